"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import decontaminate, knn, mixing, pii, secrets, similarity, substrings, token_output, toxicity, warc


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_secrets": secrets.op2_secrets,
        "op3_mixing": mixing.op3_mixing,
        "op4_substring_dedup": substrings.op4_substring_dedup,
        "op5_topk": knn.op5_topk,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_warc": warc.op8_warc,
        "op9_jaccard_join": similarity.op9_jaccard_join,
        "op10_token_output": token_output.op10_token_output,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.OP3_SQL, "op4_substring_dedup": substrings.OP4_SQL, "op5_topk": knn.OP5_SQL, "op6_decontamination": decontaminate.OP6_SQL, "op8_warc": warc.OP8_SQL, "op9_jaccard_join": similarity.OP9_SQL}
