import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from mosaica.llm import common, decontaminate, mixing, toxicity

from .helpers import awkward, docs
from .test_text_dedup import brute_components
from .test_tokens import brute


def test_each_stage_on_its_own_input(spark, sf):
    """Every stage against a plain version over the same input."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    columns = d.columns
    model = toxicity.fit(*toxicity.labelled_sample(d, common.table(spark, sf, "labels")))
    rows = d.collect()
    scores, _ = toxicity.tag([r.text for r in rows], model)
    one = common.stored(p.drop_toxic(spark, d, sf), "t")
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {r.doc_id for r, s in zip(rows, scores, strict=True) if s < 0.5}

    want = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in one.collect()])}
    two = common.stored(p.drop_near_duplicates(spark, one, sf), "t")
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(want)

    items = [(r.item_id, decontaminate.normalised(r.text)) for r in common.table(spark, sf, "benchmark").collect()]
    automaton, kept = decontaminate.Automaton(items), {}
    for r in two.collect():
        words = decontaminate.normalised(r.text)
        spans, _ = automaton.scan(words)
        if sum(b - a for a, b in spans) <= decontaminate.MAX_COVERAGE * len(words):
            kept[r.doc_id] = decontaminate.clean_text(r.text, spans)
    three = common.stored(p.remove_benchmark(spark, two, sf), "t")
    assert three.columns == columns and {r.doc_id: r.text for r in three.collect()} == kept

    four = common.stored(p.mix_sources(spark, three, sf), "t")
    assert four.columns == columns and {r.doc_id for r in four.collect()} == {r.doc_id for r in mixing.plan_mix(three).where("taken").collect()}

    slots = {r.doc_id: (r.slot, hashlib.md5(str(r.doc_id).encode()).hexdigest()) for r in mixing.plan_mix(three).collect()}
    order = sorted(((r.doc_id, r.text) for r in four.collect()), key=lambda r: slots[r[0]])
    five = [tuple(r) for r in p.write_tokens(spark, four, sf).orderBy("start").collect()]
    assert five == brute(order, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), ordered=True)


def test_run(spark, sf):
    out = p.run(spark, sf)
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    assert 0 < out.count() <= spark.read.parquet(f"{sf}/documents.parquet").count()


def test_awkward_rows_pass_every_stage(spark, sf):
    d = awkward(spark)
    for _, stage in p.STAGES:
        d = common.stored(stage(spark, d, sf), "t")
    assert d.count() > 0
    d = awkward(spark).limit(0)
    for _, stage in p.STAGES:
        d = common.stored(stage(spark, d, sf), "t")
    assert d.count() == 0


def test_one_of_each_group_stays_though_ids_repeat(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (None, text), (None, "quite another text of some more words than five"), (None, "quite another text of some more words than five"), (2, "a third text that nothing else here is like")]
    got = sorted(r.text for r in p.drop_near_duplicates(spark, docs(spark, rows), "").collect())
    assert got == sorted([text, "quite another text of some more words than five", "a third text that nothing else here is like"])
    assert np.isfinite(1)
