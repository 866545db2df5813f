"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct 5-word shingles, in one global order: rare ones first. If two sets of similarity 0.8 or more
share m shingles, the first l of these stand among the first |x| - ceil(0.8 |x|) + l of both; so pairs that share fewer than l of
such an l-prefix need no verification. Each document chooses its own l: longer prefixes make more postings to read but require
more matches, and the cheaper product of both, estimated from exact shingle frequencies, wins. Two documents are compared at
the smaller of their l.

1. Frequencies: each chunk of documents sends its distinct shingles (cut hashes) with counts to the part that owns their range,
   and gets back those that occur more than once in all. A shingle that occurs once cannot match, so it needs no posting: a
   document with more than a fifth of such shingles has none at all.
2. Equal sets are one node. Nodes post the shingles of their prefix.
3. Links are found in rounds. First every list's most central node is verified against the list (a star), twice; what these
   links join needs no further test, as only components are asked for. Then all pairs of nodes that still lie in different
   components and match l times are verified. So a group of many near copies costs about as many tests as it has members,
   and no link between different texts is lost. Each round follows only the links it has found, between the components so far.
4. Verification streams: a node's set is held while its partners' sets pass. Nodes of very many partners are cut up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, rolling
from .components import components

SHINGLE, PERCENT = 5, 80
MOST_MATCHES = 4  # the largest l
VERIFY_COST = 20.0  # of one verification, in postings read
STARS = 2
FEW = 32  # chunks of one text up to which its own shingles can be told from shared ones
RARE = 16  # frequency up to which a shingle is rare
PARTNERS = 64  # that one task verifies against one node at a time

COUNTS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("raw", pa.binary()), ("n", pa.binary())])
BACK = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("raw", pa.binary()), ("n", pa.binary())])
NODES = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("need", pa.int32()), ("few", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int64())), ("levels", pa.list_(pa.int32())), ("rare", pa.list_(pa.bool_())), ("raw", pa.binary()), ("is_doc", pa.bool_())])
NODES_SQL = "doc_id long, node long, n int, need int, few array<int>, tokens array<long>, levels array<int>, rare array<boolean>, raw binary, is_doc boolean"


def lowered(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone are lowered


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of the k-word shingles; of fewer words, of all of them."""
    if not words:
        return np.empty(0, np.uint64)
    h = rolling.word_hashes(words)
    return np.unique(rolling.windows(h, min(k, len(words))) ^ np.uint64(0 if len(words) >= k else len(words)))


def node_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def prefix(own: np.ndarray, df: np.ndarray, percent: int = PERCENT) -> tuple[int, np.ndarray, np.ndarray]:
    """(l, places of posted shingles, their levels). A shingle of level j enters with the j-prefix."""
    n = len(own)
    least = -(-percent * n // 100)  # shingles that a similar set must share
    base = n - least + 1
    order = np.lexsort((own, df))
    most = max(1, min(MOST_MATCHES, least))
    reach = np.cumsum(np.where(df[order] > 1, df[order] - 1.0, 0.0))
    costs = [reach[min(n, base + level - 1) - 1] * (1 + VERIFY_COST / level) for level in range(1, most + 1)]
    need = int(np.argmin(costs)) + 1
    end = min(n, base + need - 1)
    levels = np.maximum(1, np.arange(end) - base + 2)
    shared = df[order[:end]] > 1
    return need, order[:end][shared], levels[shared]


def _sets(texts, k: int):
    """Per text its shingles and node; the distinct nodes' shingles."""
    rows, held = [], {}
    for t in texts:
        own = shingles(lowered(t.as_py()), k)
        node = node_of(own) if len(own) else None
        rows.append((len(own), node))
        if node is not None and node not in held:
            held[node] = own
    return rows, held


def nodes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of documents (is_doc: doc_id, node, n) and of nodes that may have links (tokens, levels, need, few, raw), stored."""
    narrow = common.only(docs, doc_id="long", text="string")
    chunks, parts = rolling.plan(narrow)
    text, deal = rolling.chunked(narrow, chunks), rolling.Deal(parts)

    def count(table: pa.Table) -> pa.Table:
        _, held = _sets(table["text"], k)
        keys = deal.cut(np.concatenate(list(held.values()))) if held else np.empty(0, np.uint64)
        distinct, n = np.unique(keys, return_counts=True)
        few = np.minimum(n, 65535).astype("<u2")
        chunk = table["chunk"][0].as_py()
        rows = [(p, chunk, deal.pack(p, distinct[s]), few[s].tobytes()) for p, s in deal.split(distinct)]
        return rolling.batch(COUNTS, *(zip(*rows, strict=True) if rows else [[]] * 4))

    def total(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        lists = [deal.unpack(part, raw.as_py()) for raw in table["raw"]]
        keys = np.concatenate(lists)
        n = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in table["n"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sums = np.add.reduceat(n[order], first)
        good = sums > 1
        chosen, sums = ordered[first[good]], np.minimum(sums[good], 65535).astype("<u2")
        rows = []
        for chunk, own in zip(table["chunk"].to_pylist(), lists, strict=True):
            if len(chosen):
                at = np.minimum(np.searchsorted(chosen, own), len(chosen) - 1)
                hit = chosen[at] == own
                if hit.any():
                    rows.append((chunk, part, deal.pack(part, own[hit]), sums[at[hit]].tobytes()))
        return rolling.batch(BACK, *(zip(*rows, strict=True) if rows else [[]] * 4))

    def post(table: pa.Table, back: pa.Table) -> pa.Table:
        rows, held = _sets(table["text"], k)
        out = [(doc_id, node, n, None, None, None, None, None, None, True) for doc_id, (n, node) in zip(table["doc_id"].to_pylist(), rows, strict=True)]
        if back.num_rows:
            keys = np.concatenate([deal.unpack(p.as_py(), raw.as_py()) for p, raw in zip(back["part"], back["raw"], strict=True)])
            often = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in back["n"]]).astype(np.int64)
            order = np.argsort(keys)
            keys, often = keys[order], often[order]
            for node, own in held.items():
                cut = deal.cut(own)
                at = np.minimum(np.searchsorted(keys, cut), len(keys) - 1)
                df = np.where(keys[at] == cut, often[at], 1)
                need, places, levels = prefix(own, df, percent)
                if len(levels) and levels[0] == 1:
                    out.append((None, node, len(own), need, np.bincount(df[df <= FEW], minlength=FEW + 1)[1:].astype(np.int32), own[places].astype(np.int64), levels, df[places] <= RARE, rolling.pack(own, 8), False))
        return rolling.batch(NODES, *(zip(*out, strict=True) if out else [[]] * 10))

    by_chunk = lambda df: df.groupBy("chunk")
    known = by_chunk(text).applyInArrow(count, "part int, chunk int, raw binary, n binary").groupBy("part").applyInArrow(total, "chunk int, part int, raw binary, n binary")
    return common.stored(by_chunk(text).cogroup(by_chunk(known)).applyInArrow(post, NODES_SQL), "jaccard-nodes")


def _alike(n1: str, own1: str, n2: str, own2: str, percent: int):
    """Whether two sets can be similar: of n shingles, only ``own`` occur elsewhere, so they share the smaller of these at most."""
    most = F.least(own1, own2)
    return most * (100 + percent) >= (F.col(n1) + F.col(n2)) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets (node, raw) are similar; stored."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("cuts"))
    dealt = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("cuts")).cast("int").alias("cut"))
    heads = dealt.select("a", "cut").distinct().join(sets, F.col("a") == F.col("node")).select("a", "cut", F.lit(None).cast("long").alias("b"), "raw")
    tails = dealt.join(sets, F.col("b") == F.col("node")).select("a", "cut", "b", "raw")

    def run(batches):
        held = own = None
        for batch in batches:
            found = []
            for a, cut, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if b is None:
                    held, own = (a, cut), rolling.unpack(raw.as_py(), 8)
                elif held == (a, cut):
                    other = rolling.unpack(raw.as_py(), 8)
                    small, large = (own, other) if len(own) <= len(other) else (other, own)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    shared = int((large[at] == small).sum())
                    if 100 * shared >= percent * (len(own) + len(other) - shared):
                        found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    rows = heads.union(tails).repartition(F.col("a"), F.col("cut")).sortWithinPartitions("a", "cut", F.col("b").asc_nulls_first())
    return common.stored(rows.mapInArrow(run, "a long, b long"), "jaccard-links")


def linked(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) for all nodes of ``nodes`` that have links: root is the smallest node that they reach; stored."""
    every = found.where("not is_doc")
    sets = every.groupBy("node").agg(F.first("raw").alias("raw"))
    # A text that m chunks hold has counted m times for each of its shingles: those that count no more are its own alone.
    one = every.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("m"), F.first(F.struct("n", "need", "few", "tokens", "levels", "rare")).alias("s"))
    one = one.withColumn("lone", F.coalesce(F.get("s.few", F.col("m") - 1), F.lit(0))).where((F.col("s.n") - F.col("lone")) * 100 >= F.col("s.n") * percent)
    # Two sets without a common rare shingle share at most what either has of others; two that have one meet in its list, as rare
    # shingles come first in all prefixes. So lists of other shingles need only hold pairs up to that stricter bound ("own").
    others = F.col("s.n") - F.aggregate(F.slice("s.few", 1, RARE), F.lit(0), lambda a, x: a + x)
    posted = one.select("node", "s.n", "s.need", "lone", others.alias("others"), F.explode(F.arrays_zip("s.tokens", "s.levels", "s.rare")).alias("t"))
    own = F.when(F.col("t.rare"), F.col("n") - F.col("lone")).otherwise(F.col("others"))
    postings = common.stored(posted.select(F.col("t.tokens").alias("token"), "node", "n", "need", "lone", F.col("t.levels").alias("level"), F.col("t.rare").alias("rare"), own.alias("own")), "jaccard-postings")
    roots = None
    for step in range(STARS + 1):
        # Postings of lists that still hold several components
        labelled = postings.withColumn("root", F.col("node")) if roots is None else postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        labelled = common.stored(labelled, "jaccard-labelled")
        # Written, so that the join below knows their size beforehand: few are broadcast without an exchange of the postings, many are
        # met in a sort-merge join, whose skewed lists adaptive execution splits.
        open_lists = labelled.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min(F.struct("lone", "node", "n", "root", "own")).alias("c")).where("x <> y")
        open_lists = common.stored(open_lists, "jaccard-lists")
        if step < STARS:
            joined = labelled.join(open_lists, "token")
            pairs = joined.where((F.col("node") != F.col("c.node")) & (F.col("root") != F.col("c.root"))).select("node", "n", "own", F.col("c.node").alias("a"), F.col("c.n").alias("an"), F.col("c.own").alias("aown"))
            pairs = pairs.where(_alike("n", "own", "an", "aown", percent)).select("a", F.col("node").alias("b")).distinct()
            # A centre has now met its whole list: its posting goes
            postings = common.stored(joined.where(F.col("node") != F.col("c.node")).select(*postings.columns), "jaccard-postings")
        else:
            rest = common.stored(labelled.join(open_lists.select("token"), "token", "left_semi"), "jaccard-rest")
            # Pairs of components in a list, as far as their most similar members could be linked; then their members
            # The smaller set of a link has own * (100 + percent) >= 2 * n * percent, as _alike says; so a group without such a set meets
            # those alone that have one. Texts that share a long passage, each with more of its own than a link allows, have none: a list
            # of any number of them makes no pairs.
            wide = F.max(F.col("own") * (100 + percent) - F.col("n") * 2 * percent) >= 0
            group = lambda i: rest.groupBy("token", F.col("root").alias(f"r{i}")).agg(F.min("n").alias(f"n{i}"), F.max("own").alias(f"own{i}"), F.count(F.lit(1)).alias(f"m{i}"), wide.alias(f"wide{i}"))
            once = (F.col("r1") != F.col("r2")) & (~F.col("wide2") | (F.struct("m1", "r1") > F.struct("m2", "r2")))
            across = group(1).where("wide1").join(group(2), "token").where(once).where(_alike("n1", "own1", "n2", "own2", percent)).select("token", "r1", "r2")
            # A pair is taken from the list of its first common shingle alone, and only if it matches often enough. That list still
            # holds both: a closed one cannot, being of one component, and one that lost either to a star has had the pair tested.
            arrays = common.stored(one.select("node", "s.tokens", "s.levels").join(rest.select("node").distinct(), "node", "left_semi"), "jaccard-prefixes")
            whole = rest.join(arrays, "node")
            side = lambda i, x: whole.select("token", F.col("root").alias(f"r{i}"), F.col("node").alias(x), *(F.col(c).alias(x + c) for c in ("n", "need", "own", "tokens", "levels")))
            need = F.least("aneed", "bneed")
            within = lambda x: F.slice(f"{x}tokens", F.lit(1), F.size(F.filter(f"{x}levels", lambda level: level <= need)))
            shared = F.array_intersect(within("a"), within("b"))
            met = across.join(side(2, "b"), ["token", "r2"]).join(side(1, "a"), ["token", "r1"])  # the smaller one is spread first
            pairs = met.where(_alike("an", "aown", "bn", "bown", percent) & (F.size(shared) >= need) & (F.get(shared, F.lit(0)) == F.col("token"))).select("a", "b")
        roots = components(verified(common.stored(pairs, "jaccard-pairs"), sets, percent), known=roots)
    return roots


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that its links reach).

    Documents without words have an empty set, no links, and are their own component. Null doc_ids take part like others but
    are no component_id unless all of a component are null. Rows that repeat a doc_id are documents of their own. Extra columns
    are ignored; an empty table gives no rows."""
    found = nodes(docs, k, percent)
    roots = linked(found, percent)
    rows = found.where("is_doc").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node")
    some = rows.where("node IS NOT NULL").join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    least = common.stored(some.groupBy("root").agg(F.min("doc_id").alias("component_id")), "jaccard-least")  # lets the join's skew be split
    return some.join(least, "root").select("doc_id", "n_shingles", "component_id").union(rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, one row each; nulls, repeats, extra columns and empty tables as in ``near_duplicates``."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM met JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT x, y FROM edge UNION SELECT a, y FROM reach JOIN edge ON b = x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(r.b, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = doc_id
"""
