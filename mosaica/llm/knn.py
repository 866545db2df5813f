"""Exact top-k by inner product: a Voronoi kNN join.

Vectors are grouped by their nearest pivot (cell), and within a cell by how far they reach along the pivot (shell). A shell's summary
is its size, the range of its members' components along the pivot and the greatest length across it; from it max(a lo, a hi) + b r
bounds the score of every member for a query with components a along and b across. Each query's k-th best score so far is a
threshold that its answer cannot fall below, so it is sent only to shells whose bound reaches it: first, against a bounded
sample's scores, to those of its own cell, then, against what it found there, to the others. Shells are cut into blocks of bounded size,
and a block's queries into portions, which are solved locally: a block's vectors are held, its queries stream past in batches.

Where the data have no clusters, bounds in many dimensions reach every threshold and all pairs of queries and blocks are solved;
``report`` tells the share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, SCALE = 10, 1024.0
MAX_PIVOTS, SAMPLE = 256, 4096
LEAST_BLOCK, MOST_BLOCK, QUERY_BATCH = 512, 1 << 16, 1024
MOST_SHELLS = 64  # of a cell
QUERIES = 1 << 16  # of a block that one task answers


def quantised(column, scale: float = SCALE):
    return F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products. Through doubles where no sum can pass 2^53, else in 64-bit integers; beyond these: an error."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    bound = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    if bound < 2**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    raise OverflowError("scores pass 64 bits")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query: score down, id up."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _along(x: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of each row along its unit vector, and across it."""
    t = (x * units).sum(axis=1)
    return t, np.sqrt(np.maximum(0.0, (x * x).sum(axis=1) - t * t))


def _units(pivots: np.ndarray) -> np.ndarray:
    return pivots / np.maximum(np.sqrt((pivots**2).sum(axis=1)), 1e-300)[:, None]


def top_k(vectors: DataFrame, every: int = 100, k: int = K, max_pivots: int = MAX_PIVOTS, sample: int = SAMPLE, least_block: int = LEAST_BLOCK, report: dict | None = None) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: its k best among all other rows: query_id, rank, vec_id, score.

    Vectors that are null or hold null or non-finite components (or ones beyond double range once scaled) take no part, nor do
    rows without vec_id. Vectors of different lengths are no candidates of each other. Rows that repeat a vec_id are each a
    candidate (a query's own row is any row with its vec_id); a repeated query is answered once, for its smallest vector. Extra columns are ignored, an
    empty table gives no rows. To the driver go ``sample`` vectors at most and one summary a shell, of which a cell has
    ``MOST_SHELLS`` at most. ``report`` gets queries, blocks, and pairs (of a query and a block that it was sent to)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf")))
    named = common.only(vectors, vec_id="long", embedding="array<double>").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    valid = named.where(F.coalesce(finite, F.lit(False))).select("vec_id", quantised("embedding").alias("v"))
    drawn = valid.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    total = valid.count()
    out = "query_id long, vec_id long, score long"
    spark = vectors.sparkSession
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    block = int(min(MOST_BLOCK, max(least_block, total // 200)))
    pivots: dict[int, np.ndarray] = {}
    samples: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in sorted({len(r.v) for r in drawn}):
        own = [r for r in drawn if len(r.v) == d]
        samples[d] = np.array([r.vec_id for r in own]), np.array([r.v for r in own]).reshape(len(own), d)
        pivots[d] = np.unique(samples[d][1], axis=0)[: max(1, min(max_pivots, total // block))]
    sent = spark.sparkContext.broadcast((pivots, samples))

    def nearest(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return ((p**2).sum(axis=1)[None] - 2 * (x @ p.T)).argmin(axis=1)

    def assign(batch):
        pivots, _ = sent.value
        ids, values = batch.column(0).to_numpy(), batch.column(1)
        sizes, flat = values.value_lengths().to_numpy(), values.flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            x = flat[starts[rows][:, None] + np.arange(d)]
            p = pivots.get(int(d), np.zeros((1, d)))
            best = nearest(x, p)
            along, across = _along(x, _units(p)[best])
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(np.full(len(rows), d, np.int32)), pa.array(best.astype(np.int32)), pa.array(along), pa.array(across), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "dim", "cell", "along", "across", "v"])

    cells = common.stored(common.map_batches(valid, assign, "vec_id long, dim int, cell int, along double, across double, v binary"), "knn-cells")
    ranges = {(r.dim, r.cell): (r.n, r.lo, r.hi) for r in cells.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("along").alias("lo"), F.max("along").alias("hi")).collect()}
    shells_of = {key: (lo, (hi - lo) / m if hi > lo else 1.0, m) for key, (n, lo, hi) in ranges.items() if (m := max(1, min(MOST_SHELLS, n // block)))}
    shelled = spark.sparkContext.broadcast(shells_of)

    def place(batch):
        """Each vector's shell."""
        keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        along = batch.column(3).to_numpy()
        told = np.array([shelled.value[key] for key in keys])
        shell = np.clip((along - told[:, 0]) // told[:, 1], 0, told[:, 2] - 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shell)], names=["vec_id", "dim", "cell", "along", "across", "v", "shell"])

    placed = common.map_batches(cells, place, "vec_id long, dim int, cell int, along double, across double, v binary, shell int")
    summary = placed.groupBy("dim", "cell", "shell").agg(F.count(F.lit(1)).alias("n"), F.min("along").alias("lo"), F.max("along").alias("hi"), F.max("across").alias("across")).collect()
    cuts = {(r.dim, r.cell, r.shell): -(-r.n // block) for r in summary}
    bounds = {}
    for d in {r.dim for r in summary}:
        own = sorted((r for r in summary if r.dim == d), key=lambda r: (r.cell, r.shell))
        bounds[d] = tuple(np.array([r[x] for r in own]) for x in ("cell", "shell", "lo", "hi", "across"))
    queries = common.stored(valid.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "knn-queries")
    portions = max(1, -(-queries.count() // QUERIES))
    told = spark.sparkContext.broadcast((bounds, cuts))
    portion = lambda i: (i * 0x9E3779B97F4A7C15 >> 20) % portions

    def deal(batch):
        """Each vector to its block, once for each portion of the queries."""
        cuts = told.value[1]
        ids, dims, own, shells = (batch.column(i).to_pylist() for i in (0, 1, 2, 6))
        keys = [f"{d}:{c}:{s}:{(i * 0x9E3779B1 >> 7) % cuts[d, c, s]}" for i, d, c, s in zip(ids, dims, own, shells, strict=True)]
        n = len(ids)
        for part in range(portions):
            yield pa.RecordBatch.from_arrays([pa.array([f"{key}:{part}" for key in keys]), pa.array(np.zeros(n, np.int32)), batch.column(0), pa.nulls(n, pa.int64()), batch.column(5)], names=["key", "query", "id", "least", "v"])

    def ask(home: bool):
        """Each query to the blocks that may hold one of its answers: those of its own cell (home), or of the others."""

        def run(batch):
            (pivots, samples), (bounds, cuts) = sent.value, told.value
            rows = []
            for vec_id, v, known in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                q = np.array(v, np.float64)
                d, raw = len(q), q.tobytes()
                if d not in bounds:
                    continue
                near, x = samples.get(d, (np.empty(0, np.int64), np.empty((0, d))))
                scores = np.sort(_exact(q[None], x)[0][near != vec_id])
                least = int(scores[-k]) if len(scores) >= k else None
                if known is not None and (least is None or known > least):
                    least = known
                p = pivots.get(d, np.zeros((1, d)))
                cell, shell, lo, hi, across = bounds[d]
                own = int(nearest(q[None], p)[0])
                along = _units(p) @ q
                beside = np.sqrt(np.maximum(0.0, (q * q).sum() - along**2))
                a, b = along[cell], beside[cell] * across
                top = np.maximum(a * lo, a * hi) + b
                reach = top + 1e-9 * (np.abs(top) + b) + 1 >= (least if least is not None else -np.inf)
                for j in np.flatnonzero(reach & ((cell == own) == home)).tolist():
                    key = (d, int(cell[j]), int(shell[j]))
                    rows += [(f"{key[0]}:{key[1]}:{key[2]}:{i}:{portion(vec_id)}", 1, vec_id, least, raw) for i in range(cuts[key])]
                if len(rows) > 8192:
                    yield dealt(rows)
                    rows = []
            if rows:
                yield dealt(rows)

        return run

    def dealt(rows):
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "query", "id", "least", "v"])

    def solve(batches):
        """Rows come sorted by block, vectors before queries."""
        key, ids, held, queue = None, [], [], []
        x = near = None

        def answers():
            got = []
            scores = _exact(np.array([np.frombuffer(r[2]) for r in queue]), x)
            for (query, least, _), own in zip(queue, scores, strict=True):
                fit = np.flatnonzero((near != query) & (own >= (least if least is not None else np.iinfo(np.int64).min)))
                got += [(query, int(near[j]), int(own[j])) for j in fit[_best(own[fit], near[fit], k)]]
            queue.clear()
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for k2, query, vec_id, least, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k2 != key:
                    if queue:
                        yield from answers()
                    key, ids, held, x = k2, [], [], None
                if not query:
                    ids.append(vec_id)
                    held.append(v)
                    continue
                if x is None:
                    near, x = np.array(ids, np.int64), np.array([np.frombuffer(r) for r in held]).reshape(len(held), len(v) // 8)
                if len(ids):
                    queue.append((vec_id, least, v))
                if len(queue) >= QUERY_BATCH:
                    yield from answers()
        if queue:
            yield from answers()

    schema = "key string, query int, id long, least long, v binary"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def answered(asked: DataFrame, home: bool) -> DataFrame:
        """The asked queries' answers; only blocks that some query was sent to are dealt out."""
        asks = common.stored(common.map_batches(asked, ask(home), schema), "knn-asked")
        if report is not None:
            report["pairs"] = report.get("pairs", 0) + asks.count()
        wanted = common.map_batches(placed, deal, schema).join(asks.select("key").distinct(), "key", "left_semi")
        return wanted.select(*asks.columns).union(asks).repartition(F.col("key")).sortWithinPartitions("key", "query").mapInArrow(solve, out)

    if report is not None:
        report |= {"queries": queries.count(), "blocks": sum(cuts.values())}
    at_home = common.stored(ranked(answered(queries.select("vec_id", "v", F.lit(None).cast("long").alias("least")), True)).drop("rank"), "knn-home")
    known = at_home.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    abroad = answered(queries.join(known, "vec_id", "left").select("vec_id", "v", "least"), False)
    return ranked(at_home.union(abroad)).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings; nulls, repeats, ties, extra columns and empty tables as in ``top_k``."""
    return top_k(common.table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q, v x WHERE q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
