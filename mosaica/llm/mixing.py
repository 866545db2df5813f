"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's documents, in a fixed shuffled order (MD5 of doc_id), are laid end to end and cut into blocks of ``block_chars``
characters. Target weights are whole numbers w(s) of sum P (fractions are brought to a common denominator, never rounded). Block
b of s is released at slot floor(b P / w) and due by slot ceil((b + 1) P / w); earliest-deadline-first over the released blocks
meets every deadline, so after any number of slots each source is less than one block from its share. The schedule repeats
after P slots exactly, so one period, made from the weights alone on the driver (P entries, whatever the size of the data),
places every block in closed form, and the deviation never adds up.

A source that has run out leaves its later slots empty, and the mix goes on until every document is placed; ``held`` tells
which documents stand before that, where all sources still hold their weights. ``whole=False`` takes those alone.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_CHARS = 4096
MAX_PERIOD = 1 << 20  # slots of a period: the sum of the weights in lowest terms
MAX_SOURCES = 20_000
NATURAL, TEMPERED = 1 << 16, 1000  # sums, about, of the weights that are made from sizes
BUCKET_ROWS = 2048
HOT = 16  # buckets of so many times as many rows hold a repeated doc_id and are split further


def exact(weights: dict[str, float | int | Fraction]) -> dict[str, int]:
    """Weights as whole numbers in lowest terms. A float stands for the decimal it is written as; weights of 0 go."""
    known = {s: w if isinstance(w, (int, Fraction)) else Fraction(str(w)) for s, w in sorted(weights.items())}
    if any(w < 0 for w in known.values()):
        raise ValueError("a weight is negative")
    known = {s: Fraction(w) for s, w in known.items() if w}
    if not known:
        return {}
    scale = math.lcm(*(w.denominator for w in known.values()))
    whole = {s: int(w * scale) for s, w in known.items()}
    common_factor = math.gcd(*whole.values())
    return {s: w // common_factor for s, w in whole.items()}


def _parts(sizes: dict[str, int], of: int) -> dict[str, int]:
    """Whole numbers that divide ``of`` in the ratio of the sizes, each 1 at least, to the nearest."""
    total = max(1, sum(sizes.values()))
    return {s: max(1, (2 * n * of + total) // (2 * total)) for s, n in sizes.items()}


def natural(sizes: dict[str, int]) -> dict[str, int]:
    """Target weights that are the sources' shares of all characters, in 65,536ths."""
    return _parts(sizes, NATURAL)


def tempered(sizes: dict[str, int]) -> dict[str, int]:
    """Target weights in the ratio of the square roots of the sources' characters, in thousandths: large sources count for less
    than they hold, small ones for more."""
    return _parts({s: math.isqrt(n) for s, n in sizes.items()}, TEMPERED)


def schedule(q: dict[str, int]) -> list[tuple[str, int]]:
    """One period, earliest deadline first: (source, its block number within the period) by slot."""
    Q, out = sum(q.values()), []
    waiting: list[tuple[int, str, int]] = [(0, s, 0) for s in q]  # by release
    ready: list[tuple[int, str, int]] = []  # by deadline, then name
    heapq.heapify(waiting)
    for t in range(Q):
        while waiting and waiting[0][0] <= t:
            _, s, b = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(b + 1) * Q // q[s]), s, b))
        _, s, b = heapq.heappop(ready)
        out.append((s, b))
        if b + 1 < q[s]:
            heapq.heappush(waiting, ((b + 1) * Q // q[s], s, b + 1))
    return out


def _placed(docs: DataFrame, weights, block_chars: int, whole: bool) -> DataFrame | None:
    """docs' rows as doc_id, source_name, size, block, release, deadline, slot, taken, held; None where there is no row."""
    # Narrow rows, written once: the text is read for its length alone. _key orders a source: MD5 of the doc_id, then size, then a
    # number that tells rows apart which repeat both, so that any of them can be split.
    salt = F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0")
    size = F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), size.alias("_size"),
        F.concat(F.coalesce(F.md5(F.col("doc_id").cast("long").cast("string")), F.lit("-" * 32)), F.lpad(F.hex(size), 16, "0"), salt).alias("_key"),
    )
    rows = common.stored(rows, "mix-rows")
    most = rows.groupBy("_source").count().agg(F.max("count")).first()[0]
    if not most:
        return None
    digits = 0
    while most > BUCKET_ROWS * 16**digits:
        digits += 1
    # Prefix sums in three levels, so that no task needs a whole source: over groups of buckets, over the buckets of a group, then
    # within each bucket. A bucket is a prefix of the key; one that a repeated doc_id fills is split by longer prefixes.
    prefix = F.substring("_key", 1, digits) if digits else F.lit("")
    keyed = rows.withColumn("_bucket", prefix)
    summed = lambda df: df.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_chars"), F.count(F.lit(1)).alias("_n"))
    buckets = common.stored(summed(keyed), "mix-buckets")
    hot = buckets.where(F.col("_n") > HOT * BUCKET_ROWS).select("_source", "_bucket", F.lit(True).alias("_hot"))
    if hot.take(1):
        longer = 48 + digits
        keyed = keyed.join(hot, ["_source", "_bucket"], "left").withColumn("_bucket", F.when(F.col("_hot"), F.substring("_key", 1, longer)).otherwise(F.col("_bucket"))).drop("_hot")
        buckets = common.stored(summed(keyed), "mix-buckets")
    totals = buckets.groupBy("_source").agg(F.sum("_chars").alias("chars")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix by a coarser one")
    sizes = {r["_source"]: r.chars for r in totals}
    made = natural(sizes) if weights is None else weights(sizes) if callable(weights) else weights
    q = exact({s: w for s, w in made.items() if s in sizes})
    period = sum(q.values())
    if period > MAX_PERIOD:
        raise ValueError(f"these weights repeat after {period} slots; give whole numbers of a sum up to {MAX_PERIOD}")
    plan = schedule(q)
    slots = {sb: t for t, sb in enumerate(plan)}
    end = min((blocks // q[s] * period + slots[s, blocks % q[s]] for s in q if (blocks := max(1, -(-sizes[s] // block_chars)))), default=0)

    spark, names = docs.sparkSession, sorted(q)
    turns: dict[str, list[str]] = {s: [] for s in names}
    for t, (s, _) in enumerate(plan):
        turns[s].append(str(t))
    sources = [F.struct(F.lit(s).alias("_source"), F.lit(i).alias("_n"), F.lit(q[s]).alias("_q"), F.lit(" ".join(turns[s])).alias("_turns")) for i, s in enumerate(names)]
    nobody = F.struct(F.lit(None).cast("string").alias("_source"), F.lit(-1).alias("_n"), F.lit(0).alias("_q"), F.lit("0").alias("_turns"))
    known_sources = spark.range(1).select(F.explode(F.array(*(sources or [nobody]))).alias("x")).select("x.*")
    source_rows = known_sources.drop("_turns")
    period_rows = known_sources.select("_n", F.posexplode(F.split("_turns", " ")).alias("_i", "_slot")).withColumn("_slot", F.col("_slot").cast("int"))  # MAX_PERIOD rows at most

    coarse = F.substring("_bucket", 1, max(0, digits - 3))
    groups = buckets.groupBy("_source", coarse.alias("_group")).agg(F.sum("_chars").alias("_chars"))
    running = lambda *by: F.sum("_chars").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_chars")
    before = groups.select("_source", "_group", running("_source", "_group").alias("_before"))
    offsets = buckets.withColumn("_group", coarse).withColumn("_within", running("_source", "_group", "_bucket")).join(before, ["_source", "_group"])
    offsets = common.stored(offsets.select("_source", "_bucket", (F.col("_before") + F.col("_within")).alias("_offset")), "mix-offsets")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = keyed.withColumn("_local", F.sum("_size").over(inside) - F.col("_size")).join(offsets, ["_source", "_bucket"])
    blocked = started.withColumn("block", F.expr(f"(_offset + _local) div {block_chars}"))
    known = blocked.join(F.broadcast(source_rows), "_source", "left")
    slotted = known.withColumn("_i", (F.col("block") % F.col("_q")).cast("int")).join(F.broadcast(period_rows), ["_n", "_i"], "left")
    placed = slotted.select(
        "doc_id", F.col("_source").alias("source_name"), F.col("_size").alias("size"), "block",
        F.expr(f"block * {period} div _q").alias("release"), F.expr(f"((block + 1) * {period} + _q - 1) div _q").alias("deadline"),
        F.expr(f"block div _q * {period} + _slot").alias("slot"),
    )
    held = F.coalesce(F.col("slot") < end, F.lit(False))
    return placed.withColumn("taken", F.col("slot").isNotNull() if whole else held).withColumn("held", held)


def plan_mix(docs: DataFrame, weights=None, block_chars: int = BLOCK_CHARS, whole: bool = True) -> DataFrame:
    """Per document: doc_id, source, size, block, release, deadline, slot, taken, held. Order by (slot, block order) is the mix.

    ``weights``: by source, or a function of the sources' sizes in characters that gives them (default ``natural``). They are
    taken exactly; in lowest terms their sum may be ``MAX_PERIOD`` at most, else it raises. Sources without a weight are not taken and
    have no slot. ``held``: before the first source runs out. ``taken``: all that have a slot, or with ``whole=False`` those held.
    A null source counts as the source ``""``; null doc_ids come first in their source; null and empty texts have size 0 and share
    the block at their place. Rows that repeat a doc_id are documents of their own, ordered by size; any number of them, null ids
    included, is dealt to many tasks. Extra columns are ignored; an empty table gives no rows."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    placed = _placed(narrow, weights, block_chars, whole)
    if placed is None:
        placed = narrow.select("doc_id", F.col("source").alias("source_name"), *(F.lit(0).cast("long").alias(n) for n in ("size", "block", "release", "deadline", "slot")), F.lit(False).alias("taken"), F.lit(False).alias("held"))
    return placed.withColumnRenamed("source_name", "source")


def mix(docs: DataFrame, weights=None, **options) -> DataFrame:
    """The rows of docs that the mix takes, all columns kept, in the mix's order from the first file to the last.

    Which rows: those of ``plan_mix`` by doc_id; of rows that repeat a doc_id all are taken if the first of them is, at its
    place."""
    own, at = common.fresh("_taken", docs.columns), common.fresh("_at", docs.columns)
    places = plan_mix(docs, weights, **options).where("taken").groupBy(F.col("doc_id").alias(own)).agg(F.min("slot").alias(at))
    places = common.stored(places, "mix-places")  # a side of its own: only joins of plain exchanges have their skew split
    # a merge join at every size: places grow with the documents, so there is no size at which to broadcast them
    placed = docs.join(places.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(places[own]))
    order = (F.col(at), F.md5(F.col(own).cast("string")))
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*(f"`{c}`" for c in docs.columns))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, every one placed, mixed to ``tempered`` weights. Nulls, repeats and empty tables as in ``plan_mix``."""
    return plan_mix(common.table(spark, sf_dir, "documents"), tempered)


OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, CAST(coalesce(length(text), 0) AS BIGINT) AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS k FROM documents),
tot AS (SELECT source, CAST(sum(size) AS BIGINT) AS chars, CAST(floor(sqrt(sum(size))) AS BIGINT) AS root FROM d GROUP BY source),
w AS (SELECT source, chars, CAST(greatest(1, (2 * root * {TEMPERED} + (SELECT sum(root) FROM tot)) // (2 * (SELECT sum(root) FROM tot))) AS BIGINT) AS weight FROM tot),
qs AS (SELECT source, chars, row_number() OVER (ORDER BY source) AS n, CAST(weight // (SELECT list_reduce(list(weight), lambda x, y: gcd(x, y)) FROM w) AS BIGINT) AS q FROM w),
lists AS (SELECT list(q ORDER BY n) AS ql, CAST(sum(q) AS BIGINT) AS period FROM qs),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS b, list_transform(ql, lambda x: CAST(0 AS BIGINT)) AS done FROM lists
  UNION ALL
  SELECT t + 1, pick.n, done[pick.n], list_transform(done, lambda x, i: CASE WHEN i = pick.n THEN x + 1 ELSE x END)
  FROM (SELECT t, done, list_min(list_filter(list_transform(ql, lambda x, i: {{'deadline': ((done[i] + 1) * period + x - 1) // x, 'n': i, 'ready': done[i] < x AND done[i] * period // x <= t + 1}}), lambda s: s.ready)) AS pick
    FROM edf, lists WHERE t + 1 < period)
),
starts AS (SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) // {BLOCK_CHARS} AS block FROM d),
ends AS (SELECT min(blocks // q * period + t) AS last FROM (SELECT n, q, period, greatest(1, (chars + {BLOCK_CHARS - 1}) // {BLOCK_CHARS}) AS blocks FROM qs, lists) e JOIN edf ON edf.n = e.n AND edf.b = blocks % q)
SELECT doc_id, source, size, block, CAST(block * period // q AS BIGINT) AS release, CAST(((block + 1) * period + q - 1) // q AS BIGINT) AS deadline,
  CAST(block // q * period + t AS BIGINT) AS slot, true AS taken, block // q * period + t < last AS held
FROM starts JOIN qs USING (source) CROSS JOIN lists CROSS JOIN ends JOIN edf ON edf.n = qs.n AND edf.b = block % q
"""
