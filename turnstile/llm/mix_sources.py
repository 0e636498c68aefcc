"""Mixing sources to target weights by hash-threshold histograms (operator 9).

A document's place is a 60-bit hash of its id. Each source takes every document ``floor(target /
size)`` times, and once more those below a threshold on the hash. The threshold comes from nested
histograms: words are summed by source and hash bucket, the bucket in which the budget runs out is
split into finer buckets, and so on; nothing is sorted, and no level holds more than ``FAN`` rows a
source. The last bucket is a single hash value; it is taken if that brings the source nearer to its target.

Cases: a null text has no words and is taken as often as its hash says, with 0 words. A null source is a
source of its own, last in order. Rows with the same id share a hash and are taken or left together. A source
without words takes nothing. Null ids hash as the word "null". Extra columns stay in ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, unpacked, whole_row, words_of

WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2.0
BITS, STEP = 60, 12
FAN = 1 << STEP


def place(doc_id: Column) -> Column:
    """The first 60 bits of md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """sizes (source, source_size) with ``target``: one row per source, null last.

    Sharing what exceeds a limit again and again ends where a level times the weight, or the limit, is
    each source's target. The level follows from running sums over sources by limit per weight. Names order by
    code point: UTF-8 bytes order alike.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    df = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")))
    df = df.withColumn("_cap", F.col("source_size") * F.lit(limit)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy(F.lit(0))
    upto = every.orderBy("_ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_budget", F.least(F.sum("source_size").over(every) * F.lit(share), F.sum("_cap").over(every)))
    df = df.withColumn("_full", F.sum("_cap").over(upto)).withColumn("_left", F.sum("_w").over(every) - F.sum("_w").over(upto))
    # The level that would hold if exactly the sources up to this one were at their limit; the last such source that is under it counts.
    df = df.withColumn("_fits", F.col("_full") + F.col("_left") * F.col("_ratio") <= F.col("_budget"))
    full = F.coalesce(F.max(F.when(F.col("_fits"), F.col("_full"))).over(every), F.lit(0.0))
    left = F.coalesce(F.min(F.when(F.col("_fits"), F.col("_left"))).over(every), F.sum("_w").over(every))
    level = F.when(left > 0, (F.col("_budget") - full) / left)
    df = df.withColumn("_level", level)
    return df.select("source", "source_size", F.when(F.col("_fits") | F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def shares(sized: DataFrame, **options) -> DataFrame:
    """sized (a stored table of source, size, _place) to one row per source: sizes, target, whole copies, threshold.

    A document has one copy more than ``_copies`` where its place is below ``_limit``.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, **options)
    plan = plan.withColumn("_copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    plan = plan.withColumn("_rest", F.col("target") - F.col("_copies") * F.col("source_size")).withColumn("_low", F.lit(0).cast("long"))
    plan = stored(plan, "mix-targets")
    for shift in range(BITS - STEP, -1, -STEP):
        # Words by bucket within the range that is still open, which begins at _low.
        upper = F.lit(1 << (shift + STEP)).cast("long")
        open_ = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("_rest") > 0))
        open_ = open_.filter((F.col("_place") >= F.col("_low")) & (F.col("_place") - F.col("_low") < upper))
        bucket = F.shiftright(F.col("_place") - F.col("_low"), shift)
        sums = open_.groupBy(F.col("d.source").alias("source"), bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
        by = Window.partitionBy("source")
        sums = sums.withColumn("_upto", F.sum("_sum").over(by.orderBy("_bucket")))
        # The first bucket that goes beyond the budget, and what lies before it.
        beyond = F.col("p._rest") < F.col("s._upto")
        found = (
            sums.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).filter(beyond)
            .groupBy(F.col("p.source").alias("source")).agg(F.min_by(F.struct("s._bucket", (F.col("s._upto") - F.col("s._sum")).alias("_before"), "s._sum"), "s._bucket").alias("_b"))
        )
        joined = plan.alias("p").join(found.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")), "left")
        low = F.col("p._low") + F.shiftleft(F.col("_b._bucket"), shift)
        rest = F.col("p._rest") - F.col("_b._before")
        if shift == 0:
            low = low + F.when(F.col("_b._sum") - rest < rest, 1).otherwise(0)
        plan = joined.select("p.source", "source_size", "target", "_copies", F.when(F.col("p._rest") > 0, F.coalesce(rest, F.col("p._rest"))).otherwise(F.lit(0.0)).alias("_rest"), F.when(F.col("p._rest") <= 0, F.col("p._low")).otherwise(F.coalesce(low, F.lit(1 << BITS).cast("long"))).alias("_low"))
        plan = stored(plan, "mix-level")
    return plan.withColumnRenamed("_low", "_limit").drop("_rest")


def mixed(sized: DataFrame, **options) -> DataFrame:
    """sized with ``source_size``, ``target`` and ``_times``, the copies of each row."""
    plan = shares(sized.select("source", "size", "_place"), **options)
    out = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    times = F.col("p._copies") + F.when(F.col("d._place") < F.col("p._limit"), 1).otherwise(0)
    return out.select("d.*", "p.source_size", "p.target", times.alias("_times"))


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sized = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), place(F.col("doc_id")).alias("_place")), "mix-sizes")
    out = mixed(sized, **options)
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("_times").alias("copies"), (F.col("size") * F.col("_times")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns, whatever their names."""
    sized = stored(docs.select("source", size_of(F.col("text")).alias("size"), place(F.col("doc_id")).alias("_place")), "mix-sizes")
    plan = shares(sized, **options).select(F.col("source").alias("of"), F.col("_copies").alias("copies"), F.col("_limit").alias("limit"))
    out = docs.select(F.col("source").alias("source"), place(F.col("doc_id")).alias("place"), whole_row(docs).alias("row")).join(plan, F.col("source").eqNullSafe(F.col("of")))
    times = F.col("copies") + F.when(F.col("place") < F.col("limit"), 1).otherwise(0)
    out = out.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("copy"))
    return unpacked(out, "row", docs.columns)


#: The same mix by a running sum over the hash order.
ORACLE = """
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS sz, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM d GROUP BY source),
w AS (SELECT source, sz, 2 * sz AS cap, CASE (r - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM s),
lv AS (
  SELECT max(level) AS level FROM (
    SELECT (b.budget - sum(CASE WHEN x.cap / x.w <= y.cap / y.w THEN x.cap ELSE 0 END)) / nullif(sum(CASE WHEN x.cap / x.w <= y.cap / y.w THEN 0 ELSE x.w END), 0) AS level,
           sum(least(x.cap, x.w * (y.cap / y.w))) AS used, b.budget
    FROM (SELECT * FROM w UNION ALL SELECT NULL, 0, 0, 1) y, w x, (SELECT 1.5 * sum(sz) AS budget FROM w) b
    GROUP BY y.source, y.cap, y.w, b.budget) WHERE used <= budget AND level IS NOT NULL),
t AS (SELECT w.source, w.sz, CASE WHEN lv.level IS NULL THEN w.cap ELSE least(w.cap, lv.level * w.w) END AS target FROM w, lv),
c AS (SELECT source, sz, target, CASE WHEN sz > 0 THEN floor(target / sz) ELSE 0 END AS copies FROM t),
h AS (SELECT source, place, sum(size) AS hs FROM d GROUP BY source, place),
u AS (SELECT h.*, sum(hs) OVER (PARTITION BY source ORDER BY place) AS upto FROM h),
k AS (SELECT u.source, u.place, c.target - c.copies * c.sz AS rest, u.upto, u.hs, c.copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source),
f AS (SELECT source, min(place) AS first_over FROM k WHERE upto > rest AND rest > 0 GROUP BY source),
x AS (SELECT k.source, k.place, k.copies + CASE WHEN k.rest <= 0 THEN 0 WHEN f.first_over IS NULL OR k.place < f.first_over THEN 1
        WHEN k.place = f.first_over AND k.upto - k.rest < k.rest - (k.upto - k.hs) THEN 1 ELSE 0 END AS times
      FROM k LEFT JOIN f ON k.source IS NOT DISTINCT FROM f.source)
SELECT d.doc_id, d.size, CAST(c.sz AS BIGINT) AS source_size, round(c.target, 3) AS target, CAST(d.size * x.times AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.place = x.place
"""
