"""The threshold rule: max_retry failures of an address in a jail that span less than find_time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _by():
    return Window.partitionBy("ip", "jail").orderBy("ts", "seq")


def threshold(failures: DataFrame, max_retry: int, find_time: int) -> DataFrame:
    """Failures with span (to the one max_retry - 1 before) where the rule holds."""
    df = failures.withColumn("span", F.col("ts") - F.lag("ts", max_retry - 1).over(_by()))
    return df.filter(F.col("span") < find_time)


def reached(failures: DataFrame, rules: list[tuple[str, int, int]]) -> DataFrame:
    """Failures at which a rule (jail, max_retry, find_time) of their jail holds, from one sort for all rules."""
    df = failures
    for n in sorted({n for _, n, _ in rules}):
        df = df.withColumn(f"_span{n}", F.col("ts") - F.lag("ts", n - 1).over(_by()))
    holds = F.lit(False)
    for jail, n, t in rules:
        holds = holds | ((F.col("jail") == jail) & (F.col(f"_span{n}") < t))
    return df.filter(holds).select(*failures.columns)


def threshold_by_policy(failures: DataFrame, policy: DataFrame) -> DataFrame:
    """As threshold, with each jail's max_retry and find_time from a policy table; one sort, and a look back for each distinct max_retry."""
    df = failures.join(policy.filter("enabled").select("jail", "max_retry", "find_time"), "jail")
    back = F.lit(None).cast("long")
    for r in policy.filter("enabled").select("max_retry").distinct().collect():  # a policy is as long as its jails
        back = F.when(F.col("max_retry") == r["max_retry"], F.lag("ts", r["max_retry"] - 1).over(_by())).otherwise(back)
    return df.withColumn("span", F.col("ts") - back).filter("span < find_time")


def ring(failures: DataFrame, max_retry: int, find_time: int) -> DataFrame:
    """The same rule on a frame of the last max_retry rows."""
    frame = _by().rowsBetween(-(max_retry - 1), 0)
    df = failures.withColumn("filled", F.count(F.lit(1)).over(frame)).withColumn("oldest", F.min("ts").over(frame))
    return df.withColumn("reached", (F.col("filled") == max_retry) & (F.col("ts") - F.col("oldest") < find_time))


def in_range(failures: DataFrame, max_retry: int, find_time: int) -> DataFrame:
    """The same rule on a frame of time."""
    frame = Window.partitionBy("ip", "jail").orderBy("ts").rangeBetween(-(find_time - 1), 0)
    df = failures.withColumn("within", F.count(F.lit(1)).over(frame))
    return df.withColumn("reached", F.col("within") >= max_retry)


def first_hits(failures: DataFrame, max_retry: int, find_time: int) -> DataFrame:
    """The first threshold hit of each address and jail."""
    hits = threshold(failures, max_retry, find_time)
    return hits.groupBy("ip", "jail").agg(F.min(F.struct("ts", "seq")).alias("h")).select("ip", "jail", F.col("h.ts").alias("ts"), F.col("h.seq").alias("seq"))


def what_if(failures: DataFrame, policies: list[tuple[str, int, int]]) -> DataFrame:
    """Hits and addresses under several (name, max_retry, find_time), from one sort of the failures."""
    df = failures
    for i, (_, n, t) in enumerate(policies):
        df = df.withColumn(f"_h{i}", F.coalesce(F.col("ts") - F.lag("ts", n - 1).over(_by()) < t, F.lit(False)))
    each = df.groupBy("ip", "jail").agg(*[F.count_if(f"_h{i}").alias(f"_h{i}") for i in range(len(policies))])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("policy"), F.col(f"_h{i}").alias("n")) for i, (name, _, _) in enumerate(policies)]))
    return each.select("ip", "jail", rows.alias("r")).groupBy("jail", "r.policy").agg(F.sum("r.n").alias("hits"), F.count_if(F.col("r.n") > 0).alias("would_ban"))
