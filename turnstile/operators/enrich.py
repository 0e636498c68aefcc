"""Networks of addresses: country, ASN, organisation.

Rows are read twice, for their addresses and for themselves, so they are written first: lines are then matched once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstile.functions import addr
from turnstile.operators.extract import holding
from turnstile.sources.tables import written

#: Bits of an address that an equi-join takes before the range is compared.
BUCKET = 16


def geo_prefix(rows: DataFrame, nets: DataFrame, fields: list[str]) -> DataFrame:
    """rows (ip) left joined with the narrowest network (cidr, ...) of either family that holds their address; one row each.

    Only distinct addresses look for networks, by the prefix lengths that there are.
    """
    rows = written(rows, "rows")
    known = written(addr.with_range(nets.select("cidr", *fields), "cidr"), "networks")
    found = holding(rows.select("ip").distinct(), known).groupBy("ip").agg(F.max_by(F.struct(*fields), F.struct("bits", "cidr")).alias("_net"))
    found = found.select(F.col("ip").alias("_ip"), "_net")
    return rows.join(found, F.col("ip") == F.col("_ip"), "left").select(*rows.columns, *[F.col(f"_net.{f}").alias(f) for f in fields])


def geo_range(rows: DataFrame, nets: DataFrame) -> DataFrame:
    """rows (ip) left joined with the narrowest version-4 range (lo_n, hi_n, ...) that holds their address; one row each.

    Ranges are dealt by the address blocks they touch, so they are compared within a block only. ``geo_prefix`` takes
    networks of both families.
    """
    rows = written(rows, "rows")
    fields = [c for c in nets.columns if c not in ("lo_n", "hi_n")]
    first, last = F.shiftright("lo_n", 32 - BUCKET), F.shiftright("hi_n", 32 - BUCKET)
    dealt = nets.withColumn("_block", F.explode(F.sequence(first, last)))
    mine = rows.select(F.col("ip").alias("_ip")).distinct().withColumn("_n", addr.v4_number(F.col("_ip"))).withColumn("_b", F.shiftright("_n", 32 - BUCKET))
    on = (F.col("_b") == F.col("_block")) & (F.col("_n") >= F.col("lo_n")) & (F.col("_n") <= F.col("hi_n"))
    width = F.struct(F.col("hi_n") - F.col("lo_n"), "lo_n")
    found = mine.join(dealt, on).groupBy("_ip").agg(F.min_by(F.struct(*fields), width).alias("_net"))
    return rows.join(found, F.col("ip") == F.col("_ip"), "left").select(*rows.columns, *[F.col(f"_net.{f}").alias(f) for f in fields])


def geo_asof(rows: DataFrame, nets: DataFrame, fields: list[str]) -> DataFrame:
    """The same for networks that do not overlap, as an as-of look-up: the last network that begins at or below the address.

    Only distinct addresses are sorted, by block; a network's beginning is put into every block it touches.
    """
    first, last = F.shiftright("lo_n", 32 - BUCKET), F.shiftright("hi_n", 32 - BUCKET)
    rows = written(rows, "rows")
    ends = nets.select(F.explode(F.sequence(first, last)).alias("_block"), F.struct("lo_n", "hi_n", *fields).alias("_net"))
    ends = ends.select("_block", F.greatest(F.col("_net.lo_n"), F.shiftleft("_block", 32 - BUCKET)).alias("_n"), F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_ip"), "_net")
    ips = rows.select(F.col("ip").alias("_ip")).distinct().withColumn("_n", addr.v4_number(F.col("_ip"))).filter("_n IS NOT NULL")
    ips = ips.select(F.shiftright("_n", 32 - BUCKET).alias("_block"), "_n", F.lit(1).alias("_kind"), "_ip", F.lit(None).cast(ends.schema["_net"].dataType).alias("_net"))
    both = ends.unionByName(ips).withColumn("_net", F.last("_net", True).over(Window.partitionBy("_block").orderBy("_n", "_kind")))
    found = both.filter("_kind = 1").select("_ip", F.when(F.col("_n") <= F.col("_net.hi_n"), F.col("_net")).alias("_net"))
    return rows.join(found, F.col("ip") == F.col("_ip"), "left").select(*rows.columns, *[F.col(f"_net.{f}").alias(f) for f in fields])
