"""Jail policies as tables: defaults, overlays, durations, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default of each policy column.
DEFAULTS = {
    "enabled": True,
    "date_format": "syslog",
    "max_retry": 5,
    "find_time": 600,
    "ban_time": 3600,
    "protocol": "tcp",
    "bantime_increment": False,
    "bantime_factor": 1.0,
    "bantime_maxtime": 604800,
    "log_backend": "file",
    "ignoreself": True,
    "reban_on_restart": True,
}
PROTOCOLS = ("tcp", "udp", "sctp", "dccp")


def with_defaults(policy: DataFrame) -> DataFrame:
    """Fills the columns that the table has; arrays default to empty ones."""
    for name, value in DEFAULTS.items():
        if name in policy.columns:
            policy = policy.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(policy.schema[name].dataType)))
    return policy


def overlay(layers: DataFrame, fields: list[str]) -> DataFrame:
    """Layers (jail, layer, fields...): for each jail and field, the last layer's value that is not null."""
    return layers.groupBy("jail").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("layer"))).alias(f) for f in fields])


def violations(policy: DataFrame) -> DataFrame:
    """jail, violation: every rule that a row breaks. Names are checked even for disabled jails."""
    on = F.col("enabled")
    rule = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), F.lit(text))
    port = lambda p: p.rlike(r"^\+?[0-9]{1,9}$") & (F.coalesce(p.try_cast("int"), F.lit(-1)) <= 65535)
    broken: list[Column] = [
        rule(~F.col("jail").rlike(r"^[A-Za-z0-9_-]{1,64}$"), "name"),
        rule(on & (F.col("log_backend") == "file") & (F.coalesce(F.col("log_path"), F.lit("")) == ""), "log_path"),
        rule(on & (F.coalesce(F.size("filter"), F.lit(0)) == 0), "filter"),
        rule(on & F.exists("filter", lambda p: ~p.contains("<HOST>")), "pattern"),
        rule(on & (F.col("max_retry") <= 0), "max_retry"),
        rule(on & (F.col("find_time") <= 0), "find_time"),
        rule(on & (F.col("ban_time") == 0), "ban_time"),
        rule(on & ~F.forall("port", port), "port"),
        rule(on & ~F.col("protocol").isin(*PROTOCOLS), "protocol"),
        rule(on & (F.isnan("bantime_factor") | (F.abs("bantime_factor") == float("inf")) | (F.col("bantime_factor") <= 0)), "bantime_factor"),
    ]
    found = F.filter(F.array(*broken), lambda x: x.isNotNull())
    return policy.select("jail", F.explode_outer(found).alias("violation")).filter("violation IS NOT NULL")
