"""Where lines, policies and ban state come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, path) of text files, split at line feeds only; a carriage return stays in the line."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))


def follow_log(spark: SparkSession, path: str, files_per_trigger: int = 100, since: str | None = None) -> DataFrame:
    """A stream of (line, path, modified) of files that land in a folder. Rotated chunks are new files; a file counts once.

    With ``since``, a moment, it starts at the end as of then: lines of files that were complete by that time are passed over.
    """
    stream = spark.readStream.format("text").option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).load(path)
    rows = stream.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    return rows if since is None else rows.filter(F.col("modified") > F.lit(since).cast("timestamp"))


def _journal_schema(matches: dict[str, list[str]]) -> str:
    return ", ".join(f"`{f}` string" for f in sorted({"MESSAGE", "__REALTIME_TIMESTAMP", *matches}))


def read_journal(spark: SparkSession, path: str, matches: dict[str, list[str]]) -> DataFrame:
    """Lines of a journal's JSON export: the same field matches any of its values, different fields all match."""
    return journal_lines(spark.read.schema(_journal_schema(matches)).json(path), matches)


def follow_journal(spark: SparkSession, path: str, matches: dict[str, list[str]], files_per_trigger: int = 100) -> DataFrame:
    """The same of export files that land in a folder, as a stream."""
    return journal_lines(spark.readStream.schema(_journal_schema(matches)).option("maxFilesPerTrigger", files_per_trigger).json(path), matches)


def write_log(lines: DataFrame, path: str) -> None:
    """Text files with a line for each row (line)."""
    lines.select("line").write.option("lineSep", "\n").text(path)


def write_journal(entries: DataFrame, path: str) -> None:
    """A journal's JSON export: one object a line, fields as texts."""
    entries.select(*[F.col(c).cast("string").alias(c) for c in entries.columns]).write.json(path)


def journal_lines(entries: DataFrame, matches: dict[str, list[str]]) -> DataFrame:
    for field, values in matches.items():
        entries = entries.filter(F.col(field).isin(values))
    return entries.withColumnRenamed("MESSAGE", "line").filter(F.trim("line") != "")


def read_bans(spark: SparkSession, path: str, now: int) -> tuple[DataFrame, DataFrame]:
    """Durable ban state as (live, expired)."""
    return split_bans(spark.read.parquet(path), now)


def split_bans(bans: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    expired = F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)
    return bans.filter(~expired), bans.filter(expired)
