"""Chunks of logs that land again, under other names, or grown: each line is taken once.

A stream follows the names of files that land; each batch reads its files' lines, numbers them, and holds them against a ledger. A chunk is
known by its first line (head) and, as others may begin alike, by a mark of its first n lines: the exclusive or of a hash of
each line with its number. If the ledger has a chunk with that head whose n lines are the first n of this one, this one is a copy of it or
has grown, and only lines from n on are new; the longest such chunk counts. Anything else, also a file that is shorter than all that begin
alike, is a new one and taken from its start, as a log is after rotation.

Lines are numbered by their place in a split and the lines of the splits ahead of it, so no task reads a whole file. Of each chunk the
ledger has one row. A batch writes its lines and its ledger rows to folders of its own number, so one that is run again after a failure
writes the same; it does not see its own rows. Chunks are compared with those of the same head only, as many as there are: heads should tell
chunks apart, as a line with a time does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstile.sources.tables import written

LEDGER = "head long, n long, mark long"
LINES = "line string, path string, number long"


def numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """line, path, number (from 0) of the files' lines."""
    rows = spark.read.option("lineSep", "\n").text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    rows = written(rows, "chunk-lines")  # one reading, as places are those of one
    splits = rows.groupBy("path", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("path").orderBy("_split")) - F.col("_n")  # a row for each split of a file
    splits = splits.select("path", "_split", "_first", ahead.alias("_ahead"))
    return rows.join(splits, ["path", "_split"]).select("line", "path", (F.col("_ahead") + F.col("_at") - F.col("_first")).alias("number"))


def _mark() -> Column:
    return F.bit_xor(F.xxhash64("number", "line"))


def unseen(lines: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines that no chunk of the ledger and no other chunk of these has, and the ledger's rows for these chunks."""
    lines = written(lines, "chunk-numbered")
    whole = lines.groupBy("path").agg(F.max(F.when(F.col("number") == 0, F.xxhash64("line"))).alias("head"), F.count(F.lit(1)).alias("n"), _mark().alias("mark"))
    whole = written(whole, "chunk-marks")
    own = whole.select(F.col("path").alias("_path"), "head", F.col("n").alias("_n"))
    # Of two equal chunks of a batch the one with the lesser name comes first; none comes ahead of itself.
    known = ledger.select("head", "n", "mark", F.lit("").alias("path")).unionByName(whole.select("head", "n", "mark", "path"))
    tries = own.join(known, "head").filter((F.col("n") < F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("path") < F.col("_path"))))
    tries = written(tries.select(F.col("_path").alias("path"), "n", "mark").distinct(), "chunk-tries")
    # The mark of each length that is tried: lines up to it, from the lengths before it on.
    lengths = tries.groupBy("path").agg(F.array_sort(F.collect_set("n")).alias("_lengths"))
    upto = F.get("_lengths", F.size(F.filter("_lengths", lambda n: n <= F.col("number"))))
    parts = lines.join(lengths, "path").select("path", upto.alias("n"), "number", "line").filter("n IS NOT NULL")
    parts = parts.groupBy("path", "n").agg(_mark().alias("_mark"))
    marks = parts.withColumn("_mark", F.bit_xor("_mark").over(Window.partitionBy("path").orderBy("n")))  # a row for each length tried
    same = marks.withColumnRenamed("_mark", "mark").join(tries, ["path", "n", "mark"], "left_semi")
    taken = same.groupBy("path").agg(F.max("n").alias("_taken"))
    new = lines.join(taken, "path", "left").filter(F.col("number") >= F.coalesce("_taken", F.lit(0))).select("line", "path", "number")
    return new, whole.select("head", "n", "mark").distinct()


def follow_chunks(spark: SparkSession, glob: str, base: str, files_per_batch: int = 100) -> DataFrame:
    """Takes up all chunks that have landed since the last call; the lines of all batches so far (line, path, number)."""
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(glob).select("path")

    def take(batch: DataFrame, epoch: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # as many as files_per_batch
        if not paths:
            return
        held = spark.read.schema(f"{LEDGER}, epoch long").parquet(f"{base}/ledger").filter(F.col("epoch") < epoch) if epoch else spark.createDataFrame([], LEDGER)
        new, rows = unseen(numbered(spark, paths), held.select("head", "n", "mark"))
        new.write.mode("overwrite").parquet(f"{base}/lines/epoch={epoch}")
        rows.write.mode("overwrite").parquet(f"{base}/ledger/epoch={epoch}")

    q = names.writeStream.foreachBatch(take).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(LINES).parquet(f"{base}/lines/*")
