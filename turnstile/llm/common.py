"""What the operators share: words, scratch tables, and keys for rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, in order; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def scratch(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors.

    The table goes when ``removed`` is called, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spot, files = _place(spark, path)
    files.deleteOnExit(spot)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        spot, files = _place(df.sparkSession, df._stored_at)
        files.delete(spot, True)


def _place(spark: SparkSession, path: str) -> tuple:
    spot = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spot, spot.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one value, so that their names meet no others."""
    return F.struct(*[df[_quoted(c)].alias(c) for c in df.columns])


def unpacked(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """The columns that ``whole_row`` packed."""
    return df.select(*[F.col(row)[c].alias(c) for c in columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
