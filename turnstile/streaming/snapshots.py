"""Live views of a stream's changes: a base of the newest row of each (ip, jail), and the batches since.

A batch is written as a delta, so it costs what it holds. Every ``every`` batches the deltas are folded into a new base, and what is older
is deleted. Folders are named by batch, so a batch that is run again after a failure writes the same folder again; readers take the newest
base that is whole (with a _SUCCESS file) and the deltas behind it. The batch of a base is the last one that it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _newest(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("ip", "jail")]
    # Of two changes at one moment the later number counts; an expiry has none and comes ahead of what then happens.
    newest = F.max_by(F.struct(*rest), F.struct("banned_at", F.coalesce("seq", F.lit(-1).cast("long"))))
    return rows.groupBy("ip", "jail").agg(newest.alias("r")).select("ip", "jail", "r.*").select(*rows.columns)


class Snapshots:
    """A folder of bases and deltas of rows (kind, ip, jail, banned_at, seq, ...)."""

    def __init__(self, spark: SparkSession, folder: str, every: int = 10):
        self.spark, self.folder, self.every = spark, folder.rstrip("/"), every

    def _place(self, name: str = "") -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _held(self) -> tuple[int | None, list[int]]:
        """The batch of the newest base, and the batches of deltas behind it."""
        files, path = self._place()
        if not files.exists(path):
            return None, []
        whole = [s.getPath().getName() for s in files.listStatus(path) if files.exists(self._place(f"{s.getPath().getName()}/_SUCCESS")[1])]
        batches = lambda kind: sorted(int(n.split("-")[1]) for n in whole if n.startswith(f"{kind}-"))
        base = max(batches("base"), default=None)
        return base, [b for b in batches("delta") if base is None or b > base]

    def _read(self, base: int | None, deltas: list[int], schema) -> DataFrame | None:
        paths = [f"{self.folder}/base-{base}"] * (base is not None) + [f"{self.folder}/delta-{b}" for b in deltas]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def writer(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""

        def write(batch: DataFrame, epoch: int) -> None:
            base, _ = self._held()
            if base is not None and epoch <= base:
                return  # a base holds it already
            _newest(batch.filter("kind IN ('ban', 'unban')")).write.mode("overwrite").parquet(f"{self.folder}/delta-{epoch}")
            if (epoch + 1) % self.every == 0:
                self.compact(epoch, batch.schema)

        return write

    def compact(self, epoch: int, schema) -> None:
        base, deltas = self._held()
        rows = self._read(base, [b for b in deltas if b <= epoch], schema)
        _newest(rows).write.mode("overwrite").parquet(f"{self.folder}/base-{epoch}")
        gone = [f"delta-{b}" for b in deltas if b <= epoch] + ([f"base-{base}"] if base is not None and base < epoch else [])
        for name in gone:
            files, path = self._place(name)
            files.delete(path, True)

    def current(self, schema) -> DataFrame:
        """The newest row of each (ip, jail)."""
        rows = self._read(*self._held(), schema)
        return self.spark.createDataFrame([], schema) if rows is None else _newest(rows)
