"""Tables that a stream writes batch by batch: what was there before a batch is told from what it adds.

Each table is a log: a folder for each batch. A batch reads what earlier ones wrote, writes its own folders, and is
committed last. If it is cut off, it runs again, reads the same, and overwrites its own folders; what is not committed
is not read. ``fold`` and ``rebase`` rewrite a log as one folder, so that a long stream does not read
many small ones. A stream's folder and its checkpoint belong together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources import files


@dataclass(frozen=True)
class Logs:
    spark: SparkSession
    folder: str

    def numbers(self, name: str, kind: str = "batch") -> list[int]:
        return sorted(int(x.split("=")[1]) for x in files.listed(self.spark, f"{self.folder}/{name}") if x.startswith(f"{kind}="))

    def committed(self) -> int:
        """The last whole batch; -1 before the first."""
        return max(map(int, files.listed(self.spark, f"{self.folder}/commits")), default=-1)

    def base(self, name: str) -> int:
        """The batch up to which a log was rewritten as one; -1 if it was not."""
        return max((n for n in self.numbers(name, "base") if files.exists(self.spark, f"{self.folder}/{name}/base={n}/_SUCCESS")), default=-1)

    def put(self, name: str, df: DataFrame, no: int) -> DataFrame:
        """Write a batch's rows; as they are read again."""
        path = f"{self.folder}/{name}/batch={no}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, schema, before: int | None = None) -> DataFrame:
        """The rows of all batches before one; without ``before`` of all that are committed."""
        last = self.committed() if before is None else before - 1
        base = self.base(name)
        paths = [f"{self.folder}/{name}/base={base}"] if base >= 0 else []
        paths += [f"{self.folder}/{name}/batch={n}" for n in self.numbers(name) if base < n <= last]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, no: int) -> None:
        files.put_text(self.spark, f"{self.folder}/commits/{no}", "")

    def rebase(self, name: str, rows: DataFrame) -> None:
        """Replace all committed rows of a log by ``rows``."""
        last = self.committed()
        if last <= self.base(name):
            return
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/base={last}")
        for kind in ("batch", "base"):
            for n in self.numbers(name, kind):
                if n < last + (kind == "batch"):
                    files.remove(self.spark, f"{self.folder}/{name}/{kind}={n}")

    def fold(self, name: str, schema, value: str) -> None:
        """Add up a log of changes in the column ``value``; the other columns are its keys."""
        rows = self.read(name, schema)
        whole = rows.groupBy(*[c for c in rows.columns if c != value]).agg(F.sum(value).cast(rows.schema[value].dataType).alias(value)).where(F.col(value) != 0)
        self.rebase(name, whole.select(*rows.columns))


def drive(stream: DataFrame, folder: str, checkpoint: str, step: Callable[[DataFrame, int, Logs], None]) -> None:
    """Run ``step(batch, no, logs)`` for each batch of what is there, but for those that are committed already."""

    def once(batch: DataFrame, no: int) -> None:
        logs = Logs(batch.sparkSession, folder)
        if no > logs.committed():
            step(batch, no, logs)

    query = stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
