"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from vidtables.sources.shared import shared_path

#: What is shuffled for a table isn't read again, so its files go when the table is written; and Arrow
#: batches are small, because executors hold several of them at once beside what a task makes of them.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session with these settings, as far as this Spark has them; put back afterwards."""
    held = {}
    for key, value in wanted.items():
        try:
            held[key] = spark.conf.get(key)
        except PySparkException:  # an older Spark
            continue
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


class Scratch:
    """Parquet tables of one run. A table goes when its successor is written, or stays for the result."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = shared_path(spark, name)
        self.n = 0

    def save(self, df: DataFrame, rows_a_file: int = 0, reading: str | None = None) -> DataFrame:
        """Writes df and reads it back, so that its lineage ends here. rows_a_file: the most rows of a file (0: any);
        reading: the most bytes of files that a task reads for it, where Spark's own setting is more than it can hold."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with settings(self.spark, WHILE_WRITING | ({"spark.sql.files.maxPartitionBytes": reading} if reading else {})):
            df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_slices(self, slices: list[DataFrame]) -> DataFrame:
        """Writes tables of one schema one after another as one, so that what only one of them shuffles lies on disk at a time."""
        out = self.save(slices[0])
        with settings(self.spark, WHILE_WRITING):
            for df in slices[1:]:
                df.write.mode("append").parquet(out._scratch_path)
        path, out = out._scratch_path, self.spark.read.schema(out.schema).parquet(out._scratch_path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that save() made and that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
