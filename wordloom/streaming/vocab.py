"""Word counts of a stream of texts, kept up to date.

Each micro-batch appends the counts that it changed, from Spark's keyed state, and a mark when they are all
there; the counts are the largest of each word over the base and the marked changes since. compact() makes a new
base. A batch that is run again writes the same rows to its own place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from wordloom.functions.text import words

SCHEMA = "word string, n long"


class Counts:
    """folder: changes/NNNNNNNNN and base/NNNNNNNNN, tables by batch, each with a file of its name under done."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.paths = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.paths(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _write(self, counts: DataFrame, kind: str, batch: int) -> None:
        counts.select("word", F.col("n").cast("long").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/{kind}/{batch:09d}")
        self.fs.create(self.paths(f"{self.folder}/done/{kind}-{batch:09d}"), True).close()

    def done(self, kind: str) -> list[int]:
        """Batches whose table of this kind is whole."""
        at = self.paths(f"{self.folder}/done")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n.split("-")[1]) for n in names if n.startswith(f"{kind}-"))

    def add(self, changed: DataFrame, batch: int) -> None:
        self._write(changed, "changes", batch)

    def latest(self) -> DataFrame:
        """word, n after the last whole batch."""
        base = self.done("base")[-1:]
        paths = [f"{self.folder}/base/{k:09d}" for k in base] + [f"{self.folder}/changes/{k:09d}" for k in self.done("changes") if not base or k > base[0]]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths).groupBy("word").agg(F.max("n").alias("n"))

    def compact(self) -> None:
        """Writes latest() as the base of the last whole batch. What the base before was made from goes; what this one was made from stays for those who read it now."""
        batches, bases = self.done("changes"), self.done("base")
        if not batches or batches[-1:] == bases[-1:]:
            return
        self._write(self.latest(), "base", batches[-1])
        for kind, old in [("base", k) for k in bases[:-1]] + [("changes", k) for k in batches if bases and k <= bases[-1]]:
            self.fs.delete(self.paths(f"{self.folder}/done/{kind}-{old:09d}"), False)
            self.fs.delete(self.paths(f"{self.folder}/{kind}/{old:09d}"), True)


def counted(stream: DataFrame, text_col: str = "text") -> DataFrame:
    return words(stream, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def count_to_table(stream: DataFrame, folder: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """Runs over what is there and stops; started again with the same folders, it goes on with what is new."""
    kept = Counts(stream.sparkSession, folder)
    return counted(stream, text_col).writeStream.outputMode("update").foreachBatch(kept.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """word, n of what count_to_table has counted into the folder."""
    return Counts(spark, folder).latest()
