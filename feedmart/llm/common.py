"""Helpers shared by the training-data operators.

Every operator selects the columns it needs under internal names before it
joins, so extra columns of the caller, clashing names included, never reach a
join or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut as _cut
from ..plans.lineage import shared_folder

#: Characters that end a word of ``words_of``: blanks and ASCII control blanks.
BLANKS = r"\x20\x09-\x0D"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, _UPPER, _LOWER)


def filled(text: str | Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of non-blanks."""
    return F.regexp_count(text, F.lit(f"[^{BLANKS}]+")).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and reads them back.

    The folder is the session's ``spark.checkpoint.dir``; a temporary one
    stands in on one machine only, and on a cluster an unset one is an error.
    The files survive the loss of executors.
    """
    return _cut(df)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of frames that are gone, on all executors.

    Spark deletes them once the driver's collector has found their frames
    unreachable, which may be half an hour later; a step that shuffles much
    after others asks for it, so that what is held at once is its own.
    """
    spark._jvm.System.gc()


class Tables:
    """Tables of a loop in the shared folder, each dropped as soon as no later one needs it.

    A checkpointed table keeps the size that the optimizer guessed for it. Over
    the rounds of a loop with joins the guesses multiply to numbers of so many
    digits that planning takes minutes; a written table has its true size.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, shared_folder(spark, name), 0
        self.paths: dict[DataFrame, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[out] = path
        return out

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(self.paths.pop(t))

    def close(self, result: DataFrame) -> DataFrame:
        """The result, cut, and all tables gone."""
        out = cut(result)
        self._delete(self.folder)
        return out
