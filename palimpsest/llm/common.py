"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words: everything that is neither letter nor digit.
WORD_SEPARATOR = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a new local one where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return context.getCheckpointDir()


class Scratch:
    """Intermediate tables in the shared folder, so that losing an executor loses none of them. What is left of them goes when the driver ends.

    ``keep`` writes a frame as Parquet and reads it back, which cuts its lineage; ``drop`` removes tables that nothing
    reads any more, by their names, or everything this object wrote. What a lazy result still reads stays until its caller
    drops it: ``collected`` gives the objects made within it.
    """

    _watchers: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/palimpsest-{label}-{uuid.uuid4().hex}"
        self.paths: list[tuple[str, str]] = []
        place = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(place)
        self.files.deleteOnExit(place)
        for made in Scratch._watchers:
            made.append(self)

    def path(self, name: str) -> str:
        path = f"{self.root}/{len(self.paths) + 1:03d}-{name}"
        self.paths.append((name, path))
        return path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def names(self) -> list[str]:
        return [name for name, _ in self.paths]

    def drop(self, *names: str) -> None:
        for path in [path for name, path in self.paths if name in names] if names else [self.root]:
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def outlast(self) -> None:
        """Leave the tables where they are when the driver ends."""
        self.files.cancelDeleteOnExit(self.spark._jvm.org.apache.hadoop.fs.Path(self.root))

    @staticmethod
    @contextlib.contextmanager
    def collected() -> Iterator[list[Scratch]]:
        """The objects that are made while it is open, for their tables to be dropped once the results are written."""
        made: list[Scratch] = []
        Scratch._watchers.append(made)
        try:
            yield made
        finally:
            Scratch._watchers.remove(made)


def small_arrow_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows of an Arrow batch, so that a run of long texts stays small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def id_text_crc(doc_id: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def spread(col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the value and the seed alone."""
    return F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def words(text: Column) -> Column:
    """Lower-case words of a text as an array; none for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_SEPARATOR)
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


#: A key that holds at least one row in so many is joined by broadcast; there can be no more such keys than this.
SHARES = 1000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """Inner join to a table of unique keys, whose column ``rows`` says how many rows of ``left`` hold each key.

    Keys with at least total / SHARES rows are at most SHARES in number, whatever the input, so they are broadcast and
    never meet in one task; of the others no key is heavy, and they are shuffled. ``total`` is the sum of ``rows``;
    ``left`` is read twice. Nulls in a key match nothing.
    """
    least = F.lit(max(2.0, total / SHARES))
    heavy = left.join(F.broadcast(right.where(F.col(rows) >= least)), on)
    light = left.join(right.where(F.col(rows) < least).hint("merge"), on)
    return heavy.unionByName(light)
