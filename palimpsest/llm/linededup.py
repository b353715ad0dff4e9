"""Line deduplication over levelled sorted runs of line hashes.

Documents arrive in batches. A run holds the lines that were new when it was made, each with the number of its documents
and the largest of them, dealt into buckets of the hash and sorted within each. A batch is dealt and sorted
once; then it is merge-anti-joined with the runs, bucket by bucket, and no run is exchanged or sorted again: what no
run holds becomes a run of level 0, what some run holds goes to the hits. When a level has ``fanout`` runs they are
compacted into one run of the next level, so that a batch meets few runs, however many came before. The counts of runs and hits
give the lines that too many documents hold, and those lines stay only in the largest document.

Runs outlast the call: ``LineRuns.save`` notes where they lie, ``LineRuns.load`` takes them up again, in another session
too, and ``dedup_lines`` continues from them.
"""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, join_counted, let

#: What is stripped from a line, and the letters that are lower-cased.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]
#: A document: its id, or for rows without one a hash of the text; those are smaller than all others.
DOC = ["owned", "doc"]
RUN = "h1 long, h2 long, n_docs long, keeper struct<owned:boolean,doc:long>"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A to Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hash(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def _long_keys(text: Column, min_chars: int) -> Column:
    """Distinct keys of a text's lines that have at least ``min_chars`` code points."""
    enough = F.filter(F.transform(_lines(text), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: F.length(x) >= min_chars)
    return F.array_distinct(F.transform(enough, lambda x: F.translate(x, UPPER, LOWER)))


@contextlib.contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Let scans of buckets of one file tell that they are sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levels of runs with columns h1, h2, n_docs, keeper, and the hits, as bucketed and sorted tables."""

    def __init__(self, scratch: Scratch, fanout: int = 2, buckets: int | None = None):
        self.scratch, self.spark, self.fanout = scratch, scratch.spark, fanout
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.hits: list[str] = []
        self.tables: dict[str, DataFrame] = {}
        self.names: list[str] = []

    def _open(self, path: str) -> DataFrame:
        """The table at a path; its buckets are known from the catalog, where it has a name of its own."""
        if path not in self.tables:
            name = f"palimpsest_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.names.append(name)
            self.tables[path] = self.spark.table(name)
        return self.tables[path]

    def _write(self, df: DataFrame, name: str) -> str:
        """A table of ``df``, which is dealt by the hash into as many partitions as there are buckets, and sorted."""
        path, table = self.scratch.path(name), f"palimpsest_run_{uuid.uuid4().hex}"
        with _sorted_buckets(self.spark):
            df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).format("parquet").saveAsTable(table)
        self.names.append(table)
        self.tables[path] = self.spark.table(table)
        return path

    def close(self) -> None:
        """Take the runs' names out of the catalog; their files stay, and get other names when they are read again."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names, self.tables = [], {}

    def runs(self) -> list[DataFrame]:
        return [self._open(path) for level in self.levels for path in level]

    def add(self, entries: DataFrame) -> None:
        """A batch of distinct (owned, doc, h1, h2): its new lines become a run, the others hits."""
        counted = entries.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max(F.struct(*DOC)).alias("keeper"))
        counted = counted.repartition(self.buckets, *HASH).select(*HASH, "n_docs", "keeper")
        known = self.runs()
        if not known:
            self._place(self._write(counted, "run-0"), 0)
            return
        batch = self._open(self._write(counted, "batch"))
        some = functools.reduce(lambda left, run: left.join(run.select(*HASH).hint("merge"), HASH, "left_anti"), known, batch)
        new = self._write(some, "run-0")
        # A line is in one run at most, so what is not new is in just one of these.
        self.hits.append(self._write(batch.join(self._open(new).select(*HASH).hint("merge"), HASH, "left_anti"), "hits"))
        self.scratch.drop("batch")
        self._place(new, 0)

    def _place(self, run: str, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        """Runs share no line, so a full join of sorted buckets merges them."""

        def merge(left: DataFrame, right: DataFrame) -> DataFrame:
            both = left.join(right.withColumnsRenamed({"n_docs": "n", "keeper": "k"}).hint("merge"), HASH, "full")
            return both.select(*HASH, F.coalesce("n_docs", "n").alias("n_docs"), F.coalesce("keeper", "k").alias("keeper"))

        merged = functools.reduce(merge, [self._open(path) for path in self.levels[level]])
        self.levels[level] = []
        self._place(self._write(merged, f"run-{level + 1}"), level + 1)

    def frequent(self, min_docs: int) -> DataFrame:
        """h1, h2, n_docs, keeper of the lines in at least ``min_docs`` documents."""
        if not self.runs():
            return self.spark.createDataFrame([], RUN)
        sums = (F.sum("n").alias("n"), F.max("k").alias("k"))
        again = [self._open(path).select(*HASH, F.col("n_docs").alias("n"), F.col("keeper").alias("k")) for path in self.hits]
        again = functools.reduce(DataFrame.union, again).groupBy(*HASH).agg(*sums) if again else None
        parts = []
        for run in self.runs():
            if again is not None:
                both = run.join(again.hint("merge"), HASH, "left")
                run = both.select(*HASH, (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("keeper", F.coalesce("k", "keeper")).alias("keeper"))
            parts.append(run.where(F.col("n_docs") >= min_docs))
        return functools.reduce(DataFrame.union, parts)

    def save(self, path: str) -> None:
        """Note at ``path`` where the runs and hits lie, for ``load``."""
        rows = [("run", i, p) for i, level in enumerate(self.levels) for p in level] + [("hits", -1, p) for p in self.hits]
        note = self.spark.createDataFrame([(i, *row, self.fanout, self.buckets) for i, row in enumerate(rows)], "i int, kind string, level int, path string, fanout int, buckets int")
        note.coalesce(1).write.mode("overwrite").parquet(path)
        self.scratch.outlast()

    @classmethod
    def load(cls, scratch: Scratch, path: str) -> LineRuns:
        """The runs noted at ``path``; new ones are written by ``scratch``."""
        rows = scratch.spark.read.parquet(path).orderBy("i").collect()  # as many as there are runs
        runs = cls(scratch, rows[0]["fanout"], rows[0]["buckets"])
        runs.levels = [[] for _ in range(max(r["level"] for r in rows) + 1)]
        for r in rows:
            (runs.hits if r["kind"] == "hits" else runs.levels[r["level"]]).append(r["path"])
        return runs


def _doc(docs: DataFrame) -> list[Column]:
    id_ = F.col("doc_id").cast("long")
    return [id_.isNotNull().alias("owned"), F.coalesce(id_, F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).alias("doc")]


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, runs: LineRuns | None = None) -> DataFrame:
    """``docs`` with the lines dropped that other documents repeat: columns of docs, then __lines and __dropped.

    A line whose key (see ``line_key``) has at least ``min_chars`` code points and is held by at least ``min_docs`` documents
    stays only in the largest doc_id holding it, there in all its places; other lines stay. Rows that share a doc_id
    are one document. Rows without one are a document for each different text, smaller than every doc_id, in the order of a hash. A null text is one empty line
    and stays null; a document all of whose lines go has an empty text. Rows stay as many as they are. ``docs`` is
    fed to the runs in ``batches`` parts; ``runs`` may hold earlier documents, which count and may hold a line's place.
    """
    scratch = Scratch(spark, "lines")
    # Outer: else Spark would compute all keys twice, first for a filter below.
    exploded = docs.select(*_doc(docs), F.explode_outer(_long_keys(F.col("text"), min_chars)).alias("key")).where("key IS NOT NULL").select(*DOC, *_hash(F.col("key")))
    entries = exploded.distinct().withColumn("batch", F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(batches)).cast("int"))
    path = scratch.path("entries")
    entries.write.partitionBy("batch").parquet(path)
    entries = spark.read.schema(entries.schema).parquet(path)

    given, runs = runs, runs or LineRuns(scratch, fanout)
    for i in range(batches):
        runs.add(entries.where(F.col("batch") == i).select(*DOC, *HASH))
    with _sorted_buckets(spark):
        frequent = scratch.keep(runs.frequent(min_docs), "frequent")
    runs.close()
    if given is None:  # no more batches
        scratch.drop(*{name for name in scratch.names() if name not in ("entries", "frequent")})
    total = frequent.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first()["n"]

    held = join_counted(entries.select(*DOC, *HASH), frequent, HASH, "n_docs", total)
    gone = held.where(F.struct(*DOC) != F.col("keeper")).groupBy(*DOC).agg(F.collect_list(F.struct(*HASH)).alias("gone"))
    own = docs.select(F.struct(*docs.columns).alias("row"), *_doc(docs))  # no name of docs can clash
    joined = own.join(gone, DOC, "left")

    # As many parts as the root of their number, so that a line meets few hashes, however many lines go.
    n_parts = F.ceil(F.sqrt(F.size("gone"))).cast("int")
    part_of = lambda h1: F.pmod(h1, n_parts.cast("long")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n_parts - 1), lambda b: F.filter("gone", lambda x: part_of(x["h1"]) == b))

    def stays(line: Column, parts: Column) -> Column:
        short = F.length(F.btrim(line, F.lit(BLANK))) < min_chars
        return short | let(F.struct(*_hash(line_key(line))), lambda h: ~F.array_contains(F.get(parts, part_of(h["h1"])), h))

    lines = _lines(F.col("row.text"))
    kept = F.when(F.col("gone").isNull(), lines).otherwise(let(parts, lambda p: F.filter(lines, lambda x: stays(x, p))))
    done = joined.select("row", F.size(lines).cast("long").alias("n"), F.explode(F.array(kept)).alias("kept")).withColumn("dropped", F.col("n") - F.size("kept"))
    text = F.when(F.col("dropped") == 0, F.col("row.text")).otherwise(F.array_join("kept", "\n")).alias("text")
    others = [F.col("row")[c].alias(c) if c != "text" else text for c in docs.columns]
    return done.select(*others, F.col("n").alias("__lines"), F.col("dropped").alias("__dropped"))
