"""Ranked lexical search: term-bucketed postings, integer scores, sums by item and document, top k by a window.

1. each document's terms are counted in its task; the postings (bucket, term, row, doc_id, n, tf) are dealt by bucket of the
   term and by a part of the document, so that a term that half the documents hold fills many tasks, and written once;
2. the items' terms are joined to the postings. A match's score depends on term and document alone, so it is taken
   before the items come in: what is shuffled is one row for a term of a document, however many items ask for it;
3. matches are dealt by document, joined to the items that hold their terms, and summed for each item and document where
   they are; only the best k of each task meet in the last window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, small_arrow_batches

TOP = 10
#: Buckets of terms, and parts of documents within each.
BUCKETS, PARTS = 16, 4
#: Rows of items' terms that may be broadcast (some 60 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes that end a term in UTF-8 (all of a longer code point's bytes are over 127), as blanks; A-Z as a-z.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8: runs of ASCII letters, digits and code points over 127; only A-Z lower-cased."""
    return text.encode().translate(_TERM_BYTES).split(b" ") if text else []


def _counted(df: DataFrame, id_: str, name: str, only: Broadcast[frozenset[bytes]] | None = None) -> DataFrame:
    """A row for each row and term: row (its number), the id, n (terms of the row), term and tf; term is null in one row for each row.

    Of the terms those in ``only`` come out, if it is given; n counts all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, lengths, words, times = [], [], [], [], []
            for row, key, text in zip(batch.column("row").to_pylist(), batch.column(name).to_pylist(), batch.column("text"), strict=True):
                counts = Counter(terms(text.as_py()))
                counts.pop(b"", None)
                total = counts.total()
                if only is not None:
                    counts = {term: counts[term] for term in counts.keys() & only.value}
                size = len(counts) + 1
                rows += [row] * size
                ids += [key] * size
                lengths += [total] * size
                words += [None, *counts]
                times += [0, *counts.values()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["row", name, "n", "term", "tf"])

    own = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_).cast("long").alias(name), "text")
    return own.mapInArrow(run, f"row long, {name} long, n long, term string, tf long")


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, scratch: Scratch, only: Broadcast[frozenset[bytes]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(index, sizes): postings (bucket, term, row, doc_id, n, tf) by bucket, and a row (row, n) for each document.

    ``only``, of a counted size, leaves out terms that no question asks for. A reader that filters on bucket reads its files alone.
    """
    dealt = _counted(docs, "doc_id", "doc_id", only).withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(bucket_of(F.col("term")))).repartition("bucket", F.pmod(F.xxhash64("row"), F.lit(PARTS)))
    path = scratch.path("postings")
    dealt.write.partitionBy("bucket").parquet(path)
    index = docs.sparkSession.read.schema(dealt.schema).parquet(path)
    return index.where("bucket >= 0"), index.where("bucket < 0").select("row", "n")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents (doc_id, text) of each item (item_id, text).

    Rows with one item_id, or without any, are one item that holds the terms of all of them once each; every row of ``docs``
    is a document of its own. Scores above 0 alone; equal scores by ascending doc_id, a null id last, then by row. Null and empty
    texts have no term. All arithmetic but a term's weight is on 64-bit integers, which overflow (an error) where a document's or
    all documents' terms times 90 and the number of documents pass 2^63.
    """
    small_arrow_batches(spark)
    scratch = Scratch(spark, "lexical")
    asked = scratch.keep(_counted(items, "item_id", "item_id").where(F.col("term").isNotNull()).select("item_id", "term").distinct(), "asked")
    vocabulary = scratch.keep(asked.select("term").distinct(), "vocabulary")
    small = asked.count() <= broadcast_rows
    only = spark.sparkContext.broadcast(frozenset(r["term"].encode() for r in vocabulary.collect())) if small else None
    index, sizes = postings(docs, scratch, only)

    total = sizes.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = F.lit(total["docs"]).cast("long"), F.lit(max(1, total["terms"])).cast("long")
    held = index if small else index.join(vocabulary, "term", "left_semi")
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = scratch.keep(held.groupBy("term").agg(F.count("*").alias("df")).select("term", bucket_of(F.col("term")).alias("bucket"), weight.alias("w")).where(F.col("w") > 0), "weights")

    div = lambda a, b: F.call_function("div", a, b)
    m = F.lit(10).cast("long") + div(90 * F.col("n") * n_docs, n_terms)
    scored = held.join(F.broadcast(weighted) if small else weighted, ["bucket", "term"])
    scored = scored.select("row", "doc_id", "term", (F.col("w") * div(1_000_000_000 * F.col("tf"), 1000 * F.col("tf") + 8 * m)).alias("s"))
    if small:
        summed = scored.repartition("row").join(F.broadcast(asked), "term").groupBy("item_id", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("s").alias("score"))
    else:
        summed = scored.join(asked, "term").groupBy("item_id", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("s").alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    best = summed.where(F.col("score") > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    best = scratch.keep(best.select("item_id", "rank", "doc_id", "score"), "best")
    scratch.drop(*(set(scratch.names()) - {"best"}))
    return best


def oracle(top: int = TOP) -> str:
    """DuckDB SQL for the query's rows."""
    find = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH counted AS (
    SELECT doc_id, len(found) AS n, found FROM (SELECT doc_id, {find} AS found FROM documents)
), totals AS (
    SELECT count(*) FILTER (WHERE n > 0) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM counted
), tf AS (
    SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(found) AS term FROM counted) GROUP BY doc_id, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term
), asked AS (
    SELECT DISTINCT item_id, unnest({find}) AS term FROM benchmark
), summed AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN tf USING (term), totals GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM summed WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {top}
"""
