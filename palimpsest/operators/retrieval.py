"""Retrieval of what is visible at query time: BM25 over postings, and dense inner products."""

from __future__ import annotations

import bisect
import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import Retrieval
from palimpsest.functions.text import tie_key
from palimpsest.operators.ranking import order_by_score, top_k
from palimpsest.session import kept
from palimpsest.sources.files import KeyedCache


def _idf(df: DataFrame, n_docs: int, epsilon: float) -> DataFrame:
    """(term, df, idf): ln(N - df + .5) - ln(df + .5); a negative one becomes epsilon times the mean of all."""
    raw = df.withColumn("raw", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


#: Rows (query, term) that may be broadcast; more are joined over a shuffle by term.
ASKED_ROWS = 2_000_000


@dataclass
class Index:
    """Postings (evidence_id, observed, dl, term, tf; a row without a term for a document without any), weights of the terms, number and mean length of documents.

    Frequencies and lengths are those of the whole corpus, also of documents that are not visible yet.
    """

    postings: DataFrame
    weights: DataFrame
    documents: int
    mean: float

    def save(self, path: str) -> None:
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        spark = self.postings.sparkSession
        spark.createDataFrame([(self.documents, self.mean)], "documents long, mean double").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        totals = spark.read.parquet(f"{path}/totals").first()
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/weights"), totals["documents"], totals["mean"])


def index(docs: DataFrame, tokens: Column, id_: str = "evidence_id", observed: str = "observed_from", cfg: Retrieval = Retrieval()) -> Index:
    """The index of a corpus; its texts are cut into tokens once."""
    each = docs.repartition(id_).select(F.col(id_).alias("evidence_id"), F.col(observed).alias("observed"), tokens.alias("t"))
    each = each.select("evidence_id", "observed", F.size("t").alias("dl"), F.explode_outer("t").alias("term"))
    posted = kept(each.groupBy("evidence_id", "observed", "dl", "term").agg(F.count("*").alias("tf")), partitioned=True)
    words = posted.where(F.col("term").isNotNull())
    n = docs.count()
    total = words.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n")).first()["n"]
    weights = _idf(words.groupBy("term").agg(F.count("*").alias("df")), n, cfg.epsilon)
    return Index(posted, weights, n, total / n if n else 0.0)


def bm25(docs: DataFrame | Index, queries: DataFrame, doc_tokens: Column | None, query_tokens: Column, id_: str = "evidence_id", observed: str = "observed_from", at: str = "query_time", cfg: Retrieval = Retrieval(), k: int | None = None) -> DataFrame:
    """(query_id, evidence_id, score, rank): top k of the documents visible at each query; ``docs`` may be an index.

    A query term counts as often as it is asked. Where fewer than k visible documents have a score, others fill up with score 0.

    Postings are dealt by document and meet the broadcast terms of all queries, so a document's scores are summed where it lies,
    and only each task's best k of a query are shuffled. Too many terms for a broadcast are joined by term instead.
    """
    k = k or cfg.top_k
    found = docs if isinstance(docs, Index) else index(docs, doc_tokens, id_, observed, cfg)
    asked = queries.select("query_id", at, F.explode_outer(query_tokens).alias("term")).groupBy("query_id", at, "term").agg(F.count("*").alias("times"))
    asked = asked.join(found.weights, "term").select("query_id", at, "term", (F.col("times") * F.col("idf")).alias("w"))
    small = queries.select(F.coalesce(F.sum(F.size(query_tokens)), F.lit(0)).alias("n")).first()["n"] <= ASKED_ROWS
    part = F.col("tf") * (cfg.k1 + 1) / (F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("dl") / F.lit(found.mean or 1.0)))
    part = found.postings.select("evidence_id", F.col("observed").alias("__obs"), "term", part.alias("__p"))
    joined = part.join(F.broadcast(asked) if small else asked.hint("merge"), "term").where(F.col("__obs") <= F.col(at))
    scored = joined.groupBy("evidence_id", "query_id").agg(F.sum(F.col("w") * F.col("__p")).alias("score")).select("query_id", "evidence_id", "score")
    ranked = kept(top_k(scored, k, order_by_score(seed=cfg.tie_seed)))  # at most k rows a query, read three times
    # Fill up only the queries that came out short: the rest never meets the whole corpus.
    short = queries.select("query_id", at).join(ranked.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").where(F.coalesce("have", F.lit(0)) < k).select("query_id", F.col(at).alias("__at"))
    asking = short.count()
    if not asking:
        return ranked
    seen = found.postings.select("evidence_id", F.col("observed").alias("__obs")).distinct()
    zero = _least_tied(seen, short, asking, 2 * k, cfg.tie_seed)  # fewer than k of them have a score
    zero = zero.join(ranked.select("query_id", "evidence_id"), ["query_id", "evidence_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(ranked.drop("rank").unionByName(zero), k, order_by_score(seed=cfg.tie_seed))


#: Documents, and questions, that meet in one task of ``_least_tied``; parts of time.
TIED_DOCUMENTS, TIED_QUESTIONS, SPANS = 100_000, 5_000, 64


def _least_tied(documents: DataFrame, short: DataFrame, asking: int, k: int, seed: int) -> DataFrame:
    """(query_id, evidence_id): of the documents (evidence_id, __obs) visible at each question (query_id, __at) at least the k first by ``tie_key``.

    Documents are cut into spans of time of about equally many, a span into parts by hash; a question goes to the parts of the spans
    that have begun by its time. A part hands on its own first k of each question, so no pair is shuffled that can't be in a list.
    """
    cuts = documents.agg(F.percentile_approx("__obs", F.array(*[F.lit(i / SPANS) for i in range(1, SPANS)])).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    span = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= c)) if cuts else F.lit(0)
    dealt = documents.withColumn("span", span(F.col("__obs")))
    sizes = {r["span"]: r["n"] for r in dealt.groupBy("span").agg(F.count("*").alias("n")).collect()}
    parts = [max(1, -(-sizes.get(i, 0) // TIED_DOCUMENTS)) for i in range(len(cuts) + 1)]
    part_count = F.element_at(F.array(*map(F.lit, parts)), F.col("span") + 1)
    blocks = max(1, -(-asking // TIED_QUESTIONS))
    left = dealt.withColumn("part", F.pmod(F.xxhash64("evidence_id"), part_count)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = short.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("span", F.explode(F.sequence(F.lit(0), span(F.col("__at")))))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), part_count.cast("long") - 1)))

    def run(docs: pa.Table, questions: pa.Table) -> pa.Table:
        by_time = sorted(zip(docs.column("__obs").to_pylist(), docs.column("evidence_id").to_pylist(), strict=True)) if questions.num_rows else []
        instants, names = [t for t, _ in by_time], [str(e).encode() for _, e in by_time]
        q, d = [], []
        for query, limit in zip(questions.column("query_id").to_pylist(), questions.column("__at").to_pylist(), strict=True):
            begun = hashlib.sha256(f"{seed}|{query}|".encode())

            def key(i: int) -> bytes:
                own = begun.copy()
                own.update(names[i])
                return own.digest()

            least = heapq.nsmallest(k, range(bisect.bisect_right(instants, limit)), key)
            q += [query] * len(least)
            d += [by_time[i][1] for i in least]
        return pa.table([pa.array(q, questions.schema.field("query_id").type), pa.array(d, docs.schema.field("evidence_id").type)], names=["query_id", "evidence_id"])

    keys = ["span", "part", "block"]
    kind = f"query_id {dict(short.dtypes)['query_id']}, evidence_id {dict(documents.dtypes)['evidence_id']}"
    return left.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, kind)


#: Bytes of float32 vectors, and of questions, that meet in one task.
VECTOR_BYTES, QUESTION_BYTES = 64 << 20, 16 << 20


def dense(vectors: DataFrame, queries: DataFrame, k: int = Retrieval.dense_top_k, observed: str | None = None, at: str | None = None, seed: int = Retrieval.tie_seed, cells: int = 4_000_000, vector_bytes: int = VECTOR_BYTES, question_bytes: int = QUESTION_BYTES) -> DataFrame:
    """(query_id, evidence_id, score, rank): exact top k by inner product in float64, of what is visible.

    vectors: evidence_id, embedding; queries: query_id, embedding. A blocked product, joined as data: both sides are dealt into blocks of at most about
    ``vector_bytes`` and ``question_bytes``, every block of the one meets every block of the other in a task of its own, and hands on its k best of
    a question (and ties of the last). A task multiplies at most ``cells`` pairs at a time (32 MB of products).
    """
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    width = 4 * max(1, size["d"] or 1)
    q_blocks = max(1, -(-size["n"] * width // question_bytes))
    n_vectors = vectors.count()
    # No fewer blocks than cores, if there are vectors enough to be worth it.
    v_blocks = max(1, -(-n_vectors * width // vector_bytes), min(vectors.sparkSession.sparkContext.defaultParallelism, n_vectors // 1000))
    number = lambda id_, blocks: F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # New names: both sides may come from one table.
    left = vectors.select("evidence_id", F.col("embedding").alias("__vector"), *([F.col(observed).alias("__obs")] if observed else [])).where(F.col("__vector").isNotNull()).withColumns({"v": number("evidence_id", v_blocks), "q": every(q_blocks)})
    right = queries.select("query_id", F.col("embedding").alias("__asked"), *([F.col(at).alias("__at")] if at else [])).where(F.col("__asked").isNotNull()).withColumns({"q": number("query_id", q_blocks), "v": every(v_blocks)})

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        q_ids, v_ids = asked.column("query_id").combine_chunks(), block.column("evidence_id").combine_chunks()
        found = []
        if len(q_ids) and len(v_ids):
            questions, stored = _matrix(asked, "__asked"), _matrix(block, "__vector")
            step = max(1, cells // len(stored))
            for low in range(0, len(questions), step):
                product = np.round(questions[low : low + step] @ stored.T, 12)
                if at and observed:
                    limits = asked.column("__at").to_numpy()[low : low + step]
                    product = np.where(block.column("__obs").to_numpy()[None, :] <= limits[:, None], product, -np.inf)
                least = np.partition(product, -k, axis=1)[:, -k][:, None] if product.shape[1] > k else -np.inf
                q, d = np.nonzero((product >= least) & np.isfinite(product))
                found.append((q + low, d, product[q, d]))
        q, d, score = (np.concatenate([f[i] for f in found] or [np.empty(0, (int, int, float)[i])]) for i in range(3))
        return pa.table([q_ids.take(pa.array(q)), v_ids.take(pa.array(d)), pa.array(score)], names=["query_id", "evidence_id", "score"])

    kinds = f"query_id {dict(queries.dtypes)['query_id']}, evidence_id {dict(vectors.dtypes)['evidence_id']}, score double"
    met = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(run, kinds)
    return top_k(met, k, order_by_score(seed=seed))


def by_hash(documents: DataFrame, queries: DataFrame, k: int = Retrieval.top_k, seed: int = Retrieval.tie_seed, block: int = 250_000, questions: int = 1_000) -> DataFrame:
    """The k documents of every question whose ``tie_key`` is least, with rank: what remains of a ranking when all scores are the same.

    documents: evidence_id; queries: query_id (strings). All pairs are hashed, blocks of the one against blocks of the other, each in a task of its own that keeps the k least of a
    question: pairs are neither sorted nor shuffled, only the k best of each question and block of documents are.
    """
    n, asked = documents.count(), queries.count()
    d_blocks = max(1, -(-n // block), min(documents.sparkSession.sparkContext.defaultParallelism, n // 1000))
    q_blocks = max(1, -(-asked // questions))
    number = lambda id_, blocks: F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = documents.select("evidence_id").withColumns({"d": number("evidence_id", d_blocks), "q": every(q_blocks)})
    right = queries.select("query_id").withColumns({"q": number("query_id", q_blocks), "d": every(d_blocks)})

    def run(rows: pa.Table, questions: pa.Table) -> pa.Table:
        ids = rows.column("evidence_id").to_pylist()
        ends = [i.encode() for i in ids]
        out: dict[str, list] = {"query_id": [], "evidence_id": []}
        for q in questions.column("query_id").to_pylist() if ids else ():
            start = hashlib.sha256(f"{seed}|{q}|".encode())

            def key(place: int, start=start) -> bytes:
                h = start.copy()
                h.update(ends[place])
                return h.digest()

            best = heapq.nsmallest(k, range(len(ids)), key)
            out["query_id"] += [q] * len(best)
            out["evidence_id"] += [ids[i] for i in best]
        return pa.table(out, schema=pa.schema([("query_id", pa.string()), ("evidence_id", pa.string())]))

    best = left.groupBy("d", "q").cogroup(right.groupBy("d", "q")).applyInArrow(run, "query_id string, evidence_id string")
    return top_k(best, k, [tie_key(seed, F.col("query_id"), F.col("evidence_id")).asc()])


def _matrix(rows: pa.Table, column: str) -> np.ndarray:
    """The vectors of some rows, all of one length, as float64."""
    flat = rows.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows.num_rows, -1)


def encode(rows: DataFrame, id_: str, text: str, encoder: Callable[[list[str]], np.ndarray], revision: str, known: DataFrame | None = None) -> DataFrame:
    """(evidence_id, revision, embedding) of rows whose embedding by this revision is not known yet. ``encoder`` maps texts to vectors."""
    todo = rows.select(F.col(id_).alias("evidence_id"), F.col(text).alias("__text"))
    if known is not None:
        todo = todo.join(known.where(F.col("revision") == revision), "evidence_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"evidence_id": pdf["evidence_id"], "revision": revision, "embedding": [list(map(float, v)) for v in encoder(list(pdf["__text"]))]})

    return todo.mapInPandas(run, f"evidence_id {dict(rows.dtypes)[id_]}, revision string, embedding array<float>")


def hashing_encoder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a language model: signed hashed words, scaled to unit length."""

    def run(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return run


def score_pairs(pairs: DataFrame, scorer: Callable[[list[str], list[str]], np.ndarray], query_text: str = "query_text", doc_text: str = "evidence_text") -> DataFrame:
    """Adds score, by a function of two lists of texts; a score that is not finite is an error."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        score = np.asarray(scorer(list(a), list(b)), np.float64)
        if not np.isfinite(score).all():
            raise ValueError("a score is not finite")
        return pd.Series(score)

    return pairs.withColumn("score", F.pandas_udf(run, "double")(query_text, doc_text))


def cached_scores(pairs: DataFrame, cache: KeyedCache, key: Column, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pairs`` with score: what the cache doesn't hold is scored (by a function that adds score), each key once, and appended; all are read back from it."""
    keyed = pairs.withColumn("key", key)
    cache.append(score(cache.missing(keyed.dropDuplicates(["key"]))).select("key", F.col("score").cast("double").alias("value")))
    return keyed.join(cache.read().withColumnRenamed("value", "score"), "key").drop("key")


def encoding_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the largest difference between two encodings of the same ids."""
    joined = a.select("evidence_id", F.col("embedding").alias("x")).join(b.select("evidence_id", F.col("embedding").alias("y")), "evidence_id")
    return joined.agg(F.max(F.array_max(F.zip_with("x", "y", lambda x, y: F.abs(x - y)))).alias("max_abs_diff"))
