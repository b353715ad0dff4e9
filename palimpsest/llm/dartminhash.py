"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

Darts fall on the plane of weight and rank as a Poisson process that an element's hash determines, cell by cell of
the unit grid. A weighted set keeps the darts below its elements' weights; each dart also names one of ``k`` coordinates,
and the signature is the earliest rank in each coordinate. Rows of darts are added until every coordinate is
hit, so a set of total weight W needs about k ln k / W rows: the work follows the size of the set plus k log k, and
two signatures agree in a coordinate with probability equal to the weighted Jaccard similarity.

From signatures to classes:

1. texts with equal words collapse into one node;
2. signatures are cut into bands; nodes with an equal band share a bucket;
3. every node of a bucket is paired with the bucket's most central node, which shares buckets with the most others, and
   verified exactly;
4. components of the verified links are taken; a bucket within one component needs nothing more;
5. the nodes of buckets that hold several components are joined exactly among each other, by the rarest shingles of
   each (prefix filter) and across components only, verified, and the components taken again.

No step pairs all nodes of a bucket, and no link between nodes that share a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from palimpsest.llm.common import Scratch, join_counted, small_arrow_batches, words
from palimpsest.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6
#: Sets of one shingle that are paired in one part.
PART = 1000
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
_CDF = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, i + 1)) for i in range(16)])
_STEPS = (_CDF * 2.0**53).astype(np.uint64)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _throw(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, signature: np.ndarray) -> None:
    """Throw the darts of rank rows [low, high) of each set at its elements, and keep the earliest per coordinate."""
    columns = np.ceil(weight).astype(np.int64)
    height = (high - low)[owner]
    cells = columns * height
    at = np.repeat(np.arange(len(element)), cells)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    column, row = inner // height[at], low[owner[at]] + inner % height[at]
    cell = mix(element[at] + mix(column.astype(np.uint64) * _A + row.astype(np.uint64) * _D + _B))
    count = np.searchsorted(_STEPS, cell >> np.uint64(11), side="right")
    dart = np.repeat(np.arange(len(at)), count)
    nth = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
    first = mix(cell[dart] + (nth.astype(np.uint64) + np.uint64(1)) * _A)
    second = mix(first)
    coordinate = ((first >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    rank = (row[dart].astype(np.uint64) << np.uint64(40)) | (second >> np.uint64(24))
    who = at[dart]
    if (weight != columns).any():  # darts above the weight, in an element's last column
        height_of_dart = column[dart] + (mix(second) >> np.uint64(11)) * 2.0**-53
        below = height_of_dart < weight[who]
        coordinate, rank, who = coordinate[below], rank[below], who[below]
    np.minimum.at(signature, owner[who] * k + coordinate.astype(np.int64), rank)


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash of sets laid end to end: (len(sizes), k) ranks. Elements of a set are distinct, weights positive.

    An empty set has the largest rank everywhere.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(owner, weights, len(sizes))
    signature = np.full(len(sizes) * k, np.iinfo(np.uint64).max, np.uint64)
    todo = sizes > 0
    low = np.zeros(len(sizes), np.int64)
    high = np.where(todo, np.ceil((k * np.log(k) + k) / np.maximum(total, 1e-9)), 0).astype(np.int64)
    while todo.any():
        chosen = todo[owner]
        _throw(owner[chosen], elements[chosen], weights[chosen], low, high, k, signature)
        empty = (signature.reshape(-1, k) == np.iinfo(np.uint64).max).any(axis=1)
        todo &= empty
        low, high = high, high + np.maximum(high // 2, 1)
    return signature.reshape(-1, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; equal keys in different bands are unrelated."""
    cut = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1).astype(np.uint64) * _A), cut.shape[:2])
    for i in range(rows):
        key = mix(key * _D + cut[:, :, i])
    return key.view(np.int64)


def shingles(word_hashes: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words, with repetition; of the whole if it is shorter; none of no word."""
    runs = F.transform(F.sequence(F.lit(0), F.size(word_hashes) - size), lambda i: F.xxhash64(*[F.get(word_hashes, i + j) for j in range(size)]))
    return F.when(F.size(word_hashes) >= size, runs).when(F.size(word_hashes) > 0, F.array(F.xxhash64(word_hashes))).otherwise(F.array().cast("array<bigint>"))


def keyed(docs: DataFrame, *others: str) -> DataFrame:
    """id, k1, k2 and words (hashes) of every row, and ``others``; a null id becomes NO_ID, a null text an empty one.

    k1 and k2 are hashes of the words; of the raw text where there are none.
    """
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")
    raw = F.xxhash64(F.lit(3), F.coalesce(F.col("text"), F.lit(""))).alias("raw")
    plain = docs.select(*others, id_, raw, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    wordless = F.size("words") == 0
    k1 = F.when(wordless, F.col("raw")).otherwise(F.xxhash64("words")).alias("k1")
    k2 = F.when(wordless, F.lit(0)).otherwise(F.xxhash64(F.lit(1), F.col("words"))).alias("k2")
    return plain.select(*others, "id", k1, k2, "words")


def sketch(spark: SparkSession, docs: DataFrame, bands: int, rows: int, weighted: bool) -> DataFrame:
    """id, k1, k2 (of the words) and band keys of every row. Texts without a word have no band."""
    small_arrow_batches(spark)
    plain = keyed(docs).select("id", "k1", "k2", shingles(F.col("words")).alias("shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("shingles")
            sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            order = np.lexsort((flat, owner))
            owner, flat = owner[order], flat[order]
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
            starts = np.flatnonzero(new)
            weight = np.diff(np.append(starts, len(flat))).astype(float) if weighted else np.ones(len(starts))
            sizes = np.bincount(owner[starts], minlength=len(sizes))
            keys = band_keys(signatures(flat[starts], weight, sizes, bands * rows), bands, rows)
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[sizes > 0].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k1"), batch.column("k2"), lists], names=["id", "k1", "k2", "bands"])

    return plain.mapInArrow(run, "id long, k1 long, k2 long, bands array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets (id, shingles) are similar enough."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("a", "b")


def _rare_pairs(mixed: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """Pairs of (id, label, shingles) with different labels that share a shingle in their prefixes of rarest ones.

    Exact: sets at least ``similarity`` alike share one of their n - ceil(similarity n) + 1 rarest shingles, in any
    common order of the shingles, and at the first of those enough is left of both for that similarity.
    """
    size = F.size("shingles")
    each = scratch.keep(mixed.select("id", "label", size.alias("n"), F.explode("shingles").alias("shingle")), "mixed")
    counted = each.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    counted = scratch.keep(counted, "df")
    total = counted.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    # A shingle of one set alone comes first in the order and links nothing; its place is taken into account.
    shared = join_counted(each, counted, ["shingle"], "df", total)
    by_set = Window.partitionBy("id", "n")
    place = F.col("n") - F.count("*").over(by_set) + F.row_number().over(by_set.orderBy("df", "shingle"))
    prefix = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1
    # What is left of a set from this shingle on, itself included.
    kept = scratch.keep(shared.withColumn("place", place).where(F.col("place") <= prefix).select("id", "label", "n", "shingle", (F.col("n") - F.col("place") + 1).alias("rest")), "prefix")
    groups = kept.groupBy("shingle", "label").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"), F.sum("c").alias("rows"))
    groups = scratch.keep(groups.where(F.col("labels") > 1), "groups")
    held = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    left = join_counted(kept, groups, ["shingle"], "rows", held)
    # Of a shingle's sets, those with its commonest label meet only the others.
    others = left.where(F.col("label") != F.col("main")).select("shingle", F.col("id").alias("b"), F.col("label").alias("bl"), F.col("n").alias("bn"), F.col("rest").alias("br"))
    # A shingle of many sets is dealt in parts: its sets over the parts, the others to each part.
    parts = groups.where(F.col("rows") > PART).select("shingle", F.ceil(F.col("rows") / PART).cast("int").alias("parts"))
    dealt = left.select("shingle", F.col("id").alias("a"), F.col("label").alias("al"), F.col("n").alias("an"), F.col("rest").alias("ar"), F.ceil(F.col("rows") / PART).cast("int").alias("parts"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).drop("parts")
    others = others.join(parts, "shingle", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")
    met = dealt.join(others, ["shingle", "part"])
    # At the first shingle that two sets share, what is left of either is all they can share.
    enough = F.least("ar", "br") >= F.lit(similarity / (1 + similarity)) * (F.col("an") + F.col("bn")) - 1e-9
    alike = enough & (F.col("al") != F.col("bl")) & (F.least("an", "bn") >= F.lit(similarity) * F.greatest("an", "bn") - 1e-9)
    return met.where(alike).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _classified(spark: SparkSession, docs: DataFrame, similarity: float, bands: int, rows: int, weighted: bool) -> DataFrame:
    """id, k1, k2, class_id and first of every row; first marks the rows that stand for their class: one id with one text."""
    scratch = Scratch(spark, "neardup")
    table = scratch.keep(sketch(spark, docs, bands, rows, weighted), "sketch")
    # A node is a text, whatever its ids; named is its least id that is not null.
    texts = table.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.min(F.nullif("id", F.lit(NO_ID))).alias("named"), F.count("*").alias("copies"))
    texts = scratch.keep(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    n_rows = texts.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    row = ["k1", "k2", "id"]
    rows_of = texts.select("k1", "k2", F.col("least").alias("id"), "node")

    # Of each text a row with the least id goes on.
    first = table.where(F.size("bands") > 0).select(*row, "bands").join(rows_of.hint("merge"), row)
    entries = scratch.keep(first.select("node", F.explode("bands").alias("bucket")).distinct(), "entries")
    buckets = scratch.keep(entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1), "buckets")
    n_entries = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shared = scratch.keep(join_counted(entries, buckets, ["bucket"], "n", n_entries), "shared")
    # A text in the midst of its near copies shares buckets with the most of them, and so links the most of them.
    central = shared.groupBy("node").agg(F.sum("n").alias("met"))
    pivots = shared.join(central.hint("merge"), "node").groupBy("bucket", "n").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("pivot"))
    pivots = scratch.keep(pivots, "pivots")
    hits = scratch.keep(join_counted(shared.select("bucket", "node"), pivots, ["bucket"], "n", n_entries).select("bucket", "node", "pivot"), "hits")

    pairs = hits.where(F.col("node") != F.col("pivot")).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = scratch.keep(pairs, "pairs")
    involved = rows_of.join(hits.select("node").distinct().hint("merge"), "node", "left_semi")
    whole = keyed(docs).join(involved.hint("merge"), row).select(F.col("node").alias("id"), F.array_distinct(shingles(F.col("words"))).alias("shingles"))
    sets = scratch.keep(whole.dropDuplicates(["id"]), "sets")  # rows of one node have equal words
    scratch.drop("entries", "buckets", "shared", "pivots")
    links = scratch.keep(_verified(pairs, sets, similarity), "links")
    labels = scratch.keep(components(links, scratch, "star"), "labels")

    named = hits.select("bucket", "node").join(labels.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    named = scratch.keep(named, "named")
    scratch.drop("hits", "star")
    mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where(F.col("lo") != F.col("hi"))
    mixed = scratch.keep(mixed, "mixed-buckets")
    if mixed.take(1):
        n_mixed = mixed.agg(F.sum("n").alias("n")).first()["n"]
        open_ = join_counted(named, mixed, ["bucket"], "n", n_mixed).select(F.col("node").alias("id"), "label").distinct()
        more = _rare_pairs(open_.join(sets.hint("merge"), "id"), scratch, similarity)
        more = more.join(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).hint("merge"), ["a", "b"], "left_anti")
        found = scratch.keep(_verified(more, sets, similarity), "more-links")
        if found.take(1):
            labels = scratch.keep(components(links.union(found), scratch, "all"), "all-labels")

    # The text of a class that has its least id; of several the one with the least hash.
    linked = scratch.keep(texts.join(labels.hint("merge"), "node").select("node", "label", "k1", "k2", "named"), "linked")
    foremost = F.struct(F.col("named").isNull(), "named", "k1", "k2")
    chosen = linked.groupBy("label").agg(F.min("named").alias("class_id"), F.min_by("node", foremost).alias("chosen"), F.count("*").alias("n"))
    chosen = scratch.keep(chosen, "chosen")
    n_linked = chosen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    of_class = join_counted(linked.select("node", "label"), chosen, ["label"], "n", n_linked).select("node", "class_id", (F.col("node") == F.col("chosen")).alias("chosen"))
    classes = texts.join(of_class.hint("merge"), "node", "left")
    alone = F.col("chosen").isNull()
    classes = classes.select("k1", "k2", "copies", F.coalesce("named", F.lit(NO_ID)).alias("owner"), F.when(alone, F.col("named")).otherwise(F.col("class_id")).alias("class_id"), (alone | F.col("chosen")).alias("chosen"))
    classes = scratch.keep(classes, "classes")
    scratch.drop(*(set(scratch.names()) - {"sketch", "classes"}))
    out = join_counted(table.select("id", "k1", "k2"), classes, ["k1", "k2"], "copies", n_rows)
    return out.select("id", "k1", "k2", "class_id", (F.col("chosen") & (F.col("id") == F.col("owner"))).alias("first"))


def near_duplicates(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """doc_id and class_id of every row of ``docs`` (doc_id, text): the least doc_id of its near-duplicate class.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at least ``similarity``; words
    are runs of letters and digits, in lower case; a text of one to four words has one shingle. A class is a component
    of the links. A text without words is linked to equal texts only, null counting as empty. Texts are classified whatever
    their ids: rows that share a doc_id, or have none, are in one class only if their texts are. class_id is null where
    no document of the class has an id. ``weighted`` gives shingles their number of occurrences as weight in the signatures.

    With 40 bands of 6, a pair at 0.8 is missed with probability 5e-6 for the lack of a common bucket.
    """
    out = _classified(spark, docs, similarity, bands, rows, weighted)
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "class_id")


def one_of_each(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Of each class of near duplicates (see ``near_duplicates``) one row of ``docs``, with all its columns.

    It is the row whose doc_id is the least of the class. Rows equal in doc_id and in the text's words count as one; the one with
    the least hash of the raw text, then the least other columns, stays. So no class of texts disappears, whatever the ids.
    """
    out = _classified(spark, docs, similarity, bands, rows, False)
    key = ["id", "k1", "k2"]
    first = out.where("first").select(*[F.col(c).alias(f"__{c}") for c in key]).distinct()
    rest = F.to_json(F.struct(*[F.col(f"__row.{c}").alias(c) for c in docs.columns if c != "text"]))
    own = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text")
    named = keyed(own, "__row").select("__row", *[F.col(c).alias(f"__{c}") for c in key])
    kept = named.join(first.hint("merge"), [f"__{c}" for c in key], "left_semi")
    least = F.struct(F.xxhash64(F.coalesce(F.col("__row.text"), F.lit(""))), rest)
    return kept.groupBy(*[f"__{c}" for c in key]).agg(F.min_by("__row", least).alias("__row")).select("__row.*")
