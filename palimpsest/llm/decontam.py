"""Benchmark decontamination by SimHash windows, multi-index Hamming search and exact verification.

Native: DataFrame functions only.

A window is as many words of a document as a benchmark item has; a document shorter than the item is one window. A
window similar to an item shares so many shingles with it that it has one of the item's rarest (its anchors). So:

1. anchors filter: most documents have none of any item and are done here;
2. in the others a window of an item's length is laid at every place from which enough of the item's shingles follow, wherever these
   stand in it: sentences may be moved, halves swapped. From here on a window knows its length and no item;
3. each window gets a 64-bit SimHash of its shingles, weighted by their number. The fingerprints of all items of one length are entered, for each
   block of bits, under the values that differ in at most radius // blocks bits; two fingerprints within the radius differ in no more than that
   in some block, so looking up the window's blocks finds every item within the radius, whatever the anchors said;
4. what the index finds is verified: the weighted Jaccard similarity of the shingles must reach the threshold.

The best window of any length begins with a shingle of the item or ends with the document: from any other, the next one
shares as much. So step 2 loses nothing, and only step 3 can, by the chance that the fingerprints are farther apart.

An item of one to four words is a single shingle, and so is each window of as many words: these are joined as they are.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, words

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
#: At similarity 0.8 two fingerprints differ in 9.7 bits on average with a deviation of 2.9; 19 is over three deviations.
RADIUS = 19
BLOCKS = 10
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Rows of a table of anchors or marks that may be broadcast (some 30 bytes each); larger ones are shuffled.
BROADCAST_ROWS = 2_000_000


def _runs(hashes: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words, with repetition, by position; none if there are fewer words."""
    each = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))
    return F.when(F.size(hashes) >= size, each).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame, id_: str, name: str, *others: Column) -> DataFrame:
    return df.select(*others, F.coalesce(F.col(id_).cast("long"), F.lit(NO_ID)).alias(name), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))


def _shingled(df: DataFrame, id_: str, name: str, *others: Column) -> DataFrame:
    hashed = _hashed(df, id_, name, *others)
    return hashed.select(*[c for c in hashed.columns if c != "words"], _runs(F.col("words")).alias("shingles"))


def _short_found(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, broadcast_rows: int) -> DataFrame | None:
    """As ``_found``, for items of one to four words: every run of a document's words that equals one. None if there is no such item."""
    items = _hashed(benchmark, "item_id", "item_id").withColumn("size", F.size("words")).where(F.col("size").between(1, SHINGLE - 1))
    run = F.coalesce(*[F.when(F.col("size") == n, F.get(_runs(F.col("words"), n), 0)) for n in range(1, SHINGLE)])
    items = scratch.keep(items.select("item_id", "size", run.alias("shingle")).distinct(), "short")
    sizes = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}
    found = None
    for size, n in sizes.items():
        own = items.where(F.col("size") == size).select("item_id", "shingle")
        runs = _hashed(docs, "doc_id", "doc_id", _text_key(F.col("text")).alias("d")).select("doc_id", "d", F.posexplode(_runs(F.col("words"), size)).alias("p", "shingle"))
        met = runs.join(F.broadcast(own) if n <= broadcast_rows else own, "shingle").groupBy("doc_id", "d", "item_id").agg(F.min("p").alias("first_word"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        return None
    return found.select("doc_id", "d", "item_id", F.lit(1.0).alias("similarity"), "first_word")


def simhash(name: str) -> Column:
    """64-bit fingerprint of an array column: bit b is set if it is set in more than half of the hashes, repeated ones counted."""
    ones = f"aggregate({name}, 0, (s, h) -> s + cast(shiftright(h, b) & 1L AS int))"
    return F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (acc, b) -> acc | shiftleft(if(2 * {ones} > size({name}), 1L, 0L), b))")


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block; the blocks part the 64 bits."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def _block_values(fingerprint: Column, blocks: int) -> Column:
    """Array of (block, value) of a fingerprint."""
    cut = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << n) - 1)).alias("value")) for i, (a, n) in enumerate(block_bounds(blocks))]
    return F.array(*cut)


def _flips(spark: SparkSession, radius: int, blocks: int) -> DataFrame:
    """(block, flip): every mask of at most radius // blocks bits of each block."""
    widths = [n for _, n in block_bounds(blocks)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.lit(1 << n).alias("end")) for i, n in enumerate(widths)])).alias("b")
    masks = spark.range(1 << max(widths)).where(F.bit_count("id") <= radius // blocks)
    return masks.select(F.col("id").alias("flip"), each).where(F.col("flip") < F.col("b.end")).select("b.block", "flip")


def occurrences(shingles: Column) -> Column:
    """Turn a multiset into a set: the nth occurrence of a shingle is an element of its own."""
    return F.transform(shingles, lambda h, i: F.xxhash64(h, F.size(F.filter(F.slice(shingles, 1, i), lambda x: x == h))))


def _anchors(items: DataFrame, similarity: float) -> DataFrame:
    """(shingle, t) of the rarest shingles of every item; any window similar enough has one of them.

    Of an item's m places a similar window, be it shorter, has at least ceil(similarity m); the rarest shingles that hold more places
    than may be missing cannot all be missing.
    """
    each = items.select("t", "m", F.explode("shingles").alias("shingle")).groupBy("t", "m", "shingle").agg(F.count("*").alias("places"))
    rated = each.join(each.groupBy("shingle").agg(F.count("*").alias("df")), "shingle")
    order = Window.partitionBy("t").orderBy("df", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("places").over(order), F.lit(0))
    return rated.withColumn("before", before).where(F.col("before") <= F.col("m") - F.ceil(F.lit(similarity) * F.col("m") - 1e-9)).select("shingle", "t")


def contaminated(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """doc_id, item_id, similarity and first_word of every item found in a document (at its best window).

    docs (doc_id, text) and benchmark (item_id, text); a row for each pair of ids, however often either is repeated; rows
    with a null id are one document or item, and texts of one id are searched apart. Null and empty texts are found nowhere; an item of fewer
    than five words wherever its words stand in a row. first_word counts from 0 and is the first word of the best window;
    of windows equally similar the first that begins with a shingle of the item, or ends with the document.
    """
    found = _found(spark, docs, benchmark, similarity, radius, blocks, broadcast_rows)
    # Items of one id may have several texts, and documents too.
    best = found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max_by("first_word", F.struct("similarity", -F.col("first_word"))).alias("first_word"))
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return best.select(back("doc_id"), back("item_id"), "similarity", "first_word")


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose texts no item is found (see ``contaminated``), whatever their ids."""
    found = _found(spark, docs, benchmark, similarity, radius, blocks, broadcast_rows).select("d").distinct()
    own = docs.select(F.struct(*docs.columns).alias("row"), _text_key(F.col("text")).alias("d"))
    return own.join(found, "d", "left_anti").select("row.*")


def _text_key(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))


def _found(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float, radius: int, blocks: int, broadcast_rows: int) -> DataFrame:
    """doc_id, d (key of its text), item_id, similarity and first_word, at the best window of each text for each text of an item."""
    scratch = Scratch(spark, "decontam")
    keys = F.struct(F.xxhash64("shingles").alias("k1"), F.xxhash64(F.lit(1), F.col("shingles")).alias("k2"))
    named = scratch.keep(_shingled(benchmark, "item_id", "item_id").where(F.size("shingles") > 0).select("item_id", keys.alias("t"), "shingles"), "named")
    # Items with equal words are one text t from here on.
    items = named.dropDuplicates(["t"]).select("t", F.size("shingles").alias("m"), "shingles")
    items = scratch.keep(items.withColumn("fingerprint", simhash("shingles")), "items")
    anchors = scratch.keep(_anchors(items, similarity), "anchors")
    marks = scratch.keep(items.select("t", "m", F.explode(F.array_distinct("shingles")).alias("shingle")), "marks")
    n_anchors, n_marks = anchors.count(), marks.count()

    text = _shingled(docs, "doc_id", "doc_id", _text_key(F.col("text")).alias("d"))
    if n_anchors <= broadcast_rows:
        # Outer: else Spark would compute the shingles once more for a filter below, within each lambda's step.
        met = text.select("doc_id", "d", "shingles", F.explode_outer("shingles").alias("shingle")).join(F.broadcast(anchors), "shingle").select("doc_id", "d", "shingles", "t")
    else:
        each = text.select("d", F.explode_outer(F.array_distinct("shingles")).alias("shingle")).distinct()
        met = text.join(each.join(anchors, "shingle").select("d", "t").distinct(), "d").select("doc_id", "d", "shingles", "t")
    # A row for each text of a document and each of its candidates.
    pairs = scratch.keep(met.distinct().withColumn("pair", F.monotonically_increasing_id()), "pairs")
    hits = pairs.select("pair", "t", F.posexplode("shingles").alias("p", "shingle")).join(F.broadcast(marks) if n_marks <= broadcast_rows else marks, ["t", "shingle"])
    # No longer than one document.
    places = hits.groupBy("pair").agg(F.array_sort(F.collect_list("p")).alias("places"), F.first("m").alias("m"))
    laid = pairs.join(places, "pair").withColumn("length", F.least("m", F.size("shingles")))
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("m") + F.col("length")) - 1e-9).cast("int")
    last = F.size("shingles") - F.col("length")
    follows = lambda p, i: F.get(F.col("places"), i + least - 1) < p + F.col("length")
    begun = F.filter(F.transform("places", lambda p, i: F.when((p <= last) & follows(p, i), p)), lambda p: p.isNotNull())
    ended = F.when(F.size(F.filter("places", lambda p: p >= last)) >= least, F.array(last)).otherwise(F.array().cast("array<int>"))
    laid = laid.select("doc_id", "d", "m", "length", "shingles", F.explode(F.array_union(begun, ended)).alias("start"))
    windows = laid.select("doc_id", "d", "m", "start", F.slice("shingles", F.col("start") + 1, F.col("length")).alias("window"))
    windows = scratch.keep(windows.withColumns({"fingerprint": simhash("window"), "wid": F.monotonically_increasing_id()}), "windows")

    flips = _flips(spark, radius, blocks)
    entered = items.select("t", "m", "fingerprint", F.inline(_block_values(F.col("fingerprint"), blocks)))
    index = scratch.keep(entered.join(F.broadcast(flips), "block").select("t", "m", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), F.col("fingerprint").alias("of_item")), "index")
    looked = windows.select("wid", "m", "fingerprint", F.inline(_block_values(F.col("fingerprint"), blocks)))
    near = looked.join(F.broadcast(index) if index.count() <= broadcast_rows else index, ["m", "block", "value"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("of_item"))) <= radius)
    candidates = near.select("wid", "t").distinct()

    # An item that half of the corpus quotes meets its windows by broadcast.
    known = items.select("t", F.col("shingles").alias("item"))
    both = windows.join(candidates, "wid").join(F.broadcast(known) if n_marks <= broadcast_rows else known, "t")
    shared = F.size(F.array_intersect(occurrences(F.col("window")), occurrences(F.col("item"))))
    judged = both.select("doc_id", "d", "t", "start", (shared / (F.size("window") + F.size("item") - shared)).alias("similarity"))
    found = judged.where(F.col("similarity") >= similarity - 1e-9).groupBy("doc_id", "d", "t").agg(F.max("similarity").alias("similarity"), F.max_by("start", F.struct("similarity", -F.col("start"))).alias("first_word"))
    names = named.select("item_id", "t").distinct()
    found = found.join(F.broadcast(names) if n_marks <= broadcast_rows else names, "t").drop("t")
    short = _short_found(docs, benchmark, scratch, broadcast_rows)
    found = scratch.keep(found if short is None else found.unionByName(short.select(found.columns)), "found")
    scratch.drop(*(set(scratch.names()) - {"found"}))
    return found
