"""Jaccard join of word n-gram sets by prefix trees.

A set's n-grams stand in one global order, rare ones first: by the sum of their words' logarithmic frequencies, then by hash.
Two sets that are similar enough share one of the first few n-grams of each (their prefixes), and after the first one that
they share enough must be left of both.

1. equal sets become one node. Of most texts only the rarer quarter of their n-grams is shuffled, once: where more of them stand in no
   other set than a similar set may lack, there is no similar set;
2. the nodes that are left are grouped by each n-gram that several have in their prefixes. Each is paired with its group's most central node, verified, and
   the components of these links are taken: copies of one text are done here, without pairing them among each other;
3. groups that still hold several components are joined by trie. The tails of a group's members after the n-gram (in order, at
   most ``TAIL`` n-grams) go into a prefix tree. A member is sought by walking the tree with the overlap so far; members with the same beginning
   share the walk. A subtree is left out as soon as what remains of the sought set or of the longest set in it can't reach the
   overlap that is needed, or if all its sets are of the sought one's component, or have the same first shared n-gram and so meet elsewhere;
4. what the trie leaves is verified on the whole sets, and the components are taken again.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, join_counted, small_arrow_batches
from palimpsest.llm.dartminhash import mix
from palimpsest.llm.graph import components

GRAM = 3
#: Sets link if DEN * intersection >= NUM * union.
NUM, DEN = 90, 100
#: Words whose frequencies order the n-grams; rarer words count as never seen. A bound of what tasks are sent, not of what is joined.
RANKED_WORDS = 65_536
#: N-grams of a set that stand in a tree.
TAIL = 512
#: Members of a group in one tree.
BLOCK = 1000
#: Levels of frequency for each unit of the logarithms' sum.
LEVELS = 25
#: Rows of 40 bytes that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: Words that a task remembers.
REMEMBERED = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def split(text: str | None) -> list[bytes]:
    """Words of a text: runs without ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


class Words(dict):
    """Number of each word in ``hashes`` and ``weights``; a word not seen before is hashed and weighed."""

    def __init__(self, weight_of: dict[bytes, float]):
        super().__init__()
        self.weight_of, self.hashes, self.weights = weight_of, np.zeros(1024, np.uint64), np.zeros(1024)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        if number == len(self.hashes):
            self.hashes, self.weights = np.resize(self.hashes, 2 * number), np.resize(self.weights, 2 * number)
        self.hashes[number] = xxhash.xxh3_64_intdigest(word)
        self.weights[number] = self.weight_of.get(word, 0.0)
        return number


def grams(numbers: np.ndarray, words: Words, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text (of the whole text if it is shorter; none of no word): their hashes, and their places in the global order.

    A place holds the level of the n-gram's frequency in its upper 11 bits and 52 bits of its hash, so places are in order as numbers.
    """
    if not len(numbers):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    width = min(size, len(numbers))
    count = len(numbers) - width + 1
    gram, weight = np.full(count, width, np.uint64), np.zeros(count)
    own, heavy = words.hashes[numbers], words.weights[numbers]
    for i in range(width):
        gram = mix(gram * _A + own[i : i + count] + _B)
        weight += heavy[i : i + count]
    gram, first = np.unique(gram, return_index=True)
    level = np.minimum(weight[first] * LEVELS, 2047).astype(np.int64)
    return gram, np.sort((level << 52) | (gram >> np.uint64(12)).astype(np.int64))


def lacking(n: int | Column, num: int = NUM, den: int = DEN) -> int | Column:
    """So many n-grams of a set of n may be missing in a similar set. One more, its first ones in whatever order, are its prefix."""
    return n - -(-num * n // den) if isinstance(n, int) else n - F.ceil(F.lit(num) * n / den - 1e-9)


def told_length(n: int | Column, num: int = NUM, den: int = DEN) -> int | Column:
    """How many first n-grams are looked at to tell whether too many stand in no other set: half as many again as the prefix."""
    return -(-3 * (lacking(n, num, den) + 1) // 2) if isinstance(n, int) else F.ceil(1.5 * (lacking(n, num, den) + 1))


def stored_length(n: int, num: int = NUM, den: int = DEN) -> int:
    """How many first n-grams of a set of n must be known so that no n-gram that a similar set looks at is taken for missing here.

    A similar set has at most den n / num n-grams, and each of them stands here at most as many places later as n-grams may be missing there.
    """
    prefix = -(-(den - num) * n // num) + 1
    return min(n, -(-3 * prefix // 2) + 1 + lacking(n, num, den))


def word_weights(docs: DataFrame, scratch: Scratch, ranked: int = RANKED_WORDS) -> dict[bytes, float]:
    """Logarithm of the number of occurrences of the commonest words of all texts, at most ``ranked``; a task leaves out what it has seen once.

    Any weights give the right links; the better they tell how rare an n-gram is, the fewer texts are candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column("text"):
                for word in split(text.as_py()):
                    counts[word] = counts.get(word, 0) + 1
            if len(counts) > REMEMBERED:
                counts = {word: n for word, n in counts.items() if n > 1}
                yield out()
                counts = {}
        counts = {word: n for word, n in counts.items() if n > 1}
        yield out()

    counted = scratch.keep(docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # The lowest level of frequency from which on there are no more words than that: some hundred numbers decide, and nothing is ordered.
    level = F.floor(F.log2("n") * 8)
    from_, held = None, 0
    for r in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
        held += r["words"]
        if held > ranked:
            break
        from_ = r["level"]
    top = [] if from_ is None else counted.where(level >= from_).collect()
    return {bytes(r["word"]): math.log(r["n"] + 1) for r in top}


def ordered_sets(spark: SparkSession, docs: DataFrame, weights: dict[bytes, float], whole: bool, num: int, den: int, size: int) -> DataFrame:
    """doc_id, n (size of the set), k1 and k2 (its hashes), and its n-grams in order: the whole set, or as many as ``stored_length`` says."""
    known = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Words(known.value)
        for batch in batches:
            texts = [split(t.as_py()) for t in batch.column("text")]
            numbers = [np.fromiter(map(seen.__getitem__, t), np.int64, len(t)) for t in texts]
            sets = [grams(x, seen, size) for x in numbers]
            if len(seen) > REMEMBERED:
                seen = Words(known.value)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s, _ in sets]
            keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2) if sets else np.empty((0, 2), np.int64)
            cut = [s if whole else s[: stored_length(len(s), num, den)] for _, s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in cut])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *cut])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s, _ in sets], pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "n", "k1", "k2", "grams"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, grams array<long>")


class Member(NamedTuple):
    """A set in a group: its n-grams after the group's (at most TAIL), their number from that one on (rest), and its first shared n-gram."""

    id: int
    label: int
    n: int
    rest: int
    first: int
    tail: list[int]
    entered: bool = True
    sought: bool = True


def needed(n: int, m: int, num: int, den: int) -> int:
    """How many n-grams similar sets of n and m have in common at least; of any m, if m is 0."""
    return -(-num * (n + m) // (num + den)) if m else -(-num * n // den)


class Tree:
    """Prefix tree of ordered tails, with a run of n-grams on each edge.

    A node has the run that leads to it, its children by their first n-gram, the members that end in it, and of all members below
    the most n-grams that are left from the group's on, the least and the largest size, and the label and the first n-gram, where these are
    all the same.
    """

    __slots__ = ("children", "ends", "first", "high", "label", "low", "most", "run")

    def __init__(self, run: list[int]):
        self.run, self.children, self.ends = run, {}, []
        self.most, self.low, self.high, self.label, self.first = 0, 1 << 62, 0, -1, -1

    def _holds(self, member: Member) -> None:
        self.most = max(self.most, member.rest)
        self.low, self.high = min(self.low, member.n), max(self.high, member.n)
        self.label = member.label if self.label in (-1, member.label) else None
        self.first = member.first if self.first in (-1, member.first) else None

    def add(self, member: Member) -> None:
        node, tail, at = self, member.tail, 0
        node._holds(member)
        while at < len(tail):
            child = node.children.get(tail[at])
            if child is None:
                child = node.children[tail[at]] = Tree(tail[at:])
                at = len(tail)
            else:
                same = 0
                while same < len(child.run) and at + same < len(tail) and child.run[same] == tail[at + same]:
                    same += 1
                if same < len(child.run):  # the run parts here
                    upper = Tree(child.run[:same])
                    upper.most, upper.label, upper.first, upper.low, upper.high = child.most, child.label, child.first, child.low, child.high
                    child.run = child.run[same:]
                    upper.children[child.run[0]] = child
                    node.children[upper.run[0]] = upper
                    child = upper
                at += same
            node = child
            node._holds(member)
        node.ends.append(member)

    def find(self, sought: Member, gram: int, num: int, den: int) -> Iterator[tuple[Member, bool]]:
        """Members that may be similar to the sought one, and whether they surely are: of other labels, and with another first n-gram.

        Two sets with one first n-gram meet in that n-gram's group, so they are left out of any other (``gram`` is this group's). Along
        a path, ``missed`` n-grams of it are not in the sought set and ``matched`` are. Both stand in one order, so what either has passed by is
        lost for good; only behind the end of a tail that was cut the sought set may still have an n-gram of the path.
        """
        tail, n = sought.tail, sought.n
        there = {g: i + 1 for i, g in enumerate(tail)}
        cut = len(tail) < sought.rest - 1
        known = tail[-1] if cut and tail else math.inf
        first = sought.first if sought.first != gram else -2
        stack = [(self, 0, 0, 0)]
        while stack:
            node, missed, matched, passed = stack.pop()
            if node.label == sought.label or node.first == first or num * n > den * node.high or num * node.low > den * n:
                continue
            # So many of the sought set's n-grams may be passed by without a match, and so many of the path's be missed.
            least = max(needed(n, 0, num, den), needed(n, node.low, num, den))
            lost, spare = sought.rest - least, node.most - least
            for g in node.run:
                at = there.get(g)
                if at is not None:
                    matched, passed = matched + 1, at
                    if passed - matched > lost:
                        break
                elif g < known:
                    missed += 1
                    if missed > spare:
                        break
            else:
                if passed - matched > lost or missed > spare:
                    continue
                for other in node.ends:
                    if other.label != sought.label and other.first != first:
                        enough = needed(n, other.n, num, den)
                        if not cut and len(other.tail) == other.rest - 1:  # all of both is known
                            if matched + 1 >= enough:
                                yield other, True
                        elif min(sought.rest - (passed - matched), other.rest - missed) >= enough:
                            yield other, False
                stack += [(child, missed, matched, passed) for child in node.children.values()]


def _linked(group: Iterator[Member], gram: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of one group that may be links. Of labels that a sure link joins no further pair is looked for: one link is as good as all.

    The entered members come first; at most these are held, others are sought as they pass by.
    """
    tree, joined = Tree([]), {}

    def top(label: int) -> int:
        while label in joined:
            label = joined[label]
        return label

    def pairs(member: Member) -> Iterator[tuple[int, int]]:
        for other, sure in tree.find(member, gram, num, den):
            a, b = top(member.label), top(other.label)
            if a != b:
                yield max(member.id, other.id), min(member.id, other.id)
                if sure:
                    joined[max(a, b)] = min(a, b)

    held: list[Member] = []
    for member in group:
        if member.entered:
            tree.add(member)
            held.append(member)
            continue
        for own in held:
            if own.sought:
                yield from pairs(own)
        held = []
        yield from pairs(member)
    for own in held:
        if own.sought:
            yield from pairs(own)


def _by_trie(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) of each (gram, block): rows (gram, block, id, label, n, rest, first, tail, entered, sought)."""
    own = ("gram", "block", "id", "label", "n", "rest", "first", "tail", "entered", "sought")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in own), strict=True))
        for (gram, _), group in itertools.groupby(rows, key=lambda r: r[:2]):
            yield from _linked((Member(*row[2:]) for row in group), gram, num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = found(batches)
        while some := list(itertools.islice(pairs, 10_000)):
            a, b = zip(*dict.fromkeys(some), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ordered = groups.repartition("gram", "block").sortWithinPartitions("gram", "block", F.desc("entered"))
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")).hint("merge"), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")).hint("merge"), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where((num + den) * shared >= num * (F.size("ga") + F.size("gb"))).select("a", "b")


def _without(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs that have not been verified yet."""
    return pairs.join(known.hint("merge"), ["a", "b"], "left_anti")


def similar_sets(spark: SparkSession, docs: DataFrame, num: int = NUM, den: int = DEN, size: int = GRAM, tail: int = TAIL, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Two texts link if den * intersection >= num * union of their sets of n-grams of ``size`` words (of the whole sequence where
    there are fewer words); component_id is the least doc_id that links lead to. Texts without a word are linked with nothing.
    Rows that share a doc_id are one document with several texts: they are in one component. Rows without a doc_id are classified
    as the others; a component without any id has null.
    """
    small_arrow_batches(spark)
    scratch = Scratch(spark, "triejoin")
    weights = word_weights(docs, scratch)
    made = scratch.keep(ordered_sets(spark, docs, weights, False, num, den, size), "sketches")
    table = scratch.keep(made.select("doc_id", "n", "k1", "k2"), "ids")
    filled = table.where(F.col("n") > 0)
    nodes = made.where(F.col("n") > 0).groupBy("k1", "k2").agg(F.min("doc_id").alias("named"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("grams").alias("grams"))
    sketched = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "sketched")
    scratch.drop("sketches")
    nodes = scratch.keep(sketched.drop("grams"), "nodes")

    # A node of which too many n-grams stand in no other set has no similar set.
    stored = sketched.select("node", told_length(F.col("n"), num, den).alias("told"), F.posexplode("grams").alias("place", "gram")).select("gram", "node", (F.col("place") < F.col("told")).alias("told"))
    alone = stored.groupBy("gram").agg(F.count("*").alias("df"), F.min("node").alias("node"), F.max("told").alias("told")).where((F.col("df") == 1) & F.col("told"))
    lonely = alone.groupBy("node").agg(F.count("*").alias("alone")).join(sketched.select("node", "n").hint("merge"), "node").where(F.col("alone") > lacking(F.col("n"), num, den)).select("node")
    left = scratch.keep(sketched.join(lonely.hint("merge"), "node", "left_anti").select("node", "n", F.slice("grams", F.lit(1), (lacking(F.col("n"), num, den) + 1).cast("int")).alias("grams")), "left")

    # Places of each prefix n-gram; those of one node alone link nothing.
    each = scratch.keep(left.select("node", "n", F.posexplode("grams").alias("place", "gram")), "each")
    counted = scratch.keep(each.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") > 1), "df")
    n_each = counted.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    shared = scratch.keep(join_counted(each, counted.select("gram", "df"), ["gram"], "df", n_each), "shared")
    central = shared.groupBy("node").agg(F.sum("df").alias("met"))
    pivots = shared.join(central.hint("merge"), "node").groupBy("gram", "df").agg(F.max_by(F.struct("node", "n"), F.struct("met", -F.col("node"))).alias("pivot"))
    pivots = scratch.keep(pivots, "pivots")
    long_enough = (den * F.least("n", "pivot.n") >= num * F.greatest("n", "pivot.n")) & (F.col("node") != F.col("pivot.node"))
    pairs = join_counted(shared.select("gram", "node", "n"), pivots, ["gram"], "df", n_each).where(long_enough).select(F.greatest("node", "pivot.node").alias("a"), F.least("node", "pivot.node").alias("b"))
    pairs = scratch.keep(pairs.distinct(), "pairs")

    # Whole sets of the nodes that share something, from the first of their texts.
    involved = nodes.join(shared.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "k1", "k2", F.coalesce("named", F.lit(NO_ID)).alias("doc_id"))
    involved = scratch.keep(involved, "involved")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    few = involved.count() <= BROADCAST_ROWS
    if few:  # else all texts are read again
        own = own.join(F.broadcast(involved.select("doc_id").distinct()), "doc_id", "left_semi")
    again = ordered_sets(spark, own, weights, True, num, den, size)
    again = again.join(F.broadcast(involved) if few else involved.hint("merge"), ["k1", "k2", "doc_id"])
    sets = scratch.keep(again.select("node", "grams").dropDuplicates(["node"]), "sets")
    links = scratch.keep(_verified(pairs, sets, num, den), "links")
    labels = scratch.keep(components(links, scratch, "star"), "labels")
    scratch.drop("star", "each", "df", "left", "sketched")

    by_place = Window.partitionBy("node").orderBy("place")
    named = shared.withColumn("first", F.first("gram").over(by_place)).join(labels.hint("merge"), "node", "left")
    named = scratch.keep(named.select("gram", "node", "n", "place", "first", F.coalesce("label", "node").alias("label")), "named")
    # Groups of several components, but for those whose members all meet in another n-gram's group.
    of_label = named.groupBy("gram", "label").agg(F.count("*").alias("c"), F.min("first").alias("lo"), F.max("first").alias("hi"))
    mixed = of_label.groupBy("gram").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"), F.sum("c").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mixed = scratch.keep(mixed.where((F.col("labels") > 1) & ((F.col("lo") != F.col("hi")) | (F.col("lo") == F.col("gram")))).drop("lo", "hi"), "mixed")
    n_mixed = mixed.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    if n_mixed:
        open_ = join_counted(named, mixed, ["gram"], "rows", n_mixed)
        rest = (F.col("n") - F.col("place")).alias("rest")
        open_ = open_.join(sets.hint("merge"), "node").select("gram", F.col("node").alias("id"), "label", "main", "n", "rows", rest, "first", F.slice("grams", F.col("place") + 2, F.lit(tail)).alias("tail"))
        # Every member stands in the tree of one block; those that aren't of the commonest label are sought in all blocks.
        blocks = F.ceil(F.col("rows") / block).cast("long")
        own = F.pmod(F.xxhash64("id"), blocks)
        met = F.when(F.col("label") == F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
        dealt = open_.select("gram", "id", "label", "n", "rest", "first", "tail", own.alias("own"), (F.col("label") != F.col("main")).alias("sought"), F.explode(met).alias("block")).withColumn("entered", F.col("own") == F.col("block"))
        more = _without(_by_trie(dealt, num, den), pairs)
        found = scratch.keep(_verified(more, sets, num, den), "more-links")
        if found.take(1):
            links = links.unionByName(found)
    # Rows of one id are linked by it.
    owners = filled.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi")).where(F.col("lo") != F.col("hi")).select("doc_id").limit(1).count()
    if owners:
        same = filled.join(nodes.select("k1", "k2", "node").hint("merge"), ["k1", "k2"]).where(F.col("doc_id").isNotNull()).select("doc_id", "node").distinct()
        first = Window.partitionBy("doc_id")
        links = links.unionByName(same.select(F.col("node").alias("a"), F.min("node").over(first).alias("b")).where(F.col("a") != F.col("b")))
    if n_mixed or owners:
        labels = scratch.keep(components(scratch.keep(links, "all-links"), scratch, "all"), "all-labels")

    linked = scratch.keep(nodes.select("node", "k1", "k2", "named", "copies").join(labels.hint("merge"), "node", "left").select("k1", "k2", "named", "copies", F.coalesce("label", "node").alias("label")), "linked")
    least = scratch.keep(linked.groupBy("label").agg(F.min("named").alias("component_id"), F.count("*").alias("rows")), "least")
    total = least.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    of_node = scratch.keep(join_counted(linked, least, ["label"], "rows", total).select("k1", "k2", "copies", "component_id"), "classes")
    n_rows = of_node.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    alone = table.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = join_counted(filled.select("doc_id", "n", "k1", "k2"), of_node, ["k1", "k2"], "copies", n_rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    scratch.drop(*(set(scratch.names()) - {"ids", "classes"}))
    return out.unionByName(alone)


def oracle() -> str:
    """DuckDB SQL for the query's rows: sets once each, exact Jaccard over shared n-grams, components by least reachable id."""
    return r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS grams FROM worded
), nodes AS (
    SELECT min(doc_id) AS node, grams, len(grams) AS n FROM sets WHERE len(grams) > 0 GROUP BY grams
), each AS (
    SELECT node, n, unnest(grams) AS gram FROM nodes
), shared AS (
    SELECT a.node AS a, b.node AS b FROM each a JOIN each b ON a.gram = b.gram AND a.node <> b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.node, b.node, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)
), reach AS (
    SELECT node, node AS seen FROM nodes
    UNION SELECT reach.node, shared.b FROM reach JOIN shared ON reach.seen = shared.a
), least_of AS (
    SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT sets.doc_id, CAST(len(sets.grams) AS BIGINT) AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN nodes ON sets.grams = nodes.grams LEFT JOIN least_of ON nodes.node = least_of.node
"""
