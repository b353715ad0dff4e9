"""N-gram Jaccard join, whitening and lexical search, against plain versions."""

import collections
import fractions
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import lexical, triejoin, whitening
from palimpsest.llm.common import table
from tests.llm.conftest import PROSE

LOWER = {c: c + 32 for c in range(65, 91)}

# ---- n-gram Jaccard join


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def plain_join(rows):
    """(doc_id, size, least reachable id) by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if a and b and (same or 100 * len(a & b) >= 90 * len(a | b)):
                label[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def joined(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "k1", "node", "grams", "label", "component_id")})
    return sorted(map(tuple, triejoin.similar_sets(spark, docs, **settings).collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 1)] = [f"e{rng.randrange(50)}"] if rng.random() < 0.7 else []
    return " ".join(words)


@pytest.mark.parametrize("tail,block", [(32, 1000), (3, 4)])
def test_join_equals_all_pairs(spark, tail, block):
    """Chains of edits, so that components hang on links at the very threshold, and several components share rare n-grams."""
    rng = random.Random(tail)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice((9, 14, 40, 90, 200)))]
        rows.append(" ".join(words))
        for _ in range(rng.randint(1, 14)):
            rows.append(edited(rng, rng.choice([words, rows[-1].split()]), rng.randint(0, 4)))
    rows += [rng.choice(rows) for _ in range(30)] + [PROSE, PROSE.upper(), PROSE + " x", "a b", "A\tb ", "b a", "a", "", " \n", None, "Ä b c", "ä b c"]
    rng.shuffle(rows)
    rows = [(i * 7, t) for i, t in enumerate(rows)]
    assert joined(spark, rows, tail=tail, block=block) == plain_join(rows)


def test_trie_finds_what_pivots_miss(spark, monkeypatch):
    """With pairs of pivots left out everything hangs on the tree; with its result left out links are lost."""
    rng = random.Random(8)
    rows = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(120)]
        rows += [edited(rng, words, 1) for _ in range(12)]
    rows = list(enumerate(rows))
    want = plain_join(rows)
    verified, calls = triejoin._verified, []

    def second_time(pairs, *others):
        calls.append(pairs)
        return verified(pairs if len(calls) > 1 else pairs.where("a < 0"), *others)

    monkeypatch.setattr(triejoin, "_verified", second_time)
    monkeypatch.setattr(triejoin, "_without", lambda more, pairs: more)
    assert joined(spark, rows, block=5) == want
    monkeypatch.setattr(triejoin, "_by_trie", lambda groups, *a: groups.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    calls.clear()
    assert joined(spark, rows, block=5) != want


@pytest.mark.parametrize("tail", [2, 8, 64])
def test_tree_loses_nothing_and_prunes(tail):
    rng = random.Random(tail)
    base = [sorted(rng.sample(range(400), 60)) for _ in range(5)]
    sets = [sorted((set(b) - set(rng.sample(b, rng.randint(0, 4)))) | set(rng.sample(range(400), rng.randint(0, 4)))) for b in base for _ in range(20)]
    found, surely = set(), set()
    for common in range(400):
        members = [triejoin.Member(i, i, len(s), len(s) - s.index(common), s[0], s[s.index(common) + 1 :][:tail]) for i, s in enumerate(sets) if common in s]
        tree = triejoin.Tree([])
        for m in members:
            tree.add(m)
        assert len({m.id for m in members}) == len(members)
        for m in members:
            for other, sure in tree.find(m, common, 90, 100):
                assert other.id != m.id and (other.first != m.first or m.first == common)
                found.add((m.id, other.id))
                if sure:
                    surely.add((m.id, other.id))
    similar = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * len(set(a) & set(b)) >= 90 * len(set(a) | set(b))}
    assert similar <= found and surely <= similar and len(similar) > 100
    if tail == 64:  # whole sets: what is found is similar, and known to be
        assert similar == found == surely


def test_one_sure_link_joins_two_labels():
    """Of two components in one group one pair comes out; without whole tails all come out, to be verified."""
    s = list(range(40))
    members = lambda tail: iter([triejoin.Member(i, i % 2, 40, 40, 0, s[1 : 1 + tail]) for i in range(10)])
    assert len(list(triejoin._linked(members(64), 0, 90, 100))) == 1
    assert len({p for p in triejoin._linked(members(5), 0, 90, 100)}) == 25
    assert list(triejoin._linked(iter([m._replace(first=7) for m in members(64)]), 0, 90, 100)) == []


@pytest.mark.parametrize("num", [60, 80, 90, 97])
def test_what_is_stored_holds_all_that_similar_sets_look_at(num):
    rng = random.Random(num)
    for _ in range(3000):
        x = set(rng.sample(range(10_000), rng.randint(1, 120)))
        y = (x - set(rng.sample(sorted(x), rng.randint(0, triejoin.lacking(len(x), num))))) | set(rng.sample(range(10_000), rng.choice((0, 0, 1, 3, 9))))
        if 100 * len(x & y) >= num * len(x | y):
            for a, b in ((x, y), (y, x)):
                looked = sorted(a)[: triejoin.told_length(len(a), num)]
                assert len(a - b) <= triejoin.lacking(len(a), num)
                assert set(looked) & b <= set(sorted(b)[: triejoin.stored_length(len(b), num)])


def test_join_of_messy_rows(spark, messy, nothing):
    assert sorted(map(tuple, triejoin.similar_sets(spark, messy).collect()), key=str) == plain_join([(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()])
    assert triejoin.similar_sets(spark, nothing).collect() == []
    assert triejoin.similar_sets(spark, spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect() == [(1, 0, 1), (2, 0, 2)]


def test_large_group_of_copies_and_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(words)) for i in range(300)] + [(1000 + i, edited(rng, words, 1)) for i in range(300)] + [(5000 + i, f"alone {i} {PROSE} {rng.random()}") for i in range(20)]
    assert joined(spark, rows, block=50) == plain_join(rows)


# ---- whitening


def plain_scatter(rows):
    """n, S and n·XᵀX - SSᵀ in fractions."""
    x = [[math.floor(64 * fractions.Fraction(float(c))) + 1_000_000 for c in r] for r in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return x, s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def usable(rows):
    return [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


@pytest.mark.parametrize("scale", [1.0, 3e9])
def test_whitening_equals_fractions(spark, scale):
    rng = np.random.default_rng(4)
    data = (rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) * scale + 5 * scale).tolist()
    rows = list(enumerate(data)) + [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (905, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("n", "d", "component", "i", "deviation")}).repartition(3)
    got = whitening.whiten(spark, frame, 4).collect()
    x, s, c = plain_scatter(data)
    n = len(data)
    v = np.array([[float(fractions.Fraction(a, n * n)) for a in r] for r in c])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * n and {r["n"] for r in got} == {n}
    by = {(r["vec_id"], r["component"]): r for r in got}
    signs = None
    for i, row in enumerate(x):
        assert int(by[i, 1]["deviation"]) == sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True))
        centred = np.array([float(a - fractions.Fraction(b, n)) for a, b in zip(row, s, strict=True)])
        want = centred @ vectors[:, :4] / np.sqrt(values[:4])
        have = np.array([by[i, k]["whitened"] for k in range(1, 5)])
        signs = np.sign(want * have) if signs is None else signs
        assert have == pytest.approx(want * signs, abs=1e-9)
    assert [by[0, k]["explained"] for k in range(1, 5)] == pytest.approx(values[:4] / np.trace(v), rel=1e-9)
    assert got[0]["identity_error"] < 1e-9


def test_scatter_is_exact_at_any_size():
    rng = random.Random(2)
    y = np.array([[rng.randint(-whitening.LARGEST, whitening.LARGEST) for _ in range(3)] for _ in range(5000)], np.int64)
    sums, cross = whitening.scatter(y)
    plain = y.astype(object)
    assert (sums == plain.sum(0)).all() and (cross == plain.T @ plain).all()
    assert whitening.integers(np.array([1e300, -1e300, -0.001, 0.5])).tolist() == [whitening.LARGEST, -whitening.LARGEST, -1, 32]
    for value in (0, 1, -1, 1 << 200, -(1 << 90) + 5):
        assert sum(d << (30 * p) for p, d in whitening._digits(value)) == value


def test_whitening_edges(spark):
    make = lambda rows: whitening.whiten(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    empty = make([(1, None), (2, [None])])
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = make([(1, [1.0, 2.0]), (1, [1.0, 2.0])]).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] == 0.0 and r["deviation"] == 0 for r in one)
    flat = make([(None, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [0.0, 5.0])]).collect()
    assert [r["whitened"] is None for r in flat] == [False, True] * 3 and sum(r["vec_id"] is None for r in flat) == 2
    assert make([(i, [float(i)] * 3) for i in range(3)] + [(9, [1.0])] * 2).count() == 9


def test_whitening_of_the_table(spark, sf):
    data = table(spark, sf, "embeddings").toPandas()
    from palimpsest.llm.queries import op12_embedding_whitening

    frame = op12_embedding_whitening(spark, sf)
    assert dict(frame.dtypes)["deviation"] == "bigint"
    got = frame.toPandas()
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert w.shape == (len(data), 32) and np.abs(w.T @ w / len(w) - np.eye(32)).max() < 1e-9 and got["identity_error"].nunique() == 1


# ---- lexical search


def plain_search(docs, items, top):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counted = [(d, collections.Counter(find(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(find(t))
    out = []
    for i, wanted in asked.items():
        scores = []
        for row, (d, c) in enumerate(counted):
            m = 100 - 90 + (90 * c.total() * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                scores.append((-score, d is None, d, row))
        out += [(i, r, d, -s) for r, (s, _, d, _) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_search_equals_a_plain_version(spark, broadcast_rows):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(60)] + ["Straße", "ÉA", "x_y", "a-B", "日本", "the"]
    make = lambda n: " ".join(rng.choice(vocabulary) if rng.random() < 0.8 else "the" for _ in range(n))
    docs = [(i, make(rng.randint(0, 40))) for i in range(200)] + [(500, None), (501, ""), (502, "!!"), (7, "t1 t1"), (503, "t5"), (504, "t5"), (505, "T5")]
    items = [(i, make(6)) for i in range(12)] + [(3, "t59 éa"), (90, None), (91, "unseen words"), (None, "t5 t5")]
    frames = [spark.createDataFrame(r, s).withColumns({c: F.lit(1) for c in ("row", "term", "tf", "n", "bucket", "w", "score", "rank")}) for r, s in ((docs, "doc_id long, text string"), (items, "item_id long, text string"))]
    got = lexical.search(spark, *frames, top=4, broadcast_rows=broadcast_rows).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(docs, items, 4)


def test_search_edges(spark, messy, nothing, sf):
    items = messy.withColumnRenamed("doc_id", "item_id")
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    assert sorted(map(tuple, lexical.search(spark, messy, items).collect()), key=str) == plain_search(rows, rows, 10)
    assert lexical.search(spark, nothing, items).collect() == [] and lexical.search(spark, messy, items.limit(0)).collect() == []
    assert lexical.terms("A-b_c É1") == [b"a", b"b", b"c", "É1".encode()]
