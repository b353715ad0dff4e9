"""Decontamination, line dedup, mixing, licences, near duplicates and the pipeline, against plain versions."""

import collections
import hashlib
import math
import pathlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import dartminhash as dart
from palimpsest.llm import decontam, licenses, linededup, mixing
from palimpsest.llm.common import Scratch, table
from palimpsest.llm.graph import components
from tests.llm.conftest import PROSE

VOCABULARY = [f"w{i}" for i in range(400)]


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


# ---- line dedup


def plain_dedup(rows, least=40, docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = collections.defaultdict(set)
    doc = lambda i, t: (0, xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63) & (1 << 64) - 1) if i is None else (1, i)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(doc(i, t))
    gone = {k: max(v) for k, v in held.items() if len(k) >= least and len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == doc(i, t)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (3, 3)])
def test_lines_equal_a_plain_version(spark, batches, fanout):
    rng = random.Random(batches)
    common = [f"{PROSE} {i}" for i in range(6)] + [PROSE.upper() + " É", "  " + PROSE + " 1\t", "short", "", "x" * 39, "y" * 40]
    rows = [(i, "\n".join(rng.choice([*common, f"unique line number {i} {rng.random()}"]) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(61, None), (62, ""), (62, common[0]), (63, "\n\n"), (None, common[0]), (None, common[1] + "\n" + common[0])]
    rows += [(None, "z" * 50 + f"\nrow {i}") for i in range(7)]  # a line of rows without an id
    rows += [(i, "\n".join([f"{PROSE} {k} of many" for k in range(150)] + ["", PROSE])) for i in range(70, 78)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("h1", "n_docs", "key", "__id", "__gone", "gone", "row", "doc", "kept")})
    got = linededup.dedup_lines(spark, docs, batches=batches, fanout=fanout)
    assert got.columns == [*docs.columns, "__lines", "__dropped"]
    assert sorted(((r["doc_id"], r["__lines"], r["__dropped"], r["text"] or "") for r in got.collect()), key=str) == plain_dedup(rows)


def test_line_runs_are_levelled(spark):
    runs = linededup.LineRuns(Scratch(spark, "t"), fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(True, b, k, 0) for k in (b, b + 1)], "owned boolean, doc long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    seen = [r["h1"] for run in runs.runs() for r in run.collect()]
    assert sorted(seen) == list(range(6))  # every line once
    assert {(r["h1"], r["n_docs"], r["keeper"]["doc"]) for r in runs.frequent(2).collect()} == {(k, 2, k) for k in range(1, 5)}


def test_line_runs_outlast_the_call(spark, tmp_path):
    """Two calls, the second from stored runs, give what one call over both batches gives the later documents."""
    rng = random.Random(31)
    common = [f"{PROSE} {i}" for i in range(8)]
    rows = [(i, "\n".join(rng.choice(common + [f"{PROSE} only {i}"]) for _ in range(4))) for i in range(40)]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    runs = linededup.LineRuns(Scratch(spark, "t"))
    linededup.dedup_lines(spark, frame(rows[:25]), batches=3, runs=runs)
    runs.save(str(tmp_path / "note"))
    again = linededup.LineRuns.load(Scratch(spark, "t"), str(tmp_path / "note"))
    got = linededup.dedup_lines(spark, frame(rows[25:]), batches=2, runs=again)
    assert sorted((r["doc_id"], r["__lines"], r["__dropped"], r["text"] or "") for r in got.collect()) == [r for r in plain_dedup(rows) if r[0] >= 25]


def test_runs_are_merged_without_another_exchange(spark):
    runs = linededup.LineRuns(Scratch(spark, "t"), fanout=9)
    rows = lambda b: spark.range(2000).select(F.lit(True).alias("owned"), F.lit(b).cast("long").alias("doc"), (F.col("id") * (b + 1)).alias("h1"), F.lit(0).cast("long").alias("h2"))
    for b in range(3):
        runs.add(rows(b))
    known = runs.runs()
    with linededup._sorted_buckets(spark):
        plan = known[2].join(known[0].select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti").join(known[1].select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Exchange" not in text and "Sort [" not in text


def test_lines_of_nothing(spark, nothing, messy):
    assert linededup.dedup_lines(spark, nothing).collect() == []
    assert linededup.dedup_lines(spark, messy).count() == messy.count()


# ---- decontamination


def test_windows_are_found_and_clean_texts_left(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(i, text(rng.randint(20, 80))) for i in range(30)] + [(90, "too few words here"), (91, None), (92, "")]
    rows, truth = [], {}
    for d in range(80):
        parts = [text(rng.randint(0, 60))]
        if d % 2:
            i, t = items[rng.randrange(30)]
            w = t.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "other"
            if d % 5 == 0:
                w.insert(len(w) // 2, "more")
            parts += [" ".join(w).upper(), text(10)]
        rows.append((d, " , ".join(parts)))
    for d, t in rows:
        s = shingles(t)
        for i, it in items:
            own = shingles(it)
            for a in range(len(s) - len(own) + 1 if own else 0):
                x, y = collections.Counter(s[a : a + len(own)]), collections.Counter(own)
                both = sum((x & y).values())
                j = both / (2 * len(own) - both)
                if j >= 0.8:
                    truth[d, i] = max(j, truth.get((d, i), 0))
    docs = spark.createDataFrame([*rows, (200, None), (201, ""), rows[1], (None, items[3][1])], "doc_id long, text string").withColumns({"item_id": F.lit(7), "n": F.lit(1), "window": F.lit("w")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    truth[None, 3] = 1.0
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(spark, docs, bench).collect()}
    assert set(got) == set(truth) and all(abs(got[k] - truth[k]) < 1e-9 for k in truth)
    spilled = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(spark, docs, bench, broadcast_rows=0).collect()}
    assert spilled == got


def test_items_cut_by_the_document_are_found(spark):
    rng = random.Random(13)
    w = [rng.choice(VOCABULARY) for _ in range(50)]
    other = [f"o{i}" for i in range(60)]
    rows = [(1, other + w[:45]), (2, w[5:] + other), (3, w[:-3]), (4, w[3:]), (5, w[4:-4]), (6, w[:30])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(w)), (8, " ".join(w[:40]))], "item_id long, text string")
    truth = {}
    for i, t in rows:
        for k, n in ((7, 50), (8, 40)):
            y, s = collections.Counter(shingles(" ".join(w[:n]))), shingles(" ".join(t))
            for a in range(max(1, len(t) - n + 1)):
                x = collections.Counter(s[a : a + n - 4])
                j = (x & y).total() / (x | y).total()
                if j >= 0.8:
                    truth[i, k] = max(truth.get((i, k), (0, 0)), (j, -a))
    assert {k for k in truth if k[1] == 7} >= {(1, 7), (2, 7), (3, 7), (4, 7), (5, 7)}
    for limit in (decontam.BROADCAST_ROWS, 0):
        got = {(r["doc_id"], r["item_id"]): (r["similarity"], -r["first_word"]) for r in decontam.contaminated(spark, docs, bench, broadcast_rows=limit).collect()}
        assert set(got) == set(truth) and all(got[k] == pytest.approx(truth[k]) for k in truth)


def plain_contamination(rows, items):
    """(document, item) to the best similarity of any window of the item's length, one word after the other."""
    truth = {}
    for d, text in rows:
        s = shingles(text)
        for i, item in items:
            own = collections.Counter(shingles(item))
            length = min(own.total(), len(s))
            for a in range(len(s) - length + 1 if length else 0):
                x = collections.Counter(s[a : a + length])
                j = (x & own).total() / (x | own).total()
                if j >= 0.8 - 1e-9:
                    truth[d, i] = max(j, truth.get((d, i), 0))
    return truth


def test_moved_and_changed_items_are_found(spark):
    """Rotations, moved sentences, insertions, deletions and items that share sentences, against all windows."""
    rng = random.Random(21)
    vocabulary = VOCABULARY[:120]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in (20, 60, 120, 200, 200)]
    items += [items[3][:150] + text(50), items[4][100:] + items[4][:100], items[1] + items[1][:30]]
    docs = []
    for w in items:
        n = len(w)
        for turn in (0.5, 0.25, 0.9):
            k = int(n * turn)
            docs.append(w[k:] + w[:k])
        for _ in range(6):
            cut = sorted(rng.sample(range(1, n), 3))
            parts = [w[a:b] for a, b in zip([0, *cut], [*cut, n])]
            i, j = rng.sample(range(4), 2)
            parts[i], parts[j] = parts[j], parts[i]
            docs.append(sum(parts, []))
        for most in (1, n // 30 + 1, n // 20 + 1, n // 12 + 1):
            x = list(w)
            for _ in range(most):
                at = rng.randrange(len(x))
                rng.choice([lambda: x.insert(at, "more"), lambda: x.pop(at), lambda: x.__setitem__(at, "other")])()
            docs.append(x)
    rows = [(i, " ".join(text(rng.randint(0, 30)) + w + text(rng.choice([0, 3, 40])))) for i, w in enumerate(docs)]
    named = [(i, " ".join(w)) for i, w in enumerate(items)]
    truth = plain_contamination(rows, named)
    assert len(truth) > 60 and any(j < 0.9 for j in truth.values())
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*named, (50, named[0][1]), (50, named[1][1]), (51, "one two")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(spark, docs, bench).collect()}
    exact = {k: j for k, j in got.items() if k[1] < 50}
    assert all(exact[k] == pytest.approx(truth[k]) for k in exact) and exact.keys() <= truth.keys()
    assert len(exact) >= 0.99 * len(truth)  # fingerprints farther apart than the radius, by chance
    assert {d for d, i in got if i == 50} == {d for d, i in got if i in (0, 1)}


def test_hamming_index_finds_everything_within_the_radius(spark):
    rng = random.Random(4)
    flips = collections.defaultdict(list)
    for r in decontam._flips(spark, decontam.RADIUS, decontam.BLOCKS).collect():
        flips[r["block"]].append(r["flip"])
    bounds = decontam.block_bounds(decontam.BLOCKS)
    assert sum(n for _, n in bounds) == 64
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, decontam.RADIUS)):
            b ^= 1 << bit
        cut = lambda x, k: x >> bounds[k][0] & (1 << bounds[k][1]) - 1
        assert any(cut(a, k) ^ f == cut(b, k) for k in range(decontam.BLOCKS) for f in flips[k])


def test_simhash_is_the_majority_of_bits(spark):
    rng = random.Random(6)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(9)] + [5, 5, 5]
    got = spark.createDataFrame([(values,)], "x array<long>").select(decontam.simhash("x")).first()[0]
    want = sum((1 << b) for b in range(64) if 2 * sum((v >> b) & 1 for v in values) > len(values))
    assert got % (1 << 64) == want


@pytest.mark.parametrize("broadcast_rows", [decontam.BROADCAST_ROWS, 0])
def test_short_items_are_found_where_their_words_stand_in_a_row(spark, broadcast_rows):
    rows = [(1, "Paris is a town"), (2, "the town of Paris, France"), (3, "Paris"), (4, "France of Paris"), (None, "town of paris"), (5, None), (6, "of, Paris! France; of Paris France")]
    items = [(1, "of Paris"), (2, "PARIS france"), (2, "paris"), (3, "the town of Paris"), (4, "unheard of"), (5, " "), (None, "town")]
    find = lambda t: re.findall(r"[a-z]+", (t or "").lower())
    truth = {}
    for d, t in rows:
        for i, it in items:
            w, own = find(t), find(it)
            for a in range(len(w) - len(own) + 1 if own else 0):
                if w[a : a + len(own)] == own:
                    truth[d, i] = min(a, truth.get((d, i), a))
    got = decontam.contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast_rows).collect()
    assert {(r["doc_id"], r["item_id"]): r["first_word"] for r in got} == truth and all(r["similarity"] == 1.0 for r in got)
    assert {r["doc_id"] for r in decontam.clean(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items[:1], "item_id long, text string")).collect()} == {1, 2, 3, 5} - {2}


def test_the_index_finds_the_items(spark, monkeypatch):
    """Without it there is nothing to verify; and an item is found through a window that another item of its length has laid."""
    rng = random.Random(41)
    w = [rng.choice(VOCABULARY) for _ in range(40)]
    items = [(1, " ".join(w)), (2, " ".join(w[:38] + ["x", "y"]))]
    docs = spark.createDataFrame([(i, " ".join([f"o{i}"] * (i % 7) + w)) for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontam.contaminated(spark, docs, bench).collect()) == 60
    one = decontam._anchors
    monkeypatch.setattr(decontam, "_anchors", lambda items, similarity: one(items, similarity).join(items.orderBy("t").limit(1), "t", "left_semi"))
    assert len(decontam.contaminated(spark, docs, bench).collect()) == 60
    flips = decontam._flips
    monkeypatch.setattr(decontam, "_flips", lambda *a: flips(*a).limit(0))
    assert decontam.contaminated(spark, docs, bench).collect() == []


def test_clean_rows_stay_whatever_their_ids(spark):
    rng = random.Random(23)
    item, other = (" ".join(rng.choice(VOCABULARY) for _ in range(40)) for _ in range(2))
    rows = [(None, item), (None, other), (3, f"x {item} y"), (3, other), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("__id", "d", "row", "t")})
    kept = decontam.clean(spark, docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[i] for i in (1, 3, 4, 5, 6)], key=str)


def test_decontamination_of_nothing(spark, messy, nothing, sf):
    bench = table(spark, sf, "benchmark")
    assert decontam.contaminated(spark, nothing, bench).collect() == []
    assert decontam.contaminated(spark, messy, bench.limit(0)).collect() == []
    assert decontam.contaminated(spark, messy, bench).collect() == []


# ---- mixing


def test_raking_fits_the_margins(spark):
    rng = random.Random(8)
    cells = [(s, g, t, rng.randint(1, 1000)) for s in "abc" for g in "xy" for t in "pq"]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    given = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}}
    rows = mixing.rake(df, Scratch(spark, "t"), rounds=30, given=given).collect()
    share = lambda name, v: sum(r["fitted"] for r in rows if r[name] == v)
    for name, target in given.items():
        for v, want in target.items():
            assert abs(share(name, v) - want) < 1e-6
    seen = {t: sum(c[3] for c in cells if c[2] == t) for t in "pq"}
    root = {t: math.sqrt(n) for t, n in seen.items()}
    assert abs(share("topic", "p") - root["p"] / sum(root.values())) < 1e-6


def test_mixing_edges(spark, messy, nothing):
    rows = mixing.mix(spark, messy).collect()
    assert len(rows) == messy.count() and all(0 <= r["probability"] <= 1 and r["tokens"] >= 1 for r in rows)
    assert mixing.mix(spark, nothing).collect() == []
    kept = mixing.sample(spark, messy)
    assert kept.columns == [*messy.columns, "probability"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["sampled"])
    assert max(r["probability"] for r in mixing.mix(spark, messy, fraction=None).collect()) == pytest.approx(1)
    clashing = messy.withColumns({c: F.lit(1) for c in ("__probability", "probability", "__source", "row")})
    assert mixing.sample(spark, clashing).columns == [*messy.columns, "__probability", "__source", "row", "probability"]


def test_sample_follows_the_probabilities(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 10 == 0, "s").otherwise("t").alias("source"), F.lit("en").alias("lang"))
    rows = mixing.mix(spark, docs, fraction=0.3).collect()
    for s in "st":
        own = [r for r in rows if r["source"] == s]
        assert abs(np.mean([r["sampled"] for r in own]) - own[0]["probability"]) < 0.05


def plain_targets(seen, fraction):
    """Square roots of what is seen, values that have too little for that taken whole, to the end."""
    total, full = sum(seen.values()), set()
    while True:
        free = 1 - sum(seen[v] / total / fraction for v in full)
        rest = sum(math.sqrt(n) for v, n in seen.items() if v not in full)
        want = {v: n / total / fraction if v in full else math.sqrt(n) * free / rest for v, n in seen.items()}
        more = {v for v, n in seen.items() if v not in full and fraction and want[v] > n / total / fraction}
        if not more:
            return want
        full |= more


@pytest.mark.parametrize("fraction", [None, 0.05, 0.2, 0.3])
def test_expected_margins_are_the_targets(spark, fraction):
    """On the driver's documents, whatever part is wanted, and by a topic column too."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    for by in (None, F.when(F.col("doc_id") % 3 == 0, "third").otherwise("other")):
        cells = mixing.mix(spark, docs, fraction=fraction, by=by).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("n"), F.first("probability").alias("p")).collect()
        assert max(r["p"] for r in cells) <= 1
        expected, total = sum(r["n"] * r["p"] for r in cells), sum(r["n"] for r in cells)
        assert fraction is None or expected == pytest.approx(fraction * total, rel=5e-3)
        for name in mixing.MARGINS:
            seen, got = collections.Counter(), collections.Counter()
            for r in cells:
                seen[r[name]] += r["n"]
                got[r[name]] += r["n"] * r["p"]
            want = plain_targets(seen, fraction or 1e-9)
            assert all(abs(got[v] / expected - want[v]) < 1e-3 for v in seen)


def test_pipeline_sample_has_the_target_margins(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randint(2, 9)) + rng.choice([""] * 9 + [" | "]), rng.choice("aaaaaaaab"), rng.choice(["en"] * 5 + ["de"])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    cell = lambda r: (r[2], r[3], "tabular" if " | " in r[1] else "prose")
    rates = {cell(r): r["probability"] for r in corpus_pipeline.mixing_stage(spark, docs, "").collect()}
    tokens = collections.Counter()
    for r in rows:
        tokens[cell(r)] += len(re.findall("[ \n]", r[1])) + 1
    assert set(rates) == set(tokens) and max(rates.values()) <= 1
    expected = sum(n * rates[c] for c, n in tokens.items())
    for k in range(3):
        seen, got = collections.Counter(), collections.Counter()
        for c, n in tokens.items():
            seen[c[k]] += n
            got[c[k]] += n * rates[c]
        want = plain_targets(seen, mixing.FRACTION)
        assert all(abs(got[v] / expected - want[v]) < 1e-3 for v in seen)


# ---- licences


def plain_numbers(piece):
    return [x for x in (licenses.SPELLINGS.get(w, w) for w in words(piece)) if x not in licenses.FUNCTION_WORDS]


def plain_best(run, t, least):
    """(is bare, rank, minus cosine, licence) of the best template of a list of words."""
    bag = collections.Counter(w for w in run if w in t.idf)
    weight = {w: (1 + math.log(n)) * t.idf[w] for w, n in bag.items()}
    norm = math.sqrt(sum(x * x for x in weight.values()) + t.unknown**2 * sum(w not in t.idf for w in run))
    found = []
    for spdx, vector, need in zip(t.spdx, t.vectors, t.needs):
        if need <= bag.keys():
            cosine = round(sum(x * vector.get(w, 0) for w, x in weight.items()) / norm, 9)
            found.append((spdx == licenses.BARE, -round(cosine + licenses.BONUS * len(need & licenses.VARIANTS), 9), -cosine, spdx))
    return min((x for x in found if x[2] <= -least), default=None)


def plain_own(text, t):
    """Every run of pieces that begins near a cue, and the whole text."""
    pieces = [x for x in (plain_numbers(p) for p in re.split(licenses.PIECES, text or "")) if x]
    cued = [bool(t.cues & set(p)) for p in pieces]
    found = []
    if any(cued):
        found.append((plain_best(sum(pieces, []), t, licenses.LEAST_FILE), "file"))
    for i in range(len(pieces)):
        if any(cued[i : i + licenses.LEAD + 1]):
            found += [(plain_best(sum(pieces[i : i + n], []), t, licenses.LEAST), "header") for n in licenses.RUNS]
    return min(((*x[:3], basis, x[3]) for x, basis in found if x), default=None)


def test_licences_equal_a_plain_version(spark):
    t = licenses.Templates()
    rng = random.Random(9)
    rows = []
    for i in range(160):
        lines = [" ".join(rng.choice(["the", "of", "and", "file", "work", "license", "rights", *VOCABULARY]) for _ in range(12)) for _ in range(rng.randint(0, 3))]
        if i % 3 == 0:
            notice = rng.choice(licenses.TEMPLATES)[2].split()
            if i % 2:
                notice[rng.randrange(len(notice))] = "else"
            wrap = rng.choice([8, 1000])
            lines.insert(rng.randint(0, len(lines)), "\n".join(" ".join(notice[k : k + wrap]) for k in range(0, len(notice), wrap)))
        rows.append((i, "\n".join(lines), f"r{i % 2}/d{i % 5}/{'LICENSE' if i % 10 == 0 else 'f'}{'.' if i % 10 == 0 else ''}{i}"))
    rows += [(200, None, "r0/x/y/z/1"), (201, "", None), (201, "", None), (202, "All rights reserved.", "lone"), (203, "words", "top/COPYING")]
    df = spark.createDataFrame(rows, "doc_id long, text string, where string").withColumns({"path": F.lit("p"), "dir": F.lit("d"), "license": F.lit("l"), "pieces": F.lit(1), "own": F.lit(2)})
    got = {r["doc_id"]: r for r in licenses.scan(spark, df, F.col("where")).collect()}
    assert len(got) == len({r[0] for r in rows})
    own, dirs = {}, {}
    for i, text, path in rows:
        best = plain_own(text, t)
        if best:
            own[i] = best
            if path and (best[3] == "file" or re.search(licenses.NAMES, path)):
                dirs.setdefault(path.rpartition("/")[0], []).append((best[2], best[4]))
    assert len(own) >= 30
    for i, text, path in rows:
        r = got[i]
        if i in own:
            assert (r["license"], round(r["similarity"], 6)) == (own[i][4], round(-own[i][2], 6)) and r["basis"] in ("header", "file")
            continue
        at = path.rpartition("/")[0] if path else None
        while at is not None and at not in dirs and at:
            at = at.rpartition("/")[0]
        want = min(dirs[at])[1] if at in dirs else None
        assert (r["license"], r["basis"]) == (want, "inherited" if want else "none"), (i, path)


def test_licence_cues_lose_nothing():
    t = licenses.Templates()
    assert all(t.cues & need for need in t.needs)  # a text without a cue lacks a word that each template asks for


#: Licence lines as other people write them, none of them a template.
IN_THE_WILD = (
    ("GPL-2.0", "This library is licensed under GPL v2"),
    ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later\nint main() {}"),
    ("GPL-2.0", "# it under the terms of the GNU General Public License version 2 as\n# published by the Free Software Foundation.\nx = 1"),
    ("LGPL-2.1", "GNU Lesser General Public License v2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("CC-BY-NC-ND-4.0", "The figures are licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-4.0", "This file is CC BY 4.0 licensed"),
    ("CC-BY-SA-3.0", "Content is available under the Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("MIT", "some prose first. This code is released under the MIT licence. And more prose follows it here"),
    ("Apache-2.0", "/* Copyright 2019 Some One\n * Licensed under the Apache License, Version 2.0\n */\nclass A {}"),
    ("Proprietary", "Copyright (c) 2020 Foo Bar. All rights reserved.\ncode here"),
    (None, "the license of the driver said nothing of rights"),
    (None, "All rights of man, and the copy of a source"),
    (None, "GNU General Public License"),
)


def test_licences_in_the_wild(spark):
    fsf = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU{} General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\n"
    code = "".join(f"\nx{i} = call(y{i})" for i in range(40))
    cases = [*IN_THE_WILD, ("GPL-3.0", fsf.format("", 3) + code), ("GPL-2.0", "import x\n" + fsf.format("", 2) + code), ("LGPL-3.0", fsf.format(" Lesser", 3) + code), ("AGPL-3.0", fsf.format(" Affero", 3) + code)]
    rows = [(i, text, f"p{i}/LICENSE") for i, (_, text) in enumerate(cases)] + [(100 + i, "words", f"p{i}/a") for i in range(len(cases))]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string, where string"), F.col("where")).collect()}
    assert [got[i] for i in range(len(cases))] == [spdx for spdx, _ in cases]
    assert [got[100 + i] for i in range(len(cases))] == [spdx for spdx, _ in cases]


#: Full texts as the system has them, and their licences.
SYSTEM_TEXTS = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


def test_full_texts_of_licences(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts here")
    texts = [(name, spdx, (folder / name).read_text()) for name, spdx in SYSTEM_TEXTS.items() if (folder / name).exists()]
    rows = [(i, text, f"{i}/LICENSE") for i, (_, _, text) in enumerate(texts)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string, where string"), F.col("where")).collect()}
    assert [got[i] for i in range(len(rows))] == [spdx for _, spdx, _ in texts]


def test_licences_of_nothing(spark, nothing, messy):
    assert licenses.scan(spark, nothing, F.col("source")).collect() == []
    assert licenses.scan(spark, messy, F.col("source")).count() == messy.select("doc_id").distinct().count()


# ---- near duplicates


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    k = 512
    for trial in range(6):
        a = {int(e): float(w) for e, w in zip(rng.integers(0, 1 << 62, 80), rng.integers(1, 5, 80) if trial < 4 else rng.uniform(0.2, 3, 80))}
        b = dict(list(a.items())[: 40 + 8 * trial]) | {int(e): 1.0 for e in rng.integers(0, 1 << 62, 20)}
        for e in list(b)[:10]:
            b[e] = b[e] * (2 if trial % 2 else 1)
        sets = [a, b]
        flat = [(e, w) for s in sets for e, w in sorted(s.items())]
        sig = dart.signatures(np.array([e for e, _ in flat], np.uint64), np.array([w for _, w in flat]), np.array([len(s) for s in sets]), k)
        keys = set(a) | set(b)
        want = sum(min(a.get(e, 0), b.get(e, 0)) for e in keys) / sum(max(a.get(e, 0), b.get(e, 0)) for e in keys)
        assert abs((sig[0] == sig[1]).mean() - want) < 0.1


def test_signature_does_not_depend_on_the_batch():
    rng = np.random.default_rng(5)
    sizes = np.array([0, 1, 3, 700, 0, 9000])
    e = rng.integers(0, 1 << 62, sizes.sum()).astype(np.uint64)
    w = np.ones(len(e))
    together = dart.signatures(e, w, sizes, 64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, n in enumerate(sizes):
        alone = dart.signatures(e[at[i] : at[i + 1]], w[: n], np.array([n]), 64)
        assert (alone[0] == together[i]).all()
    top = np.iinfo(np.uint64).max
    assert ((together == top).all(axis=1) == (sizes == 0)).all() and (together[sizes > 0] < top).all()


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "x").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "x").collect() == []


def plain_classes(rows):
    sets = collections.defaultdict(list)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    for i, t in rows:
        w = words(t)
        own = frozenset(shingles(t)) or (frozenset([tuple(w)]) if w else t or "")
        sets[own].append(i)
    for ids in sets.values():
        for i in ids:
            union(ids[0], i)
    each = [(s, ids[0]) for s, ids in sets.items() if isinstance(s, frozenset)]
    for n, (a, i) in enumerate(each):
        for b, j in each[:n]:
            both = len(a & b)
            if both >= 0.8 * (len(a) + len(b) - both) - 1e-9:
                union(i, j)
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("weighted", [False, True])
def test_classes_equal_a_plain_version(spark, weighted):
    rng = random.Random(11)
    rows = []
    for f in range(6):  # families of near copies, with edits around the threshold
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            rows.append(" ".join(w[: rng.choice([len(w)] * 3 + [len(w) - 3])]))
    shared = " ".join(rng.choice(VOCABULARY) for _ in range(40))
    rows += [shared + " " + " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(5, 40))) for _ in range(40)]
    rows += [rows[0]] * 5 + ["", "", None, "one", "One!", "two words", "??", "??", "!"]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "bands": F.lit(2), "node": F.lit(3)})
    got = {r["doc_id"]: r["class_id"] for r in dart.near_duplicates(spark, docs, weighted=weighted).collect()}
    assert got == plain_classes(rows)


def test_near_duplicates_edges(spark, messy, nothing):
    rows = dart.near_duplicates(spark, messy).collect()
    assert len(rows) == messy.count()
    got = collections.defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add(r["class_id"])
    assert got[1] == got[2] == {1} and got[5] == {5}
    assert got[3] == got[4] == {3}  # a null text counts as empty
    assert got[None] == {None, 3}  # one text with no id of its own, one equal to others
    assert dart.near_duplicates(spark, nothing).collect() == []


def test_texts_without_an_id_of_their_own(spark):
    """Null and repeated ids: every text is classified, and one row of each class stays."""
    rng = random.Random(15)
    a, b, c, d = (" ".join(rng.choice(VOCABULARY) for _ in range(80)) for _ in range(4))
    rows = [(None, a), (7, a), (None, b), (9, b), (9, c), (9, c), (None, c + " end"), (None, d), (None, d), (None, d.upper())]
    docs = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "doc_id long, text string, k1 int")
    classes = collections.Counter((r["doc_id"], r["class_id"]) for r in dart.near_duplicates(spark, docs).collect())
    assert classes == {(None, 7): 1, (7, 7): 1, (None, 9): 2, (9, 9): 3, (None, None): 3}
    kept = dart.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"].lower()) for r in kept.collect()), key=str) == sorted([(7, a), (9, b), (9, c), (None, d)], key=str)


def test_central_ties_and_hubs(spark):
    """A star of copies around one text, several texts equally central, and a chain between components."""
    base = [f"s{i}" for i in range(200)]
    rows = [" ".join(base)] + [" ".join(base[:i] + [f"e{i}"] + base[i + 1 :]) for i in range(0, 200, 2)]
    rows += [" ".join(base[k:] + [f"t{k}_{j}" for j in range(k)]) for k in (2, 4, 6, 8, 10, 12)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dart.near_duplicates(spark, docs).collect()}
    assert got == plain_classes(list(enumerate(rows)))


# ---- pipeline


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf, "documents")
    scratch = Scratch(spark, "t")
    now = scratch.keep(docs, "in")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.keep(stage(spark, now, sf), name)
        assert after.columns == docs.columns and 0 < after.count() <= now.count()
        if name == "line_dedup":
            assert after.count() == now.count() and after.where("n_chars <> length(text)").count() == 0
        now = after
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert last.columns == [*docs.columns, "probability"] and 0 < last.count() < now.count()
    assert not decontam.contaminated(spark, last, table(spark, sf, "benchmark")).take(1)
    classes = dart.near_duplicates(spark, now)
    assert classes.select("class_id").distinct().count() == now.count()
    again = corpus_pipeline.run(spark, sf)
    assert sorted(r["doc_id"] for r in again.collect()) == sorted(r["doc_id"] for r in last.collect())


def test_pipeline_stages_take_anything(spark, messy, nothing, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).collect() == [], name
        out = stage(spark, messy, sf)
        assert out.columns[: len(messy.columns)] == messy.columns
        n = out.count()
        assert n <= messy.count()
        if name in ("line_dedup", "benchmark_decontamination"):
            assert n == messy.count()


def test_kept_text_digest(spark, sf):
    from palimpsest.llm.queries import op3_line_dedup

    rows = {r["doc_id"]: r for r in op3_line_dedup(spark, sf).collect()}
    plain = plain_dedup([(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()])
    assert all((rows[i]["n_lines"], rows[i]["n_dropped"], rows[i]["kept_sha256"]) == (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain)
