"""The learned reranker: features, preparation, logistic regression and its evaluation."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.config import Retrieval
from palimpsest.functions.times import days_between
from palimpsest.operators import quantiles
from palimpsest.operators.ranking import block_order, minmax, order_by_score, rerank

#: Of our own: feature, whether it is a number that is imputed and scaled, and the column or expression of a candidate that gives it.
FEATURES: tuple[tuple[str, bool, str], ...] = (
    ("score_scaled", True, "score_scaled"),
    ("prior_rank", True, "prior_rank"),
    ("pair_score", True, "pair_score"),
    ("age_days", True, "age_days"),
    ("newer_in_chain", True, "newer_count"),
    ("days_to_newest", True, "days_to_newest"),
    ("place_in_chain", True, "position"),
    ("superseded", False, "superseded"),
    ("from_censored", False, "valid_from_censored"),
    ("entity_matches", False, "entity = q_entity"),
    ("source_matches", False, "source = q_source"),
    ("version_matches", False, "version = q_version"),
    ("differs_from_newest", False, "differs_from_newest"),
)
#: What the rule itself says of a candidate; a model may be asked to do without it.
OF_THE_RULE = "superseded"


def chain_features(candidates: DataFrame, rows: DataFrame, chain: list[str], observed: str, id_: str, value: str, at: str, keys: list[str]) -> DataFrame:
    """Adds how a candidate stands in what is visible of its chain: newer_count, position, days_to_newest, differs_from_newest and newest_id.

    Places and counts are running sums along the chain, looked up by instant: no row meets the others of its chain. position is
    1 plus the number of rows before it by (observed, id); a candidate of a chain without a visible row is left out.
    """
    base = rows.select(*chain, F.col(observed).alias("__t"), F.col(id_).alias("__i"), F.col(value).alias("__v"))
    by = Window.partitionBy(*chain)
    own = candidates.select(*chain, F.col(observed).alias("__t"), F.col(id_).alias("__i"), F.lit(0).cast("long").alias("one")).distinct()
    places = base.select(*chain, "__t", "__i", F.lit(1).cast("long").alias("one")).unionByName(own).groupBy(*chain, "__t", "__i").agg(F.sum("one").alias("one"))
    before = F.coalesce(F.sum("one").over(by.orderBy("__t", "__i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = places.select(*chain, F.col("__t").alias(observed), F.col("__i").alias(id_), before.alias("__before"), F.sum("one").over(by.orderBy("__t")).alias("__upto"))
    asked = candidates.select(*chain, F.col(at).alias("__t")).distinct()
    instants = base.groupBy(*chain, "__t").agg(F.count("*").alias("n"), F.max(F.struct("__t", "__i", "__v")).alias("last"))
    instants = instants.unionByName(asked.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True).groupBy(*chain, "__t").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    so_far = by.orderBy("__t")
    seen = instants.select(*chain, F.col("__t").alias(at), F.sum("n").over(so_far).alias("__seen"), F.last("last", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0)).alias("__n"))
    both = candidates.join(places, [*chain, observed, id_]).join(seen, [*chain, at]).where(F.col("__n").isNotNull())
    newer = F.greatest(F.col("__seen") - F.col("__upto"), F.lit(0))
    added = {
        "newer_count": newer,
        "position": F.col("__before") + 1,
        "days_to_newest": F.when(newer > 0, days_between(F.col("__n.__t"), F.col(observed))).otherwise(F.lit(0.0)),
        "differs_from_newest": F.col("__n.__v") != F.col(value),
        "newest_id": F.col("__n.__i"),
    }
    return both.select(*candidates.columns, *[c.alias(name) for name, c in added.items()])


def chain_features_within(candidates: DataFrame, query: list[str], chain: list[str], observed: str, id_: str, value: str) -> DataFrame:
    """``chain_features`` of candidates that are all that their question (told by ``query``) sees: of every chain among them all visible rows.

    Windows within a question; where candidates are dealt by a part of ``query``, as ``pit.asof_cells`` leaves them, nothing is shuffled.
    """
    by = Window.partitionBy(*query, *chain)
    order = by.orderBy(observed, id_)
    last = F.max(F.struct(F.col(observed).alias("t"), F.col(id_).alias("i"), F.col(value).alias("v"))).over(by)
    told = candidates.withColumns({"__n": last, "position": F.row_number().over(order).cast("long"), "newer_count": F.count("*").over(by) - F.count("*").over(by.orderBy(observed))})
    days = F.when(F.col("newer_count") > 0, days_between(F.col("__n.t"), F.col(observed))).otherwise(F.lit(0.0))
    return told.withColumns({"days_to_newest": days, "differs_from_newest": F.col("__n.v") != F.col(value), "newest_id": F.col("__n.i")}).drop("__n")


def feature_table(candidates: DataFrame, sources: list[str], templates: list[str] | None = None, with_rule: bool = True) -> tuple[DataFrame, list[str], list[str]]:
    """(candidates with a column for each feature, all features in order, those to be imputed and scaled).

    Features come from FEATURES as far as the candidates have the columns, then one for each template of a question (column
    template) and for each source group (column source). A flag that is not known counts as no.
    """
    given, made, numeric = set(candidates.columns), {}, []
    for name, scaled, expression in FEATURES:
        if {w for w in expression.replace("=", " ").split()} <= given and (with_rule or name != OF_THE_RULE):
            value = F.expr(expression).cast("double")
            made[f"f_{name}"] = value if scaled else F.coalesce(value, F.lit(0.0))
            numeric += [f"f_{name}"] if scaled else []
    if templates:
        made |= one_hot(F.col("template"), sorted(templates), "f_template")
    made |= one_hot(F.col("source"), sorted(sources), "f_source")
    return candidates.withColumns(made), list(made), numeric


def top_sources(queries: DataFrame, key: str = "source_key", k: int = 6) -> list[str]:
    """The k commonest sources of the training queries; of equally common ones those first in order."""
    return [r[0] for r in queries.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k).collect()]


def one_hot(column: Column, names: list[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{n}": F.coalesce(column == n, F.lit(False)).cast("double") for n in names}


def fit_preparation(train: DataFrame, numeric: list[str]) -> dict[str, tuple[float, float, float]]:
    """name -> (median, mean, deviation) on the training rows: NaN and null are missing, a deviation of 0 counts as 1. ``train`` is read a few times; store what is costly."""
    clean = train.select(*[F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in numeric])
    medians = quantiles.interpolated(clean, numeric)
    filled = clean.select(*[F.coalesce(c, F.lit(float(medians[c] or 0.0))).alias(c) for c in numeric])
    stats = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first()
    return {c: (float(medians[c] or 0.0), float(stats[f"m_{c}"] or 0.0), float(stats[f"s_{c}"] or 1.0)) for c in numeric}


def prepare(rows: DataFrame, preparation: dict[str, tuple[float, float, float]]) -> DataFrame:
    fill = lambda c, p: (F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))), F.lit(p[0])) - F.lit(p[1])) / F.lit(p[2])
    return rows.withColumns({c: fill(c, p) for c, p in preparation.items()})


@dataclass(frozen=True)
class Logistic:
    """A logistic regression: its intercept and a weight for each feature."""

    intercept: float
    weights: tuple[float, ...]


def fit(train: DataFrame, features: list[str], label: str = "label", c: float = 1.0) -> Logistic:
    """L2 logistic regression with inverse strength c; the intercept is not penalised."""
    return fit_all(train, features, label, (c,))[0]


#: Steps of Newton's method, and the change of a weight that ends it.
STEPS, SMALL = 100, 1e-9


def fit_all(train: DataFrame, features: list[str], label: str, strengths: tuple[float, ...]) -> list[Logistic]:
    """A model for each inverse strength, by Newton's method: a pass over the rows is a step of all models.

    A task hands on a sum of losses, a gradient and a matrix for each model, whatever its rows. A step that makes the loss greater is halved. Where all labels are the
    same the intercept is infinite.
    """
    d = len(features) + 1
    rows = train.select(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"))

    def sums(points: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray, float, float]]:
        def run(batches):
            total = [[0.0, np.zeros(d), np.zeros((d, d))] for _ in points]
            n = ones = 0.0
            for pdf in batches:
                y = pdf["y"].to_numpy()
                x = np.column_stack([np.ones(len(y)), pdf.drop(columns="y").to_numpy(dtype=float)])
                n, ones = n + len(y), ones + y.sum()
                for t, w in zip(total, points):
                    z = x @ w
                    p = 0.5 * (1 + np.tanh(0.5 * z))
                    t[0] += float((np.logaddexp(0, z) - y * z).sum())
                    t[1] += x.T @ (p - y)
                    t[2] += (x * (p * (1 - p))[:, None]).T @ x
            yield pd.DataFrame({"model": range(len(points)), "loss": [t[0] for t in total], "gradient": [t[1] for t in total], "matrix": [t[2].ravel() for t in total], "n": n, "ones": ones})

        kinds = "model int, loss double, gradient array<double>, matrix array<double>, n double, ones double"
        found = [[0.0, np.zeros(d), np.zeros((d, d)), 0.0, 0.0] for _ in points]
        for r in rows.mapInPandas(run, kinds).collect():  # a row for each task and model
            f = found[r["model"]]
            for i, v in enumerate((r["loss"], np.array(r["gradient"]), np.array(r["matrix"]).reshape(d, d), r["n"], r["ones"])):
                f[i] = f[i] + v
        return [tuple(f) for f in found]

    mask = np.array([0.0] + [1.0] * (d - 1))
    best: list[np.ndarray] = [np.zeros(d) for _ in strengths]
    loss, step, done = [math.inf] * len(strengths), [np.zeros(d) for _ in strengths], [False] * len(strengths)
    for _ in range(STEPS):
        todo = [i for i, is_done in enumerate(done) if not is_done]
        if not todo:
            break
        for i, (value, gradient, matrix, n, ones) in zip(todo, sums([best[i] + step[i] for i in todo])):
            if n and ones in (0.0, n):
                best[i], step[i], done[i] = np.array([math.inf if ones else -math.inf] + [0.0] * (d - 1)), np.zeros(d), True
                continue
            at = best[i] + step[i]
            value += 0.5 / strengths[i] * float(mask @ (at * at))
            if value > loss[i] * (1 + 1e-12):
                step[i] = step[i] / 2
                done[i] = bool(np.abs(step[i]).max() < SMALL)
                continue
            best[i], loss[i] = at, value
            step[i] = -np.linalg.lstsq(matrix + np.diag(mask / strengths[i]), gradient + mask * at / strengths[i], rcond=None)[0]
            done[i] = bool(np.abs(step[i]).max() < SMALL)
    return [Logistic(float(w[0]), tuple(map(float, w[1:]))) for w in best]


def select_c(train: DataFrame, dev: DataFrame, features: list[str], grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0), label: str = "label") -> tuple[float, Logistic, list[tuple[float, float]]]:
    """(c, its model, log loss of each c on ``dev``): the strength that does best there; of equally good ones the smallest."""
    models = fit_all(train, features, label, tuple(grid))
    inside = [F.least(F.greatest(_probability(m, features), F.lit(1e-15)), F.lit(1 - 1e-15)) for m in models]
    losses = dev.agg(*[(-F.avg(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))).alias(f"l{i}") for i, p in enumerate(inside)]).first()
    tried = [(round(float("inf") if losses[i] is None else losses[i], 9), c, m) for i, (c, m) in enumerate(zip(grid, models))]
    best = min(tried, key=lambda x: x[:2])
    return best[1], best[2], [(c, loss) for loss, c, _ in tried]


def _probability(model: Logistic, features: list[str]) -> Column:
    linear = F.lit(model.intercept)
    for name, weight in zip(features, model.weights, strict=True):
        linear = linear + F.lit(weight) * F.col(f"`{name}`").cast("double")
    return 1 / (1 + F.exp(-linear))


def predict(rows: DataFrame, model: Logistic, features: list[str]) -> DataFrame:
    """Adds p: the probability of being current."""
    return rows.withColumn("p", _probability(model, features))


def rerank_learned(pool: DataFrame, on_target: Column, policy: str = "block", alpha: float = 1.0, seed: int = Retrieval.tie_seed, query: str | list[str] = "query_id") -> DataFrame:
    """Reorder by p, in the target chain only: "block" puts what is likely outdated behind, "alpha" shifts the scaled score."""
    if policy == "block":
        return block_order(pool, on_target & (F.col("p") < 0.5), "learned_block", query)
    shifted = minmax("score", query) + F.when(on_target, F.lit(alpha) * (F.col("p") - 0.5)).otherwise(F.lit(0.0))
    return rerank(pool.withColumns({"suppressed": on_target & (F.col("p") < 0.5), "score": shifted}), order_by_score(seed=seed), "learned_alpha", query)


def auc(rows: DataFrame, score: str = "p", label: str = "label", ranges: int = 256) -> DataFrame:
    """One row: area under the curve by rank sums, ties at their mean rank; null with one class only.

    Scores are counted first. Distinct scores are dealt into ``ranges`` by approximate quantiles; each range is counted up by itself, and only
    the ranges' totals are summed up in one task.
    """
    counts = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).where(F.col("s").isNotNull())
    edges = sorted(set(counts.approxQuantile("s", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))  # fewer than ``ranges`` numbers
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("s"))) if edges else F.lit(0)
    dealt = counts.withColumn("part", part)
    totals = dealt.groupBy("part").agg(F.sum("n").alias("t"))
    below = totals.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = dealt.withColumn("within", within).join(F.broadcast(below), "part").withColumn("rank", F.col("below") + F.col("within") + (F.col("n") + 1) / 2.0)
    total = ranks.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    return total.select(F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2.0, F.col("pos") * F.col("neg")).alias("auc"))


def classification(rows: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """One row of the usual measures at 0.5; a ratio without cases is 0."""
    yes, said = F.col(label) == 1, F.col(p) >= 0.5
    c = rows.agg(F.count("*").alias("n"), F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"), F.count_if(~yes & ~said).alias("tn"))
    r = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall = r(tp, tp + fp), r(tp, tp + fn)
    return c.select(
        "n", "tp", "fp", "fn", "tn", r(tp + tn, F.col("n")).alias("accuracy"), ((recall + r(tn, tn + fp)) / 2).alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
    )


def probability_deciles(rows: DataFrame, p: str = "p") -> DataFrame:
    """(decile, n): the last one includes 1."""
    return rows.groupBy(F.least(F.floor(F.col(p) * 10), F.lit(9)).alias("decile")).agg(F.count("*").alias("n"))


def manifest_of(model: Logistic, features: list[str], preparation: dict[str, tuple[float, float, float]], c: float, policy: str = "block", alpha: float | None = None, **facts) -> dict:
    """All that scoring needs, and facts on how it came about, as plain values."""
    weights = dict(zip(features, model.weights, strict=True))
    return {"features": features, "preparation": {k: list(v) for k, v in preparation.items()}, "c": c, "intercept": float(model.intercept), "weights": weights, "policy": policy, "alpha": alpha, "facts": facts}


def _seal(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, default=str).encode()).hexdigest()


def lock(spark: SparkSession, manifest: dict, path: str) -> str:
    """Write a manifest with its hash to ``path``; one that is there already can't be replaced by another. Returns the hash."""
    seal = _seal(manifest)
    try:
        if unlock(spark, path)[1] == seal:
            return seal
        raise ValueError(f"{path} holds another manifest")
    except FileNotFoundError:
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True, default=str), seal)], "manifest string, seal string").coalesce(1).write.json(path)
    return seal


def unlock(spark: SparkSession, path: str) -> tuple[dict, str]:
    """(manifest, hash) from ``path``; an error if there is none, or if it isn't what was locked."""
    try:
        row = spark.read.schema("manifest string, seal string").json(path).first()
    except AnalysisException as error:
        raise FileNotFoundError(path) from error
    manifest = json.loads(row["manifest"]) if row else {}
    if not row or _seal(manifest) != row["seal"]:
        raise ValueError(f"the manifest at {path} was changed after it was locked")
    return manifest, row["seal"]


def open_test(spark: SparkSession, rows: DataFrame, path: str, role: str = "role", held_out: str = "test") -> tuple[DataFrame, dict]:
    """(the held-out rows, the manifest): only once a manifest is locked at ``path``."""
    manifest, _ = unlock(spark, path)
    return rows.where(F.col(role) == held_out), manifest


def score_by(rows: DataFrame, manifest: dict) -> DataFrame:
    """Adds p to rows with raw features, from a manifest alone: prepared as on the training rows, in plain expressions."""
    ready = prepare(rows, {k: tuple(v) for k, v in manifest["preparation"].items()})
    linear = F.lit(manifest["intercept"])
    for name, weight in manifest["weights"].items():
        linear = linear + F.lit(weight) * F.col(f"`{name}`").cast("double")
    return ready.withColumn("p", 1 / (1 + F.exp(-linear)))


def agreement(learned: DataFrame, rule: DataFrame, on_target: Column, by: list[str]) -> DataFrame:
    """By ``by``: how far a learned list only repeats a rule's. Both have query_id, evidence_id, rank and suppressed, ``learned`` also what ``by`` and ``on_target`` need.

    A question agrees in its decisions if both suppress the same candidates of the target chain, and in its list if every rank is the same.
    """
    other = rule.select("query_id", "evidence_id", F.col("suppressed").alias("__s"), F.col("rank").alias("__r"))
    both = learned.withColumn("__on", on_target).join(other, ["query_id", "evidence_id"])
    return agreement_of(both, by)


def agreement_of(both: DataFrame, by: list[str], query: list[str] | None = None) -> DataFrame:
    """``agreement`` of learned lists that have the rule's suppressed and rank as __s and __r, and whether they are of the target chain as __on."""
    per = both.groupBy(*(query or ["query_id"]), *by).agg(
        F.count("*").alias("candidates"), F.count_if(F.col("suppressed")).alias("by_model"), F.count_if(F.col("__s") & F.col("__on")).alias("by_rule"), F.count_if(F.col("suppressed") & F.col("__s") & F.col("__on")).alias("by_both"),
        F.max((F.col("__on") & (F.col("suppressed") != F.col("__s"))).cast("int")).alias("differs"), F.max((F.col("rank") != F.col("__r")).cast("int")).alias("moved"), F.count_if(F.col("suppressed") & ~F.col("__on")).alias("off_target"),
    )
    sums = [F.sum(c).alias(c) for c in ("candidates", "by_model", "by_rule", "by_both", "off_target")]
    return per.groupBy(*by).agg(F.count("*").alias("queries"), *sums, F.sum(1 - F.col("differs")).alias("same_decisions"), F.sum(1 - F.col("moved")).alias("same_lists"))
