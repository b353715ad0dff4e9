"""Cluster bootstrap, paired comparison and Holm's correction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.config import Statistics


def cluster_sums(values: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """(unit, by, total, n) over defined values."""
    return values.groupBy(unit, *by).agg(F.sum("value").alias("total"), F.count("value").alias("n"))


def hash_draw(replicate: Column, slot: Column, clusters: Column) -> Column:
    """Which cluster a slot of a replicate draws: portable to any SQL that has md5."""
    return F.conv(F.left(F.md5(F.concat_ws("|", replicate, slot).cast("binary")), F.lit(8)), 16, 10).cast("long") % clusters


#: Clusters whose sums may travel to every task.
MOST_CLUSTERS = 100_000


def bootstrap_by_hash(sums: DataFrame, unit: str, by: list[str], replicates: int, most: int = MOST_CLUSTERS) -> DataFrame:
    """(by, replicate, mean): clusters drawn with replacement, the same draws for every metric.

    Up to ``most`` clusters, their sums go to all tasks, a replicate is drawn within its row, and the means of a batch of replicates are
    products of how often each cluster is drawn and the sums: nothing is shuffled. More clusters are for ``bootstrap_by_poisson``.
    """
    clusters = sums.select(unit).distinct().count()
    if clusters > most:
        return bootstrap_by_poisson(sums, unit, by, replicates)
    groups, total, count = _matrices(sums, unit, by)
    schema = _schema(sums, by)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(max(clusters, 1) - 1)), lambda slot: hash_draw(F.col("replicate"), slot, F.lit(max(clusters, 1))).cast("int"))
    slices = max(1, min(replicates, sums.sparkSession.sparkContext.defaultParallelism))
    reps = sums.sparkSession.range(0, replicates, 1, slices).select(F.col("id").alias("replicate"))

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                times = np.stack([np.bincount(d, minlength=total.shape[1]) for d in part["draws"]]).astype(float)
                yield from _means(groups, by, part["replicate"].to_numpy(), times, total, count)

    return reps.select("replicate", drawn.alias("draws")).mapInPandas(run, schema)


def poisson_times(key: int, seed: int, replicates: int) -> np.ndarray:
    """How often one cluster counts in each replicate: Poisson numbers of mean 1, told by the cluster's hash alone."""
    return np.random.Generator(np.random.Philox(key=[seed & 0xFFFFFFFFFFFFFFFF, key & 0xFFFFFFFFFFFFFFFF])).poisson(1.0, replicates)


def bootstrap_by_poisson(sums: DataFrame, unit: str, by: list[str], replicates: int, seed: int = Statistics.seed, block: int = 1000) -> DataFrame:
    """(by, replicate, mean) of any number of clusters in one pass: the Poisson bootstrap.

    Instead of drawing a fixed number of clusters, each cluster counts a Poisson number of times in a replicate, the same for every
    metric; for many clusters the two have the same distribution of means. A cluster's weights are made where its sums lie, a task sums them up to one
    array for each metric and ``block`` replicates, and only these arrays are shuffled. Clusters of one hash share their weights; a replicate
    without any value has a mean of NaN.
    """
    keyed = sums.groupBy(unit).agg(F.collect_list(F.struct(*by, "total", "n")).alias("series")).select(F.xxhash64(unit).alias("key"), "series")
    kinds = ", ".join(f"{c} {k}" for c, k in sums.dtypes if c in by)

    def run(batches):
        totals: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, series in zip(pdf["key"], pdf["series"], strict=True):
                times = poisson_times(int(key), seed, replicates)
                for s in series:
                    group = tuple(s[c] for c in by)
                    if group not in totals:
                        totals[group] = np.zeros((2, replicates))
                    totals[group] += np.outer([s["total"] or 0.0, s["n"]], times)
        for group, (total, n) in totals.items():
            for start in range(0, replicates, block):
                yield pd.DataFrame({**{c: [v] for c, v in zip(by, group)}, "start": [start], "total": [total[start : start + block]], "n": [n[start : start + block]]})

    parts = keyed.mapInPandas(run, f"{kinds}, start long, total array<double>, n array<double>")

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total, n = (np.sum(np.stack(rows[c].to_numpy()), axis=0) for c in ("total", "n"))
        mean = np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)
        return pd.DataFrame({**dict(zip([*by, "replicate"], [*key[:-1], key[-1] + np.arange(len(mean))])), "mean": mean})

    return parts.groupBy(*by, "start").applyInPandas(add, _schema(sums, by))


def _matrices(sums: DataFrame, unit: str, by: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(groups, totals, numbers) of all clusters in order, a row for each group: of clusters that are counted before."""
    rows = sums.select(unit, *by, "total", "n").toPandas()
    units = sorted(rows[unit].unique())
    place = {u: i for i, u in enumerate(units)}
    groups = [(key if isinstance(key, tuple) else (key,), g) for key, g in rows.groupby(by, dropna=False)]
    total, count = (np.zeros((len(groups), len(units))) for _ in range(2))
    for i, (_, g) in enumerate(groups):
        at = g[unit].map(place).to_numpy()
        total[i, at], count[i, at] = g["total"].fillna(0).to_numpy(), g["n"].to_numpy()
    return [key for key, _ in groups], total, count


def _schema(sums: DataFrame, by: list[str]) -> str:
    kinds = dict(sums.dtypes)
    return ", ".join([*(f"{c} {kinds[c]}" for c in by), "replicate long", "mean double"])


def _means(groups: list[tuple], by: list[str], replicates: np.ndarray, times: np.ndarray, total: np.ndarray, count: np.ndarray):
    """Rows of the means of some replicates, by how often each draws each cluster; NaN without any value."""
    n, sums = times @ count.T, times @ total.T
    mean = np.divide(sums, n, out=np.full(n.shape, np.nan), where=n > 0)
    for i, key in enumerate(groups):
        yield pd.DataFrame({**dict(zip(by, key)), "replicate": replicates, "mean": mean[:, i]})


def bootstrap_by_generator(sums: DataFrame, unit: str, by: list[str], cfg: Statistics = Statistics(), block: int = 500, most: int = 1_000_000) -> DataFrame:
    """(by, replicate, mean) with the draws of one PCG64 generator, made in order by blocks of replicates.

    Draw i of replicate r is the same for every metric. The clusters' sums travel to every task, a row for each cluster and metric; more than
    ``most`` clusters are an error, for they are for ``bootstrap_by_hash``. A task draws on from where its block before ended, and passes over
    the draws of other tasks in slices of at most ``most``.
    """
    spark: SparkSession = sums.sparkSession
    if (found := sums.select(unit).distinct().count()) > most:
        raise ValueError(f"{found} clusters are too many for one generator; use bootstrap_by_hash")
    groups, total, count = _matrices(sums, unit, by)
    clusters = total.shape[1]
    starts = spark.range(0, cfg.replicates, block, numPartitions=max(1, min(64, cfg.replicates // block)))

    def run(batches):
        rng, at = np.random.Generator(np.random.PCG64(cfg.seed)), 0
        for pdf in batches:
            for start in sorted(pdf["id"]):
                left = (start - at) * clusters
                while left > 0:
                    left -= len(rng.integers(0, clusters, min(left, most)))
                at = min(start + block, cfg.replicates)
                for low in range(start, at, 64):
                    high = min(low + 64, at)
                    times = np.stack([np.bincount(rng.integers(0, clusters, clusters), minlength=clusters) for _ in range(low, high)]).astype(float)
                    yield from _means(groups, by, np.arange(low, high), times, total, count)

    return starts.mapInPandas(run, _schema(sums, by))


def intervals(replicates: DataFrame, by: list[str], level: float = Statistics.level) -> DataFrame:
    """(by, low, high): percentile interval."""
    tail = (1 - level) / 2
    replicates = replicates.withColumn("mean", F.nullif("mean", F.lit(float("nan"))))  # a replicate without any defined value
    return replicates.groupBy(*by).agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))


def paired_differences(replicates: DataFrame, baseline: str, by: list[str], level: float = Statistics.level) -> DataFrame:
    """(method, by, diff_low, diff_high, p): of every other method against a baseline on the same draws, two-sided; p is no less than one in the number of replicates."""
    replicates = replicates.where(~F.isnan("mean"))
    b = replicates.where(F.col("method") == baseline).select(*by, "replicate", F.col("mean").alias("__b"))
    d = replicates.where(F.col("method") != baseline).join(b, [*by, "replicate"]).withColumn("d", F.col("mean") - F.col("__b"))
    tail = (1 - level) / 2
    p = F.least(F.lit(1.0), F.greatest(2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))), 1.0 / F.count("*")))
    return d.groupBy("method", *by).agg(F.percentile("d", F.lit(tail)).alias("diff_low"), F.percentile("d", F.lit(1 - tail)).alias("diff_high"), p.alias("p"))


def paired_difference(replicates: DataFrame, method: str, baseline: str, by: list[str], level: float = Statistics.level) -> DataFrame:
    """(by, diff_low, diff_high, p) of one method, see ``paired_differences``."""
    return paired_differences(replicates.where(F.col("method").isin(method, baseline)), baseline, by, level).drop("method")


def holm(tests: DataFrame, p: str = "p", name: str = "test", alpha: float = Statistics.alpha) -> DataFrame:
    """Adds p_holm and rejected. One family of tests, so one window over all rows."""
    order = Window.orderBy(p, name)
    m = F.count("*").over(Window.partitionBy())
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("__step", step).withColumn("p_holm", F.max("__step").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rejected", F.col("p_holm") <= alpha).drop("__step")


def win_loss_tie(values: DataFrame, method: str, baseline: str, lower_is_better: tuple[str, ...] = (), tolerance: float = Statistics.tolerance, query: list[str] | None = None) -> DataFrame:
    """(metric, wins, losses, ties) over queries (told by ``query``) on which both are defined, a value each."""
    of = lambda name: F.max(F.when(F.col("method") == name, F.col("value")))
    d = values.groupBy(*(query or ["query_id"]), "metric").agg(of(method).alias("value"), of(baseline).alias("__b")).where(F.col("value").isNotNull() & F.col("__b").isNotNull())
    sign = F.when(F.col("metric").isin(*lower_is_better), -1).otherwise(1) if lower_is_better else F.lit(1)
    diff = sign * (F.col("value") - F.col("__b"))
    return d.groupBy("metric").agg(F.count_if(diff > tolerance).alias("wins"), F.count_if(diff < -tolerance).alias("losses"), F.count_if(F.abs(diff) <= tolerance).alias("ties"))


def capacity(values: DataFrame, preserved: Column, threshold: int = Statistics.capacity) -> DataFrame:
    """Rows with the group of their query: whether at least ``threshold`` candidates are preserved."""
    return values.withColumn("capacity", F.when(preserved >= threshold, F.lit(f">={threshold}")).otherwise(F.lit(f"<{threshold}")))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows in which two sources of the same values disagree: one is missing, or they are further apart than ``tolerance``."""
    both = a.select(*keys, F.col("value").alias("left_value")).join(b.select(*keys, F.col("value").alias("right_value")), keys, "full")
    fine = F.coalesce(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, F.lit(False))
    return both.where(~fine)
