"""Splitting entities in time, and seeded choices."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.config import Splits
from palimpsest.session import kept


def periods(events: DataFrame, entity: str, year: str, cfg: Splits = Splits()) -> DataFrame:
    """(entity, in_train, in_test): whether an entity has events in either period, in one pass."""
    return events.groupBy(entity).agg(F.bool_or(F.col(year).isin(*cfg.train_years)).alias("in_train"), F.bool_or(F.col(year).isin(*cfg.test_years)).alias("in_test"))


#: Keys of which a seeded sample may be drawn: the driver holds a number for each that is chosen.
MOST_KEYS = 50_000_000


def numbered(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """((key, place) of all different keys, place counting from 0 in their order; their number). Partitions hold consecutive places, sorted.

    The keys are dealt by range and counted there; the driver sees a number for each partition.
    """
    dealt = keys.select(key).distinct()
    ordered = kept(dealt.repartitionByRange(key).sortWithinPartitions(key), partitioned=True).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts = dict(ordered.groupBy("__part").agg(F.count("*")).collect())
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part], total = total, total + counts[part]
    if not total:
        return ordered.select(key, F.col("__row").alias("place")), 0
    offset = F.element_at(F.array(*[F.lit(starts.get(i, 0)).cast("long") for i in range(max(starts) + 1)]), F.col("__part") + 1)
    return ordered.select(key, (offset + F.col("__row")).alias("place")), total


def seeded_sample(keys: DataFrame, key: str, fraction: float, seed: int, most: int = MOST_KEYS) -> DataFrame:
    """The keys that a Mersenne Twister with ``seed`` samples from all of them in order; round(n fraction) of them, half to even.

    The generator draws places, so no key comes to the driver; more than ``most`` keys are an error, for they are for ``hash_sample``.
    """
    ordered, total = numbered(keys, key)
    if total > most:
        raise ValueError(f"{total} keys are too many for one generator; use hash_sample")
    places = pd.DataFrame({"place": np.array(random.Random(seed).sample(range(total), round(total * fraction)), np.int64)})
    return ordered.join(keys.sparkSession.createDataFrame(places, "place long"), "place", "left_semi").select(key)


def hash_sample(keys: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """The keys whose seeded hash is below ``fraction``: the same in any SQL, without a sorted list."""
    number = F.conv(F.left(F.md5(F.concat_ws("|", F.lit(str(seed)), key).cast("binary")), F.lit(8)), 16, 10).cast("double") / float(16**8)
    return keys.where(number < fraction)


def seeded_choice(keys: DataFrame, key: str, options: tuple[str, ...], seed: int, name: str) -> DataFrame:
    """(key, choice): a seeded generator draws once for each key in order.

    A task draws for its own keys, and passes over the draws for those before them.
    """
    ordered, _ = numbered(keys, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, at, choices = random.Random(seed), 0, sorted(options)
        for pdf in batches:
            drawn = []
            for place in pdf["place"]:
                while at <= place:
                    choice = rng.choice(choices)
                    at += 1
                drawn.append(choice)
            yield pd.DataFrame({key: pdf[key], name: drawn})

    return ordered.mapInPandas(run, f"{key} {dict(keys.dtypes)[key]}, {name} string")


def assign(entities: DataFrame, seen: DataFrame, entity: str, dev: DataFrame) -> DataFrame:
    """(entity, split): train or dev with events in the train period, test with events in the test period alone, else corpus_only."""
    flagged = entities.select(entity).distinct().join(seen, entity, "left").join(dev.select(entity).withColumn("__dev", F.lit(True)), entity, "left")
    split = F.when(F.col("in_train") & F.col("__dev"), "dev").when(F.col("in_train"), "train").when(F.col("in_test"), "test").otherwise("corpus_only")
    return flagged.select(entity, split.alias("split"))


def event_splits(events: DataFrame, assigned: DataFrame, entity: str, year: str, cfg: Splits = Splits()) -> DataFrame:
    """Events with the split they count for; test-year events of train and dev entities are future_event, others none."""
    train, test = F.col(year).isin(*cfg.train_years), F.col(year).isin(*cfg.test_years)
    own = F.col("split").isin("train", "dev")
    split = F.when(own & train, F.col("split")).when(own & test, "future_event").when((F.col("split") == "test") & test, "test")
    return events.join(assigned, entity).withColumn("split", split).where(F.col("split").isNotNull())


def guard(frame: DataFrame, allowed: tuple[str, ...] = ("train", "dev")) -> DataFrame:
    """The frame; reading a row of another split is an error."""
    bad = ~F.coalesce(F.col("split").isin(*allowed), F.lit(False))
    return frame.withColumn("split", F.when(bad, F.raise_error(F.concat(F.lit("split not open: "), F.coalesce("split", F.lit("null")))).cast("string")).otherwise(F.col("split")))
