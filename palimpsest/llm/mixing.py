"""Mixing sources to target weights by iterative proportional fitting.

Native: DataFrame functions only.

Tokens are summed over all documents by cell, a cell being one combination of source, language and topic. The cells' weights
are raked: scaled to the target share of each source, then of each language, then of each topic, round after round,
until all margins fit. A document is then sampled by a hash of its id with its cell's probability: fitted over observed weight,
times the part of all tokens that is wanted. No document is taken more than once, so no cell gets more than it has: what a
cell can't take goes to the others round after round, and a margin's value that has too little for its target is taken whole, the
other targets growing in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch

#: Margins that are raked, in this order.
MARGINS = ("source", "lang", "topic")
ROUNDS = 12
#: Rounds between two cuts of the lineage.
CUT = 3
#: Target share of a value: its observed share to this power, made to sum to 1.
FLATTEN = 0.5
#: Cells that one task may rake; more are raked over shuffles.
ONE_TASK_CELLS = 100_000
#: Tokens to be sampled, as a part of all.
FRACTION = 0.2
#: Rounds in which targets that cannot be had are lowered.
FILL = 8
#: Digits of the md5 that make a document's number in [0, 1).
DIGITS = 12
#: Patterns of the topics, the first that matches names it. They stand in for a topic column, where there is none.
TOPICS = (
    ("legal", r"(?i)(licen[cs]e|copyright|all rights reserved)"),
    ("contact", r"([0-9]{1,3}\.){3}[0-9]{1,3}|[A-Za-z0-9._-]{1,64}@[A-Za-z0-9-]{1,64}\.|\+?[0-9][0-9 ()-]{8,20}[0-9]"),
    ("tabular", r" \| "),
    ("noisy", r"[!#$%&*]{2}"),
)


def topic(text: Column) -> Column:
    """A document's topic from fixed patterns over its whole text; ``prose`` if none matches."""
    found = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def token_weight(text: Column) -> Column:
    """Words between single spaces and line feeds: one more than those separators; at least 1, so no document weighs nothing."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, " \n", "")) + 1).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of id and seed, the same in any SQL."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def targets(cells: DataFrame, name: str, power: float, given: dict[str, float] | None, fraction: float | None = None) -> DataFrame:
    """value, share of one margin: as ``given`` (values not named get nothing), else observed tokens to the ``power``.

    With ``fraction`` a value gets no more than all it has, and what that leaves over goes to the others in proportion.
    """
    seen = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("tokens"))
    if given is None:
        raw = F.pow(F.col("tokens").cast("double"), F.lit(power))
    else:
        raw = F.coalesce(*[F.when(F.col("value") == k, F.lit(float(v))) for k, v in given.items()], F.lit(0.0))
    whole = Window.partitionBy()  # a row for each value of the margin
    room = F.col("tokens") / (F.sum("tokens").over(whole) * F.lit(float(fraction))) if fraction else F.lit(float("inf"))
    rated = seen.withColumns({"raw": raw, "room": room}).withColumn("share", F.col("raw") / F.sum("raw").over(whole))
    full = F.col("share") >= F.col("room")
    for _ in range(FILL if fraction else 0):
        sums = {"taken": F.sum(F.when(full, F.col("room")).otherwise(0.0)).over(whole), "rest": F.sum(F.when(full, 0.0).otherwise(F.col("raw"))).over(whole)}
        rated = rated.withColumns(sums).withColumn("share", F.when(full, F.col("room")).otherwise(F.try_divide(F.col("raw") * (1 - F.col("taken")), F.col("rest"))))
    return rated.select("value", "share")


def rake(cells: DataFrame, scratch: Scratch, power: float = FLATTEN, rounds: int = ROUNDS, given: dict[str, dict[str, float]] | None = None, fraction: float | None = None) -> DataFrame:
    """cells (source, lang, topic, tokens) with ``fitted``: shares whose margins are the targets.

    ``given`` may name targets for a margin; observed cells stay the only ones, and a value without target gets weight 0. With ``fraction`` no
    cell gets more than all it has. The margins fit up to what the rounds left.
    """
    count = cells.count()
    whole = cells.agg(F.sum("tokens").alias("all_tokens"))
    cap = F.col("tokens") / (F.col("all_tokens") * F.lit(float(fraction))) if fraction else F.lit(float("inf"))
    fitted = cells.join(F.broadcast(whole)).select(*MARGINS, "tokens", F.col("tokens").cast("double").alias("fitted"), cap.alias("cap"))
    for name in MARGINS:
        share = targets(cells, name, power, (given or {}).get(name), fraction).select(F.col("value").alias(name), F.col("share").alias(f"{name}_share"))
        fitted = fitted.join(share, name)
    fitted = scratch.keep(fitted, "cells")
    for done in range(1, rounds + 1):
        if count <= ONE_TASK_CELLS:
            fitted = fitted.coalesce(1)
        for name in MARGINS:
            total = F.sum("fitted").over(Window.partitionBy(name))
            fitted = fitted.withColumn("fitted", F.when(total > 0, F.least(F.col("fitted") * F.col(f"{name}_share") / total, F.col("cap"))).otherwise(F.lit(0.0)))
        if done % CUT == 0 or done == rounds:
            fitted = scratch.keep(fitted, f"raked-{done}")
    return fitted.select(*MARGINS, "tokens", "fitted")


CELL = [f"__{name}" for name in MARGINS]


def celled(docs: DataFrame, by: Column | None = None) -> DataFrame:
    """row (all columns of ``docs``), the columns of its cell, __source, __lang and __topic, and __tokens; a null value is ``-``.

    ``by`` is the topic; null and where it is not given, it is told by patterns.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(f"__{c}") for c in ("source", "lang")]
    told = F.coalesce(topic(F.col("text")), F.lit("prose")) if by is None else F.coalesce(by.cast("string"), F.lit("-"))
    return docs.select(F.struct(*docs.columns).alias("row"), *named, told.alias("__topic"), token_weight(F.col("text")).alias("__tokens"))


def calibrate(spark: SparkSession, weights: DataFrame, fraction: float | None = FRACTION, power: float = FLATTEN, rounds: int = ROUNDS, given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """__source, __lang, __topic and __probability of every cell of ``weights`` (those and __tokens)."""
    scratch = Scratch(spark, "mixing")
    cells = scratch.keep(weights.groupBy(*CELL).agg(F.sum("__tokens").alias("tokens")).withColumnsRenamed(dict(zip(CELL, MARGINS))), "observed")
    fitted = scratch.keep(rake(cells, scratch, power, rounds, given, fraction), "fitted")
    ratio = F.col("fitted") / F.col("tokens")
    total = fitted.agg(F.sum("tokens").alias("all_tokens"), F.max(ratio).alias("most"))
    factor = F.try_divide(F.lit(1.0), F.col("most")) if fraction is None else F.col("all_tokens") * F.lit(float(fraction))
    probability = F.coalesce(F.least(ratio * factor, F.lit(1.0)), F.lit(0.0)).alias("__probability")  # the least takes off what rounding adds
    rates = scratch.keep(fitted.join(F.broadcast(total)).select(*[F.col(m).alias(c) for m, c in zip(MARGINS, CELL)], probability), "rates")
    scratch.drop(*(set(scratch.names()) - {"rates"}))
    return F.broadcast(rates) if rates.count() <= ONE_TASK_CELLS else rates


def mix(
    spark: SparkSession, docs: DataFrame, fraction: float | None = FRACTION, power: float = FLATTEN, rounds: int = ROUNDS, given: dict[str, dict[str, float]] | None = None, seed: int = 11, by: Column | None = None
) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability and sampled (boolean) of every row of ``docs``.

    docs has doc_id, text, source, lang; a null source or language is the value ``-``; ``by`` is a topic column, if there is one.
    The probability is the cell's fitted share over its observed share, times ``fraction``. It is at most 1 without being cut:
    see ``rake`` and ``targets``. Without ``fraction`` targets are not lowered, and the factor is the largest that
    leaves all probabilities at most 1, however small the sample. Rows that share a doc_id are sampled together if their cells are the
    same. An empty table gives no row.
    """
    each = Scratch(spark, "weights").keep(celled(docs, by).select("row.doc_id", *CELL, "__tokens"), "each")
    out = each.join(calibrate(spark, each, fraction, power, rounds, given), CELL).withColumnsRenamed(dict(zip(CELL, MARGINS)))
    sampled = uniform(F.col("doc_id"), seed) < F.col("__probability")
    return out.select("doc_id", *MARGINS, F.col("__tokens").alias("tokens"), F.col("__probability").alias("probability"), sampled.alias("sampled"))


def sample(
    spark: SparkSession, docs: DataFrame, fraction: float | None = FRACTION, power: float = FLATTEN, rounds: int = ROUNDS, given: dict[str, dict[str, float]] | None = None, seed: int = 11, by: Column | None = None
) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, with their columns and probability, which takes the place of a column of that name."""
    own = celled(docs, by)
    joined = own.join(calibrate(spark, own.select(*CELL, "__tokens"), fraction, power, rounds, given), CELL)
    drawn = joined.where(uniform(F.col("row.doc_id"), seed) < F.col("__probability"))
    return drawn.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "probability"], F.col("__probability").alias("probability"))


def oracle(fraction: float = FRACTION, power: float = FLATTEN, rounds: int = ROUNDS, seed: int = 11) -> str:
    """The same in DuckDB's SQL, round by round."""
    topics = " ".join(f"WHEN regexp_matches(text, '{pattern}') THEN '{name}'" for name, pattern in TOPICS)
    parts = [
        f"each AS (SELECT doc_id, coalesce(source, '-') AS source, coalesce(lang, '-') AS lang, CASE {topics} ELSE 'prose' END AS topic, "
        "length(coalesce(text, '')) - length(replace(replace(coalesce(text, ''), ' ', ''), chr(10), '')) + 1 AS tokens FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM each GROUP BY ALL)",
    ]
    for name in MARGINS:
        parts.append(f"{name}_0 AS MATERIALIZED (SELECT {name}, pow(sum(tokens), {power}) AS raw, sum(tokens) / ((SELECT sum(tokens) FROM cells) * {fraction}::DOUBLE) AS room, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS share FROM cells GROUP BY {name})")
        for i in range(FILL):
            free, rest = "(1 - sum(CASE WHEN share >= room THEN room ELSE 0 END) OVER ())", "nullif(sum(CASE WHEN share >= room THEN 0 ELSE raw END) OVER (), 0)"
            parts.append(f"{name}_{i + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN share >= room THEN room ELSE raw * {free} / {rest} END AS share) FROM {name}_{i})")
    parts.append(f"step_0 AS MATERIALIZED (SELECT *, tokens AS fitted, tokens / ((SELECT sum(tokens) FROM cells) * {fraction}::DOUBLE) AS cap FROM cells)")
    step = 0
    for _ in range(rounds):
        for name in MARGINS:
            parts.append(f"step_{step + 1} AS MATERIALIZED (SELECT c.* REPLACE (least(c.fitted * t.share / sum(c.fitted) OVER (PARTITION BY c.{name}), c.cap) AS fitted) FROM step_{step} c JOIN {name}_{FILL} t USING ({name}))")
            step += 1
    parts.append(f"rates AS (SELECT source, lang, topic, least(fitted / tokens * (SELECT sum(tokens) FROM step_{step}) * {fraction}::DOUBLE, 1.0) AS probability FROM step_{step})")
    number = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, {DIGITS}))::BIGINT / {16**DIGITS}.0"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, source, lang, topic, tokens, round(probability, 9) AS probability, {number} < probability AS sampled FROM each JOIN rates USING (source, lang, topic)"
