"""Profiles of labelled pools and of what a rule takes away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.pit import graded
from palimpsest.session import kept

POSITIVE, NEGATIVE = "TARGET_CURRENT", "TARGET_OUTDATED"


def _section(frame: DataFrame, section: str, key: Column, value: Column) -> DataFrame:
    return frame.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))


def labels(pool: DataFrame, suppressed: Column, entity: str = "entity", query: list[str] | None = None) -> DataFrame:
    """(section, key, value): what there is to learn from in a pool (query_id, evidence_id, class, entity).

    Examples are the target chain's current (positive) and outdated (negative) candidates: their numbers, how many a question has, how many questions a
    piece of evidence is an example of, evidence with both labels, entities, classes of the other candidates, and what the rule (``suppressed``) says of examples.

    The pool is read once: stored is a row for each question (told by ``query``) with its numbers by class, and the names of its examples.
    These names are shuffled once, with their numbers of both classes; how much evidence has which numbers is stored too.
    """
    example = F.col("class").isin(POSITIVE, NEGATIVE)
    marked = pool.withColumns({"__gone": F.coalesce(suppressed, F.lit(False)), "__example": example})
    parts = marked.groupBy(*(query or ["query_id"]), "class", "__gone").agg(F.count("*").alias("n"), F.max("__example").alias("__example"), F.collect_list(F.when(F.col("__example"), F.col("evidence_id"))).alias("of"), F.first(entity).alias("__e"))
    stored = kept(parts.groupBy(*(query or ["query_id"])).agg(F.first("__e").alias("__entity"), F.collect_list(F.struct("class", "__gone", "__example", "n", "of")).alias("parts")).select("__entity", "parts"))
    number = lambda c: F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + F.when(x["class"] == c, x["n"]).otherwise(F.lit(0)))
    per_query = stored.select(number(POSITIVE).alias("positive"), number(NEGATIVE).alias("negative"))
    by_class = stored.select(F.explode("parts").alias("x")).groupBy("x.class", "x.__gone", "x.__example").agg(F.sum("x.n").alias("n"))
    own = stored.select(F.explode("parts").alias("x")).select("x.class", F.explode("x.of").alias("evidence_id"))
    each = own.groupBy("evidence_id").agg(F.count_if(F.col("class") == POSITIVE).alias("p"), F.count_if(F.col("class") == NEGATIVE).alias("q"))
    numbers = each.select((F.col("p") + F.col("q")).alias("n"), F.when((F.col("p") > 0) & (F.col("q") > 0), 2).otherwise(1).alias("classes"))
    per_evidence = kept(numbers.groupBy("n", "classes").agg(F.count("*").alias("m")))
    entities = stored.where(F.exists("parts", lambda x: x["__example"])).agg(F.count_distinct("__entity").alias("entities"))
    return _sections(per_query, by_class, per_evidence, entities)


def _sections(per_query: DataFrame, by_class: DataFrame, per_evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """(section, key, value) of ``labels``. per_evidence: of how many questions evidence is an example (n), of how many classes, and how much there is of that (m)."""
    totals = per_query.agg(F.count("*").alias("queries"), F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    wide = totals.join(per_evidence.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("evidence"), F.coalesce(F.sum(F.when(F.col("classes") > 1, F.col("m"))), F.lit(0)).alias("both_labels"))).join(entities)  # one row each
    wide = wide.withColumn("ratio", F.try_divide(F.col("negative"), F.col("positive")))
    names = ("queries", "positive", "negative", "ratio", "evidence", "both_labels", "entities")
    each = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select(F.lit("totals").alias("section"), "x.key", "x.value")
    count = lambda frame, section, key: _section(frame.groupBy(key.alias("k")).agg(F.count("*").alias("n")), section, F.col("k"), F.col("n"))
    summed = lambda frame, section, key: _section(frame.groupBy(key.alias("k")).agg(F.sum("n").alias("n")), section, F.col("k"), F.col("n"))
    parts = [
        each, count(per_query, "positive_per_query", F.col("positive")), count(per_query, "negative_per_query", F.col("negative")), _section(per_evidence.groupBy("n").agg(F.sum("m").alias("m")), "queries_per_evidence", F.col("n"), F.col("m")),
        summed(by_class.where(~F.col("__example")), "other_classes", F.col("class")), summed(by_class.where("__example"), "rule_on_examples", F.concat_ws("|", "class", F.col("__gone").cast("string"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def counted_within(rows: DataFrame, by: str, sums: dict[str, Column], id_: str = "evidence_id", entity: str = "entity") -> DataFrame:
    """By ``by``: the ``sums``, and how many different pieces of evidence and entities there are, of rows dealt by ``entity`` and cell (``pit.deal``); evidence belongs to one entity.

    Evidence is counted where it lies. Only that of an entity with several cells, which each may have it, leaves its cell by name; any other entity leaves with its numbers.
    """
    here = rows.groupBy(entity, "cell", by, id_).agg(*[c.alias(name) for name, c in sums.items()])
    named = F.when(F.shiftright("cell", 32) > 1, F.col(id_)).alias("__named")
    totals = [F.sum(name).alias(name) for name in sums]
    parts = here.groupBy(by, entity, named).agg(*totals, F.count("*").alias("evidence")).withColumn("evidence", F.when(F.col("__named").isNull(), F.col("evidence")).otherwise(F.lit(1)))
    each = parts.groupBy(by, entity).agg(*totals, F.sum("evidence").alias("evidence"))
    return each.groupBy(by).agg(*totals, F.sum("evidence").alias("evidence"), F.count("*").alias("entities"))


def suppressed_mass(flagged: DataFrame, category: Column, k: int = 10) -> DataFrame:
    """By category of what a rule suppresses: occurrences, evidence, entities, the share of all, and the graded relevance that leaves the first ``k``.

    flagged: query_id, evidence_id, entity, class, prior_rank, rank and suppressed; with cell it is dealt as ``counted_within`` has it.
    """
    gain = graded(F.col("class")).cast("long")
    gone = flagged.where("suppressed").withColumn("category", category)
    lost = F.sum(F.when((F.col("prior_rank") <= k) & (F.col("rank") > k), gain).otherwise(F.lit(0)))
    totals = {"occurrences": F.count("*"), "graded": F.sum(gain), "graded_lost_at_k": lost}
    if "cell" in flagged.columns:
        sums = counted_within(gone, "category", totals).select("category", "occurrences", "evidence", "entities", "graded", "graded_lost_at_k")
    else:
        sums = gone.groupBy("category").agg(
            totals["occurrences"].alias("occurrences"), F.count_distinct("evidence_id").alias("evidence"), F.count_distinct("entity").alias("entities"), totals["graded"].alias("graded"), lost.alias("graded_lost_at_k"),
        )
    return sums.withColumn("share", F.col("occurrences") / F.sum("occurrences").over(Window.partitionBy()))  # a row for each category
