"""Whole summaries: all columns of the metric and staleness reports, the grid on dev, and profiles of labels and suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import evaluate, pit, profiles
from palimpsest.operators.ranking import DECIMALS
from palimpsest.plans.catalogue import query
from palimpsest.plans.ranked import _DCG, _FLAG, _IDEAL, _METRICS, _MM, _SUP, _KEYS, _TIE, flagged, lists, rule
from palimpsest.session import kept
from palimpsest.sources import adapters as A
from palimpsest.sources.adapters import LIST, POOL, SEED

_SUMMARY = f"""{_METRICS}, x AS (SELECT query_id, method, min(rank) FILTER (WHERE class = 'OTHER_SOURCE_CURRENT') AS fo, min_by(score, rank) FILTER (WHERE class = 'TARGET_CURRENT') - min_by(score, rank) FILTER (WHERE class = 'TARGET_OUTDATED') AS gap FROM lists GROUP BY 1, 2),
y AS (SELECT met.*, ideal.fc, ideal.fs, ideal.nc, ideal.out10, ideal.top1, x.fo, x.gap, coalesce(ideal.fc <= 50, false) AS listed, coalesce(ideal.fc <= 10, false) AS top FROM met JOIN ideal USING (query_id, method) JOIN x USING (query_id, method))"""


@query(
    f"WITH {_SUMMARY} SELECT method, count(*) AS queries, round(avg(recall), 6) AS recall_k, round(avg(CASE WHEN nc > 0 THEN 1 ELSE 0 END), 6) AS recall_pool, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(gndcg), 6) AS ndcg_graded, round(avg(stale), 6) AS stale, "
    "round(avg((NOT listed)::INT), 6) AS retrieval_failure, round(avg((listed AND NOT top)::INT), 6) AS ranking_failure, round(avg((fs IS NOT NULL)::INT), 6) AS outdated_in_pool, round(avg((out10 > 0)::INT), 6) AS outdated_in_k, round(avg((listed AND fs IS NOT NULL)::INT), 6) AS both_in_pool, "
    "round(avg((fo IS NOT NULL)::INT), 6) AS other_current_in_pool, round(avg((top AND out10 > 0)::INT), 6) AS both_in_k, round(avg(coalesce(fo <= 10, false)::INT), 6) AS other_current_in_k, round(avg((top1 = 'TARGET_CURRENT')::INT), 6) AS top1_current, round(avg((top1 = 'TARGET_OUTDATED')::INT), 6) AS top1_outdated, "
    "round(avg((abs(gap) < 1e-9)::INT), 6) AS tie_rate, round(avg(gap), 6) AS mean_gap, count(gap) AS both_listed FROM y GROUP BY 1"
)
def metric_summary(spark, sf):
    return evaluate.summary(evaluate.per_query(lists(spark, sf), keys=_KEYS))


@query(
    f"WITH {_SUMMARY}{_SUP}, z AS (SELECT y.*, CASE WHEN bo > 0 THEN 1.0::DOUBLE - so * 1.0::DOUBLE / bo END AS suppression, CASE WHEN bc > 0 THEN (EXISTS (SELECT 1 FROM top t WHERE t.query_id = y.query_id AND t.method = y.method AND t.class = 'TARGET_CURRENT'))::INT::DOUBLE END AS preservation FROM y JOIN sup USING (query_id, method)) "
    "SELECT method, count(*) AS queries, round(avg(out10), 6) AS outdated_count, round(avg(first_outdated), 6) AS first_outdated_mean, CAST(list_sort(list(first_outdated))[1 + count(*) // 2] AS DOUBLE) AS first_outdated_median, round(avg((first_outdated > 10)::INT), 6) AS beyond_k, round(avg((first_outdated > 50)::INT), 6) AS not_in_pool, "
    "round(avg(suppression), 6) AS suppression, count(suppression) AS suppression_queries, round(avg(preservation), 6) AS preservation, count(preservation) AS preservation_queries, round(avg(joint), 6) AS joint FROM z GROUP BY 1"
)
def staleness_summary(spark, sf):
    m = evaluate.per_query(lists(spark, sf), keys=_KEYS, prior="prior_rank")
    needed = ["method", "outdated_count@10", "first_outdated_rank", "current_at1_no_stale@10", "outdated_suppression", "current_preservation"]
    return evaluate.staleness(kept(m.select(*[F.col(f"`{c}`") for c in needed])), None)  # a row for each list, read twice


_TAUS, _WEIGHTS = (30.0, 180.0, 365.0), (0.1, 0.3, 0.5)


@query(
    f"WITH {POOL}, g AS (SELECT * FROM (VALUES {', '.join(f'({t}::DOUBLE)' for t in _TAUS)}) t(tau), (VALUES {', '.join(f'({w}::DOUBLE)' for w in _WEIGHTS)}) w(weight)), sc AS (SELECT *, {_MM} AS ms FROM pool WHERE entity % 3 = 1 WINDOW w AS (PARTITION BY query_id)), "
    f"ea AS (SELECT query_id, evidence_id, class, tau, weight, ms + weight * exp(-age / tau) AS s FROM sc, g), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, tau, weight ORDER BY round(s, {DECIMALS}) DESC, {_TIE}) AS rank FROM ea), "
    f"pq AS (SELECT query_id, tau, weight, {_DCG.format(g="(class = 'TARGET_CURRENT')::INT")} AS dcg, count(*) FILTER (WHERE class = 'TARGET_CURRENT') AS nc, count(*) FILTER (WHERE class = 'TARGET_OUTDATED' AND rank <= 10) / 10.0::DOUBLE AS stale FROM rk GROUP BY 1, 2, 3), "
    f"me AS (SELECT tau, weight, avg(CASE WHEN nc > 0 THEN dcg / {_IDEAL.format(n='nc')} ELSE 0 END) AS ndcg, avg(stale) AS stale FROM pq GROUP BY 1, 2) SELECT tau, weight, round(ndcg, 6) AS ndcg, round(stale, 6) AS stale, row_number() OVER (ORDER BY round(ndcg, 9) DESC, round(stale, 9), tau, weight) AS place FROM me"
)
def recency_dev_selection(spark, sf):
    """The grid of the blended recency reranker on the dev entities' questions alone."""
    dev = A.pool(spark, sf, only=F.col("entity") % 3 == 1)
    order = lambda s: [F.round(s, DECIMALS).desc(), text.tie_key(SEED, F.col("query_id"), F.col("evidence_id")).asc()]
    return evaluate.grid_on_dev(dev, F.col("age"), _TAUS, _WEIGHTS, order, query=LIST)


_LABELS = f"""{_FLAG}, mk AS (SELECT *, class IN ('TARGET_CURRENT', 'TARGET_OUTDATED') AS example FROM flag), ex AS (SELECT * FROM mk WHERE example),
pq AS (SELECT query_id, count(*) FILTER (WHERE class = 'TARGET_CURRENT') AS p, count(*) FILTER (WHERE class = 'TARGET_OUTDATED') AS n FROM mk GROUP BY 1), pe AS (SELECT evidence_id, count(*) AS n, count(DISTINCT class) AS c FROM ex GROUP BY 1)"""
_TOTALS = {"queries": "SELECT count(*) FROM pq", "positive": "SELECT sum(p) FROM pq", "negative": "SELECT sum(n) FROM pq", "ratio": "SELECT sum(n) * 1.0::DOUBLE / sum(p) FROM pq", "evidence": "SELECT count(*) FROM pe", "both_labels": "SELECT count(*) FROM pe WHERE c > 1", "entities": "SELECT count(DISTINCT entity) FROM ex"}


@query(
    f"WITH {_LABELS} " + " UNION ALL ".join(f"SELECT 'totals' AS section, '{k}' AS key, round(CAST(({q}) AS DOUBLE), 6) AS value" for k, q in _TOTALS.items())
    + " UNION ALL SELECT 'positive_per_query', CAST(p AS VARCHAR), count(*)::DOUBLE FROM pq GROUP BY p UNION ALL SELECT 'negative_per_query', CAST(n AS VARCHAR), count(*)::DOUBLE FROM pq GROUP BY n UNION ALL SELECT 'queries_per_evidence', CAST(n AS VARCHAR), count(*)::DOUBLE FROM pe GROUP BY n"
    " UNION ALL SELECT 'other_classes', class, count(*)::DOUBLE FROM mk WHERE NOT example GROUP BY class UNION ALL SELECT 'rule_on_examples', class || '|' || superseded, count(*)::DOUBLE FROM ex GROUP BY class, superseded"
)
def label_profile(spark, sf):
    return profiles.labels(flagged(spark, sf), F.col("superseded"), query=LIST)


_MASS = f"{_FLAG}, l AS (SELECT *, rank AS prior, row_number() OVER (PARTITION BY query_id ORDER BY superseded, rank) AS nr, CASE class WHEN 'TARGET_CURRENT' THEN 2 WHEN 'OTHER_SOURCE_CURRENT' THEN 1 ELSE 0 END AS gain FROM flag)"


@query(f"WITH {_MASS} SELECT CASE WHEN class = 'TARGET_OUTDATED' THEN 'TARGET_CHAIN_OUTDATED' WHEN e_source <> source THEN 'SAME_CVE_OTHER_SOURCE_INFERRED_SUPERSEDED' WHEN class <> 'TARGET_CURRENT' THEN 'UNLABELED_CHAIN_CONTEXT' ELSE 'OTHER' END AS category, count(*) AS occurrences, count(DISTINCT evidence_id) AS evidence, count(DISTINCT entity) AS entities, CAST(sum(gain) AS BIGINT) AS graded, CAST(sum(CASE WHEN prior <= 10 AND nr > 10 THEN gain ELSE 0 END) AS BIGINT) AS graded_lost_at_k, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM l WHERE superseded GROUP BY 1")
def suppressed_mass(spark, sf):
    category = pit.suppression_category(F.col("class"), F.lit(True), F.col("source") == F.col("q_source"), F.lit(True))
    return profiles.suppressed_mass(rule(spark, sf, "rule_corpus"), category)
