"""The full replay of chains, and its oracle: a recursive query that carries a chain's state from step to step.

The adapters' chains have four values, so what is held, and since when, fits into four columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import replay, timeline
from palimpsest.plans.catalogue import query
from palimpsest.sources import adapters as A
from palimpsest.sources.adapters import A3

_VALUES = range(4)
_each = lambda f, sep=", ": sep.join(f(i) for i in _VALUES)
_pick = lambda column, value: f"CASE {value} " + _each(lambda i: f"WHEN {i} THEN {column}{i}", " ") + " END"
_VECTOR = "'AV:' || substr('NALP', 1 + CAST({0} AS INT), 1) || '/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H'"

# g: what is gone, c: what came; of a change with one of each, both. Position p of an event, and number of the chain's events up to the change's end.
_STEPS = f"""{A3},
begun AS (SELECT *, min(t) OVER (PARTITION BY entity, source, change_id) AS bt FROM a3),
ord AS (SELECT *, row_number() OVER w AS p, lag(t) OVER w AS pt, lag(change_id) OVER w AS pc FROM begun WINDOW w AS (PARTITION BY entity, source ORDER BY bt, change_id, t, id)),
chg AS (SELECT entity, source, change_id, min(p) AS p0, max(p) AS events, count(*) FILTER (WHERE action = 'Removed') AS r, count(*) FILTER (WHERE action = 'Added') AS a FROM ord GROUP BY 1, 2, 3),
loose AS (SELECT o.*, c.p0, c.events, c.r, c.a, change_id || '#' || id AS event_id FROM ord o JOIN chg c USING (entity, source, change_id)),
made AS (SELECT entity, source, p0, events, min(p) AS p, max(value) FILTER (WHERE action = 'Removed') AS gv, max(t) FILTER (WHERE action = 'Removed') AS gt, max(event_id) FILTER (WHERE action = 'Removed') AS gid,
   max(value) FILTER (WHERE action = 'Added') AS cv, max(t) FILTER (WHERE action = 'Added') AS ct, max(event_id) FILTER (WHERE action = 'Added') AS cid, NULL::BOOLEAN AS came FROM loose WHERE r = 1 AND a = 1 GROUP BY ALL
 UNION ALL SELECT entity, source, p0, events, p, CASE WHEN action = 'Removed' THEN value END, CASE WHEN action = 'Removed' THEN t END, CASE WHEN action = 'Removed' THEN event_id END,
   CASE WHEN action = 'Added' THEN value END, CASE WHEN action = 'Added' THEN t END, CASE WHEN action = 'Added' THEN event_id END, action = 'Added' FROM loose WHERE r <> 1 OR a <> 1),
step AS (SELECT *, row_number() OVER (PARTITION BY entity, source ORDER BY p0, came, p) AS k, CASE WHEN came THEN 'addition' WHEN NOT came THEN 'removal' WHEN gv = cv THEN 'rewrite' ELSE 'strict' END AS kind FROM made)"""

# State: h0..h3 the interval that holds a value (0: none), s0..s3 whether a value was seen, n intervals so far; en, ev, et, eid the interval that the last
# removal ended, its value, the time and the event. Situations and acts are those of the replay's table.
_RUN = f"""{_STEPS},
run AS (
 SELECT DISTINCT entity, source, 0::BIGINT AS k, {_each(lambda i: f'0::BIGINT AS h{i}')}, {_each(lambda i: f'false AS s{i}')}, 0::BIGINT AS n, 0::BIGINT AS en, -1::BIGINT AS ev, 0::BIGINT AS et, '' AS eid,
   '' AS kind, '' AS told, '' AS added, 0::BIGINT AS inferred, 0::BIGINT AS ended, 0::BIGINT AS started, false AS back, 0::BIGINT AS crossed, '' AS crossed_by, 0::BIGINT AS crossed_at, -1::BIGINT AS gv, 0::BIGINT AS gt, -1::BIGINT AS cv, 0::BIGINT AS ct, '' AS cid FROM step
 UNION ALL
 SELECT entity, source, k, {_each(lambda i: f"CASE WHEN started > 0 AND cv = {i} THEN started WHEN gv = {i} AND ended > 0 THEN 0 WHEN gv = {i} AND inferred > 0 THEN inferred ELSE h{i} END")},
   {_each(lambda i: f"s{i} OR (inferred > 0 AND gv = {i}) OR (started > 0 AND cv = {i})")}, n + (inferred > 0)::BIGINT + (started > 0)::BIGINT,
   CASE WHEN kind <> 'removal' THEN 0 WHEN ended > 0 THEN ended ELSE en END, CASE WHEN kind = 'removal' AND ended > 0 THEN gv ELSE ev END, CASE WHEN kind = 'removal' AND ended > 0 THEN gt ELSE et END, CASE WHEN kind = 'removal' AND ended > 0 THEN gid ELSE eid END,
   kind, told, added, inferred, ended, started, started > 0 AND added <> 'again' AND seen_c, CASE WHEN added = 'crossing' THEN en ELSE 0 END, CASE WHEN added = 'crossing' THEN eid ELSE '' END, CASE WHEN added = 'crossing' THEN et ELSE 0 END, coalesce(gv, -1), coalesce(gt, 0), coalesce(cv, -1), coalesce(ct, 0), coalesce(cid, '')
 FROM (SELECT *, CASE WHEN kind IN ('strict', 'removal') THEN CASE WHEN told = 'held' THEN hv WHEN told IN ('first', 'lost') THEN n + 1 ELSE 0 END ELSE 0 END AS ended, CASE WHEN kind = 'strict' OR added <> '' THEN n + 1 + (inferred > 0)::BIGINT ELSE 0 END AS started
  FROM (SELECT *, CASE WHEN (kind = 'strict' AND told <> 'held') OR (kind IN ('rewrite', 'removal') AND told = 'first') THEN n + 1 ELSE 0 END AS inferred,
    CASE WHEN (kind = 'addition' AND told <> 'held') OR (kind = 'rewrite' AND told = 'lost') THEN CASE WHEN en > 0 AND ev = cv THEN 'again' WHEN en > 0 AND et < ct THEN 'crossing' WHEN n > 0 THEN 'later' ELSE 'initial' END ELSE '' END AS added
   FROM (SELECT *, CASE WHEN hv > 0 THEN 'held' WHEN kind = 'strict' THEN CASE WHEN n = 0 AND events = 2 THEN 'first' ELSE 'lost' END WHEN kind = 'rewrite' THEN CASE WHEN n = 0 AND events <= 2 THEN 'first' ELSE 'lost' END
      WHEN kind = 'removal' THEN CASE WHEN n = 0 AND events = 1 THEN 'first' WHEN sv THEN 'past' ELSE 'unknown' END ELSE 'new' END AS told
    FROM (SELECT s.*, r.n, r.en, r.ev, r.et, r.eid, {_each(lambda i: f'r.h{i}')}, {_each(lambda i: f'r.s{i}')}, {_pick('r.h', 'coalesce(s.gv, s.cv)')} AS hv, {_pick('r.s', 'coalesce(s.gv, s.cv)')} AS sv, {_pick('r.s', 's.cv')} AS seen_c
     FROM run r JOIN step s ON r.entity = s.entity AND r.source = s.source AND s.k = r.k + 1))))
),
act AS (SELECT *, (kind = 'strict' OR added = 'later') AND {_each(lambda i: f'(h{i} > 0)::INT', ' + ')} > 1 AS compete FROM run WHERE k > 0),
why AS (SELECT entity, source, reason, min(spot) AS spot FROM (
   SELECT entity, source, k::DOUBLE AS spot, CASE WHEN kind = 'strict' AND told = 'lost' THEN '{replay.LOST}' WHEN kind = 'removal' AND told = 'past' THEN '{replay.PAST}' WHEN kind = 'removal' AND told = 'unknown' THEN '{replay.UNKNOWN}' END AS reason FROM act
   UNION ALL SELECT entity, source, k + 0.1, '{replay.COMPETING}' FROM act WHERE compete
   UNION ALL SELECT entity, source, min(s.k) - 0.5, '{replay.SEVERAL}' FROM chg c JOIN step s USING (entity, source, p0) WHERE r > 0 AND a > 0 AND (r <> 1 OR a <> 1) GROUP BY entity, source, p0) WHERE reason IS NOT NULL GROUP BY 1, 2, 3),
chain AS (SELECT entity, source, entity || '|3.1|' || source AS chain_id FROM act GROUP BY 1, 2),
rival AS (SELECT DISTINCT entity, source, i FROM (SELECT entity, source, unnest([{_each(lambda i: f'h{i}')}]) AS i FROM act WHERE compete) WHERE i > 0)"""

_INTERVALS = f"""{_RUN},
iv AS (SELECT entity, source, inferred AS i, gv AS value, NULL::BIGINT AS spot, false AS initial FROM act WHERE inferred > 0 UNION ALL SELECT entity, source, started, cv, ct, added = 'initial' FROM act WHERE started > 0),
fin AS (SELECT entity, source, ended AS i, CASE WHEN kind = 'strict' THEN ct ELSE gt END AS until FROM act WHERE ended > 0),
fate AS (SELECT entity, source, ended AS i, started AS j, '{replay.STRICT}' AS what FROM act WHERE kind = 'strict' UNION ALL SELECT entity, source, crossed, started, '{replay.CROSS}' FROM act WHERE crossed > 0),
told AS (SELECT entity, source, string_agg(reason, ',' ORDER BY spot) AS every, coalesce(string_agg(reason, ',' ORDER BY spot) FILTER (WHERE reason <> '{replay.COMPETING}'), '') AS others FROM why GROUP BY 1, 2)
SELECT chain_id || '|' || iv.i AS evidence_id, CAST(iv.entity AS VARCHAR) AS cve_id, iv.source AS source_key, {_VECTOR.format('value')} AS vector, coalesce(spot, -1) AS valid_from, coalesce(until, -1) AS valid_until,
 CASE WHEN f.what IS NOT NULL THEN '{replay.REPLACED}' WHEN until IS NOT NULL THEN '{replay.WITHDRAWN}' WHEN initial THEN '{replay.INITIAL}' ELSE '{replay.ACTIVE}' END AS timeline_status, coalesce(f.what, '') AS replacement_type,
 CASE WHEN f.what = '{replay.STRICT}' THEN chain_id || '|' || f.j ELSE '' END AS superseded_by_evidence_id, CASE WHEN b.i IS NOT NULL THEN chain_id || '|' || b.i ELSE '' END AS replaces_evidence_id, every IS NOT NULL AS chain_ambiguous,
 CASE WHEN every IS NULL THEN '' WHEN rival.i IS NULL THEN every WHEN others = '' THEN '{replay.COMPETING}' ELSE '{replay.COMPETING},' || others END AS ambiguity_reason
FROM iv JOIN chain USING (entity, source) LEFT JOIN fin USING (entity, source, i) LEFT JOIN fate f USING (entity, source, i) LEFT JOIN (SELECT entity, source, j AS k, i FROM fate) b ON b.entity = iv.entity AND b.source = iv.source AND b.k = iv.i
 LEFT JOIN told ON told.entity = iv.entity AND told.source = iv.source LEFT JOIN rival ON rival.entity = iv.entity AND rival.source = iv.source AND rival.i = iv.i"""
_REPORTS = f"""{_RUN},
evs AS (SELECT entity, source, max(p) AS n_events, count(*) FILTER (WHERE pt = t AND pc <> change_id) AS same_time FROM ord GROUP BY 1, 2),
cnt AS (SELECT entity, source, count(*) FILTER (WHERE kind = 'strict') AS strict_pairs, count(*) FILTER (WHERE kind = 'rewrite') AS other_pairs, count(*) FILTER (WHERE kind = 'rewrite') AS rewrites, count(*) FILTER (WHERE kind = 'addition' AND told = 'held') AS duplicates,
  count(*) FILTER (WHERE added = 'again') AS readds, count(*) FILTER (WHERE added = 'crossing') AS crossings, count(*) FILTER (WHERE back) AS reversals, count(*) FILTER (WHERE kind = 'removal' AND told IN ('past', 'unknown')) AS unmatched_removed,
  count(*) FILTER (WHERE added = 'later') AS unmatched_added, count(*) FILTER (WHERE compete) AS competing FROM act GROUP BY 1, 2)
SELECT chain_id, CAST(entity AS VARCHAR) AS cve_id, '3.1' AS cvss_version, source AS source_key, n_events, strict_pairs, other_pairs, rewrites, duplicates, readds, crossings, reversals, unmatched_removed, unmatched_added, competing, same_time,
 EXISTS (SELECT 1 FROM why WHERE why.entity = cnt.entity AND why.source = cnt.source) AS ambiguous FROM cnt JOIN evs USING (entity, source) JOIN chain USING (entity, source)"""

_CROSSINGS = f"""{_RUN},
iv AS (SELECT entity, source, inferred AS i, gv AS value FROM act WHERE inferred > 0 UNION ALL SELECT entity, source, started, cv FROM act WHERE started > 0)
SELECT chain_id, CAST(entity AS VARCHAR) AS cve_id, '3.1' AS cvss_version, source AS source_key, crossed_by AS removed_event_id, cid AS added_event_id, crossed_at AS removed_at, ct AS added_at, round((ct - crossed_at) / 86400000000.0::DOUBLE, 3) AS gap_days, {_VECTOR.format('iv.value')} AS old_vector, {_VECTOR.format('cv')} AS new_vector
FROM act JOIN chain USING (entity, source) JOIN iv USING (entity, source) WHERE crossed > 0 AND iv.i = crossed"""


@query(f"WITH RECURSIVE {_INTERVALS}")
def timeline_full_replay(spark, sf):
    rows, _, _ = timeline.replay(A.chain_events(spark, sf))
    or_none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    or_blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    linked = map(or_blank, ("replacement_type", "superseded_by_evidence_id", "replaces_evidence_id"))
    return rows.select("evidence_id", "cve_id", "source_key", "vector", or_none("valid_from"), or_none("valid_until"), "timeline_status", *linked, "chain_ambiguous", F.array_join("ambiguity_reason", ",").alias("ambiguity_reason"))


@query(f"WITH RECURSIVE {_REPORTS}")
def timeline_chain_reports(spark, sf):
    return timeline.replay(A.chain_events(spark, sf))[1].drop("reasons")


@query(f"WITH RECURSIVE {_CROSSINGS}")
def timeline_cross_events(spark, sf):
    return timeline.replay(A.chain_events(spark, sf))[2]
