"""Text, time and score functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scores, text, times, vectors
from palimpsest.plans.catalogue import query
from palimpsest.sources import adapters as A
from palimpsest.sources.adapters import METRICS, SEED, table, vector_sql

_TOKENS = "list_filter(list_transform(string_split_regex(replace(lower({0}), '/', ' '), '[^a-z0-9.:@\\-]+'), lambda x: trim(x, '.:-')), lambda x: x <> '')"
TOKENS = _TOKENS.format("coalesce(text, '')")


@query(f"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS terms, coalesce(array_to_string(t, ' '), '') AS joined FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def tokenize_terms(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("terms"), F.array_join("t", " ").alias("joined"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS flat FROM pages")
def text_normalise(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.normalize_whitespace(F.col("html")).alias("flat"))


# References, as far as the documents have them: DuckDB knows no function that decodes them all.
_DECODED = "text"
for _name, _char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
    _DECODED = f"replace({_DECODED}, '{_name}', {_char})"



@query(f"SELECT doc_id, CASE WHEN f IS NULL THEN '[NULL]' WHEN length(f) > 200 THEN left(f, 200) || '...[TRUNCATED]' ELSE f END AS short FROM (SELECT doc_id, regexp_replace(regexp_replace({_DECODED}, '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g') AS f FROM documents)")
def compact_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.compact_text(F.col("text"), 200).alias("short"))


@query("SELECT doc_id, CASE WHEN f = '' THEN '[EMPTY]' WHEN length(f) > 300 THEN left(f, 300) || '...[TRUNCATED]' ELSE f END AS short FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS f FROM documents)")
def compact_normalized_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.compact_normalized_text(F.col("text"), 300).alias("short"))


@query(f"SELECT item_id, sha256('{SEED}|' || item_id || '|' || text) AS tie, 'q_' || substr(sha1(item_id || '|' || text), 1, 16) AS qid, sha256(text) AS text_hash FROM benchmark")
def hash_keys(spark, sf):
    i, t = F.col("item_id").cast("string"), F.col("text")
    return table(spark, sf, "benchmark").select("item_id", text.tie_key(SEED, i, t).alias("tie"), text.query_id(i, t).alias("qid"), F.sha2("text", 256).alias("text_hash"))


@query(f"SELECT p_partkey, 'As of 2024-05-01, ' || p_brand || ' assessed ' || p_name || ' under CVSS 3.1 with Base metric vector ' || v || ', a CVSS-B score of ' || CAST((p_size / 10.0)::DOUBLE AS VARCHAR) || ', and High severity.' AS evidence_text, 'As of 2024-05-01, what was the current Base severity issued by ' || p_brand || ' for ' || p_name || ' under CVSS 3.1?' AS query_text FROM (SELECT *, {vector_sql('3.1')} AS v FROM part)")
def template_text(spark, sf):
    p = table(spark, sf, "part").join(A.vectors(spark, sf), "p_partkey")
    d, ver = F.lit("2024-05-01"), F.lit("3.1")
    e = text.evidence_text(d, F.col("p_brand"), F.col("p_name"), ver, F.col("vector"), (F.col("p_size") / 10.0), F.lit("HIGH"), F.lit(False))
    return p.select("p_partkey", e.alias("evidence_text"), text.query_text(F.lit("base_severity"), d, ver, F.col("p_brand"), F.col("p_name")).alias("query_text"))


_RAW = f"CASE p_partkey % 4 WHEN 0 THEN 'NIST: CVSS:3.1/' || v WHEN 1 THEN 'NIST - (' || v || ')' WHEN 2 THEN v ELSE 'no vector here' END"


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'NIST' WHEN 1 THEN 'NIST' WHEN 2 THEN '' ELSE 'no vector here' END AS source, CASE p_partkey % 4 WHEN 0 THEN 'CVSS:3.1/' || v WHEN 3 THEN '' ELSE v END AS vector, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE v END AS canonical FROM (SELECT p_partkey, {vector_sql('3.1')} AS v FROM part)")
def extract_vector_prefix(spark, sf):
    k, v = F.col("p_partkey") % 4, F.col("vector")
    raw = F.when(k == 0, F.concat(F.lit("NIST: CVSS:3.1/"), v)).when(k == 1, F.concat(F.lit("NIST - ("), v, F.lit(")"))).when(k == 2, v).otherwise(F.lit("no vector here"))
    found = A.vectors(spark, sf).select("p_partkey", vectors.source_and_vector(raw).alias("x"))
    return found.select("p_partkey", "x.source", "x.vector", vectors.canonical_vector(F.col("x.vector")).alias("canonical"))


_DIFF = ", ".join(f"CASE WHEN substr(split_part(a, '/', {i + 1}), {len(n) + 2}) <> substr(split_part(b, '/', {i + 1}), {len(n) + 2}) THEN '{n}' END" for i, (n, _) in enumerate(METRICS["3.1"]))


@query(f"SELECT p_partkey, coalesce(array_to_string(list_sort(list_filter([{_DIFF}], lambda x: x IS NOT NULL)), ','), '') AS changed, split_part(a, '/', 1) || '/' || split_part(a, '/', 2) AS head FROM (SELECT p_partkey, {vector_sql('3.1')} AS a, {vector_sql('3.1', 7)} AS b FROM part)")
def vector_components_diff(spark, sf):
    two = A.vectors(spark, sf).join(A.vectors(spark, sf, "3.1", 7).withColumnRenamed("vector", "other"), "p_partkey")
    m = two.withColumns({"m": vectors.components(F.col("vector")), "n": vectors.components(F.col("other"))})
    head = F.concat(F.lit("AV:"), F.col("m")["AV"], F.lit("/AC:"), F.col("m")["AC"])
    return m.select("p_partkey", F.array_join(vectors.changed(F.col("m"), F.col("n")), ",").alias("changed"), head.alias("head"))


def _w(position: int, name: str, table_: dict[str, float], v: str = "v") -> str:
    return f"CASE substr(split_part({v}, '/', {position}), {len(name) + 2}) " + " ".join(f"WHEN '{k}' THEN {x!r}::DOUBLE" for k, x in table_.items()) + " END"


def _v3_sql(rounding: str) -> str:
    c, i, a = (_w(6 + n, x, scores.V3["CIA"]) for n, x in enumerate("CIA"))
    return f"""WITH x AS (SELECT p_partkey, {vector_sql('3.1')} AS v FROM part),
y AS (SELECT p_partkey, substr(split_part(v, '/', 5), 3) AS s, 1 - (1 - {c}) * (1 - {i}) * (1 - {a}) AS iss, {_w(1, 'AV', scores.V3['AV'])} AS av, {_w(2, 'AC', scores.V3['AC'])} AS ac, {_w(3, 'PR', scores.V3['PR_U'])} AS pu, {_w(3, 'PR', scores.V3['PR_C'])} AS pc, {_w(4, 'UI', scores.V3['UI'])} AS ui FROM x),
z AS (SELECT *, CASE WHEN s = 'C' THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS impact, 8.22::DOUBLE * av * ac * (CASE WHEN s = 'C' THEN pc ELSE pu END) * ui AS ease FROM y),
t AS (SELECT *, least(CASE WHEN s = 'C' THEN 1.08::DOUBLE * (impact + ease) ELSE impact + ease END, 10) AS total FROM z)
SELECT p_partkey, CASE WHEN impact <= 0 THEN 0 ELSE {rounding} END::DOUBLE AS score FROM t"""


_UP31 = "CASE WHEN CAST(round_even(total * 100000, 0) AS BIGINT) % 10000 = 0 THEN round_even(total * 100000, 0) / 100000.0 ELSE (CAST(round_even(total * 100000, 0) AS BIGINT) // 10000 + 1) / 10.0 END"


@query(_v3_sql(_UP31))
def score_v31(spark, sf):
    return A.vectors(spark, sf).select("p_partkey", scores.base_score_v3(vectors.components(F.col("vector")), "3.1").alias("score"))


@query(_v3_sql("ceil(total * 10) / 10.0"))
def score_v30(spark, sf):
    return A.vectors(spark, sf).select("p_partkey", scores.base_score_v3(vectors.components(F.col("vector")), "3.0").alias("score"))


_V2 = f"""WITH x AS (SELECT p_partkey, {vector_sql('2.0')} AS v FROM part),
y AS (SELECT p_partkey, 10.41::DOUBLE * (1 - (1 - {_w(4, 'C', scores.V2['CIA'])}) * (1 - {_w(5, 'I', scores.V2['CIA'])}) * (1 - {_w(6, 'A', scores.V2['CIA'])})) AS impact, 20 * {_w(1, 'AV', scores.V2['AV'])} * {_w(2, 'AC', scores.V2['AC'])} * {_w(3, 'Au', scores.V2['AU'])} AS ease FROM x),
z AS (SELECT p_partkey, round((0.6::DOUBLE * impact + 0.4::DOUBLE * ease - 1.5::DOUBLE) * (CASE WHEN impact = 0 THEN 0 ELSE 1.176::DOUBLE END) + 1e-9::DOUBLE, 1) AS score FROM y)"""


@query(f"{_V2} SELECT p_partkey, score FROM z")
def score_v2(spark, sf):
    return A.vectors(spark, sf, "2.0").select("p_partkey", scores.base_score_v2(vectors.components(F.col("vector"))).alias("score"))


@query(f"{_V2} SELECT CASE WHEN score < 4 THEN 'LOW' WHEN score < 7 THEN 'MEDIUM' ELSE 'HIGH' END AS v2, CASE WHEN score = 0 THEN 'NONE' WHEN score < 4 THEN 'LOW' WHEN score < 7 THEN 'MEDIUM' WHEN score < 9 THEN 'HIGH' ELSE 'CRITICAL' END AS v3, count(*) AS n FROM z GROUP BY 1, 2")
def severity(spark, sf):
    s = score_v2(spark, sf)
    return s.groupBy(scores.severity(F.lit("2.0"), F.col("score")).alias("v2"), scores.severity(F.lit("3.1"), F.col("score")).alias("v3")).agg(F.count("*").alias("n"))


@query(f"{_V2} SELECT CAST(floor(score) AS BIGINT) AS bin, count(*) AS n FROM z GROUP BY 1")
def score_histogram(spark, sf):
    return score_v2(spark, sf).groupBy(F.floor("score").alias("bin")).agg(F.count("*").alias("n"))


_P4 = {n: f"substr(split_part(v, '/', {i + 1}), {len(n) + 2})" for i, (n, _) in enumerate(METRICS["4.0"])}


@query(
    f"SELECT p_partkey, (CASE WHEN AV = 'N' AND PR = 'N' AND UI = 'N' THEN '0' WHEN (AV = 'N' OR PR = 'N' OR UI = 'N') AND AV <> 'P' THEN '1' ELSE '2' END) || (CASE WHEN AC = 'L' AND AT_ = 'N' THEN '0' ELSE '1' END) || (CASE WHEN VC = 'H' AND VI = 'H' THEN '0' WHEN VC = 'H' OR VI = 'H' OR VA = 'H' THEN '1' ELSE '2' END) || (CASE WHEN SC = 'H' OR SI = 'H' OR SA = 'H' THEN '1' ELSE '2' END) || '0' || (CASE WHEN VC = 'H' OR VI = 'H' OR VA = 'H' THEN '0' ELSE '1' END) AS macro FROM (SELECT p_partkey, "
    + ", ".join(f"{s} AS {'AT_' if n == 'AT' else n}" for n, s in _P4.items())
    + f" FROM (SELECT p_partkey, {vector_sql('4.0')} AS v FROM part))"
)
def macro_vector_v4(spark, sf):
    return A.vectors(spark, sf, "4.0").select("p_partkey", scores.macro_vector(vectors.components(F.col("vector"))).alias("macro"))


#: A table of version 4.0 made by a rule, to stand in for the standard's, which users give: tenths that each level costs.
COSTS4 = {"eq1": 9, "eq2": 6, "eq3": 11, "eq4": 8, "eq5": 5, "eq6": 7}


def rule_table() -> dict[str, float]:
    return {key: (100 - sum(int(q) * cost for q, cost in zip(key, COSTS4.values()))) / 10.0 for key in scores.macro_vectors()}


#: Metrics beside the base ones, by digits of the key: name, letters, divisor.
_MORE4 = (("E", "XAPU", 1), ("CR", "XHML", 3), ("IR", "HXLM", 7), ("AR", "MLXH", 11), ("MSI", "XSHL", 5), ("MPR", "XXNH", 13))


def _score4_sql() -> str:
    more = "".join(f" || '/{n}:' || substr('{letters}', 1 + (p_partkey // {div}) % 4, 1)" for n, letters, div in _MORE4)
    raw = {n: f"split_part(split_part(v, '/{n}:', 2), '/', 1)" for n in ("AC", "AT", "PR", "UI", "VC", "VI", "VA", "SC", "SI", "SA", *(n for n, _, _ in _MORE4))}
    raw["AV"] = "substr(v, 4, 1)"
    default = {"E": "A", "CR": "H", "IR": "H", "AR": "H"}
    own = {n: f"CASE WHEN {x} = 'X' THEN '{default[n]}' ELSE {x} END" if n in default else x for n, x in raw.items()}
    for name in ("SI", "PR"):
        own[name] = f"coalesce(nullif({raw['M' + name]}, 'X'), {raw[name]})"
    step = lambda n, top: f"(CASE e_{n} " + " ".join(f"WHEN '{v}' THEN {0.1 * k!r}::DOUBLE" for v, k in scores.STEPS4[n].items()) + f" END - {0.1 * scores.STEPS4[n][top]!r}::DOUBLE)"

    def distance(group: str, level: str) -> str:
        whens = []
        for key, highest in scores.HIGHEST4[group].items():
            steps = [[step(*part.split(":")) for part in h.split("/")] for h in highest]
            whens.append(f"WHEN '{key}' THEN coalesce(" + ", ".join("CASE WHEN " + " AND ".join(f"{x} > -0.05" for x in one) + " THEN " + " + ".join(one) + " END" for one in steps) + ")")
        return f"CASE {level} {' '.join(whens)} END"

    depth = lambda group, level: f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v * 0.1!r}::DOUBLE" for k, v in scores.DEPTH4[group].items()) + " END"
    cost = lambda **up: "(100 - " + " - ".join(f"{c} * ({q}::INT + {up.get(q, 0)})" for q, c in COSTS4.items()) + ") / 10.0::DOUBLE"
    level = {"eq1": "eq1", "eq2": "eq2", "eq3eq6": "eq3 || eq6", "eq4": "eq4"}
    lower = {
        "eq1": f"CASE WHEN eq1 < '2' THEN {cost(eq1=1)} END", "eq2": f"CASE WHEN eq2 < '1' THEN {cost(eq2=1)} END", "eq4": f"CASE WHEN eq4 < '2' THEN {cost(eq4=1)} END",
        "eq3eq6": f"CASE eq3 || eq6 WHEN '11' THEN {cost(eq3=1)} WHEN '01' THEN {cost(eq3=1)} WHEN '10' THEN {cost(eq6=1)} WHEN '00' THEN greatest({cost(eq3=1)}, {cost(eq6=1)}) END",
    }
    groups = list(level)
    return f"""
WITH x AS (SELECT p_partkey, {vector_sql('4.0')}{more} AS v FROM part),
e AS (SELECT p_partkey, {', '.join(f'{own[n]} AS e_{n}' for n in own)} FROM x),
q AS (SELECT *, CASE WHEN e_AV = 'N' AND e_PR = 'N' AND e_UI = 'N' THEN '0' WHEN (e_AV = 'N' OR e_PR = 'N' OR e_UI = 'N') AND e_AV <> 'P' THEN '1' ELSE '2' END AS eq1,
 CASE WHEN e_AC = 'L' AND e_AT = 'N' THEN '0' ELSE '1' END AS eq2, CASE WHEN e_VC = 'H' AND e_VI = 'H' THEN '0' WHEN e_VC = 'H' OR e_VI = 'H' OR e_VA = 'H' THEN '1' ELSE '2' END AS eq3,
 CASE WHEN e_MSI = 'S' THEN '0' WHEN e_SC = 'H' OR e_SI = 'H' OR e_SA = 'H' THEN '1' ELSE '2' END AS eq4, CASE e_E WHEN 'A' THEN '0' WHEN 'P' THEN '1' ELSE '2' END AS eq5,
 CASE WHEN (e_VC = 'H' AND e_CR = 'H') OR (e_VI = 'H' AND e_IR = 'H') OR (e_VA = 'H' AND e_AR = 'H') THEN '0' ELSE '1' END AS eq6 FROM e),
t AS (SELECT *, {cost()} AS value, CASE WHEN eq5 < '2' THEN 1 ELSE 0 END AS c5, {', '.join(f'{lower[g]} AS t_{g}' for g in groups)}, {', '.join(f'{distance(g, level[g])} AS d_{g}' for g in groups)}, {', '.join(f'{depth(g, level[g])} AS m_{g}' for g in groups)} FROM q),
m AS (SELECT *, {' + '.join(f'd_{g}' for g in groups)} IS NOT NULL AS complete, c5 + {' + '.join(f'CASE WHEN t_{g} IS NULL THEN 0 ELSE 1 END' for g in groups)} AS n FROM t),
s AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE ({' + '.join(f'CASE WHEN t_{g} IS NULL THEN 0.0::DOUBLE ELSE (value - t_{g}) * ((CASE WHEN complete THEN d_{g} ELSE 0.0::DOUBLE END) / m_{g}) END' for g in groups)}) / n END AS mean FROM m),
r AS (SELECT *, least(greatest(value - mean, 0), 10)::DOUBLE AS x, {' AND '.join(f"e_{n} = 'N'" for n in ('VC', 'VI', 'VA', 'SC', 'SI', 'SA'))} AS harmless FROM s)
SELECT p_partkey, eq1 || eq2 || eq3 || eq4 || eq5 || eq6 AS macro, CASE WHEN harmless THEN 0 ELSE round(CAST(x AS DECIMAL(20, 10)), 1)::DOUBLE END AS score_decimal,
 CASE WHEN harmless THEN 0 ELSE floor(x * 10 + 0.5) / 10 END::DOUBLE AS score_js, CASE WHEN harmless THEN 0 ELSE round(x, 6) END::DOUBLE AS score_none FROM r"""


@query(_score4_sql())
def score_v4(spark, sf):
    """Scores by a table that a rule makes; the standard's own is a parameter (``scores.read_score_table``)."""
    more = [F.concat(F.lit(f"{n}:"), F.substring(F.lit(letters), (F.floor(F.col("p_partkey") / div) % 4 + 1).cast("int"), F.lit(1))) for n, letters, div in _MORE4]
    lookup = scores.score_table(rule_table())
    m = A.vectors(spark, sf, "4.0").select("p_partkey", vectors.components(F.concat_ws("/", "vector", *more)).alias("m"))
    return m.select("p_partkey", scores.macro_vector(F.col("m")).alias("macro"), *[scores.score_v4(F.col("m"), lookup, r).alias(f"score_{r}") for r in scores.ROUNDINGS])


@query("SELECT p_partkey, round(floor(x * 10 + 0.5) / 10, 6) AS js, round(CAST(x AS DECIMAL(20, 10)), 1)::DOUBLE AS dec FROM (SELECT p_partkey, p_retailprice / 100.0 AS x FROM part)")
def rounding_policies(spark, sf):
    x = F.col("p_retailprice") / 100.0
    return table(spark, sf, "part").select("p_partkey", scores.round_js(x).alias("js"), scores.round_decimal(x).alias("dec"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) // 1000 * 1000 WHEN 1 THEN epoch_us(ts) WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000 ELSE -1 END AS micros FROM events")
def utc_parse(spark, sf):
    """The events' times, written without a zone, with Z, with an offset, and as no time at all, and parsed again."""
    e = table(spark, sf, "events").select("event_id", F.timestamp_micros(times.micros(F.col("ts"))).alias("t"))
    ahead = F.timestamp_micros(F.unix_micros("t") + 7_200_000_000)
    forms = [F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.concat(F.date_format(ahead, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), F.lit("??"), F.lit("")]
    written = e.select("event_id", F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int")).alias("text"))
    return written.select("event_id", F.coalesce(times.micros(times.parse_utc(F.col("text"))), F.lit(-1)).alias("micros"))


@query("SELECT DISTINCT date_trunc('month', CAST(o_orderdate AS DATE))::DATE::VARCHAR AS start, g::DATE::VARCHAR AS first, least(g::DATE + 119, (date_trunc('month', CAST(o_orderdate AS DATE)) + INTERVAL 1 YEAR)::DATE)::VARCHAR AS last FROM orders, LATERAL (SELECT unnest(generate_series(date_trunc('month', CAST(o_orderdate AS DATE)), date_trunc('month', CAST(o_orderdate AS DATE)) + INTERVAL 1 YEAR, INTERVAL 120 DAY)) AS g)")
def date_windows(spark, sf):
    m = table(spark, sf, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("start")).distinct()
    w = m.select("start", F.explode(times.date_windows(F.col("start"), F.add_months("start", 12))).alias("w"))
    return w.select(*[F.col(c).cast("string").alias(c.split(".")[-1]) for c in ("start", "w.first", "w.last")])
