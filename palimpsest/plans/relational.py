"""Scans, joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import corpus, evaluate, splits, stats, timeline
from palimpsest.plans.catalogue import query
from palimpsest.sources import adapters as A
from palimpsest.sources.adapters import A1, A2, A3, table


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase') AND value > 50")
def scan_project_filter(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("click", "purchase") & (F.col("value") > 50)).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT CASE source WHEN 'src0' THEN 'MAIN' WHEN 'src1' THEN 'SECOND' ELSE source END AS source_key, count(*) AS n FROM documents GROUP BY 1")
def alias_lookup_default_self(spark, sf):
    key = timeline.alias(F.col("source"), {"src0": "MAIN", "src1": "SECOND"})
    return table(spark, sf, "documents").groupBy(key.alias("source_key")).agg(F.count("*").alias("n"))


_REASON = "CASE WHEN coalesce(text, '') = '' THEN 'EMPTY' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'JUNK' WHEN length(text) < 100 THEN 'SHORT' WHEN contains(lower(text), 'license') THEN 'FORBIDDEN' END"


@query(f"SELECT doc_id, coalesce({_REASON}, 'ACCEPTED') AS reason FROM documents")
def eligibility_first_reason(spark, sf):
    t = F.col("text")
    reason = F.when(F.coalesce(t, F.lit("")) == "", "EMPTY").when(t.rlike("[#$%&*]{3}"), "JUNK").when(F.length(t) < 100, "SHORT").when(text.contains_any(t, ("license",)), "FORBIDDEN")
    ok, out = corpus.admit(table(spark, sf, "documents"), reason)
    return ok.select("doc_id", F.lit("ACCEPTED").alias("reason")).union(out.select("doc_id", "reason"))


@query("SELECT CASE WHEN source IN ('src1', 'src2', 'src3') THEN source ELSE 'OTHER_SOURCE' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def source_bucket_counts(spark, sf):
    return table(spark, sf, "documents").groupBy(corpus.source_bucket(F.col("source"), ("src1", "src2", "src3")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join_entities(spark, sf):
    o = table(spark, sf, "orders")
    big = o.where(F.col("o_totalprice") > 400_000).select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").join(big, "c_custkey", "left_semi")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join_missing(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT event_type, tau, lam, count(*) AS n, round(sum(value * lam / tau), 2) AS weighted FROM events, (VALUES (30.0::DOUBLE), (180.0), (365.0)) t(tau), (VALUES (0.1::DOUBLE), (0.3), (0.5)) l(lam) GROUP BY ALL", digits=2)
def cross_grid(spark, sf):
    grid = spark.createDataFrame([(t, w) for t in (30.0, 180.0, 365.0) for w in (0.1, 0.3, 0.5)], "tau double, lam double")
    return table(spark, sf, "events").join(F.broadcast(grid)).groupBy("event_type", "tau", "lam").agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("lam") / F.col("tau")).alias("weighted"))


@query("SELECT CAST(coalesce(a.k, b.k) AS BIGINT) AS k, a.v AS left_value, b.v AS right_value FROM (SELECT c_nationkey AS k, count(*)::DOUBLE AS v FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*)::DOUBLE AS v FROM supplier GROUP BY 1) b ON a.k = b.k WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 1e-9")
def full_outer_reconcile(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").cast("double").alias("value"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").cast("double").alias("value"))
    return stats.reconcile(a, b, ["k"])


_PERIOD = "SELECT o_custkey, bool_or(year(o_orderdate) IN (1992, 1993, 1994, 1995, 1996)) AS tr, bool_or(year(o_orderdate) IN (1997, 1998, 1999, 2000, 2001)) AS te FROM orders GROUP BY 1"
_YEARS = {"train_years": (1992, 1993, 1994, 1995, 1996), "test_years": (1997, 1998, 1999, 2000, 2001)}


@query(f"SELECT c_custkey AS entity, CASE WHEN tr AND CAST('0x' || left(md5('20260915|' || c_custkey), 8) AS BIGINT) / 4294967296.0 < 0.15 THEN 'dev' WHEN tr THEN 'train' WHEN te THEN 'test' ELSE 'corpus_only' END AS split FROM customer LEFT JOIN ({_PERIOD}) ON o_custkey = c_custkey")
def temporal_split(spark, sf):
    from palimpsest.config import Splits

    cfg = Splits(**_YEARS)
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"))
    entities = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"))
    return splits.assign(entities, splits.periods(o, "entity", "year", cfg), "entity", splits.hash_sample(entities, "entity", 0.15, cfg.seed))


@query("SELECT c_custkey FROM customer WHERE CAST('0x' || left(md5('7|' || c_custkey), 8) AS BIGINT) / 4294967296.0 < 0.1")
def seeded_dev_sample(spark, sf):
    return splits.hash_sample(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 0.1, 7)


@query()
def seeded_generator_sample(spark, sf):
    return splits.seeded_sample(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 0.15, 20260915)


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def count_by_keys(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS large, count(*) FILTER (WHERE l_discount = 0) AS plain, round(count(*) FILTER (WHERE l_quantity > 25) * 1.0 / count(*), 6) AS ratio FROM lineitem GROUP BY 1")
def conditional_counts(spark, sf):
    large = F.count_if(F.col("l_quantity") > 25)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(large.alias("large"), F.count_if(F.col("l_discount") == 0).alias("plain"), F.try_divide(large.cast("double"), F.count("*")).alias("ratio"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT struct_pack(a := user_id, b := CAST(ts AS DATE))) AS user_days FROM events GROUP BY 1")
def distinct_per_group(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.struct("user_id", F.to_date("ts"))).alias("user_days"))


@query("SELECT source, CAST(sum(c - 1) AS BIGINT) AS duplicates, count(*) AS groups FROM (SELECT source, text, count(*) AS c FROM documents GROUP BY 1, 2) WHERE c > 1 GROUP BY 1")
def dup_groups(spark, sf):
    twice = table(spark, sf, "documents").groupBy("source", "text").agg(F.count("*").alias("c")).where("c > 1")
    return twice.groupBy("source").agg(F.sum(F.col("c") - 1).alias("duplicates"), F.count("*").alias("groups"))


@query("SELECT least(n, 3) AS bucket, count(*) AS entities FROM (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1) GROUP BY 1")
def sources_per_entity_hist(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n"))
    return per.groupBy(F.least("n", F.lit(3)).alias("bucket")).agg(F.count("*").alias("entities"))


@query("SELECT o_orderpriority, round(min(o_totalprice), 4) AS lo, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(median(o_totalprice), 4) AS mid, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(max(o_totalprice), 4) AS hi, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1", digits=4)
def quantile_linear(spark, sf):
    p = lambda q: F.percentile("o_totalprice", F.lit(q))
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("lo"), p(0.25).alias("p25"), p(0.5).alias("mid"), p(0.75).alias("p75"), F.max("o_totalprice").alias("hi"), F.avg("o_totalprice").alias("mean"))


@query("SELECT user_id, s[least(len(s) - 1, CAST(floor(0.25 * len(s)) AS BIGINT)) + 1] AS p25, s[least(len(s) - 1, CAST(floor(0.9 * len(s)) AS BIGINT)) + 1] AS p90 FROM (SELECT user_id, list_sort(list(value)) AS s FROM events GROUP BY 1)")
def quantile_lower_index(spark, sf):
    return evaluate.at_place(table(spark, sf, "events"), ["user_id"], "value", p25=evaluate.lower_quantile(0.25), p90=evaluate.lower_quantile(0.9))


@query("SELECT user_id, s[len(s) // 2 + 1] AS upper_median FROM (SELECT user_id, list_sort(list(value)) AS s FROM events GROUP BY 1)")
def median_upper(spark, sf):
    return evaluate.at_place(table(spark, sf, "events"), ["user_id"], "value", upper_median=evaluate.upper_median)


@query(f"WITH {A3} SELECT signature, count(*) AS changes FROM (SELECT change_id, string_agg(action || ':' || source, ',' ORDER BY action, source) AS signature FROM a3 GROUP BY 1) GROUP BY 1")
def action_signature(spark, sf):
    per = A.actions(spark, sf).groupBy("change_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("action", "source"))), lambda x: F.concat(x["action"], F.lit(":"), x["source"])), ",").alias("signature"))
    return per.groupBy("signature").agg(F.count("*").alias("changes"))


@query(f"WITH {A3} SELECT change_id, source, count(*) FILTER (WHERE action = 'Removed') AS removed, count(*) FILTER (WHERE action = 'Added') AS added FROM a3 GROUP BY 1, 2 HAVING removed > 0 AND added > 0")
def removed_added_pairs(spark, sf):
    c = lambda a: F.count_if(F.col("action") == a)
    return A.actions(spark, sf).groupBy("change_id", "source").agg(c("Removed").alias("removed"), c("Added").alias("added")).where("removed > 0 AND added > 0")


@query("SELECT event_type, event_id, n FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5")
def top_examples_per_group(spark, sf):
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("event_type", "event_id", n.alias("n")).where("n <= 5")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def topk_by_count(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("SELECT doc_id, round(CASE WHEN max(n_chars) OVER w - min(n_chars) OVER w < 1e-12 THEN 0 ELSE (n_chars - min(n_chars) OVER w) * 1.0 / (max(n_chars) OVER w - min(n_chars) OVER w) END, 6) AS scaled FROM documents WINDOW w AS (PARTITION BY lang)")
def minmax_normalise(spark, sf):
    from palimpsest.operators.ranking import minmax

    return table(spark, sf, "documents").select("doc_id", minmax("n_chars", "lang").alias("scaled"))


@query(f"WITH p AS ({_PERIOD}) SELECT CASE WHEN tr AND te THEN 'both' WHEN tr THEN 'train_only' WHEN te THEN 'test_only' ELSE 'neither' END AS membership, count(*) AS entities FROM p GROUP BY 1")
def set_ops_periods(spark, sf):
    from palimpsest.config import Splits

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"))
    p = splits.periods(o, "entity", "year", Splits(**_YEARS))
    name = F.when(F.col("in_train") & F.col("in_test"), "both").when(F.col("in_train"), "train_only").when(F.col("in_test"), "test_only").otherwise("neither")
    return p.groupBy(name.alias("membership")).agg(F.count("*").alias("entities"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0")
def cache_antijoin(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id")
    return v.join(v.where("vec_id % 3 = 0"), "vec_id", "left_anti")


@query("SELECT gate, violations, violations = 0 AS passed FROM (SELECT 'negative_price' AS gate, count(*) FILTER (WHERE l_extendedprice < 0) AS violations FROM lineitem UNION ALL SELECT 'large_discount', count(*) FILTER (WHERE l_discount > 0.05) FROM lineitem UNION ALL SELECT 'no_quantity', count(*) FILTER (WHERE l_quantity <= 0) FROM lineitem)")
def quality_gates(spark, sf):
    from palimpsest.operators import gates

    return gates.check(table(spark, sf, "lineitem"), {"negative_price": F.col("l_extendedprice") < 0, "large_discount": F.col("l_discount") > 0.05, "no_quantity": F.col("l_quantity") <= 0})


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 2) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2", digits=2)
def grouped_sums(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02'"))

    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))


@query(f"WITH {A1} SELECT section, key, n FROM (SELECT 'source' AS section, source AS key, count(*) AS n FROM a1 GROUP BY 2 UNION ALL SELECT 'value', CAST(value AS VARCHAR), count(*) FROM a1 GROUP BY 2 UNION ALL SELECT 'rows', 'all', count(*) FROM a1)")
def profile_rollup(spark, sf):
    a = A.assertions(spark, sf).withColumn("value", F.col("value").cast("string"))
    g = a.groupingSets([[F.col("source")], [F.col("value")], []], "source", "value").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    section = F.when(F.col("g") == 1, "source").when(F.col("g") == 2, "value").otherwise("rows")
    return g.select(section.alias("section"), F.coalesce("source", "value", F.lit("all")).alias("key"), "n")


@query(f"WITH {A2} SELECT entity, source, count(*) AS n FROM (SELECT *, lead(valid_from) OVER (PARTITION BY entity, source ORDER BY valid_from) AS nf FROM a2) WHERE nf IS NOT NULL AND (valid_until IS NULL OR nf < valid_until) GROUP BY 1, 2")
def timeline_overlap_check(spark, sf):
    return timeline.overlaps(A.intervals(spark, sf), ["entity", "source"], "valid_from", "valid_until").groupBy("entity", "source").agg(F.count("*").alias("n"))
