"""Queries of the table layer: joins, rates, profiles, breaks, ranks, checks, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.functions.columns import break_label, full_address, geoid, no_sentinel, smart_round, to_numeric, travel_minutes
from arealis.operators import catalog, classify, clean, joins, profile, quality, rank, rates, reports
from arealis.plans.registry import Tables, query, r6, select6
from arealis.sources import payloads
from arealis.sources.tables import run_sql


def _by_nation(t: Tables) -> DataFrame:
    """Returned and shipped quantity of each nation's customers, with taxes as margins."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    return lines.groupBy(F.col("c_nationkey").alias("area")).agg(F.sum(returned).alias("num"), F.sum("l_quantity").alias("den"), F.sum("l_tax").alias("moe_num"), F.sum(F.col("l_tax") * 2).alias("moe_den"))


_BY_NATION = """
SELECT c_nationkey AS area, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS num, sum(l_quantity) AS den,
       sum(l_tax) AS moe_num, sum(l_tax * 2) AS moe_den
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"""


@query(f"""
WITH a AS ({_BY_NATION}), r AS (
  SELECT n_name AS name, num / nullif(den, 0) * 100 AS rate,
         sqrt(moe_num ** 2 + (num / nullif(den, 0) * moe_den) ** 2) / nullif(den, 0) * 100 AS rate_moe
  FROM nation LEFT JOIN a ON n_nationkey = area)
SELECT name, round(rate, 6) AS rate, round(rate_moe, 6) AS rate_moe,
       coalesce(NOT rate_moe > abs(rate) * 0.5, true) AND rate IS NOT NULL AS rate_reliable,
       CASE WHEN rate IS NOT NULL THEN row_number() OVER (ORDER BY round(rate, 6) DESC NULLS LAST, name) END AS rank
FROM r""")
def area_rate_ranked(t: Tables) -> DataFrame:
    areas = t.nation.select(F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("name"))
    joined = joins.join_data(areas, _by_nation(t), "area_id", "area")
    out = rates.compute_rate(joined, "num", "den", "rate", "moe_num", "moe_den").withColumn("rate", F.round("rate", 6))
    return rank.row_rank(out, "rate", ["name"], descending=True).select("name", "rate", r6("rate_moe"), "rate_reliable", "rank")


@query("""
WITH a AS (SELECT c_custkey k, count(*) nl FROM customer GROUP BY 1), b AS (SELECT o_custkey k, count(*) nr FROM orders GROUP BY 1),
j AS (SELECT nl, nr FROM a FULL JOIN b USING (k))
SELECT CAST(sum(nl) AS BIGINT) left_rows, CAST(sum(nr) AS BIGINT) right_rows, count(nl) left_keys, count(nr) right_keys,
       count(*) FILTER (WHERE nl IS NOT NULL AND nr IS NOT NULL) matched, count(*) FILTER (WHERE nr IS NULL) left_only,
       count(*) FILTER (WHERE nl IS NULL) right_only, count(*) FILTER (WHERE nr > 1) right_duplicates,
       round(100.0 * count(*) FILTER (WHERE nl IS NOT NULL AND nr IS NOT NULL) / nullif(count(nl), 0), 2) match_pct FROM j""")
def join_diagnostics(t: Tables) -> DataFrame:
    return joins.join_diagnostics(t.customer, t.orders, "c_custkey", "o_custkey").withColumn("match_pct", F.col("match_pct").cast("double"))


@query("""
SELECT CASE WHEN l.k IS NOT NULL AND r.k IS NOT NULL THEN 'both' WHEN l.k IS NOT NULL THEN 'left' ELSE 'right' END AS side, count(*) n
FROM (SELECT DISTINCT c_custkey k FROM customer) l FULL JOIN (SELECT DISTINCT o_custkey k FROM orders) r ON l.k = r.k GROUP BY 1""")
def key_set_sizes(t: Tables) -> DataFrame:
    a, b = t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k"))
    return joins.key_sets(a, b, "k").groupBy("side").agg(F.count("*").alias("n"))


@query("""
SELECT n_nationkey AS k, n_name, c.n, c.bal, s.n AS s_n, s.bal AS s_bal
FROM nation LEFT JOIN (SELECT c_nationkey k, count(*) n, round(sum(c_acctbal), 4) bal FROM customer GROUP BY 1) c ON c.k = n_nationkey
LEFT JOIN (SELECT s_nationkey k, count(*) n, round(sum(s_acctbal), 4) bal FROM supplier GROUP BY 1) s ON s.k = n_nationkey""")
def batch_join_chain(t: Tables) -> DataFrame:
    base = t.nation.select(F.col("n_nationkey").alias("k"), "n_name")
    c = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 4).alias("bal"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 4).alias("bal"))
    return joins.batch_join(base, {"c": c, "s": s}, "k")


@query("""
WITH j AS (SELECT c_custkey, o_totalprice, o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) o_totalprice, max(o_orderstatus) o_orderstatus FROM orders GROUP BY 1) ON c_custkey = o_custkey)
SELECT count(*) AS "rows", count(DISTINCT c_custkey) unique_keys, count(DISTINCT c_custkey) = count(c_custkey) key_unique,
       round(100.0 * count(coalesce(CAST(o_totalprice AS VARCHAR), o_orderstatus)) / count(*), 2) any_pct,
       round(100.0 * count(o_totalprice) / count(*), 2) o_totalprice_pct, round(100.0 * count(o_orderstatus) / count(*), 2) o_orderstatus_pct FROM j""")
def join_coverage(t: Tables) -> DataFrame:
    o = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"), F.max("o_orderstatus").alias("o_orderstatus"))
    j = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    out = joins.join_coverage(j, "c_custkey", ["o_totalprice", "o_orderstatus"])
    return out.withColumns({c: F.col(c).cast("double") for c in out.columns if c.endswith("_pct")})


_STATS = """count(v) n, round(avg(v), 6) mean, round(stddev_samp(v), 6) std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) p25, round(quantile_cont(v, 0.5), 6) median,
round(quantile_cont(v, 0.75), 6) p75, round(max(v), 6) AS max, count(*) FILTER (WHERE v IS NULL) nulls"""


@query(f"""
SELECT field, {_STATS} FROM (
  SELECT 'p_size' AS field, CAST(p_size AS DOUBLE) v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) GROUP BY field""")
def summary_stats(t: Tables) -> DataFrame:
    return select6(profile.summary_stats(t.part, ["p_size", "p_retailprice"]), "field")


@query(f"""
SELECT project, field, {_STATS}, round(quantile_cont(v, 0.9), 6) p90, round(quantile_cont(v, 0.95), 6) p95 FROM (
  SELECT c_mktsegment AS project, 'c_acctbal' AS field, c_acctbal AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) GROUP BY project, field""")
def compare_projects(t: Tables) -> DataFrame:
    c = t.customer
    return select6(profile.compare({s: c.where(F.col("c_mktsegment") == s) for s in ("BUILDING", "MACHINERY")}, ["c_acctbal"]), "project", "field")


@query("""
WITH l AS (SELECT 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT 'p_type', p_type FROM part)
SELECT field, CASE field WHEN 'p_size' THEN 'int' ELSE 'string' END AS type, round(100.0 * count(*) FILTER (WHERE value IS NULL) / count(*), 2) null_pct,
       count(DISTINCT value) distinct_values, min(value) first_value, max(value) last_value,
       CASE WHEN count(DISTINCT value) <= 10 THEN array_to_string(list_sort(list(DISTINCT value)), '|') END AS value_list FROM l GROUP BY field""")
def data_dictionary(t: Tables) -> DataFrame:
    return profile.data_dictionary(t.part.select("p_brand", "p_size", "p_type")).withColumn("null_pct", F.col("null_pct").cast("double"))


@query("""
WITH l AS (SELECT 'o_orderstatus' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
c AS (SELECT field, value, count(*) n FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT * FROM (SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS place FROM c) WHERE place <= 3""")
def catalog_top3(t: Tables) -> DataFrame:
    return profile.top_values(t.orders, ["o_orderstatus", "o_orderpriority"]).withColumn("place", F.col("place").cast("long"))


@query("SELECT p_brand, count(*) n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def value_counts(t: Tables) -> DataFrame:
    return profile.value_counts(t.part, "p_brand", 10)


@query("""
SELECT field, count(*) FILTER (WHERE v IS NULL) nulls, round(100.0 * count(*) FILTER (WHERE v IS NULL) / count(*), 2) null_pct FROM (
SELECT 'props' AS field, props AS v FROM events UNION ALL SELECT 'value', CAST(value AS VARCHAR) FROM events) GROUP BY field""")
def null_coverage(t: Tables) -> DataFrame:
    return profile.null_coverage(t.events, ["props", "value"]).withColumn("null_pct", F.col("null_pct").cast("double"))


@query("""
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) r FROM lineitem UNION ALL
SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL
SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem""")
def correlation_matrix(t: Tables) -> DataFrame:
    return select6(profile.correlation(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]), "a", "b")


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 6) slope, round(regr_intercept(l_extendedprice, l_quantity), 5) intercept,
round(regr_r2(l_extendedprice, l_quantity), 6) r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) n FROM lineitem""")
def ols_simple(t: Tables) -> DataFrame:
    return profile.ols(t.lineitem, "l_quantity", "l_extendedprice").select(r6("slope"), F.round("intercept", 5).alias("intercept"), r6("r2"), "n")


@query("""
WITH e AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, lo, (hi - lo) / 30 AS w FROM lineitem, e)
SELECT bin, round(min(lo + bin * w), 4) bin_start, count(*) n FROM b GROUP BY bin""")
def histogram(t: Tables) -> DataFrame:
    return profile.histogram(t.lineitem, "l_extendedprice", 30).withColumn("bin_start", F.round("bin_start", 4))


@query("""
WITH a AS (SELECT (l_quantity * (sqrt(3) / 3) - l_discount * 100 / 3) / 5 AS q, l_discount * 100 * (2.0 / 3) / 5 AS r FROM lineitem),
b AS (SELECT q, r, -q - r AS s, round(q) rq, round(r) rr, round(-q - r) rs FROM a),
c AS (SELECT *, abs(rq - q) dq, abs(rr - r) dr, abs(rs - s) ds FROM b)
SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) q,
       CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) r, count(*) n FROM c GROUP BY 1, 2""")
def hexbin(t: Tables) -> DataFrame:
    return profile.hexbin(t.lineitem.withColumn("d", F.col("l_discount") * 100), "l_quantity", "d", 5.0)


@query("""
WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) q1, quantile_cont(p_retailprice, 0.5) median, quantile_cont(p_retailprice, 0.75) q3 FROM part GROUP BY 1),
j AS (SELECT p.p_brand, p_retailprice v, q1, median, q3, p_retailprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM part p JOIN q USING (p_brand))
SELECT p_brand, round(q1, 6) q1, round(median, 6) median, round(q3, 6) q3, round(min(v) FILTER (WHERE inside), 6) whisker_low, round(max(v) FILTER (WHERE inside), 6) whisker_high,
       count(*) FILTER (WHERE NOT inside) outliers FROM j GROUP BY 1, q1, median, q3""")
def box_stats(t: Tables) -> DataFrame:
    return select6(profile.box_stats(t.part, "p_retailprice", "p_brand"), "p_brand")


@query("""
SELECT c_mktsegment, n, bal, round(n + bal, 4) AS total FROM (SELECT c_mktsegment, CAST(count(*) AS DOUBLE) n, round(sum(c_acctbal), 4) bal FROM customer GROUP BY 1) ORDER BY total DESC, c_mktsegment LIMIT 3""")
def category_bars(t: Tables) -> DataFrame:
    c = t.customer.groupBy("c_mktsegment").agg(F.count("*").cast("double").alias("n"), F.round(F.sum("c_acctbal"), 4).alias("bal"))
    return profile.category_bars(c, "c_mktsegment", ["n", "bal"], 3).withColumn("total", F.round("total", 4))


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) n, round(sum(o_totalprice), 2) v FROM orders GROUP BY 1, 2""")
def time_series(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("v")).orderBy("o_orderstatus", "month")


@query("""
SELECT event_type, CAST(hour(ts) AS VARCHAR) bucket, count(*) events, count(DISTINCT CAST(ts AS DATE)) AS days, round(count(*) / count(DISTINCT CAST(ts AS DATE)), 6) per_day FROM events GROUP BY 1, 2""")
def temporal_profile(t: Tables) -> DataFrame:
    return select6(profile.temporal_profile(t.events, "ts", "hour", by=["event_type"]), "event_type", "bucket")


@query("""
SELECT CASE floor(month(ts) % 12 / 3) WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'autumn' END AS bucket, count(*) events,
count(DISTINCT CAST(ts AS DATE)) AS days, round(count(*) / count(DISTINCT CAST(ts AS DATE)), 6) per_day FROM events GROUP BY 1""")
def seasonal_profile(t: Tables) -> DataFrame:
    return select6(profile.temporal_profile(t.events, "ts", "season"), "bucket")


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, " + ", ".join(f"nullif(count(*) FILTER (WHERE isodow(ts) - 1 = {d}), 0) AS d{d}" for d in range(7)) + " FROM events GROUP BY 1")
def hour_weekday(t: Tables) -> DataFrame:
    return profile.hour_weekday(t.events, "ts").withColumnsRenamed({str(d): f"d{d}" for d in range(7)})


@query("""
SELECT n_regionkey AS region, round(sum(n * w), 4) n, round(sum(bal * w), 4) bal, round(100 * sum(bal * w) / nullif(sum(n * w), 0), 4) AS mean_pct
FROM (SELECT c_nationkey k, CAST(count(*) AS DOUBLE) n, sum(c_acctbal) bal FROM customer GROUP BY 1) JOIN (SELECT n_nationkey k, n_regionkey, (n_nationkey % 4 + 1) / 4.0 AS w FROM nation) USING (k) GROUP BY 1""")
def rollup_by_class(t: Tables) -> DataFrame:
    c = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").cast("double").alias("n"), F.sum("c_acctbal").alias("bal"))
    x = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("region"), ((F.col("n_nationkey") % 4 + 1) / 4.0).alias("weight"))
    out = profile.rollup(c, x, "k", "region", ["n", "bal"], {"mean_pct": ("bal", "n")})
    return out.select("region", *(F.round(c, 4).alias(c) for c in ("n", "bal", "mean_pct")))


@query("""
SELECT x.n_regionkey AS origin_area, y.n_regionkey AS destination_area, round(sum(v), 2) flow, count(*) pairs
FROM (SELECT c_nationkey o, s_nationkey d, sum(l_extendedprice) v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
JOIN nation x ON o = x.n_nationkey JOIN nation y ON d = y.n_nationkey GROUP BY 1, 2""")
def od_flows(t: Tables) -> DataFrame:
    f = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    f = f.groupBy(F.col("c_nationkey").alias("o"), F.col("s_nationkey").alias("d")).agg(F.sum("l_extendedprice").alias("v"))
    out = profile.od_flows(f, t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("area")), "o", "d", "v")
    return out.withColumn("flow", F.round("flow", 2))


@query("""SELECT field, value, count(*) n FROM (SELECT 'c_mktsegment' AS field, c_mktsegment AS value FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer) GROUP BY 1, 2""")
def facet_counts(t: Tables) -> DataFrame:
    return profile.facet_counts(t.customer, ["c_mktsegment", "c_nationkey"])


@query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS i, percent_rank() OVER (ORDER BY p_retailprice) AS p FROM part)
SELECT p_partkey, round(p, 6) AS pct_rank, CAST(least(floor(p * 5) + 1, 5) AS INTEGER) AS tile FROM r""")
def pct_rank(t: Tables) -> DataFrame:
    return rank.pct_rank(t.part, "p_retailprice").select("p_partkey", r6("pct_rank"), "tile")


def _year(t: Tables, year: int) -> DataFrame:
    o = t.orders.where(F.year("o_orderdate") == year).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").cast("string").alias("geoid")).agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("v"))


_YEAR = "SELECT CAST(c_nationkey AS VARCHAR) geoid, CAST(count(*) AS DOUBLE) n, sum(o_totalprice) v FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = {} GROUP BY 1"
_CHANGE = f"SELECT b.geoid, b.n n_base, c.n n_current, c.n - b.n AS n_change, (c.n - b.n) / nullif(abs(b.n), 0) * 100 n_change_pct FROM ({_YEAR.format(1995)}) b LEFT JOIN ({_YEAR.format(1998)}) c USING (geoid)"


@query(f"SELECT geoid, n_base, n_current, n_change, round(n_change_pct, 6) n_change_pct FROM ({_CHANGE})")
def change_detection(t: Tables) -> DataFrame:
    return select6(rates.change_detection(_year(t, 1995), _year(t, 1998), ["n"], "geoid"), "geoid")


@query(f"""SELECT round(avg(n_change), 6) mean_change, quantile_cont(n_change, 0.5) median_change, min(n_change) min_change, max(n_change) max_change, count(*) FILTER (WHERE n_change > 0) improved,
count(*) FILTER (WHERE n_change < 0) worsened, count(*) FILTER (WHERE n_change = 0) unchanged, count(*) FILTER (WHERE n_change IS NULL) no_data FROM ({_CHANGE})""")
def change_summary(t: Tables) -> DataFrame:
    return select6(rates.change_summary(rates.change_detection(_year(t, 1995), _year(t, 1998), ["n"], "geoid"), "n"))


@query(f"SELECT b.geoid, round(CASE WHEN b.v > 0 AND c.v > 0 THEN pow(c.v / b.v, 1.0 / 3) - 1 END, 6) AS growth FROM ({_YEAR.format(1995)}) b JOIN ({_YEAR.format(1998)}) c USING (geoid)")
def cagr(t: Tables) -> DataFrame:
    j = _year(t, 1995).select("geoid", F.col("v").alias("v0")).join(_year(t, 1998).select("geoid", F.col("v").alias("v1")), "geoid")
    return j.select("geoid", r6(rates.cagr(F.col("v0"), F.col("v1"), 3), "growth"))


def _urgent(t: Tables, year: int, p: str, w: str) -> DataFrame:
    return t.orders.where(F.year("o_orderdate") == year).groupBy((F.col("o_custkey") % 25).alias("area")).agg(F.count_if(F.col("o_orderpriority").startswith("1")).alias(p), F.count("*").alias(w))


_URGENT = "SELECT o_custkey % 25 AS area, count(*) FILTER (WHERE starts_with(o_orderpriority, '1')) p, count(*) w FROM orders WHERE year(o_orderdate) = {} GROUP BY 1"


@query(f"""SELECT area, round(100.0 * a.p / a.w, 6) share_base, round(100.0 * b.p / b.w, 6) share_current, round(100.0 * b.p / b.w - 100.0 * a.p / a.w, 6) share_points, b.p - a.p AS count_change
FROM ({_URGENT.format(1995)}) a JOIN ({_URGENT.format(1998)}) b USING (area)""")
def share_shift(t: Tables) -> DataFrame:
    j = _urgent(t, 1995, "p0", "w0").join(_urgent(t, 1998, "p1", "w1"), "area")
    j = j.withColumns({c: F.col(c).cast("double") for c in ("p0", "p1", "w0", "w1")})
    out = rates.share_shift(j, "p0", "w0", "p1", "w1")
    return out.select("area", r6("share_base"), r6("share_current"), r6("share_points"), F.col("count_change").cast("long").alias("count_change"))


_RELIABLE = """SELECT l_orderkey, l_linenumber, l_tax * 100 / 1.645 / nullif(abs(l_quantity), 0) * 100 AS cv, CASE WHEN l_quantity IS NULL OR abs(l_quantity) < 1e-9 THEN 'Effectively Zero'
WHEN l_tax * 100 > abs(l_quantity) THEN 'Essentially Meaningless' WHEN l_tax * 100 / 1.645 / abs(l_quantity) * 100 < 15 THEN 'Reliable' WHEN l_tax * 100 / 1.645 / abs(l_quantity) * 100 < 30 THEN 'Use with Caution' ELSE 'Unreliable' END AS reliability FROM lineitem"""


@query(f"SELECT reliability, count(*) n, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 2) pct, round(avg(cv), 6) mean_cv, round(max(cv), 6) max_cv FROM ({_RELIABLE}) GROUP BY 1")
def reliability_classes(t: Tables) -> DataFrame:
    rows = rates.reliability(t.lineitem.withColumn("moe", F.col("l_tax") * 100), "l_quantity", "moe")
    return select6(rates.reliability_summary(rows).withColumn("pct", F.col("pct").cast("double")), "reliability")


@query("""
WITH e AS (SELECT min(p_retailprice) lo, (max(p_retailprice) - min(p_retailprice)) / 5 AS s FROM part)
SELECT CAST(CASE WHEN p_retailprice <= lo + s THEN 0 WHEN p_retailprice <= lo + s * 2 THEN 1 WHEN p_retailprice <= lo + s * 3 THEN 2 WHEN p_retailprice <= lo + s * 4 THEN 3 ELSE 4 END AS INTEGER) AS class, count(*) n FROM part, e GROUP BY 1""")
def breaks_equal(t: Tables) -> DataFrame:
    return classify.classify(t.part, "p_retailprice", 5, "equal_interval").groupBy("class").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT p_retailprice v, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part),
b AS (SELECT DISTINCT v FROM r, (SELECT unnest(range(0, 6)) AS k) WHERE i = least(n * k // 5, n - 1))
SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS place, v AS edge FROM b""")
def breaks_quantile(t: Tables) -> DataFrame:
    edges = classify.breaks(t.part, "p_retailprice", 5)
    return t.spark.createDataFrame(list(enumerate(edges)), "place int, edge double")


@query("""
WITH s AS (SELECT min(p_retailprice) lo, max(p_retailprice) hi, avg(p_retailprice) m, stddev_samp(p_retailprice) d FROM part),
b AS (SELECT lo AS e FROM s UNION SELECT hi FROM s UNION SELECT m + d * k FROM s, (VALUES (-2), (-1), (1), (2)) t(k) WHERE m + d * k > lo AND m + d * k < hi)
SELECT CAST(row_number() OVER (ORDER BY e) - 1 AS INTEGER) AS place, round(e, 6) AS edge FROM b""")
def breaks_std(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(i, round(e, 6)) for i, e in enumerate(classify.breaks(t.part, "p_retailprice", 5, "std_mean"))], "place int, edge double")


@query("""
WITH e AS (SELECT quantile_cont(p_retailprice, 1.0 / 3) x1, quantile_cont(p_retailprice, 2.0 / 3) x2, quantile_cont(CAST(p_size AS DOUBLE), 1.0 / 3) y1, quantile_cont(CAST(p_size AS DOUBLE), 2.0 / 3) y2 FROM part)
SELECT CAST(((p_size > y1)::INT + (p_size > y2)::INT) * 3 + (p_retailprice > x1)::INT + (p_retailprice > x2)::INT AS INTEGER) AS bivariate, count(*) n FROM part, e GROUP BY 1""")
def bivariate_3x3(t: Tables) -> DataFrame:
    return classify.bivariate(t.part, "p_retailprice", "p_size").groupBy("bivariate").agg(F.count("*").alias("n"))


@query("""
SELECT field, count(DISTINCT v) distinct_values, round(stddev_samp(v), 6) std, count(DISTINCT v) < 5 OR coalesce(stddev_samp(v), 0) < 0.001 AS degenerate
FROM (SELECT 'l_linenumber' AS field, CAST(l_linenumber AS DOUBLE) v FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem) GROUP BY 1""")
def spread_check(t: Tables) -> DataFrame:
    return select6(classify.classification_spread(t.lineitem, ["l_linenumber", "l_quantity"], 5), "field")


@query("""SELECT s_suppkey, round(20 + 780 * sqrt(greatest(s_acctbal, 0)) / (SELECT sqrt(greatest(max(s_acctbal), 0)) FROM supplier), 6) AS size FROM supplier""")
def symbol_sizes(t: Tables) -> DataFrame:
    return classify.sqrt_scale(t.supplier, "s_acctbal").select("s_suppkey", r6("size"))


@query("""
SELECT * FROM (SELECT 'top' AS side, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, c_custkey, c_acctbal, c_name FROM customer) WHERE rank <= 10 UNION ALL
SELECT * FROM (SELECT 'bottom' AS side, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank, c_custkey, c_acctbal, c_name FROM customer) WHERE rank <= 10""")
def top_bottom(t: Tables) -> DataFrame:
    return rank.top_bottom(t.customer, "c_acctbal", 10, "c_custkey", ["c_name"]).withColumn("rank", F.col("rank").cast("long"))


_SITES = "SELECT n_nationkey AS k, count(*) n, sum(s_acctbal) bal FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"
_NORM = f"""SELECT k, coalesce((n - min(n) OVER ()) / nullif(max(n) OVER () - min(n) OVER (), 0), 0.5) AS nn,
coalesce(1 - (bal - min(bal) OVER ()) / nullif(max(bal) OVER () - min(bal) OVER (), 0), 0.5) AS nb FROM ({_SITES})"""


@query(f"SELECT k, score, row_number() OVER (ORDER BY score DESC, k) AS rank FROM (SELECT k, round_even((nn * 0.6 + nb * 0.2 + 0.5 * 0.2) * 100, 1) AS score FROM ({_NORM}))")
def site_scores(t: Tables) -> DataFrame:
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.sum("s_acctbal").alias("bal"))
    return rank.score_sites(s, {"n": (0.6, "higher"), "bal": (0.2, "lower"), "gap_to_nearest": (0.2, "lower")}, "k").select("k", "score", "rank")


@query(f"SELECT k, demand, row_number() OVER (ORDER BY demand DESC, k) AS rank FROM (SELECT k, round_even(n / max(n) OVER () * (bal / max(bal) OVER ()) * 100, 1) AS demand FROM ({_SITES}))")
def demand_scores(t: Tables) -> DataFrame:
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.sum("s_acctbal").alias("bal"))
    return rank.demand_score(s, "n", "bal", "k").select("k", "demand", "rank")


@query("""SELECT p_brand AS name, CASE WHEN p_brand = 'Brand#11' THEN 'Brand#11' WHEN lower(p_brand) = 'brand#12' THEN 'brand#12' WHEN contains(lower(p_brand), 'brand#11') OR contains('brand#11', lower(p_brand)) THEN 'Brand#11' WHEN contains(lower(p_brand), 'brand#12') OR contains('brand#12', lower(p_brand)) THEN 'brand#12' WHEN contains(lower(p_brand), '#2') THEN '#2' WHEN regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') = 'brand33' THEN 'BRAND 33' END AS brand,
CAST(CASE WHEN p_brand = 'Brand#11' THEN 1 WHEN lower(p_brand) = 'brand#12' THEN 2 WHEN contains(lower(p_brand), 'brand#11') OR contains('brand#11', lower(p_brand)) THEN 3 WHEN contains(lower(p_brand), 'brand#12') OR contains('brand#12', lower(p_brand)) THEN 3 WHEN contains(lower(p_brand), '#2') THEN 3 WHEN regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') = 'brand33' THEN 4 END AS INTEGER) AS tier, count(*) n FROM part GROUP BY 1, 2, 3""")
def brand_match(t: Tables) -> DataFrame:
    brands = t.spark.createDataFrame([(1, "Brand#11"), (2, "brand#12"), (3, "#2"), (4, "BRAND 33")], "ordinal int, brand string")
    return joins.brand_match(t.part.select(F.col("p_brand").alias("name")), brands, "name").groupBy("name", "brand", "tier").agg(F.count("*").alias("n"))


@query("""SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'industry' ELSE 'other' END AS category, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'map' ELSE 'escalate' END AS action, count(*) n
FROM customer WHERE c_mktsegment <> 'HOUSEHOLD' GROUP BY 1, 2""")
def category_map(t: Tables) -> DataFrame:
    m = t.spark.createDataFrame([("BUILDING", "construction", "map"), ("MACHINERY", "industry", "map"), ("HOUSEHOLD", "home", "exclude")], "raw string, category string, action string")
    return joins.normalize_category(t.customer, m, "c_mktsegment").groupBy("category", "action").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_brand FROM part WHERE (p_name ILIKE '%a%' OR p_brand ILIKE '%a%' ) AND p_type IN (SELECT min(p_type) FROM part) AND NOT coalesce(p_brand ILIKE '%#1%', false) AND NOT coalesce(p_name ILIKE '%#1%', false)""")
def poi_filter(t: Tables) -> DataFrame:
    shop = t.part.agg(F.min("p_type").alias("t")).first().t
    p = t.part.select("p_partkey", "p_brand", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("shop"))
    return clean.poi_filter(p, brands=["a"], shops=[shop], exclude=["#1"]).select("p_partkey", "p_brand")


@query("""SELECT coalesce(o.o_custkey, c.c_custkey) AS k, CAST(c.n AS BIGINT) left_value, CAST(o.n AS BIGINT) right_value, CASE WHEN c.n IS NULL THEN 'missing_left' WHEN o.n IS NULL THEN 'missing_right' WHEN abs(c.n - o.n) > 0 THEN 'mismatch' WHEN c.n = 0 AND o.n = 0 THEN 'zero' ELSE 'ok' END AS issue
FROM (SELECT c_custkey, c_custkey % 15 AS n FROM customer) c FULL JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def reconcile(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 15).alias("n"))
    return joins.reconcile(a, t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")), "k", "n")


@query("""SELECT c_custkey AS k, coalesce(o.v, s.v) AS v, CASE WHEN o.v IS NOT NULL THEN 'primary' WHEN s.v IS NOT NULL THEN 'fallback' ELSE 'none' END AS source FROM customer
LEFT JOIN (SELECT o_custkey k, max(o_totalprice) v FROM orders GROUP BY 1) o ON o.k = c_custkey LEFT JOIN (SELECT s_suppkey k, s_acctbal v FROM supplier) s ON s.k = c_custkey""")
def coalesce_match(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return joins.coalesce_match(t.customer.select(F.col("c_custkey").alias("k")), a, t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), "k", "v")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_orderkey FROM orders)")
def orphan_refs(t: Tables) -> DataFrame:
    return joins.orphan_refs(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")


@query("""SELECT 'row_count' AS "check", CASE WHEN count(*) >= 100 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL
SELECT 'nulls:o_totalprice', CASE WHEN coalesce(100.0 * count(*) FILTER (WHERE o_totalprice IS NULL) / count(*), 0) <= 50 THEN 'PASS' ELSE 'WARN' END, CAST(round(100.0 * count(*) FILTER (WHERE o_totalprice IS NULL) / count(*), 4) AS DOUBLE) FROM orders UNION ALL
SELECT 'null_rate:o_custkey', CASE WHEN 100.0 * count(*) FILTER (WHERE o_custkey IS NULL) / count(*) <= 15 THEN 'PASS' ELSE 'FAIL' END, CAST(round(100.0 * count(*) FILTER (WHERE o_custkey IS NULL) / count(*), 4) AS DOUBLE) FROM orders UNION ALL
SELECT 'join_rate', CASE WHEN 100.0 * count(c_custkey) / count(*) >= 85 THEN 'PASS' ELSE 'FAIL' END, CAST(round(100.0 * count(c_custkey) / count(*), 4) AS DOUBLE) FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def null_gate(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = quality.check_rows(t.orders, 100).unionByName(quality.check_nulls(t.orders, ["o_totalprice"])).unionByName(quality.gate(joined, ["o_custkey"], "c_custkey"))
    return rows.select("check", "status", "value")


@query("""WITH n AS (SELECT 100.0 * sum((value IS NULL)::INT + (user_id IS NULL)::INT) / (2 * count(*)) AS pct FROM events)
SELECT 20 + CASE WHEN pct < 20 THEN 10 ELSE 0 END AS points, 30 AS possible, CAST(round(pct, 1) AS DOUBLE) AS null_pct FROM n""")
def quality_points(t: Tables) -> DataFrame:
    return quality.quality_points(t.events, ["value", "user_id"])


@query("""SELECT event_id, CASE WHEN event_type NOT IN (SELECT max(event_type) FROM events) THEN 'WARN' WHEN json_extract(props, '$.k') IS NOT NULL THEN 'PASS' ELSE 'FAIL' END AS status FROM events""")
def check_contract(t: Tables) -> DataFrame:
    kind = t.events.agg(F.max("event_type").alias("k")).first().k
    return quality.check_contract(t.events, {kind: ["k"]}, "event_type", "props").select("event_id", "status")


@query("""
WITH s AS (SELECT o_custkey AS source, max(CAST(o_orderdate AS DATE)) AS last_date, CASE o_custkey % 4 WHEN 0 THEN 'continuous' WHEN 1 THEN 'monthly' WHEN 2 THEN 'quarterly' ELSE 'annual' END AS frequency,
 CASE WHEN o_custkey % 5 > 0 THEN 30 * (o_custkey % 5) END AS threshold, CASE o_custkey % 7 WHEN 0 THEN DATE '2001-07-01' WHEN 1 THEN DATE '2001-05-01' WHEN 2 THEN DATE '2000-07-01' END AS release FROM orders GROUP BY o_custkey)
SELECT source, CAST(date_diff('day', last_date, DATE '2001-06-30') AS INTEGER) AS age_days, CASE WHEN release <= DATE '2001-06-30' THEN 'STALE' WHEN frequency = 'annual' THEN 'OK'
 WHEN last_date IS NULL THEN 'UNKNOWN' WHEN date_diff('day', last_date, DATE '2001-06-30') > coalesce(threshold, 365) THEN 'STALE' ELSE 'OK' END AS freshness FROM s""")
def freshness(t: Tables) -> DataFrame:
    c = F.col("source")
    frequency = F.when(c % 4 == 0, "continuous").when(c % 4 == 1, "monthly").when(c % 4 == 2, "quarterly").otherwise("annual")
    release = F.when(c % 7 == 0, "2001").when(c % 7 == 1, "2001-05").when(c % 7 == 2, "2000").when(c % 7 == 3, "soon")
    s = t.orders.groupBy(F.col("o_custkey").alias("source")).agg(F.max(F.to_date("o_orderdate")).alias("last_date"))
    s = s.withColumns({"frequency": frequency, "threshold_days": F.when(c % 5 > 0, 30 * (c % 5)), "next_release": release})
    return catalog.freshness(s, "2001-06-30").select("source", "age_days", "freshness")


_USES = "SELECT o_custkey % 40 AS project, CAST(year(o_orderdate) AS VARCHAR) AS vintage, o_orderpriority, o_orderstatus FROM orders"


@query(f"""
WITH u AS (SELECT project, greatest(2001 - TRY_CAST(vintage AS INTEGER), 0) AS behind, o_orderpriority, o_orderstatus FROM ({_USES})),
s AS (SELECT project, round(least(CASE WHEN starts_with(o_orderpriority, '1') THEN 0.5 WHEN starts_with(o_orderpriority, '2') THEN 0.3 ELSE 0.1 END + CASE WHEN o_orderstatus = 'F' THEN 0.25 ELSE 0 END
 + CASE WHEN behind >= 3 THEN 0.2 WHEN behind = 2 THEN 0.15 WHEN behind = 1 THEN 0.05 ELSE 0 END + CASE WHEN behind >= 2 THEN 0.1 ELSE 0 END, 1.0), 2) AS score FROM u)
SELECT project, CAST(max(score) AS DOUBLE) AS score, CASE WHEN max(score) >= 0.7 THEN 'critical' WHEN max(score) >= 0.5 THEN 'high' WHEN max(score) >= 0.3 THEN 'medium' ELSE 'low' END AS severity FROM s GROUP BY 1""")
def staleness_impact(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    used = t.orders.select((F.col("o_custkey") % 40).alias("project"), F.year("o_orderdate").cast("string").alias("vintage"), F.lit("x").alias("source"), F.when(p.startswith("1"), "high").when(p.startswith("2"), "medium").otherwise("low").alias("criticality"), (F.col("o_orderstatus") == "F").alias("is_primary"))
    newest = t.spark.createDataFrame([("x", "2001")], "source string, latest string")
    return catalog.impact(catalog.staleness(used, F.broadcast(newest)))


_FOUND = "contains(lower(coalesce(CAST({c} AS VARCHAR), '')), '{w}')::INT * {p}"
_SCORE = " + ".join([_FOUND.format(c=c, w="src1 license, mit", p=p) for c, p in (("source", 10), ("doc_id", 8), ("lang", 2))] + [_FOUND.format(c=c, w=w, p=p) for w in ("src1", "license", "mit") for c, p in (("source", 3), ("doc_id", 2), ("lang", 1.5), ("text", 1), ("source || ' ' || lang", 0.5))])


@query(f"""SELECT doc_id, CAST({_SCORE} AS DOUBLE) AS score FROM documents WHERE {_SCORE} > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def keyword_search(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("uses", F.concat_ws(" ", "source", "lang"))
    return catalog.search(docs, "src1 license, mit", 20, "doc_id", "source", "doc_id", "lang", "text", "uses", "lang").select("doc_id", "score")


@query("SELECT DISTINCT source FROM documents WHERE contains(lower(concat_ws(' ', text, lang)), 'public license')")
def inventory_search(t: Tables) -> DataFrame:
    return catalog.search_inventory(t.documents, "source", ["text", "lang"], "Public License")


@query(r"""
WITH l AS (SELECT doc_id AS k, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT *, string_agg(line, ' ') OVER (PARTITION BY k ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near, concat_ws(' ', line, lead(line) OVER (PARTITION BY k ORDER BY line_no)) AS two,
 coalesce(bool_or(regexp_matches(line, '(?i)^#+\s*(key finding|finding|conclusion|summary|result|hero|executive)')) OVER (PARTITION BY k ORDER BY line_no), false) AS begun FROM l),
h AS (SELECT k, line_no, 'race_causal_language' AS rule, 'FAIL' AS severity, NULL::BOOLEAN AS in_key_section FROM n WHERE (regexp_matches(line,
 '(?i)(^|[^\pL\pN_])(because|due to|caused by|driven by|attributable to|explained by|result of|owing to|leads? to|results? in|causes?)([^\pL\pN_.][^.]{0,58}[^\pL\pN_.]|[^\pL\pN_.])(race|racial|ethnicity|ethnic|hispanic|latino|latina|latinx|black|white|asian|indigenous|native american|african american|minority|minorities|people of color|poc)($|[^\pL\pN_])')
 OR regexp_matches(line, '(?i)(^|[^\pL\pN_])(race|racial|ethnicity|ethnic|hispanic|latino|latina|latinx|black|white|asian|indigenous|native american|african american|minority|minorities|people of color|poc)([^\pL\pN_.][^.]{0,58}[^\pL\pN_.]|[^\pL\pN_.])(causes?|drives?|leads? to|results? in|explains?|determines?|predicts?|accounts? for)($|[^\pL\pN_])'))
 AND NOT regexp_matches(line, '(?i)(^|[^\pL\pN_])(disproportionately affect|disproportionate|more likely|less likely|higher rates? among|lower rates? among|concentrated among|predominantly|largely|mostly|majority|correlated with|associated with|compared to)($|[^\pL\pN_])')
UNION ALL SELECT k, line_no, 'policy_without_disclaimer', 'WARN', NULL FROM n WHERE regexp_matches(line, '(?i)(^|[^\pL\pN_])(should|must|recommends?|ought to|urges?|calls? for|proposes?|advocates?|suggest|suggests? that (the county|the city|the state|officials?|policymakers?))($|[^\pL\pN_])')
 AND NOT regexp_matches(near, '(?i)(^|[^\pL\pN_])(note|disclaimer|caveat|caution|limitation|based on|subject to|contingent|pending|further analysis|additional research|not a substitute|for informational|not policy advice|consult)($|[^\pL\pN_])')
UNION ALL SELECT k, line_no, 'superlative_without_citation', 'WARN', NULL FROM n WHERE regexp_matches(line, '(?i)(^|[^\pL\pN_])(worst|best|most|highest|lowest|greatest|least|largest|smallest|number one|#1|top-ranked|bottom-ranked)($|[^\pL\pN_])')
 AND NOT regexp_matches(two, '(?i)(\([^)]{3,}\)|\[\d+\]|according to|per the|data show|figure \d|table \d|see appendix|as shown|source:|\d{4} [A-Z])')
UNION ALL SELECT k, line_no, 'passive_uncertainty', 'INFO', begun FROM n WHERE regexp_matches(line, '(?i)(^|[^\pL\pN_])((may|might|could) (suggest|indicate)|(could|may) imply|seems? to (indicate|suggest|imply|show)|appears? to (indicate|suggest)|tends? to suggest|would seem to|seems? like|seems? as though)($|[^\pL\pN_])')
UNION ALL SELECT k, line_no, 'sensitive_topic', 'WARN', NULL FROM n WHERE contains(lower(line), 'license') OR contains(lower(line), 'password')
UNION ALL SELECT k, line_no, 'hero_contradicts_belief', 'WARN', NULL FROM n WHERE list_has_any(string_split_regex(trim(lower(line)), '\s+'), ['software', 'granted', 'permission']) AND regexp_matches(line, '(?i)(^|[^\pL\pN_])(not|no|contrary|opposite|contradicts?|disproves?|challenges?|unexpected|surprising|counter|(lower|higher|less|more) than expected)($|[^\pL\pN_])'))
SELECT k, CAST(line_no AS INTEGER) AS line_no, rule, severity, coalesce(in_key_section, false) AS in_key_section FROM h""")
def text_rules(t: Tables) -> DataFrame:
    hits = reports.scan_report(t.documents.withColumnRenamed("doc_id", "k"), "k", "text", ["license", "password"], "software permission granted for all", ["it is free"])
    return hits.select("k", "line_no", "rule", "severity", F.coalesce("in_key_section", F.lit(False)).alias("in_key_section"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'apache license') THEN 'Apache' WHEN contains(lower(text), 'mit license') THEN 'MIT' END AS citation FROM documents""")
def match_citation(t: Tables) -> DataFrame:
    reg = t.spark.createDataFrame([(1, "apache license", "Apache"), (2, "MIT license", "MIT")], "ordinal int, keyword string, citation string")
    return catalog.match_citation(t.documents.select("doc_id", "text"), reg, "text").select("doc_id", "citation")


@query("SELECT DISTINCT doc_id, k AS source FROM documents, (VALUES ('gnu', 'GNU'), ('mit', 'MIT license')) v(k, w) WHERE contains(lower(text), lower(w))")
def detect_sources(t: Tables) -> DataFrame:
    words = t.spark.createDataFrame([("gnu", "GNU"), ("mit", "MIT license")], "source string, keyword string")
    return catalog.detect_sources(t.documents, words, "doc_id", "text")


@query("""
WITH l AS (SELECT user_id AS run, event_type AS stage, ts, event_id % 2 = 0 AS is_start FROM events),
a AS (SELECT run, stage, max(ts) FILTER (WHERE is_start) started, max(ts) FILTER (WHERE NOT is_start) ended, count(*) FILTER (WHERE is_start) starts FROM l GROUP BY 1, 2)
SELECT run, stage, starts, CASE WHEN started IS NULL THEN 'pending' WHEN coalesce(ended >= started, false) THEN 'completed' WHEN starts > 1 THEN 'restarted' ELSE 'running' END AS status,
CASE WHEN ended >= started THEN CAST(floor(epoch(ended)) - floor(epoch(started)) AS BIGINT) END AS seconds FROM a""")
def stage_status(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), F.when(F.col("event_id") % 2 == 0, "stage_start").otherwise("stage_end").alias("event"), "ts")
    return rank.stage_status(log, "run", "stage", "event", "ts").select("run", "stage", "starts", "status", "seconds")


@query("""SELECT event_id, CASE WHEN CAST(value AS VARCHAR) IS NOT NULL THEN round(value, 6) END AS v, CASE WHEN value <> -666666666 AND value >= 0 THEN round(value, 6) END AS income, lpad(CAST(user_id AS VARCHAR), 5, '0') || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS geoid,
concat_ws(', ', nullif(trim(event_type), ''), CAST(user_id AS VARCHAR)) AS address, round(value / 40.0 * 60, 6) AS minutes FROM events""")
def scalar_functions(t: Tables) -> DataFrame:
    return t.events.select("event_id", r6(to_numeric(F.col("value").cast("string")), "v"), r6(no_sentinel(F.col("value"), income=True), "income"), geoid((F.col("user_id"), 5), (F.col("event_id") % 100, 2)).alias("geoid"), full_address(None, F.col("event_type"), F.col("user_id").cast("string")).alias("address"), r6(travel_minutes(F.col("value"), "drive"), "minutes"))


@query("""SELECT p_partkey, round_even(p_retailprice, 0) AS price_total, round_even(p_retailprice / 100, 2) AS price_pct, round_even(p_retailprice / 7, 0) AS price,
CASE WHEN abs(p_retailprice) >= 1000 THEN round_even(p_retailprice, 0) WHEN abs(p_retailprice) >= 1 THEN round_even(p_retailprice, 1) ELSE round_even(p_retailprice, 2) END AS score FROM part""")
def smart_rounding(t: Tables) -> DataFrame:
    p = F.col("p_retailprice")
    return t.part.select("p_partkey", smart_round(p, "price_total").alias("price_total"), smart_round(p / 100, "price_pct").alias("price_pct"), smart_round(p / 7, "price").alias("price"), smart_round(p, "score").alias("score"))


@query("SELECT o_orderkey AS order_key, o_totalprice AS price, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
def clean_and_derive(t: Tables) -> DataFrame:
    df = clean.rename(t.orders, {"o_orderkey": " Order KEY ", "o_totalprice": "Price"})
    df = clean.where(clean.normalize_columns(df), "price > 1000 and o_orderstatus = 'F'")
    df = clean.derive(clean.coerce_types(df, {"price": "double"}), ["twice = price * 2", "broken = nothing_here + 1"])
    return clean.select_fields(df, ["order_key", "price", "twice", "missing"])


@query("SELECT event_type, count(*) n FROM events WHERE value BETWEEN 10 AND 60 AND user_id BETWEEN 5 AND 60 GROUP BY 1")
def bbox_filter(t: Tables) -> DataFrame:
    return clean.in_bbox(t.events, (10, 5, 60, 60), "value", "user_id").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, min(v) AS lo, max(v) AS hi FROM (SELECT c_acctbal v FROM customer UNION ALL SELECT s_acctbal FROM supplier)")
def pooled_range(t: Tables) -> DataFrame:
    v = classify.pool([t.customer.withColumnRenamed("c_acctbal", "v"), t.supplier.withColumnRenamed("s_acctbal", "v")], ["v"])
    return v.agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("""SELECT n_regionkey, count(*) n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def sql_surface(t: Tables) -> DataFrame:
    return run_sql(t.spark, "SELECT n_regionkey, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_regionkey", customer=t.customer, nation=t.nation)


@query("""SELECT event_type AS k, CAST(year(ts) AS INTEGER) AS year, round(value, 6) AS v FROM events WHERE value IS NOT NULL""")
def series_payload(t: Tables) -> DataFrame:
    body = F.to_json(F.array(F.struct(F.col("event_type").alias("seriesID"), F.array(F.struct(F.year("ts").cast("string").alias("year"), F.lit("M01").alias("period"), F.col("value").cast("string").alias("value"), F.array(F.struct(F.lit("a").alias("text"))).alias("footnotes"))).alias("data"))))
    out = payloads.from_series(t.events.where("value is not null").select(body.alias("body")), "body")
    return out.select(F.col("series").alias("k"), "year", r6("value", "v"))


@query("""SELECT user_id, event_type, lpad(CAST(user_id AS VARCHAR), 3, '0') || event_type AS geoid FROM events""")
def header_array_payload(t: Tables) -> DataFrame:
    names = F.array(F.lit("user"), F.lit("kind"), F.lit("state"))
    body = F.to_json(F.array(names, F.array(F.col("user_id").cast("string"), F.col("event_type"), F.lpad(F.col("user_id").cast("string"), 3, "0"))))
    out = payloads.from_header_array(t.events.select(body.alias("body")), "body", ["user", "kind", "state"], ["state", "kind"])
    return out.select(F.col("user").cast("long").alias("user_id"), F.col("kind").alias("event_type"), "geoid")


@query("""SELECT event_id AS id, value AS x, CAST(user_id AS DOUBLE) AS y, event_type AS amenity FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL""")
def osm_payload(t: Tables) -> DataFrame:
    e = F.struct(F.lit("way").alias("type"), F.col("event_id").alias("id"), F.struct(F.col("user_id").cast("double").alias("lat"), F.col("value").alias("lon")).alias("center"), F.create_map(F.lit("amenity"), F.col("event_type")).alias("tags"))
    return payloads.from_osm(t.events.select(F.to_json(F.struct(F.array(e).alias("elements"))).alias("body")), "body").select("id", "x", "y", "amenity")


@query("""SELECT event_id AS id, coalesce(props, event_type) AS label FROM events""")
def record_payload(t: Tables) -> DataFrame:
    return payloads.from_records(t.events, {"id": ["event_id"], "label": ["absent", "props", "event_type"]})


_END = "CASE WHEN abs({x}) >= 100 THEN format('{{:,.0f}}', {x}) WHEN abs({x}) >= 1 THEN format('{{:,.1f}}', {x}) ELSE format('{{:,.2f}}', {x}) END"


@query(f"SELECT p_partkey, {_END.format(x='(p_size / 8.0)::DOUBLE')} || '\u2013' || {_END.format(x='(p_size * 501)::DOUBLE')} || '%' AS label, {_END.format(x='p_size::DOUBLE')} || '\u2013' || {_END.format(x='(p_size + 60)::DOUBLE')} AS plain FROM part")
def break_labels(t: Tables) -> DataFrame:
    s = F.col("p_size").cast("double")
    return t.part.select("p_partkey", break_label(s / 8, s * 501, percent=True).alias("label"), break_label(s, s + 60).alias("plain"))
