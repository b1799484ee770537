"""Queries of aggregates, sketches, series, joins and sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .catalogue import query, rounded, table
from .operators import resample, series, sets, sketch, stats
from .sources import random as rnd

# Aggregates


@query("""
SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(sum(l_extendedprice), 2) AS total, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
  round(avg(l_extendedprice), 4) AS average, round(coalesce(var_samp(l_extendedprice), 0), 2) AS variance, round(coalesce(stddev_samp(l_extendedprice), 0), 4) AS deviation
FROM lineitem GROUP BY ALL""")
def double_statistics(spark, sf_dir):
    out = stats.summarize(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.withColumns({"total": rounded(F.col("total"), 2), "average": rounded(F.col("average"), 4), "variance": rounded(F.col("variance"), 2), "deviation": rounded(F.col("deviation"), 4)})


@query("""
SELECT CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS total, 'inf'::DOUBLE AS low, '-inf'::DOUBLE AS high, 0.0::DOUBLE AS average, 0.0::DOUBLE AS variance, 0.0::DOUBLE AS deviation""")
def double_statistics_empty(spark, sf_dir):
    return stats.summarize(table(spark, sf_dir, "lineitem").where("l_quantity < 0"), [], "l_quantity")


@query("""
SELECT event_type, CASE WHEN bool_or(isnan(value)) THEN 'nan'::DOUBLE ELSE min(value) END AS low, max(value) AS high, round(avg(value), 6) AS average,
  round(stddev_pop(value), 6) AS deviation, round(median(value), 6) AS median, round(sqrt(sum(value * value)), 4) AS norm2, round(sum(value * event_id), 1) AS dot
FROM events GROUP BY event_type""")
def list_aggregates(spark, sf_dir):
    x = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(stats.list_min(x).alias("low"), stats.list_max(x).alias("high"), rounded(F.avg(x)).alias("average"), rounded(stats.list_stddev(x)).alias("deviation"), rounded(stats.list_median(x)).alias("median"), rounded(stats.norm2(x), 4).alias("norm2"), rounded(stats.dot(x, F.col("event_id")), 1).alias("dot"))


HALVES = """
WITH l AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1),
h AS (SELECT l_returnflag, v, len(v) AS n, CASE WHEN len(v) = 1 THEN v ELSE v[1:len(v)//2] END AS a, CASE WHEN len(v) = 1 THEN v ELSE v[len(v) - len(v)//2 + 1:] END AS b FROM l),
q AS (SELECT l_returnflag, n, list_median(a) AS lower_quartile, list_median(v) AS median, list_median(b) AS upper_quartile, v[1] AS low, v[n] AS high FROM h)
"""


@query(HALVES + """
SELECT l_returnflag, CAST(n AS BIGINT) AS n, round(lower_quartile, 4) AS lower_quartile, round(median, 4) AS median, round(upper_quartile, 4) AS upper_quartile, round(upper_quartile - lower_quartile, 4) AS iqr FROM q""")
def list_quartiles(spark, sf_dir):
    q = stats.halves_quartiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return q.select("l_returnflag", "n", *[rounded(F.col(c), 4).alias(c) for c in ("lower_quartile", "median", "upper_quartile", "iqr")])


@query(HALVES + """
SELECT l_returnflag, round(greatest(lower_quartile - 1.5 * (upper_quartile - lower_quartile), low), 4) AS lower_fence, round(least(upper_quartile + 1.5 * (upper_quartile - lower_quartile), high), 4) AS upper_fence FROM q""")
def outlier_fences(spark, sf_dir):
    return stats.outlier_fences(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice").withColumns({c: rounded(F.col(c), 4) for c in ("lower_fence", "upper_fence")})


@query(HALVES + """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN q USING (l_returnflag)
WHERE l_extendedprice < lower_quartile - 0.5 * (upper_quartile - lower_quartile) OR l_extendedprice > upper_quartile + 0.5 * (upper_quartile - lower_quartile)""")
def outlier_rows(spark, sf_dir):
    return stats.outliers(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.5).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""
WITH m AS (SELECT event_type, max(value) AS m FROM events GROUP BY 1)
SELECT event_type, round(max(m) + ln(sum(exp(value - m))), 6) AS log_sum_exp FROM events JOIN m USING (event_type) GROUP BY event_type""")
def log_sum_exp(spark, sf_dir):
    return stats.log_sum_exp(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("log_sum_exp", rounded(F.col("log_sum_exp")))


COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs(f: str, name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round({f.format(a=a, b=b)}, 4) AS {name} FROM lineitem" for a in COLUMNS for b in COLUMNS)


@query(_pairs("covar_samp({a}, {b})", "covariance"))
def covariance_matrix(spark, sf_dir):
    return stats.covariance_matrix(table(spark, sf_dir, "lineitem"), COLUMNS).withColumn("covariance", rounded(F.col("covariance"), 4))


@query(_pairs("covar_pop({a}, {b})", "covariance"))
def population_covariance(spark, sf_dir):
    return stats.covariance_matrix(table(spark, sf_dir, "lineitem"), COLUMNS, True).withColumn("covariance", rounded(F.col("covariance"), 4))


@query(_pairs("CASE WHEN '{a}' = '{b}' THEN 1.0 ELSE coalesce(covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) * var_pop({b})), 0), 0) END", "correlation"))
def correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(table(spark, sf_dir, "lineitem"), COLUMNS).withColumn("correlation", rounded(F.col("correlation"), 4))


@query("""SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, round(avg(l_extendedprice), 4) AS mean_price, round(var_samp(l_quantity), 4) AS var_quantity, round(covar_samp(l_quantity, l_extendedprice), 2) AS covariance, round(var_samp(l_extendedprice), 0) AS var_price FROM lineitem""")
def merged_covariance(spark, sf_dir):
    """Accumulators by flag, merged to the whole."""
    m = stats.merge_moments(stats.moments(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"]), 2)
    d = F.col("n") - 1
    return m.select("n", rounded(F.col("means")[0]).alias("mean_quantity"), rounded(F.col("means")[1], 4).alias("mean_price"), rounded(F.col("comoments")[0] / d, 4).alias("var_quantity"), rounded(F.col("comoments")[1] / d, 2).alias("covariance"), rounded(F.col("comoments")[2] / d, 0).alias("var_price"))


@query("""
SELECT event_type, round(CASE WHEN count(value) < 4 THEN 'nan' ELSE coalesce((quantile_cont(value, 0.75) + quantile_cont(value, 0.25) - 2 * quantile_cont(value, 0.5)) / nullif(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 0), 0) END, 6) AS skewness,
  round(coalesce((quantile_cont(value, 0.99) - quantile_cont(value, 0.5)) / nullif(quantile_cont(value, 0.5) - quantile_cont(value, 0.01), 0), 0), 6) AS tail_ratio
FROM events GROUP BY event_type""")
def skewness_and_tails(spark, sf_dir):
    x = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(rounded(stats.bowley_skewness(x)).alias("skewness"), rounded(stats.tail_ratio(x)).alias("tail_ratio"))


@query("""
WITH e AS (SELECT vec_id, embedding AS a, list_reverse(embedding) AS b FROM embeddings)
SELECT round(avg(CASE WHEN list_position(a, list_max(a)) = list_position(b, list_max(b)) THEN 1.0 ELSE 0.0 END), 4) AS accuracy, count(*) AS n FROM e""")
def multi_class_accuracy(spark, sf_dir):
    return stats.multi_class_accuracy(table(spark, sf_dir, "embeddings"), F.col("embedding"), F.reverse("embedding"))


# Sketches and resampling


@query("""
SELECT user_id, count(*) AS truth, true AS never_below, true AS close FROM events GROUP BY user_id""")
def count_min_bound(spark, sf_dir):
    """Every item's estimate is at least its count, and within the sketch's error."""
    e = table(spark, sf_dir, "events")
    truth = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("truth"))
    got = sketch.count_min_estimate(sketch.count_min(e, "user_id", 5, 4000), e, "user_id", 5, 4000)
    total = sketch.count_min_total(sketch.count_min(e, "user_id", 5, 4000))
    return truth.join(got, "user_id").crossJoin(F.broadcast(total)).select("user_id", "truth", (F.col("estimate") >= F.col("truth")).alias("never_below"), (F.col("estimate") <= F.col("truth") + 0.01 * F.col("total")).alias("close"))


@query("""SELECT CAST(count(*) AS BIGINT) AS total FROM events""")
def count_min_merged_total(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [sketch.count_min(e.where(F.col("event_id") % 2 == k), "user_id") for k in (0, 1)]
    return sketch.count_min_total(sketch.count_min_merge(*parts))


@query()
def count_min_top_k(spark, sf_dir):
    return sketch.count_min_top_k(table(spark, sf_dir, "events"), "user_id", 5)


@query("""
SELECT event_type, CAST(count(value) AS BIGINT) AS n, true AS median_close, true AS tail_close, true AS rank_close, true AS few FROM events GROUP BY event_type""")
def t_digest_quantiles(spark, sf_dir):
    """Digest estimates against exact ranks: within 2 % at the centre, 1 % at the tail."""
    e = table(spark, sf_dir, "events").select("event_type", "value")
    d = sketch.t_digest(e, "value", 100.0, ["event_type"])
    q = d.select("event_type", "n", sketch.centroid_count(F.col("centroids")).alias("k"), sketch.digest_median(F.col("centroids")).alias("q50"), sketch.digest_quantile(F.col("centroids"), 0.99).alias("q99"), sketch.digest_cdf(F.col("centroids"), 30.0).alias("r30"))
    x = F.col("value")
    ranks = e.join(q, "event_type").groupBy("event_type", "n", "k").agg(F.avg((x <= F.col("q50")).cast("double")).alias("a"), F.avg((x <= F.col("q99")).cast("double")).alias("b"), F.avg((x <= 30.0).cast("double")).alias("c"), F.max("r30").alias("r30"))
    return ranks.select("event_type", "n", (F.abs(F.col("a") - 0.5) < 0.02).alias("median_close"), (F.abs(F.col("b") - 0.99) < 0.01).alias("tail_close"), (F.abs(F.col("c") - F.col("r30")) < 0.02).alias("rank_close"), (F.col("k") < 1000).alias("few"))


@query()
def p_square_median(spark, sf_dir):
    return sketch.p_square_median(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], ["event_type"])


@query()
def bootstrap_mean(spark, sf_dir):
    """Intervals of the mean account balance of one segment; an error if the segment
    is larger than the bound of a sample."""
    v = resample.whole_sample(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), "c_acctbal")
    reps = resample.bootstrap(spark, v, "mean", 2000, 7)
    low, high = resample.bca_interval(reps, v, "mean")
    return resample.summary(reps).withColumns({"bca_lower": F.lit(low), "bca_upper": F.lit(high)})


@query()
def poisson_bootstrap_mean(spark, sf_dir):
    return resample.poisson_bootstrap(table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", 100, 3)


@query("""
WITH t AS (SELECT sum(c_acctbal) AS s, count(*) AS n FROM customer), l AS (SELECT (s - c_acctbal) / (n - 1) AS t FROM customer, t), m AS (SELECT avg(t) AS m FROM l)
SELECT round(sum((m - t) * (m - t) * (m - t)) / (6 * pow(sum((m - t) * (m - t)), 1.5)), 8) AS acceleration FROM l, m""")
def jackknife_acceleration(spark, sf_dir):
    return resample.jackknife_mean(table(spark, sf_dir, "customer"), "c_acctbal").withColumn("acceleration", rounded(F.col("acceleration"), 8))


@query("SELECT round(quantile_cont(c_acctbal, 0.9), 4) AS quantile FROM customer")
def replicate_quantile(spark, sf_dir):
    return resample.quantile(table(spark, sf_dir, "customer").withColumnRenamed("c_acctbal", "value"), 0.9).withColumn("quantile", rounded(F.col("quantile"), 4))


# Series




def hourly(spark, sf_dir):
    h = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("v"))
    return series.positions(h, ["hour"])


HOURLY = "WITH s AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS v, row_number() OVER (ORDER BY date_trunc('hour', ts)) - 1 AS pos FROM events GROUP BY 1), d AS (SELECT pos, v - (SELECT avg(v) FROM s) AS d FROM s), r AS (SELECT k.lag, sum(a.d * b.d) / (SELECT sum(d * d) FROM d) AS r FROM (SELECT unnest(range(0, 8)) AS lag) k, d a JOIN d b ON b.pos = a.pos + k.lag GROUP BY k.lag)"


@query(HOURLY + " SELECT CAST(lag AS INT) AS lag, round(r, 6) AS r FROM r")
def acf_hourly(spark, sf_dir):
    return series.acf(hourly(spark, sf_dir), "v", "pos", 7).withColumn("r", rounded(F.col("r")))


@query(HOURLY + " SELECT CAST(lag AS INT) AS lag, round(1.96 / sqrt((SELECT count(*) FROM s)), 6) AS bound, abs(r) > 1.96 / sqrt((SELECT count(*) FROM s)) AS significant FROM r")
def acf_significance(spark, sf_dir):
    s = hourly(spark, sf_dir)
    return series.acf(s, "v", "pos", 7).crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("n")))).select("lag", rounded(series.acf_bound(F.col("n"))).alias("bound"), series.is_significant(F.col("r"), F.col("n")).alias("significant"))


def _levinson_sql(lags: int) -> str:
    """The recursion unrolled, a table for each step: partial autocorrelation k as a<k>, from c[1 + lag]."""
    out, phi = ["p0 AS MATERIALIZED (SELECT c, 1.0::DOUBLE AS e0 FROM c)"], []
    for k in range(1, lags + 1):
        out.append(f"q{k} AS MATERIALIZED (SELECT *, (c[{k + 1}] - ({' + '.join([f'{p} * c[{k - j}]' for j, p in enumerate(phi)] or ['0'])})) / e{k - 1} AS a{k} FROM p{k - 1})")
        less = "".join(f", {p} - a{k} * {phi[k - 2 - j]} AS p{k}_{j}" for j, p in enumerate(phi))
        out.append(f"p{k} AS MATERIALIZED (SELECT *{less}, e{k - 1} * (1 - a{k} * a{k}) AS e{k} FROM q{k})")
        phi = [f"p{k}_{j}" for j in range(k - 1)] + [f"a{k}"]
    return ", ".join(out)


@query(HOURLY + f", c AS (SELECT list(r ORDER BY lag) AS c FROM r), {_levinson_sql(7)} SELECT CAST(unnest(range(0, 8)) AS INT) AS lag, round(unnest([1.0, {', '.join(f'a{k}' for k in range(1, 8))}]), 6) AS partial FROM p7")
def pacf_hourly(spark, sf_dir):
    return series.pacf(hourly(spark, sf_dir), "v", "pos", 7).withColumn("partial", rounded(F.col("partial")))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment)) / stddev_samp(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS z FROM customer")
def zscore_sample(spark, sf_dir):
    return series.standardize(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"]).select("c_custkey", rounded(F.col("z")).alias("z"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z FROM customer")
def zscore_population(spark, sf_dir):
    return series.standardize(table(spark, sf_dir, "customer"), "c_acctbal", None, True).select("c_custkey", rounded(F.col("z")).alias("z"))


def _positional(op: str, sign: str):
    def run(spark, sf_dir):
        a = series.positions(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"])
        b = series.positions(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["s_suppkey"])
        return series.combine_by_position(a, b, "c_acctbal", "s_acctbal", op).withColumn("value", rounded(F.col("value"), 2))

    run.__name__ = f"positional_{op}"
    query(f"""WITH a AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer), b AS (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier)
SELECT pos, round(c_acctbal {sign} s_acctbal, 2) AS value FROM a JOIN b USING (pos)""")(run)


for _op, _sign in (("add", "+"), ("subtract", "-"), ("multiply", "*")):
    _positional(_op, _sign)


@query("SELECT * FROM (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier) WHERE pos BETWEEN 2 AND 6")
def slice_positions(spark, sf_dir):
    return series.slice_positions(series.positions(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["s_suppkey"]), 7, 3)


@query("""
WITH k AS (SELECT DISTINCT CAST(p_size AS DOUBLE) * 2 AS knot, CAST(p_size AS DOUBLE) AS payload FROM part)
SELECT event_id, value, k.knot AS knot_found, k.payload FROM events ASOF LEFT JOIN k ON events.value >= k.knot""")
def as_of_lookup(spark, sf_dir):
    k = table(spark, sf_dir, "part").select((F.col("p_size").cast("double") * 2).alias("knot"), F.col("p_size").cast("double").alias("payload")).distinct()
    return series.as_of(table(spark, sf_dir, "events").select("event_id", "value"), k, "value", "knot", ["payload"])


# Joins by value and sets


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_mktsegment = 'BUILDING') USING (o_custkey)")
def semi_retain(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return sets.retain_all(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_mktsegment = 'BUILDING') USING (o_custkey)")
def anti_remove(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return sets.remove_all(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey")


@query("SELECT NOT EXISTS (SELECT 1 FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders) USING (c_custkey)) AS contains_all")
def contains_all(spark, sf_dir):
    return sets.contains_all(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "customer"), "c_custkey")


def _keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))


K = "WITH a AS (SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer), b AS (SELECT CAST(s_nationkey AS BIGINT) AS k FROM supplier) "


@query(K + "SELECT k FROM a UNION ALL SELECT k FROM b")
def union_all(spark, sf_dir):
    return sets.union_all(*_keys(spark, sf_dir))


@query(K + "SELECT k FROM a UNION SELECT k FROM b")
def union_distinct(spark, sf_dir):
    return sets.union(*_keys(spark, sf_dir))


@query(K + "SELECT k FROM a INTERSECT SELECT k FROM b")
def intersect(spark, sf_dir):
    return sets.intersect(*_keys(spark, sf_dir))


@query(K + "SELECT k FROM a EXCEPT SELECT k FROM b WHERE k > 3")
def difference(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return sets.difference(a, b.where("k > 3"))


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, event_type, user_id LIMIT 10")
def top_k(spark, sf_dir):
    return sets.top_k(table(spark, sf_dir, "events"), ["event_type", "user_id"], 10)


@query("SELECT event_type, arg_max(user_id, {'v': value, 'i': -event_id}) AS user_id, max(value) AS value FROM events GROUP BY event_type")
def arg_max(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("user_id", F.struct("value", -F.col("event_id"))).alias("user_id"), F.max("value").alias("value"))


@query("SELECT value, event_id FROM events ORDER BY value, event_id")
def sorted_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("value", "event_id").orderBy("value", "event_id")




@query("""WITH g AS (SELECT o_custkey, CAST(o_orderkey % 7 AS INT) AS k, CAST(max(o_orderkey) AS INT) AS v FROM orders GROUP BY ALL)
SELECT o_custkey, coalesce(max(CASE WHEN k = 3 THEN v END), -1) AS at_3, bool_or(k = 2) AS has_2, CAST(count(*) AS INT) AS size, CAST(count(CASE WHEN k <> 2 THEN 1 END) AS INT) AS without_2,
  99 AS put_5, CAST(count(CASE WHEN k <> 5 THEN 1 END) + 1 AS INT) AS size_put, bool_or(v = 7) AS has_value_7, CAST(sum(k) AS INT) AS key_sum, CAST(sum(v) AS BIGINT) AS value_sum, 8 AS merged_1
FROM g GROUP BY o_custkey""")
def int_maps(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 7).cast("int").alias("k")).agg(F.max("o_orderkey").cast("int").alias("v"))
    m = F.col("m")
    d = g.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    fold = lambda a, t: F.aggregate(a, F.lit(0).cast(t), lambda s, x: s + x.cast(t))
    return d.select(
        "o_custkey", sets.lookup(m, 3).alias("at_3"), sets.contains_key(m, 2).alias("has_2"), F.size(m).alias("size"), F.size(sets.remove_key(m, 2)).alias("without_2"),
        sets.lookup(sets.put(m, 5, 99), 5).alias("put_5"), F.size(sets.put(m, 5, 99)).alias("size_put"), sets.contains_value(m, 7).alias("has_value_7"),
        fold(F.map_keys(m), "int").alias("key_sum"), fold(F.map_values(m), "bigint").alias("value_sum"), sets.lookup(sets.put_all(m, F.create_map(F.lit(1), F.lit(8))), 1).alias("merged_1"),
    )


@query("""WITH s AS (SELECT user_id, list(DISTINCT CAST(event_id % 10 AS INT)) AS s FROM events GROUP BY user_id)
SELECT user_id, CAST(len(s) AS INT) AS n, list_contains(s, 3) AS has_3, CAST(len(s) + CASE WHEN list_contains(s, 11) THEN 0 ELSE 1 END AS INT) AS with_11, CAST(len(list_filter(s, lambda x: x <> 3)) AS INT) AS without_3,
  CAST(len(list_filter(s, lambda x: x IN (1, 2, 3))) AS INT) AS common, CAST(len(list_filter(s, lambda x: x NOT IN (1, 2, 3))) AS INT) AS rest, len(list_filter([1, 2], lambda x: list_contains(s, x))) = 2 AS has_both FROM s""")
def int_sets(spark, sf_dir):
    s = F.col("s")
    three = F.array(F.lit(1), F.lit(2), F.lit(3))
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set((F.col("event_id") % 10).cast("int")).alias("s"))
    return d.select("user_id", F.size(s).alias("n"), F.array_contains(s, 3).alias("has_3"), F.size(sets.add_int(s, 11)).alias("with_11"), F.size(sets.remove_int(s, 3)).alias("without_3"), F.size(F.array_intersect(s, three)).alias("common"), F.size(F.array_except(s, three)).alias("rest"), (F.size(F.array_except(F.array(F.lit(1), F.lit(2)), s)) == 0).alias("has_both"))


# Random sources


@query()
def random_longs(spark, sf_dir):
    """A few words of every generator, at fixed seeds."""
    out = None
    for name in rnd.GENERATORS:
        d = rnd.longs(spark, 1000, 42, name).select(F.lit(name).alias("generator"), "id", "value")
        out = d if out is None else out.unionByName(d)
    return out


@query()
def random_variates(spark, sf_dir):
    """Means and variances of 50,000 draws of each distribution."""
    params = {"uniform": (2.0, 5.0), "normal": (1.0, 2.0), "cauchy": (0.0, 1.0), "exponential": (0.5,), "gamma": (2.0, 3.0), "beta": (2.0, 3.0), "chi_square": (4.0,), "fisher_f": (5, 12), "log_normal": (0.0, 0.5), "student_t": (6.0,), "weibull": (2.0, 1.5), "truncated_standard_normal": (-1.0, 2.0), "lecun_normal": (0.5,), "inverse_gamma": (4.0, 2.0)}
    out = None
    for name, p in params.items():
        d = rnd.variates(spark, name, 50_000, *p, seed=11).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.var_samp("value").alias("variance"))
        out = d if out is None else out.unionByName(d)
    return out


@query("SELECT CAST(20000 AS BIGINT) AS n, true AS in_range, true AS both_ends, true AS spread")
def random_bounded(spark, sf_dir):
    d = rnd.bounded_longs(spark, 20_000, -3, 12, 5)
    return d.agg(F.count(F.lit(1)).alias("n"), (F.min("value") >= -3).alias("in_range") & (F.max("value") <= 12), ((F.min("value") == -3) & (F.max("value") == 12)).alias("both_ends"), (F.abs(F.avg("value") - 4.5) < 0.2).alias("spread")).toDF("n", "in_range", "both_ends", "spread")


@query("SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS different, true AS in_range")
def random_without_replacement(spark, sf_dir):
    return rnd.ints_without_replacement(spark, 10, 999, 100, 1).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("different"), (F.min("value") >= 10).alias("a") & (F.max("value") <= 999)).toDF("n", "different", "in_range")


@query()
def multivariate_normal(spark, sf_dir):
    return rnd.multivariate_normal(spark, np.array([1.0, -1.0]), np.array([[2.0, 0.6], [0.6, 1.0]]), 20_000, 4).agg(F.avg(F.col("sample")[0]).alias("m0"), F.avg(F.col("sample")[1]).alias("m1"), F.covar_samp(F.col("sample")[0], F.col("sample")[1]).alias("c01"))
