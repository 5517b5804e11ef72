"""Pivot and recipe queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalog import query
from foliant.model import table
from foliant.operators import frames

FLAGS = ["A", "N", "R"]


@query("SELECT l_returnflag, l_linestatus, round_even(sum(l_quantity), 2) AS sum_l_quantity, round_even(avg(l_extendedprice), 2) AS average_l_extendedprice, round_even(max(l_tax), 2) AS max_l_tax, count(l_discount)::DOUBLE AS count_l_discount, min(l_linenumber)::DOUBLE AS min_l_linenumber FROM lineitem GROUP BY 1, 2")
def pivot_flat(spark, sf_dir):
    values = {"l_quantity": "sum", "l_extendedprice": "average", "l_tax": "max", "l_discount": "count", "l_linenumber": "min"}
    return frames.pivot_flat(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], values)


@query("SELECT l_linenumber::VARCHAR AS l_linenumber, " + ", ".join(f"coalesce(round_even(sum(l_quantity) FILTER (l_returnflag = '{f}'), 2), 0.0) AS \"{f}\"" for f in FLAGS) + " FROM lineitem GROUP BY 1")
def pivot_cross(spark, sf_dir):
    return frames.pivot_cross(table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_returnflag", "l_quantity", "sum", FLAGS)


@query("SELECT coalesce(l_linestatus, 'All') AS l_linestatus, " + ", ".join(f"sum(l_quantity) FILTER (l_returnflag = '{f}') AS \"{f}\"" for f in FLAGS) + ", sum(l_quantity) AS \"All\" FROM lineitem GROUP BY ROLLUP (l_linestatus)")
def rollup_margins(spark, sf_dir):
    return frames.with_margins(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", "l_quantity", FLAGS)


@query("SELECT p_brand, round(sum(p_retailprice), 4) AS total, round(avg(p_retailprice), 4) AS mean, count(*) AS n, max(p_retailprice) AS top FROM part GROUP BY 1")
def category_summary(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 4).alias("total"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.count("*").alias("n"), F.max("p_retailprice").alias("top"))


_MONTHS = "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1"


def _months(spark, sf_dir):
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").groupBy(month.cast("timestamp_ntz").alias("month")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))


@query(f"WITH m AS ({_MONTHS}), s AS (SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS month) SELECT s.month, round(coalesce(total, 0.0), 2) AS total, coalesce(n, 0) AS n FROM s LEFT JOIN m USING (month)")
def monthly_resample(spark, sf_dir):
    out = frames.monthly(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    return out.select(F.col("month").cast("timestamp_ntz").alias("month"), F.round("total", 2).alias("total"), "n")


@query(f"WITH m AS ({_MONTHS}) SELECT month, round(total / lag(total) OVER (ORDER BY month) - 1, 9) AS pct_change FROM m")
def pct_change(spark, sf_dir):
    return frames.pct_change(_months(spark, sf_dir), [], ["month"], "total").select("month", F.round("pct_change", 9).alias("pct_change"))


@query(f"WITH m AS ({_MONTHS}) SELECT month, round(CASE WHEN count(*) OVER w = 3 THEN avg(total) OVER w END, 4) AS rolling_mean FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_mean(spark, sf_dir):
    return frames.rolling_mean(_months(spark, sf_dir), [], ["month"], "total").select("month", F.round("rolling_mean", 4).alias("rolling_mean"))


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running_total FROM orders")
def running_total(spark, sf_dir):
    out = frames.running(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return out.select("o_custkey", "o_orderkey", F.round("running_total", 2).alias("running_total"))


@query("SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std, min(o_totalprice) AS low, quantile_cont(o_totalprice, 0.5) AS median, max(o_totalprice) AS high, round(skewness(o_totalprice), 6) AS skew FROM orders")
def describe_stats(spark, sf_dir):
    out = frames.describe(table(spark, sf_dir, "orders"), "o_totalprice")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "skew")})


@query("SELECT round(corr(l_quantity, l_extendedprice), 3) AS quantity_price, round(corr(l_discount, l_tax), 3) AS discount_tax FROM lineitem")
def corr_stats(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 3).alias("quantity_price"), F.round(F.corr("l_discount", "l_tax"), 3).alias("discount_tax"))


@query("WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer) SELECT c_custkey, c_acctbal FROM customer, q WHERE c_acctbal BETWEEN a - 0.3 * (b - a) AND b + 0.3 * (b - a)")
def iqr_outliers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return c.crossJoin(F.broadcast(frames.outlier_bounds(c, "c_acctbal", 0.3))).where("c_acctbal BETWEEN low AND high").drop("low", "high")  # one row is broadcast


@query("SELECT count(*) AS n_rows, count(*) FILTER (lang IS NULL) AS null_lang, count(*) FILTER (source IS NULL) AS null_source, (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM documents)) AS n_distinct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM documents)) AS n_duplicates FROM documents")
def shape_nulls_duplicates(spark, sf_dir):
    return frames.shape(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("WITH o AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), n AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1) SELECT o_custkey, round(o.v, 2) AS v_old, round(n.v, 2) AS v_new, round(n.v - o.v, 2) AS change, round((n.v - o.v) / o.v * 100, 6) AS pct FROM o JOIN n USING (o_custkey)")
def merge_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    part = lambda cond: o.where(cond).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    out = frames.diff(part("o_orderdate < TIMESTAMP '1997-01-01'"), part("o_orderdate >= TIMESTAMP '1997-01-01'"), "o_custkey", "v")
    return out.select("o_custkey", *[F.round(c, 2).alias(c) for c in ("v_old", "v_new", "change")], F.round("pct", 6).alias("pct"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_normalize(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("SELECT doc_id, try_cast(substr(source, 4) AS DOUBLE) AS number, coalesce(try_cast(nullif(lang, 'fr') AS VARCHAR), 'none') AS lang FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def coerce_and_fill(spark, sf_dir):
    d = table(spark, sf_dir, "documents").na.drop(subset=["lang", "source"])
    return d.select("doc_id", F.expr("try_cast(substring(source, 4) AS double)").alias("number"), F.coalesce(F.nullif("lang", F.lit("fr")), F.lit("none")).alias("lang"))


@query("WITH r AS (SELECT l_returnflag AS config, avg(l_quantity) AS m, coalesce(stddev_samp(l_quantity), 0) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1), a AS (SELECT * FROM r ORDER BY config LIMIT 1) SELECT r.config, round_even(r.m, 4) AS mean, round_even(r.s, 4) AS stddev, round_even(r.lo, 4) AS \"min\", round_even(r.hi, 4) AS \"max\", round_even(round_even(r.m, 4) - round_even(a.m, 4), 4) AS delta FROM r, a")
def run_stats_delta(spark, sf_dir):
    stats = frames.run_stats(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "config"), ["config"], "l_quantity")
    first = stats.agg(F.min_by("mean", "config").alias("base"))
    return stats.crossJoin(F.broadcast(first)).withColumn("delta", F.bround(F.col("mean") - F.col("base"), 4)).drop("base")  # one row is broadcast


@query("SELECT n_name, sum(o_totalprice) AS actual, 1000000.0::DOUBLE AS budget, sum(o_totalprice) - 1000000.0 AS variance, (sum(o_totalprice) - 1000000.0) / 1000000.0 AS share, CASE WHEN sum(o_totalprice) > 1100000 THEN 'over' WHEN sum(o_totalprice) < 900000 THEN 'under' ELSE 'on track' END AS status FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1".replace("sum(o_totalprice)", "round(sum(o_totalprice), 2)"))
def budget_variance(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    actual = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("actual"))
    budget = F.lit(1000000.0)
    return actual.withColumns({"budget": budget, "variance": F.col("actual") - budget, "share": (F.col("actual") - budget) / budget, "status": F.when(F.col("actual") > 1100000, "over").when(F.col("actual") < 900000, "under").otherwise("on track")})


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '-42'), doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY lang) * 0.4)) AS held FROM documents")
def stratified_split(spark, sf_dir):
    return frames.split_holdout(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.4)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_n(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().join(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
