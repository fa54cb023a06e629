"""Grouping, grouping sets, pivots and every aggregate function."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.emulations import exact_percentiles
from .registry import query, sql_query


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1, 2")
def agg_group_by(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.min("o_totalprice").alias("low"),
        F.max("o_totalprice").alias("high"),
    )


sql_query("agg_global", "SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders")
sql_query("agg_global_empty", "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders WHERE o_totalprice < 0")
sql_query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 100000")
sql_query("agg_expression_key", "SELECT c_custkey % 7 AS bucket, count(*) AS n FROM customer GROUP BY c_custkey % 7")
sql_query("agg_group_by_all", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
sql_query("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus")
sql_query(
    "agg_distinct",
    "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, round(avg(DISTINCT o_custkey), 4) AS a FROM orders GROUP BY o_orderstatus",
)


@query("SELECT count(*) AS n FROM (SELECT DISTINCT nullif(c_nationkey, 3) AS a, c_mktsegment AS b FROM customer) WHERE a IS NOT NULL AND b IS NOT NULL")
def agg_count_distinct_multi(t):
    return t.customer.select(F.count_distinct(F.nullif("c_nationkey", F.lit(3)), "c_mktsegment").alias("n"))


sql_query(
    "agg_rollup",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS g1, CAST(grouping(o_orderpriority) AS BIGINT) AS g2 FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)",
)
sql_query(
    "agg_cube",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS gid FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)",
)
sql_query("agg_grouping_sets", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())")


@query("SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)")
def agg_cube_dataframe(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", "
    "count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority"
)
def agg_pivot(t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query(
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", "
    "count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority"
)
def agg_pivot_discovered(t):
    # the values are found by a pass of their own; Spark refuses more than spark.sql.pivotMaxValues
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus").agg(F.count(F.lit(1))).fillna(0)


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_mktsegment), ())")
def agg_grouping_sets_dataframe(t):
    sets = [("c_nationkey", "c_mktsegment"), ("c_mktsegment",), ()]
    return t.customer.groupingSets([[F.col(c) for c in s] for s in sets], "c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT c_nationkey, max(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS \"BUILDING_hi\", count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS \"BUILDING_n\", "
    "max(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS \"MACHINERY_hi\", count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS \"MACHINERY_n\" FROM customer GROUP BY c_nationkey"
)
def agg_pivot_many(t):
    wide = t.customer.groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"])
    return wide.agg(F.max("c_acctbal").alias("hi"), F.count(F.lit(1)).alias("n")).fillna(0, ["BUILDING_n", "MACHINERY_n"])


@query(
    "SELECT p_partkey, 'p_size' AS measure, p_size::DOUBLE AS amount FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part"
)
def agg_unpivot(t):
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot("p_partkey", ["p_size", "p_retailprice"], "measure", "amount")


_X, _Y = "l_quantity", "l_extendedprice"
sql_query(
    "agg_moments",
    f"""
    SELECT l_returnflag, round(avg({_X}), 6) AS avg_, round(mean({_X}), 6) AS mean_, round(stddev({_Y}), 4) AS sd, round(stddev_samp({_Y}), 4) AS sds,
      round(stddev_pop({_Y}), 4) AS sdp, round(variance({_X}), 6) AS var_, round(var_samp({_X}), 6) AS vars, round(var_pop({_X}), 6) AS varp
    FROM lineitem GROUP BY l_returnflag
    """,
)
sql_query("agg_std", f"SELECT l_linestatus, round(std({_X}), 6) AS s FROM lineitem GROUP BY l_linestatus", f"SELECT l_linestatus, round(stddev_samp({_X}), 6) AS s FROM lineitem GROUP BY l_linestatus")
sql_query(
    "agg_covariance",
    f"SELECT l_returnflag, round(corr({_X}, {_Y}), 8) AS r, round(covar_pop({_X}, {_Y}), 3) AS cp, round(covar_samp({_X}, {_Y}), 3) AS cs FROM lineitem GROUP BY l_returnflag",
)
sql_query(
    "agg_regression",
    f"""
    SELECT l_returnflag, CAST(regr_count({_Y}, {_X}) AS BIGINT) AS n, round(regr_r2({_Y}, {_X}), 8) AS r2, round(regr_slope({_Y}, {_X}), 5) AS slope,
      round(regr_intercept({_Y}, {_X}), 3) AS icept, round(regr_avgx({_Y}, {_X}), 6) AS ax, round(regr_avgy({_Y}, {_X}), 4) AS ay,
      round(regr_sxx({_Y}, {_X}), 2) AS sxx, round(regr_syy({_Y}, {_X}) / 1000000, 1) AS syy, round(regr_sxy({_Y}, {_X}), 0) AS sxy
    FROM lineitem GROUP BY l_returnflag
    """,
)
sql_query(
    "agg_shape",
    f"SELECT l_returnflag, round(kurtosis({_X}), 6) AS k, round(skewness({_X}), 6) AS s FROM lineitem GROUP BY l_returnflag",
    f"""
    SELECT l_returnflag, round(avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3, 6) AS k, round(avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5), 6) AS s
    FROM (SELECT l_returnflag, {_X} AS x, avg({_X}) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY l_returnflag
    """,
)
sql_query(
    "agg_boolean",
    "SELECT c_nationkey, bool_and(c_acctbal > 0) AS a, bool_or(c_acctbal > 9500) AS o, every(c_acctbal > -500) AS e, count_if(c_acctbal > 0) AS n FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, bool_and(c_acctbal > 0) AS a, bool_or(c_acctbal > 9500) AS o, bool_and(c_acctbal > -500) AS e, CAST(count_if(c_acctbal > 0) AS BIGINT) AS n FROM customer GROUP BY c_nationkey",
)
sql_query("agg_bitwise", "SELECT o_orderstatus, bit_and(o_custkey) AS a, bit_or(o_custkey) AS o, bit_xor(o_custkey) AS x FROM orders GROUP BY o_orderstatus")


@query(
    f"SELECT l_returnflag, quantile_cont({_Y}, 0.5) AS p50, quantile_cont({_Y}, 0.9) AS p90, median({_Y}) AS med FROM lineitem GROUP BY l_returnflag"
)
def agg_percentiles(t):
    # percentile() keeps every value of a group in one task; ranks are narrowed by bins instead
    return exact_percentiles(t.lineitem, "l_returnflag", _Y, {"p50": 0.5, "p90": 0.9, "med": 0.5})


sql_query(
    "agg_percentile_function",
    "SELECT o_custkey, percentile(o_totalprice, 0.5) AS p50, percentile(o_totalprice, 0.9) AS p90, median(o_totalprice) AS med FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.9) AS p90, median(o_totalprice) AS med FROM orders GROUP BY o_custkey",
)
sql_query(
    "agg_max_by",
    "SELECT c_nationkey, max_by(c_name, c_custkey) AS hi, min_by(c_name, c_custkey) AS lo FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, arg_max(c_name, c_custkey) AS hi, arg_min(c_name, c_custkey) AS lo FROM customer GROUP BY c_nationkey",
)
sql_query(
    "agg_collect",
    "SELECT c_nationkey, array_join(sort_array(collect_list(c_mktsegment)), ',') AS l, array_join(sort_array(collect_set(c_mktsegment)), ',') AS s, "
    "array_join(sort_array(array_agg(c_mktsegment)), ',') AS g FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, array_to_string(list_sort(list(c_mktsegment)), ',') AS l, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS s, "
    "array_to_string(list_sort(array_agg(c_mktsegment)), ',') AS g FROM customer GROUP BY c_nationkey",
)
sql_query(
    "agg_any_value",
    "SELECT o_custkey, any_value(o_custkey) AS v, first(o_custkey) AS f, last(o_custkey) AS l, first_value(o_custkey) AS fv, last_value(o_custkey) AS lv FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, o_custkey AS v, o_custkey AS f, o_custkey AS l, o_custkey AS fv, o_custkey AS lv FROM orders GROUP BY o_custkey",
)
sql_query(
    "agg_decimal",
    "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS s, CAST(avg(CAST(l_quantity AS INT)) AS DOUBLE) AS a FROM lineitem GROUP BY l_returnflag",
)


@query("SELECT o_orderstatus, true AS customers, true AS quartiles, true AS p90 FROM orders GROUP BY o_orderstatus")
def agg_approximate(t):
    """Whether the approximations keep the error that they promise."""
    got = t.orders.groupBy("o_orderstatus").agg(
        F.approx_count_distinct("o_custkey", 0.02).alias("about"),
        F.percentile_approx("o_totalprice", [0.25, 0.5, 0.75], 10_000).alias("q"),
        F.approx_percentile("o_totalprice", 0.9, 10_000).alias("p"),
    )
    exact = t.orders.groupBy("o_orderstatus", "o_custkey").agg(F.lit(1)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("exact"))
    under = lambda bound: F.avg((F.col("o_totalprice") <= bound).cast("double"))
    ranks = t.orders.join(got, "o_orderstatus").groupBy("o_orderstatus").agg(
        F.first("about").alias("about"), *[under(F.col("q")[i]).alias(f"r{i}") for i in range(3)], under(F.col("p")).alias("r3"), F.count(F.lit(1)).alias("n")
    )
    near = lambda name, share: F.abs(F.col(name) - share) <= 0.001 + 2 / F.col("n")
    return ranks.join(exact, "o_orderstatus").select(
        "o_orderstatus",
        (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("customers"),
        (near("r0", 0.25) & near("r1", 0.5) & near("r2", 0.75)).alias("quartiles"),
        near("r3", 0.9).alias("p90"),
    )
