"""Window functions, frames, null handling and named windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.emulations import sessions
from .registry import query, sql_query

_ORDER = "PARTITION BY o_custkey ORDER BY o_totalprice ASC NULLS FIRST, o_orderkey ASC NULLS FIRST"
for _name, _call in {
    "row_number": "CAST(row_number() OVER ({w}) AS BIGINT)",
    "rank": "CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ASC NULLS FIRST) AS BIGINT)",
    "dense_rank": "CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ASC NULLS FIRST) AS BIGINT)",
    "percent_rank": "round(percent_rank() OVER ({w}), 10)",
    "cume_dist": "round(cume_dist() OVER ({w}), 10)",
    "ntile": "CAST(ntile(4) OVER ({w}) AS BIGINT)",
    "lag": "lag(o_totalprice, 2) OVER ({w})",
    "lag_default": "lag(o_totalprice, 1, CAST(-1 AS DOUBLE)) OVER ({w})",
    "lead": "lead(o_orderkey) OVER ({w})",
    "first_value": "first_value(o_orderkey) OVER ({w})",
    "last_value": "last_value(o_orderkey) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "nth_value": "nth_value(o_orderkey, 2) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "running_sum": "round(sum(o_totalprice) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2)",
    "moving_average": "round(avg(o_totalprice) OVER ({w} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4)",
    "range_frame": "count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice ASC NULLS FIRST RANGE BETWEEN 50000 PRECEDING AND CURRENT ROW)",
    "whole_partition": "max(o_totalprice) OVER (PARTITION BY o_custkey)",
    "default_frame": "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ASC NULLS FIRST)",
}.items():
    sql_query(f"window_{_name}", f"SELECT o_orderkey, {_call.format(w=_ORDER)} AS v FROM orders")

_NULLED = "(SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS v FROM orders) x"
_BY_ORDER = "PARTITION BY o_custkey ORDER BY o_orderkey ASC NULLS FIRST"
sql_query(
    "window_ignore_nulls_offsets",
    f"SELECT o_orderkey, lag(v, 1) IGNORE NULLS OVER ({_BY_ORDER}) AS before, lead(v, 1) IGNORE NULLS OVER ({_BY_ORDER}) AS after, "
    f"nth_value(v, 2) IGNORE NULLS OVER ({_BY_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM {_NULLED}",
    f"SELECT o_orderkey, lag(v, 1 IGNORE NULLS) OVER ({_BY_ORDER}) AS before, lead(v, 1 IGNORE NULLS) OVER ({_BY_ORDER}) AS after, "
    f"nth_value(v, 2 IGNORE NULLS) OVER ({_BY_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM {_NULLED}",
)
sql_query(
    "window_decimal",
    "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ASC NULLS FIRST) AS DECIMAL(25,2)) AS upto, "
    "CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS BIGINT) AS whole FROM lineitem",
)
sql_query(
    "window_named",
    "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, min(o_totalprice) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ASC NULLS FIRST)",
)
sql_query(
    "window_over_aggregate",
    "SELECT c_nationkey, n, CAST(rank() OVER (ORDER BY n DESC NULLS LAST) AS BIGINT) AS r FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) x",
)


@query(
    "SELECT o_orderkey, last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS carried, "
    "first_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head "
    "FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS v FROM orders)"
)
def window_ignore_nulls(t):
    rows = t.orders.withColumn("v", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("o_orderkey", F.last("v", True).over(w).alias("carried"), F.first("v", True).over(whole).alias("head"))


@query(
    "WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) "
    "SELECT event_id, user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g"
)
def window_sessions(t):
    return sessions(t.events, "user_id", "ts", "6 HOUR").select("event_id", "user_id", F.col("session").cast("long").alias("session"))
