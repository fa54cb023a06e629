"""Reporting queries in the style of retail decision support."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query

_c = F.col
_MONTHLY = """monthly AS (
  SELECT o_orderpriority AS pri, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, round(sum(o_totalprice), 2) AS total
  FROM orders GROUP BY 1, 2, 3)"""


def _monthly(t):
    year, month = F.year("o_orderdate").cast("long"), F.month("o_orderdate").cast("long")
    return t.orders.groupBy(_c("o_orderpriority").alias("pri"), year.alias("y"), month.alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    f"""WITH {_MONTHLY}, w AS (
      SELECT *, round(avg(total) OVER (PARTITION BY pri, y), 6) AS mean, lag(total) OVER (PARTITION BY pri ORDER BY y, m) AS before, lead(total) OVER (PARTITION BY pri ORDER BY y, m) AS after FROM monthly)
    SELECT pri, y, m, total, mean, before, after FROM w WHERE abs(total - mean) / mean > 0.2"""
)
def report_month_deviation(t):
    per, order = Window.partitionBy("pri", "y"), Window.partitionBy("pri").orderBy("y", "m")
    rows = _monthly(t).select(
        "*", F.round(F.avg("total").over(per), 6).alias("mean"), F.lag("total").over(order).alias("before"), F.lead("total").over(order).alias("after")
    )
    return rows.filter(F.abs(_c("total") - _c("mean")) / _c("mean") > 0.2)


@query(
    """WITH a AS (SELECT l_suppkey AS k, date_trunc('month', l_shipdate) AS d, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
    b AS (SELECT l_suppkey AS k, date_trunc('month', l_shipdate) AS d, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
    ca AS (SELECT k, d, round(sum(q) OVER (PARTITION BY k ORDER BY d), 2) AS q FROM a), cb AS (SELECT k, d, round(sum(q) OVER (PARTITION BY k ORDER BY d), 2) AS q FROM b),
    f AS (SELECT coalesce(ca.k, cb.k) AS k, coalesce(ca.d, cb.d) AS d, ca.q AS a, cb.q AS b FROM ca FULL JOIN cb ON ca.k = cb.k AND ca.d = cb.d),
    m AS (SELECT k, d, max(a) OVER w AS a, max(b) OVER w AS b FROM f WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT k, CAST(d AS TIMESTAMP) AS d, a, b FROM m WHERE a > b"""
)
def report_cumulative_lead(t):
    return _cumulative_lead(t.lineitem)


def _cumulative_lead(lineitem):
    # both running totals come from one grouped pass; no full join is needed
    month = F.date_trunc("MONTH", "l_shipdate").cast("timestamp_ntz")
    amount = lambda flag: F.round(F.sum(F.when(_c("l_returnflag") == flag, _c("l_quantity"))), 2)
    rows = lineitem.filter("l_returnflag IN ('A', 'R')").groupBy(_c("l_suppkey").alias("k"), month.alias("d")).agg(
        amount("A").alias("qa"), amount("R").alias("qr")
    )
    upto = Window.partitionBy("k").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("k", "d", F.round(F.sum("qa").over(upto), 2).alias("a"), F.round(F.sum("qr").over(upto), 2).alias("b")).filter("a > b")


@query(
    """WITH r AS (SELECT p_type, p_brand, p_size, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP(p_type, p_brand, p_size)),
    k AS (SELECT *, CAST(rank() OVER (PARTITION BY p_type ORDER BY total DESC NULLS LAST) AS BIGINT) AS rk FROM r) SELECT p_type, p_brand, p_size, total, rk FROM k WHERE rk <= 20"""
)
def report_rollup_rank(t):
    # lines are summed per part before the join, and parts per finest group before
    # the rollup, so that what it multiplies is no larger than the list of groups
    per_part = t.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("s"))
    finest = per_part.join(t.part, _c("l_partkey") == _c("p_partkey")).groupBy("p_type", "p_brand", "p_size").agg(F.sum("s").alias("s"))
    total = finest.rollup("p_type", "p_brand", "p_size").agg(F.round(F.sum("s"), 2).alias("total"))
    ranked = total.withColumn("rk", F.rank().over(Window.partitionBy("p_type").orderBy(F.desc_nulls_last("total"))))
    return ranked.filter("rk <= 20").withColumn("rk", _c("rk").cast("long"))


@query(
    """WITH s AS (SELECT l_suppkey, CAST(year(l_shipdate) AS BIGINT) AS y, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1, 2),
    r AS (SELECT l_suppkey, CAST(year(l_shipdate) AS BIGINT) AS y, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
    SELECT s.l_suppkey, s.y, s.n, coalesce(r.n, 0) AS returned, round(coalesce(r.n, 0) / s.n, 6) AS ratio, s.total FROM s LEFT JOIN r ON s.l_suppkey = r.l_suppkey AND s.y = r.y WHERE coalesce(r.n, 0) * 3 > s.n"""
)
def report_return_ratio(t):
    rows = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_c("l_returnflag") == "R").alias("returned"), F.round(F.sum("l_extendedprice"), 2).alias("total")
    )
    return rows.filter("returned * 3 > n").select("l_suppkey", "y", "n", "returned", F.round(_c("returned") / _c("n"), 6).alias("ratio"), "total")


@query(
    """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
    SELECT count(*) AS customers FROM (SELECT * FROM a INTERSECT SELECT * FROM b EXCEPT SELECT * FROM c)"""
)
def report_customer_overlap(t):
    # set operations on one key are a grouped test of which kinds a key has
    has = lambda kind: F.max((_c("o_orderstatus") == kind).cast("int"))
    per = t.orders.groupBy("o_custkey").agg(has("F").alias("f"), has("O").alias("o"), has("P").alias("p"))
    return per.filter("f = 1 AND o = 1 AND p = 0").agg(F.count(F.lit(1)).alias("customers"))


@query(
    """SELECT event_type, user_id, CAST(to_days_ AS BIGINT) AS day, n FROM (SELECT event_type, user_id, date_diff('day', TIMESTAMP '2024-01-01', ts) AS to_days_, count(*) AS n FROM events GROUP BY 1, 2, 3)
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id, to_days_) <= 5"""
)
def report_busiest_users(t):
    day = F.datediff(_c("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    per = t.events.groupBy("event_type", "user_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id", "day")
    return per.withColumn("k", F.row_number().over(order)).filter("k <= 5").drop("k")
