"""Joins of every kind, semi and anti forms, as-of, band and lateral joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.emulations import asof_join, band_join, block_join
from .registry import query, sql_query

_JOIN = "SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c {} JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c.c_custkey = o.o_custkey"
for _kind in ("inner", "left", "right", "full"):

    @query(_JOIN.format(_kind.upper()), f"join_{_kind}")
    def _plan(t, kind=_kind):
        big = t.orders.filter("o_totalprice > 400000")
        return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), kind).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join_left_semi(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_left_anti(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(t):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT k, c_name, s_name FROM (SELECT c_nationkey AS k, c_name FROM customer) JOIN (SELECT s_nationkey AS k, s_name FROM supplier) USING (k)")
def join_using(t):
    customers = t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey", "c_name")
    suppliers = t.supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_name")
    # every customer meets every supplier of the same of 25 nations
    return block_join(customers, suppliers, "k", "c_custkey", "s_suppkey")


@query(
    "SELECT coalesce(a.k, b.k) AS k, a.m, b.n FROM (SELECT nullif(c_nationkey, 3) AS k, count(*) AS m FROM customer GROUP BY 1) a "
    "FULL JOIN (SELECT nullif(s_nationkey, 5) AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k"
)
def join_full_using(t):
    a = t.customer.groupBy(F.nullif("c_nationkey", F.lit(3)).alias("k")).agg(F.count(F.lit(1)).alias("m"))
    b = t.supplier.groupBy(F.nullif("s_nationkey", F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, ["k"], "full").select("k", "m", "n")


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate WHERE l.l_quantity > 49")
def join_equi_and_inequality(t):
    return (
        t.lineitem.filter("l_quantity > 49")
        .join(t.orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")))
        .select("l_orderkey", "l_linenumber", "o_orderdate")
    )


@query("SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def join_self(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    cond = (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_regionkey") == F.col("b.n_regionkey"))
    return a.join(b, cond).select(F.col("a.n_name").alias("low"), F.col("b.n_name").alias("high"))


@query("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey OR n.n_nationkey = s.s_suppkey")
def join_or_condition(t):
    cond = (F.col("s_nationkey") == F.col("n_nationkey")) | (F.col("n_nationkey") == F.col("s_suppkey"))
    return t.supplier.join(t.nation, cond).select("s_suppkey", "n_nationkey")


_NULLED = "(SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer)"
_NULLED2 = "(SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier)"
sql_query("join_null_keys", f"SELECT a.c_custkey, b.s_suppkey FROM {_NULLED} a JOIN {_NULLED2} b ON a.k = b.k")
sql_query(
    "join_null_safe",
    f"SELECT a.c_custkey, b.s_suppkey FROM {_NULLED} a JOIN {_NULLED2} b ON a.k <=> b.k",
    f"SELECT a.c_custkey, b.s_suppkey FROM {_NULLED} a JOIN {_NULLED2} b ON a.k IS NOT DISTINCT FROM b.k",
)
sql_query(
    "join_natural",
    "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y",
)
sql_query(
    "join_multi_way",
    """
    SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total
    FROM region JOIN nation ON r_regionkey = n_regionkey
    JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
    GROUP BY r_name, n_name
    """,
)


@query("SELECT n_name, c FROM nation JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON n_nationkey = c_nationkey")
def join_broadcast_hint(t):
    per = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"))
    # nation has one row per country, a bound that does not grow with the data
    return per.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c")


@query(
    "SELECT e.event_id, p.last_value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') e "
    "ASOF LEFT JOIN (SELECT user_id, ts, value AS last_value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts"
)
def join_asof(t):
    left = t.events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    right = t.events.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    return asof_join(left, right, "user_id", "ts", ["value"]).select("event_id", "last_value")


@query("SELECT a.s_suppkey, b.c_custkey FROM supplier a JOIN customer b ON abs(a.s_acctbal - b.c_acctbal) <= 15")
def join_band(t):
    return band_join(t.supplier.select("s_suppkey", "s_acctbal"), t.customer.select("c_custkey", "c_acctbal"), "s_acctbal", "c_acctbal", 15.0).select(
        "s_suppkey", "c_custkey"
    )


sql_query(
    "join_lateral",
    """
    SELECT n_name, x.c_custkey, x.c_acctbal FROM nation,
      LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey ASC NULLS FIRST LIMIT 2) x
    """,
)


@query("SELECT a.k AS left_k, b.k AS right_k, a.n_name, b.r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b ON a.k = b.k")
def join_same_name_keys(t):
    a = t.nation.select(F.col("n_regionkey").alias("k"), "n_name")
    b = t.region.select(F.col("r_regionkey").alias("k"), "r_name")
    joined = a.join(b, a["k"] == b["k"])  # both keys stay, told apart by their frames
    return joined.select(a["k"].alias("left_k"), b["k"].alias("right_k"), "n_name", "r_name")


@query("SELECT n_name, x.c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 2) x")
def join_lateral_dataframe(t):
    richest = t.customer.filter(F.col("c_nationkey") == F.col("n_nationkey").outer()).orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(2)
    return t.nation.lateralJoin(richest.select("c_custkey")).select("n_name", "c_custkey")
