"""Decision-support queries over the order tables, adapted to their columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query

_c = F.col
_REV = "l_extendedprice * (1 - l_discount)"


def _revenue():
    return _c("l_extendedprice") * (1 - _c("l_discount"))


def _day(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _money(total, name: str, places: int = 2):
    return F.round(F.sum(total), places).alias(name)


@query(
    f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum({_REV}), 2) AS sum_disc_price, round(sum({_REV} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
    round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
)
def tpch_q1(t):
    return (
        t.lineitem.filter(_c("l_shipdate") <= _day("1998-09-02"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            _money(_c("l_quantity"), "sum_qty"),
            _money(_c("l_extendedprice"), "sum_base_price"),
            _money(_revenue(), "sum_disc_price"),
            _money(_revenue() * (1 + _c("l_tax")), "sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


@query(
    f"""SELECT o_orderkey, o_orderdate, round(sum({_REV}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1997-03-15'
    GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10"""
)
def tpch_q3(t):
    orders = t.orders.filter(_c("o_orderdate") < _day("1997-03-15"))
    building = t.customer.filter("c_mktsegment = 'BUILDING'")
    lines = t.lineitem.filter(_c("l_shipdate") > _day("1997-03-15"))
    joined = orders.join(building, _c("o_custkey") == _c("c_custkey")).join(lines, _c("l_orderkey") == _c("o_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderdate").agg(_money(_revenue(), "revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query(
    """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01'
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority"""
)
def tpch_q4(t):
    quarter = t.orders.filter((_c("o_orderdate") >= _day("1997-07-01")) & (_c("o_orderdate") < _day("1997-10-01")))
    later = quarter.join(t.lineitem, (_c("l_orderkey") == _c("o_orderkey")) & (_c("l_shipdate") > _c("o_orderdate")), "left_semi")
    return later.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))


@query(
    f"""SELECT n_name, round(sum({_REV}), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
    AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name"""
)
def tpch_q5(t):
    orders = t.orders.filter((_c("o_orderdate") >= _day("1996-01-01")) & (_c("o_orderdate") < _day("1998-01-01")))
    asia = t.nation.join(t.region.filter("r_name = 'ASIA'"), _c("n_regionkey") == _c("r_regionkey"))
    supply = t.supplier.join(asia, _c("s_nationkey") == _c("n_nationkey"))
    joined = (
        t.lineitem.join(orders, _c("l_orderkey") == _c("o_orderkey"))
        .join(supply, _c("l_suppkey") == _c("s_suppkey"))
        .join(t.customer, (_c("o_custkey") == _c("c_custkey")) & (_c("c_nationkey") == _c("s_nationkey")))
    )
    return joined.groupBy("n_name").agg(_money(_revenue(), "revenue"))


@query(
    """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
    AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24"""
)
def tpch_q6(t):
    year = (_c("l_shipdate") >= _day("1997-01-01")) & (_c("l_shipdate") < _day("1998-01-01"))
    cheap = _c("l_discount").between(0.045, 0.075) & (_c("l_quantity") < 24)
    return t.lineitem.filter(year & cheap).agg(_money(_c("l_extendedprice") * _c("l_discount"), "revenue"))


@query(
    f"""SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, round(sum({_REV}), 2) AS revenue
    FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
    WHERE (a.n_name = 'NATION_3' AND b.n_name = 'NATION_7') OR (a.n_name = 'NATION_7' AND b.n_name = 'NATION_3') GROUP BY 1, 2, 3"""
)
def tpch_q7(t):
    two = t.nation.filter(_c("n_name").isin("NATION_3", "NATION_7")).select("n_nationkey", "n_name")
    a, b = two.toDF("a_key", "supp_nation"), two.toDF("b_key", "cust_nation")
    supply, buyers = t.supplier.join(a, _c("s_nationkey") == _c("a_key")), t.customer.join(b, _c("c_nationkey") == _c("b_key"))
    # buyers cut the orders before the lines meet them
    bought = t.orders.join(buyers, _c("o_custkey") == _c("c_custkey")).select("o_orderkey", "cust_nation")
    joined = (
        t.lineitem.join(supply, _c("l_suppkey") == _c("s_suppkey"))
        .join(bought, (_c("o_orderkey") == _c("l_orderkey")) & (_c("supp_nation") != _c("cust_nation")))
    )
    return joined.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").cast("long").alias("l_year")).agg(_money(_revenue(), "revenue"))


@query(
    f"""SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, round(sum(CASE WHEN n2.n_name = 'NATION_5' THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS mkt_share
    FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
    WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
    AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'PROMO' GROUP BY 1"""
)
def tpch_q8(t):
    region = t.nation.join(t.region.filter("r_name = 'AMERICA'"), _c("n_regionkey") == _c("r_regionkey")).select(_c("n_nationkey").alias("in_region"))
    seller = t.nation.select(_c("n_nationkey").alias("sold_by"), _c("n_name").alias("seller"))
    # the region cuts the orders before the lines meet them
    buyers = t.customer.join(region, _c("c_nationkey") == _c("in_region"))
    bought = t.orders.join(buyers, _c("o_custkey") == _c("c_custkey")).select("o_orderkey", "o_orderdate")
    joined = (
        t.lineitem.join(t.part.filter("p_type = 'PROMO'"), _c("l_partkey") == _c("p_partkey"))
        .join(bought, _c("l_orderkey") == _c("o_orderkey"))
        .join(t.supplier.join(seller, _c("s_nationkey") == _c("sold_by")), _c("l_suppkey") == _c("s_suppkey"))
    )
    own = F.sum(F.when(_c("seller") == "NATION_5", _revenue()).otherwise(F.lit(0.0)))
    return joined.groupBy(F.year("o_orderdate").cast("long").alias("o_year")).agg(F.round(own / F.sum(_revenue()), 6).alias("mkt_share"))


@query(
    f"""SELECT c_custkey, c_name, round(sum({_REV}), 2) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey
    JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R'
    GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20"""
)
def tpch_q10(t):
    quarter = t.orders.filter((_c("o_orderdate") >= _day("1997-10-01")) & (_c("o_orderdate") < _day("1998-01-01")))
    joined = (
        t.lineitem.filter("l_returnflag = 'R'")
        .join(quarter, _c("l_orderkey") == _c("o_orderkey"))
        .join(t.customer, _c("o_custkey") == _c("c_custkey"))
        .join(t.nation, _c("c_nationkey") == _c("n_nationkey"))
    )
    return joined.groupBy("c_custkey", "c_name", "c_acctbal", "n_name").agg(_money(_revenue(), "revenue")).orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query(
    """SELECT l_returnflag, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_line_count, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_line_count
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY l_returnflag"""
)
def tpch_q12(t):
    year = t.lineitem.filter((_c("l_shipdate") >= _day("1998-01-01")) & (_c("l_shipdate") < _day("1999-01-01")))
    high = _c("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return year.join(t.orders, _c("l_orderkey") == _c("o_orderkey")).groupBy("l_returnflag").agg(
        F.count_if(high).alias("high_line_count"), F.count_if(~high).alias("low_line_count")
    )


@query("SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY c_count")
def tpch_q13(t):
    per = t.customer.join(t.orders, _c("c_custkey") == _c("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count"))
    return per.groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist"))


@query(
    f"""SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-12-01'"""
)
def tpch_q14(t):
    season = t.lineitem.filter((_c("l_shipdate") >= _day("1997-09-01")) & (_c("l_shipdate") < _day("1997-12-01")))
    promo = F.sum(F.when(_c("p_type").startswith("PROMO"), _revenue()).otherwise(F.lit(0.0)))
    return season.join(t.part, _c("l_partkey") == _c("p_partkey")).agg(F.round(100 * promo / F.sum(_revenue()), 6).alias("promo_revenue"))


@query(
    f"""WITH revenue AS (SELECT l_suppkey, round(sum({_REV}), 2) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = l_suppkey WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)"""
)
def tpch_q15(t):
    quarter = t.lineitem.filter((_c("l_shipdate") >= _day("1997-01-01")) & (_c("l_shipdate") < _day("1997-04-01")))
    revenue = quarter.groupBy("l_suppkey").agg(_money(_revenue(), "total_revenue"))
    best = revenue.agg(F.max("total_revenue").alias("best"))
    top = revenue.join(best, _c("total_revenue") == _c("best"))
    return t.supplier.join(top, _c("s_suppkey") == _c("l_suppkey")).select("s_suppkey", "s_name", "total_revenue")


@query(
    """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2'
    AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)"""
)
def tpch_q17(t):
    # one pass over lineitem: the average per part is a window, not a second scan
    per_part = Window.partitionBy("l_partkey")
    lines = t.lineitem.join(t.part.filter("p_brand = 'Brand#2'"), _c("l_partkey") == _c("p_partkey")).withColumn("mean", F.avg("l_quantity").over(per_part))
    return lines.filter(_c("l_quantity") < 0.2 * _c("mean")).agg(F.round(F.sum("l_extendedprice") / 7.0, 2).alias("avg_yearly"))


@query(
    """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) GROUP BY 1, 2, 3, 4, 5"""
)
def tpch_q18(t):
    large = t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity")).filter("quantity > 250")
    joined = t.orders.join(large, _c("o_orderkey") == _c("l_orderkey")).join(t.customer, _c("o_custkey") == _c("c_custkey"))
    return joined.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "quantity")


@query(
    f"""SELECT round(sum({_REV}), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
    OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)"""
)
def tpch_q19(t):
    wanted = F.lit(False)
    for brand, low, size in (("Brand#12", 1, 5), ("Brand#23", 10, 10), ("Brand#2", 20, 15)):
        wanted |= (_c("p_brand") == brand) & _c("l_quantity").between(low, low + 10) & _c("p_size").between(1, size)
    return t.lineitem.join(t.part, (_c("l_partkey") == _c("p_partkey")) & wanted).agg(_money(_revenue(), "revenue"))


@query(
    """SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey
    WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
    AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name"""
)
def tpch_q21(t):
    # per order: its suppliers, and those with returned lines; no self-joins
    returned = F.when(_c("l_returnflag") == "R", _c("l_suppkey"))
    # least and greatest tell one supplier from several, with map-side sums
    orders = t.lineitem.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"), F.min(returned).alias("x"), F.max(returned).alias("y"), F.count(returned).alias("lines")
    )
    alone = orders.filter("a < b AND x = y").join(t.orders.filter("o_orderstatus = 'F'"), _c("l_orderkey") == _c("o_orderkey"), "left_semi")
    per = alone.groupBy("x").agg(F.sum("lines").alias("lines"))
    return per.join(t.supplier, _c("x") == _c("s_suppkey")).groupBy("s_name").agg(F.sum("lines").alias("numwait"))


@query(
    """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_nationkey IN (3, 7, 11, 15)
    AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (3, 7, 11, 15))
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey"""
)
def tpch_q22(t):
    some = t.customer.filter(_c("c_nationkey").isin(3, 7, 11, 15))
    mean = some.filter("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))
    rich = some.join(mean, _c("c_acctbal") > _c("mean"))
    quiet = rich.join(t.orders.filter("o_orderstatus = 'P'"), _c("o_custkey") == _c("c_custkey"), "left_anti")
    return quiet.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("numcust"), _money(_c("c_acctbal"), "totacctbal"))
