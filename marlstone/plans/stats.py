"""Missing values and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query

_HOLES = "(SELECT c_custkey, nullif(c_nationkey, 3) AS k, nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer)"


def _holes(t):
    return t.customer.select(
        "c_custkey",
        F.nullif("c_nationkey", F.lit(3)).alias("k"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"),
    )


@query(f"SELECT * FROM {_HOLES} WHERE k IS NOT NULL AND seg IS NOT NULL AND bal IS NOT NULL")
def na_drop_any(t):
    return _holes(t).dropna()


@query(f"SELECT * FROM {_HOLES} WHERE NOT (k IS NULL AND seg IS NULL)")
def na_drop_all_subset(t):
    return _holes(t).dropna("all", subset=["k", "seg"])


@query(f"SELECT * FROM {_HOLES} WHERE (k IS NOT NULL)::INT + (seg IS NOT NULL)::INT + (bal IS NOT NULL)::INT + 1 >= 3")
def na_drop_thresh(t):
    return _holes(t).dropna(thresh=3)


@query(f"SELECT c_custkey, coalesce(k, 0) AS k, seg, coalesce(bal, 0) AS bal FROM {_HOLES}")
def na_fill_value(t):
    return _holes(t).fillna(0)


@query(f"SELECT c_custkey, coalesce(k, -1) AS k, coalesce(seg, 'none') AS seg, bal FROM {_HOLES}")
def na_fill_dict(t):
    return _holes(t).fillna({"k": -1, "seg": "none"})


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def na_replace(t):
    return t.customer.select("c_custkey", "c_mktsegment").replace({"BUILDING": "B", "MACHINERY": None}, subset=["c_mktsegment"])


@query(
    "SELECT * FROM (SELECT 'count' AS summary, count(c_acctbal)::DOUBLE AS v FROM customer UNION ALL SELECT 'mean', round(avg(c_acctbal), 4) FROM customer "
    "UNION ALL SELECT 'stddev', round(stddev_samp(c_acctbal), 4) FROM customer UNION ALL SELECT 'min', min(c_acctbal) FROM customer UNION ALL SELECT 'max', max(c_acctbal) FROM customer)"
)
def stat_describe(t):
    return t.customer.describe("c_acctbal").select("summary", F.round(F.col("c_acctbal").cast("double"), 4).alias("v"))


@query()
def stat_summary(t):
    return t.customer.select("c_acctbal", "c_nationkey").summary("count", "min", "25%", "50%", "75%", "max", "count_distinct", "approx_count_distinct")


@query("SELECT round(covar_samp(l_quantity, l_extendedprice), 3) AS cov, round(corr(l_quantity, l_extendedprice), 8) AS cor FROM lineitem")
def stat_cov_corr(t):
    rows = t.lineitem
    pair = (round(rows.stat.cov("l_quantity", "l_extendedprice"), 3), round(rows.stat.corr("l_quantity", "l_extendedprice"), 8))
    return t.spark.createDataFrame([pair], "cov double, cor double")


@query("SELECT * FROM (VALUES (0.25::DOUBLE, true), (0.5::DOUBLE, true), (0.75::DOUBLE, true)) v(share, within)")
def stat_approx_quantile(t):
    """Whether the quantiles have the ranks they should; an error of 0 would keep every value on the driver."""
    shares, error = [0.25, 0.5, 0.75], 0.001
    found = t.orders.approxQuantile("o_totalprice", shares, error)
    ranks = [F.avg((F.col("o_totalprice") <= q).cast("double")).alias(f"r{i}") for i, q in enumerate(found)]
    near = lambda i, s: F.struct(F.lit(s).alias("share"), (F.abs(F.col(f"r{i}") - s) <= error + 2 / F.col("n")).alias("within"))
    row = t.orders.agg(*ranks, F.count(F.lit(1)).alias("n"))
    return row.select(F.inline(F.array(*[near(i, s) for i, s in enumerate(shares)])))


@query(
    "SELECT o_orderstatus AS o_orderstatus_o_orderpriority, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus"
)
def stat_crosstab(t):
    return t.orders.crosstab("o_orderstatus", "o_orderpriority").select("o_orderstatus_o_orderpriority", F.col("`1-URGENT`").alias("urgent"), F.col("`5-LOW`").alias("low"))


@query()
def stat_freq_items(t):
    return t.orders.freqItems(["o_orderstatus", "o_orderpriority"], 0.1)


@query()
def stat_sample_by(t):
    return t.orders.sampleBy("o_orderstatus", {"F": 0.1, "O": 0.2, "P": 1.0}, seed=11).select("o_orderkey", "o_orderstatus")
