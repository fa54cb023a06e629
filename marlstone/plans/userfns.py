"""User-defined functions of every kind, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .registry import query


@query("SELECT p_partkey, p_retailprice * 1.19 AS gross FROM part")
def udf_pandas_scalar(t):
    @F.pandas_udf("double")
    def gross(price: pd.Series) -> pd.Series:
        return price * 1.19

    return t.part.select("p_partkey", gross("p_retailprice").alias("gross"))


@query("SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 2) AS spread FROM customer GROUP BY c_nationkey")
def udf_grouped_aggregate(t):
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return t.customer.groupBy("c_nationkey").agg(F.round(spread("c_acctbal"), 2).alias("spread"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def udf_map_in_pandas(t):
    def big(batches):
        for pdf in batches:
            yield pdf[pdf.o_totalprice > 400000]

    return t.orders.select("o_orderkey", "o_totalprice").mapInPandas(big, "o_orderkey long, o_totalprice double")


@query("SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS place FROM orders")
def udf_apply_in_pandas(t):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(place=pdf.o_totalprice.rank(method="min", ascending=False).astype("int64"))[["o_custkey", "o_orderkey", "place"]]

    # a group is the orders of one customer, which one task can hold
    return t.orders.select("o_custkey", "o_orderkey", "o_totalprice").groupBy("o_custkey").applyInPandas(place, "o_custkey long, o_orderkey long, place long")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def udf_cogroup(t):
    def both(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "customers": [int(a.n.sum())], "suppliers": [int(b.n.sum())]})

    # groups are counted before they are sent, so that a key's rows need not meet
    counted = lambda df, key: df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("k")
    left, right = counted(t.customer, "c_nationkey"), counted(t.supplier, "s_nationkey")
    return left.cogroup(right).applyInPandas(both, "k int, customers long, suppliers long")


@query("SELECT n_nationkey, i AS step FROM nation, range(0, 3) r(i) WHERE i <= n_nationkey % 3")
def udf_table_function(t):
    @F.udtf(returnType="step bigint")
    class Steps:
        def eval(self, n: int):
            for i in range(n % 3 + 1):
                yield (i,)

    t.spark.udtf.register("marlstone_steps", Steps)
    return t.sql("SELECT n_nationkey, step FROM nation, LATERAL marlstone_steps(n_nationkey)")


@query("SELECT n_nationkey, n_nationkey * 10 - n_regionkey AS v FROM nation")
def udf_named_arguments(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION marlstone_less(a INT, b INT) RETURNS INT RETURN a * 10 - b")
    return t.sql("SELECT n_nationkey, marlstone_less(b => n_regionkey, a => n_nationkey) AS v FROM nation")


@query("SELECT range AS id, range * range AS square FROM range(100)")
def udf_data_source(t):
    """A data source in Python: numbers and their squares, read by several tasks."""

    # classes of this function travel with it, so workers need not import this module
    class Reader(DataSourceReader):
        def __init__(self, n: int):
            self.n = n

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(k) for k in range(4)]

        def read(self, partition: InputPartition):
            for i in range(partition.value, self.n, 4):
                yield i, i * i

    class Squares(DataSource):
        @classmethod
        def name(cls) -> str:
            return "marlstone_squares"

        def schema(self) -> str:
            return "id long, square long"

        def reader(self, schema) -> DataSourceReader:
            return Reader(int(self.options["n"]))

    t.spark.dataSource.register(Squares)
    return t.spark.read.format("marlstone_squares").option("n", "100").load()


@query("SELECT n_nationkey, n_nationkey * 2 + 1 AS v FROM nation")
def udf_sql_function(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION marlstone_odd(x INT) RETURNS INT RETURN x * 2 + 1")
    return t.sql("SELECT n_nationkey, marlstone_odd(n_nationkey) AS v FROM nation")


@query("SELECT upper(r_name) AS a, r_name || '!' AS b FROM region")
def udf_call_by_name(t):
    @F.pandas_udf("string")
    def loud(s: pd.Series) -> pd.Series:
        return s + "!"

    t.spark.udf.register("marlstone_loud", loud)
    return t.region.select(F.call_function("upper", "r_name").alias("a"), F.call_function("marlstone_loud", F.col("r_name")).alias("b"))
