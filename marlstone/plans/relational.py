"""Scans, projections, predicates, sorting, limits, set operations and CTEs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.emulations import keep_first, qualify, top_k
from .registry import query, sql_query

# ---- sources ---------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def scan_parquet_pushdown(t):
    return t.orders.filter((F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") == "F")).select(
        "o_orderkey", "o_orderstatus", "o_totalprice"
    )


@query("SELECT range AS id FROM range(3, 1000, 7)")
def source_range(t):
    return t.spark.range(3, 1000, 7).toDF("id")


@query("SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE), (2, NULL, 2.5::DOUBLE), (3, 'c', NULL)) v(id, name, score)")
def source_local_rows(t):
    return t.spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5), (3, "c", None)], "id int, name string, score double")


@query("SELECT CAST(NULL AS INTEGER) AS id, CAST(NULL AS VARCHAR) AS name WHERE false")
def source_empty(t):
    return t.spark.createDataFrame([], "id int, name string")


sql_query("source_values", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(k, name)")
sql_query("source_single_row", "SELECT 1 AS one, 'text' AS word, CAST(2.5 AS DOUBLE) AS num")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_temp_view(t):
    t.nation.createOrReplaceTempView("nation_view")
    return t.spark.table("nation_view")


def _round_trip(t, kind: str, df, **options):
    from ..sources.files import scratch

    path = scratch(t.spark, kind)
    df.write.format(kind).options(**options).save(path)
    return t.spark.read.format(kind).options(**options).schema(df.schema).load(path)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def source_csv(t):
    return _round_trip(t, "csv", t.customer, header=True)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def source_json(t):
    return _round_trip(t, "json", t.supplier)


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def source_orc(t):
    return _round_trip(t, "orc", t.part.select("p_partkey", "p_name", "p_brand", "p_size"))


@query("SELECT r_name AS value FROM region")
def source_text(t):
    return _round_trip(t, "text", t.region.select(F.col("r_name").alias("value")))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def sink_partitioned_parquet(t):
    from ..sources.files import scratch

    path = scratch(t.spark, "parquet")
    t.orders.select("o_orderkey", "o_orderstatus").write.mode("overwrite").partitionBy("o_orderstatus").parquet(path)
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES (0, 'a'), (1, 'b'), (2, 'c')) v(pos, item)")
def source_posexplode_tvf(t):
    return t.spark.sql("SELECT pos, col AS item FROM posexplode(array('a', 'b', 'c'))")


# ---- projection ------------------------------------------------------------


@query("SELECT c_custkey, upper(c_name) AS name_upper, c_acctbal * 2 AS twice FROM customer")
def project_expressions(t):
    return t.customer.select("c_custkey", F.upper("c_name").alias("name_upper"), (F.col("c_acctbal") * 2).alias("twice"))


@query("SELECT c_custkey + 1 AS next_key, length(c_name)::BIGINT AS len FROM customer WHERE c_nationkey BETWEEN 3 AND 9")
def project_select_expr(t):
    return t.customer.filter("c_nationkey BETWEEN 3 AND 9").selectExpr("c_custkey + 1 AS next_key", "CAST(length(c_name) AS BIGINT) AS len")


@query("SELECT s_suppkey, s_name, s_nationkey + 100 AS s_nationkey, s_acctbal, s_acctbal > 0 AS positive FROM supplier")
def project_with_columns(t):
    return t.supplier.withColumns({"s_nationkey": F.col("s_nationkey") + 100, "positive": F.col("s_acctbal") > 0})


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def project_rename(t):
    return t.region.withColumnsRenamed({"r_regionkey": "id", "r_name": "name"})


@query("SELECT n_nationkey, n_name FROM nation")
def project_drop(t):
    return t.nation.drop("n_regionkey", "missing_column")


@query("SELECT n_nationkey AS a, n_name AS b, n_regionkey AS c FROM nation")
def project_to_df(t):
    return t.nation.toDF("a", "b", "c")


@query("SELECT n_name, n_nationkey::BIGINT AS n_nationkey FROM nation")
def project_to_schema(t):
    return t.nation.to(T.StructType([T.StructField("n_name", T.StringType()), T.StructField("n_nationkey", T.LongType())]))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def project_regex(t):
    return t.customer.select(t.customer.colRegex("`c_.*`"))


@query("SELECT n.n_name, n.n_regionkey FROM nation n WHERE n.n_regionkey = 2")
def project_alias(t):
    return t.nation.alias("n").filter(F.col("n.n_regionkey") == 2).select("n.n_name", "n.n_regionkey")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def partitioning_hints(t):
    moved = t.orders.hint("rebalance").repartition(8, "o_orderstatus").repartitionByRange(4, "o_orderkey").coalesce(2)
    return moved.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


sql_query(
    "cte_chain",
    """
    WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000),
         per AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM big GROUP BY o_custkey)
    SELECT o_custkey, n, total FROM per WHERE n >= 3
    """,
)
sql_query("cte_column_list", "WITH k(a, b) AS (SELECT n_nationkey, n_name FROM nation) SELECT a, b FROM k WHERE a < 7")

# ---- predicates ------------------------------------------------------------

for _name, _where in {
    "comparison": "c_acctbal >= 1000 AND c_acctbal < 5000 AND c_nationkey <> 4",
    "three_valued_logic": "NOT (nullif(c_nationkey, 3) > 10) OR (nullif(c_nationkey, 3) IS NULL AND c_acctbal > 0)",
    "between": "c_nationkey NOT BETWEEN 5 AND 20",
    "in_list": "c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)",
    "in_subquery": "c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "not_in_subquery": "c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))",
    "exists": "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "not_exists": "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "scalar_subquery": "c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "correlated_scalar": "c_acctbal > (SELECT max(s_acctbal) * 0.9 FROM supplier WHERE s_nationkey = c_nationkey)",
    "like": "c_name LIKE 'Customer#0000_0%' AND c_name NOT LIKE '%7'",
    "is_null": "nullif(c_mktsegment, 'BUILDING') IS NULL OR nullif(c_nationkey, 0) IS NULL",
    "is_true": "(nullif(c_nationkey, 2) > 10) IS TRUE",
    "is_not_false": "(nullif(c_nationkey, 2) > 10) IS NOT FALSE",
    "is_distinct_from": "nullif(c_nationkey, 2) IS DISTINCT FROM 5",
    "is_not_distinct_from": "nullif(c_nationkey, 2) IS NOT DISTINCT FROM NULL",
    "tuple_in": "(c_nationkey, c_mktsegment) IN ((1, 'BUILDING'), (2, 'MACHINERY'), (3, 'AUTOMOBILE'))",
}.items():
    sql_query(f"predicate_{_name}", f"SELECT c_custkey, c_name, c_nationkey FROM customer WHERE {_where}")


@query(
    "SELECT c_custkey FROM customer WHERE contains(c_name, '00012') OR starts_with(c_mktsegment, 'BUI') "
    "OR ends_with(c_name, '99') OR c_mktsegment ILIKE 'machin%' OR regexp_matches(c_name, '#0+5[0-3]$')"
)
def predicate_strings(t):
    c = t.customer
    return c.filter(
        c.c_name.contains("00012")
        | c.c_mktsegment.startswith("BUI")
        | c.c_name.endswith("99")
        | c.c_mktsegment.ilike("machin%")
        | c.c_name.rlike("#0+5[0-3]$")
    ).select("c_custkey")


@query("SELECT event_id, isnan(CASE WHEN event_id % 5 = 0 THEN 'NaN'::DOUBLE ELSE value END) AS is_nan FROM events")
def predicate_nan(t):
    return t.events.select("event_id", F.isnan(F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).alias("is_nan"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IS NOT DISTINCT FROM 4")
def predicate_null_safe_equal(t):
    return t.customer.filter(F.col("c_nationkey").eqNullSafe(4)).select("c_custkey", "c_nationkey")


# ---- sort, limit, distinct -------------------------------------------------

def _numbered(customer, by_key, by_id):
    """All customers in order with their positions: those within a key after the rows of the keys before it."""
    rows = customer.select("c_custkey", F.expr("nullif(c_nationkey, 3)").alias("k"))
    earlier = Window.orderBy(by_key).rowsBetween(Window.unboundedPreceding, -1)  # one row per nation
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    within = rows.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy(by_id)))
    placed = within.join(keys.select(F.col("k").alias("of"), "before"), F.col("k").eqNullSafe(F.col("of")))
    return placed.select("c_custkey", "k", (F.col("before") + F.col("i")).alias("pos")).orderBy(by_key, by_id)


@query("SELECT c_custkey, k, row_number() OVER (ORDER BY k ASC NULLS FIRST, c_custkey DESC NULLS LAST) AS pos FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer)")
def sort_nulls(t):
    return _numbered(t.customer, F.asc_nulls_first("k"), F.desc_nulls_last("c_custkey"))


@query("SELECT c_custkey, k, row_number() OVER (ORDER BY k DESC NULLS FIRST, c_custkey ASC NULLS FIRST) AS pos FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer)")
def sort_desc_nulls_first(t):
    return _numbered(t.customer, F.desc_nulls_first("k"), F.asc_nulls_first("c_custkey"))


sql_query("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS FIRST LIMIT 25 OFFSET 10")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_top_k(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
def sort_offset(t):
    return t.orders.orderBy("o_orderkey").offset(100).select("o_orderkey")


@query("SELECT o_custkey, count(*) AS n, max(o_orderkey) AS newest FROM orders GROUP BY o_custkey")
def sort_within_partitions(t):
    """The order inside partitions is observed: a customer's first row is the newest."""

    def first_rows(batches):
        last = None  # the customer that may go on in the next batch
        for pdf in batches:
            new = pdf.o_custkey.ne(pdf.o_custkey.shift(fill_value=-1 if last is None else last))
            if len(pdf):
                last = pdf.o_custkey.iloc[-1]
            yield pdf.assign(newest=pdf.o_orderkey.where(new))[["o_custkey", "newest"]]

    rows = t.orders.select("o_custkey", "o_orderkey").repartition("o_custkey").sortWithinPartitions("o_custkey", F.desc("o_orderkey"))
    marked = rows.mapInPandas(first_rows, "o_custkey long, newest double")
    return marked.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("newest").cast("long").alias("newest"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 12")
def sort_tail(t):
    # the last rows of an order, as tail(12) gives them, without a sort of the table
    rows = t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(12)
    return rows.orderBy("o_totalprice", "o_orderkey")


sql_query(
    "sort_over_rollup",
    "SELECT o_orderstatus, o_orderpriority, n, CAST(row_number() OVER (ORDER BY o_orderstatus ASC NULLS LAST, o_orderpriority ASC NULLS LAST) AS BIGINT) AS pos FROM "
    "(SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)) r ORDER BY o_orderstatus ASC NULLS LAST, o_orderpriority ASC NULLS LAST",
)


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(t):
    return t.customer.select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def distinct_keep_first(t):
    return keep_first(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("SELECT DISTINCT c_mktsegment FROM customer")
def drop_duplicates_subset(t):
    return t.customer.dropDuplicates(["c_mktsegment"]).select("c_mktsegment")


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_k_per_group(t):
    return top_k(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST) = 2")
def qualify_rank(t):
    return qualify(t.orders, "rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST) = 2").select("o_orderkey", "o_custkey")


@query()
def sample_bernoulli(t):
    return t.orders.sample(0.1, seed=7).select("o_orderkey")


@query()
def sample_with_replacement(t):
    return t.orders.sample(True, 0.2, seed=7).select("o_orderkey")


# ---- set operations --------------------------------------------------------

_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"
for _name, _op in {
    "union_all": "UNION ALL",
    "union": "UNION",
    "except": "EXCEPT",
    "except_all": "EXCEPT ALL",
    "intersect": "INTERSECT",
    "intersect_all": "INTERSECT ALL",
}.items():
    sql_query(f"set_{_name}", f"({_A}) {_op} ({_B})")
sql_query("set_minus", f"({_A}) MINUS ({_B})", f"({_A}) EXCEPT ({_B})")


@query("SELECT n_nationkey AS id, n_name AS name, NULL::VARCHAR AS extra FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def set_union_by_name_missing(t):
    left = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    right = t.region.select(F.col("r_name").alias("extra"), F.col("r_regionkey").alias("id"))
    return left.unionByName(right, allowMissingColumns=True)


@query("SELECT n_nationkey::DOUBLE AS v FROM nation UNION ALL SELECT s_acctbal FROM supplier")
def set_union_widening(t):
    return t.nation.select(F.col("n_nationkey").alias("v")).union(t.supplier.select("s_acctbal"))


@query("SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def set_subtract(t):
    return t.customer.select("c_nationkey").subtract(t.supplier.select("s_nationkey"))


# ---- tables and catalog ----------------------------------------------------


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey * 2 AS twice FROM nation WHERE n_regionkey > 0")
def table_as_select(t):
    """CREATE TABLE AS SELECT and INSERT; columns are renamed and dropped on the way out."""
    from ..sources.files import scratch

    spark, name = t.spark, "marlstone_ctas"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    t.nation.createOrReplaceTempView("nation")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{scratch(spark, 'ctas')}' AS SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
    spark.sql(f"INSERT INTO {name} SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey > 1")
    # Parquet tables can neither rename nor drop a column in place
    renamed = spark.table(name).withColumnsRenamed({"n_nationkey": "id", "n_name": "name"}).withColumn("twice", F.col("n_regionkey") * 2)
    return renamed.drop("n_regionkey")


@query("SELECT * FROM (VALUES ('marlstone_listed', 'n_nationkey', 'int'), ('marlstone_listed', 'n_name', 'string')) v(t, c, kind)")
def catalog_columns(t):
    t.nation.select("n_nationkey", "n_name").createOrReplaceTempView("marlstone_listed")
    listed = [x.name for x in t.spark.catalog.listTables() if x.name == "marlstone_listed"]
    rows = [(name, c.name, c.dataType) for name in listed for c in t.spark.catalog.listColumns(name)]
    return t.spark.createDataFrame(rows, "t string, c string, kind string")


@query("SELECT true AS has_upper, 'upper' AS name, 'spark_catalog' AS catalog, 'default' AS db, 'on' AS conf")
def catalog_functions(t):
    catalog, conf = t.spark.catalog, t.spark.conf
    conf.set("marlstone.example", "on")
    found = catalog.getFunction("upper")
    row = (any(f.name == "upper" for f in catalog.listFunctions()), found.name, catalog.currentCatalog(), catalog.currentDatabase(), conf.get("marlstone.example"))
    conf.unset("marlstone.example")
    return t.spark.createDataFrame([row], "has_upper boolean, name string, catalog string, db string, conf string")


@query("SELECT n_nationkey FROM nation")
def catalog_global_view(t):
    t.nation.select("n_nationkey").createOrReplaceGlobalTempView("marlstone_global")
    return t.spark.newSession().table("global_temp.marlstone_global")
