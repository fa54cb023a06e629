"""Emulated operators, sources, sinks, catalog, streaming and plan shapes."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from marlstone.functions.catalog import exists, function
from marlstone.operators import emulations
from marlstone.operators.emulations import asof_join, band_join, block_join, keep_first, qualify, sessions, top_k
from marlstone.plans.catalog import QUERIES, flagship
from marlstone.sources import files
from marlstone.sources.tables import Tables
from marlstone.streaming import events as streaming


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_asof_join_carries_the_last_row(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (None, 3, "d")], "k int, at int, name string")
    right = spark.createDataFrame([(1, 2, 10.0), (1, 5, 20.0), (2, 10, 30.0)], "k int, at int, v double")
    got = {r["name"]: r["last_v"] for r in asof_join(left, right, "k", "at", ["v"]).collect()}
    assert got == {"a": 20.0, "b": None, "c": None, "d": None}


def test_band_join_equals_nested_loop(spark):
    a, b = spark.range(40).select((F.col("id") * 0.7).alias("x")), spark.range(40).select((F.col("id") * 0.9).alias("y"))
    got = {tuple(r) for r in band_join(a, b, "x", "y", 1.5).collect()}
    want = {tuple(r) for r in a.join(b, F.abs(F.col("x") - F.col("y")) <= 1.5).collect()}
    assert got == want
    assert "NestedLoop" not in plan(band_join(a, b, "x", "y", 1.5)) and "Cartesian" not in plan(band_join(a, b, "x", "y", 1.5))


def test_block_join_equals_a_plain_join(spark, monkeypatch):
    for name, small in (("LEFT_PIECE", 16), ("RIGHT_PIECE", 3), ("TASK_PAIRS", 100)):
        monkeypatch.setattr(emulations, name, small)
    # a hot key, keys of one side only, null keys, null values, equal rows, equal and null ids
    left = [(0, i, f"c{i % 90}") for i in range(200)] + [(1, 7, None), (1, 7, None), (2, 8, "x"), (None, 9, "y"), (4, None, "z")]
    right = [(0, i, f"s{i % 20}", i) for i in range(31)] + [(1, 1, None, 5), (3, 2, "x", 6), (None, 3, "y", 7), (4, None, "z", None), (4, None, "z", None)]
    a, b = spark.createDataFrame(left, "k int, a int, name string"), spark.createDataFrame(right, "k int, b int, title string, v int")
    got, want = block_join(a, b, "k", "a", "b"), a.drop("a").join(b.drop("b"), "k")
    assert got.schema.simpleString() == want.schema.simpleString() == "struct<k:int,name:string,title:string,v:int>"
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 20 and max(tasks) < sum(tasks) / 5
    assert block_join(a.limit(0), b, "k", "a", "b").count() == block_join(a, b.limit(0), "k", "a", "b").count() == 0


def test_qualify_keep_first_and_top_k(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (2, 5)], "k int, v int")
    assert sorted(map(tuple, keep_first(df, ["k"], [F.col("v")]).collect())) == [(1, 1), (2, 5)]
    assert sorted(map(tuple, top_k(df, ["k"], [F.desc("v")], 2).collect())) == [(1, 2), (1, 3), (2, 5)]
    assert sorted(map(tuple, qualify(df, "count(*) OVER (PARTITION BY k) = 1").collect())) == [(2, 5)]


def test_sessions_start_after_a_gap(spark):
    at = [dt.datetime(2024, 1, 1, h) for h in (0, 1, 9, 10)]
    df = spark.createDataFrame([(1, t) for t in at], "u int, ts timestamp_ntz")
    assert [r["session"] for r in sessions(df, "u", "ts", "2 HOUR").orderBy("ts").collect()] == [1, 1, 2, 2]


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "orc"])
def test_files_round_trip_with_mode_and_partitions(spark, kind):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "id int, name string, v double")
    path = files.scratch(spark, kind) + "." + kind
    files.write(df, path)
    with pytest.raises(AnalysisException):
        files.write(df, path)
    files.write(df, path, mode="append")
    assert sorted(map(str, files.read(spark, path, schema="id int, name string, v double").collect())) == sorted(map(str, df.union(df).collect()))
    files.write(df, path, mode="overwrite", partition_by=("id",))
    assert spark.read.format(kind).options(header=True).load(path).where("id = 2").count() == 1


def test_format_by_extension():
    assert [files.format_of(p) for p in ("a.csv", "b.tsv", "c.jsonl", "d.orc", "e.txt", "f.parquet", "g")] == ["csv", "csv", "json", "orc", "text", "parquet", "parquet"]


def test_ddl_and_catalog(spark):
    spark.sql("CREATE OR REPLACE TEMP VIEW v_ddl AS SELECT 1 AS a")
    assert spark.catalog.tableExists("v_ddl") and spark.catalog.dropTempView("v_ddl") and not spark.catalog.dropTempView("v_ddl")
    spark.sql("DROP TABLE IF EXISTS t_ddl")
    spark.sql("CREATE TABLE IF NOT EXISTS t_ddl (a INT, b STRING) USING parquet")
    try:
        spark.sql("INSERT INTO t_ddl VALUES (1, 'x'), (2, 'y')")
        spark.sql("INSERT INTO t_ddl SELECT a + 10, b FROM t_ddl")
        assert spark.table("t_ddl").count() == 4
        spark.sql("ALTER TABLE t_ddl ADD COLUMNS (c DOUBLE)")
        assert spark.table("t_ddl").columns == ["a", "b", "c"]
        spark.sql("TRUNCATE TABLE t_ddl")
        assert spark.table("t_ddl").count() == 0
    finally:
        spark.sql("DROP TABLE t_ddl")
    assert spark.catalog.databaseExists("default") and spark.catalog.currentDatabase() == "default" and spark.catalog.functionExists("upper")
    spark.range(3).createOrReplaceTempView("v_cache")
    spark.catalog.cacheTable("v_cache")
    assert spark.catalog.isCached("v_cache")
    spark.catalog.uncacheTable("v_cache")
    assert not spark.catalog.isCached("v_cache")


def test_config(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true" and spark.conf.get("spark.sql.session.timeZone") == "UTC"


NAMES = """
min max avg mean stddev stddev_samp std stddev_pop variance var_samp var_pop approx_count_distinct percentile_approx approx_percentile first last bool_and every
bool_or any_value bit_and bit_or bit_xor count sum count_distinct sum_distinct kurtosis skewness collect_list collect_set percentile count_if median max_by min_by
regr_count regr_r2 regr_slope regr_intercept regr_avgx regr_avgy regr_sxx regr_syy regr_sxy corr covar_pop covar_samp array_agg grouping grouping_id
row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value
upper lower length char_length character_length bit_length trim ltrim rtrim lpad rpad repeat reverse concat concat_ws replace translate ascii chr char bin hex base64
unbase64 left right md5 sha sha1 sha2 levenshtein url_decode url_encode uuid printf format_string sentences luhn_check substring substr unhex locate instr
regexp_replace regexp_extract split overlay space format_number octet_length btrim encode decode to_number to_char substring_index initcap soundex split_part
startswith endswith contains rlike like ilike position
abs ceil ceiling floor round sqrt cbrt exp pow power ln log2 log10 sin cos tan asin acos atan atan2 sinh cosh tanh asinh acosh atanh degrees radians sign signum hypot
greatest least pi e factorial expm1 log1p bround width_bucket rand log randn pmod mod crc32 conv shiftleft shiftright shiftrightunsigned bit_count bit_get getbit
negative positive rint cot
year month day dayofmonth dayofyear weekofyear quarter hour minute second last_day date_trunc now current_timestamp current_date curdate make_date make_timestamp
trunc date_add date_sub datediff add_months months_between to_date to_timestamp unix_timestamp from_unixtime date_format dayofweek weekday next_day make_ym_interval
dayname monthname extract to_timestamp_ntz to_unix_timestamp
coalesce nullif ifnull nvl isnull nanvl when nvl2 if iff isnotnull
array_contains array_sort array_max array_min array_reverse flatten array_intersect arrays_overlap array_append map_keys map_values map_entries map_concat array size
array_size cardinality array_prepend element_at slice array_position array_remove array_compact array_union array_concat array_join create_map map map_from_arrays
sort_array map_filter map_transform_values sequence array_distinct array_except arrays_zip map_from_entries map_contains_key
transform filter aggregate exists forall reduce zip_with explode explode_outer posexplode posexplode_outer inline inline_outer
to_json json_array_length json_object_keys get_json_object schema_of_json from_json json_tuple
random hash xxhash64 typeof current_user current_schema current_database version monotonically_increasing_id isnan isinf named_struct struct assert_true raise_error
to_csv spark_partition_id input_file_name user
""".split()


@pytest.mark.parametrize("name", NAMES)
def test_every_function_resolves(spark, name):
    assert exists(spark, name) and callable(function(name))


def test_function_aliases(spark):
    row = spark.range(1).select(
        function("IFF")(F.lit(True), F.lit(1), F.lit(2)).alias("a"),
        function("isinf")(F.lit(float("inf"))).alias("b"),
        function("array_reverse")(F.array(F.lit(1), F.lit(2))).alias("c"),
        function("space")(F.lit(2)).alias("d"),
        function("luhn_check")(F.lit("79927398713")).alias("e"),
    ).first()
    assert tuple(row) == (1, True, [2, 1], "  ", True)


def test_scan_pushes_filters_and_prunes_columns(spark, sf):
    text = plan(QUERIES["scan_parquet_pushdown"](spark, sf))
    assert "GreaterThan(o_totalprice,300000.0)" in text and "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in text


def test_top_k_needs_no_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES["sort_top_k"](spark, sf))
    assert "WindowGroupLimit" in plan(QUERIES["top_k_per_group"](spark, sf))


def test_single_scan_rewrites(spark, sf):
    assert plan(QUERIES["tpch_q17"](spark, sf)).count("lineitem.parquet") == 1
    assert plan(QUERIES["tpch_q21"](spark, sf)).count("lineitem.parquet") == 1


def test_streaming_deduplicates_within_watermark(spark, sf):
    stream = streaming.deduplicated(streaming.event_stream(Tables(spark, sf)), "event_id", "1 day").select("event_id")
    assert streaming.available_now(stream).count() == Tables(spark, sf).events.count()


def test_streaming_append_drops_nothing_that_is_in_time(spark, sf):
    counts = streaming.late_tolerant_counts(streaming.event_stream(Tables(spark, sf)), "1 hour", "2 hours", "30 minutes")
    assert streaming.available_now(counts, "complete").count() > 0


def test_set_identities(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int")
    b = spark.createDataFrame([(1,), (3,), (None,)], "v int")
    both = a.exceptAll(b).union(a.intersectAll(b))
    assert sorted(map(str, both.collect())) == sorted(map(str, a.collect()))


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert empty.groupBy("k").agg(F.sum("v")).collect() == []
    assert empty.agg(F.count("*").alias("n"), F.sum("v").alias("s")).first() == (0, None)
    assert top_k(empty, ["k"], [F.col("v")], 2).count() == 0


def test_flagship_has_rows(spark, sf):
    assert flagship(spark, sf).schema.simpleString() == "struct<n_name:string,revenue:double>"
