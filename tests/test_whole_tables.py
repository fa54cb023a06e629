"""Queries over whole tables against counts made outside of both engines."""

from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marlstone.plans.catalog import QUERIES


def read(sf, name, *columns):
    found = pq.read_table(f"{sf}/{name}.parquet", columns=list(columns))
    return list(zip(*(found.column(c).to_pylist() for c in columns), strict=True))


@pytest.mark.parametrize("name", ["join_null_keys", "join_null_safe"])
def test_null_joins_pair_every_customer(spark, sf, name):
    nulled = lambda k: None if k == 3 else k
    customers, suppliers = read(sf, "customer", "c_custkey", "c_nationkey"), read(sf, "supplier", "s_suppkey", "s_nationkey")
    same = lambda a, b: a == b and (a is not None or name == "join_null_safe")
    want = Counter((c, s) for c, k in customers for s, m in suppliers if same(nulled(k), nulled(m)))
    assert Counter((r.c_custkey, r.s_suppkey) for r in QUERIES[name](spark, sf).collect()) == want
    assert any(c >= 60 for c, _ in want)


def test_cumulative_lead_of_every_supplier(spark):
    # sf0.001 has no supplier beyond the bound of report_cumulative_lead
    sf = "/root/testdata/sf0.01"
    total = defaultdict(lambda: defaultdict(float))
    for k, flag, day, q in read(sf, "lineitem", "l_suppkey", "l_returnflag", "l_shipdate", "l_quantity"):
        if flag in "AR":
            total[k][day.year, day.month, flag] += q
    want = set()
    for k, months in total.items():
        for y, m in {(y, m) for y, m, _ in months}:
            a, r = (sum(q for (y2, m2, f), q in months.items() if f == flag and (y2, m2) <= (y, m)) for flag in "AR")
            if a > r > 0:
                want.add((k, y, m, round(a, 2), round(r, 2)))
    got = {(r.k, r.d.year, r.d.month, r.a, r.b) for r in QUERIES["report_cumulative_lead"](spark, sf).collect()}
    assert got == want
    assert any(k >= 20 for k, *_ in got)


@pytest.mark.parametrize(("name", "key_sign", "id_sign"), [("sort_nulls", 1, -1), ("sort_desc_nulls_first", -1, 1)])
def test_sorts_place_every_row(spark, sf, name, key_sign, id_sign):
    customers = [(c, None if k == 3 else k) for c, k in read(sf, "customer", "c_custkey", "c_nationkey")]
    want = sorted(customers, key=lambda r: (r[1] is not None, key_sign * (r[1] or 0), id_sign * r[0]))
    got = [(r.c_custkey, r.k, r.pos) for r in QUERIES[name](spark, sf).collect()]
    assert got == [(*row, i) for i, row in enumerate(want, 1)]


def test_set_operations_take_every_customer(spark, sf):
    a, b = (Counter(k for (k,) in read(sf, *x)) for x in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    want = {"union_all": a + b, "union": set(a) | set(b), "except": set(a) - set(b), "minus": set(a) - set(b), "except_all": a - b, "intersect": set(a) & set(b), "intersect_all": a & b}
    for name, rows in want.items():
        assert Counter(r.k for r in QUERIES[f"set_{name}"](spark, sf).collect()) == Counter(rows)


def test_offset_leaves_rows_and_cross_join_takes_all_nations(spark, sf):
    want = sorted(k for (k,) in read(sf, "orders", "o_orderkey"))[100:]
    assert want and [r.o_orderkey for r in QUERIES["sort_offset"](spark, sf).collect()] == want
    pairs = {(r, n) for (r,) in read(sf, "region", "r_name") for (n,) in read(sf, "nation", "n_name")}
    assert {tuple(r) for r in QUERIES["join_cross"](spark, sf).select("r_name", "n_name").collect()} == pairs


def test_join_using_spreads_the_pairs_of_one_nation(spark, tmp_path):
    for name, n in (("customer", 10_000), ("supplier", 1_500)):
        of = name[0]
        ids = range(n)
        table = pa.table({f"{of}_{'cust' if of == 'c' else 'supp'}key": pa.array(ids, pa.int64()), f"{of}_name": [f"{name}{i}" for i in ids], f"{of}_nationkey": pa.array([3] * n, pa.int32())})
        pq.write_table(table, tmp_path / f"{name}.parquet")
    found = QUERIES["join_using"](spark, str(tmp_path))
    each = found.groupBy("c_name").count().groupBy("count").agg(F.count(F.lit(1))).collect()
    assert list(map(tuple, each)) == [(1_500, 10_000)]
    # all were one task's work
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 1 and max(tasks) < 10_000_000
