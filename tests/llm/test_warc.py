import base64
import hashlib

import pytest

from marlstone.llm import warc

FAKE = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"


def expected(rows):
    last = {}
    for page, _, html in rows:
        if page is not None:
            last[html or ""] = max(page, last.get(html or "", page))
    out = []
    for page, _, html in rows:
        raw, top = (html or "").encode(), last.get(html or "")
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "response" if page == top else "revisit", None if page == top else top))
    return sorted(map(str, out))


def written(spark, rows, parts=3):
    path = warc.new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts), path)
    return path


@pytest.fixture()
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_magic_in_payloads_over_many_ranges(spark, small_ranges):
    kinds = ["<p>x</p>", FAKE * 3, "pre" + warc.MAGIC + "post" + FAKE, None, "", "é" * 500, warc.MAGIC, warc.MAGIC * 5 + "\r\n\r\n" + warc.MAGIC]
    rows = [(i, f"http://a/{i}", kinds[i % 8] and kinds[i % 8] * (1 + i % 3)) for i in range(80)]
    rows += [(None, None, "nul"), (7, "u\r\nWARC-Record-ID: <urn:page:5>", "dup"), (7, "u", "dup"), (1000, None, "x" * 20000 + warc.MAGIC + FAKE)]
    got = warc.described(warc.read_archives(spark, written(spark, rows))).collect()
    assert sorted(map(str, map(tuple, got))) == expected(rows)


def test_other_byte_ranges_in_the_second_scan(spark, small_ranges, monkeypatch):
    """Fewer live cores between two scans make other splits of the same files."""
    kinds = ["<p>x</p>" * 40, FAKE * 3, "pre" + warc.MAGIC + "post" + FAKE]
    rows = [(i, f"http://a/{i}", kinds[i % 3] * (1 + i % 4)) for i in range(60)]
    path = written(spark, rows)
    monkeypatch.setattr(warc, "staged", lambda df, name: _staged_under(spark, df, name))
    got = warc.described(warc.read_archives(spark, path)).collect()
    assert sorted(map(str, map(tuple, got))) == expected(rows)


def _staged_under(spark, df, name):
    from marlstone.llm.common import staged

    out = staged(df, name)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2000 + len(name) * 531))
    return out


def test_equal_payloads_and_empty_table(spark):
    rows = [(i, "u", "same" if i % 3 else None) for i in range(30)]
    got = warc.described(warc.read_archives(spark, written(spark, rows))).collect()
    assert sorted(map(str, map(tuple, got))) == expected(rows)
    assert warc.read_archives(spark, written(spark, [])).count() == 0


def test_damaged_chain_ends(spark, tmp_path):
    good = "".join(warc.MAGIC + f"WARC-Type: response\r\nContent-Length: 9\r\n\r\nHTTP\r\n\r\n{i}\r\n\r\n" for i in range(6))
    (tmp_path / "a.warc").write_text(good.replace("Content-Length: 9", "Content-Length: 7", 4).replace("Content-Length: 7", "Content-Length: 9", 3), newline="")
    offsets = [r.offset for r in warc.read_archives(spark, f"file://{tmp_path}/a.warc").collect()]
    assert len(offsets) == 4 and 0 in offsets
