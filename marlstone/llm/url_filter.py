"""URL filtering with a cascade of Bloom filters.

A list of keys (rules: a host and a path prefix) is encoded over the complete
universe of keys that the corpus can ask for.  Level 0 holds the listed keys,
level 1 the keys of the universe that level 0 passes wrongly, level 2 the listed
keys that level 1 passes wrongly, and so on until no level errs.  A key of the
universe is then judged exactly by the first level that rejects it, without
any join.  A url asks for one key for each shape (labels of the host, characters
of the path) in the rules; the longest listed key wins.

A filter has 8 MB at most.  Keys are split by a hash into as many parts as it
takes for every level of every part to hold ``PART_KEYS`` keys at most, listed
ones and false positives alike; each part has a cascade of its own, which sees
only its own keys, so long lists and large universes stay exact.  The url table
passes the parts one after another, so a task holds one part at a time.

Rules are written ``host/path``.  A rule fits its host and all subdomains if the
url's path starts with its path.  Of rules of equal length the one with the
longer host wins; a key that is both blocked and allowed is blocked.  A url
without a rule is allowed: the cascade proves that no listed key fits it.

Defined results: a null url or one without ``://`` has an empty host and path
and fits no rule; empty tables give an empty result; repeated rows are judged
alike.  Only page_id and url are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import prepare, staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
MOST_LEVELS = 40
#: Keys in a level of a cascade: 16 bits for each in the largest filter.
PART_KEYS = 1 << 22


def shape(rule: str) -> tuple[int, int]:
    """(labels of the host, characters of the path) of a rule."""
    host, slash, path = rule.partition("/")
    return host.count(".") + 1, len(slash + path)


def host_of(url: str) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def asked_key(labels: int, chars: int) -> Column:
    """The key of one shape that a url asks for, null where it is too short."""
    count = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    fits = (F.col("host") != "") & (count >= labels) & (F.length("path") >= chars)
    return F.when(fits, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)))


def level_hash(key: str | Column, level: int) -> Column:
    """Each level hashes anew, so keys that collide in one part in the next."""
    return F.xxhash64(F.lit(level), key)


@dataclass
class Cascade:
    """Filters of the levels; even ones hold listed keys."""

    levels: list[np.ndarray]

    def listed(self, hashes: Sequence[np.ndarray]) -> np.ndarray:
        """Membership of keys of the universe from their hash at each level."""
        verdict = np.zeros(len(hashes[0]) if hashes else 0, dtype=bool)
        open_ = np.ones(len(verdict), dtype=bool)
        for number, bits in enumerate(self.levels):
            inside = bloom.test(bits, hashes[number])
            verdict[open_ & ~inside] = number % 2 == 1
            open_ &= inside
        verdict[open_] = len(self.levels) % 2 == 1
        return verdict


def _passing(keys: DataFrame, bits: np.ndarray, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["key"]).filter(pa.array(bloom.test(bits, batch.column("h").to_numpy())))

    return keys.select("key", level_hash("key", level).alias("h")).mapInArrow(run, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame, most: int | None = None) -> Cascade | None:
    """The cascade of the keys in ``listed`` over those in ``universe``.

    The universe is read once, against level 0; what passes is made distinct
    and carried from level to level.  None if a level has over ``most`` keys.
    """
    levels: list[np.ndarray] = []
    encode = staged(listed.select("key").filter("key IS NOT NULL").distinct(), "listed")
    others: DataFrame | None = None
    for number in range(MOST_LEVELS):
        keys = encode.count()
        if most is not None and keys > most:
            return None
        bits = bloom.build(encode.select(level_hash("key", number).alias("h")), bloom.log2_bits(keys))
        levels.append(bits)
        if others is None:
            passed = _passing(universe.filter("key IS NOT NULL"), bits, number).distinct().join(encode, "key", "left_anti")
        else:
            passed = _passing(others, bits, number)
        passed = staged(passed, "passed")
        if not passed.limit(1).count():
            return Cascade(levels)
        encode, others = passed, encode
    raise RuntimeError("the cascade did not end")


def part_hash(key: str | Column) -> Column:
    """Splits keys into parts; no level hashes like it."""
    return F.xxhash64(F.lit(-1), key)


def build_parts(listed: DataFrame, universe: DataFrame, most: int = PART_KEYS) -> list[tuple[int, int, Cascade]]:
    """(residue, modulus, cascade) of parts whose levels hold ``most`` keys at most."""
    waiting, parts = [(0, 1)], []
    while waiting:
        residue, modulus = waiting.pop()
        mine = F.pmod(part_hash("key"), F.lit(modulus)) == residue if modulus > 1 else F.lit(True)
        cascade = build_cascade(listed.filter(mine), universe.filter(mine), most)
        if cascade is None:
            waiting += [(residue, 2 * modulus), (residue + modulus, 2 * modulus)]
        else:
            parts.append((residue, modulus, cascade))
    return parts


#: What is known of a page: the rule so far, and its rank (-1 for none).
BEST = "page_id long, host string, path string, rule string, verdict string, best long"


def _judge(shapes: int, action: str, residue: int, modulus: int, cascade: Cascade):
    """A mapInArrow function that takes the rules of one part into account."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("best", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rule, verdict = batch.column("rule"), batch.column("verdict")
            best = batch.column("best").to_numpy().copy()
            for s in range(shapes):
                key = batch.column(f"k{s}")
                asked = pc.is_valid(key).to_numpy(zero_copy_only=False)
                asked &= batch.column(f"p{s}").to_numpy() % modulus == residue
                length = pc.fill_null(pc.utf8_length(key), 0).to_numpy().astype(np.int64)
                # longer rules first, then longer hosts, then blocks
                weight = (length << 20) + pc.fill_null(batch.column(f"n{s}"), 0).to_numpy()
                hashes = [batch.column(f"h{s}_{i}").to_numpy() for i in range(len(cascade.levels))]
                rank = weight * 2 + (action == "block")
                hit = asked & cascade.listed(hashes) & (rank > best)
                best[hit] = rank[hit]
                rule = pc.if_else(pa.array(hit), key, rule)
                verdict = pc.if_else(pa.array(hit), action, verdict)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), rule, verdict, pa.array(best)], schema=schema)

    return run


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most: int = PART_KEYS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    spark = prepare(pages.sparkSession)
    rows = pages.select(
        "page_id", host_of("url").alias("host"), path_of("url").alias("path"), F.lit(None).cast("string").alias("rule"),
        F.lit("allow").alias("verdict"), F.lit(-1).cast("long").alias("best"),
    )
    shapes = sorted({shape(rule) for _, rule in rules})
    keys = [asked_key(*s).alias(f"k{i}") for i, s in enumerate(shapes)]
    hosts = [F.length(F.substring_index("host", ".", -s[0])).cast("long").alias(f"n{i}") for i, s in enumerate(shapes)]
    parts_of = [part_hash(F.col(f"k{i}")).alias(f"p{i}") for i in range(len(shapes))]
    universe = rows.select(*keys).select(F.explode(F.array(*[f"k{i}" for i in range(len(shapes))])).alias("key"))
    first = True
    for action in sorted({a for a, _ in rules}):
        listed = spark.createDataFrame([(rule,) for a, rule in rules if a == action], "key string")
        parts = build_parts(listed, universe, most)
        for residue, modulus, cascade in parts:
            if len(parts) > 1 and not first:
                rows = staged(rows, "judged")
            hashes = [level_hash(F.col(f"k{i}"), n).alias(f"h{i}_{n}") for i in range(len(shapes)) for n in range(len(cascade.levels))]
            asked = rows.select("*", *keys).select("*", *hosts, *parts_of, *hashes)
            rows, first = asked.mapInArrow(_judge(len(shapes), action, residue, modulus, cascade), BEST), False
    return rows.drop("best")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"))


SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), j AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE k = 1
"""
