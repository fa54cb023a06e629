import random
from urllib.parse import quote

import numpy as np

from marlstone.llm import bloom
from marlstone.llm import url_filter as U


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = []
    for action, rule in rules:
        h, slash, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), action == "block", rule, action))
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["example.com", "EXAMPLE.com", "com", "a.example.net", "net", "notexample.com", "b.org", "org", "", "x..com", "com.", "é.com"]
    paths = ["", "/", "/en/", "/en", "/en/7", "/en/77?x", "/de/8", "/de/8#f", "/es/é", "?q=://z/en/", "#://", "/EN/7"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no scheme", "://com/en/x", "http://a\nb.com/en/\n", "http://" + "a." * 3000 + "com/en/" + quote("z") * 9000]
    rules = (*U.RULES, ("block", "b.org"), ("allow", "org/es/"), ("allow", "com/en/7"), ("block", "é.com/"))
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://com/en/"), (3, urls[3])]
    got = U.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *judge(u, rules))) for i, u in rows)
    assert U.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_long_lists_are_split_into_parts(spark):
    rules = [("block" if i % 3 else "allow", f"h{i}.com/") for i in range(60)]
    urls = [f"http://{p}h{i % 90}.com/x{i}" for i, p in enumerate(["", "a.", "b.c."] * 100)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([(r,) for a, r in rules if a == "block"], "key string")
    universe = spark.createDataFrame([(f"h{i}.com/",) for i in range(90)], "key string")
    parts = U.build_parts(listed, universe, 12)
    assert len(parts) > 2 and sum(1 / m for _, m, _ in parts) == 1
    got = U.judged(pages, rules, 12).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *judge(u, rules))) for i, u in enumerate(urls))


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(bloom, "log2_bits", lambda keys, *_: max(10, keys.bit_length() + 1))  # crowded, so levels err
    keys = [f"k{i}" for i in range(6000)]
    frame = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    cascade = U.build_cascade(frame(keys[:1500]), frame(keys + keys[:50]))
    assert len(cascade.levels) > 2
    hashed = frame(keys).select("key", *[U.level_hash("key", n).alias(f"h{n}") for n in range(len(cascade.levels))]).toPandas()
    listed = cascade.listed([hashed[f"h{n}"].to_numpy() for n in range(len(cascade.levels))])
    assert set(hashed["key"][listed]) == set(keys[:1500])


def test_bloom_has_no_false_negatives(spark):
    bits = bloom.build(spark.range(5000).selectExpr("xxhash64(id) AS h"), bloom.log2_bits(5000))
    h = spark.range(20_000).selectExpr("id", "xxhash64(id) AS h").toPandas()
    found = bloom.test(bits, h["h"].to_numpy())
    assert found[h["id"] < 5000].all() and np.mean(found[h["id"] >= 5000]) < 0.01
