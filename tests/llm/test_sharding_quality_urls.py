import re
import time
import zlib
from collections import Counter

import pytest

from hirelake.llm import quality, sharding, url_filter

from .helpers import corpus, frame


def test_shards_are_even_and_slots_gapless(spark):
    rows = corpus() + [(None, None, "en", "s", None)] * 30
    out = sharding.shard_documents(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((str(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    counts = Counter(r["shard"] for r in out)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(n))
    assert {r["law"] for r in out} == {"rows"}


@pytest.mark.parametrize("n", [0, 1, 23])
def test_few_documents(spark, n):
    df = spark.createDataFrame([(i, "x") for i in range(n)], "doc_id long, text string")
    out = sharding.shard_documents(df).collect()
    assert len(out) == n and len({r["shard"] for r in out}) == n


def test_most_keys_stay_when_a_shard_is_added(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, shards=n).collect()} for n in (24, 25))
    moved = {k for k in a if a[k] != b[k]}
    assert len(moved) / len(a) < 0.08  # a 25th has to move into the new shard
    assert sum(b[k] != 24 for k in moved) / len(a) < 0.03


def walked(rows, shards, points):
    """Shards by a walk of the ring, key by key. rows: (arc, rank within it); rounds of one hop each, as bounds ask for."""
    _, owners = sharding.ring(shards, points)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    out, waiting = {}, sorted(rows)
    for hop in range(len(owners)):
        left = []
        for arc, rank in waiting:
            shard = int(owners[(arc + hop) % len(owners)])
            if room[shard]:
                room[shard] -= 1
                out[arc, rank] = shard
            else:
                left.append((arc, rank))
        waiting = left
    return out


def test_shards_equal_a_walk_of_the_ring(spark):
    from pyspark.sql import functions as F

    df = frame(spark, corpus() * 3)
    spots, _ = sharding.ring(5, 7)
    keyed = df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect()
    by_arc = {}
    for r in sorted(keyed, key=lambda r: (r["key"], r["doc_id"] is not None, r["doc_id"] or 0, r["crc"], r["size"])):
        by_arc.setdefault(sum(s < r["key"] for s in spots.tolist()) % len(spots), []).append(r)
    expected = walked([(arc, k) for arc, found in by_arc.items() for k in range(len(found))], 5, 7)
    expected = Counter((found[k]["doc_id"], found[k]["crc"], expected[arc, k]) for arc, found in by_arc.items() for k in range(len(found)))
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.shard_documents(df, 5, 7).collect()) == expected


def test_rows_alike_and_more_points(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 10)
    monkeypatch.setattr(sharding, "ROWS_PER_ARC", 3)
    df = spark.range(900).selectExpr("CASE WHEN id < 600 THEN 1 ELSE id END AS doc_id", "'x' AS text")
    out = sharding.shard_documents(df, 4, 2).collect()
    assert Counter(r["doc_id"] for r in out)[1] == 600 and len(out) == 900
    assert Counter((r["shard"], r["slot"]) for r in out) == Counter((s, k) for s in range(4) for k in range(225))


def test_bounds_are_kept():
    counts, owners = [5, 0, 9, 1], [0, 1, 0, 1]
    ranges = sharding.cut_arcs(counts, owners, [8, 7])
    assert Counter({s: sum(hi - lo for _, lo, hi, t, _ in ranges if t == s) for s in (0, 1)}) == {0: 8, 1: 7}
    assert sum(hi - lo for _, lo, hi, _, _ in ranges) == 15


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated = len({k + j for k, w in enumerate(windows) if w in often for j in range(8)})
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * repeated > 30 * len(words)
    n, lines = len(words), text.split("\n")
    letters = sum(any(c.isalpha() for c in w) for w in words)
    bad = not 2 * n <= sum(map(len, words)) <= 20 * n or sum(text.count(c) for c in "#*$%&|<>") > n / 10 or letters < n / 2 or dup > len(lines) / 2
    bad = bad or sum(x.lstrip().startswith(("-", "*", "•")) for x in lines) > 0.9 * len(lines) or sum(x.rstrip().endswith(("...", "…")) for x in lines) > len(lines) / 2
    kept = not failed and not bad
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeated, failed, kept


def test_quality_equals_brute_force(spark):
    rows = corpus() + [(2000, "| a * b # c $ d % e & f < g > " * 20, "en", "s", 1), (2001, "\n".join(f"- item {k} of a list" for k in range(30)), "en", "s", 1), (2002, "no break space " * 30, "en", "s", 1)]
    out = quality.judge_quality(frame(spark, rows)).drop("n_rules").collect()
    assert sorted(map(tuple, out), key=str) == sorted(((r[0], *plain_quality(r[1])) for r in rows), key=str)


def test_cascade_order_does_not_change_verdicts(spark):
    rows = corpus(4)
    df = frame(spark, rows)
    a, b = (sorted(map(tuple, quality.judge_quality(df, rules).drop("n_rules").collect()), key=str) for rules in (quality.RULES, quality.RULES[::-1]))
    assert a == b


def test_rules_are_ordered_by_rejections_for_their_cost():
    slow = ("slow", lambda f: time.sleep(0.002) or True)
    rare = ("rare", lambda f: False)
    often = ("often", lambda f: True)
    # Only texts that pass the base count: the rule that rejects those that fail has nothing to reject.
    early = ("early", lambda f: f.n_words < 20)
    half = ("half", lambda f: "w0" in f.words)
    passing = [" ".join(f"w{k}" for k in range(j, 40)) for j in range(2)]
    order = [n for n, _ in quality.order_rules(passing * 20 + ["a b"] * 5000, [slow, rare, early, half, often])]
    assert order[0] == "often" and order.index("half") < order.index("early")


def test_shared_parts_are_paid_by_the_rule_that_runs_first():
    """Two rules ask for a slow part, of which one rejects more: the other is nearly free behind it, and comes second, before
    one that costs less than the part does."""
    import time
    from functools import cached_property

    class Slow(quality.Facts):
        @cached_property
        def lines(self):
            time.sleep(0.002)
            return self.text.split("\n")

    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(40)]
    number = lambda f: int(f.text.split("x")[0][1:])

    def cheap(f):
        time.sleep(0.0005)
        return number(f) % 10 == 9

    rules = [("half", lambda f: len(f.lines) > 0 and number(f) % 2 == 0), ("few", lambda f: len(f.lines) > 0 and number(f) % 10 == 1), ("cheap", cheap)]
    before, quality.Facts = quality.Facts, Slow
    try:
        order = [n for n, _ in quality.order_rules(texts, rules)]
        alone = [n for n, _ in quality.order_rules(texts, rules[1:])]
    finally:
        quality.Facts = before
    assert order == ["half", "few", "cheap"] and alone == ["cheap", "few"]


def test_quality_no_rows(spark):
    assert quality.judge_quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []


CASES = [
    ("http://Example.COM/en/7", "example.com", "/en/7", "example.com/en/7", "allow"),
    ("http://a.example.com/en/70?x", "a.example.com", "/en/70", "example.com/en/7", "allow"),
    ("http://example.com/en/6", "example.com", "/en/6", "com/en/", "block"),
    ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    ("http://com/en", "com", "/en", None, "allow"),
    ("https://x.example.net/de/8#y", "x.example.net", "/de/8", "example.net/de/8", "block"),
    ("https://x.net/de/", "x.net", "/de/", "net/de/", "allow"),
    ("ftp://b.org/es/1/2", "b.org", "/es/1/2", "org/es/", "block"),
    ("http://h?://x/en/", "h", "", None, "allow"),
    ("http://", "", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://.com/en/", ".com", "/en/", "com/en/", "block"),
    ("http://a.com:80/en/", "a.com:80", "/en/", None, "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)] + [(None, None), (0, CASES[0][0])], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule")
    out = url_filter.judge_urls(df).collect()
    assert len(out) == len(CASES) + 2
    found = {r["page_id"]: tuple(r)[1:] for r in out}
    for k, (_, *expected) in enumerate(CASES):
        assert found[k] == tuple(expected), CASES[k]
    assert url_filter.judge_urls(df.limit(0)).collect() == []


def test_trie_equals_scan_of_rules():
    import random

    rng = random.Random(1)
    host = lambda n: ".".join(rng.choice("ab") for _ in range(n))
    path = lambda n: "/" + "".join(rng.choice("ab/") for _ in range(n))
    rules = list({(h, p): url_filter.Rule(rng.choice(["allow", "block"]), h, p) for _ in range(60) for h, p in [(host(rng.randint(1, 3)), path(rng.randint(0, 4)))]}.values())
    trie = url_filter.Trie(rules)
    for _ in range(500):
        h, p = host(rng.randint(1, 4)), path(rng.randint(0, 6))
        fits = [r for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host)), default=None)
        assert trie.find(h, p) == best


def test_joined_rules_give_the_same(spark, monkeypatch):
    import random

    rng = random.Random(2)
    host = lambda n: ".".join(rng.choice(["a", "b", "Cc"]) for _ in range(n))
    path = lambda n: "".join(rng.choice("ab/7") for _ in range(n))
    rules = [url_filter.Rule(rng.choice(["allow", "block"]), host(rng.randint(1, 4)), rng.choice(["", "/" + path(rng.randint(0, 5))])) for _ in range(1000)] + [url_filter.Rule("block", "", "/")]
    urls = [f"http://{host(rng.randint(1, 5))}/{path(rng.randint(0, 8))}{rng.choice(['', '?q', '#f'])}" for _ in range(1500)] + [c[0] for c in CASES]
    df = spark.createDataFrame([(k % 1400, u) for k, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule_host")
    few = sorted(map(tuple, url_filter.judge_urls(df, rules).collect()), key=str)
    as_table = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert sorted(map(tuple, url_filter.judge_urls(df, as_table).collect()), key=str) == few
    monkeypatch.setattr(url_filter, "MAX_BROADCAST", 2)
    for many in (rules, as_table):
        assert sorted(map(tuple, url_filter.judge_urls(df, many).collect()), key=str) == few
    assert {r[4] for r in few} == {"allow", "block"} and len({r[3] for r in few}) > 100


def test_a_host_with_many_paths():
    rules = [url_filter.Rule("block", "a.org", f"/p{k:06d}") for k in range(50_000)]
    trie = url_filter.Trie(rules)
    began = time.perf_counter()
    assert all(trie.find("x.a.org", f"/p{k:06d}/x").path == f"/p{k:06d}" for k in range(0, 50_000, 25))
    assert time.perf_counter() - began < 2  # a scan of all would take minutes
