import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import suffix_dedup

from .helpers import corpus, frame, removed_bytes


def judged(df, **options):
    out = suffix_dedup.dedup_suffixes(df, **options).withColumn("sha", F.sha2("kept", 256))
    return sorted(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", "sha").collect()), key=str)


def keyed(df):
    return list(map(tuple, df.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))).collect()))


def test_equals_brute_force_on_odd_cases(spark):
    df = frame(spark, corpus())
    assert judged(df) == removed_bytes(keyed(df))


def test_small_blocks_and_window_by_window(spark):
    df = frame(spark, corpus(2), clashes=False)
    expected = removed_bytes(keyed(df), 40)
    assert judged(df, length=40, gram=16, block_bytes=4096) == expected
    assert judged(df, length=40, gram=16, block_bytes=4096, most=0) == expected


def test_periodic_texts(spark):
    rng = random.Random(5)
    texts = ["ab" * n for n in (49, 50, 51, 80)] + ["".join(rng.choice("ab") for _ in range(600)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert judged(df, length=20, gram=8, block_bytes=500) == removed_bytes(keyed(df), 20)


def test_no_rows(spark):
    assert judged(spark.createDataFrame([], "doc_id long, text string")) == []


def test_suffix_ranks_order_suffixes():
    data = np.random.default_rng(1).integers(97, 99, 400).astype(np.uint8)
    ranks = suffix_dedup.suffix_ranks(data, 20)[-1][1]
    suffixes = [data[i : i + 20].tobytes() for i in range(len(data) - 19)]
    assert [sorted(set(suffixes)).index(s) for s in suffixes] == np.unique(ranks[: len(suffixes)], return_inverse=True)[1].tolist()


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("letters", [1, 2, 4, 26])
def test_longest_previous_factors_equal_brute_force(letters):
    rng = random.Random(letters)
    for length in (16, 20, 37):
        data = bytes(rng.randrange(letters) + 97 for _ in range(500))
        data += data[100:160] + b"z" + data[100:140]
        starts = np.array(rng.sample(range(len(data) - length + 1), 300))
        places = np.random.default_rng(length).permutation(300)
        found = suffix_dedup.longest_previous_factors(np.frombuffer(data, np.uint8), starts, places, length)
        texts = [data[s : s + length] for s in starts]
        expected = [max((common(texts[i], texts[j]) for j in range(300) if places[j] < places[i]), default=0) for i in range(300)]
        assert found.tolist() == expected


def test_smaller_places_on_one_side():
    rng = np.random.default_rng(4)
    for places in (np.arange(50), np.arange(50)[::-1], np.append(np.arange(1, 50), 0), rng.permutation(50)):
        shared = np.append(0, rng.integers(0, 9, 49))
        found = suffix_dedup.to_smaller(places, shared)
        for k in range(50):
            j = next((j for j in range(k - 1, -1, -1) if places[j] < places[k]), None)
            assert found[k] == (0 if j is None else min(shared[j + 1 : k + 1]))


def test_segments_are_found_whatever_the_chunks():
    data = np.frombuffer(random.Random(3).randbytes(5000), np.uint8)
    starts = np.array([0, 50, 1500, 1500, 5000])
    whole = suffix_dedup.segments(data, starts)
    cut = suffix_dedup.segments(data, starts, chunk=256)
    windows = lambda s: {(w, int(a)) for a, low, high in zip(s["anchor"], s["low"], s["high"], strict=True) for w in range(low, high + 1)}
    assert windows(whole) == windows(cut)
    assert sorted(w for w, _ in windows(whole)) == [*range(50, 1401), *range(1500, 4901)]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def shared_passage(n=300, seed=7):
    """Documents that have a passage in common, each between words of its own."""
    rng = random.Random(seed)
    own = lambda: "".join(rng.choice("abcdefgh ") for _ in range(60))
    passage = "".join(rng.choice("ijklmnop ") for _ in range(50))
    return [(k, own() + passage + own()) for k in range(n)]


def test_block_sends_each_window_of_split_segments_once():
    block = suffix_dedup.Block([suffix_dedup.pack([(True, k, 0, t.encode()) for k, t in shared_passage()])])
    records, first = block.records(40, 16)
    flags = np.where(first, suffix_dedup.SPLIT, suffix_dedup.REPEAT)
    single, first = suffix_dedup.split_windows(block, records, flags, 40)
    assert suffix_dedup.to_sort(block, records, flags, 5, 40) == []
    window = lambda r: block.texts[r["doc"]][r["low"] : r["low"] + 40]
    sent = [window(r) for r in single[first]]
    assert len(sent) == len(set(sent)) > 1000 and set(sent) == {window(r) for r in single}
    assert all((r["doc"], r["low"]) == min((o["doc"], o["low"]) for o in single if window(o) == window(r)) for r in single[first][::97])


@pytest.mark.parametrize("fold", [1, 7, 1 << 20])
def test_running_minima_equal_those_of_all(monkeypatch, fold):
    monkeypatch.setattr(suffix_dedup, "FOLD", fold)
    rng = np.random.default_rng(fold)
    records = np.zeros(600, suffix_dedup.RECORD)
    for name, most in (("anchor", 4), ("segment", 5), ("doc_id", 40), ("digest", 2), ("doc", 3)):
        records[name] = rng.integers(0, most, 600)
    records["low"] = np.arange(600)
    records["anchor"][:300] = records["segment"][:300] = 9  # half of all rows are of one kind
    rng.shuffle(records)
    earliest, kinds, answered = suffix_dedup.Earliest(), suffix_dedup.Kinds(), []
    for block, part in enumerate(np.split(records, 60)):
        answered += zip(*(x.tolist() for x in earliest.add(block, part)), strict=True)
        kinds.add(part)
        assert fold > 600 or len(earliest.records) + earliest.size <= 2 * 21 + 10 + fold
    answered += zip(*(x.tolist() for x in earliest.fold()), strict=True)
    least = {}
    for r in records.tolist():
        least[r[:2]] = min(least.get(r[:2], r), r, key=lambda x: (x[2], x[3], x[4], x[5]))
    assert sorted(earliest.records.tolist()) == sorted(least.values())
    assert sorted(r for _, r in answered) == sorted(set(records.tolist()) - set(least.values()))
    assert all(records[10 * block : 10 * block + 10].tolist().count(r) == 1 for block, r in answered)
    assert dict(kinds.counts().tolist()) == {a: sum(k[0] == a for k in least) for a in {k[0] for k in least}}


def test_segments_of_one_anchor_are_dealt_out():
    block = suffix_dedup.Block([suffix_dedup.pack([(True, k, 0, t.encode()) for k, t in shared_passage()])])
    records, first = block.records(40, 16)
    records = records[first]
    anchors, n = np.unique(records["anchor"], return_counts=True)
    hot = records[records["anchor"] == anchors[n.argmax()]]
    assert n.max() > 100 and np.bincount(suffix_dedup.bucket_of(hot, 8), minlength=8).max() < len(hot) / 4


def test_hot_anchor_equals_brute_force(spark):
    df = spark.createDataFrame(shared_passage(), "doc_id long, text string")
    expected = removed_bytes(keyed(df), 40)
    for most in (20_000, 20):
        assert judged(df, length=40, gram=16, block_bytes=4096, most=most) == expected
