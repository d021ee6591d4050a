"""Line dedup and decontamination, which run without Python on the main path."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from hirelake.llm import decontam, line_dedup

from .helpers import corpus, deduped_lines, frame


def keyed(df):
    return list(map(tuple, df.select("doc_id", "text", F.xxhash64("doc_id", "text")).collect()))


def test_lines_equal_brute_force(spark):
    df = frame(spark, corpus())
    out = line_dedup.dedup_lines(df)
    assert set(out.columns) == set(df.columns)
    assert sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str) == deduped_lines(keyed(df))


def test_near_lines(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    words = base.split()
    near = [base, " ".join(words[1:]), " ".join([*words, "more"]), base.replace("eight", "8"), base.replace("one ", "1 ", 1)]
    far = [" ".join(words[2:]), base.replace("two", "2").replace("nine", "9"), "four words and no", "four words and yes"]
    df = spark.createDataFrame(list(enumerate(near + far)), "doc_id long, text string")
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(df).collect()}
    expected = {r[0]: r[3] for r in deduped_lines(keyed(df))}
    assert out == expected
    assert [out[k] for k in range(5)] == [0, 1, 1, 1, 1]


def test_many_variants_of_one_line(spark):
    words = [f"w{k}" for k in range(20)]
    rows = [(k, " ".join([*words[:7], f"number{k}", *words[7:]])) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.dedup_lines(df).where("n_removed = 0").select("doc_id").collect() == [(0,)]


def test_near_lines_of_all_lengths(spark):
    texts = [" ".join(f"w{n}_{k}" for k in range(n) if k != left) for n in range(5, 13) for left in (n, 0, n // 2, n - 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (line_dedup.MIN_WORDS, 9):
        out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(df, least).collect()}
        assert out == {k: int(k % 4 > 0 and len(t.split()) >= least) for k, t in enumerate(texts)}


def test_no_lines(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_line_plan_has_no_python(spark):
    df = frame(spark, corpus(), clashes=False)
    for out in (line_dedup.dedup_lines(df), decontam.contamination(df, df.select(F.col("doc_id").alias("item_id"), "text").limit(3))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def words_of(text):
    return [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def contaminated(docs, items, size=13):
    windows = {}
    for item_id, text in items:
        words = words_of(text)
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(item_id)
    sizes, out = {len(w) for w in windows}, []
    for doc_id, text in docs:
        words, hit, names = words_of(text), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (found := windows.get(tuple(words[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= {str(x) for x in found if x is not None}
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    rows = corpus()
    texts = {r[0]: r[1] for r in rows}
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    items = [(1, texts[0]), (2, cut(texts[1], 0, 20)), (10, cut(texts[2], 2, 8)), (3, "Absent from all of them"), (4, None), (5, ""), (None, texts[7]), (6, cut(texts[0], 0, 14)), (2, cut(texts[1], 0, 20)), (7, "!ta, RE-" + cut(texts[7], 0, 14).upper())]
    items += [(8, "ta"), (9, "ab " * 15)]
    df = frame(spark, rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    out = decontam.contamination(df, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = contaminated([(r[0], r[1]) for r in rows], items)
    assert sorted(map(tuple, out.collect()), key=str) == expected
    kept = decontam.keep_clean(df, benchmark)
    assert kept.columns == df.columns
    assert kept.count() == sum(not r[5] for r in expected)


def test_proximity_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    words = item.split()
    # The rarest words of the item are alpha and mu, of which the last two texts have one only.
    texts = [item, " ".join(reversed(words)), "nothing of the kind is here", item.replace("alpha", "other"), item.replace(" mu ", " other ")]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select(F.struct("k").alias("key"), decontam.split_words(F.col("text")).alias("words"))
    out, lengths = decontam.find_phrases(rows, spark.createDataFrame([(1, item)], "item_id long, text string"), near=0.8)
    found = {(r["key"]["k"], r["exact"]) for r in out.collect()}
    assert found == {(0, True), (0, False), (1, False), (3, False), (4, False)}
    assert {r["key"]["k"]: r["n_words"] for r in lengths.collect()} == {k: len(t.split()) for k, t in enumerate(texts)}


def test_terms_beyond_a_broadcast_take_further_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BROADCAST", 40)
    rows = corpus()[:12]
    items = [(k, rows[k][1]) for k in range(3)]
    df = frame(spark, rows, clashes=False)
    out = decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, out.collect()), key=str) == contaminated([(r[0], r[1]) for r in rows], items)


def test_empty_sides(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.contamination(docs, items).collect() == []
    assert decontam.contamination(some, items).select("n_words", "n_hit", "contaminated").collect() == [(2, 0, False)]


def test_documents_of_many_lines_are_linear(spark):
    """Half of 200,000 lines repeat an earlier one."""
    text = "\n".join(f"line {k % 100_000}" for k in range(200_000))
    began = time.perf_counter()
    row = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_lines"], row["n_removed"]) == (200_000, 100_000) and row["text"] == "\n".join(f"line {k}" for k in range(100_000))
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("places", [[], [0], [2], [0, 1, 2], [1], [0, 2]])
def test_arrays_without_places(spark, places):
    df = spark.createDataFrame([(list("abc"), places)], "x array<string>, at array<int>")
    assert df.select(line_dedup.without(F.col("x"), F.col("at"))).first()[0] == [c for k, c in enumerate("abc") if k not in places]


def test_items_of_very_many_words(spark):
    """No row holds an item's words, so what is stored grows with them and not with their square."""
    words = [f"w{k * k % 9973}" for k in range(100_000)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words[500:530]) + " y"), (2, " ".join(words)), (3, "a short item"), (4, "none")], "doc_id long, text string")
    out = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(docs, items).collect()}
    assert out == {1: (32, 30, ["1"]), 2: (100_000, 100_000, ["1"]), 3: (3, 2, ["2"]), 4: (1, 0, [])}


def test_many_terms_are_met_by_a_shuffle(spark, monkeypatch):
    rows = corpus()
    df = frame(spark, rows)
    items = df.select(F.col("doc_id").alias("item_id"), F.substring("text", 20, 400).alias("text")).where("item_id % 5 = 0")
    columns = ("doc_id", "n_words", "n_hit", "items_sha256", "n_near", "near_items")
    plain = decontam.contamination(df, items, near=0.8).select(*columns).collect()
    monkeypatch.setattr(decontam, "MAX_BROADCAST", 5)
    assert sorted(map(str, decontam.contamination(df, items, near=0.8).select(*columns).collect())) == sorted(map(str, plain))
    assert any(r["n_near"] > r["n_hit"] for r in plain) and all(r["n_near"] >= r["n_hit"] for r in plain)


def test_index_of_terms_with_others(spark, monkeypatch):
    documents = spark.createDataFrame([(1, "a x b".split()), (2, "a x x x b a".split()), (3, "b b".split()), (4, ["a"])], "key long, words array<string>")
    terms = spark.createDataFrame([("a", ["b"]), ("b", ["b"])], "word string, others array<string>")
    for most, passes in ((decontam.MAX_BROADCAST, 3), (1, 9), (1, 3)):  # one pass, four, and a shuffle
        monkeypatch.setattr(decontam, "MAX_BROADCAST", most)
        monkeypatch.setattr(decontam, "MOST_PASSES", passes)
        rows = decontam.index(documents, terms, 3).collect()
        lengths = {r["key"]: r["at"] for r in rows if r["word"] == decontam.LENGTH}
        assert lengths == {1: 3, 2: 6, 3: 2, 4: 1}
        # The first a of document 2 has no b within two words.
        assert sorted((r["word"], r["key"], r["at"], r["met"]) for r in rows if r["word"] != decontam.LENGTH) == [("a", 1, 0, ["b"]), ("a", 2, 5, ["b"]), ("b", 1, 2, ["b"]), ("b", 2, 4, ["b"]), ("b", 3, 0, ["b"]), ("b", 3, 1, ["b"])]
