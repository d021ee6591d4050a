"""Whitening against a full eigendecomposition, fill-in-the-middle against a list of tokens, mixing against a queue in Python."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import infilling, mixing, whitening
from tests.llm.helpers import CLASHES, corpus, frame

# --- whitening -------------------------------------------------------------------------------------------------------------


def vectors(n=300, d=12, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) * 0.2 + rng.standard_normal(d)).tolist()


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    return df.withColumns({c: F.lit(7) for c in (*CLASHES, "v", "n", "whitened", "deviation")})


def by_eigh(rows):
    x = np.floor(1024 * np.array(rows)).astype(np.int64) + 100_000
    c = x - x.mean(axis=0)
    values, v = np.linalg.eigh(c.T @ c / len(x))
    return x, c, values[::-1], v[:, ::-1], [sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(axis=0), strict=True)) for r in x]


@pytest.mark.parametrize("d, block, most_basis", [(12, 16, 1024), (40, 4, 1024), (40, 4, 16), (3, 16, 1024), (1, 16, 1024)])
def test_components_equal_those_of_the_whole_covariance(spark, d, block, most_basis):
    rows = vectors(d=d)
    bad = [(None, None), (-1, [math.nan] * d), (-2, [math.inf] + [0.0] * (d - 1)), (-3, [None] * d)]
    df = table(spark, [*enumerate(rows), *bad, (None, rows[5]), (6, rows[6])])
    model = whitening.fit(df, components=4, block=block, most_basis=most_basis)
    x, c, values, v, deviation = by_eigh([*rows, rows[5], rows[6]])
    k = min(4, d)
    assert model.n == len(x) and list(model.sums) == x.sum(axis=0).tolist()
    assert np.allclose(model.eigenvalues, values[:k], rtol=1e-9) and math.isclose(model.trace, values.sum(), rel_tol=1e-12)
    assert np.allclose(np.abs((model.directions * v[:, :k]).sum(axis=0)), 1, atol=1e-12)
    assert model.identity_error < 1e-10
    found = {r["vec_id"]: r for r in whitening.whiten(df, model).collect() if r["vec_id"] is not None}
    assert len(found) == len(rows) and all(found[i]["deviation"] == deviation[i] for i in found)
    white = np.array([found[i]["whitened"] for i in range(len(rows))])
    expected = c[: len(rows)] @ v[:, :k] / np.sqrt(values[:k])
    assert np.allclose(np.abs(white), np.abs(expected), atol=1e-8)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(table(spark, []), whitening.fit(table(spark, []))).collect() == []
    same = table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    model = whitening.fit(same)
    assert model.n == 2 and not len(model.eigenvalues)
    assert {tuple(r["whitened"]) for r in whitening.whiten(same, model).collect()} == {()}
    line = table(spark, [(i, [i / 4, i / 2, 1.0]) for i in range(20)])
    model = whitening.fit(line)
    assert len(model.eigenvalues) == 1 and model.identity_error < 1e-10
    with pytest.raises(ValueError, match="several lengths"):
        whitening.fit(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_deviations_beyond_the_numbers_of_the_machine(spark):
    moved, gaps, n = np.array([[3, -5], [10**9, 7]]), np.array([1, -2]), 10**6
    assert [int(v) for v in whitening.deviations(moved, n, gaps)] == [sum((n * int(a) - int(g)) ** 2 for a, g in zip(row, gaps, strict=True)) for row in moved]


# --- fill in the middle ------------------------------------------------------------------------------------------------------


def cut_by_list(doc_id, text, rate=50):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(tokens), "plain", None, None, text
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(tokens), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in corpus()]
    pieces = ["a", "<", "P>", "<S", ">", " ", "\n", "é", "　", "\x0b", "日本", "\U0001f600", "<M", "word "]
    rows += [(2000 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 300)))) for i in range(300)]
    return rows + [(3000 + i, t) for i, t in enumerate(["x <P> y", "<M>", "é " * 5000, " " * 1000, "\n", "end \t", "日本 " * 129 + " ", "a b"] * 4)]


@pytest.mark.parametrize("step, rate", [(1, 100), (3, 50), (64, 100)])
def test_cuts_equal_those_of_a_list_of_tokens(spark, step, rate):
    rows = odd_texts()
    df = frame(spark, [(i, t, None, None, None) for i, t in rows]).withColumns({"n": F.lit(1), "form": F.lit("x")})
    outputs = ("n", "form", "prefix_chars", "middle_chars", "output", "restored", "output_sha256", "restored_sha256")
    found = infilling.fill_in_middle(df, outputs, rate=rate, step=step).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(i, *(made := cut_by_list(i, t, rate)), t or "", sha(made[4]), sha(t or "")) for i, t in rows]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_checkpoints_are_sparse_and_long_texts_are_linear(spark):
    data = "wört ".encode() * 300_000
    index = infilling.Checkpoints.of(data)
    assert index.n == 300_001 and len(index.numbers) == 300_000 // infilling.STEP + 1
    assert index.cut(123_457) == (123_457 * 6 - 1, 123_457 * 5 - 1) and index.cut(index.n) == (len(data), 1_500_000)
    assert infilling.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- mixing ------------------------------------------------------------------------------------------------------------------


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by capping one source after another."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, capped = Fraction(sum(sizes.values())), set()
    while True:
        rest = [s for s in order if s not in capped]
        level = (budget - sum(most * sizes[s] for s in capped)) / sum(w[s] for s in rest) if rest else 0
        if not (more := {s for s in rest if w[s] * level > most * sizes[s]}):
            return {s: Fraction(most * sizes[s]) if s in capped else w[s] * level for s in order}
        capped |= more


def check_mix(rows, found):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += words(t)
    target = filled(sizes)
    by_source = Counter()
    documents = {}
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-12)
        by_source[r["source"]] += r["words"]
        taken, size = documents.get((r["row"], r["copy"]), (0, r["size"]))
        documents[r["row"], r["copy"]] = (taken + r["words"], size)
    assert len(documents) == len(rows) and all(0 <= taken <= 3 * size for taken, size in documents.values())
    assert sorted(size for _, size in documents.values()) == sorted(words(t) for _, t, _, _, _ in rows)
    assert all(by_source[s] == int(t) for s, t in target.items())
    # At each time all sources have had the same part of their targets, but for the document in service.
    had, longest = Counter(), Counter()
    for r in found:
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    place = 0
    for r in sorted(found, key=lambda r: (r["finish"], r["place"])):
        if r["words"]:
            assert r["place"] == place
            place += r["words"]
            had[r["source"]] += r["words"]
            assert abs(had[r["source"]] - r["finish"] * target[r["source"]]) < 1.001
    assert place == sum(map(int, target.values()))


def test_mix_gives_each_source_its_target(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), None, rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"]), None) for i in range(400)]
    rows += [(1000, "long " * 3000, None, "small", None), (1001, None, None, "none", None), (1002, "", None, "none", None)]
    rows += [(7, "again and again", None, "hot", None)] * 50 + [(None, "no id", None, "b", None), (None, "no id either", None, "b", None)]
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("size", "rank", "row", "copy", "pass", "finish", "target", "start", "part")}).repartition(7)
    found = mixing.fair_queue(df).collect()
    check_mix(rows, found)
    again = mixing.fair_queue(df.repartition(3)).select("doc_id", "pass", "finish", "place", "words").collect()
    assert sorted(map(str, again)) == sorted(str(type(again[0])(**{c: r[c] for c in ("doc_id", "pass", "finish", "place", "words")})) for r in found)


def test_small_sources_are_served_three_times_at_most(spark):
    rows = [(1, "a b c", None, "s1", None), (2, "d e", None, "s1", None), (3, "x " * 500, None, "s2", None), (4, "y " * 500, None, "s3", None)]
    found = mixing.fair_queue(frame(spark, rows)).collect()
    check_mix(rows, found)
    assert sum(r["words"] for r in found if r["source"] == "s1") == 15 and max(r["pass"] for r in found) == 2


def test_mix_of_corpus_and_of_odd_tables(spark):
    rows = corpus()
    check_mix(rows, mixing.fair_queue(frame(spark, rows)).collect())
    assert mixing.fair_queue(frame(spark, [])).collect() == []
    empty = mixing.fair_queue(frame(spark, [(1, None, None, "a", None), (2, " ", None, None, None)])).collect()
    assert [(r["size"], r["words"], r["target"]) for r in empty] == [(0, 0, 0.0)] * 2


def test_budget_truncates_the_mix_in_its_order(spark):
    rows = [(i, "w " * 10, None, "ab"[i % 2], None) for i in range(100)]
    found = mixing.fair_queue(frame(spark, rows), share=Fraction(1, 4)).collect()
    assert sum(r["words"] for r in found) in range(248, 251)
    assert max(r["place"] + r["words"] for r in found if r["words"]) <= 250


def test_running_totals_over_ranges(spark):
    df = spark.range(0, 5000, 1, 6).select((F.col("id") % 3).cast("int").alias("g"), F.xxhash64("id").alias("k"), (F.col("id") % 11).alias("v"))
    found = mixing.running_totals(df, ("k",), "v", "g").collect()
    seen = Counter()
    for r in sorted(found, key=lambda r: (r["g"], r["k"])):
        assert r["start"] == seen[r["g"]]
        seen[r["g"]] += r["v"]
    plain = mixing.running_totals(df.where("g = 1"), ("k",), "v", name="before", row="row").collect()
    assert len({r["row"] for r in plain}) == len(plain) and max(r["before"] + r["v"] for r in plain) == seen[1]
