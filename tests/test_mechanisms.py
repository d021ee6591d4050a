"""Ranks, tables that change in place, keyed settlement, and the trigram index, each against the plain way."""

import datetime as dt
import random
import re
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from hirelake.operators import bitmaps, mutations, ranks, search, trigrams
from hirelake.plans import payments, reports, rollup
from hirelake.sources import bucketed, generator, storage, tables, upserts
from hirelake.streaming import settlement

# --- stored results ----------------------------------------------------------------------------------------------------------


def test_checkpoints_in_threads_leave_the_setting_as_it_was(spark):
    def rows(k):
        return storage.checkpointed(spark.range(10 * k).repartition(3).groupBy((F.col("id") % 7).alias("x")).count()).count()

    for before in ("false", "true"):
        spark.conf.set(storage.CLEAN_UP, before)
        with ThreadPoolExecutor(6) as pool:
            assert list(pool.map(rows, range(24))) == [min(7, 10 * k) for k in range(24)]
        assert spark.conf.get(storage.CLEAN_UP) == before and not storage._WRITING
    spark.conf.unset(storage.CLEAN_UP)
    with pytest.raises(Exception, match="divided by zero"):
        storage.checkpointed(spark.range(3).select(F.expr("raise_error('divided by zero')")))
    assert spark.conf.get(storage.CLEAN_UP, "false") == "false"


# --- ranks -----------------------------------------------------------------------------------------------------------------


def test_ranks_of_all_rows(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, *range(9)])) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, x long").repartition(7)
    for names in (["x", "id"], ["-x", "id"], ["-id"]):
        ranked = [r["id"] for r in sorted(ranks.numbered(df, search.sort_keys(names)).collect(), key=lambda r: r["rank"])]
        assert ranked == [r["id"] for r in df.orderBy(*search.sort_keys(names)).collect()]
        assert sorted(r["rank"] for r in ranks.numbered(df, search.sort_keys(names)).collect()) == list(range(1000))
    assert ranks.numbered(df.limit(0), [F.col("id")]).collect() == []
    pages = ranks.paged(df, ["id"], 300, None)
    assert sorted((r["page"], r["count"]) for r in pages.groupBy("page").count().collect()) == [(1, 300), (2, 300), (3, 300), (4, 100)]
    assert sorted(map(tuple, ranks.envelopes(pages).collect())) == [(1, 1000, 2, None), (2, 1000, 3, 1), (3, 1000, 4, 2), (4, 1000, None, 3)]
    assert ranks.paged(df, ["id"], 300).where("page = 10").count() == 100
    plan = pages._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_new_keys_follow_the_order_of_names(spark):
    known = spark.createDataFrame([(5, "b")], "id long, name string")
    names = spark.createDataFrame([(f"n{k}",) for k in range(500)] + [(" b ",), ("",), (None,), ("n7",)], "name string")
    grown = mutations.got_or_created(known, names.repartition(9))
    expected = {"b": 5} | {n: 6 + k for k, n in enumerate(sorted(f"n{k}" for k in range(500)))}
    for _ in range(2):
        assert {r["name"]: r["id"] for r in grown.repartition(3).collect()} == expected


# --- tables that change in place -------------------------------------------------------------------------------------------


def files(path):
    return {str(p) for p in path.rglob("*.parquet")}


def test_upserts_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    path = tmp_path / "t"
    old = spark.createDataFrame([(k, f"v{k}", None if k % 3 else k) for k in range(1000)], "id long, v string, n int")
    upserts.create(old, str(path))
    before = files(path)
    changes = spark.createDataFrame([(17, "new", None)], "id long, v string, n int")
    version = upserts.upserted(spark, str(path), changes)
    assert len(files(path) - before) == 1 and len(set(version.folders.values())) == 2
    assert version.number == 1 and sorted(map(tuple, upserts.read(spark, str(path)).collect()), key=str) == sorted(map(tuple, mutations.merged(old, changes).collect()), key=str)
    # Unknown keys only become rows if asked for.
    more = spark.createDataFrame([(18, "again"), (5000, "added")], "id long, v string")
    assert upserts.upserted(spark, str(path), more).read(spark).count() == 1000
    grown = upserts.upserted(spark, str(path), more, insert=True).read(spark)
    assert grown.count() == 1001 and grown.where("id = 5000").first()["n"] is None and grown.where("id = 18").first()["v"] == "again"
    left = upserts.deleted(spark, str(path), spark.range(500)).read(spark)
    assert left.count() == 501 and left.agg(F.min("id")).first()[0] == 500
    assert upserts.deleted(spark, str(path), spark.range(6000)).read(spark).count() == 0
    assert upserts.read(spark, str(path)).columns == ["id", "v", "n"]


def test_a_write_that_ends_early_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    upserts.create(spark.range(100).withColumn("v", F.lit("old")), path, buckets=4)
    changes = spark.range(100).withColumn("v", F.lit("new"))

    def crash():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        upserts.upserted(spark, path, changes, before_commit=crash)
    assert upserts.latest(spark, path).number == 0 and upserts.read(spark, path).where("v = 'new'").isEmpty()
    # Of two writers of one version the second is refused.
    with pytest.raises(upserts.Conflict):
        upserts.upserted(spark, path, changes, before_commit=lambda: upserts.upserted(spark, path, changes.where("id = 1")))
    assert [r["id"] for r in upserts.read(spark, path).where("v = 'new'").collect()] == [1]
    assert upserts.upserted(spark, path, changes).number == 2 and upserts.read(spark, path).where("v = 'new'").count() == 100


def test_empty_and_missing_tables(spark, tmp_path):
    with pytest.raises(LookupError):
        upserts.read(spark, str(tmp_path / "none"))
    path = str(tmp_path / "t")
    upserts.create(spark.range(0), path)
    assert upserts.read(spark, path).collect() == []
    assert upserts.upserted(spark, path, spark.range(3), insert=True).read(spark).count() == 3


# --- settlement ------------------------------------------------------------------------------------------------------------


def receipts_of(spark, rows):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, r, Decimal(a) if a is not None else None, paid, "PENDING", 10 * i, i, at) for i, r, a, paid in rows], "id long, transaction_id string, amount decimal(12,0), is_paid boolean, status string, related_job_id long, service_pack_id long, created_date timestamp")


def notifications(n=120, seed=4):
    rng = random.Random(seed)
    at = dt.datetime(2024, 1, 1, 1)
    return [(rng.choice(["r1", "r2", "r3", "r4", "twice", "none", None]), k, at + dt.timedelta(minutes=k // 3), str(rng.choice([100, 100, 100, 200])) if k % 10 else "x", rng.choice(["00", "24"]), rng.random() < 0.9) for k in range(n)]


SENT = "reference string, number long, at timestamp, amount string, code string, valid boolean"
RECEIPTS = [(1, "r1", 1, False), (2, "r2", 1, False), (3, "r3", 2, True), (4, "r4", None, False), (5, "twice", 1, False), (6, "twice", 1, False), (7, None, 1, False)]


@pytest.mark.parametrize("cuts", [[], [40], [1, 2, 60, 119]])
def test_any_split_into_batches_gives_the_same_answers(spark, tmp_path, cuts):
    rows, receipts = notifications(), receipts_of(spark, RECEIPTS)
    folder = str(tmp_path)
    for low, high in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[low:high], SENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SENT).parquet(f"{folder}/in")
        settlement.settle(settlement.answers(stream, receipts), f"{folder}/out", f"{folder}/checkpoint").awaitTermination(120)
    found = {r["number"]: r["reply"] for r in spark.read.schema(settlement.ANSWER).parquet(f"{folder}/out").collect()}
    expected = payments.replies(spark.createDataFrame(rows, SENT), receipts, None, F.col("number"))
    assert found == {r["number"]: r["reply"] for r in expected.collect()} and len(found) == len(rows)


def test_receipts_that_nobody_pays_are_closed(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    receipts = receipts_of(spark, [(1, "r1", 1, False), (2, "r2", 1, False)])
    batches = [[("r1", 1, at(1), "100", "00", True)], [("late", 2, at(9), "1", "00", True)], [("later", 3, at(10), "1", "00", True)], [("r2", 4, at(11), "100", "00", True), ("r1", 5, at(11), "100", "00", True)]]
    folder = str(tmp_path)
    for rows in batches:
        spark.createDataFrame(rows, SENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SENT).parquet(f"{folder}/in")
        settlement.settle(settlement.answers(stream, receipts, lifetime_s=3 * 3600), f"{folder}/out", f"{folder}/checkpoint").awaitTermination(120)
    found = spark.read.schema(settlement.ANSWER).parquet(f"{folder}/out").collect()
    assert {r["number"]: r["reply"] for r in found if r["number"]} == {1: "00", 2: "01", 3: "01", 4: "99", 5: "02"}
    assert [(r["reference"], r["status"], r["job_id"]) for r in found if r["number"] is None] == [("r2", "CANCELLED", 20)]


def test_receipts_arrive_while_the_stream_runs(spark, tmp_path):
    folder = str(tmp_path)
    first, new = receipts_of(spark, [(1, "r1", 1, False)]), receipts_of(spark, [(2, "r2", 1, False)])
    new.write.parquet(f"{folder}/receipts")
    rows = [("r1", 1, dt.datetime(2024, 1, 1, 1), "100", "24", True), ("r2", 2, dt.datetime(2024, 1, 1, 1), "100", "00", True), ("r2", 3, dt.datetime(2024, 1, 1, 2), "100", "00", True)]
    spark.createDataFrame(rows, SENT).write.parquet(f"{folder}/in")
    answered = settlement.answers(spark.readStream.schema(SENT).parquet(f"{folder}/in"), first, spark.readStream.schema(new.schema).parquet(f"{folder}/receipts"))
    settlement.settle(answered, f"{folder}/out", f"{folder}/checkpoint").awaitTermination(120)
    found = {r["number"]: (r["reply"], r["status"]) for r in spark.read.schema(settlement.ANSWER).parquet(f"{folder}/out").collect()}
    assert found == {1: ("00", "FAILED"), 2: ("00", "SUCCESS"), 3: ("02", "SUCCESS")}


def test_fixed_receipts_touch_the_state_only_when_they_change():
    cell = SimpleNamespace(value=None, calls=0, get=lambda: cell.value)

    def update(v):
        cell.value, cell.calls = v, cell.calls + 1

    cell.update = update
    made = settlement.Settlement(None, False, fixed=True)
    made.init(SimpleNamespace(getValueState=lambda name, schema: cell))
    row = lambda number, code, sent=100, start=dict(zip(settlement._FIELDS, (1, 1, 100, "PENDING", 2, None), strict=True)): {"reference": "r", "number": number, "at": None, "code": code, "sent": sent, "receipt": None, "start": start}
    replies = lambda *rows: sorted((r["number"], r["reply"]) for r in made.handleInputRows(("r",), iter(rows), None))
    assert replies(row(1, "00", 7)) == [(1, "04")] and replies(row(1, "00", start=None)) == [(1, "01")] and cell.calls == 0
    assert replies(row(2, "24"), row(3, "00"), row(4, "00")) == [(2, "00"), (3, "00"), (4, "02")] and cell.value[3] == "SUCCESS"
    assert replies(row(5, "00")) == [(5, "02")] and cell.calls == 2


def test_state_of_one_reference_without_a_stream():
    """The processor's own rules, with a state in memory."""
    cell = SimpleNamespace(value=None, exists=lambda: cell.value is not None, get=lambda: cell.value, update=lambda v: setattr(cell, "value", v))
    timers = []
    handle = SimpleNamespace(getValueState=lambda name, schema: cell, registerTimer=timers.append)
    made = settlement.Settlement(1000)
    made.init(handle)
    made.handleInitialState(("r",), {"n": 1, "id": 1, "minor": 100, "status": "PENDING", "job_id": 2, "pack_id": None, "created_ms": 5}, None)
    row = lambda number, code, sent=100: {"reference": "r", "number": number, "at": None, "code": code, "sent": sent, "receipt": None}
    assert timers == [1005]
    assert sorted((r["number"], r["reply"]) for r in made.handleInputRows(("r",), iter([row(3, "00"), row(1, "24"), row(2, "00"), row(4, "00", 7)]), None)) == [(1, "00"), (2, "00"), (3, "02"), (4, "04")]
    assert list(made.handleExpiredTimer(("r",), None, None)) == []


# --- trigrams --------------------------------------------------------------------------------------------------------------


ODD = ["Đà Nẵng", "da nang", "STRASSE", "Straße", "ﬁsh oﬃce", "fish office", "café noir", "Café Noir", "Ⅷ rooms", "viii rooms", "ab​cd efgh", "a-b-c", "", None, "日本語テキスト", "ĲSSELMEER", "ijsselmeer", "𝐁𝐨𝐥𝐝 text", "ﾊﾝﾄﾞ", "x\x00yz abc", "１２３ numbers"]


@pytest.mark.parametrize("collation", [search.ANY_CASE_AND_ACCENT, None])
def test_lookup_finds_what_contains_finds(spark, tmp_path, collation):
    rng = random.Random(8)
    words = ["Kỹ sư", "Engineer", "data", "Đội", "lạp trình", "senior", "Straße", "office", "ﬁn", "re", "mote", "x1y2", "Ünï", "-", "ab́c"]
    texts = ODD + ["".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, title string").withColumn("company_name", F.when(F.col("id") % 7 == 0, F.concat(F.lit("Công ty "), F.col("id").cast("string"))))
    pieces = [t for t in texts if t]
    needles = [n.swapcase() if rng.random() < 0.5 else n for t in (rng.choice(pieces) for _ in range(1000)) for at in [rng.randrange(len(t))] for n in [t[at : at + rng.randint(3, 14)]]]
    needles += ["da nang", "strasse", "fish", "cafe noir", "viii", "abcd", "công ty 7", "zzzqqq", "ss", "", None]
    asked = spark.createDataFrame(list(enumerate(needles)), "needle_id long, needle string")
    index = trigrams.build(df, str(tmp_path), ["title", "company_name"], collation=collation, buckets=8)
    found = {tuple(r) for r in trigrams.lookup(index, asked).collect()}
    both = [F.col("title"), F.col("company_name")]
    expected = asked.join(df.hint("broadcast"), F.coalesce(search.any_contains(both, F.col("needle"), collation), F.lit(False))).select("needle_id", "id")
    assert found == {tuple(r) for r in expected.collect()} and len(found) > 1000
    assert trigrams.lookup(trigrams.build(df.limit(0), str(tmp_path), ["title"], buckets=2), asked).collect() == []


def test_needles_that_no_index_answers_are_compared_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "SHORT_AT_ONCE", 4)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["ab", "ABBA", "ﬁsh", "xyz", None, "ba"])], "id long, title string")
    index = trigrams.build(df, str(tmp_path), ["title"], buckets=2)
    needles = ["a", "b", "AB", "ba", "x", "z", "-", "fis", "abba", "", None]
    asked = spark.createDataFrame([(k % 10, n) for k, n in enumerate(needles)] * 2, "needle_id long, needle string")
    expected = asked.join(df.hint("broadcast"), F.coalesce(search.any_contains([F.col("title")], F.col("needle"), index.collation), F.lit(False))).select("needle_id", "id").distinct()
    found = trigrams.lookup(index, asked).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected.collect())) and len(found) > 12


def test_texts_with_ligatures_are_filed_and_postings_are_packed(spark, tmp_path):
    """Only what stands for no letters of the alphabet alone is compared with every needle."""
    df = spark.createDataFrame([(k, f"Straße {k % 10} oﬃce") for k in range(400)] + [(400, "Ⅷ rooms")], "id long, title string").coalesce(2)
    index = trigrams.build(df, str(tmp_path), ["title"], buckets=2)
    postings = index.postings(spark)
    assert [k for r in postings.where("gram = ''").collect() for k in r["keys"]] == [400]
    assert sum(len(r["keys"]) for r in postings.where("gram = 'ass'").collect()) == 400 and postings.where("gram = 'ass'").count() <= 4
    needles = ["STRASSE", "straße", "office", "ffi", "as", "tra", "ße 7", "s", "ss"]
    asked = spark.createDataFrame(list(enumerate(needles)), "needle_id long, needle string")
    expected = asked.join(df.hint("broadcast"), search.any_contains([F.col("title")], F.col("needle"), index.collation)).select("needle_id", "id")
    assert sorted(map(tuple, trigrams.lookup(index, asked).collect())) == sorted(map(tuple, expected.collect()))


def test_lookup_reads_few_files(spark, tmp_path):
    df = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("title"))
    index = trigrams.build(df, str(tmp_path), ["title"], buckets=32)
    needle = df.where("id = 777").select(F.lit(1).alias("needle_id"), F.substring("title", 5, 20).alias("needle"))
    found = trigrams.lookup(index, needle)
    assert [tuple(r) for r in found.collect()] == [(1, 777)]
    # Of 32 folders of texts and of postings, those of one key and of three trigrams are read.
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = re.findall(r"PartitionFilters: \[[^\]]*bucket[^\]]*\]", plan)
    assert pruned and index.texts(spark).where(F.col("bucket").isin([0])).count() < 20_000 // 16


# --- a database in even parts, draws, rollups, bitmaps ---------------------------------------------------------------------


def test_a_skewed_table_is_read_in_even_parts(spark):
    database = {"url": "jdbc:derby:memory:skewed;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    keys = [k for k in range(800)] + [1_000_000 + 1000 * k for k in range(150)] + [1 << 40, (1 << 40) + 1, None]
    rows = spark.createDataFrame([(k, i, 1000 * (i % 7)) for i, k in enumerate(keys)], "KEY_ID long, N int, SALARY_MIN long")
    rows.write.format("jdbc").options(dbtable="SKEWED", **database).mode("overwrite").save()
    found = tables.jdbc(spark, database["url"], "SKEWED", key="KEY_ID", parts=8, driver=database["driver"])
    assert sorted(r["N"] for r in found.collect()) == list(range(len(keys)))
    sizes = [r["n"] for r in found.where("KEY_ID IS NOT NULL").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 * len(keys) / 8 and 8 <= len(sizes) <= 17
    plan = found.where("SALARY_MIN >= 3000")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(SALARY_MIN,3000)" in plan
    rows.limit(0).write.format("jdbc").options(dbtable="NOTHING", **database).mode("overwrite").save()
    assert tables.jdbc(spark, database["url"], "NOTHING", key="KEY_ID", driver=database["driver"]).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_draws_without_replacement_are_permutations(spark, n):
    df = spark.range(40).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("x", generator.drawn(7, "x", F.col("k"), n))
    rows = df.collect()
    orders = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["k"])):
        orders.setdefault(r["id"], []).append(r["x"])
    assert all(sorted(o) == list(range(n)) for o in orders.values())
    if n >= 16:
        assert len(set(map(tuple, orders.values()))) == 40


def test_draws_are_uniform_and_weights_hold(spark):
    n = 40_000
    df = spark.range(n).select(generator.drawn(3, "x", F.lit(2), 10).alias("x"), generator.weighted(3, "w", ("a", "b", "c"), (20, 70, 10)).alias("w"))
    seen = {r["x"]: r["count"] for r in df.groupBy("x").count().collect()}
    # Within five standard deviations.
    assert set(seen) == set(range(10)) and all(abs(c - n / 10) < 5 * (n * 0.09) ** 0.5 for c in seen.values())
    drawn = {r["w"]: r["count"] for r in df.groupBy("w").count().collect()}
    assert all(abs(drawn[v] - n * w) < 5 * (n * w * (1 - w)) ** 0.5 for v, w in (("a", 0.2), ("b", 0.7), ("c", 0.1)))


def test_reports_from_a_rollup_equal_those_from_all_rows(spark, tmp_path):
    made = generator.generate(spark, 9, 6, 30, 40)
    moved = made["application"].withColumn("created_date", F.col("created_date") + F.make_dt_interval(F.pmod(F.xxhash64("id"), F.lit(1500)).cast("int") - 700))
    path, jobs = str(tmp_path / "r"), made["job"]

    def check(rows, year, category=None):
        found = rollup.reports(rollup.stored(spark, path), jobs, year, category)
        for period in ("year", "quarter", "month"):
            expected = reports.employer_report(rows, jobs, period, year, category)
            assert sorted(map(tuple, found.where(F.col("period") == period).drop("period").collect())) == sorted(map(tuple, expected.collect()))

    old, new = moved.where("id % 3 > 0"), moved.where("id % 3 = 0")
    rollup.store_day(path, dt.date(2024, 5, 1), old, jobs)
    check(old, 2024)
    for _ in range(2):  # a day that is written again counts once
        rollup.store_day(path, dt.date(2024, 5, 2), new, jobs)
    check(moved, 2024)
    check(moved, 2023, 2)
    rollup.compacted(spark, path, str(tmp_path / "c"))
    assert rollup.stored(spark, str(tmp_path / "c")).agg(F.sum("applications")).first()[0] == moved.count()


def test_bitmaps_let_all_known_keys_through(spark):
    large = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("name"), "id")
    keys = spark.createDataFrame([(f"k{7 * k}",) for k in range(300)] + [("none",), (None,)], "name string")
    maps = bitmaps.united(bitmaps.bitmaps(keys.where("length(name) < 4"), "name"), bitmaps.bitmaps(keys, "name"))
    passed = bitmaps.maybe_among(large, "name", maps)
    found = [r["id"] for r in passed.collect()]
    assert set(range(0, 2100, 7)) <= set(found) and len(found) < 330
    assert passed.columns == large.columns
    assert bitmaps.maybe_among(large, "name", bitmaps.bitmaps(keys.limit(0), "name")).collect() == []
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_tables_in_equal_buckets_join_without_a_shuffle(spark, tmp_path):
    applications = spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(700)).alias("job_id"))
    jobs = spark.range(700).select("id", (F.col("id") % 9).alias("posted_by_id"), F.concat(F.lit("job "), "id").alias("title"))
    left, right = bucketed.bucketed(applications, "job_id", 8, str(tmp_path)), bucketed.bucketed(jobs, "id", 8, str(tmp_path))
    joined = bucketed.applications_with_jobs(left, right)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "Exchange" in bucketed.applications_with_jobs(applications, jobs)._jdf.queryExecution().executedPlan().toString()
    expected = bucketed.applications_with_jobs(applications, jobs)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, expected.collect())) and joined.count() == 5000
    assert bucketed.applications_with_jobs(bucketed.bucketed(applications.limit(0), "job_id", 8, str(tmp_path)), right).collect() == []
