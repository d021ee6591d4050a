import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hirelake.operators import deletes, integrity, mutations, relations, search
from hirelake.plans import compare, payments, profiles, reports
from hirelake.sources import generator, schema, tables

NOW = dt.datetime(2024, 1, 20)
today = lambda: F.lit("2024-01-20").cast("date")


@pytest.fixture(scope="module")
def data(spark):
    out = generator.generate(spark, 3)
    return out | {"bookmark_job": spark.createDataFrame([(1, 12, 1, True, NOW, NOW), (2, 12, 2, True, NOW, NOW), (3, 13, 1, True, NOW, NOW)], "id long, user_id long, job_id long, active boolean, created_date timestamp, updated_date timestamp")}


def jobs_of(spark, rows):
    """Jobs with some columns given and the others null."""
    names = list(rows[0])
    return tables.inserted(spark.createDataFrame([], schema.schema("job")), spark.createDataFrame([tuple(r.values()) for r in rows], schema="struct<" + ",".join(f"{n}:{schema.schema('job')[n].dataType.simpleString()}" for n in names) + ">"))


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_public_jobs_need_a_deadline(spark):
    day = lambda n: dt.date(2024, 1, n)
    jobs = jobs_of(spark, [{"id": 1, "active": True, "deadline": day(20)}, {"id": 2, "active": True, "deadline": None}, {"id": 3, "active": False, "deadline": day(25)}, {"id": 4, "active": True, "deadline": day(19)}])
    assert ids(search.public(jobs, today())) == [1]
    applications = spark.createDataFrame([(k, 1, k) for k in (1, 2, 3, 4)], "id long, candidate_id long, job_id long")
    assert ids(integrity.closed_applications(applications, jobs, today())) == [3, 4]


def test_text_search_ignores_case_and_accents(spark):
    df = spark.createDataFrame([(1, "Đà Nẵng", "Beta"), (2, "HA NOI", "đội"), (3, None, None)], "id long, title string, company_name string")
    both = [F.col("title"), F.col("company_name")]
    assert ids(df.where(search.matches_terms(both, "da nang"))) == [1]
    assert ids(df.where(search.matches_terms(both, "nẴng, beta"))) == [1]
    assert ids(df.where(search.matches_terms(both, "hà doi"))) == [2]
    assert ids(df.where(search.matches_terms(both, "  "))) == [1, 2, 3]
    assert ids(df.where(search.contains(F.col("title"), "NOI", None))) == [2]


def test_filters(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    jobs = jobs_of(spark, [{"id": k, "active": True, "deadline": dt.date(2024, 2, 1), "location_id": 1, "salary_min": lo, "salary_max": hi, "created_date": t, "employment_type": "REMOTE", "title": "x"} for k, lo, hi, t in [(1, 10, 20, at(1, 0)), (2, 30, None, at(2, 0)), (3, None, 20, at(2, 5)), (4, 30, 40, at(3, 0))]])
    places = spark.createDataFrame([(1, "Hà Nội")], "id long, name string")
    found = lambda **f: ids(search.search_jobs(jobs, places, search.FilterSpec(**f), today())[0])
    assert found() == [1, 2, 3, 4] == found(location="ha noi", search="", employment_type="REMOTE")
    assert found(min_salary=20) == [2, 4] and found(max_salary=20) == [1, 3]
    assert found(created_before="2024-01-02") == [1, 2] and found(created_after="2024-01-02") == [2, 3, 4]
    assert found(location="da nang") == []
    with pytest.raises(ValueError):
        search.FilterSpec(employment_type="NEVER")


def test_forms(spark):
    spec = search.FilterSpec.from_form({"salary": {"min": 10, "max": 20}, "job_types": ["full", "part"], "experience": "5_10", "last_update": "week"}, today())
    assert (spec.min_salary, spec.max_salary, spec.employment_type, spec.experience_level) == (10_000_000, 20_000_000, "FULL_TIME", "SENIOR")
    assert spark.range(1).select(spec.created_after.cast("string")).first()[0] == "2024-01-13"


def test_orders_and_pages(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9), (4, 5)], "id long, salary_min long")
    by = lambda text: [r["id"] for r in df.orderBy(*search.ordering(text, default="id")).collect()]
    assert by("salary_min") == [2, 1, 4, 3] and by("-salary_min") == [3, 1, 4, 2] and by("id_of_owner") == [1, 2, 3, 4]
    found = search.page(df, search.ordering("salary_min"), 2, 3)
    assert ids(found.rows) == [3] and found.envelope() == {"count": 4, "next": None, "previous": 1}
    assert search.page(df, [F.col("id")], 1, 1000).size == 100 and search.page(df, [F.col("id")], 1, 1000, None).size == 1000
    for names in (["salary_min", "id"], ["-salary_min", "id"], ["-salary_min", "-id"]):
        pages, last = [], None
        while rows := search.next_page(df, names, last, 3).collect():
            pages, last = pages + [r["id"] for r in rows], rows[-1]
        assert pages == [r["id"] for r in df.orderBy(*search.sort_keys(names)).collect()]
    with pytest.raises(LookupError):
        search.page(df, [F.col("id")], 3, 2).envelope()
    assert search.page(df.limit(0), [F.col("id")]).envelope() == {"count": 0, "next": None, "previous": None}
    with pytest.raises(ValueError):
        search.page(df, [F.col("id")], 0)


def test_plans_push_filters_and_take_the_top(spark, tmp_path):
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "id long, created_date timestamp_ntz").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    from hirelake.functions.dates import in_year

    plan = df.where(in_year(F.col("created_date"), 2024))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(created_date" in plan and "LessThan(" in plan.partition("PushedFilters")[2]
    assert "TakeOrderedAndProject" in search.page(df, [F.col("id")], 2).rows._jdf.queryExecution().toString()


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, t string")
    assert tables.single(df, "t", "b").first()["id"] == 3
    for wrong in ("a", "z"):
        with pytest.raises(LookupError):
            tables.single(df, "t", wrong)
    assert tables.none_of(df).count() == 0 and tables.first_row(df, "id").first()["id"] == 1
    assert tables.as_json(df.limit(1)).first()["value"] == '{"id":1,"t":"a"}'


def test_cards(spark, data):
    found = profiles.cards(data, data["job"], 12).collect()
    assert len(found) == 50
    card = next(r for r in found if r["id"] == 1)
    assert card["bookmark_id"] == 1 and card["saved"] and len(card["tags"]) == 2 and card["category"]["name"] in generator.CATEGORIES
    assert not next(r for r in found if r["id"] == 3)["saved"]
    shown = profiles.shown_cards(profiles.cards(data, data["job"], 12), F.lit(NOW)).where("id = 1").first()
    assert shown["salary"].endswith("M") and len(shown["tags"]) == 4
    assert profiles.shown_details(profiles.details(data, data["job"], 12), F.lit(NOW)).count() == 50


def test_profiles_do_not_multiply(spark, data):
    empty = {t: spark.createDataFrame([], schema.schema(t)) for t in ("education", "language", "appreciation")}
    work = spark.createDataFrame([(k, 11, f"t{k}", dt.date(2020 + k, 1, 1)) for k in range(3)], "id long, candidate_id long, job_title string, start_date date")
    skills = spark.createDataFrame([(1, "Python"), (2, "SQL")], "id long, name string")
    bridge = spark.createDataFrame([(11, 1), (11, 2), (11, 2)], "candidate_id long, skill_id long")
    made = data | empty | {"work_experience": tables.inserted(spark.createDataFrame([], schema.schema("work_experience")), work), "skill": skills, "candidate_skills": bridge}
    out = profiles.shown_profiles(profiles.candidate_profiles(made))
    row = out.where("user_id = 11").first()
    assert out.count() == 20 and row["skills"] == ["Python", "SQL"] and [w["title"] for w in row["work"]] == ["t2", "t1", "t0"] and row["work"][0]["end"] == "Present"
    assert out.where("user_id = 12").first()["skills"] == []


def test_relations(spark, data):
    listed = relations.applications_of_employer(data["application"], data["job"], data["candidate_profile"], data["user"])
    assert listed.count() == data["application"].count()
    assert relations.employers_with_users(data["employer_profile"], data["user"]).where("verifier IS NULL").count() == 10
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(1,), (1,), (None,)], "p long")
    assert relations.existing(a, "k", b, "p").count() == 1 and relations.missing(a, "k", b, "p").count() == 2
    assert {r["k"]: r["has"] for r in relations.flagged(a, "k", b, "p", "has").collect()} == {1: True, 2: False, None: False}


def test_reports(spark, data):
    year = reports.employer_report(data["application"], data["job"], "year", 2024)
    assert year.select("bucket").distinct().count() == 5
    assert year.agg(F.sum("applications")).first()[0] == data["application"].count()
    month = reports.employer_report(data["application"], data["job"], "month", 2024, category_id=1)
    assert {r["label"] for r in month.collect()} == {f"T{m}" for m in range(1, 13)}
    assert spark.range(1).select(reports.efficiency(F.lit(1), F.lit(8)).alias("x"), reports.efficiency(F.lit(0), F.lit(8)).alias("y"), reports.efficiency(F.lit(1), F.lit(0)).alias("z")).first()[:] == (12.5, 0.0, 0.0)
    with pytest.raises(ValueError):
        reports.employer_report(data["application"], data["job"], "week", 2024)
    assert reports.totals(data["job"], data["candidate_profile"], data["employer_profile"], data["application"]).first()["synthetic_revenue"] == 25_000_000
    assert reports.recent(data["job"], data["employer_profile"]).count() == 5


def test_compare(spark, data):
    one = data["job"].where("category_id = 1").select("id").limit(2).collect()
    out = compare.compared(data["job"], data["job_category"], data["location"], f"{one[0][0]}, {one[1][0]},x")
    assert out.count() == 2 and out.first()["same_category"] is True and out.first()["description"] == "---"
    assert compare.compared(data["job"], data["job_category"], data["location"], "0").count() == 0


def test_rules(spark):
    jobs = jobs_of(spark, [{"id": 1, "salary_min": 2, "salary_max": 1}, {"id": 2, "salary_min": None, "salary_max": 1}, {"id": 3, "salary_min": 1, "salary_max": 1}])
    assert ids(integrity.breaking(jobs, integrity.salary_ordered())) == [1]
    ratings = spark.createDataFrame([(1, None), (2, 0), (3, 5), (4, 6)], "id long, rating int")
    assert ids(integrity.breaking(ratings, integrity.rating_in_range())) == [2, 4]
    levels = spark.createDataFrame([(1, 11, 1), (2, 10, 0)], "id long, oral_level int, written_level int")
    assert ids(integrity.breaking(levels, integrity.levels_in_range())) == [1]
    taxes = spark.createDataFrame([("1",), ("1",), (None,), (None,)], "tax_code string")
    assert integrity.repeated(taxes, ("tax_code",)).collect() == [("1", 2)]
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id long, email string")
    assert ids(integrity.taken_emails(spark.createDataFrame([(1, "a"), (2, "a"), (3, "c")], "id long, email string"), users)) == [2]
    assert spark.range(1).select(integrity.resume_accepted(F.lit("a.PDF"), F.lit(5 << 20)), integrity.resume_accepted(F.lit("a.txt"), F.lit(1)), integrity.resume_accepted(F.lit("a.pdf"), F.lit((5 << 20) + 1))).first()[:] == (True, False, False)


def test_forms_are_checked(spark):
    forms = spark.createDataFrame([(" ", "a", "d", "r", "b", "12", "5", None), ("t", "a", "d", "r", "b", "x", "-1", dt.date(2024, 1, 19)), ("t", "a", "d", "r", "b", "", "", dt.date(2024, 1, 20))], "title string, address string, description string, requirements string, benefits string, salary_min string, salary_max string, deadline date")
    found = [r[0] for r in forms.select(integrity.form_errors(today())).collect()]
    assert found == [[integrity.BLANK["title"], integrity.NOT_ORDERED, integrity.NO_DATE], [integrity.NOT_A_NUMBER["salary_min"], integrity.NEGATIVE["salary_max"], integrity.PAST], []]


def test_deletes(spark, data):
    owner = data["job"].where("id = 1").select("posted_by_id")
    out = deletes.deleted(data, "employer_profile", owner)
    left = {r[0] for r in out["job"].select("id").collect()}
    assert 1 not in left and {r[0] for r in out["application"].select("job_id").collect()} <= left
    assert out["bookmark_job"].where("job_id = 1").count() == 0
    with pytest.raises(deletes.Refused):
        deletes.deleted(data, "job_category", data["job_category"].select("id"))
    with pytest.raises(deletes.Refused):
        deletes.deleted(data, "user", spark.createDataFrame([(1,)], "id long"))
    receipts = spark.createDataFrame([(1, 7, 1), (2, 8, None)], "id long, service_pack_id long, related_job_id long")
    packs = spark.createDataFrame([(7,), (8,)], "id long")
    out = deletes.deleted({"service_pack": packs, "receipt": receipts}, "service_pack", packs.where("id = 7"))
    assert sorted(map(tuple, out["receipt"].select("id", "service_pack_id").collect())) == [(1, None), (2, 8)]


def test_changes(spark, data):
    jobs = data["job"]
    assert mutations.soft_deleted(jobs, jobs.where("id = 1").first()["posted_by_id"], 1).where("NOT active").count() == 1
    assert mutations.soft_deleted(jobs, -1, 1).where("NOT active").count() == 0
    reviewed = mutations.application_reviewed(data["application"], spark.createDataFrame([(110, "APPROVED", 5)], "id long, status string, rating int"))
    assert reviewed.where("id = 110").first()["rating"] == 5 and reviewed.count() == data["application"].count()
    applications = mutations.overlaid(data["application"], F.col("id") == 110, status=F.lit("SUBMITTED"))
    changed = mutations.application_changed(applications, 11, 110, cover_letter=F.lit("x"))
    assert changed.where("cover_letter = 'x'").count() == 1
    assert mutations.application_changed(reviewed, 11, 110, cover_letter=F.lit("x")).where("cover_letter = 'x'").count() == 0
    assert mutations.application_withdrawn(applications, 11, 110).count() == applications.count() - 1
    skills = spark.createDataFrame([(1, "a")], "id long, name string")
    grown = mutations.got_or_created(skills, spark.createDataFrame([(" a",), ("b",), ("b ",), ("",), (None,)], "name string"))
    assert sorted(r["name"] for r in grown.collect()) == ["a", "b"] and grown.select("id").distinct().count() == 2
    bridge = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "p long, c long")
    assert sorted(map(tuple, mutations.links_replaced(bridge, "p", "c", spark.createDataFrame([(1, 9), (2, None)], "p long, c long")).collect())) == [(1, 9)]
    marks = data["bookmark_job"]
    assert mutations.bookmark_removed(marks, 12).count() == 1 and mutations.bookmark_removed(marks, 12, 2).count() == 2
    assert mutations.bookmarked(marks, spark.createDataFrame([(12, 1), (12, 5), (12, 5)], "user_id long, job_id long"), jobs).count() == 4
    made = mutations.jobs_created(jobs, spark.createDataFrame([(900, 1), (901, 9)], "id long, posted_by_id long"), data["employer_profile"], F.lit(NOW))
    assert made.where("id >= 900").select("id", "company_name").collect() == [(900, "Công ty 1")]
    judged = mutations.employers_judged(data["employer_profile"], spark.createDataFrame([(9,)], "k long"), False, 1, F.lit(NOW), "no")
    assert judged.where("user_id = 9").select("status", "reject_reason").first()[:] == ("REJECTED", "no")
    users, owners = mutations.registered(data["user"], data["employer_profile"], spark.createDataFrame([(50, "new@x"), (51, "user1@example.org")], "id long, email string"), spark.createDataFrame([(50,), (51,)], "user_id long"), "EMPLOYER")
    assert users.count() == 31 and owners.count() == 11
    assert mutations.resume_cleared(data["candidate_profile"].withColumn("resume", F.lit("r")), 11).where("resume IS NULL").count() == 1


RECEIPTS = [(1, "r1", Decimal(100), False, 5, 7), (2, "r2", Decimal(100), True, 5, 7), (3, "r3", Decimal(100), False, 6, None), (4, "r4", Decimal(100), False, None, 7), (5, "twice", Decimal(1), False, None, None), (6, "twice", Decimal(1), False, None, None)]


@pytest.mark.parametrize("valid", [True, False])
@pytest.mark.parametrize("reference,amount,code,expected", [("r1", "10000", "00", "00"), ("r1", "10000", "24", "00"), ("r1", "9999", "00", "04"), ("r1", "x", "00", "99"), ("r2", "10000", "00", "02"), ("r2", "1", "00", "04"), ("none", "10000", "00", "01"), (None, "1", "00", "01"), ("twice", "100", "00", "99"), ("r3", "10000", "00", "00"), ("r4", "10000", None, "00")])
def test_notifications(spark, valid, reference, amount, code, expected):
    receipts = spark.createDataFrame(RECEIPTS, "id long, transaction_id string, amount decimal(12,0), is_paid boolean, related_job_id long, service_pack_id long").withColumn("status", F.lit("PENDING"))
    sent = spark.createDataFrame([(reference, amount, code, valid)], "reference string, amount string, code string, valid boolean")
    replied = payments.replies(sent, receipts, None)
    assert replied.first()["reply"] == (expected if valid else "97")
    if reference in ("r1", "r3"):
        after = payments.receipts_settled(receipts, replied).where(F.col("transaction_id") == reference).first()
        accepted = valid and expected == "00"
        assert (after["status"], after["is_paid"]) == (("SUCCESS", True) if accepted and code == "00" else ("FAILED", False) if accepted else ("PENDING", False))
        jobs = spark.createDataFrame([(5, False), (6, False)], "id long, is_featured boolean")
        assert [r["id"] for r in payments.jobs_featured(jobs, replied).where("is_featured").collect()] == ([5] if accepted and code == "00" and reference == "r1" else [])
    assert payments.receipts_returned(receipts, sent).where("status <> 'PENDING'").count() == 0


def test_signed_notifications_and_new_receipts(spark):
    import hashlib
    import hmac
    import urllib.parse

    receipts = spark.createDataFrame(RECEIPTS, "id long, transaction_id string, amount decimal(12,0), is_paid boolean, related_job_id long, service_pack_id long")
    fields = {"reference": "r1", "amount": "10000", "code": "00"}
    good = fields | {"secure_hash": hmac.new(b"k", urllib.parse.urlencode(sorted(fields.items())).encode(), hashlib.sha512).hexdigest()}
    sent = spark.createDataFrame([(good,), (good | {"amount": "1"},), (fields,)], "parameters map<string,string>")
    assert sorted(r["reply"] for r in payments.replies(sent, receipts, "k").collect()) == ["00", "97", "97"]
    packs = spark.createDataFrame([(7, Decimal(500))], "id long, price decimal(12,0)")
    wanted = spark.createDataFrame([(10, 1, 7, 5, "VNPAY"), (11, 1, 8, 5, "CASH"), (12, 1, 7, None, "CASH")], "id long, user_id long, pack_id long, job_id long, method string")
    out = payments.receipts_created(spark.createDataFrame([], schema.schema("receipt")), wanted, packs, "PAY", F.lit(dt.datetime(1970, 1, 1, 0, 0, 9, tzinfo=dt.UTC)))
    assert sorted((r["id"], r["amount"], r["status"], r["transaction_id"]) for r in out.collect()) == [(10, 500, "PENDING", "PAY_10_9"), (12, 500, "PENDING", None)]


def test_later_notifications_of_a_batch_find_the_receipt_paid(spark):
    receipts = spark.createDataFrame(RECEIPTS, "id long, transaction_id string, amount decimal(12,0), is_paid boolean, related_job_id long, service_pack_id long")
    rows = [(1, "r1", "10000", "24", True), (2, "r1", "10000", "00", False), (3, "r1", "1", "00", True), (4, "r1", "10000", "00", True), (5, "r1", "10000", "00", True), (6, "r1", "10000", "24", True), (7, "r3", "10000", "00", True)]
    sent = spark.createDataFrame(rows, "k long, reference string, amount string, code string, valid boolean")
    found = {r["k"]: r["reply"] for r in payments.replies(sent, receipts, None, F.col("k")).collect()}
    assert found == {1: "00", 2: "97", 3: "04", 4: "00", 5: "02", 6: "02", 7: "00"}


def test_stream_of_forged_failed_and_repeated_notifications(spark, tmp_path):
    import hashlib
    import hmac
    import urllib.parse

    from hirelake.streaming.payments import settle

    def signed(code, amount="10000", key=b"k", reference="r1"):
        fields = {"reference": reference, "amount": amount, "code": code}
        return fields | {"secure_hash": hmac.new(key, urllib.parse.urlencode(sorted(fields.items())).encode(), hashlib.sha512).hexdigest()}

    hour = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(signed("00", key=b"forged"), hour(0)), (signed("24"), hour(1)), (signed("24"), hour(2)), (signed("00"), hour(3)), (signed("00"), hour(4)), (signed("00", reference="none"), hour(5))]
    spark.createDataFrame(rows, "parameters map<string,string>, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("parameters map<string,string>, at timestamp").parquet(str(tmp_path / "in"))
    receipts = spark.createDataFrame(RECEIPTS, "id long, transaction_id string, amount decimal(12,0), is_paid boolean, related_job_id long, service_pack_id long").withColumn("status", F.lit("PENDING"))

    def apply(batch, number):
        if batch.isEmpty():  # the last batch only moves the watermark
            return
        replied = payments.replies(batch, receipts, None, F.col("at"))
        replied.select("at", "reply").write.mode("append").parquet(str(tmp_path / "out"))
        payments.receipts_settled(receipts, replied).where("id = 1").write.mode("append").parquet(str(tmp_path / "receipts"))

    settle(stream, "k", apply, str(tmp_path / "checkpoint")).awaitTermination(120)
    # The forged one is gone, repeats went once, and the payment after the failure counts.
    found = [r["reply"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()]
    assert found == ["00", "00", "01"]
    assert [(r["status"], r["is_paid"]) for r in spark.read.parquet(str(tmp_path / "receipts")).collect()] == [("SUCCESS", True)]


def test_gates(spark):
    users = spark.createDataFrame([(1, "EMPLOYER", True, False, False), (2, "EMPLOYER", True, False, False), (3, "ADMIN", True, None, True), (4, "CANDIDATE", None, None, None), (5, "EMPLOYER", False, True, False)], "id long, role string, is_active boolean, is_staff boolean, is_superuser boolean")
    owners = spark.createDataFrame([(1, "APPROVED"), (2, None), (3, "APPROVED"), (5, "APPROVED")], "user_id long, status string")
    found = {g: ids(integrity.admitted(users, owners, g)) for g in ("admin", "employer", "candidate", "approved", "staff")}
    assert found == {"admin": [3], "employer": [1, 2], "candidate": [4], "approved": [1], "staff": [3]}
    with pytest.raises(ValueError):
        integrity.admitted(users, owners, "other")


def test_declared_lengths_and_domains(spark):
    df = spark.createDataFrame([(1, "x" * 256, "REMOTE"), (2, "x" * 255, "y" * 30), (3, None, None)], "id long, title string, employment_type string")
    assert sorted(map(tuple, integrity.broken_columns(df, "job").collect())) == [(1, "title"), (2, "employment_type")]


def test_composed_updates(spark, data):
    bridge = data["job_tags"]
    jobs, links = mutations.job_updated(data["job"], bridge, spark.createDataFrame([(1, "New", None)], "id long, title string, views int"))
    assert jobs.where("id = 1").select("title").first()[0] == "New" and links.count() == bridge.count() and jobs.count() == 50
    tables_ = {"candidate_profile": data["candidate_profile"], "user": data["user"], "skill": spark.createDataFrame([(1, "SQL")], "id long, name string"), "candidate_skills": spark.createDataFrame([(11, 1), (12, 1), (13, 1)], "candidate_id long, skill_id long")}
    skills = spark.createDataFrame([(11, " Spark "), (11, "SQL"), (12, None)], "user_id long, name string")
    out = mutations.profile_updated(tables_, spark.createDataFrame([(11, "here", "hello")], "user_id long, address string, bio string"), skills)
    named = out["candidate_skills"].join(out["skill"], F.col("skill_id") == F.col("id")).select("candidate_id", "name")
    assert sorted(map(tuple, named.collect())) == [(11, "SQL"), (11, "Spark"), (13, "SQL")]
    assert out["candidate_profile"].where("user_id = 11").select("address").first()[0] == "here"
    assert out["user"].where("id = 11").select("bio").first()[0] == "hello" and out["user"].where("bio = 'hello'").count() == 1


def test_first_children_of_each_parent(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("p"), "id")
    found = {r["parent"]: [x["id"] for x in r["items"]] for r in relations.children(df, "p", "id", most=2, descending=True).collect()}
    assert found == {0: [999, 996], 1: [997, 994], 2: [998, 995]}


def test_json_files_and_parts_of_a_database(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, name string")
    tables.write_json(df, str(tmp_path / "json"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "json")).select("id", "name").collect()), key=str) == [(1, None), (2, "x")]
    tables.append(df, str(tmp_path / "rows"))
    tables.append(df, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 4
    # Spark brings an embedded database along.
    database = {"url": "jdbc:derby:memory:jobs;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(100).selectExpr("id", "concat('job ', id) AS name")
    rows.write.format("jdbc").options(dbtable="JOBS", **database).mode("overwrite").save()
    found = tables.jdbc(spark, database["url"], "JOBS", key='"id"', parts=4, driver=database["driver"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))


def test_generator_repeats_itself(spark, data):
    again = generator.generate(spark, 3)
    for name in ("job", "application", "user"):
        assert sorted(map(str, again[name].collect())) == sorted(map(str, data[name].collect()))
    assert integrity.repeated(data["application"], ("candidate_id", "job_id")).count() == 0
    assert data["application"].groupBy("candidate_id").count().where("count NOT BETWEEN 3 AND 5").count() == 0
