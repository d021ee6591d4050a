import datetime as dt
import hashlib
import hmac
import unicodedata
import urllib.parse
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hirelake.functions import dates, money, text


@pytest.fixture(scope="module")
def value(spark):
    """Evaluates expressions on one row of values."""

    def run(expression, **values):
        schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else {bool: 'boolean', int: 'bigint', float: 'double', Decimal: 'decimal(20,2)', dt.date: 'date', dt.datetime: 'timestamp', list: 'array<string>', dict: 'map<string,string>'}[type(v)]}" for k, v in values.items()) or "x int"
        return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(expression.alias("out")).first()["out"]

    return run


c = F.col


@pytest.mark.parametrize("first,last,expected", [("An", "Lê", "Lê An"), ("An", "", "An"), ("", "Lê", "Lê"), (None, None, "u"), ("", "", "u")])
def test_full_name(value, first, last, expected):
    assert value(text.full_name(c("f"), c("l"), c("u")), f=first, l=last, u="u") == expected


def test_display_name(value):
    assert value(text.display_name(c("f"), c("u")), f="", u="u") == "u"


@pytest.mark.parametrize("name", ["Bé Na", "a/b~c*d", "x+y&z=1", "Đà Nẵng 😀"])
def test_percent_encoding(value, name):
    assert value(text.percent_encoded(c("x")), x=name) == urllib.parse.quote(name)


def test_avatar_and_media(value):
    assert value(text.default_avatar(c("f"), c("l"), c("u")), f="An", l="Lê", u="u") == text.AVATAR.format(urllib.parse.quote("Lê An"))
    assert value(text.default_avatar(c("f"), c("l"), c("u")), f=None, l=None, u="") == ""
    assert value(text.media_url(c("x")), x=None) == "" and value(text.media_url(c("x")), x="a") == "a"


@pytest.mark.parametrize("s", ["Đà Nẵng", "ﬁ ½ é", "", None, "plain"])
def test_strip_accents(value, s):
    expected = "".join(x for x in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(x))
    assert value(text.strip_accents(c("x")), x=s) == expected


@pytest.mark.parametrize("html,expected", [(None, ""), ("<p>a</p><p>b</p>", "a\n\nb"), ("a<BR/>b<br >c", "a\nb\nc"), ("<ul><li>x</li><li>y</li></ul>", "x\ny"), ("&amp;lt; &quot;q&quot;&nbsp;", '< "q"'), ("\n\t t \n", "t")])
def test_strip_html(value, html, expected):
    assert value(text.strip_html(c("x")), x=html) == expected


def test_looks_like_html(value):
    assert [value(text.looks_like_html(c("x")), x=s) for s in ("<P>\n</p>", "1 < 2 > 1", None, "a")] == [True, False, False, False]


def test_lists(value):
    assert value(text.parse_lines(c("x")), x="a. b\n\n c ") == ["a. b", "c"]
    assert value(text.parse_lines(c("x")), x="a. b..c") == ["a", "b", "c"]
    assert value(text.parse_lines(c("x")), x=None) == [] == value(text.parse_commas(c("x")), x="")
    assert value(text.parse_commas(c("x")), x=" a ,, b.c") == ["a", "b.c"]
    assert value(text.parse_ids(c("x")), x="1, 2,x, -3,,9999999999999999999,04") == [1, 2, 4]
    assert value(text.drop_blank(c("x")), x=["a", None, ""]) == ["a"]
    assert tuple(value(text.first_and_more(c("x"), 2), x=["a", "b", "c"])) == (["a", "b"], 1)
    assert value(text.toggled(c("x"), F.lit("b")), x=["a", "b"]) == ["a"] and value(text.toggled(c("x"), F.lit("c")), x=["a"]) == ["a", "c"]
    assert value(text.with_item(c("x"), F.lit("a")), x=["a"]) == ["a"]


@pytest.mark.parametrize("s,expected", [(None, "U"), ("", "U"), ("an", "A"), ("an binh le", "AL"), (" an  le ", "AL")])
def test_initials(value, s, expected):
    assert value(text.initials(c("x")), x=s) == expected


def test_enum_labels(value):
    assert value(text.enum_label(c("x")), x="A_B_C") == "A B_C"
    assert value(text.enum_title(c("x")), x="FULL_TIME") == "Full time"


def test_split_full_name(value):
    split = lambda s: tuple(value(text.split_full_name(c("x")), x=s))
    assert split("Lê Văn An") == ("An", "Lê Văn") and split(" An ") == ("", "An") and split(None) == ("", "")


def test_degrees(value):
    assert value(text.degree_label(c("a"), c("b")), a="Bachelor", b="IT") == "Bachelor - IT"
    assert value(text.degree_label(c("a"), c("b")), a="", b="IT") == "IT"
    split = lambda s: tuple(value(text.split_degree(c("x")), x=s))
    assert split("A - B - C") == ("A", "B - C") and split("IT") == ("", "IT") and split(None) == ("", "")


def test_files_and_links(value):
    assert [value(text.file_has_type(c("x")), x=s) for s in ("a.PDF", "a.docx", "a.pdf.exe", "pdf")] == [True, True, False, False]
    assert value(text.image_type(c("x")), x="file://a/b.c/d.PNG") == "image/PNG" and value(text.image_type(c("x")), x="file://a/d") == "image"
    assert value(text.client_ip(c("a"), c("b")), a="1.1.1.1, 2.2.2.2", b="3.3.3.3") == "1.1.1.1" and value(text.client_ip(c("a"), c("b")), a="", b="3.3.3.3") == "3.3.3.3"
    assert value(text.link_parameter(c("x"), "q"), x="app://r?s=1&q=a%20b+c") == "a b c"


def test_look_ups(value):
    assert value(text.status_colour(c("x")), x="APPROVED") == "#28A745" and value(text.status_colour(c("x")), x=None) == "gray"
    assert value(text.application_colour(c("x")), x="approved") == "#E8FAEF" and value(text.application_colour(c("x")), x="?") == "#FFF4E5"
    assert value(text.compare_cell(c("x")), x="") == "---" and value(text.compare_list(c("x")), x=["a", "b"]) == "a, b"


@pytest.mark.parametrize("v,full,short", [(None, "Thỏa thuận", "0"), (0, "Thỏa thuận", "0"), (999, "999", "999"), (1234567, "1.234.567", "1.2 Triệu"), (2_000_000, "2.000.000", "2 Triệu"), (12_000, "12.000", "12.000")])
def test_currency(value, v, full, short):
    x = c("x").cast("bigint")
    assert value(money.currency(x), x=v) == full and value(money.currency_short(x), x=v) == short


def test_millions_are_rounded_as_printf_does(spark):
    """The double's exact value, halves to the even digit: 1.25 gives 1.2, 1.35 and 1.15 what their doubles are nearer to."""
    amounts = [*range(1_050_000, 12_000_000, 50_000), *range(999_999, 60_000_000, 777_777), 9_950_000, 2**40 * 10**6 + 250_000, 2**60]
    row = spark.createDataFrame([(v,) for v in amounts], "v long").select("v", money.currency_short(c("v")), money.salary_band(c("v"), c("v") + 500_000))
    for v, short, band in row.collect():
        assert short == (f"{v / 1e6:.1f}".removesuffix(".0") + " Triệu" if v >= 1_000_000 else f"{v:,}".replace(",", ".")), v
        assert band == f"{v / 1e6:.0f}M - {(v + 500_000) / 1e6:.0f}M", v


@pytest.mark.parametrize("low,high,expected", [(10_000_000, 15_000_000, "10M - 15M"), (0, 15_000_000, "15M"), (10_000_000, None, "10M"), (None, None, "Thỏa thuận"), (0, 0, "Thỏa thuận")])
def test_salary_band(value, low, high, expected):
    assert value(money.salary_band(c("a").cast("bigint"), c("b").cast("bigint")), a=low, b=high) == expected


def test_numbers(value):
    assert value(money.kilobytes(c("x")), x=1536) == 2 and value(money.clamped(c("x"), 1, 5), x=9) == 5 and value(money.rounded(c("x"), 5), x=13) == 15
    assert value(money.minor_units(c("x")), x=Decimal("150000")) == 15_000_000
    assert value(money.currency_local(c("x")), x=1000) == "1.000 đ"


PARAMETERS = {"b": "x y*~/é", "a": "1&2", "c": ""}


def test_signatures(value):
    query = urllib.parse.urlencode(sorted(PARAMETERS.items()))
    assert value(money.query_string(c("m")), m=PARAMETERS) == query
    for name in ("sha512", "sha256"):
        assert value(money.hmac_hex(c("x"), "key", name), x=query) == hmac.new(b"key", query.encode(), getattr(hashlib, name)).hexdigest()
    signed = PARAMETERS | {"secure_hash": hmac.new(b"key", query.encode(), hashlib.sha512).hexdigest()}
    assert value(money.signature_valid(c("m"), "key"), m=signed) is True
    assert value(money.signature_valid(c("m"), "other"), m=signed) is False
    assert value(money.signature_valid(c("m"), "key"), m=PARAMETERS) is False


def test_reference(value):
    assert value(money.transaction_reference("P", c("i"), c("t")), i=5, t=dt.datetime(1970, 1, 1, 0, 1, tzinfo=dt.UTC)) == "P_5_60"


DAY = dt.date(2024, 3, 10)


@pytest.mark.parametrize("days,expected", [(None, dates.OPEN), (-1, dates.EXPIRED), (0, dates.EXPIRES_SOON), (3, dates.EXPIRES_SOON), (4, dates.OPEN)])
def test_job_state(value, days, expected):
    deadline = None if days is None else DAY + dt.timedelta(days)
    assert value(dates.job_state(c("d").cast("date"), c("t")), d=deadline, t=DAY) == expected


@pytest.mark.parametrize("seconds,expected", [(-5, "Vừa xong"), (59, "Vừa xong"), (60, "1 phút trước"), (3600, "1 giờ trước"), (86399, "23 giờ trước"), (86400, "1 ngày trước"), (7 * 86400, "1 tuần trước"), (28 * 86400 - 1, "3 tuần trước"), (28 * 86400, "11/2/2024")])
def test_elapsed(value, seconds, expected):
    now = dt.datetime(2024, 3, 10, tzinfo=dt.UTC)
    assert value(dates.elapsed_label(c("p"), c("n")), p=now - dt.timedelta(seconds=seconds), n=now) == expected


def test_dates(value):
    assert value(dates.date_label(c("d")), d=DAY) == "10/03/2024" and value(dates.date_label(c("d").cast("date")), d=None) == dates.NO_DEADLINE
    assert value(dates.month_name(c("n").cast("int")), n=3) == "Mar" and value(dates.month_number(c("x")), x="Dec") == 12
    assert value(dates.first_of_month(F.lit(2024), F.lit(2))) == dt.date(2024, 2, 1)
    assert tuple(value(dates.month_and_year(c("x")), x="2024-02-05")) == ("Feb", 2024)
    assert value(dates.month_and_year(c("x")), x="Present") is None and value(dates.month_and_year(c("x")), x="never") is None
    assert value(dates.end_label(c("d").cast("date")), d=None) == "Present"
    assert value(dates.days_in_month(F.lit(2024), F.lit(2)))[-1] == "29"
    assert value(dates.recent_from("month", c("d")), d=dt.date(2024, 3, 31)) == dt.date(2024, 2, 29) and dates.recent_from("ever", c("d")) is None
    assert value(dates.period_label("quarter", F.lit(1))) == "Quý 1"
    assert value(dates.plus_seconds(c("t"), 36000), t=dt.datetime(2024, 1, 1, tzinfo=dt.UTC)).hour == 10
