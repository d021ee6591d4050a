"""Labels, names, lists and markup: string functions of one row."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Texts that users see.
NEGOTIABLE = "Thỏa thuận"
COUNTRY = "Việt Nam"
PRESENT = "Present"
EMPTY_CELL = "---"
AVATAR = "https://ui-avatars.com/api/?name={}&background=random&color=fff&size=512&font-size=0.5"


def filled(c: Column) -> Column:
    """c, with an empty string counted as null."""
    return F.nullif(c, F.lit(""))


def or_default(c: Column, default) -> Column:
    """c or the default, if c is null or empty."""
    return F.coalesce(filled(c), default if isinstance(default, Column) else F.lit(default))


def full_name(first: Column, last: Column, username: Column) -> Column:
    """Last and first name, or whichever there is, or the user name."""
    first, last = filled(first), filled(last)
    return F.when(first.isNotNull() & last.isNotNull(), F.concat(last, F.lit(" "), first)).otherwise(F.coalesce(first, last, username))


def display_name(first: Column, username: Column) -> Column:
    return F.coalesce(filled(first), username)


def percent_encoded(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits, _.-~ and / as they are. url_encode is for forms: it writes a blank
    as +, encodes ~ and /, and leaves *."""
    out = F.url_encode(c)
    for found, put in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(found), F.lit(put))
    return out


def default_avatar(first: Column, last: Column, username: Column) -> Column:
    """The address of a picture with initials; empty without any name."""
    name = F.coalesce(filled(F.trim(F.concat(F.coalesce(last, F.lit("")), F.lit(" "), F.coalesce(first, F.lit(""))))), filled(username))
    before, after = AVATAR.split("{}")
    return F.coalesce(F.concat(F.lit(before), percent_encoded(name), F.lit(after)), F.lit(""))


def media_url(url: Column, fallback: Column | None = None) -> Column:
    return F.coalesce(filled(url), fallback if fallback is not None else F.lit(""), F.lit(""))


@F.pandas_udf(StringType())
def _without_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "" if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def strip_accents(c: Column) -> Column:
    """Letters without combining marks, after compatibility decomposition; null gives the empty string. Letters that are
    their own, such as Đ, stay. Spark has no normalisation, so texts go to Python in Arrow batches, in which those of ASCII
    alone, which stay as they are, are nulls."""
    plain = F.length(c) == F.octet_length(c)
    return F.when(plain, c).otherwise(_without_marks(F.when(~plain, c)))


def strip_html(c: Column) -> Column:
    """Text of markup: breaks, paragraph and list item ends become line ends, other tags go, five entities are decoded in
    this order, and white space at both ends goes."""
    out = F.coalesce(c, F.lit(""))
    for found, put in ((r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"(?i)</li>", "\n"), (r"<[^>]+>", "")):
        out = F.regexp_replace(out, found, put)
    for found, put in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = F.replace(out, F.lit(found), F.lit(put))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def looks_like_html(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)<[a-z][\s\S]*>"), F.lit(False))


def _parts(c: Column, separator: Column) -> Column:
    trimmed = F.transform(F.split(c, F.concat(F.lit(r"\Q"), separator, F.lit(r"\E"))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(filled(c).isNull(), F.array().cast("array<string>")).otherwise(F.filter(trimmed, lambda x: x != ""))


def parse_lines(c: Column) -> Column:
    """Items of a text: its lines, or its sentences if it has one line only."""
    return _parts(c, F.when(F.contains(c, F.lit("\n")), F.lit("\n")).otherwise(F.lit(".")))


def parse_commas(c: Column) -> Column:
    return _parts(c, F.lit(","))


def parse_ids(c: Column) -> Column:
    """Numbers in a comma-separated list; what is no number is left out, as is one too large for an id."""
    return F.filter(F.transform(F.filter(parse_commas(c), lambda x: x.rlike(r"^\d+$")), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def initials(c: Column) -> Column:
    """First letters of the first and last word, of the only word, or U without a name."""
    words = F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), " ")
    last = F.when(F.size(words) > 1, F.substring(F.element_at(words, -1), 1, 1)).otherwise("")
    return F.when(filled(c).isNull(), F.lit("U")).otherwise(F.upper(F.concat(F.substring(words[0], 1, 1), last)))


def enum_label(c: Column) -> Column:
    """FULL_TIME as FULL TIME: the first underscore becomes a blank."""
    return F.regexp_replace(c, "^([^_]*)_", "$1 ")


def enum_title(c: Column) -> Column:
    """FULL_TIME as Full time."""
    return F.concat(F.substring(c, 1, 1), F.regexp_replace(F.lower(F.substr(c, F.lit(2))), "^([^_]*)_", "$1 "))


def compare_cell(c: Column) -> Column:
    """A value, or a mark for none."""
    return or_default(c, EMPTY_CELL)


def compare_list(names: Column) -> Column:
    """Names joined by commas; null gives the mark for none, and no names the empty string."""
    return F.when(names.isNull(), F.lit(EMPTY_CELL)).otherwise(F.array_join(names, ", "))


def split_full_name(c: Column) -> Column:
    """first_name is the last word and last_name the rest; a single word is the last name."""
    words = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""), " ")
    many = F.size(words) > 1
    return F.struct(
        F.when(many, F.element_at(words, -1)).otherwise("").alias("first_name"),
        F.when(many, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")).otherwise(words[0]).alias("last_name"),
    )


def degree_label(level: Column, field: Column) -> Column:
    return F.when(filled(level).isNull(), field).otherwise(F.concat(level, F.lit(" - "), F.coalesce(field, F.lit("null"))))


def split_degree(c: Column) -> Column:
    """The level before the first separator and the field after it; without one all is the field."""
    at = F.instr(F.coalesce(c, F.lit("")), F.lit(" - "))
    return F.struct(F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise("").alias("level"), F.when(at > 0, F.substr(c, at + 3)).otherwise(F.coalesce(c, F.lit(""))).alias("field"))


def file_has_type(name: Column, types: tuple[str, ...] = ("pdf", "doc", "docx")) -> Column:
    return F.lower(name).rlike(r"\.(" + "|".join(types) + ")$")


def file_name(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def image_type(uri: Column) -> Column:
    """image/ with the extension, or image without one."""
    extension = F.regexp_extract(file_name(uri), r"\.(\w+)$", 1)
    return F.when(extension == "", F.lit("image")).otherwise(F.concat(F.lit("image/"), extension))


def client_ip(forwarded_for: Column, remote: Column) -> Column:
    return F.coalesce(F.split(filled(forwarded_for), ",")[0], remote)


def link_parameter(url: Column, key: str) -> Column:
    """A parameter of a link's query, decoded."""
    return F.try_url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(key)))


def looked_up(c: Column, labels: dict[str, str], default: str | None = None) -> Column:
    """The label of a code."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


# Colours of a state, and of an application's state.
STATUS_COLOURS = {"PENDING": "#FFC107", "APPROVED": "#28A745", "REJECTED": "#DC3545"}
APPLICATION_COLOURS = {"APPROVED": "#E8FAEF", "OFFERED": "#E8FAEF", "REJECTED": "#FFEBEB", "INTERVIEWED": "#E6E1FF"}


#: What the states of an employer are called.
STATUS_LABELS = {"PENDING": "Pending", "APPROVED": "Approved", "REJECTED": "Rejected"}


def status_label(c: Column) -> Column:
    """A state's name; one that has none is shown as it is."""
    return F.coalesce(looked_up(c, STATUS_LABELS), c)


def is_verified(status: Column) -> Column:
    return F.coalesce(status == "APPROVED", F.lit(False))


def job_label(title: Column, company: Column) -> Column:
    return F.concat(title, F.lit(" - "), company)


def user_label(first: Column, email: Column) -> Column:
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" ("), email, F.lit(")"))


def candidate_label(first: Column, last: Column, username: Column) -> Column:
    """First and last name, or the user name without either."""
    name = F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))
    return F.coalesce(filled(name), username)


def education_label(level: Column, institution: Column) -> Column:
    return F.concat(level, F.lit(" - "), institution)


def language_label(language: Column, native: Column, oral: Column, written: Column) -> Column:
    mark = F.when(native, " (Native)").otherwise("")
    return F.concat(language, mark, F.lit(" - Oral: "), oral.cast("string"), F.lit(", Written: "), written.cast("string"))


def pack_label(name: Column, price: Column) -> Column:
    return F.concat(name, F.lit(" - "), price.cast("decimal(12,0)").cast("string"), F.lit(" VND"))


def receipt_label(receipt_id: Column, username: Column, amount: Column) -> Column:
    return F.concat(F.lit("Receipt #"), receipt_id.cast("string"), F.lit(" - "), username, F.lit(" - "), amount.cast("decimal(12,0)").cast("string"))


def bookmark_label(user: Column, job: Column) -> Column:
    return F.concat(user, F.lit(" bookmarked "), job)


def status_colour(c: Column) -> Column:
    return looked_up(c, STATUS_COLOURS, "gray")


def application_colour(c: Column) -> Column:
    return looked_up(F.upper(c), APPLICATION_COLOURS, "#FFF4E5")


def drop_blank(items: Column) -> Column:
    """An array without nulls and empty strings."""
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def first_and_more(items: Column, shown: int) -> Column:
    """The first items, and how many more there are."""
    return F.struct(F.slice(items, 1, shown).alias("shown"), F.greatest(F.size(items) - shown, F.lit(0)).alias("more"))


def toggled(items: Column, item: Column) -> Column:
    """Without the item if it is there, else with it at the end."""
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def with_item(items: Column, item: Column) -> Column:
    return F.array_union(items, F.array(item))
