"""Filters, free text, order and pages."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.dates import recent_from
from hirelake.sources.schema import DOMAINS

#: Finds text whatever its case and accents; None compares lower-cased text, as plain SQL can.
ANY_CASE_AND_ACCENT = "UNICODE_CI_AI"

PAGE, MAX_PAGE = 20, 100

# What forms call levels and types.
LEVEL_OF = {"no_experience": "FRESHER", "less_than_1": "FRESHER", "1_3": "JUNIOR", "3_5": "MIDDLE", "5_10": "SENIOR", "more_than_10": "EXPERT"}
TYPE_OF = {"full": "FULL_TIME", "part": "PART_TIME", "remote": "REMOTE", "intern": "INTERN"}


def contains(c: Column, needle: str | Column, collation: str | None = ANY_CASE_AND_ACCENT) -> Column:
    """Whether a text has a needle, without regard to case."""
    if collation is None:
        return F.contains(F.lower(c), F.lower(F.lit(needle)))
    return F.contains(F.collate(c, collation), F.collate(F.lit(needle), collation))


def any_contains(columns: Iterable[Column], needle: str | Column, collation: str | None = ANY_CASE_AND_ACCENT) -> Column:
    return reduce(or_, (contains(c, needle, collation) for c in columns))


def matches_terms(columns: Iterable[Column], text: str, collation: str | None = ANY_CASE_AND_ACCENT) -> Column:
    """Each term, of those that blanks or commas separate, is in one of the columns."""
    columns = list(columns)
    return reduce(and_, (any_contains(columns, t, collation) for t in text.replace(",", " ").split()), F.lit(True))


def public(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs that everyone sees. One without a deadline is not seen: the comparison is unknown."""
    return jobs.where(F.col("active") & (F.col("deadline") >= as_of))


def owned_by(df: DataFrame, column: str, principal: int) -> DataFrame:
    return df.where(F.col(column) == principal)


def among(df: DataFrame, ids: list[int], column: str = "id") -> DataFrame:
    return df.where(F.col(column).isin(ids))


@dataclass(frozen=True)
class FilterSpec:
    """What a caller may limit a job search by; None and empty values limit nothing."""

    search: str | None = None
    location: str | None = None
    min_salary: int | None = None
    max_salary: int | None = None
    created_after: str | Column | None = None
    created_before: str | None = None
    category_id: int | None = None
    employment_type: str | None = None
    experience_level: str | None = None
    collation: str | None = ANY_CASE_AND_ACCENT

    def __post_init__(self):
        for name in ("employment_type", "experience_level"):
            if (value := getattr(self, name)) and value not in DOMAINS["job", name]:
                raise ValueError(f"{value!r} is no {name}")

    def condition(self) -> Column:
        """On jobs with the column location_name. created_before excludes what comes after that day's midnight."""
        on = []
        if self.search and self.search.strip():
            on.append(matches_terms([F.col("title"), F.col("company_name")], self.search, self.collation))
        if self.location:
            on.append(contains(F.col("location_name"), self.location, self.collation))
        if self.min_salary is not None:
            on.append(F.col("salary_min") >= self.min_salary)
        if self.max_salary is not None:
            on.append(F.col("salary_max") <= self.max_salary)
        if self.created_after is not None and not (isinstance(self.created_after, str) and not self.created_after):
            on.append(F.col("created_date") >= F.lit(self.created_after).cast("timestamp"))
        if self.created_before:
            on.append(F.col("created_date") <= F.lit(self.created_before).cast("timestamp"))
        for name in ("category_id", "employment_type", "experience_level"):
            if value := getattr(self, name):
                on.append(F.col(name) == value)
        return reduce(and_, on, F.lit(True))

    @classmethod
    def from_form(cls, form: dict, as_of: Column) -> FilterSpec:
        """From a form's fields: search, category, location, salary in millions, job types (the first counts), experience
        and last update."""
        salary = form.get("salary") or {}
        scaled = lambda x: None if x is None else int(x * 1_000_000)
        return cls(
            search=form.get("search"),
            location=form.get("location"),
            category_id=form.get("category"),
            min_salary=scaled(salary.get("min")),
            max_salary=scaled(salary.get("max")),
            employment_type=TYPE_OF.get((form.get("job_types") or [""])[0]),
            experience_level=LEVEL_OF.get(form.get("experience") or ""),
            created_after=recent_from(form.get("last_update"), as_of),
        )


SORTABLE = ("salary_min", "salary_max", "created_date")


def sort_names(text: str | None, allowed: Iterable[str] = SORTABLE, default: str = "-created_date", key: str = "id") -> list[str]:
    """Names to sort by from a list such as "-salary_max,created_date", each with a - if it descends. Names that aren't
    allowed are dropped, and without any left the default holds. The key decides ties."""
    names = [x.strip() for x in (text or "").split(",")]
    return [*([x for x in names if x.lstrip("-") in set(allowed)] or [default]), key]


def sort_keys(names: Iterable[str]) -> list[Column]:
    """Nulls come first upwards and last downwards, Spark's own order."""
    return [F.col(x[1:]).desc() if x.startswith("-") else F.col(x).asc() for x in names]


def ordering(text: str | None, allowed: Iterable[str] = SORTABLE, default: str = "-created_date", key: str = "id") -> list[Column]:
    return sort_keys(sort_names(text, allowed, default, key))


@dataclass(frozen=True)
class Page:
    """A page of rows and, apart, the count of all."""

    rows: DataFrame
    unpaged: DataFrame
    number: int
    size: int

    def envelope(self) -> dict:
        """Counts rows: an action. A page past the last one raises LookupError; the first may be empty."""
        count = self.unpaged.count()
        if self.number > 1 and (self.number - 1) * self.size >= count:
            raise LookupError(f"there is no page {self.number}")
        return {"count": count, "next": self.number + 1 if self.number * self.size < count else None, "previous": self.number - 1 if self.number > 1 else None}


def page(df: DataFrame, keys: list[Column], number: int = 1, size: int = PAGE, most: int | None = MAX_PAGE) -> Page:
    """Page from 1. A size above the most is cut to it; pages are cut by a top-k, not by a full sort."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    size = size if most is None else min(size, most)
    return Page(df.orderBy(*keys).offset((number - 1) * size).limit(size), df, number, size)


def behind(names: list[str], row) -> Column:
    """Whether a row comes after another one in the order of names: a page that begins there needs no rows before it."""
    after, same = F.lit(False), F.lit(True)
    for x in names:
        column, value = F.col(x.removeprefix("-")), F.lit(row[x.removeprefix("-")])
        if x.startswith("-"):
            beyond = column.isNull() & value.isNotNull() | F.coalesce(column < value, F.lit(False))
        else:
            beyond = value.isNull() & column.isNotNull() | F.coalesce(column > value, F.lit(False))
        after, same = after | same & beyond, same & column.eqNullSafe(value)
    return after


def next_page(df: DataFrame, names: list[str], last=None, size: int = PAGE) -> DataFrame:
    """The rows that follow the last one shown, if any, as a list that grows asks for them. The last of names is unique."""
    return (df if last is None else df.where(behind(names, last))).orderBy(*sort_keys(names)).limit(size)


def search_jobs(jobs: DataFrame, locations: DataFrame, spec: FilterSpec, as_of: Column, order: str | None = None) -> tuple[DataFrame, list[Column]]:
    """Public jobs under a specification, with location_name, and the keys to page them by."""
    named = locations.select(F.col("id").alias("location_id"), F.col("name").alias("location_name"))
    return public(jobs, as_of).join(named, "location_id").where(spec.condition()), ordering(order)


def facets(df: DataFrame, **values) -> DataFrame:
    """Equality on each column that has a value."""
    return reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == kv[1]), values.items(), df)
