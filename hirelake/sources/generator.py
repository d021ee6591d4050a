"""A recruiting data set for tests and demonstrations: the same for the same seed, on any cluster.

Every choice is a digest of the seed, the row's number and the choice's name, so no row depends on partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.sources.schema import DOMAINS, schema

CATEGORIES = ("Công nghệ thông tin", "Kế toán", "Marketing")
LOCATIONS = ("North", "South", "Coast")
TAGS = ("Java", "Evening", "Travel", "Team")
START = "2024-01-01 08:00:00"


def _draw(seed: int, name: str, n: int, key: str = "id") -> Column:
    """0 to n - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), key), F.lit(n)).cast("int")


def _pick(seed: int, name: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), _draw(seed, name, len(values)) + 1)


def drawn(seed: int, name: str, k: Column, n: int, key: str = "id") -> Column:
    """The k-th draw (from 0, below n) without replacement from 0 to n - 1, for each value of key anew.

    Which number comes k-th is a permutation of the numbers, keyed by seed, name and key: four rounds that each add a digest
    of one half of a number to its other half, over the least square that holds n. A number that falls outside is sent
    through again until it is inside, which keeps it a permutation. So any draw can be made alone, for any n.
    """
    side = max(1, math.isqrt(max(0, n - 1)) + 1)

    def once(x: Column) -> Column:
        left, right = F.floor(x / side).cast("long"), F.pmod(x, F.lit(side))
        for turn in range(4):
            left, right = right, F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.lit(turn), F.col(key), right), F.lit(side)), F.lit(side))
        return left * side + right

    # More than half of the square is inside, so that 64 turns would not do has a chance of 2**-64.
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(k.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def weighted(seed: int, name: str, values: tuple, weights: tuple[float, ...], key: str = "id") -> Column:
    """One of the values by weight, from an alias table: a draw picks a slot, and another one the slot's own value or the one
    that fills it up. Costs the same for any number of values."""
    n, total = len(values), sum(weights)
    share, other = [w * n / total for w in weights], list(range(n))
    small, large = [i for i in range(n) if share[i] < 1], [i for i in range(n) if share[i] >= 1]
    while small and large:
        i, j = small.pop(), large[-1]
        other[i] = j
        share[j] -= 1 - share[i]
        if share[j] < 1:
            small.append(large.pop())
    for i in small + large:
        share[i] = 1.0  # what rounding has left
    slot = _draw(seed, name + " slot", n, key)
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), slot + 1)
    kept = _draw(seed, name + " share", 1 << 30, key) < at([s * (1 << 30) for s in share])
    return F.when(kept, at(values)).otherwise(at([values[i] for i in other]))


def _table(df: DataFrame, table: str, seed: int, **columns: Column) -> DataFrame:
    made = {"active": F.lit(True), "created_date": F.lit(START).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), _draw(seed, table, 100_000, df.columns[0])), **columns}
    made.setdefault("updated_date", made["created_date"])
    return df.select(*(made.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)))


def generate(spark: SparkSession, seed: int = 1, employers: int = 10, candidates: int = 20, jobs: int = 50) -> dict[str, DataFrame]:
    """Half of the employers are approved; salaries span 5 million; a fifth of the jobs are featured; a job has two tags
    and a candidate applies to three to five different jobs."""
    numbers = lambda n, start=1: spark.range(start, start + n)
    names = lambda values: spark.createDataFrame(list(enumerate(values, 1)), "id long, name string")
    is_employer = F.col("id") <= employers
    user = numbers(employers + candidates)
    out = {
        "user": _table(user, "user", seed, username=F.concat(F.lit("user"), "id"), first_name=F.concat(F.lit("An"), "id"), last_name=F.lit("Nguyễn"), email=F.concat(F.lit("user"), F.col("id"), F.lit("@example.org")), role=F.when(is_employer, "EMPLOYER").otherwise("CANDIDATE"), is_active=F.lit(True)),
        "employer_profile": _table(numbers(employers), "employer_profile", seed, user_id=F.col("id"), company_name=F.concat(F.lit("Công ty "), F.col("id")), tax_code=F.lpad(F.col("id").cast("string"), 10, "0"), status=F.when(F.col("id") <= employers // 2, "APPROVED").otherwise("PENDING")),
        "candidate_profile": _table(numbers(candidates, employers + 1), "candidate_profile", seed, user_id=F.col("id"), experience_years=_draw(seed, "years", 11), education_status=_pick(seed, "education", DOMAINS["candidate_profile", "education_status"]), gender=_pick(seed, "gender", DOMAINS["candidate_profile", "gender"])),
        "job_category": names(CATEGORIES),
        "location": names(LOCATIONS),
        "tag": _table(names(TAGS), "tag", seed),
    }
    low = (_draw(seed, "salary", 41) + 10).cast("long") * 1_000_000
    out["job"] = _table(
        numbers(jobs), "job", seed, posted_by_id=_draw(seed, "owner", max(1, employers // 2)).cast("long") + 1, title=F.concat(F.lit("Vị trí "), F.col("id")), company_name=F.lit(None), is_featured=weighted(seed, "featured", (True, False), (20, 80)),
        category_id=_draw(seed, "category", len(CATEGORIES)) + 1, location_id=_draw(seed, "location", len(LOCATIONS)) + 1, employment_type=_pick(seed, "type", DOMAINS["job", "employment_type"]), experience_level=_pick(seed, "level", DOMAINS["job", "experience_level"]),
        views=_draw(seed, "views", 4_991) + 10, salary_min=low, salary_max=low + 5_000_000, deadline=F.date_add(F.lit(START).cast("date"), 30),
    )
    first = _draw(seed, "tag", len(TAGS))
    out["job_tags"] = numbers(jobs).select(F.col("id").alias("job_id"), F.explode(F.array(first + 1, F.pmod(first + 1 + _draw(seed, "second", len(TAGS) - 1), F.lit(len(TAGS))) + 1).cast("array<bigint>")).alias("tag_id"))
    applied = numbers(candidates, employers + 1).withColumn("k", F.explode(F.sequence(F.lit(0), F.least(_draw(seed, "applications", 3) + 2, F.lit(jobs - 1)))))
    applied = applied.select(F.col("id").alias("candidate_id"), (drawn(seed, "job", F.col("k"), jobs) + 1).alias("job_id"), (F.col("id") * 10 + F.col("k")).alias("id"))
    out["application"] = _table(applied.select("id", "candidate_id", "job_id"), "application", seed, status=_pick(seed, "status", DOMAINS["application", "status"]))
    return out
