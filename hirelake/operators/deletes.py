"""Deletes as one pass over the graph of references.

The tables that a delete can reach are put in an order in which each comes behind all that lead to it. Keys of rows that
go are gathered for each table from all its parents at once, so a row that several paths reach goes once, and all of them
are stored by one action. A second one judges every reference that forbids. Neither number grows with the graph.
"""

from __future__ import annotations

import uuid
from functools import partial, reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.sources.schema import CASCADE, PROTECT, REFERENCES, RESTRICT, SET_NULL
from hirelake.sources.storage import shared_folder

#: (table, column): (table referred to, its key, policy).
References = dict[tuple[str, str], tuple[str, str, str]]
GONE = "key_that_goes"


class Refused(Exception):
    """Rows are referred to that must not go."""


def reached(table: str, tables: dict[str, DataFrame], references: References = REFERENCES) -> list[str]:
    """The table and all that a delete there may cascade to, each behind all that lead to it. Cascades in a circle are a
    ValueError."""
    parents: dict[str, set[str]] = {table: set()}
    todo = [table]
    while todo:
        at = todo.pop()
        for (child, _), (parent, _, policy) in references.items():
            if parent == at and policy == CASCADE and child in tables:
                if child not in parents:
                    parents[child] = set()
                    todo.append(child)
                parents[child].add(parent)
    return list(TopologicalSorter(parents).static_order())


def _key(table: str, references: References) -> str | None:
    return next((key for to, key, _ in references.values() if to == table), None)


def _edges(child: str, policy: str, gone: dict[str, DataFrame], references: References) -> list[tuple[str, str]]:
    """Columns of a table, with the tables that they refer to, whose rows go."""
    return [(column, parent) for (of, column), (parent, _, p) in references.items() if of == child and p == policy and parent in gone]


def _referring(df: DataFrame, column: str, gone: DataFrame, how: str) -> DataFrame:
    return df.join(gone, F.col(column) == F.col(GONE), how)


def keys_that_go(tables: dict[str, DataFrame], table: str, keys: DataFrame, references: References = REFERENCES) -> dict[str, DataFrame]:
    """By table that others refer to, the keys of its rows that go with those of a table (keys has one column), in a
    column GONE: each once, stored in the shared folder by a single action, where they stay for the results that are read
    by them. Nulls are no keys."""
    gone = {table: keys.select(F.col(keys.columns[0]).alias(GONE))}
    for name in reached(table, tables, references):
        if name != table and (key := _key(name, references)):
            hits = [_referring(tables[name], column, gone[parent], "left_semi") for column, parent in _edges(name, CASCADE, gone, references)]
            gone[name] = reduce(DataFrame.union, (hit.select(F.col(key).alias(GONE)) for hit in hits))
        elif name != table:
            continue
        gone[name] = gone[name].where(F.col(GONE).isNotNull()).distinct()
    # A column for each table: keys keep their types. A scan of files tells the planner their size, so few keys are broadcast
    # and the tables that they are compared with stay where they are; many are met by a shuffle.
    found = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), (df.withColumnRenamed(GONE, name) for name, df in gone.items()))
    path = f"{shared_folder(keys.sparkSession)}/deleted-{uuid.uuid4().hex}"
    found.write.parquet(path)
    stored = keys.sparkSession.read.schema(found.schema).parquet(path)
    return {name: stored.where(F.col(name).isNotNull()).select(F.col(name).alias(GONE)) for name in gone}


def deleted(tables: dict[str, DataFrame], table: str, keys: DataFrame, references: References = REFERENCES) -> dict[str, DataFrame]:
    """The tables after deleting the rows of a table whose key is in keys (one column). Rows that refer to them go too,
    lose the reference, or forbid it all, by the reference's policy: one that protects forbids in any case, one that
    restricts unless the row that refers goes by a cascade itself. Tables that are not given are not looked at; null
    references refer to nothing; keys that no row has change nothing but what refers to them."""
    gone = keys_that_go(tables, table, keys, references)

    def staying(df: DataFrame, name: str) -> DataFrame:
        if name == table:
            return _referring(df, _key(table, references) or "id", gone[table], "left_anti")
        return reduce(lambda left, edge: _referring(left, edge[0], gone[edge[1]], "left_anti"), _edges(name, CASCADE, gone, references), df)

    forbidding = [_referring(df, c, gone[p], "left_semi").select(F.lit(f"{name}.{c} refers to rows of {p}").alias("why")) for name, df in tables.items() for c, p in _edges(name, PROTECT, gone, references)]
    forbidding += [staying(_referring(df, c, gone[p], "left_semi"), name).select(F.lit(f"{name}.{c} refers to rows of {p}").alias("why")) for name, df in tables.items() for c, p in _edges(name, RESTRICT, gone, references)]
    if forbidding:
        # One row for each reference of the schema at most.
        reasons = reduce(DataFrame.union, forbidding).groupBy("why").count().orderBy("why").collect()
        if reasons:
            raise Refused("; ".join(f"{why} ({n} rows)" for why, n in reasons))
    out = {}
    for name, df in tables.items():
        out[name] = staying(df, name)
        for column, parent in _edges(name, SET_NULL, gone, references):
            out[name] = _referring(out[name], column, gone[parent], "left").withColumn(column, F.when(F.col(GONE).isNull(), F.col(column))).drop(GONE)
    return out
