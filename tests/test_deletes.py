"""Deletes over graphs of references: several paths, policies, circles, and the number of actions."""

import pytest

from hirelake.operators import deletes
from hirelake.sources.schema import CASCADE, PROTECT, RESTRICT, SET_NULL

#: a owns b and c; d belongs to both, e to d, and remembers an a.
DIAMOND = {
    ("b", "a_id"): ("a", "id", CASCADE),
    ("c", "a_id"): ("a", "id", CASCADE),
    ("d", "b_id"): ("b", "id", CASCADE),
    ("d", "c_id"): ("c", "id", CASCADE),
    ("e", "d_id"): ("d", "id", CASCADE),
    ("e", "a_id"): ("a", "id", SET_NULL),
}


@pytest.fixture(scope="module")
def diamond(spark):
    make = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))
    return {
        "a": make([(1,), (2,), (3,)], "id"),
        "b": make([(10, 1), (11, 2), (12, None)], "id a_id"),
        "c": make([(20, 1), (21, 2), (22, 3)], "id a_id"),
        # 30 is reached by two paths, 31 and 32 by one each, 33 and 34 by none; 34 refers to nothing.
        "d": make([(30, 10, 20), (31, 10, 21), (32, 11, 20), (33, 11, 21), (34, None, None)], "id b_id c_id"),
        "e": make([(40, 30, 2), (41, 33, 1), (42, 33, 2), (43, None, 1), (43, None, 1)], "id d_id a_id"),
    }


def rows(out):
    return {n: sorted(map(tuple, df.collect()), key=str) for n, df in out.items()}


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "key long")


def test_rows_reached_by_two_paths_go_once(spark, diamond):
    assert deletes.reached("a", diamond, DIAMOND)[0] == "a"
    assert deletes.reached("a", diamond, DIAMOND).index("d") > max(deletes.reached("a", diamond, DIAMOND).index(n) for n in "bc")
    gone = deletes.keys_that_go(diamond, "a", keys(spark, 1, 1, None, 99), DIAMOND)
    assert {n: sorted(r[0] for r in df.collect()) for n, df in gone.items()} == {"a": [1, 99], "b": [10], "c": [20], "d": [30, 31, 32]}
    assert rows(deletes.deleted(diamond, "a", keys(spark, 1, 1, None, 99), DIAMOND)) == {
        "a": [(2,), (3,)],
        "b": [(11, 2), (12, None)],
        "c": [(21, 2), (22, 3)],
        "d": [(33, 11, 21), (34, None, None)],
        "e": [(41, 33, None), (42, 33, 2), (43, None, None), (43, None, None)],
    }


def test_no_keys_and_tables_left_out(spark, diamond):
    assert rows(deletes.deleted(diamond, "a", keys(spark).limit(0), DIAMOND)) == rows(diamond)
    few = {n: diamond[n] for n in ("a", "d")}
    assert rows(deletes.deleted(few, "a", keys(spark, 1), DIAMOND))["d"] == rows(diamond)["d"]
    empty = {n: df.limit(0) for n, df in diamond.items()}
    assert not any(rows(deletes.deleted(empty, "a", keys(spark, 1), DIAMOND)).values())


def test_what_restricts_may_go_by_another_path(spark, diamond):
    restricted = DIAMOND | {("d", "c_id"): ("c", "id", RESTRICT)}
    # 32 refers to 20, which goes, and stays itself.
    with pytest.raises(deletes.Refused, match=r"d\.c_id refers to rows of c \(1 rows\)$"):
        deletes.deleted(diamond, "a", keys(spark, 1), restricted)
    tables = diamond | {"d": diamond["d"].where("id <> 32")}
    assert [r[0] for r in rows(deletes.deleted(tables, "a", keys(spark, 1), restricted))["d"]] == [33, 34]
    protected = DIAMOND | {("d", "c_id"): ("c", "id", PROTECT)}
    with pytest.raises(deletes.Refused, match=r"d\.c_id refers to rows of c"):
        deletes.deleted(tables, "a", keys(spark, 1), protected)
    assert len(rows(deletes.deleted(tables, "a", keys(spark, 3), protected))["c"]) == 2


def test_a_key_of_text(spark):
    graph = {("child", "code"): ("parent", "code", CASCADE), ("leaf", "child_id"): ("child", "id", CASCADE)}
    tables = {"parent": spark.createDataFrame([("x",), ("y",)], "code string"), "child": spark.createDataFrame([(1, "x"), (2, "y")], "id long, code string"), "leaf": spark.createDataFrame([(1,), (2,), (2,)], "child_id long")}
    out = rows(deletes.deleted(tables, "parent", spark.createDataFrame([("y",)], "code string"), graph))
    assert out == {"parent": [("x",)], "child": [(1, "x")], "leaf": [(1,)]}


def test_circles_are_an_error(spark, diamond):
    with pytest.raises(ValueError):
        deletes.deleted(diamond, "a", keys(spark, 1), DIAMOND | {("a", "id"): ("d", "id", CASCADE)})


def test_few_keys_move_no_large_table(spark, diamond):
    out = deletes.deleted(diamond, "a", keys(spark, 1), DIAMOND)
    for name in "bde":
        plan = out[name]._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_actions_do_not_grow_with_depth(spark):
    def actions(depth):
        graph = {(f"t{k + 1}", "up"): (f"t{k}", "id", CASCADE) for k in range(depth)} | {("guard", f"up{k}"): (f"t{k}", "id", PROTECT) for k in range(depth)}
        tables = {f"t{k}": spark.range(20).selectExpr("id", "id AS up") for k in range(depth + 1)}
        tables["guard"] = spark.range(20).selectExpr(*(f"id + 5 AS up{k}" for k in range(depth)))
        store = spark._jsparkSession.sharedState().statusStore()
        before = store.executionsCount()
        out = deletes.deleted(tables, "t0", spark.range(3), graph)
        taken = store.executionsCount() - before
        assert out[f"t{depth}"].count() == 17
        return taken

    assert actions(2) == actions(5) <= 2
