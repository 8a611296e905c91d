"""Search plans, rule workflows, folds and streams against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import folds
from sparkloom.operators.analytics import nearest_rank, wilson
from sparkloom.operators.matching import best_matches
from sparkloom.plans.rules import Expression, ExpressionError, Scope, Workflow
from sparkloom.plans.search import Facet, JoinSpec, SearchPlan, all_of, any_of, exists_in, found_and_missing, hydrate_one, negate, one_of, recursive_closure, where


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "a", None), (4, None, 5), (5, "c", 20)], "id long, k string, v long")


def test_page_lookahead_and_empty_predicates(items):
    plan = SearchPlan(items).with_where(all_of(), any_of()).with_order(F.col("v").desc_nulls_last(), tie=("id",))
    first = plan.with_page(2).items().collect()
    assert [r["id"] for r in first] == [2, 5] and all(r["has_next_page"] for r in first)
    last = plan.with_page(2, page=3).items().collect()
    assert [r["id"] for r in last] == [3] and not last[0]["has_next_page"]
    assert plan.with_page(0).items().count() == 0 and plan.total().first()[0] == 5 and plan.exists() and plan.estimate() >= 0
    assert SearchPlan(items).with_where(one_of("id", [])).total().first()[0] == 0


def test_facets_ignore_their_own_filter(items):
    plan = SearchPlan(items).with_facets(Facet("k", F.col("k"), selected=("a", "zz")), Facet("v", F.col("v"), selected=(20,)))
    got = {(r["facet"], r["value"]): (r["n"], r["selected"]) for r in plan.facet_counts().collect()}
    assert got == {("k", "b"): (1, False), ("k", "c"): (1, False), ("k", "a"): (0, True), ("k", "zz"): (0, True), ("v", "10"): (1, False), ("v", None): (1, False), ("v", "20"): (0, True)}


def test_joins_semi_and_hydration(spark, items):
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert {r["id"] for r in SearchPlan(items).with_where(exists_in(keys, "k")).matches().collect()} == {1, 3}
    assert {r["id"] for r in SearchPlan(items).with_where(negate(exists_in(keys, "k"))).matches().collect()} == {2, 4, 5}
    with pytest.raises(KeyError):
        SearchPlan(items).with_where(where(F.col("x") > 1, "nope")).matches()
    plan = SearchPlan(items).with_join("never", JoinSpec(keys, ("k",)))
    assert plan.required() == [] and plan.matches().count() == 5
    with pytest.raises(Exception, match="no sub"):
        hydrate_one(items, spark.createDataFrame([("a", 1)], "k string, x int"), "k", "sub", must=True).collect()
    wanted = spark.createDataFrame([(1, "a"), (2, "z"), (3, "a")], "position long, k string")
    assert sorted(tuple(r) for r in found_and_missing(wanted, items, "k").collect()) == [(1, "a", True), (2, "z", False)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    assert recursive_closure(edges, "a", "b").count() == 9


def test_expressions_and_workflows(spark):
    df = spark.createDataFrame([(["mkv", "srt"], [5.0, 1.0], "x"), ([], [], None)], "e array<string>, s array<double>, n string")
    scope = Scope({"t.e": F.col("e"), "t.s": F.col("s"), "t.n": F.col("n")}, {"ext.video": ["mkv"]}, {"kw.x": "^x$"})
    cases = {"t.s.sum() > 5": (True, False), "t.e.filter(x, x in ext.video).size() == 1": (True, False), "t.s.isSorted()": (False, True), "t.e.indexOf('srt')": (1, -1), "t.e.lastIndexOf('q')": (-1, -1), "t.n.matches(kw.x) || !(1 < 2)": (True, None), "t.n == null ? 1 : 2 kb": (2000, 1), "t.s.map(x, x + 1).exists(y, y == 6)": (True, False), "-1 + 2 * 3": (5, 5)}
    for text, want in cases.items():
        assert tuple(r[0] for r in df.select(Expression(text, scope).compile()).collect()) == want, text
    for bad in ("t.nope", "1 +", "t.e.what()", "#"):
        with pytest.raises(ExpressionError):
            Expression(bad, scope).compile()
    w = Workflow({"default": [{"find_match": ["unmatched", {"if_else": {"condition": "t.e.size() > 0", "if_action": {"set_content_type": "v"}, "else_action": "unmatched"}}]}, {"add_tag": "t"}, {"if_else": {"condition": "t.n == 'x'", "if_action": "delete"}}, {"add_tag": "never"}]}, scope)
    got = [(r["content_type"], r["tags"], r["deleted"]) for r in w.apply(df).collect()]
    assert got == [("v", ["t"], True), (None, ["t", "never"], False)]
    with pytest.raises(ExpressionError):
        Workflow({"default": [{"run_workflow": "default"}]}, scope).columns()


def _replay(rows, hours=4, least=2):
    n, first, dead = 0, None, False
    for at, kind in rows:
        if kind == "alive":
            n, first, dead = 0, None, False
        else:
            n, first = n + 1, first or at
            dead = dead or n >= least and at - first >= dt.timedelta(hours=hours)
    return "dead" if dead else "suspect" if n else "alive"


def test_liveness_against_replay(spark):
    rnd = random.Random(5)
    events = [(k, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 3000)), rnd.choice(["alive", "suspect", "suspect", "noise"])) for k in range(40) for i in range(12)]
    df = spark.createDataFrame(rnd.sample(events, len(events)), "k long, i long, at timestamp, kind string")
    got = {r["k"]: r["status"] for r in folds.suspicion_runs(df, "k", "at", ["at", "i"], F.col("kind") == "alive", F.col("kind") == "suspect").collect()}
    want = {k: _replay([(at, kind) for kk, i, at, kind in sorted(events, key=lambda e: (e[2], e[1])) if kk == k and kind != "noise"]) for k in range(40)}
    assert got == {k: v for k, v in want.items() if k in got} and len(got) >= 39


def test_backoff_votes_and_merge(spark):
    ev = [(1, 1, False, "x"), (1, 2, False, "x"), (1, 3, False, "y"), (2, 1, False, "x"), (2, 2, True, None), (3, 1, False, None)]
    out = {r["k"]: (r["failures"], r["wait_seconds"]) for r in folds.backoff_fold(spark.createDataFrame(ev, "k long, i long, ok boolean, why string"), "k", ["i"], "ok", "why").collect()}
    assert out == {1: (1, 60), 2: (0, 0), 3: (1, 60)}
    votes = [(i, g, v) for i, (g, v) in enumerate([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", None), ("a", "x")])]
    df = spark.createDataFrame(votes, "i long, g string, v string")
    assert [tuple(r) for r in folds.majority(df, "g", "v").collect()] == [("a", "x", 3, 4)]
    assert {r["i"]: r["elected"] for r in folds.leave_one_out(df, "i", "g", "v").collect()} == {0: "x", 1: "x", 2: "x", 6: "x"}
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k long, v string, at long")
    new = spark.createDataFrame([(1, "n", 5), (2, "old", 1), (3, "c", 1)], "k long, v string, at long")
    assert {r["k"]: r["v"] for r in folds.merge_latest(old, new, ["k"], "at").collect()} == {1: "n", 2: "b", 3: "c"}


def test_intervals_ranks_and_matching(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 10.0)], "k double, n double")
    low, high = wilson(F.col("k"), F.col("n"))
    got = [tuple(round(x, 3) for x in r) for r in df.select(low, high).collect()]
    assert got[0] == (0.0, 1.0) and got[1] == (0.237, 0.763)
    v = spark.createDataFrame([("a", float(x)) for x in range(1, 11)], "g string, v double")
    assert nearest_rank(v, ["g"], "v", 0.95).first()["at_rank"] == 10
    left = spark.createDataFrame([("l1", "The Iron Bridge", 1990), ("l2", "Quiet Rver", None), ("l3", "", 1990), ("l4", None, 1)], "l_id string, title string, year int")
    right = spark.createDataFrame([("r1", "The Iron Bridge", 1991), ("r2", "The Iron Bridge", 1980), ("r3", "Quiet River", 2000)], "r_id string, title string, year int")
    assert {(r["l_id"], r["r_id"]) for r in best_matches(left, right).collect()} == {("l1", "r1"), ("l2", "r3")}
