"""Attempts, swarms, filter lists, vectors, date spans, collections, processors and quarantine on small cases."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import fts
from sparkloom.operators.analytics import swarm_sizes
from sparkloom.operators.evaluation import filter_list, weighted_verdict
from sparkloom.operators.folds import resolve_attempts, stable_rank
from sparkloom.operators.snapshots import expire_quarantine, quarantine_page
from sparkloom.plans.processors import ContractError, Processor, process
from sparkloom.plans.request import in_collections, month_range, released_in, year_range

T = dt.datetime(2025, 1, 1)
DAY = dt.timedelta(days=1)


def test_attempts(spark):
    grabs = spark.createDataFrame([("a", T, ["x", "y"]), ("a", T + DAY, ["x"]), ("a", T + 5 * DAY, ["z"]), ("b", T, ["x", "x"]), ("b", T + DAY, ["w"]), ("c", T + 9 * DAY, ["x"])], "key string, at timestamp, features array<string>")
    imports = spark.createDataFrame([("a", T + DAY), ("a", T + 2 * DAY), ("d", T)], "key string, at timestamp")
    got = sorted((r["key"], r["success"], sorted(r["features"])) for r in resolve_attempts(grabs, imports, F.lit(T + 10 * DAY).cast("timestamp"), 4).collect())
    assert got == [("a", False, ["z"]), ("a", True, ["x", "y"]), ("b", False, ["w", "x"])]
    items = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3), ("s", 4)], "k string, i int")
    ranked = stable_rank(items, spark.createDataFrame([("r", 2.0), ("s", 2.0), ("p", 1.0)], "k string, score double"), "k", "i")
    assert {r["k"]: r["rank"] for r in ranked.collect()} == {"r": 1, "s": 2, "p": 3, "q": 4}


def test_swarm_sizes_are_close_and_merge(spark):
    df = spark.range(600).selectExpr("id % 2 AS g", "cast(id AS string) AS p")
    got = {r["g"]: r["size"] for r in swarm_sizes(df.unionByName(df), "g", F.col("p")).collect()}
    assert all(abs(v - 300) < 30 for v in got.values()) and swarm_sizes(df.limit(0), "g", F.col("p")).count() == 0


def test_filter_lists_and_thresholds(spark):
    df = spark.createDataFrame([("ok", 9, ["mkv"], ["a"], "G"), ("bad ok", 9, ["mkv"], ["a"], "G"), ("x", 1, [], [], None), ("x", 99, [], [], None), ("x", 9, [".EXE"], [], None), ("x", 9, [], [], " g2"), ("bad", 9, [], [], None), ("x", 9, [], ["in/bad"], None), (None, None, None, None, None)], "n string, s int, e array<string>, p array<string>, g string")
    reason = filter_list(df, F.col("n"), F.col("s"), F.col("e"), F.col("p"), F.trim(F.col("g")), ["^bad ok$"], 5, 50, ["exe"], ["G2 "], ["bad"])
    assert [r[0] for r in df.select(reason).collect()] == [None, None, "below_min_size", "above_max_size", "blocked_extension", "blocked_release_group", "block_pattern_matched", "block_file_pattern_matched", None]
    out = weighted_verdict(df.limit(2), F.col("n"), [("q", "bad", 0.6), ("q", "ok", 0.3), ("r", "ok", 1.0)], {"q": 0.8, "r": 1.5}, {"ok": 0.5}).collect()
    assert [r["excluded_by"] for r in out] == ["q", "q"]


def test_vectors_round_trip(spark):
    rows = [(1, "it's", 3, "A"), (1, "it's", 9, "D"), (1, "b\\\\c", 1, "B"), (2, "x", 1, "D")]
    posts = spark.createDataFrame(rows, "id long, lexeme string, pos int, weight string")
    text = {r["id"]: r["vector"] for r in fts.print_vectors(posts).collect()}
    assert text[2] == "'x':1" and "'it''s':3A,9" in text[1]
    back = fts.parse_vectors(fts.print_vectors(posts))
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    assert [tuple(r) for r in fts.parse_vectors(spark.createDataFrame([(1, "word:2C")], "id long, vector string")).collect()] == [(1, "word", 2, "C")]
    t = spark.createDataFrame([("h", "My Film", ["1080p"], None)], "info_hash string, name string, video array<string>, files string")
    assert {(r["lexeme"], r["weight"]) for r in fts.postings(fts.torrent_chunks(t)).collect()} == {("h", "A"), ("my", "A"), ("film", "A"), ("1080p", "C")}


def test_spans_and_collections(spark):
    assert month_range(2024, 12) == (dt.date(2024, 12, 1), dt.date(2025, 1, 1)) and month_range(2024, 2)[1] == dt.date(2024, 3, 1) and year_range(2000, 1) == (dt.date(1999, 1, 1), dt.date(2002, 1, 1))
    df = spark.createDataFrame([("m", "s", "1", dt.date(2024, 2, 29)), ("m", "s", "2", dt.date(2024, 3, 1)), ("m", None, None, None)], "content_type string, content_source string, content_id string, release_date date")
    assert [r["content_id"] for r in released_in(month_range(2024, 2)).apply(df).collect()] == ["1"]
    members = spark.createDataFrame([("m", "s", "2", "genre", "x", "9"), ("m", None, None, "genre", "x", "9")], "content_type string, content_source string, content_id string, collection_type string, collection_source string, collection_id string")
    assert [r["content_id"] for r in in_collections([("genre", "x", "9"), ("genre", "x", "8")], members).apply(df).collect()] == ["2"] and in_collections([], members).apply(df).count() == 0


def test_processors_keep_their_contract(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["good", "bad", "odd", "list", "none", None])], "id long, name string")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        made = {"good": ("completed", '{"tag": 1}', ["r"]), "bad": ("nope", None, []), "odd": ("completed", "{", []), "list": ("completed", "[]", []), "none": ("completed", None, None)}
        rows = [made.get(n, ("abstained", None, None)) for n in b["name"]]
        return pd.DataFrame(rows, columns=["outcome", "proposal", "reasons"])

    got = {r["id"]: (r["outcome"], r["reasons"]) for r in process(df, "id", Processor("p", "1", ("name",), run), batch=2).collect()}
    assert got == {0: ("completed", ["r"]), 1: ("failed", ["unknown_outcome"]), 2: ("failed", ["proposal_is_no_json"]), 3: ("failed", ["proposal_is_no_object"]), 4: ("failed", ["completed_without_proposal"]), 5: ("abstained", [])}
    for broken, why in ((lambda b: b[:0], "no_result_columns"), (lambda b: run(b)[:0], "result_count_differs"), (lambda b: 1 / 0, "ZeroDivisionError")):
        assert {tuple(r["reasons"]) for r in process(df, "id", Processor("p", "1", ("name",), broken)).collect()} == {(why,)}
    with pytest.raises(ContractError):
        Processor("", "1", ("name",), run)
    with pytest.raises(ContractError):
        process(df, "id", Processor("p", "1", ("nope",), run))


def test_quarantine_steps(spark):
    state = spark.createDataFrame([("a", T, None, "{}"), ("b", T + DAY, None, "{}"), ("c", T + 9 * DAY, None, "{}"), ("d", T, T, None)], "info_hash string, quarantined_at timestamp, expired_at timestamp, torrent_snapshot string")
    out = {r["info_hash"]: (r["expired_at"] is not None, r["torrent_snapshot"]) for r in expire_quarantine(state, F.lit(T + 10 * DAY).cast("timestamp"), 3, 1, "info_hash").collect()}
    assert out == {"a": (True, None), "b": (False, "{}"), "c": (False, "{}"), "d": (True, None)}
    assert [tuple(r) for r in quarantine_page(state, state.limit(0), "info_hash", 2, "a").collect()] == [("b", "live"), ("c", "live")]
