"""Evaluation, snapshots, naming, sources and streams on small cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.naming import bracket_marks, file_search_strings, search_strings, wanted_key
from sparkloom.operators.evaluation import cluster_bootstrap, exact_mcnemar, paired_comparison, scores, weighted_rules
from sparkloom.operators.snapshots import apply_changes, plan_changes, remove_with_snapshot, restore
from sparkloom.sources.readers import alias_table, import_items, read_hash_feed, read_ndjson, write_ndjson
from sparkloom.streaming.pipelines import EVENTS, failure_runs, first_seen, run_to_table


def test_mcnemar_and_scores(spark):
    assert exact_mcnemar(0, 0) == 1 and exact_mcnemar(5, 0) == pytest.approx(0.0625) and exact_mcnemar(3, 3) == 1 and 0 < exact_mcnemar(900, 1100) < 1e-4
    df = spark.createDataFrame([("a", True, True), ("a", True, False), ("a", False, True), ("b", None, True)], "g string, t boolean, s boolean")
    got = {r["g"]: (r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["recall"]) for r in scores(df, ["g"], F.col("t"), F.col("s")).collect()}
    assert got == {"a": (1, 1, 1, 0, 0.5, 0.5), "b": (0, 1, 0, 0, 0.0, None)}
    p = paired_comparison(df.na.fill(False), ["g"], F.col("t"), F.col("s")).filter("g = 'a'").first()
    assert (p["only_a"], p["only_b"], p["p_value"]) == (1, 1, 1.0)


def test_bootstrap_is_stable_and_covers(spark):
    df = spark.range(400).select((F.col("id") % 80).alias("c"), ((F.col("id") % 80) % 4 == 0).cast("double").alias("v"))
    a, b = (cluster_bootstrap(df.repartition(n), "c", F.col("v")).first() for n in (1, 5))
    assert a == b and a["estimate"] == 0.25 and a["low"] < 0.25 < a["high"]
    assert cluster_bootstrap(df.limit(0), "c", F.col("v")).first()["estimate"] is None


def test_rules_and_names(spark):
    df = spark.createDataFrame([("good web",), ("bad",), (None,)], "n string")
    assert [r["q"] for r in weighted_rules(df, F.col("n"), [("q", "good", 1.0), ("q", "web", 0.5), ("q", "bad", -2.0)]).collect()] == [1.5, -2.0, 0.0]
    assert wanted_key("The.Show.S02E03.1080p-X") == "tv:the-show:s02" and wanted_key("A Film 1999 720p") == "mv:a-film:1999" and wanted_key("Band - Album 2001 FLAC") == "ms:band-album" and wanted_key("") is None and wanted_key(None) is None
    m = spark.createDataFrame([("[Grp] Show - 105 [Dual Audio] [Batch]",), ("Show 2010",), (None,)], "n string").select(bracket_marks(F.col("n")).alias("m")).collect()
    assert m[0]["m"].asDict() == {"group": "Grp", "absolute_episode": 105, "dual_audio": True, "batch": True} and m[1]["m"]["group"] is None
    assert search_strings(["Show/Show one.mkv", "Show/Show two.mkv"]) == "Show/Show one two" and search_strings([]) == ""
    f = spark.createDataFrame([("a", 1, "x y.mkv"), ("a", 0, "x z.mkv"), ("b", 0, None)], "k string, i long, p string")
    assert {r["k"]: r["text"] for r in file_search_strings(f, "k", "i", "p").collect()} == {"a": "x z y", "b": ""}


def test_snapshots(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, None, 6), (3, "c", None)], "k long, s string, n int")
    journal = plan_changes(rows, "k", s=F.coalesce("s", F.lit("new")), n=F.col("n") + 1)
    assert {(r["k"], r["field"], r["old"], r["new"]) for r in journal.collect()} == {(1, "n", "5", "6"), (2, "s", None, "new"), (2, "n", "6", "7")}
    after = apply_changes(rows, "k", journal)
    assert {tuple(r) for r in after.collect()} == {(1, "a", 6), (2, "new", 7), (3, "c", None)}
    moved = after.withColumn("n", F.when(F.col("k") == 1, 99).otherwise(F.col("n")))
    assert {tuple(r) for r in apply_changes(moved, "k", journal, back=True).collect()} == {(1, "a", 99), (2, None, 6), (3, "c", None)}
    stay, snap = remove_with_snapshot(rows, "k", rows.filter("k < 3"), "x", {"kids": spark.createDataFrame([(1, "q")], "k long, v string")})
    assert stay.count() == 1 and snap.filter("kids is not null").count() == 1
    assert {tuple(r) for r in restore(stay.unionByName(spark.createDataFrame([(1, "mine", 0)], rows.schema)), "k", snap).collect()} == {(3, "c", None), (1, "mine", 0), (2, None, 6)}


def test_sources(spark, tmp_path):
    items = spark.createDataFrame([("h1", "n1", 5, "dht", 1), ("h1", "n1", 5, "web", None)], "infoHash string, name string, size long, source string, seeders int").withColumn("leechers", F.lit(0))
    write_ndjson(items, str(tmp_path / "a"))
    (tmp_path / "a" / "part-x.txt").write_text("not json\n")
    back = read_ndjson(spark, str(tmp_path / "a"), "i1").cache()
    assert back.filter("_corrupt is null").count() == 2 and back.filter("_corrupt is not null").count() == 1 and {r["import_id"] for r in back.collect()} == {"i1"}
    h = "ab" * 32
    (tmp_path / "feed").write_text(f"# c\n{h.upper()}  # x\n{h}\nzz\n\n")
    assert [r["hash"] for r in read_hash_feed(spark, str(tmp_path / "feed")).collect()] == [h]
    t = spark.createDataFrame([("h1", "old", 1)], "info_hash string, name string, size long")
    links = spark.createDataFrame([("dht", "h1", 9, 9, dt.datetime(2020, 1, 1)), ("x", "h2", 1, 1, dt.datetime(2020, 1, 1))], "source string, info_hash string, seeders int, leechers int, updated_at timestamp")
    torrents, merged = import_items(t, links, items)
    assert {tuple(r) for r in torrents.collect()} == {("h1", "old", 1)}
    assert {(r["source"], r["info_hash"], r["seeders"]) for r in merged.collect()} == {("dht", "h1", 1), ("web", "h1", None), ("x", "h2", 1)}
    a = alias_table(spark.createDataFrame([("1", "A b"), ("2", "a B"), ("3", "")], "work_id string, title string"), spark.createDataFrame([("1", "r2"), ("2", "r1"), ("3", "r3")], "work_id string, ref string"), F.lower)
    assert [tuple(r) for r in a.collect()] == [("a b", "r1")]


def test_streams_over_several_batches(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i % 2, "error" if i % 5 else "purchase", 1.0, None) for i in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    got = run_to_table(failure_runs(stream()), "update").groupBy("user_id").agg(F.max_by("events", "batch_id").alias("n"), F.max_by("failures", "batch_id").alias("f"))
    want = {u: sum(1 for _ in g) for u, g in ((u, [r for r in rows if r[2] == u]) for u in (0, 1))}
    assert {r["user_id"]: r["n"] for r in got.collect()} == want
    assert run_to_table(first_seen(stream(), ["user_id"]), "append").count() == 2
