"""Batch jobs: dry runs change nothing, steps go on behind a key, applied changes are those planned; late data in streams."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest

from sparkloom.jobs import PLANNED, REPORTS, Options, run
from sparkloom.streaming.pipelines import run_to_table, stream_files, tumbling_counts


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    T = dt.datetime(2025, 1, 1)
    names = [("a", "[Grp] Long River - 12 [1080p].mkv", 10), ("b", "Show.S01E02.720p.WEB-DL.x264-ABC.mkv", 20), ("c", "Film.2010.1080p.BluRay.x265-XYZ", 30), ("d", "Album FLAC", 40), ("e", None, 5)]
    spark.createDataFrame([(h, n, s, False, "single", None, 1, T, T) for h, n, s in names], "info_hash string, name string, size long, private boolean, files_status string, extension string, files_count int, created_at timestamp, updated_at timestamp").write.parquet(f"{root}/torrents.parquet")
    spark.createDataFrame([("d", 0, "01.flac", "flac", 40)], "info_hash string, file_index long, path string, extension string, size long").write.parquet(f"{root}/torrent_files.parquet")
    spark.createDataFrame([("dht", "a", 3, 1, None, T), ("tracker", "b", 0, 0, None, T)], "source string, info_hash string, seeders int, leechers int, published_at timestamp, updated_at timestamp").write.parquet(f"{root}/torrents_torrent_sources.parquet")
    spark.createDataFrame([("movie", "tmdb", "1", "Film", None, 2010)], "content_type string, content_source string, content_id string, title string, original_title string, release_year int").write.parquet(f"{root}/content.parquet")
    return root


SOURCE = json.dumps({"workflows": {"default": [{"if_else": {"condition": "torrent.files.map(f, f.extension in extensions.music ? f.size : -f.size).sum() > 0", "if_action": [{"set_content_type": "music"}, {"add_tag": "sound"}]}}]}, "extensions": {"music": ["flac"]}})


@pytest.mark.parametrize("name", sorted([*PLANNED, *REPORTS]))
def test_every_job_runs_dry(spark, tables, name):
    before = sorted(os.listdir(tables))
    told = run(spark, name, tables, o=Options(source=SOURCE, now="2025-01-02"))
    assert told["job"] == name and not told["applied"] and sorted(os.listdir(tables)) == before


def test_jobs_apply_in_steps(spark, tables, tmp_path):
    first = run(spark, "episodes-backfill", tables, str(tmp_path / "x"), Options(apply=True, limit=1))
    assert first["changes"] == {"episodes": 1} and first["last_key"] is not None
    rest = run(spark, "episodes-backfill", tables, o=Options(after=first["last_key"]))
    every = run(spark, "episodes-backfill", tables)
    assert every["changes"]["episodes"] == 1 + rest["changes"].get("episodes", 0)
    out = str(tmp_path / "y")
    run(spark, "process", tables, out, Options(apply=True, source=SOURCE))
    got = {r["info_hash"]: (r["content_type"], r["tags"]) for r in spark.read.parquet(f"{out}/torrents.parquet").collect()}
    assert got["d"] == ("music", "sound") and got["a"] == (None, "")
    for t in ("torrent_files", "content", "torrents_torrent_sources"):
        spark.read.parquet(f"{tables}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    gone = run(spark, "purge-content-types", out, str(tmp_path / "z"), Options(apply=True, types=("music",)))
    assert gone["removed"] == 1 and spark.read.parquet(f"{tmp_path}/z/torrents.parquet").count() == 4
    for bad in (lambda: run(spark, "nope", tables), lambda: run(spark, "process", tables), lambda: run(spark, "process", tables, o=Options(apply=True)), lambda: run(spark, "purge-content-types", tables), lambda: run(spark, "purge-content-types", tables, o=Options(types=("x",)))):
        with pytest.raises(ValueError):
            bad()


def test_late_rows_are_dropped_and_state_spans_files(spark, tmp_path):
    T = dt.datetime(2025, 1, 1)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    path = str(tmp_path / "in")
    for i, hours in enumerate(([0, 0, 1], [1, 9], [9], [0])):  # the last row is older than the watermark that the second file set
        spark.createDataFrame([(i, T + dt.timedelta(hours=h, minutes=i), 1, "view", 1.0, None) for h in hours], schema).coalesce(1).write.mode("append").parquet(path)
    rows = run_to_table(tumbling_counts(stream_files(spark, path, schema)), "update")
    best: dict = {}
    for r in rows.collect():
        best[r["window_start"]] = max(best.get(r["window_start"], (-1, 0)), (r["batch_id"], r["n"]))
    assert {(k - T).total_seconds() / 3600: n for k, (_, n) in best.items()} == {0.0: 2, 1.0: 2, 9.0: 2}
    assert rows.select("batch_id").distinct().count() >= 2
