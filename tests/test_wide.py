"""Attribute rows to wide tables: spellings, conflicts, nulls, odd values, clashing columns, empty tables, a hot entity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sparkloom.operators.wide import attributes_to_wide, wide_cells

SCHEMA = "content_type string, content_source string, content_id string, attr_source string, attr_key string, attr_value string, created_at timestamp, updated_at timestamp"
T = [dt.datetime(2024, 1, d) for d in range(1, 9)]


def rows(*cells):
    return [("movie", "tmdb", i, s, k, v, T[0], t) for i, s, k, v, t in cells]


def wide_of(spark, *cells):
    return {r["content_id"]: r.asDict() for r in attributes_to_wide(spark.createDataFrame(rows(*cells), SCHEMA)).collect()}


def test_spellings_and_types(spark):
    out = wide_of(
        spark,
        ("1", "imdb", " id", " TT00012 ", T[0]), ("1", "tvdb", "ID", "77", T[0]), ("1", "tmdb", "posterPath", "/a.jpg", T[0]), ("1", "tmdb", "Poster Path", "nope", T[5]),
        ("1", "tmdb", "RUNTIME", "PT1H18M", T[0]), ("1", "tmdb", "vote-average", "7,9", T[0]), ("1", "tmdb", "voteCount", "4,780", T[0]), ("1", "tmdb", "adult", "N", T[0]),
        ("1", "tmdb", "season_count", "x", T[0]), ("1", "tmdb", "releaseDate", "October 21, 1968", T[0]), ("1", "tmdb", "id", "9", T[0]),
    )["1"]
    assert out["imdb_id"] == "tt00012" and out["tvdb_id"] == 77 and out["poster_path"] == "/a.jpg" and out["backdrop_path"] is None
    assert out["runtime"] == 78 and out["vote_average"] == 7.9 and out["vote_count"] == 4780 and out["adult"] is False
    assert out["season_count"] is None and out["release_date"] == dt.date(1968, 10, 21)


def test_readings(spark):
    cases = {"74": 74, "82 min": 82, "3h 7m": 187, " 27 ": 27, "-- min": None, "": None, "feature length": None, "99999999999": None}
    out = wide_of(spark, *[(str(i), "tmdb", "runtime", v, T[0]) for i, v in enumerate(cases)])
    assert [out[str(i)]["runtime"] for i in range(len(cases))] == list(cases.values())
    dates = {"13.08.2023": dt.date(2023, 8, 13), "20090502": dt.date(2009, 5, 2), "2 Dec 1955": dt.date(1955, 12, 2), "1969-09-27T00:00:00Z": dt.date(1969, 9, 27), "2023-02-30": None, "31.02.2020": None, None: None}
    out = wide_of(spark, *[(str(i), "tmdb", "release_date", v, T[0]) for i, v in enumerate(dates)])
    assert [out[str(i)]["release_date"] for i in range(len(dates))] == list(dates.values())


def test_latest_readable_wins_and_ties(spark):
    out = wide_of(spark, ("1", "tmdb", "runtime", "90", T[1]), ("1", "tmdb", "runtime", "95", T[3]), ("1", "tmdb", "runtime", "unknown", T[5]), ("2", "tmdb", "runtime", "10", T[1]), ("2", "tmdb", "runtime", "20", T[1]), ("2", "tmdb", "runtime", "20", T[1]))
    assert out["1"]["runtime"] == 95 and out["2"]["runtime"] == 20


def test_unknown_attributes_keep_entities_and_nulls_are_entities(spark):
    out = wide_of(spark, ("1", "tmdb", "alt_title:de:1", "x", T[0]), (None, "tmdb", "runtime", "5", T[0]), ("3", None, None, None, T[0]))
    assert set(out) == {"1", None, "3"} and out["1"]["runtime"] is None and out[None]["runtime"] == 5


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert attributes_to_wide(empty).count() == 0
    df = spark.createDataFrame(rows(("1", "tmdb", "runtime", "5", T[0])), SCHEMA).withColumn("position", F.lit(3)).withColumn("text", F.lit("t")).withColumn("_key", F.lit("k")).withColumn("_value", F.lit(1))
    assert [r["runtime"] for r in attributes_to_wide(df).collect()] == [5]


def test_hot_entity_and_long_value(spark):
    df = spark.range(5000).select(*[F.lit(x).alias(n) for n, x in (("content_type", "movie"), ("content_source", "tmdb"), ("content_id", "1"), ("attr_source", "tmdb"), ("attr_key", "vote_count"))], F.col("id").cast("string").alias("attr_value"), F.lit(T[0]).alias("created_at"), (F.lit(T[0]).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))).alias("updated_at"))
    long = spark.createDataFrame(rows(("2", "tmdb", "poster_path", "/" + "x" * 100_000, T[0])), SCHEMA)
    out = {r["content_id"]: r for r in attributes_to_wide(df.unionByName(long)).collect()}
    assert out["1"]["vote_count"] == 4999 and len(out["2"]["poster_path"]) == 100_001


def test_cells(spark):
    df = spark.createDataFrame(rows(("1", "tmdb", "runtime", "5", T[0]), ("1", "tmdb", "adult", "maybe", T[0]), ("1", "imdb", "id", "tt1", T[0])), SCHEMA)
    assert {r["attribute"] for r in wide_cells(attributes_to_wide(df)).collect()} == {"runtime", "imdb_id"}
