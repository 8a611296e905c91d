"""Scalar functions, episodes, titles and the full-text language on small cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import fts
from sparkloom.functions import release as R
from sparkloom.functions.episodes import episodes_of, has_episodes, parse_episodes, render_episodes
from sparkloom.functions.titles import family_key, is_pack, kana_to_romaji, normalize_title, numbered_title, parse_date, parse_title_year


@pytest.mark.parametrize(
    ("name", "want", "text"),
    [
        ("Show.S01E02.mkv", {1: [2]}, "S01E02"), ("Show S01E01-03", {1: [1, 2, 3]}, "S01E01-03"), ("Show S01E01E02", {1: [1, 2]}, "S01E01-02"), ("Show S01-S03 complete", {1: [], 2: [], 3: []}, "S01-03"),
        ("Show 1x02", {1: [2]}, "S01E02"), ("Show Season 4", {4: []}, "S04"), ("Show S2023E145", {2023: [145]}, "S2023E145"), ("Show S01E106 - 1080p", {1: [106]}, "S01E106"),
        ("Show S01E01,E03", {1: [1, 3]}, "S01E01,E03"), ("Show S01E01-E9999", {1: [1]}, "S01E01"), ("Film 1080p", None, ""), ("", None, ""), (None, None, ""),
    ],
)
def test_episodes(name, want, text):
    assert parse_episodes(name) == want and render_episodes(parse_episodes(name)) == text


def test_episode_maps(spark):
    df = spark.createDataFrame([("a S01E01-03",), ("b S02",), ("c",), (None,)], "n string").withColumn("e", episodes_of("n"))
    got = [tuple(r) for r in df.select(has_episodes(F.col("e"), 1, [1, 2]), has_episodes(F.col("e"), 2, [9]), has_episodes(F.col("e"), 1, [4])).collect()]
    assert got[0] == (True, False, False) and got[1] == (False, True, False) and not any(got[2]) and not any(got[3])


def test_titles():
    assert normalize_title("The Iron Man & Part II") == "iron man and 2" and normalize_title("ボキミ") == "bokimi" and family_key("L'été") == "lete" and normalize_title(None) == ""
    assert kana_to_romaji("ラッパ") == "rappa" and kana_to_romaji("シャー") == "shaa" and normalize_title("Тихая") == "tikhaia"
    assert parse_title_year("[Grp] My.Film.1999-2001.1080p-X")[:2] == ("My Film", 1999) and parse_title_year("Show S01E02")[0] == "Show" and parse_title_year("") is None
    assert parse_date("x 2020.02.29 y") == dt.date(2020, 2, 29) and parse_date("31-12-2019") == dt.date(2019, 12, 31) and parse_date("2 Dec 1955") == dt.date(1955, 12, 2) and parse_date("30.02.2019") is None and parse_date(None) is None


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("www.Some-Site.rsvp - Quiet Tide 2004 1080p", ("Quiet Tide", 2004)), ("www.site.org   Quiet Tide S01E09", ("Quiet Tide", None)), ("site.pics - [Tag] Quiet.Tide.2004", ("Quiet Tide", 2004)), ("Example.com Title 2001", ("Example com Title", 2001)),
        ("【发布 www.x.com】潮汐3 Quiet Tide 2004", ("Quiet Tide", 2004)), ("潮汐.2004.1080p", ("潮汐", 2004)), ("Quiet 潮汐 2004", ("Quiet 潮汐", 2004)), ("2019.The.Old.Bridge.1080p", ("The Old Bridge", 2019)), ("Quiet Tide (2004-present) 720p", ("Quiet Tide", 2004)), ("1984", ("1984", None)),
    ],
)
def test_titles_behind_noise(name, want):
    assert parse_title_year(name)[:2] == want


def test_packs_and_numbers():
    assert is_pack("The Bridge Trilogy 1980-1990") and is_pack("Complete.Movies 1080p") and is_pack("Old 12 movies") and not is_pack("The Bridge Collection S01") and not is_pack("Recollections") and not is_pack(None)
    assert numbered_title("Some.Tide.2024.EP12.1080p") == ("Some Tide", 2024) and numbered_title("[Grp] Tide EP1168v2") == ("Tide", None) and numbered_title("Band EP 2019") is None and numbered_title("x [1080p.EP001-151]") is None


def test_release(spark):
    names = [("A.B.2019.1080p.WEB-DL.x264-GRP.mkv",), ("A 2160p UHD HDR10+ DDP5.1 x265",), ("x264 and xvid",), ("plain",), ("",), (None,)]
    n = F.col("n")
    rows = spark.createDataFrame(names, "n string").select(R.video_resolution(n).alias("r"), R.video_source(n).alias("s"), R.video_codec(n).alias("c"), R.release_group(n).alias("g"), R.release_attributes(n).alias("a")).collect()
    assert (rows[0]["r"], rows[0]["s"], rows[0]["c"], rows[0]["g"]) == ("1080p", "WEBDL", "x264", "GRP")
    assert rows[1]["a"]["hdr_formats"] == ["HDR10_PLUS"] and rows[1]["a"]["audio_formats"] == ["EAC3"] and rows[1]["a"]["encoder"] == "x265"
    assert rows[2]["c"] is None and rows[3]["a"] is None and rows[4]["g"] is None and rows[5]["r"] is None


def test_features_and_keywords(spark):
    df = spark.createDataFrame([("Foo.720p.BluRay.H.264-ABC.mkv", ["udp://tracker.x.org:80/a", "x.org"], "mkv")], "n string, s array<string>, e string")
    got = df.select(R.release_features(F.col("n"), F.col("s"), F.col("e")).alias("f")).first()["f"]
    assert [(x["type"], x["value"]) for x in got] == [("codec", "x264"), ("extension", "mkv"), ("quality_tag", "bluray"), ("release_group", "abc"), ("resolution", "720p"), ("source", "x.org")]
    p = R.keyword_pattern("sound(track|s)?", "ost")
    hits = spark.createDataFrame([("a soundtrack",), ("ost",), ("hosting",), ("sound",)], "n string").select(F.col("n").rlike(p).alias("h")).collect()
    assert [r["h"] for r in hits] == [True, True, False, True]
    for bad in ("a)", "(a", "*a"):
        with pytest.raises(ValueError, match="keyword"):
            R.keyword_pattern(bad)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", None), ("lamp", "lamp"), ("lamp Post", "lamp & post"), ('"over the " . (river | brook) !bridge mist*', "over <-> the <-> (river | brook) & ! bridge & mist:*"),
        ('"over the river', "over <-> the <-> river"), ('"over the " . (river | brook', "over <-> the <-> (river | brook)"), ("тиха вода біжить", "tikha & voda & bizhit"), ("&ccedil;", "ccedil"),
    ],
)
def test_query_language(text, want):
    node = fts.parse_query(text)
    assert (None if node is None else str(node)) == want


def test_unspaced_scripts_are_single_lexemes():
    assert fts.tokenize_flat("水车 lamp") == ["水", "车", "lamp"] and [n.op for n in [fts.parse_query("水车")]] == ["then"]


def _brute(text: str, node) -> bool:
    words = fts.tokenize_flat(text or "")

    def ends(n):
        if n.op == "lexeme":
            return {i for i, w in enumerate(words) if (w.startswith(n.value) if n.prefix else w == n.value)}
        if n.op == "then":
            step = fts._first_len(n.right)
            return {i + step for i in ends(n.left)} & ends(n.right)
        if n.op == "or":
            return ends(n.left) | ends(n.right)
        return ends(n.left) | ends(n.right) if n.op == "and" and ends(n.left) and ends(n.right) else set()

    def true(n):
        if n.op == "not":
            return not true(n.left)
        if n.op == "and":
            return true(n.left) and true(n.right)
        if n.op == "or":
            return true(n.left) or true(n.right)
        return bool(ends(n))

    return true(node)


def test_match_against_brute_force(spark):
    texts = ["under the old bridge", "The bridge, under the sun", "old under bridge", "тихая река", "", None, "bridge " * 300, "a b a b c", "under the bridge under the bridge"]
    chunks = spark.createDataFrame([(i, 0, "D", t) for i, t in enumerate(texts)], "id long, chunk int, weight string, text string")
    posts = fts.postings(chunks)
    for q in ('"under the" . bridge', "bridge !old", "br* & (sun | old)", '"тихая река"', "tikh*", '"a b" . c', "missing", '"under the bridge"'):
        node = fts.parse_query(q)
        got = {r["id"] for r in fts.match(posts, node).collect()}
        assert got == {i for i, t in enumerate(texts) if _brute(t, node)}, q
    ranks = {r["id"]: r["rank"] for r in fts.cover_density(fts.match(posts, fts.parse_query("under bridge"))).collect()}
    assert ranks[8] > ranks[0] > 0
