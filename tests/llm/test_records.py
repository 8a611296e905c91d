"""Linkage, set membership, leakage, mixing and quality on small cases and against brute force."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm.golomb import SeenBefore, decode_gaps, encode_gaps, full_hash
from sparkloom.llm.linkage import link_names, parse_mention, solve_hinges
from sparkloom.llm.mixing import mix, mix_shares, token_counts
from sparkloom.llm.quality import STATISTICS, not_prose, outlier_scores, tail_probabilities, text_statistics
from sparkloom.llm.winnowing import aligned_pairs, best_alignment, leaked_passages

WORK = "content_type string, content_source string, content_id string, title string, original_title string, release_year int, popularity double, updated_at timestamp"
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
WORKS = [
    ("movie", "tmdb", "1", "The Iron Kobalen", "Das eiserne Kobalen", 1990, 5.0, T1), ("movie", "tmdb", "1", "Old title", None, 1950, 1.0, T0), ("movie", "tmdb", "2", "The Iron Kobalen 2", None, 1995, 5.0, T0),
    ("tv_show", "tvdb", "3", "The Iron Kobalen", None, 2001, 1.0, T0), ("movie", "tmdb", "4", "The Iron Kobalen", None, 2015, 2.0, T0), ("movie", "tmdb", "5", "Zumolar & the Tide", "Зумола и зима", None, None, T0), ("movie", "tmdb", "6", None, None, None, None, None),
]


def test_linkage(spark):
    names = {
        "a": ("Iron.Kobalen.The.1991.720p.x264-GRP.mkv", "1"), "b": ("The Iron Kobalen Part II 1995 1080p", "2"), "c": ("The.Iron.Kobalen.S01E02.720p", "3"), "d": ("The Iron Kobalen 2014 DVDRip", "4"), "e": ("The Iron Kobalen 2003 720p", None),
        "f": ("Zumolar and the Tide / Зумола и зима 1080p", "5"), "g": ("Zumolar & the Tdie 720p", "5"), "h": ("The Iron Kobalen 1990 OST FLAC", None), "i": ("Das.eiserne.Kobalen.1990.mkv", "1"), "j": ("Zumolar.Tide.v1.2.3.Win", None), "k": (None, None), "l": ("", None),
        "m": ("The Iron Kobalen 3 1990 720p", None), "n": ("Iron.Kobalen.The.1991.720p.x264-GRP.mkv", "1"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in names.items()], "info_hash string, text string")
    rows = link_names(df, spark.createDataFrame(WORKS, WORK)).collect()
    assert {r["info_hash"]: r["content_id"] for r in rows} == {k: v[1] for k, v in names.items() if v[1]}
    assert all(0 < r["confidence"] <= 1 for r in rows)
    empty = spark.createDataFrame([], "info_hash string, text string")
    assert link_names(empty, spark.createDataFrame(WORKS, WORK)).count() == 0 and link_names(df, spark.createDataFrame([], WORK)).count() == 0


def test_mentions():
    assert parse_mention("Foo 2 (2010) [1080p]") == ("movie", 2010, ["FOO2"]) and parse_mention("Foo S01 720p")[0] == "tv_show" and parse_mention("Foo 2010 MP3")[0] == ""


def test_solver_finds_the_minimum(spark):
    # 4 max(0, .9 - x)^2 + 4 max(0, .8 - y)^2 + 8 max(0, x + y - 1) has its minimum at (.55, .45)
    rows = [("s1", "x", -1.0, 0.9, 4.0, True), ("s2", "y", -1.0, 0.8, 4.0, True), ("e", "x", 1.0, -1.0, 8.0, False), ("e", "y", 1.0, -1.0, 8.0, False)]
    got = {r["v"]: r["truth"] for r in solve_hinges(spark.createDataFrame(rows, "pid string, v string, a double, b double, weight double, square boolean"), rounds=40).collect()}
    assert got == {"x": pytest.approx(0.55, abs=0.02), "y": pytest.approx(0.45, abs=0.02)}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**30), min_size=1, max_size=300), st.integers(1, 20))
def test_gap_code_round_trip(values, rice):
    v = np.array(sorted(values), dtype=np.int64)
    if (np.diff(v, prepend=0) >> rice).sum() < 2_000_000:
        assert decode_gaps(encode_gaps(v, rice), len(v), rice).tolist() == v.tolist()


def test_hash_spellings(spark):
    h = "943c31338db9cf9b8a9d41d5ca9a3c0d4f38eda5"
    import base64

    b32 = base64.b32encode(bytes.fromhex(h)).decode()
    good = [h, f"{h}\n", h.upper(), f"urn:btih:{h}", f"0x{h}", f" {h}\n", f"\t{h} ", b32, b32.lower(), f"urn:btih:{b32}", f"magnet:?xt=urn:btih:{h}&dn=x"]
    bad = [None, "", "-", "unknown", h[:20], h + "ab", "0x", "z" * 40, "1" * 32]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string").select(full_hash(F.col("t")).alias("h"))
    assert [r["h"] for r in df.collect()] == [h] * len(good) + [None] * len(bad)


def test_seen_before_is_exact(spark):
    rnd = random.Random(1)
    keys = [f"{rnd.getrandbits(160):040x}" for _ in range(400)]
    hot = keys[0]
    rows = [(i, hot if rnd.random() < 0.33 else rnd.choice(keys) if rnd.random() < 0.9 else None) for i in range(3000)]
    known = keys[300:]
    seen, want = set(known), set()
    for i, h in rows:
        if h is not None:
            if h in seen:
                want.add(i)
            seen.add(h)
    df = spark.createDataFrame(rows, "id long, hash string")
    s = SeenBefore(df, spark.createDataFrame([(k,) for k in known + known[:3]], "hash string"), epochs=4, precision=2, block_keys=50)
    assert {r["id"] for r in s.seen().collect()} == want
    r = s.rates().first()
    assert r["hits"] == r["confirmed"] + r["wrong"] and 0 < r["theoretical_rate"] < 1 and r["bits_per_key"] > 0
    none = SeenBefore(spark.createDataFrame([], "id long, hash string"), spark.createDataFrame([], "hash string"))
    assert none.seen().count() == 0 and none.rates().first()["probes"] == 0


def test_alignment():
    a = list(range(20))
    assert best_alignment(a, [-1, *a, -1]) == (20, 20) and best_alignment(a, a[:5]) == (5, 5) and best_alignment(a, [-1, -1]) == (0, 0)
    assert best_alignment(a, [*a[:8], -1, *a[9:]]) == (18, 20) and best_alignment(a, [*a[:8], *a[9:]]) == (18, 20)


def test_leaks_against_brute_force(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(words, k=40))) for i in range(5)]
    docs, want = [], set()
    for d in range(60):
        body = rnd.choices(words, k=60)
        if d % 3 == 0:
            it = rnd.randrange(5)
            src = items[it][1].split()
            at = rnd.randrange(20)
            part = src[at : at + rnd.randint(16, 20)]
            part[7] = "changed"
            body[30:30] = part
            want.add((d, it))
        elif d % 3 == 1:
            body[30:30] = items[d % 5][1].split()[3:9]
        docs.append((d, "\n".join(w.upper() + "," for w in body)))
    docs += [(100, None), (101, ""), (102, "one two"), (0, docs[0][1])]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (9, None), (10, "")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaked_passages(df, it).collect()} == want
    assert aligned_pairs(df, it).count() >= len(want)
    assert leaked_passages(spark.createDataFrame([], "doc_id long, text string"), it).count() == 0
    long = spark.createDataFrame([(7, "x " * 50_000 + items[0][1])], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in leaked_passages(long, it).collect()] == [(7, 0)]


def test_mix_meets_shares(spark):
    rnd = random.Random(4)
    docs = [(i, "big" if i % 3 else "small", "some words " * rnd.randint(1, 40)) for i in range(900)] + [(1000, None, "x"), (1001, "other", "x"), (1002, "big", None), (1003, "big", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    chosen = mix(df, targets).collect()
    use = {r["doc_id"]: r["times"] for r in chosen}
    assert set(use) <= set(range(900)) and max(t for d, t in use.items() if d % 3) == 1 and max(use.values()) <= 3
    shares = {r["source"]: r for r in mix_shares(mix(df, targets), targets).collect()}
    assert shares["big"]["actual_share"] == pytest.approx(0.5, abs=0.005) and shares["small"]["most_repeats"] in (2, 3)
    tokens = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert tokens[1002] == 0 and tokens[0] > 0
    small = {r["source"]: r["n_tokens"] for r in mix_shares(mix(df, targets, total_tokens=2000), targets).collect()}
    assert all(abs(v - 1000) <= 100 for v in small.values())
    assert mix(spark.createDataFrame([], df.schema), targets).count() == 0


def test_statistics_and_exact_tails(spark):
    docs = [(1, "The cat sat on the mat. It was a good day.", "en"), (2, "- one\n- two\n- three", "EN"), (3, None, None), (4, "", "xx"), (5, "a|b|c\n1|2|3", "eng"), (6, "a|b|c\n1|2|3", "de")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, lang string, ws string")
    stats = text_statistics(df)
    rows = {r["doc_id"]: r for r in stats.collect()}
    assert rows[1]["n_words"] == 11 and rows[1]["end_mark_line_share"] == 1 and rows[2]["bullet_line_share"] == 1 and rows[3]["n_words"] == 0 and rows[4]["language"] == "und" and rows[5]["language"] == "en"
    got = {(r["language"], r["stat"], r["value"]): (r["at_most"], r["at_least"]) for r in tail_probabilities(stats).collect()}
    for lang in ("en", "de", "und"):
        mine = [r for r in rows.values() if r["language"] == lang]
        for s in STATISTICS:
            for v in {r[s] for r in mine}:
                assert got[lang, s, v] == (pytest.approx(sum(r[s] <= v for r in mine) / len(mine)), pytest.approx(sum(r[s] >= v for r in mine) / len(mine)))
    assert outlier_scores(df).count() == 6


def test_not_prose_on_held_out_documents(spark):
    rnd = random.Random(6)
    nouns, verbs = ["bridge", "river", "teacher", "engine", "garden"], ["found", "carried", "left", "saw"]

    def prose() -> str:
        return " ".join(f"The {rnd.choice(nouns)} that we {rnd.choice(verbs)} was near the {rnd.choice(nouns)}, and they had {rnd.choice(verbs)} it." for _ in range(rnd.randint(1, 6)))

    def other() -> str:
        return rnd.choice([lambda: "\n".join(f"- {rnd.choice(nouns).title()} {rnd.randint(1, 99)}" for _ in range(9)), lambda: "\n".join(f"{rnd.randint(1, 999)}|{rnd.choice(nouns)}|{rnd.random():.2f}" for _ in range(9)), lambda: "".join(rnd.choices("$%&/()=? ", k=200))])()

    docs = [(i, prose() if i % 3 else other(), "en") for i in range(300)]
    labels = [(i, "prose" if i % 3 else "list") for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["p_not_prose"] > 0.5 for r in not_prose(df, spark.createDataFrame(labels, "doc_id long, text_kind string")).collect()}
    assert len(out) == 300 and np.mean([out[i] == (i % 3 == 0) for i in range(150, 300)]) > 0.98
    assert not_prose(df, spark.createDataFrame([], "doc_id long, text_kind string")).count() == 300
