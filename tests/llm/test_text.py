"""Formatting duplicates, look-alikes and wrong encodings on small cases and against plain Python."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.encodings import CHAINS, garble, garbled_forms
from sparkloom.llm.formatting import collapse_formatting, formatting_pairs
from sparkloom.llm.lookalike import same_look, same_look_forms, same_look_pairs
from sparkloom.llm.mojibake import garbled_records

NAMES = [
    ("01", "The.Iron.Bridge.2012.S03E04.1080p.DVDRip.AV1-HCXEN.mkv"), ("02", "[hcxen] the iron bridge - 2012 s03e04 1080p DVDRip av1.mkv"), ("03", "AV1 {S03E04} The Iron Bridge {1080p} 2012 HCXEN DVD_Rip.mkv"),
    ("04", "Iron.Bridge.The.2012.S03E04.1080p.DVDRip.AV1-HCXEN.mkv"), ("05", "The.Iron.Bridge.2012.S03E05.1080p.DVDRip.AV1-HCXEN.mkv"), ("06", "The.Iron.Bridgé.2012.S03E04.1080p.DVDRip.AV1-HCXEN.mkv"),
    ("07", "Тhe Ｉron Bri​dge 2012 S03E04 1080p DVDRip AV1 HCXEN.mkv"), ("08", "Quiet & Tide 1999 720p"), ("09", "Quiet Tide (1999) [720p]"), ("10", "Quiet and Tide 1999 720p"), ("11", None), ("12", ""), ("13", ""), ("14", "Quiet Tide (1999) [720p]"),
]


def test_formatting_pairs(spark):
    df = spark.createDataFrame(NAMES, "info_hash string, name string")
    got = {(r[0], r[1]) for r in formatting_pairs(df).collect()}
    assert got == {("01", "02"), ("01", "03"), ("01", "07"), ("08", "09"), ("08", "14"), ("12", "13")}
    counts = {r["name"]: (r["n_copies"], r["n_spellings"]) for r in collapse_formatting(df).collect()}
    assert counts["Quiet & Tide 1999 720p"] == (3, 2) and sum(c for c, _ in counts.values()) == 13


def test_formatting_empty_long_and_extra_columns(spark):
    empty = spark.createDataFrame([], "info_hash string, name string")
    assert formatting_pairs(empty).count() == 0 and collapse_formatting(empty).count() == 0
    long = "word." * 20_000
    df = spark.createDataFrame([("a", long, 1, "x"), ("b", long.replace(".", " "), 2, "y")], "info_hash string, name string, text int, canonical string")
    assert [(r[0], r[1]) for r in formatting_pairs(df).collect()] == [("a", "b")]


LOOKS = ["Grave Tide 2010", "Grаve Tide 2010", "Ｇｒａｖｅ Tide 2010", "Gra‍ve Tide 2010", "grave Tide 2010", "Gráve Tide", "Gráve Tide", "Grave.Tide 2010", "ﬁn", "fin", "한국", unicodedata.normalize("NFD", "한국"), "ệ", "ệ", "ệ", "ﾊﾞ", "バ", "ёж", "ёж", "x²", "x2", "", "​"]


def test_same_look_forms_equal_the_reference(spark):
    rnd = random.Random(3)
    pool = "aeоаνΑẹ́́̈​ Ａ한한バ゙ﬁ½²ЙйЁ"
    texts = LOOKS + ["".join(rnd.choices(pool, k=rnd.randint(1, 14))) for _ in range(300)] + [None, "é" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["form"] for r in same_look_forms(df).collect()}
    assert set(got) == {t for t in texts if t is not None}
    groups = Counter()
    for t, f in got.items():
        assert unicodedata.normalize("NFC", f) == same_look(t), ascii(t)
        groups[f] += 1
    assert got["Gráve Tide"] == got["Gráve Tide"] and got["ﬁn"] == "fin" and got["ệ"] == got["ệ"] and got["x²"] != got["x2"]


def test_same_look_pairs_against_brute_force(spark):
    rows = [(f"{i:03d}", t) for i, t in enumerate(LOOKS + ["Grave Tide 2010", None])]
    df = spark.createDataFrame(rows, "info_hash string, name string")
    got = {(r[0], r[1]) for r in same_look_pairs(df).collect()}
    want = {(a, b) for (a, x), (b, y) in combinations(rows, 2) if x is not None and y is not None and x != y and same_look(x) == same_look(y)}
    assert got == want
    assert same_look_pairs(spark.createDataFrame([], "info_hash string, name string")).count() == 0


CLEAN = ["Québec château forêt", "Мир и война", "日本語の旅 物語", "Größe über Äpfel", "El corazón de España", "한국어 편지", "Ελληνικά και θάλασσα"]


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(CLEAN), st.integers(0, len(CHAINS) - 1))
def test_forms_hold_every_chain(text, i):
    for word in text.split():
        g = garble(word, CHAINS[i])
        if g and g != word and not g.isascii():
            assert g in {f for f, _ in garbled_forms(word)}


def test_garbled_records(spark):
    g = lambda t, *c: " ".join(garble(w, c) for w in t.split(" "))
    cases = {
        "a": (g("El corazón de España", "utf-8", "cp1252"), "El corazón de España"), "b": (g("Мир и война", "utf-8", "cp1251"), "Мир и война"), "c": (g("日本語の旅", "euc-jp", "latin-1"), "日本語の旅"),
        "d": (g("Größe", "utf-8", "cp1252", "utf-8", "cp1252"), "Größe"), "e": ("S�o Jo�o", None), "f": (g("Zürna", "utf-8", "cp437"), "Zürna"),
    }
    sound = ["SÃO PAULO MANHÃ", "Été à l'île", "“Title” … 5°C №1 ½", "Тhе dіsguised name", "Ünïcödé", "naïve ﬁn", "plain ascii", "", None]
    rows = [(k, v[0]) for k, v in cases.items()] + [(f"s{i}", t) for i, t in enumerate(sound)] + [(f"r{j}{i}", t) for j in range(6) for i, t in enumerate(CLEAN)]
    got = {r["id"]: r["restored"] for r in garbled_records(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert set(got) == set(cases)
    assert {k: got[k] for k in cases} == {k: v[1] for k, v in cases.items()}


def test_garbled_records_empty(spark):
    assert garbled_records(spark.createDataFrame([], "id string, text string")).count() == 0


def test_long_garbled_text_is_read_whole(spark):
    text = "word " * 30_000 + garble("château", ("utf-8", "cp1252"))
    rows = [("x", text)] + [(str(i), "le château") for i in range(6)]
    got = {r["id"]: r["restored"] for r in garbled_records(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert set(got) == {"x"} and got["x"].endswith("château")


@pytest.mark.parametrize("text", ["", "abc", "Ａ", "​"])
def test_same_look_is_idempotent(text):
    assert same_look(same_look(text)) == same_look(text)
