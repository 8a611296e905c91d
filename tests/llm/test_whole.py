"""Cases that the training-data operators used to leave out."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from sparkloom.llm.encodings import CHAINS, LONGEST_CHARACTER_FORM, garbled_forms
from sparkloom.llm.golomb import SeenBefore
from sparkloom.llm.linkage import link_names, solve_with_residuals, truths
from sparkloom.llm.mixing import mix, mix_report
from sparkloom.llm.mojibake import garbled_records
from sparkloom.llm.quality import common_words, fit_weights
from sparkloom.llm.queries import p1_copies
from sparkloom.llm.winnowing import aligned_pairs, best_alignment, best_alignments, leaked_passages


def test_copies_count_every_name(spark, tmp_path):
    word = "победа"
    bad = word.encode().decode("cp1252")
    names = [f"{word} 2010 720p"] * 3 + [f"{bad} 2010 720p"] * 2 + ["Quiet Tide (1999)", "quiet.tide.1999", None]
    spark.createDataFrame([(f"{i:02d}", n) for i, n in enumerate(names)], "info_hash string, name string").write.parquet(f"{tmp_path}/torrents.parquet")
    spark.createDataFrame([("00", word)], "info_hash string, path string").write.parquet(f"{tmp_path}/torrent_files.parquet")
    spark.createDataFrame([(word, word)], "title string, original_title string").write.parquet(f"{tmp_path}/content.parquet")
    rows = p1_copies(spark, str(tmp_path)).collect()
    assert sorted(r["n_copies"] for r in rows) == [2, 2, 3]


def test_a_slip_of_the_pen_beside_other_titles(spark):
    at = dt.datetime(2024, 1, 1)
    works = [("movie", "tmdb", "1", "Silvern Harbour", None, 2010, 5.0, at), ("tv_show", "tvdb", "2", "Silvern", None, 2010, 5.0, at), ("movie", "tmdb", "3", "Silvern", None, 1970, 5.0, at), ("movie", "tmdb", "4", "Quiet Meadow Tide", None, 2001, 5.0, at), ("movie", "tmdb", "5", "Quiet", None, 1960, 5.0, at)]
    names = [("a", "Silvern Habrour 2010 720p"), ("b", "Silvern Harbour 2010 720p"), ("c", "Silvern S01E02 720p"), ("d", "Quiet Meadwo Tide 2001 1080p")]
    schema = "content_type string, content_source string, content_id string, title string, original_title string, release_year int, popularity double, updated_at timestamp"
    rows = link_names(spark.createDataFrame(names, "info_hash string, text string"), spark.createDataFrame(works, schema)).collect()
    assert {r["info_hash"]: r["content_id"] for r in rows} == {"a": "1", "b": "1", "c": "2", "d": "4"}


def test_passages_with_edits_near_their_ends(spark):
    words = [f"w{i}" for i in range(16)]
    docs = []
    for n, x, y in [(n, x, y) for n in (15, 16) for x in range(n) for y in range(x)]:
        docs.append((len(docs), " ".join("other" if k in (x, y) else w for k, w in enumerate(words[:n]))))
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    found = {r["doc_id"] for r in leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert len(found) == len(docs) == 225
    assert leaked_passages(spark.createDataFrame([(1, " ".join(words[:12]))], "doc_id long, text string"), items).count() == 0


def test_coded_sets_spare_the_exact_step(spark):
    rows = [(i, f"{i * 7919 % 900:040x}") for i in range(1200)]  # 900 keys, the last 300 rows repeat the first ones
    s = SeenBefore(spark.createDataFrame(rows, "id long, hash string"), spark.createDataFrame([], "hash string"), epochs=6, precision=12, block_keys=100)
    assert sorted(r["id"] for r in s.seen().collect()) == list(range(900, 1200))
    r = s.rates().first()
    assert r["confirmed"] == 300 and r["rows_without_sets"] == 1200 and r["rows_confirmed"] < 620
    everything = s.candidates.count()
    assert everything == r["rows_confirmed"]


def test_epochs_change_no_answer(spark):
    rows = [(i, None if i % 7 == 0 else f"{i * i % 211:040x}") for i in range(700)]
    df, known = spark.createDataFrame(rows, "id long, hash string"), spark.createDataFrame([(f"{3:040x}",), (None,)], "hash string")
    got = [sorted(r["id"] for r in SeenBefore(df, known, epochs=e).seen().collect()) for e in (1, 3, 64)]
    assert got[0] == got[1] == got[2] and got[0]


def test_weights_of_surprises_are_never_negative_and_separate():
    rnd = np.random.default_rng(3)
    x = rnd.exponential(1.0, (400, 6))
    y = (2 * x[:, 0] + x[:, 3] - x[:, 5] > 3).astype(float)
    w, threshold = fit_weights(x, y)
    assert (w >= 0).all() and w[0] > w[3] > 0 and w[5] == 0
    assert np.mean((x @ w > threshold) == (y == 1)) > 0.85


def test_common_words_come_from_the_corpus(spark):
    docs = [(i, f"zul the item{i} mek zul", "en") for i in range(9)] + [(20 + i, "der zul und", "DE") for i in range(3)] + [(30, None, None), (31, "", "xx")]
    got = common_words(spark.createDataFrame(docs, "doc_id long, text string, lang string"), most=3)
    assert got == {"en": ["mek", "the", "zul"], "de": ["der", "und", "zul"]}


def test_alignments_at_once_equal_single_ones():
    rnd = np.random.default_rng(5)
    pairs = []
    for _ in range(120):
        a = rnd.integers(0, 12, rnd.integers(1, 25))
        b = rnd.integers(-1, 12, rnd.integers(1, 60))
        if rnd.random() < 0.5:
            b = np.concatenate([b, a[len(a) // 4 :], b[:3]])
        pairs.append((a.astype(np.int32), b.astype(np.int32)))
    assert best_alignments(pairs) == [best_alignment(a.tolist(), b.tolist()) for a, b in pairs]


def test_leaks_by_broadcast_and_by_shuffle_are_the_same(spark):
    rnd = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(words, 30))) for i in range(4)]
    docs = []
    for d in range(40):
        body = list(rnd.choice(words, 150))
        body[70:70] = items[d % 4][1].split()[d % 8 : d % 8 + 18]
        docs.append((d, " ".join(body)))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    both = [{tuple(r) for r in aligned_pairs(df, it, least_score=8, least_words=10, broadcast_up_to=n).collect()} for n in (0, 10_000)]
    assert both[0] == both[1] and {(d, d % 4) for d in range(40)} <= {r[:2] for r in both[0]}
    # windows around hits give the scores of whole documents
    ids = {w: n for n, w in enumerate(words)}
    whole = {(d, i): best_alignment([ids[w] for w in t.split()], [ids[w] for w in doc.split()])[0] for d, doc in docs for i, t in items}
    assert all(r[2] == whole[r[:2]] for r in both[0] if whole[r[:2]] >= 15)


def test_mix_says_why_it_is_no_larger(spark):
    df = spark.createDataFrame([(i, "a" if i < 30 else "b", "some words here " * 5) for i in range(40)], "doc_id long, source string, text string")
    wanted = lambda *rows: spark.createDataFrame(rows, "source string, target_share double, max_repeats int")
    notes = lambda *a: {r["source"]: r["note"] for r in mix_report(df, *a).collect()}
    assert notes(wanted(("a", 0.5, 1), ("b", 0.5, 2))) == {"a": None, "b": "bounds the total"}
    assert notes(wanted(("a", 0.5, 1), ("b", 0.5, 2)), 10**6) == {"a": "asked for more than its repeats allow", "b": "asked for more than its repeats allow"}
    assert notes(wanted(("a", 0.5, 1), ("none", 0.5, 2))) == {"a": None, "none": "no documents"} and mix(df, wanted(("a", 0.5, 1), ("none", 0.5, 2))).count() == 0


def test_garbled_words_of_any_length_and_plain_letters(spark):
    clean = "мира и война в городе где живут люди и река несёт воды далеко в море"
    long = "дом" * 50
    letters = "Вечеринка".encode("cp1251").decode("cp1252")  # no sound form of it occurs, and all of it are plain Latin letters
    rows = [("long", long.encode().decode("cp1252", "ignore") + " x"), ("plain", f"{letters} 2010"), ("cut", "река \ufffd\ufffdдом"), ("sound", "ÄÖÜ Été Ünïcödé"), ("ascii", "plain")]
    rows += [(f"c{i}", t) for i in range(8) for t in (clean, long, "Вода и река", "в Городе Нет чеканки", "les châteaux déjà")]
    got = {r["id"]: r["restored"] for r in garbled_records(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert set(got) == {"long", "plain", "cut"}
    assert got["long"] == long + " x" and got["plain"] == "Вечеринка 2010" and got["cut"] is None


def test_no_character_form_is_longer_than_the_bound():
    for ch in "éěệ한日Ж\u1f82𠀋ẛ̣":
        assert all(len(form) <= LONGEST_CHARACTER_FORM for form, _ in garbled_forms(ch, every_chain=True))
    assert max(len(c) for c in CHAINS) == 4


def test_copies_weigh_in_the_vocabulary(spark):
    bad = "château".encode().decode("cp1252")
    texts = spark.createDataFrame([(1, bad, 1)], "id long, text string, copies long")
    known = spark.createDataFrame([("le château", 7)], "text string, copies long")
    assert [r["restored"] for r in garbled_records(texts, [known]).collect()] == ["château"]
    assert garbled_records(texts.drop("copies"), [known.limit(0)]).count() == 0


WORK = "content_type string, content_source string, content_id string, title string, original_title string, release_year int, popularity double, updated_at timestamp"


def _works(*rows):
    return [("movie", "tmdb", i, t, None, y, p, dt.datetime(2024, 1, 1)) for i, t, y, p in rows]


def test_the_rules_decide_links(spark):
    content = spark.createDataFrame(_works(("1", "Silver Harbor", 1990, 5.0), ("2", "Silver Harbor", 2015, 6.0), *[(f"t{i}", "Triple Lantern", 1950 + 20 * i, 3.0) for i in range(3)]), WORK)
    names = [("bare", "Silver.Harbor.720p.x264"), ("three", "Triple Lantern 1080p")] + [(f"d{i}", f"Silver Harbor 1990 {i}00p GRP{i}") for i in range(3, 15)]
    df = spark.createDataFrame(names, "info_hash string, text string")

    def linked(**weights):
        return {r["info_hash"]: r["content_id"] for r in link_names(df, content, weights).collect()}

    every, no_follow, no_limit = linked(), linked(transitivity=0.0), linked(exclusivity=0.0)
    dated = {f"d{i}": "1" for i in range(3, 15)}
    assert every == dated | {"bare": "1"}  # it follows the names that are dated; three works of one title fit alike, so none
    assert no_follow == dated | {"bare": "2"}  # the more popular work
    assert no_limit == dated | {"bare": no_limit["bare"], "three": no_limit["three"]}
    scored, _, report = truths(df, content)
    assert report["copies"] > 0 and 0 < report["primal"] <= 2e-3 and report["dual"] <= 2e-3
    assert scored.filter("truth < 0 or truth > 1").count() == 0


def test_truths_of_single_candidates_are_the_minimum(spark):
    rows = [(f"{k}{s}", f"v{s}", a, b, w, sq) for s in (0.05, 0.5, 0.9) for k, a, b, w, sq in (("s", -1.0, s, 4.0, True), ("p", 1.0, 0.0, 0.4, False))]
    got, report = solve_with_residuals(spark.createDataFrame(rows, "pid string, v string, a double, b double, weight double, square boolean"), tolerance=1e-4)
    assert all(abs(r["truth"] - max(0.0, float(r["v"][1:]) - 0.05)) < 2e-3 for r in got.collect()) and report["rounds"] < 400
    with pytest.raises(RuntimeError):
        solve_with_residuals(spark.createDataFrame(rows, "pid string, v string, a double, b double, weight double, square boolean"), rounds=4, tolerance=1e-9)


def test_the_solver_keeps_its_plans_small(spark, monkeypatch):
    from sparkloom.llm import linkage

    scans, kept = [], linkage.cut
    monkeypatch.setattr(linkage, "cut", lambda df: scans.append(df._jdf.queryExecution().analyzed().collectLeaves().size()) or kept(df))
    rows = [("s1", "x", -1.0, 0.9, 4.0, True), ("s2", "y", -1.0, 0.8, 4.0, True), ("e", "x", 1.0, -1.0, 8.0, False), ("e", "y", 1.0, -1.0, 8.0, False)]
    _, report = linkage.solve_with_residuals(spark.createDataFrame(rows, "pid string, v string, a double, b double, weight double, square boolean"))
    assert report["rounds"] >= 8 and max(scans) <= 4, scans  # a round reads its state four times; uncut rounds multiply that
