"""Serving rules, requests, evidence, liveness, jobs, tags, languages and fansub titles on small cases and against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.anime import clean_title, is_batch, is_film, is_technical, with_anime_type
from sparkloom.functions.language import audio_signal, english_audio, explicit_foreign_track, foreign_audio_only, languages_in, parse_language, subtitle_signal
from sparkloom.operators import jobs as J
from sparkloom.operators import liveness as L
from sparkloom.operators import serving as S
from sparkloom.plans.request import Profile, Request, RequestError, extensions_of, plan_request, release_attribute
from sparkloom.plans.search import ResultCache, SearchPlan, recursive_closure, with_callbacks
from sparkloom.sources import evidence as E

T = dt.datetime(2025, 1, 10)


def now():
    return F.lit(T).cast("timestamp")


def test_request_errors_and_limits(spark):
    plan = SearchPlan(spark.createDataFrame([("h", "movie", "tmdb", "7", "480p")], "info_hash string, content_type string, content_source string, content_id string, video_resolution string"))
    assert plan_request(plan, Request(limit=500, profile=Profile(50, 80))).limit == 80 and plan_request(plan, Request(profile=Profile(50, 80))).limit == 50
    assert plan_request(plan, Request("movie", categories=(2030,), tmdb_id="7")).matches().count() == 1 and plan_request(plan, Request("movie", categories=(2045,))).matches().count() == 0
    assert plan_request(plan, Request("search", categories=(9999,))).matches().count() == 1
    for bad in (Request("nope"), Request(imdb_id="1"), Request(profile=Profile(tags=("a",)))):
        with pytest.raises(RequestError):
            plan_request(plan, bad)
    for f, v in (("nope", "X"), ("encoder", "x266"), ("audio_channels", "1.1")):
        with pytest.raises(RequestError):
            release_attribute(f, v)
    assert extensions_of(["subtitles"]) == ["srt", "sub", "vtt"]
    with pytest.raises(RequestError):
        extensions_of(["nope"])


def test_zero_limit_estimates_cache_and_closure(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    none = SearchPlan(df).with_page(0).items()
    assert none.count() == 0 and "has_next_page" in none.columns
    told = SearchPlan(df).budgeted_total(10).first()
    assert told["is_estimate"] and told["total_count"] > 10 and not SearchPlan(df).budgeted_total(None).first()["is_estimate"]
    cache, made = ResultCache(most=1), []
    make = lambda: made.append(1) or spark.range(3)
    assert cache.get("a", make).count() == 3 and cache.get("a", make).count() == 3 and len(made) == 1
    cache.get("a", make, "warm"), cache.get("b", make), cache.get("a", make), cache.get("a", make, "off")
    assert len(made) == 5
    with pytest.raises(ValueError):
        cache.get("a", make, "nope")
    assert with_callbacks(spark.range(3), lambda d: d.limit(2), lambda d: d.limit(1)).count() == 1
    chain = spark.createDataFrame([(i, i + 1) for i in range(15)] + [(15, 15)], "a long, b long")
    assert recursive_closure(chain, "a", "b").count() == 15 * 16 // 2 + 1
    with pytest.raises(RuntimeError):
        recursive_closure(chain, "a", "b", most_rounds=3)
    assert recursive_closure(chain.limit(0), "a", "b").count() == 0


def test_freshness_and_scope_of_edge_cases(spark):
    items = spark.createDataFrame([(x, False) for x in "abcdef"] + [("p", True), ("n", None)], "info_hash string, private boolean")
    old, new = T - dt.timedelta(days=90), T - dt.timedelta(days=1)
    rows = [("a", "tracker", 0, new, None), ("b", "dht", 0, old, None), ("c", "dht", 0, new, None), ("d", "dht", None, old, new), ("e", "dht", 3, old, None), ("e", "tracker", None, old, None)]
    src = spark.createDataFrame(rows, "info_hash string, source string, seeders int, updated_at timestamp, published_at timestamp")
    keep = lambda **k: {r[0] for r in S.drop_dead_confidence(items, src, now(), **k).select("info_hash").collect()}
    assert keep(hide_unknown_days=30) == {"c", "d", "e"}
    assert keep(hide_unknown_days=0) == set("bcdefpn") and keep(hide_zero=False) == set("abcdefpn") and keep(authoritative=False) == set("defpn")
    assert {r[0] for r in S.serving_scope(items).collect()} == set("abcdef")
    dead = spark.createDataFrame([("a",), (None,)], "info_hash string")
    assert S.exclude_judged(items, dead, None, True).count() == 7 and S.exclude_judged(items, dead, items, False).count() == 7 and S.exclude_judged(items, dead, items, True).count() == 0


def test_evidence_of_odd_input(spark):
    d = spark.createDataFrame([("i", "Sonarr", T, b) for b in ('{"eventType": "Grab", "downloadId": "AB", "seriesId": 3}', "not json", None, '{"eventType": "Health"}')] + [("i", "prowlarr", T, '{"eventType": "Grab"}')], "instance string, app string, received_at timestamp, body string")
    rows = E.webhook_evidence(d).collect()
    assert [(r["media_id"], r["info_hash"], r["download_id"], r["strength"]) for r in rows] == [("sonarr:3", None, "ab", 60)]
    assert E.insert_evidence(None, E.webhook_evidence(d)).count() == 1 and E.insert_evidence(None, E.webhook_evidence(d).withColumn("download_id", F.lit(None).cast("string"))).count() == 0
    states = spark.createDataFrame([("SEEDING ",), ("metaDL",), ("",), (None,), ("odd",)], "s string").select(E.state_class(F.col("s"))).collect()
    assert [r[0] for r in states] == ["alive", "suspect", "ignore", "ignore", "suspect"]
    a = spark.createDataFrame([("h", "t1", 0, 0, 0), ("h", "t2", 2, 1, 0), ("h", "t3", 2, 5, 1), ("z", "t1", 0, 0, 3), ("u", "t1", 0, 0, 0)], "info_hash string, tracker string, seeders int, leechers int, completed int")
    got = {r["info_hash"]: (r["seeders"], r["leechers"], r["best_tracker"], r["class"]) for r in E.merge_scrapes(a, a).collect()}
    assert got == {"h": (2, 5, "t2", "positive"), "z": (0, 0, None, "known_zero"), "u": (None, None, None, "unknown")}


def _available(rows, now, fresh=24, protect=168, gap=1, span=4, least=2):
    h = lambda n: dt.timedelta(hours=n)
    seen, neg, pos, unk, live = set(), [], None, None, None
    for o in sorted(rows, key=lambda r: (r["at"], r["id"])):
        if o["private"] or not o["id"] or o["at"] > now or o["exp"] <= o["at"] or o["id"] in seen:
            continue
        seen.add(o["id"])
        is_fresh = now < o["exp"] and now - o["at"] < h(fresh)
        if not o["ok"] or o["class"] == "unknown":
            unk = o["at"]
        elif o["class"] == "positive":
            pos = o["at"]
            live = o["id"] if is_fresh else live
        elif is_fresh:
            neg.append(o)
    if live:
        return "fresh_positive", [live]
    q = []
    for o in neg:
        if (unk is None or o["at"] > unk) and (pos is None or o["at"] > pos) and (not q or o["at"] - q[-1]["at"] >= h(gap)):
            q.append(o)
    if not q:
        return "unknown_stale", []
    state = "unknown_stale" if q[-1]["class"] == "stall" else "fresh_known_zero"
    if not (pos and now - pos < h(protect)) and len(q) >= least and q[-1]["at"] - q[0]["at"] >= h(span):
        state = "suspected_unavailable"
    return state, [o["id"] for o in q]


def test_availability_against_replay(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(80):
        for i in range(rnd.randint(0, 9)):
            at = T - dt.timedelta(minutes=rnd.choice([10, 50, 130, 300, 500, 900, 2000, 20_000]) + rnd.randint(0, 40))
            rows.append({"k": k, "id": rnd.choice([f"o{i}", f"o{i}", "o0", ""]), "class": rnd.choice(["zero", "zero", "stall", "positive", "unknown"]) if k % 3 else "zero", "at": at, "exp": at + dt.timedelta(hours=rnd.choice([0, 12, 48])), "ok": rnd.random() < 0.9, "private": rnd.random() < 0.1})
    df = spark.createDataFrame([(r["k"], r["id"], "s", r["class"], r["at"], r["exp"], r["ok"], r["private"]) for r in rows], "info_hash long, id string, source string, class string, observed_at timestamp, expires_at timestamp, qualified boolean, private boolean")
    got = {r["info_hash"]: (r["state"], list(r["observations"])) for r in L.availability(df, now()).collect()}
    want = {k: _available([r for r in rows if r["k"] == k], T) for k in range(80)}
    assert all(got[k] == want[k] for k in got) and all(want[k] == ("unknown_stale", []) for k in want if k not in got) and len({s for s, _ in got.values()}) == 4


def test_revalidation_and_batches(spark):
    ev = [("a", 1, "suspect", T - dt.timedelta(hours=9)), ("a", 2, "suspect", T), ("b", 1, "alive", T)]
    df = spark.createDataFrame(ev, "k string, i int, kind string, at timestamp")
    got = {r["k"]: r["next_revalidate_at"] for r in L.with_revalidation(df, "k", "at", ["at", "i"], F.col("kind") == "alive", F.col("kind") == "suspect").collect()}
    assert got == {"a": T + dt.timedelta(days=30), "b": None}
    schema = "info_hash string, status string, last_qb_state string, suspect_first_seen_at timestamp, suspect_observations int, last_observed_at timestamp, blacklisted_at timestamp, next_revalidate_at timestamp, alive_source string"
    st = spark.createDataFrame([("a", "dead", None, None, 4, T, T, None, None), ("b", "dead", None, None, 4, T, T, T, None), ("c", "alive", None, None, 0, T, None, None, "qb_state"), ("d", "alive", None, None, 0, T, None, None, "seeds")], schema)
    every = spark.createDataFrame([("a",), ("b",), ("b",), ("x",)], "info_hash string")
    assert {r["info_hash"]: r["status"] for r in L.mark_alive_batch(st, every, now(), "seeds").collect()} == {"a": "dead", "b": "alive", "c": "alive", "d": "alive"}
    some = spark.createDataFrame([(x,) for x in "abcdxx"], "info_hash string")
    assert {r["info_hash"]: (r["status"], r["suspect_observations"]) for r in L.record_suspect_batch(st, some, now()).collect()} == {"a": ("dead", 5), "b": ("dead", 5), "c": ("alive", 0), "d": ("suspect", 1), "x": ("suspect", 1)}
    assert [r[0] for r in L.due_for_revalidation(st, now(), 9).collect()] == ["b"]


def test_jobs_leases_and_tags(spark):
    schema = "id long, queue string, fingerprint string, status string, priority int, retries int, max_retries int, created_at timestamp, run_after timestamp, ran_at timestamp, deadline timestamp, archival_seconds long, error string"
    jobs = spark.createDataFrame([(1, "q", "f1", "pending", 1, 0, 1, T, T, None, None, 0, None), (2, "q", "f2", "processed", 1, 0, 1, T, T, T, None, 0, None)], schema)
    new = spark.createDataFrame([(3, "q", "f1", 1, 2), (4, "q", "f2", 1, 2), (5, "q", "f2", 1, 2)], "id long, queue string, fingerprint string, priority int, max_retries int")
    out = {r["id"]: r for r in J.enqueue(jobs, new, now(), 1).collect()}
    assert set(out) == {1, 2, 4} and out[4]["run_after"] == T + dt.timedelta(minutes=1) and out[4]["status"] == "pending"
    leases = spark.createDataFrame([("a", "leased", 3, T - dt.timedelta(seconds=1), T, T, None), ("b", "queued", 1, None, T, T, None), ("c", "queued", 1, None, T + dt.timedelta(days=1), T, None)], "job_id string, state string, lease_generation long, lease_until timestamp, available_at timestamp, created_at timestamp, reason string")
    back = J.reclaim_leases(leases, now())
    assert {r["job_id"]: r["state"] for r in back.collect()} == {"a": "queued", "b": "queued", "c": "queued"}
    held = J.claim_leases(back, now(), 60, 5)
    assert {r["job_id"]: (r["state"], r["lease_generation"]) for r in held.collect()} == {"a": ("leased", 4), "b": ("leased", 2), "c": ("queued", 1)}
    answers = spark.createDataFrame([("a", 3, "late"), ("a", 4, "now")], "job_id string, lease_generation long, answer string")
    assert [r["answer"] for r in J.answers_that_count(held, answers).collect()] == ["now"]
    tags = spark.createDataFrame([("h", "x"), ("i", "y")], "info_hash string, name string")
    assert J.put_tags(tags, tags, []).count() == 2 and J.delete_tags(tags).count() == 2 and J.delete_tags(tags, None, ["x"]).count() == 1 and J.set_tags(tags, tags, []).count() == 0
    with pytest.raises(ValueError):
        J.put_tags(tags, tags, ["Not Good"])


def test_learnt_weights_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(J, "PIECE", 7)
    rnd = random.Random(4)
    rows = [(i, rnd.sample(["a", "b", "c"], rnd.randint(0, 3)), rnd.choice([1.0, 1.0, -1.0] if i < 150 else [-1.0, 0.0, -1.0, 1.0])) for i in range(400)]
    want = {}
    for _, rules, r in rows:
        for x in rules if r else []:
            want[x] = max(-2.0, min(2.0, want.get(x, 0.0) + 0.05 * r))
    got = {r["rule"]: r["adjustment"] for r in J.learnt_weights(spark.createDataFrame(rows, "i int, matched_rules array<string>, reward double"), ["i"]).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    cases = [("applied", None, None, None, None, 1.0), ("rejected_policy", None, None, None, None, -1.0), ("teacher_consensus", "movie", "movie", None, None, 1.0), ("operator_override", "movie", "game", None, None, -1.0), ("teacher_consensus", None, None, True, False, -1.0), ("teacher_consensus", None, None, None, None, 1.0), ("other", "a", "a", None, None, 0.0)]
    df = spark.createDataFrame([c[:5] for c in cases], "o string, p string, t string, po boolean, to boolean")
    assert [r[0] for r in df.select(J.reward(*[F.col(c) for c in ("o", "p", "t", "po", "to")])).collect()] == [c[5] for c in cases]


def test_languages_and_audio(spark):
    codes = ["en", "ENG", "German", "fre", "Castellano", "xx", "", None, "zh", "deu"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r[0] for r in df.select(parse_language(spark, F.col("c"))).collect()] == ["en", "en", "de", "fr", "es", None, None, None, "zh", "de"]
    names = spark.createDataFrame([("Film 2010 GERMAN frdub 1080p",), ("Film.ITA.ENG.mkv",), ("Itemgerman",), ("",), (None,)], "n string")
    assert [r[0] for r in names.select(languages_in(spark, F.col("n"))).collect()] == [["de", "fr"], ["en", "it"], [], [], None]
    audio = spark.createDataFrame([("Film 2010 Dublado",), ("Film TRUEFRENCH MULTI",), ("Film Hindi Dubbed",), ("Film Spanish Subbed",), ("Show [Dual Audio] dublado",), ("The Italian Job",), ("Show Dubbed",), ("Show [Eng Subs]",)], "n string")
    n = F.col("n")
    got = [tuple(r) for r in audio.select(foreign_audio_only(n), explicit_foreign_track(n), english_audio(F.lit(True), audio_signal(n), subtitle_signal(n))).collect()]
    assert got == [(True, True, None), (False, True, None), (True, True, None), (False, True, None), (False, True, None), (False, False, None), (False, False, "dub"), (False, False, "sub")]


def test_fansub_titles(spark):
    cases = {"[Grp] Long River - 107 (480p) [3FC90F00].mkv": (107, "Long River"), "[Quiet no Tide] Story [1080p]": (None, "[Quiet no Tide] Story"), "[Grp]_Soul_Lantern_27-39_(1280x720)": (None, "Soul Lantern"), "[A] x": (None, ""), "": (None, ""), "Fate [Unlimited Works] (2014) [BD 1080p x265 10 bit]": (None, "Fate [Unlimited Works] (2014)"), "Harbor v2.mkv": (None, "Harbor")}
    for name, (episode, want) in cases.items():
        assert clean_title(name, episode, frozenset({"grp", "a"})) == want, name
    assert is_technical("[English Dub]") and not is_technical("[English Patient]") and is_technical("(AT-X 1280x720 x264 AAC)") and is_technical("[]") and clean_title(None) == ""
    df = spark.createDataFrame([("[G] Show 01-12",), ("[G] Show The Movie",), ("[G] Show",), ("[G] Show [Batch]",)], "n string")
    n = F.col("n")
    assert [tuple(r) for r in df.select(is_batch(n), is_film(n), with_anime_type(F.lit(None).cast("string"), n, F.lit(True), F.lit(False))).collect()] == [(True, False, "tv_show"), (False, True, "movie"), (False, False, "tv_show"), (True, False, "tv_show")]
