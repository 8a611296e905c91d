"""Workflows with every action, flags, sources and plan size; fuzzy matching and candidates against brute force."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.titles import native_key, normalize_title
from sparkloom.operators.matching import best_matches, candidates, resolve_aliases
from sparkloom.plans.rules import CONTENT_TYPES, ExpressionError, Flags, Scope, Workflow, json_schema, read_source


@pytest.fixture(scope="module")
def content(spark):
    rows = [("movie", "tmdb", "1", "The Iron Bridge", 1990), ("tv_show", "tvdb", "2", "Quiet Tide", 2001), ("movie", "tmdb", "3", "Lantern", 2010)]
    return spark.createDataFrame(rows, "content_type string, content_source string, content_id string, title string, release_year int")


def _names(spark, rows):
    df = spark.createDataFrame(rows, "id string, name string, size long, hint_type string, hint_source string, hint_id string")
    return df, Scope({"torrent.name": F.col("name"), "torrent.size": F.col("size")})


def test_actions_that_parse_and_attach(spark, content):
    df, scope = _names(spark, [
        ("film", "The.Iron.Bridge.1991.1080p.BluRay.x264-GRP", 9, None, None, None), ("show", "Quiet Tide S01E02 720p", 9, None, None, None), ("pack", "Quiet Tide S02 720p", 3, None, None, None), ("hint", "whatever", 9, "movie", "tmdb", "3"),
        ("badhint", "Lantern 2010 720p", 9, "movie", "tmdb", "99"), ("date", "Quiet Tide 2004.05.06 720p", 9, None, None, None), ("none", "no marks at all", 9, None, None, None), ("guess", "Lantern guessme 2010", 9, None, None, None), ("null", None, None, None, None, None),
    ])
    actions = [
        {"find_match": ["parse_date"]}, {"find_match": ["attach_local_content_by_id", "attach_tmdb_content_by_id"]},
        {"if_else": {"condition": "result.content == null && !torrent.name.contains('guessme')", "if_action": {"find_match": ["parse_video_content"]}}},
        {"if_else": {"condition": "result.content == null && result.title != null", "if_action": {"find_match": ["attach_local_content_by_search", "attach_tmdb_content_by_search"]}}},
        "type_fallback", "enrich_type_fallback", {"if_else": {"condition": "result.content != null", "if_action": {"add_tag": "attached"}}},
    ]
    w = Workflow({"default": actions}, scope, {"type_fallback": lambda s: F.when(F.col("name").contains("guessme"), "movie")}, content, single_episode_max_bytes=5)
    got = {r["id"]: r for r in w.apply(df).collect()}
    ref = lambda k: got[k]["content"] and got[k]["content"]["content_id"]
    assert {k: ref(k) for k in got} == {"film": "1", "show": "2", "pack": "2", "hint": "3", "badhint": "3", "date": "2", "none": None, "guess": None, "null": None}
    assert got["film"]["year"] == 1991 and got["film"]["video"]["release_group"] == "GRP" and got["film"]["episodes"] is None
    assert got["show"]["episodes"] == {1: [2]} and got["pack"]["episodes"] is None and str(got["date"]["date"]) == "2004-05-06" and got["date"]["content_type"] == "tv_show"
    assert got["guess"]["content_type"] == "movie" and got["guess"]["year"] == 2010 and got["none"]["content_type"] is None and got["film"]["tags"] == ["attached"] and not any(r["unmatched"] for r in got.values())
    assert w.apply(df.limit(0)).count() == 0


def test_packs_fansubs_and_numbers(spark):
    names = [("pack", "The Bridge Trilogy 1980 1080p"), ("ep", "Some.Tide.2024.EP12.1080p"), ("sub", "[Grp] Long River - 107 (480p).mkv"), ("film", "[Grp] Long River The Movie [BD 1080p].mkv"), ("vague", "[Grp] Long River [1080p].mkv"), ("other", "[Nobody] Long River [1080p].mkv")]
    df, scope = _names(spark, [(i, n, 9, None, None, None) for i, n in names])
    w = Workflow({"default": [{"find_match": ["parse_video_content"]}]}, scope, fansub_groups=("grp",))
    got = {r["id"]: (r["content_type"], r["title"], r["year"]) for r in w.apply(df).collect()}
    assert got == {"pack": (None, None, None), "ep": ("tv_show", "Some Tide", 2024), "sub": ("tv_show", "Long River", None), "film": ("movie", "Long River The Movie", None), "vague": ("tv_show", None, None), "other": (None, None, None)}


def test_find_match_restores_and_stops(spark):
    df, scope = _names(spark, [("a", "x", 1, None, None, None), ("b", "y", 1, None, None, None)])
    tries = [[{"add_tag": "lost"}, {"set_content_type": "game"}, "unmatched", {"add_tag": "never"}], [{"if_else": {"condition": "torrent.name == 'x'", "if_action": {"add_tag": "kept"}, "else_action": "unmatched"}}]]
    got = {r["id"]: (r["content_type"], r["tags"], r["unmatched"]) for r in Workflow({"default": [{"find_match": tries}, {"add_tag": "end"}]}, scope).apply(df).collect()}
    assert got == {"a": (None, ["kept", "end"], False), "b": (None, ["end"], False)}
    ends = {r["id"]: (r["tags"], r["unmatched"]) for r in Workflow({"default": [{"add_tag": "one"}, "unmatched", {"add_tag": "two"}]}, scope).apply(df).collect()}
    assert ends == {"a": (["one"], True), "b": (["one"], True)}


def test_a_long_workflow_plans_quickly(spark):
    df, scope = _names(spark, [("a", "x", 1, None, None, None)])
    actions = [{"if_else": {"condition": f"torrent.name == 'x' && !(result.tags.contains('t{i}'))" if i % 2 else "torrent.size > 0", "if_action": {"add_tag": f"t{i}"}, "else_action": {"set_content_type": "game"}}} for i in range(20)]
    scope.columns["result_tags"] = F.lit(1)
    actions = [{"if_else": {**a["if_else"], "condition": "torrent.size > 0"}} for a in actions]
    start = time.time()
    out = Workflow({"default": actions}, scope).apply(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert time.time() - start < 20 and len(plan) < 400_000
    assert out.first()["tags"] == [f"t{i}" for i in range(20)]


def test_flags_sources_and_types(spark):
    df, scope = _names(spark, [("a", "x", 1, None, None, None)])
    flags = Flags({"on": "bool", "least": "int", "drop": "content_type_list", "words": "string_list", "s": "string"}, {"on": True, "least": 1, "drop": ["game"], "words": ["x"], "s": "x"})
    w = Workflow({"default": [{"set_content_type": "game"}, {"if_else": {"condition": "flags.on && torrent.size >= flags.least && result.content_type in flags.drop && torrent.name in flags.words && torrent.name == flags.s", "if_action": "delete"}}]}, scope, flags=flags)
    assert w.apply(df).first()["deleted"]
    for kinds, values in (({"a": "bool"}, {"a": 1}), ({"a": "int"}, {"a": True}), ({"a": "nope"}, {}), ({}, {"a": 1}), ({"a": "int"}, {}), ({"a": "content_type_list"}, {"a": ["x"]}), ({"a": "string_list"}, {"a": [1]})):
        with pytest.raises(ExpressionError):
            Flags(kinds, values)
    for bad in ([{"if_else": {"condition": "torrent.size", "if_action": "delete"}}], ["nope"], [{"apply": "nope"}], [{"run_workflow": "nope"}], [{"if_else": {}}], [3]):
        with pytest.raises(ExpressionError):
            Workflow({"default": bad}, scope).apply(df)
    source = {"workflows": {"default": ["delete"]}, "flag_definitions": {"on": "bool"}, "flags": {"on": False}, "keywords": {"k": ["a"]}}
    assert read_source(json.dumps(source))[1].values == {"on": False}
    with pytest.raises(ExpressionError):
        read_source('{"x": 1}')
    schema = json_schema()
    assert schema["$defs"]["action"] and CONTENT_TYPES[0] in json.dumps(schema)


def test_lists_join_and_fail_when_empty(spark):
    from sparkloom.plans.rules import Expression

    df = spark.createDataFrame([(["a", "b"], [1.0])], "e array<string>, s array<double>")
    scope = Scope({"e": F.col("e"), "s": F.col("s")})
    assert df.select(Expression("(['x'] + e.map(f, f)).join(' ')", scope).compile()).first()[0] == "x a b"
    with pytest.raises(Exception, match="empty list"):
        df.select(Expression("s.filter(x, x > 9).max()", scope).compile()).collect()


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_matches_equal_brute_force(spark):
    rnd = random.Random(11)
    words = "iron bridge quiet tide lantern silver harbor winter garden story of night river stone glass".split()
    titles = [" ".join(rnd.choices(words, k=rnd.randint(1, 11))) for _ in range(60)] + ["雪の国", "ユキノクニ", "Тихая река", "Fate/stay night", "The " + " ".join(words[:10]), ""]

    def slip(t):
        t = list(t)
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(t) + 1)
            t[i : i + rnd.randint(0, 1)] = rnd.choice(["", "x", "e"])
        return "".join(t)

    left = [(f"l{i:03d}", slip(t), rnd.choice([None, 2000, 2001])) for i, t in enumerate(titles + rnd.sample(titles, 30))] + [("l900", None, 1), ("l901", "ゆきのくに", None)]
    right = [(f"r{i:03d}", t, rnd.choice([None, 2000, 2003])) for i, t in enumerate(titles)]
    got = {r["l_id"]: r["r_id"] for r in best_matches(spark.createDataFrame(left, "l_id string, title string, year int"), spark.createDataFrame(right, "r_id string, title string, year int")).collect()}
    want = {}
    for li, lt, ly in left:
        best = None
        for ri, rt, ry in right:
            if not lt or not rt or not (a := normalize_title(lt)) or not (b := normalize_title(rt)):
                continue
            native = bool(native_key(lt)) and native_key(lt) == native_key(rt)
            if not native and not native_key(lt) and a.split()[0] != b.split()[0]:
                continue
            d, x, y = _lev(a, b), set(a.split()), set(b.split())
            j = 1.0 if native else round(len(x & y) / len(x | y), 6)
            d = 0 if native else d
            p = 0 if ly is None or ry is None or ly == ry else 1 if abs(ly - ry) == 1 else 100
            if p < 100 and (native or d <= min(5, -(-15 * len(a) // 100)) or j >= 0.9):
                best = min(best or (9, 9, 9, ""), (p, d, -j, ri))
        if best:
            want[li] = best[3]
    assert got == want and len(want) > 40 and "l901" in want


def test_candidates_and_aliases(spark):
    works = [("w1", "movie", "Iron Bridge", 1990), ("w2", "movie", "The Old Iron Bridge Story", 1991), ("w3", "movie", "Bridge of Iron", 1990), ("w4", "movie", "Iron Bridge", 1950), ("w5", "movie", "Bridge Club", 1990), ("w6", "tv_show", "Iron Bridge", 1970), ("w7", "movie", None, 1)]
    w = spark.createDataFrame(works, "w_id string, kind string, title string, year int")
    q = spark.createDataFrame([("q1", "movie", "Iron Bridge", 1990), ("q2", "tv_show", "Iron Bridge", 2001), ("q3", "movie", "", None), ("q4", "movie", None, None)], "q_id string, kind string, title string, year int")
    got = {(r["q_id"], r["w_id"]): r["step"] for r in candidates(q, w).collect()}
    assert got == {("q1", "w1"): 1, ("q1", "w2"): 1, ("q1", "w3"): 2, ("q1", "w5"): 3, ("q2", "w6"): 4}
    aliases = spark.createDataFrame([("Long Show Name", "s1"), ("ab", "x")], "title string, ref string")
    names = spark.createDataFrame([(1, "long show  name", None, "n"), (2, None, "Long-Show Name!", "n"), (3, "no", None, "[G] LSN - 01"), (4, "ab", None, "n"), (5, None, None, None)], "id long, parsed string, extracted string, name string")
    assert {r["id"]: (r["ref"], r["how"]) for r in resolve_aliases(names, aliases, {"LSN": "s1"}).collect()} == {1: ("s1", "exact"), 2: ("s1", "exact"), 3: ("s1", "seed"), 4: (None, "miss"), 5: (None, "miss")}
