"""Queries that read every row, against brute force on small tables."""

from __future__ import annotations

import math
from urllib.parse import quote_plus

import pytest

import __spark_entry__ as entry

TEXTS = {
    1: "The caf\u00e9 by the station, under the bridge", 2: "Station \u2013 na\u00efve market", 3: "station bridge quarry \u00fcber", 4: "plain station under the bridge",
    5: "\u00c9t\u00e9: comp\u00f4t lantern", 6: "compass lantern", 7: "", 8: None, 9: "Under \u201cthe\u201d bridge", 10: "the lantern under",
}
LEXEMES = {
    1: "the cafe by the station under the bridge", 2: "station naive market", 3: "station bridge quarry uber", 4: "plain station under the bridge",
    5: "ete compot lantern", 6: "compass lantern", 9: "under the bridge", 10: "the lantern under",
}


def test_full_text_reads_documents_of_every_script(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    words = {i: t.split() for i, t in LEXEMES.items()}
    tally = {w: (sum(w in ws for ws in words.values()), sum(ws.count(w) for ws in words.values()), sum(k for ws in words.values() for k, x in enumerate(ws, 1) if x == w)) for ws in words.values() for w in ws}
    assert {r["lexeme"]: (r["documents"], r["postings"], r["positions"]) for r in run("tokenize_postings_all")} == tally
    tests = {
        "fts_boolean_all": lambda ws: "station" in ws and ("bridge" in ws or "market" in ws) and "quarry" not in ws,
        "fts_phrase_all": lambda ws: " under the bridge " in f" {' '.join(ws)} ",
        "fts_prefix_all": lambda ws: "lantern" in ws and any(w.startswith("comp") for w in ws),
    }
    for name, fits in tests.items():
        assert sorted(r["doc_id"] for r in run(name)) == [i for i, ws in words.items() if fits(ws)], name


def test_magnets_of_every_name(spark, tmp_path):
    names = ["a b.c-d_e", "[Gr] Caf\u00e9 (2010)~*%7E%20+&", "\u0424\u0438\u043b\u044c\u043c", "\u6620\u753b\U0001f3ac", ""]
    spark.createDataFrame([(f"{i:040x}", n, i) for i, n in enumerate(names)], "info_hash string, name string, size long").write.parquet(f"{tmp_path}/torrents.parquet")
    got = {r["info_hash"]: r["magnet"] for r in entry.queries()["scalar_magnet_all"](spark, str(tmp_path)).collect()}
    assert got == {f"{i:040x}": f"magnet:?xt=urn:btih:{i:040x}&dn={quote_plus(n)}&xl={i}" for i, n in enumerate(names)}


def test_score_of_every_line(spark, tmp_path):
    lines = [(o, n, float(o + n), "FO"[n % 2], "RN"[(o + n) % 3 == 0]) for o in range(12) for n in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_linestatus string, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["l_orderkey"]: r["score"] for r in entry.queries()["geomean_rerank_all"](spark, str(tmp_path)).collect()}
    rate = lambda rows: (sum(r[4] == "R" for r in rows) + 1) / (len(rows) + 2)
    for o in range(12):
        logs = [math.log(rate([r for r in lines if r[k] == x[k]])) for x in lines if x[0] == o for k in (1, 3)]
        assert got[o] == pytest.approx(math.exp(sum(logs) / len(logs)) * (1 + math.log1p(o + 7)), abs=2e-6)
