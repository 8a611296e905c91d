"""Text read in a wrong encoding: find affected records and restore them.

Garbled forms of every distinct clean word of the corpus under all chains of wrong decodings make a table, of which only the
forms that may occur are kept; the tokens of the texts are hash-joined with it, and matches are verified and replaced by their
originals. Three grains share the table: whole words, the non-ASCII runs inside words, and single characters, so that a garbled word whose sound form occurs
nowhere else is still found: its run, or a gapless sequence of garbled characters of one chain, has to be in the table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.encodings import CHAINS, LONGEST_CHARACTER_FORM, UTF8_CHAINS, char_class, garbled_forms
from sparkloom.llm.lookalike import LETTERS
from sparkloom.session import cut, spread

#: ASCII separators of words; all other characters belong to words.
SEPARATORS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
NON_ASCII = r"[^\x00-\x7f]"

# Punctuation and signs that sound text of any language uses, alone or at a word's edge.
TYPOGRAPHIC = set("–—―‘’‚“”„…•·°®©™«»¿¡№×½¼¾²³¹ªº§¶±€£¥‐‑′″‹›†‡♪★☆♥❤→←✓")
# Letters of other scripts that pass for Latin ones; in a Latin word they are a disguise, not a wrong decoding.
DISGUISES = set("аеорсухіѕјӏԁԛԝһАВЕКМНОРСТУХІЅЈЗονιαρκυγωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")

#: Logarithm of a number of characters that no corpus exceeds much; only ranks likelihoods of texts of different lengths.
ALL_CHARACTERS = 24.0
#: Bits of the filter of observed keys that garbled forms have to pass before they are stored; a power of two.
SKETCH_BITS = 1 << 24
#: A garbled-looking but sound-looking word counts only if its original is this many times as frequent.
DIRECTION_RATIO = 5


def _text_pieces(text: F.Column) -> F.Column:
    return F.array_distinct(F.filter(F.split(text, SEPARATORS), lambda w: w.rlike(NON_ASCII)))


def _profile(word: str) -> tuple[bool, bool, str, list[str]]:
    """(odd characters?, more than one script?, script, non-ASCII runs) of a word."""
    classes = [char_class(c) for c in word]
    scripts = {c for c in classes if c not in ("DIGIT", "MARK", "ODD", "HIDE", "WIDE")}
    runs, run = [], ""
    for c in word + " ":
        if ord(c) > 127:
            run += c
        elif run:
            runs.append(run)
            run = ""
    script = "NONE" if not scripts else "MIXED" if len(scripts) > 1 else next(iter(scripts))
    return "ODD" in classes or "�" in word, len(scripts) > 1, script if "HIDE" not in classes and ("WIDE" not in classes or script == "HAN") else f"{script}~", list(dict.fromkeys(runs))


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [_profile(w) for w in b["piece"]]
        yield b.assign(odd=[r[0] for r in rows], mixed=[r[1] for r in rows], script=[r[2] for r in rows], runs=[r[3] for r in rows])


_PIECE = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def _longest_piece(form: str) -> str:
    best = ""
    for piece in _PIECE.findall(form):
        if len(piece) > len(best) and not piece.isascii():
            best = piece
    return best


def _observed_bits(keys: DataFrame) -> np.ndarray:
    """A bit per hash value of the observed keys: a filter of a fixed ``SKETCH_BITS`` bits, whatever the number of keys.

    A form whose bit is not set occurs in no text; where many bits are set the filter spares less, and no match is lost.
    """
    bit = F.crc32("key").bitwiseAND(F.lit(SKETCH_BITS - 1))
    words = keys.select(F.shiftright(bit, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(crc32(key) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(SKETCH_BITS // 64, dtype=np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool) if len(words) else np.zeros(SKETCH_BITS, dtype=bool)


def _forms_of(observed: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = ["kind", "key", "form", "orig", "orig_n", "orig_script", "chain"]

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, last = observed.value, SKETCH_BITS - 1
        for b in batches:
            out: list[tuple] = []
            lossy_keys: set[str] = set()
            for kind, word, n, script in zip(b["kind"], b["orig"], b["orig_n"], b["orig_script"]):
                for form, chain in garbled_forms(word, every_chain=kind == "c"):
                    lossy = kind != "w" and CHAINS[chain][1] == "utf-8?"  # tells that text was garbled, and words apart, but not letters
                    if lossy and (kind == "r" or form in lossy_keys):
                        continue
                    key = _longest_piece(form) if kind == "w" else form
                    if key and bits[zlib.crc32(key.encode("utf-8", "replace")) & last]:
                        if lossy:
                            lossy_keys.add(form)
                            out.append(("l", key, form, "", 0, script, -1))
                        else:
                            out.append((kind, key, form, word, n, script, chain))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    return forms


_FORMS_SCHEMA = "kind string, key string, form string, orig string, orig_n long, orig_script string, chain int"


def _accept_word(piece: str, n: int, odd: bool, mixed: bool, script: str, form: str, orig_n: int, orig_script: str) -> bool:
    """Is a word that equals a garbled form of a clean word a wrong decoding of it?"""
    if len(form) < 2:
        return len(form) == 1 and not odd and not mixed and orig_n >= 100 * n and script == "LATIN" and orig_script != "LATIN"
    if all(c in TYPOGRAPHIC for c in form):
        return False
    if odd or mixed:
        return True
    if script == "LATIN" and orig_script != "LATIN" and all(ord(c) > 127 for c in piece) and len(piece) >= 3:
        return True
    return orig_n >= DIRECTION_RATIO * n and orig_n >= DIRECTION_RATIO


_PASS_FOR_OTHERS = set(LETTERS.values())
_LEADS = set("ÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙ")
_TRAILS = set("ŠŒŽšœžŸƒ")


def _accept_run(piece: str, run: str, odd: bool, mixed: bool, script: str, chain: int, orig_n: int, orig: str) -> bool:
    """Is a non-ASCII run inside a word, that equals a garbled form of a clean run, a wrong decoding of it?"""
    classes = {char_class(c) for c in run}
    if "HIDE" in classes and classes <= {"HIDE"}:
        return False
    if chain in UTF8_CHAINS and len(run) >= 2:
        if all(c in TYPOGRAPHIC for c in run):
            return False
        return "ODD" in classes or mixed and not all(c in DISGUISES or char_class(c) == "HIDE" for c in run) or any(a in _LEADS and b in _TRAILS for a, b in zip(run, run[1:]))
    if len(run) != 1 or orig_n < DIRECTION_RATIO or char_class(orig[0]) != "LATIN":
        return False
    if any(ord(a) > 127 and ord(b) > 127 for a, b in zip(piece, piece[1:])) or all(c in _PASS_FOR_OTHERS for c in piece if c.isascii() and c.isalpha()):
        return False  # a word of another script with disguised letters
    at = piece.find(run)
    inside = 0 < at < len(piece) - 1 and piece[at - 1].isascii() and piece[at - 1].isalpha() and piece[at + 1].isascii() and piece[at + 1].isalpha()
    edge = piece[:at].isascii() and piece[at + 1 :].isascii() and len(piece) >= 4
    if "ODD" in classes:
        return inside and (run not in TYPOGRAPHIC or run in "‚„†‡‹›”“‰")
    return mixed and (inside or edge) and run not in DISGUISES and char_class(run) in ("GREEK", "CYRILLIC")


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = [
            _accept_word(p, n, odd, mixed, s, form, on, os) if kind == "w" else _accept_run(p, form, odd, mixed, s, ch, on, orig)
            for kind, p, n, odd, mixed, s, form, on, os, ch, orig in zip(b["kind"], b["piece"], b["n"], b["odd"], b["mixed"], b["script"], b["form"], b["orig_n"], b["orig_script"], b["chain"], b["orig"])
        ]
        yield b[ok][["piece", "form", "orig", "orig_n", "chain"]]


def _tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per run and chain: can the garbled characters that joined be laid end to end over the whole run?

    ``orig_n`` of the result is the log-likelihood of the characters laid, by their counts in the corpus, so that of several
    chains the likeliest wins.
    A run of sound-looking Latin letters has to become one cased word of another script.
    """
    for b in batches:
        out = []
        for piece, run, odd, chain, spans in zip(b["piece"], b["run"], b["odd"], b["chain"], b["spans"]):
            at: dict[int, tuple[float, str]] = {0: (0.0, "")}
            for s in sorted(spans, key=lambda s: (s["start"], s["len"])):
                if s["start"] in at:
                    score, text = at[s["start"]]
                    laid = (score + math.log1p(s["orig_n"]) - ALL_CHARACTERS, text + s["orig"])
                    end = s["start"] + s["len"]
                    if end not in at or laid > at[end]:
                        at[end] = laid
            score, text = at.get(len(run), (0.0, ""))
            if text:
                scripts = {char_class(c) for c in text} - {"MARK", "DIGIT"}
                fine = len(scripts) == 1 and not scripts & {"ODD", "HIDE"}
                if fine and (odd or "LATIN" not in scripts and (text[1:] == text[1:].lower() or text == text.upper())):
                    out.append((piece, run, text, int(100 * score), chain))
        yield pd.DataFrame(out, columns=["piece", "form", "orig", "orig_n", "chain"])


_VERDICT = "piece string, form string, orig string, orig_n long, chain int"


def _counted(df: DataFrame, own: int) -> DataFrame:
    weight = F.col("copies") if "copies" in df.columns else F.lit(1).cast("long")
    return df.select(F.explode(_text_pieces(F.col("text"))).alias("piece"), F.lit(own).alias("own"), weight.alias("copies"))


def garbled_words(texts: DataFrame, references: list[DataFrame]) -> DataFrame:
    """(piece, form, orig): words of ``texts.text`` with the garbled form that they hold and its original.

    ``references``: frames with a column ``text`` whose words only add to the clean vocabulary. A column ``copies`` of either
    says how often a text occurs. ``form`` may be longer than the word where the wrong decoding made separators; then the text
    has to hold it whole. ``orig`` is null for words that hold a garbled character which no original explains.
    """
    every = _counted(texts, 1)
    for r in references:
        every = every.unionByName(_counted(r, 0))
    counts = every.groupBy("piece").agg(F.sum("copies").alias("n"), F.max("own").alias("own"))
    pieces = cut(counts.mapInPandas(_profiles, "piece string, n long, own int, odd boolean, mixed boolean, script string, runs array<string>"))

    mine = pieces.filter(F.col("own") == 1)
    keyed = mine.select("piece", "n", "odd", "mixed", "script", F.lit("w").alias("kind"), F.col("piece").alias("key")).unionByName(
        mine.filter(F.col("script").startswith("LATIN") | F.col("odd") | F.col("mixed")).select("piece", "n", "odd", "mixed", "script", F.lit("r").alias("kind"), F.explode("runs").alias("key"))
    )
    foreign = ~F.col("odd") & ~F.col("mixed") & (F.col("script") == "LATIN") & F.col("piece").rlike(r"\A[^\x00-\x7f]{4,}\z")
    at = mine.filter(F.col("odd") | foreign).select("piece", "odd", F.explode("runs").alias("run"))
    starts = at.select("piece", "odd", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    spans = starts.select("piece", "odd", "run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_CHARACTER_FORM), F.length("run") - F.col("start") + 1))).alias("len"))
    spans = spans.select("piece", "odd", "run", "start", "len", F.expr("substring(run, start, len)").alias("key"))
    observed = texts.sparkSession.sparkContext.broadcast(_observed_bits(keyed.select("key").unionByName(spans.select("key"))))

    clean = pieces.filter(~F.col("odd") & ~F.col("mixed") & ~F.col("script").isin("NONE") & ~F.col("script").contains("~"))
    words = clean.select(F.lit("w").alias("kind"), F.col("piece").alias("orig"), F.col("n").alias("orig_n"), F.col("script").alias("orig_script"))
    runs = clean.select(F.explode("runs").alias("orig"), "n", "script").groupBy("orig").agg(F.sum("n").alias("orig_n"), F.min("script").alias("orig_script"))
    chars = runs.select(F.explode(F.array_distinct(F.split("orig", ""))).alias("orig"), "orig_n", "orig_script").groupBy("orig").agg(F.sum("orig_n").alias("orig_n"), F.min("orig_script").alias("orig_script"))
    vocabulary = words.unionByName(runs.select(F.lit("r").alias("kind"), "orig", "orig_n", "orig_script")).unionByName(chars.select(F.lit("c").alias("kind"), "orig", "orig_n", "orig_script"))
    forms = cut(spread(vocabulary).mapInPandas(_forms_of(observed), _FORMS_SCHEMA))

    joined = keyed.join(forms.filter(F.col("kind").isin("w", "r")), ["kind", "key"])
    matched = cut(joined.filter(F.col("orig") != F.col("piece")).mapInPandas(_judge, _VERDICT))

    units = spans.join(forms.filter("kind = 'c'").select("key", "orig", "orig_n", "chain"), "key")
    tiled = (
        units.filter(F.length("run") >= 2).join(matched.select("piece").distinct(), "piece", "left_anti")
        .groupBy("piece", "run", "odd", "chain")
        .agg(F.collect_list(F.struct((F.col("start") - 1).alias("start"), "len", "orig", "orig_n")).alias("spans"))
        .mapInPandas(_tile, _VERDICT)
    )
    told = spans.filter(F.col("key").rlike("[\\x{80}-\\x{9f}\\x{fffd}]")).join(forms.filter(F.col("kind").isin("c", "l")).select("key").distinct(), "key", "left_semi")
    lossy = told.select("piece").distinct().select("piece", F.col("piece").alias("form"), F.lit(None).cast("string").alias("orig"), F.lit(0).cast("long").alias("orig_n"), F.lit(-1).alias("chain"))
    return matched.unionByName(tiled).unionByName(lossy)


def garbled_records(texts: DataFrame, references: list[DataFrame] | None = None) -> DataFrame:
    """Affected rows of ``texts`` (all its columns; ``text`` is examined) with ``restored``, null where nothing is restorable.

    Null and empty texts are never affected. A text is examined whole. Repeated rows each come out. Where several originals
    explain a word, the most frequent one is taken, then the greatest. A column ``copies`` says how often a text occurs.
    """
    keys = [c for c in texts.columns if c != "text"]
    candidates = texts.filter(F.col("text").rlike(NON_ASCII))
    words = cut(garbled_words(candidates.select("text", *[c for c in keys if c == "copies"]), references or []))
    best = words.groupBy("piece", "form").agg(F.max_by("orig", F.struct(F.col("orig").isNotNull(), "orig_n", F.col("orig"))).alias("orig"))
    exploded = candidates.select("*", F.explode(_text_pieces(F.col("text"))).alias("piece"))
    hits = exploded.join(best, "piece").filter(F.col("text").contains(F.col("form")))
    grouped = hits.groupBy(*keys, "text").agg(F.collect_set(F.struct(F.length("form").alias("len"), "form", "orig")).alias("found"))
    ordered = F.array_sort(F.filter("found", lambda x: x["orig"].isNotNull()), lambda a, b: b["len"] - a["len"])
    restored = F.aggregate(ordered, F.col("text"), lambda t, x: F.replace(t, x["form"], x["orig"]))
    return grouped.select(*keys, "text", F.when(restored != F.col("text"), restored).alias("restored"))
