"""Records that are the same but for formatting: whitespace, case, punctuation and the order of fields.

Byte-identical rows collapse first, with counts; the distinct survivors are brought to a canonical text; a second grouping
on the full canonical text sums the counts. Which words of a name are a field of their own is learnt only among names of
the same letters: a word that stands alone between delimiters in one of them is a field in all of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.lookalike import LETTERS, same_look
from sparkloom.session import cut

_UPPER_LETTERS = {k: v for k, v in LETTERS.items() if k.upper() == k}
_G = r"[\W_]*"  # any formatting inside a field

# The technical fields of release names, as patterns over upper-case text.
FIELDS = [
    rf"S\d{{1,4}}{_G}E\d{{1,4}}(?:{_G}E\d{{1,4}})*",
    rf"SEASON{_G}\d{{1,3}}",
    r"S\d{1,2}",
    r"\d{3,4}[PI]",
    r"(?:19|20)\d\d",
    rf"WEB{_G}(?:DL|RIP)|BLU{_G}RAY|B[DR]{_G}RIP|DVD{_G}RIP|HD{_G}TV|REMUX|HDRIP|CAM|DVD\d?",
    rf"[XH]{_G}26[45]|HEVC|XVID|DIVX|AV1|VP9|AVC",
    rf"DDP?\+?{_G}\d{_G}\d|AAC{_G}\d{_G}\d|AC{_G}3|E{_G}AC{_G}3|DTS{_G}HD|DTS{_G}X|DTS|TRUE{_G}HD|ATMOS|OPUS|FLAC|MP3|AAC|OGG|ALAC|24{_G}96|24{_G}192|\d{{2,3}}KBPS",
    r"HDR10\+?|HDR|10BIT|8BIT|SDR|DV",
    rf"PROPER|REPACK|RERIP|INTERNAL|UNCUT|EXTENDED|UNRATED|REMASTERED|LIMITED|READNFO|SUBBED|DUBBED|MULTI|NORDIC|VOSTFR|DUAL{_G}AUDIO|RUS|ITA|GERMAN|FRENCH|SPANISH|ENG|JPN|KOR",
    rf"VOL{_G}\d+|DIS[CK]{_G}\d+|ORIGINAL{_G}SCORE|SOUNDTRACK|OST",
    rf"V\d+(?:{_G}\d+)+",
    r"WIN|LINUX|MACOS|X64|X86|PORTABLE",
    r"PDF|EPUB|CBZ|CBR|MOBI|AUDIOBOOK",
    r"(?=[0-9A-F]*\d)[0-9A-F]{8}",
]
# File extensions that end a name.
EXTENSIONS = r"MKV|MP4|AVI|TS|M2TS|WMV|MOV|WEBM|MPG|ISO|ZIP|RAR|7Z|EXE|DMG|M4B|SRT"
_FIELD = re.compile(rf"(?<![^\W_])(?:{'|'.join(FIELDS)})(?![^\W_])|(?<=[._ \-])(?:{EXTENSIONS})$")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_HARD = re.compile(r"[\[\](){}|~;,]| / ")
# Articles, which stand alone in inverted titles without being a field, and short numerals, which belong to titles.
ARTICLES = set("A AN THE LE LA LES UN UNE DES DER DIE DAS DEN DEM EIN EINE EL LOS LAS UNA UNOS UNAS IL LO GLI I O OS AS UM UMA HET DE EEN DET EN ETT".split())
NUMERALS = set("II III IV V VI VII VIII IX X".split())


def _may_be_field(word: str) -> bool:
    """May a word that stands alone between delimiters be a field of its own? Not a letter, an article or a short number."""
    return len(word) >= 2 and word not in ARTICLES and word not in NUMERALS and not (word.isdigit() and len(word) < 4)


def _upper(name: str) -> str:
    """Upper case with look-alikes as Latin; words wholly of another script keep it but for capitals that look Latin."""
    out = []
    for w in re.split(r"([\W_]+)", name):
        if not w.isascii():
            foreign = sum(c in LETTERS for c in w)
            plain = sum(c.isascii() for c in w)
            if foreign and plain:
                w = same_look(w)
            w = "".join(_UPPER_LETTERS.get(c, c) for c in same_look_but_letters(w).upper())
            w = same_look(w)
        out.append(w.upper())
    return "".join(out)


def same_look_but_letters(text: str) -> str:
    """Widths, spaces, invisible characters and accents made uniform, letters of other scripts kept."""
    import unicodedata

    kept = "".join(c if c in LETTERS else same_look(c) if not unicodedata.combining(c) else c for c in unicodedata.normalize("NFC", text))
    return unicodedata.normalize("NFC", kept)


def _parse(name: str) -> tuple[list[str], list[list[str]], set[str]]:
    """(technical fields, runs of other words, words that stand alone as a field)."""
    text = _upper(same_look_but_letters(name))
    fields, runs, alone, run = [], [], set(), []
    hard_before = True

    def close(hard: bool) -> None:
        nonlocal run, hard_before
        if run:
            if len(run) == 1 and hard and hard_before and _may_be_field(run[0]):
                alone.add(run[0])
            runs.append(run)
        run, hard_before = [], hard

    at = 0
    spans = [(m.start(), m.end()) for m in _FIELD.finditer(text)] + [(len(text), len(text))]
    for start, end in spans:
        gap = text[at:start]
        pos = 0
        for w in _WORD.finditer(gap):
            if _HARD.search(gap, pos, w.start()) if pos < w.start() else None:
                close(True)
            run.append(re.sub(r"[\W_]+", "", w.group()))
            pos = w.end()
        close(True)
        if end > start:
            fields.append(re.sub(r"[\W_]+", "", text[start:end]))
        at = end
    return fields, runs, alone


def _canonical(fields: list[str], runs: list[list[str]], alone: set[str]) -> str:
    """Sorted fields, then the remaining words in their order without gaps."""
    fields, rest = list(fields), []
    for run in runs:
        lo, hi = 0, len(run)
        while lo < hi and run[lo] in alone:
            fields.append(run[lo])
            lo += 1
        while hi > lo and run[hi - 1] in alone:
            fields.append(run[hi - 1])
            hi -= 1
        rest.extend(run[lo:hi])
    return " ".join(sorted(fields)) + "|" + "".join(rest)


def _letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        parsed = [_parse(n) for n in b["text"]]
        letters = ["".join(sorted("".join(f) + "".join(w for r in runs for w in r))) for f, runs, _ in parsed]
        yield b.assign(letters=letters, alone=[sorted(a) for _, _, a in parsed], fields=[f for f, _, _ in parsed], runs=[r for _, r, _ in parsed])


def _canonicals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        canonical = [_canonical(f, r, set(a)) for f, r, a in zip(b["fields"], b["runs"], b["alone"])]
        yield b[["text", "copies", "first", "last"]].assign(canonical=canonical)


def canonical_names(rows: DataFrame, text: str = "name", key: str | None = None, shared_only: bool = False) -> DataFrame:
    """(text, copies, first, last, canonical) per distinct non-null text; ``copies`` counts its byte-identical rows, ``first`` and
    ``last`` are its smallest and greatest ``key`` (null without one).

    Each distinct text is parsed once. ``shared_only`` leaves out texts whose letters no other row has, as they can't be the same
    as any. Names without any letter or digit share the canonical text '|'. Long names are read whole.
    """
    raw = rows.select(F.col(text).alias("text"), (F.col(key) if key else F.lit(None).cast("string")).alias("k")).filter(F.col("text").isNotNull())
    distinct = raw.groupBy("text").agg(F.count("*").alias("copies"), F.min("k").alias("first"), F.max("k").alias("last"))
    kind = raw.schema["k"].dataType.simpleString()
    parsed = distinct.mapInPandas(_letters, f"text string, copies long, first {kind}, last {kind}, letters string, alone array<string>, fields array<string>, runs array<array<string>>")
    lettered = cut(parsed.withColumn("letters", F.md5("letters")))
    if shared_only:
        shared = lettered.groupBy("letters").agg(F.count("*").alias("texts"), F.max("copies").alias("most")).filter("texts > 1 or most > 1")
        lettered = lettered.join(shared.select("letters"), "letters", "left_semi")
    learnt = lettered.select("letters", F.explode("alone").alias("word")).distinct().groupBy("letters").agg(F.collect_list("word").alias("alone"))
    known = lettered.drop("alone").join(learnt, "letters", "left").select("text", "copies", "first", "last", "fields", "runs", F.coalesce("alone", F.array().cast("array<string>")).alias("alone"))
    return known.mapInPandas(_canonicals, f"text string, copies long, first {kind}, last {kind}, canonical string")


def collapse_formatting(rows: DataFrame, text: str = "name") -> DataFrame:
    """(canonical, name, n_copies, n_spellings): one record per name, whatever its formatting. ``name`` is the smallest spelling."""
    names = canonical_names(rows, text)
    return names.groupBy("canonical").agg(F.min("text").alias("name"), F.sum("copies").alias("n_copies"), F.count("*").alias("n_spellings"))


def formatting_pairs(rows: DataFrame, key: str = "info_hash", text: str = "name", unsound: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key_a, key_b): the smallest key of each group of names that differ only in formatting, with each other key of it.

    ``unsound`` gives, of a frame (text, copies) of distinct names that share a canonical text with another row, those to leave
    out. A row that is repeated with its key repeats its pair.
    """

    def groups(names: DataFrame) -> DataFrame:
        return names.groupBy("canonical").agg(F.min("first").alias("a"), F.max("last").alias("z")).filter("a < z").select("canonical", "a")

    names = cut(canonical_names(rows, text, key, shared_only=True))
    if unsound is not None:
        names = cut(names.join(groups(names), "canonical").drop("a"))
        names = names.join(unsound(names.select("text", "copies")).select("text"), "text", "left_anti")
    of = names.join(groups(names), "canonical").select("text", "a")
    keyed = rows.select(F.col(key).alias("k"), F.col(text).alias("text")).join(of, "text")  # one row a text on the right: a hot text is split
    return keyed.filter("k <> a").select(F.col("a").alias(f"{key}_a"), F.col("k").alias(f"{key}_b"))
