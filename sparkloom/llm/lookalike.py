"""One form for text that looks the same: width, combining accents, invisible characters, odd spaces, look-alike letters.

Distinct texts are exploded to positioned code points, which a broadcast join maps to their decomposition and their
look-alike Latin letter; combining marks are ordered by class, segments of a base and its marks are recomposed by a second
broadcast join, and the strings are rebuilt. Both tables are bounded by the Unicode repertoire. Distinct texts are spread by
hash over all cores, and all later steps keep that partitioning, so the exploded rows are never shuffled.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import cut, spread

# Letters of other scripts and the Latin letters that they are mistaken for.
CYRILLIC = dict(zip("аеорсухіѕјӏԁԛԝһѵАВЕКМНОРСТУХІЅЈӀԌԚԜҮ", "aeopcyxisjldqwhvABEKMHOPCTYXISJIGQWY"))
GREEK = dict(zip("ονϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ovjABEZHIKMNOPTYXCj"))
OTHER = dict(zip("ոսօցɡɑıⲟⲣΙꓐꓑꓓꓔꓖꓗꓙꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "nuoggaıopIBPDTGKJCFMNLSRVHWXYAEIOU"))
LETTERS = {k: v for k, v in (CYRILLIC | GREEK | OTHER).items() if k != v}
# Signs that differ from an ASCII sign in name only.
SIGNS = {"‐": "-", "‑": "-", "⁃": "-", "․": ".", "‚": ",", "∕": "/", "⁄": "/", "∶": ":", "꞉": ":", "˸": ":", "⁓": "~", "∼": "~", "ǀ": "|", "∣": "|", "⧸": "/", "＂": '"'}
#: Kinds of compatibility mapping that leave the look of a letter alone.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Selectors and fillers that show nothing, besides all format characters.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x180F)}


#: Letters that the public data count as look-alikes though they are told apart by sight: without its dot, i is another letter.
TOLD_APART = "ı"


@lru_cache(maxsize=4)
def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters and the ASCII letters they are mistaken for: ``LETTERS``, and by the Unicode data on confusable characters every
    cased letter of any script whose skeleton is that of an ASCII letter.

    The data come with the ICU library that Spark ships. Where I and l share a skeleton, the case of the letter decides.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    cased = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) in ("Lu", "Ll") and not unicodedata.decomposition(c) and c not in TOLD_APART]
    ascii_letters = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    skeletons = checker.getSkeleton("\n".join(cased + ascii_letters)).split("\n")
    of: dict[tuple[str, bool], str] = {}
    for c, s in zip(ascii_letters, skeletons[len(cased) :]):
        of[s, c.isupper()] = c
    out = {}
    for c, s in zip(cased, skeletons):
        plain = of.get((s, c.isupper())) or of.get((s, not c.isupper()))
        if plain:
            out[c] = plain
    return out | LETTERS


@lru_cache(maxsize=None)
def expand(ch: str) -> str:
    """What a character is made of: nothing if invisible, a space for any space, else decomposed and look-alikes replaced."""
    return expand_by(ch, LETTERS)


def expand_by(ch: str, letters: dict[str, str]) -> str:
    c = ord(ch)
    if unicodedata.category(ch) == "Cf" or c in INVISIBLE:
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch in letters or ch in SIGNS:
        return letters.get(ch) or SIGNS[ch]
    if 0xAC00 <= c <= 0xD7A3:
        return ch
    d = unicodedata.decomposition(ch)
    if not d:
        return ch
    parts = d.split(" ")
    if parts[0][0] == "<":
        text = "".join(chr(int(x, 16)) for x in parts[1:])
        same = parts[0] in SAME_LOOK or parts[0] == "<compat>" and (text.isalpha() or text.isspace())
        if not same:
            return ch
    else:
        text = "".join(chr(int(x, 16)) for x in parts)
    return "".join(expand_by(x, letters) for x in text)


def joins_previous(ch: str) -> bool:
    """Combining marks, and the vowels and finals of a Hangul syllable, belong to the character before."""
    return unicodedata.combining(ch) > 0 or 0x1161 <= ord(ch) <= 0x1175 or 0x11A8 <= ord(ch) <= 0x11C2


def same_look(text: str) -> str:
    """The form of one text; the reference for the distributed operator and for other per-row code."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(expand(c) for c in text))


@lru_cache(maxsize=4)
def _expansions(spark: SparkSession) -> list[tuple[str, list[tuple[str, int, bool]]]]:
    out, letters = [], look_alikes(spark)
    for c in range(128, sys.maxunicode + 1):
        if 0xD800 <= c <= 0xDFFF:
            continue
        ch = chr(c)
        e = expand_by(ch, letters)
        if e != ch or joins_previous(ch):
            out.append((ch, [(x, unicodedata.combining(x), joins_previous(x)) for x in e]))
    return out


@lru_cache(maxsize=1)
def _compositions() -> list[tuple[str, str]]:
    out = {}
    for c in range(128, sys.maxunicode + 1):
        if 0xD800 <= c <= 0xDFFF:
            continue
        ch = chr(c)
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and unicodedata.normalize("NFC", d) == ch:
            out[d] = ch
            if 0xAC00 <= c <= 0xD7A3 and len(d) == 3:
                out[chr(c - (c - 0xAC00) % 28) + d[2]] = ch
    return sorted(out.items())


def same_look_forms(texts: DataFrame) -> DataFrame:
    """(text, form) for every distinct non-null ``text``; equal forms look the same. Texts of ASCII only are their own form.

    The empty text is its own form, and text of invisible characters only has the empty form. Any length is processed whole.
    """
    spark: SparkSession = texts.sparkSession
    distinct = texts.select("text").filter(F.col("text").isNotNull()).distinct()
    wide = spread(distinct.filter(F.col("text").rlike(r"[^\x00-\x7f]")), "text")
    expansions = F.broadcast(spark.createDataFrame(_expansions(spark), "ch string, parts array<struct<c: string, ccc: int, joins: boolean>>"))
    compositions = spark.createDataFrame(_compositions(), "key string, composed string")

    points = wide.select("text", F.posexplode(F.split("text", "")).alias("pos", "ch")).filter(F.col("ch") != "")
    mapped = points.join(expansions, "ch", "left")
    own = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"), F.lit(False).alias("joins")))
    parts = mapped.select("text", "pos", F.posexplode(F.coalesce("parts", own)).alias("sub", "part")).select("text", "pos", "sub", "part.*")
    order = Window.partitionBy("text").orderBy("pos", "sub")
    before = F.lag("c").over(order)
    hangul = before.between("\u1100", "\u1112") | before.between("\u1161", "\u1175") | before.between("\uac00", "\ud7a3")
    jamo = F.col("c").between("\u1161", "\u11c2")
    parts = parts.withColumn("joins", F.col("joins") & (~jamo | F.coalesce(hangul, F.lit(False))))
    numbered = parts.withColumn("base", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order))
    segments = numbered.groupBy("text", "base").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "c"))), lambda x: x["c"]), "").alias("segment")
    )
    whole = F.broadcast(compositions.select(F.col("key").alias("segment"), F.col("composed").alias("all_of_it")))
    start = F.broadcast(compositions.select(F.col("key").alias("head"), F.col("composed").alias("first_two")))
    composed = segments.join(whole, "segment", "left").withColumn("head", F.substring("segment", 1, 2)).join(start, "head", "left")
    rest = F.expr("substring(segment, 3)")
    piece = F.coalesce("all_of_it", F.when(F.length("segment") > 2, F.concat("first_two", rest)), F.col("segment"))
    rebuilt = composed.groupBy("text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", piece.alias("s")))), lambda x: x["s"]), "").alias("form"))
    forms = wide.join(rebuilt, "text", "left").select("text", F.coalesce("form", F.lit("")).alias("form"))
    return forms.unionByName(distinct.filter(~F.col("text").rlike(r"[^\x00-\x7f]")).select("text", F.col("text").alias("form")))


def _lookalikes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(k, text, form) of the rows whose form holds several different texts."""
    own = rows.select(F.col(key).alias("k"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    wide = F.col("text").rlike(r"[^\x00-\x7f]")
    forms = same_look_forms(own.select("text").filter(wide))
    keyed = cut(own.filter(wide).join(forms, "text").unionByName(own.filter(~wide).withColumn("form", F.col("text"))))
    several = keyed.groupBy("form").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).filter("lo <> hi").select("form")
    return keyed.join(several, "form", "left_semi")


def same_look_classes(rows: DataFrame, key: str = "info_hash", text: str = "name") -> DataFrame:
    """(key, representative): membership of the rows whose text looks like a different text of another row; the representative
    is the smallest key of the class. Linear in the rows, however large a class is. Null texts are in no class."""
    some = cut(_lookalikes(rows, key, text))
    first = some.groupBy("form").agg(F.min("k").alias("representative"))
    return some.join(first, "form").select(F.col("k").alias(key), "representative")


def same_look_pairs(rows: DataFrame, key: str = "info_hash", text: str = "name", unsound: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs (key_a, key_b), smaller key first, of rows whose texts differ but look the same. Null texts have no partner.

    Only forms that hold two different texts are joined, found by a pre-aggregated minimum and maximum; groups of exact
    copies without a disguised member make no pairs. ``unsound`` gives, of a frame (text, copies), the texts to leave out. All
    pairs are rows of the result; ``same_look_classes`` says the same without them.
    """
    some = cut(_lookalikes(rows, key, text))
    if unsound is not None:
        some = some.join(unsound(some.groupBy("text").agg(F.count("*").alias("copies"))).select("text"), "text", "left_anti")
    a, b = some.alias("a"), some.alias("b")
    pairs = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.text") != F.col("b.text")) & (F.col("a.k") < F.col("b.k")))
    return pairs.select(F.col("a.k").alias(f"{key}_a"), F.col("b.k").alias(f"{key}_b"))
