"""Languages of names and codes, and what a name says of its audio."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The languages told apart, codes that differ from the ISO terminology codes, and spellings besides code and name.
CODES = "af ar az be bg bs ca ce co cs cy da de el en es et eu fa fi fr he hi hr hu hy id is it ja ka ko ku lt lv mi mk ml mn ms mt nl no pl pt ro ru sa sk sl sm so sr sv ta th tr uk vi yi zh zu".split()
BIBLIOGRAPHIC = {"cs": "cze", "fr": "fre", "nl": "dut", "ro": "rum", "zh": "chi"}
SPELLINGS = {
    "bg": ["bbgaudio"], "ca": ["valencian", "catalán"], "cs": ["cz"], "en": ["ing"], "es": ["castilian", "castellano", "español", "esp", "latino", "lat"], "fr": ["fr", "vf", "vf2", "vff", "vfq", "truefrench"],
    "he": ["hebdub"], "hu": ["hundub"], "nl": ["flemish"], "ro": ["moldavian", "moldovan", "rodubbed"], "zh": ["cn", "mandarin", "cantonese", "简", "繁", "字幕"],
}


@lru_cache(maxsize=4)
def spellings(spark: SparkSession) -> dict[str, str]:
    """Lower-case spelling to code: three-letter codes and English names by the JVM's locale data, and the fixed spellings."""
    locale = spark._jvm.java.util.Locale
    out: dict[str, str] = {}
    for code in CODES:
        own = locale.forLanguageTag(code)
        names = [BIBLIOGRAPHIC.get(code) or own.getISO3Language(), own.getDisplayLanguage(locale.ENGLISH).lower(), *SPELLINGS.get(code, [])]
        for name in names:
            out.setdefault(name, code)
    return out


def parse_language(spark: SparkSession, text: Column) -> Column:
    """The two-letter code that a code, name or spelling stands for; null for anything else."""
    low = F.lower(text)
    known = F.create_map(*[F.lit(x) for kv in sorted(spellings(spark).items()) for x in kv])
    return F.when(low.isin(*CODES), low).otherwise(known[low])


def languages_in(spark: SparkSession, name: Column) -> Column:
    """Sorted codes of the languages that a name says, by name, three-letter code, spelling, or a code with 'dub'; none is an empty array."""
    table = spellings(spark) | {f"{c}dub": c for c in CODES}
    words = "|".join(re.escape(w) for w in sorted(table, key=lambda w: (-len(w), w)))
    found = F.regexp_extract_all(F.lower(name), F.lit(rf"(?<![\p{{L}}\p{{N}}_])({words})(?![\p{{L}}\p{{N}}_])"), 1)
    known = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: known[w])))


# Words of dubbed and subtitled releases; a space stands for an optional separator.
FOREIGN_AUDIO = ["dublado", "lektor", "dubbing.pl", "pldub", "pl-dub", "truefrench", "vff", "vfq", "vfi", "vf2", "castellano", "dublaj"]
FOREIGN_SUBTITLES = ["vostfr", "legendado", "napisy", "nlsubbed", "nlsubs", "swesub", "dksub", "norsub", "finsub", "italiansubs", "subspedia", "altyazili"]
DUB_LANGUAGES = "hindi tamil telugu kannada malayalam bengali french german spanish castellano italian portuguese russian polish arabic latino turkish".split()
SUB_LANGUAGES = [x for x in DUB_LANGUAGES if x != "turkish"]
ENGLISH_EVIDENCE = ["eng", "english", "en", "multi"]


def _alone(name: Column, words: list[str]) -> Column:
    """Does one of the words stand between characters that are no ASCII letters?"""
    return name.rlike(rf"(?i)(?<![a-z])(?:{'|'.join(map(re.escape, words))})(?![a-z])")


def generic_audio(name: Column) -> Column:
    """Several audio tracks that aren't named."""
    return name.rlike(r"(?i)(?:dual|multi)[ ._-]?audio|\[dual\]")


def _not_english(name: Column) -> Column:
    return name.rlike(rf"(?i)(?:{'|'.join(SUB_LANGUAGES)})[ ._-]{{0,2}}(?:dub|sub)(?:bed)?s?\b")


def audio_signal(name: Column) -> Column:
    """An English audio track is said: by name, in the list of a dual release, or a bare 'dubbed' without another language."""
    named = name.rlike(r"(?i)(?:dual|multi)[ ._-]?audio[ ._:=-]*[\[(][^\])]*\b(?:eng|english|en)\b[^\])]*[\])]")
    return name.rlike(r"(?i)eng(?:lish)?[ ._-]?dub|\[(?:eng)?dub\]") | named | (name.rlike(r"(?i)\bdubbed\b") & ~_not_english(name))


def subtitle_signal(name: Column) -> Column:
    """English or several subtitles are said, or a bare 'subbed' without another language."""
    said = name.rlike(r"(?i)(?:eng(?:lish)?|multi|soft)[ ._-]?subs?|multiple[ ._-]?subtitle|[\[(](?:eng)?subs?[\])]")
    return said | (name.rlike(r"(?i)\bsubbed\b") & ~_not_english(name))


def english_audio(is_anime: Column, audio: Column, subtitles: Column) -> Column:
    """'dub' or 'sub' of an anime release by its signals, audio first; null without one and for anything else."""
    return F.when(is_anime & audio, "dub").when(is_anime & subtitles, "sub")


def foreign_audio_only(name: Column) -> Column:
    """A name that says another audio track and nothing of an English one. Unnamed audio tracks leave that open, as do subtitles."""
    compound = name.rlike(rf"(?i)(?:{'|'.join(DUB_LANGUAGES)})[ ._-]{{0,2}}dub(?:bed)?s?\b")
    said = _alone(name, FOREIGN_AUDIO) | compound
    open_ = reduce(lambda a, b: a | b, [generic_audio(name), _alone(name, ENGLISH_EVIDENCE), audio_signal(name), subtitle_signal(name)])
    return said & ~open_


def explicit_foreign_track(name: Column) -> Column:
    """A name that says another audio or subtitle language at all."""
    return _alone(name, FOREIGN_AUDIO + FOREIGN_SUBTITLES) | name.rlike(rf"(?i)(?:{'|'.join(DUB_LANGUAGES)})[ ._-]{{0,2}}dub(?:bed)?s?\b") | _not_english(name)
