"""Titles, batches and films among fansub names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What bracketed metadata of fansub releases is made of; '#' is a digit, a space an optional separator.
TECHNICAL = (
    "###p ####p ###x### ###x#### ####x### ####x#### 4k uhd sd hd x264 x265 h264 h265 h.264 h.265 hevc avc xvid divx av1 10_bit 8_bit hi10 hi10p bd bd_rip bluray blu-ray dvd dvd_rip web web-dl webdl web_rip webrip hdtv tv remux "
    "cr amzn nf hidive adn funi funimation disney disney+ abema baha bglobal b-global aac ac3 eac3 flac dts dtshd dts-hd opus mp3 dd# ddp# dd#.# ddp#.# mkv mp4 avi ts m2ts multi_sub multi_subs multi-sub multi-subs multiple_subtitle "
    "multiple_subtitles dual_audio dual-audio multi_audio multi-audio audio sub subs subbed dub dubs dubbed raw raws uncensored censored batch complete repack v# final multiple subtitle subtitles"
).split()
LANGUAGE_WORDS = (
    "en eng english ja jap jpn japanese chs cht chinese mandarin cantonese kor korean ita italian spa spanish fr fre french ger german por portuguese rus russian ara arabic tha thai vie vietnamese ind indonesian "
    "pol polish dut dutch swe swedish dan danish nor norwegian fin finnish tur turkish hin hindi tam tamil tel telugu ukr ukrainian"
).split()
FILM_WORDS = ["movie", "the movie", "film", "gekijouban", "gekijou-ban", "劇場版"]
EXTENSIONS = "mkv mp4 avi ts m2ts ogm wmv rmvb".split()

_WORDS = {w.replace("_", " ") for w in TECHNICAL} | {w.replace("_", "") for w in TECHNICAL}
_LANGUAGES = set(LANGUAGE_WORDS)
_BRACKET = re.compile(r"[\[(][^\])]*[\])]")
_RANGE = re.compile(r"(?:^|(?<=[\s._(\[]))\d{1,4}\s*[-~]\s*\d{1,4}(?=$|[\s._)\]])")
_EPISODE = re.compile(r"(?:^|\s)-\s(\d{1,4})(?:v\d)?(?=\s|$|[\[(.])")


def _technical_word(word: str) -> bool:
    low = re.sub(r"\d", "#", word.lower())
    if word.lower() in _WORDS or low in _WORDS or re.fullmatch(r"[0-9a-f]{8}", word.lower()):
        return True
    parts = re.split(r"[,+/ ]", word.lower())
    return all(p in _LANGUAGES for p in parts)


def is_technical(bracket: str, groups: frozenset[str] = frozenset()) -> bool:
    """Is a bracket release metadata: a known group, a technical word as a whole, or mostly technical words, singly or in pairs?"""
    inner = bracket.strip("[]()").strip()
    if not inner or inner.lower() in groups or _technical_word(inner):
        return True
    words = [w for w in re.split(r"[ _.,]", inner) if w]
    hit = [_technical_word(w) for w in words]
    for i in range(len(words) - 1):
        if not (hit[i] and hit[i + 1]) and (_technical_word(f"{words[i]} {words[i + 1]}") or _technical_word(words[i] + words[i + 1])):
            hit[i] = hit[i + 1] = True
    return 2 * sum(hit) > len(words)


def clean_title(name: str | None, absolute: int | None = None, groups: frozenset[str] = frozenset()) -> str:
    """The title of a fansub name, or nothing where it isn't sure.

    Leading technical brackets go; the rest ends at the absolute episode number, if there is one, and at the first technical bracket.
    Other brackets belong to the title. What is left needs three characters and a letter.
    """
    text = name or ""
    while (m := _BRACKET.search(text)) and not text[: m.start()].strip() and is_technical(m.group(), groups):
        text = text[m.end() :]
    if " " not in text:
        text = text.replace("_", " ")
    if absolute and (m := _EPISODE.search(text)):
        text = text[: m.start()]
    for m in _BRACKET.finditer(text):
        if is_technical(m.group(), groups):
            text = text[: m.start()]
            break
    text = re.sub(rf"(?i)\.(?:{'|'.join(EXTENSIONS)})$", "", text)
    text = re.sub(r"(?i)\s*v\d+$", "", text)
    text = " ".join(re.sub(r"[\s._~-]+$", "", _RANGE.sub("", text)).split())
    return text if len(text) >= 3 and any(c.isascii() and c.isalpha() or ord(c) > 127 for c in text) else ""


def clean_titles(name: Column, absolute: Column, groups: tuple[str, ...] = ()) -> Column:
    """``clean_title`` of names with their absolute episodes; ``groups`` are the known groups, whose brackets are no title."""
    known = frozenset(g.lower() for g in groups)

    @F.pandas_udf(T.StringType())
    def cleaned(names: pd.Series, episodes: pd.Series) -> pd.Series:
        return pd.Series([clean_title(n, None if pd.isna(a) else int(a), known) for n, a in zip(names, episodes)])

    return cleaned(name, absolute)


def is_batch(name: Column) -> Column:
    """Several episodes: a range of numbers, a batch mark, or a complete series or season."""
    return name.rlike(r"(?i)[\[(]batch[\])]|complete (?:series|season)") | name.rlike(r"(?:^|[\s._(\[])\d{1,4}\s*[-~]\s*\d{1,4}(?:$|[\s._)\]])")


def is_film(name: Column) -> Column:
    """An explicit film mark."""
    return name.rlike(rf"(?i)(?:^|[\s._\[(-])(?:{'|'.join(map(re.escape, FILM_WORDS))})(?:$|[\s._\])-])")


def with_anime_type(content_type: Column, name: Column, known_group: Column, has_episode: Column) -> Column:
    """The type of a fansub name without one: series by an episode, a season or a batch, film by a film mark, else series."""
    return F.when(content_type.isNotNull() | ~known_group, content_type).when(has_episode | is_batch(name), "tv_show").when(is_film(name), "movie").otherwise("tv_show")
