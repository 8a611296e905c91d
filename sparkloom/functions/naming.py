"""Keys and search strings of names: wanted-item keys, fansub marks, and de-duplicated file paths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.episodes import parse_episodes
from sparkloom.functions.fts import tokenize_flat

# Words at which the title of a release name ends.
_STOP = re.compile(r"^(?:\d{3,4}[pi]|web|webrip|bluray|blu|bdrip|brrip|dvdrip|hdtv|remux|x264|x265|h264|h265|hevc|xvid|av1|flac|mp3|aac|proper|repack|internal|multi|complete|season)$")
_MUSIC = re.compile(r"(?i)(?<![a-z0-9])(?:flac|mp3|320kbps|24-96|discography)(?![a-z0-9])")


def wanted_key(name: str | None) -> str | None:
    """'tv:title:s01', 'mv:title:1999' or 'ms:title' of a name; None where no title is left."""
    words = tokenize_flat(name or "")
    episodes = parse_episodes(name)
    title: list[str] = []
    year = None
    for w in words:
        if re.fullmatch(r"s\d{1,4}(?:e\d+)*|\d{1,2}x\d{1,4}", w) or _STOP.match(w) and title:
            break
        if re.fullmatch(r"(?:19|20)\d\d", w) and title:
            year = w
            break
        title.append(w)
    if not title:
        return None
    key = "-".join(title)
    if episodes:
        return f"tv:{key}:s{min(episodes):02d}"
    if year and not _MUSIC.search(name or ""):
        return f"mv:{key}:{year}"
    return f"ms:{key}" if _MUSIC.search(name or "") else f"mv:{key}:"


@F.pandas_udf(T.StringType())
def wanted_keys(names: pd.Series) -> pd.Series:
    return names.map(wanted_key)


def bracket_marks(name: F.Column) -> F.Column:
    """struct<group, absolute_episode, dual_audio, batch> of fansub-style names, inside the JVM."""
    group = F.nullif(F.regexp_extract(name, r"^\s*\[([A-Za-z][A-Za-z0-9 _-]{1,30})\]", 1), F.lit(""))
    number = F.nullif(F.regexp_extract(name, r" - (\d{1,4})(?:v\d)?(?= |\[|\(|\.|$)", 1), F.lit("")).cast("int")
    absolute = F.when(~number.between(1900, 2099) & ~number.isin(480, 576, 720, 1080, 2160), number)
    return F.struct(group.alias("group"), absolute.alias("absolute_episode"), name.rlike(r"(?i)dual[ ._-]?audio|multi[ ._-]?audio").alias("dual_audio"), name.rlike(r"(?i)[\[(]batch[\])]").alias("batch"))


def _own_part(stem: str, before: str) -> str:
    """A path's stem without the start and end that it shares with the one before it, in whole words."""
    a = 0
    while a < min(len(stem), len(before)) and stem[a] == before[a]:
        a += 1
    b = 0
    while b < min(len(stem), len(before)) - a and stem[-1 - b] == before[-1 - b]:
        b += 1
    while 0 < a < len(stem) and stem[a - 1].isalnum() and stem[a].isalnum():
        a -= 1
    while b and stem[len(stem) - b - 1 : len(stem) - b + 1].isalnum():
        b -= 1
    return stem[a : len(stem) - b].strip(" ._-/")


def _stem(path: str) -> str:
    return re.sub(r"\.[A-Za-z0-9]{1,5}$", "", path)


def search_strings(paths: list[str]) -> str:
    """File paths in order, each without the start and end that it shares with the one before it."""
    out, before = [], ""
    for p in paths:
        stem = _stem(p)
        if part := _own_part(stem, before):
            out.append(part)
        before = stem
    return " ".join(out)


def file_search_strings(files: DataFrame, key: str, order: str, path: str) -> DataFrame:
    """(key, text) per group of files, streamed through partitions sorted by key and order: of a group only the path before and the
    text so far are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, before, parts, started, out = None, "", [], False, []
        for b in batches:
            for k, p in zip(b[key], b[path]):
                if started and k != now:
                    out.append((now, " ".join(parts)))
                    before, parts = "", []
                now, started = k, True
                stem = _stem(p or "")
                if part := _own_part(stem, before):
                    parts.append(part)
                before = stem
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=[key, "text"])
                out = []
        if started:
            out.append((now, " ".join(parts)))
        yield pd.DataFrame(out, columns=[key, "text"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select(key, order, path).repartition(n, key).sortWithinPartitions(key, order).mapInPandas(run, f"{key} string, text string")
