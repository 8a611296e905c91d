"""Episodes as a map of season to episode numbers, where no numbers mean the whole season: parse, render, test."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST_RANGE = 1000
# Heights that a number behind a dash is taken for, rather than a last episode.
HEIGHTS = {480, 576, 720, 1080, 2160}

_SEASON = r"(?:(?:18|19|20)\d{2}|\d{1,2})"
_SPAN = rf"(?P<{{0}}>{{1}})(?:\s?-\s?(?:[{{2}}]\s?)?(?P<{{0}}_to>{{1}})|(?P<{{0}}_list>(?:\s?,\s?(?:[{{2}}]\s?)?{{1}}\s?)+))?"
_PATTERN = re.compile(
    rf"(?<![^\W_])(?:"
    rf"s?(?P<x_season>\d{{1,2}})x(?P<x>\d{{1,4}})(?:\s?-\s?(?P<x_to>\d{{1,4}}))?"
    rf"|s(?:eason)?[ ._]?{_SPAN.format('s', _SEASON, 'sS')}(?:[ ._-]?e(?:p(?:isode)?)?[ ._]?{_SPAN.format('e', r'\d{1,4}', 'eE')}(?P<more>(?:[ ._]?e\d{{1,4}})*))?)",
    re.I,
)


def _range(start: int, end: int | None, heights: bool = False) -> range:
    if end is None or end < start or end - start > LONGEST_RANGE or heights and end in HEIGHTS and end - start > 300:
        return range(start, start + 1)
    return range(start, end + 1)


def parse_episodes(name: str | None) -> dict[int, list[int]] | None:
    """Season to sorted episodes of the first season or episode mark of a name; None without one."""
    m = _PATTERN.search(name or "")
    if not m:
        return None
    g = m.groupdict()
    number = lambda k: int(g[k]) if g[k] else None
    if g["x"]:
        return {int(g["x_season"]): list(_range(int(g["x"]), number("x_to"), True))}
    first = int(g["s"])
    if not g["e"]:
        listed = [int(x) for x in re.findall(r"\d+", g["s_list"] or "")]
        return {s: [] for s in sorted({*_range(first, number("s_to")), *listed})}
    marked = "e" in m.group(0)[m.start("e") - m.start() :].lower()
    listed = [int(x) for x in re.findall(r"\d+", (g["e_list"] or "") + (g["more"] or ""))]
    return {first: sorted({*_range(int(g["e"]), number("e_to"), not marked), *listed})}


def _ranges(numbers: list[int]) -> list[str]:
    out: list[list[int]] = []
    for n in numbers:
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [f"{a:02d}" if a == b else f"{a:02d}-{b:02d}" for a, b in out]


def render_episodes(episodes: dict[int, list[int]] | None) -> str:
    """'S01-03, S05E01-02,E07': whole seasons as ranges, episodes per season."""
    if not episodes:
        return ""
    whole = sorted(s for s, e in episodes.items() if not e)
    parts = {int(r[:2] if "-" not in r else r.split("-")[0]): f"S{r}" for r in _ranges(whole)}
    for s, e in episodes.items():
        if e:
            parts[s] = f"S{s:02d}" + ",".join(f"E{r}" for r in _ranges(sorted(e)))
    return ", ".join(parts[s] for s in sorted(parts))


@F.pandas_udf(T.MapType(T.IntegerType(), T.ArrayType(T.IntegerType())))
def episodes_of(names: pd.Series) -> pd.Series:
    return names.map(parse_episodes)


@F.pandas_udf(T.StringType())
def episodes_text(names: pd.Series) -> pd.Series:
    return names.map(lambda n: render_episodes(parse_episodes(n)))


def has_episodes(episodes: Column, season: int, numbers: list[int] | None = None) -> Column:
    """Does the map hold the season, and if numbers are given, the whole season or all of them?"""
    here = F.map_contains_key(episodes, F.lit(season))
    if not numbers:
        return here
    got = episodes[season]
    return here & ((F.size(got) == 0) | (F.size(F.array_intersect(got, F.array(*[F.lit(n) for n in sorted(set(numbers))]))) == len(set(numbers))))


def episode_numbers(name: Column) -> Column:
    """struct<season, episode> of the plain SxxEyy form, inside the JVM; nulls without one."""
    s = F.nullif(F.regexp_extract(name, r"(?i)(?:^|[^A-Za-z0-9])s(\d{1,2})e\d{1,4}(?:$|[^A-Za-z0-9])", 1), F.lit("")).cast("int")
    e = F.nullif(F.regexp_extract(name, r"(?i)(?:^|[^A-Za-z0-9])s\d{1,2}e(\d{1,4})(?:$|[^A-Za-z0-9])", 1), F.lit("")).cast("int")
    return F.struct(s.alias("season"), e.alias("episode"))
