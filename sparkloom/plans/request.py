"""Criteria of release search, and the translation of an indexer's request to them."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.episodes import has_episodes
from sparkloom.functions.release import FILE_TYPES
from sparkloom.plans.search import Criterion, SearchPlan, all_of, any_of, exists_flag, exists_in, one_of, where

# The claims that can be asked for.
CLAIMS = {
    "hdr_formats": ["HDR", "HDR10", "HDR10_PLUS", "DOLBY_VISION"], "audio_formats": ["TRUEHD", "DTS", "EAC3", "AC3", "AAC", "FLAC", "OPUS"], "audio_features": ["ATMOS", "DTS_X"],
    "revisions": ["PROPER", "REPACK", "READNFO", "INTERNAL"], "encoder": ["x264", "x265"],
    "audio_channels": [f"{n}.{s}" for n in range(1, 10) for s in (0, 1) if (n, s) != (1, 1)] + [f"{n}ch" for n in range(1, 10)],
}
# Category numbers: a family is its hundreds, its members narrow it.
MOVIES, TV, XXX, PC, AUDIO, BOOKS = 2000, 5000, 6000, 4000, 3000, 7000
SD, HD, UHD, MOVIES_3D = (2030, 5030), (2040, 5040), (2045, 5045), 2060
ANIME, AUDIOBOOK, COMICS = 5070, 3030, 7030
HD_RESOLUTIONS = ["720p", "1080p", "1440p", "2160p"]
KINDS_3D = ["V3D", "V3DSBS", "V3DOU"]
FUNCTIONS = {"search": [], "movie": ["movie"], "tvsearch": ["tv_show"], "music": ["music"], "book": ["ebook", "comic", "audiobook"]}


class RequestError(ValueError):
    """A request that can't be translated."""


def release_attribute(field_name: str, value: str, attributes: str = "attributes") -> Criterion:
    """Rows whose release attributes of version 1 hold a claim; an unknown field or value is an error."""
    if value not in CLAIMS.get(field_name, []):
        raise RequestError(f"no such release attribute: {field_name}={value}")
    held = F.col(f"{attributes}.{field_name}")
    found = held == value if field_name in ("encoder", "audio_channels") else F.array_contains(held, value)
    return where((F.col(f"{attributes}.version") == 1) & found)


def month_range(year: int, month: int) -> tuple[date, date]:
    """First day of a month and of the next."""
    return date(year, month, 1), date(year + month // 12, month % 12 + 1, 1)


def year_range(year: int, around: int = 0) -> tuple[date, date]:
    """First day of a year, or of a window of years around it, and the first one behind."""
    return date(year - around, 1, 1), date(year + around + 1, 1, 1)


def released_in(span: tuple[date, date], column: str = "release_date") -> Criterion:
    """Dates from the first day of a span up to, and without, its last."""
    return where((F.col(column) >= F.lit(span[0])) & (F.col(column) < F.lit(span[1])))


def in_collections(refs: list[tuple[str, str, str]], members: DataFrame) -> Criterion:
    """Content that belongs to any of the collections (type, source, id); rows without content never do. ``members``: content_type,
    content_source, content_id, collection_type, collection_source, collection_id."""
    keys = ["content_type", "content_source", "content_id"]
    wanted = any_of(*[where((F.col("collection_type") == t) & (F.col("collection_source") == s) & (F.col("collection_id") == i)) for t, s, i in refs]) if refs else where(F.lit(False))
    return exists_in(wanted.apply(members).select(*keys), *keys)


def extensions_of(file_types: list[str]) -> list[str]:
    """All extensions of some file types, sorted; an unknown type is an error."""
    if unknown := [t for t in file_types if t not in FILE_TYPES]:
        raise RequestError(f"no such file types: {unknown}")
    return sorted(e for t in file_types for e in FILE_TYPES[t])


def with_file_types(rows: DataFrame, files: DataFrame, file_types: list[str], key: str = "info_hash") -> DataFrame:
    """Rows whose own extension, or that of any of their files, is of one of the types."""
    wanted = extensions_of(file_types)
    marked = exists_flag(rows, files.filter(F.col("extension").isin(*wanted)), key, "_has_file")
    return marked.filter(F.col("extension").isin(*wanted) | F.col("_has_file")).drop("_has_file")


@dataclass(frozen=True)
class Profile:
    """Limits, tags and order that an indexer's profile sets."""

    default_limit: int = 100
    max_limit: int = 100
    tags: tuple[str, ...] = ()
    order_by_relevance: bool = True


@dataclass(frozen=True)
class Request:
    """An indexer's search."""

    function: str = "search"
    query: str = ""
    categories: tuple[int, ...] = ()
    season: int | None = None
    episode: int | None = None
    air_date: date | None = None
    imdb_id: str | None = None
    tmdb_id: str | None = None
    limit: int | None = None
    offset: int = 0
    profile: Profile = field(default_factory=Profile)


def _category(cat: int, function: str) -> list[Criterion]:
    family = cat // 1000 * 1000
    if family in (MOVIES, TV):
        kind, own = ("movie", "movie") if family == MOVIES else ("tv_show", "tvsearch")
        out = [one_of("content_type", [kind])] if function != own or cat == family else []
        if cat in SD:
            out.append(one_of("video_resolution", ["480p"]))
        elif cat in HD:
            out.append(one_of("video_resolution", HD_RESOLUTIONS))
        elif cat in UHD:
            out.append(one_of("video_resolution", ["2160p"]))
        elif cat == MOVIES_3D:
            out.append(one_of("video_3d", KINDS_3D))
        elif cat == ANIME:
            out.append(where(F.col("is_anime")))
        return out
    if family == XXX:
        return [one_of("content_type", ["xxx"])]
    if family == PC:
        return [one_of("content_type", ["software", "game"])]
    if family == AUDIO:
        return [one_of("content_type", ["audiobook" if cat == AUDIOBOOK else "music"])]
    if family == BOOKS:
        return [one_of("content_type", ["comic"] if cat == COMICS else ["ebook", "comic", "audiobook"])]
    return []


def plan_request(plan: SearchPlan, request: Request, alternatives: DataFrame | None = None, tags: DataFrame | None = None, relevance: Column | None = None, key: str = "info_hash") -> SearchPlan:
    """``plan`` with the request's criteria, order and page.

    The plan's rows have content_type, content_source, content_id, release_date, episodes, video_resolution, video_3d, is_anime and
    published_at. ``alternatives`` (content_type, content_source, content_id, source, value) are other identifiers, ``tags`` (key,
    name). A date and a season exclude each other: the date wins. An unknown function is an error; so is an id without what it needs.
    """
    if request.function not in FUNCTIONS:
        raise RequestError(f"no such function ({request.function})")
    if types := FUNCTIONS[request.function]:
        plan = plan.with_where(one_of("content_type", types))
    if request.function == "tvsearch":
        if request.air_date is not None:
            plan = plan.with_where(where(F.col("release_date") == F.lit(request.air_date)))
        elif request.season is not None:
            plan = plan.with_where(where(has_episodes(F.col("episodes"), request.season, None if request.episode is None else [request.episode])))
    choices = [all_of(*criteria) for cat in request.categories if (criteria := _category(cat, request.function))]
    if choices:
        plan = plan.with_where(any_of(*choices))
    kind = {"tvsearch": "tv_show"}.get(request.function, "movie")
    ref = ["content_type", "content_source", "content_id"]
    if request.imdb_id is not None:
        if alternatives is None:
            raise RequestError("an alternative id needs the identifiers of content")
        wanted = request.imdb_id if request.imdb_id.startswith("tt") else f"tt{request.imdb_id}"
        plan = plan.with_where(exists_in(alternatives.filter((F.col("content_type") == kind) & (F.col("source") == "imdb") & (F.col("value") == wanted)).select(*ref), *ref))
    if request.tmdb_id is not None:
        plan = plan.with_where(where((F.col("content_type") == kind) & (F.col("content_source") == "tmdb") & (F.col("content_id") == request.tmdb_id)))
    if request.profile.tags:
        if tags is None:
            raise RequestError("a profile with tags needs the tags of torrents")
        plan = plan.with_where(exists_in(tags.filter(F.col("name").isin(*request.profile.tags)), key))
    if request.query:
        plan = plan.with_order((relevance if relevance is not None and request.profile.order_by_relevance else F.col("published_at")).desc_nulls_last(), tie=(key,))
    limit = request.profile.default_limit if request.limit is None else min(request.limit, request.profile.max_limit)
    return plan.with_page(limit, offset=request.offset)
