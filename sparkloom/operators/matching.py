"""Fuzzy matching of titles: candidates by shared parts and words, edit distance and word overlap, year penalty, first best wins;
retrieval of candidates in passes, and aliases."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.titles import family_key, native_form, native_key, normalized_title, slip_limit, title_family, token_jaccard, year_penalty
from sparkloom.session import cut


#: Edits that are ever allowed.
MOST_SLIPS = 5


def _slips(length: int) -> int:
    """Edits allowed for a title of so many letters: 15 %, rounded up, at most five."""
    return min(MOST_SLIPS, -(-15 * length // 100))


def _segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of so many even parts of a text; the later ones are the longer ones."""
    short, long = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = short + (i >= parts - long)
        out.append((at, n))
        at += n
    return out


def _token_keys(gate: str, words: list[str], least: float) -> list[str]:
    """Keys of which two word sets share one if their overlap is at least ``least``: the whole set where no other set can be so
    close, else as many of its words, in one order, as may be missing, and one more."""
    n = len(words)
    if n * (1 - least) < 1 - 1e-9 and (n + 1) * least > n + 1e-9:
        return [f"{gate}|s|" + " ".join(words)]
    missing = n - math.ceil(least * n - 1e-9)
    return [f"{gate}|w|{w}" for w in sorted(words, key=lambda w: zlib.crc32(w.encode()))[: missing + 1]]


def _title_keys(least: float, query: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(title, key): of two titles that are close enough, a query and a work share a key.

    Titles within t edits share one of t + 1 parts, nearly in place: works give their parts, queries the texts that may be one.
    Titles have to begin with the same word; only queries in Japanese script are free of that, and match their native form too.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            titles, found = [], []
            for raw, title in zip(b["raw"], b["title"]):
                native = native_key(raw)
                words = sorted(set(title.split(" ")))
                out = [f"n|{native}"] if native else []
                head, _, rest = title.partition(" ")
                for gate, text in [("", title)] if native and query else [(head, rest)] if query else [("", title), (head, rest)]:
                    out += _token_keys(gate, words, least)
                    n, off = len(text), len(title) - len(text)
                    if query:
                        t = _slips(len(title))
                        for length in range(max(0, n - t), n + t + 1):
                            shift = n - length
                            for i, (at, size) in enumerate(_segments(length, t + 1)):
                                # no more edits than parts lie before the part that is kept, nor behind it
                                low, high = max(0, at - i, at + shift - (t - i)), min(n - size, at + i, at + shift + t - i)
                                out += {f"{gate}|{t}|{length}|{i}|{text[s : s + size]}" for s in range(low, high + 1)}
                    else:
                        for t in {_slips(q + off) for q in range(max(0, n - MOST_SLIPS), n + MOST_SLIPS + 1) if abs(q - n) <= _slips(q + off)}:
                            out += [f"{gate}|{t}|{n}|{i}|{text[at : at + size]}" for i, (at, size) in enumerate(_segments(n, t + 1))]
                titles += [raw] * len(out)
                found += out
            yield pd.DataFrame({"raw": titles, "key": found})

    return keys


def best_matches(left: DataFrame, right: DataFrame, jaccard: float = 0.9, kind: str | None = None) -> DataFrame:
    """(l_id, r_id, distance, jaccard): for each (l_id, title, year) the best (r_id, title, year), of the same ``kind`` if a column is given.

    Titles are normalised (numerals, articles, scripts). A pair passes if both begin with the same word and its edits are within
    the limit of the query's length or its words overlap by ``jaccard``; a query in Japanese script needs no common first word,
    and equals a work of the same native form at once. Ranked by year penalty, edits, overlap, smaller id. Only titles that share a
    key are compared, each distinct pair once, so a common first word costs nothing. Empty and null titles have no match.
    """
    extra = [kind] if kind else []

    def side(df: DataFrame, ident: str, p: str) -> DataFrame:
        return df.select(F.col(ident), F.col("title").alias(f"{p}raw"), F.col("year").alias(f"{p}y"), *[F.col(c).alias(f"{p}{c}") for c in extra]).filter(F.col(f"{p}raw").isNotNull())

    def keyed(df: DataFrame, p: str, query: bool) -> tuple[DataFrame, DataFrame]:
        raw = df.select(F.col(f"{p}raw").alias("raw")).distinct()
        texts = cut(raw.select("raw", normalized_title("raw").alias("title"), native_form("raw").alias("native")).filter(F.col("title") != ""))
        return texts.select(F.col("raw").alias(f"{p}raw"), F.col("title").alias(f"{p}t"), F.col("native").alias(f"{p}n")), texts.mapInPandas(_title_keys(jaccard, query), "raw string, key string")

    l, r = side(left, "l_id", "l"), side(right, "r_id", "r")
    lt, lk = keyed(l, "l", True)
    rt, rk = keyed(r, "r", False)
    near = lk.select(F.col("raw").alias("lraw"), "key").join(rk.select(F.col("raw").alias("rraw"), "key"), "key").select("lraw", "rraw").distinct()
    near = near.join(lt, "lraw").join(rt, "rraw").withColumn("native", F.coalesce(F.col("ln") == F.col("rn"), F.lit(False)))
    near = near.filter(F.col("native") | F.col("ln").isNotNull() | (F.split_part("lt", F.lit(" "), F.lit(1)) == F.split_part("rt", F.lit(" "), F.lit(1))))
    near = near.withColumn("distance", F.when(F.col("native"), 0).otherwise(F.levenshtein("lt", "rt"))).withColumn("jaccard", F.when(F.col("native"), 1.0).otherwise(F.round(token_jaccard(F.col("lt"), F.col("rt")), 6)))
    fine = near.filter(F.col("native") | (F.col("distance") <= slip_limit(F.col("lt"))) | (F.col("jaccard") >= jaccard)).select("lraw", "rraw", "distance", "jaccard")
    works = r.groupBy("rraw", "ry", *[f"r{c}" for c in extra]).agg(F.min("r_id").alias("r_id"))
    asked = l.select("lraw", "ly", *[f"l{c}" for c in extra]).distinct()
    pairs = asked.join(fine, "lraw").join(works, "rraw").withColumn("penalty", year_penalty(F.col("ly"), F.col("ry"))).filter(F.col("penalty") < 100)
    for c in extra:
        pairs = pairs.filter(F.col(f"l{c}") == F.col(f"r{c}"))
    best = pairs.groupBy("lraw", "ly", *[f"l{c}" for c in extra]).agg(F.min(F.struct("penalty", "distance", (-F.col("jaccard")).alias("j"), "r_id")).alias("b"))
    on = (l["lraw"] == best["lraw"]) & l["ly"].eqNullSafe(best["ly"])
    for c in extra:
        on = on & (l[f"l{c}"] == best[f"l{c}"])
    return l.join(best, on).select("l_id", F.col("b.r_id").alias("r_id"), F.col("b.distance").alias("distance"), (-F.col("b.j")).alias("jaccard"))


# Words that tell too little to search by alone.
WEAK_WORDS = "a an and at de der do du el for in la le les of on or the to und with".split()
#: Candidates of the narrow passes (phrase, all words) and of the broad one (any word), per query.
NARROW, BROAD = 10, 40


def candidates(queries: DataFrame, works: DataFrame, narrow: int = NARROW, broad: int = BROAD) -> DataFrame:
    """(q_id, w_id, step, place): works for each (q_id, kind, title, year) among (w_id, kind, title, year), in the order of the passes.

    Pass 1 finds the query as a phrase, pass 2 all its words, pass 3 any word of some weight; films within a year of the asked one,
    series first within a year and then in any (passes 4 to 6). A work counts in its first pass only. Each pass is a top-k report:
    ``narrow`` or ``broad`` works, those with more words in common first, then the shorter title, then the smaller id.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(normalized_title(c), " "), lambda w: w != ""))
    weighty = lambda ws: F.filter(ws, lambda w: (F.length(w) >= 2) & ~w.isin(*WEAK_WORDS))
    q = queries.filter(F.col("title").isNotNull()).select("q_id", F.col("kind").alias("q_kind"), F.col("year").alias("q_year"), normalized_title("title").alias("q_text"), words("title").alias("q_words")).filter(F.size("q_words") > 0)
    q = q.withColumn("keys", F.when(F.size(weighty(F.col("q_words"))) > 0, weighty(F.col("q_words"))).otherwise(F.col("q_words")))
    w = works.filter(F.col("title").isNotNull()).select("w_id", F.col("kind").alias("w_kind"), F.col("year").alias("w_year"), normalized_title("title").alias("w_text"), words("title").alias("w_words"))
    asked = q.select("q_id", "q_kind", F.explode("keys").alias("word"))
    pairs = asked.join(w.select("w_id", F.col("w_kind").alias("q_kind"), F.explode("w_words").alias("word")), ["q_kind", "word"]).groupBy("q_id", "w_id").agg(F.count("*").alias("common"))
    full = pairs.join(q, "q_id").join(w, "w_id")
    near = F.coalesce(F.abs(F.col("q_year") - F.col("w_year")) <= 1, F.col("q_year").isNull())
    series = F.col("q_kind") == "tv_show"
    full = full.filter(near | series)
    level = F.when(F.concat(F.lit(" "), "w_text", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("q_text"), F.lit(" "))), 1).when(F.size(F.array_except("q_words", "w_words")) == 0, 2).otherwise(3)
    broad_fits = (level < 3) | (F.size("keys") >= 2)
    full = full.filter(broad_fits).withColumn("step", level + F.when(near, 0).otherwise(3))
    place = F.row_number().over(Window.partitionBy("q_id", "step").orderBy(F.col("common").desc(), F.length("w_text"), "w_id"))
    return full.withColumn("place", place).filter(F.col("place") <= F.when(F.col("step").isin(3, 4, 5, 6), broad).otherwise(narrow)).select("q_id", "w_id", "step", "place")


def resolve_aliases(names: DataFrame, aliases: DataFrame, seeds: dict[str, str], least: int = 3) -> DataFrame:
    """(id, ref, how): the work of each (id, parsed, extracted, name): exactly by its parsed title, else by the extracted one, else by
    a seed that the name contains.

    ``aliases``: title, ref; keys shorter than ``least`` are ignored and seeds override them. ``seeds`` is a fixed list of
    abbreviations with their work; the longest that is contained wins.
    """
    spark = names.sparkSession
    fixed = spark.createDataFrame(sorted(seeds.items()), "title string, ref string").withColumn("seed", F.lit(1))
    keyed = aliases.select("title", "ref", F.lit(0).alias("seed")).unionByName(fixed).withColumn("key", title_family("title")).filter(F.length("key") >= least)
    exact = keyed.groupBy("key").agg(F.min_by("ref", F.struct(-F.col("seed"), F.col("ref"))).alias("ref"))
    n = names.select("id", title_family("parsed").alias("k1"), title_family("extracted").alias("k2"), title_family("name").alias("whole"))
    hit = n.join(exact.select(F.col("key").alias("k1"), F.col("ref").alias("r1")), "k1", "left").join(exact.select(F.col("key").alias("k2"), F.col("ref").alias("r2")), "k2", "left")
    spelt = [(family_key(t), ref) for t, ref in sorted(seeds.items(), key=lambda x: (-len(family_key(x[0])), x[0])) if len(family_key(t)) >= least]
    contained = F.lit(None).cast("string")
    for key, ref in reversed(spelt):
        contained = F.when(F.col("whole").contains(key), ref).otherwise(contained)
    how = F.when(F.col("r1").isNotNull() | F.col("r2").isNotNull(), "exact").when(contained.isNotNull(), "seed").otherwise("miss")
    return hit.select("id", F.coalesce("r1", "r2", contained).alias("ref"), how.alias("how"))


#: Vectors of a block of queries and of rows; a pair of blocks is one matrix product.
QUERY_BLOCK, ROW_BLOCK = 256, 2048


def top_by_dot_product(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, rank, similarity): for each (query_id, q) the ``k`` best (vec_id, v), clamped and rounded; ties keep the smaller id.

    A pair of blocks passes on what may be among a query's best after rounding, and only that is shuffled.
    """

    def blocks(df: DataFrame, ident: str, vector: str, length: int) -> DataFrame:
        df = df.filter(F.col(vector).isNotNull())
        n = max(1, -(-df.count() // length))
        return df.groupBy(F.pmod(F.xxhash64(ident), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct(ident, vector)).alias(f"{ident}s")).drop("_b")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qs, rs in zip(b["query_ids"], b["vec_ids"]):
                ids = np.array([r["vec_id"] for r in rs])
                dots = np.array([q["q"] for q in qs]) @ np.array([r["v"] for r in rs]).T
                dots = np.clip(dots, -1.0, 1.0)
                least = np.partition(dots, -k, axis=1)[:, [-k]] - 2e-5 if dots.shape[1] > k else np.full((len(dots), 1), -2.0)
                i, j = np.nonzero(dots >= least)
                yield pd.DataFrame({"query_id": np.array([q["query_id"] for q in qs])[i], "vec_id": ids[j], "similarity": dots[i, j]})

    pairs = blocks(rows, "vec_id", "v", ROW_BLOCK).crossJoin(blocks(queries, "query_id", "q", QUERY_BLOCK))
    best = pairs.mapInPandas(multiply, "query_id long, vec_id long, similarity double").withColumn("similarity", F.round("similarity", 5))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")).cast("long")
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank", "similarity")
