"""Passages of held-out items inside a corpus, by winnowed fingerprints that are extended to alignments.

The minimum k-gram hash of every window of w successive k-grams is kept on both sides, so every shared run of k + w - 1
words shares a fingerprint. Corpus fingerprints meet those of the items, and each hit is extended in both directions to the best
local word alignment, within the pass that made it: only the words around hits leave the scan, never the corpus text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import pin, widen

#: Words of a gram and grams of a window: 15 words with one in eight changed keep a run of 5, the guaranteed length.
K, W = 3, 3
#: Fewest item words of a passage, and least alignment score: +1 a word in common, -1 a word changed, dropped or added.
LEAST_WORDS, LEAST_SCORE = 13, 10
#: A table of items of up to this many fingerprints is broadcast; a larger one is joined by shuffle.
BROADCAST_FINGERPRINTS = 500_000


def word_list(text: Column) -> Column:
    """Lower-case words of letters and digits; case, punctuation and layout are gone. Apostrophes join."""
    flat = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}'’]", ""))
    return F.filter(F.split(flat, r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def with_fingerprints(df: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """``df`` with a column ``prints``: winnowed (print, at) of the array column ``words``, by position of the gram; none below k words."""
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - (k - 1)), lambda i: F.struct(F.xxhash64(*[F.get("words", i - 1 + j) for j in range(k)]).alias("print"), (i - 1).alias("at")))
    none = F.array().cast("array<struct<print: bigint, at: int>>")
    with_grams = pin(df, grams=F.when(F.size("words") >= k, grams).otherwise(none))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("grams") - (w - 1))), lambda i: F.array_min(F.slice("grams", i, w)))
    least = pin(with_grams, least=F.when(F.size("grams") > 0, windows).otherwise(none)).drop("grams")
    # successive windows mostly keep the same gram
    return least.withColumn("prints", F.filter("least", lambda x, i: (i == 0) | (x["at"] != F.get("least", i - 1)["at"]))).drop("least")


def best_alignment(a: list[int], b: list[int]) -> tuple[int, int]:
    """(score, item words) of the best local alignment of item ``a`` within document ``b``; ties: the first end."""
    y = np.asarray(b)
    m = len(y)
    j = np.arange(m + 1)
    h = np.zeros(m + 1, dtype=np.int64)
    start = np.zeros(m + 1, dtype=np.int64)  # item position at which the alignment that ends here began
    best, words = 0, 0
    for i, x in enumerate(a):
        up, diag = h - 1, np.empty(m + 1, dtype=np.int64)
        diag[0] = 0
        diag[1:] = h[:-1] + np.where(y == x, 1, -1)
        d_start = np.empty(m + 1, dtype=np.int64)
        d_start[0] = i + 1
        d_start[1:] = np.where(h[:-1] > 0, start[:-1], i)
        take_up = up > diag
        t = np.where(take_up, up, diag)
        s = np.where(take_up, start, d_start)
        t[0] = 0
        low = t <= 0
        t[low] = 0
        s[low] = i + 1
        lifted = t + j
        reach = np.maximum.accumulate(lifted)
        src = np.maximum.accumulate(np.where(lifted == reach, j, 0))
        g = reach - j
        h = np.maximum(g, 0)
        start = np.where(h > 0, s[src], i + 1)
        top = int(h.argmax())
        if h[top] > best:
            best, words = int(h[top]), int(i + 1 - start[top])
    return best, words


def longest_alignment(a: list[int], b: list[int], least_words: int, least_score: int) -> tuple[int, int]:
    """(score, item words) of the longest alignment that begins and ends with a word in common and reaches both limits, else (0, 0).

    The best alignment leaves out edits near its ends; this one keeps them.
    """
    y = np.asarray(b)
    j = np.arange(len(y))
    found = (0, 0)
    for s in range(len(a) - least_words + 1):
        if not (y == a[s]).any():
            continue
        h = np.where(y == a[s], 1, -len(a) - len(y) - 1)
        for i in range(s + 1, len(a)):
            h = np.maximum.accumulate(h + j) - j
            same = y[1:] == a[i]
            diag = h[:-1] + np.where(same, 1, -1)
            words = i + 1 - s
            if words >= least_words and same.any() and (score := int(diag[same].max())) >= least_score:
                found = max(found, (words, score))
            h = np.concatenate(([h[0] - 1], np.maximum(diag, h[1:] - 1)))
    return found[1], found[0]


def best_alignments(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """``best_alignment`` of many (item, document window) pairs at once: one step over the item words of all of them.

    Shorter ones are padded with words that equal nothing, which only lower a score.
    """
    n = max(len(a) for a, _ in pairs)
    m = max(len(b) for _, b in pairs)
    items, texts = np.full((len(pairs), n), -2, dtype=np.int32), np.full((len(pairs), m), -1, dtype=np.int32)
    for k, (a, b) in enumerate(pairs):
        items[k, : len(a)], texts[k, : len(b)] = a, b
    j = np.arange(m + 1, dtype=np.int32)
    h, start = np.zeros((len(pairs), m + 1), dtype=np.int32), np.zeros((len(pairs), m + 1), dtype=np.int32)
    best, words = np.zeros(len(pairs), dtype=np.int32), np.zeros(len(pairs), dtype=np.int32)
    every = np.arange(len(pairs))
    for i in range(n):
        t, s = h - 1, start.copy()
        diag = h[:, :-1] + np.where(texts == items[:, i : i + 1], 1, -1)
        better = diag >= t[:, 1:]
        t[:, 1:] = np.where(better, diag, t[:, 1:])
        s[:, 1:] = np.where(better, np.where(h[:, :-1] > 0, start[:, :-1], i), s[:, 1:])
        t[:, 0] = 0
        low = t <= 0
        t[low], s[low] = 0, i + 1
        lifted = t + j
        reach = np.maximum.accumulate(lifted, axis=1)
        src = np.maximum.accumulate(np.where(lifted == reach, j, 0), axis=1)
        h = np.maximum(reach - j, 0)
        start = np.where(h > 0, np.take_along_axis(s, src, axis=1), i + 1)
        at = h.argmax(axis=1)
        top = h[every, at]
        more = top > best
        best[more], words[more] = top[more], (i + 1 - start[every, at])[more]
    return list(zip(best.tolist(), words.tolist()))


#: Cells of one step over many alignments.
STEP_CELLS = 400_000


def _aligner(least_score: int, least_words: int = 0) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Extend hits to alignments; those whose words in common, in any order, are fewer than the least score can't reach it and are left out."""

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: dict[int, tuple[dict[str, int], np.ndarray, np.ndarray]] = {}
        for b in batches:
            b = b.drop_duplicates(["doc_id", "item_id", "low"])  # the hits of a document follow one another
            found: list[tuple] = []
            for doc, item, window, iw in zip(b["doc_id"], b["item_id"], b["window"], b["item_words"]):
                if item not in items:
                    if len(items) > 5_000:
                        items.clear()
                    ids = {w: n for n, w in enumerate(dict.fromkeys(iw))}
                    a = np.array([ids[w] for w in iw], dtype=np.int32)
                    items[item] = ids, a, np.bincount(a)
                ids, a, counts = items[item]
                words = np.array([ids.get(w, -1) for w in window], dtype=np.int32)
                common = np.bincount(words[words >= 0], minlength=len(counts))
                if np.minimum(common, counts).sum() >= least_score:
                    found.append((doc, item, a, words))
            found.sort(key=lambda x: (len(x[2]), len(x[3])))
            out, at = [], 0
            while at < len(found):
                size = max(1, STEP_CELLS // (len(found[-1][3]) + 1))
                part = found[at : at + size]
                for (doc, item, a, words), (score, span) in zip(part, best_alignments([x[2:] for x in part])):
                    if score >= least_score and span < least_words:
                        longer = longest_alignment(a.tolist(), words.tolist(), least_words, least_score)
                        score, span = longer if longer[1] else (score, span)
                    out.append((doc, item, score, span))
                at += size
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "item_span"])

    return extend


def aligned_pairs(documents: DataFrame, items: DataFrame, k: int = K, w: int = W, least_score: int = 1, least_words: int = 0, broadcast_up_to: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """(doc_id, item_id, score, item_span) of all pairs that share a fingerprint and can reach ``least_score``; a span below ``least_words`` is stretched over edits at its ends where that reaches both.

    ``documents``: doc_id, text; ``items``: item_id, text. Null and empty texts, and texts shorter than a gram, make no pair.
    Repeated rows make one pair. An alignment of any score adds no more words than it has in common, so it stays within the item's
    length of the diagonal of a hit; only that window goes on, cut in the pass that makes the hit. Item tables of more than
    ``broadcast_up_to`` fingerprints are joined by shuffle, with the same result.
    """
    item = pin(items.select("item_id", "text"), item_words=word_list(F.col("text"))).drop("text")
    item_prints = with_fingerprints(item.withColumnRenamed("item_words", "words"), k, w).select("item_id", F.explode("prints").alias("p"), F.size("words").alias("n")).select("item_id", "p.print", F.col("p.at").alias("item_at"), "n")
    docs = pin(widen(documents.select("doc_id", "text").filter(F.length("text") > 0)), words=word_list(F.col("text"))).drop("text")
    low = F.greatest(F.lit(0), F.col("at") - F.col("item_at") - F.col("n"))
    low = low - low % F.col("n")  # hits that lie close share a window
    window = F.slice("words", low + 1, 4 * F.col("n")).alias("window")
    if item_prints.limit(broadcast_up_to + 1).count() <= broadcast_up_to:
        hits = with_fingerprints(docs, k, w).select("doc_id", "words", F.explode("prints").alias("p")).select("doc_id", "words", "p.*").join(F.broadcast(item_prints), "print")
        windows = hits.select("doc_id", "item_id", low.alias("low"), window)
        full = windows.join(F.broadcast(item), "item_id")
    else:
        doc_prints = with_fingerprints(docs, k, w).select("doc_id", F.explode("prints").alias("p")).select("doc_id", "p.*")
        places = doc_prints.join(item_prints, "print").select("doc_id", "item_id", low.alias("low"), "n").distinct()
        full = docs.join(places, "doc_id").select("doc_id", "item_id", "low", F.expr("slice(words, low + 1, 4 * n)").alias("window")).join(item, "item_id")
    made = full.select("doc_id", "item_id", "low", "window", "item_words").mapInPandas(_aligner(least_score, least_words), "doc_id long, item_id long, score int, item_span int")
    return made.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("item_span").alias("item_span"))


def leaked_passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, item_span): documents that hold a passage of an item."""
    return aligned_pairs(documents, items, least_score=LEAST_SCORE, least_words=LEAST_WORDS).filter((F.col("item_span") >= LEAST_WORDS) & (F.col("score") >= LEAST_SCORE))
