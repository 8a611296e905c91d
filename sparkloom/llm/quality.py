"""Per-document text statistics and outlier scores that tell natural prose from lists, tables and junk.

Statistics are JVM expressions over whole texts. For each statistic and language, the distinct values are range-partitioned
and sorted; partition totals give offsets, so every value gets its exact rank and both of its empirical tail probabilities.
Values occur in countless documents, so the value table, not the documents, is sorted, and values that hold many documents
are salted when the tails are joined back. The surprises -ln(tail) are combined over the statistics into one outlier score, which
decides what is mostly not prose; a bounded labelled sample gives its weights, none below zero, and its threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import cut, pin, salt_of, widen

#: Words of a language that count as common: those that the most documents of the corpus hold.
COMMON = 64
# The languages told apart; all others and unknown ones form one more group.
KNOWN_LANGUAGES = ["de", "en", "es", "fr"]
# Spellings of language codes.
LANGUAGES = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "esp": "es"}
SALTS = 16
#: At most this many labelled documents are used to fit the classifier.
LABELLED_BOUND = 20_000

STATISTICS = [
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "upper_word_share", "end_mark_line_share", "bullet_line_share", "common_word_share",
    "words_per_line", "sentence_density", "comma_density", "separator_ratio", "distinct_word_share", "vowel_ratio", "short_line_share", "title_word_share", "letter_variety", "gap_share",
]


#: No part of a word stands before.
_BEFORE = r"(?<![\p{L}\p{N}\p{M}])"


def language_of(lang: Column) -> Column:
    """Two-letter code; 'und' where the code is null or unknown."""
    code = F.lower(F.trim(lang))
    code = F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[code], F.substring(code, 1, 2))
    return F.when(code.isin(*KNOWN_LANGUAGES), code).otherwise("und")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def common_words(documents: DataFrame, most: int = COMMON) -> dict[str, list[str]]:
    """Per language, the ``most`` words that the most of all its documents hold; ties go to the smaller word.

    Counts combine before the shuffle, each partition passes on its best ``most``, and only ``most`` words a language are
    collected.
    """
    words = widen(documents.select(language_of(F.col("lang")).alias("language"), "text")).select("language", F.explode(F.array_distinct(_words(F.lower("text")))).alias("word"))
    counts = words.groupBy("language", "word").agg(F.count("*").alias("n"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("language").orderBy(F.col("n").desc(), "word"))).filter(F.col("k") <= most)
    out: dict[str, list[str]] = {}
    for r in best.select("language", "word").orderBy("language", "word").collect():
        out.setdefault(r["language"], []).append(r["word"])
    return out


def text_statistics(documents: DataFrame, common: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, language and the statistics of every document, each rounded to four digits. Null and empty texts have zeros.

    ``common``: common words by language; without it, those of ``documents`` itself.
    """
    common = common_words(documents) if common is None else common
    text = F.coalesce(F.col("text"), F.lit(""))
    n_chars = F.greatest(F.length(text), F.lit(1))
    lines = F.filter(F.split(text, r"\R"), lambda x: F.trim(x) != "")
    full = widen(documents.select("doc_id", language_of(F.col("lang")).alias("language"), text.alias("text")))
    gone = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    base = pin(full, ws=_words(F.lower("text")), ls=lines, nc=n_chars, n_letters=gone(r"\p{L}+"), n_digits=gone(r"\p{N}+"), n_others=gone(r"[\p{M}\s]+"))
    n, m = F.greatest(F.size("ws"), F.lit(1)), F.greatest(F.size("ls"), F.lit(1))

    def count(chars: str) -> Column:
        return F.length("text") - F.length(F.translate("text", chars, ""))

    def share(items: str, test, of: Column) -> Column:
        return F.size(F.filter(items, test)) / of

    out = {
        "n_words": F.size("ws").cast("double"),
        "mean_word_length": F.length(F.array_join("ws", "")) / n,
        "symbol_ratio": (F.length("text") - F.col("n_letters") - F.col("n_digits") - F.col("n_others")) / F.col("nc"),
        "digit_ratio": F.col("n_digits") / F.col("nc"),
        "upper_word_share": F.regexp_count("text", F.lit(rf"{_BEFORE}\p{{Lu}}[\p{{Lu}}\p{{N}}]+(?![\p{{L}}\p{{N}}\p{{M}}])")) / n,
        "end_mark_line_share": share("ls", lambda x: x.rlike(r"[.!?…。！？][\"'”’»)\]]*\s*$"), m),
        "bullet_line_share": share("ls", lambda x: x.rlike(r"^\s*(?:[-*•·#>+]|\d+[.)]|\[[ xX]?\])\s*"), m),
        "common_word_share": reduce(lambda a, kv: F.when(F.col("language") == kv[0], F.size(F.filter("ws", lambda w: w.isin(*kv[1])))).otherwise(a), common.items(), F.lit(0)) / n,
        "words_per_line": n / m,
        "sentence_density": F.size(F.filter(F.split("text", r"(?<=\p{Ll}[.!?…])(?=\s|$)"), lambda x: F.trim(x) != "")) / n,
        "comma_density": count(",;") / n,
        "separator_ratio": count("|\t;/=_:│─┌┐└┘├┤") / F.col("nc"),
        "distinct_word_share": F.size(F.array_distinct("ws")) / n,
        "vowel_ratio": count("aeiouyAEIOUYàâäáãåæèéêëíìîïóòôöõøúùûüœ") / F.greatest(F.col("n_letters"), F.lit(1)),
        "short_line_share": share("ls", lambda x: F.size(F.split(F.trim(x), r"\s+")) <= 4, m),
        "title_word_share": F.regexp_count("text", F.lit(rf"{_BEFORE}\p{{Lu}}\p{{Ll}}")) / n,
        "letter_variety": F.size(F.array_distinct(F.split(F.lower("text"), ""))) / F.log(F.col("nc") + 2.0),
        "gap_share": (F.length("text") - F.length(F.regexp_replace("text", r"\s{2,}", ""))) / F.col("nc"),
    }
    return base.select("doc_id", "language", *[F.round(out[s], 4).alias(s) for s in STATISTICS])


def _ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running document count within a sorted partition, per language and statistic."""
    from pyspark import TaskContext

    pid, carry = TaskContext.get().partitionId(), {}
    for b in batches:
        out = b.assign(pid=pid, upto=b.groupby(["language", "stat"], sort=False)["n"].cumsum())
        for (g, part) in out.groupby(["language", "stat"], sort=False):
            out.loc[part.index, "upto"] += carry.get(g, 0)
            carry[g] = int(out.loc[part.index[-1], "upto"])
        yield out


def tail_probabilities(stats: DataFrame) -> DataFrame:
    """(language, stat, value, n, at_most, at_least): exact shares of the language's documents with a value that small or that large."""
    long = stats.select("language", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATISTICS])).alias("x")).select("language", "x.stat", "x.value")
    counts = long.groupBy("language", "stat", "value").agg(F.count("*").alias("n"))
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.repartitionByRange(parts, "language", "stat", "value").sortWithinPartitions("language", "stat", "value")
    ranked = cut(ordered.mapInPandas(_ranked, "language string, stat string, value double, n long, pid int, upto long"))
    totals = ranked.groupBy("language", "stat", "pid").agg(F.sum("n").alias("in_part"))
    offsets = totals.select("language", "stat", "pid", (F.sum("in_part").over(Window.partitionBy("language", "stat").orderBy("pid")) - F.col("in_part")).alias("before"), F.sum("in_part").over(Window.partitionBy("language", "stat")).alias("total"))
    # at most partitions x languages x statistics rows
    joined = ranked.join(F.broadcast(offsets), ["language", "stat", "pid"])
    upto = F.col("upto") + F.col("before")
    return joined.select("language", "stat", "value", "n", (upto / F.col("total")).alias("at_most"), ((F.col("total") - upto + F.col("n")) / F.col("total")).alias("at_least"))


def outlier_scores(documents: DataFrame) -> DataFrame:
    """doc_id, language, statistics, ``left_<stat>`` and ``right_<stat>`` (-ln of each tail) and ``outlier``: the greater of their sums."""
    stats = cut(text_statistics(documents))
    tails = tail_probabilities(stats)
    hot = F.greatest(F.lit(1), F.when(F.col("at_most") + F.col("at_least") - 1 > 0.01, SALTS).otherwise(1))
    salted = tails.select("language", "stat", "value", (-F.log("at_most")).alias("l"), (-F.log("at_least")).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), hot.alias("k")).filter((F.col("salt") < F.col("k")))
    keyed = tails.select("language", "stat", "value", hot.alias("k")).filter("k > 1").select("language", "stat", "value", F.lit(1).alias("is_hot"))
    long = stats.select("doc_id", "language", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATISTICS])).alias("x")).select("doc_id", "language", "x.stat", "x.value")
    # a value of over one document in a hundred: at most 100 a language and statistic
    marked = long.join(F.broadcast(keyed), ["language", "stat", "value"], "left").withColumn("salt", F.when(F.col("is_hot") == 1, salt_of(F.col("doc_id"), SALTS)).otherwise(0))
    scored = marked.join(salted.drop("k"), ["language", "stat", "value", "salt"])
    wide = scored.groupBy("doc_id", "language").agg(
        *[F.max(F.when(F.col("stat") == s, F.col("l"))).alias(f"left_{s}") for s in STATISTICS],
        *[F.max(F.when(F.col("stat") == s, F.col("r"))).alias(f"right_{s}") for s in STATISTICS],
        F.greatest(F.sum("l"), F.sum("r"), F.sum(F.greatest("l", "r"))).alias("outlier"),
    )
    return wide


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights of zero or more for the tail surprises ``x`` and the threshold of their weighted sum, by projected Newton steps on
    the penalised logistic loss of the labels ``y``."""
    scale = x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), x / scale]
    w = np.zeros(z.shape[1])
    ridge = penalty * len(x) * np.r_[0.0, np.ones(x.shape[1])]

    def loss(v: np.ndarray) -> float:
        m = z @ v
        return float(np.logaddexp(0, m).sum() - y @ m + (ridge * v * v).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        free = np.flatnonzero((w > 0) | (grad < 0) | (np.arange(len(w)) == 0))
        part = z[:, free]
        step = np.linalg.solve((part * (p * (1 - p) + 1e-6)[:, None]).T @ part + np.diag(ridge[free] + 1e-9), grad[free])
        size, now = 1.0, loss(w)
        while size > 1e-4:
            new = w.copy()
            new[free] -= size * step
            new[1:] = np.maximum(new[1:], 0)
            if loss(new) <= now:
                break
            size /= 2
        if size <= 1e-4 or np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[1:] / scale, float(-w[0])


def not_prose(documents: DataFrame, labels: DataFrame, bound: int = LABELLED_BOUND) -> DataFrame:
    """(doc_id, outlier, threshold, p_not_prose, even_outlier) of every document; it is mostly not prose where ``outlier`` > ``threshold``.

    ``labels``: doc_id, text_kind ('prose' or anything else). ``outlier`` is the sum of the document's surprises -ln(tail), each
    times a weight of zero or more; weights and threshold are fitted on at most ``bound`` labelled documents, those with the
    smallest hash of their id. ``even_outlier`` weighs all alike, and ``p_not_prose`` is the logistic of what ``outlier`` is over the
    threshold. Without labels of both kinds, ``outlier`` is the even one and the threshold twice its mean in the language.
    """
    scores = cut(outlier_scores(documents))
    features = [f"{side}_{s}" for s in STATISTICS for side in ("left", "right")]
    sample = labels.select("doc_id", "text_kind").filter(F.col("text_kind").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    train = scores.join(sample, "doc_id").select("text_kind", *features).toPandas()
    y = (train["text_kind"] != "prose").to_numpy(dtype=float)
    even = F.round("outlier", 6)
    if len(set(y)) < 2:
        means = scores.groupBy("language").agg((2 * F.avg("outlier")).alias("threshold"))  # one row a language
        known = scores.join(F.broadcast(means), "language")
        return known.select("doc_id", even.alias("outlier"), F.round("threshold", 6).alias("threshold"), F.when(F.col("outlier") > F.col("threshold"), 1.0).otherwise(0.0).alias("p_not_prose"), even.alias("even_outlier"))
    weights, threshold = fit_weights(train[features].to_numpy(dtype=float), y)
    total = sum((F.col(f) * F.lit(float(w)) for f, w in zip(features, weights) if w > 0), F.lit(0.0))
    return scores.select("doc_id", F.round(total, 6).alias("outlier"), F.lit(round(threshold, 6)).alias("threshold"), F.round(1 / (1 + F.exp(threshold - total)), 6).alias("p_not_prose"), even.alias("even_outlier"))
