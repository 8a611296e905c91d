"""Mixing sources to target shares of all tokens, with capped repetition.

Every document gets a hash-random key; each source is range-sorted by it, running token sums come from one pass over the
sorted partitions plus partition offsets, and each source is cut at its exact budget, after whole epochs where it is small.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import cut, widen

#: Where the public tokenizer's ranks lie on the driver; the file is shipped to the executors with the job.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level BPE vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER_PATH) -> DataFrame:
    """doc_id, source, n_tokens of every document; null texts have none."""
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(SparkFiles.get(name))
        for b in batches:
            yield b.assign(n_tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]])[["doc_id", "source", "n_tokens"]]

    return widen(documents.select("doc_id", "source", "text")).mapInPandas(count, "doc_id long, source string, n_tokens long")


def _prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    pid, carry = TaskContext.get().partitionId(), {}
    for b in batches:
        sums = b.groupby("source", sort=False)["n_tokens"].cumsum()
        out = b.assign(pid=pid, upto=sums + b["source"].map(carry).fillna(0).astype("int64"))
        for s, last in out.groupby("source", sort=False)["upto"].last().items():
            carry[s] = int(last)
        yield out


def _running_sums(documents: DataFrame, targets: DataFrame, seed: int, path: str) -> DataFrame:
    # counted once: a range sort reads its input twice, for its bounds and for itself
    counted = cut(token_counts(documents, path).filter("n_tokens > 0"))
    known = counted.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")  # targets: a fixed table
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = known.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")).repartitionByRange(parts, "source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id")
    return cut(ordered.mapInPandas(_prefix, "source string, doc_id long, n_tokens long, key long, pid int, upto long"))


def mix_plan(have: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: source, target_share, max_repeats, have, total, budget and ``note``.

    ``have``: source, have (tokens). The total is as large as the caps allow, or ``total_tokens`` where that is less. ``note`` says
    why it is no larger: 'no documents' (a target of some share without any token: the mix is empty), 'asked for more than
    its repeats allow', or 'bounds the total' for the source that does so; null for all others.
    """
    plan = targets.select("source", "target_share", "max_repeats").join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    room = F.when(F.col("target_share") > 0, F.floor(F.col("have") * F.col("max_repeats") / F.col("target_share")))
    plan = plan.withColumn("room", room).withColumn("most", F.min("room").over(Window.partitionBy()))  # one row per target
    asked = F.lit(total_tokens).cast("long")
    plan = plan.withColumn("total", F.coalesce(F.least(asked, F.col("most")), F.lit(0))).withColumn("budget", F.col("target_share") * F.col("total"))
    bound = F.col("room") == F.col("most")
    note = F.when(F.col("room") == 0, "no documents").when(asked > F.col("room"), "asked for more than its repeats allow").when(bound & (asked.isNull() | (asked >= F.col("most"))), "bounds the total")
    return plan.select("source", "target_share", "max_repeats", "have", "total", "budget", note.alias("note"))


def _offsets(running: DataFrame) -> DataFrame:
    totals = running.groupBy("source", "pid").agg(F.sum("n_tokens").alias("in_part"))
    by_source = Window.partitionBy("source")  # one row per partition of the range sort
    return totals.select("source", "pid", (F.sum("in_part").over(by_source.orderBy("pid")) - F.col("in_part")).alias("before"), F.sum("in_part").over(by_source).alias("have"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, path: str = TOKENIZER_PATH) -> DataFrame:
    """(doc_id, source, n_tokens, times): the chosen documents and how often each is used.

    ``targets``: source, target_share, max_repeats. Without ``total_tokens`` the mix is as large as the caps allow. Sources
    without a target, null ones included, are left out; a target without documents makes an empty mix, as no share of it can
    be met (``mix_shares`` names it). Of the document at a cut, that side is taken that is nearer to the budget. Documents
    without tokens are not used.
    """
    return _chosen(_running_sums(documents, targets, seed, path), targets, total_tokens)[0]


def _chosen(running: DataFrame, targets: DataFrame, total_tokens: int | None) -> tuple[DataFrame, DataFrame]:
    offsets = _offsets(running)
    plan = mix_plan(offsets.groupBy("source").agg(F.first("have").alias("have")), targets, total_tokens)
    budgets = plan.filter("have > 0").withColumn("epochs", F.floor(F.col("budget") / F.col("have") + 1e-9)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("have"))
    small = offsets.drop("have").join(budgets, "source")
    placed = running.join(F.broadcast(small), ["source", "pid"])  # at most partitions x sources rows
    upto = F.col("upto") + F.col("before")
    extra = ((upto - F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("epochs") < F.col("max_repeats"))).cast("int")
    return placed.select("doc_id", "source", "n_tokens", (F.col("epochs") + extra).cast("int").alias("times")).filter("times > 0"), plan


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, path: str = TOKENIZER_PATH) -> DataFrame:
    """``mix_shares`` of the mix with the tokens at hand (``have``) and the ``note`` of ``mix_plan`` per target."""
    chosen, plan = _chosen(_running_sums(documents, targets, seed, path), targets, total_tokens)
    return mix_shares(chosen, targets).join(F.broadcast(plan.select("source", "have", "note")), "source")  # one row per target


def mix_shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_documents, n_tokens, actual_share, most_repeats) of a mix, one row per target."""
    used = chosen.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("n_tokens") * F.col("times")).alias("n_tokens"), F.max("times").alias("most_repeats"))
    rows = targets.select("source", "target_share").join(used, "source", "left").fillna(0, ["n_documents", "n_tokens", "most_repeats"])
    total = F.sum("n_tokens").over(Window.partitionBy())  # one row per target
    return rows.select("source", F.round("target_share", 6).alias("target_share"), "n_documents", "n_tokens", F.round(F.coalesce(F.try_divide(F.col("n_tokens"), total), F.lit(0.0)), 6).alias("actual_share"), "most_repeats")
