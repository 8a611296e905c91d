"""Has this key been seen before? Golomb-coded sets of the keys of earlier epochs, probed block by block.

Rows are cut into epochs in order of arrival; the distinct keys of each epoch make one set: hashes reduced to a target
range, sorted, and their gaps Rice-coded in blocks of the range. The first row of a key in an epoch probes the blocks of all
earlier epochs that cover its hash; only these are decoded. A miss is certain and needs nothing more; only hits are
confirmed exactly, which also gives the audited rate of wrong answers beside the theoretical one. Memory of a task is bounded
by one block of the range, whose number grows with the keys, whatever the size of an epoch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import cut

#: Bits beyond log2 of the number of all keys: an absent key hits the sets together with probability 2 ** -PRECISION at most.
PRECISION = 10
#: Keys of all epochs per block, about.
BLOCK_KEYS = 65_536
#: Epochs the rows are cut into: the more there are, the fewer repeats fall within one.
EPOCHS = 64

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def full_hash(text: Column) -> Column:
    """The 20 bytes of an info hash as 40 lower-case hex digits, from any spelling; null for anything else.

    Spellings: hex in either case, base32 in either case, with white space around, '0x' or URN prefixes, within a magnet
    link, quoted or bracketed, or with separators between digits.
    """
    bare = F.regexp_replace(text, r"[\s\x{0}\x{a0}\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]+", "")
    bare = F.regexp_replace(bare, r"(?i)^.*(?:btih:|sha1:|xt=)", "")
    bare = F.regexp_replace(bare, r"(?i)^[\"'<({\[]*(?:0x|\\\\x|sha1:|btih:)?", "")
    bare = F.regexp_replace(bare, r"[&?;#].*$", "")
    bare = F.upper(F.regexp_replace(bare, r"[-:._\"'<>(){}\[\],]", ""))
    chunk = lambda i: F.lpad(F.conv(F.translate(F.substring(bare, i, 8), _BASE32, _DIGITS32), 32, 16), 10, "0")
    # plain hex first: it is nearly every row, and the branches behind it are not evaluated then
    return F.when(text.rlike(r"\A[0-9A-Fa-f]{40}\z"), F.lower(text)).when(bare.rlike("^[0-9A-F]{40}$"), F.lower(bare)).when(bare.rlike("^[A-Z2-7]{32}$"), F.lower(F.concat(*[chunk(i) for i in (1, 9, 17, 25)])))


def encode_gaps(values: np.ndarray, rice: int) -> bytes:
    """Rice code of the gaps of sorted distinct values: first all quotients in unary, then all remainders of ``rice`` bits."""
    gaps = np.diff(values, prepend=0).astype(np.int64)
    q = gaps >> rice
    unary = np.zeros(int(q.sum()) + len(q), dtype=np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    shifts = np.arange(rice - 1, -1, -1, dtype=np.int64)
    low = ((gaps[:, None] >> shifts) & 1).astype(np.uint8).ravel()
    return np.packbits(np.concatenate([unary, low])).tobytes()


def decode_gaps(data: bytes, n: int, rice: int) -> np.ndarray:
    """The values that ``encode_gaps`` packed."""
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8))
    ends = np.flatnonzero(bits)[:n]
    q = np.diff(ends, prepend=-1) - 1
    at = int(ends[-1]) + 1
    low = bits[at : at + n * rice].reshape(n, rice).astype(np.int64)
    weights = 1 << np.arange(rice - 1, -1, -1, dtype=np.int64)
    return np.cumsum((q.astype(np.int64) << rice) + low @ weights)


def build_sets(keys: DataFrame, range_bits: int, block_bits: int) -> DataFrame:
    """(epoch, block, n, rice, data) from (epoch, key): one Golomb-coded block per row. Keys are distinct within an epoch."""
    inner = range_bits - block_bits
    reduced = F.shiftrightunsigned(F.xxhash64("key"), 64 - range_bits)
    rows = keys.select("epoch", F.shiftright(reduced, inner).alias("block"), reduced.bitwiseAND(F.lit((1 << inner) - 1)).alias("r"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.unique(pdf["r"].to_numpy())
        rice = max(1, int(math.log2(max(2.0, 0.69 * (1 << inner) / len(r)))))
        return pd.DataFrame({"epoch": [pdf["epoch"].iat[0]], "block": [pdf["block"].iat[0]], "n": [len(r)], "rice": [rice], "data": [encode_gaps(r, rice)]})

    return rows.groupBy("epoch", "block").applyInPandas(pack, "epoch int, block long, n int, rice int, data binary")


def probe_sets(keys: DataFrame, sets: DataFrame, range_bits: int, block_bits: int) -> DataFrame:
    """(epoch, key, hit): the rows whose reduced hash some set of an earlier epoch holds (``hit``), and the earlier rows of that hash.

    Decodes only blocks that are probed, each once; the earliest epoch of every value decides, so the number of epochs costs
    nothing. Rows whose hash is new when they arrive, and isn't met again, are certainly first and are not passed on.
    """
    inner = range_bits - block_bits
    reduced = F.shiftrightunsigned(F.xxhash64("key"), 64 - range_bits)
    rows = keys.select("epoch", "key", F.shiftright(reduced, inner).alias("block"), reduced.bitwiseAND(F.lit((1 << inner) - 1)).alias("r"))

    def look(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(blocks):
            return pd.DataFrame({"epoch": asked["epoch"], "key": asked["key"], "hit": np.zeros(len(asked), dtype=bool)})[:0]
        values = np.concatenate([decode_gaps(d, n, rice) for n, rice, d in zip(blocks["n"], blocks["rice"], blocks["data"])])
        epochs = np.repeat(blocks["epoch"].to_numpy(), blocks["n"].to_numpy())
        order = np.lexsort((epochs, values))
        held, at = np.unique(values[order], return_index=True)
        since = epochs[order][at]
        r = asked["r"].to_numpy()
        found = np.minimum(np.searchsorted(held, r), len(held) - 1)
        hit = (held[found] == r) & (since[found] < asked["epoch"].to_numpy())
        asked = asked.assign(hit=hit)
        return asked[asked["r"].isin(asked["r"][hit])][["epoch", "key", "hit"]]

    return rows.groupBy("block").cogroup(sets.groupBy("block")).applyInPandas(look, "epoch int, key binary, hit boolean")


class SeenBefore:
    """One run of the operator over (id, hash) rows and earlier keys.

    ``rows``: ``id`` (order of arrival, any long) and ``hash`` (40 hex digits or null); ``known``: ``hash``. Null hashes are no
    keys. With empty tables nothing was seen. A key that holds most rows costs no more: rows are aggregated to the first of
    each epoch and key before anything is shuffled, and the answer is an anti-join on ids.

    The sets decide: a row that no earlier set holds is first, and only hits, with the earlier rows of the same reduced hash,
    go on to the exact confirmation. Repeats within an epoch fall together in the aggregation.
    """

    def __init__(self, rows: DataFrame, known: DataFrame, epochs: int = EPOCHS, precision: int = PRECISION, block_keys: int = BLOCK_KEYS):
        self.rows = rows.filter(F.col("hash").isNotNull()).select("id", F.unhex("hash").alias("key"))
        cuts = sorted(set(rows.approxQuantile("id", [i / epochs for i in range(1, epochs)], 0.1 / epochs))) if epochs > 1 else []
        epoch = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>"), lambda c: c < F.col("id"))) + 1
        firsts = self.rows.groupBy(epoch.cast("int").alias("epoch"), "key").agg(F.min("id").alias("first_id"))
        earlier = known.filter(F.col("hash").isNotNull()).select(F.lit(0).alias("epoch"), F.unhex("hash").alias("key")).distinct()
        self.keys = cut(firsts.unionByName(earlier.withColumn("first_id", F.lit(None).cast("long"))))
        self.sizes = {r["epoch"]: r["n"] for r in self.keys.groupBy("epoch").agg(F.count("*").alias("n")).collect()}  # one row an epoch
        every = max(1, sum(self.sizes.values()))
        self.block_bits = max(0, math.ceil(math.log2(max(1, every / block_keys))))
        self.range_bits = min(62, max(self.block_bits + 1, math.ceil(math.log2(max(2, every))) + precision))
        self.sets = cut(build_sets(self.keys.select("epoch", "key"), self.range_bits, self.block_bits))
        self.candidates = cut(probe_sets(self.keys.select("epoch", "key"), self.sets, self.range_bits, self.block_bits))
        since = self.candidates.groupBy("key").agg(F.min("epoch").alias("since"))
        self.confirmed = self.candidates.filter("hit").join(since, "key").filter("since < epoch").select("epoch", "key")

    def seen(self) -> DataFrame:
        """(id): rows whose key occurred before."""
        again = self.keys.filter("epoch > 0").join(self.confirmed, ["epoch", "key"], "left_anti").select(F.col("first_id").alias("id"))
        return self.rows.select("id").join(again, "id", "left_anti")

    def rates(self) -> DataFrame:
        """One row: probes, hits, confirmed hits, wrong answers, their audited and theoretical rate among absent keys, bits per key,
        and the rows that the exact step moves with the sets (``rows_confirmed``) and would move without them (``rows_without_sets``)."""
        spark = self.rows.sparkSession
        r, size = float(1 << self.range_bits), self.sizes
        told = self.candidates.groupBy("epoch").agg(F.count("*").alias("moved"), F.count_if("hit").alias("hits"))
        right = self.confirmed.groupBy("epoch").agg(F.count("*").alias("confirmed"))
        per = {x["epoch"]: x for x in told.join(right, "epoch", "left").collect()}  # one row an epoch
        probes = hits = confirmed = absent = moved = 0
        expected, before = 0.0, 1.0
        for e in sorted(size):
            x = per.get(e)
            if e > 0:
                sure = (x and x["confirmed"]) or 0
                probes, confirmed, absent = probes + size[e], confirmed + sure, absent + size[e] - sure
                hits += x["hits"] if x else 0
                expected += (size[e] - sure) * (1 - before)
            moved += x["moved"] if x else 0
            before *= 1 - size[e] / r
        wrong = hits - confirmed
        one = [(probes, hits, confirmed, wrong, round(wrong / absent, 8) if absent else 0.0, round(expected / absent, 8) if absent else 0.0, moved, sum(size.values()))]
        out = spark.createDataFrame(one, "probes long, hits long, confirmed long, wrong long, audited_rate double, theoretical_rate double, rows_confirmed long, rows_without_sets long")
        bits = self.sets.agg((F.coalesce(F.sum(F.length("data")), F.lit(0)) * 8).alias("bits"), F.coalesce(F.sum("n"), F.lit(0)).alias("stored"))
        return out.crossJoin(bits).select(  # one row each
            "probes", "hits", "confirmed", "wrong", "audited_rate", "theoretical_rate",
            F.round(F.coalesce(F.try_divide(F.col("bits").cast("double"), F.col("stored")), F.lit(0.0)), 3).alias("bits_per_key"), "rows_confirmed", "rows_without_sets",
        )
