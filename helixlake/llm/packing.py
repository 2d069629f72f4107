"""Best-fit packing with Martello-Toth dominance reduction, decided on the histogram of lengths.

Lengths are whole numbers up to the capacity, so the packing problem is its histogram: at most ``capacity`` counts, however
many documents. The driver plans on these counts alone. The reduction takes the longest length left and fixes it with a
small set of partners whenever that set provably dominates every other choice (nothing fits; an exact fill; only single
partners fit, so the longest one; at most two fit, so the longest one if no pair is longer, or an exact triple with it,
unless two partners that are both longer than its third fit as well). What is left is packed best fit
in decreasing order, all copies of a length at a time. The plan says, for a length and a range of ranks among its copies,
which sequences and which offset they take. Executors number the copies of each length, salted so that a length which
a third of all pieces share is numbered by many tasks, and look their slots up. No text or document passes the driver.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_bpe, default_vocab, materialize, table

CAPACITY = 1024
EOS = 2
#: Pieces that one task numbers, about.
PIECES_A_SALT = 50_000

_PIECES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """Start, length and crc32 of each piece; of a document over the capacity the first piece takes what full ones leave."""
    n = len(ids)
    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
    return [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(cuts, cuts[1:], strict=False)]


def token_pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, eos: int = EOS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document: its ids and ``eos``; a null text has ``eos`` alone."""

    @F.pandas_udf(_PIECES)
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = byte_bpe(vocab)
        for s in texts:
            yield pd.Series([pieces_of(np.array((bpe.encode(t, allowed_special="all") if t else []) + [eos], dtype="<u4"), capacity) for t in s], dtype=object)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(cut(F.col(text_col))).alias("piece", "x"))
    return rows.select("doc_id", "piece", "x.start", "x.length", "x.ids_crc32")


def reduce_and_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The plan for a histogram of lengths: (length, first rank, rank after the last, first sequence, offset)."""
    left = {s: n for s, n in counts.items() if n}
    return _reduce_and_fit(left, capacity)[0]


def _reduce_and_fit(left: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan, and how many of its first sequences the reduction fixed."""
    used: dict[int, int] = defaultdict(int)
    plan: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def fix(sizes: list[int], times: int) -> None:
        nonlocal sequence
        at = 0
        mult: dict[int, int] = defaultdict(int)
        for s in sizes:
            plan.append((s, used[s] + mult[s] * times, used[s] + (mult[s] + 1) * times, sequence, at))
            mult[s] += 1
            at += s
        for s, m in mult.items():
            used[s] += m * times
            left[s] -= m * times
            if not left[s]:
                del left[s]
        sequence += times

    def largest(limit: int, without: dict[int, int]) -> int:
        return max((s for s, n in left.items() if s <= limit and n > without.get(s, 0)), default=0)

    for j in sorted(left, reverse=True):
        while j in left:
            room, own = capacity - j, {j: 1}
            best = largest(room, own)
            few = [s for s in sorted(left)[:3] for _ in range(min(3, left[s] - own.get(s, 0)))][:3]  # smallest partners
            if not best:
                fix([j], left[j])
            elif best == room or sum(few[:2]) > room or len(few) < 2:  # an exact fill, or one partner at most
                fix([j, best], left[j] // 2 if best == j else min(left[j], left[best]))
            elif sum(few) > room or len(few) < 3:  # two partners at most
                pair = _best_pair(left, room, own)
                if best >= sum(pair):
                    fix([j, best], left[j] // 2 if best == j else min(left[j], left[best]))
                elif best == pair[0] and sum(pair) == room and not _fits_two_over(left, room, own, pair[1]):
                    need: dict[int, int] = defaultdict(int)
                    for s in (j, *pair):
                        need[s] += 1
                    fix([j, *pair], min(left[s] // n for s, n in need.items()))
                else:
                    break
            else:
                break  # no set dominates: this length is left to best fit
    fixed = sequence
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, how many)
    for s in sorted(left, reverse=True):
        n = left[s]
        for room in range(s, capacity):
            fits = room // s
            while n and bins.get(room):
                first, m = bins[room].pop()
                full, rest = divmod(n, fits)
                if m <= full:
                    take, t = m, fits
                elif full:
                    take, t = full, fits
                else:
                    take, t = 1, rest
                if take < m:
                    bins[room].append((first + take, m - take))
                for k in range(t):
                    plan.append((s, used[s], used[s] + take, first, capacity - room + k * s))
                    used[s] += take
                n -= take * t
                bins[room - t * s].append((first, take))
            if not n:
                break
        fits = capacity // s
        for m, t in ((n // fits, fits), (1, n % fits)):
            if m and t:
                for k in range(t):
                    plan.append((s, used[s], used[s] + m, sequence, k * s))
                    used[s] += m
                bins[capacity - t * s].append((sequence, m))
                sequence += m
    return plan, fixed


def _fits_two_over(left: dict[int, int], room: int, own: dict[int, int], over: int) -> bool:
    """Whether two partners both longer than ``over`` fit: the third of a triple would not stand for either of them."""
    few: list[int] = []
    for s in sorted(s for s in left if s > over):
        few += [s] * min(2 - len(few), left[s] - own.get(s, 0))
        if len(few) == 2:
            return sum(few) <= room
    return False


def _best_pair(left: dict[int, int], room: int, own: dict[int, int]) -> tuple[int, int]:
    """The pair of lengths, the longer one first, that fills ``room`` best."""
    have = sorted(s for s, n in left.items() if n > own.get(s, 0) and s < room)
    best, i, k = (0, 0), 0, len(have) - 1
    while i <= k:
        a, b = have[i], have[k]
        if i == k and left[a] - own.get(a, 0) < 2:
            break
        if a + b <= room:
            if (a + b, b) > (sum(best), best[0]):
                best = (b, a)
            i += 1
        else:
            k -= 1
    return best


_PLAN = "length long, lo long, hi long, first_sequence long, offset long"


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to ``capacity``; columns of these names are replaced, all
    others are kept. ``pieces`` is written once with the place of each row, from which it is dealt: repeated rows are rows of
    their own, in many tasks. Rows of equal length may swap places; an empty table gives an empty one."""
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    rows = materialize(pieces.select(F.col("length").cast("long").alias("length"), F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # ``capacity`` rows at most
    if counts and (None in counts or min(counts) < 1 or max(counts) > capacity):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan = spark.createDataFrame(reduce_and_fit(counts, capacity), _PLAN)  # grows with the capacity, not with the input
    n_salts = max(1, -(-sum(counts.values()) // PIECES_A_SALT))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(n_salts)))
    counted = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("at")) - 1)
    placed = ranked.join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    slots = F.broadcast(plan.withColumnRenamed("length", "slot_length"))  # bounded by the capacity
    p = placed.join(slots, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return p.select("row.*", (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document. Repeated rows are
    documents of their own; null and empty texts take one id; a null doc_id stays null; other columns don't matter. An empty
    table gives an empty one."""
    return pack(token_pieces(docs, vocab or default_vocab(), capacity), capacity)


def op1_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
