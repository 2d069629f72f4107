"""Counting of hashed keys over all documents in bounded steps.

Documents are dealt to *runs* of a bounded number of bytes. A run sends each distinct key that it holds once, in sorted
blobs by ranges of keys (buckets), with its count and its smallest owner. A bucket answers each run, key by key in the
run's own order: how often the key occurs in all runs, and whether another run has a smaller owner. So a key that a third
of all documents share costs one entry a run, never a group of its documents; nothing passes the driver.

There are as many buckets as runs. Up to DIRECT of them a run sends a blob to each. Beyond that, blobs would outgrow the
keys in them, so keys go in two steps: a run sends to about the square root of that many ranges, groups of as many runs
merge what they have for a range, and send it on to the buckets of the range; replies come back by the same way. The blobs
then number about 2 * runs ** 1.5 instead of runs ** 2.

Where the counts only sort out keys that nobody else has, the keys may be the upper ``bits`` of a hash: ``count_bits`` takes
as many as leave about one accidental match in a hundred, whatever the size of the input, and blobs shrink to a third.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Text bytes in a run: what one task holds, several times over, while it works.
RUN_BYTES = 8_000_000
#: Runs (or buckets) of a partition, at most, where the session has fewer partitions.
RUNS_A_TASK = 16
#: Buckets that a run sends a blob to each; with more of them keys go in two steps.
DIRECT = 2_048
NO_ID = np.iinfo(np.int64).max
#: The kind of a reply that is the run's own state, as it sent it.
STATE = -1

#: Bytes of documents that a task packs at once.
PACK_BYTES = 32_000_000
_PACKED = "run int, n int, did binary, known binary, sizes binary, text binary, carried binary"
_PACKED_PA = pa.schema([("run", pa.int32()), ("n", pa.int32()), ("did", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary()), ("carried", pa.binary())])
_KEYS = "bucket int, run int, kind int, n int, keys binary, extra binary, counts binary, owners binary"
REPLY = "run int, kind int, bucket int, n int, total binary, smaller binary"
_REPLY = pa.schema([("run", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("total", pa.binary()), ("smaller", pa.binary())])
_KEYS_PA = pa.schema([("bucket", pa.int32()), ("run", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary())])


def squeeze(x: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unsqueeze(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


@dataclass
class Run:
    """The documents of a run: ids (a null one is NO_ID), which of them are known, and the texts as one byte array."""

    run: int
    did: np.ndarray
    known: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    #: The columns that came along, in the order of the documents.
    carried: pa.Table | None = None

    def doc_ids(self) -> pa.Array:
        return pa.array(self.did, pa.int64(), mask=~self.known)

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)]


def _table_bytes(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(t)
    return sink.getvalue().to_pybytes()


def spread_repeats(run: np.ndarray, did: np.ndarray, texts: list[bytes], n_runs: int, salt: int) -> np.ndarray:
    """The runs of rows, where rows that are equal in id and text, and so all would go to one run, go to one after the other
    from a place on that ``salt`` says. Equal rows never count as smaller than each other: they may be anywhere."""
    order = np.lexsort((did, run))
    close = np.flatnonzero((run[order][1:] == run[order][:-1]) & (did[order][1:] == did[order][:-1]))
    if n_runs == 1 or not len(close):
        return run
    groups: dict[tuple[int, bytes], list[int]] = {}
    for i in np.unique(np.concatenate([order[close], order[close + 1]])).tolist():
        groups.setdefault((int(did[i]), texts[i]), []).append(i)
    run = run.copy()
    for own in groups.values():
        if len(own) > 1:
            run[own] = (int(run[own[0]]) + salt + np.arange(len(own))) % n_runs
    return run


def _packer(n_runs: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack(batches, n_runs)

    return pack


def _pack(batches: Iterator[pa.RecordBatch], n_runs: int) -> Iterator[pa.RecordBatch]:
    """A row for each run that some documents go to, with these compressed."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    flushed = 0

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        run = spread_repeats(t["run"].to_numpy(), t["did"].to_numpy(), t["text"].to_pylist(), n_runs, zlib.crc32(b"%d:%d" % (part, flushed)))
        order = np.argsort(run, kind="stable")
        run, texts = run[order], t["text"].to_pylist()
        did, known = t["did"].to_numpy()[order], np.asarray(t["doc_id"].is_valid())[order]
        cuts = np.flatnonzero(np.diff(run, prepend=-1))
        rest = t.select(t.schema.names[4:]).take(pa.array(order))
        cols: list[list] = [[], [], [], [], [], [], []]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(run)], strict=True):
            own = [texts[i] for i in order[a:b].tolist()]
            row = (int(run[a]), b - a, did[a:b].tobytes(), np.packbits(known[a:b]).tobytes(), np.array([len(x) for x in own], np.int64).tobytes(), zstandard.ZstdCompressor(1).compress(b"".join(own)), _table_bytes(rest.slice(a, b - a)) if rest.num_columns else None)
            for col, x in zip(cols, row, strict=True):
                col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(cols, _PACKED_PA, strict=True)], schema=_PACKED_PA)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= PACK_BYTES:
            yield flush(held)
            held, size, flushed = [], 0, flushed + 1
    if held:
        yield flush(held)


def enough(df: DataFrame, n: int, col: str) -> DataFrame:
    """Dealt by ``col`` to a partition for every RUNS_A_TASK of its ``n`` values, where that is more than the session has."""
    parts = -(-n // RUNS_A_TASK)
    return df.repartition(parts, col) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Packed documents by run (``read_run`` reads them), and the number of runs. A null id is the largest number, a null
    text empty; the columns ``carry`` come along under their places (c0, c1, ...). Rows that share an id, or have none, are
    dealt by their texts, and rows that are equal in both by where they stand; texts travel compressed."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    total = docs.agg(F.coalesce(F.sum(size + 64), F.lit(0)).alias("b")).first()["b"]
    n_runs = max(1, -(-total // run_bytes))
    did = F.col(id_col).cast("long")
    run = F.pmod(F.xxhash64(did, size, text_col), F.lit(n_runs)).cast("int")
    rows = docs.select(run.alias("run"), F.coalesce(did, F.lit(int(NO_ID))).alias("did"), did.alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))
    return enough(rows.mapInArrow(_packer(n_runs), _PACKED), n_runs, "run"), n_runs


def read_run(t: pa.Table, ordered: bool = False) -> Run:
    """What ``_pack`` packed; ``ordered``: by id and text, as shuffles keep no order."""
    rows = t.select(_PACKED_PA.names).to_pylist()
    join = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
    did, size = join("did", np.int64), join("sizes", np.int64)
    known = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r["known"], np.uint8), count=r["n"]).astype(bool) for r in rows)])
    raw = b"".join(zstandard.ZstdDecompressor().decompress(r["text"]) for r in rows)
    out = Run(rows[0]["run"] if rows else 0, did, known, np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(size)]))
    if rows and rows[0]["carried"] is not None:
        out.carried = pa.concat_tables([pa.ipc.open_stream(r["carried"]).read_all() for r in rows])
    if not ordered:
        return out
    order = np.argsort(did, kind="stable")
    texts = out.texts()
    if len(np.unique(did)) < len(did):
        order = np.array(sorted(order.tolist(), key=lambda i: (did[i], texts[i])))
    data = np.frombuffer(b"".join(texts[i] for i in order.tolist()), np.uint8)
    return Run(out.run, did[order], known[order], data, np.concatenate([[0], np.cumsum(size[order])]), None if out.carried is None else out.carried.take(pa.array(order)))


def count_bits(n_runs: int, run_bytes: int = RUN_BYTES) -> int:
    """Bits of a hash that tell the keys of all runs apart, but for about one in a hundred."""
    return min(64, max(32, (n_runs * run_bytes).bit_length() + 4))


def n_ranges(n_buckets: int, direct: int = DIRECT) -> int:
    """Ranges of keys that a run sends to."""
    return n_buckets if n_buckets <= direct else math.isqrt(n_buckets - 1) + 1


def batches(offsets: np.ndarray, size: int = 1_000_000):
    """Ranges of documents of about ``size`` bytes; a longer one is alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def _key_rows(run: int, kind: int, bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray | None, owners: np.ndarray | None, extra: np.ndarray | None) -> pa.Table:
    if not len(keys):
        return _KEYS_PA.empty_table()
    cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] + np.uint64(1)))
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        rows.append({"bucket": int(bucket[a]), "run": run, "kind": kind, "n": int(b - a), "keys": squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), "extra": None if extra is None else extra[a:b].tobytes(), "counts": None if counts is None else squeeze(counts[a:b].astype(np.uint32)), "owners": None if owners is None else squeeze(owners[a:b])})
    return pa.Table.from_pylist(rows, schema=_KEYS_PA)


def _bucket(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    return ((keys >> np.uint64(bits - 32)) * np.uint64(n)) >> np.uint64(32)


def key_rows(run: int, kind: int, n_buckets: int, keys: np.ndarray, counts: np.ndarray | None = None, owners: np.ndarray | None = None, extra: np.ndarray | None = None, bits: int = 64, direct: int = DIRECT) -> pa.Table:
    """``keys``: sorted numbers of ``bits`` bits (with ``extra``, a second hash of 64 or 32 bits, below them). Equal pairs must not
    repeat."""
    return _key_rows(run, kind, _bucket(keys, n_ranges(n_buckets, direct), bits), keys, counts, owners, extra)


def state_row(run: int, state: bytes) -> pa.Table:
    """What a run wants to have next to the replies to it."""
    return pa.Table.from_pylist([{"bucket": -1 - run, "run": run, "kind": STATE, "n": 0, "keys": state}], schema=_KEYS_PA)


def _gather(rows: list[dict]):
    """What the blobs hold, one after the other: keys, second hashes, counts, owners; their order by key, where each
    different key starts in it, and the number of each key's group."""
    keys = np.concatenate([np.cumsum(unsqueeze(r["keys"], np.uint64), dtype=np.uint64) for r in rows])
    counts = np.concatenate([np.ones(r["n"], np.int64) if r["counts"] is None else unsqueeze(r["counts"], np.uint32).astype(np.int64) for r in rows])
    kind = np.uint64 if rows[0]["extra"] is not None and len(rows[0]["extra"]) == 8 * rows[0]["n"] else np.uint32
    extra = None if rows[0]["extra"] is None else np.concatenate([np.frombuffer(r["extra"], kind) for r in rows])
    owners = None if rows[0]["owners"] is None else np.concatenate([unsqueeze(r["owners"], np.int64) for r in rows])
    order = np.argsort(keys, kind="stable") if extra is None else np.lexsort((extra, keys))
    sorted_keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    if extra is not None:
        e = extra[order]
        fresh[1:] |= e[1:] != e[:-1]
    return keys, extra, counts, owners, order, np.flatnonzero(fresh), np.cumsum(fresh) - 1


def _sums(counts: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.minimum(np.add.reduceat(counts[order], starts), 2**32 - 1)


def _replies(rows: list[dict], total: np.ndarray, smaller: np.ndarray | None) -> pa.Table:
    out, at = [], 0
    for r in rows:
        n = r["n"]
        out.append({"run": r["run"], "kind": r["kind"], "bucket": r["bucket"], "n": n, "total": squeeze(total[at : at + n].astype(np.uint32)), "smaller": None if smaller is None else np.packbits(smaller[at : at + n]).tobytes()})
        at += n
    return pa.Table.from_pylist(out, schema=_REPLY)


def _answer(t: pa.Table) -> pa.Table:
    rows = t.to_pylist()
    if rows[0]["kind"] == STATE:
        return pa.Table.from_pylist([{"run": r["run"], "kind": STATE, "bucket": r["bucket"], "n": r["n"], "total": r["keys"]} for r in rows], schema=_REPLY)
    keys, _, counts, owners, order, starts, group = _gather(rows)
    total = np.empty(len(keys), np.int64)
    total[order] = _sums(counts, order, starts)[group]
    smaller = None
    if owners is not None:
        smaller = np.empty(len(keys), bool)
        smaller[order] = np.minimum.reduceat(owners[order], starts)[group] < owners[order]
    return _replies(rows, total, smaller)


def answers(keys: DataFrame, n_buckets: int, bits: int = 64, direct: int = DIRECT) -> DataFrame:
    """The replies to the rows of ``key_rows`` of all runs."""
    if n_buckets <= direct:
        return enough(keys, n_buckets, "bucket").groupBy("bucket").applyInArrow(_answer, REPLY)
    side = n_ranges(n_buckets, direct)
    sent = materialize(keys.withColumn("team", F.expr(f"run div {side}").cast("int")), "keys")

    def combine(t: pa.Table) -> pa.Table:
        """What a team of runs has in one range, each key once, for the buckets of the range."""
        rows = sorted(t.to_pylist(), key=lambda r: r["run"])
        keys, extra, counts, owners, order, starts, _ = _gather(rows)
        first = order[starts]
        least = None if owners is None else np.minimum.reduceat(owners[order], starts)
        return _key_rows(rows[0]["team"], rows[0]["kind"], _bucket(keys[first], side * side, bits), keys[first], _sums(counts, order, starts), least, None if extra is None else extra[first])

    def expand(t: pa.Table, reply: pa.Table) -> pa.Table:
        """The team's reply, dealt to its runs."""
        rows = sorted(t.to_pylist(), key=lambda r: r["run"])
        keys, _, _, owners, order, starts, group = _gather(rows)
        team_total, team_smaller = read_answer(reply, rows[0]["kind"])
        total = np.empty(len(keys), np.int64)
        total[order] = team_total[group]
        smaller = None
        if owners is not None:
            smaller = np.empty(len(keys), bool)
            smaller[order] = team_smaller[group] | (np.minimum.reduceat(owners[order], starts)[group] < owners[order])
        return _replies(rows, total, smaller)

    state = sent.where(F.col("kind") == STATE).select("run", "kind", "bucket", "n", F.col("keys").alias("total"), F.lit(None).cast("binary").alias("smaller"))
    sent = sent.where(F.col("kind") != STATE)
    merged = sent.groupBy("team", "bucket").applyInArrow(combine, _KEYS)
    replies = merged.groupBy("bucket").applyInArrow(_answer, REPLY).withColumns({"team": F.col("run"), "range": F.expr(f"bucket div {side}").cast("int")})
    return sent.groupBy("team", "bucket").cogroup(replies.groupBy("team", "range")).applyInArrow(expand, REPLY).union(state)


def read_answer(t: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Total count, and whether another run has a smaller owner, for the run's keys in their order."""
    rows = sorted((r for r in t.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    if not rows:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    total = np.concatenate([unsqueeze(r["total"], np.uint32) for r in rows])
    smaller = np.concatenate([np.unpackbits(np.frombuffer(r["smaller"], np.uint8), count=r["n"]).astype(bool) if r["smaller"] is not None else np.zeros(r["n"], bool) for r in rows])
    return total, smaller


def key_schema() -> str:
    return _KEYS


def group_spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
