"""Exact substring dedup by a common-prefix-aware distributed merge sort of suffixes.

Removed is each byte that a ``window`` of bytes covers which starts in a document of smaller id as well.

*Anchors.* The smallest hash of ``SEED`` bytes inside a window is its anchor. Equal windows have their anchors at equal
offsets, so windows need comparing only when they share one. Consecutive windows with one anchor form an entry: the suffix
that starts at the anchor, up to the end of the last of these windows, followed by the bytes left of the anchor, read
backwards. Anchors' hashes are counted over all documents first (``exchange``); those that occur once are dropped.

*Merge sort.* Splitters, quantiles of the suffixes of a bounded sample of documents, cut the order of all strings into
ranges, so that the ranges' results are one sorted whole. A run (documents of bounded size) sorts its entries, keeps each
different one once with its smallest owner, and sends each range its part front-coded: the length of the prefix shared with
the entry before, and the rest. A range merges the sorted runs with a loser tree whose nodes keep the prefix length shared
with the last winner: two entries are compared from there on only, so that no known prefix is compared twice, and equal
entries come out next to each other. It answers each run how often its entries occur in all, and whether another run has a
smaller owner. An entry that every document holds costs its range one entry a run, and an anchor that many documents share
is split among ranges by what follows it.

*Windows.* Where an anchor occurs as often as an entry, all windows of it are settled with the entry. Elsewhere (where
repeats begin and end) the entry's windows are counted one by one, by a hash of 96 bits, in the same way as the anchors.

What a run knows of its entries travels with the replies to it, so that nothing is sorted twice. The last step puts the
spans together next to the text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, table
from .exchange import DIRECT, REPLY, RUN_BYTES, STATE, answers, batches, count_bits, group_spans, key_rows, key_schema, n_ranges, read_answer, read_run, runs_of, squeeze, state_row, unsqueeze

WINDOW, SEED = 50, 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_AT = np.uint64((1 << 30) - 1)
_RUN = "bucket int, run int, n int, lcp binary, rest binary, ends binary, owners binary, counts binary"
_RUN_PA = pa.schema([("bucket", pa.int32()), ("run", pa.int32()), ("n", pa.int32()), ("lcp", pa.binary()), ("rest", pa.binary()), ("ends", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])
_REPLY_PA = pa.schema([("run", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("total", pa.binary()), ("smaller", pa.binary())])
_OUT = "doc_id long, did long, text binary, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>"
ANCHORS, ENTRIES, WINDOWS = 0, 1, 2
#: Documents that splitters are taken from (more where ranges are more than that), strings of each and of all at most, and
#: bytes of a splitter.
SAMPLE_DOCS, SAMPLE_STRINGS, ALL_STRINGS, SPLITTER_BYTES = 2_000, 32, 1_000_000, 200


def window_hash(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on, by doubling: O(log size) passes."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    n = len(data) - size + 1
    piece, width = data.astype(np.uint64) + np.uint64(1), 1
    out, have = None, 0
    while True:
        if size & width:
            if out is None:
                out = piece
            else:
                m = min(len(out), len(piece) - have)
                out = out[:m] * np.uint64(pow(int(_BASE), width, 1 << 64)) + piece[have : have + m]
            have += width
        if have == size:
            return mix64(out[:n])
        piece = piece[:-width] * np.uint64(pow(int(_BASE), width, 1 << 64)) + piece[width:]
        width *= 2


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of ``size`` values from each position on."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Entries:
    """The entries of some documents: anchor, first window, last window (positions in ``data``), document, anchor hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, seed: int):
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for lo, hi in batches(offsets):
            base = int(offsets[lo])
            own = data[base : offsets[hi]]
            if len(own) < window:
                continue
            h = window_hash(own, seed)
            # the upper bits decide, then the leftmost position: both depend on the window's bytes alone
            least = sliding_min((h & ~_AT) | np.arange(len(h), dtype=np.uint64), window - seed + 1)
            fits = np.zeros(len(own) + 1, np.int32)
            size = np.diff(offsets[lo : hi + 1])
            long = size >= window
            np.add.at(fits, offsets[lo:hi][long] - base, 1)
            np.add.at(fits, offsets[lo + 1 : hi + 1][long] - base - window + 1, -1)
            p = np.flatnonzero(np.cumsum(fits)[: len(least)])
            at = (least[p] & _AT).astype(np.int64)
            doc = np.searchsorted(offsets[lo : hi + 1] - base, p, "right") - 1 + lo
            if not len(p):
                continue
            fresh = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
            last = np.append(fresh[1:], len(p)) - 1
            for part, x in zip(parts, (at[fresh] + base, p[fresh] + base, p[last] + base, doc[fresh], h[at[fresh]]), strict=True):
                part.append(x)
        kinds = (np.int64,) * 4 + (np.uint64,)
        self.anchor, self.first, self.last, self.doc, self.hash = (np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(parts, kinds, strict=True))

    def take(self, which: np.ndarray) -> Entries:
        out = object.__new__(Entries)
        for k in ("anchor", "first", "last", "doc", "hash"):
            setattr(out, k, getattr(self, k)[which])
        return out


def strings_of(raw: bytes, e: Entries, window: int) -> list[bytes]:
    """Suffix, a byte that no text has, and what is left of the anchor, backwards."""
    return [raw[a : z + window] + b"\xff" + raw[p:a][::-1] + b"\xff" for a, p, z in zip(e.anchor.tolist(), e.first.tolist(), e.last.tolist(), strict=True)]


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the shared prefix, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    lo, hi = at, n
    while hi - lo > 8:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    while a[lo] == b[lo]:
        lo += 1
    return lo


def front_code(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Prefix shared with the string before, and the rest, of sorted strings."""
    lcp = np.zeros(len(strings), np.uint16)
    rest, before = [], b""
    for i, s in enumerate(strings):
        k = common(before, s)
        lcp[i] = k
        rest.append(s[k:])
        before = s
    return lcp, rest


def merge_runs(runs: list[tuple[list[int], list[bytes]]]):
    """Merges front-coded sorted runs: yields (run, index in it, whether equal to the string before).

    A loser tree in which each run keeps its current string and how much of it is shared with the last winner. A run with
    the longer shared prefix is smaller without a look at its bytes; with equal ones the comparison starts after them."""
    k = 1
    while k < len(runs):
        k *= 2
    current: list[bytes | None] = [None] * k
    shared, index = [0] * k, [0] * k
    for i, (_, rest) in enumerate(runs):
        if rest:
            current[i] = rest[0]

    def duel(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix becomes the one with the winner."""
        x, y = current[a], current[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = shared[a], shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        m = common(x, y, p)
        if m == len(x) or (m < len(y) and x[m] < y[m]):
            shared[b] = m
            return a, b
        shared[a] = m
        return b, a

    loser = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], loser[node] = duel(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    before = -1
    while (s := current[top]) is not None:
        yield top, index[top], before == len(s) and shared[top] == before
        before = len(s)
        lcp, rest = runs[top]
        index[top] = i = index[top] + 1
        if i < len(rest):
            current[top] = s[: lcp[i]] + rest[i]
            shared[top] = lcp[i]
        else:
            current[top] = None
        node = (k + top) // 2
        while node:
            winner, lost = duel(top, loser[node])
            top, loser[node] = winner, lost
            node //= 2


def _sort_run(data: np.ndarray, e: Entries, did: np.ndarray, window: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different entries in order, the place of each entry among them, and their smallest owners."""
    strings = strings_of(data.tobytes(), e, window)
    places: dict[bytes, int] = {}
    rank = np.fromiter((places.setdefault(s, len(places)) for s in strings), np.int64, len(strings))
    different = list(places)
    order = sorted(range(len(different)), key=different.__getitem__)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    rank = back[rank]
    owners = np.full(len(order), np.iinfo(np.int64).max)
    np.minimum.at(owners, rank, did[e.doc])
    return [different[i] for i in order], rank, owners


def splitters_of(docs: DataFrame, parts: int, id_col: str, text_col: str, window: int, seed: int) -> list[bytes]:
    """Strings that cut the entries of all documents into about equal ranges: quantiles of those of a bounded sample."""
    if parts == 1:
        return []

    def strings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for t in b["text"].to_pylist():
                e = Entries(np.frombuffer(t, np.uint8), np.array([0, len(t)]), window, seed)
                e = e.take(np.linspace(0, max(0, len(e.doc) - 1), min(SAMPLE_STRINGS, len(e.doc))).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([x[:SPLITTER_BYTES] for x in strings_of(t, e, window)], pa.binary())], ["s"])

    # the first documents by hash: so many whatever the number of rows
    size = min(max(SAMPLE_DOCS, parts // 4), ALL_STRINGS // SAMPLE_STRINGS)
    place = F.xxhash64(id_col, text_col)
    placed = docs.select(place.alias("h"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    first = placed.select("h").distinct().orderBy("h").limit(size)
    texts = placed.join(F.broadcast(first), "h").dropDuplicates(["h"]).select("text")
    found = sorted(bytes(r["s"]) for r in texts.mapInArrow(strings, "s binary").collect())
    return sorted({found[k * len(found) // parts] for k in range(1, parts)}) if found else []


def wide_cuts(cuts: list[bytes], side: int) -> list[bytes]:
    """About ``side`` ranges of ranges, however many splitters there are."""
    return sorted({cuts[k * len(cuts) // side] for k in range(1, side)}) if cuts else []


def _send_entries(run: int, cuts: list[bytes], data: np.ndarray, e: Entries, n: np.ndarray, did: np.ndarray, window: int) -> pa.Table:
    """The front-coded runs by range, and what the run must know of its entries afterwards, under a range of its own."""
    strings, rank, owners = _sort_run(data, e, did, window)
    counts = np.bincount(rank, minlength=len(strings))
    rows = _front_coded(run, strings, cuts, owners, counts)
    mine = (owners[rank] < did[e.doc]).astype(np.int64)
    rows.append({"bucket": -1 - run, "run": run, "n": len(e.doc), "rest": _keep(_places(e.first, e.last, e.doc), [rank, n.astype(np.int64), mine])})
    return pa.Table.from_pylist(rows, schema=_RUN_PA)


def _places(first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Small numbers for what rises along the run."""
    return [np.diff(first, prepend=0), last - first, np.diff(doc, prepend=0)]


def _keep(*groups: list[np.ndarray]) -> bytes:
    """Groups of columns of one length each as a blob: the lengths first."""
    cols = [c for g in groups for c in g]
    return squeeze(np.concatenate([[len(cols)], [len(c) for c in cols], *cols]).astype(np.uint32))


def _kept(blob: bytes) -> list[np.ndarray]:
    flat = unsqueeze(blob, np.uint32).astype(np.int64)
    n = int(flat[0])
    return np.split(flat[n + 1 :], np.cumsum(flat[1 : n + 1])[:-1])


def _merge(t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: r["run"])
    if rows[0]["bucket"] < 0:  # a run's own state goes back to it
        return pa.Table.from_pylist([{"run": r["run"], "kind": STATE, "bucket": r["bucket"], "n": r["n"], "total": r["rest"], "smaller": None} for r in rows], schema=_REPLY_PA)
    m = _Merged(rows)
    return m.replies(rows, m.spread(np.minimum(m.totals(), 2**32 - 1)), m.spread(m.least()) < m.owners)


class _Merged:
    """Sorted runs merged: the entries one after the other, their order, and the groups of equal ones."""

    def __init__(self, rows: list[dict]):
        self.runs, owners, counts = [], [], []
        for r in rows:
            blob = zstandard.ZstdDecompressor().decompress(r["rest"])
            ends = np.cumsum(unsqueeze(r["ends"], np.uint32), dtype=np.int64).tolist()
            self.runs.append((unsqueeze(r["lcp"], np.uint16).tolist(), [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]))
            owners.append(unsqueeze(r["owners"], np.int64))
            counts.append(unsqueeze(r["counts"], np.uint32))
        self.first = np.concatenate([[0], np.cumsum([len(o) for o in owners])])
        self.owners, self.counts = np.concatenate(owners), np.concatenate(counts).astype(np.int64)
        base, seq, fresh = self.first.tolist(), [], []
        for run, i, same in merge_runs(self.runs):
            seq.append(base[run] + i)
            fresh.append(not same)
        self.seq, self.fresh = np.array(seq), np.array(fresh)
        self.starts, self.group = np.flatnonzero(self.fresh), np.cumsum(self.fresh) - 1

    def totals(self) -> np.ndarray:
        return np.add.reduceat(self.counts[self.seq], self.starts)

    def least(self) -> np.ndarray:
        return np.minimum.reduceat(self.owners[self.seq], self.starts)

    def spread(self, by_group: np.ndarray) -> np.ndarray:
        """A value a group, for each entry in the order it came in."""
        out = np.empty(len(self.seq), by_group.dtype)
        out[self.seq] = by_group[self.group]
        return out

    def strings(self) -> list[bytes]:
        """The different entries in order."""
        flat: list[bytes] = []
        for lcp, rest in self.runs:
            s = b""
            for k, x in zip(lcp, rest, strict=True):
                s = s[:k] + x
                flat.append(s)
        return [flat[i] for i in self.seq[self.starts].tolist()]

    def replies(self, rows: list[dict], total: np.ndarray, smaller: np.ndarray) -> pa.Table:
        out = [{"run": r["run"], "kind": ENTRIES, "bucket": r["bucket"], "n": r["n"], "total": squeeze(total[a:b].astype(np.uint32)), "smaller": np.packbits(smaller[a:b]).tobytes()} for r, a, b in zip(rows, self.first, self.first[1:], strict=False)]
        return pa.Table.from_pylist(out, schema=_REPLY_PA)


def _front_coded(run: int, strings: list[bytes], cuts: list[bytes], owners: np.ndarray, counts: np.ndarray, first_range: int = 0) -> list[dict]:
    """Sorted strings by range, each range's part front-coded."""
    edges = [0, *(bisect_left(strings, c) for c in cuts), len(strings)]
    rows = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            lcp, rest = front_code(strings[a:b])
            rows.append({"bucket": first_range + k, "run": run, "n": b - a, "lcp": squeeze(lcp), "rest": zstandard.ZstdCompressor(3).compress(b"".join(rest)), "ends": squeeze(np.array([len(r) for r in rest], np.uint32)), "owners": squeeze(owners[a:b]), "counts": squeeze(np.minimum(counts[a:b], 2**32 - 1).astype(np.uint32))})
    return rows


def _merge_all(sent: DataFrame, cuts: list[bytes], n_runs: int, direct: int) -> DataFrame:
    """The replies to all runs' entries. Beyond ``direct`` ranges the sort has two levels, as keys have in ``exchange``: teams
    of runs merge what they have for a wide range, and their merged runs are merged by its narrow ones."""
    if n_runs <= direct:
        return sent.groupBy("bucket").applyInArrow(_merge, REPLY)
    side = n_ranges(n_runs, direct)
    sent = materialize(sent.withColumn("team", F.expr(f"run div {side}").cast("int")), "entries")

    def combine(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["run"])
        m, wide = _Merged(rows), rows[0]["bucket"]
        narrow = cuts[wide * side : (wide + 1) * side - 1]
        return pa.Table.from_pylist(_front_coded(rows[0]["team"], m.strings(), narrow, m.least(), m.totals(), wide * side), schema=_RUN_PA)

    def expand(t: pa.Table, reply: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["run"])
        m = _Merged(rows)
        total, smaller = read_answer(reply, ENTRIES)
        return m.replies(rows, m.spread(total), m.spread(smaller) | (m.spread(m.least()) < m.owners))

    keys = sent.where("bucket >= 0")
    merged = keys.groupBy("team", "bucket").applyInArrow(combine, _RUN).groupBy("bucket").applyInArrow(_merge, REPLY)
    merged = merged.withColumns({"team": F.col("run"), "range": F.expr(f"bucket div {side}").cast("int")})
    state = sent.where("bucket < 0").select("run", F.lit(STATE).alias("kind"), "bucket", "n", F.col("rest").alias("total"), F.lit(None).cast("binary").alias("smaller"))
    return keys.groupBy("team", "bucket").cogroup(merged.groupBy("team", "range")).applyInArrow(expand, REPLY).union(state)


def _anchors(e: Entries, bits: int) -> np.ndarray:
    """Keys of the anchors, spread evenly: the smallest hash of a window is a small one."""
    return mix64(e.hash) >> np.uint64(64 - bits)


def _candidates(data: np.ndarray, offsets: np.ndarray, reply: pa.Table, window: int, seed: int, bits: int) -> tuple[Entries, np.ndarray]:
    """Entries whose anchor occurs more than once, and how often it does (or more, if its key isn't its own)."""
    e = Entries(data, offsets, window, seed)
    total, _ = read_answer(reply, ANCHORS)
    keys, place = np.unique(_anchors(e, bits), return_inverse=True)
    n = total[place] if len(keys) else np.zeros(0, np.uint32)
    keep = n > 1
    return e.take(keep), n[keep]


def _settle(reply: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of a run's entries: first and last window of those that a smaller document has as a whole; first and last window and
    document of those whose windows must be looked at one by one. Windows of an entry that is gone are not: they go with
    it, and a smaller document sends them."""
    first, size, doc, place, n, mine = _kept(_state(reply))
    first, doc = np.cumsum(first), np.cumsum(doc)
    total, smaller = read_answer(reply, ENTRIES)
    gone = (smaller[place] | (mine > 0)) if len(place) else np.zeros(0, bool)
    open_ = (total[place] < n) & ~gone if len(place) else gone
    return [first[gone], (first + size)[gone]], [first[open_], (first + size)[open_], doc[open_]]


def _state(reply: pa.Table) -> bytes:
    return next(r["total"] for r in reply.to_pylist() if r["kind"] == STATE)


def _windows(data: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Positions, hashes (64 and 32 bits) and owners of all windows of some entries, their order by hash, and whether one is
    the first of its hash in it."""
    size = last - first + 1
    p = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    h, g = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint32)
    for at in range(0, len(p), 1 << 15):  # the bytes of a batch of windows side by side
        h[at : at + (1 << 15)], g[at : at + (1 << 15)] = hash_rows(data[p[at : at + (1 << 15), None] + np.arange(window)])
    owner = np.repeat(owner, size)
    order = np.lexsort((owner, g, h))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    return p, h, g, owner, order, fresh


_rng = np.random.default_rng(4711)
_WORDS = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hash_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row of bytes, of 64 and 32 bits, taken eight bytes at a time."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    h, g = np.full(n, width, np.uint64), np.full(n, 3 * width, np.uint64)
    for k, col in enumerate(wide.view(np.uint64).T):
        h = mix64(h ^ (col * _WORDS[k % 64]))
        g = (g ^ (col >> np.uint64(29)) ^ col) * _WORDS[(k + 17) % 64]
    return h, (mix64(g) >> np.uint64(32)).astype(np.uint32)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, run_bytes: int = RUN_BYTES, direct: int = DIRECT) -> DataFrame:
    """doc_id, text (bytes that are kept), n_bytes, n_removed, n_spans, and the removed spans' starts and ends, of each row.

    A null text is empty. Texts shorter than ``window`` bytes lose nothing. Rows of equal id don't count as smaller than
    each other; a null id counts as the largest. Other columns aren't read; an empty table gives an empty one."""
    rows, n_runs = runs_of(docs, id_col, text_col, run_bytes)
    bits = count_bits(n_runs, run_bytes)
    cuts = splitters_of(docs, n_runs, id_col, text_col, window, seed)
    side = n_ranges(n_runs, direct)
    wide = cuts if n_runs <= direct else wide_cuts(cuts, side)

    def send_anchors(t: pa.Table) -> pa.Table:
        r = read_run(t)
        keys, counts = np.unique(_anchors(Entries(r.data, r.offsets, window, seed), bits), return_counts=True)
        return key_rows(r.run, ANCHORS, n_runs, keys, counts, bits=bits, direct=direct)

    def send_entries(t: pa.Table, reply: pa.Table) -> pa.Table:
        if not len(t):
            return _RUN_PA.empty_table()
        r = read_run(t, ordered=True)
        e, n = _candidates(r.data, r.offsets, reply, window, seed, bits)
        return _send_entries(r.run, wide, r.data, e, n, r.did, window)

    def send_windows(t: pa.Table, reply: pa.Table) -> pa.Table:
        if not len(t):
            return key_rows(0, WINDOWS, n_runs, np.zeros(0, np.uint64), direct=direct)
        r = read_run(t, ordered=True)
        gone, (first, last, doc) = _settle(reply)
        _, h, g, own, order, fresh = _windows(r.data, first, last, r.did[doc], window)
        one = order[fresh]
        keys = key_rows(r.run, WINDOWS, n_runs, h[one], None, own[one], g[one], direct=direct)
        state = _keep([np.diff(gone[0], prepend=0), gone[1] - gone[0]], _places(first, last, doc))
        return pa.concat_tables([keys, state_row(r.run, state)])

    def cut(t: pa.Table, reply: pa.Table) -> pa.Table:
        r = read_run(t, ordered=True)
        data, offsets = r.data, r.offsets
        step = np.zeros(len(data) + 1, np.int32)
        if len(t):
            gone, size, first, open_size, doc = _kept(_state(reply))
            gone, first, own = np.cumsum(gone), np.cumsum(first), r.did[np.cumsum(doc)]
            np.add.at(step, gone, 1)
            np.add.at(step, gone + size + window, -1)
            p, _, _, own, order, fresh = _windows(data, first, first + open_size, own, window)
            _, smaller = read_answer(reply, WINDOWS)
            if len(p):
                group = np.cumsum(fresh) - 1
                repeated = np.empty(len(p), bool)
                repeated[order] = smaller[group] | (own[order[fresh]][group] < own[order])
                np.add.at(step, p[repeated], 1)
                np.add.at(step, p[repeated] + window, -1)
        drop = np.cumsum(step)[:-1] > 0
        cols: dict[str, list] = {k: [] for k in ("text", "n_removed", "n_spans", "starts", "ends")}
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            d = drop[a:b]
            s, z = group_spans(d)
            cols["text"].append(data[a:b][~d].tobytes() if len(s) else data[a:b].tobytes())
            cols["n_removed"].append(int((z - s).sum()))
            cols["n_spans"].append(len(s))
            cols["starts"].append(s)
            cols["ends"].append(z)
        return pa.table({"doc_id": r.doc_ids(), "did": pa.array(r.did), "text": pa.array(cols["text"], pa.binary()), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(cols["n_removed"], pa.int64()), "n_spans": pa.array(cols["n_spans"], pa.int64()), "starts": pa.array(cols["starts"], pa.list_(pa.int64())), "ends": pa.array(cols["ends"], pa.list_(pa.int64()))})

    counted = answers(rows.groupBy("run").applyInArrow(send_anchors, key_schema()), n_runs, bits, direct)
    sent = rows.groupBy("run").cogroup(counted.groupBy("run")).applyInArrow(send_entries, _RUN)
    merged = _merge_all(sent, cuts, n_runs, direct)
    settled = answers(rows.groupBy("run").cogroup(merged.groupBy("run")).applyInArrow(send_windows, key_schema()), n_runs, direct=direct)
    return rows.groupBy("run").cogroup(settled.groupBy("run")).applyInArrow(cut, _OUT).drop("did")


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``find_repeats`` with the kept bytes as text; where a cut falls inside a character, its other bytes are replaced."""
    return find_repeats(docs, **options).withColumn("text", F.decode("text", F.lit("UTF-8")))


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


def op2_suffix_array_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT r, doc_id, x, unnest(generate_series(0, length(x) // 2 - 50)) AS p FROM d WHERE length(x) >= 100)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT r, p FROM w JOIN m USING (s) WHERE m.first < coalesce(w.doc_id, 9223372036854775807)),
g AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
spans AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS k FROM g) GROUP BY r, k),
cuts AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before, row_number() OVER (PARTITION BY r ORDER BY a DESC) AS back FROM spans),
kept AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || max(CASE WHEN back = 1 THEN substr(x, 2 * b + 1) ELSE '' END) AS rest FROM cuts JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
