"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 8 bytes says where chunks may end, about every 11 bytes, so an insertion moves the
boundaries next to it only; a stretch without a boundary is cut every 64 bytes from the last one on. At each boundary a
chunk begins and goes on to the first boundary at least CHUNK bytes later: chunks vary in length with what they hold, and
overlap, so that each passage holds whole chunks wherever it stands. Chunks are compared by a 96-bit digest over all documents
(``exchange``). A chunk that a document with a smaller id holds too is a duplicate; runs of duplicates of at least
``min_run`` bytes are cut out of the text. A passage keeps at its ends what lies before its first and after its last boundary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, table, unused
from .exchange import RUN_BYTES, answers, batches, key_rows, key_schema, read_answer, read_run, runs_of

#: Bytes of a chunk at least, bytes that the gear hash sees, values of 256 that mark a boundary, and the longest stretch
#: without one.
CHUNK, REACH, MARKS, STRETCH = 64, 8, 24, 64
#: Runs of duplicates from this many bytes on are passages; shorter ones (stock phrases, single lines) are left alone.
MIN_RUN = 128

_rng = np.random.default_rng(77)
_GEAR = _rng.integers(0, 2**8, 256, dtype=np.uint8)
_LANES = [(_rng.integers(0, 2**63, 256, dtype=np.uint64), int(_rng.integers(0, 2**62)) * 2 + 1) for _ in range(2)]
_OUT = "doc_id long, did long, text binary, n_chunks int, n_bytes long, n_removed long, n_spans int"


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of it and the 7 before, of 8 bits: doubled windows, shifted by what follows them."""
    h = _GEAR[data]
    for k in (1, 2, 4):
        h[k:] = h[k:] + (h[:-k] << np.uint8(k))
    return h


def boundaries_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sorted places where chunks may begin or end: the starts of the documents ``at`` (which end where the next one starts),
    after each gear hash under MARKS that lies in one document, and every STRETCH bytes beyond such a place. Of
    places next to each other the first counts. All fall before the first byte of a character."""
    n = len(data)
    mark = gear(data) < MARKS
    mark[1:] &= ~mark[:-1].copy()
    cut = np.flatnonzero(mark) + 1
    starts = at[:-1][np.diff(at) > 0]
    inside = cut[cut < n]
    inside = inside[inside - at[np.searchsorted(at, inside, "right") - 1] > REACH]
    b = np.union1d(inside, starts)
    gap = np.diff(np.append(b, n))
    more = np.maximum(0, (gap - 1) // STRETCH)
    step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    b = np.union1d(b, np.repeat(b, more) + STRETCH * step)
    letter = np.flatnonzero(np.append((data & 0xC0) != 0x80, True))
    b = np.unique(letter[np.searchsorted(letter, b)])
    return b[b < n]


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and the digest, of 64 and 32 bits, of every chunk; the last chunk of a document ends with it, so
    that copies go whole."""
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for lo, hi in batches(offsets):
        base = offsets[lo]
        own, at = data[base : offsets[hi]], offsets[lo : hi + 1] - base
        n = len(own)
        if not n:
            continue
        b = boundaries_of(own, at)
        doc = np.searchsorted(at, b, "right") - 1
        stop = at[doc + 1]
        later = np.searchsorted(b, b + CHUNK)
        e = np.minimum(np.append(b, n)[later], stop)
        whole = b + CHUNK <= stop
        last = whole & np.append(~whole[1:] | (doc[1:] != doc[:-1]), True)  # of the chunks that fit, the last of its document
        tail = last & (e < stop)
        keep = whole | (b == at[doc])
        s, e, doc = (np.concatenate([x[keep], y[tail]]) for x, y in ((b, b), (e, stop), (doc, doc)))
        order = np.lexsort((e, s))
        s, e, doc = s[order], e[order], doc[order]
        digest = []
        for value, base_ in _LANES:
            power, inverse = _powers(base_, 1 << max(20, int(n).bit_length()))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(value[own] * power[:n], out=sums[1:])
            digest.append(mix64((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)))
        for p, x in zip(parts, (s + base, e + base, doc + lo, digest[0], (digest[1] >> np.uint64(32)).astype(np.uint32)), strict=True):
            p.append(x)
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint32)
    return tuple(np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True))


_power_cache: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(b: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if (b, n) not in _power_cache:
        if len(_power_cache) > 4:
            _power_cache.clear()
        up = []
        for base in (b, pow(b, -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            up.append(np.cumprod(x, dtype=np.uint64))
        _power_cache[b, n] = tuple(up)
    return _power_cache[b, n]


def _firsts(h1: np.ndarray, h2: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by digest; where each digest starts in it; its smallest owner."""
    order = np.lexsort((owner, h2, h1))
    a, b = h1[order], h2[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(fresh), np.cumsum(fresh) - 1


def _cut(docs: DataFrame, id_col: str, text_col: str, min_run: int, run_bytes: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """What ``dedup_chunks`` gives of every row, with the columns ``carry`` as c0, c1 and so on."""
    rows, n_runs = runs_of(docs, id_col, text_col, run_bytes, carry)

    def send(t: pa.Table) -> pa.Table:
        r = read_run(t)
        _, _, doc, h1, h2 = chunks_of(r.data, r.offsets)
        did = r.did
        order, starts, _ = _firsts(h1, h2, did[doc])
        first = order[starts]
        return key_rows(r.run, 0, n_runs, h1[first], None, did[doc[first]], h2[first])

    def cut(t: pa.Table, reply: pa.Table) -> pa.Table:
        r = read_run(t)
        did, data, offsets = r.did, r.data, r.offsets
        s, e, doc, h1, h2 = chunks_of(data, offsets)
        own = did[doc]
        order, starts, group = _firsts(h1, h2, own)
        _, smaller = read_answer(reply, 0)
        dup = np.zeros(len(s), bool)
        if len(s):
            dup[order] = smaller[group] | (own[order[starts]][group] < own[order])
        drop = np.zeros(len(data), bool)
        removed, spans = np.zeros(len(did), np.int64), np.zeros(len(did), np.int32)
        bounds = np.searchsorted(doc, np.arange(len(did) + 1))
        for d in np.unique(doc[dup]).tolist():
            mine = np.flatnonzero(dup[bounds[d] : bounds[d + 1]]) + bounds[d]
            x, y = s[mine], e[mine]
            fresh = np.append(True, x[1:] > y[:-1])
            for x, y in zip(x[fresh].tolist(), y[np.append(fresh[1:], True)].tolist(), strict=True):
                if y - x >= min_run:
                    drop[x:y] = True
                    removed[d] += y - x
                    spans[d] += 1
        texts = [data[a:b].tobytes() if not n else data[a:b][~drop[a:b]].tobytes() for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist(), strict=True)]
        out = pa.table({"doc_id": r.doc_ids(), "did": pa.array(did), "text": pa.array(texts, pa.binary()), "n_chunks": pa.array(np.diff(bounds).astype(np.int32)), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed), "n_spans": pa.array(spans)})
        for k in range(len(carry)):
            out = out.append_column(f"c{k}", r.carried[f"c{k}"] if r.carried is not None else pa.nulls(0))
        return out

    schema = T._parse_datatype_string(_OUT)
    for k, c in enumerate(carry):
        schema = schema.add(f"c{k}", docs.schema[c].dataType)
    replies = answers(rows.groupBy("run").applyInArrow(send, key_schema()), n_runs)
    return rows.groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(cut, schema)


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, run_bytes: int = RUN_BYTES) -> DataFrame:
    """doc_id, text (what is kept), n_chunks, n_bytes, n_removed, n_spans of every row.

    Null and empty texts give an empty text. Repeats inside one document, and in rows of equal id, stay. A null id counts as
    the largest. Other columns aren't read; an empty table gives an empty one."""
    done = _cut(docs, id_col, text_col, min_run, run_bytes)
    return done.select("doc_id", F.col("text").cast("string").alias("text"), "n_chunks", "n_bytes", "n_removed", "n_spans")


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", min_run: int = MIN_RUN, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts, and their lengths anew; all other columns travel with the texts. A
    document that loses all its text goes; one that had none (null or empty) stays as it was. A null id counts as the largest;
    rows of equal id aren't compared with each other. An empty table gives an empty one."""
    void = unused(docs, "no_text")
    others = [c for c in docs.columns if c != text_col]
    done = _cut(docs.withColumn(void, F.col(text_col).isNull()), id_col, text_col, min_run, run_bytes, (*others, void))
    own = {c: F.col(f"c{k}") for k, c in enumerate(others)}
    text, changed = F.col("text").cast("string"), F.col("n_removed") > 0
    kept = done.where(~changed | (F.length("text") > 0))
    new = own | {text_col: F.when(~F.col(f"c{len(others)}"), text)}
    if length_col in own:
        new[length_col] = F.when(changed, F.length(text)).otherwise(own[length_col]).cast(docs.schema[length_col].dataType)
    return kept.select(*(new[c].alias(c) for c in docs.columns))


def op5_substring_dedup(spark, sf_dir):
    """SQL has no rolling hash: tests plant random passages and count what is missed, and hold ``dedup_chunks`` against a
    plain version on small documents."""
    return dedup_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
