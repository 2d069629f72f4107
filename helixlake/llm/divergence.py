"""Source divergence audit: how far the sources of a language differ in the words they use, and by which words.

Terms are counted in numpy, in length buckets. The lower-cased bytes of a block of documents are one array, in which the
bytes between terms are zero. A term of up to 8 bytes becomes one uint64, one of up to 16 becomes two; each bucket is sorted
by a radix sort of 16-bit digits, with the document's group as the last one, and runs of equal words are counted. Longer
terms go to buckets of equal length that are sorted as bytes. What a block holds is summed before the shuffle and again by
Spark, so a source with a third of all documents is as many partial counts as it has blocks, and a term has no more than
one row a source from then on.

The divergence of two sources sums ``f(p, q)`` over all terms that the language keeps, also those that neither has. Terms
that both have are paired; for those of only one, how often each probability occurs (a histogram) meets the probability
that the other source gives to absent terms; the rest is one product. No table of sources by terms is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Documents need a term so many times in a language for it to be kept, and so many terms of a group are reported.
MIN_DOCS, TOP = 10, 10
#: Text bytes that a task counts at once (a longer text is a block of its own).
BLOCK_BYTES = 16_000_000
SCALE = 1_000_000_000

#: Letters and bytes beyond ASCII, lower-cased; all other bytes are zero.
_FOLD = np.zeros(256, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
#: The leading n bytes of a word.
_LEADING = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], np.uint64)

_COUNTS = "lang string, source string, term binary, n bigint, docs bigint"
_COUNTS_PA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by unsigned keys, the least significant first: a counting sort for each 16-bit digit."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, 8 * key.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _word(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` (up to 8) bytes from each place on as one number whose order is that of the bytes."""
    raw = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    return raw.view(">u8").ravel().astype(np.uint64) & _LEADING[n]


def _runs(fresh: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of runs, their lengths, and how many documents are in each. Rows of a run are in document order."""
    starts = np.flatnonzero(fresh)
    new_doc = fresh.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    return starts, np.diff(starts, append=len(fresh)), np.add.reduceat(new_doc.astype(np.int64), starts)


def count_terms(texts: list[bytes], group: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """For each bucket: the group, the term, how often it occurs in the group's texts and in how many of them."""
    data = _FOLD[np.frombuffer(b"\0".join(texts) + bytes(17), np.uint8)]
    inside = np.concatenate([[False], data != 0])
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    lengths = ends - starts
    opens = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    doc = np.searchsorted(opens, starts, "right") - 1
    group = group.astype(np.uint32)
    for low, high in ((1, 8), (9, 16)):
        own = np.flatnonzero((lengths >= low) & (lengths <= high))
        if not len(own):
            continue
        at, n, d = starts[own], lengths[own], doc[own]
        words = [_word(data, at, np.minimum(n, 8))] + ([_word(data, at + 8, n - 8)] if high > 8 else [])
        order = radix_order([*words[::-1], group[d]])
        words, d = [w[order] for w in words], d[order]
        fresh = np.ones(len(d), bool)
        fresh[1:] = np.any([x[1:] != x[:-1] for x in (*words, group[d])], axis=0)
        first, counts, docs = _runs(fresh, d)
        raw = np.stack([w[first] for w in words], axis=1).astype(">u8").view(np.uint8)
        full = raw != 0  # no term holds a zero
        offsets = np.concatenate([[0], np.cumsum(full.sum(axis=1))]).astype(np.int32)
        terms = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[full])])
        yield group[d][first], terms, counts, docs
    long = np.flatnonzero(lengths > 16)
    long = long[np.argsort(lengths[long], kind="stable")]
    for own in np.split(long, np.flatnonzero(np.diff(lengths[long])) + 1):
        if not len(own):
            continue
        size, d = int(lengths[own[0]]), doc[own]
        rows = np.lib.stride_tricks.sliding_window_view(data, size)[starts[own]].view(f"S{size}").ravel()
        order = np.argsort(rows, kind="stable")
        order = order[radix_order([group[d][order]])]
        rows, d = rows[order], d[order]
        fresh = np.ones(len(d), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (group[d][1:] != group[d][:-1])
        first, counts, docs = _runs(fresh, d)
        yield group[d][first], pa.array(rows[first].tolist(), pa.binary()), counts, docs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def block(held: list[tuple[str, str, bytes]]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        group = np.array([names.setdefault(x[:2], len(names)) for x in held])
        langs, sources = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
        for g, terms, counts, docs in count_terms([x[2] for x in held], group):
            g = pa.array(g)
            t = pa.Table.from_arrays([langs.take(g), sources.take(g), terms, pa.array(counts, pa.int64()), pa.array(docs, pa.int64())], schema=_COUNTS_PA)
            yield from t.to_batches(max_chunksize=100_000)

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[2])
            if size >= BLOCK_BYTES:
                yield from block(held)
                held, size = [], 0
    if held:
        yield from block(held)


def kept_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """A row for each language and term that ``min_docs`` of its documents hold: lang, term, total, and ``sources``, an array
    of (source, n) with those that have it. Nulls are empty strings. Repeated rows are documents each."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    counts = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return terms.where(F.col("docs") >= min_docs).select("lang", F.col("term").cast("string").alias("term"), "total", "sources")


def _share(n: str, size: str) -> F.Column:
    """1 + floor(SCALE * (n + 2) / size), exactly. Null if size is 0."""
    return F.expr(f"1 + (cast({n} + 2 as decimal(20, 0)) * {SCALE}) div cast(nullif({size}, 0) as decimal(20, 0))")


def _distance(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def divergence_audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part ``pair``: every other source of the language, with the divergence
    of the two over all kept terms (0 if none is kept). Part ``term``: the ``top`` terms that the source has more of than
    its language, with their share of the divergence from it. Ranks go by value, then by the bytes of the item.

    Nulls are empty strings; a group without terms has its pairs; an empty table gives no rows; other columns don't matter."""
    kept = materialize(kept_terms(docs, lang_col, source_col, text_col, min_docs), "terms")
    each = kept.select("lang", "term", "total", F.explode("sources").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = (
        docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
        .join(each.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left")
        .join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all")), "lang", "left")
        .fillna(0)
        .withColumns({"size": F.expr("own + 2 * terms"), "lang_size": F.expr("all + 2 * terms")})
        .withColumn("absent", _share("0", "size"))
    )
    groups = materialize(groups.select("lang", "source", "terms", "size", "lang_size", "absent"), "groups")
    shares = each.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("n", "size").alias("p"), _share("total", "lang_size").alias("q"), "absent")
    shares = materialize(shares, "shares")

    other = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("absent2"))
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("terms") * _distance("absent", "absent2"), F.lit(0)).alias("v"))
    # terms of one source, against what the other gives to those that it doesn't have
    often = shares.groupBy("lang", "source", "p", "absent").agg(F.count("*").alias("often"))
    one = often.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("often") * (_distance("p", "absent2") - _distance("absent", "absent2"))).alias("v"))
    # terms of both: their own part in place of what the lines above have for them
    having = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "absent")).alias("x"))
    x = having.select("lang", "x", F.explode("x").alias("a")).select("lang", "a", F.explode("x").alias("b")).where("a.source < b.source")
    x = x.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.p").alias("p"), F.col("b.p").alias("q"), F.col("a.absent").alias("y"), F.col("b.absent").alias("z"))
    both = x.groupBy("lang", "source", "item").agg(F.sum(_distance("p", "q") - _distance("p", "z") - _distance("y", "q") + _distance("y", "z")).alias("v"))
    swapped = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "v")
    pairs = base
    for part in (one, both):
        pairs = pairs.unionByName(part).unionByName(swapped(part))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op13_source_divergence_audit(spark, sf_dir):
    """Which sources of a language differ, and by which terms, over all documents."""
    return divergence_audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
   1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.v)::HUGEINT AS p,
   1 + (1000000000::HUGEINT * (k.total + 2)) // (v.n + 2 * v.v)::HUGEINT AS q
 FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
 LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 10
"""
