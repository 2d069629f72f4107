"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Texts are normalised to lower-cased words joined by single spaces, so that a window of words is a string between spaces.
The automaton holds every window once; each text is scanned once, and the hits are mapped back to words and to character
offsets of the original text. The benchmark is the small side: its size is measured first. Up to ``block_bytes`` one
automaton goes over the texts in one map-only pass. A larger benchmark is dealt to blocks; each has an automaton and a pass of
its own, which writes what it hit by row, so that no task ever holds more than one block, and the rows' hits are joined.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table, unused

WINDOW = 10
#: Bytes of benchmark text in one automaton (about forty times that in memory).
BLOCK_BYTES = 4_000_000

_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_HIT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
_cache: dict[str, object] = {}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    """All runs of ``size`` words; a shorter text is one window; a text without words has none."""
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _automaton(key: str, items: list[tuple[str, str]], size: int):
    if key not in _cache:
        import ahocorasick

        _cache.clear()
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for w in windows_of(words_of(text), size):
                owners.setdefault(w, set()).add(item)
        auto = ahocorasick.Automaton()
        for w, own in owners.items():
            auto.add_word((b" " + b" ".join(w) + b" ").decode("utf-8", "surrogatepass"), (len(w), tuple(own)))
        if owners:
            auto.make_automaton()
        _cache[key] = auto if owners else None
    return _cache[key]


def scan(auto, text: str | None) -> tuple[int, list[int], list[int], list[int], list[str]]:
    """Words in all, hit words, their character offsets in ``text``, and the items found."""
    words = words_of(text) if text else []
    if not words or auto is None:
        return len(words), [], [], [], []
    flat = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    ends, sizes, items = [], [], set()
    for end, (n, own) in auto.iter(flat):
        ends.append(end)
        sizes.append(n)
        items.update(own)
    if not ends:
        return len(words), [], [], [], []
    spaces = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    last = np.searchsorted(spaces, ends)  # the word before the closing space, plus one
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, last - np.asarray(sizes), 1)
    np.add.at(step, last, -1)
    hit = np.flatnonzero(np.cumsum(step)[:-1])
    at = [m.span() for m in _WORD.finditer(text)]
    return len(words), hit.tolist(), [at[i][0] for i in hit], [at[i][1] for i in hit], sorted(items)


def _scanner(shared, size: int):
    key = uuid.uuid4().hex

    @F.pandas_udf(_HIT)
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = _automaton(key, shared.value, size)
        for s in texts:
            yield pd.DataFrame([scan(auto, t) for t in s], columns=_HIT.names)

    return hits


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES, out: str = "contamination") -> DataFrame:
    """Adds struct ``out``: n_words, hit word numbers, their start and end offsets in the text (characters), items found.

    A null text has no words; an empty benchmark, or items without words, hit nothing. Items of equal id count once, and a
    null item id is the string ``null``. All columns of ``docs`` but one named ``out`` stay; repeated rows stay; an empty
    table gives an empty one."""
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("words")).where("words is not null")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("b")).first()["b"]
    n_blocks = max(1, -(-total // block_bytes))
    if n_blocks == 1:
        block = [tuple(r) for r in bench.collect()]  # block_bytes at most
        return docs.withColumn(out, _scanner(spark.sparkContext.broadcast(block), size)(F.col(text_col)))
    row = unused(docs, "row")
    kept = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")  # read in each pass: numbers must stay
    found = None
    for k in range(n_blocks):
        block = spark.sparkContext.broadcast([tuple(r) for r in bench.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k).collect()])  # about block_bytes
        hits = kept.select(F.col(row).alias("row"), _scanner(block, size)(F.col(text_col)).alias("hit"))
        hits = materialize(hits if k == 0 else hits.where(F.size("hit.words") > 0), "hits")  # the first pass counts the words of all
        block.unpersist()
        found = hits if found is None else found.union(hits)
    every = lambda n: F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"hit.{n}")))).alias(n)
    joined = found.groupBy("row").agg(F.max("hit.n_words").alias("n_words"), *map(every, _HIT.names[1:]))
    struct = joined.select(F.col("row").alias(row), F.struct(*_HIT.names).cast(_HIT).alias("hit"))
    both = kept.drop(out).join(struct.withColumnRenamed("hit", out), row)
    return both.select(*(c for c in docs.columns if c != out), out)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit word, with the columns they came with. Null and empty texts have none and stay, repeated
    rows too; an empty benchmark removes nothing."""
    out = unused(docs, "contamination")
    return find_contamination(docs, benchmark, out=out, **options).where(F.size(F.col(out)["words"]) == 0).select(docs.columns)


def op8_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = find_contamination(docs, table(spark, sf_dir, "benchmark"), out="c")
    n_hit = F.size("c.words").cast("long")
    return hit.select("doc_id", F.col("c.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("c.items").cast("long").alias("n_items"), F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
