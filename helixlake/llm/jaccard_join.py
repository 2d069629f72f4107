"""N-gram Jaccard join by filtering under multiple global orders.

1. Every document's distinct word shingles are hashed, and their counts over all documents taken (``exchange``). A document
   that can be similar to another shares at least the threshold's part of its shingles; the others are alone and done.
2. Documents with equal sets form one class; from here on classes stand for their documents. The counts are taken anew over
   the classes left, and classes that no longer share enough go, twice over.
3. The classes' tokens are put in global orders: rarest first with ties broken by one hash (order A), rarest first by whole
   powers of two of the count with ties broken by another (B), and by a hash alone (C). Tokens that no other class has are
   left out of the orders, but count: two sets can only be similar if what is left of each from the first shared token on is
   as large as the overlap that their sizes call for. That bounds the prefixes, and each prefix row says how much is left.
4. Hubs first: each token of order A pairs its holders with two of them, the one with the smallest part of tokens of its
   own (where there is an original and its copies, that is the original) and one by hash. Links found merge components, so
   that a large group of near copies collapses at once; a token whose holders are one component is done.
5. Then the rest in full: every two holders of a token in different components whose rows leave enough room, under A and
   under B each, by size bands. Candidates are the pairs found under both; they must share prefix tokens under C as well
   before their sets are compared. No link between components is lost, and there is no cap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, table, unused
from .components import components
from .exchange import NO_ID, RUN_BYTES, answers, count_bits, key_rows, key_schema, read_answer, read_run, runs_of
from .shingles import shingle_sets

WORDS = 5
PERCENT = 80
#: Times that the tokens of the classes left are counted anew.
RECOUNTS = 2
#: Size bands a factor of e: one is about five parts in a hundred wide.
BANDS = 20

_SETS = "doc_id long, did long, key long, n int, node binary, tokens binary"
_SETS_PA = pa.schema([("doc_id", pa.int64()), ("did", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("node", pa.binary()), ("tokens", pa.binary())])
_CLASSES = "cid long, n int, tokens binary, freq binary"
_CLASSES_PA = pa.schema([("cid", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary()), ("freq", pa.binary())])


def _least(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` must share with a similar one at least."""
    return -(-percent * n // 100)


def shared_order(tokens: np.ndarray, freq: np.ndarray, order: str) -> np.ndarray:
    """Positions of the tokens that other classes have too (``freq`` over 0), in a global order."""
    at = np.flatnonzero(freq)
    t = tokens[at]
    if order == "C":
        return at[np.argsort(mix64(t + np.uint64(3)))]
    rank = freq[at] if order == "A" else freq[at] >> 3
    return at[np.lexsort((mix64(t + np.uint64(1 if order == "A" else 2)), rank))]


def prefix(tokens: np.ndarray, freq: np.ndarray, order: str, percent: int = PERCENT) -> np.ndarray:
    """Positions of the prefix under a global order: a similar set shares one of these tokens at least."""
    ranks = shared_order(tokens, freq, order)
    return ranks[: max(0, len(ranks) - _least(len(tokens), percent) + 1)]


def shingle_table(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """doc_id, did, key (hash of the text), n (shingles) of every document, and for those that can be similar to another one
    the class key (node) and the tokens."""
    rows, n_runs = runs_of(docs, id_col, text_col, run_bytes)
    bits = count_bits(n_runs, run_bytes)
    drop = np.uint64(64 - bits)

    def send(t: pa.Table) -> pa.Table:
        r = read_run(t)
        keys, counts = np.unique(np.concatenate(shingle_sets(r.data, r.offsets, words)) >> drop, return_counts=True)
        return key_rows(r.run, 0, n_runs, keys, counts, bits=bits)

    def judge(t: pa.Table, reply: pa.Table) -> pa.Table:
        r = read_run(t)
        if not len(r.did):
            return _SETS_PA.empty_table()
        sets = shingle_sets(r.data, r.offsets, words)
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets) >> drop
        total, _ = read_answer(reply, 0)
        keys, place = np.unique(flat, return_inverse=True)
        common = np.bincount(np.repeat(np.arange(len(sets)), size), total[place] > 1, len(sets)) if len(keys) else np.zeros(len(sets))
        near = (size > 0) & (100 * common >= percent * size)
        node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if x else None for s, x in zip(sets, near, strict=True)]
        tokens = [s.tobytes() if x else None for s, x in zip(sets, near, strict=True)]
        key = np.array([xxhash.xxh64_intdigest(x, 42) for x in r.texts()], np.uint64).view(np.int64)  # as Spark's xxhash64
        return pa.table({"doc_id": r.doc_ids(), "did": pa.array(r.did), "key": pa.array(key), "n": pa.array(size, pa.int32()), "node": pa.array(node, pa.binary()), "tokens": pa.array(tokens, pa.binary())}, schema=_SETS_PA)

    replies = answers(rows.groupBy("run").applyInArrow(send, key_schema()), n_runs, bits)
    return materialize(rows.groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(judge, _SETS), "shingles")


def _recount(classes: DataFrame, n_runs: int, percent: int) -> DataFrame:
    """The classes that share enough tokens with other ones, with how many have each token (8 log2 of it)."""
    rows = classes.withColumn("run", F.pmod(F.xxhash64("cid"), F.lit(n_runs)).cast("int"))

    def sets_of(t: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint64) for x in t["tokens"].to_pylist()]

    def send(t: pa.Table) -> pa.Table:
        keys, counts = np.unique(np.concatenate(sets_of(t)), return_counts=True)
        return key_rows(t["run"][0].as_py(), 0, n_runs, keys, counts)

    def judge(t: pa.Table, reply: pa.Table) -> pa.Table:
        if not len(t):
            return _CLASSES_PA.empty_table()
        sets = sets_of(t)
        total, _ = read_answer(reply, 0)
        keys = np.unique(np.concatenate(sets))
        code = np.minimum(8 * np.log2(total), 255).astype(np.uint8)  # 0: no other class has it
        freq = [code[np.searchsorted(keys, s)] for s in sets]
        keep = np.flatnonzero([100 * np.count_nonzero(f) >= percent * len(f) for f in freq])
        kept = t.select(["cid", "n", "tokens"]).take(pa.array(keep))
        return kept.append_column("freq", pa.array([freq[i].tobytes() for i in keep], pa.binary())).cast(_CLASSES_PA)

    replies = answers(rows.groupBy("run").applyInArrow(send, key_schema()), n_runs)
    return materialize(rows.groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(judge, _CLASSES), "classes")


def _prefix_rows(batches: Iterator[pa.RecordBatch], order: str, percent: int) -> Iterator[pa.RecordBatch]:
    """A row for each prefix token: ``left`` is how many shared tokens there are from it on, ``own`` how many in a thousand
    tokens the class shares with no other."""
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for cid, t, f in zip(b["cid"].to_pylist(), b["tokens"].to_pylist(), b["freq"].to_pylist(), strict=True):
            t, f = np.frombuffer(t, np.uint64), np.frombuffer(f, np.uint8)
            p, shared = prefix(t, f, order, percent), np.count_nonzero(f)
            for col, x in zip(cols, (t[p].view(np.int64), np.full(len(p), cid), np.full(len(p), len(t)), shared - np.arange(len(p)), np.full(len(p), 1000 - 1000 * shared // len(t))), strict=True):
                col.append(x)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["token", "cid", "n", "left", "own"])


def prefix_table(classes: DataFrame, order: str, percent: int) -> DataFrame:
    return classes.mapInArrow(lambda it: _prefix_rows(it, order, percent), "token long, cid long, n int, left int, own int")


def _need(a: str, b: str, percent: int):
    """What similar sets of these sizes must share."""
    return F.ceil(percent * (F.col(a) + F.col(b)) / (100 + percent))


def _hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Holders of a token with two of them. ``rows``: prefix rows with their components."""
    hub = F.struct("cid", "n", "left", "comp")
    first, second = F.min_by(hub, F.struct("own", F.xxhash64("cid"))), F.min_by(hub, F.xxhash64("cid", F.lit(1)))
    hubs = rows.groupBy("token").agg(F.array_distinct(F.array(first, second)).alias("hubs"), F.count("*").alias("m")).where("m > 1")
    near = rows.join(hubs, "token").select("cid", "n", "left", "comp", F.explode("hubs").alias("h")).where("comp != h.comp")
    near = near.where(F.least("left", "h.left") >= _need("n", "h.n", percent))
    return near.select(F.least("cid", "h.cid").alias("a"), F.greatest("cid", "h.cid").alias("b"))


def _all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Every two holders of a token in different components that leave room for the overlap. The smaller set's row goes
    to the bands of the sizes that it has room for, the other one's to its own."""
    band = lambda n: F.floor(BANDS * F.log(n)).cast("int")
    most = F.least(F.floor(100 * F.col("n") / percent), F.floor((100 + percent) * F.col("left") / percent) - F.col("n"))
    x, y = (rows.select("token", F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("left").alias(f"left{c}"), F.col("comp").alias(f"c{c}"), (most if c == "a" else F.col("n")).alias(f"m{c}")) for c in "ab")
    x = x.where("ma >= na").withColumn("band", F.explode(F.sequence(band("na"), band("ma"))))
    y = y.withColumn("band", band("nb")).drop("mb")
    both = x.join(y, ["token", "band"]).where("ca != cb and (na < nb or (na = nb and a < b)) and nb <= ma")
    return both.where(F.col("leftb") >= _need("na", "nb", percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _verify_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that share prefix tokens under B and C, and whose sets are similar."""
    for b in batches:
        keep = []
        for i, row in enumerate(zip(*(b[c].to_pylist() for c in ("ta", "fa", "tb", "fb")), strict=True)):
            ta, fa, tb, fb = (np.frombuffer(x, kind) for x, kind in zip(row, (np.uint64, np.uint8) * 2, strict=True))
            if all(len(np.intersect1d(ta[prefix(ta, fa, o, percent)], tb[prefix(tb, fb, o, percent)], True)) for o in "BC"):
                both = len(np.intersect1d(ta, tb, True))
                if 100 * both >= percent * (len(ta) + len(tb) - both):
                    keep.append(i)
        yield pa.RecordBatch.from_arrays([b["a"].take(pa.array(keep, pa.int64())), b["b"].take(pa.array(keep, pa.int64()))], ["a", "b"])


def _links(pairs: DataFrame, classes: DataFrame, percent: int, name: str) -> DataFrame:
    left, right = (classes.select(F.col("cid").alias(c), F.col("tokens").alias(f"t{c}"), F.col("freq").alias(f"f{c}")) for c in "ab")
    return materialize(pairs.join(left, "a").join(right, "b").mapInArrow(lambda it: _verify_rows(it, percent), "a long, b long"), name)


def _with_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Prefix rows of tokens whose holders are in more than one component, with these."""
    labelled = rows.join(labels.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    labelled = materialize(labelled, "labelled")
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("token")
    return labelled.join(mixed, "token")


def _link_classes(classes: DataFrame, n_runs: int, percent: int) -> DataFrame | None:
    """node, comp of the classes that are linked with another one; None if there are none. ``classes``: cid, n, tokens."""
    for k in range(RECOUNTS):
        before, classes = classes, _recount(classes, n_runs, percent)
        if k:
            discard(before)
    rows = materialize(prefix_table(classes, "A", percent), "prefixes")
    if rows.isEmpty():
        discard(classes, rows)
        return None
    tried = materialize(_hub_pairs(rows.withColumn("comp", F.col("cid")), percent).distinct(), "pairs")
    links = _links(tried, classes, percent, "links")
    labels = components(links)
    first = materialize(_with_components(rows, labels), "open")
    open_classes = classes.join(first.select("cid").distinct(), "cid", "left_semi")
    second = _with_components(prefix_table(open_classes, "B", percent), labels)
    rest = _all_pairs(first, percent).intersect(_all_pairs(second, percent)).join(tried, ["a", "b"], "left_anti")
    more = _links(rest, classes, percent, "links")
    labels = labels if more.isEmpty() else components(links.union(more))
    discard(classes, rows, tried, first, links, more)
    return labels


def _classes_and_firsts(sets: DataFrame, percent: int, run_bytes: int) -> tuple[DataFrame, DataFrame]:
    """node, cid, comp and first (the smallest did of the component) of each class."""
    known = sets.where("node is not null")
    classes = known.groupBy("node").agg(F.min("did").alias("first"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    size = classes.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0)).alias("b")).first()["b"]
    labels = _link_classes(classes.select("cid", "n", "tokens"), max(1, -(-size // run_bytes)), percent)
    own = materialize(classes.select("node", "cid", "first"), "nodes")
    discard(classes)
    if labels is None:
        return own.select("node", F.col("cid").alias("comp"), "first")
    own = own.join(labels.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    own = materialize(own, "components")
    firsts = own.groupBy("comp").agg(F.min("first").alias("first"))
    return own.drop("first").join(firsts, "comp").select("node", "comp", "first")


def _grouped(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, run_bytes: int) -> DataFrame:
    """doc_id, key (hash of the text), n, comp (null: alone), first (smallest did of the component) of every row."""
    whole = shingle_table(docs, words, percent, id_col, text_col, run_bytes)
    firsts = _classes_and_firsts(whole, percent, run_bytes)
    sets = materialize(whole.drop("tokens"), "documents")
    discard(whole)
    near = sets.where("node is not null").select("doc_id", "key", "n", "node").join(firsts, "node").select("doc_id", "key", "n", "comp", "first")
    return near.union(sets.where("node is null").select("doc_id", "key", "n", F.lit(None).cast("long"), "did"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``: two documents are linked if 100 * shared shingles >=
    percent * all their shingles, and a component is what links join; its id is its smallest doc_id.

    Null and empty texts, and texts without words, have no shingles and are alone. A null doc_id stays null; it gives its
    name to no component that has another id. Repeated rows are linked with each other. An empty table gives none; other
    columns aren't read."""
    rows = _grouped(docs, words, percent, id_col, text_col, run_bytes)
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("first") != int(NO_ID), F.col("first")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with all its columns; of rows that are equal in id and
    text one. Of several texts in a component that share this id, one stays; those in other components aren't touched.
    Documents without doc_id, without text or without words are kept, but for repeated rows of one id and text."""
    rows = _grouped(docs.select(id_col, text_col), words, percent, id_col, text_col, run_bytes).where("doc_id is not null")
    rows = rows.select("doc_id", "key", "comp", (F.col("first") < F.col("doc_id")).alias("later"))
    best = rows.where("not later and comp is not null").groupBy("comp", "doc_id").agg(F.min("key").alias("best"))
    same = rows.where("not later").join(best, ["comp", "doc_id"]).where("key != best").select("doc_id", "key")
    drop = rows.where("later").select("doc_id", "key").union(same).distinct()
    key = unused(docs, "key")
    keyed = docs.where(F.col(id_col).isNotNull()).withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))
    drop = drop.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("key").alias(key))
    kept = keyed.join(drop, [id_col, key], "left_anti").dropDuplicates([id_col, key])
    return kept.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON reach.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT reach.a AS r, min(t.doc_id) AS component_id FROM reach JOIN d t ON t.r = reach.b GROUP BY reach.a) c USING (r)
"""
