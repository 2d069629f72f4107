"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves, each quantised with its own codebook (k-means on a bounded sample); a cell is a pair of
centroids, so a few hundred centroids address their square in cells. Every row is indexed. The measure is the inner
product, of vectors of any length. A query walks the cells with a heap over the sorted centroid lists, from the largest
sum of what the two half-cells promise on: the inner product with the centroid, raised by ``margin`` standard deviations of
the inner product with a residual. It stops when no cell left promises more than the centroids alone say of the cells that
hold the best vectors so far: soon where vectors form clusters, late where they have no structure. The entries of the cells
walked are ranked by the true measure in double precision.

Equal vectors are one entry that carries the smallest ids, as many as a result can use: a group of copies of any size
costs one entry in one cell. Cells are gathered, or large ones cut, into blocks of bounded size; queries are dealt to parts
of bounded size by the cell that they are in themselves, and a part is sent the blocks that its queries ask for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Vectors that the codebooks are fitted to, at most.
SAMPLE_ROWS = 20_000
#: Standard deviations of a residual's inner product that a half-cell may promise beyond its centroid.
MARGIN = 1.1
MAX_CENTROIDS = 256
BLOCK_ENTRIES, BLOCK_QUERIES = 4_096, 2_048
#: Queries that walk the cells in one task.
PROBE_QUERIES = 256
TOP = 20


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)


def walk(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Pairs of centroids and their sums by rising sum of distances. Each row of the first list has one pair in the heap;
    a row enters when the first pair of the row before it leaves."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap = [(s1[0] + s2[0], 0, 0)]
    while heap:
        d, i, j = heap[0]
        yield o1[i], o2[j], d
        if j + 1 < len(o2):
            heapq.heapreplace(heap, (s1[i] + s2[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < len(o1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))


class Codebooks:
    """Two codebooks of at most MAX_CENTROIDS each: bounded, so they can go to all executors."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second

    def cells(self, x: np.ndarray) -> np.ndarray:
        return self.place(x)[0]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, and how far each half lies from its centroid."""
        h = self.first.shape[1]
        a, b = nearest(x[:, :h], self.first), nearest(x[:, h:], self.second)
        return a * len(self.second) + b, np.linalg.norm(x[:, :h] - self.first[a], axis=1), np.linalg.norm(x[:, h:] - self.second[b], axis=1)


def promises(x: np.ndarray, c: np.ndarray, spread: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Inner products with the centroids, and what half-cells promise: ``margin`` standard deviations more of the inner
    product with a residual of length ``spread`` in a random direction."""
    if not x.shape[1]:
        return np.zeros((len(x), len(c))), np.zeros((len(x), len(c)))
    near = x @ c.T
    return near, near + margin * np.linalg.norm(x, axis=1)[:, None] * spread / np.sqrt(x.shape[1])


def cells_to_ask(near: tuple[np.ndarray, np.ndarray], promised: tuple[np.ndarray, np.ndarray], sizes: dict[int, int], wanted: int) -> Iterator[int]:
    """Occupied cells in the order of the walk, until none left promises more than the centroids of the cells that hold the
    ``wanted`` best vectors say."""
    n1, n2 = near[0].tolist(), near[1].tolist()
    best: list[tuple[float, int]] = []  # the cells walked that hold the best by their centroids, the worst of them first
    held = 0
    for i, j, d in walk(-promised[0], -promised[1]):
        if held >= wanted and -d < best[0][0]:
            return
        cell = i * len(n2) + j
        n = sizes.get(cell)
        if n:
            yield cell
            own = n1[i] + n2[j]
            if held < wanted or own > best[0][0]:
                heapq.heappush(best, (own, n))
                held += n
                while held - best[0][1] >= wanted:
                    held -= heapq.heappop(best)[1]


def deal(sizes: dict[int, int], most: int = BLOCK_ENTRIES) -> tuple[dict[int, int], dict[int, int]]:
    """The first block of each cell and its number of blocks: neighbours share a block, a large cell takes several."""
    first, many, block, held = {}, {}, 0, 0
    for cell in sorted(sizes):
        n = sizes[cell]
        if held and held + n > most:
            block, held = block + 1, 0
        first[cell], many[cell] = block, -(-n // most)
        block, held = (block + many[cell], 0) if n > most else (block, held + n)
    return first, many


def usable(vec: str):
    """Neither null nor zero, and without null or non-finite components."""
    c = F.col(vec)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch[name].combine_chunks() if isinstance(batch[name], pa.ChunkedArray) else batch[name]
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def fit(vectors: DataFrame, n: int) -> Codebooks:
    """Codebooks from a hash sample of at most SAMPLE_ROWS of ``n`` distinct vectors."""
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    rows = vectors.where(F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < max(1, int(1e6 * share))).select("vec").limit(2 * SAMPLE_ROWS).toPandas()["vec"]
    x = np.array(rows.tolist(), np.float64) if len(rows) else np.array([vectors.first()["vec"]], np.float64)
    h = (x.shape[1] + 1) // 2
    k = int(min(MAX_CENTROIDS, max(1, round(5 * n**0.25))))
    return Codebooks(kmeans(x[:, :h], k), kmeans(x[:, h:], k) if x.shape[1] > h else np.zeros((1, 0)))


def search(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, top: int = TOP, margin: float = MARGIN) -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` nearest found of each row whose id is divisible by ``every``.

    Rows with a null id, or an unusable vector (null, empty, zero, null or non-finite components), take no part, nor do
    vectors of another length than the most frequent one, which have no inner product with it. Rows of equal id and vector
    count once; a row with the query's id is no candidate for it. An id with several vectors has one list, of what is nearest
    to any of them. Extra columns don't matter; an empty table gives no rows."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(vec_col))
    width = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    out = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], out)
    # equal vectors become one entry with the ids a result can use: the smallest of each salt, then of all
    rows = rows.where(F.size("vec") == width["w"]).dropDuplicates(["id", "vec"])
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    few = rows.withColumn("salt", salt).withColumn("r", F.row_number().over(Window.partitionBy("vec", "salt").orderBy("id"))).where(f"r <= {top + 1}")
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(f"r <= {top + 1}")
    entries = materialize(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    n = entries.count()
    books = spark.sparkContext.broadcast(fit(entries, n))
    half = books.value.first.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far1, far2 = books.value.place(_vectors(b, "vec"))
            kept = [c for c in b.schema.names if c != "vec"]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far1**2), pa.array(far2**2), b["vec"], *(b[c] for c in kept)], ["cell", "far1", "far2", "vec", *kept])

    where = "cell long, far1 double, far2 double, vec array<double>"
    placed = materialize(entries.mapInArrow(place, f"{where}, ids array<long>"), "cells")
    held = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum("far1").alias("far1"), F.sum("far2").alias("far2")).collect()  # MAX_CENTROIDS squared at most
    sizes = {r["cell"]: r["n"] for r in held}
    n2 = len(books.value.second)
    sums = np.array([[*divmod(r["cell"], n2), r["n"], r["far1"], r["far2"]] for r in held])
    spread = []
    for k, c in enumerate((books.value.first, books.value.second)):
        own, size = (np.bincount(sums[:, k].astype(int), sums[:, m], len(c)) for m in (3 + k, 2))
        spread.append(np.sqrt(own / np.maximum(size, 1)))
    first_block, n_blocks = deal(sizes)
    layout = spark.sparkContext.broadcast((sizes, first_block, n_blocks, spread))

    queries = materialize(rows.where(F.pmod(F.col("id"), F.lit(every)) == 0).select("id", "vec").mapInArrow(place, f"{where}, id long").drop("far1", "far2"), "queries")
    asking = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}  # as many cells at most
    parts = spark.sparkContext.broadcast(deal(asking, BLOCK_QUERIES))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, many, far = layout.value
        part, split = parts.value
        for b in batches:
            x = _vectors(b, "vec")
            near1, said1 = promises(x[:, :half], books.value.first, far[0], margin)
            near2, said2 = promises(x[:, half:], books.value.second, far[1], margin)
            at, block, cells = [], [], []
            for q in range(len(x)):
                asked: dict[int, list[int]] = {}
                for cell in cells_to_ask((near1[q], near2[q]), (said1[q], said2[q]), size, top + 1):
                    for k in range(first[cell], first[cell] + many[cell]):
                        asked.setdefault(k, []).append(cell)
                at += [q] * len(asked)
                block += asked.keys()
                cells += asked.values()
            own = np.array([part[c] + i % split[c] for c, i in zip(b["cell"].to_pylist(), b["id"].to_pylist(), strict=True)], np.int32)
            at = np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at)), b["vec"].take(pa.array(at)), pa.array(block, pa.int32()), pa.array(own[at] if len(at) else [], pa.int32()), pa.array(cells, pa.list_(pa.int64()))], ["id", "vec", "block", "part", "cells"])

    dealt_queries = queries.repartition(max(1, -(-sum(asking.values()) // PROBE_QUERIES)), "id")
    asked = materialize(dealt_queries.mapInArrow(probe, "id long, vec array<double>, block int, part int, cells array<long>"), "asked")

    def deal_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, many, _ = layout.value
        for b in batches:
            block = [first[c] + i % many[c] for c, i in zip(b["cell"].to_pylist(), b["salt"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["cell"], b["vec"], b["ids"], pa.array(block, pa.int32())], ["cell", "vec", "ids", "block"])

    salted = placed.select("cell", "vec", "ids", F.pmod(F.xxhash64("vec"), F.lit(1 << 30)).cast("int").alias("salt"))
    dealt = salted.mapInArrow(deal_out, "cell long, vec array<double>, ids array<long>, block int")
    pairs = asked.select(F.col("block").alias("asked_block"), F.col("part").alias("part")).distinct()
    dealt = dealt.join(pairs, F.col("block") == F.col("asked_block")).select("cell", "vec", "ids", "block", F.col("part").alias("to_part"))

    def rank(q: pa.Table, e: pa.Table) -> pa.Table:
        found = []
        if len(q) and len(e):
            e = e.sort_by("cell")
            x, y, own = _vectors(q, "vec"), _vectors(e, "vec"), e["ids"].to_pylist()
            qid, cell = q["id"].to_pylist(), e["cell"].to_numpy()
            wanted: dict[int, list[int]] = {}
            for i, cells in enumerate(q["cells"].to_pylist()):
                for c in cells:
                    wanted.setdefault(c, []).append(i)
            s = np.full((len(x), len(y)), -np.inf)  # a block by a part
            cuts = np.flatnonzero(np.diff(cell, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cell)], strict=True):
                who = wanted.get(int(cell[a]))
                if who:
                    s[who, a:b] = x[who] @ y[a:b].T
            m = min(top + 1, len(y))  # one of them may be the query's own
            for at in range(0, len(x), 128):
                t = s[at : at + 128]
                floor = np.partition(t, len(y) - m, axis=1)[:, len(y) - m]
                slack = np.where(np.isfinite(floor), 1e-9 * np.abs(floor) + 1e-12, 0)
                for i, j in zip(*np.nonzero((t >= (floor - slack)[:, None]) & (t > -np.inf)), strict=True):
                    found += [(qid[at + i], v, float(np.dot(x[at + i], y[j]))) for v in own[j]]
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    near = asked.groupBy("block", "part").cogroup(dealt.groupBy("block", "to_part")).applyInArrow(rank, "query_id long, vec_id long, score double")
    near = near.where("query_id != vec_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_approximate_nearest_neighbours(spark, sf_dir):
    """Results are approximate, so SQL can't stand for them: a test measures recall against brute force."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
