"""Many text files, one for each key: tasks write and read them as files, without a Hadoop stream and its calls for each."""

from __future__ import annotations

import errno
import json
import os
import re
import shutil
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, WriterCommitMessage

from .dense import DenseWriter, local_path

FORMAT = "text_files"
#: Lines that a task holds before it writes or sends them, and bytes that it reads of a file at once.
HELD, READ = 20_000, 1 << 22
#: How partition folders name what isn't there, and what they write as %XX.
NOTHING, ESCAPED = "__HIVE_DEFAULT_PARTITION__", re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def is_mounted(spark: SparkSession, path: str) -> bool:
    """Whether a path names a folder of the file system that is mounted, not one of a remote store."""
    if "://" in path or path.startswith("file:"):
        return path.startswith("file:")
    return spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")


def folder(names: list[str], values: tuple) -> str:
    """The partition folder of a key."""
    text = lambda v: ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", str(v)) if v not in (None, "") else NOTHING
    return "/".join(f"{n}={text(v)}" for n, v in zip(names, values, strict=True))


@dataclass
class Folder(WriterCommitMessage):
    """What a task wrote, whatever the number of its files."""

    path: str


def merge(source: str, target: str) -> None:
    """Moves what a folder holds, whole folders where the target has none of that name."""
    for name in os.listdir(source):
        old, new = os.path.join(source, name), os.path.join(target, name)
        try:
            os.rename(old, new)
        except OSError as e:
            if e.errno not in (errno.ENOTEMPTY, errno.EEXIST):
                raise
            merge(old, new)


class TextWriter(DenseWriter):
    """Rows come in order of their keys. A task writes below a folder of its own, which the driver only moves into place: of
    files it hears nothing."""

    def __init__(self, path: str, names: list[str], splits: list[str], overwrite: bool):
        super().__init__(path)
        self.names, self.splits, self.overwrite = names, splits, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Folder:
        attempt = os.path.join(self.job, f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}")
        os.makedirs(attempt)
        last, lines, held = None, {}, 0

        def flush(key: tuple) -> None:
            for (split, part), own in lines.items():
                at = folder(self.names, key) if split is None else f"{folder(['by'], (split,))}/{folder([*self.names, 'part'], (*key, part))}"
                os.makedirs(f"{attempt}/{at}", exist_ok=True)
                with open(f"{attempt}/{at}/lines.txt", "ab") as out:
                    out.write("\n".join(own).encode() + b"\n")
            lines.clear()

        for batch in iterator:
            values = [v or "" for v in batch["value"].to_pylist()]
            keys = list(zip(*(batch[c].to_pylist() for c in self.names), strict=True))
            parts = [(s, batch[s].to_pylist()) for s in self.splits] or [(None, [None] * len(values))]
            for i, key in enumerate(keys):
                if key != last or held >= HELD:
                    if lines:
                        flush(last)
                    last, held = key, 0
                held += 1
                for split, part in parts:
                    own = (split, part[i])
                    if own in lines:
                        lines[own].append(values[i])
                    else:
                        lines[own] = [values[i]]
        if lines:
            flush(last)
        return Folder(attempt)

    def commit(self, messages: list[Folder | None]) -> None:
        for n in os.listdir(self.path) if self.overwrite else ():
            old = os.path.join(self.path, n)
            if old != self.job:
                shutil.rmtree(old) if os.path.isdir(old) else os.remove(old)
        for m in messages:
            if m:
                merge(m.path, self.path)
        self._clear()


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Spark lists many folders with a task for each, which takes longer to start than to list one: for a while four tasks a core
    share them."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> TextWriter:
        splits = json.loads(self.options["splits"])
        return TextWriter(self.options["path"], [f.name for f in schema.fields if f.name not in ("value", *splits)], splits, overwrite)


def write_text_files(rows: DataFrame, path: str, by: list[str], order: str, splits: tuple[str, ...] = (), dealt: bool = False) -> None:
    """The column ``value`` of the rows of each key in a folder of its own (``a=1/b=2/``), as lines by ``order``. What the path
    held before goes. On a mounted folder tasks write the files themselves; a remote store gets them from Spark's writer.
    ``splits``: instead, for each of these columns, a folder for each of its values (``by=c/a=1/b=2/part=x/``), all in one pass.
    ``dealt``: rows of a key are in one task already."""
    spark = rows.sparkSession
    # empty text has the folder of nothing, so it is one key with it
    rows = rows.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c, t in rows.select(*by, *splits).dtypes if t == "string"})
    if not is_mounted(spark, path):
        names = by
        if splits:
            names = ["by", *by, "part"]
            rows = rows.select(*by, order, "value", F.explode(F.array(*(F.struct(F.lit(c).alias("by"), F.col(c).cast("string").alias("part")) for c in splits))).alias("_s")).select("*", "_s.*")
        rows.repartition(*names).sortWithinPartitions(*names, order).select(*names, "value").write.partitionBy(*names).mode("overwrite").text(path)
        return
    spark.dataSource.register(TextFiles)
    os.makedirs(local_path(path), exist_ok=True)
    rows = (rows if dealt else rows.repartition(*by)).sortWithinPartitions(*by, order).select(*by, *splits, "value")
    rows.write.format(FORMAT).mode("overwrite").option("path", path).option("splits", json.dumps(splits)).save()


def read_text_files(spark: SparkSession, path: str, names: list[str], level: int = 0) -> DataFrame:
    """The lines that ``write_text_files`` wrote, as ``value`` next to the keys (``names``, as text). On a mounted folder tasks deal
    the folders of a level among themselves and list what is below: the driver lists nothing. A remote store is read by Spark."""
    schema = ", ".join(f"`{n}` string" for n in ("value", *names))
    if not is_mounted(spark, path):
        return spark.read.schema(schema).text(path)
    root, tasks = local_path(path), 4 * spark.sparkContext.defaultParallelism

    def files(at: str, key: tuple, own: int) -> Iterator[tuple[str, tuple]]:
        with os.scandir(at) as entries:
            for e in entries:
                if len(key) == len(names):
                    if not e.name.startswith(("_", ".")):
                        yield e.path, key
                elif e.name.startswith(f"{names[len(key)]}=") and (len(key) != level or zlib.crc32(e.name.encode()) % tasks == own):
                    text = e.name.partition("=")[2]
                    yield from files(e.path, (*key, None if text == NOTHING else unquote(text)), own)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in (x for b in batches for x in b["id"].to_pylist()):
            values, keys, runs = [], [], []
            for at, key in files(root, (), own):
                with open(at, encoding="utf-8", errors="replace") as f:  # any line end, as Spark's reader takes them
                    while got := f.readlines(READ):
                        values += [x.removesuffix("\n") for x in got]
                        keys.append(key)
                        runs.append(len(got))
                        if len(values) >= HELD:
                            yield batch(values, keys, runs)
                            values, keys, runs = [], [], []
            if values:
                yield batch(values, keys, runs)

    def batch(values: list[str], keys: list[tuple], runs: list[int]) -> pa.RecordBatch:
        at = pa.array(np.repeat(np.arange(len(keys)), runs))
        return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), *(pa.array(k, pa.string()).take(at) for k in zip(*keys, strict=True))], ["value", *names])

    return spark.range(0, tasks, 1, tasks).mapInArrow(lines, schema)
