"""Helpers that the training-data operators share: tables, scratch space, tokenizers."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a session in one process (``local``) may do without:
    a temporary folder is made there. On a cluster that would break, so it is an error."""
    context = spark.sparkContext
    set_one = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_one:
        return set_one
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="helixlake-")
    return _own_dirs[app]


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared scratch folder and reads it: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def fold_of(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 4; 2 is the held-out fold. A null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


@functools.lru_cache(maxsize=4)
def byte_bpe(vocab: str):
    """Encoder of a byte-level BPE rank file, with the added tokens of the tokenizers file beside it, if there is one:
    ``encode(text, allowed_special="all")`` gives the ids of that file (a test holds them against each other), at four
    times the speed."""
    import public_tokenizers
    import tiktoken

    with open(vocab, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    added = {}
    if os.path.exists(full := os.path.splitext(vocab)[0] + ".json"):
        with open(full, encoding="utf-8") as f:
            added = {x["content"]: x["id"] for x in json.load(f).get("added_tokens") or []}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each input bit over the word."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x
