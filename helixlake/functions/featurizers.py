"""User functions over one structure at a time, with failures kept apart from results."""

from __future__ import annotations

import traceback
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.scratch import written

_FEATURIZERS: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame | None], str]] = {}


def register_featurizer(name: str, function: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> None:
    """``function`` takes the rows of one structure and returns rows of ``schema``, or None."""
    _FEATURIZERS[name] = (function, schema)


def featurize(df: DataFrame, name: str, by: str = "cath_domain") -> DataFrame:
    """The registered function's rows for every structure; a failure stops the job (``safe_map`` doesn't)."""
    function, schema = _FEATURIZERS[name]
    empty = df.sparkSession.createDataFrame([], schema).columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = function(rows)
        return pd.DataFrame(columns=empty) if out is None else out

    return df.groupBy(by).applyInPandas(run, schema)


def map_groups(df: DataFrame, function: Callable[[pd.DataFrame], object], by: str, schema: str, stage: str = "map") -> DataFrame:
    """Calls a function on the rows of each key and keeps failures apart, in one pass: a written table (by, rows, stage,
    message). ``rows`` holds what the function returned, as an array of structs of ``schema``: a frame of any number of rows, a
    dict (one row), another value (one row of one column) or None (no row). A key whose function, or whose result, fails has
    null rows and the message. The function runs once a key, however often results and failures are read."""
    result = df.sparkSession.createDataFrame([], schema).schema
    names = result.names
    kind = df.schema[by]
    out = T.StructType([kind, T.StructField("rows", T.ArrayType(result)), T.StructField("stage", T.StringType()), T.StructField("message", T.StringType())])
    arrow = to_arrow_schema(out)

    def records(value: object) -> list[dict]:
        if value is None:
            return []
        if isinstance(value, pd.DataFrame):
            missing = [n for n in names if n not in value.columns]
            if missing:
                raise ValueError(f"the result has no column {', '.join(missing)}")
            return pa.Table.from_pandas(value[names], preserve_index=False).to_pylist()
        if isinstance(value, dict):
            return [{n: value[n] for n in names}]
        if len(names) > 1:
            raise ValueError("one value for several columns")
        return [{names[0]: value}]

    def run(t: pa.Table) -> pa.Table:
        key = t[by][0].as_py()
        try:
            row = {by: key, "rows": records(function(t.to_pandas())), "stage": stage, "message": None}
            return pa.Table.from_pylist([row], schema=arrow)
        except Exception as e:
            last = traceback.format_exception_only(e)[-1].strip()
            return pa.Table.from_pylist([{by: key, "rows": None, "stage": stage, "message": last}], schema=arrow)

    return written(df.groupBy(by).applyInArrow(run, out), "mapped")


def results(done: DataFrame, by: str) -> DataFrame:
    """The rows of the keys that went well: by and the result's columns."""
    return done.where("message is null").select(by, F.explode("rows").alias("_r")).select(by, "_r.*")


def failures(done: DataFrame, by: str) -> DataFrame:
    """The keys that failed: by, stage, message."""
    return done.where("message is not null").select(by, "stage", "message")


def safe_map(df: DataFrame, function: Callable[[pd.DataFrame], float], by: str, stage: str = "map") -> tuple[DataFrame, DataFrame]:
    """One number for each key, and for keys that fail the error: (key, value) and (key, stage, message), from one pass."""
    done = map_groups(df, lambda rows: float(function(rows)), by, "value double", stage)
    return results(done, by), failures(done, by)
