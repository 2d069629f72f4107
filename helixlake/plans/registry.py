"""Where queries register themselves, with their SQL."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.geometry import NUDGE, half_away
from ..operators.geometry import six as r6

QUERIES: dict = {}
SQL: dict[str, str] = {}


def settled(sql: str) -> str:
    """What ``r6`` does, for ``round(x, 6)`` in a SQL text."""
    out, at = [], 0
    while (k := sql.find("round(", at)) >= 0:
        depth, end = 1, k + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        body = sql[k + 6 : end - 1]
        out.append(sql[at:k] + (f"(round({settled(body[:-3])} + {NUDGE}, 6) + 0.0)" if body.endswith(", 6") else f"round({settled(body)})"))
        at = end
    return "".join(out) + sql[at:]


def _text(keys: list[str], values: list[str]) -> str:
    """A row as text, the same in both engines: whole keys, and values in millionths."""
    cells = [f"CAST({k} AS VARCHAR(20))" for k in keys] + [f"CAST(CAST(round({v} * 1000000) AS BIGINT) AS VARCHAR(20))" for v in values]
    return "concat(" + ", ',', ".join(f"coalesce({c}, '-')" for c in cells) + ")"


def digest(df: DataFrame, by: list[str], keys: list[str], values: list[str]) -> DataFrame:
    """One row a group in place of millions: the number of rows, and the sum of a 60-bit hash of each row's keys and values.
    Halves of the hash are summed as long numbers, which is faster than decimals and exact for 2^33 rows."""
    cell = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    cells = [cell(F.col(k)) for k in keys] + [cell(half_away(F.col(v).cast("double") * 1000000).cast("long")) for v in values]
    text = F.concat(*[x for c in cells for x in (F.lit(","), c)][1:])
    hashed = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    sums = df.select(*by, hashed.alias("_h")).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.shiftright("_h", 30)).alias("_high"), F.sum(F.col("_h").bitwiseAND((1 << 30) - 1)).alias("_low"))
    whole = F.col("_high").cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(10,0)") + F.col("_low").cast("decimal(20,0)")
    return sums.select(*by, "n", whole.cast("string").alias("digest"))


def digest_sql(sql: str, by: list[str], keys: list[str], values: list[str]) -> str:
    """The same over a SQL text."""
    hashed = f"CAST(('0x' || substr(md5({_text(keys, values)}), 1, 15)) AS BIGINT)"
    return f"SELECT {', '.join(by)}, count(*) AS n, CAST(sum({hashed}) AS VARCHAR) AS digest FROM ({sql}) GROUP BY ALL"


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Registers ``f(spark, sf_dir)``. ``sql`` may start with further WITH members, which the views come before."""

    def add(f):
        from .views import view_sql

        QUERIES[name] = f
        if sql is not None:
            text = settled(sql.strip())
            if views:
                head, rest = re.match(r"(?is)(WITH\s+(?:RECURSIVE\s+)?)?(.*)", text).groups()
                text = f"{head}{view_sql(*views)}, {rest}" if head else f"WITH {view_sql(*views)} {text}"
            SQL[name] = text
        return f

    return add


def on(*views: str):
    """Hands a query's views to it as DataFrames."""

    def wrap(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            from .views import view

            return f(*(view(spark, sf_dir, v) for v in views))

        return run

    return wrap
