"""Bounded samples and the dealing of repeated rows, at any number of rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixlake.llm import exchange, language_id, suffix_dedup, toxicity


def test_toxicity_sample_is_bounded_and_weighted(spark):
    rows = spark.createDataFrame([("same text", 0)] * 500 + [(f"t{k}", k % 2) for k in range(300)] + [("", 0)] * 50, "text string, label int")
    got = toxicity.sample_rows(rows, 10_000).toPandas()
    assert len(got) == 302 and got["n"].sum() == 850
    assert got.set_index("text").loc["same text", "n"] == 500
    few = toxicity.sample_rows(rows, 40).toPandas()
    assert len(few) == 40 and len(few.drop_duplicates(["text", "label"])) == 40
    # ten times as many rows give as many samples
    many = rows.unionAll(spark.range(3000).select(F.concat(F.lit("u"), F.col("id").cast("string")), F.lit(1)))
    assert toxicity.sample_rows(many, 40).count() == 40


def test_weights_are_repeats():
    r = np.random.default_rng(1)
    x, y, n = r.normal(size=(60, 2)), r.integers(0, 2, 60), r.integers(1, 5, 60)
    assert np.allclose(toxicity.fit_logistic(x, y, weights=n), toxicity.fit_logistic(np.repeat(x, n, axis=0), np.repeat(y, n)), atol=1e-6)


def test_language_sample(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language_id, "fit", lambda langs, texts, y, **_: seen.update(langs=langs, texts=texts, y=y))
    rows = [("hot", "en")] * 400 + [(f"word{k}", "en") for k in range(200)] + [(f"wort{k}", "de") for k in range(5)] + [(None, "en"), ("x", None)]
    language_id.train(spark.createDataFrame(rows, "text string, lang string"), sample_docs=50)
    assert seen["langs"] == ["de", "en"] and seen["y"].count(0) == 5 and seen["y"].count(1) == 50
    assert len(set(seen["texts"])) == 55


def test_repeated_row_goes_to_many_runs(spark):
    rows = [(1, "a repeated row " * 20)] * 400 + [(k, f"text {k}") for k in range(2, 40)] + [(None, "no id")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed, n_runs = exchange.runs_of(docs, run_bytes=2_000)
    got = packed.toPandas()
    assert got["n"].sum() == len(rows) and n_runs > 50
    held = got.groupby("run")["n"].sum()
    assert held.max() <= 4 * len(rows) / n_runs + 10
    # nothing changes in what is removed
    out = {c: sorted(map(str, suffix_dedup.find_repeats(docs, run_bytes=c).select("doc_id", "n_removed", "text").collect())) for c in (2_000, 10**9)}
    assert out[2_000] == out[10**9]


def test_wide_ranges_do_not_thin_out():
    cuts = [b"%06d" % k for k in range(64_000)]
    for side in (2, 60, 3_536):
        assert len(suffix_dedup.wide_cuts(cuts, side)) == side - 1
    assert suffix_dedup.wide_cuts([], 5) == [] and suffix_dedup.wide_cuts([b"x"], 5) == [b"x"]


@pytest.mark.parametrize("n", [0, 3])
def test_no_repeats_stay_where_they_are(n):
    run = np.arange(n, dtype=np.int32)
    assert (exchange.spread_repeats(run, np.arange(n), [b"x"] * n, 9, 5) == run).all()
    assert pd.Series(exchange.spread_repeats(np.zeros(6, np.int32), np.zeros(6, np.int64), [b"x"] * 6, 4, 5)).value_counts().max() == 2
