"""The source divergence audit against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixlake.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(rows, min_docs, top):
    """rows: (lang, source, text)."""
    rows = [(a or "", b or "", terms_of(t)) for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(t for _, _, ts in own for t in set(ts))
        kept = {t for t, n in docs.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for _, source, ts in own:
            counts[source].update(t for t in ts if t in kept)
        every = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(counts[s]) for s in counts}, share(every)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            words = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", words, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


SHORT = ["a", "Ab", "abcdefgh", "abcdefghi", "ABCDEFGHIJKLMNOP", "abcdefghijklmnopq", "x" * 40, "Éé", "é", "ümlautwört", "漢字" * 9, "z" * 3000]


def corpus():
    r = random.Random(3)
    rows = [("en" if r.random() < 0.6 else "de", f"s{r.randrange(4)}", " ".join(r.choice(SHORT) + r.choice([" ", "1", "\x00", "_", "\x7f"]) for _ in range(r.randrange(40)))) for _ in range(80)]
    return [*rows, *rows[:3], (None, "s1", "a b"), (None, None, None), ("fr", "s9", "only here"), ("fr", "s8", ""), ("en", "empty", None), ("en", None, "a a a"), ("es", "lone", "a")]


def test_audit(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*x, "n", "p", "q", 1) for x in rows], "lang string, source string, text string, n string, p string, term string, size int")
    for min_docs, top, block in ((3, 10, divergence.BLOCK_BYTES), (1, 2, 50)):
        monkeypatch.setattr(divergence, "BLOCK_BYTES", block)
        got = divergence.divergence_audit(df, min_docs=min_docs, top=top)
        assert sorted(map(tuple, got.collect())) == plain(rows, min_docs, top)
    assert divergence.divergence_audit(df.where("false")).collect() == []


def test_hot_source_and_very_long_text(spark):
    rows = [("en", "hot", "same words here")] * 60 + [("en", f"s{k}", "same " + "other " * k) for k in range(30)] + [("en", "long", "w" * 300_000 + " same" * 200_000)]
    got = divergence.divergence_audit(spark.createDataFrame(rows, "lang string, source string, text string"), min_docs=2)
    assert sorted(map(tuple, got.collect())) == plain(rows, 2, 10)


def test_counts_beyond_64_bits(spark):
    """A count times SCALE doesn't fit 64 bits: shares stay exact."""
    df = spark.createDataFrame([(10**12 + 7, 3 * 10**12 + 1)], "n long, size long")
    assert df.select(divergence._share("n", "size")).first()[0] == 1 + 10**9 * (10**12 + 9) // (3 * 10**12 + 1)


def test_buckets_sort_as_bytes():
    r = random.Random(1)
    texts = [" ".join(r.choice(SHORT) for _ in range(200)).encode() for _ in range(5)]
    group = np.array([0, 1, 0, 1, 2])
    found = defaultdict(lambda: [0, 0])
    for g, terms, n, docs in divergence.count_terms(texts, group):
        rows = list(zip(g.tolist(), terms.to_pylist(), strict=True))
        assert rows == sorted(rows) or len({len(t) > 16 for _, t in rows}) > 1
        for key, a, b in zip(rows, n.tolist(), docs.tolist(), strict=True):
            assert key not in found
            found[key] = [a, b]
    want = defaultdict(lambda: [0, 0])
    for t, g in zip(texts, group.tolist(), strict=True):
        for term, n in Counter(x.encode() for x in terms_of(t.decode())).items():
            want[g, term][0] += n
            want[g, term][1] += 1
    assert found == want


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_radix_order(n):
    r = np.random.default_rng(2)
    a, b = r.integers(0, 2**63, n).astype(np.uint64), r.integers(0, 5, n).astype(np.uint32)
    assert (divergence.radix_order([a, b]) == np.lexsort((a, b))).all()
