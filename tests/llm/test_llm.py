"""The training-data operators against plain versions, and their edge cases."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from helixlake.llm import ann, chunk_dedup, common, decontaminate, exchange, jaccard_join, language_id, packing, suffix_dedup, token_counts, toxicity, url_filter
from helixlake.llm.components import components
from helixlake.llm.exchange import squeeze, unsqueeze

DOCS = "doc_id long, text string, lang string, source string, n_chars long, run string, n string, text2 string"
SF = "/root/testdata/sf0.001"


def words(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsi", "zeta", "eta", "theta", "iota", "kappa", "Élan", "ñandú"]) + str(r.randrange(60)) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows and null ids."""
    r = random.Random(5)
    base = [words(r, n) for n in (80, 90, 200, 3, 1, 400, 61)]
    passage = words(r, 60)
    texts = [*base, base[0], base[0], base[1].replace("alpha", "ALPHA", 1), base[2] + " tail", passage, words(r, 50) + " " + passage + " " + words(r, 50), passage + words(r, 9), "", None, "   ", "% & !", base[5].replace("beta1", "beta2", 2), words(r, 3000), "a b c d", "a b c d", "x" * 120, "x" * 120]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, base[6]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else None, None, None, "x", "y", "z") for k, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


# --- 2: suffix dedup ------------------------------------------------------------------------------------------------


def plain_repeats(rows, w=50):
    """Removed bytes of each row."""
    big = 1 << 62
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - w + 1):
            first[b[p : p + w]] = min(first.get(b[p : p + w], big * 2), big if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - w + 1):
            if first[b[p : p + w]] < (big if i is None else i):
                gone[p : p + w] = [True] * w
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("run_bytes", [10_000, 8_000_000])
def test_suffix_dedup_equals_plain(docs, run_bytes):
    got = suffix_dedup.find_repeats(docs, run_bytes=run_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_repeats(corpus())


def test_suffix_dedup_in_two_levels(docs):
    """As many runs as call for wide and narrow ranges give the same."""
    got = suffix_dedup.find_repeats(docs, run_bytes=2_000, direct=4).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_repeats(corpus())


def test_suffix_dedup_of_nothing(none):
    assert suffix_dedup.find_repeats(none).isEmpty()


def test_merge_runs_never_loses_order():
    r = random.Random(1)
    runs = [sorted({bytes(r.choice(b"ab") for _ in range(r.randrange(1, 9))) + b"\xff" for _ in range(r.randrange(0, 30))}) for _ in range(5)]
    coded = [(x[0].tolist(), x[1]) for x in map(suffix_dedup.front_code, runs)]
    seq = list(suffix_dedup.merge_runs(coded))
    got = [runs[k][i] for k, i, _ in seq]
    assert got == sorted(s for x in runs for s in x)
    assert [same for *_, same in seq] == [k > 0 and got[k] == got[k - 1] for k in range(len(got))]


def test_window_hash_depends_on_content_alone():
    data = np.frombuffer(b"abcabcabcabcxabcabcabc", np.uint8)
    for n in (1, 5, 7, 20):
        h = suffix_dedup.window_hash(data, n)
        assert len(h) == len(data) - n + 1
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (data[i : i + n].tobytes() == data[j : j + n].tobytes())


# --- 5: chunk dedup -------------------------------------------------------------------------------------------------


def plain_chunks(b):
    """Chunks of bytes by a gear hash that is computed window by window."""
    table, n = chunk_dedup._GEAR.tolist(), len(b)
    mark = [sum(table[b[k - i]] << i for i in range(8) if k >= i) % 256 < chunk_dedup.MARKS for k in range(n)]
    natural = [k + 1 for k in range(8, n - 1) if mark[k] and not mark[k - 1]]
    places = []
    for k, z in zip([0, *natural], [*natural, n]):
        places += range(k, z, chunk_dedup.STRETCH) or [k]
    while_inside = lambda k: k if k >= n or b[k] & 0xC0 != 0x80 else while_inside(k + 1)
    places = sorted({while_inside(k) for k in places} - {n})
    out = []
    for k in places:
        if k + 64 <= n or k == 0:
            out.append((k, next((z for z in places if z >= k + 64), n)))
    if n >= 64 and out[-1][1] < n:
        out.append((out[-1][0], n))
    return out if n else []


def plain_chunk_dedup(rows, least=128):
    big, owner = 1 << 62, {}
    for i, t in rows:
        b = (t or "").encode()
        for a, z in plain_chunks(b):
            owner[b[a:z]] = min(owner.get(b[a:z], big), big if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        spans = []
        for a, z in plain_chunks(b):
            if owner[b[a:z]] < (big if i is None else i):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(z, spans[-1][1])
                else:
                    spans.append([a, z])
        spans = [s for s in spans if s[1] - s[0] >= least]
        kept = b"".join(b[z:a] for z, a in zip([0, *(z for _, z in spans)], [*(a for a, _ in spans), len(b)]))
        out.append((i, kept.decode(), len(plain_chunks(b)), len(b), len(b) - len(kept), len(spans)))
    return sorted(map(str, out))


@pytest.mark.parametrize("run_bytes", [10_000, 8_000_000])
def test_chunk_dedup_equals_plain(docs, run_bytes):
    got = chunk_dedup.dedup_chunks(docs, run_bytes=run_bytes).collect()
    want = plain_chunk_dedup(corpus())
    assert sorted(str(tuple(r)) for r in got) == want and any(int(r.n_removed) for r in got)


def test_chunk_dedup_resists_shifts(spark):
    r = random.Random(9)
    t = words(r, 120)
    rows = spark.createDataFrame([(1, t), (2, "inserted " + t), (3, words(r, 120))], "doc_id long, text string")
    got = {x.doc_id: x for x in chunk_dedup.dedup_chunks(rows).collect()}
    assert got[2].n_removed > 0.8 * len(t) and not got[1].n_removed and not got[3].n_removed


def test_chunk_dedup_of_nothing_and_rewrite(docs, none):
    assert chunk_dedup.dedup_chunks(none).isEmpty() and chunk_dedup.rewrite(none).isEmpty()
    out = chunk_dedup.rewrite(docs)
    assert out.columns == docs.columns and out.count() <= docs.count()


def test_chunks_catch_every_passage_of_51_words(spark):
    r = random.Random(21)
    short = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzñé日") for _ in range(r.randrange(2, 9))) for _ in range(n))
    rows, size = [], {}
    for k in range(600):
        p = short(51)
        size[1000 + k] = len(p.encode())
        rows += [(k, short(r.randrange(60)) + " " + p + " " + short(40)), (1000 + k, short(40) + " " + p + " " + short(r.randrange(60)))]
    got = chunk_dedup.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = [size[x.doc_id] - x.n_removed for x in got if x.doc_id >= 1000]
    assert all(x.n_removed for x in got if x.doc_id >= 1000) and sum(left) < 0.14 * sum(size.values())
    assert all(x.n_removed == 0 for x in got if x.doc_id < 1000)
    assert all(abs(x.n_removed + len(x.text.encode()) - x.n_bytes) == 0 for x in got)
    ours = {r.doc_id: r.n_removed for r in chunk_dedup.op5_substring_dedup(_Tables(spark, rows), "").collect()}
    assert ours == {x.doc_id: x.n_removed for x in got}


class _Tables:
    """Stands for the session: the reader gives one table."""

    def __init__(self, spark, rows):
        self.read, self.df = self, spark.createDataFrame(rows, "doc_id long, text string")

    def parquet(self, _):
        return self.df


def test_chunks_take_copies_whole_and_short_repeats_not(spark):
    r = random.Random(22)
    stock, flat = words(r, 12)[:100], "y" * 300
    rows = [(1, words(r, 80)), (3, "é" + words(r, 30) + flat + words(r, 30)), (5, stock + words(r, 40)), (6, words(r, 40) + stock), (7, "z" * 900), (8, "z" * 700), (9, ""), (10, None), (11, "日" * 60)]
    rows += [(20 + i, t) for i, t in rows if i in (1, 3, 11)]
    got = {x.doc_id: (x.n_removed, x.text) for x in chunk_dedup.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i][1] == "" for i in (21, 23, 31)) and got[8][0] >= 640 and all(got[i][0] == 0 for i in (1, 3, 5, 6, 7, 9, 10, 11))


# --- 6: Jaccard join ------------------------------------------------------------------------------------------------


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(str((d, len(s), least[root(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("run_bytes", [10_000, 8_000_000])
def test_jaccard_join_equals_plain(docs, run_bytes):
    got = jaccard_join.near_duplicates(docs, run_bytes=run_bytes).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_components(corpus())


def group(r, base, n, edits):
    """Copies of a text in which some words are changed, so that few are similar to each other."""
    rows = []
    for i in range(n):
        w = base.split()
        for k in range(edits(i)):
            w[(i * 13 + k * 29) % len(w)] = f"edit{i}"
        rows.append(" ".join(w))
    return rows


def test_jaccard_join_of_a_large_group_and_chains(spark):
    r = random.Random(2)
    base = words(r, 120)
    texts = group(r, base, 60, lambda i: i % 7)
    flow = words(r, 400).split()
    texts += [" ".join(flow[k : k + 90]) for k in range(0, 300, 6)]  # each is similar to its neighbours only
    rows = [(i + 10, t) for i, t in enumerate(texts)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(x)) for x in got) == plain_components(rows)


def test_jaccard_join_of_near_sets_without_links(spark):
    """A family without its original: all share most of their tokens, few are similar. The candidates stay few."""
    r = random.Random(8)
    texts = group(r, words(r, 150), 300, lambda i: 4 + i % 3)
    parts = [words(r, 40) for _ in range(12)]
    texts += [f"{parts[i]} {parts[j]}" for i in range(12) for j in range(i)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_duplicates(df).collect()
    assert sorted(str(tuple(x)) for x in got) == plain_components(rows)
    classes = jaccard_join.shingle_table(df).where("node is not null").select(F.monotonically_increasing_id().alias("cid"), "n", "tokens")
    classes = jaccard_join._recount(common.materialize(classes, "t"), 2, 80)
    rows = jaccard_join.prefix_table(classes, "A", 80).withColumn("comp", F.col("cid"))
    n = classes.count()
    assert jaccard_join._all_pairs(rows, 80).distinct().count() < n * (n - 1) / 20


def test_prefixes_of_similar_sets_meet():
    """Under each order, the first token that two similar sets share leaves as much room as their overlap needs."""
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(5, 80))
        a = r.integers(1, 2**63, n, dtype=np.uint64)
        b = np.unique(np.concatenate([a[r.random(n) < 0.93], r.integers(1, 2**63, int(r.integers(0, n // 8 + 1)), dtype=np.uint64)]))
        a = np.unique(a)
        both = np.intersect1d(a, b)
        if 100 * len(both) < 80 * (len(a) + len(b) - len(both)):
            continue
        every = {int(t): int(x) for t, x in zip(both, r.integers(8, 60, len(both)))}
        fa, fb = (np.array([every.get(int(t), 0) for t in s], np.uint8) for s in (a, b))
        for order in "ABC":
            pa_, pb = a[jaccard_join.prefix(a, fa, order)].tolist(), b[jaccard_join.prefix(b, fb, order)].tolist()
            t = next(x for x in pa_ if x in pb)
            need = -(-80 * (len(a) + len(b)) // 180)
            assert np.count_nonzero(fa) - pa_.index(t) >= need and np.count_nonzero(fb) - pb.index(t) >= need


def test_jaccard_join_of_nothing_and_keep_one(docs, none):
    assert jaccard_join.near_duplicates(none).isEmpty()
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 1 in ids and 22 not in ids


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


# --- 8: decontamination ---------------------------------------------------------------------------------------------


def plain_hits(rows, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    cut = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = [(str(i), tuple(w[k : k + 10])) for i, t in items for w in [cut(t)] if w for k in range(max(1, len(w) - 9))]
    out = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found.add(i)
        out.append(str((d, len(w), len(hit), len(found), decontaminate.digest(found))))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [40, 4_000_000])
def test_decontamination_equals_plain(spark, docs, block_bytes):
    c = corpus()
    items = [(1, " ".join(c[5][1].split()[50:70]).upper()), (2, "A, b; C"), (3, None), (4, ""), (5, c[12][1][100:260]), (10, "a b c"), (10, "zeta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hit = decontaminate.find_contamination(docs, bench, block_bytes=block_bytes, out="c")
    got = hit.select("doc_id", "c.n_words", F.size("c.words"), F.size("c.items"), F.sha2(F.array_join("c.items", ","), 256)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_hits(c, items)


def test_decontamination_maps_offsets_and_takes_nothing(spark, docs, none):
    bench = spark.createDataFrame([(1, "Vierter Satz")], "item_id long, text string")
    one = spark.createDataFrame([("é — Vierter, satz!",)], "text string")
    c = decontaminate.find_contamination(one, bench, out="c").first().c
    assert [one.first().text[a:b] for a, b in zip(c.starts, c.ends)] == ["Vierter", "satz"]
    assert decontaminate.find_contamination(docs, bench.where("false"), out="c").where("size(c.words) > 0").isEmpty()
    assert decontaminate.remove_contaminated(none, bench).isEmpty()
    assert decontaminate.remove_contaminated(docs, bench).columns == docs.columns


# --- 1 and 10: tokens -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_equal_the_tokenizers_library(docs, tokenizer):
    want = []
    for d, t in corpus():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        n, at, piece = len(ids), 0, 0
        while at < n:
            size = (n % 1024 or 1024) if piece == 0 and n > 1024 else min(1024, n - at)
            want.append(str((d, piece, at, size, zlib.crc32(ids[at : at + size].tobytes()))))
            at, piece = at + size, piece + 1
    got = packing.pack_documents(docs).collect()
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(want)
    check_packed(got, 1024)


def test_added_tokens_are_matched_in_text(spark, tokenizer, tmp_path):
    rows = [(1, "end of it.<|endoftext|>Next one"), (2, "<|endoftext|><|endoftext|>"), (3, " a <|endoftext|> b <|endoftext"), (4, "é<|endoftext|>\n"), (5, "<|END|> ſ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in rows}
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack_documents(df).collect()}
    assert got == {d: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for d, x in want.items()}
    token_counts.write_token_files(df, f"file://{tmp_path}/added", common.default_vocab())
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark, f"file://{tmp_path}/added").collect()} == {d: len(x) for d, x in want.items()}
    assert len(want[1]) == 7


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_tight(spark):
    r = np.random.default_rng(0)
    for sizes in (r.integers(1, 65, 3000), r.integers(20, 40, 1000), np.full(500, 64), np.full(100, 33), np.array([60, 4, 32, 32, 10, 20, 34])):
        plan = packing.reduce_and_fit(dict(zip(*map(list, map(np.ndarray.tolist, np.unique(sizes, return_counts=True))))), 64)
        n = 1 + max(f + hi - lo - 1 for _, lo, hi, f, _ in plan)
        order, bins = sorted(sizes.tolist(), reverse=True), []
        for s in order:  # best fit decreasing, one by one
            fit = [k for k, room in enumerate(bins) if room >= s]
            if fit:
                bins[min(fit, key=bins.__getitem__)] -= s
            else:
                bins.append(64 - s)
        assert math.ceil(sizes.sum() / 64) <= n <= 1 + 1.01 * len(bins)
        filled = np.zeros(n, int)
        for s, lo, hi, f, _ in plan:
            filled[f : f + hi - lo] += s
        assert filled.max() <= 64 and filled.sum() == sizes.sum()


def test_dominance_fixes_exact_pairs():
    plan = packing.reduce_and_fit({40: 3, 24: 3}, 64)
    assert sorted(plan) == [(24, 0, 3, 0, 40), (40, 0, 3, 0, 0)]


def fewest(sizes, capacity):
    """Sequences needed, by trying every choice."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[i]}:
            k = rooms.index(room)
            place(i + 1, [*rooms[:k], room - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_fewest_sequences():
    r = random.Random(6)
    cases = [(20, [10, 7, 7, 6, 6, 6, 5, 5, 5, 3])] + [(c, [r.randrange(c // 6, c * 2 // 3) for _ in range(r.randrange(3, 11))]) for c in (20, 24, 30) for _ in range(250)]
    for capacity, sizes in cases:
        counts = {s: sizes.count(s) for s in sizes}
        plan, fixed = packing._reduce_and_fit(dict(counts), capacity)
        rest = [s for s, lo, hi, first, _ in plan for k in range(hi - lo) if first + k >= fixed]
        assert fixed + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity)


def test_packing_salts_hot_lengths_and_takes_nothing(spark, none, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_SALT", 50)
    df = common.materialize(spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20 + 1).cast("long").alias("length")), "t")
    got = packing.pack(df, 20).collect()
    assert len(got) == 900
    check_packed(got, 20)
    assert packing.pack_documents(none).isEmpty()
    with pytest.raises(ValueError):
        packing.pack(df, 5)


def test_token_counts_equal_the_tokenizers_library(spark, docs, none, tokenizer, tmp_path):
    for name, df in (("docs", docs), ("none", none)):
        path = f"file://{tmp_path}/{name}"
        token_counts.write_token_files(df, path, common.default_vocab(), record_bytes=2_000, file_records=3)
        for block in (3, 64, 1 << 20):
            got = sorted(str((r.doc_id, r.n_tokens)) for r in token_counts.count_tokens(spark, path, block_tokens=block).collect())
            assert got == (sorted(str((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids))) for d, t in corpus()) if name == "docs" else [])


def test_token_files_without_headers_or_end(spark, tmp_path):
    np.array([5, 6, 9, 9, 7, 1, 2], ">u2").tofile(tmp_path / "a.bin")
    np.array([], ">u2").tofile(tmp_path / "b.bin")
    got = [(r.doc_index, r.start, r.n_tokens, r.terminated) for r in token_counts.count_tokens(spark, f"file://{tmp_path}", end_id=9, header=0, block_tokens=2).orderBy("doc_index").collect()]
    assert got == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, False)]


def test_headers_carry_all_ids():
    for i in (None, 0, 1, -1, 5, 2**63 - 1, -(2**63)):
        assert token_counts.id_of(token_counts.header_of(i)) == i


# --- 3 and 4: models ------------------------------------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("Ídi0t, m0r0n 1d10t сlоwn h@t3!") == " idiot moron idiot clown hate "


def test_toxicity_learns_folds_and_excepts(spark, none):
    r = random.Random(4)
    rows = []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, words(r, 40) + (" you moronic clown " if bad else " class clown ") + words(r, 20), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    lex = toxicity.train(df)
    assert " moron" in lex.weights
    test = spark.createDataFrame([(1, words(r, 30) + " M0R0NIC " + words(r, 30)), (2, words(r, 60)), (3, None), (4, ""), (5, words(r, 30) + " class clown")], "doc_id long, text string")
    got = {x.doc_id: x.toxicity.score for x in toxicity.score_toxicity(test, lex).collect()}
    assert got[1] > 0.5 and max(got[k] for k in (2, 3, 4, 5)) < 0.3 and all(0 <= v <= 1 for v in got.values())
    assert toxicity.score_toxicity(none, lex).isEmpty()
    empty = toxicity.train(df.where("false"))
    assert not empty.weights and toxicity.score_toxicity(test, empty).count() == 5


def test_exceptions_shield_matches():
    lex = toxicity.Lexicon({" clown": 3.0}, {"class clown"})
    auto = lex.automaton()
    assert lex.matches(auto, " a class clown ") == {} and lex.matches(auto, " a mean clown ") == {7: 3.0}


def test_backpropagation_equals_finite_differences():
    net = language_id.Network(["a", "b", "c"], hidden=3)
    for g in (net.ahead, net.back):
        g.wx, g.wh = g.wx.astype(np.float64), g.wh.astype(np.float64)
        g.params = [g.wx, g.wh]
    x, y = language_id.windows_of(["hello world", "ceci n'est", "Ω"], [0, 1, 2], np.random.default_rng(0), 1)
    x = x[:8]
    _, grads = net.gradients(x, y)
    for p, g in zip(net.parameters(), grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[i]
        p[i] = old + 1e-2
        up = net.gradients(x, y)[0]
        p[i] = old - 1e-2
        down = net.gradients(x, y)[0]
        p[i] = old
        assert abs((up - down) / 2e-2 - g[i]) < 2e-3 * max(1, abs(g[i]))


def test_inference_equals_training_form():
    net = language_id.Network(["a", "b"], hidden=4)
    x, _ = language_id.windows_of(["some bytes", "andere Bytes"], [0, 1], np.random.default_rng(0), 1)
    f, _ = net.ahead.forward(x)
    assert np.allclose(net.ahead.run(x).transpose(0, 2, 1), f, atol=1e-5)


def test_language_of_edge_texts(spark, none):
    net = language_id.fit(["de", "en"], ["der die und das ist", "the and of this is"] * 20, [0, 1] * 20, steps=60)
    df = spark.createDataFrame([(1, "der und die das"), (2, "the of and this"), (3, None), (4, ""), (5, "123 %%"), (6, "und das " * 4000)], "doc_id long, text string")
    got = {r.doc_id: r.language for r in language_id.predict_language(df, net).collect()}
    assert [got[k].lang for k in range(1, 7)] == ["de", "en", "und", "und", "und", "de"] and all(0 <= v.score <= 1 for v in got.values())
    assert language_id.predict_language(none, net).isEmpty()
    assert language_id.train(none).langs == [] and {r.language.lang for r in language_id.predict_language(df, language_id.Network([])).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    """On the documents of the fold that neither model learns from."""
    sf = SF.replace("0.001", "0.01")
    d = duckdb.connect()
    langs = dict(d.execute(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())
    toxic = dict(d.execute(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    got = [r for r in language_id.op4_language_id(spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got]) > 0.95
    got = [r for r in toxicity.op3_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in got]) > 0.9


# --- 7: neighbours --------------------------------------------------------------------------------------------------


def test_search_recall_ties_and_odd_vectors(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 16))
    x[100:200] = x[100]  # a group of copies
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    rows += [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0] * 3), (780, [None] * 16), (None, [1.0] * 16), rows[20], rows[21]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for row in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row)
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        order = [k for k in np.lexsort((np.arange(600), -s)) if k != q][:20]
        hits += len(set(order) & {f.vec_id for f in found})
        assert [f.rank for f in found] == list(range(1, 21))
        assert all(abs(f.score - s[f.vec_id]) < 1e-9 for f in found)
        keys = [(-f.score, f.vec_id) for f in found]
        assert keys == sorted(keys)
    assert hits / (20 * len(got)) >= 0.9
    assert ann.search(df.where("false")).isEmpty()
    few = ann.search(df.where("vec_id < 3")).collect()
    assert sorted((f.query_id, f.vec_id) for f in few) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("sigma", [0.5, 1.0])
def test_search_recall_at_unequal_norms(spark, sigma):
    r = np.random.default_rng(12)
    x = r.normal(size=(2000, 32))
    x *= np.exp(sigma * r.normal(size=(2000, 1))) / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in ann.search(df, every=40).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    hits = [len(found & set([k for k in np.argsort(-(x @ x[q])) if k != q][:20])) for q, found in got.items()]
    assert len(got) == 50 and np.mean(hits) / 20 >= 0.9


def test_walk_goes_by_sum():
    d1, d2 = np.array([3.0, 1.0, 2.0]), np.array([5.0, 0.0])
    walked = list(ann.walk(d1, d2))
    sums = [d1[i] + d2[j] for i, j, _ in walked]
    assert sums == sorted(sums) == [d for *_, d in walked] and len({w[:2] for w in walked}) == 6


def test_walk_stops_early_where_vectors_form_clusters():
    """Of clustered vectors a query looks at few and finds nearly all; without structure it looks at more."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(60, 32))
    loose, tight = r.normal(size=(3000, 32)), centres[r.integers(0, 60, 3000)] + 0.2 * r.normal(size=(3000, 32))
    looked = []
    for x in (loose, tight):
        books = ann.Codebooks(ann.kmeans(x[:, :16], 60), ann.kmeans(x[:, 16:], 60))
        cell, far1, far2 = books.place(x)
        sizes = dict(zip(*(v.tolist() for v in np.unique(cell, return_counts=True)), strict=True))
        spread = [np.sqrt(np.bincount(c, f**2, 60) / np.maximum(1, np.bincount(c, minlength=60))) for c, f in ((cell // 60, far1), (cell % 60, far2))]
        near, said = zip(*(ann.promises(h, c, s, ann.MARGIN) for h, c, s in ((x[:100, :16], books.first, spread[0]), (x[:100, 16:], books.second, spread[1]))), strict=True)
        hit, share = [], []
        for q in range(100):
            asked = np.isin(cell, list(ann.cells_to_ask((near[0][q], near[1][q]), (said[0][q], said[1][q]), sizes, 21)))
            best = [k for k in np.argsort(-(x @ x[q])) if k != q][:20]
            hit.append(asked[best].mean())
            share.append(asked.mean())
        assert np.mean(hit) >= 0.9
        looked.append(np.mean(share))
    assert looked[0] < 0.75 and looked[1] < 0.1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_on_the_table(spark):
    got = {}
    for r in ann.op7_approximate_nearest_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = duckdb.execute(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hit = [len(got[q] & set(ids[[k for k in np.argsort(-(x @ x[i])) if k != i][:20]].tolist())) for i, q in enumerate(ids.tolist()) if q % 20 == 0]
    assert np.mean(hit) / 20 >= 0.9


# --- 9: URLs --------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["https://a.Example.ORG/es/1", "https://example.org/en/12", "http://example.org/de/", "https://x.com/fr/", "https://x.com/de/9", "https://notexample.org", "https://org/", "nothing", None, "", "x://spam-farm.net/", "x://spam-farmer.net/", "https://x.com?u=http://y.com/de/", "https://x.com/FR/", "://\n.org/a", "https://myspam-farm-x.com/"]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = [(r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.RULES + url_filter.PATTERNS).orderBy("page_id").collect()]
    assert got == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), ("org/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"), (None, "allow")]
    assert url_filter.filter_urls(df.where("false"), url_filter.RULES).isEmpty()
    assert url_filter.filter_urls(df, ()).where("verdict != 'allow'").isEmpty()


def test_urls_by_table_equal_those_by_list(spark, monkeypatch):
    hosts = ["a.example.org", "bestcasino.net", "my-casino.com", "casinobests.com", "x.com", "org", "best-casino.top", "vipporn.de"]
    paths = ["", "/", "/es/1", "/en/12", "/fr/", "/de/9", "/a/Track/Click", "/aff/out/2", "/affx/out"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "nothing", "", "https://x.com/fr/"]
    df = spark.createDataFrame([(i, u, "p", 1, 2) for i, u in enumerate(urls)], "page_id long, url string, pattern string, url_parts int, url_rule int")
    rules = url_filter.RULES + url_filter.PATTERNS
    one = url_filter.filter_urls(df, rules)
    want = sorted(map(str, one.collect()))
    assert {"url_parts", "url_rule"} <= set(one.columns) and sum("block" in r for r in want) > 10
    monkeypatch.setattr(url_filter, "LITERAL_RULES", 5)
    two = url_filter.filter_urls(df, rules)
    assert sorted(map(str, two.select(one.columns).collect())) == want
    assert not re.search("Python|Pandas|Arrow", two._jdf.queryExecution().executedPlan().toString())


def test_urls_fetch_few_rules(spark):
    """Of some two hundred and fifty rules a URL runs the ones that its rare tokens fetch."""
    rules = url_filter.RULES + url_filter.PATTERNS
    assert len(rules) > 200 and all(r.tokens for r in rules)
    hosts = ["news.com", "shop.org", "bestcasino.net", "blog.example.org"] * 50
    counts = {}
    for h in hosts:
        for t in set(re.findall("[0-9a-z]+", h)):
            counts[t] = counts.get(t, 0) + 1
    filed = [min(r.tokens, key=lambda t: (counts.get(t, 0), t)) for r in rules]
    fetched = [sum(f in re.findall("[0-9a-z]+", h) for f in filed) for h in hosts]
    assert max(fetched) <= 4 and sum(fetched) / len(hosts) < 3


def test_url_filter_is_native(spark):
    plan = url_filter.filter_urls(spark.createDataFrame([("x://a.org/",)], "url string"), url_filter.RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_keys_in_two_steps(spark):
    """Beyond ``direct`` buckets keys go by ranges and teams: the replies are the same, and the blobs grow with the keys."""
    n_runs = 40
    r = np.random.default_rng(1)
    held = [np.unique(np.concatenate([r.integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2), np.arange(50, dtype=np.uint64) << np.uint64(57)])) for _ in range(n_runs)]
    first = {}
    for k, keys in enumerate(held):
        for x in keys.tolist():
            first.setdefault(x, []).append(k)
    runs = spark.range(n_runs).select(F.col("id").cast("int").alias("run"))
    rows = {}

    def sender(direct, bits):
        def send(t):
            k = t["run"][0].as_py()
            keys = np.unique(held[k] >> np.uint64(64 - bits))
            return exchange.key_rows(k, 7, n_runs, keys, np.full(len(keys), 2), np.full(len(keys), k), bits=bits, direct=direct)

        return send

    for direct, bits in ((10, 64), (1000, 64), (10, 40)):
        sent = runs.groupBy("run").applyInArrow(sender(direct, bits), exchange.key_schema())
        rows[direct] = sent.count()
        replies = exchange.answers(sent, n_runs, bits, direct).toArrow()
        for k, keys in enumerate(held):
            total, smaller = exchange.read_answer(replies.filter(pc.equal(replies["run"], k)), 7)
            assert total.tolist() == [2 * len(first[x]) for x in keys.tolist()] and smaller.tolist() == [min(first[x]) < k for x in keys.tolist()]
    assert rows[10] <= n_runs * 7 < rows[1000]


def test_matcher_equals_a_search_for_each_entry():
    r = random.Random(3)
    entries = {" idio": 2.0, " idiot": 3.0, " scum ": 4.0, " bad ": 1.5, " x ": 1.0}
    lexicon = toxicity.Lexicon(entries, {"not bad", "scum bag"})
    auto = lexicon.automaton()
    for _ in range(200):
        flat = toxicity.fold(" ".join(r.choice(["idiot", "idiom", "1d10t", "scum", "scummy", "bad", "not", "bag", "x", "Ѕсum", "!", "clean"]) for _ in range(r.randrange(12))))
        want = {}
        for w, x in entries.items():
            for at in range(len(flat)):
                if flat.startswith(w, at) and not any(p in lexicon.exceptions for p in toxicity.phrases_at(flat, at)):
                    want[at] = max(x, want.get(at, x))
        assert lexicon.matches(auto, flat) == want


def test_pooling_equals_one_position_at_a_time():
    """Texts of several segments, read by plain steps: each segment from the zero state in both directions."""
    net = language_id.Network(["a", "b", "c"], seed=5)
    texts = ["", "ab", "é" * 40, "some words " * 30]

    def states(gru, segment):
        s, out = np.zeros(gru.h), []
        for byte in segment:
            s = gru.step(gru.wx[np.array([byte])].astype(np.float64), s[None, :])[0][0]
            out.append(s)
        return out

    got = net.pooled([t.encode() for t in texts])
    for row, t in zip(got, texts):
        raw, p = t.encode(), []
        for a in range(0, len(raw), language_id.SEGMENT):
            real = raw[a : a + language_id.SEGMENT]
            segment = list(real) + [net.PAD] * (language_id.SEGMENT - len(real))
            ahead, back = states(net.ahead, segment), states(net.back, segment[::-1])[::-1]
            for k in range(len(real)):
                z = np.concatenate([ahead[k], back[k]]) @ net.wo + net.bo
                p.append(np.exp(z) / np.exp(z).sum())
        assert np.allclose(row, np.mean(p, axis=0) if p else 1 / 3, atol=1e-4)


CLASHING = ("run", "did", "key", "n", "node", "row", "at", "salt", "rank", "lo", "hi", "base", "bucket", "hit", "_hit", "_u", "_c", "_id", "_text", "language", "_language", "toxicity", "cut_id", "cut_text", "contamination")


def test_users_columns_stay(spark):
    """Operators that return the documents keep columns of any name."""
    r = random.Random(6)
    passage = words(r, 70)
    texts = [words(r, 40) + passage, words(r, 30) + passage, passage, None, "", words(r, 20), words(r, 20)]
    df = spark.createDataFrame([(i, t, None, f"https://h{i}.org/", "k") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, url string, mark string")
    df = df.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in CLASHING})
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    net = language_id.fit(["xx"], [t for t in texts if t], [0] * 5, steps=2)
    outs = {
        "jaccard": jaccard_join.keep_one(df), "chunks": chunk_dedup.rewrite(df), "clean": decontaminate.remove_contaminated(df, bench), "found": decontaminate.find_contamination(df, bench, block_bytes=1, out="c9"),
        "urls": url_filter.filter_urls(df, url_filter.RULES), "lang": language_id.keep_identified(df, net, 0.0), "tox": toxicity.score_toxicity(df, toxicity.Lexicon({}, set()), out="t9"),
        "pack": packing.pack(df.withColumn("length", F.col("doc_id") + 1)),
    }
    for name, out in outs.items():
        assert set(df.columns) <= set(out.columns), name
        rows = out.collect()
        assert rows and all(x[c] == f"{c}-{x.doc_id}" for x in rows for c in CLASHING), name


# --- all ------------------------------------------------------------------------------------------------------------


def test_squeeze_round_trip():
    for x in (np.arange(5, dtype=np.uint64), np.zeros(0, np.uint32), np.array([2**63], np.uint64)):
        assert (unsqueeze(squeeze(x), x.dtype) == x).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_suffix_array_dedup", "op6_ngram_jaccard_join", "op8_decontamination", "op9_url_filters"])
def test_sql(spark, name):
    from helixlake.llm.registry import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    got = QUERIES[name](spark, SF)
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == sorted(str(tuple(r)) for r in cur.fetchall())
