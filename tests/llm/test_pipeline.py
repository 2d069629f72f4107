"""The pipeline's stages, each against what it must keep, and the whole of it."""

import random

import corpus_pipeline
import test_llm as plain
from helixlake.llm import language_id
from helixlake.llm.common import byte_bpe, default_vocab, materialize


def words(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(60)) for _ in range(n))


def table(spark, path):
    r = random.Random(3)
    lang = {"en": "the of and to in is that it was for".split(), "de": "der die und das ist nicht ein zu von mit".split()}
    text = lambda k, n: " ".join(r.choice(lang[k]) + r.choice(["", "x", "y"]) + str(r.randrange(40)) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "de", 60 + i % 50), "en" if i % 2 else "de", "s", None) for i in range(120)]
    item = words(r, 20)
    passage = text("en", 70)
    rows += [(200, rows[3][1], "en", "s", 1), (201, rows[3][1] + " one more", "en", "s", 1), (202, None, "en", "s", 0), (203, "%% 12", "en", "s", 0), (204, text("en", 40) + " " + item, "en", "s", 0), (205, text("en", 50) + " " + passage, "en", "s", 0), (206, text("en", 50) + " " + passage + " " + text("en", 50), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = table(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            kept[name] = {r.doc_id: r for r in docs.collect()}
    first = kept["language_id"]
    assert not {202, 203} & set(first) and len(first) >= 120
    second = kept["near_duplicates"]
    assert set(first) - set(second) == {200, 201}
    third = kept["substring_dedup"]
    assert set(third) == set(second) and passage in third[205].text and passage not in third[206].text and third[206].n_chars == len(third[206].text)
    assert set(third) - set(kept["decontamination"]) == {204}
    assert {r.doc_id for r in docs.collect()} == set(kept["decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).isEmpty()


def plain_near(rows):
    """One document of each component, the one with the smallest id; those without id stay."""
    sets = [line.strip("()").rsplit(", ", 1)[1] for line in plain_components_in_order(rows)]
    seen, out = set(), []
    for (d, t), c in zip(rows, sets):
        if d is None:
            out.append((d, t))
        elif str(d) == c and (d, t or "") not in seen:
            seen.add((d, t or ""))
            out.append((d, t))
    return out


def plain_components_in_order(rows):
    """``plain_components`` of each row by itself: rows are told apart by their place."""
    marked = [(k, t) for k, (_, t) in enumerate(rows)]
    comp = {}
    for line in plain.plain_components(marked):
        k, _, c = (int(x) for x in line.strip("()").split(", "))
        comp.setdefault(c, []).append(k)
    out = [None] * len(rows)
    for members in comp.values():
        least = min((rows[k][0] for k in members if rows[k][0] is not None), default=None)
        for k in members:
            out[k] = f"({rows[k][0]}, {least})"
    return out


def plain_cut(rows):
    """Texts without the chunks that a smaller document holds."""
    big, owner = 1 << 62, {}
    for d, t in rows:
        b = (t or "").encode()
        for a, z in plain.plain_chunks(b):
            owner[b[a:z]] = min(owner.get(b[a:z], big), big if d is None else d)
    out = []
    for d, t in rows:
        b, spans = (t or "").encode(), []
        for a, z in plain.plain_chunks(b):
            if owner[b[a:z]] < (big if d is None else d):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(z, spans[-1][1])
                else:
                    spans.append([a, z])
        spans = [x for x in spans if x[1] - x[0] >= 128]
        if not spans:
            out.append((d, t))
        elif kept := b"".join(b[z:a] for z, a in zip([0, *(z for _, z in spans)], [*(a for a, _ in spans), len(b)])).decode():
            out.append((d, kept))
    return out


def test_stages_equal_plain_versions(spark, tmp_path):
    """Null ids, repeated rows, null and empty texts, an id with two texts, and a column that the stages don't know."""
    r = random.Random(4)
    rows = [*plain.corpus(), (7000, plain.words(r, 60)), (7000, plain.words(r, 60))]
    langs = ["en" if k % 3 else None for k in range(len(rows))]
    frame = lambda some: spark.createDataFrame([(d, t, "en", "s", None, "x") for d, t in some], "doc_id long, text string, lang string, source string, n_chars long, key string")
    items = [(1, rows[2][1][:200]), (2, None), (3, " ".join(rows[5][1].split()[30:45]).upper())]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = {name: lambda some, f=f: [(x.doc_id, x.text) for x in f(spark, frame(some), str(tmp_path)).collect()] for name, f in corpus_pipeline.STAGES[:4]}
    same = lambda a, b: sorted(map(str, a)) == sorted(map(str, b))

    with_langs = spark.createDataFrame([(d, t, x, "s", None, "x") for (d, t), x in zip(rows, langs)], "doc_id long, text string, lang string, source string, n_chars long, key string")
    net = language_id.train(language_id.training_docs(with_langs))
    score = lambda t: float(net.pooled([t.encode()]).max()) if t and any(map(str.isalpha, t)) else 0.0
    got = [(x.doc_id, x.text) for x in corpus_pipeline.identify_language(spark, with_langs, str(tmp_path)).collect()]
    assert same(got, [(d, t) for d, t in rows if score(t) >= language_id.KEEP_SCORE])

    near = plain_near(rows)
    assert same(stage["near_duplicates"](rows), near) and len(near) < len(rows)
    assert same(stage["substring_dedup"](rows), plain_cut(rows))
    hits = [int(line.strip("()").split(", ")[2]) for line in (plain.plain_hits([x], items)[0] for x in rows)]
    assert same(stage["decontamination"](rows), [x for x, h in zip(rows, hits) if not h]) and any(hits)
    packed = corpus_pipeline.pack_sequences(spark, frame(rows), str(tmp_path)).collect()
    bpe = byte_bpe(default_vocab())
    assert sum(x.length for x in packed) == sum(len(bpe.encode(t or "", allowed_special="all")) + 1 for _, t in rows)
    bins = {}
    for x in packed:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert all(b[0][0] == 0 and all(p + n == q for (p, n), (q, _) in zip(b, b[1:])) and sum(b[-1]) <= 1024 for b in map(sorted, bins.values()))
