"""Conversation repair against exhaustive search and a plain dynamic programme."""

import hashlib
import itertools
import random
import re

import pytest

from helixlake.llm import conversation_repair as cr

SPACE = " \t\n\x0b\f\r"
FIT = re.compile("(s?(ua)+)?")


def faults(rows):
    """(must go, truncated) of each row, and the counts."""
    out, seen = [], set()
    count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for role, text in rows:
        body = text.rstrip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        out.append((fault in ("blank", "duplicate"), fault == "truncated"))
    count["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return out, count


def search(rows):
    """The cheapest repair, first in order: whole strings of edits for each sequence of roles so far."""
    marks, count = faults(rows)
    full = {"u": "user", "a": "assistant"}
    ways = {("", 0): (0, "", ())}
    best = None
    # by cost, then by edits: every string of edits is followed, none is thrown away but those of a state that has a better one
    ways = {"": [(0, "", ())]}
    for (role, text), (must_go, cut) in zip(rows, marks, strict=True):
        new = {}
        for state, held in ways.items():
            for cost, edits, out in held:
                for ins in ("", "I", "II"):
                    at, made = state, out
                    for _ in ins:
                        at = {"": "u", "s": "u", "u": "a", "a": "u"}[at]
                        made = (*made, full[at] + ":")
                    c = cost + 3 * len(ins)
                    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}[at]
                    found = [(at, c + 4, edits + ins + "D", made)]
                    if not must_go:
                        c += 3 if cut else 0
                        found.append((nxt, c + 3, edits + ins + "R", (*made, f"{full[nxt]}:{text}")))
                        if role[:1] == nxt or (role[:1] == "s" and at == ""):
                            found.append((role[:1], c, edits + ins + "K", (*made, f"{role}:{text}")))
                    for then, c2, e2, o2 in found:
                        new.setdefault(then, []).append((c2, e2, o2))
        # every way of the least two costs stays, so that nothing rests on the order among prefixes
        ways = {s: sorted(x)[:200] for s, x in new.items()}
    ends = []
    for state, held in ways.items():
        for cost, edits, out in held:
            for ins in ("", "I", "II"):
                at, made = state, out
                for _ in ins:
                    at = {"": "u", "s": "u", "u": "a", "a": "u"}[at]
                    made = (*made, full[at] + ":")
                if at == "a" or (at == "" and not ins):
                    ends.append((cost + 3 * len(ins), edits + ins, made))
    best = min(ends)
    assert FIT.fullmatch("".join(x[0] for x in best[2]))
    return count, best


def expected(rows):
    """rows: (turn, role, text) of one conversation, unsorted."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    count, (cost, edits, out) = search([x[1:] for x in rows])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *count.values(), cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest())


TEXTS = ["Fine.", "Cut off", "Why? ", "", " \t", "Yes!\n", "no", None]
ROLES = ["user", "assistant", "system", "tool", "", None, "üser", "umpire"]


def random_rows(r, n):
    return [(r.choice([None, *range(n)]) if r.random() < 0.3 else k, r.choices(ROLES, [8, 8, 3, 1, 1, 1, 1, 1])[0], r.choice(TEXTS[:3]) + str(r.randrange(4)) + "." if r.random() < 0.6 else r.choice(TEXTS)) for k in range(n)]


@pytest.fixture(scope="module")
def table():
    r = random.Random(8)
    rows = [(c, *x) for c in range(120) for x in random_rows(r, r.randrange(1, 14))]
    rows += [(None, *x) for x in random_rows(r, 6)]
    rows += [(500, 3, "user", "Same.")] * 40 + [(500, 5, "user", "Same.")] * 7 + [(501, None, "user", "x.")] * 3 + [(502, 1, "user", "")] * 4
    rows += [(503, k, "user" if k % 2 else "assistant", f"Turn {k}." if k % 7 else "ok") for k in range(400)]
    return rows


@pytest.mark.parametrize("segment", [2_000, 1, 3])
def test_repair(spark, table, monkeypatch, segment):
    monkeypatch.setattr(cr, "SEGMENT_ROWS", segment)
    df = spark.createDataFrame([(*x, "n", 1, "z") for x in table], "conv_id long, turn long, role string, text string, n string, same int, first string")
    ids = spark.createDataFrame([(7,), (None,), (999,)], "conv_id long")
    got = {x[0]: tuple(x)[1:] for x in cr.repair_conversations(df, ids=ids).collect()}
    groups = {}
    for c, *x in table:
        groups.setdefault(c, []).append(x)
    assert got.pop(999) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got.keys() == groups.keys()
    for c, rows in groups.items():
        assert got[c] == expected(rows), (c, rows)


def test_every_short_conversation():
    """All edits of all rows of a few kinds, with up to two inserts at each place, by brute force."""
    kinds = [("s", False, False), ("u", False, False), ("u", False, True), ("a", False, False), ("", False, False), ("u", True, False)]
    nxt = cr.NEXT
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            best = None
            for edits in itertools.product("KRD", repeat=n):
                for ins in itertools.product(range(3), repeat=n + 1):
                    state, cost, audit, ok = "", 0, "", True
                    for k in range(n + 1):
                        for _ in range(ins[k]):
                            state, cost, audit = nxt[state], cost + 3, audit + "I"
                        if k == n:
                            break
                        initial, must_go, cut = rows[k]
                        e = edits[k]
                        audit += e
                        if e == "D":
                            cost += 4
                            continue
                        cost += (3 if cut else 0) + (3 if e == "R" else 0)
                        if must_go or (e == "K" and initial != nxt[state] and not (initial == "s" and state == "")):
                            ok = False
                            break
                        state = nxt[state] if e == "R" else initial
                    if ok and (state == "a" or (state == "" and "I" not in audit)) and (best is None or (cost, audit) < best):
                        best = cost, audit
            survivors, done = cr.Survivors(), []
            for kind in rows:
                done += survivors.step(cr.OPTIONS[kind])
            cost, rest = survivors.end()
            assert (cost, "".join(done + rest)) == best, rows


def test_memory_is_bounded_by_coalescence():
    r = random.Random(3)
    survivors, waiting, most = cr.Survivors(), 0, 0
    for _ in range(20_000):
        waiting += 1 - len(survivors.step(cr.OPTIONS[r.choice(["s", "u", "a", "a", "u"]), r.random() < 0.1, r.random() < 0.1]))
        most = max(most, waiting)
    assert most < 200


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", f"One. Two? {c}!") for c in range(30) for t in range(4)] + [(None, None, None, None), (1, None, "user", None)]
    got = cr.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want += [(c, t, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_and_long(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([], schema)
    assert cr.repair_conversations(df, ids=df).collect() == []
    text = "word " * 1_000_000 + "end."
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], schema)
    out = cr.repair_conversations(df).select("cost", "audit", "repaired_sha256").collect()
    assert [tuple(x) for x in out] == [(0, "KK", hashlib.sha256(f"user:{text}\nassistant:{text}".encode()).hexdigest())]
