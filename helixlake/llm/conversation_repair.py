"""Repair of conversations by survivor-coalescence Viterbi.

The rows of a conversation, by turn, get the cheapest edits (Keep, Rerole, Delete, Insert) after which roles read
``(system)? (user assistant)*``; of equally cheap ones, those whose initials come first. One survivor is held for each state
(nothing yet, after system, after user, after assistant) in a tree of back pointers that counts references: what no survivor
stands on goes, and as soon as all stand on one node the edits up to it are final and leave. Where survivors tie, their
unresolved edits are compared whole, back to the node that they share. (Two of them have edited the same rows and end with
a row's edit, so neither begins the other, and the order holds whatever follows.)

A conversation may be any part of the table. Equal rows are counted before they are shuffled; rows are then dealt and sorted
by ranges of (conversation, turn, role, text), and each task cuts what it has into segments. A segment that may stand in
the middle of a conversation is solved for each state that it could be entered in. What remains for one task is a row a
segment: to choose among these solutions, by the same tree and without the texts, and then to hash the repaired text as it
streams by, which SHA-256 can only do in order.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table

SPACE = " \t\n\x0b\f\r"
#: Rows and text bytes of a segment (a longer text is alone), and characters of a text by which rows of one turn and role are dealt.
SEGMENT_ROWS, SEGMENT_BYTES, HEAD = 2_000, 4_000_000, 200
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: What comes next after each state, and the role that a row takes to get there.
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}
#: Edits after the last row, by state.
TAIL = {"": ("", 0), "s": ("II", 2 * INSERT), "u": ("I", INSERT), "a": ("", 0)}

#: How much more the rest may cost from the second state than from the first, whatever comes: a survivor that costs more
#: than that above another one can't win.
SLACK = {("", "s"): 6, ("", "u"): 7, ("", "a"): 4, ("s", ""): 0, ("s", "u"): 3, ("s", "a"): 0, ("u", ""): 3, ("u", "s"): 3, ("u", "a"): 3, ("a", ""): 0, ("a", "s"): 6, ("a", "u"): 3}


class _Node:
    __slots__ = ("parent", "piece", "refs")

    def __init__(self, parent: _Node | None, piece: str):
        self.parent, self.piece, self.refs = parent, piece, 1


class Survivors:
    """The cheapest way to each state, first in order among equals. ``step`` returns the pieces that became final."""

    def __init__(self, state: str = ""):
        self.root = _Node(None, "")
        self.at = {state: (0, self.root)}

    @staticmethod
    def _before(a: _Node, piece_a: str, b: _Node, piece_b: str) -> bool:
        one, two = [piece_a], [piece_b]
        while a is not b:  # as deep as each other
            one.append(a.piece)
            two.append(b.piece)
            a, b = a.parent, b.parent
        return "".join(reversed(one)) < "".join(reversed(two))

    def step(self, options) -> list[str]:
        """``options``: (state, piece, cost, next state)."""
        best: dict[str, tuple[int, _Node, str]] = {}
        for state, piece, cost, then in options:
            if state in self.at:
                total, node = self.at[state]
                total += cost
                old = best.get(then)
                if old is None or total < old[0] or (total == old[0] and self._before(node, piece, old[1], old[2])):
                    best[then] = (total, node, piece)
        best = {x: b for x, b in best.items() if all(b[0] <= best[y][0] + SLACK[x, y] for y in best if y != x)}
        left, self.at = self.at, {}
        for then, (total, node, piece) in best.items():
            node.refs += 1
            self.at[then] = (total, _Node(node, piece))
        for _, node in left.values():
            node.refs -= 1
            while not node.refs and node is not self.root:
                node = node.parent
                node.refs -= 1
        return self._final()

    def _path(self, node: _Node) -> list[_Node]:
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]

    def _final(self) -> list[str]:
        if self.root.refs > 1:
            return []
        nodes = {id(node) for _, node in self.at.values()}
        out = []
        for node in self._path(next(iter(self.at.values()))[1]):
            if self.root.refs > 1 or id(self.root) in nodes:
                break
            out.append(node.piece)
            self.root, node.parent = node, None
        return out

    def ways(self) -> dict[str, tuple[int, list[str]]]:
        """Cost and unresolved pieces for each state."""
        return {state: (cost, [x.piece for x in self._path(node)]) for state, (cost, node) in self.at.items()}

    def end(self) -> tuple[int, list[str]]:
        """The cheapest way to an end: its cost, and the pieces not returned so far."""
        ended = [(cost + TAIL[state][1], [*pieces, TAIL[state][0]]) for state, (cost, pieces) in self.ways().items()]
        return min(ended, key=lambda x: (x[0], "".join(x[1])))


def _options(initial: str, must_go: bool, cut: bool) -> list[tuple[str, str, int, str]]:
    """What may become of a row, from each state. Inserts stand before a row that stays, one at most: two lead back to the
    same place, and before a row that goes they could as well stand behind it, which is earlier in order."""
    out = []
    for state in NEXT:
        out.append((state, "D", DELETE, state))
        if must_go:
            continue
        for inserts, at in (("", state), ("I", NEXT[state])):
            cost = len(inserts) * INSERT + (CUT if cut else 0)
            out.append((state, f"{inserts}R", cost + REROLE, NEXT[at]))
            if initial == NEXT[at] or (initial == "s" and at == ""):
                out.append((state, f"{inserts}K", cost, initial))
    return out


OPTIONS = {(i, must_go, cut): _options(i, must_go, cut) for i in ("s", "u", "a", "") for must_go in (False, True) for cut in (False, True)}


def solve(kinds: list[tuple[str, bool, bool]], entry: str) -> dict[str, tuple[int, str]]:
    """For each state after the rows: the cost and the edits of the best way there from state ``entry``."""
    survivors, done = Survivors(entry), []
    for kind in kinds:
        done += survivors.step(OPTIONS[kind])
    head = "".join(done)
    return {state: (cost, head + "".join(pieces)) for state, (cost, pieces) in survivors.ways().items()}


def repaired(edits: str, state: str, rows: list[tuple[str, str, int]]) -> Iterator[tuple[str, str | None, str | None]]:
    """(initials, role, text) for each edit; role and text are None where a row goes. ``rows``: role, text, how often; all
    but the first of equal rows go."""
    at = 0
    for edit in edits:
        if edit == "I":
            state = NEXT[state]
            yield "I", ROLE[state], ""
            continue
        role, text, n = rows[at]
        at += 1
        initials = edit + "D" * (n - 1)
        if edit == "D":
            yield initials, None, None
            continue
        state = NEXT[state] if edit == "R" else role[:1]
        yield initials, ROLE[state] if edit == "R" else role, text


_SEGMENT = "part int, seq int, lo bigint, hi bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, paths array<struct<entry:string,exit:string,cost:bigint,audit:string>>, body binary"
_ROW = pa.schema([("role", pa.string()), ("text", pa.string()), ("n", pa.int64())])
COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = ("su", "ua", "au")


def _segment(rows: list[tuple], opening: bool) -> dict:
    """rows: turn, role, text, n, duplicate, blank, cut; those without role only stand for their conversation."""
    rows = [x for x in rows if x[1] is not None]
    turns = [x[0] for x in rows if x[0] is not None]
    initials = [x[1][:1] for x in rows]
    out = {"lo": turns[0] if turns else None, "hi": turns[-1] if turns else None, "turns": len(set(turns)), "first": initials[0] if rows else None, "last": initials[-1] if rows else None}
    kinds = []
    count = dict.fromkeys(COUNTS, 0)
    for (_, _, _, n, again, blank, cut), initial in zip(rows, initials, strict=True):
        count["blank"] += n if blank else 0
        count["duplicate"] += 0 if blank else n - 1 + again
        count["truncated"] += cut and not again
        count["illegal"] += n - 1
        kinds.append((initial if initial in ("s", "u", "a") else "", blank or again, cut and not again))
    count["illegal"] += sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    copies = sum(x[3] - 1 for x in rows)
    out["paths"] = [{"entry": entry, "exit": state, "cost": cost + DELETE * copies, "audit": edits} for entry in ([""] if opening else NEXT) for state, (cost, edits) in solve(kinds, entry).items()]
    sink = pa.BufferOutputStream()
    body = pa.Table.from_arrays([pa.array([x[k] for x in rows], _ROW.field(i).type) for i, k in enumerate((1, 2, 3))], schema=_ROW)
    with pa.ipc.new_stream(sink, _ROW) as writer:
        writer.write_table(body)
    return out | count | {"body": zstandard.ZstdCompressor(1).compress(sink.getvalue())}


def _segments(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held, size, conv, opening = [], 0, None, False

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv": conv, "part": part, "seq": seq} | _segment(held, opening)], schema=schema)

        begun = False
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and x[0] != conv:
                    yield flush()
                    held, size, seq, opening = [], 0, seq + 1, True
                elif len(held) >= SEGMENT_ROWS or size >= SEGMENT_BYTES:
                    yield flush()
                    held, size, seq, opening = [], 0, seq + 1, False
                begun, conv = True, x[0]
                held.append(x[1:])
                size += len(x[3] or "")
        if begun:
            yield flush()

    return run


class _Choice:
    """Takes the segments of a conversation in order, without their texts."""

    def __init__(self):
        self.survivors, self.waiting, self.state = Survivors(), deque(), ""
        self.count = dict.fromkeys(COUNTS, 0)
        self.lo = self.hi = self.last = None
        self.turns = 0

    def add(self, x: dict) -> Iterator[dict]:
        for c in COUNTS:
            self.count[c] += x[c]
        if x["lo"] is not None:
            self.turns += x["turns"] - (x["lo"] == self.hi)
            self.lo, self.hi = x["lo"] if self.lo is None else self.lo, x["hi"]
        if x["first"] is not None:
            self.count["illegal"] += self.last is not None and self.last + x["first"] not in LEGAL
            self.last = x["last"]
        exits = {(p["entry"], p["audit"]): p["exit"] for p in x["paths"]}
        self.waiting.append((x["part"], x["seq"], exits))
        yield from self.settled(self.survivors.step([(p["entry"], p["audit"], p["cost"], p["exit"]) for p in x["paths"]]))

    def settled(self, pieces: list[str]) -> Iterator[dict]:
        for edits in pieces:
            part, seq, exits = self.waiting.popleft()
            yield {"part": part, "seq": seq, "state": self.state, "edits": edits}
            self.state = exits[self.state, edits]

    def end(self) -> Iterator[dict]:
        cost, pieces = self.survivors.end()
        yield from self.settled(pieces[:-1])
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.turns
        yield {"state": self.state, "edits": pieces[-1], "gaps": gaps, **self.count, "cost": cost}


_CHOICE = "part int, seq int, state string, edits string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch[c][k].as_py() for c in batch.schema.names}


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for conv, own in groupby(_rows(batches), key=itemgetter("conv")):
        choice = _Choice()
        for x in own:
            yield from ({"conv": conv} | y for y in choice.add(x))
        yield from ({"conv": conv} | y for y in choice.end())


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for conv, own in groupby(_rows(batches), key=itemgetter("conv")):
        sha, begun, audit, last = hashlib.sha256(), False, [], {}
        for last in own:
            rows = []
            if last["body"] is not None:
                body = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(last["body"])).read_all()
                rows = list(zip(*(c.to_pylist() for c in body.columns), strict=True))
            for initials, role, text in repaired(last["edits"], last["state"], rows):
                audit.append(initials)
                if role is not None:
                    sha.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
        yield {"conv": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()} | {c: last[c] for c in ("gaps", *COUNTS, "cost")}


def repair_conversations(convs: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: its faults (each row's first of blank, duplicate and truncated), gaps between turns,
    illegal neighbours, and the cheapest repair: cost, edits (``audit``) and the SHA-256 of the repaired text.

    Rows stand by turn, nulls first; those of one turn by role and text. Null roles and texts are one space, which is no role
    to keep and no text. Repeated rows are duplicates of each other. Rows without id are one conversation. ``ids``: a table
    with all ids to report; those without rows get zeros and the empty repair. An empty table gives no rows; other columns
    don't matter."""
    kind = convs.schema[id_col].dataType
    space = F.lit(" ")
    rows = convs.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text"))
    # equal rows once, with their number
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("same", F.sha1(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    # roles and texts that a conversation has in several turns, with the first of these
    seen = rows.groupBy("conv", "same").agg(F.count("*").alias("times"), F.max(F.col("turn").isNull()).alias("open"), F.min("turn").alias("first"))
    seen = seen.where("times > 1").select(F.col("conv").alias("conv2"), F.col("same").alias("same2"), "open", "first")
    again = F.when(F.col("open"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    rows = rows.join(seen, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("same") == F.col("same2")), "left")
    body = F.rtrim("text", F.lit(SPACE))
    rows = rows.select("conv", "turn", "role", "text", "n", F.coalesce(again, F.lit(False)).alias("again"), (body == "").alias("blank"), ((body != "") & ~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    if ids is not None:
        nothing = ids.select(F.col(id_col).cast(kind).alias("conv")).distinct()
        rows = rows.unionByName(nothing.select("conv", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), *(F.lit(False).alias(c) for c in ("again", "blank", "cut"))))
    dealt = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, HEAD)).sortWithinPartitions("conv", "turn", "role", "text")

    def with_conv(ddl: str) -> T.StructType:
        return T.StructType([T.StructField("conv", kind), *T._parse_datatype_string(ddl).fields])

    segment, choice, result = with_conv(_SEGMENT), with_conv(_CHOICE), with_conv(_RESULT)
    segments = materialize(dealt.mapInArrow(_segments(_arrow(segment)), segment), "segments")
    in_order = lambda df: df.repartition("conv").sortWithinPartitions("conv", F.col("part").asc_nulls_last(), "seq")
    arrow = _arrow(choice)
    chosen = materialize(in_order(segments.drop("body")).mapInArrow(lambda batches: _batched(_choices(batches), arrow), choice), "choices")
    # the last row of a conversation has the counts, and no segment
    whole = chosen.join(segments.select("part", "seq", "body"), ["part", "seq"], "left")
    arrow2 = _arrow(result)
    return in_order(whole).mapInArrow(lambda batches: _batched(_repairs(batches), arrow2), result).withColumnRenamed("conv", id_col)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def damage(convs: DataFrame) -> DataFrame:
    """Conversations with faults, by crc32 of ``conv_id:turn`` mod 20 (a null is one space): 0 drops a row, 1 empties its
    text, 2 removes its marks of a sentence's end, 3 repeats it, 4 makes it a user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = convs.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), fault.alias("fault"))
    return rows.where("fault <> 0").withColumn("copy", F.explode(F.expr("if(fault = 3, array(0, 1), array(0))"))).drop("fault", "copy")


def op12_conversation_structure_repair(spark, sf_dir):
    """All conversations, damaged and repaired."""
    convs = table(spark, sf_dir, "conversations")
    return repair_conversations(damage(convs), ids=convs)


SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
bits AS (SELECT key, length(key) AS n FROM (SELECT DISTINCT key FROM k)),
crc AS (SELECT key, 0::BIGINT AS i, 4294967295::BIGINT AS c FROM bits
 UNION ALL SELECT crc.key, i + 1, list_reduce([xor(c, ascii(substr(crc.key, (i + 1)::INTEGER, 1))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) FROM crc JOIN bits USING (key) WHERE i < n),
f AS (SELECT key, xor(c, 4294967295) % 20 AS fault FROM crc JOIN bits USING (key) WHERE i = n),
m AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
 FROM k JOIN f USING (key), range(CASE WHEN fault = 3 THEN 2 ELSE 1 END) WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM m),
q AS (SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
s AS (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM q),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM s GROUP BY ALL),
nxt(state, to_state) AS (VALUES ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
ways AS (SELECT state, '' AS ins, state AS at FROM nxt UNION ALL SELECT state, 'I', to_state FROM nxt UNION ALL SELECT x.state, 'II', y.to_state FROM nxt x JOIN nxt y ON y.state = x.to_state),
w AS (SELECT conv_id, 0::BIGINT AS i, '' AS state, 0::BIGINT AS cost, '' AS audit, '' AS out FROM c
 UNION ALL SELECT conv_id, i, state, cost, audit, out FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
   SELECT w.conv_id, s.i, CASE e WHEN 'D' THEN ways.at WHEN 'R' THEN nxt.to_state ELSE s.r END AS state,
    w.cost + 3 * length(ins) + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND truncated THEN 3 ELSE 0 END AS cost, w.audit || ins || e AS audit,
    w.out || CASE ins WHEN '' THEN '' WHEN 'I' THEN CASE ways.at WHEN 'u' THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END
      ELSE CASE ways.at WHEN 'a' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE chr(10) || 'assistant:' || chr(10) || 'user:' END END
     || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE nxt.to_state WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text END AS out
   FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1 JOIN ways ON ways.state = w.state JOIN nxt ON nxt.state = ways.at, (VALUES ('D'), ('K'), ('R')) v(e)
   WHERE e = 'D' OR (NOT blank AND NOT duplicate AND (e = 'R' OR s.r = nxt.to_state OR (s.r = 's' AND ways.at = ''))))) WHERE best = 1),
z AS (SELECT w.conv_id, w.cost + 3 * length(ins) AS cost, w.audit || ins AS audit,
  w.out || CASE ins WHEN '' THEN '' WHEN 'I' THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END AS out
 FROM w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN ways ON ways.state = w.state AND (ways.at = 'a' OR (ways.at = '' AND ins = ''))
 QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * length(ins), w.audit || ins) = 1)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(z.cost, 0) AS cost, coalesce(z.audit, '') AS audit, sha256(coalesce(substr(z.out, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id
"""
