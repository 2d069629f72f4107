"""Web archives: WARC records written and read back, and their capture index merged into global order.

``write_archives`` writes a record for each page: the first of equal payloads as ``response``, the others as ``revisit``
without the payload. Each record is a gzip member of its own, so that an index entry (file, offset, length) is enough to
read it. Spark's text writer puts the files where the cluster's file system is: the last byte of a gzip member is the
highest byte of the record's length, zero below 16 MiB, and the writer supplies it as its line end (a longer record is
followed by an empty member that ends so).

``capture_index`` is an external merge. Tasks sort runs of entries by key (URL key, time, id, place), cut them at
splitters and send the pieces; each range merges its pieces by a loser tree. Where runs are many, teams of runs are first
merged by coarse ranges, so that the pieces number about runs ** 1.5 and not runs ** 2. The place in the archive is part of
the key: a URL that a third of all captures have is cut into as many ranges as any other third.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, scratch_dir, table, unused

#: Records of a file, entries of a run that a task sorts, and entries of a range (on average) that a task merges, at most.
FILE_RECORDS, RUN_ROWS, RANGE_ROWS = 20_000, 50_000, 100_000
#: Sampled keys for each range; runs from which on they are merged in two levels.
SAMPLES, DIRECT = 40, 64
#: Captures of tables without a time of capture count seconds from here.
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)

_CHUNK = 1 << 16
_SHORT = 1 << 24
_EMPTY = gzip.compress(b"", mtime=0)
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENTRY = "key binary, url_key string, captured string, page_id bigint, file string, offset bigint, length bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, intact boolean"
_ENTRY_PA = pa.schema([("key", pa.binary()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
_PIECES = "team int, range int, n bigint, piece binary"
_PIECES_PA = pa.schema([("team", pa.int32()), ("range", pa.int32()), ("n", pa.int64()), ("piece", pa.binary())])


def b32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def header_safe(url: str | None) -> str:
    """A URL as a header can hold it: controls and blanks percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query: all of a site's captures stand together. The scheme,
    user, default port and fragment don't count. A text without ``://`` is its own key."""
    head, mark, rest = url.partition("://")
    if not mark:
        return url
    host, path = re.fullmatch(r"([^/?#]*)([^#]*).*", rest, re.S).groups()
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    if port == {"http": "80", "https": "443"}.get(head.lower()):
        port = ""
    return ",".join(host.split(".")[::-1]) + (f":{port}" if port else "") + ")" + (path if path.startswith("/") else f"/{path}")


def record(page_id: int | None, url: str | None, captured: str, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """A record as a gzip member. ``first``: the page that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(page_id), "WARC-Date": captured, "WARC-Target-URI": header_safe(url), "WARC-Payload-Digest": f"sha1:{digest}"}
    if revisit:
        fields |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": _urn(first)}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _line(member: bytes) -> bytes:
    """What the writer is given: its line end, a zero byte, completes the member."""
    return (member if member[-1] == 0 else member + _EMPTY)[:-1]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, min_bytes: int = 0, file_records: int = FILE_RECORDS) -> None:
    """Writes a record for each row to files in ``path``. Of rows with equal payloads (SHA-1 and length) of at least
    ``min_bytes`` bytes those with the smallest id are responses; the others revisit it. Rows without id revisit a row that has
    one; if none has, all are responses, as rows that repeat id and payload are. Null payloads are empty. ``time_col``: a
    timestamp; without it, or where it is null, ids (mod 10^9) count seconds from EPOCH. An empty table gives no records."""
    seconds = F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(1_000_000_000))
    when = F.lit(None).cast("long") if time_col is None else F.unix_timestamp(F.col(time_col).cast("timestamp"))
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(when, seconds + int(EPOCH.timestamp())).alias("at"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    firsts = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null").drop("rows")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for k in range(batch.num_rows):
                x = {c: batch[c][k].as_py() for c in batch.schema.names}
                captured = datetime.fromtimestamp(x["at"], timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
                digest = base64.b32encode(bytes.fromhex(x["digest"])).decode()
                out.append(_line(record(x["id"], x["url"], captured, x["payload"], digest, x["first"], x["first"] is not None and x["id"] != x["first"])))
                size += len(out[-1])
                if size > 8_000_000 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0

    lines = rows.join(firsts, ["digest", "size"], "left").select("id", "url", "at", "payload", "digest", "first").mapInArrow(build, "value binary")
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", file_records).text(path)


def members(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and contents of each gzip member."""
    at = 0
    while at < len(content):
        reader, parts, end = zlib.decompressobj(31), [], at
        while not reader.eof:
            chunk = content[end : end + _CHUNK]
            if not len(chunk):
                raise EOFError("a record is cut off")
            parts.append(reader.decompress(chunk))
            end += len(chunk) - len(reader.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def entries(name: str, content: memoryview) -> Iterator[dict]:
    """An index entry for each record. ``intact``: the payload (of a response) has the length and digest that it should."""
    for offset, length, raw in members(content):
        if not raw:
            continue
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
        page_id, captured = _id_of(fields["WARC-Record-ID"]), fields["WARC-Date"]
        own = url_key(fields["WARC-Target-URI"])
        order = (1 << 64) - 1 if page_id is None else page_id + (1 << 63)
        key = b"\0".join((own.encode(), captured.encode(), order.to_bytes(8, "big") + name.encode())) + offset.to_bytes(8, "big")
        yield {
            "key": key, "url_key": own, "captured": captured, "page_id": page_id, "file": name, "offset": offset, "length": length, "record_type": fields["WARC-Type"],
            "payload_bytes": n, "payload_digest": digest, "refers_to": _id_of(fields.get("WARC-Refers-To")), "intact": revisit or (len(payload) == n and b32_digest(payload) == digest),
        }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """An entry for each record of the files in ``path``, with the key of the index order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                held = []
                for x in entries(name.as_py().rsplit("/", 1)[-1], memoryview(content.as_buffer())):
                    held.append(x)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema=_ENTRY_PA)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=_ENTRY_PA)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, _ENTRY)


def loser_tree(runs: list[list[bytes]]) -> Iterator[int]:
    """Merges sorted runs: the run that each next entry comes from. Equal entries come by the order of their runs."""
    k = len(runs)
    at, heads = [0] * k, [r[0] if r else None for r in runs]

    def behind(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        return x is None if y is None or x is None else (x, a) > (y, b)

    def play(node: int) -> int:
        """The winner below a node; losers stay in the nodes."""
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if behind(a, b):
            a, b = b, a
        losers[node] = b
        return a

    losers = [0] * k
    winner = play(1) if k > 1 else 0
    while k and heads[winner] is not None:
        yield winner
        at[winner] += 1
        heads[winner] = runs[winner][at[winner]] if at[winner] < len(runs[winner]) else None
        node = (winner + k) // 2
        while node:
            if behind(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


def _merged(t: pa.Table) -> pa.Table:
    """The pieces of a range as one sorted table."""
    pieces = [pa.ipc.open_stream(x).read_all() for x in t["piece"].to_pylist()]
    runs = [x["key"].to_pylist() for x in pieces]
    starts = [0]
    for r in runs[:-1]:
        starts.append(starts[-1] + len(r))
    order = []
    for k in loser_tree(runs):
        order.append(starts[k])
        starts[k] += 1
    return pa.concat_tables(pieces).take(pa.array(order, pa.int64()))


def _cut(sorted_rows: pa.Table, team: int, splitters: list[bytes]) -> Iterator[dict]:
    """Pieces by range: keys below the first splitter, and so on."""
    keys = sorted_rows["key"].to_pylist()
    at = 0
    while at < len(keys):
        k = bisect_right(splitters, keys[at])
        end = bisect_left(keys, splitters[k], at) if k < len(splitters) else len(keys)
        sink = pa.BufferOutputStream()
        piece = sorted_rows.slice(at, end - at).combine_chunks()
        with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(piece)
        yield {"team": team, "range": k, "n": end - at, "piece": sink.getvalue().to_pybytes()}
        at = end


def capture_index(entries_df: DataFrame, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS, direct: int = DIRECT) -> DataFrame:
    """The entries in global order, with their ``position`` (from 0). ``entries_df``: a written table with a unique binary
    ``key``; its other columns stay, under any name."""
    columns, spare = entries_df.columns, unused(entries_df, "range_no")
    place = unused(entries_df, "place")
    n = entries_df.count()
    n_ranges, n_runs = max(1, -(-n // range_rows)), max(1, -(-n // run_rows))
    splitters: list[bytes] = []
    if n_ranges > 1:
        # as many keys as ranges need, picked by hash: the same ones if a task runs again
        rate = min(1.0, SAMPLES * n_ranges / n)
        picked = sorted(r[0] for r in entries_df.where(F.abs(F.xxhash64("key") % 1_000_000_007) < int(rate * 1_000_000_007) + 1).select("key").collect())
        splitters = [bytes(picked[len(picked) * k // n_ranges]) for k in range(1, n_ranges)] if picked else []
    two = n_runs > direct
    step = math.isqrt(n_ranges - 1) + 1 if two else 1
    coarse, teams = splitters[step - 1 :: step], math.isqrt(n_runs - 1) + 1 if two else 1

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            t = t.sort_by("key")
            team = zlib.crc32(t["key"][0].as_py()) % teams
            return pa.RecordBatch.from_pylist(list(_cut(t, team, coarse)), schema=_PIECES_PA)

        for batch in batches:
            for a in range(0, batch.num_rows, run_rows):
                held.append(batch.slice(a, run_rows))
                size += held[-1].num_rows
                if size >= run_rows:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    pieces = entries_df.mapInArrow(runs, _PIECES)
    if two:
        pieces = pieces.groupBy("team", "range").applyInArrow(lambda t: pa.Table.from_pylist(list(_cut(_merged(t), t["team"][0].as_py(), splitters)), schema=_PIECES_PA), _PIECES)

    def merge(t: pa.Table) -> pa.Table:
        out = _merged(t)
        return out.append_column(spare, pa.repeat(pa.scalar(t["range"][0].as_py(), pa.int32()), len(out))).append_column(place, pa.array(range(len(out)), pa.int64()))

    schema = T.StructType([*entries_df.schema.fields, T.StructField(spare, T.IntegerType()), T.StructField(place, T.LongType())])
    ordered = materialize(pieces.groupBy("range").applyInArrow(merge, schema), "captures")
    sizes = ordered.groupBy(spare).agg(F.count("*").alias("rows"))
    before = sizes.select(spare, (F.sum("rows").over(Window.orderBy(spare)) - F.col("rows")).alias("before"))  # a row a range
    return ordered.join(before, spare).select(*columns, (F.col("before") + F.col(place)).alias("position"))


def op11_warc(spark, sf_dir):
    """All pages written as WARC records and read back in the order of the merged capture index."""
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    found = materialize(read_archives(spark, path), "entries")
    ordered = capture_index(found)
    discard(found)
    return ordered.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, coalesce(url, '') AS url, strpos(url, '://') > 0 AS has_host, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
h AS (SELECT *, regexp_replace(regexp_extract(rest, '^[^/?#]*'), '^.*@', '') AS host, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS path,
  lower(split_part(url, '://', 1)) AS scheme FROM p),
d AS (SELECT page_id, strlen(html) AS payload_bytes, hex, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + (((('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31)::INTEGER), 1)), '') AS payload_digest,
  min(page_id) OVER (PARTITION BY hex) AS first,
  CASE WHEN has_host THEN array_to_string(list_reverse(string_split(split_part(lower(host), ':', 1), '.')), ',')
    || CASE WHEN strpos(host, ':') = 0 OR split_part(host, ':', 2) = '' OR (scheme = 'http' AND split_part(host, ':', 2) = '80') OR (scheme = 'https' AND split_part(host, ':', 2) = '443') THEN '' ELSE ':' || substr(host, strpos(host, ':') + 1) END
    || ')' || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END ELSE url END AS url_key,
  strftime(TIMESTAMP '2000-01-01' + to_seconds(coalesce(((page_id % 1000000000) + 1000000000) % 1000000000, 0)), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, url_key, captured,
 row_number() OVER (ORDER BY url_key, captured, page_id NULLS LAST) - 1 AS position FROM d
"""
