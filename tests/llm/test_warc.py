"""Web archives: round trip, revisits, and the order of the merged capture index."""

import base64
import gzip
import hashlib
import random
import uuid

import pytest

from helixlake.llm import warc
from helixlake.llm.common import materialize, scratch_dir

PAGES = "page_id long, url string, html string, key string, place int, range_no int, digest string"


def pages():
    r = random.Random(4)
    body = ["<p>one</p>", "", None, "\r\n\r\nWARC/1.1\r\n\r\nin the text\0", "é" * 50, "x" * 300_000]
    urls = ["http://a.b.org/x?y#z", "https://A.b.org:443/x?y", "http://c.org:8080", "no url", None, "http://u@d.org/\r\nX: y", "http://hot.org/"]
    rows = [(k, r.choice(urls) if k % 3 else urls[-1], r.choice(body)) for k in range(60)]
    return [*rows, rows[7], rows[7], (None, urls[0], body[0]), (None, None, None), (None, urls[1], "only without id"), (None, urls[2], "only without id"), (-5, urls[2], "y"), (2**62, urls[2], "y")]


def plain(rows, least=0):
    firsts = {}
    for i, _, t in rows:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    out = []
    for i, _, t in rows:
        raw, first = (t or "").encode(), firsts.get(t or "")
        revisit = len(raw) >= least and first is not None and i != first
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(*x, "k", 1, 2, "d") for x in pages()], PAGES)


def test_round_trip(spark, df):
    for least, most in ((0, warc.FILE_RECORDS), (11, 5)):
        path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
        warc.write_archives(df, path, min_bytes=least, file_records=most)
        found = materialize(warc.read_archives(spark, path), "entries")
        rows = found.collect()
        assert sorted(str((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to)) for x in rows) == plain(pages(), least)
        assert all(x.intact for x in rows)
        # an entry is enough to read its record from the file
        files = {f.path.rsplit("/", 1)[-1]: bytes(f.content) for f in spark.read.format("binaryFile").load(path).collect()}
        for x in rows:
            raw = gzip.decompress(files[x.file][x.offset : x.offset + x.length])
            assert raw.startswith(b"WARC/1.1\r\nWARC-Type: " + x.record_type.encode()) and raw.endswith(b"\r\n\r\n")
        assert sum(x.length for x in rows) == sum(map(len, files.values()))
        assert most > 5 or len(files) > 5
        for few in ({"run_rows": 1000, "range_rows": 1000}, {"run_rows": 7, "range_rows": 9}, {"run_rows": 3, "range_rows": 4, "direct": 1}):
            ordered = sorted(warc.capture_index(found, **few).collect(), key=lambda x: x.position)
            assert [x.position for x in ordered] == list(range(len(rows)))
            assert [bytes(x.key) for x in ordered] == sorted(bytes(x.key) for x in rows)
            histories = [(x.url_key, x.captured) for x in ordered]
            assert histories == sorted(histories)


def test_empty_table(spark, df):
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(df.where("false"), path)
    assert warc.capture_index(materialize(warc.read_archives(spark, path), "entries")).count() == 0


def test_times(spark):
    df = spark.sql("select 1L page_id, 'u' url, 'h' html, timestamp'2020-02-03 04:05:06' seen union all select 3L, 'u', 'i', null")
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(df, path, time_col="seen")
    assert sorted(x.captured for x in warc.read_archives(spark, path).collect()) == ["2000-01-01T00:00:03Z", "2020-02-03T04:05:06Z"]


def test_long_record_ends_for_the_writer():
    """From 16 MiB on the last byte of a member isn't zero."""
    r = random.Random(1)
    for payload in (b"x", r.randbytes(100), b"y" * (warc._SHORT + 5)):
        member = warc.record(1, "u", "2000-01-01T00:00:00Z", payload, warc.b32_digest(payload), None, False)
        content = (warc._line(member) + b"\0") * 2
        got = list(warc.entries("f", memoryview(content)))
        assert [x["payload_bytes"] for x in got] == [len(payload)] * 2 and all(x["intact"] for x in got)


def test_damage_is_seen():
    payload = b"<p>text</p>"
    other = warc.record(1, "u", "2000-01-01T00:00:00Z", b"<p>next</p>", warc.b32_digest(payload), None, False)
    assert [x["intact"] for x in warc.entries("f", memoryview(other))] == [False]
    with pytest.raises(EOFError):
        list(warc.entries("f", memoryview(other[:-9])))


def test_url_keys():
    assert warc.url_key("https://u:p@Www.A.org:443/b/C?d=e#f") == "org,a,www)/b/C?d=e"
    assert warc.url_key("http://a.org:81") == "org,a:81)/" and warc.url_key("x") == "x" and warc.url_key("") == ""


def test_loser_tree():
    r = random.Random(2)
    for k in (0, 1, 2, 3, 7, 33):
        runs = [sorted(bytes([r.randrange(9), r.randrange(9)]) for _ in range(r.randrange(12))) for _ in range(k)]
        at = [0] * k
        out = []
        for run in warc.loser_tree(runs):
            out.append((runs[run][at[run]], run))
            at[run] += 1
        assert out == sorted((x, i) for i, own in enumerate(runs) for x in own)
