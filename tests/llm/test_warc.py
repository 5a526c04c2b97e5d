import gzip
import hashlib
import random

from densel.llm import warc
from densel.session import scratch_dir

SCHEMA = "key long, url string, payload binary, kind string, _sha int"


def test_chunked_framing():
    for n in (0, 1, 8191, 8192, 8193, 30000):
        data = random.Random(n).randbytes(n)
        assert warc.dechunked(warc.chunked(data, 8192)) == data
    for broken in (b"", b"5\r\nabc", b"5\r\nabcdeXX0\r\n\r\n", b"zz\r\n"):
        try:
            warc.dechunked(broken)
        except ValueError:
            continue
        raise AssertionError(broken)


def pages():
    rng = random.Random(1)
    same, binary = b"x" * 1500, rng.randbytes(200_000)
    return [(1, "http://a/1", same), (5, "http://a/5", same), (3, None, same), (None, "http://n", same),
            (2, "http://a/2", b"short"), (4, "http://a/4", b"short"), (6, "http://a/6", None), (7, "http://a/7", b""),
            (8, "http://a/8\r\nWARC-Type: fake", binary), (9, "u", b"\r\n\r\nWARC/1.1\r\n" * 100),
            (10, "u", "é€".encode() * 40_000), (11, "u", b"y" * 1000), (11, "u", b"y" * 1000), (None, "m", b"z" * 2000)]


def test_round_trip(spark):
    rows = pages()
    path = scratch_dir(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA), path, segment_bytes=16 * 1024)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r.status == "ok" for r in got)
    want = sorted((str(k), len(p or b""), hashlib.sha1(p or b"").hexdigest()) for k, _, p in rows)
    assert sorted((str(r.key), r.payload_bytes, r.payload_digest) for r in got) == want
    to = {r.key: (r.kind, r.refers_to_key) for r in got if r.payload_digest == hashlib.sha1(b"x" * 1500).hexdigest()}
    assert to == {"1": ("revisit", "5"), "3": ("revisit", "5"), None: ("revisit", "5"), "5": ("response", None)}
    assert {r.kind for r in got if r.key in ("2", "4", "6", "7", "11")} == {"response"}
    payloads = {r.key: r.payload for r in got if r.kind == "response"}
    assert all(bytes(payloads[str(k)]) == (p or b"") for k, _, p in rows if k in (5, 6, 7, 8, 9, 10))
    assert next(r.kind for r in got if r.payload_bytes == 2000) == "response"


def test_damage_is_told(spark):
    rows = [(i, "u", bytes([65 + i]) * 100_000) for i in range(4)]
    path = scratch_dir(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).coalesce(1), path)
    import glob
    whole = gzip.decompress(open(glob.glob(path.replace("file:", "") + "/*.gz")[0], "rb").read())
    records = [b"WARC/1.1\r\n" + r for r in whole.split(b"WARC/1.1\r\n")[1:]]
    second = next(i for i, r in enumerate(records) if b"X-Key: 0\r\n" in r) + 1
    last = max(i for i, r in enumerate(records) if b"Total-Length" in r and b"BBBB" in r)
    records[last] = records[last].replace(b"Total-Length: 100", b"Total-Length: 999")
    del records[second]
    third = next(i for i, r in enumerate(records) if b"CCCC" in r and b"X-Key: 2\r\n" in r)
    records[third] = records[third].replace(b"CCCC", b"CCxC", 1)
    damaged = scratch_dir(spark, "test-warc").replace("file:", "")
    import os
    os.makedirs(damaged)
    with gzip.open(f"{damaged}/a.gz", "wb") as f:
        f.write(b"".join(records))
    got = {r.key: r.status for r in warc.read_archives(spark, damaged).collect()}
    assert got == {"0": "segment missing", "1": "total length differs", "2": "digest differs", "3": "ok"}


def test_no_pages(spark):
    path = scratch_dir(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).collect() == []


def record(kind, block, *headers, length=None):
    lines = [f"WARC-Type: {kind}", *headers, *([] if length == "" else [f"Content-Length: {len(block) if length is None else length}"])]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http(body):
    return b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body


def test_chunk_sizes_that_are_no_numbers_end():
    for broken in (b"1\r\na\r\n-6\r\n", b"+1\r\na\r\n0\r\n\r\n", b"0x1\r\na\r\n0\r\n\r\n", b"1_0\r\n", b"\r\n\r\n", b"f" * 40 + b"\r\n"):
        try:
            warc.dechunked(broken)
        except ValueError:
            continue
        raise AssertionError(broken)


def test_bad_records_get_a_status_and_the_rest_is_read(spark):
    import os
    sha = hashlib.sha1(b"a").hexdigest()
    good = http(b"1\r\na\r\n0\r\n\r\n")
    parts = [
        record("response", http(b"1\r\na\r\n-6\r\n"), "X-Key: 1"),
        record("response", good, "X-Key: 2", f"WARC-Payload-Digest: sha1:{sha.upper()}"),
        record("response", good, "X-Key: 3", "WARC-Payload-Digest: md5:0cc175b9c0f1b6a831c399e269772661"),
        b"no record at all\r\nnor this\r\n",
        record("response", good, "X-Key: 4"),
        record("response", good, "X-Key: 5", length=""),
        record("response", good, "X-Key: 6", length="-4"),
        record("revisit", b"", "X-Key: 7", "WARC-Payload-Digest: sha1:!!", "X-Payload-Length: many"),
        record("continuation", b"x", "X-Key: 8", "WARC-Segment-Number: none"),
        record("response", good, "X-Key: 9", "WARC-Segment-Number: 99999999999999"),
        record("warcinfo", b"ignored"),
        record("response", good, "X-Key: 10", f"WARC-Payload-Digest: {sha}"),
        record("response", good, "X-Key: 11", length=10_000)]
    folder = scratch_dir(spark, "test-warc").replace("file:", "")
    os.makedirs(folder)
    with gzip.open(f"{folder}/a.gz", "wb") as f:
        f.write(b"".join(parts))
    whole = gzip.compress(b"".join(parts[:2]) + random.Random(1).randbytes(50_000))
    with open(f"{folder}/b.gz", "wb") as f:
        f.write(whole[:len(whole) // 2])
    rows = [(r.key, r.status) for r in warc.read_archives(spark, folder).collect()]
    got = sorted({r for r in rows if r[0]}, key=lambda r: int(r[0]))  # 1 and 2 may be in both files
    assert got == [
        ("1", "transfer framing broken"), ("2", "ok"), ("3", "digest unreadable"), ("4", "ok"), ("5", "record damaged"),
        ("6", "record damaged"), ("7", "digest unreadable"), ("8", "record damaged"), ("10", "ok"),
        ("11", "record damaged")]
    assert {s for k, s in rows if not k} == {"record damaged", "segment missing"}  # 9 has no first segment, so no key
