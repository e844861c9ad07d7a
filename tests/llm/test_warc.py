import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from orrery.llm import warc
from orrery.session import scratch_path

SCHEMA = "page_id long, url string, html string, digest string, n long, data string, uid int"
ROWS = [
    (3, "http://a/\r\nx", "x" * 50), (1, None, "x" * 50), (2, "a b", None), (5, "b", ""), (9, "c", "é" * 3000), (8, "d", "é" * 3000),
    (7, "e", "end\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n"), (7, "e", "other"), (9, "c", "é" * 3000), (10, "f", "<p>" * 40_000), (None, "g", "no id"), (-4, "h", "x" * 50),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "z", 1, "q", 0) for r in rows], SCHEMA)


def expected(rows, least=0):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out, seen = [], set()
    for i, _, h in rows:
        data = (h or "").encode()
        first = min((x for x in groups[h or ""] if x is not None), default=None)
        revisit = len(data) >= least and (i != first or (i, h) in seen)
        seen.add((i, h))
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 20])
@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, chunk, least):
    rows = ROWS if least == 0 else [r for r in ROWS if r[0] != 9] + [(9, "c", "é" * 3000)]
    got = warc.round_trip(spark, pages(spark, rows), least=least, chunk=chunk).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, least)


def test_payload_chunks_join_to_the_payload(spark):
    df = pages(spark)
    rows = warc.chunk_rows(df, warc.decide(df, "page_id", "html"), "page_id", "html", "url", 1000)
    index = warc.write_archives(rows, scratch_path(spark, "warc"))
    got = defaultdict(list)
    for r in warc.read_chunks(index, chunk=512, segment=4096).where("record_type = 'response'").collect():
        assert len(r.payload) <= 512
        got[(r.record, r.payload_digest)].append((r.chunk_no, bytes(r.payload), r.running_digest, r.last))
    for (_, digest), parts in got.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts))) and [p[3] for p in parts] == [False] * (len(parts) - 1) + [True]
        whole = b""
        for _, data, running, _ in parts:
            whole += data
            assert running == base64.b32encode(hashlib.sha1(whole).digest()).decode()
        assert running == digest
    assert {len(b"".join(x[1] for x in p)) for p in got.values()} == {len((r[2] or "").encode()) for r in ROWS}


def test_one_response_of_a_row_that_several_large_files_repeat(spark, tmp_path):
    for i in range(4):
        rows = [(1, "u", "same payload")] + [(100 * i + 10 + j, "u", f"{i} {j} " + hashlib.sha256(f"{i}.{j}".encode()).hexdigest() * 4000) for j in range(12)]
        pages(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    got = [r for r in warc.round_trip(spark, df).collect() if r.page_id == 1]
    assert sorted((r.record_type, r.refers_to) for r in got) == [("response", None)] + [("revisit", 1)] * 3


def test_every_record_has_a_name_of_its_own(spark):
    for least in (0, 100):
        df = pages(spark, ROWS + ROWS[:3])
        index = warc.write_archives(warc.chunk_rows(df, warc.decide(df, "page_id", "html", least), "page_id", "html", "url", least=least), scratch_path(spark, "warc"))
        rows = warc.read_chunks(index, with_payload=False).where("last").collect()
        names = [r.record for r in rows]
        assert len(set(names)) == len(names) == len(ROWS) + 3
        # What a revisit refers to is a response of the same payload.
        found = {r.record: r for r in rows}
        for r in rows:
            if r.record_type == "revisit":
                assert found[r.refers_to].record_type == "response" and found[r.refers_to].payload_digest == r.payload_digest


def test_payloads_of_several_chunks_and_segments(spark):
    rows = [(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * n) for i, n in enumerate((50_000, 120_000, 1, 40_000, 50_000))] + [(9, "u", hashlib.sha256(b"0").hexdigest() * 50_000)]
    df = pages(spark, rows)
    chunks = warc.chunk_rows(df, warc.decide(df, "page_id", "html"), "page_id", "html", "url")
    assert chunks.selectExpr("max(octet_length(payload))", "max(chunk_no)").first()[:] == (warc.CHUNK, 7)
    index = warc.write_archives(chunks, scratch_path(spark, "warc"))
    got = defaultdict(bytes)
    for r in sorted(warc.read_chunks(index, segment=1 << 20).collect(), key=lambda r: (r.record, r.chunk_no)):
        got[r.record] += bytes(r.payload)
    want = defaultdict(int)
    for data in got.values():
        want[hashlib.sha1(data).hexdigest()] += 1
    assert {hashlib.sha1(h.encode()).hexdigest() for _, _, h in rows} <= set(want) and sorted(map(len, got.values()))[-1] == 64 * 120_000
    assert sorted(map(tuple, warc.round_trip(spark, df).collect()), key=str) == expected(rows)


def test_payloads_of_single_rows_are_not_moved(spark):
    df = pages(spark)
    plan = warc.chunk_rows(df, warc.decide(df.limit(0), "page_id", "html"), "page_id", "html", "url")
    assert plan.where("refers_to IS NOT NULL").count() == 0


def test_archives_are_plain_gzip_of_the_format(spark):
    df = pages(spark, ROWS[:4])
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(warc.chunk_rows(df, warc.decide(df, "page_id", "html"), "page_id", "html", "url"), folder)
    for (archive,) in index.select("archive").distinct().collect():
        text = gzip.decompress(open(archive.removeprefix("file://"), "rb").read())
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
        assert b"WARC-Target-URI: http://a/%0D%0Ax" in text or b"http://a/" not in text


def test_digest_in_base32(spark):
    df = spark.createDataFrame([("",), ("abc",)], "t string")
    from pyspark.sql import functions as F

    got = {r[0]: r[1] for r in df.select("t", warc.base32(F.sha1("t"))).collect()}
    assert got == {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in ("", "abc")}


def test_empty_table(spark):
    assert warc.round_trip(spark, pages(spark, [])).count() == 0
