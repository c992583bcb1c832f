import gzip
import os
import random

from sketchloom.llm import warc


def brute(pages):
    by = {}
    for i, _, h in pages:
        by.setdefault((h or "").encode(), []).append(i)
    out = []
    for i, _, h in pages:
        p = (h or "").encode()
        known = [x for x in by[p] if x is not None]
        top = max(known) if known else None
        revisit = top is not None and i != top
        out.append((i, len(p), warc.sha1_base32(p), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    pages = [(i, f"http://x/{i}\r\n?", "".join(rng.choice("ab\r\n\r\né<") for _ in range(rng.choice([0, 1, 5, 700, 9000])))) for i in range(120)]
    pages += [(200 + i, None, "copy \r\n\r\n é" * 900) for i in range(9)] + [(300, "u", None), (301, "u", ""), (302, "u", "big" * 200_000)]
    pages += [(None, "u", ""), (None, "u", "only null"), (None, "u", "only null"), (400, "u", "same"), (400, "u", "same"), (7, "u", "other text")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    path = f"file://{tmp_path}/a"
    warc.write_archive(df, path, segment_bytes=700)
    back = warc.read_archive(spark, path).selectExpr("*", "try_cast(split(record_id, ':')[2] as bigint) as page", "try_cast(split(refers_to, ':')[2] as bigint) as origin").collect()
    got = sorted(((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["origin"]) for r in back), key=repr)
    assert got == brute(pages)
    assert all(r["complete"] for r in back)
    names = {r["record_id"] for r in back if r["record_type"] == "response"}
    assert len({r["record_id"] for r in back}) == len(back) and all(r["refers_to"] in names for r in back if r["refers_to"])
    bodies = {r["page"]: bytes(r["payload"]) for r in back if r["record_type"] == "response"}
    assert bodies[302] == b"big" * 200_000 and bodies[301] == b"" and bodies[7] == b"other text"


def test_segments_in_other_files_and_missing_ones(spark, tmp_path):
    recs = warc.records_of("5", 0, "u", b"x" * 5000, "D", None, "2024-01-01T00:00:00Z", 1000)
    lost = warc.records_of("6", 0, "u", b"y" * 5000, "D", None, "2024-01-01T00:00:00Z", 1000)
    os.makedirs(tmp_path / "w")
    for k, r in enumerate([*recs, *lost[:2], *lost[3:]]):
        (tmp_path / "w" / f"{9 - k % 10}-{k}.warc.gz").write_bytes(gzip.compress(r + b"\r\n\r\n"))
    rows = {r["record_id"]: r for r in warc.read_archive(spark, f"file://{tmp_path}/w").collect()}
    assert bytes(rows["urn:x-page:5:0"]["payload"]) == b"x" * 5000 and rows["urn:x-page:5:0"]["complete"]
    assert rows["urn:x-page:6:0"]["payload"] is None and not rows["urn:x-page:6:0"]["complete"]


def test_empty_and_framing(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(empty, f"file://{tmp_path}/e")
    assert warc.read_archive(spark, f"file://{tmp_path}/e").count() == 0
    for n in (0, 1, 4095, 4096, 4097, 10_000):
        assert warc.dechunk(warc.chunked(b"q" * n)) == b"q" * n
    assert warc.dechunk(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n") is None and warc.dechunk(b"zz") is None


def test_broken_records_do_not_end_the_job(spark, tmp_path):
    good = [warc.records_of(str(i), 0, f"http://x/{i}", b"body %d" % i, "D", None, "2024-01-01T00:00:00Z", 1000)[0] + b"\r\n\r\n" for i in range(6)]
    os.makedirs(tmp_path / "w")
    noise = b"not a record\r\nat all\r\n"
    no_length = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:70:0>\r\n\r\nlost block\r\n\r\n"
    bad_bytes = good[2].replace(b"http://x/2", b"http://x/\xff\xfe")
    (tmp_path / "w" / "a.warc").write_bytes(good[0] + noise + good[1] + no_length + bad_bytes)
    whole = gzip.compress(good[3] + good[4] * 50)
    (tmp_path / "w" / "b.warc.gz").write_bytes(whole[: len(whole) - 12])  # the stream breaks off
    (tmp_path / "w" / "c.warc").write_bytes(good[5][:-20])  # the block is cut short
    (tmp_path / "w" / "d.warc").write_bytes(b"")
    (tmp_path / "w" / "e.warc").write_bytes(b"\x1f\x8bnonsense")
    rows = [(r["record_id"], r["record_type"], r["complete"]) for r in warc.read_archive(spark, f"file://{tmp_path}/w").collect()]
    ok = {i for i, _, c in rows if c}
    assert {f"urn:x-page:{i}:0" for i in (0, 1, 2, 3)} <= ok and "urn:x-page:5:0" not in ok and "urn:x-page:70:0" not in ok
    broken = [(i, k) for i, k, c in rows if not c]
    assert ("urn:x-page:70:0", "response") in broken and ("urn:x-page:5:0", "response") in broken and (None, "broken") in broken
