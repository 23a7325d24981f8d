from __future__ import annotations

import base64
import glob
import gzip
import hashlib

from pyspark.sql import functions as F

from vantor.llm.warc import base32, captures, parse, read_records, round_trip, write_archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_hold_standard_records(spark, tmp_path):
    rows = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://d/\r\nX: y", "ä\r\n\r\nWARC/1.1\r\n\r\n"), (5, "http://e/", "")]
    path = str(tmp_path / "w")
    write_archives(pages(spark, rows), path)
    found = [r for f in glob.glob(f"{path}/*.gz") for r in parse(gzip.open(f).read())]
    assert sorted(h["warc-type"] for h, _ in found) == sorted(["request"] * 5 + ["metadata"] * 5 + ["response"] * 3 + ["revisit"] * 2)
    assert all(h["version"] == "WARC/1.1" and h["warc-record-id"].startswith("<urn:uuid:") for h, _ in found)
    bodies = {b.partition(b"\r\n\r\n")[2] for h, b in found if h["warc-type"] == "response"}
    assert bodies == {b"<p>one</p>", b"", rows[3][2].encode()}
    nested = captures(read_records(spark, path)).select("capture.*").collect()
    assert len(nested) == 5 and all(r.request.target == r.response.target and r.metadata.page_id for r in nested)
    by = {r.metadata.page_id: r for r in nested}
    assert by["2"].response.record_type == "revisit" and by["2"].response.refers_to == 1 and by["2"].response.payload is None
    assert bytes(by["4"].response.payload).decode() == rows[3][2]


def test_round_trip_brute_force(spark):
    texts = ["a", "a", None, "", "é" * 1000, "a", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "x" * 300_000]
    rows = [(9 - k, f"http://x/{k}", t) for k, t in enumerate(texts)]
    for least in (0, 2):
        got = {r.page_id: r for r in round_trip(pages(spark, rows), least).collect()}
        for i, _, t in rows:
            data = (t or "").encode()
            first = min(p for p, _, u in rows if (u or "").encode() == data)
            again = i > first and len(data) >= least
            r = got[i]
            assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            assert (r.record_type, r.refers_to, r.intact) == ("revisit" if again else "response", first if again else None, True)


def test_edges(spark):
    assert round_trip(pages(spark, [])).count() == 0
    got = round_trip(pages(spark, [(None, None, None), (1, "u", "x"), (1, "u", "x")])).collect()
    assert sorted((str(r.page_id), r.record_type) for r in got) == [("1", "response"), ("1", "response"), ("None", "response")]
    clash = pages(spark, [(1, "u", "x")]).selectExpr("*", "'z' AS digest", "'q' AS record", "1 AS n", "true AS revisit")
    assert round_trip(clash).count() == 1


def test_missing_partner(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(pages(spark, [(1, "u", "x"), (2, "v", "y")]), path)
    found = read_records(spark, path).where("NOT (record_type = 'request' AND target = 'u')")
    nested = captures(found).select("capture.*").collect()
    assert sorted(r.request is None for r in nested) == [False, True]


def test_base32_in_three_steps(spark):
    """There was a conversion for every four letters, within a lambda."""
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(300)] + ["0" * 40, "f" * 40, "0" * 39 + "1", "8" + "0" * 39, "0" * 15 + "f" * 25]
    found = spark.createDataFrame([(h,) for h in hexes], "h string").select("h", base32(F.col("h")).alias("b"))
    assert {r.h: r.b for r in found.collect()} == {h: base64.b32encode(bytes.fromhex(h)).decode() for h in hexes}
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("conv(") == 3 and "transform(" not in plan
