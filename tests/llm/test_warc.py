"""Archives round trip."""

import base64
import hashlib

from rankweave.llm import blocks, files, warc


def test_archives_round_trip(spark):
    pages = [(3, "http://a/ b", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (5, "u", ""), (4, "u", "x" * 200_000), (4, "u", "x" * 200_000), (None, "n", "<p>é</p>"), (-9, "m", "solo"), (2**45, "z", "<p>é</p>")]
    df = spark.createDataFrame([(*p, "ignored") for p in pages], "page_id long, url string, html string, payload string")
    for least in (0, 9):
        first = {}
        for i, _, h in pages:
            b = (h or "").encode()
            if i is not None and len(b) >= least:
                first[b] = min(i, first.get(b, i))
        want = []
        for i, _, h in pages:
            b = (h or "").encode()
            refers = first.get(b)
            refers = refers if refers is not None and i is not None and refers < i else None
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if refers is not None else "response", refers))
        out = warc.archived(df, least).collect()
        assert sorted(map(str, (tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in out))) == sorted(map(str, want))
        assert {(r["page_id"], bytes(r["payload"]).decode()) for r in out if r["record_type"] == "response"} <= {(i, h or "") for i, _, h in pages}
    assert warc.archived(df.limit(0)).count() == 0


def test_only_selected_records_are_read(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"body {i}" * (i + 1)) for i in range(200)], "page_id long, url string, html string")
    folder = blocks.scratch(spark)
    index = blocks.stored(warc.write_archives(df, folder))
    some = warc.read_records(index.where("url like '%7'"), folder, gap=0).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in some} == {i: f"body {i}" * (i + 1) for i in range(7, 200, 10)}


def test_ranges_coalesce_over_small_holes():
    assert list(files.ranges([0, 10, 30, 100], [10, 5, 5, 1], 15, 1000)) == [(0, 3, 0, 35), (3, 4, 100, 1)]
    assert list(files.ranges([0, 10, 20], [10, 10, 10], 5, 20)) == [(0, 2, 0, 20), (2, 3, 20, 10)]
    assert warc.page_of(warc.record_id(-3)) == -3 and warc.page_of(warc.record_id(None)) is None
