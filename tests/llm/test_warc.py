import base64
import hashlib

import pytest

from textguard.llm.warc import payload_digest, ranges, read, write


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)

    return make


ROWS = [
    (1, "http://a/", "<p>one</p>"),
    (2, "http://b/\r\nX: y", "<p>one</p>"),
    (3, None, ""),
    (4, "u", None),
    (5, "http://c/é", "ü\r\n\r\nWARC/1.1\r\n\r\n" * 50),
    (6, "http://d/", "x" * 300_000),
    (None, "http://e/", "<p>one</p>"),
    (2, "http://b/\r\nX: y", "<p>one</p>"),
]


def test_round_trip(pages, tmp_path):
    index = write(pages(ROWS), f"file://{tmp_path}/w")
    got = sorted(read(index).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert len(got) == len(ROWS)
    for row, r in zip(sorted(ROWS, key=lambda r: (r[0] is None, r[0])), got, strict=True):
        payload = (row[2] or "").encode()
        assert (r.page_id, r.payload_bytes, r.payload_digest) == (row[0], len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        first = min(i for i, _, h in ROWS if i is not None and (h or "") == (row[2] or ""))
        assert (r.record_type, r.refers_to) == (("response", None) if row[0] == first else ("revisit", first))
        assert bytes(r.block) == (payload if row[0] == first else b"")
    assert {r.url for r in got} == {"http://a/", "http://b/%0D%0AX: y", None, "u", "http://c/é", "http://d/", "http://e/"}


def test_selected_records_come_in_few_ranges(pages, tmp_path):
    index = write(pages([(k, f"u{k}", f"page {k} " * 50) for k in range(60)]), f"file://{tmp_path}/w").where("page_id % 3 = 0")
    assert sorted(r.page_id for r in read(index).collect()) == list(range(0, 60, 3))
    assert ranges(index, gap=1 << 20).count() <= 3 < ranges(index, gap=0).count()


def test_small_payloads_and_empty_table(pages, tmp_path):
    index = write(pages(ROWS), f"file://{tmp_path}/a", min_bytes=11)
    assert {r.record_type for r in read(index).collect()} == {"response"}
    assert read(write(pages(ROWS).limit(0), f"file://{tmp_path}/b")).count() == 0


def test_damage_is_noticed(pages, tmp_path):
    index = write(pages([(1, "u", "payload")]), f"file://{tmp_path}/w")
    row = index.first()
    path = row.archive.removeprefix("file://")
    from textguard.llm import warc

    data = warc.record_bytes(1, "u", b"PAYLOAD", payload_digest(b"payload"), None)
    import zlib

    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = pack.compress(data) + pack.flush()
    with open(path, "wb") as out:
        out.write(raw)
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="damaged record"):
        read(index.withColumn("length", F.lit(len(raw)).cast("bigint"))).collect()
