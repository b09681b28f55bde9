import base64
import hashlib
import io
import random

import pytest
import zstandard
from frames import rows
from pyspark.sql import functions as F

from pagesift.llm import warc

SCHEMA = "page_id bigint, url string, html string"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute(pages, least=0):
    groups = {}
    for p, _, html in pages:
        groups.setdefault(html or "", []).append(p)
    out = []
    for p, _, html in pages:
        data = (html or "").encode()
        ids = [i for i in groups[html or ""] if i is not None]
        first = max(ids) if ids and len(data) >= least else p
        revisit = p != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((p, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


PAGES = [(1, "u1", "aé"), (2, "u\r\nX: y%", "aé"), (3, None, None), (4, "", ""), (5, "u5", "WARC/1.1\r\n\r\n"), (6, "u6", "z" * 900_000),
         (7, "u6", "z" * 900_000), (7, "u6", "z" * 900_000), (None, "u", "lonely"), (None, "u", "aé"), (8, "ü", "\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, SCHEMA).withColumns({"k": F.lit(1), "first": F.lit(2), "refers_to": F.lit(3)})
    bundles = warc.write_bundles(pages, least_bytes=least, frame_bytes=1000, bundle_bytes=5000)
    found = warc.read_bundles(bundles)
    assert rows(found, *COLUMNS) == brute(PAGES, least)
    assert {r.url for r in found.collect()} >= {"u%0D%0AX: y%25", "", "ü"}


def test_bundle_is_an_ordinary_stream_with_a_seek_table(spark):
    rng = random.Random(1)
    pages = [(i, f"http://x/{i}", "".join(rng.choice("abc<>") for _ in range(rng.randint(0, 3000)))) for i in range(200)]
    made = warc.write_bundles(spark.createDataFrame(pages, SCHEMA), frame_bytes=4000, bundle_bytes=20_000).collect()
    seen = {}
    for row in made:
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(row.bundle), read_across_frames=True).read()
        table = warc.seek_table(row.bundle)
        assert sum(size for _, _, size in table) == len(plain)
        starts = [0]
        for *_, size in table:
            starts.append(starts[-1] + size)
        for r in row.records:
            begin = starts[r.frame] + r.offset
            record, end = warc.read_record(plain, begin)
            assert end - begin == r.length and record.headers["WARC-Record-ID"] == r.record_id
            seen[warc.page_of(r.record_id)] = record.block.decode()
    assert seen == {i: html for i, _, html in pages if html} | {i: "" for i, _, html in pages if i in seen and not html}


def test_fetch_reads_single_records(spark):
    bundles = warc.write_bundles(spark.createDataFrame(PAGES[:6], SCHEMA), frame_bytes=50, bundle_bytes=300)
    wanted = spark.createDataFrame([(warc.record_id(5),), (warc.record_id(1),), (warc.record_id(99),)], "record_id string")
    got = {r.record_id: warc.read_record(r.warc)[0] for r in warc.fetch(bundles, wanted).collect()}
    assert set(got) == {warc.record_id(5), warc.record_id(1)}
    assert got[warc.record_id(5)].block == b"WARC/1.1\r\n\r\n" and got[warc.record_id(1)].headers["WARC-Type"] == "revisit"


def test_damage_is_seen(spark):
    bundle, index = warc.Bundler(), [{"record_id": warc.record_id(1), "frame": 0, "offset": 0}]
    record = warc.write_record(1, "u", b"payload", None, False).replace(b"payload\r\n", b"Payload\r\n")
    bundle.add(warc.record_id(1), record)
    with pytest.raises(ValueError, match="damaged"):
        warc._records(bundle.done()[0], [{**index[0], "length": len(record)}])
    with pytest.raises(ValueError, match="seek table"):
        warc.seek_table(b"x" * 100)


def test_empty_table_and_whole_table(spark):
    assert warc.read_bundles(warc.write_bundles(spark.createDataFrame([], SCHEMA))).isEmpty()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert rows(warc.read_bundles(warc.write_bundles(pages)), *COLUMNS) == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
