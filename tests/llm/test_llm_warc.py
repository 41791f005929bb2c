import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanloom.llm import warc
from spanloom.session import scratch

SCHEMA = "page_id bigint, url string, html string"


def plain(rows, least=100):
    first = {}
    for i, _, html in rows:
        first.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        data, ids = (html or "").encode(), first[html or ""]
        head = min((j for j in ids if j is not None), default=None)
        again = len(data) >= least and i != head
        show = lambda x: None if x is None else str(x)
        out.append((show(i), "revisit" if again else "response", show(head) if again else None, len(data), hashlib.sha256(data).hexdigest(), None if again else html or ""))
    return sorted(out, key=str)


def written(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"_id": F.lit(1), "_digest": F.lit("x"), "file": F.lit(2), "_first": F.lit(3), "_salt": F.lit(1)})
    folder = scratch(spark, "warc-test")
    return warc.write_archives(df, folder, **options), folder


def read(index, folder, **options):
    rows = warc.read_records(index, folder, **options).collect()
    return sorted(((r.record_key, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in rows), key=str)


ROWS = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * 30) for i in range(40)]
EDGES = [(50, None, None), (51, "u", ""), (52, "http://h/a b\r\nX: y", "é" * 49), (53, "v", "é" * 49), (54, "v", "é" * 50), (55, "v", "é" * 50), (None, "n", "é" * 50), (None, "n", "only null " * 20), (56, "w", "a\r\n\r\nb" * 40), (57, "same", "again " * 30), (57, "same", "again " * 30), (58, "", "again " * 30)]


@pytest.mark.parametrize("options", [{}, {"gap": 0, "block": 500}, {"gap": 1 << 30, "block": 1 << 30}])
def test_round_trip(spark, options):
    index, folder = written(spark, ROWS + EDGES)
    assert read(index, folder, **options) == plain(ROWS + EDGES)


def test_hot_payload_and_small_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_COUNT", 5)
    rows = [(900 - i, f"u{i}", "hot payload " * 20 if i % 3 else f"own {i} " * 30) for i in range(300)]
    index, folder = written(spark, rows, file_bytes=2000)
    assert read(index, folder) == plain(rows)
    assert index.select("file").distinct().count() > 10


def test_selected_records_by_ranges(spark):
    index, folder = written(spark, ROWS)
    chosen = index.filter("record_key IN ('3', '4', '17')")
    assert [r[0] for r in read(chosen, folder)] == ["17", "3", "4"]
    near = warc.byte_ranges(index, gap=0).agg(F.sum("size"), F.count("*")).first()
    size = sum(p.stat().st_size for p in Path(folder.removeprefix("file:"), "archives").glob("*.warc.gz"))
    assert near[0] == size and near[1] == index.select("file").distinct().count()
    assert warc.byte_ranges(index.union(index), gap=0).agg(F.sum(F.size("records"))).first()[0] == len(ROWS)


def test_archives_are_warc(spark):
    index, folder = written(spark, [(1, "http://h/", "body " * 30), (2, "http://i/", "body " * 30)])
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(folder.removeprefix("file:"), "archives").glob("*.warc.gz"))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.count(b"body body") and data.endswith(b"\r\n\r\n")
    assert b"WARC-Type: revisit" in data and b"WARC-Refers-To: <urn:x-row:1>" in data and data.count(b"Content-Length: 150\r\n") == 2
    url = index.select("record_key", "url", "payload_digest").orderBy("record_key").collect()
    assert [r.url for r in url] == ["http://h/", "http://i/"] and url[0].payload_digest == hashlib.sha256(b"body " * 30).hexdigest()


def test_damage_is_seen():
    data = warc.record_bytes("1", "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False, "2020-01-01T00:00:00Z")
    assert warc.parse_record(data)[-1] == "payload"
    with pytest.raises(ValueError, match="does not match"):
        warc.parse_record(data.replace(b"payload\r", b"paylOad\r"))


def test_empty_table_and_very_long_payload(spark):
    index, folder = written(spark, [])
    assert read(index, folder) == []
    rows = [(1, "u", "long " * 2_000_000), (2, "v", "long " * 2_000_000)]
    assert read(*written(spark, rows)) == plain(rows)
