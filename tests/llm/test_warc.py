import gzip
import hashlib

from pyarrow import fs

from vecatlas.llm import warc
from vecatlas.llm.common import folder

HTML = ["<p>" + "a" * 200, None, "", "short", "short", "é" * 60, "<p>" + "a" * 200, "x" * 3_000_000, "<p>" + "a" * 200, "é" * 60]


def written(spark, **k):
    pages = spark.createDataFrame([(100 - i, f"http://h/{i}\r\nX: y" if i % 2 else None, h, "kind", 3) for i, h in enumerate(HTML)] + [(92, "twice", HTML[8], "k", 1), (None, "u", HTML[5], "k", 1)], "page_id long, url string, html string, kind string, offset int")
    place = folder(spark, "warc")
    return warc.write(warc.plan_records(pages), place, **k), place


def test_round_trip(spark):
    index, place = written(spark)
    rows = warc.read(index, place).collect()
    assert len(rows) == len(HTML) + 2
    for r in rows:
        html = (HTML[100 - r["page_id"]] or "").encode() if r["page_id"] is not None else HTML[5].encode()
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha256(html).hexdigest()
        assert r["payload"] == (html if r["record_type"] == "response" else None)
    revisits = sorted((r["page_id"] or 0, r["refers_to"]) for r in rows if r["record_type"] == "revisit")
    assert revisits == [(0, 91), (92, 92), (94, 92), (95, 91), (100, 92)]


def test_selected_records_in_few_reads(spark):
    index, place = written(spark, archive_bytes=2000)
    some = index.where("page_id in (99, 97, 93)")
    assert sorted(r["page_id"] for r in warc.read(some, place, gap=0, most=10).collect()) == [93, 97, 99]
    assert index.select("archive").distinct().count() > 1


def test_archives_are_gzip_members_in_a_row(spark):
    index, place = written(spark)
    store, path = fs.FileSystem.from_uri(place)
    for name in {r["archive"] for r in index.collect()}:
        with store.open_input_file(f"{path}/{name}") as f:
            text = gzip.decompress(f.read())
        n = index.where(index["archive"] == name).count()
        assert text.count(b"WARC/1.1\r\n") == n


def test_runs():
    got = list(warc._runs(iter([("a", 0, 5), ("a", 5, 5), ("a", 30, 5), ("b", 0, 1)]), 10, 100))
    assert got == [("a", 0, 10, [(0, 5), (5, 5)]), ("a", 30, 35, [(30, 5)]), ("b", 0, 1, [(0, 1)])]


def test_empty(spark):
    place = folder(spark, "warc")
    index = warc.write(warc.plan_records(spark.createDataFrame([], "page_id long, url string, html string")), place)
    assert warc.read(index, place).count() == 0


def reordered(frame):
    """The rows in another order at every scan, as when files are split in another way."""

    def run(batches):
        import os

        import pyarrow as pa

        whole = pa.Table.from_batches(list(batches))
        if whole.num_rows:
            yield from whole.take(sorted(range(whole.num_rows), key=lambda i: os.urandom(8))).to_batches()

    return frame.coalesce(1).mapInArrow(run, frame.schema)


def test_order_of_scans_does_not_matter(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "same" * 50 if i < 40 else f"own{i}" * 50) for i in range(80)], "page_id long, url string, html string")
    rows = warc.plan_records(reordered(pages)).collect()
    assert {r["page_id"]: (r["kind"], r["refers_to"]) for r in rows} == {i: ("revisit", 0) if 0 < i < 40 else ("response", None) for i in range(80)}
