import hashlib

from pyspark.sql import functions as F

from fleetwatch.llm import warc_bundles

from .conftest import SMALL, prose

SCHEMA = "page_id long, url string, html string"


def _digest(df):
    return sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in df.collect()), key=str)


def test_round_trip_of_a_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    bundles = warc_bundles.write(pages)
    back = warc_bundles.read(bundles)
    want = {str(r.page_id): (r.url, r.html) for r in pages.collect()}
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in back.collect()}
    assert got == want
    wanted = warc_bundles.record_index(bundles).where("length % 3 = 0")
    records = {r.record_id: bytes(r.record) for r in warc_bundles.fetch(bundles, wanted).collect()}
    lengths = {r.record_id: r.length for r in wanted.collect()}
    assert {k: len(v) for k, v in records.items()} == lengths and lengths
    for data in records.values():
        (head, payload), = warc_bundles.parse(data)
        assert want[head["x-page-id"]][1].encode() == payload


def test_revisits_nulls_ties_and_short_payloads(docs):
    long = prose(40)
    rows = [(5, "u5", long), (3, "u3", long), (9, "u\r\n9 x", long), (1, None, "short"), (2, "v", "short"), (4, "w", None), (None, "n", ""), (None, "n", long), (7, "x", long + "!"), (7, "y", long + "!"), (7, "y", long + "!")]
    bundles = warc_bundles.write(docs(rows, SCHEMA).repartition(3))
    back = warc_bundles.read(bundles)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = []
    for i, _, t in rows:
        n = len((t or "").encode())
        revisit = t == long and i != 3
        want.append([str(i) if i is not None else None, "revisit" if revisit else "response", "3" if revisit else None, n, sha(t)])
    for r in [r for r in want if r[0] == "7"][1:]:
        r[1:3] = ["revisit", "7"]
    assert _digest(back) == sorted(map(tuple, want), key=str)
    ids = [r.record_id for r in warc_bundles.record_index(bundles).collect()]
    assert len(ids) == len(rows) and len(set(ids)) == len(ids) - 0
    assert back.where(F.col("url").contains("%0D%0A")).count() == 1


def test_seek_table_and_frames():
    writer = warc_bundles.BundleWriter()
    records = {f"r{k}": (b"%d" % k) * (50_000 + k) for k in range(20)}
    for k, v in records.items():
        writer.add(k, v)
    data = writer.finished()
    table = warc_bundles.seek_table(data)
    assert len(table) > 1
    for name, f, at, n in writer.index:
        assert warc_bundles.frame(data, table[f])[at: at + n] == records[name]
    import zstandard
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # other readers skip the table
    assert plain == b"".join(records.values())
    assert warc_bundles.seek_table(warc_bundles.BundleWriter().finished()) == []


def test_empty_table(docs):
    assert warc_bundles.read(warc_bundles.write(docs([], SCHEMA))).count() == 0


def test_every_record_has_an_identifier_of_its_own(docs):
    """Repeated rows with short payloads, too; each is fetched by its own."""
    rows = [(1, "u", "short"), (1, "u", "short"), (1, "v", "short"), (2, "u", None), (2, "u", None), (None, None, ""), (3, "u", "long " * 50), (3, "u", "long " * 50), (4, "w", "long " * 50)]
    bundles = warc_bundles.write(docs(rows, "page_id long, url string, html string").repartition(3))
    index = warc_bundles.record_index(bundles)
    assert index.count() == index.select("record_id").distinct().count() == len(rows)
    got = {r.record_id: bytes(r.record) for r in warc_bundles.fetch(bundles, index).collect()}
    assert len(got) == len(rows) and all(k.encode() in v for k, v in got.items())
    back = {r.record_id: r.payload for r in warc_bundles.read(bundles).collect()}
    assert back.keys() == got.keys()
