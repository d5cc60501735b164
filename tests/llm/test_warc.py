import gzip

from pyspark.sql import functions as F

from kindred.llm import warc as W

from .oracle import assert_equal


def test_sql(spark):
    assert_equal(spark, "op5_warc", "/root/testdata/sf0.01")


def test_ids():
    for i in (0, 1, -1, 2**62, 2**63 - 1, -(2**63), None, 12345678901):
        for turn in (0, 3, 2**40):
            assert W.page_of(W.record_id(i, turn)) == i


ROWS = [(5, "u5", "same"), (2, "u2", "same"), (9, None, None), (8, "u8", ""), (3, "u\r\n3", "é日本" * 4000), (4, "u4", "x\r\n\r\ny\x00"), (7, "u7", "same"), (7, "u7", "same"), (6, "a", "p"), (6, "b", "q"), (6, "c", "p"), (None, "n", "same"), (-1, "neg", "neg")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int")
    man = W.write(df, f"file://{tmp_path}/a", file_bytes=300)
    files = [r.file for r in man.collect()]
    assert len(files) > 1 and man.agg(F.sum("n_records")).first()[0] == len(ROWS)
    got = W.read(spark, man).collect()
    assert len(got) == len(ROWS)
    by = {(r.page_id, r.url): r for r in got}
    assert by[2, "u2"].record_type == "response" and by[5, "u5"].refers_to == 2 and by[5, "u5"].payload_bytes == 4
    assert all(r.refers_to == 2 for r in got if r.page_id == 7) and by[None, "n"].record_type == "response"
    assert by[9, ""].refers_to == 8 and by[8, "u8"].payload_digest == W.base32_sha1(b"")
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id == 6) == [("response", None), ("response", None), ("revisit", 6)]
    assert bytes(by[3, "u%0D%0A3"].payload).decode() == ROWS[4][2] and bytes(by[4, "u4"].payload) == b"x\r\n\r\ny\x00"
    again = W.write(df.repartition(3), f"file://{tmp_path}/b", file_bytes=300)
    name = lambda m: sorted((r.file.rpartition("/")[2], r.sha1) for r in m.collect())
    assert name(man) == name(again)
    assert gzip.decompress(open(files[0].removeprefix("file://"), "rb").read()).startswith(b"WARC/1.1\r\n")
    assert all(r.record_type == "response" for r in W.read(spark, W.write(df.where("page_id = 5 or page_id = 2"), least_bytes=5)).collect())


def test_the_same_pages_give_the_same_bytes(spark, monkeypatch):
    """Far above what range partitioning would sample, from three partitionings and batch sizes; ids in clumps, so that
    buckets are summed again by finer ones."""
    monkeypatch.setattr(W, "RANGE_BYTES", (1 << 18, 1 << 20))
    monkeypatch.setattr(W, "BUCKET_BITS", 5)
    df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.col("id") * 7).otherwise(F.col("id") + 10**15).alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("page "), F.col("id") % 5000).alias("html"))
    files = []
    try:
        for parts, batch in ((8, 10_000), (3, 100), (13, 777)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            man = W.write(df.repartition(parts, F.rand(parts)), file_bytes=1 << 19).collect()
            files.append(sorted((r.file.rpartition("/")[2], r.n_records, r.sha1) for r in man))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert files[0] == files[1] == files[2] and len(files[0]) > 20 and sum(n for _, n, _ in files[0]) == 60_000
    starts = W.range_starts(df)
    assert (starts[1:] > starts[:-1]).all() and starts[-1] > 10**15


def test_empty(spark):
    assert W.written_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_cut_archives_raise(tmp_path):
    import pytest

    whole = gzip.compress(b"one") + gzip.compress(b"two" * 50)
    (tmp_path / "a").write_bytes(whole)
    assert list(W.records(str(tmp_path / "a"))) == [b"one", b"two" * 50]
    for n in (len(whole) - 1, len(whole) - 12, len(gzip.compress(b"one")) + 4):
        (tmp_path / "b").write_bytes(whole[:n])
        with pytest.raises(ValueError, match="cut off"):
            list(W.records(str(tmp_path / "b")))
