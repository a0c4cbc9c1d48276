import pytest

from credsieve import scan
from credsieve.sinks.baseline import fingerprints, write_baseline
from credsieve.streaming.incremental import report_once, stream_findings, write_following, write_new

KEY = "AKIA" + "ABCDEFGHIJ12345"
SCHEMA = "file_path string, line_number int, content string, ts timestamp_ntz"


def rows(spark, *items):
    return spark.sql(
        "select * from values "
        + ", ".join(f"('{p}', {n}, '{c}', timestamp_ntz'2024-01-01 00:{n:02d}:00')" for p, n, c in items)
        + " as t(file_path, line_number, content, ts)"
    )


def test_only_new_lines_are_scanned(spark, tmp_path):
    src, out, log = (str(tmp_path / d) for d in ("src", "out", "log"))
    rows(spark, ("a.py", 1, KEY + "1"), ("a.py", 2, "nothing")).write.parquet(src)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    write_new(stream_findings(stream), out, log).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    rows(spark, ("b.py", 3, KEY + "2")).write.mode("append").parquet(src)
    write_new(stream_findings(stream), out, log).awaitTermination()
    got = spark.read.parquet(out)
    batch = scan(spark.read.parquet(src), mode="staged").findings
    assert got.count() == 2 and got.exceptAll(batch).count() == 0


def test_baseline_and_once(spark, tmp_path):
    src = str(tmp_path / "src")
    rows(spark, ("a.py", 1, KEY + "1"), ("a.py", 2, KEY + "1"), ("b.py", 3, KEY + "1")).write.parquet(src)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    known = fingerprints(scan(rows(spark, ("b.py", 1, KEY + "1"))).findings)
    found = report_once(stream_findings(stream, baseline=known, keep=["ts"]), "ts", "1 hour")
    write_new(found, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert [r.file_path for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a.py"]


def test_batch_tables_are_refused(spark):
    with pytest.raises(ValueError):
        stream_findings(rows(spark, ("a.py", 1, "x")))


def test_a_running_stream_follows_its_baseline(spark, tmp_path):
    src, out, log, base = (str(tmp_path / d) for d in ("src", "out", "log", "base"))
    rows(spark, ("a.py", 1, KEY + "1")).write.parquet(src)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    query = write_following(stream, base, out, log, trigger={"processingTime": "0 seconds"})
    try:
        query.processAllAvailable()
        assert [r.file_path for r in spark.read.parquet(out).collect()] == ["a.py"]
        write_baseline(scan(rows(spark, ("b.py", 1, KEY + "1"))).findings, base)
        rows(spark, ("b.py", 2, KEY + "1"), ("c.py", 3, KEY + "1")).write.mode("append").parquet(src)
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.file_path for r in spark.read.parquet(out).collect()) == ["a.py", "c.py"]
    # The last batch is repeated as if its commit had been lost.
    for name in ("commits/1", "commits/.1.crc"):
        (tmp_path / "log" / name).unlink(missing_ok=True)
    write_following(stream, base, out, log).awaitTermination()
    assert sorted(r.file_path for r in spark.read.parquet(out).collect()) == ["a.py", "c.py"]
