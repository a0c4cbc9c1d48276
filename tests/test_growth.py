"""Work that grows with the tables is done once: lines are made once, and lines are searched once for documents."""

import json

import pytest
from pyspark.sql import functions as F

from credsieve.config import default_settings
from credsieve.operators.detectors import RegexDetector, may_hit
from credsieve.operators.diffs import added_lines
from credsieve.operators.summary import findings_view
from credsieve.plans import corpus as C
from credsieve.plans.scan import scan
from credsieve.sinks.json_report import report_documents
from credsieve.sinks.sarif import sarif_documents

KEYS = [(None, 3), (5, None), (None, None), (7, 7), (7, 7), (7, 7), (8, 7), (-5, 1), (-5, 1), (0, 0)]
KEYS += [(4 * i, i % 5) for i in range(60)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    orders = spark.createDataFrame(KEYS, "o_orderkey bigint, o_custkey bigint")
    orders.write.parquet(f"{root}/orders.parquet")
    return str(root), orders


def same(a, b):
    assert a.schema == b.schema
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_derived_lines_are_those_of_their_sql(spark, tables):
    root, orders = tables
    same(C.order_lines(spark, root), spark.sql(C.ORDER_LINES_SQL.replace("from orders", "from {o}"), o=orders))
    events = orders.selectExpr(
        "o_custkey as event_id", "'view' as event_type", "o_orderkey as user_id", "timestamp_seconds(o_custkey) as ts"
    )
    same(C.event_lines(events), spark.sql(C.EVENT_LINES_SQL.replace("from events", "from {e}"), e=events))


def test_diff_lines_are_those_of_their_sql(spark, tables):
    root, orders = tables
    sections = orders.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(C.DIFF_PARTS - 1))))
    same(C.diff_lines(spark, root), spark.sql(C.DIFF_LINES_SQL.replace("from sections", "from {s}"), s=sections))


def test_a_filter_does_not_make_a_line_again(spark, tables):
    rules = [RegexDetector(default_settings().rules)]
    found = C.order_lines(spark, tables[0]).filter(may_hit(rules, F.col("content")))
    assert plan(found).count("md5(") == 4


def test_orders_and_not_diff_lines_are_numbered(spark, tables):
    text = plan(C.diff_lines(spark, tables[0]))
    assert text.index("Generate explode") < text.index("Window [")


def test_documents_search_the_lines_once(lines):
    run = scan(lines(("a.py", 1, "key = AKIA" + "IOSFODNN7EXAMPL2"), ("b.py", 4, "nothing")), target="t")
    for documents in (sarif_documents(run), report_documents(run)):
        assert "hit_pos" not in plan(documents)
    counts = json.loads(report_documents(run).first()["value"])["summary"]
    assert counts == run.summary.select(*counts).first().asDict()
    assert counts["total"] == 1 and counts["scanned_lines"] == 2


def test_a_clean_scan_still_gives_one_document(lines):
    run = scan(lines(("a.py", 1, "nothing")))
    assert json.loads(report_documents(run).first()["value"])["findings"] == []
    assert [json.loads(r["value"])["runs"][0]["results"] for r in sarif_documents(run).collect()] == [[]]


def test_a_view_searches_the_lines_once(lines):
    run = scan(lines(("b.py", 2, "key = AKIA" + "IOSFODNN7EXAMPL2"), ("a.py", 1, "key = AKIA" + "IOSFODNN7EXAMPL3")))
    view = findings_view(run.matches)
    assert "hit_pos" not in plan(view)
    assert [(r["file"], r["line"]) for r in view.collect()] == [("a.py", 1), ("b.py", 2)]


def test_lines_of_few_partitions_are_made_by_many_tasks(spark, tables):
    _, orders = tables
    events = orders.coalesce(1).selectExpr(
        "o_custkey as event_id", "'view' as event_type", "o_orderkey as user_id", "timestamp_seconds(o_custkey) as ts"
    )
    assert C.event_lines(events).select(F.spark_partition_id()).distinct().count() > 1


def test_a_diff_of_one_block_is_read_once(spark):
    rows = [(d, n, raw) for d in range(3) for n, raw in enumerate(["diff --git a/x b/x", "@@ -1 +4 @@", "+a", " b", "-c", "+d"])]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(raw):
        read.add(1)
        return raw

    diffs = spark.createDataFrame(rows, "diff_id long, seq int, raw string").withColumn("raw", counted("raw"))
    found = added_lines(C.made_once(diffs, "raw")).collect()
    assert sorted((r.diff_id, r.line_number, r.content) for r in found) == [(d, *r) for d in range(3) for r in ((4, "a"), (6, "d"))]
    assert read.value == len(rows)


def test_long_diffs_hand_on_beside_short_ones_and_rows_without_a_key_are_left_out(spark):
    raws = ["diff --git a/x b/x", "@@ -1 +4 @@", "+a", "", "-c", "+d", "+++ /dev/null", "+e"]
    rows = [(1, n, r) for n, r in enumerate(raws)] + [(2, 0, raws[0]), (2, 1, "+z"), (None, 0, raws[0]), (None, 1, "+n"), (3, None, "+n")]
    diffs = spark.createDataFrame(rows, "diff_id long, seq int, raw string")
    for size in (1, 2, 3, 100):
        found = added_lines(diffs, block_lines=size).collect()
        assert sorted((r.diff_id, r.line_number, r.content) for r in found) == [(1, 4, "a"), (1, 6, "d"), (1, 7, "e"), (2, 1, "z")]


def test_patterns_are_constants_and_nothing_is_split(spark):
    lines = spark.createDataFrame([("x AKIA" + "A1" * 8 + " ghp_" + "a1B2" * 9,)], "content string")
    hits = lines.select(RegexDetector(default_settings().rules).hits(F.col("content")).alias("hits"))
    assert "split(" not in plan(hits) and "from_json" not in plan(hits)
    assert sorted((h.column_start, h.column_end) for h in hits.first().hits) == [(2, 22), (23, 63)]
