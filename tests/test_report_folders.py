"""Reports written by tasks: bounded documents, an index, and nothing of what failed."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credsieve.config import Allowlist, default_settings
from credsieve.plans.scan import scan
from credsieve.sinks.folders import FolderWriter, read_folder
from credsieve.sinks.json_report import report_rows, write_json_report
from credsieve.sinks.sarif import log_rows, write_sarif

KEY, OTHER = "AKIA" + "QWERTYUIOPASDFGH", "sk_live_" + "a1B2c3D4e5F6g7H8i9J0k1L2"
BATCH = pa.RecordBatch.from_pydict(
    {
        "status": ["kept", "allowlist", "kept", "kept"],
        "severity": ["critical", "high", "high", "low"],
        "item": ['{"a": 1}', None, '{"a": 2}', '{"a": 3}'],
        "rule_id": ["x", "x", "x", "y"],
        "rule": ['{"id": "x"}', None, '{"id": "x", "later": 1}', '{"id": "y"}'],
    }
)


def folder(path, shape="json", overwrite=False):
    head = {"target": "t"} if shape == "json" else {"log": {"version": "2.1.0"}, "tool": {"name": "n"}, "properties": {"target": "t"}}
    return FolderWriter({"path": str(path), "shape": shape, "size": "2", "head": json.dumps(head)}, overwrite)


def index_of(path):
    return json.loads((path / "index.json").read_text())


def documents(path):
    return [json.loads((path / "documents" / d["name"]).read_text()) for d in index_of(path)["documents"]]


def test_a_repeated_task_is_listed_once(tmp_path):
    writer = folder(tmp_path)
    first, again = writer.write(iter([BATCH, BATCH])), writer.write(iter([BATCH, BATCH]))
    writer.commit([again, None])
    index = index_of(tmp_path)
    assert index["summary"] == {"total": 6, "critical": 2, "high": 2, "suppressed": 2} and index["parts"] == 3
    assert [[f["a"] for f in d["findings"]] for d in documents(tmp_path)] == [[1, 2], [3, 1], [2, 3]]
    assert len({d["part"] for d in documents(tmp_path)}) == 3
    assert not {n for n, _ in first.documents} & {d["name"] for d in index["documents"]}


def test_a_failed_task_and_an_aborted_job_leave_nothing(tmp_path):
    def broken():
        yield BATCH
        raise OSError("lost")

    writer = folder(tmp_path)
    with pytest.raises(OSError):
        writer.write(broken())
    done = writer.write(iter([BATCH]))
    writer.abort([done, None])
    assert list((tmp_path / "documents").iterdir()) == [] and not (tmp_path / "index.json").exists()


def test_a_report_is_replaced_only_when_asked(tmp_path):
    writer = folder(tmp_path)
    writer.commit([writer.write(iter([BATCH]))])
    with pytest.raises(ValueError):
        folder(tmp_path)
    writer = folder(tmp_path, overwrite=True)
    writer.commit([writer.write(iter([]))])
    assert documents(tmp_path) == [{"target": "t", "part": "none", "findings": []}] and index_of(tmp_path)["parts"] == 1
    assert len(list((tmp_path / "documents").iterdir())) == 1


def test_a_log_names_the_rules_of_its_own_results(tmp_path):
    writer = folder(tmp_path, "sarif")
    writer.commit([writer.write(iter([BATCH]))])
    runs = [d["runs"][0] for d in documents(tmp_path)]
    assert [r["tool"]["driver"]["rules"] for r in runs] == [[{"id": "x"}], [{"id": "y"}]]
    assert [r["properties"]["suppressedCount"] for r in runs] == [1, 0]


def test_reports_of_a_scan(spark, lines, tmp_path):
    settings = default_settings().with_(allowlist=Allowlist(patterns=("^sk_",)))
    rows = [(f"{c}.py", n, KEY if n % 2 else OTHER) for c in "ab" for n in range(1, 6)]
    s = scan(lines(*rows, ("c.py", 1, "nothing")), settings, target="repo")
    write_json_report(s, str(tmp_path / "json"), size=4)
    write_sarif(s, str(tmp_path / "sarif"), size=4)
    want = s.summary.select("total", "critical", "high", "suppressed", "scanned_files", "scanned_lines").first().asDict()
    assert index_of(tmp_path / "json")["summary"] == want and want["suppressed"] == 4
    found = [(f["file_path"], f["line_number"]) for d in documents(tmp_path / "json") for f in d["findings"]]
    assert sorted(found) == [(f"{c}.py", n) for c in "ab" for n in (1, 3, 5)]
    assert sum(d["runs"][0]["properties"]["suppressedCount"] for d in documents(tmp_path / "sarif")) == 4
    assert read_folder(spark, str(tmp_path / "sarif")).count() == index_of(tmp_path / "sarif")["parts"]
    assert KEY not in (tmp_path / "json").joinpath("documents", index_of(tmp_path / "json")["documents"][0]["name"]).read_text()


def test_lines_are_searched_once(lines):
    s = scan(lines(("a.py", 1, KEY)))
    for rows in (report_rows(s), log_rows(s)):
        plan = rows.withColumn("n", F.lit(1))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == 1


def test_a_clean_scan_gives_one_empty_document(lines, tmp_path):
    write_json_report(scan(lines(("a.py", 1, "x"))), str(tmp_path))
    assert [d["findings"] for d in documents(tmp_path)] == [[]] and index_of(tmp_path)["summary"]["scanned_lines"] == 1
