import json

import pytest
from pyspark.sql import functions as F

from credsieve import Allowlist, EntropySettings, RegexRule, ScanSettings, SettingsError, default_settings, scan, user_settings
from credsieve.config import merge_settings
from credsieve.functions.masking import mask_secret
from credsieve.operators.detectors import RegexDetector, detectors_for
from credsieve.operators.summary import SecretsFound, assert_clean, findings_view, first_per_rule, gate, rule_activity
from credsieve.sinks.baseline import baseline_documents, write_baseline
from credsieve.sinks.json_report import finding_json, report_documents, write_findings
from credsieve.sinks.sarif import sarif_documents
from credsieve.sources.baseline import read_baseline, read_baseline_table
from credsieve.sources.rules import merge_rules, rules_from_table, rules_table

KEY = "AKIA" + "IOSFODNN7EXAMPLE"
OTHER = "sk_" + "test_" + "A" * 24
MIXED = "Zx9Kq2Lm4Np6Rs8Tv0Wy1Ab3Cd5Ef7GhJj"
OFF = EntropySettings(enabled=False)


def rule(pattern, **kw):
    return RegexRule("t", "T", pattern, **kw)


def only(*rules, **kw):
    return ScanSettings(rules=tuple(rules), entropy=kw.pop("entropy", OFF), **kw)


def hits(lines, content, *rules, on_arrow=()):
    df = lines(("a.py", 1, content))
    found = df.select(RegexDetector(rules, on_arrow).hits(F.col("content")).alias("h")).first().h
    return [(h.raw_value, h.column_start, h.column_end) for h in found]


@pytest.mark.parametrize("on_arrow", [(), ("t",)])
def test_regex_cases(lines, on_arrow):
    def run(content, *rules):
        return hits(lines, content, *rules, on_arrow=on_arrow)

    assert run(f"key = {KEY}", rule("AKIA[A-Z0-9]{16}")) == [(KEY, 6, 26)]
    assert run("password = 'hunter2ab'", rule("password = '([a-z0-9]+)'")) == [("hunter2ab", 12, 21)]
    assert run("a=tok_aaaaaa b=tok_bbbbbb", rule("tok_[a-z]{6}")) == [("tok_aaaaaa", 2, 12), ("tok_bbbbbb", 15, 25)]
    assert run("prefix KEY1234 suffix", rule("KEY[0-9]{4}")) == [("KEY1234", 7, 14)]
    assert run("😀😀 KEY1234", rule("KEY[0-9]{4}")) == [("KEY1234", 3, 10)]
    assert run("", rule("KEY[0-9]{4}")) == []


def test_rules_without_jvm_form_run_on_arrow(lines):
    assert hits(lines, "x ab y", rule("(a)(b)")) == [("a", 2, 3)]
    assert hits(lines, "b", rule("(a)|(b)")) == [("b", 0, 1)]
    assert hits(lines, "id=42;", rule(r"\b\d+\b")) == [("42", 3, 5)]


@pytest.mark.parametrize(
    "content, entropy, n",
    [
        (f"x {MIXED}", EntropySettings(threshold=4.0), 1),
        ("plain prose of short words only", EntropySettings(threshold=4.0), 0),
        ("tok_abcd", EntropySettings(threshold=1.0), 0),
        ("A" * 300, EntropySettings(max_length=50), 0),
        ("a" * 40, EntropySettings(), 0),
        (f"x {MIXED}", OFF, 0),
        ("0123456789abcdef0123456789abcdef", EntropySettings(threshold=4.0), 1),
        (MIXED + "é" * 300, EntropySettings(threshold=4.0), 0),
    ],
)
def test_entropy_cases(lines, content, entropy, n):
    found = scan(lines(("a.py", 1, content)), only(entropy=entropy)).findings.collect()
    assert len(found) == n and all(f.match_type == "entropy" for f in found)


def test_overlap_keeps_the_rule(lines):
    settings = only(rule("AKIA[A-Z0-9]{16}"), entropy=EntropySettings(threshold=3.0, min_length=10))
    found = scan(lines(("a.py", 1, f"k {KEY} and {MIXED}")), settings).findings.collect()
    assert sorted((f.match_type, f.column_start) for f in found) == [("entropy", 27), ("regex", 2)]


def test_allowlisted_hit_counts_as_suppressed_and_still_blocks_entropy(lines):
    settings = only(
        rule("AKIA[A-Z0-9]{16}"),
        entropy=EntropySettings(threshold=3.0, min_length=10),
        allowlist=Allowlist(patterns=("EXAMPLE$",)),
    )
    s = scan(lines(("a.py", 1, KEY)), settings)
    assert s.findings.count() == 0
    assert (s.summary.first().suppressed, s.summary.first().total) == (1, 0)


def test_allowlist_searches_anywhere(lines):
    content = "tok_aaaaaa tok_bbbbbb tok_cccccc"
    for patterns, kept in [(("^tok_a",), 2), (("b+",), 2), (("x",), 3), (("(a)(a)", "c$"), 1)]:
        settings = only(rule("tok_[a-z]{6}"), allowlist=Allowlist(patterns=patterns))
        assert scan(lines(("a.py", 1, content)), settings).findings.count() == kept


def test_ignored_paths_and_counts(lines):
    df = lines(("tests/fixtures/a.py", 1, KEY), ("src/a.py", 1, "x"), ("src/b.py", 1, KEY), ("src/b.py", 2, ""))
    s = scan(df, only(rule("AKIA[A-Z0-9]{16}"), ignore_paths=("tests/fixtures/*",)), target="t")
    row = s.summary.first()
    assert (row.total, row.scanned_files, row.scanned_lines, row.suppressed, row.target) == (1, 2, 4, 0, "t")
    assert s.findings.first().file_path == "src/b.py"


def test_finding_fields_and_previews(lines):
    content = f"a {KEY} b {OTHER}"
    s = scan(lines(("src/a.py", 7, content)), default_settings())
    found = {f.rule_id: f for f in s.findings.collect()}
    assert set(found) == {"aws-access-key-id", "stripe-secret-key"}
    aws = found["aws-access-key-id"]
    assert (aws.line_number, aws.column_start, aws.column_end, aws.severity) == (7, 2, 22, "critical")
    assert OTHER in aws.line_preview and KEY not in aws.line_preview
    for f in s.safe_findings.collect():
        assert KEY not in f.line_preview and OTHER not in f.line_preview
    assert "raw_value" not in s.matches.columns and "content" not in s.matches.columns


def test_settings_are_checked_and_merged():
    with pytest.raises(SettingsError):
        rule("a", severity="urgent")
    with pytest.raises(SettingsError):
        rule("(")
    for bad in ({"min_length": 7}, {"threshold": 0.5}, {"threshold": 9}, {"max_length": 19}):
        with pytest.raises(SettingsError):
            EntropySettings(**bad)
    with pytest.raises(SettingsError):
        Allowlist(patterns=("[",))
    got = user_settings({
        "rules": [{"id": "jwt-token", "name": "J", "pattern": "eyJ", "severity": "LOW", "odd": 1}, {"id": "new", "name": "N", "pattern": "n"}],
        "entropy": {"threshold": 5.0, "min_len": 3},
        "allowlist": {"paths": ["p/*"]},
        "ignore_paths": ["q/*"],
        "baseline_file": "b.json",
    })
    ids = [r.id for r in got.rules]
    assert ids.index("jwt-token") == [r.id for r in default_settings().rules].index("jwt-token")
    assert ids[-1] == "new" and got.rules[-1].severity == "high"
    assert got.rules[ids.index("jwt-token")].severity == "low"
    assert got.entropy == EntropySettings(threshold=5.0)
    assert got.ignored_globs[0] == "p/*" and got.ignored_globs[-1] == "q/*"
    assert merge_settings(got, ScanSettings()).baseline_file == "b.json"
    assert user_settings(None) == default_settings()


def test_rule_tables_merge_like_settings(spark):
    user = [RegexRule("b", "B2", "b+"), RegexRule("z", "Z", "z+"), RegexRule("z", "Z2", "z")]
    base = [RegexRule("a", "A", "a"), RegexRule("b", "B", "b"), RegexRule("c", "C", "c")]
    merged = rules_from_table(merge_rules(rules_table(spark, base), rules_table(spark, user)))
    assert [(r.id, r.name) for r in merged] == [("a", "A"), ("b", "B2"), ("c", "C"), ("z", "Z2")]
    with pytest.raises(SettingsError):
        rules_from_table(rules_table(spark, []))


def test_baseline_files(spark, tmp_path):
    def read(name, text):
        (tmp_path / name).write_text(text)
        return sorted(r[0] for r in read_baseline(spark, str(tmp_path / name)).collect())

    assert read("o.json", json.dumps({"version": 1, "fingerprints": ["b", "a", "a"]}, indent=2)) == ["a", "b"]
    assert read("l.json", '["x", "y"]') == ["x", "y"]
    assert read("bad.json", "{not json") == []
    assert read_baseline(spark, str(tmp_path / "none.json")).count() == 0


def test_baseline_round_trip(spark, lines, tmp_path):
    df = lines(("a.py", 1, KEY), ("b.py", 1, f"{KEY} {OTHER}"))
    first = scan(df)
    for name, table, read in (("doc", False, read_baseline), ("tab", True, read_baseline_table)):
        path = str(tmp_path / name)
        write_baseline(first.findings, path, table=table)
        again = scan(df, baseline=read(spark, path))
        assert again.findings.count() == 0
        assert again.summary.first().suppressed == 3
    configured = scan(df, default_settings().with_(baseline_file=str(tmp_path / "doc")))
    assert configured.findings.count() == 0
    docs = [json.loads(r.value) for r in baseline_documents(first.findings, size=2).collect()]
    assert sum(len(d["fingerprints"]) for d in docs) == 3 and max(len(d["fingerprints"]) for d in docs) <= 2


def test_gate(lines):
    dirty, clean = scan(lines(("a.py", 1, KEY))).summary, scan(lines(("a.py", 1, "x"))).summary
    assert tuple(gate(dirty).first()) == (True, 1)
    assert tuple(gate(dirty, fail_on_findings=False).first()) == (True, 0)
    assert tuple(gate(clean).first()) == (False, 0)
    assert_clean(clean)
    with pytest.raises(SecretsFound):
        assert_clean(dirty)


def test_views(spark, lines):
    s = scan(lines(("b.py", 1, "twilio AC" + "0" * 32), ("a.py", 2, KEY), ("a.py", 1, KEY)))
    view = findings_view(s.matches).collect()
    assert [(r.severity, r.file, r.line) for r in view] == [("CRITICAL", "a.py", 1), ("CRITICAL", "a.py", 2), ("MEDIUM", "b.py", 1)]
    assert "•" in view[0].secret and "*" not in view[0].secret
    first = {r.rule_id: r for r in first_per_rule(s.matches).collect()}
    assert (first["aws-access-key-id"].line_number, first["aws-access-key-id"].findings) == (1, 2)
    activity = {r.id: r for r in rule_activity(rules_table(spark, [rule("x"), *default_settings().rules]), s.matches).collect()}
    assert activity["t"].description == "—" and activity["t"].hits == 0
    assert activity["twilio-account-sid"].findings == 1


def test_json_reports(lines, tmp_path, spark):
    s = scan(lines(("a.py", 1, f"{KEY} {OTHER}"), ("b.py", 1, KEY)), target="repo")
    docs = [json.loads(r.value) for r in report_documents(s, size=2).collect()]
    assert all(d["summary"]["total"] == 3 and d["target"] == "repo" for d in docs)
    assert sum(len(d["findings"]) for d in docs) == 3
    assert "commit_hash" in docs[0]["findings"][0] and docs[0]["generated_at"].endswith("+00:00")
    clean = [json.loads(r.value) for r in report_documents(scan(lines(("a.py", 1, "x")))).collect()]
    assert len(clean) == 1 and clean[0]["findings"] == [] and clean[0]["summary"]["scanned_lines"] == 1
    write_findings(s, str(tmp_path / "f"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "f")).collect())
    assert KEY not in text and OTHER not in text
    assert len(json.loads(finding_json(s.findings).first().value)) == 14


def test_sarif(lines):
    s = scan(lines(("a.py", 5, "0123456789" + KEY), ("b.py", 1, f"{KEY} {OTHER}")), target="repo")
    docs = [json.loads(r.value) for r in sarif_documents(s).collect()]
    assert len(docs) == 1 and docs[0]["version"] == "2.1.0" and "$schema" in docs[0]
    run = docs[0]["runs"][0]
    first = run["results"][0]
    assert first["level"] == "error" and "credsieve/v1" in first["fingerprints"]
    region = first["locations"][0]["physicalLocation"]["region"]
    assert (region["startLine"], region["startColumn"]) == (5, 11)
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["aws-access-key-id", "stripe-secret-key"]
    assert KEY not in json.dumps(docs) and OTHER not in json.dumps(docs)
    assert run["properties"] == {"scanMode": "working_tree", "target": "repo", "suppressedCount": 0}
    clean = [json.loads(r.value) for r in sarif_documents(scan(lines(("a.py", 1, "x")))).collect()]
    assert len(clean) == 1 and clean[0]["runs"][0]["results"] == []


def test_mode_is_checked(lines):
    with pytest.raises(ValueError):
        scan(lines(("a", 1, "x")), mode="other")


def test_empty_settings_find_nothing(lines):
    assert detectors_for(only()) == []
    assert scan(lines(("a", 1, KEY)), only()).summary.first().total == 0
