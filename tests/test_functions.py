import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from credsieve.functions.dialect import NoJvmForm, jvm_pattern
from credsieve.functions.entropy import BASE64, best_entropy, shannon_entropy, tokens
from credsieve.functions.masking import fingerprint, mask_secret, preview, redact_line, redact_spans
from credsieve.functions.paths import ignored_by, suffix
from credsieve.functions.runs import has_long_run
from credsieve.functions.severity import report_level, severity_rank
from credsieve.functions.spans import BLOCK, find_spans
from credsieve.rules import BUILTIN_RULES, IGNORED_GLOBS


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_mask_by_length(spark):
    values = ["", "AB", "ABCD", "ABCDE", "ABCDEFGHIJK", "ABCDEFGHIJKL", "x" * 36]
    got = column(spark, values, mask_secret)
    assert got == ["****", "****", "****", "ABCD***", "ABCD*******", "ABCD****IJKL", "xxxx" + "*" * 28 + "xxxx"]


def test_redact_line_and_bad_spans(spark):
    line = "key = abcdefghijklmnop end"
    spans = [(6, 22), (-1, 5), (5, 3), (0, 100), (4, 4)]
    df = spark.createDataFrame(spans, "s int, e int").withColumn("c", F.lit(line))
    got = [r[0] for r in df.select(redact_line(F.col("c"), F.col("s"), F.col("e"))).collect()]
    assert got == ["key = abcd********mnop end"] + [line] * 4


def test_redact_all_spans_merges_overlaps(spark):
    line = "😀 0123456789abcdef xx 0123456789abcdef!"
    spans = F.from_json(
        F.lit('[{"column_start":22,"column_end":38},{"column_start":2,"column_end":10},{"column_start":6,"column_end":18},{"column_start":-1,"column_end":3}]'),
        "array<struct<column_start:int,column_end:int>>",
    )
    got = column(spark, [line, ""], lambda c: redact_spans(c, spans))
    assert got == ["😀 0123********cdef xx 0123********cdef!", ""]
    assert column(spark, [line], lambda c: redact_spans(c, F.filter(spans, lambda s: F.lit(False)))) == [line]


def test_fingerprint(spark):
    want = hashlib.sha256(b"rule:a/b.py:ABCD****").hexdigest()[:16]
    got = column(spark, ["ABCD****"], lambda c: fingerprint(F.lit("rule"), F.lit("a/b.py"), c))
    assert got == [want]


def test_severity(spark):
    names = ["critical", "high", "medium", "low", "odd"]
    assert column(spark, names, severity_rank) == [4, 3, 2, 1, 0]
    assert column(spark, names, report_level) == ["error", "error", "warning", "note", "warning"]


def test_preview(spark):
    assert column(spark, ["  \tx y  ", "a" * 100], preview) == ["x y", "a" * 80]


def test_suffix(spark):
    paths = ["a/b.PNG", "a/.lock", "x.tar.gz", "Makefile", "a.b/c", "poetry.lock"]
    assert column(spark, paths, suffix) == [".png", "", ".gz", "", "", ".lock"]


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("**/*.env", ".env", True),
        ("**/*.env", "config/.env", True),
        ("*.test.ts", "src/app.test.ts", True),
        ("secrets/**", "src/config.py", False),
        ("docs/**/x.md", "other/x.md", True),
        ("docs/**/x.md", "x.md", True),
        ("src/[ab]?.py", "src/a1.py", True),
        ("src/[ab]?.py", "src/c1.py", False),
        ("**", "any/thing", True),
        ("tests/fixtures/*", "tests/fixtures/a/b.py", True),
    ],
)
def test_globs(spark, glob, path, hit):
    assert column(spark, [path], lambda c: ignored_by(c, [glob])) == [hit]


def test_default_globs(spark):
    paths = ["node_modules/a.js", "a/node_modules/b.js", "my_node_modules/b.js", "go.sum", "x/Cargo.lock", "src/vendor.py"]
    got = column(spark, paths, lambda c: ignored_by(c, IGNORED_GLOBS))
    assert got == [True, True, False, True, True, False]


@pytest.mark.parametrize("text, want", [("0123456789abcdef", 4.0), ("aaaaaaa", 0.0), ("", 0.0), ("aabb!!@@", 1.0)])
def test_entropy_values(spark, text, want):
    got = column(spark, [text], lambda c: shannon_entropy(c, BASE64))[0]
    assert got == pytest.approx(want, abs=1e-9)


def test_best_entropy_matches_formula(spark):
    values = ["Zx9Kq2Lm4Np6Rs8Tv0", "deadbeefcafe0123", "zz!!deadbeef", "ab-_.~cd"]

    def plain(text, allowed):
        kept = [c for c in text if re.match(f"[{allowed}]", c)]
        return -sum(n / len(kept) * math.log2(n / len(kept)) for n in Counter(kept).values()) if kept else 0.0

    got = column(spark, values, lambda c: best_entropy(c)["entropy"])
    for text, h in zip(values, got):
        assert h == pytest.approx(max(plain(text, "A-Za-z0-9+/="), plain(text, "0-9a-fA-F")), abs=1e-9)


def test_tokens_split_on_unicode_spaces(spark):
    text = "a bb ccc,'dd'=e/f\x1cgg 😀ü"
    got = column(spark, [text], tokens)[0]
    want = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\s'\"`,;(){}\[\]<>\\/=:]+", text)]
    assert [tuple(s) for s in got] == want


def test_spans_on_a_line_with_very_many_matches(spark):
    n = BLOCK * 3 + 7
    text = "".join(f"é{i:04d}x" for i in range(n))
    got = column(spark, [text], lambda c: find_spans(c, F.lit("[0-9]{4}"), False))[0]
    assert [(s.column_start, s.column_end) for s in got] == [(6 * i + 1, 6 * i + 5) for i in range(n)]


PATTERNS = [
    r"tok_[a-z]{6}",
    r"(?i)secret\s*=\s*['\"]([A-Z]{4,})['\"]",
    r"[]x[]+y",
    r"(?:a|bc)d{,2}e",
    r"\d+\w\S",
    r"^k(.{2})$",
    r"a.c",
    r"v(?=1)\d",
    r"{x}",
]
TEXTS = [
    "tok_abcdef tok_ghijkl",
    'SECRET = "ABCD" ſecret=\'efgh\' 😀 secret = "WXYZ"',
    "]x[y [y",
    "ade bcdde adddde ae",
    "12ab ٣xy 9é!",
    "kab",
    "a\rc a c a\nc",
    "v1 v2",
    "{x}{x}",
    r"\bx",
    r"x\b",
    r"\Bx\B|\b\w\w\b",
    "(a)(b)",
    "(?P<n>a)b",
    "((a)b)",
    "(?i:a)b",
    r"(?i:K(?-i:e))y",
]


def test_jvm_patterns_agree_with_python(spark):
    for pattern in PATTERNS:
        form = jvm_pattern(pattern)
        got = column(spark, TEXTS, lambda c: find_spans(c, F.lit(form.regex), form.grouped))
        g = 1 if form.grouped else 0
        want = [[(m.group(g), m.start(g), m.end(g)) for m in re.finditer(pattern, t)] for t in TEXTS]
        assert [[tuple(s) for s in row] for row in got] == want, pattern


@pytest.mark.parametrize("pattern", ["a*", "(a)+b", "(?=a)", "(?x)a b", "a|(b)", r"(a)\1", r"\b", r"x|\B"])
def test_patterns_without_jvm_form(pattern):
    with pytest.raises(NoJvmForm):
        jvm_pattern(pattern)


def test_built_in_rules_all_have_a_jvm_form():
    assert len(BUILTIN_RULES) == 35 and len({r.id for r in BUILTIN_RULES}) == 35
    for rule in BUILTIN_RULES:
        jvm_pattern(rule.pattern)


def test_search_hints_lose_no_match(spark):
    """Random matches of every rule pass the cheap tests that come before its pattern."""
    from hypothesis import HealthCheck, find, settings
    from hypothesis import strategies as st

    from credsieve.operators.detectors import RegexDetector, may_hit

    samples = []
    for rule in BUILTIN_RULES:
        strategy = st.lists(st.from_regex(rule.pattern, fullmatch=True), min_size=3, max_size=3)
        found = find(strategy, lambda _: True, settings=settings(suppress_health_check=list(HealthCheck), database=None))
        samples += [(rule.id, text) for text in found]
    samples.append(("generic-secret-assignment", "apiKey = 'aaaaaaaaaaaaaaaa'".replace("iKey", "i_Key")))
    df = spark.createDataFrame(samples, "id string, content string")
    detector = RegexDetector(BUILTIN_RULES)
    c = F.col("content")
    rows = df.select("id", "content", may_hit([detector], c).alias("may"), detector.hits(c).alias("hits")).collect()
    for r in rows:
        assert r.may, r
        assert r.id in {h.rule_id for h in r.hits}, r


def test_long_run(spark):
    texts = ["x" * 16, "a " + "b" * 16, "a b c", "x" * 15 + "=" + "x" * 15, "a/" * 8]
    assert column(spark, texts, lambda c: has_long_run(c, 16)) == [True, True, False, False, True]
