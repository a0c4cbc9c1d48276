"""Row shapes shared by the operators."""

from pyspark.sql import types as T

LINES = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("line_number", T.IntegerType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("commit_hash", T.StringType(), True),
        T.StructField("author", T.StringType(), True),
    ]
)

RULES = T.StructType(
    [
        T.StructField("rule_ord", T.IntegerType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("pattern", T.StringType(), False),
        T.StructField("severity", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
    ]
)

BASELINE = T.StructType([T.StructField("fingerprint", T.StringType(), True)])

DIFF_LINES = T.StructType(
    [
        T.StructField("diff_id", T.LongType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("raw", T.StringType(), False),
    ]
)

# A span found on a line: offsets are code points, 0-based, end-exclusive.
SPAN = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("column_start", T.IntegerType()),
        T.StructField("column_end", T.IntegerType()),
    ]
)

# One detector hit. ``raw_value`` never leaves the scan plan.
HIT = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("match_type", T.StringType()),
        T.StructField("raw_value", T.StringType()),
        T.StructField("column_start", T.IntegerType()),
        T.StructField("column_end", T.IntegerType()),
        T.StructField("engine_rank", T.IntegerType()),
        T.StructField("rule_ord", T.IntegerType()),
    ]
)

FINDING_COLUMNS = [
    "fingerprint",
    "rule_id",
    "rule_name",
    "severity",
    "match_type",
    "file_path",
    "line_number",
    "column_start",
    "column_end",
    "secret_masked",
    "line_preview",
    "scan_mode",
    "commit_hash",
    "author",
]

# Scan order within a result; replaces the stability of a sequential scan.
SCAN_ORDER = ["file_path", "line_number", "engine_rank", "rule_ord", "column_start"]
