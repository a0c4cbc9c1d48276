"""Inputs for the registered queries, all derived from the given tables.

The text tables hold almost no credentials, so lines that look like source code are derived from
``orders``: every row gives one line, filled from the MD5 of its key. The expressions are plain
SQL that Spark and other engines read alike, and no template holds a whole credential.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credsieve.sources.texts import lines_from_text

TABLES = ("documents", "pages", "conversations", "orders", "events", "labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived lines ---------------------------------------------------------------------------


# Line templates. <A36> stands for 36 letters and digits, <A36@40> for others starting at 40, <C16>
# for capitals, <D11> and <E12> for digits, <X32> for hex, <M> for a mixed token, <K> for the key,
# <Q> for a single quote and <N> for a no-break space.
TEMPLATES = [
    "aws_key = AKIA<C16>",
    "AWS_SECRET_ACCESS_KEY = <A40>",
    "t=ghp_<A36>",
    "t=github_pat_<A82>",
    "t=gho_<A36> gho_<A36@40>",
    "t=ghs_<A36>",
    "t=ghr_<A36>",
    "stripe: sk_live_<A24>",
    "stripe: pk_test_<A30>",
    "stripe: rk_live_<A26>;",
    "g: AIza<A35>",
    "g: GOCSPX-<A28>",
    "slack xoxb-<D11>-<E12>-<A24>",
    "slack xoxp-<D11>-<E12>-<D12>-<A32>",
    "slack xapp-1-<C11>-<D13>-<A64>",
    "post https://hooks.slack.com/services/T<C8>/B<C8>/<A24>",
    "twilio SK<X32>",
    "twilio AC<X32>",
    "mail SG.<A22>.<A43@30>",
    "mail key-<A32>",
    "reg npm_<A36>",
    "reg pypi-<A80>",
    "vault hvs.<A28>",
    "jwt eyJ<A9>.eyJ<A9@20>.<A6@40>",
    "-----BEGIN RSA PRIVATE KEY-----",
    "-----BEGIN EC PRIVATE KEY-----",
    "-----BEGIN OPENSSH PRIVATE KEY-----",
    "-----BEGIN PRIVATE KEY-----",
    "url: postgresql://app:<A12>@db<K>.example.com/x",
    "url: mysql://app:<A12>@db<K>.example.com/x",
    "url: mongodb+srv://app:<A12>@db<K>.example.com/x",
    "url: redis://:<A12>@db<K>.example.com/x",
    'api_key = "<A20>"',
    "Authorization: Bearer <A30>",
    "url: https://bob:<A12>@db<K>.example.com/x",
    "two: AKIA<C16> and sk_test_<A24@3>",
    "blob <M> end",
    "😀 at AKIA<C16> ünd <M>",
    "password: <Q><M><Q>",
    "sample AKIA<C9>EXAMPLE",
    "Authorization:<N>bearer<N><A24>",
    'token = "<X40>"',
    'Secret="<A18>", Auth-Token : "<A22@5>"',
    "hex <X64> done",
    "nothing to see on line <K>",
    "",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa <K>",
    "path/to/<X10>/file.txt, short tok_<A6@3>",
]


def _fill_sql(mark: str) -> str:
    fixed = {"<K>": "k", "<M>": "mixed", "<Q>": "chr(39)", "<N>": "chr(160)"}
    if mark in fixed:
        return fixed[mark]
    column = {"A": "alnum", "C": "upper(h0)", "D": "d0", "E": "d1", "X": "concat(h0, h2)"}[mark[1]]
    length, _, start = mark[2:-1].partition("@")
    return f"substring({column}, {start or 1}, {length})"


def with_line_sql(source: str, key: str) -> str:
    """``source`` plus a column ``line``: a template chosen and filled by the key."""
    hashes = ", ".join(f"md5(concat(cast({key} as string), '{s}')) as h{i}" for i, s in enumerate("abcd"))
    cases = " ".join(f"when {i} then '{t}'" for i, t in enumerate(TEMPLATES))
    hashed = (
        f"select *, cast({key} as string) as k, {hashes}, "
        f"case cast(floor({key} / 4) as bigint) % {len(TEMPLATES)} {cases} end as template from {source}"
    )
    ready = (
        "select *, concat(h0, upper(h1), h2, upper(h3)) as alnum, "
        "concat(translate(substring(h0, 1, 16), '0123456789abcdef', 'GHJKLMNPQRSTUVWX'), "
        "translate(substring(h1, 1, 16), '0123456789abcdef', 'ghjkmnpqrstuvwxy'), substring(h2, 1, 14)) as mixed, "
        "translate(h0, 'abcdef', '123456') as d0, translate(h1, 'abcdef', '123456') as d1 "
        f"from ({hashed}) as hashed"
    )
    line = "template"
    for mark in sorted(set(re.findall("<[^>]+>", " ".join(TEMPLATES)))):
        line = f"replace({line}, '{mark}', {_fill_sql(mark)})"
    return f"select *, {line} as line from ({ready}) as ready"


def path_sql(key: str) -> str:
    k = f"cast({key} % 50 as string)"
    return (
        f"concat('svc', {k}, case {key} % 4 when 0 then '/src/app.py' "
        f"when 1 then '/node_modules/x/index.js' when 2 then '/docs/readme.md' else '/vendor/lib.go' end)"
    )


ORDER_LINES_SQL = (
    f"select {path_sql('o_orderkey')} as file_path, cast(o_orderkey % 2000000000 as int) as line_number, "
    f"line as content from ({with_line_sql('orders', 'o_orderkey')}) as lined"
)


# A line is put together from pieces of its template, each a text or a place in one of the derived strings.
# One expression that replaces every mark took four times as long (600,000 lines, 11.8 s against 2.8 s).
_PIECE_TYPE = "array<array<struct<text: string, source: string, start: int, length: int>>>"


def _pieces(template: str) -> list[dict[str, object]]:
    fixed = {"<Q>": "'", "<N>": "\u00a0"}
    found: list[dict[str, object]] = []
    for part in re.split("(<[^>]+>)", template):
        if part in fixed or not part.startswith("<"):
            found.append({"text": fixed.get(part, part)})
        elif part in ("<K>", "<M>"):
            found.append({"source": part[1], "start": 1, "length": 1_000})
        else:
            length, _, start = part[2:-1].partition("@")
            found.append({"source": part[1], "start": int(start or 1), "length": int(length)})
    return [p for p in found if p.get("text") != ""]


def with_line(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` plus the column ``line`` of ``with_line_sql``."""
    names = [f"_h{i}" for i in range(4)]
    text = F.col(key).cast("string")
    hashed = rows.select("*", *[F.md5(F.concat(text, F.lit(s))).alias(n) for n, s in zip(names, "abcd", strict=True)])
    h0, h1, h2, h3 = (F.col(n) for n in names)

    def tame(text: Column, letters: str) -> Column:
        return F.translate(F.substring(text, 1, 16), "0123456789abcdef", letters)

    made = {
        "A": F.concat(h0, F.upper(h1), h2, F.upper(h3)),
        "C": F.upper(h0),
        "D": F.translate(h0, "abcdef", "123456"),
        "E": F.translate(h1, "abcdef", "123456"),
        "X": F.concat(h0, h2),
        "K": text,
        "M": F.concat(tame(h0, "GHJKLMNPQRSTUVWX"), tame(h1, "ghjkmnpqrstuvwxy"), F.substring(h2, 1, 14)),
    }

    def filled(piece: Column) -> Column:
        source = F.lit(None).cast("string")
        for letter, value in made.items():
            source = F.when(piece["source"] == letter, value).otherwise(source)
        return F.coalesce(piece["text"], F.substring(source, piece["start"], piece["length"]))

    templates = F.from_json(F.lit(json.dumps([_pieces(t) for t in TEMPLATES])), _PIECE_TYPE)
    number = F.expr(f"cast(cast(floor({key} / 4) as bigint) % {len(TEMPLATES)} as int)")
    line = F.array_join(F.transform(F.get(templates, number), filled), "")
    return hashed.withColumn("line", line).drop(*names)


def made_once(lines: DataFrame, made: str = "content") -> DataFrame:
    """The same rows, with ``content`` (or another column) made where it is.

    A filter on a derived line is otherwise pushed to the table and makes the line there a second time, with
    every hash as often as the line's expression names it. It cannot be pushed through a generator.
    """
    names = lines.columns
    bound = lines.select(*[n for n in names if n != made], F.explode(F.array(made)).alias(made))
    return bound.select(*names)


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """These columns, dealt to as many tasks as shuffles have.

    A table of few bytes, or of one row group, is read by few tasks, and its lines are much work. Streams and
    tables are dealt alike, in turn, so that neither nulls nor repeated rows gather.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*columns).repartition(parts)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``ORDER_LINES_SQL``.

    Keys are few bytes and lines much work, so the keys are dealt to more tasks than their bytes would get.
    """
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    keys = keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    lined = with_line(keys, "o_orderkey")
    return made_once(
        lined.select(
            F.expr(path_sql("o_orderkey")).alias("file_path"),
            F.expr("cast(o_orderkey % 2000000000 as int)").alias("line_number"),
            F.col("line").alias("content"),
        )
    )


# --- text tables -----------------------------------------------------------------------------


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(path.alias("file_path"), "text")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("url").alias("file_path"), F.col("html").alias("text"))


def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select(path.alias("file_path"), "text")


def corpus_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = (
        document_texts(spark, sf_dir)
        .unionByName(page_texts(spark, sf_dir))
        .unionByName(conversation_texts(spark, sf_dir))
    )
    return dealt(texts, "file_path", "text")


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the three text tables and of ``orders``."""
    return lines_from_text(corpus_texts(spark, sf_dir), "file_path", "text").unionByName(
        order_lines(spark, sf_dir)
    )


# --- diffs -----------------------------------------------------------------------------------

DIFF_PATH_SQL = (
    "concat('svc', cast(o_orderkey % 50 as string), case o_orderkey % 5 when 0 then '/src/app.py' "
    "when 1 then '/img/Logo.PNG' when 2 then '/vendor/lib.go' when 3 then '/docs/two words.md' "
    "else '/conf/.lock' end)"
)
DIFF_PARTS = 13
_RAW_SQL = " ".join(
    f"when {j} then {sql}"
    for j, sql in enumerate(
        [
            "case when o_orderkey % 11 = 0 then 'diff --git \"a/q\" \"b/q\"' "
            "else concat('diff --git a/', path, ' b/', path) end",
            "'index 0000..1111 100644'",
            "concat('--- a/', path)",
            "case when o_orderkey % 11 = 0 then '+++ \"b/q\"' when o_orderkey % 13 = 0 then '+++ /dev/null' "
            "else concat('+++ b/', path, case o_orderkey % 5 when 3 then chr(9) else '' end) end",
            "concat('@@ -3,2 +', cast(o_orderkey % 97 as string), ',4 @@ def f(x + y):')",
            "' unchanged'",
            "concat('-', 'removed ', cast(o_custkey as string))",
            "concat('+', line)",
            "'+++ plus plus'",
            "concat('+', line)",
            "case when o_orderkey % 3 = 0 then '@@ -90 +200 @@' else '-- minus' end",
            "concat(chr(92), ' No newline at end of file')",
            "concat('+', line)",
        ]
    )
)
# {j} ranges over the parts of one order's section; a customer's sections make up one diff.
_SECTIONS_SQL = with_line_sql(
    f"(select *, {DIFF_PATH_SQL} as path, case j when 9 then o_orderkey + 40 when 12 then o_orderkey + 80 "
    "else o_orderkey end as line_key from sections) as pathed",
    "line_key",
)
DIFF_LINES_SQL = (
    "select o_custkey as diff_id, cast(row_number() over (partition by o_custkey order by o_orderkey, j) - 1 as int) as seq, "
    f"case j {_RAW_SQL} end as raw from ({_SECTIONS_SQL}) as lined"
)
# Authors whose commits belong to an earlier range.
EARLIER_AUTHORS = ["dev3@example.com", "dev8@example.com"]
COMMITS_SQL = (
    f"select {DIFF_PATH_SQL} as file_path, concat('dev', cast(o_custkey % 20 as string), '@example.com') as author, "
    "o_orderdate as commit_ts from orders"
)


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``DIFF_LINES_SQL``.

    Orders are numbered before they are taken apart, so only their keys move and no line does. Orders that
    share both keys have equal sections, whose lines alternate.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    by_customer = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    row, rank = F.row_number().over(by_customer), F.rank().over(by_customer)
    # Lines are many times the bytes of the keys, by which partitions would else be drawn together.
    numbered = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey").select(
        "*",
        ((rank - 1) * DIFF_PARTS).alias("first"),
        (row - rank).alias("copy"),
        F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "o_orderkey")).alias("copies"),
    )
    sections = numbered.select("*", F.explode(F.sequence(F.lit(0), F.lit(DIFF_PARTS - 1))).alias("j")).select(
        "o_orderkey",
        "o_custkey",
        "j",
        (F.col("first") + F.col("j") * F.col("copies") + F.col("copy")).cast("int").alias("seq"),
        F.expr(DIFF_PATH_SQL).alias("path"),
        # Only these parts hold a line.
        F.expr("case j when 7 then o_orderkey when 9 then o_orderkey + 40 when 12 then o_orderkey + 80 end").alias("line_key"),
    )
    lined = with_line(sections, "line_key")
    return made_once(lined.select(F.col("o_custkey").alias("diff_id"), "seq", F.expr(f"case j {_RAW_SQL} end").alias("raw")), "raw")


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        COMMITS_SQL.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders")
    )


# --- events ----------------------------------------------------------------------------------

EVENT_LINES_SQL = (
    "select concat('events/', event_type, '.log') as file_path, cast(event_id % 2000000000 as int) as line_number, "
    f"line as content, ts from ({with_line_sql('events', 'user_id')}) as lined"
)


def event_lines(events: DataFrame) -> DataFrame:
    """The rows of ``EVENT_LINES_SQL``."""
    events = dealt(events, "event_id", "user_id", "event_type", "ts")
    return made_once(
        with_line(events, "user_id").select(
            F.expr("concat('events/', event_type, '.log')").alias("file_path"),
            F.expr("cast(event_id % 2000000000 as int)").alias("line_number"),
            F.col("line").alias("content"),
            "ts",
        )
    )
