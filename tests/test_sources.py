import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import In, LessThan, StringStartsWith

from credsieve import SettingsError, scan, user_settings
from credsieve.operators.diffs import (
    UnknownRange, added_lines, diff_lines_from_text, in_range, latest_authors, range_lines, split_range,
    with_authors,
)
from credsieve.rules import MAX_FILE_BYTES
from credsieve.sources.files import lines_from_files, read_files
from credsieve.sources.settings import read_settings
from credsieve.sources.texts import lines_from_text
from credsieve.sources.tree import OPEN_BYTES, Tree, TreeSource, use_trees, wanted

KEY = "AKIA" + "ABCDEFGHIJ123456"


@pytest.mark.parametrize(
    "text",
    ["", "\n", "a", "a\n", "a\n\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef", "a\x85b c d\n", "\n\na", "x\r\n"],
)
def test_lines_are_split_like_text_files(spark, text):
    df = spark.createDataFrame([("p", text)], "path string, text string")
    got = [(r.line_number, r.content) for r in lines_from_text(df, "path", "text").orderBy("line_number").collect()]
    assert got == list(enumerate(text.splitlines(), start=1))


def test_tree(spark, tmp_path):
    root = tmp_path / "tree"
    for name, data in {
        "src/a.py": KEY.encode() + b"\r\nx\n",
        "src/deep/b.txt": b"a\xffb\xe2\x82",
        "img/c.PNG": KEY.encode(),
        "poetry.lock": KEY.encode(),
        "edge.txt": b"a" * MAX_FILE_BYTES,
        "big.txt": b"a" * (MAX_FILE_BYTES + 1),
        "node_modules/d.js": KEY.encode(),
        "empty.txt": b"",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    lines = lines_from_files(read_files(spark, str(root)))
    got = {(r.file_path, r.line_number): r.content for r in lines.filter("file_path <> 'edge.txt'").collect()}
    assert got == {
        ("src/a.py", 1): KEY,
        ("src/a.py", 2): "x",
        ("src/deep/b.txt", 1): "a�b�",
        ("node_modules/d.js", 1): KEY,
    }
    assert lines.filter("file_path = 'edge.txt'").count() == 1
    row = scan(lines).summary.first()
    assert (row.total, row.scanned_files, row.scanned_lines) == (1, 3, 5)
    sub = lines_from_files(read_files(spark, str(root), "src"))
    assert {r.file_path for r in sub.collect()} == {"src/a.py", "src/deep/b.txt"}
    manifest = spark.createDataFrame([("src/a.py",)], "file_path string")
    assert lines_from_files(read_files(spark, str(root), manifest=manifest)).count() == 2


HIDDEN = [
    ".env", ".aws/credentials", "src/.npmrc", "pkg/__init__.py", "_conf/x.py", "src/app.py", "a b/c#1.py", "k=v/z.py",
]


def test_no_name_is_left_out(spark, tmp_path):
    for name in HIDDEN:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"key = {KEY}\n")
    (tmp_path / "back").symlink_to(tmp_path)

    def names(**options):
        return sorted(r.file_path for r in scan(lines_from_files(read_files(spark, str(tmp_path), **options))).findings.collect())

    assert names() == sorted(HIDDEN)
    assert names(subtree=".aws") == [".aws/credentials"]
    manifest = spark.createDataFrame([(".env",), ("pkg/__init__.py",), ("gone",)], "file_path string")
    assert names(manifest=manifest) == [".env", "pkg/__init__.py"]
    opened = read_files(spark, str(tmp_path), manifest=manifest)
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join"), "content is read after the join"


def test_an_empty_tree(spark, tmp_path):
    assert read_files(spark, str(tmp_path)).count() == 0


DIFF = """diff --git a/src/a.py b/src/a.py
index 1..2 100644
--- a/src/a.py
+++ b/src/a.py
@@ -1,2 +10,3 @@ def f(a + b):
 context
-gone
+added one
+++ plus
+added two
\\ No newline at end of file
+added three
@@ -90 +200 @@
+far
@@ bad @@
+from one
diff --git a/i.PNG b/i.PNG
+++ b/i.PNG
@@ -0,0 +1 @@
+skipped
diff --git "a/q" "b/q"
@@ -0,0 +5 @@
+no file
diff --git a/old b/old
+++ /dev/null
@@ -1 +0,0 @@
+odd"""

WANT = [
    ("src/a.py", 11, "added one"),
    ("src/a.py", 13, "added two"),
    ("src/a.py", 15, "added three"),
    ("src/a.py", 200, "far"),
    ("src/a.py", 1, "from one"),
    ("old", 0, "odd"),
]


@pytest.mark.parametrize("block", [1, 3, 7, 65536])
def test_added_lines_in_blocks_of_any_size(spark, block):
    texts = spark.createDataFrame([(1, DIFF), (2, "+stray\n" + DIFF)], "diff_id long, text string")
    rows = added_lines(diff_lines_from_text(texts, "diff_id", "text"), block_lines=block)
    for diff_id in (1, 2):
        got = rows.filter(F.col("diff_id") == diff_id).orderBy("seq").collect()
        assert [(r.file_path, r.line_number, r.content) for r in got] == WANT


def test_ranges_and_authors(spark, tmp_path):
    commits = spark.createDataFrame(
        [("src/a.py", "old@x", "2024-01-01", "A", "B"), ("src/a.py", "new@x", "2024-02-01", "A", "B")],
        "file_path string, author string, commit_ts string, from_ref string, to_ref string",
    )
    assert latest_authors(commits).first().author == "new@x"
    text = spark.createDataFrame([(1, DIFF)], "diff_id long, text string")
    diff = diff_lines_from_text(text, "diff_id", "text").withColumn("from_ref", F.lit("A")).withColumn("to_ref", F.lit("B"))
    diff.write.parquet(str(tmp_path / "diff"))
    diff = spark.read.parquet(str(tmp_path / "diff"))
    lines = range_lines(diff, "A..B").select("file_path")
    got = {(r.file_path, r.author) for r in with_authors(lines, in_range(commits, "A..B")).collect()}
    assert got == {("src/a.py", "new@x"), ("old", None)}
    other = diff.withColumn("to_ref", F.lit("C")).withColumn("raw", F.concat("raw", F.lit("!"))).unionByName(diff)
    assert sorted(range_lines(other, "A..B").select("content").collect()) == sorted(range_lines(diff, "A..B").select("content").collect())
    with pytest.raises(Exception, match="no diff for"):
        range_lines(diff, "A..C").collect()
    with pytest.raises(UnknownRange):
        split_range("HEAD")
    assert split_range("a..b..c") == ("a", "b..c")


def many_files(root, folders=60, files=20):
    for i in range(folders):
        (root / f"d{i % 7}" / f"_f{i}").mkdir(parents=True)
        for j in range(files):
            (root / f"d{i % 7}" / f"_f{i}" / f".n{j}.txt").write_text(f"{i} {j}\n" * (j + 1))


def test_a_tree_is_read_by_many_tasks(spark, tmp_path):
    many_files(tmp_path)
    with_limit = read_files(spark, str(tmp_path))
    tasks = with_limit.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).collect()
    assert sum(t.n for t in tasks) == 1200 and len(tasks) >= 8 and max(t.n for t in tasks) <= 300
    manifest = spark.range(60).selectExpr("concat('d', id % 7, '/_f', id, '/.n3.txt') as file_path")
    opened = read_files(spark, str(tmp_path), manifest=manifest)
    assert opened.count() == 60 and opened.select(F.spark_partition_id()).distinct().count() >= 4


@pytest.mark.parametrize("listed", [1, 100, 700])
def test_folders_the_planner_leaves_are_walked(spark, tmp_path, listed):
    many_files(tmp_path)
    use_trees(spark)
    read = spark.read.format("file_tree").option("listed", listed).option("max_bytes", 90).load(str(tmp_path))
    want = spark.read.format("file_tree").load(str(tmp_path)).filter("length <= 90")
    assert read.count() == want.count() > 500
    assert sorted(read.collect()) == sorted(want.collect())


def test_predicates_reach_the_planner(tmp_path):
    many_files(tmp_path, 3, 5)
    reader = TreeSource({"path": str(tmp_path), "pushdown": "true"}).reader(None)
    left = list(reader.pushFilters([
        LessThan(("length",), 9), StringStartsWith(("file_path",), "d1/"), In(("file_path",), ("d1/_f1/.n0.txt", "d1/_f1/.n1.txt", "d2/_f2/.n0.txt")),
        LessThan(("file_path",), "x"),
    ]))
    assert [type(f).__name__ for f in left] == ["LessThan"] and left[0].attribute == ("file_path",)
    (part,) = reader.partitions()
    assert [(f.path.split("/")[-1], f.length) for f in part.files] == [(".n0.txt", 4), (".n1.txt", 8)]
    assert TreeSource({"path": str(tmp_path / "none")}).reader(None).partitions()[0].files == []


def test_partitions_are_bounded_by_bytes(tmp_path):
    many_files(tmp_path)
    parts = Tree(str(tmp_path)).plan(wanted({}), 3_000_000, 10**6)
    assert all(sum(f.length + OPEN_BYTES for f in p.files) <= 3_000_000 for p in parts)
    assert sorted(f.path for p in parts for f in p.files) == sorted(str(p) for p in tmp_path.rglob("*.txt"))


def test_a_stream_reads_only_new_files(spark, tmp_path):
    use_trees(spark)
    root, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"

    def put(name):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)

    def run():
        rows = spark.readStream.format("file_tree").option("settle", 0).load(str(root)).selectExpr("file_path", "cast(content as string) as text")
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(state)).trigger(availableNow=True).start(str(out))
        assert query.awaitTermination(60)
        return sorted(r.file_path for r in spark.read.parquet(str(out)).collect())

    put(".env")
    put("a/_b.txt")
    assert run() == [".env", "a/_b.txt"]
    assert run() == [".env", "a/_b.txt"]
    put("a/.c/d.txt")
    assert run() == [".env", "a/.c/d.txt", "a/_b.txt"]
    # A run that was lost before it was committed is repeated over the same span.
    last = max((state / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    number = int(last.name)
    last.unlink()
    (state / "commits" / f".{number}.crc").unlink(missing_ok=True)
    put("late.txt")
    assert run() == [".env", "a/.c/d.txt", "a/_b.txt"]
    assert run() == [".env", "a/.c/d.txt", "a/_b.txt", "late.txt"]


def test_settings_from_a_file(spark, tmp_path):
    assert read_settings(spark, str(tmp_path / "none.json")) == user_settings({})
    path = tmp_path / "settings.json"
    path.write_text('{"entropy": {"enabled": false}, "ignore_paths": ["x/*"], "unknown": 1}')
    got = read_settings(spark, str(path))
    assert not got.entropy.enabled and got.ignore_paths[-1] == "x/*" and got.rules == user_settings({}).rules
    for bad in ("{", "[1]", '{"entropy": {"min_length": 2}}', '{"rules": [{"id": "a", "name": "b", "pattern": "("}]}'):
        path.write_text(bad)
        with pytest.raises(SettingsError):
            read_settings(spark, str(path))
    path.write_text("  ")
    assert read_settings(spark, str(path)) == user_settings({})
