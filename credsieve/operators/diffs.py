"""Unified diffs as tables: which lines were added, where, and by whom."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credsieve.functions.dialect import SPACE_CHARS
from credsieve.functions.paths import ignored_by, suffix
from credsieve.rules import SKIPPED_SUFFIXES
from credsieve.sources.texts import split_lines

# Diff lines handled by one task at a time. A diff of any length is cut into such blocks.
BLOCK_LINES = 65_536


class UnknownRange(ValueError):
    """A commit range that is malformed or has no diff."""


def diff_lines_from_text(diffs: DataFrame, diff_id: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Whole diff texts as a table of diff lines."""
    rows = diffs.select(
        F.col(diff_id).alias("diff_id"), *keep, F.posexplode(split_lines(F.col(text)))
    )
    return rows.select("diff_id", F.col("pos").alias("seq"), F.col("col").alias("raw"), *keep)


def added_lines(
    diff_lines: DataFrame,
    *,
    block_lines: int = BLOCK_LINES,
    ignore: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Added lines with their line number in the new file.

    ``diff_lines`` has ``diff_id``, ``seq`` and ``raw``: the text of a diff, line by line.
    Reading a diff means carrying the current file and a line counter from line to line. Within
    a block of lines that is a window; what a block hands to the next is worked out on one small
    row per block; so one huge diff spreads over as many tasks as it has blocks. Only diffs of several
    blocks hand anything on, so the lines of all others are read and ordered once.
    """
    block = F.floor(F.col("seq") / block_lines)
    numbered = diff_lines.select("diff_id", "seq", "raw", *keep).withColumn("block", block)
    numbered = numbered.filter(F.col("diff_id").isNotNull() & F.col("block").isNotNull())
    local = _within_blocks(numbered)

    handing = numbered.filter(F.col("block") > 0).select(F.col("diff_id").alias("_long")).distinct()
    any_long = handing.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    long_diffs = numbered.filter(any_long).join(handing, F.col("diff_id") == F.col("_long"), "left_semi")
    blocks = _within_blocks(long_diffs).groupBy("diff_id", "block").agg(
        F.max_by(F.struct("file", "steps_with", "steps_without", "shift_with", "shift_without"), "seq").alias("end")
    )
    before = (
        Window.partitionBy("diff_id")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        blocks.select("diff_id", "block", "end.*")
        .withColumn("file_in", F.last("file", ignorenulls=True).over(before))
        .withColumn("with_file", F.coalesce(F.col("file_in.path") != "", F.lit(False)))
        .withColumn("steps", _case("steps"))
        .withColumn("shift", _case("shift"))
        .withColumn("steps_in", F.coalesce(F.sum("steps").over(before), F.lit(0)))
        .withColumn("shift_in", F.last(F.col("shift") - F.col("steps_in"), ignorenulls=True).over(before))
        .select("diff_id", "block", "file_in", "with_file", F.col("steps_in").alias("steps_before"), "shift_in")
    )

    steps_here, shift_here = _case("steps"), _case("shift")
    number = (
        F.col("steps_in")
        + steps_here
        + F.coalesce(shift_here - F.col("steps_in"), F.col("shift_in"), F.lit(0))
    )
    out = (
        local.filter(F.col("kind") == "added")
        .join(carried, ["diff_id", "block"], "left")
        .withColumn("steps_in", F.coalesce("steps_before", F.lit(0)))
        .select(
            "diff_id",
            "seq",
            F.coalesce("file", "file_in")["path"].alias("file_path"),
            number.cast("int").alias("line_number"),
            F.substring("raw", F.lit(2), F.length("raw")).alias("content"),
            *keep,
        )
        .filter(F.col("file_path") != "")
        .filter(~suffix(F.col("file_path")).isin(SKIPPED_SUFFIXES))
    )
    if ignore is not None:
        out = out.withColumn("path_ignored", ignored_by(F.col("file_path"), list(ignore)))
    return out


def _within_blocks(lines: DataFrame) -> DataFrame:
    """Diff lines with the file and the counts that their own block up to there gives them."""
    marked = _kinds(lines)
    kind = F.col("kind")
    # Other lines neither open a file nor count nor restart a count.
    marked = marked.filter(~kind.isin("removed", "no name"))
    # Of lines that were not added all that matters is known by now, so their text need not travel.
    marked = marked.withColumn("raw", F.when(kind == "added", F.col("raw")))
    sofar = (
        Window.partitionBy("diff_id", "block")
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = marked.withColumn("file", F.last("opens", ignorenulls=True).over(sofar))
    # Added lines count only where there is a file. Before the first file of the block that
    # depends on the block before, so both cases are counted.
    has_file = F.coalesce(F.col("file.path") != "", F.lit(False))
    steps, shifts = {}, {}
    for case, file_before in (("with", True), ("without", False)):
        known = F.when(F.col("file").isNull(), F.lit(file_before)).otherwise(has_file)
        step = F.when(kind == "added", known.cast("int")).when(kind == "context", 1)
        steps[f"steps_{case}"] = F.sum(F.coalesce(step, F.lit(0))).over(sofar)
        shifts[f"shift_{case}"] = F.last(F.col("restarts") - F.col(f"steps_{case}"), ignorenulls=True).over(sofar)
    return local.withColumns(steps).withColumns(shifts)


def _case(name: str) -> Column:
    return F.when(F.col("with_file"), F.col(f"{name}_with")).otherwise(F.col(f"{name}_without"))


def _strip(text: Column) -> Column:
    # git puts a tab after a name that has spaces
    return F.regexp_replace(text, f"^[{SPACE_CHARS}]+|[{SPACE_CHARS}]+\\z", "")


def _kinds(lines: DataFrame) -> DataFrame:
    """Classify diff lines; add the file a line opens and the number its hunk starts from."""
    raw = F.col("raw")
    header = raw.startswith("diff --git ")
    new_name = raw.startswith("+++ b/")
    no_name = raw.startswith("+++ /dev/null") | raw.startswith("--- ")
    hunk = raw.startswith("@@ ")
    kind = (
        F.when(header, "header")
        .when(new_name, "name")
        .when(no_name, "no name")
        .when(hunk, "hunk")
        .when(raw.startswith("+") & ~raw.startswith("+++"), "added")
        .when(raw.startswith("-"), "removed")
        .otherwise("context")
    )
    # A header without " b/" (a quoted path) opens no file, which is not the same as no header.
    header_path = F.when(F.locate(" b/", raw) > 0, _strip(F.substring(raw, F.locate(" b/", raw) + 3, F.length(raw))))
    opens = F.when(header, F.struct(header_path.alias("path"))).when(
        new_name, F.struct(_strip(F.substring(raw, F.lit(7), F.length(raw))).alias("path"))
    )
    between = F.split_part(F.split_part(raw, F.lit("+"), F.lit(2)), F.lit("@@"), F.lit(1))
    start = F.split_part(between, F.lit(","), F.lit(1)).try_cast("int")
    restarts = F.when(header, 0).when(hunk, F.coalesce(start - 1, F.lit(0)))
    return (
        lines.withColumn("kind", kind).withColumn("opens", opens).withColumn("restarts", restarts)
    )


def split_range(commit_range: str) -> tuple[str, str]:
    """``A..B`` as its two ends."""
    first, dots, second = commit_range.partition("..")
    if not dots:
        raise UnknownRange(f"{commit_range!r} is not of the form FROM..TO")
    return first, second


def latest_authors(commit_files: DataFrame) -> DataFrame:
    """The author of the last commit that touched each file (``file_path``, ``author``, ``commit_ts``)."""
    return commit_files.groupBy("file_path").agg(
        F.max_by("author", F.struct("commit_ts", "author")).alias("author")
    )


def in_range(table: DataFrame, commit_range: str) -> DataFrame:
    """Rows of a table with ``from_ref`` and ``to_ref`` that belong to the range."""
    first, second = split_range(commit_range)
    return table.filter((F.col("from_ref") == first) & (F.col("to_ref") == second))


def with_authors(findings: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Findings with the last author of their file; joined after detection, when few rows are left."""
    columns = findings.columns if "author" in findings.columns else [*findings.columns, "author"]
    return findings.drop("author").join(latest_authors(commit_files), "file_path", "left").select(*columns)


def range_lines(diff_lines: DataFrame, commit_range: str, **options) -> DataFrame:
    """Added lines of one commit range; ``diff_lines`` carries ``from_ref`` and ``to_ref``.

    A range without a diff must not pass for a clean one: the scan of such lines fails when it
    runs, not while it is planned.
    """
    diff = in_range(diff_lines, commit_range)
    known = diff.limit(1).agg(F.count(F.lit(1)).alias("known"))
    unknown = F.raise_error(F.lit(f"no diff for {commit_range!r}"))
    checked = known.select(F.when(F.col("known") == 0, unknown).cast("string").alias("nothing"))
    # A subquery of one row, null or an error; it stands at the scan, which always runs.
    return added_lines(diff.filter(checked.scalar().isNull()), **options)
