"""File trees as numbered lines."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.functions.paths import suffix
from credsieve.rules import MAX_FILE_BYTES, SKIPPED_SUFFIXES
from credsieve.sources.texts import lines_from_text
from credsieve.sources.tree import use_trees


def _reader(root: str):
    """A task that adds the bytes of each file; a file that is gone or unreadable is left out."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        local = root.startswith("/") or root.startswith("file:")
        system = fs.LocalFileSystem() if local else fs.FileSystem.from_uri(root)[0]
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with system.open_input_file(path) as f:
                        data = f.read()
                except OSError:
                    continue
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], names=[*row.schema.names, "content"])

    return work


def _tree(spark: SparkSession, root: str, subtree: str, **options) -> DataFrame:
    use_trees(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("file_tree").option("subtree", subtree).option("pushdown", pushdown)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(root)


def list_files(spark: SparkSession, root: str, subtree: str = "") -> DataFrame:
    """All files below ``root`` (or one subtree): ``file_path`` relative to the root, ``path``, ``length``.

    Nothing is listed before the query runs.
    """
    return _tree(spark, root, subtree, content="false")


def read_content(files: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """Listed files with their bytes in ``content``; called after everything that drops files.

    Listed rows are tiny and would be put together in few tasks, so they are dealt over ``tasks``, which adaptive
    execution leaves alone. Files are read one at a time, so more of them make a task longer and not larger.
    """
    if tasks is None:
        spark = files.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = files.select("file_path", "path", "length").repartition(tasks)
    return rows.mapInArrow(_reader(root), "file_path string, path string, length long, content binary")


def read_files(
    spark: SparkSession, root: str, subtree: str = "", *, manifest: DataFrame | None = None, max_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    """The text files below ``root``, or those a manifest names, with their content.

    Size and extension are told from the listing and planned by bytes; only what is left is opened. With a
    manifest the listing is joined first, and what it names is opened after.
    """
    if manifest is None:
        return _tree(spark, root, subtree, max_bytes=max_bytes, skip_suffixes=json.dumps(list(SKIPPED_SUFFIXES)))
    return read_content(listed_only(select_text_files(list_files(spark, root, subtree), max_bytes=max_bytes), manifest), root)


def select_text_files(
    files: DataFrame, *, max_bytes: int = MAX_FILE_BYTES, suffixes: Sequence[str] = SKIPPED_SUFFIXES
) -> DataFrame:
    """Drop files by size and extension; both tests come before any content is used."""
    return files.filter(F.col("length") <= max_bytes).filter(
        ~suffix(F.col("file_path")).isin(list(suffixes))
    )


def listed_only(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Files a manifest (``file_path``) names; without a manifest, all."""
    if manifest is None:
        return files
    return files.join(manifest.select("file_path"), "file_path", "left_semi")


def decoded(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def lines_from_files(
    files: DataFrame,
    *,
    ignore: Sequence[str] | None = None,
    manifest: DataFrame | None = None,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """Numbered lines of a table of files (``file_path``, ``length``, ``content``)."""
    chosen = listed_only(select_text_files(files, max_bytes=max_bytes), manifest)
    return lines_from_text(chosen, "file_path", decoded(F.col("content")), ignore=ignore)
