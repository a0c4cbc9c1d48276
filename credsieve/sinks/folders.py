"""Report folders: documents of bounded size and an index, written by one pass over the rows.

A task streams its rows into documents below ``documents`` and tells the driver no more than their names
and its counts. The commit adds the counts up and writes ``index.json``, which lists the documents. What a
failed, repeated or abandoned task has written is listed nowhere, so it is no part of the report.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from credsieve.sources.tree import Tree

INDEX, DOCUMENTS = "index.json", "documents"
# Files are kept together in a task, but a huge one is cut at every so many lines.
BLOCK_LINES = 1 << 16
COUNTS = "total: bigint, critical: bigint, high: bigint, suppressed: bigint, scanned_files: bigint, scanned_lines: bigint"


@dataclass
class Written(WriterCommitMessage):
    """Names of a task's documents with the items in each, and what the task has counted."""

    documents: list[tuple[str, int]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("total", "critical", "high", "suppressed"), 0))


class Document:
    """Items of one document until it is full, and the rules they name, each as first met."""

    def __init__(self):
        self.items: list[str] = []
        self.rules: dict[str, str] = {}
        self.suppressed = 0

    def text(self, shape: str, head: dict, part: str) -> str:
        items = ",".join(self.items)
        if shape == "json":
            return f'{json.dumps({**head, "part": part})[:-1]}, "findings":[{items}]}}'
        tool = f'{json.dumps(head["tool"])[:-1]}, "rules":[{",".join(self.rules.values())}]}}'
        facts = json.dumps({**head["properties"], "suppressedCount": self.suppressed, "part": part})
        return f'{json.dumps(head["log"])[:-1]}, "runs":[{{"tool":{{"driver":{tool}}},"results":[{items}],"properties":{facts}}}]}}'


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.shape, self.size = options["path"], options["shape"], int(options["size"])
        self.head, self.scanned = json.loads(options["head"]), json.loads(options.get("scanned", "{}"))
        system, base = Tree(self.root).system()
        self.replaced = [name for name, _ in listed(system, base)]
        if self.replaced and not overwrite:
            raise ValueError(f"there is a report in {self.root}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = Tree(self.root).system()
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        attempt, done, document = uuid.uuid4().hex[:12], Written(), Document()

        def close() -> None:
            part = f"{task}-{len(done.documents)}"
            name = f"part-{part}-{attempt}.json"
            done.documents.append((name, len(document.items)))
            put(system, f"{base}/{DOCUMENTS}", name, document.text(self.shape, self.head, part))

        try:
            for batch in iterator:
                kept = pc.equal(batch["status"], "kept")
                done.counts["total"] += (n := pc.sum(kept).as_py() or 0)
                done.counts["suppressed"] += batch.num_rows - n
                for level in ("critical", "high"):
                    done.counts[level] += pc.sum(pc.and_(kept, pc.equal(batch["severity"], level))).as_py() or 0
                for item, rule_id, rule in zip(*(batch[c].to_pylist() for c in ("item", "rule_id", "rule")), strict=True):
                    if item is None:
                        document.suppressed += 1
                        continue
                    if len(document.items) >= self.size:
                        close()
                        document = Document()
                    document.items.append(item)
                    document.rules.setdefault(rule_id, rule)
            if document.items or document.suppressed:
                close()
        except BaseException:
            remove(system, base, done.documents)
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, base = Tree(self.root).system()
        done = [m for m in messages if m is not None]
        documents = [d for m in done for d in m.documents]
        if not documents:
            documents = [("part-none.json", 0)]
            put(system, f"{base}/{DOCUMENTS}", documents[0][0], Document().text(self.shape, self.head, "none"))
        counts = {c: sum(m.counts[c] for m in done) for c in Written().counts}
        index = {**self.head, "summary": counts | self.scanned, "parts": len(documents)}
        index["documents"] = [{"name": name, "items": items} for name, items in documents]
        put(system, base, INDEX, json.dumps(index))
        new = {name for name, _ in documents}
        remove(system, base, [(name, 0) for name in self.replaced if name not in new])

    def abort(self, messages: list[Written | None]) -> None:
        system, base = Tree(self.root).system()
        remove(system, base, [d for m in messages if m is not None for d in m.documents])


def put(system, folder: str, name: str, text: str) -> None:
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/{name}") as out:
        out.write(text.encode("utf-8"))


def remove(system, base: str, documents: list[tuple[str, int]]) -> None:
    for name, _ in documents:
        try:
            system.delete_file(f"{base}/{DOCUMENTS}/{name}")
        except FileNotFoundError:
            pass


def listed(system, base: str) -> list[tuple[str, int]]:
    """What the index lists; nothing if there is none."""
    try:
        with system.open_input_stream(f"{base}/{INDEX}") as file:
            return [(d["name"], d["items"]) for d in json.loads(file.read())["documents"]]
    except FileNotFoundError:
        return []


class FolderSource(DataSource):
    """Options: ``path``; ``shape``, ``json`` or ``sarif``; ``size``, items a document; ``head`` and ``scanned``, JSON."""

    @classmethod
    def name(cls) -> str:
        return "report_folder"

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(dict(self.options), overwrite)


def in_scan_order(matches: DataFrame, order: list[str]) -> DataFrame:
    """Matches with those of one file together and in order. Only matches move, and nothing is sampled for it."""
    block = F.floor(F.col("line_number") / BLOCK_LINES)
    return matches.repartition("file_path", block).sortWithinPartitions(*order)


def write_folder(rows: DataFrame, path: str, shape: str, head: dict, size: int, scanned: dict | None = None) -> None:
    """Write ``status, severity, item, rule_id, rule`` in their order, replacing the report in ``path``.

    ``item`` is a finding as JSON, null if it is suppressed, and ``rule`` its rule as JSON or null.
    """
    rows.sparkSession.dataSource.register(FolderSource)
    out = rows.select("status", "severity", "item", "rule_id", "rule").write.format("report_folder").mode("overwrite")
    options = {"shape": shape, "size": size, "head": json.dumps(head), "scanned": json.dumps(scanned or {})}
    out.options(**options).save(path)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """``value``, ``name`` and the report's ``summary`` for each listed document."""
    shape = f"summary struct<{COUNTS}>, documents array<struct<name: string>>"
    index = spark.read.text(f"{path}/{INDEX}", wholetext=True).select(F.from_json("value", shape).alias("index"))
    names = index.select("index.summary", F.explode("index.documents.name").alias("name"))
    documents = spark.read.text(f"{path}/{DOCUMENTS}", wholetext=True)
    return documents.select("value", F.col("_metadata.file_name").alias("name")).join(names, "name")


# Tasks get the code itself and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
