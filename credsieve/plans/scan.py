"""The scan: lines in, matches, findings and counts out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.config import ScanSettings, default_settings
from credsieve.functions.masking import fingerprint, mask_secret, redact_line, redact_spans
from credsieve.operators.detectors import Detector, all_hits, detectors_for, may_hit
from credsieve.operators.suppress import KEPT, is_allowed, mark_baselined, mark_ignored, status
from credsieve.schema import FINDING_COLUMNS

MODES = ("working_tree", "staged", "commit_range")
LINE_COLUMNS = ["file_path", "line_number", "content", "commit_hash", "author"]


def scan(
    lines: DataFrame,
    settings: ScanSettings | None = None,
    *,
    mode: str = "working_tree",
    target: str = "",
    baseline: DataFrame | None = None,
    detectors: Sequence[Detector] = (),
    on_arrow: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> Scan:
    """Scan a table of lines (``file_path``, ``line_number``, ``content``; provenance optional).

    ``detectors`` run besides the ones the settings ask for. ``on_arrow`` names rules to run on
    Python's ``re``. ``keep`` names columns of the lines to carry to the results. A ``baseline_file`` in the settings is read unless ``baseline`` is given.
    """
    settings = settings or default_settings()
    if mode not in MODES:
        raise ValueError(f"scan mode {mode!r} is none of {MODES}")
    if baseline is None and settings.baseline_file:
        from credsieve.sources.baseline import read_baseline

        baseline = read_baseline(lines.sparkSession, settings.baseline_file)
    found = [*detectors_for(settings, on_arrow), *detectors]
    return Scan(lines, settings, mode, target, baseline, found, list(keep))


class Scan:
    """Lazy results of one scan; each property is a DataFrame over the same plan."""

    def __init__(self, lines, settings, mode, target, baseline, detectors, keep) -> None:
        self.settings: ScanSettings = settings
        self.mode: str = mode
        self.target: str = target
        self.baseline: DataFrame | None = baseline
        self._detectors: list[Detector] = detectors
        self._keep: list[str] = keep
        for name in ("commit_hash", "author"):
            if name not in lines.columns:
                lines = lines.withColumn(name, F.lit(None).cast("string"))
        self._lines = mark_ignored(lines, settings.ignored_globs)

    def _hit_rows(self, every_line: bool) -> DataFrame:
        """One row per hit, with the raw value; with ``every_line`` hitless lines stay in.

        The generator is an outer one in both cases. For an inner one Spark would add a filter
        on the hit array and compute the whole array a second time to evaluate it.
        """
        content = F.col("content")
        wanted = ~F.col("path_ignored") & may_hit(self._detectors, content)
        hits = all_hits(self._detectors, content)
        kept = [*LINE_COLUMNS, *self._keep, "path_ignored"]
        if every_line:
            rows = self._lines.select(*kept, F.when(wanted, hits).alias("hits"))
        else:
            rows = self._lines.filter(wanted).select(*kept, hits.alias("hits"))
        rows = rows.select(*kept, "hits", F.posexplode_outer("hits").alias("hit_pos", "hit"))
        rows = rows.select(
            *kept, "hits", F.coalesce("hit_pos", F.lit(0)).alias("hit_pos"), "hit.*"
        )
        return rows if every_line else rows.filter(F.col("rule_id").isNotNull())

    def _masked(self, rows: DataFrame) -> DataFrame:
        raw = F.col("raw_value")
        masked = rows.withColumn("secret_masked", mask_secret(raw)).withColumn(
            "allowed", is_allowed(raw, self.settings.allowlist.patterns)
        )
        return masked.withColumn(
            "fingerprint",
            F.when(
                F.col("rule_id").isNotNull(),
                fingerprint(F.col("rule_id"), F.col("file_path"), F.col("secret_masked")),
            ),
        )

    @cached_property
    def matches(self) -> DataFrame:
        """Every hit with its ``status``: kept, allowlist or baseline. Nothing raw is in it."""
        start, end = F.col("column_start"), F.col("column_end")
        content = F.col("content")
        rows = self._masked(self._hit_rows(every_line=False)).select(
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
            redact_line(content, start, end).alias("line_preview"),
            redact_spans(content, F.col("hits")).alias("safe_preview"),
            F.lit(self.mode).alias("scan_mode"),
            "commit_hash",
            "author",
            "engine_rank",
            "rule_ord",
            "allowed",
            *self._keep,
        )
        marked = mark_baselined(rows, self.baseline)
        return marked.withColumn("status", status(F.col("allowed"), F.col("in_baseline"))).drop(
            "allowed", "in_baseline"
        )

    def with_order(self, safe: bool = False) -> DataFrame:
        """Kept matches with the columns of the scan order; ``safe`` masks the whole line."""
        kept = self.matches.filter(F.col("status") == KEPT)
        return kept.withColumn("line_preview", F.col("safe_preview")) if safe else kept

    @property
    def safe_matches(self) -> DataFrame:
        """Matches whose preview masks every secret on the line."""
        return self.matches.withColumn("line_preview", F.col("safe_preview"))

    @property
    def scanned(self) -> DataFrame:
        """``scanned_files, scanned_lines`` of the summary, without a look at what the lines hold."""
        files = self._lines.groupBy("file_path", "path_ignored").agg(F.count(F.lit(1)).alias("lines"))
        return files.agg(
            F.count_if(~F.col("path_ignored") & F.col("file_path").isNotNull()).alias("scanned_files"),
            F.coalesce(F.sum("lines"), F.lit(0)).alias("scanned_lines"),
        )

    @property
    def findings(self) -> DataFrame:
        """What is left to report. ``line_preview`` masks the finding's own span."""
        return self.with_order().select(*FINDING_COLUMNS, *self._keep)

    @property
    def safe_findings(self) -> DataFrame:
        """Findings whose preview masks every secret on the line; what the sinks write."""
        return self.with_order(safe=True).select(*FINDING_COLUMNS, *self._keep)

    @property
    def summary(self) -> DataFrame:
        """One row of counts, from one pass over the lines.

        Rows are counted per file and fingerprint before anything is shuffled, and lines without
        a hit join the baseline under their path, so neither a huge file nor the mass of hitless
        lines ends up in one task.
        """
        rows = self._masked(self._hit_rows(every_line=True))
        counted = rows.groupBy("file_path", "path_ignored", "fingerprint", "severity", "allowed").agg(
            F.count("rule_id").alias("hits"), F.count_if(F.col("hit_pos") == 0).alias("lines")
        )
        key = F.coalesce(F.col("fingerprint"), F.concat(F.lit("#"), F.col("file_path")))
        marked = mark_baselined(counted, self.baseline, key)
        kept = status(F.col("allowed"), F.col("in_baseline")) == KEPT

        def total(condition: Column) -> Column:
            return F.coalesce(F.sum(F.when(condition, F.col("hits"))), F.lit(0))

        return marked.agg(
            total(kept).alias("total"),
            total(kept & (F.col("severity") == "critical")).alias("critical"),
            total(kept & (F.col("severity") == "high")).alias("high"),
            total(~kept).alias("suppressed"),
            F.count_distinct(F.when(~F.col("path_ignored"), F.col("file_path"))).alias("scanned_files"),
            F.coalesce(F.sum("lines"), F.lit(0)).alias("scanned_lines"),
        ).select(
            F.lit(self.mode).alias("scan_mode"),
            F.lit(self.target).alias("target"),
            "total",
            "critical",
            "high",
            "suppressed",
            "scanned_files",
            "scanned_lines",
        )
