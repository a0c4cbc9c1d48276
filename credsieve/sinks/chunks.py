"""Bounded pieces of an ordered result, for reports that are documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.operators.suppress import KEPT
from credsieve.plans.scan import Scan
from credsieve.scratch import stored

_ROW_BITS = 33


def in_chunks(df: DataFrame, order: list[str | Column], size: int, ranged: bool = True) -> DataFrame:
    """Add ``chunk``: rows sorted by ``order`` in pieces of at most ``size``.

    Rows are range-partitioned and sorted, and numbered within their partition, so no task holds
    more than its range and no group more than ``size`` rows, whatever the number of findings.
    Ranges cost a second run of ``df`` to sample it; unless ``ranged``, rows stay in the partitions
    they are in, and pieces are in order only within each.
    """
    n = F.monotonically_increasing_id()
    row = n.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        (df.repartitionByRange(*order) if ranged else df)
        .sortWithinPartitions(*order)
        .withColumn(
            "chunk",
            F.struct(
                F.shiftright(n, _ROW_BITS).alias("part"), F.floor(row / size).alias("piece")
            ),
        )
    )


def found_once(scan: Scan) -> DataFrame:
    """All matches of the scan, masked, written to scratch and read back.

    Documents need them for the ranges, for the items and for the counts; each use would search all lines again.
    """
    return stored(scan.safe_matches, "matches")


def counts_of(scan: Scan, found: DataFrame) -> DataFrame:
    """One row with those columns of the summary that the matches tell."""
    kept = F.col("status") == KEPT
    return found.agg(
        F.lit(scan.mode).alias("scan_mode"),
        F.lit(scan.target).alias("target"),
        F.count_if(kept).alias("total"),
        F.count_if(kept & (F.col("severity") == "critical")).alias("critical"),
        F.count_if(kept & (F.col("severity") == "high")).alias("high"),
        F.count_if(~kept).alias("suppressed"),
    )
