"""A cheap necessary condition: does the line hold a long unbroken run of characters?

Every fixed-shape credential and every high-entropy token is such a run, and prose has next to
none, so this one test spares most lines all further work. Only characters that neither detector
accepts inside a value count as breaks, so no line that a detector would report is lost.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Single characters, no ranges and no shorthand: the JVM then tests the class by one table
# look-up. Starting the match at a break keeps it from retrying inside every word.
_BREAKS = " \\t\"'`,;(){}\\[\\]<>\\\\=:"


def has_long_run(content: Column, length: int) -> Column:
    return F.concat(F.lit(" "), content).rlike(f"[{_BREAKS}][^{_BREAKS}]{{{length}}}")
