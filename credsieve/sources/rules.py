"""Rule tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credsieve.config import RegexRule, SettingsError
from credsieve.rules import BUILTIN_RULES
from credsieve.schema import RULES


def rules_table(spark: SparkSession, rules: Iterable[RegexRule]) -> DataFrame:
    rows = [(i, r.id, r.name, r.pattern, r.severity, r.description) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULES)


def merge_rules(base: DataFrame, user: DataFrame) -> DataFrame:
    """User rules over base rules, by id.

    An overriding rule keeps the base rule's place, new ones follow in their own order, and of
    several user rules with one id the last stands.
    """
    both = base.withColumn("_source", F.lit(0)).unionByName(user.withColumn("_source", F.lit(1)))
    latest = Window.partitionBy("id").orderBy(F.desc("_source"), F.desc("rule_ord"))
    place = F.min(F.struct("_source", "rule_ord")).over(Window.partitionBy("id"))
    picked = (
        both.withColumn("_place", place)
        .withColumn("_latest", F.row_number().over(latest))
        .filter(F.col("_latest") == 1)
    )
    # One task orders the rules, which are settings and not data.
    ordered = F.row_number().over(Window.orderBy("_place._source", "_place.rule_ord")) - 1
    return picked.withColumn("rule_ord", ordered.cast("int")).select(*RULES.fieldNames())


def rules_from_table(rules: DataFrame) -> list[RegexRule]:
    """Validated rules from a table, in order; built-in rules keep their search hints.

    A rule set is settings, not data: it comes to the driver and ends up as literals in the plan.
    """
    rows = rules.orderBy("rule_ord").collect()
    if not rows:
        raise SettingsError("the rule table is empty")
    hints = {(r.id, r.pattern): r for r in BUILTIN_RULES}
    out = []
    for r in rows:
        known = hints.get((r["id"], r["pattern"]))
        out.append(
            RegexRule(
                r["id"],
                r["name"],
                r["pattern"],
                r["severity"] or "high",
                r["description"] or "",
                long=known.long if known else False,
                anchor=known.anchor if known else (),
                folded=known.folded if known else (),
            )
        )
    return out
