"""Detectors: a line in, an array of hits out.

A detector is anything with the three members of ``Detector``. Hits are built row by row from
column expressions, so the same detector serves batch and streaming plans without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.config import EntropySettings, RegexRule, ScanSettings
from credsieve.functions.dialect import JvmPattern, NoJvmForm, jvm_pattern
from credsieve.functions.entropy import fewest_letters, is_high_entropy, tokens
from credsieve.functions.lets import let
from credsieve.functions.runs import has_long_run
from credsieve.functions.spans import found_parts, overlaps, place_parts
from credsieve.operators.exact import exact_hits
from credsieve.schema import HIT

HITS = f"array<{HIT.simpleString()}>"
LONG_RUN = 16

# How entropy hits are labelled.
ENTROPY_RULE = ("high-entropy-string", "High Entropy String", "medium")


class Detector(Protocol):
    """What a scan needs of a detector."""

    @property
    def run_length(self) -> int | None:
        """Length of the unbroken run every hit line holds, if there is one."""

    def cheap_tests(self, content: Column) -> list[Column]:
        """Tests, one of which holds on every hit line that lacks such a run."""

    def hits(self, content: Column) -> Column:
        """All hits on the line, as ``array<HIT>``."""


def hit(
    span: Column, rule: Sequence[Column], match_type: str, engine_rank: int, rule_ord: Column
) -> Column:
    rule_id, rule_name, severity = rule
    return F.struct(
        rule_id.alias("rule_id"),
        rule_name.alias("rule_name"),
        severity.alias("severity"),
        F.lit(match_type).alias("match_type"),
        span["value"].alias("raw_value"),
        span["column_start"].alias("column_start"),
        span["column_end"].alias("column_end"),
        F.lit(engine_rank).alias("engine_rank"),
        rule_ord.alias("rule_ord"),
    )


def _any(tests: Iterable[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


class RegexDetector:
    """All matches of all rules; a rule's position in the list is its rank on a line."""

    def __init__(self, rules: Sequence[RegexRule], on_arrow: Iterable[str] = ()) -> None:
        forced = set(on_arrow)
        self.native: list[tuple[int, RegexRule, JvmPattern]] = []
        self.exact: list[tuple[int, RegexRule]] = []
        for i, rule in enumerate(rules):
            try:
                if rule.id in forced:
                    raise NoJvmForm("asked for")
                self.native.append((i, rule, jvm_pattern(rule.pattern)))
            except NoJvmForm:
                self.exact.append((i, rule))

    @property
    def run_length(self) -> int | None:
        return LONG_RUN if any(r.long for _, r, _ in self.native) else None

    def cheap_tests(self, content: Column) -> list[Column]:
        if self.exact and not all(r.anchor or r.long for _, r in self.exact):
            return [F.lit(True)]
        anchors: dict[str, None] = {}
        slow: list[Column] = []
        for _, rule, form in self.native:
            if rule.long:
                continue
            texts = rule.anchor or ((form.literal,) if form.literal else ())
            anchors.update(dict.fromkeys(texts))
            if not texts:
                slow.append(content.rlike(form.regex))
        for _, rule in self.exact:
            anchors.update(dict.fromkeys(rule.anchor))
            if rule.long and not rule.anchor:
                slow.append(has_long_run(content, LONG_RUN))
        return [content.contains(a) for a in anchors] + slow

    def hits(self, content: Column) -> Column:
        found = []
        if self.native:
            found.append(self._native_hits(content))
        if self.exact:
            found.append(exact_hits(self.exact, F.when(self._exact_guard(content), content)))
        return F.concat(*found) if found else F.array().cast(HITS)

    def _native_hits(self, content: Column) -> Column:
        """Search for the rules with an anchor on the line, then place what they found in one shared step.

        Each pattern is a constant, which the JVM compiles once; as a column of a rule table it would be
        compiled for every line. Few rules are searched for on any line.
        """

        def found(folded: Column) -> Column:
            return F.filter(F.array(*[self._found(content, folded, *r) for r in self.native]), lambda r: r.isNotNull())

        return F.flatten(
            F.transform(
                let(F.lower(content), found),
                lambda r: F.transform(
                    place_parts(r["parts"]),
                    lambda s: hit(s, (r["id"], r["name"], r["severity"]), "regex", 0, r["ord"]),
                ),
            )
        )

    @staticmethod
    def _found(content: Column, folded: Column, i: int, rule: RegexRule, form: JvmPattern) -> Column:
        """The matches of one rule with its labels, null where none of its anchors is on the line."""
        anchors = [form.literal] if form.literal else list(rule.anchor)
        tests = [content.contains(t) for t in anchors] or [folded.contains(t) for t in rule.folded]
        labels = F.struct(
            F.lit(i).alias("ord"),
            F.lit(rule.id).alias("id"),
            F.lit(rule.name).alias("name"),
            F.lit(rule.severity).alias("severity"),
            found_parts(content, F.lit(form.regex), form.grouped).alias("parts"),
        )
        # Without any anchor the rule is searched for on every candidate line.
        return F.when(_any(tests) if tests else F.lit(True), labels)

    def _exact_guard(self, content: Column) -> Column:
        if all(r.anchor for _, r in self.exact):
            return _any(content.contains(t) for _, r in self.exact for t in r.anchor)
        return F.lit(True)


class EntropyDetector:
    """Tokens whose entropy reaches the threshold."""

    def __init__(self, settings: EntropySettings) -> None:
        self.settings = settings

    @property
    def run_length(self) -> int | None:
        return max(self.settings.min_length, fewest_letters(self.settings.threshold))

    def cheap_tests(self, content: Column) -> list[Column]:
        return []

    def hits(self, content: Column) -> Column:
        s = self.settings
        rule = [F.lit(x) for x in ENTROPY_RULE]
        strong = F.filter(
            tokens(content, self.run_length),
            lambda t: (F.length(t["value"]) <= s.max_length)
            & is_high_entropy(t["value"], s.threshold),
        )
        return F.transform(strong, lambda t: hit(t, rule, "entropy", 1, F.lit(0)))


def detectors_for(settings: ScanSettings, on_arrow: Iterable[str] = ()) -> list[Detector]:
    found: list[Detector] = []
    if settings.rules:
        found.append(RegexDetector(settings.rules, on_arrow))
    if settings.entropy.enabled:
        found.append(EntropyDetector(settings.entropy))
    return found


def may_hit(detectors: Sequence[Detector], content: Column) -> Column:
    """True on every line any detector reports, and on few others."""
    lengths = [d.run_length for d in detectors if d.run_length is not None]

    def tests(line: Column) -> Column:
        cheap = [t for d in detectors for t in d.cheap_tests(line)]
        return _any([has_long_run(line, min(lengths)), *cheap] if lengths else cheap)

    # The filter is pushed below the projection that makes the line. Were the line not bound, it would
    # be made anew for every test, and the code of a long expression would outgrow what the JVM compiles.
    return let(content, tests)


def all_hits(detectors: Sequence[Detector], content: Column) -> Column:
    """Hits of all detectors; an entropy hit that overlaps a regex hit of its line is dropped."""
    if not detectors:
        return F.array().cast(HITS)
    every = F.concat(*[d.hits(content).cast(HITS) for d in detectors])
    return let(
        every,
        lambda found: let(
            F.filter(found, lambda h: h["match_type"] == "regex"),
            lambda named: F.filter(
                found,
                lambda h: (h["match_type"] == "regex")
                | ~F.exists(named, lambda r: overlaps(h, r)),
            ),
        ),
    )
