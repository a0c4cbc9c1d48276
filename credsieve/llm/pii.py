"""Personal data by candidate gradient boosting, in DataFrame operations only.

Four strict patterns with their checks give the base spans. Loose generators propose more spans, also
overlapping ones. A proposal is described by yes/no features of its format and of what stands around
it; those leave out what the strict check itself looks at (a plus sign, a checksum, the range of a
number), and whether the strict check agrees is the label. So trees learn what checked values look like
otherwise, and can add values that only the check misses.

Proposals are summed up by kind, fold and features, a table of bounded size, from which trees are
boosted; the other fold sets, per kind, the lowest score at which precision is still as wanted. The
trees are applied as expressions. Added spans never touch a base span and never overlap each other.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import stash

KINDS = ("email", "ip", "card", "phone")
TREES = 12
RATE = 0.5
PRECISION = 0.95
# Fewer labelled proposals than this in a fold leave a kind to its strict pattern.
LEAST_LABELLED = 20

# The strict patterns, so written that no start inside a run is tried again and loops never recurse:
# a match begins where its run of characters does, or where the match before ended.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must contain to be searched at all.
HINT = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
}
LOOSE = {
    "email": r"(?:(?<![^\s@,;:<>()\[\]\"'])|\G)[^\s@,;:<>()\[\]\"']++@[^\s@,;:<>()\[\]\"']++",
    "ip": r"(?<![0-9.])[0-9]++(?:[.:][0-9]++){3,7}+",
    "number": r"(?<![0-9])\(?[0-9](?:[\x20().\-/]{0,2}+[0-9]){8,18}+(?![0-9])",
}
LOOSE_HINT = {
    "email": HINT["email"],
    "ip": HINT["ip"],
    "number": lambda t: t.rlike(r"[0-9](?:[\x20().\-/]{0,2}+[0-9]){8}"),
}
CUES = {
    "email": r"(?i)(?:mail|contact|write)[^a-z]*$",
    "ip": r"(?i)(?:\bip|addr\w*|host|server|from)[^a-z]*$",
    "card": r"(?i)(?:card|visa|master\w*|amex|credit|pan)[^a-z]*$",
    "phone": r"(?i)(?:phone|tel\w*|call|fax|mobile|cell|number)[^a-z]*$",
}
FOUND = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
SPANS = "array<struct<start:int,end:int>>"
AROUND = 16


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points and what stands around.

    Matches and the pieces between them alternate, so places are running sums of lengths.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    following = F.zip_with(found, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(1))), lambda m, g: F.struct(m.alias("m"), F.substring(g, 1, 1).alias("after")))
    steps = F.zip_with(
        F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(1))), following,
        lambda g, f: F.struct(F.length(g).alias("gap"), F.substring(g, -AROUND, AROUND).alias("before"), f.m.alias("m"), f.after.alias("after")),
    )
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

    def step(state: Column, s: Column) -> Column:
        start = state.at + s.gap
        one = F.struct(start.alias("start"), (start + F.length(s.m)).alias("end"), s.m.alias("match"), s.before.alias("before"), s.after.alias("after"))
        return F.struct((start + F.length(s.m)).alias("at"), F.concat(state.out, F.array(one)).alias("out"))

    return F.aggregate(F.filter(steps, lambda s: s.m.isNotNull()), nothing, step, lambda state: state.out)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    reversed_digits = F.split(F.reverse(digits(match)), "")
    doubled = F.transform(
        F.filter(reversed_digits, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """The strict pattern's own check."""
    n = F.length(digits(match))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.concat(F.lit("0"), F.substring(part(p), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(match)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = F.when(HINT[kind](text), located(text, STRICT[kind])).otherwise(F.array().cast(FOUND))
    checked = F.filter(found, lambda m: holds(kind, m.match))
    return F.transform(checked, lambda m: F.struct(m.start.alias("start"), m.end.alias("end")))


def features(kind: str, m: Column) -> list[Column]:
    """Yes/no features; at most 8, so that a kind has at most 256 combinations."""
    n, text = F.length(digits(m.match)), m.match
    around = [m.before.rlike(CUES[kind]), m.before.rlike(r"(?:^|[\s(\[<{:=,;\"'+])$"), m.after.rlike(r"^[\s)\]>},;.:!?\"']|^$")]
    if kind == "email":
        return [*around, text.rlike(r"\.[A-Za-z]{2,6}[.!?]?$"), text.rlike(r"^[\w.%+-]{1,64}@"), ~text.contains(".."), text.rlike(r"@[\w.-]+$")]
    if kind == "ip":
        return [*around, text.rlike(r"^[^.:]+(?:\.[^.:]+){3}$"), text.rlike(r"^[1-9]"), text.rlike(r"^(?:[0-9]{1,3}[.:])+[0-9]{1,3}$")]
    if kind == "card":
        return [*around, n == 16, n == 15, digits(text).rlike("^[3-6]"), text.rlike(r"^[0-9]+$"), text.rlike(r"^(?:[0-9]{4}[ -]){3}[0-9]{4}$")]
    return [*around, text.contains("("), n.between(10, 12), text.rlike(r"[0-9]{3}[ .-][0-9]{4}$"), text.rlike(r"[ .()-]"), text.rlike(r"^[0-9]{1,3}[ .(-]|^\(")]


def proposals(kind: str, found: Column, base: Column) -> Column:
    """Loose matches of one kind with features as bits and the strict check's verdict as label."""

    def one(m: Column) -> Column:
        bits = F.lit(0)
        for k, f in enumerate(features(kind, m)):
            bits = bits + F.when(f, 1 << k).otherwise(0)
        agreed = F.exists(base, lambda b: (b.start < m.end) & (b.end > m.start))
        return F.struct(m.start.alias("start"), m.end.alias("end"), bits.alias("bits"), agreed.alias("agreed"))

    shaped = found
    if kind == "card":
        shaped = F.filter(found, lambda m: F.length(digits(m.match)).between(13, 19))
    elif kind == "phone":
        shaped = F.filter(found, lambda m: F.length(digits(m.match)).between(9, 15))
    return F.transform(shaped, one)


def searched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, and per kind ``base_<kind>`` and ``more_<kind>``; the only pass over the texts."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    based = rows.select("*", *[base_spans(F.col("text"), k).alias(f"base_{k}") for k in KINDS])
    loose = {k: F.when(LOOSE_HINT[k](F.col("text")), located(F.col("text"), p)).otherwise(F.array().cast(FOUND)) for k, p in LOOSE.items()}
    proposed = based.select("*", *[c.alias(f"loose_{k}") for k, c in loose.items()])
    source = {"email": "loose_email", "ip": "loose_ip", "card": "loose_number", "phone": "loose_number"}
    return proposed.select("key", *[f"base_{k}" for k in KINDS], *[proposals(k, F.col(source[k]), F.col(f"base_{k}")).alias(f"more_{k}") for k in KINDS])


def counted(found: DataFrame) -> dict[str, list[tuple[int, int, int, int]]]:
    """Per kind (fold, bits, agreed, not agreed): at most 2 * 256 rows a kind, whatever the input."""
    rows = None
    for kind in KINDS:
        each = found.select(F.lit(kind).alias("kind"), F.pmod(F.xxhash64("key"), F.lit(2)).alias("fold"), F.explode(f"more_{kind}").alias("m"))
        rows = each if rows is None else rows.union(each)
    table = rows.groupBy("kind", "fold", "m.bits").agg(F.count_if("m.agreed").alias("yes"), F.count_if(~F.col("m.agreed")).alias("no"))
    out: dict[str, list] = {k: [] for k in KINDS}
    for r in table.collect():
        out[r["kind"]].append((r["fold"], r["bits"], r["yes"], r["no"]))
    return {k: sorted(v) for k, v in out.items()}


def leaf(rows: list[tuple[int, float, float]]) -> tuple[float, float]:
    """Newton value and gain of (bits, gradient, curvature) rows in one leaf."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    return g / (h + 1.0), g * g / (h + 1.0)


def best_split(rows: list) -> tuple[int, list, list] | None:
    best = None
    for k in range(8):
        on, off = [r for r in rows if r[0] >> k & 1], [r for r in rows if not r[0] >> k & 1]
        if on and off:
            gain = leaf(on)[1] + leaf(off)[1] - leaf(rows)[1]
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = (gain, k, on, off)
    return best and best[1:]


def grown(rows: list, depth: int) -> tuple | float:
    """A tree: a value, or (feature, tree if on, tree if off)."""
    split = best_split(rows) if depth else None
    if split is None:
        return RATE * leaf(rows)[0]
    k, on, off = split
    return k, grown(on, depth - 1), grown(off, depth - 1)


def tree_value(tree: tuple | float, bits: int) -> float:
    while isinstance(tree, tuple):
        tree = tree[1] if bits >> tree[0] & 1 else tree[2]
    return tree


def boosted(rows: list[tuple[int, int, int]], trees: int = TREES) -> list:
    """Logistic boosting of trees of depth 2 on (bits, yes, no)."""
    yes, no = sum(r[1] for r in rows), sum(r[2] for r in rows)
    model: list = [log((yes + 1) / (no + 1))]
    scores = dict.fromkeys((r[0] for r in rows), model[0])
    for _ in range(trees):
        steps = []
        for bits, y, n in rows:
            p = 1 / (1 + exp(-scores[bits]))
            steps.append((bits, y - (y + n) * p, (y + n) * p * (1 - p)))
        model.append(grown(steps, 2))
        for bits in scores:
            scores[bits] += tree_value(model[-1], bits)
    return model


def calibrated(model: list, rows: list[tuple[int, int, int]], precision: float) -> float | None:
    """The lowest score from which upwards held-out precision, one miss added, is as wanted."""
    scored: dict[float, list[int]] = {}
    for bits, y, n in rows:
        at = scored.setdefault(round(sum(tree_value(t, bits) for t in model), 6), [0, 0])
        at[0] += y
        at[1] += n
    yes = no = 0
    lowest = None
    for score in sorted(scored, reverse=True):
        yes, no = yes + scored[score][0], no + scored[score][1]
        if yes >= precision * (yes + no + 1):
            lowest = score
    return lowest


def fitted(found: DataFrame, precision: float) -> dict[str, tuple[list, float]]:
    models = {}
    for kind, rows in counted(found).items():
        folds = [[r[1:] for r in rows if r[0] == f] for f in (0, 1)]
        if all(sum(y + n for _, y, n in f) >= LEAST_LABELLED for f in folds):
            model = boosted(folds[0])
            if (lowest := calibrated(model, folds[1], precision)) is not None:
                models[kind] = (model, lowest)
    return models


def tree_column(tree: tuple | float, bits: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    on = F.shiftright(bits, tree[0]).bitwiseAND(F.lit(1)) == 1
    return F.when(on, tree_column(tree[1], bits)).otherwise(tree_column(tree[2], bits))


def added_spans(kind: str, models: dict) -> Column:
    """Proposals of a kind above its threshold that touch no base span, leftmost first, none overlapping."""
    nothing = F.array().cast(SPANS)
    if kind not in models:
        return nothing
    model, lowest = models[kind]

    def chosen(m: Column) -> Column:
        score = F.lit(0.0)
        for tree in model:
            score = score + tree_column(tree, m.bits)
        free = F.lit(True)
        for k in KINDS:
            free = free & apart_from(F.col(f"base_{k}"))(m)
        return ~m.agreed & (F.round(score, 6) >= lowest) & free

    return F.transform(F.filter(f"more_{kind}", chosen), lambda m: F.struct(m.start.alias("start"), m.end.alias("end")))


def apart_from(taken: Column):
    return lambda m: ~F.exists(taken, lambda b: (b.start < m.end) & (b.end > m.start))


def personal_data(docs: DataFrame, key: str, text: str, precision: float = PRECISION) -> DataFrame:
    """One row per document: ``key``, ``base_<kind>`` and ``added_<kind>``, arrays of (start, end) in
    code points, end exclusive, by start.

    Null and empty texts have no spans. Repeated rows are searched each for itself. Where one place
    is proposed as several kinds, the first kind of ``KINDS`` has it. Other columns are not looked
    at. An empty table gives no rows.
    """
    found = stash(searched(docs, key, text), "personal-data")
    models = fitted(found, precision)
    added = found.select("key", *[f"base_{k}" for k in KINDS], *[added_spans(k, models).alias(f"added_{k}") for k in KINDS])
    for at, kind in enumerate(KINDS):
        if kind in models:
            taken = F.concat(F.array().cast(SPANS), *[f"added_{k}" for k in KINDS[:at]])
            added = added.withColumn(f"added_{kind}", F.filter(f"added_{kind}", apart_from(taken)))
    return added.withColumnRenamed("key", key)


def named_span(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s.start, s.end)


def span_list(columns: list[str]) -> Column:
    """``kind:start:end`` of all columns named ``<what>_<kind>``, by kind, then start, comma-joined."""
    parts = []
    for kind in KINDS:
        spans = F.array_sort(F.concat(*[F.col(c) for c in columns if c.endswith(f"_{kind}")]))
        parts.append(F.transform(spans, named_span(kind)))
    return F.array_join(F.concat(*parts), ",")
