"""Toxic texts by compression: windows that a dictionary of toxic text shortens more than one of ordinary text.

Two zstandard dictionaries are trained on labelled texts. A text is cut into windows, each a word with the
spaces around it. A window's distance is how many bytes shorter it becomes when the toxic dictionary may be
used beside the ordinary one. Counts of windows above calibrated distances give the text's score by a logistic
model, fitted on labelled texts that the dictionaries have not seen.

Windows are compressed two bytes a character and dictionaries used as plain content, so a match is worth
several bytes; in one byte a character a short word costs as much as the reference to it.

A toxic text is ordinary for the most part, so the toxic dictionary is trained on the windows that tell: those
with a run of characters that stands in many different contexts in toxic texts, and in far fewer in ordinary
ones. Contexts are counted and not occurrences, so copied texts do not make their words suspicious.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import ship

# The sample the model is fitted on: rows of each kind for the dictionaries, rows for the calibration, and
# characters of each, from a place chosen by the row's hash. Scoring has no such bounds.
TOXIC_ROWS = 2000
ORDINARY_ROWS = 2500
CALIBRATION_ROWS = 6000
SAMPLE_CHARS = 12_000
SAMPLE_WORDS = 100_000

RUN = 5
CONTEXT = 3
LEAST_CONTEXTS = 10
LIFT = 8
ORDINARY_BYTES = 110_000
TOXIC_BYTES = 8192
SEGMENT = 32
MATCH = 8
# What a trained dictionary has before its content: tables that plain content does without.
TABLES = 300

DISTANCES = (3, 4, 5, 6, 7, 8, 9, 11, 13)
REMEMBERED = 1 << 18
WORD = re.compile(r"\w{1,32}")
PREDICTED = 0.3


class Model(NamedTuple):
    """Contents of the two dictionaries, and the logistic model over a text's features."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; very long ones in parts."""
    return WORD.findall(text.lower()) if text else []


def window(word: str) -> bytes:
    return f" {word} ".encode("utf-16-le", "surrogatepass")


def _compressor(content: bytes):
    import zstandard

    parameters = zstandard.ZstdCompressionParameters(
        window_log=19, hash_log=17, chain_log=18, search_log=5, min_match=4, target_length=16,
        strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=parameters)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


class Distances(dict):
    """Window to distance, remembered up to a bound."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = _compressor(ordinary), _compressor(ordinary + toxic)

    def __missing__(self, word: str) -> int:
        w = window(word)
        found = len(self.plain.compress(w)) - len(self.both.compress(w))
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def features(distances: np.ndarray) -> np.ndarray:
    """How many windows reach each distance, in all and in a thousand, and how many there are."""
    n = len(distances)
    reached = np.array([(distances >= d).sum() for d in DISTANCES], float)
    most = min(int(distances.max()), 20) / 10 if n else 0.0
    return np.concatenate([np.log1p(reached), np.log1p(1000 * reached / max(n, 1)), [np.log1p(n), most]])


def trained(samples: Sequence[bytes], size: int) -> bytes:
    """The content of a dictionary trained on samples; the distinct samples where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, list(samples), k=SEGMENT, d=MATCH).as_bytes()[TABLES:]
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples)))[-size:]


def _contexts(texts: Iterable[str]) -> set[str]:
    found = set()
    for text in texts:
        words = words_of(text)
        found.update(" " + " ".join(words[i : i + CONTEXT]) + " " for i in range(max(1, len(words) - CONTEXT + 1)))
    return found


def _runs(contexts: Iterable[str]) -> Counter:
    counted: Counter = Counter()
    for c in contexts:
        counted.update({c[i : i + RUN] for i in range(len(c) - RUN + 1)})
    return counted


def telling_runs(toxic: Iterable[str], ordinary: Iterable[str]) -> set[str]:
    """Runs of characters with ``LIFT`` times as large a share of the contexts of toxic texts."""
    a, b = _contexts(toxic), _contexts(ordinary)
    in_toxic, in_ordinary = _runs(a), _runs(b)
    return {
        run for run, n in in_toxic.items()
        if n >= LEAST_CONTEXTS and n * max(len(b), 1) >= LIFT * (in_ordinary[run] + 1) * len(a)
    }


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of the features, and weights with the constant last; a unit ridge keeps them finite."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    weights = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        bend = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(weights))
        weights = weights - np.linalg.solve(bend, z.T @ (p - y) + weights)
    return mean, spread, weights


def fit(toxic: Sequence[str], ordinary: Sequence[str], calibration: Sequence[tuple[str, int]]) -> Model:
    """A model from texts of both kinds for the dictionaries, and others with labels for the calibration."""
    runs = telling_runs(toxic, ordinary)
    rng = np.random.default_rng(0)

    def shuffled(words: list[str]) -> list[str]:
        return [words[i] for i in rng.permutation(len(words))[:SAMPLE_WORDS]]

    usual = sorted(set(shuffled([w for t in ordinary for w in words_of(t)])))
    padded = ((w, f" {w} ") for t in toxic for w in words_of(t))
    telling = shuffled([w for w, p in padded if any(p[i : i + RUN] in runs for i in range(len(p) - RUN + 1))])
    contents = trained([window(w) for w in usual], ORDINARY_BYTES), trained([window(w) for w in telling], TOXIC_BYTES)
    distances = Distances(*contents)
    x = np.array([features(distances.of(t)) for t, _ in calibration]).reshape(len(calibration), 2 * len(DISTANCES) + 2)
    if not len(x):
        x = np.zeros((1, x.shape[1]))
    y = np.array([float(label) for _, label in calibration] or [0.5])
    return Model(*contents, *fit_logistic(x, y))


def scorer(model: Model) -> Column:
    """The score of texts: 0 to 1, higher for toxic ones."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known = Distances(model.ordinary, model.toxic)

        def of(text: str | None) -> float:
            z = np.append((features(known.of(text)) - model.mean) / model.spread, 1.0)
            return float(1 / (1 + np.exp(-np.clip(z @ model.weights, -30, 30))))

        return texts.map(of, na_action=None)

    return score


def held_out(key: Column) -> Column:
    """Rows whose labels are not learnt: those whose key's CRC-32 leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[list[str], list[str], list[tuple[str, int]]]:
    """The bounded sample of labelled rows: two in three for the dictionaries, the others for the calibration.

    Keys are chosen first, by the order of their hash, so texts of the chosen ones alone are read and moved; of a
    repeated key the smallest text is taken. Long texts give ``SAMPLE_CHARS`` characters from a place the hash chooses.
    """
    marks = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("key")))
    marks = marks.groupBy("key").agg(F.max("label").alias("label")).join(docs.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
    marks = marks.withColumn("h", F.xxhash64(F.col("key").cast("string")))
    fits = F.pmod("h", F.lit(3)) < 2
    kinds = [(fits & (F.col("label") == 1), TOXIC_ROWS), (fits & (F.col("label") == 0), ORDINARY_ROWS), (~fits, CALIBRATION_ROWS)]
    chosen = [r for test, n in kinds for r in marks.filter(test).orderBy("h", "key").limit(n).collect()]
    # At most the rows above; the join's small side has that bound.
    few = docs.sparkSession.createDataFrame(chosen, marks.schema)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(few), "key").withColumn("n", F.length("text"))
    start = F.when(F.col("n") > SAMPLE_CHARS, F.pmod(F.xxhash64("h"), F.col("n") - SAMPLE_CHARS)).otherwise(0).cast("int") + 1
    part = F.substring("text", start, F.lit(SAMPLE_CHARS))
    found = rows.groupBy("key", "label", "h").agg(F.min(part).alias("text")).orderBy("h", "key").collect()
    of = lambda test: [r for r in found if test(r.h % 3 < 2, r.label)]
    toxic, ordinary, others = of(lambda f, m: f and m == 1), of(lambda f, m: f and m == 0), of(lambda f, m: not f)
    return [r.text for r in toxic], [r.text for r in ordinary], [(r.text, int(r.label)) for r in others]


def toxicity(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str = "toxic") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``.

    A null text is an empty one; a text without words is scored from its lack of words. A null key is never held
    out and never learnt from; keys with several labels count as toxic if any is. Repeated rows get equal
    scores. Without labelled rows every score is one half. Other columns are not looked at, whatever their names.
    """
    model = fit(*sample(docs, labels, key, text, label))
    score = scorer(model)
    rows = docs.select(key, held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    scored = rows.select(key, "held_out", score(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICTED).cast("int"))


ship(__name__)
