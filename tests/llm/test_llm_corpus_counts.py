"""Alignment, toxicity and phrases against plain versions, on small tables and odd ones."""

import hashlib
import pickletools
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark import cloudpickle

from credsieve.llm import alignment, incidence, phrases, queries, toxicity
from credsieve.llm.alignment import ByteLevel, Pieces

SF = Path("/root/testdata/sf0.001")

ODD_TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\nb c", "x▁y z", "▁", "é ﬁ", "　x y", "don't stop", "\x00 \x1c b",
    "<|endoftext|> <s> </s> <unk> <0x41>", "日本語のテキスト \U0001f600\U0001f600", "tab\tand\r\nend", "   x", "wort " * 3000, "z" * 5000, "same text", "same text",
]


# --- matrices ----------------------------------------------------------------------------------


def dense(m):
    out = np.zeros((len(m.starts) - 1, m.width), int)
    for i in range(len(out)):
        np.add.at(out[i], m.columns[m.starts[i] : m.starts[i + 1]], 1)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_product_is_the_matrix_product(seed):
    rng = np.random.default_rng(seed)

    def some(n, width):
        rows = [np.sort(rng.choice(width, rng.integers(0, width), replace=False)) for _ in range(n)]
        return incidence.Rows(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows).astype(np.int64), width)

    a, b = some(7, 9), some(5, 9)
    assert (dense(incidence.transposed(b)) == dense(b).T).all()
    row, column, value = incidence.product(a, incidence.transposed(b))
    got = np.zeros((7, 5), int)
    got[row, column] = value
    want = dense(a) @ dense(b).T
    assert (got == want).all() and len(value) == (want > 0).sum()
    assert (incidence.partial_sizes(a, incidence.transposed(b)) == want.sum(axis=1)).all()


# --- alignment ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def plainly_aligned(texts, paths):
    """Whole texts, token by token."""
    first, second = ByteLevel(paths[0]), Pieces(paths[1])
    found, holders = [], Counter()
    for text in texts:
        a = first.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.model.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(first.bytes[i] for i in a) != whole or b"".join(second.bytes[i] for i in b) != whole:
            found.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(v.bytes[i]) for i in ids]) for v, ids in ((first, a), (second, b)))
        links = []
        for i, (end, n) in enumerate(zip(ends_a, (len(first.bytes[x]) for x in a), strict=True)):
            j = int(np.searchsorted(ends_b, end - n, "right"))
            while j < len(b) and ends_b[j] - len(second.bytes[b[j]]) < end:
                links.append((a[i], b[j]))
                j += 1
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups, low = [], 0
        for cut in cuts:
            part = [[i for i, e in zip(ids, ends, strict=True) if low < e <= cut] for ids, ends in ((a, ends_a), (b, ends_b))]
            groups.append("|".join(",".join(map(str, p)) for p in part))
            low = cut
        n_group_links = sum((g.split("|")[0].count(",") + 1) * (g.split("|")[1].count(",") + 1) for g in groups)
        found.append((len(a), len(b), links, groups, n_group_links))
        holders.update(set(links))
    top = {}
    for (i, _), n in holders.items():
        top[i] = max(top.get(i, 0), n)
    for f in found:
        if f is None:
            yield 0, 0, 0, 0, 0, 0, "", 0
        else:
            a, b, links, groups, n_group_links = f
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            best = sum(holders[x] == top[x[0]] for x in links)
            yield a, b, len(groups), len(links), best, sum(holders[x] for x in links), digest, n_group_links


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]


@pytest.mark.parametrize("block_bytes", [5000, alignment.BLOCK_BYTES])
def test_alignment_is_that_of_whole_texts(spark, paths, block_bytes):
    texts = list(ODD_TEXTS)
    if SF.exists():
        texts += [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' where doc_id % 40 = 0").fetchall()]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "id long, text string, key int, block int, n_a int")
    got = {r["id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, "id", "text", *paths, block_bytes=block_bytes).collect()}
    assert got == dict(enumerate(plainly_aligned(texts, paths)))


def test_alignment_of_odd_tables(spark, paths):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, "doc_id", "text", *paths).collect() == []
    rows = [(None, "a b"), (None, None), (3, "a b"), (3, "a b"), (3, "other")]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", *paths).collect()
    assert sorted((r.doc_id is None, r.n_a) for r in got) == [(False, 1), (False, 2), (False, 2), (True, 0), (True, 2)]


def test_neither_vocabulary_goes_on_from_a_word_to_a_space(paths):
    for vocabulary in (ByteLevel(paths[0]), Pieces(paths[1])):
        assert not [b for b in vocabulary.bytes if re.search(r"\S ", b.decode("utf-8", "replace"))]


# --- toxicity ----------------------------------------------------------------------------------


def made_up(spark):
    """Texts of made-up words; every third has some of three words that no other text has."""
    rng = np.random.default_rng(7)
    parts = ["ba", "ke", "lo", "mi", "nu", "ra", "so", "ti", "ve", "wo"]
    usual = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(usual, 60))
        if i % 3 == 0:
            for _ in range(4):
                words.insert(int(rng.integers(len(words))), str(rng.choice(["grunkel", "schmozz", "pfidget"])))
        rows.append((i, " ".join(words), "ignored"))
        labels.append((i, int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = made_up(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, "doc_id", "text").collect()}
    assert len(got) == 900
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got.values() if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.95


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = made_up(spark)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    a = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, "doc_id", "text").collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(5), turned, "doc_id", "text").collect()}
    assert a == b


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame(
        [(None, "a"), (1, None), (1, ""), (2, "x" * 50_000), (2, "x" * 50_000), (3, "!!! ...")], "doc_id long, text string"
    )
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    for labels in (no_labels, some):
        got = toxicity.toxicity(docs, labels, "doc_id", "text").collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.toxicity(docs, no_labels, "doc_id", "text").collect()} == {0.5}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.toxicity(empty, some, "doc_id", "text").collect() == []


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_toxicity_of_the_given_tables(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in queries.op12_compression_distance(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    toxic, others = ([r.predicted for r in rows if labels[r.doc_id] == k] for k in (1, 0))
    # Of the toxic rows of these tables some 40 % hold none of the words that set the others apart.
    assert np.mean(toxic) > 0.65 and np.mean(others) < 0.05


# --- phrases -----------------------------------------------------------------------------------


def plainly_mined(rows, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1))
    found = {}
    candidates = [(lang, ws) for (lang, ws), a in counts.items() if len(ws) > 1 and a >= least]
    for lang, ws in candidates:
        a = counts[lang, ws]
        cuts = [(2_000_000 * a // (counts[lang, ws[:k]] + counts[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        inside = any(
            other == lang and len(longer) > len(ws) and 100 * counts[lang, longer] >= 80 * a
            and any(longer[i : i + len(ws)] == ws for i in range(len(longer) - len(ws) + 1))
            for other, longer in candidates
        )
        if not inside:
            found.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), counts[lang, ws[:k]], counts[lang, ws[k:]]))
    for lang, of in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(of), 1):
            yield lang, rank, phrase.decode(), -a, left, right, totals[lang], -score


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "lang string, text string, n int, word string, id int").repartition(3)
    return {tuple(r) for r in phrases.collocations(docs, "lang", "text", **options).collect()}


def phrase_rows():
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "État", "Ä", "gamma", "d-e", "e", "f"]
    rows = [(str(rng.choice(["en", "de"])), " ".join(rng.choice(words, 30)).replace("gamma", "gamma,", 2)) for _ in range(60)]
    rows += [("en", "new york city hall, new york city hall"), ("en", "the new york city hall")] * 8
    rows += [(None, "a a a a a a"), ("und", "a\ta  a"), ("fr", None), ("fr", ""), ("fr", "un"), ("en", "x" * 3000 + " y"), ("", "q q")] * 3
    return rows


@pytest.mark.parametrize("least", [1, 3, 12])
def test_phrases_are_those_of_plain_counting(spark, least):
    assert mined(spark, phrase_rows(), least=least) == set(plainly_mined(phrase_rows(), least))


def test_full_slots_change_nothing(spark, monkeypatch):
    whole = mined(spark, phrase_rows(), least=5)
    monkeypatch.setattr(phrases, "WORD_SLOTS", 6)
    monkeypatch.setattr(phrases, "RUN_SLOTS", 6)
    assert mined(spark, phrase_rows(), least=5) == whole == set(plainly_mined(phrase_rows(), 5))


def test_first_ranks_and_empty_tables(spark):
    whole = mined(spark, phrase_rows(), least=3)
    assert mined(spark, phrase_rows(), least=3, first=4) == {r for r in whole if r[1] <= 4}
    assert mined(spark, [], least=1) == set()
    assert mined(spark, [(None, None), ("en", "one")], least=1) == set()


def test_products_past_64_bits_are_exact(spark):
    big = 9_000_000_000_000_000_001
    counts = spark.createDataFrame([([1, 2], big - 2), ([1], big), ([2], big - 1)], "ws array<long>, n long")
    (row,) = phrases.best_cuts(counts).collect()
    assert row.score == 2_000_000 * (big - 2) // (2 * big - 1) and (row.l, row.r) == (big, big - 1)


# --- tasks -------------------------------------------------------------------------------------


def by_name(pickled: bytes) -> list:
    """Names a pickle would import from the package."""
    strings, found = [], []
    for op, arg, _ in pickletools.genops(pickled):
        if isinstance(arg, str):
            strings.append(arg)
        if op.name == "STACK_GLOBAL" and strings[-2].startswith("credsieve"):
            found.append(strings[-2:])
    return found


def test_tasks_carry_their_code():
    slots = np.zeros(4, np.uint64)
    model = toxicity.Model(b"", b"", np.zeros(1), np.ones(1), np.zeros(2))
    for task in (
        alignment.block_worker("a", "b", 1), alignment.answer_worker(), phrases.word_counter(0)[0],
        phrases.run_counter(0, slots, [])[0], phrases.window_counter(0, slots, [slots])[0], phrases.slot_counter(8), toxicity.scorer,
    ):
        assert not by_name(cloudpickle.dumps(task))
