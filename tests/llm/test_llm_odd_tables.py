"""Every operator and stage on tables that are empty, or hold nulls, ties, copies and long texts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import corpus_pipeline
from credsieve.llm import fuzzy_lines, hamming, html_text, minhash, mixing, packing, paragraphs, pii, quality, queries, warc

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n int, component long, size long, "
    "bucket int, copies int, kept boolean, measures int, failed string, row int, group string"
)
EXTRA = (7, "k", 1, 2, 3, 4, 5, True, 6, "f", 8, "g")
LINE = " ".join(f"word{i}" for i in range(60))
LONG = "\n".join(" ".join(f"w{i * j % 9973}" for j in range(40)) for i in range(400))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [
        (1, LINE), (2, LINE), (2, LINE), (3, None), (4, ""), (5, "x"), (6, "\n\n \t\n"), (7, LONG), (8, "y" * 200_000), (None, LINE),
        (9, "+" * 5000 + "a@b.cc"), (10, "é ß 😀 " * 30),
    ]
    sources = ["a", "b", None]
    rows = [(i, t, "en", sources[k % 3], len(t) if t else None, *EXTRA) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=lambda i: (i is None, i))


ALL = [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, None]


def test_quality(odd, none):
    book = quality.ledger(odd, "text")
    assert ids(book) == ALL
    assert book.filter(F.col("doc_id") == 3).first()["measures"]["n_words"] == 0
    assert ids(book.filter(quality.passes("v1"))) == [1, 2, 2, 7, None]
    assert quality.ledger(none, "text").count() == 0


def test_mixing(odd, none):
    sized = odd.withColumn("size", mixing.word_count(F.col("text")))
    mixed = mixing.mix(sized, "doc_id", "source", "size").collect()
    assert len(mixed) == 12 and all(0 <= r["copies"] <= 3 for r in mixed)
    assert {r["group"] for r in mixed} == {"g"}
    assert mixing.mix(none, "doc_id", "source", "size").count() == 0


def test_packing(odd, none):
    pieces = packing.pack(odd, "doc_id", "text", queries.tokenizer_path()).collect()
    assert {p["doc_id"] for p in pieces} == {*range(1, 11), None}
    assert all(p["doc_tokens"] == 1 for p in pieces if p["doc_id"] in (3, 4, 6))
    assert packing.pack(none, "doc_id", "text", queries.tokenizer_path()).count() == 0


def test_minhash(odd, none):
    rows = minhash.near_duplicates(odd, "doc_id", "text").collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and found[2]["component_id"] == 1 and not found[2]["kept"]
    assert all(found[i]["kept"] and found[i]["n_shingles"] == 0 for i in (3, 4, 6))
    assert found[5]["n_shingles"] == 1 and found[1]["n_shingles"] == 56
    assert minhash.near_duplicates(none, "doc_id", "text").count() == 0


def test_lines(odd, none):
    out = fuzzy_lines.dedup_lines(odd, "doc_id", "text")
    assert ids(out) == ALL and set(odd.columns) <= set(out.columns)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] == LINE and texts[2] == "" and texts[3] is None and texts[6] == "\n\n \t\n" and texts[None] == LINE
    assert fuzzy_lines.dedup_lines(none, "doc_id", "text").count() == 0


def test_lines_of_other_texts_under_one_id_stay(spark):
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta\nsecond words stay"), (2, "a line nobody else has\nanother rare line")]
    out = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    want = {(1, "alpha beta gamma delta", 1, 0), (2, "second words stay", 2, 1), (2, "a line nobody else has\nanother rare line", 2, 0)}
    assert {(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out} == want


def test_paragraphs_of_other_texts_under_one_id_stay(spark):
    words = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcd"]
    rows = [(1, words[0]), (2, f"{words[0]}\n{words[1]}"), (2, f"{words[2]}\n{words[3]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = paragraphs.without_repeats(docs, "doc_id", "text", paragraphs.repeated_paragraphs(docs, "doc_id", "text"))
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(1, words[0]), (2, words[1]), (2, f"{words[2]}\n{words[3]}")}


def test_near_dedup_drops_no_other_text_of_an_id(spark):
    words = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(1, words[0]), (2, words[0] + " more"), (2, words[1]), (2, words[1]), (2, words[2]), (None, words[2]), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert {(r["doc_id"], r["text"]) for r in kept if r["text"]} == {(1, words[0]), (2, words[1]), (2, words[2]), (None, words[2])}
    assert len(kept) == 6


def test_paragraphs(odd, none):
    rows = paragraphs.repeated_paragraphs(odd, "doc_id", "text").collect()
    assert sorted((r["doc_id"] or 99, r["kept"]) for r in rows) == [(1, True), (2, False), (2, False), (99, False)]
    assert paragraphs.repeated_paragraphs(none, "doc_id", "text").count() == 0


def test_personal_data(odd, none):
    rows = pii.personal_data(odd, "doc_id", "text").collect()
    assert len(rows) == 12 and sum(len(r["base_email"]) for r in rows) == 1
    assert pii.personal_data(none, "doc_id", "text").count() == 0


def test_pages(odd, none):
    out = html_text.extract(odd, "text", "lang")
    assert out.count() == 12 and {r["lang"] for r in out.filter("doc_id in (3, 4, 6)").collect()} == {""}
    assert html_text.extract(none, "text").count() == 0


def test_archives(odd, none, spark, tmp_path):
    for name, rows in (("odd", odd), ("none", none)):
        pages = rows.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
        warc.write_warc(queries.page_records(pages), str(tmp_path / name))
        assert warc.read_warc(spark, str(tmp_path / name)).count() == rows.count()


def test_codes(spark):
    rows = [(None, 5), (1, None), (2, 5), (3, 5), (3, 5), (4, -1)]
    codes = spark.createDataFrame(rows, "vec_id long, code long")
    near = hamming.nearest(codes, codes, "vec_id", "code", k=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["neighbour_id"], r["distance"]) for r in near] == [
        (2, 3, 0), (2, 4, 62), (3, 2, 0), (3, 4, 62), (4, 2, 62), (4, 3, 62),
    ]
    empty = codes.limit(0)
    assert hamming.nearest(empty, codes, "vec_id", "code", k=2).count() == 0
    assert hamming.nearest(codes, empty, "vec_id", "code", k=2).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, "")
    if name != "sequence_packing":
        assert out.columns == odd.columns
        assert {r["group"] for r in out.collect()} == {"g"} and {r["copies"] for r in out.collect()} == {5}
    assert stage(spark, none, "").count() == 0
