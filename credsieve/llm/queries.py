"""The operators' registered queries over the given tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.llm import alignment, fuzzy_lines, hamming, html_text, minhash, mixing, packing, paragraphs, phrases, pii, quality, toxicity, warc
from credsieve.llm.common import stash, table
from credsieve.scratch import shared_folder


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), "html")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to archives in the shared folder, and back from there."""
    path = shared_folder(spark, "warc")
    warc.write_warc(page_records(table(spark, sf_dir, "pages")), path)
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).cast("long")
    whole = warc.read_warc(spark, path, ["record_type", "record_id", "payload"]).filter("record_type = 'response'")
    responses = whole.select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    heads = warc.read_warc(spark, path, ["record_type", "record_id", "refers_to", "payload_sha1", "http_length"])
    revisits = heads.filter("record_type = 'revisit'").select(
        page("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"),
    )
    return responses.union(revisits)


LEAST_REVISITED = 1000


def page_records(pages: DataFrame) -> DataFrame:
    """Of pages with equal payloads of some size, the one with the largest id is the response.

    Payloads are compared by their SHA-256, summed up before they are joined, so that the texts do
    not travel when few are repeated. Rows with the largest id are responses, each of them; a null
    id is smaller than others.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    big = F.octet_length("payload") >= LEAST_REVISITED
    rows = rows.withColumn("same", F.when(big, F.sha2("payload", 256)))
    tops = rows.filter(big).groupBy("same").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(tops.filter(F.col("n") > 1).drop("n"), "same", "left")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), "target_uri",
        F.when(again, urn("top")).alias("refers_to"), "payload",
    )


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest sign codes for every vector whose id is divisible by 100, against all vectors."""
    codes = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code("embedding").alias("code"))
    codes = stash(codes, "hamming-codes")
    return hamming.nearest(codes, codes.filter(F.col("vec_id") % 100 == 0), "vec_id", "code", k=10)


def op5_rule_bitmask_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents"), "text").select("doc_id", "measures", "failed")
    book = quality.with_ablations(stash(book, "ledger"), quality.CURRENT)
    digest = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return book.select(
        "doc_id", *[f"measures.{m}" for m in digest], (~quality.passes("base")).alias("base_failed"),
        quality.passes(quality.CURRENT).alias("kept"), F.col("failed").alias("failed_rules"),
        "rule", "n_failed", "n_only", "n_kept_without",
    )


def op6_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stash(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "mix-sizes")
    mixed = mixing.mix(sized, "doc_id", "source", "size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_boosted_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"), "doc_id", "text")
    base, added = [f"base_{k}" for k in pii.KINDS], [f"added_{k}" for k in pii.KINDS]
    return found.select(
        "doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(base + added).alias("spans"),
        F.size(F.concat(*added)).cast("long").alias("n_added"),
    )


def op8_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return deduped.select("doc_id", "n_lines", "n_removed", "text")


def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")


def op11_token_byte_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), "doc_id", "text", *paths)


def op12_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text")


def op13_top_order_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), "lang", "text", first=FIRST_PHRASES)


FIRST_PHRASES = 2000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_tag_path_text, op2_warc, op3_sum_of_squares_packing, op4_multi_index_hashing, op5_rule_bitmask_ledger, op6_systematic_mixing, op7_boosted_personal_data, op8_tensored_minhash,
        op9_fuzzy_lines, op10_paragraph_minhash, op11_token_byte_incidence, op12_compression_distance, op13_top_order_phrases,
    )
}

SIGNS = "list_sum(list_transform(range(1, 65), lambda i: ((a.embedding[i] > 0) <> (b.embedding[i] > 0))::INT))"
WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_multi_index_hashing": f"""
with near as (
    select a.vec_id as query_id, b.vec_id as neighbour_id, ({SIGNS})::INT as distance
    from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), ranked as (
    select *, row_number() over (partition by query_id order by distance, neighbour_id)::INT as rank from near
)
select * from ranked where rank <= 10
""",
    "op5_rule_bitmask_ledger": f"""
with d as (
    select doc_id, coalesce(text, '') as t, coalesce({WORDS}, []) as w from documents
), windows as (
    select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
    from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)
), repeated as (
    select doc_id, count(distinct p) as n from (
        select doc_id, unnest([i, i + 1, i + 2]) as p
        from (select *, count(*) over (partition by doc_id, g) as c from windows) where c > 1
    ) group by doc_id
), lines as (
    select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d
), measured as (
    select d.doc_id, len(w)::BIGINT as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT as n_symbols,
        len(l)::BIGINT as n_lines, (len(l) - len(list_distinct(l)))::BIGINT as n_dup_lines,
        coalesce(r.n, 0)::BIGINT as n_repeat_words,
        length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) as letters,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as upper
    from d join lines using (doc_id) left join repeated r using (doc_id)
), failed as (
    select *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
        + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
        + 16 * (100 * upper > 30 * letters)::BIGINT + 32 * (word_chars < 2 * n_words)::BIGINT
        + 64 * (word_chars > 12 * n_words)::BIGINT)::BIGINT as failed_rules
    from measured
), bits as (
    select * from (values {", ".join(f"('{r}', {1 << b})" for r, b in quality.BITS.items())}) as v(rule, bit)
), ablated as (
    select rule, count(*) filter (where failed_rules & bit <> 0) as n_failed, count(*) filter (where failed_rules = bit) as n_only,
        count(*) filter (where failed_rules & ~bit = 0) as n_kept_without
    from failed, bits group by rule
), named as (
    select *, (select arg_min(rule, bit) from bits where failed_rules & bit <> 0) as rule from failed
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules & 3 <> 0 as base_failed,
    failed_rules = 0 as kept, failed_rules, coalesce(rule, '') as rule,
    coalesce(n_failed, 0) as n_failed, coalesce(n_only, 0) as n_only, coalesce(n_kept_without, 0) as n_kept_without
from named left join ablated using (rule)
""",
    "op6_systematic_mixing": f"""
with sized as (
    select doc_id, source, coalesce(len({WORDS}), 0)::BIGINT as size from documents
), sources as (
    select source, sum(size)::BIGINT as source_size,
        (row_number() over (order by source is null, source) - 1) % 3 + 1 as weight
    from sized group by source
), shares as (
    select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over before, 0))::DOUBLE
        / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as share
    from sources
    window before as (
        order by 3 * source_size / weight, source is null, source rows between unbounded preceding and 1 preceding
    )
), targets as (
    select source, source_size, least((3 * source_size)::DOUBLE, max(share) over () * weight) as target,
        ('0x' || substr(sha256(coalesce('mix=' || source, 'mix')), 1, 5))::INT / 1048576.0::DOUBLE as start
    from shares
), placed as (
    select s.doc_id, s.size, t.source_size, t.target, t.start,
        case when t.source_size > 0 then t.target / t.source_size else 0.0 end::DOUBLE as rate,
        row_number() over (partition by s.source order by s.size, s.doc_id) as place
    from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
    (least(floor(start + rate * place) - floor(start + rate * (place - 1)), ceil(rate)) * size)::BIGINT as taken
from placed
""",
    "op13_top_order_phrases": r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), worded as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), totals as (
    select lang, sum(len(w))::BIGINT as n from worded group by lang
), grams as (
    select lang, size, w[i:i + size - 1] as ws
    from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from worded, range(1, 5) as s(size))
), counts as (
    select lang, ws, count(*)::BIGINT as a from grams group by lang, ws having count(*) >= 30
), cuts as (
    select lang, ws, a, unnest(range(1, len(ws))) as k from counts where len(ws) > 1
), scored as (
    select c.lang, c.ws, c.a, c.k, h.a as l, t.a as r, (2000000::HUGEINT * c.a // (h.a::HUGEINT + t.a))::BIGINT as score
    from cuts c join counts h on h.lang = c.lang and h.ws = c.ws[1:c.k] join counts t on t.lang = c.lang and t.ws = c.ws[c.k + 1:]
), lowest as (
    select * from scored qualify row_number() over (partition by lang, ws order by score, k) = 1
), parts as (
    select lang, a, ws[i:i + size - 1] as ws
    from (select lang, a, ws, size, unnest(range(1, len(ws) - size + 2)) as i from counts, range(2, 4) as s(size) where len(ws) > size)
), inside as (
    select lang, ws, max(a) as longer from parts group by lang, ws
), ranked as (
    select l.lang, array_to_string(l.ws, ' ') as phrase, l.a, l.l, l.r, n, score
    from lowest l left join inside i on i.lang = l.lang and i.ws = l.ws join totals t on t.lang = l.lang
    where 100::HUGEINT * coalesce(longer, 0) < 80::HUGEINT * l.a
), numbered as (
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from ranked
)
select * from numbered where rank <= 2000
""",
}
