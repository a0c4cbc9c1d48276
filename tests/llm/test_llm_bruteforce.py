"""Operators against plain versions on small tables with groups of copies."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from credsieve.llm import fuzzy_lines, hamming, linking, minhash, mixing, packing, paragraphs, pii, quality, queries, warc
from credsieve.llm.common import CLEANED, WordHashes, stash

VOCABULARY = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(VOCABULARY) + "x" if rng.random() < share else w for w in text.split(" "))


def groups(items, linked):
    """Smallest index reachable for each item."""
    parent = list(range(len(items)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(items))]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


@pytest.fixture(scope="module")
def family():
    """One text copied with few to many edits, some exact copies, and others."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    texts = [edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04])) for _ in range(60)]
    texts += [base] * 5 + [sentence(rng, rng.randint(1, 80)) for _ in range(30)] + [base.upper(), base + " " + sentence(rng, 30)]
    rng.shuffle(texts)
    return texts


def test_near_duplicates(spark, family):
    sets = [shingles(t) for t in family]
    want = groups(sets, similar)
    assert 10 < len(set(want)) < 80
    docs = spark.createDataFrame(list(enumerate(family)), "doc_id long, text string")
    rows = minhash.near_duplicates(docs, "doc_id", "text").collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(want))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(sets[r["doc_id"]]) for r in rows)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    nodes = sorted({n for a, b in links if a != b for n in (a, b)})
    linked = {frozenset(x) for x in links}
    want = {n: nodes[g] for n, g in zip(nodes, groups(nodes, lambda a, b: frozenset((a, b)) in linked), strict=True)}
    got = linking.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want)


def shuffle_files(spark):
    names = [f.getName() for f in _each(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())]
    return {n for n in names if n.startswith("shuffle_")}


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_stashing_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANED)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(r["count"] for r in stash(rows, "counts").collect()) == [142] + [143] * 6
    assert shuffle_files(spark) <= before and spark.conf.get(CLEANED) == setting


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_shared_buckets_over_batches_of_any_size(size):
    rng = np.random.default_rng(size)
    rows = sorted(zip(rng.integers(0, 90, 300).tolist(), rng.integers(0, 3, 300).tolist(), strict=True)) + [(91, 5)] * 3 + [(92, 1), (92, 1), (92, 2)]
    table = pa.table({"id": [i for _, i in rows], "key": [k for k, _ in rows]})
    got = [r for b in linking.shared_buckets(iter(table.to_batches(size))) for r in zip(b["key"].to_pylist(), b["id"].to_pylist(), strict=True)]
    assert got == [r for r in sorted(set(rows)) if len({i for k, i in rows if k == r[0]}) > 1]


def test_members_that_meet_are_shuffled_once(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 1), (3, 7)], "key long, id long")
    alive = linking.alive_members(rows)
    assert alive._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, alive.collect())) == [(1, 1), (1, 2)]


def test_open_pairs_are_made_in_one_of_their_buckets(spark):
    """Ids 1 to 3 share five buckets, 3 and 4 two; 1 and 2 are one group already."""
    places = [(k, i) for k in range(10, 15) for i in (1, 2, 3)] + [(k, i) for k in (20, 21) for i in (3, 4)]
    group = {1: 1, 2: 1, 3: 3, 4: 4}
    rows = linking.contested(spark.createDataFrame([(k, i, group[i]) for k, i in places], "key long, id long, component long"))
    facts = rows.groupBy("id").agg(F.collect_set("key").alias("keys"))
    pairs = linking.cross_pairs(rows, facts, linking.shared_first).collect()
    assert sorted(map(tuple, pairs)) == [(3, 1), (3, 2), (4, 3)]


def test_paragraphs(spark, family):
    docs = [(i, "\n".join(family[3 * i : 3 * i + 3])) for i in range(len(family) // 3)]
    places = [(i, k, p) for i, t in docs for k, p in enumerate(t.split("\n")) if len(p.split()) >= 25]
    want = groups([shingles(p) for _, _, p in places], similar)
    often = {g for g in want if want.count(g) > 1}
    expected = {(i, k, places[g][:2] == (i, k)) for (i, k, _), g in zip(places, want, strict=True) if g in often}
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = paragraphs.repeated_paragraphs(table, "doc_id", "text")
    assert {(r["doc_id"], r["paragraph"], r["kept"]) for r in rows.collect()} == expected
    left = paragraphs.without_repeats(table, "doc_id", "text", rows).collect()
    gone = sum(not kept for _, _, kept in expected)
    assert sum(len((r["text"] or "").split("\n")) for r in left if r["text"]) <= sum(len(t.split("\n")) for _, t in docs) - gone + len(docs)


def test_short_paragraphs(spark):
    """Lines from the width of a shingle up, exact copies and near ones."""
    rng = random.Random(3)
    bases = [sentence(rng, n) for n in (4, 5, 6, 10, 16, 24)]
    texts = [t for b in bases for t in (b, b.upper(), b + " more")] + [sentence(rng, 12)]
    sets = [shingles(t) if len(t.split()) >= 5 else set() for t in texts]
    want = groups(sets, similar)
    expected = {(i, g == i) for i, g in enumerate(want) if want.count(g) > 1}
    assert len(expected) > 12
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["kept"]) for r in paragraphs.repeated_paragraphs(table, "doc_id", "text").collect()} == expected


def test_fuzzy_lines(spark, family):
    docs = [(i, "\n".join(family[3 * i : 3 * i + 3]) + "\n12, Oak Street!\n7 oak street") for i in range(len(family) // 3)]
    places = [(i, k, w) for i, t in docs for k, w in fuzzy_lines.normal_lines(t)]
    known = WordHashes()
    hashes = [int(fuzzy_lines.sim_hashes(w, np.asarray([0]), known)[0]) for _, _, w in places]

    def linked(a, b):
        (x, h), (y, g) = a, b
        return x == y or ((h ^ g).bit_count() <= fuzzy_lines.DISTANCE and fuzzy_lines.alike(b" ".join(x), b" ".join(y), fuzzy_lines.PERCENT))

    want = groups([(w, h) for (_, _, w), h in zip(places, hashes, strict=True)], linked)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = fuzzy_lines.line_groups(table, "doc_id", "text").collect()
    assert {(r["doc_id"], r["line"]): r["kept"] for r in got} == {(i, k): places[g][:2] == (i, k) for (i, k, _), g in zip(places, want, strict=True)}
    texts = {r["doc_id"]: r["text"] for r in fuzzy_lines.dedup_lines(table, "doc_id", "text").collect()}
    kept = {(i, k) for (i, k, _), g in zip(places, want, strict=True) if places[g][:2] == (i, k)}
    assert texts == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) in kept) for i, t in docs}


def test_fuzzy_lines_misses_no_pair(spark):
    """Lines of all lengths with up to a fifth of their words changed, put in or left out."""
    rng, lines = random.Random(9), []
    for n in [*range(1, 31), 40, 55, 80, 130]:
        base = sentence(rng, n).split()
        lines.append(base)
        for _ in range(6):
            line = list(base)
            for at in sorted(rng.sample(range(n), n // 5), reverse=True):
                line[at : at + 1] = rng.choice([[], [line[at], rng.choice(VOCABULARY)], [rng.choice(VOCABULARY) + "x"]])
            lines.append(line)
    lines = [next(words for _, words in fuzzy_lines.normal_lines(" ".join(x))) for x in lines if x]
    rng.shuffle(lines)
    alike = lambda a, b: fuzzy_lines.alike(b" ".join(a), b" ".join(b), 80)
    want = groups(lines, alike)
    assert sum(lines[i] != lines[g] for i, g in enumerate(want)) > 100
    table = spark.createDataFrame([(i, b" ".join(x).decode()) for i, x in enumerate(lines)], "doc_id long, text string")
    got = fuzzy_lines.line_groups(table, "doc_id", "text").collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {i: g == i for i, g in enumerate(want)}


def test_nearest_codes(spark):
    rng = np.random.default_rng(4)
    codes = rng.integers(-(1 << 63), (1 << 63) - 1, 300, np.int64)
    codes[100:150] = codes[0]
    codes[150:200] = codes[1] ^ (1 << rng.integers(0, 63, 50))
    table = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "vec_id long, code long")
    queries_table = table.filter("vec_id % 20 = 0")
    want = []
    for q in range(0, 300, 20):
        order = sorted((int(codes[q] ^ codes[i]) & (1 << 64) - 1).bit_count() * 1000 + i for i in range(300) if i != q)[:5]
        want += [(q, x % 1000, x // 1000, k) for k, x in enumerate(order, 1)]
    got = hamming.nearest(table, queries_table, "vec_id", "code", k=5).collect()
    assert sorted((r["query_id"], r["neighbour_id"], r["distance"], r["rank"]) for r in got) == sorted(want)


def reshared(sizes, weights):
    """Targets by sharing the excess again and again."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        targets = [3.0 * s if i in capped else left * weights[i] / weight for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(targets) if t > 3 * sizes[i] and i not in capped}
        if not over:
            return targets
        capped |= over


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "b", "b", "c", "é", None]), rng.choice([5, 7, 7, 7, 30, 200])) for i in range(4000)] + [(9999, "tiny", 3)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long")
    names = sorted({s for _, s, _ in rows if s is not None}) + [None]
    sizes = [sum(n for _, s, n in rows if s == x) for x in names]
    targets = dict(zip(names, reshared(sizes, [1 + k % 3 for k in range(len(names))]), strict=True))
    for bucket_rows in (100, 1_000_000):
        mixed = mixing.mix(table, "doc_id", "source", "size", bucket_rows=bucket_rows).collect()
        assert len(mixed) == len(rows)
        for name, size in zip(names, sizes, strict=True):
            own = [r for r in mixed if r["source"] == name]
            assert all(r["source_size"] == size and abs(r["target"] - targets[name]) < 1e-6 for r in own)
            assert all(0 <= r["copies"] <= 3 for r in own)
            assert abs(sum(r["copies"] * r["size"] for r in own) - targets[name]) <= max(r["size"] for r in own)


def test_packed_ids(spark, family):
    docs = spark.createDataFrame(list(enumerate(family * 3)), "doc_id long, text string")
    rows = packing.pack(docs, "doc_id", "text", queries.tokenizer_path(), window=256).collect()
    tokens = packing.TokenBytes(queries.tokenizer_path()).tokenizer
    ids, fill = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert len(ids.setdefault(r["doc_id"], [])) == r["start"]
        ids[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert ids == {i: [*tokens.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(family * 3)}
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0


def test_archive_round_trip(spark, tmp_path):
    big, other = "<p>" + "é" * 600 + "</p>", "<b>" + "x" * 2000
    pages = spark.createDataFrame(
        [(1, "http://a", big), (2, "http://b", "small"), (3, None, big), (4, "http://c", "small"), (5, "http://d", other), (6, "http://e", None), (2, "http://b", "small")],
        "page_id long, url string, html string",
    )
    path = str(tmp_path / "warc")
    warc.write_warc(queries.page_records(pages), path)
    rows = {r["record_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert rows["urn:page:1"]["record_type"] == "revisit" and rows["urn:page:1"]["refers_to"] == "urn:page:3"
    assert rows["urn:page:1"]["payload"] == b"" and rows["urn:page:1"]["http_length"] == len(big.encode())
    assert bytes(rows["urn:page:3"]["payload"]) == big.encode() and rows["urn:page:3"]["target_uri"] is None
    assert sum(r["record_type"] == "response" for r in rows.values()) == 5 and rows["urn:page:6"]["http_length"] == 0
    chosen = warc.read_warc(spark, path, ["record_id", "record_type"]).filter("record_type = 'revisit'")
    assert [r["record_id"] for r in chosen.collect()] == ["urn:page:1"]
    assert "Filter (" not in chosen._jdf.queryExecution().executedPlan().toString()
    assert warc.read_warc(spark, path, ["file"]).filter("length(file) > 0").count() == 7


def test_plain_archives_and_broken_ones(spark, tmp_path):
    rows = [{"record_type": "response", "record_id": f"urn:page:{i}", "target_uri": None, "refers_to": None, "payload": b"p" * i} for i in (0, 70_000, 3)]
    records = [warc.record_bytes(r, "2024-01-01T00:00:00Z") for r in rows]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    import gzip

    (tmp_path / "foreign.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = warc.read_warc(spark, str(tmp_path), ["record_id", "payload"]).collect()
    assert sorted(len(r["payload"]) for r in got) == [0, 0, 3, 3, 70_000, 70_000]
    (tmp_path / "broken.warc").write_bytes(records[0][:-30])
    with pytest.raises(Exception, match="not a WARC record"):
        warc.read_warc(spark, str(tmp_path / "broken.warc")).collect()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data(spark):
    rng = random.Random(1)
    texts = [
        "a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112", "x" * 50_000 + "@", "9" * 50_000,
        "+1+1234567890 é+33 1 23 45 67 89 😀 a.b@c..d", "1.2.3.4 " * 500, "", None, "+1 " + "(" * 3000,
    ]
    texts += [f"please call me at +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} tomorrow" for _ in range(200)]
    texts += [f"order {rng.randint(10**9, 10**10 - 1)} of the day, part {rng.randint(10**9, 10**10 - 1)} too" for _ in range(100)]
    texts += ["please call me at (523) 555-1055 tomorrow"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.personal_data(docs, "doc_id", "text").collect()}
    for i, text in enumerate(texts):
        for kind, pattern in BASE.items():
            want = [m.span() for m in re.finditer(pattern, text or "") if holds(kind, m[0])]
            assert [tuple(s) for s in rows[i][f"base_{kind}"]] == want, (i, kind)
    assert [tuple(s) for s in rows[len(texts) - 1]["added_phone"]] == [(18, 32)]
    assert not any(rows[i]["added_phone"] for i in range(208, 308))


def test_ablations(spark):
    rows = [(0, 3), (1, 5), (2, 2), (3, 1), (8, 7)]
    book = spark.createDataFrame([(m,) for m, n in rows for _ in range(n)], "failed long")
    got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in quality.ablations(book, "base").collect()}
    assert got == {"few_words": (6, 5, 3 + 7 + 5), "repeated_words": (3, 2, 3 + 7 + 2)}


def test_rows_carry_the_ablation_of_their_first_rule(spark):
    book = spark.createDataFrame([(0, "x"), (2, "x"), (3, "x"), (2, "x"), (4, "x")], "failed long, rule string")
    rows = [tuple(r) for r in quality.with_ablations(book, "base").collect()]
    assert sorted(rows, key=str) == sorted(
        [(0, "", 0, 0, 0), (4, "", 0, 0, 0), (3, "few_words", 1, 0, 2), *[(2, "repeated_words", 3, 2, 4)] * 2], key=str
    )
    assert quality.with_ablations(book.limit(0), "base").count() == 0


def test_mix_takes_the_same_rows_whatever_the_buckets(spark):
    rows = [(i * 37 % 501, "abc"[i % 3], i % 2 + 3) for i in range(500)] + [(None, "a", 3)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long")
    taken = [
        sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["copies"]) for r in mixing.mix(table, "doc_id", "source", "size", bucket_rows=n).collect())
        for n in (1_000_000, 100, 7)
    ]
    assert taken[0] == taken[1] == taken[2] and len({c for _, c in taken[0]}) > 1


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, sf)
        assert name == "sequence_packing" or at.columns == docs.columns
        at = spark.createDataFrame(at.collect(), at.schema)
        if name == "quality_rules":
            assert at.count() < before.count() and quality.ledger(at, "text").filter(~quality.passes("v1")).isEmpty()
        if name == "line_dedup":
            assert at.count() == before.count()
            assert fuzzy_lines.line_groups(at, "doc_id", "text").filter(~F.col("kept")).isEmpty()
        if name == "near_dedup":
            assert minhash.near_duplicates(at, "doc_id", "text").filter(~F.col("kept")).isEmpty()
    assert {r[0] for r in at.select("doc_id").distinct().collect()} <= {r[0] for r in before.select("doc_id").collect()}
