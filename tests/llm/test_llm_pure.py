"""The parts that run without Spark, against plain versions of themselves."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from credsieve.llm import common, fuzzy_lines, html_text, minhash, packing, paragraphs, pii, quality, queries, warc
from credsieve.llm.common import WordHashes, shingle_set


# --- packing ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokens():
    return packing.TokenBytes(queries.tokenizer_path())


PARTS = ["a", "Bc", "é", "É", "ß", "İ", "Σ", "日本", " ", "\n", "\t", "\x1c", " ", ".", ",", "'", "'s", "'LL", "9", "12", "$$", "-", "<|endoftext|>", "ﬁ", "́"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_chunks_give_the_ids_of_the_whole_text(tokens, text):
    assert np.frombuffer(tokens.of(text), "<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_latin_words_are_entries_of_the_model(tokens):
    """Every Latin letter, alone, in a word and before marks; none of them takes the whole tokenizer."""
    letters = [c for c in map(chr, range(0x41, 0x180)) if c.isalpha() and c != tokens.DOTTED]
    texts = [t for c in letters for t in (c, f"Stra{c}e", f"{c}{c}o", f"na{c}")]
    whole = [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, ",."]]
    fresh = packing.TokenBytes(queries.tokenizer_path())
    fresh.encoded = {",.": np.asarray(whole[-1], "<u4").tobytes()}.__getitem__
    assert [np.frombuffer(fresh.of(t), "<u4").tolist() for t in texts] == whole[:-1]
    assert [np.frombuffer(fresh.of(f"{t},."), "<u4").tolist() for t in texts] == [w + whole[-1] for w in whole[:-1]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 20))
def test_each_token_is_packed_once_without_padding(sizes, most_open):
    closed = []
    packer = packing.LevelPacker(64, lambda pieces: closed.append([tuple(p) for p in pieces]), most_open)
    for k, n in enumerate(sizes):
        packer.place([k, 0, np.arange(n, dtype="<u4").tobytes()])
    packer.tidy(last=True)
    got = {}
    for pieces in closed:
        total = sum(len(ids) // 4 for _, _, ids in pieces)
        assert total == 64 or total & (total - 1) == 0
        for row, start, ids in pieces:
            got.setdefault(row, []).extend(enumerate(np.frombuffer(ids, "<u4").tolist(), start))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(i, i) for i in range(n)] for k, n in enumerate(sizes)}


def test_the_level_minimises_the_sum_of_squares():
    rng = random.Random(3)
    packer = packing.LevelPacker(16, lambda pieces: None)
    for _ in range(300):
        size = rng.randint(1, 15)

        def after(level):
            counts = packer.counts.copy()
            counts[level] -= level > 0
            counts[level + size] += level + size < 16
            return int((counts[1:16] ** 2).sum())

        options = {level: after(level) for level in range(0, 17 - size) if level == 0 or packer.counts[level]}
        assert options[packer.level(size)] == min(options.values())
        packer.place([0, 0, bytes(4 * size)])


# --- quality ---------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "É#", "\n", " ", "\x0b", "\xa0", "|"]), max_size=40).map("".join))
def test_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    got = dict(zip(quality.MEASURES, quality.measure_text(text, WordHashes()), strict=True))
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
    assert got["n_dup_lines"] == len(lines) - len(set(lines)) and got["n_repeat_words"] == len(repeated)
    assert (got["n_letters"], got["n_upper"]) == (len(re.findall("[A-Za-z]", text)), len(re.findall("[A-Z]", text)))


# --- lines -----------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    assert fuzzy_lines.edit_distance(a, b) == row[-1]


def test_simhash_is_the_majority_of_bits():
    words, known = [b"w" * (i % 17 + 1) + str(i).encode() for i in range(50)], WordHashes()
    starts = np.asarray([0, 1, 20])
    for got, part in zip(fuzzy_lines.sim_hashes(words, starts, known), (words[:1], words[1:20], words[20:]), strict=True):
        weight = lambda w: min(len(w), 12)
        for b in range(64):
            ones = sum(weight(w) for w in part if known[w] >> b & 1)
            assert (int(got) >> b & 1) == (2 * ones > sum(map(weight, part)))


def test_normal_lines():
    lines = list(fuzzy_lines.normal_lines("Call  +1-23, NOW!\n\n...\nÉté 9"))
    assert lines == [(0, [b"call", b"0", b"00", b"now"]), (3, ["été".encode(), b"0"])]


# --- shingles --------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "É", "c"]), max_size=15))
def test_shingle_sets(words):
    low = [w.lower() if w.isascii() else w for w in words]
    want = {tuple(low[i : i + 5]) for i in range(max(1, len(low) - 4))} if low else set()
    assert len(shingle_set(" ".join(words), 5, WordHashes())) == len(want)


@pytest.mark.parametrize("least", [1, 5])
def test_signing_many_paragraphs_is_signing_each(least):
    rng = np.random.default_rng(least)
    texts = [[b"w%d" % w for w in rng.integers(0, 9, n)] for n in rng.integers(least, 40, 50)]
    known = WordHashes()
    shingles, starts = paragraphs.all_shingles(known.of([w for t in texts for w in t]), np.asarray([*map(len, texts)]), 5)
    family = common.hash_family(24, 3)
    got = minhash.band_keys(paragraphs.least_hashes(shingles, starts, *family), 2)
    sets = [common.shingle_set(b" ".join(t).decode(), 5, known) for t in texts]
    assert [g.tolist() for g in got] == [minhash.band_keys(common.min_hashes(s, *family), 2).tolist() for s in sets]


def test_the_agreement_bound_loses_next_to_nothing():
    k = minhash.least_agreement(108, 75)
    from math import comb

    missed = sum(comb(108, i) * 0.75**i * 0.25 ** (108 - i) for i in range(k))
    assert missed <= 1e-9 and 40 < k < 60


# --- pages -----------------------------------------------------------------------------------

ARTICLE = "<h1>Title &amp; more</h1><p>First  part,\nwith text.<p>Second&nbsp;one; <b>bold</b> word.<br>After<ul><li>item<li>other</ul>"
WANT = "Title & more\nFirst part, with text.\nSecond one; bold word.\nAfter\nitem\nother"
AROUND = (
    "<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header><p>Site, name.</p></header><nav><a href=x>Menu</a></nav>"
    "<!-- <p>not this, either.</p> --><div class='ad big'>Buy now, please.</div><aside>Side, text.</aside><div id=sidebar><p>Other, news.</p></div>"
    "{}<form><label>Your mail, please</label><input></form><section class='comments'><p>I, a reader, agree.</p></section>"
    "<div class=\"cookie-notice\">We use, cookies.</div><script>if (a < b) document.write('<p>no, no.</p>')</script><footer>(c) us, 2020.</footer></body></html>"
)


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<article class='post'><div>{}</div></article>"])
def test_main_text(around):
    assert html_text.main_text(AROUND.replace("{}", around.replace("{}", ARTICLE))) == WANT


@pytest.mark.parametrize(
    "article",
    [
        '<article class="post comments-open" data-comment-count="3">{}</article>',
        "<article><div title='the hidden truth'>{}</div></article>",
        "<main><section id='discussion'>{}</section></main>",
        "<article><div class='search-results'>{}</div></article>",
    ],
)
def test_an_article_may_use_the_words_of_other_parts(article):
    assert html_text.main_text(AROUND.replace("{}", article.replace("{}", ARTICLE))) == WANT


def test_headings_and_words_of_an_article_stay_whatever_their_names():
    article = "<article><h2 id='related-work'>Related work</h2><p>Some <span class='notice'>noted</span> text, and more of it.</p></article>"
    assert html_text.main_text(AROUND.replace("{}", article)) == "Related work\nSome noted text, and more of it."


@pytest.mark.parametrize(
    "part",
    [
        "<article class='comment' id='comment-7'><p>I, a reader, agree.</p></article>", "<div class='share'>Share, now.</div>",
        "<div hidden><p>Not, seen.</p></div>", "<p style='display: none'>Not, seen.</p>", "<p class='big hidden'>Not, seen.</p>",
        "<p aria-hidden='true'>Not, seen.</p>", "<div id='newsletter'>Mail, please.</div>",
        "<div class='related'><a href='x'>Another one</a> now</div>",
    ],
)
def test_other_parts_of_an_article_go(part):
    long = "".join(f"<p>Paragraph {i}, with a good deal of text in it, and marks; it goes on for a while.</p>" for i in range(9))
    want = html_text.main_text(AROUND.replace("{}", f"<article>{long}</article>"))
    assert html_text.main_text(AROUND.replace("{}", f"<article>{long}{part}</article>")) == want


@pytest.mark.parametrize("html", [None, "", "<html></html>", "<p", "<!--", "<script>x", "<div><div></p></b>", "<" * 5000, "<b>" * 3000])
def test_broken_pages(html):
    assert isinstance(html_text.main_text(html), str)


def test_nothing_of_a_long_article_is_cut():
    paragraphs = [f"Paragraph {i}, of some text." for i in range(3000)]
    page = AROUND.replace("{}", "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>")
    assert html_text.main_text(page) == "\n".join(paragraphs)


# --- archives --------------------------------------------------------------------------------


def test_members_are_plain_gzip_and_tell_their_length():
    row = {"record_type": "response", "record_id": "urn:page:1", "target_uri": "http://a/\r\nX: y", "refers_to": None, "payload": b"<p>hi</p>"}
    record = warc.record_bytes(row, "2024-01-01T00:00:00Z")
    packed = warc.member(record)
    assert gzip.decompress(packed) == record and warc.member_length(packed) == len(packed)
    head, _, block = record.partition(b"\r\n\r\n")
    fields = warc.header_columns(warc.header_fields(head))
    assert fields["target_uri"] == "http://a/%0D%0AX: y" and fields["content_length"] == len(block) - 4
    assert fields["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"<p>hi</p>").digest()).decode()


# --- boosting --------------------------------------------------------------------------------


def test_trees_learn_a_conjunction_and_thresholds_hold():
    rows = [(bits, 90 if bits & 3 == 3 else 1, 1 if bits & 3 == 3 else 90) for bits in range(16)]
    model = pii.boosted(rows)
    score = lambda bits: sum(pii.tree_value(t, bits) for t in model)
    lowest = pii.calibrated(model, rows, 0.95)
    assert {bits for bits, _, _ in rows if round(score(bits), 6) >= lowest} == {3, 7, 11, 15}
    assert pii.calibrated(model, [(b, n, y) for b, y, n in rows], 0.999) is None


def line_table(texts):
    columns = [pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "text"])


def test_lines_and_runs_travel_in_few_rows():
    """Two thousand runs and more are a few packets, and all that was packed comes out of them."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.random())[2:5].translate(str.maketrans("0123456789", "klmnopqrst")) for _ in range(40)) for _ in range(120)]
    rarity = np.zeros(fuzzy_lines.CELLS, np.uint8)
    out = list(fuzzy_lines.line_worker(80, 64, rarity, 3)(iter([line_table([*texts, texts[0]])])))
    rows = [r for b in out for r in b.to_pylist()]
    assert len(rows) <= 6 and sum(r["rows"] for r in rows if r["lines"]) == 121
    runs = [fuzzy_lines.unpacked(r["packet"], r["rows"], fuzzy_lines.RUNS) for r in rows if not r["lines"]]
    assert sum(len(c[0]) for c in runs) > 2000 and len({i for c in runs for i in c[1].tolist()}) == 120
    lines = [fuzzy_lines.unpacked(r["packet"], r["rows"], fuzzy_lines.LINES) for r in rows if r["lines"]]
    assert sorted(i for c in lines for i in c[1].tolist()) == list(range(121))
    assert all((c[4] == 40).all() for c in lines)


@pytest.mark.parametrize("values", [6, 1 << 20])
def test_runs_of_many_lines_are_chosen_like_those_of_one(values):
    rng = np.random.default_rng(values)
    for shortest, width in ((4, 2), (9, 3), (40, 3), (70, 3)):
        sizes = rng.integers(shortest, shortest * 9 // 8 + 1, 30)
        counts, edits = sizes - width + 1, 20 * (100 * sizes // 80) // 100
        ranked = rng.integers(0, values, (30, counts.max())).astype(np.uint64)
        ranked[np.arange(counts.max()) >= counts[:, None]] = np.iinfo(np.uint64).max
        last = fuzzy_lines.last_of_each(ranked, counts, width, edits)
        for row, n, k, bound in zip(ranked, counts.tolist(), edits.tolist(), last, strict=True):
            apart = lambda b: fuzzy_lines.disjoint(np.flatnonzero(row[:n] <= b).tolist(), width)  # noqa: B023, E731
            assert apart(bound) > min(k, apart(row[:n].max()) - 1)
            assert values < 10 or bound == fuzzy_lines.last_held_out(row[:n], width, k)


def test_words_have_one_hash_wherever_they_stand():
    words = [b"a", b"ab", b"ba", "é".encode(), b"x" * 200_000, *(b"w%d" % k for k in range(40_000)), b"ab", b"a"]
    hashes = fuzzy_lines.word_hasher()(b"".join(w + b" " for w in words))
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words)) == len(words) - 2
    assert hashes[0] == hashes[-1] and hashes[1] == hashes[-2]
    assert fuzzy_lines.word_hasher()(b"ab ").tolist() == [hashes[1]]


def test_alike_is_edit_distance():
    rng = random.Random(8)
    for _ in range(400):
        a = [rng.choice([b"a", b"b", b"c", b"d", b"e", b"f"]) for _ in range(rng.randrange(1, 30))]
        b = [w if rng.random() < 0.85 else rng.choice([b"a", b"x"]) for w in a if rng.random() < 0.95] or [b"a"]
        longest, far = max(len(a), len(b)), fuzzy_lines.edit_distance(a, b)
        assert fuzzy_lines.alike(b" ".join(a), b" ".join(b), 80) == (100 * (longest - far) >= 80 * longest)
        assert (fuzzy_lines.edit_distance(a, b, 3) <= 3) == (far <= 3)


@pytest.mark.parametrize(("small", "each"), [(256, 4), (256, 0), (1, 4)])
def test_met_runs_lose_no_pair(monkeypatch, small, each):
    """A pair that may be alike is made at once, or both lines stay in an open bucket."""
    monkeypatch.setattr(fuzzy_lines, "SMALL", small)
    monkeypatch.setattr(fuzzy_lines, "EACH", each)
    rng = np.random.default_rng(2)
    ids, keys = rng.integers(-60, 60, 700), rng.integers(0, 90, 700)
    n = 10 + ids % 7
    lo = (ids * 31 + keys * 17) % 8
    rows = [keys.astype(np.uint64), ids.astype(np.int64), n.astype(np.int32), lo.astype(np.int32), (lo + ids % 2).astype(np.int32)]
    a, b, star, key, member = fuzzy_lines.met_runs([np.concatenate([c, c[:50]]) for c in rows], 80)
    made, left = set(zip(a.tolist(), b.tolist(), strict=True)), set(zip(key.tolist(), member.tolist(), strict=True))
    assert len(made) == len(a) and star.any() and (a > b).all()
    want = {
        (int(k), max(int(ids[i]), int(ids[j])), min(int(ids[i]), int(ids[j])))
        for k in set(keys.tolist()) for i in np.flatnonzero(keys == k) for j in np.flatnonzero(keys == k)
        if fuzzy_lines.compatible(rows, np.array([i]), np.array([j]), 80)[0]
    }
    assert len(want) > 300 and all((x, y) in made or {(k, x), (k, y)} <= left for k, x, y in want)
    assert made <= {(x, y) for _, x, y in want}
