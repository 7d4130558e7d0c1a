"""Every text operator against brute force, over small tables with nulls, blanks, long texts, copies and clashing columns."""

from __future__ import annotations

import hashlib
import random
import time
import tracemalloc
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hashmark.llm import bpe, fingerprint, langid, lines, lmscore, minhash, packing, quality, suffix, toxicity
from hashmark.llm.components import components
from hashmark.llm.tables import labels as read_labels
from hashmark.llm.textbytes import flat, hashes, words

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n int, line string, name string, part int, at long, "
    "h1 string, words string, `group` string, length string, label string"
)


def _rows():
    """About 60 documents: invented words, copies, near copies, shared passages and every odd case."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghiéß") for _ in range(rng.randrange(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))

    passage = prose(70)
    texts = [None, "", " \t\n ", "one", "one two", "aaaa " * 300, "x" * 900, prose(9000)]
    texts += [prose(rng.randrange(60, 160)) for _ in range(20)]
    texts += [texts[10], texts[10], texts[11] + " tail"]
    for k in range(8):
        near = texts[12].split(" ")
        for _ in range(k // 2):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    texts += [prose(60) + "\n" + passage + "\n" + prose(60) for _ in range(6)]
    texts += ["common line here\n" + prose(70) for _ in range(4)] + ["é" * 150 + prose(60), "é" * 150 + prose(60)]
    rows = [(k + 1, t) for k, t in enumerate(texts)]
    rows += [rows[15], rows[15], rows[0]]  # repeated rows
    return rows


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    other = ("en", "s", 0, 9, "k", 1, "l", "nm", 2, 3, "h", "w", "g", "ln", "lb")
    return spark.createDataFrame([(i, t, *other) for i, t in rows] + [(None, "no id at all " * 30, *other)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect() if r["doc_id"] is not None}


def split(text):
    return re.findall(WORD, text or "")


def test_word_hashes_agree_with_python():
    texts = ["a b", "", None, "b  a\x0bab\ta", "  ", "é a"]
    data, offsets = flat(pa.array(texts))
    starts, lengths, row = words(data, offsets)
    spelled = [bytes(data[s : s + n]).decode() for s, n in zip(starts, lengths, strict=True)]
    assert [[w for w, r in zip(spelled, row, strict=True) if r == k] for k in range(len(texts))] == [split(t) for t in texts]
    found = hashes(data, starts, lengths)
    assert len(set(found.tolist())) == len(set(spelled)) and all((found[i] == found[j]) == (spelled[i] == spelled[j]) for i in range(len(spelled)) for j in range(len(spelled)))


# near-duplicates


def shingles(text, size):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in split(text)]
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def linked_groups(sets, percent):
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, size, percent):
    result = minhash.near_duplicates(docs, size, percent)
    assert result.count() == docs.count()
    got = by_id(result)
    sets = {i: shingles(t, size) for i, t in rows}
    want = linked_groups(sets, percent)
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)
    lost = [r for r in result.collect() if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in lost] == [(None, True)]


def test_unlinked_members_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 2)
    sets = {k: list(range(10 * (k // 3), 10 * (k // 3) + 20)) + [1000 + k] for k in range(12)}
    members = spark.createDataFrame([(99, k, False, s, 12) for k, s in sets.items()], "centre long, id long, linked boolean, shingles array<long>, rest long")
    found = components(minhash._compare_rest(members, 80)).collect()
    assert {r["id"]: r["component_id"] for r in found} == {k: k // 3 * 3 for k in range(12)}


def test_a_task_holds_a_slice_of_a_group(spark, monkeypatch):
    members = spark.range(3000).select(F.lit(99).alias("centre"), "id", (F.col("id") >= 4).alias("linked"))
    dealt = minhash.dealt_copies(members, F.lit(2), F.lit(20))
    held = dealt.groupBy("block", "slice").count().collect()
    assert len(held) == 40 and max(r["count"] for r in held) < 250
    met = dealt.filter("tries").alias("x").join(dealt.filter("NOT tries").alias("y"), ["block", "slice"])
    assert met.select("x.id", "y.id").distinct().count() == met.count() == 4 * 3000


@pytest.mark.parametrize("size", [1, 512])
def test_members_far_from_their_centre_keep_their_links(spark, monkeypatch, size):
    """Two signatures within the distance that meet under a centre which is like neither."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", size)
    monkeypatch.setattr(minhash, "SLICE_ROWS", size)
    rng = np.random.default_rng(4)
    centre, x, z = (rng.integers(0, 1 << 16, minhash.SYMBOLS, dtype=np.uint16) for _ in range(3))
    y = x.copy()
    y[rng.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)] ^= 1
    rows = [(0, k, bytearray(centre.tobytes()), bytearray(m.tobytes())) for k, m in ((1, x), (2, y), (3, z))]
    met = minhash._met(spark.createDataFrame(rows, "centre long, id long, s1 binary, s2 binary"))
    assert not any(r["near"] for r in met.collect())
    assert {tuple(r) for r in minhash._far_with_company(met).collect()} == {(0, 1), (0, 2)}


@pytest.mark.parametrize("slice_rows,block_rows", [(2048, 512), (3, 2)])
def test_a_group_in_slices_keeps_all_links(spark, monkeypatch, slice_rows, block_rows):
    monkeypatch.setattr(minhash, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block_rows)
    held, deal = [], minhash.dealt_copies

    def watched(*a):
        held.append(deal(*a))
        return held[-1]

    monkeypatch.setattr(minhash, "dealt_copies", watched)
    rng = random.Random(3)
    shared = [f"s{k}" for k in range(100)]
    own = [[f"f{f}w{k}" for k in range(26)] for f in range(6)]
    texts = [shared + own[k % 6][:-1] + [f"v{k}"] for k in range(30)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))
    want = linked_groups({i: shingles(t, 3) for i, t in rows}, 85)
    assert {i: r["component_id"] for i, r in got.items()} == want and len(set(want.values())) == 6
    tasks = [r["count"] for r in held[-1].groupBy("centre", "block", "slice").count().collect()]
    assert len(tasks) > 1 if slice_rows == 3 else tasks


def test_pigeonhole_finds_all_within_the_distance():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, (1, minhash.SYMBOLS), dtype=np.uint16)
    own = set(minhash.chunk_keys(base)[0].tolist())
    for _ in range(300):
        other = base.copy()
        wrong = rng.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)
        other[0, wrong] ^= 1
        assert own & set(minhash.chunk_keys(other)[0].tolist())


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 140)}}


# quality


def statistics_of(text):
    w = split(text)
    triples = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    seen = Counter(triples)
    covered = {k + j for k, t in enumerate(triples) if seen[t] > 1 for j in range(3)}
    full = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(covered)


def test_text_statistics(docs, rows):
    got = by_id(quality.text_statistics(docs))
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == statistics_of(t)


def test_decision_list_learns_a_planted_rule(spark):
    rng = random.Random(3)
    texts, marks = [], []
    for k in range(600):
        bad = k % 5 == 0
        sign = "###" if bad else ""
        texts.append((k, " ".join(f"w{rng.randrange(500)}{sign}" for _ in range(80))))
        marks.append((k, 0 if bad else 1))
    docs, marked = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks + [(5, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    got = by_id(quality.quality_rules(docs, marked))
    assert all(got[k]["kept"] == (k % 5 != 0) for k in range(600))


def test_without_labels_only_base_rules_speak(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    for r in quality.quality_rules(docs, none).collect():
        assert r["kept"] == (r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"])


# language


def page(url, lang, body):
    tag = f'<html lang="{lang}">' if lang else "<html>"
    return url, f"<!DOCTYPE html>{tag}<head><title>t</title></head><body><nav>zz</nav><p>{body}</p><script>var qqq</script></body></html>"


def test_language_evidence(spark):
    en, de = "the cat and the dog with that thing " * 6, "der hund und die katze mit dem ding auch " * 6
    docs = spark.createDataFrame([(1, en, "en"), (2, de, "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    pages = [page("http://a.example.de/x", "de", de), page("http://b.example.com/x", "en", en), page("http://a.example.de/y", "en", de)]
    pages += [page("http://h.example.org/%d" % k, "de", "") for k in range(6)] + [page("http://h.example.org/z", None, ""), (None, None), ("not an address", "")]
    frame = spark.createDataFrame([(k, u, h, "x") for k, (u, h) in enumerate(pages)] + [(None, "http://h.example.org/n", None, "x")], "page_id long, url string, html string, host string")
    result = langid.languages(frame, docs).collect()
    got = {r["page_id"]: r for r in result}
    assert len(result) == len(pages) + 1
    assert [got[k]["lang"] for k in range(3)] == ["de", "en", "de"] and got[2]["declared"] == "en" and got[0]["text_lang"] == "de"
    assert got[9]["lang"] == "de" and got[9]["text_lang"] is None and got[9]["host"] == "h.example.org"  # the host's other pages speak
    assert got[10]["lang"] in ("de", "en") and all(0 < r["confidence"] <= 1 for r in result)
    assert langid.languages(frame.limit(0), docs).count() == 0
    assert {r["lang"] for r in langid.languages(frame, docs.limit(0)).collect()} == {None}


def test_pages_of_openings_that_never_end():
    for unit in ("<!--", "<script", "<script>", "<", "<html ", "&a", "</head", "<nav><head>"):
        page = unit * (1_000_000 // len(unit))
        begin = time.monotonic()
        langid.visible(page)
        assert time.monotonic() - begin < 5, unit
    pages = ["a<!-- x -->b<script>no</SCRIPT >c", "a<head>no</nav></head><nav>z", "<!-- never <script>no</script> b < c", "", "x&amp;y > z"]
    assert [langid.visible(p).split() for p in pages] == [["a", "b", "c"], ["a", "z"], ["<!--", "never", "b", "<", "c"], [], ["x", "y", ">", "z"]]


def test_long_hostile_pages_in_a_table(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die", "de")], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(k, "http://a.example.de", u * (1_000_000 // len(u))) for k, u in enumerate(["<!--", "<html ", "<script>"])] * 2, "page_id long, url string, html string")
    begin = time.monotonic()
    assert langid.languages(pages, docs).count() == 6 and time.monotonic() - begin < 60


# tokens


HARD = [
    "don't 'tis ''s I'll've \n\n x  y\t\tz  ", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>x<|endoftext|><|endoftext", "日本語テキスト 123,456 ½²³Ⅷ ٣ _a_b é ‍👩‍👧 \xa0x 　y \x1c\x1d a\x85b",
    "ab" * 3000, " " * 3000 + "x", "'S 'T \x00\x01", " 'll 's", "!'s \r\n\r\n a\x0bb", "'", "'s", "x'", "'re'ves", " ", "\n\n", "",
]


def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path())


def test_ids_and_text_are_those_of_the_library():
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice("ab'srevltdm  \n1!éß\t") for _ in range(rng.randrange(30))) for _ in range(3000)]
    own, theirs = bpe.Codec(bpe.read_vocabulary(bpe.vocabulary_path())), tokenizer()
    ids = [part for found, ends in own.encode(pa.array(texts)) for part in np.split(found, ends[:-1])]
    for text, got, want in zip(texts, ids, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids, text[:50]
        assert own.decode(got.astype(np.int64), np.array([len(got)])) == [theirs.decode(want.ids, skip_special_tokens=False)]


def test_cache_may_be_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "TOGETHER_BYTES", 10)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 10)
    own, theirs = bpe.Codec(bpe.read_vocabulary(bpe.vocabulary_path())), tokenizer()
    ids = [part.tolist() for found, ends in own.encode(pa.array(HARD)) for part in np.split(found, ends[:-1])]
    assert ids == [e.ids for e in theirs.encode_batch(HARD, add_special_tokens=False)]


def test_encode_and_decode_a_table(docs, rows, empty):
    encoded = bpe.encode(docs, bpe.vocabulary_path())
    got = by_id(bpe.decode(encoded, bpe.vocabulary_path()))
    assert all(got[i]["decoded"] == (t or "") for i, t in rows)
    assert bpe.decode(bpe.encode(empty, bpe.vocabulary_path()), bpe.vocabulary_path()).count() == 0


def test_packing(docs, rows, empty, monkeypatch):
    cut = packing.pieces(docs, bpe.vocabulary_path(), capacity=64)
    result = packing.pack(cut, capacity=64, group_rows=40).collect()
    theirs = tokenizer()
    pieces = {}
    for r in result:
        pieces.setdefault(r["doc_id"], []).append(r)
    copies = Counter(i for i, _ in rows)
    for i, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[i], key=lambda r: (r["piece"], r["sequence_id"]))
        assert len(own) == copies[i] * -(-len(ids) // 64)
        at = 0
        for r in own[:: copies[i]]:
            part = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(part.tobytes())) and (r["length"] == 64 or r["piece"] == 0)
            at += r["length"]
        assert at == len(ids)
    bins = {}
    for r in result:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len(bins) <= 1.05 * packing.lower_bound(np.array([r["length"] for r in result]), 64)
    assert packing.pack(packing.pieces(empty, bpe.vocabulary_path())).count() == 0


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, _, room = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= len(room) and (np.bincount(bins, lengths) + room == 100).all()
    assert packing.lower_bound(np.array([51] * 9 + [10]), 100) == 9 and packing.lower_bound(np.array([34] * 9), 100) == 5


# lines


def test_line_dedup(docs, rows, empty):
    got = by_id(lines.dedup_lines(docs))
    seen, first = [], {}
    for i, t in sorted(set(rows)):
        stay, total, gone = [], 0, 0
        for line in (t or "").split("\n"):
            own = set(split(line))
            if not own:
                stay.append(line)
                continue
            total += 1
            if any(100 * len(own & x) >= 80 * len(own | x) for x in seen):
                gone += 1
            else:
                stay.append(line)
            seen.append(own)
        first[i] = (total, gone, None if t is None else "\n".join(stay))
    for i, _ in rows:
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["text"]) == first[i]
    assert lines.dedup_lines(docs).count() == docs.count() and lines.dedup_lines(empty).count() == 0


def test_long_lines_are_told_apart_before_their_sets_are_read(spark):
    """Lines of up to 300 words that share rare words, and near copies of them around the length from which sketches are wide."""
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(3000)}" for _ in range(n)] for n in (150, 200, 300) for _ in range(25)]
    texts += [[f"v{k}" for k in range(n)] for n in (78, 79, 80, 84, 97, 98, 122)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    like, seen, removed = 0, [], {}
    for k, t in rows:
        found = [100 * len(set(t.split()) & x) >= 80 * len(set(t.split()) | x) for x in seen]
        like, removed[k] = like + sum(found), any(found)
        seen.append(set(t.split()))
    classes = lines.line_classes(lines._tagged(docs, "doc_id", "text"), lines.rarity(docs), 80, "doc_id", "text")
    tried = lines._others(classes, classes.select(*lines.LINE).limit(0), 80).count()
    assert 0 < like <= tried <= like + 3  # far fewer than all pairs, of which the short sketch alone leaves most
    assert {r["doc_id"]: r["n_removed"] == 1 for r in lines.dedup_lines(docs).collect()} == removed



def test_words_of_a_line_are_cut_without_regular_expressions(spark):
    texts = ["", " ", "a", " a  b ", "a\tb", "\ta \x0b", "a\x0cb c\r", "a\u00a0b c\u2003d", "\x1c a", "a b a", "a\r\tb  "]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, text string")
    got = df.select("k", lines._words(F.col("text")).alias("w"), lines.codes(F.col("text"), lines.rarity(df)).alias("codes")).collect()
    assert {r["k"]: r["w"] for r in got} == {k: split(t) for k, t in rows}
    assert all(len(r["codes"]) == len(set(r["w"])) and r["codes"] == sorted(r["codes"]) for r in got)


# repeats


def removed_by_force(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((bytes(x for x, g in zip(b, gone, strict=True) if not g), len(b), sum(gone), spans))
    return out


@pytest.mark.parametrize("part_rows,windows", [(4096, 1 << 20), (2, 50)])
def test_repeats(docs, rows, monkeypatch, part_rows, windows):
    monkeypatch.setattr(suffix, "PART_ROWS", part_rows)
    monkeypatch.setattr(suffix, "PIECE_WINDOWS", windows)
    everything = [*rows, (None, "no id at all " * 30)]
    got = {}
    for r in suffix.remove_repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append((bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]))
    for (i, _), want in zip(everything, removed_by_force(everything), strict=True):
        assert want in got[i] and len(set(got[i])) == 1


def test_repeats_of_an_empty_table(empty):
    assert suffix.remove_repeats(empty).count() == 0


# toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(11)
    neutral = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]

    def text(bad):
        w = [rng.choice(neutral) for _ in range(60)]
        for _ in range(3 if bad else 0):
            w[rng.randrange(60)] = rng.choice(["vilefoo", "vilebar", "vilebaz", "Vilefoo!"])
        return " ".join(w)

    rows = [(k, text(k % 4 == 0)) for k in range(900)]
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    result = toxicity.score(docs, model).collect()
    got = {r["doc_id"]: r["score"] for r in result}
    assert len(result) == 903 and all(0 <= r["score"] <= 1 for r in result)
    right = [(got[k] >= 0.5) == (k % 4 == 0) for k in range(600, 900)]
    assert np.mean(right) > 0.97
    one_class = toxicity.fit(docs, marks.filter("toxic = 0"))
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, one_class).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


# language models


@pytest.mark.parametrize("shares", [1, 12, 1 << 20])
def test_cross_entropy_difference(spark, monkeypatch, shares):
    monkeypatch.setattr(lmscore, "HOT_SHARES", shares)
    rng = random.Random(8)
    many = [" ".join(f"w{rng.randrange(rng.choice((5, 10**6)))}" for _ in range(2500)) for _ in range(4)]  # words beyond any small number
    texts = [(1, "a b a b c"), (2, "x y x y"), (3, None), (4, " "), (5, "a b"), (None, "x")] + [(10 + k, t) for k, t in enumerate(many)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in texts], "doc_id long, text string, target int")
    good = spark.createDataFrame([(1,), (1,), (5,), (77,), (None,), (11,)], "doc_id long")
    result = lmscore.cross_entropy_difference(docs, good).collect()
    got = {r["doc_id"]: r for r in result}
    assert len(result) == len(texts) and got[3]["difference"] is None and got[4]["n_words"] == 0
    every = [t.split() for _, t in texts if t and t.strip()]
    known = sorted({w for t in every for w in t})
    assert len(known) > 4000

    def model(corpus):
        pair, word = Counter(), Counter()
        for t in corpus:
            for before, w in zip([None, *t[:-1]], t, strict=True):
                pair[before, w] += 1
                word[w] += 1
        total = sum(word.values()) + len(known)
        context = Counter()
        for (before, _), n in pair.items():
            context[before] += n
        return lambda before, w: -np.log((pair[before, w] + lmscore.BACKOFF * (word[w] + 1) / total) / (context[before] + lmscore.BACKOFF))

    target, background = model([t.split() for i, t in texts if i in (1, 5, 11)]), model(every)
    for i, t in texts:
        if t and t.strip():
            w = t.split()
            pairs = list(zip([None, *w[:-1]], w, strict=True))
            want = [np.mean([m(*p) for p in pairs]) for m in (target, background)]
            assert got[i]["target_loss"] == pytest.approx(want[0], rel=1e-4) and got[i]["difference"] == pytest.approx(want[0] - want[1], abs=1e-4)
    assert lmscore.cross_entropy_difference(docs.limit(0), good).count() == 0


def test_no_table_of_bigrams_is_written(spark, monkeypatch):
    """Nearly every bigram of a corpus occurs once: tables of them are larger than the texts."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(f"w{rng.randrange(300)}" for _ in range(400))) for k in range(40)], "doc_id long, text string")
    sizes, write = [], lmscore.written
    monkeypatch.setattr(lmscore, "written", lambda df, label, *how: (out := write(df, label, *how), sizes.append(out.count()))[0])
    got = lmscore.cross_entropy_difference(docs, docs.filter("doc_id < 5").select("doc_id")).collect()
    assert len(got) == 40 and {r["n_words"] for r in got} == {400} and max(sizes) < 6000  # about 14,600 distinct bigrams, 300 words
    assert max(r["difference"] for r in got if r["doc_id"] < 5) < min(r["difference"] for r in got if r["doc_id"] >= 5)


def test_losses_are_one_row_for_each_row_dealt(spark, monkeypatch):
    """What a task has in hand holds each of few texts many times, of many texts hardly one twice: sums of it would grow faster than the input."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(f"w{rng.randrange(300)}" for _ in range(100))) for k in range(60)], "doc_id long, text string")
    made, added = [], lmscore._added

    def counted(rows, *how):
        out = added(rows, *how)
        made.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(lmscore, "_added", counted)
    for n in (12, 60):
        lmscore.cross_entropy_difference(docs.filter(F.col("doc_id") < n), docs.filter("doc_id < 5").select("doc_id"))
    assert all(came == went for came, went in made)
    small, large = (sum(went for _, went in x) for x in (made[: len(made) // 2], made[len(made) // 2 :]))
    assert small > 600 and 4 < large / small < 6


@pytest.mark.parametrize("bits", [1, 48])
def test_bigrams_of_a_word_stand_together(monkeypatch, bits):
    monkeypatch.setattr(lmscore, "CONTEXT_BITS", bits)
    rng = np.random.default_rng(5)
    for clash in (0, 1):  # the hashes of a word and of a bigram may be equal
        key = np.sort(rng.integers(-9, 9, 400))
        context, hot = rng.integers(-5, 5, 400), np.where(key % 2 == 0, -1, rng.integers(3, 4 + clash, 400))
        order = lmscore._sorted(key, hot, context)
        whole = list(zip(key[order].tolist(), hot[order].tolist(), context[order].tolist(), strict=True))
        assert sorted(order.tolist()) == list(range(400)) and key[order].tolist() == key.tolist()
        for width in (2, 3):
            assert sum(a[:width] != b[:width] for a, b in zip(whole, whole[1:])) + 1 == len({r[:width] for r in whole})


def test_pair_hashes_are_those_of_spark(spark):
    rng = np.random.default_rng(2)
    some = rng.integers(0, 1 << 64, (2, 50), dtype=np.uint64)
    rows = spark.createDataFrame([tuple(map(int, r)) for r in some.view(np.int64).T], "a long, b long").select(F.xxhash64("a", "b").alias("h"))
    assert [r["h"] for r in rows.collect()] == lmscore.pair_hashes(*some).view(np.int64).tolist()


def test_words_are_hashed_and_put_in_runs_with_little_room():
    """Numbers for each byte of a chunk, and sorts of places instead of numbers, were a third of what LM scoring took in Python."""
    rng = np.random.default_rng(6)
    data = rng.choice(np.frombuffer(b"abcdefXYZ \n", dtype=np.uint8), 1 << 20)
    data[5000:100_000] = 97  # a word longer than a piece
    starts, lengths, _ = words(data, np.array([0, len(data)]))
    hashes(data, starts, lengths)
    tracemalloc.start()
    found = hashes(data, starts, lengths)
    assert tracemalloc.get_traced_memory()[1] < 10 * len(data)
    tracemalloc.stop()
    spelt = [data[a : a + n].tobytes() for a, n in zip(starts, lengths, strict=True)]
    assert len(set(spelt)) == len(set(found.tolist())) == len(set(zip(spelt, found.tolist(), strict=True)))
    order = lmscore._in_runs(found)
    assert sorted(order.tolist()) == list(range(len(found)))
    in_order = found[order]
    assert 1 + (in_order[1:] != in_order[:-1]).sum() == len(set(spelt)) and all(order[1:][in_order[1:] == in_order[:-1]] > order[:-1][in_order[1:] == in_order[:-1]])
    at, times = lmscore._often(found, 1 << 18)
    want = {w: n for w, n in Counter(spelt).items() if n >= lmscore.REPORTED}
    assert {spelt[k]: n for k, n in zip(at, times, strict=True)} == want and all(spelt.index(spelt[k]) == k for k in at)


def test_texts_that_differ_in_rare_words_only_get_scores_of_their_own(spark):
    common = " ".join(f"w{k % 50}" for k in range(200))
    docs = spark.createDataFrame([(k, f"{common} r{k} s{k} " * 3) for k in range(20)] + [(20, f"{common} r0 s0 " * 3)], "doc_id long, text string")
    got = by_id(lmscore.cross_entropy_difference(docs, docs.filter("doc_id = 3").select("doc_id")))
    assert got[0]["background_loss"] == got[20]["background_loss"] < got[1]["background_loss"]
    assert min(got, key=lambda k: got[k]["difference"]) == 3


# fingerprints


def test_fingerprints_and_edited_texts(docs, rows):
    result = fingerprint.fingerprinted(docs).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1])) + [(None, "no id at all " * 30)]
    assert len(result) == len(order)
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = fingerprint.fingerprints([t, edited, following])
        near = [float(fingerprint.likeness(a[None], x[None])[0]) for x in (b, c)]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.astype(">u2").tobytes().hex(), b.astype(">u2").tobytes().hex(), *near))
    assert Counter(map(tuple, result)) == Counter(want)


def test_small_edits_stay_near_and_others_do_not():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(20)]
    edited = []
    for t in texts:
        c = list(t)
        for _ in range(10):
            k = rng.randrange(len(c))
            c[k : k + 1] = rng.choice(["", "x", "yz"])
        edited.append("".join(c))
    a, b = fingerprint.fingerprints(texts), fingerprint.fingerprints(edited)
    assert fingerprint.likeness(a, b).mean() > 0.8 and fingerprint.likeness(a, np.roll(b, 1, axis=0)).max() < 0.3


def test_every_segment_is_read_to_its_end():
    rng = random.Random(12)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    points = np.frombuffer((text + "\0" * 16).encode("utf-32-le"), np.uint32)
    begins, ends, _ = fingerprint._segments(points, np.array([0]), np.array([len(text)]))
    # from the middle of each segment on, other characters: every segment shows it in some band, and most in all
    other = points.copy()
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        other[b + (e - b) // 2 : e] += 1000
    parted = fingerprint._embedded(points, begins, ends) != fingerprint._embedded(other, begins, ends)
    assert parted[ends - begins >= 16].any(axis=1).all() and parted.mean() > 0.7
    last = points.copy()  # the last quarter only
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        last[e - (e - b) // 4 : e] += 1000
    long = ends - begins >= 40
    assert long.any() and (fingerprint._embedded(points, begins, ends) != fingerprint._embedded(last, begins, ends))[long].any(axis=1).all()


def test_near_links(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(6)]
    texts += [texts[0], texts[1][:1000] + "!" + texts[1][1001:], ""]
    marks = fingerprint.fingerprints(texts)
    frame = spark.createDataFrame([(k, m.astype(">u2").tobytes().hex()) for k, m in enumerate(marks)], "id long, fingerprint string")
    got = {r["id"]: r["component_id"] for r in fingerprint.near_links(frame).collect()}
    assert got == {**{k: k for k in range(9)}, 6: 0, 7: 1}


def linked_marks(marks, slots=40):
    """Components of the rows that share a band and agree in ``slots`` slots, by brute force."""
    label = list(range(len(marks)))
    for i in range(len(marks)):
        for j in range(i):
            same = marks[i] == marks[j]
            if same.sum() >= slots and same.reshape(fingerprint.KEYS, -1).all(axis=1).any():
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return dict(enumerate(label))


@pytest.mark.parametrize("block,part", [(512, 2048), (3, 5)])
def test_near_links_where_a_passage_is_shared(spark, monkeypatch, block, part):
    monkeypatch.setattr(fingerprint, "BLOCK_ROWS", block)
    monkeypatch.setattr(fingerprint, "SLICE_ROWS", part)
    rng = np.random.default_rng(4)
    centre, first = rng.integers(1, 1 << 16, (2, fingerprint.SLOTS), dtype=np.uint16)
    first[:4] = centre[:4]
    second = first.copy()
    second[4::4] ^= 1  # agrees in 49 slots and shares the first band only, whose smallest class may be like neither
    words = random.Random(6)
    passage, *own = ("".join(words.choice("abcdefgh ") for _ in range(n)) for n in (3000, *[1300] * 60))
    marks = np.concatenate([[centre, first, second], fingerprint.fingerprints([passage + t for t in own])])
    frame = spark.createDataFrame([(k, m.astype(">u2").tobytes().hex()) for k, m in enumerate(marks)], "id long, fingerprint string")
    got = {r["id"]: r["component_id"] for r in fingerprint.near_links(frame).collect()}
    assert got == linked_marks(marks) and got[2] == 1 and got[0] == 0


def test_the_query_of_fingerprints_has_components(spark, sf_dir):
    found = fingerprint.op10_fingerprints(spark, sf_dir)
    assert "component_id" in found.columns and found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_fingerprints_of_an_empty_table(empty):
    assert fingerprint.fingerprinted(empty).count() == 0


def test_held_out_rows_are_those_of_the_checksum(spark):
    frame = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("h", toxicity.held_out())
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in frame.collect())


def test_labels_are_read(spark, sf_dir):
    assert read_labels(spark, sf_dir).filter(F.col("toxic") == 1).count() > 0


def test_rows_of_one_id_with_different_texts_are_documents_of_their_own(spark):
    """Lines never move from one row to another, whatever the ids are."""
    rows = [(1, "x y z\nfoo bar"), (1, "foo bar\nqux"), (1, "foo bar\nqux"), (2, "qux\nown line"), (2, None), (2, ""), (None, "qux\nqux"), (3, "a b c d e\n\nx y z"), (3, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lines.dedup_lines(docs).collect()
    assert len(got) == len(rows) and all(r.n_removed >= 0 for r in got)
    left = sorted(((r.doc_id, r.text) for r in got), key=str)
    for doc_id, text in left:
        assert any(i == doc_id and (t is None and text is None or t is not None and text is not None and set(text.split("\n")) <= set(t.split("\n")) | {""}) for i, t in rows)
    assert (2, "own line") in left and (None, "qux\nqux") in left and [r.text for r in got if r.doc_id == 2 and r.n_lines == 0] in ([None, ""], ["", None])
    # each set of words that is like an earlier one is gone: one "foo bar" among the first three rows, which come in the order of a hash
    first, second = (sorted((t for i, t in left if i == 1 and "x y z" in t), key=str), [t for i, t in left if i == 1 and "x y z" not in t])
    assert len(first) == 1 and len(second) == 2 and second[0] == second[1]
    assert ("foo bar" in first[0]) != ("foo bar" in second[0])
