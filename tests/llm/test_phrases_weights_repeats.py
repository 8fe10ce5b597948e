"""Phrases, importance resampling and repeated passages against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.llm.test_corpus import LONG, ODD_TEXTS, SCHEMA, docs_of, nothing, odd  # noqa: F401
from tidemark.llm import automata, bloom, collocation, importance, repeats, suffix
from tools.check import canonical, compare

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- automata

def transducer_of(counts, words, order, block=7):
    names = sorted(counts)
    columns = [np.array([name[k] for name in names], np.int64) for k in range(order)]
    return automata.build(words, columns, np.array([counts[name] for name in names], np.int64), block)


def read(transducer, words, columns=None, counts=None):
    if columns is None:
        columns, counts = transducer.paths()
    return {tuple(words.index(transducer.words[n]) for n in row): c for row, c in zip(zip(*(c.tolist() for c in columns)), counts.tolist())}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4), st.lists(st.lists(st.tuples(*[st.integers(0, 5)] * 4), min_size=1, max_size=60), min_size=1, max_size=3), st.integers(0, 3))
def test_transducers_add_up(order, parts, least):
    words = sorted([b"a", b"ab", b"b", "é".encode(), b"\x00", b"zz"])
    counted = [Counter(row[:order] for row in part) for part in parts]
    made = [automata.Transducer.from_bytes(transducer_of(c, words, order).to_bytes()) for c in counted]
    assert [read(m, words) for m in made] == [dict(c) for c in counted]
    total = sum(counted, Counter())
    whole = automata.union(made, least)
    assert read(whole, words) == {name: n for name, n in total.items() if n >= least}
    asked = transducer_of(Counter(row[:order][::-1] for row in parts[0]), words, order)
    found = read(asked, words, *whole.compose(asked)) if whole.words else {}
    for name, n in found.items():
        assert n == (total[name] if total[name] >= least else 0)


def test_equal_endings_exist_once():
    words = [b"a", b"b", b"c", b"d"]
    same = transducer_of({(x, y, z): 1 for x in range(4) for y in (0, 1) for z in (2, 3)}, words, 3)
    assert [len(first) - 1 for first in same.firsts] == [1, 1, 1]
    other = transducer_of({(x, y, z): 1 + (x == y == 0) for x in range(4) for y in (0, 1) for z in (2, 3)}, words, 3)
    assert [len(first) - 1 for first in other.firsts] == [1, 2, 2]


def test_bounds_cut_alike_whatever_words_a_task_has():
    rng = np.random.default_rng(0)
    every = sorted({bytes(rng.integers(97, 123, int(rng.integers(1, 5))).astype(np.uint8)) for _ in range(3_000)})
    begins = sorted([(b"en", w, b"") for w in every[::300]] + [(b"en", every[300], w) for w in every[::900]] + [(b"fr", every[5], b"")])
    place = {}
    for draw in range(6):
        some = sorted(set(rng.choice(len(every), 700).tolist()) | {300, 301})
        texts = sorted({every[n] for n in some} | {b"en", b"fr", b"zz"})
        rank = {word: n for n, word in enumerate(texts)}
        made = sorted({(rank[lang], rank[every[a]], rank[every[b]]) for lang in (b"en", b"fr")
                       for a in [300, *rng.choice(some, 300).tolist()] for b in rng.choice(some, 3).tolist()})
        columns = [np.array(c, np.int32) for c in zip(*made)]
        seen = 0
        for number, first, last in collocation.cut(columns, texts, begins):
            assert first == seen
            seen = last
            for row in made[first:last]:
                name = tuple(texts[n] for n in row)
                assert place.setdefault(name, number) == number
                assert sum(begin <= name for begin in begins) == number
        assert seen == len(made)


# --- phrases

def plain_phrases(docs, least, longest, inside, top):
    singles, counts = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            singles[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    some = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in some.items():
        if any(100 * b >= inside * a for (other, longer), b in some.items() if other == lang and len(longer) > len(words)
               and any(longer[i:i + len(words)] == words for i in range(len(longer) - len(words) + 1))):
            continue
        cuts = [(2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return sorted((lang, rank, phrase.decode(), -a, left, right, singles[lang], -score) for lang, found in out.items()
                  for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1))


@pytest.fixture(scope="module")
def prose(spark):
    rng = np.random.default_rng(2)
    words = ["New", "YORK", "city", "é", "日本", "of", "the", "a", "b\x0bb", "c\td"]
    made = []
    for n in range(300):
        drawn = [words[int(w)] for w in np.minimum(rng.geometric(0.25, int(rng.integers(0, 60))) - 1, 9)]
        made.append((n, " ".join(word + ("," if rng.random() < 0.1 else "") for word in drawn), [None, "en", "und", "fr"][n % 4], "s", 1))
    made += [(n, "of the new york city", "en", "s", 1) for n in range(400, 500)]  # copies count each time
    return spark.createDataFrame(made, SCHEMA)


@pytest.mark.parametrize("held, share", [(1 << 20, 1 << 24), (200, 50)])
def test_phrases_equal_plain_counts(spark, prose, held, share, monkeypatch):
    monkeypatch.setattr(collocation, "HELD", held)
    monkeypatch.setattr(collocation, "RANGE", share)
    monkeypatch.setattr(collocation, "BATCH_BYTES", 2_000)
    found = sorted(tuple(row) for row in collocation.mine(prose, 30, 4, 80, 25).collect())
    want = plain_phrases([(row["lang"], row["text"]) for row in prose.collect()], 30, 4, 80, 25)
    assert found == want and {row[0] for row in want} == {"en", "und", "fr"} and max(row[1] for row in want) == 25


def test_phrases_of_odd_rows(spark, odd, nothing):  # noqa: F811
    assert collocation.mine(nothing).collect() == [] and collocation.mine(docs_of(spark, [None, "", " \t"])).collect() == []
    found = sorted(tuple(row) for row in collocation.mine(odd, least=2, top=50).collect())
    assert found == plain_phrases([(row["lang"], row["text"]) for row in odd.collect()], 2, 4, 80, 50)


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5_000).select(F.xxhash64("id").alias("key"))
    words = bloom.build(keys, 5_000).value
    mine = np.array([row["key"] for row in keys.collect()], np.int64)
    assert bloom.test(words, mine).all()
    others = np.array([row[0] for row in spark.range(10_000, 30_000).select(F.xxhash64("id")).collect()], np.int64)
    assert bloom.test(words, others).mean() < 0.05


# --- importance

def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, percent, buckets=10_000):
    ours, theirs = np.zeros(buckets, int), np.zeros(buckets, int)
    read_ = [(name, *features(text)) for name, text in docs]
    for _, _, found in read_:
        for feature in found:
            ours[zlib.crc32(feature.encode()) % buckets] += 1
    for text in target:
        for feature in features(text)[1]:
            theirs[zlib.crc32(feature.encode()) % buckets] += 1
    s, t = int(ours.sum()), int(theirs.sum())
    gain = [math.floor(1000 * math.log((int(b) + 1) * float(s + buckets) / ((int(a) + 1) * float(t + buckets)))) for a, b in zip(ours, theirs)]
    out = []
    for name, words, found in read_:
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"42:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        out.append([name, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((row for row in out if row[5] >= 20), key=lambda row: (-row[3], row[0] is not None, row[0] or 0, row[1]))
    for rank, row in enumerate(fit[:percent * len(fit) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=str)


@given(st.binary(max_size=40), st.binary(max_size=400))
@settings(max_examples=60, deadline=None)
def test_a_crc_follows_from_two_prefixes(first, rest):
    moved = importance.shift(np.array([zlib.crc32(first)], np.uint32), np.array([len(rest)]))
    assert zlib.crc32(first + rest) ^ int(moved[0]) == zlib.crc32(rest)


def test_long_moves_and_texts_in_stretches(monkeypatch):
    for size in (127, 128, 129, 70_000):
        moved = importance.shift(np.array([zlib.crc32(b"xy")], np.uint32), np.array([size]))
        assert zlib.crc32(b"xy" + b"q" * size) ^ int(moved[0]) == zlib.crc32(b"q" * size)
    monkeypatch.setattr(importance, "STRETCH", 512)
    texts = ["Hello x", "Ab cd, " * 900 + "é x" * 90 + "y" * 1_500 + " end", "", "one", "-- " * 600 + "a b"]
    got, want = Counter(), Counter()
    for found, owner, _ in importance.Scan(3).texts([text.encode() for text in texts]):
        got.update(zip(owner.tolist(), found.tolist()))
    for n, text in enumerate(texts):
        want.update((n, zlib.crc32(feature.encode())) for feature in features(text)[1])
    assert got == want


def test_resampling_equals_plain_sums(spark, odd, nothing):  # noqa: F811
    rng = np.random.default_rng(6)
    texts = [" ".join(f"W{int(w)}" for w in rng.geometric(0.05, int(rng.integers(0, 70)))) for _ in range(300)]
    frame = docs_of(spark, texts).unionByName(odd.select(*docs_of(spark, []).columns).withColumn("doc_id", F.col("doc_id") + 1_000))
    frame = frame.unionByName(frame.where("doc_id < 30"))  # repeated rows
    target = docs_of(spark, [texts[3], None, "w1 w2 w3"])
    found = sorted(((*row,) for row in importance.resample(frame, target, percent=40).collect()), key=str)
    want = plain_resample([(row["doc_id"], row["text"]) for row in frame.collect()], [row["text"] for row in target.collect()], 40)
    key = lambda row: (row[:4], row[5])
    assert sorted(map(key, found), key=str) == sorted(map(key, want), key=str)
    assert sorted((row[4], row[:4]) for row in found if row[4]) == sorted((row[4], row[:4]) for row in want if row[4])
    assert importance.resample(nothing, target).count() == 0
    assert importance.resample(frame, nothing).where("rank is not null").count() > 0


# --- suffix arrays

@settings(max_examples=80, deadline=None)
@given(st.integers(1, 4), st.lists(st.integers(0, 3), min_size=1, max_size=70), st.integers(1, 4), st.sampled_from([2, 128]))
def test_induced_order_and_prefixes(letters, drawn, times, widest):
    text = bytes(97 + n % letters for n in drawn) * times
    before, suffix.WIDEST = suffix.WIDEST, widest
    try:
        order = suffix.suffix_array(np.frombuffer(text, np.uint8))
    finally:
        suffix.WIDEST = before
    assert order.tolist() == sorted(range(len(text)), key=lambda n: text[n:])
    found = suffix.permuted_prefixes(np.frombuffer(text, np.uint8), order)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
        same = 0
        while same < len(text) - max(a, b) and text[a + same] == text[b + same]:
            same += 1
        assert found[b] == same


def plain_removal(docs, length):
    count = Counter()
    for _, text in docs:
        data = (text or "").encode()
        count.update(data[i:i + length] for i in range(len(data) - length + 1))
    out = []
    for name, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if count[data[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((name, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, stretch, piece", [(3 << 20, 1 << 20, 4096), (300, 512, 7)])
def test_repeats_equal_plain_removal(spark, block, stretch, piece, monkeypatch):
    """The second case deals every group anew by longer grams and cuts texts and long runs."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = np.random.default_rng(3)

    def text(n):
        return " ".join("".join(chr(97 + x) for x in rng.integers(0, 4, 3)) for _ in range(n))

    shared = [text(30) for _ in range(5)]
    docs = [(n, text(int(rng.integers(0, 80))) + shared[n % 5][:int(rng.integers(20, 119))] + text(int(rng.integers(0, 50)))) for n in range(60)]
    docs += [(100, None), (101, ""), (102, "a" * 2_000), (103, "ab" * 300), (104, docs[3][1]), (104, docs[3][1]), (None, docs[3][1]),
             (106, "é" * 300), (107, "x" * 39), (108, "y" * 40), (109, "y" * 41), (110, "\x00" * 50 + "é" * 20)]
    found = repeats.remove(spark.createDataFrame(docs, "doc_id long, text string"), 40)
    assert sorted(((*row,) for row in found.collect()), key=str) == plain_removal(docs, 40)


def test_repeats_of_odd_rows(spark, odd, nothing):  # noqa: F811
    found = sorted(((*row,) for row in repeats.remove(odd).collect()), key=str)
    assert found == plain_removal([(row["doc_id"], row["text"]) for row in odd.collect()], 400)
    assert repeats.remove(nothing).collect() == []
    plain = " ".join(f"u{n}" for n in range(3_000))
    kept = {row["doc_id"]: row["kept"] for row in repeats.remove(docs_of(spark, [plain, "x" * 401, "tail", LONG]), texts=True).collect()}
    assert [bytes(kept[n]) for n in range(4)] == [plain.encode(), b"", b"tail", b""]  # the last is periodic


# ------------------------------------------------------------------------------- encoder
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_new_word_of_letters_is_looked_for_once(name, monkeypatch):
    """Words behind a space go to the model after one look; ids stay the library's own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm import encode

    path, asked = public_tokenizers.path(name), []
    look = encode.Memory.look
    monkeypatch.setattr(encode.Memory, "look", lambda self, words: asked.extend(words) or look(self, words))
    texts = ["Head arrationf Zérouñé tire.\nAnwhre it's", "éierouré arrationf,arrationf x y", "", None, " lead <|im_end|>  two"]
    ids, where = encode.Encoder(path).batch(pa.array(texts), 7)
    library = Tokenizer.from_file(path)
    for n, text in enumerate(texts):
        assert ids[where[n]:where[n + 1]].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 7]
    assert asked.count("Zérouñé") == 1
