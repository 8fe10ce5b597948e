"""Phrases whose words stand together more often than apart, counted through weighted acyclic automata.

Every task sorts its word sequences of one length and builds count transducers of them, one for each prefix
range; a range's transducers are united and their counts added; what stays is at least ``least``. Pairs are
sent where both words are frequent, longer sequences where all their pairs are (no frequent one is
otherwise), by Bloom filters of bounded size; one that passes by error is dropped with its exact count. Parts are looked up by composing a transducer of the asked sequences with the
range's counts. A sequence begins with its language, so that all languages share the ranges.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import automata, bloom
from tidemark.llm.common import slices, whole_text
from tidemark.session import written

#: Lower case for A-Z; one mark ends a piece, one blank parts words.
NORMAL = bytes(
    byte + 32 if 65 <= byte <= 90 else 10 if chr(byte) in ".,;:!?\n\x0b\x0c\r" else 32 if byte == 9 else byte
    for byte in range(256))
BATCH_BYTES = 2 << 20
#: Sequences that a task holds before it builds transducers of them, and different words.
HELD, WORDS = 1 << 20, 1 << 18
#: Word occurrences of a prefix range, and words looked at to find the ranges' bounds.
RANGE, LOOKED = 1 << 24, 1 << 14


def coded_words(texts: list[bytes]) -> pa.DictionaryArray:
    """All words of the texts in order, with a word "\\n" between pieces and empty ones beside blanks."""
    joined = b"\n".join(texts).translate(NORMAL).replace(b"\n", b" \n ")
    return pc.split_pattern(pa.array([joined], pa.large_binary()), " ").flatten().dictionary_encode()


def by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    found: dict[str, list[bytes]] = {}
    for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
        found.setdefault(lang, []).append(text)
    return found


class Reader:
    """Numbers of the words that the filter ``frequent`` holds; -1 for others and between pieces.

    Numbers hold for a task until ``forget``.
    """

    def __init__(self, frequent: np.ndarray) -> None:
        self.frequent = frequent
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, dict[bytes, int]] = {}
        self.names: list[tuple[str, bytes]] = []
        self.hashes = np.zeros(0, np.uint64)

    def batch(self, batch: pa.RecordBatch) -> np.ndarray:
        found = []
        for lang, texts in by_lang(batch).items():
            coded = coded_words(texts)
            codes = self._numbers(lang, coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            found += [codes[codes != -2], np.array([-1], np.int32)]
        return np.concatenate(found)

    def _numbers(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Of each different word; -2 for the empty one."""
        number = self.number.setdefault(lang, {b"": -2, b"\n": -1})
        mine = np.array([-3 if value is None else value for value in map(number.get, words)], np.int32)
        missing = np.flatnonzero(mine == -3)
        if len(missing):
            hashes = word_hashes(lang, [words[n] for n in missing.tolist()])
            passed = bloom.test(self.frequent, hashes.view(np.int64))
            mine[missing[~passed]] = -1
            for n in missing[passed].tolist():
                mine[n] = number[words[n]] = len(self.names)
                self.names.append((lang, words[n]))
            self.hashes = np.concatenate([self.hashes, hashes[passed]])
        return mine


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    values = np.empty(len(words), object)
    values[:] = words
    return pd.util.hash_array(values, hash_key=hashlib.md5(lang.encode()).hexdigest()[:16], categorize=False)


def join_hashes(first: np.ndarray, more: np.ndarray) -> np.ndarray:
    mixed = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + more
    return mixed ^ (mixed >> np.uint64(32))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text().cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of all words; every task adds up its own first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def made() -> Iterator[pa.RecordBatch]:
            summed = pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")])
            held.clear()
            yield from summed.rename_columns({"n_sum": "n"}).select(["lang", "word", "n"]).to_batches()

        size = 0
        for batch in slices(batches, "text", BATCH_BYTES):
            for lang, texts in by_lang(batch).items():
                coded = coded_words(texts)
                words = coded.dictionary.cast(pa.binary())
                keep = pc.invert(pc.is_in(words, pa.array([b"", b"\n"])))
                counts = pa.array(np.bincount(coded.indices.to_numpy(), minlength=len(words)))
                held.append(pa.table({"lang": pa.array([lang] * len(words), pa.string()), "word": words, "n": counts}).filter(keep))
                size += len(held[-1])
            if size > WORDS:
                yield from made()
                size = 0
        if size:
            yield from made()

    return (_texts(docs).mapInArrow(count, "lang string, word binary, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def bounds(frequent: DataFrame, ranges: int) -> list[tuple[bytes, bytes, bytes]]:
    """Where prefix ranges after the first begin: (lang, first word, second word), in order.

    A word that would fill more than a range is among at most so many as ranges and is cut by second
    words. The other bounds come from a fixed number of words by hash; they set only how even ranges are.
    """
    total = frequent.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // ranges)
    named = frequent.select(F.col("lang").cast("binary").alias("lang"), "word", "n")
    heavy = named.where(F.col("n") > share).collect()  # at most ``ranges`` rows
    light = named.where(F.col("n") <= share).orderBy(F.xxhash64("lang", "word"), "lang", "word").limit(LOOKED).collect()
    seen = sum(row["n"] for row in light)
    scale = (total - sum(row["n"] for row in heavy)) / seen if seen else 0
    words = sorted([(bytes(row["lang"]), bytes(row["word"]), row["n"] * scale) for row in light]
                   + [(bytes(row["lang"]), bytes(row["word"]), float(row["n"])) for row in heavy])

    def quantiles(some: list[tuple[bytes, bytes, float]], parts: int) -> list[tuple[bytes, bytes]]:
        each, found, sum_ = sum(n for *_, n in some) / parts, [], 0.0
        for lang, word, n in some:
            if sum_ >= each * (len(found) + 1) and len(found) < parts - 1:
                found.append((lang, word))
            sum_ += n
        return found

    found = {(lang, word, b"") for lang, word in quantiles(words, ranges)} if words else set()
    for lang, word, n in words:
        if n > share:
            found.add((lang, word, b""))
            own = [row for row in words if row[0] == lang]
            found |= {(lang, word, second) for _, second in quantiles(own, int(n // share) + 1)}
    return sorted(found)


def sequences(docs: DataFrame, orders: tuple[int, ...], words: Broadcast, pairs: Broadcast | None, begins: list) -> DataFrame:
    """``(order, range, payload)``: every task's count transducers, by prefix range.

    With ``pairs`` only sequences all of whose neighbouring words are in that filter are sent.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(words.value)
        held: dict[int, list[list[np.ndarray]]] = {order: [] for order in orders}
        size = 0

        def made() -> Iterator[pa.RecordBatch]:
            names = reader.names
            texts = sorted({word for _, word in names} | {lang.encode() for lang, _ in names})
            place = {word: n for n, word in enumerate(texts)}
            langs = np.array([place[lang.encode()] for lang, _ in names], np.int32)
            ranks = np.array([place[word] for _, word in names], np.int32)
            for order, runs in held.items():
                if not runs:
                    continue
                columns = [np.concatenate(column) for column in zip(*runs)]
                runs.clear()
                columns = [langs[columns[0]]] + [ranks[column] for column in columns]
                columns, counts = automata.sorted_sums(columns, np.ones(len(columns[0]), np.int64), len(texts))
                for number, first, last in cut(columns, texts, begins):
                    payload = automata.build(texts, [column[first:last] for column in columns], counts[first:last]).to_bytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([order], pa.int32()), pa.array([number], pa.int32()), pa.array([payload], pa.binary())],
                        ["order", "range", "payload"])

        for batch in slices(batches, "text", BATCH_BYTES):
            numbers = reader.batch(batch)
            joined = (numbers[:-1] >= 0) & (numbers[1:] >= 0)
            if pairs is not None:
                at = np.flatnonzero(joined)
                keys = join_hashes(reader.hashes[numbers[at]], reader.hashes[numbers[at + 1]])
                joined[at] = bloom.test(pairs.value, keys.view(np.int64))
            for order in orders:
                n = max(len(joined) - order + 2, 0)
                keep = np.ones(n, bool)
                for k in range(order - 1):
                    keep &= joined[k:k + n]
                at = np.flatnonzero(keep)
                if len(at):
                    held[order].append([numbers[at + k] for k in range(order)])
                    size += len(at)
            if size > HELD or len(reader.names) > WORDS:
                yield from made()
                size = 0
                if len(reader.names) > WORDS:
                    reader.forget()
        if size:
            yield from made()

    return _texts(docs).mapInArrow(build, "order int, range int, payload binary")


def cut(columns: list[np.ndarray], texts: list[bytes], begins: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[int, int, int]]:
    """(range, first, last) of sorted sequences (lang, word, ...): the stretches between the ranges' begins."""
    n, wide = len(columns[0]), len(texts) + 1
    key = columns[0].astype(np.int64) * wide + columns[1]
    edges = [0]
    for lang, word, second in begins:
        # a bound that is no word of this task stands before the next one that is
        a, b = bisect_left(texts, lang), bisect_left(texts, word)
        exact = a < len(texts) and texts[a] == lang
        at = int(np.searchsorted(key, a * wide + (b if exact else 0)))
        if second and exact and b < len(texts) and texts[b] == word and len(columns) > 2:
            end = int(np.searchsorted(key, a * wide + b, "right"))
            at += int(np.searchsorted(columns[2][at:end], bisect_left(texts, second)))
        elif second and exact and b < len(texts) and texts[b] == word:
            at = int(np.searchsorted(key, a * wide + b, "right"))  # a word alone stands before all its sequences
        edges.append(max(at, edges[-1]))
    edges.append(n)
    for number in range(len(edges) - 1):
        if edges[number] < edges[number + 1]:
            yield number, edges[number], edges[number + 1]


def unite(parts: DataFrame, least: int) -> DataFrame:
    """``(order, range, payload)`` of the sequences that stand ``least`` times or more, one transducer for a range."""
    def merge(table: pa.Table) -> pa.Table:
        whole = automata.union([automata.Transducer.from_bytes(value.as_py()) for value in table["payload"]], least)
        first = table.slice(0, 1 if whole.words else 0)
        return pa.table({"order": first["order"], "range": first["range"],
                         "payload": pa.array([whole.to_bytes()] if whole.words else [], pa.binary())})

    return parts.groupBy("order", "range").applyInArrow(merge, "order int, range int, payload binary")


ROWS = "lang string, words array<binary>, n long, key long"


def rows_of(counted: DataFrame) -> DataFrame:
    """The sequences of transducers as rows, each with the key that filters know it by."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                whole = automata.Transducer.from_bytes(payload.as_py())
                columns, counts = whole.paths()
                langs = [whole.words[n].decode() for n in columns[0].tolist()]
                words = [[whole.words[n] for n in row] for row in zip(*(column.tolist() for column in columns[1:]))]
                keys = np.zeros(len(langs), np.uint64)
                for lang in set(langs):
                    mine = np.flatnonzero(np.array([one == lang for one in langs]))
                    for place in range(len(columns) - 1):
                        more = word_hashes(lang, [words[n][place] for n in mine.tolist()])
                        keys[mine] = join_hashes(keys[mine], more) if place else more
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(words, pa.list_(pa.binary())), pa.array(counts), pa.array(keys.view(np.int64))],
                    ["lang", "words", "n", "key"])

    return counted.select("payload").mapInArrow(read, ROWS)


def looked_up(asked: DataFrame, counted: DataFrame, begins: list) -> DataFrame:
    """``(lang, part, f)``: the counts of the different ``asked(lang, part array<binary>)``, by composition."""
    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_order: dict[int, list[tuple[bytes, ...]]] = {}
            for lang, part in zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist()):
                by_order.setdefault(len(part), []).append((lang.encode(), *part))
            for order, found in by_order.items():
                found.sort()
                texts = sorted({word for row in found for word in row})
                place = {word: n for n, word in enumerate(texts)}
                columns = [np.array([place[word] for word in column], np.int64) for column in zip(*found)]
                for number, first, last in cut(columns, texts, begins):
                    mine = automata.build(texts, [column[first:last] for column in columns], np.ones(last - first, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int32()), pa.array([order], pa.int32()), pa.array([mine.to_bytes()], pa.binary())],
                        ["range", "order", "asked"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        langs, parts, counts = [], [], []
        if left.num_rows:
            whole = automata.union([automata.Transducer.from_bytes(value.as_py()) for value in left["asked"]])
            columns, found = whole.paths()[0], np.zeros(0, np.int64)
            for value in right["payload"]:  # one transducer, if any
                columns, found = automata.Transducer.from_bytes(value.as_py()).compose(whole)
            found = found if len(found) else np.zeros(len(columns[0]), np.int64)
            langs = [whole.words[n].decode() for n in columns[0].tolist()]
            parts = [[whole.words[n] for n in row] for row in zip(*(column.tolist() for column in columns[1:]))]
            counts = found.tolist()
        return pa.table({"lang": pa.array(langs, pa.string()), "part": pa.array(parts, pa.list_(pa.binary())), "f": pa.array(counts, pa.int64())})

    requests = asked.distinct().mapInArrow(request, "range int, order int, asked binary")
    return requests.groupBy("order", "range").cogroup(counted.groupBy("order", "range")).applyInArrow(
        answer, "lang string, part array<binary>, f long")


def mine(docs: DataFrame, least: int = 30, longest: int = 4, inside: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs(lang, text, ...)``; other columns are not read. A null lang is ``und``, a null or empty text has no words.
    Repeated rows count each time. Ties in score go to larger a, then to the smaller phrase in byte order. A
    phrase goes where a longer candidate around it stands at least ``inside`` percent as often. Counts
    are exact; products are decimals. An empty table, or one without frequent words, gives no rows.
    """
    spark = docs.sparkSession
    singles = written(word_counts(docs), "words")
    totals = singles.groupBy("lang").agg(F.sum("n").alias("all"))
    frequent = singles.where(F.col("n") >= least)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summary = frequent.agg(F.count("*").alias("words"), F.sum("n").alias("n")).first()
    ranges = max(tasks, (summary["n"] or 0) // RANGE + 1)
    begins = bounds(frequent, ranges)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = batch.column("lang").to_pylist(), batch.column("word").to_pylist()
            for lang in set(langs):
                found = word_hashes(lang, [word for one, word in zip(langs, words) if one == lang])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["key"])

    words = bloom.build(frequent.select("lang", "word").mapInArrow(keys, "key long"), summary["words"])
    # words alone, as transducers of the same ranges; then pairs; then all longer sequences of frequent pairs
    counted = written(of_words(frequent, begins), "counts-1")
    counted = counted.unionByName(written(unite(sequences(docs, (2,), words, None, begins), least), "counts-2"))
    candidates = written(rows_of(counted.where("order = 2")), "phrases-2")
    if longest > 2:
        pairs = bloom.build(candidates.select("key"), candidates.count())
        more = written(unite(sequences(docs, tuple(range(3, longest + 1)), words, pairs, begins), least), "counts-3")
        counted = counted.unionByName(more)
        candidates = candidates.unionByName(written(rows_of(more), "phrases-3"))
    candidates = candidates.select("lang", "words", F.col("n").alias("a"))
    cuts = candidates.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"),
        F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    asked = cuts.select("lang", F.explode(F.array("first", "rest")).alias("part"))
    parts = written(looked_up(asked, counted, begins), "parts")
    left = parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    lowest = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
              .groupBy("lang", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")))
    longer = candidates.where(F.size("words") > 2).select("lang", F.col("a").alias("around"), F.explode(_within("words", longest)).alias("words"))
    most = longer.groupBy("lang", "words").agg(F.max("around").alias("around"))
    kept = (lowest.join(most, ["lang", "words"], "left")
            .where(F.col("around").isNull() | (F.expr("cast(around as decimal(20, 0)) * 100") < F.expr(f"cast(a as decimal(20, 0)) * {inside}"))))
    phrase = F.array_join(F.transform("words", lambda word: word.cast("string")), " ")
    ranked = kept.select("lang", phrase.alias("phrase"), "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    best = ranked.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all").alias("n"), "score")


def _within(words: str, longest: int):
    """All shorter phrases of two words or more inside ``words``."""
    pieces = []
    for size in range(2, longest):
        for first in range(1, longest - size + 2):
            fits = (F.size(words) > size) & (F.size(words) >= first + size - 1)
            pieces.append(F.when(fits, F.slice(words, first, size)))
    return F.filter(F.array(*pieces), lambda piece: piece.isNotNull())


def of_words(frequent: DataFrame, begins: list) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted(zip([lang.encode() for lang in batch.column("lang").to_pylist()],
                               batch.column("word").to_pylist(), batch.column("n").to_pylist()))
            texts = sorted({word for row in found for word in row[:2]})
            place = {word: n for n, word in enumerate(texts)}
            columns = [np.array([place[row[k]] for row in found], np.int64) for k in range(2)]
            counts = np.array([row[2] for row in found], np.int64)
            for number, first, last in cut(columns, texts, begins):
                payload = automata.build(texts, [column[first:last] for column in columns], counts[first:last]).to_bytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([1], pa.int32()), pa.array([number], pa.int32()), pa.array([payload], pa.binary())], ["order", "range", "payload"])

    return unite(frequent.select("lang", "word", "n").mapInArrow(build, "order int, range int, payload binary"), 1)


SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM piece
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cuts AS (
  SELECT lang, phrase, a, k, w, c, array_to_string(w[:c], ' ') AS first, array_to_string(w[c + 1:], ' ') AS rest
  FROM cand, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k
), scored AS (
  SELECT t.*, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * t.a) // (x.a + y.a) AS BIGINT) AS score
  FROM cuts AS t JOIN f AS x ON x.lang = t.lang AND x.phrase = t.first AND x.k = t.c
  JOIN f AS y ON y.lang = t.lang AND y.phrase = t.rest AND y.k = t.k - t.c
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), parts AS (
  SELECT lang, a, k, w, unnest(list_concat(
    list_transform(range(1, k), lambda i: w[i:i + 1]), list_transform(range(1, k - 1), lambda i: w[i:i + 2]))) AS part FROM cand WHERE k > 2
), around AS (
  SELECT lang, array_to_string(part, ' ') AS phrase, max(a) AS around FROM parts WHERE len(part) < k GROUP BY ALL
), kept AS (
  SELECT p.lang, p.phrase, p.a, p.l, p.r, p.score FROM lowest AS p LEFT JOIN around AS o ON o.lang = p.lang AND o.phrase = p.phrase
  WHERE o.around IS NULL OR CAST(100 AS HUGEINT) * o.around < CAST(80 AS HUGEINT) * p.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n, k.score FROM ranked AS k JOIN n ON n.lang = k.lang WHERE k.rank <= 2000
"""
