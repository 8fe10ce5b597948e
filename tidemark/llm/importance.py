"""Resample documents toward a target corpus by hashed n-gram importance weights.

A document is scanned once per pass: separators become single spaces and the running CRC-32 at every
word's end is kept. CRC-32 is affine over GF(2), so the CRC of any run of words needs only two of the
running values: that at its end, and that before its start moved over the run's bytes. Moving a value
over L zero bytes is a linear map; four tables of 256 entries per length state it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import whole_text
from tidemark.session import written

#: Words are runs of digits, lower-case letters and everything beyond ASCII; all else separates.
NORMAL = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte >= 128 else 32
    for byte in range(256))
#: A text is scanned in stretches of about so many bytes.
STRETCH = 1 << 20
#: Lengths with tables of their own; longer moves are made of these and of doubled ones.
TABLED = 128


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


STEP = _byte_table()


def _apply(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    return tables[0][values & 255] ^ tables[1][values >> 8 & 255] ^ tables[2][values >> 16 & 255] ^ tables[3][values >> 24]


def _moves() -> np.ndarray:
    """For each length below TABLED, four tables that move a value's bytes over so many zero bytes."""
    moved = np.empty((TABLED, 4, 256), np.uint32)
    moved[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for length in range(1, TABLED):
        before = moved[length - 1]
        moved[length] = (before >> 8) ^ STEP[before & 255]
    return moved


def _doubled(once: np.ndarray) -> list[np.ndarray]:
    """Tables for TABLED zero bytes and for 2, 4, 8 ... times as many."""
    tables = [(once >> 8) ^ STEP[once & 255]]
    for _ in range(24):
        tables.append(_apply(tables[-1], tables[-1]))
    return tables


MOVED = _moves()
DOUBLED = _doubled(MOVED[-1])


def shift(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values moved over so many zero bytes each."""
    step = lengths % TABLED
    out = (MOVED[step, 0, values & 255] ^ MOVED[step, 1, values >> 8 & 255]
           ^ MOVED[step, 2, values >> 16 & 255] ^ MOVED[step, 3, values >> 24])
    times = lengths // TABLED
    for bit, tables in enumerate(DOUBLED):
        more = np.flatnonzero(times >> bit & 1) if times.any() else ()
        if len(more):
            out[more] = _apply(tables, out[more])
    return out


class Scan:
    """CRC-32 of every run of 1 to ``longest`` words of the texts given in stretches."""

    def __init__(self, longest: int) -> None:
        self.longest = longest

    def _runs(self, befores: np.ndarray, ends: np.ndarray, sizes: np.ndarray, room: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
        """CRCs of runs that end at word ``fresh`` or later, and the word at which each ends.

        ``befores`` and ``ends`` are running CRCs before and after each word, ``sizes`` the words' bytes,
        ``room`` how many words of the same text stand before each.
        """
        places = np.concatenate([[0], np.cumsum(sizes + 1)])
        found, at = [], []
        for n in range(self.longest):
            last = np.flatnonzero(room >= n)
            last = last[last >= fresh]
            first = last - n
            length = places[last + 1] - 1 - places[first]
            found.append(ends[last] ^ shift(befores[first], length))
            at.append(last)
        return np.concatenate(found), np.concatenate(at)

    def texts(self, values: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
        """In stretches: CRCs, the text each belongs to, and (text, words) of what was read."""
        held: list[tuple[int, list[bytes]]] = []
        size = 0
        for text, value in enumerate(values):
            if len(value) <= STRETCH:
                held.append((text, value.translate(NORMAL).split()))
                size += len(value)
                if size > STRETCH:
                    yield self._whole(held)
                    held, size = [], 0
            else:
                yield from self._long(text, value)
        if held:
            yield self._whole(held)

    def _whole(self, held: list[tuple[int, list[bytes]]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        counts = np.array([len(words) for _, words in held])
        running: list[int] = []
        sizes: list[int] = []
        for _, words in held:
            running += _running(words)
            sizes += map(len, words)
        owner = np.repeat(np.array([text for text, _ in held]), counts)
        room = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        ends = np.array(running, np.uint32)
        befores = _after_space(np.concatenate([[0], ends[:-1]]).astype(np.uint32))
        befores[room == 0] = 0
        found, at = self._runs(befores, ends, np.array(sizes, np.int64), room, 0)
        return found, owner[at], [(text, len(words)) for text, words in held]

    def _long(self, text: int, value: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
        """One text in stretches that end between words; the running CRC and the last words go along."""
        crc, words_before, rest = 0, 0, b""
        kept = [np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)]
        for start in range(0, len(value), STRETCH):
            piece = rest + value[start:start + STRETCH].translate(NORMAL)
            if start + STRETCH < len(value):
                cut = piece.rfind(b" ") + 1
                piece, rest = piece[:cut], piece[cut:]
            words = piece.split()
            if not words:
                continue
            ends = np.array(_running(words, crc if words_before else None), np.uint32)
            befores = _after_space(np.concatenate([[crc], ends[:-1]]).astype(np.uint32))
            if not words_before:
                befores[0] = 0
            fresh, crc = len(kept[0]), int(ends[-1])
            new = [befores, ends, np.array(list(map(len, words)), np.int64)]
            befores, ends, sizes = (np.concatenate(pair) for pair in zip(kept, new))
            room = np.arange(len(ends)) + words_before - fresh
            found, _ = self._runs(befores, ends, sizes, np.minimum(room, np.arange(len(ends))), fresh)
            words_before += len(words)
            kept = [a[-(self.longest - 1):] if self.longest > 1 else a[:0] for a in (befores, ends, sizes)]
            yield found, np.full(len(found), text), [(text, len(words))]


def _running(words: list[bytes], before: int | None = None) -> list[int]:
    """The running CRC at the end of each word of the normalised text; ``before`` is that of earlier words."""
    crc32 = zlib.crc32
    if before is None:
        if not words:
            return []
        return list(accumulate(words[1:], lambda crc, word: crc32(word, crc32(b" ", crc)), initial=crc32(words[0])))
    return list(accumulate(words, lambda crc, word: crc32(word, crc32(b" ", crc)), initial=before))[1:]


def _after_space(values: np.ndarray) -> np.ndarray:
    register = ~values
    return ~((register >> np.uint32(8)) ^ STEP[(register ^ np.uint32(32)) & np.uint32(255)])


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """How many features of ``texts(text binary)`` fall in each bucket; every task sums its own first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scan = np.zeros(buckets, np.int64), Scan(longest)
        for batch in batches:
            for found, _, _ in scan.texts(batch.column("text").to_pylist()):
                total += np.bincount(found % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return texts.select(_bytes()).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _bytes() -> Column:
    return whole_text().cast("binary").alias("text")


def gains(docs: DataFrame, target: DataFrame, buckets: int, longest: int) -> DataFrame:
    """One row per bucket: its gain, 1000 times the log ratio of the smoothed bucket rates, floored."""
    spark = docs.sparkSession
    both = (bucket_counts(target, buckets, longest).select("bucket", F.col("n").alias("t"), F.lit(0).cast("long").alias("s"))
            .unionByName(bucket_counts(docs, buckets, longest).select("bucket", F.lit(0).cast("long").alias("t"), F.col("n").alias("s")))
            .unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("s"))))
    each = written(both.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("s").alias("s")), "bucket-counts")
    sums = each.agg(F.sum("t").alias("t"), F.sum("s").alias("s")).first()
    ratio = ((F.col("t") + 1) * F.lit(float(sums["s"] + buckets))) / ((F.col("s") + 1) * F.lit(float(sums["t"] + buckets)))
    return each.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weigh(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """``docs`` as (doc_id, text) to (doc_id, n_words, n_features, weight)."""
    context = docs.sparkSession.sparkContext
    shared, buckets = context.broadcast(gain), len(gain)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, gain = Scan(longest), shared.value
        for batch in batches:
            n = batch.num_rows
            features, weight, words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for found, owner, read in scan.texts(batch.column("text").to_pylist()):
                features += np.bincount(owner, minlength=n)
                order = np.argsort(owner, kind="stable")
                first = np.flatnonzero(np.diff(owner[order], prepend=-1))
                if len(first):
                    weight[owner[order][first]] += np.add.reduceat(gain[found[order] % buckets], first)
                for text, count in read:
                    words[text] += count
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _bytes()).mapInArrow(
        each, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 3, percent: int = 5,
             min_words: int = 20, seed: int = 42) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``min_words`` words, by weight and Gumbel noise.

    Returns for every row of ``docs(doc_id, text, ...)`` doc_id, n_features, weight, score, rank and
    n_words; rank is null where a row is not drawn. The noise depends on seed and doc_id alone (a null
    doc_id counts as an empty string), so reruns agree. A null or empty text has no features and weight 0. Ties
    go to the smaller doc_id, null first, then to fewer features; rows equal in all of these are
    interchangeable. Repeated rows count each time. Extra columns are not read. An empty table gives no rows.

    Each task sends at most ``buckets`` sums, whatever its texts. The order is settled by score ranges:
    only the ranges' row counts meet in one place.
    """
    spark = docs.sparkSession
    rows = gains(docs, target, buckets, longest).toPandas()  # one row per bucket
    gain = np.zeros(buckets, np.int64)
    gain[rows["bucket"].to_numpy()] = rows["gain"].to_numpy()
    weighed = weigh(docs, gain, longest)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    scored = weighed.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))))
    eligible = F.col("n_words") >= min_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc()]
    dealt = written(
        scored.withColumn("_row", F.monotonically_increasing_id())  # so that no repeated row fills a range
        .repartitionByRange(F.when(eligible, F.col("score")).desc_nulls_last(), F.col("doc_id"), F.col("n_features"), F.col("_row"))
        .drop("_row").withColumn("_part", F.spark_partition_id()), "scored")
    parts = dealt.where(eligible).groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # one row per task
    before = np.cumsum([0, *(row["n"] for row in parts)]).tolist()
    drawn = percent * before[-1] // 100
    bases = spark.createDataFrame([(row["_part"], n) for row, n in zip(parts, before)], "_part int, _before long")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    best = (dealt.where(eligible).join(F.broadcast(bases.where(F.col("_before") < drawn)), "_part")
            .withColumn("rank", place)
            .withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("_before"))
    last = max([row["_part"] for row, n in zip(parts, before) if n < drawn], default=-1)
    others = dealt.where(~eligible | (F.col("_part") > last)).withColumn("rank", F.lit(None).cast("long"))
    return best.unionByName(others).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"), "n_words")
