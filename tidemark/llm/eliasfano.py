"""Token ids in segments whose document boundaries are Elias-Fano coded.

A segment is one binary value, little endian throughout:

    4 bytes  "TKEF"
    uint8    bytes of an id: 2 where the vocabulary has at most 65,536 ids, else 4
    uint8    l, low bits of a boundary
    uint16   documents between two select samples
    uint32   n, documents; uint32 documents without a number (they come first)
    uint64   ids
    int64    document numbers, n minus those without one
    uint32   select samples: the place of every so many-th one in the high bits
    bytes    low bits, l for each boundary; bytes high bits, unary; then the ids

Boundary i is where document i ends. Its high part is the place of the i-th one in the high bits less
i, found from the nearest sample by counting ones; no table of 64-bit offsets exists. Documents lie in
ascending order within a segment, and segments in ascending (part, seq) order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import slices, whole_text
from tidemark.llm.encode import Encoder

HEAD = struct.Struct("<4sBBHIIQ")
SAMPLE = 128
#: A segment closes at so many ids or documents; a longer document has a segment of its own.
SEGMENT_IDS, SEGMENT_DOCUMENTS = 1 << 20, 1 << 16
BATCH_BYTES = 8 << 20
SEGMENTS = "part int, seq int, n_docs long, n_ids long, payload binary"


class Boundaries:
    """Elias-Fano code of ascending numbers, the last of which is the total."""

    def __init__(self, n: int, low: int, samples: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> None:
        self.n, self.low, self.samples, self.lows, self.highs = n, low, samples, lows, highs

    @classmethod
    def of(cls, ends: np.ndarray) -> "Boundaries":
        n = len(ends)
        total = int(ends[-1]) if n else 0
        low = max(0, (total // n).bit_length() - 1) if n else 0
        bits = (ends[:, None] >> np.arange(low)) & 1
        places = (ends >> low) + np.arange(n)
        ones = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        ones[places] = 1
        return cls(n, low, places[::SAMPLE].astype(np.uint32),
                   np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(ones, bitorder="little"))

    def select(self, i: int) -> int:
        """Where document ``i`` ends; -1 is the beginning."""
        if i < 0:
            return 0
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        bits = int(self.highs[byte]) & (0xFF << at % 8) & 0xFF
        while bits.bit_count() <= left:  # skip whole bytes
            left -= bits.bit_count()
            byte += 1
            bits = int(self.highs[byte])
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        value, begin = 0, i * self.low
        for k in range(self.low):
            value |= (int(self.lows[(begin + k) // 8]) >> (begin + k) % 8 & 1) << k
        return (place - i) << self.low | value

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[:self.n]
        bits = np.unpackbits(self.lows, bitorder="little", count=self.n * self.low).reshape(self.n, self.low)
        lows = (bits.astype(np.int64) << np.arange(self.low)).sum(1)
        return (places - np.arange(self.n)) << self.low | lows


def pack(numbers: list[int | None], ids: np.ndarray, ends: np.ndarray, width: int) -> bytes:
    coded = Boundaries.of(ends)
    named = [number for number in numbers if number is not None]
    return b"".join([
        HEAD.pack(b"TKEF", width, coded.low, SAMPLE, len(numbers), len(numbers) - len(named), len(ids)),
        np.array(named, "<i8").tobytes(), coded.samples.astype("<u4").tobytes(), coded.lows.tobytes(),
        struct.pack("<I", len(coded.highs)), coded.highs.tobytes(), ids.astype(f"<u{width}").tobytes()])


class Segment:
    """Reads one packed value."""

    def __init__(self, payload: bytes) -> None:
        magic, width, low, sample, self.n, nameless, n_ids = HEAD.unpack_from(payload)
        if magic != b"TKEF" or sample != SAMPLE:
            raise ValueError("not a token segment")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, count, at)
            at += found.nbytes
            return found

        named = take("<i8", self.n - nameless)
        self.numbers: list[int | None] = [None] * nameless + named.tolist()
        samples = take("<u4", -(-self.n // SAMPLE))
        lows = take("u1", -(-self.n * low // 8))
        highs = take("u1", int(take("<u4", 1)[0]))
        self.boundaries = Boundaries(self.n, low, samples, lows, highs)
        self.ids = take(f"<u{width}", n_ids)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.boundaries.select(i - 1):self.boundaries.select(i)]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text of ``docs(doc_id, text, ...)`` whole and write the segments as Parquet rows.

    Rows go in ascending doc_id order, those without a doc_id first; rows with one doc_id are ordered
    by a hash of the text, so that reruns write the same. A null or empty text is the end id alone.
    Other columns are not read. An empty table writes no segment. The one exchange is by doc_id range.
    """
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        part, seq = TaskContext.get().partitionId(), 0
        numbers: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        count = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, count
            ends = np.cumsum(np.concatenate(sizes))
            payload = pack(numbers, np.concatenate(held), ends, width)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(numbers)], pa.int64()),
                 pa.array([count], pa.int64()), pa.array([payload], pa.binary())],
                ["part", "seq", "n_docs", "n_ids", "payload"])
            seq, count = seq + 1, 0
            numbers.clear(), held.clear(), sizes.clear()
            return row

        for batch in slices(batches, "text", BATCH_BYTES):
            ids, where = encoder.batch(batch.column("text"), end_id)
            names = batch.column("doc_id").to_pylist()
            first = 0
            while first < len(names):
                last = max(first + 1, int(np.searchsorted(where, where[first] + SEGMENT_IDS - count, "right")) - 1)
                last = min(last, len(names), first + SEGMENT_DOCUMENTS - len(numbers))
                numbers += names[first:last]
                held.append(ids[where[first]:where[last]])
                sizes.append(np.diff(where[first:last + 1]))
                count += int(where[last] - where[first])
                if count >= SEGMENT_IDS or len(numbers) >= SEGMENT_DOCUMENTS or last < len(names):
                    yield close()
                first = last
        if numbers:
            yield close()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    (keyed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
     .mapInArrow(segments, SEGMENTS)
     .write.option("compression", "zstd").mode("errorifexists").parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the written segments: doc_id, start, n_tokens, ids_crc32 (of uint32 ids)."""
    written = spark.read.schema(SEGMENTS).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row["payload"])
                ends = segment.boundaries.all()
                starts = np.concatenate([[0], ends[:-1]]) if segment.n else ends
                wide = memoryview(segment.ids.astype("<u4").tobytes())
                sums = [zlib.crc32(wide[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(segment.n, row["part"], np.int32)), pa.array(np.full(segment.n, row["seq"], np.int32)),
                     pa.array(segment.numbers, pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(ends - starts, pa.int64()), pa.array(sums, pa.int64())],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    # ids before a segment: over the parts, of which there are as many as tasks, then within the part
    parts = written.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before_part = parts.select("part", (F.sum("ids").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias("before_part"))
    before = written.select("part", "seq", (F.sum("n_ids").over(
        Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("n_ids")).alias("before"))
    bases = before.join(before_part, "part").select("part", "seq", (F.col("before") + F.col("before_part")).alias("base"))
    found = written.select("part", "seq", "payload").mapInArrow(
        documents, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(bases, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
