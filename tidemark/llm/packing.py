"""Best-fit packing of token pieces under several capacities at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import slices, whole_text
from tidemark.llm.encode import Encoder

BATCH_BYTES = 4 << 20
#: Pieces that are packed together. A block leaves at most about one sequence part-filled.
BLOCK = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds: tokens, pieces, and attention cost (the sum of squared piece lengths).

    The defaults of the last two follow from the first, so that only tokens bind.
    """

    tokens: int = 2048
    pieces: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"  # or "dot"


def vector_best_fit(lengths: np.ndarray, room: Capacities) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins.

    Pieces come longest first. Each goes to the open bin, among those with room in every dimension, that
    "norm" leaves the smallest weighted residual, or where "dot" finds the largest weighted product of
    need and residual; shares of capacity throughout, the oldest bin on ties. Without one, a bin opens.
    A piece too large for an empty bin still gets its own.
    """
    full = np.array([room.tokens, room.pieces, room.attention], float)
    weights = np.array(room.weights)
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.zeros((3, 1024))
    names = np.zeros(1024, np.int64)
    used = opened = 0
    smallest = float(lengths.min()) if len(lengths) else 0
    for turn, at in enumerate(order.tolist()):
        size = float(lengths[at])
        need = np.array([size, 1.0, size * size])
        best = -1
        if used:
            after = left[:, :used] - need[:, None]
            fits = (after >= 0).all(0)
            if fits.any():
                if room.rule == "norm":
                    score = -(weights[:, None] * np.square(after / full[:, None])).sum(0)
                else:
                    score = (weights[:, None] * (need / full)[:, None] * (left[:, :used] / full[:, None])).sum(0)
                best = int(np.where(fits, score, -np.inf).argmax())
        if best < 0:
            if used == left.shape[1]:
                left, names = np.hstack([left, np.zeros_like(left)]), np.concatenate([names, np.zeros_like(names)])
            best, used = used, used + 1
            left[:, best], names[best] = full, opened
            opened += 1
        bins[at], offsets[at] = names[best], full[0] - left[0, best]
        left[:, best] -= need
        if turn % 256 == 255:  # bins that no piece can enter any more
            stay = np.flatnonzero((left[0, :used] >= smallest) & (left[1, :used] >= 1))
            left[:, :len(stay)], names[:len(stay)], used = left[:, stay], names[stay], len(stay)
    return bins, offsets, opened


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, room: Capacities = Capacities(),
              extra_ids: bool = False) -> DataFrame:
    """Every row's ids (null or empty text: the end id alone), cut only where they exceed a sequence.

    With ``extra_ids`` a column ``ids`` holds the piece's ids as little-endian uint32. A document's
    pieces are told apart by ``piece``; repeated rows give repeated pieces.
    """
    longest = room.tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in slices(batches, "text", BATCH_BYTES):
            ids, where = encoder.batch(batch.column("text"), end_id)
            sizes = np.diff(where)
            counts = -(-sizes // longest)
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * longest
            length = np.minimum(longest, sizes[row] - start)
            held = memoryview(ids.astype("<u4", copy=False).tobytes())
            begin = where[row] + start
            spans = [held[4 * a:4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist())]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if extra_ids:
                columns, names = [*columns, pa.array(map(bytes, spans), pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return keyed.mapInArrow(cut, PIECES + (", ids binary" if extra_ids else ""))


def place(pieces: DataFrame, room: Capacities = Capacities(), block: int = BLOCK) -> DataFrame:
    """Assign ``pieces(doc_id, piece, start, length, ids_crc32)`` to sequences.

    Only these narrow rows are exchanged, evenly by hash; each task packs its rows block by block, so
    memory is bounded and no key can be hot. Within a sequence offsets have no gap.
    """
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(held).combine_chunks()
            bins, offsets, _ = vector_best_fit(rows["length"].to_numpy(), room)
            sequence = bins + (part << 40) + (number << 20)
            number += 1
            held.clear()
            rows = rows.append_column("sequence_id", pa.array(sequence, pa.int64()))
            return rows.append_column("offset", pa.array(offsets, pa.int64())).to_batches()[0]

        for batch in batches:
            while batch.num_rows:
                free = block - sum(b.num_rows for b in held)
                held.append(batch.slice(0, free))
                batch = batch.slice(free)
                if sum(b.num_rows for b in held) >= block:
                    yield close()
        if held:
            yield close()

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return (pieces.select(*names, F.monotonically_increasing_id().alias("_row"))
            .repartition(F.xxhash64("doc_id", "piece", "_row"))
            .sortWithinPartitions(*names).drop("_row").mapInArrow(packed, PLACED))
