"""Remove passages of a given length that stand anywhere else, by suffix arrays over shards.

Every window of ``length`` bytes is dealt by the least hash of the ``gram``-byte strings inside it, so
equal windows meet. A run of neighbouring windows with one such hash is a piece of text. Pieces whose
hash stands once in the whole corpus cannot repeat and go no further; equal pieces become one with a
count. A shard holds whole groups of pieces with one hash, cut in blocks; a block's suffix array and
permuted common prefixes tell which of its windows repeat. A group too large for a block is dealt anew
by longer grams, last by whole windows, of which a group holds one piece only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import bloom
from tidemark.llm.common import slices, whole_text
from tidemark.llm.suffix import permuted_prefixes, suffix_array
from tidemark.session import written

#: A text is cut into pieces in stretches of so many windows.
STRETCH = 1 << 20
#: Most windows of a piece.
PIECE = 4096
#: Bytes of pieces that one suffix array covers, and that a group may have before it is dealt anew.
BLOCK = 3 << 20
#: Shares of the window that the grams cover, coarse to whole.
GRAMS = (0.32, 0.8, 1.0)


def _gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``gram`` bytes from each place on."""
    base = 0x9E3779B97F4A7C15
    power, width, hashes = base, 1, text.astype(np.uint64) + np.uint64(1)
    out, covered = None, 0
    while True:
        if gram & width:  # put the widths of gram's binary digits one after the other
            if out is None:
                out, covered = hashes, width
            else:
                m = len(text) - covered - width + 1
                out = out[:m] * np.uint64(power) + hashes[covered:covered + m]
                covered += width
        if width * 2 > gram:
            break
        hashes = hashes[:-width] * np.uint64(power) + hashes[width:]
        power, width = power * power % (1 << 64), width * 2
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(33)
    return out


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    least, covered = values, 1
    while covered * 2 <= width:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    return np.minimum(least[:len(values) - width + 1], least[width - covered:]) if covered < width else least


def cut(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """In stretches of joined texts: which text, first and last window, key, key's places, first window's place, joined bytes."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for which, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), STRETCH):
            part = text[at:at + STRETCH + length - 1]
            held.append((which, at, part))
            size += len(part)
            if size >= STRETCH:
                yield _cut(held, length, gram)
                held, size = [], 0
    if held:
        yield _cut(held, length, gram)


def _cut(held: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple:
    joined = b"".join(part for _, _, part in held)
    sizes = np.array([len(part) for _, _, part in held])
    begin = np.cumsum(sizes) - sizes
    grams = _gram_hashes(np.frombuffer(joined, np.uint8), gram)
    width = length - gram + 1
    least = _window_least(grams, width)
    # windows that lie in one text; each differs from the next text's by at least length - 1 places
    valid = np.zeros(len(least) + 1, np.int8)
    np.add.at(valid, begin, 1)
    np.add.at(valid, np.minimum(begin + sizes - length + 1, len(least)), -1)
    inside = np.cumsum(valid[:-1]) > 0
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    change[begin] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(least)) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    runs = last - first + 1
    if (runs > PIECE).any():  # long runs, as in periodic text, are cut
        count = -(-runs // PIECE)
        row = np.repeat(np.arange(len(runs)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        first, last = first[row] + inner * PIECE, np.minimum(first[row] + inner * PIECE + PIECE - 1, last[row])
    key = least[first]
    # how often the key's gram stands in the piece: more than once where its windows may repeat within
    spans = last - first + width
    offsets = np.cumsum(spans) - spans
    places = np.arange(int(spans.sum()), dtype=np.int32) + np.repeat((first - offsets).astype(np.int32), spans)
    times = np.add.reduceat(grams[places] == np.repeat(key, spans), offsets, dtype=np.int64) if len(first) else offsets
    text = np.searchsorted(begin, first, "right") - 1
    which = np.array([w for w, _, _ in held])[text]
    start = first - begin[text] + np.array([at for _, at, _ in held])[text]
    return which, start, last - first, key.view(np.int64), times, first, joined


def _trimmed(pieces: list[bytes], weights: np.ndarray, length: int, gram: int) -> list[tuple[int, int, int]]:
    """The stretches (piece, first, last window) whose longer grams stand more than once among ``pieces``."""
    parts = [(which, start, start + extra, key, times) for which, start, extra, key, times, _, _ in cut(pieces, length, gram)]
    if not parts:
        return []
    which, first, last, key, times = (np.concatenate(column) for column in zip(*parts))
    _, inverse = np.unique(key, return_inverse=True)
    keep = np.bincount(inverse, weights=times * weights[which])[inverse] >= 2
    which, first, last = which[keep], first[keep], last[keep]
    if not len(which):
        return []
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (first[1:] != last[:-1] + 1)
    begin = np.flatnonzero(new)
    return list(zip(which[begin].tolist(), first[begin].tolist(), last[np.append(begin[1:], len(which)) - 1].tolist()))


def repeated_windows(pieces: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece the first bytes of its windows that stand elsewhere too, by one suffix array over all."""
    sizes = np.array([len(piece) for piece in pieces])
    text = np.frombuffer(b"\xff".join(pieces), np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    valid = np.zeros(len(text), bool)
    for at, size in zip(begin.tolist(), sizes.tolist()):
        valid[at:at + max(size - length + 1, 0)] = True
    order = suffix_array(text)
    prefixes = permuted_prefixes(text, order)
    group = np.cumsum(prefixes[order] < length)
    alike = np.bincount(group, weights=valid[order])
    found = np.zeros(len(text), bool)
    found[order] = alike[group] >= 2
    found &= valid
    return [np.arange(max(size - length + 1, 0)) if weight > 1 else np.flatnonzero(found[at:at + size])
            for at, size, weight in zip(begin.tolist(), sizes.tolist(), weights.tolist())]


def _ranges(windows: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """The bytes that the windows cover, as ranges that do not touch."""
    if not len(windows):
        return [], []
    gap = np.flatnonzero(np.diff(windows) > length)
    return windows[np.append(0, gap + 1)].tolist(), (windows[np.append(gap, len(windows) - 1)] + length).tolist()


def _settle(groups: list[list[tuple[bytes, int, int, bytes]]], length: int, trim: int) -> Iterator[tuple[bytes, int, int]]:
    """Covered ranges of the pieces (name, count, times, text) of whole groups."""
    open_ = []
    for group in groups:
        if sum(count * times for _, count, times, _ in group) < 2:
            continue
        if len(group) == 1 and group[0][1] > 1:  # equal pieces: one text, every window stands in each
            yield group[0][0], 0, len(group[0][3])
        else:
            open_.append(group)
    rows = [row for group in open_ for row in group]
    of_group = [n for n, group in enumerate(open_) for _ in group]
    counts = np.array([count for _, count, _, _ in rows], np.int64)
    stretches = _trimmed([text for *_, text in rows], counts, length, trim) if rows else []
    block: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> Iterator[tuple[bytes, int, int]]:
        alike: dict[bytes, int] = {}  # equal stretches stand once, with their counts added
        place = [alike.setdefault(text, len(alike)) for _, _, text in block]
        weights = np.bincount(place, weights=counts[[row for row, _, _ in block]], minlength=len(alike))
        ranges = [_ranges(windows, length) for windows in repeated_windows(list(alike), weights, length)]
        for (row, first, _), at in zip(block, place):
            for start, end in zip(*ranges[at]):
                yield rows[row][0], first + start, first + end

    for row, first, last in stretches:
        if size >= BLOCK and of_group[row] != of_group[block[-1][0]]:
            yield from flush()
            block, size = [], 0
        block.append((row, first, rows[row][3][first:last + length]))
        size += last + length - first
    if block:
        yield from flush()


def covered(units: DataFrame, length: int, level: int = 0) -> DataFrame:
    """``(unit, start, end)``: the bytes of ``units(unit binary, n long, text binary)`` that repeated windows cover.

    ``n`` says how often a row counts. Rows of one unit must hold one text. Ranges of a unit may touch or overlap.
    """
    gram = max(1, int(length * GRAMS[level]))
    trim = max(1, int(length * GRAMS[1]))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            n = batch.column("n").to_numpy()
            for which, _, _, key, times, _, _ in cut(batch.column("text").to_pylist(), length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(times * n[which])], ["key", "times"])

    repeated = written(units.select("n", "text").mapInArrow(keys, "key long, times long")
                       .groupBy("key").agg(F.sum("times").alias("times")).where("times > 1").select("key"), "repeated-keys")
    filter_ = bloom.build(repeated, repeated.count())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sent = filter_.value, set()
        for batch in slices(batches, "text", 4 << 20):
            unit, n = batch.column("unit"), batch.column("n")
            for which, start, extra, key, times, first, joined in cut(batch.column("text").to_pylist(), length, gram):
                keep = np.flatnonzero(bloom.test(words, key))
                names, texts = [], []
                for at, end in zip(first[keep].tolist(), (first[keep] + extra[keep] + length).tolist()):
                    text = joined[at:end]
                    name = xxhash.xxh3_128_digest(text)
                    texts.append(None if name in sent else text)
                    names.append(name)
                    if len(sent) >= 1 << 19:
                        sent.clear()
                    sent.add(name)
                row = pa.array(which[keep])
                yield pa.RecordBatch.from_arrays(
                    [unit.take(row), n.take(row), pa.array(start[keep], pa.int64()), pa.array(key[keep]),
                     pa.array(names, pa.binary()), pa.array(times[keep], pa.int64()), pa.array(texts, pa.binary())],
                    ["unit", "n", "start", "key", "piece", "times", "text"])

    places = written(units.mapInArrow(pieces, "unit binary, n long, start long, key long, piece binary, times long, text binary"), "pieces")
    each = written(places.groupBy("key", "piece").agg(
        F.sum("n").alias("n"), F.max("times").alias("times"), F.max("text").alias("text")), "distinct-pieces")
    large = each.groupBy("key").agg(F.sum(F.length("text")).alias("size")).where(F.col("size") > BLOCK).select("key")
    deeper = level + 1 < len(GRAMS)
    hot = written(large, "large-groups") if deeper else None
    deeper = deeper and not hot.isEmpty()
    rest = each.join(hot, "key", "left_anti") if deeper else each

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple[bytes, int, int, bytes]]] = []
        size, last = 0, None

        def made() -> pa.RecordBatch:
            found = list(_settle(groups, length, trim))
            return pa.RecordBatch.from_arrays(
                [pa.array([name for name, _, _ in found], pa.binary()), pa.array([a for _, a, _ in found], pa.int64()),
                 pa.array([b for _, _, b in found], pa.int64())], ["piece", "from", "to"])

        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("key", "piece", "n", "times", "text"))
            for key, piece, n, times, text in zip(*columns):
                if key != last:
                    if size >= 4 * BLOCK:
                        yield made()
                        groups, size = [], 0
                    groups.append([])
                    last = key
                groups[-1].append((piece, n, times, text))
                size += len(text)
        if groups:
            yield made()

    found = (rest.select("key", "piece", "n", "times", "text").repartition("key").sortWithinPartitions("key", "piece")
             .mapInArrow(settle, "piece binary, from long, to long"))
    if deeper:
        again = covered(each.join(hot, "key", "left_semi").select(F.col("piece").alias("unit"), "n", "text"), length, level + 1)
        found = found.unionByName(again.select(F.col("unit").alias("piece"), F.col("start").alias("from"), F.col("end").alias("to")))
    return places.select("unit", "start", "piece").distinct().join(found, "piece").select(
        "unit", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end"))


def remove(docs: DataFrame, length: int = 400, texts: bool = False) -> DataFrame:
    """Every row of ``docs(doc_id, text, ...)`` without the bytes that a repeated ``length``-byte string covers.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with ``texts`` the
    remaining bytes as ``kept`` (binary: a cut may fall within a character). Strings are judged on the input, in any
    place of any row, repeated rows included. A null or empty text has no bytes. Rows keep their doc_id, null or
    repeated ones too. Extra columns are not read. An empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    keyed = keyed.withColumn("unit", F.unhex(F.md5("text")))
    ranges = (covered(keyed.select("unit", F.lit(1).cast("long").alias("n"), "text"), length).distinct()
              .groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges")))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            columns: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                kept, at, removed, runs, open_end = [], 0, 0, 0, -1
                for span in spans or ():
                    start, end = span["start"], span["end"]
                    if start > open_end:
                        kept.append(text[at:start])
                        runs += 1
                        open_end = at = start
                    if end > open_end:
                        removed += end - open_end
                        open_end = at = end
                kept.append(text[at:])
                whole = b"".join(kept)
                for column, value in zip(columns, (len(text), removed, runs, hashlib.sha256(whole).hexdigest(), whole)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            made = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made[:5 if texts else 4]], ["doc_id", *names[:5 if texts else 4]])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return keyed.join(ranges, "unit", "left").select("doc_id", "text", "ranges").mapInArrow(rest, schema)
