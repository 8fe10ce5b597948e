"""SimHash fingerprints and their comparison on vertical bit planes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import WORD, slices, whole_text
from tidemark.llm.components import components
from tidemark.session import written

SEED = 42
BITS = 64
BATCH_BYTES = 16 << 20
#: Fingerprints of one group that a task compares at a time; larger groups are cut into pairs of chunks.
CHUNK = 8_192
#: Rows that a task holds at least before it compares, and (query, word) items per pass.
HELD, ITEMS = 1 << 17, 1 << 14
#: Bytes that a task holds at least before it compares, and bytes of shingle sets in a chunk.
HELD_BYTES, CHUNK_BYTES = 32 << 20, 16 << 20
#: One fingerprint in so many is looked at to find groups that need cutting.
LOOKED_AT = 16
ONES = np.uint64(2**64 - 1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of so many words, A-Z lower-cased, repeats included; a shorter text is one run."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1:].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; none: zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        rows = hashes[first:first + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, fingerprint`` of every row, from its whole text; null or empty texts have zero."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            found = [majority(shingle_hashes(text.encode(), words)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return keyed.mapInArrow(digests, "doc_id long, fingerprint long")


class Planes:
    """Groups of fingerprints as bit planes: lane i of word w of plane b is bit b of one fingerprint.

    Every group begins a new word. ``sizes`` are the groups' row counts, rows in group order.
    """

    def __init__(self, prints: np.ndarray, sizes: np.ndarray) -> None:
        self.words = -(-sizes // 64)
        self.first_word = np.cumsum(self.words) - self.words
        self.first_row = np.cumsum(sizes) - sizes
        group = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(prints)) - self.first_row[group]
        self.lane = self.first_word[group] * 64 + inside
        self.group, self.inside, self.prints = group, inside, prints
        total = int(self.words.sum())
        self.row_of = np.zeros(total * 64, np.int64)
        self.row_of[self.lane] = np.arange(len(prints))
        self.planes = np.zeros((BITS, total), np.uint64)
        bits = np.zeros(total * 64, np.uint8)
        for b in range(BITS):
            bits[self.lane] = (prints >> np.uint64(b)) & np.uint64(1)
            self.planes[b] = np.packbits(bits, bitorder="little").view(np.uint64)
        bits[:] = 0
        bits[self.lane] = 1
        self.present = np.packbits(bits, bitorder="little").view(np.uint64)

    def near(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (a < b) of one group that differ in at most ``radius`` bits, in portions."""
        own = self.inside // 64
        todo = self.words[self.group] - own  # words from the row's own on
        upto = np.cumsum(todo)
        first = 0
        while first < len(todo):
            base = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, base + ITEMS, "right")))
            rows = np.repeat(np.arange(first, last), todo[first:last])
            step = np.arange(len(rows)) - np.repeat(upto[first:last] - todo[first:last] - base, todo[first:last])
            word = self.first_word[self.group[rows]] + own[rows] + step
            valid = self.present[word].copy()
            mine = step == 0  # in its own word a row meets the lanes after its own
            lane = (self.inside[rows[mine]] % 64).astype(np.uint64)
            valid[mine] &= (ONES << lane) & ~(np.uint64(1) << lane)
            yield from self._count(rows, word, valid, radius)
            first = last

    def _count(self, rows: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        alive = np.flatnonzero(valid)
        rows, word, valid = rows[alive], word[alive], valid[alive]
        levels = [np.zeros(len(rows), np.uint64) for _ in range(radius.bit_length())]
        over = ~valid
        for b in range(BITS):
            mine = np.uint64(0) - ((self.prints[rows] >> np.uint64(b)) & np.uint64(1))
            carry = self.planes[b][word] ^ mine
            for k, level in enumerate(levels):  # carry-save: add one bit to 64 counters at once
                levels[k], carry = level ^ carry, level & carry
            over |= carry
            if b % 8 == 7:
                more, same = np.zeros_like(over), np.full_like(over, ONES)
                for k in reversed(range(len(levels))):
                    if radius >> k & 1:
                        same &= levels[k]
                    else:
                        more |= same & levels[k]
                        same &= ~levels[k]
                over |= more
                stay = over != ONES
                if stay.mean() < 0.75 if len(stay) else False:  # abandon words all of whose lanes exceed
                    rows, word, over = rows[stay], word[stay], over[stay]
                    levels = [level[stay] for level in levels]
                if not len(rows):
                    return
        hit = np.flatnonzero(~over)
        lanes = np.unpackbits((~over[hit]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        item, lane = np.nonzero(lanes)
        yield rows[hit[item]], self.row_of[word[hit[item]] * 64 + lane]


class Forest:
    """Union of rows; the root is the smallest row."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.parent[rows]
        while True:
            above = self.parent[found]
            if (above == found).all():
                return found
            found = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            if not len(low):
                return
            np.minimum.at(self.parent, high, low)
            a, b = low, high


def group_edges(groups: DataFrame, node: str, radius: int,
                check: Callable[[np.ndarray, np.ndarray, pa.Table], np.ndarray] | None = None,
                rest: Callable[[pa.Table, np.ndarray, Forest], None] | None = None) -> DataFrame:
    """A spanning forest ``a, b`` (of ``node``) of the links within each group of ``groups(group, print, node, ...)``.

    Rows are exchanged by group. ``check`` may refuse links: it gets row pairs that are not yet joined.
    ``rest`` joins what is alike beyond ``radius``; it gets the rows, the groups' sizes and the forest.
    """
    kind = dict(groups.dtypes)[node]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(rows: pa.Table) -> pa.RecordBatch | None:
            group = rows["group"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(group)]]))
            many = np.repeat(sizes > 1, sizes)
            if not many.any():
                return None
            rows, sizes = rows.filter(pa.array(many)), sizes[sizes > 1]
            planes, forest = Planes(rows["print"].to_numpy().view(np.uint64), sizes), Forest(rows.num_rows)
            for a, b in planes.near(radius):
                if check is not None:
                    for at in range(0, len(a), 512):
                        x, y = a[at:at + 512], b[at:at + 512]
                        apart = forest.roots(x) != forest.roots(y)
                        x, y = x[apart], y[apart]
                        good = check(x, y, rows) if len(x) else np.zeros(0, bool)
                        forest.join(x[good], y[good])
                else:
                    forest.join(a, b)
            if rest is not None:
                rest(rows, sizes, forest)
            roots = forest.roots(np.arange(rows.num_rows))
            tied = np.flatnonzero(roots != np.arange(len(roots)))
            nodes = rows[node].combine_chunks()
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(tied)), nodes.take(pa.array(roots[tied]))], ["a", "b"])

        size = weight = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            weight += batch.nbytes
            if size >= HELD or weight >= HELD_BYTES:
                rows = pa.Table.from_batches(held).combine_chunks()
                group = rows["group"].to_numpy()
                cut = int(np.searchsorted(group == group[-1], True))  # the last group may go on
                if cut:
                    if (out := compare(rows.slice(0, cut))) is not None:
                        yield out
                    rows = rows.slice(cut)
                held, size, weight = rows.to_batches(), rows.num_rows, rows.nbytes
        if held and (out := compare(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return groups.repartition("group").sortWithinPartitions("group", node).mapInArrow(edges, f"a {kind}, b {kind}")


def cut_large(keyed: DataFrame, large: DataFrame, node: str) -> DataFrame:
    """Adds ``group`` to ``keyed(key, ...)``. ``large(key, chunks)``: the rows of these keys are dealt to
    chunks, and every pair of chunks is a group; so no group is unbounded and no pair is lost."""
    joined = keyed.join(large, "key", "left")
    chunk = F.pmod(F.xxhash64(F.lit(1), node), F.coalesce("chunks", F.lit(1))).cast("long")
    pairs = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1),
        lambda other: F.least(other, chunk) * F.col("chunks") + F.greatest(other, chunk)))
    dealt = joined.withColumn("pair", F.explode(pairs))
    return dealt.withColumn("group", F.xxhash64("key", "pair")).drop("key", "chunks", "pair")


def masks(radius: int, spare: int = 2) -> list[int]:
    """Masks of which two prints within ``radius`` agree on one at least.

    The bits are cut into ``radius + spare`` blocks; at least ``spare`` of them stay equal.
    """
    blocks = radius + spare
    cuts = [round(BITS * k / blocks) for k in range(blocks + 1)]
    block = [sum(1 << bit for bit in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(block, spare)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def linked_prints(prints: DataFrame, radius: int) -> DataFrame:
    """A spanning forest of all pairs of the distinct ``print`` values within ``radius`` bits."""
    tables = F.array(*[F.xxhash64(F.lit(n), F.col("print").bitwiseAND(F.lit(signed(mask)))) for n, mask in enumerate(masks(radius))])
    keyed = prints.select("print", F.explode(tables).alias("key"))
    looked = prints.where(F.pmod(F.xxhash64("print"), F.lit(LOOKED_AT)) == 0).select(F.explode(tables).alias("key"))
    large = written(looked.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * LOOKED_AT > CHUNK).select(
        "key", F.ceil(F.col("n") * LOOKED_AT / F.lit(CHUNK)).alias("chunks")), "simhash-large")
    groups = cut_large(keyed, large, "print").withColumn("node", F.col("print"))
    return group_edges(groups, "node", radius)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text, ...)``.

    Texts link when their fingerprints differ in at most ``radius`` bits, all such pairs counting. The
    component's id is the smallest doc_id in it. Equal fingerprints are one node, so copies are never
    paired. Null text counts as empty; rows without words have fingerprint zero and link like others. A
    null doc_id stays null and names no component unless no other is there. Repeated rows stay. An
    empty table gives an empty one. Other columns are not read.
    """
    rows = written(fingerprints(docs, words), "simhash-rows")
    nodes = written(rows.groupBy(F.col("fingerprint").alias("print")).agg(F.min("doc_id").alias("least")), "simhash-prints")
    root = components(linked_prints(nodes.select("print"), radius))
    placed = nodes.join(root, nodes["print"] == root["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select(F.col("print").alias("fingerprint"), "component_id")
    return rows.join(named, "fingerprint").select("doc_id", hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# --- keeping one text of each group of near copies -------------------------------------------------

COPY_WORDS, SIMILARITY, COPY_RADIUS, KEYS, BINS = 5, 0.8, 20, 4, 256


def text_node() -> Column:
    """The text's digest; texts without words are one text."""
    return F.md5(F.when(whole_text().rlike(WORD), whole_text()).otherwise(""))


def smallest(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, node, keys, shingles`` per row: the text's digest, its smallest shingle hashes, and how
    many different ones it has."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            keys, counts = [], []
            for text in batch.column("text").to_pylist():
                distinct = np.unique(shingle_hashes(text.encode(), words))
                keys.append(distinct[:KEYS].view(np.int64).tolist())
                counts.append(len(distinct))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.int64())],
                ["doc_id", "node", "keys", "shingles"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_node().alias("node"), whole_text().alias("text"))
    return keyed.mapInArrow(sketch, "doc_id long, node string, keys array<long>, shingles long")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``node, groups, print, shingles`` of ``texts(node, groups, text)``: every different shingle hash in
    order, and the fingerprint in which each has one vote, however often it stands in the text."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            prints, kept = [], []
            for text in batch.column("text").to_pylist():
                distinct = np.unique(shingle_hashes(text.encode(), words))
                prints.append(majority(distinct))
                kept.append(distinct.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("groups"), pa.array(prints, pa.int64()), pa.array(kept, pa.binary())],
                ["node", "groups", "print", "shingles"])

    return texts.select("node", "groups", "text").mapInArrow(sets, "node string, groups array<long>, print long, shingles binary")


def set_of(rows: pa.Table, row: int) -> np.ndarray:
    return np.frombuffer(rows["shingles"][row].as_buffer(), "<u8")


def alike(similarity: float) -> Callable[[np.ndarray, np.ndarray, pa.Table], np.ndarray]:
    """Refuses pairs whose whole shingle sets are less similar."""
    def check(a: np.ndarray, b: np.ndarray, rows: pa.Table) -> np.ndarray:
        seen: dict[int, np.ndarray] = {}

        def of(row: int) -> np.ndarray:
            if row not in seen:
                seen[row] = set_of(rows, row)
            return seen[row]

        good = np.zeros(len(a), bool)
        for at, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            merged = np.sort(np.concatenate([of(x), of(y)]))
            shared = int((merged[1:] == merged[:-1]).sum())
            good[at] = shared >= similarity * (len(merged) - shared)
        return good

    return check


def all_alike(similarity: float) -> Callable[[pa.Table, np.ndarray, Forest], None]:
    """Joins every pair of a group that is similar enough, however far apart the fingerprints are.

    Pairs already joined are left out, and those that cannot reach ``similarity``: two sets share at most
    the sum, over ``BINS`` ranges of hashes, of the smaller count.
    """
    check = alike(similarity)

    def rest(rows: pa.Table, sizes: np.ndarray, forest: Forest) -> None:
        lengths = pa.compute.binary_length(rows["shingles"]).to_numpy().astype(np.int64) // 8
        first = 0
        for size in sizes.tolist():
            members = np.arange(first, first + size)
            first += size
            if len(np.unique(forest.roots(members))) == 1:
                continue
            members = members[np.argsort(lengths[members], kind="stable")]
            count = lengths[members]
            bins = np.stack([np.bincount((set_of(rows, row) >> np.uint64(56)).astype(np.int64), minlength=BINS) for row in members.tolist()]).astype(np.uint32)
            upto = np.searchsorted(count, count / similarity + 1, "right")
            for at in range(size - 1):
                others = np.arange(at + 1, upto[at])
                others = others[forest.roots(members[others]) != forest.roots(members[at:at + 1])]
                most = np.minimum(bins[others], bins[at]).sum(1, dtype=np.int64)
                others = others[most >= similarity * (count[at] + count[others] - most)]
                if len(others):
                    near = members[others]
                    mine = np.full(len(near), members[at])
                    good = check(mine, near, rows)
                    forest.join(mine[good], near[good])

    return rest


def keep_one(docs: DataFrame, words: int = COPY_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of exact and near copies: the one with the smallest doc_id.

    Different texts that share one of their ``KEYS`` smallest shingle hashes link when their whole sets of
    shingles have ``similarity`` or more of their union. Bit planes find the pairs within ``COPY_RADIUS``
    bits first; pairs beyond are checked as well. Two sets of that similarity share a key but for one
    pair in several hundred. Groups are connected components. Null texts and texts without words are
    copies of each other. A null doc_id counts as the largest. Of fully repeated rows one stays. Columns
    and their order stay.
    """
    rows = written(smallest(docs, words), "copies-keys-of")
    null_last = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    texts = written(rows.groupBy("node").agg(F.min(null_last).alias("least"), F.first("keys").alias("keys"),
                                             F.first("shingles").alias("shingles")), "copies-texts")
    keyed = texts.select("node", "shingles", F.explode("keys").alias("key"))
    counted = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("shingles").alias("shingles"),
        *[F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"mark{k}") for k in range(2)]).where("n > 1")
    # keys of the same texts give the same pairs: one of them is enough
    shared = written(counted.groupBy("n", "shingles", "mark0", "mark1").agg(F.min("key").alias("key")), "copies-keys")
    chunks = F.ceil(F.greatest(F.col("n") / F.lit(CHUNK), F.col("shingles") * 8 / F.lit(CHUNK_BYTES)))
    large = shared.select("key", chunks.alias("chunks")).where("chunks > 1")
    members = cut_large(keyed.select("node", "key").join(shared.select("key"), "key"), large, "node")
    per_text = members.groupBy("node").agg(F.collect_set("group").alias("groups"))
    wanted = written(per_text.join(texts.select("node", "least"), "node"), "copies-wanted")
    held = docs.select(text_node().alias("node"), null_last.alias("least"), whole_text().alias("text")).join(wanted, ["node", "least"])
    groups = shingle_sets(held, words).select("node", "print", "shingles", F.explode("groups").alias("group"))
    root = components(group_edges(groups, "node", COPY_RADIUS, alike(similarity), all_alike(similarity)))
    placed = texts.select("node", "least").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min(F.struct("least", "node")).alias("best")).select("best.*")
    times = rows.select("node", null_last.alias("least")).groupBy("node", "least").agg(F.count("*").alias("times"))
    kept = written(best.join(times, ["node", "least"]).withColumnsRenamed({"node": "_node", "least": "_least", "times": "_times"}), "copies-kept")
    named = docs.select(F.struct(*docs.columns).alias("_row"), text_node().alias("_node"), null_last.alias("_least"))
    once = named.join(kept.where("_times = 1").drop("_times"), ["_node", "_least"], "left_semi")
    again = named.join(kept.where("_times > 1").drop("_times"), ["_node", "_least"], "left_semi").dropDuplicates(["_node", "_least"])
    return once.unionByName(again).select("_row.*")
