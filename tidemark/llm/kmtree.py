"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample (``SAMPLE`` rows) and sent to the tasks; it has at most
``LEAVES`` leaves, however many rows there are. Every row is indexed under its leaf. A query walks the
tree with a priority queue over unexplored branches, nearest centre first, and so puts leaves in order;
it visits the first ``visits`` of them. That number is calibrated: for ``PROBES`` queries the true
neighbours are found by a scan over all rows, and visits widen until the share of them that lies in
visited leaves reaches ``RECALL``.

Rows and queries meet in groups of leaves: a group's rows stay in one task's memory, and every query that visits
some of its leaves goes there once, with a bit for each. The driver holds the sample, the tree and the leaves'
row counts, all bounded; neither queries nor rows are broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from tidemark.llm.vectors import clean, matrix, packed
from tidemark.session import written

SAMPLE, PROBES, RECALL = 20_000, 200, 0.98
BRANCHES, LEAF_ROWS, LEAVES, ROUNDS = 8, 256, 4_096, 12
BLOCK, HELD = 256, 200_000
#: Groups of leaves: about so many, of so many rows at least and so many bytes (as doubles) at most.
GROUPS, GROUP_ROWS, GROUP_BYTES = 48, 4_096, 64 << 20
#: Entries of a block of distances, and over how many of them one minimum is taken.
ENTRIES, FOLD = 1 << 21, 16
FOUND = "query_id long, vec_id long, score double"


class KMeansTree:
    """Nodes in arrays: a node's children are ``first:last``; a leaf has none and a leaf number."""

    def __init__(self, values: np.ndarray, leaves: int, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.centers, self.first, self.last, self.leaf = [values.mean(0)], [0], [0], [0]
        smallest = max(2, len(values) // max(1, leaves))
        queue = [(-len(values), 0, np.arange(len(values)))]
        count = 1
        while queue and count < leaves:
            size, node, rows = heapq.heappop(queue)  # the largest leaf is split next
            groups = self._split(values[rows], min(BRANCHES, leaves - count + 1), random) if -size > smallest else []
            if len(groups) < 2:
                continue
            self.first[node], self.last[node] = len(self.centers), len(self.centers) + len(groups)
            for group in groups:
                name = len(self.centers)
                self.centers.append(values[rows[group]].mean(0))
                self.first.append(0), self.last.append(0), self.leaf.append(0)
                heapq.heappush(queue, (-len(group), name, rows[group]))
            count += len(groups) - 1
        ends = [node for node in range(len(self.centers)) if self.last[node] == 0]
        for number, node in enumerate(ends):
            self.leaf[node] = number
        self.leaves = len(ends)
        self.centers = np.array(self.centers)

    @staticmethod
    def _split(values: np.ndarray, k: int, random: np.random.Generator) -> list[np.ndarray]:
        chosen = [values[random.integers(len(values))]]
        apart = np.square(values - chosen[0]).sum(1)
        while len(chosen) < k and apart.max() > 0:
            chosen.append(values[random.choice(len(values), p=apart / apart.sum())])
            apart = np.minimum(apart, np.square(values - chosen[-1]).sum(1))
        centers = np.array(chosen)
        for _ in range(ROUNDS):
            near = (np.square(centers).sum(1) - 2 * values @ centers.T).argmin(1)
            moved = np.array([values[near == c].mean(0) if (near == c).any() else centers[c] for c in range(len(centers))])
            if np.allclose(moved, centers):
                break
            centers = moved
        return [rows for c in range(len(centers)) if len(rows := np.flatnonzero(near == c))]

    def assign(self, values: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into, nearest centre at every node."""
        out = np.zeros(len(values), np.int32)
        todo = [(0, np.arange(len(values)))]
        while todo:
            node, rows = todo.pop()
            if self.last[node] == 0:
                out[rows] = self.leaf[node]
                continue
            centers = self.centers[self.first[node]:self.last[node]]
            near = (np.square(centers).sum(1) - 2 * values[rows] @ centers.T).argmin(1)
            todo += [(self.first[node] + c, rows[near == c]) for c in np.unique(near).tolist()]
        return out

    def leaves_by_nearness(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of a best-bin-first traversal."""
        queue, order = [(0.0, 0)], []
        known = np.square(self.centers - query).sum(1).tolist() if 4 * most >= self.leaves else None  # most will be asked for
        while queue and len(order) < most:
            _, node = heapq.heappop(queue)
            if self.last[node] == 0:
                order.append(self.leaf[node])
                continue
            a, b = self.first[node], self.last[node]
            for child, far in zip(range(a, b), known[a:b] if known else np.square(self.centers[a:b] - query).sum(1).tolist()):
                heapq.heappush(queue, (far, child))
        return order

    def leaves_in_order(self) -> list[int]:
        """All leaves, those of one branch together."""
        todo, order = [0], []
        while todo:
            node = todo.pop()
            if self.last[node] == 0:
                order.append(self.leaf[node])
            todo += range(self.first[node], self.last[node])
        return order


class Groups:
    """Leaves in groups of at most ``most`` rows; a leaf of more rows has several groups, to which its rows are dealt in turn."""

    def __init__(self, order: list[int], counts: dict[int, int], most: int) -> None:
        self.first, self.lots = np.zeros(len(order), np.int32), np.ones(len(order), np.int32)
        self.leaves: list[np.ndarray] = []  # of each group
        open_: list[int] = []
        held = 0

        def close() -> None:
            if open_:
                self.first[open_] = len(self.leaves)
                self.leaves.append(np.array(open_))
                open_.clear()

        for leaf in order:
            count = counts.get(leaf, 0)
            if count > most:
                self.first[leaf], self.lots[leaf] = len(self.leaves), -(-count // most)
                self.leaves += [np.array([leaf])] * int(self.lots[leaf])
                continue
            if held + count > most:
                close()
                held = 0
            open_.append(leaf)
            held += count
        close()


class Candidates:
    """Rows that blocks of queries meet."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.met = ids, np.empty((len(ids), values.shape[1] + 1))
        self.values, length = self.met[:, :-1], self.met[:, -1]
        self.values[:] = values
        with np.errstate(over="ignore"):
            np.square(values).sum(1, out=length)
        self.longest, self.width = length.max(), -(-len(ids) // FOLD)
        self.block = max(1, min(BLOCK, ENTRIES // (FOLD * self.width)))

    def nearest(self, names: np.ndarray, asked: np.ndarray, k: int, spans: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        """Each query's ``k`` nearest of the rows it may see; spans: rows ``first:last`` and the numbers of their queries.

        The squared length of a row less twice its product with the query orders as the distance does, but for
        rounding. It leaves out what is farther than the ``k`` nearest by more than that; the rest is measured.
        """
        with np.errstate(over="ignore"):
            reach = np.square(asked).sum(1) + self.longest
        if not reach.max() < 1e300:  # squares of huge values overflow
            with np.errstate(over="ignore"):
                return nearest_kept(rows_out([
                    nearest_of(names[n], np.sqrt(np.square(self.values[a:b] - asked[n]).sum(1)), self.ids[a:b], k)
                    for a, b, who in spans for n in who.tolist()]), k)
        near = np.full((len(names), FOLD * self.width), np.inf)
        sought = np.column_stack([-2 * asked, np.ones(len(asked))])
        for a, b, who in spans:
            near[who, a:b] = sought[who] @ self.met[a:b].T
        for row in np.flatnonzero(np.isin(self.ids, names)):
            near[names == self.ids[row], row] = np.inf
        bar = np.full(len(names), np.inf)
        if self.width >= k:  # k of the least values of parts: at least k rows are as near
            bar = np.partition(near.reshape(len(names), FOLD, self.width).min(1), k - 1, axis=1)[:, k - 1]
        bar = bar + 8 * (asked.shape[1] + 8) * np.finfo(float).eps * reach + np.finfo(float).tiny
        query, row = np.nonzero(near <= np.minimum(bar, np.finfo(float).max)[:, None])
        score, step = np.empty(len(row)), max(1, ENTRIES // asked.shape[1])
        for at in range(0, len(row), step):
            some = slice(at, at + step)
            score[some] = np.sqrt(np.square(self.values[row[some]] - asked[query[some]]).sum(1))
        return nearest_kept(rows_out([(names[query], self.ids[row], score)]), k)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def rows_out(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate([part[n] for part in parts]) if parts else np.zeros(0) for n in range(3)]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.float64))],
        ["query_id", "vec_id", "score"])


def nearest_kept(found: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """Each query's ``k`` nearest of what was found."""
    query, name, score = (found.column(n).to_numpy() for n in ("query_id", "vec_id", "score"))
    order = np.lexsort((name, score, query))
    first = np.flatnonzero(np.diff(query[order], prepend=query[order][:1] - 1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return found.take(pa.array(order[rank < k]))


def combined(parts: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The same answers, each query's ``k`` nearest of a whole task instead of every page's.

    A task holds ``HELD`` rows at most; where its queries need more than half of that, it hands them on.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for part in parts:
        held.append(part)
        count += part.num_rows
        if count >= HELD:
            kept = nearest_kept(pa.Table.from_batches(held).combine_chunks().to_batches()[0], k)
            held, count = [kept], kept.num_rows
            if count > HELD // 2:
                yield kept
                held, count = [], 0
    if count:
        yield nearest_kept(pa.Table.from_batches(held).combine_chunks().to_batches()[0], k)


def nearest_of(query: int, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    other = np.flatnonzero(ids != query)
    if len(other) > k:
        bar = np.partition(scores[other], k - 1)[k - 1]
        other = other[scores[other] <= bar]
    order = other[np.lexsort((ids[other], scores[other]))][:k]
    return np.full(len(order), query), ids[order], scores[order]


def by_leaf(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], leaves: np.ndarray) -> tuple[Candidates, np.ndarray]:
    """The rows of some batches (leaf, ids, values) in the order of ``leaves``, and where each leaf begins; empties the list."""
    leaf = np.concatenate([batch[0] for batch in held])
    place = np.argsort(leaves)[np.searchsorted(np.sort(leaves), leaf)]
    order = np.argsort(place, kind="stable")
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(len(order))
    ids, values = np.empty(len(order), np.int64), np.empty((len(order), held[0][2].shape[1]))
    at = len(order)
    while held:
        _, some, vectors = held.pop()
        at -= len(some)
        ids[to[at:at + len(some)]], values[to[at:at + len(some)]] = some, vectors
    return Candidates(ids, values), np.searchsorted(place[order], np.arange(len(leaves) + 1))


def drawn(rows: DataFrame, hashed: Column, most: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values of the ``most`` of ``total`` rows that come first by ``hashed`` (64 bits), then by vector.

    Only rows with hashes low enough are ordered, and a task hands on the packed rows: the driver gets no others.
    """
    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("vec_id").to_numpy().tobytes()], pa.binary()),
                     pa.array([packed(matrix(batch.column("vector")))], pa.binary())], ["ids", "values"])

    share = (most + 8 * most ** 0.5) / max(1, total)
    while True:
        low = rows.where(hashed < int(share * 2.0 ** 64 - 2.0 ** 63)) if share < 0.9 else rows
        got = low.orderBy(hashed, "vector").limit(most).mapInArrow(together, "ids binary, values binary").collect()
        ids = np.frombuffer(b"".join(row["ids"] for row in got), np.int64)
        if share >= 0.9 or len(ids) >= min(most, total):
            return ids, np.frombuffer(b"".join(row["values"] for row in got)).reshape(len(ids), -1 if len(ids) else 0)
        share *= 2


def exact_nearest(rows: DataFrame, names: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """True neighbours of a bounded list of queries, by one scan over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((names, queries))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near = Candidates(batch.column("vec_id").to_numpy(), matrix(batch.column("vector")))
            for at in range(0, len(names), near.block):
                some = names[at:at + near.block]
                yield near.nearest(some, queries[at:at + near.block], k, [(0, batch.num_rows, np.arange(len(some)))])

    return best(rows.select("vec_id", "vector").mapInArrow(lambda batches: combined(scan(batches), k), FOUND), k)


def calibrate(tree: KMeansTree, queries: list[tuple[int, np.ndarray]], truth: dict[int, list[int]], recall: float) -> int:
    """Visits after which ``recall`` of the true neighbours (given by leaf) have been met."""
    ranks: list[int] = []
    for name, query in queries:
        place = {leaf: n for n, leaf in enumerate(tree.leaves_by_nearness(query, tree.leaves))}
        ranks += [place[leaf] + 1 for leaf in truth.get(name, [])]
    if not ranks:
        return tree.leaves
    return max(1, int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose vec_id is divisible by ``every``, the ``k``
    nearest other rows that the tree finds, by Euclidean distance on the original vectors, ties to the
    smaller vec_id.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor does a
    null vec_id. Vectors of another length than the query's are not compared with it; each length has a tree
    of its own. Rows that repeat a vec_id are candidates of their own for other queries; as a query, a vec_id
    counts once, by its shortest, then smallest vector. A query that finds fewer than ``k`` rows in its leaves
    visits all leaves. An empty table gives an empty one. Other columns are not read.
    """
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)  # stored as they came, compared as doubles
    rows = clean(vectors, zero=False).withColumn("vector", F.col("vector").cast("array<float>" if single else "array<double>"))
    given = written(rows, "kmtree-rows", "dims")
    asked = given.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dims", "vector")).alias("q"))
    asked = written(asked.select("vec_id", "q.*"), "kmtree-queries", "dims")
    found = None
    for row in given.groupBy("dims").count().orderBy("dims").collect():  # a row per length
        mine = F.col("dims") == row["dims"]
        more = nearest_of_length(given.where(mine).select("vec_id", "vector"), asked.where(mine).select("vec_id", "vector"),
                                 row["count"], k, recall)
        found = more if found is None else found.unionByName(more)
    if found is None:
        return given.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    return found


def nearest_of_length(rows: DataFrame, queries: DataFrame, total: int, k: int, recall: float) -> DataFrame:
    """``nearest`` for written rows and queries (vec_id, vector) of one length."""
    spark = rows.sparkSession
    tree = KMeansTree(drawn(rows, F.xxhash64("vec_id"), SAMPLE, total)[1], max(1, min(LEAVES, total // LEAF_ROWS)))
    shared = spark.sparkContext.broadcast(tree)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.assign(matrix(batch.column("vector")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(leaf, pa.int32())], ["vec_id", "leaf"])

    index = written(rows.mapInArrow(indexed, "vec_id long, leaf int"), "kmtree-index")
    asked = queries.count()
    names, probes = drawn(queries, F.xxhash64(F.lit(3), "vec_id"), PROBES, asked)
    known = exact_nearest(rows, names, probes, k).select("query_id", "vec_id")  # at most PROBES * k rows
    true = index.join(F.broadcast(known), "vec_id").select("query_id", "vec_id", "leaf").distinct()
    leaves: dict[int, list[int]] = {}
    for row in true.collect():  # at most PROBES * k rows
        leaves.setdefault(row["query_id"], []).append(row["leaf"])
    visits = calibrate(tree, list(zip(names.tolist(), probes)), leaves, recall)

    counts = {row["leaf"]: row["count"] for row in index.groupBy("leaf").count().collect()}  # at most LEAVES rows
    dims = tree.centers.shape[1]
    most = max(1, min(max(GROUP_ROWS, -(-total // GROUPS)), GROUP_BYTES // (8 * dims)))
    groups = spark.sparkContext.broadcast(Groups(tree.leaves_in_order(), counts, most))
    dealt = f"group int, asked boolean, leaf int, visits binary, vec_id long, vector {rows.schema['vector'].dataType.simpleString()}"

    def row_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, lots, at = groups.value.first, groups.value.lots, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = shared.value.assign(matrix(batch.column("vector")))
            turn = np.arange(at, at + len(leaf))
            at += len(leaf)
            yield pa.RecordBatch.from_arrays(
                [pa.array((first[leaf] + turn % lots[leaf]).astype(np.int32)), pa.array(np.zeros(len(leaf), bool)), pa.array(leaf, pa.int32()),
                 pa.nulls(len(leaf), pa.binary()), batch.column("vec_id"), batch.column("vector")],
                ["group", "asked", "leaf", "visits", "vec_id", "vector"])

    def search(wanted: DataFrame, count: int, most: int) -> DataFrame:
        def query_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (batch.slice(at, BLOCK) for batch in batches for at in range(0, batch.num_rows, BLOCK)):
                visit = np.full((part.num_rows, shared.value.leaves), most >= shared.value.leaves)
                if most < shared.value.leaves:
                    for n, query in enumerate(matrix(part.column("vector"))):
                        visit[n, shared.value.leaves_by_nearness(query, most)] = True
                for group, leaves in enumerate(groups.value.leaves):
                    if len(who := np.flatnonzero(visit[:, leaves].any(1))):
                        bits = np.packbits(visit[np.ix_(who, leaves)], axis=1)
                        some = part.take(pa.array(who))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(who), group, np.int32)), pa.array(np.ones(len(who), bool)), pa.nulls(len(who), pa.int32()),
                             pa.array([row.tobytes() for row in bits], pa.binary()), some.column("vec_id"), some.column("vector")],
                            ["group", "asked", "leaf", "visits", "vec_id", "vector"])

        def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A group's rows come first and are held; its queries meet them block by block, leaf by leaf."""
            group, held, near, bounds = None, [], None, np.zeros(0)
            for batch in batches:
                number, ask = batch.column("group").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.diff(number * 2 + ask, prepend=-1))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                    part = batch.slice(a, b - a)
                    if number[a] != group:
                        group, held, near = number[a], [], None
                    ids, values = part.column("vec_id").to_numpy(), matrix(part.column("vector"))
                    if not ask[a]:
                        held.append((part.column("leaf").to_numpy(), ids, values))
                        continue
                    leaves = groups.value.leaves[group]
                    if held:
                        near, bounds = by_leaf(held, leaves)
                    if near is None:  # a group without rows
                        continue
                    visit = np.frombuffer(b"".join(part.column("visits").to_pylist()), np.uint8).reshape(len(ids), -1)
                    visit = np.unpackbits(visit, axis=1, count=len(leaves)).astype(bool)
                    for at in range(0, len(ids), near.block):
                        some = slice(at, at + near.block)
                        spans = [(bounds[n], bounds[n + 1], np.flatnonzero(visit[some, n])) for n in range(len(leaves)) if bounds[n] < bounds[n + 1]]
                        yield near.nearest(ids[some], values[some], k, spans)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return combined(answers(batches), k)

        spread = wanted.repartition(max(1, count // BLOCK), "vec_id")
        both = rows.mapInArrow(row_groups, dealt).unionByName(spread.mapInArrow(query_groups, dealt))
        both = both.repartitionById(len(groups.value.leaves), "group").sortWithinPartitions("group", "asked")
        return best(both.mapInArrow(meet, FOUND), k)

    found = search(queries, asked, visits)
    if visits < tree.leaves:
        found = written(found, "kmtree-found")
        short = queries.join(found.where(F.col("rank") == min(k, total - 1)).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
        again = written(short, "kmtree-short")
        if not again.isEmpty():
            found = found.join(again.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(search(again, asked, tree.leaves))
    return found.select("query_id", "rank", "vec_id", "score")
