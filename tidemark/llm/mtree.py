"""Exact top-k by inner product over paged M-trees.

Rows are dealt to pages' trees near one another: a bounded sample gives pivots, each row goes to its
nearest pivot, and a task builds one tree per ``TREE`` rows of a pivot. A node page holds up to ``PAGE``
entries; each entry stores its distance to the page's routing object, and each inner entry a covering
radius and the largest norm below it. Distances are Euclidean; since

    2 <q, o> = |q|^2 + |o|^2 - d(q, o)^2

a lower bound of a distance is an upper bound of the score. By the triangle inequality an entry is no
nearer than |d(q, routing) - d(routing, entry)|, so entries that cannot reach the k-th best score are
left out before their distance is computed. Pages are visited best bound first.

Every tree first answers its own queries, which gives each query a k-th best score to begin with. Then
blocks of queries meet all other trees; a query leaves a tree at the root when its bound is too low.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.vectors import clean, matrix
from tidemark.session import written

PAGE, TREE, BLOCK, LANES = 64, 8_192, 256, 32
SAMPLE, PIVOTS = 4_096, 64
NODES = "tree long, dims int, rows long, payload binary"
HITS = "query_id long, vec_id long, score long"


class Tree:
    """Pages in arrays. Entry e of a level covers entries ``child[e]:child[e + 1]`` of the level below."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = self._near_order(values)
        self.ids, values = ids[order], values[order].astype(np.float64)
        self.levels: list[dict[str, np.ndarray]] = []
        norms = np.einsum("ij,ij->i", values, values)
        reach = np.zeros(len(values))
        while True:
            bounds = np.arange(0, len(values) + PAGE, PAGE).clip(max=len(values))
            bounds = np.unique(bounds)
            center = np.array([values[a + self._medoid(values[a:b])] for a, b in zip(bounds, bounds[1:])])
            page = np.repeat(np.arange(len(center)), np.diff(bounds))
            apart = np.sqrt(np.square(values - center[page]).sum(1))
            radius = np.maximum.reduceat(apart + reach, bounds[:-1])
            top = np.maximum.reduceat(norms, bounds[:-1])
            self.levels.append({"values": values, "norms": norms, "parent": apart, "reach": reach, "child": bounds})
            if len(center) == 1:
                self.root = {"values": center, "norms": top, "reach": radius}
                break
            values, norms, reach = center, top, radius

    @staticmethod
    def _medoid(values: np.ndarray) -> int:
        return int(np.square(values - values.mean(0)).sum(1).argmin())

    @staticmethod
    def _near_order(values: np.ndarray) -> np.ndarray:
        """Rows so that neighbours lie together: halves along the widest direction, again and again."""
        done: list[np.ndarray] = []
        todo = [np.arange(len(values))]
        while todo:
            rows = todo.pop()
            if len(rows) <= PAGE:
                done.append(rows)
                continue
            part = values[rows].astype(np.float64)
            far = part[np.square(part - part[0]).sum(1).argmax()]
            other = part[np.square(part - far).sum(1).argmax()]
            along = np.argsort(part @ (far - other), kind="stable")
            half = -(-len(rows) // (2 * PAGE)) * PAGE
            todo += [rows[along[half:]], rows[along[:half]]]
        return np.concatenate(done)

    def bound(self, query: np.ndarray, square: float) -> float:
        """The highest score that anything in the tree can have."""
        apart = float(np.sqrt(np.square(self.root["values"][0] - query).sum()))
        low = max(0.0, apart - float(self.root["reach"][0]))
        return (square + float(self.root["norms"][0]) - low * low) / 2

    def search(self, query: np.ndarray, k: int, own: int, least: float) -> list[tuple[int, int]]:
        """(score, -id) of the best k whose score is ``least`` or more, the query's own id left out."""
        square = float(query @ query)
        best: list[tuple[int, int]] = []
        apart = float(np.sqrt(np.square(self.root["values"][0] - query).sum()))
        queue = [(-np.inf, len(self.levels) - 1, 0, apart)]
        while queue:
            lead, depth, page, routing = heapq.heappop(queue)
            level = self.levels[depth]
            need = max(least, float(best[0][0])) if len(best) == k else least
            if -lead < need - 1e-6 * (1 + abs(need)):
                break
            a, b = level["child"][page], level["child"][page + 1]
            reach, norms = level["reach"][a:b], level["norms"][a:b]
            low = np.maximum(0, np.abs(routing - level["parent"][a:b]) - reach)
            slack = need - 1e-6 * (1 + abs(need))
            keep = np.flatnonzero((square + norms - low * low) / 2 >= slack)
            if not len(keep):
                continue
            values = level["values"][a:b][keep]
            if depth == 0:
                scores = np.rint(values @ query).astype(np.int64)
                for score, name in zip(scores.tolist(), self.ids[a:b][keep].tolist()):
                    if name == own or score < least:
                        continue
                    one = (score, -name)
                    if len(best) < k:
                        heapq.heappush(best, one)
                    elif one > best[0]:
                        heapq.heapreplace(best, one)
            else:
                far = np.sqrt(np.square(values - query).sum(1))
                low = np.maximum(0, far - reach[keep])
                bounds = (square + norms[keep] - low * low) / 2
                for at in np.flatnonzero(bounds >= slack).tolist():
                    heapq.heappush(queue, (-float(bounds[at]), depth - 1, int(a + keep[at]), float(far[at])))
        return best

    def dump(self) -> bytes:
        import io

        out = io.BytesIO()
        arrays = {"ids": self.ids, **{f"root_{k}": v for k, v in self.root.items()}}
        for n, level in enumerate(self.levels):
            arrays |= {f"{n}_{k}": v.astype(np.int32) if k == "values" and n == 0 else v for k, v in level.items()}
        np.savez(out, levels=len(self.levels), **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, payload: bytes) -> "Tree":
        import io

        tree = cls.__new__(cls)
        with np.load(io.BytesIO(payload)) as found:
            names = {name: found[name] for name in found.files}
        tree.ids = names["ids"]
        tree.root = {k: names[f"root_{k}"] for k in ("values", "norms", "reach")}
        tree.levels = [{k: names[f"{n}_{k}"].astype(np.float64) if k == "values" else names[f"{n}_{k}"]
                        for k in ("values", "norms", "parent", "reach", "child")} for n in range(int(names["levels"]))]
        return tree


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, dims, vector`` with every component floor(scale * x), x as double."""
    return clean(vectors).withColumn("vector", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))


def hits(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def build(vectors: DataFrame) -> DataFrame:
    """The trees, one row each: a page file of up to ``TREE`` vectors of one dimension, near each other."""
    spark = vectors.sparkSession
    sample = vectors.where("dims > 0").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("dims", "vector").collect()
    pivots: dict[int, np.ndarray] = {}
    for dims in {row["dims"] for row in sample}:
        values = np.array([row["vector"] for row in sample if row["dims"] == dims])
        chosen = [0]  # farthest first, so that pivots spread over the sample
        apart = np.square(values - values[0]).sum(1)
        while len(chosen) < min(PIVOTS, len(values)) and apart.max() > 0:
            chosen.append(int(apart.argmax()))
            apart = np.minimum(apart, np.square(values - values[chosen[-1]]).sum(1))
        pivots[dims] = values[chosen]
    shared = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims in np.unique(batch.column("dims").to_numpy()).tolist():
                rows = batch.filter(pa.array(batch.column("dims").to_numpy() == dims))
                values = matrix(rows.column("vector"))
                centers = shared.value.get(dims)
                if centers is None:
                    pivot = np.zeros(len(values), np.int32)
                else:
                    pivot = (np.square(centers).sum(1) - 2 * values @ centers.T).argmin(1).astype(np.int32)
                yield rows.append_column("pivot", pa.array(pivot, pa.int32()))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = pa.Table.from_batches(held)
            held.clear()
            for dims in np.unique(rows["dims"].to_numpy()).tolist():
                some = rows.filter(pa.array(rows["dims"].to_numpy() == dims))
                tree = Tree(some["vec_id"].to_numpy(), matrix(some["vector"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + number], pa.int64()), pa.array([dims], pa.int32()),
                     pa.array([some.num_rows], pa.int64()), pa.array([tree.dump()], pa.binary())],
                    ["tree", "dims", "rows", "payload"])
                number += 1

        for batch in batches:
            while batch.num_rows:
                free = TREE - sum(b.num_rows for b in held)
                held.append(batch.slice(0, free))
                batch = batch.slice(free)
                if sum(b.num_rows for b in held) >= TREE:
                    yield from close()
        if held:
            yield from close()

    # rows of a pivot are spread by hash over a few tasks, so that a common vector is no hot key
    near = vectors.mapInArrow(nearest, "vec_id long, dims int, vector array<double>, pivot int")
    return (near.repartition("pivot", F.pmod(F.xxhash64("vec_id"), F.lit(8)))
            .sortWithinPartitions("dims", "pivot", "vec_id").mapInArrow(trees, NODES))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose vec_id is divisible by ``every``, the ``k``
    other rows of highest integer inner product of quantised vectors, ties to the smaller vec_id.

    Vectors that are null, empty, or hold a null or non-finite component take no part, nor does a null
    vec_id. Vectors of another length than the query's are not compared with it. Rows that repeat a
    vec_id are candidates of their own for other queries; as a query, a vec_id counts once, by its
    smallest vector, and its own rows are not its candidates. Fewer than ``k`` candidates are all
    returned. An empty table gives an empty one. Other columns are not read.
    """
    rows = quantised(vectors)
    trees = written(build(written(rows, "mtree-rows")), "mtree-pages")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dims").agg(
        F.min("vector").alias("vector"), F.count("*").alias("times"))
    queries = written(queries.groupBy("vec_id").agg(F.min(F.struct("dims", "vector")).alias("q"), F.sum("times").alias("times"))
                      .select("vec_id", "q.*", "times"), "mtree-queries")

    # blocks of queries, of one dimension each
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for dims in np.unique(batch.column("dims").to_numpy()).tolist():
                some = batch.filter(pa.array(batch.column("dims").to_numpy() == dims))
                for first in range(0, some.num_rows, BLOCK):
                    cut = some.slice(first, BLOCK)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(part << 32) + number], pa.int64()), pa.array([dims], pa.int32()),
                         pa.array([cut.column("vec_id").to_numpy().tobytes()], pa.binary()),
                         pa.array([matrix(cut.column("vector")).tobytes()], pa.binary()),
                         pa.array([cut.column("least").to_numpy(zero_copy_only=False).tobytes()], pa.binary())],
                        ["block", "dims", "ids", "values", "least"])
                    number += 1

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                name = batch.column("tree")[at].as_py()
                if name != last:
                    last, tree = name, Tree.load(batch.column("payload")[at].as_py())
                ids = np.frombuffer(batch.column("ids")[at].as_py(), np.int64)
                values = np.frombuffer(batch.column("values")[at].as_py(), np.float64).reshape(len(ids), -1)
                floors = np.frombuffer(batch.column("least")[at].as_py(), np.float64)
                found = []
                for own, query, floor in zip(ids.tolist(), values, floors.tolist()):
                    if tree.bound(query, float(query @ query)) >= floor - 1e-6 * (1 + abs(floor)):
                        found += [(own, -name, score) for score, name in tree.search(query, k, own, floor)]
                yield hits(found)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every tree's own queries, against that tree alone: a floor for each."""
        for batch in batches:
            for at in range(batch.num_rows):
                tree = Tree.load(batch.column("payload")[at].as_py())
                own = np.flatnonzero(tree.ids % every == 0)
                found = []
                for row in own.tolist():
                    scores = tree.search(tree.levels[0]["values"][row], k, int(tree.ids[row]), -np.inf)
                    if len(scores) == k:
                        found.append((int(tree.ids[row]), 0, min(scores)[0]))
                yield hits(found)

    floors = trees.mapInArrow(home, HITS).groupBy("query_id").agg(F.min("score").cast("double").alias("least"))
    floored = queries.join(floors, queries["vec_id"] == floors["query_id"], "left").select(
        "vec_id", "dims", "vector",  # a floor of a repeated vec_id may be another row's
        F.coalesce(F.when(F.col("times") == 1, F.col("least")), F.lit(float("-inf"))).alias("least"))
    block = written(floored.repartition(F.expr(f"vec_id div {every * BLOCK}")).mapInArrow(
        blocks, "block long, dims int, ids binary, values binary, least binary"), "mtree-blocks")
    # the stated query set against all trees, in blocks: each block goes to every lane of trees once
    lanes = block.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))).withColumnRenamed("dims", "_dims")
    paged = trees.withColumn("lane", F.pmod(F.xxhash64("tree"), F.lit(LANES)).cast("int"))
    met = paged.join(lanes, (paged["lane"] == lanes["lane"]) & (F.col("dims") == F.col("_dims"))).select(
        "tree", "payload", "ids", "values", "least")
    return best(met.mapInArrow(visit, HITS)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
