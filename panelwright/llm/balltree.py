"""Exact top-k inner-product search: a ball tree per shard of vectors, searched by branch and bound."""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

LEAF = 128
#: Below it the sums of products of whole numbers are exact in a double, in any order.
EXACT = 2.0**52
LARGEST = float(np.finfo(np.float64).max)
LONG = (1 << 63) - 1


def vectors(table: DataFrame, scale: int = 256, column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of each component, a whole number of any size; shorter vectors
    are filled up with zeros. A product beyond the doubles counts as the largest double.

    Rows with a null vec_id or vector, or with a component that is null or not finite, are left out; no other
    row is.
    """
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    wide = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col(column), lambda x: x.cast("double")).alias("v"))
    wide = wide.where("vec_id is not null and v is not null").where(F.forall("v", finite))
    product = lambda x: F.least(F.lit(LARGEST), F.greatest(F.lit(-LARGEST), F.lit(float(scale)) * x))
    below = lambda y: F.rint(y) - (F.rint(y) > y).cast("double")  # noqa: E731  floor without a cast to long
    found = wide.select("vec_id", F.transform(F.transform("v", product), below).alias("v"))
    dims = found.agg(F.max(F.size("v"))).first()[0] or 0
    short = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("v")))
    return found.select("vec_id", F.when(F.size("v") < dims, short).otherwise(F.col("v")).alias("v"))


def _rows(flat: np.ndarray, n: int) -> np.ndarray:
    return flat.reshape(n, len(flat) // max(1, n))


def exact_score(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of two vectors of whole numbers, as a whole number of any size."""
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x**2).sum(axis=1))


class BallTree:
    """Nodes are ranges of rows; a node's rows lie within its radius of its centre. All of it is arrays, so that a
    tree is built where its shard is packed and only read where it is searched."""

    PARTS = ("ids", "x", "shape", "centre", "radius", "far")

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order, shape = np.arange(len(ids)), []
        self._split(order, x, 0, len(ids), shape)
        self.ids, self.x = ids[order].astype(np.int64), x[order].astype(np.float64)
        self.shape = np.array(shape, np.int32)  # start, end, left, right of each node
        spans = [self.x[a:b] for a, b in self.shape[:, :2].tolist()]
        with np.errstate(over="ignore", invalid="ignore"):
            self.centre = np.array([s.mean(axis=0) for s in spans])
            self.radius = np.array([_lengths(s - c).max() for s, c in zip(spans, self.centre)])
            self.far = np.array([_lengths(s).max() for s in spans])

    @staticmethod
    def _split(order: np.ndarray, x: np.ndarray, a: int, b: int, shape: list) -> int:
        node = len(shape)
        shape.append([a, b, -1, -1])
        if b - a > LEAF:
            own = x[order[a:b]]
            with np.errstate(over="ignore"):
                spread = own.max(axis=0) - own.min(axis=0)
            if spread.size and spread.max() > 0:
                order[a:b] = order[a:b][np.argsort(own[:, int(spread.argmax())], kind="stable")]
            middle = (a + b) // 2
            shape[node][2] = BallTree._split(order, x, a, middle, shape)
            shape[node][3] = BallTree._split(order, x, middle, b, shape)
        return node

    def packed(self) -> list[bytes]:
        return [getattr(self, part).tobytes() for part in self.PARTS]

    @classmethod
    def unpacked(cls, ids: bytes, x: bytes, shape: bytes, centre: bytes, radius: bytes, far: bytes) -> BallTree:
        tree = cls.__new__(cls)
        tree.ids, tree.shape = np.frombuffer(ids, np.int64), np.frombuffer(shape, np.int32).reshape(-1, 4)
        tree.radius, tree.far = np.frombuffer(radius), np.frombuffer(far)
        tree.x, tree.centre = _rows(np.frombuffer(x), len(tree.ids)), _rows(np.frombuffer(centre), len(tree.radius))
        return tree

    def bounds(self, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each query and node a number that no row's score passes: q . centre + |q| * radius and what rounding
        can have taken from it; infinite where doubles end."""
        with np.errstate(over="ignore", invalid="ignore"):
            bound = q @ self.centre.T + np.outer(length, self.radius)
            bound += (q.shape[1] + 8) * 2.0**-50 * np.outer(length, self.far + 2 * self.radius) + 1e-6
        return np.nan_to_num(bound, nan=np.inf, posinf=np.inf, neginf=np.inf)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: list) -> list[list[tuple[int, int]]]:
        """For each query up to k (-score, id), best first, among rows of other ids that score its floor or more.

        Nodes are opened in order of their bound until it is below the k-th score. A leaf is scored in doubles;
        where its products pass EXACT, the rows that may reach the k-th score are scored anew in whole numbers
        of any size, so no score is rounded. floor is raised to the k-th score of a query that has k.
        """
        length = _lengths(q)
        bound, nodes = self.bounds(q, length), self.shape.tolist()
        out = []
        for i in range(len(q)):
            own_bound, best, least = bound[i].tolist(), [], floor[i]
            heap = [(-own_bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                if -top < least:
                    break
                a, b, left, right = nodes[node]
                if left >= 0:
                    for child in (left, right):
                        if own_bound[child] >= least:
                            heapq.heappush(heap, (-own_bound[child], child))
                    continue
                for s, d in self._leaf(q[i], length[i], node, a, b, least):
                    if d != own[i]:
                        best.append((-s, d))
                if len(best) >= k:
                    best = heapq.nsmallest(k, best)
                    least = max(least, -best[-1][0])
            out.append(heapq.nsmallest(k, best))
            floor[i] = least
        return out

    def _leaf(self, q: np.ndarray, length: float, node: int, a: int, b: int, least) -> list[tuple[int, int]]:
        """(score, id) of a leaf's rows that score at least `least`."""
        with np.errstate(over="ignore", invalid="ignore"):
            score, size = self.x[a:b] @ q, length * self.far[node]
            rough = float(max(-LARGEST, min(LARGEST, least)))
            sure = size < EXACT
            near = np.flatnonzero(~(score < (rough if sure else rough - (len(q) + 8) * 2.0**-50 * (size + abs(rough)))))
        if sure:
            return list(zip(score[near].astype(np.int64).tolist(), self.ids[a:b][near].tolist()))
        exact = [(exact_score(self.x[a + r], q), int(self.ids[a + r])) for r in near.tolist()]
        return [(s, d) for s, d in exact if s >= least]


TREE = ", ".join(f"{part} binary" for part in BallTree.PARTS)


def _batches(batches, rows: int):
    """(ids, vectors) of so many rows each, however Arrow cuts them."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, rows - n)
            at, n = at + some.num_rows, n + some.num_rows
            held.append((np.asarray(some.column(0)), _rows(np.asarray(some.column(1).flatten()), some.num_rows)))
            if n == rows:
                yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held, n = [], 0
    if n:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def _binary(*values: bytes, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=names)


def _shards(found: DataFrame, rows: int) -> DataFrame:
    """A ball tree for every `rows` vectors, built once, in the task that has them."""

    def run(batches):
        for ids, x in _batches(batches, rows):
            yield _binary(*BallTree(ids, x).packed(), names=list(BallTree.PARTS))

    return found.mapInArrow(run, TREE)


def _unit(x: np.ndarray) -> np.ndarray:
    """The vectors at length one; zeros stay."""
    largest = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    x = x / np.where(largest > 0, largest, 1.0)
    length = _lengths(x)[:, None]
    return x / np.where(length > 0, length, 1.0)


def _blocks(found: DataFrame, rows: int, sample, k: int) -> DataFrame:
    """(ids, x, floor, mean) of up to `rows` queries; floor: the k-th score of each in the sample, as text; mean: of
    the queries at length one."""

    def run(batches):
        tree = sample.value
        for ids, x in _batches(batches, rows):
            floor = [float("-inf")] * len(ids)
            if tree is not None:
                tree.search(x, ids, k, floor)
            yield _binary(ids.astype(np.int64).tobytes(), x.tobytes(), _text(floor), _unit(x).mean(axis=0).tobytes(), names=["ids", "x", "floor", "mean"])

    return found.mapInArrow(run, "ids binary, x binary, floor binary, mean binary")


def _text(floor: list) -> bytes:
    return " ".join(map(str, floor)).encode()


def _floors(text: bytes) -> list:
    return [float(s) if "inf" in s else int(s) for s in text.decode().split()]


def _beyond(score: int) -> str:
    """Orders scores of one long, which only those beyond 63 bits share, as text."""
    if -LONG - 1 <= score <= LONG:
        return "~" if score < 0 else ""
    digits = str(abs(score))
    return f"{len(digits):04d}{digits}" if score > 0 else f"{9999 - len(digits):04d}" + "".join(str(9 - int(c)) for c in digits)


def _numbered(packed: DataFrame, name: str, most: int) -> tuple[DataFrame, int, int]:
    """packed, written, with its rows numbered from 0 as `n`; the size of its groups, `most` or less where there would
    be fewer groups than cores; and how many groups there are. Only a number for each task that packed comes here."""
    spark = packed.sparkSession
    packed = written(packed.withColumn("part", F.monotonically_increasing_id()), name)
    task = F.shiftright("part", 33)
    counts = sorted(map(tuple, packed.groupBy(task.alias("task")).count().collect()))
    rows = sum(n for _, n in counts)
    before = [(t, end - n) for (t, n), end in zip(counts, itertools.accumulate(n for _, n in counts))]
    starts = F.broadcast(spark.createDataFrame(before, "task long, start long"))  # 16 bytes a task
    size = max(1, min(most, rows // spark.sparkContext.defaultParallelism))
    numbered = packed.join(starts, task == F.col("task")).withColumn("n", F.col("start") + F.col("part").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.drop("task", "start", "part"), size, -(-rows // size)


def _group(size: int):
    return F.floor(F.col("n") / size).cast("int").alias("group")


def _meet(kept: DataFrame, passed: DataFrame, n_kept: int, n_passed: int) -> DataFrame:
    """Each group of kept beside each group of passed, in one partition: rows (a, b, kind, ...) by the two groups, those
    to keep (kind 0) before those to pass along them (kind 1)."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = kept.select(F.col("group").alias("a"), each(n_passed).alias("b"), F.lit(0).alias("kind"), *(c for c in kept.columns if c != "group"))
    right = passed.select(each(n_kept).alias("a"), F.col("group").alias("b"), F.lit(1).alias("kind"), *(c for c in passed.columns if c != "group"))
    tasks = min(n_kept * n_passed, 64 * kept.sparkSession.sparkContext.defaultParallelism)
    return left.unionByName(right, allowMissingColumns=True).repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "kind")


def _passed(batches, key: list[str], keep: list[str], take: list[str]):
    """Of rows sorted by key and kind, (key, all kept rows of the key, row) for each row to pass along."""
    here, held = None, []
    for batch in batches:
        for row in range(batch.num_rows):
            at = tuple(batch.column(c)[row].as_py() for c in key)
            if at != here:
                here, held = at, []
            if batch.column("kind")[row].as_py() == 0:
                held.append([batch.column(c)[row].as_py() for c in keep])
            else:
                yield at, held, [batch.column(c)[row].as_py() for c in take]


def _nearest(shards: DataFrame, blocks: DataFrame, first: int, pack: int = 4096) -> DataFrame:
    """(block, shard): for each block of queries the `first` shards whose root has the highest mean bound of the
    queries at length one. Roots and means meet in packs: a vector for a shard and one for a block."""
    root = F.expr("substring(centre, 1, octet_length(centre) div (octet_length(radius) div 8))")
    packs = [-(-(t.agg(F.max("n")).first()[0] + 1) // pack) for t in (shards, blocks)]
    roots = shards.select(_group(pack), F.col("n").alias("shard"), root.alias("v"), F.substring("radius", 1, 8).alias("r"))
    means = blocks.select(_group(pack), F.col("n").alias("block"), F.col("mean").alias("v"))

    def run(batches):
        of, centres, radii, names = None, None, None, None
        for at, held, (block, mean) in _passed(batches, ["a", "b"], ["shard", "v", "r"], ["block", "v"]):
            if at != of:
                of, names = at, np.array([h[0] for h in held], np.int64)
                centres, radii = np.stack([np.frombuffer(h[1]) for h in held]), np.array([np.frombuffer(h[2])[0] for h in held])
            with np.errstate(over="ignore", invalid="ignore"):
                bound = np.nan_to_num(centres @ np.frombuffer(mean) + radii, nan=LARGEST)
            best = np.lexsort((names, -bound))[:first]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(best), pa.int64()), pa.array(names[best]), pa.array(bound[best])], names=["block", "shard", "bound"])

    found = _meet(roots, means, *packs).mapInArrow(run, "block long, shard long, bound double")
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("bound"), "shard"))
    return found.withColumn("rank", rank).where(F.col("rank") <= first).select("block", "shard")


def _floored(shards: DataFrame, blocks: DataFrame, k: int, first: int, copies: int = 64) -> DataFrame:
    """blocks with every floor raised to the k-th score in the block's `first` best shards, so that all tasks of the
    search start from it. A shard that many blocks want is sent from several places, some `copies` blocks each."""
    wanted = written(_nearest(shards, blocks, first), "nearest")
    salts = wanted.groupBy("shard").agg(F.ceil(F.count("*") / copies).cast("int").alias("salts"))
    sent = shards.withColumnRenamed("n", "shard").join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    pairs = wanted.join(salts, "shard").select("block", "shard", F.pmod(F.xxhash64("block"), "salts").cast("int").alias("salt"))
    trees = sent.join(pairs, ["shard", "salt"]).select("block", F.lit(0).alias("kind"), *BallTree.PARTS)
    asked = blocks.select(F.col("n").alias("block"), F.lit(1).alias("kind"), "ids", "x", "floor")
    met = trees.unionByName(asked, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches):
        for (block,), held, (ids, x, floor) in _passed(batches, ["block"], list(BallTree.PARTS), ["ids", "x", "floor"]):
            names, least = np.frombuffer(ids, np.int64), _floors(floor)
            _searched([BallTree.unpacked(*h) for h in held], names, _rows(np.frombuffer(x), len(names)), k, least)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([v], pa.binary()) for v in (ids, x, _text(least)))], names=["n", "ids", "x", "floor"])

    return written(met.mapInArrow(run, "n long, ids binary, x binary, floor binary"), "floored")


def _searched(trees: list[BallTree], ids: np.ndarray, x: np.ndarray, k: int, floor: list) -> list[list[tuple[int, int]]]:
    """For each query up to k (-score, id) of all trees, best first; floor is taken from tree to tree and raised."""
    best: list[list[tuple[int, int]]] = [[] for _ in ids]
    for tree in trees:
        for i, found in enumerate(tree.search(x, ids, k, floor)):
            if found:
                best[i] = heapq.nsmallest(k, best[i] + found)
                if len(best[i]) == k:
                    floor[i] = max(floor[i], -best[i][-1][0])
    return best


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 4096, block_rows: int = 1024, sample_rows: int = 4096, group: int = 16, first: int = 2
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner product for each query, ties to
    the smaller vec_id; fewer if there are fewer. A candidate with the query's own vec_id is left out.

    candidates and queries are tables of vectors(). Candidates are packed in shards of at most shard_rows
    vectors wherever they lie, each with its tree; queries in blocks of at most block_rows. `group` shards and
    `group` blocks meet in one task, which keeps the trees and passes each block through them, so that a shard
    is sent once for every `group` blocks and a task holds that many trees however large either table is. A
    query starts from its k-th score in a broadcast sample of at most sample_rows candidates, which a first round
    raises to that in the `first` shards of the highest bound for its block; all tasks share it, and the current k-th
    score goes along from tree to tree of a task. The floors only spare work: every shard meets every block.

    Scores are exact whatever the components' size. One that passes 63 bits takes its place by its exact value
    and is given as the nearest long. Queries that repeat a row count once; with one vec_id and different vectors
    each is searched, and the id has the best k of them all. Repeated candidates count each. Empty tables give
    no rows.
    """
    spark = candidates.sparkSession
    some = candidates.limit(sample_rows).toPandas()  # sample_rows rows at most
    tree = BallTree(some["vec_id"].to_numpy(), np.stack(some["v"].to_numpy())) if len(some) else None
    if tree is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = spark.sparkContext.broadcast(tree)
    shards, shard_size, n_shards = _numbered(_shards(candidates, shard_rows), "shards", group)
    blocks, block_size, n_blocks = _numbered(_blocks(queries.dropDuplicates(), block_rows, sample, k), "blocks", group)
    if not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = _floored(shards, blocks, k, first)
    met = _meet(shards.select(_group(shard_size), *BallTree.PARTS), blocks.select(_group(block_size), "ids", "x", "floor"), n_shards, n_blocks)

    def run(batches):
        of, trees = None, []
        for at, held, (ids, x, floor) in _passed(batches, ["a", "b"], list(BallTree.PARTS), ["ids", "x", "floor"]):
            if at != of:
                of, trees = at, [BallTree.unpacked(*h) for h in held]
            names = np.frombuffer(ids, np.int64)
            best = _searched(trees, names, _rows(np.frombuffer(x), len(names)), k, _floors(floor))
            flat = [(int(i), d, max(-LONG - 1, min(LONG, -s)), _beyond(-s)) for i, own in zip(names, best) for s, d in own]
            if flat:
                columns = list(zip(*flat))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], names=["query_id", "vec_id", "score", "beyond"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long, beyond string")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
