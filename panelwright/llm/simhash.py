"""Near-duplicates by SimHash: pigeonhole blocks, a join on blocks, then the Hamming distance; and by the
similarity of shingle sets: MinHash bands, a join on bands, then the sets themselves."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import free_name, text_bytes, text_key, written

SEED = 42
BLOCK = 1 << 20
GAP = re.compile(rb"[ \t-\r]")
#: Rows of one block key that a task compares at once; larger keys are dealt out as pairs of slices.
SLICE = 4096
#: Up to so many large block keys (16 bytes each) are broadcast; more are joined by a shuffle.
MOST_LARGE = 1 << 18
#: As SLICE, for rows that hold a text's shingles.
SET_SLICE = 1024


def _tokens(text: bytes):
    """The words of a lower-cased text, in lists of bounded length."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            gap = GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def shingle_hashes(text: bytes, shingle: int):
    """Arrays of the XXH64 of each shingle, repeats included; a shorter text has one shingle, an empty one none."""
    tail: list[bytes] = []
    any_yet = False
    for some in _tokens(text.lower()):
        some = tail + some
        if len(some) >= shingle:
            joined = b" ".join(some)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[: len(some) - shingle + 1].tolist()
            digest = xxhash.xxh64_intdigest
            yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
            any_yet = True
        tail = some[len(some) - shingle + 1 :] if len(some) >= shingle and shingle > 1 else [] if shingle == 1 else some
    if not any_yet and tail:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A further 64 bits from a hash, for fingerprints of more than one word."""
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the lowest."""
    lanes = h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    if len(h) < 512:
        return np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(lanes[:, i], minlength=256) @ BITS for i in range(8)])


def fingerprint(text: bytes, shingle: int = 3, words: int = 1) -> list[int]:
    """words times 64 bits as signed longs: a bit is 1 if over half of the shingles' hashes have it."""
    n, counts = 0, np.zeros((words, 64), np.int64)
    for h in shingle_hashes(text, shingle):
        n += len(h)
        for k in range(words):
            counts[k] += _bit_counts(h if k == 0 else _mixed(h, k))
    packed = np.packbits(2 * counts > n, axis=1, bitorder="little").view("<i8").ravel() if n else np.zeros(words, np.int64)
    return packed.tolist()


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, text: str = "text") -> DataFrame:
    """(doc_id, f0[, f1 ...]): the fingerprint of each whole text; null and empty texts have zero."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(x, shingle, words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in range(words))],
                names=["doc_id", *(f"f{k}" for k in range(words))],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"f{k} long" for k in range(words)))


def _spread(parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of the parts of 64 bits."""
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_keys(words: int, parts: int, match: int) -> list[Column]:
    """One long for each choice of match among a word's parts; fingerprints that differ in at most
    parts - match bits of a word agree in at least one of its keys."""
    keys = []
    for k in range(words):
        for chosen in combinations(_spread(parts), match):
            key, bits = F.lit(len(keys)).cast("long"), 0
            for at, n in chosen:
                part = F.shiftrightunsigned(F.col(f"f{k}"), at).bitwiseAND(F.lit((1 << n) - 1))
                key, bits = F.shiftleft(key, n).bitwiseOR(part), bits + n
            assert bits <= 48, "a block key must leave room for its number"
            keys.append(key)
    return keys


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indices is linked with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(key: np.ndarray, node: np.ndarray, prints: np.ndarray, radius: int, held: int = 1 << 20):
    """Rows sorted by key; (u, v) pairs that join, for each key, the rows within the radius of each other."""
    n = len(key)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    run_end = np.repeat(np.concatenate((starts[1:], [n])), np.diff(np.concatenate((starts, [n]))))
    left, step, pairs, size = np.flatnonzero(run_end - np.arange(n) > 1), 1, [], 0

    def joined():
        nonlocal pairs, size
        i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        seen, where = np.unique(np.concatenate((i, j)), return_inverse=True)
        label = _forest(len(seen), where[: len(i)], where[len(i) :])
        off = label != np.arange(len(seen))
        pairs, size = [(seen[off], seen[label[off]])], int(off.sum())

    while len(left):
        right = left + step
        apart = np.bitwise_count(prints[left] ^ prints[right]).sum(axis=1)
        near = apart <= radius
        if near.any():
            pairs.append((left[near], right[near]))
            size += int(near.sum())
            if size > held:
                joined()
        step += 1
        left = left[left + step < run_end[left]]
    if pairs:
        joined()
        yield node[pairs[0][0]], node[pairs[0][1]]


def _dealt(rows: DataFrame, block: str, node: str, slice_rows: int) -> DataFrame:
    """rows, sorted by block within tasks; blocks of more than slice_rows rows are dealt out as pairs of slices of
    that size, each pair a block of its own, so that no task holds more than two slices and no pair is lost."""
    large = rows.groupBy(block).count().where(F.col("count") > slice_rows)
    large = written(large.select(block, F.ceil(F.col("count") / slice_rows).cast("int").alias("slices")), "large-blocks")
    many, columns = large.count(), rows.columns
    if many:
        large = F.broadcast(large) if many <= MOST_LARGE else large
        slice_of = F.pmod(F.xxhash64(node), F.col("slices")).cast("int")
        rows = rows.join(large, block, "left").withColumn("own_slice", F.coalesce(slice_of, F.lit(0)))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices") - 1, F.lit(0)))))
        pair = F.xxhash64(block, F.least("own_slice", "other"), F.greatest("own_slice", "other"))
        rows = rows.withColumn(block, F.when(F.col("slices").isNull(), F.col(block)).otherwise(pair)).select(*columns)
    return rows.repartition(block).sortWithinPartitions(block, node)


def _blocks(batches):
    """Columns of the rows of whole blocks, from batches sorted by their first column."""
    rest = None
    for batch in batches:
        columns = [np.asarray(batch.column(k)) if pa.types.is_integer(batch.column(k).type) else np.array(batch.column(k).to_pylist(), object) for k in range(batch.num_columns)]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns)]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        rest = [x[cut:] for x in columns]
        if cut:
            yield [x[:cut] for x in columns]
    if rest is not None and len(rest[0]):
        yield rest


def near_links(nodes: DataFrame, radius: int, parts: int, match: int, words: int = 1) -> DataFrame:
    """(u, v) edges that connect all nodes(node, f0 ...) whose fingerprints differ in at most radius bits,
    if also some word of them differs in at most parts - match bits.

    Only the edges of a spanning forest of each block are emitted, never all its pairs; an edge may come from
    several blocks. Large blocks are _dealt in slices of SLICE rows. Rows with equal nodes or null nodes make no edge.
    """
    prints = [f"f{k}" for k in range(words)]
    keyed = nodes.where("node is not null").select("node", *prints, F.explode(F.array(*block_keys(words, parts, match))).alias("key"))

    def run(batches):
        for key, node, *own in _blocks(batches):
            for u, v in _links(key, node, np.stack(own, axis=1).view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    dealt = _dealt(keyed.select("key", "node", *prints), "key", "node", SLICE)
    return dealt.mapInArrow(run, "u long, v long")


def simhash_components(
    docs: DataFrame, shingle: int = 3, radius: int = 3, parts: int = 5, match: int = 2, words: int = 1, text: str = "text"
) -> DataFrame:
    """(doc_id, f0 ..., component_id): the smallest doc_id that each document is linked with, itself included.

    Two documents link if their fingerprints of words x 64 bits differ in at most radius bits. With
    radius <= words * (parts - match + 1) - 1 every such pair meets in a block; a larger radius also takes
    those pairs beyond it that happen to. Equal fingerprints are merged before anything is compared, so a
    group of copies is one node. Null and empty texts have fingerprint zero and link as any other; a null
    doc_id gets the component of its fingerprint; repeated rows are repeated in the result; extra columns
    are ignored; an empty table gives no rows.
    """
    prints = [f"f{k}" for k in range(words)]
    own = written(fingerprints(docs, shingle, words, text), "fingerprints")
    nodes = written(own.groupBy(*prints).agg(F.min("doc_id").alias("node")), "nodes")
    label = connected_components(near_links(nodes, radius, parts, match, words))
    nodes = nodes.join(label, "node", "left").select(*prints, F.coalesce("component", "node").alias("component_id"))
    return own.join(nodes, prints, "left").select("doc_id", *prints, "component_id")


#: Constants of the MinHash functions.
ODD = np.random.default_rng(SEED).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The sorted hashes of a text's different shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def min_hashes(own: np.ndarray, many: int) -> np.ndarray:
    """The least value of each of so many hash functions over a set: two sets agree in one with a probability of
    their similarity. Those of empty sets agree."""
    least = np.full(many, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 2048):
            least = np.minimum(least, np.multiply.outer(ODD[:many], own[at : at + 2048]).min(axis=1))
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A long for each band of min_hashes: sets agree in a band with probability similarity ** rows."""
    with np.errstate(over="ignore"):
        mixed = (_mixed(least, 1).reshape(bands, rows) * ODD[-rows:]).sum(axis=1, dtype=np.uint64)
        return _mixed(mixed + np.arange(bands, dtype=np.uint64) * ODD[0], 2).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of pairs(u, v) whose sets(node, own) have that similarity or more."""

    def alike(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            near = [jaccard(np.frombuffer(a[i].as_py(), np.uint64), np.frombuffer(b[i].as_py(), np.uint64)) >= similarity for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u")
    met = met.join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v").select("u", "v", "a", "b")
    return written(met.mapInArrow(alike, "u long, v long"), "alike")


def set_links(node: np.ndarray, component: np.ndarray, sets: list[np.ndarray], similarity: float, bands: int, rows: int) -> list[tuple[int, int]]:
    """Links between texts of different components that share a band and have the similarity: enough of them to
    join all such components.

    A pair is looked at in the first band that it shares, if the two aren't joined by then, and passed over if
    their sizes rule it out or under similarity - 0.2 of their min-hashes agree, which of pairs that have the
    similarity one in a billion does (six deviations of 150). The rest are settled by their sets.
    """
    least = np.stack([min_hashes(s, bands * rows) for s in sets])
    keys, size = np.stack([band_keys(x, bands, rows) for x in least]), np.array([len(s) for s in sets])
    label, links = component.copy(), []
    for band in range(bands):
        order = np.argsort(keys[:, band], kind="stable")
        edges = np.flatnonzero(np.diff(keys[order, band])) + 1
        for group in np.split(order, edges):
            for k, i in enumerate(group[:-1]):
                other = group[k + 1 :]
                other = other[label[other] != label[i]]
                other = other[np.minimum(size[other], size[i]) >= similarity * np.maximum(size[other], size[i]) - 1e-6]
                if len(other) and band:
                    other = other[~(keys[other, :band] == keys[i, :band]).any(axis=1)]
                if len(other):
                    other = other[(least[other] == least[i]).mean(axis=1) >= similarity - 0.2]
                for j in other:
                    if label[i] != label[j] and jaccard(sets[i], sets[j]) >= similarity:
                        links.append((int(node[i]), int(node[j])))
                        label[label == label[j]] = label[i]
    return links


def _mixed_bands(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(key, node, rank, component) of the bands in which not all nodes are of one component."""
    named = shared.drop("component").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    return written(named.join(mixed.hint("shuffle_hash"), "key", "left_semi").select("key", "node", "rank", "component"), "apart")


def _stars(apart: DataFrame) -> DataFrame:
    """(u, v): each node with the highest-ranking first node of its bands, of those of another component."""
    first = apart.groupBy("key").agg(F.max_by("node", "rank").alias("leader"), F.max("rank").alias("top"))
    known = apart.select(F.col("node").alias("leader"), F.col("component").alias("of_leader")).distinct()
    first = first.join(known, "leader")
    met = apart.join(first, "key").where("component <> of_leader")
    return met.groupBy(F.col("node").alias("u")).agg(F.max_by("leader", "top").alias("v"))


def _rare_keys(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node, component) of the rare shingles of apart's nodes that nodes of several components have.

    Two sets of that similarity have the same similarity * n of either's n shingles or more. So in whatever order all
    shingles stand, the first n - similarity * n + 1 of each hold one of the other's first, and with the rarest in front
    texts that share a common part, as a template, but have words of their own besides meet nowhere. How many of these
    nodes have a shingle is counted; ties are ordered by the hash."""

    def shingles(batches):
        for batch in batches:
            for node, component, own in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.frombuffer(own, np.int64) if own else np.zeros(1, np.int64)  # texts without a word are alike
                first = len(found) - int(np.ceil(similarity * len(found) - 1e-6)) + 1
                for at in range(0, len(found), BLOCK):
                    some, n = found[at : at + BLOCK], len(found[at : at + BLOCK])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, node)), pa.array(np.full(n, component)), pa.array(some), pa.array(np.full(n, first, np.int32))], names=["node", "component", "key", "first"])

    nodes = apart.select("node", "component").distinct().join(sets.hint("shuffle_hash"), "node")
    held = written(nodes.mapInArrow(shingles, "node long, component long, key long, first int"), "rest-shingles")
    counts = held.groupBy("key").agg(F.count("*").alias("many"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("many", "key"))
    front = held.join(counts.hint("shuffle_hash"), "key").withColumn("place", place).where("place <= first and many > 1")
    front = written(front.select("key", "node", "component"), "rare")
    mixed = front.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    return written(front.join(mixed.hint("shuffle_hash"), "key", "left_semi"), "rare-apart")


def _print_pairs(own: DataFrame) -> DataFrame:
    """(u, v) of own's nodes by SimHash, as simhash_components links them: those of one fingerprint f0 with the first of
    them, and the first ones that meet in a block and differ in at most 3 bits."""
    nodes = own.dropDuplicates(["node"]).select("node", "f0")
    firsts = written(nodes.groupBy("f0").agg(F.min("node").alias("first")), "prints")
    same = nodes.join(firsts, "f0").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    return written(same.unionByName(near_links(firsts.select(F.col("first").alias("node"), "f0"), 3, 5, 2)).distinct(), "print-pairs")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 30, rows: int = 5, text: str = "text") -> DataFrame:
    """(doc_id, node, component): node is the text's, component the same for texts that are linked.

    Two texts are linked if the Jaccard similarity of their sets of shingles, by 64-bit hashes, is at least
    `similarity`. Candidates meet in the pigeonhole blocks of SimHash fingerprints of the same shingles first; texts that
    these leave apart, as short ones, are candidates if they share a band of MinHashes: a pair of similarity s is none with probability
    (1 - s ** rows) ** bands, whatever the texts' lengths. Each is settled by its two sets. No pairs of a band
    are emitted: in two rounds every text meets one other, that of its bands which shares the most bands, as
    the original of many copies does; what is then left in bands of several components goes to tasks in groups
    of components that share bands, large groups in slices, and the tasks return the links they find. So a
    group of copies costs few comparisons, and no candidate is skipped. Texts without a word are alike; rows
    with a null doc_id take part as all others; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            keys = [band_keys(min_hashes(shingle_set(t, shingle), bands * rows), bands, rows) for t in texts]
            prints = pa.array([fingerprint(t, shingle)[0] for t in texts], pa.int64())
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, prints], names=["doc_id", "node", "keys", "f0"])

    def to_sets(batches):
        for batch in batches:
            found = [shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "own"])

    def settle(batches):
        for _, node, component, own in _blocks(batches):
            links = set_links(node, component, [np.frombuffer(x, np.uint64) for x in own], similarity, bands, rows)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["u", "v"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("node"), text_bytes(text).alias("__text"))
    own = written(source.mapInArrow(run, "doc_id long, node long, keys array<long>, f0 long"), "signatures")
    pairs = _print_pairs(own)
    keyed = own.dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    held = keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    shared = keyed.join(held.hint("shuffle_hash"), "key")
    rank = F.sum("many").over(Window.partitionBy("node"))  # up to `bands` rows a node
    shared = written(shared.select("key", "node", rank.alias("rank"), F.col("node").alias("component")), "bands")
    named = shared.select("node").unionByName(pairs.select(F.explode(F.array("u", "v")).alias("node"))).distinct().hint("shuffle_hash")
    sets = source.select("node", "__text").join(named, "node", "left_semi").dropDuplicates(["node"])
    sets = written(sets.mapInArrow(to_sets, "node long, own binary"), "shingle-sets")
    links, apart = _verified(pairs, sets, similarity), shared
    for more in (True, True, False):
        label = connected_components(links)
        apart = _mixed_bands(apart, label)
        links = label.select(F.col("node").alias("u"), F.col("component").alias("v"))  # the same components, settled
        if more:
            links = links.unionByName(_verified(_stars(apart), sets, similarity))
    rare = _rare_keys(apart, sets, similarity)
    least = rare.groupBy("key").agg(F.min("component").alias("v"))
    groups = connected_components(rare.join(least, "key").select(F.col("component").alias("u"), "v").distinct())
    member = rare.select("node", "component").distinct().join(groups.select(F.col("node").alias("component"), F.col("component").alias("group")), "component")
    member = member.join(sets, "node").select("group", "node", "component", "own")
    rest = written(_dealt(member, "group", "node", SET_SLICE).mapInArrow(settle, "u long, v long"), "settled")
    label = connected_components(links.unionByName(rest))
    return own.select("doc_id", "node").join(label, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))


def keep_one_of_each(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """One row of each class of near_copies: that with the smallest doc_id, and of those with it the one with the
    smallest text_key. So rows with one doc_id and texts that aren't alike all stay, also if they have no
    doc_id, which counts as the largest; of rows that repeat id and text one stays. Null and empty texts are
    alike. All columns are kept, whatever their names."""
    found = written(near_copies(docs, text=text, **how), "near-copies")
    by_id = found.groupBy("component", "doc_id").agg(F.min("node").alias("node"), F.count("*").alias("rows"))
    best = by_id.groupBy("component").agg(
        F.min("doc_id").alias("__doc"), F.coalesce(F.min_by("node", "doc_id"), F.min("node")).alias("__node"), F.max(F.coalesce("rows", F.lit(0))).alias("__rows")
    )
    kept = written(best.select("__doc", "__node", "__rows"), "kept")
    doc, node = free_name(docs, "__doc"), free_name(docs, "__node")
    ids = kept.select(F.col("__doc").alias(doc), F.col("__node").alias(node)).hint("shuffle_hash")  # ids grow with the documents: never broadcast, no sort of texts
    out = docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (text_key(text) == F.col(node)), "left_semi")
    return out if kept.where("__rows > 1").isEmpty() else out.dropDuplicates(["doc_id", text])


#: Near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more. Of pairs at exactly 0.8 seven
#: in a million share no band.
FIVE_WORDS = {"shingle": 5, "similarity": 0.8, "bands": 30, "rows": 5}
