"""Benchmark decontamination: a BM25 inverted index of test items, searched for every training passage with
block-max WAND; what it retrieves is verified by the overlap of question and answer."""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, text_bytes, text_key, words, written

K1, B = 1.2, 0.75
#: Items of a block: each list has its largest impact in every block that it reaches.
BLOCK = 16
#: Bytes of texts that are searched together.
TOGETHER = 1 << 19
#: Passages times blocks whose bounds are computed at once.
SLAB = 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTENCE = r"(?s)^(.*[.!?]\s+)(\S.*)$"


def question_and_answer(items: DataFrame) -> DataFrame:
    """(item_id, question, answer) of items(item_id, text): the answer is the last sentence, if there is one
    before it; items that have the columns question and answer keep theirs."""
    if {"question", "answer"} <= set(items.columns):
        q, a = F.col("question"), F.col("answer")
    else:
        body = F.trim(F.coalesce("text", F.lit("")))
        q = F.when(body.rlike(SENTENCE), F.regexp_extract(body, SENTENCE, 1)).otherwise(body)
        a = F.regexp_extract(body, SENTENCE, 2)
    return items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes(q).alias("question"), text_bytes(a).alias("answer"))


def word_list(text: Column) -> Column:
    """The words of `shared.words` as an array, by expressions."""
    return F.regexp_extract_all(F.translate(text.cast("string"), UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _shingles(tokens: list[bytes], n: int) -> list[int]:
    """The hashes of the shingles; fewer words than n have none."""
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(tokens[i : i + n])) for i in range(len(tokens) - n + 1)]


def _parts(question: list[bytes], answer: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The item's shingles that lie in its question, and those that reach into its answer."""
    whole = _shingles(question + answer, n)
    inside = max(0, len(question) - n + 1) if answer else len(whole)
    return np.unique(np.array(whole[:inside], np.uint64)), np.unique(np.array(whole[inside:], np.uint64))


@dataclass
class Group:
    """The inverted index of items of about one length. A passage for it has two strides of words, one beginning at
    each stride; a stride has the words of its longest item at least, so any of its items that stands in a text
    lies within a passage.

    The lists of all terms stand one after the other in items and impacts. An entry is what a list has in a
    block of BLOCK items: entries first[t] to first[t + 1] are those of term t, each with its block, its
    largest impact there and where its postings begin and end.
    """

    stride: int
    items: array
    impacts: array
    first: np.ndarray
    block: np.ndarray
    most: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, stride: int, lists: dict[int, list[tuple[int, float]]], terms: int) -> Group:
        flat = [x for t in sorted(lists) for x in lists[t]]
        items, impacts = array("i", (i for i, _ in flat)), array("d", (s for _, s in flat))
        term = np.repeat(np.array(sorted(lists), np.int64), [len(lists[t]) for t in sorted(lists)])
        block = np.array(items, np.int64) // BLOCK
        begin = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1]))))
        first = np.searchsorted(term[begin], np.arange(terms + 2))
        return cls(stride, items, impacts, first, block[begin], np.maximum.reduceat(np.array(impacts), begin), begin, np.append(begin[1:], len(items)))

    def entries(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of all the terms, and how many each has."""
        start = self.first[terms]
        many = self.first[terms + 1] - start
        ends = np.cumsum(many)
        return np.repeat(start - ends + many, many) + np.arange(ends[-1] if len(ends) else 0), many

    def live(self, places: np.ndarray, terms: np.ndarray, passages: int, least: float) -> Iterator[tuple[int, list[int]]]:
        """Passages with their live blocks: those whose maxima of the passage's terms sum to `least`, where terms in
        both its strides count twice. places and terms: each term once for each stride that has it, in order."""
        blocks = int(self.block.max()) + 1
        slab = max(1, SLAB // blocks)
        for begin in range(0, passages, slab):
            a, b = np.searchsorted(places, (begin, begin + slab + 1))
            entry, many = self.entries(terms[a:b])
            width = min(slab, passages - begin) + 1
            cell = np.repeat(places[a:b] - begin, many) * blocks + self.block[entry]
            bound = np.bincount(cell, self.most[entry], width * blocks).reshape(width, blocks)
            found: dict[int, list[int]] = {}
            for p, block in np.argwhere(bound[:-1] + bound[1:] >= least).tolist():
                found.setdefault(begin + p, []).append(block)
            yield from found.items()

    def search(self, terms: np.ndarray, live: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of every item of the live blocks whose impacts in the lists of the distinct terms sum to the
        threshold at least, by block_max_wand in each block whose maxima do."""
        entry, _ = self.entries(terms)
        block, most, found = self.block[entry], self.most[entry], []
        for b in live:
            here = block == b
            if most[here].sum() >= threshold - SLACK:
                e = entry[here]
                found += block_max_wand(self.items, self.impacts, list(zip(self.begin[e].tolist(), self.end[e].tolist(), self.most[e].tolist())), threshold)
        return found


@dataclass
class Index:
    """Impacts are BM25 term scores divided by the item's score for itself, so that 1 is the whole item. short has
    the words of items that are shorter than a shingle."""

    ids: list[int | None]
    question: list[np.ndarray]
    answer: list[np.ndarray]
    short: dict[int, bytes]
    term: dict[bytes, int]
    groups: list[Group]


def _stride(longest: int) -> int:
    """The next of 16, 24, 36, 54 ... words."""
    n = 16
    while n < longest:
        n = n * 3 // 2
    return n


def build_index(rows: list[tuple[int | None, bytes, bytes]], idf: dict[bytes, float], mean: float, shingle: int) -> Index:
    """rows: (item, question, answer), each with a word at least."""
    kept = sorted(((words(q), words(a), item) for item, q, a in rows), key=lambda x: (len(x[0]) + len(x[1]), x[0], x[1]))
    term: dict[bytes, int] = {}
    found: dict[int, dict[int, list[tuple[int, float]]]] = {}
    for k, (q, a, _) in enumerate(kept):
        n = len(q) + len(a)
        score = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean)) for t, f in Counter(q + a).items()}
        whole, lists = sum(score.values()), found.setdefault(_stride(n), {})
        for t, s in score.items():
            lists.setdefault(term.setdefault(t, len(term)), []).append((k, s / whole))
    groups = [Group.of(stride, lists, len(term)) for stride, lists in sorted(found.items())]
    parts = [_parts(q, a, shingle) for q, a, _ in kept]
    short = {k: b" ".join(q + a) for k, (q, a, _) in enumerate(kept) if len(q) + len(a) < shingle}
    return Index([item for _, _, item in kept], [p[0] for p in parts], [p[1] for p in parts], short, term, groups)


#: Sums of impacts differ by their order; bounds give way by this.
SLACK = 1e-9
FIRST = itemgetter(0)


def block_max_wand(items: array, impacts: array, lists: list[tuple[int, int, float]], threshold: float) -> list[tuple[int, float]]:
    """(item, score) of every item whose impacts in the lists sum to the threshold at least. lists: where each one's
    postings in the block begin and end, and its maximum there.

    The lists stand in order of their current items. The pivot is the first list up to which the maxima reach the
    threshold: no item before the pivot's can. So the lists before it go on to the pivot's item, which is scored
    once they all stand there.
    """
    cursor, found, least = [[items[begin], begin, end, most] for begin, end, most in lists], [], threshold - SLACK
    while cursor:
        cursor.sort(key=FIRST)
        total, pivot = 0.0, -1
        for k, c in enumerate(cursor):
            total += c[3]
            if total >= least:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursor[pivot][0]
        if cursor[0][0] == item:
            moved = [c for c in cursor if c[0] == item]
            score, target = sum(impacts[c[1]] for c in moved), item + 1
            if score >= threshold:
                found.append((item, score))
        else:
            target, moved = item, [c for c in cursor[:pivot] if c[0] < item]
        for c in moved:
            c[1] = bisect_left(items, target, c[1], c[2])
            c[0] = items[c[1]] if c[1] < c[2] else -1
        cursor = [c for c in cursor if c[0] >= 0]
    return found


def _overlap(part: np.ndarray, own: set[int]) -> float:
    """The share of the shingles that stand in the passage; 1 if there are none."""
    return sum(s in own for s in part.tolist()) / len(part) if len(part) else 1.0


def search_texts(index: Index, texts: list[bytes], threshold: float, overlap: float, shingle: int) -> list[list[tuple]]:
    """For each whole text (item, score, question overlap, answer overlap) of every item that it contains; each once,
    from the passage with the highest question, then answer overlap.

    Blocks of items that a passage can't reach the threshold in are passed over, for all passages of the texts at
    once; what is left is searched one passage at a time. No passage reaches from one text into the next.
    """
    tokens, oov, get = [words(t) for t in texts], len(index.term), index.term.get
    size = np.array([len(x) for x in tokens], np.int64)
    ids = np.fromiter((get(t, oov) for x in tokens for t in x), np.int64, int(size.sum()))
    starts, text = np.cumsum(size) - size, np.repeat(np.arange(len(texts)), size)
    known = np.flatnonzero(ids != oov)
    best: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
    for group in index.groups if len(known) else ():
        stride = group.stride
        places = size // stride + 2  # the last one of each text is empty
        base = np.cumsum(places) - places
        place = base[text[known]] + (known - starts[text[known]]) // stride
        pair = np.unique(place * oov + ids[known])  # each term once a stride
        for p, live in group.live(pair // oov, pair % oov, int(places.sum()), threshold - SLACK):
            k = int(np.searchsorted(base, p, "right")) - 1
            begin = (p - int(base[k])) * stride
            end = min(int(size[k]), begin + 2 * stride)
            if begin >= end:
                continue
            terms = np.unique(ids[starts[k] + begin : starts[k] + end])
            found = group.search(terms[terms != oov], live, threshold)
            if found:
                passage = tokens[k][begin:end]
                own, joined = set(_shingles(passage, shingle)), b" ".join((b"", *passage, b""))
                for item, score in found:
                    if item in index.short:
                        whole = float(b" " + index.short[item] + b" " in joined)
                        got = (whole, whole, score)
                    else:
                        got = (_overlap(index.question[item], own), _overlap(index.answer[item], own), score)
                    if min(got[:2]) >= overlap and got > best[k].get(item, (-1.0,)):
                        best[k][item] = got
    out = []
    for found in best:
        by_id: dict[int | None, tuple] = {}
        for item, got in found.items():
            by_id[index.ids[item]] = max(by_id.get(index.ids[item], (-1.0,)), got)
        out.append([(item, s, q, a) for item, (q, a, s) in by_id.items()])
    return out


def search(index: Index, text: bytes, threshold: float, overlap: float, shingle: int) -> list[tuple]:
    return search_texts(index, [text], threshold, overlap, shingle)[0]


def _found(index: Index, texts: list[bytes], *how) -> Iterator[list[tuple]]:
    """search_texts over slices of about TOGETHER bytes."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= TOGETHER):
            held, end = held + len(texts[end]), end + 1
        yield from search_texts(index, texts[at:end], *how)
        at = end


def index_blocks(items: DataFrame, shingle: int, block_bytes: int) -> Iterator:
    """Broadcasts of the index of items, in blocks of about block_bytes of their text. Term weights are those over
    all items, counted in Spark; only one block's items and the counts of its own terms come to the driver."""
    spark = items.sparkSession
    parts = question_and_answer(items).distinct()
    found = word_list(F.concat_ws(" ", F.col("question").cast("string"), F.col("answer").cast("string")))
    parts = written(parts.withColumn("words", found).where(F.size("words") > 0), "benchmark-items")
    held, total, size = parts.agg(F.count("*"), F.sum(F.size("words")), F.sum(F.octet_length("question") + F.octet_length("answer"))).first()
    if not held:
        return
    terms = parts.select(F.explode(F.array_distinct("words")).alias("term"))
    frequency = written(terms.groupBy("term").agg(F.count("*").alias("n")), "benchmark-terms")
    blocks = max(1, -(-size // block_bytes))
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("question", "answer"), F.lit(blocks)))
    for block in range(blocks):
        own = dealt.where(F.col("block") == block)
        rows = [(r.item_id, bytes(r.question), bytes(r.answer)) for r in own.select("item_id", "question", "answer").collect()]  # about block_bytes
        if not rows:
            continue
        mine = own.select(F.explode("words").alias("term")).distinct()
        counted = frequency.join(mine, "term").collect()  # no more than the words of these items
        idf = {r.term.encode(): math.log(1 + (held - r.n + 0.5) / (r.n + 0.5)) for r in counted}
        yield spark.sparkContext.broadcast(build_index(rows, idf, total / held, shingle))


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8, shingle: int = 5, block_bytes: int = 8 << 20, text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row for each test item in a document.

    Every passage of every whole text is a query. An item is retrieved if its BM25 score for the passage's
    distinct terms is at least threshold times its score for itself, and reported if at least `overlap` of the
    shingles (five words) within the question and of those that reach into the answer stand in the passage.
    The index goes to the tasks in blocks of about block_bytes of items, one pass over the documents each, so
    what is broadcast is bounded whatever the benchmark's size.

    Items without a word and null and empty texts find nothing. Null doc_ids and item_ids are searched as all
    others and reported as null; repeated rows are searched each; items that share an id and differ in text
    are all searched and the id is reported once, with the best of them, whatever the blocks; empty tables give no
    rows; extra columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text_bytes(text).alias("text"))
    schema = "doc_id long, key long, block int, item_id long, score double, question_overlap double, answer_overlap double"
    names = [c.split()[0] for c in schema.split(", ")]
    out, blocks = None, 0
    for sent in index_blocks(items, shingle, block_bytes):

        def run(batches, sent=sent, block=blocks):
            index, kinds = sent.value, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            for batch in batches:
                hits = _found(index, batch.column(2).to_pylist(), threshold, overlap, shingle)
                got = [(d, key, block, *x) for d, key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), hits) for x in own]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=names)

        found, blocks = source.mapInArrow(run, schema), blocks + 1
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    if blocks > 1:  # an id whose items lie in several blocks is reported once: for each of the rows that repeat a text
        found = F.struct("question_overlap", "answer_overlap", "score")
        by_block = out.groupBy("doc_id", "key", "item_id", "block").agg(F.max(found).alias("best"), F.count("*").alias("rows"))
        best = by_block.groupBy("doc_id", "key", "item_id").agg(F.max("best").alias("best"), F.max("rows").cast("int").alias("rows"))
        out = best.select("doc_id", "item_id", "best.*", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return out.select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def drop_contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8, shingle: int = 5, block_bytes: int = 8 << 20, text: str = "text"
) -> DataFrame:
    """The rows of docs in whose text `contaminated` finds no test item; every row is judged by its own text,
    also without an id or with one that others share. Null and empty texts stay, repeated rows stay or go
    together, columns stay as they are. One pass, without a shuffle."""
    for sent in index_blocks(items, shingle, block_bytes):

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                texts = batch.column(batch.num_columns - 1).to_pylist()
                clean = pa.array([not hits for hits in _found(index, texts, threshold, overlap, shingle)], pa.bool_())
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(clean)

        docs = docs.select("*", text_bytes(text).alias(free_name(docs, "__bytes"))).mapInArrow(run, docs.schema)
    return docs
