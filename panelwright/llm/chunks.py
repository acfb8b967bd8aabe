"""Substring deduplication: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, text_bytes, text_key

#: Gear table: 256 odd-looking 32-bit values from a fixed generator.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)
WINDOW_STEPS = (1, 2, 4, 8)  # doubling steps: the hash covers the last 16 bytes
WORD = re.compile(rb"[^ \t-\r]+")
BLOCK = 1 << 22
GAP = re.compile(rb"[ \t-\r]")
#: Bits of a run's number of words in its place.
PLACE = 20


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over the last 16 bytes, modulo 2**32."""
    h = GEAR[data]
    for step in WINDOW_STEPS:
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def _cuts(candidates: list[int], n: int, least: int, most: int) -> list[int]:
    """Ends of chunks of n words: candidate ends, at least `least` and at most `most` words apart."""
    out, last = [], 0
    for c in candidates:
        while c - last > most:
            last += most
            out.append(last)
        if c - last >= least:
            out.append(c)
            last = c
    while n - last > most:
        last += most
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunk_words(text: bytes, rate: float, least: int, most: int):
    """(digest, first word, end word) of each chunk of a whole text; case and spacing don't matter."""
    lowered, at, word0 = text.lower(), 0, 0
    bound = np.uint32(min(int(rate * (1 << 32)), (1 << 32) - 1))
    tail: list[bytes] = []
    while at < len(lowered) or tail:
        end = at + BLOCK
        if end < len(lowered):
            gap = GAP.search(lowered, end)
            end = gap.start() if gap else len(lowered)
        some, at = tail + lowered[at:end].split(), end
        tail = []
        if not some:
            break
        joined = b" ".join(some) + b" "
        data = np.frombuffer(joined, np.uint8)
        ends = np.flatnonzero(data == 32)
        cut = _cuts((np.flatnonzero(gear_hash(data)[ends - 1] < bound) + 1).tolist(), len(some), least, most)
        if at < len(lowered) and len(cut) > 1:  # the last chunk goes on in the next block
            tail = some[cut[-2] :]
            cut.pop()
        edge = [0, *(ends[np.array(cut) - 1] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        begin = 0
        for k, stop in enumerate(cut):
            yield digest(joined[edge[k] : edge[k + 1]]), word0 + begin, word0 + stop
            begin = stop
        word0 += begin
        if at >= len(lowered) and not tail:
            break


def run_digests(digests: list[int], edges: list[int], min_words: int):
    """(digest, first, end) of the shortest run of chunks from each on that has min_words, as far as there is one,
    and of the shortest one that ends with the text.

    edges are the chunks' first words and, last, the end. A run's digest is that of its chunks' digests in
    order; so equal ones are the same words in a row.
    """
    n, packed, at = len(digests), np.array(digests, np.uint64).tobytes(), np.array(edges)
    reach, last = np.searchsorted(at, at[:n] + min_words).tolist(), int(np.searchsorted(at, at[-1] - min_words, "right")) - 1
    runs = [(first, end) for first, end in enumerate(reach) if end <= n]
    if last >= 0 and reach[last : last + 1] != [n]:
        runs.append((last, n))
    for first, end in runs:
        yield xxhash.xxh64_intdigest(packed[8 * first : 8 * end]), first, end


def run_table(docs: DataFrame, rate: float, least: int, most: int, min_words: int, text: str = "text", places: bool = True) -> DataFrame:
    """(digest, doc_id, key, place, again): the runs of at least min_words words of each whole text, chunk by chunk.

    A chunk ends after a word where the gear hash of the last 16 bytes is below rate * 2**32, but has from least
    to most words. place holds a run's first word and, in its last PLACE bits, how many it has; again is true
    where the same run stands in the same text before, without sharing a word with it. Without places, a row
    (digest, doc_id) for each different run of a text.
    """

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for i, key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                chunks = list(chunk_words(t, rate, least, most))
                edges, seen = [c[1] for c in chunks] + [chunks[-1][2] if chunks else 0], {}
                for digest, first, last in run_digests([c[0] for c in chunks], edges, min_words):
                    begin, end = edges[first], edges[last]
                    if places:
                        rows.append((digest, i, key, begin << PLACE | end - begin, seen.setdefault(digest, end) <= begin))
                    elif digest not in seen:
                        seen[digest] = end
                        rows.append((digest, i))
                if len(rows) > 100_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    def out(rows):
        digest, *rest = zip(*rows)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        columns = [pa.array(np.array(digest, np.uint64).view(np.int64)), *(pa.array(c, k) for c, k in zip(rest, kinds))]
        return pa.RecordBatch.from_arrays(columns, names=["digest", "doc_id", "key", "place", "again"][: len(columns)])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text_bytes(text).alias("text"))
    return source.mapInArrow(run, "digest long, doc_id long" + (", key long, place long, again boolean" if places else ""))


def keyed_spans(docs: DataFrame, rate: float, least: int, most: int, min_words: int, text: str = "text") -> DataFrame:
    """As repeated_spans, with the key of the text."""
    if most + min_words >= 1 << PLACE:
        raise ValueError(f"a run has fewer than 2**{PLACE} words")
    runs = run_table(docs, rate, least, most, min_words, text)
    # texts are cut twice rather than kept on disk; the first place of a run goes through the shuffle as two longs
    once = run_table(docs, rate, least, most, min_words, text, places=False)
    first = once.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("holders")).where("holders > 1").drop("holders")
    met = runs.join(first, "digest", "left")
    earlier = F.coalesce((F.col("first_doc") < F.col("doc_id")) | (F.col("doc_id").isNull() & F.col("first_doc").isNotNull()), F.lit(False))
    found = met.where(F.col("again") | earlier).select("doc_id", "key", "place", F.when(earlier, F.col("first_doc")).otherwise(F.col("doc_id")).alias("first_doc"))
    begin = F.shiftright("place", PLACE)
    found = found.select("doc_id", "key", begin.cast("int").alias("first"), (begin + F.col("place").bitwiseAND((1 << PLACE) - 1)).cast("int").alias("end"), "first_doc")
    place = Window.partitionBy("doc_id", "key").orderBy("first", "end")
    before = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.when(F.col("first") <= F.col("before"), 0).otherwise(1)).over(place)
    spans = found.withColumn("before", before).withColumn("run", number).groupBy("doc_id", "key", "run").agg(
        F.min("first").alias("first_word"), F.max("end").alias("end_word"), F.array_sort(F.collect_set("first_doc")).alias("first_docs")
    )
    return spans.select("doc_id", "key", "first_word", "end_word", "first_docs")


def repeated_spans(
    docs: DataFrame, rate: float = 0.3, least: int = 3, most: int = 12, min_words: int = 20, text: str = "text"
) -> DataFrame:
    """(doc_id, first_word, end_word, first_docs): what of each text stands elsewhere before it, in words of the
    text from 0, end excluded; first_docs are the documents in which it does.

    Texts are cut into content-defined chunks, and the runs of chunks that have min_words words, one from each
    chunk on, are deduplicated by digest. Of a run that several documents have, the smallest doc_id keeps it;
    of a run that one text has several times, the first place stays. So each word of a span lies in a run of at
    least min_words words that stands in a row at one other place, in a document of first_docs; runs that
    overlap or touch make a span, and passages are never put together from shorter pieces. A passage is found
    up to the chunk that its either end falls in, wherever it stands, as chunks depend on the 16 bytes before
    their ends only.

    Null and empty texts have no chunks. Rows that share a doc_id are one document: what they have in common
    stays, and each has its own spans. A text without a doc_id comes after all others; what only such texts
    share stays. Repeated rows have the same spans, given once. Extra columns are ignored, an empty table gives
    no rows. Digests have 64 bits: of n different runs about n**2 / 2**65 are taken for another.
    """
    return keyed_spans(docs, rate, least, most, min_words, text).drop("key").distinct()


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (sorted, apart) and the space after each."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at : starts[min(first, len(starts) - 1)]])
        at = starts[min(end, len(starts) - 1)]
    return b"".join(out) + text[at:]


def cut_repeats(docs: DataFrame, rate: float = 0.3, least: int = 3, most: int = 12, min_words: int = 20) -> DataFrame:
    """docs with the text of each document less its repeated_spans and n_chars, if there, counted anew.

    A document that loses all its words goes; every other row stays, with its columns in their order, also rows
    without an id or a text and repeated rows. Texts without such spans are passed on as they are. Columns
    other than text and n_chars are not read; they may have any name.
    """
    spans = keyed_spans(docs, rate, least, most, min_words).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("first_word", "end_word"))).alias("spans"))
    doc, key, held = (free_name(docs, c) for c in ("__doc", "__key", "__spans"))
    spans = spans.select(F.col("doc_id").alias(doc), F.col("key").alias(key), F.col("spans").alias(held)).hint("shuffle_hash")  # grow with the documents: never broadcast, no sort of texts
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (text_key() == F.col(key))
    joined = docs.join(spans, same, "left").drop(doc, key)

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            spans_of = batch.column(batch.num_columns - 1)
            texts = batch.column(k).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(np.asarray(spans_of.is_valid())):
                cut = without_spans(texts[i].encode(), [(s["first_word"], s["end_word"]) for s in spans_of[int(i)].as_py()])
                texts[i] = cut.decode("utf-8", "replace")
                keep[i] = bool(cut.split())
            columns = [batch.column(c) for c in range(batch.num_columns - 1)]
            columns[k] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(keep))

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
