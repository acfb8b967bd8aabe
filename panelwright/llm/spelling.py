"""Spelling variant grouping: the whole neighbourhood of each word, hash-joined to the vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A near word has to occur so many times as often to be a word's form.
RATIO = 5
#: The filter of the vocabulary has so many bits a word, at least 2 ** 16 and at most 2 ** MOST_BITS, and PROBES of them are set. With
#: more words than that it lets more candidates pass to the join, which decides.
BITS_A_WORD, MOST_BITS, PROBES = 32, 29, 5
#: Candidates that are hashed at a time, and words of a partition of the vocabulary.
BLOCK, WORDS_A_TASK = 1 << 20, 5_000
#: The base of the words' polynomial hash modulo 2 ** 64 (odd, so that it has an inverse), and odd factors of the probes.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
FACTORS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the words of all texts of LEAST_LENGTH code points or more that occur LEAST_COUNT times or more.

    A word is a maximal run of RUN with A-Z lower-cased. Where 199 divides h, the crc32 of `<doc_id>:<run>`, the run's
    code point number h modulo its length is left out first, which plants misspellings. Null texts have no words, a
    null doc_id counts as an empty string.
    """
    owner = F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":")).alias("owner")
    runs = docs.select(owner, F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.octet_length("run") == F.char_length("run")  # of ASCII alone, which lower takes fast
    runs = runs.select("owner", F.when(plain, F.lower("run")).otherwise(F.translate("run", upper, lower)).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("owner", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    found = runs.select(F.when(F.col("h") % 199 == 0, without).otherwise(F.col("run")).alias("word"))
    return found.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _symbol(points: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of each code point."""
    x = (points.astype(np.uint64) + np.uint64(1)) * BASE
    x = (x ^ (x >> np.uint64(30))) * FACTORS[0]
    x = (x ^ (x >> np.uint64(27))) * FACTORS[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]).astype(np.uint64), dtype=np.uint64)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _prefixes(points: np.ndarray) -> np.ndarray:
    """The polynomial hashes of all prefixes of each row, the empty one included."""
    steps = _symbol(points) * _powers(points.shape[1])[:-1]
    return np.concatenate([np.zeros((len(points), 1), np.uint64), np.cumsum(steps, axis=1, dtype=np.uint64)], axis=1)


def _probes(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    x = hashes ^ (hashes >> np.uint64(29))
    x = x * FACTORS[k]
    return (x ^ (x >> np.uint64(32))) * BASE >> np.uint64(64 - bits)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    length = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(length):
        yield int(n), np.flatnonzero(length == n)


def vocabulary_filter(words: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of words(word) by their polynomial hash, as 64-bit words; its parts are put together in Spark and
    2 ** bits bits come to the driver."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for _, rows in _by_length(texts):
                hashes = _prefixes(_points([texts[r] for r in rows]))[:, -1]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_probes(hashes, bits, k) for k in range(PROBES)]).astype(np.int64))], names=["bit"])

    bit = words.select("word").mapInArrow(run, "bit long")
    found = bit.groupBy(F.shiftrightunsigned("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("set")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["at"].to_numpy(np.int64)] = found["set"].to_numpy(np.int64)
    return out.view(np.uint64)


def _passed(hashes: np.ndarray, kept: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    """Places of those hashes that are kept and may be of a word."""
    at = np.flatnonzero(kept)
    left = hashes.ravel()[at]
    for k in range(PROBES):
        bit = _probes(left, bits, k)
        hit = held[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) == 1
        at, left = at[hit], left[hit]
    return at


def neighbours(words: list[str], alphabet: np.ndarray, held: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows, candidates), in parts: all distinct strings that are a word but for one code point that is deleted,
    replaced or inserted, and that the filter doesn't rule out.

    Each candidate's hash comes from the hashes of the word's prefixes in a step, so only those that pass are made. Of
    equal code points in a row the first alone is deleted, and none is inserted behind its equal: no candidate of a
    word comes twice.
    """
    symbol = _symbol(alphabet)
    for length, rows in _by_length(words):
        step = max(1, BLOCK // (length * len(alphabet) + 1))
        for first in range(0, len(rows), step):
            part = rows[first : first + step]
            points = _points([words[r] for r in part])
            before, power = _prefixes(points), _powers(length)
            whole, own = before[:, -1:], _symbol(points)
            again = np.concatenate([np.zeros((len(part), 1), bool), points[:, 1:] == points[:, :-1]], axis=1)
            shorter = before[:, :-1] + (whole - before[:, 1:]) * INVERSE
            found = _passed(shorter, ~again, held, bits)
            yield part[found // length], [words[part[f // length]][: f % length] + words[part[f // length]][f % length + 1 :] for f in found.tolist()]
            width = max(1, BLOCK // (len(part) * len(alphabet)))
            for at in range(0, length + 1, width):
                places = np.arange(at, min(at + width, length + 1))
                left = np.concatenate([np.zeros((len(part), 1), np.uint32), points], axis=1)[:, places]
                longer = before[:, places, None] + symbol * power[places, None] + ((whole - before[:, places]) * BASE)[:, :, None]
                yield from _made(words, part, alphabet, places, _passed(longer, left[:, :, None] != alphabet, held, bits), 0)
                places = places[places < length]
                if len(places):
                    other = whole[:, :, None] + (symbol - own[:, places, None]) * power[places, None]
                    yield from _made(words, part, alphabet, places, _passed(other, points[:, places, None] != alphabet, held, bits), 1)


def _made(words: list[str], part: np.ndarray, alphabet: np.ndarray, places: np.ndarray, found: np.ndarray, taken: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The strings with a code point of the alphabet in place of `taken` ones."""
    row, rest = np.divmod(found, len(places) * len(alphabet))
    place, letter = np.divmod(rest, len(alphabet))
    rows, letters = part[row], alphabet[letter].tolist()
    yield rows, [words[r][:p] + chr(a) + words[r][p + taken :] for r, p, a in zip(rows.tolist(), places[place].tolist(), letters)]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words(word, n) that differ by exactly one code point inserted, deleted or
    replaced, in both directions. words is read several times: give a written table.

    The alphabet is that of the words. Candidates meet the words by a shuffled hash join on the string; before that,
    the filter takes out nearly all that are no word, so what is shuffled grows with the pairs that there are."""
    spark = words.sparkSession
    size = words.count()
    bits = min(MOST_BITS, max(16, int(size * BITS_A_WORD).bit_length()))
    # of RUN's code points, so 116 at most
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r.c) for r in letters.collect()), np.uint32)
    sent = spark.sparkContext.broadcast(vocabulary_filter(words, bits))  # 2 ** (MOST_BITS - 3) bytes at most

    def run(batches):
        held = sent.value
        for batch in batches:
            texts, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for rows, candidates in neighbours(texts, alphabet, held, bits):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([texts[r] for r in rows.tolist()]), pa.array(n[rows]), pa.array(candidates)], names=["word", "n", "near"])

    dealt = words.select("word", "n").repartition(max(spark.sparkContext.defaultParallelism, -(-size // WORDS_A_TASK)), "word")
    made = dealt.mapInArrow(run, "word string, n long, near string")
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("shuffle_hash"), "near").select("word", "n", "near", "near_n")


def spelling_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of vocabulary(docs).

    form is the word's near word that occurs most (of several the smallest in code-point order), if it occurs RATIO
    times as often as the word or more, else null; root is where forms lead to in the end, the word itself if it has
    none; n_near counts its near words. As each form occurs RATIO times as often as the word, chains end after a few
    steps, and their lengths are halved in each round.

    Null and empty texts have no words; texts of any length are read whole; repeated rows count each; extra columns are
    ignored; an empty table gives no rows. A word has at most 234 near words a code point, so no group is larger.
    """
    words = written(vocabulary(docs, text), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = words.join(near.hint("shuffle_hash"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")
    fits = -F.col("best.less") >= RATIO * F.col("n")
    formed = formed.select("word", "n", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    formed = written(formed, "formed")
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(on.hint("shuffle_hash"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = written(moved, "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return formed.join(roots.hint("shuffle_hash"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
