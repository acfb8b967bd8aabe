"""Names found in texts: word n-grams joined with a table of names, homonyms told apart by what else a text names."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.work import settled

#: Names of so many different numbers of words can be looked for at a time.
MOST_LENGTHS = 12
#: Characters of a text among which its first words are looked for before all of it is read.
HEAD = 500
#: Words that a task looks at together, but for texts of more.
HELD = 1 << 18
#: Homonyms times contexts that are tested in one text, where a text with more gives out its contexts, and at a time.
MOST_PAIRS, TESTED = 1 << 24, 1 << 16
#: The filter: bits a name, 2 ** MOST_BITS at most (64 MB), and those that a fact sets.
BITS_A_NAME, MOST_BITS, PROBES = 32, 29, 4
#: Bearers that share a part of their name's texts; a name has MOST_DEALS parts at most.
BEARERS_A_DEAL, MOST_DEALS = 64, 64

#: What the filter holds: names, those with several bearers, their contexts, both together, ids that rows share, and
#: names together with the parts of 64 that hashes of their contexts fall in.
NAME, HOMONYM, CONTEXT, PAIR, SHARED, PART = range(6)
KINDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x94D049BB133111EB], np.uint64)
PARTS = np.arange(64, dtype=np.uint64)
FACTORS = np.array([0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
BASE = np.uint64(0xFF51AFD7ED558CCD)


def word_list(text: Column) -> Column:
    """The words of a text in lower case: runs of letters and digits. Null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def first_words(text: Column, most: int) -> Column:
    """The first words of word_list, up to so many; the text behind them stays uncut, and unread if they end within
    HEAD characters."""
    whole = F.coalesce(text.cast("string"), F.lit(""))

    def words(of):
        return F.filter(F.split(F.lower(of), r"[^\p{L}\p{N}]+", most + 2), lambda w: w != "")  # one may be empty, the last is the rest

    start = F.substring(whole, 1, HEAD)
    near = (F.size(words(start)) > most) & ~F.contains(start, F.lit("Σ"))  # whose lower case depends on what follows
    return F.slice(F.when(near, words(start)).otherwise(words(whole)), 1, most)


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _phrases(phrases: pa.Array) -> np.ndarray:
    """The hash of each phrase (words with a blank between), as of its words in a text."""
    words = pc.split_pattern(phrases, " ")
    many = pc.list_value_length(words).to_numpy()
    hashes, start, out = _hashes(words.flatten()), np.cumsum(many) - many, np.zeros(len(many), np.uint64)
    for n in np.unique(many).tolist():
        at = start[many == n]
        whole = hashes[at]
        for k in range(1, n):
            whole = whole * BASE + hashes[at + k]
        out[many == n] = whole
    return out


def _fact(kind: int, hashes: np.ndarray) -> np.ndarray:
    x = hashes * KINDS[kind]
    return x ^ (x >> np.uint64(32))


def _both(pair: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """A name's fact of kind PAIR or PART together with a context's hash or its part."""
    x = (pair + contexts) * BASE
    return x ^ (x >> np.uint64(29))


def _part(hashes: np.ndarray) -> np.ndarray:
    return hashes * FACTORS[0] >> np.uint64(58)


def _bit(facts: np.ndarray, k: int, bits: int) -> np.ndarray:
    return facts * FACTORS[k] >> np.uint64(64 - bits)


def _passed(facts: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    """Places of those facts that the filter doesn't rule out."""
    at = np.arange(len(facts))
    for k in range(PROBES):
        bit = _bit(facts, k, bits)
        hit = held[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) == 1
        at, facts = at[hit], facts[hit]
    return at


def names_filter(own: DataFrame, shared: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of own(key, context, bearers) and shared(hash), as 64-bit words; its parts are put together in
    Spark and 2 ** bits bits come to the driver."""

    def of_names(batches):
        for batch in batches:
            key = _phrases(batch.column(0))
            several = batch.column(2).to_numpy() > 1
            context = _phrases(batch.column(1).filter(pa.array(several)))
            both = _both(_fact(PAIR, key[several]), context), _both(_fact(PART, key[several]), _part(context))
            yield from set_by(np.concatenate([_fact(NAME, key), _fact(HOMONYM, key[several]), _fact(CONTEXT, context), *both]))

    def of_ids(batches):
        for batch in batches:
            yield from set_by(_fact(SHARED, batch.column(0).to_numpy().view(np.uint64)))

    def set_by(facts):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([_bit(facts, k, bits) for k in range(PROBES)])).astype(np.int64))], names=["bit"])

    bit = own.select("__key", "__context", "__bearers").mapInArrow(of_names, "bit long").unionByName(shared.mapInArrow(of_ids, "bit long"))
    found = bit.groupBy(F.shiftrightunsigned("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("set")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["at"].to_numpy(np.int64)] = found["set"].to_numpy(np.int64)
    return out.view(np.uint64)


class _Words:
    """The words of some texts, one behind the other."""

    def __init__(self, lists: pa.Array):
        many = pc.list_value_length(lists).to_numpy()
        self.words = lists.flatten().dictionary_encode()
        self.row = np.repeat(np.arange(len(many)), many)
        self.place = np.arange(len(self.row)) - np.repeat(np.cumsum(many) - many, many)
        self.hash = _hashes(self.words.dictionary)[self.words.indices.to_numpy()]

    def distinct(self, lengths: list[int], kind: int, held: np.ndarray, bits: int, rows: np.ndarray | None = None) -> tuple:
        """(row, phrase, hash, how often, first place) of the distinct phrases of so many words in each text (of rows,
        where given) that the filter may hold as of this kind, by row, as arrays."""
        none = np.zeros(0, np.int64)
        parts = [(none, pa.array([], pa.string()), none.astype(np.uint64), none, none)]
        for n in lengths:
            most = max(0, len(self.row) - n + 1)
            hashes, within = self.hash[:most], self.row[:most] == self.row[n - 1 :]
            for k in range(1, n):
                hashes = hashes * BASE + self.hash[k : k + most]
            at = np.flatnonzero(within if rows is None else within & rows[self.row[:most]])
            at = at[_passed(_fact(kind, hashes[at]), held, bits)]
            if not len(at):
                continue
            words = [self.words.take(pa.array(at + k)) for k in range(n)]
            phrase = words[0] if n == 1 else pc.binary_join_element_wise(*(w.cast(pa.string()) for w in words), " ").dictionary_encode()
            _, first, many = np.unique(self.row[at] * len(phrase.dictionary) + phrase.indices.to_numpy(), return_index=True, return_counts=True)
            parts.append((self.row[at[first]], phrase.take(pa.array(first)).cast(pa.string()), hashes[at[first]], many, self.place[at[first]]))
        row, phrase, *more = (pa.concat_arrays(p) if isinstance(p[0], pa.Array) else np.concatenate(p) for p in zip(*parts))
        order = np.argsort(row, kind="stable")
        return row[order], phrase.take(pa.array(order)), *(m[order] for m in more)


def _runs(many: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(from, to) of neighbours that have some more than so many together at the most, or are one."""
    cuts = np.unique(np.searchsorted(np.cumsum(many) - many, np.arange(0, int(many.sum()) + 1, most))).tolist()
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], len(many)]) if a < b]


def _pairs(name_row: np.ndarray, names: np.ndarray, context_row: np.ndarray, contexts: np.ndarray, held: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of names and of contexts of the same text that the filter may hold together. Of a text's contexts only
    those are tested with a name that fall in parts in which it has some."""
    facts, step = _fact(PART, names)[:, None], TESTED // len(PARTS)
    name, part = np.divmod(np.concatenate([np.zeros(0, np.int64), *(_passed(_both(facts[a : a + step], PARTS).ravel(), held, bits) + a * len(PARTS) for a in range(0, len(names), step))]), len(PARTS))
    places = context_row * len(PARTS) + _part(contexts).astype(np.int64)
    order = np.argsort(places, kind="stable")
    places, wanted = places[order], name_row[name] * len(PARTS) + part
    first = np.searchsorted(places, wanted)
    many = np.searchsorted(places, wanted, "right") - first
    facts, starts, found = _fact(PAIR, names), np.cumsum(many) - many, [np.zeros((2, 0), np.int64)]
    for a, b in _runs(many, TESTED):
        one = np.repeat(name[a:b], many[a:b])
        other = order[np.arange(len(one)) + np.repeat(first[a:b] - starts[a:b] + starts[a], many[a:b])]
        at = _passed(_both(facts[one], contexts[other]), held, bits)
        found.append(np.stack([one[at], other[at]]))
    return tuple(np.concatenate(found, axis=1))


def find_names(docs: DataFrame, names: DataFrame, doc: str, text: str, name_id: str, name: str, context: str | None = None) -> DataFrame:
    """(doc, name_id, name, n, first, ambiguous): the names whose words stand one behind the other in a text, how often
    and from which word (from 0), and whether the text doesn't tell which of several bearers of the name is meant.

    A bearer of a name that others bear is meant if, of them all, only their context (a name too, as of a team) stands
    in the text as well; else all are given, as ambiguous. Names are compared word by word, whatever stands between
    words; a name of no words is never found. Rows of docs that share an id count together.

    Every text is cut into words once; its n-grams, of the lengths that names have, are tested by hash against a filter
    of names, so only those that are names, and few by mistake, become strings and meet the names on these. Contexts
    are looked for beside homonyms alone, by a filter of both together, and meet the bearers with a row a homonym and
    context that a text has. A full filter loses nothing. A text that shares its id with others, or has too many of
    both to be tested, gives out all that are contexts, which meet its homonyms in joins. What stands in texts is
    written, as it is read more than once. A text that tells its bearer takes that one alone; only what stays ambiguous
    meets all bearers, last of all, so these rows are not shuffled; names of many bearers are dealt out by text.
    """
    spark = docs.sparkSession
    own = names.select(F.col(name_id).alias("__id"), F.array_join(word_list(F.col(name)), " ").alias("__key"), (F.array_join(word_list(F.col(context)), " ") if context else F.lit("")).alias("__context"))
    own = settled(own.distinct(), "names").where("__key <> ''")
    bearers = own.groupBy("__key").agg(F.count("*").alias("__bearers"))
    own = settled(own.join(bearers, "__key"), "bearers")
    homonyms = settled(own.where("__bearers > 1 and __context <> ''").groupBy("__key", "__context").agg(F.count("*").alias("__same"), F.first("__id").alias("__meant")), "homonyms")
    words_of = [of.select(F.lit(kind), F.regexp_count(key, F.lit(" ")) + 1).distinct() for of, kind, key in ((own, NAME, "__key"), (homonyms, CONTEXT, "__context"))]
    lengths = sorted(tuple(r) for r in words_of[0].union(words_of[1]).limit(2 * MOST_LENGTHS + 1).collect())
    if len({n for _, n in lengths}) > MOST_LENGTHS:
        raise ValueError(f"names have more than {MOST_LENGTHS} different numbers of words")
    of_names, of_contexts = ([n for kind, n in lengths if kind == k] for k in (NAME, CONTEXT))

    shared = settled(docs.groupBy(F.xxhash64(doc).alias("hash")).count().where("count > 1").select("hash"), "shared-ids")
    bits = min(MOST_BITS, max(16, (BITS_A_NAME * (own.count() + shared.count())).bit_length()))
    sent = spark.sparkContext.broadcast(names_filter(own, shared, bits))  # 2 ** (MOST_BITS - 3) bytes at most
    words = docs.select(F.col(doc).alias("__doc"), F.xxhash64(doc).alias("__hash"), word_list(F.col(text)).alias("__words"))

    def grams(batches):
        held = sent.value
        for batch in batches:
            for a, b in _runs(pc.list_value_length(batch.column(2)).to_numpy(), HELD):
                yield from in_texts(*(c.slice(a, b - a) for c in batch.columns), held)

    def in_texts(ids, hashes, lists, held):
        def given(row, key, context, many, at, of, loose):
            columns = ((key, pa.string()), (context, pa.string()), (many, pa.int64()), (at, pa.int32()), (of, pa.int64()), (np.full(len(row), loose), pa.bool_()))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *(pa.nulls(len(row), t) if c is None else pa.array(c, t) for c, t in columns)], names=found_as.names)

        texts = _Words(lists)
        loose = ids.is_null().to_numpy(zero_copy_only=False).copy()  # no text without an id tells a bearer, as in SQL
        loose[_passed(_fact(SHARED, hashes.to_numpy().view(np.uint64)), held, bits)] = True
        row, key, hash, many, at = texts.distinct(of_names, NAME, held, bits)
        several = np.zeros(len(row), bool)
        several[_passed(_fact(HOMONYM, hash), held, bits)] = True
        wanted = loose.copy()
        wanted[row[several]] = True
        beside, context, by, *_ = texts.distinct(of_contexts, CONTEXT, held, bits, wanted)
        loose |= np.bincount(row[several], minlength=len(lists)) * np.bincount(beside, minlength=len(lists)) > MOST_PAIRS
        tested = np.flatnonzero(several & ~loose[row])
        one, other = _pairs(row[tested], hash[tested], beside, by, held, bits)
        one = tested[one]
        of = np.bincount(one, minlength=len(row))
        yield given(row[one], key.take(pa.array(one)), context.take(pa.array(other)), many[one], at[one], of[one], False)
        for out, as_loose in ((np.flatnonzero((of == 0) & ~loose[row]), False), (np.flatnonzero(loose[row]), True)):
            yield given(row[out], key.take(pa.array(out)), None, many[out], at[out], of[out], as_loose)
        out = np.flatnonzero(loose[beside])
        yield given(beside[out], None, context.take(pa.array(out)), None, None, None, True)

    # a row a name in a text (__of 0), or one for each of the contexts beside it (so many: __of); loose texts: one for each name and each context
    found_as = StructType([words.schema["__doc"], *StructType.fromDDL("__key string, __context string, n long, first int, __of long, __loose boolean")])
    found = settled(words.mapInArrow(grams, found_as), "found")
    loose = found.where("__loose")
    contexts = loose.where("__key is null").select("__doc", "__context").distinct()
    loose = loose.where("__key is not null").groupBy("__doc", "__key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    beside = loose.select("__doc", "__key").join(homonyms.select("__key", "__context"), "__key").join(contexts, ["__doc", "__context"])
    loose = loose.join(beside, ["__doc", "__key"], "left").withColumn("__of", F.when(F.col("__context").isNull(), 0).otherwise(2))
    met = found.where("not __loose").drop("__loose").unionByName(loose)
    told = met.where("__of > 0").join(homonyms, ["__key", "__context"], "left").withColumn("__same", F.coalesce("__same", F.lit(0)))
    among = told.where("__of > 1").groupBy("__doc", "__key").agg(F.first("n").alias("n"), F.first("first").alias("first"), F.sum("__same").alias("__same"), F.first("__meant", ignorenulls=True).alias("__meant"))
    columns = ["__doc", "__key", "n", "first", "__same", "__meant"]
    told = told.where("__of = 1").select(columns).unionByName(settled(among, "among").select(columns))
    open_ = met.where("__of = 0").select(columns[:4]).unionByName(told.where("__same <> 1").select(columns[:4]))
    deals = F.least(F.lit(MOST_DEALS), F.ceil(F.col("__bearers") / BEARERS_A_DEAL)).cast("int")
    wide = settled(own.select("__key", deals.alias("__deals")).where("__deals > 1").distinct(), "wide")
    open_ = open_.join(wide, "__key", "left").withColumn("__deal", F.pmod(F.xxhash64("__doc"), F.coalesce("__deals", F.lit(1))).cast("int"))
    by_deal = own.select("__key", "__id", (F.col("__bearers") > 1).alias("ambiguous"), F.explode(F.sequence(F.lit(0), deals - 1)).alias("__deal"))
    out = open_.join(by_deal, ["__key", "__deal"]).drop("__deal", "__deals")
    out = out.unionByName(told.where("__same = 1").select(*columns[:4], F.col("__meant").alias("__id"), F.lit(False).alias("ambiguous")))
    return out.select(F.col("__doc").alias(doc), F.col("__id").alias(name_id), F.col("__key").alias(name), "n", "first", "ambiguous")
