"""SentencePiece encoding and decoding: merge-type vocabularies, encoded by a table of each prefix's last token."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import text_bytes

SPACE = "▁"
#: The largest model that is sent to the executors.
MOST_MODEL_BYTES = 64 << 20
#: Entries of each memory (what stands between spaces, the words in that, and pairs), after which it is emptied, and the
#: longest word that it holds.
MOST_PARTS, MOST_WORDS, MOST_PAIRS, LONGEST_KNOWN = 600_000, 200_000, 500_000, 64
#: Characters of a text that are encoded at a time; what has no space in it stays together.
BLOCK = 1 << 20


#: A state of the automaton: what it has read of the tokens that are open, its steps, and the tokens that end there.
_Node = tuple[str, dict[str, "_Node"], tuple[int, ...]]


class Vocabulary:
    """The pieces of a merge-type model and their scores, with an automaton that finds all of them in a text.

    The library merges, of all neighbouring symbols whose string is a piece, those of the highest score, the leftmost
    first, until none are left. So the tokens of a text are the one sequence in which each token is what its own
    string is merged to and each two neighbours are what their joined string is merged to: until a merge crosses a
    border between two tokens, all merges lie within tokens, in the order that the two alone would have.
    """

    def __init__(self, model: bytes):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score: dict[str, float] = {}
        ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(len(lib)):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (lib.is_unknown(i) or lib.is_control(i)):
                self.score[piece], ids[piece] = lib.get_score(i), i
        self.unknown = lib.unk_id()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.tokens = sorted(t for t in self.score.keys() | set("".join(self.score)) if len(self.merged(t)) == 1)
        self.lengths, self.single = [len(t) for t in self.tokens], [ids.get(t, -1) for t in self.tokens]
        self.number = {t: k for k, t in enumerate(self.tokens)}
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t) + 1)}
        self.nodes: dict[str, _Node] = {}
        # no token reaches over the beginning of a word, if no piece has a space behind another character
        self.whole = any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.word, self.border = re.compile(self._words()), re.compile("(?!)" if self.whole else f"(?<=[^{SPACE}])(?={SPACE})")
        probe = " ".join(self.tokens[:: max(1, len(self.tokens) // 500)])
        if list(self.encode(probe)) != lib.encode(probe):
            raise ValueError("the model's tokens aren't those of merges by score")

    def _words(self) -> str:
        """A pattern of the parts of a text over whose ends no piece reaches: runs of letters and of other characters,
        with the spaces before them, held together where pieces have such neighbours. Where pieces have spaces behind
        other characters, or letters next to many others, the parts are larger."""
        letter, pairs = re.compile(r"[^\W\d_]"), {a + b for p in self.score for a, b in zip(p, p[1:])}
        if self.whole:
            return r"(?s:.+)"
        mixed = sorted(x for x in pairs if SPACE not in x and bool(letter.match(x[0])) != bool(letter.match(x[1])))
        if len(mixed) > 50:
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        run = rf"(?:[^\W\d_]+|(?:(?!{SPACE})[\W\d_])+)"
        glue = "|".join(rf"(?<={re.escape(a)})(?={re.escape(b)})" for a, b in mixed)
        return f"{SPACE}*{run}" + (f"(?:(?:{glue}){run})*" if glue else "") + f"|{SPACE}+"

    def merged(self, text: str, border: int = 0) -> list[str] | None:
        """text's symbols after all merges; None as soon as a merge crosses the border."""
        symbols, at = list(text), list(range(len(text) + 1))
        while True:
            best, score = -1, None
            for k in range(len(symbols) - 1):
                found = self.score.get(symbols[k] + symbols[k + 1])
                if found is not None and (score is None or found > score):
                    best, score = k, found
            if best < 0:
                return symbols
            if border and at[best + 1] == border:
                return None
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
            del at[best + 1]

    def fit(self, a: int, b: int) -> bool:
        """Whether a and b stay apart where they are neighbours."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        left = self.tokens[a]
        found = self.pairs[a * len(self.tokens) + b] = self.merged(left + self.tokens[b], len(left)) is not None
        return found

    def _node(self, text: str) -> _Node:
        """The automaton's state after a text whose longest end that begins a token is text itself. States and steps are
        made as they are met."""
        found = self.nodes.get(text)
        if found is None:
            ends = (self.number.get(text[k:]) for k in range(len(text)))
            found = self.nodes[text] = (text, {}, tuple(k for k in ends if k is not None))
        return found

    def _step(self, node: _Node, character: str) -> _Node:
        if character not in self.prefixes:
            return self._node("")
        text = node[0] + character
        while text not in self.prefixes:
            text = text[1:]
        found = node[1][character] = self._node(text)
        return found

    def last_tokens(self, text: str) -> list[int] | array:
        """For each prefix of text, the number of its one last token: of the automaton's matches that end there, the one
        that stays apart from the last token of what is before it. -1 is for the empty prefix and for a character that
        no piece has, which stands alone."""
        last = [-1] if len(text) < BLOCK else array("i", [-1])
        lengths, many, pairs, node, end = self.lengths, len(self.tokens), self.pairs, self._node(""), 0
        for character in text:
            node = node[1].get(character) or self._step(node, character)
            end += 1
            for token in node[2]:
                before = last[end - lengths[token]]
                if before < 0:
                    break
                apart = pairs.get(before * many + token)
                if self.fit(before, token) if apart is None else apart:
                    break
            else:
                token = -1
            last.append(token)
        return last

    def encode_word(self, word: str) -> bytes:
        """Ids of a text that has no other word before or behind it: the last token of the whole, then that of what
        is before it, and so back to the beginning."""
        last, end, out, single, lengths = self.last_tokens(word), len(word), [], self.single, self.lengths
        while end:
            token = last[end]
            if token >= 0 and single[token] >= 0:
                out.append(single[token])
                end -= lengths[token]
            else:  # a character without an id of its own
                end -= 1
                out.extend(reversed([self.bytes[b] for b in word[end].encode()] if self.bytes else [self.unknown]))
        out.reverse()
        return array("i", out).tobytes()

    def _known(self, memory: dict[str, bytes], word: str, ids: bytes, most: int) -> bytes:
        if len(word) <= LONGEST_KNOWN:
            if len(memory) >= most:
                memory.clear()
            memory[word] = ids
        return ids

    def _word(self, word: str) -> bytes:
        return self.known.get(word) or self._known(self.known, word, self.encode_word(word), MOST_WORDS)

    def _spaced(self, part: str) -> bytes:
        """Ids of a space and what stands up to the next one."""
        words = self.word.findall(SPACE + part)
        ids = self.encode_word(words[0]) if len(words) == 1 else b"".join(map(self._word, words))
        return self._known(self.parts, part, ids, MOST_PARTS)

    def _blocks(self, text: str) -> Iterator[str]:
        """text in parts of some BLOCK characters over whose borders no token reaches."""
        start = 0
        while start < len(text):
            border = self.border.search(text, start + BLOCK) if len(text) - start > BLOCK else None
            end = border.start() if border else len(text)
            yield text[start:end]
            start = end

    def encode(self, text: str) -> np.ndarray:
        """Ids of text, without begin and end. Words that were met before aren't encoded again."""
        out = []
        for block in self._blocks(self.library.normalize(text)):
            if self.whole or SPACE + SPACE in block:
                out.append(b"".join(map(self._word, self.word.findall(block))))
                continue
            first, *parts = block.split(SPACE)
            out += map(self._word, self.word.findall(first))
            found = list(map(self.parts.get, parts))
            if None in found:
                for k in [k for k, x in enumerate(found) if x is None]:
                    found[k] = self._spaced(parts[k])
            out += found
        ids = np.frombuffer(b"".join(out), np.int32)
        if not self.bytes and len(ids):  # without bytes, unknown characters in a row are one token
            ids = ids[~((ids == self.unknown) & (np.concatenate([[-1], ids[:-1]]) == self.unknown))]
        return ids


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    """One for all tasks of a Python worker."""
    return Vocabulary(model)


def sent_model(spark: SparkSession, path: str) -> Broadcast:
    """The model's bytes for all executors; path is a file of the driver's."""
    model = Path(path).read_bytes()
    if len(model) > MOST_MODEL_BYTES:
        raise ValueError(f"the model has more than {MOST_MODEL_BYTES} bytes")
    return spark.sparkContext.broadcast(model)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, ids): each whole text's ids, exactly as the library encodes it with the model at path, without begin
    and end.

    Null and empty texts have no ids; texts of any length are read whole, in time that grows with their length; null
    doc_ids and repeated rows are encoded each; extra columns are ignored; an empty table gives no rows. Characters
    that the vocabulary lacks become their bytes, or the unknown token where the model has no bytes.
    """
    sent = sent_model(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = vocabulary(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # so that the ids of long texts don't pile up
                part = batch.slice(at, 256)
                ids = [found.encode(x.decode("utf-8", "replace")) for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the texts of encoded(doc_id, ids), as the library's decode gives them. Null ids are an
    empty text; ids that the model lacks are an error of the library's; an empty table gives no rows."""
    sent = sent_model(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = vocabulary(sent.value).library
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1).fill_null([])
                ids, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
                texts = [found.decode(ids[a:b].tolist()) if b > a else "" for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")
