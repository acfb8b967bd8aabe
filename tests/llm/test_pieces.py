"""Encoding and decoding against the library, whole tables and hard strings."""

import hashlib
import random
import time

import public_tokenizers
import pytest
import sentencepiece
from panelwright.llm.pieces import Vocabulary, decode, encode
from panelwright.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return Vocabulary(f.read())


def test_query_equals_the_library(spark, sf, library):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = set()
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "")
        want.add((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert {tuple(r) for r in QUERIES["op12_pieces"](spark, sf).collect()} == want


def test_random_strings_of_letters_spaces_bytes_and_marks(own, library):
    draw = random.Random(11)
    parts = [" ", "  ", "\t", "a", "e", "the", "ing", "é", "語", "\U0001f600", "ሴ", "\x00", "▁", "▁▁", "1", "00", "==", "//", "Ab", "\n", "ß", "https", "qz", "²", ".", "\r", ";", "_", "<s>", "<0x41>", "̈", "​"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))
        assert list(own.encode(text)) == library.encode(text), repr(text)


def test_prefix_table_holds_the_last_token_of_every_prefix(own, library):
    text = "▁unbelievable▁antidisestablishmentarianismሴs"
    last = own.last_tokens(text)
    for end in range(1, len(text) + 1):
        assert last[end] == -1 if text[end - 1] == "ሴ" else own.tokens[last[end]] == own.merged(text[:end])[-1]


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 100_000 + "b", "ab▁" * 50_000, "語一" * 50_000, "x y " * 600_000, "".join(random.Random(2).choices("abcdefghij", k=300_000))], ids=["one letter", "spaces", "marks", "no spaces", "many blocks", "one word"])
def test_very_long_texts_take_linear_time(own, library, text):
    start = time.perf_counter()
    got = list(own.encode(text))
    assert time.perf_counter() - start < 30
    assert got == library.encode(text)


def test_memories_may_overflow(own, library, monkeypatch):
    for name in ("MOST_PARTS", "MOST_WORDS", "MOST_PAIRS"):
        monkeypatch.setattr(f"panelwright.llm.pieces.{name}", 3)
    text = "several different words, several memories of them, and none of these is kept for long"
    assert list(own.encode(text)) == library.encode(text)


def test_odd_documents(spark, odd_docs, no_docs, library):
    got = decode(encode(odd_docs, PATH), PATH).collect()
    want = [(r.doc_id, library.encode(r.text or ""), library.decode(library.encode(r.text or ""))) for r in odd_docs.collect()]
    assert sorted(map(repr, ((r.doc_id, r.ids, r.text) for r in got))) == sorted(map(repr, want))
    assert decode(encode(no_docs, PATH), PATH).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {(r.doc_id, r.text) for r in decode(nothing, PATH).collect()} == {(1, ""), (2, "")}


def test_models_that_do_not_merge_are_an_error(own, monkeypatch):
    monkeypatch.setattr("panelwright.llm.pieces.Vocabulary.fit", lambda self, a, b: True)
    with open(PATH, "rb") as f, pytest.raises(ValueError, match="merges by score"):
        Vocabulary(f.read())
