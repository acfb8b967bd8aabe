"""Substring deduplication: planted passages are found and cut, shifts don't matter, the rest stays."""

import re

import numpy as np
import pytest
from panelwright.llm.chunks import chunk_words, cut_repeats, gear_hash, repeated_spans, without_spans
from panelwright.llm.queries import QUERIES


def prose(seed, n, vocabulary=20_000):
    return [f"w{int(x)}" for x in np.random.default_rng(seed).integers(0, vocabulary, n)]


def test_gear_hash_equals_the_rolling_form():
    from panelwright.llm.chunks import GEAR

    data = np.frombuffer(b"a rolling hash over the last sixteen bytes of this text", np.uint8)
    rolled, out = 0, []
    for k in range(len(data)):
        rolled = sum(int(GEAR[data[k - j]]) << j for j in range(min(16, k + 1))) % (1 << 32)
        out.append(rolled)
    assert gear_hash(data).tolist() == out


def test_chunks_cover_the_text_in_order():
    words = prose(1, 5000)
    chunks = list(chunk_words(" ".join(words).encode(), 0.3, 3, 12))
    assert chunks[0][1] == 0 and chunks[-1][2] == 5000
    assert all(a[2] == b[1] for a, b in zip(chunks, chunks[1:])) and all(3 <= b - a <= 12 for _, a, b in chunks[:-1])


def test_chunks_are_alike_across_blocks(monkeypatch):
    from panelwright.llm import chunks

    text = " ".join(prose(2, 4000)).encode()
    whole = list(chunk_words(text, 0.3, 3, 12))
    monkeypatch.setattr(chunks, "BLOCK", 700)
    assert list(chunk_words(text, 0.3, 3, 12)) == whole


def test_shifted_passages_are_found(docs_of):
    shared = prose(3, 60)
    docs = [(i, " ".join(prose(100 + i, 40 + i) + shared + prose(200 + i, 50))) for i in range(12)]
    spans = {r.doc_id: r for r in repeated_spans(docs_of(*docs)).collect()}
    assert set(spans) == set(range(1, 12))
    for i, r in spans.items():
        assert abs(r.first_word - (40 + i)) <= 12 and abs(r.end_word - (100 + i)) <= 12 and r.end_word - r.first_word >= 40
        assert r.first_docs == [0]


def test_short_repeats_stay(docs_of):
    line = prose(4, 8)
    docs = docs_of((1, " ".join(prose(5, 90) + line)), (2, " ".join(prose(6, 90) + line)))
    assert repeated_spans(docs).collect() == []
    assert sorted(r.text for r in cut_repeats(docs).collect()) == sorted(r.text for r in docs.collect())


def test_repeats_inside_a_document_go(docs_of):
    passage = prose(7, 60)
    docs = docs_of((3, " ".join(passage + prose(8, 30) + passage + prose(9, 30) + passage)), (4, "x " * 500))
    spans = sorted(tuple(r) for r in repeated_spans(docs).collect())
    assert [s[0] for s in spans] == [3, 3, 4] and all(s[3] == [s[0]] for s in spans)
    assert 90 <= spans[0][1] <= 102 and 138 <= spans[0][2] <= 150 and 180 <= spans[1][1] <= 192 and 228 <= spans[1][2] <= 240
    assert 20 <= spans[2][1] <= 40 and spans[2][2] >= 485  # the first run stays whole
    left = {r.doc_id: r.text.split() for r in cut_repeats(docs).collect()}
    assert left[3][:90] == passage + prose(8, 30) and 120 <= len(left[3]) <= 120 + 36


def test_pieces_of_several_documents_are_no_passage(docs_of):
    """Twelve words from each of five documents, one after the other, are nobody's passage."""
    pieces = [prose(20 + i, 12) for i in range(5)]
    docs = [(i, " ".join(prose(30 + i, 50) + p + prose(40 + i, 50))) for i, p in enumerate(pieces)]
    assert repeated_spans(docs_of(*docs, (9, " ".join(sum(pieces, []))))).collect() == []


def test_rows_without_an_id_of_their_own(docs_of):
    shared, other = prose(50, 80), prose(51, 80)
    rows = [(1, " ".join(shared)), (None, " ".join(prose(52, 30) + shared)), (None, " ".join(prose(53, 30) + other)), (None, " ".join(other)), (5, " ".join(prose(54, 20) + shared)), (5, " ".join(prose(55, 90)))]
    spans = sorted(((r.doc_id or 0, r.first_docs) for r in repeated_spans(docs_of(*rows)).collect()))
    assert spans == [(0, [1]), (5, [1])]  # what only rows without an id share stays
    kept = [(r.doc_id, len(r.text.split())) for r in cut_repeats(docs_of(*rows)).collect()]
    assert len(kept) == 6 and (5, 90) in kept and (1, 80) in kept and sorted(n for d, n in kept if d is None)[1:] == [80, 110]


def test_cut_leaves_the_rest_as_it_stands():
    text = b"  One two,\n three  four five six. "
    assert without_spans(text, []) == text
    assert without_spans(text, [(1, 3)]) == b"  One four five six. "
    assert without_spans(text, [(0, 6)]) == b"  "


def test_cut_repeats(docs_of):
    shared = prose(8, 80)
    docs = docs_of((1, " ".join(shared)), (2, " ".join(shared)), (3, " ".join(prose(9, 30) + shared + prose(10, 30))))
    kept = {r.doc_id: r for r in cut_repeats(docs).collect()}
    assert set(kept) == {1, 3} and kept[1].text == " ".join(shared)
    left = kept[3].text.split()
    assert left[:18] == prose(9, 30)[:18] and left[-18:] == prose(10, 30)[-18:] and len(left) <= 60 + 24
    assert kept[3].n_chars == len(kept[3].text)


def contiguous(own, others, n=20):
    """For each word, whether it lies in n words in a row of some other text."""
    windows = {tuple(o[i : i + n]) for o in others for i in range(len(o) - n + 1)}
    good = np.zeros(len(own), bool)
    for i in range(len(own) - n + 1):
        if tuple(own[i : i + n]) in windows:
            good[i : i + n] = True
    return good


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_every_span_stands_in_one_earlier_place(spark, folder):
    """Against a plain search: each word of a span lies in 20 words that stand in a row in one named document, before
    it or in an earlier one; and what has 60 words of an earlier text is found."""
    sf = f"/root/testdata/{folder}"
    words = {r.doc_id: re.findall(rb"[^ \t-\r]+", r.text.lower().encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    covered, n = {}, 0
    for r in QUERIES["op7_chunks"](spark, sf).collect():
        assert all(d <= r.doc_id for d in r.first_docs)
        others = [words[d] if d < r.doc_id else words[d][: r.end_word - 20] for d in r.first_docs]
        assert contiguous(words[r.doc_id][r.first_word : r.end_word], others).all(), r
        covered.setdefault(r.doc_id, np.zeros(len(words[r.doc_id]), bool))[r.first_word : r.end_word] = True
        n += 1
    seen, windows, share = set(), 0, []
    for doc in sorted(words):
        w, own = words[doc], set()
        for a in range(len(w) - 59):
            key = hash(tuple(w[a : a + 60]))
            own.add(key)
            if key in seen:
                windows += 1
                share.append(covered[doc][a : a + 60].mean() if doc in covered else 0.0)
        seen |= own
    print(folder, n, "spans;", windows, "windows of 60 words, of which are found in the mean", np.mean(share), "at least", min(share))
    assert windows > 100 and np.mean(share) > 0.95 and np.mean(np.array(share) > 0.4) > 0.99


def test_passages_of_fifty_words_are_caught(docs_of):
    """Of planted passages of 50 to 70 words at least 97 in 100 lose over half of their words."""
    draw = np.random.default_rng(11)
    docs, spans_of = [], {}
    for k in range(400):
        passage = prose(1000 + k, int(draw.integers(51, 71)))
        before = prose(3000 + k, int(draw.integers(0, 60)))
        docs += [(2 * k, " ".join(prose(5000 + k, 20) + passage)), (2 * k + 1, " ".join(before + passage + prose(7000 + k, 25)))]
        spans_of[2 * k + 1] = (len(before), len(before) + len(passage))
    found = {}
    for r in repeated_spans(docs_of(*docs)).collect():
        a, b = spans_of[r.doc_id]
        assert r.first_word >= a and r.end_word <= b
        found[r.doc_id] = found.get(r.doc_id, 0) + r.end_word - r.first_word
    caught = np.mean([found.get(d, 0) > (b - a) / 2 for d, (a, b) in spans_of.items()])
    print("caught", caught)
    assert caught >= 0.97


def test_odd_rows(odd_docs, no_docs):
    assert [(r.doc_id, r.first_docs) for r in repeated_spans(odd_docs).collect()] == [(5, [5])]  # its words come again and again
    kept = cut_repeats(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert cut_repeats(no_docs).collect() == [] and repeated_spans(no_docs).collect() == []
