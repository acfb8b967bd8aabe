"""Decontamination against a search of every passage for every item, without an index."""

import math
import resource
from collections import Counter

import numpy as np
import pytest
from panelwright.llm.decontaminate import B, K1, Group, build_index, contaminated, drop_contaminated, question_and_answer, search, search_texts
from panelwright.llm.queries import QUERIES
from panelwright.llm.shared import words


def plain_hits(text, items, overlap=0.8, shingle=5):
    """Items whose question's and answer's shingles stand in the text to the share of overlap, anywhere."""
    w = words((text or "").encode())
    joined, own = b" " + b" ".join(w) + b" ", {b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)}
    out = set()
    for item, q, a in items:
        q, a = words(q), words(a)
        whole = q + a
        if not whole:
            continue
        parts = [b" ".join(whole[i : i + shingle]) for i in range(max(1, len(whole) - shingle + 1))]
        inside = max(0, len(q) - shingle + 1) if a else len(parts)
        ok = all(not part or sum(s in own or b" " + s + b" " in joined for s in set(part)) / len(set(part)) >= overlap for part in (parts[:inside], parts[inside:]))
        if ok:
            out.add(item)
    return out


def test_query_finds_all_planted_items(spark, sf, documents):
    items = [(r.item_id, bytes(r.question), bytes(r.answer)) for r in question_and_answer(spark.read.parquet(f"{sf}/benchmark.parquet")).collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, sf).collect()}
    want = {(r.doc_id, i) for r in documents.collect() for i in plain_hits(r.text, items)}
    assert got == want and want


def test_wand_equals_scoring_every_item():
    rng, skipped = np.random.default_rng(1), 0
    for _ in range(200):
        lists = {}
        for t in range(9):
            items = sorted(rng.choice(400, int(rng.integers(1, 300)), replace=False).tolist())
            lists[t] = [(i, float(x)) for i, x in zip(items, rng.uniform(0, 0.3, len(items)) ** 2)]
        group, terms = Group.of(16, lists, 9), np.sort(rng.choice(9, 7, replace=False))
        score = Counter()
        for t in terms.tolist():
            score.update(dict(lists[t]))
        threshold = float(rng.uniform(0.05, 0.4))
        live = [blocks for _, blocks in group.live(np.zeros(7, np.int64), terms, 1, threshold)]
        got = group.search(terms, live[0] if live else [], threshold)
        assert {i: pytest.approx(s) for i, s in got} == {i: s for i, s in score.items() if s >= threshold}
        skipped += sum(map(len, live)) < 25
    assert skipped > 20


def test_texts_together_give_what_each_gives():
    rng = np.random.default_rng(4)
    rows = [(i, b" ".join(b"w%d" % x for x in rng.integers(0, 90, int(rng.integers(3, 40)))), b"") for i in range(50)]
    idf = {b"w%d" % x: 1.0 for x in range(90)}
    index = build_index(rows, idf, 20.0, 5)
    texts = [b"", *(b" ".join([b"z"] * int(rng.integers(0, 30)) + words(q) + [b"z"] * int(rng.integers(0, 30))) for _, q, _ in rows), b"  "]
    alone = [sorted(search(index, t, 0.5, 0.5, 5)) for t in texts]
    assert [sorted(x) for x in search_texts(index, texts, 0.5, 0.5, 5)] == alone and all(alone[1:-1]) and not alone[0]
    assert [sorted(x) for x in search_texts(index, texts[::-1], 0.5, 0.5, 5)] == alone[::-1]


def test_index_retrieves_every_passage_over_the_threshold():
    rng = np.random.default_rng(2)
    rows = [(i, b" ".join(b"w%d" % x for x in rng.integers(0, 400, int(rng.integers(5, 60)))), b"") for i in range(300)]
    frequency = Counter(t for _, q, _ in rows for t in set(words(q)))
    idf = {t: math.log(1 + (300 - f + 0.5) / (f + 0.5)) for t, f in frequency.items()}
    mean = sum(len(words(q)) for _, q, _ in rows) / 300
    index, sure = build_index(rows, idf, mean, 5), 0
    for _, q, _ in rows[::7]:
        w = words(q)
        text = b" ".join([b"pad"] * 37 + w[: len(w) // 2] + [b"swapped"] + w[len(w) // 2 + 1 :] + [b"pad"] * 50)
        found = {i for i, *_ in search(index, text, 0.6, 0.0, 5)}
        for item, question, _ in rows:
            f = Counter(words(question))
            impact = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * sum(f.values()) / mean)) for t, n in f.items()}
            share = sum(s for t, s in impact.items() if t in set(words(text))) / sum(impact.values())
            assert item in found if share >= 0.61 and sum(f.values()) >= len(w) else True
            assert share >= 0.6 - 1e-9 if item in found else True
            sure += item in found
    assert sure >= 43


def test_a_large_index_and_a_long_text_stay_small():
    """20,000 items and a text of a million words: time and memory stay bounded, and what is planted is found."""
    rng = np.random.default_rng(3)
    draw = lambda n: b" ".join(b"w%d" % x for x in rng.zipf(1.3, n) % 60_000)
    rows = [(i, draw(int(rng.integers(12, 60))), b"") for i in range(20_000)]
    frequency = Counter(t for _, q, _ in rows for t in set(words(q)))
    idf = {t: math.log(1 + (20_000 - f + 0.5) / (f + 0.5)) for t, f in frequency.items()}
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    index = build_index(rows, idf, 36.0, 5)
    text = b" ".join([draw(30_000), rows[77][1], draw(30_000), rows[19_999][1]])
    found = {i for i, *_ in search(index, text, 0.6, 0.8, 5)}
    assert {77, 19_999} <= found
    plain = b" ".join([b"x%d" % (i % 50_000) for i in range(1_000_000)] + [rows[5][1]])
    assert 5 in {i for i, *_ in search(index, plain, 0.6, 0.8, 5)}
    more = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    print(f"{more:.0f} MB more")
    assert more < 1000


def test_question_and_answer(spark):
    rows = spark.createDataFrame([(1, "What is it? A thing."), (2, "no sentence"), (3, None), (4, "")], "item_id long, text string")
    got = {r.item_id: (bytes(r.question).strip(), bytes(r.answer).strip()) for r in question_and_answer(rows).collect()}
    assert got == {1: (b"What is it?", b"A thing."), 2: (b"no sentence", b""), 3: (b"", b""), 4: (b"", b"")}


def test_question_without_answer_is_clean(spark, docs_of):
    question = " ".join(f"q{i}" for i in range(20)) + "? "
    answer = " ".join(f"a{i}" for i in range(12)) + "."
    items = spark.createDataFrame([(1, question + answer)], "item_id long, text string")
    docs = docs_of((1, "start " * 90 + question + answer + " end" * 90), (2, question), (3, answer), (4, (question + answer).upper()))
    assert sorted(r.doc_id for r in contaminated(docs, items).collect()) == [1, 4]
    assert sorted(r.doc_id for r in drop_contaminated(docs, items).collect()) == [2, 3]


def test_blocks_of_items_make_no_difference(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = contaminated(documents, items).select("doc_id", "item_id").collect()
    assert sorted(one) == sorted(contaminated(documents, items, block_bytes=1500).select("doc_id", "item_id").collect())


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "same text here again and again"), (1, "same text here again and again"), (None, "no id at all in this row"), (2, None), (3, ""), (4, "one")], "item_id long, text string")
    key = lambda r: (r.doc_id or 0, r.item_id or 0)
    assert sorted(map(key, contaminated(odd_docs, items).collect())) == [(0, 0), (2, 4), (3, 1), (3, 1), (4, 1)]
    kept = drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 5
    assert contaminated(no_docs, items).collect() == [] and contaminated(odd_docs, items.limit(0)).collect() == []
    assert drop_contaminated(no_docs, items).collect() == [] and drop_contaminated(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_rows_and_items_that_share_an_id(spark, docs_of):
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    items = spark.createDataFrame([(1, one), (1, two)], "item_id long, text string")
    docs = docs_of((5, "before " + one), (5, "clean"), (None, two + " behind"), (None, "clean too"), (6, one + " " + two))
    got = sorted(map(repr, contaminated(docs, items).collect()))
    assert sorted((r.doc_id or 0, r.item_id) for r in contaminated(docs, items).collect()) == [(0, 1), (5, 1), (6, 1)]
    assert sorted(map(repr, contaminated(docs, items, block_bytes=10).collect())) == got
    twice = docs.union(docs)
    assert sorted(map(repr, contaminated(twice, items, block_bytes=10).collect())) == sorted(map(repr, contaminated(twice, items).collect())) == sorted(got * 2)
    assert sorted(r.text for r in drop_contaminated(docs, items).collect()) == ["clean", "clean too"]
