"""Spelling variants against the SQL, against all pairs of words, and odd texts."""

import zlib
from collections import Counter

import numpy as np
from panelwright.llm.queries import ORACLES, QUERIES
from panelwright.llm.spelling import PROBES, RUN, _by_length, _points, _prefixes, _probes, near_pairs, neighbours, spelling_groups, vocabulary


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def grouped(texts):
    """spelling_groups of (doc_id, text) pairs, word by word and pair by pair."""
    import re

    n = Counter()
    for i, text in texts:
        for run in re.findall(RUN, text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if distance_one(w, v)] for w in n}
    form = {w: best for w in n if near[w] and n[best := min(near[w], key=lambda v: (-n[v], v))] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def test_query_equals_its_sql(spark, sf):
    from oracle import check

    assert check(QUERIES["op11_spelling"](spark, sf), sf, ORACLES["op11_spelling"]) > 500


def test_groups_equal_all_pairs(spark, docs_of):
    words = {"letter": 700, "lettre": 30, "leteré": 5, "leter": 90, "lettes": 100, "letters": 120, "lettters": 6, "aaaaaa": 40, "aaaaaaa": 300, "aaaaaaaa": 8, "Étéété": 7, "Étéét": 50, "Étéétés": 60, "Banana": 5, "BANANAS": 25, "bananan": 125}
    texts = [(k, " ".join(w for w, n in words.items() for _ in range(n // 5 + (k < n % 5)))) for k in range(5)]
    texts += [(None, "letter9letter letter"), (7, None), (8, ""), (8, "letter"), (8, "letter")]
    got = [tuple(r) for r in spelling_groups(docs_of(*texts)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == grouped(texts)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a chain of forms


def test_whole_neighbourhood_comes_once_and_fast_hashes_are_those_of_the_strings():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abé"), rng.integers(1, 7))) for _ in range(60)]
    alphabet, bits = np.array(sorted(map(ord, "abé")), np.uint32), 16
    everything = np.full(1 << (bits - 6), ~np.uint64(0))
    made = [(int(r), c) for rows, candidates in neighbours(words, alphabet, everything, bits) for r, c in zip(rows, candidates)]
    assert len(made) == len(set(made))
    letters = [chr(a) for a in alphabet]
    for k, w in enumerate(words):
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + t :] for i in range(len(w) + 1) for a in letters for t in (0, 1) if i + t <= len(w)}
        assert {c for r, c in made if r == k} == want - {w}
    held = np.zeros(1 << (bits - 6), np.uint64)
    chosen = sorted({c for _, c in made})[::7]
    for _, rows in _by_length(chosen):
        hashes = _prefixes(_points([chosen[r] for r in rows]))[:, -1]
        for k in range(PROBES):
            for bit in _probes(hashes, bits, k).tolist():
                held[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)
    kept = {(int(r), c) for rows, candidates in neighbours(words, alphabet, held, bits) for r, c in zip(rows, candidates)}
    assert {x for x in made if x[1] in chosen} <= kept and len(kept) < len(made)


def test_a_full_filter_loses_nothing(spark, docs_of, monkeypatch):
    texts = [(1, "letters lettere letterz letter " * 9)]
    want = {tuple(r) for r in spelling_groups(docs_of(*texts)).collect()}
    monkeypatch.setattr("panelwright.llm.spelling.BITS_A_WORD", 0)
    assert {tuple(r) for r in spelling_groups(docs_of(*texts)).collect()} == want
    words = vocabulary(docs_of(*texts))
    assert {(r.word, r.near) for r in near_pairs(words).collect()} == {(a, b) for a in ("letters", "lettere", "letterz", "letter") for b in ("letters", "lettere", "letterz", "letter") if distance_one(a, b)}


def test_odd_documents(spark, odd_docs, no_docs, docs_of):
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert {tuple(r) for r in spelling_groups(odd_docs).collect()} == grouped(texts)
    assert spelling_groups(no_docs).collect() == []
    long_word = "ab" * 20_000
    got = spelling_groups(docs_of((1, f"{long_word} " * 6 + f"{long_word}x "))).collect()
    assert [(r.word, r.n, r.n_near) for r in got] == [(long_word, 6, 0)]
