"""Mixing against a plain recomputation of budgets and prefixes."""

from collections import defaultdict

import pytest
from panelwright.llm.mixing import DOMAINS, WEIGHTS, allocate, mix, mix_by_source
from panelwright.llm.queries import QUERIES


def test_shortages_go_to_siblings_first():
    supply = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 1000}
    got = allocate(supply, {("a",): 0.5, ("b",): 0.5}, 400, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}


def test_shortages_of_all_siblings_go_to_ancestors():
    supply = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 1000, ("c", "x"): 1000}
    got = allocate(supply, {("a",): 0.5, ("b",): 0.3, ("c",): 0.2}, 400, 2)
    assert got == {("a", "x"): 20, ("a", "y"): 40, ("b", "x"): 204, ("c", "x"): 136}


def test_budget_beyond_all_supply():
    assert allocate({("a",): 5, ("b",): 7}, {}, 1000, 3) == {("a",): 15, ("b",): 21}
    assert allocate({}, {}, 10, 1) == {} and allocate({("a",): 5}, {("a",): 0.0}, 3, 1) == {("a",): 3}


def test_query_fills_each_leaf(spark, sf, documents):
    rows = QUERIES["op4_mixing"](spark, sf).collect()
    docs = documents.collect()
    supply, tokens, leaf = defaultdict(int), {}, {}
    for r in docs:
        leaf[r.doc_id], tokens[r.doc_id] = (DOMAINS.get(r.source, "community"), r.lang, r.source), len([w for w in __import__("re").findall(r"[^ \t-\r]+", r.text)])
        supply[leaf[r.doc_id]] += tokens[r.doc_id]
    budget = allocate(supply, WEIGHTS, 0.6 * sum(supply.values()), 3)
    took, times = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.tokens == tokens[r.doc_id] and (r.domain, r.lang, r.source) == leaf[r.doc_id]
        took[leaf[r.doc_id]] += r.tokens
        times[r.doc_id] += 1
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    longest = defaultdict(int)
    for d, l in leaf.items():
        longest[l] = max(longest[l], tokens[d])
    for l, n in budget.items():
        assert n - longest[l] < took[l] <= n
        own = [times[d] for d in leaf if leaf[d] == l]
        assert max(own) - min(own) <= 1


def test_prefix_is_the_longest_in_the_seeded_order(spark, docs_of):
    docs = docs_of(*((i, "word " * (i % 7 + 1)) for i in range(400)))
    order = spark.sql("select id, shiftrightunsigned(xxhash64(17, 1, id), 1) as k from range(400)").collect()
    total, want = 0, []
    for r in sorted(order, key=lambda r: r.k):
        total += r.id % 7 + 1
        if total > 500:
            break
        want.append(r.id)
    got = mix(docs, ("source",), {}, budget_tokens=500).collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and {r.mix_epoch for r in got} == {1}


def test_rounds_make_no_difference(documents, monkeypatch):
    from panelwright.llm import mixing

    taken = lambda: {(r.doc_id, r.epoch) for r in mix_by_source(documents).collect()}
    one = taken()
    for window, rounds in ((0, (13, 13, 13, 12, 12)), (3, (2, 3, 20, 38)), (1 << 13, (63,))):
        monkeypatch.setattr(mixing, "WINDOW", window)
        monkeypatch.setattr(mixing, "ROUNDS", rounds)
        assert taken() == one


def test_same_seed_same_mixture(documents):
    one, two, other = ({(r.doc_id, r.epoch) for r in mix_by_source(documents.repartition(n), seed=s).collect()} for n, s in ((1, 17), (5, 17), (3, 18)))
    assert one == two != other


def test_too_many_leaves_is_an_error(documents):
    with pytest.raises(ValueError, match="leaves"):
        mix_by_source(documents, max_leaves=2)


def test_odd_rows(odd_docs, no_docs):
    rows = mix_by_source(odd_docs, budget_share=1.0, max_epochs=1)
    assert rows.columns == [*odd_docs.columns, "domain", "mix_epoch", "tokens"] and rows.count() == odd_docs.count()
    assert mix_by_source(no_docs).collect() == []


def test_columns_of_the_documents_stay(spark):
    """Columns that bear the names of the operator's own, inside and in its result."""
    names = ["domain", "epoch", "tokens", "full", "rest", "key", "bucket", "supply", "n", "mix_epoch", "a.b"]
    docs = spark.createDataFrame([(1, "one two", "en", "src0", *range(11)), (2, "three", "de", "src7", *range(11))], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    rows = mix_by_source(docs, budget_share=2.0, max_epochs=2)
    assert rows.columns == [*docs.columns, "mix_domain", "mix_mix_epoch", "mix_tokens"]
    assert sorted((r.doc_id, r.mix_domain, r.mix_mix_epoch, r.mix_tokens, *r[4:15]) for r in rows.collect()) == [(i, d, e, n, *range(11)) for i, d, n in ((1, "crawl", 2), (2, "reference", 1)) for e in (1, 2)]


def test_repeated_ids_and_one_place_for_all(docs_of):
    """Rows of one doc_id share a place, so that they come together or not at all, also if they are all there is."""
    docs = docs_of(*[(7, "a b c")] * 50, *[(None, "d")] * 30)
    got = mix(docs, ("source",), {}, budget_tokens=160).collect()
    assert len(got) in (50, 80, 30) and sum(r.tokens for r in got) <= 160
