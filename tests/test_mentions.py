"""Names in texts against a plain search of every name in every text."""

import random
import re
from collections import defaultdict

from panelwright.operators import mentions
from panelwright.operators.mentions import find_names, first_words, word_list


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain(docs, names):
    texts, bearers = defaultdict(list), defaultdict(set)
    for doc, text in docs:
        texts[doc].append(words(text))
    for name_id, name, context in names:
        if words(name):
            bearers[tuple(words(name))].add((name_id, tuple(words(context))))

    def places(own, key):
        return [i for i in range(len(own) - len(key) + 1) if tuple(own[i : i + len(key)]) == key]

    out = set()
    for doc, all_ in texts.items():
        for key, who in bearers.items():
            at = [i for own in all_ for i in places(own, key)]
            told = [b for b in who if b[1] and any(places(own, b[1]) for own in all_)]
            meant = told if len(who) > 1 and len(told) == 1 else who
            out |= {(doc, i, " ".join(key), len(at), min(at), len(meant) > 1) for i, _ in meant if at}
    return out


def found(spark, docs, names, **how):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    names = spark.createDataFrame(names, "id long, name string, team string")
    got = [tuple(r) for r in find_names(docs, names, "doc_id", "text", "id", "name", "team").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_names_equal_a_plain_search(spark):
    draw = random.Random(9)
    small = ["ann", "lee", "bob", "ray", "fox", "été", "st", "of", "9"]
    docs = [(i % 70, "".join(draw.choice([" ", ", ", "\n", "-", "_", "'"]) + draw.choice([str.lower, str.upper])(draw.choice(small)) for _ in range(draw.randint(0, 40)))) for i in range(80)]
    names = [(i, " ".join(draw.choices(small, k=draw.randint(1, 3))), draw.choice([None, "", "fox", "bob ray", "nowhere"])) for i in range(40)]
    got = found(spark, docs, names)
    assert got == plain(docs, names)
    assert {a for *_, a in got} == {True, False}


def test_homonyms_and_odd_rows(spark):
    docs = [(1, "Mike Williams of Tampa, then mike  williams."), (2, "MIKE WILLIAMS"), (3, "Mike Williams: Tampa or Los Angeles"), (4, None), (5, ""), (None, "Josh Allen!"), (6, "Mike Williamson, xMike Williams")]
    names = [(1, "Mike Williams", "Tampa"), (2, "Mike Williams", "Los-Angeles"), (3, "Josh Allen", None), (3, "Josh Allen", None), (4, "", None), (5, None, "x"), (None, "Tampa", None)]
    assert found(spark, docs, names) == {
        (1, 1, "mike williams", 2, 0, False), (2, 1, "mike williams", 1, 0, True), (2, 2, "mike williams", 1, 0, True), (3, 1, "mike williams", 1, 0, True), (3, 2, "mike williams", 1, 0, True),
        (None, 3, "josh allen", 1, 0, False), (1, None, "tampa", 1, 3, False), (3, None, "tampa", 1, 2, False),
    }
    assert found(spark, [], names) == set() and found(spark, docs, []) == set()


def test_texts_are_cut_once_not_at_every_reading(spark):
    docs = spark.createDataFrame([(1, "Mike Williams of Tampa"), (2, "Mike Williams")], "doc_id long, text string")
    names = spark.createDataFrame([(1, "Mike Williams", "Tampa"), (2, "Mike Williams", "Los Angeles")], "id long, name string, team string")
    plan = find_names(docs, names, "doc_id", "text", "id", "name", "team")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
    long = spark.createDataFrame([(",a b, c-d e f",), ("a b c",), ("",), (None,), ("A b c d",)], "x string")
    assert [r[0] for r in long.select(first_words(long.x, 4)).collect()] == [["a", "b", "c", "d"], ["a", "b", "c"], [], [], ["a", "b", "c", "d"]]


def test_contexts_are_written_beside_their_homonyms_alone(spark, monkeypatch):
    tables, write = [], mentions.settled
    monkeypatch.setattr(mentions, "settled", lambda df, tag: tables.append(write(df, tag)) or tables[-1])
    docs = [(i, "from Tampa to Los Angeles") for i in range(200)] + [(900, "Mike Williams of Tampa"), (901, "Mike Williams"), (901, "from Tampa"), (None, "Mike Williams of Tampa")]
    names = [(1, "Mike Williams", "Tampa"), (2, "Mike Williams", "Los Angeles")]
    nobody = {(None, i, "mike williams", 1, 0, True) for i in (1, 2)}
    assert found(spark, docs, names) == {(900, 1, "mike williams", 1, 0, False), (901, 1, "mike williams", 1, 0, False), *nobody}
    assert max(t.count() for t in tables if "__doc" in t.columns) < 50


def test_full_filters_small_runs_and_texts_of_many_homonyms_lose_nothing(spark, monkeypatch):
    draw = random.Random(4)
    small = ["ann", "lee", "bob", "ray", "fox", "σίσυφος", "st"]
    docs = [(i % 45, " ".join(draw.choices(small, k=draw.randint(0, 30)))) for i in range(50)]
    names = [(i, " ".join(draw.choices(small, k=draw.randint(1, 2))), draw.choice([None, "fox", "bob ray", "nowhere", "lee st"])) for i in range(60)]
    for odd in ({"MOST_PAIRS": 0, "BEARERS_A_DEAL": 2}, {"MOST_BITS": 6, "HELD": 16, "BEARERS_A_DEAL": 1}):
        with monkeypatch.context() as changed:
            for name, value in odd.items():
                changed.setattr(mentions, name, value)
            assert found(spark, docs, names) == plain(docs, names)


def test_first_words_are_those_of_the_whole_text(spark):
    texts = [" " * 600 + "A b c d e", "a b c " + "D" * 600 + " e f", "x " * 246 + "abcd efgh", "Α Β Γ ΔΣ.Ε Ζ", "a b c d" + "." * 600 + "e", "a b c d" + "." * 490, None, "É È Ê Ë Ù " * 90]
    long = spark.createDataFrame([(t,) for t in texts], "x string")
    for got, whole in long.select(first_words(long.x, 4), word_list(long.x)).collect():
        assert got == whole[:4]
