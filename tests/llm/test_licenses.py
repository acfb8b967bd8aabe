"""License scans against plain searches, and suppression by priority and containment."""

import itertools
import math
import re

from panelwright.llm.licenses import BASE, NOTICES, TEXTS, Rule, Scanner, license_scan, rules, scan
from panelwright.llm.queries import QUERIES
from panelwright.llm.shared import words


def test_query_equals_a_plain_search(spark, sf, documents):
    got = {r.doc_id: r for r in QUERIES["op3_licenses"](spark, sf).collect()}
    for row in documents.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), row.text or ""))
        places = [(i, label) for phrase, label in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.decode().split()]
        r = got[row.doc_id]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1


def test_rules_are_many_and_every_match_has_its_keyword():
    table = rules()
    assert len(table) > 580 and len(NOTICES.strip().splitlines()) + len(TEXTS) > 250 and [r.priority for r in table] == sorted((r.priority for r in table), reverse=True)
    for rule in table:
        re.compile(rule.pattern)


def test_prefilter_loses_nothing(documents):
    scanner = Scanner()
    for row in documents.collect():
        found = words(row.text.encode())
        joined = b" ".join((b"", *found, b""))
        for k, pattern in enumerate(scanner.patterns):
            if scanner.rules[k].keyword.encode() not in found:
                assert not pattern.search(joined)


def test_contained_detections_are_suppressed():
    table = [Rule("outer", "b", 80, "a b c"), Rule("inner", "b", 60, "b"), Rule("over", "c", 60, "c d"), Rule("strong", "d", 90, "d")]
    scanner = Scanner(table)
    found = b"a b c d".split()
    kept = [(a, b, scanner.rules[k].label) for a, b, k in scanner.detections(found, b" a b c d ")]
    assert kept == [(0, 3, "outer"), (2, 4, "over"), (3, 4, "strong")]


def test_known_notices():
    scanner = Scanner()
    labels = lambda t: set(scan(t.encode(), scanner)["labels"].split(","))
    assert "apache" in labels("Licensed under the Apache License, Version 2.0")
    assert "mit" in labels("SPDX-License-Identifier: MIT")
    assert {"gpl"} <= labels("the GNU General Public License as published")
    assert labels("an ordinary sentence about cats") == {""}


def test_odd_rows(odd_docs, no_docs):
    rows = license_scan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.score == 0 and r.n_words == 0 for r in rows if r.doc_id in (1, 6, 8))
    assert license_scan(no_docs).collect() == []


def forms(pattern, most=3000):
    """Strings for the alternatives of a pattern: all combinations, or each alternative once if they are many."""
    parser = re._parser

    def of(items):
        parts = [one(op, arg) for op, arg in items]
        if math.prod(map(len, parts)) <= most:
            return ["".join(x) for x in itertools.product(*parts)]
        return ["".join(p[i % len(p)] for p in parts) for i in range(max(map(len, parts)))]

    def one(op, arg):
        name = str(op)
        if name == "LITERAL":
            return [chr(arg)]
        if name == "BRANCH":
            return [x for branch in arg[1] for x in of(branch)]
        if name == "SUBPATTERN":
            return of(arg[3])
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, many, inner = arg
            return [x * n for n in sorted({least, min(many, max(1, least))}) for x in (of(inner) if n else [""])]
        if name == "IN":
            return [chr(c) for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1) if str(o) == "RANGE" else [ord("7")])][:10]
        raise AssertionError(name)

    return of(parser.parse(pattern))


def test_every_form_of_a_pattern_has_the_keyword():
    for rule in rules():
        for form in forms(rule.pattern):
            assert re.fullmatch(rule.pattern, form) and rule.keyword in re.sub("[^a-z0-9\x80-\uffff]", " ", form).split(), (rule, form)


def test_forms_written_as_one_word_or_two_are_found():
    scanner = Scanner()
    for text, label in (
        ("released under the GPLv3", "gpl"), ("gpl2 or later", "gpl"), ("GPL v1 only", "gpl"), ("LGPLv2.1", "lgpl"), ("lgpl 3", "lgpl"), ("AGPLv3", "agpl"), ("agpl3", "agpl"),
        ("WTFPL", "wtfpl"), ("do what the fuck you want to public license", "wtfpl"), ("CC0", "cc0"), ("Creative Commons Zero", "cc0"), ("CC Zero", "cc0"),
        ("open rail m license", "openrail"), ("OpenRAIL-M", "openrail"), ("beer-ware license", "beerware"), ("Beerware License", "beerware"),
        ("for personal use only", "non-commercial"), ("noncommercial use only", "non-commercial"), ("non-commercial use only", "non-commercial"),
        ("registered trademarks of X", "trademark"), ("a trademark of X", "trademark"),
    ):
        assert label in scan(text.encode(), scanner)["labels"].split(","), text
