"""SimHash near-duplicates against all pairs of fingerprints made word by word."""

import re

import numpy as np
import xxhash
from panelwright.llm.components import connected_components
from panelwright.llm.queries import QUERIES
from panelwright.llm.shared import written
from panelwright.llm.simhash import FIVE_WORDS, block_keys, keep_one_of_each, near_links, simhash_components


def plain_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """{doc_id: smallest linked doc_id} by all pairs; prints: (doc_id, fingerprint)."""
    ids, f = [i for i, _ in prints], np.array([p for _, p in prints], np.uint64)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[k:] ^ f[k]) <= radius) + k:
            a, b = find(ids[k]), find(ids[int(j)])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_equals_all_pairs(spark, sf, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, sf).collect()}
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in documents.collect()]
    component = plain_components(prints)
    assert got == {i: (f"{p:016x}", component[i]) for i, p in prints}


def test_links_at_three_bits_and_not_at_four(spark):
    rng = np.random.default_rng(3)
    prints = []
    for k in range(200):
        base = int(rng.integers(0, 1 << 63))
        for away in (0, 1, 3, 4):
            flip = sum(1 << int(b) for b in rng.choice(64, away, replace=False))
            prints.append((len(prints), base ^ flip))
    signed = [(i, p - (1 << 64) if p >= 1 << 63 else p) for i, p in prints]
    links = near_links(spark.createDataFrame(signed, "node long, f0 long"), 3, 5, 2)
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert {i: got.get(i, i) for i, _ in prints} == plain_components(prints)


def test_large_blocks_lose_no_link(spark, monkeypatch):
    from panelwright.llm import simhash

    monkeypatch.setattr(simhash, "SLICE", 16)
    prints = [(i, (i % 300) << 20) for i in range(300)]
    for most in (0, 1 << 18):
        monkeypatch.setattr(simhash, "MOST_LARGE", most)
        links = near_links(spark.createDataFrame(prints, "node long, f0 long"), 3, 5, 2)
        got = {r.node: r.component for r in connected_components(links).collect()}
        assert {i: got.get(i, i) for i, _ in prints} == plain_components(prints)


def test_block_keys_have_a_number_of_their_own(spark):
    row = spark.createDataFrame([(5, 7, 9)], "f0 long, f1 long, f2 long").select(*block_keys(3, 8, 2)).first()
    assert len(set(row)) == 84


def test_odd_rows(odd_docs, no_docs):
    rows = simhash_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r.doc_id: r for r in rows}
    assert found[1].component_id == found[6].component_id == found[8].component_id == 1
    assert found[4].component_id == 3
    assert simhash_components(no_docs).collect() == []


def test_long_text_is_read_whole(docs_of):
    words = " ".join(f"w{i}" for i in range(300_000))
    row = simhash_components(docs_of((1, words))).first()
    assert row.f0 % (1 << 64) == plain_fingerprint(words)


def test_near_copies_go_and_others_stay(docs_of):
    rng = np.random.default_rng(5)
    base = [f"w{int(x)}" for x in rng.integers(0, 5000, 400)]
    near = base[:200] + ["changed"] + base[201:]
    half = base[:200] + [f"v{int(x)}" for x in rng.integers(0, 5000, 200)]
    docs = docs_of((1, " ".join(base)), (2, " ".join(near)), (3, " ".join(half)), (4, " ".join(base).upper()), (4, " ".join(base).upper()))
    kept = keep_one_of_each(docs, **FIVE_WORDS)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == docs.columns


def test_one_of_repeated_rows_stays(odd_docs, no_docs):
    rows = keep_one_of_each(odd_docs, **FIVE_WORDS)
    kept = rows.collect()
    assert rows.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 3, 5, 7]
    assert [r.text for r in kept if r.doc_id is None] == ["no id at all in this row"]
    assert keep_one_of_each(no_docs, **FIVE_WORDS).collect() == []


def test_chains_settle(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    assert {r.component for r in connected_components(edges).collect()} == {0}


def test_copies_are_those_of_similarity_at_least_four_fifths(docs_of):
    def text(k, n, changed):
        return " ".join(f"x{i}" if i >= n - changed else f"k{k}w{i}" for i in range(n))

    texts, linked = [], []
    for k in range(60):  # 4 of 5 shingles; 36 of 44 and 34 of 46 if the last 4 and 6 of 44 words differ
        for one, other, alike in ((text(k, 9, 0), text(k, 8, 0), True), (text(f"{k}a", 44, 0), text(f"{k}a", 44, 4), True), (text(f"{k}b", 44, 0), text(f"{k}b", 44, 6), False)):
            texts += [one, other]
            linked.append(alike)
    kept = {r.doc_id for r in keep_one_of_each(docs_of(*enumerate(texts)), **FIVE_WORDS).collect()}
    assert kept == {2 * i for i in range(len(linked))} | {2 * i + 1 for i, alike in enumerate(linked) if not alike}


def test_components_equal_all_pairs_of_sets(docs_of):
    rng = np.random.default_rng(7)
    texts = []
    for k in range(12):
        words = [f"k{k}w{i}" for i in range(60)]
        for _ in range(8):  # drifts away, so that chains form
            words = [f"v{int(rng.integers(1 << 30))}" if rng.random() < 0.012 else w for w in words]
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    kept = {r.doc_id for r in keep_one_of_each(docs_of(*enumerate(texts)), **FIVE_WORDS).collect()}
    assert kept == set(root) and 12 < len(kept) < len(texts)


def test_each_row_is_decided_by_its_text(docs_of):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (1, two), (1, two), (None, one), (None, three), (None, three), (7, three + " more"), (None, "only here and without an id"), (9, None), (None, "")]
    kept = sorted(((r.doc_id or 0), r.text or "") for r in keep_one_of_each(docs_of(*rows), **FIVE_WORDS).collect())
    assert kept == sorted([(1, one), (1, two), (7, three + " more"), (0, "only here and without an id"), (9, "")])


def test_recall_by_band_of_similarity(docs_of):
    """Pairs at 0.8 and more are linked whatever the band, those below never."""
    rng, texts, similarity = np.random.default_rng(17), [], []
    for k in range(400):
        n = int(rng.integers(30, 300))
        words = [f"p{k}w{i}" for i in range(n)]
        other = list(words)
        for at in rng.choice(n, max(1, int(n * rng.uniform(0.0, 0.06))), replace=False):
            other[at] = "changed"
        a, b = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (words, other))
        similarity.append(len(a & b) / len(a | b))
        texts += [" ".join(words), " ".join(other)]
    kept = {r.doc_id for r in keep_one_of_each(docs_of(*enumerate(texts)), **FIVE_WORDS).collect()}
    linked, similarity = np.array([2 * k + 1 not in kept for k in range(400)]), np.array(similarity)
    for low, high in ((0.0, 0.7), (0.7, 0.8), (0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        band = (similarity >= low) & (similarity < high)
        print(f"{low} to {high}: {band.sum()} pairs, linked {linked[band].mean():.3f}")
        assert band.sum() > 10 and linked[band].mean() == float(low >= 0.8)


def test_texts_of_one_template_are_not_dealt_to_each_other(spark, docs_of, monkeypatch):
    """3,000 and 6,000 texts with 40 words in common and 20 of their own, and a near copy of every hundredth."""
    from panelwright.llm import simhash

    dealt = {}
    real = simhash._dealt
    monkeypatch.setattr(simhash, "_dealt", lambda rows, *a: dealt.update({n: rows.count()}) or real(rows, *a))
    template = [f"t{i}" for i in range(40)]
    for n in (3000, 6000):
        rng, texts, linked = np.random.default_rng(n), [], set()
        for k in range(n):
            own = [f"o{k}x{i}" for i in range(20)]
            texts.append((k, " ".join(template[:20] + own + template[20:])))
            if k % 100 == 0:
                at = int(rng.integers(0, 20))
                texts.append((n + k, " ".join(template[:20] + own[:at] + ["other"] + own[at + 1 :] + template[20:])))
                linked.add(n + k)
        kept = {r.doc_id for r in keep_one_of_each(docs_of(*texts), **FIVE_WORDS).collect()}
        assert kept == set(range(n))
    assert dealt[6000] <= 0.05 * 6000  # before, all texts of a template were one group


def test_near_copies_meet_by_fingerprints_first(spark):
    """Pairs of SimHash are settled by their sets too: with bands of so many rows that no pair shares one, they are
    found all the same."""
    from panelwright.llm.simhash import near_copies

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(reversed(words)), ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in near_copies(docs, bands=1, rows=1000).collect()}
    assert got[0] == got[1] and len({got[0], got[2], got[3]}) == 3


def test_few_edges_are_few_files(spark, tmp_path, monkeypatch):
    """A round's table has no file for each partition of a shuffle, whatever the settings of the session."""
    from panelwright.llm import components

    tables = []
    monkeypatch.setattr(components, "written", lambda df, tag: (tables.append(df), written(df, tag))[1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("48", "false")):
        spark.conf.set(k, v)
    try:
        edges = spark.range(3000).selectExpr("id as u", "id - id % 10 as v").repartition(8)
        got = {r.node: r.component for r in components.connected_components(edges).collect()}
        parts = [df.rdd.getNumPartitions() for df in tables[1:]]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 10 for i in range(3000)}
    assert parts and max(parts) <= components.FEW_PARTS
