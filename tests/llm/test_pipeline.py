"""The corpus pipeline: each stage works on what the one before kept, and its decisions take effect."""

import itertools
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from panelwright.llm.decontaminate import contaminated
from panelwright.llm.quality import scored, train
from panelwright.llm.shared import table, written
from pyspark.sql import functions as F


def test_stages(spark, sf):
    docs, kept = table(spark, sf, "documents"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, written(stage(spark, docs, sf), name)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and ids
        if k < 4:
            assert docs.columns == columns and docs.count() == len(ids)
        if name == "quality":
            model = train(before, table(spark, sf, "labels"))
            assert ids == {r.doc_id for r in scored(before, model).where("score >= 0.7").collect()}
        if name == "decontamination":
            assert contaminated(docs, table(spark, sf, "benchmark")).count() == 0 and len(ids) < before.count()
        kept.append(len(ids))
    assert kept == sorted(kept, reverse=True) and kept[1] < kept[0]
    assert docs.count() > 0 and "epoch" in docs.columns


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_near_duplicates_equal_all_pairs(spark, folder):
    """Every pair of texts that share a shingle is compared by its sets; the first document of each class stays."""
    sf = f"/root/testdata/{folder}"
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: [w.lower() for w in re.findall(rb"[^ \t-\r]+", (r.text or "").encode())] for r in docs.collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in texts.items()}
    root, by, empty = {d: d for d in sets}, defaultdict(list), [d for d, s in sets.items() if not s]
    for d, own in sets.items():
        for s in own:
            by[s].append(d)

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for d in empty:
        join(empty[0], d)
    seen, linked = set(), 0
    for group in by.values():
        for a, b in itertools.combinations(group, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    linked += 1
                    join(a, b)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()}
    print(folder, len(sets), "documents,", linked, "pairs at 0.8 and above,", len(kept), "kept")
    assert kept == {find(d) for d in sets}
    assert linked > 5


def test_odd_and_empty_documents(spark, sf, odd_docs, no_docs):
    """With all their columns, which bear names that the operators use inside."""
    more = lambda df: df.withColumns({c: F.lit(1) for c in ("domain", "tokens", "first", "end", "key_", "n", "question", "epoch_", "__bytes", "__doc", "__key", "__node", "__spans", "__times", "__full", "__last", "__cut0", "__leaf0", "mix___doc")})
    for docs in (more(odd_docs), more(no_docs)):
        columns = docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = written(stage(spark, docs, sf), name)
            assert docs.columns == columns if k < 4 else docs.columns[: len(columns)] == columns
        docs.collect()


def test_rows_without_ids_are_told_apart_by_their_text(spark, sf, documents):
    """Copies and leaks go without an id as well, and all else stays."""
    some = documents.where("doc_id < 150")
    for stage in (corpus_pipeline.near_duplicate_stage, corpus_pipeline.decontamination_stage):
        want = sorted(r.text for r in stage(spark, some, sf).collect())
        got = stage(spark, some.withColumn("doc_id", F.lit(None).cast("long")), sf).collect()
        assert len(got) == len(want)
