"""The quality classifier: held-out accuracy, the pairwise fit, and what it never looks at."""

import zlib

import numpy as np
from panelwright.llm.quality import FEATURES, features, fit, keep_good, scored, train
from panelwright.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op8_quality"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9 and np.mean([p == y for _, p, y in held]) > 0.85


def test_pairs_rank_a_planted_score():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, len(FEATURES)))
    truth = x @ rng.normal(size=len(FEATURES))
    y = (rng.uniform(size=3000) < 1 / (1 + np.exp(-2 * truth))).astype(int)
    model = fit(x, y)
    assert np.corrcoef(model.margin(x), truth)[0, 1] > 0.97
    assert abs((model.score(x) >= model.quantile_score).mean() - y.mean()) < 0.02


def test_one_label_or_none():
    x = np.ones((5, len(FEATURES)))
    assert fit(x, np.ones(5, int)).score(x).min() > 0.99 and fit(x, np.zeros(5, int)).score(x).max() < 0.01
    assert fit(x[:0], np.zeros(0, int)).score(x).tolist() == [0.5] * 5


def test_scores_see_the_text_only(spark, sf, documents):
    model = train(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    plain = {r.doc_id: r.score for r in scored(documents, model).collect()}
    other = documents.selectExpr("doc_id + 1000000 as doc_id", "text", "'xx' as lang", "'zz' as source", "n_chars")
    assert {r.doc_id - 1000000: r.score for r in scored(other, model).collect()} == plain


def test_held_out_labels_are_not_learned(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = train(documents, labels), train(documents, turned)
    assert np.allclose(a.weight, b.weight) and a.offset == b.offset


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None), (5, 7), (2, 0)], "doc_id long, quality int")
    model = train(odd_docs, labels)
    rows = scored(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 8)}) == 1
    assert keep_good(odd_docs, model, 0.0).count() == odd_docs.count() and keep_good(odd_docs, model, 1.1).count() == 0
    assert keep_good(odd_docs, model, 0.0).columns == odd_docs.columns
    assert scored(no_docs, train(no_docs, labels.limit(0))).collect() == []
    assert features(b"") == [0.0] * len(FEATURES)


def test_every_pair_counts_and_none_is_drawn():
    """The weights are where the gradient over all pairs vanishes."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(FEATURES)))
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-x[:, 0] - x[:, 1]))).astype(int)
    model = fit(x, y)
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, len(FEATURES))
    gradient = -(diff / (1 + np.exp(diff @ model.weight))[:, None]).mean(axis=0) + model.weight / 60_000
    assert np.abs(gradient).max() < 1e-4
    assert (model.score(x) >= model.quantile_score).sum() == y.sum()


def test_every_label_is_learned_from(spark):
    """Passes over a table give what all its rows give at once."""
    docs = spark.range(2_000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, cast(id % 23 as int)), i -> concat('w', cast(crc32(cast(concat(id, ':', i) as binary)) % 50 as string))), if(crc32(cast(cast(id as string) as binary)) % 3 = 0, '!', '.')) as text")
    labels = docs.selectExpr("doc_id", "cast(crc32(cast(concat('q', doc_id) as binary)) % 5 < if(doc_id % 23 > 11, 4, 1) as int) as quality")
    rows = {r.doc_id: r for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    want = fit(np.array([features(r.text.encode()) for r in rows.values()]), np.array([r.quality for r in rows.values()]))
    got = train(docs, labels)
    assert np.allclose(got.weight, want.weight, atol=1e-6) and np.allclose([got.slope, got.offset, got.quantile_score], [want.slope, want.offset, want.quantile_score], atol=1e-6)
