import zlib

import numpy as np
from helpers import ODD, docs, table

from triplewright.llm import quality_classifier as Q


def test_held_out_accuracy(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    labels = table(spark, big, "labels")
    rows = Q.classify(table(spark, big), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    good, bad = [r.score for r in test if r.quality == 1], [r.score for r in test if r.quality == 0]
    assert sum(r.predicted == r.quality for r in test) / len(test) > 0.95
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, sf):
    d, labels = table(spark, sf), table(spark, sf, "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert (Q.train(d, labels.filter(~Q.held_out())) == Q.train(d.repartition(5), turned.filter(~Q.held_out()))).all()
    a = {r.doc_id: r.score for r in Q.classify(d, labels).collect()}
    b = {r.doc_id: r.score for r in Q.classify(d.selectExpr("doc_id", "text", "'z' AS lang", "1 AS score", "1 AS label"), labels).collect()}
    assert a == b and len(a) == d.count()


def test_odd_rows(spark, sf):
    labels = table(spark, sf, "labels")
    weights = Q.train(table(spark, sf), labels)
    out = Q.score(docs(spark, ODD), weights).collect()
    assert len(out) == len(ODD)
    bias = 1 / (1 + np.exp(-weights[-1]))
    assert all(abs(r.score - bias) < 1e-6 for r in out if r.doc_id in (1, 2))
    assert Q.score(docs(spark, []), weights).count() == 0


def test_no_labels(spark):
    d = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in Q.classify(d, none).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in Q.classify(d, nulls).collect()} == {0.5}


def test_dropping_keeps_columns(spark, sf):
    d = table(spark, sf)
    out = Q.drop_low_quality(d, table(spark, sf, "labels"))
    assert out.columns == d.columns and 0.7 * d.count() < out.count() < d.count()


def test_features_are_counts_of_whole_texts():
    i, x = Q.features(b"a b a b")
    assert len(i) == len(set(i.tolist())) and (x > 0).all()
    whole = b"word other. " * 200_000
    assert len(Q.features(whole)[0]) < 40
    assert len(Q.features(b"")[0]) == 0


def plain_ftrl(examples, alpha=0.3, beta=1.0, l1=0.02, l2=0.5, epochs=Q.EPOCHS):
    """Updates of McMahan and others (2013), one coordinate at a time."""
    import math

    z, n, bias = {}, {}, 1 << Q.BITS

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            index, value, label = examples[k]
            x = dict(zip(index.tolist(), map(float, value), strict=True)) | {bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i, xi in x.items():
                g = (p - label) * xi
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z}


def test_weights_and_scores_equal_plain_updates(spark, sf):
    rows = table(spark, sf).join(table(spark, sf, "labels"), "doc_id").orderBy("doc_id").limit(60).collect()
    examples = [(*Q.features(r.text.encode()), r.quality) for r in rows]
    want, got = plain_ftrl(examples), Q.ftrl(examples)
    assert all(abs(got[i] - w) < 1e-9 for i, w in want.items()) and set(np.flatnonzero(got)) <= set(want)
    d = docs(spark, [(r.doc_id, r.text) for r in rows])
    for r in Q.score(d, got).collect():
        index, value = Q.features(next(x.text for x in rows if x.doc_id == r.doc_id).encode())
        s = sum(want.get(i, 0.0) * float(v) for i, v in zip(index.tolist(), value, strict=True)) + want.get(1 << Q.BITS, 0.0)
        assert abs(r.score - 1 / (1 + np.exp(-s))) < 1e-6


def test_repeated_ids_train_once(spark, sf):
    d, labels = table(spark, sf), table(spark, sf, "labels")
    twice = d.unionByName(d)
    assert (Q.train(twice, labels) == Q.train(d, labels)).all()
