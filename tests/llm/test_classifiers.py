"""Quality and toxicity: held-out accuracy, folds, and odd inputs."""

import zlib

import numpy as np
from llm_fixtures import collected, edge_rows, table

from pyspark.sql import functions as F

from colorway.llm import quality, toxicity
from colorway.llm.queries import op1_quality_qda, op3_toxicity_ftrl

SF = "/root/testdata/sf0.01"


def _held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def _shape(rows, docs, cutoff):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cutoff)
        assert r["held_out"] == _held_out(r["doc_id"])


def test_quality_held_out(spark):
    rows = collected(op1_quality_qda(spark, SF))
    _shape(rows, table(spark, "documents", SF).collect(), 0.3)
    labels = {r.doc_id: r.quality for r in table(spark, "labels", SF).collect()}
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(pairs) > 30 and np.mean([p == y for p, y in pairs]) > 0.9


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = collected(op3_toxicity_ftrl(spark, sf))
    _shape(rows, table(spark, "documents", sf).select("doc_id").collect(), 0.5)
    labels = {r.doc_id: r.toxic for r in table(spark, "labels", sf).collect()}
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p for p, y in pairs if y]) > 0.7 and np.mean([p for p, y in pairs if not y]) < 0.02


def test_edges(spark, edges):
    for classify, label, cutoff in ((quality.classify, "quality", 0.3), (toxicity.classify, "toxic", 0.5)):
        labels = spark.createDataFrame(
            [(i, i % 2, i % 3 == 0) for i, *_ in edge_rows() if i] + [(None, 1, True), (5, None, None), (77777, 1, True)],
            "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) toxic")
        rows = collected(classify(edges, labels))
        _shape(rows, edges.collect(), cutoff)
        empty = [r["score"] for r in rows if r["doc_id"] in (1, 2, 3)]
        assert empty == [0.0] * 3, label
        assert len({r["score"] for r in rows if r["doc_id"] == 12}) == 1


def test_labels_of_one_class_or_none(spark, edges, no_labels, no_docs):
    one = spark.createDataFrame([(i, 1, 1) for i, *_ in edge_rows() if i], "doc_id long, quality int, toxic int")
    for classify in (quality.classify, toxicity.classify):
        assert all(r["score"] > 0.99 for r in collected(classify(edges, one)) if r["doc_id"] in (5, 7, 100))
        assert all(r["score"] == 0.5 for r in collected(classify(edges, no_labels)) if r["doc_id"] in (5, 7, 100))
        assert classify(no_docs, no_labels).count() == 0
        assert classify(no_docs, one).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    """Flipping the held-out labels changes no score."""
    docs, labels = table(spark, "documents"), table(spark, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality",
                                "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    for classify in (quality.classify, toxicity.classify):
        a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in collected(classify(docs, x))) for x in (labels, flipped))
        assert a == b


def test_discriminant_is_the_log_density_ratio():
    """Scores equal those of the densities computed directly."""
    rng = np.random.default_rng(0)
    x = {k: rng.normal(k, 1 + k, (400, quality.SIZE)) for k in (0, 1)}
    moments = {k: quality.Moments(len(v), v.sum(0), v.T @ v) for k, v in x.items()}
    model = quality.discriminant(moments, pooling=0.0, ridge=0.0, temperature=1.0)
    at = rng.normal(0.5, 2, (20, quality.SIZE))
    logs = []
    for k in (0, 1):
        cov = np.cov(x[k].T, bias=True)
        d = at - x[k].mean(0)
        logs.append(-0.5 * np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(at), 1 / (1 + np.exp(-(logs[1] - logs[0]))), atol=1e-6)


def test_ftrl_is_sparse_and_finds_the_signal():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        noise = rng.choice(np.arange(100, 5000), 30, replace=False)
        rows.append((np.unique(np.append(noise, 7) if k % 3 == 0 else noise), int(k % 3 == 0)))
    w, _, bias = toxicity.ftrl(rows)
    assert w[7] > 1 and bias < 0 and np.count_nonzero(w) < 100


def test_ftrl_equals_a_plain_loop_per_coordinate():
    """The update rule written out for one coordinate at a time."""
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(40, 8, replace=False)), int(rng.random() < 0.4)) for _ in range(80)]
    z, n, bias, squares = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            g = 1 / (1 + np.exp(-(bias + sum(w.values())))) - y
            for i in x:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
            squares += g * g
            bias -= toxicity.ALPHA / (toxicity.BETA + squares ** 0.5) * g
    found, _, intercept = toxicity.ftrl(rows, epochs=3)
    assert np.allclose([found[i] for i in range(40)], [weight(i) if i in z else 0 for i in range(40)]) and np.isclose(intercept, bias)
    assert np.count_nonzero(found) > 3


def test_features_are_words_pairs_and_skip_pairs():
    """As many coordinates as distinct grams; word edges and case do not count."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        w = [str(rng.integers(30)) + "w" for _ in range(rng.integers(0, 60))]
        grams = {(1, a) for a in w} | {(2, a, b) for a, b in zip(w, w[1:])} | {(3, a, b) for a, b in zip(w, w[2:])}
        assert len(toxicity.features(" ".join(w))) in (len(grams), len(grams) - 1)  # a chance meeting in 2**20
    assert (toxicity.features("One, two! three") == toxicity.features("one TWO (three)")).all()


def test_quality_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    x = {k: rng.normal(k, 1 + k, (400, quality.SIZE)) for k in (0, 1)}
    model = quality.discriminant({k: quality.Moments(len(v), v.sum(0), v.T @ v) for k, v in x.items()})
    raw = np.array([quality.statistics(f"Some words {k} and MORE, of them {k * 7}!") for k in range(600)])
    alone = [float(model.score(quality.transformed(raw[k:k + 1]))[0]) for k in range(600)]
    for size in (2, 7, 33, 512, 600):
        for at in (0, 1, 5):
            assert model.score(quality.transformed(raw[at:at + size])).tolist() == alone[at:at + size], size


def test_moments_equal_direct_sums(spark):
    """What Spark adds up, whatever the partitions, against numpy."""
    docs = table(spark, "documents").repartition(5)
    labels = table(spark, "labels").selectExpr("doc_id", "quality AS label")
    models = [quality.fit(quality.vectors(d).join(labels, "doc_id")) for d in (docs, docs.coalesce(1))]
    known = {r.doc_id: r.label for r in labels.collect()}
    rows = [(known[r.doc_id], r.text or "") for r in table(spark, "documents").collect() if r.doc_id in known]
    moments = {}
    for k in (0, 1):
        x = quality.transformed(np.array([quality.statistics(t) for y, t in rows if y == k]))
        moments[k] = quality.Moments(len(x), x.sum(0), x.T @ x)
    direct = quality.discriminant(moments)
    for a, b, c in zip(models[0].means + models[0].factors, models[1].means + models[1].factors, direct.means + direct.factors, strict=True):
        assert (a == b).all() and np.allclose(a, c, rtol=1e-3, atol=1e-3)


def test_labels_without_a_document_use_up_no_places(spark):
    docs = spark.createDataFrame([(i, "bad word here" if i < 3 else "all is fine") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3 or i > 100)) for i in [*range(9), *range(101, 400)]], "doc_id long, label int")
    present = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    assert toxicity.sample(present, 3).where(F.col("doc_id") < 9).count() == 9
    at, w, bias = toxicity.fit(docs, labels)
    assert np.isfinite(w).all() and np.isfinite(bias)
