"""Classifier chains: accuracy on documents not learned from, and defined results for odd input."""

import numpy as np
from rillflow.llm import toxicity_chain as module
from rillflow.llm.toxicity_chain import design, features, fit, fit_chain, toxicity

DOCS = "doc_id long, text string, quality string, junk int, words string"
LABELS = "doc_id long, quality int, toxic int, text string"


def test_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    train = labels.where("doc_id % 3 <> 0")
    got = {r.doc_id: r.p_toxic >= 0.5 for r in toxicity(docs, train).collect()}
    assert set(got) == set(texts)
    test = [i for i in toxic if i % 3 == 0]
    assert not any(got[i] for i in test if not toxic[i])
    assert sum(got[i] for i in test if toxic[i]) >= 0.75 * sum(toxic[i] for i in test)


def solved(x, y, ridge):
    """The least loss by plain gradient steps, without Newton's curvature."""
    w, rate = np.zeros(x.shape[1]), 4 / (np.linalg.norm(x, 2) ** 2 + 4 * ridge)
    weight = np.r_[np.full(x.shape[1] - 1, ridge), 0]
    for _ in range(60_000):
        w -= rate * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + weight * w)
    return w


def test_fit_is_the_least_loss():
    rng = np.random.default_rng(1)
    docs = [{f"w{j}" for j in rng.choice(12, 4, replace=False)} for _ in range(200)]
    inputs = rng.random((200, 2))
    y = (rng.random(200) < 1 / (1 + np.exp(2 - 4 * inputs[:, 0] - np.array(["w3" in d for d in docs])))).astype(float)
    model = fit(docs, inputs, y, 8)
    assert len(model.words) == 8 and model.dense[0] > 1
    want = solved(design(docs, model.words, inputs), y, module.RIDGE)
    assert np.allclose(np.r_[model.weights, model.dense, model.bias], want, atol=1e-4)


def test_later_models_see_out_of_fold_probabilities(monkeypatch):
    """The second category follows the first where no word of the document says so."""
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for _ in range(600):
        signs = {f"s{j}" for j in range(40) if rng.random() < 0.5}
        a = len(signs) + rng.normal() > 20.5
        docs.append(signs)
        labels.append([float(a), float(a if rng.random() < 0.9 else rng.random() < 0.5)])
    labels, folds, seen = np.array(labels), np.arange(600) % 4, []
    monkeypatch.setattr(module, "FEATURES", (40,))
    monkeypatch.setattr(module, "fit", lambda d, x, y, most: seen.append(x) or fit(d, x, y, 40 if not x.shape[1] else 5))
    chain = fit_chain(docs, labels, folds)
    assert chain[1].dense.shape == (1,) and chain[1].dense[0] > 0        # it leans on the earlier category
    given = seen[-1][:, 0]
    for fold in range(4):
        rest = np.flatnonzero(folds != fold)
        model = fit([docs[i] for i in rest], np.zeros((450, 0)), labels[rest, 0], 40)
        own = np.flatnonzero(folds == fold)
        assert np.allclose(given[own], [1 / (1 + np.exp(-model.logit(docs[i], np.zeros(0)))) for i in own])


def test_one_row_of_each_labelled_id(spark):
    """Copies of a labelled document weigh nothing and bring nothing to the driver."""
    docs = [(i, "you idiot" if i % 2 else "fine day") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, i % 2, "z") for i in range(40)], LABELS)
    plain, repeated = (spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)
                       for rows in (docs, docs + docs[:1] * 3000))
    want = {r.doc_id: r.p_toxic for r in toxicity(plain, labels).collect()}
    got = toxicity(repeated, labels).collect()
    assert len(got) == 3040 and all(r.p_toxic == want[r.doc_id] for r in got)


def test_odd_rows(spark):
    docs = [(i, "you idiot" if i % 2 else "fine day") for i in range(40)]
    docs += [(50, None), (51, ""), (None, "you idiot"), (52, "idiot " + "x " * 50_000), (1, "you idiot"), (53, "FINE " * 9)]
    labels = [(i, 1, i % 2) for i in range(40)] + [(None, 0, 1), (1, None, None), (2, 1, None), (99, 0, 1)]
    d = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], DOCS)
    got = toxicity(d, spark.createDataFrame([(*r, "z") for r in labels], LABELS)).collect()
    assert len(got) == len(docs) and all(0 <= p <= 1 for r in got for p in r[1:])
    assert [r.p_toxic > 0.5 for r in got if r.doc_id in (None, 1, 3, 52)] == [True] * 5
    assert not any(r.p_toxic > 0.5 for r in got if r.doc_id in (50, 51, 53, 0, 2))
    assert {r.p_toxic_junk for r in got} == {0.0}                        # one label everywhere


def test_no_labels_no_documents(spark):
    none = spark.createDataFrame([], LABELS)
    docs = spark.createDataFrame([(1, "text", "x", 1, "y")], DOCS)
    assert [tuple(r) for r in toxicity(docs, none).collect()] == [(1, 0.0, 0.0, 0.0)]
    assert toxicity(docs.limit(0), none).count() == 0


def test_features():
    assert features(None) == features("") == {"=empty"}
    assert features("Achlich achliche achlicher b") == {"achlich", "achliche", "achlicher", "b", "^achlic", "^achlich"}
    assert features("AAA bbb") == {"aaa", "bbb", "=upper"} and "=symbols" in features("a### b###")
