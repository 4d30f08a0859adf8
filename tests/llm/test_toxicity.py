"""Ordered thresholds, gradients by what the fit reaches, and held-out accuracy."""

from __future__ import annotations

import random

import numpy as np

from bibliospark.llm import toxicity
from tests.llm.samples import no_documents, odd_documents, odd_rows

FOLDER = "/root/testdata/sf0.1"


def made(n: int, seed: int) -> list[tuple[int, str, int]]:
    """Clean texts, and toxic ones with one to four bad words."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}abc" for _ in range(rng.randrange(10, 60))]
        bad = rng.randrange(1, 5) if i % 5 == 0 else 0
        words += rng.choices(["vile", "foul", "rotten"], k=bad)
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad > 0)))
    return rows


def test_held_out_accuracy_and_graded_output(spark):
    rows = made(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:400]], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.grade_documents(docs, labels).collect()}
    held_out = rows[400:]
    assert np.mean([got[i].rejected == bool(y) for i, _, y in held_out]) > 0.97
    by_count = [np.mean([got[i].severity for i, t, _ in held_out if sum(w in t for w in ("vile", "foul", "rotten")) == k]) for k in (0, 1, 3)]
    assert by_count == sorted(by_count)
    assert all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in got.values())
    again = {r.doc_id: r.severity for r in toxicity.grade_documents(docs.repartition(3), labels).collect()}
    assert again == {i: r.severity for i, r in got.items()}


def test_given_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    fit, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    scored = toxicity.grade_documents(docs, fit).join(rest, "doc_id").toPandas()
    found = scored[scored.rejected]
    assert (found.toxic == 1).mean() > 0.9
    assert (scored[scored.toxic == 1].rejected).mean() > 0.8
    assert (scored[scored.toxic == 0].rejected).mean() < 0.02


def test_thresholds_are_ordered_and_shared():
    rows = made(300, 2)
    encoder = toxicity.Features()
    features = [encoder.of(t) for _, t, _ in rows]
    sizes = np.array([len(f) for f in features])
    slots = np.array([s for f in features for s in f])
    counts = np.array([c for f in features for c in f.values()])
    sample = toxicity.Sample.of(sizes, slots, counts, np.array([y for *_, y in rows]))
    grades = toxicity.grade(sample)
    assert set(grades) == {0, 1, 2} and ((grades > 0) == sample.toxic).all()
    model = toxicity.fit(sample, grades)
    assert (np.diff(model.thresholds) > 0).all() and len(model.slots) == len(model.weights)


def test_odd_documents_and_no_labels(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.grade_documents(docs, none).collect()
    assert len(rows) == len(odd_rows()) and not any(r.rejected for r in rows)
    assert toxicity.grade_documents(no_documents(spark), none).count() == 0


def test_the_fit_is_a_maximum_of_the_plain_likelihood():
    rng = np.random.default_rng(5)
    n, width = 400, 5
    dense = rng.integers(0, 4, (n, width))
    truth = np.array([1.5, -1.0, 0.8, 0.0, 1.2])
    latent = np.log1p(dense) @ truth + rng.logistic(size=n)
    grades = (latent > 1.5).astype(int) + (latent > 3.0)
    rows, columns = np.nonzero(dense)
    sample = toxicity.Sample.of((dense > 0).sum(axis=1), columns, dense[rows, columns], grades > 0)
    model = toxicity.fit(sample, grades, steps=4_000)
    used = np.log1p(dense[:, model.slots].astype(float))

    def loss(theta):
        w, cuts = theta[: len(model.slots)], theta[len(model.slots) :]
        total = 0.0
        for x, g in zip(used @ w, grades):
            above = [1.0, *(1 / (1 + np.exp(c - x)) for c in cuts), 0.0]
            total -= np.log(above[g] - above[g + 1])
        return (total + 0.05 * (w**2).sum()) / n

    theta = np.concatenate([model.weights, model.thresholds])
    step = 1e-4
    gradient = [(loss(theta + step * e) - loss(theta - step * e)) / (2 * step) for e in np.eye(len(theta))]
    assert len(model.slots) >= 3 and np.abs(gradient).max() < 5e-3
    assert loss(theta) < min(loss(theta + rng.normal(size=len(theta)) * 0.1) for _ in range(20))


def test_keeping_clean_rows_leaves_all_columns(spark):
    rows = made(200, 3)
    names = "severity grade rejected toxic_probability _s".split()
    docs = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in names]) for i, t, _ in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and 100 < kept.count() < 200
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}


def test_the_bound_holds_where_one_id_has_many_rows(spark):
    rows = made(200, 4)
    docs = [(i, t) for i, t, _ in rows] + [(3, "the same words")] * 300 + [(3, f"words of {i}") for i in range(300)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2, "doc_id long, toxic int")
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    whole = toxicity.sample_labelled(docs, labels)
    assert len(whole.toxic) == 200 + 1 + 300
    assert len(toxicity.sample_labelled(docs, labels, max_rows=150).toxic) <= 150
    few = toxicity.sample_labelled(docs.where("doc_id = 3"), labels, max_rows=200)
    assert len(few.toxic) == 200


def test_the_driver_gets_only_the_features_that_tell_and_fits_the_same(spark):
    rows = made(400, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sample = toxicity.sample_labelled(docs, labels)
    encoder = toxicity.Features()
    features = [encoder.of(t) for _, t, _ in rows]
    slots = np.array([s for f in features for s in f])
    toxic = np.array([y for *_, y in rows]) > 0
    at = np.repeat(np.arange(len(rows)), [len(f) for f in features])
    chosen = toxicity.screen(at, slots, toxic)
    assert 0 < len(chosen) < len(set(slots.tolist())) and sample.chosen.tolist() == chosen.tolist()
    assert len(sample.toxic) == 400 and sample.toxic.sum() == toxic.sum()
    assert len(sample.slots) == np.isin(slots, chosen).sum() and set(sample.slots.tolist()) <= set(chosen.tolist())
    whole = toxicity.Sample.of(np.array([len(f) for f in features]), slots, np.array([c for f in features for c in f.values()]), toxic)
    one, other = toxicity.fit(sample, toxicity.grade(sample)), toxicity.fit(whole, toxicity.grade(whole))
    assert one.slots.tolist() == other.slots.tolist()
    assert np.allclose(one.weights, other.weights) and np.allclose(one.thresholds, other.thresholds)
