"""Weak labels: estimated accuracies, held-out accuracy of the scorer, odd rows."""

import numpy as np

from textloom.llm import queries, weak_labels


def test_estimated_accuracies_are_near_the_true_ones():
    draw = np.random.default_rng(1)
    n, k = 40_000, len(weak_labels.LABELLERS)
    good = draw.random(n) < 0.8
    right = draw.uniform(0.75, 0.95, k)
    votes = np.empty((n, k), int)
    for j in range(k):
        own = np.where(draw.random(n) < right[j], good, ~good)
        votes[:, j] = np.where(draw.random(n) < 0.3, weak_labels.SILENT, own.astype(int))
    patterns = votes @ 3 ** np.arange(k - 1, -1, -1)
    names, counts = np.unique(patterns, return_counts=True)
    assert (weak_labels.unpacked(names)[np.searchsorted(names, patterns)] == votes).all()
    model = weak_labels.estimate(names, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.02
    for kind, own in ((weak_labels.GOOD, weak_labels.GOOD), (weak_labels.POOR, weak_labels.POOR)):
        assert np.abs(model.of_votes[:, kind, own] / 0.7 - right).max() < 0.04
    said = model.posterior(patterns) > 0.5
    assert (said == good).mean() > 0.97


def test_counts_alone_matter():
    patterns, counts = np.array([0, 5, 9_000]), np.array([3.0, 4.0, 50.0])
    a = weak_labels.estimate(patterns, counts)
    b = weak_labels.estimate(np.repeat(patterns, 2), np.repeat(counts / 2, 2))
    assert np.allclose(a.posterior(patterns), b.posterior(patterns))


def test_shapes():
    assert weak_labels._shape(b"Hello") == b"Xx"
    assert weak_labels._shape("élan,".encode()) == b"x,"
    assert weak_labels._shape(b"A1-22!!") == b"X9-9!"


def held_out(spark, folder, share):
    folder = folder.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("doc_id % 2 = 1")
    model = weak_labels.fit(docs.filter("doc_id % 2 = 0"))
    judged, out = weak_labels.judge(docs.join(labels, "doc_id"), model)
    return judged.select("quality", f"{out}.*").collect()


def test_scores_on_held_out_documents(spark, folder):
    rows = held_out(spark, folder, 2)
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.95
    assert sum((r.posterior > 0.5) == (r.quality == 1) for r in rows if r.posterior is not None) / len(rows) > 0.95


def test_odd_rows(spark):
    good = " ".join(f"word{k % 97} some{k}" for k in range(150))
    rows = [(1, good), (1, good), (2, None), (3, ""), (None, good), (4, "### " * 900), (5, "x" * 200_000), (6, "A B C")]
    docs = spark.createDataFrame([(*r, "z", 0) for r in rows], "doc_id long, text string, statistics string, judged int")
    model = weak_labels.fit(docs)
    found, out = weak_labels.judge(docs, model)
    got = found.select("doc_id", f"{out}.*").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert not any(r.kept for r in got if r.doc_id in (2, 3))
    assert len({(r.score, r.posterior) for r in got if r.doc_id in (1, None)}) == 1
    again = weak_labels.fit(docs)
    assert (again.scorer.weights == model.scorer.weights).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found, _ = weak_labels.judge(docs, weak_labels.fit(docs))
    assert found.count() == 0


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = queries.op5_weak_labels(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert all(r.kept == (r.score >= 0.5) for r in rows)


def test_estimation_over_counts_equals_plain_estimation_over_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stats = weak_labels.fresh(docs, "statistics")
    voted = docs.withColumn(stats, weak_labels.text_statistics("text")).select(weak_labels.pattern(stats).alias("p"))
    k = len(weak_labels.LABELLERS)
    rows = [[r.p // 3 ** (k - 1 - j) % 3 for j in range(k)] for r in voted.collect()]
    good = []
    for votes in rows:
        poor = votes.count(weak_labels.POOR)
        good.append(0.5 ** (2 * poor) if poor else 0.95 if weak_labels.GOOD in votes else 0.5)
    for _ in range(200):
        prior = (sum(good) + 1) / (len(rows) + 2)
        table = [[[1.0] * 3 for _ in range(2)] for _ in range(k)]
        for votes, g in zip(rows, good):
            for j, v in enumerate(votes):
                table[j][weak_labels.GOOD][v] += g
                table[j][weak_labels.POOR][v] += 1 - g
        table = [[[x / sum(kind) for x in kind] for kind in own] for own in table]
        now = []
        for votes in rows:
            yes, no = prior, 1 - prior
            for j, v in enumerate(votes):
                yes *= table[j][weak_labels.GOOD][v]
                no *= table[j][weak_labels.POOR][v]
            now.append(yes / (yes + no))
        moved, good = max(abs(a - b) for a, b in zip(now, good)), now
        if moved < 1e-9:
            break
    model = weak_labels.fit(docs)
    patterns = [sum(v * 3 ** (k - 1 - j) for j, v in enumerate(votes)) for votes in rows]
    assert np.allclose([model.posteriors[p] for p in patterns], good, atol=1e-6)
    assert abs(model.accuracies.prior - prior) < 1e-6


def test_the_sample_is_bounded_where_rows_share_an_id(spark, monkeypatch):
    rows = [(None, f"null {k}") for k in range(2000)] + [(7, f"seven {k}") for k in range(2000)] + [(8, "same")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    taken = []
    train = weak_labels.train
    monkeypatch.setattr(weak_labels, "train", lambda made, good: (taken.append(len(made)), train(made, good))[1])
    weak_labels.fit(docs, sample_rows=300)
    assert 100 <= taken[0] <= 400
