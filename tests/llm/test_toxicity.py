import random
import zlib

import numpy as np

from flowloom.llm.toxicity import Fit, drop_toxic, fit, hashed, risk, score, train


def corpus(spark):
    r = random.Random(6)
    words = [f"w{r.randrange(10**6)}" for _ in range(800)]
    docs, labels, truth = [], [], {}
    for i in range(1500):
        text = [r.choice(words) for _ in range(r.randrange(20, 80))]
        truth[i] = int(r.random() < 0.12)
        if truth[i]:
            for _ in range(r.randrange(2, 5)):
                text.insert(r.randrange(len(text)), r.choice(["vile", "nasty!", "AWFUL", "horrid", "fouls"]))
        docs.append((i, " ".join(text)))
        labels.append((i, truth[i]))
    docs += [(None, "w1 vile nasty awful"), (2000, None), (2001, ""), (2002, "x " * 400_000), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, 0.5, 1) for d in docs], "doc_id long, text string, score double, predicted int").repartition(4)
    return docs, df, spark.createDataFrame([*labels, (None, 1), (3, None), (4, truth[4])], "doc_id long, toxic int"), truth


def test_held_out_accuracy_and_edges(spark):
    docs, df, labels, truth = corpus(spark)
    model = fit(df, labels)
    got = score(df, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 2000]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held) and not [r for r in got if r.doc_id is None][0].held_out
    hits = np.mean([r.predicted for r in held if truth[r.doc_id]])
    wrong = np.mean([r.predicted for r in held if not truth[r.doc_id]])
    assert hits > 0.9 and wrong < 0.02, (hits, wrong)
    kept = drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in got)


def test_labels_that_may_not_be_used_change_nothing(spark):
    _, df, labels, _ = corpus(spark)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a, b = fit(df, labels, Fit(steps=50)), fit(df, flipped, Fit(steps=50))
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)


def test_the_fit_lowers_the_risk():
    """The risk by plain sums, and the model against that of no features and against nearby weights."""
    r = random.Random(3)
    prose = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    toxic = [prose(30) + " vile nasty" for _ in range(120)]
    other = [prose(30) + (" vile nasty" if i % 10 == 0 else "") for i in range(900)]
    sets = lambda texts: [np.unique(np.concatenate(list(hashed(t)))) for t in texts]
    logit = lambda p: np.log(p / (1 - p))
    model = train(sets(toxic), sets(other), 0.1, Fit())
    p, u = logit(model.scores(toxic)), logit(model.scores(other))
    log1p = lambda s: float(np.log(1 + np.exp(s)))
    plain = 0.1 * sum(log1p(-s) for s in p) / len(p) + max(0, sum(log1p(s) for s in u) / len(u) - 0.1 * sum(log1p(s) for s in p) / len(p))
    assert abs(plain - risk(p, u, 0.1)) < 1e-9
    assert risk(p, u, 0.1) < 0.5 * risk(np.full(len(p), logit(0.1)), np.full(len(u), logit(0.1)), 0.1)
    assert model.scores([toxic[0]])[0] > 0.7 > model.scores([other[1]])[0]


def test_without_examples(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in score(df, fit(df, none)).collect()] == [0]
    assert score(df.limit(0), fit(df.limit(0), none)).count() == 0
