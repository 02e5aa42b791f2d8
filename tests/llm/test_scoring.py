import pytest
from pyspark.sql import functions as F

from lexikv.llm import lm, toxicity
from tests.llm import brute
from tests.llm.conftest import make_docs, sentences


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_equals_brute_force(spark, odd_rows, odd_docs, order):
    out = lm.score_texts(odd_docs, toxicity.id_hash("doc_id", 7) == 2, lm.Settings(order=order, mu=3.0, block_bytes=40_000, bucket_keys=2000)).collect()
    key = lambda x: tuple((v is None, v) if not isinstance(v, float) else round(v, 5) for v in x)
    want = [(i, *x) for (i, _, _), x in zip(odd_rows, brute.lm([(i, t) for i, t, _ in odd_rows], 3.0, order), strict=True)]
    assert sorted(map(key, (tuple(r) for r in out))) == sorted(map(key, want))


def test_lm_without_training_rows(spark, no_docs):
    assert lm.score_texts(no_docs, F.lit(False)).count() == 0
    row = lm.score_texts(make_docs(spark, [(1, "a b", "s")]), F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_lm_probabilities_of_a_context_sum_to_one(spark):
    base = [(1, "a b a c", "s"), (2, "b a", "s"), (3, "c", "s")]
    texts = ["a", *(f"a {w}" for w in ["a", "b", "c", "zz"])]
    docs = make_docs(spark, [*base, *((100 + k, t, "s") for k, t in enumerate(texts)), *((200 + k, w, "s") for k, w in enumerate(["a", "b", "c", "zz"]))])
    s = lm.Settings(order=2, mu=2.0)
    score = {r.doc_id: 10**r.score for r in lm.score_texts(docs, F.col("doc_id") >= 100, s).collect()}
    p = brute_p([t for _, t, _ in base], 2.0)
    assert sum(p("<s>", w) for w in ["a", "b", "c", "zz", "</s>"]) == pytest.approx(1)
    assert sum(p("a", w) for w in ["a", "b", "c", "zz", "</s>"]) == pytest.approx(1)
    assert score[101] == pytest.approx(p("<s>", "a") * p("a", "a") * p("a", "</s>"))
    assert score[104] == pytest.approx(p("<s>", "a") * p("a", "zz") * p("zz", "</s>"))


def brute_p(texts, mu):
    """P(word | word before)."""
    from collections import Counter

    runs = [["<s>", *t.split(), "</s>"] for t in texts]
    one, two = Counter(x for r in runs for x in r), Counter(x for r in runs for x in zip(r, r[1:], strict=False))
    n = sum(v for k, v in one.items() if k != "<s>")
    unknown = (sum(v == 1 for k, v in one.items() if k != "<s>") + 1) / (n + 2)

    def p(u, v):
        lower = (1 - unknown) * one[v] / n if one[v] else unknown
        return (two[u, v] + mu * lower) / (one[u] + mu) if one[u] else lower

    return p


def _toxic_rows():
    rows = [(i, sentences(i, 40) + (" you vile toad" if i % 4 == 0 else "") + sentences(i + 999, 40), "s") for i in range(400)]
    return rows, [(i, 1 if i % 4 == 0 else 0) for i in range(400)]


def test_toxicity_finds_held_out_texts(spark):
    rows, marks = _toxic_rows()
    docs, labels = make_docs(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    held_out = toxicity.id_hash("doc_id", 4) == 2
    model = toxicity.train(docs, labels, held_out)
    assert 0 < len(model.at) < 2000
    out = toxicity.score(docs, model).select("doc_id", "score", "predicted", held_out.alias("held")).collect()
    right = [r.predicted == int(r.doc_id % 4 == 0) for r in out if r.held]
    assert len(right) > 50
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_toxicity_ignores_held_out_labels(spark):
    rows, marks = _toxic_rows()
    docs, held_out = make_docs(spark, rows), toxicity.id_hash("doc_id", 4) == 2
    flipped = [(i, 1 - y if brute.held_out(i, 4) else y) for i, y in marks]
    a, b = (toxicity.train(docs, spark.createDataFrame(m, "doc_id long, toxic int"), held_out) for m in (marks, flipped))
    assert a.bias == b.bias
    assert (a.weight == b.weight).all()


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, none, F.lit(False))
    assert {r.score for r in toxicity.score(odd_docs, model).collect()} == {0.5}
    labels = spark.createDataFrame([(40, 1), (41, 0), (None, 1), (1, None), (2, 1), (2, 0), (777, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels, F.lit(False))
    assert toxicity.score(odd_docs, model).count() == odd_docs.count()
    assert toxicity.score(no_docs, model).count() == 0


def plain_ftrl(examples, s):
    """FTRL-proximal over sets of coordinates, one number at a time."""
    import math
    from collections import defaultdict

    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else (math.copysign(s.l1, z[i]) - z[i]) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for at, y in examples:
            ws = {i: weight(i) for i in [*at, "bias"]}
            g = 1 / (1 + math.exp(-sum(ws.values()))) - y
            for i, w in ws.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w
                n[i] += g * g
    return {i: weight(i) for i in list(z) if weight(i)}


def test_toxicity_equals_plain_ftrl(spark):
    import numpy as np
    import pyarrow as pa

    rows, marks = _toxic_rows()
    s = toxicity.Settings(bits=12, l1=0.5)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    held_out = toxicity.id_hash("doc_id", 4) == 2
    model = toxicity.train(make_docs(spark, rows), labels, held_out, s)
    order = labels.filter(~held_out).select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h").collect()
    text = {i: t for i, t, _ in rows}
    examples = [(sorted(set(toxicity.features(pa.array([text[r.doc_id]]), s.bits)[0].tolist())), r.toxic) for r in order if r.doc_id in text]
    want = plain_ftrl(examples, s)
    assert model.bias == pytest.approx(want.pop("bias", 0.0))
    assert model.at.tolist() == sorted(want)
    assert np.allclose(model.weight, [want[i] for i in model.at.tolist()])


def test_toxicity_sample_bounds_rows_that_repeat_an_id(spark):
    docs = make_docs(spark, [(7, f"word{i}", "s") for i in range(200)])
    labels = spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    once, more = (toxicity.train(docs, labels, F.lit(False), toxicity.Settings(l1=0.0, epochs=1, sample_rows=k)) for k in (1, 50))
    assert len(once.at) == 1
    assert len(more.at) == 50
