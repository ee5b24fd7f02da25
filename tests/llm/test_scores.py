"""Quality and toxicity: held-out accuracy, and rows that are odd."""

import numpy as np
import pytest

from ashlar.llm import boosting, quality_mil, toxicity

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    up = y == 1
    return (order[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum())


@pytest.mark.parametrize(("query", "label", "least"), [(quality_mil.op1_attention_mil, "quality", 0.95), (toxicity.op10_boosted_toxicity, "toxic", 0.75)])
def test_held_out(spark, query, label, least):
    got = query(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got["score"].between(0, 1).all()
    y = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    y = y[y["held_out"]]
    assert auc(y["score"].to_numpy(), y[label].to_numpy()) >= least


@pytest.mark.parametrize("module", [quality_mil, toxicity])
def test_odd_rows(edge, none, labels, edge_rows, module):
    model = module.fit(edge, labels)
    got = module.score(edge, model).toPandas()
    assert len(got) == len(edge_rows)
    assert got.iloc[:, 1].between(0, 1).all()
    assert module.score(none, model).count() == 0
    empty = module.fit(none, labels.where("false"))
    assert (module.score(edge, empty).toPandas().iloc[:, 1] == 0.5).all()


def test_keep_clean(edge, labels, edge_rows):
    kept = toxicity.keep_clean(edge, toxicity.fit(edge, labels))
    assert kept.columns == edge.columns
    assert kept.count() <= len(edge_rows)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * s))).astype(float)
    f = boosting.Isotonic().fit(s, y)
    assert (np.diff(f(np.linspace(-3, 3, 200))) >= 0).all()


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = boosting.Calibrated().fit(x[:600], y[:600]).score(x[600:])
    assert ((p > 0.5) == (y[600:] > 0)).mean() > 0.9


def test_mil_finds_the_one_bad_passage():
    rng = np.random.default_rng(2)
    bags, y = [], []
    for i in range(300):
        b = rng.normal(size=(rng.integers(1, 9), 6))
        b[:, 0] = 0
        if i % 2:
            b[rng.integers(len(b)), 0] = 3
        bags.append(b)
        y.append(float(i % 2))
    y = np.array(y)
    model = quality_mil.AttentionMIL().fit(bags[:200], y[:200])
    assert ((model.score(bags[200:]) > 0.5) == (y[200:] > 0)).mean() > 0.95


def test_gradient_against_differences():
    """The gradient of the loss by every weight, against differences of the loss, whose forward pass is written out bag by bag."""
    rng = np.random.default_rng(4)
    m = quality_mil.AttentionMIL(hidden=5, attention=3, epochs=1)
    bags = [rng.normal(size=(n, 4)) for n in (1, 3, 2, 6)] * 6
    y = np.array([0.0, 1.0, 1.0, 0.0] * 6)
    m.fit(bags, y)
    x, starts, which = m._bags(bags)

    def loss():
        total, p = 0.0, m.p
        for i, s in enumerate(starts):
            rows = x[s : s + len(bags[i])]
            hid = np.tanh(rows @ p["W"] + p["b"])
            a = np.array([(np.tanh(r @ p["V"]) / (1 + np.exp(-(r @ p["U"])))) @ p["w"] for r in hid])
            a = np.exp(a) / np.exp(a).sum()
            q = 1 / (1 + np.exp(-((a[:, None] * hid).sum(0) @ p["c"] + p["e"][0])))
            total -= y[i] * np.log(q) + (1 - y[i]) * np.log(1 - q)
        return total / len(y)

    grad = m._gradient(x, starts, which, y)
    for k, v in m.p.items():
        for at in list(np.ndindex(v.shape))[:6]:
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-6 - grad[k][at]) < 1e-6


def test_isotonic_against_brute_force():
    """Each value is the greatest, over beginnings, of the least mean over endings; steps are then drawn a little from 0 and 1."""
    rng = np.random.default_rng(7)
    s = np.sort(rng.choice(1000, 40, replace=False)).astype(float)
    y = (rng.random(40) < s / 1000).astype(float)
    fit = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    got = boosting.Isotonic().fit(s, y)
    for i in range(40):
        alike = np.isclose(fit, fit[i])
        assert np.isclose(got.value[np.searchsorted(got.at, s[i])], (y[alike].sum() + 0.1) / (alike.sum() + 0.2))


def test_first_tree_against_brute_force():
    """The first split is the best of all pairs of feature and bound, its leaves Newton steps of the log loss."""
    rng = np.random.default_rng(9)
    x = np.round(rng.random((60, 3)), 1)
    y = (x[:, 1] + 0.3 * rng.random(60) > 0.6).astype(float)
    t = boosting.Trees(trees=1, depth=1, least=5, bins=64).fit(x, y)
    g, h = y.mean() - y, np.full(60, y.mean() * (1 - y.mean()))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max((gain(x[:, f] <= v) + gain(x[:, f] > v), -f) for f in range(3) for v in np.unique(x[:, f]) if 5 <= (x[:, f] <= v).sum() <= 55)
    f, v = t.made[0][0][0], t.made[0][0][1]
    left = x[:, f] <= v
    assert np.isclose(gain(left) + gain(~left), best[0])
    want = np.where(left, -0.15 * g[left].sum() / (h[left].sum() + 1), -0.15 * g[~left].sum() / (h[~left].sum() + 1))
    assert np.allclose(t.margin(x), np.log(y.mean() / (1 - y.mean())) + want)


def test_passages_of_texts_without_blanks():
    for text in ("\u3042" * 20_000, "x" * 9_000, "word " * 500 + "\u3042" * 5_000 + " word" * 500):
        got = quality_mil.passages(text)
        n = len(text.encode())
        assert n / (2.1 * quality_mil.PASSAGE) <= len(got) <= n / quality_mil.PASSAGE + 2
    assert len(quality_mil.fitted_on(quality_mil.passages("word and " * 90_000))) == quality_mil.FIT_PASSAGES


def test_one_text_of_an_id_is_learnt_from(spark):
    from ashlar.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for n in (1, 4):
        got = {r["doc_id"]: r["text"] for r in labelled_sample(docs.repartition(n), labels, "quality", 10, "s").collect()}
        assert got == {1: "", 2: "c"}


def test_lexicons_leave_their_fold_out(spark):
    """A term that only one fold's toxic texts have is not in the lexicon that this fold is scored with."""
    rows = [(f"bad{chr(97 + k) * 3} words here {i}" if i % 2 else f"plain words here {i}", i % 2, k) for k in range(toxicity.FOLDS) for i in range(60)]
    got = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, y int, fold int"), ())
    for k in range(toxicity.FOLDS):
        assert f"bad{chr(97 + k) * 3}" not in got[k] and f"bad{chr(97 + k) * 3}" in got[-1]
