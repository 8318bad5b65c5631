"""The parts of the language and toxicity models against brute force."""

from itertools import combinations

import numpy as np
import pytest

from captionloom.llm import language, toxicity


def best_likelihood(q, weight, members):
    """Largest log-likelihood of shares over ``members``, by many steps from several starts."""
    out = -np.inf
    for seed in range(3):
        pi = np.random.default_rng(seed).dirichlet(np.ones(len(members)) * 5)
        for _ in range(2000):
            joint = q[:, members] * pi
            pi = (joint / joint.sum(axis=1, keepdims=True) * weight[:, None]).sum(axis=0) / weight.sum()
        out = max(out, float((weight * np.log((q[:, members] * pi).sum(axis=1))).sum()))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_language_sets_are_those_of_best_penalised_likelihood(seed):
    rng = np.random.default_rng(seed)
    n_languages, penalty = 4, 3.0
    docs, first = [], []
    for _ in range(6):
        own = rng.choice(n_languages, rng.integers(1, 4), replace=False)
        rows = rng.integers(5, 60)
        q = rng.uniform(1e-4, 0.2, (rows, n_languages))
        q[np.arange(rows), rng.choice(own, rows)] = 1.0
        first.append(sum(len(d) for d, _ in docs))
        docs.append((q, rng.integers(1, 4, rows).astype(float)))
    got = language.mixtures(np.vstack([q for q, _ in docs]), np.concatenate([w for _, w in docs]), np.array(first), penalty)
    for (q, weight), shares in zip(docs, got, strict=True):
        n = weight.sum()
        values = {m: best_likelihood(q, weight, list(m)) - penalty * (len(m) - 1) * 0.5 * np.log(n + 1)
                  for size in range(1, n_languages + 1) for m in combinations(range(n_languages), size)}
        chosen = tuple(np.flatnonzero(shares > 0).tolist())
        assert shares.sum() == pytest.approx(1, abs=0.01)
        assert values[chosen] >= max(values.values()) - 0.3, (chosen, max(values, key=values.get))


def sample(n=90, seed=2):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(["one", "two", "six", "bad" if k % 3 == 0 else "good", "vile" if k % 4 == 0 else "kind"], 8)) for k in range(n)]
    labels = np.array([[float(k % 3 == 0), float(k % 3 == 0 or k % 4 == 0)] for k in range(n)])
    labels[rng.choice(n, 15, replace=False), 0] = np.nan
    return texts, labels, np.arange(n) // 5 % 3


def test_linear_model_is_the_minimum_of_its_loss():
    """Against gradient descent of another kind, on dense features and without the code's own gradient."""
    texts, labels, _ = sample()
    y, use = labels[:, 1], np.arange(len(texts)) % 7 != 0
    extra = np.random.default_rng(0).normal(size=(len(texts), 1))
    feats = toxicity.features_of_all(texts)
    w, e, b = toxicity.fit_linear(feats, extra, y, use, l2=1.0, steps=400)
    columns = np.unique(np.flatnonzero(w))
    dense = np.zeros((len(texts), len(columns)))
    for j, c in enumerate(columns):
        one = np.zeros(toxicity.DIMS, np.float32)
        one[c] = 1
        dense[:, j] = toxicity.raw_scores(one, len(texts), *feats)
    x = np.hstack([dense, extra, np.ones((len(texts), 1))])[use]

    def loss(v):
        z = x @ v
        return np.logaddexp(0, np.where(y[use] > 0, -z, z)).sum() + 0.5 * (v[:-1] @ v[:-1])

    v = np.concatenate([w[columns], e, [b]])
    for _ in range(60):  # Newton's steps to the minimum
        p = 1 / (1 + np.exp(-x @ v))
        ridge = np.append(np.ones(len(v) - 1), 0)
        v = v - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-9), x.T @ (p - y[use]) + ridge * v)
    found = loss(np.concatenate([w[columns], e, [b]]))
    assert found <= loss(v) + 1e-3 * abs(loss(v))


def test_later_models_learn_from_models_that_have_not_seen_the_row(monkeypatch):
    texts, labels, folds = sample()
    feats, calls, fit = toxicity.features_of_all(texts), [], toxicity.fit_linear

    def spy(feats, extra, y, use, *rest):
        out = fit(feats, extra, y, use, *rest)
        calls.append((extra.copy(), use.copy(), out))
        return out

    monkeypatch.setattr(toxicity, "fit_linear", spy)
    chain = toxicity.fit_chain(texts, labels, ["first", "second"], folds)
    assert len(calls) == 8
    known = ~np.isnan(labels)
    for k in (0, 1):
        for f in (0, 1, 2):
            assert (calls[4 * k + f][1] == (known[:, k] & (folds != f))).all()
        assert (calls[4 * k + 3][1] == known[:, k]).all()
    out = np.zeros(len(texts))
    for f in (0, 1, 2):
        w, _, b = calls[f][2]
        out[folds == f] = toxicity.sigmoid(toxicity.raw_scores(w, len(texts), *feats) + b)[folds == f]
    for extra, _, _ in calls[4:]:
        assert extra[:, 0] == pytest.approx(out)
    assert [link.name for link in chain.links] == ["first", "second"] and len(chain.links[1].earlier) == 1
    p = toxicity.probabilities(texts, chain)
    z = toxicity.raw_scores(chain.links[1].weights, len(texts), *feats) + p[:, :1] @ chain.links[1].earlier + chain.links[1].bias
    assert p[:, 1] == pytest.approx(toxicity.sigmoid(z))
