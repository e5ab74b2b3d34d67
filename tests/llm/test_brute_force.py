"""Models and packing against plain versions: gradients by differences, chains link by link, packs one piece after the other."""

import random
from collections import Counter

import numpy as np

from tramline.llm import packing, quality, toxicity


def one_by_one(lengths, size):
    """Rooms left when each piece, longest first, goes into the pack with most room, or a new one."""
    room = []
    for n in sorted(lengths, reverse=True):
        i = max(range(len(room)), key=room.__getitem__, default=None)
        if i is None or room[i] < n:
            room.append(size - n)
        else:
            room[i] -= n
    return Counter(room)


def test_patterns_are_shortest_pack_first():
    r = random.Random(10)
    for case in range(60):
        size = r.choice([16, 64, 100])
        some = r.sample(range(1, size + 1), r.randint(1, min(size, 25)))
        counts = {n: r.choice([1, 2, 3, 7, 40]) for n in some}
        got = Counter()
        for n, pack in packing.patterns(counts, size):
            used = 0
            while pack:
                used, pack = used + pack[0], pack[1]
            got[size - used] += n
        assert got == one_by_one([n for n, k in counts.items() for _ in range(k)], size), (case, counts)


def test_padding_is_little():
    """Lengths as those of texts: many short ones, full pieces, some in between."""
    r = np.random.default_rng(4)
    lengths = np.minimum(np.maximum(r.lognormal(6, 1.1, 20_000).astype(int), 1), 4096)
    packs = sum(n for n, _ in packing.patterns(dict(Counter(lengths.tolist())), 4096))
    assert packs <= 1.01 * lengths.sum() / 4096


def numeric(f, p, step=1e-5):
    return np.array([(f(p + d) - f(p - d)) / (2 * step) for d in np.eye(len(p)) * step])


def descended(f, p, steps=4000):
    """Plain descent by numeric gradients with a step that halves when it does not help."""
    rate, now = 1.0, f(p)
    for _ in range(steps):
        g = numeric(f, p)
        while rate > 1e-9 and (new := f(p - rate * g)) > now - 1e-4 * rate * (g @ g):
            rate /= 2
        if rate <= 1e-9 or np.abs(g).max() < 1e-7:
            return p
        p, now, rate = p - rate * g, new, rate * 2
    return p


def test_ordinal_fit_is_the_likeliest():
    """Four grades, five features: thresholds and weights of a direct fit of the cumulative-link likelihood; and its gradient is nothing there."""
    r = np.random.default_rng(6)
    n, size, ridge = 400, 5, 1e-2
    x = r.random((n, size)) * (r.random((n, size)) < 0.7)
    y = np.digitize(x @ [3, -2, 1, 0, 4] + r.logistic(size=n), [0.5, 2.0, 4.0])
    row, col = np.nonzero(x)
    got = quality.fit(row, col, x[row, col], y.astype(float), size, steps=6000, ridge=ridge, rate=0.02)

    def loss(p):
        w, cut = p[:size], np.cumsum(np.r_[p[size], np.exp(p[size + 1 :])])
        below = np.column_stack([np.zeros(n), 1 / (1 + np.exp(-(cut[None, :] - (x @ w)[:, None]))), np.ones(n)])
        return -np.log(below[np.arange(n), y + 1] - below[np.arange(n), y]).mean() + ridge / 2 * (w @ w)

    own = np.r_[got.weights, got.thresholds[0], np.log(np.diff(got.thresholds))]
    assert np.abs(numeric(loss, own)).max() < 1e-4
    want = descended(loss, np.r_[np.zeros(size), -1.0, 0.0, 0.0])
    assert np.allclose(own, want, atol=2e-3)
    score = x @ got.weights
    chance = got.chances(score)
    assert np.allclose(chance.sum(axis=1), 1) and abs((chance @ got.grades).mean() - y.mean()) < 0.02


def texts(seed, n, words=12):
    """Rows of words, each word once; words 0 and 1 tell of the first category, 2 of the second."""
    r = np.random.default_rng(seed)
    has = r.random((n, words)) < 0.35
    a = (has[:, 0] | has[:, 1]) ^ (r.random(n) < 0.05)
    b = (has[:, 2] & ~a) ^ (r.random(n) < 0.05)
    return has, np.column_stack([a, b, a | b]).astype(float)


def test_linear_fit_is_the_likeliest():
    has, y = texts(1, 500)
    row, key = np.nonzero(has)
    before = np.column_stack([np.sin(np.arange(500))])
    m = toxicity.fit(row, key.astype(np.uint64), before, y[:, 0], steps=8000, rate=0.01)
    x = has[:, m.keys.astype(int)].astype(float)
    k = x.shape[1]
    assert 0 < k < 12 and {0, 1} <= set(m.keys.tolist())  # words without a clear link are left out

    def loss(p):
        z = x @ p[:k] + before @ p[k:-1] + p[-1]
        return (np.logaddexp(0, z) - y[:, 0] * z).mean() + 1e-3 / 2 * (0.02 * (p[:k] @ p[:k]) + p[k:-1] @ p[k:-1])

    own = np.r_[m.weights, m.chain, m.bias]
    assert np.abs(numeric(loss, own)).max() < 1e-4
    assert loss(own) <= loss(descended(loss, np.zeros(k + 2), 3000)) + 1e-6


def test_a_chain_is_its_links_one_after_the_other():
    """Each link is fitted on the odds that models of the other folds gave for the links before it, and scores on those of the whole models."""
    has, y = texts(2, 300)
    row, key = np.nonzero(has)
    key = key.astype(np.uint64)
    got = toxicity.fit_chain(row, key, y, folds=4)
    fold, before = np.arange(300) % 4, np.zeros((300, 0))
    for j in range(3):
        want = toxicity.fit(row, key, before, y[:, j])
        assert (got[j].keys == want.keys).all() and np.allclose(got[j].weights, want.weights) and np.allclose(got[j].chain, want.chain) and len(got[j].chain) == j
        odds = np.zeros(300)
        for i in range(300):  # one text after the other, by the model that has not seen its fold
            if i < 4:
                rest = np.flatnonzero(fold != fold[i])
                r, k = np.nonzero(has[rest])
                others = toxicity.fit(r, k.astype(np.uint64), before[rest], y[rest, j])
                for t in np.flatnonzero(fold == fold[i]):
                    weight = sum(w for w, c in zip(others.weights, others.keys, strict=True) if has[t, int(c)])
                    odds[t] = np.clip(others.bias + weight + before[t] @ others.chain, -12, 12)
        before = np.column_stack([before, odds])
    out = np.zeros((300, 0))
    for m in got:
        out = np.column_stack([out, m.odds(row, key, out)])
    assert ((out[:, 2] > 0) == (y[:, 2] > 0)).mean() > 0.9
