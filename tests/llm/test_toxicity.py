"""The convolutional classifier against slow versions of its parts."""

import numpy as np
import pytest

from framewright.llm import toxicity as tx

TEXTS = ["one two three two one", "Word", None, "", "déjà vu déjà vu vu", "some longer words repeated longer words and a few more of them", "a b"]


def slow_response(model, text, width, k):
    """The greatest response of one filter over the windows of a text that is padded with three null words."""
    words = [w for w in tx._word(text.lower())] if text else []
    vec = [sum(model.emb[b] for b in tx.word_ids(w)) for w in words] + [np.zeros(tx.DIM)] * max(tx.WIDTHS)
    conv = model.conv[tx.WIDTHS.index(width)]
    return max(sum(float(vec[i + j] @ conv[j][:, k]) for j in range(width)) for i in range(len(vec) - width + 1))


def test_pooling_equals_a_slow_convolution():
    model = tx.ToxicityModel()
    model.bias = np.random.default_rng(0).standard_normal(len(model.bias)).astype(np.float32)
    got = model.features(TEXTS)
    for i, t in enumerate(TEXTS):
        for c, w in enumerate(tx.WIDTHS):
            for k in (0, 7, 15):
                at = c * tx.FILTERS + k
                assert got[i, at] == pytest.approx(slow_response(model, t, w, k) + model.bias[at], abs=1e-4)


def test_gradients_equal_finite_differences():
    r = np.random.default_rng(1)
    model = tx.ToxicityModel()
    model.out, model.bias = (r.standard_normal(len(model.out)).astype(np.float32) for _ in range(2))
    buckets, seq, starts = tx._encode(TEXTS)
    y, weight = np.array([1, 0, 0, 1, 1, 0, 1], np.float32), np.linspace(0.5, 1.5, 7).astype(np.float32)
    _, g, de = model.gradients(buckets, seq, starts, y, weight)

    def slope(array, at):
        old, loss = array[at], []
        for step in (2e-3, -2e-3):
            array[at] = old + step
            loss.append(model.gradients(buckets, seq, starts, y, weight)[0])
        array[at] = old
        return (loss[0] - loss[1]) / 4e-3

    for name, p in [("out", model.out), ("bias", model.bias), *((f"c{i}", c) for i, c in enumerate(model.conv))]:
        for _ in range(6):
            at = tuple(int(r.integers(n)) for n in p.shape)
            assert g[name][at] == pytest.approx(slope(p, at), rel=0.05, abs=2e-3), (name, at)
    for word in range(1, 5):
        own = buckets[word][0]
        assert (buckets == own).sum() == 1
        assert de[word][3] == pytest.approx(slope(model.emb, (own, 3)), rel=0.05, abs=2e-3)


def test_the_best_threshold_is_the_best():
    r = np.random.default_rng(2)
    for _ in range(30):
        z, y = np.round(r.standard_normal(40), 1), (r.random(40) < 0.3).astype(float)
        if not y.any():
            continue
        f1 = lambda t: 2 * ((z > t) & (y > 0)).sum() / ((z > t).sum() + y.sum())  # noqa: E731, B023
        assert f1(tx._best_threshold(z, y)) == pytest.approx(max(f1(t) for t in [*z, z.min() - 1]))
