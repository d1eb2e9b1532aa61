"""The tagger's quick parts against plain ones."""

import numpy as np

from framewright.llm import pii


def test_quick_tanh_is_tanh():
    x = np.concatenate([np.linspace(-20, 20, 4001), [0.0, 1e-6, -1e-6]]).astype(np.float32).reshape(4, -1)
    got = pii.fast_tanh()(x.copy())
    assert got.shape == x.shape and np.abs(got - np.tanh(x.astype(np.float64))).max() < 1e-6


def test_stretches_of_unlike_lengths_are_not_decoded_together(monkeypatch):
    seen, plain = [], pii.Tagger.decode
    monkeypatch.setattr(pii.Tagger, "decode", lambda self, e: seen.append(e.shape[:2]) or plain(self, e))
    m, out = pii.Tagger(), [[]]
    m._decode([(0, k, np.zeros((n, pii.TAGS), np.float32)) for k, n in enumerate([3, 5, 600, 4, 650])], out)
    assert sum(n * length for n, length in seen) < 1400 and sorted(len(t) for _, t, _ in out[0]) == [3, 4, 5, 600, 650]
