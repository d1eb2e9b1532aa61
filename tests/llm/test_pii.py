"""The tagger against slow versions of its parts."""

import numpy as np
import pytest

from framewright.llm import pii

TEXTS = [
    "call +1 (269) 555-3296 or write to ab.cd@mail.example.com " * 4,
    "reach jane.roe (at) post (dot) org, please, or 10 . 2 . 3 . 4",
    "",
    "x",
    "nothing to see in these words " * 60,
    "9" * 700 + " a@b.example.com " + "é" * 300,
    "10.1.2.3 4111/1111/1111/1111 " + "lorem ipsum 12 dolor 2024-05-06 " * 40 + "tel (269) 555-3296",
]


@pytest.fixture(scope="module")
def model():
    m = pii.Tagger()
    m.fit(*pii.labelled_samples(800), steps=150)
    return m


def slow_lstm(m, c):
    """One window, one step at a time, with the logistic function written out."""
    p, h, out = m.p, pii.HIDDEN, np.zeros((len(c), pii.TAGS))
    for d, order in ((0, range(len(c))), (1, range(len(c) - 1, -1, -1))):
        hs, cell = np.zeros(h), np.zeros(h)
        for t in order:
            z = p["emb"][c[t]] @ p["wx"][d] + p["b"][d] + hs @ p["wh"][d]
            i, f, o = (1 / (1 + np.exp(-z[k * h : (k + 1) * h])) for k in range(3))
            cell = f * cell + i * np.tanh(z[3 * h :])
            hs = o * np.tanh(cell)
            out[t] += hs @ p["out"][d * h : (d + 1) * h]
    return out + p["ob"]


def slow_emissions(m, text):
    c, step = pii.codes(text), pii.WINDOW - pii.OVERLAP
    total, n, s = np.zeros((len(c), pii.TAGS)), np.zeros((len(c), 1)), 0
    while True:
        part = c[s : s + pii.WINDOW]
        total[s : s + len(part)] += slow_lstm(m, part)
        n[s : s + len(part)] += 1
        if s + pii.WINDOW >= len(c):
            return total / n
        s += step


def slow_path(m, e):
    """The best path over a whole text, outside before and after it, without any stretch left out."""
    tr = m.trans.astype(float)
    score, back = tr[0] + e[0], []
    for x in e[1:]:
        table = score[:, None] + tr
        back.append(table.argmax(axis=0))
        score = table.max(axis=0) + x
    tags = [int((score + tr[:, 0]).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return np.array(tags[::-1])


def tags_of(found, n):
    out = np.zeros(n, int)
    for s, tags, _ in found:
        out[s : s + len(tags)] = tags
    return out


def test_emissions_and_paths_equal_the_slow_ones(model):
    found = model.tag(TEXTS)
    for text, own in zip(TEXTS, found):
        if text:
            want = slow_emissions(model, text)
            got = model.emissions([(pii.codes(text), 0, len(text))])[0]
            assert np.abs(got - want).max() < 1e-3
            assert (tags_of(own, len(text)) == slow_path(model, got.astype(float))).all()
    assert any((t > 0).any() for own in found for _, t, _ in own)


def test_untrained_weights_of_any_size_decode_alike():
    """The bound that leaves stretches out holds for transitions and margins of any sign."""
    r = np.random.default_rng(3)
    for k in range(60):
        m = pii.Tagger()
        m.p["trans"] = (r.standard_normal((pii.TAGS, pii.TAGS)) * (k % 5)).astype(np.float32)
        e = r.standard_normal((int(r.integers(1, 120)), pii.TAGS)).astype(np.float32) * 2
        e[:, 0] += r.choice([0, 2, 5, 9])
        got = np.zeros(len(e), int)
        for s, x in m.candidates(pii.margins(e)):
            got[s:x] = m.decode(e[None, s:x])[0]
        assert (got == slow_path(m, e.astype(float))).all()


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    m = pii.Tagger()
    m.p["trans"] = r.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    e = r.standard_normal((1, 4, pii.TAGS)).astype(np.float32)
    paths = np.stack(np.meshgrid(*[np.arange(pii.TAGS)] * 4, indexing="ij"), axis=-1).reshape(-1, 4)
    whole = np.concatenate([np.zeros((len(paths), 1), int), paths, np.zeros((len(paths), 1), int)], axis=1)
    w = np.exp(sum(e[0, t, paths[:, t]] for t in range(4)).astype(float) + sum(m.trans[whole[:, t], whole[:, t + 1]] for t in range(5)))
    tags = m.decode(e)
    assert (paths[w.argmax()] == tags[0]).all()
    want = [w[paths[:, t] == tags[0, t]].sum() / w.sum() for t in range(4)]
    assert np.allclose(m.marginals(e, tags)[0], want, atol=1e-4)


def test_every_character_is_read(model, monkeypatch):
    seen, plain = [], pii.Tagger.window_emissions
    monkeypatch.setattr(pii.Tagger, "window_emissions", lambda self, c, n=None: seen.append(int((c > 0).sum())) or plain(self, c, n))
    model.tag(["no at sign and no digits, only words " * 50])
    assert sum(seen) >= 37 * 50


def test_spans_depend_on_their_text_alone(model, monkeypatch):
    alone = [model.spans([t])[0] for t in TEXTS]
    assert model.spans(TEXTS) == alone == model.spans(TEXTS[::-1])[::-1]
    # Windows, ranges and stretches in small portions; then every text counts as a long one.
    for name, value in (("_WINDOWS", 3), ("_DECODED", 50), ("_HELD", 300)):
        monkeypatch.setattr(pii, name, value)
        assert model.spans(TEXTS) == alone


def test_gradients_equal_finite_differences():
    m = pii.Tagger()
    c, y = pii.labelled_samples(3)
    _, g = m.gradients(c, y)
    r = np.random.default_rng(0)
    for name, p in m.p.items():
        for _ in range(4):
            at = tuple(int(r.integers(n)) for n in p.shape)
            if name == "emb" and not (c == at[0]).any():
                continue
            old, losses = p[at], []
            for step in (0.02, -0.02):
                p[at] = old + step
                losses.append(m.gradients(c, y)[0])
            p[at] = old
            assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 0.04, rel=0.05, abs=0.05), name


def test_training_finds_spans_that_no_base_pattern_has():
    m = pii.default_model()
    for text, kind in (("reach jane at post dot org, please", "email"), ("tel (269) 555-3296 now", "phone"), ("card 4111/1111/1111/1111 ok", "card"), ("host 10 . 2 . 3 . 4 is up", "ip")):
        (base, added), = pii.find_spans([text], m)
        assert not base and [pii.KINDS[k] for _, k, _ in added] == [kind], text
    # Held-out samples: nearly all characters, and nearly all of those in a span, get their tag.
    c, y = pii.labelled_samples(300, seed=99)
    tags = m.decode(m.window_emissions(np.ascontiguousarray(c.T)).transpose(1, 0, 2))
    assert (tags == y).mean() > 0.98 and (tags == y)[y > 0].mean() > 0.95


def test_added_spans_overlap_no_base_span():
    class Found:
        def __init__(self, spans):
            self.found = spans

        def spans(self, texts):
            return [self.found for _ in texts]

    text = "a@b.example.com " + "x" * 20 + " 10.1.2.3 +1 (269) 555-3296"
    base = pii.base_spans(text)
    every = [(s, 0, e) for s in range(len(text)) for e in range(s + 1, len(text) + 1)]
    ((_, added),) = pii.find_spans([text], Found(every))
    assert added == [(s, k, e) for s, k, e in every if not any(s < y and x < e for x, _, y in base)]
