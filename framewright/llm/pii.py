"""Personal data: base recognisers and a character-level bidirectional LSTM with a CRF, written and trained in numpy.

The base recognisers (``base_spans``) are fixed patterns with checks. The network reads every character of every text in overlapping windows; a
position that two windows cover gets the mean of their emissions, and the CRF decodes the text as a whole: wherever a bound over emissions and
transitions doesn't prove that the best path is outside, a Viterbi pass decides, so windows never disagree in the result and a text's spans don't depend on
the texts beside it. A decoded span joins the base ones if it is confident, passes its kind's check (a name, an @ or a spelling of it and a
dotted host; four parts of at most 255; 12 to 19 digits under Luhn; 9 to 15 digits) and overlaps no base span.

Training spans come labelled from ``labelled_samples`` or from the caller.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.util import find_spec
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_blas_thread, task

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The patterns of the contract. Possessive parts and the look-behind only spare the engine attempts that must fail.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted host, found from each @ backwards: linear in long runs without one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points by start, then kind; kinds may overlap each other."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_ok(m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if _card_ok(m[0])]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if _phone_ok(m[0])]
    return sorted(out)


def span_list(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# ---- the network

WINDOW, OVERLAP, HIDDEN, EMBED, CHARS = 960, 48, 16, 12, 160
TAGS = 1 + 2 * len(KINDS)
CONFIDENCE = 0.8
#: Windows run at once, characters whose emissions are held at once, and positions decoded at once.
_WINDOWS, _HELD, _DECODED = 2048, 1 << 20, 1 << 18
_NEVER = np.float32(-1e4)
#: Characters of the texts that a task works on together.
_TOGETHER = 1 << 21


def codes(text: str) -> np.ndarray:
    """Symbols: ASCII as itself, letters and other characters beyond it in two classes, from 128 on. 0 is the padding."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if c.max(initial=0) < 127:
        return (c + 1).astype(np.uint8)
    return np.where(c < 127, c + 1, np.where(c < 0x2000, 129, 130)).astype(np.uint8)


def margins(e: np.ndarray) -> np.ndarray:
    """By position the best emission of a tag that begins a span, and of any but outside, each less that of outside."""
    out = np.stack([e[:, 1], e[:, 2]])
    for k in range(3, TAGS):
        np.maximum(out[(k + 1) % 2], e[:, k], out=out[(k + 1) % 2])
    np.maximum(out[1], out[0], out=out[1])
    return out - e[:, 0]


#: A graph of one Tanh of float values of any length, as an ONNX model's bytes.
_TANH_GRAPH = bytes.fromhex("08083a350a0c0a0178120179220454616e681201745a100a0178120b0a09080112050a0312016e62100a0179120b0a09080112050a0312016e42040a00100e")


@lru_cache(maxsize=1)
def fast_tanh() -> Callable[[np.ndarray], np.ndarray]:
    """tanh of contiguous single-precision values in one thread. The network spends most of its time here, and the inference
    runtime's vector code is several times faster than numpy's where there is no AVX-512. Without that package it is numpy's; the two differ by less than 1e-6."""
    if not find_spec("onnxruntime"):
        return np.tanh
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    run = ort.InferenceSession(_TANH_GRAPH, options, providers=["CPUExecutionProvider"]).run
    return lambda x: run(None, {"x": x.reshape(-1)})[0].reshape(x.shape)


class Tagger:
    """Emissions from a bidirectional LSTM, transitions of a CRF. Tag 0 is outside, 1 + 2k begins kind k and 2 + 2k continues it; the tags before and
    after a text are outside. Both directions run side by side, the backward one over the reversed window (axis 0 of ``wx``, ``wh`` and ``b``)."""

    def __init__(self, seed: int = 11) -> None:
        r, h = np.random.default_rng(seed), HIDDEN
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"emb": f(CHARS, EMBED, scale=0.5), "wx": f(2, EMBED, 4 * h, scale=0.3), "wh": f(2, h, 4 * h, scale=0.2), "b": np.zeros((2, 4 * h), np.float32)}
        self.p |= {"out": f(2 * h, TAGS, scale=0.2), "ob": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        self.p["b"][:, h : 2 * h] = 1
        # A kind is continued only after it was begun.
        self.legal = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            self.legal[:, 2 + 2 * k] = _NEVER
            self.legal[1 + 2 * k, 2 + 2 * k] = self.legal[2 + 2 * k, 2 + 2 * k] = 0

    @property
    def trans(self) -> np.ndarray:
        return self.p["trans"] + self.legal

    # Gates are in the order input, forget, output, candidate. A logistic gate is 0.5 + 0.5 tanh(z / 2): with the halves in the weights one tanh serves all.

    def _halved(self, name: str) -> np.ndarray:
        w = self.p[name].copy()
        w[..., : 3 * HIDDEN] *= 0.5
        return w

    def window_emissions(self, c: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """Emissions (length x windows x tags) of windows given as columns of symbols (length x windows). Windows may end early: ``lengths`` then falls, and what lies
        beyond a window's end isn't run."""
        h, (length, n) = HIDDEN, c.shape
        live = np.full(length, n) if lengths is None else n - np.searchsorted(lengths[::-1], np.arange(length), side="right")
        # By direction and gate, so that each step works on whole arrays.
        table = (np.einsum("ce,deg->dcg", self.p["emb"], self._halved("wx")) + self._halved("b")[:, None, :]).astype(np.float32)
        # The states are held doubled, so that a logistic gate is 1 + tanh and the halves lie in the weights, where they cost and round nothing.
        table, wh = (np.ascontiguousarray(w.reshape(2, -1, 4, h).transpose(0, 2, 1, 3)) for w in (table, self._halved("wh") * np.float32(0.5)))
        out = np.zeros((length, n, TAGS), np.float32)
        z_, fed_, tc_, hs_, cell_ = np.empty(4 * n * h, np.float32), np.empty(4 * n * h, np.float32), *(np.empty((n, h), np.float32) for _ in range(3))
        tanh = fast_tanh()
        for d in (0, 1):
            hs_[:], cell_[:] = 0, 0
            part = self.p["out"][d * h : (d + 1) * h] * np.float32(0.5)
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                k = live[t]
                z, fed, hs, tc, cell = z_[: 4 * k * h].reshape(4, k, h), fed_[: 4 * k * h].reshape(4, k, h), hs_[:k], tc_[:k], cell_[:k]
                np.take(table[d], c[t, :k], axis=1, out=z, mode="clip")
                np.matmul(hs, wh[d], out=fed)
                z += fed
                z = tanh(z)
                gates = z[:3]
                gates += 1
                cell *= gates[1]
                np.multiply(gates[0], z[3], out=tc)
                cell += tc
                cell *= 0.5
                np.multiply(tanh(cell), gates[2], out=hs)
                if d == 0:
                    np.matmul(hs, part, out=out[t, :k])
                else:
                    out[t, :k] += hs @ part
        out += self.p["ob"]
        return out

    # ---- training

    def _forward(self, c: np.ndarray) -> tuple[np.ndarray, dict]:
        """Emissions (length x windows x tags) and what the gradient needs of them."""
        h, (length, n) = HIDDEN, c.shape
        table, wh = np.einsum("ce,deg->dcg", self.p["emb"], self._halved("wx")) + self._halved("b")[:, None, :], self._halved("wh")
        x = np.stack([table[0][c], table[1][c[::-1]]], axis=1).astype(np.float32)  # length, direction, windows, gates
        hs, cs = np.zeros((length + 1, 2, n, h), np.float32), np.zeros((length + 1, 2, n, h), np.float32)
        acts, tcs = np.empty((length, 2, n, 4 * h), np.float32), np.empty((length, 2, n, h), np.float32)
        for t in range(length):
            a = acts[t]
            np.tanh(x[t] + np.matmul(hs[t], wh), out=a)
            a[..., : 3 * h] *= 0.5
            a[..., : 3 * h] += 0.5
            cs[t + 1] = a[..., h : 2 * h] * cs[t] + a[..., :h] * a[..., 3 * h :]
            np.tanh(cs[t + 1], out=tcs[t])
            hs[t + 1] = a[..., 2 * h : 3 * h] * tcs[t]
        hid = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], axis=2)
        return hid @ self.p["out"] + self.p["ob"], {"c": c, "hs": hs, "cs": cs, "acts": acts, "tcs": tcs, "hid": hid}

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood of tags y (length x windows), and its gradients by transitions and emissions."""
        length, n = y.shape
        a = np.exp(self.trans.astype(np.float64))
        top = e.max(axis=2, keepdims=True)
        s = np.exp((e - top).astype(np.float64))
        alpha, beta, norm = np.empty_like(s), np.empty_like(s), np.empty((length, n, 1))
        before = np.broadcast_to(a[0], (n, TAGS))
        for t in range(length):
            x = before * s[t]
            norm[t] = x.sum(axis=1, keepdims=True)
            alpha[t] = x / norm[t]
            before = alpha[t] @ a
        last = alpha[-1] @ a[:, 0]
        beta[-1] = a[:, 0] / last[:, None]
        for t in range(length - 2, -1, -1):
            beta[t] = (s[t + 1] * beta[t + 1] / norm[t + 1]) @ a.T
        z = (np.log(norm[:, :, 0]) + top[:, :, 0]).sum(axis=0) + np.log(last)
        w = (s[1:] * beta[1:] / norm[1:]).reshape(-1, TAGS)
        pair = a * (alpha[:-1].reshape(-1, TAGS).T @ w)
        de = alpha * beta
        pair[0] += de[0].sum(axis=0)
        pair[:, 0] += de[-1].sum(axis=0)
        gold, tr = np.zeros((TAGS, TAGS)), self.trans
        path = np.concatenate([np.zeros((1, n), y.dtype), y, np.zeros((1, n), y.dtype)])
        np.add.at(gold, (path[:-1].ravel(), path[1:].ravel()), 1)
        score = np.take_along_axis(e, y[:, :, None], axis=2).sum() + (gold * tr)[gold > 0].sum()
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], axis=2) - 1, axis=2)
        return float((z.sum() - score) / n), (pair - gold) / n, de / n

    def gradients(self, c: np.ndarray, y: np.ndarray, local: float = 0.3) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of windows c with tags y (both windows x length)."""
        p, h = self.p, HIDDEN
        e, kept = self._forward(np.ascontiguousarray(c.T))
        loss, gtrans, de = self._crf(e, np.ascontiguousarray(y.T))
        if local:  # each position's own cross-entropy: keeps the emissions themselves low where a tag has no place
            s = np.exp(e - e.max(axis=2, keepdims=True))
            s /= s.sum(axis=2, keepdims=True)
            loss -= local * float(np.log(np.take_along_axis(s, y.T[:, :, None], axis=2) + 1e-30).sum()) / len(c)
            np.put_along_axis(s, y.T[:, :, None], np.take_along_axis(s, y.T[:, :, None], axis=2) - 1, axis=2)
            de = de + local * s / len(c)
        de, hid, acts, tcs, cs, hs = de.astype(np.float32), kept["hid"], kept["acts"], kept["tcs"], kept["cs"], kept["hs"]
        g = {"trans": gtrans, "out": hid.reshape(-1, 2 * h).T @ de.reshape(-1, TAGS), "ob": de.sum(axis=(0, 1))}
        back = de @ p["out"].T
        dout = np.stack([back[:, :, :h], back[::-1, :, h:]], axis=1)
        length, n = c.shape[1], c.shape[0]
        dz_all, wht = np.empty((length, 2, n, 4 * h), np.float32), np.ascontiguousarray(p["wh"].transpose(0, 2, 1))
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for t in range(length - 1, -1, -1):
            a, dz = acts[t], dz_all[t]
            i, f, o, cand = a[..., :h], a[..., h : 2 * h], a[..., 2 * h : 3 * h], a[..., 3 * h :]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tcs[t] * tcs[t])
            dz[..., :h], dz[..., h : 2 * h] = dc * cand, dc * cs[t]
            dz[..., 2 * h : 3 * h], dz[..., 3 * h :] = dh * tcs[t], dc * i * (1 - cand * cand)
            dz[..., : 3 * h] *= a[..., : 3 * h] * (1 - a[..., : 3 * h])
            dh, dc = np.matmul(dz, wht), dc * f
        order = np.stack([kept["c"], kept["c"][::-1]])
        seen = [np.eye(CHARS, dtype=np.float32)[order[d].ravel()].T @ dz_all[:, d].reshape(-1, 4 * h) for d in (0, 1)]
        g["wh"] = np.stack([hs[:-1, d].reshape(-1, h).T @ dz_all[:, d].reshape(-1, 4 * h) for d in (0, 1)])
        g["b"], g["wx"] = np.stack([x.sum(axis=0) for x in seen]), np.stack([p["emb"].T @ x for x in seen])
        g["emb"] = sum(x @ p["wx"][d].T for d, x in enumerate(seen))
        return loss, g

    def fit(self, c: np.ndarray, y: np.ndarray, steps: int = 800, batch: int = 24, rate: float = 0.03, seed: int = 17) -> list[float]:
        """Adam over random batches of windows c with tags y (windows x length)."""
        one_blas_thread()
        r, m, v, losses = np.random.default_rng(seed), {k: 0 for k in self.p}, {k: 0 for k in self.p}, []
        for n in range(1, steps + 1):
            rows = r.integers(0, len(c), batch)
            loss, g = self.gradients(c[rows], y[rows])
            losses.append(loss)
            lr = rate * 0.5 * (1.02 + np.cos(np.pi * n / steps))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        return losses

    # ---- whole texts

    def emissions(self, parts: list[tuple[np.ndarray, int, int]]) -> list[np.ndarray]:
        """Emissions of the ranges [lo, hi) of texts (given as symbols). A text's windows begin every ``WINDOW - OVERLAP`` characters from its start, the last one
        ends with it; a position that two windows cover gets their mean. So they depend on the text alone, not on the range or on other texts."""
        step = WINDOW - OVERLAP
        todo, out = [], []
        for i, (c, lo, hi) in enumerate(parts):
            out.append(np.zeros((hi - lo, TAGS), np.float32))
            windows = max(1, -(-(len(c) - OVERLAP) // step))
            for w in range(max(0, -(-(lo - WINDOW + 1) // step)), min(windows, -(-hi // step))):
                todo.append((min(WINDOW, len(c) - w * step), i, w * step))
        todo.sort(key=lambda w: -w[0])
        for at in range(0, len(todo), _WINDOWS):
            some = todo[at : at + _WINDOWS]
            m = np.zeros((len(some), some[0][0]), np.uint8)
            for row, (real, i, s) in zip(m, some):
                row[:real] = parts[i][0][s : s + real]
            em = self.window_emissions(np.ascontiguousarray(m.T), np.array([w[0] for w in some]))
            for first in range(0, len(some), 32):  # a few windows' rows fit into the cache when they are turned
                turned = np.ascontiguousarray(em[: some[first][0], first : first + 32].transpose(1, 0, 2))
                for e, (real, i, s) in zip(turned, some[first : first + 32]):
                    _, lo, hi = parts[i]
                    a, b = max(lo, s), min(hi, s + real)
                    out[i][a - lo : b - lo] += e[a - s : b - s]
        for o, (c, lo, hi) in zip(out, parts):
            # Two windows cover the first OVERLAP positions of every window but the first.
            for s in range(step * max(1, (lo - OVERLAP) // step), min(hi, step * (-(-(len(c) - OVERLAP) // step) - 1) + 1), step):
                o[max(0, s - lo) : max(0, s + OVERLAP - lo)] *= 0.5
        return out

    def candidates(self, margin: np.ndarray) -> list[tuple[int, int]]:
        """Stretches outside of which the best path of a text is surely outside, from ``margins`` (2 x positions).

        A path with the other tags on [a, b) beats the one with outside there only if the sum over [a, b) of margin + within, plus ``ends``, isn't negative,
        where ``within`` and ``ends`` bound what transitions can add, and the margin at a is that of the tags that begin a span. A position stays if some such
        stretch holds it: if the highest later prefix sum less the lowest earlier one reaches -ends.
        """
        tr = self.trans.astype(np.float64)
        within = tr[1:, 1:].max() - tr[0, 0]
        ends = (tr[0, 1:].max() - tr[0, 0]) + (tr[1:, 0].max() - tr[0, 0]) - within
        begin, other = margin
        # The best first position and all positions that add something: below the bound together, no stretch of the text reaches it.
        if len(begin) and float(begin.max()) + within + float(np.maximum(other + np.float32(within), 0).sum(dtype=np.float64)) + ends < -2e-2:
            return []
        total = np.cumsum(other + within, dtype=np.float64)
        low, high = np.minimum.accumulate(total - begin - within), np.maximum.accumulate(total[::-1])[::-1]
        live = np.flatnonzero(np.diff(np.concatenate([[False], high - low + ends >= -1e-2, [False]]).astype(np.int8)))
        return list(zip(live[::2].tolist(), live[1::2].tolist()))

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags of stretches (stretches x length x tags) that are preceded and followed by outside."""
        n, length, _ = e.shape
        tr, rows = self.trans, np.arange(n)
        score, back = tr[0] + e[:, 0], np.empty((length, n, TAGS), np.uint8)
        into, cells = np.ascontiguousarray(tr.T), np.arange(n * TAGS)  # the tag before in the last place
        for t in range(1, length):
            m = (score[:, None, :] + into).reshape(-1, TAGS)
            best = m.argmax(axis=1)
            back[t] = best.reshape(n, TAGS)
            score = m[cells, best].reshape(n, TAGS) + e[:, t]
        tags = np.empty((n, length), np.uint8)
        tags[:, -1] = (score + tr[:, 0]).argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        return tags

    def marginals(self, e: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Probability of each of the given tags, by the forward and backward passes (in probabilities, scaled at each position)."""
        n, length, _ = e.shape
        a, s, rows = np.exp(self.trans), np.exp(e - e.max(axis=2, keepdims=True)), np.arange(n)
        forward, sure = np.empty((length, n, TAGS), np.float32), np.empty((n, length), np.float32)
        x = a[0] * s[:, 0]
        forward[0] = x / x.sum(axis=1, keepdims=True)
        for t in range(1, length):
            x = (forward[t - 1] @ a) * s[:, t]
            forward[t] = x / x.sum(axis=1, keepdims=True)
        b = np.broadcast_to(a[:, 0], (n, TAGS))
        for t in range(length - 1, -1, -1):
            x = forward[t] * b
            sure[:, t] = x[rows, tags[:, t]] / x.sum(axis=1)
            b = (s[:, t] * b) @ a.T
            b = b / b.max(axis=1, keepdims=True)
        return sure

    def tag(self, texts: list[str]) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each text the decoded stretches (start, tags, their marginals where a stretch has a span); all else is outside. Every character of every text runs through the network."""
        symbols = [codes(t) for t in texts]
        ranges = [(d, lo, min(len(c), lo + _HELD)) for d, c in enumerate(symbols) for lo in range(0, len(c), _HELD)]
        out: list[list] = [[] for _ in texts]
        held: list[tuple[int, int, np.ndarray]] = []  # text, start, emissions of a stretch
        long: dict[int, list] = {}
        at = 0
        while at < len(ranges):
            stop, size = at, 0
            while stop < len(ranges) and (stop == at or size + ranges[stop][2] - ranges[stop][1] <= _HELD):
                size, stop = size + ranges[stop][2] - ranges[stop][1], stop + 1
            for (d, lo, hi), e in zip(ranges[at:stop], self.emissions([(symbols[d], lo, hi) for d, lo, hi in ranges[at:stop]])):
                margin = margins(e)
                if len(symbols[d]) <= _HELD:
                    held += [(d, s, e[s:x].copy()) for s, x in self.candidates(margin)]
                    continue
                # A text of more than one range: only its margins are kept, the emissions of its stretches are computed again.
                long.setdefault(d, []).append(margin)
                if hi == len(symbols[d]):
                    for s, x in self.candidates(np.concatenate(long.pop(d), axis=1)):
                        self._decode([(d, s, np.concatenate([self.emissions([(symbols[d], p, min(x, p + _HELD))])[0] for p in range(s, x, _HELD)]))], out)
            at = stop
        self._decode(held, out)
        for found in out:
            found.sort(key=lambda x: x[0])
        return out

    def _decode(self, held: list[tuple[int, int, np.ndarray]], out: list) -> None:
        held, at = sorted(held, key=lambda x: len(x[2])), 0
        while at < len(held):
            stop, length = at, 0
            # Stretches of like lengths together: little is run beyond their ends.
            while stop < len(held) and (stop == at or ((stop - at + 1) * len(held[stop][2]) <= _DECODED and len(held[stop][2]) <= 1.5 * len(held[at][2]) + 8)):
                length, stop = len(held[stop][2]), stop + 1
            e = np.full((stop - at, length, TAGS), _NEVER, np.float32)  # beyond a stretch's end only outside is possible
            e[:, :, 0] = 0
            for row, (_, _, x) in zip(e, held[at:stop]):
                row[: len(x)] = x
            tags = self.decode(e)
            sure, some = np.ones(tags.shape, np.float32), np.flatnonzero(tags.any(axis=1))  # elsewhere there is no span to be sure of
            if len(some):
                end = max(len(held[at + i][2]) for i in some)
                sure[some, :end] = self.marginals(e[some, :end], tags[some, :end])
            for (d, s, x), y, z in zip(held[at:stop], tags, sure):
                out[d].append((s, y[: len(x)], z[: len(x)]))
            at = stop

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Decoded spans (start, kind, end) of each text that are confident and pass their kind's check."""
        out = []
        for text, found in zip(texts, self.tag(texts)):
            own = []
            for s, tags, sure in found:
                for a in np.flatnonzero(tags % 2 == 1).tolist():
                    k, b = (int(tags[a]) - 1) // 2, a + 1
                    while b < len(tags) and tags[b] == 2 + 2 * k:
                        b += 1
                    if sure[a:b].mean() >= CONFIDENCE and _check(k, text[s + a : s + b]):
                        own.append((s + a, k, s + b))
            out.append(own)
        return out


#: A name, an @ or a spelling of it, and a host whose dots may be spelt out too.
_HOST = re.compile(r"[^@\s()\[\]]+(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?|\sat\s(?=.*\sdot\s))[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?|\sdot\s)[A-Za-z0-9-]+)+", re.I)
_FOUR = re.compile(r"[0-9]{1,3}([. ]{1,3})[0-9]{1,3}\1[0-9]{1,3}\1[0-9]{1,3}")


def _check(kind: int, s: str) -> bool:
    if s != s.strip() or "\n" in s:
        return False
    if kind == 0:
        return _HOST.fullmatch(s) is not None
    if kind == 1:
        return _FOUR.fullmatch(s) is not None and _ip_ok(".".join(re.findall("[0-9]+", s)))
    if re.search(r"[^0-9 +().\-/]", s):
        return False
    return _card_ok(s) if kind == 2 else _phone_ok(s) and ("(" in s or "+" in s or len(re.findall(r"[ .\-/]", s)) >= 2)


# ---- labelled spans


def labelled_samples(n: int = 3000, seed: int = 23, length: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n x length symbols) and tags from spans that are labelled because they were put there: the four kinds in many forms, among words, and lookalikes."""
    r = random.Random(seed)
    pick, between = r.choice, r.randrange
    num = lambda k: "".join(r.choices("0123456789", k=k))
    lower, syl = "abcdefghijklmnopqrstuvwxyz", "an er in on the re st tion ou ed ing es é ch un de la que os ado ñ ung ß ö ver".split()

    def word() -> str:
        w = "".join(pick(syl) for _ in range(between(1, 5)))
        w = pick((w, w, w, w.capitalize(), w.upper()))
        return w + pick(("", "", "", "", ",", ".", "!!", ":", ";", "***", " |"))

    def name(k: int) -> str:
        return "".join(pick(lower) for _ in range(k))

    def email() -> str:
        local = name(between(3, 10)) + pick(("", ".", "_", "-", "+")) + pick(("", num(2), name(4), num(3)))
        at, dot = pick((("@", "."), ("@", "."), ("@", "."), (" @ ", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" AT ", " DOT ")))
        return local.rstrip(".-_+") + at + pick(("mail", "post", name(6))) + pick(("", num(1))) + dot + pick(("example.com", "org", "net", name(2), "co.uk", "example.net")).replace(".", dot)

    def ip() -> str:
        return pick((".", ".", ".", " . ")).join(str(between(256)) for _ in range(4))

    def card() -> str:
        d = pick("3456") + num(int(pick((11, 13, 14, 14, 14, 17))))
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick(("", "", " ", "-", ".", "/")).join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        cc = str(between(1, 99))
        return pick((f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}", f"+{cc}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{cc} {a} {b} {c}"))

    def lookalike() -> str:
        return pick((num(between(1, 9)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", f"{num(2)}:{num(2)}:{num(2)}", f"${num(3)}.{num(2)}", f"{name(4)} at {name(5)}", "at", "at the", f"(at {name(4)})", "dot", f"[{name(3)}]", "AKIA" + name(8).upper() + num(8), f"@{name(6)}", f"{name(4)}@{name(4)}", f"{300 + between(600)}.{num(2)}.{num(1)}.{num(1)}", name(4) + num(6) + name(5), f"sha{num(3)} {name(3)}{num(9)}{name(4)}{num(5)}", f"({num(4)})", f"/{name(3)}/{num(3)}", num(10), f"{num(4)} {num(4)}", f"{num(3)},{num(3)},{num(3)}"))

    makers = (email, ip, card, phone)
    c, y = np.zeros((n, length), dtype=np.uint8), np.zeros((n, length), dtype=np.int64)
    for row in range(n):
        text, tags = "", []
        while len(text) < 2 * length:
            u = r.random()
            if u < 0.16:
                k = between(4)
                s = makers[k]()
                t = [1 + 2 * k] + [2 + 2 * k] * (len(s) - 1)
                tail = pick(("", "", "", ",", ".", ")"))
            else:
                s, tail = (lookalike() if u < 0.26 else word()), ""
                t = [0] * len(s)
            gap = pick((" ", " ", " ", "\n"))
            text, tags = text + s + tail + gap, tags + t + [0] * (len(tail) + 1)
        cut = between(0, length)
        x, t = codes(text)[cut : cut + length], np.array(tags[cut : cut + length])
        # A span that the window's left edge cuts goes on from its second tag, which a window can't begin with.
        if t[0] and t[0] % 2 == 0:
            t[0] -= 1
        c[row], y[row] = x, t
    return c, y


@lru_cache(maxsize=1)
def default_model() -> Tagger:
    """The tagger trained on ``labelled_samples``; one training for each driver process, always with the same result."""
    t = Tagger()
    t.fit(*labelled_samples())
    return t


# ---- the operator


def find_spans(texts: list[str | None], model: Tagger) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    out = []
    for b, found in zip(base, model.spans(texts)):
        starts, reach = [s for s, _, _ in b], list(accumulate((e for _, _, e in b), max))
        # Of the base spans that begin before the end of this one, the furthest end tells whether any overlaps it.
        out.append((b, [(s, k, e) for s, k, e in found if not (at := bisect_left(starts, e)) or reach[at - 1] <= s]))
    return out


def detect_pii(docs: DataFrame, model: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, base and added (arrays of struct<kind, start, end, text>).

    Null texts are empty and have no spans. Positions are code points, the end exclusive. Null identifiers stay null, repeated rows get
    equal results, other columns are ignored, and an empty table gives an empty result.
    """
    model = model or default_model()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                texts, size = [], 0
                while lo + len(texts) < b.num_rows and (not texts or size < _TOGETHER):
                    texts.append(b.column(1)[lo + len(texts)].as_py())
                    size += len(texts[-1] or "")
                ids, lo = b.column(0).slice(lo, len(texts)), lo + len(texts)
                rows = find_spans(texts, model)
                cols = [pa.array([[{"kind": KINDS[k], "start": s, "end": e, "text": t[s:e]} for s, k, e in r[i]] for r, t in zip(rows, texts)], span) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "base", "added"])

    s = "array<struct<kind: string, start: bigint, end: bigint, text: string>>"
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(task(run), f"doc_id long, base {s}, added {s}")


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of ``detect_pii``'s result: counts of base spans, their hash, and all spans."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("r"), x["end"].alias("end"), x["kind"].alias("kind"))))
    of = lambda k: F.filter("base", lambda x: x["kind"] == k)
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )
