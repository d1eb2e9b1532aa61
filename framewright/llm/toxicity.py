"""Convolutional toxicity classifier, trained in numpy.

A word's embedding is the sum of the hashed vectors of the word and of its prefixes, so inflected and derived forms share
a part. Convolutions of several widths run over the word sequence, each filter keeps its maximum over the whole text, and
a linear layer gives a logit. Because an embedding depends on the word alone, a filter's response is a sum of per-word table
entries; the tables are computed once for each distinct word of a batch.

Thresholds are calibrated by language: an out-of-sample part of the training rows gives, for each predicted language, the logit
at which its F1 is best, and the score is the sigmoid of the logit less that threshold, so 0.5 is each language's own threshold.
The language is predicted from the text; labels, language, source and identifier are never inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, give_back, hashed_sample, one_blas_thread
from .langid import HierarchicalModel, held_out
from .langid import train as train_language

WIDTHS, FILTERS, DIM, BUCKETS, PREFIXES = (1, 2, 3), 16, 16, 1 << 15, (4, 5)
#: Labelled rows that training reads at most, and rows of each label that it fits on.
MAX_LABELLED, PER_CLASS = 24_000, 2_000
_word = re.compile(r"[^\W\d_]+").findall
_PAD = 0


def word_ids(word: str) -> tuple[int, ...]:
    """Hash buckets of a word: itself, then its prefixes (bucket 0, the null vector, where it isn't longer)."""
    return (
        1 + xxhash.xxh64_intdigest(word) % (BUCKETS - 1),
        *(1 + xxhash.xxh64_intdigest(word[:n], seed=n) % (BUCKETS - 1) if len(word) > n - 1 else 0 for n in PREFIXES),
    )


def _encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' buckets, the word numbers of all texts one after another, and where each text begins. Each text ends with pads (word 0)."""
    index: dict[str, int] = {"": 0}
    seq, starts, at = [], [], 0
    add = index.setdefault
    for t in texts:
        words = _word(t.lower()) if t else []
        starts.append(at)
        for w in words:
            add(w, len(index))
        ids = [*map(index.__getitem__, words), *[0] * max(WIDTHS)]
        seq.append(np.array(ids, dtype=np.int32))
        at += len(ids)
    buckets = np.array([(0,) * (1 + len(PREFIXES)), *map(word_ids, list(index)[1:])], dtype=np.int64)
    return buckets, np.concatenate(seq) if seq else np.empty(0, np.int32), np.array(starts, dtype=np.int64)


class ToxicityModel:
    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self.emb = (r.standard_normal((BUCKETS, DIM)) * 0.3).astype(np.float32)
        self.emb[0] = 0
        self.conv = [(r.standard_normal((w, DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out0 = np.float32(0)
        self.thresholds: dict[str, float] = {}
        self.default = 0.0
        self.language: HierarchicalModel | None = None

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Pooled responses (texts x filters, before the rectifier)."""
        return self._pool(*_encode(texts))[0]

    def _pool(self, buckets: np.ndarray, seq: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
        """Pooled responses of encoded texts, the responses at every position by width, and the words' embeddings."""
        e, ends = self.emb[buckets].sum(axis=1), np.r_[starts[1:], len(seq)]
        pooled, responses = [], []
        for conv in self.conv:
            w = len(conv)
            r = (e @ conv[0])[seq]
            for j in range(1, w):
                r[: len(seq) - j] += (e @ conv[j])[seq[j:]]
            for j in range(1, w):  # a window ends where its text does
                r[ends - j] = -np.inf
            pooled.append(np.maximum.reduceat(r, starts, axis=0))
            responses.append(r)
        return np.concatenate(pooled, axis=1) + self.bias, responses, e

    def gradients(self, buckets: np.ndarray, seq: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Weighted mean logistic loss of encoded texts, its gradients by name, and by the words' embeddings (of each word's sum)."""
        pooled, responses, e = self._pool(buckets, seq, starts)
        h = np.maximum(pooled, 0)
        z = h @ self.out + self.out0
        loss = float((np.logaddexp(0, np.where(y > 0, -z, z)) * weight).mean())
        d = ((1 / (1 + np.exp(-z)) - y) * weight / len(y)).astype(np.float32)
        dh = np.outer(d, self.out) * (pooled > 0)
        grads, de = {"out": h.T @ d, "bias": dh.sum(axis=0), "out0": d.sum()}, np.zeros_like(e)
        text = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(seq)]))
        for c, (conv, r) in enumerate(zip(self.conv, responses)):
            part = dh[:, c * FILTERS : (c + 1) * FILTERS]
            top = (pooled - self.bias)[:, c * FILTERS : (c + 1) * FILTERS]
            # Where each maximum lies: of the positions that reach it, the first of each text and filter.
            at, f = np.nonzero((r >= top[text] - 1e-6 * np.abs(top[text])) & (part != 0)[text])
            _, first = np.unique(text[at] * FILTERS + f, return_index=True)
            at, f = at[first], f[first]
            g = part[text[at], f]
            grads[f"c{c}"] = np.zeros_like(conv)
            for j in range(len(conv)):
                words = seq[at + j]
                by_filter = np.zeros((FILTERS, DIM), np.float32)
                np.add.at(by_filter, f, e[words] * g[:, None])
                grads[f"c{c}"][j] = by_filter.T
                np.add.at(de, words, conv[j][:, f].T * g[:, None])
        return loss, grads, de

    def logits(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return (np.maximum(self.features(texts), 0) @ self.out + self.out0).astype(np.float64)

    def fit(self, texts: list[str | None], y: np.ndarray, steps: int = 600, batch: int = 32, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the logistic loss with classes of equal weight; embeddings are updated where the batch touches them. Whole epochs, ``steps`` batches or more."""
        one_blas_thread()
        r = np.random.default_rng(seed)
        pos = max(1, int(y.sum()))
        weight = (np.where(y > 0, 0.5 / pos, 0.5 / max(1, len(y) - pos)) * len(y)).astype(np.float32)
        every, seq, starts = _encode(texts)
        own = np.split(seq, starts[1:])
        params = {"out": self.out, "bias": self.bias, **{f"c{i}": c for i, c in enumerate(self.conv)}}
        m, v, n = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros_like(p) for k, p in params.items()}, 0
        acc = np.zeros(BUCKETS, dtype=np.float32)
        for _ in range(max(1, -(-steps * batch // max(1, len(y))))):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                words, local = np.unique(np.concatenate([own[i] for i in rows]), return_inverse=True)
                begins = np.cumsum([0, *(len(own[i]) for i in rows[:-1])])
                buckets = every[words]
                _, grads, de = self.gradients(buckets, local, begins, y[rows], weight[rows])
                self.out0 -= np.float32(rate) * grads["out0"]
                n += 1
                for k, p in params.items():
                    m[k] += 0.1 * (grads[k] - m[k])
                    v[k] += 0.001 * (grads[k] ** 2 - v[k])
                    p -= (rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
                used = np.flatnonzero(de.any(axis=1))
                if len(used):
                    rows_, inverse = np.unique(buckets[used].ravel(), return_inverse=True)
                    ge = np.zeros((len(rows_), DIM), dtype=np.float32)
                    np.add.at(ge, inverse, np.repeat(de[used], buckets.shape[1], axis=0))
                    acc[rows_] += (ge**2).mean(axis=1)
                    self.emb[rows_] -= np.float32(5 * rate) * ge / (np.sqrt(acc[rows_])[:, None] + 1e-6)
                    self.emb[0] = 0

    def calibrate(self, texts: list[str | None], y: np.ndarray, least: int = 20) -> None:
        """Thresholds of each predicted language with at least ``least`` rows of either label, and one for the others."""
        z, lang = self.logits_in_parts(texts), np.array(self.languages(texts), dtype=object)
        self.default = _best_threshold(z, y)
        for c in sorted(set(lang.tolist())):
            own = lang == c
            if min((y[own] > 0).sum(), (y[own] == 0).sum()) >= least:
                self.thresholds[c] = _best_threshold(z[own], y[own])

    def logits_in_parts(self, texts: list[str | None], part: int = 64) -> np.ndarray:
        return np.concatenate([self.logits(texts[i : i + part]) for i in range(0, len(texts), part)]) if texts else np.zeros(0)

    def languages(self, texts: list[str | None]) -> list[str]:
        if self.language is None or len(self.language.langs) < 2:
            return ["und"] * len(texts)
        return [c for i in range(0, len(texts), 32) for c in self.language.predict([t or "" for t in texts[i : i + 32]])[0]]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.logits_in_parts(texts)
        if self.thresholds and len(set(self.thresholds.values()) | {self.default}) > 1:
            cut = np.array([self.thresholds.get(c, self.default) for c in self.languages(texts)])
        else:
            cut = self.default
        return 1 / (1 + np.exp(-np.clip(z - cut, -30, 30)))


def _best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The logit with the best F1, in the middle of the widest gap of equally good ones."""
    order = np.argsort(-z, kind="stable")
    zs, ys = z[order], y[order]
    if not ys.sum():
        return float(zs.max() + 4) if len(zs) else 0.0
    f1 = 2 * np.cumsum(ys) / (np.arange(1, len(ys) + 1) + ys.sum())
    f1[:-1][zs[:-1] == zs[1:]] = -1  # a threshold can't part ties
    i = int(f1.argmax())
    low = zs[i + 1] if i + 1 < len(zs) else zs[i] - 4
    return float((zs[i] + low) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", max_labelled: int = MAX_LABELLED, per_class: int = PER_CLASS) -> ToxicityModel:
    """A model of labelled rows that aren't held out: at most ``per_class`` of each label, chosen by identifier hash among ``max_labelled`` rows."""
    lab = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y")).filter(~held_out(F.col("i")))
    lab = hashed_sample(lab, "i", max_labelled).toPandas()
    lab = pd.concat([part.iloc[:per_class] for _, part in lab.groupby("y")]) if len(lab) else lab
    model = ToxicityModel()
    if len(lab):
        ids = docs.sparkSession.createDataFrame([(int(i), int(y)) for i, y in zip(lab["i"], lab["y"])], "i long, y int")
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).join(checked_broadcast(ids), "i").toPandas().sort_values(["i", "t"])
        texts, y = rows["t"].tolist(), rows["y"].to_numpy().astype(np.float32)
        if lang_col:
            model.language = train_language(docs, id_col, text_col, lang_col, per_lang=200)
        if 0 < y.sum() < len(y):
            test = np.array([int(i) % 4 == 0 for i in rows["i"]])
            model.fit([t for t, x in zip(texts, test) if not x], y[~test])
            model.calibrate([t for t, x in zip(texts, test) if x], y[test])
    return model


def score_column(model: ToxicityModel, text: Column) -> Column:
    """Score of each text, 0 to 1; null counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one_blas_thread()
        give_back()
        for texts in batches:
            t = [x if isinstance(x, str) else None for x in texts]
            yield pd.Series(np.concatenate([model.scores(t[i : i + 64]) for i in range(0, len(t), 64)]) if t else np.zeros(0))
            del texts, t
            give_back()

    return run(text.cast("string"))


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null and empty texts get the score of an empty text. Labels other than 0 and 1 and of null identifiers are ignored; of repeated labels the highest counts.
    Null identifiers are held out. Repeated rows get equal scores. Without labels of both kinds nothing is
    learnt and all scores are equal. An empty table gives an empty result.
    """
    model = model or train(docs, labels, id_col, text_col, lang_col=lang_col)
    doc = F.col(f"`{id_col}`")
    out = docs.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), score_column(model, F.col(f"`{text_col}`")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
