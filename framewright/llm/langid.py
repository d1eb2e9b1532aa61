"""Hierarchical language identification.

Features are character n-grams (1 to 3) of the lowered text, hashed, as square roots of their frequencies. A first level of
one-versus-rest linear support vector machines decides the language family; inside it, one-versus-one linear machines
separate the related languages by votes. Both levels are trained in numpy on a bounded sample of labelled rows
(``per_lang`` rows for each language, taken by identifier hash); prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, drop_kept, durable, fresh, give_back, one_blas_thread, share_below

#: Families of ISO 639-1 codes. Languages that aren't listed form a family of their own.
FAMILIES = {
    code: family
    for family, codes in {
        "germanic": "en de nl sv da no nb nn is af fy lb yi",
        "romance": "fr es it pt ro ca gl oc la",
        "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
        "baltic": "lt lv",
        "uralic": "fi et hu",
        "celtic": "ga gd cy br",
        "turkic": "tr az kk ky uz tk tt",
        "indic": "hi ur bn mr ne pa gu si",
        "iranian": "fa ps ku tg",
        "semitic": "ar he am mt",
        "dravidian": "ta te kn ml",
        "sinitic": "zh yue",
        "japonic": "ja",
        "koreanic": "ko",
        "austronesian": "id ms tl jv su mg mi",
        "hellenic": "el",
    }.items()
    for code in codes.split()
}
UNDETERMINED = "und"
#: Buckets of single characters, pairs and triples.
BUCKETS = (1024, 4096, 8192)
PER_LANG = 400
#: Scores below which a text counts as not identified, and from which on a prediction replaces a label.
LEAST, SURE = 0.27, 0.9
_DIM = sum(BUCKETS)
_LETTER = regex.compile(r"\p{L}").search


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER(text) is not None


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the identifier as text, modulo 5, is 0; such rows are never learnt from. A null identifier counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _codes(text: str) -> np.ndarray:
    """Code points of the lowered text with every run that isn't of letters as one space-like zero on each side."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = c < _TABLE.size
    c = np.where(low, _TABLE[np.where(low, c, 0)], c)
    if c.size > 1:
        c = c[(c != 0) | np.r_[True, c[:-1] != 0]]
    return np.concatenate(([0], c, [0])).astype(np.uint32) if c.size else np.zeros(2, dtype=np.uint32)


_TABLE = np.array([i if chr(i).isalpha() else 0 for i in range(0x3000)], dtype=np.uint32)


def featurize(texts: list[str]) -> np.ndarray:
    """Rows of square-root frequencies, one block for each n, each block of unit length."""
    parts = [_codes(t) for t in texts]
    size = np.array([len(p) for p in parts])
    c, doc = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
    out = np.zeros((len(texts), _DIM), dtype=np.float32)
    at, h = 0, c.astype(np.uint64)
    for n, m in enumerate(BUCKETS):
        if n:
            h = h[:-1] * np.uint64(0x9E3779B1) + c[n:]
            same = doc[n:] == doc[: len(doc) - n]
            key, owner = h[same], doc[n:][same]
        else:
            key, owner = h, doc
        key = (key ^ (key >> np.uint64(15))) * np.uint64(0x85EBCA6B)
        b = ((key ^ (key >> np.uint64(13))) % np.uint64(m)).astype(np.int64)
        counts = np.bincount(owner * m + b, minlength=len(texts) * m).reshape(len(texts), m).astype(np.float32)
        total = counts.sum(axis=1, keepdims=True)
        out[:, at : at + m] = np.sqrt(counts / np.maximum(total, 1))
        at += m
    return out


def train_svm(gram: np.ndarray, y: np.ndarray, reg: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights of the rows (and bias) of a linear machine with squared hinge loss; y is 1 or -1.

    Accelerated gradient descent with balanced classes. The weight vector is always a combination of the rows, so the steps
    run over their inner products ``gram`` and cost the same however many features there are.
    """
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, bias = np.zeros(len(y), dtype=np.float32), 0.0
    v, vb, t = w, bias, 1.0
    rate = 1.0 / (2 * (len(BUCKETS) + 1) + reg)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (gram @ v + np.float32(vb))) * cost * y
        new, nb = v - np.float32(rate) * (np.float32(reg) * v - 2 * slack), vb + 2 * rate * float(slack.sum())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        step = (t - 1) / t2
        v, vb, w, bias, t = new + np.float32(step) * (new - w), nb + step * (nb - bias), new, nb, t2
    return w, bias


class HierarchicalModel:
    """``classes``: languages in order; ``families``: family names; weights of both levels side by side in one matrix."""

    def __init__(self, texts: list[str], langs: list[str], family_rows: int = 4000) -> None:
        self.langs = sorted(set(langs))
        family = {c: FAMILIES.get(c.lower().split("-")[0], "unlisted") for c in self.langs}
        self.families = sorted(set(family.values()))
        self.members = [[i for i, c in enumerate(self.langs) if family[c] == f] for f in self.families]
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        columns = []
        if texts:
            y = np.array([self.langs.index(c) for c in langs])

            def features(rows: np.ndarray) -> np.ndarray:
                return np.concatenate([featurize([texts[i] for i in rows[at : at + 64]]) for at in range(0, len(rows), 64)])

            def fit(x: np.ndarray, gram: np.ndarray, positive: np.ndarray) -> None:
                a, bias = train_svm(gram, np.where(positive, 1, -1).astype(np.float32))
                columns.append(np.append(a @ x, np.float32(bias)))

            # No more than ``family_rows`` rows are in one matrix: the families learn from an even share of each language, a pair from its own rows.
            if len(self.families) > 1:
                share = max(1, family_rows // len(self.langs))
                rows = np.concatenate([np.flatnonzero(y == c)[:share] for c in range(len(self.langs))])
                x = features(rows)
                gram = x @ x.T
                for m in self.members:
                    fit(x, gram, np.isin(y[rows], m))
            for a, b in self.pairs:
                rows = np.flatnonzero((y == a) | (y == b))
                x = features(rows)
                fit(x, x @ x.T, y[rows] == a)
        self.w = np.stack(columns, axis=1) if columns else np.zeros((_DIM + 1, 0), dtype=np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of texts that have a letter. The score is the family's share times the mean of the winner's pairwise ones."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        m = featurize(texts) @ self.w[:-1] + self.w[-1]
        n, rows = len(self.families), np.arange(len(texts))
        if n > 1:
            e = np.exp(4 * (m[:, :n] - m[:, :n].max(axis=1, keepdims=True)))
            e /= e.sum(axis=1, keepdims=True)
        else:
            e = np.ones((len(texts), 1))
        fam = e.argmax(axis=1)
        votes = np.zeros((len(texts), len(self.langs)))
        offset = n if n > 1 else 0
        for k, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-4 * np.clip(m[:, offset + k], -20, 20)))
            votes[:, a] += p
            votes[:, b] += 1 - p
        best, share = np.zeros(len(texts), dtype=int), np.ones(len(texts))
        for f, members in enumerate(self.members):
            own = fam == f
            if own.any():
                v = votes[np.ix_(own, members)]
                best[own] = np.array(members)[v.argmax(axis=1)]
                share[own] = v.max(axis=1) / max(1, len(members) - 1) if len(members) > 1 else 1.0
        return [self.langs[i] for i in best], np.clip(e[rows, fam] * share, 0, 1)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> HierarchicalModel:
    """A model of at most ``per_lang`` rows for each language, of rows that aren't held out, have a language and a letter.

    The sample is chosen over identifiers only: a hash threshold leaves about 1.5 times ``per_lang`` of each language, of which the first stay. Its texts are
    then picked by a join with that bounded list, and only they reach the driver.
    """
    doc, lang = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`")
    rows = docs.filter(lang.isNotNull() & ~held_out(doc)).select(doc.alias("i"), lang.cast("string").alias("l"), F.xxhash64(doc).alias("h"))
    sizes = checked_broadcast(durable(rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))))
    rows = rows.join(sizes, "l").filter(share_below(F.col("h"), F.lit(1.5 * per_lang) / F.col("n")))
    first = Window.partitionBy("l").orderBy("h", "i")
    ids = checked_broadcast(durable(rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_lang).select("i").distinct()))
    picked = docs.filter(lang.isNotNull() & ~held_out(doc)).select(doc.alias("i"), lang.cast("string").alias("l"), F.col(f"`{text_col}`").alias("t"))
    sample = picked.join(ids, "i", "left_semi").toPandas().sort_values(["l", "i", "t"])
    sample = sample[np.array([has_letter(t) for t in sample["t"]], dtype=bool)]
    return HierarchicalModel(sample["t"].tolist(), sample["l"].tolist())


def predicting(model: HierarchicalModel) -> Callable:
    """Batches of texts to batches of (lang, score), a few texts at a time."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one_blas_thread()
        drop_kept()
        give_back()
        for texts in batches:
            lang, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            for at in range(0, len(known), 32):
                part = known[at : at + 32]
                lang[part], score[part] = model.predict([texts.iloc[i] for i in part])
            yield pd.DataFrame({"lang": lang, "score": score})
            del texts
            give_back()

    return run


def predict_column(model: HierarchicalModel, text: Column) -> Column:
    """struct<lang: string, score: double> of each text; ``und`` and 0 where the text is null or has no letter."""
    return F.pandas_udf(predicting(model), "struct<lang: string, score: double>")(text.cast("string"))


def identify(docs: DataFrame, model: HierarchicalModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``; the model is trained on ``docs`` unless one is given.

    Null, empty and letterless texts are ``und`` with score 0; so is everything where no labelled row can be learnt from. Null identifiers are
    held out. Repeated rows each get their (equal) prediction. An empty table gives an empty result. Labels, sources and identifiers are
    never inputs of a prediction.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    doc = F.col(f"`{id_col}`")
    out = docs.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), predict_column(model, F.col(f"`{text_col}`")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST, sure: float = SURE) -> DataFrame:
    """The rows of ``docs`` whose language is identified, in the same columns; ``lang_col`` has the predicted language where it was null, and where a prediction
    with a score of at least ``sure`` contradicts it.

    Null and letterless texts go, and so do texts with a score below ``least``, which neither a family nor a language in it stands out for.
    Where no labelled row can be learnt from, nothing can be identified: rows with a letter stay as they are.
    """
    model, text, lang = train(docs, id_col, text_col, lang_col), F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    if not model.langs:
        return docs.filter(_letter_column(text))
    (p,) = fresh(docs, "identified")
    known = docs.withColumn(p, predict_column(model, text)).filter((F.col(p)["lang"] != UNDETERMINED) & (F.col(p)["score"] >= least))
    label = F.when(lang.isNull() | (F.col(p)["score"] >= sure), F.col(p)["lang"]).otherwise(lang).cast(docs.schema[lang_col].dataType)
    return known.select(*[label.alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns])


def _letter_column(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([has_letter(t) for t in texts], dtype=bool)

    return run(text.cast("string"))
