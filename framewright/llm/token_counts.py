"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A text's pre-tokens are its words, each with the word-start mark. The distinct ones of a batch go into a trie; the best
segmentation score of a prefix depends on the prefix alone, so the forward pass computes it once for each node, level by level, and
pre-tokens that share a prefix share its scores. A word's count is stored at its terminal node, and kept for later batches of the same worker.

The vocabulary file holds pieces by rank, not probabilities: a piece of rank r scores -ln(r + 2.7) less the logarithm of the sum (Zipf's law).
A character that no piece covers falls back to its UTF-8 bytes, one token each. Of equally good segmentations the one with fewer tokens counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, split_words, task

MARK = "▁"
#: Score of one fallback byte: rarer than any piece.
BYTE_PENALTY = 4.0
CACHE_WORDS = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces and their scores, looked up by hash of their characters."""

    def __init__(self, pieces: dict[str, float], byte_score: float) -> None:
        self.pieces, self.byte_score = pieces, byte_score
        self.longest = max(map(len, pieces), default=1)
        h = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(h)
        self.keys, self.scores = h[order], np.array(list(pieces.values()))[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.seen = np.zeros(1 << 22, dtype=bool)  # most lookups end here
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(_P)) & 0xFFFFFFFFFFFFFFFF
        return h

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Scores of hashes, -inf where no piece has it."""
        out = np.full(h.shape, -np.inf)
        i = np.nonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        if len(i[0]) and len(self.keys):
            q = h[i]
            at = np.minimum(np.searchsorted(self.keys, q), len(self.keys) - 1)
            hit = self.keys[at] == q
            out[tuple(x[hit] for x in i)] = self.scores[at[hit]]
        return out


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    raw = -np.log(np.arange(len(names)) + 2.7)
    scores = raw - np.log(np.exp(raw).sum())
    return Vocabulary(dict(zip(names, scores.tolist())), float(scores.min() - BYTE_PENALTY))


def trie_counts(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, score) of each distinct pre-token, and the number of trie nodes. Cost follows the nodes, not the words' total length."""
    words_ = [MARK + w for w in words]
    size = np.array([len(w) for w in words_], dtype=np.int64)
    chars = np.frombuffer("".join(words_).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    starts = np.cumsum(size) - size
    length = vocab.longest
    tokens, score = np.zeros(len(words_), dtype=np.int64), np.zeros(len(words_))
    # The state of a level: for each node, rolling hashes of its last 1..length characters, and scores and counts of its ancestors.
    node = np.zeros(len(words_), dtype=np.int64)
    hashes = np.zeros((1, length), dtype=np.uint64)
    best, count = np.full((1, length), -np.inf), np.zeros((1, length), dtype=np.int64)
    best[:, 0], total = 0.0, 0
    live = np.arange(len(words_))
    for depth in range(int(size.max(initial=0))):
        live = live[size[live] > depth]
        key = node[live] << 21 | chars[starts[live] + depth]
        distinct, inverse = np.unique(key, return_inverse=True)
        parent, c = distinct >> 21, distinct & 0x1FFFFF
        # The suffix of length n ends here: the parent's suffix of length n - 1 and this character.
        h = np.empty((len(distinct), length), dtype=np.uint64)
        code = (c + 1).astype(np.uint64)
        h[:, 0] = code * _P
        h[:, 1:] = (hashes[parent, : length - 1] + code[:, None]) * _P
        reach = min(length, depth + 1)
        piece = vocab.look_up(h[:, :reach])
        ahead, steps = best[parent][:, :reach], count[parent][:, :reach]
        cand = piece + ahead
        bytes_ = np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))
        fall, fall_n = best[parent, 0] + bytes_ * vocab.byte_score, count[parent, 0] + bytes_
        top = np.maximum(cand.max(axis=1), fall)
        fewest = np.where(cand >= top[:, None], steps + 1, np.iinfo(np.int64).max).min(axis=1)
        fewest = np.where(fall >= top, np.minimum(fewest, fall_n), fewest)
        best = np.concatenate([top[:, None], best[parent, : length - 1]], axis=1)
        count = np.concatenate([fewest[:, None], count[parent, : length - 1]], axis=1)
        hashes, total = h, total + len(distinct)
        node[live] = inverse
        done = live[size[live] == depth + 1]
        tokens[done], score[done] = fewest[node[done]], top[node[done]]
    return tokens, score, total


class Counter:
    """Counts of pre-tokens that a worker has met."""

    def __init__(self, path: str) -> None:
        self.vocab, self.known = load_vocabulary(path), {}

    def count(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        split = [split_words(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = sorted(set().union(*(set(w).difference(self.known) for w in split))) if split else []
        if new:
            n, s, _ = trie_counts(new, self.vocab)
            self.known.update(zip(new, zip(n.tolist(), s.tolist())))
        get, out = self.known.__getitem__, []
        for words in split:
            pairs = list(map(get, words))
            out.append((len(words), sum(p[0] for p in pairs), float(sum(p[1] for p in pairs))))
        return out


def counter(path: str) -> Counter:
    return kept(("counter", path), lambda: Counter(path))


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_pretokens, n_tokens, log_prob (of the best segmentations).

    Null and blank texts have no tokens. Null identifiers stay null, repeated rows get equal counts, other columns are ignored, and an empty
    table gives an empty result. Words of any length are counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path).count
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                rows = count(b.column(1).slice(lo, 1024).to_pylist())
                n, t, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 1024), pa.array(n, pa.int64()), pa.array(t, pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(task(run), "doc_id long, n_pretokens long, n_tokens long, log_prob double")
