"""Token compression by cosine components, in numpy, for one item at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from ..types import MediaError


def adjacency(x: np.ndarray, tau: float = 0.95) -> np.ndarray:
    """Cosine above tau; a zero vector has no edge, not even with itself."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return u @ u.T > tau


def components(adj: np.ndarray) -> np.ndarray:
    """Component number of each node, in order of their smallest nodes."""
    n = len(adj)
    link = adj | adj.T | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.where(link, label[None, :], n).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return np.unique(label, return_inverse=True)[1]


def _anchors(n: int, edges: int, eps: float) -> np.ndarray:
    k = min(n, max(1, math.ceil(math.log(max(n, 2)) / eps**2)))
    return np.sort(np.random.default_rng(edges).choice(n, k, replace=False)) if k < n else np.arange(n)


def sampled_components(adj: np.ndarray, eps: float = 0.05) -> list[list[int]]:
    """Components found from min(n, ceil(ln n / eps^2)) anchors, sorted by their node of greatest degree; exact where all nodes are anchors."""
    n = len(adj)
    if not n:
        return []
    edges = int(adj.sum())
    anchors = _anchors(n, edges, eps)
    sub = np.zeros_like(adj)
    sub[anchors] = adj[anchors]
    lab, degree = components(sub), adj.sum(axis=1)
    groups = [np.flatnonzero(lab == c).tolist() for c in range(lab.max() + 1)]
    return sorted(groups, key=lambda g: (-max(degree[i] for i in g), g[0]))


def centers(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Mean of each component."""
    out = np.zeros((label.max() + 1 if len(label) else 0, x.shape[1]))
    np.add.at(out, label, x)
    return out / np.bincount(label, minlength=len(out))[:, None]


def merge_back(center: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each center averaged with the vectors nearest to it (by cosine, ties to the first center)."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = center / np.maximum(np.linalg.norm(center, axis=1, keepdims=True), 1e-12)
    step = max(1, BLOCK // max(1, len(c)))
    near = np.concatenate([np.zeros(0, np.int64), *[(u[at : at + step] @ c.T).argmax(axis=1) for at in range(0, len(u), step)]])
    out = center.astype(np.float64).copy()
    np.add.at(out, near, x)
    return out / (np.bincount(near, minlength=len(center)) + 1)[:, None]


#: Similarities are held for so many values (32 MB of doubles) at once, not for all pairs.
BLOCK = 4 << 20


def _links(x: np.ndarray, tau: float, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, adjacency of these rows with all) in blocks: those of ``rows``, or all."""
    x = x.astype(np.float64)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rows = np.arange(len(x)) if rows is None else rows
    step = max(1, BLOCK // max(1, len(x)))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        yield some, u[some] @ u.T > tau


def degrees(x: np.ndarray, tau: float = 0.95) -> np.ndarray:
    """Row sums of ``adjacency``."""
    out = np.zeros(len(x), dtype=np.int64)
    for some, adj in _links(x, tau):
        out[some] = adj.sum(axis=1)
    return out


def _component_labels(x: np.ndarray, tau: float, rows: np.ndarray | None = None) -> np.ndarray:
    """``components`` of the links of ``rows`` (all without), from blocks: each row takes in the components of its neighbours, named by their smallest nodes."""
    root = np.arange(len(x))
    for some, adj in _links(x, tau, rows):
        for i, near in zip(some, adj):
            own = root[near]
            if not len(own):
                continue
            least = min(int(own.min()), int(root[i]))
            if root[i] == least and (own == least).all():
                continue
            merged = np.zeros(len(x), dtype=bool)
            merged[own] = True
            merged[root[i]] = True
            root[merged[root]] = least
    return np.unique(root, return_inverse=True)[1]


def token_labels(x: np.ndarray, tau: float = 0.95, eps: float | None = None) -> np.ndarray:
    """Component of each token, of an item of any size: as ``components`` numbers them, or with ``eps`` as ``sampled_components`` does."""
    if eps is None or not len(x):
        return _component_labels(x, tau)
    degree = degrees(x, tau)
    anchors = _anchors(len(x), int(degree.sum()), eps)
    lab = _component_labels(x, tau, anchors)
    most = np.full(lab.max() + 1, -1)
    np.maximum.at(most, lab, degree)
    place = np.empty(len(most), dtype=np.int64)
    place[np.lexsort((np.arange(len(most)), -most))] = np.arange(len(most))
    return place[lab]


def compress_image(x: np.ndarray, tau: float = 0.95, eps: float | None = None) -> np.ndarray:
    return merge_back(centers(x, token_labels(x, tau, eps)), x)


def compress_video(x: np.ndarray, frames: int, tau: float = 0.95, eps: float | None = None) -> np.ndarray:
    """Centers frame by frame, then their components over time, then all tokens merged back."""
    if frames < 1 or len(x) % frames:
        raise MediaError("the tokens don't divide into frames")
    per = len(x) // frames
    parts = [x[i * per : (i + 1) * per] for i in range(frames)]
    c = np.concatenate([centers(p, token_labels(p, tau, eps)) for p in parts])
    return merge_back(centers(c, token_labels(c, tau, eps)), x)


def to_exact(center: np.ndarray, k: int, tau: float = 0.95) -> np.ndarray:
    """Exactly k vectors: those of greatest degree (ties to the first) take in the rest; too few are filled up with their mean."""
    if len(center) > k:
        degree = degrees(center, tau)
        keep = np.sort(np.argsort(-degree, kind="stable")[:k])
        rest = np.setdiff1d(np.arange(len(center)), keep)
        return merge_back(center[keep], center[rest])
    if len(center) < k:
        return np.concatenate([center, np.repeat(center.mean(axis=0, keepdims=True), k - len(center), axis=0)])
    return center


def target_size(n: int, ratio: float = 0.3) -> int:
    return max(1, math.ceil(n * ratio))


def gated(n: int, limit: int = 8192) -> bool:
    """Whether an item is left alone because its similarity matrix would be too large; a limit of 0 or less lets all pass."""
    return limit > 0 and n > limit
