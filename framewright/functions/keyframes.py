"""Greedy keyframe selection: order-dependent loops over the frames of one item, in numpy."""

from __future__ import annotations

import numpy as np

from .sequences import int_linspace

DECAY, STAGE, STAGE_STEP, APART = 0.01, 0.03, 0.0015, 0.3


def cosine(query: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """Similarity of each frame with the query, in single precision."""
    f, q = frames.astype(np.float32), query.astype(np.float32)
    return (f @ q) / np.maximum(np.linalg.norm(f, axis=1) * np.linalg.norm(q), np.float32(1e-8))


def find_boundary(frames: np.ndarray, at: int, left: bool, jump: float = 0.015, step: int = 10, span: int = 300) -> int:
    """Where the scene of frame ``at`` ends on one side.

    Blocks of ``step`` frames are read in ascending order on both sides, each behind the value carried from the block before (1 at first): the last
    similarity of the block on the left, the first on the right. The boundary is the last jump on the left and the first on the right.
    """
    n = len(frames)
    if left and at <= 0:
        return 0
    if not left and at >= n - 1:
        return n - 1
    carried, pos = 1.0, at - 1 if left else at + 1
    for _ in range(-(-span // step)):
        lo, hi = (max(0, pos - step + 1), pos + 1) if left else (pos, min(n, pos + step))
        if hi <= lo:
            break
        sims = cosine(frames[at], frames[lo:hi])
        hit = np.flatnonzero(np.abs(np.diff(np.append(np.float32(carried), sims))) > jump)
        if len(hit):
            return lo + int(hit[-1] if left else hit[0])
        carried, pos = float(sims[-1] if left else sims[0]), pos + (-step if left else step)
    return 0 if left else n - 1


def diverse_intervals(sims: np.ndarray, frames: np.ndarray, budget: int, drop: float = 0.025, jump: float = 0.015, use_threshold: bool = True) -> list[tuple[int, int, int]]:
    """[left, candidate, right] of the best scenes, best first, until similarity falls below the floor or off the last candidate's."""
    n, taken, out = len(frames), np.zeros(len(frames), dtype=bool), []
    floor, last = None, 0.0
    while len(out) < max(1, budget) and not taken.all():
        free = np.flatnonzero(~taken)
        at = int(free[sims[free].argmax()])
        if floor is None:
            floor = sims[at] - drop
        else:
            if use_threshold and (sims[at] < floor or sims[at] < last):
                break
            last = sims[at] - DECAY
        lo, hi = find_boundary(frames, at, True, jump), find_boundary(frames, at, False, jump)
        out.append((max(0, lo), at, min(hi, n - 1)))
        taken[lo : hi + 1] = True
    return out


def merge_intervals(intervals: list[tuple[int, ...]], sims: np.ndarray, gap: int = 30, alike: float = 0.015) -> list[tuple[int, int]]:
    """Intervals that lie within ``gap`` of each other and whose mean similarities differ by less than ``alike`` become one; in order of first appearance."""
    spans = [(min(i), max(i)) for i in intervals]
    mean = [float(sims[lo : hi + 1].mean()) for lo, hi in spans]
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], i))
    root = list(range(len(spans)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    begin = 0
    for k, i in enumerate(order):
        while begin < k and spans[order[begin]][1] + gap < spans[i][0]:
            begin += 1
        for j in order[begin:k]:
            if spans[i][0] <= spans[j][1] + gap and abs(mean[i] - mean[j]) < alike:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups: dict[int, list[int]] = {}
    for i in range(len(spans)):
        groups.setdefault(find(i), []).append(i)
    return [(min(spans[i][0] for i in g), max(spans[i][1] for i in g)) for _, g in sorted(groups.items())]


def quota(length: int) -> int:
    return 12 if length >= 30 else 6


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest, ties by place."""
    return np.argsort(-sims, kind="stable")[:k]


def resample_interval(interval: tuple[int, ...], sims: np.ndarray, most: int, top_ratio: float = 0.4) -> list[int]:
    """Up to ``most`` frames of an interval: its ends, the most similar ones, and others evenly between."""
    own = set(interval)
    if not own:
        return []
    lo, hi = min(own), max(own)
    inside = sims[lo : hi + 1]
    if len(own) > most:
        return sorted(lo + int(i) for i in _top(inside, most))
    extra = most - len(own)
    free = [i for i in range(hi - lo + 1) if lo + i not in own]
    if extra <= 0 or not free:
        return sorted(own)
    picked = [free[i] for i in _top(inside[free], min(max(1, int(extra * top_ratio)), len(free)))]
    rest, pool = extra - len(picked), [i for i in free if i not in set(picked)]
    if rest > 0 and pool:
        if rest >= len(free):
            picked += pool
        else:
            picked += [pool[i] for i in (int_linspace(0, len(pool) - 1, rest) if len(pool) > 1 else [0])]
    return sorted(own | {lo + i for i in picked})[:most]


def resample_all(intervals: list[tuple[int, ...]], sims: np.ndarray, budget: int) -> list[int]:
    """Frames of the intervals in order until the budget is used."""
    out: list[int] = []
    for i in intervals:
        out += resample_interval(i, sims, quota(max(i) - min(i) + 1))[: max(0, budget - len(out))]
        if len(out) >= budget:
            break
    return out


def range_keyframes(query: np.ndarray, frames: np.ndarray, budget: int, do_resample: bool = True) -> list[int]:
    """Scenes, merged, then resampled (or their midpoints), sorted and distinct."""
    sims = cosine(query, frames)
    merged = merge_intervals(diverse_intervals(sims, frames, min(budget, len(frames))), sims)
    return sorted(set(resample_all(merged, sims, budget) if do_resample else [(lo + hi) // 2 for lo, hi in merged]))


def diverse_keyframes(query: np.ndarray, frames: np.ndarray, budget: int, use_threshold: bool = False, jump: float = 0.015) -> list[int]:
    """The two best frames of the best scene, then the best of further scenes if it lies apart from all chosen ones."""
    sims = cosine(query, frames)
    n, taken, budget = len(frames), np.zeros(len(frames), dtype=bool), min(budget, len(frames))
    rough = round(float(np.abs(np.diff(sims)).mean()), 4) if n > 1 else 0.0
    first = int(sims.argmax())
    lo, hi = find_boundary(frames, first, True, jump), find_boundary(frames, first, False, jump)
    out = [lo + int(i) for i in _top(sims[lo : hi + 1], 2)]
    taken[lo : hi + 1] = True
    bar, stage = round(float(sims[first] - STAGE), 4), STAGE - STAGE_STEP
    while len(out) < budget and not taken.all():
        free = np.flatnonzero(~taken)
        at = int(free[sims[free].argmax()])
        if use_threshold and round(float(sims[at]), 4) < bar:
            break
        bar, stage = round(float(sims[at] - stage), 4), max(rough, stage - STAGE_STEP)
        lo, hi = find_boundary(frames, at, True, jump), find_boundary(frames, at, False, jump)
        if np.sqrt(((frames[out] - frames[at]) ** 2).sum(axis=1)).min() >= APART:
            out.append(at)
        taken[lo : hi + 1] = True
    return sorted(set(out))


def adaptive_segments(scores: np.ndarray, total: int = 24, depth: int = 5, flat: float = 0.05, spread: float = 0.0) -> list[int]:
    """Halve the frames while their best don't stand out (by the mean of the best less the mean, or no spread), sharing the quota; take each leaf's best."""
    out: list[int] = []

    def go(idx: np.ndarray, q: int, level: int) -> None:
        s = scores[idx]
        if level < depth and len(idx) > 1 and q // 2 > 0 and q < len(idx):
            top = np.sort(s)[::-1][:q].mean()
            if top - s.mean() <= flat or s.std() <= spread:
                half, left = len(idx) // 2, round(q / 2)
                go(idx[:half], left, level + 1)
                go(idx[half:], q - left, level + 1)
                return
        out.extend(idx[_top(s, q)].tolist())

    go(np.arange(len(scores)), total, 0)
    return sorted(out)
