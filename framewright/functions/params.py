"""Plan-time checks and settings: plain Python, run on the driver before a plan is built."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import LIMITS, MediaError, within
from .pixels import CLIP_MEAN, CLIP_STD, to_bytes

_log = logging.getLogger("framewright")
VISION_DEFAULTS = {"min_pixels": 56 * 56, "max_pixels": 28 * 28 * 1280, "patch_size": 14, "merge_size": 2, "temporal_patch_size": 2, "mean": CLIP_MEAN, "std": CLIP_STD}


def vision_params(**overrides) -> dict:
    """Settings of the vision-language patches: overrides over defaults, checked.

    ``size`` with shortest_edge and longest_edge sets the pixel bounds; one number for mean or std counts for all channels; steps can't be switched off;
    unknown names are logged and left out.
    """
    out = dict(VISION_DEFAULTS)
    for name, value in overrides.items():
        if value is None:
            continue
        if name == "size":
            out["min_pixels"], out["max_pixels"] = value.get("shortest_edge", out["min_pixels"]), value.get("longest_edge", out["max_pixels"])
        elif name.startswith("do_"):
            if not value:
                raise MediaError(f"{name} can't be switched off")
        elif name in out:
            out[name] = (float(value),) * 3 if name in ("mean", "std") and np.isscalar(value) else value
        else:
            _log.warning("setting %s is not supported", name)
    if len(out["mean"]) != 3 or len(out["std"]) != 3 or min(out["std"]) <= 0:
        raise MediaError("mean and std have three values, and std is above 0")
    if out["temporal_patch_size"] != 2:
        raise MediaError("temporal patches are of two frames")
    if not LIMITS["qwen_min_pixels"] <= out["min_pixels"] <= out["max_pixels"] <= LIMITS["qwen_max_pixels"]:
        raise MediaError("the pixel bounds are out of range")
    return out


def frame_lists(frames) -> list[list[np.ndarray]]:
    """One frame, a list of frames or a list of lists as a list of lists of byte images."""
    if isinstance(frames, np.ndarray):
        frames = [[frames]] if frames.ndim == 3 else [list(frames)] if frames.ndim == 4 else frames
    elif frames and isinstance(frames[0], np.ndarray):
        frames = [list(f) if f.ndim == 4 else [f] for f in frames]
    out = [[np.ascontiguousarray(f if f.dtype == np.uint8 else f.astype(np.uint8)) for f in item] for item in frames]
    for item in out:
        for f in item:
            if f.ndim != 3 or f.shape[2] != 3:
                raise MediaError("a frame is height x width x 3")
    return out


def selection_inputs(query: str, n_frames: int, sample_num: int) -> int:
    """The number of frames to select, at most as many as there are."""
    if not isinstance(query, str) or not query.strip():
        raise MediaError("the query is empty")
    if n_frames < 1:
        raise MediaError("there are no frames")
    if not isinstance(sample_num, int) or isinstance(sample_num, bool) or sample_num < 1:
        raise MediaError("the number of frames to select is a positive integer")
    return min(sample_num, n_frames)


def tile_params(size: int = 448, min_num: int = 1, max_num: int = 12) -> tuple[int, int, int]:
    within("tile_side", size)
    least, most_min, most = LIMITS["tiles"]
    if not (least <= min_num <= most_min and min_num <= max_num <= most):
        raise MediaError("the numbers of tiles are out of range")
    return size, min_num, max_num


def match_score(no: Column, yes: Column) -> Column:
    """Second entry of the softmax of two logits."""
    top = F.greatest(no, yes)
    return F.exp(yes - top) / (F.exp(no - top) + F.exp(yes - top))


def retry(call: Callable, times: int = 3, wait: float = 0.2, most: float = 2.0):
    """Call again after a failure, waiting twice as long each time; for calls to services outside Spark, whose own tasks are retried anyway."""
    for n in range(times + 1):
        try:
            return call()
        except Exception:
            if n == times:
                raise
            time.sleep(min(most, wait * 2**n))


def model_column(load: Callable[[], Callable[[list], list]], schema: str, batch: int = 16) -> Callable[[Column], Column]:
    """A column from a model that the caller supplies: ``load`` runs once for each worker task and gives a function from a list of values to a list of results."""

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for values in batches:
            rows = values.to_dict("records") if isinstance(values, pd.DataFrame) else values.tolist()
            yield pd.Series([y for i in range(0, len(rows), batch) for y in model(rows[i : i + batch])], dtype=object)

    return run


__all__ = ["frame_lists", "match_score", "model_column", "retry", "selection_inputs", "tile_params", "to_bytes", "vision_params"]
