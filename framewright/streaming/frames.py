"""Frames that change, and audio buckets, on unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_frames(stream: DataFrame, video: str = "video", index: str = "frame_idx", bits: str = "bits", threshold: int = 5) -> DataFrame:
    """Append-mode frames whose hash differs from the frame before by more than ``threshold`` bits, and each video's first.

    State is a video's last hash. Frames are ordered inside a micro-batch; a frame that arrives in a later batch than its successor is compared with that successor.
    """
    out = f"{video} {stream.schema[video].dataType.simpleString()}, {index} long"

    def run(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs)).sort_values(index)
        last = np.array(state.get[0], dtype=np.int64) if state.exists else None
        kept = []
        for i, b in zip(rows[index], rows[bits]):
            b = np.array(b, dtype=np.int64)
            if last is None or int(np.bitwise_count((b ^ last).view(np.uint64)).sum()) > threshold:
                kept.append((key[0], int(i)))
            last = b
        if last is not None:
            state.update((last.tolist(),))
        yield pd.DataFrame(kept, columns=[video, index])

    return stream.select(video, index, bits).groupBy(video).applyInPandasWithState(run, out, "last array<bigint>", "append", "NoTimeout")


def bucket_levels(stream: DataFrame, key: str, ts: str, value: str, length: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Tumbling buckets of a signal: count, mean and peak; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(key, F.window(ts, length)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(F.abs(value)).alias("peak"))
