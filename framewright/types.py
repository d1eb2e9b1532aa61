"""Schemas, enumerations, limits and errors of the data model."""

from __future__ import annotations

from enum import Enum, IntEnum

TENSOR = "struct<shape: array<int>, dtype: string, format: string, data: binary>"
IMAGE = "struct<origin: string, height: int, width: int, nChannels: int, format: string, data: binary>"
AUDIO = "struct<sample_rate: int, samples: array<float>>"
POINT_DOC = "struct<text: string, ts: double>"
SPAN_DOC = "struct<text: string, start: double, end: double>"
INTERVAL = "struct<left: int, cand: int, right: int>"
QUERY = "det struct<scene_desc: array<string>, class_names: array<string>, loc: boolean, num: boolean, rel: boolean, scene_occurrence_count: boolean>, sub struct<relevant_subtitles: array<string>, retrieve_related_frames: boolean>"


class DataType(IntEnum):
    FLOAT32, INT8, UINT8, CHAR = 0, 2, 4, 13


class Layout(IntEnum):
    NCHW, NHWC, ND = 0, 1, 2


class ImageFormat(IntEnum):
    RGB, BGR, RGB_PLANAR, BGR_PLANAR, UNDEFINED = 12, 13, 69, 70, -1


class Family(Enum):
    DATA_CHECK, RESOURCE, OPEN_SOURCE, THIRD_PARTY, RUNTIME = range(5)


class MediaError(ValueError):
    """An error with its family; raised when a plan is built if it can be checked there, else by the kernel."""

    def __init__(self, message: str, family: Family = Family.DATA_CHECK) -> None:
        super().__init__(message)
        self.family = family


#: (least, most) or most, as the names say.
LIMITS = {
    "image_side": (10, 8192),
    "file_bytes": 50 << 20,
    "image_suffix": ("jpg", "jpeg"),
    "video_side": (480, 4096),
    "sample_rate": (1, 64000),
    "audio_files": 128,
    "path_length": 4096,
    "qwen_side": (10, 4096),
    "qwen_min_pixels": 100,
    "qwen_max_pixels": 4096**2,
    "tile_side": (10, 8192),
    "tiles": (1, 4, 32),
    "compress_tokens": 8192,
    "batch": (1, 1024),
    "depth": (2, 128),
}


def within(name: str, *values: int) -> None:
    low, high = LIMITS[name][0], LIMITS[name][-1]
    for v in values:
        if not low <= v <= high:
            raise MediaError(f"{name}: {v} is not within {low} to {high}")
