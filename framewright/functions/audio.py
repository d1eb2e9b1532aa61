"""Audio kernels: WAV container, sample formats, mixing, resampling and chunks."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from ..types import LIMITS, MediaError, within


def pcm_to_float(raw: bytes, bits: int) -> np.ndarray:
    """Little-endian signed samples of 16, 24 or 32 bits as floats in -1..1."""
    if bits == 16:
        x = np.frombuffer(raw, "<i2").astype(np.float32) * np.float32(2**-15)
    elif bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = ((v ^ 0x800000) - 0x800000).astype(np.float32) * np.float32(2**-23)
    elif bits == 32:
        x = np.frombuffer(raw, "<i4").astype(np.float32) * np.float32(2**-31)
    else:
        raise MediaError(f"PCM of {bits} bits")
    return np.clip(x, -1, 1)


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, frames x channels). Chunks are walked without their padding byte; PCM 16/24/32 and float 32 are read."""
    if len(data) > LIMITS["file_bytes"]:
        raise MediaError("the file is too large")
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise MediaError("not a WAVE file")
    pos, fmt = 12, None
    while pos + 8 <= len(data):
        name, size = data[pos : pos + 4], struct.unpack_from("<I", data, pos + 4)[0]
        pos += 8
        if name == b"fmt ":
            if size < 16:
                raise MediaError("short format chunk")
            fmt = struct.unpack_from("<HHIIHH", data, pos)
        elif name == b"data":
            if fmt is None:
                raise MediaError("samples before their format")
            kind, channels, rate, _, _, bits = fmt
            raw = data[pos : pos + size]
            raw = raw[: len(raw) // (channels * bits // 8) * (channels * bits // 8)]
            if kind == 1:
                x = pcm_to_float(raw, bits)
            elif kind == 3 and bits == 32:
                x = np.frombuffer(raw, "<f4").copy()  # not clamped
            else:
                raise MediaError(f"WAVE format {kind} with {bits} bits")
            return rate, x.reshape(-1, channels)
        pos += size
    raise MediaError("no samples")


def to_mono(x: np.ndarray) -> np.ndarray:
    """Mean of the channels."""
    return x[:, 0] if x.shape[1] == 1 else (x.sum(axis=1, dtype=np.float32) * np.float32(1 / x.shape[1])).astype(np.float32)


@lru_cache(maxsize=32)
def _filters(up: int, down: int, half: int = 64, beta: float = 14.0) -> tuple[np.ndarray, int]:
    cut = 0.95 * min(1.0, up / down)
    taps = int(np.ceil(half / cut))
    phase = np.arange(up)[:, None] / up
    t = np.arange(-taps + 1, taps + 1)[None, :] - phase
    w = np.i0(beta * np.sqrt(np.clip(1 - (t / taps) ** 2, 0, 1))) / np.i0(beta)
    h = cut * np.sinc(cut * t) * w
    return h / h.sum(axis=1, keepdims=True), taps


#: So many outputs that follow each other are one matrix product.
_GROUP = 80


@lru_cache(maxsize=32)
def _banks(up: int, down: int) -> tuple[list[tuple[int, int, np.ndarray]], int]:
    """The filters of a period of ``up`` outputs (``down`` inputs) in groups: (first output, first input, inputs x outputs), and the taps. About as large as the filters."""
    h, taps = _filters(up, down)
    out = []
    for lo in range(0, up, _GROUP):
        o = np.arange(lo, min(up, lo + _GROUP))
        first = o * down // up - lo * down // up
        m = np.zeros((first[-1] + 2 * taps, len(o)))
        m[first[:, None] + np.arange(2 * taps)[None, :], np.arange(len(o))[:, None]] = h[o * down % up]
        out.append((lo, lo * down // up, m))
    return out, taps


def resample(x: np.ndarray, rate: int, target: int | None) -> np.ndarray:
    """Windowed-sinc resampling to ceil(n * target / rate) samples, by phases; no target copies."""
    if target is None:
        return x.copy()
    within("sample_rate", target)
    if rate == target or not len(x):
        return x.astype(np.float32)
    g = np.gcd(rate, target)
    up, down = int(target // g), int(rate // g)
    n = -(-len(x) * target // rate)
    banks, taps = _banks(up, down)
    periods, most = -(-n // up), max(1, (1 << 14) // _GROUP)
    # Output o needs the 2 * taps inputs from o * down // up + 1 on.
    padded = np.zeros(max(taps + len(x), (periods - 1) * down + max(at + len(m) for _, at, m in banks)) + 1)
    padded[taps : taps + len(x)] = x
    out = np.empty(periods * up, np.float32)
    by_period = out.reshape(periods, up)
    for lo, at, m in banks:
        used = max(0, -(-(n - lo) // up))
        for p in range(0, used, most):
            some = min(most, used - p)
            windows = np.lib.stride_tricks.as_strided(padded[p * down + at + 1 :], (some, len(m)), (down * padded.itemsize, padded.itemsize), writeable=False)
            by_period[p : p + some, lo : lo + m.shape[1]] = np.ascontiguousarray(windows) @ m
    return out[:n].copy()


def load(data: bytes, target: int | None = None) -> tuple[int, np.ndarray]:
    """(rate, mono samples); the rate is the one asked for, if any."""
    rate, x = parse_wav(data)
    return target or rate, resample(to_mono(x), rate, target)


def chunks(x: np.ndarray, rate: int = 16000, length: float = 30, least: float = 1) -> list[tuple[float, float, np.ndarray]]:
    """(start, end, samples) of fixed length; a tail shorter than ``least`` seconds goes, a longer one is filled with zeros but keeps its true end."""
    size, out = int(length * rate), []
    for at in range(0, len(x), size):
        part = x[at : at + size]
        if len(part) < least * rate:
            break
        out.append((at / rate, (at + len(part)) / rate, np.pad(part, (0, size - len(part)))))
    return out
