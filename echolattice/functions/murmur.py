"""MurmurHash3 in its published variants. Over a batch, words are mixed in numpy and the values of a batch are chained side by side."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M32, _M64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def _rotl(x: int, r: int, bits: int) -> int:
    return ((x << r) | (x >> (bits - r))) & ((1 << bits) - 1)


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """x86, 32 bits, as a signed number."""
    h, n = seed & _M32, len(data)
    mix = lambda k: (_rotl(k * 0xCC9E2D51 & _M32, 15, 32) * 0x1B873593) & _M32
    for (k,) in struct.iter_unpack("<I", data[: n & ~3]):
        h = (_rotl(h ^ mix(k), 13, 32) * 5 + 0xE6546B64) & _M32
    if n & 3:
        h ^= mix(int.from_bytes(data[n & ~3 :], "little"))
    h ^= n
    for factor, shift in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
        h = ((h ^ (h >> shift)) * factor) & _M32
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def murmur3_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """x64, 128 bits, as two signed numbers."""
    c1, c2, n = 0x87C37B91114253D5, 0x4CF5AD432745937F, len(data)
    h1 = h2 = seed & _M32
    k_one = lambda k: (_rotl(k * c1 & _M64, 31, 64) * c2) & _M64
    k_two = lambda k: (_rotl(k * c2 & _M64, 33, 64) * c1) & _M64
    whole = n & ~15
    for a, b in struct.iter_unpack("<QQ", data[:whole]):
        h1 = (((_rotl(h1 ^ k_one(a), 27, 64) + h2) & _M64) * 5 + 0x52DCE729) & _M64
        h2 = (((_rotl(h2 ^ k_two(b), 31, 64) + h1) & _M64) * 5 + 0x38495AB5) & _M64
    tail = data[whole:]
    if len(tail) > 8:
        h2 ^= k_two(int.from_bytes(tail[8:], "little"))
    if tail:
        h1 ^= k_one(int.from_bytes(tail[:8], "little"))
    h1, h2 = h1 ^ n, h2 ^ n
    h1 = (h1 + h2) & _M64
    h2 = (h2 + h1) & _M64

    def finish(k: int) -> int:
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            k = ((k ^ (k >> 33)) * factor) & _M64
        return k ^ (k >> 33)

    h1, h2 = finish(h1), finish(h2)
    h1 = (h1 + h2) & _M64
    h2 = (h2 + h1) & _M64
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(h1), signed(h2)


def file_window(content: bytes) -> bytes:
    """The bytes of a file that are hashed: at most 65,536 from its middle, from a multiple of 8,192 on."""
    start = len(content) // 2 // 8192 * 8192
    return content[start : start + 65_536]


def _mixed(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(0xCC9E2D51)
    return ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)


def murmur3_32_many(values: list[bytes], seed: int = 0, at_once: int = 1 << 21) -> np.ndarray:
    """:func:`murmur3_32` of each value: those of a group (at most ``at_once`` words, longest first) go through their words together; the last few that are still running are chained as plain numbers."""
    size = np.array([len(v) for v in values], np.int64)
    words = size // 4
    order = np.argsort(-words, kind="stable")
    out = np.empty(len(values), np.int32)
    begin = 0
    while begin < len(order):
        width = int(words[order[begin]])
        group = order[begin : begin + max(1, at_once // max(width, 1))]
        begin += len(group)
        k = np.zeros((len(group), width), np.uint32)
        for row, i in enumerate(group):
            k[row, : words[i]] = np.frombuffer(values[i], "<u4", int(words[i]))
        k = np.ascontiguousarray(_mixed(k).T)
        h = np.full(len(group), seed & _M32, np.uint32)
        running = np.searchsorted(-words[group], -np.arange(width), "left")  # rows with more than j words
        few = int(np.searchsorted(-running, -7, "left"))  # from there on fewer than eight
        for j in range(few):
            n = running[j]
            x = h[:n] ^ k[j, :n]
            h[:n] = ((x << np.uint32(13)) | (x >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        for row in range(int(running[few]) if few < width else 0):
            x = int(h[row])
            for w in k[few : words[group[row]], row].tolist():
                x ^= w
                x = (((x << 13) | (x >> 19)) * 5 + 0xE6546B64) & _M32
            h[row] = x
        rest = np.array([int.from_bytes(values[i][size[i] & ~3 :], "little") for i in group], np.uint32)
        h ^= np.where(rest > 0, _mixed(rest), np.uint32(0))
        h ^= size[group].astype(np.uint32)
        for factor, shift in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        out[group] = (h ^ (h >> np.uint32(16))).view(np.int32)
    return out


def _batch(values: pd.Series, of_bytes, absent: int | None, seed: int = 0) -> pd.Series:
    data = [None if v is None else of_bytes(v.encode() if isinstance(v, str) else bytes(v)) for v in values]
    known = np.array([v is not None for v in data], bool)
    out = pd.Series(np.zeros(len(data), np.int32), dtype="Int32")
    out[known] = murmur3_32_many([v for v in data if v is not None], seed)
    out[~known] = pd.NA if absent is None else absent
    return out


def murmur32(x: Column, seed: int = 0) -> Column:
    """Of a binary or (as UTF-8) a string column; null for null."""

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        return _batch(values, lambda v: v, None, seed)

    return run(x)


def file_hash(content: Column) -> Column:
    """Hash of a file's content; 0 where it can't be read (null)."""

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        return _batch(values, file_window, 0)

    return run(content)
