"""Counts over the whole corpus, looked up for each document without broadcasting them.

Documents are dealt into blocks by a hash. A block sends, for each shard of the key space, one message: its distinct
keys in sorted order with their counts in the block. A shard adds up the counts of all messages and answers each of
them in the same order. A block then gets its answers and its documents together. A key that is in every document is
sent once per block, so that a hot key costs what others do; nothing that grows with the corpus is held in one place:
a block has about BLOCK_BYTES of text, a shard the keys of about SHARD_BYTES, more where tasks have more memory.

Keys are the leading bits of 64-bit hashes: the shard's number and FINGERPRINT further bits. With some 2 million keys in
a shard, a key that isn't there is taken for one that is in 1 of 500,000 lookups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of a block and of a shard for each TASK_MB of memory that a core has.
BLOCK_BYTES, SHARD_BYTES, TASK_MB = 4 << 20, 8 << 20, 1024
FINGERPRINT = 40
ESCAPE = (1 << 32) - 1

# The multipliers of the splitmix64 finaliser, and an odd base for positions.
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20260101).integers(1, 1 << 64, 256, dtype=np.uint64)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of words: digits, letters, and all of other alphabets; or everything but white space.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def combine(*parts: np.ndarray) -> np.ndarray:
    """A hash of sequences, from the hashes of their members in order."""
    total = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        total = mix(total * _BASE + p)
    return total


def word_hashes(texts: list[str], is_word: np.ndarray = ALNUM, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, lower-cased in A-Z, and for each text the number of its words."""
    hashes, counts, part, size = [], [], [], 0

    def flush() -> None:
        nonlocal part, size
        if not part:
            return
        raw = np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8)
        inside = is_word[raw]
        at = np.flatnonzero(inside)
        first = np.flatnonzero(inside[at] & np.r_[True, np.diff(at) > 1]) if len(at) else at
        ends = np.cumsum([len(p) + 1 for p in part])
        counts.append(np.diff(np.r_[0, np.searchsorted(at[first], ends)]))
        if len(first):
            lengths = np.diff(np.r_[first, len(at)])
            offset = np.arange(len(at)) - np.repeat(first, lengths)
            power = np.full(int(lengths.max()), _BASE, dtype=np.uint64)
            power[0] = 1
            value = _BYTE[FOLD[raw[at]]] * np.multiply.accumulate(power)[offset]
            hashes.append(mix(np.add.reduceat(value, first) + lengths.astype(np.uint64)))
        part, size = [], 0

    for t in texts:
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        part.append(raw)
        size += len(raw)
        if size >= chunk:
            flush()
    flush()
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate(hashes) if hashes else empty, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def windows(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every k consecutive words of a text, and the position of its text. Texts are not crossed."""
    n = len(hashes) - k + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = owner[:n] == owner[k - 1 :]
    return combine(*[hashes[j : j + n] for j in range(k)])[inside], owner[:n][inside]


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0)


def task_scale(spark: SparkSession) -> float:
    """How many times TASK_MB a core of an executor has: blocks and shards grow with it.

    A block sends a message to each shard, so that their number grows with the square of the input over the product of
    the two sizes; larger tasks keep messages large on a large input.
    """
    told = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get("spark.executor.memory", "1g").strip().lower())
    mb = int(told[1]) * {"k": 2**-10, "m": 1, "g": 2**10, "t": 2**20, "": 2**-20}[told[2]] if told else 0
    return min(64.0, max(1.0, mb / int(spark.conf.get("spark.executor.cores", "1") or 1) / TASK_MB))


def block_of(n_bytes: int, scale: float, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(max(1, -int(-n_bytes // (scale * BLOCK_BYTES)))).cast("bigint"))


def shard_bits(n_bytes: int, scale: float = 1.0) -> int:
    return max(1, -int(-n_bytes // (scale * SHARD_BYTES)) - 1).bit_length()


def shorten(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits - FINGERPRINT)


def _planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones, and so on, compressed: leading bytes are nearly alike."""
    return press(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(unpress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack(sorted_keys: np.ndarray) -> bytes:
    """Differences of a sorted list as 32-bit numbers; a larger one is preceded by escapes."""
    gaps = np.diff(np.r_[np.uint64(0), sorted_keys])
    over = gaps // np.uint64(ESCAPE)
    out = np.full(len(gaps) + int(over.sum()), ESCAPE, dtype=np.uint32)
    out[np.cumsum(over.astype(np.int64) + 1) - 1] = (gaps % np.uint64(ESCAPE)).astype(np.uint32)
    return _planes(out)


def unpack(data: bytes) -> np.ndarray:
    raw = _from_planes(data, np.uint32)
    return np.cumsum(raw, dtype=np.uint64)[raw != ESCAPE]


def pack_whole(sorted_keys: np.ndarray) -> bytes:
    """The same for numbers of 64 bits."""
    return _planes(np.diff(np.r_[np.uint64(0), sorted_keys]))


def unpack_whole(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint64), dtype=np.uint64)


def small(values: np.ndarray) -> bytes:
    """Whole numbers in the smallest width that holds them, which leads."""
    most = int(values.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def large(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], dtype=f"<u{data[0]}").astype(np.int64)


def press(data: bytes) -> bytes:
    """Compressed: counts and codes are mostly the same few values, which the shuffle's own codec packs less well."""
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def cut(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The shards of sorted keys, with the slice of each."""
    shard = (keys >> np.uint64(FINGERPRINT)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(keys) else []
    for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
        yield int(shard[a]), slice(int(a), int(b))


def local_keys(keys: np.ndarray) -> np.ndarray:
    return keys & np.uint64((1 << FINGERPRINT) - 1)


def groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of equal keys, from frames that are sorted by them."""
    held: list[pd.DataFrame] = []
    last = None
    for f in frames:
        for key, part in f.groupby(keys, sort=False):
            if key != last and held:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
            last = key
    if held:
        yield pd.concat(held, ignore_index=True)
