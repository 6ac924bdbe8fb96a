"""Exchange between blocks of documents and shards of a table that fits in no single task.

A block of texts needs the weights of its own distinct n-grams only. It sends their 64-bit keys to shards, cut by the
key's value; each shard looks up or adds up what it holds and answers every block in the order it asked. A key travels
once for each block that has it, so no n-gram is hot, and nothing that grows with the corpus is broadcast or gathered.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    shifted = x >> U64(30)
    x = x ^ shifted  # the only copies; what follows is done in place
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, U64(27), out=shifted)
    x *= U64(0x94D049BB133111EB)
    x ^= np.right_shift(x, U64(31), out=shifted)
    return x


def follow(before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Key of an n-gram from the key of all but its last symbol and that symbol."""
    return mix(before * U64(0x9E3779B97F4A7C15) + symbol)


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where in sorted ``keys`` each shard begins, and the end; shards cut the range of keys evenly."""
    return np.searchsorted(((keys >> U64(32)) * U64(shards)) >> U64(32), np.arange(shards + 1, dtype=U64))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that the shuffle's compression takes the empty ones away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps."""
    return _planes(np.diff(keys, prepend=U64(0)).astype("<u8"))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, "<u8"), dtype=U64)


def pack_numbers(x: np.ndarray, kind: str = "<u4") -> bytes:
    return _planes(np.ascontiguousarray(x.astype(kind)))


def unpack_numbers(raw: bytes, kind: str = "<u4") -> np.ndarray:
    return _unplanes(raw, kind)


def own_place(docs: DataFrame) -> Column:
    """Number of a row in its file, which any job that reads the file finds again; 0 if ``docs`` do not come from files.

    It tells rows apart that repeat all their columns, so that blocks by hash do not put them together.
    """
    place = F.col("_metadata.row_index")
    try:
        docs.select(place)
    except AnalysisException:
        return F.lit(0)
    return place
