"""Byte-level BPE by merge replay over a block of text.

A task takes its documents in blocks. The block's distinct pieces of text are laid end to end as one chain of byte
tokens, an inverted index leads from the merge of each pair of neighbouring tokens to its positions, and every merge is applied in
rank order to all its positions at once, touching only the neighbours of what has merged. Each distinct piece is
encoded once, however often it occurs.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encoder of pieces of text; ``ranks`` holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self._bytes = [ranks[bytes([b])] for b in range(256)]
        self._merged: dict[int, int] = {}

    def _merge_of(self, pair: int) -> int:
        """The token that two tokens (first << 24 | second) merge into, -1 for none; kept for the next time."""
        to = self._merged[pair] = self.ranks.get(self.tokens[pair >> 24] + self.tokens[pair & 0xFFFFFF], -1)
        return to

    def encode(self, pieces: Iterable[bytes]) -> list[list[int]]:
        """Token ids of each piece; merges never cross pieces."""
        chain: list[int] = []  # -1 stands after each piece
        starts = []
        for piece in pieces:
            starts.append(len(chain))
            whole = self.ranks.get(piece)
            chain += [whole] if whole is not None else [self._bytes[b] for b in piece]
            chain.append(-1)
        after = list(range(1, len(chain) + 1))
        before = list(range(-1, len(chain) - 1))
        index: dict[int, list[int]] = defaultdict(list)  # by the rank of the pair's merge
        known, merge_of = self._merged.get, self._merge_of
        a = -1
        for i, b in enumerate(chain):
            if a >= 0 and b >= 0:
                to = known(a << 24 | b)
                if to is None:
                    to = merge_of(a << 24 | b)
                if to >= 0:
                    index[to].append(i - 1)
            a = b
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            to = heapq.heappop(queue)
            places = index.pop(to, None)
            if places is None:
                continue
            places.sort()  # of overlapping places, the leftmost merges
            for n, i in enumerate(places):
                a, j = chain[i], after[i]
                b = chain[j]
                if a < 0 or b < 0 or known(a << 24 | b) != to:
                    continue
                k, h = after[j], before[i]
                chain[i], chain[j], after[i], before[k] = to, -2, k, i
                least = to + 1
                for at, pair in ((i, to << 24 | chain[k] if chain[k] >= 0 else -1), (h, chain[h] << 24 | to if h >= 0 and chain[h] >= 0 else -1)):
                    if pair >= 0:
                        new = known(pair)
                        if new is None:
                            new = merge_of(pair)
                        if new >= 0:
                            if new not in index:
                                heapq.heappush(queue, new)
                            index[new].append(at)
                            if new < least:
                                least = new
                if least <= to:  # a neighbour merges before the places that are left
                    if n + 1 < len(places):
                        index[to] += places[n + 1 :]
                        heapq.heappush(queue, to)
                    break
        out = []
        for i in starts:
            ids = []
            while chain[i] != -1:
                ids.append(chain[i])
                i = after[i]
            out.append(ids)
        return out


def encode_column(
    docs: DataFrame, text_col: str = "text", to: str = "ids", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN,
    block_chars: int = 4_000_000, kept_pieces: int = 500_000,
) -> DataFrame:
    """Add binary ``to`` (in place of a column of that name): the token ids of the whole text as little-endian unsigned
    32-bit integers.

    Each match of ``pattern`` is encoded separately. A null text counts as empty (no ids). A task holds about
    ``block_chars`` of text at a time, and ids of up to ``kept_pieces`` pieces between blocks. The rank file is read
    by the driver.
    """
    docs = docs.drop(to)
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    at = docs.columns.index(text_col)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{to}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, split = MergeReplay(sent.value), regex.compile(pattern).findall
        known: dict[str, bytes] = {}
        for batch in batches:
            for part in blocks(batch, at, block_chars):
                pieces = [split(t or "") for t in part.column(at).to_pylist()]
                if len(known) > kept_pieces:
                    known.clear()
                new = list({p for doc in pieces for p in doc if p not in known})
                for p, ids in zip(new, replay.encode(p.encode("utf-8", "surrogatepass") for p in new), strict=True):
                    known[p] = np.array(ids, dtype="<u4").tobytes()
                ids = [b"".join(map(known.__getitem__, doc)) for doc in pieces]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*part.schema.names, to])

    return docs.mapInArrow(run, schema)


def blocks(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``most`` bytes in column ``at``, at least one row each."""
    begin, held = 0, 0
    sizes = [v.as_py() or 0 for v in pa.compute.binary_length(batch.column(at))]
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if len(sizes) > begin:
        yield batch.slice(begin)


def decode_column(docs: DataFrame, ids_col: str = "ids", to: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """Add binary ``to`` (in place of a column of that name): the bytes that the ids stand for. Null ids decode to nothing."""
    docs = docs.drop(to)
    read = read_ranks(ranks)
    table = [b""] * (max(read.values()) + 1)
    for piece, k in read.items():
        table[k] = piece
    sent = docs.sparkSession.sparkContext.broadcast(table)
    at = docs.columns.index(ids_col)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{to}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = sent.value.__getitem__
        for batch in batches:
            out = [b"".join(map(piece, np.frombuffer(v.as_py() or b"", "<u4").tolist())) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, to])

    return docs.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode_column(docs).select("doc_id", "ids")
    return decode_column(ids).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
