"""Best-fit packing by bin completion.

Every document becomes tokens, documents beyond a sequence are cut, and the pieces are packed into as few sequences as
the search finds. Pieces of one length are interchangeable, so the packing is planned on the histogram of lengths, which
has one entry for each length however large the corpus is: best-fit decreasing gives the incumbent, and bin completion
enumerates the undominated fillings around the largest piece, applies each as often as the counts allow, and prunes
by the waste that a better solution may have and by a lower bound on the sequences for what is left. The plan says which ranks of each length go where; pieces get their ranks
from counts of salted groups, so neither the planning nor the assignment gathers documents.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.scratch import materialize

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 2048
END = 0

Pattern = tuple[int, tuple[int, ...]]  # how many sequences, and the lengths in each


def best_fit_decreasing(counts: Mapping[int, int], capacity: int) -> list[Pattern]:
    """Each length in turn, largest first, into the fullest open sequences that have room; equal ones at a time."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # by room left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            for pattern in list(open_[room]):
                if not left:
                    break
                each, bins = room // length, open_[room].pop(pattern)
                full = min(bins, left // each)
                rest = left - full * each if full < bins else 0
                for k, n in ((each, full), (rest, 1 if rest else 0), (0, bins - full - (1 if rest else 0))):
                    if n:
                        at = open_.setdefault(room - k * length, {})
                        key = pattern + (length,) * k
                        at[key] = at.get(key, 0) + n
                left -= full * each + rest
            if not left:
                break
        if left:
            each = capacity // length
            for k, n in ((each, left // each), (left % each, 1 if left % each else 0)):
                if n:
                    at = open_.setdefault(capacity - k * length, {})
                    at[(length,) * k] = at.get((length,) * k, 0) + n
    return [(n, p) for at in open_.values() for p, n in at.items()]


def lower_bound(counts: Mapping[int, int], capacity: int) -> int:
    """Sequences that the pieces need at least: their total length, or, for some a, those too long to share a sequence
    with a piece of length a, and those over half (one each), and what of the pieces from a on exceeds their room."""
    n = np.zeros(capacity + 2, dtype=np.int64)
    for length, k in counts.items():
        n[length] = k
    size = n * np.arange(capacity + 2)
    many, total = np.cumsum(n), np.cumsum(size)  # up to and with each length
    half, a = capacity // 2, np.arange(capacity // 2 + 1)
    alone = many[capacity] - many[capacity - a]
    over = many[capacity - a] - many[half]
    room = over * capacity - (total[capacity - a] - total[half])
    rest = total[half] - np.concatenate([[0], total[: len(a) - 1]])
    return int((alone + over + np.maximum(0, -((room - rest) // capacity))).max())


def dominated(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of filling ``a`` fit, largest first, into pieces of ``b``: then ``b`` is never the worse choice."""
    rooms = sorted(b)
    for x in sorted(a, reverse=True):
        k = bisect_left(rooms, x)
        if k == len(rooms):
            return False
        insort(rooms, rooms.pop(k) - x)
    return True


def fillings(counts: Mapping[int, int], lengths: list[int], room: int, most: int, steps: int, reach: int) -> tuple[list[tuple[int, ...]], int]:
    """Up to ``most`` undominated fillings of ``room``, least waste first (of equal waste, the one with larger pieces), and
    the steps taken.

    ``lengths`` ascend. A filling that leaves room for a piece still there is dominated by the one with it and is not
    given. The search looks at larger pieces first, at the ``reach`` largest lengths that fit at each place, and ends
    after ``steps`` or with enough exact fillings.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    smallest = lengths[0] if lengths else room + 1
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, len(lengths), ())]
    exact = taken = 0
    while stack and taken < steps and exact < most:
        taken += 1
        room_left, top, chosen = stack.pop()
        top = bisect_right(lengths, room_left, 0, top)
        if not top:
            used = Counter(chosen)
            if room_left < smallest or not any(used[x] < counts[x] for x in lengths[: bisect_right(lengths, room_left)]):
                found.append((room_left, chosen))
                exact += room_left == 0
            continue
        for k in range(max(0, top - reach), top):  # the largest that fits is taken up last, so it is looked at first
            x = lengths[k]
            if chosen.count(x) < counts[x]:
                stack.append((room_left - x, k + 1, (*chosen, x)))
            elif k == top - 1:
                stack.append((room_left, k, chosen))
        # the last piece may fill the room exactly
        k = bisect_right(lengths, room_left) - 1
        if k < top and lengths[k] == room_left and chosen.count(room_left) < counts[room_left]:
            found.append((0, (*chosen, room_left)))
            exact += 1
    kept: list[tuple[int, ...]] = []
    for _, f in sorted(set(found), key=lambda f: (f[0], [-x for x in f[1]])):
        if len(kept) < most and not any(dominated(f, b) for b in kept):
            kept.append(f)
    return kept, taken


def plan_packing(
    counts: Mapping[int, int], capacity: int = CAPACITY, width: int = 3, steps: int = 400, reach: int = 12, budget: int = 1_000_000
) -> list[Pattern]:
    """Sequences for ``counts`` pieces of each length; every piece is in exactly one.

    Depth-first: at each node the largest length left is completed by its ``width`` best fillings. A branch ends where
    its waste exceeds what a solution with one sequence less than the incumbent may have, or where the lower bound on
    what is left leaves no gain; the search ends at the lower bound of all or after ``budget`` steps. Two searches are
    made. The first applies each filling as often as the counts allow. If it ends above the lower bound, the second also
    applies fillings half as often and once, takes four times the fillings and steps, and looks at every length. A plan
    above the bound is not proven least unless the second search came to its end.
    """
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    total = sum(k * n for k, n in counts.items())
    lower = lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    fewest = sum(n for n, _ in best)

    def options(left: Mapping[int, int], wide: bool) -> tuple[list[Pattern], int]:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        lengths = sorted(k for k, n in rest.items() if n)
        out = []
        found, taken = fillings(rest, lengths, capacity - largest, width * (4 if wide else 1), steps * (4 if wide else 1), len(lengths) if wide else reach)
        for filling in found or [()]:
            pattern = (largest, *filling)
            out.append((min(left[k] // n for k, n in Counter(pattern).items()), pattern))
        if wide:
            out += sorted({(k, p) for n, p in out for k in (n // 2, 1) if 0 < k < n}, reverse=True)
        return out[::-1], taken

    for wide in (False, True):
        if fewest == lower:
            break
        path: list[Pattern] = []
        left, waste, bins = dict(counts), 0, 0
        first, spent = options(left, wide)
        stack = [first]
        while stack and fewest > lower and spent < budget:
            spent += 10  # a node's own cost
            if not stack[-1]:
                stack.pop()
                if path:
                    n, pattern = path.pop()
                    waste, bins = waste - n * (capacity - sum(pattern)), bins - n
                    for k in pattern:
                        left[k] = left.get(k, 0) + n
                continue
            n, pattern = stack[-1].pop()
            more = n * (capacity - sum(pattern))
            if waste + more > (fewest - 1) * capacity - total:
                continue
            path.append((n, pattern))
            waste, bins = waste + more, bins + n
            for k in pattern:
                left[k] -= n
                if not left[k]:
                    del left[k]
            if not left:
                best, fewest = list(path), bins
                stack.append([])
            elif bins + lower_bound(left, capacity) >= fewest:
                stack.append([])
            else:
                more_options, taken = options(left, wide)
                spent += taken
                stack.append(more_options)
    return best


#: Words of these characters only are split and lower-cased alike by the vocabulary's own steps and by those below.
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00ff]+").fullmatch
#: Fixed value: the vocabulary's split pattern.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
#: Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the characters from U+0100 on.
_SHOWN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
_LETTER = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordEncoder:
    """Token ids (little-endian unsigned 32-bit) of words between ASCII white space, each encoded once.

    The vocabulary drops white space and never looks across it. Plain words are cut and lower-cased here and only
    their distinct parts go to the model; others go through the whole tokenizer.
    """

    def __init__(self, vocabulary: str, kept: int):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary)
        self.tokenize, self.kept = self.whole.model.tokenize, kept
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.words) > self.kept:
            self.words.clear()
        if len(self.parts) > self.kept:
            self.parts.clear()
        parts, other = self.parts, []
        for word in [w for w in words if w not in self.words]:
            text = word.decode("utf-8", "replace")
            if not _PLAIN(text):
                other.append((word, text))
                continue
            ids = []
            for part in _SPLIT(text.lower()):
                known = parts.get(part)
                if known is None:
                    shown = part if part.isascii() else part.encode().decode("latin-1").translate(_LETTER)
                    known = parts[part] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(shown)])
                ids.append(known)
            self.words[word] = b"".join(ids)
        for at in range(0, len(other), 5000):
            few = other[at : at + 5000]
            for (word, _), e in zip(few, self.whole.encode_batch([t for _, t in few], add_special_tokens=False), strict=True):
                self.words[word] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.words.__getitem__, words))


def tokenize_pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, kept_words: int = 500_000) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``id_col``, piece, start, length, ids_crc32. The driver reads the vocabulary."""
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        encoder = WordEncoder(sent.value, kept_words)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (value.as_py() or b"").split()
                encoder.learn(set(words))
                ids = encoder.encode(words) + END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).mapInArrow(
        run, f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY,
    rows_per_salt: int = 5_000, least_salts: int = 64,
) -> DataFrame:
    """Place of every piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text has only the end token. Repeated rows are packed each for itself; null ids are kept; other
    columns are ignored; an empty input gives no rows.
    """
    # a number fixed once written tells rows that repeat id and text apart
    pieces = materialize(tokenize_pieces(docs, id_col, text_col, vocabulary, capacity).withColumn("_deal", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    used: Counter[int] = Counter()
    spans, base = [], 0  # (length, rank, sequence, offset): ranks from this one on go to sequences from that one on
    for n, pattern in plan_packing(histogram, capacity):
        offset = 0
        for length in pattern:
            spans.append((length, used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    spans.sort()
    width = max(histogram.values(), default=0) + 1
    key = np.array([s[0] * width + s[1] for s in spans] or [0], dtype=np.int64)
    rank0, sequence0, offset0 = (np.array([s[k] for s in spans] or [0], dtype=np.int64) for k in (1, 2, 3))
    sent = docs.sparkSession.sparkContext.broadcast((key, rank0, sequence0, offset0))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, rank0, sequence0, offset0 = sent.value
        at = np.searchsorted(key, length.to_numpy() * width + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence0[at] + rank.to_numpy() - rank0[at], "offset": offset0[at]})

    salts = max(least_salts, -(-sum(histogram.values()) // rows_per_salt))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("_deal"), F.lit(salts)).cast("int"))
    cells = pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = W.partitionBy("length", "_salt").orderBy("_id", "piece")
    ranked = pieces.withColumn("_own", F.row_number().over(own) - 1).join(cells, ["length", "_salt"])
    return ranked.withColumn("_at", place("length", F.col("_first") + F.col("_own"))).select(
        F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
