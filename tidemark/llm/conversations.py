"""Repair of conversation structure by the cheapest edits.

A conversation is repaired to an optional system turn and then user and assistant in turn. Its rows are kept, given another
role, deleted, or new empty turns are put in between. The cost to go from each of four states (nothing yet, after a system,
user or assistant turn) is a vector that is computed from the last row backwards. Vectors are kept only at about sqrt(n)
checkpoints; walking forward, a block's vectors are computed again from the checkpoint at its end, and of the edits that
are tight the one with the least letter is taken.

A conversation with more bytes than a quarter of an even task is cut into runs of its order. Each run gives the (min, +)
matrix of its rows, these give the vectors at the ends of the runs, those give each run's map of states, and so
the state in which each run is entered: the runs' ends are checkpoints, too, and runs are walked apart. Only SHA-256, which
has no parallel form, takes the chunks of such a conversation one after another in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import materialize, shuffle_partitions

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_START, _S, _U, _A = range(4)
#: The state after a role's initial in each state; None where the order forbids it. Code 0 is any other initial.
_AFTER = {0: (None,) * 4, 1: (_S, None, None, None), 2: (_U, _U, None, _U), 3: (None, None, _A, None)}
_CODE = {b"s": 1, b"u": 2, b"a": 3}
_MUST_GO, _CUT = 4, 8  # flags beside the code of the initial
_NEW = (_U, _U, _A, _U)  # the only role that may follow each state when it may be chosen
_NAME = {_U: b"user", _A: b"assistant"}
_FAR = 1 << 40
Vector = tuple[int, ...]
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"


def _closed(v: list[int]) -> list[int]:
    """Costs to go when turns may be inserted first; a third one would only come back to a state seen."""
    return [min(v[q], INSERT + v[_NEW[q]], 2 * INSERT + v[_NEW[_NEW[q]]]) for q in range(4)]


def _level(v: list[int]) -> tuple[Vector, int]:
    """The vector less its least entry, and that entry."""
    least = min(v)
    return tuple(x - least if x < _FAR // 2 else _FAR for x in v), least


END = _level(_closed([0, _FAR, _FAR, 0]))[0]


def _moves(code: int, ahead: Vector, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost to go, next state) for each edit that consumes a row, by letter."""
    found = [("D", DELETE + ahead[state], state)]
    if not code & _MUST_GO:
        extra = TRUNCATED if code & _CUT else 0
        if (after := _AFTER[code & 3][state]) is not None:
            found.append(("K", KEEP + extra + ahead[after], after))
        found.append(("R", REROLE + extra + ahead[_NEW[state]], _NEW[state]))
    return found


@lru_cache(maxsize=100_000)
def _back(code: int, ahead: Vector) -> tuple[Vector, int]:
    """The vector before a row from the one after it. Level vectors are few, so nearly all calls are found."""
    return _level(_closed([min(m[1] for m in _moves(code, ahead, q)) for q in range(4)]))


@lru_cache(maxsize=100_000)
def _forward(code: int, ahead: Vector, state: int) -> tuple[str, int]:
    """The least tight edits up to and with a row, and the state after it."""
    here, less = _back(code, ahead)
    letters = ""
    while True:
        best = [("I", INSERT + here[_NEW[state]] + less, _NEW[state]), *_moves(code, ahead, state)]
        letter, _, state = min(m for m in best if m[1] == here[state] + less)
        letters += letter
        if letter != "I":
            return letters, state


def walk(codes: bytes, end: Vector = END, state: int = _START) -> Iterator[tuple[str, int]]:
    """The edits of each row (its own letter last, insertions before it) and the state after it, in order."""
    block = math.isqrt(len(codes)) + 1
    marks, v = {}, end
    for i in range(len(codes), 0, -1):
        if i == len(codes) or i % block == 0:
            marks[i] = v
        v, _ = _back(codes[i - 1], v)
    for low in range(0, len(codes), block):
        high = min(low + block, len(codes))
        ahead = [marks.pop(high)]
        for i in range(high - 1, low, -1):
            ahead.append(_back(codes[i], ahead[-1])[0])
        for i in range(low, high):
            letters, state = _forward(codes[i], ahead.pop(), state)
            yield letters, state


def last_edits(state: int) -> tuple[str, int]:
    """Insertions after the last row."""
    letters = ""
    while state not in (_START, _A):
        letters, state = letters + "I", _NEW[state]
    return letters, state


def costs(codes: bytes, end: Vector = END) -> tuple[Vector, int]:
    """The level vector before the first of ``codes``, and what it is short of."""
    v, total = end, 0
    for code in reversed(codes):
        v, more = _back(code, v)
        total += more
    return v, total


def _lines(letters: str, state: int, role: bytes, text: bytes) -> tuple[list[bytes], int]:
    """The repaired lines of one row's edits that start from ``state``."""
    out = []
    for letter in letters:
        if letter == "I":
            state = _NEW[state]
            out.append(_NAME[state] + b":")
        elif letter == "R":
            state = _NEW[state]
            out.append(_NAME[state] + b":" + text)
        elif letter == "K":
            state = _AFTER[_CODE.get(role[:1], 0)][state]
            out.append(role + b":" + text)
    return out, state


class _Faults:
    """Faults, turns and initials of rows that come in order."""

    def __init__(self, seen: set[bytes] = frozenset()):
        self.seen, self.codes = set(seen), bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None  # initials
        self.low = self.high = None  # turns

    def add(self, turn: int | None, role: bytes, text: bytes, copies: int) -> None:
        core, mark = text.rstrip(_BLANK), line_key(role, text)
        code = _CODE.get(role[:1], 0)
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.last is not None:
            self.illegal += not _legal(self.last, role[:1])
        self.illegal += (copies - 1) * (not _legal(role[:1], role[:1]))
        self.first, self.last = role[:1] if self.first is None else self.first, role[:1]
        if not core:
            self.blank += copies
            self.codes += bytes([code | _MUST_GO]) * copies
        else:
            again = mark in self.seen
            cut = not again and core[-1:] not in b".!?"
            self.duplicate += copies - (not again)
            self.truncated += cut
            self.codes += bytes([code | (_MUST_GO if again else _CUT if cut else 0)]) + bytes([code | _MUST_GO]) * (copies - 1)
        self.seen.add(mark)


def line_key(role: bytes, text: bytes) -> bytes:
    """What two equal rows share: a digest of role and text."""
    return hashlib.sha256(len(role).to_bytes(8, "big") + role + text).digest()[:16]


def _legal(before: bytes, after: bytes) -> bool:
    return before + after in (b"su", b"ua", b"au")


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)


_STATS = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
_OUT = pa.schema([("conv_id", pa.int64()), *_STATS, ("audit", pa.string()), ("repaired_sha256", pa.string())])
_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _repair(key: int | None, rows: list[tuple]) -> tuple:
    """One conversation's result from its (turn, role, text, copies) in order."""
    faults = _Faults()
    for turn, role, text, copies in rows:
        if copies:
            faults.add(turn, role, text, copies)
    codes = bytes(faults.codes)
    v, cost = costs(codes)
    digest, audit, state, first = hashlib.sha256(), [], _START, True
    edits = walk(codes)
    for _, role, text, copies in rows:
        for _ in range(copies):
            letters, _ = next(edits)
            lines, state = _lines(letters, state, role, text)
            audit.append(letters)
            for line in lines:
                digest.update(line if first else b"\n" + line)
                first = False
    letters, _ = last_edits(state)
    for line in _lines(letters, state, b"", b"")[0]:
        digest.update(line if first else b"\n" + line)
        first = False
    audit.append(letters)
    gaps = _gaps(faults.low, faults.high, faults.turns)
    return key, gaps, faults.blank, faults.duplicate, faults.truncated, faults.illegal, cost + v[_START], "".join(audit), digest.hexdigest()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, rows, out, first = None, [], [], True
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first or conv != key:
                if not first:
                    out.append(_repair(key, rows))
                key, rows, first = conv, [], False
            rows.append(row)
        if out:
            yield _batch(out, _OUT)
            out = []
    if not first:
        yield _batch([_repair(key, rows)], _OUT)


_PIECE = pa.schema([
    ("run", pa.int64()), ("conv", pa.int64()), ("codes", pa.binary()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("first", pa.binary()), ("last", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("matrix", pa.list_(pa.int64())),
])
_PIECE_DDL = "run long, conv long, codes binary, blank long, duplicate long, truncated long, illegal long, first binary, last binary, low long, high long, turns long, matrix array<long>"
_UNIT = [tuple(0 if i == j else _FAR for i in range(4)) for j in range(4)]


def _by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[list]]]:
    """Rows in order, grouped by (run, conv); a group is read as it is walked."""

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    yield from groupby(rows, key=lambda row: row[:2])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults, codes and (min, +) matrix of each run's part of a conversation."""
    for (run, conv), rows in _by_piece(batches):
        faults = _Faults()
        for _, _, kind, turn, role, text, copies, mark in rows:
            if kind == 0:
                faults.seen.add(mark)
            elif copies:
                faults.add(turn, role, text, copies)
        codes = bytes(faults.codes)
        matrix = []
        for unit in _UNIT:  # column by column
            v, total = costs(codes, unit)
            matrix += [x + total if x < _FAR // 2 else _FAR for x in v]
        f = faults
        yield _batch([(run, conv, codes, f.blank, f.duplicate, f.truncated, f.illegal, f.first, f.last, f.low, f.high, f.turns, matrix)], _PIECE)


_ENDS = pa.schema([("run", pa.int64()), ("conv", pa.int64()), ("end", pa.list_(pa.int64())), *_STATS])
_ENDS_DDL = "run long, conv long, end array<long>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _ends(table: pa.Table) -> pa.Table:
    """The vector at the end of each run of one conversation, and the conversation's counts. One small row a run."""
    rows = sorted(table.to_pylist(), key=lambda r: r["run"])
    total = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    initials = [(r["first"], r["last"]) for r in rows if r["first"] is not None]
    spans = [(r["low"], r["high"]) for r in rows if r["low"] is not None]
    total["illegal"] += sum(not _legal(a[1], b[0]) for a, b in zip(initials, initials[1:], strict=False))
    turns = total["turns"] - sum(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    v, cost, out = END, 0, []
    for r in reversed(rows):
        out.append([r["run"], r["conv"], list(v)])
        v, more = _level([min(r["matrix"][4 * j + q] + v[j] for j in range(4)) for q in range(4)])
        cost += more
    gaps = _gaps(spans[0][0], spans[-1][1], turns) if spans else 0
    counts = [gaps, *(total[c] for c in ("blank", "duplicate", "truncated", "illegal")), cost + v[_START]]
    return pa.Table.from_batches([_batch([(*row, *counts) for row in out], _ENDS)])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that a run is left in, for each state it may be entered in."""
    for batch in batches:
        out = []
        for run, conv, codes, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            left = list(range(4))
            for q in range(4):
                for _, left[q] in walk(codes, tuple(end), q):
                    pass
            out.append((run, conv, left))
        if out:
            yield _batch(out, pa.schema([("run", pa.int64()), ("conv", pa.int64()), ("left", pa.list_(pa.int64()))]))


def _entries(table: pa.Table) -> pa.Table:
    """The state in which each run of one conversation is entered, and the last run."""
    rows, state, out = sorted(table.to_pylist(), key=lambda r: r["run"]), _START, []
    for r in rows:
        out.append((r["run"], r["conv"], state, r is rows[-1]))
        state = r["left"][state]
    return pa.Table.from_batches([_batch(out, pa.schema([("run", pa.int64()), ("conv", pa.int64()), ("state", pa.int64()), ("final", pa.bool_())]))])


def _chunks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("conv", pa.int64()), ("run", pa.int64()), ("part", pa.int64()), ("audit", pa.string()), ("body", pa.binary())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Audit and repaired lines (each with a line feed before it) of a run, in parts of about ``size`` bytes."""
        for (run, conv), rows in _by_piece(batches):
            audit, body, held, part, edits, state, final = [], [], 0, 0, None, _START, False

            def take(letters: str, role: bytes, text: bytes) -> None:
                nonlocal state, held
                lines, state = _lines(letters, state, role, text)
                audit.append(letters)
                body.extend(lines)
                held += 1 + sum(map(len, lines))

            for _, _, kind, _, role, text, copies, codes, end, entered, is_final in rows:
                if kind == 0:
                    edits, state, final = walk(codes, tuple(end), entered), entered, is_final
                    continue
                for _ in range(copies):
                    take(next(edits)[0], role, text)
                    if held > size:
                        yield _batch([(conv, run, part, "".join(audit), b"".join(b"\n" + line for line in body))], schema)
                        audit, body, held, part = [], [], 0, part + 1
            if final:
                take(last_edits(state)[0], b"", b"")
            yield _batch([(conv, run, part, "".join(audit), b"".join(b"\n" + line for line in body))], schema)

    return chunks


def _join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for conv, parts in groupby(rows, key=lambda row: row[0]):
        audit, digest, begun = [], hashlib.sha256(), False
        for _, _, _, letters, body in parts:
            audit.append(letters)
            digest.update(body if begun else body[1:])
            begun = begun or bool(body)
        yield _batch([(conv, "".join(audit), digest.hexdigest())], pa.schema([("conv", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]))


#: Ascending, nulls first, as Spark sorts if not told otherwise.
_ORDER = ["conv", "turn", "role", "text"]


def _repair_long(rows: DataFrame, chunk: int) -> DataFrame:
    """Conversations that are cut into runs; the same result as ``_whole`` gives."""
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))  # equal rows are one
    cut = [*_ORDER[:3], F.substring("text", 1, 256)]
    ranged = rows.repartitionByRange(n, *cut)
    mark = F.expr("unhex(left(sha2(concat(unhex(lpad(hex(octet_length(role)), 16, '0')), role, text), 256), 32))")
    ranged = materialize(ranged.select(F.spark_partition_id().cast("long").alias("run"), "*", mark.alias("mark")), "runs")
    # what a run's rows may repeat: marks that an earlier run has, too; one row a run and mark
    own = ranged.where("copies > 0").select("run", "conv", "mark").distinct()
    first = own.groupBy("conv", "mark").agg(F.min("run").alias("_first"))
    both = own.alias("o").join(first.alias("f"), F.col("o.conv").eqNullSafe(F.col("f.conv")) & (F.col("o.mark") == F.col("f.mark"))).where("run > _first")
    seen = both.selectExpr("run", "o.conv AS conv", "0 AS kind", "CAST(NULL AS BIGINT) AS turn", "CAST(NULL AS BINARY) AS role", "CAST(NULL AS BINARY) AS text", "0L AS copies", "o.mark AS mark")
    given = ranged.selectExpr("run", "conv", "1 AS kind", "turn", "role", "text", "copies", "CAST(NULL AS BINARY) AS mark")
    by_run = lambda df: df.repartition(n, "run").sortWithinPartitions("run", _ORDER[0], "kind", *_ORDER[1:])
    pieces = materialize(by_run(seen.unionAll(given)).mapInArrow(_pieces, _PIECE_DDL), "pieces")
    ends = materialize(pieces.drop("codes").groupBy("conv").applyInArrow(_ends, _ENDS_DDL), "ends")
    same = F.col("p.conv").eqNullSafe(F.col("e.conv")) & (F.col("p.run") == F.col("e.run"))
    with_end = pieces.alias("p").join(ends.alias("e"), same).select("p.run", "p.conv", "codes", "end")
    entries = with_end.mapInArrow(_exits, "run long, conv long, left array<long>").groupBy("conv").applyInArrow(_entries, "run long, conv long, state long, final boolean")
    heads = with_end.alias("p").join(entries.alias("e"), same).selectExpr(
        "p.run AS run", "p.conv AS conv", "0 AS kind", "CAST(NULL AS BIGINT) AS turn", "CAST(NULL AS BINARY) AS role", "CAST(NULL AS BINARY) AS text", "0L AS copies", "codes", "end", "state", "final"
    )
    body = ranged.selectExpr("run", "conv", "1 AS kind", "turn", "role", "text", "copies", "CAST(NULL AS BINARY) AS codes", "CAST(NULL AS ARRAY<BIGINT>) AS end", "0L AS state", "false AS final")
    chunks = by_run(heads.unionAll(body)).mapInArrow(_chunks(chunk), "conv long, run long, part long, audit string, body binary")
    joined = chunks.repartition(n, "conv").sortWithinPartitions(_ORDER[0], "run", "part").mapInArrow(_join_chunks, "conv long, audit string, repaired_sha256 string")
    counts = ends.drop("run", "end").distinct()
    return joined.alias("p").join(counts.alias("e"), F.col("p.conv").eqNullSafe(F.col("e.conv"))).select(
        F.col("p.conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    copies: Column | None = None, least_long: int = 1 << 22, chunk: int = 1 << 20,
) -> DataFrame:
    """One row per conversation: its gaps, faults, and the cheapest repair (cost, audit of edits, SHA-256 of the result).

    ``copies`` says how often a row stands there (once, if not given); 0 for a row that is gone but whose conversation still
    gets a result (zeros, an empty audit, the digest of nothing). Rows go by turn, nulls first, then role and text;
    null roles and texts count as one space; null conversation ids are one conversation; other columns are ignored. An empty
    input gives no rows. Conversations of more than ``least_long`` bytes and a quarter of an even task are cut.
    """
    spark = rows.sparkSession
    count = F.lit(1) if copies is None else copies
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).cast("binary")
    gone = count == 0
    rows = rows.select(
        F.col(conv_col).cast("long").alias("conv"), F.when(~gone, F.col(turn_col).cast("long")).alias("turn"),
        F.when(~gone, text(role_col)).otherwise(F.lit(b"")).alias("role"), F.when(~gone, text(text_col)).otherwise(F.lit(b"")).alias("text"), count.cast("long").alias("copies"),
    )
    sizes = rows.groupBy("conv").agg(F.sum(64 + (F.octet_length("role") + F.octet_length("text")) * F.col("copies")).alias("size"))
    sizes = materialize(sizes, "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    most = max(least_long, total // (4 * shuffle_partitions(spark)))
    long = sizes.where(F.col("size") > most).select(F.col("conv").alias("_long"))
    # at most four for each task, as their sizes add up to no more than the total
    same = F.col("conv").eqNullSafe(F.col("_long"))
    short = rows.join(F.broadcast(long), same, "left_anti").repartition(shuffle_partitions(spark), "conv").sortWithinPartitions(*_ORDER)
    found = short.mapInArrow(_whole, _DDL)
    if long.isEmpty():
        return found
    return found.unionAll(_repair_long(rows.join(F.broadcast(long), same, "left_semi"), chunk))


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """``conversations`` with faults put in by crc32(conv_id:turn) mod 20, and how often each row then stands there."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    rows = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"),
    )
    return rows, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair_conversations(rows, copies=copies)


#: Forward, the cheapest edits to reach each state, ties by letters; CRC-32 by its byte table.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS core FROM damaged
), found AS (
  SELECT *, left(role, 1) AS c, core = '' AS blank, core <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following
  FROM placed
), faults AS (
  SELECT *, NOT blank AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS cut FROM found
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
         count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE c || following NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id
), states AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'body': []::VARCHAR[]} AS best FROM conversations
  UNION ALL
  SELECT conv_id, i, q2, min(best) FROM (
    SELECT *, CASE letter WHEN 'D' THEN q1 WHEN 'R' THEN CASE q1 WHEN 2 THEN 3 ELSE 2 END ELSE CASE WHEN c = 's' AND q1 = 0 THEN 1 WHEN c = 'u' AND q1 <> 2 THEN 2 WHEN c = 'a' AND q1 = 2 THEN 3 END END AS q2,
           {'cost': cost + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN cut AND letter <> 'D' THEN 5 ELSE 0 END, 'audit': audit || letter,
            'body': CASE letter WHEN 'D' THEN body WHEN 'K' THEN list_append(body, role || ':' || text) ELSE list_append(body, CASE q1 WHEN 2 THEN 'assistant:' ELSE 'user:' END || text) END} AS best
    FROM (
      SELECT f.*, letter, CASE k WHEN 0 THEN q WHEN 1 THEN CASE q WHEN 2 THEN 3 ELSE 2 END ELSE CASE q WHEN 2 THEN 2 ELSE 3 END END AS q1, best.cost + 5 * k AS cost, best.audit || repeat('I', k) AS audit,
             list_concat(best.body, (CASE q WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END)[1:k]) AS body
      FROM states s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1, range(3) r(k), (VALUES ('D'), ('K'), ('R')) l(letter)
    )
    WHERE letter = 'D' OR NOT (blank OR again)
  ) WHERE q2 IS NOT NULL GROUP BY conv_id, i, q2
), ends AS (
  SELECT s.conv_id, min({'cost': best.cost + 5 * k, 'audit': best.audit || repeat('I', k), 'body': list_concat(best.body, (CASE q WHEN 2 THEN ['assistant:'] ELSE ['user:', 'assistant:'] END)[1:k])}) AS best
  FROM (SELECT *, CASE q WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS k FROM states) s LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.i = coalesce(n.n, 0) GROUP BY s.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(array_to_string(best.body, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""
