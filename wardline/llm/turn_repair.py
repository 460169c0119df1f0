"""Repair of conversation structure at the least cost, by Hirschberg's divide and conquer.

A repaired conversation has the role initials `(s?(ua)+)?`, which four states read: nothing yet,
after s, after u, after a. Each row is kept, given another role or deleted, and empty turns
may be inserted before it. A conversation is cut into pieces of bounded size; a piece is
summed up by its costs from each state to each state. Forward and backward cost vectors of four
states meet at every border between pieces, and inside a piece in its middle, then in the
middles of both halves, and so on, all halves of a level side by side. Only vectors are kept.

Of the optimal states at a border the one with the least audit so far is the crossing. The audit
of a path determines its states, and audits that end in the same row are never prefixes of one
another, so it is enough that forward vectors carry the order of their four audits.

Defined results. Null roles and texts are one space; rows are taken by turn (null first), then role
and text; a role without an initial cannot be kept; a null id is a conversation of its own.
A repeated row is a duplicate. Long texts stay whole; the hash of a conversation is fed row by
row. Further columns are not carried, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import BLANKS, read, ship, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What a row is: class of its initial (other, s, u, a) times four plus its first fault.
INITIALS = "sua"
CLEAN, BLANK, DUPLICATE, CUT = range(4)
#: The state after an output with this initial, per state; None where it may not follow.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The role that an inserted or changed turn takes in each state, and the state after it.
ROLE = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
#: What ends a conversation in each state: inserted turns.
ENDINGS = ("", "II", "I", "")
LABELS = sorted("I" * j + op for j, op in product(range(3), "DKR"))
FAR = 1 << 40
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 20


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per kind of row, from state to state: the least cost, and the least label of that cost."""
    cost = np.full((16, 4, 4), FAR, np.int64)
    label = np.zeros((16, 4, 4), np.int64)
    for kind, start, name in product(range(16), range(4), range(len(LABELS))):
        initial, fault = divmod(kind, 4)
        state, paid = start, 0
        for op in LABELS[name][:-1]:
            state, paid = AFTER[state], paid + INSERT
        op = LABELS[name][-1]
        if op == "D":
            end, paid = state, paid + DELETE
        elif fault in (BLANK, DUPLICATE):
            continue
        else:
            paid += TRUNCATED * (fault == CUT) + (REROLE if op == "R" else KEEP)
            end = AFTER[state] if op == "R" else (
                NEXT[INITIALS[initial - 1]][state] if initial else None)
        if end is not None and (paid, name) < (cost[kind, start, end], label[kind, start, end]):
            cost[kind, start, end], label[kind, start, end] = paid, name
    return cost, label


COST, LABEL = tables()
END = np.array([INSERT * len(x) for x in ENDINGS], np.int64)


def advance(cost: np.ndarray, rank: np.ndarray, step: np.ndarray, label: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """Forward costs and the order of audits (last axis: state) after a step of state to state."""
    paid = np.minimum(cost[..., :, None] + step, FAR)
    best = ((paid << 8) | (rank[..., :, None] << 4) | label).min(-2)
    order = best & 255
    return best >> 8, (order[..., None, :] < order[..., :, None]).sum(-1)


def layers(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each place the rows that are longer; rows leave from the end of a sorted order."""
    order = np.argsort(-lengths, kind="stable")
    falling = -lengths[order]
    for i in range(int(lengths.max(initial=0))):
        yield i, order[:np.searchsorted(falling, -i, side="left")]


def summed(kinds: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and orders of audits of whole pieces, from each state to each state."""
    n = len(lows)
    cost = np.full((n, 4, 4), FAR, np.int64)
    cost[:, range(4), range(4)] = 0
    rank = np.zeros((n, 4, 4), np.int64)
    for i, rows in layers(highs - lows):
        kind = kinds[lows[rows] + i]
        cost[rows], rank[rows] = advance(cost[rows], rank[rows], COST[kind][:, None],
                                         LABEL[kind][:, None])
    return cost, rank


def crossing(cost: np.ndarray, rank: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The state with the least audit so far among those on a cheapest path."""
    total = cost + rest
    return np.where(total == total.min(-1, keepdims=True), rank, 99).argmin(-1)


def audits(kinds: np.ndarray, lows: np.ndarray, highs: np.ndarray, first: np.ndarray,
           last: np.ndarray) -> np.ndarray:
    """The label of each row of pieces [low, high) that go from state `first` to `last`."""
    found = np.zeros(len(kinds), np.int64)
    low, high, a, b = (np.asarray(x, np.int64) for x in (lows, highs, first, last))
    while len(low):
        one = high - low == 1
        found[low[one]] = LABEL[kinds[low[one]], a[one], b[one]]
        low, high, a, b = (x[high - low > 1] for x in (low, high, a, b))
        middle = (low + high) // 2
        cost = np.where(np.arange(4) == a[:, None], 0, FAR)
        rank = np.zeros((len(low), 4), np.int64)
        for i, rows in layers(middle - low):
            kind = kinds[low[rows] + i]
            cost[rows], rank[rows] = advance(cost[rows], rank[rows], COST[kind], LABEL[kind])
        rest = np.where(np.arange(4) == b[:, None], 0, FAR)
        for i, rows in layers(high - middle):
            kind = kinds[high[rows] - 1 - i]
            rest[rows] = np.minimum((COST[kind] + rest[rows][:, None, :]).min(-1), FAR)
        at = crossing(cost, rank, rest)
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        a, b = np.concatenate([a, at]), np.concatenate([at, b])
    return found


def chained(costs: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, int]:
    """The states at all borders of consecutive pieces, and the whole cost."""
    rest = [END]
    for step in costs[::-1]:
        rest.append(np.minimum((step + rest[-1]).min(-1), FAR))
    cost, rank = np.array([0, FAR, FAR, FAR]), np.zeros(4, np.int64)
    states = [0]
    for step, order, after in zip(costs, ranks, rest[-2::-1]):
        cost, rank = advance(cost, rank, step, order)
        states.append(int(crossing(cost, rank, after)))
    return np.array(states), int(rest[-1][0])


def initial(role: str | None) -> int:
    return INITIALS.find((role or "")[:1]) + 1 if role else 0


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, n copies) with the first fault of the first copy."""
    end = F.rtrim("text", F.lit(BLANKS))
    keys = ["conv", "h1", "h2"]
    rows = rows.withColumns({"h1": F.xxhash64("role", "text"),
                             "h2": F.xxhash64("text", "role", F.lit(1))})
    order = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = rows.groupBy(*keys).agg(F.min(order).alias("first")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], "first")
    same = F.col("conv").eqNullSafe(F.col("_conv"))
    for k in keys[1:]:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return rows.join(firsts, same).select(
        "conv", "turn", "role", "text", "n",
        F.when(end == "", BLANK).when(F.col("first") != order, DUPLICATE)
        .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(CLEAN).alias("fault"))


def cut_pieces(rows: DataFrame, kind: str) -> DataFrame:
    """The rows in order, in pieces of bounded size: conv, part, no, kinds, roles, texts.

    Texts of rows that must be deleted are left out. Range partitions split long conversations.
    """
    schema = pa.schema([("part", pa.int64()), ("no", pa.int64()), ("kinds", pa.binary()),
                        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        convs: list = []
        done: list[tuple] = []
        open_conv, kinds, roles, texts, size, no, held = None, bytearray(), [], [], 0, 0, 0
        type_ = None

        def close() -> None:
            nonlocal kinds, roles, texts, size, no, held
            convs.append(open_conv)
            done.append((part, no, bytes(kinds), roles, texts))
            held += size
            kinds, roles, texts, size, no = bytearray(), [], [], 0, no + 1

        def flush() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_arrays(
                [pa.array(convs, type_), *[pa.array([x[i] for x in done], f.type)
                                           for i, f in enumerate(schema)]],
                names=["conv", *schema.names])
            convs.clear()
            done.clear()
            held = 0
            return out

        for batch in batches:
            type_ = batch.schema[0].type
            for conv, role, text, n, fault in zip(*[c.to_pylist() for c in batch.columns]):
                if kinds and (conv != open_conv or size + len(text) > PIECE_BYTES):
                    close()
                open_conv = conv
                code = 4 * initial(role)
                repeated = code + (BLANK if fault == BLANK else DUPLICATE)
                for i in range(n):
                    if len(kinds) == PIECE_ROWS:
                        close()
                    kinds.append(code + fault if i == 0 else repeated)
                    gone = kinds[-1] % 4 in (BLANK, DUPLICATE)
                    roles.append("" if gone else role)
                    texts.append("" if gone else text)
                    if len(done) >= 10_000 or held > 4 * PIECE_BYTES:
                        yield flush()
                size += len(text) + 64
        if kinds:
            close()
        if done:
            yield flush()

    ordered = rows.repartitionByRange(
        "conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(
        "conv", "turn", "role", "text")
    return ordered.select("conv", "role", "text", "n", "fault").mapInArrow(
        cut, f"conv {kind}, part long, no long, kinds binary, roles array<string>, "
             "texts array<string>")


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kinds of all pieces in a row, and where each piece begins and ends."""
    codes = column.to_pylist()
    ends = np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)))
    return (np.frombuffer(b"".join(codes), np.uint8),
            ends - np.diff(ends, prepend=0), ends)


def sum_pieces(pieces: DataFrame, kind: str) -> DataFrame:
    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost, rank = summed(*laid_out(batch.column(3)))
            numbers = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(list(cost.reshape(-1, 16)), numbers),
                 pa.array(list(rank.reshape(-1, 16)), numbers)],
                names=["conv", "part", "no", "cost", "rank"])

    return pieces.select("conv", "part", "no", "kinds").mapInArrow(
        total, f"conv {kind}, part long, no long, cost array<long>, rank array<long>")


def by_conversation(df: DataFrame) -> DataFrame:
    return df.repartition("conv").sortWithinPartitions("conv", "part", "no")


def chain_pieces(sums: DataFrame) -> DataFrame:
    """The states in which each piece begins and ends; `total` only at the last piece."""
    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, []

        def settle() -> pa.RecordBatch:
            states, total = chained(np.array([x[2] for x in held]).reshape(-1, 4, 4),
                                    np.array([x[3] for x in held]).reshape(-1, 4, 4))
            return [(x[0], x[1], int(a), int(b), None) for x, a, b in zip(
                held, states, states[1:])][:-1] + [
                (held[-1][0], held[-1][1], int(states[-2]), int(states[-1]), total)]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)],
                names=["part", "no", "first", "last", "total"])

        out: list[tuple] = []
        for batch in batches:
            for own, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and own != conv:
                    out += settle()
                    held = []
                conv = own
                held.append(row)
            if out:
                yield batch_of(out)
                out = []
        if held:
            yield batch_of(settle())

    return by_conversation(sums).mapInArrow(
        chain, "part long, no long, first long, last long, total long")


def rebuilt(labels: np.ndarray, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The lines of a piece after its edits."""
    lines = []
    for label, role, text in zip(labels, roles, texts):
        *inserts, op = LABELS[label]
        for _ in inserts:
            lines.append(f"{ROLE[state]}:")
            state = AFTER[state]
        if op == "R":
            lines.append(f"{ROLE[state]}:{text}")
            state = AFTER[state]
        elif op == "K":
            lines.append(f"{role}:{text}")
            state = NEXT[role[0]][state]
    return lines


def breaks(kinds: bytes | np.ndarray) -> int:
    """Neighbours that no repaired conversation has."""
    first = np.frombuffer(bytes(kinds), np.uint8) // 4
    pair = first[:-1] * 4 + first[1:]
    return int((~np.isin(pair, (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2))).sum())


def repair_pieces(pieces: DataFrame, states: DataFrame, kind: str) -> DataFrame:
    def edit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, lows, highs = laid_out(batch.column(3))
            first, last = (batch.column(i).to_numpy() for i in (6, 7))
            labels = audits(kinds, lows, highs, first, last)
            said, bodies, ends, illegal = [], [], [], []
            for i, (a, b) in enumerate(zip(lows, highs)):
                own = labels[a:b]
                lines = rebuilt(own, int(first[i]), batch.column(4)[i].as_py(),
                                batch.column(5)[i].as_py())
                said.append("".join(LABELS[x] for x in own))
                bodies.append("\n".join(lines) if lines else None)
                ends.append([int(kinds[a]), int(kinds[b - 1])])
                illegal.append(breaks(kinds[a:b]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(said, pa.string()), pa.array(bodies, pa.string()),
                 pa.array(ends, pa.list_(pa.int64())), pa.array(illegal, pa.int64()),
                 batch.column(7), batch.column(8)],
                names=["conv", "part", "no", "audit", "body", "ends", "illegal", "last", "total"])

    return pieces.join(states, ["part", "no"]).select(
        "conv", "part", "no", "kinds", "roles", "texts", "first", "last", "total").mapInArrow(
        edit, f"conv {kind}, part long, no long, audit string, body string, ends array<long>, "
              "illegal long, last long, total long")


def joined_pieces(edited: DataFrame, kind: str) -> DataFrame:
    """Per conversation: cost, audit, illegal and the hash of the repaired lines."""
    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, said, illegal, before, lines = hashlib.sha256(), [], 0, None, False

        def add(body: str) -> None:
            nonlocal lines
            digest.update((f"\n{body}" if lines else body).encode("utf-8", "surrogatepass"))
            lines = True

        for batch in batches:
            done: list[tuple] = []
            for conv, _, _, audit, body, ends, inner, last, total in zip(
                    *[c.to_pylist() for c in batch.columns]):
                illegal += inner + (before is not None and breaks(bytes([before, ends[0]])))
                before = ends[1]
                said.append(audit)
                if body is not None:
                    add(body)
                if total is None:
                    continue
                state = last
                for op in ENDINGS[last]:
                    said.append(op)
                    add(f"{ROLE[state]}:")
                    state = AFTER[state]
                done.append((conv, total, "".join(said), illegal, digest.hexdigest()))
                digest, said, illegal, before, lines = hashlib.sha256(), [], 0, None, False
            if done:
                convs, totals, audits_, illegals, digests = zip(*done)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(convs, batch.schema[0].type), pa.array(totals, pa.int64()),
                     pa.array(audits_, pa.string()), pa.array(illegals, pa.int64()),
                     pa.array(digests, pa.string())],
                    names=["conv", "cost", "audit", "illegal", "repaired_sha256"])

    return by_conversation(edited).mapInArrow(
        fold, f"conv {kind}, cost long, audit string, illegal long, repaired_sha256 string")


def repair(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", copies: Column | None = None) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, hash.

    `copies` says how often a row occurs, once by default.
    """
    ship(turns.sparkSession)
    kind = turns.schema[id].dataType.simpleString()
    rows = turns.select(
        F.col(id).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("n"))
    rows = stored(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n")))
    marked = stored(faults(rows))
    fault = F.col("fault")
    counts = marked.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"),
                   F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(fault == BLANK, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == BLANK, 0).when(fault == DUPLICATE, F.col("n"))
              .otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(F.when(fault == CUT, 1).otherwise(0)).cast("long").alias("truncated"))
    pieces = stored(cut_pieces(marked, kind))
    states = chain_pieces(sum_pieces(pieces, kind))
    found = joined_pieces(repair_pieces(pieces, states, kind), kind)
    return counts.join(found.withColumnRenamed("conv", "_conv"),
                       F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv").select(
        F.col("conv").alias(id), "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults that a hash of id and turn picks, and their `copies`."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.crc32(key) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    return turns.where(case != 0).select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
        F.when(case == 3, 2).otherwise(1).alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    found = repair(damaged(turns), copies=F.col("copies")).withColumnRenamed("conv_id", "_conv")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return turns.select("conv_id").distinct().join(
        found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[F.coalesce(c, empty.get(c, F.lit(0))).alias(c)
                     for c in found.columns if c != "_conv"])


CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(
    string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda acc, x: list_reduce(
    [xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""

ORACLE = f"""
WITH RECURSIVE keyed AS (
  SELECT DISTINCT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
         || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
cases AS (SELECT *, {CRC.format("key")} % 20 AS c FROM keyed),
rows AS (
  SELECT x.conv_id, x.turn, CASE WHEN c = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN c = 1 THEN '' WHEN c = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
              ELSE coalesce(text, ' ') END AS text,
         unnest(range(CASE WHEN c = 3 THEN 2 ELSE 1 END)) AS copy
  FROM conversations x JOIN cases k ON x.conv_id IS NOT DISTINCT FROM k.conv_id
    AND x.turn IS NOT DISTINCT FROM k.turn WHERE c <> 0),
placed AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM rows),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS times,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS earlier
  FROM placed),
marked AS (
  SELECT *, CASE WHEN solid = '' THEN 'b' WHEN times > 1 THEN 'd'
                 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (place > 1 AND earlier || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
         max(place) AS n
  FROM marked GROUP BY conv_id),
reads(s, c, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(s, t, said, paid, lines) AS (
  VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
         (0, 2, 'I', 5, chr(10) || 'user:'), (1, 2, 'I', 5, chr(10) || 'user:'),
         (3, 2, 'I', 5, chr(10) || 'user:'), (2, 3, 'I', 5, chr(10) || 'assistant:'),
         (0, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
         (1, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:')),
ops(op, role, paid) AS (VALUES ('K', NULL, 0), ('R', 'user', 1), ('R', 'assistant', 1)),
edits AS (
  SELECT conv_id, place, s, s AS t, 'D' AS op, 2 AS paid, '' AS line
  FROM marked, (VALUES (0), (1), (2), (3)) states(s)
  UNION ALL
  SELECT conv_id, place, s, t, op, paid + CASE WHEN fault = 't' THEN 5 ELSE 0 END,
         chr(10) || coalesce(ops.role, m.role) || ':' || text
  FROM marked m, ops JOIN reads ON true
  WHERE fault NOT IN ('b', 'd') AND left(coalesce(ops.role, m.role), 1) = c),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, 0 AS s,
         {{'cost': CAST(0 AS BIGINT), 'audit': '', 'body': ''}} AS b FROM counts
  UNION ALL
  SELECT e.conv_id, e.place, e.t, min({{'cost': b.cost + i.paid + e.paid,
         'audit': b.audit || i.said || e.op, 'body': b.body || i.lines || e.line}})
  FROM best JOIN inserts i ON i.s = best.s
    JOIN edits e ON e.conv_id IS NOT DISTINCT FROM best.conv_id AND e.place = best.place + 1
      AND e.s = i.t
  GROUP BY e.conv_id, e.place, e.t),
closed AS (
  SELECT c.conv_id, min({{'cost': b.cost + coalesce(i.paid, 0), 'audit': b.audit || coalesce(i.said, ''),
         'body': b.body || coalesce(i.lines, '')}}) AS b
  FROM counts c JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id AND place = n
    JOIN inserts i ON i.s = best.s AND (i.t = 3 OR best.s = 0 AND i.t = 0)
  GROUP BY c.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
       sha256(coalesce(substr(b.body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
  LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN closed f ON f.conv_id IS NOT DISTINCT FROM a.conv_id
"""
