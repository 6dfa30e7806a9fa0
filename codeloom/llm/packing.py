"""Operator 3: packing into sequences by linear grouping.

Documents are encoded and cut into pieces of at most `capacity` tokens. Only the histogram of piece lengths, at most `capacity`
rows, goes to the driver, where the plan is made:

1. lengths over capacity / 4 are sorted and dealt into groups of equal cardinality; each counts as its group's longest;
2. a linear programme over all configurations of at most three group sizes is solved by the simplex method, and its
   multiplicities are rounded down;
3. actual lengths take the groups' places, longest first;
4. what is left, small lengths included, goes longest first to the fullest sequence that still has room, or opens a new one.

Steps 3 and 4 work on runs of equal sequences, so their cost depends on the number of lengths and not of documents. The plan
says, for each length, which ranks go where; a piece's rank among its length is its number within its task plus a base from
counts by task, so nothing is sorted and no length, however common, meets in one task.

Null text counts as empty (one piece: the end id alone); repeated rows are packed each; extra columns are not read; no rows give
no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm._shared import binaries, map_texts, written

CAPACITY, END, GROUPS = 4096, 1, 36


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), and (task, nth): its number among the task's pieces of
    this length."""

    def make():
        from pyspark import TaskContext

        from codeloom.llm.tokens import encoder, ranges

        e, task = encoder(path, "word"), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)

        def f(doc_ids, texts):
            ids, ends = e.encode_column(texts)
            ends = ends + np.arange(len(ends))  # each text has the end id, too
            every = np.full(int(ends[-1]), end, "<u4")
            own = np.ones(len(every), bool)
            own[ends[1:] - 1] = False
            every[own] = ids
            sizes = np.diff(ends)
            cut = -(-sizes // capacity)
            piece = ranges(np.zeros(len(cut), np.int64), cut)
            start = piece * capacity
            length = np.minimum(capacity, np.repeat(sizes, cut) - start)
            # the number of each piece among those of its length, here and before in this task
            order = np.argsort(length, kind="stable")
            values, count = np.unique(length, return_counts=True)
            nth = np.empty(len(length), np.int64)
            nth[order] = ranges(seen[values], count)
            seen[values] += count
            named = doc_ids.take(pa.array(np.repeat(np.arange(len(cut)), cut)))
            bounds = np.append(np.repeat(ends[:-1], cut) + start, ends[-1])
            return {"doc_id": named, "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids": binaries(every, bounds), "task": np.full(len(length), task, np.int32), "nth": pa.array(nth)}

        return f

    return map_texts(docs, "doc_id long, piece int, start long, length long, ids binary, task int, nth long", make, arrow=True)


def solve(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations of at most three sizes and how often to use each: the linear programme's optimum, rounded down."""
    k = len(sizes)
    columns = [c for m in (1, 2, 3) for c in combinations_with_replacement(range(k), m) if sum(sizes[i] for i in c) <= capacity]
    a = np.zeros((k, len(columns)))
    for j, c in enumerate(columns):
        for i in c:
            a[i, j] += 1
    basis = [columns.index((i,)) for i in range(k)]
    inverse, x = np.eye(k), np.array(counts, float)
    for _ in range(60 * k):
        price = inverse.sum(0)
        gain = price @ a - 1
        enter = int(gain.argmax())
        if gain[enter] < 1e-9:
            break
        step = inverse @ a[:, enter]
        ratio = np.where(step > 1e-9, x / np.maximum(step, 1e-9), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        basis[out] = enter
    return [(columns[j], int(v + 1e-6)) for j, v in zip(basis, x, strict=True) if v >= 1 - 1e-6]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> dict:
    """Intervals of ranks by length: rank r of interval i goes to sequence base[i] + (r - low[i]) // each[i], at offset
    offset[i] + (r - low[i]) % each[i] * length."""
    left = {n: c for n, c in histogram.items() if c > 0}
    runs: list[tuple[int, list[tuple[int, int]], int]] = []  # sequences, (length, pieces of it in each), room
    large = sorted((n for n in left if n > capacity // 4), reverse=True)
    total = sum(left[n] for n in large)
    dealt: list[deque] = []
    if total:
        per = -(-total // min(groups, total))
        room = 0
        for n in large:
            c = left[n]
            while c:
                if not room:
                    dealt.append(deque())
                    room = per
                take = min(c, room)
                dealt[-1].append([n, take])
                c, room = c - take, room - take
        sizes = [g[0][0] for g in dealt]
        merged: dict[int, list[int]] = {}  # groups of one rounded size are one
        for i, s in enumerate(sizes):
            merged.setdefault(s, []).append(i)
        queues = [deque(x for i in same for x in dealt[i]) for same in merged.values()]
        for config, m in sorted(solve([*merged], [sum(c for _, c in q) for q in queues], capacity), key=lambda x: -sum([*merged][i] for i in x[0])):
            slots = []
            for g in config:
                need, got = m, []
                while need:
                    head = queues[g][0]
                    take = min(need, head[1])
                    got.append([head[0], take])
                    head[1] -= take
                    need -= take
                    if not head[1]:
                        queues[g].popleft()
                slots.append(got)
                for n, c in got:
                    left[n] -= c
            while slots[0]:
                t = min(s[0][1] for s in slots)
                held: dict[int, int] = {}
                for s in slots:
                    held[s[0][0]] = held.get(s[0][0], 0) + 1
                    s[0][1] -= t
                    if not s[0][1]:
                        s.pop(0)
                runs.append((t, [*held.items()], capacity - sum(n * k for n, k in held.items())))
    rooms: dict[int, list] = {}
    order: list[int] = []

    def keep(run: tuple) -> None:
        if run[2] not in rooms:
            rooms[run[2]] = []
            insort(order, run[2])
        rooms[run[2]].append(run)

    for run in runs:
        keep(run)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            at = bisect_left(order, n)
            if at == len(order):
                k = min(capacity // n, c)
                m = c // k
                keep((m, [(n, k)], capacity - n * k))
                c -= m * k
                continue
            r = order[at]
            m, held, _ = rooms[r].pop()
            if not rooms[r]:
                del rooms[r]
                order.pop(at)
            k = r // n
            full = min(m, c // k)
            if full:
                keep((full, [*held, (n, k)], r - n * k))
            c, m = c - full * k, m - full
            if c and m:  # fewer than k are left
                keep((1, [*held, (n, c)], r - n * c))
                c, m = 0, m - 1
            if m:
                keep((m, held, r))
    rows, sequences, rank = [], 0, dict.fromkeys(left, 0)
    for r in order:
        for m, held, _ in rooms[r]:
            offset = 0
            for n, k in held:
                rows.append((n, rank[n], sequences, offset, k))
                rank[n] += m * k
                offset += n * k
            sequences += m
    rows.sort()
    return {"sequences": sequences, **{name: np.array([x[i] for x in rows], np.int64) for i, name in enumerate(("length", "low", "base", "offset", "each"))}}


def assign(made: dict, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sequence_id and offset of the pieces with these ranks."""
    i = np.searchsorted((made["length"] << 46) + made["low"], (length << 46) + rank, side="right") - 1
    past = rank - made["low"][i]
    return made["base"][i] + past // made["each"][i], made["offset"][i] + past % made["each"][i] * length


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut: from pieces(), written. The same columns without ids, task and nth, with ids_crc32, sequence_id and offset."""
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    made = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kept = cut.select("doc_id", "piece", "start", "length", "task", "nth", F.crc32("ids").alias("ids_crc32"))
    ranked = kept.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches):
        for b in batches:
            where, offset = assign(made, b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(where), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> tuple[DataFrame, DataFrame]:
    """(packed, pieces with ids): join them on doc_id and piece and order by offset for the sequences' ids."""
    cut = written(pieces(docs, path, capacity, end), "pieces")
    return pack(cut, capacity), cut.select("doc_id", "piece", "ids")
