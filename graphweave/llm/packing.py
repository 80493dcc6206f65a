"""Best-fit packing by bin completion, over the histogram of lengths.

Documents are cut only if they exceed a sequence; full pieces take a sequence each. All others
count by their length alone, and there are fewer lengths than places in a sequence, so the
packing is found for the histogram: a list of fillings with the number of sequences that get each.
Bin completion takes the largest length, enumerates fillings around it, and branches, each
filling as often as the histogram lets it; a branch ends when its waste leaves no room for a
solution with fewer sequences than the best so far. Best fit of what is left, taken now and then
on the way down, gives incumbents. The pieces then find their places by their rank among those of their length, from
ranks within tasks and running totals of the tasks' histograms.

The search ends at the lower bound or after ``NODES`` nodes, with the best solution found. A first
pass tries up to ``FILLINGS`` fillings a node; while nodes are left, further passes try twice as
many each, until none was left out. Fillings are enumerated larger pieces first in batches of
about ``BATCH``, or what ``STEPS`` steps find; only within a batch are they put in order of
fullness and freed of dominated ones, and the next batch is made when it is asked for. A packing
above the lower bound is not proven to have the fewest sequences: nodes can run out, and a filling
is tried only as often as the histogram lets it, not less often.

Defined results: a null text counts as empty and has the end id alone; every row is packed,
repeated ones too; pieces of one length are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import logging
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweave.llm import bpe, common

log = logging.getLogger(__name__)
CAPACITY, END_ID = 2048, 0
NODES, FILLINGS = 6000, 8
#: Fillings are enumerated in batches of so many steps or fillings.
STEPS, BATCH = 1500, 64
INCUMBENT_EVERY = 100
Filling = tuple[tuple[int, int], ...]  # (length, how many), lengths descending
Solution = list[tuple[Filling, int]]


def best_fit(counts: dict[int, int], capacity: int) -> Solution:
    """Best fit of descending lengths, for groups of like sequences at once."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            tight = next((r for r in room if r >= length), None)
            if tight is None:
                each = capacity // length
                whole, rest = divmod(left, each)
                for k, times in ((each, whole), (rest, 1 if rest else 0)):
                    if times:
                        groups.setdefault(capacity - k * length, []).append(((length,) * k, times))
                left = 0
            else:
                own = groups[tight]
                held, times = own.pop()
                each = min(tight // length, max(1, left // times))
                used = min(times, left // each)
                if used < times:
                    own.append((held, times - used))
                groups.setdefault(tight - each * length, []).append((held + (length,) * each, used))
                left -= used * each
            groups = {r: g for r, g in groups.items() if g}
            room = sorted(groups)
    total: Counter = Counter()
    for own in groups.values():
        for held, times in own:
            total[tuple(sorted(Counter(held).items(), reverse=True))] += times
    return list(total.items())


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The largest, over thresholds, of the bound that counts what can't share and what must spill over."""
    lengths = np.array(sorted(counts), np.int64)
    if not len(lengths):
        return 0
    number = np.array([counts[x] for x in lengths.tolist()], object)
    volume = lengths.astype(object) * number
    best = -(-int(volume.sum()) // capacity)
    big = lengths * 2 > capacity
    for least in [0, *lengths[~big].tolist()]:
        alone, shared = lengths > capacity - least, big & (lengths <= capacity - least)
        small = ~big & (lengths >= least)
        n1, n2 = int(number[alone].sum()), int(number[shared].sum())
        spill = int(volume[small].sum()) - (n2 * capacity - int(volume[shared].sum()))
        best = max(best, n1 + n2 + max(0, -(-spill // capacity)))
    return best


def _maximal(lengths: array, free: array, room: int) -> Iterator[Filling | None]:
    """What fills ``room`` so that no further piece fits, larger pieces first; None for each step on the way.

    A step takes as many pieces of one length as fit, or one fewer than before, so a filling of a
    thousand pieces of one length is as near as one of two.
    """
    below = array("q", (-x for x in lengths))
    volume = array("q", bytes(8 * (len(lengths) + 1)))  # of the pieces from a length on
    for k in range(len(lengths) - 1, -1, -1):
        volume[k] = volume[k + 1] + lengths[k] * free[k]
    taken = array("q", bytes(8 * len(lengths)))
    path: list[int] = []
    k = 0
    while True:
        # down: the next length that fits, until none does
        while (k := bisect_left(below, -room, k)) < len(lengths):
            if free[k]:
                taken[k] = min(free[k], room // lengths[k])
                room -= taken[k] * lengths[k]
                path.append(k)
                yield None
            k += 1
        if all(taken[j] == free[j] for j in range(len(lengths) - 1, bisect_left(below, -room) - 1, -1)):
            yield tuple((lengths[j], taken[j]) for j in path)
        # back: one piece fewer of the last length, if what follows can take so much of its room that it doesn't fit again
        while path:
            k = path[-1]
            if volume[k + 1] > room:
                break
            room += taken[k] * lengths[k]
            taken[k] = 0
            path.pop()
        if not path:
            return
        taken[k] -= 1
        room += lengths[k]
        if not taken[k]:
            path.pop()
        k += 1
        yield None


def fillings(counts: dict[int, int], capacity: int) -> Iterator[Filling]:
    """Fillings around the largest length, batch after batch as they are asked for; of a batch the undominated ones, the fullest first."""
    lengths = array("q", sorted(counts, reverse=True))  # a search holds as many of these as its path is long
    first, found, steps = lengths[0], [], 0
    for filling in _maximal(lengths, array("q", (counts[x] - (x == first) for x in lengths)), capacity - first):
        if filling is None:
            steps += 1
        else:
            found.append((capacity - first - sum(x * k for x, k in filling), sum(k for _, k in filling), filling))
        if found and (steps > STEPS or len(found) > BATCH):
            yield from _undominated(first, found)
            found, steps = [], 0
    yield from _undominated(first, found)


def _undominated(first: int, found: list[tuple[int, int, Filling]]) -> Iterator[Filling]:
    kept: list[tuple[int, Filling]] = []
    for _, pieces, filling in sorted(found, key=lambda x: (x[0], x[1], [(-y, -k) for y, k in x[2]])):
        if not any(n == pieces and _covers(other, filling) for n, other in kept):
            kept.append((pieces, filling))
            own = Counter(dict(filling))
            own[first] += 1
            yield tuple(sorted(own.items(), reverse=True))


def _covers(one: Filling, other: Filling) -> bool:
    """Of as many pieces: each of ``one``, in descending order, is as long as its fellow of ``other``."""
    a = b = 0
    left, right = (filling[0][1] if filling else 0 for filling in (one, other))
    while a < len(one) and b < len(other):
        if one[a][0] < other[b][0]:
            return False
        both = min(left, right)
        left, right = left - both, right - both
        if not left and (a := a + 1) < len(one):
            left = one[a][1]
        if not right and (b := b + 1) < len(other):
            right = other[b][1]
    return True


def pack(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Solution:
    """Fillings and how many sequences get each, for ``counts`` pieces of each length; the number of sequences and its lower bound are logged."""
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    size = lambda solution: sum(times for _, times in solution)
    best, target, total = best_fit(counts, capacity), lower_bound(counts, capacity), sum(x * n for x, n in counts.items())
    width, cut, left = FILLINGS, True, dict(counts)
    while cut and size(best) > target and nodes > 0:
        cut = False
        # depth first; ``left`` is what the path has left of the counts. A level: the filling that led there, how often it is taken,
        # sequences used, waste, the fillings to try, and how many were tried
        stack = [[(), 0, 0, 0, fillings(left, capacity), 0]]
        while stack and size(best) > target and nodes > 0:
            _, _, used, waste, options, tried = stack[-1]
            filling = next(options, None) if tried < width else None
            if filling is None:
                cut |= tried == width
                last, times, *_ = stack.pop()
                for x, k in last:
                    left[x] = left.get(x, 0) + k * times
                continue
            stack[-1][-1] += 1
            nodes -= 1
            most = (size(best) - 1) * capacity - total  # more waste than that can't lead to fewer sequences
            loss = capacity - sum(x * k for x, k in filling)
            times = min(left[x] // k for x, k in filling)
            if loss:
                times = min(times, (most - waste) // loss)
            if times <= 0:
                continue
            for x, k in filling:
                left[x] -= k * times
                if not left[x]:
                    del left[x]
            stack.append([filling, times, used + times, waste + loss * times, fillings(left, capacity) if left else iter(()), 0])
            if not left or nodes % INCUMBENT_EVERY == 0:
                rest = best_fit(left, capacity)
                if used + times + size(rest) < size(best):
                    best = [(f, t) for f, t, *_ in stack[1:]] + rest
        while stack:
            last, times, *_ = stack.pop()
            for x, k in last:
                left[x] = left.get(x, 0) + k * times
        width *= 2
    log.info("%d sequences, lower bound %d", size(best), target)
    return best


def places(solution: Solution) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, how many in a sequence, offset of the first)."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: Counter = Counter()
    sequence = 0
    for filling, times in solution:
        offset = 0
        for length, k in filling:
            found.setdefault(length, []).append((seen[length], sequence, k, offset))
            seen[length] += k * times
            offset += k * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): ``rank`` among the task's pieces of that length."""
    common.bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), common.once(bpe.library_encoder, tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in common.joined(batches):
            doc, piece, start, length, crc, rank = [], [], [], [], [], []
            for k, own in enumerate(bpe.splits(*encoder(batch.column("text")))):
                own = np.concatenate([own.astype("<u4"), end])
                at = 0
                for p in range(-(-len(own) // capacity)):
                    n = (len(own) - 1) % capacity + 1 if p == 0 else capacity
                    doc.append(k), piece.append(p), start.append(at), length.append(n)
                    crc.append(zlib.crc32(own[at : at + n])), rank.append(seen[n])
                    seen[n] += 1
                    at += n
            columns = [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(common.tidied(encode, keeps=True), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each piece of each document with its sequence and the offset there."""
    spark = docs.sparkSession
    cut = common.materialize(pieces(docs, tokenizer, capacity, end_id, text, key), "pieces")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # a full piece has a sequence of its own, numbered below zero by task and rank
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", -(F.shiftleft(F.col("part").cast("bigint"), 36) + F.col("rank") + 1)).withColumn("offset", F.lit(0).cast("bigint"))
    rest = cut.where(F.col("length") < capacity)
    by_task = common.materialize(rest.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # fewer than capacity
    shared = spark.sparkContext.broadcast(places(pack(counts, capacity)))
    common.give_back()  # the driver's Python, after the search
    earlier = by_task.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("earlier"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["overall"].to_numpy()
            for length in np.unique(lengths):
                own, rows = lengths == length, shared.value[int(length)]
                row = rows[np.searchsorted(rows[:, 0], ranks[own], "right") - 1]
                inner = ranks[own] - row[:, 0]
                sequence[own] = row[:, 1] + inner // row[:, 2]
                offset[own] = row[:, 3] + inner % row[:, 2] * length
            yield batch.drop(columns="overall").assign(sequence_id=sequence, offset=offset)

    ranked = rest.join(earlier.hint("merge"), ["part", "length"]).select(*out[:5], (F.col("rank") + F.col("earlier")).alias("overall"))
    placed = ranked.mapInPandas(common.tidied(place), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return full.select(*out).unionAll(placed.select(*out))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(common.table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
