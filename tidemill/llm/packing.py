"""Packing token sequences into fixed windows by non-negative least squares.

Lengths left after cutting whole windows off long documents make a histogram. Shallow combinations of length classes
that fill a window are enumerated; NNLS finds how often each is to be used so that the classes' counts are met; the
counts are rounded down and what is left is packed greedily, longest first into the fullest window that has room.
Everything up to here works on the histogram (at most `window` numbers), so the driver's work does not grow with the
number of documents. Ranks of documents among those of equal length then give each its slot.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked_broadcast, in_arrow, mapped, stored, text_or_empty
from .word_ids import worker

#: Tokens of a window, its length classes, and the most pieces that a combination has.
WINDOW, CLASSES, DEPTH = 4096, 64, 3
#: Pieces of one length that are ranked together, so that a very common length is spread over tasks.
RANK_ROWS = 1_000


def combinations(classes: int, depth: int) -> np.ndarray:
    """Columns: how often each class 1..classes is in a multiset of at most `depth` classes that sums to `classes`."""
    rows = [c for d in range(1, depth + 1) for c in combinations_with_replacement(range(1, classes + 1), d) if sum(c) == classes]
    out = np.zeros((classes, len(rows)))
    for k, c in enumerate(rows):
        for x in c:
            out[x - 1, k] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000, tolerance: float = 1e-8) -> np.ndarray:
    """min |a x - b| with x >= 0, by Lawson and Hanson's active sets."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    w = a.T @ (b - a @ x)
    limit = tolerance * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        free = np.where(passive, -np.inf, w)
        k = int(np.argmax(free))
        if free[k] <= limit or passive.sum() >= m:
            break
        passive[k] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (s <= 0)
            if not low.any():
                break
            alpha = float(np.min(x[low] / np.maximum(x[low] - s[low], 1e-300)))
            x = x + alpha * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = s
        w = a.T @ (b - a @ x)
    return np.maximum(x, 0)


def plan(histogram: dict[int, int], window: int = WINDOW, classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one window, number of such windows)] that use every length of the histogram exactly as often as it occurs."""
    left = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] += n
    size = -(-window // classes)
    klass = -(-np.arange(window + 1) // size)
    wanted = np.bincount(klass, weights=left, minlength=classes + 1)[1:]
    made: list[tuple[tuple[int, ...], int]] = []
    if wanted.any():
        a = combinations(classes, depth)
        repeats = np.floor(nnls(a, wanted) + 1e-9).astype(np.int64)
        longest = {c: [v for v in range(min(window, c * size), (c - 1) * size, -1) if left[v]] for c in range(1, classes + 1)}
        for k in np.argsort(-repeats, kind="stable"):
            todo = int(repeats[k])
            members = [c for c in range(classes, 0, -1) for _ in range(int(a[c - 1, k]))]
            while todo > 0:
                picked = Counter()
                for c in members:
                    value = next((v for v in longest[c] if left[v] - picked[v] > 0), None)
                    if value is None:
                        break
                    picked[value] += 1
                else:
                    n = min(todo, *(int(left[v]) // m for v, m in picked.items()))
                    for v, m in picked.items():
                        left[v] -= n * m
                        if not left[v]:
                            longest[int(klass[v])].remove(v)
                    made.append((tuple(sorted(picked.elements(), reverse=True)), n))
                    todo -= n
                    continue
                break
    return greedy(left, made, window)


def greedy(left: np.ndarray, made: list[tuple[tuple[int, ...], int]], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Puts the remaining lengths, longest first, where the least room is left over; whole groups of equal windows at a time."""
    open_: dict[int, list[list]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def keep(lengths: tuple[int, ...], n: int) -> None:
        room = window - sum(lengths)
        if room:
            open_.setdefault(room, []).append([lengths, n])
        else:
            done.append((lengths, n))

    for lengths, n in made:
        keep(lengths, n)
    for value in np.flatnonzero(left)[::-1].tolist():
        n = int(left[value])
        while n > 0:
            room = min((r for r in open_ if r >= value), default=None)
            if room is None:
                per = window // value
                if n >= per:
                    keep((value,) * per, n // per)
                    n -= n // per * per
                else:
                    keep((value,) * n, 1)
                    n = 0
                continue
            lengths, count = open_[room].pop()
            if not open_[room]:
                del open_[room]
            per = room // value
            full = min(count, n // per)
            if full:
                keep(lengths + (value,) * per, full)
                n -= full * per
                count -= full
            elif n:
                keep(lengths + (value,) * n, 1)
                n, count = 0, count - 1
            if count:
                open_.setdefault(room, []).append([lengths, count])
    return done + [(lengths, n) for room in sorted(open_) for lengths, n in open_[room]]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Cuts each document's ids (null text: empty; end_id last) into whole windows and one rest of 1 to `window` ids:
    doc_id, start, length, ids_crc32, doc_tokens. Repeated rows are documents of their own."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(part: pa.RecordBatch) -> dict[str, list]:
        rows = []
        for doc_id, raw in zip(part["doc_id"].to_pylist(), worker(tokenizer).encode(part["text"].to_pylist()), strict=True):
            raw += end
            n = len(raw) // 4
            for start in range(0, n, window):
                length = min(window, n - start)
                rows.append((doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n))
        return dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), map(list, zip(*rows, strict=True)), strict=True))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return mapped(docs, cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def assign(cut: DataFrame, window: int = WINDOW, classes: int = CLASSES, depth: int = DEPTH) -> DataFrame:
    """Adds sequence_id and offset to stored pieces. Every piece gets exactly one slot; offsets in a sequence have no gaps."""
    histogram = stored(cut.groupBy("length").count(), "pack-lengths")
    made = plan({r["length"]: r["count"] for r in histogram.collect()}, window, classes, depth)  # at most `window` rows
    #: For each length, in rank order: first rank, first sequence, offset in the first of equal slots, equal slots per sequence.
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for lengths, n in made:
        offset = 0
        for value, m in sorted(Counter(lengths).items(), reverse=True):
            slots.setdefault(value, []).append((taken[value], sequence, offset, m))
            taken[value] += n * m
            offset += value * m
        sequence += n
    tables = cut.sparkSession.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in slots.items()})

    parts = F.ceil(F.col("count") / RANK_ROWS).cast("int")
    ranked = cut.join(F.broadcast(histogram.select("length", parts.alias("parts"))), "length")  # at most `window` rows
    ranked = ranked.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "parts").cast("int")).drop("parts")
    sizes = ranked.groupBy("length", "part").count()
    before = sizes.select("length", "part", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = ranked.withColumn("rank", F.row_number().over(within) - 1).join(checked_broadcast(stored(before, "pack-ranks")), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")

    def place(batch: pa.RecordBatch) -> dict[str, list]:
        length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        ids, offsets = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for value in np.unique(length).tolist():
            at = np.flatnonzero(length == value)
            table = tables.value[value]
            row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
            nth = rank[at] - row[:, 0]
            ids[at] = row[:, 1] + nth // row[:, 3]
            offsets[at] = row[:, 2] + nth % row[:, 3] * value
        return {c: batch[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")} | {"sequence_id": pa.array(ids), "offset": pa.array(offsets)}

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(place(batch))

    return in_arrow(ranked, run, schema)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Packs all documents (doc_id, text) into sequences of at most `window` ids: one row per piece. A null text is empty
    and packs its end id alone; repeated rows and rows that share a doc_id are documents of their own; an empty table
    gives no rows."""
    return assign(stored(pieces(docs, tokenizer, end_id, window), "pieces"), window)
