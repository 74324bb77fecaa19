"""Packing of tokenised documents into sequences: Martello-Toth dominance first, best fit for what is left.

Lengths are whole numbers up to the capacity, so an instance of any size is a histogram of at most ``capacity`` counts.  The
histogram is solved on the driver as patterns with multiplicities; documents take their places by their rank among the
pieces of the same length, which tasks count apart and Spark adds up.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knownat.llm.common import crc_of_ids, stored
from knownat.llm.encode import encoder, gathered

Pattern = tuple[int, ...]


class Stock:
    """Counts of the lengths that are not packed yet, with the look-ups the dominance tests need."""

    def __init__(self, counts: np.ndarray):
        self.counts = {int(v): int(counts[v]) for v in np.flatnonzero(counts)}
        self.sizes = sorted(self.counts)

    def take(self, pattern: Pattern, times: int) -> None:
        for size, each in Counter(pattern).items():
            self.counts[size] -= each * times
            if not self.counts[size]:
                del self.counts[size]
                self.sizes.remove(size)

    def times(self, pattern: Pattern) -> int:
        """How often the pattern can be made of what is there."""
        return min(self.counts[size] // each for size, each in Counter(pattern).items())

    def left(self, size: int, used: Pattern) -> int:
        return self.counts.get(size, 0) - used.count(size)

    def largest(self, room: int, used: Pattern) -> int:
        """The largest length that fits, other than the used pieces; 0 if none does."""
        at = bisect_left(self.sizes, room + 1) - 1
        while at >= 0 and self.left(self.sizes[at], used) <= 0:
            at -= 1
        return self.sizes[at] if at >= 0 else 0

    def smallest(self, number: int, used: Pattern) -> list[int]:
        found: list[int] = []
        for size in self.sizes:
            found += [size] * min(number - len(found), max(0, self.left(size, used)))
            if len(found) == number:
                break
        return found

    def best_pair(self, room: int, used: Pattern) -> int:
        """The largest sum of two pieces that fits; 0 if no two do."""
        best, low, high = 0, 0, bisect_left(self.sizes, room + 1) - 1
        while low <= high:
            a, b = self.sizes[low], self.sizes[high]
            if self.left(a, used) <= 0:
                low += 1
            elif self.left(b, used) <= 0 or a + b > room or (a == b and self.left(a, used) < 2):
                high -= 1
            else:
                best, low = max(best, a + b), low + 1
        return best

    def largest_second(self, room: int, used: Pattern) -> int:
        """The largest y of any two pieces x >= y that fit together; 0 if no two do."""
        larger = 0
        for size in reversed(self.sizes):
            there = self.left(size, used)
            if there <= 0:
                continue
            if (there >= 2 and 2 * size <= room) or (larger and size + larger <= room):
                return size
            larger = size
        return 0


def dominating(stock: Stock, size: int, capacity: int) -> Pattern | None:
    """A set with a piece of this length that no other set with it can beat, or None where the tests decide nothing.

    A set dominates another if the other's pieces can be put, in groups, under pieces of the first that are at least as long.
    """
    room = capacity - size
    second = stock.largest(room, (size,))
    if not second:
        return (size,)
    if second == room:
        return (size, second)
    few = stock.smallest(3, (size,))
    if len(few) < 2 or few[0] + few[1] > room:
        return (size, second)
    if len(few) == 3 and sum(few) <= room:
        return None
    if stock.best_pair(room, (size,)) <= second:
        return (size, second)
    third = stock.largest(room - second, (size, second))
    if third and stock.largest_second(room, (size,)) <= third:
        return (size, second, third)
    return None


def reduce_instance(stock: Stock, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets until none is found; what they hold leaves the instance for good."""
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for size in sorted(stock.counts, reverse=True):
            while size in stock.counts and (pattern := dominating(stock, size, capacity)):
                times = stock.times(pattern)
                stock.take(pattern, times)
                fixed.append((pattern, times))
                changed = True
    return fixed


def best_fit(stock: Stock, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit in decreasing order on classes: equal bins and equal pieces are moved together."""
    bins: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if not times:
            return
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append((pattern, times))

    for size in sorted(stock.counts, reverse=True):
        left = stock.counts[size]
        while left:
            at = bisect_left(rooms, size)
            room = rooms[at] if at < len(rooms) else capacity
            if at < len(rooms):
                pattern, times = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                pattern, times = (), -(-left // (capacity // size))
            each = room // size
            whole = min(times, left // each)
            put(room - each * size, pattern + (size,) * each, whole)
            left -= whole * each
            times -= whole
            if times and left and left < each:
                put(room - left * size, pattern + (size,) * left, 1)
                left, times = 0, times - 1
            if pattern:
                put(room, pattern, times)
    return [group for room in rooms for group in bins[room]]


def solve(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns with multiplicities that hold every piece once."""
    stock = Stock(counts)
    return reduce_instance(stock, capacity) + best_fit(stock, capacity)


class Places:
    """For each length, which ranks go to which sequences and at which offset."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        ranks: Counter = Counter()
        sequence = 0
        for pattern, times in patterns:
            offset = 0
            for size in pattern:
                rows.setdefault(size, []).append((ranks[size], sequence, offset))
                ranks[size] += times
                offset += size
            sequence += times
        self.sequences = sequence
        self.tables = {size: np.array(found, np.int64) for size, found in rows.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequences, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for size in np.unique(lengths):
            rows = np.flatnonzero(lengths == size)
            table = self.tables[int(size)]
            at = np.searchsorted(table[:, 0], ranks[rows], "right") - 1
            sequences[rows] = table[at, 1] + ranks[rows] - table[at, 0]
            offsets[rows] = table[at, 2]
        return sequences, offsets


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole sequences, after a first piece that may be shorter."""
    first = total - (-(-total // capacity) - 1) * capacity
    return [(0, first)] + [(start, capacity) for start in range(first, total, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece, with ``part`` and ``rank``: its task and its number among that task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in gathered(batches):
            rows: dict[str, list] = {name: [] for name in ("row", "piece", "start", "length", "ids_crc32", "rank")}
            for row, found in enumerate(own.encode_all(batch.column("text"))):
                ids = found + end
                for number, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = crc_of_ids(ids[4 * start:4 * (start + length)])
                    for name, value in zip(rows, (row, number, start, length, crc, int(seen[length]))):
                        rows[name].append(value)
                    seen[length] += 1
            taken = batch.column("doc_id").take(pa.array(rows.pop("row"), pa.int64()))
            columns = {"doc_id": taken, "part": pa.array(np.full(len(taken), part, np.int32))}
            kinds = {"piece": pa.int32()}
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, part int, piece int, start long, length long, ids_crc32 long, rank long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Place every document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is a document of the end id alone.  Documents longer than a sequence are cut, others never.  Repeated
    rows are packed as often as they come; null ids stay null.  Only ``doc_id`` and ``text`` are read.  An empty table gives
    no rows.  The texts are encoded once: the pieces, rows of a few numbers, are stored before they are counted.
    """
    rows = stored(pieces(docs, tokenizer, capacity, end_id), "pieces")
    by_part = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    # At most ``capacity`` rows reach the driver.
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    places = rows.sparkSession.sparkContext.broadcast(Places(solve(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    ranked = rows.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("earlier")).drop("earlier", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places.value.find(np.asarray(batch.column("length")), np.asarray(batch.column("rank")))
            kept = {name: batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(found[0]), "offset": pa.array(found[1])})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
