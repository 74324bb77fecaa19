"""Exact duplicates by counting quotient filters: one filter per task, merged by sorted remainders, then bytes compared.

A fingerprint of 64 bits is cut into a quotient (its slot) and a remainder.  A filter keeps, for each occupied slot, the
sorted remainders of its run and their counts.  Two filters of the same shape merge without loss: runs of one slot are merged
in remainder order and counts of equal remainders are added, which gives the filter of the union of both inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import SPACES, free_name, normal_text, stored


@dataclass
class CountingQuotientFilter:
    """Runs in slot order: ``quotients`` of the occupied slots, ``lengths`` of their runs, then remainders and counts."""

    bits: int
    quotients: np.ndarray
    lengths: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """Count fingerprints (unsigned, 64 bits) with ``bits`` quotient bits."""
        fingerprints = np.asarray(fingerprints, np.uint64)
        each = np.ones(len(fingerprints), np.int64) if counts is None else np.asarray(counts, np.int64)
        order = np.argsort(fingerprints, kind="stable")
        fingerprints, each = fingerprints[order], each[order]
        first = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]]) if len(fingerprints) else np.zeros(0, int)
        return cls._runs(fingerprints[first], np.add.reduceat(each, first) if len(first) else each[:0], bits)

    @classmethod
    def _runs(cls, distinct: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        shift = np.uint64(64 - bits)
        slots = distinct >> shift
        first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else np.zeros(0, int)
        return cls(bits, slots[first], np.diff(first, append=len(slots)), distinct & ((np.uint64(1) << shift) - np.uint64(1)), counts)

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients, self.lengths) << np.uint64(64 - self.bits)) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of both inputs: two runs in slot and remainder order become one, counts of equals are added."""
        if self.bits != other.bits:
            raise ValueError("filters of different shapes do not merge")
        small, large = sorted((self, other), key=lambda f: len(f.counts))
        ours, theirs = large.fingerprints(), small.fingerprints()
        place = np.searchsorted(ours, theirs)
        equal = place < len(ours)
        equal[equal] = ours[place[equal]] == theirs[equal]
        counts = large.counts.copy()
        counts[place[equal]] += small.counts[equal]
        new = place[~equal]
        return self._runs(np.insert(ours, new, theirs[~equal]), np.insert(counts, new, small.counts[~equal]), self.bits)

    def slices(self, width: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The filter cut at its top ``width`` quotient bits; each slice merges on its own."""
        tops = self.quotients >> np.uint64(self.bits - width)
        ends = np.cumsum(self.lengths)
        for top in np.unique(tops):
            a, b = np.searchsorted(tops, top), np.searchsorted(tops, top, "right")
            low, high = (ends[a - 1] if a else 0), ends[b - 1]
            yield int(top), CountingQuotientFilter(
                self.bits, self.quotients[a:b], self.lengths[a:b], self.remainders[low:high], self.counts[low:high])

    def to_bytes(self) -> tuple[bytes, bytes, bytes, bytes]:
        """Quotients and remainders in as many bytes as their bits need."""
        return (packed(self.quotients, self.bits), self.lengths.astype("<u4").tobytes(),
                packed(self.remainders, 64 - self.bits), self.counts.astype("<i8").tobytes())

    @classmethod
    def from_bytes(cls, bits: int, parts: tuple[bytes, bytes, bytes, bytes]) -> CountingQuotientFilter:
        return cls(bits, unpacked(parts[0], bits), np.frombuffer(parts[1], "<u4"), unpacked(parts[2], 64 - bits),
                   np.frombuffer(parts[3], "<i8"))


def packed(values: np.ndarray, bits: int) -> bytes:
    """Whole numbers below ``2 ** bits``, each in its lowest bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)].tobytes()


def unpacked(raw: bytes, bits: int) -> np.ndarray:
    size = -(-bits // 8)
    whole = np.zeros((len(raw) // size, 8), np.uint8)
    whole[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return whole.ravel().view("<u8")


def add_filter(waiting: list[CountingQuotientFilter], new: CountingQuotientFilter) -> None:
    """Put ``new`` on the pile, merged with those above that are not much larger.

    What stays on the pile at least doubles from top to bottom, so each fingerprint is merged a logarithmic number of times.
    """
    while waiting and len(waiting[-1].counts) <= 2 * len(new.counts):
        new = waiting.pop().merge(new)
    waiting.append(new)


PARTS = ("quotients", "lengths", "remainders", "counts")


def count_fingerprints(rows: DataFrame, column: str, bits: int, width: int) -> DataFrame:
    """``fingerprint, copies`` of every fingerprint, through one filter per task and a merge per slice."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[CountingQuotientFilter] = []
        for batch in batches:
            add_filter(waiting, CountingQuotientFilter.build(np.asarray(batch.column(0)).view(np.uint64), bits))
        while len(waiting) > 1:
            waiting.append(waiting.pop().merge(waiting.pop()))
        found = waiting[0] if waiting else None
        if found is not None and len(found.counts):
            tops, parts = zip(*((top, part.to_bytes()) for top, part in found.slices(width)))
            yield pa.RecordBatch.from_pydict({"slice": pa.array(tops, pa.int32())} | {
                name: pa.array([p[k] for p in parts], pa.binary()) for k, name in enumerate(PARTS)})

    def merge(group: pa.Table) -> pa.Table:
        filters = [CountingQuotientFilter.from_bytes(bits, parts)
                   for parts in zip(*(group.column(name).to_pylist() for name in PARTS))]
        while len(filters) > 1:
            filters = [a.merge(b) for a, b in zip(filters[::2], filters[1::2])] + filters[len(filters) // 2 * 2:]
        whole = filters[0]
        return pa.table({"fingerprint": whole.fingerprints().view(np.int64), "copies": whole.counts})

    slices = rows.select(column).mapInArrow(build, "slice int, quotients binary, lengths binary, remainders binary, counts binary")
    return slices.groupBy("slice").applyInArrow(merge, "fingerprint long, copies long")


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(normal_text(column), SPACES, " ")


def exact_duplicates(docs: DataFrame, bits: int = 24, width: int = 0) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space became one space; null counts as empty.  The smallest
    doc_id of equal texts stays; null ids rank last, and a group of null ids only has a null ``keep_id``.  Of rows that repeat
    the smallest id one is kept.  Extra columns are not read.  ``width`` top bits cut the filters into slices that merge
    apart; 0 takes as many as give a slice about a million documents.
    """
    width = width or max(3, min(bits, (docs.count() >> 20).bit_length() + 3))
    prints = docs.select("doc_id", normalised().alias("_text")).select(
        "doc_id", F.xxhash64("_text").alias("fingerprint"), F.sha2("_text", 256).alias("text_sha256"))
    rows = stored(prints, "exact-prints")
    often = count_fingerprints(rows, "fingerprint", bits, width).where("copies > 1").select("fingerprint")
    often = stored(often, "exact-often")
    # Bytes of texts whose fingerprint came twice: grouping by the text itself compares them whole, combined in each task.
    suspects = docs.select("doc_id", normalised().alias("_text")).withColumn("fingerprint", F.xxhash64("_text")).join(
        often, "fingerprint", "left_semi")
    groups = suspects.groupBy("fingerprint", "_text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).select(
        "fingerprint", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    # Rows that agree in everything are counted before the join and written out again after it.
    counted = rows.groupBy("doc_id", "fingerprint", "text_sha256").agg(F.count("*").alias("_rows"))
    joined = counted.join(groups, ["fingerprint", "text_sha256"], "left")
    single = F.col("group_size").isNull()
    return joined.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.when(single, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("_row") == 1)).alias("kept"),
        "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest doc_id of each group of equal texts, once.

    All columns of ``docs`` are handed on, whatever their names.  Rows that agree in id and text are reduced in each task before whole
    rows are sent, and the join with the kept ones uses the same digest of id and text, so texts are shuffled once.
    """
    def key(sha: Column) -> Column:
        return F.sha2(F.concat_ws("/", sha, F.col("doc_id").cast("string")), 256)

    name = free_name(docs, "_key")
    kept = exact_duplicates(docs).where("kept").select(key(F.col("text_sha256")).alias(name))
    once = docs.withColumn(name, key(F.sha2(normalised(), 256))).dropDuplicates([name])
    return once.join(kept, name, "left_semi").select(*docs.columns)
