"""Spelling variants: words one insertion, deletion or replacement apart, found in a trie of letter-group counts.

A word's vector counts its letters per group; the trie has one level per group and a word's counts as its path.  One edit raises
at most one count by one and lowers at most one by one, so a depth-first search with a surplus and a deficit of one each
reaches every near word; words of the leaves reached are verified.  Each pair is searched once: its first count that differs
must be the surplus.

The trie is cut where a subtree holds at most ``SHARD`` words, and a task searches one subtree: with its own words, and with the
words of other subtrees that a budget leads to it.  Words that all have one vector are cut into blocks, each pair of which meets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import stored

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Letters of one count each, roughly in order of frequency; the last count is of all others.
GROUPS = ("e", "n", "t", "a", "i", "o", "r", "h", "s", "l", "u", "c", "d", "gm", "fbp", "vkwyqxzj")
DEPTH = len(GROUPS) + 1
#: Counts above this are equal, which only adds candidates.
MOST = 30
#: Words of one task's subtree, besides visitors; node or word pairs held at once.
SHARD, CHUNK = 20_000, 400_000
#: Longer words are verified one by one.
WIDTH = 64

_OF = np.full(256, len(GROUPS), np.int64)
for _k, _letters in enumerate(GROUPS):
    for _letter in _letters:
        _OF[ord(_letter)] = _k


def vocabulary(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """``word, n``: runs of Latin letters of all texts, with the contract's slips made, that are long and common enough.

    Null texts have no words; a null id makes no slip.  Rows that repeat an id count each.
    """
    found = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        # A slip only shortens a word, so shorter runs cannot count.
        F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{shortest},}})"), F.lit(1))).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = found.select("id", F.translate("run", upper, upper.lower()).alias("run"))
    hashed = lower.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, slipped).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(
        F.col("n") >= least)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each word begins (one more at the end)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def vectors_of(words: list[str]) -> np.ndarray:
    flat, edges = code_points(words)
    groups = np.where(flat < 256, _OF[np.minimum(flat, 255)], len(GROUPS))
    owner = np.repeat(np.arange(len(words)), np.diff(edges))
    counts = np.bincount(owner * DEPTH + groups, minlength=len(words) * DEPTH).reshape(-1, DEPTH)
    return np.minimum(counts, MOST).astype(np.uint8)


def with_vectors(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = vectors_of(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "word": batch.column("word"), "n": batch.column("n"), "vector": pa.array([v.tobytes() for v in vectors], pa.binary())})

    return words.mapInArrow(run, "word string, n long, vector binary")


def cut(words: DataFrame) -> tuple[set[bytes], dict[bytes, int]]:
    """Paths of more than ``SHARD`` words, at most one in ``SHARD`` words a level, and the blocks of leaves that are as large."""
    split, blocks = set(), {}
    total = words.count()
    if total <= SHARD:
        return split, blocks
    split.add(b"")
    level, parents = 1, None
    sizes = words.groupBy("vector").agg(F.count("*").alias("n"))
    while level <= DEPTH:
        path = F.expr(f"substring(vector, 1, {level})")
        under = sizes if parents is None else sizes.where(F.expr(f"substring(vector, 1, {level - 1})").isin(parents))
        large = [(bytes(r["path"]), r["n"]) for r in under.groupBy(path.alias("path")).agg(F.sum("n").alias("n")).where(
            F.col("n") > SHARD).collect()]
        if not large:
            break
        if level == DEPTH:
            blocks = {p: -(-n // SHARD) for p, n in large}
        else:
            split.update(p for p, _ in large)
        parents, level = [bytearray(p) for p, _ in large], level + 1
    return split, blocks


def homes(vector: bytes, word: str, split: set[bytes], blocks: dict[bytes, int]) -> Iterator[tuple[bytes, bool]]:
    """Subtrees in which a word is looked for, and whether it is one of their own words."""
    stack = [(b"", 0)]
    while stack:
        path, spent = stack.pop()
        level = len(path)
        if level < DEPTH and path in split:
            count = vector[level]
            stack.append((path + vector[level:level + 1], spent))
            if spent == 0:
                stack.append((path + bytes([count + 1]), 1))
            elif spent == 1 and count:
                stack.append((path + bytes([count - 1]), 2))
        elif (many := blocks.get(path, 1)) > 1:
            own = zlib.crc32(word.encode()) % many if spent == 0 else -1
            for block in range(max(own, 0), many):
                yield path + bytes([255]) + block.to_bytes(4, "big"), block == own
        else:
            yield path, spent == 0


class Trie:
    """The distinct vectors of some words; nodes of a level are numbered in order of their paths."""

    def __init__(self, vectors: np.ndarray, looked_up: bool):
        self.order = np.lexsort(vectors.T[::-1])
        sorted_ = vectors[self.order]
        new = np.ones((len(sorted_), DEPTH), bool)
        if len(sorted_) > 1:
            new[1:] = np.logical_or.accumulate(sorted_[1:] != sorted_[:-1], axis=1)
        self.values, self.first, self.tables = [], [], []
        above = np.zeros(len(sorted_), np.int64)
        nodes = 1
        for level in range(DEPTH):
            starts = np.flatnonzero(new[:, level])
            parent, value = above[starts], sorted_[starts, level].astype(np.int64)
            self.values.append(value)
            self.first.append(np.searchsorted(parent, np.arange(nodes + 1)))
            if looked_up:
                table = np.full((nodes, MOST + 3), -1, np.int32)
                table[parent, value + 1] = np.arange(len(starts))
                self.tables.append(table)
            above, nodes = np.cumsum(new[:, level]) - 1, len(starts)
        self.words = np.append(np.flatnonzero(new[:, -1]), len(sorted_))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: each index repeated c times, and 0..c-1 within each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def leaf_pairs(asked: Trie, held: Trie) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leaves that a surplus and a deficit of one each lead to from a leaf: asked, held, spent (0, 1 or 2)."""
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero, np.zeros(1, np.int8))]
    while stack:
        level, a, h, spent = stack.pop()
        if level == DEPTH:
            yield a, h, spent
            continue
        first = asked.first[level]
        owner, step = spread(first[a + 1] - first[a])
        child = first[a][owner] + step
        value, h, spent = asked.values[level][child], h[owner], spent[owner]
        found = []
        for change in (0, 1, -1):
            may = slice(None) if change == 0 else np.flatnonzero(spent == (0 if change == 1 else 1))
            to = held.tables[level][h[may], value[may] + 1 + change]
            good = to >= 0
            found.append((child[may][good], to[good].astype(np.int64), (spent[may] + (change != 0))[good].astype(np.int8)))
        a, h, spent = (np.concatenate(x) for x in zip(*found))
        for at in range(0, len(a), CHUNK):
            stack.append((level + 1, a[at:at + CHUNK], h[at:at + CHUNK], spent[at:at + CHUNK]))


def one_edit(a: str, b: str) -> bool:
    """Whether two different words are one insertion, deletion or replacement apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:])


class Words:
    """Code points of words in a matrix, to verify many pairs at once."""

    def __init__(self, words: list[str]):
        self.words = words
        flat, edges = code_points(words)
        self.length = np.diff(edges)
        width = min(WIDTH, int(self.length.max(initial=1))) + 1
        self.matrix = np.zeros((len(words), width), flat.dtype if flat.max(initial=0) > 255 else np.uint8)
        owner, place = spread(self.length)
        inside = place < width - 1
        self.matrix[owner[inside], place[inside]] = flat[inside]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are one edit apart."""
        swap = self.length[a] > self.length[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        gap = self.length[b] - self.length[a]
        x, y = self.matrix[a], self.matrix[b]
        differs = x != y
        found = (gap == 0) & (differs.sum(axis=1) == 1)
        one = np.flatnonzero(gap == 1)
        if len(one):
            from_here = np.logical_or.accumulate(differs[one], axis=1)[:, :-1]
            found[one] = ~((x[one, :-1] != y[one, 1:]) & from_here).any(axis=1)
        for k in np.flatnonzero(self.length[b] > WIDTH):
            found[k] = one_edit(self.words[a[k]], self.words[b[k]])
        return found


def search(words: list[str], own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of near words, at least one of which is the subtree's own, each pair once."""
    vectors = vectors_of(words)
    mine = np.flatnonzero(own)
    if not len(mine):
        return
    asked, held, texts = Trie(vectors, False), Trie(vectors[mine], True), Words(words)
    for a, h, spent in leaf_pairs(asked, held):
        wide = np.diff(held.words)[h]
        size = np.diff(asked.words)[a] * wide
        ends = np.cumsum(size)
        at = 0
        while at < len(a):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            # A single pair of leaves may still hold more word pairs than a chunk.
            for low in range(0, int(ends[stop - 1] - base), CHUNK):
                place = np.arange(low, min(low + CHUNK, int(ends[stop - 1] - base)))
                owner = at + np.searchsorted(ends[at:stop] - base, place, "right")
                inner = place - (ends[owner] - size[owner] - base)
                one = asked.order[asked.words[a[owner]] + inner // wide[owner]]
                two = mine[held.order[held.words[h[owner]] + inner % wide[owner]]]
                # Equal vectors: pairs of own words come in both orders, and with themselves.
                once = (spent[owner] > 0) | ~own[one] | (one < two)
                one, two = one[once], two[once]
                good = texts.near(one, two)
                if good.any():
                    yield one[good], two[good]
            at = stop


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, other, other_n``: both orders of each pair of words one edit apart.

    ``words`` has distinct ``word`` and ``n``, and should be a stored table: it is read several times.
    """
    vectors = with_vectors(words.select("word", "n"))
    split, blocks = cut(vectors)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, owns, rows = [], [], []
            for k, (word, vector) in enumerate(zip(batch.column("word").to_pylist(), batch.column("vector").to_pylist())):
                for shard, own in homes(vector, word, split, blocks):
                    shards.append(shard)
                    owns.append(own)
                    rows.append(k)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(shards, pa.binary()), "own": pa.array(owns, pa.bool_()), "word": batch.column("word").take(at),
                "n": batch.column("n").take(at)})

    def pairs(key: tuple, shard: pa.Table) -> pa.Table:
        words, own = shard.column("word").combine_chunks(), np.asarray(shard.column("own"))
        n = shard.column("n").combine_chunks()
        found = list(search(words.to_pylist(), own))
        one, two = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        a, b = pa.array(np.concatenate([one, two])), pa.array(np.concatenate([two, one]))
        return pa.table({"word": words.take(a), "other": words.take(b), "other_n": n.take(b)})

    return vectors.mapInArrow(deal, "shard binary, own boolean, word string, n long").groupBy("shard").applyInArrow(
        pairs, "word string, other string, other_n long")


def with_roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a ``form``: the last word that forms lead to.

    A form is at least ``ratio`` times as frequent, so a chain is short; each round doubles the steps taken.
    """
    steps = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10, every: int = 31) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts.

    Empty tables and texts without words give no rows; see ``vocabulary`` for nulls and repeated rows.  Among near words of equal
    count the smallest in code-point order is the form.  Other columns are not read.  The words are counted and searched while the
    result is built.
    """
    words = stored(vocabulary(docs, shortest, least, every), "words")
    near = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("other"))).alias("best"))
    joined = words.join(near, "word", "left")
    high = -F.col("best.minus") >= ratio * F.col("n")
    chosen = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(high, F.col("best.other")).alias("form"),
        F.when(high, -F.col("best.minus")).alias("form_n")), "forms")
    roots = with_roots(chosen.where("form IS NOT NULL"))
    return chosen.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
