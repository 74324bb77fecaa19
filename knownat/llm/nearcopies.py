"""Near duplicates by fast similarity sketches, banding and exact verification on full shingle sets.

A sketch throws the members of a set into bins, round after round with new hash functions, until every bin is filled; a last
set of rounds fills each bin by itself, so none can stay empty.  A bin keeps its least value, values of later rounds being
larger.  Two sketches agree in a bin with the probability of the sets' similarity, with the spread of as many independent
trials.

Links are found in two passes over the bands.  First every member of a band meets the band's least document; true links become
components.  Then only bands that still hold different components compare, by sketch and in blocks, members of different
components; a document that may be similar to one of another component meets that component's whole texts, pack by pack.
Links within a component need no check: they cannot change it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import lower_table, stored, utf8
from knownat.llm.components import connected

BINS, BANDS = 128, 32
#: Pairs of sketches that agree in fewer bins are not compared: five standard deviations below a similarity of 0.75.
AGREEING = 0.55
LOWER = lower_table()
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, element by element."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted 64-bit hashes of a text's distinct word shingles; word hashes are kept between texts, in a bounded table."""

    def __init__(self, size: int = 5, kept: int = 300_000):
        self.size, self.kept = size, kept
        self.words: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.words.get, words))
        if None in found:
            if len(self.words) > self.kept:
                self.words.clear()
            self.words.update((w, xxhash.xxh3_64_intdigest(w)) for w in words)
            found = [self.words[w] for w in words]
        return np.array(found, np.uint64)

    def shingles(self, text: bytes) -> np.ndarray:
        """Distinct shingles; of fewer words the whole sequence is one; without words there are none."""
        words = text.translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        each = self.hashes(words)
        size = min(self.size, len(words))
        count = len(words) - size + 1
        value = np.full(count, size, np.uint64)
        for k in range(size):
            value = mix(value * _MIX[2] + each[k:k + count])
        return np.unique(value)


def sketch(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch of a set that is not empty: one 32-bit value per bin."""
    best = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    bits = np.uint64(bins.bit_length() - 1)
    for turn in range(2 * bins):
        value = mix(shingles + np.uint64((turn + 1) * int(_MIX[2]) % (1 << 64)))
        # The round stands in the top bits, so that an earlier round's value is less than any later one.
        ranked = (value >> np.uint64(9)) | (np.uint64(turn) << np.uint64(55))
        if turn < bins:
            np.minimum.at(best, (value & (np.uint64(bins) - np.uint64(1))).astype(np.int64), ranked)
        else:
            best[turn - bins] = min(best[turn - bins], ranked.min())
        if best.max() != np.iinfo(np.uint64).max:
            break
    return (mix(best + bits) >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band of equally many bins."""
    rows = signature.reshape(bands, -1).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for column in rows.T:
        key = mix(key * _MIX[2] + column)
    return key.view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest, sketch, bands``; the last three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler()
        for batch in batches:
            sizes, digests, sketches, bands = [], [], [], []
            for text in utf8(batch.column("text")):
                found = own.shingles(text)
                sizes.append(len(found))
                signature = sketch(found) if len(found) else None
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sketches.append(None if signature is None else signature.tobytes())
                bands.append(None if signature is None else band_keys(signature))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_shingles": pa.array(sizes, pa.int64()),
                "digest": pa.array(digests, pa.binary()), "sketch": pa.array(sketches, pa.binary()),
                "bands": pa.array(bands, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, sketch binary, bands array<long>")


def alike(sizes: np.ndarray, sketches: np.ndarray, size: np.ndarray, signature: np.ndarray, percent: int) -> np.ndarray:
    """Which rows may reach the similarity with one row, by size and by sketch."""
    close = 100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)
    return close & ((sketches == signature).sum(1) >= AGREEING * sketches.shape[1])


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sizes and sketches allow a link."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (np.asarray(batch.column(c)) for c in ("na", "nb"))
            good = alike(na, _signatures(batch.column("sa")), nb, _signatures(batch.column("sb")), percent)
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(good)) for c in ("a", "b")})

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, percent: int, together: int = 256) -> DataFrame:
    """The pairs ``a, b`` whose whole shingle sets have 100 * intersection >= percent * union.

    A document ``a`` of many pairs is dealt out with at most about ``together`` partners to a task.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    salted = pairs.join(pairs.groupBy("a").agg((F.count("*") / together).cast("int").alias("more")), "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("more") + 1).cast("int").alias("salt"))
    partners = salted.join(texts, F.col("b") == F.col("id")).select("a", "salt", "b", "text")
    centers = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("id")).select(
        "a", "salt", F.lit(None).cast("long").alias("b"), "text")

    def run(group: pa.Table) -> pa.Table:
        own = Shingler()
        center = group.column("a")[0].as_py()
        ids = group.column("b").to_pylist()
        texts = utf8(group.column("text").combine_chunks())
        wholes = [own.shingles(t) for b, t in zip(ids, texts) if b is None]
        found = set()
        for b, text in zip(ids, texts):
            if b is None or b in found:
                continue
            other = own.shingles(text)
            for whole in wholes:
                common = len(np.intersect1d(whole, other, assume_unique=True))
                if common and 100 * common >= percent * (len(whole) + len(other) - common):
                    found.add(b)
        return pa.table({"a": pa.array([center] * len(found), pa.int64()), "b": pa.array(sorted(found), pa.int64())})

    return partners.union(centers).groupBy("a", "salt").applyInArrow(run, "a long, b long")


def across(members: DataFrame, percent: int, block: int = 2048) -> DataFrame:
    """``x, comp``: a document and another component that may hold a text similar to it, in a band they share.

    ``members`` has ``band, rep, comp, of, n, sketch, size`` (``of``: documents of the component, ``size``: rows of the band).  A
    large band is cut into blocks by a hash, and pairs of blocks are separate tasks.  Of two components the smaller one's
    documents are named, and each once per component, so a large group does not multiply the rows.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("rep", "band"), blocks).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "comp", "of", "n", "sketch")

    def run(group: pa.Table) -> pa.Table:
        rep, comp, of, n, own = (np.asarray(group.column(c).combine_chunks()) for c in ("rep", "comp", "of", "n", "own"))
        signatures = _signatures(group.column("sketch"))
        within = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        found: set[tuple[int, int]] = set()
        for row in range(len(rep)):
            later = np.arange(row + 1, len(rep)) if within else np.flatnonzero(own > own[row])
            later = later[comp[later] != comp[row]]
            near = later[alike(n[later], signatures[later], n[row], signatures[row], percent)]
            smaller = (of[near] < of[row]) | ((of[near] == of[row]) & (comp[near] > comp[row]))
            found.update((int(x), int(comp[row])) for x in rep[near[smaller]])
            found.update((int(rep[row]), int(c)) for c in np.unique(comp[near[~smaller]]))
        x, c = zip(*sorted(found)) if found else ((), ())
        return pa.table({"x": pa.array(x, pa.int64()), "comp": pa.array(c, pa.int64())})

    return dealt.groupBy("band", "i", "j").applyInArrow(run, "x long, comp long").distinct()


def meetings(named: DataFrame, places: DataFrame, docs: DataFrame, percent: int, pack: int = 256, together: int = 1024) -> DataFrame:
    """Links ``a, b`` between the documents ``x`` and the components ``comp`` that ``named`` puts together.

    ``places`` has ``rep, comp, of`` of every document.  A component is cut into packs of about ``pack`` texts; a task holds one
    pack and at most about ``together`` of the documents that it meets.  One link of a document with a pack is enough: it joins
    the components.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    packs = F.ceil(F.col("of") / pack).cast("int")
    wanted = named.groupBy("comp").agg((F.ceil(F.count("*") / together)).cast("int").alias("salts"))
    sides = places.join(wanted, "comp").withColumn("packs", packs)
    counted = sides.select("comp", "packs", "salts").distinct()
    held = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(
        "comp", F.pmod(F.xxhash64("rep"), F.col("packs")).cast("int").alias("pack"), "salt", F.lit(True).alias("held"),
        F.col("rep").alias("id"))
    met = named.join(counted, "comp").withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1))).select(
        "comp", "pack", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("held"),
        F.col("x").alias("id"))
    dealt = held.union(met).join(texts, "id")

    def run(group: pa.Table) -> pa.Table:
        own = Shingler()
        ids, held = group.column("id").to_pylist(), group.column("held").to_pylist()
        sets = [own.shingles(t) for t in utf8(group.column("text").combine_chunks())]
        inner = [k for k, h in enumerate(held) if h]
        if not inner:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        whole = np.concatenate([sets[k] for k in inner])
        sizes = np.array([len(sets[k]) for k in inner])
        owner = np.repeat(np.arange(len(inner)), sizes)
        links = []
        for k, h in enumerate(held):
            if not h:
                common = np.bincount(owner[np.isin(whole, sets[k])], minlength=len(inner))
                good = np.flatnonzero((common > 0) & (100 * common >= percent * (sizes + len(sets[k]) - common)))
                if len(good):
                    links.append((ids[k], ids[inner[good[0]]]))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("comp", "pack", "salt").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * intersection >= percent * union of their sets of five-word shingles (words between ASCII
    white space, A-Z lower-cased).  Null and empty texts have no shingles and link with nothing.  Rows that repeat a doc_id are
    one node that links where any of its texts does; of rows with the kept id all are kept.  A null doc_id links with
    nothing and has a null component.  Other columns are not read.

    Equal sets are one class before any pair is looked at, so copies add no pairs.
    """
    rows = stored(describe(docs), "sketches")
    known = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = stored(known.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
        F.first("bands").alias("bands")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("center"), F.count("*").alias("size")).where("size > 1")
    in_bands = stored(banded.join(shared, "band"), "bands")
    stars = in_bands.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    first = stored(verified(plausible(stars, classes, percent), docs, percent), "verified")
    groups = connected(first)
    in_group = groups.join(groups.groupBy("component").agg(F.count("*").alias("of")), "component")
    places = classes.select("rep").distinct().join(in_group.withColumnRenamed("id", "rep"), "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("comp"), F.coalesce("of", F.lit(1)).alias("of"))
    places = stored(places, "places")
    # Bands of two had their only pair checked above.
    placed = in_bands.where("size > 2").join(places, "rep").select("band", "rep", "size", "comp", "of")
    mixed = placed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band")
    members = placed.join(mixed, "band", "left_semi").join(classes.select("rep", "n", "sketch"), "rep")
    named = stored(across(members, percent), "named")
    second = stored(meetings(named, places, docs, percent), "verified")
    # Classes of one set join their documents; links join classes.
    same = known.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    whole = connected(first.union(second)).select(F.col("id").alias("b"), "component")
    component = same.join(whole, "b", "left").select("a", F.coalesce("component", "b").alias("component_id")).groupBy("a").agg(
        F.min("component_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles").join(component.withColumnRenamed("a", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` without those that a group's kept document stands for; rows with a null id stay."""
    dropped = near_duplicates(docs, percent).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
