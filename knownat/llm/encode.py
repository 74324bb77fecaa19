"""Byte-pair ids of whole texts by a tokenizers file, with repeated chunks encoded once per task."""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402
from tokenizers.pre_tokenizers import CharDelimiterSplit  # noqa: E402

#: A space before a visible character always begins a new match of the byte-level pattern, whatever precedes it: words, numbers
#: and signs take at most one leading space, and a run of white space gives its last space up to them.
BOUNDARY = re.compile(r" (?=\S)")
#: In a text without this a line end is always a match of its own, so that it can be cut before it as well.
DENSE_SPACE = r"[ \n][ \n]|[ \n]\z|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes of text whose chunks are held at once.
RUN_BYTES = 32 << 20
INNER_SPACE = re.compile(r"\s")
#: A word of Latin letters.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """How the byte-level alphabet writes the Latin letters beyond ASCII: each of their bytes is itself a printed character."""
    shifted = iter(range(256, 512))
    printed = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(shifted)) for b in range(256)}
    return {code: "".join(printed[b] for b in chr(code).encode()) for code in range(0xC0, 0x100)}


class Encoder:
    """Encodes chunks between safe boundaries and joins their ids; equal to encoding the whole text.

    Chunks seen lately come from a cache of at most about two times ``kept`` short chunks; it changes no result.
    """

    def __init__(self, path: str, kept: int = 450_000, longest: int = 48):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kept, self.longest = kept, longest
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = byte_letters()
        #: The same model without the pattern, for words that are one match each.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        self.fixed = dict(zip(("\n", ".", ","), self._ids(["\n", ".", ","])))
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that only the first match of a chunk without inner white space can begin with: its space, or its line end.
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[number for token, number in vocabulary.items() if token[0] == "Ġ" or token == "Ċ"]] = True

    def encode_all(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; nothing for a null or empty text.

        Lists of chunks hold no cycles, so Python need not search them for any meanwhile.
        """
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        run = np.cumsum(np.asarray(pc.binary_length(column)).astype(np.int64)) // RUN_BYTES
        edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
        gc.disable()
        try:
            return [ids for a, b in zip(edges, edges[1:]) if b > a for ids in self._encode(column.slice(a, b - a))]
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> list[bytes]:
        if len(self.recent) > self.kept:
            self.recent, self.older = {}, self.recent
        known = self.recent
        known[""] = b""
        # Where white space stands alone, every space and every line end is a boundary; else only the certain ones are.
        certain = pc.match_substring_regex(texts, DENSE_SPACE)
        split = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(certain)), "\n", " \n"), " ")
        edges, chunks = np.asarray(split.offsets), split.values.dictionary_encode()
        names = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        rest = [BOUNDARY.split(text) for text in texts.filter(certain).to_pylist()]
        wanted = set(filterfalse(known.__contains__, names))
        for parts in rest:
            wanted.update(filterfalse(known.__contains__, parts[1:]))
        self._learn(wanted)
        # First chunks are no chunks after a space: they get ids of their own.
        first = split.values.take(pa.array(edges[:-1]))
        place = np.asarray(chunks.indices).copy()
        place[edges[:-1]] = len(names)
        joined = pa.array([*map(known.__getitem__, names), b""], pa.large_binary()).take(pa.array(place))
        ends = np.append(0, np.frombuffer(joined.buffers()[1], np.int64)[1:len(place) + 1])[edges].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        plain = iter([head + data[a:b] for head, a, b in zip(self._ids(first.to_pylist()), ends, ends[1:])])
        loose = iter([head + b"".join(map(known.__getitem__, parts[1:])) for head, parts in zip(self._ids([p[0] for p in rest]), rest)])
        for chunk in wanted:
            if len(chunk) > self.longest:
                known.pop(chunk, None)
                known.pop(chunk[:-1], None)
        return [next(loose if dense else plain) for dense in certain.to_pylist()]

    def _learn(self, wanted: set[str]) -> None:
        """Put ids of these chunks, none of which it has, into ``recent``."""
        known, older = self.recent, self.older
        again = wanted & older.keys()
        known.update(zip(again, map(older.__getitem__, again)))
        words, ended, others = [], [], []
        for chunk in wanted - again if again else wanted:
            if chunk.isalpha():
                (words if chunk.isascii() or LATIN.fullmatch(chunk) else others).append(chunk)
            elif chunk[-1] in ".," and (word := chunk[:-1]).isalpha() and (word.isascii() or LATIN.fullmatch(word)):
                ended.append(chunk)
            else:
                others.append(chunk)
        known.update(zip(words, self._words(words)))
        # A word with a full stop or comma is two matches; the word itself may be known, too.
        bases = {chunk[:-1] for chunk in ended}.difference(known)
        found = {word: older[word] for word in bases & older.keys()}
        missing = list(bases.difference(found))
        found.update(zip(missing, self._words(missing)))
        known.update(found)
        fixed = self.fixed
        known.update([(chunk, known[chunk[:-1]] + fixed[chunk[-1]]) for chunk in ended])
        known.update(zip(others, self._others(others)))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words after a space. A word is one match of the pattern: its merges need no splitting before."""
        if not words:
            return []
        written = " Ġ".join([word if word.isascii() else word.translate(self.letters) for word in words])
        return self._cut(self.words, "Ġ" + written, len(words)) or self._ids([" " + word for word in words])

    def _others(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks after a space or with their line end; those that no inner white space joins to others are encoded as one text."""
        written = [c if c[:1] == "\n" else " " + c for c in chunks]
        alone = [bool(INNER_SPACE.search(c, 1)) for c in written]
        plain = [c for c, apart in zip(written, alone) if not apart]
        together = iter((plain and self._cut(self.tokenizer, "".join(plain), len(plain))) or self._ids(plain))
        apart = iter(self._ids([c for c, apart in zip(written, alone) if apart]))
        return [next(apart if a else together) for a in alone]

    def _cut(self, tokenizer: Tokenizer, text: str, number: int) -> list[bytes]:
        """Ids of a text of so many chunks, cut where chunks begin; nothing if they do not begin as often."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        edges = np.append(np.flatnonzero(self.begins[ids]), len(ids)) * 4
        if len(edges) != number + 1 or edges[0]:
            return []
        joined, edges = ids.tobytes(), edges.tolist()
        return [joined[a:b] for a, b in zip(edges, edges[1:])]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", least: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``least`` bytes of text: a chunk that a batch repeats is looked up once."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.column(column).nbytes
        if size >= least:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)
