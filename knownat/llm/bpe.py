"""Byte-level BPE by a local rank file: ids of whole texts and the raw bytes that the ids decode to."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

#: White space as the pattern's library counts it; Python's own class also holds the separators U+001C to U+001F.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a run of white space begins, a match of the pattern ends: no alternative goes on from a visible character to white
#: space.  A text may be cut there and encoded in parts.
CUT = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """Ranks are read from ``path``; no special tokens are known, so their strings are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = 1 << 16) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut only where a match of the pattern ends.

    A text without white space stays whole; the library merges a long piece in near-linear time.
    """
    begun = 0
    while len(text) - begun > 2 * size:
        cut = CUT.search(text, begun + size)
        if cut is None:
            break
        yield text[begun:cut.start()]
        begun = cut.start()
    yield text[begun:]


def encode(text: str | None, ranks: str, pattern: str) -> list[int]:
    """Ids of a whole text; none for a null or empty text."""
    if not text:
        return []
    own = encoding(ranks, pattern)
    return [i for part in parts(text) for i in own.encode_ordinary(part)]


def decode(ids: list[int], ranks: str, pattern: str) -> bytes:
    return encoding(ranks, pattern).decode_bytes(ids)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids, ids_sha256, decoded_sha256``.

    Null and empty texts have no ids and the digests of nothing; repeated rows give repeated rows; a null id stays null.
    Only ``doc_id`` and ``text`` are read, so other columns cannot clash.  ``ids`` are left out unless asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode(text, ranks, pattern) for text in batch.column("text").to_pylist()]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(ids) for ids in found], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(array("I", ids).tobytes()).hexdigest() for ids in found], pa.string()),
                "decoded_sha256": pa.array(
                    [hashlib.sha256(decode(ids, ranks, pattern)).hexdigest() for ids in found], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
