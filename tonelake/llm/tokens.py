"""Encoding of a corpus with a public byte-level BPE vocabulary, without any tokenizer library.

A text is cut by the vocabulary's pattern; each piece starts as single bytes. A segment tree over the byte positions
holds, for every live position, the rank of the pair it forms with its live right neighbour, and yields the leftmost
pair of least rank; a merge updates the positions of the merged pair and of its left neighbour, each in logarithmic
time. A piece of n bytes costs O(n log n) however long it is. Pieces repeat, so their ids are kept in a bounded
dictionary per worker; the bound only limits memory, not results.

Defined results: a null text and a text without characters have no ids (an empty list); blank texts are encoded as
they stand; special tokens are ordinary text; every row gives one row, repeated ids too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.sources.tables import text_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation pattern of this vocabulary family; \s is spelt as the Unicode property.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces kept per worker, and the length up to which a piece is kept.
KEPT, KEPT_LENGTH = 200_000, 48


def read_ranks(text: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line)}


class Merger:
    """Byte-pair merging of single pieces by a segment tree."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.none = 1 << 60

    def encode(self, piece: bytes) -> list[int]:
        ranks, none = self.ranks, self.none
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # end of the part that begins at a position
        before = list(range(-1, n - 1))  # begin of the live part to the left
        size = 1 << (n - 1).bit_length()
        # a leaf holds rank * size + position, so that the least one is the leftmost pair of least rank
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r * size + i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, v: int) -> None:
            k = size + i
            tree[k] = v
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                m = a if a < b else b
                if tree[k] == m:
                    break
                tree[k] = m
                k >>= 1

        def pair(i: int) -> int:
            mid = end[i]
            if mid >= n:
                return none
            r = ranks.get(piece[i : end[mid]])
            return none if r is None else r * size + i

        while tree[1] < none:
            i = tree[1] % size
            gone = end[i]
            end[i] = end[gone]
            if end[i] < n:
                before[end[i]] = i
            put(gone, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.merger, self.find, self.kept = Merger(ranks), regex.compile(pattern).findall, {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        kept = self.kept
        for piece in self.find(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.merger.encode(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= KEPT_LENGTH:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def shared_encoder(key: tuple[int, str], content: bytes) -> Encoder:
    """One encoder per worker and vocabulary."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(content), key[1])
    return _ENCODERS[key]


def encode_corpus(df: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids): one row per row of `df`. The vocabulary (under 1 MB) is read by the driver and broadcast."""
    spark = df.sparkSession
    with open(vocabulary, "rb") as f:
        content = f.read()
    if len(content) > 64_000_000:
        raise ValueError("a vocabulary of over 64 MB is not broadcast")
    sent, key = spark.sparkContext.broadcast(content), (hash(content), pattern)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(key, sent.value)
        for batch in text_rows(batches):
            ids, done, held = [], 0, 0
            for t in batch.column(1):
                one = encoder.encode(t.as_py())
                ids.append(one)
                held += len(one)
                if held > 2_000_000:  # long texts: hand over what is done
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(ids)), pa.array(ids, schema.field(1).type)], schema=schema)
                    done, held, ids = done + len(ids), 0, []
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(ids)), pa.array(ids, schema.field(1).type)], schema=schema)

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")
