"""Problem 8: encoding of the whole corpus with a public tokenizer.

Byte-level BPE. A text is cut by the tokenizer's pattern; each piece becomes a doubly linked list
of byte symbols, and a priority queue of merge ranks merges the lowest-ranked neighbouring pair
again and again, skipping entries that a merge has made stale. Decoding concatenates the
vocabulary's strings. Pieces repeat, so each process remembers the pieces it has encoded (a
bounded memory that changes no result).

Null, empty: an empty list. Blank texts are encoded like any other. Texts are encoded whole, at
any length; strings of special tokens are ordinary text; lone surrogates become the replacement
character. Documents keep their id, repeated rows their own result; extra columns are ignored.
"""

from __future__ import annotations

import array
import base64
import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Fixed value: the pattern that cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER = "/opt/tokenizers"
REMEMBERED = 400_000


class BytePairEncoder:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
        self.strings = {rank: token for token, rank in self.ranks.items()}
        self.cut = regex.compile(PATTERN).findall
        self.memory: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        symbols: list[bytes | None] = [piece[i : i + 1] for i in range(size)]
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        queue = []
        for i in range(size - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                queue.append((rank, i, 2))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            rank, i, length = pop(queue)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j >= size:
                continue
            right = symbols[j]
            joined = left + right
            # stale: the symbols at this place have changed since the entry was made
            if len(joined) != length or ranks.get(joined) != rank:
                continue
            symbols[i], symbols[j] = joined, None
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                pair = joined + symbols[k]
                found = ranks.get(pair)
                if found is not None:
                    push(queue, (found, i, len(pair)))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + joined
                found = ranks.get(pair)
                if found is not None:
                    push(queue, (found, h, len(pair)))
        return [ranks[s] for s in symbols if s is not None]

    def encode_into(self, text: str, out: array.array) -> None:
        memory, extend = self.memory, out.extend
        get = memory.get
        for piece in self.cut(text):
            ids = get(piece)
            if ids is None:
                ids = tuple(self.merge(piece.encode("utf-8", "replace")))
                if len(piece) < 64:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[piece] = ids
            extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array.array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(self.strings[i] for i in ids)

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(2)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(path)


def encode(documents: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids) of every document."""
    path = f"{folder}/{vocabulary}.tiktoken"
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            # small slices keep the memory of a batch of long texts low
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                flat, offsets = array.array("i"), array.array("i", [0])
                for x in part.column(1):
                    value = x.as_py()
                    if value:
                        bpe.encode_into(value, flat)
                    offsets.append(len(flat))
                lists = pa.ListArray.from_arrays(
                    pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]),
                    pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]),
                )
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = f"{folder}/{vocabulary}.tiktoken"
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
