"""Encoding of a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker remembers; the memory is emptied when full, which changes no result.
REMEMBERED = 200_000
#: Words over this many bytes are not remembered.
LONG_WORD = 64


def load_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    """The vocabulary file: a base64 token and its rank, which is also its id, on each line."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines)}


def bpe(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Ids of one word by merging the pair of lowest rank, leftmost first, until none merges.

    The symbols are a doubly linked list over the byte positions, candidate pairs a priority queue
    of (rank, position, both lengths); an entry whose symbols have merged since is stale and is
    skipped. n log n in the length of the word.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    size = [1] * n  # of the symbol that starts here; 0 once it is merged into its left neighbour
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            queue.append((rank, i, 1, 1))
    heapq.heapify(queue)
    while queue:
        _, i, left, right = heapq.heappop(queue)
        j = i + left
        if size[i] != left or j >= n or size[j] != right:
            continue  # stale
        size[i], size[j] = left + right, 0
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get(word[i : k + size[k]])
            if rank is not None:
                heapq.heappush(queue, (rank, i, size[i], size[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get(word[h:k])
            if rank is not None:
                heapq.heappush(queue, (rank, h, size[h], size[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Callable[[str], list[int]]:
    """A function from text to ids; a worker process makes it once and keeps it, with its words, over all its tasks.

    Special tokens' strings are ordinary text.
    """
    import sys
    import types

    import regex

    kept = sys.modules.setdefault("knotwork_worker_memory", types.ModuleType("knotwork_worker_memory")).__dict__
    if ("encoder", name, folder) in kept:
        return kept["encoder", name, folder]

    ranks = load_ranks(name, folder)
    split = regex.compile(PATTERN).findall

    class Words(dict):
        def __missing__(self, word: str) -> list[int]:
            raw = word.encode("utf-8", "surrogatepass")
            ids = bpe(raw, ranks)
            if len(raw) <= LONG_WORD:
                if len(self) >= REMEMBERED:
                    self.clear()
                self[word] = ids
            return ids

    words = Words()

    def encode(text: str) -> list[int]:
        out: list[int] = []
        for word in split(text):
            out += words[word]
        return out

    kept["encoder", name, folder] = encode
    return encode


def decoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Callable[[list[int]], bytes]:
    """A function from ids to bytes: the vocabulary's strings, one after the other."""
    tokens = {i: t for t, i in load_ranks(name, folder).items()}
    return lambda ids: b"".join([tokens[i] for i in ids])


def encoded(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``ids`` (array of int), one row per row of ``df``; other columns are not read.

    A null and an empty text give an empty list; texts of any length are encoded whole; repeated
    rows are encoded each. Every task encodes the rows it scans: there is no shuffle.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder)
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                ids = [encode(t) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def token_counts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``n_tokens`` of each row, by the same encoder; ids are counted where they are made."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder)
        for b in batches:
            counts = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], schema.names)

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
