"""Encoding with a public byte-level BPE vocabulary.

Method: contiguous rank array.  A short word keeps its part boundaries and the
ranks of adjacent parts in two arrays; the minimum rank is sought by a scan,
its boundary deleted, and the neighbouring ranks are refreshed.  Words of more
than ``LONG_WORD`` bytes keep the same ranks in a heap over linked parts, which
gives the same merges without the square of the length.

Texts are cut into words first; words recur, so each worker keeps the ids of
those it has met, up to a bound, after which it starts anew.

Defined results: null and empty texts have an empty list of ids; strings that
look like special tokens are ordinary text; lone surrogates cannot occur in
Arrow strings.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokenizer of this vocabulary (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII letters only, for the faster engine.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
_ANY = regex.compile(PATTERN)
LONG_WORD = 200
CACHED_WORDS = 200_000


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by the contiguous rank array."""
    never = 1 << 60
    at = list(range(len(word) + 1))
    rank = [ranks.get(word[i : i + 2], never) for i in range(len(word) - 1)]
    while rank:
        least = min(rank)
        if least == never:
            break
        i = rank.index(least)
        del at[i + 1]
        del rank[i]
        if i < len(rank):
            rank[i] = ranks.get(word[at[i] : at[i + 2]], never)
        if i:
            rank[i - 1] = ranks.get(word[at[i - 1] : at[i + 1]], never)
    return [ranks[word[a:b]] for a, b in zip(at, at[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with the ranks in a heap."""
    n = len(word)
    end = list(range(1, n + 1))
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := prev[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Word to ids; a mapping that fills itself."""

    def __init__(self, vocabulary: bytes) -> None:
        super().__init__()
        self.ranks = load_ranks(vocabulary)

    def __missing__(self, word: str) -> list[int]:
        raw = word.encode()
        found = self.ranks.get(raw)
        ids = [found] if found is not None else merge_short(raw, self.ranks) if len(raw) <= LONG_WORD else merge_long(raw, self.ranks)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words = (_ASCII if text.isascii() else _ANY).findall(text)
        return list(chain.from_iterable(map(self.__getitem__, words)))


@lru_cache(maxsize=2)
def encoder_of(vocabulary: bytes) -> Encoder:
    """One encoder per process and vocabulary."""
    return Encoder(vocabulary)


def encoder(path: str = VOCABULARY) -> Encoder:
    with open(path, "rb") as f:
        return encoder_of(f.read())


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary's file, read on the driver alone and sent to all; its size is fixed."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_batches(batches: Iterable[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    e = encoder_of(vocabulary.value)
    for b in batches:
        # Very long texts: slices keep a batch's ids far below an Arrow list's limit.
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            ids = pa.array([e.encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))
            yield pa.record_batch([part.column(0), ids], names=["doc_id", "ids"])


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``documents``; no shuffle."""
    file = shipped(documents.sparkSession, vocabulary)
    return documents.select("doc_id", "text").mapInArrow(lambda it: encode_batches(it, file), "doc_id bigint, ids array<int>")


def decode_batches(batches: Iterable[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    words = {i: w for w, i in encoder_of(vocabulary.value).ranks.items()}
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            texts = [b"".join(map(words.__getitem__, ids.as_py())).decode() if ids.is_valid else None for ids in part.column(1)]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def texts_of(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` of what :func:`token_ids` gave: the inverse, null texts apart, which are empty."""
    file = shipped(ids.sparkSession, vocabulary)
    return ids.select("doc_id", "ids").mapInArrow(lambda it: decode_batches(it, file), "doc_id bigint, text string")
