"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word is held as its part ids, which mark the boundaries, beside an array with the rank of every adjacent
pair. The smallest rank is found by scanning the array; its boundary is deleted and the two neighbouring ranks
are looked up anew. A word over LONG_WORD bytes keeps its ranks in a heap instead, with the same result, so a
run of letters without end costs n log n. Words repeat, so their ids are kept in bounded caches. A run with a character that the
library of the vocabulary takes for another class (its Unicode tables differ from this module's) is encoded by the library.

Defined results: a null text counts as empty, and an empty text has no ids; repeated rows give repeated rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import prepare, text_of

#: The pattern that splits text into words before the merges; a fixed value of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes from which a word's ranks are kept in a heap.
LONG_WORD = 256
#: Entries of each cache in a Python worker; a full cache is emptied.
CACHE_ENTRIES = 500_000
_NONE = 1 << 60
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary from a tokenizers file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.byte_id = [vocab[symbols[b]] for b in range(256)]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[left] << 20 | vocab[right]] = (rank, vocab[left + right])
        self.ranks = {k: v[0] for k, v in self.pairs.items()}
        self.merged = [v[1] for v in self.pairs.values()]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(symbols)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.words = regex.compile(PATTERN)
        longest_first = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(longest_first) + ")") if longest_first else None
        self.path, self.library = path, None
        self.same_class: dict[str, bool] = {}
        self.word_cache: dict[str, bytes] = {}
        self.run_cache: dict[str, bytes] = {}

    def merge_word(self, word: bytes) -> list[int]:
        return self.merge([self.byte_id[b] for b in word])

    def merge(self, ids: list[int]) -> list[int]:
        """Ids of one word from the ids of its bytes: the contiguous rank array."""
        rank_of, merged = self.ranks, self.merged
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        ranks = [rank_of.get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = merged[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of.get(ids[i - 1] << 20 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank_of.get(ids[i] << 20 | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order, smallest rank first and leftmost among equals, from a heap."""
        n, rank_of = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of.get(ids[i] << 20 | ids[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of.get(ids[i] << 20 | ids[j], _NONE) != r:
                continue
            ids[i], ids[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of.get(ids[i] << 20 | ids[k], _NONE)) != _NONE:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of.get(ids[h] << 20 | ids[i], _NONE)) != _NONE:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def _agrees(self, c: str) -> bool:
        """Whether the pattern's classes of a character are those of the vocabulary's own library: Unicode versions differ in the newest letters."""
        if c not in self.same_class:
            whole = lambda t: len(self.library.pre_tokenizer.pre_tokenize_str(t)) == 1
            own = lambda t: len(self.words.findall(t)) == 1
            self.same_class[c] = all(whole(x + c) == own(x + c) for x in "a1!")
        return self.same_class[c]

    def _run(self, run: str) -> bytes:
        """Ids of a run that no word crosses, as little-endian uint32 bytes."""
        out, cache = [], self.word_cache
        if not run.isascii():
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
                self.library.no_truncation()
                self.library.no_padding()
            if not all(self._agrees(c) for c in set(run) if c > "\x7f"):
                return np.array(self.library.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        for word in self.words.findall(run):
            ids = cache.get(word)
            if ids is None:
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                ids = cache[word] = np.array(self.merge_word(word.encode()), "<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian uint32 bytes. Strings of special tokens become their ids."""
        if self.specials is not None and any(s in text for s in self.special):
            parts = self.specials.split(text)
        else:
            parts = [text]
        out, cache = [], self.run_cache
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            # A single space before a character that is no space always starts a word. Where two white-space
            # characters meet, only a space before a character that is no space is cut.
            runs = _SAFE.split(part) if _TWO_SPACES.search(part) else part.split(" ")
            first = True
            for run in runs:
                key = run if first else " " + run
                first = False
                ids = cache.get(key)
                if ids is None:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    ids = cache[key] = self._run(key)
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids given as little-endian uint32 bytes, special tokens included."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", errors="replace")


_SAFE = re.compile(r" (?=\S)")
_TWO_SPACES = re.compile(r"\s\s")
_loaded: dict[str, ByteBpe] = {}


def vocabulary(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Per document the number of ids and the digests of the ids and of the text decoded from them. No shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocabulary_path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, ids): the ids themselves."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocabulary_path)
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(t), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(ids: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    prepare(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocabulary_path)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
