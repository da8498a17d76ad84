"""Token ids of whole texts by a tokenizers file whose pre-tokenizer drops white space.

Such a tokenizer treats each run without white space on its own, so ids of runs are kept in a bounded cache of
the Python worker and a text's ids are its runs' ids one after another.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

from quirelight.llm.bpe import ByteBpe, byte_symbols
from quirelight.llm.common import lean, worker_cache

#: Cached runs per Python worker; a full cache is emptied.
CACHE_ENTRIES = 500_000
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: str.split() takes these for white space; the tokenizer does not.
_PYTHON_SPACE = "\x1c\x1d\x1e\x1f"


def load(path: str):
    """A tokenizer without truncation and padding, single-threaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class _Runs(dict):
    """Ids of a run as little-endian uint32 bytes, made when first asked for.

    Runs of characters below U+0130 are stable under NFC and lower-case one to one, so they are split into
    words and merged here; the library itself encodes all others and those with a special token's string.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = load(path)
        self.bpe = ByteBpe(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.last_id = [vocab[s + suffix] for s in byte_symbols()]
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        raw = word.encode()
        ids = [self.bpe.byte_id[b] for b in raw]
        ids[-1] = self.last_id[raw[-1]]
        return np.array(self.bpe.merge(ids), "<u4").tobytes()

    def __missing__(self, run: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if max(run) < "\u0130" and "<|" not in run:
            out = []
            for word in self.pattern.findall(run.lower()):
                ids = self.words.get(word)
                if ids is None:
                    if len(self.words) >= CACHE_ENTRIES:
                        self.words.clear()
                    ids = self.words[word] = self.word(word)
                out.append(ids)
            found = b"".join(out)
        else:
            found = np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        self[run] = found
        return found


_loaded: dict[str, _Runs] = worker_cache("tokens")


def word_token_ids(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids, each as little-endian uint32 bytes."""
    if path not in _loaded:
        _loaded[path] = _Runs(path)
    cache = _loaded[path]

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            runs = text.split()
            if any(c in text for c in _PYTHON_SPACE):
                runs = [x for x in _SPACE.split(text) if x]
            out.append(b"".join([cache[x] for x in runs]))
        return out

    return encode


def tokenising(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A lean pass that keeps the ids of runs for the next task of its stage."""
    return lean(run, "tokens")
