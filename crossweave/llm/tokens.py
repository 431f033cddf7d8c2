"""Token ids of whole texts by a chunk cache: white-space chunks are encoded once, then looked up.

The tokenizer drops white space and never merges across it, so a text's ids are those of its chunks in order. Chunks are split at ASCII white
space and made distinct in Arrow, batch by batch; the distinct ones are looked up in a dictionary, whose size in bytes is bounded, however long chunks are.
A-Z is lower-cased first, as the tokenizer does itself, unless the text may hold a special token. A chunk of lower-case Latin letters and then ASCII
punctuation is two pre-tokens, which the tokenizer's model encodes directly; all other chunks go through the whole tokenizer. The cache is emptied when it
is full, before a batch is looked up, so that it never holds more than CACHE_BYTES and what one batch brings (4 MB of text, or one text); results don't
depend on it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from crossweave.llm.common import bounds

CACHE_BYTES = 96 << 20
ENTRY_BYTES = 128  # of a chunk in the dictionary and its place, beside the chunk itself
BYTES = 4 << 20  # of texts looked up at once
BETWEEN = "\x01"  # one id, and no white space
#: Letters that stay as they are under NFC and lower-casing, whatever stands beside them, then ASCII punctuation, which never goes on from a letter.
_LATIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes 0-255 in a byte-level vocabulary: printable Latin-1 for itself, then the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        self.letters = _byte_letters()
        self.tails: dict[str, list[int]] = {"": []}
        (self.between,) = self._encode([BETWEEN])[0]
        self._clear()

    def _clear(self) -> None:
        self.place = {"": 0}  # of each chunk, in `start`
        self.flat = np.empty(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.used, self.known, self.bytes = 0, 1, 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _put(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.known + len(keys) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.known + 1 : self.known + len(keys) + 1] = self.used + np.cumsum(sizes)
        self.place.update(zip(keys, range(self.known, self.known + len(keys)), strict=True))
        self.bytes += sum(map(sys.getsizeof, keys)) + ENTRY_BYTES * len(keys) + ids.nbytes
        self.used += len(ids)
        self.known += len(keys)

    def _put_lists(self, keys: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._put(keys, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes)

    def _learn(self, missing: list[str]) -> None:
        """Puts chunks into the cache. Those that are no Latin word are encoded many at a time, with a mark between them that no chunk holds."""
        plain, ids, other, apart = [], [], [], []
        tokenize, tails = self.model.tokenize, self.tails
        for m in missing:
            if found := _LATIN.fullmatch(m):
                stem, tail = found.groups()
                if tail not in tails:
                    tails[tail] = self._encode([tail])[0]
                if not stem.isascii():
                    stem = stem.encode().decode("latin-1").translate(self.letters)
                plain.append(m)
                ids.append([t.id for t in tokenize(stem)] + tails[tail])
            elif BETWEEN in m or "<|" in m:
                apart.append(m)
            else:
                other.append(m)
        if plain:
            self._put_lists(plain, ids)
        for i in range(0, len(other), 1000):
            some = other[i : i + 1000]
            got = np.array(self._encode([f" {BETWEEN} ".join(some)])[0], np.uint32)
            mark = np.append(np.flatnonzero(got == self.between), len(got))
            if len(mark) == len(some):
                self._put(some, got[got != self.between], np.diff(np.concatenate([[-1], mark])) - 1)
            else:
                apart += some
        if apart:
            self._put_lists(apart, self._encode(apart))

    def look_up(self, found: pa.Array) -> np.ndarray:
        """Cache places of distinct chunks."""
        if self.bytes > CACHE_BYTES:
            self._clear()
        keys = found.to_numpy(zero_copy_only=False).tolist()
        out = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        if len(new := np.flatnonzero(out < 0)):
            missing = [keys[i] for i in new.tolist()]
            self._learn(missing)
            out[new] = np.fromiter(map(self.place.__getitem__, missing), np.int64, len(missing))
        return out

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a string array without nulls, all chunks in order: where the ids of each begin in `flat`, how many they are, where each text's chunks begin and end."""
        parts = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        bounds = parts.offsets.to_numpy().astype(np.int64)
        each = parts.flatten().dictionary_encode()
        k = self.look_up(each.dictionary)[each.indices.to_numpy()] if len(each) else np.empty(0, np.int64)
        return self.start[k], self.start[k + 1] - self.start[k], bounds[:-1] - bounds[0], bounds[1:] - bounds[0]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = [np.empty(0, np.int64)]
        for some in portions(texts):
            _, size, a, b = self.chunks(some)
            upto = np.concatenate([[0], np.cumsum(size)])
            out.append(upto[b] - upto[a])
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        for some in portions(texts):
            at, size, a, b = self.chunks(some)
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])]
            out += [ids[s:t] for s, t in zip(upto[a].tolist(), upto[b].tolist(), strict=True)]
        return out


def portions(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """The array in slices of about `most` bytes, or one text."""
    for i, n in bounds(texts, most or BYTES):
        yield texts.slice(i, n)


@cache
def word_ids(path: str) -> WordIds:
    """One for each Python worker and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordIds(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
