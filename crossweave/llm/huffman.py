"""Canonical length-limited Huffman codes: lengths by package merge, bits by columns, decoding by table in many blocks at once."""

from __future__ import annotations

import numpy as np

MAX_BITS = 18  # or two more than the number of symbols needs, for large alphabets
WINDOW_BITS = 25  # that the decoder can see at once, at any bit of a byte
BLOCK = 2048  # symbols between checkpoints


def code_lengths(counts: np.ndarray, most: int | None = None) -> np.ndarray:
    """Bits of each symbol, 0 where it doesn't occur; the best code with no more than `most` bits."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if most is None:
        most = min(WINDOW_BITS, max(MAX_BITS, (len(used) - 1).bit_length() + 2))
    if len(used) > 1 << most:
        raise ValueError("too many symbols for codes that short")
    by = used[np.argsort(counts[used], kind="stable")]
    weights = counts[by]
    levels = [(weights, np.ones(len(by), bool))]
    for _ in range(most - 1):
        last = levels[-1][0]
        pairs = last[: len(last) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        levels.append((both[order], order < len(by)))
    take = 2 * len(by) - 2
    for _, leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        out[by[:leaves]] += 1
        take = 2 * (take - leaves)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes, in order of length and then of symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        step = np.int64(1) << (int(size.max()) - size)
        codes[order] = ((np.cumsum(step) - step) >> (int(size.max()) - size)).astype(np.uint64)
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bits, and the bit at which each block of ids starts."""
    size = lengths[ids].astype(np.int64)
    if not len(ids):
        return b"", np.empty(0, np.uint64)
    if not size.all():
        raise ValueError("an id without a code")
    stop = np.cumsum(size)
    start = stop - size
    word, room = start >> 6, 64 - (start & 63) - size
    code = codes[ids]
    head = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    out = np.zeros(int(stop[-1] >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(head, first)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(stop[-1]) + 7) // 8], start[::block].astype(np.uint64)


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.bits = int(lengths.max(initial=1))
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        reach = 1 << (self.bits - lengths[used].astype(np.int64))
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.length = np.zeros(1 << self.bits, np.int64)
        n = int(reach.sum())
        self.symbol[:n] = np.repeat(used, reach)
        self.length[:n] = np.repeat(lengths[used], reach)

    def decode(self, bits: bytes, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """n ids; the blocks are independent, and a step decodes one id of each."""
        if not n:
            return np.empty(0, np.uint32)
        raw = np.concatenate([np.frombuffer(bits, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at, out = starts.astype(np.int64), np.zeros((block, len(starts)), np.uint32)
        full, last = len(starts) - 1, n - (len(starts) - 1) * block
        for i in range(block):
            if i == last:
                at = at[:full]
                if not full:
                    break
            key = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.bits)
            out[i, : len(at)] = self.symbol[key]
            at = at + self.length[key]
        return out.T.reshape(-1)[:n]
