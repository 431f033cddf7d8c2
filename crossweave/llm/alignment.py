"""Alignment of two tokenizers: which tokens of one overlap which tokens of the other, in every text, and how often each pair of ids does in all of them.

A encodes a space and the text, B the text, to which it adds a space itself; both then spell the same bytes. Ends of tokens are running sums of their bytes; ends that both
have cut the tokens into groups; a token's group is found by binary search among the cuts, and so are the first and last tokens of B that a token of A overlaps,
which are then repeated into links. All of that is done for many texts at once, in NumPy.

1. Texts are handled in blocks of about BLOCK bytes. Neither tokenizer has a token that goes on from a letter or mark over a space, so that a text splits there into chunks; each distinct
   chunk of a block is encoded and aligned once, and a text's links are those of its chunks. A block keeps its pairs of ids, each with its number of links.
2. Pairs are summed in two stages, first by pair and a salt that the block gives, then by pair; the sums go back to the blocks the same way. A row stands for all
   links of a pair in a block, so that no pair weighs more than the number of blocks, in as many parts as a shuffle has partitions.
3. The highest sum of each B id is a table of at most as many rows as B has ids, which is broadcast. Each block then sums over its texts.

Texts that are null or empty, or whose tokens of A or of B don't spell the space and the text (U+2581 in a text does that), have no tokens: zeros and ''. Special tokens' strings
are plain text. A very long text is a block of its own. Each row gives one row, repeated rows and rows without an id as well; an empty table gives none; other columns take no part.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.common import bounds, stored, tidied, whole_text, with_group
from crossweave.llm.tokens import _byte_letters

#: Bytes of text that are handled at once.
BLOCK = 2 << 20
SPACE = 0x20
#: Bytes of a chunk that is encoded apart from others.
LONG = 400
#: Last bytes of characters after which a text may be split before a space: visible ASCII, and those that no white space of Unicode ends with.
_SPLITS = np.zeros(256, bool)
_SPLITS[0x21:0x7F] = _SPLITS[0x80:0xC0] = True
_SPLITS[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
BLOCKS = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, "
    "first array<int>, chunks binary, links binary, slots binary, pairs array<long>, counts array<long>"
)


class Vocabulary:
    """The bytes of a tokenizer's tokens, by id."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        stop = np.cumsum(size)
        return self.data[np.repeat(self.begin[ids] - (stop - size), size) + np.arange(int(size.sum()))]


#: How such a tokenizer cuts a text before it merges bytes: fixed values.
_PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A: a byte-level tokenizer of the tokenizers library. Ordinary chunks are encoded by tiktoken from the same file's vocabulary, many in one call, some five times
    as fast with the same ids; what can't be put between others, or is long, goes to the library itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        of = {c: b for b, c in _byte_letters().items()}
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            tokens[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        self.vocabulary = Vocabulary(tokens)
        ranks = {tokens[i]: i for t, i in vocabulary.items() if all(c in of for c in t)}
        self.fast = tiktoken.Encoding("byte-level", pat_str=_PRETOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, chunks: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and how many each has. raw: their bytes."""
        plain = np.array([len(x) <= LONG and x[1:2] != b" " and bool(_SPLITS[x[-1]]) for x in raw], bool)
        fast = np.array(self.fast.encode_ordinary("".join(c for c, p in zip(chunks, plain.tolist(), strict=True) if p)), np.int64)
        to = np.cumsum([len(x) for x, p in zip(raw, plain.tolist(), strict=True) if p], dtype=np.int64)
        n = np.zeros(len(chunks), np.int64)
        n[plain] = np.diff(np.searchsorted(np.cumsum(self.vocabulary.sizes[fast]), to, side="right"), prepend=0)
        odd = np.flatnonzero(~plain)
        slow, n[odd] = _flat([e.ids for e in self.tokenizer.encode_batch_fast([chunks[i] for i in odd.tolist()], add_special_tokens=False)])
        ids = np.empty(int(n.sum()), np.int64)
        ids[np.repeat(plain, n)], ids[np.repeat(~plain, n)] = fast, slow
        return ids, n


class Pieces:
    """B: a sentencepiece model, which puts a space before what it encodes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        self.vocabulary = Vocabulary([bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces])

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.model.encode([c[1:] for c in chunks], num_threads=1))


@cache
def tokenizers(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    """One pair for each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteLevel(path_a), Pieces(path_b)


@cache
def _numerals(size: int, mark: bytes) -> np.ndarray:
    """All ids in decimal, each with a mark behind it."""
    return np.array([b"%d%s" % (i, mark) for i in range(size)])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.array(list(chain.from_iterable(lists)), np.int64), sizes


def _per(bounds_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    upto = np.concatenate([[0], np.cumsum(values)])[bounds_]
    return upto[1:] - upto[:-1]


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 up in as few bytes as they need."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return kind.char.encode() + zlib.compress(values.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), np.dtype(data[:1].decode()))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A space and each text, for texts without nulls or empties, as chunks; and where each text's chunks begin, the end of the last besides."""
    spaced = pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type)).cast(pa.large_string())
    at = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2], np.uint8)
    edge = np.zeros(len(data) + 1, bool)
    edge[1 : len(data) - 1] = (data[1:-1] == SPACE) & _SPLITS[data[:-2]] & (data[2:] != SPACE)
    edge[at[1:] - 1] = False  # a space that ends its text stays with what is before it
    edge[at] = True
    cut = np.flatnonzero(edge[at[0] : at[-1] + 1]) + at[0]
    chunks = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut.astype(np.int64)), spaced.buffers()[2])
    return chunks, np.searchsorted(cut, at)


class Aligned:
    """Distinct chunks, encoded by both tokenizers and aligned. Those that the tokens don't spell are `bad`, and have no tokens."""

    def __init__(self, chunks: pa.Array, a: ByteLevel, b: Pieces):
        strings = chunks.to_pylist()
        raw = [s.encode() for s in strings]
        (ids_a, n_a), (ids_b, n_b) = a.encode(strings, raw), b.encode(strings)
        size = np.array([len(x) for x in raw], np.int64)
        good = np.ones(len(raw), bool)
        for ids, n, v in ((ids_a, n_a, a.vocabulary), (ids_b, n_b, b.vocabulary)):
            to = np.concatenate([[0], np.cumsum(n)])
            fits = _per(to, v.sizes[ids]) == size
            given = np.frombuffer(b"".join(x for x, f in zip(raw, fits, strict=True) if f), np.uint8)
            spelled = v.spelled(ids[np.repeat(fits, n)])
            fits[fits] = _per(np.concatenate([[0], np.cumsum(size[fits])]), spelled != given) == 0
            good &= fits
        self.bad = ~good
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        self.n_a, self.n_b = n_a * good, n_b * good
        size_a = a.vocabulary.sizes[ids_a]
        end_a, end_b = np.cumsum(size_a), np.cumsum(b.vocabulary.sizes[ids_b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        ends = np.cumsum(size * good)
        self.n_groups = np.diff(np.searchsorted(cuts, ends, side="right"), prepend=0)
        # links: from the first token of B that ends behind the start of a token of A to the first that ends at or behind its end
        low, high = np.searchsorted(end_b, end_a - size_a, side="right"), np.searchsorted(end_b, end_a, side="left")
        n = high - low + 1
        links = np.repeat(np.arange(len(ids_a)), n)
        other = np.arange(len(links)) + np.repeat(low - (np.cumsum(n) - n), n)
        self.pairs = ids_a[links] << 32 | ids_b[other]
        self.n_links = _per(np.concatenate([[0], np.cumsum(self.n_a)]), n)
        self._spell(ids_a, ids_b, np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), max(len(a.vocabulary.sizes), len(b.vocabulary.sizes)))

    def _spell(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, most: int) -> None:
        """groups: of each chunk, a1,a2|b1; for each group."""
        out = np.empty(len(ids_a) + len(ids_b), _numerals(most, b",").dtype)
        for ids, group, before, mark in ((ids_a, group_a, np.searchsorted(group_b, group_a), b"|"), (ids_b, group_b, np.searchsorted(group_a, group_b, side="right"), b";")):
            last = np.append(group[1:] != group[:-1], True)[: len(group)]
            out[np.arange(len(ids)) + before] = np.where(last, _numerals(most, mark)[ids], _numerals(most, b",")[ids])
        stop = np.cumsum(self.n_a + self.n_b) * out.itemsize
        data = out.tobytes()
        self.groups = [data[s:t].translate(None, b"\0") for s, t in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=False)]


def _block(number: int, ids: pa.Array, texts: pa.Array, a: ByteLevel, b: Pieces, whole_groups: bool) -> dict:
    """The row of a block."""
    there = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    chunks, first = split(texts.take(pa.array(there)))
    coded = chunks.dictionary_encode()
    each = coded.indices.to_numpy().astype(np.int64)
    found = Aligned(coded.dictionary, a, b)
    bad = _per(first, found.bad[each]) > 0
    counts = {c: np.zeros(len(ids), np.int64) for c in _COUNTS}
    for c in _COUNTS:
        counts[c][there] = np.where(bad, 0, _per(first, getattr(found, c)[each]))
    groups = [""] * len(ids)
    for i, s, t, no in zip(there.tolist(), first[:-1].tolist(), first[1:].tolist(), bad.tolist(), strict=True):
        if not no:
            text = b"".join([found.groups[k] for k in each[s:t].tolist()])[:-1]
            groups[i] = text.decode() if whole_groups else hashlib.sha256(text).hexdigest()
    # chunks of texts without tokens take no part in what follows
    inside = np.repeat(~bad, np.diff(first))
    each, n = each[inside], np.zeros(len(ids), np.int64)
    n[there] = np.where(bad, 0, np.diff(first))
    times = np.bincount(each, minlength=len(found.bad))
    used = np.repeat(times > 0, found.n_links)
    pairs, slots = np.unique(found.pairs[used], return_inverse=True)
    link_counts = np.bincount(slots, weights=np.repeat(times, found.n_links)[used], minlength=len(pairs)).astype(np.int64)
    return {
        "block": number, "doc_id": ids, **counts, "groups": groups, "first": np.concatenate([[0], np.cumsum(n)]).astype(np.int32),
        "chunks": _packed(each), "links": _packed(np.where(times > 0, found.n_links, 0)), "slots": _packed(slots), "pairs": pairs, "counts": link_counts,
    }


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", whole_groups: bool = False, most: int = BLOCK) -> DataFrame:
    """A row for each block of texts: its texts' counts and groups (the strings, or their SHA-256), and all that later steps need to sum over its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), part, n = tokenizers(path_a, path_b), TaskContext.get().partitionId(), 0
        kinds = {"block": pa.int64(), "groups": pa.list_(pa.string()), "first": pa.list_(pa.int32()), **dict.fromkeys(("chunks", "links", "slots"), pa.binary())}
        for batch in batches:
            for i, k in bounds(batch.column("body"), most):
                row = _block(part << 32 | n, batch.column("id").slice(i, k), batch.column("body").slice(i, k), a, b, whole_groups)
                yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(c, pa.list_(pa.int64()))) for c, v in row.items()], list(row))
                n += 1

    return docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("body")).mapInArrow(tidied(run), BLOCKS)


def counted_pairs(blocks: DataFrame) -> DataFrame:
    """block, slot, pair, total: for each pair of each block, its links in all blocks."""
    rows = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("slot", "x")).select("block", "slot", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    return with_group(rows, "pair", "block", {"total": ("sum", "n")}).select("block", "slot", "pair", "total")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, n: links of each pair of ids in all texts."""
    rows = blocks.select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(32)))
    salted = rows.groupBy(F.col("x.pairs").alias("pair"), "salt").agg(F.sum("x.counts").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n")).select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", whole_groups: bool = False, most: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row."""
    blocks = stored(aligned_blocks(docs, path_a or default_path("byte_bpe_50k.json"), path_b or default_path("piece_bpe_32k.model"), id_col, text_col, whole_groups, most), "aligned")
    pairs = stored(counted_pairs(blocks), "pairs")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = pairs.groupBy(b.alias("b")).agg(F.max("total").alias("highest"))  # a row for each id of B at most
    told = pairs.withColumn("b", b).join(F.broadcast(highest), "b").groupBy("block").agg(F.collect_list(F.struct("slot", "total", (F.col("total") == F.col("highest")).alias("best"))).alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                first = row["first"].values.to_numpy()
                chunks, links, slots = (_unpacked(row[c].as_py()) for c in ("chunks", "links", "slots"))
                links = np.concatenate([[0], np.cumsum(links, dtype=np.int64)])
                total, best = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
                if (x := row["told"].values) is not None:
                    slot = x.field("slot").to_numpy()
                    total[slot], best[slot] = x.field("total").to_numpy(), x.field("best").to_numpy(zero_copy_only=False)
                sums = [_per(first, _per(links, v[slots])[chunks]) for v in (best, total)]
                yield pa.RecordBatch.from_arrays([row[c].values for c in ("doc_id", *_COUNTS)] + [pa.array(s) for s in sums] + [row["groups"].values], ["doc_id", *_COUNTS, "n_best", "count_sum", "groups"])

    rows = blocks.drop("pairs", "counts").join(told, "block", "left")
    return rows.mapInArrow(tidied(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLE_SQL: dict[str, str] = {}
