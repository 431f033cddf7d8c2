"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of that length. Pieces are taken in order of falling length; each goes to the open bin
with the least room that holds it. Where none does, a bin is opened whose length costs least for each token that it may hold, given what is
still to be packed: cost(length) / min(length, piece + rest). At the end each bin shrinks to the shortest permitted length that holds its
contents. Pieces are dealt by hash to groups of about GROUP pieces, each packed by one task, so that groups grow in number and not in size.

A document's length is its tokens by the tokenizer of op8 and op9, plus an end token; null texts are empty and have length 1. `start` counts the same
tokens, so that `sequences` can cut the pieces out of op9's ids. `pack_documents` takes any column for a length, or estimates it as UTF-8 bytes over
BYTES_PER_TOKEN, rounded up, plus an end token. Of bins with equal room, the one changed last is taken; pieces of one length are taken in order of id and
piece. Repeated rows are packed each. An empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.common import portioned, stored, tidied, whole_text
from crossweave.llm.tokens import default_path, word_ids

LENGTHS = (512, 1024, 2048, 4096, 8192)
BYTES_PER_TOKEN, GROUP = 4, 20_000
OVERHEAD = 16.0  # cost of a bin, in tokens


def bin_cost(length: int) -> float:
    """Work for a bin: its tokens, a share that grows with the square (attention), and a fixed part."""
    return OVERHEAD + length + length * length / 65536


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost=bin_cost) -> tuple[list[int], list[int], list[int]]:
    """sizes: in falling order -> bin of each, offset of each in its bin, length of each bin."""
    lengths = tuple(sorted(lengths))
    bins, offsets, opened, used = [], [], [], []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    rest = sum(sizes)
    for n in sizes:
        if n > lengths[-1]:
            raise ValueError("a piece is longer than the largest bin")
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room = min((c for c in lengths if c >= n), key=lambda c: (cost(c) / min(c, max(rest, 1)), c))
            k = len(opened)
            opened.append(room)
            used.append(0)
        bins.append(k)
        offsets.append(used[k])
        used[k] += n
        rest -= n
        left = room - n
        if left:
            by_room.setdefault(left, []).append(k)
            rooms |= 1 << left
    return bins, offsets, [min(c for c in lengths if c >= u) for u in used]


def token_length(text_col: str = "text", bytes_per_token: int = BYTES_PER_TOKEN) -> Column:
    return F.ceil(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) / F.lit(bytes_per_token)).cast("long") + 1


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n (tokens and an end token) of every row."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in portioned(batches):
            n = encoder.lengths(batch.column("body")) + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n)], ["doc_id", "n"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("body")).mapInArrow(tidied(run), "doc_id long, n long")


def pack_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, lengths: tuple[int, ...] = LENGTHS, group: int = GROUP) -> DataFrame:
    """As pack_documents, by the tokens of the texts; these are counted once."""
    return pack_documents(stored(token_lengths(docs, id_col, text_col, path), "token-lengths"), length=F.col("n"), lengths=lengths, group=group)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, lengths: tuple[int, ...] = LENGTHS, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start (in the document), n_tokens, bin_id, bin_offset, bin_length: a row for each piece."""
    top = max(lengths)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (token_length() if length is None else length).alias("n"))
    total = base.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    groups = max(1, -(-int(total) // group))
    pieces = base.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / top), F.lit(1)) - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).alias("grp"))
    dealt = pieces.repartition(min(groups, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "grp").sortWithinPartitions("grp", F.desc("n_tokens"), "doc_id", "piece")

    def packed(table: pa.Table, grp: int) -> Iterator[pa.RecordBatch]:
        bins, offsets, sizes = pack(table.column("n_tokens").to_pylist(), lengths)
        at, size = np.array(bins, np.int64), np.array(sizes, np.int64)
        out = table.drop_columns(["grp"]).append_column("bin_id", pa.array((grp << 32) + at)).append_column("bin_offset", pa.array(np.array(offsets, np.int64))).append_column("bin_length", pa.array(size[at]))
        yield from out.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and grp[a] != now:
                    yield from packed(pa.Table.from_batches(held), now)
                    held = []
                now = int(grp[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from packed(pa.Table.from_batches(held), now)

    return dealt.mapInArrow(run, "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_length long")


def sequences(pieces: DataFrame, ids: DataFrame) -> DataFrame:
    """bin_id, bin_length, n_tokens, ids (binary, u32) of every bin: its pieces' ids end to end. ids: doc_id and ids, as `token_ids.read_ids` gives them.

    Pieces go to their documents by id, so ids must be there once and not null; a bin holds `bin_length` ids at most, which bounds what meets in a row.
    """
    cut = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(n_tokens * 4 as int))")
    rows = pieces.join(ids.select("doc_id", "ids"), "doc_id").select("bin_id", "bin_length", "bin_offset", "n_tokens", cut.alias("part"))
    bins = rows.groupBy("bin_id", "bin_length").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("bin_offset", "part"))).alias("parts"))
    return bins.select("bin_id", "bin_length", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["part"])).alias("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_packing": op2_packing}
ORACLE_SQL: dict[str, str] = {}
