"""Token-ID output: all documents' ids in one order, in segments of canonical length-limited Huffman code, and the way back.

1. Texts are encoded; ids go to a table in the shared folder, two or four bytes each, and each task's counts of ids with them. 2. Counts of all ids give
one code; there are as many counts as the vocabulary has ids, which bounds what the driver gets. 3. Documents are put in order of their id by a range shuffle and written in
segments of about SEGMENT ids. 4. Readers decode segments independently, by table, all blocks of a segment at once from bit-offset checkpoints.

A segment is one binary value of a table that Spark writes, so that any storage Spark knows can hold it and half-written files of a lost executor
never count. Its layout, little-endian: "CWT1", documents (u32), ids (u64), ids in a block (u32), bytes of code (u64); then for each document
null flag (u8), id (i64), ids (u32); a checkpoint (u64) for each block; the code. The code lengths, one byte for each id, are a table beside it.

Null texts are empty; an empty document has the end id only. Null ids come first; rows of equal ids come in order of their ids' checksum. An
empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.llm import huffman
from crossweave.llm.common import discard, portioned, stored, table_path, tidied, whole_text
from crossweave.llm.tokens import default_path, word_ids

END_ID = 2
SEGMENT = 2_000_000
SEGMENTS_PER_PART, MOST_PARTS = 2, 100_000
HEAD = struct.Struct("<4sIQIQ")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id, crc, ids (binary: u16, or u32 for larger vocabularies) of every row, end id included, with `counts` null; and from each task one row
    of which only `counts` is set: how often each id occurs in the task's rows."""
    size = word_ids(path).size
    kind = id_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = word_ids(path), np.zeros(size, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in portioned(batches):
            found = [np.concatenate([x, end]) for x in encoder.encode(batch.column("body"))]
            for some in range(0, len(found), 1024):
                total += np.bincount(np.concatenate(found[some : some + 1024]), minlength=size)
            crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64())
            ids = pa.array([x.astype(kind).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), crc, ids, pa.nulls(len(found), pa.binary())], ["doc_id", "crc", "ids", "counts"])
        some = np.flatnonzero(total)
        packed = zlib.compress(some.astype("<u4").tobytes() + total[some].astype("<u8").tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], ["doc_id", "crc", "ids", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("body")).mapInArrow(tidied(run), "doc_id long, crc long, ids binary, counts binary")


def id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def id_counts(encoded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, from the tasks' own counts; the driver gets a row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                raw = zlib.decompress(x.as_py())
                n = len(raw) // 12
                total[np.frombuffer(raw, "<u4", n)] += np.frombuffer(raw, "<u8", n, 4 * n).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in encoded.filter("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.id] = r.n
    return out


def pack(docs: list[tuple[int | None, np.ndarray]], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate([x for _, x in docs])
    bits, starts = huffman.encode(ids, lengths, codes)
    heads = np.zeros(len(docs), np.dtype([("null", "u1"), ("id", "<i8"), ("n", "<u4")]))
    heads["null"] = [d is None for d, _ in docs]
    heads["id"] = [d or 0 for d, _ in docs]
    heads["n"] = [len(x) for _, x in docs]
    return HEAD.pack(b"CWT1", len(docs), len(ids), huffman.BLOCK, len(bits)) + heads.tobytes() + starts.astype("<u8").tobytes() + bits


def unpack(data: bytes, decoder: huffman.Decoder) -> Iterator[tuple[int | None, np.ndarray]]:
    magic, n_docs, n_ids, block, n_bits = HEAD.unpack_from(data)
    if magic != b"CWT1":
        raise ValueError("not a segment")
    heads = np.frombuffer(data, np.dtype([("null", "u1"), ("id", "<i8"), ("n", "<u4")]), n_docs, HEAD.size)
    at = HEAD.size + heads.nbytes
    starts = np.frombuffer(data, "<u8", -(-n_ids // block), at)
    ids = decoder.decode(data[at + starts.nbytes : at + starts.nbytes + n_bits], starts, n_ids, block)
    stop = np.cumsum(heads["n"], dtype=np.int64)
    for null, doc, n, b in zip(heads["null"].tolist(), heads["id"].tolist(), heads["n"].tolist(), stop.tolist(), strict=True):
        yield None if null else doc, ids[b - n : b]


def write_ids(docs: DataFrame, out: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Writes the ids of docs below `out`: tables segments (part, segment, n_ids, data) and code (lengths)."""
    spark, path = docs.sparkSession, path or default_path()
    size = word_ids(path).size
    kind = id_type(size)
    encoded = stored(encode_documents(docs, path, id_col, text_col, end_id), "ids")
    counts = id_counts(encoded, size)
    lengths = huffman.code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{out}/code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, n, segment = huffman.canonical(lengths), [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([n], pa.int64()), pa.array([pack(held, lengths, codes)], pa.binary())], ["part", "segment", "n_ids", "data"])

        part = 0
        for batch in batches:
            for p, doc, ids in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                part = p
                held.append((doc, np.frombuffer(ids.as_py(), kind)))
                n += len(held[-1][1])
                if n >= SEGMENT:
                    yield flush()
                    held, n, segment = [], 0, segment + 1
        if held:
            yield flush()

    parts = min(MOST_PARTS, max(1, -(-int(counts.sum()) // (SEGMENTS_PER_PART * SEGMENT))))
    order = ("doc_id", "crc", "tie")  # the last, so that equal rows don't all go to one part
    rows = encoded.filter("counts is null").select("doc_id", "crc", "ids", F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    ordered.mapInArrow(run, "part int, segment int, n_ids long, data binary").write.parquet(f"{out}/segments")
    discard(encoded)


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """part, segment, start, doc_id, ids (binary, u32) of every document. start: ids of all documents before it."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{out}/code").first().lengths), np.uint8)
    segments = spark.read.parquet(f"{out}/segments")
    sizes = segments.select("part", "segment", "n_ids")
    before = (Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(*before)), F.lit(0))
    starts = sizes.withColumn("inner", inner).join(parts, "part").select("part", "segment", (F.col("base") + F.col("inner")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = huffman.Decoder(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                at, rows = 0, []
                for doc, ids in unpack(batch.column("data")[k].as_py(), decoder):
                    rows.append((doc, at, ids.astype("<u4").tobytes()))
                    at += len(ids)
                n = len(rows)
                same = [pa.array([batch.column(c)[k].as_py()] * n, pa.int32()) for c in ("part", "segment")]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary())))], ["part", "segment", "doc_id", "at", "ids"])

    read = segments.select("part", "segment", "data").mapInArrow(run, "part int, segment int, doc_id long, at long, ids binary")
    return read.join(F.broadcast(starts) if segments.count() <= 100_000 else starts, ["part", "segment"]).select("part", "segment", (F.col("base") + F.col("at")).alias("start"), "doc_id", "ids")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table_path(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    return read_ids(spark, out).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op9_token_ids": op9_token_ids}
ORACLE_SQL: dict[str, str] = {}
