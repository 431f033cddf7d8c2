"""Lengths of packed documents by the tokenizer, bins against brute force, and sequences."""

import random

import numpy as np
import pytest

from crossweave.llm import packing, token_ids, tokens

SF = "/root/testdata/sf0.001"


def test_op2_counts_the_tokenizers_tokens(spark):
    tokenizer = tokens.word_ids(tokens.default_path()).tokenizer
    total = {}
    for r in packing.op2_packing(spark, SF).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert total == {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs}


def brute_pack(sizes, lengths, cost):
    """Best fit by trying every bin."""
    bins, out = [], []  # a bin: length, used, when it was last changed
    for step, n in enumerate(sizes):
        fits = [(length - used, -changed, i) for i, (length, used, changed) in enumerate(bins) if length - used >= n]
        if fits:
            i = min(fits)[2]
        else:
            rest = sum(sizes[step:])
            length = min((c for c in lengths if c >= n), key=lambda c: (cost(c) / min(c, max(rest, 1)), c))
            i = len(bins)
            bins.append((length, 0, step))
        length, used, _ = bins[i]
        out.append((i, used))
        bins[i] = (length, used + n, step)
    return [i for i, _ in out], [a for _, a in out], [min(c for c in lengths if c >= used) for _, used, _ in bins]


@pytest.mark.parametrize("lengths", [(8,), (4, 10), (5, 6, 7), (512, 1024, 2048, 4096, 8192), (3, 100)])
def test_bins_match_brute_force(lengths):
    rnd = random.Random(sum(lengths))
    for cost in (packing.bin_cost, lambda c: c, lambda c: 1.0, lambda c: c * c):
        for n in (0, 1, 5, 60, 300):
            sizes = sorted((rnd.randint(1, max(lengths)) for _ in range(n)), reverse=True)
            assert packing.pack(sizes, lengths, cost) == brute_pack(sizes, lengths, cost)


def test_sequences_hold_the_ids_of_their_pieces(spark):
    docs = spark.createDataFrame([(i, "some words, again and again. " * (i * 7 % 60) if i % 5 else None) for i in range(60)], "doc_id long, text string")
    tokenizer = tokens.word_ids(tokens.default_path()).tokenizer
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, token_ids.END_ID] for r in docs.collect()}
    out = token_ids.table_path(spark, "test-ids")
    token_ids.write_ids(docs, out)
    pieces = packing.pack_tokens(docs, lengths=(32, 64, 128))
    got = {r.bin_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(pieces, token_ids.read_ids(spark, out)).collect()}
    rows = pieces.collect()
    assert sum(map(len, got.values())) == sum(map(len, want.values()))
    for r in rows:
        assert got[r.bin_id][r.bin_offset : r.bin_offset + r.n_tokens] == want[r.doc_id][r.start : r.start + r.n_tokens] and len(got[r.bin_id]) <= r.bin_length
