"""Token alignment against a plain version that encodes whole texts and compares all byte ranges."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from crossweave.llm import alignment as al
from crossweave.llm.tokens import _byte_letters


@pytest.fixture(scope="module")
def encoders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(al.default_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=al.default_path("piece_bpe_32k.model"))


def tokens(encoders, text):
    a, b = encoders
    of = {c: x for x, c in _byte_letters().items()}
    e = a.encode(" " + text, add_special_tokens=False)
    one = [(i, bytes(of[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    two = [(i, bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    want = (" " + text).encode()
    return (one, two) if b"".join(t for _, t in one) == want == b"".join(t for _, t in two) else ([], [])


def ranges(toks):
    at, out = 0, []
    for i, t in toks:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def plain(encoders, rows):
    found, counts = [], Counter()
    for doc, text in rows:
        one, two = map(ranges, tokens(encoders, text) if text else ([], []))
        links, j0 = [], 0
        for i, s, t in one:
            while two[j0][2] <= s:
                j0 += 1
            for j, u, v in two[j0:]:
                if u >= t:
                    break
                if v > s:
                    links.append((i, j))
        cuts = sorted({t for *_, t in one} & {t for *_, t in two})
        groups = ";".join(",".join(str(i) for i, _, t in one if a < t <= b) + "|" + ",".join(str(i) for i, _, t in two if a < t <= b) for a, b in zip([0, *cuts], cuts, strict=False)) if len(cuts) < 2000 else None
        counts.update(links)
        found.append((doc, len(one), len(two), len(cuts), links, groups))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(doc, a, b, g, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), s) for doc, a, b, g, x, s in found]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "  a  b   c ", "\n", " \n ", "a\n b", "a \nb", "a  b", "a  b", "　 x", "x　 y", "a▁b", "▁", "<|endoftext|> here", "x<|endoftext|>", "<s> </s> <unk>", "<0x41> a",
    "don't 've 'll we'll", "日本語のテキスト です。 はい", "naïve café ünï", "🙂 🙂🙂 é ﻿x", "\x00 \x01a \x7f b", "\u0085 a\u0085 b", "a​ b", "  a  b", "tab\t tab \tx", "1234 567 8", "!!! ??? ... a", "� ￾ x",
    "long" * 400, "a b " * 300, "\r\n\r\n a\r\n", "ﬁ ½ ㎏ Ａ", "᠎ a᠎ b", "a  b", "a  b", "a  b", "a\x1c b\x1f c", "x  y", "x   \n  y", "▁ a b", "ok ok▁ ok",
]


def test_as_a_plain_alignment(spark, encoders):
    rng = random.Random(3)
    letters = ["a", "b", "the", " ", " ", "  ", "\n", "é", "日", "　", " ", "'s", "1", ".", "▁", "🙂", "-", "Th", "\t"]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "".join(rng.choices(letters, [5, 5, 5, 9, 9, 1, 1, 1, 1, 0.3, 0.3, 1, 1, 1, 0.1, 1, 1, 1, 0.3], k=rng.randint(1, 60)))) for i in range(400)]
    rows += [(None, "a b"), (3, "the cat"), (3, "the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (1 << 20, 500):
        got = al.align(df, whole_groups=True, most=most).collect()
        assert sorted(map(tuple, got), key=str) == sorted(plain(encoders, rows), key=str)


def test_no_token_goes_over_a_split(encoders):
    """What the split into chunks rests on: no piece of B holds a space behind another character."""
    _, b = encoders
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    assert not [p for p in pieces if "▁" in p.lstrip("▁")]
    chunks, first = al.split(pa.array(["ab cd  e ", " x", "日本 語　 y"]))
    assert chunks.to_pylist() == [" ab", " cd  e ", "  x", " 日本", " 語　 y"]
    assert first.tolist() == [0, 2, 3, 5]


def test_the_query_and_the_pairs(spark, encoders):
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 3000]
    some = docs.filter("length(text) < 3000 or text is null")
    want = sorted((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in plain(encoders, rows))
    assert sorted(map(tuple, al.align(some).collect())) == want
    pairs = al.pair_counts(al.aligned_blocks(some, al.default_path("byte_bpe_50k.json"), al.default_path("piece_bpe_32k.model"))).collect()
    assert sum(p.n for p in pairs) == sum(r[4] for r in want)
    whole = al.op11_token_alignment(spark, SF)
    assert whole.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert whole.count() == docs.count()


def test_an_empty_table_and_other_columns(spark):
    assert al.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, None, "x", 1), (2, "", "y", 2), (3, "one two", None, 3)], "doc_id long, text string, block string, groups int")
    got = {r.doc_id: r for r in al.align(df).collect()}
    assert tuple(got[1])[1:] == tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert got[3].n_links == got[3].n_best == got[3].count_sum == 2
