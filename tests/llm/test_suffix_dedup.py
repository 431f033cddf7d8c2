"""Repeated passages against a plain search over all windows."""

import random

import pytest

from crossweave.llm import suffix_dedup as sd


def plain(rows, n=50):
    """doc_id -> (removed spans, kept), by a dictionary of all windows."""
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - n + 1):
            if doc is not None:
                least[data[p : p + n]] = min(doc, least.get(data[p : p + n], doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - n + 1):
            if doc is not None and least[data[p : p + n]] < doc:
                gone[p : p + n] = b"\1" * n
        edges = [i for i in range(len(data) + 1) if (gone[i] if i < len(data) else 0) != (gone[i - 1] if i else 0)]
        out.append((doc, len(data), list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def found(spark, rows, n=50, block=sd.BLOCK):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return [(r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in sd.remove_repeats(df, threshold=n, block=block).collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def texts(seed, n):
    """Texts of few words, with shared passages, copies with small changes, and other letters."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gämma", "δέλτα", "ε", "zeta-eta", "thëta", "日本語", "x"]
    passages = [" ".join(rng.choices(words, k=rng.randint(5, 30))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages)[rng.randint(0, 9) :])
        text = "\n".join(parts)
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1]
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(["", "q", "qq q"]) + text[at:]
        rows.append((rng.randint(0, 3 * n), text))
    return rows


@pytest.mark.parametrize(("seed", "block", "n"), [(1, 1 << 20, 50), (2, 300, 50), (3, 2000, 50), (4, 500, 33)])
def test_as_a_plain_search(spark, seed, block, n):
    rows = texts(seed, 60)
    assert in_order(found(spark, rows, n, block)) == in_order(plain(rows, n))


def test_one_letter_and_short_periods(spark):
    """All places have the same hash, or few: the first of equal places counts."""
    rows = [(5, "a" * 500), (3, "a" * 49), (4, "a" * 50), (9, "ab" * 100), (8, "b" + "ab" * 30), (1, "b" * 10 + "a" * 70), (7, "abc" * 40)]
    assert in_order(found(spark, rows, block=100)) == in_order(plain(rows))


def test_nulls_empties_ties_and_copies(spark):
    long = "The quick brown fox jumps over the lazy dog, and then again over him."
    rows = [(1, None), (2, ""), (3, long), (3, long), (3, "x" + long), (4, long), (4, long), (None, long), (None, "y" + long), (5, long[:49]), (6, long[:50])]
    got = in_order(found(spark, rows, block=64))
    assert got == in_order(plain(rows))
    assert [(r[0], r[2]) for r in got if r[0] == 4] == [(4, [(0, len(long))])] * 2
    assert (6, 50, [(0, 50)], b"") in got


def test_an_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, block string, ids int, k1 int, spans int")
    assert sd.remove_repeats(df).collect() == []
    df = spark.createDataFrame([(1, "t" * 60, "x", 1), (2, "t" * 60, None, 2)], "doc_id long, text string, block string, kept int")
    assert sorted((r.doc_id, len(r.kept)) for r in sd.remove_repeats(df).collect()) == [(1, 60), (2, 0)]


def test_texts_are_dealt_once(spark):
    """Later passes read the bucketed table without an exchange of texts."""
    blocks = sd._blocks(spark.createDataFrame([(i, "t" * 60 + str(i)) for i in range(50)], "doc_id long, text string"), "doc_id", "text", 200)
    told = {"digits": spark.createDataFrame([(0, 1)], "block long, k long").repartition(3)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sd._told(told, blocks)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    texts = plan[plan.index("Join") :].split(":- ")[1].split("+- ")[0] if ":- " in plan else plan
    assert "Exchange" not in texts
    assert "ShuffledHashJoin" in plan


def test_the_query(spark):
    import hashlib

    from tests.conftest import SF

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for d, n, spans, kept in plain(rows))
    assert sorted(tuple(r) for r in sd.op12_suffix_dedup(spark, SF).collect()) == want


def test_windows_must_be_longer_than_their_starts(spark):
    with pytest.raises(ValueError, match="more than"):
        sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), threshold=27)


def test_keys_that_differ_in_their_second_half():
    import numpy as np

    rng = np.random.default_rng(1)
    k1, k2, doc = rng.integers(0, 4, 200), rng.integers(0, 3, 200), rng.integers(0, 9, 200)
    at, least, several, number = sd.smallest((k1, k2), doc)
    groups = {}
    for a, b, d in zip(k1.tolist(), k2.tolist(), doc.tolist(), strict=True):
        groups.setdefault((a, b), []).append(d)
    assert list(zip(k1[at].tolist(), k2[at].tolist(), strict=True)) == sorted(groups)
    assert least.tolist() == [min(groups[k]) for k in sorted(groups)]
    assert several.tolist() == [len(set(groups[k])) > 1 for k in sorted(groups)]
    assert [sorted(groups)[n] for n in number.tolist()] == list(zip(k1.tolist(), k2.tolist(), strict=True))
