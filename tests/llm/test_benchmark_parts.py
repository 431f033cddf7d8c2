"""Benchmarks of several parts."""

from crossweave.llm import decontamination


def test_parts_of_a_benchmark_cut_as_one(spark):
    w = [f"w{i}" for i in range(40)]
    rows = [
        (1, "before " + " ".join(w[:19]) + " after", 0, "x"),  # items 1 and 2 overlap by a word
        (2, "go p1 p2 p3 " + " ".join(w[9:19]) + " p4 p5 p6 p7 p8 p9 p10 on", 0, "x"),  # a cut for item 2 brings item 3 together
        (3, "nothing to find", 15, "x"),
        (4, None, None, "x"),
        (5, " ".join(w[:10]), 0, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, hits string")
    items = spark.createDataFrame([("3", " ".join(f"p{i}" for i in range(1, 11))), ("1", " ".join(w[:10])), ("2", " ".join(w[9:19]))], "item_id string, text string").coalesce(1)
    one, parts = (sorted(decontamination.remove_spans(docs, items, most=m).collect()) for m in (1 << 20, 1))
    assert [tuple(r) for r in one] == [(1, "before\nafter", 12, "x"), (2, "go\non", 5, "x"), (3, "nothing to find", 15, "x"), (4, None, None, "x")]
    assert parts == one
