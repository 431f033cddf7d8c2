"""Entries of JSON files that are cut anywhere, against the standard parser."""

import json
import random
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crossweave.sources import json_entries, readers


@pytest.fixture
def cuts(spark):
    """Sets the bytes of a split."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_
    for k, v in old.items():
        spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 4 else 4)
    if kind < 4:
        return "".join(rng.choices(['"', "\\", ",", "[", "]", "{", "}", "é", "日", "a", "\n", " ", "\\\\", '\\"', ":"], k=rng.randint(0, 12)))
    if kind == 4:
        return rng.choice([None, True, 1.5, -3, 10**12])
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 5))]
    return {str(value(rng, 9)): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def written(tmp_path, data, rng, name="f.json"):
    at = tmp_path / name
    at.write_text(json.dumps(data, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 2]), separators=rng.choice([None, (",", ":")])))
    return str(at)


def items(spark, path, end=","):
    rows = json_entries.entries(spark, path, end).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(len(rows)))
    return [r.entry for r in rows]


def by_hand(text, rng, most):
    """The entries of a text by both passes, without Spark: fragments dealt to splits and batches at random."""
    end = rng.choice(",]}")
    fragments, splits = text.split(end), []
    if not fragments[-1]:
        fragments.pop()
    while fragments:
        n = rng.randint(1, most)
        splits.append(fragments[:n])
        fragments = fragments[n:]

    def batches(begins=None):
        for start, rows in enumerate(splits):
            for i in range(0, len(rows), k := rng.randint(1, most)):
                some = rows[i : i + k]
                columns = {"value": some, "file": [5] * len(some), "start": [start] * len(some)}
                if begins:
                    columns |= {c: [v] * len(some) for c, v in zip(("_inside", "_depth", "_place"), begins[start], strict=True)}
                yield pa.RecordBatch.from_pydict(columns)

    begins, odd, depth, place = [], 0, 0, 0
    for r in [x for b in json_entries.summary(batches(), end) for x in b.to_pylist()]:
        begins.append((odd, depth, place))
        place += sum(x["n"] for x in r["commas"][odd] if x["depth"] + depth == 1)
        depth += r["delta"][odd]
        odd ^= r["odd"]
    pieces = {}
    for r in [x for b in json_entries.cut(batches(begins), end) for x in b.to_pylist()]:
        pieces.setdefault(r["place"], []).append((r["start"] or 0, r["piece"]))
        assert r["start"] is not None or len(pieces[r["place"]]) == 1
    whole = [b"".join(x for _, x in sorted(v)).decode() for _, v in sorted(pieces.items())]
    return [w for w in whole if w.strip()]


def test_cuts_at_any_comma():
    rng = random.Random(2)
    for _ in range(200):
        form = {"ensure_ascii": rng.random() < 0.5, "indent": rng.choice([None, None, 2]), "separators": rng.choice([None, (",", ":")])}
        data = [value(rng) for _ in range(rng.randint(0, 30))]
        assert [json.loads(e) for e in by_hand(json.dumps(data, **form), rng, rng.choice([1, 2, 5, 50]))] == data
        data = {f"{i}{value(rng, 9)}": value(rng) for i in range(rng.randint(0, 30))}
        got = [json.loads("{" + e + "}") for e in by_hand(json.dumps(data, **form), rng, rng.choice([1, 2, 5, 50]))]
        assert [list(g.items())[0] for g in got] == list(data.items())


@pytest.mark.parametrize("text", ["{}", "[]", " [ ] \n", "null", '"a,b"', "[[]]", "[1]", '[{"a": ","}, "]"]', '\n{ "a" : [1, 2] ,\n "b": {} }\n', "[" + "[" * 50 + "1,2" + "]" * 50 + ", 3]"])
def test_small_and_empty_values(text):
    data = json.loads(text)
    got = by_hand(text, random.Random(1), 2)
    if isinstance(data, dict):
        assert json.loads("{" + ",".join(got) + "}") == data
    else:
        assert [json.loads(e) for e in got] == (data if isinstance(data, list) else [])


def test_arrays_and_maps_by_spark(spark, tmp_path, cuts):
    cuts(400)
    rng = random.Random(6)
    data = [value(rng) for _ in range(80)]
    assert [json.loads(e) for e in items(spark, written(tmp_path, data, rng, "a.json"))] == data
    data = {f"{i}{value(rng, 9)}": value(rng) for i in range(80)}
    got = [json.loads("{" + e + "}") for e in items(spark, written(tmp_path, data, rng, "m.json"), "]")]
    assert [list(g.items())[0] for g in got] == list(data.items())
    (tmp_path / "none.json").write_text("")
    assert items(spark, str(tmp_path / "none.json")) == []


def test_files_of_a_folder_are_apart(spark, tmp_path, cuts):
    cuts(150)
    rng = random.Random(9)
    data = [[f"{k}-{i}" for i in range(30 + k)] for k in range(4)]
    for k, d in enumerate(data):
        written(tmp_path, d, rng, f"{k}.json")
    rows = json_entries.entries(spark, str(tmp_path)).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "entry"))).alias("x")).collect()
    assert sorted([json.loads(x.entry) for x in r.x] for r in rows) == sorted(data)


def test_a_long_map_is_read_by_many_tasks(spark, tmp_path, cuts):
    at = tmp_path / "long.json"
    at.write_text(json.dumps({f"a{i}": [f"p{i}-{j}" for j in range(i % 7)] for i in range(20_000)}))
    cuts(20_000)
    splits = json_entries._splits(spark, str(at), ",")
    assert splits.rdd.getNumPartitions() > 40
    assert splits.mapInArrow(partial(json_entries.summary, end=","), json_entries._SUMMARY).count() == splits.select("start").distinct().count()
    got = readers.flat_profiles(spark, str(at), "in").groupBy("aid").count().collect()
    assert {r.aid: r["count"] for r in got} == {f"a{i}": i % 7 for i in range(20_000) if i % 7}


def whole(spark, path):
    return spark.read.text(path, wholetext=True)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [250, 1 << 20])
def test_readers_give_what_whole_texts_give(spark, tmp_path, cuts, size):
    cuts(size)
    rng = random.Random(4)
    flat = {f"a{i}": [f"p{j}" for j in range(rng.randint(0, 4))] for i in range(30)}
    named = {f"n{i}": {f"a{i}-{k}": [f"p{j}" for j in range(rng.randint(0, 3))] for k in range(rng.randint(0, 3))} for i in range(20)}
    papers = {f"p{i}": {"title": 'a "t", or {two}', "authors": [{"name": "x, y", "org": "[o]"}] * rng.randint(0, 2), "year": 2000 + i, "keywords": ["k,1", "]"]} for i in range(20)}
    triples = [{"aid1": i % 5, "pid": f"p{i}", "label": i % 2, "similarity": i / 7, "name": "a,b"} for i in range(50)]
    prior = [{"pid": f"p{i % 9}", "pred": i / 50} for i in range(50)]
    scored = [{"aid1": f"{i}", "pids": ["a", "b"], "content": '{"0": 1}', "inputs": "x"} for i in range(20)]
    at = {k: written(tmp_path, v, rng, f"{k}.json") for k, v in {"flat": flat, "named": named, "papers": papers, "triples": triples, "prior": prior, "scored": scored}.items()}
    assert rows_of(readers.flat_profiles(spark, at["flat"], "in")) == rows_of(readers.parse_flat(whole(spark, at["flat"]), "in"))
    assert rows_of(readers.named_profiles(spark, at["named"], "in")) == rows_of(readers.parse_named(whole(spark, at["named"]), "in"))
    assert rows_of(readers.papers(spark, at["papers"])) == rows_of(readers.parse_papers(whole(spark, at["papers"])))
    assert rows_of(readers.triples(spark, at["triples"])) == rows_of(readers.parse_triples(whole(spark, at["triples"])))
    assert rows_of(readers.prior_scores(spark, at["prior"])) == rows_of(readers.parse_prior(whole(spark, at["prior"])))
    assert rows_of(readers.scored_requests(spark, at["scored"])) == rows_of(readers.parse_scored(whole(spark, at["scored"])))


def test_lines_have_their_places(spark, tmp_path, cuts):
    cuts(100)
    data = [{"aid1": "a", "pid": f"p{i}", "label": 1} for i in range(60)]
    at = tmp_path / "t.jsonl"
    at.write_text("\n".join(json.dumps(x) + ("\n" if i % 7 == 0 else "") for i, x in enumerate(data)))
    rows = readers.triples(spark, str(at), lines=True).orderBy("ord").collect()
    assert [(r.ord, r.pid) for r in rows] == [(i, f"p{i}") for i in range(60)]


def test_splits_that_change_raise(spark, tmp_path):
    """A split of which the first pass knows nothing is an error, not a loss."""
    df = spark.createDataFrame([("[1", 1, 0)], "value string, file long, start long")
    none = json_entries._begins(df.filter("false"), ",")
    known = df.join(none, ["file", "start"], "left").withColumn("_inside", F.coalesce("_inside", F.raise_error(F.lit("the splits of the file have changed")).cast("int")))
    with pytest.raises(Exception, match="splits of the file"):
        known.mapInArrow(partial(json_entries.cut, end=","), "file long, place long, start long, piece binary").collect()
