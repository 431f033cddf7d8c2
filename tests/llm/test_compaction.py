"""Compaction against a plain version in Python, and its packing against a search through all groups."""

import datetime
import glob
import hashlib
import math
import os
import random
import zlib
from collections import defaultdict
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from crossweave.llm import compaction as co
from tests.conftest import SF


def by_search(sizes, most):
    held, out = [], []
    for s in sizes:
        g = next((g for g, h in enumerate(held) if h + s <= most), len(held))
        held += [0] * (g == len(held))
        held[g] += s
        out.append(g)
    return out


def test_first_fit_is_the_search_through_all_groups():
    rng = random.Random(1)
    for _ in range(400):
        sizes = [rng.randint(1, rng.choice([5, 40, 1000])) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.5:
            sizes.sort(reverse=True)
        most = rng.choice([10, 60, 1000])
        assert co.first_fit(sizes, most) == by_search(sizes, most)


def plain(rows):
    """Rows (click_id, arrived_at, value) -> results without path and columns."""
    total, days, files = len(rows), defaultdict(int), defaultdict(list)
    day = lambda r: None if r[1] is None else (r[1] - datetime.datetime(1970, 1, 1)).days
    for r in rows:
        days[day(r)] += 1
    part = lambda x: 1 + total // x
    for r in rows:
        h = 0 if r[0] is None else zlib.crc32(str(r[0]).encode())
        files[day(r), (h // 16) % (1 + days[day(r)] // part(200)), min(h % 4, h // 4 % 4)].append(r)
    least = lambda x: (x is not None, x)
    for f in files.values():
        f.sort(key=lambda r: (least(r[1]), least(r[0])))
    out, left = [], dict(files)
    for d in days:
        small = sorted((k for k in files if k[0] == d and len(files[k]) < part(750)), key=lambda k: (-len(files[k]), k[1], k[2]))
        groups = defaultdict(list)
        for k, g in zip(small, by_search([len(files[k]) for k in small], part(300)), strict=True):
            groups[g].append(k)
        for g in groups.values():
            if len(g) > 1:
                out.append((g, [r for k in g for r in left.pop(k)], True))
    out += [([k], f, False) for k, f in left.items()]
    return [
        (*g[0], len(f), min((r[0] for r in f if r[0] is not None), default=None), max((r[0] for r in f if r[0] is not None), default=None), sum(math.floor(100 * r[2] + 0.5) for r in f if r[2] is not None),
         ",".join(f"{k[1]}-{k[2]}" for k in g), hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in f).encode()).hexdigest(), new)
        for g, f, new in out
    ]


NAMES = ["day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "rewritten"]


def check(spark, path):
    rows = [(r.click_id, r.arrived_at, r.value) for r in spark.read.parquet(path + "/clicks.parquet").select("click_id", "arrived_at", "value").collect()]
    got = co.op13_compaction(spark, path).collect()
    assert sorted((tuple(r[c] for c in NAMES) for r in got), key=str) == sorted(plain(rows), key=str)
    return got


def test_the_query(spark):
    got = check(spark, SF)
    assert any(r.rewritten for r in got)
    assert any(not r.rewritten for r in got)
    want = pq.read_schema(f"{SF}/clicks.parquet").names
    assert {r.columns for r in got} == {",".join(want)}
    files = {r.path: pq.read_table(unquote(r.path).removeprefix("file:")) for r in got}
    folder = os.path.dirname(unquote(got[0].path).removeprefix("file:"))
    assert len(glob.glob(f"{folder}/**/*.parquet", recursive=True)) == len(got)
    for r in got:
        t = files[r.path]
        assert t.column_names == want
        assert (len(t), hashlib.sha256(",".join(map(str, t["click_id"].to_pylist())).encode()).hexdigest()) == (r.n_rows, r.ids_sha256)
    whole = pa.concat_tables(files.values())
    key = [("click_id", "ascending"), ("arrived_at", "ascending"), ("props", "ascending"), ("ts", "ascending"), ("kind", "ascending")]
    assert whole.sort_by(key).equals(pq.read_table(f"{SF}/clicks.parquet").cast(whole.schema).sort_by(key))


def test_files_that_stay_are_not_touched(spark):
    clicks = spark.read.parquet(f"{SF}/clicks.parquet")
    folder = co.table_path(spark, "clicks")
    filed, total = co.by_day(co.whole_rows(clicks))
    co.write_files(filed(co.whole_rows(clicks)), folder, ["arrived_at", "click_id"])
    at = folder.removeprefix("file:")
    before = {p: (os.stat(p).st_mtime_ns, open(p, "rb").read()) for p in glob.glob(f"{at}/*.parquet")}
    files = co.stored(co.files_of(spark, folder, clicks.schema, filed, ["click_id", "arrived_at"]), "starts")
    plan = {unquote(r.path).removeprefix("file:") for r in co.compact(spark, folder, clicks.schema, files, "day", co.part(total, 750), co.part(total, 300)).collect()}
    after = {p: (os.stat(p).st_mtime_ns, open(p, "rb").read()) for p in glob.glob(f"{at}/*.parquet")}
    assert plan
    assert not {p.replace("//", "/") for p in plan} & set(after)
    stay = {p for p in before if p not in {q.replace("//", "/") for q in plan}}
    assert all(after[p] == before[p] for p in stay)


@pytest.mark.parametrize("n", [0, 1, 7, 900])
def test_nulls_ties_and_other_columns(spark, tmp_path, n):
    rng = random.Random(n)
    day = datetime.datetime(2024, 1, 1)
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, day + datetime.timedelta(hours=rng.choice([-20_000_000 // 24, 1, 2, 30, 99]))]), rng.choice([None, 1.005, -2.5, 10.0]), "x", i, i, "y", None) for i in range(n)]
    rows += rows[: n // 5]
    spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, value double, day string, lot int, nth int, _path string, _row string").repartition(3).write.parquet(f"{tmp_path}/clicks.parquet")
    got = check(spark, str(tmp_path))
    assert {r.columns for r in got} == ({"click_id,arrived_at,value,day,lot,nth,_path,_row"} if n else set())
