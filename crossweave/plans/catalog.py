"""All queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.config import EngineConfig
from crossweave.functions import replies, text
from crossweave.operators import batching, labels, lengths, metrics, objective, ordering, profiles, refine, render, scorer, vectors
from crossweave.plans import pipeline
from crossweave.plans import proxies as px
from crossweave.plans.proxies import INNER, OUTER, SCORED, TIED, table
from crossweave.sources import readers, sinks, storage
from crossweave.streaming import resume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def fixed(text: str) -> str:
    """SQL for the stub scorers' score of a text."""
    return f"(CAST(('0x' || substr(md5({text}), 1, 2)) AS INT) % 101) / 100.0::DOUBLE"


# ---- metrics

_AUTHORS = """steps AS (SELECT aid1 AS aid, 1 - pred + 0.0 AS q, sum(1 - label) AS pos, count(*) AS n FROM scored GROUP BY 1, 2),
run AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS nn FROM steps WINDOW w AS (PARTITION BY aid ORDER BY q DESC ROWS UNBOUNDED PRECEDING)),
sums AS (SELECT aid, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(n) AS BIGINT) AS sample_count, CAST(sum((n - pos) * (tp - pos / 2.0::DOUBLE)) AS DOUBLE) AS wins,
    sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(nn AS DOUBLE)) AS gain FROM run GROUP BY aid),
authors AS (SELECT aid, wins / (p * (sample_count - p)) AS auc, gain / p AS ap, sample_count, 1 - p / sample_count AS pos_ratio FROM sums WHERE p > 0 AND 2 * p <= sample_count)"""
_AUTHOR_ROWS = "SELECT aid, round(auc, 6) AS auc, round(ap, 6) AS ap, sample_count, round(pos_ratio, 6) AS pos_ratio FROM authors"


@query(f"WITH {SCORED}, {_AUTHORS} {_AUTHOR_ROWS}")
def author_metrics(spark, d):
    return metrics.author_metrics(px.scored(spark, d)).select("aid", *r6("auc", "ap"), "sample_count", *r6("pos_ratio"))


@query(f"WITH {TIED}, {_AUTHORS} {_AUTHOR_ROWS}")
def author_metrics_ties(spark, d):
    return metrics.author_metrics(px.tied(spark, d)).select("aid", *r6("auc", "ap"), "sample_count", *r6("pos_ratio"))


@query(f'WITH {SCORED}, {_AUTHORS} SELECT round(avg(ap), 6) AS "MAP", round(avg(auc), 6) AS "AUC", round(avg(auc) + avg(ap), 6) AS "AUC_MAP", count(*) AS n_authors FROM authors')
def macro_auc_map(spark, d):
    return metrics.macro(metrics.author_metrics(px.scored(spark, d))).select(*r6("MAP", "AUC", "AUC_MAP"), "n_authors")


@query(f"WITH {SCORED} SELECT round(avg(CAST(CAST(pred >= 0.5 AS INT) = label AS INT)), 6) AS accuracy, count(*) AS n FROM scored")
def global_accuracy(spark, d):
    return metrics.accuracy(px.scored(spark, d)).select(*r6("accuracy"), "n")


@query(f"""WITH {SCORED}, m AS (SELECT aid1, pid, pred, min(pred) OVER w AS a, max(pred) OVER w AS b FROM scored WINDOW w AS (PARTITION BY aid1))
SELECT aid1, pid, round(CASE WHEN a = b THEN 0.5::DOUBLE ELSE (pred - a) / (b - a) END, 6) AS scaled FROM m""")
def minmax_norm(spark, d):
    return metrics.minmax(px.scored(spark, d), "pred", ["aid1"]).select("aid1", "pid", *r6("scaled"))


# ---- keys, projections, unions

@query("SELECT concat(o_orderkey, '-', o_custkey) AS pid, split_part(concat(o_orderkey, '-', o_custkey), '-', 1) AS paper_id FROM orders")
def paper_id_extract(spark, d):
    return table(spark, d, "orders").select(F.concat_ws("-", "o_orderkey", "o_custkey").alias("pid")).withColumn("paper_id", profiles.paper_id())


@query("SELECT event_id, concat(user_id, '-', coalesce(CASE WHEN event_type = 'click' THEN event_type END, 'None')) AS pair FROM events")
def pair_key(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("aid1"), F.when(F.col("event_type") == "click", F.col("event_type")).alias("aid2"))
    return e.select("event_id", profiles.pair_key().alias("pair"))


_NAMED = "named AS (SELECT l_returnflag AS name, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS name_ord, CAST(l_suppkey AS VARCHAR) AS aid FROM lineitem)"


@query(f"WITH {_NAMED}, m AS (SELECT *, max(name_ord) OVER (PARTITION BY aid) AS last FROM named) SELECT aid, name, count(*) AS n_papers FROM m WHERE name_ord = last GROUP BY aid, name")
def flatten_profiles(spark, d):
    """Names in an order of their own, as in a file; the last one's list stays."""
    order = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"), order.alias("name_ord"), F.col("l_suppkey").cast("string").alias("aid"))
    return profiles.flatten_names(x).groupBy("aid", "name").agg(F.count("*").alias("n_papers"))


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN value END, value / 1000) AS sim FROM events")
def sim_coalesce(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("similarity"), (F.col("value") / 1000).alias("author_sim"))
    return e.select("event_id", profiles.similarity(strict=True).alias("sim"))


@query(f"WITH {SCORED} SELECT pid, abs(coalesce(CASE WHEN event_type <> 'error' THEN pred END, 0.5) - 0.5) AS confidence FROM scored")
def confidence(spark, d):
    return px.scored(spark, d).withColumn("pred", F.when(F.col("event_type") != "error", F.col("pred"))).select("pid", profiles.confidence().alias("confidence"))


_PARTS = [("train", "click"), ("test", "view"), ("valid", "error")]


@query("""SELECT part, aid1, pid, similarity FROM (
SELECT 'train' AS part, CAST(user_id AS VARCHAR) AS aid1, CAST(event_id AS VARCHAR) AS pid, value AS similarity FROM events WHERE event_type = 'click'
UNION ALL SELECT 'test', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), NULL FROM events WHERE event_type = 'view'
UNION ALL SELECT 'valid', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), NULL FROM events WHERE event_type = 'error')""")
def union_triples(spark, d):
    e = table(spark, d, "events")
    parts = [e.filter(F.col("event_type") == t).select(F.lit(p).alias("part"), F.col("user_id").alias("aid1"), F.col("event_id").alias("pid"), *([F.col("value").alias("similarity")] if p == "train" else [])) for p, t in _PARTS]
    return readers.union_triples(*parts)


@query(f"WITH {SCORED} SELECT pid, label FROM scored WHERE label = 1 UNION ALL SELECT pid, label FROM scored WHERE label = 0")
def label_split_union(spark, d):
    pos, neg = labels.split(px.scored(spark, d).select("pid", "label"))
    return pos.union(neg)


@query(f"""WITH {SCORED}, k AS (SELECT greatest(1, CAST(floor(count(*) FILTER (label = 1) / nullif(count(*) FILTER (label = 0), 0)) AS BIGINT)) AS k FROM scored)
SELECT pid, label, unnest(range(1, CASE WHEN label = 0 THEN coalesce(k, 1) ELSE 1 END + 1)) AS copy FROM scored, k""")
def upsample_negatives(spark, d):
    return labels.upsample(px.scored(spark, d)).select("pid", "label", "copy")


@query(f"WITH {SCORED} SELECT pid, label AS ori_label, CAST(1 - pred >= 0.9 AS INT) AS label FROM scored")
def label_threshold(spark, d):
    return labels.threshold(px.scored(spark, d).withColumn("soft_label", 1 - F.col("pred"))).select("pid", "ori_label", "label")


# ---- filters and joins

@query(f"WITH {SCORED} SELECT aid1 AS aid, pid FROM (SELECT *, count(*) OVER (PARTITION BY aid1) AS n FROM scored) WHERE n > 60")
def min_profile(spark, d):
    return profiles.min_profile(px.scored(spark, d).select(F.col("aid1").alias("aid"), "pid"), 60)


_PAPERS = "papers AS (SELECT CAST(p_partkey AS VARCHAR) AS pid, p_name AS title, p_size FROM part)"


def _papers(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("pid"), F.col("p_name").alias("title"), "p_size")


@query(f"WITH {INNER}, {_PAPERS} SELECT aid, ord, pid FROM inn WHERE pid IN (SELECT pid FROM papers WHERE p_size > 25)")
def known_papers_semi(spark, d):
    return profiles.known(px.assignments(spark, d, "O"), _papers(spark, d).filter("p_size > 25")).select("aid", "ord", "pid")


@query(f"""WITH {INNER}, {OUTER}, f AS (SELECT aid, arg_min(pid, ord) AS first_pid FROM outr GROUP BY aid)
SELECT aid, ord, pid FROM inn JOIN f USING (aid) WHERE pid <> first_pid""")
def self_exclusion(spark, d):
    first = profiles.first_targets(px.assignments(spark, d, "F").withColumnRenamed("aid", "aid1"))
    return profiles.without_first_target(px.assignments(spark, d, "O"), first).select("aid", "ord", "pid")


@query(f"WITH {SCORED} SELECT pid, CASE WHEN pred >= 0.1 THEN aid1 END AS outer_aid FROM scored")
def hybrid_gate(spark, d):
    return px.scored(spark, d).select("pid", profiles.gated("aid1", "pred", 0.1).alias("outer_aid"))


@query(f"WITH {SCORED} SELECT pid, CASE WHEN 1 - pred > 0.5 THEN 'consistent' ELSE 'inconsistent' END AS part FROM scored")
def cs_ics_partition(spark, d):
    return px.scored(spark, d).withColumn("sim", 1 - F.col("pred")).select("pid", profiles.consistency().alias("part"))


@query(f"WITH {INNER}, {_PAPERS} SELECT aid, ord, pid, title FROM inn JOIN papers USING (pid)")
def papers_inner(spark, d):
    return profiles.assert_known(px.assignments(spark, d, "O"), _papers(spark, d)).join(_papers(spark, d), "pid").select("aid", "ord", "pid", "title")


_AIDS = "aids AS (SELECT CAST(s_suppkey AS VARCHAR) AS aid FROM supplier WHERE s_acctbal > 0)"


def _aids(spark, d):
    return table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("aid"))


@query(f"WITH {INNER}, {_PAPERS}, {_AIDS} SELECT aid, ord, pid, title FROM aids JOIN inn USING (aid) JOIN papers USING (pid)")
def profiles_inner(spark, d):
    return profiles.profile_papers(_aids(spark, d), px.assignments(spark, d, "O"), _papers(spark, d)).select("aid", "ord", "pid", "title")


_RICH = "rich AS (SELECT CAST(s_suppkey AS VARCHAR) AS aid FROM supplier WHERE s_acctbal > 3000)"


@query(f"WITH {OUTER}, {_AIDS}, {_RICH} SELECT aid, count(pid) AS n_papers FROM aids LEFT JOIN (SELECT * FROM outr WHERE aid IN (SELECT aid FROM rich)) o USING (aid) GROUP BY aid")
def profiles_outer_left(spark, d):
    """Some profiles have no list in the outer source."""
    there = table(spark, d, "supplier").filter("s_acctbal > 3000").select(F.col("s_suppkey").cast("string").alias("aid"))
    lists = profiles.lists(px.assignments(spark, d, "F").join(there, "aid", "left_semi"))
    return _aids(spark, d).join(lists, "aid", "left").select("aid", F.size(F.coalesce("pids", F.array().cast("array<string>"))).cast("long").alias("n_papers"))


@query(f"""WITH {INNER}, {_AIDS}, {_PAPERS}, clean AS (SELECT aid, ord, pid FROM inn JOIN aids USING (aid) WHERE pid IN (SELECT pid FROM papers WHERE p_size > 25))
SELECT aid, ord, pid FROM clean UNION ALL SELECT aid, ord, pid FROM inn WHERE aid NOT IN (SELECT aid FROM clean)""")
def clean_fallback(spark, d):
    raw = px.assignments(spark, d, "O")
    return profiles.with_fallback(profiles.known(raw.join(_aids(spark, d), "aid", "left_semi"), _papers(spark, d).filter("p_size > 25")).select(*raw.columns), raw)


@query(f"WITH {SCORED} SELECT a.pid, coalesce(b.pred, 0.5) AS pred FROM scored a LEFT JOIN (SELECT * FROM scored WHERE event_type = 'click') b USING (pid)")
def prior_scores_left(spark, d):
    s = px.scored(spark, d)
    prior = readers.last_wins(s.filter("event_type = 'click'"), ["pid"], "ord").select("pid", "pred")
    return profiles.prior(s.select("pid"), prior)


@query(f"""WITH {INNER}, {OUTER}, a AS (SELECT aid, count(*) AS n1 FROM inn GROUP BY aid), b AS (SELECT aid, count(*) AS n2 FROM outr GROUP BY aid),
c AS (SELECT aid, count(*) AS common FROM (SELECT DISTINCT aid, pid FROM inn INTERSECT SELECT DISTINCT aid, pid FROM outr) GROUP BY aid)
SELECT aid, coalesce(common, 0) AS common, round(least(coalesce(common, 0) / n1, coalesce(common, 0) / n2), 6) AS low, round(greatest(coalesce(common, 0) / n1, coalesce(common, 0) / n2), 6) AS high
FROM a JOIN b USING (aid) LEFT JOIN c USING (aid)""")
def profile_overlap(spark, d):
    return profiles.overlap(px.assignments(spark, d, "O"), px.assignments(spark, d, "F")).select("aid", "common", *r6("low", "high"))


@query("SELECT l_returnflag AS name, arg_max(CAST(l_suppkey AS VARCHAR), l_suppkey * 100000000 + l_orderkey) AS aid FROM lineitem GROUP BY 1")
def last_aid_per_name(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_suppkey").cast("string").alias("aid"), (F.col("l_suppkey") * 100000000 + F.col("l_orderkey")).alias("ord"))
    return profiles.last_aid(x)


# ---- batches

@query(f"WITH {INNER} SELECT aid, ord, pid FROM (SELECT *, row_number() OVER (PARTITION BY aid, pid ORDER BY ord) AS k FROM inn) WHERE k = 1")
def dedupe_first(spark, d):
    return batching.dedupe_first(px.assignments(spark, d, "O"), ["aid", "pid"]).select("aid", "ord", "pid")


@query(f"WITH {SCORED}, x AS (SELECT aid1, pid, row_number() OVER (PARTITION BY aid1 ORDER BY ord) - 1 AS i FROM scored) SELECT aid1, pid, CAST(i // 10 AS INT) AS batch_id, CAST(i % 10 AS INT) AS pos FROM x")
def fixed_batches(spark, d):
    return batching.fixed(px.scored(spark, d), ["aid1"], 10, [F.col("ord")]).select("aid1", "pid", "batch_id", "pos")


@query(f"""WITH {SCORED}, x AS (SELECT aid1, pid, row_number() OVER (PARTITION BY aid1 ORDER BY md5(concat('42-', aid1, '-', pid)), ord) - 1 AS i FROM scored)
SELECT aid1, pid, CAST(i // 10 AS INT) AS batch_id, CAST(i % 10 AS INT) AS pos FROM x""")
def random_turns(spark, d):
    return batching.build_turns(px.scored(spark, d), ["aid1"], 10, "random", "42", False).select("aid1", "pid", "batch_id", "pos")


@query(f"""WITH {SCORED}, x AS (SELECT aid1, pid, row_number() OVER (PARTITION BY aid1 ORDER BY abs(pred - 0.5) DESC, ord) - 1 AS i, CAST(ceil(count(*) OVER (PARTITION BY aid1) / 10) AS BIGINT) AS b FROM scored),
y AS (SELECT aid1, pid, i // b AS r, CASE WHEN (i // b) % 2 = 0 THEN i % b ELSE b - 1 - i % b END AS batch_id FROM x),
z AS (SELECT *, count(*) OVER (PARTITION BY aid1, batch_id) AS m FROM y)
SELECT aid1, pid, CAST(batch_id AS INT) AS batch_id, CAST(CASE WHEN r < ceil(m / 2) THEN 2 * r ELSE 2 * (m - 1 - r) + 1 END AS INT) AS pos FROM z""")
def snake_interleave(spark, d):
    return batching.build_turns(px.scored(spark, d), ["aid1"], 10, "confidence", "42", True).select("aid1", "pid", "batch_id", "pos")


@query(f"WITH {INNER} SELECT aid, pid, nth FROM (SELECT aid, pid, CAST(row_number() OVER (PARTITION BY aid ORDER BY md5(concat('42-', aid, '-', pid)), ord) AS INT) AS nth FROM inn) WHERE nth <= 20")
def sample_profile_k(spark, d):
    return profiles.sample(px.assignments(spark, d, "O"), 20, "42").select("aid", "pid", "nth")


@query("""WITH x AS (SELECT CAST(o_custkey AS VARCHAR) AS aid, o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS pid, CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INT) END AS year, CASE WHEN c_acctbal > 0 THEN 1995 ELSE 0 END AS t
FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT aid, ord, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY aid ORDER BY CASE WHEN t <> 0 THEN abs(coalesce(year, 0) - t) END NULLS FIRST, CASE WHEN t = 0 THEN md5(concat('42-', aid, '-', pid)) END NULLS FIRST, ord) AS INT) AS nth FROM x) WHERE nth <= 5""")
def nearest_year_topk(spark, d):
    """Papers without a year, and profiles without a target year (0), among them."""
    targets = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, 1995).otherwise(0).alias("target_year"))
    o = table(spark, d, "orders").join(targets, F.col("o_custkey") == F.col("c_custkey"))
    year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("year")
    o = o.select(F.col("o_custkey").cast("string").alias("aid"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("pid"), year, "target_year")
    return profiles.nearest_year(o, 5).select("aid", "ord", "nth")


@query("""WITH x AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, doc_id, CAST(before AS BIGINT) AS before FROM x WHERE before < 20000""")
def token_budget_prefix(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return batching.within_budget(docs, ["source"], "n_chars", F.lit(20000), [F.col("doc_id")]).select("source", "doc_id", "before")


@query("""WITH x AS (SELECT event_id, date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS epoch FROM events)
SELECT event_id, CAST(epoch AS INT) AS epoch, CAST(least(power(4, epoch), 10) AS INT) AS exponential, CAST(least(epoch + 1, 10) AS INT) AS linear FROM x""")
def curriculum_num_turn(spark, d):
    """Each day is an epoch."""
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    first = e.agg(F.min("day")).scalar()
    e = e.select("event_id", F.datediff("day", first).alias("epoch"))
    return e.select("event_id", "epoch", *[batching.turns_at(F.col("epoch"), 10, k).alias(k) for k in ("exponential", "linear")])


@query(f"""WITH {SCORED}, r AS (SELECT *, unnest([0, 1, 2]) AS epoch FROM scored),
t AS (SELECT *, CAST(least(power(4, epoch), 10) AS INT) AS turns, row_number() OVER (PARTITION BY epoch, aid1 ORDER BY md5(concat(42 + epoch, '-', aid1, '-', pid)), ord) - 1 AS i FROM r),
b AS (SELECT epoch, aid1, pid, CAST(i // turns AS INT) AS batch_id, CAST(i % turns AS INT) AS pos FROM t), u AS (SELECT DISTINCT epoch, aid1, batch_id FROM b),
v AS (SELECT *, CAST((row_number() OVER (PARTITION BY epoch ORDER BY md5(concat(42 + epoch, '-', aid1, '-', batch_id)), aid1, batch_id) - 1) // 8 AS INT) AS step FROM u)
SELECT epoch, aid1, pid, batch_id, pos, step FROM b JOIN v USING (epoch, aid1, batch_id) WHERE step < 20""")
def curriculum_epochs(spark, d):
    """Three epochs of growing batches, each in an order of its own and cut after 20 steps of eight batches."""
    out = ordering.curriculum(px.scored(spark, d), 3, ["aid1"], 10, "exponential", 42, 8, 20)
    return out.select("epoch", "aid1", "pid", "batch_id", "pos", "step")


@query("""WITH x AS (SELECT conv_id, turn, list_transform(range(0, length(text) % 7 + 1), lambda i: CAST(i AS INT)) AS ids FROM conversations), y AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS m FROM x)
SELECT conv_id, turn, array_to_string(list_resize(ids, m, 9), ',') AS input_ids, CAST(len(ids) AS INT) AS used, CAST(m AS INT) AS width FROM y""")
def pad_batch(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.transform(F.sequence(F.lit(0), F.char_length("text") % 7), lambda i: i.cast("int")).alias("ids"))
    out = batching.pad(c, ["conv_id"], "ids", 9)
    return out.select("conv_id", "turn", F.array_join("input_ids", ",").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("used"), F.size("labels").alias("width"))


# ---- text

_LISTS = "lists AS (SELECT aid, list(pid ORDER BY ord) AS pids FROM inn GROUP BY aid)"


@query(f"WITH {INNER}, {_LISTS} SELECT aid, array_to_string(CASE WHEN len(pids) > 10 THEN list_concat(pids[1:8], pids[-2:]) ELSE pids END, ',') AS pids FROM lists")
def cap_8_2(spark, d):
    return profiles.lists(px.assignments(spark, d, "O")).select("aid", F.array_join(text.head_tail(F.col("pids")), ",").alias("pids"))


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:10], ' ') AS org FROM documents")
def org_first_10_words(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_words(F.col("text")).alias("org"))


@query("WITH x AS (SELECT CAST(c_nationkey AS VARCHAR) AS aid, list(DISTINCT c_mktsegment) AS o FROM customer GROUP BY 1) SELECT aid, CAST(len(o) AS INT) AS n_orgs, array_to_string(list_sort(o), ',') AS orgs FROM x")
def distinct_orgs(spark, d):
    x = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("aid")).agg(F.array_sort(F.array_distinct(F.collect_list("c_mktsegment"))).alias("o"))
    return x.select("aid", F.size("o").alias("n_orgs"), F.array_join("o", ",").alias("orgs"))


def _part_papers(spark, d):
    author = "named_struct('name', p_brand, 'org', p_type, 'OriginalAuthor', cast(null as string), 'OriginalAffiliation', cast(null as string), 'AuthorSequenceNumber', 1)"
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("pid"), F.col("p_name").alias("title"), F.expr(f"array({author})").alias("authors"), F.lit(None).cast("string").alias("venue"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("year"), F.split("p_type", " ").alias("keywords"))


_RENDERED = "'Title: ' || p_name || chr(10) || 'Authors: ' || p_brand || chr(10) || 'Organizations: ' || p_type || chr(10) || 'Venue: None' || chr(10) || 'Year: ' || CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) ELSE 'None' END || chr(10) || 'Keywords: ' || array_to_string(string_split(p_type, ' '), ', ') || chr(10)"


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS pid, {_RENDERED} AS text FROM part")
def render_paper(spark, d):
    return render.rendered(_part_papers(spark, d))


def _picked(name: str, source: str, k: int) -> str:
    """SQL for `_sampled`: the titles of at most k papers of each profile, and the mean size of these papers over 50.3, as a similarity that two decimals don't hold."""
    shuffled = f"SELECT *, row_number() OVER (PARTITION BY aid ORDER BY md5(concat('42-', aid, '-', pid)), ord) AS nth FROM {source}"
    return f"{name} AS (SELECT aid, list(title ORDER BY nth) AS t, avg(p_size) / 50.3 AS sim FROM ({shuffled}) JOIN papers USING (pid) WHERE nth <= {k} GROUP BY aid)"


def _dealt(name: str, source: str, n: int) -> str:
    """SQL for `_batches`: the titles of all papers of each profile, dealt to batches of n at random."""
    shuffled = f"SELECT *, row_number() OVER (PARTITION BY aid ORDER BY md5(concat('42-', aid, '-', pid)), ord) - 1 AS i FROM {source}"
    return f"{name} AS (SELECT aid, CAST(i // {n} AS INT) AS batch_id, list(title ORDER BY i) AS b, list(p_size / 50.3::DOUBLE ORDER BY i) AS s FROM ({shuffled}) JOIN papers USING (pid) GROUP BY 1, 2)"


def _sampled(spark, d, status, k):
    rows = profiles.sample(px.assignments(spark, d, status), k, "42").join(_papers(spark, d), "pid")
    rows = rows.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("nth", "title"))).alias("x"), (F.avg("p_size") / 50.3).alias("sim"))
    return rows.select("aid", F.col("x.title").alias("t"), "sim")


def _batches(spark, d, n):
    rows = batching.random_turns(px.assignments(spark, d, "O"), ["aid"], n, "42").join(_papers(spark, d), "pid")
    rows = rows.groupBy("aid", "batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title", (F.col("p_size") / 50.3).alias("s")))).alias("x"))
    return rows.select("aid", "batch_id", F.col("x.title").alias("b"), F.col("x.s").alias("s"))


_NUMBERED = "list_transform(b, lambda x, k: CAST(k - 1 AS VARCHAR) || ': ' || x)"


@query(f"""WITH {INNER}, {OUTER}, {_PAPERS}, {_picked("i", "inn", 20)}, {_picked("o", "outr", 20)}, {_dealt("dealt", "inn", 20)}
SELECT aid, batch_id, 'Name: ' || aid || chr(10) || 'Internal profile: ' || array_to_string(i.t, '; ') || chr(10) || 'External profile: ' || array_to_string(o.t, '; ') || chr(10) || 'Profile similarity: ' ||
CASE WHEN i.sim > 0.5 THEN printf('%.2f', o.sim) ELSE 'unknown' END || chr(10) || 'Targets: ' || array_to_string({_NUMBERED}, '; ') AS prompt FROM dealt JOIN i USING (aid) JOIN o USING (aid)""")
def prompt_two_source(spark, d):
    """All targets in batches, each with a sample of both profiles; some pairs have no similarity."""
    outer = _sampled(spark, d, "F", 20).select("aid", F.col("t").alias("outer"), F.col("sim").alias("outer_sim"))
    both = _batches(spark, d, 20).join(_sampled(spark, d, "O", 20), "aid").join(outer, "aid")
    sim = F.when(F.col("sim") > 0.5, F.col("outer_sim"))
    return both.select("aid", "batch_id", render.prompt_two_sources(F.col("aid"), F.col("t"), F.col("outer"), sim, F.col("b")).alias("prompt"))


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS t, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id),
o AS (SELECT *, 'Name: C' || conv_id || chr(10) || 'Internal profile:' || chr(10) || array_to_string(r, chr(10)) || chr(10) || 'External profile:' || chr(10) || 'none' || chr(10) || 'Profile similarity: ' ||
    CASE WHEN conv_id % 3 = 0 THEN 'unknown' ELSE printf('%.2f', len(t) / 7.3) END AS opening FROM c)
SELECT conv_id, CAST(i AS INT) AS pos, CASE WHEN i = 0 THEN 'system' WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END AS role,
CASE WHEN i = 0 THEN 'Judge each item.' WHEN i = 1 THEN opening || chr(10) || t[1] WHEN i % 2 = 1 THEN t[(i + 1) // 2] ELSE '' END AS content
FROM (SELECT conv_id, t, opening, unnest(range(0, 2 * len(t) + 1)) AS i FROM o)""")
def chat_transcript(spark, d):
    """The first turn opens with both profiles and their similarity, rounded; some have none."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("t"))
    sim = F.when(F.col("conv_id") % 3 != 0, F.size("t") / 7.3)
    opening = render.chat_context(F.concat(F.lit("C"), F.col("conv_id").cast("string")), F.col("t.role"), F.lit(None).cast("array<string>"), sim)
    return c.select("conv_id", F.posexplode(render.chat(F.lit("Judge each item."), opening, F.col("t.text"))).alias("pos", "m")).select("conv_id", "pos", "m.role", "m.content")


# ---- replies

@query("SELECT event_id, CASE event_id % 7 WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events")
def llm_json_parse(spark, d):
    """Replies in a fence, with single quotes, with a trailing comma, with an object before the last and prose around, on several lines; without an object, or cut off."""
    p = F.col("props")
    forms = [
        F.concat(F.lit("<think>so {</think>Here it is:\n```json\n"), p, F.lit("\n```\n")), F.translate(p, '"', "'"), F.regexp_replace(p, r"\}$", ",}"),
        F.concat(F.lit('first {"k": 1000}, no: '), p, F.lit(" is right.")), F.concat(F.lit("```\n"), F.regexp_replace(p, ": ", ":\n  "), F.lit("\n```")), F.lit("no scores"), F.substring(p, 1, 4),
    ]
    said = F.element_at(F.array(*forms), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.try_element_at(replies.scores(said), F.lit("k")).try_cast("double").alias("k"))


@query("SELECT event_id, event_type AS reasoning, props AS content FROM events")
def think_split(spark, d):
    e = table(spark, d, "events").withColumn("c", F.concat(F.lit("<think>"), F.col("event_type"), F.lit("</think>\n"), F.col("props")))
    return e.select("event_id", replies.reasoning(F.col("c")).alias("reasoning"), replies.answer(F.col("c")).alias("content"))


def _reply():
    return F.concat(F.lit('{"10": 3, "2": '), (F.col("event_id") % 7).cast("string"), F.lit(', "x": 1, "0": 1}'))



@query("SELECT event_id, '1.0,' || CAST(event_id % 7 AS VARCHAR) || '.0,3.0' AS scores FROM events")
def score_sort_int_key(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(F.transform(replies.in_order(replies.scores(_reply())), lambda v: v.cast("string")), ",").alias("scores"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '1.0,' || CAST(event_id % 7 AS VARCHAR) || '.0,3.0' ELSE '0.5,0.5' END AS scores FROM events")
def length_mismatch_default(spark, d):
    n = F.when(F.col("event_id") % 2 == 0, 3).otherwise(2)
    v = replies.for_items(replies.in_order(replies.scores(_reply())), n)
    return table(spark, d, "events").select("event_id", F.array_join(F.transform(v, lambda x: x.cast("string")), ",").alias("scores"))


@query("""SELECT event_id, CAST(pos AS INT) AS pos, CASE pos WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN value WHEN 2 THEN CAST(event_id % 7 AS DOUBLE) END AS new_pred FROM events, range(0, 3) t(pos)""")
def batch_score_merge(spark, d):
    e = table(spark, d, "events").select("event_id", "value", replies.scores(_reply()).alias("s"))  # parsed once a reply, then dealt to its items
    e = e.select("event_id", "value", "s", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos"))
    return e.select("event_id", "pos", refine.merged(F.col("s"), F.col("pos"), F.col("value")).alias("new_pred"))


@query(f"WITH {SCORED} SELECT round(avg(abs((1 - pred) - pred)), 6) AS mean_change, round(max(abs((1 - pred) - pred)), 6) AS max_change, count(*) AS n_papers FROM scored")
def refine_change_stats(spark, d):
    return refine.change_stats(px.scored(spark, d).select(F.col("pred").alias("old_pred"), (1 - F.col("pred")).alias("new_pred"))).select(*r6("mean_change", "max_change"), "n_papers")


@query("""WITH x AS (SELECT CAST(user_id AS VARCHAR) AS aid1, event_type AS aid2, CAST(event_id AS VARCHAR) AS pid, value, CAST(row_number() OVER w - 1 AS BIGINT) AS i,
    first_value(event_id) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
SELECT aid1, aid2, CASE WHEN f % 2 = 0 THEN 'unknown' ELSE concat('N', f) END AS name, CAST(i AS INT) AS batch_idx, pid, value AS old_pred FROM x""")
def group_batches(spark, d):
    """The first batch of a pair gives its name, and some have none."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("aid1"), F.col("event_type").alias("aid2"), F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("N"), "event_id")).alias("name"), F.col("event_id").alias("ord"), F.array(F.col("event_id").cast("string")).alias("pids"), F.array("value").alias("preds"))
    return refine.flatten_batches(refine.group_batches(e)).select("aid1", "aid2", "name", "batch_idx", "pid", "old_pred")


# ---- objective

_LOGITS = "logits AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS no, CAST(embedding[2] AS DOUBLE) AS yes, label % 2 AS label, CAST(abs(embedding[3]) AS DOUBLE) / (1 + CAST(abs(embedding[3]) AS DOUBLE)) AS p_out, CAST(abs(embedding[4]) AS DOUBLE) / (1 + CAST(abs(embedding[4]) AS DOUBLE)) AS sim FROM embeddings), probs AS (SELECT *, 1 / (1 + exp(no - yes)) AS p FROM logits)"


def _logits(spark, d):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    e = table(spark, d, "embeddings")
    e = e.select("vec_id", at(0).alias("no"), at(1).alias("yes"), (F.col("label") % 2).alias("label"), (F.abs(at(2)) / (1 + F.abs(at(2)))).alias("p_out"), (F.abs(at(3)) / (1 + F.abs(at(3)))).alias("sim"))
    return e.withColumn("p", objective.p_yes(F.col("no"), F.col("yes")))


@query(f"WITH {_LOGITS} SELECT vec_id, round(p, 6) AS p, CAST(yes > no AS INT) AS predicted FROM probs")
def softmax_yes(spark, d):
    return _logits(spark, d).select("vec_id", *r6("p"), objective.argmax(F.col("no"), F.col("yes")).alias("predicted"))


@query(f"WITH {_LOGITS} SELECT round(avg(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)), 6) AS ce FROM probs")
def ce_loss(spark, d):
    return objective.loss(_logits(spark, d)).select(*r6("ce"))


@query(f"""WITH {_LOGITS}, t AS (SELECT -ln(CASE WHEN label = 1 THEN p ELSE 1 - p END) AS c, CASE WHEN sim > 0.5 THEN least(p_out + sim - p - 1, 0) ELSE least(greatest(p_out, 1 - p_out) - sim + p - 1, 0) END AS s FROM probs)
SELECT round(avg(c), 6) AS ce, round(avg(s), 6) AS psl, round(0.5 * avg(s) + 0.5 * avg(c), 6) AS loss FROM t""")
def psl_loss(spark, d):
    return objective.loss(_logits(spark, d), "psl").select(*r6("ce", "psl", "loss"))


# ---- scoring and resuming

def _requests(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").cast("string").alias("request_id"), F.concat(F.lit("Targets: "), F.col("event_type"), F.lit("; "), F.col("props")).alias("prompt"))


@query(f"WITH x AS (SELECT CAST(event_id AS VARCHAR) AS request_id, unnest([0, 1]) AS pos, unnest([event_type, trim(props)]) AS t FROM events) SELECT request_id, CAST(pos AS INT) AS pos, {fixed('t')} AS score FROM x")
def llm_score_stub(spark, d):
    done = scorer.call(_requests(spark, d), tasks=spark.sparkContext.defaultParallelism)
    return done.select("request_id", F.posexplode(replies.in_order(replies.scores(F.col("content")))).alias("pos", "score"))


@query("SELECT CAST(event_id AS VARCHAR) AS request_id FROM events WHERE event_type <> 'click'")
def resume_pending(spark, d):
    r = _requests(spark, d)
    done = table(spark, d, "events").filter("event_type = 'click'").select(F.col("event_id").cast("string").alias("request_id"))
    return resume.pending(r, done).select("request_id")


@query("""WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS aid1, l_returnflag AS aid2, list(CAST(l_partkey AS VARCHAR) ORDER BY l_partkey) AS p, sum(l_linenumber) AS s FROM lineitem GROUP BY 1, 2)
SELECT aid1, aid2, CAST(len(p) AS INT) AS n_pids, CASE WHEN aid2 <> 'A' THEN CAST(s AS VARCHAR) END AS content FROM x""")
def result_reorder(spark, d):
    """Two replies came for most requests, with their ids in other orders; the later one counts."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("aid1"), F.col("l_returnflag").alias("aid2")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("pids"), F.sum("l_linenumber").cast("string").alias("content"))
    last = x.filter("aid2 <> 'A'").withColumns({"pids": F.reverse("pids"), "ord": F.lit(2)})
    first = last.withColumns({"pids": F.array_sort("pids"), "content": F.lit("zz superseded"), "ord": F.lit(1)})
    return scorer.with_replies(x.drop("content"), first.unionByName(last), order="ord").select("aid1", "aid2", F.size("pids").alias("n_pids"), "content")


@query(f"""WITH {SCORED}, p AS (SELECT aid1, pid, ord, CASE WHEN event_type <> 'view' THEN pred ELSE 0.5 END AS pred FROM scored),
x AS (SELECT aid1, pid, pred, row_number() OVER (PARTITION BY aid1 ORDER BY abs(pred - 0.5) DESC, ord) - 1 AS i, CAST(ceil(count(*) OVER (PARTITION BY aid1) / 4) AS BIGINT) AS b FROM p),
y AS (SELECT aid1, pid, pred, i // b AS r, CASE WHEN (i // b) % 2 = 0 THEN i % b ELSE b - 1 - i % b END AS batch_id FROM x),
z AS (SELECT *, count(*) OVER (PARTITION BY aid1, batch_id) AS m FROM y)
SELECT aid1, pid, pred, CAST(batch_id AS INT) AS batch_id, CAST(CASE WHEN r < ceil(m / 2) THEN 2 * r ELSE 2 * (m - 1 - r) + 1 END AS INT) AS pos FROM z""")
def second_pass_examples(spark, d):
    """Test examples with prior scores, which some targets lack, dealt again by confidence to batches of another size."""
    s = px.scored(spark, d)
    config = EngineConfig(batching="confidence")
    dealt = pipeline.examples(s.drop("pred"), s.filter("event_type <> 'view'").select("pid", "pred"), "test", config, num_turn=4)
    return dealt.select("aid1", "pid", "pred", "batch_id", "pos")


@query(f"WITH x AS (SELECT CAST(conv_id AS VARCHAR) AS request_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, text FROM conversations) SELECT request_id, pos, {fixed('request_id')} AS no, {fixed('text')} AS yes FROM x")
def position_scores(spark, d):
    """A pair of logits for each target of a context."""
    x = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return scorer.call_positions(x.select("request_id", F.col("request_id").alias("context"), F.col("t.text").alias("targets")))


# ---- sources: JSON as the readers get it, a value for each profile, paper or group

@query(f"WITH {INNER} SELECT 'in' AS source, 'raw' AS variant, aid, ord, pid FROM inn")
def scan_flat_profiles(spark, d):
    texts = profiles.lists(px.assignments(spark, d, "O")).select(F.to_json(F.create_map("aid", "pids")).alias("value"))
    return readers.parse_flat(texts, "in").drop("name")


@query(f"WITH {OUTER} SELECT 'S' || aid AS name, 'out' AS source, 'clean' AS variant, aid, ord, pid FROM outr")
def scan_named_profiles(spark, d):
    texts = profiles.lists(px.assignments(spark, d, "F")).select(F.to_json(F.create_map(F.concat(F.lit("S"), "aid"), F.create_map("aid", "pids"))).alias("value"))
    return readers.parse_named(texts, "out", "clean").drop("name_ord")


@query("SELECT CAST(p_partkey AS VARCHAR) AS pid, p_name AS title, p_brand AS author, CAST(CASE WHEN p_size > 10 THEN p_size END AS INT) AS year, string_split(p_type, ' ')[1] AS keyword FROM part")
def scan_papers(spark, d):
    p = _part_papers(spark, d)
    texts = p.select(F.to_json(F.create_map("pid", F.struct(*[c for c in p.columns if c != "pid"]))).alias("value"))
    return readers.parse_papers(texts).select("pid", "title", F.get("authors", F.lit(0))["name"].alias("author"), "year", F.get("keywords", F.lit(0)).alias("keyword"))


@query("""SELECT CAST(user_id AS VARCHAR) AS aid1, CAST(event_id AS VARCHAR) AS pid, CAST(event_type <> 'error' AS INT) AS label, value AS similarity,
CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS ord FROM events""")
def scan_triples(spark, d):
    e = table(spark, d, "events").select("event_id", F.struct("event_id", F.col("user_id").alias("aid1"), F.col("event_id").alias("pid"), (F.col("event_type") != "error").cast("int").alias("label"), F.col("value").alias("similarity")).alias("t"), "user_id")
    texts = e.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list("t"))).alias("value"))
    return readers.parse_triples(texts).select("aid1", "pid", "label", "similarity", "ord")


@query("SELECT CAST(event_id AS VARCHAR) AS pid, value / 500 AS pred FROM events")
def scan_prior_scores(spark, d):
    """Each score is given twice; the later one counts."""
    one = lambda pred: F.struct(F.col("event_id").alias("pid"), pred.alias("pred"))
    texts = table(spark, d, "events").select(F.to_json(F.array(one(F.lit(0.0)), one(F.col("value") / 500))).alias("value"))
    return readers.parse_prior(texts)


# ---- prompts of the other steps, and what they are made of

_STYLED = _RENDERED.rpartition(" || chr(10) || 'Keywords: '")


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS pid, {_STYLED[0]} || 'Keywords: ' {_STYLED[2]} AS text FROM part")
def render_paper_distill(spark, d):
    return render.rendered(_part_papers(spark, d), style=render.Style("distill"))


_MANY = """many AS (SELECT CAST(l_partkey AS VARCHAR) AS pid, list('S' || l_suppkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS a, list(n_name ORDER BY l_orderkey, l_linenumber, l_suppkey) AS o
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)"""


def _capped(x: str) -> str:
    return f"CASE WHEN len({x}) > 10 THEN list_concat({x}[1:8], {x}[-2:]) ELSE {x} END"


def _distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, k: list_position({x}, v) = k)"


def _many_authors(spark, d):
    """Papers with an author for each row of lineitem, numbered, some of them more than once."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    none = F.lit(None).cast("string")
    number = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey"))
    rows = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("n", number)
    author = F.struct(F.concat(F.lit("S"), "l_suppkey").alias("name"), F.col("n_name").alias("org"), none.alias("OriginalAuthor"), none.alias("OriginalAffiliation"), F.col("n").alias("AuthorSequenceNumber"))
    return rows.groupBy(F.col("l_partkey").cast("string").alias("pid")).agg(F.collect_list(author).alias("authors")).withColumns({c: none for c in ("title", "venue")} | {"year": F.lit(None).cast("int"), "keywords": F.lit(None).cast("array<string>")})


@query(f"WITH {_MANY}, x AS (SELECT pid, {_capped('a')} AS a, {_capped('o')} AS o FROM many) SELECT pid, 'Authors: ' || array_to_string(a, ', ') || chr(10) || 'Organizations: ' || array_to_string({_distinct('o')}, ', ') || chr(10) AS text FROM x")
def render_many_authors(spark, d):
    return render.rendered(_many_authors(spark, d), ("author", "organization"))


@query(f"""WITH {_MANY}, x AS (SELECT pid, len(a) AS n, {_capped('a')} AS a, {_distinct('o')} AS o FROM many)
SELECT pid, 'Authors: ' || array_to_string({_distinct('a')}, ', ') || chr(10) || 'Organizations: ' || array_to_string(CASE WHEN n > 10 THEN {_capped('o')} ELSE o END, ', ') || chr(10) AS text FROM x""")
def render_many_authors_model(spark, d):
    return render.rendered(_many_authors(spark, d), ("author", "organization"), render.Style("model"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS pid, 'Title: ' || p_name || chr(10) || 'Organizations: ' || p_type || chr(10) AS text FROM part")
def render_paper_features(spark, d):
    return render.rendered(_part_papers(spark, d), ("title", "organization"), render.Style("model"))


@query(f"""WITH {INNER}, s AS (SELECT aid, list('A' || pid ORDER BY (CAST(pid AS INT) * 7919) % 1000, ord) AS a FROM inn GROUP BY aid)
SELECT aid, array_to_string(CASE WHEN len(a) > 10 THEN list_concat(a[1:8], a[-2:]) ELSE a END, ', ') AS authors FROM s""")
def authors_by_sequence(spark, d):
    """Authors in order of their sequence number, the middle of a long list left out."""
    none = F.lit(None).cast("string")
    number = ((F.col("pid").cast("long") * 7919) % 1000).cast("int").alias("AuthorSequenceNumber")  # an int holds the product of ids up to 271,181 only
    author = F.struct(none.alias("name"), none.alias("org"), F.concat(F.lit("A"), "pid").alias("OriginalAuthor"), none.alias("OriginalAffiliation"), number)
    x = px.assignments(spark, d, "O").groupBy("aid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", author.alias("a")))), lambda e: e["a"]).alias("authors"))
    return x.select("aid", F.array_join(render.names(render.authors_in_order(F.col("authors"))), ", ").alias("authors"))


@query(f"""WITH {INNER}, {_PAPERS}, {_picked("i", "inn", 100)}, {_dealt("dealt", "inn", 10)}
SELECT aid, batch_id, 'Name: ' || aid || chr(10) || 'Profile: ' || array_to_string(t, '; ') || chr(10) || 'Targets: ' || array_to_string({_NUMBERED}, '; ') AS prompt FROM dealt JOIN i USING (aid)""")
def prompt_one_source(spark, d):
    both = _batches(spark, d, 10).join(_sampled(spark, d, "O", 100), "aid")
    return both.select("aid", "batch_id", render.prompt_one_source(F.col("aid"), F.col("t"), F.col("b")).alias("prompt"))


@query(f"""WITH {INNER}, {_PAPERS}, {_picked("i", "inn", 40)}, {_dealt("dealt", "inn", 10)}
SELECT aid, batch_id, 'Collection:' || chr(10) || array_to_string(t, chr(10)) || chr(10) || 'Targets:' || chr(10) || array_to_string({_NUMBERED}, chr(10)) AS prompt FROM dealt JOIN i USING (aid)""")
def prompt_clean(spark, d):
    both = _batches(spark, d, 10).join(_sampled(spark, d, "O", 40), "aid")
    return both.select("aid", "batch_id", render.prompt_clean(F.col("t"), F.col("b")).alias("prompt"))


@query(f"""WITH {INNER}, {_PAPERS}, {_dealt("dealt", "inn", 20)},
one AS (SELECT aid, batch_id, 'Batch ' || batch_id || ', ' || len(b) || ' items' || chr(10) || array_to_string(list_transform(b, lambda x, k: CAST(k - 1 AS VARCHAR) || ': ' || x || ' | ' || printf('%.2f', s[k])), chr(10)) AS t FROM dealt)
SELECT aid, string_agg(t, chr(10) ORDER BY batch_id) AS prompt FROM one GROUP BY aid""")
def prompt_batches(spark, d):
    """All batches of a profile together, with their scores."""
    items = F.transform(F.arrays_zip("b", "s"), lambda x: F.struct(x["b"].alias("text"), x["s"].alias("score")))
    all_ = _batches(spark, d, 20).groupBy("aid").agg(F.array_sort(F.collect_list(F.struct(F.col("batch_id").alias("batch_idx"), items.alias("items")))).alias("all"))
    return all_.select("aid", render.prompt_batches(F.col("all")).alias("prompt"))


@query(f"WITH {INNER}, {_PAPERS}, {_picked('i', 'inn', 100)} SELECT aid, 'Judge each item.' || chr(10) || 'Profile of ' || aid || chr(10) || array_to_string(t, chr(10)) AS prompt FROM i")
def prompt_flat(spark, d):
    return _sampled(spark, d, "O", 100).select("aid", render.flat(F.lit("Judge each item."), F.concat(F.lit("Profile of "), "aid"), F.col("t")).alias("prompt"))


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:32], ' ') AS text, CAST(len(string_split(text, ' ')[1:32]) AS INT) AS n FROM documents")
def truncate_tokens(spark, d):
    cut = table(spark, d, "documents").select("doc_id", text.first_tokens(F.split("text", " "), 32).alias("t"))
    return cut.select("doc_id", F.array_join("t", " ").alias("text"), F.size("t").alias("n"))


@query(f"WITH {INNER} SELECT aid, string_agg(pid, '-' ORDER BY pid) AS key FROM inn GROUP BY aid")
def canonical_key(spark, d):
    return profiles.lists(px.assignments(spark, d, "O")).select("aid", text.canonical(F.col("pids")).alias("key"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN props END AS found FROM events")
def any_json_value(spark, d):
    said = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("so:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("it is "), "props", F.lit("."))).otherwise(F.lit("none"))
    return table(spark, d, "events").select("event_id", replies.any_json(said).alias("found"))


# ---- predictions, reducers, examples

@query("""SELECT user_id, pos, pid, pred, label FROM (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS pos, event_id AS pid, value / 500 AS pred, CAST(event_type <> 'error' AS INT) AS label FROM events)""")
def zip_predictions(spark, d):
    """Predictions, labels and ids of a batch, kept as three lists, back as rows by their place."""
    x = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") / 500).alias("pred"), (F.col("event_type") != "error").cast("int").alias("label")))).alias("x"))
    lists = x.select("user_id", F.col("x.event_id").alias("pids"), F.col("x.pred").alias("preds"), F.col("x.label").alias("labels"))
    return lists.select("user_id", F.posexplode(F.arrays_zip("pids", "preds", "labels")).alias("pos", "z")).select("user_id", "pos", F.col("z.pids").alias("pid"), F.col("z.preds").alias("pred"), F.col("z.labels").alias("label"))


@query(f"WITH {_LOGITS} SELECT round(avg(-ln(CASE label WHEN 1 THEN p WHEN 0 THEN 1 - p END)), 6) AS ce, count(*) AS n FROM probs WHERE vec_id % 3 > 0")
def masked_ce_loss(spark, d):
    """Rows without a label take no part."""
    x = _logits(spark, d).withColumn("label", F.when(F.col("vec_id") % 3 > 0, F.col("label")))
    loss = objective.cross_entropy(F.col("p"), F.col("label"))
    return x.agg(F.round(F.avg(loss), 6).alias("ce"), F.count("label").alias("n"))


@query("SELECT count(*) AS n_pairs, sum(n)::BIGINT AS n_papers FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def pair_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_papers"))


@query(f"WITH {SCORED} SELECT pid, CASE WHEN event_type = 'click' THEN pred ELSE 0.25 END AS soft_label FROM scored")
def refined_soft_labels(spark, d):
    s = px.scored(spark, d).select("aid1", F.lit("o").alias("aid2"), "pid", "pred", "event_type", F.lit(0.25).alias("soft_label"))
    refined = s.filter("event_type = 'click'").select("aid1", "aid2", "pid", F.col("pred").alias("new_pred"))
    return labels.soft_labels(s, refined).select("pid", "soft_label")


@query(f"""WITH {INNER}, {_PAPERS}, v AS (SELECT DISTINCT aid, pid, p_size / 50 AS s FROM inn JOIN papers USING (pid) WHERE p_size > 10)
SELECT aid, ord, pid, 'clean' AS variant FROM inn LEFT JOIN v USING (aid, pid) WHERE coalesce(s >= 0.5, true)""")
def voted_clean_profiles(spark, d):
    a = px.assignments(spark, d, "O")
    votes = a.join(_papers(spark, d).filter("p_size > 10"), "pid").select("aid", "pid", (F.col("p_size") / 50).alias("score"))
    return labels.clean_profiles(a, votes).select("aid", "ord", "pid", "variant")


@query(f"""WITH {SCORED}, s AS (SELECT aid1, pid, ord, label AS ori_label, CAST(1 - pred >= 0.9 AS INT) AS label FROM scored),
k AS (SELECT greatest(1, CAST(floor(count(*) FILTER (label = 1) / nullif(count(*) FILTER (label = 0), 0)) AS BIGINT)) AS k FROM s),
c AS (SELECT *, unnest(range(1, CASE WHEN label = 0 THEN coalesce(k, 1) ELSE 1 END + 1)) AS copy FROM s, k),
x AS (SELECT *, row_number() OVER (PARTITION BY aid1 ORDER BY md5(concat('42-', aid1, '-', pid, '-', copy)), ord) - 1 AS i FROM c)
SELECT aid1, pid, copy, ori_label, label, CAST(i // 10 AS INT) AS batch_id, CAST(i % 10 AS INT) AS pos FROM x""")
def training_examples(spark, d):
    t = px.scored(spark, d).select("aid1", "pid", "ord", "label", (1 - F.col("pred")).alias("soft_label"))
    return pipeline.examples(t).select("aid1", "pid", "copy", "ori_label", "label", "batch_id", "pos")


@query(f"""WITH {SCORED}, s AS (SELECT aid1, pid, ord, CAST(1 - pred >= 0.9 AS INT) AS label FROM scored),
k AS (SELECT greatest(1, CAST(floor(count(*) FILTER (label = 1) / nullif(count(*) FILTER (label = 0), 0)) AS BIGINT)) AS k FROM s),
c AS (SELECT *, unnest(range(1, CASE WHEN label = 0 THEN coalesce(k, 1) ELSE 1 END + 1)) AS copy FROM s, k)
SELECT aid1, pid, copy, label, row_number() OVER (ORDER BY md5(concat('42-', aid1, '-', pid, '-', copy)), aid1, pid, copy, ord) - 1 AS batch_id, 0 AS pos FROM c""")
def shuffled_examples(spark, d):
    """With one target a batch, the whole set, copies and all, is put in one order."""
    t = px.scored(spark, d).select("aid1", "pid", "ord", "label", (1 - F.col("pred")).alias("soft_label"))
    return pipeline.examples(t, num_turn=1).select("aid1", "pid", "copy", "label", "batch_id", "pos")


@query("""WITH x AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, doc_id FROM x WHERE before < 40000 - 500 - length(source)""")
def budgeted_profile(spark, d):
    docs = table(spark, d, "documents").filter("source is not null").select("source", F.col("doc_id").alias("ord"), F.col("n_chars").alias("length"))
    used = docs.select("source").distinct().withColumn("used", F.char_length("source"))
    return pipeline.budgeted(docs, used, ["source"], 40000).select("source", F.col("ord").alias("doc_id"))


_TEXTS = f"texts AS (SELECT CAST(p_partkey AS VARCHAR) AS pid, {_RENDERED} AS text FROM part)"


def _own_targets(spark, d):
    return px.assignments(spark, d, "O").select(F.lit(None).cast("string").alias("name"), F.col("aid").alias("aid1"), F.col("aid").alias("aid2"), "pid", "ord", F.lit(None).cast("double").alias("similarity"), F.lit(0.25).alias("author_sim"))


@query(f"""WITH {INNER}, {_TEXTS}, f AS (SELECT aid, pid, min(ord) AS ord FROM inn GROUP BY aid, pid),
x AS (SELECT aid, pid, row_number() OVER (PARTITION BY aid ORDER BY md5(concat('42-', aid, '-', aid, '-', pid)), ord) - 1 AS i FROM f),
y AS (SELECT aid, pid, i // 20 AS b, i % 20 AS pos, count(*) OVER (PARTITION BY aid, i // 20) AS m FROM x),
z AS (SELECT aid, pid, b, pos, {fixed("pos || ': ' || CASE WHEN pos = m - 1 THEN rtrim(text, chr(10)) ELSE text END")} AS old FROM y JOIN texts USING (pid))
SELECT aid AS aid1, aid AS aid2, 'unknown' AS name, pid, CAST(b AS INT) AS batch_idx, old AS old_pred, {fixed("pos || ': ' || pid || ' | ' || printf('%.2f', old)")} AS new_pred FROM z""")
def distilled_scores(spark, d):
    """The whole of label distillation with stubs for scorers: prompts, replies, batches of a pair scored again together."""
    own = px.assignments(spark, d, "O")
    requests = pipeline.requests(_own_targets(spark, d), own, px.assignments(spark, d, "F"), _part_papers(spark, d))
    return pipeline.distill(requests, second=scorer.stub_batches)


@query(f"""WITH {INNER}, {_AIDS}, m AS (SELECT *, count(*) OVER (PARTITION BY aid) AS n FROM inn JOIN aids USING (aid)),
x AS (SELECT aid, pid, row_number() OVER (PARTITION BY aid ORDER BY md5(concat('42-', aid, '-', pid)), ord) - 1 AS i FROM m WHERE n > 5),
v AS (SELECT aid, pid, round(avg({fixed("(i % 10) || ': Title: ' || p_name")}), 9) AS s FROM x JOIN part ON pid = CAST(p_partkey AS VARCHAR) GROUP BY aid, pid)
SELECT aid, ord, pid, 'clean' AS variant FROM inn LEFT JOIN v USING (aid, pid) WHERE coalesce(s >= 0.5, true)""")
def self_clean(spark, d):
    """The whole of profile cleaning with a stub for a scorer: profiles that targets name, large enough, judged in batches; papers voted out go."""
    named = px.assignments(spark, d, "O").withColumn("name", F.concat(F.lit("S"), "aid"))
    targets = _aids(spark, d).select(F.concat(F.lit("S"), "aid").alias("name"), F.col("aid").alias("aid1"))
    requests = pipeline.clean_requests(targets, "aid1", named, _part_papers(spark, d))
    return pipeline.clean(requests, named).select("aid", "ord", "pid", "variant")


# ---- sinks, written and read back

def _done(spark, d):
    """Replies to some of the requests, one type of them empty."""
    e = table(spark, d, "events").filter("event_type <> 'view'")
    return e.select(F.col("event_id").cast("string").alias("request_id"), F.when(F.col("event_type") == "click", F.col("props")).otherwise("").alias("content"), F.lit("").alias("reasoning"), F.lit(1).alias("attempts"))


@query(f"WITH {SCORED} SELECT 'n' AS name, aid1, event_type AS aid2, pid, 0 AS batch_idx, pred AS old_pred, 1 - pred AS new_pred FROM scored")
def dumped_scores(spark, d):
    at = storage.table_path(spark, "scores")
    s = px.scored(spark, d)
    sinks.dump_scores(s.select((1 - F.col("pred")).alias("new_pred"), F.col("pred").alias("old_pred"), F.lit("n").alias("name"), F.lit(0).alias("batch_idx"), "aid1", F.col("event_type").alias("aid2"), "pid", "ord"), at)
    return spark.read.parquet(at)


@query(f"WITH {SCORED} SELECT 0 AS version, pid, pred FROM scored UNION ALL SELECT 1 AS version, pid, 1 - pred AS pred FROM scored")
def versioned_predictions(spark, d):
    """Two dumps below one path; the second doesn't touch the first."""
    at = storage.table_path(spark, "versions")
    s = px.scored(spark, d).select("pid", "pred")
    numbers = [sinks.dump_version(x, at) for x in (s, s.withColumn("pred", 1 - F.col("pred")))]
    both = [spark.read.parquet(f"{at}/version={n}").select(F.lit(n).alias("version"), "pid", "pred") for n in numbers]
    return both[0].union(both[1])


@query("SELECT CAST(event_id AS VARCHAR) AS request_id, event_type <> 'click' AS empty, (SELECT count(*) FROM events WHERE event_type <> 'view') AS completed FROM events WHERE event_type <> 'view'")
def unfinished_replies(spark, d):
    """A snapshot, named by the number of its rows, read back and split."""
    at = storage.table_path(spark, "snapshot")
    n = sinks.snapshot(_done(spark, d), at)
    empty, full = scorer.unfinished(resume.completed(spark, f"{at}/completed={n}"))
    return empty.select("request_id", F.lit(True).alias("empty")).union(full.select("request_id", F.lit(False))).withColumn("completed", F.lit(n).cast("long"))


@query(f"""WITH x AS (SELECT CAST(event_id AS VARCHAR) AS request_id, event_type, unnest([0, 1]) AS pos, unnest([event_type, trim(props)]) AS t FROM events)
SELECT request_id, CAST(pos AS INT) AS pos, CASE WHEN event_type = 'click' THEN 2.0::DOUBLE ELSE {fixed('t')} END AS score FROM x""")
def resumed_scores(spark, d):
    """Some replies are there from a run before; the others are scored, in parts that are saved one by one; then the progress goes, and the replies stay."""
    progress, out = storage.table_path(spark, "progress"), storage.table_path(spark, "replies")
    kept = _done(spark, d).filter("content <> ''").withColumn("content", F.lit('{"0": 2, "1": 2}'))
    resume.save(kept, progress, 3)
    done = resume.run_pending(_requests(spark, d), progress, scorer.call)
    sinks.dump(done, out)
    sinks.remove(spark, progress)
    left = resume.completed(spark, progress)
    return left.unionByName(spark.read.parquet(out)).select("request_id", F.posexplode(replies.in_order(replies.scores(F.col("content")))).alias("pos", "score"))


@query("""SELECT mode, CAST(user_id AS VARCHAR) AS aid1, CAST(event_id AS VARCHAR) AS pid FROM events
JOIN (VALUES ('train', 'click'), ('eval', 'view'), ('test', 'error'), ('other', 'error')) m(mode, kind) ON event_type = kind""")
def triples_by_mode(spark, d):
    """Each mode has a file; any mode without one reads that of the tests."""
    paths = {}
    for mode, kind in (("train", "click"), ("eval", "view"), ("test", "error")):
        paths[mode] = storage.table_path(spark, mode)
        t = table(spark, d, "events").filter(F.col("event_type") == kind).select(F.struct(F.col("user_id").alias("aid1"), F.col("event_id").alias("pid")).alias("t"))
        values = t.groupBy(F.pmod("t.pid", F.lit(4))).agg(F.to_json(F.collect_list("t")).alias("value")).select("value")
        values.write.option("maxRecordsPerFile", 1).text(paths[mode])
    out = [readers.triples_for(spark, mode, paths).select(F.lit(mode).alias("mode"), "aid1", "pid") for mode in ("train", "eval", "test", "other")]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query(f"""WITH {SCORED} SELECT prefix, count(*) AS n, round(avg(pred), 6) AS mean FROM scored, (VALUES ('test'), ('final')) p(prefix) GROUP BY prefix""")
def metrics_log(spark, d):
    """Rows of three evaluations, of which that during training is left out."""
    at = storage.table_path(spark, "metrics")
    row = px.scored(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("pred"), 6).alias("mean"))
    for prefix in ("test", "eval", "final"):
        sinks.log_metrics(row, at, prefix)
    return spark.read.schema("prefix string, n long, mean double").json(at)


@query(f"""WITH {_LOGITS}, t AS (SELECT -ln(CASE WHEN label = 1 THEN p ELSE 1 - p END) AS c, CASE WHEN sim > 0.5 THEN least(p_out + sim - p - 1, 0) ELSE least(greatest(p_out, 1 - p_out) - sim + p - 1, 0) END AS s FROM probs),
m AS (SELECT avg(c) AS c, avg(s) AS s FROM t)
SELECT 'ce' AS kind, round(c, 6) AS loss FROM m UNION ALL SELECT 'psl', round(0.25 * s + 0.75 * c, 6) FROM m UNION ALL SELECT 'psl without an outer score', round(c, 6) FROM m""")
def loss_by_kind(spark, d):
    x = _logits(spark, d)
    kinds = {"ce": objective.loss(x), "psl": objective.loss(x, "psl", alpha=0.25), "psl without an outer score": objective.loss(x.withColumn("p_out", F.lit(None).cast("double")), "psl")}
    out = [loss.select(F.lit(k).alias("kind"), *r6("loss")) for k, loss in kinds.items()]
    return out[0].union(out[1]).union(out[2])


@query("SELECT CAST(event_id AS VARCHAR) AS aid1, 'a,b' AS pids, value AS author_sim, event_type AS prompt, CASE WHEN event_type = 'error' THEN '' ELSE props END AS content FROM events")
def scan_scored_requests(spark, d):
    """Requests with replies, as an earlier step has written them."""
    e = table(spark, d, "events")
    one = F.struct(F.col("event_id").alias("aid1"), F.array(F.lit("a"), F.lit("b")).alias("pids"), F.col("value").alias("author_sim"), F.col("event_type").alias("inputs"), F.when(F.col("event_type") == "error", "").otherwise(F.col("props")).alias("content"))
    return readers.parse_scored(e.select(F.to_json(F.array(one)).alias("value"))).select("aid1", F.array_join("pids", ",").alias("pids"), "author_sim", "prompt", "content")


# ---- large files

@query(f"WITH {INNER} SELECT 'in' AS source, 'raw' AS variant, aid, ord, pid FROM inn")
def scan_split_profiles(spark, d):
    """Maps of many profiles in files, each one JSON value, read by the entry."""
    at, files = storage.table_path(spark, "maps"), 8
    lists = profiles.lists(px.assignments(spark, d, "O")).withColumn("file", F.pmod(F.xxhash64("aid"), F.lit(files)).cast("int"))
    w = Window.partitionBy("file").orderBy("aid")
    lists = lists.withColumns({"nth": F.row_number().over(w), "last": F.lead("aid").over(w).isNull()})
    text = F.concat(F.when(F.col("nth") == 1, "{").otherwise(","), F.lit('"'), "aid", F.lit('": '), F.to_json("pids"), F.when(F.col("last"), "}").otherwise(""))
    lists.repartitionById(files, F.col("file")).sortWithinPartitions("nth").select(text.alias("value")).write.option("lineSep", " ").text(at)
    return readers.flat_profiles(spark, at, "in").drop("name")


# ---- scores at label places, heads, means, stopping

@query("""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT vec_id, CAST(i AS INT) AS place, CASE WHEN i > 0 THEN round(1 / (1 + exp(e[i] - e[len(e) - i + 1])), 6) END AS p FROM t WHERE CAST(floor(abs(e[i + 1]) * 50) AS INT) % 5 = 3""")
def label_positions(spark, d):
    """Several label tokens a row, some at its first place."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    ids = F.transform("e", lambda x: (F.floor(F.abs(x) * 50) % 5).cast("int"))
    return e.select("vec_id", F.explode(vectors.label_scores(ids, F.col("e"), F.reverse("e"), 3)).alias("s")).select("vec_id", "s.place", F.round("s.p", 6).alias("p"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT vec_id, list_dot_product(e, (SELECT e FROM e WHERE vec_id = 0)) AS no, list_dot_product(e, (SELECT e FROM e WHERE vec_id = 1)) AS yes FROM e)
SELECT vec_id, round(no, 6) AS no, round(yes, 6) AS yes, round(1 / (1 + exp(no - yes)), 6) AS p, CAST(yes > no AS INT) AS predicted FROM l""")
def head_projection(spark, d):
    """A binary head of two rows, and the scores it gives."""
    e = table(spark, d, "embeddings")
    x = vectors.projected(e, e.filter("vec_id < 2").withColumnRenamed("vec_id", "row"), ["no", "yes"])
    return x.select("vec_id", *r6("no", "yes"), F.round(objective.p_yes(F.col("no"), F.col("yes")), 6).alias("p"), objective.argmax(F.col("no"), F.col("yes")).alias("predicted"))


@query("""WITH x AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings)
SELECT label, CAST(pos AS INT) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM x GROUP BY 1, 2""")
def mean_embeddings(spark, d):
    m = vectors.mean_vectors(table(spark, d, "embeddings"), ["label"])
    return m.select("label", F.posexplode("embedding").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("mean"))


@query("""WITH x AS (SELECT unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings), m AS (SELECT pos, CAST(avg(CAST(v AS DOUBLE)) AS FLOAT) AS v FROM x GROUP BY 1),
n AS (SELECT DISTINCT -1 - label AS vec_id FROM embeddings)
SELECT vec_id, CAST(pos AS INT) AS pos, round(CAST(v AS DOUBLE), 4) + 0.0 AS v FROM n, m UNION ALL SELECT vec_id, CAST(pos AS INT), round(CAST(v AS DOUBLE), 4) + 0.0 FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings)""")
def new_token_vectors(spark, d):
    """New tokens get the mean of all vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    new = e.select((-1 - F.col("label")).cast("long").alias("vec_id")).distinct()
    out = vectors.with_new_rows(e.drop("label"), new)
    return out.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", (F.round(F.col("v").cast("double"), 4) + 0.0).alias("v"))


@query("""WITH l AS (SELECT event_type AS run, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step, floor(avg(value) / 20) AS metric FROM events GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER w AS n, coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM l WINDOW w AS (PARTITION BY run ORDER BY step)),
c AS (SELECT *, n - max(CASE WHEN better THEN n END) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS waited FROM b),
s AS (SELECT *, min(CASE WHEN waited >= 3 THEN n END) OVER (PARTITION BY run) AS stop FROM c)
SELECT run, CAST(step AS INT) AS step, CAST(metric AS BIGINT) AS metric, better, CAST(waited AS INT) AS waited, n = max(CASE WHEN better THEN n END) OVER (PARTITION BY run) AS is_best, coalesce(n = stop, false) AS stopped
FROM s WHERE stop IS NULL OR n <= stop""")
def early_stopping(spark, d):
    """Metrics by day, many of them equal, of a run for each type of event."""
    log = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("step")).agg(F.floor(F.avg("value") / 20).alias("metric"))
    return metrics.stopping(log, ["run"], "step", "metric").select("run", "step", "metric", "better", "waited", "is_best", "stopped")


# ---- lengths in tokens

_TOKENS = f"list_transform(regexp_extract_all(coalesce(text, ''), '{lengths.PIECES}', 0), lambda p: regexp_extract_all(p, '(?s).{{1,4}}', 0))"


@query(f"SELECT doc_id, CAST(len(flatten({_TOKENS})) AS BIGINT) AS n_tokens FROM documents")
def token_lengths(spark, d):
    return lengths.token_lengths(table(spark, d, "documents"), ["doc_id"])


@query(f"WITH x AS (SELECT doc_id, flatten({_TOKENS})[1:33] AS t FROM documents) SELECT doc_id, array_to_string(t, '') AS text, CAST(len(t) AS INT) AS n_tokens FROM x")
def truncated_texts(spark, d):
    """The first 33 tokens of each text; the cut may fall within a piece."""
    return lengths.first_tokens(table(spark, d, "documents"), ["doc_id"], 33)


@query(f"""WITH n AS (SELECT source, doc_id, CAST(len(flatten({_TOKENS})) AS BIGINT) AS n FROM documents WHERE source IS NOT NULL),
x AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT source, doc_id, n AS length FROM x WHERE before < 20000 - 500 - length(source)""")
def token_budgeted_profile(spark, d):
    """A profile's items while their tokens have room beside what is used."""
    docs = table(spark, d, "documents").filter("source is not null").select("source", F.col("doc_id").alias("ord"), "text")
    used = docs.select("source").distinct().withColumn("used", F.char_length("source"))
    long = lengths.token_lengths(docs, ["source", "ord"], out="length")
    return pipeline.budgeted(long, used, ["source"], 20000).select("source", F.col("ord").alias("doc_id"), "length")


# ---- evaluation, calls, names

@query(f"""WITH scored AS (SELECT CAST(user_id AS VARCHAR) AS aid1, 1 / (1 + exp(0 - (value - 100) / 50)) AS pred, CAST(event_type <> 'error' AS INT) AS label FROM events), {_AUTHORS}
SELECT 'final' AS prefix, round(avg(ap), 6) AS "MAP", round(avg(auc), 6) AS "AUC", round(avg(auc) + avg(ap), 6) AS "AUC_MAP", count(*) AS n_authors,
(SELECT round(avg(CAST(CAST(pred >= 0.5 AS INT) = label AS INT)), 6) FROM scored) AS accuracy, (SELECT count(*) FROM scored) AS n, 1 AS version, 2 * (SELECT count(*) FROM scored) AS dumped FROM authors""")
def evaluation_run(spark, d):
    """Logits to scores, predictions dumped, metrics logged; the evaluation during training is dumped, but not logged."""
    log, dumps = storage.table_path(spark, "log"), storage.table_path(spark, "predictions")
    e = table(spark, d, "events")
    logits = e.select(F.col("user_id").cast("string").alias("aid1"), F.col("event_id").alias("pid"), (F.col("event_type") != "error").cast("int").alias("label"), F.lit(0.0).alias("no"), ((F.col("value") - 100) / 50).alias("yes"))
    for prefix in ("eval", "final"):
        pipeline.evaluation(logits, prefix, log, dumps)
    rows = spark.read.schema('prefix string, MAP double, AUC double, AUC_MAP double, n_authors long, accuracy double, n long, version int').json(log)
    dumped = spark.read.parquet(dumps).agg(F.count("*")).scalar()
    return rows.select("prefix", *r6("MAP", "AUC", "AUC_MAP"), "n_authors", *r6("accuracy"), "n", "version", dumped.alias("dumped"))


@query("""SELECT 'eval' AS prefix, event_id AS pid, 0.0::DOUBLE AS no, value / 50 AS yes FROM events UNION ALL SELECT 'final', event_id, 0.0::DOUBLE, (value - 100) / 50 FROM events""")
def raw_buffers(spark, d):
    """Logits as evaluations have seen them; a second evaluation during training takes the place of the first."""
    log, dumps, buffers = (storage.table_path(spark, n) for n in ("log", "predictions", "buffers"))
    e = table(spark, d, "events")
    base = e.select(F.col("user_id").cast("string").alias("aid1"), F.col("event_id").alias("pid"), (F.col("event_type") != "error").cast("int").alias("label"), F.lit(0.0).alias("no"), "value")
    for prefix, yes in (("eval", F.col("value")), ("eval", F.col("value") / 50), ("final", (F.col("value") - 100) / 50)):
        pipeline.evaluation(base.withColumn("yes", yes).drop("value"), prefix, log, dumps, buffers)
    return spark.read.parquet(buffers).select("prefix", "pid", "no", "yes")


_KIND = "(CAST(('0x' || substr(md5('Targets: ' || event_type || '; ' || props), 1, 2)) AS INT) % 101) % 3"


@query(f"SELECT CAST(event_id AS VARCHAR) AS request_id, CAST(CASE WHEN {_KIND} = 2 THEN 1 ELSE 3 END AS INT) AS attempts, {_KIND} < 2 AS empty FROM events")
def failed_calls(spark, d):
    """Calls that fail or say nothing are tried three times, and end as empty replies."""
    return scorer.call(_requests(spark, d), scorer.sometimes, attempts=3).select("request_id", "attempts", (F.col("content") == "").alias("empty"))


@query("""SELECT event_id, '{"model":"judge-1","messages":[{"role":"system","content":"Judge each item."},{"role":"user","content":' || CAST(to_json('Targets: ' || event_type || '; ' || props) AS VARCHAR) || '}],"temperature":0.0}' AS body FROM events""")
def chat_payloads(spark, d):
    r = _requests(spark, d)
    return r.select(F.col("request_id").cast("long").alias("event_id"), scorer.payload("judge-1", F.col("prompt"), "Judge each item.").alias("body"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'in' ELSE 'out' END AS source, concat(o_custkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE '_' || o_orderstatus END) AS name FROM orders""")
def output_names(spark, d):
    """Sources of files, and the names of what is made of them, as their paths tell."""
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "in").otherwise("out")
    path = F.concat(F.lit("/data/name_aid_to_pids_"), kind, F.lit(".v2/"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderstatus") == "P", ".raw.json/").otherwise(F.concat(F.lit("_"), "o_orderstatus", F.lit(".json"))))
    return o.select("o_orderkey", readers.sources_of(path).alias("source"), sinks.save_names(path).alias("name"))
