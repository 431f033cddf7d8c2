"""Toxicity by a weighted finite-state pattern grammar over clauses.

Transducers read the word classes of a clause: an insult transducer (its arcs are stems and words, with weights learned from labels), a threat, a
target, a negation and a reported-speech transducer (function words). Each is a table of states; they are composed once, by product, into one
transducer that reads a clause in a single pass. A threat is a speaker, then a verb of harm with whom it is to harm right before or behind it: "I will kill you", "je vais te frapper", but not
"the film was shot in their town". A clause weighs more if a target stands in it, less if it reports speech, an insult less shortly behind a negation; a threat with
a negation in its clause counts for nothing, and so does an insult right behind "the" where nothing is said to be it ("he took out the trash"). A clause goes on over
the end of a quotation, so that who said it is part of it. A document's matched clauses give a few
sums, and a logistic function, fitted on the same labelled rows, turns them into a score.

Learning takes at most SAMPLE labelled rows, chosen by a hash of their id among the rows it may learn from (crc32 of the id as text, mod 4, not 2).
Scores see the text only. Null and empty texts have no clause and get the score of a text without a match, MOST_UNMATCHED at most: without a matched
clause nothing is rejected. Labels that are null, or that belong
to no document, are not used; where nothing can be learned, the grammar has no insults of its own and scores 0 or little. Equal texts
have equal scores. An empty table gives an empty result; other columns take no part, and `drop_toxic` keeps them.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.common import binary_text, stored, tidied, words

SAMPLE = 8_000
PARTS = 32  # that the labelled rows are dealt to while learning
THRESHOLD = 0.3
STEM_LENGTHS = tuple(range(3, 12))  # letters
LEAST_DOCS, LEAST_SHARE = 5, 0.9
#: Share of a stem's texts that one whole word of the same letters may have; beyond it the word says all that the stem does.
ONE_WORD = 0.5
MOST_UNMATCHED = 0.1  # score of a text without a match, whatever share of the labels is toxic
MOST_CACHED = 150_000
#: No colon: what is said after one belongs to who says it; nor what ends a quotation.
_CLAUSE = re.compile(rb"[.!?]+(?![.!?]*(?:[\"']|\xe2\x80[\x9c\x9d\x99]|\xc2\xbb))|[;\n|]+")


def fold(word: bytes) -> bytes:
    """A word without accents, so that lists and texts meet however they are spelled."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word.decode(errors="replace").lower()) if not unicodedata.combining(c)).encode()


def _list(text: str) -> frozenset[bytes]:
    return frozenset(fold(w.encode()) for w in text.split())


def _english(verb: str) -> str:
    stem = verb.removesuffix("e")
    return f"{verb} {verb}{'es' if verb.endswith(('sh', 'ch')) else 's'} {stem}ed {stem}ing"


#: Verbs of harm, in four languages; those of the speaker's own form, which need no pronoun; who speaks; whom it is to harm.
HARM = _list(" ".join(map(_english, "kill hurt destroy crush smash burn beat punch murder strangle shoot bomb slaughter torture".split())) + """ stab stabs stabbed stabbing shot hurting beaten cut slit
    töten tötet tötest getötet umbringen umgebracht schlagen geschlagen zerstören zerstört verprügeln erschießen erstechen
    tuer tue frapper frappe détruire détruis égorger
    matar matarte matarlos golpear golpearte destruir destruirte""")
OWN_HARM = _list("töte zerstöre verprügle schlage tuerai frapperai détruirai tuerons mataré mato mataremos matamos golpearé golpeo destruiré destruyo")
SPEAKER = _list("i we ich wir je j nous yo voy vamos gonna")
HARMED = _list("you your yourself him her them his their dich dir dein deine deinen euch ihn te ti vous votre ton tes los les matarte golpearte destruirte matarlos")
TARGET = _list("you your yours u he she they him her them his their people du dich dir ihr euch dein deine er sie tu toi vous te votre ton ta il elle ils vosotros usted ustedes tú él ella ellos su tus")
#: Contractions are cut at their apostrophe: "can't" reads can, t.
NEGATION = _list("not no never nobody cannot without t isn aren wasn weren don doesn didn won wouldn couldn shouldn hasn haven hadn ain nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans ne ni nunca jamás tampoco sin")
REPORT = _list("said says say called calls wrote writes claimed quoted reported told asked shouted sagte sagt nannte schrieb behauptete dit disait écrit appelé dijo dice llamó escribió")
DEFINITE = _list("the")
BEING = _list("is are am was were be being been re s m ist sind bist seid est sont es son eres")
INSULT_, HARM_, TARGET_, NEGATION_, REPORT_, SPEAKER_, HARMED_, DEFINITE_, BEING_ = (1 << i for i in range(9))
#: Classes of words by the list that names them.
LISTS = ((HARM_, HARM | OWN_HARM), (TARGET_, TARGET), (NEGATION_, NEGATION), (REPORT_, REPORT), (SPEAKER_, SPEAKER | OWN_HARM), (HARMED_, HARMED), (DEFINITE_, DEFINITE), (BEING_, BEING))
CLASSES = 1 << 9
HARM_REACH = 3  # words from a verb of harm to whom it harms, or back: "te voy a matar"
NEGATION_REACH = 3
FEATURES = 7


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer over sets of word classes, starting in state 0. It has two tapes, for insults and for threats.

    step: the next state, by state and class; emit: the factor of a word's weight, by state, class and tape; final: the factor of the clause's sum,
    by last state and tape; marks: what a last state tells, as bits.
    """

    step: np.ndarray
    emit: np.ndarray
    final: np.ndarray
    marks: np.ndarray

    def compose(self, other: Transducer) -> Transducer:
        """Both at once: a state for each pair of states, factors multiplied."""
        n, m = len(self.step), len(other.step)
        return Transducer(
            (self.step[:, None] * m + other.step[None]).reshape(n * m, CLASSES),
            (self.emit[:, None] * other.emit[None]).reshape(n * m, CLASSES, 2),
            (self.final[:, None] * other.final[None]).reshape(n * m, 2),
            (self.marks[:, None] | other.marks[None]).reshape(n * m),
        )


def _has(kind: int) -> np.ndarray:
    return np.arange(CLASSES) & kind > 0


def _insults() -> Transducer:
    """Insults, but not right behind "the" unless something was said to be one. States: behind "the" or not, with a word of being before or not."""
    being = np.array([0, 0, 1, 1])[:, None] | _has(BEING_)
    emit = np.where(_has(INSULT_) & ~((np.array([0, 1, 0, 1])[:, None] == 1) & (being == 0)), 1.0, 0.0)
    return Transducer(2 * being + _has(DEFINITE_), np.stack([emit, np.ones_like(emit)], axis=-1), np.ones((4, 2)), np.zeros(4, np.int64))


def _threats() -> Transducer:
    """A speaker, then a verb of harm, with whom it harms no more than HARM_REACH words before or behind it. States: whether a speaker stands before, and how many
    words the last verb and the last harmed one are away, as far as they are in reach."""
    n = HARM_REACH + 1
    step, emit = np.zeros((2 * n * n, CLASSES), np.int64), np.zeros((2 * n * n, CLASSES, 2))
    emit[..., 0] = 1.0
    for speaker in (0, 1):
        for verb in range(n):
            for harmed in range(n):
                for kind in range(CLASSES):
                    now = speaker or bool(kind & SPEAKER_)
                    harms = bool(kind & HARM_) and now
                    whom = bool(kind & HARMED_)
                    at = (speaker * n + verb) * n + harmed
                    emit[at, kind, 1] = float((harms and (harmed > 0 or whom)) or (whom and verb > 0))
                    step[at, kind] = (now * n + (HARM_REACH if harms else max(verb - 1, 0))) * n + (HARM_REACH if whom else max(harmed - 1, 0))
    return Transducer(step, emit, np.ones((2 * n * n, 2)), np.zeros(2 * n * n, np.int64))


def _seen(kind: int, final: tuple[tuple[float, float], tuple[float, float]]) -> Transducer:
    """Whether a word of a kind stands anywhere in the clause. final: factors of the tapes without and with one."""
    return Transducer(np.stack([_has(kind), np.ones(CLASSES, bool)]).astype(np.int64), np.ones((2, CLASSES, 2)), np.array(final), np.array([0, kind]))


def _after(kind: int, reach: int, factor: float) -> Transducer:
    """Words of a kind, and the `reach` words after each, have a factor. States: words still in reach."""
    left = np.arange(reach + 1)[:, None]
    step = np.where(_has(kind), reach, np.maximum(left - 1, 0))
    emit = np.where(_has(kind) | (left > 0), factor, 1.0)
    return Transducer(step, np.stack([emit, emit], axis=-1), np.ones((reach + 1, 2)), np.zeros(reach + 1, np.int64))


INSULTS, THREATS = _insults(), _threats()
TARGETS = _seen(TARGET_, ((1.0, 1.0), (1.25, 1.25)))
NEGATIONS = _after(NEGATION_, NEGATION_REACH, 0.5).compose(_seen(NEGATION_, ((1.0, 1.0), (1.0, 0.0))))
REPORTS = _seen(REPORT_, ((1.0, 1.0), (0.6, 0.6)))
CLAUSE = reduce(Transducer.compose, (INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS))
#: The arcs that texts have used so far, by state and class: the next state and the factors of both tapes.
_ARCS: dict[int, tuple[int, float, float]] = {}


def _arc(state: int, kind: int) -> tuple[int, float, float]:
    at = state * CLASSES + kind
    if at not in _ARCS:
        insult, threat = CLAUSE.emit[state, kind]
        _ARCS[at] = int(CLAUSE.step[state, kind]), float(insult), float(threat)
    return _ARCS[at]


_FINAL = [(float(a), float(b), int(m)) for (a, b), m in zip(CLAUSE.final, CLAUSE.marks, strict=True)]


@dataclass
class Grammar:
    """Word weights of the insult transducer: by stem (prefix) and by whole word; and the document model."""

    stems: dict[bytes, float] = field(default_factory=dict)
    whole: dict[bytes, float] = field(default_factory=dict)
    threat: float = 1.0  # weight of a threat: the median of the insults', as labels say which texts are toxic, but not why
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    cache: dict[bytes, int] = field(default_factory=dict)
    arcs: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "arcs")}

    def __setstate__(self, state):
        self.__dict__.update(state, cache={}, arcs={})

    def insult(self, word: bytes) -> float:
        """Weight of the insult transducer's path for a word, 0 if it has none."""
        if word in self.whole:
            return self.whole[word]
        return next((self.stems[word[:n]] for n in range(min(len(word), 24), 2, -1) if word[:n] in self.stems), 0.0)

    def classes(self, found: list[bytes]) -> np.ndarray:
        """Classes of words, as bits."""
        if len(self.cache) > MOST_CACHED:
            self.cache.clear()
            self.arcs.clear()
        got = np.fromiter(map(self.cache.get, found, repeat(-1)), np.int64, len(found))
        for i in np.flatnonzero(got < 0).tolist():
            w = found[i]
            if w not in self.cache:
                plain = fold(w)
                kind = sum(bit for bit, list_ in LISTS if plain in list_)
                if weight := self.insult(w):
                    self.arcs[w] = weight
                    kind += INSULT_
                self.cache[w] = kind
            got[i] = self.cache[w]
        return got

    def clause(self, found: list[bytes]) -> tuple[float, int, bool, bool, bool]:
        """Weight of a clause's path, matches, and whether it has a target, a negation before a match, or reports speech."""
        state, insults, threats, n_insults, n_threats, near_insult, near_threat = 0, 0.0, 0.0, 0, 0, False, False
        for word, kind in zip(found, self.classes(found).tolist(), strict=True):
            state, insult, threat = _arc(state, kind)
            if insult:
                insults += insult * self.arcs[word]
                n_insults += 1
                near_insult |= insult < 1
            elif threat:
                threats += threat * self.threat
                n_threats += 1
                near_threat |= threat < 1
        by_insult, by_threat, marks = _FINAL[state]
        matches = n_insults + (n_threats if by_threat else 0)
        negated = near_insult or bool(by_threat and near_threat)
        return by_insult * insults + by_threat * threats, matches, bool(marks & TARGET_ and matches), negated, bool(marks & REPORT_ and matches)

    def features(self, text: bytes) -> np.ndarray:
        out = np.zeros(FEATURES)
        ws = words(text)
        if ws and (self.classes(ws) & (INSULT_ | HARM_)).any():
            for part in _CLAUSE.split(text):
                if found := words(part):
                    score, matches, target, negated, report = self.clause(found)
                    if matches:
                        out += (score, 0, matches, target, negated, report, 0)
                        out[1] = max(out[1], score)
            out[6] = out[2] / len(ws)
        return np.array([min(out[0], 30.0) / 10, out[1] / 5, np.log1p(out[2]), np.log1p(out[3]), np.log1p(out[4]), np.log1p(out[5]), min(1.0, 20 * out[6])])

    def score(self, text: bytes) -> float:
        z = float(np.append(self.features(text), 1.0) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sketch(found: list[bytes], n: int = 4) -> list[int]:
    """Smallest checksums of the three-word runs under n permutations: near copies share some, other texts hardly any."""
    runs = set(map(b" ".join, zip(found, found[1:], found[2:], strict=False))) or {b" ".join(found)}
    h = np.fromiter(map(zlib.crc32, runs), np.uint64, len(runs))
    return [int(((h * np.uint64(2 * 7919 * k + 1) + np.uint64(104729 * k)) & np.uint64(0xFFFFFFFF)).min()) for k in range(n)]


def parts(found: set[bytes]) -> set[bytes]:
    """Stems of words, themselves among them, and whole words with an end mark."""
    return {w[:n] for w in found for n in STEM_LENGTHS if n <= len(w)} | {w + b"$" for w in found}


def new_ones(sketches: list[list[int]]) -> list[int]:
    """Places of the texts, by their sketches in order, that are no near copy of an earlier one."""
    out, seen = [], set()
    for i, sketch in enumerate(sketches):
        marks = list(enumerate(sketch))
        if seen.isdisjoint(marks):
            out.append(i)
        seen.update(marks)
    return out


def insults(hits: dict[bytes, int], misses: dict[bytes, int], n_bad: int, n_good: int) -> Grammar:
    """The insult transducer's paths. hits, misses: how many toxic and clean texts have a part, for the parts of LEAST_DOCS toxic texts and more."""
    g = Grammar()
    keep = {}
    for p, n in hits.items():
        if n >= LEAST_SHARE * (n + misses.get(p, 0)):
            keep[p] = float(np.log((n + 0.5) / (misses.get(p, 0) + 0.5)) + np.log((n_good + 1) / (n_bad + 1)))
    #: A stem that always goes on with the same letter, or mostly is the whole word, says no more than what goes on.
    longer = {p[:-1] for p, n in hits.items() if n == hits.get(p[:-1], 0)} | {p[:-1] for p, n in hits.items() if p.endswith(b"$") and n > ONE_WORD * hits.get(p[:-1], 0)}
    for p, weight in keep.items():
        if p.endswith(b"$"):
            g.whole[p[:-1]] = weight
        elif p not in longer and not any(p[:n] in keep and p[:n] not in longer for n in STEM_LENGTHS if n < len(p)):
            g.stems[p] = weight
    if keep:
        g.threat = float(np.median(list(keep.values())))
    return g


def weigh(g: Grammar, x: np.ndarray, y: np.ndarray) -> Grammar:
    """The grammar with its document model fitted to features and labels."""
    g.weights = fit(np.column_stack([x.reshape(-1, FEATURES), np.ones(len(y))]), y)
    g.weights[-1] = min(g.weights[-1], float(np.log(MOST_UNMATCHED / (1 - MOST_UNMATCHED))))
    return g


def learn(rows: list[tuple[bytes, int]]) -> Grammar:
    """A grammar from texts and labels. Near copies among the toxic texts count once, so that their other words don't pass for insults."""
    bad = [found for text, toxic in rows if toxic and (found := words(text))]
    good = [found for text, toxic in rows if not toxic and (found := words(text))]
    bad = [bad[i] for i in new_ones([_sketch(found) for found in bad])]
    hits = Counter(p for found in bad for p in parts(set(found)))
    hits = {p: n for p, n in hits.items() if n >= LEAST_DOCS}
    misses = Counter(p for found in good for p in parts(set(found)) if p in hits)
    g = insults(hits, misses, len(bad), len(good))
    return weigh(g, np.array([g.features(t) for t, _ in rows]), np.array([float(toxic) for _, toxic in rows]))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    if not len(x):
        return w - np.eye(x.shape[1])[-1] * 5
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is never learned from; false for a null id, which no label names."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """A grammar, as by `learn`, from at most `sample` labelled rows: one for each of so many ids, the first by a hash of its text.

    Texts stay on the executors. The driver gets four checksums of each toxic text, the counts of word parts that LEAST_DOCS toxic texts or more
    have, and the FEATURES numbers of each row.
    """
    own = labels.select(F.col("doc_id").alias("k"), F.col("toxic").alias("y")).filter("k is not null and y is not null").filter(~held_out("k"))
    own = own.groupBy("k").agg(F.max("y").alias("y"))
    chosen = own.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col("doc_id").alias("k"), binary_text().alias("t")).join(F.broadcast(chosen), "k")  # at most `sample` pairs of numbers
    rows = rows.groupBy("k").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("r"), F.first("y").alias("y"))
    rows = stored(rows.select("k", F.col("r.t").alias("t"), (F.col("y") > 0).alias("y")).repartition(PARTS, "k"), "labelled")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words(x.as_py()) for x in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), pa.array([_sketch(f) if f and bad else None for f, bad in zip(found, b.column("y").to_pylist(), strict=True)], pa.list_(pa.int64())), pa.array([bool(f) for f in found])], ["k", "y", "sketch", "any"])

    heads = rows.mapInArrow(sketches, "k long, y boolean, sketch array<long>, any boolean").filter("any").orderBy(F.xxhash64("k"), "k").collect()
    bad, n_good = [r for r in heads if r.y], sum(not r.y for r in heads)
    bad = {bad[i].k for i in new_ones([r.sketch for r in bad])}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, misses = Counter(), Counter()
        for b in batches:
            for k, y, t in zip(b.column("k").to_pylist(), b.column("y").to_pylist(), b.column("t"), strict=True):
                if not y or k in bad:
                    (hits if y else misses).update(parts(set(words(t.as_py()))))
        for some, kind in ((hits, 0), (misses, 1)):
            names = list(some)
            for i in range(0, len(names), 10_000):
                now = names[i : i + 10_000]
                n = pa.array([some[p] for p in now], pa.int64())
                zero = pa.array([0] * len(now), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(now, pa.binary()), *((zero, n) if kind else (n, zero))], ["p", "hits", "misses"])

    known = rows.mapInArrow(tidied(counted), "p binary, hits long, misses long").groupBy("p").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    known = known.filter(F.col("hits") >= LEAST_DOCS).collect()
    g = insults({bytes(r.p): r.hits for r in known}, {bytes(r.p): r.misses for r in known}, len(bad), n_good)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([g.features(t.as_py()) for t in b.column("t")], np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["k", "y", "x"])

    rows = sorted(rows.mapInArrow(features, "k long, y boolean, x array<double>").collect(), key=lambda r: r.k)
    return weigh(g, np.array([r.x for r in rows], np.float64), np.array([float(r.y) for r in rows]))


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([grammar.score(x.as_py()) for x in batch.column("body")], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), binary_text(text_col).alias("body")).mapInArrow(tidied(run), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows that score at least `threshold`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([grammar.score((x.as_py() or "").encode()) < threshold for x in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
