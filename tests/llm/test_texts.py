"""Decontamination, licence scans, HTML text, toxicity, token ids, token counts and packing against brute force or round trips."""

import hashlib
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crossweave.llm import decontamination, fm_index, html_text, huffman, license_scan, packing, token_counts, token_ids, tokens, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_suffix_order_and_search():
    rnd = random.Random(3)
    for _ in range(30):
        runs = [[rnd.randint(1, 3) for _ in range(rnd.randint(1, 40))] for _ in range(rnd.randint(1, 6))]
        ids = np.array([x for r in runs for x in r])
        starts = np.cumsum([0, *map(len, runs)])[:-1]
        index = fm_index.FMIndex(ids, starts, 3)
        pattern = np.array([[rnd.randint(1, 3) for _ in range(4)] for _ in range(5)])
        got = {i: [] for i in range(5)}
        for w, lo, hi in zip(*index.ranges(pattern), strict=True):
            got[int(w)] = sorted(index.locate(np.arange(lo, hi)).tolist())
        ends = [*starts.tolist()[1:], len(ids)]
        for k in range(5):
            want = [i for a, b in zip(starts.tolist(), ends, strict=True) for i in range(a, b - 3) if ids[i : i + 4].tolist() == pattern[k].tolist()]
            assert got[k] == want


def brute_decontaminate(docs, items):
    grams = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(name)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (10, "short ITEM!"), (3, ""), (4, None), (None, "lone words here"), (5, "a " * 12)]
DOCS = [
    (1, "zero one two three four five six seven eight nine ten eleven twelve thirteen"), (2, None), (3, ""), (4, "x short-item y Short\nItem"), (5, "a " * 50),
    (6, "two three four five six seven eight nine ten"), (7, "w " * 20000 + "lone words here"), (1, "again one two three four five six seven eight nine ten"), (None, "short item"),
    (8, "one two three four five short item six seven eight nine ten eleven twelve"), (9, "lone words, here"),
]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(d, t, "h", 1) for d, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, hits string, n_chars int"), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("most", [1 << 20, 5])
def test_decontamination(spark, small, most):
    docs, items = small
    got = decontamination.find(docs, items, most=most).collect()
    got = [(r.doc_id, r.hits.n_words, sum(s.stop - s.start for s in r.hits.spans), len(r.hits["items"]), hashlib.sha256(",".join(r.hits["items"]).encode()).hexdigest(), bool(r.hits.spans)) for r in got]
    assert sorted(got, key=str) == brute_decontaminate(DOCS, [("" if i is None else str(i), t) for i, t in ITEMS])


def test_decontamination_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = [tuple(r) for r in decontamination.op1_decontamination(spark, SF).collect()]
    want = brute_decontaminate(docs, items)
    assert sorted(got, key=str) == want and any(r[5] for r in want)


def test_removed_spans_leave_nothing(small):
    docs, items = small
    out = decontamination.remove_spans(docs, items)
    assert out.columns == docs.columns
    rows = out.collect()
    left = {r.doc_id for r in rows}
    assert 5 not in left and 9 not in left and {2, 3, 6} <= left  # wholly benchmark; empty before
    named = [("" if i is None else str(i), t) for i, t in ITEMS]
    assert not any(r[5] for r in brute_decontaminate([(r.doc_id, r.text) for r in rows], named))
    by = {(r.doc_id, r.text) for r in rows}
    assert (6, DOCS[5][1]) in by and (1, "zero\nthirteen") in by and (8, "") not in by


def test_licence_base_matches_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(9001, "CC-BY cc by CC, by."), (9002, None), (9003, "the GNU General Public License. All rights reserved; all rights RESERVED"), (9003, ""), (None, "cc by")], "doc_id long, text string"))
    got = {}
    for r in license_scan.scan_licenses(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    for r in df.collect():
        w, places = words(r.text), []
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        at = [i for i, _ in places]
        assert (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))) in got[r.doc_id]


def test_licence_templates():
    auto = license_scan.Automaton()
    labels = lambda t: {s[0] for s in license_scan.scan(t.encode(), auto)["spans"]}
    assert labels("x Licensed under the Apache License, Version 2.0.") == {"apache-2.0"}
    assert "mit" in labels("Released under the MIT License.")
    assert "gpl-3.0" in labels("This work is licensed under the GNU General Public License, version 3.")
    assert "cc-by-nc-4.0" in labels("Licensed under CC BY-NC 4.0.")
    assert labels("the terms of use under which and or the") == set()


def test_licence_chains_close_gaps_and_trim_overlaps():
    auto = license_scan.Automaton()
    rnd = random.Random(3)
    spans = lambda ws: license_scan.scan(" ".join(ws).encode(), auto)["spans"]
    grant = "permission is hereby granted free of charge to any to any person obtaining a copy a copy of this software and associated documentation files to deal in the software without restriction"
    assert [(s[0], s[3]) for s in spans(grant.split())] == [("mit", 1.0)]
    for label, text in license_scan.TEMPLATES:
        template = text.replace("-", " ").replace(".", " ").split()
        for _ in range(5):
            said, i = ["before"] * 6, 0
            while i < len(template):  # runs of two words and more, a few strange words or a repeated one between them
                n = rnd.randint(2, 5) if len(template) - i > 6 else len(template) - i
                said += template[i : i + n] + rnd.choice([[], ["strange"] * rnd.randint(1, 3), template[i + n - 1 : i + n]])
                i += n
            found = [s for s in spans([*said, *["after"] * 6]) if s[0] == label]
            assert any(s[1] >= 6 and s[2] <= len(said) and s[3] == 1.0 for s in found), (label, said)
            assert not [s for s in spans(template[: len(template) // 2]) if s[0] == label and s[3] == 1.0]
    began = time.process_time()
    license_scan.scan(b"licensed under the x y z w v u " * 30_000, auto)
    assert time.process_time() - began < 12


LICENCES_TOLD_APART = {
    "licensed under the GNU Free Documentation License, version 3": set(), "the Eclipse Public License version 2.0": {"epl-2.0"}, "under the Mozilla Public License version 2": set(),
    "Licensed under the GNU Library General Public License version 2.": {"lgpl-2.0"}, "under the GNU General Public License version 1": set(), "CC BY-ND 4.0": {"cc-by-nd-4.0"},
    "Creative Commons Attribution-ShareAlike 4.0 International": {"cc-by-sa-4.0"}, "under a Creative Commons attribution-noncommercial 4.0 license": {"cc-by-nc-4.0"},
    "licensed under CC BY 4.0": {"cc-by-4.0"}, "Licensed under CC BY-NC-SA 3.0": {"cc-by-nc-sa-3.0"}, "SPDX-License-Identifier: Apache-2.0": {"apache-2.0"}, "SPDX-License-Identifier: GPL-3.0-or-later": {"gpl-or-later"},
    "Licensed under the GNU Lesser General Public License version 2.1": {"lgpl-2.1"}, "the GNU Affero General Public License, version 3": {"agpl-3.0"},
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"mpl-2.0"}, "covered by the Mozilla Public License, v. 2.0.": {"mpl-2.0"},
    "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": {"lgpl-or-later"},
}


def test_licences_are_told_apart():
    auto = license_scan.Automaton()
    for text, want in LICENCES_TOLD_APART.items():
        for around in ("{}", "see here {} and more of it"):
            assert {s[0] for s in license_scan.scan(around.format(text).encode(), auto)["spans"]} == want, text


def test_licence_spans_match_brute_force():
    """Every whole template in a text is a span, or a better one overlaps it; what a span covers stands in it in the template's order, with its names and numbers."""
    rnd = random.Random(9)
    for _ in range(150):
        templates = [(f"{rnd.choice('pqr')}-{i}", " ".join(rnd.choice("abcdef1") for _ in range(rnd.randint(2, 7)))) for i in range(5)]
        auto = license_scan.Automaton((), templates)
        text = [w for _ in range(8) for w in [*rnd.choice(templates)[1].split()[: rnd.randint(1, 7)], *rnd.choice(["", "x", "x y", "a"]).split()]]
        spans = license_scan.scan(" ".join(text).encode(), auto)["spans"]
        whole = [(label, i, i + len(t)) for label, t in ((a, b.split()) for a, b in templates) for i in range(len(text)) if text[i : i + len(t)] == t]
        for label, a, b in whole:
            assert (label, a, b, 1.0) in spans or any(o[0] != label and o[1] < b and a < o[2] and o[3] == 1.0 and len(dict(templates)[o[0]].split()) > b - a for o in spans)
        for label, a, b, share in spans:
            assert share == 1.0  # short templates are covered whole
            rest = iter(text[a:b])
            assert all(w in rest for w in dict(templates)[label].split())


def test_matching_statistics_match_brute_force():
    rnd = random.Random(2)
    for _ in range(20):
        templates = [("t", " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8)))) for _ in range(4)]
        auto = license_scan.Automaton((), templates)
        subs = {tuple(x.split()[i:j]) for _, x in templates for i in range(9) for j in range(i + 1, 9)}
        text = [rnd.choice("abcd") for _ in range(60)]
        ids = [auto.alphabet.get(w.encode(), 0) for w in text]
        got = [n for _, n in auto.stream(ids)]
        assert got == [max((k for k in range(0, i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in subs)) for i in range(60)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header class=top><a href=/>Home</a></header>
<nav><ul><li><a href="/a">One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div><aside>Side text that is long enough to look like a paragraph</aside>
<article><header><h1>Title &amp; more</h1></header><p><b>First  para
graph &lt;x&gt;<br>next line<p>Is.</p><p>See <a href=x>this link</a>.</p><form><input>Your mail</form><script>no()</script><!-- no --><section class="comments"><p>I disagree</p></section></article>
<footer>&copy; site</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst para graph <x> next line\nIs.\nSee this link."
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<script>x")
    assert html_text.main_text("<p>" + "w " * 30 + "<p>5 < 6 and a<b") .startswith("w w")
    assert html_text.main_text("<div>" * 3000 + "word " * 40) == ("word " * 40).strip()
    flat = "<body><ul><li><a>a</a><li><a>b</a></ul><div>" + "real words of an article here " * 8 + "</div><div><a>x</a> | <a>y</a></div>"
    assert html_text.main_text(flat) == ("real words of an article here " * 8).strip()


def test_pages_query(spark):
    rows = html_text.op4_html_text(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        want = re.sub(r"\s+", " ", html_text.unescape(re.sub(r"<[^>]*>", " ", body))).strip()
        assert re.sub(r"\s+", " ", r.text) == want and r.n_chars == len(r.text)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op5_toxicity(spark, d).collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    rows = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.doc_id in got]
    held = [(r.predicted, t) for r, t in rows if r.held_out]
    tp, fp, fn = sum(p and t for p, t in held), sum(p and not t for p, t in held), sum(t and not p for p, t in held)
    assert tp / (tp + fn) > 0.85 and tp / (tp + fp) > 0.9
    for r, _ in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)


def test_toxicity_grammar():
    rows = [(b"the cat sat. you are a gronk indeed", 1), (b"what a gronk he is", 1), (b"gronkish words", 1), (b"a gronk said so much", 1), (b"total gronkery here", 1), (b"gronks all of you", 1), (b"my gronk", 1)] + [(b"plain text %d about cats" % i, 0) for i in range(60)]
    g = toxicity.learn(rows)
    assert g.insult(b"gronkette") > 0 and g.insult(b"cat") == 0
    you, plain, no, said = (g.clause(c.split())[0] for c in (b"you gronk", b"big gronk", b"not a gronk", b"said gronk"))
    assert you > plain > no and plain > said
    assert g.score(b"you gronk") > 0.3 > g.score(b"plain words") and g.score(b"") == g.score(b"nothing")
    assert toxicity.learn([]).score(b"x") < 0.3
    assert toxicity.learn([(b"one two", 1), (b"", 1), (b"three", 1)]).score(b"four") <= 0.1 + 1e-9


def brute_clause(g, found):
    """The rules of a clause, word by word."""
    target, report, no = (any(w in kind for w in found) for kind in (toxicity.TARGET, toxicity.REPORT, toxicity.NEGATION))
    total, matches, negated = 0.0, 0, False
    for i, w in enumerate(found):
        harmed = [j for j, x in enumerate(found) if x in toxicity.HARMED and j <= i]
        harm = [j for j, x in enumerate(found) if x in toxicity.HARM | toxicity.OWN_HARM and j <= i and any(y in toxicity.SPEAKER | toxicity.OWN_HARM for y in found[: j + 1])]
        weight = g.insult(w) if not (i and found[i - 1] == b"the" and not any(x in toxicity.BEING for x in found[:i])) else 0.0
        if not weight and not no:
            weight = g.threat * float((i in harm and any(i - j <= toxicity.HARM_REACH for j in harmed)) or (i in harmed and any(i - j <= toxicity.HARM_REACH for j in harm)))
        if weight:
            near = any(x in toxicity.NEGATION for x in found[max(0, i - toxicity.NEGATION_REACH) : i + 1])
            total, matches, negated = total + weight * (0.5 if near else 1.0), matches + 1, negated or near
    return total * (1.25 if target else 1.0) * (0.6 if report else 1.0), matches, target and matches > 0, negated, report and matches > 0


def test_composed_transducers_match_the_rules():
    g = toxicity.Grammar(stems={b"gron": 2.0, b"ki": 1.5}, whole={b"zed": 3.0, b"you": 0.7}, threat=1.75)
    rnd = random.Random(8)
    pool = [b"gronk", b"kill", b"zed", b"you", b"hurt", b"not", b"said", b"they", b"i", b"the", b"is", b"him", b"b", b"c", b"d"]
    for _ in range(6000):
        found = rnd.choices(pool, weights=[1, 1, 1, 1, 2, 0.5, 0.5, 0.5, 1, 1, 0.5, 1, 2, 2, 2], k=rnd.randint(1, 12))
        got, want = g.clause(found), brute_clause(g, found)
        assert abs(got[0] - want[0]) < 1e-9 and got[1:] == want[1:], found
    both = toxicity.NEGATIONS.compose(toxicity.TARGETS)
    assert len(both.step) == len(toxicity.NEGATIONS.step) * len(toxicity.TARGETS.step)
    sizes = [len(t.step) for t in (toxicity.INSULTS, toxicity.THREATS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS)]
    assert len(toxicity.CLAUSE.step) == sizes[0] * sizes[1] * sizes[2] * sizes[3] * sizes[4]


INNOCENT = (
    "An idiom is a fixed phrase.", "In Morocco, she studied sculpture.", "El trastorno se produjo tras el trasero.", "He took out the trash.", "The film was shot in their town.",
    "the storm will destroy their homes", "They killed time.", "Ich töte dich nicht", "I will not hurt you",
)
THREATS = ("I will kill you", "I have beaten you", "I'll bomb your house", "I'll cut your throat", "Ich töte dich", "te voy a matar", "je vais te frapper", "You are trash", '"You are an idiot!" he said.')


def test_words_that_only_begin_like_insults():
    """Learned on a table whose toxic texts hold plain insults, whole words among many that others share."""
    rnd = random.Random(5)
    bad = "idiot moron scum trash stupid pathetic clown".split()
    words = [f"w{i}" for i in range(200)]
    rows = [(" ".join(rnd.choices(words, k=12) + rnd.choices(bad, k=2) + rnd.choices(words, k=6)).encode(), 1) for _ in range(120)]
    rows += [(" ".join(rnd.choices(words, k=20)).encode(), 0) for _ in range(600)]
    g = toxicity.learn(rows)
    assert {w.decode() for w in g.whole} == set(bad)
    assert not g.stems  # each would be one word's
    for text in INNOCENT:
        assert g.score(text.encode()) < 0.3, text
    for text in THREATS:
        assert g.score(text.encode()) >= 0.3, text


def test_a_stem_stands_for_several_words():
    hits = {b"gron": 20, b"gronk": 9, b"gronk$": 9, b"grons": 11, b"grons$": 5, b"idio": 12, b"idiot": 12, b"idiot$": 11}
    g = toxicity.insults(hits, {}, 40, 400)
    assert set(g.stems) == {b"gron"}
    assert set(g.whole) == {b"gronk", b"grons", b"idiot"}


def test_a_quotation_belongs_to_who_says_it():
    parts = [p.strip() for p in toxicity._CLAUSE.split('"You fool!" he said. Next; “Go away!” she said! Yes?'.encode()) if p.strip()]
    assert [p.decode() for p in parts] == ['"You fool!" he said', "Next", "“Go away!” she said", "Yes"]


def test_spelling_inflection_and_reported_speech():
    g = toxicity.Grammar(stems={b"idiot": 3.0})
    score = lambda t: g.features(t.encode())[0]
    for text in ("Ich werde dich töten", "ich werde dich toten", "I killed him", "I am killing you", "je vais te détruire", "te mataré"):
        assert score(text) > 0, text
    assert score("you can't be an idiot") < score("you must be an idiot")
    assert score('He said: "you are an idiot"') < score("you are an idiot")


def test_training_equals_learning_in_memory(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").filter(~toxicity.held_out()).filter("toxic is not null").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    want, got = toxicity.learn([((r.text or "").encode(), r.toxic) for r in rows]), toxicity.train(docs, labels)
    assert want.whole == got.whole and want.stems == got.stems and np.allclose(want.weights, got.weights, atol=1e-6)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "x " * 30000, 5), (None, "x", 5), (1, None, 5)], "doc_id long, text string, score int")
    g = toxicity.train(docs, spark.createDataFrame([(1, 1), (9, 0), (None, 1), (2, None)], "doc_id long, toxic int"))
    assert toxicity.score(docs, g).count() == 5
    assert {r.h for r in docs.select(toxicity.held_out().alias("h")).collect()} <= {True, False}
    assert toxicity.drop_toxic(docs, g).columns == docs.columns


TEXTS = ["", "Hello world. Don't stop, it's fine... a.b,c 12,5 x", "naïve café ÉCOLE, straße.  nb", "<|endoftext|> <|EndOfText|> x", "ΑΣ ΣΑΣ. é.", "a" * 500 + ".", "tab\tand\r\nline \x0b\x0c \x1c x", "漢字 仮名. 🙂🙂, 'Re 're", "w. " * 3000, ". , .. ,. a.", "́a İ."]


def test_word_ids_equal_the_library():
    enc = tokens.WordIds(tokens.default_path())
    for texts in (TEXTS, TEXTS[::-1]):
        for t, got in zip(texts, enc.encode(pa.array(texts)), strict=True):
            assert got.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_word_ids_of_every_letter_and_mark():
    enc = tokens.WordIds(tokens.default_path())
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c))[0] in "LMN"]
    for i in range(0, len(marks), 10_000):
        texts = [f"{c}." for c in marks[i : i + 10_000]] + [f"a{c}'s, é{c}!" for c in marks[i : i + 10_000]] + ["হয়,"]
        want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in enc.encode(pa.array(texts))] == want
        assert enc.lengths(pa.array(texts)).tolist() == [*map(len, want)]


def test_ids_dont_depend_on_the_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 300)
    monkeypatch.setattr(tokens, "BYTES", 40)
    test_word_ids_equal_the_library()


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 1 << 20)
    enc, rnd = tokens.WordIds(tokens.default_path()), random.Random(3)
    for _ in range(12):  # texts without white space, far more of them than the cache holds
        texts = ["".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(20_000)) for _ in range(6)]
        for t, got in zip(texts, enc.encode(pa.array(texts)), strict=True):
            assert got.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert enc.bytes <= (1 << 20) + 6 * 20_000 * 12 and sum(map(len, enc.place)) * 2 <= enc.bytes + 200


def test_a_full_cache_is_looked_up_at_once():
    enc = tokens.WordIds(tokens.default_path())
    enc.encode(pa.array([" ".join(f"{i:x}" for i in range(200_000))]))
    a = time.perf_counter()
    enc.look_up(pa.array(["1f", "2b"]))
    assert time.perf_counter() - a < 0.005


def test_word_ids_of_documents(spark):
    enc = tokens.WordIds(tokens.default_path())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t, got in zip(texts, enc.encode(pa.array(texts)), strict=True):
        assert got.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_huffman_round_trip_and_length():
    rnd = np.random.default_rng(4)
    for n, top, most in ((0, 5, 4), (1, 5, 4), (5000, 1, 3), (70000, 900, 12), (3 * huffman.BLOCK, 40, 6)):
        ids = np.minimum(rnd.zipf(1.3, n), top) - 1
        counts = np.bincount(ids, minlength=top)
        lengths = huffman.code_lengths(counts, most)
        assert lengths.max(initial=0) <= most and sum(2.0 ** -int(x) for x in lengths if x) <= 1
        bits, starts = huffman.encode(ids, lengths, huffman.canonical(lengths))
        assert huffman.Decoder(lengths).decode(bits, starts, n).tolist() == ids.tolist()
    assert huffman.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32]), 6).tolist() == [6, 6, 5, 4, 3, 2, 1]
    assert max(huffman.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32]), 4)) == 4


def test_token_ids_round_trip(spark):
    df = spark.createDataFrame([(5, "b c", 1), (3, None, 1), (None, "null id", 1), (9, TEXTS[1], 1), (5, "a", 1), (5, "b c", 1), (-4, "x " * 50000, 1)], "doc_id long, text string, part int")
    out = token_ids.table_path(spark, "test")
    token_ids.write_ids(df, out)
    rows = sorted(token_ids.read_ids(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, -4, 3, 5, 5, 5, 9]
    enc, at = tokens.WordIds(tokens.default_path()), 0
    want = {}
    for d, t, _ in df.collect():
        want.setdefault(d, []).append([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and ids in want[r.doc_id]
        at += len(ids)
    none = token_ids.table_path(spark, "test")
    token_ids.write_ids(df.limit(0), none)
    assert token_ids.read_ids(spark, none).count() == 0


def test_token_ids_query(spark):
    enc = tokens.WordIds(tokens.default_path())
    at, want = 0, []
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array([*enc.tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_ids.op9_token_ids(spark, SF).collect())) == want


def test_edits_equal_full_recount():
    enc, rnd = tokens.WordIds(tokens.default_path()), random.Random(8)
    full = lambda t: len(enc.tokenizer.encode(t, add_special_tokens=False).ids)
    for text in [*TEXTS, "  Some words, and more. " * 400, "é \t\n" * 70, " " * 300]:
        (tree,), now = token_counts.build(pa.array([text]), enc, 4), text
        assert tree.tokens == full(text)
        for _ in range(12):
            pos, n, new = rnd.randint(-1, len(now) + 2), rnd.randint(-1, 9), rnd.choice(["", "x", " ", "é.", " two words ", "<|endoftext|>", ".", "many " * 300])
            trees = [token_counts.Tree.from_bytes(tree.to_bytes(), tree.text())]
            token_counts.edit(trees, [[(pos, n, new)]], enc, 4)
            tree = trees[0]
            now = now[: max(0, pos)] + new + now[max(0, pos) + max(0, n) :]
            assert tree.text() == now and tree.sums[1].tolist() == [len(now), full(now)]
    long = token_counts.build(pa.array(["word " * 50000]), enc)
    assert token_counts.edit(long, [[(100000, 3, "zz"), (5, 0, "y")]], enc)[0] < 200


def test_edited_trees_equal_the_single_pass(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None, "a b c " * 100])], "doc_id long, text string")
    kept = token_counts.edit_counts(token_counts.count_trees(docs).withColumn("edits", token_counts.derived_edits()))
    kept = sorted((r.doc_id, r.n_before, r.n_tokens, r.n_recounted) for r in kept.collect())
    once = sorted((r.doc_id, r.n_before, r.n_after, r.n_recounted) for r in token_counts.count_edits(docs, token_counts.derived_edits()).collect())
    assert kept == once


def test_token_count_query(spark):
    enc = tokens.WordIds(tokens.default_path())
    rows = {r.doc_id: r for r in token_counts.op8_token_counts(spark, SF).collect()}
    df = spark.read.parquet(f"{SF}/documents.parquet")
    edits = {r.doc_id: r for r in df.select("doc_id", "text", token_counts.derived_edits(token_counts.whole_text()).alias("e")).collect()}
    for d, r in edits.items():
        now = r.text
        for e in r.e:
            now = now[: e.pos] + e.insert + now[e.pos + e.remove :]
        assert (rows[d].n_before, rows[d].n_after) == tuple(len(enc.tokenizer.encode(t, add_special_tokens=False).ids) for t in (r.text, now))


def test_packing(spark):
    rows = [(i, "x" * (i * 37 % 50000), 0) for i in range(300)] + [(7, None, 0), (7, None, 0), (None, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bin_id int")
    got = packing.pack_documents(df, group=100).collect()
    by, total = {}, {}
    for r in got:
        by.setdefault(r.bin_id, []).append(r)
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    for d in {r[0] for r in rows}:
        assert total[d] == sum(-(-len((t or "").encode()) // 4) + 1 for i, t, _ in rows if i == d)
    for some in by.values():
        at = 0
        for r in sorted(some, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert some[0].bin_length == min(c for c in packing.LENGTHS if c >= at)
    assert sum(r.n_tokens for r in got) / sum(x[0].bin_length for x in by.values()) > 0.9
    assert packing.pack_documents(df.limit(0)).count() == 0
    bins, offsets, lengths = packing.pack([9, 6, 4, 3, 1], (4, 10), lambda c: c)
    assert bins == [0, 1, 1, 2, 2] and lengths == [10, 10, 4] and offsets == [0, 0, 6, 0, 3]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, n_chars long")
    assert decontamination.find(none, items).count() == 0 and decontamination.find(one, items).first().hits.spans == []
    assert decontamination.remove_spans(one, items).count() == 1
    assert license_scan.scan_licenses(none).count() == 0
    assert token_counts.edit_counts(token_counts.count_trees(none).withColumn("edits", token_counts.derived_edits())).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
