import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from lodestrata.llm import importance, language, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language_of_held_out_documents(docs):
    out = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and length(text) > 100").collect()
    assert len(out) > 50
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(edges, doubled, empty):
    out = {r["doc_id"]: r for r in language.identify(edges).collect()}
    texts = {r["doc_id"]: r["text"] for r in edges.select("doc_id", "text").collect()}
    assert len(out) == len(texts)
    for k, t in texts.items():
        assert (out[k]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    assert language.identify(doubled).count() == doubled.count()
    assert language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_filters_have_no_false_negatives(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma", "en"), (2, "delta epsilon", "gr")], "doc_id long, text string, lang string")
    filters = language.train(rows)
    for k, text in enumerate(("alpha beta gamma", "delta epsilon")):
        code, _ = language.grams(pa.array([text]))
        assert ((filters.masks(code)[:, 0] >> np.uint64(k)) & np.uint64(1)).all()


def test_resample_is_the_top_k(docs, labels, edges, doubled, empty):
    rows = importance.resampled(docs, labels).collect()
    k = sum(r["kept"] for r in rows)
    order = sorted(rows, key=lambda r: (-r["priority"], r["doc_id"]))
    assert 0 < k < len(rows) and all(r["kept"] for r in order[:k])
    some = labels.limit(0)
    for d in (edges, doubled, empty):
        assert importance.resampled(d, labels).count() == d.count()
        assert importance.resampled(d, some).where("not kept").count() == 0


def test_largest_with_ties(spark):
    rows = spark.createDataFrame([(k, float(k % 7)) for k in range(6000)], "doc_id long, s double")
    kept = {r["doc_id"] for r in importance.keep_largest(rows, "s", 1000).where("kept").collect()}
    assert kept == {k for k, _ in sorted(((k, k % 7) for k in range(6000)), key=lambda x: (-x[1], x[0]))[:1000]}


def test_good_texts_weigh_more(docs, labels):
    out = importance.resampled(docs, labels).join(labels.where("quality is not null"), "doc_id").groupBy("quality").agg(F.avg("log_weight").alias("w")).collect()
    means = {r["quality"]: r["w"] for r in out}
    assert means[1] > means[0]


def test_automaton_is_the_edit_distance():
    rng = random.Random(3)
    terms = [b"moron", b"stupidest", b"idiot", b"abcd", b"idi*"]
    automaton = toxicity.Automaton(sorted(terms))
    words = list(terms[:4]) + [b"idi", b"idiomatic", b"zzz", b"idi" + b"x" * 200, b"zidi" + b"x" * 200]
    for t in terms[:4]:
        for _ in range(150):
            w = bytearray(t)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    w[at:at] = bytes([rng.randrange(97, 123)])
                elif at < len(w):
                    w[at : at + 1] = b"" if kind == 1 else bytes([rng.randrange(97, 123)])
            words.append(bytes(w) or b"x")
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    size = np.array([len(w) for w in words])
    end = np.cumsum(size + 1) - 1
    found = dict(zip(*(x.tolist() for x in automaton.match(data, end - size, end)[:1] + automaton.match(data, end - size, end)[2:])))
    for k, w in enumerate(words):
        near = [brute.distance(w, t) for t in terms[:4] if brute.distance(w, t) <= toxicity.edits_allowed(t)] + [0] * w.startswith(b"idi")
        assert found.get(k) == (min(near) if near else None), w


def test_quotation_weakens():
    a = toxicity.Automaton([b"idiot"])
    plain, quoted = ([f for *_, f in toxicity.hits(pa.array([t]), a)] for t in ("You are an idiot today", 'They wrote "you are an idiot today" to us'))
    assert plain == [1.0] and quoted[0] < 0.5


def test_toxic_held_out_documents(docs, labels):
    out = toxicity.detect(docs, labels).join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] and r["toxic"] for r in out)
    # about a third of the labels mark texts without any abuse in them
    assert right / max(1, sum(r["toxic"] for r in out)) >= 0.6
    assert right / max(1, sum(r["predicted"] for r in out)) >= 0.8


def test_toxicity_edges(spark, docs, labels, edges, doubled, empty):
    for d in (edges, doubled, empty):
        out = toxicity.detect(d, labels).collect()
        assert len(out) == d.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert all(r["score"] == 0 for r in toxicity.detect(docs, labels.limit(0)).collect())


def test_training_keeps_unlike_texts_and_folds_copies(spark):
    """Short words only, one long word in all, and copies but for case and white space."""
    rows = [(k, f"a vile odd row {chr(97 + k % 26)}{k // 26} " + "common" * (k % 2), 1) for k in range(60)]
    rows += [(100 + k, f"a fine row {chr(97 + k % 26)}{k // 26} " + "common" * (k % 2), 0) for k in range(180)]
    rows += [(300 + k, ("one same text" if k % 2 else "One  SAME text\n"), 1) for k in range(40)]
    texts = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert b"vile" in toxicity.lexicon(toxicity._families(texts.join(labels, "doc_id")))
    copies = texts.join(labels, "doc_id").where("doc_id >= 300")
    assert toxicity._families(copies).select("family").distinct().count() == 1


def plain_score(text, model):
    """Words by their Unicode classes, edit distances cell by cell, context word by word."""
    low = (text or "").lower()
    found = [m.span() for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", low)]
    told, total = {}, 0.0
    for k, (a, b) in enumerate(found):
        word, best = low[a:b].encode(), None
        for t, term in enumerate(model.automaton.terms):
            d = 0 if term.endswith(b"*") and word.startswith(term[:-1]) else 99 if term.endswith(b"*") else swapped_distance(word, term) if abs(len(word) - len(term)) < 3 else 99
            if d <= toxicity.edits_allowed(term) and (best is None or (d, t) < best):
                best = d, t
        if best is None:
            continue
        first, last = max(k - toxicity.WINDOW, 0), min(k + toxicity.WINDOW, len(found) - 1)
        before, after = low[found[first - 1][1] if first else 0 : a], low[b : found[last + 1][0] if last + 1 < len(found) else len(low)]
        opened = 0
        for c in before:
            opened = 1 if c in "“«„" else 0 if c in "”»" else opened ^ (c == '"')
        factor = toxicity.QUOTED if opened and any(c in '”»"' for c in after) else 1.0
        if factor == 1.0 and {low[x:y].encode() for x, y in found[max(k - 4, 0) : k]} & toxicity.REPORTING and any(c in before[-3:] for c in "“«„\"'"):
            factor = toxicity.REPORTED
        total -= np.log(1 - factor * model.forms.get(word, model.unseen.get((best[1], best[0]), 0.5)))
        told[best[1]] = max(told.get(best[1], 0), factor * model.telling.get(word, model.telling_unseen.get((best[1], best[0]), 0.0)))
    steps = [y for x, y in zip(model.steps, model.scores) if x <= total + 1e-12]
    return max(steps[-1] if steps else model.scores[0], 1 - (1 - model.base) * np.prod([1 - x for x in told.values()]))


def swapped_distance(a, b):
    """Edit distance in which two neighbours that changed places are one edit."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_swapped_letters_are_one_edit():
    rng = random.Random(4)
    terms = [b"idiot", b"pathetic", b"abcde", b"worthless", b"aabba"]
    automaton = toxicity.Automaton(sorted(terms))
    words = [*terms, b"idoit", b"diiot", b"idito", b"pathetc", b"ptahetic", b"wrothlses", b"owrthless", b"worthlessxx"]
    words += [bytes(rng.choice(b"abcdeiot") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    for w in list(words):
        k = rng.randrange(len(w))
        words.append(w[:k] + bytes([rng.choice(b"abidot")]) + w[k + rng.randint(0, 1) :])
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    found, term, distance = automaton.match(data, end - [len(w) for w in words], end)
    got = {int(w): (int(d), int(t)) for w, t, d in zip(found, term, distance)}
    for k, w in enumerate(words):
        near = [(swapped_distance(w, t), j) for j, t in enumerate(automaton.terms) if swapped_distance(w, t) <= toxicity.edits_allowed(t)]
        assert got.get(k) == min(near, default=None), w


def test_scores_are_the_plain_ones(spark, docs, labels):
    model = toxicity.train(docs, labels)
    texts = [None, "", "You idiot, you i-d-i-o-t and idoit", 'She said "what an idiot" of him', "scum/trash and STUPID", "said 'idiot' then", "a moron " * 30, "“pathetic” loser", "Ünïcode idiöt idiot’s", "idiot—moron", "«idiot»", "idiot…", "you，idiot", "idiot\xa0now", "नमस्ते idiot", "“idiot” said he, “what a moron", "idiot_moron"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.where("doc_id between 100 and 160").select("doc_id", "text"))
    known = {r["doc_id"]: r["text"] for r in rows.collect()}
    out = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert set(out) == set(known) and len({round(x, 6) for x in out.values()}) > 1
    for k, t in known.items():
        assert out[k] == pytest.approx(plain_score(t, model), abs=1e-9), t


def test_abuse_is_told_from_quotation_and_found_misspelled(spark, docs, labels):
    model = toxicity.train(docs, labels.where(toxicity.fold(4) != 2))
    texts = ["nothing here", "you are an idiot", "you are an “idiot”, they wrote", 'he wrote "you are an idiot" there', "you are an idoit and so pathetc", "you are an idiott", "you idiot—you", "you，idiot，you", "idiot… now", "an idiot\xa0now", "«you idiot» he wrote"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = [r["score"] for r in toxicity.score(rows, model).orderBy("doc_id").collect()]
    for k in (1, 4, 5, 6, 7, 8, 9):
        assert score[k] >= toxicity.THRESHOLD, texts[k]
    for k in (2, 3, 10):
        assert score[0] < score[k] < toxicity.THRESHOLD, texts[k]
    assert score[1] > score[5] > score[0]


def test_steps_rise_and_fit(spark):
    model = toxicity.Model(toxicity.Automaton([]), {}, {})
    model.fit(np.array([0, 0, 0, 1, 1, 2, 3, 3.0]), np.array([0, 0, 1, 0, 0, 1, 1, 1.0]))
    assert model.steps.tolist() == [0, 2] and (np.diff(model.scores) > 0).all()
    assert model.score(np.array([0, 1.5, 2, 9]), np.zeros(4)).tolist() == [model.scores[0]] * 2 + [model.scores[1]] * 2


def test_scores_do_not_depend_on_partitions(docs, labels):
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.detect(d, m).collect()} for d, m in ((docs, labels), (docs.repartition(7, "text"), labels.repartition(3))))
    assert one == two


def test_log_weights_are_the_plain_ones(spark):
    good, raw = ["good texts talk like this", "and so on, like this one"], ["bad zzz qqq", "xx", "", None]
    rows = list(enumerate(good + raw))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "doc_id long, quality int")

    def counts(texts):
        out = Counter()
        for t in texts:
            b = (t or "").encode()
            for k in range(len(b) - 2):
                out[((b[k] | b[k + 1] << 8 | b[k + 2] << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 17] += 1
        return out

    t, r, m = counts(good), counts(x for _, x in rows), importance.BUCKETS
    total = {n: sum(c.values()) + 0.5 * m for n, c in (("t", t), ("r", r))}
    ratio = lambda g: np.log((t[g] + 0.5) / total["t"]) - np.log((r[g] + 0.5) / total["r"])
    out = {x["doc_id"]: x["log_weight"] for x in importance.resampled(docs, labels).collect()}
    for k, text in rows:
        grams = list(counts([text]).elements())
        assert out[k] == pytest.approx(importance.REFERENCE * np.mean([ratio(g) for g in grams]) if grams else 0.0)


def test_language_is_the_plain_one(spark, docs):
    """The filters' answers one gram and one language at a time."""
    filters = language.train(docs.select("doc_id", "text", "lang"))
    rows = docs.where("doc_id % 25 = 0").select("doc_id", "text")
    out = {r["doc_id"]: r for r in language.predict(rows, filters).collect()}
    for r in rows.collect():
        low = " " + "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower()) + " "
        codes = [sum(ord(c) << 21 * (2 - k) for k, c in enumerate(low[j : j + 3])) for j in range(len(low) - 2) if low[j + 1] != " "]
        count = [0.0] * len(filters.languages)
        for code in codes:
            slots = [filters.slots[int(language.slot(np.array([code]), k)[0])] for k in range(language.HASHES)]
            for n in range(len(count)):
                count[n] += all(int(s[n // 64]) >> n % 64 & 1 for s in slots)
        right = [max(0.0, (c - len(codes) * p) / (1 - p)) for c, p in zip(count, filters.false_positive)]
        got = out[r["doc_id"]]
        if codes:
            assert got["lang_pred"] == filters.languages[int(np.argmax(right))]
            assert got["score"] == pytest.approx(min(1.0, max(right) / len(codes)))


def test_rare_languages_and_other_scripts(spark):
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(4))
    rows = [(k, " ".join(word("abcdefgh") for _ in range(20)), "common") for k in range(3000)]
    rows += [(5000 + k, " ".join(word("日本語漢字仮名文書") for _ in range(20)), "rare") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.identify(docs).join(docs, "doc_id").where("held_out and lang = 'rare'").collect()
    assert out and all(r["lang_pred"] == "rare" for r in out)


def test_no_share_of_a_sample_is_none():
    for n in (1, 24_000, 10**8, 7 * 10**9, 10**15):
        assert language.cells(24_000 / 256 / n) > 0
    assert language.cells(2.0) == language.CELLS
    # about as many rows as are wanted, whatever the table's size
    assert language.cells(24_000 / 7e9) / language.CELLS * 7e9 == pytest.approx(24_000)
