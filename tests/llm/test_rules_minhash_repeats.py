import hashlib
import random

import brute
import numpy as np
import pytest

from lodestrata.llm import minhash, repeats, rules, skew
from lodestrata.llm.components import components
from lodestrata.llm.shared import Scratch

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.mark.parametrize("which", ["edges", "sample"])
def test_base_counts(request, which):
    docs = request.getfixturevalue(which)
    texts = texts_of(docs)
    out = rules.judge(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        want = brute.base(texts[r["doc_id"]])
        assert tuple(r[c] for c in BASE) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    line = "subscribe to our letter number {} and follow us on every channel today"
    word = lambda *x: "".join(chr(97 + int(c, 16)) for c in hashlib.md5(repr(x).encode()).hexdigest()[:8])
    body = lambda k: "\n".join(" ".join(word(k, j, i) for i in range(12)) for j in range(4))
    rows = [(k, body(k) + "\n" + line.format(k + 100) + "\n" + body(k + 1000), "a") for k in range(80)]
    rows += [(200 + k, line.format(k + 100) + "\nonly" + str(k), "a") for k in range(5)]
    rows += [(300 + k, body(k + 5000) + "\n" + line.format(k + 100), "b") for k in range(40)] + [(400, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    assert all(kept[k]["kept"] and kept[k]["n_left"] == kept[k]["n_words"] - 13 for k in range(80))
    assert not any(kept[200 + k]["kept"] for k in range(5))
    assert all(kept[300 + k]["kept"] and kept[300 + k]["n_left"] == kept[300 + k]["n_words"] for k in range(40))
    texts = texts_of(rules.cleaned(docs))
    assert set(texts) == set(range(80)) | {300 + k for k in range(40)}
    assert texts[7] == body(7) + "\n" + body(1007) and "subscribe" in texts[301]


def test_copies_are_no_evidence(spark):
    text = "\n".join(" ".join(f"v{j}x{i}" for i in range(12)) for j in range(4))
    docs = spark.createDataFrame([(k, text, "a") for k in range(300)], "doc_id long, text string, source string")
    assert all(r["kept"] for r in rules.judge(docs).collect())


def test_two_long_boilerplate_lines(spark):
    """Each is the other's longest line; copies count once in the host's total, too."""
    header, footer = " ".join(f"header{i}" for i in range(20)), " ".join(f"footer{i}" for i in range(19))
    word = lambda *x: "".join(chr(97 + int(c, 16)) for c in hashlib.md5(repr(x).encode()).hexdigest()[:6])
    rows = [(k, "\n".join([header, *(" ".join(word(k, j, i) for i in range(6)) for j in range(3)), footer]), "a") for k in range(60)]
    rows += [(100 + k, " ".join(word(i) for i in range(20)), "a") for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    assert all(out[k]["kept"] and out[k]["n_left"] == 18 for k in range(60))
    assert all(out[100 + k]["kept"] and out[100 + k]["n_left"] == 20 for k in range(5000))


@pytest.mark.parametrize("broadcast", [rules.BROADCAST_LINES, 0])
@pytest.mark.parametrize("which", ["edges", "doubled", "sample", "lined"])
def test_verdicts_on_lines(request, which, broadcast):
    """Limits so low that ordinary tables have frequent lines; both ways to the documents."""
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    want = brute.line_verdicts([r[1:] for r in rows], 1, 0.05)
    assert which == "empty" or any(len(brute.WORD.findall(t or "")) > left for (_, t, _), (left, _, _) in zip(rows, want))
    got = sorted(str((r["doc_id"], r["n_left"], r["kept"])) for r in rules.judge(docs, 1, 0.05, broadcast=broadcast).collect())
    assert got == sorted(str((k, left, kept)) for (k, _, _), (left, kept, _) in zip(rows, want))
    texts = sorted(str((r["doc_id"], r["text"])) for r in rules.cleaned(docs, 1, 0.05, broadcast=broadcast).collect())
    assert texts == sorted(str((k, rest)) for (k, _, _), (_, kept, rest) in zip(rows, want) if kept)


@pytest.fixture(scope="module")
def lined(spark):
    """Random pages of few lines; one host has most of them."""
    rng = random.Random(9)
    line = lambda k: " ".join(f"w{k * 7 % 50 + i}" for i in range(k % 9 + 1)) + f" {k % 5}"
    rows = [(k, "\n".join(line(int(rng.expovariate(0.05))) for _ in range(rng.randint(1, 12))), rng.choice(["a", "a", "a", None, "b"])) for k in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_columns_named_like_steps(spark):
    rows = [(k, f"these ten words stand in every text of this table\nand a line {chr(97 + k % 26) * (1 + k // 26)} of its own with some words", "a", k, str(k), k, "x") for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __lines long, __host string, host long, `TEXT ` string")
    out = rules.cleaned(docs)
    assert out.columns == docs.columns and {(r["doc_id"], r["__lines"], r["host"]) for r in out.collect()} == {(k, k, k) for k in range(70)}


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("which", ["edges", "sample"])
def test_near_duplicates(request, which, width):
    docs = request.getfixturevalue(which)
    want = brute.components(texts_of(docs), width)
    out = minhash.near_duplicates(docs, width).collect()
    assert len(out) == len(want)
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_pair_that_shares_little_with_its_buckets_least_member(spark):
    """Two groups whose members share shingles with a common text, but are near only one another."""
    common = [f"c{k}" for k in range(120)]
    group = lambda g, k: " ".join(common + [f"g{g}x{i}" for i in range(120)] + [f"u{g}x{k}"])
    rows = [(0, " ".join(common + [f"z{i}" for i in range(60)]))] + [(1 + 10 * g + k, group(g, k)) for g in range(4) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 2).collect()}
    assert out == {k: v[1] for k, v in brute.components(dict(rows), 2).items()}


def test_pairs_among_many_texts_of_one_template(spark):
    """Texts that share a template (0.75) fill the buckets; each template's only pair (0.81) shares no bucket but these."""
    rows, want = [], {}
    for g in range(8):
        for k in range(302):
            own = 14 if k < 300 else 10
            rows.append((1000 * g + k, " ".join([f"t{g}x{i}" for i in range(85)] + [f"o{g}x{k}x{i}" for i in range(own)])))
            want[1000 * g + k] = 1000 * g + min(k, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 2).collect()} == want


def test_all_links_of_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute.components(texts_of(docs), 2)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, 2).collect()}
    assert out == want


def test_documents_with_several_texts(spark):
    """Each document is one node, which links what any of its texts links."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (9, b), (9, ""), (9, None), (7, None), (4, "alone")] + [(20, a)] * 3 + [(None, a), (None, a)]
    out = sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    want = {3: 3, 5: 3, 9: 3, 7: 7, 4: 4, 20: 3, None: None}
    assert out == sorted(str((k, want[k], k is None or want[k] == k)) for k, _ in rows)


def test_hot_centres_are_dealt(spark, monkeypatch):
    """Joins and components with every key hot."""
    monkeypatch.setattr(skew, "EACH", 3)
    edges = [(k, 0) for k in range(1, 40)] + [(k, k - 1) for k in range(101, 140)] + [(300, 139), (300, 39), (500, 501)]
    root = {k: 0 for k in [*range(1, 40), *range(100, 140), 300]} | {501: 500}
    scratch = Scratch(spark)
    out = components(scratch.written(spark.createDataFrame(edges, "a long, b long"), "edges"), scratch)
    assert {r["node"]: r["root"] for r in out.collect()} == root
    rows, table = spark.range(100).selectExpr("id", "id % 3 AS k"), spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    hot = skew.hot(rows, ["k"], 5)
    assert hot.parts.count() == 3
    assert sorted(hot.joined(rows, table, "id", "left").collect(), key=lambda r: r["id"]) == sorted(rows.join(table, "k", "left").collect(), key=lambda r: r["id"])


def test_operators_with_every_key_hot(edges, monkeypatch):
    monkeypatch.setattr(skew, "EACH", 2)
    monkeypatch.setattr(minhash, "GROUP_PAIRS", 2)
    texts = texts_of(edges)
    want = brute.components(texts, 2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(edges, 2).collect()} == want
    flags = brute.covered(texts, 100)
    assert {r["doc_id"]: r["n_removed"] for r in repeats.report(edges).collect()} == {k: sum(v) for k, v in flags.items()}


@pytest.mark.parametrize("famous, sampled", [((1 << 16, 1 << 10), 1 << 62), ((4, 3), 1 << 62), ((4, 3), 0)])
@pytest.mark.parametrize("which", ["edges", "sample"])
def test_repeated_bytes(request, which, famous, sampled):
    """Also with ordinary grams called famous, and with the famous ones of a sample told beforehand."""
    docs = request.getfixturevalue(which)
    texts = texts_of(docs)
    want = brute.covered(texts, 100)
    for r in repeats.report(docs, famous=famous, sampled_bytes=sampled, sampled=2).collect():
        raw, flags = (texts[r["doc_id"]] or "").encode(), want[r["doc_id"]]
        left = bytes(b for b, f in zip(raw, flags) if not f)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), sum(flags), len(brute.runs(flags)), hashlib.sha256(left).hexdigest())


def test_deduplicated_keeps_other_columns(edges):
    out = repeats.deduplicated(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    texts, left = texts_of(edges), texts_of(out)
    want = brute.covered(texts, 100)
    for k, t in texts.items():
        raw = (t or "").encode()
        plain = bytes(b for b, f in zip(raw, want[k]) if not f)
        if t is None or t.isascii():
            assert (left[k] or "").encode() == plain
    others = [c for c in edges.columns if c != "text"]
    assert sorted(map(str, out.select(others).collect())) == sorted(map(str, edges.select(others).collect()))


@pytest.mark.parametrize("which", ["doubled", "empty"])
def test_repeated_rows_and_empty_tables(request, which):
    docs = request.getfixturevalue(which)
    n = docs.count()
    assert rules.judge(docs).count() == n
    assert rules.cleaned(docs).columns == docs.columns
    found = minhash.near_duplicates(docs, 2).collect()
    assert len(found) == n and all(r["kept"] and r["component_id"] is None for r in found if r["doc_id"] is None)
    assert minhash.deduplicated(docs).columns == docs.columns
    assert repeats.deduplicated(docs).count() == n


def test_repeated_rows_lose_what_stood_earlier(spark):
    """Rows of one id are ordered by a hash of their text; rows alike in both are one document."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (2, b + a), (2, c), (None, c), (None, c), (3, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = {(r["doc_id"], r["text"]): r["h"] for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, ranks[r]))
    want = brute.covered({k: t for k, (_, t) in enumerate(order)}, 100)
    removed = {r: sum(want[k]) for k, r in enumerate(order)}
    out = sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"])) for r in repeats.report(docs).collect())
    assert out == sorted(str((r[0], len(r[1]), removed[r])) for r in rows)


def test_first_windows_across_batches_and_collisions():
    rng = random.Random(7)
    rows = sorted((k, rng.choice([b"aaaa", b"bbbb", b"cccc"]) if k == 4 else bytes([k] * 4)) for k in [rng.randrange(8) * 2 for _ in range(300)])
    rows = [(k, w) for k in sorted({k for k, _ in rows}) for _, w in rng.sample([r for r in rows if r[0] == k], sum(r[0] == k for r in rows))]
    firsts, seen, got, want = repeats.FirstWindows(), set(), [], []
    for a in range(0, len(rows), 7):
        part = rows[a : a + 7]
        got += firsts.later(np.array([k for k, _ in part]), np.array([list(w) for _, w in part], np.uint8)).tolist()
    for r in rows:
        want.append(r in seen)
        seen.add(r)
    assert got == want
