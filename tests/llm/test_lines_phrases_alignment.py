"""Common lines, collocations and token alignment against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from brute import WORD  # noqa: F401
from conftest import frame

import __spark_entry__ as entry_module
from lodestrata.llm import alignment, lines, phrases, sketches

SF = "/root/testdata/sf0.001"


def sorted_rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("name", ["op12_collocations", "op13_line_dedup"])
def test_twin(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = entry_module.queries()[name](spark, SF)
    columns = ", ".join(df.columns)
    assert sorted_rows(df) == sorted(map(repr, con.execute(f"SELECT {columns} FROM ({entry_module.oracle_sql()[name]})").fetchall()))


# ---------------------------------------------------------------- lines


def reduced(rows, least_chars, least_docs):
    """(doc_id, lines, dropped, text) of each (doc_id, text)."""
    low = lambda m: m[0].lower()
    key = lambda line: re.sub("[A-Z]", low, re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line))
    order = lambda d: (d is not None, d or 0)
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        left = [x for x in all_lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or max(holders[key(x)], key=order) == d]
        out.append((d, len(all_lines), len(all_lines) - len(left), "\n".join(left)))
    return out


COMMON = "A line that many documents of the table hold"


def lined_rows():
    out = [(k, "\n".join([f"own line of the document with number {k}", ("  " if k % 2 else "") + (COMMON.upper() if k % 3 else COMMON) + "\t", "short", "", "ÄÖÜ " * 6 + str(k // 10)])) for k in range(60)]
    out += [(100, COMMON), (101, f"{COMMON}\n{COMMON}\n\n{COMMON}"), (102, "\n"), (103, ""), (104, None), (105, "\r\n".join([COMMON] * 2)), (None, COMMON), (None, "another line that has no document id"), (106, "another line that has no document id"), (107, "another line that has no document id")]
    out += [(200, "x" * 50_000 + "\n" + COMMON), (200, "x" * 50_000 + "\n" + COMMON), (200, "another text of this id\n" + "x" * 50_000), (201, "x" * 50_000)]
    return out


@pytest.mark.parametrize("bits", [None, sketches.BLOCK])
@pytest.mark.parametrize("least_docs", [2, 3])
def test_common_lines(spark, edges, doubled, empty, bits, least_docs):
    tables = [frame(spark, [(d, t, "en", "s1") for d, t in lined_rows()]), edges, doubled]
    for docs in tables:
        want = reduced([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 20, least_docs)
        got = lines.report(docs.repartition(5), 20, least_docs, bits)
        assert sorted_rows(got) == sorted(repr((d, n, k, hashlib.sha256(t.encode()).hexdigest())) for d, n, k, t in want)
        texts = lines.deduplicated(docs, 20, least_docs, bits)
        assert texts.schema == docs.schema
        assert sorted_rows(texts.selectExpr("doc_id", "coalesce(text, '')")) == sorted(repr((d, t)) for d, _, _, t in want)
        assert texts.where("text is null").count() == docs.where("text is null").count()
    assert lines.report(empty).count() == lines.deduplicated(empty).count() == 0


def test_full_filter_changes_nothing(spark, monkeypatch):
    docs = frame(spark, [(d, t, "en", "s1") for d, t in lined_rows()])
    want = sorted_rows(lines.report(docs))
    monkeypatch.setattr(lines, "repeated_filter", lambda docs, least_chars, bits: lines.np.full(bits // 8, 255, lines.np.uint8))
    assert sorted_rows(lines.report(docs)) == want


def test_few_lines_are_suspected(spark):
    docs = spark.createDataFrame([(k, f"a line of its own for document {k}\n{COMMON}", k) for k in range(2000)], "id long, text string, text_key long")
    twice = lines.repeated_filter(docs, 20, 1 << 17)
    assert 2000 <= lines.suspects(docs, 20, twice).count() <= 2060


# ---------------------------------------------------------------- phrases


def collocations(rows, least, covered, top, longest=4):
    f, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, longest + 1):
                f[lang].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = defaultdict(int)
        for p, a in good.items():
            for n in range(2, len(p)):
                for k in range(len(p) - n + 1):
                    around[p[k : k + n]] = max(around[p[k : k + n]], a)
        scored = []
        for p, a in good.items():
            if 100 * around[p] >= covered * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], k))
        for rank, (score, a, p, l, r, k) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, words[lang], -score, k))
    return sorted(map(repr, out))


def spoken_rows():
    texts = ["New York is big. new  york\tis old, new york", "to be, or not to be: to be or not to be", "x x x x x x x", "no\x00thing \x85 a　b a　b", "日本 語 日本 語! 日本 語", "😀 😀 😀 😀", ";;;,,,", " ", "", None]
    return [(k, t, [None, "en", "und", "zz"][k // 10 % 4], "s") for k, t in enumerate(texts * 12)] + [(999, "long " * 4000 + "end. " * 10, "en", "s")]


@pytest.mark.parametrize("shard", [300, phrases.SHARD])
def test_collocations(spark, edges, doubled, empty, shard, monkeypatch):
    monkeypatch.setattr(phrases, "shards", lambda batches, size=shard, f=phrases.shards: f(batches, size))
    for docs in (frame(spark, spoken_rows()), edges, doubled):
        rows = [tuple(r) for r in docs.select("lang", "text").collect()]
        for least, covered, top, cells in ((2, 80, 2000, None), (5, 101, 7, sketches.BLOCK)):
            got = phrases.collocations(docs.repartition(3), least=least, covered=covered, top=top, cells=cells)
            assert sorted_rows(got) == collocations(rows, least, covered, top)
    assert phrases.collocations(empty).count() == 0


def test_full_sketch_changes_nothing(spark, monkeypatch):
    docs = frame(spark, spoken_rows())
    want = sorted_rows(phrases.collocations(docs, least=3))
    monkeypatch.setattr(phrases, "likely", lambda docs, longest, least, cells: phrases.np.full(cells // 8, 255, phrases.np.uint8))
    assert sorted_rows(phrases.collocations(docs, least=3)) == want


def test_least_is_bounded(spark):
    with pytest.raises(ValueError):
        phrases.collocations(frame(spark, spoken_rows()), least=300)


# ---------------------------------------------------------------- alignment


def plain_alignment(texts):
    """The report's columns without doc_id, whole texts encoded at once, links by comparing all tokens' ranges."""
    known = alignment.Tokenizers(alignment.A_FILE, alignment.B_FILE)
    docs, counts = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = known.a.encode(raw.decode(), add_special_tokens=False).ids if text else []
        b = known.b.encode(text) if text else []
        if not text or b"".join(known.a_bytes[i] for i in a) != raw or b"".join(known.b_bytes[i] for i in b) != raw:
            docs.append(([], [], [], []))
            continue
        spans = []
        for ids, size in ((a, known.a_bytes), (b, known.b_bytes)):
            at, found = 0, []
            for i in ids:
                found.append((at, at := at + len(size[i]), i))
            spans.append(found)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[[i for s, e, i in side if lo <= s and e <= hi] for side in spans] for lo, hi in zip([0, *ends], ends)]
        links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
        counts.update(links)
        docs.append((a, b, groups, links))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for a, b, groups, links in docs:
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def spaced_rows():
    texts = ["Hello world", " two  spaces   here ", "tab\tand\nline\n\nbreaks \n x", "it's we'll 'tis", "<|endoftext|> and <s> </s> <unk> <0x41>", "a piece▁mark", "日本語のテキスト と English", "é é 　 \xa0 x\xa0y", "\x00 nul \x1c sep \x1d x", "😀👍🏽 flags 🇩🇪", "a" * 700, "1234567 89 0x1F", " ", "  ", "\n", "end ", "", None]
    return [(k, t, "en", "s") for k, t in enumerate(texts * 2)]


def test_alignment(spark, edges, doubled, empty):
    short = edges.where("text is null or length(text) < 4000")
    for docs in (frame(spark, spaced_rows()), short, doubled.where("text is null or length(text) < 2000")):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        want = sorted(repr((d, *x)) for (d, _), x in zip(rows, plain_alignment([t for _, t in rows])))
        for told in (5, alignment.TOLD_GROUPS):
            assert sorted_rows(alignment.report(docs, told=told)) == want
    assert alignment.report(empty).count() == 0


def test_words_are_encoded_as_in_their_texts(spark, edges):
    known = alignment.tokenizers(alignment.A_FILE, alignment.B_FILE)
    assert known.by_word
    memory = alignment.Words(known, kept=50)
    texts = [t for _, t, _, _ in spaced_rows() if t] + [r.text for r in edges.select("text").collect() if r.text and "▁" not in r.text]
    for text in texts:
        words = memory.split(text)
        parts = memory.known(words)
        raw = " " + text
        a, b = known.a.encode(raw, add_special_tokens=False).ids, known.b.encode(text)
        whole = next(iter(known._grouped([raw], a, b))) if known._same(raw.encode(), a, b) else None
        if whole is None:
            assert None in parts.values()
        else:
            assert ";".join(parts[w][0] for w in words) == whole[0]
            assert (sum(parts[w][1] for w in words), sum(parts[w][2] for w in words)) == whole[1:]


def test_dictionary_holds_every_link_once(spark, edges):
    found = alignment.aligned(edges)
    links = found.groups.selectExpr("sum(frequency * n_links)").first()[0]
    assert links == found.pairs.selectExpr("sum(n)").first()[0]
    assert found.groups.count() == found.groups.select("group").distinct().count()
