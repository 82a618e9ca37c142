"""Corpus operators: what is stored, sent and counted."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestrata import workers
from lodestrata.llm import arrays, media, phrases, repeats, sketches


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 384, 1001])
def test_coded_pcm_is_lossless(n):
    for samples in (np.random.default_rng(n).integers(-32768, 32768, n), np.full(n, -32768), np.arange(n) % 2 * 65535 - 32768):
        pcm = samples.astype("<i2").tobytes()
        assert media.decode_pcm(media.code_pcm(pcm)) == pcm


def test_stored_pcm_is_coded_and_read_back(spark, monkeypatch):
    """Half of the stored PCM is what interpolation tells; the query's columns are those of plain PCM."""
    rng = random.Random(2)
    rows = [(k, "".join(rng.choices("abc dÜ日", k=rng.randint(0, 700)))) for k in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r["doc_id"]: r["pcm"] for r in media.store(docs).collect()}
    kept = []
    real = media.written
    monkeypatch.setattr(media, "written", lambda df, *a: kept.append(real(df, *a)) or kept[0])
    found = media.telephony_digests(docs)
    for r in kept[0].collect():
        assert media.decode_pcm(r["pcm"]) == plain[r["doc_id"]] and len(r["pcm"]) == len(plain[r["doc_id"]])
        assert not any(r["pcm"][len(r["pcm"]) // 2 :])
    want = media.digests(media.store(docs))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 62


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_a_task_tells_a_phrase_once(most):
    """Of many shards of a language the counts are summed in their task; where few rows are held, by parts."""
    rng = random.Random(5)
    texts = [("de" if k % 3 else "en", " ".join(rng.choices(["a", "b", "c", "d,"], k=30))) for k in range(60)]
    batches = [pa.RecordBatch.from_pydict({"lang": [x], "text": [t]}) for x, t in texts]
    bits = np.full(1 << 12, 255, np.uint8)  # every phrase is likely
    rows = [(r["lang"], r["words"], r["phrase"], r["n"]) for b in phrases.summed((phrases.shard_counts(x, data, bits, 3) for x, data in phrases.shards(iter(batches), 100)), most) for r in b.to_pylist()]
    want = Counter()
    for lang, text in texts:
        for piece in text.split(","):
            w = piece.split()
            want[lang, 0, ""] += len(w)
            want.update((lang, n, " ".join(w[k : k + n])) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    found = Counter()
    for lang, words, phrase, n in rows:
        found[lang, words, phrase] += n
    assert found == want
    assert (len(rows) == len(want)) == (most > 1)


def test_frequent_phrases_stay_in_a_task():
    """Where more phrases are held than fit, the rare ones are passed on, the frequent ones once at the end."""
    shard = lambda k: pa.RecordBatch.from_pydict({"lang": ["en"] * 6, "words": pa.array([1] * 6, pa.int32()), "phrase": ["often", *(f"rare {k} {j}" for j in range(5))], "n": [9, *[1] * 5]})
    rows = [r for b in phrases.summed(map(shard, range(20)), 12) for r in b.to_pylist()]
    assert [r["n"] for r in rows if r["phrase"] == "often"] == [180]
    assert len(rows) == 101


def test_a_phrase_is_told_once_a_core(spark, monkeypatch):
    """The rows that tasks pass on don't grow with the number of the table's partitions, but where a task would read too much."""
    made = []
    real = arrays.mapped
    monkeypatch.setattr(arrays, "mapped", lambda *a: made.append(real(*a)) or made[-1])
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(0, 3 * cores, 1, 3 * cores).selectExpr("'en' lang", "'a b c d' text")
    phrases.collocations(docs, least=3)
    assert made[-1].count() == 11 * cores  # 10 phrases and words, and the number of words
    monkeypatch.setattr(phrases, "TASK", 7 * 3 * cores // (2 * cores))
    assert phrases.by_core(docs, 7 * 3 * cores).rdd.getNumPartitions() > cores


def test_sketch_cells_are_raised_to_bounds_only():
    """Bounds hold over several tasks' sketches, and are below those of plain sums."""
    rng, cells = np.random.default_rng(7), 1 << 13
    tasks = [[arrays.mix(rng.zipf(1.3, 20_000).astype(np.uint64)) for _ in range(3)] for _ in range(4)]
    merged, plain = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for task in tasks:
        counts = np.zeros(cells, np.uint8)
        for hashes in task:
            sketches.add(counts, hashes)
            for at in sketches.places(hashes, cells):
                plain += np.bincount(at, minlength=cells)
        merged += counts
    found, times = np.unique(np.concatenate(sum(tasks, [])), return_counts=True)
    bound, loose = (np.minimum(*(np.minimum(x[at], 255) for at in sketches.places(found, cells))) for x in (merged, plain))
    assert (bound >= np.minimum(times, 255)).all()
    assert (bound <= loose).all() and bound.sum() < 0.9 * loose.sum()


def test_phrases_with_rare_pairs_do_not_fill_the_sketch(spark):
    """Longer phrases are only sketched where all their pairs are likely; those that are frequent are still told."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([("en", " ".join(rng.choices(words, k=1000)) + ". often said by all.") for _ in range(60)], "lang string, text string").coalesce(2)
    bits = phrases.likely(docs, 4, 5, sketches.BLOCK)
    assert np.unpackbits(bits).mean() < 0.02
    shard = phrases.shard_counts("en", np.frombuffer(b"often said by all.", np.uint8), bits, 4)
    assert Counter(shard.column("words").to_pylist()) == {0: 1, 1: 4, 2: 3, 3: 2, 4: 1}


def test_no_core_waits_for_a_few_last_tasks(spark, monkeypatch):
    """Where there are more tasks than cores, each core has as many."""
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(0, 4 * cores, 1, 4 * cores).selectExpr("'en' lang", "'a b c d' text")
    monkeypatch.setattr(phrases, "TASK", 10)
    for size in (10 * cores + 1, 20 * cores - 5):
        assert phrases.by_core(docs, size).rdd.getNumPartitions() == 2 * cores


def test_words_of_any_length_have_their_own_hash():
    """A word's hash depends on the word and the language alone; words of all lengths, and of bytes that are 0, differ."""
    words = [b"x" * k for k in (*range(1, 40), 255, 256, 257, 1000)] + [b"x" * k + b"\0" for k in (1, 7, 8, 15)] + ["ä日😀".encode() * k for k in (1, 2, 40)]
    seen = {}
    for lang in ("en", "de"):
        for before in (b"", b"a ", b"longer words. "):
            shard = phrases.Coded(lang, np.frombuffer(before + b" ".join(words) + b"\n", np.uint8))
            for word, x in zip(shard.words.to_pylist(), shard.hashes.tolist()):
                assert seen.setdefault((lang, word), x) == x
    assert len(set(seen.values())) == len(seen) == 2 * (len(words) + 3)


def test_longer_phrases_of_several_languages_are_summed_apart():
    """Sums of phrases of one to five words, with several parts of them passed on or not."""
    texts = [(lang, b"a b c d e. e d c b a. ") for lang in ("en", "de")] * 3
    bits = np.full(1 << 12, 255, np.uint8)
    for most in (1, 40, 1 << 20):
        found = Counter()
        for b in phrases.summed((phrases.shard_counts(x, np.frombuffer(t, np.uint8), bits, 5) for x, t in texts), most):
            found.update({(r["lang"], r["phrase"]): r["n"] for r in b.to_pylist() if r["words"] == len(r["phrase"].split()) > 1})
            assert all(r["n"] == 30 for r in b.to_pylist() if not r["words"]) or most < 1 << 20
        want = {(x, " ".join(w[k : k + n])): 3 for x in ("en", "de") for w in ("a b c d e".split(), "e d c b a".split()) for n in range(2, 6) for k in range(6 - n)}
        assert found == want


def test_anchors_are_found_in_memory_that_stays(monkeypatch):
    """No array of a block is as large as what goes back to the system at once; blocks of any size find the same anchors."""
    assert 8 * (repeats.BLOCK + repeats.LENGTH) < workers.RETURNED_BYTES
    data = np.random.default_rng(3).integers(97, 100, 40_000).astype(np.uint8)
    off = np.array([0, 50, 150, 9_000, 9_000, 30_000, 40_000])
    found = repeats.anchors(data, off)
    for size in (1 << 10, 1 << 16):
        monkeypatch.setattr(repeats, "BLOCK", size)
        assert all((a == b).all() for a, b in zip(found, repeats.anchors(data, off), strict=True))
