import base64
import hashlib
import random
import zlib

import brute
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import media, mixing, packing, warc


def test_companding_tables():
    assert [int(media.MU_TABLE[c]) for c in (0xFF, 0x7F, 0x00, 0x80)] == [0, 0, -32124, 32124]
    assert [int(media.A_TABLE[c]) for c in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]


def test_adpcm_blocks_against_one_step_at_a_time():
    blocks = np.random.default_rng(1).integers(0, 256, (40, media.BLOCK), dtype=np.uint8)
    for block, got in zip(blocks.tolist(), media.decode_adpcm(blocks)):
        value = int.from_bytes(bytes(block[:2]), "little", signed=True)
        index, want = min(block[2], 88), [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(media.INDEX_MOVES[code & 7])))
                want.append(value)
        assert got.tolist() == want


@pytest.mark.parametrize("which", ["edges", "doubled", "empty"])
def test_audio_round_trip(request, which):
    docs = request.getfixturevalue(which)
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in docs.select("doc_id", "text").collect())
    out = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.telephony_digests(docs).collect())
    expected = []
    for k, t in want:
        raw = t.encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        expected.append((k, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert out == sorted(expected)


def test_audio_query_stores_the_pcm_and_reads_it(edges, monkeypatch):
    kept, written = [], media.written
    monkeypatch.setattr(media, "written", lambda *a: kept.append(written(*a)) or kept[-1])
    out = {r["doc_id"]: r["feature"] for r in media.telephony_digests(edges).collect()}
    stored = kept[0].collect()
    assert len(stored) == len(out)
    for r in stored:
        assert bytes(r["pcm"]) == media.resample_double(media.MU_TABLE[np.frombuffer(media.read_wave(bytes(r["media"]))[1], np.uint8)]).tobytes()
        assert out[r["doc_id"]].endswith(f"pcm16k={zlib.crc32(r['pcm']):08x}")
    other = media.digests(kept[0].withColumn("pcm", F.lit(b"ab"))).first()["feature"]
    assert other.endswith(f"pcm16k={zlib.crc32(b'ab'):08x}")  # of what is stored


def plain_features(payload):
    """Sample by sample: what the features, the file and the PCM of a payload are."""

    def sign_turns(x):
        return sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))

    def mu(c):
        c ^= 255
        size = ((c % 16 * 2 + 33) << c // 16 % 8) - 33
        return (-size if c >= 128 else size) * 4

    def a_law(c):
        c ^= 0x55
        low, high = c % 16, c // 16 % 8
        size = 16 * low + 8 if high == 0 else (16 * low + 264) << high - 1
        return size if c >= 128 else -size

    def adpcm(block):
        value = int.from_bytes(bytes(block[:2]), "little", signed=True)
        index, out = min(block[2], 88), [value]
        for byte in block[4:]:
            for code in (byte % 16, byte // 16):
                step = int(media.STEPS[index])
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(media.INDEX_MOVES[code & 7])))
                out.append(value)
        return out

    parts = []
    for table in (mu, a_law):
        pcm = [table(c) for c in payload]
        parts += [sum(x * x for x in pcm) // len(pcm), sign_turns(pcm)]
    blocks = [adpcm(payload[k : k + 192]) for k in range(0, len(payload), 192)]
    power = sum(x * x for b in blocks for x in b) // sum(map(len, blocks))
    pcm = [mu(c) for c in payload]
    wide = [y for k, x in enumerate(pcm) for y in (x, (x + pcm[min(k + 1, len(pcm) - 1)]) >> 1)]
    check = zlib.crc32(b"".join(x.to_bytes(2, "little", signed=True) for x in wide))
    return f"mu={parts[0]}/{parts[1]};a={parts[2]}/{parts[3]};adpcm={power};pcm16k={check:08x}", wide


def test_stored_form_and_features_sample_by_sample(spark):
    texts = [None, "", "short", "Ünïcode 日本語 " * 40, "x" * 192, "plain words and more of them " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {r["doc_id"]: r for r in media.store(docs).collect()}
    for r in media.telephony_digests(docs).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        n = len(payload).to_bytes(4, "little")
        body = b"WAVEfmt \x12\0\0\0\x07\0\x01\0" + (8000).to_bytes(4, "little") * 2 + b"\x01\0\x08\0\0\0fact\x04\0\0\0" + n + b"data" + n + payload
        file = b"RIFF" + len(body).to_bytes(4, "little") + body
        feature, pcm = plain_features(payload)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(file), hashlib.sha256(file).hexdigest(), feature)
        assert stored[r["doc_id"]]["media"] == file and np.frombuffer(stored[r["doc_id"]]["pcm"], np.int16).tolist() == pcm


def pages_of(spark, docs):
    return docs.selectExpr("doc_id AS page_id", "concat('http://x/', doc_id) AS url", "text AS html", "size", "n AS digest")


@pytest.mark.parametrize("which", ["edges", "empty"])
def test_archives(request, spark, which):
    pages = pages_of(spark, request.getfixturevalue(which))
    out = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    texts = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    first = {}
    for k in sorted(texts):
        first.setdefault(texts[k], k)
    assert set(out) == set(texts)
    for k, t in texts.items():
        r, raw = out[k], t.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[t] == k else ("revisit", first[t]))
        assert r["payload"] == (raw if first[t] == k else None)


def test_archives_with_repeated_rows(spark, doubled):
    pages = pages_of(spark, doubled)
    rows = sorted(((r["page_id"] is None, r["page_id"] or 0, r["url"] or "", r["html"] or "") for r in pages.collect()))
    first, want = {}, []
    for unknown, k, url, html in rows:
        raw = html.encode()
        kind, refers = ("revisit", first[html]) if html in first else ("response", None)
        first.setdefault(html, None if unknown else k)
        want.append((None if unknown else k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, refers))
    out = warc.read_archives(warc.write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", "longer"), (4, "u", "longer")], "page_id long, url string, html string")
    out = {r["page_id"]: r["record_type"] for r in warc.read_archives(warc.write_archives(pages, least=5)).collect()}
    assert out == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_damaged_archives_are_errors():
    good = warc.member(warc.page_record(1, "http://x", b"payload"))
    assert [warc.parse(m)[0]["warc-type"] for m in warc.members(good + good)] == ["response"] * 2
    with pytest.raises(ValueError):
        list(warc.members(good[:-5]))
    with pytest.raises(ValueError):
        warc.parse(next(warc.members(good))[:-1])


@pytest.mark.parametrize("which", ["edges", "empty"])
def test_mixture_beside_sql(request, which):
    docs = request.getfixturevalue(which).select("doc_id", "text", "source")
    con = duckdb.connect()
    table = docs.toArrow()
    con.register("documents", table)
    want = sorted(con.execute(mixing.ORACLE).fetchall())
    out = mixing.mixed(docs)
    got = sorted(tuple(r) for r in out.select("doc_id", "size", "source_size", "target", "taken").collect())
    assert [(a, b, c, e) for a, b, c, _, e in got] == [(a, b, c, e) for a, b, c, _, e in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want])
    assert all(r["taken"] <= 2 * r["size"] for r in out.collect())


def test_targets_fill_like_water(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = [(None if k == 5 else f"s{k}", rng.randint(1, 1000)) for k in range(6)]
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        weight = dict(zip([s for s, _ in sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))], (3, 1, 2) * 2))
        size, left, open_, want = dict(sizes), 1.5 * sum(n for _, n in sizes), {s for s, _ in sizes}, {}
        while open_:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] > 2 * size[s]}
            want |= {s: 2 * size[s] for s in over} if over else share
            left -= sum(2 * size[s] for s in over)
            open_ = open_ - over if over else set()
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixture_with_repeated_rows(doubled):
    con = duckdb.connect()
    con.register("documents", doubled.select("doc_id", "text", "source").toArrow())
    want = sorted(str((r[0], r[1], r[2], r[4])) for r in con.execute(mixing.ORACLE).fetchall())
    out = mixing.mixed(doubled).collect()
    assert sorted(str((r["doc_id"], r["size"], r["source_size"], r["taken"])) for r in out) == want
    taken = mixing.mixed_documents(doubled)
    assert taken.columns == doubled.columns
    assert sorted(str(r["doc_id"]) for r in taken.select("doc_id").collect()) == sorted(str(r["doc_id"]) for r in out for _ in range(r["taken"] // max(r["size"], 1)))


def test_buckets_hold_few_rows_whatever_the_weights(spark):
    """Texts that are nearly all symbols have weights near 0.05."""
    rows = [(k, f"{'#$' * 40} {k}" if k % 3 else f"plain words {k}", "a") for k in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per_octave = 50
    sizes = [r["n"] for r in mixing.measured(docs).groupBy(F.floor(F.log2("key") * per_octave).alias("b")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 1.3 * mixing.OCTAVE * len(rows) / per_octave


def test_many_sources(spark):
    """More sources than a partition holds, targets as with few."""
    docs = spark.createDataFrame([(k, "word " * (k % 7 + 1), f"host{k % 500}") for k in range(3000)], "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted((r[0], r[4]) for r in con.execute(mixing.ORACLE).fetchall())
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.mixed(docs).collect()) == want


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(4)
    rows = pd.DataFrame([(str(k), rng.choice([None, "a", "a", "b"]), rng.randint(0, 140), rng.choice([None, "x", "y", str(k)])) for k in range(400)], columns=["doc_id", "source", "size", "cluster"])
    out = packing.pack_shard(rows, 100, 3)
    by = rows.set_index("doc_id")
    assert out.groupby("doc_id")["length"].sum().to_dict() == {int(k): v for k, v in by["size"].items()}
    rests = out[(out["length"] > 0) & (out["length"] < 100)]
    pieces = [(int(r.length), by.loc[str(r.doc_id), "source"] or "", by.loc[str(r.doc_id), "cluster"]) for r in rests.itertuples()]
    assert rests["bin"].tolist() == brute.best_fit(pieces, 100, 3)
    assert [p[0] for p in pieces] == sorted((p[0] for p in pieces), reverse=True)


def test_packing_does_not_depend_on_the_order_of_rows(doubled):
    rows = lambda d: sorted(map(str, packing.packed(d, capacity=256).collect()))
    assert rows(doubled) == rows(doubled.repartition(5, "n")) == rows(doubled.orderBy("text"))


def test_only_the_named_column_is_the_cluster(spark):
    docs = spark.createDataFrame([(k, f"some words of text {k}", "s", "one") for k in range(6)], "doc_id long, text string, source string, cluster string")
    assert packing.packed(docs).select("bin").distinct().count() == 1
    assert packing.packed(docs, cluster="cluster").select("bin").distinct().count() == 6


@pytest.mark.parametrize("which", ["edges", "doubled", "empty"])
def test_packed(request, which):
    docs = request.getfixturevalue(which)
    out = packing.packed(docs, capacity=256).toPandas()
    assert len(out) >= docs.count()
    words = sum(len(brute.WORD.findall(r["text"] or "")) for r in docs.select("text").collect())
    assert out["length"].sum() == words
    if len(out):
        assert out.groupby(["shard", "bin"])["length"].sum().max() <= 256
        spans = out[out["length"] > 0].sort_values(["shard", "bin", "offset"])
        before = spans.groupby(["shard", "bin"])["length"].cumsum() - spans["length"]
        assert (before == spans["offset"]).all()


def test_rows_alike_are_taken_to_the_budget(spark):
    """5,000 rows alike in one source and 500 others: the words taken come near the target, not only to whole passes."""
    rows = [(1, "ten words " * 5, "a")] * 5000 + [(10 + k, f"w{k} " * 10, "b") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted((r[0], r[4]) for r in con.execute(mixing.ORACLE).fetchall())
    out = mixing.mixed(docs).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == want
    for source in ("a", "b"):
        target = next(r["target"] for r in out if r["source"] == source)
        assert abs(sum(r["taken"] for r in out if r["source"] == source) - target) <= 10
    taken = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert sum(10 * r["count"] for r in taken if r["doc_id"] == 1) == sum(r["taken"] for r in out if r["source"] == "a")
