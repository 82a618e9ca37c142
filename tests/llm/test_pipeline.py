"""Each stage of the pipeline against a plain version, on the stage's own input."""

import random

import brute
import duckdb
import pytest

import corpus_pipeline
from lodestrata.llm import mixing, packing, rules
from lodestrata.llm.shared import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The small table, and the pages of a host that have a header and a footer in common."""
    rng = random.Random(6)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    header, footer = " ".join(f"head{k}" for k in range(8)), " ".join(f"foot{k}" for k in range(9))
    body = lambda: "\n".join(" ".join(f"{rng.randrange(16**6):06x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(9)) for _ in range(rng.choice([0, 3, 5])))
    pages = [(10**6 + k, f"{header}\n{body()}\n{footer}", "en", "pages", 0) for k in range(120)]
    path = str(tmp_path_factory.mktemp("sf"))
    docs.unionByName(spark.createDataFrame(pages, docs.schema)).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), name))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(outputs):
    assert all(o.columns == outputs[0].columns for o in outputs[:-1])


def test_rules(outputs):
    before, after = rows(outputs[0]), rows(outputs[1])
    verdicts = brute.line_verdicts([(r["text"], r["source"]) for r in before.values()], rules.LINE_DOCS, rules.LINE_SHARE)
    want = {k: text for k, (_, kept, text) in zip(before, verdicts) if kept}
    assert {k: r["text"] for k, r in after.items()} == want
    assert any(want[k] != before[k]["text"] for k in want) and any(k >= 10**6 and k not in want for k in before)


def test_near_dedup(outputs):
    before, after = rows(outputs[1]), rows(outputs[2])
    want = {k for k, (_, root) in brute.components({k: r["text"] for k, r in before.items()}, 5).items() if k == root}
    assert set(after) == want and all(after[k] == before[k] for k in want)


def test_substrings(outputs):
    before, after = rows(outputs[2]), rows(outputs[3])
    flags = brute.covered({k: r["text"] for k, r in before.items()}, 100)
    assert set(before) == set(after)
    for k, r in before.items():
        text = after[k]["text"]
        plain = bytes(b for b, f in zip(r["text"].encode(), flags[k]) if not f)
        assert text.encode() == plain if r["text"].isascii() else len(text.encode()) >= len(plain)
        assert after[k]["n_chars"] == len(text)


def test_mixture(outputs):
    con = duckdb.connect()
    con.register("documents", outputs[3].toArrow())
    want = sorted(d for d, size, _, _, taken in con.execute(mixing.ORACLE).fetchall() if size for _ in range(taken // size))
    assert sorted(r["doc_id"] for r in outputs[4].collect()) == want


def test_packing(outputs):
    out = outputs[5].toPandas()
    assert out["length"].sum() == sum(len(brute.WORD.findall(r["text"] or "")) for r in outputs[4].collect())
    assert out.groupby(["shard", "bin"])["length"].sum().max() <= packing.CAPACITY


def test_run(spark, outputs, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(got.collect()) == sorted(outputs[5].collect())
