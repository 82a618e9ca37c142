"""Stored indexes, journals and states against what is computed from the rows themselves."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import paths
from lodestrata.operators import batch_search, catalog_state, changes, content_index, entries, fulltext, journal_store, name_index, postings, search, store, versions
from lodestrata.operators.requests import file_query
from lodestrata.operators.search import FileQuery

WORDS = ["alpha", "beta", "gamma", "delta", "Ünï", "日本", "x1", "rare"]


def texts_of(spark, seed, n, prefix="/c"):
    rng = random.Random(seed)
    rows = [(f"{prefix}/{rng.choice('abc')}/d{k}", " ".join(rng.choices(WORDS, [20, 10, 5, 5, 2, 2, 1, 0.1], k=rng.randint(0, 60)))) for k in range(n)]
    return spark.createDataFrame([*rows, (f"{prefix}/empty", ""), (f"{prefix}/none", None), (f"{prefix}/long", "alpha beta " * 3000 + "w" * 100)], "path_key string, content string").repartition(3)


def scored(df):
    return [(r.path_key, r.score) for r in df.collect()]


QUERIES = ["alpha", "rare", "alpha beta", '"alpha beta"', '"beta gamma delta" OR rare', "gamma AND delta -beta", "+x1 alpha", '"日本 ünï" -rare', "nothing", "NOT alpha beta"]


@pytest.mark.parametrize("block_docs, seeds", [(7, 2), (2048, 16)])
def test_index_equals_scan(spark, block_docs, seeds):
    index = content_index.Index(spark, versions.new_place(spark, "index"), block_docs, seeds)
    texts = texts_of(spark, 1, 300)
    index.build(texts)
    table = {r.path_key: r.content for r in texts.collect() if r.content is not None}
    for step in range(2):
        now = spark.createDataFrame(list(table.items()), "path_key string, content string")
        for text in QUERIES if not step else QUERIES[1:6:2]:
            q = fulltext.content_query(text)
            want = scored(fulltext.bm25(now, q, "path_key").orderBy("score", "path_key"))
            want = sorted(want, key=lambda x: (-x[1], x[0]))
            assert scored(index.top(q, 1000)) == want
            assert scored(index.top(q, 5)) == want[:5]
            only = now.where("path_key like '/c/b%'").select("path_key")
            assert scored(index.top(q, 5, only)) == [x for x in want if x[0].startswith("/c/b")][:5]
        want = sorted(map(tuple, fulltext.tokens(now, "path_key").groupBy("term").agg(F.count("*"), F.sum("tf")).collect()))
        assert sorted(map(tuple, index.frequencies().collect())) == want
        removed = spark.createDataFrame([(f"/c/{'abc'[step]}",)], "path_key string")
        ups = {**{r.path_key: r.content for r in texts_of(spark, step + 5, 20, f"/c/{'bca'[step]}").collect()}, f"/c/{'bca'[step]}/gone": None}
        assert index.change(removed, spark.createDataFrame(list(ups.items()), "path_key string, content string"))
        table = {k: v for k, v in table.items() if not k.startswith(f"/c/{'abc'[step]}/")}
        table = {k: v for k, v in {**table, **ups}.items() if k not in ups or v is not None}


def test_blocks_beyond_the_bound_are_not_read(spark):
    """A rare strong text rules out the blocks of weak ones."""
    rows = [(f"/d/{k:04d}", "alpha " + "filler " * 50 if k != 500 else "alpha alpha alpha") for k in range(1000)]
    index = content_index.Index(spark, versions.new_place(spark, "index"), 10, 1)
    index.build(spark.createDataFrame(rows, "path_key string, content string").coalesce(1))
    q = fulltext.content_query("alpha")
    bounds = index._bounds(index.postings().where("term = 'alpha'"), q, {"alpha": 1.0}, 50.0).orderBy("bound").collect()
    assert len(bounds) == 100 and bounds[-1].bound > 1.9 * bounds[-2].bound
    assert scored(index.top(q, 1))[0][0] == "/d/0500"
    plan = index.postings().where("term in ('alpha', 'beta')").select("ids")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan


def test_index_is_built_without_a_shuffle(spark):
    """Blocks are written where their texts are read, sorted by term, and nothing else stays beside them."""
    index = content_index.Index(spark, versions.new_place(spark, "index"), 16)
    index.build(texts_of(spark, 4, 100))
    folder = store.Folder(spark, f"{index.place}/segments")
    (segment,) = folder.names()
    assert store.Folder(spark, f"{index.place}/segments/{segment}").names() == ["postings"]
    blocks = {}
    for r in index.postings().select("block", "term", F.input_file_name().alias("f")).collect():
        blocks.setdefault(r["block"], []).append((r["f"], r["term"].encode()))
    assert len(blocks) > 5
    for rows in blocks.values():  # one file a block, its documents first, then terms in order
        assert len({f for f, _ in rows}) == 1 and rows == sorted(rows) and rows[0][1] == b""


def test_a_worker_gets_the_texts_of_one_block_at_a_time(spark, monkeypatch):
    real = content_index.block_rows

    def narrow(batches, most):
        for batch in batches:
            if batch.num_rows > most:
                raise ValueError(f"{batch.num_rows} texts at once")
            yield from real([batch], most)

    monkeypatch.setattr(content_index, "block_rows", narrow)
    index = content_index.Index(spark, versions.new_place(spark, "index"), 16)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index.build(texts_of(spark, 4, 100).coalesce(1))
    assert index.documents().count() == 102 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == size


def test_a_worker_gets_few_long_texts_at_once_and_gives_memory_back(spark, monkeypatch):
    real = content_index.block_rows

    def narrow(batches, most):
        import pyarrow as pa

        for batch in batches:
            if batch.nbytes > 1 << 20:
                raise ValueError(f"{batch.nbytes} bytes at once")
            if pa.default_memory_pool().backend_name != "system":
                raise ValueError("freed memory stays with the worker")
            yield from real([batch], most)

    monkeypatch.setattr(content_index, "block_rows", narrow)
    monkeypatch.setattr(content_index, "BATCH_BYTES", 1 << 19)
    index = content_index.Index(spark, versions.new_place(spark, "index"))
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = [(f"/d/{k:02d}", "alpha beta " * 5000 + f"t{k}") for k in range(40)]
    index.build(spark.createDataFrame(rows, "path_key string, content string").coalesce(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == size
    assert index.documents().count() == 40 and {r["term"]: r["df"] for r in index.frequencies().collect()}["alpha"] == 40


def test_empty_index(spark):
    index = content_index.Index(spark, versions.new_place(spark, "index"))
    none = spark.createDataFrame([], "path_key string, content string")
    assert index.top(fulltext.content_query("a"), 5).count() == 0
    index.build(none)
    assert index.top(fulltext.content_query("a"), 5).count() == index.frequencies().count() == 0
    assert index.change(none.select("path_key"), none)


# ---------------------------------------------------------------- records


def test_record_is_written_once(spark):
    folder = store.Folder(spark, versions.new_place(spark, "records"))
    assert folder.put("a", "ä first") and not folder.put("a", "second")
    assert folder.read("a") == "ä first"
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if folder.put("b", str(k)) else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and folder.read("b") == str(won[0])
    assert folder.names() == ["a", "b"]


def test_half_written_record_is_not_seen(spark):
    folder = store.Folder(spark, versions.new_place(spark, "records"))
    folder.put("a", "x")
    out = folder.fs.create(folder.at(".b.0123"), True)
    out.write(bytearray(b"half"))
    out.close()
    assert folder.names() == ["a"] and folder.put("b", "whole") and folder.read("b") == "whole"


def test_state_refuses_changes_of_old_versions(spark):
    state = store.State(spark, versions.new_place(spark, "state"))
    assert state.read() == (0, {})
    assert state.update(lambda r: {"n": 1}) == {"n": 1}
    version, record = state.read()
    assert state.put(version, {"n": 2}) and not state.put(version, {"n": 3})
    assert state.update(lambda r: None if r["n"] == 2 else {"n": 9}) is None
    counters = [threading.Thread(target=lambda: state.update(lambda r: {"n": r["n"] + 1}, 100)) for _ in range(6)]
    for t in counters:
        t.start()
    for t in counters:
        t.join()
    assert state.read()[1] == {"n": 8}


# ---------------------------------------------------------------- names


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(3)
    names = ["Report", "ring", "red-ring", "Draft.final", "x", "project_7", "Straße", "ab", "RiNgs", "tool.app"]
    dirs = ["small", "Small-2", "ECONOMY", "red", "brand-1", "Brand-12", "deep/er", "ring", "pro!", "pro-1", "pro"]
    paths = {f"/{rng.choice(dirs)}/{rng.choice(dirs)}/{rng.choice(names)}-{k}.{rng.choice(['md', 'PDF', 'json'])}" for k in range(400)} | {"/pro", "/pro/x.md", "/pro-1", "/pro!/y.md", "/pro0"}
    files = spark.createDataFrame([(p, 1, len(p)) for p in sorted(paths)], "path string, modified_ms long, size_bytes long")
    return entries.finished(entries.with_directories(files), "/").cache()


SEARCHES = [
    FileQuery(terms=("ring",)), FileQuery(terms=("red",)), FileQuery(terms=("pro",)), FileQuery(terms=("r",)), FileQuery(terms=("rg",)), FileQuery(terms=("zzz",)), FileQuery(terms=("brand-1",)), FileQuery(terms=("small", "ring")), FileQuery(terms=("ring", "red"), dirs=("pro",)),
    FileQuery(types=(".Md",)), FileQuery(names=("ring",)), FileQuery(names=("x",), types=("pdf",)), FileQuery(dirs=("brand-1",)), FileQuery(dirs=("deep",), names=("report",)), FileQuery(dirs=("*red*",), terms=("ring",)), FileQuery(terms=("/red/",)), FileQuery(terms=("ring",), types=("json",), dirs=("economy",)),
]


@pytest.mark.parametrize("block", [16, 1 << 13])
def test_name_index_equals_scan(spark, catalog, block):
    index = name_index.NameIndex(spark, versions.new_place(spark, "names"), block)
    index.build(catalog)
    n = catalog.count()
    ids = [r.id for r in index.entries().orderBy("path_key", "path").select("id").collect()]
    assert ids == list(range(n))
    of = lambda df: [r.path for r in df.collect()]
    for query in SEARCHES:
        for limit in (3, 1000) if block == 16 else (20,):
            assert of(index.search(query, limit)) == of(search.search(catalog, query, limit)), (query, limit)
    visible = F.col("size_bytes") > 25
    assert of(index.search(SEARCHES[0], 10, visible)) == of(search.search(catalog, SEARCHES[0], 10, visible))
    assert of(index.search(SEARCHES[0], 10, most=1)) == of(search.search(catalog, SEARCHES[0], 10))
    for root in ("/pro", "/", "/small", "/none"):
        want = sorted(r.path for r in catalog.collect() if r.path_key == root or r.path_key.startswith(root.rstrip("/") + "/"))
        assert sorted(of(index.scope(root))) == want
    plan = index.scope("/pro")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(path_key,/pro/)" in plan and "Exchange" not in plan


def test_postings_of_a_block_are_made_together(spark, catalog, tmp_path):
    odd = catalog.limit(40).withColumn("name", F.concat(F.lit("Ä\U0001F600"), "name")).withColumn("path_key", F.concat(F.lit("/odd"), "path_key")).withColumn("path", F.col("path_key"))
    index = name_index.NameIndex(spark, str(tmp_path / "names"), 16)
    index.build(catalog.unionByName(odd))
    keyed = index.entries().withColumn("path_key", F.col("id"))
    want = {("gram", r.gram, r.path_key) for r in postings.name_grams(keyed).collect()} | {("extension", r.extension, r.path_key) for r in postings.extensions(keyed).collect()}
    got = index.postings().collect()
    assert len({(r.kind, r.value, r.block) for r in got}) == len(got) and all(r.n == len(r.offsets) and r.offsets == sorted(set(r.offsets)) for r in got)
    assert {(r.kind, r.value, r.block * 16 + o) for r in got for o in r.offsets} == want
    plan = index.postings().where("kind = 'gram' and value = 'rin'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(value,rin)" in plan


# ---------------------------------------------------------------- journal

ENTRY = "path_key string, kind string, size_bytes long"


def delta(spark, *rows):
    return spark.createDataFrame([(op, key, "file" if "." in key else "directory", size) for op, key, size in rows], f"op string, {ENTRY}")


def shown(df):
    return sorted((r.path_key, r.size_bytes) for r in df.collect())


def test_journal_is_committed_once(spark):
    catalog = journal_store.Catalog(spark, versions.new_place(spark, "catalog"), ENTRY)
    assert catalog.recover().mode == "unavailable"
    base = spark.createDataFrame([("/a", "directory", 0), ("/a/x.md", "file", 1), ("/b", "directory", 0)], ENTRY)
    assert catalog.install(base, 4)
    one = delta(spark, ("upsert", "/a/y.md", 2), ("remove", "/b", 0))
    assert catalog.commit(5, one) == "append" and catalog.commit(5, one.repartition(3)) == "done"
    assert catalog.commit(5, delta(spark, ("upsert", "/a/y.md", 3))) == "conflict"
    assert catalog.commit(6, delta(spark, ("move", "/a", 3))) == "invalid"
    assert catalog.commit(6, delta(spark, ("upsert", "/a/z.md", 1), ("remove", "/a/z.md", 1))) == "invalid"
    found = catalog.recover()
    assert (found.mode, found.generation) == ("replayed", 5)
    assert shown(found.entries) == [("/a", 0), ("/a/x.md", 1), ("/a/y.md", 2)]
    # a gap: the baseline alone
    assert catalog.commit(7, delta(spark, ("remove", "/a", 0))) == "append"
    found = catalog.recover()
    assert (found.mode, found.code, found.generation) == ("baseline_only", "journal_gap", 4)
    assert shown(found.entries) == shown(base)
    # baselines that would go back, or before a gap, are refused; later ones are put in place
    assert not catalog.install(base, 4) and not catalog.install(base, 5)
    assert catalog.commit(6, delta(spark)) == "append"
    assert catalog.install(base, 6) and shown(catalog.recover().entries) == [("/b", 0)]
    assert catalog.install(base, 9) and not catalog.install(base, 8)
    assert shown(catalog.recover().entries) == shown(base)


def test_two_writers_of_a_generation(spark):
    catalog = journal_store.Catalog(spark, versions.new_place(spark, "catalog"), ENTRY)
    assert catalog.install(delta(spark).drop("op"), 0)
    answers = {}
    threads = [threading.Thread(target=lambda k=k: answers.update({k: catalog.commit(1, delta(spark, ("upsert", f"/w{k % 2}.md", k % 2)))})) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(answers.values()) == ["append", "conflict", "conflict", "done"]
    assert len(shown(catalog.recover().entries)) == 1
    assert len(catalog.committed()) == 1


def test_broken_payload_is_noticed(spark):
    catalog = journal_store.Catalog(spark, versions.new_place(spark, "catalog"), ENTRY)
    base = delta(spark, ("", "/a.md", 1)).drop("op")
    catalog.install(base, 0)
    catalog.commit(1, delta(spark, ("upsert", "/b.md", 1)))
    name = catalog.committed()[0]["payload"]
    catalog.journal().withColumn("size_bytes", F.lit(7).cast("long")).coalesce(1).write.parquet(f"{catalog.place}/other")
    spark.read.parquet(f"{catalog.place}/other").write.mode("overwrite").parquet(f"{catalog.place}/payloads/{name}")
    found = catalog.recover()
    assert (found.mode, found.code) == ("baseline_only", "journal_invalid") and shown(found.entries) == [("/a.md", 1)]


def test_counts_of_touched_scopes(spark):
    rng = random.Random(8)
    keys = [f"/{a}/{b}" for a in "abc" for b in ("x", "x/1.md", "x/2.md", "y.md")] + ["/a", "/b", "/c"]
    entry = lambda k: (k, "file" if "." in k else "directory", 1)
    base = spark.createDataFrame([entry(k) for k in keys if rng.random() < 0.7], ENTRY)
    journal = spark.createDataFrame([], f"generation long, op string, {ENTRY}")
    visible = base.count()
    for g in range(1, 7):
        some = rng.sample([*keys, "/a/x.md", "/new/z.md"], 3)
        new = spark.createDataFrame([(g, rng.choice(["upsert", "remove"]), k, rng.choice(["file", "directory"]), g) for k in some], journal.schema)
        visible += journal_store.count_change(base, journal, new)
        journal = spark.createDataFrame(journal.unionByName(new).collect(), journal.schema)
        assert visible == changes.layered(base, journal).count()


def test_counts_of_all_generations_in_one_pass(spark):
    rng = random.Random(9)
    keys = [f"/{a}/{b}" for a in "abc" for b in ("x", "x/1.md", "x/2.md", "y.md")] + ["/a", "/b", "/c"]
    entry = lambda k: (k, "file" if "." in k else "directory", 1)
    base = spark.createDataFrame([entry(k) for k in keys if rng.random() < 0.7], ENTRY)
    rows = [(g, rng.choice(["upsert", "remove"]), k, rng.choice(["file", "directory"]), g) for g in (1, 2, 4, 5) for k in rng.sample([*keys, "/a/x.md", "/new/z.md"], 4)]
    journal = spark.createDataFrame(rows, f"generation long, op string, {ENTRY}")
    want = {g: changes.layered(base, journal.where(F.col("generation") <= g)).count() for g in range(1, 6)}
    assert journal_store.counts(base, journal, list(range(1, 6))) == want and len(set(want.values())) > 2


def test_directories_of_odd_keys(spark):
    keys = ["/a/b/c", "/a", "/", "", "/a//b", "/a/b/", "a/b", "\\\\a\\b", "//a", None]
    rows = spark.createDataFrame([(k,) for k in keys], "path_key string")
    d = spark.createDataFrame([("/a/b",)], "d string")
    for r in rows.select("path_key", paths.ancestors(F.col("path_key")).alias("all"), paths.directory(F.col("path_key")).alias("d")).select("path_key", "all", "d", paths.ancestors(F.col("d")).alias("above")).collect():
        assert set(r["above"] or []) == {a for a in r["all"] or [] if a != r["path_key"]}, r
    assert d.select(paths.directory(F.col("d"))).first()[0] == "/a"


def test_ancestors_are_exploded_by_directory(spark, tmp_path):
    """A thousand files of a directory meet the removals once, not once each."""
    entry = lambda n: spark.range(n).select(F.concat(F.lit("/a/b/"), F.col("id").cast("string")).alias("path_key"), F.lit("file").alias("kind"), F.col("id").alias("size_bytes"))
    entry(1000).write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    delta = spark.createDataFrame([(1, "remove", "/a/b/7", "file", 0), (2, "remove", "/a/c", "file", 0)], f"generation long, op string, {ENTRY}")
    for rows in (changes.layered(base, delta), changes.applied(base, delta), changes.under(base, delta.select("path_key"), "left_anti", told=0)):
        assert rows.count() == 999
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        exploded = plan[plan.index("Generate explode") :].splitlines()
        assert "Aggregate [__dir" in exploded[1]


@pytest.mark.parametrize("strictly", [False, True])
def test_roots_in_the_scan_and_in_a_join(spark, catalog, strictly):
    for roots in (["/pro", "/small/ring", None], [], ["/"], ["/nowhere", "/ECONOMY", "/ECONOMY"]):
        r = spark.createDataFrame([(x,) for x in roots], "path_key string")
        for how in ("left_semi", "left_anti"):
            few, many = (sorted(x.path_key for x in changes.under(catalog, r, how, strictly, told).select("path_key").collect()) for told in (100, 0))
            assert few == many
    plan = changes.under(catalog, spark.createDataFrame([("/pro",)], "path_key string"), "left_semi")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0]


@pytest.mark.parametrize("text", ['(alpha OR rare) AND (gamma "beta alpha")', "+(alpha AND x1) -(rare delta)", "NOT (beta OR gamma) alpha", '((alpha)) AND ("alpha beta" OR (delta AND gamma))', "alpha(beta)"])
def test_brackets(spark, text):
    """Of nested queries: found where the tree holds, scored by the phrases of the branches that hold."""
    q = fulltext.content_query(text)
    texts = texts_of(spark, 9, 150).where("content is not null")
    index = content_index.Index(spark, versions.new_place(spark, "index"), 16, 2)
    index.build(texts)
    rows = {r.path_key: [w for w in r.content.lower().split() if len(w.encode()) <= 40] for r in texts.collect()}
    has = lambda ws, c: any(tuple(ws[k : k + len(c)]) == c for k in range(len(ws))) if isinstance(c, tuple) else tree(ws, c)
    tree = lambda ws, c: (not c.groups or any(all(has(ws, x) for x in g) for g in c.groups)) and all(has(ws, x) for x in c.must) and not any(has(ws, x) for x in c.never)
    scan = fulltext.bm25(texts, q, "path_key").orderBy(F.desc("score"), "path_key").collect()
    assert {r.path_key for r in scan} == {k for k, ws in rows.items() if tree(ws, q)}
    assert scored(index.top(q, 1000)) == [(r.path_key, r.score) for r in scan]


@pytest.mark.parametrize("text", ["(alpha", "alpha)", "()", "(alpha AND)", "(-alpha)", "alpha AND ()"])
def test_broken_brackets(text):
    with pytest.raises(fulltext.InvalidQuery):
        fulltext.content_query(text)


# ---------------------------------------------------------------- catalog state


def test_states_of_generations(spark):
    state = catalog_state.CatalogState(spark, versions.new_place(spark, "state"))
    rows = spark.createDataFrame([("/r", None, "/r", 1), ("/r/a", "/r", "/r", 2)], catalog_state.MANIFEST)
    assert not state.set_state(1, "prepared", 1) and not state.set_fingerprint(1, "x") and not state.set_manifest(1, rows, 1)
    assert state.set_state(1, "building", 1, "/r") and not state.set_manifest(1, rows, 2) and not state.set_state(1, "active", 2)
    assert state.set_state(1, "prepared", 3) and state.set_manifest(1, rows, 4) and state.set_fingerprint(1, "one")
    assert not state.set_manifest(1, rows.where("path_key != '/r'"), 5)  # an orphan
    assert state.active_fingerprint("/r") is None
    assert state.set_state(1, "active", 6) and state.active_fingerprint("/r") == "one"
    assert not state.set_manifest(1, rows, 7)
    assert [r.path_key for r in state.manifest(1).orderBy("path_key").collect()] == ["/r", "/r/a"]
    assert state.set_state(2, "prepared", 8, "/r") and state.set_state(2, "active", 9)
    found = state.record()
    assert (found["generations"]["1"]["state"], found["active"]) == ("obsolete", {"/r": 2})
    assert state.manifest(2).count() == 0
    state.save_counters("/r", scanned=5, failed=1)
    state.save_counters("/r", failed=2)
    assert state.record()["counters"] == {"/r": {"scanned": 5, "failed": 2}}


def test_prepared_at_the_time_of_the_change(spark, monkeypatch):
    """A generation that is published while its manifest is being written keeps its old one."""
    state = catalog_state.CatalogState(spark, versions.new_place(spark, "state"))
    rows = spark.createDataFrame([("/r", None, "/r", 1)], catalog_state.MANIFEST)
    state.set_state(1, "prepared", 1, "/r")
    put, other = state.state.put, catalog_state.CatalogState(spark, state.place)

    def late(version, record):
        monkeypatch.setattr(state.state, "put", put)
        other.set_state(1, "active", 2)
        return put(version, record)

    monkeypatch.setattr(state.state, "put", late)
    assert not state.set_manifest(1, rows, 3) and state.manifest(1).count() == 0


def test_manifest_of_another_state_is_not_evaluated(spark):
    state = catalog_state.CatalogState(spark, versions.new_place(spark, "state"))
    rows = spark.createDataFrame([("/r", None, "/r", 1)], catalog_state.MANIFEST)
    failing = rows.withColumn("modified_ms", F.raise_error(F.lit("evaluated")).cast("long"))
    assert state.set_state(1, "building", 1, "/r") and not state.set_manifest(1, failing, 2)
    assert state.set_state(1, "prepared", 3) and not state.set_manifest(1, rows.withColumn("path_key", F.lit("/q")), 4) and state.set_manifest(1, rows, 5)
    assert [tuple(r) for r in state.manifest(1).collect()] == [("/r", None, "/r", 1)]


def test_attached_index(spark, catalog):
    state = catalog_state.CatalogState(spark, versions.new_place(spark, "state"))
    q = fulltext.content_query("alpha")
    assert state.content_search(catalog, q, 5).count() == 0 and state.detach() is None
    texts = catalog.where("kind = 'file'").selectExpr("path_key", "'alpha beta' as content")
    places = []
    for ext in ("md", "json"):
        index = content_index.Index(spark, versions.new_place(spark, "index"))
        index.build(texts)
        states = catalog.where(f"extension = '{ext}'").selectExpr("path_key", "'indexed' as state")
        assert state.attach(index.place, states)
        places.append(index.place)
        hits = [r.path_key for r in state.content_search(catalog, q, 1000).collect()]
        assert sorted(hits) == sorted(r.path_key for r in states.collect())
    assert state.detach() == places[1]
    assert state.entries(catalog).where("content_index_state = 'indexed'").count() == 0


# ---------------------------------------------------------------- many requests


def test_many_requests_are_each_as_alone(spark, catalog):
    index = name_index.NameIndex(spark, versions.new_place(spark, "names"), 32)
    index.build(catalog)
    typed = ["ring", "red", "pro", "r", "rg", "zzz", "brand-1", "small ring", "ring red dir:pro", "type:.MD", "name:ring", "name:x type:pdf", "dir:brand-1", "dir:deep name:report", "ring type:json dir:economy", "ring ring", "RING", "straße", "a.b", "small type:md type:pdf", "dir:*red* ring", "/red/", "", "content:x ring", "dir:bnd"]
    asked = spark.createDataFrame([(t,) for t in typed], "key string").withColumn("asked", batch_search.fields("key"))
    answered = {r.key for r in asked.where(batch_search.plain(F.col("asked"))).collect()}
    assert set(typed) - answered == {"dir:*red* ring", "/red/", "", "content:x ring"}
    for limit in (3, 1000):
        got = {}
        for r in batch_search.search_many(index, asked, limit).orderBy("key", "place").collect():
            got.setdefault(r.key, []).append(r.path)
        for t in answered:
            assert got.get(t, []) == [r.path for r in search.search(catalog, file_query(t), limit).collect()], (t, limit)
    assert batch_search.search_many(index, asked.limit(0)).count() == 0
