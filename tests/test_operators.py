"""Sources, streams and rules on inputs of a few rows, against what is plainly right."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.text import command_safety
from lodestrata.operators import changes, fulltext, postings, requests, search, versions
from lodestrata.operators.search import FileQuery
from lodestrata.registry import parts
from lodestrata.sources import tree
from lodestrata.streaming import debounce, updates

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text, want",
    [
        ("", FileQuery()),
        ('report "annual plan" type:.PDF', FileQuery(terms=("report", "annual plan"), types=("pdf",))),
        ("name: draft dir:work/src content:“two words”", FileQuery(names=("draft",), dirs=("work/src",), contents=("two words",))),
        ("TYPE:Md http://x other:thing", FileQuery(terms=("http://x", "other:thing"), types=("md",))),
        ("type: ", FileQuery(terms=("type:",))),
        ('a"b c"d "" open "till the end', FileQuery(terms=("ab cd", "open", "till the end"))),
        ("dir: name:x", FileQuery(dirs=("name:x",))),
    ],
)
def test_fields(text, want):
    assert requests.file_query(text) == want


@pytest.mark.parametrize(
    "text, want",
    [("1+2*3", "7"), ("-2^2", "4"), ("2^3^2", "512"), ("10%3", "0.0099700897"), ("sqrt(16) / 0x10", "0.25"), ("(1+2", None), ("abc", None), ("7", "7"), ("1/0", None), ("2 3", None), ("1e3", None), (".5*4", "2"), ("", None), ("--3", "3"), ("sqrt(0-1)", None), ("50%", "0.5")],
)
def test_calculator(text, want):
    value = requests.calculated(text)
    assert (None if value is None else requests.number_text(value)) == want


@pytest.mark.parametrize("most", [search.SEGMENTS, 0, 2])
@pytest.mark.parametrize("query", [FileQuery(terms=("ring",)), FileQuery(terms=("econ",)), FileQuery(dirs=("brand-",)), FileQuery(terms=("bolt", "sml"), dirs=("brand-1",)), FileQuery(terms=("zzz",)), FileQuery(dirs=("bnd",))])
def test_both_ways_to_candidates(spark, query, most):
    """Few segments are tested in the scan, many are joined; a plain version beside both."""
    e = parts(spark, SF).cache()
    rows = e.orderBy("path_key").collect()
    low = lambda x: x.lower()
    filed = {r.path_key: [s for s in r.path.split("/") if s][: None if r.kind == "directory" else -1] for r in rows}
    first = {}
    for r in rows:
        for s in filed[r.path_key]:
            first.setdefault(low(s), s)

    def segments(t, both):
        precise = {s for s in first if s == t} or {s for s in first if s.startswith(t)}
        fuzzy = {s for s, w in first.items() if w[0] == t[0] and {c for c in t if "a" <= c <= "z"} <= set(s)}
        return precise | fuzzy if both else precise or fuzzy

    def near(t, s):
        m = re.match(search.fuzzy_pattern(t), s)
        return s.startswith(t) or bool(m) and len(m[0]) <= max(2 * len(t), 8)

    def good(r):
        under = {low(s) for s in filed[r.path_key]}
        parts_ = [s for s in re.split(r"[\W_]+", low(r.name)) if s] + [s for s in low(r.path).split("/") if s]
        return all((t[:3] in low(r.name) or under & segments(t, True)) and (t in low(r.name) or any(near(t, s) for s in parts_)) for t in query.terms) and all(under & segments(d, False) and d in low(r.parent) for d in query.dirs)

    want = {r.path for r in rows if good(r)}
    assert {r.path for r in search.search(e, query, 10**6, most=most).collect()} == want


def test_bad_pattern_is_feedback(spark):
    assert [r.kind for r in search.regex_results(parts(spark, SF), "*bad").collect()] == ["feedback"]
    assert search.regex_results(parts(spark, SF), "ring", 3).count() == 3


@pytest.mark.parametrize("text", ["(a b", '"open', "a AND", "NOT", "", "-x", "...."])
def test_invalid_content_queries(text):
    with pytest.raises(fulltext.InvalidQuery):
        fulltext.content_query(text)


def test_content_queries():
    q = fulltext.content_query
    assert q("Hello world").groups == ((("hello",),), (("world",),))
    assert q('a AND "b c" OR d').groups == ((("a",), ("b", "c")), (("d",),))
    assert (q("+a b -c NOT d").must, q("+a b -c NOT d").never) == ((("a",),), (("c",), ("d",)))


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("*.log", ["a.log", "x/y/b.log"], ["a.logs", "log"]),
        ("/build", ["build"], ["x/build"]),
        ("docs/*.md", ["docs/a.md"], ["docs/x/a.md", "y/docs/a.md"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["a/xb"]),
        ("tmp/", ["tmp", "x/tmp"], ["tmpx"]),
        ("**/logs", ["logs", "x/logs"], ["xlogs"]),
        ("out/**", ["out/a", "out/a/b"], ["out"]),
        ("f[0-9]?", ["f1x", "z/f2y"], ["fax", "f1", "f1/x"]),
        ("x[!a]", ["xb"], ["xa"]),
        (r"\#a", ["#a"], ["a"]),
    ],
)
def test_ignore_patterns(pattern, yes, no):
    found = re.compile(changes.ignore_regex(pattern))
    assert all(found.match(p) for p in yes) and not any(found.match(p) for p in no)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    rng = random.Random(1)
    for k in range(60):
        place = top / "/".join(f"d{rng.randrange(4)}" for _ in range(rng.randint(1, 5)))
        place.mkdir(parents=True, exist_ok=True)
        (place / f"f{k}.txt").write_bytes(b"x" * k)
    (top / "d0").mkdir(exist_ok=True)
    (top / "d0" / ".gitignore").write_text("# no\nf*.txt\n!f1*.txt\n")
    os.symlink(top, top / "loop")
    return str(top)


def walked(top):
    out = {}
    for base, dirs, files in os.walk(top):
        for d in dirs:
            out[f"{base}/{d}"] = None if os.path.islink(f"{base}/{d}") else "directory"
        out |= {f"{base}/{f}": None for f in files}
    return out


def test_tree(spark, folder):
    rows = tree.read_tree(spark, folder).collect()
    assert len(rows) == len(walked(folder)) and {r.path: r.kind for r in rows} == walked(folder)
    assert all(r.failure is None and (r.kind or r.size_bytes == os.lstat(r.path).st_size) for r in rows)
    inside = {r.path for r in tree.read_tree(spark, folder, f"{folder}/d1").collect()}
    assert inside == {p for p in walked(folder) if p == f"{folder}/d1" or p.startswith(f"{folder}/d1/")}
    with pytest.raises(Exception, match="outside"):
        tree.read_tree(spark, folder, "/etc").collect()


def test_levels_go_on_where_they_stopped(spark, folder, tmp_path):
    some = tree.scan_by_levels(spark, folder, str(tmp_path), levels=2)
    assert some.count() < len(walked(folder))
    stamp = os.path.getmtime(tmp_path / "listed-0" / "_SUCCESS")
    rows = tree.scan_by_levels(spark, folder, str(tmp_path))
    assert {r.path: r.kind for r in rows.collect()} == walked(folder)
    assert os.path.getmtime(tmp_path / "listed-0" / "_SUCCESS") == stamp


def test_unreadable_directories_are_failures(spark, tmp_path):
    out = tree.listed(spark.createDataFrame([("/", str(tmp_path)), ("/", str(tmp_path / "gone"))], "root string, directory_key string")).collect()
    assert {r.directory_key: r.ok for r in out} == {str(tmp_path): True, str(tmp_path / "gone"): False}
    assert [r for r in out if not r.ok][0].rows[0].failure


def test_ignore_files_of_a_tree(spark, folder):
    rows = tree.read_tree(spark, folder).select(F.col("path").alias("path_key"), "kind")
    rules = changes.ignore_rules(tree.ignore_files(tree.read_tree(spark, folder)))
    gone = {r.path_key for r in changes.ignore_decisions(rows, rules).where("ignored").collect()}
    want = {p for p, kind in walked(folder).items() if p.startswith(f"{folder}/d0/") and re.search(r"/f[^/]*\.txt$", p) and not re.search(r"/f1[^/]*$", p)}
    assert gone == want


def test_ignore_rules_go_to_the_rows(spark, tmp_path, monkeypatch):
    spark.range(2000).select(F.concat(F.lit("/top/d"), F.col("id") % 7, F.lit("/f"), "id").alias("path_key"), F.lit("file").alias("kind")).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")  # a small file, whose exploded rows Spark would take for small too
    rules = changes.ignore_rules(spark.createDataFrame([("/top", "gitignore", 1, "d3/"), ("/top/d3", "ignore", 1, "!f3"), ("/top", "gitignore", 2, "*9")], "dir_key string, source string, line int, text string"))
    few = changes.ignore_decisions(rows, rules)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    monkeypatch.setattr(changes, "TOLD_ROOTS", 1)
    many = changes.ignore_decisions(rows, rules)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == sorted((f"/top/d{k % 7}/f{k}", k % 7 == 3 or k % 10 == 9) for k in range(2000))


def test_grams_are_counted_and_found_without_all_of_them(spark):
    names = ["aaa", "abAB", "", "x", None, "Ä\U0001F600Ä\U0001F600", "straße.md"]
    rows = spark.createDataFrame([(f"/Top/d{k % 2}/{n}", f"/Top/d{k % 2}/{n}", n, "file") for k, n in enumerate(names)], "path_key string, path string, name string, kind string")
    grams, segments = postings.name_grams(rows), postings.path_segments(rows)
    assert sorted(map(tuple, postings.gram_counts(rows).collect())) == sorted(map(tuple, grams.groupBy("gram").count().collect()))
    of = lambda df: sorted(r.path_key for r in df.collect())
    for gram in ("a", "ab", "aaa", "\U0001F600Ä", "", "strá", "stra"):
        assert of(postings.with_gram(rows, gram)) == of(postings.holding(grams, "gram", gram)), gram
    for segment in ("top", "d1", "Top", "x"):
        assert of(postings.with_segment(rows, segment)) == of(postings.holding(segments, "segment", segment)), segment


def test_contents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "c.bad").write_bytes(b"\xff\xfe")
    (tmp_path / "d.big").write_text("x" * 100)
    out = {os.path.basename(r.path): (r.state, r.content) for r in tree.read_contents(spark, str(tmp_path), 50).collect()}
    assert out == {"a.txt": ("indexed", "héllo"), "b.bin": ("skipped_binary", None), "c.bad": ("skipped_binary", None), "d.big": ("skipped_too_large", None)}


def debounced(times, quiet, cap):
    out = []
    for t in sorted(times):
        if out and t < min(out[-1][1] + quiet, out[-1][0] + cap):
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


def test_debounce_across_arrow_batches(spark):
    rng = random.Random(3)
    times = {k: [rng.randrange(200_000) for _ in range(n)] for k, n in (("hot", 3000), ("a", 50), ("b", 1))}
    events = spark.createDataFrame([(k, t) for k, v in times.items() for t in v], "key string, ms long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(map(tuple, debounce.batches(events).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted((k, *b) for k, v in times.items() for b in debounced(v, 5000, 10_000))


def test_debounce_stream_and_commits(spark, tmp_path):
    """The stream gives the batches that are closed by the end; a commit for each micro-batch."""
    rows = [("a", 10**9 + ms) for ms in (0, 1000, 2000, 9000, 9500, 40_000)] + [("z", 10**9 + 500_000)]
    spark.createDataFrame(rows, "key string, ms long").withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("key string, ms long, ts timestamp").parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    seen = {}
    q = updates.committing(debounce.stream(events), lambda df, generation: seen.__setitem__(generation, [tuple(r) for r in df.collect()]), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = sorted(r for v in seen.values() for r in v)
    closed = [("a", *b) for b in debounced([ms for k, ms in rows if k == "a"], 5000, 10_000)]
    assert got and set(got) <= set(closed) and set(closed[:-1]) <= set(got)


def test_a_removed_directory_hides_and_a_file_replaces_it(spark):
    base = spark.createDataFrame([("/d", "directory"), ("/d/a", "file"), ("/d/b", "file"), ("/e", "file")], "path_key string, kind string")
    deltas = spark.createDataFrame(
        [(1, "upsert", "/d/c", "file"), (2, "upsert", "/d", "file"), (3, "upsert", "/d", "directory"), (3, "upsert", "/d/n", "file"), (4, "remove", "/e", "file"), (5, "upsert", "/e", "file")],
        "generation long, op string, path_key string, kind string",
    )
    assert {r.path_key for r in changes.layered(base, deltas).collect()} == {"/d", "/d/n", "/e"}
    assert {r.path_key for r in changes.applied(base, deltas).collect()} == {"/d", "/d/a", "/d/b", "/d/c", "/d/n", "/e"}


def test_unfinished_batches_do_not_count(spark, tmp_path):
    e = parts(spark, SF).limit(10)
    versions.write_batch(e, str(tmp_path), 1, 5)
    e.write.partitionBy("root").parquet(f"{tmp_path}/entries/batch_id=2")
    assert {r.batch_id for r in versions.read_batches(spark, str(tmp_path)).collect()} == {1}


def test_highlights_of_every_term():
    assert fulltext.highlight_terms('Foo:"bar_x" (+baz) -«q» ...') == ["foo", "bar_x", "baz", "q"]


def test_request_modes_on_their_borders(spark):
    typed = [
        ("re: a.*b ", "regex", None, "a.*b"), ("> ls -l", "command", None, "ls -l"), ("g spark  sql", "web", "g", "spark  sql"), ("ddg:privacy", "web", "ddg", "privacy"), (" g ", "normal", None, "g"),
        ("plain words", "normal", None, "plain words"), (" bd  x y ", "web", "bd", "x y"), ("gone with", "normal", None, "gone with"), ("re:", "regex", None, ""), ("g:", "web", "g", ""), ("", "normal", None, ""),
    ]
    rows = spark.createDataFrame([(t,) for t, *_ in typed], "t string").select("t", requests.request(F.col("t")).alias("r")).select("t", "r.*")
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == sorted(map(str, typed))


def test_command_safety_on_its_borders(spark):
    commands = [("rm -rf /", "blocked"), (" RM -rf / ", "blocked"), ("rm -rf /*", "blocked"), ("rm -rf / tmp", "blocked"), ("rm -rf /home/x", "allow"), ("farm x", "allow"), ("shutdown now", "allow"), ("sudo ls", "strong"), ("sudo", "allow"), ("mkfs.ext4 /dev/sda", "strong"), ("echo mkfs", "strong"), ("xmkfs", "allow"), ("DiskPart /s", "strong"), ("cd && diskpart", "strong"), ("ls -l", "allow")]
    rows = spark.createDataFrame(commands, "c string, want string").select("c", "want", command_safety(F.col("c")).alias("got")).collect()
    assert all(r.got == r.want for r in rows), rows
