"""Queries of what is typed, content, journals, versions, scans and updates, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import calibration, catalog, changes, entries, fulltext, journal, requests, rows, search, versions
from .operators.search import FileQuery
from .queries import _DELTA, _GEN, _LATER, _LAYERED, _TOK, deltas, generations, last_deltas, later_scan, opened
from .registry import docs, parts, query, table
from .streaming import updates

# ---------------------------------------------------------------- what is typed

#: What is typed around a part's name, and mode, prefix and text of that.
TYPED = (("re: ", " ", "regex", None, ""), ("> ", "", "command", None, ""), ("g ", "", "web", "g", ""), ("ddg:", " ", "web", "ddg", ""), (" ", "  ", "normal", None, ""), ("gone ", "", "normal", None, "gone "))
_TYPED_SQL = "CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN {{'mode': '{m}', 'prefix': {f"'{p}'" if p else 'NULL'}, 'text': '{t}' || p_name}}" for k, (_, _, m, p, t) in enumerate(TYPED)) + " END"


@query(f"SELECT p_partkey, x.mode, x.prefix, x.text FROM (SELECT p_partkey, {_TYPED_SQL} AS x FROM part)")
def request_modes(spark, sf):
    typed = F.concat(entries.picked(F.col("p_partkey"), tuple(a for a, *_ in TYPED)), "p_name", entries.picked(F.col("p_partkey"), tuple(b for _, b, *_ in TYPED)))
    return table(spark, sf, "part").select("p_partkey", requests.request(typed).alias("r")).select("p_partkey", "r.*")


@query(
    """SELECT p_partkey AS key, 'calculator:' || p_size || '*' || p_partkey || '+0x10' AS id, (p_size * p_partkey + 16)::VARCHAR AS title, 900::BIGINT AS score, 'copy:' || (p_size * p_partkey + 16) AS action FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'web:g:' || p_name, 'Google: ' || p_name, 800, 'open_url:https://www.google.com/search?q=' || replace(p_name, ' ', '%20') FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, 'command:' || p_name, p_name, 850, 'confirm:' || p_name FROM part WHERE p_partkey % 3 = 2"""
)
def provider_answers(spark, sf):
    number = F.col("p_partkey").cast("string")
    typed = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("*"), number, F.lit("+0x10"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("g "), "p_name")).otherwise(F.concat(F.lit("> "), "p_name"))
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), requests.request(typed).alias("r")).select("key", "r.*")
    return requests.answers(asked, commands=True).select("key", "id", "title", "score", "action")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE regexp_replace(regexp_replace(printf('%.10f', (-p_size)::DOUBLE ** 2 / 100 / 8 + p_partkey), '0+$', ''), '[.]$', '') END AS value FROM part")
def calculator_values(spark, sf):
    size, number = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(F.lit("-"), size, F.lit("^2% / 8 + ("), number, F.lit(")"))
    broken = F.concat(text, F.when(F.col("p_partkey") % 10 == 0, " +").otherwise(" 3x"))
    return table(spark, sf, "part").select("p_partkey", requests.calculator(F.when(F.col("p_partkey") % 5 == 0, broken).otherwise(text)).alias("value"))


# ---------------------------------------------------------------- content of the catalog

_CONTENT = f"""tok AS ({_TOK}), len AS (SELECT doc_id, sum(tf)::DOUBLE AS dl FROM tok GROUP BY 1), c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM len) / (SELECT count(*) FROM documents) AS avgdl),
df AS (SELECT term, count(*) AS df FROM tok WHERE term IN ('idiot', 'pathetic') GROUP BY 1),
s AS (SELECT '/corpus/' || lang || '/' || source || '/doc-' || doc_id || '.' || {entries._EXT}[doc_id % 7 + 1] AS path, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM tok JOIN df USING (term) JOIN len USING (doc_id) JOIN documents USING (doc_id), c GROUP BY 1)"""


def catalog_with_texts(spark, sf):
    """The documents' catalog, of which some files are indexed, and their texts by path."""
    e = docs(spark, sf).withColumn("content_index_state", F.when(F.col("extension").isin("md", "txt", "json"), "indexed").otherwise("not_indexed"))
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit("."), entries.picked(F.col("doc_id")))
    return e, d.select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))


@query(entries.DOCUMENTS_SQL + f", {_CONTENT} SELECT 'path:' || t.path AS id, name AS title, round(1000 * score)::BIGINT AS score FROM (SELECT * FROM s ORDER BY score DESC, path LIMIT 20) t JOIN entries e ON e.path = t.path AND extension IN ('md', 'txt', 'json')")
def content_only(spark, sf):
    e, t = catalog_with_texts(spark, sf)
    return fulltext.content_search(e, t, FileQuery(contents=("idiot", "pathetic"))).select("id", "title", "score")


@query(entries.DOCUMENTS_SQL + f", {_CONTENT}, found AS (SELECT path, name FROM entries WHERE extension = 'md' ORDER BY path_key LIMIT 400) SELECT 'path:' || t.path AS id, name AS title, (round(1000 * score) + 10000)::BIGINT AS score FROM (SELECT * FROM s WHERE path IN (SELECT path FROM found) ORDER BY score DESC, path LIMIT 400) t JOIN found USING (path)")
def content_and_name(spark, sf):
    e, t = catalog_with_texts(spark, sf)
    return fulltext.content_search(e, t, requests.file_query('type:md content:"idiot pathetic"'), 400).select("id", "title", "score")


@query(
    """WITH t AS (SELECT '/corpus/' || lang || '/' || source || '/d' || doc_id AS path_key, doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT path_key, n FROM t WHERE NOT starts_with(path_key, '/corpus/de/') AND path_key != '/corpus/en/src1' AND NOT starts_with(path_key, '/corpus/en/src1/') AND doc_id % 50 != 0 UNION ALL SELECT path_key, 3 FROM t WHERE doc_id % 50 = 0 AND doc_id % 100 = 0"""
)
def content_delta(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    key = F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string"))
    t = d.select(key.alias("path_key"), F.col("text").alias("content"))
    changed = d.where("doc_id % 50 = 0").select(key.alias("path_key"), F.when(F.col("doc_id") % 100 == 0, "new").alias("content"))
    gone = spark.createDataFrame([("/corpus/de",), ("/corpus/en/src1",)], "path_key string")
    return fulltext.content_delta(t, gone, changed).select("path_key", F.length("content").alias("n"))


# ---------------------------------------------------------------- journal

_JOURNAL = """b AS (SELECT o_orderkey AS id, o_orderkey AS generation, CASE o_orderstatus WHEN 'O' THEN 'building' ELSE 'committed' END AS status, md5(o_totalprice::DECIMAL(12, 2)::VARCHAR) AS digest FROM orders),
ch AS (SELECT l_orderkey AS batch_id, (l_linenumber - 1 + CASE WHEN l_orderkey % 10 = 3 THEN 1 ELSE 0 END)::BIGINT AS ordinal, CASE WHEN l_suppkey % 50 = 0 THEN 'move' WHEN l_returnflag = 'A' THEN 'remove' ELSE 'upsert' END AS op,
  CASE WHEN l_partkey % 40 = 0 THEN '' ELSE '/orders/s' || (l_suppkey % 20) || CASE WHEN l_returnflag = 'A' THEN '' ELSE '/p' || (l_partkey % 100) END END AS path_key, l_quantity::BIGINT AS size_bytes FROM lineitem)"""


def order_batches(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "building").otherwise("committed")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("generation"), status.alias("status"), F.md5(F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("digest"))


def order_changes(spark, sf):
    item = table(spark, sf, "lineitem")
    gone = F.col("l_returnflag") == "A"
    ordinal = F.col("l_linenumber") - 1 + F.when(F.col("l_orderkey") % 10 == 3, 1).otherwise(0)
    op = F.when(F.col("l_suppkey") % 50 == 0, "move").when(gone, "remove").otherwise("upsert")
    key = F.concat(F.lit("/orders/s"), (F.col("l_suppkey") % 20).cast("string"), F.when(gone, "").otherwise(F.concat(F.lit("/p"), (F.col("l_partkey") % 100).cast("string"))))
    return item.select(F.col("l_orderkey").alias("batch_id"), ordinal.cast("long").alias("ordinal"), op.alias("op"), F.when(F.col("l_partkey") % 40 == 0, "").otherwise(key).alias("path_key"), F.col("l_quantity").cast("long").alias("size_bytes"))


def order_journal(spark, sf, after=-1):
    return journal.committed_after(order_batches(spark, sf), order_changes(spark, sf), after)


@query(f"WITH {_JOURNAL} SELECT generation, ordinal, op, path_key FROM b LEFT JOIN ch ON batch_id = id WHERE status = 'committed' AND generation > 500")
def journal_committed(spark, sf):
    return order_journal(spark, sf, 500).select("generation", "ordinal", "op", "path_key")


@query(
    f"""WITH {_JOURNAL}, r AS (SELECT generation, ordinal, op, path_key FROM b JOIN ch ON batch_id = id WHERE status = 'committed')
SELECT generation, 'ordinal_gap' AS fault FROM r GROUP BY 1 HAVING min(ordinal) != 0 OR max(ordinal) != count(*) - 1 OR count(DISTINCT ordinal) != count(*)
UNION ALL SELECT DISTINCT generation, 'bad_operation' FROM r WHERE op NOT IN ('upsert', 'remove') UNION ALL SELECT DISTINCT generation, 'missing_path' FROM r WHERE path_key = ''
UNION ALL SELECT DISTINCT generation, 'repeated_path' FROM (SELECT generation, path_key FROM r WHERE path_key != '' GROUP BY 1, 2 HAVING count(*) > 1)"""
)
def journal_faults(spark, sf):
    return journal.faults(order_journal(spark, sf))


@query(f"WITH {_JOURNAL}, i AS (SELECT generation + CASE WHEN generation % 3 = 0 THEN 10000000 ELSE 0 END AS generation, CASE WHEN generation % 7 = 0 THEN 'other' ELSE digest END AS digest FROM b) SELECT i.generation, CASE WHEN b.status IS NULL THEN 'append' WHEN b.status != 'committed' THEN 'unfinished' WHEN b.digest = i.digest THEN 'done' ELSE 'conflict' END AS decision FROM i LEFT JOIN b ON i.generation = b.generation")
def commit_decisions(spark, sf):
    b, g = order_batches(spark, sf), F.col("generation")
    return journal.commit_decisions(b, b.select((g + F.when(g % 3 == 0, 10_000_000).otherwise(0)).alias("generation"), F.when(g % 7 == 0, "other").otherwise(F.col("digest")).alias("digest")))


@query("WITH d AS (SELECT o_custkey AS generation, o_orderpriority AS digest FROM orders) SELECT generation, count(*)::BIGINT AS n, min(digest) != max(digest) AS conflict FROM d GROUP BY 1")
def unique_deltas(spark, sf):
    return journal.unique_deltas(table(spark, sf, "orders").select(F.col("o_custkey").alias("generation"), F.col("o_orderpriority").alias("digest")))


@query("WITH g AS (SELECT DISTINCT o_custkey AS generation FROM orders WHERE o_custkey > 20) SELECT generation FROM g WHERE generation != 21 AND generation - 1 NOT IN (SELECT generation FROM g)")
def missing_generations(spark, sf):
    return journal.missing_generations(table(spark, sf, "orders").select(F.col("o_custkey").alias("generation")), 20)


@query("SELECT CASE i WHEN 0 THEN 'replayed' ELSE 'baseline_only' END AS mode, [NULL, 'journal_invalid', 'journal_gap', 'manifest_invalid'][i + 1] AS code FROM range(4) t(i)")
def recovery_modes(spark, sf):
    """Of a sound journal, one with faults, one with gaps, and with a faulty manifest."""
    m = changes.manifest_of(parts(spark, sf))
    none, some = changes.manifest_faults(m), changes.manifest_faults(m.where("path_key != '/parts/SMALL'"))
    d = last_deltas(spark, sf).select("generation", "op", "path_key", F.row_number().over(rows.Window.partitionBy("generation").orderBy("path_key")).alias("ordinal"))
    sound = d.withColumn("ordinal", F.col("ordinal") - 1)
    out = [journal.recovery(spark, 0, none, sound), journal.recovery(spark, 0, none, d), journal.recovery(spark, 0, none, sound.where("generation != 5")), journal.recovery(spark, 0, some, sound)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"WITH {_JOURNAL} SELECT generation, ordinal, op, path_key FROM b JOIN ch ON batch_id = id WHERE status = 'committed' AND path_key IN ('/orders/s3', '/orders/s3/p7', '/orders/s4', '/orders', '/orders/s4/p8')")
def targeted_changes(spark, sf):
    keys = spark.createDataFrame([("/orders/s3/p7",), ("/orders/s4/p8",)], "path_key string")
    return journal.targeted(order_batches(spark, sf), order_changes(spark, sf), keys, -1)


@query(
    f"""WITH {_JOURNAL}, j AS (SELECT path_key, size_bytes, generation, ordinal, op FROM b JOIN ch ON batch_id = id WHERE status = 'committed'),
x AS (SELECT path_key, size_bytes, 0 AS generation, -1 AS ordinal, 'upsert' AS op FROM (SELECT '/orders/s5/q' || (s_suppkey % 30) AS path_key, min(s_suppkey) AS size_bytes FROM supplier GROUP BY 1) UNION ALL SELECT * FROM j),
l AS (SELECT path_key, arg_max(op, (generation, ordinal)) AS op, arg_max(size_bytes, (generation, ordinal)) AS size_bytes, max(generation) AS generation FROM x WHERE regexp_matches(path_key, '^/orders/s5/[^/]*$') GROUP BY 1)
SELECT path_key, size_bytes FROM l WHERE op = 'upsert' AND generation > (SELECT coalesce(max(generation), -1) FROM j WHERE op = 'remove' AND path_key IN ('/orders/s5', '/orders', '/'))"""
)
def children_at_head(spark, sf):
    base = table(spark, sf, "supplier").groupBy(F.concat(F.lit("/orders/s5/q"), (F.col("s_suppkey") % 30).cast("string")).alias("path_key")).agg(F.min("s_suppkey").alias("size_bytes"))
    return journal.children_at_head(base, order_journal(spark, sf).where("ordinal is not null"), "/orders/s5")


# ---------------------------------------------------------------- batches, versions


@query(entries.PARTS_SQL + " SELECT path, kind, size_bytes, 7::BIGINT AS batch_id FROM entries")
def batch_round_trip(spark, sf):
    """Two batches written, of which one never gets its last row."""
    place = versions.new_place(spark, "batches")
    versions.write_batch(parts(spark, sf), place, 7, 1000)
    parts(spark, sf).write.partitionBy("root").parquet(f"{place}/entries/batch_id=8")
    return versions.read_batches(spark, place).select("path", "kind", "size_bytes", "batch_id")


_STAGED = "st AS (SELECT '/w/' || (l_partkey % 300) AS path_key, l_orderkey * 10 + l_linenumber AS seq, l_suppkey AS size_bytes FROM lineitem)"


@query(f"WITH {_STAGED}, n AS (SELECT path_key, arg_max(size_bytes, seq) AS size_bytes FROM st GROUP BY 1) SELECT path_key, size_bytes FROM n UNION ALL SELECT '/w/' || p_partkey, p_size FROM part WHERE '/w/' || p_partkey NOT IN (SELECT path_key FROM n)")
def staging_upsert(spark, sf):
    known = table(spark, sf, "part").select(F.concat(F.lit("/w/"), F.col("p_partkey").cast("string")).alias("path_key"), F.col("p_size").cast("long").alias("size_bytes"))
    new = table(spark, sf, "lineitem").select(F.concat(F.lit("/w/"), (F.col("l_partkey") % 300).cast("string")).alias("path_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_suppkey").alias("size_bytes"))
    return versions.upserted(known, new, ["path_key"], F.col("seq"))


_MANIFEST = "m AS (SELECT '/r' || (s_suppkey % 10) || '/d' || s_suppkey AS path_key, '/r' || (s_suppkey % 10) AS root, s_nationkey AS modified_ms FROM supplier)"


def supplier_manifest(spark, sf):
    root = F.concat(F.lit("/r"), (F.col("s_suppkey") % 10).cast("string"))
    return table(spark, sf, "supplier").select(F.concat(root, F.lit("/d"), F.col("s_suppkey").cast("string")).alias("path_key"), root.alias("root"), F.col("s_nationkey").cast("long").alias("modified_ms"))


@query(f"WITH {_MANIFEST} SELECT path_key, root, modified_ms::BIGINT AS modified_ms FROM m WHERE root NOT IN ('/r3', '/r4') UNION ALL SELECT DISTINCT root || '/new', root, 5 FROM m WHERE root IN ('/r3', '/r4')")
def manifest_replace_roots(spark, sf):
    m = supplier_manifest(spark, sf)
    new = m.where("root in ('/r3', '/r4')").select(F.concat("root", F.lit("/new")).alias("path_key"), "root", F.lit(5).cast("long").alias("modified_ms"))
    return versions.replaced_roots(m, new)


@query(entries.PARTS_SQL + " SELECT path_key, CASE WHEN extension = 'md' THEN 'indexed' WHEN extension = 'pdf' THEN 'unsupported' ELSE 'not_indexed' END AS content_index_state FROM entries")
def content_states(spark, sf):
    e = parts(spark, sf)
    told = e.where("extension in ('md', 'pdf')").select("path_key", F.when(F.col("extension") == "md", "indexed").otherwise("unsupported").alias("state"))
    return versions.with_content_states(e, told).select("path_key", "content_index_state")


_META = """bt AS (SELECT o_orderkey AS id, '/root-' || (o_custkey % 40) AS root, CASE o_orderstatus WHEN 'O' THEN 'building' ELSE 'completed' END AS status, epoch_ms(o_orderdate) AS completed_at_ms FROM orders),
md AS (SELECT o_orderkey AS batch_id, o_orderpriority AS config_fingerprint FROM orders WHERE o_orderkey % 2 = 0), sg AS (SELECT DISTINCT l_orderkey AS batch_id FROM lineitem WHERE l_returnflag = 'R'),
rt AS (SELECT '/root-' || (o_custkey % 40) AS root, max(o_orderkey) AS active_id FROM orders WHERE o_custkey % 40 < 20 GROUP BY 1)"""


def meta(spark, sf):
    """batches, metadata, staging and the runtime's rows."""
    o = table(spark, sf, "orders")
    root = F.concat(F.lit("/root-"), (F.col("o_custkey") % 40).cast("string"))
    status = F.when(F.col("o_orderstatus") == "O", "building").otherwise("completed")
    batches = o.select(F.col("o_orderkey").alias("id"), root.alias("root"), status.alias("status"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("completed_at_ms"))
    metadata = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("batch_id"), F.col("o_orderpriority").alias("config_fingerprint"))
    staging = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("batch_id"))
    runtime = o.where("o_custkey % 40 < 20").groupBy(root.alias("root")).agg(F.max("o_orderkey").alias("active_id"))
    return batches, metadata, staging, runtime


@query(f"WITH {_META}, {_GEN} SELECT batch_id, bt.root, status, state FROM sg JOIN bt ON bt.id = batch_id JOIN g ON g.id = batch_id")
def staging_batches(spark, sf):
    batches, _, staging, _ = meta(spark, sf)
    return versions.staging_batches(staging, batches, generations(spark, sf))


@query(f"WITH {_META} SELECT rt.root, active_id AS id, completed_at_ms, config_fingerprint FROM rt JOIN bt ON bt.id = active_id AND status = 'completed' JOIN md ON md.batch_id = active_id")
def active_batch(spark, sf):
    batches, metadata, _, runtime = meta(spark, sf)
    return versions.active_batches(runtime, batches, metadata)


@query(f"WITH {_META}, {_GEN} SELECT g.id, state, status, completed_at_ms FROM g JOIN bt USING (id)")
def generation_records(spark, sf):
    return versions.generation_records(generations(spark, sf), meta(spark, sf)[0])


@query(
    f"""WITH {_META}, nw AS (SELECT root, arg_max(id, (completed_at_ms, id)) AS newest_id FROM bt WHERE status = 'completed' GROUP BY 1),
r AS (SELECT bt.id, bt.root, coalesce(config_fingerprint, '') AS config_fingerprint, CASE WHEN bt.id = coalesce(active_id, newest_id) THEN 'active' WHEN status = 'building' AND sg.batch_id IS NOT NULL THEN 'building' ELSE 'obsolete' END AS state, completed_at_ms AS updated_at_ms
  FROM bt LEFT JOIN md ON md.batch_id = bt.id LEFT JOIN sg ON sg.batch_id = bt.id LEFT JOIN nw ON nw.root = bt.root LEFT JOIN rt ON rt.root = bt.root)
SELECT id, root, config_fingerprint, CASE WHEN state = 'building' AND id != (SELECT arg_max(id, (updated_at_ms, id)) FROM r x WHERE x.root = r.root AND x.state = 'building') THEN 'obsolete' ELSE state END AS state, updated_at_ms FROM r"""
)
def generation_backfill(spark, sf):
    return versions.backfilled(*meta(spark, sf))


@query(f"WITH {_GEN} SELECT l_orderkey AS batch_id, l_linenumber::INT AS line FROM lineitem WHERE l_orderkey IN (SELECT id FROM g WHERE state = 'obsolete')")
def obsolete_entries(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").cast("int").alias("line"))
    return versions.entries_of_obsolete(e, generations(spark, sf))


@query(f"WITH {_GEN} SELECT id, root FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY updated_at_ms DESC, id DESC) AS n FROM g) WHERE n > 3 AND id NOT IN (SELECT id FROM g WHERE state = 'active')")
def keep_newest(spark, sf):
    g = generations(spark, sf)
    return versions.beyond_newest(g, "root", [F.desc("updated_at_ms"), F.desc("id")], 3, g.where("state = 'active'")).select("id", "root")


_CHOSEN = "ch AS (SELECT root, max(id) AS new_id FROM g WHERE state = 'prepared' OR id % 5 = 0 GROUP BY 1), ok AS (SELECT ch.root, new_id FROM ch JOIN g ON g.id = new_id WHERE state = 'prepared' AND id % 4 != 0)"


@query(f"WITH {_GEN}, {_CHOSEN} SELECT id, g.root, CASE WHEN id = new_id THEN 'active' WHEN new_id IS NOT NULL AND state = 'active' THEN 'obsolete' ELSE state END AS state FROM g LEFT JOIN ok ON ok.root = g.root")
def activate_version(spark, sf):
    g = generations(spark, sf).withColumn("config_fingerprint", F.when(F.col("id") % 4 == 0, "old").otherwise("new"))
    chosen = g.where("state = 'prepared' or id % 5 = 0").groupBy("root").agg(F.max("id").alias("id")).withColumn("config_fingerprint", F.lit("new"))
    return versions.activated(g, chosen).select("id", "root", "state")


@query(f"WITH {_GEN}, f AS (SELECT root, min(id) AS baseline_id FROM g WHERE id % 2 = 1 GROUP BY 1 HAVING min(id) % 3 = 0) SELECT id, g.root, CASE WHEN id = baseline_id THEN 'active' WHEN baseline_id IS NOT NULL AND state = 'active' THEN 'obsolete' ELSE state END AS state FROM g LEFT JOIN f ON f.root = g.root")
def restore_version(spark, sf):
    g = generations(spark, sf)
    failed = g.where("id % 2 = 1").groupBy("root").agg(F.min("id").alias("baseline_id")).where("baseline_id % 3 = 0")
    return versions.restored(g, failed).select("id", "root", "state")


@query(f"WITH {_GEN}, c AS (SELECT root, count(*) FILTER (state = 'active') AS a, count(*) FILTER (state IN ('building', 'prepared')) AS p FROM g GROUP BY 1) SELECT root, 'several_active' AS fault FROM c WHERE a > 1 UNION ALL SELECT root, 'several_pending' FROM c WHERE p > 1")
def version_faults(spark, sf):
    return versions.state_faults(generations(spark, sf))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey > o_orderkey")
def runtime_faults(spark, sf):
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("baseline_generation"), F.col("o_orderkey").alias("last_generation"))
    return versions.runtime_faults(r).select("id")


@query(f"WITH {_GEN}, r AS (SELECT root, count(*)::BIGINT AS n_generations, max(id) FILTER (state = 'active') AS active_id, arg_max(id, (updated_at_ms, id)) FILTER (state IN ('building', 'prepared')) AS pending_id FROM g GROUP BY 1) SELECT r.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = active_id)::BIGINT AS n_entries FROM r")
def version_diagnostics(spark, sf):
    return versions.diagnostics(generations(spark, sf), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch_id")))


@query("SELECT '/r' || (event_id % 9) AS root, bool_or(user_id % 200 = 0) AS needs_refresh FROM events GROUP BY 1")
def needs_refresh(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("/r"), (F.col("event_id") % 9).cast("string")).alias("root"), F.when(F.col("user_id") % 200 != 0, F.col("user_id")).alias("modified_ms"), F.lit(1).alias("size_bytes"))
    return versions.needs_refresh(e)


@query(entries.PARTS_SQL + " SELECT path_key, parent AS parent_key, modified_ms FROM entries WHERE kind IN ('directory', 'application')")
def prepared_manifest(spark, sf):
    return versions.prepared_manifest(parts(spark, sf)).select("path_key", "parent_key", "modified_ms")


@query(f"WITH {_MANIFEST} SELECT '/r' || (c_custkey % 15) || '/x' || c_custkey AS path_key, 'outside_roots' AS fault FROM customer WHERE c_custkey % 15 > 9 UNION ALL SELECT path_key, 'root_changed' FROM m WHERE root = '/r1'")
def manifest_change_faults(spark, sf):
    m = supplier_manifest(spark, sf)
    gone = table(spark, sf, "customer").select(F.concat(F.lit("/r"), (F.col("c_custkey") % 15).cast("string"), F.lit("/x"), F.col("c_custkey").cast("string")).alias("path_key"))
    return versions.manifest_change_faults(m, m.withColumn("root", F.when(F.col("root") == "/r1", "/r2").otherwise(F.col("root"))), gone)


_QUEUE = "q AS (SELECT '/r' || (s_suppkey % 3) AS root, '/r' || (s_suppkey % 3) || '/' || repeat('d', 1 + s_suppkey % 4) || s_suppkey AS directory_key, CASE WHEN s_nationkey < 15 THEN 'pending' ELSE 'completed' END AS state, s_suppkey FROM supplier)"


def staging_queue(spark, sf):
    root = F.concat(F.lit("/r"), (F.col("s_suppkey") % 3).cast("string"))
    key = F.concat(root, F.lit("/"), F.repeat(F.lit("d"), (1 + F.col("s_suppkey") % 4).cast("int")), F.col("s_suppkey").cast("string"))
    return table(spark, sf, "supplier").select(root.alias("root"), key.alias("directory_key"), F.when(F.col("s_nationkey") < 15, "pending").otherwise("completed").alias("state"), "s_suppkey")


@query(f"WITH {_QUEUE} SELECT root, directory_key FROM q WHERE state = 'pending' ORDER BY length(directory_key), directory_key, root LIMIT 20")
def directory_queue(spark, sf):
    return versions.open_directories(staging_queue(spark, sf)).limit(20)


_CHECKED = f"""{_QUEUE}, rd AS (SELECT root, directory_key, s_suppkey % 7 != 0 AS ok FROM q WHERE state = 'pending' AND root != '/r2'),
c AS (SELECT q.root, q.directory_key, CASE WHEN ok THEN 'completed' WHEN NOT ok THEN 'failed' ELSE state END AS state FROM q LEFT JOIN rd USING (root, directory_key)
UNION ALL SELECT root, directory_key || '/sub', 'pending' FROM rd WHERE ok AND root = '/r0')"""


def checkpoint(spark, sf):
    q = staging_queue(spark, sf)
    sub = F.when(F.col("root") == "/r0", F.array(F.concat("directory_key", F.lit("/sub")), F.concat("directory_key", F.lit("/sub")), F.col("directory_key"))).otherwise(F.array().cast("array<string>"))
    read = q.where("state = 'pending' and root != '/r2'").select("root", "directory_key", (F.col("s_suppkey") % 7 != 0).alias("ok"), sub.alias("children"))
    return versions.checkpointed(q.drop("s_suppkey"), read)


@query(f"WITH {_CHECKED} SELECT * FROM c")
def directory_checkpoint(spark, sf):
    return checkpoint(spark, sf)


@query(f"WITH {_CHECKED} SELECT root, CASE WHEN bool_or(state = 'pending') THEN 'building' WHEN bool_or(state = 'failed') THEN 'degraded' ELSE 'completed' END AS state FROM c GROUP BY 1")
def staging_state(spark, sf):
    return versions.staging_state(checkpoint(spark, sf))


@query("SELECT count(DISTINCT '/p' || (l_partkey % 500))::BIGINT AS n FROM lineitem")
def unique_keys(spark, sf):
    return catalog.unique_keys(table(spark, sf, "lineitem").select(F.concat(F.lit("/p"), (F.col("l_partkey") % 500).cast("string"), F.lit("/")).alias("path")))


@query("SELECT DISTINCT '/r' || (s_suppkey % 10) AS root FROM supplier WHERE s_suppkey % 10 > 2")
def watched_roots(spark, sf):
    return catalog.roots(supplier_manifest(spark, sf).withColumn("root", F.when(F.substring("root", 3, 1) > "2", F.col("root")).otherwise("")))


@query("SELECT text, max(ts) AS ts FROM (SELECT event_type || ' ' || json_extract(props, '$.k') AS text, epoch_us(ts) AS ts FROM events UNION ALL SELECT 'typed ' || (user_id % 5), epoch_us(ts) + 7 FROM events WHERE user_id % 5 < 4) GROUP BY 1 ORDER BY ts DESC, text LIMIT 12")
def history_recorded(spark, sf):
    o = opened(spark, sf)
    typed = table(spark, sf, "events").select(F.when(F.col("user_id") % 5 < 4, F.concat(F.lit("  typed "), (F.col("user_id") % 5).cast("string"), F.lit(" \n"))).otherwise(" ").alias("text"), (F.unix_micros(F.col("ts").cast("timestamp")) + 7).alias("ts"))
    return rows.recorded(o.select("text", "ts"), typed, "text", "ts", 12)


@query(entries.PARTS_SQL + " SELECT path, size_bytes, kind FROM entries")
def entry_json(spark, sf):
    """Entries as JSON text and back."""
    e = parts(spark, sf).select("path", "size_bytes", "kind")
    return e.select(F.to_json(F.struct(*e.columns)).alias("j")).select(F.from_json("j", e.schema).alias("e")).select("e.*")


# ---------------------------------------------------------------- scans and merges

_PROBE = "pr AS (SELECT path_key, CASE WHEN n % 11 = 0 THEN 'file' ELSE 'directory' END AS kind, CASE WHEN n % 3 = 0 THEN 99 ELSE n END AS modified_ms, n % 13 != 0 AS readable FROM k WHERE n % 5 != 0 UNION ALL SELECT path_key || '/new', 'directory', 1, true FROM k WHERE n % 17 = 0), k AS (SELECT path_key, length(path_key) * 7 + ascii(right(path_key, 1)) AS n FROM entries WHERE kind = 'directory')"


def probe(spark, sf):
    number = (F.length("path_key") * 7 + F.ascii(F.right("path_key", F.lit(1)))).cast("long")
    m = changes.manifest_of(parts(spark, sf)).select("path_key", number.alias("n"))
    seen = m.where("n % 5 != 0").select("path_key", F.when(F.col("n") % 11 == 0, "file").otherwise("directory").alias("kind"), F.when(F.col("n") % 3 == 0, 99).otherwise(F.col("n")).cast("long").alias("modified_ms"), (F.col("n") % 13 != 0).alias("readable"))
    new = m.where("n % 17 = 0").select(F.concat("path_key", F.lit("/new")).alias("path_key"), F.lit("directory").alias("kind"), F.lit(1).cast("long").alias("modified_ms"), F.lit(True).alias("readable"))
    return m.select("path_key", F.col("n").alias("modified_ms")), seen.unionByName(new)


_PROBED = entries.PARTS_SQL + ", k AS (SELECT path_key, length(path_key) * 7 + ascii(right(path_key, 1)) AS n FROM entries WHERE kind = 'directory'), " + _PROBE.split(", k AS")[0]
_STATUS = "cal AS (SELECT coalesce(k.path_key, pr.path_key) AS path_key, CASE WHEN k.path_key IS NOT NULL AND NOT coalesce(readable, true) THEN 'failed' WHEN k.path_key IS NOT NULL AND coalesce(kind != 'directory', true) THEN 'missing' WHEN k.path_key IS NOT NULL AND modified_ms = n THEN 'unchanged' WHEN k.path_key IS NOT NULL THEN 'changed' WHEN kind = 'directory' THEN 'new' END AS status FROM k FULL JOIN pr ON k.path_key = pr.path_key)"


@query(f"{_PROBED}, {_STATUS} SELECT path_key, status FROM cal WHERE status IS NOT NULL")
def manifest_calibration(spark, sf):
    return calibration.calibrated(*probe(spark, sf))


@query(f"{_PROBED}, {_STATUS} SELECT path_key FROM cal a WHERE status = 'missing' AND NOT EXISTS (SELECT 1 FROM cal b WHERE b.status = 'missing' AND starts_with(a.path_key, b.path_key || '/'))")
def lost_scopes(spark, sf):
    return calibration.lost_scopes(calibration.calibrated(*probe(spark, sf)))


@query(f"{_PROBED}, {_STATUS}, {_LATER}, ff AS (SELECT * FROM f WHERE kind = 'file'), ll AS (SELECT * FROM later WHERE kind = 'file') SELECT * FROM (SELECT coalesce(o.path_key, c.path_key) AS path_key, CASE WHEN c.path_key IS NULL THEN 'remove' WHEN o.path_key IS NULL OR o.modified_ms != c.modified_ms THEN 'upsert' END AS change FROM (SELECT * FROM ff WHERE parent IN (SELECT path_key FROM cal WHERE status = 'changed')) o FULL JOIN (SELECT * FROM ll WHERE parent IN (SELECT path_key FROM cal WHERE status = 'changed')) c ON o.path_key = c.path_key) WHERE change IS NOT NULL")
def changed_children(spark, sf):
    e = parts(spark, sf).where("kind != 'application'")
    return calibration.changed_children(e, later_scan(e), calibration.calibrated(*probe(spark, sf)))


_SCANS = """s1 AS (SELECT '/w/a' || user_id || CASE WHEN event_type = 'error' THEN '' ELSE '/b' || (event_id % 20) END AS path_key, CASE WHEN event_type IN ('error', 'signup') THEN 'remove' ELSE 'upsert' END AS op FROM events WHERE event_id % 2 = 0),
s2 AS (SELECT '/w/a' || user_id || '/b' || (event_id % 23) || CASE WHEN event_id % 3 = 0 THEN '/c' ELSE '' END AS path_key, CASE WHEN event_id % 41 = 1 THEN 'upsert' ELSE 'remove' END AS op FROM events WHERE event_id % 2 = 1)"""


@query(
    f"""WITH {_SCANS}, a0 AS (SELECT DISTINCT path_key FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) WHERE op = 'remove'),
r AS (SELECT path_key FROM a0 x WHERE NOT EXISTS (SELECT 1 FROM a0 y WHERE starts_with(x.path_key, y.path_key || '/'))), late AS (SELECT DISTINCT path_key FROM s2 WHERE op = 'upsert'),
u AS (SELECT path_key FROM s1 WHERE op = 'upsert' AND NOT EXISTS (SELECT 1 FROM r WHERE s1.path_key = r.path_key OR starts_with(s1.path_key, r.path_key || '/')) UNION SELECT path_key FROM late)
SELECT path_key, 'upsert' AS op FROM u UNION ALL SELECT path_key, 'remove' FROM r WHERE NOT EXISTS (SELECT 1 FROM late WHERE late.path_key = r.path_key OR starts_with(late.path_key, r.path_key || '/'))"""
)
def merge_scans(spark, sf):
    """Two results over events' paths: the first from the even, the second from the odd ones."""
    e = table(spark, sf, "events")
    top = F.concat(F.lit("/w/a"), F.col("user_id").cast("string"))
    one = e.where("event_id % 2 = 0").select(F.when(F.col("event_type") == "error", top).otherwise(F.concat(top, F.lit("/b"), (F.col("event_id") % 20).cast("string"))).alias("path_key"), F.when(F.col("event_type").isin("error", "signup"), "remove").otherwise("upsert").alias("op"))
    two = e.where("event_id % 2 = 1").select(F.concat(top, F.lit("/b"), (F.col("event_id") % 23).cast("string"), F.when(F.col("event_id") % 3 == 0, "/c").otherwise("")).alias("path_key"), F.when(F.col("event_id") % 41 == 1, "upsert").otherwise("remove").alias("op"))
    return calibration.merged(one, two)


@query(
    f"""{entries.PARTS_SQL}, {_DELTA}, base AS (SELECT path_key, parent AS parent_key, '/parts' AS root, 1::BIGINT AS modified_ms FROM entries WHERE kind = 'directory'),
com AS (SELECT path_key, parent_key, root, 9::BIGINT AS modified_ms FROM base WHERE regexp_matches(path_key, '/Brand-[0-9]*[02468]$')),
rm AS (SELECT path_key AS a, max(generation) AS gone FROM d1 WHERE op = 'remove' GROUP BY 1), lst AS (SELECT path_key, max(generation) AS generation FROM d1 WHERE op = 'upsert' GROUP BY 1),
put AS (SELECT com.*, generation FROM lst JOIN com USING (path_key)),
r AS (SELECT path_key, parent_key, root, modified_ms, 0 AS generation FROM base WHERE path_key NOT IN (SELECT path_key FROM put) UNION ALL SELECT path_key, parent_key, root, modified_ms, generation FROM put),
al AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM rm WHERE gone > r.generation AND (r.path_key = a OR starts_with(r.path_key, a || '/')))),
w AS (SELECT * FROM com WHERE EXISTS (SELECT 1 FROM d1 WHERE d1.path_key = com.path_key OR starts_with(d1.path_key, com.path_key || '/')))
SELECT path_key, parent_key, root, modified_ms FROM al WHERE path_key NOT IN (SELECT path_key FROM w) UNION ALL SELECT path_key, parent_key, root, modified_ms FROM w"""
)
def manifest_with_tail(spark, sf):
    m = parts(spark, sf).where("kind = 'directory'").select("path_key", "parent_key", "root", F.lit(1).cast("long").alias("modified_ms"))
    committed = m.where(F.col("path_key").rlike("/Brand-[0-9]*[02468]$")).withColumn("modified_ms", F.lit(9).cast("long"))
    tail = last_deltas(spark, sf).select("generation", "op", "path_key", "kind", F.lit(None).cast("string").alias("parent_key"), F.lit("/parts").alias("root"), F.lit(None).cast("long").alias("modified_ms"))
    return calibration.manifest_with_tail(m, tail, committed)


@query(f"{entries.PARTS_SQL}, {_LATER} SELECT path_key, size_bytes FROM entries WHERE path_key != '/parts/SMALL' AND NOT starts_with(path_key, '/parts/SMALL/') AND path_key NOT IN (SELECT path_key FROM later WHERE contains(path_key, 'ring')) UNION ALL SELECT path_key, size_bytes FROM later WHERE contains(path_key, 'ring')")
def update_in_place(spark, sf):
    e = parts(spark, sf)
    changed = later_scan(e).where("path_key like '%ring%'")
    return calibration.updated_in_place(e.select("path_key", "size_bytes"), spark.createDataFrame([("/parts/SMALL",)], "path_key string"), changed)


_FOLDED = "fo AS (SELECT '/parts/' || (CASE user_id % 4 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'venv' WHEN 2 THEN 'ECONOMY' ELSE '../out' END) || '/e' || (event_id % 50) AS path_key, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'change' END AS action FROM events)"


@query(f"WITH {_FOLDED} SELECT DISTINCT path_key, 'remove' AS op FROM fo WHERE action = 'remove' AND regexp_matches(path_key, '^/parts/(SMALL|ECONOMY)/') UNION ALL SELECT DISTINCT path_key, 'upsert' FROM fo WHERE action = 'change' AND regexp_matches(path_key, '^/parts/(SMALL|ECONOMY)/') AND regexp_matches(path_key, '[0-4]$')")
def scan_batch(spark, sf):
    """Removals and found changes inside the roots, without excluded ones."""
    place = F.when(F.col("user_id") % 4 == 0, "SMALL").when(F.col("user_id") % 4 == 1, "venv").when(F.col("user_id") % 4 == 2, "ECONOMY").otherwise("../out")
    folded = table(spark, sf, "events").select(F.concat(F.lit("/parts/"), place, F.lit("/e"), (F.col("event_id") % 50).cast("string")).alias("path_key"), F.when(F.col("event_type") == "error", "remove").otherwise("change").alias("action"))
    found = folded.where(F.col("path_key").rlike("[0-4]$"))
    roots = spark.createDataFrame([("/parts/SMALL",), ("/parts/ECONOMY",), ("/parts/venv",)], "path_key string")
    return calibration.batch_changes(folded, found, roots, "/parts", changes.FORCED)


@query("SELECT event_id FROM events WHERE user_id % 5 = 1 OR (event_type = 'purchase' AND user_id % 5 = 2)")
def event_path_filter(spark, sf):
    base = lambda k: F.concat(F.lit("/w/u"), k.cast("string"), F.lit("/f"))
    e = table(spark, sf, "events").select("event_id", base(F.col("user_id") % 5).alias("path"), F.when(F.col("event_type") == "purchase", base(F.col("user_id") % 5 - 1)).alias("to_path"))
    return calibration.accepted(e, spark.createDataFrame([("/w/u1",)], "path_key string")).select("event_id")


@query(entries.PARTS_SQL + " SELECT path_key, 'indexed' AS state FROM entries WHERE kind = 'file' AND modified_ms % 2000 = 0 AND modified_ms % 3000 != 0")
def content_publish(spark, sf):
    e = parts(spark, sf)
    n = F.col("modified_ms") / 1000
    read = e.where("kind = 'file'").select("path_key", "kind", "root", F.when(n % 3 == 0, F.col("modified_ms") + 1).otherwise(F.col("modified_ms")).alias("modified_ms"), "size_bytes", (4 + n % 2).cast("long").alias("generation"), F.lit("indexed").alias("state"))
    return calibration.publishable(read, e, F.lit(4)).select("path_key", "state")


# ---------------------------------------------------------------- updates


@query("WITH p AS (SELECT DISTINCT event_id // 1000 AS batch, '/u' || user_id AS path FROM events), n AS (SELECT batch, count(*) > 900 AS dirty FROM p GROUP BY 1) SELECT p.batch, path, dirty FROM p JOIN n ON n.batch = p.batch WHERE NOT dirty UNION ALL SELECT batch, NULL, dirty FROM n WHERE dirty")
def batch_path_cap(spark, sf):
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 1000).cast("long").alias("batch"), F.concat(F.lit("/u"), F.col("user_id").cast("string")).alias("path"))
    return updates.capped(e, 900)


@query("SELECT l_returnflag AS root, count(*)::BIGINT AS n_rows, sum(l_quantity::BIGINT)::BIGINT AS n_bytes, count(*) >= 15000 OR sum(l_quantity::BIGINT) >= 500000 AS compact FROM lineitem GROUP BY 1")
def delta_limits(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("root"), F.col("l_quantity").cast("long").alias("bytes"))
    return updates.delta_state(d, ["root"], 15_000, 500_000)


@query("WITH r AS (SELECT DISTINCT '/u' || (user_id % 60) AS root FROM events UNION SELECT '/quiet'), l AS (SELECT '/u' || (user_id % 60) AS root, arg_max(CASE event_type WHEN 'error' THEN 'watcher_overflow' WHEN 'view' THEN 'commit_failed' ELSE 'calibrated' END, event_id) AS code FROM events GROUP BY 1) SELECT r.root, coalesce(code != 'calibrated', false) AS dirty, CASE WHEN code != 'calibrated' THEN code END AS code FROM r LEFT JOIN l USING (root)")
def dirty_roots(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("/u"), (F.col("user_id") % 60).cast("string")).alias("root"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "watcher_overflow").when(F.col("event_type") == "view", "commit_failed").otherwise("calibrated").alias("code"))
    roots = e.select("root").distinct().unionByName(spark.createDataFrame([("/quiet",)], "root string"))
    return updates.dirty_roots(roots, e)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'full:config_changed' WHEN event_id % 3 = 0 THEN 'full:manifest_unavailable' WHEN event_id % 2 = 0 THEN 'full:dirty_roots' ELSE 'calibrate' END AS decision, CASE WHEN user_id % 2 = 0 THEN 'absorbed' ELSE 'start' END AS request FROM events")
def refresh_decisions(spark, sf):
    n = F.col("event_id")
    return table(spark, sf, "events").select("event_id", updates.refresh_decision(n % 5 == 0, n % 3 != 0, 1 - n % 2).alias("decision"), updates.request_decision(F.col("user_id") % 2 == 0).alias("request"))


# ---------------------------------------------------------------- layers


@query(
    f"""{entries.PARTS_SQL}, {_LATER}, ov AS (SELECT * FROM later WHERE extension = 'md'),
b AS (SELECT path, path_key FROM entries WHERE extension = 'md' AND path_key NOT IN (SELECT path_key FROM ov WHERE modified_ms % 1000 = 5) ORDER BY path_key LIMIT 30), o AS (SELECT path, path_key FROM ov ORDER BY path_key LIMIT 30)
SELECT 'path:' || path AS id FROM b UNION SELECT 'path:' || path FROM o"""
)
def layered_search(spark, sf):
    e = parts(spark, sf)
    over = later_scan(e).where("extension = 'md'")
    base = e.join(over.where("modified_ms % 1000 = 5").select("path_key"), "path_key", "left_anti").select(*e.columns)
    return search.layered_results(base, over.select(*e.columns), FileQuery(types=("md",)), 30).select("id")


@query(f"{entries.PARTS_SQL}, {_DELTA}, {_LAYERED} SELECT count(*)::BIGINT AS n FROM alive WHERE generation > 0 OR path_key NOT IN (SELECT path_key FROM ups)")
def visible_rows(spark, sf):
    return changes.layered(parts(spark, sf).select("path_key", "kind", "size_bytes"), last_deltas(spark, sf)).agg(F.count("*").alias("n"))
