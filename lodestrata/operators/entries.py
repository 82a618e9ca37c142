"""Catalog entries: one row for each file, directory or application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

#: Extensions of the synthetic catalogs.
EXTENSIONS = ("md", "txt", "rs", "tsx", "json", "pdf", "app")


def picked(number: Column, values: tuple[str, ...] = EXTENSIONS) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def finished(rows: DataFrame, root: str) -> DataFrame:
    """The entry schema from (path, kind or null, modified_ms, size_bytes); keys and derived columns are added."""
    name, key = P.base_name(F.col("path")), P.path_key(F.col("path"))
    kind = F.coalesce("kind", F.when(F.lower(name).rlike(r"\.(app|exe|lnk|desktop)$"), "application").otherwise("file"))
    return rows.select(
        "path",
        name.alias("name"),
        kind.alias("kind"),
        F.coalesce(P.parent_key(key), F.lit("")).alias("parent"),
        F.when(kind != "directory", P.own_extension(name)).alias("extension"),
        (F.size(P.segments(F.col("path"))) - 1).alias("depth"),
        F.lit(root).alias("root"),
        F.col("modified_ms").cast("long"),
        F.col("size_bytes").cast("long"),
        F.lower(F.concat_ws(" ", name, "path")).alias("search_text"),
        F.lit("not_indexed").alias("content_index_state"),
        key.alias("path_key"),
        F.lit(root).alias("root_key"),
        P.parent_key(key).alias("parent_key"),
    )


def with_directories(files: DataFrame) -> DataFrame:
    """Files and the directories above them."""
    if "p" in files.columns:
        above = files.select(F.explode(F.expr("slice(p, 1, size(p) - 1)")).alias("path"))
    else:  # the ancestors of each distinct directory, not of each file
        above = files.select(P.parent_key(F.col("path")).alias("d")).distinct().select(F.explode(P.ancestors(F.col("d"))).alias("path"))
    above = above.distinct().select("path", F.lit("directory").alias("kind"), F.lit(None).cast("long").alias("modified_ms"), F.lit(None).cast("long").alias("size_bytes"))
    return files.withColumn("kind", F.lit(None).cast("string")).select("path", "kind", "modified_ms", "size_bytes").unionByName(above)


def of_parts(part: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/parts/"), "p_type", F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"), F.lit("."), picked(F.col("p_partkey")))
    files = part.select(path.alias("path"), (F.col("p_partkey") * 1000).alias("modified_ms"), (F.col("p_size") * 100).alias("size_bytes"))
    return finished(with_directories(files), "/parts")


def of_documents(documents: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit("."), picked(F.col("doc_id")))
    files = documents.select(path.alias("path"), (F.col("doc_id") * 1000).alias("modified_ms"), F.col("n_chars").alias("size_bytes"))
    return finished(with_directories(files), "/corpus")


def of_lineitems(lineitem: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/orders/"), "l_returnflag", F.lit("/group-"), F.pmod(F.col("l_orderkey"), F.lit(1000)).cast("string"), F.lit("/project-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("."), picked(F.col("l_partkey")))
    files = lineitem.select(path.alias("path"), F.col("l_suppkey").alias("modified_ms"), F.col("l_quantity").cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("kind"))
    return finished(files, "/orders")


_EXT = "[" + ", ".join(f"'{x}'" for x in EXTENSIONS) + "]"
_FINISH = r"""
  SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, kind0, modified_ms, size_bytes, string_split(ltrim(path, '/'), '/') AS seg FROM rows0),
entries AS (
  SELECT path, name, CASE WHEN kind0 IS NOT NULL THEN kind0 WHEN lower(name) SIMILAR TO '.*\.(app|exe|lnk|desktop)' THEN 'application' ELSE 'file' END AS kind,
         CASE WHEN len(seg) > 1 THEN '/' || array_to_string(seg[:-2], '/') ELSE '/' END AS parent,
         CASE WHEN kind0 IS NULL THEN nullif(lower(regexp_extract(name, '^.+\.([^.]+)$', 1)), '') END AS extension,
         (len(seg) - 1)::INT AS depth, modified_ms, size_bytes, path AS path_key, seg,
         CASE WHEN kind0 = 'directory' THEN seg ELSE seg[:-2] END AS dseg
  FROM named)
"""


def _sql(files: str, directories: bool = True) -> str:
    extra = " UNION ALL SELECT DISTINCT '/' || array_to_string(seg[:i], '/'), 'directory', NULL::BIGINT, NULL::BIGINT FROM (SELECT string_split(ltrim(path, '/'), '/') AS seg, unnest(range(1, len(string_split(ltrim(path, '/'), '/')))) AS i FROM files)" if directories else ""
    return f"WITH files AS ({files}), rows0 AS (SELECT path, NULL::VARCHAR AS kind0, modified_ms, size_bytes FROM files{extra}), named AS ({_FINISH}"


#: The same catalogs for DuckDB: a WITH clause that defines ``entries`` (seg: segments, dseg: directory segments).
PARTS_SQL = _sql(f"SELECT '/parts/' || p_type || '/' || replace(p_brand, '#', '-') || '/' || replace(p_name, ' ', '-') || '-' || p_partkey || '.' || {_EXT}[p_partkey % 7 + 1] AS path, p_partkey * 1000 AS modified_ms, (p_size * 100)::BIGINT AS size_bytes FROM part")
DOCUMENTS_SQL = _sql(f"SELECT '/corpus/' || lang || '/' || source || '/doc-' || doc_id || '.' || {_EXT}[doc_id % 7 + 1] AS path, doc_id * 1000 AS modified_ms, n_chars AS size_bytes FROM documents")
LINEITEMS_SQL = _sql(f"SELECT '/orders/' || l_returnflag || '/group-' || (l_orderkey % 1000) || '/project-' || l_orderkey || '-' || l_linenumber || '.' || {_EXT}[l_partkey % 7 + 1] AS path, l_suppkey AS modified_ms, l_quantity::BIGINT AS size_bytes FROM lineitem", directories=False)
