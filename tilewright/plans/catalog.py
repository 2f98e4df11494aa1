"""Queries of items, folders, metadata search, plottable tables and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import catalog as C
from tilewright.operators import elements as E
from tilewright.operators import tabular as P
from tilewright.plans.registry import query
from tilewright.sources import readers
from tilewright.sources import views as V

TREE = "WITH RECURSIVE folder AS (" + V.SQL["folder"] + "), d AS (SELECT folder FROM folder WHERE folder = 1001 UNION ALL SELECT f.folder FROM folder f JOIN d ON f.parent = d.folder), item AS (" + V.SQL["item"] + "), element AS (" + V.SQL["element"] + ")\n"


@query(TREE + "SELECT folder::INT AS folder FROM d")
def folder_descendants(spark, sf_dir):
    return C.descendants(V.folder(spark, sf_dir), 1001).select(F.col("folder").cast("int").alias("folder"))


def _below(spark, sf_dir) -> DataFrame:
    d = C.descendants(V.folder(spark, sf_dir), 1001)
    return V.item(spark, sf_dir).join(d, "folder", "left_semi")


@query(TREE + "SELECT e.id, i.item, i.name FROM element e JOIN item i ON e.annotation = i.item JOIN d USING (folder) WHERE e.type <> 'point' ORDER BY e.created DESC, e.id LIMIT 100 OFFSET 20")
def folder_annotations(spark, sf_dir):
    """Annotations of all items below a folder, sorted and paged."""
    a = V.element(spark, sf_dir).where("type <> 'point'").join(_below(spark, sf_dir).select(F.col("item").alias("annotation"), "name"), "annotation")
    return a.orderBy(F.col("created").desc(), "id").offset(20).limit(100).select("id", F.col("annotation").alias("item"), "name")


@query(TREE + "SELECT count(*)::BIGINT AS n FROM element e JOIN item i ON e.annotation = i.item JOIN d USING (folder) WHERE e.type <> 'point'")
def folder_count(spark, sf_dir):
    a = V.element(spark, sf_dir).where("type <> 'point'")
    return a.join(_below(spark, sf_dir).select(F.col("item").alias("annotation")), "annotation", "left_semi").agg(F.count("*").alias("n"))


@query(TREE + "SELECT item, name FROM item JOIN d USING (folder) WHERE contains(lower(name), '5') ORDER BY name, item LIMIT 30 OFFSET 10")
def items_recursive(spark, sf_dir):
    """Items below a folder by text, sorted and paged."""
    return _below(spark, sf_dir).where(F.lower("name").contains("5")).orderBy("name", "item").offset(10).limit(30).select("item", "name")


IE = V.with_views("item", "element")


@query(IE + "SELECT item, count(id)::BIGINT AS n, count(id) FILTER (type = 'circle') > 0 AS referenced FROM item LEFT JOIN element ON annotation = item GROUP BY item")
def item_annotation_counts(spark, sf_dir):
    """Annotations of each item, and whether an overlay refers to it."""
    n = V.element(spark, sf_dir).groupBy(F.col("annotation").alias("item")).agg(F.count("*").alias("n"), F.bool_or(F.col("type") == "circle").alias("referenced"))
    return V.item(spark, sf_dir).select("item").join(n, "item", "left").fillna(0, ["n"]).fillna(False, ["referenced"])


@query(IE + ", a AS (SELECT annotation AS item, max(created) AS last FROM element WHERE type <> 'point' GROUP BY annotation) SELECT item, name FROM a JOIN item USING (item) WHERE starts_with(lower(name), 'customer') OR len(list_filter(regexp_split_to_array(lower(name), '[\\W_]+'), lambda p: starts_with(p, 'customer'))) > 0 ORDER BY last DESC, item LIMIT 40 OFFSET 5")
def annotated_images(spark, sf_dir):
    """Distinct items with live annotations whose name matches, newest first, paged."""
    a = V.element(spark, sf_dir).where("type <> 'point'").groupBy(F.col("annotation").alias("item")).agg(F.max("created").alias("last"))
    found = a.join(V.item(spark, sf_dir), "item").where(C.name_match(F.col("name"), "customer"))
    return found.orderBy(F.col("last").desc(), "item").offset(5).limit(40).select("item", "name")


IT = V.with_views("item")


@query(IT + "SELECT segment AS group_key, item, name FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY name, item) AS k FROM item) WHERE k = 1")
def items_grouped(spark, sf_dir):
    g = C.first_of_group(V.item(spark, sf_dir), "segment", ["name", "item"])
    return g.select("group_key", "row.item", "row.name")


@query(IT + "SELECT segment AS group_key, count(*)::BIGINT AS group_size, count(DISTINCT folder)::BIGINT AS n_folder FROM item GROUP BY segment")
def items_grouped_counts(spark, sf_dir):
    return C.first_of_group(V.item(spark, sf_dir), "segment", ["name", "item"], ["folder"]).select("group_key", "group_size", "n_folder")


@query(IT + ", a AS (SELECT segment, folder, name, item FROM item QUALIFY row_number() OVER (PARTITION BY segment, folder ORDER BY name, item) = 1) SELECT folder AS group_key, segment, item FROM a QUALIFY row_number() OVER (PARTITION BY folder ORDER BY name, item) = 1")
def items_grouped_twice(spark, sf_dir):
    """Groups of rows that are groups already."""
    first = V.item(spark, sf_dir).groupBy("segment", "folder").agg(F.min_by(F.struct("*"), F.struct("name", "item")).alias("row")).select("row.*")
    return C.first_of_group(first, "folder", ["name", "item"]).select("group_key", "row.segment", "row.item")


def _columns() -> dict:
    """Columns of a part list, as text and as a number."""
    return {"name": (F.col("p_name"), None), "brand": (F.col("p_brand"), None), "type": (F.col("p_type"), None), "size": (F.col("p_size").cast("string"), F.col("p_size").cast("double"))}


def _listed(spark, sf_dir, text: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").where(C.list_filter(text, _columns())).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#13'")
def items_filter_exact(spark, sf_dir):
    return _listed(spark, sf_dir, 'brand:"Brand#13"')


@query("SELECT p_partkey FROM part WHERE contains(lower(p_brand), '#2') AND NOT (contains(lower(p_type), 'econ') OR contains(lower(p_type), 'small'))")
def items_filter_negation(spark, sf_dir):
    return _listed(spark, sf_dir, "brand:#2 type:-econ type:-small")


@query("SELECT p_partkey FROM part WHERE contains(p_size::VARCHAR, '40') OR (p_size >= 40 AND p_size < 50)")
def items_filter_number(spark, sf_dir):
    return _listed(spark, sf_dir, "size:40")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bolt') AND (contains(lower(p_brand), '#1') OR contains(lower(p_brand), '#3'))")
def items_filter_or(spark, sf_dir):
    return _listed(spark, sf_dir, "name:bolt brand:#1,#3")


@query("SELECT event_id FROM events WHERE contains(lower(json_extract_string(props, '$.k')), '7') AND contains(lower(event_type), 'c')")
def metadata_search(spark, sf_dir):
    """Phrases over metadata keys, all of which must be found."""
    k = F.get_json_object("props", "$.k")
    e = V.table(spark, sf_dir, "events")
    return e.where(C.phrase_match(k, None, "7", False) & C.phrase_match(F.col("event_type"), None, "c", False)).select("event_id")


@query("SELECT event_id FROM events WHERE contains(json_extract_string(props, '$.k'), '20') OR (TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 20 AND TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) < 30)")
def metadata_search_number(spark, sf_dir):
    """A number stands for all up to one unit of its last digit more."""
    k = F.get_json_object("props", "$.k")
    return V.table(spark, sf_dir, "events").where(C.phrase_match(k, F.expr("try_cast(get_json_object(props, '$.k') AS double)"), "20", False)).select("event_id")


@query("SELECT k AS key, count(*)::BIGINT AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def metadata_keys(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


CELLS = """WITH cells AS (SELECT p_partkey, unnest(['brand', 'type', 'size', 'price']) AS key, unnest([p_brand, p_type, CASE WHEN p_partkey % 11 > 0 THEN p_size::VARCHAR ELSE '' END, CASE WHEN p_partkey % 50 = 0 THEN 'n/a' ELSE p_size::VARCHAR END]) AS value FROM part)"""


def _cells(spark, sf_dir) -> DataFrame:
    """Part attributes as cells: one with empty values, one of mixed kinds."""
    size = F.col("p_size").cast("string")
    pairs = [("brand", F.col("p_brand")), ("type", F.col("p_type")), ("size", F.when(F.col("p_partkey") % 11 > 0, size).otherwise("")), ("price", F.when(F.col("p_partkey") % 50 == 0, "n/a").otherwise(size))]
    return V.table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])).alias("c")).select("p_partkey", "c.key", "c.value")


@query(CELLS + """, v AS (SELECT * FROM cells WHERE value IS NOT NULL AND value <> ''), s AS (SELECT key, count(*)::BIGINT AS count, count(DISTINCT value)::BIGINT AS n_distinct, bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) AS num, min(TRY_CAST(value AS DOUBLE)) AS lo, max(TRY_CAST(value AS DOUBLE)) AS hi, array_to_string(list_sort(list(DISTINCT value)), '|') AS d FROM v GROUP BY key)
  SELECT key, count, CASE WHEN num THEN 'number' ELSE 'string' END AS type, CASE WHEN num THEN lo END AS min, CASE WHEN num THEN hi END AS max, n_distinct, CASE WHEN n_distinct <= 20 THEN d END AS distinct_values FROM s""")
def plot_columns(spark, sf_dir):
    return P.column_catalogue(_cells(spark, sf_dir))


@query(CELLS + ", w AS (SELECT p_partkey, max(value) FILTER (key = 'brand') AS brand, max(value) FILTER (key = 'size' AND value <> '') AS size FROM cells GROUP BY p_partkey) SELECT p_partkey, brand, size FROM w WHERE size IS NOT NULL")
def plot_required(spark, sf_dir):
    """Rows of the requested columns in which the required one has a value."""
    take = lambda k: F.max(F.when((F.col("key") == k) & (F.col("value") != ""), F.col("value")))
    return _cells(spark, sf_dir).groupBy("p_partkey").agg(take("brand").alias("brand"), take("size").alias("size")).where("size IS NOT NULL")


@query(IE + """, r AS (SELECT i.folder AS f, e.annotation AS a, e.id AS e FROM element e JOIN item i ON i.item = e.annotation),
  own AS (SELECT e, id_v FROM (SELECT id AS e, id * 10 AS id_v FROM element WHERE id % 5 = 0)), an AS (SELECT item AS a, item * 1000 AS v FROM item WHERE item % 3 = 0), fo AS (SELECT DISTINCT folder AS f, folder * 100000 AS v FROM item WHERE folder % 2 = 0)
  SELECT r.f, r.a, r.e, coalesce(own.id_v, an.v, fo.v, -1)::BIGINT AS score FROM r LEFT JOIN own USING (e) LEFT JOIN an USING (a) LEFT JOIN fo USING (f)""")
def plot_data(spark, sf_dir):
    """Rows with a value of their own, or of their annotation, item, or all."""
    i, e = V.item(spark, sf_dir), V.element(spark, sf_dir)
    rows = e.join(i.select(F.col("item").alias("annotation"), F.col("folder").alias("f")), "annotation").select("f", F.col("annotation").alias("a"), F.col("id").alias("e"))
    none = lambda c: F.lit(None).cast("long").alias(c)
    values = rows.where("e % 5 = 0").select("f", "a", "e", (F.col("e") * 10).alias("value"))
    values = values.unionByName(i.where("item % 3 = 0").select(F.col("folder").alias("f"), F.col("item").alias("a"), none("e"), (F.col("item") * 1000).alias("value")))
    values = values.unionByName(i.where("folder % 2 = 0").select(F.col("folder").alias("f"), none("a"), none("e"), (F.col("folder") * 100000).cast("long").alias("value")).distinct())
    values = values.unionByName(spark.range(1).select(F.lit(None).cast("int").alias("f"), none("a"), none("e"), F.lit(-1).cast("long").alias("value")))
    return P.fill_from_parents(rows, {"score": values}, ["f", "a", "e"])


@query(IT + ", q AS (SELECT item AS qid, CASE item % 3 WHEN 0 THEN item::VARCHAR WHEN 1 THEN upper(name) ELSE name || '.tiff' END AS text FROM item WHERE item % 7 = 0) SELECT qid, text, min(item) AS item FROM q LEFT JOIN item ON text = item::VARCHAR OR lower(text) = lower(name) OR starts_with(lower(text), lower(name) || '.') GROUP BY qid, text")
def item_name_resolve(spark, sf_dir):
    """Free texts to items: by id, by name in any case, or by name and an extension.

    Each way is an equi-join on a key derived from the text; the smallest item wins.
    """
    i = V.item(spark, sf_dir)
    k = F.col("item") % 3
    text = F.when(k == 0, F.col("item").cast("string")).when(k == 1, F.upper("name")).otherwise(F.concat("name", F.lit(".tiff")))
    q = i.where("item % 7 = 0").select(F.col("item").alias("qid"), text.alias("text"))
    stems = F.transform(F.filter(F.sequence(F.lit(1), F.length("text")), lambda p: F.substr("text", p, F.lit(1)) == "."), lambda p: F.substr(F.lower("text"), F.lit(1), p - 1))
    keys = q.select("qid", "text", F.explode(F.concat(F.array(F.concat(F.lit("i:"), "text"), F.concat(F.lit("n:"), F.lower("text"))), F.transform(stems, lambda s: F.concat(F.lit("n:"), s)))).alias("key"))
    names = i.select("item", F.explode(F.array(F.concat(F.lit("i:"), F.col("item").cast("string")), F.concat(F.lit("n:"), F.lower("name")))).alias("key"))
    return keys.join(names, "key", "left").groupBy("qid", "text").agg(F.min("item").alias("item"))


@query(V.with_views("history", "item") + "SELECT DISTINCT annotation FROM history h WHERE NOT EXISTS (SELECT 1 FROM item i WHERE i.item = h.annotation * 20) AND updated < (SELECT max(updated) FROM history) - INTERVAL 1 DAY")
def old_annotations_orphaned(spark, sf_dir):
    """Annotations whose item is gone and that are old."""
    h = V.history(spark, sf_dir)
    cut = h.agg((F.max("updated") - F.expr("INTERVAL 1 DAY")).alias("cut"))
    old = h.crossJoin(F.broadcast(cut)).where("updated < cut").withColumn("item", F.col("annotation") * 20)
    return old.join(V.item(spark, sf_dir).select("item"), "item", "left_anti").select("annotation").distinct()


@query(V.with_views("history") + "SELECT annotation, version FROM (SELECT *, row_number() OVER (PARTITION BY annotation ORDER BY version DESC) AS k FROM history WHERE NOT active) WHERE k > 2")
def old_annotations_inactive(spark, sf_dir):
    """Inactive versions of an annotation but the two newest."""
    h = V.history(spark, sf_dir).where("NOT active")
    return C.skip_newest(h, "annotation", [F.col("version").desc()], 2).select("annotation", "version")


@query(V.with_views("history", "element") + "SELECT DISTINCT id % 500 AS annotation, version FROM element e WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.annotation = e.id % 500 AND h.version = e.version)")
def old_element_versions(spark, sf_dir):
    """Versions of elements that no annotation has."""
    e = V.element(spark, sf_dir).select((F.col("id") % 500).alias("annotation"), "version").distinct()
    return e.join(V.history(spark, sf_dir).select("annotation", "version"), ["annotation", "version"], "left_anti")


@query("SELECT event_id, array_to_string(list_sort(list_filter(['a=1', 'k=' || json_extract_string(props, '$.k'), CASE WHEN event_id % 3 > 0 THEN 'b=2' END], lambda x: x IS NOT NULL)), '|') AS merged FROM events")
def set_metadata(spark, sf_dir):
    """Metadata after a merge in which a null deletes."""
    now = F.from_json("props", "map<string,string>")
    change = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.when(F.col("event_id") % 3 > 0, "2"))
    m = C.set_metadata(now, change)
    return V.table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("merged"))


@query("SELECT event_id, len(list_filter(json_keys(props), lambda k: k <> 'k'))::INT AS n FROM events")
def delete_metadata(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", F.size(C.delete_metadata(F.from_json("props", "map<string,string>"), ["k"])).alias("n"))


RANK_SQL = "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{e}', {p}, {f})" for n, e, p, f in readers.rows()) + ") t(reader, extension, priority, fallback))"


@query(RANK_SQL + " SELECT extension, reader, row_number() OVER (PARTITION BY extension ORDER BY fallback, priority, reader) AS place FROM r")
def reader_rank(spark, sf_dir):
    return readers.ranking(spark)


@query(RANK_SQL + " SELECT extension, count(*)::BIGINT AS readers FROM r WHERE extension <> '' GROUP BY extension")
def list_extensions(spark, sf_dir):
    return readers.table(spark).where("extension <> ''").groupBy("extension").agg(F.count("*").alias("readers"))


@query(V.with_views("element") + "SELECT annotation, round(arg_max(cx, version), 6) AS cx, max(version) AS version FROM element GROUP BY annotation")
def annotation_load(spark, sf_dir):
    """The elements' newest version of each annotation."""
    return E.latest(V.element(spark, sf_dir), ["annotation"], "version", ["cx"]).select("annotation", F.round("cx", 6).alias("cx"), "version")


@query("SELECT o_orderkey, 'Annotation ' || strftime(o_orderdate, '%Y-%m-%d %H:%M') AS name FROM orders")
def default_names(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Annotation "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).alias("name"))


@query("SELECT greatest(2, floor(8e9 * 0.25 / bytes))::BIGINT AS items, bytes FROM (SELECT (k + 1) * 24 * 1048576 AS bytes FROM range(20) t(k))")
def cache_items(spark, sf_dir):
    """Sources that fit in a share of memory, two at least."""
    size = ((F.col("id") + 1) * 24 * 1048576).alias("bytes")
    return spark.range(20).select(size).select(F.greatest(F.lit(2), F.floor(8e9 * 0.25 / F.col("bytes"))).cast("long").alias("items"), "bytes")


@query(None)
def embedding_projection(spark, sf_dir):
    """Two principal components of the embeddings, by a streamed covariance: stands in for
    a neighbour projection, which has no deterministic result to compare with."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = V.table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(v).transform(v).withColumn("p", vector_to_array("p"))
    return out.select("vec_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN (props->>'$.k')::INT WHEN 3 THEN (props->>'$.k')::INT END AS k, CASE event_id % 4 WHEN 1 THEN 2 END AS b, event_id % 4 <> 3 AS done FROM events")
def json_patch(spark, sf_dir):
    """Patches (replace, add, remove) on the JSON of events, read back; adding what is there is refused and leaves the text."""
    from tilewright.functions.json_patch import patched

    e = V.table(spark, sf_dir, "events").select("event_id", "props")
    m = F.col("event_id") % 4
    ops = F.when(m == 0, '[{"op":"replace","path":"/k","value":1}]').when(m == 1, '[{"op":"add","path":"/a","value":{"b":2}}]').when(m == 2, '[{"op":"remove","path":"/k"}]').otherwise('[{"op":"add","path":"/k","value":9}]')
    e = e.withColumn("patched", patched(F.col("props"), ops))
    text = F.coalesce("patched", "props")
    return e.select("event_id", F.get_json_object(text, "$.k").cast("int").alias("k"), F.get_json_object(text, "$.a.b").cast("int").alias("b"), F.col("patched").isNotNull().alias("done"))
