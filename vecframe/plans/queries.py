"""The registered queries of the engine and the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values, vectors
from ..functions.predicate import flag, matching
from ..operators import ann, facets, ids, search
from ..sources import oplog
from ..sources.requests import Settings
from ..sources.scratch import scratch_folder
from ..sources.store import Collection, Engine

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

DOCS = """docs AS (SELECT e.vec_id AS doc_id, e.embedding AS vector, CAST(e.label AS BIGINT) AS label, v.user_id,
  CASE WHEN v.event_type IN ('purchase', 'click') THEN v.value END AS value, v.event_type
  FROM embeddings e JOIN events v ON v.event_id = e.vec_id)"""
#: value as a long for labels under 3, as a string for labels over 7, else as a double: fields of several kinds.
MIXED = "mixed AS (SELECT doc_id, label, value, event_type, CASE WHEN value IS NULL THEN NULL WHEN label < 3 THEN 0 WHEN label > 7 THEN 2 ELSE 1 END AS k FROM docs)"


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))
    v = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type").isin("purchase", "click"), F.col("value")).alias("value"), "event_type")
    return e.join(v, F.col("event_id") == F.col("doc_id")).drop("event_id")


def mapped(df: DataFrame) -> DataFrame:
    """(doc_id, vector, metadata): the map layout of ``docs``, missing values left out."""
    fields = [("label", values.LONG), ("user_id", values.LONG), ("value", values.DOUBLE), ("event_type", values.STRING)]
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), values.column_value(F.col(n), r).alias("value")) for n, r in fields))
    return df.select("doc_id", "vector", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("metadata"))


def mixed(df: DataFrame) -> DataFrame:
    x = F.when(F.col("label") < 3, values.column_value(F.col("value").cast("long"), values.LONG)).when(F.col("label") > 7, values.column_value(F.col("value").cast("string"), values.STRING))
    value = F.when(F.col("value").isNotNull(), x.otherwise(values.column_value(F.col("value"), values.DOUBLE)))
    return df.select("doc_id", F.map_filter(F.create_map(F.lit("x"), value), lambda _, v: v.isNotNull()).alias("metadata"))


#: name -> (filter, the same in SQL)
FILTERS = {
    "filter_eq_long": ("label = 3", "label = 3"),
    "filter_ne_long": ("label != 3", "label <> 3"),
    "filter_gt": ("label > 6", "label > 6"),
    "filter_lt": ("label < 2", "label < 2"),
    "filter_ge": ("user_id >= 100", "user_id >= 100"),
    "filter_le": ("user_id <= 100", "user_id <= 100"),
    "filter_eq_string": ('event_type = "click"', "event_type = 'click'"),
    "filter_ne_string": ('event_type != "error"', "event_type <> 'error'"),
    "filter_ge_double": ("value >= 10.0", "value >= 10.0"),
    "filter_lt_double": ("value < 10.0", "value < 10.0"),
    "filter_and": ('label > 3 AND event_type = "click"', "label > 3 AND event_type = 'click'"),
    "filter_or": ('label = 3 OR event_type = "click"', "label = 3 OR event_type = 'click'"),
    "filter_not": ('NOT event_type = "click"', "NOT event_type = 'click'"),
    "filter_group": ('(label = 1 OR label = 2) AND event_type = "view"', "(label = 1 OR label = 2) AND event_type = 'view'"),
    "filter_nested_not": ('NOT (label > 3 AND value >= 10.0)', "NOT (label > 3 AND coalesce(value >= 10.0, false))"),
    "filter_flat_precedence": ('label = 1 OR label = 2 AND event_type = "view"', "(label = 1 OR label = 2) AND event_type = 'view'"),
    "filter_not_missing": ("NOT value > 10.0", "NOT (value > 10.0) OR value IS NULL"),
    "filter_ne_missing": ("value != 10.0", "value <> 10.0"),
    "filter_unknown_field": ("nothing = 1", "false"),
    "filter_not_unknown_field": ("NOT nothing = 1", "true"),
    "filter_cross_type_long_lit": ("value > 80", "value IS NOT NULL"),
    "filter_cross_type_double_lit": ("label < 3.0", "label IS NOT NULL"),
    "filter_cross_type_string_lit": ('label >= "3"', "false"),
    "filter_dangling_and": ("label = 1 AND", "false"),
    "filter_dangling_or": ("label = 1 OR", "label = 1"),
    "filter_lone_not": ("NOT", "true"),
    "filter_blank": ("   ", "false"),
    "filter_empty": ("", "true"),
}
for _name, (_text, _where) in FILTERS.items():
    _out = "doc_id, label, user_id, value, event_type"

    def _flat(spark, sf_dir, text=_text):
        return matching(docs(spark, sf_dir), text).select("doc_id", "label", "user_id", "value", "event_type")

    def _mapped(spark, sf_dir, text=_text):
        return matching(mapped(docs(spark, sf_dir)), text, "metadata").select("doc_id")

    query(_name, f"WITH {DOCS} SELECT {_out} FROM docs WHERE {_where}")(_flat)
    query(_name.replace("filter_", "filter_map_"), f"WITH {DOCS} SELECT doc_id FROM docs WHERE {_where}")(_mapped)

#: filter over a field of several kinds -> SQL over (k, value)
MIXED_FILTERS = {
    "filter_mixed_gt_long": ("x > 10", "k > 0 OR (k = 0 AND trunc(value) > 10)"),
    "filter_mixed_le_double": ("x <= 20.0", "k = 0 OR (k = 1 AND value <= 20.0)"),
    "filter_mixed_lt_string": ('x < "5"', "k < 2 OR (k = 2 AND CAST(value AS VARCHAR) < '5')"),
    "filter_mixed_not_ge_double": ("NOT x >= 20.0", "k IS NULL OR k = 0 OR (k = 1 AND value < 20.0)"),
    "filter_mixed_ne_long": ("x != 10", "k > 0 OR (k = 0 AND trunc(value) <> 10)"),
}
for _name, (_text, _where) in MIXED_FILTERS.items():

    def _mixed(spark, sf_dir, text=_text):
        return matching(mixed(docs(spark, sf_dir)), text, "metadata").select("doc_id")

    query(_name, f"WITH {DOCS}, {MIXED} SELECT doc_id FROM mixed WHERE {_where}")(_mixed)


@query("filter_lineitem_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity >= 45.0 AND l_returnflag = 'R') OR NOT l_discount <= 0.09")
def filter_lineitem_scan(spark, sf_dir):
    return matching(table(spark, sf_dir, "lineitem"), '(l_quantity >= 45.0 AND l_returnflag = "R") OR NOT l_discount <= 0.09').select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_flags", f"WITH {DOCS} SELECT doc_id, coalesce(value > 10.0, false) AS passes FROM docs")
def filter_flags(spark, sf_dir):
    df = docs(spark, sf_dir)
    return df.select("doc_id", flag(df, "value > 10.0").alias("passes"))


@query("filter_match_count", f"WITH {DOCS} SELECT count(*) FILTER (label > 4) AS matched, count(*) AS total FROM docs")
def filter_match_count(spark, sf_dir):
    df = docs(spark, sf_dir)
    return df.agg(F.count_if(flag(df, "label > 4")).alias("matched"), F.count("*").alias("total"))


_A, _B = "SELECT doc_id FROM docs WHERE label > 4", "SELECT doc_id FROM docs WHERE event_type = 'click'"
for _name, _f, _op in (("ids_and", ids.intersection, "INTERSECT"), ("ids_or", ids.union, "UNION"), ("ids_and_not", ids.difference, "EXCEPT")):

    def _ids(spark, sf_dir, f=_f):
        df = docs(spark, sf_dir)
        return f(matching(df, "label > 4"), matching(df, 'event_type = "click"'))

    query(_name, f"WITH {DOCS} ({_A}) {_op} ({_B})")(_ids)


@query("ids_cardinality", f"WITH {DOCS} SELECT count(DISTINCT doc_id) AS n, coalesce(max(doc_id), -1) + 1 AS size FROM docs WHERE label > 4")
def ids_cardinality(spark, sf_dir):
    return ids.cardinality(matching(docs(spark, sf_dir), "label > 4"))


@query("ids_ascending", f"WITH {DOCS} SELECT doc_id FROM docs WHERE label > 4 ORDER BY doc_id")
def ids_ascending(spark, sf_dir):
    return ids.ascending(matching(docs(spark, sf_dir), "label > 4"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


_Q = "q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)"
_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
_IP = f"round(1 - {_DOT}, 6) + 0.0"
_L2 = "round(list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) + 0.0"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


def _knn(name: str, k: int, space: str = "IP", text: str = "", where: str = "true", keep: str = ""):
    expression = (_L2 if space == "L2" else _IP).format(a="vector", b="q.v")
    extra = "".join(f", {c}" for c in keep.split())

    def run(spark, sf_dir):
        return _rounded(search.knn(docs(spark, sf_dir), first_vector(spark, sf_dir), k, space, text, keep=keep.split()))

    query(name, f"WITH {DOCS}, {_Q} SELECT doc_id, {expression} AS distance{extra} FROM docs, q WHERE {where} ORDER BY distance, doc_id LIMIT {k}")(run)


_knn("knn_ip", 10)
_knn("knn_l2", 10, "L2")
_knn("knn_k_exceeds", 1_000_000, "IP", "label = 3", "label = 3")
_knn("knn_filtered_selective", 10, "L2", 'label = 3 AND event_type = "click"', "label = 3 AND event_type = 'click'")
_knn("knn_filtered_broad", 10, "IP", "label != 3", "label <> 3")
_knn("knn_zero", 0)
_knn("knn_with_metadata", 10, "IP", "label = 3 OR label > 7", "label = 3 OR label > 7", "label user_id value event_type")


@query("knn_cosine", f"WITH {DOCS}, {_Q} SELECT doc_id, round(1 - {_DOT.format(a='vector', b='q.v')} / (sqrt({_DOT.format(a='vector', b='vector')}) * sqrt({_DOT.format(a='q.v', b='q.v')})), 6) + 0.0 AS distance FROM docs, q ORDER BY distance, doc_id LIMIT 10")
def knn_cosine(spark, sf_dir):
    df = docs(spark, sf_dir).withColumn("vector", vectors.normalized(F.col("vector")))
    q = first_vector(spark, sf_dir)
    norm = sum(x * x for x in q) ** 0.5
    rows = df.select("doc_id", vectors.distance("IP", F.col("vector"), vectors.vector_literal([x / norm for x in q])).alias("distance"))
    return _rounded(rows.orderBy("distance", "doc_id").limit(10))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, vector): the query set of searches, every row whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _join_sql(distance: str, where: str) -> str:
    exact = distance.removeprefix("round(").removesuffix(", 6) + 0.0").format(a="vector", b="q.embedding")
    return f"""WITH {DOCS}, d AS (SELECT q.vec_id AS query_id, doc_id, {exact} AS x FROM docs, embeddings q WHERE q.vec_id % 20 = 0 AND {where}),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(x, {search.DECIMALS}), doc_id) AS INTEGER) AS rank FROM d)
      SELECT query_id, doc_id, round(x, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 10"""


@query("knn_batch_ip", _join_sql(_IP, "true"))
def knn_batch_ip(spark, sf_dir):
    return _rounded(search.knn_join(docs(spark, sf_dir), asked(spark, sf_dir), 10))


@query("knn_batch_l2_filtered", _join_sql(_L2, "docs.label > 4"))
def knn_batch_l2_filtered(spark, sf_dir):
    return _rounded(search.knn_join(docs(spark, sf_dir), asked(spark, sf_dir), 10, "L2", "label > 4"))


def _round_sql(x: str, bits: int, least: int) -> str:
    unit = f"pow(2.0, greatest(floor(log2(abs({x}))), {least}) - {bits})"
    return f"CASE WHEN {x} = 0 THEN {x} ELSE round_even({x} / {unit}, 0) * {unit} END"


for _type, (_bits, _least) in {"FLOAT16": (10, -14), "BFLOAT16": (7, -126)}.items():
    _short = "f16" if _type == "FLOAT16" else "bf16"

    def _quantize(spark, sf_dir, kind=_type):
        df = table(spark, sf_dir, "embeddings")
        return df.select(F.col("vec_id").alias("doc_id"), F.posexplode(vectors.quantized(F.col("embedding"), kind)).alias("i", "x")).select("doc_id", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))

    def _knn_reduced(spark, sf_dir, kind=_type):
        df = docs(spark, sf_dir).withColumn("vector", vectors.quantized(F.col("vector"), kind))
        return _rounded(search.knn(df, first_vector(spark, sf_dir), 10, vector_type=kind))

    _each = f"SELECT vec_id AS doc_id, CAST(i - 1 AS BIGINT) AS i, CAST(embedding[i] AS DOUBLE) AS y FROM embeddings, (SELECT unnest(range(1, 65)) AS i)"
    query(f"quantize_{_short}", f"WITH e AS ({_each}) SELECT doc_id, i, {_round_sql('y', _bits, _least)} AS x FROM e")(_quantize)
    query(
        f"knn_{_short}",
        f"WITH e AS ({_each}), r AS (SELECT doc_id, list({_round_sql('y', _bits, _least)} ORDER BY i) AS v FROM e GROUP BY doc_id), q AS (SELECT v FROM r WHERE doc_id = 0) "
        f"SELECT doc_id, {_IP.format(a='r.v', b='q.v')} AS distance FROM r, q ORDER BY distance, doc_id LIMIT 10",
    )(_knn_reduced)


@query("facet_counts", f"WITH {DOCS} SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM docs GROUP BY event_type")
def facet_counts(spark, sf_dir):
    return facets.facet_counts(docs(spark, sf_dir))


@query("facet_counts_map", f"WITH {DOCS} SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM docs GROUP BY event_type")
def facet_counts_map(spark, sf_dir):
    return facets.facet_counts(mapped(docs(spark, sf_dir)), "metadata")


_RANGES = " UNION ALL ".join(f"SELECT '{c}' AS field, CAST(min(trunc({c})) AS BIGINT) AS low, CAST(max(trunc({c})) AS BIGINT) AS high FROM docs" for c in ("label", "user_id", "value"))


@query("facet_ranges", f"WITH {DOCS} {_RANGES}")
def facet_ranges(spark, sf_dir):
    return facets.facet_ranges(docs(spark, sf_dir), fields=["label", "user_id", "value"])


@query("facet_ranges_map", f"WITH {DOCS} {_RANGES}")
def facet_ranges_map(spark, sf_dir):
    return facets.facet_ranges(mapped(docs(spark, sf_dir)), "metadata")


@query("facet_counts_of_hits", f"WITH {DOCS}, {_Q}, h AS (SELECT * FROM docs, q WHERE label > 4 ORDER BY {_IP.format(a='vector', b='q.v')}, doc_id LIMIT 50) SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM h GROUP BY event_type")
def facet_counts_of_hits(spark, sf_dir):
    return facets.facet_counts(_rounded(search.knn(docs(spark, sf_dir), first_vector(spark, sf_dir), 50, where="label > 4", keep=["event_type"])), fields=["event_type"])


@query("facet_counts_documents", "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def facet_counts_documents(spark, sf_dir):
    return facets.facet_counts(table(spark, sf_dir, "documents"), fields=["lang", "source"])


@query("get_document", f"WITH {DOCS} SELECT doc_id, label, event_type FROM docs WHERE doc_id = 7")
def get_document(spark, sf_dir):
    return search.by_ids(docs(spark, sf_dir), [7]).select("doc_id", "label", "event_type")


@query("get_many", f"WITH {DOCS} SELECT doc_id, label, event_type FROM docs WHERE doc_id IN (3, 1, 400, 1000000)")
def get_many(spark, sf_dir):
    return search.by_ids(docs(spark, sf_dir), [3, 1, 400, 1_000_000]).select("doc_id", "label", "event_type")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log made of events: errors delete, all else adds; the document is the user, the sequence the event."""
    op = F.when(F.col("event_type") == "error", oplog.DELETE).otherwise(oplog.ADD)
    record = F.when(op == oplog.ADD, F.create_map(F.lit("event_type"), values.column_value(F.col("event_type"), values.STRING)))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("doc_id"), F.lit(None).cast("array<float>").alias("vector"), record.alias("metadata"))


_OPS = "ops AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'ADD' END AS op, user_id AS doc_id, event_type FROM events)"
_LAST = "l AS (SELECT doc_id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(event_type, seq) AS event_type FROM ops GROUP BY doc_id)"


@query("oplog_fold", f"WITH {_OPS}, {_LAST} SELECT doc_id, seq, event_type FROM l WHERE op = 'ADD'")
def oplog_fold(spark, sf_dir):
    return oplog.live(operations(spark, sf_dir)).select("doc_id", "seq", F.element_at("metadata", "event_type")["s"].alias("event_type"))


@query("oplog_compact", f"WITH {_OPS}, {_LAST} SELECT doc_id, seq, op FROM l WHERE op = 'ADD' OR doc_id NOT IN (SELECT doc_id FROM ops WHERE op = 'ADD')")
def oplog_compact(spark, sf_dir):
    return oplog.compacted(operations(spark, sf_dir)).select("doc_id", "seq", "op")


_ORPHANS = "ops AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' OR user_id % 7 = 3 THEN 'DELETE' ELSE 'ADD' END AS op, user_id AS doc_id FROM events)"


@query("oplog_orphan_deletes", f"WITH {_ORPHANS} SELECT doc_id, max(seq) AS seq FROM ops GROUP BY doc_id HAVING count(*) FILTER (op = 'ADD') = 0")
def oplog_orphan_deletes(spark, sf_dir):
    """The whole log, in which all entries of every seventh user are deletions."""
    never = F.col("doc_id") % 7 == 3
    ops = operations(spark, sf_dir).withColumn("metadata", F.when(~never, F.col("metadata"))).withColumn("op", F.when(never, oplog.DELETE).otherwise(F.col("op")))
    return oplog.compacted(ops).where(F.col("op") == oplog.DELETE).select("doc_id", "seq")


@query("oplog_crc_prefix", "SELECT event_id AS seq, user_id AS doc_id FROM events WHERE event_id < (SELECT (max(event_id) + 1) * 7 // 10 FROM events)")
def oplog_crc_prefix(spark, sf_dir):
    """The log is damaged at seven and nine tenths of its length."""
    sealed = oplog.sealed(operations(spark, sf_dir))
    ends = sealed.agg((F.max("seq") + 1).alias("end"))
    at = lambda n: F.expr(f"end * {n} div 10")
    damaged = sealed.join(F.broadcast(ends)).withColumn("crc", F.when(F.col("seq").isin(at(7), at(9)), F.col("crc") + 1).otherwise(F.col("crc")))  # one row
    return oplog.intact(damaged.drop("end")).select("seq", "doc_id")


@query("upsert_revive", f"WITH {_OPS}, {_LAST} SELECT doc_id FROM l WHERE op = 'ADD' AND doc_id IN (SELECT doc_id FROM ops WHERE op = 'DELETE')")
def upsert_revive(spark, sf_dir):
    ops = operations(spark, sf_dir)
    gone = ops.where(F.col("op") == oplog.DELETE).select("doc_id").distinct()
    return oplog.live(ops).select("doc_id").join(gone, "doc_id", "left_semi")


@query("collection_status", f"WITH {_OPS}, {_LAST} SELECT count(*) FILTER (op = 'ADD') AS live, count(*) FILTER (op = 'DELETE') AS deleted, (SELECT count(*) FROM ops) AS entries FROM l")
def collection_status(spark, sf_dir):
    ops = operations(spark, sf_dir)
    total = ops.agg(F.count("*").alias("entries"))
    counts = oplog.last_states(ops).agg(F.count_if(F.col("op") == oplog.ADD).alias("live"), F.count_if(F.col("op") == oplog.DELETE).alias("deleted"))
    return counts.join(F.broadcast(total))  # one row each


@query("save_load_roundtrip", f"WITH {DOCS} SELECT doc_id, label, user_id, value, event_type, round(list_sum(vector::DOUBLE[]), 6) + 0.0 AS total FROM docs WHERE doc_id % 10 <> 3")
def save_load_roundtrip(spark, sf_dir):
    root = scratch_folder(spark)
    engine = Engine(spark, root)
    collection = engine.create(Settings("round_trip", 64))
    collection.add_frame(mapped(docs(spark, sf_dir)))
    engine.save("round_trip")
    engine.drop("round_trip")
    collection = engine.load("round_trip")
    gone = [r[0] for r in table(spark, sf_dir, "embeddings").where("vec_id % 10 = 3").select("vec_id").collect()]
    collection.delete(gone)
    get = lambda n, f: F.try_element_at("metadata", F.lit(n))[f].alias(n)
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 6) + F.lit(0.0)
    return collection.documents().select("doc_id", get("label", "l"), get("user_id", "l"), get("value", "d"), get("event_type", "s"), total.alias("total"))


def live_collection(spark: SparkSession, sf_dir: str) -> Collection:
    """All documents saved; then in the log every tenth deleted and every tenth replaced by one of label 100."""
    engine = Engine(spark, scratch_folder(spark))
    collection = engine.create(Settings("live", 64))
    rows = docs(spark, sf_dir)
    collection.add_frame(mapped(rows))
    engine.save("live")
    gone = rows.where("doc_id % 10 = 3").select(F.col("doc_id").alias("at"), F.lit(oplog.DELETE).alias("op"), "doc_id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast(values.METADATA).alias("metadata"))
    collection.append(gone, values.LARGEST_ID + 1)
    collection.add_frame(mapped(rows.where("doc_id % 10 = 5").withColumn("label", F.lit(100).cast("long"))))
    return collection


_LIVE = f"WITH {DOCS}, live AS (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN 100 ELSE label END AS label, event_type, vector FROM docs WHERE doc_id % 10 <> 3)"
_LIVE_KNN = _LIVE + ", {q} SELECT doc_id, {ip} AS distance FROM live, q WHERE {where} ORDER BY distance, doc_id LIMIT {k}"


@query("collection_search_live", _LIVE_KNN.format(q=_Q, ip=_IP.format(a="vector", b="q.v"), where="label > 4", k=20))
def collection_search_live(spark, sf_dir):
    return _rounded(live_collection(spark, sf_dir).search(first_vector(spark, sf_dir), 20, "label > 4"))


@query("collection_search_selective", _LIVE_KNN.format(q=_Q, ip=_IP.format(a="vector", b="q.v"), where="label = 7 AND event_type = 'click'", k=20))
def collection_search_selective(spark, sf_dir):
    """By the collection's index, which answers a filter that passes few rows exactly."""
    collection = live_collection(spark, sf_dir)
    collection.build_index(lists=16)
    return _rounded(collection.search(first_vector(spark, sf_dir), 20, 'label = 7 AND event_type = "click"', approximate=True))


@query("collection_facets_live", _LIVE + " SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM live WHERE label > 50 GROUP BY event_type")
def collection_facets_live(spark, sf_dir):
    return live_collection(spark, sf_dir).facets("label > 50")[0]


@query("collection_status_live", f"WITH {DOCS} SELECT count(*) FILTER (doc_id % 10 <> 3) AS live, count(*) FILTER (doc_id % 10 = 3) AS deleted, count(*) AS known FROM docs")
def collection_status_live(spark, sf_dir):
    status = live_collection(spark, sf_dir).status()
    known = status["currentElements"]
    return spark.createDataFrame([(known - status["deletedElements"], status["deletedElements"], known)], "live long, deleted long, known long")


@query("collection_get_places", _LIVE + " SELECT place, p.doc_id, label FROM (VALUES (0, 13), (1, 5), (2, 400), (3, 5), (4, 1000000)) p(place, doc_id) LEFT JOIN live USING (doc_id)")
def collection_get_places(spark, sf_dir):
    rows = live_collection(spark, sf_dir).get_many([13, 5, 400, 5, 1_000_000])
    return rows.select(F.col("place").cast("int").alias("place"), F.col("doc_id").cast("int").alias("doc_id"), F.try_element_at("metadata", F.lit("label"))["l"].alias("label"))


@query("metadata_json_roundtrip", f"WITH {DOCS} SELECT doc_id, label, event_type FROM docs WHERE event_type = 'click'")
def metadata_json_roundtrip(spark, sf_dir):
    text = mapped(docs(spark, sf_dir)).select("doc_id", values.metadata_to_json(F.col("metadata")).alias("j"))
    rows = matching(text.select("doc_id", values.metadata_from_json(F.col("j")).alias("metadata")), 'event_type = "click"', "metadata")
    return rows.select("doc_id", F.element_at("metadata", "label")["l"].alias("label"), F.element_at("metadata", "event_type")["s"].alias("event_type"))


_RESPONSE = """h AS (SELECT *, row_number() OVER (ORDER BY distance, doc_id) AS place FROM (SELECT docs.*, {ip} AS distance FROM docs, q WHERE label > 4 ORDER BY distance, doc_id LIMIT 5)),
  m AS (SELECT *, '{{"event_type":"' || event_type || '","label":' || label || ',"user_id":' || user_id || CASE WHEN value IS NULL THEN '' ELSE ',"value":' || value END || '}}' AS metadata FROM h)
  SELECT '{{"hits":[' || string_agg(doc_id, ',' ORDER BY place) || '],"distances":[' || string_agg(distance, ',' ORDER BY place) || '],"metadatas":[' || string_agg(metadata, ',' ORDER BY place) || ']}}' AS response FROM m"""


@query("search_response", f"WITH {DOCS}, {_Q}, " + _RESPONSE.format(ip=_IP.format(a="vector", b="q.v")))
def search_response(spark, sf_dir):
    return search.responses(_rounded(search.knn(mapped(docs(spark, sf_dir)), first_vector(spark, sf_dir), 5, where="label > 4", metadata="metadata", keep=["metadata"])), "metadata")


@query("knn_ivf")
def knn_ivf(spark, sf_dir):
    """The index is written, a folder a list, and read back."""
    path = scratch_folder(spark)
    ann.build(docs(spark, sf_dir), lists=45).write(path)
    return ann.load(spark, path).search_join(asked(spark, sf_dir), 10)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
