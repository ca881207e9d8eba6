"""Queries for data gates, splits, scaling, neighbours, pseudo-labels, model choice and geometry."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lamina.functions import geometry, plates
from lamina.operators import evaluation, learning
from lamina.session import table


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def data_gate(spark, sf_dir):
    out = learning.data_gate(vectors(spark, sf_dir), "embedding", "label", -1.0, 1.0, 10)
    return out.withColumn("imbalance", F.round("imbalance", 9))


def label_balance(spark, sf_dir):
    """Quality by toxicity, one column a value of the second."""
    wide = table(spark, sf_dir, "labels").groupBy("quality").pivot("toxic", [0, 1]).agg(F.count(F.lit(1)))
    return wide.select("quality", F.coalesce("0", F.lit(0)).alias("clean"), F.coalesce("1", F.lit(0)).alias("toxic"))


def stratified_split(spark, sf_dir):
    return learning.stratified_split(vectors(spark, sf_dir).select("vec_id", "label"), "label", [F.col("vec_id")])


def stratified_folds(spark, sf_dir):
    return learning.stratified_folds(vectors(spark, sf_dir).select("vec_id", "label"), "label", [F.col("vec_id")], 5)


def standardize(spark, sf_dir):
    out = learning.standard_scale(vectors(spark, sf_dir), "vec_id", "embedding")
    return out.select("vec_id", "dim", F.round("z", 6).alias("z"))


def knn_vote(spark, sf_dir):
    """Votes of the five nearest of all vectors for every vector whose id 20 divides."""
    rows = vectors(spark, sf_dir)
    near = learning.nearest(rows, rows.filter("vec_id % 20 = 0"), "vec_id", "embedding", "label")
    votes = learning.majority(near, "label")
    reach = near.groupBy("query").agg(F.max("distance").alias("d"))
    return votes.join(reach, "query").select("query", "vote", F.round("d", 6).alias("fifth"))


def pseudo_labels(spark, sf_dir):
    """Documents as candidate characters: why each is refused, or its place among its class, of which twenty are kept."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    seen = plates.upper_letter(F.substring("text", 1, 1))
    margin = F.col("doc_id") * 37 % 100 / 100
    reason = (
        F.when(F.col("quality").isNull(), "unreadable").when(F.col("quality") == 0, "ocr_failed").when(F.col("n_chars") < 100, "bad_char_count")
        .when(~seen.rlike("^[A-Z]$"), "unsupported_char").when(F.col("doc_id") % 7 == 0, "grammar_forced_char").when(margin < 0.35, "low_margin_char")
    )
    rows = docs.select("doc_id", seen.alias("class"), reason.alias("reason"))
    accepted = learning.first_of_class(rows.filter("reason is null"), "class", [F.col("doc_id")], 20)
    accepted = accepted.select("doc_id", "class", F.when(~F.col("kept"), "class_full").alias("reason"))
    return accepted.unionByName(rows.filter("reason is not null")).select("doc_id", "class", F.coalesce("reason", F.lit("kept")).alias("reason"))


def reject_reasons(spark, sf_dir):
    return pseudo_labels(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def versions(spark, sf_dir):
    """Each customer's orders as versions of a model, the accuracy told from the price."""
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    accuracy = F.floor(F.col("o_totalprice") * 100).cast("long") % 2000 / 10000 + 0.8
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), nth.cast("long").alias("version"), F.round(accuracy, 4).alias("accuracy"))


VERSIONS_SQL = """
WITH versions AS (SELECT o_custkey AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, round(floor(o_totalprice * 100)::BIGINT % 2000 / 10000 + 0.8, 4) AS accuracy FROM orders),
c AS (SELECT *, max(CASE WHEN accuracy >= 0.9 THEN accuracy END) OVER (PARTITION BY name ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS champion FROM versions),
promoted AS (SELECT *, accuracy >= 0.9 AND (champion IS NULL OR accuracy >= champion) AS promoted FROM c)"""


def promotions(spark, sf_dir):
    return learning.promotions(versions(spark, sf_dir), 0.9)


def latest_alias(spark, sf_dir):
    found = learning.production_alias(learning.promotions(versions(spark, sf_dir), 0.9))
    return found.withColumn("production", F.coalesce("production", F.lit(-1)))


def model_consistency(spark, sf_dir):
    """Served against registered version of each supplier; either side may be missing, and null is inconsistent."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    served = suppliers.filter("s_suppkey % 4 <> 0").select("s_suppkey", (F.col("s_suppkey") % 5).alias("served"))
    registered = suppliers.filter("s_suppkey % 6 <> 0").select("s_suppkey", (F.col("s_nationkey") % 5).cast("long").alias("registered"))
    out = served.join(registered, "s_suppkey", "full")
    out = out.withColumn("consistent", F.coalesce(F.col("served") == F.col("registered"), F.lit(False)))
    return out.na.fill(-1, ["served", "registered"])


def fold_interval(spark, sf_dir):
    """Mean and 95 % interval over five folds of each class's mean first component."""
    rows = learning.stratified_folds(vectors(spark, sf_dir), "label", [F.col("vec_id")], 5)
    scores = rows.groupBy("label", "fold").agg(F.avg(F.get("embedding", F.lit(0)).cast("double")).alias("score"))
    return learning.fold_interval(scores, "label").select("label", "folds", *[F.round(c, 7).alias(c) for c in ("mean", "deviation", "half_width")])


def constrained_argmax(spark, sf_dir):
    """Argmax over the first 31 components, free and with only the classes that a position allows, and the margin."""
    scores = F.transform(F.slice("embedding", 1, 31), lambda x: x.cast("double"))
    allowed = F.transform(scores, lambda s, i: F.when(F.col("vec_id") % 3 == 2, i >= 10).otherwise(i < 10))
    free = F.array_position(scores, F.array_max(scores)) - 1
    rows = vectors(spark, sf_dir).select("vec_id", scores.alias("s"), allowed.alias("a"))
    best = geometry.constrained_argmax(F.col("s"), F.col("a"))
    return rows.select("vec_id", (F.array_position("s", F.array_max("s")) - 1).alias("free"), best.alias("held"), F.round(geometry.margin(F.col("s"), best.cast("int")), 6).alias("margin"))


def polygons(spark, sf_dir):
    """Four-cornered polygons from the first eight components, in image units of 640 by 480."""
    part = lambda i: (F.get("embedding", F.lit(i)).cast("double") + 0.5)
    xs, ys = F.array(*[part(i) for i in (0, 2, 4, 6)]), F.array(*[part(i) for i in (1, 3, 5, 7)])
    return vectors(spark, sf_dir).select("vec_id", xs.alias("xs"), ys.alias("ys"))


def polygon_boxes(spark, sf_dir):
    box = geometry.clipped_box(F.col("xs"), F.col("ys"))
    out = polygons(spark, sf_dir).select("vec_id", F.round(geometry.polygon_area(F.col("xs"), F.col("ys")), 6).alias("area"), box.alias("b"))
    return out.select("vec_id", "area", *[F.round(f"b.{c}", 6).alias(c) for c in ("xc", "yc", "w", "h")], geometry.plate_type(F.col("b.w"), F.col("b.h")).alias("plate_type"))


def corner_order(spark, sf_dir):
    points = F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    corners = polygons(spark, sf_dir).select("vec_id", geometry.ordered_corners(points).alias("c"))
    return corners.select("vec_id", *[F.round(F.get("c", F.lit(i))[a], 6).alias(f"{name}_{a}") for i, name in enumerate(("tl", "tr", "br", "bl")) for a in "xy"])


def largest_polygon(spark, sf_dir):
    """The vector with the largest polygon of each label; the smaller id in a tie."""
    rows = polygons(spark, sf_dir).join(vectors(spark, sf_dir).select("vec_id", "label"), "vec_id").withColumn("area", F.round(geometry.polygon_area(F.col("xs"), F.col("ys")), 6))
    return evaluation.best_of(rows, "label", [F.desc("area"), F.col("vec_id")]).select("label", "vec_id", "area")


def top_samples(spark, sf_dir):
    """The four longest documents of each source, as a contact sheet takes them."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return learning.top_of_class(rows, "source", [F.desc("n_chars"), F.col("doc_id")], 4).select("source", "doc_id", "n_chars", "nth")


def distinct_variants(spark, sf_dir):
    """Crop variants: large enough, one for each size, angle to a tenth and enhancement; the first wins."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") + 10).alias("h"), (F.col("l_partkey") % 5 * 20 + 20).alias("w"), (F.round(F.col("l_discount").cast("double") * 100) / 10).alias("angle"), (F.col("l_returnflag") == "R").alias("enhance"))
    rows = rows.filter("h >= 18 and w >= 35")
    return rows.groupBy("h", "w", "angle", "enhance").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f"), F.count("*").alias("n")).select("h", "w", "angle", "enhance", "f.l_orderkey", "f.l_linenumber", "n")


def union_labels(spark, sf_dir):
    """Items of two sets as one, with what each set lacks of the other's classes."""
    docs = table(spark, sf_dir, "documents")
    classes = docs.groupBy("lang").agg(F.array_sort(F.collect_set(F.when(F.col("doc_id") % 2 == 0, F.col("source")))).alias("even"), F.array_sort(F.collect_set(F.when(F.col("doc_id") % 3 == 0, F.col("source")))).alias("third"))
    return classes.select("lang", F.concat_ws(",", F.array_sort(F.array_except("even", "third"))).alias("only_even"), F.concat_ws(",", F.array_sort(F.array_intersect("even", "third"))).alias("both"), F.concat_ws(",", F.array_sort(F.array_union("even", "third"))).alias("all"))


def zipped_crops(spark, sf_dir):
    """Order lines as the crops of a plate, beside the characters of a text of one to seven."""
    crops = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))).alias("crops"))
    text = F.substring(F.lit("51F1234"), F.lit(1), (F.col("o_custkey") % 7 + 1).cast("int"))
    rows = crops.join(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), F.col("l_orderkey") == F.col("o_orderkey"))
    return learning.zipped(rows, "crops", "text", "l_orderkey")


QUERIES = {
    f.__name__: f
    for f in (
        data_gate, label_balance, stratified_split, stratified_folds, standardize, knn_vote, pseudo_labels, reject_reasons, promotions, latest_alias, model_consistency, fold_interval,
        constrained_argmax, polygon_boxes, corner_order, largest_polygon, top_samples, distinct_variants, union_labels, zipped_crops,
    )
}

_POLY = "WITH p AS (SELECT vec_id, label, [embedding[i]::DOUBLE + 0.5 for i in [1, 3, 5, 7]] AS xs, [embedding[i]::DOUBLE + 0.5 for i in [2, 4, 6, 8]] AS ys FROM embeddings)"
_AREA = "abs(list_sum([xs[i] * ys[i % 4 + 1] - xs[i % 4 + 1] * ys[i] for i in [1, 2, 3, 4]])) / 2"
_FOLDS = "f AS (SELECT vec_id, label, embedding, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS fold FROM embeddings)"
_REASONS = """WITH d AS (SELECT d.doc_id, upper(substr(text, 1, 1)) AS class, CASE WHEN quality IS NULL THEN 'unreadable' WHEN quality = 0 THEN 'ocr_failed' WHEN n_chars < 100 THEN 'bad_char_count'
  WHEN NOT regexp_full_match(upper(substr(text, 1, 1)), '[A-Z]') THEN 'unsupported_char' WHEN d.doc_id % 7 = 0 THEN 'grammar_forced_char' WHEN d.doc_id * 37 % 100 / 100 < 0.35 THEN 'low_margin_char' END AS r
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
o AS (SELECT doc_id, class, CASE WHEN r IS NOT NULL THEN r WHEN row_number() OVER (PARTITION BY r IS NULL, class ORDER BY doc_id) > 20 THEN 'class_full' ELSE 'kept' END AS reason FROM d)"""
ORACLES = {
    "data_gate": """WITH c AS (SELECT label, count(*) AS n, bool_or(list_bool_or([isnan(x) for x in embedding])) AS nan, min(list_min(embedding)) AS lo, max(list_max(embedding)) AS hi FROM embeddings GROUP BY 1)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_classes, min(n) AS min_rows, max(n) AS max_rows, round(max(n) / min(n), 9) AS imbalance, bool_or(nan) AS has_nan, min(lo) >= -1 AND max(hi) <= 1 AS in_range,
  NOT bool_or(nan) AND min(lo) >= -1 AND max(hi) <= 1 AND count(*) >= 10 AS passed FROM c""",
    "label_balance": "SELECT quality, count_if(toxic = 0)::BIGINT AS clean, count_if(toxic = 1)::BIGINT AS toxic FROM labels GROUP BY quality",
    "stratified_split": "SELECT vec_id, label, percent_rank() OVER (PARTITION BY label ORDER BY vec_id) > 0.8 AS is_test FROM embeddings",
    "stratified_folds": f"WITH {_FOLDS} SELECT vec_id, label, fold::INT AS fold FROM f",
    "standardize": """WITH l AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS d FROM l GROUP BY 1)
SELECT vec_id, l.dim::INT AS dim, round(CASE WHEN d > 0 THEN (x - m) / d ELSE 0 END, 6) AS z FROM l JOIN s ON l.dim = s.dim""",
    "knn_vote": """WITH e AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings),
d AS (SELECT q.vec_id AS query, r.vec_id, r.label, list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM e q, e r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, vec_id) AS nth FROM d), t AS (SELECT query, label, count(*) AS c FROM n WHERE nth <= 5 GROUP BY ALL),
v AS (SELECT query, label AS vote FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, label) AS k FROM t) WHERE k = 1)
SELECT v.query, vote, round(dist, 6) AS fifth FROM v JOIN n ON v.query = n.query AND nth = 5""",
    "pseudo_labels": _REASONS + " SELECT * FROM o",
    "reject_reasons": _REASONS + " SELECT reason, count(*) AS n FROM o GROUP BY reason",
    "promotions": VERSIONS_SQL + " SELECT * FROM promoted",
    "latest_alias": VERSIONS_SQL + " SELECT name, max(version) AS latest, coalesce(max(CASE WHEN promoted THEN version END), -1) AS production, max_by(accuracy, version) FILTER (promoted) AS accuracy FROM promoted GROUP BY name",
    "model_consistency": """WITH a AS (SELECT s_suppkey, s_suppkey % 5 AS served FROM supplier WHERE s_suppkey % 4 <> 0), b AS (SELECT s_suppkey, (s_nationkey % 5)::BIGINT AS registered FROM supplier WHERE s_suppkey % 6 <> 0)
SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, coalesce(served, -1) AS served, coalesce(registered, -1) AS registered, coalesce(served = registered, FALSE) AS consistent FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey""",
    "fold_interval": f"""WITH {_FOLDS}, s AS (SELECT label, fold, avg(embedding[1]::DOUBLE) AS score FROM f GROUP BY ALL)
SELECT label, count(*) AS folds, round(avg(score), 7) AS mean, round(stddev_samp(score), 7) AS deviation, round(2.776 * stddev_samp(score) / sqrt(5), 7) AS half_width FROM s GROUP BY label""",
    "constrained_argmax": """WITH s AS (SELECT vec_id, [x::DOUBLE for x in embedding[1:31]] AS s FROM embeddings), h AS (SELECT vec_id, s, CASE WHEN vec_id % 3 = 2 THEN s[11:31] ELSE s[1:10] END AS a FROM s),
b AS (SELECT vec_id, s, list_position(s, list_max(s)) - 1 AS free, list_position(a, list_max(a)) - 1 + CASE WHEN vec_id % 3 = 2 THEN 10 ELSE 0 END AS held FROM h)
SELECT vec_id, free::BIGINT AS free, held::BIGINT AS held, round(s[held + 1] - list_max([s[i] for i in range(1, 32) if i <> held + 1]), 6) AS margin FROM b""",
    "polygon_boxes": _POLY + f""", b AS (SELECT vec_id, {_AREA} AS area, least(greatest(list_min(xs), 0), 1) AS x1, least(greatest(list_max(xs), 0), 1) AS x2, least(greatest(list_min(ys), 0), 1) AS y1, least(greatest(list_max(ys), 0), 1) AS y2 FROM p)
SELECT vec_id, round(area, 6) AS area, CASE WHEN x2 > x1 AND y2 > y1 THEN round((x1 + x2) / 2, 6) END AS xc, CASE WHEN x2 > x1 AND y2 > y1 THEN round((y1 + y2) / 2, 6) END AS yc, CASE WHEN x2 > x1 AND y2 > y1 THEN round(x2 - x1, 6) END AS w,
  CASE WHEN x2 > x1 AND y2 > y1 THEN round(y2 - y1, 6) END AS h, CASE WHEN x2 > x1 AND y2 > y1 AND (x2 - x1) / (y2 - y1) > 2.5 THEN '1line' ELSE '2line' END AS plate_type FROM b""",
    "corner_order": _POLY + """, s AS (SELECT vec_id, xs, ys, [xs[i] + ys[i] for i in [1, 2, 3, 4]] AS a, [ys[i] - xs[i] for i in [1, 2, 3, 4]] AS d FROM p),
i AS (SELECT *, list_position(a, list_min(a)) AS tl, list_position(d, list_min(d)) AS tr, list_position(a, list_max(a)) AS br, list_position(d, list_max(d)) AS bl FROM s)
SELECT vec_id, """ + ", ".join(f"round({a}s[{c}], 6) AS {c}_{a}" for c in ("tl", "tr", "br", "bl") for a in "xy") + " FROM i",
    "largest_polygon": _POLY + f", a AS (SELECT label, vec_id, round({_AREA}, 6) AS area FROM p) SELECT label, vec_id, area FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY area DESC, vec_id) AS n FROM a) WHERE n = 1",
    "top_samples": "SELECT source, doc_id, n_chars, nth::INT AS nth FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM documents) WHERE nth <= 4",
    "distinct_variants": """WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity::INT + 10 AS h, l_partkey % 5 * 20 + 20 AS w, round(l_discount::DOUBLE * 100) / 10 AS angle, l_returnflag = 'R' AS enhance FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY h, w, angle, enhance ORDER BY l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY h, w, angle, enhance) AS n FROM v WHERE h >= 18 AND w >= 35)
SELECT h, w, angle, enhance, l_orderkey, l_linenumber, n FROM r WHERE k = 1""",
    "zipped_crops": """WITH c AS (SELECT l_orderkey, list(l_linenumber::INT ORDER BY l_linenumber) AS crops FROM lineitem GROUP BY 1),
z AS (SELECT l_orderkey, crops, substr('51F1234', 1, (o_custkey % 7 + 1)::INT) AS text FROM c JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, unnest(range(len(crops)))::INT AS place, unnest(crops) AS crop, unnest(string_split(text, '')) AS label FROM z WHERE len(crops) = length(text)""",
    "union_labels": """WITH s AS (SELECT lang, source, bool_or(doc_id % 2 = 0) AS even, bool_or(doc_id % 3 = 0) AS third FROM documents GROUP BY ALL)
SELECT lang, coalesce(string_agg(source, ',' ORDER BY source) FILTER (even AND NOT third), '') AS only_even, coalesce(string_agg(source, ',' ORDER BY source) FILTER (even AND third), '') AS both,
  coalesce(string_agg(source, ',' ORDER BY source) FILTER (even OR third), '') AS all FROM s GROUP BY lang""",
}
