"""Queries over plate-like labels and readings, told from ``orders`` by arithmetic on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lamina.functions import geometry, lines, plates
from lamina.operators import evaluation, learning, scenes
from lamina.session import table

LETTERS = "ABCDEFGHKLMNPRSTUVXYZ"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_orderpriority, two_line, label, raw: one reading in five is right, the others have a known fault."""
    key = F.col("o_orderkey")
    two_line = key % 7 == 0
    head = F.concat(F.lpad((key % 100).cast("string"), 2, "0"), F.substring(F.lit(LETTERS), (key % 21 + 1).cast("int"), F.lit(1)))
    label = F.concat(head, F.when(two_line, (key % 9 + 1).cast("string")).otherwise(""), F.lpad((key * 7919 % 100000).cast("string"), 5, "0"))
    fault = key % 5
    tail = F.substring("label", 4, 100)
    raw = (
        F.when(fault == 1, F.concat(F.substring("label", 1, 3), F.translate(tail, "8", "B")))
        .when(fault == 2, F.concat(F.substring("label", 1, 2), F.lit("-"), F.lower(F.substring("label", 3, 1)), F.translate(tail, "5", "S")))
        .when(fault == 3, F.substring("label", F.lit(1), F.length("label") - 1))
        .when(fault == 4, F.concat(F.translate(F.substring("label", 1, 2), "01", "OI"), F.translate(F.substring("label", 3, 1), "GLASB", "61458"), tail))
        .otherwise(F.col("label"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", two_line.alias("two_line"), label.alias("label")).withColumn("raw", raw)


READINGS_SQL = f"""
WITH named AS (
  SELECT o_orderkey, o_orderpriority, o_orderkey % 7 = 0 AS two_line,
    lpad((o_orderkey % 100)::VARCHAR, 2, '0') || substr('{LETTERS}', (o_orderkey % 21 + 1)::INT, 1)
    || CASE WHEN o_orderkey % 7 = 0 THEN (o_orderkey % 9 + 1)::VARCHAR ELSE '' END || lpad((o_orderkey * 7919 % 100000)::VARCHAR, 5, '0') AS label
  FROM orders),
readings AS (
  SELECT *, CASE o_orderkey % 5
    WHEN 1 THEN label[:3] || translate(label[4:], '8', 'B')
    WHEN 2 THEN label[:2] || '-' || lower(label[3:3]) || translate(label[4:], '5', 'S')
    WHEN 3 THEN label[:length(label) - 1]
    WHEN 4 THEN translate(label[:2], '01', 'OI') || translate(label[3:3], 'GLASB', '61458') || label[4:]
    ELSE label END AS raw FROM named)"""

CORRECTED_SQL = READINGS_SQL + """,
plain AS (SELECT *, regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') AS t FROM readings),
forms AS (
  SELECT *, [t,
    translate(t[:2], 'BGILOSZT', '86110521') || translate(t[3:3], '014568', 'GLASGB') || translate(t[4:], 'BGILOSZT', '86110521'),
    translate(t[:2], 'BGILOSZT', '86110521') || translate(t[3:4], '014568', 'GLASGB') || translate(t[5:], 'BGILOSZT', '86110521')] AS f FROM plain),
short AS (
  SELECT *, list_transform(f, lambda x: CASE WHEN length(x) = 9 AND regexp_matches(x[4:4], '[0-9]') AND x[4:4] = x[5:5]
    AND (regexp_matches(x[:3] || x[5:], '^[0-9]{2}[A-Z][0-9]{4,6}$') OR regexp_matches(x[:3] || x[5:], '^[0-9]{2}[A-Z][A-Z0-9]?[0-9]{3,5}$'))
    THEN x[:3] || x[5:] ELSE x END) AS g FROM forms),
corrected AS (
  SELECT *, coalesce(list_filter(g, lambda x: regexp_matches(x, '^[0-9]{2}[A-Z][0-9]{4,6}$'))[1],
    list_filter(g, lambda x: regexp_matches(x, '^[0-9]{2}[A-Z][A-Z0-9]?[0-9]{3,5}$'))[1], t) AS fixed FROM short)"""


def plate_correct(spark, sf_dir):
    fixed = plates.corrected(F.col("raw"))
    return readings(spark, sf_dir).select("o_orderkey", "raw", fixed.alias("corrected")).withColumn("valid", plates.is_valid(F.col("corrected")))


def plate_format_score(spark, sf_dir):
    text = plates.normalised(F.col("raw"))
    score = plates.format_score(F.col("t"), F.col("two_line"), F.lit(4))
    return readings(spark, sf_dir).select("o_orderkey", "two_line", text.alias("t")).select("o_orderkey", F.round(score, 6).alias("score"))


def two_models(spark, sf_dir) -> DataFrame:
    """Readings of two models: the plain text, and the text after grammar correction."""
    both = F.explode(F.array(F.struct(F.lit("grammar").alias("model"), plates.corrected(F.col("raw")).alias("prediction")), F.struct(F.lit("plain").alias("model"), plates.normalised(F.col("raw")).alias("prediction"))))
    return readings(spark, sf_dir).select("o_orderkey", "o_orderpriority", "two_line", "label", both.alias("m")).select("*", "m.*").drop("m")


MODELS_SQL = CORRECTED_SQL + """,
models AS (
  SELECT o_orderkey, o_orderpriority, two_line, label, 'grammar' AS model, fixed AS prediction FROM corrected
  UNION ALL SELECT o_orderkey, o_orderpriority, two_line, label, 'plain', t FROM corrected),
scored AS (SELECT *, label = prediction AS correct, levenshtein(label, prediction) AS d, greatest(length(label), length(prediction)) AS m FROM models)"""


def ocr_eval(spark, sf_dir):
    out = evaluation.accuracy(evaluation.score_readings(two_models(spark, sf_dir)), "model")
    gate = (F.col("exact_rate") >= 0.5) & (F.col("char_accuracy") >= 0.85)
    return out.select("model", "n", "exact", F.round("exact_rate", 9).alias("exact_rate"), F.round("char_accuracy", 9).alias("char_accuracy"), gate.alias("passed"))


def eval_detail(spark, sf_dir):
    scored = evaluation.score_readings(two_models(spark, sf_dir))
    return scored.select("model", "o_orderkey", "label", "prediction", "correct", "edit_distance", F.round("char_accuracy", 9).alias("char_accuracy"))


def eval_by_group(spark, sf_dir):
    rows = evaluation.accuracy(evaluation.score_readings(two_models(spark, sf_dir)), "model", "o_orderpriority", "two_line")
    return evaluation.with_interval(rows).select("model", "o_orderpriority", "two_line", "n", "exact", *[F.round(c, 9).alias(c) for c in ("exact_rate", "char_accuracy", "low", "high")])


def characters(spark, sf_dir) -> DataFrame:
    rows = readings(spark, sf_dir).select("label", plates.normalised(F.col("raw")).alias("prediction"))
    return evaluation.paired_characters(rows)


PAIRS_SQL = CORRECTED_SQL + """,
pairs AS (
  SELECT label[i:i] AS truth, t[i:i] AS guess FROM (SELECT label, t, unnest(range(1, length(label) + 1)) AS i FROM corrected WHERE length(label) = length(t))),
counts AS (SELECT truth, guess, count(*) AS n FROM pairs GROUP BY ALL)"""


def confusion_counts(spark, sf_dir):
    return evaluation.confusion(characters(spark, sf_dir))


def confusion_table(spark, sf_dir):
    return evaluation.confusion_table(characters(spark, sf_dir), list("0123456789BSOI"))


def class_report(spark, sf_dir):
    report = evaluation.class_report(evaluation.confusion(characters(spark, sf_dir)))
    return report.select("class", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


REPORT_SQL = PAIRS_SQL + """,
report AS (
  SELECT coalesce(a.c, b.c) AS class, coalesce(support, 0)::BIGINT AS support, coalesce(hits / nullif(predicted, 0), 0)::DOUBLE AS precision,
    coalesce(hits / nullif(support, 0), 0)::DOUBLE AS recall
  FROM (SELECT truth AS c, sum(n) AS support, sum(CASE WHEN truth = guess THEN n ELSE 0 END) AS hits FROM counts GROUP BY 1) a
  FULL JOIN (SELECT guess AS c, sum(n) AS predicted FROM counts GROUP BY 1) b ON a.c = b.c),
full_report AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM report)"""


def macro_scores(spark, sf_dir):
    out = evaluation.averages(evaluation.class_report(evaluation.confusion(characters(spark, sf_dir))))
    return out.select("support", *[F.round(c, 9).alias(c) for c in out.columns if c != "support"])


def fairness_groups(spark, sf_dir):
    out = evaluation.group_fairness(characters(spark, sf_dir))
    return out.select("n_digits", "n_letters", "fair", *[F.round(c, 9).alias(c) for c in ("digits", "letters", "disparity")])


def pair_confusion(spark, sf_dir):
    pairs = [(a, b) for group in ("8B", "0O", "1I", "5S", "6G", "4A") for a in group for b in group if a != b]
    similar = spark.createDataFrame(pairs, "truth string, guess string")
    return evaluation.pair_confusion(evaluation.confusion(characters(spark, sf_dir)), similar)


def class_equity(spark, sf_dir):
    out = evaluation.class_equity(characters(spark, sf_dir))
    return out.select("truth", "n", "lags", *[F.round(c, 9).alias(c) for c in ("accuracy", "mean_accuracy", "std_accuracy", "equity_gap")])


def text_helpers(spark, sf_dir):
    """Stem, label path, model spec, feature method, flags, comparison key and class characters over part names."""
    name = F.col("p_name")
    path = F.concat(F.lit("data/images/"), F.translate(name, " ", "/"), F.lit("/images2/"), F.col("p_partkey").cast("string"), F.lit(".v1.jpg"))
    spec = plates.model_spec(F.when(F.col("p_partkey") % 3 == 0, name).otherwise(F.concat(F.translate(name, " ", "_"), F.lit("=m/"), F.col("p_partkey").cast("string"), F.lit("=x"))))
    method = F.element_at(F.array(*[F.lit(x) for x in (" HOG-324", "Hog", "haar2", "pixels", "ResNet18", "", "Other ")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    word = F.element_at(F.array(*[F.lit(x) for x in ("Yes", " crop", "no", " ", "1")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", plates.safe_stem(F.concat(name, F.lit(" #1/"))).alias("stem"), plates.label_path(path).alias("label_path"), spec["name"].alias("model"), spec["path"].alias("path"),
        plates.feature_method(method).alias("method"), plates.flag(word, True).alias("flag"), plates.comparison_key(F.concat(F.lit("5-1f."), name)).alias("key"), plates.class_characters(name).alias("class_chars"),
    )


def best_candidate(spark, sf_dir):
    """Of each order's lines the best by (returned, discount, -quantity gap, tax); the first line wins ties, and whether a second pass is due."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("ok"), "l_discount", F.abs(F.col("l_quantity") - 25).alias("gap"), "l_tax")
    best = evaluation.best_of(rows, "l_orderkey", [F.desc("ok"), F.desc("l_discount"), F.col("gap"), F.desc("l_tax"), F.col("l_linenumber")])
    weak = (F.col("gap") > 15) | (~F.col("ok") & (F.col("l_discount") < 0.05))
    return best.select("l_orderkey", "l_linenumber", "ok", "l_discount", F.col("gap").cast("double").alias("gap"), weak.alias("second_pass"))


def best_box(spark, sf_dir):
    """The most confident line of each order above the threshold; a stable order keeps the first of equals."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").cast("double").alias("conf")).filter("conf > 0.02")
    pick = F.max(F.struct("conf", -F.col("l_linenumber"))).alias("b")
    return rows.groupBy("l_orderkey").agg(pick, F.count("*").alias("n")).select("l_orderkey", "b.conf", (-F.col("b.col2")).alias("l_linenumber"), "n")


def group_median_filter(spark, sf_dir):
    """Lines whose quantity is within half and one and a half times the median of their order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    rows = rows.withColumn("median", F.percentile("q", 0.5).over(W.partitionBy("l_orderkey")))  # one shuffle
    return rows.filter("q between 0.5 * median and 1.5 * median").select("l_orderkey", "l_linenumber", "q", "median")


def reading_order(spark, sf_dir):
    """An order's lines in reading order: upper row (small quantity) left to right by price, then the lower one."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").cast("double").alias("y"), F.col("l_extendedprice").cast("double").alias("x"), F.col("l_linenumber").cast("int").alias("ch"))).alias("items"))
    split = (F.array_min("items.y") + F.array_max("items.y")) / 2
    ordered = F.array_sort(F.transform("items", lambda i: F.struct((i.y >= F.col("split")).alias("row"), i.x.alias("x"), i.ch.alias("ch"))))
    counts = geometry.line_counts(F.col("items.y"))
    return rows.withColumn("split", split).select("l_orderkey", F.concat_ws("", F.transform(ordered, lambda i: i.ch.cast("string"))).alias("text"), counts["top"].alias("top"), counts["bottom"].alias("bottom"))


def line_boxes(spark, sf_dir):
    """Each order's lines as character boxes in a line of 32 by 160 pixels."""
    q = F.col("l_quantity").cast("int")
    box = F.struct(((F.col("l_linenumber") - 1) * 24).cast("int").alias("x"), (3 + q % 19).alias("w"), (6 + q % 27).alias("h"), (q % 40 + 5).alias("area"), F.col("l_linenumber").cast("int").alias("n"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", box.alias("box"))


def line_scores(spark, sf_dir):
    """How much each order's boxes look like a line of three to five characters."""
    lines = line_boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("box")).alias("boxes"))
    median = lambda side: F.greatest(F.lit(1.0), geometry.middle(F.col(f"boxes.{side}").cast("array<double>"))).alias(side)
    lines = lines.select("l_orderkey", "boxes", median("h"), median("w"))
    return lines.select("l_orderkey", F.round(geometry.line_score(F.col("boxes"), F.col("h"), F.col("w"), F.lit(32), F.lit(160), 3, 5), 6).alias("score"), F.size("boxes").alias("n"))


def component_filters(spark, sf_dir):
    """Boxes by whether they are shaped like characters, and whether they are pieces of the frame."""
    rows, box = line_boxes(spark, sf_dir), F.col("box")
    return rows.select("l_orderkey", "box.n", geometry.character_shaped(box, F.lit(32), F.lit(160), 0.03, 0.12, 0.4).alias("character"), geometry.edge_artefact(box, F.lit(32), F.lit(160)).alias("artefact"))


def crop_decisions(spark, sf_dir):
    """Which readings, told from order lines, end the search and which need another crop."""
    q = F.col("l_quantity").cast("int")
    text = F.concat(F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"), F.when(q % 3 == 0, "A").otherwise("?"), F.col("l_suppkey").cast("string"), F.col("l_orderkey").cast("string"))
    angle = F.when(q % 7 != 0, F.col("l_linenumber") * 7.0 - 25)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"), angle.alias("angle"), (q / 2.0).alias("score"))
    valid = plates.is_valid(F.col("text"))
    return rows.select("l_orderkey", "l_linenumber", plates.done_early(valid, F.col("score")).alias("done"), plates.needs_fallback(valid, F.col("score"), F.length("text"), F.col("angle")).alias("again"))


def served_models(spark, sf_dir):
    """Nations as services: every third has no production version, every second a local model."""
    rows = table(spark, sf_dir, "nation")
    aliases = rows.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("name"), F.lit("production").alias("alias"), (F.col("n_nationkey") * 2 + 1).alias("version"))
    services = rows.select(F.col("n_nationkey").alias("service"), F.col("n_name").alias("name"), F.lit("production").alias("alias"), (F.col("n_nationkey") % 2 == 0).alias("has_local"))
    return learning.served_models(services, aliases)


def trimmed_lines(spark, sf_dir):
    """Each order's boxes in a line that ends at the last one, without narrow pieces at its ends, three at least."""
    lines = line_boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("box")).alias("boxes"))
    kept = geometry.trimmed(F.col("boxes"), F.size("boxes") * 24 - 12, 3)
    return lines.select("l_orderkey", F.concat_ws("", F.transform(kept["n"], lambda i: i.cast("string"))).alias("kept"))


def _listed(boxes):
    return F.concat_ws(",", F.transform(boxes, lambda b: F.concat_ws(":", *[b[n].cast("string") for n in "xywh"])))


def stroke_merges(spark, sf_dir):
    """Each order's lines as strokes in a line of 40 by 100 pixels, those of one character merged."""
    q = F.col("l_quantity").cast("int")
    box = F.struct(((F.col("l_linenumber") - 1) * 12).cast("int").alias("x"), (F.col("l_partkey") % 18).cast("int").alias("y"), (3 + q % 19).alias("w"), (6 + q % 27).alias("h"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return rows.select("l_orderkey", _listed(lines.merged_strokes(F.col("boxes"), F.lit(40), F.lit(100))).alias("merged"))


def drawn_ink(spark, sf_dir):
    """Each order as a line of 28 by 56 pixels: a slot of eight columns for each of its lines, with one run of ink in most columns."""
    slot, q = F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int")
    # Plain expressions over one amount a slot: compiled, where lambdas that look each column's amount up are interpreted.
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.max(F.when(slot == i, q)).alias(f"q{i}") for i in range(1, 8)])
    none = F.array().cast("array<struct<a:int,b:int>>")

    def column(c: int):
        q = F.col(f"q{c // 8 + 1}")
        run = F.struct((q % 10).alias("a"), (q % 10 + 1 + (q + c) % 17).alias("b"))
        return F.when(q.isNotNull() & ((q + 3 * (c % 8)) % 5 != 0), F.array(run)).otherwise(none)

    return rows.select("l_orderkey", F.array(*[column(c) for c in range(56)]).alias("ink"))


def projected_lines(spark, sf_dir):
    """Boxes of the runs of ink in each order's line."""
    boxes = lines.projected(F.col("ink"), F.lit(28), F.lit(56), 0.03, 0.3, 0.28)
    return drawn_ink(spark, sf_dir).select("l_orderkey", _listed(boxes).alias("boxes"))


def split_lines(spark, sf_dir):
    """Boxes of two slots each in an order's line, cut at their valleys until there are four."""
    rows = drawn_ink(spark, sf_dir)
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(40), F.lit(16)), lambda x: lines.tight(F.col("ink"), x, x + 16, F.lit(0), F.lit(28))), lambda b: b.isNotNull())
    rows = rows.withColumn("pairs", pairs)
    usual = F.when(F.size("pairs") > 0, geometry.middle(F.col("pairs.w").cast("array<double>")) / 2).otherwise(0.0)
    rows = rows.withColumn("usual", usual)
    cut = lines.split_budget(F.col("pairs"), F.lit(4), lambda b: lines.halves(F.col("ink"), b, F.col("usual"), F.lit(28), F.lit(56)))
    return rows.select("l_orderkey", _listed(cut).alias("boxes"))


def sample_labels(spark, sf_dir):
    """Classes of sample files whose folders and names are told from parts."""
    key = F.col("p_partkey")
    folder = F.when(key % 3 == 0, F.substring(F.lit(LETTERS), (key % 20 + 1).cast("int"), F.lit(1))).when(key % 3 == 1, "I").otherwise("mixed")
    path = F.concat(F.lit("/data/"), folder, F.lit("/"), F.substring(F.lit("qKo7-z"), (key % 6 + 1).cast("int"), F.lit(1)), key.cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "part").select("p_partkey", plates.sample_label(path).alias("label"))


def recovered_settings(spark, sf_dir):
    """Cell sizes from model descriptions of several spellings."""
    size = (F.col("p_partkey") % 9 + 2).cast("string")
    text = F.element_at(F.array(
        F.concat(F.lit('{"hog":{"pixels_per_cell":['), size, F.lit(",6]}}")), F.concat(F.lit('{"feature":{"cell_size":'), size, F.lit("}}")), F.concat(F.lit('{"features":{"cell":'), size, F.lit("},\"hog\":{}}")),
        F.lit('{"hog":{"cell":"wide"}}'), F.lit("not json"), F.lit('{"hog":{"cell":[1,2,3]}}'),
    ), (F.col("p_partkey") % 6 + 1).cast("int"))
    pair = plates.recovered_pair(text, ["hog", "feature", "features"], ["pixels_per_cell", "cell_size", "cell"], 8)
    return table(spark, sf_dir, "part").select("p_partkey", pair[0].alias("across"), pair[1].alias("down"))


def binary_scores(spark, sf_dir):
    """Each order's boxes as the components of a binarised plate of 32 by 40 pixels, by how much they look like its characters."""
    rows = line_boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("box").alias("parts"))
    fill = (F.col("l_orderkey") % 50).cast("double") / 100
    return rows.select("l_orderkey", F.round(geometry.binary_score(F.col("parts"), F.lit(32), F.lit(40), fill), 6).alias("score"))


def segmentation_scores(spark, sf_dir):
    """The boxes of two orders as the characters found in a binarisation, every second one of a plate of two lines."""
    q, line = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")
    box = F.struct((F.when(line % 3 == 0, 0).otherwise(30) + q % 5).alias("y"), (3 + q % 19).alias("w"), (6 + q % 27).alias("h"))
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") / 2).cast("long").alias("plate")).agg(F.collect_list(box).alias("boxes"))
    score = geometry.segmentation_score(F.col("boxes"), F.col("plate") % 2 == 0, (F.col("plate") % 60).cast("double") / 100, (F.col("plate") % 41).cast("double"))
    return rows.select("plate", F.round(score, 6).alias("score"))


def supplier_scenes(spark, sf_dir):
    """Suppliers as plates in scenes: s_suppkey, label, image; every third has two lines."""
    key, letters = F.col("s_suppkey"), "ABCDEFGHKLMNPRSTUVXYZ"
    head = F.concat((11 + key * 7 % 89).cast("string"), F.substring(F.lit(letters), (key % 21 + 1).cast("int"), F.lit(1)))
    series, tail = F.when(key % 3 == 2, (key % 9 + 1).cast("string")).otherwise(""), F.lpad((key * 7919 % 100000).cast("string"), 5, "0")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(head, series, tail).alias("label"), F.when(key % 3 == 2, F.array(F.concat(head, series), tail)).otherwise(F.array(F.concat(head, tail))).alias("lines"))
    # Drawing costs more than its few bytes tell: spread over all cores, and as finely as other work.
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "s_suppkey")
    return rows.select("s_suppkey", "label"), scenes.drawn_scenes(rows, "s_suppkey", "lines")


def scene_texts(spark, sf_dir):
    """The plate found and read in each supplier's scene, beside its label: detection, levelling, both passes and the grammar in one plan."""
    labels, drawn = supplier_scenes(spark, sf_dir)
    read = scenes.read_scenes(drawn, scenes.drawn_reader(spark, "wavelet"), "wavelet", "s_suppkey")
    box = [F.col("box")[s].alias(f"box_{s}") for s in "xywh"]
    return labels.join(read, "s_suppkey").select("s_suppkey", "label", "text", "score", "valid", "plate_type", "angle", "flipped", "success", *box)


QUERIES = {
    f.__name__: f
    for f in (plate_correct, plate_format_score, ocr_eval, eval_detail, eval_by_group, confusion_counts, confusion_table, class_report, macro_scores, fairness_groups, pair_confusion, class_equity, text_helpers, best_candidate, best_box, group_median_filter, reading_order, line_scores, component_filters, crop_decisions, served_models, trimmed_lines, stroke_merges, projected_lines, split_lines, sample_labels, recovered_settings, binary_scores, segmentation_scores)
}
#: Queries on pixels, which SQL can't express; tests hold them against what was drawn.
PIXEL_QUERIES = {"scene_texts": scene_texts}

_DIGITS = "length(regexp_replace({0}, '[^0-9]', '', 'g'))"
_LETTERS = "length(regexp_replace({0}, '[^A-Z]', '', 'g'))"
ORACLES = {
    "plate_correct": CORRECTED_SQL + " SELECT o_orderkey, raw, fixed AS corrected, regexp_matches(fixed, '^[0-9]{2}[A-Z][0-9]{4,6}$') OR regexp_matches(fixed, '^[0-9]{2}[A-Z][A-Z0-9]?[0-9]{3,5}$') AS valid FROM corrected",
    "plate_format_score": CORRECTED_SQL + f""", s AS (SELECT o_orderkey, two_line, t, t[:4] AS top, t[5:] AS low, t[4:] AS tail FROM corrected)
SELECT o_orderkey, round(CASE WHEN length(t) BETWEEN 7 AND 9 THEN 3.0 WHEN length(t) < 7 THEN -3.0 ELSE -2.0 END + CASE WHEN two_line THEN
  (length(top) BETWEEN 3 AND 4)::INT + (length(low) >= length(top))::INT + 3 * regexp_matches(top, '^[0-9][0-9]')::INT + 2 * ({_LETTERS.format('top')} > 0)::INT
  + 4 * regexp_matches(low, '^[0-9]{{4,6}}$')::INT + CASE WHEN low <> '' THEN 2.0 * {_DIGITS.format('low')} / length(low) ELSE 0 END - 1.5 * {_LETTERS.format('low')}
  ELSE 5 * regexp_matches(t, '^[0-9]{{2}}[A-Z]')::INT + CASE WHEN tail <> '' THEN 3.0 * {_DIGITS.format('tail')} / length(tail) ELSE 0 END END, 6)::DOUBLE AS score FROM s""",
    "ocr_eval": MODELS_SQL + """ SELECT model, count(*) AS n, count_if(correct)::BIGINT AS exact, round(count_if(correct) / count(*), 9) AS exact_rate, round(1 - sum(d) / sum(m), 9) AS char_accuracy,
  count_if(correct) / count(*) >= 0.5 AND 1 - sum(d) / sum(m) >= 0.85 AS passed FROM scored GROUP BY model""",
    "eval_detail": MODELS_SQL + " SELECT model, o_orderkey, label, prediction, correct, d::INT AS edit_distance, round(1 - d / m, 9) AS char_accuracy FROM scored",
    "eval_by_group": MODELS_SQL + """, g AS (SELECT model, o_orderpriority, two_line, count(*) AS n, count_if(correct)::BIGINT AS exact, count_if(correct) / count(*) AS p, 1 - sum(d) / sum(m) AS ca FROM scored GROUP BY ALL)
SELECT model, o_orderpriority, two_line, n, exact, round(p, 9) AS exact_rate, round(ca, 9) AS char_accuracy,
  round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS high FROM g""",
    "confusion_counts": PAIRS_SQL + " SELECT * FROM counts",
    "confusion_table": PAIRS_SQL + " SELECT truth, " + ", ".join(f"count_if(guess = '{c}')::BIGINT AS p_{c}" for c in "0123456789BSOI") + " FROM pairs GROUP BY truth",
    "class_report": REPORT_SQL + " SELECT class, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM full_report",
    "macro_scores": REPORT_SQL + """ SELECT sum(support)::BIGINT AS support, round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1,
  round(sum(precision * support) / sum(support), 9) AS weighted_precision, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, round(sum(recall * support) / sum(support), 9) AS accuracy FROM full_report""",
    "fairness_groups": PAIRS_SQL + """, a AS (SELECT count_if(regexp_matches(truth, '[0-9]'))::BIGINT AS n_digits, count_if(NOT regexp_matches(truth, '[0-9]'))::BIGINT AS n_letters,
  avg((truth = guess)::INT) FILTER (regexp_matches(truth, '[0-9]')) AS digits, avg((truth = guess)::INT) FILTER (NOT regexp_matches(truth, '[0-9]')) AS letters FROM pairs)
SELECT n_digits, n_letters, abs(digits - letters) < 0.1 AS fair, round(digits, 9) AS digits, round(letters, 9) AS letters, round(abs(digits - letters), 9) AS disparity FROM a""",
    "pair_confusion": PAIRS_SQL + """, alike AS (SELECT x[1] AS truth, x[2] AS guess FROM (SELECT unnest([['8','B'],['B','8'],['0','O'],['O','0'],['1','I'],['I','1'],['5','S'],['S','5'],['6','G'],['G','6'],['4','A'],['A','4']]) AS x)),
totals AS (SELECT truth, sum(n) AS total FROM counts GROUP BY 1)
SELECT s.truth, s.guess, round_even(coalesce(n, 0) / total, 4) AS rate, coalesce(n, 0)::BIGINT AS n, total::BIGINT AS total FROM alike s JOIN totals USING (truth) LEFT JOIN counts c ON c.truth = s.truth AND c.guess = s.guess""",
    "class_equity": PAIRS_SQL + """, a AS (SELECT truth, avg((truth = guess)::INT) AS acc, count(*) AS n FROM pairs GROUP BY 1), o AS (SELECT avg(acc) AS m, stddev_pop(acc) AS s, max(acc) - min(acc) AS g FROM a)
SELECT truth, n, acc < m - 2 * s AS lags, round(acc, 9) AS accuracy, round(m, 9) AS mean_accuracy, round(s, 9) AS std_accuracy, round(g, 9) AS equity_gap FROM a, o""",
    "text_helpers": f"""WITH p AS (SELECT *, 'data/images/' || translate(p_name, ' ', '/') || '/images2/' || p_partkey || '.v1.jpg' AS path,
  CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE translate(p_name, ' ', '_') || '=m/' || p_partkey || '=x' END AS spec,
  [' HOG-324', 'Hog', 'haar2', 'pixels', 'ResNet18', '', 'Other '][p_partkey % 7 + 1] AS method, ['Yes', ' crop', 'no', ' ', '1'][p_partkey % 5 + 1] AS word FROM part)
SELECT p_partkey, regexp_replace(p_name || ' #1/', '[^A-Za-z0-9_.-]+', '_', 'g') AS stem,
  regexp_replace(array_to_string(list_transform(string_split(path, '/'), lambda x: CASE WHEN x = 'images' THEN 'labels' ELSE x END), '/'), '\\.[^./]+$', '.txt') AS label_path,
  CASE WHEN contains(spec, '=') THEN spec[:instr(spec, '=') - 1] ELSE spec END AS model, CASE WHEN contains(spec, '=') THEN spec[instr(spec, '=') + 1:] ELSE spec END AS path,
  CASE WHEN method = '' THEN 'resnet' WHEN contains(lower(method), 'legacy') OR contains(lower(method), '8x8') OR contains(lower(method), '324') THEN 'hog_legacy' WHEN contains(lower(method), 'hog') THEN 'hog'
    WHEN contains(lower(method), 'wavelet') OR contains(lower(method), 'haar') THEN 'wavelet' WHEN contains(lower(method), 'raw') OR contains(lower(method), 'pixel') THEN 'raw' WHEN contains(lower(method), 'resnet') THEN 'resnet' ELSE lower(trim(method)) END AS method,
  CASE WHEN trim(word) = '' THEN TRUE ELSE lower(trim(word)) IN ('1', 'true', 'yes', 'y', 'plate', 'crop') END AS flag,
  upper(translate('5-1f.' || p_name, '-.', '')) AS key, regexp_replace(upper(p_name), '[^0-9A-HK-NPR-VX-Z]', '', 'g') AS class_chars FROM p""",
    "best_candidate": """SELECT l_orderkey, l_linenumber, ok, l_discount, gap, gap > 15 OR (NOT ok AND l_discount < 0.05) AS second_pass FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ok DESC, l_discount DESC, gap, l_tax DESC, l_linenumber) AS nth FROM (
    SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS ok, l_discount, abs(l_quantity - 25)::DOUBLE AS gap, l_tax FROM lineitem)) WHERE nth = 1""",
    "best_box": """SELECT l_orderkey, conf, l_linenumber, n FROM (SELECT l_orderkey, l_tax::DOUBLE AS conf, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax DESC, l_linenumber) AS nth,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_tax::DOUBLE > 0.02) WHERE nth = 1""",
    "group_median_filter": """SELECT l_orderkey, l_linenumber, q, median FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS q, quantile_cont(l_quantity::DOUBLE, 0.5) OVER (PARTITION BY l_orderkey) AS median FROM lineitem)
WHERE q BETWEEN 0.5 * median AND 1.5 * median""",
    "reading_order": """WITH s AS (SELECT l_orderkey, (min(l_quantity::DOUBLE) + max(l_quantity::DOUBLE)) / 2 AS split FROM lineitem GROUP BY 1)
SELECT l_orderkey, string_agg(l_linenumber::INT::VARCHAR, '' ORDER BY l_quantity::DOUBLE >= split, l_extendedprice::DOUBLE, l_linenumber) AS text, count_if(l_quantity::DOUBLE < split)::INT AS top, count_if(l_quantity::DOUBLE >= split)::INT AS bottom
FROM lineitem JOIN s USING (l_orderkey) GROUP BY l_orderkey""",
    "line_scores": """WITH b AS (SELECT l_orderkey, (l_linenumber - 1) * 24 AS x, 3 + l_quantity::INT % 19 AS w, 6 + l_quantity::INT % 27 AS h FROM lineitem),
m AS (SELECT l_orderkey, count(*) AS n, greatest(1.0, median(h)) AS tall, greatest(1.0, median(w)) AS wide, stddev_pop(w) AS sw, stddev_pop(h) AS sh FROM b GROUP BY 1),
f AS (SELECT l_orderkey, sum(CASE WHEN w * h < 32 * 160 * 0.006 THEN 3 ELSE 0 END + CASE WHEN (x <= 1 OR x + w >= 159) AND w < 160 * 0.07 THEN 4 ELSE 0 END + CASE WHEN h < tall * 0.45 THEN 4 ELSE 0 END) AS faults FROM b JOIN m USING (l_orderkey) GROUP BY 1)
SELECT l_orderkey, round((CASE WHEN n BETWEEN 3 AND 5 THEN 35.0 - abs(4.0 - n) ELSE 20.0 - least(abs(n - 3), abs(n - 5)) * 7.0 END + CASE WHEN tall BETWEEN 32 * 0.35 AND 32 * 0.92 THEN 8 ELSE -8 END
  - least(8.0, sw / wide * 3.0) - least(8.0, sh / tall * 3.0) - faults)::DOUBLE, 6) AS score, n::INT AS n FROM m JOIN f USING (l_orderkey)""",
    "component_filters": """WITH b AS (SELECT l_orderkey, l_linenumber::INT AS n, (l_linenumber - 1) * 24 AS x, 3 + l_quantity::INT % 19 AS w, 6 + l_quantity::INT % 27 AS h, l_quantity::INT % 40 + 5 AS area FROM lineitem)
SELECT l_orderkey, n, w >= 160 * 0.03::DOUBLE AND w <= 160 * 0.12::DOUBLE AND h >= 32 * 0.4::DOUBLE AND area >= 30 AS character,
  (x <= 1 OR x + w >= 159) AND ((h > 32 * 0.72::DOUBLE AND w < 160 * 0.08::DOUBLE) OR w / greatest(1.0, h)::DOUBLE < 0.13::DOUBLE) AS artefact FROM b""",
    "crop_decisions": """WITH r AS (SELECT l_orderkey, l_linenumber, lpad((l_partkey % 100)::VARCHAR, 2, '0') || CASE WHEN l_quantity::INT % 3 = 0 THEN 'A' ELSE '?' END || l_suppkey || l_orderkey AS t,
  CASE WHEN l_quantity::INT % 7 <> 0 THEN l_linenumber * 7.0 - 25 ELSE 0 END AS angle, l_quantity::INT / 2 AS score FROM lineitem),
v AS (SELECT *, regexp_matches(t, '^[0-9]{2}[A-Z][0-9]{4,6}$') OR regexp_matches(t, '^[0-9]{2}[A-Z][A-Z0-9]?[0-9]{3,5}$') AS valid FROM r)
SELECT l_orderkey, l_linenumber, valid AND score >= 12 AS done, abs(angle) > 15 OR length(t) < 7 OR (NOT valid AND score < 10) AS again FROM v""",
    "served_models": """SELECT n_nationkey AS service, CASE WHEN n_nationkey % 3 <> 0 THEN 'registry' WHEN n_nationkey % 2 = 0 THEN 'local' ELSE 'none' END AS source, CASE WHEN n_nationkey % 3 <> 0 THEN (n_nationkey * 2 + 1)::VARCHAR END AS version FROM nation""",
    "trimmed_lines": """WITH b AS (SELECT l_orderkey, l_linenumber::INT AS n, (l_linenumber - 1) * 24 AS x, 3 + l_quantity::INT % 19 AS w, 6 + l_quantity::INT % 27 AS h, l_quantity::INT % 40 AS area FROM lineitem),
m AS (SELECT l_orderkey, count(*) AS c, median(w) * 0.65::DOUBLE AS narrow, count(*) * 24 - 12 AS width FROM b GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY x, w, h, area) AS r FROM b JOIN m USING (l_orderkey)),
f AS (SELECT *, bool_and(x <= width * 0.03::DOUBLE AND w < narrow) OVER (PARTITION BY l_orderkey ORDER BY r) AS lead, bool_and(x + w >= width * 0.97::DOUBLE AND w < narrow) OVER (PARTITION BY l_orderkey ORDER BY r DESC) AS trail FROM o),
g AS (SELECT l_orderkey, least(count_if(lead), greatest(any_value(c) - 3, 0)) AS front, count_if(trail) AS back FROM f GROUP BY 1)
SELECT l_orderkey, string_agg(n, '' ORDER BY r) AS kept FROM f JOIN g USING (l_orderkey) WHERE r > front AND r <= c - least(back, greatest(c - front - 3, 0)) GROUP BY 1""",
    "stroke_merges": """WITH RECURSIVE b AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 18, l_quantity::INT % 19, l_quantity::INT % 27) AS r, CAST((l_linenumber - 1) * 12 AS INTEGER) AS x1, CAST(l_partkey % 18 AS INTEGER) AS y1,
         CAST((l_linenumber - 1) * 12 + 3 + l_quantity::INT % 19 AS INTEGER) AS x2, CAST(l_partkey % 18 + 6 + l_quantity::INT % 27 AS INTEGER) AS y2 FROM lineitem),
m AS (SELECT l_orderkey, r, 1 AS g, x1, y1, x2, y2 FROM b WHERE r = 1
  UNION ALL
  SELECT l_orderkey, r, g + CASE WHEN same THEN 0 ELSE 1 END, CASE WHEN same THEN least(px1, x1) ELSE x1 END, CASE WHEN same THEN least(py1, y1) ELSE y1 END, CASE WHEN same THEN greatest(px2, x2) ELSE x2 END, CASE WHEN same THEN greatest(py2, y2) ELSE y2 END
  FROM (SELECT b.l_orderkey, b.r, m.g, b.x1, b.y1, b.x2, b.y2, m.x1 AS px1, m.y1 AS py1, m.x2 AS px2, m.y2 AS py2,
          (least(m.x2, b.x2) > greatest(m.x1, b.x1) AND least(m.y2, b.y2) - greatest(m.y1, b.y1) > -3.2) OR (b.x1 - m.x2 <= 2 AND least(m.y2, b.y2) - greatest(m.y1, b.y1) > 4.8) AS same
        FROM m JOIN b ON b.l_orderkey = m.l_orderkey AND b.r = m.r + 1) s),
f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, g ORDER BY r DESC) AS last FROM m)
SELECT l_orderkey, coalesce(string_agg(CASE WHEN x2 - x1 >= 1.8 AND y2 - y1 >= 10 THEN x1 || ':' || y1 || ':' || (x2 - x1) || ':' || (y2 - y1) END, ',' ORDER BY g), '') AS merged FROM f WHERE last = 1 GROUP BY l_orderkey""",
    "projected_lines": """WITH i AS (SELECT l_orderkey, l_linenumber, max(l_quantity::INT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
c AS (
  SELECT l_orderkey, (l_linenumber - 1) * 8 + k AS x, q % 10 AS a, q % 10 + 1 + (q + (l_linenumber - 1) * 8 + k) % 17 AS b
  FROM i, range(8) t(k) WHERE (q + 3 * k) % 5 <> 0),
g AS (SELECT *, x - row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS island FROM c WHERE b - a > 1.4),
f AS (SELECT l_orderkey, min(x) AS x, min(a) AS y, count(*) AS w, max(b) - min(a) AS h FROM g GROUP BY l_orderkey, island),
o AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT o.l_orderkey, coalesce(string_agg(x || ':' || y || ':' || w || ':' || h, ',' ORDER BY x), '') AS boxes
FROM o LEFT JOIN f ON o.l_orderkey = f.l_orderkey AND w BETWEEN 56 * 0.03 AND 56 * 0.3 AND h >= 28 * 0.28 GROUP BY o.l_orderkey""",
    "split_lines": """WITH i AS (SELECT l_orderkey, l_linenumber, max(l_quantity::INT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
k AS (
  SELECT l_orderkey, (l_linenumber - 1) // 2 AS p, (l_linenumber - 1) * 8 + k AS x, q % 10 AS a, q % 10 + 1 + (q + (l_linenumber - 1) * 8 + k) % 17 AS b
  FROM i, range(8) t(k) WHERE (q + 3 * k) % 5 <> 0 AND l_linenumber <= 6),
o AS (SELECT l_orderkey, p, min(x) AS x, min(a) AS y, max(x) - min(x) + 1 AS w, max(b) - min(a) AS h FROM k GROUP BY l_orderkey, p),
u AS (SELECT l_orderkey, median(w)::DOUBLE / 2 AS usual, count(*) AS n FROM o GROUP BY l_orderkey),
cells AS (SELECT o.l_orderkey, o.p, t.j, coalesce(k.b - k.a, 0) AS n FROM o JOIN range(16) t(j) ON t.j < o.w LEFT JOIN k ON k.l_orderkey = o.l_orderkey AND k.p = o.p AND k.x = o.x + t.j),
smooth AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey, p ORDER BY j ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM cells),
least AS (
  SELECT o.l_orderkey, o.p, CAST(min(s * 100 + j) AS INTEGER) % 100 AS pos FROM o JOIN smooth m ON m.l_orderkey = o.l_orderkey AND m.p = o.p
  WHERE o.w >= 8 AND j >= greatest(2, floor(o.w * 0.3::DOUBLE)) AND j < least(o.w - 2, floor(o.w * 0.7::DOUBLE)) GROUP BY o.l_orderkey, o.p),
valley AS (
  SELECT l.l_orderkey, l.p, any_value(pos) AS pos, max(CASE WHEN j = pos THEN s END) / greatest(5.0, least(max(CASE WHEN j < pos THEN s END), coalesce(max(CASE WHEN j > pos THEN s END), 0)))::DOUBLE AS depth
  FROM least l JOIN smooth m ON m.l_orderkey = l.l_orderkey AND m.p = l.p GROUP BY l.l_orderkey, l.p),
wide AS (
  SELECT o.*, pos FROM o JOIN u ON u.l_orderkey = o.l_orderkey JOIN valley v ON v.l_orderkey = o.l_orderkey AND v.p = o.p
  WHERE w >= greatest(usual * 1.45::DOUBLE, 56 * 0.09::DOUBLE) AND w / greatest(1, h)::DOUBLE >= 0.62::DOUBLE AND h >= 28 * 0.28::DOUBLE AND (depth <= 0.82::DOUBLE OR w >= usual * 1.85::DOUBLE)),
half AS (
  SELECT g.l_orderkey, g.p, CAST(k.x > g.x + g.pos AS INTEGER) AS side, min(k.x) AS x, min(k.a) AS y, max(k.x) - min(k.x) + 1 AS w, max(k.b) - min(k.a) AS h
  FROM wide g JOIN k ON k.l_orderkey = g.l_orderkey AND k.p = g.p GROUP BY g.l_orderkey, g.p, CAST(k.x > g.x + g.pos AS INTEGER)),
good AS (SELECT l_orderkey, p FROM half WHERE w > 1 AND h > 1 AND h >= 28 * 0.18::DOUBLE GROUP BY l_orderkey, p HAVING count(*) = 2),
cut AS (
  SELECT l_orderkey, p FROM (SELECT g.l_orderkey, g.p, n, row_number() OVER (PARTITION BY g.l_orderkey ORDER BY g.p) AS nth FROM good g JOIN u ON u.l_orderkey = g.l_orderkey) r
  WHERE n >= 2 AND nth <= 4 - n),
found AS (
  SELECT o.l_orderkey, o.x, o.y, o.w, o.h FROM o LEFT JOIN cut c ON c.l_orderkey = o.l_orderkey AND c.p = o.p WHERE c.p IS NULL
  UNION ALL
  SELECT f.l_orderkey, f.x, f.y, f.w, f.h FROM half f JOIN cut c ON c.l_orderkey = f.l_orderkey AND c.p = f.p)
SELECT a.l_orderkey, coalesce(string_agg(x || ':' || y || ':' || w || ':' || h, ',' ORDER BY x), '') AS boxes
FROM (SELECT DISTINCT l_orderkey FROM lineitem) a LEFT JOIN found f ON f.l_orderkey = a.l_orderkey GROUP BY a.l_orderkey""",
    "binary_scores": """WITH b AS (SELECT l_orderkey, (l_linenumber - 1) * 24 AS x, 3 + l_quantity::INT % 19 AS w, 6 + l_quantity::INT % 27 AS h, l_quantity::INT % 40 + 5 AS area FROM lineitem),
k AS (SELECT *, area > 230.4 OR (w > 20 AND h > 11.2) AS huge, area >= 12 AND h BETWEEN 3.2 AND 26.24 AND w BETWEEN 0.32 AND 12 AND w / h::DOUBLE <= 1.9::DOUBLE AS sized FROM b),
s AS (
  SELECT l_orderkey, count(*) FILTER (huge) AS huge, count(*) FILTER (sized AND NOT huge) AS n, (l_orderkey % 50)::DOUBLE / 100 AS fill,
    coalesce(sum(least(1.4::DOUBLE, area / 32.0::DOUBLE) + least(0.4::DOUBLE, area / (w * h)::DOUBLE) - CASE WHEN x <= 1 OR x + w >= 39 THEN 0.8::DOUBLE ELSE 0 END) FILTER (sized AND NOT huge), 0) AS body
  FROM k GROUP BY l_orderkey)
SELECT l_orderkey, round(n * 3.0::DOUBLE + CASE WHEN n BETWEEN 6 AND 12 THEN 8 - abs(8 - least(n, 10)) WHEN n = 0 THEN -12 ELSE 0 END + body
  + CASE WHEN fill BETWEEN 0.035::DOUBLE AND 0.28::DOUBLE THEN 4 WHEN fill <= 0.4::DOUBLE THEN 1 ELSE (fill - 0.4::DOUBLE) * -10 END - huge * 8, 6) AS score FROM s""",
    "segmentation_scores": """WITH b AS (SELECT l_orderkey // 2 AS plate, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 30 END + l_quantity::INT % 5 AS y, 3 + l_quantity::INT % 19 AS w, 6 + l_quantity::INT % 27 AS h FROM lineitem),
m AS (SELECT *, y + h / 2.0::DOUBLE AS c, min(y + h / 2.0::DOUBLE) OVER p AS low, max(y + h / 2.0::DOUBLE) OVER p AS high FROM b WINDOW p AS (PARTITION BY plate)),
s AS (
  SELECT plate, count(*) AS n, count(*) FILTER (c < (low + high) / 2) AS top, count(*) FILTER (c >= (low + high) / 2) AS bottom, (plate % 60)::DOUBLE / 100 AS fill,
    least(8, stddev_pop(w) / greatest(1, median(w)::DOUBLE) * 4) + least(8, stddev_pop(h) / greatest(1, median(h)::DOUBLE) * 4) AS uneven
  FROM m GROUP BY plate)
SELECT plate, round((plate % 41)::DOUBLE * 0.2::DOUBLE + CASE WHEN n BETWEEN 7 AND 9 THEN 40 - abs(8 - n) * 2 WHEN n BETWEEN 5 AND 10 THEN 18 - abs(8 - n) * 3 WHEN n > 10 THEN 8 - (n - 10) * 3 ELSE (5 - n) * -7 END
  + CASE WHEN fill BETWEEN 0.035::DOUBLE AND 0.3::DOUBLE THEN 5::DOUBLE WHEN fill > 0.42::DOUBLE THEN -12 - (fill - 0.42::DOUBLE) * 25 ELSE 0 END
  - CASE WHEN n >= 4 THEN uneven ELSE 0 END
  + CASE WHEN plate % 2 = 0 THEN CASE WHEN top BETWEEN 2 AND 4 THEN 8 ELSE 0 END + CASE WHEN bottom BETWEEN 4 AND 6 THEN 8 ELSE 0 END + CASE WHEN bottom >= top THEN 3 ELSE 0 END ELSE 0 END, 6) AS score FROM s""",
    "sample_labels": """WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN substr('ABCDEFGHKLMNPRSTUVXYZ', (p_partkey % 20 + 1)::INT, 1) END AS folder, upper(substr('qKo7-z', (p_partkey % 6 + 1)::INT, 1)) AS first FROM part)
SELECT p_partkey, coalesce(folder, CASE WHEN first IN ('K', '7', 'Z') THEN first END) AS label FROM p""",
    "recovered_settings": """SELECT p_partkey, CASE WHEN p_partkey % 6 < 2 THEN p_partkey % 9 + 2 ELSE 8 END::INT AS across, CASE p_partkey % 6 WHEN 0 THEN 6 WHEN 1 THEN p_partkey % 9 + 2 ELSE 8 END::INT AS down FROM part""",
}
