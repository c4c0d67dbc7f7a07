"""Registered queries: metrics, thresholds, losses, label models, semi-automatic tagging."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb, lexicon as lx
from ..functions.vectors import sigmoid
from ..operators import learners, metrics, splits, thresholds, zero_shot
from . import inputs, sql
from .inputs import LABELS, POSTS, PREDICTIONS, predictions
from .registry import Registry
from .tagging import TAG_NAMES

registry = Registry()
query = registry.query

_COUNTS = "counts AS (SELECT i, label, count(*) FILTER (WHERE p = 1 AND truth = 1) AS tp, count(*) FILTER (WHERE p = 1 AND truth = 0) AS fp, count(*) FILTER (WHERE p = 0 AND truth = 1) AS fn, count(*) FILTER (WHERE truth = 1) AS support FROM said GROUP BY i, label)"


def _ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} > 0 THEN ({top})::DOUBLE / ({bottom}) ELSE 0.0::DOUBLE END"


F1_SQL = _ratio("2 * tp", "2 * tp + fp + fn")


def said_rows(rule: str) -> list[str]:
    return [*PREDICTIONS, f"said AS (SELECT *, ({rule})::INT AS p FROM long)", _COUNTS]


def _long(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return metrics.long_form(predictions(spark, sf), LABELS, *keep)


def counts_at(spark: SparkSession, sf: str, threshold: float, strict: bool = False) -> DataFrame:
    return metrics.label_counts(_long(spark, sf), metrics.decided(F.col("prob"), threshold, strict))


@query(
    "f1_scores",
    sql.with_ctes(
        said_rows("prob >= 0.6::DOUBLE"),
        f"SELECT round(avg({F1_SQL}), 6) AS macro_f1, round({_ratio('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')}, 6) AS micro_f1 FROM counts",
    ),
)
def f1_scores(spark: SparkSession, sf: str) -> DataFrame:
    both = metrics.f1_scores(counts_at(spark, sf, 0.6))
    return both.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("micro_f1", 6).alias("micro_f1"))


@query("per_label_f1", sql.with_ctes(said_rows("prob > 0.6::DOUBLE"), f"SELECT label, round({F1_SQL}, 6) AS f1, support FROM counts"))
def per_label_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.per_label_f1(counts_at(spark, sf, 0.6, strict=True)).withColumn("f1", F.round("f1", 6))


_STEPS = [
    "grouped AS (SELECT label, prob, sum(truth) AS pos, count(*) AS n FROM long GROUP BY ALL)",
    "steps AS (SELECT label, prob, pos, sum(pos) OVER w AS pos_above, sum(n) OVER w AS n_above, sum(pos) OVER (PARTITION BY label) AS support FROM grouped WINDOW w AS (PARTITION BY label ORDER BY prob DESC))",
]


@query(
    "average_precision",
    sql.with_ctes(
        [*PREDICTIONS, *_STEPS],
        "SELECT label, round(CASE WHEN sum(pos) > 0 THEN sum(pos * pos_above / n_above::DOUBLE) / sum(pos) ELSE 0.0::DOUBLE END, 6) AS average_precision FROM steps GROUP BY label",
    ),
)
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.average_precision(_long(spark, sf)).withColumn("average_precision", F.round("average_precision", 6))


_P, _R = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn")


@query(
    "classification_report",
    sql.with_ctes(
        [
            *said_rows("prob >= 0.6::DOUBLE"),
            f"rows_out AS (SELECT label AS name, {_P} AS precision, {_R} AS recall, {F1_SQL} AS f1, support FROM counts)",
            "per_row AS (SELECT row_id, sum(truth * p) AS b, sum(truth) AS t, sum(p) AS s FROM said GROUP BY row_id)",
            f"""report AS (SELECT * FROM rows_out
            UNION ALL SELECT 'micro avg', {_ratio('sum(tp)', 'sum(tp) + sum(fp)')}, {_ratio('sum(tp)', 'sum(tp) + sum(fn)')}, {_ratio('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')}, sum(support) FROM counts
            UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rows_out
            UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rows_out
            UNION ALL SELECT 'samples avg', avg({_ratio('b', 's')}), avg({_ratio('b', 't')}), avg({_ratio('2 * b', 't + s')}), sum(t) FROM per_row)""",
        ],
        "SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM report",
    ),
)
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    decided = F.transform("prob", lambda p: metrics.decided(p, 0.6))
    report = metrics.classification_report(predictions(spark, sf), LABELS, decided)
    return report.select("name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("bigint").alias("support"))


_SINGLE = [
    *PREDICTIONS,
    "firsts AS (SELECT row_id, any_value(own) AS own, arg_max(i, prob - i * 1e-9::DOUBLE) AS pred FROM long GROUP BY row_id)",
    f"grid AS (SELECT a.x AS t, b.x AS p FROM (SELECT unnest(range({len(LABELS)})) AS x) a, (SELECT unnest(range({len(LABELS)})) AS x) b)",
    "cells AS (SELECT t, p, count(row_id) AS n FROM grid LEFT JOIN firsts f ON f.own = t AND f.pred = p GROUP BY t, p)",
]


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    picked = predictions(spark, sf).select(F.col("label").cast("int").alias("t"), metrics.argmax(F.col("prob")).alias("p"))
    return metrics.confusion(picked, "t", "p", list(range(len(LABELS))), "int")


@query("confusion_matrix", sql.with_ctes(_SINGLE, "SELECT t::INT AS true, p::INT AS pred, n FROM cells"))
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf)


@query(
    "confusion_pivot",
    sql.with_ctes(_SINGLE, "SELECT t::INT AS true, " + ", ".join(f"sum(n) FILTER (WHERE p = {i})::BIGINT AS \"{i}\"" for i in range(len(LABELS))) + " FROM cells GROUP BY t"),
)
def confusion_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(_cells(spark, sf), list(range(len(LABELS))))


@query(
    "accuracy_report",
    sql.with_ctes(
        [
            *_SINGLE,
            """classes AS (SELECT l.x, sum(n) FILTER (WHERE t = l.x AND p = l.x) AS tp, sum(n) FILTER (WHERE t <> l.x AND p = l.x) AS fp, sum(n) FILTER (WHERE t = l.x AND p <> l.x) AS fn
            FROM cells, (SELECT unnest(range(10)) AS x) l GROUP BY l.x)""",
        ],
        f"SELECT round(sum(tp) / sum(tp + fn)::DOUBLE, 6) AS accuracy, round(avg({F1_SQL}), 6) AS macro_f1 FROM classes WHERE tp + fp + fn > 0",
    ),
)
def accuracy_report(spark: SparkSession, sf: str) -> DataFrame:
    report = metrics.accuracy_report(_cells(spark, sf))
    return report.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


# --- losses -------------------------------------------------------------------

_LS = "(-(ln(1.0::DOUBLE + exp(-abs({x}))) + greatest(-({x}), 0.0::DOUBLE)))"
_BCE = f"(-(w * truth * {_LS.format(x='logit')} + (1 - truth) * {_LS.format(x='-logit')}))"


@query(
    "loss_columns",
    sql.with_ctes(
        [
            *PREDICTIONS,
            "logits AS (SELECT row_id, own, i, label, truth, round(8.0::DOUBLE * (prob - 0.5::DOUBLE), 6) AS logit, 1.0::DOUBLE + i / 10.0::DOUBLE AS w FROM long)",
            f"losses AS (SELECT label, {_BCE} AS bce, power(1.0::DOUBLE - CASE WHEN truth > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) ELSE 1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) END, 2.0::DOUBLE) * {_BCE} AS focal, 1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) AS s FROM logits)",
        ],
        "SELECT label, round(avg(bce), 6) AS bce_mean, round(sum(bce), 4) AS bce_sum, round(avg(focal), 6) AS focal_mean, round(sum(focal), 4) AS focal_sum, round(avg(s), 6) AS score_mean FROM losses GROUP BY label",
    ),
)
def loss_columns(spark: SparkSession, sf: str) -> DataFrame:
    wide = predictions(spark, sf).select("truth", F.col("logit").alias("prob"))
    long = metrics.long_form(wide, LABELS).withColumn("w", 1.0 + F.col("position") / 10.0)
    logit, truth, w = F.col("prob"), F.col("truth"), F.col("w")
    bce, focal = metrics.weighted_bce(logit, truth, w), metrics.focal(logit, truth, w)
    return long.groupBy("label").agg(
        F.round(metrics.reduced(bce, "mean"), 6).alias("bce_mean"),
        F.round(metrics.reduced(bce, "sum"), 4).alias("bce_sum"),
        F.round(metrics.reduced(focal, "mean"), 6).alias("focal_mean"),
        F.round(metrics.reduced(focal, "sum"), 4).alias("focal_sum"),
        F.round(F.avg(sigmoid(logit)), 6).alias("score_mean"),
    )


@query(
    "weighted_cross_entropy",
    sql.with_ctes(
        [
            *PREDICTIONS,
            "logits AS (SELECT row_id, own, i, round(8.0::DOUBLE * (prob - 0.5::DOUBLE), 6) AS x FROM long)",
            "norms AS (SELECT row_id, max(x) AS m, any_value(own) AS own FROM logits GROUP BY row_id)",
            "sums AS (SELECT row_id, n.own, m, sum(exp(x - m)) AS z, max(x) FILTER (WHERE i = n.own) AS mine FROM logits JOIN norms n USING (row_id) GROUP BY ALL)",
        ],
        "SELECT round(sum((1.0::DOUBLE + own / 10.0::DOUBLE) * -(mine - m - ln(z))) / sum(1.0::DOUBLE + own / 10.0::DOUBLE), 6) AS loss FROM sums",
    ),
)
def weighted_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    w = 1.0 + F.col("label") / 10.0
    loss = -metrics.log_softmax_at(F.col("logit"), F.col("label").cast("int"))
    return predictions(spark, sf).agg(F.round(F.sum(w * loss) / F.sum(w), 6).alias("loss"))


# --- thresholds ---------------------------------------------------------------

_LISTED = "listed AS (SELECT row_id, list(label ORDER BY i) FILTER (WHERE prob >= {t}) AS hit, arg_max(label, prob - i * 1e-9::DOUBLE) AS top, list(label ORDER BY i) FILTER (WHERE truth = 1) AS own FROM long {j} GROUP BY row_id)"


@query(
    "threshold_tags",
    sql.with_ctes(
        [*PREDICTIONS, _LISTED.format(t="0.62::DOUBLE", j="")],
        "SELECT row_id, array_to_string(own, ', ') AS true, CASE WHEN coalesce(len(hit), 0) = 0 THEN top ELSE array_to_string(hit, ', ') END AS pred FROM listed",
    ),
)
def threshold_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction table: true and predicted tags as joined strings."""
    names = F.array(*[F.lit(x) for x in LABELS])
    own = F.filter(names, lambda x, i: F.element_at("truth", i + 1) == 1)
    return predictions(spark, sf).select(
        "row_id",
        lb.joined(own).alias("true"),
        lb.joined(thresholds.tags_or_best(F.col("prob"), 0.62, LABELS)).alias("pred"),
    )


_ARANGE = "grid AS (SELECT g AS gi, 0.05::DOUBLE + g * ((0.05::DOUBLE + 0.01::DOUBLE) - 0.05::DOUBLE) AS t FROM (SELECT unnest(range(90)) AS g))"


def _swept(source: str) -> list[str]:
    return [
        _ARANGE,
        f"cut AS (SELECT gi, t, label, sum(truth) FILTER (WHERE prob > t) AS tp0, count(*) FILTER (WHERE prob > t) AS said0, sum(truth) AS sup FROM {source}, grid GROUP BY gi, t, label)",
        "cut2 AS (SELECT gi, t, coalesce(tp0, 0) AS tp, said0 - coalesce(tp0, 0) AS fp, sup - coalesce(tp0, 0) AS fn FROM cut)",
        f"swept AS (SELECT gi, t, round(avg({F1_SQL}), 12) AS macro FROM cut2 GROUP BY gi, t)",
        "best AS (SELECT t, macro FROM swept WHERE macro > 0 ORDER BY macro DESC, gi LIMIT 1)",
    ]


@query("threshold_sweep", sql.with_ctes([*PREDICTIONS, *_swept("long")], "SELECT gi::INT AS i, round(t, 6) AS threshold, round(macro, 6) AS macro_f1 FROM swept"))
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    swept = thresholds.sweep(_long(spark, sf), LABELS)
    return swept.select("i", F.round("threshold", 6).alias("threshold"), F.round("macro_f1", 6).alias("macro_f1"))


@query("global_threshold", sql.with_ctes([*PREDICTIONS, *_swept("long")], "SELECT round(t, 6) AS threshold, round(macro, 6) AS macro_f1 FROM best"))
def global_threshold(spark: SparkSession, sf: str) -> DataFrame:
    best = thresholds.best_global(thresholds.sweep(_long(spark, sf), LABELS))
    return best.select(F.round("threshold", 6).alias("threshold"), F.round("macro_f1", 6).alias("macro_f1"))


_HALF = "md5('42:' || row_id) < '8'"


@query(
    "heldout_f1",
    sql.with_ctes(
        [
            *PREDICTIONS,
            f"val AS (SELECT * FROM long WHERE {_HALF})",
            *_swept("val"),
            f"said AS (SELECT l.*, (prob > coalesce((SELECT t FROM best), 0.0::DOUBLE))::INT AS p FROM long l WHERE NOT {_HALF})",
            _COUNTS,
        ],
        f"SELECT round(avg({F1_SQL}), 6) AS macro_f1, round({_ratio('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')}, 6) AS micro_f1 FROM counts",
    ),
)
def heldout_f1(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold chosen on one half of the rows, measured on the other half."""
    rows = predictions(spark, sf).withColumn("val", splits.id_hash("row_id", 42) < "8")
    long = metrics.long_form(rows, LABELS, "val")
    chosen = thresholds.best_global(thresholds.sweep(long.where("val"), LABELS)).select("threshold").scalar()
    counts = metrics.label_counts(long.where("NOT val"), metrics.decided(F.col("prob"), chosen, strict=True))
    both = metrics.f1_scores(counts)
    return both.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("micro_f1", 6).alias("micro_f1"))


_TUNED = """curve AS (SELECT label, prob, pos_above / n_above::DOUBLE AS pr, CASE WHEN support > 0 THEN pos_above / support::DOUBLE ELSE 1.0::DOUBLE END AS rc FROM steps),
    scored_t AS (SELECT label, prob, 2 * pr * rc / (pr + rc + 1e-9::DOUBLE) AS f1 FROM curve),
    tuned AS (SELECT label, prob AS threshold, f1 FROM scored_t QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, prob) = 1)"""


@query(
    "label_thresholds",
    sql.with_ctes([*PREDICTIONS, *_STEPS, _TUNED], "SELECT label, threshold, round(f1, 6) AS f1 FROM tuned"),
)
def label_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return thresholds.best_per_label(_long(spark, sf)).withColumn("f1", F.round("f1", 6))


@query(
    "apply_thresholds",
    sql.with_ctes(
        [*PREDICTIONS, *_STEPS, _TUNED, _LISTED.format(t="threshold", j="JOIN tuned USING (label)")],
        "SELECT row_id, CASE WHEN coalesce(len(hit), 0) = 0 THEN 'Miscellaneous' ELSE array_to_string(hit, ', ') END AS tags FROM listed",
    ),
)
def apply_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    tuned = thresholds.best_per_label(_long(spark, sf))
    rows = predictions(spark, sf).withColumn("t", thresholds.threshold_array(tuned, LABELS))
    return rows.select("row_id", lb.joined(thresholds.tags_reaching("prob", "t", LABELS)).alias("tags"))


# --- zero-shot and semi-automatic tagging -------------------------------------

_DESCRIPTIONS = "descriptions AS (SELECT unnest(range(8)) AS i, unnest({}) AS label, unnest({}) AS text)".format(
    sql.items([n for n, _ in lx.LABEL_DESCRIPTIONS]), sql.items([t for _, t in lx.LABEL_DESCRIPTIONS])
)
_ZERO = [
    POSTS,
    *sql.encoded("zs_post", "posts", "doc_id", "post"),
    _DESCRIPTIONS,
    *sql.encoded("zs_label", "descriptions", "i", "text"),
    "zs AS (SELECT p.doc_id AS row_id, d.i, d.label, round(list_inner_product(p.vec, l.vec), 6) AS prob FROM zs_post p, zs_label l JOIN descriptions d USING (i))",
]


@query("zero_shot_scores", sql.with_ctes(_ZERO, "SELECT row_id AS doc_id, label, prob FROM zs"))
def zero_shot_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = zero_shot.with_label_scores(inputs.posts(spark, sf), "post")
    named = F.arrays_zip(F.array(*[F.lit(x) for x in zero_shot.SCORED_LABELS]).alias("label"), F.col("prob").alias("prob"))
    return scored.select("doc_id", F.inline(named))


_HUMAN = f"""pieces AS (SELECT doc_id, unnest(string_split_regex(coalesce(tag, ''), '[;,]')) AS raw FROM posts),
    named AS (SELECT DISTINCT doc_id, {sql.lookup({**TAG_NAMES, **lx.HUMAN_ALIASES}, "lower(trim(" + sql.strip('raw') + ", '\"'))")} AS tag FROM pieces),
    human AS (SELECT p.doc_id, p.tag AS raw_tag, coalesce(list(n.tag ORDER BY n.tag) FILTER (WHERE n.tag IS NOT NULL), ['Miscellaneous']) AS tags
        FROM posts p LEFT JOIN named n USING (doc_id) WHERE coalesce(p.tag, '') <> '' GROUP BY ALL)"""
_GOLD = [
    *_ZERO,
    _HUMAN,
    "long AS (SELECT z.row_id, z.i, z.label, z.prob, list_contains(h.tags, z.label)::INT AS truth FROM zs z JOIN human h ON h.doc_id = z.row_id)",
    *_STEPS,
    _TUNED,
]


@query(
    "semi_auto_tagging",
    sql.with_ctes(
        [
            *_GOLD,
            "auto AS (SELECT row_id, list(z.label ORDER BY i) FILTER (WHERE prob >= threshold) AS hit FROM zs z JOIN tuned USING (label) GROUP BY row_id)",
        ],
        """SELECT p.doc_id, coalesce(p.tag, '') AS Tag, array_to_string(coalesce(h.tags, a.hit, ['Miscellaneous']), ', ') AS Final_Tags,
        CASE WHEN h.doc_id IS NULL THEN 'Model_Optimal' ELSE 'Human_Gold' END AS Tag_Source
        FROM posts p LEFT JOIN human h ON h.doc_id = p.doc_id LEFT JOIN auto a ON a.row_id = p.doc_id""",
    ),
)
def semi_auto_tagging(spark: SparkSession, sf: str) -> DataFrame:
    source = inputs.posts(spark, sf).select("doc_id", F.col("post").alias("Text"), F.col("tag").alias("Tag"))
    tagged = zero_shot.semi_auto_tags(source)
    return tagged.select("doc_id", "Tag", lb.joined(F.col("Final_Tags")).alias("Final_Tags"), "Tag_Source")


@query(
    "tagging_evaluation",
    sql.with_ctes(
        [
            *_GOLD,
            "auto AS (SELECT row_id, list(l.label ORDER BY i) FILTER (WHERE prob >= threshold) AS hit FROM long l JOIN tuned USING (label) GROUP BY row_id)",
        ],
        "SELECT h.doc_id, array_to_string(h.tags, ', ') AS Human_Tags, array_to_string(coalesce(a.hit, ['Miscellaneous']), ', ') AS Model_Tags FROM human h JOIN auto a ON a.row_id = h.doc_id",
    ),
)
def tagging_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    source = inputs.posts(spark, sf).select("doc_id", F.col("post").alias("Text"), F.col("tag").alias("Tag"))
    both = zero_shot.evaluated_tags(source)
    return both.select("doc_id", lb.joined(F.col("Human_Tags")).alias("Human_Tags"), lb.joined(F.col("Model_Tags")).alias("Model_Tags"))


# --- fitted models ------------------------------------------------------------


def _split_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = inputs.table(spark, sf, "embeddings").withColumn("concern", (F.col("label") % 3).cast("int"))
    own = F.array(*[(F.col("label") == i).cast("int") for i in range(len(LABELS))])
    return splits.three_way_split(v.withColumn("truth", own), "vec_id", stratum="concern")


@query("logreg_ovr")
def logreg_ovr(spark: SparkSession, sf: str) -> DataFrame:
    """One balanced logistic regression per label; F1 per label and split."""
    rows = _split_vectors(spark, sf)
    models = learners.fit_per_label(rows.where("split = 'train'"), "embedding", "truth", LABELS, max_iter=50)
    scored = learners.predict_per_label(models, rows.where("split <> 'train'"), "embedding")
    long = metrics.long_form(scored, LABELS, "split")
    hit = long.withColumn("p", metrics.decided(F.col("prob"), 0.5))
    tp = F.count_if((F.col("p") == 1) & (F.col("truth") == 1))
    counts = hit.groupBy("split", "label").agg(
        tp.alias("tp"), (F.sum("p") - tp).alias("fp"), (F.sum("truth") - tp).alias("fn"), F.sum("truth").alias("support")
    )
    return counts.select("split", "label", metrics.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), "support")


@query(
    "logreg_fit",
    f"""SELECT 'class ' || i AS label, count(*) FILTER (WHERE label = i) AS support, true AS at_optimum, true AS learned
    FROM embeddings, range({len(LABELS)}) t(i) GROUP BY i""",
)
def logreg_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Per label: its positives, whether the fit ended at the optimum, and whether it beats a model that knows nothing."""
    own = F.array(*[(F.col("label") == i).cast("int") for i in range(len(LABELS))])
    models = learners.fit_per_label(inputs.table(spark, sf, "embeddings").withColumn("truth", own), "embedding", "truth", LABELS)
    rows = [(name, m.support, m.gradient_norm < 1e-8, m.loss < 0.99 * math.log(2.0)) for name, m in zip(LABELS, models) if m]
    return spark.createDataFrame(rows, "label string, support long, at_optimum boolean, learned boolean")


@query("logreg_multinomial")
def logreg_multinomial(spark: SparkSession, sf: str) -> DataFrame:
    """A multinomial model for three classes; its confusion cells on the test rows."""
    rows = _split_vectors(spark, sf)
    model = learners.fit_multinomial(rows.where("split = 'train'"), "embedding", "concern", max_iter=50)
    scored = learners.predict_class(model, rows.where("split = 'test'").select("vec_id", "embedding", "concern"), "embedding")
    return metrics.confusion(scored, "concern", "pred", [0, 1, 2], "int")
