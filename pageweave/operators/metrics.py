"""Run metrics: means, early stopping, logs, gates and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epoch_means(batches: DataFrame) -> DataFrame:
    """Loss per run and epoch, weighted by ``n``."""
    return batches.groupBy("run", "epoch").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def early_stop(epochs: DataFrame, patience: int) -> DataFrame:
    """``improved``, ``since`` (epochs since the best) and ``stopped`` per epoch; improvement is strict."""
    w = Window.partitionBy("run").orderBy("epoch")
    best = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = epochs.withColumn("improved", best.isNull() | (F.col("loss") < best))
    rows = rows.withColumn("__g", F.sum(F.col("improved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("since", F.row_number().over(Window.partitionBy("run", "__g").orderBy("epoch")) - 1).drop("__g")
    reached = F.max((F.col("since") >= patience).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("stopped", reached == 1)


def parse_training_log(lines: DataFrame) -> DataFrame:
    """``file, best``: the loss of the epoch line right before the last "saved best model" line."""
    loss = F.regexp_extract("line", r"val(?: loss)?=([0-9.]+)", 1)
    w = Window.partitionBy("file").orderBy("line_no")
    rows = lines.withColumn("before", F.lag(loss).over(w)).filter(F.col("line").contains("saved best model"))
    return rows.groupBy("file").agg(F.max_by(F.expr("try_cast(before as double)"), "line_no").alias("best"))


def gate(best: DataFrame, threshold: float) -> DataFrame:
    return best.withColumn("passed", F.coalesce(F.col("best") < threshold, F.lit(False)))


def smooth_l1(d):
    return F.when(F.abs(d) < 1, 0.5 * d * d).otherwise(F.abs(d) - 0.5)


def evaluate(preds: DataFrame, targets: DataFrame, keys: list[str], side: float = 1024.0) -> DataFrame:
    """Per level: point, orientation and handwriting losses over valid rows, and their weighted total (1, .5, .1).

    One join of predictions (``x, y, dx, dy, logit``) and targets (``x, y, dx, dy, flag, class_id``) on ``keys``.
    """
    p = preds.select(*keys, *[F.col(c).alias("p_" + c) for c in ("x", "y", "dx", "dy", "logit")])
    j = targets.join(p, keys)
    valid = F.col("class_id") != 0
    point = (smooth_l1((F.col("p_x") - F.col("x")) / side) + smooth_l1((F.col("p_y") - F.col("y")) / side)) / 2
    turn = 1 - (F.col("p_dx") * F.col("dx") + F.col("p_dy") * F.col("dy"))
    z = F.col("p_logit")
    bce = F.greatest(z, F.lit(0.0)) - z * F.col("flag") + F.log1p(F.exp(-F.abs(z)))
    out = j.groupBy("level").agg(
        F.avg(F.when(valid, point)).alias("point_loss"), F.avg(F.when(valid, turn)).alias("orientation_loss"),
        F.avg(F.when(valid, bce)).alias("handwritten_loss"), F.count_if(valid).alias("n"),
    )
    return out.withColumn("total", F.col("point_loss") + 0.5 * F.col("orientation_loss") + 0.1 * F.col("handwritten_loss"))


def class_loss(rows: DataFrame, smoothing: float) -> DataFrame:
    """Cross-entropy of ``logits`` (array) and ``target`` with label smoothing, per row."""
    top = F.array_max("logits")
    norm = top + F.log(F.aggregate(F.transform("logits", lambda z: F.exp(z - top)), F.lit(0.0), lambda a, b: a + b))
    own = norm - F.get("logits", F.col("target"))
    mean = norm - F.aggregate("logits", F.lit(0.0), lambda a, b: a + b) / F.size("logits")
    return rows.withColumn("loss", (1 - smoothing) * own + smoothing * mean)


def self_intersection(contours: DataFrame, key: str, k: float = 0.01) -> DataFrame:
    """Mean over pairs of an open contour's segments that are no neighbours (nor the first and the last) of a soft crossing score.

    A contour of fewer than four points, or without such a pair, has no row.
    """
    seg = contours.filter(F.size("contour") >= 4).select(key, F.size("contour").alias("n"), F.posexplode("contour").alias("i", "a"), "contour")
    seg = seg.filter("i < n - 1").withColumn("b", F.get("contour", F.col("i") + 1)).drop("contour")
    s, t = seg.alias("s"), seg.alias("t")
    pairs = s.join(t, key).filter("t.i >= s.i + 2 and not (s.i = 0 and t.i = s.n - 2)")

    def side(a, b, p):
        return f"(({b}.x - {a}.x) * ({p}.y - {a}.y) - ({b}.y - {a}.y) * ({p}.x - {a}.x))"

    def soft(d1, d2):
        return f"(1 / (1 + exp(least(700D, greatest(-700D, {d1} * {d2} * {k})))))"

    score = soft(side("s.a", "s.b", "t.a"), side("s.a", "s.b", "t.b")) + " * " + soft(side("t.a", "t.b", "s.a"), side("t.a", "t.b", "s.b"))
    return pairs.groupBy(key).agg(F.avg(F.expr(score)).alias("score"))



#: Weights of the generations' totals, by the name of the loss.
WEIGHTS = {
    "contours": {"point": 1.0, "orientation": 0.5, "class": 1.0, "intersection": 0.1},
    "boxes": {"point": 1.0, "class": 1.0, "handwritten": 0.5},
    "items": {"point": 1.0, "class": 1.0},
}


def evaluate_losses(
    preds: DataFrame,
    targets: DataFrame,
    keys: list[str],
    points: tuple[str, ...] = ("x", "y"),
    paragraph: int = 2,
    smoothing: float = 0.1,
    side: float = 1024.0,
    crossing: DataFrame | None = None,
) -> DataFrame:
    """Per ``level``: ``point_loss, orientation_loss, class_loss, handwritten_loss, intersection_loss, n`` and ``total_`` of each of WEIGHTS.

    One join of predictions (``points``, ``dx, dy, logit, logits``) and targets (``points``, ``dx, dy, flag, class_id``). Points and
    directions count where the target is no NONE, classes everywhere, handwriting at paragraphs only; a loss without rows is
    0. ``crossing(level, score)`` brings the self-intersection of a level's contours (``self_intersection``), 0 if left out.
    """
    p = preds.select(*keys, "logits", *[F.col(c).alias("p_" + c) for c in (*points, "dx", "dy", "logit")])
    j = class_loss(targets.join(p, keys).withColumn("target", F.col("class_id")), smoothing)
    valid, handed = F.col("class_id") != 0, F.col("class_id") == paragraph
    point = sum(smooth_l1((F.col(f"p_{c}") - F.col(c)) / side) for c in points) / len(points)
    turn = 1 - (F.col("p_dx") * F.col("dx") + F.col("p_dy") * F.col("dy"))
    z = F.col("p_logit")
    bce = F.greatest(z, F.lit(0.0)) - z * F.col("flag") + F.log1p(F.exp(-F.abs(z)))
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    out = j.groupBy("level").agg(
        mean(F.when(valid, point)).alias("point_loss"), mean(F.when(valid, turn)).alias("orientation_loss"), mean("loss").alias("class_loss"),
        mean(F.when(handed, bce)).alias("handwritten_loss"), F.count_if(valid).alias("n"),
    )
    if crossing is not None:
        out = out.join(crossing.select("level", F.col("score").alias("intersection_loss")), "level", "left")
    found = F.coalesce("intersection_loss", F.lit(0.0)) if crossing is not None else F.lit(0.0)
    out = out.withColumn("intersection_loss", found)
    return out.withColumns({f"total_{k}": sum(w * F.col(f"{loss}_loss") for loss, w in v.items()) for k, v in WEIGHTS.items()})


def component_means(batches: DataFrame, components: list[str], rank: str | None = None) -> DataFrame:
    """Each of the ``components`` per run and epoch, weighted by ``n``; with ``rank`` the plain mean over the ranks' own means."""
    keys = ["run", "epoch", *([rank] if rank else [])]
    means = batches.groupBy(*keys).agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in components])
    return means.groupBy("run", "epoch").agg(*[F.avg(c).alias(c) for c in components]) if rank else means
