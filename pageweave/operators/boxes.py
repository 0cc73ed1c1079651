"""Boxes: range joins by tiles, suppression, components, window scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from pageweave.functions.scratch import saved
from pageweave.functions.whole import arrow, batch_of, by_groups
from pageweave.operators.graph import connected_components
from pageweave.operators.sweep import Boxes

_BOX = ("x1", "y1", "x2", "y2")


Tile = int | tuple[int, int]


def _tiled(boxes: DataFrame, tile: tuple[int, int]) -> DataFrame:
    span = lambda a, b, t: F.explode(F.sequence(F.floor(F.col(a) / t), F.floor(F.col(b) / t)))
    return boxes.withColumn("tx", span("x1", "x2", tile[0])).withColumn("ty", span("y1", "y2", tile[1]))


def fitting_tile(boxes: DataFrame) -> tuple[int, int]:
    """Width and height of twice the median box, so that a tile holds few boxes and a box stands in few tiles."""
    sides = [F.percentile_approx(F.col(b) - F.col(a), 0.5).alias(n) for a, b, n in (("x1", "x2", "w"), ("y1", "y2", "h"))]
    r = boxes.agg(*sides).first()
    return max(8, 2 * int(r["w"] or 0)), max(8, 2 * int(r["h"] or 0))


def _met_itself(boxes: DataFrame, group: list[str], tile: Tile | None, also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs as of ``overlap_join`` of boxes with themselves, but each also with itself, in tiles that fit them unless told.

    One grouping by group and tile, whose members are paired in place: boxes that are dealt by a column of the group are not
    moved.
    """
    own = boxes.select(*group, "id", *_BOX, *also)
    w, h = (tile if isinstance(tile, tuple) else (tile, tile)) if tile else fitting_tile(own)
    span = lambda x, y, t: F.explode_outer(F.sequence(F.floor(F.col(x) / t), F.floor(F.col(y) / t)))
    tiles = own.withColumn("tx", span("x1", "x2", w)).withColumn("ty", span("y1", "y2", h))
    tiles = tiles.groupBy(*group, "tx", "ty").agg(F.collect_list(F.struct("id", *_BOX, *also)).alias("m"))
    pairs = tiles.select("*", F.explode("m").alias("a")).select(*group, "tx", "ty", "a", F.explode("m").alias("b"))
    meets = F.expr("a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2")
    once = (F.col("tx") == F.floor(F.greatest("a.x1", "b.x1") / w)) & (F.col("ty") == F.floor(F.greatest("a.y1", "b.y1") / h))
    pairs = pairs.filter(meets & once)
    return pairs.select(*group, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("id", *_BOX, *also)])


def overlap_join(a: DataFrame, b: DataFrame, group: str, tile: Tile = 256, also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of ``a`` and ``b`` (ids ``id``, boxes and columns ``also``; all prefixed) of a group whose closed boxes meet.

    An equi-join on group and tile; a pair is taken in the one tile that holds the upper left corner of its overlap, so
    nothing has to be made distinct.
    """
    tile = tile if isinstance(tile, tuple) else (tile, tile)
    left = _tiled(a.select(group, "id", *_BOX, *also), tile).select(group, "tx", "ty", *[F.col(c).alias("a_" + c) for c in ("id", *_BOX, *also)])
    right = _tiled(b.select(group, "id", *_BOX, *also), tile).select(group, "tx", "ty", *[F.col(c).alias("b_" + c) for c in ("id", *_BOX, *also)])
    meets = "a_x1 <= b_x2 and b_x1 <= a_x2 and a_y1 <= b_y2 and b_y1 <= a_y2"
    once = (F.col("tx") == F.floor(F.greatest("a_x1", "b_x1") / tile[0])) & (F.col("ty") == F.floor(F.greatest("a_y1", "b_y1") / tile[1]))
    return left.join(right, [group, "tx", "ty"]).filter(meets).filter(once).drop("tx", "ty")


def contains_join(outer: DataFrame, inner: DataFrame, group: str, tile: int = 256) -> DataFrame:
    """Pairs whose inner box lies in the outer one, edges included."""
    return overlap_join(outer, inner, group, tile).filter("b_x1 >= a_x1 and b_y1 >= a_y1 and b_x2 <= a_x2 and b_y2 <= a_y2")


def overlap_area() -> Column:
    w = F.greatest(F.lit(0), F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1"))
    h = F.greatest(F.lit(0), F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1"))
    return w * h


def _area(side: str) -> Column:
    return (F.col(f"{side}_x2") - F.col(f"{side}_x1")) * (F.col(f"{side}_y2") - F.col(f"{side}_y1"))


def _pairs_met(boxes: DataFrame, group: str, tile: Tile | None, share: str, fields: Sequence[str]) -> DataFrame:
    """Pairs of a group that meet, the smaller id first, with ``inter`` and ``share``; of them ``fields``, or all if none are told.

    Groups of at most COMPONENT boxes are swept as a whole in one pass, larger ones (or any, where a ``tile`` is told) go by tiles.
    """
    boxes = boxes.filter(F.col(group).isNotNull())
    small, large = (boxes.limit(0), boxes) if tile else _split(boxes, [group])

    def by_tiles(rows: DataFrame) -> DataFrame:
        pairs = _met_itself(rows, [group], tile or (64, 64) if rows is small else tile).filter("a_id < b_id").withColumn("inter", overlap_area())
        of = F.least(_area("a"), _area("b")) if share == "of_smaller" else _area("a") + _area("b") - F.col("inter")
        pairs = pairs.withColumn(share, F.when(of > 0, F.col("inter") / of).otherwise(0.0))
        return pairs.select(group, *fields) if fields else pairs

    shape = by_tiles(small).schema
    told = arrow(shape)

    def run(table: pa.Table, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = Boxes(table, groups)
        ident = table["__id"].to_numpy()
        for i, j in own.pairs():
            ok = (ident[i] != ident[j]) & (ident[i] > 0)
            i, j = i[ok], j[ok]
            inter = own.shared(i, j)
            of = np.minimum(own.area(i), own.area(j)) if share == "of_smaller" else own.area(i) + own.area(j) - inter
            with np.errstate(divide="ignore", invalid="ignore"):
                made = {"inter": inter, share: np.where(of > 0, inter / of, 0.0)}
            at = {"a": pa.array(i), "b": pa.array(j)}
            yield batch_of(told, [made[c] if c in made else table[group].take(at["a"]) if c == group else table[c[2:]].take(at[c[0]]) for c in shape.names])

    number = F.when(F.col("id").isNotNull(), F.dense_rank().over(Window.partitionBy(group).orderBy("id"))).otherwise(0)
    met = by_groups(small.select(group, "id", *_BOX, number.alias("__id")), [group], ["id"], run, shape)
    return met if large is None else by_tiles(large) if tile else met.unionByName(by_tiles(large))


def iou_pairs(boxes: DataFrame, group: str, tile: Tile | None = None, fields: Sequence[str] = ()) -> DataFrame:
    """``iou`` of every meeting pair of a group, the smaller id first; 0 where the union is empty. With ``fields`` only these beside the group."""
    return _pairs_met(boxes, group, tile, "iou", fields)


def overlap_pairs(boxes: DataFrame, group: str, tile: Tile | None = None, fields: Sequence[str] = ()) -> DataFrame:
    """``inter`` and its share ``of_smaller`` of the smaller box. With ``fields`` only these beside the group."""
    return _pairs_met(boxes, group, tile, "of_smaller", fields)


def box_components(boxes: DataFrame, group: str, least: float = 0.9, measured: tuple[tuple[int, int], int] | None = None) -> DataFrame:
    """``component`` of each box: its smallest id under links of pairs that share ``least`` of the smaller box.

    Boxes of different groups are never linked, ids are those of a group. Links are found and followed in one pass over each group; groups of more than
    COMPONENT boxes go by tiles and by rounds over all links. Boxes that are dealt by the group are not moved.
    """
    small, large = (boxes, None) if measured and measured[1] <= COMPONENT else _split(boxes, [group])
    out = _followed(small, group, least)
    if large is None:
        return out
    links = overlap_pairs(large, group).filter(F.col("of_smaller") >= least)
    parts = connected_components(links.select(*[F.struct(F.col(group).alias("g"), F.col(f"{s}_id").alias("id")).alias(s) for s in "ab"]))
    parts = parts.select(F.col("vertex.g").alias(group), F.col("vertex.id").alias("id"), F.col("component.id").alias("component"))
    return out.unionByName(large.join(parts, [group, "id"], "left").withColumn("component", F.coalesce("component", "id")))


def _measured(boxes: DataFrame, group: str) -> tuple[tuple[int, int], int]:
    """A tile of twice the geometric mean box, and the size of the largest group; one pass, that moves a row per group at most."""
    sides = {n: F.ln(F.greatest(F.col(b) - F.col(a), F.lit(1))) for a, b, n in (("x1", "x2", "w"), ("y1", "y2", "h"))}
    per = boxes.groupBy(group).agg(F.count("*").alias("n"), *[f(e).alias(k + n) for n, e in sides.items() for f, k in ((F.sum, "s"), (F.count, "c"))])
    r = per.agg(F.max("n").alias("n"), *[F.exp(F.sum("s" + n) / F.sum("c" + n)).alias(n) for n in sides]).first()
    return (max(8, int(2 * (r["w"] or 0))), max(8, int(2 * (r["h"] or 0)))), r["n"] or 0


def _followed(boxes: DataFrame, group: str, least: float) -> DataFrame:
    """``box_components`` of groups of bounded size: a task holds the ids and rows of some groups at a time."""
    columns = boxes.columns
    shape = boxes.select(*columns, F.col("id").alias("component")).schema
    told = arrow(shape)

    def run(table: pa.Table, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = Boxes(table, groups)
        known = table["id"].combine_chunks().is_valid().to_numpy(False) & table[group].combine_chunks().is_valid().to_numpy(False)

        def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            small = np.minimum(own.area(i), own.area(j))
            with np.errstate(divide="ignore", invalid="ignore"):
                return (np.where(small > 0, own.shared(i, j) / small, 0.0) >= least) & known[i] & known[j]

        first = np.ones(len(table), bool)  # boxes of one id are one
        ident = table["__id"].to_numpy()
        first[1:] = ident[1:] != ident[:-1]
        first[groups] = True
        same = np.flatnonzero(first)[np.cumsum(first) - 1]
        root = same.tolist()

        def find(k: int) -> int:
            while (up := root[k]) != k:
                root[k] = root[up]
                k = up
            return k

        for i, j in own.pairs():
            ok = linked(i, j)
            for a, b in zip(same[i[ok]].tolist(), same[j[ok]].tolist()):
                if (a := find(a)) != (b := find(b)):
                    root[max(a, b)] = min(a, b)
        roots = pa.array([find(k) for k in root])
        yield batch_of(told, [*[table[c] for c in columns], table["id"].take(roots)])

    number = F.dense_rank().over(Window.partitionBy(group).orderBy("id"))
    return by_groups(boxes.withColumn("__id", number), [group], ["id"], run, shape)


def best_box(rows: DataFrame, key: str) -> DataFrame:
    """The box of the highest score per key, ties to the larger tuple."""
    return rows.groupBy(key).agg(F.max(F.struct("score", *_BOX)).alias("b")).select(key, "b.*")


#: Conflicts of a component that one task settles in order; larger components go on in rounds.
COMPONENT = 1 << 17


def _fold(conflicts: DataFrame) -> DataFrame:
    """``loser`` of each component of ``component, turn, a, b, loser``: in order, where both still stand, the loser goes."""
    shape = StructType([StructField("loser", conflicts.schema["loser"].dataType)])
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, gone = None, set()
        for batch in batches:
            out = []
            for c, *ends in zip(*(batch[n].to_pylist() for n in ("component", "a", "b", "loser")), strict=True):
                a, b, loser = (tuple(e.values()) for e in ends)
                if c != component:
                    component, gone = c, set()
                if a not in gone and b not in gone:
                    gone.add(loser)
                    out.append(ends[2])
            yield pa.RecordBatch.from_arrays([pa.array(out, arrow[0].type)], schema=arrow)

    return conflicts.repartition("component").sortWithinPartitions("component", "turn").mapInArrow(run, shape)


def _settled(conflicts: DataFrame, one_round: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """``loser`` of the conflicts ``a, b, loser, turn`` taken in order of ``turn``: where both ends still stand, the loser goes.

    ``one_round(live)`` tells losers that are certain whatever becomes of the rest. After some rounds the components of what
    is left are settled in order, each in one task, if they have at most COMPONENT conflicts; larger ones go on in
    rounds, which break them up. So no task holds a group, long rows of neighbours need few rounds, and the result is that
    of the order in every case. What is open is written to the shared folder in each round.
    """
    live, gone = saved(conflicts, "conflicts"), []

    def without(lost: DataFrame) -> DataFrame:
        left = live
        for side in "ab":
            left = left.join(lost.withColumnRenamed("loser", side), side, "left_anti")
        return left

    while not live.isEmpty():
        for _ in range(rounds):
            lost = saved(one_round(live), "lost")
            gone.append(lost)
            live = saved(without(lost), "conflicts")
            if live.isEmpty():
                break
        else:
            parts = connected_components(live.select("a", "b")).withColumnRenamed("vertex", "a")
            tagged = saved(live.join(parts, "a"), "components")
            small = tagged.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") <= COMPONENT)
            gone.append(saved(_fold(tagged.join(small, "component")), "lost"))
            live = saved(tagged.join(small, "component", "left_anti").drop("component"), "conflicts")
    out = live.select("loser")
    for lost in gone:
        out = out.unionByName(lost)
    return out


def _unbeaten(live: DataFrame) -> DataFrame:
    """A round where winners are ranked: who loses to one that no open conflict holds down, goes."""
    free = live.select("a").distinct().join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    return live.join(free, "a").select("loser").distinct()


def _first_of_both(live: DataFrame) -> DataFrame:
    """A round where turns alone count: the losers of conflicts that come first among those of both their ends."""
    ends = live.select(F.explode(F.array("a", "b")).alias("v"), "turn").groupBy("v").agg(F.min("turn").alias("turn"))
    now = live
    for side in "ab":
        now = now.join(ends.withColumnRenamed("v", side), [side, "turn"], "left_semi")
    return now.select("loser").distinct()


def _split(boxes: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Boxes of groups of at most COMPONENT boxes, and those of larger ones, if there are any."""
    names = [f"__{k}" for k in range(len(group))]
    large = boxes.groupBy(*[F.col(c).alias(n) for c, n in zip(group, names)]).agg(F.count("*").alias("__n")).filter(F.col("__n") > COMPONENT).drop("__n")
    if large.isEmpty():
        return boxes, None
    large, same = saved(large, "large"), F.lit(True)
    for c, n in zip(group, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return boxes.join(large, same, "left_anti"), boxes.join(large, same, "left_semi")


def _in_order(boxes: DataFrame, group: list[str], order: Column, losers: Callable[[pa.Table, Boxes], Iterator[tuple[np.ndarray, ...]]]) -> DataFrame:
    """The boxes that stay, group by group in ``order``.

    ``losers`` gives the conflicts of a table of whole groups as places ``i < j``, in that order and some at a time, and where of the two ``i``
    goes (not told: ``j`` always): where both ends still stand, one goes. A task holds some groups at a time; groups are of bounded size.
    """
    columns, shape = boxes.columns, boxes.schema
    told = arrow(shape)

    def run(table: pa.Table, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = Boxes(table, groups)
        stays = bytearray(b"\1") * len(table)
        for i, j, *own_goes in losers(table, own):
            if own_goes:
                for a, b, goes in zip(i.tolist(), j.tolist(), own_goes[0].tolist()):
                    if stays[a] and stays[b]:
                        stays[a if goes else b] = 0
            else:
                for a, b in zip(i.tolist(), j.tolist()):
                    if stays[a]:
                        stays[b] = 0
            own.known &= np.frombuffer(stays, np.uint8).astype(bool)
        left = table.filter(pa.array(np.frombuffer(stays, np.uint8).astype(bool)))
        yield batch_of(told, [left[c] for c in columns])

    return by_groups(boxes, group, [order], run, shape)


def nms(dets: DataFrame, group: list[str], thr: float = 0.3, min_conf: float = 0.1) -> DataFrame:
    """Greedy suppression per group by falling confidence (ties by id); NONE, weak and unmeasured detections go.

    ``id`` is unique within the first key of the group. Conflicts are found by tiles and taken in order within the group; groups of
    more than COMPONENT detections are settled as in ``_settled``.
    """
    strong = dets.filter((F.col("class_id") != 0) & (F.col("confidence") >= min_conf))
    small, large = _split(strong, group)
    rank = F.struct((-F.col("confidence")).alias("c"), F.col("id").alias("id"))

    def losers(_: pa.Table, own: Boxes):
        def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            inter = own.shared(i, j)
            union = own.area(i) + own.area(j) - inter
            with np.errstate(divide="ignore", invalid="ignore"):
                return (union > 0) & (inter / union >= thr)

        return own.in_order(alike)

    kept = _in_order(small, group, rank, losers)
    return kept if large is None else kept.unionByName(_nms_in_rounds(large, group, thr))


def _nms_in_rounds(strong: DataFrame, group: list[str], thr: float) -> DataFrame:
    keyed = strong.withColumn("__g", F.struct(*group))
    rank = F.struct((-F.col("confidence")).alias("c"), F.col("id").alias("id"))
    pairs = _met_itself(keyed.withColumn("rank", rank), ["__g"], None, ("rank",)).filter("a_rank < b_rank").withColumn("inter", overlap_area())
    union = _area("a") + _area("b") - F.col("inter")
    pairs = pairs.filter((union > 0) & (F.col("inter") / union >= thr))
    key = {s: F.struct(F.col(f"__g.{group[0]}").alias("g"), F.col(f"{s}_id").alias("id")) for s in "ab"}
    turn = F.struct(F.col("a_rank").alias("a"), F.col("b_rank").alias("b"))
    lost = _settled(pairs.select(key["a"].alias("a"), key["b"].alias("b"), key["b"].alias("loser"), turn.alias("turn")), _unbeaten)
    return strong.join(lost.select(F.col("loser.g").alias(group[0]), F.col("loser.id").alias("id")), [group[0], "id"], "left_anti").select(*strong.columns)


def content_regions(profile: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Islands of occupied positions more than ``gap`` blanks apart: ``start, stop`` and the extremes across."""
    w = Window.partitionBy(*keys).orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(w) - 1 > gap, 1).otherwise(0)
    rows = profile.withColumn("__new", new)
    rows = rows.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def sliding_windows(images: DataFrame, size: int = 64, stride: int = 32) -> DataFrame:
    """All window origins, column by column, at least one each way; ``idx`` counts them."""
    steps = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col(n) - size) / stride)).cast("int"))
    rows = images.withColumn("cx", F.explode(steps("width"))).withColumn("cy", F.explode(steps("height")))
    down = F.greatest(F.lit(0), F.floor((F.col("height") - size) / stride)) + 1
    return rows.withColumns({"idx": F.col("cx") * down + F.col("cy"), "x1": F.col("cx") * stride, "y1": F.col("cy") * stride}).drop("cx", "cy")


def calibrate_thresholds(scores: DataFrame) -> DataFrame:
    return scores.filter("label = own_label").groupBy("label").agg(F.min("score").alias("thr"))


def apply_thresholds(scores: DataFrame, thresholds: DataFrame, factor: float) -> DataFrame:
    """Scores that reach ``factor`` times their label's threshold; labels are few, but Spark decides on the join."""
    return scores.join(thresholds, "label").filter(F.col("score") >= factor * F.col("thr"))


def argmax_label(scores: DataFrame, key: str, blank: object | None = None) -> DataFrame:
    """``label`` of the highest score per key, the smaller of equals; a ``blank`` label never wins, and a key that has no other goes."""
    scores = scores if blank is None else scores.filter(F.col("label") != blank)
    return scores.groupBy(key).agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("label"), F.max("score").alias("score"))


def nearest_template(vectors: DataFrame, templates: DataFrame) -> DataFrame:
    """``id, key, distance``: the template of the least squared distance, the smallest key of equals.

    The template table must be small: it is joined to every vector. It is checked to be so.
    """
    if (n := templates.limit(10_001).count()) > 10_000:
        raise ValueError(f"{n} templates or more")
    d = F.aggregate(F.zip_with("vec", "tvec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = vectors.crossJoin(F.broadcast(templates)).withColumn("distance", d)
    return pairs.groupBy("id").agg(F.min(F.struct("distance", "key")).alias("m")).select("id", "m.key", "m.distance")


def subdivide(rects: DataFrame, step: int) -> DataFrame:
    """Rects with one side moved in by ``step``, where room is left."""
    sides = [("x1", 1), ("y1", 1), ("x2", -1), ("y2", -1)]
    shapes = F.array(*[F.struct(*[(F.col(c) + (s * step if c == side else 0)).alias(c) for c in _BOX]) for side, s in sides])
    rows = rects.drop(*_BOX).columns
    return rects.select(*rows, F.explode(shapes).alias("r")).select(*rows, "r.*").filter("x2 > x1 and y2 > y1")


def candidate_boxes(regions: DataFrame, line: list[str]) -> DataFrame:
    """Regions up to 1.5 times their line's median width as they are; wider ones as windows of that width.

    Windows go half a width on each time; one more ends at the region's right edge where the last falls short of it.
    """
    rows = regions.withColumn("__w", F.col("x2") - F.col("x1"))
    expected = F.percentile("__w", F.lit(0.5)).over(Window.partitionBy(*line)).cast("int")
    rows = rows.withColumn("__e", F.greatest(expected, F.lit(1)))
    last = F.col("x2") - F.col("__e")
    starts = F.array_distinct(F.concat(F.sequence("x1", last, F.greatest(F.expr("cast(__e div 2 as int)"), F.lit(1))), F.array(last)))
    windows = F.transform(starts, lambda s: F.struct(s.alias("x1"), (s + F.col("__e")).alias("x2")))
    whole = F.array(F.struct("x1", "x2"))
    rows = rows.withColumn("__c", F.explode(F.when(F.col("__w") <= 1.5 * F.col("__e"), whole).otherwise(windows)))
    return rows.withColumns({"x1": F.col("__c.x1"), "x2": F.col("__c.x2")}).drop("__c", "__e", "__w")


def overlap_score(boxes: DataFrame, component: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``score``: twice the area that a box shares with all boxes of its component, itself included.

    ``within`` names columns that are the same throughout a component; boxes that are dealt by one of them are not moved. Components of
    more than COMPONENT boxes go by tiles.
    """
    group = [*within, component]
    own = boxes.filter(F.col(component).isNotNull()).select(*group, "id", *_BOX)
    small, large = _split(own, group)

    def by_tiles(rows: DataFrame, tile: Tile | None) -> DataFrame:
        pairs = _met_itself(rows, group, tile).withColumn("inter", overlap_area())
        return pairs.groupBy(*group, F.col("a_id").alias("id")).agg((2 * F.sum("inter")).alias("score")).drop(*within)

    shape = by_tiles(small, 64).schema
    told = arrow(shape)

    def run(table: pa.Table, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
        met = Boxes(table, groups)
        alone = np.arange(len(table))
        itself = met.known & (met.x1 <= met.x2) & (met.y1 <= met.y2)
        score = np.where(itself, met.shared(alone, alone), 0)
        seen = itself.copy()
        for i, j in met.pairs():
            inter = met.shared(i, j)
            for k in (i, j):
                np.add.at(score, k, inter)
                seen[k] = True
        first = np.ones(len(table), bool)  # boxes of one id are one
        ident = table["__id"].to_numpy()
        first[1:] = ident[1:] != ident[:-1]
        first[groups] = True
        at = np.flatnonzero(first)
        score, seen = np.add.reduceat(score, at), np.logical_or.reduceat(seen, at)
        rows = pa.array(at[seen])
        yield batch_of(told, [table[component].take(rows), table["id"].take(rows), 2 * score[seen]])

    number = F.dense_rank().over(Window.partitionBy(*group).orderBy("id"))
    scored = by_groups(small.withColumn("__id", number), group, ["id"], run, shape)
    return scored if large is None else scored.unionByName(by_tiles(large, None))


def sequence_search(boxes: DataFrame, group: str, word: str, reach: int = 64) -> DataFrame:
    """``chain``: ids of boxes labelled with the word's letters, each inside the window of the one before.

    The window of a box is itself, ``reach`` further to the right, up and down. ``boxes`` has a row per box and label. A
    range join per letter over the distinct boxes, then equi-joins of neighbours. Words of one letter have no chains. The boxes of
    all letters are made once.
    """
    if len(word) < 2:
        return boxes.select(group, F.array("id").alias("chain")).filter(F.lit(False))
    named = saved(boxes.filter(F.col("label").isin(*word)).select(group, "id", "label", *_BOX).distinct(), "letters")
    found = [named.filter(F.col("label") == c).drop("label") for c in word]
    chains = found[0].select(group, F.array("id").alias("chain"), F.col("id").alias("last"))
    for left, right in zip(found, found[1:]):
        window = left.withColumns({"y1": F.col("y1") - reach, "x2": F.col("x2") + reach, "y2": F.col("y2") + reach})
        steps = contains_join(window, right, group).select(group, F.col("a_id").alias("last"), F.col("b_id").alias("next"))
        chains = chains.join(steps, [group, "last"]).select(group, F.concat("chain", F.array("next")).alias("chain"), F.col("next").alias("last"))
    return chains.drop("last")


def _representatives(rows: DataFrame, place: list[str], least: float) -> DataFrame:
    """Per place, the box of the highest overlap score of each component; ties to the larger box, then id."""
    rows = rows.withColumn("__at", F.concat_ws("/", *place))
    measured = _measured(rows, "__at")
    rows = box_components(rows, "__at", least, measured).select(*place, "component", "id", *_BOX).repartition(place[0])
    met = _met_itself(rows, [*place, "component"], measured[0]).withColumn("inter", overlap_area())
    own = [F.col(f"a_{c}").alias(c) for c in ("id", *_BOX)]
    scored = met.groupBy(*place, "component", *own).agg(F.sum("inter").alias("score"))
    best = scored.groupBy(*place, "component").agg(F.max(F.struct("score", *_BOX, "id")).alias("b"))
    return best.select(*place, F.col("b.id").alias("id"), *[F.col("b." + c).alias(c) for c in _BOX])


def merged_sequence_search(boxes: DataFrame, group: str, word: str, reach: int = 64, least: float = 0.9) -> DataFrame:
    """``sequence_search`` that reduces the boxes found at each letter to one box per component before the next.

    Components are those of the boxes within one window (``box_components``), and each gives its best box. A word of one
    letter has chains of one box. Rows with a null ``group`` go; an empty word has no chains.
    """
    found = [boxes.filter(F.col(group).isNotNull() & (F.col("label") == c)).select(group, "id", *_BOX).distinct() for c in word]
    if not found:
        return boxes.select(group, F.array("id").alias("chain")).filter(F.lit(False))
    best = saved(_representatives(found[0], [group], least), "letters")
    chains = best.select(group, F.array("id").alias("chain"), F.col("id").alias("last"))
    for right in found[1:]:
        windows = best.select(group, "id", *_BOX).distinct()
        windows = windows.withColumns({"y1": F.col("y1") - reach, "x2": F.col("x2") + reach, "y2": F.col("y2") + reach})
        inside = contains_join(windows, right, group)
        inside = inside.select(group, F.col("a_id").alias("last"), F.col("b_id").alias("id"), *[F.col("b_" + c).alias(c) for c in _BOX])
        best = saved(_representatives(inside, [group, "last"], least), "letters")
        steps = best.select(group, "last", F.col("id").alias("next"))
        chains = chains.join(steps, [group, "last"]).select(group, F.concat("chain", F.array("next")).alias("chain"), F.col("next").alias("last"))
    return chains.drop("last")


def greedy_same_label(cands: DataFrame, group: str) -> DataFrame:
    """Candidates by rising distance (ties: upper, then left, then id); one that overlaps an accepted one of its label goes.

    Conflicts are found by tiles and taken in order within group and label; those of more than COMPONENT candidates are settled as in
    ``_settled``. Ids are unique within a group and label.
    """
    small, large = _split(cands, [group, "label"])
    kept = _in_order(small, [group, "label"], F.struct("distance", "y1", "x1", "id"), lambda _, own: own.in_order())
    return kept if large is None else kept.unionByName(_greedy_in_rounds(large, group))


def _greedy_in_rounds(cands: DataFrame, group: str) -> DataFrame:
    own = cands.withColumn("__g", F.struct(group, "label"))
    own = own.withColumn("rank", F.struct("distance", "y1", "x1", "id"))
    pairs = _met_itself(own, ["__g"], None, ("rank",)).filter("a_id <> b_id")
    key = {s: F.struct(F.col(f"__g.{group}").alias("g"), F.col("__g.label").alias("label"), F.col(f"{s}_id").alias("id")) for s in "ab"}
    turn = F.struct(F.col("a_rank").alias("a"), F.col("b_rank").alias("b"))
    ranked = pairs.filter("a_rank < b_rank").select(key["a"].alias("a"), key["b"].alias("b"), key["b"].alias("loser"), turn.alias("turn"))
    lost = _settled(ranked, _unbeaten).select(F.col("loser.g").alias(group), "loser.label", "loser.id")
    return cands.join(lost, [group, "label", "id"], "left_anti").select(*cands.columns)


def drop_substring_overlaps(cands: DataFrame, group: str) -> DataFrame:
    """Of two overlapping labels, one within the other, the longer stays; of equal length the later box stays.

    Boxes are taken in the order of their sides, then labels; a box that is gone takes no other with it. Conflicts are found by
    tiles and taken in order within the group; groups of more than COMPONENT boxes are settled as in ``_settled``. Rows without a group stay.
    """
    small, large = _split(cands.filter(F.col(group).isNotNull()), [group])

    def losers(table: pa.Table, own: Boxes):
        coded = table["label"].combine_chunks().dictionary_encode()
        known, code = coded.is_valid().to_numpy(False), coded.indices.fill_null(0).to_numpy()
        labels = coded.dictionary.to_pylist() or [""]
        length = np.array([len(x) for x in labels])
        letters = np.array([sum({1 << (ord(c) & 63) for c in x}) for x in labels], np.uint64)

        def within(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Letters tell most pairs apart; the rest is looked up."""
            a, b = code[i], code[j]
            swap = length[a] > length[b]
            short, long = np.where(swap, b, a), np.where(swap, a, b)
            ok = known[i] & known[j] & ((letters[short] & ~letters[long]) == 0)
            open_ = np.flatnonzero(ok & (short != long))
            ok[open_] = [labels[s] in labels[t] for s, t in zip(short[open_].tolist(), long[open_].tolist())]
            return ok

        for i, j in own.in_order(within):
            yield i, j, length[code[i]] <= length[code[j]]

    kept = _in_order(small, [group], F.struct(*_BOX, "label", "id"), losers)
    kept = kept.unionByName(cands.filter(F.col(group).isNull()))
    return kept if large is None else kept.unionByName(_substrings_in_rounds(large, group).select(*cands.columns))


def _substrings_in_rounds(cands: DataFrame, group: str) -> DataFrame:
    met = _met_itself(cands.filter(F.col(group).isNotNull()), [group], None, ("label",)).filter("a_id <> b_id")
    place = {s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in (*_BOX, "label", "id")]) for s in "ab"}
    met = met.filter(place["a"] < place["b"]).filter(F.contains("a_label", "b_label") | F.contains("b_label", "a_label"))
    key = {s: F.struct(F.col(group).alias("g"), F.col(f"{s}_id").alias("id")) for s in "ab"}
    lesser = F.when(F.length("a_label") > F.length("b_label"), key["b"]).otherwise(key["a"])
    turn = F.struct(place["a"].alias("a"), place["b"].alias("b"))
    lost = _settled(met.select(key["a"].alias("a"), key["b"].alias("b"), lesser.alias("loser"), turn.alias("turn")), _first_of_both)
    return cands.join(lost.select(F.col("loser.g").alias(group), "loser.id"), [group, "id"], "left_anti")


def invert_index(labelled: DataFrame, label: str = "label", place: str = "doc_id") -> DataFrame:
    """``label, n, docs``: how often and in how many places each label stands."""
    return labelled.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.count_distinct(place).alias("docs"))


def pyramid(images: DataFrame, scales: tuple[float, ...] = (0.5, 0.75, 1.0)) -> DataFrame:
    """Each image (``width, height``) at each scale, its sides cut to whole points."""
    rows = images.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    return rows.withColumns({c: (F.col(c) * F.col("scale")).cast("int") for c in ("width", "height")})


def to_base_coords(boxes: DataFrame) -> DataFrame:
    """Boxes found at ``scale``, in the points of the image itself."""
    return boxes.withColumns({c: F.col(c) / F.col("scale") for c in _BOX})


def window_vector(scores: DataFrame, windows: DataFrame, group: str) -> DataFrame:
    """``group, window_id, label, score``: the best score of each label over the boxes that lie in a window.

    ``scores`` has ``group, id``, a box, ``label, score``; ``windows`` has ``group, id`` and a box. Boxes meet windows
    once, whatever the number of labels; edges count as inside; a window without a box is left out.
    """
    rects = scores.select(group, "id", *_BOX).distinct()
    inside = contains_join(windows, rects, group, tile=128).select(group, F.col("a_id").alias("window_id"), F.col("b_id").alias("id"))
    return inside.join(scores.select(group, "id", "label", "score"), [group, "id"]).groupBy(group, "window_id", "label").agg(F.max("score").alias("score"))
