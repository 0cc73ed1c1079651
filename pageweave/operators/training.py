"""Training-set construction: item and sequence indices, teacher forcing, splits and mixtures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageweave.functions.scan import scan, sums
from pageweave.operators import geometry, hierarchy, layout


def item_index(parents: DataFrame, n: str = "n") -> DataFrame:
    """One row per item of each parent (``n`` children) plus one NONE item."""
    return parents.withColumn("item", F.explode(F.sequence(F.lit(0), F.col(n).cast("int")))).withColumn("is_none", F.col("item") == F.col(n))


def sequence_index(flat: DataFrame, with_page: bool) -> DataFrame:
    """One row per parent and level; the page level only with ``with_page``."""
    return flat.filter(F.col("level") >= (0 if with_page else 1)).filter("type <> 'word'").select("doc_id", "type", "pi", "li")


def level_index(flat: DataFrame, page_level: bool) -> DataFrame:
    """``doc_id, level, pi, li, wi``: a sequence of each level (``para``, ``line``, ``word``, ``char``) for its parent, of ``flatten``'s
    rows; with ``page_level`` also ``page``, for the page itself."""
    kinds = {"page": ["para", "page"] if page_level else ["para"], "paragraph": ["line"], "line": ["word"], "word": ["char"]}
    levels = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return flat.select("doc_id", F.explode(F.try_element_at(levels, F.col("type"))).alias("level"), "pi", "li", "wi")


def teacher_forcing(steps: DataFrame, parent: list[str], order: str, target: str) -> DataFrame:
    """``prev``: the previous target in order, 0 (NONE) for the first."""
    w = Window.partitionBy(*parent).orderBy(order)
    return steps.withColumn("prev", F.lag(target, 1, 0).over(w))


def build_sequences(steps: DataFrame, parent: list[str], order: str, most: int) -> DataFrame:
    """``prev`` = NONE + steps and ``target`` = steps + NONE, both cut to ``most``; ``x0, y0`` of the first step or 0."""
    got = steps.groupBy(*parent).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "class_id", "x1", "y1"))).alias("s"))
    ids = F.col("s")["class_id"].cast("array<int>")
    none = F.array(F.lit(0))
    first = F.get(F.filter("s", lambda r: r["class_id"] != 0), F.lit(0))
    return got.withColumns(
        {
            "prev": F.slice(F.concat(none, ids), 1, most),
            "target": F.slice(F.concat(ids, none), 1, most),
            "x0": F.coalesce(first["x1"], F.lit(0)),
            "y0": F.coalesce(first["y1"], F.lit(0)),
        }
    ).drop("s")


def batched(rows: DataFrame, seq: str, batch: int) -> DataFrame:
    """``batch`` by ``seq``; rows that have theirs already, maybe dealt by it, keep it."""
    return rows if "batch" in rows.columns else rows.withColumn("batch", F.floor(F.col(seq) / batch))


def pad_batch(sequences: DataFrame, seq: str, batch: int) -> DataFrame:
    """Targets of a batch padded with 0 to its longest; ``padding`` counts the padded places."""
    rows = batched(sequences, seq, batch)
    longest = F.max(F.size("target")).over(Window.partitionBy("batch"))
    rows = rows.withColumn("padding", longest - F.size("target"))
    return rows.withColumn("target", F.concat("target", F.array_repeat(F.lit(0), F.col("padding"))))


#: A step of a contour and a box as vectors, and their NONE.
STEP = {"x": "double", "y": "double", "dx": "double", "dy": "double", "class_id": "int"}
ITEM = {"x1": "int", "y1": "int", "x2": "int", "y2": "int", "class_id": "int", "is_handwritten": "int"}


def _none(kind: dict[str, str]) -> Column:
    return F.struct(*[F.lit(0).cast(t).alias(c) for c, t in kind.items()])


def _collected(children: DataFrame, parents: DataFrame, parent: list[str], order: str, kind: dict[str, str]) -> DataFrame:
    """Each parent with its children's vectors in order; none for a parent without children."""
    vector = F.struct(*[F.col(c).cast(t).alias(c) for c, t in kind.items()])
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), vector.alias("v"))))
    lists = children.groupBy(*parent).agg(rows["v"].alias("s"))
    none = F.array().cast(lists.schema["s"].dataType)
    return parents.select(*parent).distinct().join(lists, parent, "left").withColumn("s", F.coalesce("s", none))


def teacher_forced_items(items: DataFrame, parents: DataFrame, parent: list[str], order: str) -> DataFrame:
    """``item`` (0 to n), ``prev`` and ``target`` of each parent's n items as vectors: box in the retina, class and handwriting.

    Item k is told its predecessor and asked for itself; the first is told NONE (zeros), and after the last NONE is asked
    for. A parent without items has that one row.
    """
    got = _collected(items, parents, parent, order, ITEM)
    none = F.array(_none(ITEM))
    rows = got.select(*parent, F.arrays_zip(F.concat(none, "s").alias("prev"), F.concat("s", none).alias("target")).alias("z"))
    return rows.select(*parent, F.posexplode("z").alias("item", "v")).select(*parent, "item", "v.prev", "v.target")


def contour_sequences(steps: DataFrame, parents: DataFrame, parent: list[str], order: str, most: int) -> DataFrame:
    """``prev, target, x0, y0, n`` of each parent: its steps (point, direction, class) after NONE and before it, cut to ``most``.

    ``x0, y0`` is the first step of the cut target with a class, 0 if none has one; ``n`` the length.
    """
    got = _collected(steps, parents, parent, order, STEP)
    none = F.array(_none(STEP))
    cut = got.select(*parent, F.slice(F.concat(none, "s"), 1, most).alias("prev"), F.slice(F.concat("s", none), 1, most).alias("target"))
    first = F.get(F.filter("target", lambda r: r["class_id"] != 0), F.lit(0))
    zero = F.lit(0.0)
    return cut.withColumns({"x0": F.coalesce(first["x"], zero), "y0": F.coalesce(first["y"], zero), "n": F.size("target")})


def pad_sequences(sequences: DataFrame, seq: str, batch: int) -> DataFrame:
    """``batch`` by ``seq``; ``prev`` and ``target`` padded with zeros to the batch's longest, ``mask`` true where padded."""
    longest = F.max("n").over(Window.partitionBy("batch"))
    rows = batched(sequences, seq, batch).withColumn("__more", longest - F.col("n"))
    filled = {c: F.concat(c, F.array_repeat(_none(STEP), F.col("__more"))) for c in ("prev", "target")}
    mask = F.concat(F.array_repeat(F.lit(False), F.col("n")), F.array_repeat(F.lit(True), F.col("__more")))
    return rows.withColumns(filled | {"mask": mask}).drop("__more")


def normalised(step: Column, side: float = 1024.0, classes: int = 460) -> Column:
    """A step with its point over the retina's side and its class over their number; the direction stays."""
    return F.struct(
        (step["x"] / side).alias("x"), (step["y"] / side).alias("y"), step["dx"].alias("dx"), step["dy"].alias("dy"), (step["class_id"] / F.lit(float(classes))).alias("class_id")
    )


def normalise_steps(sequences: DataFrame, side: float = 1024.0, classes: int = 460) -> DataFrame:
    """``prev`` with each of its steps ``normalised``."""
    return sequences.withColumn("prev", F.transform("prev", lambda r: normalised(r, side, classes)))


def parent_local(children: DataFrame, parent: list[str]) -> DataFrame:
    """Children's boxes in the retina of the box that their parent's children span.

    Children without a value in a ``parent`` column go, as they have no parent.
    """
    parents = layout.rollup_boxes(children, parent)
    frames = geometry.retina_frame(parents).select(*parent, "scale", "ox", "oy")
    return geometry.to_retina(hierarchy.local_boxes(children, parents, parent).join(frames, parent))


def split_train_val(df: DataFrame, key: str, share: float, seed: int, least: int = 1) -> DataFrame:
    """``split``: exactly ``max(least, int(n * share))`` rows are ``val``, the least by md5 of seed and key.

    The cut comes from counts by the first hexadecimal digits, so only the rows of one such group are ranked.
    """
    rows = df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))).withColumn("__p", F.substring("__h", 1, 3))
    counts = rows.groupBy("__p").agg(F.count("*").alias("__c"))  # at most 4096 rows
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    base = counts.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__b"), F.sum("__c").over(everything).alias("__n"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("__h", key))
    wanted = F.greatest(F.lit(least), (F.col("__n") * share).cast("int"))
    j = rows.withColumn("__r", rank).join(F.broadcast(base), "__p")
    return j.withColumn("split", F.when(F.col("__b") + F.col("__r") <= wanted, "val").otherwise("train")).drop("__h", "__p", "__r", "__b", "__n")


def mix_sources(df: DataFrame, source: str, shares: dict[str, float]) -> DataFrame:
    """``weight`` of a row: its source's share over the source's number of rows."""
    counts = df.groupBy(source).agg(F.count("*").alias("__n"))  # one row per source
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    return df.join(counts, source).withColumn("weight", F.try_element_at(share, F.col(source)) / F.col("__n")).drop("__n")


def draw_with_replacement(weighted: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``id`` (0 to n - 1) and the ``key`` drawn for it, by weight: the same under any partitioning and order of rows.

    Weights become whole units (about 2^51 in all, so a weight is exact to that share), running sums of which are ranges; a
    draw's place is the hash of seed and number. Rows and draws meet in one ordered pass over range partitions. Rows
    without a positive weight are never drawn; without any there are no draws.
    """
    rows = weighted.select(key, F.col("weight").cast("double").alias("weight")).filter("weight > 0")
    total = rows.agg(F.sum("weight").alias("t")).first()["t"]
    spark = weighted.sparkSession
    if not total:
        return spark.createDataFrame([], f"id bigint, {key} {dict(weighted.dtypes)[key]}")
    scale = 2.0 ** (51 - math.ceil(math.log2(total)))  # a power of two, so that products are exact
    units = rows.withColumn("units", (F.col("weight") * scale).cast("bigint")).filter("units > 0")
    units = scan(units, [], [key, "weight"], **sums(upto="units", place="1"), name="ranges")
    whole = units.agg(F.max("upto").alias("whole"))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 13), 16, 10)
    draws = spark.range(n).withColumn("h", hashed.cast("bigint")).crossJoin(F.broadcast(whole))  # one row
    at = F.expr("cast(cast(h as decimal(18, 0)) * cast(whole as decimal(18, 0)) div 4503599627370496 as bigint)")
    asks = draws.select(at.alias("v"), F.lit(1).alias("kind"), F.lit(0).alias("one"), "id")
    starts = units.select((F.col("upto") - F.col("units")).alias("v"), F.lit(0).alias("kind"), F.lit(1).alias("one"), F.lit(None).cast("bigint").alias("id"))
    met = scan(asks.unionByName(starts), [], ["v", "kind"], **sums(place="one"), name="draws", keep=["kind", "id"])
    return met.filter("kind = 1").select("id", "place").join(units.select("place", key), "place").select("id", key)


def detect_none_pairs(samples: DataFrame, label: str) -> DataFrame:
    """Two samples per item: NONE to the item, and the item to NONE."""
    pair = F.array(F.struct(F.lit(0).alias("prev"), F.col(label).alias("next")), F.struct(F.col(label).alias("prev"), F.lit(0).alias("next")))
    return samples.withColumn("p", F.explode(pair)).select(*[c for c in samples.columns if c != label], "p.prev", "p.next")


def annotation_status(pages: DataFrame, annotated: DataFrame, key: str, kind: str) -> DataFrame:
    """Pages, annotated and remaining ones by ``kind``."""
    done = annotated.select(key).distinct().withColumn("__done", F.lit(True))
    rows = pages.join(done, key, "left")
    had = F.count_if(F.coalesce("__done", F.lit(False)))
    return rows.groupBy(kind).agg(F.count("*").alias("pages"), had.alias("annotated"), (F.count("*") - had).alias("remaining"))


def concat_sources(synthetic: DataFrame, real: DataFrame) -> DataFrame:
    return synthetic.withColumn("origin", F.lit("synthetic")).unionByName(real.withColumn("origin", F.lit("real")), allowMissingColumns=True)


def normalise_prev(sequences: DataFrame, classes: int = 460) -> DataFrame:
    return sequences.withColumn("prev", F.transform("prev", lambda c: c / F.lit(float(classes))))
