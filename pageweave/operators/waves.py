"""Annotation waves: requests, responses and bookkeeping as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageweave.functions.scan import scan, sums
from pageweave.functions.scratch import saved

#: Stands for no wave while rows are joined by wave.
_NO_WAVE = -(1 << 63)
_BOX = ("x1", "y1", "x2", "y2")


def clamp(x1, y1, x2, y2, w, h) -> dict:
    """Box expressions cut to ``w`` x ``h``, each side at least 1."""
    a, b = F.greatest(F.lit(0), F.least(x1, w - 1)), F.greatest(F.lit(0), F.least(y1, h - 1))
    return {"x1": a, "y1": b, "x2": F.greatest(a + 1, F.least(x2, w)), "y2": F.greatest(b + 1, F.least(y2, h))}


def clamp_boxes(boxes: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Child boxes cut to their parent crop (``width``, ``height`` of ``regions``)."""
    j = boxes.join(regions.select(key, "width", "height"), key)
    return j.withColumns(clamp(*(F.col(c) for c in _BOX), F.col("width"), F.col("height")))


def box_quality(boxes: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """``reason`` of each box: missing, empty, outside or ok."""
    j = boxes.join(regions.select(key, "width", "height"), key)
    missing = F.expr("x1 is null or y1 is null or x2 is null or y2 is null")
    return j.withColumn(
        "reason",
        F.when(missing, "missing").when(F.expr("x2 <= x1 or y2 <= y1"), "empty").when(F.expr("x1 < 0 or y1 < 0 or x2 > width or y2 > height"), "outside").otherwise("ok"),
    )


def page_regions(responses: DataFrame, least: float = 0.05) -> DataFrame:
    """The clamped region if it covers ``least`` of the image, else the whole image."""
    w, h = F.col("width"), F.col("height")
    c = clamp(*(F.col(x) for x in _BOX), w, h)
    fits = (c["x2"] - c["x1"]) * (c["y2"] - c["y1"]) >= least * w * h
    whole = {"x1": F.lit(0), "y1": F.lit(0), "x2": w, "y2": h}
    return responses.withColumns({k: F.when(F.col("x1").isNotNull() & fits, c[k]).otherwise(whole[k]) for k in _BOX})


def claim(images: DataFrame, claims: DataFrame, processed: DataFrame, n: int) -> DataFrame:
    """The first ``n`` names that are neither claimed nor processed."""
    done = claims.select("filename").union(processed.select("filename"))
    return images.join(done, "filename", "left_anti").orderBy("filename").limit(n)


def downscale_dims(images: DataFrame, most: int) -> DataFrame:
    side = F.greatest("width", "height")
    s = F.lit(float(most)) / side
    return images.withColumns({c: F.when(side > most, (F.col(c) * s).cast("int")).otherwise(F.col(c)) for c in ("width", "height")})


# The shapes that answers must have, by level.
SCHEMAS = (
    '{"page_region":{"bbox":[int]}}',
    '{"paragraphs":[{"bbox":[int]}]}',
    '{"lines":[{"bbox":[int]}]}',
    '{"words":[{"bbox":[int]}]}',
    '{"characters":[{"bbox":[int],"char":string}]}',
)


def build_requests(regions: DataFrame, level: int) -> DataFrame:
    """``custom_id``, crop size, detail, and the message array as JSON of each open node (key columns carried typed)."""
    prompt = ["Find the page region.", "Find the paragraphs.", "Find the lines.", "Find the words.", "Find the characters."][level]
    keys = ["pi", "li", "wi"][: max(0, level - 1)]
    rows = regions.withColumn("custom_id", F.concat_ws("__", F.lit(f"w{level}"), "doc_id", *keys))
    return rows.withColumns(
        {
            "crop_w": F.col("x2") - F.col("x1"),
            "crop_h": F.col("y2") - F.col("y1"),
            "detail": F.lit("low" if level < 2 else "high"),
            "schema": F.lit(SCHEMAS[level]),
            "body": F.to_json(F.struct(F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("text")), F.struct(F.lit("user").alias("role"), F.col("custom_id").alias("text"))).alias("messages"))),
        }
    )


#: Rows of a wave that one task looks at together; at least four times the rows of a chunk.
BLOCK = 1 << 17


def _hops(upto: np.ndarray, before: int, max_rows: int, max_bytes: int) -> np.ndarray:
    """Where a chunk that begins at a row ends: the place of the next chunk's first row, as far as rows are given."""
    start = np.concatenate([[before], upto[:-1]])
    at = np.arange(len(upto))
    return np.maximum(at + 1, np.minimum(at + max_rows, np.searchsorted(upto, start + max_bytes, side="right")))


def chunk_requests(requests: DataFrame, max_rows: int = 45_000, max_bytes: int = 150 << 20) -> DataFrame:
    """``wave, seq, chunk``: greedy in order (ties by size), a new chunk where the next row would pass a limit.

    A wave of any size lies in blocks of bounded numbers of rows, with the head of the next block after them. The first chunk
    to begin in a block begins at one of its first ``max_rows`` rows; each of these is followed to the row where it enters the next
    block, and only these entries are joined by pointer doubling from block to block. Blocks then count their starts from their
    entry. A row over the limit has a chunk of its own; rows without a wave are a wave of their own; a null size counts as none.
    """
    narrow = requests.select(
        F.coalesce(F.col("wave").cast("bigint"), F.lit(_NO_WAVE)).alias("wave"), F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(F.col("nbytes").cast("bigint"), F.lit(0)).alias("nbytes"),
    )
    rows = scan(narrow, ["wave"], ["seq", "nbytes"], **sums(pos="1", upto="nbytes"), name="requests")
    size = max(BLOCK, 4 * max_rows)
    rows = rows.withColumn("block", F.expr(f"(pos - 1) div {size}"))

    def ordered(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        t = t.sort_by("pos")
        return t, t["upto"].to_numpy(), _hops(t["upto"].to_numpy(), t["upto"][0].as_py() - t["nbytes"][0].as_py(), max_rows, max_bytes)

    def entries(t: pa.Table) -> pa.Table:
        """``pos`` of each row that may be the first start of its block, the start it comes to in the next one, and its starts here."""
        t, upto, hop = ordered(t)
        first, own = t["pos"][0].as_py(), int(np.count_nonzero(~t["ahead"].to_numpy()))
        to, n = np.append(hop, len(upto)), np.append(np.ones(len(upto), np.int64), 0)
        to[own:], n[own:] = np.arange(own, len(upto) + 1), 0
        while (to[:own] < own).any():
            n, to = n + n[to], to[to]
        k = min(own, max_rows if t["block"][0].as_py() else 1)
        cells = {"wave": [t["wave"][0].as_py()] * k, "block": [t["block"][0].as_py()] * k, "pos": first + np.arange(k), "to": first + to[:k], "n": n[:k]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in cells.items()})

    def starts(t: pa.Table) -> pa.Table:
        """The chunk of each row, counted from the block's entry."""
        t, upto, hop = ordered(t)
        new, at = np.zeros(len(upto), np.int64), t["entry"][0].as_py()
        at = len(upto) if at is None else at - t["pos"][0].as_py()
        while at < len(upto):
            new[at] = 1
            at = hop[at]
        return pa.table({"wave": t["wave"], "seq": t["seq"], "chunk": np.cumsum(new) + t["chunks"][0].as_py() - 1})

    head = F.expr(f"if(block > 0 and (pos - 1) % {size} < {max_rows}, array(block, block - 1), array(block))")
    seen = rows.select("wave", "pos", "nbytes", "upto", F.posexplode(head).alias("k", "block")).withColumn("ahead", F.expr("k = 1")).drop("k")
    found = saved(seen.groupBy("wave", "block").applyInArrow(entries, "wave bigint, block bigint, pos bigint, `to` bigint, n bigint"), "entries")
    reached, hops = found.filter("block = 0").select("wave", "pos"), found.select("wave", "pos", "to")
    while True:
        further = saved(reached.join(hops, ["wave", "pos"]).select("wave", F.col("to").alias("pos")).join(found.select("wave", "pos"), ["wave", "pos"], "left_semi"), "starts")
        if further.isEmpty():
            break
        reached = reached.unionByName(further)
        nxt = hops.select("wave", F.col("pos").alias("to"), F.col("to").alias("further"))
        hops = saved(hops.join(nxt, ["wave", "to"]).select("wave", "pos", F.col("further").alias("to")), "hops")
    before = Window.partitionBy("wave").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    counted = found.join(reached.withColumn("entry", F.col("pos")), ["wave", "pos"], "left").filter(f"entry is not null or pos % {size} = 1")
    blocks = counted.groupBy("wave", "block").agg(F.max("entry").alias("entry"), F.max(F.when(F.col("entry").isNotNull(), F.col("n"))).alias("n"))
    blocks = blocks.select("wave", "block", "entry", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("chunks"))
    out = rows.join(F.broadcast(blocks), ["wave", "block"]).groupBy("wave", "block").applyInArrow(starts, "wave bigint, seq bigint, chunk bigint")
    return out.select(F.nullif("wave", F.lit(_NO_WAVE)).alias("wave"), "seq", "chunk")


def parse_responses(lines: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """``custom_id, ordinal, box, char`` of usable items; a bbox needs four numbers, which are cut to integers."""
    body = F.from_json("body", "items array<struct<bbox:array<double>,char:string>>")
    rows = lines.filter(F.trim("body") != "").select("custom_id", F.posexplode(body["items"]).alias("ordinal", "item"))
    rows = rows.filter(F.size("item.bbox") == 4).select(
        "custom_id", "ordinal", F.col("item.char").alias("ch"), *[F.get("item.bbox", k).cast("int").alias(c) for k, c in enumerate(_BOX)]
    )
    return rows if vocab is None else rows.filter(F.length("ch") == 1).join(vocab.select("ch"), "ch", "left_semi")


#: The list that an answer of a level holds (level 0: one region).
ITEMS = ("page_region", "paragraphs", "lines", "words", "characters")


def read_answers(responses: DataFrame, level: int) -> DataFrame:
    """``custom_id, items`` of each response's ``body`` (``choices``, of the first the message's ``content``, JSON again).

    ``items`` is null where the answer is unusable: no choice, or a content that is no JSON object; empty where the object
    has no list of that level.
    """
    body = F.from_json("body", "choices array<struct<message:struct<content:string>>>")
    content = F.get(body["choices"], F.lit(0))["message"]["content"]
    item, name = "struct<bbox:array<double>,char:string>", ITEMS[level]
    kind = item if level == 0 else f"array<{item}>"
    read = F.from_json("__content", f"{name} {kind}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = responses.withColumn("__content", F.trim(content)).withColumn("__read", F.when(F.col("__content").startswith("{"), read))
    rows = rows.withColumn("__read", F.when(F.col("__read._bad").isNull(), F.col("__read")))
    found = F.col(f"__read.{name}")
    found = F.when(found.isNotNull(), F.array(found)) if level == 0 else found
    none = F.array().cast(f"array<{item}>")
    return rows.withColumn("items", F.when(F.col("__read").isNotNull(), F.coalesce(found, none))).drop("__content", "__read")


def answer_items(answers: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """``custom_id, ordinal``, box and ``ch`` of what ``read_answers`` read: boxes of four numbers, and with ``vocab(ch)`` its single characters."""
    rows = answers.select("custom_id", F.posexplode("items").alias("ordinal", "item")).filter(F.size("item.bbox") == 4)
    rows = rows.select("custom_id", "ordinal", F.col("item.char").alias("ch"), *[F.get("item.bbox", k).cast("int").alias(c) for k, c in enumerate(_BOX)])
    return rows if vocab is None else rows.filter(F.length("ch") == 1).join(vocab.select("ch"), "ch", "left_semi")


def answer_counts(answers: DataFrame, by: str) -> DataFrame:
    """Answers, unusable ones (``errors``) and items kept (``stored``) by a column."""
    good = F.size(F.filter("items", lambda r: F.size(r["bbox"]) == 4))
    stored = F.sum(F.when(F.col("items").isNotNull(), good).otherwise(0))
    return answers.groupBy(by).agg(F.count("*").alias("answers"), F.count_if(F.col("items").isNull()).alias("errors"), stored.alias("stored"))


def store_cascade(cascade: DataFrame, new: DataFrame, parents: DataFrame, parent_key: list[str], key: list[str]) -> DataFrame:
    """Upsert rows whose parent exists; the new row of a key wins."""
    valid = new.join(parents.select(*parent_key).distinct(), parent_key, "left_semi")
    rows = cascade.withColumn("__new", F.lit(0)).unionByName(valid.withColumn("__new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__new"), *[c for c in new.columns if c not in key]))
    return rows.withColumn("__n", last).filter("__n = 1").drop("__n", "__new")


def last_completed_wave(batches: DataFrame) -> DataFrame:
    """``last_wave``: the largest wave all of whose batches are completed, -1 if none; ``next_wave``."""
    done = batches.groupBy("wave").agg(F.bool_and(F.col("status") == "completed").alias("ok"))
    last = F.coalesce(F.max(F.when(F.col("ok"), F.col("wave"))), F.lit(-1))
    return done.agg(last.alias("last_wave")).withColumn("next_wave", F.col("last_wave") + 1)


def assembly_status(docs: DataFrame, annotated: DataFrame) -> DataFrame:
    """Documents not annotated yet: ``empty`` where only the page row exists, ``error: …`` or ``annotated``."""
    status = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).when(F.col("nodes") <= 1, "empty").otherwise("annotated")
    return docs.join(annotated.select("doc_id"), "doc_id", "left_anti").withColumn("status", status)


def usage_rollup(usage: DataFrame, key: str, prompt_price: float = 2.5, completion_price: float = 10.0) -> DataFrame:
    cost = F.sum("prompt") * prompt_price / 1e6 + F.sum("completion") * completion_price / 1e6
    return usage.groupBy(key).agg(
        F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"),
        (F.sum("prompt") + F.sum("completion")).alias("total"), F.round(cost, 6).alias("cost"),
    )


def usage_so_far(calls: DataFrame, run: str, order: str, seconds: str) -> DataFrame:
    """Each call of a run with the tokens so far and their rate: ``prompt_sum, completion_sum, total_sum, tok_s``.

    ``seconds`` have passed since the run began; no time, no rate (0). A run of any length lies over many tasks. Calls
    without usage count nothing.
    """
    rows = calls.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("prompt", "completion")})
    out = scan(rows, [run], [order], **sums(prompt_sum="prompt", completion_sum="completion"), name="usage")
    total = F.col("prompt_sum") + F.col("completion_sum")
    return out.withColumns({"total_sum": total, "tok_s": F.when(F.col(seconds) > 0, total / F.col(seconds)).otherwise(0.0)})


def call_costs(plan: DataFrame, kind: str) -> DataFrame:
    """Pages, and average, least and most calls and cost of ``call_plan``'s pages by ``kind`` of page."""
    sides = [f(c).alias(f"{n}_{c}") for c in ("calls", "cost") for f, n in ((F.avg, "avg"), (F.min, "min"), (F.max, "max"))]
    return plan.groupBy(kind).agg(F.count("*").alias("pages"), *sides)


def level_calls(counts: DataFrame) -> DataFrame:
    """``doc_id, level, calls, detail``: one call for the page region and one for its paragraphs, then one a paragraph, line and word."""
    n = [F.lit(1), F.lit(1), F.col("paragraphs"), F.col("lines"), F.col("words")]
    rows = F.array(*[F.struct(F.lit(k).alias("level"), x.cast("bigint").alias("calls"), F.lit("low" if k < 2 else "high").alias("detail")) for k, x in enumerate(n)])
    return counts.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


def call_plan(counts: DataFrame, unit: float = 0.00322) -> DataFrame:
    """Calls of each page: 2 + paragraphs + lines + words; and their cost."""
    calls = 2 + F.col("paragraphs") + F.col("lines") + F.col("words")
    return counts.withColumn("calls", calls).withColumn("cost", F.round(F.col("calls") * unit, 6))


def budget_projection(pages: DataFrame, key: list[str], order: list[str], cost: str, budget: float, group: str) -> DataFrame:
    """Pages that a budget pays for in order, by ``group``. The running sum goes over per-part sums, then within parts."""
    part = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.withColumn("__p", F.struct(F.col(group), F.floor(F.col(key[0]) / 10_000)))
    sums = rows.groupBy("__p").agg(F.sum(cost).alias("__s"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    base = sums.select("__p", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__b"))
    run = rows.withColumn("__w", F.sum(cost).over(part)).join(base, "__p")
    return run.filter(F.round(F.col("__b") + F.col("__w"), 6) <= budget).groupBy(group).agg(F.count("*").alias("pages"))


def correction_rate(model: DataFrame, corrected: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Proposals against corrections by ordinal: kept, adjusted, added, removed."""
    a = model.select(*keys, F.struct(*_BOX).alias("a"))
    b = corrected.select(*keys, F.struct(*_BOX).alias("b"))
    j = a.join(b, keys, "full")
    return j.groupBy(group).agg(
        F.count_if(F.col("a") == F.col("b")).alias("kept"), F.count_if(F.col("a") != F.col("b")).alias("adjusted"),
        F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"),
    )


def proposals_json(dets: DataFrame, keys: list[str]) -> DataFrame:
    """Compact JSON list of ``[x1,y1,x2,y2]`` per parent, in order of ``ordinal``."""
    rows = F.sort_array(F.collect_list(F.struct("ordinal", F.array(*_BOX).alias("bbox"))))
    return dets.groupBy(*keys).agg(F.to_json(F.transform(rows, lambda r: r["bbox"])).alias("proposals"))


def contour_proposals(dets: DataFrame, keys: list[str], with_char: bool = False) -> DataFrame:
    """Compact JSON list per parent, in order of ``ordinal``: ``{"bbox", "contour_points"}`` of each detection with a ``contour``, or
    ``{"bbox", "char"}`` (``?`` where the class is no character)."""
    more = F.coalesce("ch", F.lit("?")).alias("char") if with_char else F.size("contour").alias("contour_points")
    rows = F.sort_array(F.collect_list(F.struct("ordinal", F.struct(F.array(*_BOX).alias("bbox"), more).alias("p"))))
    return dets.groupBy(*keys).agg(F.to_json(F.transform(rows, lambda r: r["p"])).alias("proposals"))


def message_table(conversations: DataFrame) -> DataFrame:
    """The messages of each conversation in order of turn, one string ``role: text`` each."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return conversations.groupBy("conv_id").agg(F.transform(rows, lambda r: F.concat(r["role"], F.lit(": "), r["text"])).alias("messages"))


def wave_stats(responses: DataFrame) -> DataFrame:
    """``wave, stored, errors`` from ``wave, usable``; a null counts as an error."""
    usable = F.coalesce("usable", F.lit(False))
    return responses.groupBy("wave").agg(F.count_if(usable).alias("stored"), F.count_if(~usable).alias("errors"))


def status_report(claims: DataFrame, cascade: DataFrame, batches: DataFrame, processed: DataFrame) -> DataFrame:
    """``item, status, n, seconds``: claimed files, cascade rows, batches of each status with the time they took, files
    of each status, and the last wave all of whose batches are completed (-1 if none)."""
    took = F.sum(F.unix_timestamp("completed") - F.unix_timestamp("created"))
    none, no_time = F.lit("all"), F.lit(None).cast("bigint")
    parts = [
        claims.agg(F.count("*").alias("n")).select(F.lit("claimed").alias("item"), none.alias("status"), "n", no_time.alias("seconds")),
        cascade.agg(F.count("*").alias("n")).select(F.lit("cascade").alias("item"), none.alias("status"), "n", no_time.alias("seconds")),
        batches.groupBy("status").agg(F.count("*").alias("n"), took.alias("seconds")).select(F.lit("batches").alias("item"), "status", "n", "seconds"),
        processed.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("files").alias("item"), "status", "n", no_time.alias("seconds")),
        last_completed_wave(batches).select(F.col("last_wave").cast("bigint").alias("n")).select(F.lit("last wave").alias("item"), none.alias("status"), "n", no_time.alias("seconds")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
