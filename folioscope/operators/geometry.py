"""Generated against approved boxes: matches, deltas, biases, page diagnostics, reading order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.columns import area_band, iou, rate, resize_diag
from folioscope.operators.ordered import exact_medians
from folioscope.storage import dealt, shared_table

MATCH, OVERLAP = 0.5, 0.2
#: Boxes of both sides on a page up to which all of them are compared.
CROWDED = 256
TARGET = (0.95, 0.99)
#: A page within a review; ``page_key`` is the page's name, or a mark for a missing one, and never null.
PAGE = ("review_id", "stratum", "page_key")
KEYS = (*PAGE, "page_scope")


def paged(boxes: DataFrame) -> DataFrame:
    """``boxes`` with their ``page_key``. A missing page is one page of its own, so that it matches a missing page and no other."""
    if "page_key" in boxes.columns:
        return boxes
    return boxes.withColumn("page_key", F.coalesce(F.col("page_scope").cast("string"), F.lit("\0")))


def _crowds(boxes: DataFrame, crowded: int = 0, rows: int = 0) -> DataFrame:
    """The pages with more than ``crowded`` boxes, stored: they are few, and Spark sees how few before it plans the joins with them."""
    return shared_table(dealt(boxes.select(*PAGE), rows, *PAGE).groupBy(*PAGE).agg(F.count("*").alias("_boxes")).where(F.col("_boxes") > crowded), "crowds")


def _level(size: Column) -> Column:
    return F.floor(F.log2(size)).cast("int")


def _centre_cell(start: Column, size: Column) -> Column:
    """Level of a box's width (or height), and the cell of that level in which its centre lies; a cell is up to twice as wide as the box."""
    return F.concat_ws(":", _level(size), F.floor((start + size / 2) / F.pow(F.lit(2.0), _level(size) + 1)))


def _cells(start: Column, size: Column, least: float) -> Column:
    """All cells in which the centre of a box can lie whose IoU with this one reaches ``least``.

    The IoU is at most the smaller width over the larger one, which leaves a few levels; and at most what the boxes share of the
    larger width, which bounds how far their centres are apart.
    """
    reach = math.ceil(math.log2(1 / least))

    def at(step: Column) -> Column:
        level = _level(size) + step
        cell = F.pow(F.lit(2.0), level + 1)
        far = ((size + cell) / 2 - least * F.greatest(size, cell / 2)) * (1 + 1e-9) + 1e-12
        first, last = (F.floor((start + size / 2 + sign * far) / cell) for sign in (-1, 1))
        return F.transform(F.sequence(first, last), lambda i: F.concat_ws(":", level, i))

    return F.flatten(F.transform(F.array(*map(F.lit, range(-reach, reach + 1))), at))


def _celled(boxes: DataFrame, crowds: DataFrame, crowded: int, least: float | None) -> DataFrame:
    """``boxes`` with the cells of a crowded page in which they are compared; other pages have one cell.

    With ``least`` a box stands in every cell that a partner's centre can lie in, else in its own centre's. A box without an extent
    reaches no IoU and drops out of a crowded page.
    """
    told = boxes.join(crowds, list(PAGE), "left")
    x, y, w, h = (F.col(c) for c in "xywh")
    busy = F.coalesce("_boxes", F.lit(0)) > crowded
    solid = (w > 0) & (h > 0)
    if least is None:
        mine = F.array(F.concat_ws("/", _centre_cell(x, w), _centre_cell(y, h)))
    else:
        mine = F.flatten(F.transform(_cells(x, w, least), lambda a: F.transform(_cells(y, h, least), lambda b: F.concat_ws("/", a, b))))
    return told.withColumn("_cell", F.explode(F.when(~busy, F.array(F.lit(""))).when(solid, mine))).drop("_boxes")


def matches(generated: DataFrame, approved: DataFrame, least: float = MATCH, crowded: int = CROWDED) -> DataFrame:
    """All pairs of a generated and a kept approved box on the same page and stratum whose IoU reaches ``least``.

    The page is part of the join key (a missing page equals a missing page), so the work is the product of
    the boxes within a page, never within a review; the IoU is what is left to test. On a page with more than ``crowded`` boxes the
    key has a cell as well: a generated box stands in its centre's, an approved one in all that a partner's centre can lie in, so a pair meets
    once and only boxes that are near and alike in size meet at all.
    """
    generated, approved = paged(generated), paged(approved.where("not deleted"))
    rows = generated.count() + approved.count()
    crowds = _crowds(generated.select(*PAGE).unionByName(approved.select(*PAGE)), crowded, rows)
    generated, approved = _celled(generated, crowds, crowded, None), _celled(approved, crowds, crowded, least)
    g = generated.select(*PAGE, "_cell", *[F.col(c).alias(f"g{c}") for c in "xywh"], F.col("box_id").alias("gen_id"), F.col("ord").alias("gen_ord"))
    a = approved.select(*KEYS, "_cell", *[F.col(c).alias(f"a{c}") for c in "xywh"], F.col("box_id").alias("app_id"), F.col("ord").alias("app_ord"))
    score = iou(*[F.col(f"{side}{c}") for side in "ga" for c in "xywh"])
    place = [*PAGE, "_cell"]
    pairs = dealt(g, rows, *place).join(dealt(a, rows, *place), place).withColumn("iou", score).where(F.col("iou") >= least)
    return pairs.select(*KEYS, "gen_id", "app_id", "gen_ord", "app_ord", *[f"{side}{c}" for side in "ga" for c in "xywh"], "iou")


def best_matches(pairs: DataFrame) -> DataFrame:
    """For each approved box the match of highest IoU, ties to the smaller generated id. ``pairs`` are stored, and counted first."""
    order = Window.partitionBy(*KEYS, "app_id").orderBy(F.desc("iou"), "gen_id")
    return dealt(pairs, pairs.count(), *PAGE).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _sides(generated: DataFrame, approved: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each box with its number of matches."""
    keys, found = [*PAGE, "box_id"], pairs.count()

    def hit(boxes: DataFrame, box: str) -> DataFrame:
        rows = max(found, boxes.count())
        hits = dealt(pairs.select(*PAGE, F.col(box).alias("box_id")), rows, *keys).groupBy(*keys).agg(F.count("*").alias("hits"))
        return dealt(boxes.select(*keys, "page_scope", "w", "h"), rows, *keys).join(hits, keys, "left").fillna(0, ["hits"])

    return hit(paged(generated), "gen_id"), hit(paged(approved.where("not deleted")), "app_id")


def marked(pairs: DataFrame) -> DataFrame:
    """Pairs with their boxes' numbers of matches (``g_hits``, ``a_hits``), marks that count each box once, and the best pairs.

    ``g_first`` and ``a_first`` stand on one pair of each box, ``best`` on the best pair of an approved one, ``credited`` on one pair of a generated box that has
    any best pair. Pairs are stored, and dealt by page once; all windows stay within that.
    """
    gen, app = Window.partitionBy(*PAGE, "gen_id"), Window.partitionBy(*PAGE, "app_id")
    rows = dealt(pairs.select(*PAGE, "gen_id", "app_id", "iou"), pairs.count(), *PAGE)
    rows = rows.withColumns({"g_hits": F.count("*").over(gen), "a_hits": F.count("*").over(app), "best": F.row_number().over(app.orderBy(F.desc("iou"), "gen_id")) == 1})
    rows = rows.withColumns({"g_first": F.row_number().over(gen.orderBy(F.desc("best"), "app_id")) == 1, "a_first": F.col("best")})
    return rows.withColumn("credited", F.col("g_first") & F.col("best"))


def _matched(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of matched boxes by ``keys``, summed where the marks lie."""
    c = F.col
    return marks.groupBy(*keys).agg(
        F.count_if("g_first").alias("matched_generated"), F.count_if(c("g_first") & (c("g_hits") > 1)).alias("merged"), F.count_if("a_first").alias("matched_approved"), F.count_if(c("a_first") & (c("a_hits") > 1)).alias("split"),
        F.count_if((c("g_hits") == 1) & (c("a_hits") == 1)).alias("unchanged"), F.count_if("credited").alias("credited"), F.sum(F.when(c("best"), c("iou"))).alias("earned"),
    )


def geometry_delta(generated: DataFrame, approved: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per review and stratum, and over all strata (``total``): counts and ratios of matched boxes.

    Earned credit is the sum of best IoUs, rounded by stratum before strata are added. Every ratio has the
    counts beside it, so that higher levels can be re-added. Boxes are only counted, and pairs counted where they lie; what is joined is
    one row per review and stratum.
    """
    keys = ["review_id", "stratum"]
    found = _matched(marked(pairs), keys).withColumn("earned", F.bround("earned", 6))
    pages = dealt(paged(generated).select(*PAGE), generated.count(), *PAGE).groupBy(*PAGE).agg(F.count("*").alias("n"))
    g_part = pages.groupBy(*keys).agg(F.sum("n").alias("generated"), F.count("*").alias("pages"))
    a_part = approved.where("not deleted").groupBy(*keys).agg(F.count("*").alias("approved"))
    joined = g_part.join(a_part, keys, "full_outer").join(found, keys, "left")
    counts = ("generated", "matched_generated", "merged", "false_panels", "pages", "approved", "matched_approved", "split", "missing", "unchanged", "credited")
    filled = joined.fillna(0, [n for n in counts if n not in ("false_panels", "missing")]).fillna(0.0, ["earned"])
    filled = filled.withColumns({"false_panels": F.col("generated") - F.col("matched_generated"), "missing": F.col("approved") - F.col("matched_approved")})
    both = filled.groupingSets([["review_id", "stratum"], ["review_id"]], "review_id", "stratum").agg(*[F.sum(c).alias(c) for c in (*counts, "earned")])
    out = both.withColumn("stratum", F.coalesce("stratum", F.lit("total")))
    c = F.col
    corrections = c("false_panels") + c("missing") + c("split") + c("merged")
    return out.select(
        "review_id", "stratum", "generated", "approved", rate(c("matched_generated"), c("generated")).alias("precision"), rate(c("matched_approved"), c("approved")).alias("recall"),
        rate(c("split"), c("approved")).alias("split_rate"), rate(c("merged"), c("generated")).alias("merge_rate"), rate(c("false_panels"), c("generated")).alias("false_rate"),
        rate(c("missing"), c("approved")).alias("missing_rate"), rate(c("unchanged"), c("approved")).alias("unchanged_geometry_rate"),
        corrections.alias("corrections"), rate(corrections, c("pages")).alias("corrections_per_page"), "earned", "credited", "pages",
    )


def corrections_per_page(delta: DataFrame, pages: DataFrame) -> DataFrame:
    """Per review: corrections over its story pages, else all its pages, else the distinct pages of its generated boxes.

    ``delta`` is ``geometry_delta``'s, ``pages`` has (review_id, total_story_pages, total_pages), of which either may be null or 0. Which
    number was taken is said in ``page_basis``.
    """
    known = lambda c: F.when(F.col(c) > 0, F.col(c))
    rows = delta.where("stratum = 'total'").join(pages, "review_id", "left")
    taken = F.coalesce(known("total_story_pages"), known("total_pages"), F.col("pages"))
    basis = F.when(known("total_story_pages").isNotNull(), "story_pages").when(known("total_pages").isNotNull(), "total_pages").otherwise("generated_pages")
    return rows.select("review_id", "corrections", taken.alias("pages"), basis.alias("page_basis"), rate(F.col("corrections"), taken).alias("corrections_per_page"))


def segmentation_accuracy(delta: DataFrame) -> DataFrame:
    """Earned credit over approved boxes plus generated ones that earned none, and whether it reaches the target band."""
    whole = F.col("approved") + F.col("generated") - F.col("credited")
    value = F.when(whole != 0, F.bround(F.col("earned") / whole, 6)).otherwise(0.0)
    return delta.select(
        "review_id", "stratum", F.bround("earned", 6).alias("earned"), whole.alias("possible"), value.alias("accuracy"),
        F.when(value >= TARGET[1], "above").when(value >= TARGET[0], "within").otherwise("below").alias("target"),
    )


def resize_diagnostics(best: DataFrame) -> DataFrame:
    """Best pairs with how the generated box differs from the approved one: area ratio, offsets, width and height errors."""
    return best.withColumns(resize_diag(*[F.col(f"{side}{c}") for side in "ga" for c in "xywh"]))


def resize_bias(best: DataFrame) -> DataFrame:
    """Mean and median of area ratio, width error and height error over best pairs, by review."""
    names = ("area_ratio", "dw_pct", "dh_pct")
    rows = shared_table(resize_diagnostics(best).select("review_id", *names), "resized")
    means = rows.groupBy("review_id").agg(F.count("*").alias("pairs"), *[F.bround(F.avg(c), 6).alias(f"mean_{c}") for c in names])
    long = rows.select("review_id", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])))
    medians = exact_medians(long, ["review_id", "name"], "value").groupBy("review_id").agg(*[F.bround(F.max(F.when(F.col("name") == c, F.col("median"))), 6).alias(f"median_{c}") for c in names])
    order = [f"{kind}_{c}" for c in names for kind in ("mean", "median")]
    return means.join(medians, "review_id", "left").select("review_id", "pairs", *order)


def page_overlaps(generated: DataFrame, least: float = OVERLAP, crowded: int = CROWDED) -> DataFrame:
    """Pairs of generated boxes on one page that overlap each other, found as ``matches`` finds its pairs."""
    boxes = paged(generated)
    rows = boxes.count()
    crowds = _crowds(boxes, crowded, rows)
    side = lambda p, reach: _celled(boxes, crowds, crowded, reach).select(*PAGE, "_cell", *[F.col(c).alias(f"{p}_{c}") for c in ("page_scope", "box_id", "x", "y", "w", "h")])
    score = iou(*[F.col(f"{p}_{c}") for p in "ab" for c in "xywh"])
    place = [*PAGE, "_cell"]
    pairs = dealt(side("a", None), rows, *place).join(dealt(side("b", least), rows, *place), place).where((F.col("a_box_id") < F.col("b_box_id")) & (score >= least))
    return pairs.select("review_id", F.col("a_page_scope").alias("page_scope"), F.col("a_box_id").alias("first_id"), F.col("b_box_id").alias("second_id"), F.bround(score, 6).alias("iou"), "page_key")


def _agreeing(best: DataFrame) -> DataFrame:
    """Per page the pairs of matches in the same and in the opposite order on both sides.

    Two places on the generated side part at one bit of their ranks. So for each bit the matches that agree in all higher ones are a group, and one with the bit
    set counts those without it that come earlier, or later, on the approved side. A page of n matches takes n log n steps instead of all
    pairs. Ties on either side, and matches without a place, count for nothing.
    """
    rank = lambda c: F.dense_rank().over(Window.partitionBy(*PAGE).orderBy(c)) - 1
    placed = best.where("gen_ord is not null and app_ord is not null").select(*PAGE, rank("gen_ord").alias("g"), rank("app_ord").alias("a"))
    most = F.max("g").over(Window.partitionBy(*PAGE))
    bits = placed.withColumn("most", most).where("most > 0").select(*PAGE, "g", "a", F.explode(F.sequence(F.lit(0), F.length(F.bin("most")) - 1)).alias("bit"))
    bits = bits.withColumns({"above": F.call_function("shiftright", F.col("g"), F.col("bit") + 1), "set": F.call_function("shiftright", F.col("g"), F.col("bit")) % 2})
    group = Window.partitionBy(*PAGE, "bit", "above").orderBy("a")
    unset = F.count_if(F.col("set") == 0)
    counted = bits.withColumns({"earlier": unset.over(group.rangeBetween(Window.unboundedPreceding, -1)), "later": unset.over(group.rangeBetween(1, Window.unboundedFollowing))})
    return counted.where("set = 1").groupBy(*PAGE).agg(F.sum("earlier").alias("concordant"), F.sum("later").alias("discordant"))


def reading_order(best: DataFrame) -> DataFrame:
    """Per page: pairs of best matches in the same or the opposite order, ties left out, and their agreement (1.0 if none)."""
    pages = best.select(*KEYS).distinct().join(_agreeing(best), list(PAGE), "left").fillna(0, ["concordant", "discordant"])
    pages = pages.groupBy("review_id", "page_scope", "page_key").agg(F.sum("concordant").alias("concordant"), F.sum("discordant").alias("discordant"))
    return pages.withColumn("agreement", rate(F.col("concordant"), F.col("concordant") + F.col("discordant"), 1.0))


def panel_size_recall(generated: DataFrame, approved: DataFrame, pairs: DataFrame) -> DataFrame:
    """Recall of approved boxes by size band and review."""
    _, a = _sides(generated, approved, pairs)
    grouped = a.withColumn("size_band", area_band(F.col("w") * F.col("h"))).groupBy("review_id", "size_band")
    return grouped.agg(F.count("*").alias("approved"), F.count_if(F.col("hits") > 0).alias("matched")).withColumn("recall", rate(F.col("matched"), F.col("approved")))


def page_diagnostics(generated: DataFrame, approved: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per page: boxes on both sides, recall, overlaps, order agreement, false, missing and deleted boxes."""
    keys = ["review_id", "page_key"]
    found = _matched(marked(pairs), keys).select(*keys, "matched_generated", F.col("matched_approved").alias("matched"))
    sides = paged(generated).select(*keys, F.lit(1).alias("g"), F.lit(0).alias("a"), F.lit(0).alias("d")).unionByName(
        paged(approved).select(*keys, F.lit(0).alias("g"), F.when(F.col("deleted"), 0).otherwise(1).alias("a"), F.when(F.col("deleted"), 1).otherwise(0).alias("d"))
    )
    boxes = dealt(sides, sides.count(), *keys).groupBy(*keys).agg(F.sum("g").alias("generated"), F.sum("a").alias("approved"), F.sum("d").alias("deleted")).where("generated > 0 or approved > 0")
    overlaps = page_overlaps(generated).groupBy(*keys).agg(F.count("*").alias("overlap_pairs"))
    order = reading_order(best_matches(pairs)).select(*keys, "agreement")
    out = boxes.join(found, keys, "left").join(overlaps, keys, "left").join(order, keys, "left").fillna(0, ["matched_generated", "matched", "overlap_pairs"]).fillna(1.0, ["agreement"])
    counted = out.withColumns({"false_panels": F.col("generated") - F.col("matched_generated"), "missing": F.col("approved") - F.col("matched")})
    return counted.withColumn("recall", rate(F.col("matched"), F.col("approved"))).withColumn("page_scope", F.nullif(F.col("page_key"), F.lit("\0"))).drop("page_key", "matched_generated")


def correction_ledger(generated: DataFrame, approved: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per correction of a box: false, missing (on a page or a spread), split, merge."""
    g, a = _sides(generated, approved, pairs)
    g_rows = g.withColumn("operation", F.when(F.col("hits") == 0, "false_panel").when(F.col("hits") > 1, "panel_merge"))
    a_rows = a.withColumn("operation", F.when(F.col("hits") > 1, "panel_split").when((F.col("hits") == 0) & (F.col("stratum") == "spread"), "spread_missing_panel").when(F.col("hits") == 0, "missing_panel"))
    return g_rows.unionByName(a_rows).where("operation is not null").select("review_id", "operation", "page_scope", "box_id", "hits")
