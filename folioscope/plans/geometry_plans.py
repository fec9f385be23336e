"""Queries of the geometry operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import geometry as G
from folioscope.plans import views as V
from folioscope.storage import shared_table


def _all(spark, d):
    generated, approved = V.boxes(spark, d)
    return G.paged(generated), G.paged(approved), G.matches(generated, approved)


def _stored(spark, d):
    """The same with the pairs written once, for operators that use them several times."""
    generated, approved, pairs = _all(spark, d)
    return generated, approved, shared_table(pairs, "matches")


def iou_matches(spark, d):
    return _all(spark, d)[2].select("review_id", "stratum", "page_scope", "gen_id", "app_id", F.bround("iou", 6).alias("iou"))


def best_match(spark, d):
    return G.best_matches(_stored(spark, d)[2]).select("review_id", "page_scope", "app_id", "gen_id", F.bround("iou", 6).alias("iou"))


def geometry_delta(spark, d):
    return G.geometry_delta(*_stored(spark, d)).drop("earned", "credited", "pages")


def corrections_per_page(spark, d):
    """Reviews (parts) that tell their story pages, all their pages, or neither."""
    delta = G.geometry_delta(*_stored(spark, d))
    r = F.col("review_id")
    pages = delta.where("stratum = 'total'").select("review_id", F.when(r % 3 == 0, r % 7).alias("total_story_pages"), F.when(r % 2 == 0, r % 5 + 1).alias("total_pages"))
    return G.corrections_per_page(delta, pages)


def segmentation_accuracy(spark, d):
    return G.segmentation_accuracy(G.geometry_delta(*_stored(spark, d)))


def resize_bias(spark, d):
    return G.resize_bias(G.best_matches(_stored(spark, d)[2]))


def resize_diag(spark, d):
    return G.resize_diagnostics(G.best_matches(_stored(spark, d)[2])).select("review_id", "page_scope", "app_id", "gen_id", "area_ratio", "dx", "dy", "dw_pct", "dh_pct")


def page_overlap(spark, d):
    return G.page_overlaps(V.boxes(spark, d)[0]).drop("page_key")


def reading_order(spark, d):
    return G.reading_order(G.best_matches(_stored(spark, d)[2])).drop("page_key")


def panel_size_recall(spark, d):
    return G.panel_size_recall(*_stored(spark, d))


def page_diagnostics(spark, d):
    return G.page_diagnostics(*_stored(spark, d)).withColumn("page_scope", F.col("page_scope").cast("long"))


def box_corrections(spark, d):
    return G.correction_ledger(*_stored(spark, d))


QUERIES = [iou_matches, best_match, geometry_delta, corrections_per_page, segmentation_accuracy, resize_diag, resize_bias, page_overlap, reading_order, panel_size_recall, page_diagnostics, box_corrections]

SIDES = V.BOXES + """,
best as (select * from (select *, row_number() over (partition by review_id, stratum, page_scope, app_id order by iou desc, gen_id) k from matches) where k = 1),
g as (select review_id, stratum, page_scope, box_id, (select count(*) from matches m where m.page_scope = g.page_scope and m.gen_id = g.box_id) hits from generated g),
a as (select review_id, stratum, page_scope, box_id, cast(w as double) w, cast(h as double) h, (select count(*) from matches m where m.page_scope = a.page_scope and m.app_id = a.box_id) hits from approved a where not deleted),
parts as (
  select coalesce(x.review_id, y.review_id) review_id, coalesce(x.stratum, y.stratum) stratum, coalesce(generated, 0) generated, coalesce(mg, 0) mg, coalesce(merged, 0) merged, coalesce(fp, 0) fp, coalesce(pages, 0) pages,
         coalesce(approved, 0) approved, coalesce(ma, 0) ma, coalesce(split, 0) split, coalesce(missing, 0) missing
  from (select review_id, stratum, count(*) generated, count(*) filter (where hits > 0) mg, count(*) filter (where hits > 1) merged, count(*) filter (where hits = 0) fp, count(distinct page_scope) pages from g group by 1, 2) x
  full join (select review_id, stratum, count(*) approved, count(*) filter (where hits > 0) ma, count(*) filter (where hits > 1) split, count(*) filter (where hits = 0) missing from a group by 1, 2) y on x.review_id = y.review_id and x.stratum = y.stratum),
full_parts as (
  select p.*, coalesce(unchanged, 0) unchanged, coalesce(earned, 0.0) earned, coalesce(credited, 0) credited from parts p
  left join (select review_id, stratum, count(*) unchanged from matches m where (select count(*) from matches n where n.page_scope = m.page_scope and n.gen_id = m.gen_id) = 1 and (select count(*) from matches n where n.page_scope = m.page_scope and n.app_id = m.app_id) = 1 group by 1, 2) u using (review_id, stratum)
  left join (select review_id, stratum, round_even(sum(iou), 6) earned, count(distinct (page_scope, gen_id)) credited from best group by 1, 2) e using (review_id, stratum)),
summed as (
  select review_id, coalesce(stratum, 'total') stratum, cast(sum(generated) as bigint) generated, cast(sum(mg) as bigint) mg, cast(sum(merged) as bigint) merged, cast(sum(fp) as bigint) fp, cast(sum(pages) as bigint) pages, cast(sum(approved) as bigint) approved, cast(sum(ma) as bigint) ma,
         cast(sum(split) as bigint) split, cast(sum(missing) as bigint) missing, cast(sum(unchanged) as bigint) unchanged, sum(earned) earned, cast(sum(credited) as bigint) credited
  from full_parts group by grouping sets ((review_id, stratum), (review_id)))
"""
_R = lambda n, d: f"coalesce(round_even(cast({n} as double) / nullif({d}, 0), 6), 0.0)"
_ORDERED = f"""select p.review_id, p.page_scope, coalesce(concordant, 0) concordant, coalesce(discordant, 0) discordant,
  coalesce(round_even(cast(concordant as double) / nullif(concordant + discordant, 0), 6), 1.0) agreement
from (select distinct review_id, page_scope from best) p left join (
  select x.review_id, x.page_scope, count(*) filter (where (x.gen_ord - y.gen_ord) * (x.app_ord - y.app_ord) > 0) concordant, count(*) filter (where (x.gen_ord - y.gen_ord) * (x.app_ord - y.app_ord) < 0) discordant
  from best x join best y on x.page_scope = y.page_scope and x.review_id = y.review_id and x.app_id < y.app_id group by 1, 2) q using (review_id, page_scope)"""
_OVERLAP = """select review_id, page_scope, first_id, second_id, round_even(i / (s - i), 6) iou from (
  select x.review_id, x.page_scope, x.box_id first_id, y.box_id second_id, cast(x.w * x.h + y.w * y.h as double) s,
    cast(greatest(least(x.x + x.w, y.x + y.w) - greatest(x.x, y.x), 0) * greatest(least(x.y + x.h, y.y + y.h) - greatest(x.y, y.y), 0) as double) i
  from generated x join generated y on x.page_scope = y.page_scope and x.review_id = y.review_id and x.box_id < y.box_id) where i / (s - i) >= 0.2"""

_DIAG = """diag as (select *, round_even(gw * gh / (aw * ah), 6) area_ratio, round_even(gx - ax, 6) dx, round_even(gy - ay, 6) dy, round_even((gw - aw) / aw, 6) dw_pct, round_even((gh - ah) / ah, 6) dh_pct from best)"""

ORACLES = {
    "iou_matches": f"with {V.BOXES} select review_id, stratum, page_scope, gen_id, app_id, round_even(iou, 6) iou from matches",
    "best_match": f"with {SIDES} select review_id, page_scope, app_id, gen_id, round_even(iou, 6) iou from best",
    "geometry_delta": f"""with {SIDES} select review_id, stratum, generated, approved, {_R('mg', 'generated')} "precision", {_R('ma', 'approved')} recall, {_R('split', 'approved')} split_rate, {_R('merged', 'generated')} merge_rate, {_R('fp', 'generated')} false_rate,
 {_R('missing', 'approved')} missing_rate, {_R('unchanged', 'approved')} unchanged_geometry_rate, fp + missing + split + merged corrections, {_R('(fp + missing + split + merged)', 'pages')} corrections_per_page from summed""",
    "corrections_per_page": f"""with {SIDES}, t as (select review_id, fp + missing + split + merged corrections, case when review_id % 3 = 0 and review_id % 7 > 0 then review_id % 7 end sp, case when review_id % 2 = 0 then review_id % 5 + 1 end tp, pages from summed where stratum = 'total'),
n as (select review_id, corrections, cast(coalesce(sp, tp, pages) as bigint) pages, case when sp is not null then 'story_pages' when tp is not null then 'total_pages' else 'generated_pages' end page_basis from t)
select *, {_R('corrections', 'pages')} corrections_per_page from n""",
    "segmentation_accuracy": f"""with {SIDES}, v as (select *, approved + generated - credited possible, coalesce(round_even(earned / nullif(approved + generated - credited, 0), 6), 0.0) accuracy from summed)
select review_id, stratum, round_even(earned, 6) earned, possible, accuracy, case when accuracy >= 0.99 then 'above' when accuracy >= 0.95 then 'within' else 'below' end target from v""",
    "resize_diag": f"with {SIDES}, {_DIAG} select review_id, page_scope, app_id, gen_id, area_ratio, dx, dy, dw_pct, dh_pct from diag",
    "resize_bias": f"with {SIDES}, {_DIAG} select review_id, count(*) pairs, " + ", ".join(f"round_even({f}({n}), 6) {p}_{n}" for n in ("area_ratio", "dw_pct", "dh_pct") for p, f in (("mean", "avg"), ("median", "median"))) + " from diag group by 1",
    "page_overlap": f"with {V.BOXES} {_OVERLAP}",
    "reading_order": f"with {SIDES} {_ORDERED}",
    "panel_size_recall": f"with {SIDES}, z as (select *, case when w * h >= 0.12 then 'large' when w * h >= 0.03 then 'medium' else 'small' end size_band from a) select review_id, size_band, count(*) approved, count(*) filter (where hits > 0) matched, {_R('count(*) filter (where hits > 0)', 'count(*)')} recall from z group by 1, 2",
    "page_diagnostics": f"""with {SIDES}, o as ({_OVERLAP}), r as ({_ORDERED}),
x as (select review_id, page_scope, count(*) generated, count(*) filter (where hits = 0) false_panels from g group by 1, 2),
y as (select review_id, page_scope, count(*) approved, count(*) filter (where hits > 0) matched, count(*) filter (where hits = 0) missing from a group by 1, 2),
b as (select coalesce(x.review_id, y.review_id) review_id, coalesce(x.page_scope, y.page_scope) page_scope, coalesce(generated, 0) generated, coalesce(false_panels, 0) false_panels, coalesce(approved, 0) approved, coalesce(matched, 0) matched, coalesce(missing, 0) missing
      from x full join y on x.review_id = y.review_id and x.page_scope = y.page_scope)
select b.*, coalesce(deleted, 0) deleted, coalesce(overlap_pairs, 0) overlap_pairs, coalesce(agreement, 1.0) agreement, {_R('matched', 'approved')} recall from b
left join (select review_id, page_scope, count(*) filter (where deleted) deleted from approved group by 1, 2) d using (review_id, page_scope)
left join (select review_id, page_scope, count(*) overlap_pairs from o group by 1, 2) using (review_id, page_scope) left join (select review_id, page_scope, agreement from r) using (review_id, page_scope)""",
    "box_corrections": f"""with {SIDES} select review_id, case when hits = 0 then 'false_panel' else 'panel_merge' end operation, page_scope, box_id, hits from g where hits <> 1
union all select review_id, case when hits > 1 then 'panel_split' when stratum = 'spread' then 'spread_missing_panel' else 'missing_panel' end, page_scope, box_id, hits from a where hits <> 1""",
}
