"""Queries of the revision operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import revisions as R
from folioscope.plans import views as V


def _classed(spark, d):
    return R.with_freshness(R.classify(V.field_pairs(spark, d)))


def revision_categories(spark, d):
    return _classed(spark, d).select("review_id", "artifact_id", "field", "category", F.bround("distance", 6).alias("distance"), "weight")


def metadata_delta(spark, d):
    return R.metadata_delta(_classed(spark, d))


def revision_benchmark(spark, d):
    return R.revision_benchmark(_classed(spark, d))


def metadata_accuracy(spark, d):
    return R.metadata_accuracy(_classed(spark, d))


def editorial_burden(spark, d):
    return R.editorial_burden(_classed(spark, d))


def edit_class_totals(spark, d):
    return R.edit_class_totals(_classed(spark, d))


def weak_fields(spark, d):
    return R.weak_fields(_classed(spark, d))


def field_corrections(spark, d):
    return R.field_corrections(_classed(spark, d))


def _sides(spark, d):
    """A user turn and the assistant's next one as the two sides of an output; schema versions by the turn."""
    talk = V.table(spark, d, "conversations")
    one = lambda role, version: talk.where(F.col("role") == role).select((F.col("conv_id") % 50).alias("review_id"), (F.col("conv_id") * 100 + F.col("turn") - (F.col("role") == "assistant").cast("int")).alias("artifact_id"), version.alias("schema_version"), F.lit("text").alias("field"), F.col("text").alias("value"))
    return one("user", F.when(F.col("turn") % 4 == 0, "1.1").otherwise("2")), one("assistant", F.when(F.col("conv_id") % 9 == 0, "1.1").otherwise("2"))


def field_pairing(spark, d):
    """Generated and approved outputs side by side."""
    return R.pair_fields(*_sides(spark, d)).select("review_id", "artifact_id", "status", "field", F.length("generated").alias("generated_length"), F.length("approved").alias("approved_length"))


def metadata_corrections(spark, d):
    sides = R.pair_fields(*_sides(spark, d))
    pairs = sides.where("status = 'common' and field is not null").select("review_id", "artifact_id", "field", "generated", "approved")
    return R.metadata_corrections(R.classify(pairs), sides)


def acceptance_basis(spark, d):
    """Which outputs count toward acceptance, by their provenance."""
    fields = V.field_pairs(spark, d).withColumn("fresh", R.counts_toward_acceptance(F.col("origin"), F.col("has_origin"), F.col("disposition")))
    return fields.groupBy("has_origin", "origin", "disposition").agg(F.count("*").alias("outputs"), F.count_if("fresh").alias("fresh_outputs"))


def artifact_set_diff(spark, d):
    talk = V.table(spark, d, "conversations")
    side = lambda role: talk.where(F.col("role") == role).select((F.col("conv_id") % 50).alias("review_id"), (F.col("conv_id") * 100 + F.col("turn") - (F.col("role") == "assistant").cast("int")).alias("artifact_id"))
    return R.artifact_set_diff(side("user"), side("assistant"))


def calls_per_panel(spark, d):
    counts = V.table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("generation_count"))
    return R.calls_per_panel(counts.withColumn("review_id", F.col("conv_id") % 50))


QUERIES = [revision_categories, metadata_delta, revision_benchmark, metadata_accuracy, editorial_burden, edit_class_totals, weak_fields, field_corrections, artifact_set_diff, calls_per_panel, field_pairing, metadata_corrections, acceptance_basis]

W = f"""with {V.FIELD_PAIRS}, weighted as (select *, case category {' '.join(f"when '{k}' then {v}" for k, v in R.REVISION_WEIGHTS.items())} end weight, category in ('minor_wording_edit', 'moderate_rewrite', 'major_rewrite', 'complete_replacement') is_rewrite,
 category in ('minor_wording_edit', 'moderate_rewrite', 'major_rewrite', 'complete_replacement', 'added', 'removed') is_edit from classed)"""
_R = lambda n, d, e="0.0": f"coalesce(round_even(cast({n} as double) / nullif({d}, 0), 6), {e})"
_N = lambda k: f"count(*) filter (where category = '{k}')"

_SIDES = """g as (select conv_id % 50 review_id, conv_id * 100 + turn artifact_id, case when turn % 4 = 0 then '1.1' else '2' end v, text from conversations where role = 'user'),
a as (select conv_id % 50 review_id, conv_id * 100 + turn - 1 artifact_id, case when conv_id % 9 = 0 then '1.1' else '2' end v, text from conversations where role = 'assistant'),
o as (select coalesce(g.review_id, a.review_id) review_id, coalesce(g.artifact_id, a.artifact_id) artifact_id, g.text g, a.text a,
             case when a.v is null then 'generated_only' when g.v is null then 'approved_only' when g.v <> a.v then 'schema_mismatch' else 'common' end status
      from g full join a on g.review_id = a.review_id and g.artifact_id = a.artifact_id)"""

ORACLES = {
    "revision_categories": f"{W} select review_id, artifact_id, field, category, round_even(distance, 6) distance, cast(weight as double) weight from weighted",
    "metadata_delta": f"""{W}, c as (select review_id, count(*) filter (where generated <> '') generated_populated, count(*) filter (where approved <> '') approved_populated, count(*) expected, {_N('accepted_unchanged')} accepted,
 count(*) filter (where is_rewrite) edited, {_N('removed')} deleted, {_N('added')} added from weighted group by 1)
select *, {_R('accepted', 'generated_populated')} acceptance_rate, {_R('edited', 'generated_populated')} edit_rate, {_R('deleted', 'generated_populated')} deletion_rate, {_R('(edited + deleted)', 'generated_populated')} hallucination_proxy,
 {_R('added', 'approved_populated')} addition_rate, {_R('approved_populated', 'expected')} completeness from c""",
    "revision_benchmark": f"""{W}, r as (select *, unnest(case when fresh then ['all_common', 'fresh'] else ['all_common'] end) basis from weighted), l as (select *, unnest([field, '*']) f from r),
n as (select review_id, basis, count(distinct artifact_id) artifacts from r group by 1, 2),
b as (select review_id, basis, f field, count(*) filter (where category <> 'abstention') comparable, count(*) filter (where generated <> '') generated_populated, count(*) filter (where approved <> '') approved_populated, {', '.join(f'{_N(k)} {k}' for k in R.CATEGORIES)},
 round_even(sum(cast(weight as double)), 6) ws, round_even(sum(distance), 6) distance_sum, round_even(median(distance), 6) distance_median from l group by 1, 2, 3)
select * exclude (ws), {_R('accepted_unchanged', 'comparable')} accepted_rate, {_R('ws', 'comparable')} weighted_intervention, {_R('distance_sum', 'comparable')} distance_mean, {_R('(minor_wording_edit + moderate_rewrite + major_rewrite + complete_replacement + added + removed)', 'artifacts')} corrections_per_artifact from b join n using (review_id, basis)""",
    "metadata_accuracy": f"""{W}, a as (select review_id, count(*) filter (where fresh and category = 'accepted_unchanged') accepted, count(*) filter (where fresh and category <> 'abstention') comparable, count(*) filter (where fresh and is_edit) edited,
 count(*) filter (where not fresh and category <> 'abstention') excluded_fields, count(*) filter (where not has_origin) path, count(*) filter (where not has_origin and disposition is not null) flagged from weighted group by 1),
c as (select *, case when flagged = 0 then 'none' when flagged = path then 'all' else 'partial' end coverage, {_R('accepted', 'comparable')} accuracy from a)
select review_id, accepted, comparable, edited, excluded_fields, coverage, accuracy, coverage = 'partial' provisional, case when coverage <> 'partial' and comparable > 0 then accuracy >= 0.75 end meets_target, comparable > 0 and accuracy = 1.0 and edited = 0 no_inspection from c""",
    "editorial_burden": f"""{W}, t as (select *, list_distinct(list_filter(regexp_split_to_array(lower(generated), '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> '')) g, list_distinct(list_filter(regexp_split_to_array(lower(approved), '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> '')) a from weighted where fresh and category <> 'abstention'),
e as (select *, case when len(list_distinct(list_concat(g, a))) > 0 then 1.0 - cast(len(list_intersect(g, a)) as double) / len(list_distinct(list_concat(g, a))) else 0.0 end eff from t),
f as (select field, count(*) comparable, {_N('accepted_unchanged')} accepted, count(*) filter (where is_edit) edited, coalesce(round_even(avg(round_even(eff, 6)) filter (where is_edit), 6), 0.0) effort from e group by 1)
select *, {_R('accepted', 'comparable')} acceptance_rate, {_R('edited', '(sum(edited) over ())')} "share", cast(row_number() over (order by edited desc, effort desc, field) as integer) "rank" from f""",
    "edit_class_totals": f'{W} select category, count(*) "rows", count(distinct review_id) reviews from weighted group by 1',
    "weak_fields": f"""{W}, f as (select field, count(*) comparable, {_N('accepted_unchanged')} accepted, count(*) filter (where is_edit) edited from weighted where category <> 'abstention' group by 1),
r as (select *, {_R('accepted', 'comparable')} acceptance_rate, {_R('edited', 'comparable')} edit_rate from f) select *, cast(row_number() over (order by edit_rate desc, field) as integer) "rank" from r""",
    "field_corrections": f"{W} select review_id, artifact_id, 'fields_corrected' operation, count(*) fields from weighted where is_edit group by 1, 2",
    "artifact_set_diff": """with s as (select conv_id % 50 review_id, conv_id * 100 + turn - (role = 'assistant')::int artifact_id, role from conversations where role in ('user', 'assistant')),
o as (select review_id, artifact_id, bool_or(role = 'user') u, bool_or(role = 'assistant') a from s group by 1, 2)
select review_id, count(*) filter (where u and a) common, count(*) filter (where u and not a) generated_only, count(*) filter (where a and not u) approved_only from o group by 1""",
    "calls_per_panel": """with c as (select conv_id, count(*) n from conversations where role = 'user' group by 1)
select conv_id % 50 review_id, count(*) outputs, cast(sum(n) as bigint) calls, round_even(avg(n), 6) mean_calls, max(n) most_calls, count(*) filter (where n > 1) recalled from c group by 1""",
    "field_pairing": f"""with {_SIDES} select review_id, artifact_id, status, case when status = 'common' or g is not null and a is not null then 'text' end field, case when g is not null and a is not null then length(g) end generated_length, case when g is not null and a is not null then length(a) end approved_length from o""",
    "metadata_corrections": f"""with {_SIDES}, c as (select review_id, artifact_id, g, a from o where status = 'common')
select review_id, artifact_id, case status when 'generated_only' then 'artifact_removed_at_approval' when 'approved_only' then 'artifact_added_at_approval' else 'schema_version_mismatch' end operation, 0 fields from o where status <> 'common'
union all select review_id, artifact_id, 'fields_corrected', 1 from c where not (coalesce(g, '') = '' and coalesce(a, '') = '') and g is distinct from a""",
    "acceptance_basis": f"with {V.FIELD_PAIRS} select has_origin, origin, disposition, count(*) outputs, count(*) filter (where fresh) fresh_outputs from revised group by 1, 2, 3",
}
