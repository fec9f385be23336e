"""Mixing sources to target weights: exact quotas split down a tree of shards, then drawn without replacement.

Only DataFrame and SQL functions are used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import WORD_PATTERN, let, running, shared_table, unused, whole_text
from folioscope.operators.ordered import placed, settled, with_running_sum

#: Weights by rank of the source's name, repeating.
WEIGHTS = (1, 2, 3)
#: A source is used at most so many times.
MOST_EPOCHS = 3
#: Rows that one output shard holds on average, words of a block (the unit of the quotas), and rows of each
#: shard among which what whole blocks and equal shares leave is dealt.
SHARD_ROWS, BLOCK_WORDS, POOL_ROWS = 4096, 64, 4


def _uniform(*parts: Column | int) -> Column:
    """A number in (0, 1) that depends on the given values only."""
    bits = F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in order of code points, null last, weigh ``weights`` in turn and share the total size. A
    target stops at ``epochs`` times its source's size and the excess is shared again by weight until
    none is above. That is the level L with sum(min(epochs * size, weight * L)) = total: in order of
    epochs * size / weight the stopped sources come first, so L follows from running sums. The
    windows run over the table of sources only.
    """
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    leveled = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # the level of the first source that is not stopped holds for all
    chosen = leveled.withColumn("at", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(whole))
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight")))
    return chosen.select("source", "source_size", target.alias("target"))


def _split(quota: Column, left: Column, right: Column, draw: Column) -> Column:
    """How many of ``quota`` blocks, drawn without replacement from left + right, fall left: the hypergeometric law, inverted at ``draw``.

    The exact ratios of neighbouring probabilities are summed over all values within eight deviations of
    the mean; what lies beyond weighs less than a double can tell. The number of terms grows with the
    root of the number of blocks, at every size alike.
    """
    total = left + right
    mean = quota * left / total
    spread = F.sqrt(mean * (right / total) * ((total - quota) / F.greatest(total - 1, F.lit(1.0))))
    low, high = F.greatest(F.lit(0.0), quota - right), F.least(quota, left)
    first = F.greatest(low, F.ceil(mean - 8 * spread - 2).cast("double"))
    last = F.least(high, F.floor(mean + 8 * spread + 2).cast("double"))
    bounds = F.struct(first.alias("first"), (last - first).cast("int").alias("steps"))

    def inverted(b: Column) -> Column:
        x = lambda k: b["first"] + k
        # log of p(x + 1) / p(x) from each step to the next; their running sum is the log weight
        ratio = lambda k: F.log((left - x(k)) * (quota - x(k))) - F.log((x(k) + 1) * (right - quota + x(k) + 1))
        ratios = F.transform(F.filter(F.sequence(F.lit(0), b["steps"]), lambda k: k < b["steps"]), ratio)
        logs = F.concat(running(F.concat(ratios, F.array(F.lit(0.0))), F.lit(0.0), lambda a, r: a + r))
        weights = lambda y: let(F.array_max(y), lambda top: F.transform(y, lambda v: F.exp(v - top)))
        count = lambda w: let(
            draw * F.aggregate(w, F.lit(0.0), lambda acc, v: acc + v),
            lambda share: F.aggregate(
                w,
                F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
                lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), (acc["n"] + (acc["sum"] + v < share).cast("int")).alias("n")),
                lambda acc: acc["n"],
            ),
        )
        return F.least(high, b["first"] + let(let(logs, weights), count))

    return F.when((quota <= 0) | (left <= 0), 0.0).when(right <= 0, quota).when(quota >= total, left).otherwise(let(bounds, inverted))


def _blocks(start: Column, words: Column) -> Column:
    """Blocks that begin among ``words`` words from ``start`` on; blocks of neighbouring nodes add up."""
    ends = lambda at: F.floor((at + BLOCK_WORDS - 1) / BLOCK_WORDS).cast("double")
    return ends(start + words) - ends(start)


def _quotas(shards: DataFrame, targets: DataFrame, depth: int, seed: int) -> DataFrame:
    """(source, shard, epochs, quota, source_rest): whole rounds, and the words to draw beyond them, for each shard.

    ``shards`` holds (source, shard, words) sums. A source's words in hashed order of its rows, which is
    a random permutation, are cut into blocks of BLOCK_WORDS. The blocks to draw are split between the
    two halves of a node by the hypergeometric law, level by level, so that the shards' quotas follow the multivariate law
    and add up. ``source_rest`` is what the source's shards are to give in all.
    """
    goal = F.round("target").cast("long")
    node = targets.select(
        "source",
        F.lit(0).cast("long").alias("node"),
        F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
        F.col("source_size").cast("double").alias("words"),
        F.lit(0.0).alias("start"),
        goal.alias("goal"),
    )
    node = node.withColumn("epochs", F.least("epochs", F.lit(MOST_EPOCHS)))
    node = node.withColumn("source_rest", F.greatest(F.lit(0.0), F.least(F.col("goal") - F.col("epochs") * F.col("words"), F.col("words"))))
    node = node.withColumn("blocks", _blocks(F.col("start"), F.col("words")))
    node = node.withColumn("quota", F.least("blocks", F.floor(F.col("source_rest") / BLOCK_WORDS).cast("double"))).drop("goal")
    for level in range(depth):
        half = shards.groupBy("source", F.shiftright(F.col("shard"), depth - level - 1).alias("child")).agg(F.sum("words").cast("double").alias("child_words"))
        halves = half.groupBy(F.col("source").alias("s"), F.shiftright("child", 1).alias("parent")).agg(
            F.sum(F.when(F.col("child") % 2 == 0, F.col("child_words")).otherwise(0.0)).alias("left"),
            F.sum(F.when(F.col("child") % 2 == 1, F.col("child_words")).otherwise(0.0)).alias("right"),
        )
        joined = node.join(halves, node["source"].eqNullSafe(halves["s"]) & (node["node"] == halves["parent"]))
        cut = joined.withColumn("draw", _uniform(F.col("source"), F.col("node"), level, seed))
        cut = cut.withColumn("left_blocks", _blocks(F.col("start"), F.col("left"))).withColumn("right_blocks", F.col("blocks") - F.col("left_blocks"))
        cut = cut.withColumn("first", _split(F.col("quota"), F.col("left_blocks"), F.col("right_blocks"), F.col("draw")))
        side = lambda k, start, words, blocks, quota: F.struct((F.col("node") * 2 + k).alias("node"), start.alias("start"), F.col(words).alias("words"), F.col(blocks).alias("blocks"), quota.alias("quota"))
        sides = F.array(side(0, F.col("start"), "left", "left_blocks", F.col("first")), side(1, F.col("start") + F.col("left"), "right", "right_blocks", F.col("quota") - F.col("first")))
        node = cut.select("source", "epochs", "source_rest", F.inline(sides)).where("words > 0")
        node = shared_table(node, "quotas")  # a few rows; cut here, or the plan would double at each level
    quota = F.least(F.col("quota") * BLOCK_WORDS, F.col("words"))
    return node.select(F.col("source").alias("quota_source"), F.col("node").alias("quota_shard"), "epochs", quota.cast("long").alias("quota"), F.col("source_rest").cast("long").alias("source_rest"))


def _rounded(light: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """``quotas`` with ``picks``: rows of the shard, named by the words before them, that are given beyond the quota.

    A row that lies within its shard's quota is given whole, a row that meets the quota's end is not. What the source
    then lacks is filled with whole rows that follow in hashed order. First every shard takes rows as far as its equal share
    reaches; then the next POOL_ROWS rows of every shard that fit are dealt, the first of each shard before the second of
    any; last, one row comes or not, the one that brings the source nearest to its goal. A source's sums are told
    to each of its shards, and running sums over a source are made by range, so no task holds a source.
    """
    joined = light.join(quotas, light["source"].eqNullSafe(quotas["quota_source"]) & (light["shard"] == quotas["quota_shard"]))
    in_shard = Window.partitionBy("source", "shard")
    upto = lambda *by: in_shard.orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = joined.where("source_rest > 0 and size > 0").withColumn("before", F.sum("size").over(upto("spot", "doc_id")) - F.col("size"))
    rows = rows.withColumn("given", F.col("before") + F.col("size") <= F.col("quota")).withColumn("turn", F.xxhash64("spot", F.lit(seed + 2)))
    rows = shared_table(rows.select("source", "shard", "size", "before", "turn", "given", "source_rest"), "rows")
    parts = quotas.groupBy(F.col("quota_source").alias("source")).agg(F.count("*").alias("parts"))

    def lacking(table: DataFrame, given: Column, rest: str, name: str, *others: str) -> DataFrame:
        sums = table.groupBy("source").agg((F.first(rest) - F.sum(F.when(given, F.col("size")).otherwise(0))).alias(name), *[F.first(o).alias(o) for o in others])
        return sums.withColumnRenamed("source", "of")

    shards = quotas.select(F.col("quota_source").alias("in_source"), F.col("quota_shard").alias("in_part"))

    def beside(table: DataFrame, told: DataFrame) -> DataFrame:
        # told once for each shard, so that rows are dealt by shard and a large source is not one key
        each = shards.join(told, shards["in_source"].eqNullSafe(told["of"])).drop("of")
        return table.join(each, table["source"].eqNullSafe(each["in_source"]) & (table["shard"] == each["in_part"])).drop("in_source", "in_part")

    first = lacking(rows, F.col("given"), "source_rest", "lack")
    first = first.join(parts, first["of"].eqNullSafe(parts["source"])).select("of", "lack", F.expr("lack div parts").alias("share"))
    fits = F.col("size") <= F.col("share")
    shared = beside(rows.where("not given"), first).withColumn("sum", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(upto("before")))
    shared = shared_table(shared.withColumn("given", fits & (F.col("sum") <= F.col("share"))).select("source", "shard", "size", "before", "turn", "given", "lack"), "rows")

    open_rows = beside(shared.where("not given").drop("lack"), lacking(shared, F.col("given"), "lack", "lack"))
    large = F.col("size") > F.col("lack")
    nth = F.row_number().over(in_shard.orderBy(large, "before"))
    open_rows = open_rows.withColumn("nth", nth).withColumn("pooled", ~large & (F.col("nth") <= POOL_ROWS))
    pool = with_running_sum(placed(open_rows.where("pooled"), ["source"], [F.col("nth"), F.col("turn"), F.col("shard")]), ["source"], F.col("size"), "sum")
    pool = settled(pool).withColumn("given", F.col("sum") <= F.col("lack")).drop("sum")
    dealt = shared_table(pool.unionByName(open_rows.where("not pooled")), "rows")

    last = beside(dealt.where("not given").drop("lack"), lacking(dealt, F.col("given"), "lack", "lack"))
    off = F.abs(F.col("size") - F.col("lack"))
    nearest = last.where(off < F.col("lack")).groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("turn"), F.col("shard"), F.col("before"))).alias("row"))
    name = ("source", "shard", "before")
    picked = shared.where("given").select(*name).unionByName(dealt.where("given").select(*name)).unionByName(nearest.select("source", "row.shard", "row.before"))
    picks = picked.groupBy(F.col("source").alias("s"), F.col("shard").alias("n")).agg(F.collect_list("before").alias("picks"))  # within one shard
    out = quotas.join(picks, quotas["quota_source"].eqNullSafe(picks["s"]) & (quotas["quota_shard"] == picks["n"]), "left")
    return out.select("quota_source", "quota_shard", "epochs", "quota", F.coalesce("picks", F.array().cast("array<long>")).alias("picks"))


def draw(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, seed: int = 7, column: str = "mix") -> DataFrame:
    """``docs`` with a struct ``column``: size, source_size, target, epochs, part, taken, shard, place.

    A row's size is its number of words. Each source is to give ``target`` words: its whole rows
    ``epochs`` times, and ``part`` words more from rows drawn without replacement. Rows are dealt by
    hash into shards of some SHARD_ROWS rows; the blocks to draw beyond whole rounds are split down a binary tree
    over the shards by the multivariate hypergeometric law, and within its shard each source's rows
    are taken whole in hashed order as far as the quota reaches. What the shards' quotas leave is filled
    with whole rows again (``_rounded``). No row is taken in part (``part`` is 0 or the row's size), so a source
    misses its target by a fraction of one row: a source of few rows by at most half of one,
    mostly. ``place`` is the row's position in its shard's own shuffle.

    The draw depends on (seed, doc_id, text) only, so reruns agree. Equal rows are told apart by nothing
    and may swap places. A null source is a source of its own, a null or empty text has size 0 and is
    never drawn. All other columns are kept, whatever their names (one named like ``column`` is replaced). Empty in, empty out.
    """
    docs = docs.drop(column)
    rows = docs.count()
    depth = max(0, (rows // SHARD_ROWS).bit_length())
    size = F.regexp_count(whole_text(), F.lit(WORD_PATTERN)).cast("long")
    spot = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))
    shard = F.shiftrightunsigned(spot, 64 - depth) if depth else F.lit(0).cast("long")
    light = shared_table(docs.select("doc_id", "source", size.alias("size"), spot.alias("spot"), shard.alias("shard")), "sizes")
    shards = shared_table(light.groupBy("source", "shard").agg(F.sum("size").alias("words")), "shards")
    targets = shared_table(source_targets(shards.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs), "targets")
    quotas = shared_table(_rounded(light, shared_table(_quotas(shards, targets, depth, seed), "quotas"), seed), "quotas")
    own, given, before = (unused(n, docs) for n in ("_own", "_given", "_before"))
    at, part_of = unused("_quota_source", docs), unused("_quota_shard", docs)
    named = targets.select(F.col("source").alias("target_source"), "source_size", "target")
    all_given = quotas.join(named, quotas["quota_source"].eqNullSafe(named["target_source"]))
    all_given = all_given.select(F.col("quota_source").alias(at), F.col("quota_shard").alias(part_of), F.struct("source_size", "target", "epochs", "quota", "picks").alias(given))
    sized = docs.withColumn(own, F.struct(size.alias("size"), spot.alias("spot"), shard.alias("shard")))
    joined = sized.join(all_given, F.col("source").eqNullSafe(F.col(at)) & (F.col(f"{own}.shard") == F.col(part_of)), "left")
    order = Window.partitionBy("source", f"{own}.shard").orderBy(f"{own}.spot", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = joined.withColumn(before, F.sum(f"{own}.size").over(order) - F.col(f"{own}.size"))
    n, start = F.col(f"{own}.size"), F.col(before)
    is_given = (start + n <= F.col(f"{given}.quota")) | F.array_contains(f"{given}.picks", start)
    part = F.when((n > 0) & F.coalesce(is_given, F.lit(False)), n).otherwise(0)
    rounds = F.coalesce(f"{given}.epochs", F.lit(0))
    mix = F.struct(
        n.alias("size"), F.coalesce(f"{given}.source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce(f"{given}.target", F.lit(0.0)).alias("target"),
        rounds.alias("epochs"), part.cast("long").alias("part"), (rounds * n + part).cast("long").alias("taken"), F.col(f"{own}.shard").alias("shard"), F.xxhash64(f"{own}.spot", F.lit(seed + 1)).alias("place"),
    )
    return drawn.select(*docs.columns, mix.alias(column))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves: each row once per whole round, and once more if it is drawn beyond them.

    Texts are whole. Columns are those of ``docs``, whatever their names; rows come shard by shard in the shard's own
    shuffle. Rows without a word are left out; an empty table stays empty.
    """
    mix, copy = unused("_mix", docs), unused("_copy", docs)
    of = lambda name: F.col(f"{mix}.{name}")
    mixed = draw(docs, **options, column=mix).where(of("taken") > 0)
    times = of("epochs") + (of("part") > 0).cast("long")
    copies = mixed.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return copies.sortWithinPartitions(f"{mix}.shard", f"{mix}.place", copy).select(*docs.columns)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return draw(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.epochs", "mix.shard", "mix.place")
