"""Merkle manifest of a table: every few levels are stored, the levels between are made again where proofs need them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import let, shared_table

#: Levels from one stored level to the next: a stored subtree has 64 children and 63 nodes that are not stored.
STRIDE = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value; whole numbers are written in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes until one is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _steps(n: Column, level: int, stride: int) -> Column:
    """How many levels the subtrees that start at a stored level have."""
    return F.least(F.lit(stride), F.greatest(_height(n) - level * stride, F.lit(0)))


def _levels(hashes: Column, steps: Column, stride: int) -> Column:
    """All levels of an aligned subtree, its children first; a node without a neighbour is hashed alone."""
    pair = lambda h, i: F.sha2(F.concat(F.get(h, i), F.coalesce(F.get(h, i + 1), F.lit(""))), 256)
    above = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 1, F.lit(2)), lambda i: pair(h, i))
    counted = F.slice(F.array(*map(F.lit, range(stride))), F.lit(1), steps)
    return F.aggregate(counted, F.array(hashes), lambda made, _: F.concat(made, F.array(above(F.element_at(made, -1)))))


def _siblings(levels: Column, child: Column, steps: Column, stride: int) -> Column:
    """A child's siblings up to the subtree's top: L or R for the side, then the hash; empty where there is none."""

    def at(j: Column) -> Column:
        node = F.call_function("shiftright", child, j)
        beside = F.get(F.get(levels, j), node.bitwiseXOR(F.lit(1)))
        return F.coalesce(F.concat(F.when(node % 2 == 1, "L").otherwise("R"), beside), F.lit(""))

    return F.transform(F.slice(F.array(*map(F.lit, range(stride))), F.lit(1), steps), at)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (run, key, hash, extra) with each one's place in its run, by key (null first) and hash, and the run's size ``n``.

    Rows are dealt by range of all of these and a number that tells equal rows apart, so neither a run nor a key has to fit
    a task; a range counts its rows from its beginning, and what the ranges before it hold of the run is added.
    """
    told = shared_table(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle_leaves")
    order = ["run", "key", "hash", "tie"]
    dealt = told.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id())
    placed = shared_table(dealt, "merkle_sorted").withColumn("part", F.shiftright("at", 33))
    ranges = placed.groupBy("run", "part").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    before = F.expr("coalesce(sum(here) over (partition by run order by part rows between unbounded preceding and 1 preceding), 0)")
    ranges = ranges.select("run", "part", "first", before.alias("before"), F.expr("sum(here) over (partition by run)").alias("n"))
    return placed.join(ranges, ["run", "part"]).select("run", "n", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "key", "hash", "extra")


def _subtrees(nodes: DataFrame, child: Column, stride: int) -> DataFrame:
    """(run, n, block, children): aligned groups of 2**stride nodes at most, in order."""
    grouped = nodes.groupBy("run", "n", F.shiftright("pos", stride).alias("block")).agg(F.array_sort(F.collect_list(child)).alias("children"))
    return shared_table(grouped, "merkle_level")


def store_levels(leaves: DataFrame, stride: int = STRIDE) -> list[DataFrame]:
    """The stored levels above ``leaves`` (run, n, pos, key, hash, extra), the leaves' own first.

    Level k holds the nodes of height k * stride of every run that reaches higher (the leaves of every run), grouped by subtree.
    """
    stored = [_subtrees(leaves, F.struct("pos", "hash", "key", "extra"), stride)]
    most = stored[0].agg(F.max("n").alias("n")).first()["n"] or 0
    while (most - 1).bit_length() > len(stored) * stride:
        k = len(stored)
        tops = roots(stored[-1].where(_height(F.col("n")) > k * stride), k - 1, stride)
        nodes = tops.select("run", "n", F.col("block").alias("pos"), "hash")
        stored.append(_subtrees(nodes, F.struct("pos", "hash"), stride))
    return stored


def roots(level: DataFrame, k: int, stride: int = STRIDE) -> DataFrame:
    """(run, n, block, hash): the top of each subtree of a stored level."""
    made = _levels(F.col("children.hash"), _steps(F.col("n"), k, stride), stride)
    return level.select("run", "n", "block", F.get(F.element_at(made, -1), F.lit(0)).alias("hash"))


def _last(k: int, stride: int) -> Column:
    """Whether a run's root is the top of a subtree of stored level ``k``."""
    n = F.col("n")
    ends = _height(n) <= (k + 1) * stride
    return ends if k == 0 else ends & (_height(n) > k * stride)


def run_roots(stored: list[DataFrame], stride: int = STRIDE) -> DataFrame:
    """(run, hash): the root of each run."""
    out = None
    for k, level in enumerate(stored):
        tops = roots(level.where(_last(k, stride)), k, stride).select("run", "hash")
        out = tops if out is None else out.unionByName(tops)
    return out


def extract_proofs(stored: list[DataFrame], above: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(run, key, hash, extra, proof, subroot) of every leaf; ``above`` has (run, proof, subroot), the way on from a run's root.

    From the top stored level down, each subtree's missing levels are made from its children, the children's siblings
    are put in front of their parent's proof, and the levels are dropped again. What is joined is one row per subtree.
    """
    proofs = None
    for k in range(len(stored) - 1, -1, -1):
        start = above.join(stored[k].where(_last(k, stride)).select("run", "block"), "run").select("run", "block", "proof", "subroot")
        parents = start if proofs is None else start.unionByName(proofs.select("run", F.col("pos").alias("block"), "proof", "subroot"))
        steps = _steps(F.col("n"), k, stride)
        own = let(
            _levels(F.col("children.hash"), steps, stride),
            lambda made: F.transform("children", lambda c, i: F.struct(c.alias("child"), _siblings(made, i, steps, stride).alias("way"))),  # noqa: B023
        )
        each = stored[k].join(parents, ["run", "block"]).select("run", "proof", "subroot", F.inline(own))
        proofs = each.select("run", "child.*", F.concat("way", "proof").alias("proof"), "subroot")
    return proofs.drop("pos")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    beside = lambda s: F.substring(s, 2, 64)
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.when(s.startswith("L"), F.concat(beside(s), h)).otherwise(F.concat(h, beside(s))), 256))


@dataclass
class Manifest:
    """The stored levels of all runs, those of the tree over the runs' roots, and the root (null without rows)."""

    stored: list[DataFrame]
    upper: list[DataFrame]
    root: str | None
    stride: int

    def proofs(self) -> DataFrame:
        """(run, key, hash, extra, proof, subroot): each leaf with its siblings up to the root, and its run's root."""
        top = self.upper[0].sparkSession.createDataFrame([("", [], "")], "run string, proof array<string>, subroot string")
        runs = extract_proofs(self.upper, top, self.stride).select(F.col("key").alias("run"), "proof", F.col("hash").alias("subroot"))
        return extract_proofs(self.stored, shared_table(runs, "merkle_runs"), self.stride)


def manifest(docs: DataFrame, run: str = "lang", key: str = "doc_id", fields: Sequence[str] = FIELDS, extra: Column | None = None, stride: int = STRIDE) -> Manifest:
    """The Merkle tree over a table: a leaf for each row, a tree for each value of ``run``, and one over their roots.

    Leaves stand by ``key`` (null first); rows of one key by their hashes, and equal rows are leaves of their own. A null
    run is a run of its own and comes first, an empty one is another; the others follow by their bytes. Nulls in any field
    are hashed as ``-``. Texts of any length are hashed where they are read and are not shuffled. An
    empty table has no root. ``extra`` is kept beside each leaf; other columns are not read.
    """
    name = F.coalesce(F.concat(F.lit("+"), F.col(run).cast("string")), F.lit(""))
    leaves = docs.select(name.alias("run"), F.col(key).alias("key"), leaf_hash([F.col(f) for f in fields]).alias("hash"), (F.lit(None).cast("string") if extra is None else extra).alias("extra"))
    stored = store_levels(numbered(leaves), stride)
    tops = run_roots(stored, stride).select(F.lit("").alias("run"), F.col("run").alias("key"), "hash", F.lit(None).cast("string").alias("extra"))
    upper = store_levels(numbered(tops), stride)
    root = run_roots(upper, stride).first()
    return Manifest(stored, upper, root["hash"] if root else None, stride)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its run's root and the whole root, its proof, and what the proof leads a tampered leaf to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    tampered = leaf_hash([more if f == "n_chars" else F.col(f) for f in FIELDS])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    made = manifest(docs, extra=F.when(chosen, tampered))
    rows = made.proofs().select(
        F.col("key").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", F.lit(made.root).cast("string").alias("root"),
        F.sha2(F.array_join(F.transform("proof", lambda s: F.substring(s, 2, 64)), ""), 256).alias("proof_sha256"),
        fold(F.coalesce("extra", "hash"), F.col("proof")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _encoded_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(cast({value} as varchar))) || ':' || cast({value} as varchar), '-')"


ORACLE_SQL = f"""
with recursive d as (
  select row_number() over () rid, doc_id, lang, sha256({" || ".join(map(_encoded_sql, FIELDS))}) leaf,
         sha256({" || ".join(_encoded_sql("cast(n_chars as hugeint) + 1" if f == "n_chars" else f) for f in FIELDS)}) told
  from documents),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf, rid) - 1 pos, count(*) over (partition by lang) n from d),
up as (select lang, 0 lvl, pos, n, leaf h from p
       union all
       select lang, lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' order by pos)) from up where n > 1 group by lang, lvl, pos // 2),
s as (select lang, h subroot, row_number() over (order by lang nulls first) - 1 pos, count(*) over () n from up where n = 1),
top as (select 0 lvl, pos, n, subroot h from s
        union all
        select lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' order by pos)) from top where n > 1 group by lvl, pos // 2),
crc as (select doc_id, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
          lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))) c
        from (select distinct doc_id from documents where doc_id is not null)),
start as (select p.*, coalesce(xor(crc.c, 4294967295) % {TAMPERED} = 0, false) hit from p left join crc using (doc_id)),
low as (select rid, lang, pos, n, 0 lvl, case when hit then told else leaf end h, '' way from start
        union all
        select f.rid, f.lang, f.pos // 2, (f.n + 1) // 2, f.lvl + 1,
               sha256(case when f.pos % 2 = 1 then u.h || f.h else f.h || coalesce(u.h, '') end), f.way || coalesce(u.h, '')
        from low f left join up u on u.lang is not distinct from f.lang and u.lvl = f.lvl and u.pos = xor(f.pos, 1) where f.n > 1),
high as (select low.rid, s.pos, s.n, 0 lvl, low.h, low.way from low join s on s.lang is not distinct from low.lang where low.n = 1
         union all
         select f.rid, f.pos // 2, (f.n + 1) // 2, f.lvl + 1,
                sha256(case when f.pos % 2 = 1 then u.h || f.h else f.h || coalesce(u.h, '') end), f.way || coalesce(u.h, '')
         from high f left join top u on u.lvl = f.lvl and u.pos = xor(f.pos, 1) where f.n > 1)
select p.doc_id, p.leaf, s.subroot, t.h root, sha256(high.way) proof_sha256, high.h folded_root, high.h = t.h verified
from p join s on s.lang is not distinct from p.lang join high on high.rid = p.rid and high.n = 1 cross join (select h from top where n = 1) t
"""
