"""Reading published revisions: discovery, pointers, snapshots, contract lists, evidence.

Nothing here raises on a bad record. Functions that can reject return the accepted rows and the rejected
ones with a reason, so that one record cannot stop a job over all issues.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.schemas import POINTER, SNAPSHOT
from folioscope.storage import shared_table

POINTER_NAME = "/approved/published.json"
#: The chain of names that lead to an issue.
CHAIN = ("publishers", "title_groups", "series", "issues")
IDS = ("publisher_id", "title_group_id", "series_id", "issue_id")
REQUIRED_FILES = ("approved_dataset.json", "approved_llm_outputs.json", "retrieval_evidence_packets.json")
# The objects that make up the evidence for a review.
ROLES = ("approved_pointer", "processing_snapshot", "review_report", "platform_approval")
EVIDENCE_VERSION = "v1"
#: Files or folders that one task writes, lists or reads on average at most; folders that a task looks through below one that it is given; rows or bytes of a batch that it returns.
TASK_FILES, STEPS, BATCH_ROWS, BATCH_BYTES = 5_000, 64, 10_000, 16_000_000


def files(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Every file below ``root`` that is not empty: path, length, modificationTime, content. Unused columns are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def write_files(documents: DataFrame, root: str) -> DataFrame:
    """Write each document (path, content) as a file of its own below ``root``, a folder that all executors share; returns (path, length).

    A file is replaced if it is there, so a task that runs again does no harm. A null content is an empty file; rows without a path drop out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            paths, contents = batch.column("path").to_pylist(), batch.column("content").to_pylist()
            for path, content in zip(paths, contents):
                store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([len(c or b"") for c in contents], pa.int64())], names=["path", "length"])

    rows = documents.where("path is not null").select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(run, "path string, length long")


def dealt_files(rows: DataFrame, count: int, key: str) -> DataFrame:
    """Rows that stand for ``count`` files or folders, dealt by ``key`` over as many tasks as these need: each costs far more than the row's bytes."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-count // TASK_FILES)), key)


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file below ``root`` that is not empty, the path from there on; no content is read.

    ``files`` has Spark list on the driver, folder by folder. Here tasks list: each looks through a bounded number of folders below every folder it is given, and
    what is left is dealt out anew, so that neither the driver nor a task holds a whole tree. Hidden names (``.`` and ``_`` in front) are left out, as Spark does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        hidden = lambda name: name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
        rows: list[tuple[str, int | None]] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["path", "length"])
        for batch in batches:
            for given in batch.column("path").to_pylist():
                queue, steps = deque([given]), 0
                while queue and steps < STEPS:
                    steps += 1
                    for info in store.get_file_info(fs.FileSelector(f"{base}/{queue.popleft()}".rstrip("/") or "/")):
                        path = info.path[len(base) + 1 :]
                        if hidden(info.base_name):
                            continue
                        if info.type == fs.FileType.Directory:
                            queue.append(path)
                        elif info.size:
                            rows.append((path, info.size))
                for path in queue:
                    rows.append((path, None))
                    if len(rows) >= BATCH_ROWS:
                        yield made()
                        rows.clear()
                if len(rows) >= BATCH_ROWS:
                    yield made()
                    rows.clear()
        yield made()

    folders, found = spark.range(1).select(F.lit("").alias("path")), []
    while True:
        found.append(shared_table(folders.mapInArrow(run, "path string, length long"), "listing"))
        folders = found[-1].where("length is null").select("path")
        left = folders.count()
        if not left:
            return reduce(DataFrame.unionByName, [f.where("length is not null") for f in found])
        folders = dealt_files(folders, left, "path")


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """(path, content) of the files at these paths below ``root``, each opened once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        made = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
        names: list[str] = []
        contents: list[bytes] = []
        size = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(f"{base}/{path}") as file:
                    contents.append(file.read())
                names.append(path)
                size += len(contents[-1])
                if size >= BATCH_BYTES or len(names) >= BATCH_ROWS:
                    yield made()
                    names, contents, size = [], [], 0
        yield made()

    return paths.select("path").mapInArrow(run, "path string, content binary")


def parse_identity(df: DataFrame, prefix: str = "issue_prefix") -> DataFrame:
    """Adds the four ids of an issue's path, null where the chain lacks a part."""
    parts = F.split(F.col(prefix), "/")
    place = lambda name: F.array_position(parts, name).cast("int")
    return df.withColumns({i: F.when(place(n) > 0, F.try_element_at(parts, place(n) + 1)) for n, i in zip(CHAIN, IDS)})


def identity_conflicts(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose two prefixes disagree on an id that both have."""
    a = parse_identity(df.withColumn("_p", F.col(left)), "_p").select("*", *[F.col(i).alias(f"_{i}") for i in IDS]).drop(*IDS)
    both = parse_identity(a.withColumn("_p", F.col(right)), "_p")
    clash = F.lit(False)
    for i in IDS:
        clash = clash | (F.col(f"_{i}").isNotNull() & F.col(i).isNotNull() & (F.col(f"_{i}") != F.col(i)))
    return both.where(clash).select(*df.columns)


def discover_issues(paths: DataFrame) -> DataFrame:
    """Distinct issues with a published pointer, from the ``path`` column only; broken chains are left out."""
    found = paths.where(F.col("path").endswith(POINTER_NAME)).select(F.regexp_extract("path", rf"(publishers/.+){POINTER_NAME}$", 1).alias("issue_prefix"))
    return parse_identity(found.where("issue_prefix <> ''").distinct()).dropna(subset=list(IDS))


def judged_pointers(pointers: DataFrame) -> DataFrame:
    """(issue_prefix, revision_id, revision_key, reject_reason) of all pointers, each read once; the reason is null where both are named."""
    parsed = pointers.select("issue_prefix", F.from_json(F.col("content").cast("string"), POINTER).alias("p")).select("issue_prefix", "p.*")
    reason = F.when(F.coalesce("revision_id", F.lit("")) == "", "no_revision_id").when(F.coalesce("revision_key", F.lit("")) == "", "no_revision_key")
    return parsed.withColumn("reject_reason", reason)


def resolve_pointers(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issue_prefix, revision_id, revision_key) of the pointers that name both, and the others with a reason."""
    marked = judged_pointers(pointers)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")


def extract_snapshots(pointers: DataFrame, snapshots: DataFrame, required: Sequence[str] = REQUIRED_FILES) -> tuple[DataFrame, DataFrame]:
    """The files of each pointer's snapshot (issue_prefix, revision_id, path, content), and what was rejected.

    ``rev_`` and the SHA-256 of the snapshot's bytes must be the pointer's revision; each file's digest
    must be the embedded one, its base64 must decode, and the required files must be there.
    """
    joined = pointers.join(snapshots.withColumnRenamed("key", "revision_key"), "revision_key", "left")
    digest = F.concat(F.lit("rev_"), F.sha2("content", 256))
    judged = joined.withColumn("reject_reason", F.when(F.col("content").isNull(), "missing_snapshot").when(digest != F.col("revision_id"), "snapshot_hash"))
    good = judged.where("reject_reason is null").withColumn("snapshot", F.from_json(F.col("content").cast("string"), SNAPSHOT))
    listed = good.select("issue_prefix", "revision_id", F.explode_outer("snapshot.artifacts").alias("f"))
    decoded = F.try_to_binary("f.content_b64", F.lit("base64"))
    each = listed.select("issue_prefix", "revision_id", "f.path", decoded.alias("content"), F.col("f.sha256").alias("told"))
    each = each.withColumn("reject_reason", F.when(F.col("content").isNull(), "bad_base64").when(F.sha2("content", 256) != F.col("told"), "file_hash")).drop("told")
    fine = each.where("reject_reason is null")
    named = good.select("issue_prefix", "revision_id", F.explode(F.array(*map(F.lit, required))).alias("path"))
    lacking = named.join(fine.select("issue_prefix", "revision_id", "path"), ["issue_prefix", "revision_id", "path"], "left_anti")
    keys = ["issue_prefix", "revision_id", "path", "reject_reason"]
    rejected = (
        judged.where("reject_reason is not null").withColumn("path", F.lit(None).cast("string")).select(*keys)
        .unionByName(each.where("reject_reason is not null").select(*keys)).unionByName(lacking.withColumn("reject_reason", F.lit("missing_file")).select(*keys))
    )
    whole = fine.join(rejected.select("issue_prefix").distinct(), "issue_prefix", "left_anti").drop("reject_reason")
    return whole, rejected


def contract_list(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row per record of a JSON list that stands bare or wrapped in an object under ``key``; ``record`` is VARIANT."""
    value = F.try_parse_json(F.col(content).cast("string"))
    bare = F.try_variant_get(value, "$", "array<variant>")
    wrapped = F.try_variant_get(value, f"$.{key}", "array<variant>")
    return df.select(*[c for c in df.columns if c != content], F.explode(F.coalesce(wrapped, bare)).alias("record"))


def evidence_manifest(issues: DataFrame, objects: DataFrame, roles: Sequence[str] = ROLES, needed: Sequence[str] = ROLES[:2]) -> DataFrame:
    """Per issue and role: status, size and digest, with the issue's loaded count and whether an audit can start.

    ``objects`` has (issue_prefix, role, content, error). The roles are a handful, so every issue is paired
    with each of them.
    """
    wanted = issues.select("issue_prefix", F.explode(F.array(*map(F.lit, roles))).alias("role"))
    found = wanted.join(objects, ["issue_prefix", "role"], "left")
    status = F.when(F.col("content").isNotNull(), "read").when(F.col("error") == "denied", "denied").when(F.col("error").isNotNull(), "error").otherwise("missing")
    each = found.select("issue_prefix", "role", status.alias("status"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    totals = each.groupBy("issue_prefix").agg(
        F.count_if(F.col("status") == "read").alias("loaded"), F.count("*").alias("expected"), (F.count_if((F.col("status") == "read") & F.col("role").isin(*needed)) == len(needed)).alias("audit_ready")
    )
    return each.join(totals, "issue_prefix")
