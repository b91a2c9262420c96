"""Audits of train, validation and test roles, and splits sealed by a digest.

Leaks of labels are counted by a sweep along time: block starts and label ends are events, and the latest
stop of the blocks begun so far decides whether a label reaches into one. No label meets every block.

A sealed split is one row whose ``body`` is canonical JSON (keys in order, no blanks) with settings, bounds
and counts, chained to the digest of the data it was cut from. What a partition holds follows from the body
alone, so it can be read back from the data without a stored membership.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.operators.scan import running, running_max
from tapeframe.operators.splits import Block, Fold, PurgeConfig, _verdict, with_label_interval

# Roles in time order, each kept apart from the later ones.
ROLES = ("train", "validation", "test")
PAIRS = tuple((a, b) for i, a in enumerate(ROLES) for b in ROLES[i + 1:])
SPEC_VERSION = "1.0.0"


def rows_in_two_roles(members: DataFrame, row_id: str) -> DataFrame:
    """(split_index, earlier, later, n_rows): rows that two roles of a split share."""
    roles = members.where(F.col("role").isin(*ROLES)).groupBy("split_index", row_id).agg(
        *[F.max((F.col("role") == r).cast("int")).alias(r) for r in ROLES])
    shared = F.array(*[F.when((F.col(a) == 1) & (F.col(b) == 1), F.struct(F.lit(a).alias("earlier"), F.lit(b).alias("later"))) for a, b in PAIRS])
    return roles.select("split_index", F.explode(F.array_compact(shared)).alias("p")).groupBy("split_index", "p.earlier", "p.later").agg(
        F.count(F.lit(1)).alias("n_rows"))


def repeated_in_role(members: DataFrame, row_id: str) -> DataFrame:
    """(split_index, role, n_rows): rows that one role of a split holds more than once."""
    return members.groupBy("split_index", "role", row_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy(
        "split_index", "role").agg(F.count(F.lit(1)).alias("n_rows"))


def label_leaks(members: DataFrame, blocks: DataFrame, ts: str) -> DataFrame:
    """(split_index, earlier, later, n_rows): rows of a role whose label [ts, label_end_ns] reaches into a block
    [block_start, block_stop) of a later role. ``blocks`` has split_index, role and the bounds; blocks of a role
    may overlap."""
    later = F.create_map(*[x for r in ROLES[:-1] for x in (F.lit(r), F.array(*[F.lit(b) for a, b in PAIRS if a == r]))])
    ends = members.where(F.col("role").isin(*ROLES[:-1]) & F.col("label_end_ns").isNotNull()).select(
        "split_index", F.col("role").alias("earlier"), F.explode(later[F.col("role")]).alias("later"), F.col("label_end_ns").alias("at"),
        F.lit(1).alias("kind"), F.col(ts).alias("begun"), F.lit(None).cast("long").alias("stop"))
    starts = blocks.where("block_start < block_stop").select(
        "split_index", F.lit(None).cast("string").alias("earlier"), F.col("role").alias("later"), F.col("block_start").alias("at"),
        F.lit(0).alias("kind"), F.lit(None).cast("long").alias("begun"), F.col("block_stop").alias("stop"))
    swept = running(ends.unionByName(starts), ["split_index", "later"], ["at", "kind"], __reach=running_max("stop"))
    return swept.where((F.col("kind") == 1) & (F.col("__reach") > F.col("begun"))).groupBy("split_index", "earlier", "later").agg(
        F.count(F.lit(1)).alias("n_rows"))


def role_audit(members: DataFrame, blocks: DataFrame, row_id: str, ts: str) -> DataFrame:
    """One row per split and pair of roles with any leak: rows in both, and labels that reach across."""
    both = rows_in_two_roles(members, row_id).withColumnRenamed("n_rows", "in_both")
    leaks = label_leaks(members, blocks, ts).withColumnRenamed("n_rows", "label_leaks")
    return both.join(leaks, ["split_index", "earlier", "later"], "full").na.fill(0)


def seal_split(
    members: DataFrame, folds: DataFrame, ts: str, split_type: str, dataset_id: str, dataset_hash: str, settings: dict[str, int | str],
    purge: PurgeConfig,
) -> DataFrame:
    """(body, content_hash): one row that seals a split.

    ``members`` is the split's membership, of which bounds and counts are taken; ``folds`` its test blocks
    (``splits.fold_table``). Both come down to a row per fold before they are put together.
    """
    def count(role: str):
        return F.count_if(F.col("role") == role).alias(f"{role}_rows")

    per_fold = members.groupBy("split_index").agg(
        count("embargoed"), count("purged"), count("test"), count("train"),
        F.min(F.when(F.col("role") == "train", F.col(ts))).alias("train_start"),
        (F.max(F.when(F.col("role") == "train", F.col(ts))) + 1).alias("train_stop"))
    tests = folds.groupBy("split_index").agg(F.array_sort(F.collect_list(F.struct("test_position", "block_start", "block_stop"))).alias("t"))
    block = F.transform("t", lambda b: F.struct(b["block_start"].alias("start"), b["block_stop"].alias("stop")))
    each = per_fold.join(tests, "split_index").select(F.struct(
        "split_index", F.struct("embargoed_rows", "purged_rows", block.alias("test"), "test_rows", "train_rows", "train_start", "train_stop").alias("f")).alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(
        s["f"]["embargoed_rows"].alias("embargoed_rows"), s["f"]["purged_rows"].alias("purged_rows"), s["split_index"].alias("split_index"),
        s["f"]["test"].alias("test"), s["f"]["test_rows"].alias("test_rows"), s["f"]["train_rows"].alias("train_rows"),
        s["f"]["train_start"].alias("train_start"), s["f"]["train_stop"].alias("train_stop")))
    span = members.where("role in ('train', 'test', 'purged', 'embargoed')").agg(F.min(ts).alias("a"), (F.max(ts) + 1).alias("b")).first()
    config = {**settings, "embargo_ns": purge.embargo_ns, "purge_horizon_ns": purge.purge_horizon_ns, "timestamp_column": ts}
    body = F.struct(
        F.struct(*[F.lit(v).alias(k) for k, v in sorted(config.items())]).alias("config"), F.lit(dataset_hash).alias("dataset_hash"),
        F.lit(dataset_id).alias("dataset_id"), F.lit(SPEC_VERSION).alias("spec_version"), F.lit(split_type).alias("split_type"), ordered.alias("splits"),
        F.lit(span["a"]).alias("time_start"), F.lit(span["b"]).alias("time_stop"))
    return each.agg(F.to_json(body).alias("body")).withColumn("content_hash", F.sha2("body", 256))


def is_sealed(sealed: DataFrame) -> DataFrame:
    """``sealed`` with ``is_sealed``: the body is the one the digest was made of."""
    return sealed.withColumn("is_sealed", F.sha2("body", 256) == F.lower("content_hash"))


def read_partition(df: DataFrame, sealed: DataFrame, split_index: int, role: str, horizon: int | str, dataset_hash: str | None = None) -> DataFrame:
    """The rows of ``df`` that have ``role`` in a fold of a sealed split whose folds are test blocks with purging
    and embargo. The bounds become filters of the scan. A broken seal, or data of another digest, is an error."""
    row = is_sealed(sealed).first()
    if not row.is_sealed:
        raise ValueError("the split's body does not match its digest")
    body = json.loads(row.body)
    if dataset_hash is not None and dataset_hash != body["dataset_hash"]:
        raise ValueError("the split was cut from other data")
    fold = next(s for s in body["splits"] if s["split_index"] == split_index)
    config, ts = body["config"], body["config"]["timestamp_column"]
    blocks = tuple(Block(0, 0, b["start"], b["stop"]) for b in fold["test"])
    purge = PurgeConfig(config["purge_horizon_ns"], config["embargo_ns"])
    bounds = {"test": (blocks[0].start, blocks[-1].stop), "train": (fold.get("train_start"), fold.get("train_stop"))}.get(
        role, (body["time_start"], body["time_stop"]))
    if bounds[0] is None:
        return df.limit(0)
    near = df.where((F.col(ts) >= bounds[0]) & (F.col(ts) < bounds[1]))
    verdict = F.expr(_verdict(f"`{ts}`", Fold(split_index, blocks, None, None), purge))
    return with_label_interval(near, ts, horizon).where(verdict == role).select(*df.columns)
