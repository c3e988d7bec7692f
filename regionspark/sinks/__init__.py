"""Sinks: check logs, edit logs, exports, documents, and publishing that is staged, verified and can be rolled back."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import export_path

#: Columns of the check log and of the edit log, in order.
CHECK_COLUMNS = (
    "image_path", "input_mask_path", "edited_mask_path", "colmap_mask_path", "status", "width", "height", "mask_width", "mask_height",
    "mask_ratio", "has_intermediate_values", "is_empty_mask", "is_full_mask", "note",
)


def check_log(entries: DataFrame) -> DataFrame:
    """Rows of the check log, all as text: entries (rel_path, mask_path, exported, status and the facts of the check, which
    are null for what is not checked); ratios have four places (half to even), what is not checked needs it and has no facts."""
    checked = F.col("status").isNotNull()

    def fact(c: Column) -> Column:
        return F.when(checked, F.coalesce(c, F.lit(""))).otherwise("")

    def flag(c: str) -> Column:
        return F.initcap(F.col(c).cast("string"))

    return entries.select(
        F.concat(F.lit("images/"), F.col("rel_path")).alias("image_path"),
        F.coalesce("mask_path", F.lit("")).alias("input_mask_path"),
        F.lit("").alias("edited_mask_path"),
        F.when(F.col("exported"), export_path(F.col("rel_path"))).otherwise("").alias("colmap_mask_path"),
        F.coalesce("status", F.lit("needs_check")).alias("status"),
        *[fact(F.col(c).cast("string")).alias(c) for c in ("width", "height", "mask_width", "mask_height")],
        fact(F.format_string("%.4f", F.bround("mask_ratio", 4))).alias("mask_ratio"),
        *[fact(flag(c)).alias(c) for c in ("has_intermediate_values", "is_empty_mask", "is_full_mask")],
        fact(F.col("note")).alias("note"),
    )


def write_check_log(entries: DataFrame, folder: str) -> None:
    check_log(entries).write.mode("overwrite").option("header", True).csv(folder)


def append_edit_log(rows: DataFrame, folder: str) -> None:
    """Adds rows to an edit log; a file of each append has its own header."""
    rows.write.mode("append").option("header", True).csv(folder)


def export_counts(entries: DataFrame, masks: DataFrame) -> DataFrame:
    """How many entries (rel_path, mask_path) an export writes and how many it cannot: without a mask or with one that is
    not readable (masks: mask_path, readable)."""
    joined = entries.join(masks.select("mask_path", "readable"), "mask_path", "left")
    good = F.coalesce("readable", F.lit(False))
    return joined.agg(F.count_if(good).alias("written"), F.count_if(~good).alias("failed"))


def old_files(files: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Files (path, changed) that a clean-up deletes."""
    return files.filter(F.col("changed") < now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def upserted(rows: DataFrame, changes: DataFrame, key: list[str], allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A table with changed rows in place of those of the same key; values outside the allowed ones raise an error."""
    for column, values in (allowed or {}).items():
        wrong = F.raise_error(F.concat(F.lit(f"not allowed in {column}: "), F.col(column))).cast("string")
        changes = changes.withColumn(column, F.when(F.col(column).isin(*values), F.col(column)).otherwise(wrong))
    return rows.join(changes.select(*key), key, "left_anti").unionByName(changes)


def image_documents(images: DataFrame, segments: DataFrame) -> DataFrame:
    """One JSON document for each image (image, width, height): its segment ids in order, and a decision for each."""
    ids = segments.groupBy("image").agg(F.array_sort(F.collect_list("sid")).alias("segment_ids"))
    joined = images.join(ids, "image", "left").withColumn("segment_ids", F.coalesce("segment_ids", F.array().cast("array<bigint>")))
    decisions = F.map_from_arrays(F.transform("segment_ids", lambda i: i.cast("string")), F.transform("segment_ids", lambda i: F.lit("unreviewed")))
    document = F.struct("image", "width", "height", F.size("segment_ids").alias("segment_count"), "segment_ids", decisions.alias("decisions"))
    return joined.select("image", F.to_json(document).alias("document"))


def frame_documents(frames: DataFrame, job: str, *fields: str) -> DataFrame:
    """One JSON document for each job: its frames in order of their index, and how many there are."""
    rows = F.array_sort(F.collect_list(F.struct("frame_index", *fields)))
    grouped = frames.groupBy(job).agg(rows.alias("frames"))
    return grouped.select(job, F.to_json(F.struct(job, F.size("frames").alias("frame_count"), "frames")).alias("document"))


class Files:
    """The files under a path, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def move(self, a: str, b: str) -> None:
        self.fs.mkdirs(self.path(b).getParent())
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"cannot move {a} to {b}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """A document that is there as a whole or not at all: it is written beside its place and moved."""
    files, beside = Files(spark, path), f"{path}.{uuid.uuid4().hex}.tmp"
    files.write(beside, json.dumps(document, ensure_ascii=False, indent=2))
    if files.exists(path):
        files.delete(path)
    files.move(beside, path)


@dataclass(frozen=True)
class Target:
    """A table to publish: its rows, its place, and what must hold of the staged rows (they come back in error if not)."""

    rows: DataFrame
    path: str
    problems: Callable[[DataFrame], DataFrame] | None = None


def publish(spark: SparkSession, targets: Iterable[Target], work: str) -> str:
    """Publishes all targets or none, and returns the path of an undo record.

    1. All tables are written to a staging folder and verified there. 2. What is in place moves to a backup, what is
    staged moves into place; if a move fails, those that were done are taken back. 3. The record of places and backups is
    written, with which ``undo`` restores what was there."""
    files, run = Files(spark, work), uuid.uuid4().hex
    staged = []
    try:
        for i, target in enumerate(targets):
            beside = f"{work}/{run}/staged/{i}"
            target.rows.write.parquet(beside)
            staged.append((target.path, beside, f"{work}/{run}/backup/{i}"))
            if target.problems is not None and not target.problems(spark.read.parquet(beside)).isEmpty():
                raise ValueError(f"the rows for {target.path} are not valid")
    except Exception:
        files.delete(f"{work}/{run}")
        raise
    done: list[dict] = []
    try:
        for path, beside, backup in staged:
            step = {"path": path, "existed": files.exists(path), "backup": backup, "placed": False}
            if step["existed"]:
                files.move(path, backup)
            done.append(step)
            files.move(beside, path)
            step["placed"] = True
    except Exception:
        _restore(files, done)
        files.delete(f"{work}/{run}")
        raise
    record = f"{work}/{run}/undo.json"
    write_json(spark, record, {"targets": done})
    return record


def undo(spark: SparkSession, record: str) -> None:
    """Restores what was in place before a publication."""
    files = Files(spark, record)
    _restore(files, json.loads(files.read(record))["targets"])


def _restore(files: Files, done: list[dict]) -> None:
    for step in reversed(done):
        if step["placed"]:
            files.delete(step["path"])
        if step["existed"]:
            files.move(step["backup"], step["path"])
