"""Jobs over images with injected kernels, dispatch of commands, and views that are made again only when stale."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import Files, write_json

RESULT = "image_key string, status string, error_code string, message string, batch_used int, retries int, seconds double, segments array<struct<{}>>"

#: Images whose results a task holds at once.
TOGETHER = 32


class ImageLoadError(Exception):
    """An image cannot be read."""


class InvalidRuns(ValueError):
    """A kernel's run lengths do not hold."""


def code_of(problem: Exception) -> str:
    """The error code of a failure."""
    if isinstance(problem, ImageLoadError):
        return "IMAGE_LOAD_FAILED"
    if isinstance(problem, InvalidRuns):
        return "RLE_INVALID"
    return "GPU_OOM" if isinstance(problem, MemoryError) else "GENERATION_FAILED"


def each_image(
    images: DataFrame,
    load: Callable[[str], object],
    generate: Callable[[object, int], list[dict]],
    segment: str,
    batch: int = 64,
    retry: bool = True,
    reclaim: Callable[[], None] | None = None,
    every: int = 8,
) -> DataFrame:
    """One row for each image (image_key, path) with the segments that ``generate`` makes of what ``load`` gives, or with
    the code of its failure; a failing image stops no other.

    When memory runs out the batch halves and the image is tried again, down to 1. ``reclaim`` runs before each such try
    and after every ``every`` images of a task. ``segment``: the fields of a segment, as in a schema string. The caller
    leaves out images whose stored result holds (``review.review_items``) and stops a job by cancelling Spark's job group,
    which keeps what is written and drops the images that run."""
    names = [c.split()[0] for c in RESULT.split(", ")][:8]

    def one(key: str, path: str) -> tuple:
        began, used, tries = time.time(), batch, 0
        try:
            try:
                image = load(path)
            except Exception as problem:
                raise ImageLoadError(str(problem)) from problem
            while True:
                try:
                    made = generate(image, used)
                    return key, "ready", None, None, used, tries, time.time() - began, made
                except MemoryError:
                    if reclaim:
                        reclaim()
                    if not retry or used <= 1:
                        raise
                    used, tries = max(1, used // 2), tries + 1
        except Exception as problem:  # a failure is a row of the result
            return key, "failed", code_of(problem), str(problem), used, tries, time.time() - began, None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        since = 0
        for part in parts:
            for key, path in zip(part["image_key"], part["path"], strict=True):
                done.append(one(key, path))
                since += 1
                if reclaim and since >= every:
                    since = 0
                    reclaim()
                if len(done) >= TOGETHER:
                    yield pd.DataFrame(done, columns=names)
                    done = []
        if done:
            yield pd.DataFrame(done, columns=names)

    return images.select("image_key", "path").mapInPandas(run, RESULT.format(segment))


def dispatched(messages: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], columns: list[str]) -> DataFrame:
    """Messages (command and others), each answered by the handler of its command; a handler takes the rows of its command
    and returns ``columns`` (request_id, status and error_code among them). Unknown commands get an error."""
    unknown = messages.filter(~F.coalesce(F.col("command").isin(list(handlers)), F.lit(False)))
    told = {"status": F.lit("error"), "error_code": F.lit("UNKNOWN_COMMAND")}
    out = unknown.select(*[told[c].alias(c) if c in told else F.col(c) if c in messages.columns else F.lit(None).alias(c) for c in columns])
    for command, handler in handlers.items():
        out = out.unionByName(handler(messages.filter(F.col("command") == command)).select(*columns))
    return out


def memoised(spark: SparkSession, folder: str, keys: dict[str, str], build: Callable[[], DataFrame], force: bool = False) -> tuple[DataFrame, str]:
    """The rows of ``build``, stored in a folder under keys (hashes of its source and settings), and ``reused`` or
    ``built``. They are made again if asked for, if a key differs, or if what is stored cannot be read. The keys are
    written last, so a build that stops half way counts as missing."""
    files, rows, note = Files(spark, folder), f"{folder}/rows", f"{folder}/keys.json"
    if not force and files.exists(note):
        try:
            stored = json.loads(files.read(note))
            found = spark.read.parquet(rows)
            if stored["keys"] == keys and found.count() == stored["rows"]:
                return found, "reused"
        except Exception:  # what is broken, in any way, is made again
            pass
    files.delete(note)
    build().write.mode("overwrite").parquet(rows)
    made = spark.read.parquet(rows)
    write_json(spark, note, {"keys": keys, "rows": made.count()})
    return made, "built"
