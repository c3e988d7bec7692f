"""Sources: project folders, camera registration lists and mask files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that count as images, in all-lower and all-upper case.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".JPG", ".JPEG", ".PNG")


def registered_names(spark: SparkSession, path: str) -> DataFrame:
    """Names in a registration list, with their order: lines that begin with # drop out, of the others every first of
    two holds at least ten fields, the tenth of which is the name (a name ends at its first space)."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"))
    kept = lines.select(F.posexplode(F.filter("lines", lambda line: ~line.startswith("#"))).alias("i", "line"))
    fields = F.split(F.btrim("line"), r"\s+")
    return kept.filter((F.col("i") % 2 == 0) & (F.size(fields) >= 10)).select((F.col("i") / 2).cast("long").alias("registration_index"), fields[9].alias("name"))


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """Files under a folder that are images: path relative to it, size and time of the last change; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    relative = F.regexp_extract("path", f"^.*?/{re.escape(root.rstrip('/').rsplit('/', 1)[-1])}/(.*)$", 1)
    wanted: Column = F.lit(False)
    for extension in EXTENSIONS:
        wanted |= F.col("path").endswith(extension)
    return files.filter(wanted).select(relative.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def project(images: DataFrame, registered: DataFrame) -> DataFrame:
    """Images with a flag of registration (by relative path or by base name) and their place: registered ones first, by
    path within both."""
    names = registered.select(F.col("name").alias("rel_path")).distinct().withColumn("by_path", F.lit(True))
    bases = registered.select(F.col("name").alias("base")).distinct().withColumn("by_base", F.lit(True))
    base = F.regexp_extract("rel_path", r"([^/]*)$", 1)
    joined = images.withColumn("base", base).join(names, "rel_path", "left").join(bases, "base", "left")
    flagged = joined.withColumn("registered", F.coalesce("by_path", F.lit(False)) | F.coalesce("by_base", F.lit(False)))
    return flagged.drop("by_path", "by_base", "base").orderBy(F.desc("registered"), "rel_path")


def mask_paths(images: DataFrame, masks: DataFrame) -> DataFrame:
    """The mask of each image: name.ext.png before stem.png before the same name; null without one."""
    path = F.col("rel_path")
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    candidates = F.array(F.concat(path, F.lit(".png")), F.concat(stem, F.lit(".png")), path)
    spread = images.select("rel_path", F.posexplode(candidates).alias("priority", "mask_path"))
    found = spread.join(masks.select(F.col("rel_path").alias("mask_path")).distinct(), "mask_path")
    best = found.groupBy("rel_path").agg(F.min_by("mask_path", "priority").alias("mask_path"))
    return images.join(best, "rel_path", "left")


def array_stores(spark: SparkSession, paths: str) -> DataFrame:
    """Stores of named arrays (.npz): one row for each array with its type, shape and values as text-free doubles or longs.

    Columns: path, name, dtype, shape, longs, doubles. Arrays of objects are refused, as are broken files: they give one
    row with a problem."""
    import io

    import numpy as np
    import pandas as pd

    def read(parts):
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as store:
                        for name in store.files:
                            a = store[name]
                            whole = a.dtype.kind in "iub"
                            rows.append((path, name, str(a.dtype), list(a.shape), a.ravel().astype("int64").tolist() if whole else None, a.ravel().astype("float64").tolist() if a.dtype.kind == "f" else None, None))
                except Exception as problem:  # any fault of a file is a row, not a failed job
                    rows.append((path, None, None, None, None, None, type(problem).__name__))
            yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape", "longs", "doubles", "problem"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(read, "path string, name string, dtype string, shape array<long>, longs array<long>, doubles array<double>, problem string")


def predictions(stores: DataFrame, request_id: int | None = None, most: int = 3) -> DataFrame:
    """Candidates of prediction stores (arrays masks of three dimensions and scores): index, score, foreground pixels and
    share; at most ``most`` of each. Stores without the arrays, with different counts or of another request give none."""
    masks = stores.filter("name = 'masks' and size(shape) = 3").select("path", "shape", F.col("longs").alias("masks"))
    scores = stores.filter("name = 'scores'").select("path", F.col("doubles").alias("scores"))
    ids = stores.filter("name = 'request_id'").select("path", F.get("longs", F.lit(0)).alias("request_id"))
    joined = masks.join(scores, "path").join(ids, "path", "left").filter(F.get("shape", F.lit(0)) == F.size("scores"))
    if request_id is not None:
        joined = joined.filter(F.col("request_id") == request_id)
    size = (F.get("shape", F.lit(1)) * F.get("shape", F.lit(2))).cast("int")
    one = joined.select("path", "masks", size.alias("n"), F.posexplode(F.slice("scores", 1, most)).alias("index", "score"))
    own = F.slice("masks", F.col("index") * F.col("n") + 1, F.col("n"))
    least = F.when(F.array_max(own) == 1, 1).otherwise(128)
    pixels = F.size(F.filter(own, lambda v: v >= least)).cast("long")
    return one.select("path", F.col("index").cast("long").alias("index"), "score", pixels.alias("foreground"), (pixels / F.col("n")).alias("share"))


def documents(spark: SparkSession, paths: str, schema: str) -> DataFrame:
    """JSON documents, one to a file, with the file's path; a file that does not parse has a null document."""
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    broken = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}).isNull()
    return texts.select("path", F.when(~broken, parsed).alias("document"))


def settings(stored: DataFrame, defaults: dict[str, tuple[int, int, int]]) -> DataFrame:
    """Settings (key, value as text) as numbers: the default where one is missing or no number, within its limits.
    ``defaults``: key to (default, lowest, highest)."""
    rows = [(k, *v) for k, v in defaults.items()]
    known = stored.sparkSession.createDataFrame(rows, "key string, default int, low int, high int")
    joined = F.broadcast(known).join(stored, "key", "left")
    value = F.coalesce(F.col("value").try_cast("int"), F.col("default"))
    return joined.select("key", F.greatest("low", F.least("high", value)).alias("value"))
