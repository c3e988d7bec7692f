"""Keys, hashes and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cache_id(key: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a key's UTF-8."""
    return F.substring(F.sha2(key, 256), 1, 16)


def natural_key(name: Column) -> Column:
    """A string that sorts as the name with its digit runs compared as numbers and its letters in lower case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def numbered(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(p)

    padded = F.transform(parts, numbered)
    return F.array_join(padded, "")


def safe_name(index: Column, name: Column, width: int = 6) -> Column:
    """Zero-padded index, longer ones whole, two underscores, the name with path separators replaced, and .png."""
    number = F.when(index.isNotNull(), F.format_string(f"%0{width}d", index.cast("long")))
    return F.concat(number, F.lit("__"), F.translate(name, "/\\:", "___"), F.lit(".png"))
