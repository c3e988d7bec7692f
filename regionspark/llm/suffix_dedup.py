"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A suffix matters only through its first ``DEPTH`` bytes, its window; two suffixes are equal to that depth exactly when
their windows repeat. Suffixes are ordered by most-significant-digit passes in which what is alone in its group drops
out, so that the bytes of most suffixes never move:

1. First digit. Every window has a deciding gram, the leftmost of the smallest hashes of its 32-byte grams, and an
   offset to it. Equal windows have equal grams at equal offsets, so the gram's hash is the bucket of the first pass.
   Consecutive windows with one deciding gram form a run and travel as one row: bucket, hash of the run's bytes,
   place. Runs of equal bytes in one task fold before the shuffle, and a bucket sends at most two rows from a batch, so
   a passage in a third of all documents reaches a task as a few rows for each batch of documents. Of runs with equal
   bytes all but the first are settled. Runs alone in their bucket drop out.
2. Further digits. What is left (different runs in one bucket, as at the ends of a passage) fetches its bytes, and the
   windows are split by eight bytes at a time, pass by pass; groups of one drop out after each pass, and what is still
   together after all digits is a repeated window. A bucket with more than ``CROWD`` different runs goes by window
   instead: 128-bit digests of its windows, folded in each task before the shuffle.
3. A window that also starts earlier is marked; the marked windows of a document merge into spans, which are removed.

Earlier means a smaller id or an earlier start in one document; removal never changes what counts as repeated.

Defined cases: a null text counts as empty; texts under ``DEPTH`` bytes lose nothing; null ids come last; rows that
repeat id and text are one document and get the same result; rows that share an id with different texts are ordered
by a hash of the text; an empty table gives an empty table. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held, tidied

DEPTH, GRAM = 100, 32
WINDOW = DEPTH - GRAM + 1
CROWD = 2_000
#: Bytes handled at once, and runs of windows that a task folds at once.
BLOCK, FOLD = 1 << 19, 500_000
#: Documents that a filter may be broadcast for.
BROADCAST_ROWS = 400_000
LAST = (1 << 63) - 1

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
NOTICE, ONE, MANY, MARK, WINDOWS = 0, 1, 2, 3, 4


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of an odd base and of its inverse (mod 2^64)."""
    base = int(BASE) ^ (seed << 1)
    inverse = pow(base, -1, 1 << 64)
    of_byte = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[U(1)], np.full(BLOCK + 256, U(base))]), dtype=U)
        down = np.cumprod(np.concatenate([[U(1)], np.full(BLOCK + 256, U(inverse))]), dtype=U)
    return of_byte, up, down


def tables(seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    made = held("hash tables", dict)
    if seed not in made:
        made[seed] = _tables(seed)
    return made[seed]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


class Sums:
    """Prefix sums of one block of bytes, from which the hash of any part follows."""

    def __init__(self, block: np.ndarray, seed: int = 1) -> None:
        of_byte, up, self.down = tables(seed)
        terms = of_byte[block]
        terms *= up[: len(block)]
        self.sums = np.concatenate([[U(0)], np.cumsum(terms, dtype=U)])

    def every(self, width: int) -> np.ndarray:
        part = self.sums[width:] - self.sums[:-width]
        part *= self.down[: len(part)]
        return mixed(part)

    def parts(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def runs(block: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one deciding gram: bucket, hash of the bytes, first start, last start, gram. ``valid`` are
    the rising starts of the windows that do not leave their document."""
    sums = Sums(block)
    grams = sums.every(GRAM)
    place = U(BLOCK - 1)
    least = (grams & ~place) | np.arange(len(grams), dtype=U)
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    decides = (least[valid] & place).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (decides[1:] != decides[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    first, last, gram = valid[new], valid[np.append(new[1:] - 1, len(valid) - 1)], decides[new]
    shape = ((gram - first) << 7 | (last - first)).astype(U)
    content = mixed(sums.parts(first, last + DEPTH) + shape * U(0xD6E8FEB86659FD93))
    return grams[gram].view(np.int64), content.view(np.int64), first, last, gram


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of some texts, starts of their windows, and for each window start the text's number and the start in it.
    Long texts come in parts that overlap by DEPTH - 1."""
    held: list[bytes] = []
    numbers: list[int] = []
    shifts: list[int] = []
    size = 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(b) for b in held])
        starts = np.cumsum(lengths) - lengths
        count = lengths - DEPTH + 1
        owner = np.repeat(np.arange(len(held)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.frombuffer(b"".join(held), dtype=np.uint8), starts[owner] + inside, np.array(numbers)[owner], np.array(shifts)[owner] + inside

    for number, text in enumerate(texts):
        for at in range(0, max(0, len(text) - DEPTH + 1), BLOCK - DEPTH):
            part = text[at : at + BLOCK - 1]
            if size + len(part) >= BLOCK:
                yield made()
                held, numbers, shifts, size = [], [], [], 0
            held.append(part)
            numbers.append(number)
            shifts.append(at)
            size += len(part)
    if held:
        yield made()


def packed(first: np.ndarray, last: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return first << 14 | (last - first) << 7 | (gram - first)


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = at >> 14
    return first, first + (at >> 7 & 127), first + (at & 127)


def joined_spans(doc: np.ndarray, sub: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Marked starts of the same document that touch become one span."""
    if not len(doc):
        return doc, sub, lo, hi
    order = np.lexsort((lo, sub, doc))
    doc, sub, lo, hi = doc[order], sub[order], lo[order], hi[order]
    change = np.concatenate([[True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])])
    group = np.cumsum(change)
    reach = np.maximum.accumulate(hi + group * (np.int64(1) << 42)) - group * (np.int64(1) << 42)
    new = change.copy()
    new[1:] |= lo[1:] > reach[:-1] + 1
    at = np.flatnonzero(new)
    return doc[at], sub[at], lo[at], reach[np.append(at[1:] - 1, len(lo) - 1)]


def batch(kind: int, **columns: np.ndarray) -> dict[str, np.ndarray]:
    n = len(next(iter(columns.values())))
    empty = np.zeros(n, dtype=np.int64)
    return {"k": empty, "kind": np.full(n, kind, dtype=np.int64), "c": empty, "doc": empty, "sub": empty, "at": empty, "upto": empty} | columns


ROWS = ("k", "kind", "c", "doc", "sub", "at", "upto")
ROW_TYPE = "k long, kind long, c long, doc long, sub long, at long, upto long"


def as_batches(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        if len(part["k"]):
            yield pa.RecordBatch.from_arrays([pa.array(part[c]) for c in ROWS], names=list(ROWS))


def spread(doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A key that deals marks out evenly."""
    return mixed(doc.astype(U) * U(31) + lo.astype(U)).view(np.int64)


def marks(doc: np.ndarray, sub: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
    doc, sub, lo, hi = joined_spans(doc, sub, lo, hi)
    return batch(MARK, k=spread(doc, lo), doc=doc, sub=sub, at=lo, upto=hi)


def fold(bucket: np.ndarray, content: np.ndarray, doc: np.ndarray, sub: np.ndarray, at: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Folds the runs of one task's batch: later runs of equal bytes are marked; buckets with several different runs
    send these by content and one notice, the others send their run by bucket."""
    order = np.lexsort((at, sub, doc, content, bucket))
    bucket, content, doc, sub, at = (x[order] for x in (bucket, content, doc, sub, at))
    new_bucket = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    new = new_bucket | np.concatenate([[True], content[1:] != content[:-1]])
    owner = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = ~new & ((doc != doc[owner]) | (sub != sub[owner]) | (at != at[owner]))
    lo, hi, _ = unpacked(at[later])
    out = [marks(doc[later], sub[later], lo, hi)]
    kinds = np.bincount(np.cumsum(new_bucket)[new] - 1)
    several = (kinds > 1)[np.cumsum(new_bucket) - 1]
    one, many, told = new & ~several, new & several, new_bucket & several
    out.append(batch(ONE, k=bucket[one], c=content[one], doc=doc[one], sub=sub[one], at=at[one]))
    out.append(batch(MANY, k=content[many], c=bucket[many], doc=doc[many], sub=sub[many], at=at[many]))
    out.append(batch(NOTICE, k=bucket[told]))
    return out


def first_pass(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ROW_TYPE from batches of (doc, sub, text)."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    with np.errstate(over="ignore"):
        for part in parts:
            doc, sub = np.asarray(part.column(0)), np.asarray(part.column(1))
            texts = [t.as_py() or b"" for t in part.column(2).cast(pa.binary())]
            for block, valid, number, inside in blocks(texts):
                bucket, content, first, last, gram = runs(block, valid)
                where = np.searchsorted(valid, first)
                at = packed(inside[where], inside[where] + last - first, inside[where] + gram - first)
                held.append((bucket, content, doc[number[where]], sub[number[where]], at))
                size += len(at)
                if size >= FOLD:
                    yield from as_batches(fold(*(np.concatenate(x) for x in zip(*held, strict=True))))
                    held, size = [], 0
        if held:
            yield from as_batches(fold(*(np.concatenate(x) for x in zip(*held, strict=True))))


def by_key(parts: Iterator[pa.RecordBatch], names: tuple[str, ...], least: int) -> Iterator[dict[str, np.ndarray | pa.Array]]:
    """Tables of about ``least`` rows, sorted by k, that never cut the rows of one k."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in parts:
        held.append(part)
        size += part.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = np.asarray(table["k"])
        upto = int(np.searchsorted(key, key[-1]))  # sorted by k
        if upto:
            yield {c: table[c].slice(0, upto).combine_chunks() for c in names}
            rest = table.slice(upto).combine_chunks()
            held, size = rest.to_batches(), rest.num_rows
    if held and size:
        table = pa.Table.from_batches(held).combine_chunks()
        yield {c: table[c].combine_chunks() for c in names}


def settle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks, and the runs that further digits decide (kind MANY: k is the bucket), from rows sorted by k, kind, c, doc,
    sub and at."""
    for table in by_key(parts, ROWS, 100_000):
        t = {c: np.asarray(table[c]) for c in ROWS}
        given = t["kind"] == MARK
        out = [batch(MARK, k=t["k"][given], doc=t["doc"][given], sub=t["sub"][given], at=t["at"][given], upto=t["upto"][given])]
        new_key = np.concatenate([[True], t["k"][1:] != t["k"][:-1]])
        key_no = np.cumsum(new_key) - 1
        run = (t["kind"] == ONE) | (t["kind"] == MANY)
        new = new_key | np.concatenate([[True], (t["kind"][1:] != t["kind"][:-1]) | (t["c"][1:] != t["c"][:-1])])
        owner = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = run & ~new & ((t["doc"] != t["doc"][owner]) | (t["sub"] != t["sub"][owner]) | (t["at"] != t["at"][owner]))
        lo, hi, _ = unpacked(t["at"][later])
        out.append(marks(t["doc"][later], t["sub"][later], lo, hi))
        one, many = new & (t["kind"] == ONE), new & (t["kind"] == MANY)
        crowd = np.bincount(key_no, weights=one | (t["kind"] == NOTICE) * 2)[key_no] > 1
        one &= crowd
        bucket = np.concatenate([t["k"][one], t["c"][many]])
        rest = {c: np.concatenate([t[c][one], t[c][many]]) for c in ("doc", "sub", "at")}
        out.append(batch(MANY, k=bucket, **rest))
        yield from as_batches(out)


CONTEXT = "k long, kind long, c long, doc long, sub long, at long, upto long, bytes binary"


def contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (doc, sub, text, undecided runs as arrays of bucket, place and crowded) the bytes of each run, or for
    crowded buckets the digests of its windows."""

    def made(part: dict[str, np.ndarray], own: pa.Array) -> Iterator[pa.RecordBatch]:
        if len(part["k"]):
            yield pa.RecordBatch.from_arrays([*(pa.array(part[c]) for c in ROWS), own], names=[*ROWS, "bytes"])

    with np.errstate(over="ignore"):
        for part in parts:
            k, doc, sub, at, own = [], [], [], [], []
            crowded: list[tuple[np.ndarray, ...]] = []
            for d, s, text, list_k, list_at, list_crowded in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                raw = (text or "").encode()
                block = np.frombuffer(raw, dtype=np.uint8)
                for bucket, place, many in zip(list_k, list_at, list_crowded, strict=True):
                    first = place >> 14
                    last = first + (place >> 7 & 127)
                    if many:
                        hull = block[first : last + DEPTH]
                        a, b = Sums(hull, 1).every(DEPTH), Sums(hull, 2).every(DEPTH)
                        n = len(a)
                        crowded.append((a.view(np.int64), b.view(np.int64), np.full(n, d), np.full(n, s), np.arange(first, last + 1)))
                    else:
                        k.append(bucket)
                        doc.append(d)
                        sub.append(s)
                        at.append(place)
                        own.append(raw[first : last + DEPTH])
            rows = {"k": k, "doc": doc, "sub": sub, "at": at}
            yield from made(batch(MANY, **{c: np.array(v, dtype=np.int64) for c, v in rows.items()}), pa.array(own, pa.binary()))
            if crowded:
                a, b, d, s, start = (np.concatenate(x) for x in zip(*crowded, strict=True))
                order = np.lexsort((start, s, d, b, a))
                a, b, d, s, start = (x[order] for x in (a, b, d, s, start))
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                owner = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = ~new & ((d != d[owner]) | (s != s[owner]) | (start != start[owner]))
                told = marks(d[later], s[later], start[later], start[later])
                yield from made(told, pa.nulls(len(told["k"]), pa.binary()))
                sent = batch(WINDOWS, k=a[new], c=b[new], doc=d[new], sub=s[new], at=start[new])
                yield from made(sent, pa.nulls(len(sent["k"]), pa.binary()))


def radix(bucket: np.ndarray, raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the DEPTH bytes from each start; elements come in the order of their places.
    Returns the elements that share a group after all passes and the first element of their group."""
    alive = np.arange(len(bucket))
    for d in range(-1, -(-DEPTH // 8)):
        if not len(alive):
            break
        if d >= 0:
            width = min(8, DEPTH - 8 * d)
            digit = np.zeros((len(alive), 8), dtype=np.uint8)
            digit[:, :width] = raw[(start[alive] + 8 * d)[:, None] + np.arange(width)]
            digit = digit.view(U)[:, 0]
            order = np.lexsort((alive, digit, bucket))
            alive, bucket, digit = alive[order], bucket[order], digit[order]
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (digit[1:] != digit[:-1])])
        else:
            order = np.lexsort((alive, bucket))
            alive, bucket = alive[order], bucket[order]
            new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        bucket = np.cumsum(new) - 1
        together = np.bincount(bucket)[bucket] > 1
        alive, bucket = alive[together], bucket[together]
    if not len(alive):
        return alive, alive
    new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    return alive, alive[np.flatnonzero(new)[np.cumsum(new) - 1]]


def further_passes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from rows of CONTEXT sorted by k, kind, c, doc, sub and at."""
    with np.errstate(over="ignore"):
        for table in by_key(parts, (*ROWS, "bytes"), 8_000):
            t = {c: np.asarray(table[c]) for c in ROWS}
            given = t["kind"] == MARK
            yield from as_batches([batch(MARK, k=t["k"][given], doc=t["doc"][given], sub=t["sub"][given], at=t["at"][given], upto=t["upto"][given])])
            windows = np.flatnonzero(t["kind"] == WINDOWS)
            if len(windows):
                w = {c: t[c][windows] for c in ROWS}
                new = np.concatenate([[True], (w["k"][1:] != w["k"][:-1]) | (w["c"][1:] != w["c"][:-1])])
                owner = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = ~new & ((w["doc"] != w["doc"][owner]) | (w["sub"] != w["sub"][owner]) | (w["at"] != w["at"][owner]))
                yield from as_batches([marks(w["doc"][later], w["sub"][later], w["at"][later], w["at"][later])])
            undecided = np.flatnonzero(t["kind"] == MANY)
            if not len(undecided):
                continue
            own = table["bytes"].take(pa.array(undecided))
            raw = np.frombuffer(b"".join(own.to_pylist()), dtype=np.uint8)
            first, last, gram = unpacked(t["at"][undecided])
            count = last - first + 1
            row = np.repeat(np.arange(len(undecided)), count)
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            size = count + DEPTH - 1
            base = np.cumsum(size) - size
            new_key = np.concatenate([[True], np.diff(t["k"][undecided]) != 0])
            offset = (gram - first)[row] - inside + WINDOW  # equal windows have their gram at the same offset
            bucket = (np.cumsum(new_key) - 1)[row] * 256 + offset
            doc, sub, start = t["doc"][undecided][row], t["sub"][undecided][row], first[row] + inside
            same, of = radix(bucket, raw, base[row] + inside)
            later = (doc[same] != doc[of]) | (sub[same] != sub[of]) | (start[same] != start[of])
            hit = same[later]
            yield from as_batches([marks(doc[hit], sub[hit], start[hit], start[hit])])


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, doc, sub, text, rest): doc orders the documents, sub tells rows apart that share an id but not the
    text; rest holds the other columns."""
    unique = docs.groupBy(F.col(id_col).alias("i")).agg(F.count("*").alias("n")).filter("n > 1 or i is null").isEmpty()
    text = F.coalesce(F.col(text_col), F.lit(""))
    sub: Column = F.lit(0).cast("long") if unique else F.xxhash64(text)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    rest = F.struct(F.lit(True).alias("there"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col])
    return docs.select(F.col(id_col).alias("id"), doc.alias("doc"), sub.alias("sub"), text.alias("text"), rest.alias("rest"))


def only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted documents; by a broadcast of the ids where their number is small, else by a shuffle."""
    wanted = wanted.select("doc", "sub").distinct()
    number = wanted.count()
    return rows.join(F.broadcast(wanted) if number <= BROADCAST_ROWS else wanted, ["doc", "sub"], "left_semi")


def marked_spans(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc, sub, at, upto): starts of windows that also start earlier, from rows (doc, sub, text)."""
    order = ("k", "kind", "c", "doc", "sub", "at")

    def dealt(df: DataFrame, task: Callable, kind: str) -> DataFrame:
        return df.repartition("k").sortWithinPartitions(*order).mapInArrow(tidied(task), kind)

    long_enough = rows.select("doc", "sub", "text").filter(F.octet_length("text") >= DEPTH)
    settled = cut(dealt(long_enough.mapInArrow(tidied(first_pass), ROW_TYPE), settle, ROW_TYPE))
    undecided = settled.filter(F.col("kind") == MANY).select("k", "doc", "sub", "at")
    hot = cut(undecided.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("k", F.lit(True).alias("crowded")))
    number = hot.count()
    if number:
        undecided = undecided.join(F.broadcast(hot) if number <= BROADCAST_ROWS else hot, "k", "left")
    else:
        undecided = undecided.withColumn("crowded", F.lit(False))
    by_doc = undecided.groupBy("doc", "sub").agg(F.collect_list(F.struct("k", "at", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("runs"))
    fetched = only(rows, undecided).join(by_doc, ["doc", "sub"]).select("doc", "sub", "text", F.col("runs.k").alias("ks"), F.col("runs.at").alias("ats"), F.col("runs.crowded").alias("crowds"))
    decided = dealt(fetched.mapInArrow(tidied(contexts), CONTEXT), further_passes, ROW_TYPE)
    found = settled.filter(F.col("kind") == MARK).unionByName(decided.filter(F.col("kind") == MARK))
    return found.select("doc", "sub", "at", "upto")


def kept_bytes(raw: bytes, lows: list[int], highs: list[int]) -> tuple[bytes, int, int]:
    """What is left, the number of bytes removed and of maximal removed runs."""
    kept, at, removed, spans = [], 0, 0, 0
    reach = -1
    for lo, hi in sorted(zip(lows, highs, strict=True)):
        if lo > reach:
            kept.append(raw[at:lo])
            spans += 1
            reach = lo
        end = hi + DEPTH
        if end > reach:
            removed += end - reach
            reach = end
        at = reach
    kept.append(raw[at:])
    return b"".join(kept), removed, spans


def by_document(docs: DataFrame, id_col: str, text_col: str, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The identified rows, and (doc, sub, lows, highs) of the documents that lose something."""
    rows = identified(docs, id_col, text_col)
    spans = marked_spans(rows, crowd).groupBy("doc", "sub").agg(F.collect_list(F.struct("at", "upto")).alias("spans"))
    return rows, cut(spans.select("doc", "sub", F.col("spans.at").alias("lows"), F.col("spans.upto").alias("highs")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that are left)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [kept_bytes((t or "").encode(), lo, hi) for t, lo, hi in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            sizes = [len(b) + n for b, n, _ in made]
            shas = [hashlib.sha256(b).hexdigest() for b, _, _ in made]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), pa.array(shas, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows, spans = by_document(docs, id_col, text_col, crowd)
    touched = only(rows, spans).join(spans, ["doc", "sub"]).select("id", "text", "lows", "highs")
    changed = touched.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    same = rows.join(small(spans), ["doc", "sub"], "left_anti").select(
        F.col("id").cast("long").alias("doc_id"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
    return changed.unionByName(same)


def small(wanted: DataFrame) -> DataFrame:
    wanted = wanted.select("doc", "sub").distinct()
    return F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted


def texts_without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, crowd: int = CROWD) -> DataFrame:
    """The rows of ``docs`` with the repeated passages cut out of the text; columns stay, ``length_col`` follows the
    text. Bytes of a character that a cut parts go with the cut; rows that lose nothing stay as they are."""
    rows, spans = by_document(docs, id_col, text_col, crowd)
    touched = only(rows, spans).join(spans, ["doc", "sub"]).select("rest", "text", "lows", "highs")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [kept_bytes((t or "").encode(), lo, hi)[0].decode("utf-8", "ignore") for t, lo, hi in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string())], names=["rest", "left"])

    kind = touched.select("rest", F.col("text").alias("left")).schema
    changed = touched.mapInArrow(tidied(run), kind)
    changed = changed.select(
        *[
            F.col("left").alias(c) if c == text_col else F.length("left").cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(f"rest.c{i}").alias(c)
            for i, c in enumerate(docs.columns)
        ]
    )
    same = rows.join(small(spans), ["doc", "sub"], "left_anti")
    same = same.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return changed.unionByName(same)
