"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: a bit is set where over half of a text's shingle hashes (XXH64, seed 42) have it set.

Links (at most ``RADIUS`` differing bits): equal fingerprints are one class from the start. Two classes within three
bits agree on at least three of six blocks of the 64 bits, so each class is listed under the twenty choices of three
blocks, and only classes with an equal choice are compared. Within such a bucket the differing bits are counted by bit
planes: plane b holds bit b of 64 comparisons in a word, carry-save counters add a plane to the distances of all
comparisons at once, and a block is abandoned when all its distances exceed the radius. A bucket gives only the links
of a spanning forest, never all pairs. A bucket over ``HOT`` classes is split again by six blocks of the bits that its
choice leaves open, which keeps the search exact and bounds a part by the values of the bits that are left.

Components: every class keeps a link to the smallest smaller neighbour and hands its other links down to that
neighbour until each has one smaller neighbour; pointer doubling then finds the roots. All of it stays in DataFrames.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link like any other; fewer
words than a shingle give one shingle of all words; a null id is never the smallest of a component (a component of
null ids has a null component_id); rows that repeat share class and component; very long texts are read whole; an empty
table gives an empty table. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, salted_lookup, tidied

RADIUS = 3
HOT = 4096
#: Comparisons in one block of bit planes, in words of 64.
BLOCK_WORDS = 4096


def shingle_hashes(text: bytes, words_in_shingle: int = 3) -> np.ndarray:
    """Hashes of the word shingles of one UTF-8 text, repeats included."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_in_shingle:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    begin, end = starts[: len(words) - words_in_shingle + 1].tolist(), (starts[words_in_shingle:] - 1).tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(begin, end, strict=True)), dtype=np.uint64, count=len(begin))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero for none."""
    set_bits = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        some = hashes[k : k + (1 << 16)]
        set_bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((2 * set_bits > len(hashes)) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprint(text: bytes, words_in_shingle: int = 3) -> int:
    """The fingerprint of one UTF-8 text."""
    return majority(shingle_hashes(text, words_in_shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"", words_in_shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, fp long")


def block_masks(bits: list[int]) -> list[int]:
    """Masks of the twenty choices of three out of six blocks of the given bits."""
    blocks = [sum(1 << int(b) for b in some) for some in np.array_split(np.array(bits), 6)]
    return [sum(some) for some in combinations(blocks, 3)]


MASKS = block_masks(list(range(64)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(classes: DataFrame) -> DataFrame:
    """Each fingerprint under its twenty choices: mask number and masked bits."""
    masks = F.array(*[F.struct(F.lit(i).cast("short").alias("m"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("k")) for i, m in enumerate(MASKS)])
    return classes.select("fp", F.explode(masks).alias("x")).select("fp", F.col("x.m").alias("m"), F.col("x.k").alias("k"))


def keyed_again(rows: DataFrame) -> DataFrame:
    """Fingerprints of hot buckets under the choices of the bits that their mask leaves open. Two that agree on three of
    those six blocks as well agree on the joined mask; the mask number tells both choices."""
    again = {i: block_masks([b for b in range(64) if not m >> b & 1]) for i, m in enumerate(MASKS)}
    choices = None
    for i, subs in again.items():
        made = F.array(*[F.struct(F.lit(100 + 20 * i + j).cast("short").alias("m"), F.col("fp").bitwiseAND(F.lit(signed(MASKS[i] | s)).cast("long")).alias("k")) for j, s in enumerate(subs)])
        choices = F.when(F.col("m") == i, made) if choices is None else choices.when(F.col("m") == i, made)
    return rows.select("fp", F.explode(choices).alias("x")).select("fp", F.col("x.m").alias("m"), F.col("x.k").alias("k"))


def within(planes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """planes[b] holds, as words of 64 comparisons, whether bit b differs. Returns the words of comparisons with at most
    ``radius`` differing bits; carry-save counters, abandoned once all exceed it."""
    full = ~np.uint64(0)
    width = radius.bit_length()
    start = (1 << width) - 1 - radius  # so that the counters run over just beyond the radius
    counters = [np.full_like(planes[0], full if start >> c & 1 else 0) for c in range(width)]
    over = np.zeros_like(planes[0])
    for b in range(len(planes)):
        carry = planes[b]
        for c in range(width):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        over |= carry
        if b % 8 == 7 and (over == full).all():
            break
    return ~over


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Planes of words from rows of 64-bit numbers; plane b holds bit b of the rows, 64 of them in a word."""
    n, wide = values.shape
    padded = np.full((-(-n // 64) * 64, wide), ~np.uint64(0))
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def flags(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


class Forest:
    """Union by smallest over positions of one bucket; every union is a link of the spanning forest."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def agree(own: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    """Whether signatures differ in at most ``most`` bits."""
    return np.bitwise_count(own ^ other).sum(axis=-1, dtype=np.int64) <= most


def bucket_links(fps: np.ndarray, radius: int = RADIUS, signatures: np.ndarray | None = None, most: int = 0) -> list[tuple[int, int]]:
    """Links (later, earlier position) of a spanning forest of one bucket's fingerprints, of those whose signatures
    agree.

    Several fingerprints at a time are compared with all behind the first of them; what is in one tree already is not
    looked at, and a bucket in one tree ends it.
    """
    n, links = len(fps), []
    tree, trees = np.arange(n), n
    planes = bit_planes(fps)
    ones, step = ~np.uint64(0), max(1, BLOCK_WORDS // planes.shape[1])
    for first in range(0, n - 1, step):
        if trees == 1:
            break
        some = np.ascontiguousarray(fps[first : first + step])
        query = np.where(np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").T == 1, ones, np.uint64(0))
        for at in range((first + 1) // 64, planes.shape[1], BLOCK_WORDS):
            words = within(planes[:, None, at : at + BLOCK_WORDS] ^ query[:, :, None], radius)
            near = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, : n - 64 * at]
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                i = first + k
                found = np.flatnonzero(near[k]) + 64 * at
                found = found[(found > i) & (tree[found] != tree[i])]
                if signatures is not None:
                    found = found[agree(signatures[found], signatures[i], most)]
                while len(found):
                    links.append((int(found[0]), i))
                    tree[tree == tree[found[0]]] = tree[i]
                    trees -= 1
                    found = found[tree[found] != tree[i]]
    return links


def partition_links(
    fps: np.ndarray, ids: np.ndarray, groups: np.ndarray, radius: int = RADIUS, signatures: np.ndarray | None = None, most: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within the groups of one sorted run of rows, as pairs of ids, and the group of each."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(starts, len(fps)))
    a_out, b_out, at_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # small buckets side by side: the s-th neighbours of all of them form one row of comparisons
    small = (sizes > 1) & (sizes <= 16)
    for shift in range(1, int(sizes[small].max()) if small.any() else 1):
        at = starts[small & (sizes > shift)]
        room = sizes[small & (sizes > shift)] - shift
        left = np.repeat(at, room) + (np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room))
        for k in range(0, len(left), 64 * BLOCK_WORDS):
            some = left[k : k + 64 * BLOCK_WORDS]
            some = some[flags(within(bit_planes(fps[some] ^ fps[some + shift]), radius), len(some))]
            if signatures is not None:
                some = some[agree(signatures[some], signatures[some + shift], most)]
            a_out.append(ids[some + shift])
            b_out.append(ids[some])
            at_out.append(groups[some])
    for start, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        own = None if signatures is None else signatures[start : start + size]
        if links := bucket_links(fps[start : start + size], radius, own, most):
            pairs = np.array(links) + start
            a_out.append(ids[pairs[:, 0]])
            b_out.append(ids[pairs[:, 1]])
            at_out.append(groups[pairs[:, 1]])
    return np.concatenate(a_out), np.concatenate(b_out), np.concatenate(at_out)


def trees_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for the tree of each link between ids, the same wherever a tree has the same ids."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(ids))
    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        forest.link(i, j)
    roots = np.array([forest.root(i) for i in range(len(ids))], dtype=np.int64)
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    sums = np.zeros(len(ids), dtype=np.uint64)
    np.add.at(sums, roots, mixed ^ (mixed >> np.uint64(32)))
    return sums[roots[at[: len(a)]]].view(np.int64)


def links_in_buckets(rows: DataFrame, radius: int = RADIUS, fps: tuple[str, ...] = ("fp",), signature: tuple[str, ...] = (), most: int = 0) -> DataFrame:
    """Links (a, b) of ids within the buckets of rows (m, k, id, fingerprint); a bucket meets in one task, its rows as a
    few numbers each. With a signature, links are only those whose signatures differ in at most ``most`` bits, and g tells
    the tree of a link."""
    names = ("m", "k", "id", *fps, *signature)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((0, len(names)), np.int64)]

        def emit(table: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[False], (table[1:, 0] != table[:-1, 0]) | (table[1:, 1] != table[:-1, 1])])
            own = np.ascontiguousarray(table[:, 3 : 3 + len(fps)]).view(np.uint64)
            signatures = np.ascontiguousarray(table[:, 3 + len(fps) :]).view(np.uint64) if signature else None
            a, b, bucket = partition_links(own, table[:, 2], np.cumsum(new), radius, signatures, most)
            if not signature:
                return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            order = np.argsort(bucket, kind="stable")
            a, b, bucket = a[order], b[order], bucket[order]
            ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(a))
            trees = [trees_of(a[i:j], b[i:j]) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if j > i]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([np.zeros(0, np.int64), *trees]))], names=["a", "b", "g"])

        for part in parts:
            held.append(np.stack([np.asarray(part.column(c)).astype(np.int64) for c in names], axis=1))
            if sum(map(len, held)) < 50_000:
                continue
            table = np.concatenate(held)
            last = np.flatnonzero((table[:, 0] != table[-1, 0]) | (table[:, 1] != table[-1, 1]))
            upto = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
            if upto:
                yield emit(table[:upto])
            held = [table[upto:]]
        table = np.concatenate(held)
        if len(table):
            yield emit(table)

    dealt = rows.select(*names).repartition("m", "k").sortWithinPartitions("m", "k", *fps, "id")
    return dealt.mapInArrow(tidied(run), "a long, b long, g long" if signature else "a long, b long")


def crowded_buckets(rows: DataFrame, hot: int) -> DataFrame | None:
    """Buckets with more than ``hot`` rows, to be broadcast while they are few; None if there are none."""
    found = cut(rows.groupBy("m", "k").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("m", "k"))
    number = found.count()
    return None if not number else F.broadcast(found) if number <= 100_000 else found


def links(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """Links between distinct fingerprints that connect all pairs within the radius."""
    rows = keyed(classes).withColumn("id", F.col("fp"))
    crowded = crowded_buckets(rows, hot)
    if crowded is None:
        return links_in_buckets(rows)
    mild = links_in_buckets(rows.join(crowded, ["m", "k"], "left_anti"))
    split = keyed_again(rows.join(crowded, ["m", "k"], "left_semi")).withColumn("id", F.col("fp"))
    return mild.unionByName(links_in_buckets(split))


def smaller_first(edges: DataFrame) -> DataFrame:
    """Edges as (a, b) with a > b, each once."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node that has an edge and is not a root itself.

    The rounds end by themselves: unless each node has one link already, a link moves to smaller nodes in each."""
    edges = cut(smaller_first(edges))
    while True:
        up = edges.groupBy("a").agg(F.min("b").alias("p"), F.count("*").alias("n"))
        state = up.agg(F.sum("n").alias("edges"), F.count("*").alias("nodes")).first()
        if (state["edges"] or 0) == state["nodes"]:
            break
        handed = salted_lookup(edges, up.select("a", "p"), "a", F.col("b"))
        down = handed.select(F.when(F.col("b") == F.col("p"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("p").alias("b"))
        edges = cut(smaller_first(down))
    tree = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        above = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = cut(salted_lookup(tree, above, "root", F.col("node"), "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        tree = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return tree


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links)."""
    found = cut(fingerprints(docs, id_col, text_col, words_in_shingle))
    classes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    tree = components(links(classes.select("fp"), hot))
    member = classes.join(tree, classes["fp"] == tree["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = salted_lookup(member.select("fp", "root"), smallest, "root", F.col("fp")).select("fp", "component_id")
    return salted_lookup(found, of_class, "fp", F.col("doc_id")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Standard deviations by which the estimates may miss a similarity; links are then decided by the sets themselves.
DEVIATIONS = 6


def radius_for(similarity: float, bits: int) -> int:
    """Differing bits within which texts of this Jaccard similarity lie: the angle between their shingle sets, and
    ``DEVIATIONS`` standard deviations."""
    angle = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * angle + DEVIATIONS * np.sqrt(bits * angle * (1 - angle))))


def most_for(similarity: float, bits: int) -> int:
    """Differing bits of signatures within which texts of this Jaccard similarity lie: a bit differs for half of the
    smallest shingles that differ, and ``DEVIATIONS`` standard deviations."""
    differs = (1 - similarity) / 2
    return int(np.ceil(bits * differs + DEVIATIONS * np.sqrt(bits * differs * (1 - differs))))


#: Smallest shingle hashes, each under its own permutation, by which texts meet in blocks; words of a wide fingerprint
#: and of a signature.
SKETCHES, WIDE, SIGNED = 6, 4, 16
WIDE_COLUMNS = tuple(f"fp{i}" for i in range(WIDE))
SIGNATURE_COLUMNS = tuple(f"s{i}" for i in range(SIGNED))
#: Shingles whose hashes are permuted in one step.
STEP = 1024
#: Rows of a block from which on it is compared by tiles; rows of a table of blocks up to which it may be broadcast.
CROWDED, HUBS = 1024, 50_000


def signature_of(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """One bit of the smallest of the hashes under each permutation; zeros for none."""
    if not len(hashes):
        return np.zeros(len(odd) // 64, dtype=np.uint64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(odd), ~np.uint32(0))
    for k in range(0, len(short), STEP):
        np.minimum(least, np.multiply.outer(short[k : k + STEP], odd).min(axis=0), out=least)
    return np.packbits((least >> np.uint32(5) & np.uint32(1)).astype(np.uint8), bitorder="little").view(np.uint64)


def sketched(docs: DataFrame, id_col: str, text_col: str, words_in_shingle: int, with_set: bool = False) -> DataFrame:
    """id, the wide fingerprint of the set of shingles (each counted once, so that repeated lines do not make texts
    alike), its signature, the size of that set and a hash of it, and keys: the smallest shingle hash under each of SKETCHES permutations;
    ``with_set`` adds the hashes themselves as shingles."""
    import xxhash

    random = np.random.default_rng(11)
    odd = random.integers(1, 1 << 62, SKETCHES + WIDE, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    small_odd = random.integers(1, 1 << 31, 64 * SIGNED, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)

    def scrambled(hashes: np.ndarray, by: np.uint64) -> np.ndarray:
        x = (hashes ^ (hashes >> np.uint64(32))) * by
        return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in parts:
                rows, keys, sets = [], [], []
                for text in part.column(1).cast(pa.binary()):
                    hashes = np.unique(shingle_hashes(text.as_py() or b"", words_in_shingle))
                    rows.append([*(majority(scrambled(hashes, by)) for by in odd[SKETCHES:]), *signature_of(hashes, small_odd).tolist(), len(hashes), xxhash.xxh64_intdigest(hashes.tobytes())])
                    if with_set:
                        sets.append(hashes.tobytes())
                    some = hashes if len(hashes) else np.zeros(1, np.uint64)
                    keys.append([int(scrambled(some, by).min().view(np.int64)) for by in odd[:SKETCHES]])
                table = np.array(rows, dtype=np.uint64).reshape(-1, len(names)).view(np.int64)
                columns = [pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(names))]
                columns += [pa.array(keys, pa.list_(pa.int64())), *([pa.array(sets, pa.binary())] if with_set else [])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", *names, "keys", *(["shingles"] if with_set else [])])

    names = (*WIDE_COLUMNS, *SIGNATURE_COLUMNS, "size", "whole")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    return rows.mapInArrow(tidied(run), f"id long, {', '.join(f'{c} long' for c in names)}, keys array<long>{', shingles binary' if with_set else ''}")


def blocked(rows: DataFrame) -> DataFrame:
    """Each row under each of its sketches."""
    made = F.array(*[F.struct(F.lit(c).cast("short").alias("m"), F.col("keys")[c].alias("k")) for c in range(SKETCHES)])
    kept = ("id", *WIDE_COLUMNS, *SIGNATURE_COLUMNS, "size")
    return rows.select(*kept, F.explode(made).alias("x")).select(*kept, F.col("x.m").alias("m"), F.col("x.k").alias("k"))


def starred(docs: DataFrame, crowd: DataFrame, id_col: str, text_col: str, words_in_shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows of crowded blocks with ``star``, whether they are their block's hub (the row of the smallest hash) or
    similar to it, and the links (a, b) of these to hubs.

    Rows of one star are in one component already, so that a block that is mostly one large group of near copies need not
    be compared with itself. Similarities are exact. A hub's set goes to as many tasks as its rows are spread over."""
    most, names = most_for(similarity, 64 * SIGNED), SIGNATURE_COLUMNS
    told = F.struct(F.col("id").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in names])
    hubs = cut(crowd.groupBy("m", "k").agg(F.min_by(told, F.struct(F.xxhash64("id"), "id")).alias("h")).select("m", "k", "h.*"))
    differing = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"hub_{c}"))) for c in names[1:]), F.bit_count(F.col(names[0]).bitwiseXOR(F.col(f"hub_{names[0]}"))))
    met = crowd.join(F.broadcast(hubs) if hubs.count() <= HUBS else hubs, ["m", "k"]).filter((differing <= most) & (F.col("id") != F.col("hub")))
    pairs = cut(met.select("id", "hub").distinct())
    salts = max(16, partitions(docs.sparkSession))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    wanted = pairs.select(F.explode(F.array("id", "hub")).alias("_wanted")).distinct()
    texts = docs.join(wanted, docs[id_col].cast("long") == wanted["_wanted"], "left_semi")
    sets = cut(sketched(texts, id_col, text_col, words_in_shingle, with_set=True).select("id", "shingles").groupBy("id").agg(F.min("shingles").alias("shingles")))
    own = pairs.join(sets, "id").select("hub", "salt", F.lit(1).alias("member"), "id", "shingles")
    shared = pairs.select("hub", "salt").distinct().join(sets.withColumnRenamed("id", "hub"), "hub")
    dealt = own.unionByName(shared.select("hub", "salt", F.lit(0).alias("member"), F.col("hub").alias("id"), "shingles"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, marked = None, np.zeros(0, np.uint64)
        for part in parts:
            found: list[tuple[int, int]] = []
            for of, member, i, raw in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                values = np.frombuffer(raw, dtype=np.uint64)
                if not member:
                    hub, marked = of, values
                    continue
                shared = len(np.intersect1d(values, marked, assume_unique=True))
                if shared >= similarity * (len(values) + len(marked) - shared) - 1e-9:
                    found.append((i, hub))
            yield pa.RecordBatch.from_arrays([pa.array([f[e] for f in found], pa.int64()) for e in (0, 1)], names=["a", "b"])

    ordered = dealt.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member").select("hub", "member", "id", "shingles")
    links = cut(ordered.mapInArrow(tidied(run), "a long, b long").distinct())
    of_block = crowd.join(F.broadcast(hubs.select("m", "k", "hub")) if hubs.count() <= HUBS else hubs.select("m", "k", "hub"), ["m", "k"])
    linked = links.select(F.col("a").alias("id"), F.col("b").alias("hub"), F.lit(True).alias("linked"))
    flagged = of_block.join(linked, ["id", "hub"], "left")
    return flagged.withColumn("star", F.coalesce("linked", F.lit(False)) | (F.col("id") == F.col("hub"))).drop("linked", "hub"), links


def tiled(rows: DataFrame, similarity: float, hot: int) -> DataFrame:
    """Rows of crowded blocks under tiles of about 2 * ``hot`` rows, so that each two rows of a block whose sizes allow
    the similarity meet in one, unless both are in the block's star.

    Sets of this similarity differ in size by at most its inverse, so they lie in one band of sizes or in two adjacent
    ones. A band and the one below are cut into parts by id, the rows of the star apart from the others; each two parts
    are a tile, but for two parts of the star. Tiles whose hashes are equal meet too, which only adds comparisons."""
    band = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) * (0.999 / -np.log(similarity)))
    banded = rows.withColumn("own", band).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    outside = F.count(F.when(~F.col("star"), 1))
    held = banded.groupBy("m", "k", "band").agg(F.count("*").alias("n"), outside.alias("others"), F.max(F.col("own") == F.col("band")).alias("any"))
    many = [F.ceil(F.col("others") / hot).cast("long").alias("parts"), F.ceil((F.col("n") - F.col("others")) / hot).cast("long").alias("star_parts")]
    parts = cut(held.filter("any and others > 0").select("m", "k", "band", *many))
    placed = banded.join(F.broadcast(parts) if parts.count() <= HUBS else parts, ["m", "k", "band"])
    # parts of the others are numbered from 0, those of the star behind them
    own = F.when(F.col("star"), F.col("parts") + F.pmod(F.xxhash64("id"), F.col("star_parts"))).otherwise(F.pmod(F.xxhash64("id"), F.col("parts")))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") + F.col("star_parts") - 1)
    placed = placed.withColumn("part", own)
    placed = placed.withColumn("other", F.explode(F.when(F.col("star"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(every)))
    tile = F.xxhash64("k", "band", F.least("part", "other"), F.greatest("part", "other"))
    return placed.withColumn("k", tile).drop("own", "band", "parts", "star_parts", "part", "other", "star")


def similar_links(classes: DataFrame, similarity: float, hot: int = CROWDED, stars: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Links of texts that share a smallest shingle and whose fingerprints and signatures differ in no more bits than
    those of texts of this similarity, and the links that ``stars`` has proved. A block over ``hot`` is compared by tiles,
    and no pair in it is left out but those that a star links already."""
    radius, most = radius_for(similarity, 64 * WIDE), most_for(similarity, 64 * SIGNED)
    level = blocked(classes)
    crowded = crowded_buckets(level, hot)
    if crowded is None:
        return links_in_buckets(level, radius, WIDE_COLUMNS, SIGNATURE_COLUMNS, most), None
    mild = links_in_buckets(level.join(crowded, ["m", "k"], "left_anti"), radius, WIDE_COLUMNS, SIGNATURE_COLUMNS, most)
    crowd, proved = level.join(crowded, ["m", "k"], "left_semi"), None
    if stars:
        crowd, proved = stars(cut(crowd))
    else:
        crowd = crowd.withColumn("star", F.lit(False))
    tiles = tiled(crowd, similarity, hot)
    return mild.unionByName(links_in_buckets(tiles, radius, WIDE_COLUMNS, SIGNATURE_COLUMNS, most)), proved


def exact_forest(signatures: np.ndarray, sets: list[np.ndarray], similarity: float, most: int) -> list[tuple[int, int]]:
    """Links (later, earlier position) of a spanning forest of the pairs whose sets have at least this Jaccard
    similarity; only pairs of different trees whose signatures agree are looked at."""
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    marked, tree, links, trees = np.zeros(len(values), dtype=bool), np.arange(len(sets)), [], len(sets)
    for i in range(len(sets) - 1):
        if trees == 1:
            break
        found = np.flatnonzero(tree[i + 1 :] != tree[i]) + i + 1
        found = found[agree(signatures[found], signatures[i], most)]
        own = codes[ends[i] - sizes[i] : ends[i]]
        marked[own] = True
        for k in range(0, len(found), 256):
            some = found[k : k + 256]
            some = some[tree[some] != tree[i]]
            if not len(some):
                continue
            at = np.cumsum(sizes[some])
            flat = np.repeat(ends[some] - at, sizes[some]) + np.arange(at[-1])
            hits = np.concatenate([[0], np.cumsum(marked[codes[flat]])])
            shared = hits[at] - hits[at - sizes[some]]
            for j in some[shared >= similarity * (sizes[i] + sizes[some] - shared) - 1e-9].tolist():
                if tree[j] != tree[i]:
                    tree[tree == tree[j]] = tree[i]
                    links.append((j, i))
                    trees -= 1
        marked[own] = False
    return links


def exact_links(docs: DataFrame, near: DataFrame, id_col: str, text_col: str, words_in_shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) of ids that the trees of ``near`` join and whose shingle sets have at least this Jaccard similarity.

    The sets (64-bit hashes) are made again for the ids with a candidate only; a tree is no larger than its block or
    tile, and equal trees of several blocks are looked at once."""
    members = cut(near.select("g", F.explode(F.array("a", "b")).alias("id")).distinct())
    wanted = members.select(F.col("id").alias("_wanted")).distinct()
    texts = docs.join(wanted, docs[id_col].cast("long") == wanted["_wanted"], "left_semi")
    names, most = SIGNATURE_COLUMNS, most_for(similarity, 64 * SIGNED)
    sets = sketched(texts, id_col, text_col, words_in_shingle, with_set=True).select("id", *names, "shingles").distinct()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            signatures = np.array([x[2] for x in held], dtype=np.int64).view(np.uint64)
            pairs = exact_forest(signatures, [np.frombuffer(x[3], dtype=np.uint64) for x in held], similarity, most)
            ends = [pa.array([held[p[e]][1] for p in pairs], pa.int64()) for e in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for part in parts:
            columns = np.stack([np.asarray(part.column(c)) for c in names], axis=1)
            for row in zip(part.column("g").to_pylist(), part.column("id").to_pylist(), columns, part.column("shingles").to_pylist(), strict=True):
                if held and held[-1][0] != row[0]:
                    yield emit()
                    held = []
                held.append(row)
        if held:
            yield emit()

    dealt = members.join(sets, "id").select("g", "id", *names, "shingles").repartition("g").sortWithinPartitions("g", "id")
    return dealt.mapInArrow(tidied(run), "a long, b long")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 5, similarity: float = 0.8, hot: int = CROWDED
) -> DataFrame:
    """The rows of ``docs`` but those linked to a smaller id, with all their columns.

    Texts link if their sets of shingles have this Jaccard similarity. Candidates share one of six smallest shingles, as
    texts of similarity 0.8 do but for one pair in 10,000; fingerprints of 256 bits (``radius_for``) and signatures of
    1,024 bits (``most_for``) sort out what is well below the similarity, and the sets of the others decide. Of a
    component the smallest id stays.

    Defined cases: a null text counts as empty; texts without words have an empty set and are alike; fewer words than a
    shingle give one shingle of all words; rows with a null id stay; rows that share an id share their fate; rows that
    repeat are copies; an empty table gives an empty table; other columns pass through, whatever their names."""
    found = cut(sketched(docs, id_col, text_col, words_in_shingle))
    classes = cut(found.groupBy(*WIDE_COLUMNS, *SIGNATURE_COLUMNS, "size", "whole", "keys").agg(F.min("id").alias("id")))
    near, proved = similar_links(classes, similarity, hot, lambda crowd: starred(docs, crowd, id_col, text_col, words_in_shingle, similarity))
    links = exact_links(docs, near, id_col, text_col, words_in_shingle, similarity)
    tree = components(links if proved is None else links.unionByName(proved))
    first = classes.join(tree, classes["id"] == tree["node"], "left_anti").select(F.col("id").alias("_kept_id")).distinct()
    kept = docs.join(first, docs[id_col] == first["_kept_id"], "left_semi")
    return kept.unionByName(docs.filter(docs[id_col].isNull()))
