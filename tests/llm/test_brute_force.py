"""Operators against plain recomputation, where the other tests look at accuracy or properties only."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from regionspark.llm import exact_dedup, nbsvm, quality_rules, sharding, simhash, suffix_dedup

SF = "/root/testdata/sf0.01"


def test_shards_are_the_largest_draws(spark):
    weights = [1.0, 2.5, 1.0, 0.5, 1.0]
    ids = [*range(500), -7, 2**62]
    frame = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")

    def draw(key, j):
        of_key = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", j), of_key)
        return -weights[j] / math.log(((h >> 11) + 0.5) / 2**53)

    for r in sharding.shard_records(frame, weights[:4], weights).collect():
        assert r.shard == max(range(4), key=lambda j: draw(r.doc_id, j))
        assert r.grown_shard == max(range(5), key=lambda j: draw(r.doc_id, j))


def test_descent_reaches_the_optimum():
    """The dual of the hinge loss by projected gradient steps, and the same value of the loss."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(1, 12, 5)).astype(np.int32) for _ in range(40)]
    signs = np.where(rng.random(40) < 0.4, 1.0, -1.0)
    ratios = np.zeros(nbsvm.DIMENSIONS)
    ratios[:12] = rng.normal(size=12)
    w, bias = nbsvm.descend(rows, signs, ratios, 0.7, 4000)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / math.sqrt(len(r))
    x[:, 12] = 1
    cost = np.where(signs > 0, 0.7, 0.7 * (signs > 0).sum() / (signs < 0).sum())
    q = (signs[:, None] * x) @ (signs[:, None] * x).T
    alpha, step = np.zeros(40), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, cost)
    best = x.T @ (alpha * signs)
    own = np.zeros(13)
    own[:12] = np.divide(w[:12], ratios[:12], out=np.zeros(12), where=ratios[:12] != 0)
    own[12] = bias

    def loss(v):
        return v @ v / 2 + (cost * np.maximum(0, 1 - signs * (x @ v))).sum()

    assert abs(loss(own) - loss(best)) < 1e-3 * loss(best)
    assert alpha.sum() - best @ best / 2 <= loss(own) + 1e-9  # no loss is below the dual


def test_log_count_ratios(spark):
    rows = [np.array([1, 2], np.int32), np.array([2, 3], np.int32), np.array([3], np.int32)] * 4
    model = nbsvm.fit(rows, np.array([1, 0, 0] * 4))
    assert model.score(rows[0]) > model.score(rows[1])
    docs = spark.createDataFrame([(1, "a " * 30_000), (1, "a " * 30_000), (2, "a " * 30_000 + "!!! " * 30_000)], "doc_id long, text string")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wide = docs.selectExpr("*", *[f"1 as {c}" for c in ("_id", "_label", "_text", "label", "present", "score")])
    got = Counter((r.doc_id, round(r.score, 9)) for r in nbsvm.score_quality(wide, labels).collect())
    assert sorted(got.values()) == [1, 2]


def plain_features(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip("\x20\t\x0b\x0c\r")]
    grams = list(zip(words, words[1:], words[2:]))
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= {i, i + 1, i + 2}
    n, some = len(words), max(1, len(words))
    return {
        "symbol_share": sum(c in "#*$%&|<>" for c in text) / max(1, chars), "bang_share": text.count("!") / max(1, chars),
        "upper_share": sum("A" <= c <= "Z" for c in text) / max(1, chars), "bar_share": text.count("|") / some, "repeat_share": len(covered) / some,
        "dup_line_share": (len(lines) - len(set(lines))) / max(1, len(lines)), "distinct_share": len(set(words)) / some, "mean_word": chars / some, "n_words": n,
    }


def test_learned_verdicts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.learn_rules(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rejected = 0
    for r in quality_rules.judge(docs, rules).collect():
        found = plain_features(texts[r.doc_id])
        held = [all((found[c.feature] >= c.threshold) == c.at_least for c in rule) for rule in rules]
        assert r.kept == (not r.base_failed and not any(held))
        rejected += not r.base_failed and not r.kept
    assert rejected > 0


def test_near_copies_of_a_table_are_those_of_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in docs.collect()}
    holders = defaultdict(list)
    for i in sorted(sets):
        for h in sets[i] or {None}:
            holders[h].append(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    shared = Counter()
    for some in holders.values():
        for a in range(len(some)):
            for b in range(a):
                shared[some[a], some[b]] += 1
    for (a, b), n in shared.items():
        if (not sets[a] and not sets[b]) or n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            up[max(root(a), root(b))] = min(root(a), root(b))
    want = {i for i in up if root(i) == i}
    assert len(want) < len(sets)
    for hot in (1024, 4):
        assert {r.doc_id for r in simhash.drop_near_copies(docs, hot=hot).collect()} == want


def test_stages_on_empty_tables_and_odd_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(None, None), (None, "x " * 60), (1, "y " * 10), (1, "y " * 10), (2, " ".join(f"w{i}" for i in range(70))), (2, " ".join(f"w{i}" for i in range(70))), (3, " ".join(f"v{i}" for i in range(40_000)))]
    names = ("_kept_id", "_wanted", "c", "t", "words", "kept", "_")
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"1 as `{c}`" for c in names])
    stages = (lambda d: quality_rules.drop_low_quality(d, labels), exact_dedup.drop_exact_copies, simhash.drop_near_copies, suffix_dedup.texts_without_repeats)
    for stage in stages:
        assert stage(docs).columns == docs.columns
        assert stage(docs.limit(0)).count() == 0
    assert Counter(r.doc_id for r in stages[0](docs).collect()) == {2: 2, 3: 1}
    assert Counter(r.doc_id for r in stages[1](docs).collect())[3] == 1
    assert zlib.crc32(b"") == 0
