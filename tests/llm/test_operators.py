"""Each training-data operator against a plain version, on texts with nulls, repeats, ties and odd characters."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regionspark.llm import bpe, exact_dedup, licenses, nbsvm, packing, quality_rules, queries, sharding, simhash, suffix_dedup, token_count

SF = "/root/testdata/sf0.001"
BYTES, WORDS = queries.vocabulary(queries.BYTE_VOCABULARY), queries.vocabulary(queries.WORD_VOCABULARY)
CLASHING = ("content", "digest", "salt", "words", "lines", "t", "n", "fp", "m", "k", "kind", "at", "doc", "sub", "rest", "shard", "bucket", "length", "kept", "_salt", "_", "there", "c0", "_kept_id", "_text", "_id", "_label", "ids", "spans")


def sample():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdehé") for _ in range(rng.randint(2, 8))) for _ in range(150)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage = text(40)
    rows = [(i, text(rng.randint(0, 120)), "en") for i in range(60)]
    rows += [(100 + i, f"{text(rng.randint(0, 20))} {passage[rng.randint(0, 30):]} {text(5)}", "en") for i in range(12)]
    rows += [(200 + i, rows[i][1], "de") for i in range(15)]
    rows += [(300, None, "en"), (301, "", "en"), (302, " \n\t", "en"), (303, "ab " * 300, "en"), (304, "x" * 700, None), (305, "a b c a b c", "en")]
    rows += [(306, "it's <|endoftext|> 'll\n\n  日本語 ΑΣ İ \x1c \x85!!", "en"), (307, "Licensed under CC BY 4.0. All rights reserved.", "en"), (308, " ".join(map(str, range(9000))), "en")]
    rows += [(None, "no id", "en"), (None, None, "en"), (309, "twice", "en"), (309, "twice", "en")]
    return rows


ROWS = sample()


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    return frame.select("*", *[F.lit(1).alias(c) for c in CLASHING]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def raw(text):
    return (text or "").encode()


def test_exact_groups(docs, empty):
    members = {}
    for i, t, _ in ROWS:
        members.setdefault(t or "", []).append(i)
    want = []
    for i, t, _ in ROWS:
        ids = [x for x in members[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(members[t or ""]), i == keep, hashlib.sha256(raw(t)).hexdigest()))
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect()), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text or "" for r in kept.filter("doc_id <> 309").collect()).most_common(1)[0][1] == 1


def plain_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = list(zip(words, words[1:], words[2:]))
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, docs, empty):
    odd = [(400, "a b c\na b c\n\nx", "en"), (401, "# * $ | < > & %", "en"), (402, " ".join(str(i % 700) for i in range(4000)), "en"), (403, " ".join("ab"[i * i % 7 % 2] for i in range(500)), "en")]
    frame = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.judge(frame, []).collect())
    want = Counter()
    for i, t, _ in ROWS + odd:
        counts = plain_counts(t)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want[(i, *counts, failed, not failed)] += 1
    assert got == want
    assert quality_rules.judge(empty, []).count() == 0
    assert quality_rules.judge(docs, []).count() == len(ROWS)


def test_decision_list_learns_and_is_native(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    rules = quality_rules.learn_rules(docs, labels)
    assert rules
    judged = quality_rules.judge(docs, rules)
    assert "Python" not in judged._jdf.queryExecution().toString()
    rows = judged.join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    assert quality_rules.learn_rules(docs, labels.filter("quality = 1")) == []
    assert quality_rules.learn_rules(docs, labels.limit(0)) == []
    table = np.array([[x / 100] + [0.0] * 8 for x in range(100)])
    learned = quality_rules.learn(table, table[:, 0] >= 0.6)
    assert learned[0][0].feature == "symbol_share"
    assert abs(learned[0][0].threshold - 0.6) < 0.05


def test_license_scan(docs, empty):
    def plain(t):
        words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        found = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.encode().split()] for i in range(len(words)) if words[i : i + len(p)] == p]
        starts = [i for i, _ in found]
        return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))

    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(docs).collect())
    assert got == Counter((i, *plain(t)) for i, t, _ in ROWS)
    assert licenses.scan_licenses(empty).count() == 0
    automaton = licenses.Automaton([(k, t) for k, some in licenses.TEMPLATES.items() for t in some], licenses.PHRASES)
    notice = licenses.words_of(licenses.TEMPLATES["mit"][1].encode())
    assert automaton.scan(notice)[5] == 1.0
    broken = notice[:12] + [b"zzz"] + notice[13:]
    assert "mit" in automaton.scan(broken)[4]
    assert automaton.scan(notice[:5])[5] < licenses.MIN_COVERED
    (found,) = [x for x in automaton.scan([b"zzz"] * 7 + notice)[6] if x.template == 1 + len(licenses.TEMPLATES["apache-2.0"])]
    assert (found.first, found.last, found.covered) == (7, 6 + automaton.lengths[found.template], 1.0)
    rng = random.Random(1)
    for _ in range(300):  # matching statistics against all substrings
        words = [rng.choice(list(automaton.number)) for _ in range(rng.randint(0, 25))]
        assert automaton.scan(words)[0] == sum(words[i : i + len(p)] == p for q in licenses.PHRASES for p in [q.encode().split()] for i in range(len(words)))


def best_share(words, template):
    """The largest share of a template that a chain of its maximal matches covers, by trying all of them."""
    n, m, matches = len(words), len(template), []
    size = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            if words[i] == template[j]:
                size[i + 1][j + 1] = size[i][j] + 1
    for i in range(n):  # a text position's longest match, at every place where it ends
        longest = max(size[i + 1])
        on = max(size[i + 2]) if i + 1 < n else 0
        if longest >= licenses.MIN_MATCH and on != longest + 1:
            matches += [(i, j, longest) for j in range(m) if size[i + 1][j + 1] == longest]
    best = []
    for i, j, length in matches:
        own = length
        for (a, b, _), covered in zip(matches, best, strict=False):
            fresh = min(length, j - b, i - a)
            if fresh > 0 and i - length - a <= m:
                own = max(own, covered + fresh)
        best.append(own)
    return min(1.0, max(best, default=0) / m)


def test_license_chains_are_the_best_of_all():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(9)]
    for _ in range(150):
        templates = [(f"t{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 24)))) for k in range(4)]
        templates.append(("t9", f"{templates[0][1]} {templates[1][1]}"))
        automaton = licenses.Automaton(templates, {"w0 w1": "base"})
        text = []
        for _ in range(rng.randint(0, 6)):
            own = rng.choice(templates)[1].split()
            a = rng.randrange(len(own))
            text += own[a : a + rng.randint(2, 15)] + [rng.choice([*vocabulary, "zzz"]) for _ in range(rng.randint(0, 3))]
        words = [w.encode() for w in text]
        *_, base, labels, score, spans = automaton.scan(words)
        shares = [best_share(text, t.split()) for _, t in templates]
        assert score == pytest.approx(max([*shares, 1.0 if base else 0.0]))
        assert labels == sorted({*base, *(label for (label, _), s in zip(templates, shares, strict=True) if s >= licenses.MIN_COVERED)})
        assert {x.template: pytest.approx(x.covered) for x in spans} == {k: s for k, s in enumerate(shares) if s >= licenses.MIN_COVERED}
        assert all(0 <= x.first <= x.last < len(words) for x in spans)


def test_a_stray_opening_does_not_end_a_chain():
    template = [f"w{i}" for i in range(20)]
    automaton = licenses.Automaton([("t", " ".join(template))], {})
    words = [w.encode() for w in [*template[:9], "zzz", *template[:4], "zzz", *template[14:18]]]
    assert automaton.scan(words)[4:6] == (["t"], 13 / 20)


def library(path):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def odd_texts():
    rng = random.Random(3)
    letters = "aeiou thsrv'lldmte  \n\t!?#<|>1239éßñ日　\xa0"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(400)] + ["Σ ΑΣ", "Ᲊ x", "a\ufdd0b \ufdd0", "x\u3000 \u2003\n y\x85 z\x1c \x1d\n", "\u0301 e\u0301\n\u0378\u0379 !\u0378 a\u0378b", "\0\0 a\0", "'re 'rx 'v\n'l ''s", "a" * 3000, "<|startoftext|><|endoftext|>x"]


def test_bpe_matches_the_library(docs, empty):
    tokenizer = library(BYTES)
    got = Counter(tuple(r) for r in queries.bpe_digests(docs, BYTES).collect())
    want = Counter()
    for i, t, _ in ROWS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert got == want
    assert queries.bpe_digests(empty, BYTES).count() == 0
    assert Counter((r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()) == Counter((i, t or "") for i, t, _ in ROWS)
    for path in (BYTES, WORDS):
        tokenizer, coder = library(path), bpe.Encoder(path)
        for some in (odd_texts(), odd_texts()[::-1], ["", None], []):
            ids, counts = coder.column(pa.array(some, pa.string()))
            cuts = bpe.ends_of(counts).tolist()
            assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]


def test_token_counts_match_the_library(docs, empty):
    tokenizer = library(BYTES)
    got = Counter(tuple(r) for r in token_count.token_counts(docs, BYTES, 100).collect())
    counts = [(i, t, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ROWS]
    assert got == Counter((i, len(raw(t)), n, n > 100) for i, t, n in counts)
    assert token_count.token_counts(empty, BYTES).count() == 0
    compiled = token_count.Compiled(BYTES)
    for some in (odd_texts(), odd_texts()[::-1], ["", None], []):
        assert compiled.column(pa.array(some, pa.string())).tolist() == [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in some]


def test_forgetting_changes_no_result(monkeypatch):
    for name in ("REMEMBERED", "SHORT", "ROWS"):
        monkeypatch.setattr(bpe, name, 3)
    for name in ("STATES", "PIECES", "SHORT"):
        monkeypatch.setattr(token_count, name, 3)
    for path in (BYTES, WORDS):
        tokenizer, coder = library(path), bpe.Encoder(path)
        for k in range(0, 100, 10):
            some = odd_texts()[k : k + 10]
            ids, _ = coder.column(pa.array(some))
            assert ids.tolist() == [x for t in some for x in tokenizer.encode(t, add_special_tokens=False).ids]
    tokenizer, compiled = library(BYTES), token_count.Compiled(BYTES)
    for k in range(0, 100, 10):
        some = odd_texts()[k : k + 10]
        assert compiled.column(pa.array(some)).tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in some]


def test_sharding(docs, empty):
    weights = [1.0] * 7
    rows = sharding.shard_records(docs, weights, [*weights, 1.0]).collect()
    assert len(rows) == len(ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t, _ in ROWS)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 7)
        assert r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert any(r.grown_shard == 7 for r in rows)
    assert sharding.shard_records(empty, weights).count() == 0
    heavy = Counter(r.shard for r in docs.sparkSession.range(4000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("shard")).collect())
    assert 2.6 < heavy[1] / heavy[0] < 3.4


def test_suffix_dedup(docs, empty):
    def plain(rows):
        seen, out = set(), {}
        for i, t in sorted({(i, t) for i, t, _ in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
            b = raw(t)
            hit = bytearray(len(b))
            for s in range(len(b) - 99):
                if b[s : s + 100] in seen:
                    hit[s : s + 100] = b"\1" * 100
                seen.add(b[s : s + 100])
            left = bytes(x for x, h in zip(b, hit, strict=True) if not h)
            out[i, t] = (len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(left).hexdigest(), left)
        return out

    want = plain(ROWS)
    for crowd in (2000, 2):
        got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs, crowd=crowd).collect())
        assert got == Counter((i, *want[i, t][:4]) for i, t, _ in ROWS)
    left = suffix_dedup.texts_without_repeats(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((i, want[i, t][4].decode("utf-8", "ignore")) for i, t, _ in ROWS)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_a_text_over_several_blocks(spark):
    rng = random.Random(2)
    passage = bytes(rng.choice(b"abcdefghij") for _ in range(5000)).decode()
    long_text = bytes(rng.choices(b"abcdefghij", k=1_500_000)).decode()
    text = long_text[:700_000] + passage + long_text[700_000:1_200_000] + passage + long_text[1_200_000:]
    (row,) = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert 5000 <= row.n_removed <= 5010
    assert row.n_spans == 1


def test_packing(docs, empty, monkeypatch):
    tokenizer = library(WORDS)
    rows = packing.pack(docs, WORDS, 64).collect()
    want = Counter()
    for i, t, _ in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            some = ids[at : at + 64]
            want[i, k, at, len(some), zlib.crc32(np.array(some, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) <= 1.05 * sum(r.length for r in rows) / 64 + 2
    assert packing.pack(empty, WORDS).count() == 0
    for ranks in (packing.RANKS, 3):  # blocks of ranks that entries of the plan cross
        monkeypatch.setattr(packing, "RANKS", ranks)
        whole = packing.pack(docs, WORDS, 64, keep_ids=True)
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole.collect()) == want
        joined = {r.sequence_id: r.ids for r in packing.sequences(whole).collect()}
        assert sum(map(len, joined.values())) == sum(r.length for r in rows)
        assert all(joined[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in whole.collect())


def test_packing_plan_is_best_fit():
    rng = random.Random(4)
    for _ in range(60):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 300)))
        room = []
        for length in sorted(counts.elements(), reverse=True):
            fitting = [i for i, r in enumerate(room) if r >= length]
            if fitting:
                room[min(fitting, key=lambda i: room[i])] -= length
            else:
                room.append(40 - length)
        planned = packing.plan(dict(counts), 40)
        sequences = set()
        for k, (length, rank, first, each, _) in enumerate(planned):
            upto = planned[k + 1][1] if k + 1 < len(planned) and planned[k + 1][0] == length else counts[length]
            sequences |= set(range(first, first + -(-(upto - rank) // each)))
        assert len(sequences) == len(room)


def test_simhash(docs, empty):
    import xxhash

    def plain(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(250)]
    near = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(250)] = "changed"
        near.append((1000 + i, " ".join(copy), "en"))
    rows = ROWS + near
    frame = docs.select("doc_id", "text", "lang").unionByName(docs.sparkSession.createDataFrame(near, "doc_id long, text string, lang string"))
    fps = [plain(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[max(root(i), root(j))] = min(root(i), root(j))
    smallest = {}
    for i, (doc_id, _, _) in enumerate(rows):
        if doc_id is not None:
            smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    want = Counter((rows[i][0], f"{fps[i]:016x}", smallest.get(root(i))) for i in range(len(rows)))
    for hot in (4096, 6):
        assert Counter(tuple(r) for r in simhash.near_duplicates(frame, hot=hot).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 51])
def test_carry_save_counters(radius):
    values = np.random.default_rng(1).integers(0, 1 << 62, (300, 4)).astype(np.uint64)
    values[:150] &= values[:150] >> np.uint64(1) & values[:150] >> np.uint64(2)
    values[:20] = 0
    values[10:20, 0] = 1 << 7
    distance = np.bitwise_count(values).sum(axis=1)
    assert (simhash.flags(simhash.within(simhash.bit_planes(values), radius), 300) == (distance <= radius)).all()


def rows_by_id(rows):
    return {i: text for i, text in rows if i is not None}


def test_near_stage_finds_similar_texts_only(spark):
    rng = random.Random(8)

    def text():
        return [f"w{rng.randrange(4000)}" for _ in range(200)]

    header = [f"h{i}" for i in range(8)]
    rows, copies = [], []
    for i in range(80):
        words = header + text()
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            words[rng.randrange(20, 190)] = "other"
            words[rng.randrange(20, 190)] = "another"
            copies.append(500 + i)
            rows.append((500 + i, " ".join(words)))
    for i in range(1, 40, 4):  # alike, but of a similarity of two thirds only
        rows.append((600 + i, " ".join(rows_by_id(rows)[i].split()[:168] + text()[:40])))
    rows += [(None, "x"), (None, "x"), (700, None), (701, ""), (702, "few words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (4096, 8):
        left = simhash.drop_near_copies(frame, hot=hot)
        kept = Counter(r.doc_id for r in left.collect())
        assert left.columns == frame.columns
        assert not set(copies) & set(kept)
        assert set(range(80)) <= set(kept)
        assert {600 + i for i in range(1, 40, 4)} <= set(kept)
        assert kept[None] == 2
        assert (kept[700], kept[701], kept[702]) == (1, 0, 1)


def test_quality_classifier(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", "en"), (None, "some text", "en")], "doc_id long, text string, lang string")
    rows = nbsvm.score_quality(docs.select("doc_id", "text", "lang").unionByName(odd), labels).collect()
    assert len(rows) == docs.count() + 3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.95 * len(held)
    assert nbsvm.score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in nbsvm.score_quality(odd, labels).collect()} == {0.5}


def test_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(1, 50, 20) if i % 2 else rng.integers(40, 90, 20)).astype(np.int32) for i in range(300)]
    labels = np.array([i % 2 for i in range(300)])
    model = nbsvm.fit(rows, labels)
    assert np.mean([(model.score(r) > 0.5) == (y == 1) for r, y in zip(rows, labels, strict=True)]) > 0.97
