"""BPE encoding and decoding with contiguous rank arrays.

A short word is a row of part ids and a row of the ranks of adjacent pairs, held without gaps. The smallest rank is
looked up by a scan, its boundary is deleted by closing the gap, and the two ranks beside the new part are refreshed;
that repeats until no pair of the row merges. Words of one length are rows of one matrix: each of them that still merges
loses one part in a step, so the matrix stays without padding and each scan, deletion and refresh is one array
operation. Words over ``LONG`` parts use a heap over a linked list instead, so that a very long word costs n log n rather
than n squared.

Words never reach across the border between a visible character and white space, so a text is cut there first, and
distinct pieces are encoded once and remembered up to a bound; then those that were met again stay. In a piece
with a character that Python's Unicode tables do not assign, the library finds the words (their class may differ between
Unicode versions); their ids come from the rank arrays like all others.

Defined cases: a null text counts as empty and has no ids; strings of special tokens inside a text become their ids, as
the library does by default; rows that repeat are encoded each; a null id stays null; an empty table gives an empty
table. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, tidied

LONG = 40
#: Pieces remembered by a worker, characters of the longest of them, and words handled in one matrix.
REMEMBERED, SHORT, ROWS = 250_000, 64, 4096
NONE = np.int32(1 << 30)

#: The pre-tokenizer patterns that the vocabulary files name.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: A character that Unicode never assigns, so that texts with it take the library's way of splitting.
BORDER = "\ufdd0"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Merges:
    """The merge table of a vocabulary file, ready for array lookups."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.vocab = vocab
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(max(vocab.values()), *self.special.values()) + 1
        self.by_pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.by_pair[vocab[a], vocab[b]] = (rank, vocab[a + b])
        ranks = np.array(list(self.by_pair.values()), dtype=np.int32)
        self.made = np.zeros(len(ranks), dtype=np.int32)
        self.made[ranks[:, 0]] = ranks[:, 1]
        self.hash_pairs(ranks[:, 0])
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], dtype=np.int32)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], dtype=np.int32)
        #: Ranks of two bytes, the second within a word or at its end.
        self.inner = self.rank(np.repeat(self.first, 256), np.tile(self.first, 256))
        self.outer = self.rank(np.repeat(self.first, 256), np.tile(self.last, 256))
        back = {s: b for b, s in enumerate(symbols)}
        self.token_bytes: dict[int, bytes] = {}
        for token, i in vocab.items():
            bare = token[: len(token) - len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            self.token_bytes[i] = bytes(back[c] for c in bare)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()

    def hash_pairs(self, ranks: np.ndarray) -> None:
        """An open-addressing table from pairs of ids to ranks, at most a quarter full."""
        pairs = np.array(list(self.by_pair), dtype=np.int64)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        self.shift = np.uint64(64 - (len(keys) * 4).bit_length())
        slots = 1 << (64 - int(self.shift))
        self.slot_key = np.full(slots + 1, -1, dtype=np.int64)
        self.slot_rank = np.full(slots + 1, NONE, dtype=np.int32)
        left, at = np.arange(len(keys)), self.slot_of(keys)
        while len(left):
            taken = self.slot_key[at] != -1
            free, first = np.unique(at[~taken], return_index=True)
            placed = left[~taken][first]
            self.slot_key[free], self.slot_rank[free] = keys[placed], ranks[placed]
            later = ~np.isin(left, placed)
            left, at = left[later], (at[later] + 1) & (slots - 1)

    def slot_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of part ids; NONE where no merge joins them."""
        wanted = left.astype(np.int64) << 32 | right
        at = self.slot_of(wanted)
        held = self.slot_key[at]
        out = self.slot_rank[at]
        other = np.flatnonzero(held != wanted)
        out[other] = NONE
        other = other[held[other] != -1]
        at = at[other]
        while len(other):
            at = (at + 1) & (len(self.slot_key) - 2)
            held = self.slot_key[at]
            hit = held == wanted[other]
            out[other[hit]] = self.slot_rank[at[hit]]
            on = ~hit & (held != -1)
            other, at = other[on], at[on]
        return out

    def start(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, dtype=np.uint8)
        ids = self.first[raw]
        ids[-1] = self.last[raw[-1]]
        return ids

    def long_word(self, word: bytes) -> list[int]:
        """One word by a heap over a linked list: the lowest rank first, the leftmost of equals."""
        ids = self.start(word).tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(found[0], i) for i in range(n - 1) if (found := self.by_pair.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or (found := self.by_pair.get((ids[i], ids[j]))) is None or found[0] != rank:
                continue
            ids[i], alive[j], after[i] = found[1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if ahead := self.by_pair.get((ids[i], ids[after[j]])):
                    heapq.heappush(heap, (ahead[0], i))
            if before[i] >= 0 and (behind := self.by_pair.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (behind[0], before[i]))
        return [x for x, on in zip(ids, alive, strict=True) if on]

    def short_words(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of words and their ids, from words of one length as rows of bytes; words that end with equally many
        parts together."""
        n = raw.shape[1]
        parts = self.first[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        rows = np.arange(len(raw))
        beside = raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]
        ranks = self.inner[beside]
        if n > 1:
            ranks[:, -1] = self.outer[beside[:, -1]]
        while ranks.shape[1]:
            live = np.arange(len(rows))
            at = ranks.argmin(axis=1)
            lowest = ranks[live, at]
            ended = lowest == NONE
            if ended.any():
                yield rows[ended], parts[ended]
                on = ~ended
                rows, parts, ranks, at, lowest = rows[on], parts[on], ranks[on], at[on], lowest[on]
                if not len(rows):
                    return
                live = live[: len(rows)]
            parts[live, at] = self.made[lowest]
            # deleting the boundary closes the gap to the right of the new part
            width = parts.shape[1] - 1
            kept = np.ones(parts.shape, dtype=bool)
            kept[live, at + 1] = False
            parts = parts[kept].reshape(len(rows), width)
            kept = np.ones(ranks.shape, dtype=bool)
            kept[live, at] = False
            ranks = ranks[kept].reshape(len(rows), width - 1)
            some = np.flatnonzero(at < width - 1)
            ranks[some, at[some]] = self.rank(parts[some, at[some]], parts[some, at[some] + 1])
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.rank(parts[some, at[some] - 1], parts[some, at[some]])
        yield rows, parts

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one word after the other, and how many each word has; words are not empty."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        counts = np.zeros(len(words), dtype=np.int64)
        made: list[tuple[np.ndarray, np.ndarray]] = []
        by_size = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[by_size], np.arange(1, LONG + 2))
        for n, (first, last) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), 1):
            for k in range(first, last, ROWS):
                some = by_size[k : min(k + ROWS, last)]
                made += [(some[rows], ids) for rows, ids in self.short_words(raw[starts[some][:, None] + np.arange(n)])]
        for i in by_size[cuts[-1] :].tolist():
            made.append((np.array([i]), np.array([self.long_word(words[i])], dtype=np.int32)))
        for rows, ids in made:
            counts[rows] = ids.shape[1]
        begins = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), dtype=np.int32)
        for rows, ids in made:
            out[begins[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, counts


class Encoder:
    """Encodes texts; the ids of each distinct piece between white space are found once."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.merges = Merges(path)
        self.lower = bool(self.merges.suffix)
        pattern = WORD_PATTERN if self.lower else BYTE_PATTERN
        # pieces are split many at a time, with a border behind each that ends a run as the end of a text does
        pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s\p{{L}}\p{{N}}{BORDER}]").replace(r"(?!\S)", rf"(?![^\s{BORDER}])")
        self.find = regex.compile(f"{pattern}|{BORDER}").findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")")
        self.of_special = self.merges.special
        self.opening = os.path.commonprefix(list(self.merges.special)).encode()
        self.back = {s: b for b, s in enumerate(byte_symbols())}
        self.even: set[str] = set()
        #: Numbers of remembered pieces; the ids of all pieces held and how many each has; whether it was met again.
        self.known: dict[str, int] = {}
        self.flat, self.sizes, self.again = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.library = None
        self.decoder = Decoder(self.merges)

    def is_odd(self, text: str) -> bool:
        """Whether it has characters that Python's Unicode version does not assign; other versions may class or case
        them differently."""
        new = set(text) - self.even
        if any(unicodedata.category(c) == "Cn" for c in new):
            return True
        self.even |= new
        return False

    def words_by_library(self, piece: str) -> list[bytes]:
        """The words that the library cuts a piece into."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(piece) if self.library.normalizer else piece
        return [bytes(map(self.back.__getitem__, word)) for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces, one piece after the other, and how many each has."""
        joined = BORDER.join(pieces)
        if joined.count(BORDER) >= len(pieces) or not joined.isascii() and self.is_odd(joined.replace(BORDER, "")):
            odd = [self.is_odd(piece) for piece in pieces]
            if any(odd):
                made = [self.merges.words(self.words_by_library(piece))[0] if own else self.encoded([piece])[0] for piece, own in zip(pieces, odd, strict=True)]
                return np.concatenate(made), np.array([len(ids) for ids in made])
        if self.lower:
            # one character at a time, as the library lower-cases: no final sigma
            joined = (joined if joined.isascii() else unicodedata.normalize("NFC", joined).replace("Σ", "σ")).lower()
        coded = pa.array(self.find(joined + BORDER), pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        border = distinct.index(BORDER)
        ids, counts = self.merges.words([w.encode() for w in distinct[:border] + distinct[border + 1 :]])
        counts = np.insert(counts, border, 0)
        indices = np.asarray(coded.indices)
        return gathered(ids, counts, indices, np.diff(np.flatnonzero(indices == border), prepend=-1))

    def forget(self) -> None:
        """Keeps what was met again since the last time, or nothing if that is most of it."""
        kept = [(piece, n) for piece, n in self.known.items() if self.again[n]]
        if 2 * len(kept) > REMEMBERED:
            kept = []
        numbers = np.array([n for _, n in kept], dtype=np.int64)
        self.flat, self.sizes = gathered(self.flat, self.sizes, numbers, np.ones(len(kept), dtype=np.int64))
        self.known = {piece: n for n, (piece, _) in enumerate(kept)}
        self.again = np.zeros(len(kept), dtype=bool)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Where distinct pieces stand among those whose ids are held; new ones join them."""
        if len(self.sizes) > REMEMBERED:
            self.forget()
        found = np.fromiter(map(self.known.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        missing = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        if len(missing):
            new, first = [pieces[i] for i in missing.tolist()], len(self.sizes)
            ids, sizes = self.encoded(new)
            self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
            self.again = np.concatenate([self.again, np.zeros(len(new), dtype=bool)])
            self.known.update((piece, n) for n, piece in enumerate(new, first) if len(piece) <= SHORT)
            found[missing] = np.arange(first, first + len(new))
        return found

    def column(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts, one after the other, and how many each text has; nulls have none."""
        raw, starts = as_bytes(texts)
        first = piece_starts(raw, starts)
        counts = np.diff(np.searchsorted(first, starts))
        special = {}
        if self.opening in raw.tobytes():
            for i in np.flatnonzero(pc.match_substring_regex(texts, self.special.pattern).fill_null(False)).tolist():
                special[i] = [t for t in self.special.split(texts[i].as_py()) if t]
        pieces = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(raw)).astype(np.int32)), pa.py_buffer(raw))
        if special:  # their pieces are cut between special tokens
            parts = [pieces.slice(0, 0)]
            ends, at = np.cumsum(counts), 0
            for i, some in special.items():
                begin = int(ends[i] - counts[i])
                own = [[t] if t in self.of_special else self.column_pieces(t) for t in some]
                parts += [pieces.slice(at, begin - at), pa.array([x for run in own for x in run], pa.string())]
                at = int(ends[i])
            pieces = pa.concat_arrays([*parts, pieces.slice(at)])
            for i, some in special.items():
                counts[i] = sum(1 if t in self.of_special else len(self.column_pieces(t)) for t in some)
        coded = pieces.dictionary_encode()
        known, indices = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
        if not special:
            return gathered(*self.held(known), indices, counts)
        own = np.array([self.of_special.get(x, -1) for x in known], dtype=np.int64)
        flat, sizes = self.held([x if i < 0 else "" for x, i in zip(known, own.tolist(), strict=True)])
        at = ends_of(sizes)[:-1][own >= 0]  # a special token is one id in place of none
        sizes[own >= 0] = 1
        return gathered(np.insert(flat, at, own[own >= 0]), sizes, indices, counts)

    def held(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after the other, and how many each has."""
        numbers = self.numbers(pieces)
        return gathered(self.flat, self.sizes, numbers, np.ones(len(pieces), dtype=np.int64))

    def column_pieces(self, text: str) -> list[str]:
        raw, starts = as_bytes(pa.array([text]))
        cuts = [*piece_starts(raw, starts).tolist(), len(raw)]
        return [raw[a:b].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encoder(path: str) -> Encoder:
    """The worker's encoder; it is built once for each worker."""
    return held(f"encoder {path}", lambda: Encoder(path))


#: Bytes of ASCII white space; the last byte and the one before it of characters that may be other white space.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MAY_END = np.isin(np.arange(256), [0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F])
MAY_LEAD = np.isin(np.arange(256), [0xC2, 0x9A, 0x80, 0x81])


def as_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of a column's texts, one after the other, and where each begins, with the end; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def piece_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin: at texts, and at ASCII white space behind what is no white space. Behind what may be other
    white space there is no cut, which only makes a longer piece."""
    white = WHITE[raw]
    begin = white.copy()
    begin[1:] &= ~white[:-1]
    begin[1:] &= ~MAY_END[raw[:-1]] | (raw[:-1] < 0x80) | ~np.concatenate([[False], MAY_LEAD[raw[:-2]]])[: max(0, len(raw) - 1)]
    begin[starts[:-1][starts[:-1] < len(raw)]] = True
    return np.flatnonzero(begin)


def ends_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def gathered(flat: np.ndarray, sizes: np.ndarray, indices: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, from those of the distinct ones and how many each of these has, and how many ids each run
    of so many pieces has."""
    begins = np.cumsum(sizes) - sizes
    own = sizes[indices]
    ends = ends_of(own)
    at = np.repeat(begins[indices] - ends[:-1], own) + np.arange(ends[-1])
    return flat[at], np.diff(ends[ends_of(counts)])


class Decoder:
    """Texts of ids, by one gather over all ids of a batch."""

    def __init__(self, merges: Merges) -> None:
        spelled = [merges.token_bytes.get(i, b"") for i in range(merges.size)]
        self.raw = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.sizes = np.array([len(b) for b in spelled])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of consecutive runs of so many ids; bytes that are no UTF-8 become replacement characters."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)
        raw = self.raw[at].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def slices(texts: pa.Array, limit: int = 2_000_000) -> Iterator[pa.Array]:
    """Runs of texts of about ``limit`` bytes, a longer text alone, so that what a worker holds is bounded."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield texts.slice(at, upto - at)
        at = upto


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; ``decoded`` adds text, what the ids spell."""
    names = ["doc_id", "ids", *(["text"] if decoded else [])]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for part in parts:
            at = 0
            for some in slices(part.column(1)):
                ids, counts = coder.column(some)
                lists = pa.ListArray.from_arrays(pa.array(ends_of(counts).astype(np.int32)), pa.array(ids))
                back = [pa.array(coder.decoder.texts(ids, counts), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(some)), lists, *back], names=names)
                at += len(some)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text, the text that the ids spell, special tokens included. Ids outside the vocabulary spell
    nothing; null ids are none."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path).decoder
        for part in parts:
            ids = part.column(1).fill_null([]) if part.column(1).null_count else part.column(1)
            counts = np.diff(np.asarray(ids.offsets))
            texts = coder.texts(np.asarray(ids.flatten()), counts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id long, ids array<int>, text string")
