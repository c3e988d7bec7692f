"""Token counts by finite-state tokenizer compilation, without making ids.

Two deterministic transducers are compiled from a byte-level vocabulary file:

* the splitter reads character classes and marks where pieces begin. Its states and transitions are a small table. A
  batch of texts is cut into chunks of equal length; every chunk is run from all states at once, which gives its state
  map; the maps are composed by a parallel prefix scan (log2 steps over all chunks), which gives the state in which
  each chunk is entered; a second run from that state emits the marks. A text may thus be cut anywhere, and very long
  texts cost no more by character than short ones;
* the counter reads the bytes of a piece. A transition is annotated with the number of tokens that it emits (it may be
  negative where tokens merge). What may still come depends on a prefix only through its longest end that begins some
  token, and through the last tokens of the prefixes that stop within that end, with their counts; these make up a
  state. So states are finite in number, pieces of any length run through the same table, and different prefixes share
  states. Transitions are compiled when they are first met: the last token of a prefix is the longest token at its end
  that may follow the last token of the prefix before it, which the merge ranks along the two touching sides decide.
  States are remembered up to a bound, then the compilation starts anew, which changes time and no count.

Defined cases: a null text counts as empty: no bytes, no tokens; strings of special tokens inside a text count one each,
as the library does by default; a text with characters that Python's Unicode version does not assign is split by the
library, and its pieces are counted like all others; rows that repeat are counted each; a null id stays null; an empty
table gives an empty table. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merges, as_bytes, byte_symbols, slices
from .common import held, tidied

CHUNK = 128
#: States of the counter and pieces that a worker remembers, and characters of the longest of them.
STATES, PIECES, SHORT = 400_000, 400_000, 64

(END, SPACE, WHITE, NUMBER, OTHER, QUOTE, LETTER, STMD, R, V, E, L) = range(12)
(START, LETTERS, NUMBERS, OTHERS, QUOTED, Q_R, Q_V, Q_L, CLOSED, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE) = range(13)
WIDTH = 16
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks by class * WIDTH + state. HERE: a piece begins at this character; BEFORE: at the one before."""
    following = np.zeros(WIDTH * WIDTH, dtype=np.uint8)
    marks = np.zeros(WIDTH * WIDTH, dtype=np.uint8)
    letters = (LETTER, STMD, R, V, E, L)
    plain = {NUMBER: NUMBERS, OTHER: OTHERS} | dict.fromkeys(letters, LETTERS)
    for state in range(13):
        for c in range(12):
            to, mark = START, HERE
            if c == END:
                mark = 0
            elif c in (SPACE, WHITE):
                if state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE):
                    to, mark = (MORE_SPACE if c == SPACE else MORE_WHITE), 0
                else:
                    to = ONE_SPACE if c == SPACE else ONE_WHITE
                    mark = HERE  # after a quote and r, v or l the mark before is added below
            elif c == QUOTE:
                if state in (OTHERS, QUOTED, ONE_SPACE, MORE_SPACE):
                    to, mark = OTHERS, BEFORE if state == MORE_SPACE else 0
                else:
                    to, mark = QUOTED, HERE | (BEFORE if state == MORE_WHITE else 0)
            else:
                to = plain[c]
                if state in (LETTERS, NUMBERS, OTHERS):
                    mark = 0 if to == state else HERE
                elif state == QUOTED:
                    if c == OTHER:
                        to, mark = OTHERS, 0
                    elif c in (STMD, R, V, L):
                        to, mark = {STMD: CLOSED, R: Q_R, V: Q_V, L: Q_L}[c], 0
                elif state in (Q_R, Q_V, Q_L):
                    if c == (L if state == Q_L else E):
                        to, mark = CLOSED, 0
                    elif to == LETTERS:
                        mark = 0  # the letter before begins the piece
                elif state == ONE_SPACE:
                    mark = 0
                elif state == MORE_SPACE:
                    mark = BEFORE
                elif state == MORE_WHITE:
                    mark = HERE | BEFORE
            if state in (Q_R, Q_V, Q_L) and to != CLOSED:
                mark |= BEFORE
            following[c * WIDTH + state], marks[c * WIDTH + state] = to, mark
    return following, marks


def classes() -> np.ndarray:
    """The class of every code point; 255 for those that are not assigned."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([255 if (k := unicodedata.category(chr(c))) == "Cn" else kind.get(k[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
    out[[c for c in range(0x10000) if regex.fullmatch(r"\s", chr(c))]] = WHITE
    for characters, c in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("e", E), ("l", L)):
        out[[ord(x) for x in characters]] = c
    return out


def entered(maps: np.ndarray) -> np.ndarray:
    """The state in which each chunk is entered, by a prefix scan that composes the chunks' state maps."""
    scan, step = maps.copy(), 1
    while step < len(scan):
        scan[step:] = np.take_along_axis(scan[step:], scan[:-step].astype(np.intp), axis=1)
        step *= 2
    return np.concatenate([[START], scan[:-1, START]]).astype(np.uint8)


class Counter:
    """The transducer over bytes that counts the tokens of a piece."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.by_bytes = {b: i for i, b in merges.token_bytes.items() if i not in merges.special.values()}
        self.beginnings = {b[:k] for b in self.by_bytes for k in range(len(b) + 1)}
        never = 1 << 40
        self.made_at = {made: rank for rank, made in merges.by_pair.values()}
        self.halves = {made: pair for pair, (_, made) in merges.by_pair.items()}
        self.never = never
        self.follows: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        #: What begins a token, as nodes: the bytes, and the tokens at their end with their widths, the longest first.
        self.node_of = {b"": 0}
        self.spelled, self.ending = [b""], [()]
        self.edges: dict[int, int] = {}
        self.reset()

    def reset(self) -> None:
        """The first state: at the first node, before any token, which counts none."""
        self.states: dict[tuple, int] = {(0, (-1,), (0,)): 0}
        self.held: list[tuple] = [(0, (-1,), (0,))]
        self.step: dict[int, int] = {}

    def next_node(self, node: int, byte: int) -> int:
        """The node of the longest end that begins some token."""
        found = self.edges.get(node << 8 | byte)
        if found is None:
            end = self.spelled[node] + bytes([byte])
            while end not in self.beginnings:
                end = end[1:]
            found = self.node_of.get(end)
            if found is None:
                found = self.node_of[end] = len(self.spelled)
                self.spelled.append(end)
                self.ending.append(tuple((token, len(end) - k) for k in range(len(end)) if (token := self.by_bytes.get(end[k:])) is not None))
            self.edges[node << 8 | byte] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens, both taken apart along it from the last merge back."""
        key = (left, right)
        if (known := self.follows.get(key)) is not None:
            return known
        made_at, halves, never = self.made_at, self.halves, self.never
        ends_left = ends_right = never  # the ranks at which the two sides become part of something larger
        answer = True
        while True:
            found = self.merges.by_pair.get((left, right))
            if found and found[0] < ends_left and found[0] <= ends_right:
                answer = False
                break
            at_left, at_right = made_at.get(left, -1), made_at.get(right, -1)
            if at_left < 0 and at_right < 0:
                break
            if at_left >= at_right:
                ends_left, left = at_left, halves[left][1]
            else:
                ends_right, right = at_right, halves[right][0]
        if len(self.follows) > STATES:
            self.follows.clear()
        self.follows[key] = answer
        return answer

    def is_whole(self, token: int) -> bool:
        """Whether the token's own bytes give the token."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merges.long_word(self.merges.token_bytes[token]) == [token]
        return known

    def compile(self, state: int, byte: int) -> int:
        """The transition from a state: the next state, and what it emits (plus 512) in the lowest ten bits."""
        node, tokens, counts = self.held[state]
        node = self.next_node(node, byte)
        wide = len(tokens)
        for token, width in self.ending[node]:
            before = tokens[wide - width]
            if self.is_whole(token) if before < 0 else self.may_follow(before, token):
                break
        else:
            raise AssertionError("single bytes are tokens")
        emits = counts[wide - width] + 1
        reach = wide - len(self.spelled[node])
        key = (node, (*tokens[reach:], token), (*(n - emits for n in counts[reach:]), 0))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.held)
            self.held.append(key)
        made = self.step[state << 8 | byte] = to << 10 | emits + 512
        return made

    def count(self, piece: bytes) -> int:
        if len(self.held) > STATES:
            self.reset()
        state, total, step = 0, -512 * len(piece), self.step.get
        for byte in piece:
            made = step(state << 8 | byte)
            if made is None:
                made = self.compile(state, byte)
            total += made & 1023
            state = made >> 10
        return total


class Compiled:
    """Both transducers of one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.merges = Merges(path)
        self.following, self.marks = splitter()
        self.classes = classes()
        self.counter = Counter(self.merges)
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special)))
        self.opening = os.path.commonprefix(list(self.merges.special)).encode()
        self.back = {s: b for b, s in enumerate(byte_symbols())}
        self.known: dict[str, int] = {}
        self.library = None

    def pieces_by_library(self, text: str) -> list[bytes]:
        """The pieces that the library cuts a text into."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return [bytes(map(self.back.__getitem__, piece)) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def begins(self, kinds: np.ndarray) -> np.ndarray:
        """Flags of the characters at which pieces begin."""
        n = len(kinds)
        rows = -(-n // CHUNK)
        padded = np.full(rows * CHUNK, END * WIDTH, dtype=np.uint8)
        padded[:n] = kinds * np.uint8(WIDTH)
        columns = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
        maps = np.tile(np.arange(13, dtype=np.uint8), (rows, 1))
        for column in columns:
            maps = self.following[column[:, None] + maps]
        state = entered(maps)
        marks = np.empty((CHUNK, rows), dtype=np.uint8)
        for k, column in enumerate(columns):
            at = column + state
            marks[k] = self.marks[at]
            state = self.following[at]
        flat = np.ascontiguousarray(marks.T).reshape(-1)[:n]
        begin = (flat & HERE).astype(bool)
        begin[:-1] |= (flat[1:] & BEFORE).astype(bool)
        return begin

    def counts_of(self, pieces: list[str]) -> np.ndarray:
        """The tokens of each of some distinct pieces."""
        if len(self.known) > PIECES:
            self.known = {piece: n for piece in pieces if (n := self.known.get(piece)) is not None}
        out = []
        for piece in pieces:
            n = self.known.get(piece)
            if n is None:
                n = self.counter.count(piece.encode())
                if len(piece) <= SHORT:
                    self.known[piece] = n
            out.append(n)
        return np.array(out, dtype=np.int64)

    def column(self, texts: pa.StringArray) -> np.ndarray:
        """Token counts of a column of texts, which should fit in memory a few times; nulls have none."""
        raw, starts = as_bytes(texts)
        if self.opening not in raw.tobytes():
            return self.plain(raw, starts)
        parts: list[str] = []
        owner: list[int] = []
        out = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts.to_pylist()):
            some = self.special.split(text or "")
            out[i] = len(some) - 1
            parts += some
            owner += [i] * len(some)
        np.add.at(out, owner, self.plain(*as_bytes(pa.array(parts, pa.string()))))
        return out

    def plain(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Token counts of texts without special tokens, given as UTF-8 and where each begins."""
        n = len(starts) - 1
        if not len(raw):
            return np.zeros(n, dtype=np.int64)
        raw = np.insert(raw, starts[1:-1], 0)  # one character between texts, classed as an end
        characters = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        wide = 1 + (characters > 0x7F).astype(np.int64) + (characters > 0x7FF) + (characters > 0xFFFF)
        at = np.cumsum(wide) - wide
        border = np.searchsorted(at, starts[1:-1] + np.arange(n - 1))
        kinds = self.classes[characters]
        kinds[border] = END
        odd = np.flatnonzero(kinds == 255)
        kinds[odd] = OTHER
        begin = self.begins(kinds)
        begin[border] = True
        places = np.flatnonzero(begin)
        pieces = pa.StringArray.from_buffers(len(places), pa.py_buffer(np.append(at[places], len(raw)).astype(np.int32)), pa.py_buffer(raw))
        coded = pieces.dictionary_encode()
        counts = self.counts_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(coded.indices)]
        counts[np.searchsorted(places, border)] = 0
        out = np.bincount(np.searchsorted(border, places, side="right"), weights=counts, minlength=n).astype(np.int64)
        ends = np.concatenate([[0], at[border] + 1, [len(raw) + 1]])
        for i in np.unique(np.searchsorted(border, odd, side="right")).tolist():
            text = raw[ends[i] : ends[i + 1] - 1].tobytes().decode()
            out[i] = sum(map(self.counter.count, self.pieces_by_library(text)))
        return out


def compiled(path: str) -> Compiled:
    return held(f"compiled {path}", lambda: Compiled(path))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than the limit)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(path)
        for part in parts:
            texts = part.column(1)
            counts = np.concatenate([np.zeros(0, np.int64), *(counter.column(some) for some in slices(texts, 2_000_000))])
            sizes = pc.binary_length(texts).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
