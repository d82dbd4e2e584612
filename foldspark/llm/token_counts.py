"""Token counts by a compiled finite-state tokenizer.

The tokenizer file (word-end BPE behind a splitting pattern) is compiled into
two deterministic transducers:

*   The lexer reads characters and marks where words of the pattern start.  It
    has seven states; a start may be announced one character late, when an
    apostrophe turns out not to open a contraction.  A text is cut into
    chunks of ``CHUNK`` characters, each chunk's state map (from every state
    at its start to the state at its end) is computed for all chunks in lock
    step, and the maps compose through a parallel prefix scan, which gives
    every chunk its starting state.  A second pass then emits the starts.
*   The word transducer's states are the spellings read so far, named by a
    rolling hash; such states compose over a word as affine maps do, so a
    word's final state is a sum over its characters.  The transitions at word
    ends are annotated with the emitted tokens.  Annotations are compiled from
    the file's merges (``Merges``) when a spelling is first met and kept in a
    direct-mapped table of fixed size; a spelling that was displaced is
    compiled again.

Character classes and case folding are tabulated by asking the tokenizer
itself, once for each code point.  Texts with characters that do not normalise
one by one, or with special strings, pass through the tokenizer's normaliser
before the lexer, piece by piece.

Defined cases: null and empty texts have no tokens; rows that repeat are
counted row by row; an empty table gives an empty table; input columns named
like computed ones are replaced.

Shape at scale: one scan, no shuffle.  Tables are built in each Python worker
and hold a fixed number of bytes.  A long text is cut at blanks into pieces
of about a megabyte, so memory does not follow its length.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from foldspark.llm._common import prepare
from foldspark.llm.words import BLOCK_BYTES, _STEPS, mixed, powers

CHUNK = 128
SLOTS = 1 << 20
#: Tokens of a word that the table holds; longer words are compiled each time.
HELD = 6

# character classes
BLANK, LETTER, NUMBER, OTHER, APOSTROPHE, SHORT, R, V, L, E, SPECIAL, BREAK = range(12)
# states of the lexer
OUT, WORD, SIGNS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
STARTS, STARTED = 1, 2  # a word starts at this character; at the one before
_UNKNOWN = 255
_BREAK = 0x110000
_SPECIAL = 0x110001
#: Below this code point there are no combining marks.
_PLAIN = 0x300


def lexer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for (state, class)."""
    follow, marks = np.zeros((7, 12), np.uint8), np.zeros((7, 12), np.uint8)
    letters = (LETTER, SHORT, R, V, L, E)
    fresh = {BLANK: (OUT, 0), BREAK: (OUT, 0), NUMBER: (OUT, STARTS), SPECIAL: (OUT, STARTS), OTHER: (SIGNS, STARTS), APOSTROPHE: (QUOTE, STARTS)}
    fresh |= {c: (WORD, STARTS) for c in letters}
    rules = {OUT: dict(fresh)}
    rules[WORD] = fresh | {c: (WORD, 0) for c in letters}
    rules[SIGNS] = fresh | {OTHER: (SIGNS, 0), APOSTROPHE: (SIGNS, 0)}
    rules[QUOTE] = rules[SIGNS] | {SHORT: (OUT, 0), R: (QUOTE_R, 0), V: (QUOTE_V, 0), L: (QUOTE_L, 0)}
    for state, closing in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        late = {c: (WORD, 0) if c in letters else to for c, to in fresh.items()}
        rules[state] = {c: (s, m | STARTED) for c, (s, m) in late.items()} | {closing: (OUT, 0)}
    for state, row in rules.items():
        for c, (s, m) in row.items():
            follow[state, c], marks[state, c] = s, m
    return follow, marks


_FOLLOW, _MARKS = lexer()


def lex(classes: np.ndarray) -> np.ndarray:
    """Marks for every character, by chunk maps and a prefix scan."""
    n = len(classes)
    k = -(-n // CHUNK)
    padded = np.full(k * CHUNK, BREAK, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(k, CHUNK).T)
    follow = _FOLLOW.ravel()
    maps = np.repeat(np.arange(7, dtype=np.uint8)[:, None], k, axis=1)
    for c in steps:
        maps = follow[maps * np.uint8(12) + c]
    before = prefix(maps)
    state = before[OUT]
    marks, flat = np.empty((CHUNK, k), np.uint8), _MARKS.ravel()
    for i, c in enumerate(steps):
        at = state * np.uint8(12) + c
        marks[i] = flat[at]
        state = follow[at]
    return marks.T.ravel()[:n]


def prefix(maps: np.ndarray) -> np.ndarray:
    """The composition of all maps before each one (maps: state by chunk)."""
    k = maps.shape[1]
    through = maps.copy()
    reach = 1
    while reach < k:
        through[:, reach:] = np.take_along_axis(through[:, reach:], through[:, :-reach], axis=0)
        reach *= 2
    before = np.empty_like(maps)
    before[:, 0] = np.arange(7)
    before[:, 1:] = through[:, :-1]
    return before


class Merges:
    """The merges of a file: a pair of tokens to its rank and the token made."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain merge model")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        # printable bytes spell themselves, the others follow above 255 in order
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        above = iter(range(0x100, 0x200))
        spelt = [chr(b) if b in plain else chr(next(above)) for b in range(256)]
        self.inner = [vocab[c] for c in spelt]
        self.last = [vocab[c + end] for c in spelt]
        self.made: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.made.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))

    def tokens(self, word: str) -> list[int]:
        """The word's bytes, merged by rank, the first of equals first.  Pairs
        wait in a heap, so that a word of any length takes n log n steps."""
        raw = word.encode()
        own = [self.inner[b] for b in raw[:-1]]
        own.append(self.last[raw[-1]])
        made, n = self.made, len(own)
        waiting = [(*made[p], i) for i, p in enumerate(zip(own, own[1:], strict=False)) if p in made]
        if not waiting:
            return own
        heapify(waiting)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        while waiting:
            rank, token, i = heappop(waiting)
            j = behind[i]
            if own[i] < 0 or j == n or made.get((own[i], own[j])) != (rank, token):
                continue  # one of the two has been merged since
            own[i], own[j] = token, -1
            after = behind[i] = behind[j]
            if after < n:
                before[after] = i
                if (found := made.get((token, own[after]))) is not None:
                    heappush(waiting, (*found, i))
            if (left := before[i]) >= 0 and (found := made.get((own[left], token))) is not None:
                heappush(waiting, (*found, left))
        return [t for t in own if t >= 0]


class Compiled:
    """The transducers of one tokenizer file, with the tables filled so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)  # normaliser and character classes
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.merges, added = Merges(file["model"]), file["added_tokens"]
        ids = [*file["model"]["vocab"].values(), *(x["id"] for x in added)]
        self.kind = np.uint16 if max(ids) < 1 << 16 else np.uint32
        self.special = {x["content"]: x["id"] for x in added}
        self.special_ids = np.array([x["id"] for x in added], np.uint32)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.special_at = {x["content"]: i for i, x in enumerate(added)}
        self.classes = np.full(_SPECIAL + len(added), _UNKNOWN, np.uint8)
        self.classes[_BREAK] = BREAK
        self.classes[_SPECIAL:] = SPECIAL
        self.folded = np.zeros(_PLAIN, np.uint32)
        for c in range(_PLAIN):
            out = self.whole.normalizer.normalize_str(chr(c))
            self.folded[c] = ord(out) if len(out) == 1 else 0
        self.keys = np.zeros(SLOTS, np.uint64)
        self.sizes = np.zeros(SLOTS, np.uint8)
        self.tokens = np.zeros((SLOTS, HELD), self.kind)

    # -- characters

    def code_points(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised code points, a break after every text; where texts begin."""
        parts = []
        for text in texts:
            own = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            plain = not len(own) or own.max() < _PLAIN
            if plain and not any(s in text for s in self.special):
                folded = self.folded[own]
                if folded.all() or not (own[folded == 0]).any():
                    parts.append(folded)
                    continue
            parts.append(self.normalised(text))
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        at = np.r_[0, np.cumsum(sizes)]
        out = np.full(int(at[-1]), _BREAK, np.uint32)
        for i, p in enumerate(parts):
            out[at[i] : at[i] + len(p)] = p
        return out, at

    def normalised(self, text: str) -> np.ndarray:
        pieces = []
        for piece in self.split.split(text) if self.split else [text]:
            if piece in self.special:
                pieces.append(np.array([_SPECIAL + self.special_at[piece]], np.uint32))
            elif piece:
                pieces.append(np.frombuffer(self.whole.normalizer.normalize_str(piece).encode("utf-32-le"), np.uint32))
        return np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)

    def classes_of(self, chars: np.ndarray) -> np.ndarray:
        found = self.classes[chars]
        if (found == _UNKNOWN).any():
            for c in np.unique(chars[found == _UNKNOWN]).tolist():
                self.classes[c] = self.class_of(chr(c))
            found = self.classes[chars]
        return found

    def class_of(self, c: str) -> int:
        named = {"'": APOSTROPHE, "r": R, "v": V, "l": L, "e": E} | dict.fromkeys("stmd", SHORT)
        if c in named:
            return named[c]
        pieces = lambda s: len(self.whole.pre_tokenizer.pre_tokenize_str(s))
        twice = pieces(c + c)
        if twice != 1:
            return NUMBER if twice == 2 else BLANK
        return LETTER if pieces("a" + c) == 1 else OTHER

    # -- words

    def emit(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray], np.ndarray]:
        """For all words of the texts: numbers of tokens, tokens (as many as the
        table holds), the words' first places by text, the tokens of longer
        words by word, and the words' table rows."""
        chars, at = self.code_points(texts)
        classes = self.classes_of(chars)
        marks = lex(classes)
        starting = (marks & STARTS).astype(bool)
        starting[:-1] |= (marks[1:] & STARTED).astype(bool)
        bound = np.flatnonzero(starting | (classes == BLANK) | (classes == BREAK))
        is_word = starting[bound[:-1]]
        start, end = bound[:-1][is_word], bound[1:][is_word]
        row_at = np.searchsorted(start, at)
        n = len(start)
        if not n:
            return np.zeros(0, np.int64), np.zeros((0, HELD), self.kind), row_at, {}, start
        size = end - start
        first = np.cumsum(size) - size
        index = np.arange(int(first[-1] + size[-1])) - np.repeat(first, size)
        letters = chars[np.repeat(start, size) + index].astype(np.uint64) * _STEPS[0] ^ _STEPS[1]
        key = mixed(np.add.reduceat(letters * powers(int(size.max()))[index], first) + size.astype(np.uint64)) | np.uint64(1)
        slot = (key >> np.uint64(20)) & np.uint64(SLOTS - 1)
        hit = self.keys[slot] == key
        counts, tokens = self.sizes[slot].astype(np.int64), self.tokens[slot]
        long: dict[int, np.ndarray] = {}
        missed = np.flatnonzero(~hit)
        if len(missed):
            names, one, back = np.unique(key[missed], return_index=True, return_inverse=True)
            compiled = [self.compile(chars[start[i] : end[i]]) for i in missed[one].tolist()]
            sizes = np.array([len(x) for x in compiled], np.int64)
            table = np.zeros((len(compiled), HELD), self.kind)
            for i, x in enumerate(compiled):
                table[i, : min(len(x), HELD)] = x[:HELD]
            counts[missed], tokens[missed] = sizes[back], table[back]
            if (sizes > HELD).any():
                for place, i in zip(missed.tolist(), back.tolist(), strict=True):
                    if sizes[i] > HELD:
                        long[place] = np.array(compiled[i], self.kind)
            keep = sizes <= HELD
            where = ((names >> np.uint64(20)) & np.uint64(SLOTS - 1))[keep]
            self.keys[where], self.sizes[where], self.tokens[where] = names[keep], sizes[keep], table[keep]
        return counts, tokens, row_at, long, start

    def compile(self, chars: np.ndarray) -> list[int]:
        if len(chars) == 1 and chars[0] >= _SPECIAL:
            return [int(self.special_ids[chars[0] - _SPECIAL])]
        return self.merges.tokens(chars.tobytes().decode("utf-32-le"))

    def count(self, texts: list[str]) -> np.ndarray:
        counts, _, row_at, _, _ = self.emit(texts)
        total = np.r_[0, np.cumsum(counts)]
        return total[row_at[1:]] - total[row_at[:-1]]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of every text."""
        counts, tokens, row_at, long, _ = self.emit(texts)
        at = np.r_[0, np.cumsum(counts)]
        out = np.empty(int(at[-1]), np.uint32)
        for j in range(HELD):
            some = np.flatnonzero(counts > j)
            out[at[some] + j] = tokens[some, j]
        for word, own in long.items():
            out[at[word] : at[word + 1]] = own
        bounds = at[row_at]
        return [out[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


_compiled: dict[str, Compiled] = {}


def compiled(path: str) -> Compiled:
    """One for each Python worker, which Spark keeps between tasks."""
    if path not in _compiled:
        _compiled[path] = Compiled(path)
    return _compiled[path]


def portions(texts: pa.Array) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts in portions of about a megabyte, with the row of each.  A longer
    text is cut at blanks, where no word and no special string can cross."""
    rows, held, size = [], [], 0
    for row, text in enumerate(pc.fill_null(texts, "").to_pylist()):
        at = 0
        while True:
            piece, at = cut_at_blank(text, at)
            rows.append(row)
            held.append(piece)
            size += len(piece)
            if size >= BLOCK_BYTES:
                yield np.array(rows), held
                rows, held, size = [], [], 0
            if at >= len(text):
                break
    if held:
        yield np.array(rows), held


_BLANK_CHAR = re.compile(r"[ \t\n]")


def cut_at_blank(text: str, at: int) -> tuple[str, int]:
    if len(text) - at <= BLOCK_BYTES:
        return text[at:], len(text)
    blank = _BLANK_CHAR.search(text, at + BLOCK_BYTES)
    # a blank and a combining mark behind it stay together
    end = blank.start() if blank else len(text)
    return text[at:end], end


def token_counts(docs: DataFrame, path: str, *, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``over_limit``."""
    prepare(docs.sparkSession)
    docs = docs.drop("n_tokens", "over_limit")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducers = compiled(path)
        for batch in batches:
            total = np.zeros(batch.num_rows, np.int64)
            for rows, texts in portions(batch.column(at)):
                np.add.at(total, rows, transducers.count(texts))
            yield batch.append_column("n_tokens", pa.array(total)).append_column("over_limit", pa.array(total > limit))

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, n_tokens long, over_limit boolean")
