"""Token counts by finite-state transducers compiled from a byte-level BPE file."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Input symbols of the splitter. A white-space run's last character has a symbol of its own where
#: something follows it, and an apostrophe where a contraction does.
LETTER, NUMBER, OTHER, LAST_BLANK, LAST_SPACE, SPACE, CUT_2, CUT_3, END = range(9)
#: Its states: at a border, in letters, in numbers, in others, after a joining blank, in white space,
#: and one or two characters before the end of a contraction.
BORDER, IN_LETTERS, IN_NUMBERS, IN_OTHER, BLANK, IN_SPACE, ONE_MORE, TWO_MORE = range(8)
STATES, SYMBOLS = 8, 9
CHUNK = 512
#: Pieces of more bytes than LONG are cut into blocks, which are counted side by side.
LONG, BLOCK = 2048, 512
#: A block's entry state is guessed from so many bytes before it, and at most so many guesses are held.
WARM, GUESSES = 48, 12
#: Compiled states of the counting transducer that a worker keeps, unless more are in use at once.
MOST_STATES = 300_000
PORTION = 2_000_000


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transition table and border table of the transducer that finds where pieces begin.

    It works for the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+``.
    """
    goes = np.zeros((STATES, SYMBOLS), dtype=np.uint8)
    border = np.ones((STATES, SYMBOLS), dtype=bool)
    goes[:, [LETTER, NUMBER, OTHER, LAST_BLANK, LAST_SPACE, SPACE, CUT_2, CUT_3, END]] = [IN_LETTERS, IN_NUMBERS, IN_OTHER, BLANK, BORDER, IN_SPACE, ONE_MORE, TWO_MORE, BORDER]
    border[[IN_LETTERS, BLANK], LETTER] = border[[IN_NUMBERS, BLANK], NUMBER] = border[[IN_OTHER, BLANK], OTHER] = border[IN_SPACE, SPACE] = False
    for cut in (CUT_2, CUT_3):
        goes[[IN_OTHER, BLANK], cut] = IN_OTHER
        border[[IN_OTHER, BLANK], cut] = False
    goes[ONE_MORE, :END], goes[TWO_MORE, :END] = BORDER, ONE_MORE
    border[[ONE_MORE, TWO_MORE]] = False
    border[:, END] = False
    return goes, border


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan: out[i] is maps[i] after maps[i-1] after ... maps[0], in log steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.int64), axis=1)
        step *= 2
    return out


@dataclass
class Vocabulary:
    """What both transducers are compiled from: pieces by bytes, merge ranks, special strings and character classes."""

    ids: dict[bytes, int]
    ranks: dict[tuple[bytes, bytes], int]
    special: list[str]
    classes: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        # Byte-level files write a byte that can't be printed as the next character from 256 on.
        letter_of = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        byte_of = {c: b for b, c in letter_of.items()}
        raw = lambda s: bytes(byte_of[c] for c in s)
        special = [t["content"] for t in spec["added_tokens"]]
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in set(special)}
        ranks = {tuple(map(raw, m.split(" ") if isinstance(m, str) else m)): k for k, m in enumerate(spec["model"]["merges"])}
        return cls(ids, ranks, special, character_classes(path))


def character_classes(path: str) -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of every code point, as the library's own splitter takes them.

    Each assigned character is put after a letter and after a digit and after a
    mark; whichever it joins is its class.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer
    known = regex.compile(r"[\p{L}\p{N}\s]")
    asked = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) not in ("Cn", "Co") or known.match(chr(c)))]
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    left = np.array(asked)
    joined = np.zeros(len(left), dtype=bool)
    for before, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
        text = "".join(before + chr(c) + "\n" for c in left)
        starts = np.zeros(len(text) + 1, dtype=bool)
        starts[[at for _, (at, _) in cut.pre_tokenize_str(text)]] = True
        joined = ~starts[1 : 3 * len(left) : 3]
        classes[left[joined]] = kind
        left = left[~joined]
    classes[left] = SPACE
    return classes


class Transitions:
    """A hash table of transitions in arrays, probed for many keys at once; -1 stands for a missing one."""

    def __init__(self) -> None:
        self.bits, self.used = 14, 0
        self.keys, self.values = np.full(1 << 14, -1), np.full(1 << 14, -1, dtype=np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are all new and differ."""
        self.used += len(keys)
        if 3 * self.used > len(self.keys):
            held = self.keys >= 0
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self.bits = int(6 * self.used - 1).bit_length()
            self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1, dtype=np.int64)
        slot = self.slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            _, one = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            one = one[free[one]]
            self.keys[slot[one]], self.values[slot[one]] = keys[one], values[one]
            left = np.ones(len(keys), dtype=bool)
            left[one] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)


class Counter:
    """The two transducers. One instance serves a worker; the second one is compiled as its states are met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.goes, self.border = splitter()
        self.prefixes = {t[:k] for t in vocabulary.ids for k in range(1, len(t) + 1)}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.reset()

    def reset(self) -> None:
        """Forgets all compiled states but the first."""
        self.states: list[tuple] = [(b"", ((0, None, 0),))]
        self.number = {self.states[0]: 0}
        self.table = Transitions()
        self.room = MOST_STATES

    def number_of(self, state: tuple) -> int:
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
        return number

    def shrink(self, used: list[np.ndarray]) -> None:
        """Forgets all compiled states but those in ``used``, where they get their new numbers in place; -1 is none."""
        before, now = self.states, np.full(len(self.states) + 1, -1, dtype=np.int64)
        self.reset()
        for state in np.unique(np.concatenate([u.ravel() for u in used])).tolist():
            if state >= 0:
                now[state] = self.number_of(before[state])
        for u in used:
            u[...] = now[u]
        self.room = max(MOST_STATES, 2 * len(self.states))

    def encode(self, piece: bytes) -> list[bytes]:
        """The merges applied to a few bytes, lowest rank first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.v.ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: bytes | None, b: bytes) -> bool:
        """Whether token b can follow token a, that is, the two stay as they are when their bytes are encoded."""
        if a is None:
            return True
        if (a, b) not in self.pairs:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            self.pairs[a, b] = self.encode(a + b) == [a, b]
        return self.pairs[a, b]

    def compile(self, state: int, byte: int) -> int:
        """One transition: next state << 8 | tokens emitted + 128.

        A state knows every earlier point from which a token may still be
        growing: how far back it is, the last token of the encoding up to it,
        and how many tokens fewer that encoding has. An encoding's last token
        is the longest that fits behind the encoding of what is before it.
        """
        tail, points = self.states[state]
        tail += bytes((byte,))
        for back, last, fewer in points:  # furthest first
            token = tail[len(tail) - back - 1 :]
            if token in self.v.ids and self.fits(last, token):
                emitted = fewer + 1
                break
        kept = [(back + 1, last, fewer - emitted) for back, last, fewer in points if tail[len(tail) - back - 1 :] in self.prefixes]
        kept.append((0, token, 0))
        return self.number_of((tail[len(tail) - kept[0][0] :], tuple(kept))) << 8 | (emitted + 128)

    def borders(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin among the code points of texts that each end with a code point at ``ends``.

        The code points are cut into chunks without regard to texts. A chunk's
        map from entry to exit state is found for all states at once; the maps
        are composed by a prefix scan; then each chunk's entry state is known.
        """
        kind = self.v.classes[codes]
        symbol = kind.copy()
        symbol[ends] = END
        after = np.append(symbol[1:], END)
        last = (kind == SPACE) & (after != SPACE) & (after != END)
        symbol[last] = np.where(codes[last] == 32, LAST_BLANK, LAST_SPACE)
        symbol[ends] = END
        quote = np.flatnonzero(codes[:-1] == 39)
        one, two = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
        symbol[quote[np.isin(one, [115, 116, 109, 100])]] = CUT_2  # s t m d
        pair = one.astype(np.int64) * 0x110000 + two
        symbol[quote[np.isin(pair, [a * 0x110000 + b for a, b in ((114, 101), (118, 101), (108, 108))])]] = CUT_3  # re ve ll
        chunks = -(-len(symbol) // CHUNK)
        padded = np.full(chunks * CHUNK, END, dtype=np.uint8)
        padded[: len(symbol)] = symbol
        lanes = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        flat_goes, flat_border = self.goes.ravel(), self.border.ravel()
        maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
        for symbols in lanes:
            maps = flat_goes[maps * np.uint8(SYMBOLS) + symbols[:, None]]
        entry = np.concatenate([[BORDER], compose_scan(maps)[:-1, BORDER]]).astype(np.uint8)
        begins = np.zeros((CHUNK, chunks), dtype=bool)
        for t, symbols in enumerate(lanes):
            at = entry * np.uint8(SYMBOLS) + symbols
            begins[t] = flat_border[at]
            entry = flat_goes[at]
        return begins.T.reshape(-1)[: len(symbol)]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        parts, owner = [], []
        extra = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if self.special else [text]
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        joined = "\n".join(parts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        begins = self.borders(codes, ends)
        wide = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        offset = np.cumsum(wide) - wide
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        starts = np.flatnonzero(begins)
        part = np.searchsorted(ends, starts)
        limit = np.append(starts[1:], len(codes))
        limit = np.minimum(limit, ends[part])
        first, size = offset[starts], offset[limit] - offset[starts]
        tokens = self.run(data, first, size)
        total = np.bincount(part, weights=tokens, minlength=len(parts)).astype(np.int64)
        return extra + np.bincount(owner, weights=total, minlength=len(texts)).astype(np.int64)

    def run(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each piece."""
        out = np.empty(len(first), dtype=np.int64)
        long_ = size > LONG
        out[long_] = self.in_blocks(data, first[long_], size[long_])
        out[~long_] = self.lanes(data, first[~long_], size[~long_], np.zeros(int((~long_).sum()), dtype=np.int64))[0]
        return out

    def lanes(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, entry: np.ndarray, held: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and exit state of each stretch of bytes from its entry state; all advance by one byte at a time.

        ``held`` are arrays of states that the caller needs afterwards.
        """
        order = np.argsort(-size, kind="stable")
        at, size = first[order], size[order]
        state = entry[order]
        tokens = np.zeros(len(at), dtype=np.int64)
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for t, k in enumerate(live):
            key = state[:k] << 8 | data[at[:k] + t]
            step = self.table.get(key)
            new = step < 0
            if new.any():
                missing = np.unique(key[new])
                self.table.put(missing, np.array([self.compile(m >> 8, m & 255) for m in missing.tolist()]))
                step[new] = self.table.get(key[new])
            state[:k] = step >> 8
            tokens[:k] += (step & 255) - 128
            if len(self.states) > self.room:
                self.shrink([state, *held])
        back = np.empty(len(at), dtype=np.int64)
        back[order] = np.arange(len(at))
        return tokens[back], state[back]

    def in_blocks(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of long pieces, whose blocks are counted side by side.

        A block holds a map from the entry states that were tried to their exit
        states and token counts. The first one tried is where a run over the few
        bytes before it leads, which is mostly right. The maps are composed by a
        prefix scan from each piece's beginning; blocks that it does not reach
        are run again from exit states of the block before, all at once, until
        it reaches all. At least the first such block of each piece is then right.
        """
        counts = -(-size // BLOCK)
        piece = np.repeat(np.arange(len(size)), counts)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = first[piece] + nth * BLOCK
        length = np.minimum(BLOCK, first[piece] + size[piece] - start)
        total = np.zeros(len(size), dtype=np.int64)
        entry = np.full((len(piece), GUESSES), -1, dtype=np.int64)
        leaves, tokens = entry.copy(), np.zeros_like(entry)
        head = nth == 0
        warm = np.where(head, 0, WARM)
        wanted = self.lanes(data, start - warm, warm, np.zeros(len(piece), dtype=np.int64))[1]
        column = 0
        while len(piece):
            rows = np.flatnonzero(wanted >= 0)
            to = np.where(head[rows], 0, column)
            entry[rows, to] = wanted[rows]
            tokens[rows, to], leaves[rows, to] = self.lanes(data, start[rows], length[rows], wanted[rows], (entry, leaves))
            # maps[i, g]: which guess of block i the g-th guess of block i - 1 leads to, or GUESSES for none.
            same = leaves[:-1, :, None] == entry[1:, None, :]
            same &= leaves[:-1, :, None] >= 0
            maps = np.full((len(piece), GUESSES + 1), GUESSES, dtype=np.int64)
            maps[1:, :GUESSES] = np.where(same.any(axis=2), same.argmax(axis=2), GUESSES)
            maps[head] = 0
            reached = compose_scan(maps)[:, 0]
            known = np.flatnonzero(reached < GUESSES)
            np.add.at(total, piece[known], tokens[known, reached[known]])
            # What is left begins, in each piece, behind the last block reached.
            left = reached == GUESSES
            now_head = left & np.append(False, ~left[:-1])
            before = np.flatnonzero(now_head) - 1
            wanted = np.full(len(piece), -1, dtype=np.int64)
            untried = (leaves[:-1] >= 0) & ~same.any(axis=2)
            wanted[1:] = np.where(untried.any(axis=1), leaves[np.arange(len(piece) - 1), untried.argmax(axis=1)], -1)
            wanted[now_head] = leaves[before, reached[before]]
            piece, start, length, head, wanted = piece[left], start[left], length[left], now_head[left], wanted[left]
            entry, leaves, tokens = entry[left], leaves[left], tokens[left]
            column = 1 + column % (GUESSES - 1)
        return total


_counters: dict[str, Counter] = {}


def worker_counter(path: str, sent: Broadcast) -> Counter:
    """This worker process's counter, kept between tasks so that its states are compiled once."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(sent.value)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Adds ``n_bytes, n_tokens, over_limit`` to ``docs``; earlier columns of these names are replaced.

    The counts are those of the library for the byte-level BPE file at
    ``path``, special strings in texts included, without added tokens. Null
    counts as empty, which has no token. ``path`` is read on the driver only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = worker_counter(path, sent)
        for texts in batches:
            out: list[np.ndarray] = []
            part: list[str] = []
            held = 0
            for text in texts:
                part.append(text)
                held += len(text)
                if held >= PORTION:
                    out.append(counter.count(part))
                    part, held = [], 0
            if part:
                out.append(counter.count(part))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0, dtype=np.int64))

    body = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.withColumn("n_bytes", F.octet_length(body).cast("long")).withColumn("n_tokens", tokens(body))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
