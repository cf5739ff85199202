"""Token counts by a tokenizer compiled to finite-state transducers.

Two machines, compiled from a public byte-level BPE vocabulary:

* One reads characters and tells where the pieces begin that the vocabulary's
  pattern cuts a text into. It has few states, so what a chunk of text does is
  a map from the state before it to the state after it. All chunks are run
  from all states at once, the maps are composed by a parallel prefix scan,
  and then each chunk is run from the one state that it really starts in.
* One reads the bytes of a piece. Its state holds the last token of each
  prefix within reach; a transition says by how many the tokens of the prefix
  change. A token can follow another if merging both their bytes gives just
  these two, and for each prefix exactly one last token can.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, alone, blocks, fields, keeps

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024

# Classes of characters. Some letters have their own: they may end a contraction.
LETTER, ENDS, R, V, E, L, NUMBER, BLANK, SPACE, QUOTE, OTHER, RESET = range(12)
# States: what the characters read so far leave open.
START, WORD, DIGITS, SIGNS, AFTER_BLANK, AFTER_SPACE, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CONTRACTED = range(11)
STATES, CLASSES = 11, 12
#: White space by Unicode (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK = 64
#: Pieces whose counts a worker remembers, and compiled states that a worker keeps before it starts afresh.
MOST_PIECES, MOST_STATES = 1_000_000, 300_000


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    import regex

    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, chars):
            a, b = ord(chars[m.start()]), ord(chars[m.end() - 1])
            table[a : b + 1] = kind
    for chars_of, kind in (("stmd", ENDS), ("r", R), ("v", V), ("e", E), ("l", L), ("'", QUOTE)):
        table[[ord(c) for c in chars_of]] = kind
    table[WHITE_SPACE] = SPACE
    table[0x20] = BLANK
    return table


@lru_cache(maxsize=1)
def piece_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for each state and class. Output bit 0: a piece begins here; bit 1: one begins a character before."""
    move, out = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    letters = {LETTER, ENDS, R, V, E, L}
    for q in range(STATES):
        for c in range(CLASSES):
            white, before = c in (BLANK, SPACE), q in (AFTER_BLANK, AFTER_SPACE)
            late = 0
            if c == RESET:
                move[q, c] = START
                out[q, c] = 1 | (2 if q in (QUOTED_R, QUOTED_V, QUOTED_L) else 0)
                continue
            if q == QUOTED and c in (ENDS, R, V, L):
                move[q, c] = {ENDS: CONTRACTED, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c]
                continue
            if (q, c) in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
                move[q, c] = CONTRACTED
                continue
            if q in (QUOTED_R, QUOTED_V, QUOTED_L):  # no contraction: the letter began a word
                late, q_now = 2, WORD
            elif q == QUOTED:
                q_now = SIGNS
            else:
                q_now = q
            if before and not white:
                late = 2  # the run's last character stands apart from the run
            joined = q_now == AFTER_BLANK
            if white:
                move[q, c] = AFTER_BLANK if c == BLANK else AFTER_SPACE
                begins = not before
            elif c in letters:
                move[q, c], begins = WORD, not (joined or q_now == WORD)
            elif c == NUMBER:
                move[q, c], begins = DIGITS, not (joined or q_now == DIGITS)
            else:
                begins = not (joined or q_now == SIGNS)
                move[q, c] = QUOTED if c == QUOTE and begins else SIGNS
            out[q, c] = late | begins
    return move, out


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (chunks x states): what all chunks up to each one do together."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), 1)
        step *= 2
    return maps


def piece_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pieces begin, of a sequence of character classes that ends with RESET."""
    move, out = piece_machine()
    n = len(classes)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, RESET, np.uint8)
    grid[:n] = classes
    columns = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    flat = move.ravel()
    states = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES)).copy()
    for column in columns:
        states = flat[states * np.uint8(CLASSES) + column[:, None]]
    entry = np.full(rows, START, np.uint8)
    entry[1:] = composed(states)[:-1, START]
    marks = np.empty((chunk, rows), np.uint8)
    results = out.ravel()
    for t, column in enumerate(columns):
        at = entry * np.uint8(CLASSES) + column
        marks[t], entry = results[at], flat[at]
    marks = np.ascontiguousarray(marks.T).ravel()[:n]
    begins = (marks & 1).astype(bool)
    begins[:-1] |= (marks[1:] & 2).astype(bool)
    return begins


@lru_cache(maxsize=1)
def _byte_characters() -> dict[str, int]:
    """The vocabulary file writes bytes as printable characters: these by themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceCounter:
    """The machine that reads a piece's bytes, compiled from a vocabulary and its merges."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = vocabulary
        self.merges = merges
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.made = {a + b: k for k, (a, b) in enumerate(merges)}
        self.prefixes = {t[:k] for t in vocabulary for k in range(1, len(t))}
        self.follows = Memo(self._follows)
        self.count = Memo(self.run, MOST_PIECES)
        self._restart()

    def _follows(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether merging the bytes of both tokens by rank gives these two.

        Undo the merges of the two, the later one first (of equal ones the
        right one). Before each of them, the parts that met at the seam must
        not have had a merge that came first.
        """
        left, right = pair
        first = len(self.rank)
        while self.rank.get((left, right), first) >= first:
            a, b = self.made.get(left, -1), self.made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                first, left = a, self.merges[a][1]
            else:
                first, right = b + 1, self.merges[b][0]
        return False

    def _restart(self) -> None:
        #: States by what they hold, and from each state by byte: the next state and the change in tokens.
        self.number: dict[tuple, int] = {}
        self.held: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self._state(((b"", None, 0),))

    def _state(self, held: tuple) -> int:
        if held not in self.number:
            self.number[held] = len(self.held)
            self.held.append(held)
            self.moves.append({})
        return self.number[held]

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Compile a transition. A state holds, of each place where a longer token may begin: the bytes since, the last token before, how many tokens fewer than now."""
        here, token, change = bytes([byte]), None, 0
        for since, before, fewer in self.held[state]:
            told = since + here
            if told in self.ids and (before is None or self.follows[before, told]):
                token, change = told, 1 - fewer
                break
        if token is None:
            raise ValueError("the vocabulary lacks a byte")
        places = tuple((since + here, before, fewer + change) for since, before, fewer in self.held[state] if since + here in self.prefixes)
        found = self.moves[state][byte] = (self._state((*places, (b"", token, 0))), change)
        return found

    def run(self, piece: bytes) -> int:
        """Run the machine over a piece."""
        if len(self.held) > MOST_STATES:
            self._restart()
        state = tokens = 0
        moves = self.moves
        for byte in piece:
            found = moves[state].get(byte)
            if found is None:
                found = self._move(state, byte)
            state, change = found
            tokens += change
        return tokens


def valid(text: bytes) -> bytes:
    """The text, with what isn't UTF-8 replaced as Python does."""
    try:
        text.decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text


class Counter:
    """Token counts of whole texts under a byte-level BPE file."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers

        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            told = json.load(file)
        of = _byte_characters()
        raw = lambda s: bytes(of[c] for c in s)
        self.special = [a["content"].encode() for a in told["added_tokens"]]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        vocabulary = {raw(t): i for t, i in told["model"]["vocab"].items() if t.encode() not in self.special}
        self.pieces = PieceCounter(vocabulary, [(raw(a), raw(b)) for a, b in pairs])

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text; a special string inside a text is one token."""
        out = np.zeros(len(texts), np.int64)
        texts = [valid(t) for t in texts]
        parts, owner = [], []
        for i, text in enumerate(texts):
            rest = [text]
            for s in self.special:
                if s in text:
                    rest = [y for x in rest for y in x.split(s)]
            out[i] += len(rest) - 1
            for x in rest:
                if x:
                    parts.append(x)
                    owner.append(i)
        if not parts:
            return out
        joined = b"\x00".join(parts) + b"\x00"
        points = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), np.uint32)
        classes = character_classes()[points]
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.concatenate([[0], np.cumsum(width)])
        resets = np.cumsum([len(x) + 1 for x in parts]) - 1
        classes[np.searchsorted(offsets, resets)] = RESET
        starts = offsets[:-1][piece_starts(classes)]
        pieces, memo = self.pieces, self.pieces.count
        ends = starts[1:].tolist()
        firsts = starts[:-1].tolist() if len(ends) else []
        # the reset characters are pieces too: of no tokens
        at_reset = np.isin(starts, resets, assume_unique=True)
        counts = np.fromiter(
            (memo[joined[a:b]] if b - a <= 64 else pieces.run(joined[a:b]) for a, b in zip(firsts, ends)), np.int64, len(ends)
        )
        counts = np.append(counts, 0)
        counts[at_reset] = 0
        np.add.at(out, np.asarray(owner)[np.searchsorted(resets, starts, "left")], counts)
        return out


@lru_cache(maxsize=2)
def counter(name: str) -> Counter:
    return Counter(name)


keeps("tokens", counter.cache_clear)
_SPARK, _ARROW = fields("n_bytes:long n_tokens:long")


def _counting(name: str):
    @F.arrow_udf(_SPARK)
    def count(texts: pa.Array) -> pa.Array:
        alone("tokens")
        sizes, tokens = [], []
        for block in blocks(texts):
            sizes += map(len, block)
            tokens += counter(name).counts(block).tolist()
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], fields=list(_ARROW))

    return count


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, into: str = "tokens") -> DataFrame:
    """``docs`` with a struct column: UTF-8 bytes and tokens of each whole text.

    A null or empty text has none of either. Bytes that aren't UTF-8 count as
    bytes, and as replacement characters for tokens. Rows and other columns
    stay; an existing column ``into`` is replaced.
    """
    return docs.withColumn(into, _counting(vocabulary)(F.col(text)))
