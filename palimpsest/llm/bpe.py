"""BPE as a streaming transducer.

Encoding walks each pre-token from left to right. For every prefix of a pre-token there is exactly one token that
ends it in the prefix's own encoding: the one that is *compatible* with the last token of the prefix before it (no
merge would cross the boundary between them). The transducer keeps that last token for the positions that a longer
token can still start from; tokens that all of these positions share are stable. The merge list bounds how far back
positions can disagree (:attr:`Merges.lookahead`): after that many bytes stable tokens leave, so the window is constant,
however long the input is. Decoding is a byte-to-text machine that holds at most three pending bytes.

Splitting into pre-tokens is vectorised over blocks of code points, and the outputs for pre-tokens of up to
``MEMO_CHARS`` code points are kept in a bounded memo, which is found by a hash and compared with the text itself; both
change the speed only.

Defined cases: a null text counts as the empty text (no ids); a text longer than a block is taken in pieces cut where
a pre-token starts, and a pre-token of any length runs through the transducer without being gathered; repeated rows
give repeated result rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import BLOCK_CHARS, column, text_or_empty, text_runs

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: A worker's memo of pre-tokens has this many slots as a power of two; once half of them are taken it starts anew.
MEMO_BITS = 22
#: Longer pre-tokens are not kept.
MEMO_CHARS = 64
#: Pairs of tokens whose compatibility is remembered.
PAIRS = 1_000_000
NONE = 1 << 30


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary to byte: printable Latin-1 stands for itself, the rest moves up from 256."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class Merges:
    """A merge list with what the transducer asks of it."""

    def __init__(self, spec: bytes):
        loaded = json.loads(spec)
        model, alphabet = loaded["model"], byte_alphabet()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in loaded.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.bytes_of[i] = text.encode() if text in self.special else bytes(alphabet[c] for c in text)
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = r
            made.setdefault(whole, (a, b, r))
        ordinary = [i for i, b in enumerate(self.bytes_of) if b and i not in self.special.values()]
        #: Right and left spines: (token at the edge, rank of the merge that takes it up).
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        valid: set[int] = set()
        for t in sorted(ordinary, key=lambda t: made[t][2] if t in made else -1):
            if t not in made:
                self.right[t] = self.left[t] = [(t, NONE)]
                valid.add(t)
                continue
            a, b, r = made[t]
            self.right[t] = [(t, NONE), (b, r), *self.right[b][1:]]
            self.left[t] = [(t, NONE), (a, r), *self.left[a][1:]]
            if a in valid and b in valid and self._apart(a, b, r):
                valid.add(t)
        self.trie: list[dict[int, int]] = [{}]
        self.at: list[int] = [-1]
        for t in valid:
            node = 0
            for byte in self.bytes_of[t]:
                following = self.trie[node].get(byte)
                if following is None:
                    following = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.at.append(-1)
                node = following
            self.at[node] = t
        self.longest = max(len(self.bytes_of[t]) for t in valid)
        self._made = made
        self._pairs: dict[int, bool] = {}

    def _apart(self, a: int, b: int, within: int = NONE) -> bool:
        """No merge before rank ``within`` crosses the boundary of ``a`` and ``b``.

        A merge of rank r crosses if both of its sides lie at the boundary at that time: neither is taken up before,
        and among equal ranks the leftmost goes first.
        """
        rank = self.rank
        for x, x_end in self.right[a]:
            x_end = min(x_end, within)
            for y, y_end in self.left[b]:
                r = rank.get((x, y))
                if r is not None and r < x_end and (r <= y_end if y_end != NONE else True) and r < within:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self._apart(a, b)
        return found

    @cached_property
    def lookahead(self) -> int:
        """Bytes after a token's start that can still decide on it.

        Whether a merge (x, y) takes place depends on y staying free, which a merge of a smaller rank that starts with
        y can prevent, which in turn depends on its own right side. The longest such chain of falling ranks is found
        in one pass in the order of ranks.
        """
        reach = {t: len(self.bytes_of[t]) for t in self.right}
        for t, (a, b, _) in sorted(self._made.items(), key=lambda kv: kv[1][2]):
            span = len(self.bytes_of[a]) + reach[b]
            reach[a] = max(reach[a], span)
            reach[t] = max(reach[t], span)
        return max(reach.values())


class Transducer:
    """Bytes of one pre-token in, stable ids out."""

    def __init__(self, merges: Merges):
        self.m = merges
        self._reset()

    def _reset(self) -> None:
        self.base = self.n = 0
        self.back: dict[int, tuple[int, int]] = {}  # position: (its last token, where that starts)
        self.live: list[tuple[int, int]] = []  # (start, trie node) of tokens that may still end later
        self.check, self.base_token = self.m.lookahead, -1

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        trie, at, back, fits = self.m.trie, self.m.at, self.back, self.m.compatible
        for byte in data:
            self.live.append((self.n, 0))
            n = self.n = self.n + 1
            still = []
            for start, node in self.live:
                node = trie[node].get(byte)
                if node is None:
                    continue
                still.append((start, node))
                t = at[node]
                if t >= 0 and n not in back and (start == 0 or fits(back[start][0] if start != self.base else self.base_token, t)):
                    back[n] = (t, start)
            self.live = still
            if n >= self.check:
                out += self._stable()
                self.check = n + self.m.lookahead
        return out

    def _stable(self) -> list[int]:
        """Emit what every position that matters has in common."""
        heads = sorted({start for start, _ in self.live} | {self.n}, reverse=True)
        while len(heads) > 1:
            start = self.back[heads[0]][1]
            heads = sorted({*heads[1:], start}, reverse=True)
        common = heads[0]
        out = self._path(common)
        if out:
            self.base, self.base_token = common, out[-1]
            for n in [n for n in self.back if n <= common]:
                del self.back[n]
        return out

    def _path(self, to: int) -> list[int]:
        out = []
        while to > self.base:
            t, to = self.back[to]
            out.append(t)
        return out[::-1]

    def finish(self) -> list[int]:
        out = self._path(self.n)
        self._reset()
        return out

    def window(self) -> int:
        return self.n - self.base

    def word(self, data: bytes) -> list[int]:
        return self.feed(data) + self.finish()


#: The code points with the property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


#: First and last of the code points that are letters or numbers only since Unicode 17; the tokenizers
#: library holds the tables of Unicode 16.
SINCE_17 = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Letters, numbers and blanks as the tokenizers library's Unicode tables have them."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    for low, high in SINCE_17:
        out[low : high + 1] = OTHER
    out[WHITE_SPACE] = SPACE
    return out


class Memo:
    """Open addressing over numpy arrays: 64-bit keys to row numbers, looked up a block at a time."""

    def __init__(self, bits: int):
        self.keys, self.rows, self.mask = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64((1 << bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) >> np.uint64(9)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.rows[at], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            at[left] = at[left] + np.uint64(1) & self.mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.rows[at[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray, first: int) -> None:
        """Distinct keys that are not there yet, to rows from ``first``."""
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = keys[left[free]]
            won = self.keys[at[left]] == keys[left]
            self.rows[at[left[won]]] = first + left[won]
            left = left[~won]
            at[left] = at[left] + np.uint64(1) & self.mask


@lru_cache(1)
def hash_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random word for each code point; powers of an odd base and of its inverse."""
    words = np.random.default_rng(20240229).integers(1, 2**63, 0x110000, dtype=np.uint64)
    base, n = 0x9E3779B97F4A7C15, BLOCK_CHARS * 2 + 2
    inverse = pow(base, -1, 1 << 64)
    up = np.full(n, base, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return words, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def starts(points: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Where pre-tokens of the byte-level pattern start; ``hard``: where texts start."""
    n = len(points)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[hard] = True
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= first[:n]
    space = kind == SPACE
    before_word = space[:-1] & ~space[1:] & ~first[1:n]
    new[:-1] |= before_word  # the last of several blanks stands apart,
    new[1:][before_word & (points[:-1] == 32)] = False  # and a plain one goes with the word
    marks = np.flatnonzero(points == 39)
    if len(marks):
        marks = marks[new[marks] & (marks + 1 < n)]
        marks = marks[~first[marks + 1]]
        one = points[marks + 1]
        two = np.where((marks + 2 < n) & ~first[np.minimum(marks + 2, n)], points[np.minimum(marks + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, size in ((marks[short], 2), (marks[long & ~short], 3)):
            new[found + 1] = False
            ends = found + size
            new[ends[ends < n]] = True
    return np.flatnonzero(new)


class Encoder:
    """Texts to ids: vectorised splitting, a memo of short pre-tokens, the transducer (or ``encode_words``) for the rest."""

    def __init__(self, merges: Merges, encode_words=None):
        self.m = merges
        self.encode_words = encode_words or (lambda words: [self.machine.word(w.encode()) for w in words])
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self._clear()

    @cached_property
    def machine(self) -> Transducer:
        return Transducer(self.m)

    def _clear(self) -> None:
        self.memo, self.known = Memo(MEMO_BITS), 0
        self.offset, self.count, self.place, self.size = (np.zeros(1 << 12, np.int64) for _ in range(4))
        self.pool, self.used = np.zeros(1 << 14, np.uint32), 0
        self.letters, self.written = np.zeros(1 << 14, np.uint32), 0

    @staticmethod
    def _room(held: np.ndarray, used: int, end: int) -> np.ndarray:
        if end <= len(held):
            return held
        wider = np.zeros(max(end, 2 * len(held)), held.dtype)
        wider[:used] = held[:used]  # the rest takes no memory until it is used
        return wider

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(where each word's ids begin, how many), put behind those that are kept."""
        ids = self.encode_words(words)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        end = self.used + int(counts.sum())
        self.pool = self._room(self.pool, self.used, end)
        self.pool[self.used : end] = np.fromiter(chain.from_iterable(ids), np.uint32, end - self.used)
        return self.used + np.cumsum(counts) - counts, counts

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        offsets, counts = self._encoded(words)
        n, more = self.known, self.known + len(words)
        for name in ("offset", "count", "place", "size"):
            setattr(self, name, self._room(getattr(self, name), n, more))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        end = self.written + len(points)
        self.letters = self._room(self.letters, self.written, end)
        self.letters[self.written : end] = points
        self.offset[n:more], self.count[n:more] = offsets, counts
        self.place[n:more], self.size[n:more] = self.written + np.cumsum(sizes) - sizes, sizes
        self.used, self.written, self.known = self.used + int(counts.sum()), end, more
        self.memo.add(keys, n)

    def _same(self, points: np.ndarray, begin: np.ndarray, sizes: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether the pre-tokens, which follow one another, are those that the memo holds under the slots."""
        ok = (slot >= 0) & (self.size[slot] == sizes)
        at = np.repeat(np.where(ok, self.place[slot], 0) - begin, sizes) + np.arange(len(points))
        wrong = np.flatnonzero(self.letters.take(at, mode="clip") != points)
        ok[np.searchsorted(begin, wrong, "right") - 1] = False
        return ok

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has. The texts hold no special tokens."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        hard = np.cumsum(sizes) - sizes
        begin = starts(points, hard)
        end = np.append(begin[1:], len(points))
        words, up, down = hash_tables()
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(words.take(points, mode="clip") * up[: len(points)], out=sums[1:])
        keys = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)
        keys |= np.uint64(1)
        kept = end - begin <= MEMO_CHARS
        slot = np.where(kept, self.memo.find(keys), -1)
        missing = np.flatnonzero(kept & (slot < 0))
        if len(missing):
            fresh, one = np.unique(keys[missing], return_index=True)
            if self.known + len(fresh) > len(self.memo.keys) // 2:
                self._clear()
                missing = np.flatnonzero(kept)
                fresh, one = np.unique(keys[missing], return_index=True)
            at = missing[one]
            self._learn(fresh, [whole[s:e] for s, e in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            slot[missing] = self.memo.find(keys[missing])
        # Long ones, and those whose hash another has, are encoded where they stand.
        apart = np.flatnonzero(~self._same(points, begin, end - begin, slot))
        offset, count = self.offset[slot], self.count[slot]
        if len(apart):
            offset[apart], count[apart] = self._encoded([whole[s:e] for s, e in zip(begin[apart].tolist(), end[apart].tolist(), strict=True)])
        ends = np.cumsum(count)
        ids = self.pool.take(np.repeat(offset - (ends - count), count) + np.arange(ends[-1]), mode="clip")
        upto = np.append(0, ends)
        cuts = upto[np.searchsorted(begin, np.append(hard, len(points)))]
        return ids, np.diff(cuts)

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        """Ids of one text of any length, a piece at a time."""
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                yield np.array([self.m.special[part]], np.uint32)
            else:
                yield from self._stream(part)

    def _stream(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        while at < len(text):
            part = text[at : at + BLOCK_CHARS]
            if at + len(part) == len(text):
                yield self.block([part])[0]
                return
            begin = starts(np.frombuffer(part.encode("utf-32-le"), np.uint32), np.zeros(1, np.int64))
            cut = begin[begin <= len(part) - 8]
            if len(cut) > 1:
                yield self.block([part[: cut[-1]]])[0]
                at += int(cut[-1])
            else:
                at = yield from self._endless(text, at)

    def _endless(self, text: str, at: int):
        """A pre-token longer than a block: whole through the transducer. Returns where it ends."""
        kinds = char_classes()
        lead = 1 if text[at] == " " and kinds[ord(text[at + 1])] != SPACE else 0
        kind, end = kinds[ord(text[at + lead])], at + lead
        while end < len(text):
            run = kinds[np.frombuffer(text[end : end + BLOCK_CHARS].encode("utf-32-le"), np.uint32)] != kind
            stop = int(run.argmax()) if run.any() else len(run)
            end += stop
            if run.any():
                break
        if kind == SPACE and end < len(text):
            end -= 1
        for start in range(at, end, 1 << 14):
            yield np.array(self.machine.feed(text[start : min(end, start + (1 << 14))].encode()), np.uint32)
        yield np.array(self.machine.finish(), np.uint32)
        return end

    def texts(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(index, ids, whether this ends the text), in order."""
        long = [len(t) > BLOCK_CHARS or bool(self.split and self.split.search(t)) for t in texts]
        for a, b in text_runs([BLOCK_CHARS + 1 if far else len(t) for far, t in zip(long, texts, strict=True)], BLOCK_CHARS):
            if long[a]:
                for ids in self.pieces(texts[a]):
                    yield a, ids, False
                yield a, np.zeros(0, np.uint32), True
                continue
            ids, counts = self.block(texts[a:b])
            ends = np.cumsum(counts)
            for k, (e, c) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                yield a + k, ids[e - c : e], True


class ByteText:
    """Byte-to-text machine: feed it ids piece by piece; an unfinished character waits for its other bytes."""

    def __init__(self, merges: Merges):
        self.sizes = np.fromiter(map(len, merges.bytes_of), np.int64, len(merges.bytes_of))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(merges.bytes_of), np.uint8)
        self.pending = b""

    def feed(self, ids: np.ndarray) -> str:
        count = self.sizes[ids]
        ends = np.cumsum(count)
        took = self.flat[np.repeat(self.begin[ids] - (ends - count), count) + np.arange(ends[-1])].tobytes() if len(ids) else b""
        data = self.pending + took
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:  # a lead byte: does its character end here?
                keep = back if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else 0
                break
            if byte < 0x80:
                break
        self.pending = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


_loaded: dict[bytes, Merges] = {}


def merges_of(spec: bytes) -> Merges:
    key = hashlib.sha256(spec).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Merges(spec)
    return _loaded[key]


_encoders: dict[bytes, Encoder] = {}


def encoder_of(spec: bytes) -> Encoder:
    """A worker's encoder; its memo serves later tasks too."""
    key = hashlib.sha256(spec).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(merges_of(spec))
    return _encoders[key]


def read_spec(path: str | None = None) -> bytes:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


def encode(docs: DataFrame, spec: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each text. The vocabulary file, of fixed size, goes to the executors by broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(sent.value)
        for batch in batches:
            keys, parts, ids = column(batch, "id"), [], []
            for _, got, ended in enc.texts(column(batch, "text")):
                parts.append(got)
                if ended:
                    ids.append(np.concatenate(parts))
                    parts = []
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("id").type), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, spec: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the texts of token ids (null ids: the empty text)."""
    sent = tokens.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ByteText(merges_of(sent.value))
        for batch in batches:
            texts = []
            for ids in column(batch, "ids"):
                ids = np.array(ids or [], np.int64)
                texts.append("".join(machine.feed(ids[i : i + BLOCK_CHARS]) for i in range(0, len(ids), BLOCK_CHARS)) + machine.finish())
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "id"), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])

    rows = tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, spec: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text and return digests of both; ids and text stream through, nothing is gathered."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, machine = encoder_of(sent.value), ByteText(merges_of(sent.value))
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            n, a, b = 0, hashlib.sha256(), hashlib.sha256()
            for _, ids, ended in enc.texts(column(batch, "text")):
                n += len(ids)
                a.update(ids.astype("<u4", copy=False).tobytes())
                b.update(machine.feed(ids).encode())
                if ended:
                    b.update(machine.finish().encode())
                    counts.append(n)
                    ids_hash.append(a.hexdigest())
                    text_hash.append(b.hexdigest())
                    n, a, b = 0, hashlib.sha256(), hashlib.sha256()
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "id"), pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
