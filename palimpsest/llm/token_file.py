"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block holds up to ``BLOCK_IDS`` ids and starts from empty models, so any block decodes alone. Each id is coded in one
arithmetic step from a mixture of three predictors: the id that followed the last two ids (order 2), the one that
followed the last id (order 1), and adaptive frequencies of ids in classes of 256 (order 0). Predictions change with
every id; how much the first two weigh, which follows how often predictions of the same trust have held so far in the
block, and the frequencies are fixed anew after 16, 32, 64, ... and then every ``RENEW`` ids. So the encoder works out
the intervals of many ids at once, and the decoder finds a class by one look into its slots. The encoder knows all ids
beforehand and gets the predictions by a sort; only the decoder keeps tables. Blocks do not depend on each other, and
numpy codes all blocks of a frame in lockstep, one lane for each.

A frame is a row of the file: an index of whole documents, and packs of blocks with their sizes and CRC-32s. Files are
Parquet, written through Spark's commit protocol, so lost or repeated tasks leave no partial files. A document of any
length streams through packs of bounded size on the way in and out; only its packed bytes stand in memory at once.

Defined cases: a null text counts as empty (one id, the end id); documents come in ascending doc_id (nulls first; rows
that share a doc_id in the order of their texts); ids from 0 to 65,535, others raise; an empty table gives no frames.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.bpe import Encoder, byte_alphabet, merges_of
from palimpsest.llm.common import bound_batches, column, parallel, stored, text_or_empty

#: Longer blocks pack better, more blocks in a frame code faster.
BLOCK_IDS = 2048
FRAME_IDS = BLOCK_IDS * 2048
MAGIC = b"PTF3"
#: Entries of a block's table for each order, and slots of the order-0 distribution, as powers of two.
TABLE_BITS, SLOT_BITS = 10, 12
#: What the order-0 distribution weighs in the mixture.
PLAIN = 1 << (SLOT_BITS + 8)
#: Steps after which the weights are fixed anew: soon at first, then every ``RENEW``.
RENEW = 256
#: Steps, or blocks, that the encoder works on at once: few, so that they stay in a core's cache.
AT_ONCE = 16
#: Weight of an id among the counts of classes, which are halved above ``MOST``.
STEP, MOST = 24, 1 << 15
#: Hits and trials that each trust starts with.
PRIOR = np.array([[2, 20], [8, 20], [13, 20], [17, 20]])
FRAME_SCHEMA = "part int, frame long, first_id long, n_ids long, doc_ids array<long>, lengths array<long>, crcs array<long>, data array<binary>"
#: Unused ids at the ends of rows that are transposed: rows a power of two apart share few cache lines.
GAP = 32


class DamagedFile(ValueError):
    """A frame or block fails its checks."""


class Lanes:
    """The models of all blocks of a frame, side by side. Arrays of both predictions hold order 1 first, then order 2."""

    def __init__(self, lanes: int):
        self.n = lanes
        row = np.arange(lanes)
        self.quad, self.classes, self.slots = (np.arange(2 * lanes) << 2).astype(np.int32), (row << 8).astype(np.int32), (row << SLOT_BITS).astype(np.int32)
        self.freq = np.ones((lanes, 256), np.int32)
        self.hits, self.tried = (np.tile(PRIOR[:, k], 2 * lanes) for k in (0, 1))
        self._fix()

    def _fix(self) -> None:
        """Fix the order-0 distribution (2 ** SLOT_BITS slots) and the weights of both predictions for the next steps.

        Single products of floats round alike everywhere, so the decoder finds the encoder's widths.
        """
        total = self.freq.sum(1)
        full = total > MOST
        if full.any():
            self.freq[full] = (self.freq[full] >> 1) | 1
            total[full] = self.freq[full].sum(1)
        each = np.float32((1 << SLOT_BITS) - 256) / total.astype(np.float32)
        width = (self.freq.astype(np.float32) * each[:, None]).astype(np.int32)
        width += 1
        width[np.arange(self.n), self.freq.argmax(1)] += (1 << SLOT_BITS) - width.sum(1, dtype=np.int32)
        upto = np.cumsum(width, 1, dtype=np.int32)
        upto -= width
        self.share = (upto.reshape(-1).view(np.uint32) << np.uint32(SLOT_BITS + 8)) | width.reshape(-1).view(np.uint32)
        odds = (self.hits << (SLOT_BITS + 8)) // (self.tried - self.hits)
        self.weight = np.clip(odds, 1 << SLOT_BITS, 48 * PLAIN).astype(np.int32)

    def learn(self, spots: np.ndarray, tried: np.ndarray, held: np.ndarray) -> None:
        """Count what the steps since the last time have shown: the places of their classes, and how often each weight was tried and held."""
        counts = np.bincount(spots.reshape(-1), minlength=256 * self.n).astype(np.int32)
        counts *= STEP
        self.freq += counts.reshape(self.n, 256)
        self.tried += tried
        self.hits += held
        old = self.tried > 255
        self.tried[old] >>= 1
        self.hits[old] >>= 1
        self.hits = np.minimum(self.hits, self.tried - 1)
        self._fix()

    def slot_classes(self) -> np.ndarray:
        """The class of every slot of every lane."""
        return np.repeat(np.tile(np.arange(256, dtype=np.uint8), self.n), self.share & OWN)


MASK = np.uint32((1 << TABLE_BITS) - 1)
FIRST, SECOND = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: An entry of ``Lanes.share``: 256 times the slots before a class in its upper bits, its own slots in the lower ones.
OWN, BEFORE = np.uint32((1 << SLOT_BITS) - 1), np.uint32(SLOT_BITS)


def contexts(ids: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of the last id and of the last two in the tables of order 1 and 2, one after the other."""
    mixed = ids.astype(np.uint32) * FIRST
    return np.concatenate([mixed >> np.uint32(12) & MASK, (mixed + last.astype(np.uint32) * SECOND) >> np.uint32(15) & MASK], axis=-1)


def chunks(steps: int) -> Iterator[tuple[int, int]]:
    at, size = 0, 16
    while at < steps:
        yield at, min(at + size, steps)
        at, size = at + size, min(max(size, at + size), RENEW)


LOW_WORD, WORD = np.uint64((1 << 32) - 1), np.uint64(32)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """ids: a row for each block, a column for each step."""
    n, steps = ids.shape
    lanes = Lanes(n)
    seen1, seen2 = foreseen(ids)
    lower = np.ascontiguousarray((ids & 255).astype(np.uint8).T)
    room = steps + 4
    out, at = np.zeros(n * room, np.uint32), np.arange(n) * room
    low, span = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    for first, end in chunks(steps):
        tried, held = np.zeros(8 * n, np.int64), np.zeros(8 * n, np.int64)
        spots = lanes.classes[:, None] + (ids[:, first:end] >> 8)
        shares = np.ascontiguousarray(lanes.share.take(spots, mode="wrap").T)
        for begin in range(first, end, AT_ONCE):
            rows = slice(begin, min(begin + AT_ONCE, end))
            start, size, total = intervals(lanes, lower[rows], shares[begin - first : rows.stop - first], seen1[rows], seen2[rows])
            for k in range(len(total)):
                span //= total[k]
                more = start[k] * span
                low += more
                span *= size[k]
                over = (low < more).nonzero()[0]
                if len(over):
                    spot = at.take(over) - 1
                    while len(spot):  # carry into the words before
                        word = out.take(spot) + np.uint32(1)
                        out[spot] = word
                        spot = spot[word == 0] - 1
                go = (span <= LOW_WORD).nonzero()[0]
                settled, spot = low.take(go), at.take(go)
                out[spot] = settled >> WORD
                low[go] = settled << WORD
                span[go] = span.take(go) << WORD
                at[go] = spot + 1
        for quad, seen in ((lanes.quad[:n], seen1[first:end]), (lanes.quad[n:], seen2[first:end])):
            counts = np.bincount(((quad << 1) + seen).reshape(-1), minlength=16 * n)
            tried += counts[::2] + counts[1::2]
            held += counts[1::2]
        lanes.learn(spots, tried, held)
    for _ in range(2):
        out[at] = low >> WORD
        at += 1
        low <<= WORD
    return [out[i * room : m].astype(">u4").tobytes() for i, m in enumerate(at.tolist())]


def foreseen(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the order-1 and order-2 predictions of every step, a row each: twice the trust, and 1 if it will hold.

    The encoder knows all ids, so it needs no table: sorted by place and step, each visit to a place follows the one
    whose id it finds there.
    """
    n, steps = ids.shape
    bits = np.uint32(max(steps - 1, 1).bit_length())
    when = np.arange(steps, dtype=np.uint32)
    out = [np.empty((n, steps + GAP), np.uint8)[:, :steps] for _ in range(2)]
    for begin in range(0, n, AT_ONCE):
        x = ids[begin : begin + AT_ONCE]
        row = (np.arange(len(x)) * steps)[:, None]
        past = np.concatenate([np.zeros((len(x), 2), x.dtype), x], 1)
        for places, result in zip(np.split(contexts(past[:, 1:-1], past[:, :-2]), 2, axis=1), out, strict=True):
            key = np.sort(places << bits | when, axis=1)
            back = (key & np.uint32((1 << int(bits)) - 1)) + row
            found = x.reshape(-1).take(back)
            same = np.zeros(x.shape, bool)
            np.equal(key[:, 1:] >> bits, key[:, :-1] >> bits, out=same[:, 1:])
            holds = found == 0  # as an empty table predicts
            follow = same[:, 1:]
            holds[:, 1:] &= ~follow
            holds[:, 1:] |= follow & (found[:, 1:] == found[:, :-1])
            once = np.zeros((len(x), steps + 2), bool)
            np.logical_and(follow, holds[:, :-1], out=once[:, 3:])
            twice = once[:, 2:] & once[:, 1:-1]
            trust = once[:, 2:].view(np.uint8) + twice + (twice & once[:, :-2])
            seen = np.empty(x.size, np.uint8)
            seen[back] = trust << 1 | holds
            result[begin : begin + AT_ONCE] = seen.reshape(x.shape)
    return np.ascontiguousarray(out[0].T), np.ascontiguousarray(out[1].T)


def intervals(lanes: Lanes, lower: np.ndarray, share: np.ndarray, seen1: np.ndarray, seen2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, total) of ids in the mixture: order 1's prediction, then order 2's, then the order-0 distribution.

    lower, share: the ids' last eight bits, and what the order-0 distribution has for their classes. An id that a
    prediction names has that prediction's share; if both name it, both shares, which are neighbours.
    """
    n = lanes.n
    one = lanes.weight.take(lanes.quad[:n] + (seen1 >> 1), mode="wrap")
    two = lanes.weight.take(lanes.quad[n:] + (seen2 >> 1), mode="wrap")
    both = one + two
    size = (share & OWN).view(np.int32)
    start = (share >> BEFORE).view(np.int32)
    start += both
    start += lower * size
    named = np.flatnonzero((seen1 | seen2) & 1)
    r1, r2 = (s.reshape(-1).take(named) & 1 for s in (seen1, seen2))
    first = one.reshape(-1).take(named)
    size.reshape(-1)[named] = first * r1 + two.reshape(-1).take(named) * r2
    start.reshape(-1)[named] = first * (1 - r1)
    both += np.int32(PLAIN)
    return start.astype(np.uint64), size.astype(np.uint64), both.astype(np.uint64)


def decode_blocks(blocks: list[bytes], steps: int) -> np.ndarray:
    """The ids of blocks of ``steps`` ids each: a row for each step."""
    n = len(blocks)
    width = max((len(b) for b in blocks), default=0) // 4 + 4
    data = np.zeros((n, width), np.uint32)
    for i, b in enumerate(blocks):
        data[i, : len(b) // 4] = np.frombuffer(b[: len(b) // 4 * 4], ">u4")
    flat, at = data.reshape(-1), np.arange(n) * width + 2
    lanes = Lanes(n)
    base, table = (np.arange(2 * n) << TABLE_BITS).astype(np.uint32), np.zeros(2 * n << TABLE_BITS, np.int32)  # predicted id and trust, 0 to 3
    # Where the code stands above the interval's lower end: carries need no care here.
    above, span = data[:, 0].astype(np.uint64) << WORD | data[:, 1], np.full(n, (1 << 64) - 1, np.uint64)
    out = np.zeros((steps, n + GAP), np.uint16)[:, :n]
    x, fresh = np.zeros(n, np.int32), np.zeros(2 * n, np.int32)
    place, behind = np.zeros(2 * n, np.uint32), np.zeros(n, np.uint32)
    for first, end in chunks(steps):
        used, held = np.empty((end - first, 2 * n), np.int32), []
        classes = lanes.slot_classes()
        for k in range(end - first):
            mixed = x.view(np.uint32) * FIRST
            np.right_shift(mixed, np.uint32(12), out=place[:n])
            mixed += behind
            np.right_shift(mixed, np.uint32(15), out=place[n:])
            behind = x.view(np.uint32) * SECOND
            place &= MASK
            place += base
            at_table = place.astype(np.intp)
            e = table.take(at_table, mode="wrap")
            chosen = np.add(lanes.quad, e & 3, out=used[k])
            weight = lanes.weight.take(chosen, mode="wrap")
            one = weight[:n]
            both = one + weight[n:]
            span //= (both + np.int32(PLAIN)).astype(np.uint64)
            v = (above // span).astype(np.int32)
            rest = (v - both) & np.int32(PLAIN - 1)
            c = classes.take(lanes.slots + (rest >> 8), mode="wrap").astype(np.int32)
            share = lanes.share.take(lanes.classes + c, mode="wrap")
            size = share & OWN
            start = (share >> BEFORE).view(np.int32)
            start += both
            inside = (v - start).view(np.uint32) // size
            c <<= 8
            x = c + inside.view(np.int32)
            inside *= size
            start += inside.view(np.int32)
            size = size.view(np.int32)
            named = (v < both).nonzero()[0]
            m, pair = len(named), np.concatenate([named, named + n])
            old, w = e.take(pair), weight.take(pair)
            guess, w1 = old >> 2, w[:m]
            x[named] = right = np.where(v.take(named) < w1, guess[:m], guess[m:])
            holds = guess.reshape(2, m) == right
            w2 = w.reshape(2, m) * holds
            size[named] = w2[0] + w2[1]
            start[named] = w1 - w2[0]
            np.left_shift(x, 2, out=fresh[:n])
            fresh[n:] = fresh[:n]
            holds = holds.reshape(-1).nonzero()[0]
            hit, old = pair.take(holds), old.take(holds)
            fresh[hit] = old + ((old & 3) < 3)  # more trust, up to 3
            table[at_table] = fresh
            held.append(chosen.take(hit))
            above -= start.astype(np.uint64) * span
            span *= size.astype(np.uint64)
            go = (span <= LOW_WORD).nonzero()[0]
            spot = at.take(go)
            above[go] = above.take(go) << WORD | flat.take(spot, mode="clip")
            span[go] = span.take(go) << WORD
            at[go] = spot + 1
            out[first + k] = x
        counts = (np.bincount(c, minlength=8 * n) for c in (used.reshape(-1), np.concatenate(held)))
        lanes.learn(lanes.classes[:, None] + np.ascontiguousarray(out[first:end].T >> 8), *counts)
    return out


def pack(ids: np.ndarray) -> bytes:
    """The blocks of a frame: magic, counts, then size, length and CRC-32 of each block, then the blocks.

    Blocks differ by one id at most; the shorter ones are coded with a zero at their end.
    """
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids above 65,535 do not fit this format")
    n = -(-len(ids) // BLOCK_IDS)
    ends = np.arange(n + 1) * len(ids) // max(n, 1)
    lengths = np.diff(ends)
    blocks = []
    if n:
        steps = int(lengths.max())
        whole = np.zeros((n, steps + GAP), np.uint16)[:, :steps]
        for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):  # noqa: B905
            whole[i, : b - a] = ids[a:b]
        blocks = encode_blocks(whole)
    raw = ids.astype("<u4", copy=False)
    head = b"".join(struct.pack("<IHI", len(b), int(m), zlib.crc32(raw[e - m : e].tobytes())) for b, m, e in zip(blocks, lengths, ends[1:], strict=True))
    return MAGIC + struct.pack("<I", n) + head + b"".join(blocks)


def unpack(data: bytes) -> np.ndarray:
    """The ids of a frame, every block checked."""
    if data[:4] != MAGIC or len(data) < 8:
        raise DamagedFile("not a frame")
    (n,) = struct.unpack_from("<I", data, 4)
    if len(data) < 8 + 10 * n:
        raise DamagedFile("the header is cut off")
    heads = [struct.unpack_from("<IHI", data, 8 + 10 * i) for i in range(n)]
    at, blocks = 8 + 10 * n, []
    for size, _, _ in heads:
        blocks.append(data[at : at + size])
        at += size
    if at != len(data):
        raise DamagedFile(f"{len(data)} bytes where the header says {at}")
    if not n:
        return np.zeros(0, np.uint32)
    lengths = np.array([m for _, m, _ in heads], np.int64)
    ids = np.ascontiguousarray(decode_blocks(blocks, int(lengths.max())).T)
    flat = ids[np.arange(ids.shape[1]) < lengths[:, None]].astype("<u4")
    ends = np.cumsum(lengths)
    for (_, m, crc), end in zip(heads, ends.tolist(), strict=True):
        if zlib.crc32(flat[end - m : end].tobytes()) != crc:
            raise DamagedFile("a block fails its CRC-32")
    return flat


class LateMerges:
    """Special tokens at once; the rest of the merges, which only a pre-token longer than a block needs, when asked for."""

    def __init__(self, spec: bytes):
        self.spec, self.special = spec, {t["content"]: t["id"] for t in json.loads(spec).get("added_tokens", [])}

    def __getattr__(self, name: str):
        found = self.__dict__[name] = getattr(merges_of(self.spec), name)
        return found


_library: dict[bytes, Encoder] = {}


def library_encoder(spec: bytes) -> Encoder:
    """Ids of the tokenizers library; a worker asks it once for each pre-token in its memo."""
    if spec not in _library:
        import tokenizers

        tk = tokenizers.Tokenizer.from_str(spec.decode())
        tokenize, alphabet, id_of = tk.model.tokenize, {b: c for c, b in byte_alphabet().items()}, attrgetter("id")

        def ask(words: list[str]) -> list[list[int]]:
            # UTF-8 has no byte 255, so it parts the words while all are translated at once.
            whole = b"\xff".join(map(str.encode, words)).decode("latin-1").translate(alphabet)
            return [list(map(id_of, tokenize(w))) for w in whole.split(alphabet[255])] if words else []

        _library.clear()
        _library[spec] = Encoder(LateMerges(spec), ask)
    return _library[spec]


class Frames:
    """Collects documents' ids into frames of about FRAME_IDS ids; packs never hold more than twice as many."""

    def __init__(self, part: int):
        self.part, self.frame, self.first = part, 0, 0
        self._clear()

    def _clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.packs: list[bytes] = []
        self.held = self.packed = 0
        self.ids, self.lengths, self.crcs = [], [], []

    def _pack(self) -> None:
        whole = np.concatenate(self.parts)
        self.parts, self.packed, self.held = [], self.packed + self.held, 0
        self.packs.append(pack(whole))

    def begin(self, doc_id) -> None:
        self.ids.append(doc_id)
        self.lengths.append(0)
        self.crcs.append(0)

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.lengths[-1] += len(ids)
        self.crcs[-1] = zlib.crc32(ids.astype("<u4", copy=False).tobytes(), self.crcs[-1])
        if self.held >= 2 * FRAME_IDS:
            self._pack()

    def full(self) -> bool:
        return self.packed + self.held >= FRAME_IDS

    def close(self) -> tuple:
        if self.held:
            self._pack()
        row = (self.part, self.frame, self.first, self.packed, self.ids, self.lengths, self.crcs, self.packs)
        self.frame += 1
        self.first += self.packed
        self._clear()
        return row


FRAME_ARROW = pa.schema([("part", pa.int32()), ("frame", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("crcs", pa.list_(pa.int64())), ("data", pa.list_(pa.binary()))])


def write_file(docs: DataFrame, spec: bytes, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending id order; the frames as read back from the files.

    Rows are dealt by ranges of doc_id, so file ``part`` precedes file ``part + 1`` and nothing needs a global sort.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(spec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, frames = library_encoder(sent.value), Frames(TaskContext.get().partitionId())
        end = np.array([end_id], np.uint32)

        def give(row: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, FRAME_ARROW, strict=True)], schema=FRAME_ARROW)

        for batch in batches:
            keys, fresh = column(batch, "id"), True
            for k, ids, ended in enc.texts(column(batch, "text")):
                if fresh:
                    frames.begin(keys[k])
                frames.add(np.append(ids, end) if ended else ids)
                fresh = ended
                if ended and frames.full():
                    yield give(frames.close())
        if frames.ids:
            yield give(frames.close())

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    ordered = rows.repartitionByRange(parallel(spark), "id").sortWithinPartitions("id", "text")
    return stored(ordered.mapInArrow(run, FRAME_SCHEMA), "token-file")


def read_file(frames: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode every frame and return, by document, where it starts, its number of ids and their CRC-32.

    Files start where the files before them end: one row a file, not one a document, is summed for that.
    """
    bound_batches(frames.sparkSession)
    sizes = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = sizes.select(F.col("part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    arrow = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                lengths, said = row["lengths"].as_py(), row["crcs"].as_py()
                crcs, doc, left = [0] * len(lengths), 0, lengths[0] if lengths else 0
                for packed in row["data"]:
                    ids = unpack(packed.as_py())
                    at = 0
                    while at < len(ids):
                        if doc == len(lengths):
                            raise DamagedFile("more ids than the index says")
                        took = min(left, len(ids) - at)
                        crcs[doc] = zlib.crc32(ids[at : at + took].tobytes(), crcs[doc])
                        at, left = at + took, left - took
                        if not left:
                            doc += 1
                            left = lengths[doc] if doc < len(lengths) else 0
                if doc != len(lengths) or crcs != said:
                    raise DamagedFile("the ids of a frame are not those of its index")
                begin = row["offset"].as_py() + row["first_id"].as_py() + np.cumsum([0, *lengths[:-1]])
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(begin, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], schema=arrow)

    joined = frames.join(F.broadcast(offsets), "part").select("offset", "first_id", "doc_ids", "lengths", "crcs", "data")
    return joined.mapInArrow(run, "doc long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("doc", id_col)
