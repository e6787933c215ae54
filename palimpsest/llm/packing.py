"""Best-fit packing of documents into training sequences, with conflicts.

A sequence (bin) of ``CAPACITY`` words takes at most one document of a source and one of a cluster of duplicates.
Documents come longest first; each goes to the compatible bin that it leaves the least room in (the oldest of equals),
else to a new one. Bins are ordered by their room: a bit set of the rooms that occur gives the successor of a length,
and each bin carries bitmaps of its sources and clusters. The search goes on from successor to successor until a bin
is compatible. For sources and clusters with many documents, a bit set of their own holds the rooms that have a bin
without them, so a hot source does not walk over all the bins that it already is in.

Rows are dealt by a hash of their id into shards of about ``SHARD`` documents, packed one by one: neither a hot source
nor a large cluster ends up in one task, and the loss from not sharing open bins between shards is at most a few bins
each. A document longer than a bin fills whole bins with its first pieces; the rest is packed like others.

Defined cases: a text's length is its number of words and one for its end, so null and empty texts take one place;
a null source conflicts with nothing; repeated rows are packed each, apart; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import column

CAPACITY = 2048
SHARD = 20_000
#: Keys with more documents than this in a shard get a bit set of their own.
HOT = 64


class BestFit:
    """The bins of one shard."""

    def __init__(self, capacity: int, hot: Iterable = ()):
        self.capacity = capacity
        self.room: list[int] = []
        self.sources: list[int] = []  # bitmaps
        self.clusters: list[int] = []
        self.bit: dict = {}
        self.at: dict[int, list[int]] = {}
        self.levels = 0
        self.without = {key: 0 for key in hot}  # rooms that have a bin without the key, as a bit set
        self.counts = {key: [0] * (capacity + 1) for key in self.without}

    def _mask(self, key) -> int:
        return 1 << self.bit.setdefault(key, len(self.bit)) if key is not None else 0

    def _count(self, b: int, by: int) -> None:
        room = self.room[b]
        held = self.sources[b] | self.clusters[b]
        for key, counts in self.counts.items():
            if not held & self._mask(key):
                counts[room] += by
                if counts[room]:
                    self.without[key] |= 1 << room
                else:
                    self.without[key] &= ~(1 << room)

    def _enter(self, b: int) -> None:
        room = self.room[b]
        insort(self.at.setdefault(room, []), b)
        self.levels |= 1 << room
        self._count(b, 1)

    def _leave(self, b: int) -> None:
        room = self.room[b]
        self.at[room].remove(b)
        if not self.at[room]:
            del self.at[room]
            self.levels &= ~(1 << room)
        self._count(b, -1)

    def add(self, size: int, source=None, cluster=None) -> tuple[int, int]:
        """(bin, offset in it) of a document."""
        source_key = ("source", source) if source is not None else None
        cluster_key = ("cluster", cluster) if cluster is not None else None
        s, c = self._mask(source_key), self._mask(cluster_key)
        levels = self.levels
        for key in (source_key, cluster_key):
            if key in self.without:
                levels &= self.without[key]
        levels >>= size
        room, chosen = size, -1
        while levels and chosen < 0:
            step = (levels & -levels).bit_length() - 1
            room, levels = room + step, levels >> step
            chosen = next((b for b in self.at[room] if not self.sources[b] & s and not self.clusters[b] & c), -1)
            room, levels = room + 1, levels >> 1
        if chosen < 0:
            chosen = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._leave(chosen)
        offset = self.capacity - self.room[chosen]
        self.room[chosen] -= size
        self.sources[chosen] |= s
        self.clusters[chosen] |= c
        if self.room[chosen]:
            self._enter(chosen)
        return chosen, offset


def pack_shard(rows: list[tuple], capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int, int]]:
    """rows: (id, length, source, cluster), longest first. Yields (row, piece, bin, offset, length)."""
    of_source = Counter(r[2] for r in rows if r[2] is not None)
    of_cluster = Counter(r[3] for r in rows if r[3] is not None)
    hot = [("source", k) for k, n in of_source.items() if n > HOT] + [("cluster", k) for k, n in of_cluster.items() if n > HOT]
    bins = BestFit(capacity, hot)
    for i, (_, length, source, cluster) in enumerate(rows):
        shared = cluster if of_cluster.get(cluster, 0) > 1 else None  # nothing conflicts with a document without copies
        pieces, rest = divmod(length, capacity)
        for piece in range(pieces):
            yield i, piece, *bins.add(capacity, source, shared), capacity
        if rest:
            yield i, pieces, *bins.add(rest, source, shared), rest


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")) + 1


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, id_col: str = "doc_id", cluster: Column | None = None) -> DataFrame:
    """(id, piece, bin_id, bin_offset, length): where each piece of each document goes.

    cluster: the duplicate cluster of a row; by default the rows with the same text.
    """
    clusters = cluster if cluster is not None else F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), word_count(F.col("text")).cast("long").alias("length"), F.col("source").cast("string").alias("source"), clusters.alias("cluster"))
    shards = -(-docs.count() // shard) or 1
    arrow = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("bin_id", pa.int64()), ("bin_offset", pa.int32()), ("length", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in zip(*(column(batch, c) for c in ("id", "length", "source", "cluster")), strict=True)]
        first = TaskContext.get().partitionId() << 32
        out = [(held[i][0], piece, first + b, offset, length) for i, piece, b, offset, length in pack_shard(held, capacity)]
        for k in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 10_000], strict=True), arrow, strict=True)], schema=arrow)

    dealt = rows.repartition(shards, F.xxhash64("id", "cluster")).sortWithinPartitions(F.desc("length"), "id", "cluster", "source")
    return dealt.mapInArrow(run, "id long, piece int, bin_id long, bin_offset int, length int").withColumnRenamed("id", id_col)
