"""SimHash near-duplicates: links between fingerprints within a few bits, found by the pigeonring principle.

Fingerprints are compared once each: rows that share one are a group of their own. The 64 bits form a ring of
``SEGMENTS`` segments. If two fingerprints differ in at most ``t`` bits, some segment starts a chain whose first l
segments differ in at most l * t / SEGMENTS bits together, for every l. Candidates must agree in the first segment
(budget 0) and differ in at most one bit in the first two (budget 1), which a join on both finds when one side also
offers the second segment with each bit flipped; the longer chains are then checked, and last the whole distance.

However many rows share a text or a fingerprint, they enter the join as one row. Only the components count, so links
are made in two passes: first each fingerprint meets its next neighbours in the order of each bucket, then the join
gives only links between different components of the first pass. None is lost, and a group of many close fingerprints
does not come out as all of its pairs.

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like any other; equal
fingerprints form one component; repeated rows give repeated result rows; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import column, stored, text_or_empty

SHINGLE, SEED = 4, 42
BITS_AT_ONCE = 1 << 15
SEGMENTS = [(51, 13), (38, 13), (25, 13), (12, 13), (0, 12)]
THRESHOLD = 4


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    words = text.encode().lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    begin = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s : e - 1], SEED) for s, e in zip(begin, begin[size:])]  # noqa: B905


def bit_counts(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """How many hashes of each text have each bit set; texts' hashes follow one another."""
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ends = np.cumsum(sizes)
    return np.add.reduceat(bits, ends - sizes, axis=0, dtype=np.int32)


def fingerprints_of(texts: list[str], size: int = SHINGLE) -> list[str]:
    out = ["0" * 16] * len(texts)
    held: list[int] = []
    whose: list[int] = []
    sizes: list[int] = []

    def settle() -> None:
        if whose:
            majority = bit_counts(held, sizes) * 2 > np.array(sizes)[:, None]
            for i, row in zip(whose, np.packbits(majority, axis=1), strict=True):
                out[i] = row.tobytes().hex()
        held.clear(), whose.clear(), sizes.clear()

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, size)
        if len(hashes) > BITS_AT_ONCE:
            counts = sum(bit_counts(hashes[k : k + BITS_AT_ONCE], [len(hashes[k : k + BITS_AT_ONCE])])[0] for k in range(0, len(hashes), BITS_AT_ONCE))
            out[i] = np.packbits(counts * 2 > len(hashes)).tobytes().hex()
        elif hashes:
            held += hashes
            whose.append(i)
            sizes.append(len(hashes))
            if len(held) > BITS_AT_ONCE:
                settle()
    settle()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fingerprint): 16 hexadecimal digits for each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "id"), pa.int64()), pa.array(fingerprints_of(column(batch, "text"), size), pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def _segment(fp: Column, k: int) -> Column:
    low, width = SEGMENTS[k % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _key(fp: Column, k: int, flip: int = 0) -> Column:
    first, second = _segment(fp, k), _segment(fp, k + 1)
    return F.lit(k << 26).cast("long").bitwiseOR(F.shiftleft(first, 13)).bitwiseOR(second.bitwiseXOR(F.lit(flip).cast("long")))


NEIGHBOURS = 3


def chained(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): nodes whose fingerprints stand within NEIGHBOURS places in a bucket and within ``threshold`` bits.

    A few links for each fingerprint, which already join most of a large group.
    """
    fp = F.col("fp")
    indexed = prints.select("fp", "node", F.explode(F.array(*[_key(fp, k) for k in range(len(SEGMENTS))])).alias("key"))
    row, order = F.struct("fp", "node"), Window.partitionBy("key").orderBy("fp")
    near = indexed.withColumn("before", F.array(*[F.lag(row, k).over(order) for k in range(1, NEIGHBOURS + 1)])).select("fp", "node", F.explode("before").alias("p"))
    return near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp"))) <= threshold).select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): labels of fingerprints within ``threshold`` bits of one another that are not joined yet.

    prints: distinct fingerprints ``fp`` as signed longs and the ``label`` of what each belongs to so far. The budgets
    below hold for thresholds up to 4.
    """
    if not 0 <= threshold <= len(SEGMENTS) - 1:
        raise ValueError("the segments serve thresholds from 0 to 4")
    n = len(SEGMENTS)
    fp = F.col("fp")
    flips = [(k, 0) for k in range(n)] + [(k, 1 << bit) for k in range(n) for bit in range(SEGMENTS[(k + 1) % n][1]) if 2 * threshold // n >= 1]
    offered = prints.select(fp.alias("a"), F.col("label").alias("la"), F.explode(F.array(*[_key(fp, k, flip) for k, flip in flips])).alias("key"))
    indexed = prints.select(fp.alias("b"), F.col("label").alias("lb"), F.explode(F.array(*[_key(fp, k) for k in range(n)])).alias("key"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    chains = F.lit(False)
    for k in range(n):
        ok, total = F.shiftright(F.col("key"), 26) == k, F.lit(0)
        for length in range(1, n + 1):
            total = total + F.bit_count(_segment(differ, k + length - 1))
            if length > 2:
                ok = ok & (total <= length * threshold // n)
        chains = chains | ok
    fresh = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
    found = offered.join(indexed, "key").where(fresh & (F.bit_count(differ) <= threshold) & chains)
    return found.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches.

    Labels move along the edges and then jump to their labels' labels, so rounds grow with the logarithm of the longest
    path; each round is written to the shared folder, so a lost executor costs that round at most.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, labels.node == around.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = stored(nearer.join(jump, "near").select("node", "old", F.least("near", "far").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label < old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def linked(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fingerprint, component_id) of rows (id, fingerprint): the smallest id that links reach; null ids do not link."""
    groups = stored(prints.where("id IS NOT NULL").groupBy("fingerprint").agg(F.min("id").alias("node")).withColumn("fp", F.conv("fingerprint", 16, -10).cast("long")), "groups")
    first = components(chained(groups, threshold)).withColumnRenamed("component", "label")
    labelled = stored(groups.join(first, "node", "left").select("fingerprint", "fp", F.coalesce("label", "node").alias("label")), "labelled")
    joined = components(links(labelled, threshold)).withColumnRenamed("node", "label")
    return labelled.join(joined, "label", "left").select("fingerprint", F.coalesce("component", "label").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id): one row for each input row.

    Rows with a null id make no links; theirs is the component of their fingerprint, null where no id has it.
    """
    prints = stored(fingerprints(docs, id_col, text_col, size), "fingerprints").withColumnRenamed(id_col, "id")
    return prints.join(linked(prints, threshold), "fingerprint", "left").select(F.col("id").alias(id_col), "fingerprint", "component_id")
