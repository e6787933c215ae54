"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns unit vectors with its own pseudo-rotation (three rounds of random signs and a fast Hadamard transform)
and files them under the nearest signed axis. A query probes the ``probes`` axes it lies nearest to in each table, and
all vectors found there are ranked by their exact Euclidean distance in double precision.

Equal vectors are filed once, as one node, with their smallest ids (one more than the neighbours asked for, so no answer
is lost). Vectors travel in the bytes of their own type, once for each table, never with a pair. Buckets above
``BUCKET_ROWS`` vectors are dealt out in parts, each searched by itself; only the few best of each part travel on.
Workers turn at most ``SLICE_BYTES`` of vectors at a time and hold one part and ``ASKED`` queries.
Queries that find fewer neighbours than asked for are held against all vectors in blocks of about ``ASKED``, which is
exact: each task streams its vectors past the block and gives the few best.

Defined cases: vectors that are null, zero or hold null, NaN or infinite components take no part; vectors meet only
vectors of their own dimension; ties go to the smaller id; rows that share an id stand for separate vectors; a null id
is an id below all others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import parallel, stored

TABLES, PROBES, ROUNDS, SEED = 8, 12, 3, 1729
BUCKET_ROWS = 2048
SALTS = 32
#: Bytes of vectors that a worker turns and gives at a time; queries that it holds against vectors at a time.
SLICE_BYTES = 4 << 20
ASKED = 256


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The unnormalised fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = rows.shape
    half = 1
    while half < d:
        pairs = rows.reshape(n, d // (2 * half), 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        rows = np.stack([a + b, a - b], 2).reshape(n, d)
        half *= 2
    return rows


def rotations(vectors: np.ndarray, tables: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """Unit vectors (rows, any dimension) as each table turns them, padded to a power of two."""
    n, d = vectors.shape
    width = 1 << max(d - 1, 1).bit_length() if d > 1 else 2
    padded = np.zeros((n, width))
    padded[:, :d] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for t in range(tables):
        signs = np.random.default_rng([seed, width, t]).choice([-1.0, 1.0], (ROUNDS, width))
        out = padded
        for s in signs:
            out = hadamard(out * s)
        yield out


def axes(turned: np.ndarray, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: axis i, or width + i for its opposite."""
    both = np.concatenate([turned, -turned], 1)
    probes = min(probes, both.shape[1])
    some = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(both, some, 1), axis=1, kind="stable"), 1)


def usable(vector: Column) -> Column:
    value = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: value(x) != 0)


def _field(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _matrix(batch: pa.RecordBatch, name: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors) for each dimension in a batch."""
    lists = _field(batch, name)
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    return [(rows := np.flatnonzero(sizes == d), flat[begin[rows][:, None] + np.arange(d)]) for d in np.unique(sizes)]


def _filed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """(dim, tbl, bucket, id, vec) of rows (id, v): each vector, as bytes, under ``probes`` axes of every table."""
    arrow = pa.schema([("dim", pa.int32()), ("tbl", pa.int32()), ("bucket", pa.int32()), ("id", pa.int64()), ("vec", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dims, vectors in _matrix(whole, "v"):
                keys, d = _field(whole, "id").take(pa.array(dims)), vectors.shape[1]
                most = max(1, SLICE_BYTES // (d * 8 * min(probes, 2 * d + 2)))
                for start in range(0, len(dims), most):
                    some = vectors[start : start + most]
                    own = keys.slice(start, most)
                    raw = pa.array([v.tobytes() for v in some], pa.binary())
                    for t, turned in enumerate(rotations(some.astype(np.float64), tables)):
                        found = axes(turned, probes)
                        n, p = found.shape
                        again = pa.array(np.repeat(np.arange(n), p))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n * p, d, np.int32)), pa.array(np.full(n * p, t, np.int32)), pa.array(found.reshape(-1).astype(np.int32)), own.take(again), raw.take(again)], schema=arrow)

    return rows.select("id", "v").mapInArrow(run, "dim int, tbl int, bucket int, id long, vec binary")


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """(node, ids, v): each different vector with its ``keep`` smallest ids, limited in salted parts first."""
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part, whole = Window.partitionBy("v", "salt").orderBy("id"), Window.partitionBy("v").orderBy("id")
    some = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= keep).drop("rank", "salt")
    few = some.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "v")


def build_index(nodes: DataFrame, tables: int = TABLES) -> DataFrame:
    """Every node under its axis in every table: (dim, tbl, bucket, id, vec), kept in the shared folder."""
    return stored(_filed(nodes.select(F.col("node").alias("id"), "v"), tables, 1), "cross-polytope")


def _best(x: np.ndarray, nodes: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, node, distance): the k nearest of x for each query, by exact distance; ties to the smaller node."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    squares, own = (x * x).sum(1), (q * q).sum(1)
    rough = own[:, None] + squares - 2 * q @ x.T
    last = min(k, len(x)) - 1
    limits = np.partition(rough, last, axis=1)[:, last] + 1e-9 * (own + squares.max())
    row, at = np.nonzero(rough <= limits[:, None])
    far = np.sqrt(((x[at] - q[row]) ** 2).sum(1))
    order = np.lexsort((nodes[at], far, row))
    row, at, far = row[order], at[order], far[order]
    first = np.searchsorted(row, row)
    few = np.arange(len(row)) - first < k
    return row[few], nodes[at[few]], far[few]


FOUND = pa.schema([("query_id", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])
FOUND_SQL = "query_id long, node long, score double"


def _width(rows: DataFrame) -> str:
    """The numpy type of the components of ``v``."""
    return "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"


def probe(index: DataFrame, queries: DataFrame, k: int, tables: int, probes: int) -> DataFrame:
    """(query_id, node, score): the k nearest nodes found in each part of a bucket that a query (id, v) probes."""
    kind, keys = _width(queries), ["dim", "tbl", "bucket"]
    # Only large buckets have a row here, so this side of the joins is at most a BUCKET_ROWS-th of the index.
    parts = index.groupBy(*keys).count().where(F.col("count") > BUCKET_ROWS).select(*keys, F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("parts"))
    parts = stored(parts, "large-buckets")
    of = F.coalesce("parts", F.lit(1))
    members = index.join(parts, keys, "left").select(*keys, F.pmod(F.xxhash64("id"), of).cast("int").alias("part"), F.lit(0).alias("asks"), "id", "vec")
    asked = _filed(queries, tables, probes).join(parts, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), of - 1)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: each part's members (at most about BUCKET_ROWS), then its queries."""
        now, held, x, nodes = None, [], None, None
        for batch in batches:
            names = [_field(batch, c).to_numpy() for c in (*keys, "part", "asks", "id")]
            raw, n = _field(batch, "vec"), batch.num_rows
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in names[:5]], axis=0)) + 1 if n > 1 else np.zeros(0, int)
            for start, end in zip([0, *new.tolist()], [*new.tolist(), n], strict=True) if n else ():
                key, asks, ids = tuple(int(c[start]) for c in names[:4]), names[4][start], names[5][start:end]
                if key != now:
                    now, held, x = key, [], None
                vectors = np.frombuffer(b"".join(raw.slice(start, end - start).to_pylist()), kind).reshape(end - start, -1)
                if not asks:
                    held.append((vectors, ids))
                    continue
                if x is None and held:
                    x, nodes = (np.concatenate(c) for c in zip(*held, strict=True))
                    held = []
                for j in range(0, len(ids) if x is not None else 0, ASKED):
                    row, near, far = _best(x, nodes, vectors[j : j + ASKED], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[j : j + ASKED][row]), pa.array(near), pa.array(far)], schema=FOUND)

    both = members.unionByName(asked.select(*keys, "part", F.lit(1).alias("asks"), "id", "vec"))
    dealt = both.repartition(parallel(index.sparkSession), *keys, "part").sortWithinPartitions(*keys, "part", "asks")
    return dealt.mapInArrow(run, FOUND_SQL)


def scanned(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, node, score): the k nearest nodes of each task for each query; queries: at most a few blocks' worth."""
    rows = queries.select("id", "v").collect()
    sent = nodes.sparkSession.sparkContext.broadcast([(r["id"], r["v"]) for r in rows])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, ...]] = {}
        by_dim: dict[int, list[tuple]] = {}
        for i, v in sent.value:
            by_dim.setdefault(len(v), []).append((i, v))
        asked = {d: (np.array([i for i, _ in some]), np.array([v for _, v in some], np.float64)) for d, some in by_dim.items()}
        for batch in batches:
            for at, x in _matrix(batch, "v"):
                d = x.shape[1]
                most = max(1, SLICE_BYTES // (8 * d))
                for start in range(0, len(at), most) if d in asked else ():
                    some = _best(x[start : start + most], _field(batch, "node").to_numpy()[at[start : start + most]], asked[d][1], k)
                    row, near, far = (np.concatenate(c) for c in zip(best[d], some, strict=True)) if d in best else some
                    order = np.lexsort((near, far, row))
                    row, near, far = row[order], near[order], far[order]
                    few = np.arange(len(row)) - np.searchsorted(row, row) < k
                    best[d] = row[few], near[few], far[few]
        for d, (row, near, far) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked[d][0][row]), pa.array(near), pa.array(far)], schema=FOUND)

    return nodes.select("node", "v").mapInArrow(run, FOUND_SQL)


def _ranked(found: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest ids but the query's own, of nodes found once or more."""
    order = Window.partitionBy("query_id").orderBy("score", "node")
    once = found.repartition("query_id").groupBy("query_id", "node").agg(F.min("score").alias("score"))
    near = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    each = near.join(nodes.select("node", "ids"), "node").select("query_id", "score", F.explode("ids").alias("vec_id")).where(~F.col("vec_id").eqNullSafe(F.col("query_id")))
    whole = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries among the vectors themselves.

    vectors: (id, v array); queries: (query_id, v). A query's own id is no neighbour of it.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    kind = "array<float>" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "array<double>"
    usual = lambda df, name: df.where(usable(F.col("v"))).select(F.coalesce(F.col(name).cast("long"), lowest).alias("id"), F.col("v").cast(kind).alias("v"))
    asked = usual(queries, "query_id")
    nodes = stored(distinct_vectors(usual(vectors, "id"), k + 1), "vectors")
    best = stored(_ranked(probe(build_index(nodes, tables), asked, k + 1, tables, probes), nodes, k), "neighbours")
    enough = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = stored(asked.join(enough.withColumnRenamed("query_id", "id"), "id", "left_anti"), "short-queries")
    blocks = -(-short.count() // ASKED)
    if blocks:
        dealt = short.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        exact = [stored(_ranked(scanned(nodes, dealt.where(F.col("block") == b), k + 1), nodes, k), "exact") for b in range(blocks)]
        best = best.join(enough, "query_id", "left_semi")
        for part in exact:
            best = best.unionByName(part)
    own = lambda c: F.when(F.col(c) != lowest, F.col(c)).alias(c)
    return best.select(own("query_id"), "rank", own("vec_id"), "score")
