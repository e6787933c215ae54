"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with SQL functions alone.

A text's paragraphs are its lines in pieces of up to ``PIECE`` words; texts of fewer than 8 pieces of that size have
smaller ones (8, 4, 2 or 1 words), so that short texts have several too. Each distinct paragraph has a 64-bit digest:
44 bits of hash and a 20-bit check over them. A sketch puts a digest into one cell of each of three tables; a cell
holds a count and the exclusive or of its digests. Each version builds its sketch alone; two versions' sketches
subtract cell by cell, what they share vanishes, and peeling cells with a single digest recovers exactly those in which
the versions differ. The fingerprint is the sketch with ``CELLS`` cells a table. Where it is too full or gets stuck, the
comparison is made again larger: both versions sketch themselves anew with tables that can hold all their digests, and
with twice as many cells at every further try. Likeness is the Jaccard coefficient of the paragraph sets, from their
sizes and the number of recovered digests. Only if ``TRIES`` sizes fail (each fails for a few pairs in a thousand at
most, independently) are the digests themselves compared, so the likeness is always that of the sets.

Sketches are kept sparse, as their cells that hold something in order, so work grows with the length of a text. It
needs neither Python nor a shuffle, and stays in the row.

Defined cases: null text counts as empty; two texts without paragraphs are alike (1.0); equal texts have equal
fingerprints; repeated paragraphs count once; rows that share an id follow one another in the order of their texts, null
ids come first; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import parallel

PIECE = 16
TABLES = 3
#: Cells of each table of the fingerprint, a power of two; above so many full cells of all, a difference is too large.
CELLS, FULL = 16, 40
TRIES, ROUNDS = 4, 32
CELL = "STRUCT<c: INT, n: INT, k: BIGINT>"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def digests(text: str) -> str:
    """SQL for the distinct paragraph digests of a text expression."""
    spaced = f"regexp_replace({text}, '[^\\\\S\\n]+', ' ')"
    lines = f"filter(transform(split({spaced}, '\\n'), line -> array_remove(split(line, ' '), '')), ws -> size(ws) > 0)"
    sizes = " ".join(f"WHEN n < {8 * size} THEN {size // 2}" for size in (2, 4, 8, 16) if size <= PIECE)
    size = _let("n", "aggregate(ls, 0, (t, ws) -> t + size(ws))", f"CASE {sizes} ELSE {PIECE} END")
    key = "transform(array(shiftrightunsigned(xxhash64(slice(ws, i + 1, p)), 20)), d -> shiftleft(d, 20) | (xxhash64(d) & 1048575))[0]"
    pieces = f"flatten(transform(ls, ws -> transform(sequence(0, size(ws) - 1, p), i -> {key})))"
    return f"array_distinct({_let('ls', lines, _let('p', size, pieces))})"


def merged(cells: str) -> str:
    """SQL that adds up cells of the same place: counts add, digests by exclusive or; cells left empty go."""
    end = "coalesce(get(at, j + 1), size(es))"
    total = "aggregate(slice(es, p + 1, {end} - p), named_struct('c', es[p].c, 'n', 0, 'k', 0L), (s, e) -> named_struct('c', s.c, 'n', s.n + e.n, 'k', s.k ^ e.k))".replace("{end}", end)
    each = f"transform(at, (p, j) -> IF({end} = p + 1, es[p], {total}))"
    first = "filter(sequence(0, size(es) - 1), i -> i = 0 OR es[i].c <> es[i - 1].c)"
    one = f"IF(size(es) = 0, es, {_let('at', first, f'filter({each}, e -> e.n <> 0 OR e.k <> 0L)')})"
    return _let("es", f"sort_array({cells})", one)


def sketch(keys: str, size: str | int = CELLS, sign: str | int = 1) -> str:
    """SQL for the full cells of a sketch of digests, ``size`` cells a table; place c is cell c % size of table c / size."""
    place = lambda t: f"CAST((xxhash64(k, {t}, {size}) & ({size} - 1)) + {t} * {size} AS INT)"
    cells = ", ".join(f"named_struct('c', {place(t)}, 'n', {sign}, 'k', k)" for t in range(TABLES))
    return merged(f"flatten(transform({keys}, k -> array({cells})))")


def subtract(a: str, b: str) -> str:
    return merged(f"concat({a}, transform({b}, e -> named_struct('c', e.c, 'n', -e.n, 'k', e.k)))")


def peel(cells: str, size: str | int = CELLS) -> str:
    """SQL for the number of digests recovered from a sketch; null if peeling gets stuck."""
    check = "(xxhash64(shiftrightunsigned(c.k, 20)) & 1048575) = (c.k & 1048575)"
    single = f"array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 AND {check}), c -> named_struct('n', c.n, 'k', c.k)))"
    place = lambda t: f"CAST((xxhash64(e.k, {t}, {size}) & ({size} - 1)) + {t} * {size} AS INT)"
    gone = ", ".join(f"named_struct('c', {place(t)}, 'n', -e.n, 'k', e.k)" for t in range(TABLES))
    rest = merged(f"concat(s.cells, flatten(transform(pure, e -> array({gone}))))")
    step = _let("pure", single, f"IF(size(pure) = 0, named_struct('cells', s.cells, 'found', s.found, 'go', false), named_struct('cells', {rest}, 'found', s.found + size(pure), 'go', true))")
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'found', 0, 'go', true), (s, r) -> IF(s.go AND size(s.cells) > 0, {step}, s), s -> IF(size(s.cells) = 0, s.found, CAST(NULL AS INT)))"


def differing(a: str, b: str, sketch_a: str, sketch_b: str) -> str:
    """SQL for how many digests two texts differ in, from their sketches; from larger ones where those do not peel."""
    small = _let("less", subtract(sketch_a, sketch_b), f"IF(size(less) > {FULL}, CAST(NULL AS INT), {peel('less')})")
    # The least power of two of at least half of all digests and a few more, twice that at the next try.
    size = f"CAST(shiftleft(1, CAST(ceil(log2((size({a}) + size({b})) / 2 + 8)) AS INT) + try - 1) AS INT)"
    large = _let("m", size, peel(subtract(sketch(a, "m"), sketch(b, "m")), "m"))
    tries = f"aggregate(sequence(1, {TRIES}), CAST(NULL AS INT), (d, try) -> coalesce(d, {large}))"
    plain = f"size(array_except({a}, {b})) + size(array_except({b}, {a}))"
    return f"coalesce({small}, {tries}, {plain})"


def likeness(a: str, b: str, sketch_a: str, sketch_b: str) -> Column:
    """The Jaccard coefficient of two texts' paragraphs; a, b: their digests."""
    size = f"(size({a}) + size({b}))"
    return F.expr(f"CASE WHEN {size} = 0 THEN 1D ELSE {_let('d', differing(a, b, sketch_a, sketch_b), f'({size} - d) / CAST({size} + d AS DOUBLE)')} END")


def written(cells: str) -> Column:
    """A sketch as text: place, count and exclusive or of each full cell in hexadecimal."""
    return F.expr(f"array_join(transform({cells}, e -> concat(hex(e.c), ':', hex(e.n), ':', hex(e.k))), ',')")


def with_fingerprint(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add (prefix)keys, the digests, and (prefix)cells, the sketch of each row's text."""
    keyed = df.withColumn(f"{prefix}keys", F.expr(digests(f"coalesce({text_col}, '')")))
    return keyed.withColumn(f"{prefix}cells", F.expr(sketch(f"{prefix}keys")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row."""
    rows = with_fingerprint(docs.select(F.col(id_col), F.col(text_col).alias("text")))
    return rows.select(id_col, written("cells").alias("fingerprint"))


def _ranges(docs: DataFrame, parts: int) -> list[int]:
    """Ids that cut the rows into about ``parts`` ranges: as many numbers, whatever the size of the table."""
    cuts = docs.agg(F.percentile_approx("ord", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    return sorted(set(cuts or []))


def _range_of(cuts: list[int]) -> Column:
    """The range of an id, by two steps of about the square root of their number."""
    step = isqrt(len(cuts)) + 1
    coarse = "array(" + ", ".join(f"{c}L" for c in cuts[::step]) + ")"
    fine = "array(" + ", ".join("array(" + ", ".join(f"{c}L" for c in cuts[i : i + step]) + ")" for i in range(0, len(cuts), step)) + ")"
    below = f"transform(array(size(filter({coarse}, c -> c < ord))), n -> IF(n = 0, 0, (n - 1) * {step} + size(filter({fine}[n - 1], c -> c < ord))))[0]"
    return F.expr(below) if cuts else F.lit(0)


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Rows (ord, ...) with next_<column> of the row that follows by ``ord``; the first follows the last.

    derived: columns that are made once for each row, before it meets its next.

    Rows meet their next in windows over ranges of ids. Each range also gets a copy of the row that opens the range
    after it, so no window spans the table; one id for each range goes through the driver.
    """
    spark = docs.sparkSession
    parts = parts or 8 * parallel(spark)
    cuts = _ranges(docs, parts)
    ranged = docs.withColumn("range", _range_of(cuts))
    firsts = sorted((r["range"], r["ord"]) for r in ranged.groupBy("range").agg(F.min("ord").alias("ord")).collect())
    if not firsts:
        return docs.withColumns(derived).select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    after = [(ordinal, before) for (before, _), (_, ordinal) in zip(firsts, [*firsts[1:], firsts[0]], strict=True)]
    opening = F.broadcast(spark.createDataFrame(after, "ord long, before int"))
    lent = docs.join(opening, "ord").withColumn("range", F.col("before")).drop("before").withColumn("lent", F.lit(1))
    rows = ranged.withColumn("lent", F.lit(0)).unionByName(lent).withColumns(derived)
    window = Window.partitionBy("range").orderBy("lent", "ord", "text")
    return rows.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns]).where("lent = 0").drop("lent", "range")


LOWEST = -(1 << 63)


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compare each text with an edit of it (its last quarter replaced by the next text's opening) and with the next."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(LOWEST)))
    follows = with_next(rows, ["text", "keys"], {"keys": F.expr(digests("text"))})
    size = follows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.expr("CAST(n_chars DIV 4 AS INT)"))
    edited = size.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars AS INT) - cut), substring(next_text, 1, cut))"))
    keyed = edited.withColumn("edited_keys", F.expr(digests("edited")))
    prints = keyed.withColumns({f"{p}cells": F.expr(sketch(f"{p}keys")) for p in ("", "edited_", "next_")})
    return prints.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("cells").alias("fingerprint"),
        written("edited_cells").alias("edited_fingerprint"),
        likeness("keys", "edited_keys", "cells", "edited_cells").alias("near_edited"),
        likeness("keys", "next_keys", "cells", "next_cells").alias("near_next"),
    )
