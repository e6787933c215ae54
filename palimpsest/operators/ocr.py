"""Recognised pages: text, confidence and words from the payloads of recognition engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T


def _json(payload: str, path: str, kind: str = "STRING") -> str:
    return f"try_variant_get({payload}, '$.{path}', '{kind}')"


def payload_text(payload: str) -> Column:
    """The text of a JSON payload: the first non-blank of its text keys, else its words, else its lines, else empty."""
    doc = f"try_parse_json({payload})"
    # Only strings count as text: a number or object under a text key does not.
    keys = ", ".join(f"IF(schema_of_variant(variant_get({doc}, '$.{k}')) = 'STRING' AND NOT {T.blank(_json(doc, k))}, {_json(doc, k)}, NULL)" for k in ("content", "text_content", "full_text", "text"))
    word = f"filter(transform(page, w -> {T.strip('w.tekst')}), t -> NOT {T.blank('t')})"
    pages = f"transform({_json(doc, 'words_per_page', 'ARRAY<ARRAY<STRUCT<tekst: STRING>>>')}, page -> array_join({word}, ' '))"
    lines = f"{_json(doc, 'pages', 'ARRAY<STRUCT<lines: ARRAY<VARIANT>>>')}"
    line = "coalesce(IF(schema_of_variant(l) = 'STRING', CAST(l AS STRING), NULL), try_variant_get(l, '$.content', 'STRING'))"
    rows = f"filter(transform(flatten(transform({lines}, p -> coalesce(p.lines, array()))), l -> {T.strip(line)}), t -> NOT {T.blank('t')})"
    words = f"array_join(filter({pages}, t -> t <> ''), '\\n')"
    return F.expr(f"coalesce({keys}, nullif({words}, ''), nullif(array_join({rows}, '\\n'), ''), '')")


def confidence(words: str, of_document: str = "CAST(NULL AS DOUBLE)") -> Column:
    """The document's own confidence, else the mean of its words'; null if there are none."""
    mean = f"aggregate(filter({words}, c -> c IS NOT NULL), named_struct('s', 0D, 'n', 0), (a, c) -> named_struct('s', a.s + c, 'n', a.n + 1), a -> try_divide(a.s, a.n))"
    return F.expr(f"bround(coalesce({of_document}, {mean}), 4)")


def normalise(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Add content, pages (number, lines, word confidences), page_count and confidence of cloud payloads."""
    doc = f"try_parse_json({payload})"
    shape = "ARRAY<STRUCT<page_number: INT, width: DOUBLE, height: DOUBLE, lines: ARRAY<STRUCT<content: STRING>>, words: ARRAY<STRUCT<confidence: DOUBLE>>>>"
    pages = f"coalesce({_json(doc, 'pages', shape)}, array())"
    page = "named_struct('page_number', coalesce(p.page_number, i + 1), 'width', p.width, 'height', p.height, 'lines', filter(transform(coalesce(p.lines, array()), l -> l.content), c -> coalesce(c, '') <> ''), 'words_confidence', filter(transform(coalesce(p.words, array()), w -> w.confidence), c -> c IS NOT NULL))"
    rows = payloads.withColumn("pages", F.expr(f"transform({pages}, (p, i) -> {page})"))
    own = f"filter(transform(coalesce({_json(doc, 'documents', 'ARRAY<STRUCT<confidence: DOUBLE>>')}, array()), d -> d.confidence), c -> c IS NOT NULL)"
    return rows.withColumns({
        "content": F.expr(f"coalesce(nullif({_json(doc, 'content')}, ''), array_join(flatten(transform(pages, p -> p.lines)), '\\n'))"),
        "page_count": F.size("pages"),
        "confidence": confidence("flatten(transform(pages, p -> p.words_confidence))", f"try_divide(aggregate({own}, 0D, (a, c) -> a + c), size({own}))"),
    })


def word_boxes(words: str, border: int = 30) -> Column:
    """Words as the engine gives them, trimmed, blanks dropped, the border that was added taken off."""
    return F.expr(f"filter(transform({words}, w -> named_struct('text', {T.strip('w.text')}, 'x', greatest(0, w.x - {border}), 'y', greatest(0, w.y - {border}), 'width', w.width, 'height', w.height)), w -> w.text <> '')")


def flat_words(docs: DataFrame, id_col: str = "doc_id", pages: str = "pages") -> DataFrame:
    """(id, word_id, text, x, y, width, height, page): ids w0, w1, ... run across a document's pages."""
    each = docs.select(id_col, F.posexplode(pages).alias("_page", "_words")).select(id_col, "_page", F.posexplode("_words").alias("_at", "w"))
    order = Window.partitionBy(id_col).orderBy("_page", "_at")
    return each.select(id_col, F.concat(F.lit("w"), (F.row_number().over(order) - 1).cast("string")).alias("word_id"), "w.*", (F.col("_page") + 1).alias("page"))
