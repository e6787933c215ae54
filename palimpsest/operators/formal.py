"""Formal extraction: dates, redaction labels, signatures, sections and keyword types of legal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions import text as T


def date_candidates(text: str) -> str:
    """Dates in order, one of each spelling, then placeholders of redacted dates."""
    dates = f"transform(regexp_extract_all({text}, {T.pattern(C.DATE)}, 0), x -> {T.collapsed('x')})"
    hidden = f"transform(filter(regexp_extract_all({text}, {T.pattern(C.REDACTION)}, 0), x -> regexp_extract(x, {T.pattern(C.REDACTION)}, 1) ILIKE 'data'), x -> {T.collapsed('x')})"
    return f"transform(array(concat({dates}, {hidden})), found -> {T.first_of_each('found', T.fold('x'))})[0]"


def redaction_labels(text: str) -> str:
    """Sorted labels of the placeholders; names of persons under one."""
    found = f"transform(regexp_extract_all({text}, {T.pattern(C.REDACTION)}, 1), x -> {T.searchable('x')})"
    return f"array_sort(array_distinct(transform({found}, x -> IF(x IN ('im', 'imie nazwisko'), 'person', x))))"


def signed(folded: str) -> str:
    return f"(NOT {folded} RLIKE {T.pattern(C.UNSIGNED)} AND {folded} RLIKE {T.pattern(C.SIGNED)})"


def type_scores(search: str) -> str:
    each = [f"named_struct('score', {' + '.join(f'CAST(contains({search}, {T.quoted(w)}) AS INT)' for w in C.listed(words))}, 'rank', {-i}, 'type', {T.quoted(t)}, 'of', {len(C.listed(words))})" for i, (t, words) in enumerate(C.TYPE_WORDS.items())]
    return f"array_max(array({', '.join(each)}))"


def extract(docs: DataFrame, text: str = "text", own_type: str = "CAST(NULL AS STRING)") -> DataFrame:
    """Add document_type, confidence and the formal fields of each text (null text: as empty)."""
    rows = docs.withColumn("_text", F.expr(f"coalesce({text}, '')")).withColumn("_folded", F.expr(T.fold("_text"))).withColumn("_search", F.expr(T.searchable_of("_folded"))).withColumn("_plain", F.expr(T.unnegated("_search")))
    rows = rows.withColumns({name: F.expr(T.mentions("_plain", C.listed(words))) for name, words in C.SECTIONS.items()})
    rows = rows.withColumns({"_dates": F.expr(date_candidates("_text")), "redaction_labels": F.expr(redaction_labels("_text")), "has_signature": F.expr(signed("_folded")), "_best": F.expr(type_scores("_search"))})
    return rows.withColumns({
        "has_text": F.expr(f"NOT {T.blank('_text')}"),
        "has_date": F.expr("size(_dates) > 0"),
        "date_candidates": F.expr("slice(_dates, 1, 5)"),
        "detected_sections": F.expr(f"array_sort(filter(array({', '.join(f'IF({s}, {T.quoted(s)}, NULL)' for s in C.SECTIONS)}), x -> x IS NOT NULL))"),
        "document_type": F.expr(f"IF(_best.score > 0, _best.type, IF({own_type} IS NOT NULL AND {own_type} <> 'unknown', {own_type}, 'unknown'))"),
        "confidence": F.expr(f"CASE WHEN _best.score > 0 THEN bround(least(_best.score / _best.of, 1D), 4) WHEN {own_type} IS NOT NULL AND {own_type} <> 'unknown' THEN 0.5D ELSE 0D END"),
    }).drop("_text", "_folded", "_search", "_plain", "_dates", "_best")
