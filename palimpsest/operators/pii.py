"""Personal data on pages of words: detection, masks, and the merging of digits that recognition split.

A page's words are ``array<struct<text,x,y,width,height>>`` and never leave their row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions import text as T

WORD = "struct<text:string,x:int,y:int,width:int,height:int>"


def own_label(word: str) -> str:
    """The label of a word by itself: the first detector that matches at its start."""
    detectors = [("PESEL", C.PESEL, "(?U)"), ("ADRES", C.ADDRESS, "(?iU)"), ("EMAIL", C.EMAIL, "(?U)"), ("TELEFON", rf"{C.PHONE}(?!\d)", "(?U)")]
    cases = " ".join(f"WHEN {word} RLIKE {T.pattern(f'^(?:{p})', flags)} THEN {T.quoted(C.LABEL.format(label))}" for label, p, flags in detectors)
    return f"CASE {cases} END"


def date_fragments(page: str) -> str:
    """The lower-cased words of the dates on a page."""
    found = f"concat(regexp_extract_all({page}, {T.pattern(C.PAGE_DATE, '(?U)')}, 0), regexp_extract_all({page}, {T.pattern(C.PAGE_DATE_PL + r'(?!\d)')}, 0))"
    return f"array_distinct(flatten(transform({found}, d -> split(lower({T.collapsed('d')}), ' '))))"


def personal_data(pages: DataFrame, words: str = "words", entities: str | None = None) -> DataFrame:
    """Add ``found``: the words to mask, with labels, in the order of the passes (own, dates, named entities).

    Later passes skip words at a place that is found already. entities: a column of (fragment, label) of a
    named-entity model, if there is one.
    """
    page = f"array_join(transform({words}, w -> w.text), ' ')"
    labelled = "named_struct('text', w.text, 'x', w.x, 'y', w.y, 'width', w.width, 'height', w.height, 'label', {})"
    own = f"filter(transform({words}, w -> {labelled.format(own_label('w.text'))}), w -> w.label IS NOT NULL)"

    def fresh(found: str, so_far: str) -> str:
        """Found words, first of each place, without places already taken."""
        return T.first_of_each(f"filter({found}, f -> NOT exists({so_far}, o -> o.x = f.x AND o.y = f.y))", "concat_ws(',', x.x, x.y)")

    # Fragment by fragment, in the order of the pages' dates. What lambdas share is bound once by T.bound: a column
    # of its own would be put in its place inside the lambda, to run for every word.
    dates = f"flatten(transform(fragments, d -> transform(filter({words}, w -> lower(w.text) = d), w -> {labelled.format(T.quoted(C.LABEL.format('DATA')))})))"
    found = T.bound("own", own, T.bound("fragments", date_fragments(page), f"concat(own, {fresh(dates, 'own')})"))
    if entities:
        of = f"transform(filter({words}, w -> lower(w.text) = d), w -> {labelled.format('e.label')})"
        named = f"flatten(transform({entities}, e -> flatten(transform(filter(split(lower(e.fragment), '\\\\s+'), d -> d <> ''), d -> {of}))))"
        found = T.bound("so_far", found, f"concat(so_far, {fresh(named, 'so_far')})")
    return pages.withColumn("found", F.expr(found))


def mask_boxes(found: str, width: str, height: str, pad: int = 8) -> Column:
    """The rectangles to paint over: words with a margin, within the page."""
    return F.expr(f"transform({found}, w -> named_struct('left', greatest(0, w.x - {pad}), 'top', greatest(0, w.y - {pad}), 'right', least({width}, w.x + w.width + {pad}), 'bottom', least({height}, w.y + w.height + {pad}), 'label', w.label))")


def merge_digits(words: str, dy: int = 15, gap: int = 40) -> Column:
    """Join runs of digits that lie near one another: each unused one takes up later ones near *itself*."""
    digits = f"w.text RLIKE {T.quoted('^[0-9]+$')}"
    near = f"abs(w.y - a.y) <= {dy} AND w.x - (a.x + a.width) <= {gap} AND a.x - (w.x + w.width) <= {gap}"
    rest = f"filter(sequence(i + 1, size(ws) - 1), j -> j > i AND NOT array_contains(s.used, j) AND transform(array(ws[j]), w -> {digits} AND {near})[0])"
    group = "array_sort(transform(concat(array(i), taken), j -> named_struct('x', ws[j].x, 'j', j, 'w', ws[j])))"
    merged = "named_struct('text', array_join(transform(g, e -> e.w.text), ''), 'x', array_min(transform(g, e -> e.w.x)), 'y', array_min(transform(g, e -> e.w.y)), 'width', CAST(aggregate(g, 0, (t, e) -> t + e.w.width) AS INT), 'height', CAST(array_max(transform(g, e -> e.w.y + e.w.height)) - array_min(transform(g, e -> e.w.y)) AS INT))"
    whole = f"transform(array({group}), g -> CAST({merged} AS {WORD}))[0]"
    take = f"transform(array({rest}), taken -> named_struct('used', concat(s.used, taken), 'out', concat(s.out, array({whole}))))[0]"
    keep = f"named_struct('used', s.used, 'out', concat(s.out, array(CAST(ws[i] AS {WORD}))))"
    step = f"CASE WHEN array_contains(s.used, i) THEN s WHEN transform(array(ws[i]), w -> {digits})[0] AND i < size(ws) - 1 THEN transform(array(ws[i]), a -> {take})[0] ELSE {keep} END"
    start = f"named_struct('used', CAST(array() AS ARRAY<INT>), 'out', CAST(array() AS ARRAY<{WORD}>))"
    return F.expr(f"IF(size({words}) > 0, transform(array({words}), ws -> aggregate(sequence(0, size(ws) - 1), {start}, (s, i) -> {step}, s -> s.out))[0], {words})")


#: Labels of named entities by language of the page, other languages by the Polish model.
ENTITY_LABELS = {
    "en": {"PERSON": "[UTAJNIONO: IMIE/NAZWISKO]", "DATE": "[UTAJNIONO: DATA]"},
    "pl": {
        "persName": "[UTAJNIONO: IMIE/NAZWISKO]",
        "placeName": "[UTAJNIONO: ADRES]",
        "geogName": "[UTAJNIONO: ADRES]",
        "date": "[UTAJNIONO: DATA]",
        "time": "[UTAJNIONO: DATA]",
    },
}
#: Pages of fewer characters have no named entities.
LEAST_TEXT = 5


def routed(entities: str, language: str, words: str = "words") -> Column:
    """A model's (fragment, kind) as (fragment, label): kinds that count in the page's language (null: Polish) alone."""
    page = T.strip(f"array_join(transform({words}, w -> w.text), ' ')")
    tables = {lang: "map(" + ", ".join(f"{T.quoted(k)}, {T.quoted(v)}" for k, v in table.items()) + ")" for lang, table in ENTITY_LABELS.items()}
    label = f"IF({language} = 'en', {tables['en']}[e.kind], {tables['pl']}[e.kind])"
    known = f"filter(transform({entities}, e -> named_struct('fragment', e.fragment, 'label', {label})), e -> e.label IS NOT NULL)"
    return F.expr(f"IF(length({page}) < {LEAST_TEXT}, CAST(array() AS ARRAY<STRUCT<fragment: STRING, label: STRING>>), {known})")


def redacted_files(pages: DataFrame, key: str, name: str, found: str = "found") -> DataFrame:
    """(key, filename, total, pages) of files from the rows of their pages: what is masked, and the output's name."""
    stem = F.regexp_replace(F.regexp_extract(F.max(name), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return pages.groupBy(key).agg(F.concat(F.lit("anonymized_"), stem, F.lit(".tiff")).alias("filename"), F.sum(F.size(found)).alias("total"), F.count("*").alias("pages"))


def with_entities(pages: DataFrame, model: Callable | None = None) -> DataFrame:
    """The named-entity boundary: ``model`` maps Arrow batches of pages to batches with ``entities``; none: no entities."""
    if model is None:
        return pages.withColumn("entities", F.expr("CAST(array() AS ARRAY<STRUCT<fragment: STRING, label: STRING>>)"))
    return pages.mapInArrow(model, pages.withColumn("entities", F.expr("CAST(array() AS ARRAY<STRUCT<fragment: STRING, label: STRING>>)")).schema)
