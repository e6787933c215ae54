"""Legal reviews by a language model: prompt, reply, and the words that findings point at."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from palimpsest.functions import text as T

LEAST_RATIO = 0.7
PROMPT = """You are a lawyer versed in Polish law. Review this document.

Document: {name}

---
{text}
---

Reply with JSON alone, in Polish, with the keys summary, errors and applicable_laws. Each error has issue,
text_reference (an exact passage of the document) and severity (critical, high or medium); each law has law,
description and reference. Passages marked [UTAJNIONO] are removed personal data and no errors."""


def prompt(name: Column, text: Column, template: str = PROMPT) -> Column:
    head, rest = template.split("{name}")
    middle, tail = rest.split("{text}")
    return F.concat(F.lit(head), F.coalesce(name, F.lit("")), F.lit(middle), F.coalesce(text, F.lit("")), F.lit(tail))


def reply(raw: str) -> Column:
    """summary, errors (issue, text_reference, severity) and applicable_laws of a reply; all empty if it is no JSON object."""
    doc = f"try_parse_json({raw})"
    errors = f"coalesce(try_variant_get({doc}, '$.errors', 'ARRAY<VARIANT>'), array())"
    value = lambda key, default: f"IF(try_variant_get(e, '$.{key}') IS NULL, '{default}', coalesce(try_variant_get(e, '$.{key}', 'STRING'), ''))"
    whole = f"named_struct('issue', {value('issue', '')}, 'text_reference', {value('text_reference', '')}, 'severity', {value('severity', 'medium')})"
    bare = "named_struct('issue', coalesce(try_variant_get(e, '$', 'STRING'), to_json(e)), 'text_reference', '', 'severity', 'medium')"
    each = f"IF(schema_of_variant(e) LIKE 'OBJECT%', {whole}, {bare})"
    return F.expr(f"named_struct('summary', coalesce(try_variant_get({doc}, '$.summary', 'STRING'), ''), 'errors', transform({errors}, e -> {each}), 'applicable_laws', coalesce(to_json(try_variant_get({doc}, '$.applicable_laws')), '[]'))")


def review(docs: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """Add raw_reply by the model boundary (mapInPandas over ``prompt``); without a model the empty review."""
    asked = docs.withColumn("prompt", prompt(F.col("filename"), F.col("text")))
    if model is None:
        return asked.withColumn("raw_reply", F.lit(None).cast("string"))
    return asked.mapInPandas(model, asked.withColumn("raw_reply", F.lit("")).schema)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of two lower-cased strings; words change and references stay, which the matcher caches."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def locate(errors: DataFrame, words: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """Add word_id, page and bbox of the word each error's reference is most like, above ``least``; the first of equals.

    errors: analysis_id, error_idx, text_reference, ...; words: analysis_id, idx, word_id, text, x, y, width, height, page.
    A pair's ratio cannot exceed twice the shorter length over both, so most pairs fall before Python sees them.
    """
    refs = errors.select("analysis_id", "error_idx", F.lower("text_reference").alias("_ref")).where(f"NOT {T.blank('_ref')}")
    pairs = refs.join(words.withColumn("_word", F.lower("text")), "analysis_id")
    a, b = F.char_length("_ref"), F.char_length("_word")
    near = pairs.where(2 * F.least(a, b) > least * (a + b)).withColumn("_ratio", ratio("_ref", "_word")).where(F.col("_ratio") > least)
    best = Window.partitionBy("analysis_id", "error_idx").orderBy(F.desc("_ratio"), "idx")
    top = near.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    boxes = top.select("analysis_id", "error_idx", "word_id", "page", F.struct("x", "y", "width", "height").alias("bbox"))
    return errors.join(boxes, ["analysis_id", "error_idx"], "left")
