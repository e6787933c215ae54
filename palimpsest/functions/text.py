"""Text functions, as SQL expressions over SQL expressions: they stay in the JVM and in one projection."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions.constants import NEGATIONS


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(value: str, flags: str = "(?iU)") -> str:
    return quoted(flags + value)


def strings(values: list[str]) -> str:
    return "array(" + ", ".join(map(quoted, values)) + ")" if values else "CAST(array() AS ARRAY<STRING>)"


def bound(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def each(rows: DataFrame, values: str, name: str) -> DataFrame:
    """A row for each element of the array ``values``.

    From a plain explode the optimiser infers size(...) > 0 and pushes that, with all that makes the array, below the
    joins that feed it; the outer one leaves the array where it is.
    """
    return rows.withColumn(name, F.explode_outer(F.expr(values))).where(F.col(name).isNotNull())


def fold(text: str) -> str:
    """Lower case, sharp s as ss, the nine Polish letters as ASCII; other accents stay."""
    low, letters = f"lower({text})", "ąćęłńóśźż"
    return f"IF({low} RLIKE '[ß{letters}]', translate(replace({low}, 'ß', 'ss'), '{letters}', 'acelnoszz'), {low})"


def searchable(text: str) -> str:
    """Folded text with everything but letters and digits of ASCII as single blanks."""
    return searchable_of(fold(text))


def searchable_of(folded: str) -> str:
    return f"trim(regexp_replace({folded}, '[^a-z0-9]+', ' '))"


def tokens(search: str) -> str:
    return f"IF({search} = '', CAST(array() AS ARRAY<STRING>), split({search}, ' '))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, {pattern(r'^\s+|\s+$', '(?U)')}, '')"


def blank(text: str) -> str:
    return f"NOT coalesce({text}, '') RLIKE {pattern(r'\S', '(?U)')}"


def collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, {pattern(r'\s+', '(?U)')}, ' '))"


def unnegated(search: str) -> str:
    """Searchable text in which negations and the five words after each are marks, which no keyword matches.

    A negation becomes #5 and a word after a mark the next smaller one: each pass is one scan of the text.
    """
    some = "|".join(NEGATIONS)
    marked = f"regexp_replace({search}, '(?<= |^)(?:{some})(?= |$)', '#5')"
    for k in range(5, 0, -1):
        marked = f"regexp_replace({marked}, '(?<=#{k} )[a-z0-9]+', '#{k - 1}')"
    return f"IF({search} RLIKE '(?: |^)(?:{some})(?: |$)', {marked}, {search})"


def mentions(unnegated: str, keywords: list[str]) -> str:
    """Whether a keyword occurs, its words as prefixes of successive words, with no negation in the five words before."""
    some = "|".join("[a-z0-9]* ".join(k.split()) for k in keywords)
    return f"{unnegated} RLIKE {quoted(f'(?:^| )(?:{some})')}"


def first_of_each(values: str, key: str) -> str:
    """Values without those whose key (SQL over ``x``) an earlier one has."""
    kept = "filter(vs, (x, i) -> array_position(ks, ks[i]) = i + 1)"
    return f"transform(array({values}), vs -> transform(array(transform(vs, x -> {key})), ks -> {kept})[0])[0]"


#: Everything but letters, digits and the underscore of ASCII, as blanks.
_PLAIN = bytes(i if chr(i).isalnum() or chr(i) == "_" else 32 for i in range(128)) + b" " * 128


def _plain(text: str) -> str:
    return b" ".join(unicodedata.normalize("NFKD", text.lower()).encode("ascii", "ignore").translate(_PLAIN).split()).decode()


@F.pandas_udf(StringType())
def classifier_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lower case, compatibility decomposition, ASCII alone, punctuation as blanks. Spark has no such decomposition.

    Text by text, as the words of a whole batch weigh many times its texts.
    """
    for some in texts:
        yield some.fillna("").map(_plain)


def half_even(value: Column, digits: int = 4) -> Column:
    return F.bround(value, digits)
