"""PII pseudonyms by format-preserving Feistel permutations, with SQL functions alone.

Numbers and dates that pass their own validation (Luhn for cards, octets for addresses, area and serial rules for
social security numbers, the calendar for dates) are permuted within their format under a key: the digits of a value
are two halves that take turns to be shifted by a keyed hash of the other (eight rounds, halves of unequal size for odd
lengths). A card stays a valid card, a date a date of the same notation in the same two centuries. As a permutation
of the format's values, equal values get equal pseudonyms in all documents and different values different ones, and
whoever has the key can undo it. Addresses of mail keep their domain; their names are permuted among those of one shape.

Defined cases: null text stays null; text without findings stays as it is; what looks like a number but fails its
validation stays; texts of any length are scanned whole; repeated rows give repeated result rows; the result keeps all
columns and adds ``n_findings``, with underscores behind the name where the input has such a column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31

# The notations that are recognised, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "date": r"(?<![0-9.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ -][0-9]{2,4}){2,4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{13,19})(?![0-9A-Za-z])",
}


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _whole(kind: str) -> str:
    return _sql("^(?:" + re.sub(r"\(\?<!\[[^\]]*\]\)|\(\?![^()]*\)", "", PATTERNS[kind]) + ")$")


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def feistel(digits: str, key: str, kind: str, undo: bool = False) -> str:
    """SQL that permutes a string of two to nineteen digits among those of its length."""
    n, left = "char_length(d)", "CAST(char_length(d) DIV 2 AS INT)"
    width = f"IF(r % 2 = 0, {left}, {n} - {left})"
    turn = "s.a" if undo else "s.b"
    shift = f"pmod(CAST(conv(substring(sha2(concat_ws('|', {_sql(key)}, {_sql(kind)}, {n}, r, {turn}), 256), 1, 14), 16, 10) AS BIGINT), m)"
    # Undone, the rounds run backwards: the half that a round left as it was tells by how much it shifted the other.
    forth = "named_struct('a', s.b, 'b', pmod(s.a + shift, m))"
    back = "named_struct('a', pmod(s.b - shift, m), 'b', s.a)"
    one = _let("m", f"CAST(power(10, {width}) AS BIGINT)", _let("shift", shift, back if undo else forth))
    rounds = f"sequence({ROUNDS - 1}, 0)" if undo else f"sequence(0, {ROUNDS - 1})"
    start = f"named_struct('a', CAST(substring(d, 1, {left}) AS BIGINT), 'b', CAST(substring(d, {left} + 1) AS BIGINT))"
    end = f"concat(lpad(s.a, {left}, '0'), lpad(s.b, {n} - {left}, '0'))"
    return _let("d", digits, f"aggregate({rounds}, {start}, (s, r) -> {one}, s -> {end})")


def luhn_digit(body: str) -> str:
    """SQL for the check digit of a number without it."""
    value = "CAST(substring(b, char_length(b) - i, 1) AS INT)"
    doubled = f"IF(i % 2 = 0, IF({value} > 4, 2 * {value} - 9, 2 * {value}), {value})"
    return _let("b", body, f"pmod(10 - aggregate(sequence(0, char_length(b) - 1), 0, (t, i) -> t + {doubled}) % 10, 10)")


def _refilled(shape: str, digits: str) -> str:
    """The digits of ``digits`` in the places of those of ``shape``."""
    place = "char_length(regexp_replace(substring(shape, 1, i), '[^0-9]', ''))"
    each = f"IF(substring(shape, i, 1) RLIKE '[0-9]', substring(fill, {place}, 1), substring(shape, i, 1))"
    return _let("shape", shape, _let("fill", digits, f"array_join(transform(sequence(1, char_length(shape)), i -> {each}), '')"))


def _card(key: str, undo: bool) -> str:
    body = "substring(n, 1, char_length(n) - 1)"
    moved = _let("body", feistel(body, key, "card", undo), f"concat(body, {luhn_digit('body')})")
    valid = f"{luhn_digit(body)} = CAST(substring(n, -1) AS INT) AND n RLIKE '[1-9]'"
    return _let("n", _digits("v"), f"IF({valid}, {_refilled('v', moved)}, v)")


def _ssn(key: str, undo: bool) -> str:
    valid = "v RLIKE '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'"
    step = f"IF(x RLIKE '^(?!000|666|9)[0-9]{{3}}(?!00)[0-9]{{2}}(?!0000)[0-9]{{4}}$', x, {feistel('x', key, 'ssn', undo)})"
    walk = f"aggregate(sequence(1, 60), {feistel(_digits('v'), key, 'ssn', undo)}, (x, i) -> {step})"
    return f"IF({valid}, {_refilled('v', walk)}, v)"


def _phone(key: str, undo: bool) -> str:
    own = "IF(char_length(n) > 10, 10, char_length(n) - 1)"
    moved = f"concat(substring(n, 1, char_length(n) - {own}), {feistel(f'substring(n, char_length(n) - {own} + 1)', key, 'phone', undo)})"
    return _let("n", _digits("v"), f"IF(char_length(n) BETWEEN 8 AND 15, {_refilled('v', moved)}, v)")


def _ip(key: str, undo: bool) -> str:
    """Two halves of 16 bits each, in the manner of :func:`feistel`."""
    octets = "transform(split(v, '[.]'), o -> CAST(o AS INT))"
    turn = "s.a" if undo else "s.b"
    shift = f"CAST(conv(substring(sha2(concat_ws('|', {_sql(key)}, 'ip', r, {turn}), 256), 1, 4), 16, 10) AS INT)"
    step = f"named_struct('a', s.b ^ {shift}, 'b', s.a)" if undo else f"named_struct('a', s.b, 'b', s.a ^ {shift})"
    rounds = f"sequence({ROUNDS - 1}, 0)" if undo else f"sequence(0, {ROUNDS - 1})"
    text = "concat_ws('.', s.a DIV 256, s.a % 256, s.b DIV 256, s.b % 256)"
    moved = f"aggregate({rounds}, named_struct('a', o[0] * 256 + o[1], 'b', o[2] * 256 + o[3]), (s, r) -> {step}, s -> {text})"
    return _let("o", octets, f"IF(forall(o, x -> x < 256), {moved}, v)")


def _date(key: str, undo: bool) -> str:
    """Days since 1900 as five digits; the permutation is repeated until it falls within the range again."""
    layout = "CASE WHEN substring(v, 5, 1) = '-' THEN 'yyyy-MM-dd' WHEN substring(v, 3, 1) = '.' THEN 'dd.MM.yyyy' ELSE 'dd/MM/yyyy' END"
    iso = "IF(substring(v, 5, 1) = '-', v, concat_ws('-', substring(v, 7, 4), substring(v, 4, 2), substring(v, 1, 2)))"
    day = f"datediff(TRY_CAST({iso} AS DATE), DATE'{FIRST_DAY}')"
    once = lambda x: feistel(x, key, "date", undo)
    walk = f"aggregate(sequence(1, 200), {once("lpad(day, 5, '0')")}, (x, i) -> IF(CAST(x AS INT) < {DAYS}, x, {once('x')}))"
    moved = f"date_format(date_add(DATE'{FIRST_DAY}', CAST({walk} AS INT)), {layout})"
    return _let("day", day, f"IF(day BETWEEN 0 AND {DAYS - 1}, {moved}, v)")


def _email(key: str, undo: bool) -> str:
    """Two halves of a name take turns to have their letters and digits shifted, within their kind, by a hash of the other."""
    turn, moved = ("s.a", "s.b") if undo else ("s.b", "s.a")
    code = f"sha2(concat_ws('|', {_sql(key)}, 'email', domain, r, {turn}), 256)"
    byte = "CAST(conv(substring(code, 2 * (i % 32) + 1, 2), 16, 10) AS INT)"
    sign = "-" if undo else "+"
    kinds = " ".join(f"WHEN c RLIKE '[{first}-{last}]' THEN chr({ord(first)} + pmod(ascii(c) - {ord(first)} {sign} {byte}, {ord(last) - ord(first) + 1}))" for first, last in ("az", "AZ", "09"))
    shifted = _let("code", code, f"array_join(transform(split({moved}, ''), (c, i) -> CASE {kinds} ELSE c END), '')")
    step = f"named_struct('a', {shifted}, 'b', s.a)" if undo else f"named_struct('a', s.b, 'b', {shifted})"
    left = "CAST(char_length(name) DIV 2 AS INT)"
    start = f"named_struct('a', substring(name, 1, {left}), 'b', substring(name, {left} + 1))"
    rounds = f"sequence({ROUNDS - 1}, 0)" if undo else f"sequence(0, {ROUNDS - 1})"
    walk = f"aggregate({rounds}, {start}, (s, r) -> {step}, s -> concat(s.a, s.b, '@', substring_index(v, '@', -1)))"
    return _let("name", "substring_index(v, '@', 1)", _let("domain", "lower(substring_index(v, '@', -1))", walk))


MOVES = {"email": _email, "date": _date, "ssn": _ssn, "phone": _phone, "ip": _ip, "card": _card}
EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def pseudonym(key: str, undo: bool = False) -> str:
    """SQL from a found value ``v`` to its pseudonym, or back; itself if it fails validation."""
    cases = " ".join(f"WHEN v RLIKE {_whole(kind)} THEN {move(key, undo)}" for kind, move in MOVES.items())
    return f"CASE {cases} ELSE v END"


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", undo: bool = False) -> DataFrame:
    """``df`` with the pseudonyms in ``text_col`` and the number of values replaced in ``n_findings``."""
    if not key:
        raise ValueError("an empty key protects nothing")
    text, every = F.col(text_col), F.lit(EVERY)
    maybe = text.rlike("[0-9@]")
    found = F.when(maybe, F.regexp_extract_all(text, every, F.lit(0))).otherwise(F.array().cast("array<string>"))
    found_col, moved_col, count_col = ("_found", "_moved", "n_findings")
    while {found_col, moved_col, count_col} & set(df.columns):
        found_col, moved_col = f"{found_col}_", f"{moved_col}_"
        count_col = f"{count_col}_" if count_col in df.columns else count_col
    rows = df.withColumn(found_col, found).withColumn(moved_col, F.expr(f"transform({found_col}, v -> {pseudonym(key, undo)})"))
    between = F.split(text, EVERY, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, F.concat(moved_col, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    changed: Column = F.size(F.filter(F.zip_with(found_col, moved_col, lambda a, b: a != b), lambda x: x))
    return rows.withColumn(count_col, F.coalesce(changed, F.lit(0))).withColumn(text_col, F.when(F.size(found_col) > 0, joined).otherwise(text)).drop(found_col, moved_col)
