"""Rules as data: profiles, evaluation by rule type, issues and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions import text as T

RULE_SCHEMA = "document_type string, profile_name string, ord int, name string, rule_type string, field_name string, severity string, message string, pattern string, is_active boolean"
ISSUE = "struct<ord:int,rule_name:string,field_name:string,severity:string,message:string,details:map<string,string>>"
FIELDS = ["has_text", "has_date", "has_signature", *C.SECTIONS]
LISTS = ["date_candidates", "redaction_labels", "detected_sections"]
#: What a profile holds of a rule, the order first.
IN_PROFILE = ("ord", "name", "rule_type", "field_name", "severity", "message", "pattern", "is_active")
#: Field to column.
TEXTS = {"document_text": "text"}


def builtin_rules(spark: SparkSession) -> DataFrame:
    """The rules of the built-in profiles: a table of fixed size."""
    rows = [(t, profile, o, name, "required_field", field, severity, message, None, True) for (t, profile), rules in C.PROFILES.items() for o, name, field, severity, message in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def fields_of(df: DataFrame) -> Column:
    """The fields that rules ask for, as text and by truth; a list is true if it holds something, a text if it is not empty."""
    flags = {f: (F.col(f).cast("boolean"), F.initcap(F.col(f).cast("string"))) for f in FIELDS if f in df.columns}
    lists = {f: (F.size(f) > 0, F.when(F.size(f) > 0, F.concat(F.lit("['"), F.array_join(f, "', '"), F.lit("']"))).otherwise("[]")) for f in LISTS if f in df.columns}
    texts = {name: (F.coalesce(F.col(c), F.lit("")) != "", F.coalesce(c, F.lit(""))) for name, c in TEXTS.items() if c in df.columns}
    every = flags | lists | texts
    return F.create_map(*[x for f, (truth, text) in every.items() for x in (F.lit(f), F.struct(truth.alias("truth"), text.alias("text")))])


def required_field(rule: str, fields: str) -> str:
    own = f"IF({T.blank(f'{rule}.message')}, concat('Brakuje wymaganego elementu: ', {rule}.name), {rule}.message)"
    return f"IF(coalesce({rule}.field_name, '') = '' OR coalesce({fields}[{rule}.field_name].truth, false), NULL, named_struct('message', {own}, 'details', map('expected_field', {rule}.field_name)))"


def regex_match(rule: str, fields: str) -> str:
    value = f"coalesce({fields}[{rule}.field_name].text, '')"
    bad = f"NOT {value} RLIKE concat('(?U)\\\\A(?:', {rule}.pattern, ')\\\\z')"
    text = f"concat('Field \\'', {rule}.field_name, '\\' does not match required pattern')"
    return f"IF(coalesce({rule}.field_name, '') <> '' AND coalesce({rule}.pattern, '') <> '' AND {bad}, named_struct('message', {text}, 'details', map('pattern', {rule}.pattern, 'value', {value})), NULL)"


#: Rule type to the SQL of its evaluation. Others, and date ranges, pass.
RULE_TYPES: dict[str, Callable[[str, str], str]] = {"required_field": required_field, "regex_match": regex_match}


def _in_order(held: DataFrame) -> DataFrame:
    """(document_type, profile_name, total_rules, rules, broken): of all rules, the active ones count.

    Patterns that are no regular expressions are taken out, and ``broken`` names the first.
    """
    bad = T.strings(broken_patterns(held.sparkSession, held.select(F.explode("rules").alias("r")).select("r.pattern")))
    broken = f"filter(rules, r -> r.is_active AND r.rule_type = 'regex_match' AND coalesce(r.field_name, '') <> '' AND array_contains({bad}, r.pattern))"
    active = f"transform(filter(rules, r -> r.is_active), r -> named_struct('ord', r.ord, 'name', r.name, 'rule_type', r.rule_type, 'field_name', r.field_name, 'severity', r.severity, 'message', r.message, 'pattern', IF(array_contains({bad}, r.pattern), NULL, r.pattern), 'is_active', true))"
    return held.select("document_type", "profile_name", F.size("rules").cast("long").alias("total_rules"), F.expr(active).alias("rules"), F.expr(f"concat('not a regular expression: ', get({broken}, 0).pattern)").alias("broken"))


def profiles(rules: DataFrame) -> DataFrame:
    """A row for each document type: its profile, its number of rules, its active rules in order."""
    held = rules.groupBy("document_type").agg(F.max("profile_name").alias("profile_name"), F.sort_array(F.collect_list(F.struct(*IN_PROFILE))).alias("rules"))
    return _in_order(held)


def stored_profiles(stored: DataFrame, rules: DataFrame) -> DataFrame:
    """The newest active profile (profile_id, document_type, name, is_active, created_at) of each type with its own rules.

    rules have the profile_id they belong to; a profile without rules has none and still counts as one.
    """
    newest = newest_profiles(stored).select("profile_id", "document_type", F.col("name").alias("profile_name"))
    own = rules.select("profile_id", F.struct(*IN_PROFILE).alias("_rule"))
    held = newest.join(own, "profile_id", "left").groupBy("profile_id", "document_type", "profile_name").agg(F.sort_array(F.collect_list("_rule")).alias("rules"))
    return _in_order(held)


def created(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New profiles with ``outcome``: a name that is stored, or an earlier new one (smallest id), is a conflict.

    Created ones are active, whatever was asked for.
    """
    first = Window.partitionBy("name").orderBy("profile_id")
    taken = stored.select("name", F.lit(True).alias("_taken")).distinct()
    rows = new.withColumn("_n", F.row_number().over(first)).join(taken, "name", "left")
    rows = rows.withColumn("outcome", F.when(F.col("_taken") | (F.col("_n") > 1), "conflict").otherwise("created"))
    return rows.withColumn("is_active", F.col("outcome") == "created").drop("_n", "_taken")


def listed(stored: DataFrame) -> DataFrame:
    """Profiles by type, the newest first."""
    return stored.orderBy("document_type", F.desc("created_at"), F.desc("profile_id"))


def broken_patterns(spark: SparkSession, rules: DataFrame) -> list[str]:
    """Patterns of rules that are no regular expressions: one of them would fail every job that evaluates the rule.

    To be asked when a profile is stored; rule tables are small, so their patterns go through the driver.
    """
    regex, out = spark._jvm.java.util.regex.Pattern, []
    for row in rules.where("pattern IS NOT NULL").select("pattern").distinct().collect():
        try:
            regex.compile(f"(?U)\\A(?:{row.pattern})\\z")
        except Exception:
            out.append(row.pattern)
    return sorted(out)


def newest_profiles(stored: DataFrame) -> DataFrame:
    """The newest active profile of each type; ties go to the larger id."""
    newest = Window.partitionBy("document_type").orderBy(F.desc("created_at"), F.desc("profile_id"))
    return stored.where("is_active").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def with_fallback(own: DataFrame, builtin: DataFrame) -> DataFrame:
    """Profiles by type: the stored one, else the built-in one."""
    return own.unionByName(builtin.join(own, "document_type", "left_anti"))


def issues(docs: DataFrame, by_type: DataFrame) -> DataFrame:
    """Add profile_name, total_rules and issues: no text first, then rules in order, a missing profile last."""
    cases = " ".join(f"WHEN r.rule_type = {T.quoted(kind)} THEN {make('r', '_fields')}" for kind, make in RULE_TYPES.items())
    found = f"filter(transform(coalesce(rules, array()), r -> transform(array(CASE {cases} END), e -> IF(e IS NULL, CAST(NULL AS {ISSUE}), CAST(named_struct('ord', r.ord, 'rule_name', r.name, 'field_name', r.field_name, 'severity', r.severity, 'message', e.message, 'details', e.details) AS {ISSUE})))[0]), x -> x IS NOT NULL)"

    def fixed(order: int, what: tuple, details: str) -> str:
        name, field, severity, message = map(T.quoted, what)
        return f"array(CAST(named_struct('ord', {order}, 'rule_name', {name}, 'field_name', {field}, 'severity', {severity}, 'message', {message}, 'details', {details}) AS {ISSUE}))"

    none = f"CAST(array() AS ARRAY<{ISSUE}>)"
    first = f"IF(has_text, {none}, {fixed(-1, C.NO_TEXT, "map('expected_field', 'has_text')")})"
    last = f"IF(profile_name IS NULL AND coalesce(total_rules, 0) = 0, {fixed(1 << 30, C.NO_PROFILE, "map('document_type', document_type, 'reason', 'unsupported_document_type')")}, {none})"
    rows = docs.join(F.broadcast(by_type), "document_type", "left").withColumn("_fields", fields_of(docs))
    return rows.withColumn("issues", F.expr(f"concat({first}, {found}, {last})")).withColumn("total_rules", F.coalesce("total_rules", F.lit(0).cast("long"))).drop("_fields", "rules")


def report(rows: DataFrame, clamp: bool = True) -> DataFrame:
    """Add counts by severity, is_complete and the completeness score.

    clamp: a document without text counts as one rule at least and scores do not fall below zero.
    """
    count = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s)).cast("long")
    rows = rows.withColumns({f"{s}_count": count(s) for s in ("error", "warning", "info")})
    total = F.greatest("total_rules", F.when(F.col("has_text"), 0).otherwise(1)) if clamp else F.col("total_rules")
    rest = 1 - F.try_divide(F.col("error_count"), total)
    score = F.when(total == 0, 1.0).otherwise(F.bround(F.greatest(F.lit(0.0), rest) if clamp else rest, 4))
    return rows.withColumn("is_complete", F.col("error_count") == 0).withColumn("completeness_score", score)


def summarised(rows: DataFrame) -> DataFrame:
    """Add ``summary``: what was checked, by which profile, and what was found; of a report's rows."""
    checked = [f for f in FIELDS if f in rows.columns]
    return rows.withColumn("summary", F.struct(
        "document_type",
        F.col("confidence").alias("classification_confidence"),
        "profile_name",
        (F.col("profile_name").isNotNull() | (F.col("total_rules") > 0)).alias("validation_profile_available"),
        "total_rules",
        F.size("issues").cast("long").alias("issues"),
        F.create_map(*[x for f in checked for x in (F.lit(f), F.col(f))]).alias("checked_fields"),
        "detected_sections",
    ))


def upsert(old: DataFrame, new: DataFrame, key: str, newest: str) -> DataFrame:
    """One row for each key, the newest; of equals the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc(newest), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")
