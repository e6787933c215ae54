"""The relational surface: lookups, listings, pages, access, uploads and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T

MAX_BYTES = 20 << 20
EXTENSIONS = ("pdf", "jpg", "jpeg", "png")
#: Content types of files that are redacted at once.
CONTENT_TYPES = ("application/pdf", "image/png", "image/jpeg", "image/jpg")
#: What listings leave out.
DETAILS = ("ocr_raw_result", "extracted_fields")


def by_key(df: DataFrame, **keys) -> DataFrame:
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def one_or_none(df: DataFrame, **keys):
    """The only matching row, or None; more than one is an error."""
    found = by_key(df, **keys).limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"{len(found)} rows for {keys}")
    return found[0] if found else None


def newest_first(df: DataFrame, time: str = "created_at", tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(tie))


def page(ordered: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages start at 1 and hold 1 to 100 rows")
    return ordered.offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 20) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def visible(df: DataFrame, user: int, admin: bool = False, owner: str = "owner_id") -> DataFrame:
    """What a user may see: an administrator everything, others what they own."""
    return df if admin else df.where(F.col(owner) == user)


def visible_children(children: DataFrame, parents: DataFrame, key: str, user: int, admin: bool = False, owner: str = "owner_id") -> DataFrame:
    return children.join(visible(parents, user, admin, owner), key, "left_semi")


def upload_verdict(name: Column, size: Column) -> Column:
    """Size is looked at first, then the extension."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    return F.when(size > MAX_BYTES, "too_large").when(~extension.isin(*EXTENSIONS), "unsupported").otherwise("ok")


def content_type_verdict(content_type: Column) -> Column:
    return F.when(F.lower(F.coalesce(content_type, F.lit(""))).isin(*CONTENT_TYPES), "ok").otherwise("unsupported")


def listing(df: DataFrame) -> DataFrame:
    """The light projection: rows without what only a detail view shows."""
    return df.drop(*DETAILS)


def storage_path(root: str, owner: Column, name: Column) -> Column:
    """Where an upload is kept: one file for each owner and base name, a later one overwrites it."""
    return F.concat_ws("/", F.lit(root), owner.cast("string"), F.regexp_extract(name, r"([^/\\]*)$", 1))


def read_outcome(owner: Column, user: Column, admin: bool = False) -> Column:
    """Of a row by its owner (null: there is no such row): what is not one's own is not found."""
    return F.when(owner.isNull(), "not_found").when(F.lit(admin) | (owner == user), "ok").otherwise("not_found")


def change_outcome(owner: Column, user: Column) -> Column:
    """As :func:`read_outcome`, but changing what is not one's own is forbidden."""
    return F.when(owner.isNull(), "not_found").when(owner == user, "ok").otherwise("forbidden")


def changed(df: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Requests (key, user, document_type, suggested_document_type) with the row they lead to and their outcome.

    A document type is set, and the suggestion then ignored; else a suggestion is; else the row is read as it is.
    """
    asked = requests.select(key, "user", F.col("document_type").alias("_type"), F.col("suggested_document_type").alias("_hint"))
    rows = asked.join(df, key, "left")
    changes = F.col("_type").isNotNull() | F.col("_hint").isNotNull()
    outcome = F.when(changes, change_outcome(F.col("owner_id"), F.col("user"))).otherwise(read_outcome(F.col("owner_id"), F.col("user")))
    fine = F.col("outcome") == "ok"
    rows = rows.withColumn("outcome", outcome)
    hint = F.when(fine & F.col("_type").isNull(), F.coalesce("_hint", "suggested_document_type")).otherwise(F.col("suggested_document_type"))
    return rows.withColumns({"document_type": F.when(fine, F.coalesce("_type", "document_type")).otherwise(F.col("document_type")), "suggested_document_type": hint}).drop("_type", "_hint")


def classify_input(text: str, payload: str) -> Column:
    """The text to classify: the one given, trimmed, else the content of the JSON payload; null if there is none.

    A content of JSON null reads as the word None, and of another type as its text.
    """
    content = f"variant_get(try_parse_json({payload}), '$.content')"
    other = f"CASE WHEN is_variant_null({content}) THEN 'None' ELSE try_variant_get(try_parse_json({payload}), '$.content', 'STRING') END"
    return F.expr(f"coalesce(nullif({T.strip(f'coalesce({text}, {T.quoted(str())})')}, ''), nullif({T.strip(other)}, ''))")


def coerced(value: Column, allowed: list[str], default: str = "unknown") -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def updated(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A new version of ``df`` with the non-null values of ``changes``, a row for each key at most."""
    new = [c for c in changes.columns if c != key]
    both = df.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in new]), key, "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in new else F.col(c) for c in df.columns])


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone, key, "left_anti")


def cascade_delete(gone: DataFrame, chain: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Delete down a chain of (table, its key, its key into the table above); ``gone``: the first table's keys."""
    out = []
    for k, (df, key, parent) in enumerate(chain):
        hit = df.select(F.col(key).alias("_key"), F.col(parent).alias("_parent")) if k else df.select(F.col(key).alias("_key"), F.col(key).alias("_parent"))
        gone = hit.join(gone.toDF("_parent"), "_parent", "left_semi").select("_key")
        out.append(df.join(gone.withColumnRenamed("_key", key), key, "left_anti"))
    return out


def severities(errors: str) -> Column:
    """How many errors are critical, high and medium; none counts as medium, other words do not count."""
    each = ", ".join(f"'{s}', size(filter(coalesce({errors}, array()), e -> coalesce(e.severity, 'medium') = '{s}'))" for s in ("critical", "high", "medium"))
    return F.expr(f"map({each})")


def progress(step: Column) -> Column:
    return F.least(F.floor(step / 4 * 100), F.lit(100)).cast("int")
