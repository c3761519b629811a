"""Lookups, listings and nested views of a document catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import digest, object_address


def lookup(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Every distinct key with the table's columns and a found flag."""
    return keys.select(key).distinct().join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def exists_flags(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Every distinct key and whether ``table`` has it; only the key is read."""
    return lookup(keys, table.select(key).distinct(), key)


def metadata(keys: DataFrame, registry: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every distinct key with ``columns`` of the registry and a found flag. The payload isn't among them, so it isn't read."""
    return lookup(keys, registry.select(key, *columns), key)


def payloads(keys: DataFrame, table: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(key and payload of the distinct keys that are there, the keys that aren't)."""
    asked = keys.select(key).distinct()
    return asked.join(table.select(key, payload), key), asked.join(table, key, "left_anti")


def optional_parent(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """All rows, with their parent's columns where it is there."""
    return rows.join(parents, key, "left")


def owner_chain(owners: DataFrame, documents: DataFrame, messages: DataFrame, owner: str, of: str, document: str, within: str) -> DataFrame:
    """Each message with its document (``document`` = ``within``) and that one's owner (``owner`` = ``of``)."""
    return owners.join(documents, F.col(owner) == F.col(of)).join(messages, F.col(document) == F.col(within))


def role_gate(rows: DataFrame, column: str, role: str) -> DataFrame:
    return rows.where(F.col(column) == role)


def public_view(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the columns of ``names``, under their public names."""
    return rows.select(*(F.col(own).alias(name) for own, name in names.items()))


def responses(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a JSON object of ``columns``, nulls included; no other column is read."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("response"))


def status_labels(rows: DataFrame, column: str, labels: dict[str, str], ready: str) -> DataFrame:
    """``rows`` with label (null for an unknown status) and may_chat: whether the status is ``ready``."""
    names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return rows.withColumns({"label": names[F.col(column)], "may_chat": F.col(column) == ready})


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``rows`` of a catalog insert: columns that are absent or null take their default."""
    return rows.withColumns({c: F.coalesce(F.col(c), value) if c in rows.columns else value for c, value in defaults.items()})


def owner_listing(rows: DataFrame, owner: str, value: object, at: str, tie: str) -> DataFrame:
    return rows.where(F.col(owner) == F.lit(value)).orderBy(F.desc(at), tie)


def newest_per_owner(rows: DataFrame, owner: str, at: str, tie: str, most: int) -> DataFrame:
    """Each owner's newest rows, ranked. The ranking is limited per owner, so Spark cuts it before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(at), F.col(tie)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def newest_k(rows: DataFrame, at: str, tie: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(at), tie).limit(k)


def nested_children(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Each parent with its children, in order, as JSON text."""
    each = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return rows.groupBy(key).agg(F.to_json(each).alias("children"))


def register_objects(docs: DataFrame, payload: Column, key: Column, prefix: str, at: Column) -> DataFrame:
    """The registry's rows of new objects: address, type unknown, size in bytes, checksum, time."""
    return docs.select(
        object_address(prefix, key).alias("object_address"),
        F.lit(None).cast("string").alias("content_type"),
        F.octet_length(payload).cast("int").alias("content_size_bytes"),
        digest(payload).alias("sha256_checksum"),
        at.alias("created_at"),
    )


def access_reason(tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Why each token's subject is refused, checked in order, or accepted. ``users``: id, is_active; null isn't active."""
    known = users.select(F.col("id").cast("long").alias("user_id"), F.coalesce("is_active", F.lit(False)).alias("active"), F.lit(True).alias("known"))
    asked = tokens.withColumn("user_id", F.col("subject").try_cast("long")).join(known, "user_id", "left")
    reason = F.when(F.col("subject").isNull(), "missing_subject").when(F.col("user_id").isNull(), "invalid_token").when(F.col("known").isNull(), "user_not_found").when(~F.col("active"), "inactive_user").otherwise("accepted")
    return asked.withColumn("reason", reason).drop("known", "active")
