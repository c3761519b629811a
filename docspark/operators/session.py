"""Expiring single-use tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampType


def valid_at(revoked: Column, expires_at: Column, now: Column) -> Column:
    return ~F.coalesce(revoked, F.lit(True)) & (expires_at > now)


def single_use(attempts: DataFrame, token: str, at: str, tie: str, revoked: str, expires_at: str) -> DataFrame:
    """``attempts`` with won: the first attempt of a token that is valid at its time; nobody else wins.

    (``at``, ``tie``) is unique for a token. The first attempt is found by ``min``, which is combined before the shuffle.
    """
    good = F.coalesce(valid_at(F.col(revoked), F.col(expires_at), F.col(at)), F.lit(False))
    order = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"))
    first = attempts.where(good & F.col(token).isNotNull()).groupBy(token).agg(F.min(order).alias("__first"))
    return attempts.join(first, token, "left").withColumn("won", F.coalesce(good & (order == F.col("__first")), F.lit(False))).select(*attempts.columns, "won")


def consume(tokens: DataFrame, attempts: DataFrame, token: str, at: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """(the next state of ``tokens``, the attempts that won). ``tokens``: token, revoked, expires_at; winners revoke their token."""
    judged = single_use(attempts.join(tokens.select(token, "revoked", "expires_at"), token), token, at, tie, "revoked", "expires_at")
    won = judged.where("won").drop("won")
    hit = tokens.join(won.select(token, F.lit(True).alias("__hit")), token, "left")
    after = hit.withColumn("revoked", F.when(F.col("__hit"), F.lit(True)).otherwise(F.col("revoked")))
    return after.select(tokens.columns), won


def rotated(tokens: DataFrame, attempts: DataFrame, token: str, at: str, tie: str, days: int = 30) -> DataFrame:
    """The next state of ``tokens``: used ones are revoked, and each winner has a new one."""
    after, won = consume(tokens, attempts, token, at, tie)
    new = rotate(won.withColumn("won", F.lit(True)), token, at, days).withColumnRenamed("token", token).withColumn("revoked", F.lit(False))
    return after.unionByName(new, allowMissingColumns=True)


def revoke_valid(tokens: DataFrame, keys: DataFrame, token: str, now: Column) -> DataFrame:
    """The next state of ``tokens`` (revoked, expires_at): those in ``keys`` are revoked if they are valid now, all else stays."""
    hit = tokens.join(keys.select(token).distinct().withColumn("__hit", F.lit(True)), token, "left")
    good = F.col("__hit") & valid_at(F.col("revoked"), F.col("expires_at"), now)
    return hit.withColumn("revoked", F.when(good, F.lit(True)).otherwise(F.col("revoked"))).select(tokens.columns)


def _instant(rows: DataFrame, at: str) -> Column:
    """A time as text that doesn't depend on the session's time zone: in UTC, or as it is if it has no zone."""
    zoned = rows.schema[at].dataType == TimestampType()
    return (F.convert_timezone(None, F.lit("UTC"), F.col(at)) if zoned else F.col(at)).cast("string")


def issue(users: DataFrame, user: str, secret: Column, now: Column, days: int = 30) -> DataFrame:
    """New rows (user_id, token, expires_at, revoked) of a token table: the digest of each raw ``secret``, valid for ``days``.

    The raw secret isn't kept. Rows without a user or a secret get no token.
    """
    rows = users.where(F.col(user).isNotNull() & secret.isNotNull())
    return rows.select(F.col(user).alias("user_id"), F.sha2(secret, 256).alias("token"), (now + F.make_dt_interval(F.lit(days))).alias("expires_at"), F.lit(False).alias("revoked"))


def rotate(attempts: DataFrame, token: str, at: str, days: int = 30) -> DataFrame:
    """The new tokens of attempts that won: the digest of the old one and the time names the next."""
    won = attempts.where("won")
    return won.select(F.sha2(F.concat_ws("|", F.col(token), _instant(attempts, at)), 256).alias("token"), (F.col(at) + F.make_dt_interval(F.lit(days))).alias("expires_at"))
