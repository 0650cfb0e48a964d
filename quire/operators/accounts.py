"""Accounts: identities, balances as tables, share tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.mutation import insert_ignore


def resolved(logins: DataFrame, users: DataFrame, identities: DataFrame) -> DataFrame:
    """logins (login, provider, provider_id, email) with ``user_id``: by the users' own provider id, else by a linked identity, else by address; ``by`` tells which."""
    own = users.select(F.col("google_id").alias("own_id"), F.col("user_id").alias("by_own"))
    linked = identities.select(F.col("provider").alias("p"), F.col("provider_id").alias("pid"), F.col("user_id").alias("by_link"))
    mail = users.select(F.lower("email").alias("mail"), F.col("user_id").alias("by_mail"))
    rows = logins.join(own, F.col("provider_id") == F.col("own_id"), "left").join(linked, (F.col("provider") == F.col("p")) & (F.col("provider_id") == F.col("pid")), "left")
    rows = rows.join(mail, F.lower("email") == F.col("mail"), "left")
    how = F.when(F.col("by_own").isNotNull(), "own").when(F.col("by_link").isNotNull(), "identity").when(F.col("by_mail").isNotNull(), "email")
    return rows.select(*logins.columns, F.coalesce("by_own", "by_link", "by_mail").alias("user_id"), how.alias("by"))


def email_born(users: DataFrame) -> DataFrame:
    return users.where(F.col("google_id").startswith("email:"))


def linked_identities(users: DataFrame, identities: DataFrame, provider: str = "google") -> DataFrame:
    """identities (provider, provider_id, user_id) and those of users who were not born by e-mail and have none yet; users without a provider's id have none to link."""
    known = users.where(~F.col("google_id").startswith("email:")).select(F.lit(provider).alias("provider"), F.col("google_id").alias("provider_id"), "user_id")
    return insert_ignore(identities, known, ["provider", "provider_id"])


def shared(books: DataFrame, token: str) -> DataFrame:
    """The book that a token shares."""
    return books.where(F.col("share_token") == token)


def with_token(books: DataFrame, wanted: DataFrame) -> DataFrame:
    """books whose token is set from ``wanted`` (uuid, token) where they have none; a token that is there stays."""
    new = wanted.select(F.col("uuid").alias("u"), F.col("token").alias("new_token"))
    rows = books.join(new, F.col("uuid") == F.col("u"), "left")
    return rows.select(*[F.coalesce("share_token", "new_token").alias(c) if c == "share_token" else F.col(c) for c in books.columns])


def without_token(books: DataFrame, uuids: list[str]) -> DataFrame:
    return books.withColumn("share_token", F.when(~F.col("uuid").isin(uuids), F.col("share_token")))


def without_tokens(books: DataFrame, uuids: DataFrame) -> DataFrame:
    """books whose token is taken away where ``uuids`` (uuid) names them."""
    gone = uuids.select(F.col("uuid").alias("gone")).distinct()
    rows = books.join(gone, F.col("uuid") == F.col("gone"), "left")
    return rows.select(*[F.when(F.col("gone").isNull(), F.col("share_token")).alias(c) if c == "share_token" else F.col(c) for c in books.columns])
