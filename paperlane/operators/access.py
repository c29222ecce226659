"""Users, what they may change and what they may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("user", "admin", "super_admin")
_HIGH = ("admin", "super_admin")
LEAST_PASSWORD = 8


def visible(rows: DataFrame, user_id: int, role: str, owner: str = "user_id") -> DataFrame:
    """Rows that a user may see: all for the two admin roles, else their own. Rows without an owner are for admins."""
    return rows if role in _HIGH else rows.where(F.col(owner) == user_id)


def judged_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (request_id, actor_id, action, target_id, email, name, role, is_active, password) with reason, null for those accepted.

    users has id, email, name, role, is_active. Every request is judged by the users as they are, in this order:
    actor (not an active admin, or not a super admin for delete), role (none of the three), password (create, reset: under 8
    characters), self (delete), target (not found), rank (an admin who makes, changes or promotes admins), own_role (a change of
    it), email (taken, or asked for by an earlier request that is accepted so far), action (none of the four). Created users without role
    become users. Ids of users differ; of requests with one id, each is judged.
    """
    who = users.select(F.col("id").alias("actor_id"), F.col("role").alias("actor_role")).where(F.coalesce(users["is_active"], F.lit(False)))
    whom = users.select(F.col("id").alias("target_id"), F.col("role").alias("target_role"), F.lit(True).alias("found"))
    mail = F.lower(F.trim("email"))
    known = users.select(mail.alias("_mail")).where("_mail is not null").distinct().withColumn("taken", F.lit(True))
    making, changing, deleting, setting = (F.col("action") == a for a in ("create", "update", "delete", "reset"))
    role = F.when(making, F.coalesce("role", F.lit("user"))).otherwise(F.col("role"))
    d = requests.withColumns({"_mail": F.when(making, mail), "role": role}).join(who, "actor_id", "left").join(whom, "target_id", "left").join(known, "_mail", "left")
    plain = F.col("actor_role") == "admin"
    raised = F.coalesce(F.col("role").isin(*_HIGH), F.lit(False)) & (making | changing)
    reason = (
        F.when(F.coalesce(~F.col("actor_role").isin(*_HIGH), F.lit(True)) | (deleting & plain), "actor")
        .when((making | changing) & ~F.col("role").isin(*ROLES), "role")
        .when((making | setting) & (F.length(F.coalesce("password", F.lit(""))) < LEAST_PASSWORD), "password")
        .when(deleting & (F.col("target_id") == F.col("actor_id")), "self")
        .when((changing | deleting | setting) & F.col("found").isNull(), "target")
        .when(plain & (raised | ((changing | setting) & F.col("target_role").isin(*_HIGH))), "rank")
        .when(changing & (F.col("target_id") == F.col("actor_id")) & (F.col("role") != F.col("actor_role")), "own_role")
        .when(making & (F.col("taken") | F.col("_mail").isNull()), "email")
        .when(F.coalesce(~F.col("action").isin("create", "update", "delete", "reset"), F.lit(True)), "action")
    )
    d = d.withColumn("reason", reason)
    # The first for an address: a minimum with partial aggregation, so that a hot address stays no group in one task.
    first = d.where(making & F.col("reason").isNull()).groupBy("_mail").agg(F.min("request_id").alias("first"))
    d = d.join(first, "_mail", "left")
    late = making & F.col("reason").isNull() & (F.col("request_id") != F.col("first"))
    return d.withColumn("reason", F.when(late, "email").otherwise(F.col("reason"))).select(*requests.columns, "reason")


def changed_users(users: DataFrame, judged: DataFrame) -> DataFrame:
    """The users after the accepted requests, in the order of their ids: deleted ones gone, the last given name, role and state of each kept.

    A user deleted by one request and changed by another is gone. New users have no id yet; made_by names the request.
    """
    ok = judged.where("reason is null")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col("action") == "update"), F.col("request_id"))).alias(f"_{c}")
    changes = ok.where("action in ('update', 'delete')").groupBy(F.col("target_id").alias("id")).agg(last("name"), last("role"), last("is_active"), F.max(F.col("action") == "delete").alias("_gone"))
    d = users.join(changes, "id", "left").where("_gone is null or not _gone")
    kept = d.select("id", "email", F.coalesce(F.trim("_name"), "name").alias("name"), F.coalesce("_role", "role").alias("role"), F.coalesce("_is_active", "is_active").alias("is_active"), F.lit(None).cast("long").alias("made_by"))
    made = ok.where("action = 'create'").select(F.lit(None).cast("long").alias("id"), F.lower(F.trim("email")).alias("email"), F.trim("name").alias("name"), F.coalesce("role", F.lit("user")).alias("role"), F.lit(True).alias("is_active"), F.col("request_id").alias("made_by"))
    return kept.unionByName(made)


def checked_keys(presented: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """Presented secrets (any columns, secret) with key_id and owner of the key that each opens, null where none does.

    keys has key_id, user_id, secret_hash, is_active and expires_at; a key opens while active and, at the given time, not expired;
    without expires_at it never expires. Of several keys of one hash the smallest key_id counts. A null secret opens nothing.
    """
    good = keys.where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > at)) & F.col("secret_hash").isNotNull())
    good = good.groupBy(F.col("secret_hash").alias("_hash")).agg(F.min(F.struct("key_id", F.col("user_id").alias("owner"))).alias("_key"))
    d = presented.join(good, F.sha2("secret", 256) == F.col("_hash"), "left")
    return d.select(*[presented[c] for c in presented.columns], "_key.key_id", "_key.owner")
