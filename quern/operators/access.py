"""Audit logs, roles and sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.security import verify_password


def logs(rows: DataFrame, user: object = None, start: str | None = None, end: str | None = None, user_col: str = "user_id", ts: str = "ts") -> DataFrame:
    """Rows of a user (None: all) within a time range, both ends included (None: open)."""
    tests: list[Column] = []
    if user is not None:
        tests.append(F.col(user_col) == F.lit(user))
    if start is not None:
        tests.append(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        tests.append(F.col(ts) <= F.lit(end).cast("timestamp"))
    return rows.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def search_logs(rows: DataFrame, text: str, fields: tuple[str, ...] = ("action", "resource", "result")) -> DataFrame:
    return rows.filter(reduce(lambda a, b: a | b, [F.col(f).contains(text) for f in fields]))


def failed_logins(rows: DataFrame, action: str = "action", result: str = "result") -> DataFrame:
    return rows.filter((F.col(action) == "LOGIN") & (F.col(result) == "FAILED"))


def purge(rows: DataFrame, before: str, ts: str = "ts") -> DataFrame:
    return rows.filter(F.col(ts) >= F.lit(before).cast("timestamp"))


def permitted(requests: DataFrame, user_roles: DataFrame, permissions: DataFrame) -> DataFrame:
    """Requests (user_id, resource, type) that a role of the user permits; resource and type must be equal."""
    granted = user_roles.join(permissions, "role_id").select("user_id", "resource", "type").distinct()
    return requests.join(granted, ["user_id", "resource", "type"], "left_semi")


def create(table: DataFrame, new: DataFrame, id: str) -> DataFrame:
    """Users or roles with the new ones; a name that is taken, or given twice, keeps its first row."""
    return table.unionByName(new.join(table.select(id), id, "left_anti").dropDuplicates([id]).select(*table.columns))


def update(table: DataFrame, changes: DataFrame, id: str) -> DataFrame:
    """Users or roles with their changed rows; changes of names that there are not are passed over."""
    known = changes.join(table.select(id), id, "left_semi")
    return table.join(known.select(id), id, "left_anti").unionByName(known.select(*table.columns))


def remove(table: DataFrame, gone: DataFrame, id: str) -> DataFrame:
    return table.join(gone.select(id), id, "left_anti")


def authenticate(logins: DataFrame, users: DataFrame, ts: str = "ts", hours: int = 1) -> DataFrame:
    """Logins (username, password, ts) with the session that they open: user_id and expires_at, or nulls.

    users: username, user_id, password_hash, salt, active, locked. No one gets in who is unknown, inactive or locked
    out, or whose password is another.
    """
    names = ["username", "user_id", "password_hash", "salt", "active", "locked"]
    found = logins.join(users.select(*names), "username", "left")
    ok = F.col("active") & ~F.col("locked") & verify_password(F.col("password"), F.col("salt"), F.col("password_hash"))
    end = F.col(ts) + F.expr(f"INTERVAL {hours} HOUR")
    out = found.withColumns({"user_id": F.when(ok, F.col("user_id")), "expires_at": F.when(ok, end)})
    return out.drop("password", "password_hash", "salt", "active", "locked")


def sessions(logins: DataFrame, now: str, hours: int = 1, ts: str = "ts") -> DataFrame:
    """Each login with the end of its session and whether that is not before ``now``."""
    end = F.col(ts) + F.expr(f"INTERVAL {hours} HOUR")
    return logins.withColumn("expires_at", end).withColumn("valid", F.col("expires_at") >= F.lit(now).cast("timestamp"))
