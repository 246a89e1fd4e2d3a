"""Admin reports over the stored model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 100


def session_info(sessions: DataFrame, clients: DataFrame, added: DataFrame, session_id: int) -> DataFrame:
    """One session with its client's token and input; the filter comes before the joins."""
    return _joined(sessions.where(F.col("id") == session_id), clients, added)


def list_sessions(sessions: DataFrame, clients: DataFrame, added: DataFrame, start: int = 0, n: int = MOST) -> DataFrame:
    """A page of the latest sessions; sorted and cut before the joins, which keep all rows."""
    return _joined(sessions.orderBy(F.desc("latest"), F.desc("id")).offset(start).limit(min(n, MOST)), clients, added)


def _joined(sessions: DataFrame, clients: DataFrame, added: DataFrame) -> DataFrame:
    c = clients.select(F.col("id").alias("client_id"), "token")
    a = added.select(F.col("id").alias("added_id"), "crawler", "input")
    counts = [x for x in sessions.columns if x.startswith("count_")]
    return sessions.join(c, "client_id", "left").join(a, "added_id", "left").select("id", "client_id", "token", "added_id", "crawler", "input", "date", "latest", "state", *counts)


def list_input(added: DataFrame, sessions: DataFrame, user_id: int, n: int = 1000) -> DataFrame:
    """A user's inputs with their sessions, latest inputs first."""
    s = sessions.select(F.col("added_id").alias("_added"), F.col("id").alias("session_id"), "state")
    rows = added.where(F.col("user_id") == user_id)
    rows = rows.join(s, rows["id"] == s["_added"], "left").select("id", "crawler", "input", "date", "session_id", "state")
    return rows.orderBy(F.desc("id"), F.desc("session_id")).limit(n)


def list_users(users: DataFrame, start: int = 0, n: int = MOST) -> DataFrame:
    return users.where(~F.col("deleted")).orderBy(F.desc("id")).offset(start).limit(min(n, MOST)).select("id", "user", "level")


def system_info(sessions: DataFrame, users: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("sessions")).crossJoin(users.agg(F.count("*").alias("users")))


def next_due(added: DataFrame, now: str) -> DataFrame:
    """The latest input that is due."""
    return added.where(F.col("date") <= F.lit(now).cast("timestamp")).orderBy(F.desc("date"), F.desc("id")).limit(1)


def least_loaded(clients: DataFrame, key: str) -> DataFrame:
    """The one with the fewest clients; ties go to the smaller id."""
    n = clients.groupBy(key).agg(F.count("*").alias("clients"))
    return n.agg(F.min_by(F.col(key), F.struct("clients", key)).alias(key), F.min("clients").alias("clients"))


def session_state(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The latest state of each session and how many events it had."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("events"))
