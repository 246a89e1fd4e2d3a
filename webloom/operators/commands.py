"""The commands of the control plane as functions of the stored tables.

Reading commands give a DataFrame, changing ones the new table. Each asks for a level;
transport, sessions of a shell and passwords are no part of it.
"""

from __future__ import annotations

import re
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators import reports, store


class Reply(IntEnum):
    """What a command answers, with its text."""

    OK = 100
    DENIED = 200
    BAD_REQUEST = 201
    NOT_FOUND = 203
    FAILED = 300

    @property
    def text(self) -> str:
        return {100: "OK", 200: "denied", 201: "bad request", 203: "not found", 300: "internal error"}[self.value]


class Refused(Exception):
    """A command that may not or can't be run."""

    def __init__(self, reply: Reply):
        super().__init__(f"{reply.value} {reply.text}")
        self.reply = reply


def need(level: int, least: str) -> None:
    """Refuse a level below the named one."""
    if level < store.LEVELS[least]:
        raise Refused(Reply.DENIED)


def add(added: DataFrame, user_id: int, level: int, text: str, now: str) -> DataFrame:
    """The queue with one input more: ``<crawler> <input>``, due at once."""
    need(level, "write")
    m = re.match(r"\s*(\S{1,64})\s+(.*\S)\s*$", text, re.S)
    if not m:
        raise Refused(Reply.BAD_REQUEST)
    from datetime import datetime

    return store.inserted(added, user_id=user_id, crawler=m[1], input=m[2], date=datetime.fromisoformat(now))


def user_add(users: DataFrame, level: int, name: str, fullname: str, new_level: int, extra: str = "") -> DataFrame:
    """The users with one more; names are unique."""
    need(level, "manager")
    if not name or not users.where(F.col("user") == name).isEmpty():
        raise Refused(Reply.BAD_REQUEST if not name else Reply.FAILED)
    return store.inserted(users, user=name, fullname=fullname, level=new_level, extra=extra, deleted=False)


def user_delete(users: DataFrame, level: int, user_id: int) -> DataFrame:
    need(level, "manager")
    return store.soft_delete(users, user_id)


def list_users(users: DataFrame, level: int, start: int = 0, n: int = reports.MOST) -> DataFrame:
    need(level, "manager")
    return reports.list_users(users, start, n)


def login(users: DataFrame, name: str, digest: str) -> DataFrame:
    """(id, user, level) of the user with this name and stored digest who isn't deleted."""
    return users.where((F.col("user") == name) & (F.col("pass") == digest) & ~F.coalesce("deleted", F.lit(False))).select("id", "user", "level")


def latest_clients(status: DataFrame) -> DataFrame:
    """Of each client (token) the latest report: slave, user, address, status, session_id."""
    rest = [c for c in status.columns if c not in ("token", "date")]
    best = status.groupBy("token").agg(F.max_by(F.struct("date", *rest), F.struct("date", *rest)).alias("r"))
    return best.select("token", "r.*")


def list_clients(status: DataFrame, slave: int) -> DataFrame:
    """The clients of one slave."""
    return latest_clients(status).where(F.col("slave") == slave).select("token", "user", F.pmod("status", F.lit(2)).alias("running"), "address", "session_id")


def client_info(status: DataFrame, level: int, token: str) -> DataFrame:
    """One client with its slave."""
    need(level, "read")
    if len(token) != 40:
        raise Refused(Reply.BAD_REQUEST)
    return latest_clients(status.where(F.col("token") == token)).select("token", "user", "slave", F.pmod("status", F.lit(2)).alias("running"), "address", "session_id")


def slave_info(slaves: DataFrame, status: DataFrame, slave: int) -> DataFrame:
    """Name, address (``0:0`` until it is ready) and clients of a slave."""
    many = latest_clients(status).where(F.col("slave") == slave).agg(F.count("*").alias("clients"))
    address = F.when(F.col("ready"), F.concat_ws(":", "address", "port")).otherwise(F.lit("0:0"))
    return slaves.where(F.col("id") == slave).select("id", F.concat_ws("-", "user", "id").alias("name"), address.alias("address")).crossJoin(F.broadcast(many))


def session_report(sessions: DataFrame, session_id: int) -> DataFrame:
    return sessions.where(F.col("id") == session_id).select("id", "report")


def system_info(sessions: DataFrame, users: DataFrame, slaves: DataFrame, started: str, now: str) -> DataFrame:
    """Seconds since the start and how many slaves, sessions and users there are."""
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.lit(started).cast("timestamp"))
    return reports.system_info(sessions, users).crossJoin(F.broadcast(slaves.agg(F.count("*").alias("slaves")))).select(seconds.alias("uptime"), "slaves", "sessions", "users")


def to_xml(df: DataFrame, row: str, root: str | None = None) -> DataFrame:
    """Rows as XML elements (one column ``xml``), within a root element all in one where asked for.

    The whole list is one row only for reports, which have at most some hundred rows.
    """
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts: list[Column] = [x for c in df.columns for x in (F.lit(f"<{c}>"), escaped(F.col(c)), F.lit(f"</{c}>"))]
    rows = df.select(F.concat(F.lit(f"<{row}>"), *parts, F.lit(f"</{row}>")).alias("xml"))
    if root is None:
        return rows
    return rows.agg(F.concat(F.lit(f"<{root}>"), F.array_join(F.sort_array(F.collect_list("xml")), ""), F.lit(f"</{root}>")).alias("xml"))


def kill_all(spark, group: str) -> None:
    """Cancel the jobs of a group and stop its streams."""
    for query in spark.streams.active:
        if query.name and query.name.startswith(group):
            query.stop()
    spark.sparkContext.cancelJobGroup(group)
