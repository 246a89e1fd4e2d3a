"""Control-plane tables, which the data lack, derived from tables that they have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import table

NOW = "1997-01-01 00:00:00"
STATES = "case event_type when 'error' then 'interrupted' when 'signup' then 'hook' when 'purchase' then 'done' else 'running' end"


def users(s: SparkSession, d: str) -> DataFrame:
    level = "case c_mktsegment when 'AUTOMOBILE' then 1 when 'BUILDING' then 2 when 'FURNITURE' then 1024 else 0 end"
    return table(s, d, "customer").selectExpr("c_custkey as id", "c_name as user", f"cast({level} as int) as level", "c_acctbal < 0 as deleted")


def added(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").selectExpr("o_orderkey as id", "o_custkey as user_id", "o_orderpriority as crawler", "o_orderstatus as input", "o_orderdate as date")


def clients(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").selectExpr("s_suppkey as id", "sha1(s_name) as token")


def sessions(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "orders").agg(F.count("*").alias("n"))
    rows = table(s, d, "events").crossJoin(F.broadcast(n))
    return rows.selectExpr("event_id as id", "event_id % n as added_id", "user_id as client_id", "ts as date", "timestampadd(second, cast(floor(value) as int), ts) as latest", f"{STATES} as state")


def status(s: SparkSession, d: str) -> DataFrame:
    """What clients told their slaves, again and again."""
    return table(s, d, "events").selectExpr("sha1(cast(user_id as string)) as token", "ts as date", "cast(user_id % 25 as int) as slave", "concat('u', user_id % 7) as user", "cast(event_id % 4 as int) as status", "concat('10.0.0.', event_id % 250) as address", "event_id as session_id")


def slaves(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").selectExpr("n_nationkey as id", "n_name as user", "n_nationkey % 3 > 0 as ready", "concat('10.1.0.', n_nationkey) as address", "5000 + n_nationkey as port")


SQL = f"""
nol_user as (select c_custkey as id, c_name as "user", case c_mktsegment when 'AUTOMOBILE' then 1 when 'BUILDING' then 2 when 'FURNITURE' then 1024 else 0 end::integer as level, c_acctbal < 0 as deleted from customer),
nol_added as (select o_orderkey as id, o_custkey as user_id, o_orderpriority as crawler, o_orderstatus as input, o_orderdate as date from orders),
nol_client as (select s_suppkey as id, sha1(s_name) as token from supplier),
nol_session as (select event_id as id, event_id % (select count(*) from orders) as added_id, user_id as client_id, ts as date, ts + to_seconds(floor(value)::bigint) as latest, {STATES} as state from events),
nol_status as (select sha1(user_id::varchar) as token, ts as date, (user_id % 25)::integer as slave, 'u' || (user_id % 7) as "user", (event_id % 4)::integer as status, '10.0.0.' || (event_id % 250) as address, event_id as session_id from events),
nol_latest as (select * from nol_status qualify row_number() over (partition by token order by date desc, slave desc, "user" desc, status desc, address desc, session_id desc) = 1)
"""
