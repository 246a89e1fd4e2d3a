"""The stored model: schemas, upserts by hash, relations, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType, LongType, TimestampType

from webloom.operators.filetypes import FileType
from webloom.session import cut, maybe_broadcast

TABLES = {
    "user": "id int, user string, pass string, fullname string, level int, extra string, deleted boolean",
    "client": "id int, token string",
    "slave": "id int, user string",
    "url": "hash string, url string, date timestamp",
    "added": "id int, user_id int, crawler string, input string, date timestamp",
    "msg": "id int, to int, from int, date timestamp, title string, content string",
    "session": "id int, added_id int, client_id int, date timestamp, latest timestamp, state string, report string",
    "session_rel": "session_id int, filetype string, target_id int",
}
LEVELS = {"none": 0, "read": 1, "write": 2, "manager": 1024, "signals": 2048, "admin": 8192}


def sanitized(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")


def leading_int(text: Column) -> Column:
    """The number that a text begins with; 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def schema_for(filetype: FileType) -> StructType:
    """Columns of a file type's table: id, hash, date and its declared attributes."""
    fields = [StructField("id", LongType()), StructField("url_hash", StringType()), StructField("date", TimestampType())]
    return StructType(fields + [StructField(a.split()[0], StringType()) for a in filetype.attributes])


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns are added and never dropped."""
    return old.unionByName(new, allowMissingColumns=True)


def url_hash(url: Column) -> Column:
    return F.sha1(url)


def upsert(old: DataFrame, new: DataFrame, key: str, date: str = "date") -> DataFrame:
    """One row per key, the one with the latest date; partial aggregation before the shuffle."""
    both = evolve(old, new).where(F.col(key).isNotNull())
    rest = [c for c in both.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(date, *[c for c in rest if c != date])).alias("r"))
    return best.select(*[F.col(key) if c == key else F.col(f"r.{c}") for c in both.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys ``old`` lacks are added, once each."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def with_ids(df: DataFrame, order: str, start: int = 0) -> DataFrame:
    """Consecutive ids in an order; counted per range and offset, so no task sees all rows.

    The ranges are written first, as a plan that is run twice could cut them in two ways.
    """
    ranged = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    ranged = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = ranged.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(maybe_broadcast(sizes.select("_part", "_before"), 16), "_part").withColumn("id", F.col("_in") + F.col("_before") + start).drop("_part", "_in", "_before")


def filenames(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Names to save under: the second of a name gets ``-1`` and so on.

    Counted per range and offset, so a name that most rows have is no burden to one task.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "names")
    sizes = ranged.groupBy(name, "_part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(name).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(name).alias("_name"), F.col("_part").alias("_of"), before.alias("_before"))
    ranged = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part", name).orderBy(*order)) - 1)
    n = F.col("_in") + F.col("_before")
    named = ranged.join(sizes, F.col(name).eqNullSafe(F.col("_name")) & (F.col("_part") == F.col("_of")))
    return named.withColumn("saved_as", F.when(n > 0, F.concat(F.col(name), F.lit("-"), n.cast("string"))).otherwise(F.col(name))).select(*df.columns, "saved_as")


def session_counts(rel: DataFrame, filetypes: list[str]) -> DataFrame:
    """count_<filetype> per session, of targets counted once."""
    once = rel.dropDuplicates(["session_id", "filetype", "target_id"])
    return once.groupBy("session_id").agg(*[F.count_if(F.col("filetype") == t).alias(f"count_{t}") for t in filetypes])


def renewed(added: DataFrame, input_id: int, now: str, days: int = 28) -> DataFrame:
    """The queue after an input was taken: it is due again in ``days`` days."""
    later = F.lit(now).cast("timestamp") + F.make_dt_interval(F.lit(days))
    return added.withColumn("date", F.when(F.col("id") == input_id, later).otherwise(F.col("date")))


def soft_delete(users: DataFrame, user_id: int) -> DataFrame:
    return users.withColumn("deleted", (F.col("id") == user_id) | F.col("deleted"))


def next_id(df: DataFrame) -> int:
    """The id that an auto-increment would give next."""
    return int(df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A base table without rows."""
    return spark.createDataFrame([], TABLES[name])


def inserted(table: DataFrame, **values) -> DataFrame:
    """The table with one row more, with the next id; columns not named are null."""
    row = [(next_id(table), *[values.get(c) for c in table.columns if c != "id"])]
    names = ["id", *[c for c in table.columns if c != "id"]]
    kinds = ", ".join(f"`{c}` {dict(table.dtypes)[c]}" for c in names)
    return table.unionByName(table.sparkSession.createDataFrame(row, kinds))


def with_attributes(rows: DataFrame, filetype: FileType) -> DataFrame:
    """Targets (url, date, attributes) as rows of the file type's table; values of undeclared names go.

    ``INT`` attributes are read as numbers where they are, ``BLOB`` as bytes.
    """
    cols = [url_hash(F.col("url")).alias("url_hash"), F.col("date")]
    for a in filetype.attributes:
        name, _, kind = a.partition(" ")
        value = F.try_element_at("attributes", F.lit(name))
        cast = {"INT": value.try_cast("int"), "BLOB": value.cast("binary")}
        if kind.strip().upper() not in ("", "INT", "TEXT", "BLOB"):
            raise ValueError(f"{kind} is no type of an attribute")
        cols.append(cast.get(kind.strip().upper(), value).alias(name))
    return rows.select(*cols)


def token(seed: Column) -> Column:
    """A client's token: the hash of its address and a seed, of 40 hexadecimal digits."""
    return F.sha1(seed)


def upload(path: str, key: str):
    """A ``foreachBatch`` function that upserts the batches of a stream into a Parquet table.

    Versions are written beside one another and the pointer file is replaced last, so a
    batch that is repeated after a failure gives the same table.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = current(spark, path)
        rows = upsert(old, batch, key) if old is not None else upsert(batch.limit(0), batch, key)
        rows.write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        spark.createDataFrame([(batch_id,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/current")

    return run


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that ``upload`` keeps, None before the first batch."""
    from pyspark.errors import AnalysisException

    try:
        version = spark.read.parquet(f"{path}/current").first()
    except AnalysisException:
        return None
    return spark.read.parquet(f"{path}/v{version.version}") if version else None
