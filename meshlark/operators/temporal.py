"""Logs of assertions and retractions as intervals of transaction time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replay(log: DataFrame, id_col: str = "assoc_id", kind_col: str = "kind", time_col: str = "occurred_at", order: tuple[str, ...] = (), keep_history: bool = False) -> DataFrame:
    """The interval of each association: ``system_from`` and ``system_to`` (null while open).

    An assertion opens an interval unless one is open; a retraction closes the open one; a
    retraction of nothing is ignored. Of several intervals the last one stays, or all with
    ``keep_history``. Other columns come from the opening assertion.
    """
    by = Window.partitionBy(id_col).orderBy(time_col, *order)
    marked = log.withColumn("_before", F.lag(kind_col).over(by))
    # Only changes of kind matter, and a leading retraction does not.
    changes = marked.filter((F.col(kind_col) != F.col("_before")) | (F.col("_before").isNull() & (F.col(kind_col) == "assert")))
    spans = changes.withColumn("system_to", F.lead(time_col).over(by)).filter(F.col(kind_col) == "assert").withColumnRenamed(time_col, "system_from").drop("_before", kind_col)
    if keep_history:
        return spans
    last = Window.partitionBy(id_col).orderBy(F.col("system_from").desc(), *(F.col(c).desc() for c in order))
    return spans.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def as_of(rows: DataFrame, moment: Column) -> DataFrame:
    """Rows known at a moment: from at or before it, to after it or open."""
    return rows.filter((F.col("system_from") <= moment) & (F.col("system_to").isNull() | (F.col("system_to") > moment)))


def as_of_many(rows: DataFrame, moments: DataFrame, moment_col: str = "moment") -> DataFrame:
    """Number of rows known at each of many moments, by running sums instead of a range join."""
    ups = rows.select(F.col("system_from").alias("_t"), F.lit(1).alias("_d"))
    downs = rows.filter("system_to is not null").select(F.col("system_to").alias("_t"), F.lit(-1).alias("_d"))
    asked = moments.select(F.col(moment_col).alias("_t"), F.lit(0).alias("_d")).distinct()
    steps = ups.unionByName(downs).unionByName(asked).groupBy("_t").agg(F.sum("_d").alias("_d"), F.max((F.col("_d") == 0).cast("int")).alias("_asked"))
    days = steps.withColumn("_day", F.to_date("_t"))
    # Day totals first: only one row a day goes through the window without a key.
    base = days.groupBy("_day").agg(F.sum("_d").alias("_sum")).withColumn("_base", F.sum("_sum").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)))
    inner = days.withColumn("_run", F.sum("_d").over(Window.partitionBy("_day").orderBy("_t")))
    return inner.join(base.select("_day", "_base"), "_day").filter("_asked = 1").select(F.col("_t").alias(moment_col), (F.col("_run") + F.coalesce("_base", F.lit(0))).alias("open_rows"))


def current(rows: DataFrame) -> DataFrame:
    return rows.filter("system_to is null")


def overlapping(rows: DataFrame, keys: list[str], from_col: str = "valid_from", to_col: str = "valid_to", open_only: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose valid interval [from, to) begins before an earlier one with the same keys has ended.

    Rows come by from, to (an open end last), then ``order``: of equal intervals the first
    one is the earlier, so without ``order`` it is open which of them is returned. With ``open_only``, rows that were retracted (system_to is set) neither count nor clash.
    """
    if open_only:
        rows = current(rows)
    earlier = Window.partitionBy(*keys).orderBy(from_col, F.col(to_col).asc_nulls_last(), *order).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.coalesce(F.col(to_col), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))).over(earlier)
    return rows.withColumn("_reach", reach).filter(F.coalesce(F.col("_reach") > F.col(from_col), F.lit(False))).drop("_reach")


#: Seconds of the smallest class of interval lengths; each further class is twice as long.
_LEAST = 3600


def conflicts(rows: DataFrame, keys: list[str], id_col: str, from_col: str = "valid_from", to_col: str = "valid_to") -> DataFrame:
    """All pairs of rows with the same keys whose valid intervals [from, to) share a moment.

    Returns ``keys``, ``first_id`` and ``second_id`` (the one that begins later; of equal
    beginnings the larger id), ``overlap_from`` and ``overlap_to`` (null if both are open).
    An open interval (null ``to``) never ends. Empty and inverted intervals, null beginnings
    and null keys clash with nothing. Ids tell rows apart: rows of one id do not clash.

    Two intervals clash if one begins within the other. An interval of a length class
    covers two or three buckets of that class's width, and a beginning falls into one bucket
    of each class that occurs, so the join is by equal keys and buckets and its candidates
    are near the results; a long interval is never dealt out bucket by bucket. Buckets also
    spread a key that holds many rows.
    """
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    begin, end = F.col("_from"), F.col("_to")
    own = rows.select(*keys, F.col(id_col).alias("_id"), F.col(from_col).alias("_from"), F.col(to_col).alias("_to")).dropna(subset=[*keys, "_id", "_from"]).filter(end.isNull() | (end > begin))
    # Open intervals have a class of their own, with one bucket.
    length = F.greatest(seconds(end) - seconds(begin), F.lit(float(_LEAST)))
    held = own.withColumn("_class", F.when(end.isNull(), -1).otherwise(F.ceil(F.log2(length / _LEAST))).cast("int"))
    classes = sorted(r[0] for r in held.select("_class").distinct().collect())  # some forty at most
    width = lambda c: F.lit(float(_LEAST)) * F.pow(F.lit(2.0), c)
    bucket = lambda at, c: F.when(c < 0, 0).otherwise(F.floor(seconds(at) / width(c))).cast("long")
    covering = held.withColumn("_bucket", F.explode(F.when(F.col("_class") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(bucket(begin, F.col("_class")), bucket(end, F.col("_class"))))))
    points = own.select(*keys, F.col("_id").alias("_id2"), F.col("_from").alias("_from2"), F.col("_to").alias("_to2"), F.explode(F.array(*map(F.lit, classes)) if classes else F.array().cast("array<int>")).alias("_class"))
    points = points.withColumn("_bucket", bucket(F.col("_from2"), F.col("_class")))
    pairs = covering.join(points, [*keys, "_class", "_bucket"]).filter((F.col("_from2") >= begin) & (end.isNull() | (F.col("_from2") < end)))
    pairs = pairs.filter((F.col("_from2") > begin) & (F.col("_id") != F.col("_id2")) | ((F.col("_from2") == begin) & (F.col("_id2") > F.col("_id"))))
    return pairs.select(*keys, F.col("_id").alias("first_id"), F.col("_id2").alias("second_id"), F.col("_from2").alias("overlap_from"), F.least("_to", "_to2").alias("overlap_to"))


def provenance(rows: DataFrame, id_col: str, event_col: str, agent_col: str) -> DataFrame:
    """Triples (subject, relation, object): generated by an event, and what is known of its agent."""
    triple = lambda a, r, b: F.struct(a.cast("string").alias("subject"), F.lit(r).alias("relation"), b.cast("string").alias("object"))
    mine, event, agent = F.col(id_col), F.col(event_col), F.col(agent_col)
    always = F.array(triple(mine, "wasGeneratedBy", event))
    more = F.array(triple(mine, "wasAttributedTo", agent), triple(event, "wasAssociatedWith", agent))
    return rows.select(F.explode(F.when(agent.isNull(), always).otherwise(F.concat(always, more))).alias("t")).select("t.*")
