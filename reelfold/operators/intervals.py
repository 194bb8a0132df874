"""Registrations in time: who is active when a message is sent, and how many are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelfold.operators.skew import join_unique

UNIT = 3600  # seconds of the finest time unit
FAN = 16  # units of one level in a unit of the next
LEVELS = 5  # the coarsest unit is 7.5 years long
_BUCKET = 3600  # seconds; running totals are carried from bucket to bucket


def active_periods(registrations: DataFrame) -> DataFrame:
    """``id, ref, registered_at, terminated_at`` with overlapping periods of one (id, ref) made one.

    A null ``terminated_at`` is an open end. Periods that end when or before they start are dropped, and so
    are rows without a start.
    """
    known = registrations.filter(
        F.col("registered_at").isNotNull()
        & (F.col("terminated_at").isNull() | (F.col("terminated_at") > F.col("registered_at")))
    ).select("id", "ref", "registered_at", "terminated_at", F.col("terminated_at").isNull().cast("int").alias("_open"))
    of_one = Window.partitionBy("id", "ref").orderBy("registered_at")
    before = of_one.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("terminated_at").over(before)
    # a new period starts where no earlier one is open or reaches this far
    new = F.coalesce(F.max("_open").over(before), F.lit(0)) == 0
    new = new & (reached.isNull() | (reached < F.col("registered_at")))
    numbered = known.withColumn("_new", new.cast("int")).withColumn(
        "_period", F.sum("_new").over(of_one.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return numbered.groupBy("id", "ref", "_period").agg(
        F.min("registered_at").alias("registered_at"),
        F.when(F.max("_open") == 0, F.max("terminated_at")).alias("terminated_at"),
    ).drop("_period")


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)


def _units(first: Column, after: Column) -> Column:
    """Whole numbers from ``first`` to before ``after``, none where there are none."""
    none = F.array().cast("array<bigint>")
    return F.when(first < after, F.sequence(first, after - 1)).otherwise(none)


def _struct_with(number: Column):
    return lambda unit: F.struct(number, unit.alias("unit"))


def _cover(first: Column, after: Column) -> Column:
    """(level, unit) of the fewest units, coarse ones inside, that cover units ``first`` to before ``after``."""
    pieces = []
    for level in range(LEVELS):
        if level == LEVELS - 1:
            units = _units(first, after)
        else:
            up, down = F.ceil(first / FAN).cast("bigint"), F.floor(after / FAN).cast("bigint")
            inside = up < down
            units = F.when(
                inside, F.concat(_units(first, up * FAN), _units(down * FAN, after))
            ).otherwise(_units(first, after))
            none = F.lit(0).cast("bigint")
            first, after = F.when(inside, up).otherwise(none), F.when(inside, down).otherwise(none)
        number = F.lit(level).alias("level")
        pieces.append(F.transform(units, _struct_with(number)))
    return F.flatten(F.array(*pieces))


def route_at(messages: DataFrame, registrations: DataFrame) -> DataFrame:
    """One delivery per message ``(id, ts, …)`` and consumer registered for its id at that time.

    An equi join on id and time unit: a period is cut into the few units of growing size that cover it, a
    message has one unit of each of ``LEVELS`` sizes, and the two share exactly one where the message is
    inside. So an id's past registrations are not compared with its messages, and AQE can split a hot id.
    The ends, which the finest units overlap, are checked after the join. Open ends reach to the newest
    message. Messages without id or time reach nobody.
    """
    periods = active_periods(registrations)
    newest = messages.agg(F.max("ts").alias("ts"))
    end = F.coalesce(F.col("terminated_at"), F.greatest(newest.scalar(), F.col("registered_at")))
    first = F.floor(_seconds(F.col("registered_at")) / UNIT).cast("bigint")
    after = (F.floor(_seconds(end) / UNIT) + 1).cast("bigint")
    pieces = periods.withColumn("_first", first).withColumn("_after", after).select(
        F.col("id").alias("_id"), "ref", "registered_at", "terminated_at",
        F.explode(_cover(F.col("_first"), F.col("_after"))).alias("_at"),
    )
    unit = F.floor(_seconds(F.col("ts")) / UNIT).cast("bigint")
    steps = F.array(*[
        F.struct(F.lit(n).alias("level"), F.floor(unit / FAN**n).cast("bigint").alias("unit")) for n in range(LEVELS)
    ])
    known = messages.filter(F.col("id").isNotNull() & F.col("ts").isNotNull())
    sent = known.select("*", F.explode(steps).alias("_on"))
    same = (
        (F.col("id") == F.col("_id")) & (F.col("_on.level") == F.col("_at.level"))
        & (F.col("_on.unit") == F.col("_at.unit"))
    )
    inside = (F.col("registered_at") <= F.col("ts")) & (
        F.col("terminated_at").isNull() | (F.col("ts") < F.col("terminated_at"))
    )
    return sent.join(pieces, same & inside).select(*messages.columns, "ref")


def active_counts(times: DataFrame, registrations: DataFrame) -> DataFrame:
    """(ts, recipients): how many different (id, ref) are registered at each time of ``times`` (ts).

    A sweep: starts add one, ends take one away, and the sum up to a time is the number then. Changes of one
    moment are added up first. Sums run within an hour and carry on from the totals of the hours before, a
    row each, so no task sorts the whole history.
    """
    periods = active_periods(registrations)
    change = lambda column, by: periods.select(F.col(column).alias("ts"), F.lit(by).cast("bigint").alias("by"))
    changes = change("registered_at", 1).unionByName(change("terminated_at", -1)).unionByName(
        times.select("ts", F.lit(0).cast("bigint").alias("by"))
    )
    points = changes.filter(F.col("ts").isNotNull()).groupBy("ts").agg(F.sum("by").alias("by"))
    points = points.withColumn("_hour", F.floor(_seconds(F.col("ts")) / _BUCKET).cast("bigint"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    carried = points.groupBy(F.col("_hour").alias("_of")).agg(F.sum("by").alias("_by")).select(
        "_of", F.coalesce(F.sum("_by").over(before), F.lit(0)).alias("_before")
    )
    upto = Window.partitionBy("_hour").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = points.withColumn("_sum", F.sum("by").over(upto))
    return running.join(carried, F.col("_hour") == F.col("_of")).select(
        "ts", (F.col("_sum") + F.col("_before")).alias("recipients")
    )


def recipients_at(notices: DataFrame, registrations: DataFrame) -> DataFrame:
    """``notices`` (ts, …) with the number of consumers registered when each was sent; null without a time."""
    counts = active_counts(notices.select("ts").distinct(), registrations)
    return join_unique(notices, counts, "ts", "left")
