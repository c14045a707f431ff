"""Which bulletin holds an article number: ranges, and the neighbours of what lies between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Splits that a line of numbers is cut into, at most, and rows that make a split worth it.
SPLITS, ROWS = 1024, 64


def split_points(rows: DataFrame, column: str, most: int = SPLITS) -> list:
    """Up to ``most - 1`` numbers that cut the column's values into splits of about equally many rows.

    They are quantiles (``percentile_approx``), so neither a far outlier nor a
    crowd in one place makes a split of its own or an empty one; a value that
    repeats is one point.
    """
    steps = [k / most for k in range(1, most)]
    told = rows.agg(F.percentile_approx(column, steps, 10 * most).alias("q"), F.count(column).alias("n")).first()
    points = sorted(set(told["q"] or []))
    wanted = max(0, min(len(points), told["n"] // ROWS))
    # of fewer rows fewer points, evenly taken
    return [points[k * len(points) // wanted] for k in range(wanted)] if wanted else []


def split_of(value: Column, points: list) -> Column:
    """In which split a value is: how many points are at or below it, by binary search."""
    if not points:
        return F.lit(0)
    known = F.array(*map(F.lit, points))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(points).bit_length()))))
    # the value goes along in the state: the optimizer overlooks columns that only a lambda looks at
    begun = F.struct(value.alias("value"), F.lit(0).alias("at"))
    further = lambda s, step: F.when(F.coalesce(F.get(known, s["at"] + step - 1) <= s["value"], F.lit(False)), s["at"] + step).otherwise(s["at"])
    return F.aggregate(steps, begun, lambda s, step: F.struct(s["value"].alias("value"), further(s, step).alias("at")), lambda s: s["at"])


def spans(listed: DataFrame, group: str = "bulletin", number: str = "number") -> DataFrame:
    return listed.groupBy(group).agg(F.min(number).alias("lo"), F.max(number).alias("hi"))


def _further(a, b):
    return max((x for x in (a, b) if x is not None), default=None)


def locate(targets: DataFrame, ranges: DataFrame, number: str = "number", group: str = "bulletin") -> DataFrame:
    """Per target: the range that holds it, else the nearest ranges below and above (null where there is none).

    Ranges may overlap: of several that hold a target, the one that reaches
    furthest has it (of several such, the one of the greatest number); below is
    the greatest number among the ranges that end before the target, above the
    least among those that begin behind it.  A target that is null has no row.

    No target is compared with every range.  Of the ranges that begin at or
    before a target the furthest end says whether one holds it, and if none does
    all of them end before it; so three running values over the order of numbers
    are enough.  Starts and asked numbers stand on one line, each number once of
    a kind, however many rows have it.  The line is cut at quantiles, so splits
    are of one size wherever the numbers crowd; what a split inherits is one row
    a split, SPLITS at most, which the driver sums up.  No row is copied.
    """
    spark = targets.sparkSession
    kind, value = ranges.schema[group].dataType.simpleString(), targets.schema[number].dataType.simpleString()
    # where nothing but the furthest, greatest and least matter, ranges of one start are one row, and a number that many rows ask for is asked once
    reach = F.struct(F.col("hi").cast("bigint").alias("hi"), F.col(group).alias("g"))
    starts = ranges.where("lo is not null").groupBy(F.col("lo").alias("at")).agg(F.max(reach).alias("far"), F.max(group).alias("top"), F.min(group).alias("low"), F.lit(0).cast("long").alias("n"))
    asks = targets.groupBy(F.col(number).alias("at")).agg(F.count("*").alias("n")).where("at is not null")
    line = starts.unionByName(asks, allowMissingColumns=True)
    points = split_points(line, "at")
    line = line.withColumn("split", split_of(F.col("at"), points))
    held = {r["split"]: r for r in line.groupBy("split").agg(F.max("far").alias("far"), F.max("top").alias("top"), F.min("low").alias("low")).collect()}
    before, behind = {}, {}
    far = top = low = None
    for k in sorted(held):
        before[k] = (far, top)
        far, top = _further(far, held[k]["far"] and tuple(held[k]["far"])), _further(top, held[k]["top"])
    for k in sorted(held, reverse=True):
        behind[k] = low
        low = min((x for x in (low, held[k]["low"]) if x is not None), default=None)
    inherited = F.broadcast(spark.createDataFrame([(k, *before[k], behind[k]) for k in held], f"split int, far struct<hi:bigint,g:{kind}>, top {kind}, low {kind}"))
    order = Window.partitionBy("split").orderBy("at", "n")
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    seen = line.select("split", "at", "n", F.max("far").over(upto).alias("near_far"), F.max("top").over(upto).alias("near_top"), F.min("low").over(after).alias("near_low"))
    out = seen.where("n > 0").join(inherited, "split").select("at", "n", F.greatest("near_far", "far").alias("far"), F.greatest("near_top", "top").alias("top"), F.least("near_low", "low").alias("low"))
    free = F.coalesce(F.col("far.hi") < F.col("at"), F.lit(True))
    found = out.select(F.col("at").cast(value).alias(number), "n", F.when(~free, F.col("far.g")).alias("holder"), F.when(free, F.col("top")).alias("below"), F.when(free, F.col("low")).alias("above"))
    return found.select(number, "holder", "below", "above", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")


def candidates(located: DataFrame, unlisted: DataFrame, number: str = "number", most: int | None = None) -> DataFrame:
    """What to try for each number, in order (``turn`` from 1): its holder; else bulletins between the neighbours that list nothing, then the lower, then the upper neighbour.

    ``unlisted``: bulletin numbers that list no article.  Numbers between the
    same two neighbours are one gap; gaps and unlisted bulletins meet by splits
    of the bulletins' numbers, so each is compared only with what is near.
    ``most``: the tries that a gap is given (``attempts_allowed``); what is left
    is counted in ``untried``.
    """
    loose = located.where("holder is null")
    gaps = loose.select("below", "above").distinct()
    empty = unlisted.select(F.col("bulletin").alias("b")).distinct()
    points = split_points(empty, "b")
    place = lambda b: split_of(b, points)
    near = F.sequence(F.when(F.col("below").isNull(), F.lit(0)).otherwise(place(F.col("below"))), F.when(F.col("above").isNull(), F.lit(len(points))).otherwise(place(F.col("above"))))
    wide = gaps.where("below is null or above is null or below < above").withColumn("split", F.explode(near))
    met = wide.join(empty.withColumn("split", place(F.col("b"))), "split").where((F.col("below").isNull() | (F.col("b") > F.col("below"))) & (F.col("above").isNull() | (F.col("b") < F.col("above"))))
    tries = met.select("below", "above", "b", F.lit(1).alias("grade"))
    for grade, side in ((2, "below"), (3, "above")):
        tries = tries.unionByName(gaps.where(F.col(side).isNotNull()).select("below", "above", F.col(side).alias("b"), F.lit(grade).alias("grade")))
    of_gap = Window.partitionBy("below", "above")
    tries = tries.withColumn("turn", F.row_number().over(of_gap.orderBy("grade", "b"))).withColumn("untried", F.greatest(F.count("*").over(of_gap) - (most if most is not None else 1 << 31), F.lit(0)))
    if most is not None:
        tries = tries.where(F.col("turn") <= most)
    found = loose.join(tries.withColumnRenamed("below", "lower").withColumnRenamed("above", "upper"), F.col("below").eqNullSafe(F.col("lower")) & F.col("above").eqNullSafe(F.col("upper")))
    holder = located.where("holder is not null").select(number, F.col("holder").alias("bulletin"), F.lit(1).alias("turn"), F.lit(0).cast("long").alias("untried"))
    return holder.unionByName(found.select(number, F.col("b").alias("bulletin"), "turn", "untried"))


def attempts_allowed(max_errors: int) -> int:
    """Wrong guesses that the error budget leaves room for: one or two."""
    return max(1, min(2, max_errors - 1))


def with_shortcuts(tries: DataFrame, shortcuts: DataFrame, number: str = "number", most: int | None = None) -> DataFrame:
    """(number, bulletin, turn, untried): shortcuts first, in their order, then the tries; none twice, ``most`` in all.

    shortcuts: number, bulletin, rank (0: the index, 1: the resolver).
    """
    every = shortcuts.select(number, "bulletin", F.lit(0).alias("grade"), F.col("rank").alias("turn"), F.lit(0).cast("long").alias("untried")).unionByName(tries.select(number, "bulletin", F.lit(1).alias("grade"), "turn", "untried"))
    once = every.withColumn("k", F.row_number().over(Window.partitionBy(number, "bulletin").orderBy("grade", "turn"))).where("k = 1").drop("k")
    own = Window.partitionBy(number)
    ranked = once.withColumn("place", F.row_number().over(own.orderBy("grade", "turn"))).withColumn("left", F.max("untried").over(own) + F.greatest(F.count("*").over(own) - (most if most is not None else 1 << 31), F.lit(0)))
    return ranked.where(F.lit(True) if most is None else F.col("place") <= most).select(number, "bulletin", F.col("place").alias("turn"), F.col("left").alias("untried"))


def verified(tries: DataFrame, pages: DataFrame, number: str = "number") -> DataFrame:
    """(number, bulletin, turn): the first try whose page shows the very article; pages: bulletin, asked (the number its address has), shows (the number on it)."""
    shown = pages.where(F.col("asked") == F.col("shows")).select("bulletin", F.col("asked").alias(number)).distinct()
    good = tries.join(shown, ["bulletin", number])
    return good.groupBy(number).agg(F.min_by("bulletin", "turn").alias("bulletin"), F.min("turn").alias("turn"))
