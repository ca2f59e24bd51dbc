"""US federal holidays on the days they are observed, from date functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values. (name, month, day, first year): a Saturday's holiday is kept on the Friday before, a Sunday's on the Monday after.
BY_DATE = (("New Year", 1, 1, None), ("Juneteenth", 6, 19, 2021), ("Independence", 7, 4, None), ("Veterans", 11, 11, None), ("Christmas", 12, 25, None))
# (name, month, weekday, which one, first year)
BY_WEEKDAY = (("King", 1, "MON", 3, 1986), ("Washington", 2, "MON", 3, None), ("Labor", 9, "MON", 1, None), ("Columbus", 10, "MON", 2, None), ("Thanksgiving", 11, "THU", 4, None))


def _observed(day: Column) -> Column:
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def holiday_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """holiday_date, name: observed holidays of the years given and of those beside them (New Year may fall in the year before)."""
    y = F.col("y").cast("int")

    def since(year: int | None, day: Column) -> Column:
        return day if year is None else F.when(y >= year, day)

    rules = [F.struct(F.lit(n).alias("name"), since(first, _observed(F.make_date(y, F.lit(m), F.lit(d)))).alias("holiday_date")) for n, m, d, first in BY_DATE]
    rules += [F.struct(F.lit(n).alias("name"), since(first, F.date_add(F.next_day(F.date_sub(F.make_date(y, F.lit(m), F.lit(1)), 1), w), 7 * (k - 1))).alias("holiday_date")) for n, m, w, k, first in BY_WEEKDAY]
    rules.append(F.struct(F.lit("Memorial").alias("name"), F.next_day(F.date_sub(F.last_day(F.make_date(y, F.lit(5), F.lit(1))), 7), "MON").alias("holiday_date")))
    years = spark.range(first_year - 1, last_year + 2).withColumnRenamed("id", "y")
    return years.select(F.explode(F.array(*rules)).alias("h")).select("h.holiday_date", "h.name").filter("holiday_date is not null")
