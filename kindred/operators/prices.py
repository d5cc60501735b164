"""Prices of models: the worst in force, else the table's, else the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The margin on prices of a catalogue, and the prices (in, out) of a model that nobody has.
MARGIN, DEFAULT = 1.1, (1.0, 3.0)
MINUTES = 1440


def bands(overrides: DataFrame) -> DataFrame:
    """(model, minute, price_in, price_out): the worst price of the minutes of a day that overrides(model, start, stop,
    price_in, price_out) cover. A band goes from start up to stop, past midnight if stop is not after start; start =
    stop is the whole day. Bands without both prices, or without bounds from 0 to 1439, say nothing."""
    ok = overrides.where(f"price_in IS NOT NULL AND price_out IS NOT NULL AND start BETWEEN 0 AND {MINUTES - 1} AND stop BETWEEN 0 AND {MINUTES - 1}")
    length = F.when(F.col("stop") > F.col("start"), F.col("stop") - F.col("start")).otherwise(F.col("stop") + MINUTES - F.col("start"))
    # equal bands are one before they are laid out, and a model has no more rows than a day has minutes
    ok = ok.groupBy("model", "start", length.alias("length")).agg(F.max("price_in").alias("price_in"), F.max("price_out").alias("price_out"))
    each = ok.withColumn("m", F.explode(F.sequence(F.lit(0), F.col("length") - 1))).withColumn("minute", F.pmod(F.col("start") + F.col("m"), F.lit(MINUTES)))
    return each.groupBy("model", "minute").agg(F.max("price_in").alias("price_in"), F.max("price_out").alias("price_out"))


def _or(parts: list[Column], table: Column, default: float) -> Column:
    return F.coalesce(F.greatest(*parts) * MARGIN, table, F.lit(default))


def base_prices(catalogue: DataFrame) -> DataFrame:
    """The worst of each model's entries that have both prices."""
    return catalogue.where("price_in IS NOT NULL AND price_out IS NOT NULL").groupBy("model").agg(F.max("price_in").alias("b_in"), F.max("price_out").alias("b_out"))


def worst_prices(models: DataFrame, catalogue: DataFrame, overrides: DataFrame, table: DataFrame) -> DataFrame:
    """model, price_in, price_out of the distinct models: the worst of the catalogue and of all bands, whatever the hour
    (a run may last all night), with the margin; else the table's; else DEFAULT. Never null."""
    o = bands(overrides).groupBy("model").agg(F.max("price_in").alias("o_in"), F.max("price_out").alias("o_out"))
    j = models.select("model").distinct().join(base_prices(catalogue).hint("merge"), "model", "left").join(o.hint("merge"), "model", "left").join(table.select("model", "t_in", "t_out").hint("merge"), "model", "left")
    return j.select("model", _or([F.col("b_in"), F.col("o_in")], F.col("t_in"), DEFAULT[0]).alias("price_in"), _or([F.col("b_out"), F.col("o_out")], F.col("t_out"), DEFAULT[1]).alias("price_out"))


def prices_at(calls: DataFrame, catalogue: DataFrame, overrides: DataFrame, table: DataFrame) -> DataFrame:
    """calls(id, model, ts) with price_in and price_out in force at the minute of ts (UTC): the worst of the catalogue
    and of the bands around it, with the margin; else the table's; else DEFAULT. Bands become minutes first, so a
    call joins one row however many bands a model has; a call without a time has the base price."""
    c = calls.select("id", "model", (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))
    o = bands(overrides).withColumnsRenamed({"price_in": "o_in", "price_out": "o_out"})
    j = c.join(o.hint("merge"), ["model", "minute"], "left").join(base_prices(catalogue).hint("merge"), "model", "left").join(table.select("model", "t_in", "t_out").hint("merge"), "model", "left")
    return j.select("id", "model", _or([F.col("b_in"), F.col("o_in")], F.col("t_in"), DEFAULT[0]).alias("price_in"), _or([F.col("b_out"), F.col("o_out")], F.col("t_out"), DEFAULT[1]).alias("price_out"))
