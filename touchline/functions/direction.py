"""Direction of attack from a table of matches.

A match has home_sign (1: the home team attacks to the right at first) and
halftime_frame, from which the teams change sides; without a row, or with a
null, home attacks to the right, and a match without halftime keeps its sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches_of(meta: DataFrame) -> DataFrame:
    """(match_id, home_sign, halftime_frame) of match metadata with attack_direction and extras as JSON text."""
    halftime = F.get_json_object("extras", "$.halftime_frame").cast("int")
    return meta.select("match_id", F.coalesce(F.col("attack_direction")["home"], F.lit(1)).alias("home_sign"), halftime.alias("halftime_frame"))


def directed(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """The rows with what ``sign`` reads; one small row a match, which the optimiser broadcasts if it fits."""
    return rows.join(matches.select("match_id", F.col("home_sign").alias("_home_sign"), F.col("halftime_frame").alias("_halftime")), "match_id", "left")


def sign(team: str = "team", frame: str = "frame") -> Column:
    """Direction of attack of ``directed`` rows: 1 to the right, -1 to the left, null without a team."""
    home = F.coalesce(F.col("_home_sign"), F.lit(1))
    base = F.when(F.col(team) == "home", home).when(F.col(team) == "away", -home)
    return F.when(F.col(frame) >= F.col("_halftime"), -base).otherwise(base)
