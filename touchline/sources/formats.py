"""Readers and writers of tracking tables and of common providers' formats.

Schemas are fixed: what is read is cast to them, extra columns go, and a
missing column is an error. Everything is partitioned by match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACKING = "match_id string, frame int, timestamp double, entity_id int, class string, team string, jersey_no smallint, x_pixel float, y_pixel float, x float, y float, conf float"
HOMOGRAPHY = "match_id string, frame int, timestamp double, " + ", ".join(f"h{i}{j} double" for i in range(3) for j in range(3)) + ", reproj_error_px double, method string, is_scene_cut boolean"
EVENTS = "match_id string, frame int, timestamp double, type string, team string, from_id int, to_id int, x double, y double, end_x double, end_y double, outcome string"


class MissingData(Exception):
    """A dataset or a column of it is not there."""


def coerced(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns, cast; NaN becomes null; negative frames are left out."""
    wanted = [part.split(" ") for part in schema.split(", ")]
    missing = [name for name, _ in wanted if name not in df.columns]
    if missing:
        raise MissingData(f"columns are missing: {', '.join(missing)}")

    def column(name: str, kind: str):
        value = F.col(name).cast(kind)
        return (F.when(~F.isnan(value), value) if kind in ("float", "double") else value).alias(name)

    return df.select(*(column(*w) for w in wanted)).where("frame >= 0")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def write_table(df: DataFrame, root: str, name: str) -> None:
    """The rows below root/name, one folder a match, in order of frame."""
    df.sortWithinPartitions("match_id", "frame").write.mode("overwrite").partitionBy("match_id").parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    return coerced(spark.read.parquet(f"{root}/{name}"), schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row a match: fps, n_frames, pitch size, maps of names and directions, and extras as JSON text."""
    schema = "match_id string, fps double, n_frames int, pitch_length double, pitch_width double, team_names map<string,string>, kit_colors map<string,string>, attack_direction map<string,int>, source string, extras string"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.withColumns({"pitch_length": F.coalesce("pitch_length", F.lit(105.0)), "pitch_width": F.coalesce("pitch_width", F.lit(68.0))})


def read_wide_csv(spark: SparkSession, path: str, team: str, match_id: str, with_ball: bool = True, fps: float = 25.0) -> DataFrame:
    """Tracking rows of a provider's wide CSV: three header lines, then period, frame, time and an x,y pair a player (0 to 1, y down).

    Ids are the digits of the headings (100 more for the away team); the last pair is the ball.
    """
    lines = spark.read.text(path)
    head = [r["value"].split(",") for r in lines.limit(3).collect()]
    names = [c.strip() for c in head[2]]
    first_label = head[2][0].strip()
    fields = F.split("value", ",")
    players = []
    for at in range(3, len(names), 2):
        label = names[at]
        ball = label.lower() == "ball"
        if ball and not with_ball:
            continue
        digits = "".join(ch for ch in label if ch.isdigit())
        if not ball and not digits:
            continue
        players.append(F.struct(F.lit(-1 if ball else int(digits) + (100 if team == "away" else 0)).alias("entity_id"), F.lit("ball" if ball else "player").alias("class"), F.lit("none" if ball else team).alias("team"), F.get(fields, F.lit(at)).cast("double").alias("u"), F.get(fields, F.lit(at + 1)).cast("double").alias("v")))
    rows = lines.where(F.get(fields, F.lit(1)).rlike("^[0-9]+$") & (F.get(fields, F.lit(0)) != first_label)).select(F.get(fields, F.lit(1)).cast("int").alias("raw"), F.explode(F.array(*players)).alias("p"))
    seen = rows.where("p.u is not null and p.v is not null and not isnan(p.u) and not isnan(p.v)")
    first = seen.agg(F.min("raw").alias("first"))
    placed = seen.join(F.broadcast(first)).withColumn("frame", F.col("raw") - F.col("first"))
    return placed.select(F.lit(match_id).alias("match_id"), "frame", (F.col("frame") / fps).alias("timestamp"), "p.entity_id", "p.class", "p.team", F.when(F.col("p.entity_id") >= 0, (F.col("p.entity_id") % 100).cast("smallint")).alias("jersey_no"), (F.col("p.u") * 105).alias("x"), ((1 - F.col("p.v")) * 68).alias("y"), F.lit(1.0).alias("conf"))


def read_event_json(spark: SparkSession, path: str) -> DataFrame:
    """Flat events of a provider's JSON (pitch 120 x 80, y down), in metres; a pass without outcome is complete."""
    schema = "index int, period int, timestamp string, type struct<name:string>, team struct<name:string>, player struct<id:int,name:string>, location array<double>, pass struct<end_location:array<double>,outcome:struct<name:string>,recipient:struct<id:int>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    x, y = (lambda c: F.get(c, F.lit(0)) / 120 * 105), (lambda c: (80 - F.get(c, F.lit(1))) / 80 * 68)
    passed = F.col("type.name") == "Pass"
    return raw.select("index", "period", "timestamp", F.col("type.name").alias("type"), F.col("team.name").alias("team"), F.col("player.id").alias("player_id"), x("location").alias("x"), y("location").alias("y"), x("pass.end_location").alias("end_x"), y("pass.end_location").alias("end_y"), F.when(passed, F.coalesce("pass.outcome.name", F.lit("Complete"))).alias("outcome"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth boxes of a tracking benchmark's CSV: frames from 0, corners instead of sizes, confidence 1 by default."""
    schema = "frame int, track_id int, left double, top double, width double, height double, conf double"
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    return raw.select((F.col("frame") - 1).alias("frame"), "track_id", F.col("left").alias("x1"), F.col("top").alias("y1"), (F.col("left") + F.col("width")).alias("x2"), (F.col("top") + F.col("height")).alias("y2"), F.coalesce("conf", F.lit(1.0)).alias("conf"))


def read_match_list(spark: SparkSession, path: str) -> DataFrame:
    """(match_id, home, away, score, date) of a provider's JSON list of matches; a match without a score has none."""
    schema = "match_id bigint, match_date string, home_team struct<home_team_name:string>, away_team struct<away_team_name:string>, home_score int, away_score int"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    score = F.concat(F.col("home_score").cast("string"), F.lit("-"), F.col("away_score").cast("string"))
    return raw.select(F.col("match_id").cast("string").alias("match_id"), F.col("home_team.home_team_name").alias("home"), F.col("away_team.away_team_name").alias("away"), score.alias("score"), F.col("match_date").alias("date"))


def read_frame_rate(spark: SparkSession, path: str, default: float = 25.0) -> DataFrame:
    """(path, fps) of sequence descriptions in ini form; ``default`` where the section or the rate is missing."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    section = F.regexp_extract("value", r"(?s)\[Sequence\](.*?)(?:\n\s*\[|$)", 1)
    rate = F.regexp_extract(section, r"(?mi)^\s*frameRate\s*[=:]\s*([0-9]+(?:\.[0-9]+)?)", 1)
    return text.select("path", F.coalesce(F.nullif(rate, F.lit("")).cast("double"), F.lit(default)).alias("fps"))


def read_calibration_samples(spark: SparkSession, folder: str) -> DataFrame:
    """(sample, image, lines): pictures (.jpg) with the labelled lines of the JSON file of the same name, as line to points; pictures without one are left out.

    A folder without pictures is an error when it is read, as for every file source.
    """
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
    pictures = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder).select(stem.alias("sample"), F.col("content").alias("image"))
    marks = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(stem.alias("sample"), F.from_json("value", "map<string,array<struct<x:double,y:double>>>").alias("lines"))
    return pictures.join(marks.where("lines is not null"), "sample")


STATUS = "match_id string, state string, stage string, progress double, message string, updated_at double"


def add_status(rows: DataFrame, path: str) -> None:
    """Appends states of jobs (STATUS) as JSON lines; progress is kept between 0 and 1, to four decimals."""
    progress = F.round(F.least(F.greatest(F.coalesce(F.col("progress"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), 4)
    coerced(rows.withColumn("frame", F.lit(0)), STATUS + ", frame int").drop("frame").withColumn("progress", progress).write.mode("append").json(path)


def latest_status(spark: SparkSession, path: str, matches: DataFrame) -> DataFrame:
    """The last state of each of the matches; 'unknown' where there is none. Lines that are no JSON are passed over; of states of one moment the furthest counts."""
    rows = spark.read.schema(STATUS + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null and match_id is not null").drop("_bad")
    order = Window.partitionBy("match_id").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("progress"), "state", "stage", "message")
    last = rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    default = {"state": F.lit("unknown"), "stage": F.lit(""), "progress": F.lit(0.0), "message": F.lit("")}
    wanted = matches.select(F.col("match_id").cast("string").alias("match_id")).distinct()
    return wanted.join(last, "match_id", "left").withColumns({c: F.coalesce(c, v) for c, v in default.items()})
