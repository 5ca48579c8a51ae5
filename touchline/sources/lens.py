"""A match derived from the given tables, so that every operator has input that grows with them.

Every order is a frame, the parts 1..22 are the players, and triangle waves
over integers move them inside the pitch. A block of 40 frames has a holder;
in its last ten frames the ball goes on to the next. 6000 frames are a match.
Every 97th observation or so is missing, and players 1 and 12 keep goal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = 6000
#: Frames that a task gets, about, so that what it sorts stays in memory however many matches there are.
TASK_FRAMES = 8 * FRAMES
#: The session's setting that holds the number of tasks that matches are dealt to.
TASKS = "spark.touchline.matchTasks"
HALF, EARLY_HALF = 3000, 2400
BALL = -1


def _x(f, sx, ph):
    return F.abs((f * sx + ph) % 21000 - 10500)


def _y(f, sy, ph):
    return F.abs((f * sy + 5 * ph) % 13600 - 6800)


def _players(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey between 1 and 22")
    return part.select(
        F.col("p_partkey").cast("int").alias("entity_id"),
        (5 + F.col("p_size") % 20).cast("long").alias("sx"),
        (3 + (7 * F.col("p_size")) % 15).cast("long").alias("sy"),
        (F.round(100 * F.col("p_retailprice")).cast("long") + 4217 * F.col("p_partkey")).alias("ph"),
    )


def _moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(turn, entity_id, sx, sy, ph, n_sx, n_sy, n_ph): what moves while a player (0: none) holds the ball: all players, and the ball from its holder to the next; some 500 rows."""
    players = _players(spark, sf_dir)
    turn = spark.range(23).select(F.col("id").cast("int").alias("turn"))
    holder = players.select(F.col("entity_id").alias("turn"), F.lit(BALL).alias("entity_id"), "sx", "sy", "ph")
    after = players.select((1 + (F.col("entity_id") + 14) % 22).alias("turn"), *(F.col(c).alias(f"n_{c}") for c in ("sx", "sy", "ph")))
    return turn.crossJoin(players).unionByName(holder.join(after, "turn"), allowMissingColumns=True)


def keep_matches(spark: SparkSession, sf_dir: str) -> None:
    """For the session: joins by match and frame, too, take rows as they are dealt by match; else Spark deals both sides anew by all keys of the join. Matches are dealt to as many tasks as the frames need."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    frames = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    spark.conf.set(TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-frames // TASK_FRAMES)))


def by_match(rows: DataFrame) -> DataFrame:
    """The rows with each match in one task. The number of tasks is given, so that small rows that become many are not dealt to a few tasks."""
    conf = rows.sparkSession.conf
    return rows.repartition(int(conf.get(TASKS, conf.get("spark.sql.shuffle.partitions"))), "match_id")


def tracking(spark: SparkSession, sf_dir: str, gaps: bool = True) -> DataFrame:
    """(match_id, frame, timestamp, entity_id, class, team, jersey_no, x, y, conf): players and ball in metres.

    The frames are dealt by match before they become 23 rows each, so what
    groups or joins these by match and more shuffles none of them.
    """
    f = F.col("o_orderkey")
    frames = by_match(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(f / FRAMES).cast("int").alias("match_id"), f.alias("f")))
    block = F.floor(F.col("f") / 40)
    turns = frames.withColumns({"k": F.col("f") % 40, "turn": F.when(F.col("f") >= 0, (1 + (7 * block) % 22).cast("int")).otherwise(0)})
    rows = turns.join(F.broadcast(_moving(spark, sf_dir)), "turn")
    if gaps:
        rows = rows.where((F.col("entity_id") == BALL) | ((31 * F.col("f") + 17 * F.col("entity_id")) % 97 != 0))
    hx, hy = _x(F.col("f"), F.col("sx"), F.col("ph")) / 100, _y(F.col("f"), F.col("sy"), F.col("ph")) / 100
    nx, ny = _x(F.col("f"), F.col("n_sx"), F.col("n_ph")) / 100, _y(F.col("f"), F.col("n_sy"), F.col("n_ph")) / 100
    w = F.greatest(F.col("k") - 30, F.lit(0)) / 10
    near = F.when(F.col("k") < 30, 0.5).otherwise(0.0)
    is_ball = F.col("entity_id") == BALL
    moved = rows.select("match_id", "f", "entity_id", F.when(is_ball, hx + (nx - hx) * w + near).otherwise(hx).alias("x"), F.when(is_ball, hy + (ny - hy) * w).otherwise(hy).alias("y"))
    e = F.col("entity_id")
    frame = (F.col("f") % FRAMES).cast("int")
    return moved.select(
        "match_id",
        frame.alias("frame"),
        (frame / 25).alias("timestamp"),
        "entity_id",
        F.when(e == BALL, "ball").when(e.isin(1, 12), "goalkeeper").otherwise("player").alias("class"),
        F.when(e == BALL, "none").when(e <= 11, "home").otherwise("away").alias("team"),
        F.when(e != BALL, e.cast("short")).alias("jersey_no"),
        "x",
        "y",
        (1 - (F.col("f") * 7 + e * 13) % 50 / 100).alias("conf"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, home_sign, halftime_frame), a row a match: every other one starts on the other side and has an earlier halftime."""
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(F.col("o_orderkey") / FRAMES).cast("int").alias("match_id")).distinct()
    odd = F.col("match_id") % 2 == 1
    return ids.select("match_id", F.when(odd, -1).otherwise(1).alias("home_sign"), F.when(odd, EARLY_HALF).otherwise(HALF).alias("halftime_frame"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("o_orderkey")
    block = F.floor(f / 40)
    frames = spark.read.parquet(f"{sf_dir}/orders.parquet").select(f.alias("f"), (f % 40).alias("k"), (1 + (7 * block) % 22).cast("int").alias("h"), (1 + (7 * (block + 1)) % 22).cast("int").alias("n"))
    return frames.withColumns({"match_id": F.floor(F.col("f") / FRAMES).cast("int"), "frame": (F.col("f") % FRAMES).cast("int")})


def true_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, frame, n, from_id, to_id): each block's holder plays the ball in the last frame that it holds it."""
    return _blocks(spark, sf_dir).where("k = 30").select("match_id", "frame", F.lit(1).alias("n"), F.col("h").alias("from_id"), F.col("n").alias("to_id"))


def true_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, frame, team) of the block's holder, and none while the ball is on its way."""
    return _blocks(spark, sf_dir).select("match_id", "frame", F.when(F.col("k") > 30, "none").when(F.col("h") <= 11, "home").otherwise("away").alias("team"))


def rare_ball(tracking_rows: DataFrame) -> DataFrame:
    """The rows without the ball in seven of forty frames, those around each pass."""
    return tracking_rows.where(~((F.col("entity_id") == BALL) & (F.col("frame") % 40).between(27, 33)))


#: The same tables as SQL: t(match_id, frame, entity_id, class, team, x, y, conf), ball(match_id, frame, x, y) and sgn(team, half, s).
SQL = """
p AS (
    SELECT p_partkey::INT AS e, (5 + p_size % 20)::BIGINT AS sx, (3 + (7 * p_size) % 15)::BIGINT AS sy, round(100 * p_retailprice)::BIGINT + 4217 * p_partkey AS ph
    FROM part WHERE p_partkey BETWEEN 1 AND 22
), fr AS (SELECT o_orderkey AS f FROM orders), raw AS (
    SELECT f, e, abs((f * sx + ph) % 21000 - 10500) / 100.0::DOUBLE AS x, abs((f * sy + 5 * ph) % 13600 - 6800) / 100.0::DOUBLE AS y FROM fr, p
), held AS (SELECT f, f % 40 AS k, 1 + (7 * (f // 40)) % 22 AS h, 1 + (7 * (f // 40 + 1)) % 22 AS n FROM fr
), ball0 AS (
    SELECT held.f, a.x + (b.x - a.x) * (greatest(k - 30, 0) / 10.0::DOUBLE) + CASE WHEN k < 30 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS x,
        a.y + (b.y - a.y) * (greatest(k - 30, 0) / 10.0::DOUBLE) AS y
    FROM held JOIN raw a ON a.f = held.f AND a.e = h JOIN raw b ON b.f = held.f AND b.e = n
), t AS (
    SELECT (f // 6000)::INT AS match_id, (f % 6000)::INT AS frame, e AS entity_id, CASE WHEN e IN (1, 12) THEN 'goalkeeper' ELSE 'player' END AS class,
        CASE WHEN e <= 11 THEN 'home' ELSE 'away' END AS team, x, y, 1 - (f * 7 + e * 13) % 50 / 100.0::DOUBLE AS conf
    FROM raw WHERE (31 * f + 17 * e) % 97 <> 0
), ball AS (SELECT (f // 6000)::INT AS match_id, (f % 6000)::INT AS frame, x, y FROM ball0
)"""
