"""Registered analytics queries over the match derived from the given tables."""

from __future__ import annotations

import uuid
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import conics, pitch
from ..operators import calibration, control, embedding, evaluation, features, footage, formations, marking, movement, passing, play, possession, report, style, tactics, teams, tracker, tracks, trust
from ..sources import camera, lens

QUERIES: dict = {}


def _plain(df: DataFrame) -> DataFrame:
    """Integers as long and doubles to six decimals, so that another engine's rows compare equal."""
    found = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind in ("tinyint", "smallint", "int"):
            column = column.cast("long")
        elif kind in ("float", "double"):
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        found.append(column.alias(name))
    return df.select(*found)


def query(function):
    """Registers a function under its name."""

    @wraps(function)
    def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
        lens.keep_matches(spark, sf_dir)
        return _plain(function(spark, sf_dir))

    QUERIES[function.__name__] = plain
    return function


def _stored(df: DataFrame) -> DataFrame:
    """The rows, stored once as Parquet below the session's checkpoint folder where it has one, for what several branches of a plan read; dealt by match again where they have one."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        return df
    path = f"{folder}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    return lens.by_match(found) if "match_id" in df.columns else found


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seen = lens.tracking(spark, sf_dir)
    return seen, possession.possession(seen)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.events(*_base(spark, sf_dir))


@query
def players_by_class(spark, sf_dir):
    seen = possession.players_only(lens.tracking(spark, sf_dir))
    return seen.groupBy("match_id", "team", "class").agg(F.count("*").alias("n"), F.sum(pitch.contains(F.col("x"), F.col("y")).cast("int")).alias("on_pitch"), F.sum(pitch.in_penalty_area(F.col("x"), F.col("y"), True).cast("int")).alias("in_left_box"))


@query
def possession_frames(spark, sf_dir):
    return _base(spark, sf_dir)[1]


@query
def possession_spells(spark, sf_dir):
    return possession.spells(_base(spark, sf_dir)[1])


@query
def possession_summary(spark, sf_dir):
    return possession.possession_summary(_base(spark, sf_dir)[1])


@query
def rolling_possession(spark, sf_dir):
    return possession.rolling_possession(_base(spark, sf_dir)[1])


@query
def derived_events(spark, sf_dir):
    return _events(spark, sf_dir)


@query
def event_counts(spark, sf_dir):
    return play.event_counts(_events(spark, sf_dir))


@query
def counter_attacks(spark, sf_dir):
    seen, held = _base(spark, sf_dir)
    return play.counter_attacks(play.events(seen, held), possession.ball_of(seen), lens.matches(spark, sf_dir))


@query
def minutes_played(spark, sf_dir):
    return movement.minutes_played(lens.tracking(spark, sf_dir))


@query
def kinematics(spark, sf_dir):
    return movement.kinematics(lens.tracking(spark, sf_dir))


@query
def movement_profiles(spark, sf_dir):
    return movement.movement_profiles(movement.kinematics(lens.tracking(spark, sf_dir), marks=True))


@query
def third_occupation(spark, sf_dir):
    return movement.third_occupation(lens.tracking(spark, sf_dir))


@query
def heatmap_counts(spark, sf_dir):
    return movement.heatmaps(lens.tracking(spark, sf_dir))


@query
def heatmap_blurred(spark, sf_dir):
    counts = movement.heatmaps(lens.tracking(spark, sf_dir)).where("entity_id is null")
    return movement.blurred(counts, "n", "match_id", "team")


class _Played:
    """What several branches of a query read of the derived matches, each stored when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.matches = spark, sf_dir, lens.matches(spark, sf_dir)

    @cached_property
    def seen(self):
        # made anew by each branch: arithmetic on frames costs less than storing and dealing 23 rows for each
        return lens.tracking(self.spark, self.sf_dir)

    @cached_property
    def held(self):
        return _stored(possession.possession(self.seen))

    @cached_property
    def kin(self):
        return _stored(movement.kinematics(self.seen, marks=True))

    @cached_property
    def profiles(self):
        return _stored(movement.movement_profiles(self.kin))

    @cached_property
    def teams(self):
        return _stored(_teams(self.seen))

    @cached_property
    def shapes(self):
        return _stored(tactics.shape_summary(tactics.shape(self.seen, self.held, self.matches)))

    @cached_property
    def events(self):
        return _stored(play.events(self.seen, self.held))

    @cached_property
    def phases(self):
        return _stored(tactics.phases(self.seen, self.held, self.matches))

    @cached_property
    def press(self):
        return _stored(tactics.pressures(self.kin, self.held, self.teams))

    @cached_property
    def edges(self):
        return _stored(passing.pass_edges(self.events))

    @cached_property
    def central(self):
        return _stored(passing.pass_centrality(self.edges))

    @cached_property
    def names(self):
        return _stored(report.labels(self.seen))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _Played(spark, sf_dir)
    return formations.window_places(m.seen, m.held, m.matches)


def _features(spark, sf_dir, m: _Played | None = None):
    # derived matches are short, so half a minute is enough
    m = m or _Played(spark, sf_dir)
    return features.player_features(m.seen, m.held, m.phases, m.kin, m.profiles, m.press, passing.pass_nodes(m.events), m.central, m.matches, least_minutes=0.5)


@query
def player_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query
def shape_timeseries(spark, sf_dir):
    return tactics.shape(*_base(spark, sf_dir), lens.matches(spark, sf_dir))


@query
def shape_summary(spark, sf_dir):
    return tactics.shape_summary(tactics.shape(*_base(spark, sf_dir), lens.matches(spark, sf_dir)))


@query
def field_tilt(spark, sf_dir):
    return tactics.field_tilt(*_base(spark, sf_dir), lens.matches(spark, sf_dir))


@query
def phase_frames(spark, sf_dir):
    return tactics.phases(*_base(spark, sf_dir), lens.matches(spark, sf_dir))


@query
def phase_summary(spark, sf_dir):
    return tactics.phase_summary(tactics.phases(*_base(spark, sf_dir), lens.matches(spark, sf_dir)))


def _pressures(spark, sf_dir):
    seen = lens.tracking(spark, sf_dir)
    held = _stored(possession.possession(seen))
    teams = _teams(seen)
    return seen, held, tactics.pressures(movement.kinematics(seen), held, teams)


@query
def pressures(spark, sf_dir):
    return _pressures(spark, sf_dir)[2]


@query
def ppda(spark, sf_dir):
    seen, held, press = _pressures(spark, sf_dir)
    return tactics.ppda(play.events(seen, held), press, lens.matches(spark, sf_dir))


@query
def pressing_summary(spark, sf_dir):
    seen, held, press = _pressures(spark, sf_dir)
    frames = seen.groupBy("match_id").agg((F.max("frame") + 1).alias("n_frames"))
    return tactics.pressing_summary(press, play.events(seen, held), frames, lens.matches(spark, sf_dir))


@query
def pass_edges(spark, sf_dir):
    return passing.pass_edges(_events(spark, sf_dir))


@query
def pass_nodes(spark, sf_dir):
    return passing.pass_nodes(_events(spark, sf_dir))


@query
def pass_summary(spark, sf_dir):
    return passing.pass_summary(_Played(spark, sf_dir).edges)


@query
def pass_centrality(spark, sf_dir):
    return passing.pass_centrality(passing.pass_edges(_events(spark, sf_dir)))


@query
def defensive_lines(spark, sf_dir):
    seen, held = _base(spark, sf_dir)
    return passing.defensive_lines(seen, play.events(seen, held).where("type = 'pass' and outcome = 'complete'"), lens.matches(spark, sf_dir))


@query
def line_breaking_passes(spark, sf_dir):
    m = _Played(spark, sf_dir)
    return passing.line_breaking(m.seen, m.events, m.matches)


@query
def xt_counts(spark, sf_dir):
    return passing.xt_counts(passing.moves(_events(spark, sf_dir), lens.matches(spark, sf_dir)))


@query
def xt_grid(spark, sf_dir):
    m = _Played(spark, sf_dir)
    return passing.xt_grids(m.events, m.matches)


@query
def player_xt(spark, sf_dir):
    m = _Played(spark, sf_dir)
    return passing.player_xt(m.events, passing.xt_grids(m.events, m.matches), m.matches)


def _sampled(seen: DataFrame) -> DataFrame:
    """Every 12th distinct frame, as the mean surface is defined, with each player's modal team."""
    teams = _teams(seen)
    return control.every_nth_frame(movement.kinematics(seen)).join(teams, ["match_id", "entity_id"])


@query
def pitch_control_frames(spark, sf_dir):
    return control.control_frames(_sampled(lens.tracking(spark, sf_dir)))


@query
def pitch_control_mean(spark, sf_dir):
    return control.mean_control(_sampled(lens.tracking(spark, sf_dir)))


@query
def voronoi_areas(spark, sf_dir):
    return control.voronoi_areas(possession.players_only(lens.tracking(spark, sf_dir)).select("match_id", "frame", "team", "x", "y"))


@query
def offscreen_ghosts(spark, sf_dir):
    # a camera that sees 30 m to either side of the ball leaves gaps to bridge
    seen = lens.tracking(spark, sf_dir)
    ball = possession.ball_of(seen).select("match_id", "frame", "ball_x").hint("shuffle_hash")
    kin = movement.kinematics(seen).join(ball, ["match_id", "frame"]).where("abs(x - ball_x) <= 30")
    return control.ghosts(kin)


@query
def formation_places(spark, sf_dir):
    return _places(spark, sf_dir)


@query
def formation_windows(spark, sf_dir):
    return formations.formation_windows(_places(spark, sf_dir))


@query
def formation_summary(spark, sf_dir):
    return formations.formation_summary(formations.formation_windows(_places(spark, sf_dir)))


def _moving(seen: DataFrame) -> DataFrame:
    """Smoothed positions with each entity's modal team and class, as rows of players."""
    of = possession.modal(seen, "team", "class").hint("shuffle_hash")
    return movement.smoothed(movement.resampled(seen)).select("match_id", "frame", "entity_id", "x", "y").join(of, ["match_id", "entity_id"])


def _marked(spark, sf_dir):
    m = _Played(spark, sf_dir)
    moving = _moving(m.seen)
    return moving, m.phases, marking.assignments(moving, m.phases)


@query
def marking_assignments(spark, sf_dir):
    return _marked(spark, sf_dir)[2]


@query
def marking_pairs(spark, sf_dir):
    return marking.pairs(_marked(spark, sf_dir)[2])


@query
def marking_scores(spark, sf_dir):
    seen, found, assigned = _marked(spark, sf_dir)
    return marking.marking(_stored(assigned), seen, found)


@query
def defensive_spread(spark, sf_dir):
    seen, held = _base(spark, sf_dir)
    return marking.spread(seen, tactics.phases(seen, held, lens.matches(spark, sf_dir)))


@query
def top_movers(spark, sf_dir):
    found = movement.movement_profiles(movement.kinematics(lens.tracking(spark, sf_dir), marks=True)).where("minutes > 1")
    place = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc(F.round("distance_m", 6)), "entity_id"))
    return found.withColumn("place", place).where("place <= 5").select("match_id", "place", "entity_id", "distance_m")


@query
def top_speeds(spark, sf_dir):
    found = movement.movement_profiles(movement.kinematics(lens.tracking(spark, sf_dir), marks=True)).where("minutes > 1")
    place = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc(F.round("top_speed", 6)), "entity_id"))
    return found.withColumn("place", place).where("place <= 5").select("match_id", "place", "entity_id", "top_speed", "n_sprints")


@query
def most_central(spark, sf_dir):
    return passing.most_central(passing.pass_centrality(passing.pass_edges(_events(spark, sf_dir))))


@query
def top_threats(spark, sf_dir):
    found = player_xt(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc(F.round("xt_created", 6)), "entity_id"))
    return found.withColumn("place", place).where("place <= 6")


@query
def radar_frames(spark, sf_dir):
    # three radar frames a second: every eighth frame, its players by jersey
    seen = lens.tracking(spark, sf_dir).where(F.col("frame") % 8 == 0)
    return seen.where("jersey_no is not null").groupBy("match_id", "frame").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.col("jersey_no").cast("int"))).cast("array<string>"), ",").alias("jerseys"))


def _people(spark, sf_dir):
    return possession.players_only(lens.tracking(spark, sf_dir))


@query
def class_votes(spark, sf_dir):
    return tracks.class_votes(_people(spark, sf_dir))


@query
def jersey_votes(spark, sf_dir):
    # every fifth reading or so is one off
    rows = _people(spark, sf_dir).select("match_id", "entity_id", "conf", (F.col("entity_id") + F.when((F.col("frame") * 3 + F.col("entity_id")) % 5 == 0, 1).otherwise(0)).alias("number"))
    return tracks.jersey_votes(rows)


@query
def attack_direction(spark, sf_dir):
    halves = _people(spark, sf_dir).join(lens.matches(spark, sf_dir), "match_id").withColumn("half", F.when(F.col("frame") >= F.col("halftime_frame"), 2).otherwise(1))
    return tracks.attack_direction(halves, "half")


@query
def bridged_gaps(spark, sf_dir):
    return tracks.bridged(_people(spark, sf_dir).select("match_id", "entity_id", "frame", "x", "y", "conf"))


@query
def match_quality(spark, sf_dir):
    return tracks.quality(lens.tracking(spark, sf_dir))


@query
def long_tracks(spark, sf_dir):
    return tracks.without_fragments(lens.tracking(spark, sf_dir), 500).groupBy("match_id", "entity_id").agg(F.count("*").alias("n"))


@query
def rare_ball_events(spark, sf_dir):
    # the ball is not seen around passes, so releases and receptions look for the nearest frame with it
    seen = lens.rare_ball(lens.tracking(spark, sf_dir))
    return play.events(seen, possession.possession(seen))


@query
def owner_agreement(spark, sf_dir):
    return evaluation.owner_agreement(_base(spark, sf_dir)[1], lens.true_owners(spark, sf_dir))


@query
def pass_agreement(spark, sf_dir):
    passes = evaluation.numbered(_Played(spark, sf_dir).events.where("type = 'pass'"))
    return evaluation.event_agreement(passes, lens.true_passes(spark, sf_dir))


@query
def radius_sweep(spark, sf_dir):
    seen = lens.tracking(spark, sf_dir)
    with_radius = lambda r: DEFAULT.with_overrides({"possession": {"radius_m": r}})
    return evaluation.radius_sweep(seen, lens.true_passes(spark, sf_dir), possession.possession, play.events, (1.0, 2.0, 3.0), 40, with_radius)


@query
def label_flips(spark, sf_dir):
    # labels of every other match are the wrong way round
    true = lens.tracking(spark, sf_dir)
    swapped = F.when(F.col("match_id") % 2 == 0, F.col("team")).when(F.col("team") == "home", "away").when(F.col("team") == "away", "home").otherwise(F.col("team"))
    return evaluation.labels_flipped(true.withColumns({"team": swapped, "x": F.col("x") + 0.25}), true)


@query
def player_tracks(spark, sf_dir):
    return tracker.tracks(camera.detections(spark, sf_dir))


@query
def tracking_metrics(spark, sf_dir):
    return evaluation.tracking_metrics(camera.true_boxes(spark, sf_dir), _stored(tracker.tracks(camera.detections(spark, sf_dir))))


@query
def ball_track(spark, sf_dir):
    return tracker.ball_track(camera.ball_candidates(spark, sf_dir))


def _coefficients(found):
    return found.select(*(c for c in found.columns if c != "homography"), *(F.get("homography", F.lit(3 * i + j)).alias(f"h{i}{j}") for i in range(3) for j in range(3)))


@query
def steady_homographies(spark, sf_dir):
    return _coefficients(tracker.steady_homographies(camera.homography_estimates(spark, sf_dir)))


@query
def fitted_homographies(spark, sf_dir):
    return _coefficients(calibration.fitted_homographies(camera.correspondences(spark, sf_dir)))


@query
def perception_quality(spark, sf_dir):
    # every third match is an import; calibrations are propagated in two of five frames
    f = F.col("frame")
    found = camera.homography_estimates(spark, sf_dir).select("match_id", "frame", F.get("homography", F.lit(0)).alias("h00"), F.when(f % 5 == 1, "flow").otherwise("points").alias("method"), ((f * 7) % 40).cast("double").alias("reproj_error_px"))
    m = F.col("match_id")
    sizes = found.groupBy("match_id").agg(F.count("*").alias("n_frames"))
    matches = sizes.select("match_id", F.when(m % 3 == 2, "import").otherwise("video:derived").alias("source"), F.lit(25.0).alias("fps"), "n_frames", (1.0 + m % 4).alias("team_separability"), F.when(m % 2 == 1, F.col("n_frames") * 0.6).cast("long").alias("ball_observed_frames"))
    return trust.perception_quality(lens.tracking(spark, sf_dir), found, matches)


@query
def circle_tangents(spark, sf_dir):
    # where tangents from the ball touch the centre circle, and where they meet the halfway line's polar
    ball = possession.ball_of(lens.tracking(spark, sf_dir))
    circle = conics.circle(F.lit(52.5), F.lit(34.0), F.lit(9.15))
    line = conics.polar(circle, F.col("ball_x"), F.col("ball_y"))
    (x1, y1), (x2, y2) = conics.meets(circle, line)
    back = conics.pole(circle, line)
    return ball.select("match_id", "frame", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), back[0].alias("x"), back[1].alias("y"))


@query
def pixel_backfill(spark, sf_dir):
    seen = lens.tracking(spark, sf_dir)
    return footage.with_pixels(seen, camera.homography_estimates(spark, sf_dir)).select("match_id", "frame", "entity_id", "x_pixel", "y_pixel")


@query
def calibration_errors(spark, sf_dir):
    return footage.calibration_errors(camera.true_boxes(spark, sf_dir), lens.tracking(spark, sf_dir), camera.homography_estimates(spark, sf_dir))


@query
def ball_windows(spark, sf_dir):
    # the ball's boxes have sides of six pixels and are missing in some frames
    people = camera.true_boxes(spark, sf_dir)
    ball = camera.ball_candidates(spark, sf_dir).where("x is not null and conf >= 0.3 and frame % 3 <> 0").select("match_id", "frame", F.lit(99).alias("track_id"), (F.col("x") - 3).alias("x1"), (F.col("y") - 3).alias("y1"), (F.col("x") + 3).alias("x2"), (F.col("y") + 3).alias("y2"))
    return footage.ball_windows(people.drop("class").unionByName(ball), people, 1280.0, 720.0)


def _peaks(spark, sf_dir):
    """The surest candidate of each frame against the ball's true pixel; every eleventh frame has none."""
    best = camera.ball_candidates(spark, sf_dir).where("x is not null").groupBy("match_id", "frame").agg(F.max(F.struct("conf", "x", "y")).alias("b"))
    ball = lens.tracking(spark, sf_dir).where("entity_id = -1")
    u, v = pitch.project([F.lit(float(h)) for h in camera.TO_PIXEL.ravel()], F.col("tx"), F.col("ty"))
    joined = ball.select("match_id", "frame", F.col("x").alias("tx"), F.col("y").alias("ty")).join(best, ["match_id", "frame"], "left")
    return joined.select(F.coalesce("b.conf", F.lit(0.0)).alias("peak"), "b.x", "b.y", (F.col("frame") % 11 != 4).alias("has"), u.alias("true_x"), v.alias("true_y"))


@query
def ball_threshold_sweep(spark, sf_dir):
    return footage.threshold_sweep(_peaks(spark, sf_dir), (0.3, 0.4, 0.5, 0.6, 0.7))


@query
def pose_profiles(spark, sf_dir):
    # seventeen points about each player's place, some of them unsure; Java would interpret a generated method of over 8000 bytes
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    seen = _people(spark, sf_dir)
    f, e = F.col("frame"), F.col("entity_id")
    point = lambda i: F.struct((100 + e * 10 + (f * (i + 3)) % 17).cast("double").alias("x"), (50 + i * 6 + (f * 7 + e * i) % 5).cast("double").alias("y"), (((f * (i + 1) + e) % 10) / 10).alias("conf"))
    poses = seen.select("match_id", "entity_id", "frame", F.array(*(point(i) for i in range(17))).alias("keypoints"), F.lit(40.0).alias("y1"), (160.0 + e).alias("y2"))
    return footage.pose_profiles(footage.pose_descriptors(poses))


@query
def scene_cuts(spark, sf_dir):
    return tracker.scene_cuts(camera.colour_histograms(spark, sf_dir))


@query
def nearest_vectors(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return tracks.nearest_vectors(vectors, vectors.where("vec_id % 50 = 0")).select("vec_id", "place", F.round("cosine", 5).alias("cosine"))


@query
def similar_players(spark, sf_dir):
    return style.similar_players(_stored(_features(spark, sf_dir)))


@query
def similarity_by_group(spark, sf_dir):
    return style.attribution(_stored(_features(spark, sf_dir)))


def _style_rows(spark, sf_dir, m: _Played | None = None):
    m = m or _Played(spark, sf_dir)
    features_ = _stored(_features(spark, sf_dir, m))
    return features_, _stored(embedding.style_rows(features_, embedding.player_grids(m.seen, m.matches)))


@query
def player_maps(spark, sf_dir):
    return embedding.player_maps(lens.tracking(spark, sf_dir), lens.matches(spark, sf_dir))


def _numbers(vectors):
    """A row for each number of a vector."""
    return vectors.select("match_id", "entity_id", F.posexplode("vector").alias("place", "v"))


@query
def style_vectors(spark, sf_dir):
    return _numbers(embedding.match_vectors(_style_rows(spark, sf_dir)[1]))


@query
def style_vectors_of_all(spark, sf_dir):
    return _numbers(embedding.all_vectors(_style_rows(spark, sf_dir)[1]))


def _clusters(spark, sf_dir, m: _Played | None = None):
    features_, rows = _style_rows(spark, sf_dir, m)
    return features_, _stored(embedding.style_clusters(embedding.match_vectors(rows)))


@query
def cluster_traits(spark, sf_dir):
    return embedding.cluster_traits(*_clusters(spark, sf_dir))


@query
def player_roles(spark, sf_dir):
    return embedding.player_roles(*_clusters(spark, sf_dir))


@query
def nominal_and_actual(spark, sf_dir):
    windows = formations.formation_windows(_places(spark, sf_dir))
    return embedding.nominal_and_actual(embedding.player_roles(*_clusters(spark, sf_dir)), windows)


def _looks(spark, sf_dir):
    """Vectors as samples of the looks of tracks: forty tracks a match, whose first numbers tell the team."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    track = F.pmod(F.col("vec_id"), F.lit(40)).cast("int")
    tinted = F.transform(F.slice("embedding", 1, 8), lambda v, i: v.cast("double") + F.when(track % 20 == 19, 9.0).when(track % 2 == 0, 2.0).otherwise(-2.0))
    return vectors.where("embedding is not null").select(F.col("label").alias("match_id"), track.alias("track_id"), tinted.alias("signature"))


@query
def track_signatures(spark, sf_dir):
    return teams.track_signatures(_looks(spark, sf_dir)).select("match_id", "track_id", "n", F.posexplode("signature").alias("i", "v"))


@query
def team_clusters(spark, sf_dir):
    seen = teams.track_signatures(_looks(spark, sf_dir)).withColumns({"class": F.lit("player"), "mean_x": F.when(F.col("track_id") == 39, 4.0).otherwise(30.0 + F.col("track_id") % 2 * 40.0)})
    return teams.assigned_teams(seen)


#: One question for each group of synonyms, one in plain words, and one that the facts do not answer.
QUESTIONS = (
    "Who pressed most?", "Which team had possession?", "What formation was it?", "Who was marked?", "How fast were they?", "How far did they run?", "Where did threat come from?",
    "How many passes were completed by the home team?", "What roles were there?", "How did the field tilt?", "Were there counters?", "How high was the block?", "Will it rain tomorrow?",
)


def _teams(seen):
    return possession.modal(seen, "team")


@query
def line_breaking_counts(spark, sf_dir):
    return line_breaking_passes(spark, sf_dir).groupBy("match_id", "team").agg(F.count("*").alias("total"))


@query
def counter_attack_counts(spark, sf_dir):
    return counter_attacks(spark, sf_dir).groupBy("match_id", "team").agg(F.count("*").alias("total"))


@query
def team_running(spark, sf_dir):
    seen = lens.tracking(spark, sf_dir)
    return report.team_running(movement.movement_profiles(movement.kinematics(seen, marks=True)), _teams(seen))


def _facts(spark, sf_dir, m: _Played | None = None):
    m = m or _Played(spark, sf_dir)
    frames = m.seen.groupBy("match_id").agg((F.max("frame") + 1).alias("n_frames"))
    total = lambda rows: rows.groupBy("match_id", "team").agg(F.count("*").alias("total"))
    return report.build_facts({
        "possession_summary": possession.possession_summary(m.held), "event_counts": play.event_counts(m.events), "field_tilt": tactics.field_tilt(m.seen, m.held, m.matches), "shape_summary": m.shapes,
        "pressing_summary": tactics.pressing_summary(m.press, m.events, frames, m.matches), "ppda": tactics.ppda(m.events, m.press, m.matches), "pass_summary": passing.pass_summary(m.edges),
        "line_breaking_counts": total(passing.line_breaking(m.seen, m.events, m.matches)), "counter_attack_counts": total(play.counter_attacks(m.events, possession.ball_of(m.seen), m.matches)), "team_running": report.team_running(m.profiles, m.teams),
    })


def _asked(known):
    return known.select("match_id").distinct().select("match_id", F.explode(F.array(*map(F.lit, QUESTIONS))).alias("question"))


@query
def match_facts(spark, sf_dir):
    return _facts(spark, sf_dir)


def _stored_facts(spark, sf_dir):
    return _stored(_facts(spark, sf_dir))


@query
def fact_retrieval(spark, sf_dir):
    known = _stored_facts(spark, sf_dir)
    return report.retrieve(_asked(known), known)


@query
def fact_answers(spark, sf_dir):
    known = _stored_facts(spark, sf_dir)
    return report.answers(_asked(known), known)


@query
def match_report(spark, sf_dir):
    return report.written(_facts(spark, sf_dir))


@query
def report_audit(spark, sf_dir):
    # the written report with one number that is no fact
    known = _stored_facts(spark, sf_dir)
    return report.audit(report.written(known).select("match_id", F.concat(F.lit("In a 4-3-3, nothing was 123456.5. "), "text").alias("text")), known)


def _labelled(spark, sf_dir, m: _Played | None = None):
    """Facts with players' names, and facts in words, that SQL can express too."""
    m = m or _Played(spark, sf_dir)
    return report.together(
        report.running_facts(m.profiles, m.names), report.passing_facts(passing.pass_summary(m.edges), passing.most_central(m.central), m.names),
        report.block_facts(m.shapes), report.phase_facts(tactics.phase_summary(m.phases)), report.quality_facts(perception_quality(spark, sf_dir)),
    )


@query
def labelled_facts(spark, sf_dir):
    return _labelled(spark, sf_dir)


def _scouted(spark, sf_dir, m: _Played | None = None):
    m = m or _Played(spark, sf_dir)
    of = possession.modal(m.seen, "team", "class")
    # the motion is stored once, in m.kin; only who is who is stored beside it
    moving = m.kin.select("match_id", "frame", "entity_id", "x", "y").join(_stored(of), ["match_id", "entity_id"])
    marked = marking.marking(_stored(marking.assignments(moving, m.phases)), moving, m.phases)
    windows = _stored(formations.formation_windows(formations.window_places(m.seen, m.held, m.matches)))
    roles = _stored(embedding.player_roles(*_clusters(spark, sf_dir, m)))
    created = passing.player_xt(m.events, passing.xt_grids(m.events, m.matches), m.matches)
    return report.together(
        report.formation_facts(formations.formation_summary(windows)), report.threat_facts(_stored(created), m.names), report.marking_facts(_stored(marked), m.names),
        report.role_facts(roles, embedding.nominal_and_actual(roles, windows), m.names),
    )


@query
def scouting_facts(spark, sf_dir):
    # formations, threat, marking and roles, whose numbers come from assignment, value iteration and clustering
    return _scouted(spark, sf_dir)


def _every_fact(spark, sf_dir):
    m = _Played(spark, sf_dir)
    return report.together(_facts(spark, sf_dir, m), _labelled(spark, sf_dir, m), _scouted(spark, sf_dir, m))


@query
def match_narrative(spark, sf_dir):
    return report.narrative(_every_fact(spark, sf_dir))
