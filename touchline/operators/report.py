"""A match's facts as paths and values, answers from them, a report of them, and an audit of text against them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.segments import player_label
from .possession import modal

NUMBER = r"(?<![A-Za-z0-9_.\-])-?\d+(?:\.\d+)?"
#: What looks like a number and is none: formations, and shirts.
FORMATION, SHIRT = r"\b\d(?:-\d){2,4}\b", r"#\d+"
APPENDIX = "## Metrics Appendix"
REFUSAL = "The extracted analytics don't cover that."

#: What else a word of a question, or a word that begins or continues it, stands for.
SYNONYMS = {
    "press": ["pressing", "ppda", "pressure", "pressures"],
    "possession": ["ball share", "share"],
    "formation": ["formations", "shape", "morph"],
    "mark": ["marking", "man", "zonal", "scheme", "pairs"],
    "fast": ["speed", "top_speed", "sprints"],
    "run": ["distance", "sprints", "physical"],
    "threat": ["xt", "expected_threat", "created"],
    "pass": ["passes", "pass_network", "line_breaking", "combination"],
    "role": ["roles", "discovered", "nominal"],
    "tilt": ["field_tilt", "territory"],
    "counter": ["counter_attacks", "transition"],
    "block": ["shape", "def_line_height_m", "low_block", "high"],
}

#: Summaries that give facts: the query's name, the prefix of its paths, and its columns.
SUMMARIES = (
    ("possession_summary", "possession", ("share", "n_spells", "mean_spell_s")),
    ("event_counts", "events", ("passes", "completed", "turnovers", "carries")),
    ("field_tilt", "field_tilt", ("tilt", "final_third_share", "own_third_share")),
    ("shape_summary", "shape", ("in_line", "out_line", "in_depth", "out_depth", "in_width", "out_width")),
    ("pressing_summary", "pressing", ("pressures", "pressures_per_min", "press_height_mean_m", "high_press_share", "press_to_turnover_rate")),
    ("ppda", "ppda", ("ppda", "opp_buildup_passes", "defensive_actions")),
    ("pass_summary", "pass_network", ("n_passes", "n_players", "density")),
    ("line_breaking_counts", "line_breaking", ("total",)),
    ("counter_attack_counts", "counter_attacks", ("total",)),
    ("team_running", "physical", ("distance_m", "sprints", "top_speed")),
)


def facts(summary: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    """(match_id, path, value): one row for each named number of a per-team summary."""
    entries = F.array(*(F.struct(F.concat(F.lit(f"{prefix}."), F.col("team"), F.lit(f".{n}")).alias("path"), F.col(n).cast("double").alias("value")) for n in names))
    return summary.select("match_id", F.explode(entries).alias("f")).select("match_id", "f.path", "f.value").where("value is not null")


def build_facts(summaries: dict[str, DataFrame]) -> DataFrame:
    """(match_id, path, value) of all of SUMMARIES that are given, by name."""
    return reduce(DataFrame.unionByName, (facts(summaries[name], prefix, list(columns)) for name, prefix, columns in SUMMARIES if name in summaries))


def team_running(profiles: DataFrame, teams: DataFrame) -> DataFrame:
    """(match_id, team, distance_m, sprints, top_speed): sums over a team's players, and its fastest."""
    return profiles.join(teams, ["match_id", "entity_id"]).groupBy("match_id", "team").agg(F.sum("distance_m").alias("distance_m"), F.sum("n_sprints").alias("sprints"), F.max("top_speed").alias("top_speed"))


def labels(tracking: DataFrame) -> DataFrame:
    """(match_id, entity_id, label): how a player is called, by most frequent number and team."""
    rows = modal(tracking, "jersey_no", "team")
    return rows.select("match_id", "entity_id", player_label(F.col("entity_id"), F.col("jersey_no"), F.col("team")).alias("label"))


def called(rows: DataFrame, names: DataFrame, **ids: str) -> DataFrame:
    """The rows with a label for each id column, as ``label=column``; an id without a label is 'player' and the id, a null id stays null."""
    for label, column in ids.items():
        own = names.select("match_id", F.col("entity_id").alias(column), F.col("label").alias("_label"))
        rows = rows.join(own, ["match_id", column], "left").withColumn(label, F.coalesce("_label", F.concat(F.lit("player "), F.col(column).cast("string")))).drop("_label")
    return rows


def top(rows: DataFrame, value: str, k: int, *ties: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The k rows of the largest value of each match (and ``by``) with their place, from 0; values equal to nine decimals go by ``ties``."""
    order = Window.partitionBy("match_id", *by).orderBy(F.desc_nulls_last(F.round(value, 9)), *ties)
    return rows.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < k)


def told(rows: DataFrame, path: Column, *columns: str) -> DataFrame:
    """(match_id, path, value, text): a row for each of the columns that is not null, strings as text, all else as value."""
    kinds = dict(rows.dtypes)

    def entry(name: str) -> Column:
        words = kinds[name] == "string"
        value, text = (F.lit(None), F.col(name)) if words else (F.col(name), F.lit(None))
        return F.struct(F.concat(path, F.lit(f".{name}")).alias("path"), value.cast("double").alias("value"), text.cast("string").alias("text"))

    return rows.select("match_id", F.explode(F.array(*map(entry, columns))).alias("f")).select("match_id", "f.path", "f.value", "f.text").where("value is not null or text is not null")


def together(*parts: DataFrame) -> DataFrame:
    """(match_id, path, value, text) of facts with or without text; a path that comes twice keeps its least."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.groupBy("match_id", "path").agg(F.min("value").alias("value"), F.min("text").alias("text")) if "text" in every.columns else every


def _list(prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}."), F.col("place").cast("string"))


def running_facts(profiles: DataFrame, names: DataFrame, minutes: float = 1.0, k: int = 5) -> DataFrame:
    """The players of over ``minutes`` minutes who covered most a minute, and the fastest."""
    seen = called(profiles.where(F.col("minutes") > minutes), names.where("label is not null"), player="entity_id").withColumns({"value_m_per_min": F.col("distance_m") / F.col("minutes"), "value_mps": F.col("top_speed"), "sprints": F.col("n_sprints")})
    far = told(top(seen, "value_m_per_min", k, "entity_id"), _list("physical.top_distance_per_min"), "player", "value_m_per_min", "sprints")
    return far.unionByName(told(top(seen, "value_mps", k, "entity_id"), _list("physical.top_speed"), "player", "value_mps"))


def passing_facts(summary: DataFrame, central: DataFrame, names: DataFrame) -> DataFrame:
    """Each team's most central player and its most frequent combination."""
    path = F.concat(F.lit("pass_network."), F.col("team"))
    hubs = told(called(central, names, most_central_player="entity_id"), path, "most_central_player")
    pairs = called(summary, names, _from="top_source", _to="top_target")
    said = pairs.withColumn("top_combination", F.concat("_from", F.lit(" to "), "_to", F.lit(" ("), F.col("top_weight").cast("string"), F.lit(" passes)")))
    return hubs.unionByName(told(said, path, "top_combination"))


def block_facts(shapes: DataFrame) -> DataFrame:
    """The height at which each team defends, in words."""
    return told(shapes, F.concat(F.lit("shape."), F.col("team")), "block_label")


def phase_facts(summary: DataFrame) -> DataFrame:
    """Shares of phases and postures."""
    return told(summary, F.concat(F.lit("phases."), "scope", F.lit("."), "value"), "share")


def quality_facts(quality: DataFrame) -> DataFrame:
    """Levels of trust and the notes; no notes, no fact of them."""
    rows = quality.withColumn("notes", F.nullif("notes", F.lit("")))
    return told(rows, F.lit("data_quality"), "overall", "calibration_level", "ball_level", "tracks_level", "teams_level", "ball_share", "players_median", "notes")


def formation_facts(summary: DataFrame) -> DataFrame:
    """Formations with and without the ball with their measures, and how a team's shape changes between them."""
    state = F.when(F.col("state") == "in", "in_possession").otherwise("out_possession")
    rows = summary.withColumns({"avg_width_m": F.round("mean_width_m", 1), "avg_depth_m": F.round("mean_depth_m", 1), "avg_hull_m2": F.round("mean_hull_m2", 1), "transitions": F.col("n_transitions")})
    own = told(rows, F.concat(F.lit("formations."), "team", F.lit("."), state), "formation", "stability", "avg_width_m", "avg_depth_m", "avg_hull_m2", "transitions")
    both = summary.groupBy("match_id", "team").agg(*(F.max(F.when(F.col("state") == s, F.col("formation"))).alias(s) for s in ("in", "out")))
    morph = both.withColumn("shape_morph", F.concat("in", F.lit(" with the ball, "), "out", F.lit(" without it")))
    return own.unionByName(told(morph, F.concat(F.lit("formations."), "team"), "shape_morph"))


def threat_facts(created: DataFrame, names: DataFrame, k: int = 6) -> DataFrame:
    """The players who created most expected threat, and each team's sum."""
    best = called(top(created, "xt_created", k, "entity_id"), names, player="entity_id")
    teams = created.groupBy("match_id", "team").agg(F.round(F.sum("xt_created"), 4).alias("xt_created"))
    return told(best, _list("expected_threat.top_players"), "player", "xt_created", "n_moves").unionByName(told(teams, F.concat(F.lit("expected_threat.team_created."), "team"), "xt_created"))


def marking_facts(scores: DataFrame, names: DataFrame, k: int = 6) -> DataFrame:
    """Each team's scheme and score in open play, and its k pairs of the largest share."""
    path = F.concat(F.lit("marking."), F.col("defending_team"))
    teams = scores.groupBy("match_id", "defending_team").agg(F.round(F.max("team_score"), 3).alias("man_score"), F.max("scheme").alias("scheme"))
    pairs = called(top(scores, "share", k, "defender_id", by=("defending_team",)), names, defender="defender_id", marks="attacker_id")
    return told(teams, path, "scheme", "man_score").unionByName(told(pairs, F.concat(path, F.lit(".pairs."), F.col("place").cast("string")), "defender", "marks", "share"))


def role_facts(roles: DataFrame, mismatches: DataFrame, names: DataFrame) -> DataFrame:
    """Each player's role, and those who play another role than their place says."""
    own = told(called(roles, names, player="entity_id"), F.concat(F.lit("roles.by_player."), F.col("entity_id").cast("string")), "player", "role")
    order = Window.partitionBy("match_id").orderBy("entity_id")
    odd = called(mismatches, names, player="entity_id").withColumns({"place": F.row_number().over(order) - 1, "nominal": F.col("nominal_slot"), "discovered": F.col("discovered_role")})
    return own.unionByName(told(odd, _list("roles.nominal_vs_actual"), "player", "nominal", "discovered"))


def audit(reports: DataFrame, known: DataFrame) -> DataFrame:
    """(match_id, n_claims, n_grounded, grounded_share) of reports (match_id, text).

    A number in the body counts as grounded if, at its own precision, it is a
    fact of the match or a hundred times one, numbers in facts that are text
    included. Formations and shirts are not numbers; a report without numbers
    is grounded.
    """
    bare = lambda text: F.regexp_replace(F.regexp_replace(text, FORMATION, " "), SHIRT, " ")
    if "text" in known.columns:
        inside = known.select("match_id", F.explode(F.regexp_extract_all(bare(F.col("text")), F.lit(NUMBER), F.lit(0))).alias("n"))
        known = known.where("value is not null").select("match_id", "value").unionByName(inside.select("match_id", F.col("n").cast("double").alias("value")))
    body = bare(F.substring_index("text", APPENDIX, 1))
    claims = reports.select("match_id", F.posexplode_outer(F.regexp_extract_all(body, F.lit(NUMBER), F.lit(0))).alias("i", "claim"))
    decimals = F.length(F.regexp_extract("claim", r"\.(\d+)", 1))
    sized = claims.withColumns({"said": F.col("claim").cast("double"), "near": 0.5 * F.pow(F.lit(10.0), -decimals) + 1e-9})
    fit = (F.abs(F.col("value") - F.col("said")) <= F.col("near")) | (F.abs(100 * F.col("value") - F.col("said")) <= F.col("near"))
    joined = sized.join(known.select("match_id", "value"), "match_id", "left").groupBy("match_id", "i", "claim").agg(F.max(F.coalesce(fit, F.lit(False)).cast("int")).alias("ok"))
    counted = joined.groupBy("match_id").agg(F.count("claim").alias("n_claims"), F.sum(F.when(F.col("claim").isNotNull(), F.col("ok")).otherwise(0)).alias("n_grounded"))
    return counted.withColumn("grounded_share", F.when(F.col("n_claims") == 0, 1.0).otherwise(F.col("n_grounded") / F.col("n_claims")))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))


def expanded(question: Column) -> Column:
    """The words of a question and what they stand for by SYNONYMS, as one array."""
    terms = _words(question)

    def meant(key: str, words: list[str]) -> Column:
        near = F.exists(terms, lambda t: t.startswith(key) | F.startswith(F.lit(key), t))
        return F.when(near, F.array(*(F.lit(w.replace(" ", "_")) for w in (key, *words)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(terms, *(meant(k, w) for k, w in SYNONYMS.items())))


def retrieve(questions: DataFrame, known: DataFrame, k: int = 8) -> DataFrame:
    """(match_id, question, path, value, score), and text if the facts have it: the k facts of a question's match whose path shares most words with the expanded question, ties by path; none without a shared word."""
    met = questions.withColumn("_words", expanded(F.col("question"))).join(known, "match_id").withColumn("score", F.size(F.array_intersect("_words", _words(F.col("path"))))).where("score > 0")
    place = F.row_number().over(Window.partitionBy("match_id", "question").orderBy(F.desc("score"), "path"))
    return met.withColumn("place", place).where(F.col("place") <= k).select("match_id", "question", "path", "value", *(["text"] if "text" in known.columns else []), "score")


def _said(value: Column, decimals: int) -> Column:
    """The number as text with fixed decimals, halves up."""
    return F.round(value, decimals).cast(f"decimal(24,{decimals})").cast("string")


def answers(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(match_id, question, answer, n_evidence): the facts that fit best, to three decimals, or the refusal where none fits."""
    found = retrieve(questions, known)
    number = _said(F.col("value"), 3)
    line = F.concat(F.lit("- `"), "path", F.lit("` = "), F.coalesce("text", number) if "text" in known.columns else number)
    told = found.groupBy("match_id", "question").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "path", line.alias("line")))).alias("rows"))
    text = F.concat(F.lit("Closest computed metrics:\n"), F.array_join(F.col("rows.line"), "\n"))
    return questions.join(told, ["match_id", "question"], "left").select("match_id", "question", F.coalesce(text, F.lit(REFUSAL)).alias("answer"), F.coalesce(F.size("rows"), F.lit(0)).alias("n_evidence"))


def written(known: DataFrame) -> DataFrame:
    """(match_id, text): a report made of the match's facts by fixed sentences; a sentence whose facts are missing is left out."""
    by_path = known.groupBy("match_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value")))).alias("at"))

    def value(path: str, decimals: int, times: int = 1) -> Column:
        return _said(F.try_element_at("at", F.lit(path)) * times, decimals)

    def sentence(*parts) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    lines = [F.lit("# Match Report"), F.lit("## Executive Summary")]
    for team in ("home", "away"):
        lines.append(sentence(f"The {team} team had ", value(f"possession.{team}.share", 0, 100), "% of the ball, in ", value(f"possession.{team}.n_spells", 0), " spells."))
        lines.append(sentence("Its part of the field tilt was ", value(f"field_tilt.{team}.tilt", 2), "."))
        lines.append(sentence("It let the opponent make ", value(f"ppda.{team}.ppda", 1), " passes for each defensive action."))
    lines.append(F.lit("## Tactical Narrative"))
    for team in ("home", "away"):
        lines.append(sentence(f"Without the ball the {team} team's line stood ", value(f"shape.{team}.out_line", 1), " m from goal, its depth was ", value(f"shape.{team}.out_depth", 1), " m."))
        lines.append(sentence(f"The {team} team pressed ", value(f"pressing.{team}.pressures", 0), " times, ", value(f"pressing.{team}.press_to_turnover_rate", 0, 100), "% of them with a turnover soon after."))
        lines.append(sentence("It completed ", value(f"events.{team}.completed", 0), " of ", value(f"events.{team}.passes", 0), " passes."))
        lines.append(sentence(f"Passes of the {team} team that broke a line: ", value(f"line_breaking.{team}.total", 0), "."))
    lines.append(F.lit("## Physical"))
    for team in ("home", "away"):
        lines.append(sentence(f"The {team} team ran ", value(f"physical.{team}.distance_m", 0), " m with ", value(f"physical.{team}.sprints", 0), " sprints."))
    every = F.transform(F.map_entries("at"), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), _said(e["value"], 4)))
    return by_path.select("match_id", F.concat_ws("\n", *lines, F.lit(APPENDIX), F.array_join(every, "\n")).alias("text"))


def narrative(known: DataFrame) -> DataFrame:
    """(match_id, text): the whole report of facts (match_id, path, value, text) in six sections; a sentence whose facts are missing is left out.

    Summary, tactics, key players, defensive schemes, notes, and all facts in
    the appendix. Facts without a match make a report without a match.
    """
    one = F.when(F.col("value").isNotNull(), _said(F.col("value"), 4)).otherwise(F.col("text"))
    facts_of = known.groupBy("match_id", "path").agg(F.min("value").alias("value"), F.min("text").alias("text")).withColumn("line", F.concat(F.lit("- "), "path", F.lit(": "), one))
    at = facts_of.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct("value", "text")))).alias("at"), F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("every"))

    def fact(path: str) -> Column:
        return F.try_element_at("at", F.lit(path))

    def n(path: str, decimals: int = 0, times: int = 1) -> Column:
        return _said(fact(path)["value"] * times, decimals)

    def w(path: str) -> Column:
        return fact(path)["text"]

    def line(*parts) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    both, name = ("home", "away"), {"home": "Home", "away": "Away"}
    share, ppda = {t: fact(f"possession.{t}.share")["value"] for t in both}, {t: fact(f"ppda.{t}.ppda")["value"] for t in both}
    ahead, presses = F.when(share["home"] >= share["away"], "Home").when(share["home"] < share["away"], "Away"), F.when(ppda["home"] < ppda["away"], "Home").when(ppda["home"] >= ppda["away"], "Away")
    lines = [
        F.lit("# Match Report"), F.lit("## Executive Summary"), line(ahead, " controlled the ball with ", _said(F.greatest(*share.values()) * 100, 0), "% of possession."),
        line("Field tilt of Home was ", n("field_tilt.home.tilt", 2), "."), line("The more aggressive press came from ", presses, " (PPDA ", _said(F.least(*ppda.values()), 1), " against ", _said(F.greatest(*ppda.values()), 1), ")."),
        line("Data confidence: **", w("data_quality.overall"), "**."), F.lit("## Tactical Narrative"),
    ]
    for t in both:
        f = f"formations.{t}"
        lines += [
            line(f"**{name[t]}** stood in a ", w(f"{f}.in_possession.formation"), " with the ball (width ", n(f"{f}.in_possession.avg_width_m", 1), " m)."), line(f"**{name[t]}** stood in a ", w(f"{f}.out_possession.formation"), " without it."),
            line(f"Off the ball {name[t]} defended in a ", w(f"shape.{t}.block_label"), ", its line ", n(f"shape.{t}.out_line", 1), " m from goal, ", n(f"shape.{t}.out_depth", 1), " m deep."),
            line(f"{name[t]} pressed ", n(f"pressing.{t}.pressures"), " times (", n(f"pressing.{t}.pressures_per_min", 1), " a minute), and ", n(f"pressing.{t}.press_to_turnover_rate", 0, 100), "% of it ended in a turnover."),
            line(f"{name[t]} completed ", n(f"events.{t}.completed"), " of ", n(f"events.{t}.passes"), " passes."), line(f"Passes of {name[t]} that broke a line: ", n(f"line_breaking.{t}.total"), "."), line(f"Counter-attacks of {name[t]}: ", n(f"counter_attacks.{t}.total"), "."),
        ]
    lines.append(F.lit("## Key Players"))
    threat, far, fast = "expected_threat.top_players", "physical.top_distance_per_min", "physical.top_speed"
    lines += [line("- ", w(f"{threat}.{i}.player"), " created threat of ", n(f"{threat}.{i}.xt_created", 3), " in ", n(f"{threat}.{i}.n_moves"), " moves.") for i in range(3)]
    lines += [line("- ", w(f"{far}.{i}.player"), " covered ", n(f"{far}.{i}.value_m_per_min"), " m a minute with ", n(f"{far}.{i}.sprints"), " sprints.") for i in range(2)]
    lines.append(line("- ", w(f"{fast}.0.player"), " was the fastest at ", n(f"{fast}.0.value_mps", 1), " m/s."))
    for t in both:
        lines += [line("- ", w(f"pass_network.{t}.most_central_player"), f" was the hub of {name[t]}'s passes."), line(f"- Most frequent combination of {name[t]}: ", w(f"pass_network.{t}.top_combination"), ".")]
    lines.append(F.lit("## Defensive Schemes"))
    for t in both:
        lines.append(line(f"**{name[t]}**: ", w(f"marking.{t}.scheme"), " (man score ", n(f"marking.{t}.man_score", 2), ")."))
        lines += [line("- ", w(f"marking.{t}.pairs.{i}.defender"), " marked ", w(f"marking.{t}.pairs.{i}.marks"), " in ", n(f"marking.{t}.pairs.{i}.share", 0, 100), "% of samples.") for i in range(4)]
    lines.append(F.lit("## Watch-outs & Data Notes"))
    odd = "roles.nominal_vs_actual"
    lines += [line("- ", w(f"{odd}.{i}.player"), " has the place ", w(f"{odd}.{i}.nominal"), " but plays as ", w(f"{odd}.{i}.discovered"), ".") for i in range(5)]
    lines += [F.lit("- Events are derived from tracking, so what depends on the ball inherits its noise."), line("- ", w("data_quality.notes"), ".")]
    return at.select("match_id", F.concat_ws("\n", *lines, F.lit(APPENDIX), "every").alias("text"))
