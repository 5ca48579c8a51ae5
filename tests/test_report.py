"""Facts in words, facts with names, and the report made of them."""

from __future__ import annotations

import pytest

from touchline.operators import report
from touchline.plans import queries

FOLDER = "/root/testdata/sf0.001"


def test_labels_and_ids_without_one(spark):
    seen = spark.createDataFrame([("m", 7, "player", "home", 9, 1.0, 1.0), ("m", 7, "player", "home", 9, 1.0, 1.0), ("m", 7, "player", "home", 4, 1.0, 1.0), ("m", 8, "player", "away", None, 1.0, 1.0)], "match_id string, entity_id int, class string, team string, jersey_no smallint, x double, y double")
    names = report.labels(seen)
    rows = spark.createDataFrame([("m", 7), ("m", 8), ("m", 5), ("m", None)], "match_id string, who int")
    found = {r["who"]: r["name"] for r in report.called(rows, names, name="who").collect()}
    assert found == {7: "#9 (Home)", 8: "player 8 (Away)", 5: "player 5", None: None}


def test_top_breaks_ties_by_id_and_counts_from_zero(spark):
    rows = spark.createDataFrame([(0, 3, 1.0), (0, 2, 1.0), (0, 1, None), (0, 4, 0.5), (1, 9, 0.1)], "match_id int, entity_id int, v double")
    assert sorted((r["match_id"], r["place"], r["entity_id"]) for r in report.top(rows, "v", 2, "entity_id").collect()) == [(0, 0, 2), (0, 1, 3), (1, 0, 9)]


def test_facts_of_formations_threat_marking_and_roles(spark):
    names = spark.createDataFrame([("m", 2, "#2 (Home)"), ("m", 12, "#12 (Away)")], "match_id string, entity_id int, label string")
    shapes = spark.createDataFrame([("m", "home", "in", "4-3-3", 0.5, 900.04, 40.06, 30.0, 1), ("m", "home", "out", "4-4-2", 1.0, 700.0, 35.0, 25.0, 0), ("m", "away", "in", "3-5-2", 1.0, 1.0, 1.0, 1.0, 0)], "match_id string, team string, state string, formation string, stability double, mean_hull_m2 double, mean_width_m double, mean_depth_m double, n_transitions long")
    at = {r["path"]: r["value"] if r["text"] is None else r["text"] for r in report.formation_facts(shapes).collect()}
    assert at["formations.home.in_possession.formation"] == "4-3-3" and at["formations.home.in_possession.avg_width_m"] == 40.1
    assert at["formations.home.shape_morph"] == "4-3-3 with the ball, 4-4-2 without it" and "formations.away.shape_morph" not in at

    created = spark.createDataFrame([("m", 2, "home", 0.25, 3), ("m", 12, "away", 0.5, 1)], "match_id string, entity_id int, team string, xt_created double, n_moves long")
    at = {r["path"]: r["value"] if r["text"] is None else r["text"] for r in report.threat_facts(created, names).collect()}
    assert at["expected_threat.top_players.0.player"] == "#12 (Away)" and at["expected_threat.top_players.1.xt_created"] == 0.25 and at["expected_threat.team_created.home.xt_created"] == 0.25

    scores = spark.createDataFrame([("m", "home", 2, 12, 0.75, 0.8, "man")] + [("m", "home", i, 12, 0.1, 0.8, "man") for i in range(20, 30)], "match_id string, defending_team string, defender_id int, attacker_id int, share double, team_score double, scheme string")
    at = {r["path"]: r["value"] if r["text"] is None else r["text"] for r in report.marking_facts(scores, names).collect()}
    assert at["marking.home.scheme"] == "man" and at["marking.home.pairs.0.marks"] == "#12 (Away)" and at["marking.home.pairs.5.defender"] == "player 24" and "marking.home.pairs.6.share" not in at

    roles = spark.createDataFrame([("m", 2, "winger")], "match_id string, entity_id int, role string")
    odd = spark.createDataFrame([("m", 2, "RB", "winger")], "match_id string, entity_id int, nominal_slot string, discovered_role string")
    at = {r["path"]: r["text"] for r in report.role_facts(roles, odd, names).collect()}
    assert at["roles.by_player.2.role"] == "winger" and at["roles.nominal_vs_actual.0.nominal"] == "RB"


def test_narrative_has_all_sections_and_is_grounded(spark):
    facts = [
        ("m", "possession.home.share", 0.4, None), ("m", "possession.away.share", 0.6, None), ("m", "ppda.home.ppda", 8.04, None), ("m", "ppda.away.ppda", 11.0, None),
        ("m", "formations.home.in_possession.formation", None, "4-3-3"), ("m", "formations.home.in_possession.avg_width_m", 41.5, None),
        ("m", "expected_threat.top_players.0.player", None, "#10 (Away)"), ("m", "expected_threat.top_players.0.xt_created", 0.1234, None), ("m", "expected_threat.top_players.0.n_moves", 7.0, None),
        ("m", "marking.home.scheme", None, "zonal"), ("m", "marking.home.man_score", 0.31, None), ("m", "data_quality.overall", None, "medium"), ("m", "data_quality.notes", None, "ball observed in 55% of frames"),
        ("m", "possession.home.share", 0.4, None),
    ]
    known = spark.createDataFrame(facts, "match_id string, path string, value double, text string")
    told = report.narrative(known)
    text = told.first()["text"]
    for part in ("Away controlled the ball with 60% of possession", "came from Home (PPDA 8.0 against 11.0)", "a 4-3-3 with the ball (width 41.5 m)", "#10 (Away) created threat of 0.123 in 7 moves", "**Home**: zonal (man score 0.31)", "- ball observed in 55% of frames.", "confidence: **medium**"):
        assert part in text, part
    assert [x for x in text.split("\n") if x.startswith("## ")] == ["## Executive Summary", "## Tactical Narrative", "## Key Players", "## Defensive Schemes", "## Watch-outs & Data Notes", report.APPENDIX]
    checked = report.audit(told, known).first()
    assert checked["n_claims"] == 8 and checked["grounded_share"] == 1.0
    assert report.narrative(known.limit(0)).count() == 0


def test_answers_quote_words(spark):
    known = spark.createDataFrame([(0, "marking.home.scheme", None, "man"), (0, "marking.home.man_score", 0.75, None)], "match_id int, path string, value double, text string")
    asked = spark.createDataFrame([(0, "Who was marked?")], "match_id int, question string")
    assert report.answers(asked, known).first()["answer"] == "Closest computed metrics:\n- `marking.home.man_score` = 0.750\n- `marking.home.scheme` = man"


def test_narrative_of_the_derived_match_is_grounded(spark):
    known = queries._stored(queries._every_fact(spark, FOLDER))
    at = {r["path"]: r["value"] if r["text"] is None else r["text"] for r in known.where("match_id = 0").collect()}
    best = sorted((-round(r["xt_created"], 9), r["entity_id"]) for r in queries.player_xt(spark, FOLDER).where("match_id = 0").collect())[:6]
    assert [-round(at[f"expected_threat.top_players.{i}.xt_created"], 9) for i in range(len(best))] == [b for b, _ in best]
    assert [at[f"expected_threat.top_players.{i}.player"].split(" ")[0] for i in range(len(best))] == [f"#{e}" for _, e in best]
    modal = {(r["team"], r["state"]): r["formation"] for r in queries.formation_summary(spark, FOLDER).where("match_id = 0").collect()}
    assert {k: at[f"formations.{k[0]}.{k[1]}_possession.formation"] for k in modal} == modal
    checked = report.audit(report.narrative(known), known).collect()
    assert checked and all(r["grounded_share"] == pytest.approx(1.0) and r["n_claims"] > 20 for r in checked)
