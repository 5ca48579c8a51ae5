"""Lists of matches, frame rates, calibration samples and states of jobs."""

from __future__ import annotations

import json

import pytest

from touchline.sources import formats


def test_match_list(spark, tmp_path):
    rows = [{"match_id": 7, "match_date": "2021-01-02", "home_team": {"home_team_name": "A"}, "away_team": {"away_team_name": "B"}, "home_score": 2, "away_score": 0}, {"match_id": 8, "home_team": {"home_team_name": "C"}}]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    assert [tuple(r) for r in formats.read_match_list(spark, str(tmp_path / "m.json")).orderBy("match_id").collect()] == [("7", "A", "B", "2-0", "2021-01-02"), ("8", "C", None, None, None)]


@pytest.mark.parametrize("text, fps", [("[Sequence]\nname=x\nframeRate=30\n", 30.0), ("[Sequence]\nframerate = 29.97\n[Other]\nframeRate=5\n", 29.97), ("[Other]\nframeRate=5\n", 25.0), ("", 25.0), ("[Sequence]\nname=x\n[Other]\nframeRate=5\n", 25.0)])
def test_frame_rate(spark, tmp_path, text, fps):
    (tmp_path / "seqinfo.ini").write_text(text)
    found = [r["fps"] for r in formats.read_frame_rate(spark, str(tmp_path)).collect()]
    assert found == ([fps] if text or found else [])


def test_calibration_samples(spark, tmp_path):
    for name in ("a", "b", "c.d"):
        (tmp_path / f"{name}.jpg").write_bytes(name.encode())
    (tmp_path / "a.json").write_text(json.dumps({"Side line top": [{"x": 0.1, "y": 0.2}, {"x": 0.3, "y": 0.4}]}, indent=1))
    (tmp_path / "c.d.json").write_text("{}")
    (tmp_path / "lonely.json").write_text("{}")
    found = {r["sample"]: r for r in formats.read_calibration_samples(spark, str(tmp_path)).collect()}
    assert sorted(found) == ["a", "c.d"] and bytes(found["a"]["image"]) == b"a" and found["c.d"]["lines"] == {}
    assert [tuple(p) for p in found["a"]["lines"]["Side line top"]] == [(0.1, 0.2), (0.3, 0.4)]


def test_states_of_jobs(spark, tmp_path):
    path = str(tmp_path / "status")
    row = lambda *v: spark.createDataFrame([v], formats.STATUS)
    formats.add_status(row("m", "running", "track", 0.123456, "", 1.0), path)
    formats.add_status(row("m", "done", "report", 7.0, "ready", 2.0), path)
    formats.add_status(row("n", "error", "track", None, "no file", 5.0), path)
    (tmp_path / "status" / "broken.json").write_text('{"match_id": "m", "state"')
    wanted = spark.createDataFrame([("m",), ("n",), ("new",), ("m",)], "match_id string")
    found = {r["match_id"]: (r["state"], r["stage"], r["progress"], r["message"]) for r in formats.latest_status(spark, path, wanted).collect()}
    assert found == {"m": ("done", "report", 1.0, "ready"), "n": ("error", "track", 0.0, "no file"), "new": ("unknown", "", 0.0, "")}
