"""Golden records for the semi-structured sources."""

import json

from matchloom.sources import ingest as I

SIDE = {"tag": "abc", "name": "n", "crowns": 3, "startingTrophies": 5000, "trophyChange": 30, "elixirLeaked": 1.5, "cards": [{"name": "Knight", "level": 11, "maxLevel": 14, "elixirCost": 3}, {"name": "Archers", "level": 9, "maxLevel": 14, "elixirCost": 3, "evolutionLevel": 1}]}
MATCH = {"type": "PvP", "battleTime": "20260228T200232.000Z", "arena": {"id": 1, "name": "A"}, "team": [SIDE], "opponent": [{**SIDE, "tag": "#XYZ", "crowns": 1}]}


def frame(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) or v is None else json.dumps(v),) for v in values], "raw string")


def test_flatten_matches(spark):
    rows = I.flatten_matches(frame(spark, MATCH, "{broken", None, {**MATCH, "battleTime": "later"})).collect()
    assert len(rows) == 2
    r = rows[0]
    assert (r.entity, r.opponent, r.result, r.own_score, r.opp_score, r.differential, r.own_rating, r.change) == ("#ABC", "#XYZ", "win", 3, 1, 2, 5000, 30)
    assert r.ts.isoformat() == "2026-02-28T20:02:32" and len(r.match_id) == 32
    assert rows[1].ts is None and rows[1].match_id != r.match_id


def test_explode_rosters(spark):
    rows = I.explode_rosters(frame(spark, MATCH)).collect()
    assert len(rows) == 4 and {(r.is_player, r.name, r.evolutionLevel) for r in rows} == {(1, "Knight", None), (1, "Archers", 1), (0, "Knight", None), (0, "Archers", 1)}


def test_profiles_badges_modes(spark):
    p = {"tag": "q", "name": "x", "expLevel": 50, "trophies": 6000, "wins": 10, "clan": {"tag": "#C", "name": "c"}}
    r = I.flatten_profiles(frame(spark, p)).first()
    assert (r.entity, r.expLevel, r.clan, r.arena) == ("#Q", 50, "#C", None)
    d = spark.createDataFrame([("k", [("MasteryKnight", 3, 10), ("Other", 1, 2)], '{"m1": {"arena": "a", "trophies": 5}, "m2": {}}')], "id string, b array<struct<name:string,level:int,progress:int>>, j string")
    assert [tuple(x) for x in I.badge_mastery(d, "b", "id").collect()] == [("k", "Knight", 3, 10)]
    v = d.select(I.badge_value(d["b"], "Other").alias("o"), I.badge_value(d["b"], "No").alias("n")).first()
    assert tuple(v.o) == (1, 2) and v.n is None
    assert sorted((x.mode, x.trophies) for x in I.mode_progress(d, "j", "id").collect()) == [("m1", 5), ("m2", None)]


def test_parse_replay(spark):
    html = '<div data-x="900" data-y="1200" data-c="knight" data-t="340" data-i="1" data-s="team"><span>1</span></div><div data-x="?" data-t="9">'
    d = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    rows = sorted(I.parse_replay(d).collect(), key=lambda r: r.n)
    assert [(r.page_id, r.x, r.y, r.tick, r.item, r.side) for r in rows] == [(1, 900, 1200, 340, "knight", "team"), (1, None, None, 9, None, None)]
    t = spark.createDataFrame([("3:05",), ("x",), (None,)], "t string")
    assert [r[0] for r in t.select(I.duration_seconds(t["t"])).collect()] == [185, None, None]


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "k")
    for fmt in ("json", "csv"):
        I.export(df, str(tmp_path / fmt), fmt)
    assert I.read_source(spark, str(tmp_path / "json"), "k long", "json").count() == 5
    I.append_history(df, str(tmp_path / "h"))
    I.append_history(df, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 10
    I.publish({"a": df}, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/a")).count() == 5


def test_label_counts(spark):
    d = spark.createDataFrame([([("c", "team", "ok", None), ("c", "opp", "ok", "add")],)], "units array<struct<card_name:string,team:string,status:string,action:string>>")
    assert {(r.field, r.value): r.n for r in I.label_counts(d).collect()} == {("card_name", "c"): 2, ("team", "team"): 1, ("team", "opp"): 1, ("status", "ok"): 2, ("action", "add"): 1}
