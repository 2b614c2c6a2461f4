"""Sources and sinks: typed readers, nested match records, badges, replay pages, history files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import match_id, normalize_tag

ITEM = "struct<name:string,level:int,maxLevel:int,elixirCost:int,evolutionLevel:int>"
SIDE = f"struct<tag:string,name:string,crowns:int,startingTrophies:int,trophyChange:int,kingTowerHitPoints:int,elixirLeaked:double,cards:array<{ITEM}>>"
MATCH = f"struct<type:string,battleTime:string,isLadderTournament:boolean,arena:struct<id:int,name:string>,gameMode:struct<id:int,name:string>,team:array<{SIDE}>,opponent:array<{SIDE}>>"
PROFILE = "struct<tag:string,name:string,expLevel:int,trophies:int,bestTrophies:int,wins:int,losses:int,battleCount:int,clan:struct<tag:string,name:string>,arena:struct<id:int,name:string>>"


def read_source(spark: SparkSession, where: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """A table with a fixed schema from files, or from a database url with options (dbtable, partitionColumn, bounds)."""
    if where.startswith("jdbc:"):
        return spark.read.format("jdbc").option("url", where).options(**options).load()
    return spark.read.schema(schema).format(fmt).options(**options).load(where)


def parse_time(c: Column) -> Column:
    """20260228T200232.000Z as a timestamp; null where malformed."""
    return F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss.SSSX"))


def flatten_matches(raw: DataFrame, json: str = "raw") -> DataFrame:
    """One row a match record: keys, both sides' scores and ratings, the result by scores, the time. Broken records give none."""
    d = raw.select(F.from_json(F.col(json), MATCH).alias("j"), F.col(json).alias("raw")).where("j.team[0] is not null and j.opponent[0] is not null")
    own, opp = F.col("j.team")[0], F.col("j.opponent")[0]
    result = F.when(own["crowns"] > opp["crowns"], "win").when(own["crowns"] < opp["crowns"], "loss").otherwise("draw")
    return d.select(
        match_id(F.col("j.battleTime"), normalize_tag(own["tag"]), normalize_tag(opp["tag"])).alias("match_id"),
        parse_time(F.col("j.battleTime")).alias("ts"),
        F.col("j.type").alias("kind"),
        F.col("j.arena.name").alias("arena"),
        normalize_tag(own["tag"]).alias("entity"),
        normalize_tag(opp["tag"]).alias("opponent"),
        result.alias("result"),
        own["crowns"].alias("own_score"),
        opp["crowns"].alias("opp_score"),
        (own["crowns"] - opp["crowns"]).alias("differential"),
        own["startingTrophies"].alias("own_rating"),
        opp["startingTrophies"].alias("opp_rating"),
        own["trophyChange"].alias("change"),
        own["elixirLeaked"].alias("leaked"),
        "raw",
    )


def explode_rosters(raw: DataFrame, json: str = "raw") -> DataFrame:
    """One row for each item of each side of a match record."""
    d = raw.select(F.from_json(F.col(json), MATCH).alias("j")).where("j.team[0] is not null and j.opponent[0] is not null")
    key = match_id(F.col("j.battleTime"), normalize_tag(F.col("j.team")[0]["tag"]), normalize_tag(F.col("j.opponent")[0]["tag"])).alias("match_id")
    side = lambda name, flag: d.select(key, F.lit(flag).alias("is_player"), F.explode(F.col(f"j.{name}")[0]["cards"]).alias("c")).select("match_id", "is_player", "c.*")
    return side("team", 1).unionByName(side("opponent", 0))


def flatten_profiles(raw: DataFrame, json: str = "raw") -> DataFrame:
    d = raw.select(F.from_json(F.col(json), PROFILE).alias("j"))
    return d.select(normalize_tag("j.tag").alias("entity"), "j.name", "j.expLevel", "j.trophies", "j.bestTrophies", "j.wins", "j.losses", "j.battleCount", F.col("j.clan.tag").alias("clan"), F.col("j.arena.name").alias("arena"))


def badge_value(badges: Column, name: str) -> Column:
    """struct(level, progress) of the named badge; null if absent."""
    hit = F.filter(badges, lambda b: b["name"] == name)
    return F.when(F.size(hit) > 0, F.struct(hit[0]["level"].alias("level"), hit[0]["progress"].alias("progress")))


def badge_mastery(df: DataFrame, badges: str, key: str, prefix: str = "Mastery") -> DataFrame:
    """One row for each badge whose name begins with prefix; the rest of the name is the item."""
    rows = df.select(key, F.explode(F.filter(badges, lambda b: b["name"].startswith(prefix))).alias("b"))
    return rows.select(key, F.substring("b.name", len(prefix) + 1, 200).alias("item"), "b.level", "b.progress")


def mode_progress(df: DataFrame, json: str, key: str) -> DataFrame:
    """Rows of an undocumented map {mode: {…}}; every field may be missing."""
    m = F.from_json(F.col(json), "map<string,struct<arena:string,trophies:int,bestTrophies:int>>")
    return df.select(key, F.explode(m).alias("mode", "v")).select(key, "mode", "v.*")


def parse_replay(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Marker tags with data-x, -y, -c, -t, -i, -s attributes as event rows; a page without markers gives none."""
    tags = F.regexp_extract_all(html, F.lit(r"(<[^>]*\bdata-t=[^>]*>)"), F.lit(1))
    at = lambda name: F.regexp_extract("tag", rf'data-{name}="([^"]*)"', 1)
    return pages.select(key, F.posexplode(tags).alias("n", "tag")).select(
        key, "n", at("x").try_cast("int").alias("x"), at("y").try_cast("int").alias("y"), at("t").try_cast("int").alias("tick"), F.nullif(at("c"), F.lit("")).alias("item"), F.nullif(at("i"), F.lit("")).alias("play"), F.nullif(at("s"), F.lit("")).alias("side")
    )


def duration_seconds(c: Column) -> Column:
    """m:ss as seconds; null where malformed."""
    return F.regexp_extract(c, r"^\s*(\d+):(\d{2})\s*$", 1).try_cast("int") * 60 + F.regexp_extract(c, r"^\s*(\d+):(\d{2})\s*$", 2).try_cast("int")


def export(df: DataFrame, path: str, fmt: str = "json") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def publish(results: dict[str, DataFrame], path: str) -> None:
    """One table a result under path."""
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def label_counts(units: DataFrame) -> DataFrame:
    """units(file, units array<struct<card_name, team, status, action>>) -> counts per field and value."""
    u = units.select(F.explode("units").alias("u"))
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"u.{f}").alias("value")) for f in ("card_name", "team", "status", "action")))
    return u.select(F.explode(fields).alias("x")).where("x.value is not null").groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))
