"""A mod manager's instance: its settings, enabled mods by priority, and the load order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

# --- Fixed values: plugins that load first, in this order, whether listed or not ----------------
IMPLICIT_MASTERS = ["Skyrim.esm", "Update.esm", "Dawnguard.esm", "HearthFires.esm", "Dragonborn.esm", "ccBGSSSE001-Fish.esm", "ccQDRSSE001-SurvivalMode.esl", "ccBGSSSE037-Curios.esl", "ccBGSSSE025-AdvDSGS.esm", "_ResourcePack.esl"]
# ----------------------------------------------------------------------------------------------


@dataclass
class Instance:
    root: str
    profile: str
    settings: DataFrame  # section, key, value
    mods: DataFrame  # priority, mod, enabled
    active: DataFrame  # pos, plugin


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, root: str, ini: str = "ModOrganizer.ini", profile: str | None = None) -> Instance:
    """Read the instance below ``root``; an override of the profile wins over the setting. Missing files are an error."""
    if not exists(spark, f"{root}/{ini}"):
        raise FileNotFoundError(f"{root}/{ini}")
    settings = files.ini(spark, f"{root}/{ini}")
    if profile is None:
        found = settings.where("section = 'General' and key = 'selected_profile'").select(F.regexp_extract("value", r"^(?:@ByteArray\()?(.*?)\)?$", 1)).first()
        if not found or not found[0]:
            raise ValueError("no profile is selected")
        profile = found[0]
    base = f"{root}/profiles/{profile}"
    for name in ("modlist.txt", "plugins.txt"):
        if not exists(spark, f"{base}/{name}"):
            raise FileNotFoundError(f"{base}/{name}")
    return Instance(root, profile, settings, files.mod_list(spark, f"{base}/modlist.txt"), files.active_plugins(spark, f"{base}/plugins.txt"))


def order(spark: SparkSession, instance: Instance, present: DataFrame, forced: DataFrame) -> DataFrame:
    """pos, plugin of the plugins that are there: implicit masters, forced ones by name, active ones. present, forced: plugin."""
    implicit = spark.createDataFrame(list(enumerate(IMPLICIT_MASTERS)), "pos int, plugin string")
    all_ = files.load_order(implicit, forced, instance.active)
    there = present.select(F.lower("plugin").alias("_k")).distinct()
    return all_.join(F.broadcast(there), F.lower("plugin") == F.col("_k"), "left_semi")  # a load order is a list of files


def staged(winners: DataFrame, game: DataFrame) -> DataFrame:
    """String files that count: the mods' winners, and the game's own where no mod has one. Both: path, location."""
    key = lambda df: df.withColumn("_k", F.lower("path"))
    w = key(winners)
    return w.unionByName(key(game).join(w.select("_k"), "_k", "left_anti")).drop("_k")
