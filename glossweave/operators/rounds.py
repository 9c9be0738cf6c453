"""Translation of open texts by an external translator in resumable rounds.

The state is a table in a shared folder: one row for each text that a batch has sent, with its answer or the reason why there is none.
A round is one Spark job whose rows are appended as a whole, so a run that stops, for whatever reason, goes on after
its last whole round and sends no text again that has an answer. In a round every lane sends one batch; a plugin's texts are dealt
into lanes by hash, as many as its number of texts needs, so a hot plugin is many lanes. What a round answers are hints of the
next one, to all lanes of the plugin. A pass gives every open text one chance; passes go on while they bring answers.

Batches are planned in Spark: a lane's texts in order up to the limit of characters, hints by the words they share
with a batch, and fewer texts until batch and hints fit. A task guards its translator with retries and a breaker; a round in which every call
fails ends the run. A flag file ends it between rounds.

Defined results: null and blank texts are never sent; repeated texts of a plugin are sent once; a null plugin is a plugin; a text
longer than the limit is a batch of its own without hints; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..plans.session import checkpoint, checkpoint_dir
from .batch import LOCAL_CHARS, Guarded, Translator, match_back

#: Texts that a lane holds about; known texts of a plugin that one word can bring as hints.
LANE_TEXTS, WORD_HINTS = 500, 40
STATE = "plugin string, text string, japanese string, error string, truncated boolean, calls int, lane int, pass int"


@dataclass
class Options:
    """How texts are shown to the translator. ``block``: what a text takes of the limit, ``flatten`` and ``unflatten``: a text's
    form on one line and back, ``instructions``: what stands before every batch (it does not count)."""

    chars: int = LOCAL_CHARS
    hint_share: float = 0.25
    top_hints: int = 10
    block: Callable[[Column], Column] = lambda text: text
    flatten: Callable[[Column], Column] = X.flatten_lines
    unflatten: Callable[[Column], Column] = X.restore_lines
    instructions: str = ""
    cancel_file: str | None = None
    max_rounds: int | None = None


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def finished_rounds(spark: SparkSession, state: str) -> int:
    """How many rounds of a state folder are whole."""
    n = 0
    while _exists(spark, f"{state}/round-{n}/_SUCCESS"):
        n += 1
    return n


def read_state(spark: SparkSession, state: str) -> DataFrame:
    paths = [f"{state}/round-{k}" for k in range(finished_rounds(spark, state))]
    return spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)


def lanes(texts: DataFrame) -> DataFrame:
    """``texts`` (plugin, text) with ``lane``; as many lanes a plugin as its number of texts needs."""
    need = texts.groupBy("plugin").agg(F.ceil(F.count(F.lit(1)) / F.lit(LANE_TEXTS)).cast("int").alias("n"))
    need = need.withColumnRenamed("plugin", "p")
    return texts.join(need, F.col("plugin").eqNullSafe(F.col("p"))).withColumn("lane", F.pmod(F.xxhash64("text"), F.col("n")).cast("int")).drop("p", "n")


def first_batches(open_: DataFrame, options: Options) -> DataFrame:
    """One row a lane: the texts of its next batch in order, up to the limit, the first one always."""
    lane = Window.partitionBy("plugin", "lane").orderBy("text")
    size = F.char_length(options.block(options.flatten(F.col("text")))).cast("long")
    held = open_.withColumn("size", size).withColumn("until", F.sum("size").over(lane.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(lane))
    kept = held.where((F.col("until") <= options.chars) | (F.col("k") == 1))
    return kept.groupBy("plugin", "lane").agg(F.sort_array(F.collect_list(F.struct("text", "size"))).alias("items"))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}']+"), lambda w: w != ""))


def with_hints(batches: DataFrame, known: DataFrame, options: Options) -> DataFrame:
    """Batches with ``hints``: known pairs of the plugin (plugin, text, japanese) by how many of the batch's words they share, then by text, within the
    share of the limit; and with fewer texts until both fit. A batch of one text that does not fit with its hints goes without."""
    asked = batches.select("plugin", "lane", F.explode("items.text").alias("t")).select("plugin", "lane", F.explode(_words(F.col("t"))).alias("word")).distinct()
    pool = known.select(F.col("plugin").alias("p"), "text", "japanese").withColumn("w", F.explode(_words(F.col("text"))))
    pool = pool.withColumn("k", F.row_number().over(Window.partitionBy("p", "w").orderBy("text"))).where(F.col("k") <= WORD_HINTS).drop("k")
    met = asked.join(pool, F.col("plugin").eqNullSafe(F.col("p")) & (F.col("word") == F.col("w"))).groupBy("plugin", "lane", "text", "japanese").agg(F.count(F.lit(1)).alias("shared"))
    best = Window.partitionBy("plugin", "lane").orderBy(F.desc("shared"), "text")
    line = F.concat("text", F.lit(" = "), "japanese")
    met = met.withColumn("line", line).withColumn("used", F.sum(F.char_length("line")).over(best.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(best))
    met = met.where((F.col("used") <= int(options.chars * options.hint_share)) & (F.col("k") <= options.top_hints))
    hints = met.groupBy(F.col("plugin").alias("p"), F.col("lane").alias("l")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("hints"), F.max("used").alias("taken"))
    out = batches.join(hints, F.col("plugin").eqNullSafe(F.col("p")) & (F.col("lane") == F.col("l")), "left")
    items, taken = F.col("items"), F.coalesce("taken", F.lit(0))
    upto = lambda i: F.aggregate(F.slice(items, 1, i + 1), F.lit(0).cast("long"), lambda s, x: s + x["size"])
    fitting = F.filter(F.transform(items, lambda x, i: F.struct(x["text"].alias("text"), upto(i).alias("until"))), lambda x: x["until"] + taken <= options.chars)
    fits = F.size(fitting) > 0
    out = out.withColumn("texts", F.when(fits, F.transform(fitting, lambda x: x["text"])).otherwise(F.array(F.get(items, F.lit(0))["text"])))
    none = F.array().cast("array<string>")
    return out.select("plugin", "lane", "texts", F.when(fits, F.coalesce("hints", none)).otherwise(none).alias("hints"))


def send(batches: DataFrame, make: Callable[[], Translator], options: Options, turn: int) -> DataFrame:
    """The rows of the state that sending every batch gives. One guarded translator a task; batches after its breaker has opened are not sent and give no rows."""
    flat = batches.withColumn("shown", F.transform("texts", options.flatten))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guard = Guarded(make())
        for pdf in frames:
            rows = []
            for plugin, lane, texts, shown, hints in zip(pdf["plugin"], pdf["lane"], pdf["texts"], pdf["shown"], pdf["hints"]):
                if guard.open:
                    continue
                before = guard.calls
                shown, answers = list(shown), None
                answers = guard.translate(shown, [*([options.instructions] if options.instructions else []), *hints])
                failed = guard.failures > 0
                found = match_back(shown, answers)
                cut = bool(getattr(guard.inner, "truncated", False))
                for text, s in zip(texts, shown):
                    answer = found.get(s)
                    rows.append((plugin, text, answer, None if answer else ("call failed" if failed else "no answer"), cut, guard.calls - before, lane, turn))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in STATE.split(", ")])

    told = flat.mapInPandas(run, STATE)
    return told.withColumn("japanese", options.unflatten(F.col("japanese"))).withColumn("japanese", F.when(~X.is_blank(F.col("japanese")), F.col("japanese")))


def translate(rows: DataFrame, plugin: str, text: str, make: Callable[[], Translator], options: Options | None = None, state: str | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """(plugin, text, japanese) of all texts that have an answer.

    ``state``: the folder of the answers; a run that is given the folder of an earlier one goes on where it ended. ``baseline``: known
    (plugin, text, japanese) that are hints from the start.
    """
    options, spark = options or Options(), rows.sparkSession
    state = state or f"{checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"
    wanted = rows.select(F.col(plugin).cast("string").alias("plugin"), F.col(text).alias("text")).where(~X.is_blank(F.col("text"))).distinct()
    wanted = checkpoint(lanes(wanted))
    done = finished_rounds(spark, state)
    turn = read_state(spark, state).agg(F.max("pass")).first()[0] or 0
    sent = 0
    while (options.max_rounds is None or sent < options.max_rounds) and not (options.cancel_file and _exists(spark, options.cancel_file)):
        past = read_state(spark, state)
        answered = past.where("japanese is not null").select("plugin", "text", "japanese")
        left = _without(_without(wanted, answered), past.where(F.col("pass") == turn))
        batches = first_batches(left, options)
        known = answered if baseline is None else answered.unionByName(_without(baseline.select("plugin", "text", "japanese"), answered))
        planned = checkpoint(with_hints(batches, known, options))
        if planned.isEmpty():
            if past.where((F.col("pass") == turn) & F.col("japanese").isNotNull()).isEmpty() or _without(wanted, answered).isEmpty():
                break  # a pass without an answer, or nothing open
            turn += 1
            continue
        out = send(planned.repartition("plugin", "lane"), make, options, turn)
        out.write.mode("overwrite").parquet(f"{state}/round-{done}")
        counts = spark.read.schema(STATE).parquet(f"{state}/round-{done}").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") == "call failed").alias("failed")).first()
        done, sent = done + 1, sent + 1
        if counts["n"] == counts["failed"]:
            break  # every call failed: the translator is not there
    out = read_state(spark, state).where("japanese is not null").groupBy("plugin", "text").agg(F.min_by("japanese", F.struct("pass", "lane")).alias("japanese"))
    return out.select(F.col("plugin").alias(plugin), F.col("text").alias(text), "japanese")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    other = gone.select(F.col("plugin").alias("_p"), F.col("text").alias("_t")).distinct()
    return rows.join(other, F.col("plugin").eqNullSafe(F.col("_p")) & (F.col("text") == F.col("_t")), "left_anti")
