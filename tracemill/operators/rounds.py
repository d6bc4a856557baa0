"""Searches round by round: the champion at every boundary, release statistics, presentations cut at boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import scan, trajectory_shape
from ..functions.vocabulary import CONTROL
from ..tables import stored


_ENTRY = "struct<move:string,raw:double,value:double>"


def boundary_champions(steps: DataFrame, key: str) -> DataFrame:
    """(key, seq, best, value, round) after every step of a root's rounds.

    steps: seq, kind (begin, exact, end or another), round, move, raw, value. Within a round the champion is the move of
    the highest latest raw, the first to arrive winning ties; a round begins with the champion of the one before; at its
    end the value is renewed, and the move gives way only to a strictly higher raw. An end without a raw, and a step of
    another kind, leave the champion as it is. Each round is a group of its own,
    whose entries (the latest score of every move, in order of arrival) a running state revises; what one round hands
    to the next is a second, short one over the rounds' ends.
    """
    c = F.col
    rows = steps.select(key, "seq", "kind", "round", "move", c("raw").cast("double").alias("raw"), c("value").cast("double").alias("value"))
    none = F.lit(None).cast(_ENTRY)

    def revised(entries: Column, x: Column) -> Column:
        new = F.struct(x["move"].alias("move"), x["raw"].alias("raw"), x["value"].alias("value"))
        known = F.exists(entries, lambda e: e["move"].eqNullSafe(x["move"]))
        changed = F.when(known, F.transform(entries, lambda e: F.when(e["move"].eqNullSafe(x["move"]), new).otherwise(e))).otherwise(F.concat(entries, F.array(new)))
        return F.when(x["kind"] == "exact", changed).otherwise(entries)

    def leader(entries: Column) -> Column:
        return F.aggregate(entries, none, lambda best, e: F.when(best.isNull() | (e["raw"] > best["raw"]), e).otherwise(best))

    ordered = F.array_sort(F.collect_list(F.struct("seq", "kind", "move", "raw", "value")))
    per_round = rows.groupBy(key, "round").agg(ordered.alias("steps"))
    leaders = scan(c("steps"), F.array().cast(f"array<{_ENTRY}>"), revised, lambda entries, x: leader(entries), after=True)
    # stored, as both the rounds' ends and the steps read it
    known = stored(per_round.select(key, "round", "steps", leaders.alias("led")))
    end = F.element_at(F.filter("steps", lambda x: x["kind"] == "end"), -1)
    ends = known.select(key, "round", F.when(F.exists("steps", lambda x: x["kind"] == "end"), end).alias("end"), F.element_at("led", -1).alias("led"))

    def handed(before: Column, x: Column) -> Column:
        current = F.coalesce(x["led"], before)
        known = x["end"]["raw"].isNotNull()
        best = F.when(current.isNull() | (x["end"]["raw"] > current["raw"]), x["end"]["move"]).otherwise(current["move"])
        return F.when(x["end"].isNull(), before).when(~known, current).otherwise(F.struct(best.alias("move"), x["end"]["raw"].alias("raw"), x["end"]["value"].alias("value")))

    of_root = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("round", "end", "led"))).alias("rounds"))
    afters = of_root.select(key, "rounds", scan(c("rounds"), none, handed, after=True).alias("after"))
    befores = F.concat(F.array(none), F.col("after"))  # one more than there are rounds
    carried = afters.withColumn("before", befores).select(key, F.inline(F.transform("rounds", lambda r, i: F.struct(r["round"].alias("round"), F.get("before", i).alias("before"), F.get("after", i).alias("after")))))
    shown = known.select(key, "round", F.inline(F.zip_with("steps", "led", lambda x, e: F.struct(x["seq"].alias("seq"), x["kind"].alias("kind"), e.alias("led")))))
    champion = F.when(c("kind") == "begin", c("before")).when(c("kind") == "end", c("after")).otherwise(F.coalesce("led", "before"))
    out = shown.join(carried, [key, "round"]).withColumn("_c", champion)
    return out.select(key, c("seq").cast("long").alias("seq"), c("_c.move").alias("best"), c("_c.value").alias("value"), c("round").cast("long").alias("round"))


def root_facts(rounds: DataFrame, key: str) -> DataFrame:
    """Per root, from (key, round, champion, value, refutations): rounds, overturns, the depth from which the
    champion stays, whether the first round's is the last one's, the shape of the values, all refutations."""
    order = Window.partitionBy(key).orderBy("round")
    changed = F.coalesce(F.lag("champion").over(order) != F.col("champion"), F.lit(False))
    per = rounds.withColumn("_changed", changed).groupBy(key).agg(
        F.count("*").alias("rounds"),
        F.count_if("_changed").alias("overturned_rounds"),
        F.coalesce(F.max(F.when(F.col("_changed"), F.col("round"))), F.min("round")).alias("converged_depth"),
        (F.min_by("champion", "round") == F.max_by("champion", "round")).alias("first_is_last"),
        F.transform(F.sort_array(F.collect_list(F.struct("round", "value"))), lambda x: x["value"].cast("double")).alias("_values"),
        F.sum("refutations").alias("refutations"),
    )
    return per.withColumn("value_shape", trajectory_shape(F.col("_values"))).drop("_values")


def release_summary(facts: DataFrame) -> DataFrame:
    """One row for a release: totals and rates."""
    turns = F.sum(F.greatest(F.col("rounds") - 1, F.lit(0)))
    return facts.agg(
        F.count("*").alias("roots"),
        F.sum("rounds").alias("rounds"),
        F.sum("overturned_rounds").alias("overturned_rounds"),
        F.coalesce(F.try_divide(F.sum("overturned_rounds"), turns), F.lit(0.0)).alias("overturn_rate"),
        F.count_if(F.col("overturned_rounds") > 0).alias("roots_with_overturn"),
        F.sum("refutations").alias("refutations"),
        (F.sum("refutations") / F.greatest(F.sum("rounds"), F.lit(1))).alias("refutations_per_round"),
        F.count_if("first_is_last").alias("first_round_matches_final"),
    )


def release_histograms(facts: DataFrame, rounds: DataFrame) -> DataFrame:
    """(section, value, n): how many roots have so many rounds, converge so deep, run in which shape; how many
    rounds have so many refutations. One pass over each table."""
    entry = lambda name, column: F.struct(F.lit(name).alias("section"), F.col(column).cast("string").alias("value"))
    roots = facts.select(F.inline(F.array(entry("rounds", "rounds"), entry("converged_depth", "converged_depth"), entry("value_shape", "value_shape"))))
    each = rounds.select(F.lit("refutations_per_round").alias("section"), F.col("refutations").cast("string").alias("value"))
    return roots.unionByName(each).groupBy("section", "value").agg(F.count("*").alias("n"))


def cut_target(draw: Column, length: Column, low: float, high: float) -> Column:
    """The place of a random cut: ``draw`` in [0, 1) spread over the whole numbers between the two shares."""
    least = F.greatest(F.lit(1), F.least(F.ceil(low * length), length))
    most = F.greatest(least, F.least(F.floor(high * length), length))
    return (least + F.floor(draw * (most - least + 1))).cast("int")


def presentations(df: DataFrame, tokens: str, boundaries: str, draw: Column, low: float, high: float) -> DataFrame:
    """Three rows for each of ``df``: presentation (zero, full, random), cut, its tokens, how many boundaries it
    shows and depth, its depth marks.

    tokens: those before and behind ``final_start``, where the label begins. A random cut ends at the first boundary
    at or after its target, at the last one where none is.
    """
    start, ends = F.col("final_start"), F.col(boundaries)
    target = cut_target(draw, start, low, high)
    later = F.filter(ends, lambda b: b >= target)
    random = F.coalesce(F.array_min(later), F.element_at(ends, -1))
    ways = F.array(
        F.struct(F.lit("zero").alias("presentation"), F.lit(0).alias("cut")),
        F.struct(F.lit("full").alias("presentation"), start.alias("cut")),
        F.struct(F.lit("random").alias("presentation"), random.alias("cut")),
    )
    rows = df.select("*", F.inline(ways))
    prefix = F.slice(tokens, F.lit(1), F.col("cut"))
    shown = F.when(F.col("presentation") == "full", F.size(ends)).when(F.col("presentation") == "zero", 0).otherwise(F.size(F.filter(ends, lambda b: b <= F.col("cut"))))
    return rows.withColumns(
        {
            "shown": shown,
            "depth": F.size(F.filter(prefix, lambda t: t == CONTROL["depth"])),
            "tokens": F.concat(prefix, F.slice(tokens, F.col("final_start") + 1, F.size(tokens))),
        }
    )
