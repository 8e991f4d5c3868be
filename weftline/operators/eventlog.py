"""The action log: live state by replay, anomalies, activity since a cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_actions(log: DataFrame) -> DataFrame:
    """Review id, verb, kind and round from actions 'Review 7 assigned: primary, round R1' and 'Review 7 unassigned'."""
    action = F.col("action")
    pattern = r"^Review (\d+) (assigned|unassigned)(?:: ([a-z-]+))?(?:, round (\S+))?"
    part = lambda k: F.nullif(F.regexp_extract(action, pattern, k), F.lit(""))
    return log.withColumns({"review": part(1).cast("long"), "verb": part(2), "kind": part(3), "round": part(4)}).where("review is not null")


def live(events: DataFrame, key: str, sequence: str, verb: str, on: str) -> DataFrame:
    """The last event of each key, if it is an assignment."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), sequence).alias("e"))
    return last.select(key, "e.*").where(F.col(verb) == on)


def anomalies(events: DataFrame, key: str, sequence: str, verb: str, on: str, off: str, owner: str | None = None, item: str | None = None) -> DataFrame:
    """Events that do not fit what their key's last one left: an assignment of what is assigned (reassigned), and the
    end of one that is not (not assigned), is another owner's (other address) or is for something else (other paper)."""
    w = Window.partitionBy(key).orderBy(sequence)
    held = F.coalesce(F.lag(verb).over(w) == on, F.lit(False))
    moved = lambda c: F.lit(False) if c is None else ~F.lag(c).over(w).eqNullSafe(F.col(c))
    rows = events.withColumns({"_held": held, "_owner": moved(owner), "_item": moved(item)})
    ends = F.when(~F.col("_held"), "not assigned").when(F.col("_owner"), "other address").when(F.col("_item"), "other paper")
    kind = F.when((F.col(verb) == on) & F.col("_held"), "reassigned").when(F.col(verb) == off, ends)
    return rows.withColumn("anomaly", kind).where("anomaly is not null").drop("_held", "_owner", "_item")


def live_pairs(state: DataFrame, kind: str = "primary", round_: str = "R1") -> DataFrame:
    return state.where((F.col("kind") == kind) & (F.col("round") == round_)).select("paper", "email").distinct()


def activity_since(events: DataFrame, who: str, when: str, sequence: str, what: str, cutoffs: DataFrame | None = None) -> DataFrame:
    """Per person: last time and action and how many actions since their own cutoff; without one, since ever."""
    rows = events
    if cutoffs is not None:
        rows = rows.join(cutoffs.select(who, "cutoff"), who, "left").where(F.col("cutoff").isNull() | (F.col(when) >= F.col("cutoff")))
    return rows.groupBy(who).agg(F.max(when).alias("last_activity"), F.max_by(what, F.struct(when, sequence)).alias("last_action"), F.count("*").alias("n_actions"))
