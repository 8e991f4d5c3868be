"""Patch of an assignment: who left is replaced on their papers, and nothing else moves.

Slates, loads and class counts of all that stays are frozen; only papers that the removed people leave are solved, by
rounds() over what room is left. The merged assignment says where each row comes from, and checks() proves it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.matching import outside, over_cap, seed_used
from weftline.operators.blocks import Scored
from weftline.operators.rounds import EDGE, class_limits, rounds, rounds_of

KEPT, SURVIVOR, NEW = "kept", "survivor", "new"


def still_here(removed: DataFrame, people: DataFrame) -> DataFrame:
    """Removed people who are still on the roster: a patch for them is most likely a mistake."""
    return removed.select("person_id").distinct().join(people.select("person_id").distinct(), "person_id", "left_semi")


def frozen(baseline: DataFrame, removed: DataFrame, papers: DataFrame, people: DataFrame) -> DataFrame:
    """paper_id, person_id, origin: what stays. Papers without a removed person keep their rows as they are; of the others
    stays who is still on the roster. Papers that are gone lose their rows."""
    gone, here = removed.select("person_id").distinct().withColumn("_gone", F.lit(1)), people.select("person_id").distinct().withColumn("_here", F.lit(1))
    rows = baseline.select(*EDGE).distinct().join(papers.select("paper_id").distinct(), "paper_id", "left_semi").join(gone, "person_id", "left").join(here, "person_id", "left")
    hurt = rows.where("_gone is not null").select("paper_id").distinct().withColumn("_hurt", F.lit(1))
    marked = rows.join(hurt, "paper_id", "left")
    return marked.where("_hurt is null or (_gone is null and _here is not null)").select(*EDGE, F.when(F.col("_hurt").isNull(), KEPT).otherwise(SURVIVOR).alias("origin"))


def openings(baseline: DataFrame, removed: DataFrame, papers: DataFrame, people: DataFrame) -> DataFrame:
    """paper_id, size, target: papers that a removed person leaves, their slates before, and how many to find. A second one
    who has left the roster since opens a place too."""
    rows = baseline.select(*EDGE).distinct().join(papers.select("paper_id").distinct(), "paper_id", "left_semi")
    hurt = rows.join(removed.select("person_id").distinct(), "person_id", "left_semi").select("paper_id").distinct()
    stays = frozen(baseline, removed, papers, people).where(F.col("origin") == SURVIVOR).groupBy("paper_id").agg(F.count("*").alias("_stay"))
    sizes = rows.join(hurt, "paper_id", "left_semi").groupBy("paper_id").agg(F.count("*").alias("size")).join(stays, "paper_id", "left")
    return sizes.select("paper_id", "size", (F.col("size") - F.coalesce("_stay", F.lit(0))).alias("target"))


def room_left(baseline: DataFrame, removed: DataFrame, papers: DataFrame, people: DataFrame) -> DataFrame:
    """person_id, cap: what each on the roster can still take, next to all papers that are still there."""
    used = seed_used(baseline, removed, papers)
    return people.select("person_id", "cap").join(used, "person_id", "left").select("person_id", (F.col("cap") - F.coalesce("used", F.lit(0))).alias("cap"))


def patch(baseline: DataFrame, removed: DataFrame, papers: DataFrame, people: DataFrame, edges: DataFrame | Scored, members: DataFrame | None = None, limits: DataFrame | None = None, *, force: bool = False) -> DataFrame:
    """paper_id, person_id, origin (kept, survivor, new) of the patched assignment.

    baseline: paper_id, person_id (repeats count once); removed: person_id; papers: those still there; people: person_id,
    cap; edges: paper_id, person_id, score, who can be chosen, or pairs in blocks; members and limits as in class_limits(). Raises if a removed
    person is still on the roster, unless forced. A paper stays short rather than break a cap.
    """
    if not force and still_here(removed, people).limit(1).count():
        raise ValueError("a removed person is still on the roster")
    stays = frozen(baseline, removed, papers, people)
    slates = stays.where(F.col("origin") == SURVIVOR)
    targets = openings(baseline, removed, papers, people).where("target > 0").select("paper_id", "target")
    held = slates.join(members.select("class_id", "person_id").distinct(), "person_id").groupBy("class_id", "paper_id").agg(F.count("*").alias("n")) if members is not None else None
    room = room_left(baseline, removed, papers, people)
    if isinstance(edges, Scored):
        there = targets.select("paper_id").join(slates.groupBy("paper_id").agg(F.collect_list("person_id").alias("skip")), "paper_id", "left")
        found = rounds_of(edges.of(there), targets, room.join(removed.select("person_id"), "person_id", "left_anti"), members, limits, held)
    else:
        able = edges.join(targets.select("paper_id"), "paper_id", "left_semi").join(removed.select("person_id"), "person_id", "left_anti").join(slates, EDGE, "left_anti")
        found = rounds(able, targets, room, members, limits, held)
    return stays.unionByName(found.select(*EDGE, F.lit(NEW).alias("origin")))


def checks(patched: DataFrame, baseline: DataFrame, removed: DataFrame, papers: DataFrame, people: DataFrame, members: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """check, n: how often the patch broke its word. All are 0 after patch(), but caps and classes that the frozen part
    breaks by itself count too: who got something new while over the cap, and touched papers over a limit."""
    found = patched.where(F.col("origin") == NEW)
    allowed = openings(baseline, removed, papers, people)
    changed = baseline.select(*EDGE).distinct().join(papers.select("paper_id").distinct(), "paper_id", "left_semi").join(allowed, "paper_id", "left_anti")
    same = patched.join(allowed, "paper_id", "left_anti").select(*EDGE)
    tests = {
        "new outside touched papers": outside(found, allowed),
        "untouched papers changed": changed.exceptAll(same).unionByName(same.exceptAll(changed)),
        "over the cap": over_cap(patched, people.select("person_id", "cap")).join(found.select("person_id").distinct(), "person_id", "left_semi"),
        "removed but there": found.join(removed.select("person_id").distinct(), "person_id", "left_semi"),
        "slate over its size": patched.join(allowed, "paper_id").groupBy("paper_id", "size").agg(F.count("*").alias("n")).where("n > size"),
    }
    if members is not None and limits is not None:
        at = patched.join(allowed.select("paper_id"), "paper_id", "left_semi")
        counts = at.join(members.select("class_id", "person_id").distinct(), "person_id").groupBy("class_id", "paper_id").agg(F.count("*").alias("n"))
        tests["class over its limit"] = class_limits(at, members, limits, counts).where("left < 0").select("paper_id", "class_id").distinct()
    out = None
    for name, rows in tests.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out
