"""Capacity-constrained matching: greedy by score, which is the stable assignment when both sides rank by one score.

Two forms with equal results, and one of its own order. rounds() (in rounds.py) is distributed. kernel() runs the same rule in one task over
a bounded number of edges, for the many small solves of the phases. proposals() lets papers offer in turn, which differs from the
greedy result only where a person is in several classes that cross.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.blocks import Scored
from weftline.operators.offers import offers_of
from weftline.operators.rounds import blocking_of, blocking_pairs, rounds, rounds_of  # noqa: F401
from weftline.policy import Policy
from weftline.session import shared_path

KERNEL_EDGES = 2_000_000


def greedy(edges: list[tuple], target: dict, cap: dict, class_of: dict | None = None, limit: dict | None = None, held: dict | None = None) -> list[tuple]:
    """Edges (paper, person, score) taken from the best down while paper, person and classes have room.

    class_of: person -> classes; limit: (class, paper) or class -> most; held: (class, paper) -> already there.
    """
    class_of, limit = class_of or {}, limit or {}
    left, room, count = dict(target), dict(cap), defaultdict(int, held or {})
    taken, seen = [], set()
    for paper, person, score in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if left.get(paper, 0) <= 0 or room.get(person, 0) <= 0 or (paper, person) in seen:
            continue
        classes = class_of.get(person, ())
        if any(count[c, paper] >= limit.get((c, paper), limit.get(c, float("inf"))) for c in classes):
            continue
        left[paper] -= 1
        room[person] -= 1
        for c in classes:
            count[c, paper] += 1
        seen.add((paper, person))
        taken.append((paper, person, score))
    return taken


class _Offers:
    """One paper's people, best first, and those it has passed over because a class was full."""

    def __init__(self, people: list[tuple], full) -> None:
        self.people, self.full, self.next, self.passed = people, full, 0, []

    def take(self) -> tuple | None:
        """The best (person, score) with room in every class, which gets no second offer."""
        while self.next < len(self.people) and self.full(self.people[self.next][0]):
            self.passed.append(self.next)
            self.next += 1
        k = self._open()
        if k is not None:
            return self.people[self.passed.pop(k)]
        self.next += 1
        return self.people[self.next - 1] if self.next <= len(self.people) else None

    def more(self) -> bool:
        return self.next < len(self.people) or self._open() is not None

    def _open(self) -> int | None:
        return next((k for k, i in enumerate(self.passed) if not self.full(self.people[i][0])), None)


def proposals(edges: list[tuple], target: dict, cap: dict, class_of: dict | None = None, limit: dict | None = None, held: dict | None = None) -> list[tuple]:
    """Papers, in target's order, offer in turn to their best person; a person without room lets the worst offer go for a
    better one, and of equal scores keeps what they hold. Parameters and result as for greedy().

    A person whose class is full on a paper is passed over, and gets the offer once somebody of that class is let go.
    With one class each, or nested ones, the result is stable; with crossing classes a pair may be left that prefers
    each other. A paper stays short rather than break a class's limit.
    """
    class_of, limit, count = class_of or {}, limit or {}, defaultdict(int, held or {})
    people, seen = defaultdict(list), set()
    for paper, person, score in sorted(edges, key=lambda e: (-e[2], e[1])):
        if cap.get(person, 0) > 0 and (paper, person) not in seen:
            seen.add((paper, person))
            people[paper].append((person, score))
    full_on = lambda paper: lambda person: any(count[c, paper] >= limit.get((c, paper), limit.get(c, float("inf"))) for c in class_of.get(person, ()))
    offers = {p: _Offers(people[p], full_on(p)) for p, n in target.items() if n > 0 and people[p]}
    has: dict = {p: {} for p in offers}  # person -> score
    holds: dict = defaultdict(list)  # of each person, [score, paper] in slots

    def change(paper, person, by: int) -> None:
        for c in class_of.get(person, ()):
            count[c, paper] += by

    turns = deque(offers)
    while turns:
        paper = turns.popleft()
        offer = offers[paper].take() if len(has[paper]) < target[paper] else None
        if offer is None:
            continue
        person, score = offer
        slots, loser = holds[person], None
        if len(slots) < cap[person]:
            slots.append([score, paper])
        else:
            worst = min(slots, key=lambda x: x[0])
            if score <= worst[0]:
                person = None
            else:
                loser = worst[1]
                worst[:] = score, paper
        if person is not None:
            has[paper][person] = score
            change(paper, person, 1)
        if loser is not None:
            del has[loser][person]
            change(loser, person, -1)
            turns.append(loser)
        if len(has[paper]) < target[paper] and offers[paper].more():
            turns.append(paper)
    return [(p, r, s) for p, got in has.items() for r, s in got.items()]


def _bounded(edges: DataFrame) -> None:
    if edges.limit(KERNEL_EDGES + 1).count() > KERNEL_EDGES:
        raise ValueError("too many edges for one task; use rounds()")


MODES = {"greedy": greedy, "sequential": proposals}


def kernel(edges: DataFrame, targets: DataFrame, caps: DataFrame, members: DataFrame | None = None, limits: DataFrame | None = None, mode: str = "greedy") -> DataFrame:
    """greedy() or, sequential, proposals() over edges (paper_id, person_id, score) in one task; refuses more than KERNEL_EDGES.

    targets: paper_id, target; caps: person_id, cap; members: class_id, person_id; limits: class_id, paper_id (null: all), most.
    """
    solve = MODES[mode]
    _bounded(edges)
    target = {r.paper_id: r.target for r in targets.orderBy("paper_id").collect()}
    cap = {r.person_id: r.cap for r in caps.collect()}
    class_of: dict = defaultdict(list)
    for r in members.collect() if members is not None else ():
        class_of[r.person_id].append(r.class_id)
    limit = {(r.class_id if r.paper_id is None else (r.class_id, r.paper_id)): r.most for r in (limits.collect() if limits is not None else ())}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken = solve(list(rows[["paper_id", "person_id", "score"]].itertuples(index=False, name=None)), target, cap, class_of, limit)
        return pd.DataFrame(taken, columns=["paper_id", "person_id", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    return edges.select("paper_id", "person_id", "score").groupBy(F.lit("all").alias("g")).applyInPandas(run, f"paper_id {kinds['paper_id']}, person_id {kinds['person_id']}, score double")


def phases(edges: list[tuple], steps: list[dict], cap: dict, mode: str = "greedy") -> list[tuple]:
    """Solve step after step over what the earlier ones left; earlier picks are never undone.

    A step: name, target (paper -> how many to hold after it, of those its people may fill), people (a set, or None
    for all), gated (only gated edges), class_of and limit. Edges: (paper, person, score, gated).
    """
    room, picks, taken = dict(cap), [], set()
    for step in steps:
        people = step.get("people")
        live = [(p, r, s) for p, r, s, g in edges if (g or not step.get("gated", True)) and (people is None or r in people) and (p, r) not in taken]
        counted = Counter(p for p, r, _, _ in picks if people is None or step.get("total", True) or r in people)
        left = {p: max(0, n - counted[p]) for p, n in step["target"].items()}
        class_of, held = step.get("class_of", {}), defaultdict(int)
        for p, r, _, _ in picks:
            for c in class_of.get(r, ()):
                held[c, p] += 1
        for p, r, s in MODES[mode](live, left, room, class_of, step.get("limit"), held):
            room[r] -= 1
            taken.add((p, r))
            picks.append((p, r, s, step["name"]))
    return picks


def surplus(edges: list[tuple], picks: list[tuple], cap: dict, *, base: int, extra: int, class_of: dict | None = None, limit: dict | None = None, mode: str = "greedy") -> list[tuple]:
    """One more person for the papers of lowest mean score, round after round, while people have room: first over gated
    edges, then over all. Papers that a round cannot serve are left out of later ones. Edges: (paper, person, score[, gated])."""
    room, class_of = dict(cap), class_of or {}
    has: dict = defaultdict(dict)
    count: dict = defaultdict(int)

    def put(p, r, s) -> None:
        room[r] -= 1
        has[p][r] = s
        for c in class_of.get(r, ()):
            count[c, p] += 1

    for p, r, s, *_ in picks:
        put(p, r, s)
    added = []
    for k in range(extra):
        able = sorted((sum(got.values()) / len(got), p) for p, got in has.items() if len(got) == base + k)
        left = dict.fromkeys([p for _, p in able[: sum(max(0, x) for x in room.values())]], 1)
        before = len(added)
        for released in (False, True):
            live = [(p, r, s) for p, r, s, *gated in edges if left.get(p) and r not in has[p] and (released or all(gated))]
            for p, r, s in MODES[mode](live, left, room, class_of, limit, count):
                put(p, r, s)
                left[p] = 0
                added.append((p, r, s, "surplus (area released)" if released else "surplus"))
        if len(added) == before:
            break
    return added


SENIOR, FILL = "senior anchor", "fill"
#: Name, what is to be held after it, whose people (None: all), in the area only, under the limits on classes.
LADDER = (
    (SENIOR, "anchor", "senior", True, False),
    ("senior anchor (area released)", "anchor", "senior", False, False),
    ("almost-senior anchor", "anchor", "almost_senior", False, False),
    (FILL, "whole", None, True, True),
    ("fill (area released)", "whole", None, False, True),
    ("fill (limits released)", "whole", "almost_not", False, False),
)
FLAGS = ("senior", "almost_senior", "junior", "out_of_area", "almost_not")


def ladder(papers: list, pools: dict[str, set], policy: Policy, countries: dict | None = None, country_limit: dict | None = None) -> list[dict]:
    """The steps of phases(): anchors (a senior in the area, any senior, an almost senior), then fills (in the area, any
    area, then those almost out of the junior and stranger classes, whose limits no longer hold).

    pools: senior, almost_senior, junior, out_of_area, almost_not. countries: person -> their country's class;
    country_limit: (class, paper) -> most, which holds in every step.
    """
    country_limit = country_limit or {}
    by_country = {r: [c] for r, c in (countries or {}).items()}
    classes = {r: [c for c in ("junior", "out_of_area") if r in pools[c]] + by_country.get(r, []) for r in {*by_country, *pools["junior"], *pools["out_of_area"]}}
    limits = {"junior": policy.max_juniors, "out_of_area": policy.max_out_of_area, **country_limit}
    anchor, whole = dict.fromkeys(papers, min(policy.min_seniors, policy.per_paper)), dict.fromkeys(papers, policy.per_paper)
    loose = {"class_of": by_country, "limit": country_limit}
    tight = {"class_of": classes, "limit": limits}
    goals = {"anchor": anchor, "whole": whole}
    return [{"name": name, "target": goals[goal], "people": pools[pool] if pool else None, "total": name != SENIOR, "gated": area, **(tight if limited else loose)} for name, goal, pool, area, limited in LADDER]


def assign(edges: DataFrame, people: DataFrame, policy: Policy = Policy(), mode: str = "sequential") -> DataFrame:
    """The whole run in one task: (paper_id, person_id, score, phase) by ladder(), then surplus(). Refuses more than KERNEL_EDGES.

    edges: paper_id, person_id, score, gated; people: person_id, cap, and booleans senior, almost_senior, junior,
    out_of_area, almost_not (a null is false).
    """
    _bounded(edges)
    rows = people.join(edges.select("person_id").distinct(), "person_id", "left_semi").select("person_id", "cap", *FLAGS).collect()  # at most as many as edges
    cap, pools = {r.person_id: r.cap for r in rows}, {f: {r.person_id for r in rows if r[f]} for f in FLAGS}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        live = list(group[["paper_id", "person_id", "score", "gated"]].itertuples(index=False, name=None))
        steps = ladder(sorted({p for p, *_ in live}), pools, policy)
        picks = phases(live, steps, cap, mode)
        more = surplus(live, picks, cap, base=policy.per_paper, extra=policy.surplus, class_of=steps[3]["class_of"], limit=steps[3]["limit"], mode=mode)
        return pd.DataFrame(picks + more, columns=["paper_id", "person_id", "score", "phase"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    return edges.select("paper_id", "person_id", "score", "gated").groupBy(F.lit("all").alias("g")).applyInPandas(run, f"paper_id {kinds['paper_id']}, person_id {kinds['person_id']}, score double, phase string")


def assign_of(scored: Scored, gated: Scored, people: DataFrame, policy: Policy = Policy(), mode: str = "sequential") -> DataFrame:
    """assign() over pairs in blocks, of any size: each step of LADDER, and each round of surplus, is solved by offers_of() or
    rounds_of() over what the earlier ones left. gated: those of scored that are in the area; people as for assign()."""
    solve = {"greedy": rounds_of, "sequential": offers_of}[mode]
    spark = scored.papers.sparkSession
    home, names = shared_path(spark, "assign"), count(1)
    kept = lambda df: (lambda path: (df.write.parquet(path), spark.read.schema(df.schema).parquet(path))[1])(f"{home}/{next(names)}")
    people = kept(people.select("person_id", "cap", *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS]))
    papers = kept(scored.papers.select("paper_id").distinct())
    members = kept(people.select("person_id", F.explode(F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("junior", "out_of_area")]))).alias("class_id")))
    limits = spark.createDataFrame([("junior", None, policy.max_juniors), ("out_of_area", None, policy.max_out_of_area)], f"class_id string, paper_id {scored.kinds[0]}, most int")
    p, r = scored.kinds
    picks = spark.createDataFrame([], f"paper_id {p}, person_id {r}, score double, phase string")

    def step(name: str, targets: DataFrame, who: DataFrame, area: bool, limited: bool) -> DataFrame:
        """picks and what the step adds for papers with a target above zero."""
        used = picks.groupBy("person_id").agg(F.count("*").alias("_n"))
        room = kept(who.join(used, "person_id", "left").select("person_id", (F.col("cap") - F.coalesce("_n", F.lit(0))).alias("cap")).where("cap > 0"))
        targets = kept(targets.where("target > 0"))
        if targets.isEmpty() or room.isEmpty():
            return picks
        taken = targets.select("paper_id").join(picks.groupBy("paper_id").agg(F.collect_list("person_id").alias("skip")), "paper_id", "left")
        held = picks.join(members, "person_id").groupBy("class_id", "paper_id").agg(F.count("*").alias("n"))
        got = solve((gated if area else scored).of(taken), targets, room, *((members, limits, kept(held)) if limited else ()))
        return kept(picks.unionByName(got.withColumn("phase", F.lit(name))))

    for name, goal, pool, area, limited in LADDER:
        most = policy.per_paper if goal == "whole" else min(policy.min_seniors, policy.per_paper)
        has = picks.groupBy("paper_id").agg(F.count("*").alias("_n"))
        targets = papers.join(has, "paper_id", "left").select("paper_id", (F.lit(most) - F.coalesce("_n", F.lit(0))).alias("target"))
        picks = step(name, targets, people.where(F.col(pool)) if pool else people, area, limited)
    for k in range(policy.surplus):
        means = picks.groupBy("paper_id").agg(F.avg("score").alias("mean"), F.count("*").alias("n")).where(F.col("n") == policy.per_paper + k)
        used = picks.groupBy("person_id").agg(F.count("*").alias("_n"))
        room = people.join(used, "person_id", "left").agg(F.sum(F.greatest(F.col("cap") - F.coalesce("_n", F.lit(0)), F.lit(0)))).first()[0] or 0
        able = kept(_lowest(means, room, kept).select("paper_id"))
        before = picks
        for name, area in (("surplus", True), ("surplus (area released)", False)):
            served = picks.groupBy("paper_id").agg(F.count("*").alias("_n"))
            picks = step(name, able.join(served, "paper_id").select("paper_id", (F.lit(policy.per_paper + k + 1) - F.col("_n")).alias("target")), people, area, True)
        if picks.count() == before.count():
            break
    return picks


def _lowest(means: DataFrame, n: int, kept) -> DataFrame:
    """The n papers of least mean, of equals the least paper_id; numbered over ranges, so that no task sees all."""
    if means.count() <= n:
        return means
    order = ["mean", "paper_id"]
    rows = kept(means.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_c"))  # a row for each range
    start = sizes.withColumn("_start", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_start")
    return rows.join(F.broadcast(start), "_part").withColumn("_at", at).where(F.col("_at") <= n)


def load_pins(baseline: DataFrame, pinned: DataFrame, papers: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(baseline pairs of pinned people that still stand, pairs dropped with why)."""
    rows = baseline.join(pinned.select("person_id").distinct(), "person_id", "left_semi")
    rows = rows.join(papers.select("paper_id").withColumn("_p", F.lit(1)), "paper_id", "left").join(people.select("person_id").withColumn("_r", F.lit(1)), "person_id", "left")
    why = F.when(F.col("_p").isNull(), "paper gone").when(F.col("_r").isNull(), "person gone")
    return rows.where(why.isNull()).drop("_p", "_r"), rows.where(why.isNotNull()).withColumn("why", why).drop("_p", "_r")


def open_slots(baseline: DataFrame, removed: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers that lost people: paper_id, survivors and open slots."""
    rows = baseline.join(papers.select("paper_id").distinct(), "paper_id", "left_semi").join(removed.select("person_id").distinct().withColumn("_gone", F.lit(1)), "person_id", "left")
    return rows.groupBy("paper_id").agg(F.count_if(F.col("_gone").isNull()).alias("survivors"), F.count("_gone").alias("open")).where("open > 0")


def seed_used(baseline: DataFrame, removed: DataFrame, papers: DataFrame) -> DataFrame:
    """(person_id, used): load of those who stay, on papers that are still there."""
    rows = baseline.select("paper_id", "person_id").distinct().join(papers.select("paper_id").distinct(), "paper_id", "left_semi")
    return rows.join(removed.select("person_id"), "person_id", "left_anti").groupBy("person_id").agg(F.count("*").alias("used"))


def outside(touched: DataFrame, allowed: DataFrame) -> DataFrame:
    """Papers that were touched but may not be: none after a sound patch."""
    return touched.select("paper_id").distinct().join(allowed.select("paper_id"), "paper_id", "left_anti")


def over_cap(assigned: DataFrame, caps: DataFrame) -> DataFrame:
    return assigned.groupBy("person_id").agg(F.count("*").alias("used")).join(caps, "person_id").where("used > cap")


def over_class(assigned: DataFrame, members: DataFrame, limits: DataFrame) -> DataFrame:
    counts = assigned.join(members, "person_id").groupBy("class_id", "paper_id").agg(F.count("*").alias("used"))
    return counts.join(limits, ["class_id", "paper_id"]).where("used > most")
