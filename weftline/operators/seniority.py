"""Career and window counts, the classes they give, and capacities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.policy import Policy

LEVELS = ("out-of-area", "junior", "typical", "senior")


def target_venue(venue: Column, kind: Column, venues: tuple[str, ...]) -> Column:
    """The venue's name, with or without a number behind; whole volumes do not count."""
    found = F.regexp_extract(venue, "^(" + "|".join(venues) + r")( \(\d+\))?$", 1)
    return F.when((F.coalesce(kind, F.lit("")) != "proceedings") & (found != ""), found)


def classify(records: DataFrame, key: str, venues: list[str], *, current_year: int, policy: Policy = Policy()) -> DataFrame:
    """Per person: counts by venue over the career and the window, first and last year, all publications, and the level.

    records: key, title, venue, year. Records without a title or year do not count; of those with the same title (its
    case and the dots at its end aside) and year one counts, at one of the venues if any of them was. The window ends
    with current_year.
    """
    p = policy
    title = F.rtrim(F.lower(F.trim(F.col("title").cast("string"))), F.lit(". "))
    at = F.when(F.col("venue").isin(*venues), F.col("venue"))
    once = records.where("year is not null").withColumn("_title", title).where("trim(cast(title as string)) <> ''").groupBy(key, "_title", "year").agg(F.min(at).alias("venue"))
    hit, inside = F.col("venue").isNotNull(), F.col("year").between(current_year - p.seniority_window + 1, current_year)
    counts = [F.count_if(F.col("venue") == v).alias(f"career_{k}") for k, v in enumerate(venues)] + [F.count_if((F.col("venue") == v) & inside).alias(f"window_{k}") for k, v in enumerate(venues)]
    out = once.groupBy(key).agg(*counts, F.count_if(hit).alias("career"), F.count_if(hit & inside).alias("window"), F.min(F.when(hit, F.col("year"))).alias("first_year"), F.max(F.when(hit, F.col("year"))).alias("last_year"), F.count("*").alias("pubs"))
    return out.withColumn("level", level(F.col("career"), F.col("window"), F.col("pubs"), p))


def level(career: Column, window: Column, pubs: Column, policy: Policy = Policy()) -> Column:
    """senior by the window's rate, else junior by all publications, else out-of-area by those at the venues."""
    p = policy
    senior = window >= p.senior_rate * p.seniority_window - 1e-9
    return F.when(senior, "senior").when(pubs < p.junior_pubs, "junior").when(career < p.out_of_area_career, "out-of-area").otherwise("typical")


def promote(label: Column, score: Column, policy: Policy = Policy()) -> Column:
    """Service can raise a level, never lower it."""
    by_service = F.when(score >= policy.service_senior, 3).when(score >= policy.service_typical, 2).otherwise(0)
    now = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), label) - 1
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.greatest(now, by_service) + 1).cast("int"))


def merge_service(rows: DataFrame, key: str, sums: list[str], flags: list[str]) -> DataFrame:
    return rows.groupBy(F.lower(F.trim(key)).alias(key)).agg(*[F.sum(c).alias(c) for c in sums], *[F.bool_or(c).alias(c) for c in flags])


def pools(people: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Six memberships: senior, junior and out-of-area, and those who are almost (not) one."""
    p = policy
    return people.withColumns({
        "senior": F.col("level") == "senior",
        "junior": F.col("level") == "junior",
        "out_of_area": F.col("level") == "out-of-area",
        "almost_senior": (F.col("level") != "senior") & (F.col("window") >= p.almost_senior_window),
        "almost_not_junior": (F.col("level") == "junior") & (F.col("career") >= p.almost_junior_pubs),
        "almost_not_out_of_area": (F.col("level") == "out-of-area") & (F.col("career") >= p.almost_out_of_area_career),
    })


def capacity(override: Column, tier: Column, policy: Policy = Policy()) -> Column:
    return F.coalesce(override, F.when(tier == "light", policy.light_cap).when(tier == "reserve", policy.reserve_cap).otherwise(policy.full_cap))


def area_capacity(people: DataFrame, areas: list[str], tier: str, cap: str) -> DataFrame:
    """Per area, primary or secondary and each person once: people, people by tier, capacity."""
    rows = people.select("person_id", tier, cap, F.explode(F.array_distinct(F.array_compact(F.array(*areas)))).alias("area"))
    return rows.groupBy("area").agg(
        F.count("*").alias("n_people"), F.count_if(F.col(tier) == "light").alias("n_light"), F.count_if(F.col(tier) == "full").alias("n_full"), F.count_if(F.col(tier) == "reserve").alias("n_reserve"), F.sum(cap).alias("capacity"),
    )


def reserves_needed(slots: Column, capacity_: Column, load: Column) -> Column:
    return F.ceil(F.greatest(slots - capacity_, F.lit(0)) / load)
