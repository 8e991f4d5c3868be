"""Conflict layers: declared, own, co-authors, collaborators; one table of pairs with the best evidence of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import homonym_number, token_pairs, token_set
from weftline.session import checkpoint_dir

BLOCK = 1024  # rows of one name in a block
DEALT = 1 << 25  # pairs of one key that a task makes


def _blocks(rows: DataFrame, of: list[str], names: list[str], block: str) -> DataFrame:
    """A row for each block of rows that are equal in names: names, and as block an array of the columns of."""
    sizes = rows.groupBy(*names).agg(F.ceil(F.count("*") / BLOCK).alias("_n")).select(*[F.col(c).alias(f"_{c}") for c in names], "_n")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    dealt = rows.join(sizes, same).withColumn("_k", F.pmod(F.xxhash64(*of), F.col("_n")))
    checkpoint_dir(rows.sparkSession)
    return dealt.groupBy(*names, "_k").agg(F.collect_list(F.struct(*of)).alias(block)).drop("_k").checkpoint()


def _dealt_join(left: DataFrame, right: DataFrame, on: list[str], *, dealt: int = DEALT) -> DataFrame:
    """The join of blocks (or rows) on equal keys, in tasks by the pairs that they stand for: where a key makes more than dealt,
    its left blocks are dealt over several tasks and its right ones go to each of these."""
    spark = left.sparkSession
    size = lambda df, block: F.size(block).cast("double") if block in df.columns else F.lit(1.0)
    sizes = left.groupBy(*on).agg(F.sum(size(left, "_l")).alias("_a")).join(right.groupBy(*on).agg(F.sum(size(right, "_r")).alias("_b")), on)
    sizes = sizes.select(*on, F.ceil(F.col("_a") * F.col("_b") / dealt).alias("_parts"))
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64(*[c for c in left.columns if c not in on]), F.col("_parts"))
    left = left.join(sizes, on).withColumn("_part", part).drop("_parts")
    right = right.join(sizes, on).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    # Tasks by number, as few rows stand for many pairs and would be put together otherwise.
    return left.repartition(parts, *on, "_part").join(right.repartition(parts, *on, "_part"), [*on, "_part"]).drop("_part")


def _opened(met: DataFrame) -> DataFrame:
    """The pairs that blocks _l and _r stand for, with the columns of both."""
    rest = [c for c in met.columns if c not in ("_l", "_r")]
    one = met.select(*rest, F.explode("_l").alias("_l"), "_r")
    return one.select(*rest, "_l", F.explode("_r").alias("_r")).select(*rest, "_l.*", "_r.*")


def coauthor_index(people: DataFrame, coauthorships: DataFrame, *, years: int, current_year: int) -> DataFrame:
    """(person_id, name, tokens, number, shared, latest_year, latest_title) in the window, own names left out.

    people: person_id, pid, own_tokens (array of token sets); coauthorships: pid, name, year, title.
    """
    recent = coauthorships.where(F.col("year") >= current_year - years + 1)
    joined = recent.join(people, "pid").withColumn("tokens", token_set(F.col("name"))).where(~F.array_contains("own_tokens", F.col("tokens")))
    grouped = joined.groupBy("person_id", "tokens", homonym_number(F.col("name")).alias("number")).agg(F.count("*").alias("shared"), F.max(F.struct("year", "title")).alias("latest"))
    return grouped.select("person_id", "tokens", "number", "shared", F.col("latest.year").alias("latest_year"), F.col("latest.title").alias("latest_title"))


def coauthor_conflicts(authors: DataFrame, index: DataFrame, *, least: int = 2) -> DataFrame:
    """Papers' authors met with people's co-authors by shared tokens, never all against all.

    Equal names are joined as whole sets. Where one name lies in the other, the shorter one's first pair of tokens (first
    token where one is enough) and its size meet those that the longer one could hold, so that names which only share
    some tokens do not meet. Tokens are sorted sets, as token_set() gives them. authors: paper_id, author, tokens, numbers
    (array of homonym numbers, may be empty). Equal names whose numbers differ are different people. The best evidence of each
    (paper, person): exact first, then more shared papers; pairs of papers and people with one row each need no ranking.
    Rows of one name are compared as a block, and pairs are made from blocks that match.
    """
    enough = lambda rows, key: rows.where(F.size("tokens") >= max(least, 1)).withColumn("_one", F.count("*").over(Window.partitionBy(key)) == 1)
    left = enough(authors.select("paper_id", "author", "tokens", "numbers"), "paper_id")
    right = enough(index.select("person_id", "tokens", "number", "shared", "latest_year", "latest_title"), "person_id").withColumnRenamed("tokens", "their_tokens")
    left = _blocks(left, ["paper_id", "author"], ["tokens", "numbers", "_one"], "_l")
    right = _blocks(right, ["person_id", "shared", "latest_year", "latest_title"], ["their_tokens", "number", "_one"], "_r")
    one = _opened(_met(left.where("_one").drop("_one"), right.where("_one").drop("_one"), least))
    out = ["paper_id", "person_id", "match", "author", "shared", "latest_year", "latest_title"]
    steps = [(left.where("not _one"), right), (left.where("_one"), right.where("not _one"))]
    several = [_met(a.drop("_one"), b.drop("_one"), least) for a, b in steps if a.limit(1).count() and b.limit(1).count()]
    if not several:
        return one.select(*out)
    many = _opened(reduce(DataFrame.unionByName, several))
    w = Window.partitionBy("paper_id", "person_id").orderBy(F.when(F.col("match") == "exact", 0).otherwise(1), F.desc("shared"), F.desc("latest_year"), "author", F.array_join("their_tokens", " "))
    best = many.withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    return one.select(*out).unionByName(best.select(*out))


def _met(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """Rows of authors and of the index whose names match, each two once, with match; those with other numbers left out."""
    keys, n = (token_pairs, 2) if least > 1 else (lambda tokens: tokens, 1)
    apart = (F.size("numbers") > 0) & (F.col("number") != "") & ~F.array_contains("numbers", F.col("number"))
    rows = _dealt_join(left.withColumn("key", F.col("tokens")), right.withColumn("key", F.col("their_tokens")), ["key"]).where(~apart).drop("key").withColumn("match", F.lit("exact"))
    for short, long, mine, theirs in ((left, right, "tokens", "their_tokens"), (right, left, "their_tokens", "tokens")):
        short = short.withColumns({"key": F.array_join(F.slice(mine, 1, n), " "), "_n": F.size(mine)})
        long = long.where(F.size(theirs) > max(least, 1)).withColumn("key", F.explode(keys(F.col(theirs)))).withColumn("_n", F.explode(F.sequence(F.lit(max(least, 1)), F.size(theirs) - 1)))
        a, b = (short, long) if mine == "tokens" else (long, short)
        inside = _dealt_join(a, b, ["key", "_n"]).where(F.size(F.array_except(mine, theirs)) == 0)
        rows = rows.unionByName(inside.drop("key", "_n").withColumn("match", F.lit("partial")))
    return rows


def collaborator_conflicts(people: DataFrame, authors: DataFrame) -> DataFrame:
    """person_declared, author_declared or institution, the first that holds.

    people: person_id, tokens, declared (array of token sets), institutions (tokens); authors: paper_id, author and the same.
    """
    # A pair is made at the least key of its first kind only, so that pairs are not shuffled to be told apart; people, and
    # authors, with the same names and institutions are compared as a block.
    joined = lambda names: F.transform(F.filter(names, lambda x: F.size(x) > 1), lambda x: F.array_join(x, " "))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    sides = []
    for rows, key, side, block in ((people, "person_id", "r", "_r"), (authors, "paper_id", "p", "_l")):
        names = rows.select(key, joined(F.array("tokens")).alias("n"), joined(F.col("declared")).alias("d"), F.array_compact("institutions").alias("i"))
        sides.append(_blocks(names.groupBy(key).agg(*[flat(c).alias(f"{side}_{c}") for c in "ndi"]), [key], [f"{side}_{c}" for c in "ndi"], block))
    steps, every = (("r_d", "p_n", "person_declared"), ("r_n", "p_d", "author_declared"), ("r_i", "p_i", "institution")), None
    for k, (mine, theirs, kind) in enumerate(steps):
        right, left = sides[0].withColumn("evidence", F.explode(mine)), sides[1].withColumn("evidence", F.explode(theirs))
        met = _dealt_join(left, right, ["evidence"]).where(F.array_min(F.array_intersect(mine, theirs)) == F.col("evidence"))
        for a, b, _ in steps[:k]:
            met = met.where(~F.arrays_overlap(a, b))
        rows = _opened(met.select("evidence", "_l", "_r")).select("paper_id", "person_id", F.lit(kind).alias("kind"), "evidence")
        every = rows if every is None else every.unionByName(rows)
    return every


def hard(conflicts: DataFrame) -> DataFrame:
    """Only name conflicts bar a pair; shared institutions are reported."""
    return conflicts.where("kind <> 'institution'")


def merge_layers(layers: list[tuple[str, DataFrame]], declared: DataFrame) -> DataFrame:
    """All layers' (paper_id, person_id) as one row per pair: the first layer, every layer, and whether it was declared."""
    every = None
    for k, (name, pairs) in enumerate(layers):
        rows = pairs.select("paper_id", "person_id", F.lit(k).alias("rank"), F.lit(name).alias("layer"))
        every = rows if every is None else every.unionByName(rows)
    merged = every.groupBy("paper_id", "person_id").agg(F.min_by("layer", "rank").alias("layer"), F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"))
    said = declared.select("paper_id", "person_id").distinct().withColumn("_said", F.lit(True))
    return merged.join(said, ["paper_id", "person_id"], "left").withColumn("declared", F.coalesce("_said", F.lit(False))).drop("_said")


def nominated(lines: Column) -> Column:
    """Addresses of lines 'name / affiliation / address'."""
    parts = F.transform(F.split(F.coalesce(lines, F.lit("")), "\n"), lambda x: F.split(x, "/"))
    return F.filter(F.transform(F.filter(parts, lambda p: F.size(p) >= 3), lambda p: F.lower(F.trim(F.element_at(p, -1)))), lambda e: F.contains(e, F.lit("@")))


def paper_people(slots: DataFrame, declared: DataFrame, spellings: DataFrame) -> DataFrame:
    """(paper_id, tokens, email, name, affiliation, numbers): authors and contacts under their own name and under each
    spelling of the id they declared; numbers are the homonym numbers of those spellings, empty where none is known.

    slots: paper_id, email, name, affiliation; declared: email, pid; spellings: pid, name. Of slots with equal tokens
    and address one row stays.
    """
    own = slots.withColumn("email", F.lower(F.trim(F.coalesce("email", F.lit("")))))
    links = declared.select(F.lower(F.trim("email")).alias("email"), "pid").join(spellings.select("pid", F.col("name").alias("spelling")), "pid").groupBy("email").agg(F.collect_set("spelling").alias("_known"))
    known = own.join(links, "email", "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>")))
    rows = known.select("paper_id", "email", "name", "affiliation", F.explode(F.array_distinct(F.concat(F.array("name"), "_known"))).alias("spelling"), "_known")
    rows = rows.select("paper_id", "email", "name", "affiliation", token_set(F.col("spelling")).alias("tokens"), F.when(F.array_contains("_known", F.col("spelling")), homonym_number(F.col("spelling"))).alias("number")).where(F.size("tokens") > 0)
    return rows.groupBy("paper_id", "tokens", "email").agg(F.min("name").alias("name"), F.min("affiliation").alias("affiliation"), F.array_sort(F.collect_set("number")).alias("numbers"))


def uncovered(people: DataFrame, key: str, coauthorships: DataFrame) -> DataFrame:
    """People of whom no co-author is known: that layer cannot see them, and finding nothing does not clear them."""
    return people.join(coauthorships.select(key).distinct(), key, "left_anti")
