"""Writers: one CSV file in place at once, and the shapes that uploads want."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """One CSV file under its final name; a failed write leaves the old file as it was."""
    spark = df.sparkSession
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    store = target.getFileSystem(hadoop)
    # Uploads are read by one program from one file, so they are gathered here; they hold a row per assignment.
    rows = (df.orderBy(*order) if order else df).coalesce(1)
    try:
        rows.write.option("header", True).option("quoteAll", False).option("emptyValue", "").option("escape", '"').csv(draft.toString())
        part = next(s.getPath() for s in store.listStatus(draft) if s.getPath().getName().startswith("part-"))
        store.delete(target, False)
        store.rename(part, target)
    finally:
        store.delete(draft, True)


def replacing_upload(assigned: DataFrame, accounts: DataFrame, round_: str = "R1") -> DataFrame:
    """A row that clears the round, then the assignments by paper, falling score and address; addresses as accounts have them."""
    spark = assigned.sparkSession
    clear = spark.createDataFrame([(0, 0.0, "all", "clearreview", "all", round_)], "paper_id int, score double, paper string, action string, email string, round string")
    named = assigned.join(accounts.select("person_id", "account_email"), "person_id", "left").withColumn("email", F.coalesce("account_email", "person_id"))
    rows = named.select(F.lit(1).alias("block"), F.col("paper_id").cast("int").alias("paper_id"), F.col("score").cast("double").alias("score"), F.col("paper_id").cast("string").alias("paper"), F.lit("primaryreview").alias("action"), "email", F.lit(round_).alias("round"))
    return clear.withColumn("block", F.lit(0)).unionByName(rows)


def write_upload(assigned: DataFrame, accounts: DataFrame, path: str, round_: str = "R1") -> None:
    rows = replacing_upload(assigned, accounts, round_).orderBy("block", "paper_id", F.desc("score"), "email")
    write_csv(rows.select("paper", "action", "email", "round"), path)


def write_pairs(assigned: DataFrame, path: str) -> None:
    write_csv(assigned.select(F.col("paper_id").alias("pid"), F.col("person_id").alias("email"), "phase", "rank_score", "affinity"), path, [F.col("pid"), F.desc("rank_score"), F.col("email")])


def track_tag(n) -> F.Column:
    return F.concat(F.lit("track_"), n.cast("string"))


def account_tags(chairs: DataFrame, clear_through: int) -> DataFrame:
    """Per chair: drop the whole range of track tags, then add the chair's own. chairs: email, track."""
    drop = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(clear_through)), track_tag), " ")
    return chairs.select("email", drop.alias("remove_tags"), track_tag(F.col("track")).alias("add_tags"))


def paper_tags(spark: SparkSession, placed: DataFrame, clear_through: int) -> DataFrame:
    """Rows that clear every track tag from all papers, then one tag a paper. placed: paper_id, track."""
    clear = spark.range(1, clear_through + 1).select(F.lit("all").alias("paper"), F.lit("cleartag").alias("action"), track_tag(F.col("id")).alias("tag"))
    return clear.unionByName(placed.select(F.col("paper_id").cast("string").alias("paper"), F.lit("tag").alias("action"), track_tag(F.col("track")).alias("tag")))


def distinct_paper_tag(spark: SparkSession, papers: DataFrame, tag: str) -> DataFrame:
    clear = spark.createDataFrame([("all", "cleartag", tag)], "paper string, action string, tag string")
    return clear.unionByName(papers.select(F.col("paper_id").cast("string").alias("paper")).distinct().select("paper", F.lit("tag").alias("action"), F.lit(tag).alias("tag")))


def stray_tags(papers: DataFrame, clear_through: int) -> DataFrame:
    """Track-like tags of papers outside the range that is cleared anyway."""
    tags = papers.select(F.explode("tags").alias("tag")).select(F.lower(F.ltrim(F.substring_index("tag", "#", 1), F.lit("~"))).alias("tag")).distinct()
    number = F.expr("try_cast(regexp_extract(tag, '^track_([0-9]+)$', 1) as int)")
    return tags.where(number.isNotNull() & ~number.between(1, clear_through))


def disable_users(accounts: DataFrame, keep: set[str]) -> DataFrame:
    """Every account but the kept ones; blank or repeated addresses and missing keepers raise."""
    emails = accounts.select(F.lower(F.trim("email")).alias("email"))
    n, d, blank = emails.agg(F.count("*"), F.countDistinct("email"), F.count_if(F.col("email") == "")).first()
    if blank or n != d:
        raise ValueError("addresses are blank or repeated")
    if emails.where(F.col("email").isin(*keep)).count() != len(keep):
        raise ValueError("an account to keep is not there")
    return emails.where(~F.col("email").isin(*keep)).select("email", F.lit("yes").alias("disabled"))


def append_missing(existing: DataFrame, stubs: DataFrame, key: str) -> DataFrame:
    return existing.unionByName(stubs.join(existing.select(key), key, "left_anti").select(*existing.columns))
