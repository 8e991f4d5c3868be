"""Readers: submissions, forms, accounts, logs, assignments, curated files, caches, bibliographies, worksheets.

Empty cells, missing keys and nulls mean the same. A missing optional file is an empty relation; a file that safety
depends on must be there and hold rows.
"""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import is_false_like, normalise_doi, parse_pid, tag_names
from weftline.operators.dedup import best_row
from weftline.sources.bibliography import KINDS, Dump

PERSON = "struct<email:string,given_name:string,family_name:string,affiliation:string>"
PAPERS = (
    f"pid int, title string, abstract string, topics array<string>, authors array<{PERSON}>, contacts array<{PERSON}>, pc_conflicts map<string,string>, "
    "status string, withdrawn boolean, submitted_at bigint, dblp string, reserve_reviewer string, tags array<string>"
)
LOG = ("date", "ipaddr", "email", "roles", "affected_email", "via", "paper", "action")
UPLOAD, PAIRS = ("paper", "action", "email", "round"), ("pid", "email", "phase", "rank_score", "affinity")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def csv(spark: SparkSession, path: str, *, required: bool = True, columns: str = "email string", spans: bool = True) -> DataFrame:
    """All columns as strings; a missing optional file has no rows, with the given columns.

    Quoted cells may span lines, which takes a task a file; a file whose cells never do (spans=False) is cut among many.
    """
    if not required and not exists(spark, path):
        return spark.createDataFrame([], columns)
    return spark.read.option("header", True).option("multiLine", spans).option("escape", '"').csv(path)


def field(df: DataFrame, needle: str) -> Column:
    """The first column whose header holds the needle, whatever its case."""
    for name in df.columns:
        if needle.lower() in name.lower():
            return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))
    raise ValueError(f"no column holds {needle!r}")


def need(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def fail_on(df: DataFrame, bad: Column, say: Column, what: str) -> DataFrame:
    """Raise, naming some of the rows, if any row is bad."""
    found = [r[0] for r in df.where(bad).select(say).limit(5).collect()]
    if found:
        raise ValueError(f"{what}: {', '.join(map(str, found))}")
    return df


def papers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAPERS).option("multiLine", True).json(path)


def accounts(spark: SparkSession, path: str) -> DataFrame:
    """The user export with its topic columns as a map; refuses an export without members."""
    raw = csv(spark, path)
    topics = [c for c in raw.columns if c.lower().startswith("topic: ")]
    pairs = F.array(*[F.struct(F.lit(c[7:].strip()).alias("topic"), F.expr(f"try_cast(`{c}` as int)").alias("interest")) for c in topics]) if topics else F.expr("cast(array() as array<struct<topic:string,interest:int>>)")
    out = raw.withColumn("email", F.lower(F.trim("email"))).withColumn("disabled", ~is_false_like(F.col("disabled"))).withColumn("tag_names", tag_names(F.col("tags")))
    out = out.withColumn("topic_interests", F.map_from_entries(F.filter(pairs, lambda p: p["interest"].isNotNull()))).drop(*topics)
    if not out.where("array_contains(split(roles, ' '), 'pc')").limit(1).count():
        raise ValueError("the export holds no member")
    return out


def top_topics(df: DataFrame, key: str, most: int, least: int = 1) -> DataFrame:
    rows = df.select(key, F.explode("topic_interests").alias("topic", "interest")).where(F.col("interest") >= least)
    ordered = rows.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("interest")).alias("o"), "topic"))), 1, most).alias("t"))
    return ordered.select(key, F.transform("t", lambda x: x["topic"]).alias("topics"))


def form(spark: SparkSession, path: str, needles: dict[str, str], *, answer: str, accepts: Column | None = None) -> DataFrame:
    """An acceptance form: columns by header, the latest row of each address, those who do not decline."""
    raw = csv(spark, path)
    rows = raw.select(*[field(raw, n).alias(k) for k, n in needles.items()]).withColumn("position", F.monotonically_increasing_id()).withColumn("email", F.lower("email"))
    rows = rows.where("email <> ''").withColumn("at", F.try_to_timestamp("timestamp", F.lit("M/d/yyyy H:mm:ss")))
    latest = best_row(rows, ["email"], [F.desc("at"), F.asc("position")])
    keep = accepts if accepts is not None else ~F.contains(F.lower(F.col(answer)), F.lit("unable"))
    return latest.where(keep)


def with_overrides(people: DataFrame, identity: DataFrame, areas: DataFrame, caps: DataFrame) -> DataFrame:
    """Curated values win over the form's; blank ones decide nothing."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    ids = fail_on(identity.select("email", blank("dblp").alias("said")).where("said is not null").withColumn("_pid", parse_pid(F.col("said"))), F.col("_pid").isNull(), F.col("email"), "not an id")
    cap = fail_on(caps.select("email", blank("cap").alias("said")).where("said is not null").withColumn("_cap", F.expr("try_cast(said as int)")), F.coalesce(F.col("_cap") < 0, F.lit(True)), F.col("email"), "not a cap")
    area = areas.where(blank("primary").isNotNull()).select("email", *[blank(c).alias(f"_{c}") for c in ("primary", "secondary", "tertiary")])
    out = people.join(ids.select("email", "_pid"), "email", "left").join(area, "email", "left").join(cap.select("email", "_cap"), "email", "left")
    out = out.withColumns({"pid_from_override": F.col("_pid").isNotNull(), "pid": F.coalesce("_pid", "pid"), "override_cap": F.coalesce("_cap", "override_cap")})
    own = F.col("_primary").isNotNull()
    return out.withColumns({c: F.when(own, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("primary", "secondary", "tertiary")}).drop("_pid", "_cap", "_primary", "_secondary", "_tertiary")


def roster(spark: SparkSession, role: str, paths: dict[str, str]) -> DataFrame:
    """The people of one role: reviewer, area-chair, trc or reserve."""
    common = {"timestamp": "Timestamp", "email": "email address", "first": "First Name", "last": "Last Name", "dblp_url": "DBLP", "affiliation": "institutional affiliation", "primary": "primary area", "secondary": "secondary area", "keywords": "keywords"}
    if role == "reviewer":
        return form(spark, paths["form"], common | {"answer": "PC membership", "tertiary": "tertiary area", "cap": "Override paper assignment number"}, answer="answer").withColumn("role", F.lit(role))
    if role == "area-chair":
        return form(spark, paths["form"], common | {"answer": "Area Chair membership"}, answer="answer", accepts=F.startswith(F.lower(F.col("answer")), F.lit("yes"))).withColumn("role", F.lit(role))
    if role == "trc":
        rows = form(spark, paths["form"], common | {"answer": "TRC membership", "advisors": "Advisor's Email"}, answer="answer").where(F.contains("email", F.lit("@")))
        return rows.withColumn("advisor_emails", F.filter(F.transform(F.split("advisors", ";"), lambda x: F.lower(F.trim(x))), lambda x: x != "")).withColumn("role", F.lit(role))
    if role == "reserve":
        return csv(spark, paths["info"]).withColumn("email", F.lower(F.trim("email"))).withColumn("role", F.lit(role))
    raise ValueError(f"no such role: {role}")


def action_log(spark: SparkSession, path: str) -> DataFrame:
    """The log in the order things happened (the file has the newest first), with a sequence."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if tuple(raw.columns) != LOG:
        raise ValueError(f"the log's header is {raw.columns}")
    at = raw.withColumn("sequence", -F.monotonically_increasing_id())
    return at.withColumns({c: F.lower(F.coalesce(c, F.lit(""))) for c in ("email", "affected_email")})


def assignment_format(columns: list[str]) -> str:
    if tuple(columns[:4]) == UPLOAD:
        return "upload"
    if {"pid", "email"} <= set(columns):
        return "pairs"
    raise ValueError(f"not an assignment: {columns}")


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """Either file shape as (paper_id, person_id, phase, affinity); of an upload only primary reviews."""
    raw = csv(spark, path, spans=False)
    if assignment_format(raw.columns) == "upload":
        rows = raw.where("action = 'primaryreview'")
        return rows.select(F.expr("try_cast(paper as int)").alias("paper_id"), F.lower(F.trim("email")).alias("person_id"), F.lit(None).cast("string").alias("phase"), F.lit(None).cast("double").alias("affinity")).where("paper_id is not null").distinct()
    return raw.select(F.col("pid").cast("int").alias("paper_id"), F.lower(F.trim("email")).alias("person_id"), "phase", F.expr("try_cast(affinity as double)").alias("affinity"))


def email_list(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("email"))
    return lines.where("email <> ''").distinct()


def curated(spark: SparkSession, path: str, columns: tuple[str, ...], *, required: bool = False) -> DataFrame:
    """A file of overrides kept by hand: its columns must be there, its address in lower case, rows without one left out."""
    df = need(csv(spark, path, required=required, columns=", ".join(f"{c} string" for c in columns)), columns)
    return df.select(F.lower(F.trim(columns[0])).alias(columns[0]), *[F.trim(c).alias(c) for c in columns[1:]]).where(F.col(columns[0]) != "")


def publication_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map person id -> [{title, year, venue, type, doi}] as rows."""
    record = "map<string,array<struct<title:string,year:int,venue:string,type:string,doi:string>>>"
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", record)).alias("pid", "records")).select("pid", F.inline("records"))


def title_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map person id -> [[year, title], ...] as rows; entries without year or title are left out."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("pid", "entries")).select("pid", F.posexplode("entries").alias("position", "e"))
    return rows.select("pid", "position", F.expr("try_cast(e[0] as int)").alias("year"), F.expr("e[1]").alias("title")).where("year is not null and title is not null")


def coauthor_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map person id -> name -> [[year, title], ...] as rows."""
    text = spark.read.option("wholetext", True).text(path)
    names = text.select(F.explode(F.from_json("value", "map<string,map<string,array<array<string>>>>")).alias("pid", "names")).select("pid", F.explode("names").alias("name", "works"))
    return names.select("pid", "name", F.explode("works").alias("w")).select("pid", "name", F.expr("try_cast(w[0] as int)").alias("year"), F.expr("w[1]").alias("title"))


def embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map key -> {vector, fingerprint_key} as rows: key, vector, content_key.

    The file is cut at closing braces, of which an entry has one, so that a map of any size is read by many tasks, an
    entry at a time, also where it is all one line. Raises at what is no entry, as where a key holds a brace.
    """
    text = spark.read.option("lineSep", "}").text(path)
    body = F.regexp_replace("value", r"^[\s,{]+", "")
    record = F.from_json(F.concat(F.lit("{"), body, F.lit("}}")), "map<string,struct<vector:array<double>,fingerprint_key:string>>")
    entries = text.where(body != "").select(F.coalesce(record, F.raise_error(F.lit("not an entry of a vector cache")).cast("map<string,struct<vector:array<double>,fingerprint_key:string>>")).alias("m"))
    return entries.select(F.explode("m").alias("key", "e")).select("key", "e.vector", F.col("e.fingerprint_key").alias("content_key"))


def bibliography(spark: SparkSession, path: str, kinds: tuple[str, ...] = KINDS, **options: str) -> DataFrame:
    """Records of a bibliography dump, of all kinds in one scan: kind, key, fields (name, type, text)."""
    spark.dataSource.register(Dump)
    return spark.read.format("bibliography").options(kinds=",".join(kinds), **options).load(path)


def texts(name: str, kind: str | None = None) -> Column:
    """What the fields of a name (and a type) hold, blanks left out."""
    mine = F.filter("fields", lambda f: (f["name"] == name) & (f["text"] != "") & ((f["type"] == kind) if kind else F.lit(True)))
    return F.transform(mine, lambda f: f["text"])


def bibliography_people(spark: SparkSession, path: str, wanted: DataFrame | None = None, **options: str) -> DataFrame:
    """Person records: pid, spellings, affiliation notes; only wanted ids (column pid) if given."""
    rows = bibliography(spark, path, ("www",), **options).where(F.startswith("key", F.lit("homepages/")))
    out = rows.select(F.expr("substring(key, 11)").alias("pid"), texts("author").alias("spellings"), texts("note", "affiliation").alias("notes"))
    return out if wanted is None else out.join(wanted.select("pid").distinct(), "pid", "left_semi")


def bibliography_works(spark: SparkSession, path: str, people: DataFrame, *, since: int | None = None, **options: str) -> tuple[DataFrame, DataFrame]:
    """(publications, co-authorships) of people (pid, spellings) from all records but people's own, one scan each.

    A record counts once for each person, whatever number of spellings it shows; one without title or whole year is left
    out. Co-authorships are of since or later, and leave out the person's own spellings.
    """
    first = lambda name: F.get(texts(name), F.lit(0))
    rows = bibliography(spark, path, tuple(k for k in KINDS if k not in ("www", "person")), **options).select(
        "key", F.col("kind").alias("type"), texts("author").alias("authors"), first("title").alias("title"), first("year").try_cast("int").alias("year"),
        F.coalesce(first("booktitle"), first("journal"), F.lit("")).alias("venue"), F.coalesce(F.get(F.array_compact(F.transform(texts("ee"), normalise_doi)), F.lit(0)), F.lit("")).alias("doi"),
    ).where("title is not null and year is not null")
    names = people.select("pid", "spellings", F.explode("spellings").alias("name"))
    hit = rows.withColumn("name", F.explode(F.array_distinct("authors"))).join(names, "name").dropDuplicates(["key", "title", "pid"])
    publications = hit.select("pid", "title", "year", "venue", "type", "doi")
    late = hit if since is None else hit.where(F.col("year") >= since)
    together = late.select("pid", "year", "title", "spellings", F.explode("authors").alias("coauthor")).where(~F.array_contains("spellings", F.col("coauthor")))
    return publications, together.select("pid", F.col("coauthor").alias("name"), "year", "title").distinct()


def assigned_in_report(spark: SparkSession, path: str) -> DataFrame:
    """Paper numbers with an indented assignee below them in a text report."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    marked = lines.select("at", "line", F.expr("try_cast(nullif(regexp_extract(line, '^ {0,2}#?([0-9]+)', 1), '') as int)").alias("paper_id"))
    owner = F.last("paper_id", ignorenulls=True).over(Window.orderBy("at"))
    return marked.withColumn("owner", owner).where("paper_id is null and line rlike '^ {3,}.*@'").select(F.col("owner").alias("paper_id")).distinct()


def worksheet(path: str, sheet: str) -> list[list[str]]:
    """Rows of a worksheet of an .xlsx file, gaps as empty cells; a small file, read on the driver."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        names = [s.get("name") for s in book.findall("m:sheets/m:sheet", space)]
        if sheet not in names:
            raise ValueError(f"no sheet {sheet!r}")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter("{%s}t" % space["m"])) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", space)]
        body = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{names.index(sheet) + 1}.xml"))
    rows = []
    for row in body.iter("{%s}row" % space["m"]):
        cells: dict[int, str] = {}
        for cell in row.findall("m:c", space):
            value = cell.find("m:v", space)
            text = "".join(t.text or "" for t in cell.iter("{%s}t" % space["m"])) if cell.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
            cells[column_index(cell.get("r"))] = shared[int(text)] if cell.get("t") == "s" else text
        rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return rows


def column_index(reference: str) -> int:
    """A1 -> 0, B7 -> 1, AA1 -> 26."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1
