"""Countries of people and papers."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import fold, strip_accents

#: Domains that say nothing of a country.
GENERIC = ("com", "edu", "org", "net", "gov", "mil", "int", "info", "biz", "name", "pro", "app", "dev", "xyz", "online", "site", "tech", "io", "ai", "co", "me", "tv", "cc", "ly", "to", "gg", "sh", "st", "fm", "am")


def country_codes() -> tuple[str, ...]:
    """The two-letter codes of ISO 3166, as the Java runtime lists them."""
    return tuple(sorted(SparkContext._active_spark_context._jvm.java.util.Locale.getISOCountries()))


def country_code(c: Column) -> Column:
    """A cell's code in capitals, if it is one of ISO 3166; else null."""
    code = F.upper(F.trim(c))
    return F.when(code.isin(*country_codes()), code)


def normalize_affiliation(c: Column) -> Column:
    """Lower case, no accents, marks or leading article, single blanks."""
    plain = F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", " ")
    return F.regexp_replace(F.trim(plain), "^the ", "")


def country_from_email(email: Column) -> Column:
    """The two-letter domain, uk as GB; null for generic ones and what is no country's code."""
    last = F.lower(F.regexp_extract(email, r"@[^@]*\.([A-Za-z]{2,})$", 1))
    return F.when((F.length(last) == 2) & ~last.isin(*GENERIC), country_code(F.when(last == "uk", "GB").otherwise(last)))


def country_from_cell(cell: Column, names: dict[str, str]) -> Column:
    """An account's country cell: a code, or a name of the table (by its normalised form); else null."""
    table = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv]) if names else F.lit(None).cast("map<string,string>")
    return F.coalesce(country_code(cell), F.try_element_at(table, normalize_affiliation(cell)))


def country_from_text(df: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, country): the longest country name among the words of a text, of equals the last.

    A country that another one found here outranks is out, unless that leaves none. names: name, country, outranks (a
    country this one is part of, or null); a row each, names of any length. Each word of a text meets only the names that
    begin with it, and carries no more words than the longest of them has.
    """
    table = names.select(F.split(normalize_affiliation(F.col("name")), " ").alias("parts"), "country", "outranks").where("parts[0] <> ''").withColumn("first", F.col("parts")[0])
    longest = table.agg(F.max(F.size("parts"))).first()[0] or 1
    words = F.split(normalize_affiliation(F.col(text)), " ")
    places = df.select(key, words.alias("w")).select(key, F.posexplode(F.transform("w", lambda x, i: F.slice(F.col("w"), i + 1, longest))).alias("at", "ahead"))
    found = places.withColumn("first", F.col("ahead")[0]).join(table, "first").withColumn("n", F.size("parts")).where(F.slice("ahead", 1, F.col("n")) == F.col("parts"))
    found = found.select(key, "country", "outranks", F.struct("n", "at").alias("rank"))
    best = found.groupBy(key, "country").agg(F.max("rank").alias("rank"))
    beaten = found.where("outranks is not null").select(key, F.col("outranks").alias("country")).distinct().withColumn("_beaten", F.lit(True))
    marked = best.join(beaten, [key, "country"], "left")
    return marked.groupBy(key).agg(F.max_by("country", F.struct(F.col("_beaten").isNull(), "rank", "country")).alias("country"))


#: Words of a note that tell no institution.
NOTE_WORDS = tuple(
    """
    university universite universitat universidad univ college institute institut school department dept faculty
    laboratory laboratories lab labs center centre research academy academic technology technological science sciences
    engineering computer computing national state of the and for at in a
    """.split()
)


def note_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_affiliation(text), " "), lambda t: (t != "") & ~t.isin(*NOTE_WORDS)))


def country_from_notes(people: DataFrame, key: str, notes: DataFrame, names: DataFrame) -> DataFrame:
    """(key, country) by the note of a person's page that shares most words with their affiliation, of equals the first;
    none where no word is shared. people: key, pid, affiliation; notes: pid, place, note."""
    rows = people.select(key, "pid", note_words(F.col("affiliation")).alias("_w")).join(notes, "pid").withColumn("_n", F.size(F.array_intersect(note_words(F.col("note")), "_w"))).where("_n > 0")
    best = rows.groupBy(key).agg(F.max_by("note", F.struct("_n", F.negate("place"))).alias("note"))
    return country_from_text(best, key, "note", names)


LAYERS = ("account", "hand", "notes", "affiliation", "email")


def resolve_countries(people: DataFrame, key: str, names: DataFrame, *, accounts: DataFrame | None = None, hand: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """(key, country, layer): the first of LAYERS that knows; no country and the layer unresolved where none does.

    What people told their account comes first, then the curated table, their page's notes, the affiliation's own words
    and the address. people: key (one row each), affiliation, email, account_email, pid; authors have no pid, and null is
    fine anywhere. accounts: email, country; hand: affiliation, country; notes: pid, place, note.
    """
    rows = people.select(key, "affiliation", "email", "account_email", "pid")
    if accounts is not None:
        told = accounts.select(F.lower(F.trim("email")).alias("_a"), country_code(F.col("country")).alias("_c")).where("_a <> '' and _c is not null").groupBy("_a").agg(F.min("_c").alias("account"))
        rows = rows.withColumn("_a", F.lower(F.trim("account_email"))).join(told, "_a", "left")
    if hand is not None:
        table = hand.select(normalize_affiliation(F.col("affiliation")).alias("_h"), F.col("country").alias("_c")).where("_h <> '' and _c is not null").groupBy("_h").agg(F.min("_c").alias("hand"))
        rows = rows.withColumn("_h", normalize_affiliation(F.col("affiliation"))).join(table, "_h", "left")
    if notes is not None:
        rows = rows.join(country_from_notes(people, key, notes, names).withColumnRenamed("country", "notes"), key, "left")
    rows = rows.join(country_from_text(people, key, "affiliation", names).withColumnRenamed("country", "_text"), key, "left")
    known = {"affiliation": F.col("_text"), "email": country_from_email(F.col("email"))} | {c: F.col(c) for c, given in (("account", accounts), ("hand", hand), ("notes", notes)) if given is not None}
    country, layer = waterfall([(n, known[n]) for n in LAYERS if n in known])
    return rows.select(key, country.alias("country"), F.coalesce(layer, F.lit("unresolved")).alias("layer"))


def waterfall(layers: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(country, layer) of the first layer that knows."""
    return F.coalesce(*[c for _, c in layers]), F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in layers])


def best_note(df: DataFrame, key: str, wanted: str, notes: str) -> DataFrame:
    """(key, note, shared): of an array of notes (token arrays) the one sharing most tokens, the first of equals; none if no token."""
    rows = df.select(key, wanted, F.posexplode(notes).alias("at", "note")).withColumn("shared", F.size(F.array_intersect("note", wanted))).where("shared > 0")
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("shared"), "at"))).where("_rank = 1").select(key, F.array_join("note", " ").alias("note"), "shared")


def paper_countries(authors: DataFrame, *, majority: float = 0.5, min_resolved: float = 0.5) -> DataFrame:
    """Per paper: country of more than majority of the placed authors where enough are placed, else null.

    authors: paper_id, country (null if unknown). Also n_authors, n_placed, n_top and thin (too few placed).
    """
    per = authors.groupBy("paper_id").agg(F.count("*").alias("n_authors"), F.count("country").alias("n_placed"))
    top = authors.where("country is not null").groupBy("paper_id", "country").agg(F.count("*").alias("n"))
    best = top.groupBy("paper_id").agg(F.max(F.struct("n", "country")).alias("top"))
    out = per.join(best, "paper_id", "left").withColumn("thin", F.col("n_placed") < F.col("n_authors") * min_resolved)
    wins = ~F.col("thin") & (F.col("top.n") > F.col("n_placed") * majority)
    return out.select("paper_id", "n_authors", "n_placed", F.col("top.n").alias("n_top"), "thin", F.when(wins, F.col("top.country")).alias("country"))
