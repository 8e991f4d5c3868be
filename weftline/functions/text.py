"""Columns for names, addresses, titles and ids; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters whose compatibility decomposition is one ASCII letter and marks, and that letter."""
    pairs = []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != chr(point):
            pairs.append((chr(point), base))
    a, b = zip(*pairs)
    return "".join(a), "".join(b)


ACCENTED, PLAIN = _accents()


def strip_accents(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"\p{M}", ""), ACCENTED, PLAIN)


def fold(c: Column) -> Column:
    """Accents off, lower case, everything but letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def ordered_tokens(c: Column, nicknames: dict[str, str] | None = None) -> Column:
    """Tokens of two letters or more in the order written, short forms expanded."""
    tokens = F.filter(F.split(fold(c), " "), lambda t: F.length(t) > 1)
    if nicknames:
        table = F.create_map(*[F.lit(x) for kv in sorted(nicknames.items()) for x in kv])
        tokens = F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), t))
    return tokens


def token_set(c: Column, nicknames: dict[str, str] | None = None) -> Column:
    """The same as a sorted set, without a trailing homonym number."""
    return F.array_sort(F.array_distinct(ordered_tokens(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+\d+\s*$", ""), nicknames)))


def token_pairs(tokens: Column) -> Column:
    """All pairs of a sorted set of tokens, a blank between the two."""
    return F.flatten(F.transform(tokens, lambda a: F.transform(F.filter(tokens, lambda b: b > a), lambda b: F.concat_ws(" ", a, b))))


def homonym_number(name: Column) -> Column:
    return F.regexp_extract(F.trim(name), r"\s(\d+)$", 1)


def names_match(one: Column, other: Column, least: int = 2) -> Column:
    """'exact' for equal sets, 'partial' where one holds the other; null otherwise, or if a side has fewer than least tokens."""
    shared = F.size(F.array_intersect(one, other))
    inside = (shared == F.size(one)) | (shared == F.size(other))
    return F.when((F.size(one) >= least) & (F.size(other) >= least), F.when(one == other, "exact").when(inside, "partial"))


def local_part(email: Column) -> Column:
    return F.when(F.contains(email, F.lit("@")), fold(F.substring_index(email, "@", 1))).otherwise("")


def registrable_domain(email: Column) -> Column:
    """The last two labels of an address's domain; empty with fewer."""
    labels = F.filter(F.split(F.lower(F.substring_index(email, "@", -1)), r"[^a-z0-9]+"), lambda x: x != "")
    return F.when(F.contains(email, F.lit("@")) & (F.size(labels) >= 2), F.array_join(F.slice(labels, -2, 2), ".")).otherwise("")


def display_name(first: Column, last: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.concat_ws(" ", first, last)), F.lit("")), email)


def parse_pid(url: Column) -> Column:
    """A person's id from a page address (also with the known typo of its path), or a bare id; else null."""
    path = F.regexp_extract(url, r"/p[io]d/([A-Za-z0-9]+/[A-Za-z0-9-]+)", 1)
    bare = F.regexp_extract(F.trim(url), r"^([A-Za-z0-9]+/[A-Za-z0-9-]+)$", 1)
    return F.coalesce(F.nullif(path, F.lit("")), F.nullif(bare, F.lit("")))


def split_ids(raw: Column) -> Column:
    """A delimited list by position: placeholders become empty, empty entries at the end go."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), r"[;,]\n|\n|;|,"), lambda p: F.trim(p))
    parts = F.transform(parts, lambda p: F.when(F.lower(p).isin("", "-", "none", "n/a", "na", "null"), "").otherwise(p))
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p != "", i + 1).otherwise(0)))
    return F.slice(parts, F.lit(1), F.coalesce(last, F.lit(0)))


def normalise_doi(value: Column) -> Column:
    found = F.regexp_extract(F.lower(value), r"(10\.\d{4,9}/[^\s\"<]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[.>,)]+$", ""), F.lit(""))


def sentence_count(c: Column) -> Column:
    """Stretches between . ! and ? that hold a letter."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "[.!?]+"), lambda x: x.rlike(r"\p{L}")))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


def strip_markup(c: Column) -> Column:
    """Tags out, the five basic entities back, white space one blank."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tag_names(tags: Column) -> Column:
    """Bare lower-case names of a cell of tags: no leading marks, no #value."""
    parts = F.filter(F.split(F.coalesce(tags, F.lit("")), r"\s+"), lambda t: t != "")
    return F.array_distinct(F.transform(parts, lambda t: F.lower(F.ltrim(F.substring_index(t, "#", 1), F.lit("~")))))


def has_role(roles: Column, role: str) -> Column:
    """A role as a whole word, not as part of one."""
    return F.array_contains(F.split(F.coalesce(roles, F.lit("")), r"\s+"), role)


def structural_role(roles: Column, tags: Column) -> Column:
    """chair, trc, sysadmin or area-chair, the first that holds; else null."""
    names = tag_names(tags)
    return (
        F.when(has_role(roles, "chair"), "chair").when(F.array_contains(names, "trc"), "trc").when(has_role(roles, "sysadmin"), "sysadmin")
        .when(F.exists(names, lambda t: F.endswith(t, F.lit("area-chairs"))), "area-chair")
    )


def one_tier(tags: Column, tiers: tuple[str, ...] = ("pc-full", "pc-light")) -> Column:
    """The tier if exactly one tag names one; else null."""
    found = F.array_intersect(tag_names(tags), F.array(*[F.lit(t) for t in tiers]))
    return F.when(F.size(found) == 1, found[0])


def collaborator_lines(text: Column) -> Column:
    """Lines 'Name (Institution)' as an array of (name, institution)."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.trim(F.regexp_replace(x, r"\s*\([^()]*\)\s*$", "")).alias("name"), F.regexp_extract(x, r"\(([^()]*)\)\s*$", 1).alias("institution")))


def distinctive_tokens(text: Column, stop: tuple[str, ...], least: int = 3) -> Column:
    """Folded words of at least so many letters that are not stop words, as a sorted set."""
    return F.array_sort(F.array_distinct(F.filter(F.split(fold(text), " "), lambda t: (F.length(t) >= least) & ~t.isin(*stop))))


def camel_words(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!^)(?=[A-Z])", " ")


def is_false_like(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "no", "false", "0")


def pid_name(pid: Column) -> Column:
    """The name inside a named id (area/GivenFamily, a number behind aside), words apart; null for other ids."""
    inner = F.regexp_extract(pid, r"^[A-Za-z]+/([A-Za-z]+?)\d*$", 1)
    return F.when(inner != "", F.regexp_replace(inner, r"(?<!^)(?=[A-Z])", " "))


def pid_url(pid: Column) -> Column:
    return F.concat(F.lit("https://dblp.org/pid/"), pid, F.lit(".html"))


def split_people(cell: Column) -> Column:
    """The people a cell names: A or B, A (or B), A/B."""
    parts = F.split(F.coalesce(cell, F.lit("")), r"(?i)\s*\(\s*or\s+|\)\s*|\s+or\s+|\s*/\s*")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def is_everyone(name: Column) -> Column:
    """A collaborator line that stands for the whole institution."""
    return F.lower(F.trim(F.coalesce(name, F.lit("")))) == "all"


def role_label(role: Column) -> Column:
    """A role's name in reports; null for roles that are none."""
    labels = {"reviewer": "reviewers", "area-chair": "area chairs", "reserve": "reserve reviewers", "trc": "TRC members"}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), role)


def document(primary: Column, secondary: Column | None = None, separator: str = "[SEP]") -> Column:
    """What a text encoder reads: a title, the separator, an abstract (or nothing)."""
    return F.concat(F.coalesce(primary, F.lit("")), F.lit(separator), F.lit("") if secondary is None else F.coalesce(secondary, F.lit("")))


def area_profile(areas: list[Column], keywords: Column, separator: str = "[SEP]") -> Column:
    """A person's areas, empty ones left out, and keywords as one document."""
    named = F.filter(F.array(*areas), lambda x: x.isNotNull() & (x != ""))
    return document(F.array_join(named, ", "), keywords, separator)
