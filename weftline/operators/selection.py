"""Which submissions count, with a reason for each that does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import sentence_count, word_count

PLACEHOLDERS = ("test",)


def withdrawn(status: Column, flag: Column | None = None) -> Column:
    by_status = F.lower(F.coalesce(status, F.lit(""))) == "withdrawn"
    return by_status if flag is None else F.coalesce(flag, F.lit(False)) | by_status


def _reasons(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(rule, reason) for rule, reason in rules]))


def registration_gaps(title: Column, abstract: Column, n_authors: Column, gone: Column, placeholders: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """Registered: a real title, two sentences of abstract, an author, not withdrawn."""
    clean = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return _reasons((clean == "", "no title"), (clean.isin(*placeholders), "placeholder title"), (sentence_count(abstract) < 2, "abstract under two sentences"), (F.coalesce(n_authors, F.lit(0)) < 1, "no authors"), (gone, "withdrawn"))


def completeness_gaps(title: Column, abstract: Column, n_topics: Column, n_authors: Column, gone: Column) -> Column:
    """Complete: three words of title, an abstract, a topic, an author, not withdrawn."""
    return _reasons((word_count(title) < 3, "title under three words"), (F.trim(F.coalesce(abstract, F.lit(""))) == "", "no abstract"), (F.coalesce(n_topics, F.lit(0)) < 1, "no topics"), (F.coalesce(n_authors, F.lit(0)) < 1, "no authors"), (gone, "withdrawn"))


def submission_gaps(status: Column, gone: Column) -> Column:
    return _reasons((F.lower(F.coalesce(status, F.lit(""))) != "submitted", "not submitted"), (gone, "withdrawn"))


def selection_gaps(policy: str, pid: Column, excluded: set[int], **columns: Column) -> Column:
    """Why a submission is out under a policy: registered, complete or submitted. An exclusion by hand comes alone."""
    rules = {
        "registered": lambda c: registration_gaps(c["title"], c["abstract"], c["n_authors"], c["gone"]),
        "complete": lambda c: completeness_gaps(c["title"], c["abstract"], c["n_topics"], c["n_authors"], c["gone"]),
        "submitted": lambda c: submission_gaps(c["status"], c["gone"]),
    }
    if policy not in rules:
        raise ValueError(f"no such policy: {policy}")
    gaps = rules[policy](columns)
    return F.when(pid.isin(*sorted(excluded)), F.array(F.lit("excluded"))).otherwise(gaps) if excluded else gaps


def split_selected(df: DataFrame, gaps: str = "gaps") -> tuple[DataFrame, DataFrame]:
    """(selected, rejected with their reasons)."""
    return df.where(F.size(gaps) == 0).drop(gaps), df.where(F.size(gaps) > 0)


def parse_exclude(value: str | None) -> set[int]:
    return {int(x) for x in (value or "").replace(",", " ").split()}
