"""Identity columns: composite ids, posting ids, company keys, slugs, document keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.links import company_domain, link_identity, name_from_domain
from vacancylens.functions.text import blank, col, either, filled, let, norm_text, slug, words


def company_words(c: Column | str) -> Column:
    """Normalised company name without legal suffixes."""
    bare = F.regexp_replace(norm_text(c), fixed.LEGAL_SUFFIXES, " ")
    return F.trim(F.regexp_replace(bare, " +", " "))


def composite_id(company: Column | str, title: Column | str, metro: Column | str | None = None,
                 split_city: bool = False) -> Column:
    """`company|title|city`. The city keeps its region unless `split_city` cuts it at the first comma."""
    if metro is None:
        city = F.lit("")
    else:
        city = norm_text(F.split_part(blank(metro), F.lit(","), F.lit(1))) if split_city else norm_text(metro)
    return F.concat(company_words(company), F.lit("|"), norm_text(title), F.lit("|"), city)


def job_id(company: Column | str, title: Column | str, link: Column | str) -> Column:
    """Composite id; the canonical link only where company and title are both empty."""
    composite = composite_id(company, title)
    return F.when(F.btrim(composite, F.lit("|")) != "", composite).otherwise(either(link_identity(link), composite))


def company_key(c: Column | str) -> Column:
    """Company name squashed to letters and digits, legal suffixes gone."""
    return F.replace(company_words(c), F.lit(" "), F.lit(""))


def same_company(a: Column, b: Column) -> Column:
    """Keys equal, or the shorter (five characters or more) inside the longer. Takes company keys."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a != "") & (b != "") & ((a == b) | ((F.length(short) >= 5) & long.contains(short)))


def cache_key(c: Column | str) -> Column:
    """Key of a cached entity brief, from a name or an address: its site's name, else the address, else the company."""
    def key(target: Column) -> Column:
        def of_domain(domain: Column) -> Column:
            path = F.regexp_extract(target, r"^https?://([^?#;]*)", 1)
            by_path = F.substring(slug(path, "-", "unnamed"), 1, 80)
            is_url = target.rlike("^https?://")
            name = F.when(is_url, either(name_from_domain(domain), domain)).otherwise(target)
            bare = either(company_key(name), F.when(is_url, F.lit("")).otherwise(target))
            return F.when(is_url & (domain == ""), by_path).otherwise(slug(bare, "-", "unnamed"))

        return let(company_domain(target), of_domain)

    return let(F.trim(blank(c)), key)


def board_slugs(c: Column | str) -> Column:
    """Board names to try for a company: words joined, then words hyphenated where that differs."""
    parts = words(F.regexp_replace(F.lower(blank(c)), fixed.BOARD_SLUG_NOISE, " "))
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.array(F.array_join(parts, ""), F.array_join(parts, "-")))
    )


def pretty_token(c: Column | str) -> Column:
    """Board token as a display name."""
    spaced = F.trim(F.regexp_replace(blank(c), r"[-_\s]+", " "))
    return F.array_join(
        F.transform(F.split(spaced, " "),
                    lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def metric_slug(c: Column | str) -> Column:
    return slug(F.trim(blank(c)), "_")


def folder_slug(c: Column | str) -> Column:
    return slug(c, "-", "unknown")


def document_key(kind: Column | str, posting_id: Column | str, source: Column | str, path: Column | str,
                 part: Column | str) -> Column:
    """`md:source#path#part` for document chunks, `job:id` for postings."""
    md = F.concat(F.lit("md:"), blank(source), F.lit("#"), blank(path), F.lit("#"),
                  F.coalesce(col(part).cast("string"), F.lit("0")))
    return F.when(col(kind) == "markdown", md).otherwise(F.concat(F.lit("job:"), blank(posting_id)))


def with_identity(df, company: str = "company", title: str = "title", link: str = "link"):
    """Adds `id` and `link_key` once, so later steps do not compute them again."""
    return df.withColumn("id", job_id(company, title, link)).withColumn("link_key", filled(link_identity(link)))
