"""Identifiers of records: DOI, arXiv and URL forms, and the chronology that arXiv ids encode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two styles of arXiv identifiers.
NEW = r"^([0-9]{2})([0-9]{2})\.([0-9]{4,5})(?:v[0-9]+)?$"
OLD = r"^[a-z][a-z-]*(?:\.[a-z-]+)?/([0-9]{2})([0-9]{2})([0-9]{3})(?:v[0-9]+)?$"
DOI_PREFIX = "10.48550/arxiv."


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is named once, so that expressions which use it often stay small wherever they are pushed."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def without_version(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"(?i)v[0-9]+$", "")


def is_arxiv(x: Column) -> Column:
    return F.lower(x).rlike(NEW) | F.lower(x).rlike(OLD)


def recognized(x: Column, bare: bool = False) -> Column:
    """``arxiv:ID`` without its version, or null. Bare forms count only if asked for."""

    def told(text: Column) -> Column:
        prefixed = F.lower(text).startswith("arxiv:")
        named = bound(F.trim(F.try_url_decode(F.substring(text, F.lit(7), F.length(text)))), lambda after: F.when(after != "", F.concat(F.lit("arxiv:"), without_version(after))))
        found = F.when(prefixed, named)
        return found.when(~prefixed & is_arxiv(text), F.concat(F.lit("arxiv:"), without_version(text))) if bare else found

    return bound(F.trim(x), told)


def chronology(x: Column) -> Column:
    """year * 10,000,000 + month * 100,000 + sequence of an arXiv id, or null; two-digit years from 91 are of the last century."""

    def packed(text: Column, pattern: str) -> Column:
        y, m, s = (F.regexp_extract(text, pattern, k).cast("long") for k in (1, 2, 3))
        year = F.when(y >= 91, y + 1900).otherwise(y + 2000)
        return F.when(m.between(1, 12), year * 10_000_000 + m * 100_000 + s)

    return bound(F.regexp_replace(F.lower(F.trim(x)), "^arxiv:", ""), lambda t: F.when(t.rlike(NEW), packed(t, NEW)).when(t.rlike(OLD), packed(t, OLD)))


def doi(x: Column) -> Column:
    """A DOI in lower case from bare, prefixed or URL form, or null."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"^https?://(?:[a-z0-9.-]*\.)?doi\.org/", ""), "^doi: *", "")
    return bound(text, lambda t: F.when(t.rlike(r"^10\.[0-9]{4,9}/\S+$"), t))


def arxiv_of_doi(x: Column) -> Column:
    """The arXiv id of a DOI that arXiv issued; its month is checked."""
    number = lambda d: F.substring(d, len(DOI_PREFIX) + 1, 1 << 20)
    return bound(doi(x), lambda d: F.when(d.startswith(DOI_PREFIX) & chronology(number(d)).isNotNull(), F.concat(F.lit("arxiv:"), without_version(number(d)))))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def in_domain(name: Column, domain: str) -> Column:
    return (name == domain) | name.endswith("." + domain)


def arxiv_of_path(path: Column) -> Column:
    """The arXiv id of a URL path such as /abs/ID or /pdf/ID.pdf, or null."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "^(?:abs|pdf)/", ""), r"\.pdf$", "")
    bare = F.trim(F.regexp_replace(bare, "(?i)^arxiv:", ""))
    return F.when(bare != "", without_version(bare))


def local_only(x: Column) -> Column:
    return F.coalesce(x.startswith("content:") | x.rlike(r"^arxiv_[0-9]+$"), F.lit(False))


def canonical(x: Column) -> Column:
    """A canonical id of what a user may write: arXiv and DOI names and URLs; anything else is trimmed."""

    def told(x: Column) -> Column:
        path = arxiv_of_path(F.regexp_extract(x, r"^[a-zA-Z]+://[^/]+(/[^?#]*)", 1))
        return F.coalesce(F.when(in_domain(host(x), "arxiv.org"), F.concat(F.lit("arxiv:"), path)), doi(x), recognized(x), F.trim(x))

    return bound(x, told)


def namespaces(identifier: Column) -> Column:
    """struct<arxiv, doi> that a canonical id tells."""

    def told(x: Column) -> Column:
        arxiv = F.when(F.lower(x).startswith("arxiv:"), F.lower(without_version(F.substring(x, 7, 1 << 20))))
        return F.struct(F.coalesce(arxiv, F.substring(arxiv_of_doi(x), 7, 1 << 20)).alias("arxiv"), doi(x).alias("doi"))

    return bound(identifier, told)


def same_identity(a: Column, b: Column) -> Column:
    """Whether two structs of namespaces share one and agree wherever both have a value."""
    agree = [(a[n], b[n]) for n in ("arxiv", "doi")]
    shared = (agree[0][0] == agree[0][1]) | (agree[1][0] == agree[1][1])
    return F.coalesce(shared, F.lit(False)) & ~conflict(a, b)


def conflict(a: Column, b: Column) -> Column:
    return F.coalesce(a["arxiv"] != b["arxiv"], F.lit(False)) | F.coalesce(a["doi"] != b["doi"], F.lit(False))
