"""Fields of raw rows: what the columns of differing sources say, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions import ids as I
from kinweave.functions import text as T

#: Where a source may put the venue, in order of trust.
VENUE_KEYS = ("venue", "journal_ref", "journal-ref", "journal")
#: Endings of a name that aren't its surname.
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
#: Text of the roles that prompts tell apart.
QUERY_PROMPT, DOCUMENT_PROMPT, NO_TITLE, NO_ID = "task: search result | query: ", ("title: ", " | text: "), "none", "unknown-paper"
#: What a relation and a provenance are called.
RELATIONS = {
    "focal": "Focal paper", "referenced_by_focal": "Referenced by focal paper", "cites_focal": "Cites focal paper", "semantic_only": "No direct citation recorded",
    "overlap": "Cites and is cited by focal paper",
}
SOURCES = {"both": "Citation and semantic", "citation": "Citation", "semantic": "Semantic"}


def first_filled(*values: Column) -> Column:
    """The first value with more than blanks, as it is; empty if there is none."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values], F.lit(""))


def whole(x: Column) -> Column:
    """An integer that a text spells, blanks around it aside; null for anything else."""
    return F.when(F.trim(x).rlike(r"^[+-]?[0-9]{1,9}$"), F.trim(x).try_cast("int"))


def year(field: Column, identifier: Column) -> Column:
    """The year that the field spells, or that an arXiv id tells."""
    return F.coalesce(whole(field), F.floor(I.chronology(identifier) / 10_000_000).cast("int"))


def publication_year(x: Column) -> Column:
    return F.coalesce(whole(x), F.lit(0))


def names(x: Column) -> Column:
    """Names of a list that aren't blank; repeats stay, as two people may share one."""
    return F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: n != "")


def authors(field: Column, triples: Column) -> Column:
    """Names of (last, first, suffix) rows, or, where those say nothing, of a text with commas."""
    part = lambda t, i: F.nullif(F.trim(F.get(t, F.lit(i))), F.lit(""))
    spelled = names(F.transform(triples, lambda t: F.concat_ws(" ", part(t, 1), part(t, 0), part(t, 2))))
    return I.bound(spelled, lambda s: F.when(F.size(s) > 0, s).otherwise(names(F.split(field, ","))))


def categories(x: Column, packed: bool = True) -> Column:
    """Labels without repeats, in order; ``packed`` ones stand in one text with blanks and commas, others are a list."""
    return F.array_distinct(names(F.split(F.replace(x, F.lit(","), F.lit(" ")), r"\s+") if packed else x))


def doi(x: Column) -> Column:
    """The first DOI of a field that may hold several, with noise behind; empty if there is none."""
    text = F.regexp_replace(F.trim(x), r"(?i)^(doi:)\s+", "$1")
    first = F.get(F.split(text, r"(?i)\s+|[,;](?=\s*(?:10\.[0-9]{4,9}/|doi:|https?://|(?:[\w-]+\.)*doi\.org))"), F.lit(0))
    return F.coalesce(I.doi(F.regexp_replace(first, r"[,;/]+$", "")), F.lit(""))


def canonical_id(x: Column) -> Column:
    """The identifier that a raw row states, in canonical form; null if it states none."""
    return I.bound(F.nullif(F.trim(x.cast("string")), F.lit("")), lambda t: F.coalesce(I.recognized(t, bare=True), I.canonical(t)))


def content_id(title: Column, abstract: Column, people: Column, in_year: Column, doi: Column) -> Column:
    """A name of a row without identifier, by what it says; null if it has neither title nor abstract."""
    clean = F.struct(*[T.one_line(F.coalesce(x, F.lit(""))).alias(n) for n, x in (("t", T.without_placeholder(title)), ("a", abstract))])
    said = lambda c: F.concat_ws("\u001f", c["t"], c["a"], F.array_join(people, "\u001e"), F.coalesce(in_year.cast("string"), F.lit("")), doi)
    return I.bound(clean, lambda c: F.when((c["t"] != "") | (c["a"] != ""), F.concat(F.lit("content:"), F.sha2(F.encode(said(c), "UTF-8"), 256))))


def timestamp(x: Column) -> Column:
    """ISO and e-mail dates as UTC with microseconds, times without a zone being UTC; empty if it is neither."""
    text = F.trim(x)
    zoned = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    iso = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(zoned))
    mail = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3}, *", ""), r" (?:GMT|UTC|UT)$", " +0000")
    sent = F.when(mail.rlike(r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")))
    in_utc = F.to_utc_timestamp(F.coalesce(iso, sent), F.current_timezone())
    return F.coalesce(F.date_format(in_utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"), F.lit(""))


def version_of(x: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(x), r"v([0-9]+)$", 1), F.lit("")).cast("int")


def priority(updated: Column, versions: Column, identifier: Column) -> Column:
    """struct<updated, number, created> that tells the newest of rows with one id: versions is array<struct<version, created>>."""
    known = F.filter(versions, lambda v: v["version"].rlike("^v[0-9]+$"))
    listed = F.transform(known, lambda v: F.struct(version_of(v["version"]).alias("number"), timestamp(v["created"]).alias("created")))
    own = F.array(F.struct(version_of(identifier).alias("number"), F.lit("").alias("created")))
    most = F.array_max(F.filter(F.concat(F.coalesce(listed, F.array().cast("array<struct<number:int,created:string>>")), own), lambda v: v["number"].isNotNull()))
    return F.struct(timestamp(updated).alias("updated"), F.coalesce(most["number"], F.lit(0)).alias("number"), F.coalesce(most["created"], F.lit("")).alias("created"))


def text_list(json: Column) -> Column:
    """A list that a column keeps as JSON, or an empty one if it isn't one."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def as_json_list(x: Column) -> Column:
    return F.to_json(names(x))


def number(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(x).try_cast("double"), F.lit(default))


def edge_weight(x: Column) -> Column:
    """A weight that is positive and finite, else 1e-6."""
    return F.when((x > 0) & (x < F.lit(float("inf"))), x).otherwise(1e-6)


def layout_distance(similarity: Column) -> Column:
    return 1.0 / (1e-6 + similarity)


def length_bucket(x: Column) -> Column:
    """An estimate of a text's tokens, to batch texts of like length: its words, or a quarter of its characters if that is more."""
    text = F.trim(x)
    return F.when(text == "", 0).otherwise(F.greatest(F.size(F.split(text, r"\s+")), F.floor(F.length(text) / 4).cast("int"), F.lit(1)))


def role_text(role: str, title: Column, abstract: Column, identifier: Column) -> Column:
    """What is encoded of a record in a role: ``query``, ``document`` or ``similarity``. A record without text is known by its id."""
    title, abstract = (T.one_line(F.coalesce(x, F.lit(""))) for x in (T.without_placeholder(title), abstract))
    name = F.coalesce(T.blank_to_null(identifier), F.lit(NO_ID))
    content = F.coalesce(T.composed(title, abstract), name)
    if role == "query":
        return F.concat(F.lit(QUERY_PROMPT), content)
    if role == "document":
        return F.concat(F.lit(DOCUMENT_PROMPT[0]), F.when(title != "", title).when(abstract != "", NO_TITLE).otherwise(name), F.lit(DOCUMENT_PROMPT[1]), abstract)
    if role == "similarity":
        return content
    raise ValueError(f"no such role: {role}")


def quoted(x: Column, keep: str = "") -> Column:
    """Percent-encoded for a URL, but for letters, digits, ``-._~`` and what is to be kept."""
    out = F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return reduce(lambda c, k: F.replace(c, F.lit(f"%{ord(k):02X}"), F.lit(k)), keep, out)


# Where the pages of identifiers are, what stays as it is in a DOI's, and the form of a provider's own ids.
ARXIV_PAGE, ARXIV_FILE, DOI_PAGE, PROVIDER_PAGE = "https://arxiv.org/abs/", "https://arxiv.org/pdf/", "https://doi.org/", "https://www.semanticscholar.org/paper/"
DOI_KEPT, PROVIDER_ID = "/()[]:._;-", r"(?i)^(?:s2:)?[0-9a-f]{40}$"


def doi_of_node(identifier: Column, stated: Column) -> Column:
    """A record's DOI as it is written: the stated one, else that of its name, which has the prefix ``doi:`` or is a DOI."""
    named = F.coalesce(F.trim(F.nullif(F.regexp_extract(identifier, "(?is)^doi:(.*)$", 1), F.lit(""))), F.when(I.doi(identifier).isNotNull() & identifier.startswith("10."), identifier))
    return F.coalesce(F.nullif(F.trim(stated), F.lit("")), named, F.lit(""))


def links(identifier: Column, arxiv: Column, doi: Column, local: Column | None = None) -> Column:
    """struct<arxiv_abs, arxiv_pdf, doi, provider>: the pages that a record's identifiers lead to; null where there is none.

    The provider knows all names but those of the local corpus and of queries; of a record of the local corpus only arXiv numbers, DOIs and its own ids.
    """
    named = F.coalesce(F.nullif(F.trim(arxiv), F.lit("")), F.nullif(F.trim(F.regexp_extract(identifier, "(?i)^arxiv:(.+)$", 1)), F.lit("")))
    number, own = quoted(I.without_version(named)), F.nullif(doi_of_node(identifier, doi), F.lit(""))
    canonical = I.canonical(identifier)
    outside = I.recognized(canonical, bare=True).isNotNull() | I.doi(canonical).isNotNull() | canonical.rlike(PROVIDER_ID)
    inner = I.local_only(identifier) | identifier.startswith("query:") | (F.coalesce(local if local is not None else F.lit(False), F.lit(False)) & ~F.coalesce(outside, F.lit(False)))
    return F.struct(
        F.concat(F.lit(ARXIV_PAGE), number).alias("arxiv_abs"), F.concat(F.lit(ARXIV_FILE), number, F.lit(".pdf")).alias("arxiv_pdf"),
        F.concat(F.lit(DOI_PAGE), quoted(own, DOI_KEPT)).alias("doi"), F.when(~inner, F.concat(F.lit(PROVIDER_PAGE), quoted(identifier))).alias("provider"),
    )


def _named(x: Column, table: dict[str, str]) -> Column:
    return reduce(lambda c, kv: F.when(x == kv[0], kv[1]).otherwise(c), table.items(), F.lit(""))


def relation_badge(is_focal: Column, relation: Column) -> Column:
    return F.when(is_focal, RELATIONS["focal"]).otherwise(_named(F.trim(relation), RELATIONS))


def source_label(provenance: Column, base: Column) -> Column:
    """What a record's provenance is called; the focal record has that of its base."""
    return _named(F.when(provenance == "focal", base).otherwise(provenance), SOURCES)


def default_provenance(strategy: Column) -> Column:
    return F.when(strategy.isin("embedding", "recommendation"), "semantic").otherwise("citation")


def web_link(x: Column) -> Column:
    """A link if it is one of HTTP or HTTPS, else empty."""
    return F.when(F.trim(x).rlike(r"(?i)^https?://[^\s/]"), F.trim(x)).otherwise("")


def reference_id(json: Column) -> Column:
    """The id in a reference's JSON: a plain text, a record's own, or that of the paper in it."""
    plain = F.when(F.trim(json).startswith('"'), F.get(F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>"), F.lit(0)))
    return F.coalesce(plain, *[F.get_json_object(json, p) for p in ("$.paperId", "$.paper_id", "$.paper.paperId", "$.paper.paper_id")])


def arxiv_of_journal(name: Column, volume: Column) -> Column:
    """The arXiv number in the volume ``abs/NUMBER`` of the journal arXiv, else empty."""
    suffix = F.substring(F.trim(volume), 5, 1 << 20)
    stated = (F.lower(F.trim(name)) == "arxiv") & F.trim(volume).startswith("abs/") & ~F.contains(suffix, F.lit(":"))
    return F.coalesce(F.when(stated, F.substring(I.recognized(suffix, bare=True), 7, 1 << 20)), F.lit(""))


def abbreviates(full: Column, short: Column) -> Column:
    """Whether a name's words are leading initials and the tail of another's: surname, particles and endings."""
    n = F.size(short)
    suffix = F.element_at(F.when(n > 0, short), -1).isin(*NAME_SUFFIXES)
    longest = n - F.when(suffix, 2).otherwise(1)
    stop = F.array_position(F.transform(F.slice(short, 1, F.greatest(longest, F.lit(0))), lambda w: F.length(w) != 1), True)
    initials = F.when(stop > 0, stop - 1).otherwise(F.greatest(longest, F.lit(0))).cast("int")
    first = F.transform(F.slice(full, 1, initials), lambda w: F.substring(w, 1, 1))
    rest = F.greatest(n - initials, F.lit(1))
    tail = F.slice(full, F.greatest(F.size(full) - rest + 1, F.lit(1)), rest)
    return F.coalesce((initials > 0) & (n <= F.size(full)) & (F.slice(short, 1, initials) == first) & (F.slice(short, initials + 1, rest) == tail), F.lit(False))


def lookup_id(identifier: Column, arxiv: Column, doi: Column, local: Column) -> Column:
    """An identifier that a provider may be asked for, or null: keys that only the local corpus knows stay inside."""
    name = F.nullif(F.trim(identifier), F.lit(""))
    stated = F.coalesce(I.recognized(arxiv, bare=True), I.doi(doi), I.recognized(name, bare=True), F.when(name.rlike("^[0-9a-f]{40}$"), name), I.doi(name))
    outside = F.when(~I.local_only(name), name)
    return F.when(~F.coalesce(name.startswith("query:"), F.lit(False)), F.when(local, stated).otherwise(outside))


def aliases(identifier: Column, arxiv: Column, doi: Column) -> Column:
    """All names of a record, sorted and without repeats."""
    number = I.without_version(F.nullif(F.trim(arxiv), F.lit("")))
    all_ = F.array(F.nullif(F.trim(identifier), F.lit("")), F.concat(F.lit("arxiv:"), number), I.doi(doi))
    return F.array_sort(F.array_distinct(F.filter(all_, lambda a: a.isNotNull())))


def share_authors(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))
