"""Records of one work brought together in a stated order, where contradictory identifiers forbid it, and publications folded into their preprints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import fields, ids, text
from kinweave.operators import graph
from kinweave.operators.common import cut
from kinweave.session import ship

#: Words that an abstract needs if it is to speak for an abbreviated author.
TELLING_WORDS = 20


class Walk:
    """The members that a component's records have made so far. A member is called by the number of the record that founded it."""

    def __init__(self, focal: tuple[str, str | None, str | None, bool, bool]) -> None:
        self.focal_id, *self.focal = focal
        self.known: dict[int, list] = {}
        self.name: dict[int, str] = {}
        self.by_id: dict[str, int] = {}
        self.by_key: dict[tuple[int, str], dict[int, None]] = {}
        self.alias: dict[str, str] = {}
        self.aliased: dict[str, list[str]] = {}
        self.into: dict[int, int] = {}

    @staticmethod
    def clash(a: list, b: list) -> bool:
        return a[3] or b[3] or any(x is not None and y is not None and x != y for x, y in zip(a[:2], b[:2], strict=True))

    @classmethod
    def same(cls, a: list, b: list) -> bool:
        return not cls.clash(a, b) and not (a[2] and b[2]) and any(x is not None and x == y for x, y in zip(a[:2], b[:2], strict=True))

    def index(self, member: int) -> None:
        for key in enumerate(self.known[member][:2]):
            if key[1] is not None and not self.known[member][3]:
                self.by_key.setdefault(key, {})[member] = None

    def enrich(self, member: int, by: list) -> None:
        own = self.known[member]
        for k in (0, 1):
            if own[k] is None and not by[3]:
                own[k] = by[k]
        self.index(member)

    def found(self, number: int, identifier: str, record: list) -> int:
        self.known[number], self.name[number], self.by_id[identifier] = [*record], identifier, number
        self.index(number)
        return number

    def remember(self, identifier: str, target: str) -> None:
        self.alias[identifier] = target
        self.aliased.setdefault(target, []).append(identifier)

    def take_over(self, number: int, identifier: str, record: list, other: int) -> int:
        """A record of the local corpus takes the place of the member that it matches; that one's name and aliases lead to it from now on."""
        gone = self.name[other]
        self.found(number, identifier, record)
        del self.by_id[gone]
        old = self.known[other]
        for key in enumerate(old[:2]):
            self.by_key.get(key, {}).pop(other, None)
        self.enrich(number, old)
        self.into[other] = number
        for a in [a for a in self.aliased.pop(gone, []) if self.alias[a] == gone]:
            self.remember(a, identifier)
        self.remember(gone, identifier)
        return number

    def add(self, number: int, identifier: str, record: list) -> int | None:
        """The member that a record joins or founds; None for the focal record: focal, exact name, alias that doesn't contradict, the only match by identifiers."""
        if identifier == self.focal_id or self.same(record, self.focal):
            for k in (0, 1):
                if self.focal[k] is None and not record[3]:
                    self.focal[k] = record[k]
            return None
        if identifier in self.by_id:
            member = self.by_id[identifier]
            self.enrich(member, record)
            return member
        target = None
        if not record[2]:
            by_alias = self.by_id.get(self.alias.get(identifier, ""))
            if by_alias is not None and not self.clash(self.known[by_alias], record):
                target = by_alias
        if target is None:
            offered = {m: None for key in enumerate(record[:2]) if key[1] is not None for m in self.by_key.get(key, ())}
            matches = [m for m in offered if self.same(record, self.known[m])]
            target = matches[0] if len(matches) == 1 else None
        if target is None:
            return self.found(number, identifier, record)
        if record[2]:
            return self.take_over(number, identifier, record, target)
        self.enrich(target, record)
        self.remember(identifier, self.name[target])
        return target

    def survivors(self) -> list[tuple[int, int, str]]:
        """(member, the member it ended in, its name)."""
        out = []
        for m in self.known:
            end = m
            while end in self.into:
                end = self.into[end]
            out.append((m, end, self.name[end]))
        return out


def explicit(identifier: Column, arxiv: Column, doi: Column) -> Column:
    """struct<arxiv, doi, clash> of a record's name and fields: lower-case identifiers by namespace, arXiv-issued DOIs among arXiv's; ``clash`` if they contradict each other, and both null then."""
    named = ids.namespaces(identifier)
    field = lambda x: F.substring(F.lower(x), 7, 1 << 20)
    stated = F.array(named["arxiv"], field(ids.recognized(arxiv, bare=True)), field(ids.arxiv_of_doi(doi)))
    dois = F.filter(F.array(named["doi"], ids.doi(doi)), lambda d: ids.arxiv_of_doi(d).isNull())
    values = lambda a: F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))

    def told(s: Column) -> Column:
        clash = (F.size(s["a"]) > 1) | (F.size(s["d"]) > 1)
        one = lambda a: F.when(~clash, F.get(a, F.lit(0)))
        return F.struct(one(s["a"]).alias("arxiv"), one(s["d"]).alias("doi"), clash.alias("clash"))

    return ids.bound(F.struct(values(stated).alias("a"), values(dois).alias("d")), told)


def resolved(records: DataFrame, focal: tuple[str, str | None, str | None, bool]) -> DataFrame:
    """(pos, id, member, member_pos): what each of ``records`` (pos, id, arxiv, doi, local) ends in, as if they came one after another by ``pos``.

    ``focal`` is (id, arxiv, doi, local), identifiers lower-case and without prefix. A record joins the focal one if it has its name or matches it; else the member of its name; else, unless it is of the
    local corpus, the member that its name is an alias of and doesn't contradict; else the only member that it matches. Otherwise it founds one. Records match if they share an arXiv number or DOI,
    contradict in neither, and aren't both of the local corpus. A member learns the identifiers that it lacks. A local record that matches takes the member over, name and all. ``member_pos`` is where the surviving
    record stood, null for the focal one.

    Records that share no name or identifier, at any remove, don't touch, so components of names and identifiers are walked by themselves, each in order and by one task, whose state is the members and aliases.
    In a component with one arXiv number and one DOI at most, and names either local or not, copies follow their first, so only that is walked; copies are counted before. Records without a name
    go. Records at one place come by name and identifiers.
    """
    spark = records.sparkSession
    ship(spark)
    told = records.select("pos", F.trim("id").alias("id"), F.coalesce("local", F.lit(False)).alias("local"), explicit(F.col("id"), F.col("arxiv"), F.col("doi")).alias("e")).where("id <> ''").select("pos", "id", "local", "e.*")
    signed = told.withColumn("sign", F.to_json(F.struct("id", "arxiv", "doi", "clash", "local")))
    kinds = cut(signed.groupBy("sign", "id", "arxiv", "doi", "clash", "local").agg(F.min("pos").alias("first")))
    name = lambda mark, c: F.concat(F.lit(mark), c)
    own = kinds.select("id", "arxiv", "doi").unionByName(spark.createDataFrame([focal[:3]], "id string, arxiv string, doi string"))
    pairs = own.where("arxiv IS NOT NULL").select(name("i", "id").alias("a"), name("a", "arxiv").alias("b")).unionByName(own.where("doi IS NOT NULL").select(name("i", "id").alias("a"), name("d", "doi").alias("b")))
    edges = graph.canonical(pairs.withColumn("weight", F.lit(1.0)))
    nodes = own.select(name("i", "id").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    component = graph.components(nodes, edges).select(F.substring("id", 2, 1 << 20).alias("id"), "component", F.substring("id", 1, 1).alias("mark")).where("mark = 'i'").drop("mark")
    placed = cut(kinds.join(component, "id"))
    # The focal record contests a component as any other record does.
    seen = placed.select("component", "id", "arxiv", "doi", "clash", "local").unionByName(
        spark.createDataFrame([(focal[0], focal[1], focal[2], False, focal[3])], "id string, arxiv string, doi string, clash boolean, local boolean").join(component, "id").select("component", "id", "arxiv", "doi", "clash", "local")
    )
    by_name = seen.groupBy("component", "id").agg((F.count_distinct("local") > 1).alias("both"))
    contested = seen.groupBy("component").agg(((F.count_distinct("arxiv") > 1) | (F.count_distinct("doi") > 1) | F.bool_or("clash")).alias("contested"))
    contested = contested.join(by_name.groupBy("component").agg(F.bool_or("both").alias("both")), "component").select("component", (F.col("contested") | F.col("both")).alias("contested"))
    held = cut(placed.join(contested, "component"))
    rows = signed.select("pos", "sign").join(held.select("sign", "component", "contested"), "sign").withColumn("at", F.when(F.col("contested"), F.col("pos")))
    walked = rows.where("contested").select("component", "pos", "sign").distinct().join(placed.select("sign", "id", "arxiv", "doi", "local", "clash"), "sign")
    # Equal records at one place are one event.
    clean = held.where("NOT contested").select("sign", "component", F.col("first").alias("pos"), "id", "arxiv", "doi", "local", "clash")
    both = walked.select(*clean.columns).unionByName(clean)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk, current, number = None, None, 0

        def ended():
            return pd.DataFrame([(current, None, None, m, end, n) for m, end, n in walk.survivors()], columns=columns)

        for batch in batches:
            decided = []
            for component, pos, sign, identifier, arxiv, doi, local, clash in zip(*(batch[c] for c in ("component", "pos", "sign", "id", "arxiv", "doi", "local", "clash")), strict=True):
                if component != current:
                    if decided:
                        yield pd.DataFrame(decided, columns=columns)
                        decided = []
                    if walk is not None:
                        yield ended()
                    walk, current, number = Walk((focal[0], focal[1], focal[2], focal[3], False)), component, 0
                number += 1
                decided.append((component, pos, sign, walk.add(number, identifier, [arxiv, doi, local, clash]), None, None))
            if decided:
                yield pd.DataFrame(decided, columns=columns)
        if walk is not None:
            yield ended()

    columns = ["component", "pos", "sign", "member", "ended", "name"]
    kind = records.schema["pos"].dataType.simpleString()
    order = ["component", "pos", "id", "arxiv", "doi", "local"]
    walks = cut(both.repartition("component").sortWithinPartitions(*order).mapInPandas(run, f"component string, pos {kind}, sign string, member long, ended long, name string"))
    decided = walks.where("name IS NULL")
    founders = decided.where("member IS NOT NULL").groupBy("component", F.col("member").alias("ended")).agg(F.min("pos").alias("member_pos"))
    ends = walks.where("name IS NOT NULL").select("component", "member", "ended", F.col("name").alias("end_name")).join(founders, ["component", "ended"])
    final = decided.join(ends, ["component", "member"], "left").join(held.select("sign", "contested"), "sign")
    final = final.select("sign", F.when(F.col("contested"), F.col("pos")).alias("at"), F.coalesce("end_name", F.lit(focal[0])).alias("member"), "member_pos").distinct()
    left, right = rows.alias("left"), final.alias("right")
    joined = left.join(right, (F.col("left.sign") == F.col("right.sign")) & F.col("left.at").eqNullSafe(F.col("right.at"))).select("left.pos", "left.sign", "member", "member_pos")
    return joined.join(placed.select("sign", "id"), "sign").select("pos", "id", "member", "member_pos")


def admitted(members: DataFrame, focal: str, most: int) -> DataFrame:
    """The rows of ``members`` (pos, id, member, member_pos) of a selection of ``most`` records with the focal one: it is full when a record would found one more, and what comes from then on is left out.

    Records that join the focal one or a member take no slot.
    """
    firsts = members.where(F.col("member") != focal).groupBy("member").agg(F.min("pos").alias("first"))
    cut_off = firsts.orderBy("first", "member").limit(most).agg(F.count("*").alias("n"), F.max("first").alias("cut_off"))
    return members.crossJoin(F.broadcast(cut_off)).where((F.col("n") < most) | (F.col("pos") < F.col("cut_off"))).drop("n", "cut_off")


def shortened(words: Column) -> Column:
    """Each way to shorten a name: the initials of its first words, and a tail of it that doesn't overlap them. A name of n words has n * (n - 1) / 2."""
    n = F.size(words)
    first = F.transform(words, lambda w: F.substring(w, 1, 1))
    tails = lambda k: F.transform(F.when(k < n, F.sequence(F.lit(1), n - k)), lambda m: name_key(F.slice(first, 1, k), F.slice(words, n - m + 1, m)))
    return F.when(n >= 2, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), tails)))


def name_key(initials: Column, surname: Column) -> Column:
    return F.concat(F.array_join(initials, " "), F.lit("|"), F.array_join(surname, " "))


def short_form(words: Column) -> Column:
    """The key of a name that starts with initials, else null: they are the leading words of one letter, but one word, or two before an ending, are the surname."""
    n = F.size(words)
    longest = F.greatest(n - F.when(F.element_at(F.when(n > 0, words), -1).isin(*fields.NAME_SUFFIXES), 2).otherwise(1), F.lit(0))
    stop = F.array_position(F.transform(F.slice(words, 1, longest), lambda w: F.length(w) != 1), True)
    k = F.when(stop > 0, stop - 1).otherwise(longest).cast("int")
    return ids.bound(k, lambda k: F.when((n > 0) & (k > 0), name_key(F.slice(words, 1, k), F.slice(words, k + 1, n - k))))


def publication_versions(members: DataFrame) -> DataFrame:
    """(preprint_id, publication_id) of members that are a preprint and its publication, each the other's only such partner.

    members: id, local, arxiv, doi (without prefix, lower-case), year, title, author (the first), abstract. Of two, the preprint is the one of the local corpus, if one is; else the only one with an arXiv number. It needs
    one, the publication a DOI; they must not contradict. Titles of two words or more agree word by word, and the publication is of the same or the next year. The preprint's author has two names or more, not an initial first;
    the publication has the same, or leading initials and the surname, if both have the same abstract of twenty words or more.

    Every condition is an equality of tokens: a preprint offers one for its year and the next, for its name and each way to shorten it, with or without what the other may lack, and a publication asks by its own, so that partners
    share exactly one. Tokens are counted before anything is joined, so a title that many members share makes no pairs. Both sides of each join grow with the members, but Spark guesses from the size of the files what
    their tokens take, so the joins are told to be by sorting: the driver would gather a side that it broadcasts.
    """
    ship(members.sparkSession)
    keyed = members.select("id", "local", "arxiv", "doi", "year", text.folded_words(F.coalesce("title", F.lit(""))).alias("title"), F.split(text.folded_words(F.coalesce("author", F.lit(""))), " ").alias("author"), text.folded_words(F.coalesce("abstract", F.lit(""))).alias("abstract"))
    keyed = cut(keyed.where("year IS NOT NULL AND title LIKE '% %' AND (arxiv IS NOT NULL OR doi IS NOT NULL)").withColumn("telling", F.size(F.split("abstract", " ")) >= TELLING_WORDS))
    whole = F.concat(F.lit("="), F.array_join("author", " "))
    digest = F.concat(F.lit("|"), F.sha2("abstract", 256))
    none, any_ = F.lit(""), F.lit("*")
    offers = keyed.where((F.col("arxiv").isNotNull()) & (F.size("author") >= 2) & (F.length(F.get("author", F.lit(0))) >= 2)).select(
        "id", F.lit(True).alias("preprint"), "title", F.explode(F.array("year", F.col("year") + 1)).alias("year"),
        F.concat(F.array(whole), F.when(F.col("telling"), F.transform(shortened(F.col("author")), lambda k: F.concat(k, digest))).otherwise(F.array().cast("array<string>"))).alias("names"),
        F.when(F.col("local"), F.array(none, F.col("arxiv"))).otherwise(F.array(none)).alias("arxivs"), F.array(F.coalesce("doi", any_)).alias("dois"),
    )
    asks = keyed.where("doi IS NOT NULL AND NOT local").select(
        "id", F.lit(False).alias("preprint"), "title", "year", F.filter(F.array(whole, F.when(F.col("telling"), F.concat(short_form(F.col("author")), digest))), lambda k: k.isNotNull()).alias("names"),
        F.array(F.coalesce("arxiv", none)).alias("arxivs"), F.array(any_, F.col("doi")).alias("dois"),
    )
    key = ["title", "year", "name", "arxiv", "doi"]
    tokens = offers.unionByName(asks).withColumn("name", F.explode("names")).withColumn("arxiv", F.explode("arxivs")).withColumn("doi", F.explode("dois")).select("id", "preprint", *key)
    p = F.col("preprint")
    counts = tokens.groupBy(*key).agg(F.count_if(p).alias("offered"), F.count_if(~p).alias("asked"), F.min(F.when(p, F.col("id"))).alias("preprint_id"), F.min(F.when(~p, F.col("id"))).alias("publication_id")).where("offered > 0 AND asked > 0")
    counts = cut(counts)
    alone = counts.where("offered = 1 AND asked = 1").select("preprint_id", "publication_id")
    taken = alone.select(F.col("preprint_id").alias("id")).unionByName(alone.select(F.col("publication_id").alias("id"))).distinct()
    partners = tokens.join(taken.hint("merge"), "id", "left_semi").join(counts.select(*key, "offered", "asked").hint("merge"), key).groupBy("id").agg(F.sum(F.when(p, F.col("asked")).otherwise(F.col("offered"))).alias("partners"))
    single = cut(partners.where("partners = 1").select("id"))
    return alone.join(single.withColumnRenamed("id", "preprint_id").hint("merge"), "preprint_id", "left_semi").join(single.withColumnRenamed("id", "publication_id").hint("merge"), "publication_id", "left_semi").select("preprint_id", "publication_id")
