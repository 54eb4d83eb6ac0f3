"""PII by weak supervision: labelers vote on candidate spans, expectation-maximisation estimates how far each can be trusted, and a classifier that is trained on its estimates decides. Spark expressions only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import between, blocks_of, let, read, running, text_or_empty, whole_row

KINDS = ("email", "ip", "card", "phone", "national", "secret")
BASE = KINDS[:4]
#: Patterns without nested backtracking: possessive quantifiers, and a look behind where a later start in the same run can't match either.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?:password|passwd|token|secret|api[_-]?key)\x20{0,3}[=:]\x20{0,3}\x22?[a-z0-9+/_-]{8,}+\x22?",
}
#: What must stand in a text for a pattern to be worth a search.
GUARDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "national": r"[0-9]{3}[\x20.-][0-9]{4}", "secret": r"[=:]"}
#: The gazetteers. Beginnings of values that numbering plans or common use allow, and endings of host names.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|it|eu|info)$",
    "ip": r"^(?!0|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "national": r"^\(?[2-9][0-8]",
    "secret": r"(?i)^(?!.*[=:]\x20*\x22?(?:example|changeme|placeholder|password|secret|your|x{4}|\*{4}|1234)).",
}
#: Words that stand before such data.
CONTEXT = {
    "email": r"(?i)mail|contact|write|from|to\b",
    "ip": r"(?i)\bip\b|host|server|address|from",
    "card": r"(?i)card|visa|credit|account|pay",
    "phone": r"(?i)phone|tel|call|mobile|fax|contact",
    "national": r"(?i)phone|tel|call|mobile|fax|contact",
    "secret": r"(?i)password|token|secret|key|login|user",
}
BEFORE = 32


def spans_of(text: Column, pattern: str, guard: str) -> Column:
    """array<struct<start, end, value, before, last, next>> of the leftmost non-overlapping matches: code points, ends exclusive.

    before is the end of what stands between the match and the one before it, last the character before the match, next the one behind it.
    The pieces between the matches and the matches alternate, so their lengths add up to the places.
    """
    kind = "array<struct<start:int,end:int,value:string,before:string,last:string,next:string>>"

    def placed(x: Column) -> Column:
        p, m = x["pieces"], x["found"]
        sums = running(F.transform(m, lambda v, i: F.length(F.get(p, i)) + F.length(v)), F.lit(0), lambda s, n: s + n)

        def span(sums: Column) -> Column:
            def of(v: Column, i: Column) -> Column:
                before, behind = F.get(p, i), F.get(p, i + 1)
                last = F.when(before != "", F.substring(before, -1, 1)).otherwise(F.coalesce(F.substring(F.get(m, i - 1), -1, 1), F.lit("")))
                after = F.when(behind != "", F.substring(behind, 1, 1)).otherwise(F.coalesce(F.substring(F.get(m, i + 1), 1, 1), F.lit("")))
                return F.struct(
                    (F.get(sums, i) + F.length(before)).alias("start"), F.get(sums, i + 1).alias("end"), v.alias("value"),
                    F.substring(before, -BEFORE, BEFORE).alias("before"), last.alias("last"), after.alias("next"),
                )

            return F.transform(m, of)

        return let(sums, span)

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(guard), let(both, placed)).otherwise(F.array().cast(kind))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.reverse(digits(value))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.struct(i.alias("i"), F.try_to_number(F.substring(d, i, F.lit(1)), F.lit("9")).cast("int").alias("x")))
    doubled = lambda x: F.when(x >= 5, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(each, F.lit(0), lambda s, e: s + F.when(e["i"] % 2 == 0, doubled(e["x"])).otherwise(e["x"])) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether the checks on a match of this kind hold: those of the base kinds decide, those of added kinds are votes."""
    if kind == "ip":
        # A part of any length is at most 255 if it is so without its leading zeros.
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits(value)).between(13, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "national":  # neither an area nor an exchange begins with 0 or 1, nor is it a service number
        return digits(value).rlike("^[2-9](?!11)[0-9]{2}[2-9](?!11)")
    if kind == "email":
        return F.lit(True)
    return F.regexp_extract(value, r"[=:]\x20*(.*)$", 1).rlike(r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]")


VOTES = ("regex", "gazetteer", "context", "shape")
#: What the classifier sees of a span besides the votes, and the values that each can have.
FEATURES = {"length": 4, "digits": 4, "upper": 2, "signs": 2, "dull": 2, "assigned": 2}


def features(s: Column) -> list[Column]:
    value, n = s["value"], F.length(s["value"])
    share = F.length(digits(value)) / n
    bucket = lambda x, ends: sum([(x >= e).cast("int") for e in ends[1:]], (x >= ends[0]).cast("int"))
    return [
        bucket(n, (10, 16, 24)), bucket(share, (0.01, 0.4, 0.75)), value.rlike("[A-Z]").cast("int"), value.rlike("[^A-Za-z0-9.]").cast("int"),
        value.rlike(r"([A-Za-z0-9])\1{4}").cast("int"), s["before"].rlike(r"[=:]\s*$").cast("int"),
    ]


def candidates(docs: DataFrame, text: str, key: str, row: bool = False) -> DataFrame:
    """(key, t, c): the candidate spans of each row with the votes of the labelers, 1 for, -1 against, 0 for none, and the classifier's features.

    regex: the checks on the value, which speak against if they fail. gazetteer: known beginnings or endings, or
    common placeholders. context: a cue before the span. shape: letters or digits that touch the span speak against it.
    """
    body = text_or_empty(text)
    rows = docs.select(docs[key].cast("long").alias("key"), body.alias("t"), *[whole_row(docs)][:row])

    def voted(kind: str):
        def votes(s: Column) -> Column:
            touching = s["last"].rlike(r"[\p{L}0-9]") | s["next"].rlike(r"[\p{L}0-9]")
            passed = valid(kind, s["value"])
            return F.struct(
                F.lit(KINDS.index(kind)).alias("k"), s["start"].alias("start"), s["end"].alias("end"), (passed if kind in BASE else F.lit(False)).alias("base"),
                F.when(passed, 1).otherwise(-1).alias("regex"), F.when(s["value"].rlike(GAZETTEER[kind]), 1).otherwise(-1).alias("gazetteer"),
                F.when(s["before"].rlike(CONTEXT[kind]), 1).otherwise(0).alias("context"), F.when(touching, -1).otherwise(0).alias("shape"),
                *[f.alias(name) for name, f in zip(FEATURES, features(s), strict=True)],
            )

        return votes

    found = [F.transform(spans_of(F.col("t"), PATTERNS[kind], GUARDS[kind]), voted(kind)) for kind in KINDS]
    return rows.select("key", "t", F.concat(*found).alias("c"), *["row"][:row])


def label_model(counts: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """The chance that a candidate of each vote pattern (kind and votes) is true, by expectation-maximisation over the patterns' counts.

    A pattern's first guess is the share of its votes that speak for it. In each round the labelers' rates follow from the
    guesses, and the guesses from the rates, as the votes are independent given the truth; it ends when no guess moves by 1e-7.
    Three made-up votes for each labeler, which agree with the truth, tell which of the two classes is the true one.
    """
    guess = {p: (1 + sum(x > 0 for x in p[1:])) / (2 + sum(x != 0 for x in p[1:])) for p, _ in counts}
    while True:
        new = {}
        for k in {p[0] for p, _ in counts}:
            own = [(p[1:], n, guess[p]) for p, n in counts if p[0] == k]
            true, all_ = sum(n * g for _, n, g in own), sum(n for _, n, _ in own)
            prior = math.log((true + 1) / (all_ - true + 1))
            ratio = {}
            for i in range(len(VOTES)):
                for vote in (-1, 0, 1):
                    yes = sum(n * g for v, n, g in own if v[i] == vote) + (3 if vote > 0 else 1)
                    no = sum(n * (1 - g) for v, n, g in own if v[i] == vote) + (3 if vote < 0 else 1)
                    ratio[i, vote] = math.log(yes / (true + 5)) - math.log(no / (all_ - true + 5))
            for v, _, _ in own:
                logit = prior + sum(ratio[i, x] for i, x in enumerate(v))
                new[k, *v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, logit))))
        moved = max((abs(new[p] - guess[p]) for p in new), default=0.0)
        guess = new
        if moved < 1e-7:
            return guess


NAMES = (*VOTES, *FEATURES)


def classifier(counts: list[tuple[tuple[int, ...], int]], guess: dict[tuple[int, ...], float], ridge: float = 1.0) -> dict[tuple[int, str, int], float]:
    """Weights (kind, name, value) of one logistic regression for each kind, with the label model's chances as soft labels.

    Its inputs are the votes and the features, each value of each of them a column of its own; "" is the constant. Newton's
    steps run over the counts of equal candidates, which are bounded whatever the texts.
    """
    weights: dict[tuple[int, str, int], float] = {}
    for k in sorted({p[0] for p, _ in counts}):
        own = [(p, n) for p, n in counts if p[0] == k]
        columns = [("", 0), *sorted({(name, v) for p, _ in own for name, v in zip(NAMES, p[1:], strict=True)})]
        at = {c: i for i, c in enumerate(columns)}
        x = np.zeros((len(own), len(columns)))
        x[:, 0] = 1
        for r, (p, _) in enumerate(own):
            x[r, [at[c] for c in zip(NAMES, p[1:], strict=True)]] = 1
        n, y = np.array([n for _, n in own], float), np.array([guess[p[: len(VOTES) + 1]] for p, _ in own])
        cost = lambda w: (n * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + ridge / 2 * (w @ w)  # noqa: B023, E731
        w = np.zeros(len(columns))
        while True:
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            change = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
            size = 1.0
            while size > 1e-6 and cost(w - size * change) > cost(w):
                size /= 2
            w = w - size * change
            if size <= 1e-6 or np.abs(size * change).max() < 1e-7:
                break
        weights |= {(k, *c): float(v) for c, v in zip(columns, w, strict=True)}
    return weights


def find(docs: DataFrame, cut: float = 0.5, text: str = "text", key: str = "doc_id", row: bool = False) -> DataFrame:
    """One row per row of ``docs``: key and spans, array<struct<kind, start, end, base, score>> in order of kind and start, and redacted, the
    text with ``[KIND]`` in place of each span; and, if asked, row, a struct of all its columns.

    Base spans pass their kind's pattern and checks, and always stay. Of the other candidates, which are matches of the
    kinds that the method adds, those stay to which the classifier gives ``cut`` or more and that no base span overlaps. The
    label model's reliabilities come from all candidates of all rows, and the classifier learns from its chances; matches
    that fail the checks of a base kind aren't spans, but count there. Where spans overlap, the redacted text has one mark for them, of the first.

    The texts are read twice, to count candidates and to decide. What reaches the driver is the number of candidates of each kind,
    vote pattern and feature pattern, of which there are at most 6 x 16 x 256. Null and empty texts have no spans; repeated rows
    and null keys are rows of their own; other columns aren't read. Work grows with the length of a text and the 1.5th power of its spans.
    """
    patterns = candidates(docs, text, key).select(F.explode("c").alias("c")).groupBy("c.k", *[f"c.{v}" for v in NAMES]).count().collect()
    counts = sorted((tuple(r[:-1]), r[-1]) for r in patterns)
    votes: dict[tuple[int, ...], int] = {}
    for p, n in counts:
        votes[p[: len(VOTES) + 1]] = votes.get(p[: len(VOTES) + 1], 0) + n
    weights = classifier(counts, label_model(sorted(votes.items())))
    table = F.create_map(*[F.lit(x) for (k, name, value), w in weights.items() for x in (f"{k}{name}{value}", w)]) if weights else F.create_map(F.lit("-"), F.lit(0.0))

    def scored(c: Column) -> Column:
        weight = lambda *of: F.coalesce(F.element_at("weights", F.concat(c["k"].cast("string"), *of)), F.lit(0.0))
        logit = weight(F.lit("0"))
        for name in NAMES:
            logit = logit + weight(F.lit(name), c[name].cast("string"))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["k"].alias("k"), c["base"].alias("base"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).alias("score"))

    def free(s: Column) -> Column:
        """Without the added spans that a base span overlaps: s is in order, so those before end too late or those behind begin too early."""
        far = F.lit((1 << 31) - 1)
        before = running(F.transform(s, lambda c: F.when(c["base"], c["end"]).otherwise(0)), F.lit(0), F.greatest)
        behind = running(F.transform(F.reverse(s), lambda c: F.when(c["base"], c["start"]).otherwise(far)), far, F.least)
        return let(before, lambda b: let(behind, lambda e: F.filter(s, lambda c, i: c["base"] | ((c["start"] >= F.get(b, i)) & (c["end"] <= F.get(e, F.size(s) - 1 - i))))))

    rows = candidates(docs, text, key, row).withColumn("weights", table)
    sure = F.array_sort(F.filter(F.transform("c", scored), lambda c: c["base"] | ((c["k"] >= len(BASE)) & (c["score"] >= cut))))
    rows = rows.withColumn("s", F.when(F.size("c") > 0, let(sure, free)).otherwise(F.array().cast("array<struct<start:int,end:int,k:int,base:boolean,score:double>>")))
    names = F.array(*[F.lit(k) for k in KINDS])
    in_kinds = F.array_sort(F.transform("s", lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), c["score"].alias("score"))))
    spans = F.transform(in_kinds, lambda c: F.struct(F.get(names, c["k"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), c["score"].alias("score")))

    def built(blocks: Column) -> Column:
        def around(done: Column) -> Column:  # done: how far the spans before each reach
            gap = lambda c, i: F.when(c["start"] >= F.get(done, i), F.concat(between(blocks, F.get(done, i), c["start"]), F.lit("["), F.upper(F.get(names, c["k"])), F.lit("]"))).otherwise("")
            return F.concat(F.array_join(F.transform("s", gap), ""), between(blocks, F.element_at(done, -1), F.length("t")))

        return let(running(F.transform("s", lambda c: c["end"]), F.lit(0), F.greatest), around)

    redacted = F.when(F.size("s") == 0, F.col("t")).otherwise(let(blocks_of(F.col("t")), built))
    return rows.select(F.col("key").alias(key), spans.alias("spans"), redacted.alias("redacted"), *["row"][:row])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    named = lambda k: lambda kind: kind == k
    counts = [F.size(F.filter(F.transform("spans", lambda s: F.when(s["base"], s["kind"])), named(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.encode(shown(base), "UTF-8"), 256).alias("base_sha256"), shown("spans").alias("spans"))
