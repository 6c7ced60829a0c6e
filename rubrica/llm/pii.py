"""Personal data by weak supervision, in DataFrame functions only.

Four kinds have fixed rules (email, ip, card, phone) and always stay.  Further candidates come from
forms (tokens that mix digits into eight or more characters), from contexts (any value assigned to a
word such as ``password``; names after a word such as ``contact:``), and from gazetteers (names after a
title, houses in a street).  Eight labelers (forms, gazetteers, contexts, character make-up) vote yes,
no or nothing on each.  Expectation maximisation over the counts of vote patterns (at most 3^8 rows)
estimates how reliable every labeler is, without labels.  The resulting probabilities train a logistic
span classifier on features of the span; it decides which candidates are kept, as kinds ``secret``,
``name`` and ``address``.

Positions are code points: a match starts where the lengths of the gaps and matches before it
end.  Prefix sums go by blocks, so a text with very many matches stays affordable.

The patterns are the given ones with possessive quantifiers and a look behind, which find the
same matches without retrying inside a run of characters.

Defined cases: null or empty text has no spans; a null id is kept; repeated rows get equal
answers; an empty table gives an empty result, and no candidate at all keeps none; extra columns
are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.llm.shared import cut_lineage, text_or_empty

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9_.@%+-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{8,}+(?!@)"

#: Words that a private value is assigned to, that a name follows, and of titles and streets.
ASSIGNED = r"(?:password|passwd|passphrase|pwd|pin|secret|api[_-]?key|access[_-]?key|token|ssn|iban|passport|plate)"
VALUE = rf"(?<=(?i:\b{ASSIGNED})\s?[=:]\s?[\"']?)[^\s\"',;<>]{{3,128}}+"
CALLED = r"(?:[Nn]ame|[Cc]ontact|[Pp]atient|[Ee]mployee|[Ss]igned|[Aa]ttn)"
TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof)\.?"
NAME = rf"(?:(?<=\b{CALLED}\s?:\s?)|\b{TITLE}\s)\p{{Lu}}\p{{L}}+(?:[ -]\p{{Lu}}\p{{L}}+){{0,2}}"
GIVEN = (
    r"(?:Ada|Adam|Alan|Alice|Amir|Ana|Andrew|Anna|Carlos|Carmen|Claire|Daniel|David|Elena|Emma|Eva|Fatima|Francis|George|Grace|Hans|Ivan|"
    r"James|Jan|Jane|Jean|John|Jorge|Jose|Juan|Julia|Karl|Laura|Lena|Li|Linda|Louis|Lucia|Luis|Maria|Marie|Mark|Mary|Michael|Mohammed|"
    r"Nina|Olga|Omar|Paul|Pedro|Peter|Pierre|Robert|Rosa|Sara|Sofia|Susan|Thomas|Wei|William|Yuki)"
)
STREETS = r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|Square|Terrace|St|Ave|Rd|Ln|Blvd)"
STREET = rf"(?<![0-9])[0-9]{{1,5}}[a-z]?\s(?:\p{{Lu}}\p{{L}}+\s){{1,3}}{STREETS}\b"
#: Kinds the method adds; the number of a candidate's source says which it is.
ADDED = ("secret", "name", "address")
SOURCES = ("secret", "secret", "name", "address")

BEFORE = 24
BLOCK = 256
LABELERS = 8
_PLACED = "array<struct<s:bigint,e:bigint,t:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(items: Column, start: Column) -> Column:
    """Items with their places, from ``start`` on."""
    seed = F.struct(F.expr(f"cast(array() as {_PLACED})").alias("out"), start.cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        s = (acc["at"] + x["gap"]).cast("long")
        e = (s + x["len"]).cast("long")
        item = F.struct(
            s.alias("s"), e.alias("e"), x["t"].alias("t"), x["before"].alias("before"), x["after"].alias("after")
        )
        return F.struct(F.concat(acc["out"], F.array(item)).cast(_PLACED).alias("out"), e.alias("at"))

    return F.aggregate(items, seed, step, lambda acc: acc["out"])


def _placed(items: Column) -> Column:
    """Items with their places; by blocks, as growing one long array would cost its square."""

    def whole(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + x["len"]))
        starts = F.aggregate(
            sums,
            F.expr("cast(array(0) as array<bigint>)"),
            lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)).cast("array<bigint>"),
        )
        return let(
            starts,
            lambda at: F.flatten(
                F.zip_with(blocks, F.slice(at, F.lit(1), F.size(blocks)), lambda b, s: _running(b, s))
            ),
        )

    count = F.ceil(F.size(items) / F.lit(BLOCK)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(items) <= BLOCK, _running(items, F.lit(0))).otherwise(let(cut, whole))


def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches: start, end (code points), text, what stands before and after."""
    none = F.expr(f"cast(array() as {_PLACED})")

    def from_gaps(found: Column, gaps: Column) -> Column:
        items = F.zip_with(
            F.zip_with(
                F.slice(gaps, F.lit(1), F.size(found)),
                F.slice(gaps, F.lit(2), F.size(found)),
                lambda a, b: F.struct(
                    F.length(a).cast("long").alias("gap"),
                    F.substring(a, -BEFORE, BEFORE).alias("before"),
                    F.substring(b, 1, 1).alias("after"),
                ),
            ),
            found,
            lambda g, t: F.struct(
                g["gap"].alias("gap"), F.length(t).alias("len"), t.alias("t"), g["before"].alias("before"), g["after"].alias("after")
            ),
        )
        return let(items, _placed)

    def from_found(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return F.when(F.size(found) == 0, none).otherwise(let(gaps, lambda g: from_gaps(found, g)))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), from_found)
    return spans if gate is None else F.when(gate, spans).otherwise(none)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The four fixed kinds; matches that fail their check are dropped."""
    octet = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    length = lambda t: F.length(_digits(t))
    luhn = lambda t: F.when(length(t).between(13, 19), F.call_function("luhn_check", _digits(t))).otherwise(False)
    return {
        "email": matches(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(text, IP), lambda x: x["t"].rlike(rf"^{octet}(?:\.{octet}){{3}}$")),
        "card": F.filter(matches(text, CARD), lambda x: luhn(x["t"])),
        "phone": F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda x: length(x["t"]).between(9, 15)),
    }


def _yes_no(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(x: Column) -> list[Column]:
    """1 (private), -1 (not) or 0 (no opinion) of each labeler on one candidate."""
    t, before, after = x["t"], x["before"], x["after"]
    share = F.length(_digits(t)) / F.length(t)
    assigned = before.rlike(rf"(?i)\b{ASSIGNED}\s?[=:]\s?[\"']?$")
    # Names and addresses are words: what their characters and the prose before them are says nothing.
    words = t.rlike(r"^(?:\p{Lu}|[0-9]{1,5}[a-z]?\s\p{Lu})") & (t.rlike(r"\s") | before.rlike(rf"{CALLED}\s?:\s?$"))
    return [
        # forms
        _yes_no(
            t.rlike(r"^(?:[0-9a-fA-F]{16,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{4,8})$")
            | t.rlike(rf"^(?:{TITLE}\s)?\p{{Lu}}\p{{L}}+(?:[ -]\p{{Lu}}\p{{L}}+)+$|^{TITLE}\s\p{{Lu}}\p{{L}}+$|^[0-9].*\s{STREETS}$"),
            t.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[A-Za-z]+[_-]?[0-9]{1,4})$"),
        ),
        # gazetteers of words before it
        _yes_no(
            before.rlike(rf"(?i)(?:{ASSIGNED}|key|account|{CALLED}|(?:lives|living|resides|address|office)(?:\sat|\sin|:)?)[^A-Za-z0-9]{{0,6}}$"),
            before.rlike(r"(?i)(?:version|article|figure|isbn|page|model|chapter)[^A-Za-z0-9]{0,6}$"),
        ),
        # context on the left: assigned, or in running prose
        _yes_no(before.rlike(r"[=:]\s*[\"']?$"), before.rlike(r"\p{L},?\s$") & ~words),
        # context on the right: closes a quotation, or a path goes on
        _yes_no(after.isin('"', "'"), after.isin("/", "\\")),
        # make-up: letters and digits mixed in a long token, or hardly a digit
        _yes_no((F.length(t) >= 12) & share.between(0.2, 0.9) & (F.length(t) <= 128), (share < 0.1) & ~words & ~assigned),
        # words inside it
        _yes_no(~t.rlike(r"[A-Za-z]{4}") & ~words, t.rlike(r"[a-z]{6}") & ~words & ~assigned),
        # gazetteer of titles and words that names follow
        _yes_no(t.rlike(rf"^{TITLE}\s\p{{Lu}}") | before.rlike(rf"{CALLED}\s?:\s?$"), t.rlike(r"^\p{Ll}+$") & ~assigned),
        # gazetteers of given names, of streets, and of words that values are assigned to
        _yes_no(t.rlike(rf"\s{STREETS}$|^(?:{TITLE}\s)?{GIVEN}\b") | assigned, before.rlike(r"(?i)(?:no|without|forgot|your)\s\w*\s?[=:]\s?$")),
    ]


def features(x: Column, source: int) -> Column:
    """A span's features as a short code: one digit for each of FEATURE_SIZES."""
    t, before, after = x["t"], x["before"], x["after"]
    share = F.length(_digits(t)) / F.length(t)
    length = F.length(t)
    parts = [
        F.when(length < 12, "0").when(length < 16, "1").when(length < 24, "2").otherwise("3"),
        F.when(share < 0.25, "0").when(share < 0.5, "1").when(share < 0.75, "2").when(share < 1, "3").otherwise("4"),
        F.when(t.rlike("[A-Z]"), "1").otherwise("0"),
        F.when(t.rlike("[_-]"), "1").otherwise("0"),
        F.when(t.rlike("[g-zG-Z]"), "1").otherwise("0"),
        F.when(before.rlike(r"[=:]$"), "0").when(before.rlike(r"[\"']$"), "1").when(before.rlike(r"\s$"), "2").otherwise("3"),
        F.when(after.rlike(r"^[\"']"), "0").when(after.rlike(r"^\s?$"), "1").otherwise("2"),
        F.when(before.rlike(r"[A-Za-z0-9]\s?[=:]\s?[\"']?$"), "1").otherwise("0"),
        F.lit(str(source)),
    ]
    return F.concat(*parts)


FEATURE_SIZES = (4, 5, 2, 2, 2, 4, 3, 2, 4)


def candidates(text: Column) -> Column:
    """Start, end, source, vote code (one of 0, 1, 2 for -1, 0, 1 of each labeler) and feature code of each candidate.

    A value that is a candidate by its form is not one again by its context.
    """
    found = [
        matches(text, TOKEN),
        F.filter(
            matches(text, VALUE, text.rlike(rf"(?i){ASSIGNED}\s?[=:]")),
            lambda x: ~x["t"].rlike(r"^(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{8,}+$") & ~x["t"].rlike(EMAIL),
        ),
        matches(text, NAME, text.rlike(rf"{TITLE}\s\p{{Lu}}|{CALLED}\s?:\s?\p{{Lu}}")),
        matches(text, STREET, text.rlike(rf"[0-9][a-z]?\s\p{{Lu}}\p{{L}}+\s.{{0,80}}{STREETS}")),
    ]

    def coded(source: int, spans: Column) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct(
                x["s"].alias("s"),
                x["e"].alias("e"),
                F.lit(source).alias("source"),
                F.concat(*[(v + 1).cast("string") for v in votes(x)]).alias("votes"),
                features(x, source).alias("features"),
            ),
        )

    return F.concat(*[coded(k, spans) for k, spans in enumerate(found)])


@dataclass
class SpanModel:
    """Labeler reliabilities and classifier weights; without candidates it keeps none."""

    prior: float = 0.0
    odds: list[list[float]] = field(default_factory=list)  # log odds of each labeler's three votes
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    bias: float = -1.0

    def posterior(self, code: Column) -> Column:
        score = F.lit(self.prior)
        for j, row in enumerate(self.odds):
            vote = F.substring(code, j + 1, 1)
            score = score + F.when(vote == "0", row[0]).when(vote == "1", row[1]).otherwise(row[2])
        return 1 / (1 + F.exp(-score))

    def keeps(self, code: Column) -> Column:
        score = F.lit(self.bias)
        for j, size in enumerate(FEATURE_SIZES):
            part = F.substring(code, j + 1, 1)
            choice = F.lit(0.0)
            for v in range(size):
                weight = self.weights.get((j, v), 0.0)
                choice = F.when(part == str(v), weight).otherwise(choice)
            score = score + choice
        return score >= 0


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[float, list[list[float]]]:
    """Expectation maximisation over vote patterns: prior and each labeler's log odds by vote.

    Starts from the balance of votes; one pseudo-count a vote keeps estimates finite, and more
    of them on the side a labeler votes for keep the two classes from changing places.
    """
    if not patterns:
        return 0.0, [[0.0, 0.0, 0.0]] * LABELERS
    p = {k: _sigmoid(sum(int(v) - 1 for v in k)) for k in patterns}
    total = sum(patterns.values())
    prior, odds = 0.0, []
    for _ in range(rounds):
        yes = sum(n * p[k] for k, n in patterns.items())
        prior = math.log((yes + 1) / (total - yes + 1))
        odds = []
        for j in range(LABELERS):
            table = {True: [1.0, 2.0, 3.0], False: [3.0, 2.0, 1.0]}
            for k, n in patterns.items():
                table[True][int(k[j])] += n * p[k]
                table[False][int(k[j])] += n * (1 - p[k])
            a, b = sum(table[True]), sum(table[False])
            odds.append([math.log(x / a) - math.log(y / b) for x, y in zip(table[True], table[False])])
        new = {k: _sigmoid(prior + sum(odds[j][int(v)] for j, v in enumerate(k))) for k in patterns}
        change = max(abs(new[k] - p[k]) for k in patterns)
        p = new
        if change < 1e-6:
            break
    return prior, odds


def fit_classifier(groups: list[tuple[str, float, float]], rounds: int = 300) -> tuple[float, dict[tuple[int, int], float]]:
    """Logistic regression on (feature code, weight of yes, weight of no), with a ridge."""
    keys = [[(j, int(v)) for j, v in enumerate(code)] for code, _, _ in groups]
    total = sum(a + b for _, a, b in groups) or 1.0
    bias, weights = 0.0, {k: 0.0 for row in keys for k in row}
    for _ in range(rounds):
        slope = 0.0
        slopes = {k: 0.002 * w for k, w in weights.items()}
        for row, (_, yes, no) in zip(keys, groups):
            p = _sigmoid(bias + sum(weights[k] for k in row))
            d = ((yes + no) * p - yes) / total
            slope += d
            for k in row:
                slopes[k] += d
        bias -= slope
        for k, s in slopes.items():
            weights[k] -= s
    return bias, weights


def fit(found: DataFrame) -> SpanModel:
    """Learn from ``found.candidates``; groups are bounded by vote patterns and feature codes."""
    each = found.select(F.explode("candidates").alias("c"))
    patterns = {r["v"]: r["n"] for r in each.groupBy(F.col("c.votes").alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not patterns:
        return SpanModel()
    model = SpanModel(*estimate(patterns))
    yes = model.posterior(F.col("c.votes"))
    rows = each.groupBy(F.col("c.features").alias("f")).agg(F.sum(yes).alias("yes"), F.sum(1 - yes).alias("no")).collect()
    model.bias, model.weights = fit_classifier(sorted((r["f"], r["yes"], r["no"]) for r in rows))
    return model


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, SpanModel]:
    """doc_id, an array of {s, e} for each kind, fixed and added, and the fitted model."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    place = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    base = {k: F.transform(c, place).alias(k) for k, c in base_spans(F.col("text")).items()}
    found = cut_lineage(rows.select("doc_id", *base.values(), candidates(F.col("text")).alias("candidates")))
    model = fit(found)
    def kept(kind: str) -> Column:
        sources = [k for k, x in enumerate(SOURCES) if x == kind]
        mine = F.filter("candidates", lambda x: x["source"].isin(*sources) & model.keeps(x["features"]))
        return F.array_sort(F.transform(mine, place)).alias(kind)

    return found.select("doc_id", *KINDS, *[kept(k) for k in ADDED]), model


def summary(spans: DataFrame) -> DataFrame:
    """Counts of the fixed kinds, the digest of their places, and all spans as text."""
    base = F.concat(*[_joined(k, F.col(k)) for k in KINDS])
    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, *[_joined(k, F.col(k)) for k in ADDED]), ",").alias("spans"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ADDED],
    )
