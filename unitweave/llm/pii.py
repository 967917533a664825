"""Personal data: labelers vote on candidate spans, expectation-maximisation finds how reliable they are, and a span
classifier is trained on its verdicts. Over the texts, Spark expressions only."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import prefix_sums, write_shared

#: The base kinds in order. A match begins where no character of its first run stands before it, or
#: where the last match ended; runs are possessive; so scanning is linear. Card chains of under 16 digits can't pass.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that the method may add: numbers of persons and accounts, names, street addresses, dates of birth. Their
#: patterns are wide; the labelers tell which matches are meant.
ADDED = {
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<!\p{L})\p{Lu}\p{Ll}{1,19}(?:\x20\p{Lu}\.)?\x20\p{Lu}\p{Ll}{1,19}(?!\p{L})",
    "address": r"(?<![\p{L}0-9])(?:[0-9]{1,5}(?:\x20\p{Lu}\p{Ll}{1,19}){1,3}|\p{Lu}\p{Ll}{2,24}\x20[0-9]{1,4})(?![\p{L}0-9])",
    "birth": r"(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])",
}
PATTERNS = BASE | ADDED
KINDS = list(PATTERNS)
LABELERS = ("rule", "gazetteer", "context", "edges", "form")
#: Words before a span that speak for its kind.
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|adresse|correo)\b", "ip": r"(?i)\b(ip|host|server|address|login|client)\b", "card": r"(?i)\b(card|visa|mastercard|credit|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|fax|cell|telefon|whatsapp)\b", "ssn": r"(?i)\b(ssn|social security|sozialversicherung)\b", "iban": r"(?i)\b(iban|account|konto|bank|cuenta|compte)\b",
    "name": r"(?i)\b(mr|mrs|ms|dr|prof|herr|frau|señora?|monsieur|madame|name is|named?|signed|dear|contact|by)\b[.:]?\s*$", "address": r"(?i)\b(address|adresse|dirección|lives? (at|in)|street|ship to|wohnhaft)\b",
    "birth": r"(?i)\b(born|birth|birthday|dob|geboren|geburtsdatum|naissance|née?|nacid[oa]|nacimiento)\b",
}
TOP_DOMAINS = "com org net edu gov int io co de fr es it uk us eu info biz me app dev ch at nl be pl pt br mx ca au jp cn in ru se no fi dk".split()
DIAL_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
IBAN_LANDS = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split()
GIVEN_NAMES = """
Alice Andrea Anna Anne Antonio Barbara Ben Carlos Carmen Charles Charlotte Claire Daniel David Elena Elizabeth Emily Emma Eva Frank
Franz George Hannah Hans Helen Ines Isabel Jack Jacques James Jan Jane Javier Jean John Jonas Jorge Jose Juan Julia Karen Karl Kate
Laura Lena Linda Lisa Louis Lucas Lucia Luis Lukas Manuel Maria Marie Mark Martin Mary Max Michael Miguel Monika Nicole Nina Olivia
Pablo Patricia Paul Pedro Peter Philippe Pierre Rachel Richard Robert Rosa Sandra Sarah Sofia Sophie Stefan Susan Thomas Tom Ursula
Victor William Wolfgang
""".split()
STREETS = r"(?:\b(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd|Court|Square|Calle|Rue)$|(?:straße|strasse|weg|platz|gasse|allee)\x20[0-9]+$)"
#: Characters in front of a span that are looked at.
BEFORE = 40
#: Probability from which the classifier takes a span that is not a base one.
TAKE = 0.9
#: Expectation-maximisation ends when no posterior moves by more than this, or after so many rounds.
SETTLED, MOST_ROUNDS = 1e-7, 2_000
#: How often each labeler says yes on personal and on other spans, and how often a candidate is personal, before any is
#: seen. These count as PULL votes against what is estimated.
START = {"rule": (0.95, 0.1), "gazetteer": (0.8, 0.2), "context": (0.8, 0.05), "edges": (0.95, 0.6), "form": (0.9, 0.3)}
START_PRIOR, PULL = 0.3, 4.0


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, start, end, value, before, after) of the matches; the pieces between them give the places.

    before: up to BEFORE characters in front of the match, from the ends of the pieces and matches there (a match has 4
    characters at least, so a few of them suffice); after: the next character. The text itself is cut once.
    """
    values, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        values,
        lambda a, b: F.struct(F.length(a).alias("skip"), b.alias("value"), F.right(a, F.lit(BEFORE)).alias("tail")),
    )
    heads = F.transform(pieces, lambda p: F.left(p, F.lit(1)))
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  so that x is made once

    def placed(x: Column) -> Column:
        sums = prefix_sums(F.transform(x, lambda p: p["skip"] + F.length(p["value"])))
        said = F.flatten(F.transform(x, lambda p: F.array(p["tail"], F.right(p["value"], F.lit(BEFORE)))))
        every = F.struct(x.alias("pairs"), sums.alias("sums"), said.alias("said"), heads.alias("heads"))
        return bound(every, lambda e: F.transform(e["pairs"], lambda p, i: span(e, p, i)))

    def span(e: Column, p: Column, i: Column) -> Column:
        start = F.get(e["sums"], i).cast("int") + p["skip"]
        first = F.greatest(2 * i - 2 * (BEFORE // 4), F.lit(0))
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(p["value"])).alias("end"), p["value"].alias("value"),
            F.right(F.array_join(F.slice(e["said"], first + 1, 2 * i - first + 1), ""), F.lit(BEFORE)).alias("before"),
            F.coalesce(F.nullif(F.get(e["heads"], i + 1), F.lit("")), F.left(F.get(e["pairs"], i + 1)["value"], F.lit(1)), F.lit("")).alias("after"),
        )

    return F.when(F.regexp_like(text, F.lit(pattern)), bound(pairs, placed)).otherwise(
        F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>")
    )


def luhn(value: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(value, "[^0-9]", ""), ""))
    doubled = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def iban_sum(value: Column) -> Column:
    """Whether the check digits of an account number are right: the first four characters go last, letters count from
    10 on, and the number leaves 1 when divided by 97."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    number = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(turned, F.lit(0), lambda s, c: (s * F.when(F.ascii(c) >= 65, 100).otherwise(10) + number(c)) % 97) == 1


def votes(x: Column) -> dict[str, Column]:
    """Each labeler's vote on a span: 1 for, 0 against, 2 for none.

    rule: check sums and ranges. gazetteer: lists of domains, dial codes, lands, given names, streets. context: words
    before the span (absence is no vote). edges: the span stands free. form: how such data are usually written.
    """
    kind, value = x["kind"], x["value"]
    n_digits = F.regexp_count(value, F.lit("[0-9]"))
    small = F.forall(
        F.split(value, r"\."),
        lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)),
    )
    part = lambda k: F.element_at(F.split(value, "[./-]"), k).cast("int")
    iso = F.regexp_like(value, F.lit("^[0-9]{4}"))
    year, low, high = F.when(iso, part(1)).otherwise(part(3)), F.least(
        part(2), F.when(iso, part(3)).otherwise(part(1))
    ), F.greatest(part(2), F.when(iso, part(3)).otherwise(part(1)))
    rule = (
        F.when(kind == "ip", small).when(kind == "card", F.when((n_digits >= 16) & (n_digits <= 19), luhn(value)).otherwise(False))
        .when(kind == "phone", (n_digits >= 8) & (n_digits <= 15)).when(kind == "ssn", ~F.regexp_like(value, F.lit("^(000|666|9)|-00-|-0000$")))
        .when(kind == "iban", iban_sum(value)).when(kind == "birth", low.between(1, 12) & high.between(1, 31)).when(kind.isin("name", "address"), F.lit(None)).otherwise(True)
    )
    dial = reduce(lambda c, d: c | value.startswith("+" + d), DIAL_CODES, F.lit(False))
    gazetteer = (
        F.when(kind == "email", F.lower(F.element_at(F.split(value, r"\."), -1)).isin(TOP_DOMAINS))
        .when(kind == "phone", dial).when(kind == "iban", F.substring(value, 1, 2).isin(IBAN_LANDS))
        .when(kind == "card", F.when(F.substring(value, 1, 1).isin("3", "4", "5", "6"), True))
        .when((kind == "ip") & F.regexp_like(value, F.lit(r"^(0|127|255)\.")), False)
        .when(kind == "name", F.substring_index(value, " ", 1).isin(GIVEN_NAMES)).when(kind == "address", F.regexp_like(value, F.lit(STREETS)))
    )
    context = reduce(
        lambda c, k: c.when(kind == k, F.regexp_like(x["before"], F.lit(CONTEXT[k]))),
        KINDS,
        F.when(F.lit(False), F.lit(False)),
    ).otherwise(False)
    clear = ~F.regexp_like(x["before"], F.lit(r"[\p{L}0-9]$")) & ~F.regexp_like(x["after"], F.lit(r"^[\p{L}0-9]"))
    form = (
        F.when(kind == "email", F.regexp_like(value, F.lit(r"^[^@]{2,64}@.{1,63}\.[A-Za-z]{2,6}$"))).when(kind == "ip", F.regexp_like(value, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")) & F.regexp_like(value, F.lit("[0-9]{2}")))
        .when(kind == "card", F.regexp_like(value, F.lit(r"^([0-9]{16}|[0-9]{4}([ -][0-9]{4}){3})$"))).when(kind == "phone", F.regexp_like(value, F.lit(r"^\+[0-9]{1,3}[ .-]?(\([0-9]{2,4}\)|[0-9]{2,4})([ .-]?[0-9]{2,}){1,4}$")))
        .when(kind == "iban", F.length(F.regexp_replace(value, " ", "")).between(15, 34)).when(kind == "birth", year.between(1900, 2020))
    )
    as_vote = lambda c: F.coalesce(c.cast("int"), F.lit(2))
    return {
        "rule": as_vote(rule),
        "gazetteer": as_vote(gazetteer),
        "context": F.when(context, 1).otherwise(2),
        "edges": as_vote(clear),
        "form": as_vote(form),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans: candidate spans of all kinds by kind and start, each with its votes and length class."""
    text = F.coalesce("text", F.lit(""))
    raw = docs.select("doc_id", text.alias("_uw_text"))
    raw = raw.select("doc_id", F.concat(*[spans_of(F.col("_uw_text"), p, k) for k, p in PATTERNS.items()]).alias("_uw_raw"))
    voted = F.transform(
        "_uw_raw",
        lambda x: F.struct(
            x["kind"].alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            *[v.alias(k) for k, v in votes(x).items()],
            F.least(F.floor((x["end"] - x["start"]) / 5), F.lit(8)).cast("int").alias("size"),
        ),
    )
    return raw.select("doc_id", voted.alias("spans"))


class SpanModel:
    """Probability that a span is personal, from its kind, votes and length class: a logistic model whose weights stand
    in one array, by kind and then by feature."""

    #: Features of a kind: itself, each labeler's yes and no, length classes.
    WIDTH = 1 + 2 * len(LABELERS) + 9

    def __init__(
        self,
        weights: np.ndarray,
        reliability: dict[tuple[str, str], tuple[float, float]] | None = None,
        prior: dict[str, float] | None = None,
    ):
        self.weights, self.reliability, self.prior = weights, reliability or {}, prior or {}

    def probability(self, x: Column) -> Column:
        table = F.array(*[F.lit(float(w)) for w in self.weights])
        first = (F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]) - 1).cast("int") * self.WIDTH
        weight = lambda k: F.get(table, first + k)
        z = weight(F.lit(0)) + weight(1 + 2 * len(LABELERS) + x["size"])
        for j, m in enumerate(LABELERS):
            z = z + F.when(x[m] < 2, weight(1 + 2 * j + x[m])).otherwise(0.0)
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def estimate(votes_: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each pattern of votes, reliabilities (labeler, personal or not) and prior, by expectation-maximisation.

    votes_: patterns x labelers with 1, 0 and 2 (none); n: spans of each pattern. Starts from START and runs until the
    posteriors stand still. PULL votes of START are added, so rates keep off 0 and 1 and "personal" stays the class
    that the labelers vote for.
    """
    yes, no = votes_ == 1, votes_ == 0
    start = np.array([START[m] for m in LABELERS])
    rates, prior, p = start.copy(), START_PRIOR, np.full(len(n), -1.0)
    for _ in range(MOST_ROUNDS):
        z = np.log(prior / (1 - prior)) + yes @ np.log(rates[:, 0] / rates[:, 1]) + no @ np.log((1 - rates[:, 0]) / (1 - rates[:, 1]))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        moved, p = np.abs(new - p).max(initial=0.0), new
        if moved < SETTLED:
            break
        for c, w in ((0, n * p), (1, n * (1 - p))):
            rates[:, c] = (w @ yes + PULL * start[:, c]) / (w @ (yes | no) + PULL)
        prior = (n @ p + PULL * START_PRIOR) / (n.sum() + PULL)
    return p, rates, prior


def fit_span_model(spans: DataFrame) -> SpanModel:
    """The span classifier, trained on posteriors of the votes.

    Spark counts the spans of each (kind, votes, length class): a table of at most a few thousand rows however large
    the input is, which is collected. Expectation-maximisation per kind and the logistic fit on its posteriors (Newton
    steps, small ridge, each pattern weighed by its spans) run over that table. No spans: weights of zero.
    """
    fields = ["kind", *LABELERS, "size"]
    counted = spans.select(F.explode("spans").alias("x")).groupBy(
        *[F.col(f"x.{f}").alias(f) for f in fields]
    ).agg(F.count(F.lit(1)).alias("n"))
    rows, width = sorted(counted.collect()), SpanModel.WIDTH
    weights, reliability, prior = np.zeros(len(KINDS) * width), {}, {}
    for code, kind in enumerate(KINDS):
        some = [r for r in rows if r["kind"] == kind]
        if not some:
            continue
        v, n, size = np.array(
            [[r[m] for m in LABELERS] for r in some]
        ), np.array([r["n"] for r in some], float), np.array([r["size"] for r in some])
        p, rates, prior[kind] = estimate(v, n)
        reliability |= {(kind, m): tuple(map(float, rates[j])) for j, m in enumerate(LABELERS)}
        x = np.zeros((len(some), width))
        x[:, 0] = 1
        for j in range(len(LABELERS)):
            for vote in (0, 1):
                x[:, 1 + 2 * j + vote] = v[:, j] == vote
        x[np.arange(len(some)), 1 + 2 * len(LABELERS) + size] = 1
        w, ridge = np.zeros(width), np.diag([1e-3] + [0.01] * (width - 1))
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w + np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (n * (p - q)) - ridge @ w)
        weights[code * width : (code + 1) * width] = w
    return SpanModel(weights, reliability, prior)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each document.

    Base kinds are matched leftmost and without overlap; those that pass their rule always stay. All other candidates
    (further kinds, and matches that failed their rule) are taken if the classifier says so; n_spans counts all taken.
    Null and empty texts have no spans. Null doc_ids and repeated rows are searched like others. Empty table: no
    rows. Columns other than doc_id and text are ignored. Positions are code points from 0, ends exclusive. Very long
    texts are searched whole; work grows in proportion to text and matches.
    """
    spans = write_shared(candidates(docs), "candidates")
    model = fit_span_model(spans)
    in_base = lambda x: x["kind"].isin(list(BASE)) & (x["rule"] == 1)
    of_kind = lambda k: lambda x: x["kind"] == k
    written = lambda a: F.array_join(
        F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    base = F.filter("spans", in_base)
    found = spans.withColumn("_uw_base", base).withColumn(
        "_uw_all", F.filter("spans", lambda x: in_base(x) | (model.probability(x) >= TAKE))
    )
    return found.select(
        "doc_id", *[F.size(F.filter("_uw_base", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(written("_uw_base"), 256).alias("base_sha256"), written("_uw_all").alias("spans"), F.size("_uw_all").cast("long").alias("n_spans"),
    )
