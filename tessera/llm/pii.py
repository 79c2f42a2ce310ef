"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans,
expectation-maximisation estimates how reliable each labeler is, and a naive-Bayes span classifier is
trained on the resulting posteriors. Everything over rows is DataFrame expressions.

Base spans (email, ip, card, phone) are found by their fixed patterns and checks, leftmost and
non-overlapping per kind, and always stay. One further pattern proposes candidates of other kinds
(ssn, iban, local, secret, name); those that overlap a base span go, and of the others those that the
classifier accepts are added.

EM sees votes alone: a labeler that abstains says nothing, one that votes is right at rates of its own for
true and for false spans. The classifier sees what a span looks like (size, kinds of characters, checksums) and
what stands before it, weighted by EM's posteriors; its features `form` and `word` are the evidence that the shape
and the context labeler vote by, so it isn't independent of these two. Both learn from one table of counts by
kind, votes and feature, bounded by kinds x 3^labelers x features, never from texts or spans; its counts cover
all rows. What an added span gets depends on these counts, so on the other rows.

The patterns are written so that Java's matcher neither recurses nor rescans long runs: groups are
possessive where nothing follows them, and a run is entered at its start or where the last match ended.

Null texts count as empty; texts without candidates have empty spans. Offsets are code points, end
exclusive. Rows that repeat give the same result each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

BASE = ("email", "ip", "card", "phone")
ADDED = ("ssn", "iban", "local", "secret", "name")
KINDS = BASE + ADDED

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters of an IBAN by country.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC", 32: "LC",
}
_GROUP = r"\x20?[A-Z0-9]"


def _iban(countries: str, size: int) -> str:
    groups, rest = divmod(size - 4, 4)
    return rf"(?:{countries})[0-9]{{2}}(?:{_GROUP}{{4}}){{{groups}}}" + (rf"{_GROUP}{{{rest}}}" if rest else "")


#: A country's own length first; else 15 to 34 characters, so that an unknown country or a slip is found too.
IBAN = "|".join([
    *(_iban(countries, size) for size, countries in IBAN_SIZES.items()),
    rf"[A-Z]{{2}}[0-9]{{2}}(?:{_GROUP}{{4}}){{2}}(?:(?:{_GROUP}{{4}}){{1,5}}(?:{_GROUP}{{1,3}})?|{_GROUP}{{3}})",
])
#: Given names of the languages at hand: fixed values.
GIVEN = (
    "Adam|Alejandro|Alexander|Alice|Ana|Andrea|Andreas|Andrew|Anna|Anne|Antonio|Barbara|Ben|Bernard|Carlos|Carmen|Catherine|Charles|Charlotte"
    "|Christian|Christine|Claire|Claudia|Daniel|David|Diego|Dorothy|Elena|Elizabeth|Emily|Emma|Eric|Eva|Felix|Fernando|Florian|Francisco|Frank|Franz"
    "|François|Gabriel|George|Grace|Hannah|Hans|Heinz|Helen|Henri|Henry|Isabel|Isabelle|Jack|Jacques|James|Jan|Javier|Jean|Jennifer|Jessica|Joan|Johann"
    "|Johannes|John|José|Joseph|Juan|Julia|Julie|Karl|Katharina|Klaus|Laura|Lea|Leon|Linda|Louis|Louise|Lucas|Lucía|Luis|Lukas|Manuel|Margaret"
    "|Maria|María|Marie|Mark|Marta|Martin|Mary|Matthew|Max|Michael|Michel|Miguel|Monika|Nathalie|Nicole|Nina|Olivia|Pablo|Patricia|Paul|Pedro|Peter|Petra"
    "|Philip|Philippe|Pierre|Rachel|Ralf|Richard|Robert|Rosa|Ruth|Sabine|Sandra|Sarah|Simon|Sofia|Sophie|Stefan|Stephen|Susan|Susanne|Teresa|Thomas"
    "|Tobias|Ursula|Victor|William|Wolfgang"
)
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Sr|Sra|Mme|Mlle"
PROPOSE = (
    r"(?<![A-Za-z0-9])(?:"
    r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
    rf"|(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})(?![A-Za-z0-9])"  # a look ahead, as most words are no IBAN
    r"|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
    r"|(?:token|api_key|apikey|secret|password|passwd|pwd)\x20?[=:]\x20?[\x22']?[A-Za-z0-9_/+.-]{8,}+[\x22']?"
    rf"|(?=\p{{Lu}}\p{{Ll}})(?<!\p{{L}})(?:(?:{TITLES})\.?\x20\p{{Lu}}\p{{Ll}}+(?:\x20\p{{Lu}}\p{{Ll}}+)?|(?:{GIVEN})\x20\p{{Lu}}\p{{Ll}}+))"
)
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Words that announce a kind, in the data's languages, and gazetteers: fixed values.
CONTEXT = {
    "email": "mail|email|e-mail|contact|kontakt|correo|courriel|write|schreiben",
    "ip": "ip|host|server|address|adresse|client|login|router|from|gateway",
    "card": "card|karte|carte|tarjeta|visa|mastercard|amex|credit|kredit",
    "phone": "tel|telefon|teléfono|téléphone|phone|call|fax|mobile|mobil|handy|cell",
    "ssn": "ssn|social|security|sozial",
    "iban": "iban|konto|account|bank|cuenta|compte|pay",
    "local": "tel|telefon|teléfono|téléphone|phone|call|fax|mobile|mobil|handy|cell",
    "secret": "key|credential|credentials|login|user|export|set|env",
    "name": "name|from|by|von|de|dear|hello|liebe|lieber|signed|patient|client|author",
}
DOUBT = r"(?i)(?:version|v|no|nr|nº|number|order|part|item|isbn|serial|#)[.:\x20]*$"
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|us|it|nl|ch|at|be|pl|mx|br|ca|au|jp|cn|in)$"
CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
NAMES = rf"(?:^|\x20)(?:{GIVEN})\x20"
COUNTRIES = r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
NOT_PUBLIC = r"^0*(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^0*192\.0*168\.|^0*172\.0*(?:1[6-9]|2[0-9]|3[01])\."
PLACEHOLDERS = r"(?i)change_?me|example|placeholder|your_|xxxx|\*\*\*|dummy|insert"
LABELERS = ("shape", "gazetteer", "context", "doubt")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    doubled = F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, F.element_at(doubled, d + 1)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda span: _passes(kind, span["value"])


_CHUNK = 64


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once: lambdas would evaluate an expression again each time."""
    return F.transform(F.array(value), use)[0]


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def running(values: Column, join: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """What joins the ints before each one, from 0 on, by an associative function such as a sum. An array grows by
    copying, so only chunks grow: first come the chunks' totals, whose running values (by chunks again, two levels
    up) are where each chunk starts. So time is linear up to chunks^3 and far beyond."""

    def within(chunk: Column, first: Column) -> Column:
        def step(acc: Column, value: Column) -> Column:
            return F.struct(join(acc["at"], value).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(chunk, F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out")), step)["out"]

    if levels == 1:
        return within(values, F.lit(0))

    def cut(named: Column) -> Column:
        last = F.greatest(F.floor((F.size(named) - 1) / _CHUNK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(named, c * _CHUNK + 1, F.lit(_CHUNK)))

    def whole(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), join))
        return F.flatten(F.zip_with(chunks, running(totals, join, levels - 1), within))

    return _named(_named(values, cut), whole)


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before) of a pattern's matches; before is up to 30 characters that
    precede. What lies between the matches gives their places, so no text is searched twice."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.split(text, pattern, -1).alias("gap")
    )

    def span(pair: Column, at: Column) -> Column:
        start = at + F.length(pair["gap"])
        return F.struct(start.alias("start"), (start + F.length(pair["value"])).alias("end"), pair["value"].alias("value"), F.right(pair["gap"], F.lit(30)).alias("before"))

    def placed(matched: Column) -> Column:
        sizes = F.transform(matched, lambda p: F.length(p["gap"]) + F.length(p["value"]))
        return F.zip_with(matched, running(sizes, lambda a, b: a + b), span)

    return _named(F.filter(pairs, lambda p: p["value"].isNotNull()), placed)


def _kind_of(value: Column) -> Column:
    return (
        F.when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(value.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(value.rlike(r"^\(?[0-9]"), "local")
        .when(value.rlike(r"[=:]"), "secret")
        .otherwise("name")
    )


def candidates(text: Column) -> Column:
    """Array of (start, no, end, kind, value, before) of base spans and proposals, in order of start and
    kind (no is the kind's place in KINDS). Proposals that overlap a base span are left out."""

    def typed(array: Column, kind) -> Column:
        def one(s: Column) -> Column:
            k = kind(s["value"]) if callable(kind) else F.lit(kind)
            return F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), k).cast("int").alias("no"), s["end"].alias("end"), k.alias("kind"), s["value"].alias("value"), s["before"].alias("before"))

        return F.transform(array, one)

    nothing = F.expr("cast(array() as array<struct<start:int,no:int,end:int,kind:string,value:string,before:string>>)")
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    base = []
    for kind in BASE:
        spans = F.filter(typed(found(text, PATTERNS[kind]), kind), _check(kind))
        base.append(F.when(needs[kind], spans).otherwise(nothing) if kind in needs else spans)
    proposed = typed(found(text, PROPOSE), _kind_of)

    def clear(both: Column) -> Column:
        # A sweep: a proposal stands at its end, after all base spans that start before it, and is clear if none
        # of these ends after its start.
        def swept(events: Column) -> Column:
            ends = F.transform(events, lambda e: F.when(e["base"], e["span"]["end"]).otherwise(0))
            reached = F.zip_with(events, running(ends, _larger), lambda e, most: F.struct(e["span"].alias("span"), (e["base"] | (most <= e["span"]["start"])).alias("stays")))
            return F.transform(F.filter(reached, lambda e: e["stays"]), lambda e: e["span"])

        def event(s: Column) -> Column:
            return F.struct(F.when(is_base(s), s["start"]).otherwise(s["end"]).alias("at"), is_base(s).alias("base"), s.alias("span"))

        mixed = F.exists(both, lambda s: ~is_base(s)) & F.exists(both, is_base)
        return F.when(mixed, _named(F.sort_array(F.transform(both, event)), swept)).otherwise(both)

    return F.sort_array(_named(F.concat(*base, proposed), clear))


def is_base(span: Column) -> Column:
    return span["no"] <= len(BASE)


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits are right."""
    compact = F.regexp_replace(iban, "[^A-Z0-9]", "")
    moved = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.left(compact, F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = F.substring(moved, i, F.lit(1))
        n = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _vote(yes: Column, no: Column | None = None) -> Column:
    found = F.when(yes, "+")
    return found.otherwise("0") if no is None else found.when(no, "-").otherwise("0")


def shape(span: Column) -> Column:
    """+ if the span's form and checksums hold, - if they break."""
    value, kind = span["value"], span["kind"]
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z].*[A-Za-z]")
    return (
        F.when(is_base(span), "+")
        .when(kind == "ssn", F.when(value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), "+").otherwise("-"))
        .when(kind == "iban", F.when(mod97(value), "+").when(F.length(value).between(15, 42) & value.rlike("[0-9]{4}"), "0").otherwise("-"))
        .when(kind == "secret", _vote((F.length(value) >= 20) & mixed, ~value.rlike(r"[=:]\x20?[\x22']?[^\x22']*[0-9_/+-]")))
        .when(kind == "local", F.when(value.rlike(r"^\(?[2-9][0-9]{2}\)?.[2-9]"), "+").otherwise("-"))
        .otherwise(_vote(value.rlike(r"\x20\S+\x20") | ~value.rlike(rf"^(?:{TITLES})\b")))
    )


def context(span: Column) -> Column:
    """The kind whose words stand right before the span, `doubt` after words of numbers that identify nobody."""
    found = F.when(span["before"].rlike(DOUBT), "doubt")
    # the span's own kind first, as kinds share words
    for kind, words in CONTEXT.items():
        found = found.when((span["kind"] == kind) & span["before"].rlike(rf"(?i)(?<!\p{{L}})(?:{words})[^\p{{L}}\p{{N}}]{{0,4}}$"), kind)
    found = found.when((span["kind"] == "name") & span["value"].rlike(rf"^(?:{TITLES})\b"), "title")
    return found.otherwise("none")


def votes(span: Column) -> Column:
    """The labelers' votes as a string: + for, - against, 0 for none."""
    value, kind = span["value"], span["kind"]
    known = (
        F.when(kind == "email", _vote(value.rlike(DOMAINS)))
        .when(kind == "ip", F.when(value.rlike(NOT_PUBLIC), "-").otherwise("+"))
        .when(kind == "card", F.when(value.rlike("^[3-6]"), "+").otherwise("-"))
        .when(kind == "phone", F.when(value.rlike(CODES), "+").otherwise("-"))
        .when(kind == "iban", F.when(value.rlike(COUNTRIES), "+").otherwise("-"))
        .when(kind == "name", _vote(value.rlike(NAMES)))
        .when(kind == "secret", _vote(F.lit(False), value.rlike(PLACEHOLDERS)))
        .otherwise("0")
    )
    said = context(span)
    doubt = F.when(value.rlike(r"([0-9])[\x20-]?\1{6}|0?123456789|987654321") | (said == "doubt"), "-").otherwise("0")
    return F.concat(shape(span), known, _vote(~said.isin("none", "doubt")), doubt)


def features(span: Column) -> Column:
    """What the classifier sees: an array of name=value, of which there are about 40."""
    value, size = span["value"], F.length(span["value"])

    def share(pattern: str) -> Column:
        return F.floor(4 * F.length(F.regexp_replace(value, pattern, "")) / size).cast("string")

    edge = F.regexp_extract(span["before"], r"(\S)\s*$", 1)
    edge = F.when(edge == "", "none").when(edge.rlike(r"\p{L}"), "letter").when(edge.rlike(r"\p{N}"), "digit").when(edge.isin(":", "="), "colon").when(edge == "#", "number").otherwise("sign")
    made = {
        "size": F.least(F.floor(F.log2(size)), F.lit(8)).cast("string"),
        "digits": share("[^0-9]"),
        "capitals": share(r"[^\p{Lu}]"),
        "different": F.floor(4 * F.size(F.array_distinct(F.split(value, ""))) / size).cast("string"),
        "form": shape(span),
        "word": context(span),
        "edge": edge,
    }
    return F.array(*[F.concat(F.lit(f"{k}="), v) for k, v in made.items()])


#: Rates at which a labeler's votes are right, before any is seen, and how many votes that counts for.
_RIGHT, _WEIGHT = 0.85, 20


def posteriors(counts: dict[tuple[str, str], int], rounds: int = 50) -> dict[tuple[str, str], float]:
    """The probability that a span of (kind, votes) is personal data, by EM. Each kind has a prior, each
    labeler a rate of votes for among true spans and of votes against among false ones; abstentions say
    nothing. Rates stay above 0.55, so that the classes can't change places."""
    right = [{True: _RIGHT, False: _RIGHT} for _ in LABELERS]
    prior: dict[str, float] = defaultdict(lambda: 0.5)

    def posterior(kind: str, vote: str) -> float:
        z = math.log(prior[kind] / (1 - prior[kind]))
        for rate, mark in zip(right, vote):
            if mark == "+":
                z += math.log(rate[True] / (1 - rate[False]))
            elif mark == "-":
                z += math.log((1 - rate[True]) / rate[False])
        return 1 / (1 + math.exp(-max(-700, min(700, z))))

    for _ in range(rounds):
        soft = {key: posterior(*key) for key in counts}
        for kind in sorted({k for k, _ in counts}):
            of = [(n, soft[key]) for key, n in counts.items() if key[0] == kind]
            prior[kind] = (2 + sum(n * p for n, p in of)) / (4 + sum(n for n, _ in of))
        for i, rate in enumerate(right):
            for truth, good in ((True, "+"), (False, "-")):
                agree, votes_cast = _RIGHT * _WEIGHT, float(_WEIGHT)
                for (kind, vote), n in counts.items():
                    if vote[i] != "0":
                        share = n * (soft[kind, vote] if truth else 1 - soft[kind, vote])
                        votes_cast += share
                        agree += share * (vote[i] == good)
                rate[truth] = min(0.99, max(0.55, agree / votes_cast))
    return {key: posterior(*key) for key in counts}


def train(counts: list[tuple[str, str, str, int]]) -> dict[tuple[str, str], float]:
    """Weights of the naive-Bayes classifier by (kind, feature), ("", in place of a feature: the kind's own),
    from counts of (kind, votes, feature); feature "" counts each span once. A feature's rates among true and
    false spans of a kind are smoothed by its rate among all of them."""
    truth = posteriors({(kind, vote): n for kind, vote, feature, n in counts if not feature})
    spans: dict[tuple, float] = defaultdict(float)
    for kind, vote, feature, n in counts:
        spans[kind, feature, True] += n * truth[kind, vote]
        spans[kind, feature, False] += n * (1 - truth[kind, vote])
    weights = {}
    for kind, feature in sorted({(k, f) for k, f, _ in spans}):
        yes, no = spans[kind, "", True], spans[kind, "", False]
        if not feature:
            weights[kind, ""] = math.log((yes + 1) / (no + 1))
            continue
        both = 5 * (spans[kind, feature, True] + spans[kind, feature, False]) / (yes + no)
        weights[kind, feature] = math.log((spans[kind, feature, True] + both) / (yes + 5)) - math.log((spans[kind, feature, False] + both) / (no + 5))
    return weights


def odds(span: Column, weights: dict[tuple[str, str], float]) -> Column:
    """The classifier's log-odds that a span is personal data."""
    tables: dict[str, list[Column]] = defaultdict(list)
    for (kind, feature), weight in weights.items():
        tables[kind] += [F.lit(feature), F.lit(weight)]
    table = F.when(F.lit(False), F.create_map(F.lit(""), F.lit(0.0)))
    for kind, entries in tables.items():
        table = table.when(span["kind"] == kind, F.create_map(*entries))

    def total(found: Column) -> Column:
        names = F.concat(F.array(F.lit("")), features(span))
        return F.aggregate(names, F.lit(0.0), lambda z, f: z + F.coalesce(F.try_element_at(found, f), F.lit(0.0)))

    return _named(table, total)


def _accepted(spans: Column, weights: dict[tuple[str, str], float]) -> Column:
    """Base spans, and proposals that the classifier accepts."""
    if not weights:
        return spans
    return F.filter(spans, lambda s: is_base(s) | (odds(s, weights) > 0))


def pattern_counts(spans: DataFrame) -> list[tuple[str, str, str, int]]:
    """Counts of (kind, votes, feature) over all candidates of the column `spans`."""
    each = spans.select(F.explode("spans").alias("s"))
    each = each.select(F.col("s.kind").alias("kind"), votes(F.col("s")).alias("votes"), F.concat(F.array(F.lit("")), features(F.col("s"))).alias("f"))
    rows = each.select("kind", "votes", F.explode("f").alias("feature")).groupBy("kind", "votes", "feature").count().collect()
    return sorted((r["kind"], r["votes"], r["feature"], r["count"]) for r in rows)  # kinds x 3^labelers x features at most


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row; spans is the array of (start, no, end, kind, value, before)."""
    spans = common.checkpointed(common.texts(docs).select("doc_id", candidates(F.col("text")).alias("spans")))
    weights = train(pattern_counts(spans))
    return spans.select("doc_id", _accepted(F.col("spans"), weights).alias("spans"))


def _nulled(kind: str) -> Callable[[Column], Column]:
    return lambda k: F.when(k == kind, k)


def span_digests(docs: DataFrame) -> DataFrame:
    """The query's columns; n_added counts the spans of other kinds than the base ones."""
    spans = detect(docs)
    base = F.filter("spans", is_base)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _nulled(k)))).cast("long").alias(f"n_{k}") for k in BASE]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return spans.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), added)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every detected span of its text replaced by its kind in brackets; n_chars, where docs
    has it, becomes the new text's length. Overlapping spans become one, named by the first. Rows and their
    candidates are written once to the shared folder, as texts are searched only once."""
    rows = common.written(docs.withColumn("__spans", candidates(F.coalesce("text", F.lit("")))), "spans")
    weights = train(pattern_counts(rows.select(F.col("__spans").alias("spans"))))
    rows = rows.withColumn("__spans", _accepted(F.col("__spans"), weights))
    text = F.col("text")

    def marks(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), _larger)
        return F.zip_with(spans, ends, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    rows = rows.withColumn("__marks", _named(F.col("__spans"), marks))
    cut = F.col("__marks")

    def replaced(points: Column) -> Column:
        def between(start: Column, size: Column) -> Column:
            # the A in front keeps a first U+FEFF from being read as a byte order mark
            part = F.concat(F.encode(F.lit("A"), "UTF-32"), F.substring(points, 4 * start + 1, 4 * size))
            return F.substring(F.decode(part, "UTF-32"), F.lit(2), size)

        def piece(m: Column) -> Column:
            return F.concat(between(m["at"], m["start"] - m["at"]), F.lit("["), F.upper(m["kind"]), F.lit("]"))

        last = F.array_max(F.transform(cut, lambda m: m["end"]))
        pieces = F.transform(F.filter(cut, lambda m: m["start"] >= m["at"]), piece)
        return F.concat(F.array_join(pieces, ""), between(last, F.length(text) - last))

    # Four bytes a character: a piece is cut out without walking the text up to it.
    clean = F.when(F.size(cut) > 0, _named(F.encode(text, "UTF-32"), replaced)).otherwise(text)
    rows = rows.withColumn("text", clean)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)
