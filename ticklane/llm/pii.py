"""Personal data by weak supervision, in column expressions only.

Candidate spans come from patterns: strict ones for e-mail, IP, card and phone (the base),
and looser ones for phone numbers without a plus sign, access keys, tokens, passwords and
account numbers. Labelers vote on every candidate: yes (2), no (0) or abstain (1).

- form: the regular shape of the kind, checked digits included;
- gazetteer: known prefixes, domains and number ranges of the kind;
- context: a word near the span that announces the kind, in four languages;
- surround: how the span is set off from the text around it.

Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability and the share of true spans, without any labels. The posterior of each pattern
then trains the final classifier, a logistic model over votes and shape of a span, which
decides. The base spans always stay; the classifier adds others. What reaches the driver is
one count per pattern of votes and shape: at most KINDS * 3 ** 4 * 16 rows.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.llm.linear import fit_logistic, sigmoid
from ticklane.llm.tables import stored, texts

#: Java patterns, leftmost and without overlaps. The start conditions and possessive
#: repeats leave the matches as they are and keep long runs linear and off the stack.
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "number": r"(?<![0-9A-Za-z+(.])(?:\([0-9]{2,4}\)[\x20]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){3,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "key": r"(?<![0-9A-Za-z])[A-Z]{4}[A-Z0-9]{16}(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9_-]*[A-Za-z])(?=[A-Za-z_-]*[0-9])(?:[0-9a-f]{16,64}|[A-Za-z0-9_-]{32,64})(?![0-9A-Za-z_-])",
}
KINDS = (*BASE, *LOOSE)
#: Kinds that can only occur where a text has this: spares the pattern elsewhere.
_NEEDS = {"email": "@", "phone": "+"}
#: A text without any of this holds no match of any kind: each pattern contains one branch.
_DENSE = r"[0-9][\x20.-]?[0-9]|@|[A-Z0-9]{16}|[0-9a-f]{16}|[A-Za-z0-9_-]{32}|\+[0-9]"
#: Words that announce a kind, lower case.
_CONTEXT = {
    "email": r"e-?mail|correo|courriel|mail",
    "ip": r"\bip\b|server|host|address",
    "card": r"card|visa|karte|carte|tarjeta",
    "phone": r"phone|tel|call|anruf|appel|llam",
    "number": r"phone|tel|call|fax|mobile|anruf|appel|llam",
    "ssn": r"\bssn\b|social|security",
    "iban": r"iban|konto|account|compte|cuenta",
    "key": r"key|access|aws|token|secret",
    "secret": r"token|password|passwort|secret|key|contrase|mot de passe|pwd|auth",
}
#: Known prefixes, domains or ranges.
_GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk)$",
    "ip": r"^(?!0)(?!127\.0\.0\.1$)[0-9]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|33|34|44|49|7|81|86|91)",
    "number": r"555|^\(?(?:2|3|4|5|6|7|8|9|0)",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^(?:DE|FR|ES|GB|IT|NL|AT|CH|BE|PT|PL)",
    "key": r"^(?:AKIA|ASIA|AIDA|AROA)",
    "secret": r"^(?:[0-9a-f]+$|sk-|ghp_|xox)",
}
_VOTES = ("form", "gazetteer", "context", "surround")
_NEAR = 24
#: Spans that are handled at a time where lists grow or are compared.
CHUNK = 128


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def valid(kind: str, span: Column) -> Column:
    """What a match of a base pattern must pass besides."""
    if kind == "ip":
        parts = F.transform(F.split(span, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & ((p == "") | (F.left(p, F.lit(3)).cast("int") <= 255)))
    if kind == "card":
        n = F.length(_digits(span))
        return F.when(n.between(12, 19), _luhn(_digits(span))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(span)).between(9, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once: in a lambda an expression is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _starts(lengths: Column, gaps: Column) -> Column:
    """Where each match starts, from the lengths of matches and of the gaps before them.

    Sums run over stretches of CHUNK matches, so that growing lists are copied seldom.
    """
    none = F.array().cast("array<int>")
    n = F.size(lengths)

    def stretch(at: Column, k: Column) -> Column:
        own = F.sequence(k * CHUNK, F.least((k + 1) * CHUNK, n) - 1)
        return F.aggregate(
            own, F.struct(at.alias("at"), none.alias("out")),
            lambda acc, i: _let(
                acc["at"] + F.get(gaps, i),
                lambda start: F.struct((start + F.get(lengths, i)).alias("at"), F.concat(acc["out"], F.array(start)).alias("out")),
            ),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, k: _let(stretch(acc["at"], k), lambda one: F.struct(one["at"].alias("at"), F.concat(acc["out"], one["out"]).alias("out"))),
    )["out"]


def _spans(kind: str, text: Column) -> Column:
    """Array of (kind, start, end, span, before, after) of a pattern's matches.

    Split gives the gaps around the matches, so lengths added up give positions.
    """
    pattern = BASE.get(kind) or LOOSE[kind]
    none = F.array().cast("array<struct<kind:string,start:int,end:int,span:string,before:string,after:string>>")

    def entries(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        lengths = [F.transform(x, lambda y: F.length(y)) for x in (found, gaps)]
        entry = lambda start, i: F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(F.get(found, i))).cast("int").alias("end"),
            F.get(found, i).alias("span"), F.right(F.get(gaps, i), F.lit(_NEAR)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(_NEAR)).alias("after"),
        )
        sizes = F.struct(lengths[0].alias("found"), lengths[1].alias("gaps"))
        return F.transform(_let(sizes, lambda x: _starts(x["found"], x["gaps"])), entry)

    both = F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    there = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
    return F.when(there & text.rlike(pattern), _let(both, entries)).otherwise(none)


def _judged(s: Column) -> Column:
    """The span with its labelers' votes: 2 yes, 0 no, 1 none."""
    span, before, after = s["span"], s["before"], s["after"]
    pick = lambda of: F.coalesce(*[F.when(s["kind"] == k, of(k)) for k in KINDS])
    vote = lambda yes, no: F.when(yes, 2).when(no, 0).otherwise(1)
    both = span.rlike("[0-9]") & span.rlike("[A-Za-z]")
    shaped = {"key": both, "secret": both, "number": F.length(_digits(span)).between(7, 15)}
    form = pick(lambda k: shaped.get(k, valid(k, span)))
    near = F.lower(F.concat(before, F.lit(" "), after))
    apart = before.rlike(r"(?:^|[\s\"'=:(<])$") & after.rlike(r"^(?:$|[\s\"'.,;:)>!?])")
    inside = before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")
    return F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), span.alias("span"),
        (s["kind"].isin(*BASE) & pick(lambda k: valid(k, span))).alias("base"),
        vote(form, ~form).alias("form"),
        vote(pick(lambda k: span.rlike(_GAZETTEER[k])), F.lit(False)).alias("gazetteer"),
        vote(pick(lambda k: near.rlike(_CONTEXT[k])), F.lit(False)).alias("context"),
        vote(apart, inside).alias("surround"),
        F.least(F.lit(3), F.floor(F.length(_digits(span)) / 5)).cast("int").alias("digits"),
    )


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, span, base, votes ..., digits) of the candidate spans.

    Positions are code points, the end exclusive. base: a match that passes the checks of its
    base pattern.
    """
    judged = F.transform(F.concat(*[_spans(k, text) for k in KINDS]), _judged)
    return F.when(text.rlike(_DENSE), judged)


def reliabilities(counts: list[tuple[tuple[int, ...], float]], rounds: int = 100):
    """(share of true spans, table[labeler, truth, vote]) by expectation-maximisation.

    counts: vote patterns (0, 1 or 2 per labeler) with their numbers. Starts from the view
    that labelers are right more often than not, which also settles which class is which.
    """
    patterns, n = np.array([p for p, _ in counts]), np.array([c for _, c in counts], float)
    labelers = patterns.shape[1]
    table = np.tile(np.array([[0.45, 0.4, 0.15], [0.15, 0.4, 0.45]]), (labelers, 1, 1))
    prior = 0.5
    for _ in range(rounds):
        p = posterior(patterns, prior, table)
        prior = float(np.clip((p * n).sum() / n.sum(), 0.01, 0.99))
        for j in range(labelers):
            for truth, q in ((0, 1 - p), (1, p)):
                seen = np.array([(q * n)[patterns[:, j] == v].sum() for v in range(3)]) + 0.5
                table[j, truth] = seen / seen.sum()
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    odds = np.log(prior / (1 - prior))
    for j in range(patterns.shape[1]):
        odds = odds + np.log(table[j, 1, patterns[:, j]] / table[j, 0, patterns[:, j]])
    return sigmoid(odds)


def fit(spans: DataFrame) -> dict:
    """The span classifier from rows of `spans` (arrays): weight by indicator, intercept under ''."""
    rows = spans.select(F.explode("spans").alias("s")).select("s.*").groupBy("kind", "digits", *_VOTES).count().collect()
    if not rows:
        return {"": 0.0}
    prior, table = reliabilities([(tuple(r[v] for v in _VOTES), r["count"]) for r in rows])
    soft = posterior(np.array([[r[v] for v in _VOTES] for r in rows]), prior, table)
    names = [f"{v}={k}" for v in _VOTES for k in (0, 2)] + [f"kind={k}" for k in KINDS] + [f"digits={k}" for k in range(4)]
    x = np.array([[float(name in _indicators(r)) for name in names] for r in rows])
    w, b = fit_logistic(x, soft, weight=np.array([r["count"] for r in rows], float), l2=1e-3)
    return {"": b} | {name: float(v) for name, v in zip(names, w)}


def _indicators(row) -> set[str]:
    return {f"{v}={row[v]}" for v in _VOTES} | {f"kind={row['kind']}", f"digits={row['digits']}"}


def decided(spans: Column, model: dict, threshold: float = 0.5) -> Column:
    """The spans that are personal data, in order: base spans, and those that the classifier
    accepts and no base span overlaps."""

    def likely(s: Column) -> Column:
        z = F.lit(float(model[""]))
        for name, w in model.items():
            if name:
                column, value = name.split("=")
                z = z + F.when(s[column].cast("string") == value, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) >= threshold

    def apart(base: Column):
        """Base spans by stretches with their range, and so whether a span overlaps none of them."""
        ks = F.sequence(F.lit(0), F.floor((F.size(base) - 1) / CHUNK).cast("int"))
        part = lambda k: F.slice(base, k * CHUNK + 1, CHUNK)
        stretch = lambda k: _let(part(k), lambda own: F.struct(
            own.alias("own"), F.array_min(own["start"]).alias("low"), F.array_max(own["end"]).alias("high"),
        ))
        return F.when(F.size(base) > 0, F.transform(ks, stretch))

    meets = lambda s, b: (s["start"] < b["end"]) & (b["start"] < s["end"])
    taken = lambda s, parts: F.exists(parts, lambda p: (s["start"] < p["high"]) & (p["low"] < s["end"]) & F.exists(p["own"], lambda b: meets(s, b)))
    base = F.filter(spans, lambda s: s["base"])
    others = F.filter(spans, lambda s: ~s["kind"].isin(*BASE) & likely(s))
    more = _let(
        F.struct(others.alias("others"), apart(base).alias("parts")),
        lambda x: F.filter(x["others"], lambda s: ~F.coalesce(taken(s, x["parts"]), F.lit(False))),
    )
    order = lambda s: F.coalesce(*[F.when(s["kind"] == k, F.lit(i)) for i, k in enumerate(KINDS)])
    entry = lambda s: F.struct(s["start"].alias("start"), order(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"))
    return F.array_sort(F.transform(F.concat(base, more), entry))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row; spans: array of (start, rank, end, kind, base), whole texts.

    A null or empty text has no spans. Rows stay as they are, also repeated ones and those
    with a null doc_id; other columns go. No rows: no result.
    """
    found = stored(texts(docs).select("doc_id", candidates(F.col("text")).alias("spans")), "pii-candidates")
    return found.select("doc_id", F.coalesce(decided(F.col("spans"), fit(found)), F.array()).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with each span of personal data replaced by its kind, as [EMAIL].

    n_chars, if there is such a column, is the new length. Overlapping spans become one.
    """
    text = F.col("text")
    mine = "_spans"
    while mine in docs.columns:
        mine += "_"
    found = stored(docs.withColumn(mine, candidates(text)), "pii-documents")
    spans = decided(F.col(mine), fit(found.select(F.col(mine).alias("spans")).filter("spans is not null")))

    def pieces(spans: Column) -> Column:
        """The text before each span and its label; a span that starts inside another joins it."""
        walked = F.aggregate(
            F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, k: F.aggregate(
                F.slice(spans, k * CHUNK + 1, CHUNK), acc,
                lambda acc, s: F.struct(
                    F.greatest(acc["at"], s["end"]).alias("at"),
                    F.when(s["start"] < acc["at"], acc["out"]).otherwise(
                        F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
                    ).alias("out"),
                ),
            ),
        )
        return _let(walked, lambda w: F.array_join(F.concat(w["out"], F.array(F.substring(text, w["at"] + 1, F.length(text)))), ""))

    clean = F.when(F.size(spans) > 0, _let(spans, pieces)).otherwise(text)
    out = found.withColumn("text", F.coalesce(clean, text)).drop(mine)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
