"""Personal data: base patterns, and further spans by weak supervision.  DataFrame functions only.

*Base spans* are e-mail addresses, IPv4 addresses, payment cards and international phone numbers, by
pattern with a check of each match.  They are always reported.

*Further spans* (secrets, IBANs, social-security numbers, local phone numbers, titled names) start as
candidates.  Regex, gazetteer and context labelers vote +1, 0 or -1 on each; expectation-maximisation
over the counts of vote patterns estimates every labeler's reliability and each pattern's posterior;
a logistic span classifier is trained on those posteriors and applied to every candidate.  It sees, beside
the votes, ``FEATURES`` of the span that no labeler looks at, so it may differ from the label model where
votes are few.  Patterns of votes and features are counted in Spark over all documents and weigh as their
count; their number is bounded (kinds, times 3 to the number of labelers, times 2 to that of features,
of which few occur), so the two small fits run on the driver.

Context is what stands up to ``LEFT`` characters before a span and one after it.

Positions are code points, end exclusive.  They come from the lengths of the pieces between matches.
Patterns take possessive groups and anchored starts, so long runs cost linear time and no stack.

Defined results.  Null reads as empty and has no spans.  Very long texts are searched whole.  Repeated
rows each get a row, rows with a null id too.  An empty table, or one without candidates, gives a
classifier that rests on the labelers' prior reliabilities.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "iban", "ssn", "localphone", "name")

_LOCAL = "A-Za-z0-9._%+-"
# What the base patterns match, written so that each start is tried once.
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Forms of the candidates.  A short last group of an IBAN that stands alone holds a digit, else it is the next word.
EXTRA_PATTERNS = {
    "secret": r"(?<=[=:]\x20?\")[0-9A-Za-z+/_.-]{16,}+(?=\")",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20?[A-Z0-9]{4}){3,7}(?:[A-Z0-9]{1,3}|\x20(?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?|(?:\x20?[A-Z0-9]{4}){2}\x20?[A-Z0-9]{3})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "localphone": r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}\p{Ll}++(?:[\x20-]\p{Lu}\p{Ll}++)*+",
}
# Words that speak for a kind when they stand before a span.
CONTEXT = {
    "secret": "token|secret|password|passwd|apikey|api_key|key|auth|credential",
    "iban": "iban|account|konto|compte|cuenta",
    "ssn": "ssn|social|security",
    "localphone": "phone|tel|call|fax|mobile|contact",
    "name": "contact|signed|patient|author|from|dear",
}
# Frequent given and family names of the corpus languages; ``votes`` takes another list as a parameter.
NAMES = (
    "Ahmed", "Alexander", "Ali", "Alvarez", "Andrea", "Andrew", "Angela", "Anna", "Anne", "Antonio", "Barbara", "Bauer", "Becker", "Bernard", "Brown",
    "Carlos", "Carmen", "Caroline", "Charles", "Christian", "Claire", "Claudia", "Daniel", "David", "Davis", "Diaz", "Dubois", "Durand", "Elena",
    "Elizabeth", "Emily", "Emma", "Fernandez", "Fischer", "Francisco", "Frank", "Garcia", "George", "Gomez", "Gonzalez", "Hans", "Harris", "Helen",
    "Hernandez", "Hoffmann", "Isabel", "Jackson", "James", "Jan", "Javier", "Jean", "Jennifer", "Johnson", "John", "Jones", "Jose", "Juan", "Julia",
    "Karl", "Klaus", "Klein", "Laura", "Laurent", "Lefebvre", "Leroy", "Lewis", "Linda", "Lopez", "Louis", "Lucas", "Luis", "Manuel", "Marc", "Maria",
    "Marie", "Mark", "Martin", "Martinez", "Mary", "Meyer", "Michael", "Michel", "Miller", "Moore", "Moreau", "Moreno", "Mueller", "Müller", "Nicolas",
    "Pablo", "Patricia", "Paul", "Pedro", "Perez", "Peter", "Petit", "Philippe", "Pierre", "Ramirez", "Richard", "Robert", "Rodriguez", "Romero", "Ruiz",
    "Sanchez", "Sarah", "Schmidt", "Schneider", "Schulz", "Simon", "Smith", "Sophie", "Stefan", "Susan", "Taylor", "Thomas", "Torres", "Wagner",
    "Walter", "Weber", "White", "William", "Williams", "Wilson", "Wolf",
)

CUMULATE = 256
NEWTON_ROUNDS, RIDGE = 60, 0.05
LEFT = 64


def _guard(kind: str, t: Column) -> Column:
    """A cheap necessary condition, so that most texts are not scanned by most patterns."""
    need = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+")), "secret": F.contains(t, F.lit('"')), "name": F.rlike(t, F.lit(r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}"))}
    return need.get(kind, F.rlike(t, F.lit("[0-9]")))


def _prefix_sums(lengths: Column) -> Column:
    """Running totals before each element, in blocks so that long arrays cost little more than their length."""
    add = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    block = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CUMULATE).cast("int")),
        lambda j: F.slice(lengths, j * CUMULATE + 1, F.lit(CUMULATE)),
    )
    sums = F.transform(block, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    starts = F.aggregate(sums, F.array(F.lit(0)), add)
    within = F.transform(block, lambda b, j: F.slice(F.aggregate(b, F.array(F.get(starts, j)), add), 1, F.size(b)))
    return F.flatten(within)


def _with_match(matches: Column):
    return lambda x, i: F.length(x) + F.coalesce(F.length(F.get(matches, i)), F.lit(0))


def _base_span(kind: str):
    span = lambda m, s: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(m)).alias("end"))
    return lambda m, s: F.when(_checked(kind, m), span(m, s))


def _candidate(kind: str):
    return lambda m, s: F.struct(
        F.lit(kind).alias("kind"),
        s.alias("start"),
        (s + F.length(m)).alias("end"),
        m.alias("value"),
        F.substring(F.col("_t"), F.greatest(s - LEFT, F.lit(0)) + 1, F.least(s, F.lit(LEFT))).alias("before"),
        F.substring(F.col("_t"), s + F.length(m) + 1, F.lit(1)).alias("after"),
    )


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def _stage_matches(d: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Adds ``m_kind`` (matches) and ``s_kind`` (their starts) for each kind."""
    t = F.col("_t")
    none = F.array().cast("array<string>")
    d = d.select("*", *[F.when(_guard(k, t), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, p in kinds.items()])
    d = d.select(
        "*",
        *[F.when(F.size(f"m_{k}") > 0, F.split(t, p, -1)).alias(f"_p_{k}") for k, p in kinds.items()],
    )
    # One length per match: the piece before it and the match before that.
    d = d.select(
        *[c for c in d.columns if not c.startswith("_p_")],
        *[F.transform(f"_p_{k}", _with_match(F.col(f"m_{k}"))).alias(f"_q_{k}") for k in kinds],
        *[F.transform(f"_p_{k}", lambda x: F.length(x)).alias(f"_p_{k}") for k in kinds],
    )
    starts = {
        k: F.when(F.size(f"m_{k}") > 0, F.zip_with(F.slice(_prefix_sums(F.col(f"_q_{k}")), 1, F.size(f"m_{k}")), F.slice(f"_p_{k}", 1, F.size(f"m_{k}")), lambda a, b: a + b))
        for k in kinds
    }
    return d.select(
        *[c for c in d.columns if not c.startswith(("_p_", "_q_"))],
        *[F.coalesce(starts[k], F.array().cast("array<int>")).alias(f"s_{k}") for k in kinds],
    )


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 1, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def _checked(kind: str, x: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(x, r"\."), lambda p: ~F.rlike(p, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))
    if kind == "card":
        d = _digits(x)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def base_spans(d: DataFrame) -> DataFrame:
    """Adds ``_base``: array of (kind, start, end), by kind as listed and start, to rows that have the text as ``_t``."""
    before = d.columns
    d = _stage_matches(d, BASE_PATTERNS)
    each = [F.filter(F.zip_with(f"m_{k}", f"s_{k}", _base_span(k)), lambda x: x.isNotNull()) for k in BASE]
    return d.select(*before, F.concat(*each).alias("_base"))


# Labelers: name, and the vote on a candidate with fields kind, value, before.
def _votes(c: Column, names: tuple[str, ...] = NAMES) -> dict[str, Column]:
    kind, value, before = c["kind"], c["value"], F.lower(c["before"])
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    mixed = F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))
    by_context = F.lit(False)
    for k, words in CONTEXT.items():
        by_context = by_context | ((kind == k) & F.rlike(before, F.lit(rf"(?:{words})[^a-z0-9]*$")))
    return {
        "shape": F.when(kind == "secret", F.when(F.rlike(value, F.lit("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")), yes).when(~mixed, no).otherwise(none))
        .when(kind == "ssn", F.when(F.rlike(value, F.lit("^(?:000|666|9)|-00-|-0000$")), no).otherwise(yes))
        .when(kind == "localphone", F.when(F.rlike(value, F.lit(r"^\(?[2-9]")), yes).otherwise(no))
        .when(kind == "iban", F.when(F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34), yes).otherwise(no))
        .otherwise(none),
        "gazetteer": F.when(kind == "name", F.when(F.rlike(value, F.lit(rf"\b(?:{'|'.join(names)})\b")), yes).otherwise(none)).otherwise(none),
        "context": F.when(by_context, yes).otherwise(none),
        "assigned": F.when((kind == "secret") & F.rlike(before, F.lit("[a-z_]\\x20?[=:]\\x20?\"$")), yes).otherwise(none),
        "variety": F.when(kind == "name", none).when(F.size(F.array_distinct(F.split(value, ""))) <= 3, no).when((kind == "secret") & mixed, yes).otherwise(none),
        "titled": F.when(kind == "name", yes).otherwise(none),
    }


LABELERS = ("shape", "gazetteer", "context", "assigned", "variety", "titled")

#: What the classifier sees of a span beside the votes.
FEATURES = ("long", "short", "digits", "upper", "separated", "varied", "several", "line_start", "colon", "closed")


def _features(c: Column) -> dict[str, Column]:
    value, before, after = c["value"], c["before"], c["after"]
    size = F.length(value)
    share = lambda pattern, k: F.length(F.regexp_replace(value, pattern, "")) * k >= size
    on = {
        "long": size >= 32,
        "short": size < 12,
        "digits": share("[^0-9]", 2),
        "upper": share("[^A-Z]", 2),
        "separated": F.rlike(value, F.lit("[\\x20.()/_-]")),
        "varied": F.size(F.array_distinct(F.split(value, ""))) >= 10,
        "several": F.size(F.split(value, "\\x20")) >= 3,
        "line_start": F.rlike(before, F.lit("(?:^|\\n)$")),
        "colon": F.rlike(before, F.lit("[:=]\\x20?\"?$")),
        "closed": F.rlike(after, F.lit("^(?:[\\s\"',.;:)]|$)")),
    }
    return {k: on[k].cast("int") for k in FEATURES}


def candidates(d: DataFrame) -> DataFrame:
    """Adds ``_cand``: array of (kind, start, end, features..., votes...) to rows that have the text as ``_t``."""
    before = d.columns
    d = _stage_matches(d, EXTRA_PATTERNS)
    raw = [F.zip_with(f"m_{k}", f"s_{k}", _candidate(k)) for k in EXTRA]
    d = d.select(*before, F.concat(*raw).alias("_raw"))
    voted = F.transform("_raw", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), *[v.alias(n) for n, v in (_features(c) | _votes(c)).items()]))
    return d.select(*before, voted.alias("_cand"))


@dataclass
class SpanModel:
    """Labeler reliabilities and the classifier's weights."""

    reliability: dict[str, tuple[float, float]] = field(default_factory=dict)
    prior: float = 0.5
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, c: Column) -> Column:
        z = F.lit(self.weights["bias"])
        for k in EXTRA:
            z = z + F.when(c["kind"] == k, self.weights[f"kind={k}"]).otherwise(0.0)
        for n in FEATURES:
            z = z + c[n] * F.lit(self.weights[n])
        for n in LABELERS:
            z = z + F.when(c[n] > 0, self.weights[f"{n}+"]).when(c[n] < 0, self.weights[f"{n}-"]).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50, weight: float = 4.0):
    """EM for the votes: P(+1 | true) and P(-1 | false) of each labeler given that it votes, with a prior of 0.8 each."""
    n = len(LABELERS)
    acc, prior, post = [(0.8, 0.8)] * n, 0.5, {}
    for _ in range(rounds):
        for votes, _count in patterns:
            yes, no = math.log(prior), math.log(1 - prior)
            for v, (p, q) in zip(votes, acc, strict=True):
                if v:
                    yes += math.log(p if v > 0 else 1 - p)
                    no += math.log(q if v < 0 else 1 - q)
            post[votes] = 1 / (1 + math.exp(min(700, no - yes)))
        total = sum(c for _, c in patterns)
        prior = min(0.95, max(0.05, (sum(c * post[v] for v, c in patterns) + weight / 2) / (total + weight)))
        acc = []
        for j in range(n):
            hit = sum(c * post[v] for v, c in patterns if v[j] > 0)
            miss = sum(c * post[v] for v, c in patterns if v[j] < 0)
            away = sum(c * (1 - post[v]) for v, c in patterns if v[j] < 0)
            wrong = sum(c * (1 - post[v]) for v, c in patterns if v[j] > 0)
            clip = lambda x: min(0.98, max(0.5, x))
            acc.append((clip((hit + 0.8 * weight) / (hit + miss + weight)), clip((away + 0.8 * weight) / (away + wrong + weight))))
    return acc, prior, post


def fit(docs: DataFrame) -> SpanModel:
    """Counts the vote patterns of all candidates, estimates reliabilities and trains the span classifier."""
    d = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    c = candidates(d).select(F.explode("_cand").alias("c"))
    counted = c.groupBy("c.kind", *[f"c.{n}" for n in (*FEATURES, *LABELERS)]).count().collect()
    by_votes: dict[tuple[int, ...], float] = {}
    rows = []
    for r in sorted(counted, key=str):
        votes = tuple(r[n] for n in LABELERS)
        by_votes[votes] = by_votes.get(votes, 0) + r["count"]
        rows.append((r["kind"], [n for n in FEATURES if r[n]], votes, r["count"]))
    # Every single vote once, so that labelers unseen here keep their prior and the classifier has all weights.
    pseudo = [tuple(s if i == j else 0 for i in range(len(LABELERS))) for j in range(len(LABELERS)) for s in (1, -1)]
    acc, prior, post = estimate(sorted(by_votes.items()) + [(p, 1.0) for p in pseudo if p not in by_votes])
    rows += [(k, [], p, 0.2) for k in EXTRA for p in pseudo]
    names = ["bias", *FEATURES] + [f"kind={k}" for k in EXTRA] + [f"{n}{s}" for n in LABELERS for s in "+-"]
    at = {n: i for i, n in enumerate(names)}
    x, y, w = [], [], []
    for kind, seen, votes, count in rows:
        f = [at["bias"], at[f"kind={kind}"]] + [at[n] for n in seen] + [at[n + ("+" if v > 0 else "-")] for n, v in zip(LABELERS, votes, strict=True) if v]
        x.append(f)
        y.append(post[votes])
        w.append(count)
    import numpy as np

    seen = np.zeros((len(x), len(names)))
    for i, f in enumerate(x):
        seen[i, f] = 1.0
    y, w, theta = np.array(y), np.array(w, float), np.zeros(len(names))
    for _ in range(NEWTON_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(seen @ theta, -30, 30)))
        slope = seen.T @ (w * (y - p)) - RIDGE * theta
        bend = seen.T @ (seen * (w * p * (1 - p))[:, None]) + RIDGE * np.eye(len(names))
        step = np.linalg.solve(bend, slope)
        theta += step / max(1.0, float(np.abs(step).max()))
    return SpanModel(dict(zip(LABELERS, acc, strict=True)), prior, dict(zip(names, theta.tolist(), strict=True)))


def find_spans(docs: DataFrame, model: SpanModel, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """``keep``, ``_t`` (the text), ``_base`` and ``_spans``: base spans and those the classifier adds beside them."""
    d = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    d = candidates(base_spans(d))
    added = F.filter("_cand", lambda c: (model.score(c) >= threshold) & ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    added = F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return d.select(*keep, "_t", "_base", F.when(F.size("_cand") > 0, F.concat("_base", added)).otherwise(F.col("_base")).alias("_spans"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans."""
    d = find_spans(docs, model or fit(docs))
    return d.select(
        "doc_id",
        *[F.size(F.filter("_base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined("_base").cast("binary"), 256).alias("base_sha256"),
        _joined("_spans").alias("spans"),
        F.size("_spans").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """The documents with each span's text replaced by its kind in brackets; ``n_chars``, if there, is counted anew.

    Of overlapping spans the one that starts first is replaced, and what the others hold beyond its end with it.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    d = find_spans(whole, model or fit(docs), ("_row",))
    d = d.select("_row", "_t", F.sort_array(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("_s"))
    # The furthest end before each span, by running maximum over the sorted spans.
    far = F.aggregate("_s", F.array(F.lit(0)), lambda acc, s: F.array_append(acc, F.greatest(F.element_at(acc, -1), s["end"])))
    d = d.select("*", far.alias("_far"))
    parts = F.transform(
        "_s",
        lambda s, i: F.concat(
            F.substring(F.col("_t"), F.get("_far", i) + 1, F.greatest(s["start"] - F.get("_far", i), F.lit(0))),
            F.when(s["start"] >= F.get("_far", i), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""),
        ),
    )
    rest = F.substring(F.col("_t"), F.element_at("_far", -1) + 1, F.length("_t"))
    text = F.when(F.size("_s") == 0, F.col("_row.text")).otherwise(F.concat(F.array_join(parts, ""), rest))
    d = d.select("_row", text.alias("_new"))
    new = {"text": F.col("_new"), "n_chars": F.when(F.col("_new").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new").cast("long")) if "n_chars" in docs.columns else None}
    return d.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
