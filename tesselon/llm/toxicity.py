"""Toxicity by weak supervision.

1. *Lexicons.*  Words and word prefixes that occur mostly in toxic documents are mined from at most
   ``MAX_LABELLED`` labelled training documents, one row an id and one of near copies; a fixed list of insults is a lexicon of its own.
2. One pass over all texts counts each document's lexicon hits and its shouted, masked and exclaimed words.
3. *Voters* vote toxic, clean or abstain: tiers of the mined lexicons by weight of evidence, the fixed list,
   patterns of density, variety, shouting, masking and exclamation, absence of all of these, and the
   annotators of the sample.  A generative label model is fitted to the vote patterns of all training
   rows by expectation-maximisation.  Within each class votes form a tree: each voter has an accuracy
   table given the vote of the voter it is most correlated with, and the tree of greatest conditional
   mutual information is found anew in each round, so every step raises the expected likelihood.  The
   first round believes the annotators, later ones all rows.
4. A linear classifier is trained on the posterior labels of the same bounded sample and scores every
   document from its hits, their density and its patterns.

Rows whose crc32 of the id modulo 3 is 1 are held out of every step that learns.  Each round of the label
model sums its expected pair counts on the executors; the driver sees ``2 * (3 * voters) ** 2`` numbers.
The classifier's rows are at most ``MAX_LABELLED``, and a term of the lexicon stands in ``MIN_TOXIC`` of
these rows at least, so both are bounded by that parameter; nothing else is capped.

Defined results.  Null and empty texts have no hits and get the score of a text without hits, a number
between 0 and 1.  Very long texts count whole, in pieces.  A null id is not held out and never labelled.
Repeated rows each get a row; of rows with a labelled id the one with the least hash of its text is learned
from.  An id with two labels is toxic if one of them says so.  Without labels of both kinds no lexicon
exists and every score is 0.  An empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import Scratch, bounded_batches, crc_mod, pieces

MAX_LABELLED = 40_000
MIN_TOXIC = 6
MIN_WEIGHT = 2.0
#: Weights of evidence at which a tier of the lexicon ends.
TIERS = (3.0, 4.5)
PREFIXES = (3, 4, 5, 6, 7)
CACHE = 200_000
ROUNDS = 12
_STRIP = ".,;:!?\"'()[]{}|#*$%&<>-_=+~`/\\"
_MASKED = re.compile(r"[^\W\d_]+[*@$#!]+[^\W\d_]+")
# Plain insults of the corpus languages.
INSULTS = frozenset((
    "abschaum", "arschloch", "basura", "connard", "crétin", "dummkopf", "estúpido", "idiot", "idiota", "idiote", "idiots", "imbecile", "imbécil",
    "imbécile", "loser", "moron", "morons", "pathetic", "scum", "stupid", "stupide", "trash", "trottel", "vermin", "worthless",
))


def words(text: str | None) -> set[str]:
    return {w for part in pieces(text or "") for w in (x.strip(_STRIP) for x in part.lower().split()) if w}


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


def _term_counts(batches):
    """Partial counts per batch: toxic and clean documents with the term."""
    import pyarrow as pa

    for b in batches:
        count = (Counter(), Counter())
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            count[toxic].update({t for w in words(text) for t in terms_of(w)})
        for toxic, n in enumerate(count):
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic] * len(keys), pa.int32()), pa.array([n[k] for k in keys], pa.int64())], ["term", "toxic", "n"])


def _fingerprints(batches):
    """Adds the least hash of each text's shingles, which near copies mostly share."""
    import numpy as np
    import pyarrow as pa

    from tesselon.llm import shingles as S

    for b in batches:
        least = [int(S.mix64(x).min().view(np.int64)) if len(x) else None for x in S.shingle_sets(b.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], [*b.schema.names, "print"])


def mine_lexicon(sample: DataFrame) -> list[tuple[str, float]]:
    """Terms by weight of evidence: the smoothed log ratio of their rates in toxic and clean documents of the sample."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    side = lambda y: F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col("n"))), F.lit(0))
    counts = sample.select("text", "toxic").mapInArrow(_term_counts, "term string, toxic int, n long").groupBy("term").agg(side(1).alias("bad"), side(0).alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (n1 + 1)) - F.log((F.col("good") + 0.5) / (n0 + 1))
    found = counts.filter(F.col("bad") >= MIN_TOXIC).select("term", F.round(weight, 9).alias("w")).filter(F.col("w") >= MIN_WEIGHT)
    return sorted((r["term"], r["w"]) for r in found.collect())


HITS = "n_words long, t array<int>, n array<int>, insult int, shout int, masked int, exclaim int"


def _hits(lexicon: list[tuple[str, float]], carried: list[str]):
    def run(batches):
        import pyarrow as pa

        at = {t: i for i, (t, _) in enumerate(lexicon)}
        cache: dict[str, tuple] = {}
        get = cache.get
        # Every prefix has three letters at least, so a word's start rules most words out.
        heads = {t.rstrip("-")[:3] for t in at} | {w[:3] for w in INSULTS}

        def look(raw: str) -> tuple:
            """Terms and marks of a word; empty for the many words that have neither."""
            plain = raw.isalpha()
            low = raw.lower() if plain else raw.lower().strip(_STRIP)
            shout, masked = len(low) > 2 and raw.isupper(), not plain and _MASKED.search(raw) is not None
            if low[:3] not in heads and not shout and not masked:
                return ()
            return tuple(at[t] for t in terms_of(low) if t in at) if low else (), (int(low in INSULTS), int(shout), int(masked))

        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in b.column("text").to_pylist():
                size, exclaim, marks, hits = 0, 0, [0, 0, 0], Counter()
                for part in pieces(text or ""):
                    tokens = part.split()
                    size += len(tokens)
                    exclaim += part.count("!")
                    for raw in tokens:
                        f = get(raw)
                        if f is None:
                            if len(cache) >= CACHE:
                                cache.clear()
                            f = cache[raw] = look(raw)
                        if f:
                            for i in f[0]:
                                hits[i] += 1
                            marks = [m + x for m, x in zip(marks, f[1])]
                found = sorted(hits.items())
                for c, v in zip(cols, (size, [i for i, _ in found], [n for _, n in found], *marks, exclaim), strict=True):
                    c.append(v)
            ints = pa.list_(pa.int32())
            kinds = [pa.int64(), ints, ints, *[pa.int32()] * 4]
            names = ["n_words", "t", "n", "insult", "shout", "masked", "exclaim"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in carried] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], carried + names)

    return run


# A vote is 1 (toxic), -1 (clean) or 0 (abstains).
VOTERS = (
    "strong words", "words", "weak words", "strong prefixes", "prefixes", "weak prefixes", "insults",
    "many", "dense", "varied", "shouting", "masked", "exclaimed", "nothing", "thin", "quiet", "annotator",
)


def votes_of(lexicon: list[tuple[str, float]], h: dict, label: int | None = None) -> tuple[int, ...]:
    """Votes on one document, given its hits and marks; the annotator's is its label where it is in the labelled sample."""
    tier = [[0, 0, 0], [0, 0, 0]]
    kinds = 0
    for i, k in zip(h["t"], h["n"], strict=True):
        t, w = lexicon[i]
        prefix = t.endswith("-")
        tier[prefix][(w < TIERS[0]) + (w < TIERS[1])] += k
        kinds += not prefix
    size, nw = h["n_words"], sum(tier[0])
    marks = h["insult"] + h["masked"]
    return (
        *(int(x > 0) for x in tier[0]),
        *(int(x > 1) for x in tier[1]),
        int(h["insult"] > 0),
        int(nw >= 3),
        int(nw >= 0.01 * max(size, 1)),
        int(kinds >= 2),
        int(10 * h["shout"] >= max(size, 20)),
        int(h["masked"] > 0),
        int(20 * h["exclaim"] >= max(size, 20)),
        -1 if nw + marks == 0 else 0,
        -1 if nw + sum(tier[1]) + marks <= max(1, size // 200) else 0,
        -1 if h["shout"] + h["exclaim"] + marks == 0 else 0,
        0 if label is None else 2 * label - 1,
    )


#: Starting accuracies: P(vote -1, 0, 1) in clean and in toxic documents.
_START = {"annotator": ((0.28, 0.7, 0.02), (0.02, 0.7, 0.28)), "nothing": ((0.9, 0.1, 0.0), (0.2, 0.8, 0.0)), "thin": ((0.9, 0.1, 0.0), (0.2, 0.8, 0.0))}
_START |= dict.fromkeys(("shouting", "masked", "exclaimed"), ((0.0, 0.95, 0.05), (0.0, 0.9, 0.1))) | {"quiet": ((0.6, 0.4, 0.0), (0.5, 0.5, 0.0))}
_OTHER = ((0.0, 0.95, 0.05), (0.0, 0.6, 0.4))


class LabelModel:
    """Votes within a class form a tree; ``table[y, j, u, v]`` is P(voter j votes v | class y, its parent votes u)."""

    #: Weight of a voter's starting accuracy, and of its accuracy for each vote of its parent, in votes.
    KEPT = 5.0
    TRUST = 0.95

    def __init__(self, prior: float = 0.1):
        import numpy as np

        start = np.array([[_START.get(v, _OTHER)[y] for v in VOTERS] for y in (0, 1)]) + 1e-4
        self.start = start / start.sum(2, keepdims=True)
        self.prior, self.parent = prior, [-1] * len(VOTERS)
        self.table = np.repeat(self.start[:, :, None, :], 3, axis=2)

    def posterior(self, votes):
        """P(toxic) of each row of votes."""
        import numpy as np

        votes = np.atleast_2d(np.asarray(votes)) + 1
        z = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for j, p in enumerate(self.parent):
            u = votes[:, p] if p >= 0 else 1
            z += np.log(self.table[1, j, u, votes[:, j]]) - np.log(self.table[0, j, u, votes[:, j]])
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def expected(self, votes, n, annotated: bool = False):
        """Expected counts of pairs of votes in each class: an array of (2, 3 * voters, 3 * voters).

        ``annotated`` takes rows with an annotator's vote only and believes it by ``TRUST``, which is where the fit starts.
        """
        import numpy as np

        votes, n = np.asarray(votes), np.asarray(n, float)
        post = self.posterior(votes)
        if annotated:
            said = votes[:, VOTERS.index("annotator")]
            n, post = n * (said != 0), np.where(said > 0, self.TRUST, 1 - self.TRUST)
        hot = np.zeros((len(votes), len(VOTERS), 3))
        np.put_along_axis(hot, votes[:, :, None] + 1, 1.0, axis=2)
        hot = hot.reshape(len(votes), -1)
        return np.stack([hot.T @ (hot * (n * w)[:, None]) for w in (1 - post, post)])

    def improve(self, pairs) -> None:
        """The tree and tables of greatest expected likelihood for these expected counts."""
        import numpy as np

        j = len(VOTERS)
        joint = pairs.reshape(2, j, 3, j, 3).transpose(0, 1, 3, 2, 4)
        mass = joint[:, 0, 0].sum((1, 2))
        self.prior = float(min(0.5, max(0.01, (mass[1] + 1) / (mass.sum() + 10))))
        single = np.stack([np.diagonal(pairs[y]).reshape(j, 3) for y in (0, 1)])
        single = (single + self.KEPT * self.start) / (mass[:, None, None] + self.KEPT)
        # Conditional mutual information of each pair of voters given the class.
        share = joint / np.maximum(mass, 1e-9)[:, None, None, None, None]
        free = share.sum(4, keepdims=True) * share.sum(3, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            info = np.where(share > 0, share * np.log(share / free), 0.0).sum((3, 4))
        info = (info * mass[:, None, None]).sum(0) / max(mass.sum(), 1e-9)
        self.parent = spanning_tree(info)
        for k, p in enumerate(self.parent):
            if p < 0:
                self.table[:, k] = single[:, k, None, :]
            else:
                pair = joint[:, p, k]
                self.table[:, k] = (pair + self.KEPT * single[:, k, None, :]) / (pair.sum(2, keepdims=True) + self.KEPT)


def spanning_tree(weight) -> list[int]:
    """Parents in the spanning tree of greatest total weight, rooted at the last node."""
    import numpy as np

    n = len(weight)
    parent, best = [-1] * n, np.full(n, n - 1)
    gain = np.array(weight[n - 1], float)
    open_ = np.ones(n, bool)
    open_[n - 1] = False
    while open_.any():
        k = int(np.where(open_, gain, -np.inf).argmax())
        parent[k], open_[k] = int(best[k]), False
        better = open_ & (weight[k] > gain)
        gain[better], best[better] = weight[k][better], k
    return parent


def fit_labels(patterns: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """EM over (votes, n); the expected counts of a round are summed on the executors."""
    import numpy as np

    model = LabelModel()
    size = 2 * (3 * len(VOTERS)) ** 2

    def stats(annotated):
        def run(batches):
            import pyarrow as pa

            total = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    total += model.expected(np.array(b.column("votes").to_pylist()), b.column("n").to_numpy(), annotated).ravel()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["i", "x"])

        return run

    for k in range(rounds):
        sums = patterns.mapInArrow(stats(k == 0), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        if not sums:
            continue
        pairs = np.zeros(size)
        for r in sums:
            pairs[r["i"]] = round(r["x"], 6)  # sums arrive in any order
        old = model.prior
        model.improve(pairs.reshape(2, 3 * len(VOTERS), -1))
        if k and abs(model.prior - old) < 1e-6:
            break
    return model


def features(lexicon, h: dict) -> dict[int, float]:
    """Sparse features: each term's presence, then log counts, densities and variety of word and prefix hits, and the marks."""
    k = len(lexicon)
    x = {k: 1.0}
    total, kinds, weight = [0, 0], [0, 0], 0.0
    for i, c in zip(h["t"], h["n"], strict=True):
        t, w = lexicon[i]
        p = int(t.endswith("-"))
        total[p] += c
        kinds[p] += 1
        weight += w * c
        x[i] = 0.5
    n = max(h["n_words"], 10)
    for p in (0, 1):
        x[k + 1 + p] = math.log1p(total[p])
        x[k + 3 + p] = min(1.0, 20 * total[p] / n)
        x[k + 5 + p] = math.log1p(kinds[p])
    x[k + 7] = min(2.0, 5 * weight / n)
    x[k + 8] = math.log(n) / 10
    for i, m in enumerate(("insult", "shout", "masked", "exclaim")):
        x[k + 9 + i] = min(1.0, 10 * h[m] / n)
    return x


EXTRA = 13


def train_linear(rows: list[dict[int, float]], target: list[float], size: int, rounds: int = 300, l2: float = 1e-4):
    """Logistic regression on soft targets by full-batch gradient steps with momentum, over a bounded number of rows."""
    import numpy as np

    if not rows:
        return np.zeros(size)
    col = np.array([i for r in rows for i in r], np.int64)
    val = np.array([v for r in rows for v in r.values()])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    y, w, m = np.array(target), np.zeros(size), np.zeros(size)
    for _ in range(rounds):
        z = np.bincount(row, val * w[col], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(col, val * (p - y)[row], size) / len(rows) + l2 * w
        m = 0.9 * m + g
        w -= 1.0 * m
    return w


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    import numpy as np

    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    bounded_batches(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()

    known = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(~held)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most MAX_LABELLED rows of two integers: this table has a bound and may be broadcast.
    known = scratch.write(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED), "known")
    # One row an id, so repeated documents of a labelled id add none.
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    sample = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(one.alias("d")).select("doc_id", "toxic", "d.text")
    sample = sample.mapInArrow(_fingerprints, f"doc_id {kind}, toxic int, text string, print long")
    # Near copies teach once: chance words of a document with many copies would look like evidence.
    sample = sample.groupBy("print", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("d"))
    sample = scratch.write(sample.select("d.doc_id", "toxic", "d.text"), "sample")
    lexicon = mine_lexicon(sample)

    hits = scratch.write(docs.mapInArrow(_hits(lexicon, ["doc_id"]), f"doc_id {kind}, {HITS}"), "hits")
    fields = [c.split()[0] for c in HITS.split(", ")]

    def ballots(batches):
        import pyarrow as pa

        for b in batches:
            n = Counter(votes_of(lexicon, h, h["toxic"]) for h in b.to_pylist())
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in keys], pa.list_(pa.int32())), pa.array([n[k] for k in keys], pa.int64())], ["votes", "n"])

    training = hits.filter(~held).join(F.broadcast(known), "doc_id", "left").select(*fields, "toxic")
    patterns = training.mapInArrow(ballots, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    model = fit_labels(scratch.write(patterns, "patterns")) if lexicon else LabelModel()

    weights: list[float] = []
    if lexicon:
        rows = sample.mapInArrow(_hits(lexicon, ["doc_id", "toxic"]), f"doc_id {kind}, toxic int, {HITS}").toArrow().to_pylist()
        rows.sort(key=lambda r: r["doc_id"])
        x = [features(lexicon, r) for r in rows]
        y = model.posterior([votes_of(lexicon, r, r["toxic"]) for r in rows]) if rows else np.empty(0)
        weights = train_linear(x, y, len(lexicon) + EXTRA).tolist()

    def score(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for h in b.to_pylist():
                z = sum(weights[i] * v for i, v in features(lexicon, h).items()) if lexicon else -math.inf
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if lexicon else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    scratch.keep_only(hits)
    scored = hits.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
