"""Language-model scores from a hidden Markov model trained by Baum-Welch.

Tokens are the words of the text, lower-cased in A-Z, then one end token.  Rows whose crc32 of the id
modulo 5 is 1 are held out of all learning.

*Counts.*  Every training word is counted (tasks send partial counts; nothing is dropped).  The most
frequent, at most ``TOP_WORDS``, are a bounded table that travels to the tasks; all other words are looked up by a
join, so the vocabulary may grow without bound.

*Model.*  The chain emits symbols: the ``SYMBOLS`` most frequent words, the end token, and for other
words one of ``CLASSES`` classes by their last bytes.  Within a class a word has its smoothed share of
the class's training tokens, with room for one unseen type, so that texts get a proper probability.
Baum-Welch runs on segments of ``SEGMENT`` tokens; expected counts are summed in each task, then by
symbol across tasks.  Scores come from the scaled forward recursion over whole texts, which gives the
exact likelihood of the sequence.

Defined results.  Null and empty texts consist of the end token.  Very long texts are read in pieces and
scored as one sequence.  A null id is a training row.  Repeated rows count and are scored each.  An empty training set gives uniform scores over nothing but
the unseen type.  An empty table gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import Scratch, bounded_batches, crc_mod, lean, pieces

TOP_WORDS = 131_072
SYMBOLS = 8_192
CLASSES = 64
STATES = 8
ROUNDS = 8
SEGMENT = 256
FLUSH = 300_000
#: Counted words for which Python objects are made at once.
PART = 16_384
#: Bytes of text that are split into words at once.
RUN = 4 << 20


def words_of(texts):
    """(rows, words) for runs of a string array: the words as binary values in order, and the row of each.

    A run holds rows of about ``RUN`` bytes; longer texts come a piece of them at a time.  Arrow's ASCII white space is
    U+0020 and U+0009-U+000D.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def split(part, row):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(part))
        words, rows = lists.flatten(), np.repeat(row, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        full = pc.not_equal(pc.binary_length(words), 0)
        return rows[full.to_numpy(zero_copy_only=False)], words.filter(full).cast(pa.binary())

    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    run = np.cumsum(size, dtype=np.int64) // RUN
    i = 0
    while i < len(size):
        if size[i] > RUN:
            for part in pieces(texts[i].as_py()):
                yield split(pa.array([part], pa.string()), np.array([i]))
            i += 1
            continue
        j = i + 1
        while j < len(size) and run[j] == run[i] and size[j] <= RUN:
            j += 1
        yield split(texts.slice(i, j - i), np.arange(i, j))
        i = j


def word_class(w: bytes) -> int:
    return zlib.crc32(w[-3:]) % CLASSES


def _count(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    def summed():
        n = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
        return n.select(["word", "c_sum"]).rename_columns(["word", "c"])

    def out(n):
        for b in n.to_batches(PART):
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array([word_class(k) for k in b.column("word").to_pylist()], pa.int32()), b.column("c")], ["word", "cls", "c"])

    held: list = []
    for b in batches:
        for _, words in words_of(b.column("text")):
            n = pc.value_counts(words)
            held.append(pa.table({"word": n.field("values"), "c": n.field("counts")}))
            if sum(map(len, held)) >= FLUSH:
                held = [summed()]
                if len(held[0]) >= FLUSH:
                    yield from out(held.pop())
    if held:
        yield from out(summed())


class Vocabulary:
    """The frequent words with their counts, and the mass of each class of the rest."""

    def __init__(self, top: list[tuple[bytes, int]], class_totals: dict[int, tuple[int, int]], docs: int, total: int, distinct: int):
        self.words = [w for w, _ in top]
        self.log_c = [math.log10(c + 0.5) for _, c in top]
        self.classes = [word_class(w) for w, _ in top]
        self.symbols = min(SYMBOLS, len(top))
        # Tokens and types of each class beyond the symbols.
        rest = dict(class_totals)
        for w, c in top[: self.symbols]:
            k = word_class(w)
            t, v = rest[k]
            rest[k] = (t - c, v - 1)
        self.log_z = [math.log10(t + 0.5 * v + 0.5) for t, v in (rest.get(k, (0, 0)) for k in range(CLASSES))]
        self.end = self.symbols + CLASSES
        self.size = self.end + 1
        self.n = total + docs
        self.v = distinct + (1 if docs else 0)
        self.log_base = math.log10(self.n + 0.5 * (self.v + 1))
        self.log_end = math.log10(docs + 0.5)
        self.docs = docs


def _encode(shared):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        voc = shared.value
        table, m = pa.array(voc.words, pa.binary()), voc.symbols
        # One entry more for words beyond the table, which the last index reaches.
        log_c, cls, log_z = np.array([*voc.log_c, 0.0]), np.array([*voc.classes, 0]), np.array(voc.log_z)
        for b in batches:
            rows = len(b)
            known, base = np.full(rows, int(voc.docs > 0)), np.full(rows, voc.log_end)
            inner, z = np.zeros(rows), np.zeros(rows)
            syms, rare = [(np.arange(rows), np.full(rows, voc.end, np.uint16))], []
            for row, words in words_of(b.column("text")):
                at = pc.fill_null(pc.index_in(words, table), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                kind = cls[at]
                beyond = np.flatnonzero(at < 0)
                coded = words.take(pa.array(beyond)).dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                kind[beyond] = np.array([word_class(w) for w in coded.dictionary.to_pylist()], np.int64)[code]
                pairs, n = np.unique(row[beyond] * max(len(coded.dictionary), 1) + code, return_counts=True)
                owner, code = np.divmod(pairs, max(len(coded.dictionary), 1))
                rare.append((owner, coded.dictionary.take(pa.array(code)), n))
                mapped = (at >= m) | (at < 0)
                sums = lambda where, what: np.bincount(row[where], what, rows)  # noqa: B023, E731
                known += np.bincount(row[at >= 0], minlength=rows)
                base += sums(slice(None), log_c[at])
                inner += sums(at >= m, log_c[at[at >= m]])
                z += sums(mapped, log_z[kind[mapped]])
                syms.append((row, np.where(mapped, m + kind, at).astype(np.uint16)))
            # The end of each text comes behind its words.
            syms.append(syms.pop(0))
            owner, sym = (np.concatenate(x) for x in zip(*syms, strict=True))
            sym, n = sym[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=rows)
            cut = np.cumsum(n) - n
            sym = [sym[i : i + k].tobytes() for i, k in zip(cut.tolist(), n.tolist(), strict=True)]
            owner = np.concatenate([np.empty(0, np.int64), *[x[0] for x in rare]])
            order = np.argsort(owner, kind="stable")
            w = pa.concat_arrays([pa.array([], pa.binary()), *[x[1] for x in rare]]).take(pa.array(order))
            pairs = pa.StructArray.from_arrays([w, pa.array(np.concatenate([np.empty(0, np.int64), *[x[2] for x in rare]])[order], pa.int32())], ["w", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(inner), pa.array(z), pa.array(sym, pa.binary()), lists],
                ["rid", "doc_id", "n_tokens", "known", "base", "inner", "z", "sym", "rare"],
            )

    return run


def start_model(size: int, unigram, states: int = STATES):
    """Persistent states whose emissions are the unigram distribution, unevenly disturbed."""
    import numpy as np

    rnd = np.random.default_rng(11)
    emit = unigram[:, None] * np.exp(rnd.normal(0, 0.7, (size, states)))
    emit /= emit.sum(0)
    move = np.full((states, states), 0.03 / max(states - 1, 1))
    np.fill_diagonal(move, 0.97 if states > 1 else 1.0)
    return np.full(states, 1 / states), move, emit


def _packed(seqs):
    """Sequences in order of falling length: their symbols step by step, how many last beyond each step, where steps begin, order."""
    import numpy as np

    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    active = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
    begin = np.cumsum(active) - active
    flat = np.empty(size.sum(), np.int64)
    at = np.repeat(np.arange(len(size)), size)
    flat[begin[np.arange(len(flat)) - (np.cumsum(size) - size)[at]] + at] = np.concatenate([seqs[i] for i in order])
    return flat, active.tolist(), begin.tolist(), order


def forward(seqs, start, move, emit):
    """log10 likelihood of each sequence by the scaled forward recursion."""
    import numpy as np

    out = np.zeros(len(seqs))
    if not len(seqs):
        return out
    flat, active, begin, order = _packed(seqs)
    total = np.zeros(len(seqs))
    # A row a state: what is done to a step's sequences runs along them.
    turn, emit = np.ascontiguousarray(move.T), np.ascontiguousarray(emit.T)
    alpha = None
    for t, n in enumerate(active):
        e = emit.take(flat[begin[t] : begin[t] + n], axis=1)
        e *= start[:, None] if t == 0 else turn @ alpha[:, :n]
        s = e.sum(0)
        e /= s
        alpha = e
        total[:n] += np.log10(s)
    out[order] = total
    return out


def expected_counts(seqs, start, move, emit):
    """Baum-Welch E-step: expected starts, moves and emissions, and the natural log likelihood."""
    import numpy as np

    k = len(start)
    starts, moves, emissions, ll = np.zeros(k), np.zeros((k, k)), np.zeros(emit.shape), 0.0
    if not len(seqs):
        return starts, moves, emissions, ll
    flat, active, begin, _ = _packed(seqs)
    turn = np.ascontiguousarray(move.T)
    # A row a state: what is done to a step's sequences runs along them.
    e = np.ascontiguousarray(emit.T).take(flat, axis=1)
    alpha, scale = np.empty_like(e), np.empty(len(flat), e.dtype)
    last = None
    for n, i in zip(active, begin, strict=True):
        a = alpha[:, i : i + n]
        np.multiply(start[:, None] if last is None else turn @ last[:, :n], e[:, i : i + n], out=a)
        s = a.sum(0)
        a /= s
        scale[i : i + n] = s
        last = a
    ll = float(np.log(scale).sum(dtype=float))
    e /= scale
    beta = np.ones((k, active[-1]), emit.dtype)
    for t in range(len(active) - 1, -1, -1):
        n, i = active[t], begin[t]
        if t:
            m, j = active[t - 1], begin[t - 1]
            w = e[:, i : i + n]
            w *= beta
            moves += alpha[:, j : j + n] @ w.T
            # Of a step that is done the state probabilities are kept in place.
            alpha[:, i : i + n] *= beta
            beta = np.ones((k, m), emit.dtype)
            np.matmul(move, w, out=beta[:, :n])
        else:
            alpha[:, :n] *= beta
    moves *= move
    starts = alpha[:, : active[0]].sum(1)
    for j in range(k):
        emissions[:, j] = np.bincount(flat, alpha[j], len(emit))
    return starts, moves, emissions, ll


def _e_step(shared):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        # Single precision does for expected counts, which are summed in double; scores are computed in double.
        start, move, emit = (x.astype(np.float32) for x in shared.value)
        k = len(start)
        total = np.zeros((len(emit) + k + 2, k))
        for b in batches:
            segs = []
            for x in b.column("sym"):
                s = np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64)
                segs += [s[i : i + SEGMENT] for i in range(0, len(s), SEGMENT)]
            for i in range(0, len(segs), 2048):
                a, m, e, ll = expected_counts(segs[i : i + 2048], start, move, emit)
                total[: len(emit)] += e
                total[len(emit) : len(emit) + k] += m
                total[-2] += a
                total[-1, 0] += ll
        rows = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32())] + [pa.array(total[rows, j]) for j in range(k)], ["i", *[f"k{j}" for j in range(k)]])

    return run


def _forward(shared, kind: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        start, move, emit = shared.value
        names = ["rid", "doc_id", "n_tokens", "known", "base", "inner", "z"]
        for b in batches:
            ll = forward([np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64) for x in b.column("sym")], start, move, emit)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(ll)], [*names, "ll"])

    return run, f"rid long, doc_id {kind}, n_tokens long, known long, base double, inner double, z double, ll double"


def train(encoded: DataFrame, size: int, unigram, states: int = STATES, rounds: int = ROUNDS):
    """Baum-Welch over the symbol sequences in ``sym``: (start, move, emit) and the log likelihood of each round."""
    import numpy as np

    sc = encoded.sparkSession.sparkContext
    model = start_model(size, unigram, states)
    trace = []
    schema = "i int, " + ", ".join(f"k{j} double" for j in range(states))
    for _ in range(rounds):
        shared = sc.broadcast(model)
        rows = encoded.select("sym").mapInArrow(lean(_e_step(shared)), schema).groupBy("i").agg(*[F.sum(f"k{j}").alias(f"k{j}") for j in range(states)]).toPandas()
        total = np.zeros((size + states + 2, states))
        total[rows["i"]] = rows.drop(columns="i")
        emit = total[:size] + 20.0 * unigram[:, None]
        move = total[size : size + states] + 1.0 + 20.0 * np.eye(states)
        start = total[-2] + 1.0
        model = start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)
        trace.append(float(total[-1, 0]))
        shared.unpersist()
    return model, trace


def _steps():
    """Counts on a logarithmic scale, fine enough to keep small ones apart."""
    return F.floor(F.log2("c") * 256)


def _cut(counts: DataFrame) -> int:
    """The step above which at most ``TOP_WORDS`` words lie; found from a histogram of bounded size, not by sorting."""
    room = TOP_WORDS
    for r in sorted(counts.groupBy(_steps().alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["s"]):
        room -= r["n"]
        if room < 0:
            return r["s"]
    return -1


def language_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    import numpy as np

    spark = docs.sparkSession
    sc = spark.sparkContext
    scratch = Scratch(spark, "hmm")
    bounded_batches(spark)
    held = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    train_docs = docs.filter(~held)

    counts = train_docs.select("text").mapInArrow(lean(_count), "word binary, cls int, c long")
    counts = scratch.write(counts.groupBy("word").agg(F.first("cls").alias("cls"), F.sum("c").alias("c")), "counts")
    per_class = counts.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    n_docs = train_docs.count()
    cut = _cut(counts)
    top = [(bytes(r["word"]), r["c"]) for r in counts.filter(_steps() > cut).select("word", "c").collect()]
    top.sort(key=lambda x: (-x[1], x[0]))
    voc = Vocabulary(top, {r["cls"]: (r["c"], r["v"]) for r in per_class}, n_docs, sum(r["c"] for r in per_class), sum(r["v"] for r in per_class))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"rid long, doc_id {kind}, n_tokens long, known long, base double, inner double, z double, sym binary, rare array<struct<w:binary,n:int>>"
    shared = sc.broadcast(voc)
    encoded = scratch.write(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(lean(_encode(shared)), schema), "encoded")
    shared.unpersist()

    # Words beyond the table: one row per document and word, looked up by a join.
    rare = encoded.select("rid", F.explode("rare").alias("x")).select("rid", "x.w", "x.n")
    low = counts.select(F.col("word").alias("w"), "c")
    low = low.filter(_steps() <= cut)
    seen = rare.join(low, "w", "left").groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("beyond"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("found")
    )

    unigram = np.full(voc.size, 0.5)
    for i, (_, c) in enumerate(top[: voc.symbols]):
        unigram[i] += c
    for k in range(CLASSES):
        unigram[voc.symbols + k] = 10 ** voc.log_z[k]
    unigram[voc.end] += n_docs
    unigram /= unigram.sum()
    model, _ = train(encoded.filter(~held), voc.size, unigram, states, rounds)
    run, schema = _forward(sc.broadcast(model), kind)
    scored = encoded.select("rid", "doc_id", "n_tokens", "known", "base", "inner", "z", "sym").mapInArrow(lean(run), schema)
    out = scored.join(seen, "rid", "left").withColumn("beyond", F.coalesce("beyond", F.lit(0.0)))
    return out.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(voc.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("beyond") - F.col("n_tokens") * F.lit(voc.log_base)).alias("base_score"),
        (F.col("ll") + F.col("inner") + F.col("beyond") - F.col("z")).alias("score"),
    )
