import random
from fractions import Fraction

from tesselon.llm import mixing
from tesselon.llm.common import Scratch
from tesselon.llm.mixing import mix, mixed_documents, numbered, solve_dual, targeted, tilted_sources


def corpus():
    rnd = random.Random(3)
    texts, sources = [], []
    for s, n in (("a", 300), ("b", 120), ("c", 5), (None, 60), ("é", 40)):
        for _ in range(n):
            texts.append(" ".join(["w"] * rnd.randint(1, 80)))
            sources.append(s)
    return texts + [None, "", "  "], sources + ["a", "b", "empty"]


def capped_targets(sizes, cap=3):
    """The rule of the targets, one source at a time in exact fractions."""
    weight = {k: i % 3 + 1 for i, k in enumerate(sorted(sizes))}
    left, out, open_ = Fraction(sum(sizes.values())), {}, set(sizes)
    while open_:
        total = sum(weight[k] for k in open_)
        above = {k for k in open_ if left * weight[k] / total > cap * sizes[k]}
        if not above:
            return out | {k: left * weight[k] / total for k in open_}
        out |= {k: Fraction(cap * sizes[k]) for k in above}
        left, open_ = left - sum(cap * sizes[k] for k in above), open_ - above
    return out


def test_targets_and_rates(spark):
    rnd = random.Random(5)
    cases = [{"a": 100, "b": 10, "c": 100}, {"a": 0}, {"a": 7}, {"a": 0, "b": 1, "c": 10**12}, {f"s{i:03d}": rnd.choice([0, 1, 5, 10**6, 10**9]) for i in range(200)}]
    for sizes in cases:
        t = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(sorted(sizes.items()))], "g string, size long, rank long")
        want = capped_targets(sizes)
        for r in tilted_sources(targeted(t)).collect():
            assert abs(r.target - want[r.g]) <= 1e-9 * max(1, want[r.g]) and abs(r.rate * r["size"] - r.target) <= 1e-6 * max(1, r.target)


def test_ranks_follow_the_order_of_sources(spark, tmp_path):
    names = ["w"] + ["v" + x for x in ["", "a", "B", "é", "\U0001f600", "\uffff", "z"] + [f"s{i}" for i in range(300)]]
    df = spark.createDataFrame([(n,) for n in names], "g string").repartition(5)
    got = {r.g: r["rank"] for r in numbered(df, Scratch(spark, "t")).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_mix_meets_targets_and_repeats(make_docs):
    texts, sources = corpus()
    docs = make_docs(texts, sources).withColumnRenamed("key", "row_id").withColumnRenamed("score", "rate")
    rows = mix(docs).collect()
    assert len(rows) == len(texts)
    sums, goal, small = {}, {}, {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").split()) and 0 <= r.taken <= 3 * r.size and r.source == sources[r.doc_id]
        sums[r.source] = sums.get(r.source, 0) + r.taken
        goal[r.source] = r.target
    for s in goal:
        assert abs(sums[s] - goal[s]) <= max(2, 0.02 * goal[s]), (s, sums[s], goal[s])
    again = mix(docs).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_two_constraint_columns(spark):
    cells = spark.createDataFrame([("x", "p", 10), ("x", "q", 30), ("y", "p", 40), ("y", "q", 20)], "a string, b string, size long")
    want = {"a": {"x": 50.0, "y": 50.0}, "b": {"p": 30.0, "q": 70.0}}
    import math

    lam = solve_dual(cells, ["a", "b"], want)
    got = {}
    for r in cells.collect():
        m = r.size * math.exp(lam["a", r.a] + lam["b", r.b])
        got["a", r.a] = got.get(("a", r.a), 0) + m
        got["b", r.b] = got.get(("b", r.b), 0) + m
    assert all(abs(got[c, v] - want[c][v]) < 1e-6 for c in want for v in want[c])


def test_documents_are_repeated(make_docs):
    texts, sources = corpus()
    docs = make_docs(texts, sources)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert max(n.values()) <= 3
    assert mixed_documents(docs.filter("doc_id < 0")).count() == 0


def test_the_mix_does_not_depend_on_how_rows_lie(make_docs, monkeypatch):
    texts, sources = corpus()
    texts, sources = texts * 2, sources * 2
    seen = []
    for k, (parts, order) in enumerate(((1, 1), (3, -1), (7, 1))):
        monkeypatch.setattr(mixing, "SLICE_ROWS", (20_000, 3, 3)[k])
        docs = make_docs(texts[::order], sources[::order], list(range(len(texts) // 2)) * 2 if order > 0 else (list(range(len(texts) // 2)) * 2)[::-1], partitions=parts)
        seen.append(sorted((r.doc_id, r.taken) for r in mix(docs).collect()))
        if k:
            seen.append(seen[0])
            again = sorted((r.doc_id, r.text or "") for r in mixed_documents(docs).collect())
            assert k == 1 or again == first
            first = again
    assert all(x == seen[0] for x in seen)


def plain_copies(sizes, target, rate):
    """Copies by size: systematic sampling by a loop over a source's documents, then the best single cell, as often as it helps."""
    part, whole = rate - int(rate), int(rate)
    take, k = {}, 0
    for size in sorted(sizes, reverse=True):
        k += 1
        take[size] = take.get(size, 0) + int(k * part + 0.5) - int((k - 1) * part + 0.5)
    n = {s: sizes.count(s) for s in take}
    while True:
        gap = target - sum(s * (n[s] * whole + take[s]) for s in n)
        options = []
        for s in n:
            room = take[s] if gap < 0 else n[s] - take[s] if whole < 3 else 0
            for m in range(1, room + 1 if s and abs(gap) > 0.5 else 1):
                if abs(abs(gap) - m * s) < abs(gap) - 1e-6:
                    options.append((abs(abs(gap) - m * s), -s, m))
        if not options:
            return {s: [whole] * (n[s] - take[s]) + [whole + 1] * take[s] for s in n}
        _, s, m = min(options)
        take[-s] += m if gap > 0 else -m


def test_against_one_document_at_a_time(make_docs):
    texts, sources = corpus()
    got = {}
    for r in mix(make_docs(texts, sources)).collect():
        got.setdefault(r.source, []).append((r["size"], r.copies, r.target, r.rate))
    for rows in got.values():
        want = plain_copies([r[0] for r in rows], *rows[0][2:])
        for size, copies in want.items():
            assert sorted(c for z, c, *_ in rows if z == size) == copies


def test_odd_rows(make_docs, spark):
    """Null and empty texts, a null source, a very long text, no rows."""
    long = "word " * 300_000
    docs = make_docs([None, "", "a b", long, "c"], [None, "x", "x", "y", None])
    got = {r.doc_id: (r["size"], r.taken) for r in mix(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 0, 1: 0, 2: 2, 3: 300_000, 4: 1} and got[0][1] == got[1][1] == 0
    assert mix(docs.filter("doc_id < 0")).count() == 0


def test_sources_are_numbered_without_python_on_the_executors(spark):
    """Python rows of the driver are read back by Python workers, which stay beside the executor's heap."""
    from pyspark.sql import functions as F

    df = spark.range(40).select(F.concat(F.lit("v"), "id").alias("g"), F.col("id").alias("size"))
    ranked = numbered(df, Scratch(spark, "t"))
    assert "ExistingRDD" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["rank"], r.g) for r in ranked.collect()) == list(enumerate(sorted(f"v{i}" for i in range(40))))
    assert numbered(df.filter("size < 0"), Scratch(spark, "t")).count() == 0
