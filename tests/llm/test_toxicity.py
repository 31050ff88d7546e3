import random
import zlib

import numpy as np

from tesselon.llm import toxicity as T
from tesselon.llm.toxicity import VOTERS, LabelModel, fit_labels, spanning_tree, toxicity


def test_held_out_accuracy_and_odd_rows(make_docs, spark, odd_texts):
    rnd = random.Random(6)
    words, bad = [f"word{i}" for i in range(400)], ["vile", "awful", "nasty", "rotten"]
    texts, labels = [], []
    for i in range(900):
        w = [rnd.choice(words) for _ in range(rnd.randint(10, 60))]
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad) + rnd.choice(["", ",", "!"]))
        texts.append(" ".join(w))
        labels.append((i, 1, toxic if rnd.random() > 0.03 else 1 - toxic))
    docs = make_docs(texts + odd_texts, ids=[*range(900), *range(5000, 5000 + len(odd_texts) - 1), None])
    known = spark.createDataFrame([*labels, (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity(docs, known).collect()
    assert len(rows) == 900 + len(odd_texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    # Labels of held-out rows change nothing.
    flipped = spark.createDataFrame([(i, q, t if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)
    assert all(r.score == 0 for r in toxicity(docs, known.filter("doc_id < 0")).collect())
    assert toxicity(docs.filter("doc_id < 0"), known).count() == 0


def hidden_classes(rnd, n=4000):
    """Votes of a known process: two voters that err together, others that err alone."""
    truth, votes = [], []
    for _ in range(n):
        y = int(rnd.random() < 0.2)
        v = [0] * len(VOTERS)
        for j in range(3, 9):
            v[j] = int(rnd.random() < (0.7 if y else 0.06))
        v[0] = v[1] = int(rnd.random() < (0.5 if y else 0.25))
        v[VOTERS.index("nothing")] = 0 if any(v) else -1
        v[VOTERS.index("annotator")] = 0 if rnd.random() > 0.15 else (1 if y else -1) * (1 if rnd.random() > 0.05 else -1)
        truth.append(y)
        votes.append(tuple(v))
    return truth, votes


def loglik(model, votes):
    """One pattern and class at a time."""
    total = 0.0
    for v in votes:
        p = 0.0
        for y, w in ((0, 1 - model.prior), (1, model.prior)):
            for j, u in enumerate(model.parent):
                w *= model.table[y, j, v[u] + 1 if u >= 0 else 1, v[j] + 1]
            p += w
        total += np.log(p)
    return total


def test_label_model_learns_accuracies_and_correlations(spark):
    truth, votes = hidden_classes(random.Random(8))
    counts = sorted((v, votes.count(v)) for v in set(votes))
    table = spark.createDataFrame([(list(v), n) for v, n in counts], "votes array<int>, n long").repartition(3)
    model = fit_labels(table, 30)
    # Each round against sums by hand, with a likelihood that does not fall by more than the kept starting votes allow.
    again, seen = LabelModel(), []
    again.improve(again.expected([v for v, _ in counts], [n for _, n in counts], True))
    for _ in range(6):
        pairs = again.expected([v for v, _ in counts], [n for _, n in counts])
        post = again.posterior([v for v, _ in counts])
        want = sum(n * p for (v, n), p in zip(counts, post) if v[3] == 1 and v[5] == 1)
        assert abs(pairs[1, 3 * 3 + 2, 3 * 5 + 2] - want) < 1e-6
        again.improve(pairs)
        seen.append(loglik(again, votes))
    assert all(b > a - 1 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]
    assert model.parent[1] == 0 or model.parent[0] == 1  # the two that err together are neighbours in the tree
    assert abs(model.prior - 0.2) < 0.05
    got = model.posterior(votes) >= 0.5
    assert np.mean(got == np.array(truth)) > 0.97
    # Two voters that always agree are worth one: the second adds nothing.
    lone = model.table[1, 1, 2, 2] / model.table[0, 1, 2, 2] if model.parent[1] == 0 else model.table[1, 0, 2, 2] / model.table[0, 0, 2, 2]
    assert 0.8 < lone < 1.3


def test_spanning_tree_against_all_trees():
    import itertools

    rnd = np.random.default_rng(1)
    w = rnd.random((5, 5))
    w = w + w.T
    parent = spanning_tree(w)
    got = sum(w[k, p] for k, p in enumerate(parent) if p >= 0)

    def tree(p):  # every node reaches the root
        for k in range(4):
            seen = set()
            while k != 4:
                if k in seen:
                    return False
                seen.add(k)
                k = p[k]
        return True

    assert parent[4] == -1
    assert abs(got - max(sum(w[k, q] for k, q in enumerate(p)) for p in itertools.product(range(5), repeat=4) if tree(p))) < 1e-9


def test_repeated_rows_of_a_labelled_id_are_learned_from_once(make_docs, spark, monkeypatch):
    seen = []
    mine = T.mine_lexicon
    monkeypatch.setattr(T, "mine_lexicon", lambda s: seen.append(s.count()) or mine(s))
    n = 100_000
    one = spark.range(n).selectExpr("5L AS doc_id", "'some vile text' AS text")
    labels = spark.createDataFrame([(5, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity(one.unionByName(make_docs(["a text", "b"], ids=[6, 8]).select("doc_id", "text")), labels).count() == n + 2
    assert seen[0] <= 2


def test_a_very_long_text_counts_whole(make_docs, monkeypatch):
    import pyarrow as pa

    from tesselon.llm import common

    text = "plain words and then vile ones ! " * 3000
    batch = pa.RecordBatch.from_pydict({"text": [text]})
    look = lambda: next(T._hits([("vil-", 3.0), ("vile", 5.0)], [])([batch])).to_pylist()
    want = look()
    monkeypatch.setattr(common.pieces, "__defaults__", (100,))
    assert look() == want and (want[0]["n"], want[0]["n_words"], want[0]["exclaim"]) == ([3000, 3000], 21_000, 3000)
