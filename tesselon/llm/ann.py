"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors are one node, with the few smallest ids that could appear in a result.  Nodes are dealt
to shards of about ``shard_rows`` by hash.  In each shard points are inserted in growing batches: a
greedy beam search of the graph so far proposes neighbours, pruning keeps a proposal only if no kept
neighbour is closer to it by the factor ``ALPHA`` (relaxed distance pruning, which keeps long,
diverse edges), and reverse edges are added under the same rule.  Queries, in blocks, are answered by
a beam search of every shard; scores are cosines in double precision on the original vectors.

Every vector is indexed.  No task holds more than a shard with its graph and a block of queries; long
vectors make shards and blocks larger in proportion and are compared whole.

Defined results.  Vectors that are null, empty, all zero, or hold a null, NaN or infinite component take
no part, nor do rows with a null id; a query that takes no part has no rows.  Only vectors of equal
length are compared.  Ties go to the smaller id.  Repeated rows count once.  An empty table gives an
empty result.  Only the id and the vector column are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselon.llm.common import Scratch, bounded_batches

SHARD_ROWS = 16_384
QUERY_ROWS = 512
DEGREE, SLACK = 32, 2
BUILD_BEAM, QUERY_BEAM = 32, 160
ALPHA = 1.2
EXPAND = 4
BATCH = 512
MARKS = 1 << 24


def beam_search(x, graph, entry: int, q, beam: int):
    """Ids and squared distances of the ``beam`` nearest nodes that a greedy search finds, per row of ``q``; -1 pads.

    ``graph`` has one row more than ``x``, all -1, which is what a padding id reads.
    """
    import numpy as np

    n, b = len(x), len(q)
    # The marks of what was met take two bytes a row and node.
    if b > 1 and b * n > MARKS:
        parts = [beam_search(x, graph, entry, p, beam) for p in np.array_split(q, min(b, -(-b * n // MARKS)))]
        return tuple(np.concatenate(z) for z in zip(*parts, strict=True))
    ids = np.full((b, beam), -1, np.int32)
    dist = np.full((b, beam), np.inf, np.float32)
    todo = np.full((b, beam), np.inf, np.float32)  # the distance of what is not yet expanded
    seen = np.zeros((b, n), np.int16)
    ids[:, 0], seen[:, entry] = entry, 1
    dist[:, 0] = todo[:, 0] = 2 - 2 * (q @ x[entry])
    expand = min(EXPAND, beam)
    mark = np.arange(1, graph.shape[1] * expand + 1, dtype=np.int16)
    act = np.arange(b)
    while True:
        near = todo[act]
        order = np.argpartition(near, expand - 1, axis=1)[:, :expand]
        live = np.isfinite(np.take_along_axis(near, order, 1))
        some = live.any(1)
        act, order, live = act[some], order[some], live[some]
        if not len(act):
            return ids, dist
        r = act[:, None]
        nb = graph[np.where(live, ids[r, order], -1)].reshape(len(act), -1)
        todo[r, order] = np.inf
        row, col = np.nonzero((nb >= 0) & (seen[r, nb] == 0))
        found = nb[row, col]
        # A neighbour met twice in one step counts once: the place whose mark stayed.
        seen[act[row], found] = mark[col]
        first = seen[act[row], found] == mark[col]
        row, found = row[first], found[first]
        d = 2 - 2 * np.einsum("nd,nd->n", x[found], q[act[row]])
        count = np.bincount(row, minlength=len(act))
        col = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        new_d, new_i = np.full((len(act), int(count.max(initial=0))), np.inf, np.float32), np.full((len(act), int(count.max(initial=0))), -1, np.int32)
        new_d[row, col], new_i[row, col] = d, found
        all_d = np.concatenate([dist[act], new_d], 1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[act] = np.take_along_axis(all_d, best, 1)
        ids[act] = np.take_along_axis(np.concatenate([ids[act], new_i], 1), best, 1)
        todo[act] = np.take_along_axis(np.concatenate([todo[act], new_d], 1), best, 1)


def robust_prune(x, points, cand, degree: int, alpha: float):
    """At most ``degree`` diverse neighbours of each point out of its candidates (-1 pads), nearest first."""
    import numpy as np

    cand = np.where(cand == points[:, None], -1, cand)
    d = np.where(cand >= 0, 2 - 2 * np.matmul(x[cand], x[points][:, :, None])[:, :, 0], np.inf)
    order = np.argsort(d, 1, kind="stable")
    d, cand = np.take_along_axis(d, order, 1), np.take_along_axis(cand, order, 1)
    v = x[cand]
    # Squared distances, so the factor is squared too.
    between = (2 - 2 * np.matmul(v, v.transpose(0, 2, 1))) * np.float32(alpha * alpha)
    alive, count = np.isfinite(d), np.zeros(len(cand), np.int64)
    out = np.full((len(cand), degree), -1, np.int32)
    for j in range(cand.shape[1]):
        rows = np.flatnonzero(alive[:, j] & (count < degree))
        out[rows, count[rows]] = cand[rows, j]
        count[rows] += 1
        alive[rows] &= between[rows, j] > d[rows]
    return out


def build_graph(x, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
    """(graph, entry) over unit vectors ``x``; a node has room for ``SLACK * degree`` edges and is pruned when that is full."""
    import numpy as np

    n, room = len(x), SLACK * degree
    graph, have = np.full((n + 1, room), -1, np.int32), np.zeros(n, np.int64)
    entry = int((x @ x.mean(0)).argmax())
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done = 1
    while done < n:
        batch = order[done : done + min(BATCH, max(1, done))]
        cand, _ = beam_search(x, graph, entry, x[batch], beam)
        new = robust_prune(x, batch, cand, degree, alpha)
        graph[batch, :degree], have[batch] = new, (new >= 0).sum(1)
        done += len(batch)
        # Reverse edges, grouped by the node that gains them.
        to, src = new.ravel(), np.repeat(batch, degree)
        src, to = src[to >= 0], to[to >= 0]
        at = np.argsort(to, kind="stable")
        to, src = to[at], src[at]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count) + np.repeat(have[nodes], count)
        total = have[nodes] + count
        fits = np.repeat(total <= room, count)
        graph[to[fits], place[fits]] = src[fits]
        have[nodes] = np.where(total <= room, total, have[nodes])
        full = np.flatnonzero(total > room)
        for s in range(0, len(full), BATCH):
            part = full[s : s + BATCH]
            pool = np.full((len(part), int(total[part].max())), -1, np.int32)
            pool[:, :room] = graph[nodes[part]]
            slot = np.full(len(nodes), -1)
            slot[part] = np.arange(len(part))
            slot = np.repeat(slot, count)
            pool[slot[slot >= 0], place[slot >= 0]] = src[slot >= 0]
            kept = robust_prune(x, nodes[part], pool, degree, alpha)
            graph[nodes[part]] = -1
            graph[nodes[part], :degree], have[nodes[part]] = kept, (kept >= 0).sum(1)
    return graph, entry


def _unit(v):
    import numpy as np

    # Scaled by the largest component first, so that no square overflows or vanishes.
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def _build(pdf):
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values("node")
    v = np.stack([np.asarray(e, np.float64) for e in pdf["emb"]])
    graph, entry = build_graph(_unit(v))
    ids = np.full((len(v), max(map(len, pdf["ids"]))), -1, np.int64)
    mark = np.zeros(ids.shape, bool)
    for i, x in enumerate(pdf["ids"]):
        ids[i, : len(x)], mark[i, : len(x)] = x, True
    blob = lambda a: np.ascontiguousarray(a).tobytes()
    row = (int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), entry, ids.shape[1], blob(v), blob(graph.astype(np.int32)), blob(ids), blob(mark))
    return pd.DataFrame([row], columns=["dim", "shard", "entry", "width", "vectors", "graph", "ids", "mark"])


class Shard:
    """A shard's graph as a task holds it while query blocks stream by."""

    def __init__(self, row: dict):
        import numpy as np

        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        self.unit = _unit(self.vectors)
        self.graph = np.frombuffer(row["graph"], np.int32).reshape(len(self.vectors) + 1, -1)
        self.ids = np.frombuffer(row["ids"], np.int64).reshape(-1, row["width"])
        self.mark = np.frombuffer(row["mark"], bool).reshape(-1, row["width"])
        self.entry = row["entry"]

    def answer(self, qid, qv, k: int):
        """(query, id, cosine) of up to ``k`` nearest ids of each query found here."""
        import numpy as np

        # The query's own node may hold no other id: one node more than the result.
        found, _ = beam_search(self.unit, self.graph, self.entry, _unit(qv), min(max(QUERY_BEAM, k + 1), len(self.vectors)))
        score = np.where(found >= 0, _cosine(qv, self.vectors[found]), -np.inf)
        top = np.argsort(-score, axis=1, kind="stable")[:, : 4 * (k + 1)]
        for r in range(len(qv)):
            node = found[r, top[r]]
            hits = [(-s, int(x)) for s, j in zip(score[r, top[r]].tolist(), node.tolist(), strict=True) if j >= 0 for x in self.ids[j][self.mark[j]] if x != qid[r]]
            yield from ((int(qid[r]), x, -s) for s, x in sorted(hits)[:k])


def _search(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, shard = None, None
        for b in batches:
            out = []
            for i in range(b.num_rows):
                key = (b.column("dim")[i].as_py(), b.column("shard")[i].as_py())
                if b.column("vectors")[i].is_valid:
                    # A shard's row comes before its query blocks.
                    at, shard = key, Shard({n: b.column(n)[i].as_py() for n in ("dim", "entry", "width", "vectors", "graph", "ids", "mark")})
                elif key == at:
                    qv = np.array(b.column("qvecs")[i].values, np.float64).reshape(-1, key[0])
                    out += shard.answer(np.array(b.column("qids")[i].values, np.int64), qv, k)
            q, x, s = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(x, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def _cosine(q, v):
    """Cosine of each query with its own row of candidates, in double precision."""
    import numpy as np

    a, b = np.abs(q).max(-1, keepdims=True), np.abs(v).max(-1, keepdims=True)
    q, v = q / a, v / b
    return np.einsum("bd,bcd->bc", q, v, optimize=False) / (np.sqrt((q * q).sum(-1))[:, None] * np.sqrt((v * v).sum(-1)))


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows of ``table`` other than itself.

    Every query searches every shard, so the searches are queries times rows over ``shard_rows``; a search grows
    with the logarithm of its shard.  Raise ``shard_rows`` as far as executors have memory (about 1.3 KB a row of 64 components).
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    bounded_batches(spark)

    def usable(df):
        e = F.col("emb")
        # Null where the array holds a null, which no filter passes; no lambda functions, so this stays in generated code.
        without = lambda x: F.array_contains(e, F.lit(x)) == F.lit(False)
        sound = (F.size(e) > 0) & without(float("nan")) & without(float("inf")) & without(float("-inf")) & ((F.array_max(e) > 0) | (F.array_min(e) < 0))
        df = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("emb"))
        return df.filter(F.col("id").isNotNull() & e.isNotNull() & sound).distinct()

    # The k + 1 smallest ids of each distinct vector; the limit is applied before the shuffle as well.  Vectors are told
    # apart by two hashes of 64 bits, which sort faster than they would.
    key = [F.xxhash64("emb").alias("h"), F.xxhash64(F.lit(1), "emb").alias("i")]
    smallest = F.row_number().over(Window.partitionBy("h", "i").orderBy("id"))
    nodes = usable(table).select("*", *key).withColumn("r", smallest).filter(F.col("r") <= k + 1)
    nodes = nodes.groupBy("h", "i").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("emb").alias("emb"))
    nodes = scratch.write(nodes.select(F.col("ids")[0].alias("node"), "ids", "emb", F.size("emb").alias("dim")), "nodes")
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    schema = "dim int, shard int, entry int, width int, vectors binary, graph binary, ids binary, mark binary"
    graphs = scratch.write(dealt.groupBy("dim", "shard").applyInPandas(_build, schema), "graphs")

    asked = scratch.write(usable(queries).withColumn("dim", F.size("emb")), "queries")
    blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    packed = asked.groupBy("dim", block.alias("block")).agg(F.collect_list(F.struct("id", "emb")).alias("q"))
    packed = packed.select("dim", F.col("q.id").alias("qids"), F.flatten("q.emb").alias("qvecs"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    # Each shard's graph moves once, and its query blocks stream by in the same task.
    met = graphs.unionByName(packed, allowMissingColumns=True).repartition(2 * shards, "dim", "shard").sortWithinPartitions("dim", "shard", F.col("vectors").isNull())
    found = scratch.write(met.mapInArrow(_search(k), "query_id long, vec_id long, score double"), "found")
    scratch.keep_only(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
