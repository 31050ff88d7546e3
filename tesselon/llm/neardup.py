"""Near duplicates by fast similarity sketching, banding and exact verification.

1. One pass over the texts gives each document its shingle count, a digest of its shingle set, the
   band keys of its sketch and a one-bit signature.  Documents with equal sets form one class; only
   class representatives go on.
2. Documents that share a band key are candidates.  In each bucket every member is paired with a few
   centres; each node verifies its nearest centres on full sets, and links are joined into components.
3. In buckets that still hold several components the members outside the largest one meet the others,
   and their sets are intersected inside the join, which gives out links only.  A pair is compared in the
   first bucket that it shares.  Pairs within the largest component are never tried, so a group of copies
   costs a star, not its square; hot buckets are split by adaptive skew handling.  Before two sets are
   intersected the parities of their hashes over ``PARITY`` places are compared, which differ in no more
   bits than the sets differ in elements: most pairs of a group below the threshold end there.

Bands are as selective as leaves a pair at the threshold without a common band with probability
``MISS`` at most.  A candidate is passed over only when its signatures are over 6 standard deviations
from what the threshold gives, or its set sizes or parities rule the link out.  Verification compares complete sets.

Defined results.  Null, empty and blank texts have no shingles, are linked with nothing and kept.
Very long texts take part whole.  Rows with a null ``doc_id`` have no identity to report: they link
nothing, their component is null and they are kept.  Repeated rows each get a row; texts that share a
``doc_id`` are one node, which is linked as each of them is.  An empty table gives an empty result.
Columns beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselon.llm.common import Scratch, bounded_batches, lean_worker
from tesselon.llm.components import connected_components

SHINGLE = 5
COORDINATES = 256
#: Bits of a set's parities.
PARITY = 1024
MISS = 3e-6
SIGMAS = 6.0
#: Centres that each node verifies first.
NEAREST = 3


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair at the threshold with probability ``MISS`` at most."""
    return next((COORDINATES // r, r) for r in range(COORDINATES, 0, -1) if (1 - (percent / 100) ** r) ** (COORDINATES // r) <= MISS)


_FEATURES = "doc_id long, n_shingles long, digest binary, s0 long, s1 long, s2 long, s3 long, bands array<long>, parity array<long>"


def _parts(batches):
    """Ids and texts of a batch, about 2**20 characters at a time: what a worker holds beside the batch follows from that."""
    from tesselon.llm import shingles as S

    lean_worker()
    for b in batches:
        texts = b.column("text").to_pylist()
        for i, j in S.grouped(texts):
            yield b.column("doc_id").slice(i, j - i), texts[i:j]
    b = texts = None
    lean_worker()


def _features(batches, percent: int):
    import numpy as np
    import pyarrow as pa

    from tesselon.llm import shingles as S

    for ids, texts in _parts(batches):
        sets = S.shingle_sets(texts, SHINGLE)
        has = [i for i, s in enumerate(sets) if len(s)]
        some = [sets[i] for i in has]
        sketch, parity = S.similarity_sketches(some, COORDINATES), S.parities(some, PARITY)
        keys, sig = S.band_keys(sketch, *banding(percent)).view(np.int64), S.signature(sketch)
        digest: list = [None] * len(sets)
        bands: list = [None] * len(sets)
        odd: list = [None] * len(sets)
        words = np.zeros((len(sets), COORDINATES // 64), np.int64)
        for k, i in enumerate(has):
            digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            bands[i], odd[i] = keys[k], parity[k]
            words[i] = sig[k]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())]
            + [pa.array(words[:, j]) for j in range(4)]
            + [pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "digest", "s0", "s1", "s2", "s3", "bands", "parity"],
        )


def _hash_sets(batches):
    import numpy as np
    import pyarrow as pa

    from tesselon.llm import shingles as S

    for ids, texts in _parts(batches):
        sets = [x.view(np.int64) for x in S.shingle_sets(texts, SHINGLE)]
        digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
        yield pa.RecordBatch.from_arrays([ids, pa.array(digest, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["node", "digest", "items"])


def _apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.s{j}").bitwiseXOR(F.col(f"{b}.s{j}"))) for j in range(4)), F.lit(0))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Signature and size test on two sides whose columns are prefixed."""
    p = (1 - percent / 100) / 2
    most = COORDINATES * p + SIGMAS * math.sqrt(COORDINATES * p * (1 - p))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (_apart(a, b) <= int(most)) & (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m))


SIG = ["n", "s0", "s1", "s2", "s3"]


def _few_differ(a: str, b: str, percent: int) -> Column:
    """Parity test on two sides: linked sets differ in at most (100 - percent) / (100 + percent) of their elements."""
    bits = sum((F.bit_count(F.col(f"{a}.d{j}").bitwiseXOR(F.col(f"{b}.d{j}"))) for j in range(PARITY // 64)), F.lit(0))
    return F.lit(100 + percent) * bits <= F.lit(100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _may_meet(p: str, q: str, percent: int) -> Column:
    """Whether a row outside the main component may be linked with another row of its bucket."""
    x, y = (lambda c: F.col(f"{p}.{c}")), (lambda c: F.col(f"{q}.{c}"))
    apart = (x("comp") < y("comp")) | ((y("comp") == y("main")) & (x("comp") != y("comp")))
    return (x("bucket") == y("bucket")) & apart & _may_link(p, q, percent) & _few_differ(p, q, percent) & ~F.arrays_overlap(x("head"), y("head"))


def near_duplicates(docs: DataFrame, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; links are at ``percent`` hundredths of similarity or more."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "neardup")
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = scratch.write(docs.mapInArrow(partial(_features, percent=percent), _FEATURES), "features")

    # Classes of equal sets; the representative is the smallest id.
    nodes = scratch.write(
        feats.filter("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), *[F.first(f"s{j}").alias(f"s{j}") for j in range(4)], F.first("bands").alias("bands"), F.first("parity").alias("parity")),
        "nodes",
    )
    sig = nodes.select("node", *SIG)
    # Few buckets recur, so counting them before the exchange would only sort them once more: one exchange serves both sides.
    member = nodes.select("node", F.explode("bands").alias("bucket")).repartition("bucket")
    shared = member.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.struct(F.xxhash64("node"), "node")).alias("mid")).filter("low <> high")
    member = member.join(shared.select("bucket", "low", "high", "mid.node").withColumnRenamed("node", "mid"), "bucket")
    # A small part of the rows read: gathered into as few files as their size asks for.
    member = scratch.write(member.hint("rebalance"), "members")

    # The full sets of all candidates, made once; without the hint the plan, and the disk it needs, would change with the size.
    wanted = member.select(F.col("node").alias("doc_id")).distinct()
    sets = docs.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_hash_sets, "node long, digest binary, items array<long>")
    sets = scratch.write(sets.join(nodes.select("node", "digest"), ["node", "digest"], "left_semi"), "sets")

    centres = F.explode(F.array_distinct(F.array("low", "high", "mid")))
    star = member.select("node", centres.alias("c")).filter("node <> c").select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b"), "node").distinct()
    near = Window.partitionBy("node").orderBy("apart", "a", "b")
    star = _with_signatures(star, sig, percent).withColumn("r", F.row_number().over(near)).filter(F.col("r") <= NEAREST)
    links = scratch.write(_confirm(star.select("a", "b").distinct(), sets, percent), "links")

    comp = scratch.write(connected_components(links, scratch, "cc1"), "labels")
    label = member.select("bucket", "node").join(comp, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    label = scratch.write(label, "members-labelled")
    held = label.groupBy("bucket", "comp").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps"))
    rest = label.join(held.filter("comps > 1").select("bucket", F.col("m.comp").alias("main")), "bucket")
    # Only components are joined further, by links between them.
    found = _across(rest, nodes, sets, percent, scratch)
    joined = scratch.write(connected_components(found, scratch, "cc2"), "joined")
    scratch.keep_only(feats, nodes, comp, joined)

    class_of = nodes.select("digest", "node").join(comp, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    class_of = class_of.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("least")), "comp", "left").select("digest", F.coalesce("least", "comp").alias("comp"))
    out = feats.select("doc_id", "n_shingles", "digest").join(class_of, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _across(rest: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components that a bucket of ``rest`` (bucket, node, comp, and the bucket's main component) shows."""
    # Of the texts of one id those that fell into the bucket.
    rows = rest.join(nodes, "node").withColumn("at", F.array_position("bands", F.col("bucket")).cast("int")).filter("at > 0")
    odd = {f"d{j}": F.col("parity")[j] for j in range(PARITY // 64)}
    rows = scratch.write(rows.withColumns({"head": F.slice("bands", 1, F.col("at") - 1)} | odd).drop("bands", "at", "parity"), "rest")

    # Only rows that may meet another one take their sets along.
    p, q = rows.filter("comp <> main"), rows
    near_p = p.alias("p").join(q.alias("q"), _may_meet("p", "q", percent), "left_semi").join(sets, ["node", "digest"])
    near_q = q.alias("q").join(p.alias("p"), _may_meet("p", "q", percent), "left_semi").join(sets, ["node", "digest"])
    met = near_p.alias("p").join(near_q.alias("q"), _may_meet("p", "q", percent) & _linked(F.col("p.items"), F.col("q.items"), percent))
    return met.select(F.greatest("p.comp", "q.comp").alias("a"), F.least("p.comp", "q.comp").alias("b")).distinct()


def _linked(x: Column, y: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(x, y))
    return F.lit(100) * both >= F.lit(percent) * (F.size(x) + F.size(y) - both)


def _with_signatures(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    rename = lambda x: sig.select(F.col("node").alias(x), F.struct(*SIG).alias(f"s_{x}"))
    both = pairs.join(rename("b"), "b").join(rename("a"), "a")
    return both.filter(_may_link("s_a", "s_b", percent)).select(*pairs.columns, _apart("s_a", "s_b").alias("apart"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    return pairs.join(right, "b").join(left, "a").filter(_linked(F.col("items_a"), F.col("items_b"), percent)).select("a", "b").distinct()


def one_of_each_group(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, and every row without an id or without words.

    Of rows that share the ``doc_id`` that stays one is kept.  An empty table stays empty; all columns pass through.
    """
    keep = near_duplicates(docs, percent).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
