"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

The level rises over all sources in proportion to their weights; a source that is used up as often as it may be is
clamped there, and what it lacks goes to the others in proportion, until nothing changes. A source's repetitions are
then a whole number of every document and a fraction: the documents first in a seeded order, up to the quota.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .tokens import TOKENIZER, sized

#: The seeded order is cut into bins, of some so many documents or more; only in the one bin where a quota ends are
#: documents put in order.
BIN_DOCS, MOST_BINS = 4096, 1 << 16
#: Bins up to which they are sent to every task.
MOST_SENT = 100_000
SEED = 42


def fill(targets: list[tuple[str, float, int]], sizes: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens each source gives: targets are (source, weight, most repetitions), sizes their tokens.

    ``total`` defaults to all tokens of the listed sources; where the sources can't give that, they give all they can.
    """
    total = float(sum(sizes.get(s, 0) for s, _, _ in targets)) if total is None else float(total)
    most = {s: float(max(0, r) * sizes.get(s, 0)) for s, _, r in targets}
    weight = {s: max(0.0, w) for s, w, _ in targets}
    quota = {s: 0.0 for s in most}
    open_, rest = {s for s in most if weight[s] > 0 and most[s] > 0}, total
    while open_ and rest > 1e-9:
        level = rest / sum(weight[s] for s in open_)
        clamped = {s for s in open_ if level * weight[s] >= most[s]}
        if not clamped:
            for s in open_:
                quota[s] = level * weight[s]
            break
        for s in clamped:
            quota[s] = most[s]
            rest -= most[s]
        open_ -= clamped
    return quota


def _take(bin_: pd.DataFrame) -> pd.DataFrame:
    """Of the one bin in which a quota ends, the documents that still fit, in the seeded order."""
    bin_ = bin_.sort_values(["h", "doc_id"])
    room, more = int(bin_["room"].iloc[0]), []
    for n in bin_["tokens"]:
        more.append(int(n <= room))
        room -= n if n <= room else 0
    return bin_.assign(more=np.asarray(more, dtype="int32"))[["mix", "source", "doc_id", "tokens", "whole", "more"]]


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """mix, source, doc_id, tokens, repeats: the documents of each mix and how often each is taken.

    Defined cases: a null source is no source; documents without tokens are not taken; a source that is not listed
    gives nothing, one without documents gives nothing and the others make up for it; weights need not sum to 1;
    repeated doc_ids are documents of their own; ties of the seeded order go by doc_id; an empty table gives no rows.
    """
    spark = documents.sparkSession
    sizes = written(sized(documents.where(F.col("source").isNotNull()), ["doc_id", "source"], tokenizer).where("tokens > 0"), "mix-sizes")
    wanted: dict[str, list[tuple[str, float, int]]] = {}
    for r in targets.select("mix", "source", "target_share", "max_repeats").distinct().collect():  # a fixed, small table
        wanted.setdefault(r["mix"], []).append((r["source"], r["target_share"], r["max_repeats"]))
    listed = sorted({s for t in wanted.values() for s, _, _ in t})
    got = sizes.where(F.col("source").isin(*listed)).groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")).collect()  # a row a source
    have = {r["source"]: r["n"] for r in got}
    power = max(0, min(MOST_BINS, max((r["docs"] for r in got), default=1) // BIN_DOCS).bit_length() - 1)
    rows = []
    for mix, t in sorted(wanted.items()):
        quota = fill(t, have, total)
        for s, _, r in t:
            n = have.get(s, 0)
            if n and quota[s] > 0:
                whole = min(int(quota[s] // n), r)
                rows.append((mix, s, whole, max(0, int(round(quota[s] - whole * n))) if whole < r else 0))
    plan = spark.createDataFrame(rows, "mix string, source string, whole int, part bigint")
    x = sizes.join(F.broadcast(plan), "source")  # as many rows as targets
    x = x.withColumn("h", F.xxhash64(F.lit(seed), "mix", "doc_id"))
    x = x.withColumn("bin", F.shiftrightunsigned("h", 64 - power).cast("int") if power else F.lit(0))
    keys = ["mix", "source"]
    bins = x.where("part > 0").groupBy(*keys, "bin").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("before", before)
    bins = F.broadcast(bins) if len(rows) << power <= MOST_SENT else bins.hint("shuffle_hash")  # a bin is a small part of its source
    x = x.join(bins, [*keys, "bin"], "left")
    whole_bin = x.where((F.col("part") <= 0) | F.col("n").isNull() | (F.col("before") + F.col("n") <= F.col("part")) | (F.col("before") >= F.col("part")))
    whole_bin = whole_bin.withColumn("more", ((F.col("part") > 0) & (F.coalesce(F.col("before") + F.col("n"), F.lit(0)) <= F.col("part"))).cast("int"))
    edge = x.where((F.col("part") > 0) & (F.col("before") < F.col("part")) & (F.col("before") + F.col("n") > F.col("part")))
    edge = edge.select(*keys, "doc_id", "tokens", "whole", "h", (F.col("part") - F.col("before")).alias("room"))
    edge = edge.groupBy(*keys).applyInPandas(_take, "mix string, source string, doc_id bigint, tokens bigint, whole int, more int")
    both = whole_bin.select(*keys, "doc_id", "tokens", "whole", "more").unionByName(edge.select(*keys, "doc_id", "tokens", "whole", "more"))
    return both.select(*keys, "doc_id", "tokens", (F.col("whole") + F.col("more")).alias("repeats")).where("repeats > 0")


def shares(taken: DataFrame, targets: DataFrame) -> DataFrame:
    """mix, source, target_share, actual_share, tokens, documents, most_repeats: what each source really gives."""
    got = taken.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    x = targets.select("mix", "source", "target_share").distinct().join(got, ["mix", "source"], "left")
    w = Window.partitionBy("mix")  # the targets of a mix
    n = F.coalesce("tokens", F.lit(0))
    return x.select(
        "mix", "source", "target_share", F.round(n / F.sum(n).over(w), 6).alias("actual_share"), n.alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
