"""Filling containers of fixed capacity, with every container close to a mixture.

Deficit round-robin: when a container opens, each source queue is credited
with its target share of the capacity; the queue with the largest deficit
gives its largest item that still fits, and pays for it. Credits that were not
spent stay, across containers and across partitions.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.session import cut

PACKED = "limit_id int, capacity int, container string, position int, doc_id bigint, part int, source string, n_tokens bigint"
#: Tokens that one task packs; only sizes are held, so this bounds its memory.
TOKENS_PER_SHARD = 2_000_000
#: Sources and limits are planned on the driver and are few; more are refused.
MAX_SOURCES, MAX_LIMITS = 5_000, 200


class _Queue:
    """Items of one source, by size."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.items: dict[int, list] = {}

    def put(self, size: int, item) -> None:
        if size not in self.items:
            self.items[size] = []
            insort(self.sizes, size)
        self.items[size].append(item)

    def largest(self, room: int) -> int:
        """Index of the largest size that fits, or -1."""
        return bisect_right(self.sizes, room) - 1

    def take(self, at: int):
        size = self.sizes[at]
        item = self.items[size].pop()
        if not self.items[size]:
            del self.items[size], self.sizes[at]
        return size, item


def pack(items: list[tuple[str, int, object]], capacity: int, share: dict[str, float], deficit: dict[str, float]) -> list[tuple[int, int, str, int, object]]:
    """(container, position, source, size, item) of all ``items`` (source, size, item), each no larger than ``capacity``."""
    queues: dict[str, _Queue] = {}
    for source, size, item in items:
        queues.setdefault(source, _Queue()).put(size, item)
    owed = {s: deficit.get(s, 0.0) for s in queues}
    out, container = [], 0
    while queues:
        for s in queues:
            owed[s] += share.get(s, 0.0) * capacity
        room, position = capacity, 0
        while True:
            best = None
            for s, q in queues.items():
                at = q.largest(room)
                if at >= 0 and (best is None or (owed[s], s) > best[:2]):
                    best = (owed[s], s, at)
            if best is None:
                break
            _, s, at = best
            size, item = queues[s].take(at)
            owed[s] -= size
            room -= size
            out.append((container, position, s, size, item))
            position += 1
            if not queues[s].sizes:
                del queues[s]
                if not queues:
                    break
        container += 1
    return out


def packed(sizes: DataFrame, limits: DataFrame, shares: DataFrame | None = None, tokens_per_shard: int = TOKENS_PER_SHARD) -> DataFrame:
    """Where every document goes, for each capacity.

    ``sizes``: (doc_id, source, n_tokens); ``limits``: (limit_id,
    capacity_tokens), those without a positive capacity are left out;
    ``shares``: (source, share) to aim at, by default the shares of what
    goes into mixed containers, for which no queue runs dry before the others.
    Documents are not split, so a container holds every source only where it
    has room for a document of each; what holds is that a source never leads
    or lags by much more than one container, which ``mixture`` measures.

    Each document goes into one container per limit. Only one that exceeds
    the capacity by itself is split: its full parts fill containers of their
    own (part 0, 1, ...), the rest is an item like any other. Documents of no
    tokens take a place of size 0. A null source is a source of its own.
    Documents are dealt into shards of about ``tokens_per_shard`` by the hash
    of their id; each shard starts with the deficits that the shards before
    it leave, which follow from the shards' totals alone.
    """
    sizes = cut(sizes.where("n_tokens is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.greatest("n_tokens", F.lit(0)).alias("n_tokens")))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // tokens_per_shard))
    own = [r["source"] for r in sizes.select("source").distinct().limit(MAX_SOURCES + 1).collect()]
    given = None if shares is None else {r["source"]: r["share"] or 0.0 for r in shares.select("source", "share").limit(MAX_SOURCES + 1).collect()}
    caps = [(r["limit_id"], r["capacity_tokens"]) for r in limits.where("capacity_tokens > 0").select("limit_id", "capacity_tokens").distinct().limit(MAX_LIMITS + 1).collect()]
    if max(len(own), len(given or ())) > MAX_SOURCES or len(caps) > MAX_LIMITS:
        raise ValueError("too many sources or limits")
    if not caps or not own:
        return sizes.sparkSession.createDataFrame([], PACKED)
    aim = None if given is None else {s: given.get(s, 0.0) for s in own}

    one = lambda i, c: F.struct(F.lit(int(i)).cast("int").alias("limit_id"), F.lit(int(c)).cast("int").alias("capacity"))
    cap = F.col("capacity")
    pieces = sizes.select("*", F.explode(F.array(*(one(i, c) for i, c in sorted(caps)))).alias("x")).select("doc_id", "source", "n_tokens", "x.limit_id", "x.capacity")
    full = F.floor(F.when(F.col("n_tokens") > cap, F.col("n_tokens") / cap).otherwise(0)).cast("int")
    pieces = pieces.withColumn("full", full).withColumn("rest", F.col("n_tokens") - F.col("full") * cap).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    whole = pieces.where("full > 0").select(
        "limit_id", "capacity", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"), "doc_id", "source"
    ).select("limit_id", "capacity", F.concat_ws("-", F.lit("w"), "doc_id", "part").alias("container"), F.lit(0).alias("position"), "doc_id", "part", "source", cap.cast("bigint").alias("n_tokens"))
    items = pieces.where("rest > 0 or full = 0").select("limit_id", "capacity", "shard", "doc_id", F.col("full").alias("part"), "source", F.col("rest").alias("n_tokens"))

    # Deficits before each shard: what its predecessors should have given of each source, less what they gave. Only sources that a shard has matter in it.
    given = items.groupBy("limit_id", "shard", "source").agg(F.sum("n_tokens").alias("t"))
    before = lambda *by: W.partitionBy(*by).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    gone = given.groupBy("limit_id", "shard").agg(F.sum("t").alias("all")).select("limit_id", "shard", "all", F.coalesce(F.sum("all").over(before("limit_id")), F.lit(0)).alias("gone"))
    if aim is None:  # what goes into mixed containers, which depends on the capacity: full parts of long documents do not
        whole_limit = given.groupBy("limit_id").agg(F.sum("t").alias("of"))
        kinds = given.groupBy("limit_id", "source").agg(F.sum("t").alias("share")).join(whole_limit, "limit_id").select("limit_id", "source", (F.col("share") / F.greatest("of", F.lit(1))).alias("share"))
    else:
        kinds = sizes.sparkSession.createDataFrame([(int(i), x, float(w)) for i, _ in caps for x, w in sorted(aim.items())], "limit_id int, source string, share double")
    plan = given.withColumn("had", F.coalesce(F.sum("t").over(before("limit_id", "source")), F.lit(0))).join(gone, ["limit_id", "shard"]).join(F.broadcast(kinds), ["limit_id", "source"])  # at most MAX_LIMITS x MAX_SOURCES rows
    plan = plan.withColumn("deficit", F.col("share") * F.col("gone") - F.col("had"))
    if aim is None:  # credits that with the deficit add up to what the shard has of the source, so that its last containers are mixed like its first
        plan = plan.withColumn("share", F.greatest(F.lit(0.0), (F.col("t") - F.col("deficit")) / F.greatest("all", F.lit(1))))
    plan = plan.groupBy("limit_id", "shard").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("share", "deficit")))).alias("plan"))
    plan = plan.select(F.col("limit_id").alias("of_limit"), F.col("shard").alias("of_shard"), "plan")

    def run(key, pdf: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        limit_id, shard = int(key[0]), int(key[1])
        if not len(pdf):
            return pd.DataFrame(columns=[c.split()[0] for c in PACKED.split(", ")])
        of = plan["plan"].iloc[0]
        of = dict(of)
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "part"])
        rows = pack(
            [(s, int(n), (d, p)) for s, n, d, p in zip(pdf["source"], pdf["n_tokens"], pdf["doc_id"], pdf["part"])], capacity,
            {s: x["share"] for s, x in of.items()}, {s: x["deficit"] for s, x in of.items()},
        )
        return pd.DataFrame([(limit_id, capacity, f"s-{shard}-{c}", i, d, p, s, n) for c, i, s, n, (d, p) in rows], columns=[c.split()[0] for c in PACKED.split(", ")])

    mixed = items.groupBy("limit_id", "shard").cogroup(plan.groupBy("of_limit", "of_shard")).applyInPandas(run, PACKED)
    return whole.unionByName(mixed)


def report(packs: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, share of space used, documents, split documents."""
    per = packs.groupBy("limit_id", "capacity", "container").agg(F.sum("n_tokens").alias("used"))
    fill = per.groupBy("limit_id", "capacity").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    docs = packs.groupBy("limit_id", "doc_id").agg(F.count("*").alias("parts")).groupBy("limit_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("parts") > 1).alias("n_split"))
    return fill.join(docs, "limit_id").withColumn("filled", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6))


def mixture(packs: DataFrame) -> DataFrame:
    """How well the mixed containers keep the proportions, per limit and source.

    (limit_id, source, target_share, n_containers, n_without, mean_error,
    most_lag): the source's share of all tokens in mixed containers, their
    number, those without the source, the mean distance of the share in a
    container from the target, and the farthest that a shard's running total
    of the source leads or lags, in containers.
    """
    p = packs.where(F.col("container").startswith("s-"))
    at = F.split("container", "-")
    one = p.groupBy("limit_id", "capacity", "container", "source").agg(F.sum("n_tokens").alias("t")).withColumn("shard", at[1].cast("int")).withColumn("no", at[2].cast("int"))
    upto = lambda *by: W.partitionBy(*by).orderBy("no")
    per = one.groupBy("limit_id", "shard", "no").agg(F.sum("t").alias("used"))
    per = per.withColumn("all", F.sum("used").over(upto("limit_id", "shard")))
    total = one.groupBy("limit_id").agg(F.sum("t").alias("total"), F.countDistinct("container").alias("n_containers"))
    aim = one.groupBy("limit_id", "source").agg(F.sum("t").alias("of")).join(total, "limit_id").withColumn("target_share", F.col("of") / F.greatest("total", F.lit(1)))
    # A shard aims at its own proportions as well as it can: running totals are held against what the shard has of the source.
    shard = W.partitionBy("limit_id", "shard", "source")
    x = one.join(per, ["limit_id", "shard", "no"]).withColumn("had", F.sum("t").over(upto("limit_id", "shard", "source"))).withColumn("has", F.sum("t").over(shard))
    x = x.join(per.groupBy("limit_id", "shard").agg(F.sum("used").alias("shard_total")), ["limit_id", "shard"])
    want = F.col("has") / F.greatest("shard_total", F.lit(1))
    lag = F.greatest(F.abs(F.col("had") - want * F.col("all")), F.abs(F.col("had") - F.col("t") - want * (F.col("all") - F.col("used")))) / F.col("capacity")
    x = x.withColumn("lag", lag).join(aim.select("limit_id", "source", "target_share"), ["limit_id", "source"])
    x = x.groupBy("limit_id", "source").agg(F.count("*").alias("n_with"), F.sum(F.abs(F.col("t") / F.greatest("used", F.lit(1)) - F.col("target_share"))).alias("e"), F.max("lag").alias("most_lag"))
    out = aim.join(x, ["limit_id", "source"])
    without = F.col("n_containers") - F.col("n_with")
    return out.select(
        "limit_id", "source", F.round("target_share", 6).alias("target_share"), "n_containers", without.alias("n_without"),
        F.round((F.col("e") + without * F.col("target_share")) / F.col("n_containers"), 6).alias("mean_error"), F.round("most_lag", 4).alias("most_lag"),
    )


def violations(packs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(limit_id, n_docs, n_lost, n_overfull, n_changed): documents, and how many are missing, too full a container, or of other than their size. All but the first must be 0."""
    per = packs.groupBy("limit_id", "capacity", "container").agg(F.sum("n_tokens").alias("used")).groupBy("limit_id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("n_overfull"))
    docs = packs.groupBy("limit_id", "doc_id").agg(F.sum("n_tokens").alias("t"))
    limits = sorted(r["limit_id"] for r in packs.select("limit_id").distinct().limit(MAX_LIMITS + 1).collect())
    want = sizes.select("doc_id", "n_tokens", F.explode(F.array(*map(F.lit, limits)) if limits else F.array().cast("array<int>")).alias("limit_id"))
    got = want.join(docs, ["limit_id", "doc_id"], "left").groupBy("limit_id").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("t").isNull()).alias("n_lost"), F.count_if(F.col("t") != F.col("n_tokens")).alias("n_changed")
    )
    return got.join(per, "limit_id").select("limit_id", "n_docs", "n_lost", "n_overfull", "n_changed")
