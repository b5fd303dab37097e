"""Mixing sources to target weights by Pfair scheduling.

The drawn documents of a source form a stream that is cut into blocks of equal
size. With weight w its i-th block may not come before slot floor((i-1)/w) and
must come before slot ceil(i/w); earliest deadline first among the released
blocks meets all deadlines, so at no time is a source a whole block ahead of
or behind its share. The schedule repeats after QUANTUM slots, which makes the
slot of any block a formula over one small table.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.prefix import running_start
from codeweft.session import cut

#: Weights are rounded to multiples of 1/QUANTUM; the schedule has this period.
QUANTUM = 10_000
BLOCK_TOKENS = 2_048
#: More (mix, source) pairs than this are refused: they are planned on the driver.
MAX_TARGETS = 100_000
#: A share is met if it is reached to within this much of the whole mix.
TOLERANCE = 0.005
#: Rounds in which documents that are short enough fill what is missing at a goal.
FILL_ROUNDS = 3


def units(weights: dict[str, float], quantum: int = QUANTUM) -> dict[str, int]:
    """Whole slots per period, by largest remainder; every positive weight gets at least one."""
    total = sum(w for w in weights.values() if w > 0)
    if total <= 0:
        return {}
    exact = {s: w / total * quantum for s, w in weights.items() if w > 0}
    n = {s: max(1, floor(x)) for s, x in exact.items()}
    rest = quantum - sum(n.values())
    for s in sorted(exact, key=lambda s: (floor(exact[s]) - exact[s], s)):
        if rest <= 0:
            break
        n[s] += 1
        rest -= 1
    while rest < 0:
        s = max(n, key=lambda s: (n[s], s))
        n[s] -= 1
        rest += 1
    return n


def schedule(n: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source in one period of sum(n) slots: EDF over Pfair windows."""
    period = sum(n.values())
    coming, ready = [], []
    for s, k in n.items():
        heapq.heappush(coming, (0, s, 1))
    slots: dict[str, list[int]] = {s: [] for s in n}
    for t in range(period):
        while coming and coming[0][0] <= t:
            _, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (ceil(Fraction(i * period, n[s])), s, i))
        if not ready:
            raise AssertionError("an idle slot: weights do not add up")
        _, s, i = heapq.heappop(ready)
        slots[s].append(t)
        if i < n[s]:
            heapq.heappush(coming, (floor(Fraction(i * period, n[s])), s, i + 1))
    return slots


def plan(supply: dict[str, int], targets: list[tuple[int, str, float, int]], total_tokens: int | None = None, whole: bool = False) -> list[tuple]:
    """(mix_id, source, target_share, max_repeats, supply, goal, kind) for every target.

    Without ``total_tokens`` a mix is as large as it can be with every share
    exact: the smallest of supply * max_repeats / share over its sources that
    have documents. With it, or with ``whole``, which makes a mix as large as
    the supply of these sources together, sources that cannot give so much
    give all they may. kind: zero_target, no_documents, capped or open.
    """
    out = []
    mixes: dict[int, list] = {}
    for t in targets:
        mixes.setdefault(t[0], []).append(t)
    for mix, ts in sorted(mixes.items()):
        live = [(s, w, r) for _, s, w, r in ts if w > 0 and r > 0 and supply.get(s, 0) > 0]
        if total_tokens is not None:
            size = total_tokens
        elif whole:
            size = sum(supply[s] for s, _, _ in live)
        else:
            size = min((supply[s] * r / w for s, w, r in live), default=0)
        for _, s, w, r in ts:
            have = supply.get(s, 0)
            if not w or w <= 0:
                goal, kind = 0, "zero_target"
            elif have <= 0 or r <= 0:
                goal, kind = 0, "no_documents"
            else:
                want, most = int(w * size), have * r
                goal, kind = min(want, most), "open" if want <= most else "capped"
            out.append((mix, s, float(w), int(r), int(have), int(goal), kind))
    return out


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK_TOKENS, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The drawn documents in order, and the shares reached.

    ``sizes``: (doc_id, source, n_tokens); ``targets``: (mix_id, source,
    target_share, max_repeats). Documents without tokens are never drawn, nor
    are those of sources that no mix names; targets with a null source, null
    or negative share are left out; null repeats count as 1.

    Draws: (mix_id, slot, offset, source, doc_id, repeat, n_tokens), ordered
    by slot and offset. A source's documents are drawn in hash order, whole
    passes first, so none is drawn twice more often than another; a document
    is drawn if it ends before the goal, and what is then missing is filled
    with the next documents that are short enough, so no goal is exceeded.

    Report: (mix_id, source, target_share, max_repeats, supply_tokens,
    goal_tokens, drawn_tokens, n_draws, reached_share, deviation, status).
    ``deviation`` is reached less target share. status: zero_target;
    no_documents; met, if the deviation is within TOLERANCE; capped, if a
    source would have to be repeated more often than it may; over or short,
    if others of the mix are capped or have no documents, or documents are
    too long to come closer.
    """
    spark = sizes.sparkSession
    sizes = cut(sizes.where("n_tokens > 0 and source is not null").select("doc_id", "source", "n_tokens"))
    t = targets.where("source is not null and target_share >= 0").groupBy("mix_id", "source").agg(F.max("target_share").alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r"))
    rows = t.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError("too many targets")
    named = t.select("source").distinct()
    total = {r["source"]: (r["t"], r["n"]) for r in sizes.join(F.broadcast(named), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    planned = plan({s: x[0] for s, x in total.items()}, [(r["mix_id"], r["source"], r["w"], r["r"]) for r in rows], total_tokens, whole)

    goals, table = [], []
    for mix in sorted({p[0] for p in planned}):
        n = units({p[1]: p[5] for p in planned if p[0] == mix})
        slots = schedule(n) if n else {}
        for p in planned:
            if p[0] == mix and p[5] > 0:
                goals.append((mix, p[1], p[4], p[5], n[p[1]]))
                table += [(mix, p[1], i, s) for i, s in enumerate(slots[p[1]])]
    goals_df = spark.createDataFrame(goals, "mix_id int, source string, supply bigint, goal bigint, n int")
    slots_df = spark.createDataFrame(table, "mix_id int, source string, i int, slot_in int")  # at most QUANTUM rows a mix

    at = running_start(sizes, ["source"], "doc_id", "n_tokens", sum(x[1] for x in total.values()))
    passes = F.explode(F.sequence(F.lit(0), F.ceil(F.col("goal") / F.col("supply")).cast("int") - 1))
    offers = at.join(F.broadcast(goals_df), "source").select("*", passes.alias("repeat")).withColumn("offset", F.col("start") + F.col("repeat") * F.col("supply"))
    left = cut(offers.withColumn("taken", F.col("offset") + F.col("n_tokens") <= F.col("goal")))
    drawn, left = left.where("taken").drop("taken"), left.where("not taken").drop("taken", "start", "offset")
    # A long document at the goal leaves a gap: later ones that are short enough fill it, in the same order, then shorter ones.
    for _ in range(FILL_ROUNDS):
        sums = drawn.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("got"))
        gaps = [(r["mix_id"], r["source"], r["got"], r["goal"] - r["got"]) for r in goals_df.join(sums, ["mix_id", "source"], "left").fillna(0, ["got"]).collect() if r["goal"] - r["got"] > 0]
        if not gaps:
            break
        gaps_df = spark.createDataFrame(gaps, "mix_id int, source string, got bigint, gap bigint")
        short = left.join(F.broadcast(gaps_df), ["mix_id", "source"]).where("n_tokens <= gap")
        if short.isEmpty():
            break
        short = cut(running_start(short, ["mix_id", "source"], "doc_id", "n_tokens").withColumn("taken", F.col("start") + F.col("n_tokens") <= F.col("gap")))
        fits = short.where("taken").withColumn("offset", F.col("got") + F.col("start"))
        drawn = drawn.unionByName(fits.drop("got", "gap", "taken"))
        left = short.where("not taken").drop("got", "gap", "taken", "start")
    drawn = drawn.withColumn("b", F.floor(F.col("offset") / block)).withColumn("i", (F.col("b") % F.col("n")).cast("int"))
    drawn = drawn.join(F.broadcast(slots_df), ["mix_id", "source", "i"])
    draws = drawn.select("mix_id", (F.floor(F.col("b") / F.col("n")) * QUANTUM + F.col("slot_in")).cast("bigint").alias("slot"), "offset", "source", "doc_id", "repeat", "n_tokens")

    known = spark.createDataFrame(planned, "mix_id int, source string, target_share double, max_repeats int, supply_tokens bigint, goal_tokens bigint, kind string")
    got = draws.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.count("*").alias("n_draws"))
    shares = known.join(got, ["mix_id", "source"], "left").fillna(0, ["drawn_tokens", "n_draws"])
    whole = got.groupBy("mix_id").agg(F.sum("drawn_tokens").alias("all"))
    shares = shares.join(whole, "mix_id", "left").withColumn("reached_share", F.round(F.coalesce(F.col("drawn_tokens") / F.col("all"), F.lit(0.0)), 6)).drop("all")
    off = F.col("reached_share") - F.col("target_share")
    status = F.when(F.col("kind").isin("zero_target", "no_documents"), F.col("kind")).when(F.abs(off) <= TOLERANCE, "met").when(F.col("kind") == "capped", "capped").when(off > 0, "over").otherwise("short")
    return draws, shares.withColumn("deviation", F.round(off, 6)).withColumn("status", status).drop("kind")


def violations(draws: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, max_repeats, n_docs, n_over_repeated, n_foreign): per target, its documents with tokens, those drawn too often, and draws of another source's document. The last two must be 0."""
    d = sizes.where("n_tokens > 0")
    n = d.groupBy("source").agg(F.count("*").alias("n_docs"))
    t = targets.where("source is not null and target_share >= 0").groupBy("mix_id", "source").agg(F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    own = d.select("doc_id", F.col("source").alias("own"))
    drawn = draws.groupBy("mix_id", "source", "doc_id").agg(F.count("*").alias("k")).join(own, "doc_id", "left").join(t, ["mix_id", "source"])
    bad = drawn.groupBy("mix_id", "source").agg(F.count_if(F.col("k") > F.col("max_repeats")).alias("n_over_repeated"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("n_foreign"))
    return t.join(n, "source", "left").join(bad, ["mix_id", "source"], "left").fillna(0, ["n_docs", "n_over_repeated", "n_foreign"]).select("mix_id", "source", "max_repeats", "n_docs", "n_over_repeated", "n_foreign")
