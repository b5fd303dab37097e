"""Containers and mixtures."""

import random
from collections import Counter, defaultdict

import pytest

from codeweft.llm import mixing, packing, tokens

SIZES = "doc_id bigint, source string, n_tokens bigint"


def sizes(spark, n=3000, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), int(r.lognormvariate(4.5, 1)) if r.random() > 0.02 else 0) for i in range(n)]
    rows += [(n, "a", 5000), (n + 1, "b", 1024), (n + 2, "c", 512), (n + 3, "c", None)]
    return rows, spark.createDataFrame(rows, SIZES)


def test_packed(spark):
    rows, df = sizes(spark)
    limits = spark.createDataFrame([(1, 512), (2, 2048), (3, 0), (4, None)], "limit_id int, capacity_tokens int")
    got = packing.packed(df, limits, tokens_per_shard=60_000).collect()
    for limit, cap in ((1, 512), (2, 2048)):
        part = [r for r in got if r["limit_id"] == limit]
        used, docs = Counter(), defaultdict(list)
        for r in part:
            used[r["container"]] += r["n_tokens"]
            docs[r["doc_id"]].append(r)
        assert max(used.values()) <= cap and set(docs) == {i for i, _, n in rows if n is not None}
        for i, s, n in rows:
            if n is None:
                continue
            assert sum(r["n_tokens"] for r in docs[i]) == n and {r["source"] for r in docs[i]} == {s or ""}
            assert len(docs[i]) == (1 if n <= cap else -(-n // cap)) and sorted(r["part"] for r in docs[i]) == list(range(len(docs[i])))
        assert sum(used.values()) / (len(used) * cap) > 0.97
    assert {r["limit_id"] for r in got} == {1, 2}
    rep = {r["limit_id"]: r for r in packing.report(packing.packed(df, limits)).collect()}
    assert rep[1]["fullest"] <= 512 and rep[1]["n_docs"] == 3003


def test_windows_hold_the_mixture(spark):
    r = random.Random(2)
    items = [("a" if i % 4 else "b", r.randrange(20, 60), i) for i in range(4000)]
    total = sum(x[1] for x in items)
    share = {s: sum(n for q, n, _ in items if q == s) / total for s in "ab"}
    windows = defaultdict(Counter)
    for c, _, s, n, _ in packing.pack(items, 2048, share, {}):
        windows[c][s] += n
    full = [w for w in windows.values() if sum(w.values()) > 2000]
    assert len(full) > 60 and all(abs(w["b"] / sum(w.values()) - share["b"]) < 0.04 for w in full)


def test_mixture_report_equals_brute_force(spark):
    rows, df = sizes(spark, 1500)
    limits = spark.createDataFrame([(1, 1024), (2, 4096)], "limit_id int, capacity_tokens int")
    packs = packing.packed(df, limits, tokens_per_shard=60_000)
    got = {(r["limit_id"], r["source"]): r for r in packing.mixture(packs).collect()}
    for limit, cap in ((1, 1024), (2, 4096)):
        p = [r for r in packs.collect() if r["limit_id"] == limit and r["container"].startswith("s-")]
        boxes, shards = defaultdict(Counter), defaultdict(set)
        for r in p:
            boxes[r["container"]][r["source"]] += r["n_tokens"]
            shards[r["container"].split("-")[1]].add(int(r["container"].split("-")[2]))
        total = sum(sum(b.values()) for b in boxes.values())
        for s in {r["source"] for r in p}:
            share, lag = sum(b[s] for b in boxes.values()) / total, 0.0
            for k, nos in shards.items():
                own = [boxes[f"s-{k}-{i}"] for i in sorted(nos)]
                want, had, all_ = sum(b[s] for b in own) / sum(sum(b.values()) for b in own), 0, 0
                for b in own:
                    had, all_ = had + b[s], all_ + sum(b.values())
                    lag = max(lag, abs(had - want * all_) / cap)
            r = got[limit, s]
            assert abs(r["target_share"] - share) < 1e-6 and r["n_without"] == sum(not any(x["container"] == c and x["source"] == s for x in p) for c in boxes)
            assert abs(r["mean_error"] - sum(abs(b[s] / max(sum(b.values()), 1) - share) for b in boxes.values()) / len(boxes)) < 1e-5
            assert abs(r["most_lag"] - lag) < 1e-3 and r["most_lag"] < 2.5
    v = {r["limit_id"]: tuple(r)[1:] for r in packing.violations(packs, df.where("n_tokens is not null")).collect()}
    assert v == {1: (1503, 0, 0, 0), 2: (1503, 0, 0, 0)}


def test_no_goal_is_exceeded(spark):
    rows = [(i, "a", 100) for i in range(50)] + [(100 + i, "b", 900 if i % 2 else 40) for i in range(30)]
    df = spark.createDataFrame(rows, SIZES)
    t = spark.createDataFrame([(1, "a", 0.7, 1), (1, "b", 0.3, 1), (2, "b", 0.5, 1), (2, "none", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int")
    draws, shares = mixing.mixture(df, t, total_tokens=5000)
    s = {(x["mix_id"], x["source"]): x for x in shares.collect()}
    assert all(x["drawn_tokens"] <= x["goal_tokens"] for x in s.values())
    assert s[1, "b"]["drawn_tokens"] >= s[1, "b"]["goal_tokens"] - 40 and (s[1, "a"]["status"], s[1, "b"]["status"]) == ("met", "met")
    assert s[2, "b"]["status"] == "over" and s[2, "b"]["deviation"] == 0.5 and s[2, "none"]["status"] == "no_documents"
    assert {(r["n_over_repeated"], r["n_foreign"]) for r in mixing.violations(draws, df, t).collect()} == {(0, 0)}


def test_packing_empty(spark):
    none, lim = spark.createDataFrame([], SIZES), spark.createDataFrame([(1, 512)], "limit_id int, capacity_tokens int")
    assert packing.packed(none, lim).count() == 0 and packing.packed(none.limit(0), lim.limit(0)).count() == 0
    aimed = packing.packed(spark.createDataFrame([(1, "a", 5), (2, "b", 5)], SIZES), lim, spark.createDataFrame([("a", 1.0)], "source string, share double"))
    assert aimed.count() == 2


def test_schedule_stays_within_a_block():
    for w in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0}, {f"s{i}": i + 0.37 for i in range(23)}, {"big": 0.999, "small": 0.00001}):
        n = mixing.units(w, 1000)
        slots = mixing.schedule(n)
        assert sum(n.values()) == 1000 and sorted(t for x in slots.values() for t in x) == list(range(1000))
        for s, x in slots.items():
            for i, t in enumerate(x, 1):
                assert (i - 1) * 1000 // n[s] <= t < -(-i * 1000 // n[s])


def test_mixture(spark):
    r = random.Random(3)
    rows = [(i, "abc"[i % 3] if i % 100 else "d", r.randrange(50, 150)) for i in range(6000)] + [(9000, "e", 0), (9001, None, 5), (9002, "f", 70)]
    df = spark.createDataFrame(rows, SIZES)
    t = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.3, 1), (1, "d", 0.2, 4), (2, "a", 0.0, 1), (2, "b", 0.6, 2), (2, "gone", 0.4, 2), (3, None, 0.5, 1), (3, "c", None, 1)], "mix_id int, source string, target_share double, max_repeats int")
    draws, shares = mixing.mixture(df, t)
    d = draws.collect()
    most = Counter((x["mix_id"], x["source"], x["doc_id"]) for x in d)
    cap = {(1, "a"): 1, (1, "b"): 1, (1, "d"): 4, (2, "b"): 2}
    assert all(n <= cap[k[:2]] for k, n in most.items()) and len(set((x["mix_id"], x["doc_id"], x["repeat"]) for x in d)) == len(d)
    s = {(x["mix_id"], x["source"]): x for x in shares.collect()}
    for k, w in (((1, "a"), 0.5), ((1, "b"), 0.3), ((1, "d"), 0.2)):
        assert abs(s[k]["reached_share"] - w) < 0.005 and s[k]["status"] == "met"
        assert s[k]["drawn_tokens"] == sum(x["n_tokens"] for x in d if (x["mix_id"], x["source"]) == k)
    assert s[2, "a"]["status"] == "zero_target" and s[2, "gone"]["status"] == "no_documents" and s[2, "b"]["reached_share"] == 1.0
    # In order, a source is never more than a block and a document off its share.
    one = sorted((x for x in d if x["mix_id"] == 1), key=lambda x: (x["slot"], x["offset"]))
    done, seen = 0, Counter()
    for x in one:
        done += x["n_tokens"]
        seen[x["source"]] += x["n_tokens"]
        assert all(abs(seen[q] - s[1, q]["reached_share"] * done) < mixing.BLOCK_TOKENS * 2 + 150 for q in "abd")


def test_mixture_with_a_fixed_total(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 1000)], SIZES)
    t = spark.createDataFrame([(1, "a", 0.5, 3), (1, "b", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int")
    s = {x["source"]: x for x in mixing.mixture(df, t, total_tokens=2000)[1].collect()}
    assert (s["a"]["status"], s["a"]["drawn_tokens"], s["a"]["n_draws"], s["b"]["drawn_tokens"]) == ("capped", 30, 3, 1000)


def test_a_tiny_source_does_not_shrink_the_registered_mix(spark, tmp_path):
    pytest.importorskip("tiktoken")
    from codeweft.llm import queries

    rows = [(i, "large", "some words of text " * 20) for i in range(40)] + [(99, "tiny", "one line")]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "large", 0.95, 1), (1, "tiny", 0.05, 4)], "mix_id int, source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    s = {x["source"]: x for x in queries.p8_shares(spark, str(tmp_path)).collect()}
    assert (s["tiny"]["status"], s["tiny"]["n_draws"], s["large"]["status"]) == ("capped", 4, "over")
    assert s["large"]["drawn_tokens"] > 0.9 * s["large"]["supply_tokens"] and s["tiny"]["reached_share"] < 0.05
    assert queries.p8_draws(spark, str(tmp_path)).where("source = 'large'").count() > 36


def test_mixture_empty(spark):
    t = spark.createDataFrame([(1, "a", 0.5, 3)], "mix_id int, source string, target_share double, max_repeats int")
    none = spark.createDataFrame([], SIZES)
    draws, shares = mixing.mixture(none, t)
    assert draws.count() == 0 and shares.first()["status"] == "no_documents"
    draws, shares = mixing.mixture(none, t.limit(0))
    assert draws.count() == 0 and shares.count() == 0


def test_tokens(spark):
    pytest.importorskip("tiktoken")
    text = "line of text\n" * 40_000
    assert tokens.count(text) == 40_000 * tokens.count("line of text\n") and tokens.count("") == 0
    df = spark.createDataFrame([(1, "a", "hello world"), (2, None, ""), (3, "b", None)], "doc_id bigint, source string, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.sized(df).collect()} == {1: 2, 2: 0}
