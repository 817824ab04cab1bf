"""Corpus operators against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import leakage, quantiles, queries
from sedimenta.llm.cooccurrence import cooccurrence
from sedimenta.llm.leakage import leaks
from sedimenta.llm.mixture import cell_weights, mixture, rake, reached_shares, token_count


def brute_pairs(rows):
    per, both = defaultdict(set), defaultdict(set)
    for r, items in rows:
        if r is None or items is None:
            continue
        clean = sorted({x.strip().lower() for x in items if x and x.strip()})
        for x in clean:
            per[x].add(r)
        for a, b in combinations(clean, 2):
            both[a, b].add(r)
    n = len(set().union(*per.values())) if per else 0
    return {(a, b): (len(per[a]), len(per[b]), len(s), n) for (a, b), s in both.items()}


def test_stripes_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5, None]), rng.choice([None, [], [rng.choice(["a", " A ", "b", "", None, "c", "d"]) for _ in range(rng.randint(1, 5))]])) for _ in range(120)]
    df = spark.createDataFrame([(r, i, "clash") for r, i in rows], "q bigint, tags array<string>, item_a string")
    got = {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, r.n) for r in cooccurrence(df, "q", "tags").collect()}
    want = brute_pairs(rows)
    assert got == want
    cut = {(r.item_a, r.item_b) for r in cooccurrence(df, "q", "tags", min_count=3, min_lift=1.1).collect()}
    assert cut == {p for p, (a, b, ab, n) in want.items() if ab >= 3 and ab * n / (a * b) >= 1.1}
    assert cooccurrence(df.limit(0), "q", "tags").count() == 0


def test_likelihood_ratio(spark):
    df = spark.createDataFrame([(i, ["x", "y"]) for i in range(10)] + [(i, ["z"]) for i in range(10, 20)], "q bigint, t array<string>")
    (r,) = cooccurrence(df, "q", "t").collect()
    assert abs(r.llr - 40 * math.log(2)) < 1e-9 and r.lift == 2


def test_percentiles_within_the_stated_error_and_mergeable(spark):
    rng = random.Random(6)
    rows = [(f"g{i % 2}", i % 5, rng.lognormvariate(1, 2)) for i in range(20_000)] + [("g0", 1, None), ("g0", 1, float("nan")), ("empty", 0, None), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    ranks = {"p10": 0.1, "p50": 0.5, "p99": 0.99, "lo": 0.0, "hi": 1.0}
    whole = quantiles.percentiles(quantiles.sketch(df, ["g"], "v"), ["g"], ranks).collect()
    daily = quantiles.percentiles(quantiles.merge(quantiles.sketch(df, ["g", "day"], "v"), ["g"]), ["g"], ranks).collect()
    for result in (whole, daily):
        by = {r.g: r for r in result}
        assert by["empty"].p50 is None and by["empty"].n_null == 1 and by[None].p50 == 1.0 and by["g0"].n_null == 2
        for g in ("g0", "g1"):
            values = sorted(v for k, _, v in rows if k == g and v is not None and not math.isnan(v))
            for name, q in ranks.items():
                if 0 < q < 1:
                    rank = sum(v <= by[g][name] for v in values) / len(values)
                    assert abs(rank - q) <= 2 * quantiles.rank_error()
            assert (by[g].lo, by[g].hi) == (values[0], values[-1])
    assert quantiles.sketch(df.limit(0), ["g"], "v").count() == 0


def brute_leaks(docs, items):
    def words(t):
        return re.findall(r"[^\W_]+", re.sub(r"</?[A-Za-z][^<>]*>", " ", t or "").lower())

    def grams(t):
        w = words(t)
        return {tuple(w[i : i + 10]) for i in range(len(w) - 9)}

    known = [(i, grams(t)) for i, t in items if i is not None]
    return sorted((d, i) for d, t in docs if d is not None for i, g in known if g & grams(t))


def test_leaks_equal_all_windows(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 40)))) for i in range(12)] + [(None, "w1 " * 20), (99, None), (98, ""), (97, "too short"), (96, "w1 " * 30)]
    docs = []
    for d in range(60):
        own = rng.choices(vocab + ["noise"] * 4, k=rng.randint(0, 60))
        if rng.random() < 0.6:
            w = rng.choice(items[:12])[1].split()
            at = rng.randint(0, max(0, len(w) - 8))
            part = [x.upper() if rng.random() < 0.3 else x for x in w[at : at + rng.randint(7, 14)]]
            own[len(own) // 2 : 0] = part
        docs.append((d, rng.choice([", ", " ", " - ", "<b>x</b> "[:0] + "\n"]).join(own)))
    docs += [(None, "w1 " * 20), (100, None), (101, ""), (102, "<p>" + " <i>".join(["w1"] * 40) + "</p>"), (102, "w1 " * 12)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted({(r.doc_id, r.item_id) for r in leaks(df, it).collect()})
    assert got == sorted(set(brute_leaks(docs, items))) and got
    assert leaks(df.limit(0), it).count() == 0 and leaks(df, it.limit(0)).count() == 0
    with pytest.MonkeyPatch.context() as m:  # the way for many items
        m.setattr(leakage, "BROADCAST_ROWS", 0)
        assert sorted({(r.doc_id, r.item_id) for r in leaks(df, it).collect()}) == got


def test_both_texts_of_a_repeated_item_and_document_count(spark):
    one, two = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x y {one}"), (2, f"{two} z"), (3, "x " * 30), (3, two)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, one), (7, two), (8, two)], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.matches, r.first_word) for r in leaks(docs, items).collect())
    assert got == [(1, 7, 3, 2), (2, 7, 3, 0), (2, 8, 3, 0), (3, 7, 3, 0), (3, 8, 3, 0)]


def test_raking_meets_margins_and_caps():
    cells = {("a", "en", ""): 100.0, ("a", "de", ""): 50.0, ("b", "en", ""): 30.0, ("b", "de", ""): 10.0}
    w = rake(cells, [{"a": 60, "b": 60}, {"en": 90, "de": 30}, {}], dict.fromkeys(cells, 5.0))
    got = Counter()
    for c, t in cells.items():
        got[c[0]] += w[c] * t
        got[c[1]] += w[c] * t
    assert all(abs(got[k] - v) < 1e-3 for k, v in {"a": 60, "b": 60, "en": 90, "de": 30}.items())
    capped = cell_weights({("a", "x", ""): 100.0, ("b", "x", ""): 10.0}, {"a": (0.5, 1), "b": (0.5, 2), "none": (0.2, 1)}, None)
    assert capped == pytest.approx({("a", "x", ""): 0.2, ("b", "x", ""): 2.0})
    assert cell_weights({}, {"a": (1.0, 1)}, None) == {}


def test_raking_of_many_cells_is_fast():
    import time

    rng = random.Random(4)
    cells = {(f"s{i}", f"l{j}", f"t{k}"): rng.uniform(1, 100) for i in range(20) for j in range(500) for k in range(10)}
    whole = sum(cells.values())
    margins = [{f"s{i}": whole / 20 for i in range(20)}, {f"l{j}": whole / 500 for j in range(500)}, {f"t{k}": whole / 10 for k in range(10)}]
    began = time.perf_counter()
    w = rake(cells, margins, dict.fromkeys(cells, 3.0))
    assert time.perf_counter() - began < 30
    for i, m in enumerate(margins):
        got = Counter()
        for c, t in cells.items():
            got[c[i]] += w[c] * t
        assert all(abs(got[v] - x) < 1e-3 * x for v, x in m.items())


def test_a_rare_language_gets_its_share(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", f"l{i % 500}", 10) for i in range(20_000)], "doc_id bigint, source string, lang string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    taken = mixture(docs, targets, total=100_000.0, language_share={"l499": 0.004, "l3": 0.001}).join(docs.select("doc_id", "lang"), "doc_id")
    got = {r.lang: r.t for r in taken.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    assert abs(got["l499"] - 400) <= 20 and abs(got.get("l3", 0) - 100) <= 20 and len(got) == 500


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["big"] * 8 + ["mid", "mid", "small", None, "other"]), rng.choice(["en", "es", None]), rng.randint(1, 400)) for i in range(4000)]
    docs = spark.createDataFrame(rows + [(None, "big", "en", 5), (9999, "big", "en", 0), (9998, "big", "en", None)], "doc_id bigint, source string, lang string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    taken = mixture(docs, targets).cache()
    shares = {r.source: r for r in reached_shares(taken, targets).collect()}
    for s, want in (("big", 0.4), ("mid", 0.3), ("small", 0.2)):
        assert abs(shares[s].share - want / 0.9) < 0.01
    assert shares["absent"].share == 0 and shares["small"].max_copies <= 3 and shares["mid"].max_copies <= 2 and shares["big"].max_copies == 1
    again = mixture(docs, targets)
    assert taken.exceptAll(again).count() == 0  # the same seed takes the same
    assert mixture(docs.limit(0), targets).count() == 0


def test_tokens_are_those_of_the_public_vocabulary(spark):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    texts = ["Hello world's  42 naïve\n\n  x_y", "", None, "ы 日本語 🎉"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(token_count(F.col("t")).alias("n")).collect()]
    assert got == [len(ref.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]


def shown(df):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_stripes_travel_by_item_and_segment_and_are_merged_there(spark, sf):
    plan = shown(queries.p4_found(spark, sf))
    tail = plan[plan.index("(1)") :] if "(1)" in plan else plan
    assert "hashpartitioning(item_a#" in tail and re.search(r"hashpartitioning\(item_a#\d+, segment#\d+", tail) and not re.search(r"hashpartitioning\(item_a#\d+, item_b#\d+", tail)


@pytest.mark.parametrize("name", ["p4_found", "p7_percentiles"])
def test_no_cross_join(spark, sf, name):
    plan = shown(queries.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
