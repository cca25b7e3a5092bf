"""Exact search, exact and near duplicates, mixing and URL verdicts against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import chosen_path, exact_dedup, host_reputation, knn, mixing, queries
from seqloom.llm.components import connected


def brute_topk(rows, k):
    out = []
    for n, (qid, q) in enumerate(rows):
        if qid % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for m, (i, v) in enumerate(rows) if m != n and len(v) == len(q))
            out += [(qid, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("prune", [True, False])
def test_topk_with_ties_nulls_and_odd_lengths(spark, prune):
    rng = random.Random(1)
    vectors = [(i, [rng.randint(-2, 2) / 64 for _ in range(6)]) for i in range(300)]
    vectors += [(i, [0.5] * 6) for i in range(300, 420)] + [(500, [1.0, 2.0]), (505, [3.0, -1.0])]
    vectors += [(20, [0.25] * 6), (20, [0.5] * 6), (3, [9.0] * 6), (3, [9.0] * 6)]  # repeated ids ask and are found by row
    bad = [(600, None), (601, []), (605, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (610, [float("nan")] * 6), (615, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors + bad], "vec_id long, embedding array<float>, score string, no int")
    got = knn.top_k(df, F.col("vec_id") % 5 == 0, k=7, factor=64, shard_rows=60, block_rows=20, leaf=8, prune=prune).collect()
    whole = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in vectors]
    assert sorted(map(tuple, got)) == brute_topk(whole, 7)


def test_topk_prunes_pairs_before_they_are_visited(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 20
    rows = [(i, (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen, every = {}, {}
    a = knn.top_k(df, F.col("vec_id") % 20 == 0, k=5, shard_rows=100, block_rows=16, leaf=16, visits=seen)
    b = knn.top_k(df, F.col("vec_id") % 20 == 0, k=5, shard_rows=100, block_rows=16, leaf=16, prune=False, visits=every)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert every["opened"] == every["all"] == seen["all"] and seen["opened"] < 0.5 * seen["all"]


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.top_k(df, F.col("vec_id") % 5 == 0).count() == 0


def test_topk_of_a_query_with_many_rows(spark):
    rng = random.Random(3)
    vectors = [(5, [4.0 + i / 64] * 4) for i in range(40)]  # all of them score highest for each other
    vectors += [(i, [rng.randint(1, 40) / 64 for _ in range(4)]) for i in range(100, 200) if i % 5]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    want = brute_topk([(i, [int(64 * x) for x in v]) for i, v in vectors], 7)
    for shard in (1000, 30):
        found = knn.top_k(df, F.col("vec_id") % 5 == 0, k=7, factor=64, shard_rows=shard, leaf=256).collect()
        assert sorted(map(tuple, found)) == want


def test_topk_shards_are_bounded_when_rows_repeat(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") < 2500, 0.5).otherwise(F.col("id") + 0.5)).alias("embedding"))
    seen = []
    monkeypatch.setattr(knn, "materialise", lambda df, label, real=knn.materialise: (seen.append((label, real(df, label))), seen[-1][1])[1])
    knn.top_k(rows, F.col("vec_id") == 7, k=3, shard_rows=500, block_rows=300)
    made = dict(seen)
    assert made["shards"].count() >= 6 and made["blocks"].agg(F.max("n")).first()[0] < 450
    sizes = [len(knn.KDTree.load(r["tree"]).ids) for r in made["shards"].collect()]
    assert sum(sizes) == 3000 and max(sizes) < 750


def test_large_scores_stay_exact():
    v = np.array([[2**31, 2**31 - 1], [2**31 + 1, 2**31]], dtype=np.int64)
    tree = knn.KDTree(np.array([1, 2]), np.array([0, 1]), v, 1).as_type(object)
    q = v[0].astype(object)
    bounds = knn.box_bounds(q[None, :], tree.low, tree.high)[0]
    assert tree.search(q, bounds, 2, None, -np.inf)[0] == (2**31 * (2**31 + 1) + (2**31 - 1) * 2**31, -2)


WHITE = re.compile("[\x20\x09-\x0d]")


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(2)
    base = ["alpha beta", "", "x y", "Ünï", "long " * 500]
    rows = [(i, rng.choice(base).replace(" ", rng.choice([" ", "  ", "\t", "\n"])), f"d{i}", i) for i in range(150)]
    rows += [(1000 + i, None, None, None) for i in range(3)] + [(2000 + i, "hot copy", "h", 1) for i in range(120)] + [(None, "nobody", "n", 0), (5000, f"only {rng.random()}", "o", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, keep_id int")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((i, t or ""))
    for capacity in (4, 1023):  # with and without heavy hitters at this size
        got = {r["doc_id"]: r for r in exact_dedup.dedup_map(df, capacity=capacity).collect()}
        assert len(got) == len(rows)
        for norm, members in groups.items():
            keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
            for i, _ in members:
                r = got[i]
                assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(members), i == keep)
                assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()


def test_one_row_of_a_group_is_kept(spark):
    rows = [(9, "a  b"), (9, "a b"), (4, "ab"), (9, "a  b"), (None, "a  b"), (2, None), (2, ""), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for capacity in (1, 1023):
        got = exact_dedup.dedup_map(df, capacity=capacity).collect()
        assert len(got) == len(rows)
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["kept"]) == [(2, 2, 3), (9, 9, 5)]
        kept = exact_dedup.drop_copies(df, capacity=capacity).collect()
        assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(2, ""), (9, "a  b")]
    assert exact_dedup.dedup_map(df.where("false")).count() == 0


def test_drop_copies_keeps_one_row_each(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, "ab", "t"), (3, None, "u"), (4, "", "v"), (None, "q", "w"), (5, "other", "x"), (5, "different", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in exact_dedup.drop_copies(df).collect())
    assert got == [(0, "q"), (1, "a b"), (3, ""), (5, "different"), (5, "other")]
    assert exact_dedup.drop_copies(df.where("false")).count() == 0


def grams(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(rows):
    sets = [(i, grams(t)) for i, t in rows]
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i, _ in rows}


def near_copies(seed, groups=6, size=14):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    rows, n = [], 0
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 200]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    shared = " ".join(rng.choice(words) for _ in range(12))
    for _ in range(60):  # a passage that many unlike documents share
        rows.append((n, shared + " " + " ".join(rng.choice(words) for _ in range(40))))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "one two"), (n + 4, "Two one"), (n + 5, "ONE, two!")]


@pytest.mark.parametrize(("limit", "grams_a_block"), [(1024, 400_000), (8, 400)])
def test_jaccard_links_against_brute_force(spark, limit, grams_a_block):
    rows = near_copies(4)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, rep int")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_links(df, bucket_limit=limit, block_grams=grams_a_block).collect()}
    assert got == brute_links(rows)


def test_jaccard_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_links(docs).collect()}
    assert got == brute_links(rows)
    kept = {r["doc_id"] for r in chosen_path.keep_one(docs).collect()}
    assert kept == {c for c, _ in got.values()}


def test_keep_one_of_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    near = b + " end"
    rows = [(5, a, "x"), (5, b, "y"), (3, near, "z"), (None, a + " last", "n"), (None, "quite another text of one two three", "m"), (7, None, "e"), (7, "", "f"), (8, "...", "g"), (9, a, "h"), (5, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = sorted(((r["doc_id"], r["root"]) for r in chosen_path.keep_one(df).collect()), key=str)
    # One row of each group of copies; a text without a copy stays, whatever its id.
    assert sorted([(5, "x"), (3, "z"), (None, "m"), (8, "g")], key=str) == [g for g in got if g[0] != 7]
    assert len(got) == 5
    links = chosen_path.jaccard_links(df).collect()
    assert len(links) == len(rows) and sum(r["n_links"] for r in links) == 4 * 3 + 2


def test_a_large_family_is_split_and_found(spark):
    """Recursion: a family above the bucket limit whose members drift across the pivot's radius."""
    rng = random.Random(9)
    now = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for k in range(400):
        now = list(now)
        now[rng.randrange(150)] = f"n{k}"
        rows.append((k, " ".join(now)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_links(df, bucket_limit=32).collect()}
    want = brute_links(rows)
    lost = sum(want[i][1] - got[i][1] for i in want)
    assert lost == 0 and got == want


def test_jaccard_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert chosen_path.jaccard_links(df).count() == 0
    assert chosen_path.keep_one(df).count() == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (7, 7), (3, 5), (20, 9), (1, None)] + [(i + 1, i) for i in range(100, 140)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {5: 3, 4: 3, 3: 3, 9: 8, 8: 8, 20: 8, 7: 7} | {i: 100 for i in range(100, 141)}
    assert got == want


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("d1", "en", "a", 100, 10), ("d1", "en", "b", 1000, 10), ("d1", "de", "c", 50, 10), ("d2", "en", "d", 5000, 10)],
        "domain string, lang string, source string, leaf_tokens long, leaf_rows long",
    )
    tree = ["domain", "lang", "source"]
    got = {r["source"]: r["given"] for r in mixing.leaf_budgets(leaves, tree, {"domain": {"d1": 1, "d2": 1}}, 2000, 1).collect()}
    # d1 and d2 get 1000 each; de can take 50 of 500, en takes its 450; a gives 100, b takes the rest.
    assert got == {"a": 100, "b": 850, "c": 50, "d": 1000}
    more = {r["source"]: r["given"] for r in mixing.leaf_budgets(leaves, tree, {}, 4000, 1).collect()}
    assert more == {"a": 100, "b": 1000, "c": 50, "d": 2850}  # d1 is full, the rest goes to d2
    assert sum(r["given"] for r in mixing.leaf_budgets(leaves, tree, {}, 10**9, 2).collect()) == 2 * 6150


def test_mix_is_a_seeded_prefix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["x", "y", None]), "hot" if i % 3 else f"s{i % 7}", rng.randint(0, 40)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_tokens int")
    got = mixing.mix(df, ["lang", "source"], {"lang": {"x": 3}}, budget=9000, max_epochs=2, bucket_rows=16).collect()
    totals, taken = {}, {}
    for _, lang, s, n in rows:
        totals[lang or "(none)", s] = totals.get((lang or "(none)", s), 0) + n
    for r in got:
        key = (r["lang"], r["source"])
        taken[key] = taken.get(key, 0) + r["tokens_taken"]
        assert r["copies"] in (1, 2, 3) and r["tokens_taken"] <= r["copies"] * r["n_tokens"]
    assert all(v <= 2 * totals[k] for k, v in taken.items())
    assert sum(taken.values()) == 9000  # what rounding leaves goes to the largest remainders
    again = mixing.mix(df.repartition(5), ["lang", "source"], {"lang": {"x": 3}}, budget=9000, max_epochs=2, bucket_rows=16)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    assert mixing.mix(df.where("false"), ["lang", "source"], {}).count() == 0


def test_mix_of_repeated_ids_and_nulls(spark):
    rows = [(1, "x", "s", n % 5, "q") for n in range(400)] + [(None, "x", "s", 3, "q")] * 200 + [(k, "x", "s", None, "q") for k in range(2, 9)] + [(k, "y", None, 7, "q") for k in range(9, 60)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_tokens int, copies string")
    got = mixing.mix(df, ["lang", "source"], {"lang": {"x": 2}}, budget=900, max_epochs=1, bucket_rows=16).collect()
    assert sum(r["tokens_taken"] for r in got) == 900
    assert all(r["copies"] == 1 and r["tokens_taken"] <= r["n_tokens"] for r in got)
    assert sum(r["tokens_taken"] < r["n_tokens"] for r in got) <= 2  # one prefix end a leaf
    assert mixing.mix(df, ["lang", "source"], {}, budget=10**6, max_epochs=3).agg(F.sum("tokens_taken")).first()[0] == 3 * (800 + 600 + 357)


URLS = [
    ("https://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("https://a.example.net/EN/x", "a.example.net", "/EN/x", "net/", "block"),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://badexample.com/de/", "badexample.com", "/de/", None, None),
    ("ftp://x.org/fr/a#b", "x.org", "/fr/a", "org/fr/", "allow"),
    ("http://x.net", "x.net", "", None, None),
    ("http://h?u=http://y.net/", "h", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("://net/a", "net", "/a", "net/", "block"),
    ("http://ÀB.org:80/fr/", "Àb.org:80", "/fr/", None, None),
]
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, bad int")
    got = {r["page_id"]: r for r in host_reputation.judge_urls(pages, none, RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), URLS[i]
        assert r["verdict"] == (verdict or "allow")
    assert host_reputation.judge_urls(pages.where("false"), none, RULES).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    outcomes = [(f"http://bad.d{k % 2}.com/{k}", 1) for k in range(60)] + [(f"http://good{k % 3}.d2.com/{k}", 0) for k in range(60)]
    outcomes += [("http://new.d2.com/1", 1), ("http://x.d2.com/1", None)]
    pages = [(1, "http://bad.d0.com/q"), (2, "http://good1.d2.com/q"), (3, "http://new.d2.com/q"), (4, "http://other.d0.com/q"), (5, "http://a.zz/q")]
    got = {
        r["page_id"]: r
        for r in host_reputation.judge_urls(
            spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "url string, bad int"), []
        ).collect()
    }
    assert got[1]["verdict"] == "block" and got[2]["verdict"] == "allow"
    assert got[3]["verdict"] == "allow" and 0 < got[3]["mean"] < 1  # one bad page is not enough
    assert got[4]["level"] == "domain" and got[4]["mean"] > 0.5
    assert got[5]["level"] == "all"


def test_keys_of_hosts(spark):
    hosts = [("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("u:p@b.com.:8080", "b.com", "com"), ("10.0.0.4:80", "10.0.0.4", "(address)"), ("[::1]:80", "[::1]", "(address)"), ("", "", ""), ("x", "x", "x"), ("b.com:", "b.com", "com")]
    df = spark.createDataFrame(hosts, "h string, d string, s string").withColumn("k", host_reputation.host_key(F.col("h")))
    for r in df.select("d", "s", host_reputation.registered_domain(F.col("k"), ["co.uk"]).alias("d2"), host_reputation.public_suffix(F.col("k"), ["co.uk"]).alias("s2")).collect():
        assert (r["d"], r["s"]) == (r["d2"], r["s2"])


@pytest.mark.parametrize("share", [2, 6])
def test_verdicts_do_not_depend_on_the_overall_rate(spark, share):
    """Clean hosts stay and bad ones go, whether most hosts are clean or most are bad."""
    outcomes = [(f"http://h{k}.d{k % 3}.com:8080/{j}", int(k < share)) for k in range(8) for j in range(15)]
    pages = [(k, f"http://h{k}.d{k % 3}.com/new") for k in range(8)] * 2 + [(99, "http://h0.d0.com/" + "x" * 100_000)]
    got = host_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "url string, bad int"), []).collect()
    assert len(got) == 17
    assert all((r["verdict"] == "block") == (r["page_id"] < share or r["page_id"] == 99) for r in got)


def test_many_queries_find_what_each_finds_alone():
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, size=(700, 4))
    v[100:400] = v[100]  # ties in whole leaves
    ids = rng.permutation(700)
    tree = knn.KDTree(ids, np.arange(700), v, 32).as_type(np.float64)
    q = v[rng.integers(0, 700, 90)].astype(float)
    own = np.arange(90)
    floors = np.where(np.arange(90) % 3 == 0, 5.0, -np.inf)
    bounds = knn.box_bounds(q, tree.low, tree.high)
    asks, scores, found = tree.search_many(q, bounds, 6, own, floors)
    for i in range(90):
        alone = tree.search(q[i], bounds[i], 6, int(own[i]), floors[i])
        assert [(s, -n) for s, n in zip(scores[asks == i].tolist(), found[asks == i].tolist())] == alone
