"""Merkle manifests, hard negatives and chat formatting against brute force."""

import hashlib
import json
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import chat, hard_negatives, merkle, queries
from seqloom.llm.ranking import positions

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, hash string, n long, kids int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha(*map(one, (doc_id, source, lang, n_chars, text)))


def climb(nodes, i):
    """Root over ``nodes`` and the (left, right) siblings of node ``i``."""
    steps = []
    while len(nodes) > 1:
        at = i // 3 * 3
        run = nodes[at : at + 3]
        steps.append((run[: i - at], run[i - at + 1 :]))
        nodes = [sha(*nodes[j : j + 3]) for j in range(0, len(nodes), 3)]
        i //= 3
    return nodes[0], steps


def brute_manifest(rows):
    by_source = {}
    for doc_id, text, lang, source, n_chars in rows:
        by_source.setdefault(source, []).append((doc_id, leaf_of(doc_id, source, lang, n_chars, text), lang, n_chars, text))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for v in by_source.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    subroots = [climb([r[1] for r in by_source[s]], 0)[0] for s in order]
    out = []
    for at, s in enumerate(order):
        leaves = [r[1] for r in by_source[s]]
        root, above = climb(subroots, at)
        for i, (doc_id, leaf, lang, n_chars, text) in enumerate(by_source[s]):
            _, steps = climb(leaves, i)
            steps = steps + above
            now = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
                now = leaf_of(doc_id, s, lang, n_chars, text.replace("\n", ""))
            for left, right in steps:
                now = sha(*left, now, *right)
            out.append((doc_id, leaf, subroots[at], root, sha(*[x for a, b in steps for x in (*a, *b)]), now, now == root))
    return sorted(map(repr, out))


def manifest_of(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    return sorted(repr(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))) for r in got)


def test_manifest_with_trees_of_all_shapes(spark, tmp_path):
    rows, no = [], 0
    for s, size in [(None, 5), ("", 1), ("a", 2), ("b", 3), ("ä", 4), ("B", 9), ("c", 10), ("d", 27), ("e", 81), ("f", 82), ("g", 300), ("z", 1)]:
        for _ in range(size):
            no += 7
            rows.append((no * 7919 % 5000, f"line {no}\nnext\n" if no % 3 else "kept", "de" if no % 2 else None, s, no if no % 5 else None))
    rows += [(None, "no id\n", "en", "g", 1), (None, "no id\n", "en", "g", 1), (77, None, None, "b", None), (78, "", None, "b", 0), (79, "long\n" * 200_000, "en", "c", 9)]
    rows += [(5, "same\n", "fr", "f", 1)] * 6  # repeated rows are leaves of their own
    assert manifest_of(spark, tmp_path, rows) == brute_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(3, "one\n", "en", None, 1)], [(i, "x", "en", "s", i) for i in range(4)]])
def test_manifest_of_few_rows(spark, tmp_path, rows):
    assert manifest_of(spark, tmp_path, rows) == brute_manifest(rows)


def test_manifest_of_many_trees(spark, tmp_path):
    rows = [(i, f"t{i}\n", None, f"s{i % 130}", None) for i in range(260)]
    assert manifest_of(spark, tmp_path, rows) == brute_manifest(rows)


def test_blocks_agree_with_single_levels():
    for n in (1, 2, 3, 4, 26, 27, 28, 80, 81):
        nodes = [sha(str(i)) for i in range(n)]
        steps = merkle.block_steps(nodes, merkle.height(n))
        for i in range(n):
            root, want = climb(nodes, i)
            assert steps[i] == ["".join(a) + "." + "".join(b) for a, b in want]
            assert merkle.levels_of(nodes, merkle.height(n))[-1] == [root]


def test_positions_of_a_hot_group(spark):
    rows = [("hot", 1)] * 500 + [("hot", i) for i in range(300)] + [("a", None), ("a", 2), ("b", 5)]
    got = positions(spark.createDataFrame(rows, "g string, x int").repartition(5), ["g"], ["x"], "t").collect()
    for g in ("hot", "a", "b"):
        mine = sorted((r["pos"], r["x"]) for r in got if r["g"] == g)
        want = sorted((x for k, x in rows if k == g), key=lambda x: (x is not None, x or 0))
        assert [p for p, _ in mine] == list(range(len(want))) and [x for _, x in mine] == want
        assert {r["n"] for r in got if r["g"] == g} == {len(want)}


def brute_negatives(rows, is_anchor, positives=5, negatives=3):
    out = []
    for a, (aid, av, al) in enumerate(rows):
        if not is_anchor(aid):
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i, label) for b, (i, v, label) in enumerate(rows) if b != a and len(v) == len(av)]
        for p, pid, _ in sorted(s for s in scored if s[2] == al)[:positives]:
            fit = sorted((s, i) for s, i, label in scored if label != al and Fraction(-p, 2) <= -s <= Fraction(-95 * p, 100))
            out += [(aid, pid, r, i, -p, -s) for r, (s, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("bucket", [None, 7, 60])
def test_negatives_with_ties_nulls_and_odd_lengths(spark, bucket):
    rng = random.Random(4)
    rows = [(i, [rng.randint(-3, 9) / 256 for _ in range(5)], rng.randint(0, 2)) for i in range(240)]
    rows += [(i, [0.25] * 5, i % 2) for i in range(300, 360)]  # ties of equal vectors
    rows += [(10, [0.5] * 5, 1), (10, [0.5] * 5, 1), (11, [0.1, 0.2], 0), (20, [0.2, 0.1], 0), (21, [0.1, 0.1], 1), (30, [0.0] * 5, 0), (40, [-0.5] * 5, 2)]
    bad = [(600, None, 1), (610, [], 1), (620, [1.0, None, 0, 0, 0], 1), (630, [float("nan")] * 5, 1), (640, [float("inf")] * 5, 1), (650, [1.0] * 5, None), (None, [1.0] * 5, 1)]
    df = spark.createDataFrame([(i, [None if x is None else float(x) for x in v] if v is not None else None, c, "x", 1.0, 2) for i, v, c in rows + bad], "vec_id long, embedding array<double>, label int, bucket string, norm double, row int")
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), bucket_rows=bucket).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v], c) for i, v, c in rows]
    assert sorted(map(tuple, got)) == brute_negatives(whole, lambda i: i % 10 == 0)


def test_negatives_prune_buckets_by_norm(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * 2.0 ** (i % 9)).tolist(), int(i % 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    seen = {}
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label"), bucket_rows=20, visits=seen).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v], c) for i, v, c in rows]
    assert sorted(map(tuple, got)) == brute_negatives(whole, lambda i: i % 100 == 0)
    assert 0 < seen["opened"] < 0.75 * 2 * seen["all"]


def test_negatives_of_large_scores_and_of_nothing(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(0, [2.0**22, 3.0], 1), (1, [2.0**22, 1.0], 1), (2, [2.0**22 * 0.9, 5.0], 2), (3, [2.0**22 * 0.95, 0.0], 2), (4, [2.0**21, 0.0], 2), (5, [2.0**21 - 1, 0.0], 2)]
    got = hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") == 0, F.col("label")).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v], c) for i, v, c in rows]
    assert sorted(map(tuple, got)) == brute_negatives(whole, lambda i: i == 0)
    empty = spark.createDataFrame([], schema)
    assert hard_negatives.mine(empty, F.col("vec_id") == 0, F.col("label")).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1)], schema)
    assert hard_negatives.mine(one, F.col("vec_id") == 0, F.col("label")).count() == 0


RECORDS = [
    ({"role": "user", "text": "a"}, "row", [("user", "a")]),
    ({"role": "human", "text": "a"}, "row", [("human", "a")]),
    ({"role": "human", "content": None}, "message", [("user", "")]),
    ({"from": "gpt", "value": "v"}, "speaker", [("assistant", "v")]),
    ({"id": 3, "messages": [{"role": "user", "content": "q"}, {"content": "r", "role": "bot"}]}, "messages", [("user", "q"), ("assistant", "r")]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}, "message_parts", [("user", "xy")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "system", "value": "s"}]}, "conversations", [("user", "h"), ("system", "s")]),
    ({"prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]),
    ({"system": "s", "prompt": "p", "response": None}, "prompt", [("system", "s"), ("user", "p"), ("assistant", "")]),
    ({"prompt": "p", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"output": "o"}, "instruction", [("assistant", "o")]),
    ({"history": [{"user": "u1", "assistant": "a1"}, {"user": "u2", "assistant": "a2"}]}, "pairs", [("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2")]),
    ({"something": {"else": 1}}, None, [(None, None)]),
    ({}, None, [(None, None)]),
]


def test_layouts_are_found_by_fingerprint(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(900, None), (901, "no json"), (902, "[1]"), (None, '{"output": "o"}')]
    got = {}
    for r in chat.canonical_turns(spark.createDataFrame(rows, "id long, rec string"), ["id"], "rec").orderBy("id", "part").collect():
        got.setdefault(r["id"], []).append((r["layout"], r["role"], r["text"]))
        assert (r["fingerprint"] is None) == (r["id"] in (900, 901, 902))
    for i, (_, name, turns) in enumerate(RECORDS):
        assert got.get(i, []) == [(name, *t) for t in turns], RECORDS[i]
    assert got[None] == [("instruction", "assistant", "o")] and all(got[i] == [(None, None, None)] for i in (900, 901, 902))


def test_fingerprints_of_layouts_do_not_meet():
    owner = {}
    for layout in chat.LAYOUTS:
        for mark in layout.fingerprints():
            owner.setdefault(mark, []).append(layout.name)
    shared = {tuple(v) for v in owner.values() if len(v) > 1}
    assert shared <= {("prompt", "completion"), ("messages", "message_parts")}  # a prompt alone, a list without elements
    assert chat.fingerprint_of(chat.field_paths({"a": {"b": 1, "c": [{"d": 1}, {"e": 2}]}})) == chat.fingerprint_of({"a.b", "a.c[].d", "a.c[].e"})


_nasty = st.lists(st.sampled_from(["<", "|", "\\", ">", "im_end", "<|im_start|>", "<|im_end|>", "\n", "a", "é", "😀", "\\n"]), max_size=12).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]) | _nasty, _nasty), min_size=1, max_size=30))
def test_marked_text_reads_back(spark, turns):
    df = spark.createDataFrame([(i, r, t) for i, (r, t) in enumerate(turns)], "i long, role string, text string")
    out = chat.format_turns(df, ["i"])
    segments = {r["i"]: r for r in out.collect()}
    back = {r["i"]: r for r in chat.read_turns(out).collect()}
    for i, (role, text) in enumerate(turns):
        seg = segments[i]["segment"]
        assert (back[i]["role"], back[i]["text"]) == (role, text) and len(seg) == back[i]["n_chars"]
        assert seg.count("<|") == 2 and seg.startswith("<|im_start|>") and seg.endswith("<|im_end|>\n")
        assert (back[i]["learnt"] or "") == (text if role == "assistant" else "")
        at, n = segments[i]["loss_start"], segments[i]["loss_length"]
        assert n == 0 or seg[at : at + n] + "<|im_end|>\n" == seg[at:]


def test_conversations_with_nulls_ties_and_long_turns(spark, tmp_path):
    long = "words <| and more\n" * 100_000
    rows = [(1, 0, "user", None), (1, 1, "assistant", "A<|im_end|>"), (1, 1, "assistant", "B"), (1, None, "system", "first"), (2, 0, None, "x"), (2, 1, "assistant", long), (2, 2, "assistant", None)]
    rows += [(None, 0, "user", "n"), (None, 0, "user", "n"), (3, 5, "human", "h"), (3, 6, "gpt", "g"), (5, 1, "a\nb\\", "t"), (6, 0, "user", "u"), (6, 1, "assistant", "v"), (7, 0, "user", "i"), (7, 1, "assistant", "o")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, part int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op13_chat_formatting(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        learnt = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == sha(*[f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine])
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learnt), sha(learnt))


def test_conversations_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["conv_id"] for r in queries.op13_chat_formatting(spark, str(tmp_path)).collect()] == [-1]


def test_segments_without_marks_raise(spark):
    df = spark.createDataFrame([("no marks", 0, 0)], "segment string, loss_start int, loss_length int")
    with pytest.raises(Exception, match="no turn"):
        chat.read_turns(df).collect()


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_hard_negatives", "op13_chat_formatting"])
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(*want.columns).toPandas().values.tolist())) == sorted(map(str, want.df().values.tolist()))
