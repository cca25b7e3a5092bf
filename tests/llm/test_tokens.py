"""Token counts, packing and record files against the libraries themselves."""

import base64
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import mixing, packing, queries, records, token_counts, tokenizing
from seqloom.llm.tokenizing import fast_ids, sentencepiece_model, tokenizer

TEXTS = [
    None,
    "",
    "plain words, and more.",
    "two  spaces\n\nand\tbreaks  ",
    "Ünïcode 漢字 ﬁ Ａ² x_y don't we'll",
    "<|endoftext|> inside <s> text",
    "a" * 700,
    "word " * 3000,
    ("Été à la plage, 12345 fois.\n" * 900),
    "▁ meta ▁▁ mixed  with ▁ spaces " * 300,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(None, "no id", "y", 1), (3, TEXTS[3], "z", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int").repartition(3)


def ids_of(text):
    return tokenizer(queries.BYTE_BPE).encode(text or "", add_special_tokens=False).ids


def test_counts_equal_library_with_any_chunk(docs):
    sp = sentencepiece_model(queries.PIECE_MODEL)
    for chunk, overlap in ((64, 8), (500, 40), (32768, 1024)):
        for r in token_counts.count_tokens(docs.where("doc_id is not null"), queries.PIECE_MODEL, chunk_bytes=chunk, overlap_bytes=overlap).collect():
            text = TEXTS[r["doc_id"]] or ""
            assert r["n_tokens"] == len(sp.encode(text)), (chunk, r)
            assert r["n_bytes"] == len(text.encode())


@pytest.mark.parametrize("name", [queries.PIECE_MODEL, queries.BYTE_BPE])
def test_spliced_ids_equal_whole(name):
    enc = token_counts.ChunkedEncoder(name, 200, 16)
    for text in TEXTS[2:]:
        ids, chunks, _ = enc.encode(text)
        assert ids == enc.lib.ids([text])[0]
    assert enc.encode("word " * 3000)[1] > 10
    # no boundary at all: widened to the whole text
    ids, _, widened = enc.encode("a" * 900)
    assert ids == enc.lib.ids(["a" * 900])[0] and widened > 0
    rng = random.Random(4)
    letters = "abc XYZ 019 .,-_▁  \n\téàß漢字かな한글𠀀ａ́ 'st"
    for _ in range(400):
        some = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
        text = "".join(rng.choice(some) for _ in range(rng.randint(200, 1500)))
        assert enc.encode(text)[0] == enc.lib.ids([text])[0]


def test_long_texts_without_spaces_take_linear_time():
    enc = token_counts.ChunkedEncoder(queries.PIECE_MODEL, 32_768, 1_024)
    rng = random.Random(5)
    for text in (base64.b64encode(rng.randbytes(6_000_000)).decode(), "".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range(500_000)), "a" * 500_000):
        began = time.perf_counter()
        whole = enc.lib.ids([text])[0]
        middle = time.perf_counter()
        ids, chunks, _ = enc.encode(text)
        assert ids == whole
        assert time.perf_counter() - middle < 3 * (middle - began) + 3  # slack for a busy machine


def test_fast_ids_equal_library(spark, sf):
    texts = [t for t in TEXTS] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for text in texts:
        assert np.frombuffer(fast_ids(queries.BYTE_BPE, text), "<u4").tolist() == ids_of(text)


def test_counts_query_on_whole_table(spark, sf):
    sp = sentencepiece_model(queries.PIECE_MODEL)
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_token_counts(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        n = len(sp.encode(text[r["doc_id"]]))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 4096)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert token_counts.count_tokens(none, queries.PIECE_MODEL).count() == 0
    assert packing.pack(packing.token_pieces(none, queries.BYTE_BPE)).count() == 0
    assert records.read_token_records(records.write_token_records(none, queries.BYTE_BPE)).count() == 0


def check_packing(rows, text_of, size):
    seqs = {}
    per_doc = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        per_doc.setdefault(r["doc_id"], []).append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    for doc, pieces in per_doc.items():
        ids = ids_of(text_of[doc]) + [0]
        pieces.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        at = 0
        for k, p in enumerate(pieces):
            assert p["start"] == at and (k == 0 or p["length"] == size)
            part = np.array(ids[at : at + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids)
        assert len(pieces) == -(-len(ids) // size)
    return len(seqs)


def test_packing_whole_table(spark, sf):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op6_best_fit_packing(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(text)
    n = check_packing(rows, text, 2048)
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert n <= least + 2


def test_packing_nulls_and_repeats(docs):
    pieces = packing.token_pieces(docs, queries.BYTE_BPE, 64)
    rows = packing.pack(pieces.withColumn("offset", F.lit("old")), 64).collect()
    assert sum(r["doc_id"] is None for r in rows) >= 1
    assert sum(r["doc_id"] == 0 for r in rows) == 1  # a null text is one end token
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_sum_of_squares_is_the_rule():
    rng = np.random.default_rng(3)
    size = 50
    lengths = rng.integers(1, 51, 300)
    where, offset = packing.sum_of_squares(lengths, size)
    gaps = {}
    for s, w, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        def total(g):
            counts = {}
            for x in g.values():
                if x:
                    counts[x] = counts.get(x, 0) + 1
            return sum(v * v for v in counts.values())

        best = min(
            [total({**gaps, b: g - s}) for b, g in gaps.items() if g >= s] + [total({**gaps, len(gaps): size - s})]
        )
        assert o == size - gaps.get(w, size)
        gaps[w] = gaps.get(w, size) - s
        assert gaps[w] >= 0 and total(gaps) == best


def test_record_round_trip(docs):
    index = records.write_token_records(docs, queries.BYTE_BPE, partitions=3)
    back = records.with_starts(records.read_token_records(index)).orderBy("file_no", "record").collect()
    keys = [r["key"] for r in back]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(back) == docs.count()
    start = 0
    for r in back:
        text = "no id" if r["key"] is None else TEXTS[r["key"]]
        assert r["ids"] == ids_of(text) + [0] and r["start"] == start
        start += r["n_ids"]
    assert sorted(map(tuple, back)) == sorted(map(tuple, records.with_starts(records.read_token_records(records.write_token_records(docs, queries.BYTE_BPE, partitions=3))).collect()))
    some = records.read_token_records(index.where("key % 2 = 0").orderBy(F.rand(1)))
    assert {r["key"] for r in some.collect()} == {k for k in keys if k is not None and k % 2 == 0}


def test_records_query(spark, sf):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    for r in queries.op8_token_records(spark, sf).orderBy("doc_id").collect():
        ids = np.array(ids_of(text.pop(r["doc_id"])) + [0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not text


def test_damage_is_found():
    good = records.frame(records.pack_ids(7, np.array([1, 70000], "<u4")))
    assert records.unpack_ids(records.unframe(good))[1].tolist() == [1, 70000]
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))


def test_a_hot_key_is_spread_over_files(spark):
    rows = spark.range(4000).select((F.lit(7) + F.col("id") % 2 * 0).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    index = records.write_token_records(rows, queries.BYTE_BPE, partitions=4)
    sizes = [r["count"] for r in index.groupBy("file").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000
    starts = records.with_starts(records.read_token_records(index, with_ids=False)).orderBy("start").collect()
    at = 0
    for r in starts:
        assert r["start"] == at
        at += r["n_ids"]


class PairsOfA:
    """Tokens are runs of two a's, counted from a chunk's begin or the last b; boundaries named stable may be wrong inside such runs."""

    proven = True

    def __init__(self, lies):
        self.lies = lies

    def stable(self, window):
        codes = np.frombuffer(window.encode("utf-32-le"), "<u4")
        return (codes[:-1] == ord("b")) | ((codes[:-1] == ord("a")) & (codes[1:] == ord("a")) if self.lies else False)

    def spans(self, text):
        ids, at, i = [], [], 0
        while i < len(text):
            n = 2 if text[i : i + 2] == "aa" else 1
            ids.append(hash(text[i : i + n]) % 1000)
            at.append(i)
            i += n
        return ids, at

    def ids(self, texts):
        return [self.spans(t)[0] for t in texts]


@pytest.mark.parametrize("lies", [False, True])
def test_overlaps_are_widened_until_a_boundary_is_common(lies):
    rng = np.random.default_rng(4)
    seen = 0
    for _ in range(200):
        text = "".join("b" + "a" * int(rng.integers(1, 12)) for _ in range(int(rng.integers(1, 60))))
        enc = token_counts.ChunkedEncoder.__new__(token_counts.ChunkedEncoder)
        enc.lib, enc.chunk, enc.overlap = PairsOfA(lies), 40, 3
        ids, chunks, widened = enc.encode(text)
        assert ids == enc.lib.ids([text])[0] and chunks <= 3 * len(text) / 20 + 8
        seen += widened
    assert (seen > 50) == lies or not lies


def test_a_forced_widening_meets_after_one_step():
    enc = token_counts.ChunkedEncoder.__new__(token_counts.ChunkedEncoder)
    enc.lib, enc.chunk, enc.overlap = PairsOfA(True), 20, 2
    text = "b" + "a" * 6 + "b" + "a" * 6 + "b" + "a" * 40
    ids, chunks, widened = enc.encode("bab" * 9 + text)
    assert ids == enc.lib.ids(["bab" * 9 + text])[0] and widened > 0


def test_token_counts_of_a_column(spark):
    df = spark.createDataFrame([(1, "two words", "x"), (2, None, "y"), (3, "", "z"), (3, "ä" * 5000, "z")], "doc_id long, text string, n_tokens string")
    got = mixing.token_count(df, queries.BYTE_BPE).collect()
    assert [r["n_tokens"] for r in got] == [len(tokenizing.fast_ids(queries.BYTE_BPE, r["text"])) // 4 for r in got] and len(got) == 4
