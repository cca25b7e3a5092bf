"""Token counts with overlap resynchronisation for huge documents.

A text up to ``chunk_bytes`` is encoded whole. A longer one is cut into chunks
that overlap; each is encoded with offsets, and neighbours are spliced at a
common token boundary that is proven stable. Where the overlap holds none, it
is widened until it does, in the end to the whole text, so the count always
equals that of the whole text while a task encodes one chunk at a time.

A boundary between two characters is stable when no token of the vocabulary can
cover both: no merge then ever crosses it, and what stands on one side has no
influence on the other. That is read off the vocabulary (sentencepiece: pairs of
neighbours that no piece holds) or the word pattern (tokenizers: a space after a
non-space, a letter beside a digit), never assumed. Texts without spaces have
such places too; only a text without any is encoded in one call.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizing import sentencepiece_model, tokenizer, vocabulary_path

_SPACE = 0x20
_META = "▁"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@lru_cache(maxsize=1)
def _spaces() -> np.ndarray:
    """Which code points of the first plane are white space."""
    return np.array([chr(c).isspace() for c in range(0x10000)])


class _SentencePiece:
    def __init__(self, name: str):
        self.sp = sentencepiece_model(name)
        kept = [
            self.sp.id_to_piece(i)
            for i in range(self.sp.get_piece_size())
            if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))
        ]
        self.known = {p for p in kept if len(p) == 1}
        # Pairs of neighbouring characters that some piece holds; no merge crosses any other pair.
        pairs = {(ord(p[k]) << 32) | ord(p[k + 1]) for p in kept for k in range(len(p) - 1)}
        self.pairs = np.array(sorted(pairs), np.uint64)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.lengths = np.array([1 if self.sp.is_byte(i) else len(p.replace(_META, " ").encode()) for i, p in enumerate(pieces)])
        self.bytes_for_unknown = any(self.sp.is_byte(i) for i in range(self.sp.get_piece_size()))
        probe = f"a b  c{_META}"
        self.proven = "".join(self.sp.encode(probe, out_type=str)).replace(_META, " ").strip() == probe.replace(_META, " ").strip()
        self.plain: dict[int, bool] = {}

    def _learn(self, codes: list[int]) -> None:
        """Notes which characters normalise to themselves, alone and beside others."""
        texts = [f"a{chr(c)}a" for c in codes]
        for code, text, pieces in zip(codes, texts, self.sp.encode(texts, out_type=str, num_threads=1), strict=True):
            c = text[1]
            if (_META if c == " " else c) in self.known:
                same = "".join(pieces).replace(_META, " ").strip() == text
            else:  # its bytes stand for it
                own = [f"<0x{b:02X}>" for b in c.encode("utf-8", "surrogatepass")]
                same = self.bytes_for_unknown and any(pieces[k : k + len(own)] == own for k in range(len(pieces)))
            self.plain[code] = same and unicodedata.combining(c) == 0 and not 0x1100 <= code < 0x1200

    def stable(self, window: str) -> np.ndarray:
        """For each character of ``window`` but the first: no token can hold it and the one before."""
        codes = _codes(window)
        seen = np.unique(codes).tolist()
        self._learn([c for c in seen if c not in self.plain])
        good = np.isin(codes, np.array([c for c in seen if self.plain[c]], np.uint32))
        pieces = np.where(codes == _SPACE, ord(_META), codes).astype(np.uint64)
        pairs = (pieces[:-1] << np.uint64(32)) | pieces[1:]
        at = np.minimum(np.searchsorted(self.pairs, pairs), max(0, len(self.pairs) - 1))
        held = self.pairs[at] == pairs if len(self.pairs) else np.zeros(len(pairs), bool)
        return good[:-1] & good[1:] & ~held

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)

    def spans(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and the byte offset at which each begins."""
        ids = self.sp.encode(text)
        ends = np.cumsum(self.lengths[ids])
        size = len(text.encode("utf-8", "surrogatepass"))
        if len(ids) and int(ends[-1]) - size in (0, 1):  # 1: the model's own space in front
            front = int(ends[-1]) - size
            return ids, np.maximum(np.concatenate([[0], ends[:-1]]) - front, 0).tolist()
        found = self.sp.encode(text, return_type="proto").pieces  # characters that change in normalising
        return [p.id for p in found], [p.begin for p in found]


class _Tokenizers:
    #: Pre-tokenizers that always start a new word at a space after a non-space.
    SPLITTING = ("ByteLevel", "Whitespace", "WhitespaceSplit", "BertPreTokenizer")

    def __init__(self, name: str):
        self.tk = tokenizer(name)
        with open(vocabulary_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.proven = (
            pre.get("type") in self.SPLITTING
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
            and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))
        )
        # The byte-level word pattern also parts letters from digits; an added token could hold both.
        self.classes = pre.get("type") == "ByteLevel" and not any(re.search("[A-Za-z][0-9]|[0-9][A-Za-z]", t["content"]) for t in spec.get("added_tokens", []))

    def stable(self, window: str) -> np.ndarray:
        """For each character of ``window`` but the first: a word always begins there."""
        codes = _codes(window)
        space = _spaces()[np.minimum(codes, 0xFFFF)] & (codes < 0x10000)
        found = ~space[:-1] & (codes[1:] == _SPACE)
        if self.classes:
            digit = (codes >= 48) & (codes < 58)
            letter = ((codes | 32) >= 97) & ((codes | 32) < 123)
            found |= (digit[:-1] & letter[1:]) | (letter[:-1] & digit[1:])
        return found

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tk.encode_batch_fast(texts, add_special_tokens=False)]

    def spans(self, text: str) -> tuple[list[int], list[int]]:
        found = self.tk.encode(text, add_special_tokens=False)
        if text.isascii():
            return found.ids, [a for a, _ in found.offsets]
        at, total = [0], 0
        for ch in text:
            total += len(ch.encode("utf-8", "surrogatepass"))
            at.append(total)
        return found.ids, [at[a] for a, _ in found.offsets]


class ChunkedEncoder:
    """Encodes texts of any length; ``name`` is a ``.json`` or ``.model`` file."""

    def __init__(self, name: str, chunk_bytes: int, overlap_bytes: int):
        if not 0 < overlap_bytes < chunk_bytes:
            raise ValueError("the overlap must be positive and smaller than a chunk")
        self.lib = _SentencePiece(name) if name.endswith(".model") else _Tokenizers(name)
        self.chunk, self.overlap = chunk_bytes, overlap_bytes

    def _last(self, text: str, lo: int, hi: int) -> int | None:
        """The last stable boundary in (lo, hi], looked for backwards in growing steps."""
        step = 256
        while hi > lo:
            a = max(lo, hi - step)
            found = np.flatnonzero(self.lib.stable(text[a : hi + 1]))
            if len(found):
                return a + 1 + int(found[-1])
            hi, step = a, min(2 * step, 1 << 18)
        return None

    def _next(self, text: str, lo: int) -> int | None:
        """The first stable boundary behind ``lo``."""
        step = 256
        while lo + 1 < len(text):
            found = np.flatnonzero(self.lib.stable(text[lo : lo + step + 1]))
            if len(found):
                return lo + 1 + int(found[0])
            lo, step = lo + step, min(2 * step, 1 << 18)
        return None

    def _common(self, text: str, begin: int, done: int, done_at: int, known: set[int], starts: set[int]) -> int | None:
        """Byte place of the last stable boundary up to ``done`` at which a token begins in both encodings."""
        if done_at in known and done_at in starts:
            return done_at
        for c in (begin + 1 + np.flatnonzero(self.lib.stable(text[begin : done + 1]))[::-1]).tolist():
            at = done_at - _bytes(text[c:done])
            if at in known and at in starts:
                return at
        return None

    def encode(self, text: str) -> tuple[list[int], int, int]:
        """Ids of ``text``, chunks encoded, times an overlap was widened.

        The splice is chosen before a chunk is encoded: the last stable boundary
        within the chunk, or, where it holds none, the next one behind it. So
        each part is encoded once and each overlap twice, whatever the text. If
        no token begins there in both encodings, the overlap is doubled
        backwards until a stable boundary is common to both, and what lies
        behind it is taken from the new encoding; an overlap that reaches the
        text's begin without one leaves the whole text to one call.
        """
        if _bytes(text) <= self.chunk or not self.lib.proven:
            return self.lib.ids([text])[0], 1, 0
        out: list[int] = []
        marks: list[int] = []  # bytes before each id of ``out``
        done = done_at = chunks = widened = begin = 0  # everything before the character ``done``, at byte ``done_at``, is in ``out``
        after: set[int] = set()  # where the last chunk's tokens from ``done`` on begin
        while True:
            cut = None
            if done + self.chunk < len(text):
                cut = self._last(text, done, done + self.chunk)
                widened += cut is None or cut < done + self.chunk - self.overlap
                cut = cut or self._next(text, done + self.chunk)
            if cut is None and done == 0:
                return self.lib.ids([text])[0], 1, widened
            end = len(text) if cut is None else min(len(text), cut + self.overlap)
            back = done - begin
            while True:
                begin_at = done_at - _bytes(text[begin:done])
                ids, at = self.lib.spans(text[begin:end])
                at = [a + begin_at for a in at]
                chunks += 1
                known = after.union(marks[bisect_left(marks, begin_at) :])
                splice = self._common(text, begin, done, done_at, known, set(at)) if done else 0
                if splice is not None:
                    break
                if begin == 0:
                    return self.lib.ids([text])[0], chunks + 1, widened + 1
                back, widened = max(2 * back, self.overlap), widened + 1
                begin = max(0, done - back)
            kept = bisect_left(marks, splice)
            del out[kept:], marks[kept:]
            stop = None if cut is None else done_at + _bytes(text[done:cut])
            for i, a in zip(ids, at, strict=True):
                if a >= splice and (stop is None or a < stop):
                    out.append(i)
                    marks.append(a)
            if cut is None:
                return out, chunks, widened
            after = {a for a in at if a >= stop}
            begin, done, done_at = max(done, cut - self.overlap), cut, stop


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=4)
def encoder(name: str, chunk_bytes: int, overlap_bytes: int) -> ChunkedEncoder:
    return ChunkedEncoder(name, chunk_bytes, overlap_bytes)


def count_tokens(
    docs: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = 32_768,
    overlap_bytes: int = 1_024,
    with_ids: bool = False,
) -> DataFrame:
    """``(id, n_bytes, n_tokens, n_chunks, n_widened[, token_ids])`` per row.

    A narrow map without a shuffle: a row never leaves its partition. Null and
    empty texts have 0 tokens; null ids and repeated rows are kept as they are;
    other columns, whatever their names, are not read; an empty table gives no
    rows. Time grows in proportion to a text's length, with or without spaces
    in it. ``chunk_bytes`` is the size from which a text is cut, and the
    characters of its chunks.
    """
    id_type = docs.schema[id_col].dataType
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model, chunk_bytes, overlap_bytes)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                yield count(enc, whole.slice(first, 256))

    def count(enc: ChunkedEncoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        sizes = [_bytes(t) for t in texts]
        short = [k for k, n in enumerate(sizes) if n <= chunk_bytes]
        found: list = [None] * len(texts)
        for k, ids in zip(short, enc.lib.ids([texts[k] for k in short]), strict=True):
            found[k] = (ids if with_ids else len(ids), 1, 0)
        for k, n in enumerate(sizes):
            if n > chunk_bytes:
                ids, chunks, widened = enc.encode(texts[k])
                found[k] = (ids if with_ids else len(ids), chunks, widened)
        columns = [
            batch.column(0),
            pa.array(sizes, pa.int64()),
            pa.array([len(f[0]) if with_ids else f[0] for f in found], pa.int64()),
            pa.array([f[1] for f in found], pa.int32()),
            pa.array([f[2] for f in found], pa.int32()),
        ]
        names = ["id", "n_bytes", "n_tokens", "n_chunks", "n_widened"]
        if with_ids:
            columns.append(pa.array([f[0] for f in found], pa.list_(pa.int32())))
            names.append("token_ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {id_type.simpleString()}, n_bytes long, n_tokens long, n_chunks int, n_widened int"
    if with_ids:
        schema += ", token_ids array<int>"
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)
