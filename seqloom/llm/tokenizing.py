"""Tokenizer access for tasks: one instance per Python worker.

``fast_ids`` encodes with the ``tokenizers`` library and gives the ids of a
text as packed little-endian unsigned 32-bit integers. A byte-level BPE with
the library's own word pattern never merges across words, so a word's ids are
looked up in a bounded memo and the library is asked once for each new word.
Texts outside the plain character set below, or holding an added token's
string, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

# The ranges of letters for which the word pattern below is
# known to agree with the library's Unicode classes.
_LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(f"[\\t\\n\\r\\x20-\\x7e{_LETTER}]*")
_WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s0-9{_LETTER}]+|\\s+(?!\\S)|\\s+"
)
#: Most words one worker remembers; beyond it new words are encoded each time.
MEMO_WORDS = 600_000
#: Longer words are not remembered, so the memo's bytes are bounded as well.
MEMO_LETTERS = 64


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; a path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary_path(name))
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def sentencepiece_model(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))


class WordMemo(dict):
    """Word -> packed ids, filled from the library."""

    def __init__(self, name: str):
        super().__init__()
        self.tk = tokenizer(name)
        with open(vocabulary_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.splits = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]

    def __missing__(self, word: str) -> bytes:
        packed = self.whole(word)
        if len(self) < MEMO_WORDS and len(word) <= MEMO_LETTERS:
            self[word] = packed
        return packed

    def whole(self, text: str) -> bytes:
        (done,) = self.tk.encode_batch_fast([text], add_special_tokens=False)
        return array("I", done.ids).tobytes()

    def ids(self, text: str) -> bytes:
        if self.splits and _PLAIN.fullmatch(text) and not any(a in text for a in self.added):
            return b"".join(map(self.__getitem__, _WORDS.findall(text)))
        return self.whole(text)


@lru_cache(maxsize=2)
def word_memo(name: str) -> WordMemo:
    return WordMemo(name)


def release() -> None:
    """Frees the worker's memo; operators that need their own memory call it."""
    word_memo.cache_clear()


def fast_ids(name: str, text: str | None) -> bytes:
    """Ids of a whole text as packed uint32; null counts as empty."""
    return word_memo(name).ids(text) if text else b""
