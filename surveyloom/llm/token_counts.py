"""Token counts by the whole-token shortcut.

A byte-level BPE vocabulary is read once on the driver, which proves for each entry whether
the library encodes that string alone as exactly one token. In tasks a text is cut into
pre-tokens by the library's own pre-tokenizer; a pre-token of the proved table counts as one
and only the rest is merged. Both steps are remembered per word between single spaces: a space
whose neighbours are not white space always begins a pre-token, so such a word (with the space
before it) has the same tokens in every text.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import whole_text, worker_store

#: Words of each memo in a worker, its bytes (about), and the longest word kept; results do not depend on them.
MEMO_WORDS, MEMO_BYTES, MEMO_LENGTH = 400_000, 32 << 20, 48
#: Longer texts are read in slices that end at a safe space.
SLICE = 1 << 20
_UNSAFE = 1 << 50


@functools.lru_cache(maxsize=4)
def proved_whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings (in byte-level spelling) that alone encode as one token, with its id.

    Raises ``ValueError`` for a tokenizer whose words would not be independent of what is
    around them (a normalizer, another pre-tokenizer, special strings that strip space).
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
    if spec["normalizer"] or not plain or odd or spec["model"]["type"] != "BPE":
        raise ValueError(f"{path}: only plain byte-level BPE tokenizers are counted this way")
    model = Tokenizer.from_file(path).model
    special = {t["content"] for t in spec["added_tokens"]}
    proved = {}
    for entry, token in spec["model"]["vocab"].items():
        found = model.tokenize(entry) if entry not in special else []
        if len(found) == 1 and found[0].id == token:
            proved[entry] = token
    return proved


class _Memo(dict):
    """Remembers what ``make`` returns for a word; forgets everything when full."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.bytes = make, 0

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= MEMO_LENGTH:
            self.bytes += getsizeof(word) + getsizeof(value) + 100  # and its slot
            if self.bytes > MEMO_BYTES or len(self) >= MEMO_WORDS:
                self.clear()
                self.bytes = 0
            self[word] = value
        return value


class WordTokens:
    """Tokens of texts, word by word. One per worker and tokenizer."""

    def __init__(self, path: str, whole: dict[str, int]):
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.splitter = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.pre, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.counts, self.ids = _Memo(self._count_word), _Memo(self._word_ids)
        self.merged = _Memo(lambda piece: [t.id for t in self.model.tokenize(piece)])

    def _pieces(self, text: str) -> list[int]:
        out: list[int] = []
        for piece, _ in self.pre.pre_tokenize_str(text):
            token = self.whole.get(piece)
            if token is None:
                out.extend(self.merged[piece])
            else:
                out.append(token)
        return out

    @staticmethod
    def _unsafe(word: str) -> bool:
        return not word or word[0].isspace() or word[-1].isspace()

    def _count_word(self, word: str) -> int:
        """Tokens of the word with the space before it, or a huge number if that space isn't safe."""
        return _UNSAFE if self._unsafe(word) else len(self._pieces(" " + word))

    def _word_ids(self, word: str) -> bytes | None:
        return None if self._unsafe(word) else np.array(self._pieces(" " + word), "<u4").tobytes()

    def _slices(self, text: str) -> Iterator[tuple[int, str]]:
        """(token id, "") for a special string, else (-1, a slice of the text)."""
        parts = [text]
        if self.splitter is not None and any(s in text for s in self.special):
            parts = self.splitter.split(text)
        for part in parts:
            if part in self.special:
                yield self.special[part], ""
                continue
            at = 0
            while len(part) - at > SLICE:
                end = part.find(" ", at + SLICE)
                while 0 < end < len(part) - 1 and (part[end - 1].isspace() or part[end + 1].isspace()):
                    end = part.find(" ", end + 1)
                if end < 0 or end >= len(part) - 1:
                    break
                yield -1, part[at:end]
                at = end
            if at < len(part):
                yield -1, part[at:] if at else part

    @staticmethod
    def _safe_words(text: str) -> list[str]:
        """Parts between those single spaces that have no white space beside them."""
        return re.split(r"(?<=\S) (?=\S)", text)

    def count(self, text: str) -> int:
        total = 0
        for token, part in self._slices(text):
            if token >= 0:
                total += 1
                continue
            first, *words = part.split(" ")
            # a slice after the first begins with its space, and then `first` is empty
            n = sum(map(self.counts.__getitem__, words)) + (len(self._pieces(first)) if first else 0)
            if n >= _UNSAFE or (first and first[-1].isspace()):
                first, *words = self._safe_words(part)
                n = len(self._pieces(first)) + sum(len(self._pieces(" " + w)) for w in words)
            total += n
        return total

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        out = []
        for token, part in self._slices(text):
            if token >= 0:
                out.append(np.array([token], "<u4").tobytes())
                continue
            first, *words = part.split(" ")
            found = list(map(self.ids.__getitem__, words))
            if None in found or (first and first[-1].isspace()):
                first, *words = self._safe_words(part)
                found = [np.array(self._pieces(" " + w), "<u4").tobytes() for w in words]
            out.append(np.array(self._pieces(first), "<u4").tobytes())
            out.extend(found)
        return b"".join(out)


def word_tokens(path: str, whole: dict[str, int]) -> WordTokens:
    """This worker's reader of texts."""
    store = worker_store("tokens")
    key = ("word_tokens", path)
    if key not in store:
        store[key] = WordTokens(path, whole)
    return store[key]


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", output: str = "n_tokens"
) -> DataFrame:
    """Add the number of tokens of each whole text, without begin, end or added special tokens.

    A null or empty text has 0 tokens. Rows are kept one by one, repeated ones too, with all
    their other columns; an empty table stays empty. A special string inside a text is one
    token, as the library has it by default. No row moves between tasks.
    """
    if output in docs.columns:
        raise ValueError(f"Column {output} exists")
    whole = proved_whole_tokens(path)

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = word_tokens(path, whole)
        for batch in texts:
            yield pd.Series([reader.count(x) for x in batch], dtype="int64")

    return docs.withColumn(output, counted(whole_text(text)))
