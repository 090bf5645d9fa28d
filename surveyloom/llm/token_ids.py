"""Token ids of whole texts, as bytes, by the fastest way that is proved equal to the library.

Texts in Latin script are encoded by the rank form of the same vocabulary; the ranks come from
the tokenizer's own file, and the driver proves that its merges are in rank order and that both
libraries cut a word at the same places around each of those characters. All other texts, and
very long ones, take the tokenizer's own pre-tokenizer and merges.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

from surveyloom.llm.common import worker_store
from surveyloom.llm.token_counts import SLICE, proved_whole_tokens, word_tokens

#: Characters below this one may take the fast way.
LATIN = 0x250
# Fixed value: the pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER = re.compile(f"[^\\x00-{chr(LATIN - 1)}]")


def byte_spelling() -> dict[str, int]:
    """The byte that each character of the byte-level spelling stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def rank_encoding(path: str):
    """The vocabulary in rank form."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    back = byte_spelling()
    ranks = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=4)
def ranks_are_proved(path: str) -> bool:
    """Whether merges come in the order of ids and Latin characters are cut alike."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if made != sorted(made) or len(set(made)) != len(made):
        return False
    library, ranks = Tokenizer.from_file(path), rank_encoding(path)
    around = [f"a{chr(i)}a 1{chr(i)}1 .{chr(i)}. {chr(i)} {chr(i)}{chr(i)}  x" for i in range(LATIN)]
    want = [e.ids for e in library.encode_batch(around, add_special_tokens=False)]
    return want == [ranks.encode(x, allowed_special="all") for x in around]


class TokenIds:
    def __init__(self, path: str, whole: dict[str, int], ranked: bool):
        self.words = word_tokens(path, whole)
        self.ranks = rank_encoding(path) if ranked else None

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.ranks is None or len(text) > SLICE or _OTHER.search(text):
            return self.words.encode(text)
        ids = array("I", self.ranks.encode(text, allowed_special="all"))
        return ids.tobytes() if _LITTLE else ids.byteswap() or ids.tobytes()


_LITTLE = array("I", [1]).tobytes()[0] == 1


def proofs(path: str) -> tuple[str, dict[str, int], bool]:
    """What tasks need for ``token_ids``; made on the driver."""
    return path, proved_whole_tokens(path), ranks_are_proved(path)


def token_ids(proved: tuple[str, dict[str, int], bool]) -> TokenIds:
    """This worker's reader of texts."""
    store = worker_store("tokens")
    key = ("token_ids", proved[0])
    if key not in store:
        store[key] = TokenIds(*proved)
    return store[key]
