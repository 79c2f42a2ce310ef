"""Byte-level BPE with a public vocabulary, as a task of a Spark job uses it.

The rank file gives the same ids as the vocabulary's JSON form does in the library `tokenizers`
(tests/llm/test_texts.py compares them); special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

RANKS = "byte_bpe_50k.tiktoken"
#: The library's own splitter recurses over a run of white space, and a million overflow its stack.
_LONG_SPACE = re.compile(r"\s{10000}")


@lru_cache(maxsize=4)
def token_bytes(name: str = RANKS) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=4)
def encoding(name: str = RANKS):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_bytes(name), special_tokens={})


@lru_cache(maxsize=4)
def pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def encode(text: str) -> list[int]:
    """The text's ids. A text with a long run of white space is split by the package `regex`, whose matches
    are the same, and each piece is merged by itself."""
    if _LONG_SPACE.search(text) is None:
        return encoding().encode_ordinary(text)
    return [i for piece in pattern().findall(text) for i in encode_piece(piece)]


def encode_piece(piece: str) -> list[int]:
    """The ids of one match of the pattern, of any length."""
    return encoding()._core_bpe.encode_single_piece(piece.encode())
