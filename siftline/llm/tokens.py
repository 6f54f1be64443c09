"""Sizes in tokens of a public byte-level tokenizer whose rank file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Where the rank file lies on every executor, and the pattern its texts are cut with before merging.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def tokenizer(path: str = RANKS):
    """The encoding, one per Python worker; the library is needed only where texts are sized."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str = RANKS) -> list[int]:
    return tokenizer(path).encode_ordinary(text) if text else []
