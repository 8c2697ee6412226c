"""Byte-level BPE ids of whole texts, as the tokenizers library gives them.

Texts of common Latin characters go through the rank file of the same vocabulary,
which is several times faster; every other text through the library itself.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: ASCII and Latin letters, on whose classes both libraries agree; no text with a
#: special token's mark takes this way.
_COMMON = re.compile("[\t\n\r -~À-ÖØ-öø-ſ]*")
_SPECIAL = "<|"


@lru_cache(maxsize=4)
def _library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _ranked(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_bpe_ids(texts: list[str], json_path: str, ranks_path: str | None, pattern: str | None) -> list[np.ndarray]:
    """Ids of each text with no special tokens added. Without a rank file the library encodes all."""
    out = []
    for text in texts:
        if ranks_path and _SPECIAL not in text and _COMMON.fullmatch(text):
            ids = _ranked(ranks_path, pattern).encode_ordinary(text)
        else:
            ids = _library(json_path).encode(text, add_special_tokens=False).ids
        out.append(np.array(ids, np.uint32))
    return out


def plain_ids(text: str, ranks_path: str, pattern: str) -> list[int] | None:
    """Ids of a text of common Latin characters by the rank file, marks of special tokens as plain text; None for any other."""
    return _ranked(ranks_path, pattern).encode_ordinary(text) if _COMMON.fullmatch(text) else None
