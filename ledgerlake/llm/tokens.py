"""Token ids of whole texts by a public byte-level vocabulary."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

_BESIDE_BLANK = re.compile(r"\s |  | $|^ ")


class _Pieces(dict):
    """Blank-free piece of text -> ids as little-endian bytes; a piece is encoded once for each Python worker.

    The vocabulary's pattern binds a single blank to what follows it, so a text in which no blank lies beside other
    white space is encoded piece by piece with the same ids. `most` bounds the memory: then the store starts anew.
    """

    def __init__(self, encode, lead: str, most: int = 1 << 19):
        self._encode, self._lead, self._most = encode, lead, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self._most:
            self.clear()
        ids = np.asarray(self._encode(self._lead + piece), dtype="<u4").tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids


class Encoder:
    """Ids as the vocabulary's own library gives them, without special tokens added."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._json_path, self._library = json_path, None
        self._plain = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._first, self._later = _Pieces(self._plain, ""), _Pieces(self._plain, " ")

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if "<|" in text:  # perhaps the name of a special token, which the library reads as that token
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self._json_path)
            return np.asarray(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not text or _BESIDE_BLANK.search(text):
            return np.asarray(self._plain(text), dtype="<u4").tobytes()
        first, *later = text.split(" ")
        return self._first[first] + b"".join(map(self._later.__getitem__, later))


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    return Encoder(json_path, ranks_path, pattern)
