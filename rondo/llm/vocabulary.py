"""Byte-level BPE vocabularies: loading, batch encoding to lengths or ids, decoding, and places where a text may be cut.

The encoder is built from the vocabulary file of the tokenizers library, whose path is a parameter; every executor needs the file
at that path. Token ranks must follow the order of merges, which loading checks.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Pre-token pattern of byte-level BPE with its default regular expression (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pre-token always ends before a space between two visible ASCII characters: no alternative of the pattern runs past a visible
#: character into white space, and the next one starts with the space whatever came before.
SAFE = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + n)] = b
    return table


class Vocabulary:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {token: i for token, i in spec["model"]["vocab"].items() if token not in self.specials}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(made) or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary in the order of its merges")
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)
        pieces = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.specials.items()}
        table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.lengths = np.array([len(b) for b in table], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)

    def encode(self, text: str) -> np.ndarray:
        """Ids as the tokenizers library gives them without added special tokens; special strings in a text are special tokens."""
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def lengths_of(self, texts: list[str]) -> list[int]:
        """Numbers of ids of a batch of texts, encoded in one call."""
        return [len(ids) for ids in self.encoding.encode_batch(texts, num_threads=1, allowed_special="all")]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids and where each id's bytes end."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at], ends


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and path."""
    return Vocabulary(path)


def safe_cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes, cut only where a pre-token ends in any case; a stretch without such a place stays whole."""
    pieces, start = [], 0
    while len(data) - start > size:
        found = SAFE.search(data, start + size)
        if not found:
            break
        pieces.append(data[start : found.start()])
        start = found.start()
    return [*pieces, data[start:]]
