"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary file (tokenizers' JSON) is a parameter and is never copied here.
Encoding is done by tiktoken from ranks read out of that same file, which gives the
ids of tokenizers several times faster.  Both split a text by Unicode classes, whose
tables may be of different Unicode versions, so a text with a character outside the
ranges of ``_PLAIN`` goes to the tokenizers library itself.  Texts that look like a
special token are ordinary text.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Latin letters with marks, Greek, Cyrillic, general punctuation: the same in all
#: Unicode versions of the last twenty years.
_PLAIN = re.compile("[^\x00-ſΑ-Ρα-ωА-я‐-‧€]")
#: The public split pattern of this vocabulary family.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes for themselves, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """ids(text) -> numpy uint32; one per Python worker, see ``encoder``."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self._path = path
        self._fast = tiktoken.Encoding(f"vocab:{path}", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._exact = None

    def exact(self, text: str) -> np.ndarray:
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self._path)
            self._exact.encode_special_tokens = True
        return np.asarray(self._exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint32)
        if _PLAIN.search(text):
            return self.exact(text)
        return np.asarray(self._fast.encode_to_numpy(text), dtype=np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
