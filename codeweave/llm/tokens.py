"""Token ids of whole texts for a byte-level BPE file of ``tokenizers``.

Texts of printable ASCII, Latin letters with accents and newlines are encoded by
``tiktoken`` with the ranks and the split pattern of the same file, which gives
the same ids several times faster; everything else (other white space, other
scripts, added tokens) by ``tokenizers`` itself."""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np

#: Fixed values of the file format: the split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on which the two libraries' character classes agree.
_PLAIN = re.compile("[ -~À-ÖØ-öø-ɏ\n]*")


def _byte_letters() -> dict[str, int]:
    """The file's letters for bytes: printable ones stand for themselves, the
    others for U+0100 onwards in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
    return out


class Ids:
    """``encode(text)``: little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str):
        self.path = path
        self._whole = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        little = sys.byteorder == "little" and array("I").itemsize == 4
        self.fast = self._ranks(spec) if little else None

    def _ranks(self, spec):
        """A tiktoken encoding if the file's merges are in the order of ids."""
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            return None
        letters, added = _byte_letters(), set(self.added)
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in added}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        ids = np.array([spec["model"]["vocab"][m] for m in merged])
        if not (np.diff(ids) > 0).all():
            return None
        import tiktoken
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        if self._whole is None:
            from tokenizers import Tokenizer
            self._whole = Tokenizer.from_file(self.path)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or not _PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return self.whole(text)
        return array("I", self.fast.encode_ordinary(text)).tobytes()


_LOADED: dict[str, Ids] = {}


def ids_for(path: str) -> Ids:
    """One encoder per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]
