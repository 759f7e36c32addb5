"""Token ids of whole texts by a public tokenizer file, with a cache of words.

The word-level BPE drops white space and never merges across it, so the ids of a text are those of its
white-space separated parts, one after another. Most parts are letters, digits and ASCII punctuation of
Latin-1: these are cut as the file's pattern says and each piece goes to the file's BPE model. Every other
part goes through the whole tokenizer. Frequent parts are encoded once per worker.
"""

from __future__ import annotations

import re
import struct
from functools import cache

import public_tokenizers
from tokenizers import Tokenizer

#: The tokenizer of the packing contract.
DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Cached parts of a worker, and as many pieces of parts, some 200 bytes each; beyond it the cache starts anew.
CACHED_PARTS = 600_000

_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile(f"[!-~À-ÖØ-öø-ÿ]+")
# The pattern of the tokenizer file, for lower-case Latin-1.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: itself, or the next one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PartEncoder(dict):
    """Maps a white-space free UTF-8 part to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, file: str, limit: int = CACHED_PARTS) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.limit = limit
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, part: bytes) -> bytes:
        text = part.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) and "<|" not in text:
            found = b"".join([self.pieces.get(p) or self._piece(p) for p in _PIECES.findall(text.lower())])
        else:
            found = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) >= self.limit:
            self.clear()
        self[part] = found
        return found

    def _piece(self, piece: str) -> bytes:
        spelled = "".join([self.letters[b] for b in piece.encode()])
        if len(self.pieces) >= self.limit:
            self.pieces.clear()
        found = self.pieces[piece] = _packed([t.id for t in self.model.tokenize(spelled)])
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; a null text has none."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@cache
def encoder(name: str = DEFAULT_TOKENIZER, limit: int = CACHED_PARTS) -> PartEncoder:
    """The encoder of this process for a file of ``public_tokenizers`` or for a path, with at most ``limit`` cached parts."""
    return PartEncoder(name if "/" in name else str(public_tokenizers.path(name)), limit)
