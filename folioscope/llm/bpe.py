"""Token ids of a byte-level BPE vocabulary file, a batch of texts at a time.

The vocabulary's own library gives every id. Texts of well-known characters are first cut into the pre-tokens of the
vocabulary's pattern, and each distinct pre-token is given to the library's model once a task; alone it has the ids it has
in its text. All other texts, and texts that name the special token, go to the library whole. Very long ones are cut where a
single blank stands between two other characters, since a pre-token always begins there.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Characters whose class is the same in every version of Unicode, and the letters and numbers among them.
WELL_KNOWN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\u00a1-\u024f]*")
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The pattern of the vocabulary's pre-tokens, for those characters.
PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
_JOINT = re.compile(r"(?<=\S) (?=\S)")
SPECIAL = "<|endoftext|>"
PIECE_CHARS = 1 << 16
MAX_KNOWN = 500_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next one from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {b: chr(b if b in seen else next(hidden)) for b in range(0x100)}


def cut_long(text: str, size: int = PIECE_CHARS) -> list[str]:
    pieces, lo = [], 0
    while len(text) - lo > size:
        found = _JOINT.search(text, lo + size)
        if not found:
            break
        pieces.append(text[lo:found.start()])
        lo = found.start()
    return [*pieces, text[lo:]]


class Known(dict):
    """Pre-token to the bytes of its ids; one that is looked up for the first time goes to the model."""

    def __init__(self, model) -> None:
        super().__init__()
        self.tokenize, self.letters = model.tokenize, byte_letters()

    def __missing__(self, token: str) -> bytes:
        if len(self) >= MAX_KNOWN:
            self.clear()
        ids = self.tokenize(token.encode().decode("latin-1").translate(self.letters))
        found = self[token] = array("I", [t.id for t in ids]).tobytes()
        return found


class Encoder:
    """One per task. ``path`` is the vocabulary's ``tokenizers`` file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(self.tokenizer.model)

    def _whole(self, text: str) -> list[int]:
        return [i for piece in cut_long(text) for i in self.tokenizer.encode(piece, add_special_tokens=False).ids]

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, as unsigned 32-bit numbers."""
        if SPECIAL in text or not WELL_KNOWN.fullmatch(text):
            return np.array(self._whole(text), np.uint32)
        ids = [b"".join(map(self.known.__getitem__, PATTERN.findall(piece))) for piece in cut_long(text)]
        return np.frombuffer(b"".join(ids), np.uint32)
