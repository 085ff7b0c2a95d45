"""Token ids of whole texts by the word-level BPE tokenizer, word by word.

The tokenizer normalises (NFC, lower case) and never matches across white space, so a
text's ids are the ids of its white-space separated words, one after the other.  Each
Python worker keeps the ids of words it has met in a dictionary of bounded size; the
tokenizers library encodes the others.  The new words of a text are cut into parts together.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from operator import attrgetter

END_ID = 2
#: Words, and parts of words, kept by a worker; each dictionary is emptied when it is full.
KEPT_WORDS = 500_000
KEPT_PARTS = 800_000
#: Longer words are not kept.
KEPT_BYTES = 40

#: Words of printable ASCII and Latin-1 letters: each character is its own normal form and
#: has one lower case character, so that their parts need no normaliser.
PLAIN = re.compile("[\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The tokenizer's own pre-token pattern, over lower case plain words, a line each.
PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\na-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Stands between words that are cut together: no four bytes of ids, whose highest byte is 0, are equal to it.
BETWEEN = b"\xff" * 4
_ID = attrgetter("id")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(shown)]
    return {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(hidden)}


class _Parts(dict):
    """The ids of parts, as uint32 bytes; a line's end gives BETWEEN."""

    def __init__(self, tokenize: Callable):
        super().__init__({"\n": BETWEEN})
        self.tokenize, self.letters = tokenize, byte_letters()

    def __missing__(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = array("I", map(_ID, self.tokenize(shown))).tobytes()
        if len(self) < KEPT_PARTS:
            self[part] = ids
        return ids

    def clear(self) -> None:
        super().clear()
        self["\n"] = BETWEEN


class WordEncoder(dict):
    """``encode(texts)``: for each text (UTF-8 bytes, None is empty) its ids as little-endian uint32 bytes."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.parts = _Parts(self.tokenizer.model.tokenize)

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of plain words."""
        parts = PARTS.findall(b"\n".join(words).decode().lower())
        return b"".join(map(self.parts.__getitem__, parts)).split(BETWEEN)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if len(word) > 4 * KEPT_BYTES or not PLAIN.fullmatch(text) or "<|" in text:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            ids = self._ids([word])[0]
        if len(word) <= KEPT_BYTES and len(self) < self.kept:
            self[word] = ids
        return ids

    def _meet(self, words: list[bytes]) -> None:
        """Keeps the ids of new plain words, as far as there is room; other words are met one by one."""
        new = [w for w in dict.fromkeys(words) if len(w) <= KEPT_BYTES][: self.kept - len(self)]
        text = b"\n".join(new)
        if b"<|" in text or not PLAIN.fullmatch(text.decode()):
            new = [w for w in new if b"<|" not in w and PLAIN.fullmatch(w.decode())]
        if new:
            self.update(zip(new, self._ids(new), strict=True))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        out = []
        for text in texts:
            words = (text or b"").split()
            ids = list(map(self.get, words))
            gaps = [k for k, x in enumerate(ids) if x is None]
            if gaps:
                self._meet([words[k] for k in gaps])
                for k in gaps:
                    ids[k] = self[words[k]]
            out.append(b"".join(ids))
            if len(self) >= self.kept:
                self.clear()
            if len(self.parts) >= KEPT_PARTS:
                self.parts.clear()
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for the tokenizer file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
