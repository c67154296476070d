"""Token ids of whole texts by the tokenizers library, with words that were seen before taken from a cache.

Most of a text is words that came before, but the library's work per word is high. Both kinds of vocabulary used here
encode the parts of a text that lie between certain spaces independently, so each part is encoded once and then looked
up. A new part that is a plain word, maybe with marks after it, goes to the library's model at once, as its pattern would
cut it the same way; any other part goes through the whole library. The ids are those of the library for the whole text
(tests compare them).
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
from array import array
from collections.abc import Iterator

from tidemark.llm.common import worker_cache

#: A space starts a new part if a character that isn't white space follows. Spaces before white space are left inside
#: parts: the byte-level pattern joins runs of white space, and gives its last space to the next word.
_CUT = re.compile(r" (?=\S)")
_RUN = re.compile(r" (?:\s|\Z)")
_BLANK = re.compile(r"\s")
MOST_CACHED = 300_000  # parts


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


_LETTER = _byte_letters()


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Parts(dict):
    """Ids of parts; ``spaced``: of the part with a space before it."""

    def __init__(self, encoder: Encoder, spaced: bool):
        super().__init__()
        self.encoder, self.before = encoder, " " if spaced else ""
        self.first = _LETTER[32] if spaced else ""

    def _plain(self, part: str) -> bytes | None:
        """A word of Latin letters with marks after it, if the part is that."""
        core = part.rstrip(string.punctuation)
        if not core.isalpha() or not core.isascii() and max(core) > "ɏ":
            return None
        if not self.encoder.cased:
            low = core.lower()
            if not core.isascii() and not (low.isalpha() and len(low) == len(core) and unicodedata.is_normalized("NFC", part)):
                return None
            core, part = low, low + part[len(core) :]
        if len(part) > len(core):
            return self[core] + self.encoder.marks[part[len(core) :]]
        text = self.first + (core if core.isascii() else "".join(_LETTER[b] for b in core.encode()))
        return _packed([t.id for t in self.encoder.model.tokenize(text)])

    def __missing__(self, part: str) -> bytes:
        e = self.encoder
        ids = self._plain(part) if part else b""
        if ids is None and e.cased and "\n" in part:
            a, _, b = part.partition("\n")
            if a and b and not _BLANK.search(a) and not _BLANK.search(b):
                ids = self[a] + e.marks["\n"] + e.starts[b]
        if ids is None:
            ids = _packed(e.tokenizer.encode(self.before + part, add_special_tokens=False).ids)
        if len(self) < MOST_CACHED:  # frequent parts come early, so what is held then stays worth holding
            self[part] = ids
        return ids


class _Marks(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, marks: str) -> bytes:
        ids = _packed(self.encoder.tokenizer.encode(marks, add_special_tokens=False).ids)
        if len(self) < MOST_CACHED:
            self[marks] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``cased``: a byte-level vocabulary that keeps case, white space and the space before a word; else one that lowers
    the text and drops white space.
    """

    def __init__(self, path: str, cased: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cased = Tokenizer.from_file(path), cased
        self.model = self.tokenizer.model
        self.marks, self.starts, self.parts = _Marks(self), _Parts(self, False), _Parts(self, cased)

    def encode(self, texts: list[str | None], end: int) -> Iterator[bytes]:
        """The ids of each text, then ``end``; null counts as empty."""
        last, get = _packed([end]), self.parts.__getitem__
        for text in texts:
            text = text or ""
            if not self.cased:
                yield b"".join(map(get, text.replace("\n", " ").split(" "))) + last
            else:
                first, *more = _CUT.split(text) if _RUN.search(text) else text.split(" ")
                yield self.starts[first] + b"".join(map(get, more)) + last


def encoder(path: str, cased: bool) -> Encoder:
    """One for each file in a Python worker, as loading takes a second."""
    held = worker_cache(f"tokens {path} {cased}")
    if "encoder" not in held:
        held["encoder"] = Encoder(path, cased)
    return held["encoder"]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; it is looked up where it is used, as machines may differ."""
    import public_tokenizers

    return public_tokenizers.path(name)
