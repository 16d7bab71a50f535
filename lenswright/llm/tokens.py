"""Token ids of whole texts from a public tokenizer's file, with memoised words.

Encoding with the library costs tens of microseconds a word, and words repeat.
Stretches of plain Latin letters, digits, marks and spaces are cut as the
tokenizer's own pattern does it, all at once; the pieces are few, and each is
looked up or given to the library's model.  A chunk between spaces that holds
anything else goes to the library whole: the tokenizer drops spaces and line
ends and never merges across them.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import kept

#: Pieces and chunks that a worker remembers, of either generation, and the longest of them.
REMEMBERED, LONGEST = 200_000, 64
#: The id that ends each document.
END_ID = 1

#: The plain characters in Latin-1, and what is not plain or may be a special token.
_PLAIN = bytes([*range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_ODD = re.compile(r"[^ !-~À-ÖØ-öø-ÿ]|<\|")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def default_path() -> str:
    """The public vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letters that byte-level tokenizers write bytes with: printable Latin-1 stands for itself, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Memory(dict):
    """Text -> its ids as little-endian bytes; when full, what hasn't been asked for since the last time goes."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, text: str) -> bytes:
        got = self.older.get(text)
        if got is None:
            got = self.encode(text)
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[text] = got
        return got


def _all_plain(text: str) -> bool:
    """What a search for ``_ODD`` says, told faster."""
    try:
        return not text.encode("latin-1").translate(None, _PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


class Encoder:
    """A tokenizer's file, opened; ``ids`` encodes a text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.pieces, self.chunks = _Memory(self._piece), _Memory(self._chunk)
        self.plain = self._word_pieces_apply()

    def _word_pieces_apply(self) -> bool:
        """Whether cutting plain text by the pattern above gives what the library gives."""
        probe = "The man's \"o'clock\" isn't 3,14! ÉTÉ groß; don't/won't a_b...'ll $$$ (x)'S"
        return all(self._cut(p) == self._chunk(p) for p in [probe, *probe.split(" ")])

    def _chunk(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))

    def raw(self, text: str, end: int | None = END_ID) -> bytes:
        """All ids of a text, the end id after them, as little-endian bytes of ``dtype``."""
        tail = b"" if end is None else int(end).to_bytes(self.dtype.itemsize, "little")
        text = text.replace("\n", " ")
        if not self.plain:
            return b"".join(map(self.chunks.__getitem__, text.split(" "))) + tail
        if _all_plain(text):
            return self._cut(text) + tail
        out, at = [], 0
        while odd := _ODD.search(text, at):
            start = max(at, text.rfind(" ", at, odd.start()) + 1)
            stop = text.find(" ", odd.end())
            stop = len(text) if stop < 0 else stop
            if at < start:
                out.append(self._cut(text[at:start]))
            out.append(self.chunks[text[start:stop]])
            at = stop
        out.append(self._cut(text[at:]))
        return b"".join(out) + tail

    def ids(self, text: str, end: int | None = END_ID) -> np.ndarray:
        return np.frombuffer(self.raw(text, end), self.dtype)


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept until another operator works there."""
    return kept("tokens", path, lambda: Encoder(path))
