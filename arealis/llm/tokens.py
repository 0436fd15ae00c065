"""Token ids by the ``tokenizers`` library, fast for long runs of similar texts."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np

#: Texts whose characters all lie here split at white space before any other rule applies.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")
_ENCODERS: dict[tuple[str, bool], "WordEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Chunks(dict):
    """Ids of a white-space-separated chunk of a normalised text, found on first use."""

    def __init__(self, library, code: str):
        self.tokenize, self.letters, self.code = library.model.tokenize, _byte_letters(), code
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^\sa-z0-9ªµºß-öø-ɏ²³¹¼-¾]+").findall

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1] in ",.;:!?" and chunk[:-1].isalpha():  # a word that is mostly known already, and a mark
            ids = self[chunk] = self[chunk[:-1]] + self[chunk[-1]]
            return ids
        if chunk.isascii():
            pieces = [chunk] if chunk.isalpha() else self.pieces(chunk)
        else:
            pieces = [p.encode().decode("latin-1").translate(self.letters) for p in self.pieces(chunk)]
        ids = self[chunk] = array(self.code, [t.id for p in pieces for t in self.tokenize(p)]).tobytes()
        return ids


class WordEncoder:
    """Ids of whole texts, with the ids of each white-space-separated chunk remembered.

    The word vocabulary lower-cases, drops white space and never merges across it, so a
    text's ids are those of its chunks in turn. Texts with a special token's string or
    with characters outside Latin script, before or after lower-casing, go through the
    library whole. With ``narrow``, vocabularies of up to 65,536 ids give two bytes an id.
    ``room`` bounds the chunks that a Python worker remembers.
    """

    def __init__(self, path: str, narrow: bool = False, room: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.room = Tokenizer.from_file(path), room
        self.narrow = narrow and self.whole.get_vocab_size() <= 1 << 16
        self.known = _Chunks(self.whole, "H" if self.narrow else "I")

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers, or 16-bit ones if ``narrow``."""
        for text in texts:
            if "<|" in text or _PLAIN.search(text):
                yield self._library(text)
                continue
            low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
            if not low.isascii() and _PLAIN.search(low):  # some capitals have small letters beyond the range
                yield self._library(text)
                continue
            if len(self.known) > self.room:
                self.known.clear()
            yield b"".join(map(self.known.__getitem__, low.split()))

    def _library(self, text: str) -> bytes:
        ids = self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u2" if self.narrow else "<u4").tobytes()


def encoder(path: str, narrow: bool = False) -> WordEncoder:
    """One encoder for each vocabulary file and Python worker; ``narrow`` asks for two bytes an id where the vocabulary allows it."""
    if (path, narrow) not in _ENCODERS:
        _ENCODERS[path, narrow] = WordEncoder(path, narrow)
    return _ENCODERS[path, narrow]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
