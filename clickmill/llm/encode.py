"""Token ids of whole texts by a public tokenizer file, with remembered words."""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

from .common import one_memory

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words and pieces remembered per generation; two generations are held. Longer ones are not remembered.
WORDS, PIECES, LONGEST = 200_000, 50_000, 48
_TWO_BLANKS = re.compile(r" \s|\s ")
_SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: Pieces made of characters whose class (letter, digit, sign, line end) no Unicode version has changed, without apostrophes
#: and without two blanks in a row, and the words that byte-level patterns cut them into.
_COMMON = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ſ0-9!-&(-/:-@\[-`{-~]|(?<=[^\s])\n(?=[^\s]))+")
_WORDS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n")
#: A word with the spaces before it, and after the last word those to the end.
_BLANK_WORDS = re.compile(r" +[^ ]+(?: +\Z)?")


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level BPE files use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Memory(dict):
    """Remembers results of ``make``; when full, the older half of what was seen is forgotten."""

    def __init__(self, make, room: int) -> None:
        super().__init__()
        self.make, self.room, self.older = make, room, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """``encode(text)``: the ids of a whole text as little-endian bytes, equal to ``Tokenizer.encode`` of it.

    Byte-level BPE works on words that its pattern cuts out. A text of common characters only is cut by ``_WORDS``, which
    agrees with the pattern there, and each word is encoded once by the BPE model and remembered. Any other text is cut at its
    single spaces, each of which starts a new word, and the pieces are done in the same way or by the whole tokenizer.
    Without ``special``, names of special tokens in a text are plain text.
    """

    def __init__(self, path: str, special: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.plain = "ByteLevel" in repr(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        self.alphabet = byte_alphabet()
        self.words = Memory(self._word, WORDS)
        self.pieces = Memory(self._piece, PIECES)

    def _pack(self, ids: list[int]) -> bytes:
        packed = array("H" if self.kind == "<u2" else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """One word of the pattern, with the space before it if any."""
        mapped = word.encode().decode("latin-1").translate(self.alphabet)
        return self._pack([t.id for t in self.tokenizer.model.tokenize(mapped)])

    def _piece(self, piece: str) -> bytes:
        if _COMMON.fullmatch(piece):
            return b"".join(map(self.words.__getitem__, _WORDS.findall(piece)))
        return self.whole(piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain or any(s in text for s in self.special):
            return self.whole(text)
        words = _WORDS.findall(text)
        if "\n\n" not in text and sum(map(len, words)) == len(text):
            return b"".join(map(self.words.__getitem__, words))
        parts = _SINGLE_BLANK.split(text) if _TWO_BLANKS.search(text) else text.split(" ")
        first = self.pieces[parts[0]] if parts[0] else b""
        return first + b"".join(map(self.pieces.__getitem__, [" " + p for p in parts[1:]]))


class PieceEncoder:
    """``encode(text)``: the ids of a whole text by a sentencepiece model, as little-endian bytes.

    Where no piece of the vocabulary has a blank after another character, no merge crosses from a word into the blank
    after it, so a text is cut there, and each word with the blanks before it is encoded once and remembered.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.kind = "<u2" if len(self.pieces) <= 1 << 16 else "<u4"
        self.plain = not any("\u2581" in p.lstrip("\u2581") for p in self.pieces)
        # blanks must all stay, and one more come first
        self.plain &= "".join(self.model.encode("a  b ", out_type=str)).replace("\u2581", " ") == " a  b "
        self.words = Memory(self._word, WORDS)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        return self._pack(self.model.encode(word[1:], num_threads=1))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain or text.isspace():
            return self._pack(self.model.encode(text, num_threads=1))
        return b"".join(map(self.words.__getitem__, _BLANK_WORDS.findall(" " + text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, made once per worker and given up when its tasks turn to another operator."""
    one_memory(_encoders)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
