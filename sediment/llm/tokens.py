"""Token ids by a public tokenizer, with ids of repeated words looked up instead of computed again.

The pre-tokenizers of both vocabularies never join text across a lone blank or line end between two other
characters, nor across the end of a run of Latin letters that ASCII punctuation and then white space follow. So a
text is cut there, each distinct piece goes through the tokenizers library once per worker process, and the ids are
joined. Odd white space stays inside its piece, together with the words on both sides.
"""

from __future__ import annotations

import array
import re
import sys
from collections.abc import Callable
from functools import cache

_PIECES_WITH_ODD_SPACE = re.compile(r"(?:\A\s+)?(?: ?\S+)(?:(?:\s\s+|[^\S \n]|\s+\Z)\S*)*|\n|\s+")
#: Letters whose class all Unicode versions agree on; punctuation without the apostrophe, which may begin "'s" or "'re".
_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
_LETTERS_THEN_MARKS = re.compile(rf"( ?{_LETTER}++)?({_MARK}++)?")
#: So many pieces are remembered at most, and so many of the later ones for a while; none of over so many characters. The
#: others are computed anew, which bounds the memory of a worker.
KNOWN_PIECES, RECENT_PIECES, LONGEST_KNOWN = 300_000, 20_000, 100


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class _Known(dict):
    """Ids of pieces; those that are not there are learned as they are looked up."""

    def __init__(self, learn: Callable[[str], bytes]):
        self._learn, self._recent = learn, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self._recent.get(piece)
        if ids is None:
            ids = self._learn(piece)
            if len(piece) <= LONGEST_KNOWN:
                if len(self) < KNOWN_PIECES:
                    self[piece] = ids
                else:
                    if len(self._recent) >= RECENT_PIECES:
                        self._recent.clear()
                    self._recent[piece] = ids
        return ids


class PieceEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._merge = self._tokenizer.model.tokenize
        self._drops_space = not self._tokenizer.encode(" ", add_special_tokens=False).ids
        self._alphabet = _byte_letters()
        self._known = _Known(self._learn)

    def _ids(self, ids: list[int]) -> bytes:
        out = array.array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _cut(self, text: str) -> list[str]:
        words = text.split()
        if " ".join(words) == text.replace("\n", " "):  # white space is single blanks and line ends, inside only
            if self._drops_space:
                return words
            return self._with_space(text)
        if self._drops_space:
            return text.replace("\n", " ").split(" ")
        if not words:  # blanks alone are one run to the end
            return [text]
        return _PIECES_WITH_ODD_SPACE.findall(text)

    @staticmethod
    def _with_space(text: str) -> list[str]:
        pieces: list[str] = []
        for line in text.split("\n"):
            if pieces:
                pieces.append("\n")
            words = line.replace(" ", "\n ").split("\n")  # each word keeps the blank before it
            pieces += words
        return pieces

    def _learn(self, piece: str) -> bytes:
        """Ids of letters and then punctuation from both parts, those of one pretoken by the library's model alone (the steps
        before it are known here), all others by the library."""
        if (m := _LETTERS_THEN_MARKS.fullmatch(piece)) and piece:
            letters, marks = m.groups()
            if letters and marks:
                return self._known[letters] + self._known[marks]
            if piece.isascii():  # printable ASCII stands for itself
                shown = piece.lower() if self._drops_space else "Ġ" + piece[1:] if piece[0] == " " else piece
            else:
                shown = (piece.lower() if self._drops_space else piece).encode().decode("latin-1").translate(self._alphabet)
            return self._ids([t.id for t in self._merge(shown)])
        return self._ids(self._tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids = self._known.__getitem__
        return [b"".join(map(ids, self._cut(text))) for text in texts]


@cache
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path)
