"""BPE ids by the tokenizers library, with a bounded memo of pre-tokens.

BPE merges only within the pieces that its pattern cuts a text into, so ids of a text are those of its pieces one after
another. Pieces repeat; each worker remembers the ids of recent ones and asks the library for the others.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

from lodestone.llm.common import held, slices

VOCABULARY = "byte_bpe_50k.json"
SPACED_VOCABULARY = "word_bpe_49k.json"


def _below(limit: int, *kinds: str) -> str:
    """The characters below `limit` whose category begins with one of `kinds`, for a character class."""
    return "".join(re.escape(chr(i)) for i in range(limit) if unicodedata.category(chr(i)).startswith(kinds))


#: The white space of the vocabularies' published patterns, which knows neither \x1c-\x1f nor ASCII-only rules.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Composition changes no text whose characters are all below this one, and letters and numbers below it are listed in classes.
_FIRST_MARK = 0x300
_MARKED = re.compile(f"[{chr(_FIRST_MARK)}-\U0010ffff]")
_LETTERS, _NUMBERS = _below(_FIRST_MARK, "L"), _below(_FIRST_MARK, "N")


def _pieces(letters: str, numbers: str) -> str:
    """The byte-level vocabulary's published pre-token pattern with these classes of letters and numbers."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


#: That pattern for all texts, for those below _FIRST_MARK and for ASCII texts.
_PIECES = regex.compile(_pieces(r"\p{L}", r"\p{N}"))
_LATIN_PIECES, _ASCII_PIECES = re.compile(_pieces(_LETTERS, _NUMBERS)), re.compile(_pieces("A-Za-z", "0-9"))
#: What ASCII white space parts.
_CHUNK = re.compile(r"[^\t-\r ]+")
#: The published pattern of the vocabulary that drops white space, on lower-case text below _FIRST_MARK.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> dict[int, str]:
    """The visible letter of each byte in a byte-level vocabulary: printable ones are their own, the rest follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. A lone surrogate, which UTF-8 can't hold, becomes '?'."""

    #: Pre-tokens that a generation of the memo holds, some 30 MB; two generations live at once.
    MEMO = 300_000

    def __init__(self, path: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = (_ASCII_PIECES if text.isascii() else _PIECES if _MARKED.search(text) else _LATIN_PIECES).findall(text)
        new = self.new
        try:
            return b"".join(map(new.__getitem__, pieces))
        except KeyError:
            pass
        old, tokenize, letters = self.old, self.model.tokenize, self.letters
        for piece in set(pieces).difference(new):
            ids = old.pop(piece, None)
            if ids is None:
                ids = array("I", [t.id for t in tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(letters))]).tobytes()
            new[piece] = ids
        out = b"".join(map(new.__getitem__, pieces))
        if len(new) > self.MEMO:
            self.old, self.new = new, {}
        return out


class SpacedEncoder:
    """Ids of UTF-8 texts by a vocabulary that drops white space and merges nothing across it.

    Lower-casing, composition of accents and the pattern all stay within what white space parts, so a text is taken in slices.
    A slice without marks that compose is cut by the pattern here and the library's model is asked for new pieces; of another
    slice, the library encodes each chunk between ASCII spaces that is new.
    """

    #: Pieces or chunks that a generation of a memo holds; longer ones than LONGEST are not remembered.
    MEMO = 300_000
    LONGEST = 64

    def __init__(self, path: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path or vocabulary_path(SPACED_VOCABULARY))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: list[dict[str, bytes]] = [{}, {}]
        self.chunks: list[dict[str, bytes]] = [{}, {}]

    def _of_piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def _of_chunk(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def _ids(self, parts: list[str], memo: list[dict[str, bytes]], of_part: Callable[[str], list[int]]) -> bytes:
        new, old = memo
        try:
            return b"".join(map(new.__getitem__, parts))
        except KeyError:
            missing = set(parts).difference(new)
        for part in missing:
            ids = old.get(part)
            new[part] = array("I", of_part(part)).tobytes() if ids is None else ids
        out = b"".join(map(new.__getitem__, parts))
        for part in missing:
            if len(part) > self.LONGEST:
                del new[part]
        if len(new) > self.MEMO:
            memo[:] = {}, new
        return out

    def _slice(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if _MARKED.search(text) is None and not any(s in text for s in self.special):
            return self._ids(_WORDS.findall(text.lower()), self.pieces, self._of_piece)
        return self._ids(_CHUNK.findall(text), self.chunks, self._of_chunk)

    def encode(self, raw: bytes) -> bytes:
        return b"".join(map(self._slice, slices(raw)))


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder; workers are used again by later tasks."""
    return held(("encoder", path), lambda: Encoder(path))


def spaced_encoder(path: str | None = None) -> SpacedEncoder:
    return held(("spaced encoder", path), lambda: SpacedEncoder(path))
