"""Exact ids of the tokenizers library at the speed of a dictionary: a text is cut where the tokenizer's own
pre-tokenizer always cuts, each different piece is encoded once by the library, and ids are joined as bytes.

Both files cut at a single space or line end between words. A key is the word behind a space, a line end and the word
behind it, or NUL and a piece that nothing stands before (for the file that drops white space, just the word). A word of
Latin letters goes to the library's model alone, since its normalizer and pre-tokenizer leave such a word whole; other
pieces go through all of the library. Texts for which the cuts are not certain (special tokens, other white space,
pieces longer than LONG) are given to the library whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

#: Pieces held in each of two generations, about 200 bytes each; pieces longer than LONG are never held.
PIECES, LONG = 400_000, 200

_RUNS = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
#: Letters whose normal forms and lower case are single letters of this class, and the signs that both files cut off.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ſ"
_WORD_SIGNS = re.compile(f"([{_LETTERS}]+)([.,!?;:*#$%&|]*)")
#: Any of these sends a text to the library whole: special tokens, and white space other than blank and line end.
_UNSURE = re.compile("<\\||[\\x00\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")


class _Unsure(Exception):
    """The cuts around a piece are not certain."""


class Encoder(dict):
    """raw(text) gives the ids. drops_space: the ids do not depend on the white space between words, nor on case.

    The dictionary itself is from keys to ids; a key that is not there yet is learnt when it is asked for.
    """

    def __init__(self, path: str, drops_space: bool, pieces: int = PIECES):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.pieces, self.drops_space = pieces, drops_space
        self.library = Tokenizer.from_file(path)
        self.word = self.library.model.tokenize
        spelt = self.library.pre_tokenizer.pre_tokenize_str
        self.bytewise = str.maketrans({c: spelt(c)[0][0] for c in re.findall(f"[{_LETTERS}]", "".join(map(chr, range(0x180))))})
        self.space = "" if drops_space else spelt(" a")[0][0][:-1]
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self._learn(key)
        if len(self) > self.pieces:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        self[key] = ids
        return ids

    def _learn(self, key: str) -> bytes:
        m = _WORD_SIGNS.fullmatch(key, not self.drops_space and key[0] == "\0")
        if m:
            word, signs = m.groups()
            if self.drops_space:
                if signs or not word.islower():
                    return self[word.lower()] + self[signs]
            elif signs:
                return self[key[: m.end(1)]] + self["\0" + signs]
            spelt = word if word.isascii() else word.translate(self.bytewise)
            return array("I", [t.id for t in self.word(spelt if key[0] == "\0" else self.space + spelt)]).tobytes()
        if len(key) > LONG or _UNSURE.search(key, key[0] == "\0"):
            raise _Unsure
        if self.drops_space or key[0] == "\0":
            return self.whole(key.removeprefix("\0"))
        if key[0] == "\n":
            return self.whole("\n") + self["\0" + key[1:]] if len(key) > 1 else self.whole("\n")
        return self.whole(" " + key)

    def _keys(self, text: str) -> list[str]:
        if self.drops_space:
            return text.replace("\n", " ").split(" ")
        keys = text.replace("\n", " \n").split(" ")
        if "\n\n" in text or "" in keys:  # runs of white space
            return [p[1:] if p[0] == " " and len(p) > 1 and p[1] not in " \n" else f"\0{p}" for p in _RUNS.findall(text)]
        if keys[0][0] != "\n":
            keys[0] = "\0" + keys[0]
        return keys

    def raw(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "\0" in text:  # it marks keys
            return self.whole(text)
        try:
            return b"".join(map(self.__getitem__, self._keys(text)))
        except _Unsure:
            return self.whole(text)


@lru_cache(maxsize=2)
def encoder(path: str, drops_space: bool, pieces: int = PIECES) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path, drops_space, pieces)
