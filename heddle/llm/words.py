"""Words of a text as ids: white-space words are looked up in a bounded memory and only new ones are tokenized.

The tokenizer file's rules never join characters across white space, so a text's ids are its words' ids one after another.
Special tokens written in a text are cut out first, as the tokenizers library does with tokens that aren't normalized.
cut_words does what the memory does for its new words, short of the merges, for many words at once.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space of the tokenizer file's pattern; str.split() also splits at the four information separators.
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Of words with code points below U+0250 but U+0130, which both sides lower-case and class alike.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = re.compile(r"[\x21-\x7e\xa1-\u012f\u0131-\u024f]*")
#: Code points from here on are not PLAIN.
NEAR = 0x250
LETTER, NUMBER, OTHER = range(3)


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable bytes for themselves, the rest from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def binaries(ends: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    """data cut at ends, of which the first is 0."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])


def laid(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """ends and data of large strings or binaries without nulls."""
    if not len(values):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
    return ends - ends[0], np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]


def replaced(values: pa.Array, where: np.ndarray, by: list[bytes]) -> pa.Array:
    """values with others where where is true."""
    place = np.arange(len(values))
    place[where] = len(values) + np.arange(len(by))
    return pa.concat_arrays([values, pa.array(by, values.type)]).take(pa.array(place))


@lru_cache(maxsize=1)
def near() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of code points up to NEAR: the lower-case one, its kind, and whether PLAIN holds and lower case stays below NEAR."""
    points = [chr(c) for c in range(NEAR + 1)]
    low = [p.lower() for p in points]
    fine = [bool(PLAIN.fullmatch(p)) and len(x) == 1 and ord(x) < NEAR for p, x in zip(points, low)]
    low = [x if ok else p for p, x, ok in zip(points, low, fine)]
    kind = [LETTER if regex.fullmatch(r"\p{L}", x) else NUMBER if regex.fullmatch(r"\p{N}", x) else OTHER for x in low]
    return np.array([ord(x) for x in low]), np.array(kind), np.array(fine)


def cut_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-case pre-tokens of many words, as PIECES finds them: their bytes, where each ends (after a 0), the number of pre-tokens
    before each word and in all, and which words are odd: those have code points that near() doesn't hold fine, and get no pre-tokens here."""
    low_of, kind_of, fine = near()
    points = np.minimum(np.frombuffer(laid(words)[1].tobytes().decode().encode("utf-32-le"), "<u4"), NEAR)
    owner = np.repeat(np.arange(len(words)), pc.utf8_length(words).to_numpy())
    odd = np.zeros(len(words), bool)
    odd[owner[~fine[points]]] = True
    if odd.any():
        stays = ~odd[owner]
        points, owner = points[stays], owner[stays]
    low, kind, n = low_of[points], kind_of[points], len(points)
    starts = np.ones(n + 3, bool)
    starts[1:n] = (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quotes = np.flatnonzero(starts[:n] & (low == ord("'")))
    if len(quotes):  # 's, 't, 're, 've, 'm, 'll, 'd
        (a, b), (of_a, of_b) = ([np.append(x, [-1, -1])[quotes + k] for k in (1, 2)] for x in (low, owner))
        one = np.isin(a, [ord(c) for c in "stmd"]) & (of_a == owner[quotes])
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (of_b == owner[quotes])
        starts[quotes[one | two] + 1] = False
        starts[quotes[one] + 2] = starts[quotes[two] + 3] = True
    wide = low >= 0x80
    at = np.cumsum(np.concatenate([[0], 1 + wide]))
    flat = np.empty(at[-1], np.uint8)
    flat[at[:-1]] = np.where(wide, 0xC0 | low >> 6, low)
    flat[at[:-1][wide] + 1] = 0x80 | low[wide] & 0x3F
    begin = np.flatnonzero(starts[:n])
    first = np.cumsum(np.concatenate([[0], np.bincount(owner[begin], minlength=len(words))]))
    return flat, np.append(at[begin], len(flat)) if len(begin) else np.zeros(1, np.int64), first, odd


class WordMemory(dict):
    """word -> its ids as little-endian 32-bit bytes. encode: a pre-token in byte letters -> ids.

    Holds the words of late: at limit words those so far become the older half, and the half before that is forgotten."""

    def __init__(self, tokenizer, encode, limit: int = 200_000):
        super().__init__()
        self.normalize, self.cut, self.encode, self.limit = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str, encode, limit
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.letters = byte_letters()
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = {k: int(v).to_bytes(4, "little") for k, v in special.items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def spelled(self, s: str) -> bytes:
        """Of a pre-token in byte letters."""
        if (got := self.pieces.get(s)) is None:
            if (got := self.old_pieces.get(s)) is None:
                got = array("I", self.encode(s)).tobytes()
            if len(s) <= 40:
                if len(self.pieces) >= self.limit:
                    self.old_pieces, self.pieces = self.pieces, {}
                self.pieces[s] = got
        return got

    def __missing__(self, word: str) -> bytes:
        if (got := self.older.get(word)) is None:
            low = word.lower()
            if low.isascii():
                if low.isalpha():
                    got = self.spelled(low)
                elif low[-1] in ".,!?;:" and low[:-1].isalpha():
                    got = self.spelled(low[:-1]) + self.spelled(low[-1])
            if got is None:
                if PLAIN.fullmatch(word):
                    letters = self.letters
                    got = b"".join([self.spelled(p if p.isascii() else "".join([letters[b] for b in p.encode()])) for p in PIECES.findall(low)])
                else:
                    got = b"".join([self.spelled(s) for s, _ in self.cut(self.normalize(word))])
        if len(word) <= 40:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got

    def ids(self, text: str | None) -> bytes:
        """All ids of a whole text; null is as empty."""
        if not text:
            return b""
        if self.special_at and "<" in text and self.special_at.search(text):
            return b"".join([self.special.get(p) or self.plain(p) for p in self.special_at.split(text)])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return b"".join(map(self.__getitem__, filter(None, SPACE.split(text)) if odd else text.split()))
