"""BPE encoding and decoding with a contiguous rank array per word (operator 3).

encode(df) adds an array of ids, decode(df) turns such arrays back into text. Both are Arrow functions over Spark's own
partitions and batches; nothing is shuffled. An empty table gives no rows, null and empty texts give an empty array, repeated rows the same array each,
very long texts are read whole,
other columns stay as they are (an existing column of the output's name is replaced). Ids outside the vocabulary decode to
nothing. Very long words are merged through a heap, with the same result, as the array's scan is quadratic.

Texts go in slices of SLICE bytes or one text. The distinct words of a slice are cut into pre-tokens; the rank arrays of its
distinct pre-tokens of one length lie side by side, so that a step merges one pair in each of them.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .words import WordMemory, binaries, byte_letters, cut_words, laid, replaced

NONE = 1 << 60
SHORT = 200
#: Bytes of texts whose words are taken together; fewest words of one length, and most of their letters, merged side by side.
SLICE, FEW, SIDE = 1 << 22, 32, 1 << 17


class RankArray:
    """The merges of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(merges)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        known = dict.fromkeys([*self.letters, *(c + self.suffix for c in self.letters), *(p for a, b in self.ranks for p in (a, b, a + b))])
        number = {p: k for k, p in enumerate(known)}
        self.inner, self.last = (np.array([number[c + end] for c in self.letters]) for end in ("", self.suffix))
        #: The number of no part.
        self.blank = len(number)
        self.id_of = np.array([*(self.ids.get(p, -1) for p in number), -1])
        rows = np.array([(self.key(number[a], number[b]), r, number[a + b]) for (a, b), r in self.ranks.items()], np.int64).reshape(-1, 3)
        rows = rows[np.argsort(rows[:, 0])]
        self.pairs, self.order = np.append(rows[:, 0], NONE), np.append(rows[:, 1], 0)
        self.joined = np.zeros(len(model["merges"]), np.int64)
        self.joined[rows[:, 1]] = rows[:, 2]

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-token in byte letters."""
        if not word:
            return []
        parts = list(word)
        parts[-1] += self.suffix
        if len(parts) > SHORT:
            parts = self.heap(parts)
        else:
            self.merge(parts)
        return [i for p in parts if (i := self.ids.get(p)) is not None]

    def merge(self, parts: list[str]) -> None:
        """Joins parts in place; ranks[i] is that of parts i and i+1."""
        get = self.ranks.get
        ranks = [get(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            parts[i] = one = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((one, parts[i + 1]), NONE)
            if i:
                ranks[i - 1] = get((parts[i - 1], one), NONE)

    def key(self, left, right):
        """One number for two."""
        return left * (self.blank + 1) + right

    def places(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank * 256 + at of pairs of part numbers, NONE of those without a rank."""
        key = self.key(left, right)
        found = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[found] == key, self.order[found] * 256 + at, NONE)

    def side_by_side(self, letters: np.ndarray) -> np.ndarray:
        """Part numbers of words of one length, SHORT at most; a column is a word, and blank stands where a part was joined to the one before.

        The last row of each array stands for what lies outside the words."""
        n, words = letters.shape
        row = np.arange(n)[:, None]
        parts, ranks = np.full((n + 1, words), self.blank), np.full((n + 1, words), NONE)
        parts[: n - 1], parts[n - 1] = self.inner[letters[:-1]], self.last[letters[-1]]
        ranks[: n - 1] = self.places(parts[: n - 1], parts[1:n], row[:-1])
        after, before = np.repeat([*range(1, n + 1), n], words), np.repeat([n, *range(n)], words)
        part, rank = parts.reshape(-1), ranks.reshape(-1)
        live = np.arange(words)
        while len(live):
            least = (ranks if len(live) == words else ranks[:, live]).min(axis=0)
            live, least = live[least < NONE], least[least < NONE]
            i = least & 255
            here = i * words + live
            gone = after[here] * words + live
            j, h = after[gone], before[here]
            right, left = j * words + live, h * words + live
            part[here], part[gone], rank[gone] = self.joined[least >> 8], self.blank, NONE
            after[here], before[right] = j, i
            rank[here], rank[left] = self.places(part[here], part[right], i), self.places(part[left], part[here], h)
        return parts[:n]

    def encode_all(self, words: pa.Array) -> pa.LargeBinaryArray:
        """Ids of pre-tokens, given as their bytes, as little-endian 32-bit bytes."""
        ends, data = laid(words)
        lengths = np.diff(ends)
        order = np.argsort(lengths, kind="stable")
        counts, ids = [np.zeros(1, np.int64)], [np.empty(0, "<i4")]
        for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else ():
            n = int(lengths[some[0]])
            if 0 < n <= SHORT and len(some) >= FEW:
                step = max(FEW, SIDE // n)
                for k in range(0, len(some), step):
                    found = self.id_of[self.side_by_side(data[ends[some[k : k + step]] + np.arange(n)[:, None]]).T]
                    counts.append((found >= 0).sum(axis=1))
                    ids.append(found[found >= 0].astype("<i4"))
            else:
                for k in some:
                    found = self.encode("".join([self.letters[b] for b in data[ends[k] : ends[k + 1]].tolist()]))
                    counts.append(np.array([len(found)]))
                    ids.append(np.array(found, "<i4"))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return binaries(np.cumsum(np.concatenate(counts)) * 4, np.concatenate(ids)).take(pa.array(place))

    def heap(self, parts: list[str]) -> list[str]:
        """The same merges for a long word: lowest rank first, leftmost among equals."""
        after, before, alive = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)], [True] * len(parts)
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = left + right, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) >= 0 and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(queue, (r, a, parts[a], parts[b]))
        return [p for p, live in zip(parts, alive) if live]


class TextEncoder(WordMemory):
    """Texts as ids, the words of many texts together. encode: ids of one pre-token in byte letters; encode_all: of many, given as
    their bytes, or else those new to the memory go to encode. Of words the memory has only those beyond cut_words and of texts with marks."""

    def __init__(self, tokenizer: Tokenizer, encode, encode_all=None):
        super().__init__(tokenizer, encode)
        self.encode_all = encode_all or self.spelled_all
        #: What has a text split by ids(): special tokens, and separators that are no white space in the tokenizer file.
        self.marks = [*self.special, "\x1c", "\x1d", "\x1e", "\x1f"]

    def spelled_all(self, pieces: pa.Array) -> pa.LargeBinaryArray:
        letters = self.letters
        keys = pieces.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        keys = [k if k.isascii() else "".join([letters[b] for b in k.encode()]) for k in keys]
        return pa.array([self.spelled(k) if ids is None else ids for k, ids in zip(keys, map(self.pieces.get, keys))], pa.large_binary())

    def of_words(self, words: pa.Array) -> pa.Array:
        flat, ends, first, odd = cut_words(words)
        pieces = binaries(ends, flat).dictionary_encode()
        ends, data = laid(self.encode_all(pieces.dictionary).take(pieces.indices))
        out = binaries(ends[first], data)
        return replaced(out, odd, [self[w] for w in words.filter(pa.array(odd)).to_pylist()]) if odd.any() else out

    def of_slice(self, texts: pa.Array) -> pa.Array:
        whole, marked = laid(texts)[1].tobytes(), np.zeros(len(texts), bool)
        for m in self.marks:
            if m.encode() in whole:
                marked |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        lists = pc.utf8_split_whitespace(pc.if_else(pa.array(marked), "", texts) if marked.any() else texts)
        words = lists.flatten().dictionary_encode()
        ends, data = laid(self.of_words(words.dictionary).take(words.indices))
        out = binaries(ends[lists.offsets.to_numpy()], data)
        return replaced(out, marked, [self.ids(t) for t in texts.filter(pa.array(marked)).to_pylist()]) if marked.any() else out

    def of_texts(self, texts: pa.Array) -> pa.ListArray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        starts = laid(texts)[0][:-1] // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(starts)) + 1).tolist(), len(texts)]
        slices = [laid(self.of_slice(texts[a:b])) for a, b in zip(cuts, cuts[1:]) if b > a]
        ends = np.cumsum(np.concatenate([[0], *(np.diff(e) // 4 for e, _ in slices)]))
        ids = np.concatenate([np.empty(0, "<i4"), *(d.view("<i4") for _, d in slices)])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One a Python worker; its memory of words is bounded."""
    array = RankArray(path)
    return TextEncoder(Tokenizer.from_file(path), array.encode, array.encode_all)


@lru_cache(maxsize=2)
def names(path: str) -> pa.Array:
    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out: list[str | None] = [None] * (max(vocab.values()) + 1)
    for k, i in vocab.items():
        out[i] = k
    return pa.array(out, pa.string())


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column ids (array<int>) of each whole text."""

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        return encoder(tokenizer).of_texts(texts)

    return df.withColumn(ids, of(F.col(text)))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text of its ids, as the library's decode without a decoder: the tokens joined by one space."""

    @F.arrow_udf("string")
    def of(lists: pa.Array) -> pa.Array:
        tokens = names(tokenizer)
        flat, lengths = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        at = flat.to_numpy(zero_copy_only=False)
        known = (at >= 0) & (at < len(tokens))
        if not known.all():
            owner = np.repeat(np.arange(len(lengths)), lengths)[known]
            at, lengths = at[known], np.bincount(owner, minlength=len(lengths))
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens.take(pa.array(at))), " ")

    return df.withColumn(decoded, of(F.col(ids)))
