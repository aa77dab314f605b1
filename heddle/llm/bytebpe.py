"""Byte-level BPE by merge replay over many words at once (operator 13).

encode(df) adds an array of ids, decode(df) turns such arrays back into bytes. A rank file (tiktoken's format) gives the merges:
the rank of a token is its id and its place in the order of merges. A task cuts its texts into the pattern's matches, gathers
the distinct ones that it has not met of late, and replays the merges over all of them together: an inverted index has, for each
rank, the places in these words where a pair of that joint spelling stands; ranks are taken in order, every live place of one is
merged, and only the two pairs beside it are looked up anew and put in the index.

A word's ids depend on the word alone, so texts stay where they are and nothing is shuffled: a table of all words of a corpus
would have to be joined with every occurrence. Words met before are held in a memory of bounded size, the rest of a slice of
SLICE characters is replayed in one go.

An empty table gives no rows, null and empty texts an empty array, repeated rows the same array each; very long texts are read
whole, in slices; other columns stay as they are (an existing column of the output's name is replaced). Text that looks like a
special token is ordinary text. Ids outside the vocabulary, negative or null, decode to nothing, a null array to no bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters whose words are replayed together; words held in each half of the memory; letters of a word that is held.
SLICE, HELD, LONGEST = 1 << 22, 300_000, 40
#: Code points that the pattern of a task names one by one; others stand for their class.
NEAR = 0x250


class Replay:
    """The merges of a rank file over many words."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.spelled = {r: token for token, r in self.ranks.items()}
        try:
            self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        except KeyError as e:
            raise ValueError(f"{path} has no token for the byte {e.args[0]!r}") from None
        self.of_bytes = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        self.joint: dict[tuple[int, int], int] = {}

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each, as little-endian 32-bit bytes; no word is empty."""
        if not words:
            return []
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        n = len(flat)
        last = np.zeros(n, bool)
        last[ends - 1] = True
        pair = np.full(n, -1)
        pair[:-1] = self.of_bytes[flat[:-1] * 256 + flat[1:]]
        pair[last] = -1
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        found, first = np.unique(pair[at], return_index=True)
        index = {int(r): places.tolist() for r, places in zip(found, np.split(at, first[1:]))}
        after = np.where(last, -1, np.arange(1, n + 1)).tolist()
        before = np.where(np.concatenate([[True], last[:-1]]), -1, np.arange(-1, n - 1)).tolist()
        tokens, early = self.replayed(index, self.of_byte[flat].tolist(), pair.tolist(), before, after)
        live = np.array(tokens)
        kept = live >= 0
        out, size = live[kept].astype("<u4").tobytes(), np.cumsum(np.concatenate([[0], kept])) * 4
        starts = size[np.concatenate([[0], ends])].tolist()
        ids = [out[a:b] for a, b in zip(starts, starts[1:])]
        for k in {*np.searchsorted(ends, early, "right").tolist()}:
            ids[k] = np.array(self.one(words[k]), "<u4").tobytes()
        return ids

    def look(self, a: int, b: int) -> int:
        """The rank of two tokens' joint spelling, -1 for none."""
        out = self.joint[a, b] = self.ranks.get(self.spelled[a] + self.spelled[b], -1)
        return out

    def replayed(self, index: dict[int, list[int]], token: list[int], pair: list[int], before: list[int], after: list[int]) -> tuple[list[int], list[int]]:
        """The token at each place, -1 where one was merged into another, and places of words to be done by themselves.

        pair: the rank of the pair that begins at a place, -1 for none. Merges go by rank, places of a rank from left to right,
        as in each word alone. Only if a merge brings up a rank lower than its own would a word go back to that first: such words,
        of no trained vocabulary seen, are told."""
        joint, early = self.joint, []
        queue = list(index)
        heapify(queue)

        def stands(at: int, q: int, r: int) -> None:
            """From now on a pair of rank q begins there."""
            pair[at] = q
            if q < r:
                early.append(at)
            if (known := index.get(q)) is None:
                index[q] = [at]
                heappush(queue, q)
            else:
                known.append(at)

        while queue:
            r = heappop(queue)
            places = index.pop(r)
            places.sort()
            for i in places:
                if pair[i] != r:
                    continue  # merged since
                j = after[i]
                k = after[i] = after[j]
                token[i], token[j], pair[j] = r, -1, -1
                if k < 0:
                    pair[i] = -1
                else:
                    before[k] = i
                    if (q := joint.get((r, token[k]))) is None:
                        q = self.look(r, token[k])
                    if q < 0:
                        pair[i] = -1
                    else:
                        stands(i, q, r)
                if (h := before[i]) >= 0:
                    if (q := joint.get((token[h], r))) is None:
                        q = self.look(token[h], r)
                    if q < 0:
                        pair[h] = -1
                    else:
                        stands(h, q, r)
        if len(joint) > 1_000_000:
            joint.clear()
        return token, early

    def one(self, word: bytes) -> list[int]:
        """Of a word by itself: the lowest rank first, leftmost among equals."""
        parts = [bytes([b]) for b in word]
        while True:
            least = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if least is None:
                return [self.ranks[p] for p in parts]
            parts[least[1] : least[1] + 2] = [parts[least[1]] + parts[least[1] + 1]]


class Classes(dict):
    """For str.translate: each code point as one that the task's pattern names, of the same class by tiktoken's own tables."""

    def __init__(self):
        import tiktoken

        super().__init__({c: c for c in range(NEAR)})
        every = {bytes([b]): b for b in range(256)}
        self.tests = {k: tiktoken.Encoding(k, pat_str=k, mergeable_ranks=every, special_tokens={}) for k in (r"\p{L}", r"\p{N}", r"\s")}
        self.near = {k: [c for c in range(NEAR) if self.is_in(c, k)] for k in self.tests}
        none = next(c for c in range(128, NEAR) if not any(c in v for v in self.near.values()))
        self.stand = {k: next(c for c in v if c >= 128) for k, v in self.near.items()} | {"": none}

    def is_in(self, c: int, kind: str) -> bool:
        return bool(self.tests[kind].encode_ordinary(chr(c)))

    def __missing__(self, c: int) -> int:
        self[c] = out = self.stand[next((k for k in self.tests if self.is_in(c, k)), "")]
        return out

    def named(self, pattern: str) -> re.Pattern:
        """The pattern with its classes of letters, numbers and white space written out."""
        inside = {k: "".join(map(re.escape, map(chr, v))) for k, v in self.near.items()}
        held = re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"\\p\{[LN]\}|\\s", lambda x: inside[x[0]], m[0]), pattern)
        held = re.sub(r"\\p\{[LN]\}|\\s", lambda x: f"[{inside[x[0]]}]", held).replace(r"\S", f"[^{inside[chr(92) + 's']}]")
        if re.search(r"\\[pPwWdDbBhHvVX]", held):
            raise ValueError(f"of classes, {pattern} may name letters, numbers and white space only")
        return re.compile(held)


class Words:
    """Texts as ids, through the words of late."""

    def __init__(self, path: str, pattern: str, held: int = HELD):
        self.replay, self.classes, self.limit = Replay(path), Classes(), held
        self.pattern, self.far = self.classes.named(pattern), re.compile(rf"[^\x00-{chr(NEAR - 1)}]")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def cut(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches; long texts give several lists."""
        near = text if self.far.search(text) is None else text.translate(self.classes)
        if len(text) <= SLICE and near is text:
            yield self.pattern.findall(text)
        else:
            spans = (m.span() for m in self.pattern.finditer(near))
            while some := list(islice(spans, SLICE // 4)):
                yield [text[a:b] for a, b in some]

    def learn(self, words: Iterable[str]) -> list[str]:
        """known has all of them afterwards; those too long to stay."""
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        unseen = set(words).difference(self.known)
        again = unseen.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        spelled = {w: w.encode() for w in unseen.difference(again)}
        whole = {w: r.to_bytes(4, "little") for w, s in spelled.items() if (r := self.replay.ranks.get(s)) is not None}
        rest = [w for w in spelled if w not in whole]
        self.known.update(whole)
        self.known.update(zip(rest, self.replay.words([spelled[w] for w in rest])))
        return [w for w in spelled if len(w) > LONGEST]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """All ids of each, as little-endian 32-bit bytes."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        room = SLICE

        def settle() -> None:
            long = self.learn(chain.from_iterable(words for _, words in held))
            for k, words in held:
                out[k].append(b"".join(map(self.known.__getitem__, words)))
            for w in long:
                del self.known[w]
            held.clear()

        for k, text in enumerate(texts):
            for words in self.cut(text) if text else ():
                held.append((k, words))
                room -= len(words) * 5
                if room <= 0:
                    settle()
                    room = SLICE
        settle()
        return [b"".join(x) for x in out]


@lru_cache(maxsize=2)
def memory(path: str, pattern: str) -> Words:
    """One a Python worker."""
    return Words(path, pattern)


@lru_cache(maxsize=2)
def tokens(path: str) -> pa.Array:
    spelled = Replay(path).spelled
    return pa.array([spelled.get(i, b"") for i in range(max(spelled) + 1)], pa.binary())


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column ids (array<int>) of each whole text: the pattern's matches, each encoded by itself."""

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        raw = memory(ranks, pattern).ids(texts.to_pylist())
        ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))

    return df.withColumn(ids, of(F.col(text)))


def decode(df: DataFrame, ranks: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes of its ids (binary)."""

    @F.arrow_udf("binary")
    def of(lists: pa.Array) -> pa.Array:
        known = tokens(ranks)
        flat, lengths = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        at = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
        fine = (at >= 0) & (at < len(known))
        if not fine.all():
            owner = np.repeat(np.arange(len(lengths)), lengths)[fine]
            at, lengths = at[fine], np.bincount(owner, minlength=len(lengths))
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), known.take(pa.array(at))), b"")

    return df.withColumn(decoded, of(F.col(ids)))
