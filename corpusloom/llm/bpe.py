"""Byte-pair encoding and decoding as a streaming transducer with bounded lookahead.

The merge list has a sufficient lookahead L (see `lookahead`): a boundary of the tokens of a buffered piece that lies
more than L bytes before the buffer's end is a boundary whatever follows.  So a pretoken of any length is encoded from a
window of a few L and tokens are emitted once they are stable.  Texts pass in blocks, ids are hashed as they are emitted,
and decoding runs them through the byte table and an incremental UTF-8 state machine: beside the text itself a digest
holds one block of ids, however long a pretoken is.

Cases: a null text is an empty text (no ids); the special token's string in a text is the special token, as in the
library; empty tables give empty results; repeated rows are encoded each for itself; a run of millions of letters
without a space is one pretoken and costs linear time; of other columns only those in carry are read, so none can clash.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from itertools import chain, islice

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import annotate

BLOCK = 1 << 18
CACHE = 100_000
LONG = 96
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it prints, else the next free character from 256 on."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(free)] = b
            free += 1
    return out


def char_class(test, last: int) -> str:
    """A character class body with all code points up to `last` that satisfy test."""
    parts, start = [], None
    for i in range(last + 2):
        yes = i <= last and not 0xD800 <= i <= 0xDFFF and test(chr(i))
        if yes and start is None:
            start = i
        elif not yes and start is not None:
            parts.append(f"\\U{start:08x}" + (f"-\\U{i - 1:08x}" if i - 1 > start else ""))
            start = None
    return "".join(parts)


@lru_cache(2)
def pretokens(last: int = sys.maxunicode) -> re.Pattern:
    """The byte-level splitting rule: contractions, letters, digits, other signs, each with one space before, and space.

    For texts with no code point above `last`; up to 0xFFFF the classes are single table lookups.
    """
    letter = char_class(lambda c: unicodedata.category(c)[0] == "L", last)
    digit = char_class(lambda c: unicodedata.category(c)[0] == "N", last)
    space = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")


def lookahead(merges: Sequence[tuple[bytes, bytes]]) -> int:
    """Bytes that suffice to the right of a boundary.

    If what follows can change whether a merge (u, v) crosses a boundary, then v, or a suffix q of v's merge tree, was
    taken from the right by an earlier merge (q, y), whose y in turn was formed or not because of a still earlier merge
    (q', z) at its own right end, and so on.  The bytes involved are |v| + |y| + |z| + ... along a chain of falling
    ranks; in rank order the longest chain is a table with one entry for each token.
    """
    right: dict[bytes, bytes] = {}
    best: dict[bytes, int] = {}
    longest = 0
    for u, v in merges:
        more, t = 0, v
        while t is not None:
            more = max(more, best.get(t, 0))
            t = right.get(t)
        reach = len(v) + more
        best[u] = max(best.get(u, 0), reach)
        right.setdefault(u + v, v)
        longest = max(longest, reach)
    return longest


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.rank = {p: r for p, (r, _) in self.pairs.items()}
        self.made = [vocab[a + b] for a, b in merges]
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.lookahead = lookahead(merges)
        self.said = [str(i) for i in range(len(self.bytes_of))]
        self.cache = Cache(self)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge_short(self, ids: list[int]) -> list[int]:
        """Apply the lowest-ranked pair, leftmost first, until none is left; only its neighbours' ranks change."""
        rank = self.rank.get
        ranks = [rank(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            new = self.made[best]
            ids[i : i + 2] = (new,)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((new, ids[i + 1]), NEVER)
            if i:
                ranks[i - 1] = rank((ids[i - 1], new), NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list."""
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(hit[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (hit := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a, b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (hit := pairs.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (hit[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (hit := pairs.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (hit[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def stream(self, chunks: Iterator[bytes]) -> Iterator[int]:
        """Ids of one pretoken that comes in chunks of bytes; holds a few lookaheads of it at most."""
        window, held, ended = 4 * self.lookahead + LONG, b"", False
        while not ended:
            while len(held) <= window:
                more = next(chunks, None)
                if more is None:
                    ended = True
                    break
                held += more
            ids = self.merge_long([self.byte_id[b] for b in held])
            stable, at = len(held) if ended else len(held) - self.lookahead - 1, 0
            for i in ids:
                size = len(self.bytes_of[i])
                if at + size > stable:
                    break
                yield i
                at += size
            held = held[at:]

    def word(self, text: str) -> tuple[int, ...]:
        raw = text.encode()
        if len(raw) <= LONG:
            return tuple(self.merge_short([self.byte_id[b] for b in raw]))
        if len(raw) <= 4 * self.lookahead:
            return tuple(self.merge_long([self.byte_id[b] for b in raw]))
        step = self.lookahead
        return tuple(self.stream(raw[i : i + step] for i in range(0, len(raw), step)))

    def blocks(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, block after block.  What follows a block can change its last three pretokens only."""
        wide = len(text.encode("utf-16-le")) > 2 * len(text)
        pattern, cache = pretokens(sys.maxunicode if wide else 0xFFFF), self.cache
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                yield [self.special[part]]
                continue
            at = 0
            while at < len(part):
                found = pattern.findall(part, at, at + BLOCK)
                if at + BLOCK < len(part):
                    if len(found) <= 3:  # a pretoken longer than a block may begin here: read this one by the stream
                        end = pattern.match(part, at).end()
                        yield from self.streamed(part, at, end)
                        at = end
                        continue
                    del found[-3:]
                yield list(chain.from_iterable(map(cache.__getitem__, found)))
                at += sum(map(len, found))

    def streamed(self, text: str, start: int, end: int) -> Iterator[list[int]]:
        """Ids of the pretoken text[start:end], block after block as they become stable; no copy of it is made."""
        step = self.lookahead
        ids = self.stream(text[i : min(i + step, end)].encode() for i in range(start, end, step))
        while block := list(islice(ids, BLOCK)):
            yield block

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.blocks(text or "")))

    def decoder(self):
        """f(ids, last) -> text, keeping bytes of an unfinished character for the next call."""
        machine, table = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of.__getitem__
        return lambda ids, last=False: machine.decode(b"".join(map(table, ids)), last)

    def decode(self, ids: Sequence[int]) -> str:
        return self.decoder()(ids, True)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids joined by commas, sha256 of the decoded text), in one pass."""
        n, ids_hash, text_hash, decode, said = 0, sha256(), sha256(), self.decoder(), self.said.__getitem__
        for ids in self.blocks(text or ""):
            if ids:
                ids_hash.update(("," * (n > 0) + ",".join(map(said, ids))).encode())
                text_hash.update(decode(ids).encode())
                n += len(ids)
        text_hash.update(decode([], True).encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


class Cache(dict):
    """Ids of pretokens seen lately: two generations of at most CACHE entries."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.word, self.old = bpe.word, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.old.get(text)
        if ids is None:
            ids = self.word(text)
        if len(text) <= LONG:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


@lru_cache(4)
def load(path: str) -> Bpe:
    return Bpe(path)


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def encode_digests(docs: DataFrame, path: str, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """carry columns plus n_tokens, ids_sha256, decoded_sha256."""

    def factory():
        bpe = load(path)

        def f(texts):
            got = [bpe.digest(t) for t in texts]
            return None, [[g[k] for g in got] for k in range(3)]

        f.close = bpe.cache.forget
        return f

    return annotate(docs, text, DIGESTS, factory, carry)


def encode_ids(docs: DataFrame, path: str, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """carry columns plus ids."""
    return annotate(docs, text, [IDS], lambda: lambda ts: (None, [[load(path).encode(t) for t in ts]]), carry)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """carry columns plus decoded, the text of the ids (null ids: an empty text)."""
    return annotate(encoded, ids, [T.StructField("decoded", T.StringType())], lambda: lambda xs: (None, [[load(path).decode(x or []) for x in xs]]), carry)
