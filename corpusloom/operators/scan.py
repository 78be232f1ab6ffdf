"""Vectorised scans of sequences: bases become small numbers, words packed integers, and a batch is read in a few array passes.

Every scan reads a sequence in pieces of `PIECE` bases that overlap by a window less one, so memory does not follow the
longest sequence and every window start belongs to one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grammar import Grammar, complement_pattern
from ..functions.sequences import ADMITS

PIECE = 1 << 20
MOST_WORDS = 2_000_000
_CODE = np.full(256, 4, np.uint8)
_CODE[[*b"ACGT"]] = range(4)
_TURN = np.arange(256, dtype=np.uint8)
_TURN[[*b"ACGT"]] = [*b"TGCA"]
SPREAD = np.int64(0x9E3779B97F4A7C15 - (1 << 64))
_ODD = np.int64(0x5555555555555555)


def as_bytes(seq: str | None) -> np.ndarray:
    return np.frombuffer((seq or "").encode("ascii", "replace"), np.uint8)


def pieces(raw: np.ndarray, window: int, size: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, piece): pieces of `size` window starts."""
    for at in range(0, max(0, len(raw) - window + 1), size):
        yield at, raw[at : at + size + window - 1]


def concrete(code: np.ndarray, k: int) -> np.ndarray:
    """For each window of k, whether it has A, C, G and T only."""
    doubts = np.concatenate(([0], np.cumsum(code == 4, dtype=np.int32)))
    return doubts[k:] == doubts[:-k]


def packed(code: np.ndarray, k: int) -> np.ndarray:
    """For each window of k (up to 31), its bases as a number of 2 k bits; doubled widths make that a few passes."""
    part, width = (code & 3).astype(np.int64), 1
    out, have = None, 0
    while True:
        if k & width:
            out = part if out is None else out[: len(part) - have] << 2 * width | part[have:]
            have += width
        if 2 * width > k:
            return out[: len(code) - k + 1]
        part = part[:-width] << 2 * width | part[width:]
        width *= 2


def turned_words(code: np.ndarray, k: int) -> np.ndarray:
    """packed() of the reverse complement of each window."""
    return packed(np.where(code < 4, 3 - code, 4)[::-1], k)[::-1]


def fits(code: np.ndarray, pattern: str) -> np.ndarray:
    """For each window, whether it is concrete and admitted by the IUPAC pattern."""
    k = len(pattern)
    ok = concrete(code, k)
    for j, c in enumerate(pattern.upper()):
        admitted = np.array([b in ADMITS[c] for b in "ACGT"] + [False])
        if not admitted[:4].all():
            ok &= admitted[code[j : j + len(ok)]]
    return ok


def strings(raw: np.ndarray, at: np.ndarray, k: int, turn: bool = False) -> pa.Array:
    """The windows of k bytes at the given starts, or their reverse complements."""
    cells = raw[at[:, None] + np.arange(k)]
    if turn:
        cells = _TURN[cells[:, ::-1]]
    offsets = np.arange(len(at) + 1, dtype=np.int32) * np.int32(k)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(cells)))


def _strands(grammar: Grammar) -> list[tuple[str, str]]:
    free = "N" * grammar.spacer
    return [("+", free + grammar.pam), ("-", complement_pattern(grammar.pam) + free)]


def sites(df: DataFrame, seq: str, grammar: Grammar, piece: int = PIECE) -> DataFrame:
    """All sites of df's sequences: df's other columns, start0, strand, target (5' to 3' on its own strand).

    Both strands are scanned for themselves; a window that matches on both gives two rows.  A null sequence has none.
    """
    keep = [c for c in df.columns if c != seq]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("start0", T.IntegerType()), T.StructField("strand", T.StringType()), T.StructField("target", T.StringType())])
    n, patterns = grammar.length, _strands(grammar)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(schema).names
        for b in batches:
            for row, text in enumerate(b.column(len(keep)).to_pylist()):
                for offset, raw in pieces(as_bytes(text), n, piece):
                    code = _CODE[raw]
                    for strand, pattern in patterns:
                        at = np.flatnonzero(fits(code, pattern))
                        if len(at):
                            same = pa.array(np.full(len(at), row, np.int64))
                            yield pa.RecordBatch.from_arrays([*[b.column(i).take(same) for i in range(len(keep))], pa.array((at + offset).astype(np.int32)), pa.array([strand]).take(pa.array(np.zeros(len(at), np.int64))), strings(raw, at, n, strand == "-")], names=names)

    return df.select(*keep, seq).mapInArrow(run, schema)


class Words:
    """A dictionary of words of one length, found by a bitmap of their hashes and then by binary search."""

    BITS = 22

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        order = np.argsort(words, kind="stable")
        self.words, self.owner = words[order], owner[order]
        self.marked = np.zeros(1 << self.BITS, bool)
        self.marked[self.place(self.words)] = True

    def place(self, words: np.ndarray) -> np.ndarray:
        return (words * SPREAD).view(np.uint64) >> np.uint64(64 - self.BITS)

    def owners(self, words: np.ndarray) -> np.ndarray:
        """The owners of all given words, each once."""
        words = np.unique(words[self.marked[self.place(words)]])
        low, high = np.searchsorted(self.words, words, "left"), np.searchsorted(self.words, words, "right")
        times = high - low
        return np.unique(self.owner[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)])


def held_words(records: DataFrame, names: list[str], targets: list[str]) -> DataFrame:
    """(seq_id, guide_id): which records hold which targets (concrete, of one length up to 31), on either strand; each pair once for each row of records."""
    k = len(targets[0])
    code = [_CODE[as_bytes(t)] for t in targets]
    both = np.concatenate([np.array([packed(c, k)[0] for c in code]), np.array([turned_words(c, k)[0] for c in code])])
    book = Words(both, np.tile(np.arange(len(targets)), 2))
    known = pa.array(names, pa.string())

    def run(batches):
        for b in batches:
            rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for row, text in enumerate(b.column(1)):  # one text at a time
                got = [book.owners(packed(code, k)[concrete(code, k)]) for code in (_CODE[raw] for _, raw in pieces(as_bytes(text.as_py()), k))]
                if got:
                    own = np.unique(np.concatenate(got))
                    found.append(own)
                    rows.append(np.full(len(own), row, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), known.take(pa.array(np.concatenate(found)))], names=["seq_id", "guide_id"])

    schema = T.StructType([records.schema["seq_id"], T.StructField("guide_id", T.StringType())])
    return records.select("seq_id", "seq").mapInArrow(run, schema)


HEAD = 16


def held_strings(records: DataFrame, names: list[str], strands: list[tuple[str, str]]) -> DataFrame:
    """(seq_id, guide_id): which records hold which strings, in either of the two spellings of each, whatever signs they have.

    Nothing is packed and no window is left out: every place of a record is asked for the first bytes of a string, and where
    they may stand the string is compared as a whole.  Strings of fewer bytes are looked for one by one.
    """
    book = [(i, t.encode()) for i, both in enumerate(strands) for t in dict.fromkeys(both)]
    short, heads = [(i, t) for i, t in book if len(t) < HEAD], {}
    for i, t in book:
        if len(t) >= HEAD:
            heads.setdefault(t[:HEAD], []).append((i, t))
    known = pa.array(names, pa.string())
    marked = np.zeros(1 << 22, bool)

    def places(raw: np.ndarray) -> np.ndarray:
        two = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view(np.uint64).ravel()
        return (two[:-8] * np.uint64(0x9E3779B97F4A7C15) + two[8:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(42)

    for head in heads:
        marked[places(np.frombuffer(head, np.uint8))] = True

    def run(batches):
        for b in batches:
            rows, found = [], []
            for row, text in enumerate(b.column(1).cast(pa.binary())):
                text = text.as_py()
                if text is None:
                    continue
                own = {i for i, t in short if t in text}
                for at, raw in pieces(np.frombuffer(text, np.uint8), HEAD):
                    for start in (np.flatnonzero(marked[places(raw)]) + at).tolist() if heads else ():
                        own.update(i for i, t in heads.get(text[start : start + HEAD], ()) if text.startswith(t, start))
                rows += [row] * len(own)
                found += sorted(own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), known.take(pa.array(found, pa.int64()))], names=["seq_id", "guide_id"])

    schema = T.StructType([records.schema["seq_id"], T.StructField("guide_id", T.StringType())])
    return records.select("seq_id", "seq").mapInArrow(run, schema)


class Neighbours:
    """Packed words of k bases, found by parts of the layout (offset, size) that agree with a given word's."""

    def __init__(self, own: np.ndarray, k: int, layout: list[tuple[int, int]]):
        self.own, self.books = own, []
        for offset, size in layout:
            shift, mask = np.int64(2 * (k - offset - size)), np.int64((1 << 2 * size) - 1)
            keys = own >> shift & mask
            order = np.argsort(keys, kind="stable")
            self.books.append((shift, mask, keys[order], order))

    def close(self, words: np.ndarray, mismatches: int, doubts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of a given word, index of an own word, differing places as bits) of pairs within `mismatches`, by both indices.

        doubts: for each given word, its places that differ from any base, as bits."""
        out = []
        for i in range(0, len(words), 1 << 16):
            part = words[i : i + (1 << 16)]
            unsure = None if doubts is None else doubts[i : i + (1 << 16)]
            pairs = []
            for shift, mask, keys, order in self.books:
                key = part >> shift & mask
                a, z = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                times = z - a
                own = order[np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                word = np.repeat(np.arange(len(part)), times)
                close = np.bitwise_count(self._places(part, unsure, word, own)) <= mismatches
                pairs.append(word[close] * len(self.own) + own[close])
            pair = np.unique(np.concatenate(pairs))
            word, own = pair // len(self.own), pair % len(self.own)
            out.append((word + i, own, self._places(part, unsure, word, own)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _places(self, part, unsure, word, own):
        x = part[word] ^ self.own[own]
        x = (x | x >> 1) & _ODD
        return x if unsure is None else x | unsure[word]


def near_sites(records: DataFrame, grammar: Grammar, names: list[str], spacers: list[str], mismatches: int, layout: list[tuple[int, int]], seed: int = 12) -> DataFrame:
    """Sites of records whose spacer is within `mismatches` of a dictionary spacer: seq_id, start0, strand, target, guide_id,
    mismatches, seed_mismatches, mismatch_positions.

    Of more chunks than mismatches one agrees (pigeonhole): a site meets the spacers that share a chunk of the layout at its
    place, and the differing bases of two packed spacers are counted at once.
    """
    k, n = grammar.spacer, grammar.length
    book = Neighbours(np.array([packed(_CODE[as_bytes(s)], k)[0] for s in spacers], np.int64), k, layout)
    known = pa.array(names, pa.string())
    patterns = _strands(grammar)
    low = np.int64((1 << 2 * seed) - 1) if seed < k else np.int64(-1)

    def run(batches):
        fields = ["seq_id", "start0", "strand", "target", "guide_id", "mismatches", "seed_mismatches", "mismatch_positions"]
        for b in batches:
            for row, text in enumerate(b.column(1).to_pylist()):
                for offset, raw in pieces(as_bytes(text), n):
                    code = _CODE[raw]
                    for strand, pattern in patterns:
                        at = np.flatnonzero(fits(code, pattern))
                        if not len(at):
                            continue
                        words = packed(code, n)[at] >> 2 * (n - k) if strand == "+" else turned_words(code, n)[at] >> 2 * (n - k)
                        word, spacer, places = book.close(words, mismatches)
                        if not len(word):
                            continue
                        said = [",".join(str(j + 1) for j in range(k) if x >> 2 * (k - 1 - j) & 1) for x in places.tolist()]
                        starts = at[word]
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(np.full(len(word), row, np.int64))), pa.array((starts + offset).astype(np.int32)), pa.array([strand] * len(word)), strings(raw, starts, n, strand == "-"), known.take(pa.array(spacer)),
                             pa.array(np.bitwise_count(places).astype(np.int32)), pa.array(np.bitwise_count(places & low).astype(np.int32)), pa.array(said, pa.string())],
                            names=fields)

    kind = records.schema["seq_id"].dataType.simpleString()
    return records.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, start0 int, strand string, target string, guide_id string, mismatches int, seed_mismatches int, mismatch_positions string")


def one_off_windows(records: DataFrame, names: list[str], targets: list[str]) -> DataFrame:
    """(seq_id, guide_id, variant, place): the windows of records, on either strand, that differ from a target in exactly one place.

    No pattern is asked of a window.  Of the two halves of a target one is there unchanged, so a window meets the targets
    that share its left or its right half.  variant is written in the target's own direction and place counts from 1; a base
    other than A, C, G and T differs from each base.  A variant comes once for each
    piece of a sequence.  targets: concrete, of
    one length from 2 to 31; a null sequence has no window.
    """
    n = len(targets[0])
    half = n // 2
    code = [_CODE[as_bytes(t)] for t in targets]
    own = np.concatenate([np.array([packed(c, n)[0] for c in code], np.int64), np.array([turned_words(c, n)[0] for c in code], np.int64)])
    book = Neighbours(own, n, [(0, half), (half, n - half)])
    sides = [(shift, mask, Words(keys, order)) for shift, mask, keys, order in book.books]
    known = pa.array(names, pa.string())

    def run(batches):
        for b in batches:
            for row, text in enumerate(b.column(1).to_pylist()):
                for _, raw in pieces(as_bytes(text), n):
                    code = _CODE[raw]
                    words, doubts = packed(code, n), packed((code == 4).astype(np.uint8), n)
                    likely = np.zeros(len(words), bool)
                    for shift, mask, side in sides:
                        likely |= side.marked[side.place(words >> shift & mask)]
                    at = np.flatnonzero(likely & (np.bitwise_count(doubts) <= 1))
                    if not len(at):
                        continue
                    word, probe, places = book.close(words[at], 1, doubts[at])
                    found = set()
                    for start, t, x in zip(at[word].tolist(), probe.tolist(), places.tolist(), strict=True):
                        if x:
                            turn, place, window = t >= len(targets), n - (x.bit_length() - 1) // 2, raw[start : start + n]
                            found.add((t % len(targets), (_TURN[window[::-1]] if turn else window).tobytes().decode(), n + 1 - place if turn else place))
                    if found:
                        who, variant, place = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(np.full(len(found), row, np.int64))), known.take(pa.array(who, pa.int64())), pa.array(variant, pa.string()), pa.array(place, pa.int32())],
                            names=["seq_id", "guide_id", "variant", "place"])

    kind = records.schema["seq_id"].dataType.simpleString()
    return records.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, guide_id string, variant string, place int")


def canonical_words(code: np.ndarray, k: int) -> np.ndarray:
    """The lesser of each concrete k-mer and its reverse complement: the order of packed words is that of the strings."""
    return np.minimum(packed(code, k), turned_words(code, k))[concrete(code, k)]


#: The multipliers of a public 64-bit finaliser.
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def hashes60(words: np.ndarray) -> np.ndarray:
    """60 bits of each packed word (two bits a base), well mixed: shifts and products modulo 2^64, no loop over words."""
    h = words.astype(np.uint64)
    h ^= h >> np.uint64(33)
    for m in MIX:
        h *= np.uint64(m)
        h ^= h >> np.uint64(33)
    return (h >> np.uint64(4)).astype(np.int64)


def sketch_of(text: str | None, k: int, size: int) -> np.ndarray:
    """The `size` smallest distinct hashes of a sequence's canonical k-mers, sorted, one piece after the other."""
    least = np.empty(0, np.int64)
    for _, raw in pieces(as_bytes(text), k):
        h = np.sort(np.concatenate((least, hashes60(canonical_words(_CODE[raw], k)))))
        least = h[np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]][:size]
    return least


def sketches(records: DataFrame, k: int, size: int, most: int = 1 << 19) -> DataFrame:
    """(seq_id, sketch): the `size` smallest distinct hashes of each record's canonical k-mers, sorted; no row without one.

    Pieces are sketched one after the other, so a record of any length needs `size` hashes and a piece.  A batch goes out
    when it holds `most` hashes, so memory does not follow the number of records that come in one batch.
    """

    def run(batches):
        def told(b, rows, out):
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))], names=["seq_id", "sketch"])

        for b in batches:
            rows, out, held = [], [], 0
            for row, text in enumerate(b.column(1)):
                least = sketch_of(text.as_py(), k, size)
                if len(least):
                    rows.append(row)
                    out.append(least)
                    held += len(least)
                if held >= most:
                    yield told(b, rows, out)
                    rows, out, held = [], [], 0
            yield told(b, rows, out)

    kind = records.schema["seq_id"].dataType.simpleString()
    return records.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, sketch array<bigint>")


def kmer_totals(records: DataFrame, k: int, longest: int = 1 << 24) -> DataFrame:
    """(seq_id, n_kmers, n_canonical, least_hash) of each record with a k-mer.

    Distinct words of a record up to `longest` bases are counted where it is read; those of longer ones over the cluster.
    """
    kind = records.schema["seq_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for row, text in enumerate(b.column(1).to_pylist()):
                words = [canonical_words(_CODE[raw], k) for _, raw in pieces(as_bytes(text), k)]
                n = sum(map(len, words))
                if n:
                    different = np.unique(np.concatenate(words))
                    out.append((row, n, len(different), int(hashes60(different).min())))
            row, *cols = [list(c) for c in zip(*out, strict=True)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in cols]], names=["seq_id", "n_kmers", "n_canonical", "least_hash"])

    def spread(batches):
        for b in batches:
            for row, text in enumerate(b.column(1).to_pylist()):
                for _, raw in pieces(as_bytes(text), k):
                    words, times = np.unique(canonical_words(_CODE[raw], k), return_counts=True)
                    same = pa.array(np.full(len(words), row, np.int64))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(same), pa.array(hashes60(words)), pa.array(times)], names=["seq_id", "h", "n"])

    size = F.coalesce(F.length("seq"), F.lit(0))
    part = records.select("seq_id", "seq")
    short = part.where(size <= longest).mapInArrow(run, f"seq_id {kind}, n_kmers long, n_canonical long, least_hash long")
    words = part.where(size > longest).mapInArrow(spread, f"seq_id {kind}, h long, n long").groupBy("seq_id", "h").agg(F.sum("n").alias("n"))
    return short.unionByName(words.groupBy("seq_id").agg(F.sum("n").alias("n_kmers"), F.count(F.lit(1)).alias("n_canonical"), F.min("h").alias("least_hash")))
