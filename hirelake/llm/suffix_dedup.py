"""Removal of repeated byte strings with longest-previous-factor arrays over a sampled set of suffixes.

A byte goes if a string of `length` bytes that covers it also starts earlier in the corpus. All starts of such strings
(windows) cannot be sorted together, so each window is filed under its anchor: the least hash among its `gram`-byte
strings, the leftmost of equals. Anchors depend on the window's bytes alone, so equal windows have equal anchors. The
windows of a document that share an anchor are a run, and the bytes that they cover are its segment. Then

1. segments that are equal meet under the hashes of anchor and segment; all but the earliest are repeats as a whole.
   How many different ones an anchor has is counted where they meet and summed by anchor, so no task holds them all;
2. the suffixes of segments under anchors that still have several different ones are sorted in tasks, by ranks of 8 bytes
   doubled up to `length`. With the common prefixes of neighbours in that order, the previous and the next smaller
   positions give the longest previous factor of each suffix; where it has `length` bytes, they are repeats;
3. documents meet the ranges found and drop their bytes.

Documents travel in compressed blocks of about BLOCK_BYTES and answers go back by block. Before anything is sent, a
block keeps the earliest of its equal segments only, so a passage that is everywhere comes once from each block. Where
segments go window by window, it keeps the earliest of its equal windows in the same way, and windows are equal if 128 bits
of their hashes are. What comes about one passage from all blocks, 44 bytes from each, streams by: a task holds the
earliest record of each kind so far and answers the others as they come. Only anchors with several segments, of which
there are MOST_SEGMENTS at most, have their suffixes sorted, so no task gathers a record of each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm._common import read

LENGTH = 100
#: Bytes of the strings among which anchors are chosen.
GRAM = 32
#: Bytes of text in a block, and bytes hashed at a time.
BLOCK_BYTES, CHUNK = 8 << 20, 1 << 18
#: Partitions that blocks are dealt to; of more blocks, a partition holds several, which are taken one by one.
MOST_PARTITIONS = 20_000
#: Segments under one anchor of more than this many are sent window by window, filed under the window's own hash.
MOST_SEGMENTS = 20_000
#: Records that are gathered before they are compared with what is held.
FOLD = 1 << 20

#: Flags of answers: a segment is a repeat; its suffixes are to be sorted; the same, window by window.
REPEAT, SORT, SPLIT = 1, 2, 3
NO_ID = np.iinfo(np.int64).max
#: An anchor with a count of kinds of segments, or with the flag that they lead to.
KINDS = np.dtype([("anchor", "<u8"), ("value", "<i8")])
RECORD = np.dtype([("anchor", "<u8"), ("segment", "<u8"), ("doc_id", "<i8"), ("digest", "<i8"), ("doc", "<i4"), ("low", "<i4"), ("high", "<i4")])


# --- segments of a block -------------------------------------------------------------------------------------------


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and their inverses."""
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> dict[str, np.ndarray]:
    """Runs of windows in the bytes of several documents, one after another: starts has the first byte of each and the
    end of all. Returns anchor and segment (hashes), low and high (the first and last window's start)."""
    found = []
    last_start = np.repeat(starts[1:], np.diff(starts)) - length  # of each byte, the last window of its document
    for at in range(0, max(0, len(data) - length + 1), chunk):
        part = data[at : at + chunk + length - 1]
        n = len(part)
        up, down = _powers(chunk + length)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashes = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        key = hashes >> np.uint64(20) << np.uint64(20) | np.arange(len(hashes), dtype=np.uint64)
        width, step = length - gram + 1, 1
        while 2 * step <= width:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if width > step:
            key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
        anchors = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
        windows = np.arange(at, at + len(anchors))
        valid = windows <= last_start[at : at + len(anchors)]
        new = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (valid[1:] != valid[:-1])]))
        end = np.append(new[1:], len(anchors)) - 1
        new, end = new[valid[new]], end[valid[new]]
        place = anchors[new]
        whole = (sums[end + length] - sums[new]) * down[new] + ((end - new) << 20 | (place - new)).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        found.append((hashes[place], _mix(whole), new + at, end + at))
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 2
    return dict(zip(("anchor", "segment", "low", "high"), columns, strict=True))


class Block:
    """The documents of a block in their order, and their segments."""

    def __init__(self, blobs: list[bytes]):
        docs = sorted((doc for blob in blobs for doc in unpack(blob)), key=lambda d: (d[1], d[2]))
        self.has_id = [d[0] for d in docs]
        self.ids, self.digests = (np.array([d[k] for d in docs], np.int64) for k in (1, 2))
        self.texts = [d[3] for d in docs]
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def records(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """A record for each segment in order, and whether it is the first of its kind here."""
        found = segments(self.data, self.starts, length, gram)
        out = np.empty(len(found["low"]), RECORD)
        out["doc"] = np.searchsorted(self.starts, found["low"], "right") - 1
        for name in ("anchor", "segment"):
            out[name] = found[name]
        for name in ("low", "high"):
            out[name] = found[name] - self.starts[out["doc"]]
        out["doc_id"], out["digest"] = self.ids[out["doc"]], self.digests[out["doc"]]
        order = np.lexsort((out["segment"], out["anchor"]))  # keeps the order of equals
        a, s = out["anchor"][order], out["segment"][order]
        first = np.zeros(len(out), bool)
        first[order] = np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])]) if len(out) else []
        return out, first


def pack(docs: list[tuple]) -> bytes:
    """docs: whether it has an id, id, digest, bytes."""
    head = np.array([(d[0], d[1], d[2], len(d[3])) for d in docs], np.int64)
    raw = len(docs).to_bytes(8, "little") + head.tobytes() + b"".join(d[3] for d in docs)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(blob: bytes) -> Iterator[tuple]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    at = 8 + 32 * n
    for has_id, doc_id, digest, size in np.frombuffer(raw, np.int64, 4 * n, 8).reshape(n, 4).tolist():
        yield bool(has_id), doc_id, digest, raw[at : at + size]
        at += size


def _rows(names: list[str], rows: list[tuple]) -> pa.Table:
    types = {"kind": pa.int32(), "home": pa.int32(), "bucket": pa.int32(), "block": pa.int32(), "blob": pa.binary()}
    return pa.table({n: pa.array([r[k] for r in rows], types[n]) for k, n in enumerate(names)})


def _split(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Values by key, in order within a key."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for part, key in zip(np.split(values, cuts), keys[np.concatenate([[0], cuts])].tolist() if len(keys) else [], strict=False):
        yield key, part


# --- the three steps -------------------------------------------------------------------------------------------------


def bucket_of(records: np.ndarray, buckets: int) -> np.ndarray:
    """Where a segment meets its equals: by anchor and segment, so an anchor's segments are dealt out."""
    return (_mix(records["anchor"] + records["segment"] * np.uint64(0xA24BAED4963EE407)) % np.uint64(buckets)).astype(np.int64)


class Earliest:
    """The earliest of records that are alike in anchor and segment, found while records stream by. It holds the different
    ones and at most as many again (or FOLD), however often each comes."""

    def __init__(self):
        self.blocks, self.records = np.empty(0, np.int32), np.empty(0, RECORD)
        self.waiting: list[tuple[int, np.ndarray]] = []
        self.size = 0

    def add(self, block: int, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes records of a block. Returns blocks and records of those that by now are known to have an earlier equal."""
        self.waiting.append((block, records))
        self.size += len(records)
        return self.fold() if self.size >= max(FOLD, len(self.records)) else (self.blocks[:0], self.records[:0])

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        """The same for all that is waiting; the earliest of what came are in blocks and records then."""
        records = np.concatenate([self.records, *(r for _, r in self.waiting)])
        blocks = np.concatenate([self.blocks, *(np.full(len(r), k, np.int32) for k, r in self.waiting)])
        self.waiting, self.size = [], 0
        # Only what shares its hashes is sorted any further.
        both = records["anchor"] + records["segment"] * np.uint64(0xA24BAED4963EE407)
        order = np.argsort(both)
        same = both[order][1:] == both[order][:-1]
        if not same.any():
            self.blocks, self.records = blocks, records
            return blocks[:0], records[:0]
        order = np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])])
        few = records[order]
        order = order[np.lexsort((few["low"], few["doc"], few["digest"], few["doc_id"], few["segment"], few["anchor"]))]
        anchor, segment = records["anchor"][order], records["segment"][order]
        later = order[1:][(segment[1:] == segment[:-1]) & (anchor[1:] == anchor[:-1])]
        stay = np.ones(len(records), bool)
        stay[later] = False
        self.blocks, self.records = blocks[stay], records[stay]
        return blocks[later], records[later]


class Kinds:
    """The different segments of a bucket, counted by anchor while records stream by, in bounded room like Earliest."""

    def __init__(self):
        self.pairs = np.empty((0, 2), np.uint64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, records: np.ndarray) -> None:
        self.waiting.append(np.stack([records["anchor"], records["segment"]], axis=1))
        self.size += len(records)
        if self.size >= max(FOLD, len(self.pairs)):
            self.fold()

    def fold(self) -> None:
        pairs = np.concatenate([self.pairs, *self.waiting])
        self.waiting, self.size = [], 0
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
        self.pairs = pairs[new]

    def counts(self) -> np.ndarray:
        """The anchors, each with its number of different segments."""
        self.fold()
        anchors, counts = np.unique(self.pairs[:, 0], return_counts=True)
        out = np.empty(len(anchors), KINDS)
        out["anchor"], out["value"] = anchors, counts
        return out


def sum_kinds(blobs: list[tuple[int, bytes]], most: int) -> list[tuple[int, bytes]]:
    """By bucket that has them, the anchors with several different segments in all, each with a flag."""
    parts = [np.frombuffer(b, KINDS) for _, b in blobs]
    told = np.concatenate(parts)
    buckets = np.repeat(np.array([k for k, _ in blobs]), [len(p) for p in parts])
    anchors, inverse = np.unique(told["anchor"], return_inverse=True)
    total = np.bincount(inverse, weights=told["value"], minlength=len(anchors))[inverse]
    told["value"] = np.where(total > most, SPLIT, SORT)
    keep = total > 1
    return [(k, part.tobytes()) for k, part in _split(buckets[keep], told[keep])]


def told_flags(records: np.ndarray, told: list[bytes]) -> np.ndarray:
    """The flags of records by their anchors. told has the anchors with several different segments and their flags."""
    several = np.sort(np.concatenate([np.empty(0, KINDS), *(np.frombuffer(b, KINDS) for b in told)]), order="anchor")
    if not len(several):
        return np.zeros(len(records), np.int64)
    at = np.minimum(np.searchsorted(several["anchor"], records["anchor"]), len(several) - 1)
    return np.where(several["anchor"][at] == records["anchor"], several["value"][at], 0)


def answers_of(blocks: np.ndarray, records: np.ndarray, last: np.ndarray | int) -> list[tuple[int, bytes]]:
    """By block: document, first window and last, or a flag in its place."""
    answers = np.stack([records["doc"], records["low"], np.broadcast_to(last, len(records))], axis=1).astype(np.int32)
    return [(k, part.tobytes()) for k, part in _split(blocks, answers)] if len(records) else []


def answered(block: Block, answers: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's records and a flag for each."""
    records, first = block.records(length, gram)
    flags = np.where(first, 0, REPEAT)
    if answers:
        told = np.concatenate([np.frombuffer(a, np.int32).reshape(-1, 3) for a in answers])
        at = np.searchsorted(records["doc"].astype(np.int64) << 32 | records["low"], told[:, 0].astype(np.int64) << 32 | told[:, 1])
        flags[at] = told[:, 2]
    return records, flags


def split_windows(block: Block, records: np.ndarray, flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A record for each window of the segments that go window by window, filed under its own hash, and whether it is
    the first of its equals in the block."""
    split = records[flags == SPLIT]
    n = (split["high"] - split["low"] + 1).astype(np.int64)
    single = np.repeat(split, n)
    single["low"] += (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    single["high"] = single["low"]
    begin = block.starts[single["doc"]] + single["low"]
    digests = b"".join(hashlib.blake2b(block.data[b : b + length], digest_size=16).digest() for b in begin.tolist())
    hashes = np.frombuffer(digests, "<u8").reshape(-1, 2)
    single["anchor"], single["segment"] = hashes[:, 0], hashes[:, 1]
    order = np.lexsort((begin, hashes[:, 1], hashes[:, 0]))
    first = np.ones(len(single), bool)
    first[order[1:]] = (hashes[order[1:]] != hashes[order[:-1]]).any(axis=1)
    return single, first


def to_sort(block: Block, records: np.ndarray, flags: np.ndarray, buckets: int, length: int) -> list[tuple[int, bytes]]:
    """By bucket, the segments whose suffixes are to be sorted: records with their bytes behind."""
    out = []
    chosen = records[flags == SORT]
    for bucket, part in _split((chosen["anchor"] % np.uint64(buckets)).astype(np.int64), chosen):
        begin = block.starts[part["doc"]] + part["low"]
        sizes = (part["high"] - part["low"] + length).astype(np.int64)
        take = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out.append((bucket, len(part).to_bytes(8, "little") + part.tobytes() + block.data[take].tobytes()))
    return out


def suffix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes of data by their first 8 bytes, 16, and so on up to length: each with its size. Ranks are in
    the order of these bytes, and equal exactly if these are. The last step overlaps."""
    n = len(data) - 7
    ranks = np.zeros(n, np.uint64)
    for k in range(8):
        ranks |= data[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    size = 8
    levels = [(size, np.unique(ranks, return_inverse=True)[1].astype(np.int32))]
    while size < length:
        step = min(size, length - size)
        ranks = levels[-1][1].astype(np.int64)
        ranks = ranks[: len(ranks) - step] << 32 | ranks[step:]
        size += step
        levels.append((size, np.unique(ranks, return_inverse=True)[1].astype(np.int32)))
    return levels


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """How many bytes suffixes at a and b have in common, up to the size of the last level."""
    length, last = levels[-1]
    shared = np.zeros(len(a), np.int64)
    for size, ranks in levels[-2::-1]:
        at = np.flatnonzero(shared + size <= length)
        shared[at] += size * (ranks[a[at] + shared[at]] == ranks[b[at] + shared[at]])
    for _ in range(7):
        at = np.flatnonzero(shared < length)
        shared[at] += data[a[at] + shared[at]] == data[b[at] + shared[at]]
    return np.where(last[a] == last[b], length, shared)


def to_smaller(places: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For suffixes in their order, with their places in the text and what each shares with the one before (0 for the
    first): what each shares with the nearest one before that has a smaller place; 0 if none has. A suffix whose candidate
    has a greater place takes over the candidate of that one, all at once and again, so candidates move in doubling steps."""
    before, least = np.arange(-1, len(places) - 1), shared.copy()
    todo = np.flatnonzero((before >= 0) & (places[before] > places))
    while len(todo):
        at = before[todo]
        least[todo], before[todo] = np.minimum(least[todo], least[at]), before[at]
        at = before[todo]
        todo = todo[(at >= 0) & (places[at] > places[todo])]
    return np.where(before >= 0, least, 0)


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor, up to length, of each suffix of data that begins at starts: how many of its bytes also
    begin at a start with a smaller place. Suffixes have length bytes at least, and places differ.

    The greatest prefix shared with any earlier suffix is shared with the nearest smaller place on one of its sides in
    suffix order. Of suffixes alike in length bytes, only the earliest takes part in that search.
    """
    if not len(starts):
        return np.empty(0, np.int64)
    levels = suffix_ranks(data, length)
    rank = levels[-1][1][starts]
    order = np.lexsort((places, rank))
    first = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    heads = order[first]
    shared = np.concatenate([[0], common_prefixes(data, starts[heads[:-1]], starts[heads[1:]], levels)])
    left = to_smaller(places[heads], shared)
    right = to_smaller(places[heads][::-1], np.concatenate([[0], shared[:0:-1]]))[::-1]
    out = np.full(len(starts), length, np.int64)
    out[heads] = np.maximum(left, right)
    return out


def earlier_matches(blobs: list[tuple[int, bytes]], length: int) -> list[tuple[int, bytes]]:
    """Answers by block for the segments of one bucket: (document, first window, last window) of repeats."""
    if not blobs:
        return []
    parts, data = [], []
    for _, blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        parts.append(np.frombuffer(blob, RECORD, n, 8))
        data.append(np.frombuffer(blob, np.uint8, -1, 8 + n * RECORD.itemsize))
    records = np.concatenate(parts)
    blocks = np.repeat(np.array([k for k, _ in blobs]), [len(p) for p in parts])
    text = np.concatenate(data)
    sizes = (records["high"] - records["low"] + length).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    # Windows take their places from the order of their segments in the corpus.
    order = np.lexsort((records["low"], records["doc"], records["digest"], records["doc_id"]))
    n = sizes - length + 1
    base = np.empty(len(order), np.int64)
    base[order] = np.cumsum(n[order]) - n[order]
    owner = np.repeat(np.arange(len(records)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    # Suffixes under different anchors are different, for the windows that are here are filed under their anchors.
    at = np.flatnonzero(longest_previous_factors(text, begin[owner] + inside, base[owner] + inside, length) >= length)
    if not len(at):
        return []
    cut = np.concatenate([[True], (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])])
    first, last = at[cut], at[np.append(np.flatnonzero(cut)[1:], len(at)) - 1]
    who = owner[first]
    ranges = np.stack([records["doc"][who], records["low"][who] + inside[first], records["low"][who] + inside[last]], axis=1).astype(np.int32)
    return [(k, part.tobytes()) for k, part in _split(blocks[who], ranges)]


def own_ranges(records: np.ndarray, flags: np.ndarray, single: np.ndarray, first: np.ndarray) -> bytes:
    """Ranges (document, first window, last window) of the block's segments and single windows that are repeats."""
    gone = np.concatenate([records[flags == REPEAT], single[~first]])
    gone = gone[np.lexsort((gone["low"], gone["doc"]))]
    new = np.ones(len(gone), bool)
    new[1:] = (gone["doc"][1:] != gone["doc"][:-1]) | (gone["low"][1:] != gone["high"][:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(gone)) - 1 if len(gone) else first
    return np.stack([gone["doc"][first], gone["low"][first], gone["high"][last]], axis=1).astype(np.int32).tobytes()


def cleaned(block: Block, ranges: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """For each document: bytes removed, maximal runs removed, and the bytes left."""
    told = np.concatenate([np.empty((0, 3), np.int32), *(np.frombuffer(r, np.int32).reshape(-1, 3) for r in ranges)])
    depth = np.zeros(len(block.data) + 1, np.int32)
    base = block.starts[told[:, 0]]
    np.add.at(depth, base + told[:, 1], 1)
    np.add.at(depth, base + told[:, 2] + length, -1)
    removed = np.cumsum(depth[:-1]) > 0
    touched = set(np.unique(told[:, 0]).tolist())
    for k, text in enumerate(block.texts):
        if k not in touched:
            yield 0, 0, text
            continue
        mask = removed[block.starts[k] : block.starts[k + 1]]
        yield int(mask.sum()), int(mask[0]) + int((mask[1:] > mask[:-1]).sum()), block.data[block.starts[k] : block.starts[k + 1]][~mask].tobytes()


def dedup_suffixes(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, most: int = MOST_SEGMENTS) -> DataFrame:
    """Removes every byte of text that a string of length bytes covers which also starts earlier: in a document with a
    smaller doc_id, or earlier in the same. Strings lie within a text and are judged on the input.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: what is left, maybe no valid
    UTF-8), a row for each row of documents. A null or empty text has no bytes. A null doc_id comes after all others; of
    equal ids the text with the smaller digest comes first, and of rows alike in both any one. No rows give none. Other
    columns are ignored. length must be 16 at least, and a document shorter than 2 GiB.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).withColumn("digest", F.xxhash64("doc_id", "text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush():
            table = pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(map(pack, held.values()), pa.binary())], names=["block", "blob"])
            held.clear()
            return table

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text, digest in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    held.setdefault(digest % blocks, []).append((doc_id is not None, NO_ID if doc_id is None else doc_id, digest, text))
                    size += len(text)
                if size > 4 * block_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    # Partitions follow the data, whatever the session's number for shuffles is.
    parts = min(blocks, MOST_PARTITIONS)
    packed = rows.mapInArrow(pack_blocks, "block int, blob binary").repartition(parts, "block")

    def blobs(table: pa.Table) -> list[bytes]:
        return table["blob"].to_pylist()

    def block_of(table: pa.Table) -> int:
        return table["block"][0].as_py()

    def pairs(table: pa.Table | pa.RecordBatch) -> list[tuple[int, bytes]]:
        return list(zip(table["block"].to_pylist(), table["blob"].to_pylist(), strict=True))

    def send_segments(table: pa.Table) -> pa.Table:
        records, first = Block(blobs(table)).records(length, gram)
        records = records[first]
        return _rows(["bucket", "block", "blob"], [(bucket, block_of(table), part.tobytes()) for bucket, part in _split(bucket_of(records, blocks), records)])

    def send_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, bucket = Kinds(), 0
        for batch in batches:
            bucket = batch["bucket"][0].as_py()
            for _, blob in pairs(batch):
                kinds.add(np.frombuffer(blob, RECORD))
        counts = kinds.counts()
        homes = (counts["anchor"] % np.uint64(blocks)).astype(np.int64)
        yield from _rows(["home", "bucket", "blob"], [(home, bucket, part.tobytes()) for home, part in _split(homes, counts)]).to_batches()

    def add_kinds(table: pa.Table) -> pa.Table:
        told = sum_kinds(list(zip(table["bucket"].to_pylist(), blobs(table), strict=True)), most)
        return _rows(["bucket", "block", "blob"], [(bucket, None, blob) for bucket, blob in told])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows without a block say which anchors have several different segments.
        earliest, told = Earliest(), []
        for batch in batches:
            for number, blob in pairs(batch):
                if number is None:
                    told.append(blob)
                else:
                    yield from send(answers_of(*earliest.add(number, np.frombuffer(blob, RECORD)), REPEAT))
        yield from send(answers_of(*earliest.fold(), REPEAT))
        flags = told_flags(earliest.records, told)
        yield from send(answers_of(earliest.blocks[flags > 0], earliest.records[flags > 0], flags[flags > 0]))

    def send(answers: list[tuple[int, bytes]]) -> list[pa.RecordBatch]:
        return _rows(["block", "blob"], answers).to_batches() if answers else []

    def send_suffixes(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(["kind", "bucket", "block", "blob"], [])
        number, block = block_of(left), Block(blobs(left))
        records, flags = answered(block, blobs(right), length, gram)
        single, first = split_windows(block, records, flags, length)
        sent = [(SORT, bucket, number, blob) for bucket, blob in to_sort(block, records, flags, blocks, length)]
        sent += [(SPLIT, bucket, number, part.tobytes()) for bucket, part in _split(bucket_of(single[first], blocks), single[first])]
        # What the block knows by itself goes along, so that it needn't be found again in the end.
        return _rows(["kind", "bucket", "block", "blob"], [*sent, (REPEAT, number, number, own_ranges(records, flags, single, first))])

    def sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earliest, suffixes = Earliest(), []
        for batch in batches:
            for kind, number, blob in zip(batch["kind"].to_pylist(), batch["block"].to_pylist(), batch["blob"].to_pylist(), strict=True):
                if kind == SORT:
                    suffixes.append((number, blob))
                elif kind == REPEAT:
                    yield from send([(number, blob)])
                else:
                    later, records = earliest.add(number, np.frombuffer(blob, RECORD))
                    yield from send(answers_of(later, records, records["high"]))
        later, records = earliest.fold()
        yield from send(answers_of(later, records, records["high"]) + earlier_matches(suffixes, length))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(blobs(left))
        out = list(cleaned(block, blobs(right), length))
        return pa.table({
            "doc_id": pa.array([i if has else None for i, has in zip(block.ids.tolist(), block.has_id, strict=True)], pa.int64()),
            "n_bytes": pa.array([len(t) for t in block.texts], pa.int64()),
            "n_removed": pa.array([x[0] for x in out], pa.int64()),
            "n_spans": pa.array([x[1] for x in out], pa.int64()),
            "kept": pa.array([x[2] for x in out], pa.binary()),
        })

    by_block, by_bucket = "block int, blob binary", "bucket int, block int, blob binary"
    sent = packed.groupBy("block").applyInArrow(send_segments, by_bucket).repartition(parts, "bucket")
    kinds = sent.groupBy("bucket").applyInArrow(send_kinds, "home int, bucket int, blob binary").repartition(parts, "home").groupBy("home").applyInArrow(add_kinds, by_bucket)
    first = sent.union(kinds.repartition(parts, "bucket")).groupBy("bucket").applyInArrow(match, by_block)
    second = packed.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(send_suffixes, f"kind int, {by_bucket}")
    answers = second.repartition(parts, "bucket").groupBy("bucket").applyInArrow(sort_suffixes, by_block)
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings of 100 that start earlier too."""
    return dedup_suffixes(read(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
