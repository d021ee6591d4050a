"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

An encoding is an element of a monoid: the ids of a text, and how many of them each pretoken has. Two neighbours can be
joined without encoding either again. Two facts make the join exact.

* Pretokens: the pattern has no lookbehind, and which match it finds depends on at most LOOKAHEAD characters behind the
  match: one for the end of a run, two where 'll might have matched. So a match that ends that far before the end of its
  text never changes when text is appended; and matching from a place where a match starts depends only on what follows.
  After joining, only the last matches on the left up to the first common match start on the right are found anew.
* Tokens: a sequence of tokens is the BPE encoding of its bytes exactly if each neighbouring pair, encoded alone, stays
  as it is. So after joining, a window of tokens about the seam is encoded anew and widened until the pairs at both of
  its ends are stable; tokens outside it cannot change.

Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hirelake.llm._common import map_rows, read

#: Characters of a leaf: texts and halves up to this length are matched in one go.
LEAF_CHARS = 16_384
#: Characters behind a match that decide on it.
LOOKAHEAD = 2
#: Bytes of a pretoken that is merged directly; longer ones are halved.
LEAF_BYTES = 24
#: Ids of a leaf of decoding.
LEAF_IDS = 8_192
#: Bytes, by estimate, of the encodings that a Python worker remembers in all.
CACHE_BYTES = 64 << 20
#: Texts of more characters are cut into blocks that different tasks encode.
BLOCK_CHARS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line has a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Remembered:
    """Two dictionaries, of which the younger takes up to half of most bytes, by estimate. When it is full it becomes the
    older one, whose entries go unless they have been asked for meanwhile."""

    def __init__(self, most: int):
        self.young: dict = {}
        self.old: dict = {}
        self.spent, self.most = 0, most // 2

    def again(self, key, size: int):
        """An entry of either, moved to the younger, or None."""
        if (value := self.young.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value, size)
        return value

    def put(self, key, value, size: int) -> None:
        if self.spent > self.most:
            self.old, self.young, self.spent = self.young, {}, 0
        self.young[key] = value
        self.spent += size

    def __len__(self) -> int:
        return len(self.young) + len(self.old)


class Codec:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES, leaf_ids: int = LEAF_IDS, cache_bytes: int = CACHE_BYTES):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.leaf_chars, self.leaf_bytes, self.leaf_ids = leaf_chars, leaf_bytes, leaf_ids
        # Encodings of pretokens, four bytes an id, and whether pairs of tokens are stable.
        self.known, self.pairs = Remembered(cache_bytes * 7 // 8), Remembered(cache_bytes // 8)

    # --- bytes of one pretoken -------------------------------------------------------------------------------------

    def merged(self, data: bytes) -> list[int]:
        """Lowest-ranked merges first, leftmost among equals."""
        return self.merged_short(data) if len(data) <= 64 else self.merged_long(data)

    def merged_short(self, data: bytes) -> list[int]:
        """With a list of the neighbours' ranks."""
        rank, none = self.ranks.get, len(self.ranks) + 1
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], none)
        return [self.ranks[part] for part in parts]

    def merged_long(self, data: bytes) -> list[int]:
        """With a heap over a linked list of parts."""
        n, ranks = len(data), self.ranks
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(ranks[data[i : i + 2]], i, i + 2) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, left, stop = heapq.heappop(heap)
            if not alive[left] or end[left] >= n or end[end[left]] != stop or not alive[end[left]]:
                continue
            right = end[left]
            alive[right], end[left] = False, stop
            if stop < n:
                before[stop] = left
                if (rank := ranks.get(data[left : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, left, end[stop]))
            if (first := before[left]) >= 0 and (rank := ranks.get(data[first:stop])) is not None:
                heapq.heappush(heap, (rank, first, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stable(self, left: int, right: int) -> bool:
        """True if these neighbours stay as they are when encoded alone."""
        pair = left, right
        if (known := self.pairs.again(pair, 200)) is None:
            known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            self.pairs.put(pair, known, 200)
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours: encodes a window about the seam, widened while one of its ends is unstable."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            window = self.merged(b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j])))
            ok_left = i >= len(left) or self.stable(left[-i - 1], window[0])
            ok_right = j >= len(right) or self.stable(window[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - min(i, len(left))] + window + right[j:]
            i, j = (i if ok_left else 2 * i), (j if ok_right else 2 * j)

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, text: str) -> bytes:
        """The ids of one pretoken, four bytes each; one that is a token as a whole is that token."""
        size = 180 + 2 * len(text)
        if (ids := self.known.again(text, size)) is None:
            data = text.encode()
            if data in self.ranks:
                ids = self.ranks[data].to_bytes(4, "little")
            else:
                ids = np.array(self.tree(data), "<u4").tobytes() if len(data) > 64 else b"".join([i.to_bytes(4, "little") for i in self.tree(data)])
            if len(text) <= 256:
                self.known.put(text, ids, size)
        return ids

    def pieces(self, text: str) -> list[bytes]:
        """The ids of each of the pattern's matches."""
        known, piece = self.known.young.get, self.piece
        return [known(match) or piece(match) for match in self.pattern.findall(text)]

    # --- elements: the ids of a text, and how many of them each of its pretokens has ----------------------------------

    def element(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Halves are encoded by themselves and joined at the seam."""
        if len(text) > self.leaf_chars:
            half = len(text) // 2
            return self.join_elements(self.element(text[:half]), self.element(text[half:]))
        return _element(self.pieces(text))

    def join_elements(self, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pretokens at the end of the left that aren't final are matched anew, until one starts where one on the right
        does; all others keep their ids."""
        (ids, sizes), (more_ids, more_sizes) = left, right
        if not len(sizes) or not len(more_sizes):
            return (more_ids, more_sizes) if not len(sizes) else left
        kept, cut, tail = len(sizes), len(ids), ""
        while kept and len(tail) < LOOKAHEAD:
            kept -= 1
            cut -= int(sizes[kept])
            tail = self.decode(ids[cut : cut + int(sizes[kept])]).decode() + tail
        wide = 2
        while True:
            # Characters and ids before each of the first pretokens on the right.
            starts, window, at = {}, [tail], 0
            place = len(tail)
            for size in more_sizes[:wide].tolist():
                starts[place] = at
                window.append(self.decode(more_ids[at : at + size]).decode())
                place += len(window[-1])
                at += size
            whole, fresh, stop = "".join(window), [], None
            for m in self.pattern.finditer(whole):
                if m.start() in starts:
                    stop = starts[m.start()]
                    break
                if m.end() + LOOKAHEAD > len(whole) and wide < len(more_sizes):
                    break
                fresh.append(self.piece(m[0]))
            else:
                stop = at
            if stop is not None:
                new_ids, new_sizes = _element(fresh)
                passed = int(np.searchsorted(np.cumsum(more_sizes[:wide]), stop, "right")) if stop else 0
                return np.concatenate([ids[:cut], new_ids, more_ids[stop:]]), np.concatenate([sizes[:kept], new_sizes, more_sizes[passed:]])
            wide *= 2

    def join_all(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours are joined in pairs, level by level."""
        while len(parts) > 1:
            parts = [self.join_elements(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def encode(self, text: str) -> np.ndarray:
        if len(text) > self.leaf_chars:
            return self.element(text)[0]
        return np.frombuffer(b"".join(self.pieces(text)), "<u4")

    def decode(self, ids: Sequence[int] | np.ndarray) -> bytes:
        if len(ids) > self.leaf_ids:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


def _element(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(pieces), "<u4"), np.array(list(map(len, pieces)), "<u4") // 4


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


#: What encode_documents can return of each row, besides doc_id.
OUTPUTS = {"ids": "binary", "decoded": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def outputs_of(c: Codec, ids: np.ndarray, wanted: tuple[str, ...]) -> tuple:
    raw = ids.tobytes()
    decoded = c.decode(ids) if {"decoded", "decoded_sha256"} & set(wanted) else b""
    make = {"ids": lambda: raw, "decoded": lambda: decoded, "n_tokens": lambda: len(ids), "ids_sha256": lambda: hashlib.sha256(raw).hexdigest(), "decoded_sha256": lambda: hashlib.sha256(decoded).hexdigest()}
    return tuple(make[name]() for name in wanted)


def encode_documents(documents: DataFrame, vocabulary: Callable[[], tuple[str, str]] = _vocabulary, block_chars: int = BLOCK_CHARS, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encodes the column text of documents, and decodes the ids.

    vocabulary is called in the tasks and gives the path of a vocabulary file, which is on every machine, and the
    pattern of pretokens. Returns a row for each row: doc_id and outputs, of ids binary (little-endian unsigned 32-bit
    integers), decoded binary (the ids decoded), n_tokens long, and the digests ids_sha256 and decoded_sha256 (lowercase
    hex), which are made in the tasks, so that what isn't asked for is never sent.

    A null or empty text has no ids. A null doc_id stays null. Repeated rows give repeated results, no rows give none.
    Other columns are ignored, whatever their names. A text of more than block_chars characters is cut into blocks,
    which tasks encode side by side; the blocks' ids are then joined in pairs, in a task that holds the ids of one text.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(["doc_id long", *(f"{name} {OUTPUTS[name]}" for name in outputs)])

    def whole():
        c = codec(*vocabulary())
        return lambda doc_id, text: ((doc_id, *outputs_of(c, c.encode(text), outputs)),)

    short = map_rows(rows.where(F.length("text") <= block_chars), schema, whole)
    blocks = (
        rows.where(F.length("text") > block_chars)
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / block_chars).cast("int"))).alias("block"))
        .select("row", "doc_id", "block", F.expr(f"substring(text, block * {block_chars} + 1, {block_chars})").alias("text"))
        .repartition("row", "block")
    )

    def encoded():
        c = codec(*vocabulary())

        def one(row, doc_id, block, text):
            ids, sizes = c.element(text)
            yield row, doc_id, block, ids.tobytes(), sizes.tobytes()

        return one

    def joined(table: pa.Table) -> pa.Table:
        c = codec(*vocabulary())
        parts = sorted(table.select(["block", "ids", "sizes"]).to_pylist(), key=lambda x: x["block"])
        ids, _ = c.join_all([(np.frombuffer(x["ids"], "<u4"), np.frombuffer(x["sizes"], "<u4")) for x in parts])
        values = (table["doc_id"][0].as_py(), *outputs_of(c, ids, outputs))
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, arrow.types, strict=True)], schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    long = map_rows(blocks, "row long, doc_id long, block int, ids binary, sizes binary", encoded).groupBy("row").applyInArrow(joined, schema)
    return short.unionByName(long)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the encoding of every text of documents, and of what it decodes to."""
    return encode_documents(read(spark, sf_dir, "documents"), outputs=DIGESTS)
