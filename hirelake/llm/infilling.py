"""Fill-in-the-middle: documents are cut in three at token boundaries and written in another order.

While the tokens of a text are counted, a sparse index notes the byte and the character that every STEP-th token begins
at. A cut is then found by binary search in the index and a scan of fewer than STEP tokens, so a text is gone through once
and a bit, whatever its length, and no list of its tokens is made.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm._common import map_rows, read

#: Tokens between two checkpoints.
STEP = 64
#: Percentages: documents that are rearranged, and those of them that begin with the suffix.
RATE, SPM_RATE = 50, 80
SEED = 42
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

# White space is ASCII, so bytes can be matched as well as characters. Repeats are possessive: nothing is tried twice.
_TOKEN = rb"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++)"
_ONE, _REST = re.compile(_TOKEN), re.compile(rb"[\x20\x09-\x0D]+")


def _characters(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode())


@dataclass(frozen=True)
class Checkpoints:
    """Of a text in UTF-8: every step-th token's number, first byte and first character, and the number of all tokens."""

    data: bytes
    numbers: list[int]
    starts: list[int]
    characters: list[int]
    n: int

    @classmethod
    def of(cls, data: bytes, step: int = STEP) -> Checkpoints:
        many = re.compile(_TOKEN + b"{%d}+" % step)
        numbers, starts, characters, at, n = [0], [0], [0], 0, 0
        while found := many.match(data, at):
            characters.append(characters[-1] + _characters(data[at : found.end()]))
            at, n = found.end(), n + step
            numbers.append(n)
            starts.append(at)
        while found := _ONE.match(data, at):
            at, n = found.end(), n + 1
        return cls(data, numbers, starts, characters, n + bool(_REST.match(data, at)))

    def cut(self, number: int) -> tuple[int, int]:
        """Bytes and characters before the token of a number; the number of all tokens gives the whole text."""
        near = bisect_right(self.numbers, number) - 1
        start = at = self.starts[near]
        for _ in range(number - self.numbers[near]):
            at = (_ONE.match(self.data, at) or _REST.match(self.data, at)).end()
        return at, self.characters[near] + _characters(self.data[start:at])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12)]


def rearranged(doc_id: int | None, data: bytes, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, step: int = STEP) -> tuple[int, str, int | None, int | None, list[bytes]]:
    """Number of tokens, form, characters of prefix and middle, and the pieces of the output of a text."""
    index = Checkpoints.of(data, step)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or h3 % 100 >= rate or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return index.n, "plain", None, None, [data]
    (first, before), (second, until) = (index.cut(c) for c in sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    spm = h4 % 100 < spm_rate
    pieces = [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle] if spm else [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]
    return index.n, "spm" if spm else "psm", before, until - before, pieces


def restored(output: bytes, form: str) -> list[bytes]:
    """The pieces of the text that an output was made from. Texts with a marker in them are plain, so a marker is found where
    it was written: it can't begin in a piece and end in a marker, nor the other way round."""
    if form == "plain":
        return [output]
    second, third = output.index(SUFFIX if form == "psm" else PREFIX, 3), output.index(MIDDLE, 3)
    one, two, middle = output[3:second], output[second + 3 : third], output[third + 3 :]
    return [one, middle, two] if form == "psm" else [two, middle, one]


def _digest(pieces: list[bytes]) -> str:
    made = hashlib.sha256()
    for piece in pieces:
        made.update(piece)
    return made.hexdigest()


#: What fill_in_middle can return of each row, besides doc_id.
OUTPUTS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string", "restored": "string", "output_sha256": "string", "restored_sha256": "string"}
DIGESTS = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def fill_in_middle(documents: DataFrame, outputs: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output"), rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, step: int = STEP) -> DataFrame:
    """Rearranges about rate percent of the texts of documents, spm_rate percent of these with the suffix first.

    A token is a word with the white space before it, or white space at the end. Cuts, choice and form follow from seed
    and doc_id alone. Returns a row for each row: doc_id and outputs, of n (tokens), form (plain, psm or spm),
    prefix_chars and middle_chars (null if plain), output, restored (rebuilt from output and form), and the digests of
    both. A null text counts as empty, and empty texts, as well as texts with a marker in them, are plain. A null doc_id
    stays null and draws as an empty number does. Repeated rows give repeated results, no rows give none. Other columns
    are ignored, whatever their names. A very long text is one row's work, in time and memory in proportion to it.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    schema = ", ".join(["doc_id long", *(f"{name} {OUTPUTS[name]}" for name in outputs)])

    def start():
        def one(doc_id, data):
            n, form, prefix_chars, middle_chars, pieces = rearranged(doc_id, data, rate, spm_rate, seed, step)
            rebuilt = restored(b"".join(pieces), form) if {"restored", "restored_sha256"} & set(outputs) else []
            make = {
                "n": lambda: n, "form": lambda: form, "prefix_chars": lambda: prefix_chars, "middle_chars": lambda: middle_chars,
                "output": lambda: b"".join(pieces).decode(), "restored": lambda: b"".join(rebuilt).decode(),
                "output_sha256": lambda: _digest(pieces), "restored_sha256": lambda: _digest(rebuilt),
            }
            return ((doc_id, *(make[name]() for name in outputs)),)

        return one

    return map_rows(rows, schema, start)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged or plain, and what it is rebuilt to."""
    return fill_in_middle(read(spark, sf_dir, "documents"), DIGESTS)


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
tokens AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS r FROM d),
chosen AS (SELECT *, len(w) AS n, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS a, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM tokens),
cut AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM chosen)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM cut
"""
