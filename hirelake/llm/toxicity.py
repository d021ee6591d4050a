"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

Only documents have labels. A sentence's probability is a logistic model of its words, each of which counts by its own
hash and those of the n-grams of its bytes with a mark at both ends. A document's is the noisy-or of its sentences', and the likelihood of the
documents' labels is maximised through it, so weight gathers on the sentences that tell toxic documents from others.
The trained model then names the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm._common import crc32_of_id, map_rows, read, sample_by_id

#: Labelled rows of the sample (at most twice as many), and characters of the longest text in it.
SAMPLE_ROWS, SAMPLE_CHARS = 10_000, 50_000
BUCKETS, GRAM = 1 << 18, 5
EPOCHS, RATE, BATCH, DECAY = 12, 0.5, 64, 2e-5
#: A document is predicted to be toxic from this score on; sentences are named from the same.
THRESHOLD = 0.3
#: Characters of a text that are looked at together; longer ones are cut, where a sentence ends if one does.
PIECE = 1 << 18

_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])
#: ASCII letters stay, other ASCII becomes the mark between words; bytes beyond ASCII count as letters.
_MARKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Odd multipliers for the places in a word, of which the last counts for all beyond.
_PLACES = np.cumprod(np.full(64, 0x01000193, np.uint32), dtype=np.uint32)


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[int, str]]:
    """The text in parts with their offsets: cut behind the last end of a sentence, else at the last blank."""
    at = 0
    while len(text) - at > size:
        part = text[at : at + size]
        cut = max(map(part.rfind, ".!?\n")) + 1 or part.rfind(" ") + 1 or size
        yield at, part[:cut]
        at += cut
    yield at, text[at:]


def features(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Buckets of the words of a text and of their n-grams; of each the number of its sentence, sentences being what ends
    of sentences separate; and the bytes that were looked at, which are as many as the text's."""
    data = text.lower().encode()
    if len(data) != len(plain := text.encode()):
        data = plain.lower()  # a few letters change in length
    marked = np.frombuffer(b" " + data.translate(_MARKED) + b" ", np.uint8)
    sentence = np.zeros(len(marked), np.int32)
    sentence[2:] = np.cumsum(_ENDS[np.frombuffer(data, np.uint8)])
    codes, marks = marked.astype(np.uint32), marked == 32
    letters = np.flatnonzero(~marks)
    if not len(letters):
        return np.empty(0, np.int64), np.empty(0, np.int32), data
    first = np.flatnonzero(np.concatenate([[True], np.diff(letters) > 1]))
    sizes = np.diff(np.append(first, len(letters)))
    place = np.minimum(np.arange(len(letters)) - np.repeat(first, sizes), len(_PLACES) - 1)
    words = np.add.reduceat(codes[letters] * _PLACES[place], first, dtype=np.uint32) + sizes.astype(np.uint32)
    m = max(0, len(marked) - GRAM + 1)
    grams, inside = np.zeros(m, np.uint32), np.zeros(m, bool)
    for k in range(GRAM):
        grams = grams * np.uint32(0x01000193) + codes[k : k + m]
        if 0 < k < GRAM - 1:
            inside |= marks[k : k + m]
    good = np.flatnonzero(~inside)
    hashed = np.concatenate([words * np.uint32(0x9E3779B1), (grams[good] + np.uint32(7)) * np.uint32(0x85EBCA6B)])
    return (hashed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), np.concatenate([sentence[letters[first]], sentence[good + 1]]), data


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Logits of the sentences with a word, their numbers, and the bytes looked at."""
        ids, sentence, data = features(text)
        if not len(ids):
            return np.empty(0), np.empty(0, np.int64), data
        totals = np.bincount(sentence, weights=self.weights[ids])
        there = np.flatnonzero(np.bincount(sentence))
        return totals[there] + self.bias, there, data


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Adagrad on the likelihood of the labels under the noisy-or."""
    rng = np.random.default_rng(seed)
    bags, sizes = [], []  # of each document its sentences' features one after another, and how many each has
    for text in texts:
        ids, sentence, _ = features(text)
        order = np.argsort(sentence, kind="stable")
        bags.append(ids[order].astype(np.int32))
        counts = np.bincount(sentence)
        sizes.append(counts[counts > 0])
    y = np.array(labels, np.float64)
    usable = np.array([i for i, s in enumerate(sizes) if len(s)], np.int64)
    weights, bias = np.zeros(BUCKETS), -6.0
    squares, bias_square = np.full(BUCKETS, 1e-4), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(usable)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            ids, size = np.concatenate([bags[i] for i in batch]), np.concatenate([sizes[i] for i in batch])
            per_doc = np.array([len(sizes[i]) for i in batch])
            z = np.add.reduceat(weights[ids], np.cumsum(size) - size) + bias
            total = np.add.reduceat(softplus(z), np.cumsum(per_doc) - per_doc)
            pull = np.where(y[batch] > 0, -1 / np.expm1(np.clip(total, 1e-6, 500)), 1.0)
            slope = np.repeat(pull, per_doc) / (1 + np.exp(-np.clip(z, -500, 500)))
            ids_gradient = np.bincount(ids, weights=np.repeat(slope, size), minlength=BUCKETS) / len(batch)
            touched = np.flatnonzero(ids_gradient)
            step = ids_gradient[touched] + DECAY * weights[touched]
            squares[touched] += step**2
            weights[touched] -= RATE * step / np.sqrt(squares[touched])
            step = slope.sum() / len(batch)
            bias_square += step**2
            bias -= RATE * step / np.sqrt(bias_square)
    return Model(weights.astype(np.float32), float(bias))


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc32_of_id(doc_id), F.lit(4)) == 2


def train_on(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on a bounded sample of the labels that are not held out; conflicting labels of one id all count."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    chosen = sample_by_id(usable, sample_rows, 6)  # at most twice sample_rows rows, so it may be broadcast
    rows = documents.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Repeated ids may make more rows of the labels; which of them stay doesn't depend on the run.
    found = sorted(map(tuple, rows.orderBy("doc_id", "text", "toxic").limit(2 * sample_rows).collect()))
    return train([r[1] for r in found], [int(r[2] > 0) for r in found])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Returns doc_id, score, predicted, n_sentences, offending (array of start, end, probability of sentences from the
    threshold on: character offsets) for each row of documents.

    A null or empty text has no sentence and score 0. A very long text is looked at in pieces that end where sentences do,
    all of which count. Null ids stay null, repeated rows give repeated results, no rows give none. Other columns are
    ignored.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def start():
        model = sent.value

        def one(doc_id, text):
            total, n, bad = 0.0, 0, []
            for offset, piece in pieces(text or ""):
                z, number, data = model.sentences(piece)
                total, n = total + float(softplus(z).sum()), n + len(z)
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                if (hits := np.flatnonzero(p >= THRESHOLD)).size:
                    ends = np.flatnonzero(np.append(_ENDS[np.frombuffer(data, np.uint8)], True))
                    chars = lambda at, piece=piece: offset + len(piece.encode()[:at].decode(errors="ignore"))  # noqa: B023, E731
                    for k in hits:
                        low = 0 if number[k] == 0 else int(ends[number[k] - 1]) + 1
                        bad.append({"start": chars(low), "end": chars(int(ends[number[k]])), "probability": float(p[k])})
            score = float(-np.expm1(-total))
            return ((doc_id, score, int(score >= THRESHOLD), n, bad),)

        return one

    return map_rows(documents.select("doc_id", "text"), "doc_id long, score double, predicted int, n_sentences int, offending array<struct<start:int,end:int,probability:double>>", start)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, by a model of the labels that are not held out."""
    documents = read(spark, sf_dir, "documents")
    out = score(documents, train_on(documents, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"))
