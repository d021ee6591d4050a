"""Language identification with averaged embeddings of hashed subwords and a linear softmax.

The subwords of a word are n-grams of its bytes with a mark at both ends, and their hashes pick rows of an embedding
table. A text's vector is the mean over the subwords of its words. Table and softmax are trained by stochastic gradient
descent in numpy on a bounded sample. As all of it is linear, a task adds up one short row for each subword.

Rejection is calibrated on a part of the sample that is not trained on: a temperature makes the scores probabilities, and
the threshold is one below which hardly any of these texts score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm._common import crc32_of_id, free_name, read, sample_by_id

#: Rows of the sample (at most twice as many), and characters of the longest text in it.
SAMPLE_ROWS, SAMPLE_CHARS = 3_000, 50_000
BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (1, 2, 3, 4)
#: Subwords of a training example, drawn anew in each epoch; short ones make the model fit for short texts.
DRAWN = (8, 32, 256)
EPOCHS, RATE, BATCH = 6, 0.5, 16
#: The share of texts in known languages that may be rejected, and a threshold that is high enough for any.
REJECTED, MOST = 0.001, 0.5
UNKNOWN = "und"

#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 16
#: ASCII letters stay, other ASCII becomes the mark between words; bytes beyond ASCII count as letters.
_MARKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def subwords(text: str) -> np.ndarray:
    """Buckets of all subwords of a text; none for a text without letters."""
    if not any(map(str.isalpha, text)):
        return np.empty(0, np.uint16)
    data = np.frombuffer(b" " + text.lower().encode().translate(_MARKED) + b" ", np.uint8)
    return np.concatenate([_hashed(data[at : at + CHUNK + max(GRAMS) - 1], CHUNK) for at in range(0, len(data), CHUNK)])


def _hashed(data: np.ndarray, starts: int) -> np.ndarray:
    """Buckets of the n-grams that begin at the first starts places, without those that have a mark inside or nothing
    else."""
    codes, marks = data.astype(np.uint32), data == 32
    out, hashed, inside = [], np.zeros(len(data), np.uint32), np.zeros(len(data), bool)
    for n in range(1, max(GRAMS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        hashed = hashed[:m] * np.uint32(0x01000193) + codes[n - 1 :]
        if n > 2:
            inside = inside[:m] | marks[n - 2 : n - 2 + m]
        if n in GRAMS:
            lone = marks[:m] if n == 1 else marks[:m] & marks[n - 1 :] if n == 2 else inside[:m]
            good = np.flatnonzero(~lone[:starts])
            out.append((((hashed[good] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.uint16))
    return np.concatenate(out) if out else np.empty(0, np.uint16)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # of each bucket its embedding times the softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, found: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for some subwords."""
        if len(found) > BUCKETS // 8:
            total = np.bincount(found, minlength=BUCKETS) @ self.table
        else:
            total = self.table[found].sum(axis=0)
        z = (total / max(1, len(found)) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Every fifth text is kept for calibration."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    features = [subwords(text) for text in texts]
    y = np.array([languages.index(x) for x in labels])
    usable = [i for i, f in enumerate(features) if len(f)]
    held, used = usable[::5], [i for k, i in enumerate(usable) if k % 5] or usable
    embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    steps = EPOCHS * max(1, len(used) // BATCH)
    for epoch in range(EPOCHS):
        order = rng.permutation(used)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            drawn = [rng.choice(features[i], min(len(features[i]), int(rng.choice(DRAWN)))) for i in batch]
            sizes = np.array([len(d) for d in drawn])
            ids = np.concatenate(drawn)
            mean = np.add.reduceat(embedding[ids], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(batch)), y[batch]] -= 1
            rate = np.float32(RATE * (1 - (epoch * (len(used) // BATCH) + at // BATCH) / (steps + 1)))
            back = (error @ weights.T) / sizes[:, None]
            weights -= rate * (mean.T @ error)
            bias -= rate * error.sum(axis=0) / len(batch)
            np.add.at(embedding, ids, (-rate * np.repeat(back, sizes, axis=0)).astype(np.float32))
    model = Model(languages, (embedding @ weights).astype(np.float32), bias)
    if held:
        z = np.stack([np.bincount(features[i], minlength=BUCKETS) @ model.table / len(features[i]) + bias for i in held])
        right = y[held]
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(held)), right] + 1e-12).mean()))
        model.threshold = float(min(MOST, np.quantile(_softmax(z / model.temperature).max(axis=1), REJECTED)))
    return model


def train_on(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on a sample of the rows that have a language and a text."""
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found = sorted(map(tuple, sample_by_id(usable, sample_rows, 2).where(F.length("text") <= SAMPLE_CHARS).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    return train([r[1] for r in found], [r[2] for r in found])


RESULTS = ("lang_pred", "score", "rejected")


def predict(documents: DataFrame, model: Model, names: tuple[str, str, str] = RESULTS) -> DataFrame:
    """Predicts the language of each text of documents (doc_id, text, and whatever is to be carried along).

    Returns the columns of documents with lang_pred, score (the probability of lang_pred) and rejected (the score is
    below the calibrated threshold, or there are no letters: lang_pred is then und and the score 0). A null or empty
    text has no letters. A very long text is hashed in pieces, all of which count. Of languages that tie the first by name
    is taken. Without any training rows everything is und. No rows give none; repeated rows give repeated results. Columns named like a result are replaced; names gives other names for the results.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    carried = documents.drop(*names)

    def start():
        model = sent.value

        def one(text):
            found = subwords(text or "")
            if not len(found) or not model.languages:
                return UNKNOWN, 0.0, True
            scores = model.scores(found)
            best = int(scores.argmax())
            return model.languages[best], float(scores[best]), bool(scores[best] < model.threshold)

        return one

    return _with_columns(carried, start, names)


def _with_columns(documents: DataFrame, start, names: tuple[str, str, str]) -> DataFrame:
    """The rows with the results of a function of text, which alone goes to Python and back with its row."""
    import pyarrow as pa
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    added = tuple(zip(names, (pa.string(), pa.float64(), pa.bool_()), (StringType(), DoubleType(), BooleanType()), strict=True))

    def run(batches):
        each = start()
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            found = [each(text[i].as_py()) for i in range(batch.num_rows)]
            columns = zip(*found, strict=True) if found else [[]] * len(added)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, (_, t, _) in zip(columns, added, strict=True))], names=[*batch.schema.names, *(n for n, _, _ in added)])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, *(StructField(n, t) for n, _, t in added)]))


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc32_of_id(doc_id), F.lit(5)) == 0


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document, by a model of the documents that are not held out."""
    documents = read(spark, sf_dir, "documents")
    model = train_on(documents.where(~held_out(F.col("doc_id"))))
    out = predict(documents.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(documents: DataFrame) -> DataFrame:
    """documents without those that are rejected. The model learns from documents, but not from those held out."""
    model = train_on(documents.where(~held_out(F.col("doc_id"))))
    names = tuple(free_name(documents, n) for n in RESULTS)
    return predict(documents, model, names).where(~F.col(names[2])).select(*documents.columns)


