"""Documents with every odd case, and plain versions of the operators."""

import hashlib
import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Columns named like those that operators make or use.
CLASHES = ("digest", "block", "key", "words", "score", "rejected", "lang_pred", "n_lines", "n_removed", "fingerprint", "component_id", "gone_id", "kept_digest", "bad_id", "line", "id")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["ta", "re", "mi", "so", "él", "ü", "qu"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    lines = [sentence(rng.randint(1, 40)) for _ in range(40)]
    shared = sentence(70)
    rows = []
    for i in range(n):
        parts = [rng.choice(lines) if rng.random() < 0.3 else sentence(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if i % 7 == 0:
            parts.append(shared)
        if i % 9 == 0:
            words = rng.choice(lines).split()
            words[rng.randrange(len(words))] = "changed"
            parts.append(" ".join(words))
        rows.append((i, "\n".join(parts)))
    rows += [(n + k, rows[k][1]) for k in range(5)]  # exact copies
    rows += [(n + 10, rows[3][1].replace(" ", "  ", 1)), (n + 11, rows[4][1] + " more")]
    rows += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "\n\n"), (1004, "12345 67 !!"), (1005, "a"), (1006, "x" * 5000), (1007, "ab " * 4000), (1008, rows[0][1] * 40)]
    rows += [(None, rows[1][1]), (None, None), (None, "a text without an id, which is long enough to hold a hundred bytes and a little more than that, as may be seen")]
    rows += [rows[2], rows[2], (1001, "")]  # repeated rows
    rows += [(5, rows[6][1])]  # an id that is taken
    return [(i, t, ("en", "de")[(i or 0) % 2], "s", None if t is None else len(t)) for i, t in rows]


def frame(spark, rows, clashes=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in CLASHES}) if clashes else df


def in_order(rows):
    """Earlier documents first: null ids last. Texts of equal ids are told apart by Spark's digest, so tests give them
    as (id, text, digest)."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))


def removed_bytes(docs, length=100):
    """docs: (id, text, digest). Returns (id, bytes, removed, spans, digest of the rest), sorted."""
    seen, out = set(), []
    for doc_id, text, _ in in_order(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def deduped_lines(docs, min_words=5):
    """docs: (id, text, digest). Returns (id, text, lines, removed), sorted. Rows alike are one row for the order."""
    exact, same, whole, part, known, out = set(), set(), set(), set(), {}, []
    for doc_id, text, digest in in_order(docs):
        if (doc_id, digest) in known:
            out.append(known[doc_id, digest])
            continue
        kept, lines, removed = [], [] if text is None else text.split("\n"), 0
        for line in lines:
            trimmed = line.strip(" \t\r\x0b\x0c")
            words, bad = tuple(trimmed.split(" ")), False
            if trimmed:
                bad = words in exact
                exact.add(words)
                if len(words) >= min_words:
                    variants = [words[:k] + words[k + 1 :] for k in range(len(words))]
                    bad = bad or words in part or any(v in whole or (v, k) in same for k, v in enumerate(variants))
                    same |= {(v, k) for k, v in enumerate(variants)}
                    whole.add(words)
                    part |= set(variants)
            removed += bad
            if not bad:
                kept.append(line)
        known[doc_id, digest] = (doc_id, None if text is None else "\n".join(kept), len(lines), removed)
        out.append(known[doc_id, digest])
    return sorted(out, key=str)


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
