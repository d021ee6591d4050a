"""Quality rules as a short-circuit cascade: a sample gives each rule's cost and how much it rejects, and rules run in
the order of rejections for the cost, so that most bad documents meet few rules. The verdict doesn't depend on the order.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm._common import map_rows, read, sample_by_id

#: Rows on which costs and selectivities are measured, at most twice as many, and characters of the longest text among them.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 50_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"


class Facts:
    """A text and what the base has counted in it; its words are only made where a rule asks for them."""

    def __init__(self, text: str):
        self.text = text
        self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words = base(text)
        self.failed = self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words

    def fresh(self) -> Facts:
        """The same facts, without what rules have asked for so far."""
        new = object.__new__(type(self))
        new.__dict__ |= {k: v for k, v in self.__dict__.items() if k not in ("words", "lines")}
        return new

    @cached_property
    def words(self) -> list[str]:
        return words_of(self.text)

    @cached_property
    def lines(self) -> list[str]:
        return self.text.split("\n")


Rule = tuple[str, Callable[[Facts], bool]]


def words_of(text: str) -> list[str]:
    """Words are separated by ASCII white space only."""
    return [w.decode() for w in text.encode().split()]


def repeated_words(words: list, size: int = WINDOW) -> int:
    """Words inside windows of size words that occur twice or more in the text, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict = {}
    numbers = [ids.setdefault(w, len(ids)) for w in words]
    if len(ids) == len(words):
        return 0
    windows = list(zip(*(numbers[k:] for k in range(size)), strict=False))
    seen = Counter(windows)
    if len(seen) == n:
        return 0
    covered = end = 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            covered += at + size - max(end, at)
            end = at + size
    return covered


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.encode().split())


def base(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode())
    return len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(words)


# --- rules of the cascade: each is True for a document to reject ---------------------------------------------------

_LETTERS = re.compile(r"[^\W\d_]")


def odd_word_length(facts: Facts) -> bool:
    return not 2 <= facts.word_chars / max(1, facts.n_words) <= 20


def many_symbols(facts: Facts) -> bool:
    return facts.n_symbols > 0.1 * max(1, facts.n_words)


def few_letter_words(facts: Facts) -> bool:
    return sum(1 for w in facts.words if _LETTERS.search(w)) < 0.5 * facts.n_words


def many_duplicate_lines(facts: Facts) -> bool:
    return facts.n_dup_lines > 0.5 * len(facts.lines)


def many_bullets(facts: Facts) -> bool:
    return sum(1 for x in facts.lines if x.lstrip()[:1] in ("-", "*", "•")) > 0.9 * len(facts.lines)


def many_ellipses(facts: Facts) -> bool:
    return sum(1 for x in facts.lines if x.rstrip().endswith(("...", "…"))) > 0.5 * len(facts.lines)


RULES: tuple[Rule, ...] = tuple((f.__name__, f) for f in (odd_word_length, many_symbols, few_letter_words, many_duplicate_lines, many_bullets, many_ellipses))


def order_rules(texts: Iterable[str], rules: Iterable[Rule] = RULES) -> list[Rule]:
    """Rules by rejections per second on those texts of the sample that the base passes on to the cascade, the most first.

    Each place goes to the rule that does best on the texts that the rules before it leave, and after these have run: what
    they have made of a text already, such as its lines, costs nothing more. A rule that rejects none comes by its cost.
    """
    left, order, rest = [f for f in map(Facts, texts) if not f.failed], [], dict(rules)
    while rest:
        rated = []
        for name, rule in rest.items():
            facts = [f.fresh() for f in left]
            for f in facts:
                for _, before in order:
                    before(f)
            began = time.perf_counter()
            rejected = sum(map(rule, facts))
            rated.append((-(rejected + 0.01) / (time.perf_counter() - began + 1e-9), name))
        name = min(rated)[1]
        order.append((name, rest.pop(name)))
        left = [f for f in left if not order[-1][1](f.fresh())]
    return order


def judge_quality(documents: DataFrame, rules: Iterable[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_rules.

    kept is False if the base rule fails or any rule of the cascade rejects; n_rules counts the rules that were run. A
    null or empty text has no words and fails. A very long text is judged as a whole, in one task. Null ids stay null,
    repeated rows give repeated results, no rows give none, and other columns are ignored. Only the order of the rules
    comes from the sample of about sample_rows rows; rules that tie run by name.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cascade = order_rules([r["text"] for r in sample_by_id(rows, sample_rows, 9).where(F.length("text") <= SAMPLE_CHARS).collect()], rules)

    def start():
        def one(doc_id, text):
            facts, run = Facts(text), 0
            kept = not facts.failed
            if kept:
                for _, rule in cascade:
                    run += 1
                    if rule(facts):
                        kept = False
                        break
            yield doc_id, facts.n_words, facts.word_chars, facts.n_symbols, facts.n_dup_lines, facts.n_repeat_words, facts.failed, kept, run

        return one

    return map_rows(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_rules int", start)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict of every document."""
    return judge_quality(read(spark, sf_dir, "documents")).drop("n_rules")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
windows AS (SELECT r, k, list_slice(w, k, k + 7) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS k FROM words WHERE len(w) >= 8)),
often AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + 8)) AS p FROM often) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
shape AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '^\s*[-*•]')) AS bullets, count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|…)\s*$')) AS ellipses FROM lines GROUP BY r),
base AS (
  SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS lettered, n_lines, bullets, ellipses
  FROM d JOIN words USING (r) JOIN shape USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r)
), judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND 10 * n_symbols <= n_words AND 2 * lettered >= n_words AND 2 * n_dup_lines <= n_lines AND 10 * bullets <= 9 * n_lines AND 2 * ellipses <= n_lines AS kept
FROM judged
"""
