"""URL filter: a trie over reversed host labels and path segments, with the longest matching rule winning.

The trie is built once and broadcast, as long as the rules are few enough. A longer list is joined instead: an address
looks up the suffixes of its host, and of those that rules have, the beginnings of its path that are as long as a rule's.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm._common import LOWER, UPPER, map_rows, read

#: Rules of a trie that is broadcast, at most; more are joined by shuffles, which gives the same.
MAX_BROADCAST = 200_000
#: Parts that the addresses of a host are dealt out over in that join.
SALTS = 16

_LOWER = str.maketrans(UPPER, UPPER.lower())


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # it and its subdomains
    path: str  # what the path starts with, with its slash


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path. Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the
    end. A null URL or one without :// has neither."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    stop = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    end = min((i for i in (rest.find(c, stop) for c in "?#") if i >= 0), default=len(rest))
    return rest[:stop].translate(_LOWER), rest[stop:end]


class Trie:
    """Edges are host labels from the last to the first, then path segments. At a node are the rules that end in it, under
    the beginning of the next segment that they ask for, by its length from the longest on."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.translate(_LOWER).split(".")):
                node = node.setdefault(("host", label), {})
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            ends = node.setdefault("ends", {}).setdefault(-len(last), {})
            # Of equal rules, block wins.
            if last not in ends or rule.verdict == "block":
                ends[last] = rule
        self._sort(self.root)

    def _sort(self, root: dict) -> None:
        waiting = [root]
        while waiting:
            node = waiting.pop()
            if ends := node.get("ends"):
                node["ends"] = dict(sorted(ends.items()))
            waiting += (below for key, below in node.items() if key != "ends")

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule (characters of host and path; of equal length the longer host) that fits."""
        best, size = None, (-1, -1)
        segments = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            if (node := node.get(("host", label))) is None:
                break
            at = node
            for segment in segments:
                for n, ends in at.get("ends", {}).items():
                    if -n <= len(segment) and (rule := ends.get(segment[:-n] if n else "")):
                        if (n := (len(rule.host) + len(rule.path), len(rule.host))) > size:
                            best, size = rule, n
                        break  # shorter beginnings are shorter rules
                if (at := at.get(("path", segment))) is None:
                    break
        return best


def judge_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """Judges the column url of pages by rules, which may be a DataFrame (verdict, host, path). Returns page_id, host, path,
    rule, verdict, a row for each row.

    The longest rule wins, of equal length the longer host, and block of equal rules. No rule fits: rule is null and the
    verdict is default. A null page_id stays null, a null or odd URL has an empty host and path, which a rule with a host
    never fits; a rule without a host never fits any. Very long URLs are looked up as a whole. Repeated rows give repeated
    results, no rows none. Other columns are ignored. Up to MAX_BROADCAST rules go to the executors as a trie; more are
    joined.
    """
    if isinstance(rules, DataFrame):
        rules = rules.select("verdict", "host", "path")
        few = rules.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
        if not few:
            return judge_by_join(pages, rules, default)
        rules = [Rule(*r) for r in rules.collect()]
    rules = list(rules)
    if len(rules) > MAX_BROADCAST:
        return judge_by_join(pages, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), default)
    sent = pages.sparkSession.sparkContext.broadcast(Trie(r for r in rules if r.host))

    def start():
        trie = sent.value

        def one(page_id, url):
            host, path = split_url(url)
            rule = trie.find(host, path)
            yield page_id, host, path, rule and rule.host.translate(_LOWER) + rule.path, rule.verdict if rule else default

        return one

    return map_rows(pages.select("page_id", "url"), "page_id long, host string, path string, rule string, verdict string", start)


def url_parts(url: Column) -> tuple[Column, Column]:
    """split_url as expressions."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    authority = reduce(lambda c, mark: F.substring_index(c, mark, 1), "/?#", rest)
    path = reduce(lambda c, mark: F.substring_index(c, mark, 1), "?#", F.substr(rest, F.length(authority) + 1))
    return F.translate(authority, UPPER, LOWER), path


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """judge_urls for rules of any number, as a DataFrame: with joins on hosts, and then on hosts and beginnings of paths.
    Each different address is judged once. A host that many addresses end in, such as com, is dealt out over SALTS parts,
    to each of which its rules go."""
    host, path = url_parts(F.col("url"))
    rules = rules.where(F.length("host") > 0).select("verdict", F.translate("host", UPPER, LOWER).alias("rule_host"), "path")
    rules = rules.groupBy("rule_host", F.col("path").alias("rule_path")).agg(F.max("verdict").alias("verdict"))  # block is the later word
    dealt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths")).withColumn("salt", dealt)
    rules = rules.withColumn("salt", dealt)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = rows.select("host", "path").distinct().withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    asked = asked.select("host", "path", "salt", F.explode(suffixes).alias("rule_host")).join(lengths, ["rule_host", "salt"])
    asked = asked.select("host", "path", "salt", "rule_host", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    asked = asked.select("host", "path", "salt", "rule_host", F.expr("substring(path, 1, n)").alias("rule_path"))
    size = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    best = asked.join(rules, ["rule_host", "rule_path", "salt"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), size).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host, path, deciding rule and verdict of every page's URL, under RULES."""
    return judge_urls(read(spark, sf_dir, "pages"))


_FITS = " ".join(
    f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.verdict} {r.host}{r.path}'"
    for r in sorted(RULES, key=lambda r: -len(r.host + r.path))
)
OP10_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), fit AS (SELECT *, CASE {_FITS} END AS hit FROM parts)
SELECT page_id, host, path, substr(hit, 7) AS rule, coalesce(left(hit, 5), 'allow') AS verdict FROM fit
"""
