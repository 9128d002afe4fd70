"""URL filter: host and path rules first, then a weighted vocabulary of URL terms.

A rule (action, host, path) fits its host and all subdomains when the URL's path starts with
the rule's path; of the rules that fit, the longest decides. A URL without a rule is judged
by its terms: one Aho-Corasick automaton of strict and soft terms runs over the lower-cased
URL, percent escapes read as blanks. A term counts where no letter a-z stands on either side
of it, once a URL however often it occurs. One strict term blocks, as do ``need`` different
soft terms: strict terms weigh ``need``, soft ones 1, and ``need`` is the limit.

Nothing is shuffled: rules are column expressions, the automaton is built once a task from
the vocabulary, a parameter. Host and path are as written (a port or user name stays part of
the host), only A-Z lower-cased in the host.

Edge cases: a null URL, or one without ``://``, has an empty host and path and no rule; its
terms are still looked for (none in null). Rows are judged one by one, so repeated rows and
null ids keep a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Vocabulary:
    """Lower-case terms; ``need`` different soft ones weigh as much as a strict one."""

    strict: tuple[str, ...]
    soft: tuple[str, ...]
    need: int = 2


#: the rules of the registered query (fixed values)
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

#: adult, gambling, spam and piracy terms: strict ones are unlikely in any other URL
TERMS = Vocabulary(
    strict=(
        "porn", "porno", "pornos", "pornhub", "xxx", "hentai", "milf", "milfs", "camgirl", "camgirls", "sexcam", "sexcams",
        "blowjob", "gangbang", "creampie", "onlinecasino", "casinobonus", "sportsbook", "warez", "keygen", "torrentz",
    ),
    soft=(
        "adult", "sex", "sexy", "nude", "nudes", "naked", "erotic", "escort", "escorts", "fetish", "webcam", "cams", "dating",
        "hookup", "lingerie", "casino", "poker", "slots", "roulette", "jackpot", "betting", "bet", "bonus", "gambling", "lottery",
        "viagra", "cialis", "pills", "cheap", "free", "win", "winner", "bets", "prize", "spam", "ads", "track", "clickbait",
        "torrent", "torrents", "crack", "cracked", "serial", "nulled", "leaked", "uncensored",
    ),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to / ? # or the end, and then up to ? # or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null; of equally long ones, the first in order of text."""
    out = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: (-len(r.text), r.text))):
        out = F.when(fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


def _count_terms(terms: Vocabulary):
    """Different strict and soft terms of every ``url``, appended to the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [*dict.fromkeys(terms.strict), *(t for t in dict.fromkeys(terms.soft) if t not in terms.strict)]
        n_strict = len(dict.fromkeys(terms.strict))
        machine = ahocorasick.Automaton()
        for k, word in enumerate(words):
            machine.add_word(word, k)
        if words:
            machine.make_automaton()
        for b in batches:
            urls = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(b.column("url"), "")), "%[0-9a-f][0-9a-f]", " ")
            counts = np.zeros((b.num_rows, 2), np.int32)
            for row, url in enumerate(urls.to_pylist() if words else ()):
                found = set()
                for last, k in machine.iter(url):
                    first = last + 1 - len(words[k])
                    if (first == 0 or not "a" <= url[first - 1] <= "z") and (last + 1 == len(url) or not "a" <= url[last + 1] <= "z"):
                        found.add(k)
                strict = sum(k < n_strict for k in found)
                counts[row] = strict, len(found) - strict
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["page_id", "url", "n_strict", "n_soft"])

    return run


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, terms: Vocabulary = TERMS) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft of every row of ``pages`` (page_id, url)."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    counted = base.mapInArrow(_count_terms(terms), "page_id bigint, url string, n_strict int, n_soft int")
    host, path = url_parts(F.col("url"))
    parts = counted.select("page_id", host.alias("host"), path.alias("path"), "n_strict", "n_soft")
    host, path = F.col("host"), F.col("path")
    rule = longest_rule(rules, host, path, lambda r: r.text)
    by_terms = F.when(terms.need * F.col("n_strict") + F.col("n_soft") >= terms.need, "block").otherwise("allow")
    verdict = F.coalesce(longest_rule(rules, host, path, lambda r: r.action), by_terms)
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft")


def url_sql(rules: tuple[Rule, ...] = RULES, terms: Vocabulary = TERMS) -> str:
    """The same for DuckDB: every term by a regular expression of its own."""
    strict = list(dict.fromkeys(terms.strict))
    soft = [t for t in dict.fromkeys(terms.soft) if t not in strict]

    def hits(words):
        return " + ".join(f"regexp_matches(u, '(^|[^a-z]){w}([^a-z]|$)')::INT" for w in words) or "0"

    def case(value):
        longest = sorted(rules, key=lambda r: (-len(r.text), r.text))
        return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') THEN '{value(r)}'" for r in longest) + " END"

    return f"""
WITH rest AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(r, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(translate(url, '{UPPER}', '{LOWER}'), '%[0-9a-f][0-9a-f]', ' ', 'g') AS u
  FROM rest
), counted AS (
  SELECT page_id, host, path, ({hits(strict)})::INT AS n_strict, ({hits(soft)})::INT AS n_soft FROM parts
)
SELECT page_id, host, path, {case(lambda r: r.text)} AS rule,
  coalesce({case(lambda r: r.action)}, CASE WHEN {terms.need} * n_strict + n_soft >= {terms.need} THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, n_soft
FROM counted"""


OP13_SQL = url_sql()


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
