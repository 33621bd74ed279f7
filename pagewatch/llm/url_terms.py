"""URL filter: host and path rules, then a weighted vocabulary of URL terms.

One strict term rejects a URL; soft terms reject it when several different ones
occur. A term counts only between boundaries: the characters beside it are not
a-z or 0-9. An Aho-Corasick automaton finds all terms in one pass over the URL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRICT = ("casino", "porn", "xxx", "viagra", "cialis", "escort", "escorts", "hentai", "sexcam", "warez", "jackpot")
SOFT = (
    "ads", "adult", "bet", "bets", "betting", "bonus", "cams", "cheap", "click", "dating", "discount", "free", "loan",
    "loans", "lottery", "payday", "pills", "poker", "popup", "replica", "slots", "track", "tracker", "win", "winner",
)
SOFT_LIMIT = 2
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The rule that fits and its verdict; the longest comes first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def term_counter(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT):
    """Pandas UDF: the different strict and soft terms of each URL."""
    kinds = {**dict.fromkeys(soft, 1), **dict.fromkeys(strict, 0)}

    @F.pandas_udf("strict_terms int, soft_terms int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in kinds:
            automaton.add_word(term, term)
        automaton.make_automaton()
        lower = str.maketrans(UPPER, LOWER)
        inner = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

        def found(url: str | None) -> tuple[int, int]:
            text, seen = (url or "").translate(lower), set()
            for end, term in automaton.iter(text):
                start = end - len(term)
                if (start < 0 or text[start] not in inner) and (end + 1 == len(text) or text[end + 1] not in inner):
                    seen.add(term)
            firm = sum(kinds[t] == 0 for t in seen)
            return firm, len(seen) - firm

        for urls in batches:
            yield pd.DataFrame([found(u) for u in urls], columns=["strict_terms", "soft_terms"]).astype("int32")

    return count


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """A verdict per row of ``pages`` (page_id, url).

    A null or empty URL, or one without ``://``, has an empty host and path and fits no
    rule. Terms are looked for in the whole URL, with or without ``://``; a null or empty one holds none and is allowed. Repeated rows are judged row by row;
    other columns are not returned.
    """
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select(
        "page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), term_counter(strict, soft)("url").alias("t")
    )
    rejected = (F.col("t.strict_terms") > 0) | (F.col("t.soft_terms") >= soft_limit)
    by_terms = F.when(rejected, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_terms).alias("verdict"),
        F.col("t.strict_terms").alias("strict_terms"), F.col("t.soft_terms").alias("soft_terms"),
    )


def oracle() -> str:
    """The same in DuckDB: each term is a regular expression with boundaries."""

    def distinct(terms: Sequence[str]) -> str:
        return " + ".join(f"(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))::int" for t in terms)

    cases = []
    for name, prefix, says in sorted(RULES, key=lambda r: -len(r[0]) - len(r[1])):
        cases.append((f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{prefix}')", name + prefix, says))
    rule = " ".join(f"when {test} then '{text}'" for test, text, _ in cases)
    ruled = " ".join(f"when {test} then '{says}'" for test, _, says in cases)
    return f"""
with u as (
  select page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') as low,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages),
t as (select *, ({distinct(STRICT)})::int as strict_terms, ({distinct(SOFT)})::int as soft_terms from u)
select page_id, host, path, case {rule} end as rule,
  coalesce(case {ruled} end, case when strict_terms > 0 or soft_terms >= {SOFT_LIMIT} then 'block' else 'allow' end) as verdict,
  strict_terms, soft_terms
from t"""
