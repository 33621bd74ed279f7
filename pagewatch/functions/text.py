"""Text expressions: trimming, hashing, signal scoring, quote comparison."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode-aware trimming removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The characters that end a line.
LINE_BREAKS = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029]"

# Lexical signals of guidance addressed to outside spenders, each
# with a lower-case text every match contains.
SIGNALS = (
    (r"\bvoters?\s+(?:need|should|must)\b", "voter"),
    (r"\bneed to (?:see|hear|read|know)\b", "need to "),
    (r"\bshould (?:see|hear|read|tell|emphasize|mention|feature|highlight|know)\b", "should "),
    (r"\bon the go\b", "on the go"),
    (r"\bin (?:their|the) mailbox", "mailbox"),
    (r"\bb-?roll\b", "roll"),
    (r"\bmedia market\b", "media market"),
    (r"\bpaid (?:communication|media|advertising|comms)\b", "paid "),
    (r"\bdirect mail\b", "direct mail"),
    (r"\b(younger|older|suburban|rural|likely|latino|latina) (?:primary )?voters?\b", "voter"),
    (r"\bcontrast (?:with|against|messaging)\b", "contrast "),
    (r"\bmessaging guidance\b", "messaging guidance"),
    (r"\bclear and bold\b", "clear and bold"),
    (r"\bmore to follow\b", "more to follow"),
    (r"\bfor (?:national|local) press release\b", " press release"),
    (r"\bvoters (?:age|under|over|likely)\b", "voters "),
    (r"\bon (?:the )?(?:tv|broadcast|cable|ctv|youtube|meta|streaming)\b", "on "),
    (r"\bcouncilmanic\b", "councilmanic"),
    (r"\bcrosstab", "crosstab"),
)
SIGNAL_PATTERNS = tuple(pattern for pattern, _ in SIGNALS)

HIDDEN_MARKER = "[hidden/DOM-only content]"


def any_of(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Apply ``fn`` to ``value`` computed once.

    A column used inside an array lambda is otherwise evaluated per element.
    """
    return F.transform(F.array(value), fn)[0]


def strip(c: Column) -> Column:
    """Trim every Unicode whitespace character, not only spaces."""
    return F.trim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def words(c: Column) -> Column:
    """Whitespace-separated tokens; an empty text gives an empty array."""
    return F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAKS)


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every letter run, lower-case the rest."""
    runs = F.split(F.regexp_replace(F.lower(c), r"(?<!\p{L})(?=\p{L})", "\u0001"), "\u0001")
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))),
        "",
    )


def case_folded(c: Column) -> Column:
    """Lower case, with the letters a case-insensitive ASCII match also accepts."""
    return F.lower(F.translate(c, "\u0130\u0131\u017f\u212a", "iisk"))


def signal_hits(text: Column, patterns: Sequence[str] = SIGNAL_PATTERNS) -> list[Column]:
    """One boolean per pattern: it occurs somewhere in the whole text.

    Known patterns look for their fixed text first, which is far cheaper than
    the regular expression and settles most pages.
    """
    known = dict(SIGNALS)
    body = F.coalesce(text, F.lit(""))
    low = case_folded(body)

    def hit(pattern: str) -> Column:
        match = body.rlike("(?iU)" + pattern)
        return F.contains(low, F.lit(known[pattern])) & match if pattern in known else match

    return [hit(p) for p in patterns]


def signal_score(text: Column, patterns: Sequence[str] = SIGNAL_PATTERNS) -> Column:
    """How many distinct patterns occur in the text."""
    total = F.lit(0)
    for hit in signal_hits(text, patterns):
        total = total + hit.cast("int")
    return total


def classifier_text(visible: Column, dom: Column) -> Column:
    """Visible text followed by the document lines a visitor does not see."""
    vis = strip(F.coalesce(visible, F.lit("")))
    full = strip(F.coalesce(dom, F.lit("")))
    hidden = bind(
        F.transform(lines(vis), strip),
        lambda seen: F.array_join(
            F.filter(lines(full), lambda x: (strip(x) != "") & ~F.array_contains(seen, strip(x))), "\n"
        ),
    )
    remainder = F.when(vis == "", full).otherwise(hidden)
    joined = strip(F.concat(vis, F.lit(f"\n\n{HIDDEN_MARKER}\n"), remainder))
    return (
        F.when((full == "") | F.contains(vis, full), F.when(vis != "", vis).otherwise(full))
        .when(remainder == "", vis)
        .otherwise(joined)
    )


def norm_span(c: Column) -> Column:
    squeezed = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.lower(F.trim(squeezed))


def span_key(c: Column) -> Column:
    """Comparison key of a quoted span: normalised, trailing dots dropped."""
    return F.rtrim(norm_span(c), F.lit(".…"))


def raw_quotes(evidence: Column) -> Column:
    quotes = F.transform(evidence, lambda e: e["quote"])
    return F.coalesce(F.filter(quotes, lambda q: q.isNotNull() & (q != "")), F.array().cast("array<string>"))


def quote_set(evidence: Column) -> Column:
    """Distinct comparison keys of the non-empty quotes."""
    return F.array_distinct(F.transform(raw_quotes(evidence), span_key))


def guidance_unchanged(prev_evidence: Column, new_evidence: Column, prev_text: Column, new_text: Column) -> Column:
    """True / false when the quoted spans settle it, NULL when they cannot."""
    before, after = quote_set(prev_evidence), quote_set(new_evidence)
    held_after = bind(norm_span(new_text), lambda page: F.forall(before, lambda q: F.contains(page, q)))
    held_before = bind(norm_span(prev_text), lambda page: F.forall(after, lambda q: F.contains(page, q)))
    return (
        F.when(
            (F.size(before) > 0) & (F.size(after) > 0),
            (F.array_sort(before) == F.array_sort(after)) | (held_after & held_before),
        )
        .when((F.size(after) > 0) & (F.coalesce(prev_text, F.lit("")) != ""), held_before)
        .otherwise(F.lit(None).cast("boolean"))
    )


def quote_diff(old_evidence: Column, new_evidence: Column) -> Column:
    """struct(added, dropped): raw quotes whose key is on one side only."""

    def one_sided(evidence: Column, other: Column) -> Column:
        quotes = raw_quotes(evidence)
        keys = F.array_except(quote_set(evidence), quote_set(other))
        return bind(
            quotes,
            lambda raw: F.transform(keys, lambda k: F.element_at(F.filter(raw, lambda q: span_key(q) == k), -1)),
        )

    return F.struct(
        one_sided(new_evidence, old_evidence).alias("added"),
        one_sided(old_evidence, new_evidence).alias("dropped"),
    )


def clip(c: Column, limit: int = 290) -> Column:
    """Cut at the last space when that keeps more than half of the limit."""
    cut = F.substring(c, 1, limit)
    last_space = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    kept = F.when(last_space > limit / 2, cut.substr(F.lit(1), last_space)).otherwise(cut)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(kept, F.lit(" …")))


def estimate_tokens(chars: Column, prompt_tokens: int = 700) -> Column:
    return F.floor(chars / 4).cast("long") + F.lit(prompt_tokens)
