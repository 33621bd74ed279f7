"""Scan, verdict and change-event expressions with the fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewatch.functions.text import any_of, strip

# Verdict vocabulary and review actions.
GUIDANCE = "red_box_guidance"
AMBIGUOUS = "ambiguous"
NO_GUIDANCE = "no_guidance_detected"
POSITIVE_CLASSES = (GUIDANCE, AMBIGUOUS)
REVIEW_ACTIONS = ("approve", "reject", "needs_more")

# Statuses of an absent page and of a throttled fetch.
GONE_STATUSES = (404, 410)
THROTTLE_STATUSES = (429, 503)

# Phrases of short bot-challenge pages.
CHALLENGE_MARKERS = (
    "just a moment", "checking your browser", "verifying you are human",
    "enable javascript and cookies", "captcha", "attention required",
)
CHALLENGE_MAX_CHARS = 400

VERDICT_SCHEMA = (
    "classification string, confidence double, "
    "evidence array<struct<quote:string,why:string>>, rationale string"
)


def is_positive(cls: Column) -> Column:
    return F.coalesce(cls.isin(*POSITIVE_CLASSES), F.lit(False))


def is_gone(http_status: Column) -> Column:
    return F.coalesce(http_status.isin(*GONE_STATUSES), F.lit(False))


def is_challenge(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    low = F.lower(body)
    return (F.length(body) < CHALLENGE_MAX_CHARS) & any_of([F.contains(low, F.lit(m)) for m in CHALLENGE_MARKERS])


def usable_scan(http_status: Column, text: Column) -> Column:
    """Whether a fetch says anything about what the page contains."""
    body = strip(F.coalesce(text, F.lit("")))
    return F.coalesce(http_status == 200, F.lit(False)) & (body != "") & ~is_challenge(body)


def change_type(prev_class: Column, new_class: Column) -> Column:
    before, after = is_positive(prev_class), is_positive(new_class)
    return F.when(before & ~after, "take_down").when(~before & after, "put_up").when(before & after, "modified")


def change_key(event_type: Column, same: Column) -> Column:
    """Display kind: a 'modified' event is refined by the quote comparison."""
    return (
        F.when(event_type != "modified", event_type)
        .when(same.isNull(), "changed")
        .when(same, "updated")
        .otherwise("revised")
    )


def severity(cls: Column) -> Column:
    return F.when(cls == GUIDANCE, 2).when(cls == AMBIGUOUS, 1).otherwise(0)


def should_escalate(cls: Column, confidence: Column, below: float = 0.75) -> Column:
    return F.coalesce(cls == AMBIGUOUS, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) < below)


def review_tier(cls: Column, action: Column) -> Column:
    """Approved positives lead, open positives follow, the rest sinks."""
    return (
        F.when(is_positive(cls) & (action == "approve"), 2)
        .when(is_positive(cls) & (action.isNull() | (action == "needs_more")), 1)
        .otherwise(0)
    )


def parse_verdict(raw: Column) -> Column:
    """struct(verdict fields..., error) of a reply that is, or holds, a JSON object.

    Each field is read on its own, so an odd one does not fail the reply: a number may be
    written as a text, evidence may be plain quotes. ``error`` is set when no object is
    found and holds the whole reply.
    """
    body = strip(F.coalesce(raw, F.lit("")))
    whole, inner = F.try_parse_json(body), F.try_parse_json(F.regexp_extract(body, r"(?s)\{.*\}", 0))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    reply = F.when(is_object(whole), whole).when(is_object(inner) & whole.isNull(), inner)
    field = lambda v, path, kind: F.try_variant_get(v, path, kind)

    def quoted(item: Column) -> Column:
        quote = F.coalesce(field(item, "$.quote", "string"), F.when(~is_object(item), field(item, "$", "string")))
        return F.struct(quote.alias("quote"), field(item, "$.why", "string").alias("why"))

    single = F.array(field(reply, "$.evidence", "variant"))
    items = F.coalesce(field(reply, "$.evidence", "array<variant>"), F.when(field(reply, "$.evidence", "string").isNotNull(), single))
    return F.struct(
        field(reply, "$.classification", "string").alias("classification"),
        field(reply, "$.confidence", "double").alias("confidence"),
        F.transform(items, quoted).alias("evidence"),
        field(reply, "$.rationale", "string").alias("rationale"),
        F.when(reply.isNull(), F.concat(F.lit("unparseable verdict: "), body)).alias("error"),
    )

