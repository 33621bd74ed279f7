"""URL expressions. Bad input never raises; it yields empty parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewatch.functions.text import any_of, bind, strip

# Path fragments of pages that always go to the classifier.
MEDIA_PATHS = (
    "/media", "/media-kit", "/mediakit", "/press", "/messaging", "/newsroom",
    "/news", "/resources", "/toolkit", "/kit", "/comms", "/communications",
)
# The same plus paths worth fetching early.
HIGH_VALUE_PATHS = MEDIA_PATHS + ("/supporter",)
# Path fragments of boilerplate pages.
BOILERPLATE_PATHS = (
    "/donate", "/contribute", "/chip-in", "/volunteer", "/privacy", "/terms",
    "/contact", "/events", "/event/", "/shop", "/store", "/merch", "/jobs",
    "/careers", "/unsubscribe", "/login", "/account", "/cart", "/checkout",
    "/thank", "/endorse", "/sign", "/petition", "/rsvp", "/host", "/refund",
)
# Hosts that are never a candidate's own site.
BLOCKED_HOSTS = (
    "wikipedia.org", "ballotpedia.org", "facebook.com", "twitter.com", "x.com",
    "instagram.com", "youtube.com", "linkedin.com", "tiktok.com", "actblue.com",
    "winred.com", "fec.gov", "opensecrets.org", "vote411.org", "wikidata.org",
    "linktr.ee", "votesmart.org", "govtrack.us", "legistorm.com", "ballotready.org",
    "vote.org", "emilyslist.org", "votevets.org",
)
# Paths probed on every site.
COMMON_PATHS = (
    "/media", "/media-kit", "/mediakit", "/press", "/messaging",
    "/newsroom", "/news", "/resources", "/toolkit",
)


def url_parts(u: Column) -> Column:
    """struct(host, path, query) of an address; the fragment is dropped."""

    def parts(bare: Column, head: Column, rest: Column) -> Column:
        absolute = rest.startswith("//")
        host = F.when(absolute, F.substring_index(F.substr(rest, F.lit(3)), "/", 1)).otherwise("")
        return bind(
            host,
            lambda h: F.struct(
                h.alias("host"),
                F.when(absolute, F.substr(rest, F.length(h) + 3)).otherwise(rest).alias("path"),
                F.substr(bare, F.length(head) + 2).alias("query"),
            ),
        )

    def split(bare: Column) -> Column:
        return bind(
            F.substring_index(bare, "?", 1),
            lambda head: bind(
                F.regexp_replace(head, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), lambda rest: parts(bare, head, rest)
            ),
        )

    return bind(F.substring_index(u, "#", 1), split)


def url_scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_host(u: Column) -> Column:
    return url_parts(u)["host"]


def without_params(path: Column) -> Column:
    """Path without the ';params' of its last segment."""
    return F.regexp_replace(path, r";[^/]*$", "")


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def canon_url(u: Column) -> Column:
    """Page key: scheme, 'www.', fragment and trailing slash do not matter."""

    def key(p: Column) -> Column:
        return bind(
            F.rtrim(without_params(p["path"]), F.lit("/")),
            lambda path: F.concat(
                without_www(F.lower(p["host"])),
                F.when(path == "", "/").otherwise(path),
                F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"])),
            ),
        )

    # never NULL, so joins on the key add no null check that would compute it twice
    return F.coalesce(bind(url_parts(F.coalesce(u, F.lit(""))), key), F.lit("/"))


def url_variants(u: Column) -> Column:
    """Stored forms that share one page key: scheme x www x trailing slash."""

    def forms(p: Column) -> Column:
        host, path = p["host"], F.rtrim(without_params(p["path"]), F.lit("/"))
        other = F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(F.concat(F.lit("www."), host))
        params = F.regexp_extract(p["path"], r";[^/]*$", 0)
        tail = F.concat(params, F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"])))
        return F.array_sort(
            F.array(
                *[
                    F.concat(F.lit(f"{scheme}://"), h, path, F.lit(slash), tail)
                    for scheme in ("https", "http")
                    for h in (host, other)
                    for slash in ("", "/")
                ]
            )
        )

    return bind(url_parts(u), forms)


def host_key(u: Column) -> Column:
    return without_www(F.lower(url_host(u)))


def same_domain(a: Column, b: Column) -> Column:
    """Case-sensitive; 'www.' is ignored wherever it occurs in the host."""
    return F.replace(url_host(a), F.lit("www."), F.lit("")) == F.replace(url_host(b), F.lit("www."), F.lit(""))


def robots_host(host: Column) -> Column:
    """Host form used by robots overrides: no case, port or 'www.'."""
    return without_www(F.substring_index(F.lower(strip(F.coalesce(host, F.lit("")))), ":", 1))


def site_host(u: Column) -> Column:
    """Host of a URL that may lack a scheme."""
    rest = F.regexp_replace(u, r"(?s)^.*?//", "")
    return without_www(F.lower(F.substring_index(rest, "/", 1)))


def is_blocked_host(u: Column) -> Column:
    listed = "|".join(b.replace(".", r"\.") for b in BLOCKED_HOSTS)
    return site_host(u).rlike(rf"(?:^|\.)(?:{listed})$|\.gov$")


def pick_campaign_url(text: Column) -> Column:
    """First http(s) URL of a free text, unless its host is blocked."""
    found = F.regexp_extract(text, r"(?U)https?://[^\s)>\]\"'`]+", 0)
    url = F.rtrim(found, F.lit(".,);'\"`"))
    return F.when((found != "") & ~is_blocked_host(url), url)


def website_from_wikitext(w: Column) -> Column:
    """Campaign site of an infobox 'website' field, never an office page."""
    field = F.regexp_extract(w, r"(?iU)\|\s*website\s*=\s*(.+)", 1)
    template = r"(?i)\{\{\s*url\s*\|\s*([^}|]+?)\s*(?:\|\s*([^}]*))?\}\}"
    bracket = r"\[(https?://[^\s\]]+)\s*([^\]]*)\]"

    def links(pattern: str) -> Column:
        return F.arrays_zip(
            F.regexp_extract_all(field, F.lit(pattern), F.lit(1)).alias("url"),
            F.regexp_extract_all(field, F.lit(pattern), F.lit(2)).alias("label"),
        )

    def site(c: Column) -> Column:
        return F.lower(F.substring_index(F.substring_index(strip(c["url"]), "//", -1), "/", 1))

    usable = F.filter(F.concat(links(template), links(bracket)), lambda c: ~site(c).endswith(".gov"))
    labelled = F.filter(usable, lambda c: F.contains(F.lower(c["label"]), F.lit("campaign")))
    pick = strip(F.coalesce(F.try_element_at(labelled, F.lit(1)), F.try_element_at(usable, F.lit(1)))["url"])
    return F.when(pick.startswith("http"), pick).otherwise(F.concat(F.lit("https://"), pick))


def normalize_url(u: Column) -> Column:
    """A pasted URL with a default scheme, or NULL when it has no usable host."""
    raw = strip(F.coalesce(u, F.lit("")))
    full = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))
    good = (raw != "") & url_scheme(full).isin("http", "https") & F.contains(url_host(full), F.lit("."))
    return F.when(good, full)


def _mentions(u: Column, fragments: tuple[str, ...]) -> Column:
    low = F.lower(u)
    return any_of([F.contains(low, F.lit(x)) for x in fragments])


def is_media(u: Column) -> Column:
    return _mentions(u, MEDIA_PATHS)


def is_boilerplate(u: Column) -> Column:
    return _mentions(u, BOILERPLATE_PATHS)


def is_pdf(u: Column, content_type: Column) -> Column:
    return F.lower(u).endswith(".pdf") | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf"))


def is_high_value(u: Column) -> Column:
    return _mentions(u, HIGH_VALUE_PATHS) | F.lower(u).endswith(".pdf")
