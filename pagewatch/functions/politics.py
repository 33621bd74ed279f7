"""Party, district, person-name and seat expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewatch.functions.text import strip, title_case, words

# Name suffixes, honorifics and state names.
NAME_SUFFIXES = ("JR", "SR", "II", "III", "IV", "V")
HONORIFICS = ("DR", "JR", "SR", "II", "III", "IV", "MR", "MRS", "MS", "ESQ", "COL", "HON", "REV")
STATE_NAMES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia",
    "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois",
    "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana",
    "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York",
    "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
    "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota",
    "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
    "AS": "American Samoa", "GU": "Guam", "MP": "Northern Mariana Islands", "PR": "Puerto Rico",
    "VI": "U.S. Virgin Islands",
}

# Order in which universe reasons are joined into a label.
REASON_ORDER = (
    "nominee", "contested_primary", "contested_general", "competitive_general", "incumbent", "funded_nominee",
)


def norm_party(c: Column) -> Column:
    code = F.upper(strip(F.coalesce(c, F.lit(""))))
    return (
        F.when(code.isin("DFL", "DNL", "D") | code.startswith("DEM"), "DEM")
        .when(code.startswith("REP") | code.startswith("GOP") | (code == "R"), "REP")
        .otherwise(F.substring(code, 1, 3))
    )


def norm_district(office: Column, district: Column) -> Column:
    """District used for nominee buckets: no prefix, no leading zeros, '0' when none."""
    tail = F.substring_index(F.upper(strip(F.coalesce(district.cast("string"), F.lit("")))), "-", -1)
    bare = F.regexp_replace(tail, "^0+", "")
    at_large = F.coalesce(office, F.lit("")).isin("S", "P") | tail.isin("AL", "ATLARGE") | (bare == "")
    return F.when(at_large, "0").otherwise(bare)


def office_of(candidate_id: Column) -> Column:
    letter = F.upper(F.substring(candidate_id, 1, 1))
    return F.when(letter.isin("H", "S", "P"), letter).otherwise(F.lit(""))


def pad_district(district: Column) -> Column:
    """Zero-pad to two digits; longer values stay whole."""
    d = strip(F.coalesce(district.cast("string"), F.lit("")))
    return F.when(F.length(d) < 2, F.lpad(d, 2, "0")).otherwise(d)


def person_surname(name: Column) -> Column:
    """Surname that ignores how suffixes are written."""
    last = F.upper(F.substring_index(F.coalesce(name, F.lit("")), ",", 1))
    tokens = F.transform(words(last), lambda t: F.trim(t, F.lit(".")))
    kept = F.filter(tokens, lambda t: ~t.isin(*NAME_SUFFIXES))
    return F.coalesce(F.try_element_at(kept, F.lit(1)), strip(last))


def id_matches_geo(candidate_id: Column, office: Column, state: Column, district: Column) -> Column:
    """Whether the id itself carries the row's state and district."""
    cid = F.coalesce(candidate_id, F.lit(""))
    seat = F.upper(F.coalesce(F.nullif(office, F.lit("")), F.substring(cid, 1, 1)))
    embedded = (F.upper(F.substring(cid, 3, 2)) == F.upper(F.coalesce(state, F.lit("")))) & (
        F.substring(cid, 5, 2) == pad_district(district)
    )
    return (seat != "P") & (F.length(cid) >= 6) & embedded


def fec_name_parts(name: Column) -> Column:
    """'LAST, FIRST ...' -> struct(first, last), honorific tokens dropped."""
    full = F.coalesce(name, F.lit(""))
    last = F.substring_index(full, ",", 1)
    given = full.substr(F.length(last) + 2, F.length(full) + 1)
    kept = F.filter(words(given), lambda t: ~F.upper(F.trim(t, F.lit("."))).isin(*HONORIFICS))
    first = F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit(""))
    return F.struct(title_case(first).alias("first"), title_case(strip(last)).alias("last"))


def feed_name_parts(name: Column) -> Column:
    """'First M. Last' or 'Last, First' -> struct(first, last)."""
    full = strip(F.coalesce(name, F.lit("")))
    before = F.substring_index(full, ",", 1)
    after = words(full.substr(F.length(before) + 2, F.length(full) + 1))
    tokens = F.filter(words(full), lambda t: F.trim(t, F.lit(".")) != "")
    tail = F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))
    is_suffix = F.upper(F.trim(tail, F.lit("."))).isin(*NAME_SUFFIXES) & (F.size(tokens) >= 2)
    last = F.when(is_suffix, F.try_element_at(tokens, F.lit(-2))).otherwise(tail)
    comma = F.contains(full, F.lit(","))
    first = F.coalesce(
        F.when(comma, F.try_element_at(after, F.lit(1))).otherwise(F.try_element_at(tokens, F.lit(1))), F.lit("")
    )
    return F.struct(
        title_case(first).alias("first"),
        title_case(F.when(comma, strip(before)).otherwise(last)).alias("last"),
    )


def names_match(fec_name: Column, feed_name: Column) -> Column:
    """Same last name, and first names agree on a prefix or an initial."""
    filed, called = fec_name_parts(fec_name), feed_name_parts(feed_name)
    a, b = F.lower(filed["first"]), F.lower(called["first"])
    same_last = (filed["last"] != "") & (F.lower(filed["last"]) == F.lower(called["last"]))
    first_agrees = (
        (a == "") | (b == "") | a.startswith(b) | b.startswith(a) | (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    )
    return same_last & first_agrees


def first_name_rank(fec_name: Column, feed_first: Column) -> Column:
    """3 exact, 2 prefix, 1 a first name is missing, 0 initial only."""
    a, b = F.lower(fec_name_parts(fec_name)["first"]), F.lower(F.coalesce(feed_first, F.lit("")))
    return (
        F.when((a == "") | (b == ""), 1)
        .when(a == b, 3)
        .when(a.startswith(b) | b.startswith(a), 2)
        .otherwise(0)
    )


def norm_rating(c: Column) -> Column:
    low = F.lower(strip(c))
    return (
        F.when(F.contains(low, F.lit("toss")), "Toss-up")
        .when(F.contains(low, F.lit("tilt")), "Tilt")
        .when(F.contains(low, F.lit("lean")), "Lean")
        .when(F.contains(low, F.lit("likely")), "Likely")
        .when(F.contains(low, F.lit("solid")) | F.contains(low, F.lit("safe")), "Solid")
        .otherwise(title_case(strip(c)))
    )


def reason_label(reasons: Column) -> Column:
    """Stable label of a set of reasons; the primary + competitive pair is 'both'."""
    ordered = F.filter(
        F.array(*[F.when(F.array_contains(reasons, r), F.lit(r)) for r in REASON_ORDER]), lambda r: r.isNotNull()
    )
    joined = F.array_join(ordered, "+")
    return F.when(joined == "contested_primary+competitive_general", "both").otherwise(joined)


def state_name(state: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATE_NAMES.items() for x in pair])
    code = F.coalesce(state, F.lit(""))
    return F.coalesce(F.try_element_at(table, code), code)


def _present(district: Column) -> Column:
    return F.coalesce(district, F.lit("")) != ""


def seat_code(office: Column, state: Column, district: Column) -> Column:
    base = F.concat(F.coalesce(office, F.lit("None")), F.lit("-"), F.coalesce(state, F.lit("None")))
    return F.when(_present(district), F.concat(base, F.lit("-"), district)).otherwise(base)


def seat_compact(office: Column, state: Column, district: Column) -> Column:
    st = F.coalesce(state, F.lit(""))
    return (
        F.when(office == "P", "President")
        .when(office == "S", F.concat(st, F.lit(" Senate")))
        .when(_present(district), F.concat(st, F.lit("-"), district))
        .otherwise(st)
    )


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(10, 20)
    suffix = (
        F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def race_phrase(office: Column, state: Column, district: Column) -> Column:
    name = state_name(state)
    number = F.coalesce(F.coalesce(district, F.lit("0")).try_cast("int"), F.lit(0))
    return (
        F.when(office == "P", "President")
        .when(office == "S", F.concat(F.lit("U.S. Senate, "), name))
        .when(number != 0, F.concat(name, F.lit("'s "), ordinal(number), F.lit(" District")))
        .otherwise(F.concat(name, F.lit(" at-large")))
    )


def heat_class(n: Column) -> Column:
    return F.when(n >= 7, "h4").when(n >= 4, "h3").when(n >= 2, "h2").when(n == 1, "h1").otherwise("")
