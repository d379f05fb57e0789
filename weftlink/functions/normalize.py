"""Normalising names and addresses, tokens, squashed names and numbers, as Spark expressions.

Words are maximal runs of letters, digits and underscores in any script. Every rule is a column
expression, so a plan with them stays inside the JVM and below its exchanges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"\p{L}\p{N}_"
SEPARATORS = rf"[^{_WORD}]+"
BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Legal forms and generic words removed from names, in this order, as whole words.
LEGAL_WORDS = (
    "private limited", "pvt ltd", "pvt limited", "limited", "ltd", "corporation", "corp", "incorporated", "inc", "company", "co", "llc", "llp",
    "sarl", "sa", "sas", "gmbh", "ag", "enterprises?", "solutions?", "services?", "group", "holdings?",
)

# Address abbreviations and what they stand for, in this order.
ADDRESS_WORDS = (
    ("rd", "road"), ("st", "street"), ("ave", "avenue"), ("blvd", "boulevard"), ("dr", "drive"), ("ln", "lane"), ("ct", "court"), ("pl", "place"),
    ("hwy", "highway"), ("pkwy", "parkway"), ("apt", "apartment"), ("ste", "suite"), ("bldg", "building"), ("fl", "floor"), ("dist", "district"),
    ("nr", "near"), ("opp", "opposite"),
)

# Postal codes of US states and their names.
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii",
    "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan",
    "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york",
    "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota",
    "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming", "dc": "district of columbia",
}

# Strings deleted from squashed names wherever they stand, in this order.
SQUASH_STRONG = ("@", " ", "&", "and", ".com", ".org", ".net", ".co", "com", "org", "net", "www", "llc", "inc", "corp", "ltd", "lp", "pllc")
SQUASH_WEAK = (" ", "com", "org", "net", "www")


def whole_word(pattern: str) -> str:
    """The first letter is looked for before anything else, which most places fail cheaply."""
    return rf"(?={pattern[0]})(?<![{_WORD}])(?:{pattern.replace(' ', BLANK + '+')})(?![{_WORD}])"


def _text(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def _collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, BLANK + "+", " "))


def _replaced(x: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, x)


def normalize_name(name: Column | str) -> Column:
    """Lower case, "&" spelled out, dots, commas and hyphens as blanks, quotes dropped, legal words removed."""
    x = _replaced(F.lower(_text(name)), [("&", " and "), (".", " "), (",", " "), ("-", " "), ("'", ""), ('"', "")])
    return _collapsed(reduce(lambda c, w: F.regexp_replace(c, whole_word(w), ""), LEGAL_WORDS, x))


def normalize_address(address: Column | str) -> Column:
    """Lower case, dots, commas and hyphens as blanks, abbreviations expanded."""
    x = _replaced(F.lower(_text(address)), [(",", " "), (".", " "), ("-", " ")])
    # the expressions are dear on long texts; where only words and blanks are left, every word gets blanks of its own and plain replacing does
    general = _collapsed(reduce(lambda c, p: F.regexp_replace(c, whole_word(p[0]), p[1]), ADDRESS_WORDS, x))
    spaced = F.concat(F.lit(" "), F.replace(x, F.lit(" "), F.lit("  ")), F.lit(" "))
    plain = _replaced(spaced, [(f" {w} ", f" {full} ") for w, full in ADDRESS_WORDS])
    return F.when(x.rlike(rf"[^{_WORD} ]"), general).otherwise(F.array_join(F.array_remove(F.split(plain, " "), ""), " "))


def words(x: Column | str) -> Column:
    return F.array_remove(F.split(_text(x), BLANK + "+"), "")


def pieces(x: Column | str) -> Column:
    return F.array_remove(F.split(_text(x), SEPARATORS), "")


def name_tokens(name: Column | str) -> Column:
    """Words of more than one character, joined again."""
    return F.array_join(F.filter(words(name), lambda w: F.length(w) > 1), " ")


def blocking_tokens(name: Column | str, address: Column | str) -> Column:
    """Distinct words that are three or more of a-z and 0-9, or exactly two digits. A word with any other character gives none."""
    whole = F.lower(F.concat_ws(" ", _text(name), _text(address)))
    return F.array_distinct(F.filter(pieces(whole), lambda w: w.rlike("^([a-z0-9]{3,}|[0-9]{2})$")))


def folded(x: Column | str) -> Column:
    """Accents of Latin letters dropped: an option before ``blocking_tokens`` for languages that have them."""
    # Accented letters and their plain forms, place by place.
    return F.translate(F.lower(_text(x)), "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def squash(name: Column | str, strong: bool = True) -> Column:
    """One string without blanks, domain parts and (strong) legal forms: substrings go, not words."""
    x = _replaced(F.lower(_text(name)), [(s, "") for s in (SQUASH_STRONG if strong else SQUASH_WEAK)])
    return F.regexp_replace(x, "[^a-z0-9]", "") if strong else x


def numbers(address: Column | str, least: int = 1, most: int | None = None) -> Column:
    """All numbers of so many digits, in order."""
    return F.filter(pieces(address), lambda w: w.rlike(f"^[0-9]{{{least},{most or ''}}}$"))


def number_set(address: Column | str, least: int = 2, most: int = 6) -> Column:
    return F.array_distinct(numbers(address, least, most))


def first_postal_code(address: Column | str) -> Column:
    return F.get(numbers(address, 5, 6), F.lit(0))


def first_number(address: Column | str) -> Column:
    return F.get(numbers(address), F.lit(0))


def source_of(entity_id: Column | str) -> Column:
    c = F.col(entity_id) if isinstance(entity_id, str) else entity_id
    return F.when(c.startswith("S1-"), "S1").when(c.startswith("S2-"), "S2").otherwise("S3")


def expand_states(address: Column | str, states: dict[str, str] | None = None) -> Column:
    """Whole-word state codes by their names; an option that no other rule applies by default."""
    found = F.transform(words(address), lambda w: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (states or US_STATES).items() for x in p]), w), w))
    return F.array_join(found, " ")
