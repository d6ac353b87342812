"""Text functions as Column expressions: normal forms, slugs, transliteration, matching, keywords, proximity."""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKED = [chr(c) for c in [*range(0xC0, 0x180), *range(0x370, 0x400), *range(0x1E00, 0x2000)]]
#: Letters of Latin and Greek blocks whose decomposition is a plain letter with marks, and those letters.
_PLAIN = {
    c: base
    for c in _MARKED
    if len(base := "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) == 1 and base != c
}


def strip_marks(text: Column) -> Column:
    """Letters without their accents: composed ones by a fixed table, loose combining marks by pattern."""
    return F.regexp_replace(F.translate(text, "".join(_PLAIN), "".join(_PLAIN.values())), r"\p{M}+", "")


def fold(text: Column) -> Column:
    """Lower case without accents, final sigma as sigma."""
    return F.translate(F.lower(strip_marks(text)), "ς", "σ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_form(text: Column) -> Column:
    """Folded; ``&`` reads "and"; what is neither Latin or Greek letter nor digit is one space."""
    spoken = F.replace(fold(text), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spoken, "[^a-z0-9α-ω]+", " "))


def catalog_form(text: Column) -> Column:
    """Folded; what is neither letter nor digit of any script is one space."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def label_form(text: Column) -> Column:
    """Folded, white space to single spaces, punctuation kept."""
    return squeeze(strip_marks(F.lower(text)))


# Words that say nothing in the names of shops and firms.
SHOP_WORDS = ["greece", "hellas", "official", "eshop", "e-shop", "shop", "store", "online"]
FIRM_WORDS = ["ae", "sa", "ike", "oe", "ee", "ltd", "limited", "greece", "hellas"]


def without_words(text: Column, words: list[str]) -> Column:
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~w.isin(words) & (w != "")), " ")


def shop_name(text: Column) -> Column:
    """A shop's name for comparison."""
    spoken = F.replace(fold(text), F.lit("&"), F.lit(" and "))
    dropped = F.regexp_replace(spoken, rf"\b({'|'.join(SHOP_WORDS)})\b", " ")
    return squeeze(F.regexp_replace(dropped, "[^a-z0-9α-ω]+", " "))


def firm_name(text: Column) -> Column:
    """A firm's name for comparison, without its legal form."""
    return without_words(catalog_form(F.replace(text, F.lit("&amp;"), F.lit("&"))), FIRM_WORDS)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9α-ω]+", "-"), "^-+|-+$", "")


# Greek letter pairs and letters in Latin, in the order in which they apply.
GREEK_PAIRS = {"ου": "ou", "αι": "ai", "ει": "ei", "οι": "oi", "υι": "yi", "αυ": "av", "ευ": "ev", "μπ": "b", "ντ": "d", "γκ": "g", "γγ": "ng", "τσ": "ts", "τζ": "tz"}
GREEK_LONG = {"θ": "th", "ψ": "ps"}
GREEK_FROM, GREEK_TO = "αβγδεζηικλμνξοπρστυφχω", "avgdeziiklmnxoprstyfxo"


def latin_letters(form: Column) -> Column:
    """A text in search form in Latin letters."""
    steps = {**GREEK_PAIRS, **GREEK_LONG}
    spelled = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), steps.items(), form)
    return F.translate(spelled, GREEK_FROM, GREEK_TO)


def greek_to_latin(text: Column) -> Column:
    return latin_letters(search_form(text))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def one_less(word: Column) -> Column:
    """What is left of a word when one letter goes, for each of its letters; nothing of an empty one."""
    n = F.length(word)
    drop = lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, n))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), drop)).otherwise(F.array().cast("array<string>"))


def allowed_typos(word: Column, long_from: int, shortest: int) -> Column:
    """How many edits a word may be off: none below ``shortest`` letters, two from ``long_from`` on, else one."""
    n = F.length(word)
    return F.when(n < shortest, 0).when(n >= long_from, 2).otherwise(1)


def collated(text: Column, locale: str = "el") -> Column:
    """A text that compares as a locale's dictionaries sort (Greek before Latin letters in ``el``), for ordering."""
    return F.collate(text, locale)


# Words of three letters or more that don't tell a brand.
PLAIN_BRAND_WORDS = ["the", "and", "hotels", "hotel", "resorts", "resort"]


def brand_tokens(text: Column) -> Column:
    """The words of a shop's name that can tell the brand: three letters or more, none of the plain ones."""
    return F.filter(F.split(shop_name(text), " "), lambda w: (F.length(w) >= 3) & ~w.isin(PLAIN_BRAND_WORDS))


# What names, titles and logos of shops look like that were taken from the wrong place.
NAME_NUMBER = r"^\d+$"
NAME_PRODUCT = r"(?iu)\b(?:gift ?card|gift ?voucher|voucher|δωροκαρτ|δωροεπιταγ)\b"
NAME_URL = r"(?i)https?://|www\.|\.gr\b|\.com\b"
NAME_PARTS = r"\||::"
TITLE_URL = r"(?i)https?://|www\."
TITLE_SITE = r"(?i)\|\s*(?:home|official|eshop|e-shop|online)"
TITLE_SERIAL = r"(?iu)\b(?:gift ?card|δωροκαρτ)[-_ ]?\d{4,}\b"
TITLE_PARTS = r"::|\s{3,}"
LOGO_ICON = r"favicon|apple-touch-icon|mstile|browserconfig|site-icon"
LOGO_PLACEHOLDER = r"placeholder|dummy|default[-_ ]?logo|sample[-_ ]?logo|generated|mock[-_ ]?logo"


def _any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.rlike(text, F.lit(p)) for p in patterns])


def name_polluted(name: Column) -> Column:
    """Whether a shop's name is empty, a number, a product's name, a URL or several parts."""
    own = F.coalesce(name, F.lit(""))
    plain = catalog_form(own)
    return (F.length(plain) < 2) | F.rlike(plain, F.lit(NAME_NUMBER)) | _any_of(own, [NAME_PRODUCT, NAME_URL, NAME_PARTS])


def title_polluted(title: Column) -> Column:
    """Whether a title is empty, has a URL, a site's part, a serial number or several parts."""
    own = F.coalesce(title, F.lit(""))
    return (catalog_form(own) == "") | _any_of(own, [TITLE_URL, TITLE_SITE, TITLE_SERIAL, TITLE_PARTS])


def logo_problem(url: Column) -> Column:
    """MISSING, FAVICON_OR_SITE_ICON, PLACEHOLDER_OR_GENERATED, or null."""
    low = F.lower(F.coalesce(url, F.lit("")))
    icon, made = F.rlike(low, F.lit(LOGO_ICON)), F.rlike(low, F.lit(LOGO_PLACEHOLDER))
    return F.when(low == "", "MISSING").when(icon, "FAVICON_OR_SITE_ICON").when(made, "PLACEHOLDER_OR_GENERATED")


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits with adjacent swaps as one (each place edited once); null if either is null.

    It runs in Python: let F.levenshtein() (a swap is two edits there) leave only the pairs that can be near.
    """
    return pd.Series([None if x is None or y is None else _osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def _osa(a: str, b: str) -> int:
    before, row = None, np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, y in enumerate(b, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], before[j - 2] + 1)
        before, row = row, new
    return int(row[-1])


def match_strength(field: Column, query: Column) -> Column:
    """How well a query matches a field, both in search form: exact 1, prefix .88, inside .70, shared words up to .76, near .46 and more."""
    words, asked = tokens(field), tokens(query)
    shared = F.size(F.array_intersect(asked, words)) / F.greatest(F.size(asked), F.lit(1)) * 0.76
    allowed = allowed_typos(query, 7, 3)
    near = F.array_min(F.transform(words, lambda w: F.levenshtein(w, query)))
    fuzzy = F.when((allowed > 0) & (near <= allowed), 0.46 + (allowed - near) * 0.08).otherwise(0.0)
    return (
        F.when((query == "") | (field == ""), 0.0)
        .when(field == query, 1.0)
        .when(F.startswith(field, query), 0.88)
        .when(F.contains(field, query), 0.70)
        .otherwise(F.greatest(shared, fuzzy))
    )


def alias_forms(query: Column, groups: list[list[str]]) -> Column:
    """The query with every form of each synonym group of which it is or contains a form. Groups are a short list."""
    fired = [F.when(reduce(lambda a, b: a | b, [F.contains(query, F.lit(f)) for f in g]), F.array(*[F.lit(f) for f in g])) for g in groups]
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(F.array(query), *[F.coalesce(f, empty) for f in fired])))


def keywords(text: Column, words: list[str]) -> Column:
    """Which of these words a folded text contains, in their order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def near(text: Column, a: str, b: str, distance: int) -> Column:
    """The first stretch from pattern a to pattern b, in either order, with at most ``distance`` characters between; '' if none."""
    return F.regexp_extract(text, f"(?is)((?:{a}).{{0,{distance}}}?(?:{b})|(?:{b}).{{0,{distance}}}?(?:{a}))", 1)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?;])\s+|[\r\n]+"), lambda s: F.trim(s) != "")


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match of a pattern; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), group)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def first_number(text: Column, patterns: list[str]) -> Column:
    """The number in the first pattern (with one group of digits) that a text matches at all; null if none does."""
    found = [F.when(F.regexp_extract(text, p, 1) != "", F.regexp_extract(text, p, 1)) for p in patterns]
    return F.coalesce(*found).try_cast("bigint")


def set_tag(notes: Column, tag: str, value: Column) -> Column:
    """Notes, parts joined by ``|``, with ``[tag:value]`` as the last part and no other value of the tag."""
    clean = F.regexp_replace(F.coalesce(notes, F.lit("")), rf"\[{tag}:[A-Z_]+\]", "")
    clean = F.trim(F.regexp_replace(clean, r"\s*\|\s*\|+", " | "))
    clean = F.regexp_replace(clean, r"^\|\s*|\s*\|$", "")
    mark = F.concat(F.lit(f"[{tag}:"), value, F.lit("]"))
    return F.when(clean != "", F.concat(clean, F.lit(" | "), mark)).otherwise(mark)


def first_of_pipes(text: Column) -> Column:
    """The first item of an ``a | b`` list that isn't blank."""
    return F.get(F.filter(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))


def strip_tags(text: Column) -> Column:
    plain = F.regexp_replace(text, "<[^>]*>", " ")
    for name, char in {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}.items():
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return squeeze(plain)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by ``|``; a null part is empty, not left out."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def token_overlap(a: Column, b: Column, kind: str = "jaccard") -> Column:
    """Overlap of two arrays as sets, by the union (jaccard), the smaller (coefficient) or the larger (max); 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    n, m = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    whole = {"jaccard": n + m - both, "coefficient": F.least(n, m), "max": F.greatest(n, m)}[kind]
    return F.when(whole > 0, both / whole).otherwise(0.0)
