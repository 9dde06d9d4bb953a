"""Slugs, keywords, hashes and relevance scores as native Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: they decide which tokens and scores a query returns -----------------------------

#: Whitespace as ECMAScript defines it, as the inside of a character class.
WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same without the line feed, for use inside one line of a multi-line pattern.
WS_INLINE = r"\t\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters as a string.
WS_CHARACTERS = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
#: What "." does not match.
LINE_ENDS = r"\n\r\x{2028}\x{2029}"
#: What it matches, as ranges: a negated class takes several times as long.
IN_LINE = r"\x00-\x09\x0B\x0C\x0E-\x{2027}\x{202A}-\x{10FFFF}"

STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is",
    "it", "as", "be", "was", "are", "this", "that", "not", "can", "will", "do", "if", "you", "your", "we",
    "our", "has", "have", "had", "been", "would", "could", "should", "may", "might", "shall", "its", "also",
    "into", "than", "then", "each", "which", "their", "them", "these", "those", "such", "when", "how", "what",
    "where", "who", "all", "any", "both", "no", "so", "up", "out", "about", "just", "more", "some", "other",
    "over",
]
PYTHON_STOP_WORDS = [
    *STOP_WORDS,
    "self", "cls", "none", "true", "false", "return", "returns",
]
QUERY_STOP_WORDS = [
    "the", "and", "for", "with", "from", "this", "that", "are", "was", "were", "been", "have", "has", "had",
]

TYPE_WEIGHTS = {"documentation": 1.0, "template-pattern": 0.9, "code-example": 0.8}
DEFAULT_TYPE_WEIGHT = 0.8
TITLE_SCORE = 10
EXCERPT_SCORE = 5
KEYWORD_SCORE = 3

EXCERPT_LENGTH = 200
#: Characters of the short form of a hash, which is for display only.
HASH_LENGTH = 16

# ---------------------------------------------------------------------------------------------------

#: One by one, as a class of single characters is a table; one of ranges takes twice as long.
_TOKEN = f"[{string.ascii_lowercase}{string.digits}-]+"
_ONE_CHARACTER_TOKENS = [""] + list(string.ascii_lowercase + string.digits + "-")


def js_trim(text: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(text, F.lit(WS_CHARACTERS))


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def slugify(heading: Column) -> Column:
    """``Getting Started (v2)`` -> ``getting-started-v2``; letters outside a-z are dropped."""
    # Every whitespace character becomes a blank first, which keeps the patterns short.
    spaced = F.translate(F.lower(heading), WS_CHARACTERS, " " * len(WS_CHARACTERS))
    # what stays is collected: replacing what a negated class matches takes ten times as long
    kept = F.array_join(F.regexp_extract_all(spaced, F.lit("[a-z0-9 -]+"), F.lit(0)), "")
    dashed = F.regexp_replace(kept, "[ -]+", "-")
    return F.regexp_replace(dashed, r"\A-|-\z", "")


def _tokens(text: Column) -> Column:
    """Lower-cased pieces between characters other than a-z, 0-9 and "-".

    All other characters separate, whether they are whitespace or would first be replaced by a blank,
    so one pass does both steps; it collects the tokens, as splitting at a negated class takes ten times as long.
    """
    return lower_tokens(F.lower(text))


def lower_tokens(text: Column) -> Column:
    """Tokens of a text in lower case, repeats included."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def keywords(text: Column) -> Column:
    """Distinct index keywords in order of first occurrence.

    ``array_except`` both removes the stop words and one-character tokens and keeps the
    first occurrence of the rest, without an interpreted lambda.
    """
    return F.array_except(_tokens(text), literal_array(STOP_WORDS + _ONE_CHARACTER_TOKENS))


def python_keywords(text: Column) -> Column:
    """As :func:`keywords` with more stop words; underscores separate as all other characters do."""
    return F.array_except(_tokens(text), literal_array(PYTHON_STOP_WORDS + _ONE_CHARACTER_TOKENS))


def query_keywords(text: Column) -> Column:
    """Distinct search terms: at least three characters and a shorter stop list."""
    words = F.array_except(_tokens(F.coalesce(text, F.lit(""))), literal_array(QUERY_STOP_WORDS))
    return F.filter(words, lambda w: F.length(w) > 2)


def keyword_union(*arrays: Column) -> Column:
    """Ordered set union."""
    return F.array_distinct(F.concat(*arrays))


def with_fallback(words: Column, fallback: Column) -> Column:
    """``words``, or a one-element array of ``fallback`` when there are none."""
    return F.when(F.size(words) > 0, words).otherwise(F.array(fallback))


def path_hash(path: Column) -> Column:
    """Whole SHA-256 of a content path: the identity of an entry."""
    return F.sha2(path, 256)


def content_hash(path: Column) -> Column:
    """Short form of :func:`path_hash` for display; two paths may share it."""
    return F.substring(path_hash(path), 1, HASH_LENGTH)


def excerpt(text: Column) -> Column:
    return F.substring(text, 1, EXCERPT_LENGTH)


def camel_split(name: Column) -> Column:
    return F.regexp_replace(name, "([A-Z])", " $1")


def type_weight(entry_type: Column) -> Column:
    weight = F.lit(DEFAULT_TYPE_WEIGHT)
    for name, value in TYPE_WEIGHTS.items():
        weight = F.when(entry_type == name, F.lit(value)).otherwise(weight)
    return weight


def round_half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("int")


def weighted_score(in_title: Column, in_excerpt: Column, in_keywords: Column, weight: Column) -> Column:
    """Score of a keyword, given where it occurs."""
    base = (
        F.when(in_title, TITLE_SCORE).otherwise(0)
        + F.when(in_excerpt, EXCERPT_SCORE).otherwise(0)
        + F.when(in_keywords, KEYWORD_SCORE).otherwise(0)
    )
    return round_half_up(base * weight)


#: Words up to which each is looked up in a text by itself; pieces of a text that are made at once.
_FEW, _PIECES = 2000, 100_000


def inside_tokens(words: Column, text: Column, tokens: Column, few: int = _FEW) -> Column:
    """Those of the distinct lower-case ``words``, none of which is a token, that occur in the lower-case ``text`` of these tokens.

    Up to ``few`` words are looked for one by one, which takes a pass over the text for each.  More are looked up among all pieces of
    the distinct tokens that have the length of such a word, so that the work follows the text's length and not its product with the
    number of words.  Words with characters that separate tokens are searched in the text itself.

    All three should be columns of their own: an expression is evaluated anew wherever a lambda names it.
    """

    def one_by_one(some: Column) -> Column:
        return F.filter(some, lambda w: F.contains(text, w))

    def pieces(length: Column) -> Column:
        longer = F.filter(F.array_distinct(tokens), lambda t: F.length(t) > length)
        starts = lambda t: F.sequence(F.lit(1), F.length(t) - length + 1)
        return F.flatten(F.transform(longer, lambda t: F.transform(starts(t), lambda at: F.substring(t, at, length))))

    of_letters = F.filter(words, lambda w: w.rlike("^[a-z0-9-]+$"))
    lengths = F.array_distinct(F.transform(of_letters, F.length))
    # all pieces at once where they are few, as of a title; else those of one length after the other
    at_once = F.length(text) * F.size(lengths) <= _PIECES
    inside = F.when(at_once, F.array_intersect(of_letters, F.flatten(F.transform(lengths, pieces)))).otherwise(
        F.flatten(F.transform(lengths, lambda n: F.array_intersect(of_letters, pieces(n))))
    )
    return (
        F.when(F.size(words) == 0, F.array().cast("array<string>"))
        .when(F.size(words) <= few, one_by_one(words))
        .otherwise(F.concat(inside, one_by_one(F.array_except(words, of_letters))))
    )


def relevance(keyword: Column, title: Column, excerpt_text: Column, in_keywords: Column, weight: Column) -> Column:
    """Weighted score of one keyword for one entry, ignoring case; ``in_keywords`` is a boolean."""
    word = F.lower(keyword)
    return weighted_score(
        F.lower(title).contains(word), F.lower(excerpt_text).contains(word), in_keywords, weight
    )


def csv_list(text: Column) -> Column:
    """``"a, b ,,c"`` -> ``[a, b, c]``."""
    parts = F.split(F.coalesce(text, F.lit("")), ",")
    return F.filter(F.transform(parts, js_trim), lambda p: p != "")


def byte_size(text: Column) -> Column:
    return F.octet_length(text)


def exceeds(text: Column, threshold: int = 50_000) -> Column:
    return byte_size(text) > threshold


def decode_base64(text: Column) -> Column:
    """Base64 (with line breaks) to UTF-8 text."""
    return F.decode(F.unbase64(F.regexp_replace(text, r"\s", "")), "UTF-8")


def placeholders(text: Column) -> Column:
    """Distinct ``$NAME$`` placeholders."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$([A-Z_][A-Z0-9_]*)\$"), 1))


def release_version(tag: Column, published_at: Column) -> Column:
    """``v1.2.3 (2024-06-15)``, or empty when either part is missing."""
    present = (F.coalesce(tag, F.lit("")) != "") & (F.coalesce(published_at, F.lit("")) != "")
    return F.when(present, F.concat(tag, F.lit(" ("), F.substring(published_at, 1, 10), F.lit(")"))).otherwise("")
