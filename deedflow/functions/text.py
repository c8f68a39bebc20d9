"""Scalar text functions, Column to Column. Patterns use (?U): white space and words are Unicode's."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that advise or foretell a legal outcome, and the neutral marker put in their place.
FORBIDDEN = (
    "you should sign",
    "you should not sign",
    "you must sign",
    "you should sue",
    "you must sue",
    "this is illegal",
    "this clause is illegal",
    "this provision is illegal",
    "this is unenforceable",
    "this is enforceable",
    "this clause is enforceable",
    "you will win",
    "you will lose",
    "you have a strong case",
    "you have no case",
    "the other party violated the law",
    "the employer violated the law",
    "the landlord violated the law",
)
NEUTRAL = "[Requires specific factual and jurisdiction-specific legal review]"
#: Tokens that do not tell parties apart.
PARTY_STOP_WORDS = ("inc", "llc", "corp", "corporation", "ltd", "limited", "co", "company", "the", "and", "party", "tenant", "landlord", "borrower", "lender")


ASSERTION = r"(?iU)\b(?:" + "|".join(FORBIDDEN) + r")\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


#: The characters that Unicode counts as white space, which is what ``\\s`` matches with (?U).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def folded(c: Column) -> Column:
    """A text in which ``contains`` finds every lower-case ASCII phrase that a pattern with (?iU) could match (Turkish i and long s too; lower case knows the Kelvin sign)."""
    plain = c
    for odd, letter in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        plain = F.replace(plain, F.lit(odd), F.lit(letter))
    return F.lower(F.when(F.octet_length(c) == F.length(c), c).otherwise(plain))


def contains_any(c: Column, phrases: Iterable[str]) -> Column:
    return reduce(or_, [F.contains(c, F.lit(p)) for p in phrases])


def may_hold(c: Column, phrases: Iterable[str]) -> Column:
    """A pattern with (?iU) could match one of the lower-case ASCII phrases in the text; the text is folded once."""
    return F.exists(F.array(folded(c)), lambda low: contains_any(low, phrases))


def any_word(phrases: str) -> str:
    """Pattern of whole phrases (``a|b``, capturing); their first letters are tried before the costlier word boundary."""
    return rf"(?=[{''.join(sorted({p[0] for p in phrases.split('|')}))}])\b({phrases})"


def normalize_text(c: Column) -> Column:
    """Line ends to LF, no control characters but tab and LF, at most one blank line in a row, stripped; null gives empty."""
    lf = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    clean = F.regexp_replace(lf, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    return strip(F.regexp_replace(clean, r"\n{3,}", "\n\n"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def match_key(c: Column) -> Column:
    """Stripped, lower-cased, white space collapsed."""
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")


def day_count(c: Column) -> Column:
    """First count of days named in a text, null if none."""
    found = F.regexp_extract(c, r"(?iU)(\d+)\s+(?:business\s+|calendar\s+)?days?", 1)
    return F.nullif(found, F.lit("")).try_cast("int")


def party_key(c: Column) -> Column:
    """Lower-cased name without punctuation."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)[^\w\s]", "")


def party_tokens(c: Column) -> Column:
    """Distinct tokens of a name longer than one letter, without stop words unless nothing else is left."""
    spaced = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}\s]", " "))
    tokens = F.array_distinct(F.filter(F.split(spaced, r"(?U)\s+"), lambda t: F.length(t) > 1))
    telling = F.array_except(tokens, F.array(*[F.lit(w) for w in PARTY_STOP_WORDS]))
    return F.when(F.size(telling) > 0, telling).otherwise(tokens)


def has_forbidden(c: Column) -> Column:
    return c.rlike(ASSERTION)


def neutral(c: Column) -> Column:
    return F.regexp_replace(c, ASSERTION, NEUTRAL)


def clean_filename(c: Column) -> Column:
    """A safe PDF file name: base name only, no control characters or leading dots, odd characters to underscores, 255 at most."""
    base = F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F]", ""), r"([^/\\]*)$", 1)
    plain = F.regexp_replace(strip(F.regexp_replace(strip(base), r"^[./\\]+", "")), r"[^A-Za-z0-9._\- ]", "_")
    reserved = plain.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^.]*)?$") | (plain == "")
    named = F.when(reserved, F.lit("document.pdf")).otherwise(plain)
    extension = F.regexp_extract(named, r"(\.[^.]*)$", 1)
    return F.when(F.length(named) <= 255, named).otherwise(F.concat(F.left(named, F.lit(255) - F.length(extension)), extension))


def bounded(c: Column, default: str, most: int) -> Column:
    """Stripped text cut at ``most`` characters; blank gives the default."""
    return F.left(F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default)), F.lit(most))


def token_estimate(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(chars / F.lit(4.0)).cast("int"))


def highlight(text: Column, quote: Column) -> Column:
    """(before, match, after) of the first place of a quote, letter case ignored; everything in before if it is not there."""
    at = F.instr(F.lower(text), F.lower(quote))
    n = F.length(quote)
    return F.when(
        (at > 0) & (n > 0),
        F.struct(text.substr(F.lit(1), at - 1).alias("before"), text.substr(at, n).alias("match"), text.substr(at + n, F.length(text)).alias("after")),
    ).otherwise(F.struct(text.alias("before"), F.lit("").alias("match"), F.lit("").alias("after")))


def sentences(c: Column) -> Column:
    """Sentences of a text, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def found(c: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null where there is none."""
    return F.nullif(strip(F.regexp_extract(c, pattern, group)), F.lit(""))
