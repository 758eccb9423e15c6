"""Text cleaning and tokenising expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlog.constants import STOP_WORDS

# The characters each normaliser turns into a blank.
PAYLOAD_MARKS = "%/!@#$?,;:&*)(+="
PATH_MARKS = "/.,0123456789:;<=>?!@#$%^&_"
QUERY_MARKS = "/.0123456789,=:?!@#$%^&_"
AGENT_MARKS = "/. ,0123456789:;<=>?!@#$%^&_()"

LETTERS = ascii_letters + " "
URL_CHARS = ascii_letters + ".:,=&?$/"
WORD = r"[\p{L}\p{N}_]{2,}"


def blank_out(c: Column, marks: str) -> Column:
    """Each character of ``marks`` becomes one blank."""
    return F.translate(c, marks, " " * len(marks))


def only(c: Column, kept: str) -> Column:
    """The text without any other character than those kept.

    What is left when those are taken out is what is to be taken out; a search for the
    characters by pattern takes several times as long.
    """
    return F.call_function("translate", c, F.translate(c, kept, ""), F.lit(""))


def letters_only(c: Column) -> Column:
    """The text without any character that is no letter a to z, A to Z or blank."""
    return only(c, LETTERS)


def payload_words(c: Column) -> Column:
    """Dots become the word ``ddott``, marks become blanks, the rest keeps only letters."""
    return letters_only(blank_out(F.replace(c, F.lit("."), F.lit(" ddott ")), PAYLOAD_MARKS))


def url_chars(c: Column) -> Column:
    return only(c, URL_CHARS)


def host_keywords(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("."), F.lit(" "))


def path_keywords(c: Column) -> Column:
    return blank_out(F.lower(c), PATH_MARKS)


def query_keywords(c: Column) -> Column:
    return blank_out(F.lower(c), QUERY_MARKS)


def agent_keywords(c: Column) -> Column:
    return blank_out(F.lower(c), AGENT_MARKS)


def has_literal(c: Column, literal: str) -> Column:
    return F.contains(c, F.lit(literal))


def any_of(c: Column, terms: Sequence[str]) -> Column:
    """True where the lower-cased text holds a match of one of the patterns."""
    return F.lower(c).rlike("|".join(terms))


def after_bracket(c: Column) -> Column:
    """The label after its first closing bracket; labels without one are kept."""
    return F.regexp_replace(c, r"^[^)]*\)", "")


def words(c: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-cased words of two or more characters, stop words removed."""
    found = F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))
    if not stop_words:
        return found
    return F.filter(found, lambda w: ~w.isin(*stop_words))


def n_grams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams of the token array for n in low..high, shorter ones first."""

    if low == high == 1:
        return tokens

    def grams(t: Column, n: int) -> Column:
        if n == 1:
            return t
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1)))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda i: F.array_join(F.slice(t, i, n), " "),
        )

    # The tokens are bound to one variable, so the text is split once per row.
    return F.flatten(
        F.transform(
            F.array(tokens), lambda t: F.concat(*[grams(t, n) for n in range(low, high + 1)])
        )
    )


def counted_terms(c: Column, term: str, low: int = 1, high: int = 1) -> tuple[Column, Column]:
    """The n-grams of a text to be read out a row each, and which of the rows named ``term`` count.

    Stop words are no part of an n-gram and are dropped first; single words are tested in
    their own rows, which is faster than in the array.
    """
    if low == high == 1:
        return words(c, ()), ~F.col(term).isin(*STOP_WORDS)
    return n_grams(words(c), low, high), F.lit(True)
