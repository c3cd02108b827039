"""Text functions as Spark expressions: no Python runs.

`fold` is exact for texts of characters up to U+024F (Latin with its accents); `refloom.functions.udfs.exact_fold` is exact for every
text and takes only the others to Python. Java's character classes are ASCII unless a pattern starts with (?U), so all of them do.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions import strings as S


def _latin() -> tuple[str, str, dict[str, str]]:
    """What the characters up to U+024F are without accents and case, by Unicode's decompositions: one for one, and those that become several."""
    one, several = {}, {}
    for code in range(0xA0, 0x250):
        char = chr(code)
        if char in S.TRANSLITERATED:
            continue
        bare = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).casefold()
        bare = "".join(f" {S.GREEK[S.GREEK_LETTERS.index(c)]} " if c in S.GREEK_LETTERS else c for c in bare)
        if bare != char:
            # Capitals that become several are lower-cased first.
            if len(bare) == 1:
                one[char] = bare
            elif char == char.lower():
                several[char] = bare
    return "".join(one), "".join(one.values()), several


_FROM, _TO, _SEVERAL = _latin()


def resolve_latex(text: Column) -> Column:
    text = F.regexp_replace(text, "(?i)" + S.LATEX_GREEK, " $1 ")
    text = F.regexp_replace(text, S.LATEX_ACCENT, "$1")
    text = F.regexp_replace(text, S.LATEX_COMMAND, " ")
    return F.translate(F.regexp_replace(text, "[{}]", ""), "$", " ")


def fold(text: Column) -> Column:
    for letter, by in S.TRANSLITERATED.items():
        text = F.replace(text, F.lit(letter), F.lit(by))
    # LaTeX is rare: a text without a backslash, brace or dollar sign skips seven and twenty patterns.
    text = F.when(text.rlike(r"[\\{}$]"), resolve_latex(text)).otherwise(text)
    text = F.lower(F.translate(text, _FROM, _TO))
    spelt = text
    for char, by in _SEVERAL.items():
        spelt = F.replace(spelt, F.lit(char), F.lit(by))
    text = F.when(text.rlike("[" + "".join(_SEVERAL) + "]"), spelt).otherwise(text)
    text = F.replace(text, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, r"(?U)[\W_]+", " "))


def is_wide(text: Column) -> Column:
    """Whether a text has characters that `fold` doesn't know: beyond U+024F, marks that stand alone among them."""
    return text.rlike("[^\u0000-\u024F]")


def words(folded: Column) -> Column:
    return F.array_remove(F.split(folded, " "), "")


def tokens(text: Column, drop_stopwords: bool = False) -> Column:
    out = words(fold(text))
    return F.filter(out, lambda w: ~w.isin(*S.STOPWORDS)) if drop_stopwords else out


def canonical_word(word: Column) -> Column:
    """Numbers as digits, American spelling; for one folded word."""
    numerals = F.create_map(*(F.lit(x) for pair in S.NUMERALS.items() for x in pair))
    spelt = word
    for pattern, by in S.SPELLING:
        spelt = F.regexp_replace(spelt, "(?U)" + pattern, by.replace("\\", "$"))
    return F.coalesce(F.try_element_at(numerals, word), F.when(F.length(word) >= S.MIN_SPELLING_LETTERS, spelt).otherwise(word))


def main_title(title: Column) -> Column:
    return F.get(F.split(F.trim(title), "(?U)" + S.SUBTITLE, 2), F.lit(0))


def surname_key(name: Column) -> Column:
    return F.substring_index(fold(name), " ", -1)


def letters(text: Column) -> Column:
    """How many letters a text has."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def venue_tokens(venue: Column) -> Column:
    return F.filter(words(fold(venue)), lambda w: ~w.isin(*S.STOPWORDS, *S.GENERIC_VENUE_WORDS))


def same_abbreviated(a: Column, b: Column) -> Column:
    return (a == b) | ((F.length(a) >= 3) & (F.startswith(a, b) | F.startswith(b, a)))
