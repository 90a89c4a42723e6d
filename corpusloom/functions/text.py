"""Text columns: trimming, tokens, line previews, keyword counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every code point that Unicode and the ASCII separators count as blank.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim all Unicode blanks, not only the space that SQL ``trim`` knows."""
    return F.trim(text, F.lit(WHITESPACE))


def has_text(text: Column) -> Column:
    """True when something is left after :func:`strip`."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


_WORD = r"[\p{L}\p{N}_&&[^\p{IsHan}]]"
_HAN = r"\p{IsHan}"
# Where Han characters may begin; a range is far quicker to look for than a script.
_FAR = r"[\x{2E80}-\x{10FFFF}]"
# At each position: two Han characters, a whole other run from its start, or a lone Han one.
_MIXED = (rf"(?=({_HAN}{{2}}|(?<!{_WORD}){_WORD}+|(?<!{_HAN}){_HAN}(?!{_HAN})))")


def tokenize(text: Column) -> Column:
    """Lower-cased letter/digit runs; a run of Han characters becomes its bigrams.

    Han text has no blanks between words, so neighbouring characters stand in for words.
    Rows without Han characters take the plain regular expression.
    """
    lowered = F.lower(text)
    plain = F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    mixed = F.regexp_extract_all(lowered, F.lit(_MIXED), F.lit(1))
    return F.when(lowered.rlike(_FAR) & lowered.rlike(_HAN), mixed).otherwise(plain)


def count_occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping, case-insensitive occurrences of ``needle``."""
    return count_exact(F.lower(text), F.lower(needle))


def count_exact(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of ``needle``, case as given."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (gone / F.length(needle)).cast("long")).otherwise(F.lit(0))
