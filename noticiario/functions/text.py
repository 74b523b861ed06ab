"""Text expressions: territories, mention scores, slugs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of a mention in the title, default threshold.
TITLE_BONUS = 2
DEFAULT_MIN_MENTIONS = 3


def territory(term: Column) -> Column:
    """Search term without its last word, lower-cased, single blanks between words."""
    words = F.filter(F.split(term, r"(?U)\s+"), lambda word: word != "")
    kept = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.lower(F.array_join(kept, " "))


def count_mentions(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of ``needle``; an empty needle fits length + 1 times.

    The needle is searched literally, in one pass over the text.
    """
    end = "\\E"
    literal = F.concat(
        F.lit("\\Q"), F.replace(needle, F.lit(end), F.lit(end + "\\\\E\\Q")), F.lit(end)
    )
    return (
        F.when(needle == "", F.length(text) + 1)
        .otherwise(F.regexp_count(text, literal))
        .cast("long")
    )


def mention_score(text: Column, title: Column, place: Column) -> Column:
    """Mentions in the text plus a bonus when the title names the place.

    Comparison ignores case but keeps accents, and matches inside words.
    """
    body = F.lower(F.coalesce(text, F.lit("")))
    head = F.lower(F.coalesce(title, F.lit("")))
    bonus = F.when(F.contains(head, place), TITLE_BONUS).otherwise(0)
    return count_mentions(body, place) + bonus


def is_blank(col: Column) -> Column:
    """Null, empty or only white space of any kind."""
    return col.isNull() | col.rlike(r"(?U)^\s*$")


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and their plain letters in the same order."""
    blocks = [range(0x00DF, 0x0250), range(0x1E00, 0x1F00)]
    pairs = [
        (chr(code), unicodedata.normalize("NFD", chr(code))[0])
        for block in blocks
        for code in block
        if chr(code).islower()
    ]
    pairs = [(marked, plain) for marked, plain in pairs if plain.isascii()]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def slug(name: Column) -> Column:
    """``San Andrés y Providencia`` -> ``san_andres_y_providencia``."""
    plain = F.translate(F.lower(name), *_accents())
    ascii_only = F.regexp_replace(plain, r"[^\x00-\x7F]", "")
    return F.replace(ascii_only, F.lit(" "), F.lit("_"))
