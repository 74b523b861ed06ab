"""Date parsers: string column in, UTC timestamp column (or null) out.

Every parser is a built-in expression that never raises on bad input, also under
ANSI mode: unparsable text becomes null.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticiario.functions.markup import let

# Month names as the sites write them.
MONTHS_ES = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6,
    "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11,
    "diciembre": 12,
}
MONTHS_ES_ABBR = {
    "ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6,
    "jul": 7, "ago": 8, "sep": 9, "oct": 10, "nov": 11, "dic": 12,
}
MONTHS_EN_ABBR = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
MONTHS_EN = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11,
    "december": 12,
}


# Separates the parts of a date while they travel as one string.
_SEP = "\u0001"

# White space as text stripping understands it.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _month(name: Column, months: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(months.items())])
    return F.try_element_at(table, name)


def _number(digits: Column) -> Column:
    return digits.try_cast("int")


def _integer(word: Column) -> Column:
    """Whole number of a word. Tested first, as a failing cast is slow."""
    return F.when(word.rlike(r"^[+-]?\d{1,9}$"), word.try_cast("int"))


def _strip(col: Column) -> Column:
    return F.btrim(col, F.lit(_BLANKS))


def _clean(col: Column) -> Column:
    """Lower case without surrounding white space of any kind."""
    return _strip(F.lower(col))


def _parts(text: Column, pattern: str, *groups: int) -> list[Column]:
    """The given groups of the first match, null where there is none.

    The match is found once: its groups are joined and split again, so all parts
    share one subexpression that is evaluated once per row. An unmatched text is
    left whole in front of the first separator, where no part is taken.
    """
    joined = "".join(f"{_SEP}${group}" for group in groups)
    found = F.split(F.regexp_replace(text, f"(?s)^.*?{pattern}.*$", joined), _SEP)
    return [F.get(found, F.lit(place)) for place in range(1, len(groups) + 1)]


def _day(year: Column, month: Column, day: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp(year, month, day, zero, zero, zero.cast("decimal(8,6)"))


def _named_date(
    text: Column, pattern: str, months: dict[str, int], year: int, month: int, day: int
) -> Column:
    """Date from the first match of ``pattern``; the numbers are group positions."""
    y, m, d = _parts(text, pattern, year, month, day)
    return _day(_number(y), _month(m, months), _number(d))


# ── Spanish text ─────────────────────────────────────────────────────────────

# The year 0000 is no date.
_YEAR = r"(?!0000)(\d{4})"
_MONTH_DAY_YEAR = rf"(?U)(\w+)\s+(\d{{1,2}}),?\s+{_YEAR}"
_DAY_DE_MONTH = rf"(?U)(\d{{1,2}})\s+de\s+(\w+)[,\s]+{_YEAR}"
_DAY_ABBR_YEAR = rf"(?U)(\d{{1,2}})\s+(\w{{3}})\s+{_YEAR}"


def es_month_day(col: Column) -> Column:
    """``marzo 3, 2026`` anywhere in the text; the comma is optional."""
    return _named_date(F.lower(col), _MONTH_DAY_YEAR, MONTHS_ES, year=3, month=1, day=2)


def es_day_de_month(col: Column) -> Column:
    """``martes 24 de febrero, 2026`` anywhere in the text."""
    return _named_date(F.lower(col), _DAY_DE_MONTH, MONTHS_ES, year=3, month=2, day=1)


def es_text(col: Column) -> Column:
    """``24 de febrero, 2026`` first, else ``febrero 24, 2026``.

    A first form that names a known month but an impossible day ends the search.
    """
    named = F.regexp_extract(F.lower(col), _DAY_DE_MONTH, 2)
    known = _month(named, MONTHS_ES).isNotNull()
    return F.when(known, es_day_de_month(col)).otherwise(es_month_day(col))


def es_abbr(col: Column) -> Column:
    """``03 mar 2026`` anywhere in the text, three-letter Spanish month."""
    return _named_date(F.lower(col), _DAY_ABBR_YEAR, MONTHS_ES_ABBR, year=3, month=2, day=1)


def _positional_parts(col: Column, allow_de: bool) -> tuple[Column, Column, Column]:
    text = _clean(col)
    if allow_de:
        text = F.replace(text, F.lit(" de "), F.lit(" "))
    parts = F.split(_strip(F.replace(text, F.lit(","), F.lit(""))), r"(?U)\s+")
    return (
        _integer(F.get(parts, F.lit(2))),
        _month(F.get(parts, F.lit(0)), MONTHS_ES),
        _integer(F.get(parts, F.lit(1))),
    )


def es_positional(col: Column, allow_de: bool = False) -> Column:
    """``agosto 13, 2024`` read by position; ``allow_de`` accepts ``agosto 13 de 2024``."""
    year, month, day = _positional_parts(col, allow_de)
    return F.when(year.between(1, 9999), _day(year, month, day))


def es_positional_text(col: Column) -> Column:
    """As :func:`es_positional` with ``allow_de``, as ``YYYY-MM-DD`` text.

    The day is not validated, so that text order equals the order the listing
    comparison uses for all inputs.
    """
    year, month, day = _positional_parts(col, allow_de=True)
    pad = lambda number, width: F.lpad(number.cast("string"), width, "0")
    return F.concat(
        pad(year, 4), F.lit("-"), pad(month, 2), F.lit("-"), pad(day, 2)
    )


def es_relative(col: Column, now: Column | str) -> Column:
    """``4 meses ago`` counted back from ``now``: year 365 days, month 30 days."""
    now = F.to_timestamp(F.lit(now)) if isinstance(now, str) else now
    parts = F.split(_clean(col), r"(?U)\s+")
    amount = _integer(F.get(parts, F.lit(0)))
    unit = F.get(parts, F.lit(1))
    minutes_per_unit = (
        F.when(unit.contains("año") | unit.contains("ano"), 365 * 1440)
        .when(unit.contains("mes"), 30 * 1440)
        .when(unit.contains("semana"), 7 * 1440)
        .when(unit.contains("día") | unit.contains("dia"), 1440)
        .when(unit.contains("hora"), 60)
        .when(unit.contains("minuto"), 1)
    )
    # Amounts whose result would leave the calendar give null.
    minutes = amount.cast("long") * minutes_per_unit
    back = F.when(F.abs(minutes) < 1900 * 365 * 1440, minutes)
    return now - F.make_dt_interval(mins=back.cast("int"))


# ── ISO ──────────────────────────────────────────────────────────────────────

_DATE = r"\d{4}-\d{2}-\d{2}"
_SHORT_DATE = r"\d{4}-\d{1,2}-\d{1,2}"
_CLOCK = r"\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?"
_SHORT_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)"


def _whole(text: Column, kept: str, tail: str = "") -> Column:
    """Timestamp of the part ``kept`` if the text is exactly ``kept`` and ``tail``."""
    local = F.regexp_extract(text, f"^(?!0000)({kept}){tail}$", 1)
    return F.try_to_timestamp(F.replace(local, F.lit(","), F.lit(".")))


def iso_date(col: Column) -> Column:
    """First ten characters as an ISO date."""
    return _whole(F.substring(col, 1, 10), _DATE)


def iso_datetime(col: Column) -> Column:
    """ISO date or date-time; an offset is dropped and the wall clock kept."""
    return _whole(col, f"{_DATE}(?:[T ]{_CLOCK})?", rf"\d*{_OFFSET}?")


def iso_datetime_short_offset(col: Column) -> Column:
    """As :func:`iso_datetime`, for the source whose times count only with no
    offset, ``Z`` or ``-0500``; with any other tail the day at midnight is taken.
    """
    text = _strip(col)
    return F.coalesce(
        _whole(F.substring(text, 1, 24), f"{_SHORT_DATE}T{_SHORT_CLOCK}", r"(?:Z|[+-]\d{4})"),
        _whole(F.substring(text, 1, 22), f"{_SHORT_DATE}T{_SHORT_CLOCK}"),
        _whole(F.substring(text, 1, 13), _SHORT_DATE),
        _whole(F.substring(text, 1, 10), _SHORT_DATE),
    )


# ── Any form ─────────────────────────────────────────────────────────────────

_SHAPE_CLOCK = r"(?:,? ?a? ?9{1,2}:99(?::99(?:\.9+)?)?(?: ?a)?(?: ?[+-]99:?99)?(?: \(?a\)?)?)?"
# Shapes of texts: every run of letters is one ``a``, every digit a ``9``.
_SHAPES = {
    "compact": r"^9{8}(?:[aA_ -]?9{6})?$",
    "day_first": rf"^(?:a[.,]{{0,2}} )?9{{1,2}}a?[ -]a[.,]?[ -]9999{_SHAPE_CLOCK}$",
    "month_first": rf"^(?:a[.,]{{0,2}} )?a\.? 9{{1,2}}a?,? 9999{_SHAPE_CLOCK}$",
    "clock_inside": r"^a a 9{1,2} 99:99:99(?: a)? 9999$",
    "slashes": rf"^9{{1,2}}([/.-])9{{1,2}}\1 ?9999{_SHAPE_CLOCK}$",
    "year_first": rf"^9999([/.])9{{1,2}}\1 ?9{{1,2}}{_SHAPE_CLOCK}$",
}


def _taken(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", group), F.lit(""))


def _clock_of(text: Column) -> tuple[Column, Column, Column, Column]:
    """Hour, minute, second, and minutes east of UTC of the clock in a text; 0 without."""
    clock = r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?: ?([ap])\.?m)?"
    hour, minute, second = (_number(_taken(text, clock, k)) for k in (1, 2, 3))
    half = F.lower(_taken(text, clock, 4))
    hour = F.when(half.isNotNull(), F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0)).otherwise(hour)
    zone = r":\d{2}(?:\.\d+)? ?([+-])(\d{2}):?(\d{2})"
    east = (_number(_taken(text, zone, 2)) * 60 + _number(_taken(text, zone, 3))) * F.when(
        _taken(text, zone) == "-", -1
    ).otherwise(1)
    zero = F.lit(0)
    return F.coalesce(hour, zero), F.coalesce(minute, zero), F.coalesce(second, zero), F.coalesce(east, zero)


def _at(text: Column, year: Column, month: Column, day: Column) -> Column:
    hour, minute, second, east = _clock_of(text)
    local = F.try_make_timestamp(year, month, day, hour, minute, second.cast("decimal(8,6)"))
    return local - F.make_dt_interval(mins=east)


def to_utc_naive(col: Column) -> Column:
    """Any usual form to a UTC timestamp: offsets are converted, failures are null.

    ISO texts and what Spark casts are read as before. Other texts are told apart by their
    shape, and one parser reads each: ``Tue, 05 Mar 2024 10:00:00 -0500``, ``5 March 2024``,
    ``March 5, 2024 3:15 PM``, ``Tue Mar  5 10:00:00 2024``, ``20240305`` with or without
    ``T101500``, ``05/03/2024``, ``2024/03/05``. Month names are English. Of two numbers
    before a year the first is the month, unless it is above 12. Named zones count as UTC.
    """
    plain = col.cast("string")
    # the common case stays in generated code; the others are worked out only where needed
    return F.when(plain.isNull() | plain.rlike(r"^\d{4}-"), F.try_to_timestamp(plain)).otherwise(
        let(F.regexp_replace(_strip(plain), r"\s+", " "), _any_form)
    )


def _any_form(text: Column) -> Column:
    shape = F.regexp_replace(F.regexp_replace(text, "[A-Za-z]+", "a"), "[0-9]", "9")
    name = F.lower(_taken(text, rf"(?<![a-z])((?:{'|'.join(MONTHS_EN_ABBR)})[a-z]*)"))
    known = name.isin(*MONTHS_EN, *MONTHS_EN_ABBR, "sept")
    month = F.when(known, _month(F.substring(name, 1, 3), MONTHS_EN_ABBR))
    digits = F.regexp_replace(text, "[^0-9]", "")

    def part(start: int, length: int) -> Column:
        return F.coalesce(_number(F.nullif(F.substring(digits, start, length), F.lit(""))), F.lit(0))

    one, two = (_number(_taken(text, r"^(\d{1,2})[/.-](\d{1,2})", k)) for k in (1, 2))
    swapped = one > 12
    year = _number(_taken(text, r"(?<![\d:+-])-?(\d{4})(?!\d)(?!:)"))
    day = _number(_taken(text, r"(?<![\d:])(\d{1,2})(?:st|nd|rd|th)?(?![\d:])"))
    forms = {
        "compact": F.try_make_timestamp(
            part(1, 4), part(5, 2), part(7, 2), part(9, 2), part(11, 2), part(13, 2).cast("decimal(8,6)")
        ),
        "day_first": _at(text, year, month, day),
        "month_first": _at(text, year, month, day),
        "clock_inside": _at(text, year, month, day),
        "slashes": _at(
            text, _number(_taken(text, r"^\d{1,2}[/.-]\d{1,2}[/.-] ?(\d{4})")),
            F.when(swapped, two).otherwise(one), F.when(swapped, one).otherwise(two),
        ),
        "year_first": _at(text, *[_number(_taken(text, r"^(\d{4})[/.](\d{1,2})[/.] ?(\d{1,2})", k)) for k in (1, 2, 3)]),
    }

    def chosen(shape: Column) -> Column:
        read = F.when(shape.startswith("9999-"), F.try_to_timestamp(text))
        for name, pattern in _SHAPES.items():
            read = read.when(shape.rlike(pattern), forms[name])
        return read.otherwise(F.try_to_timestamp(text))

    return let(shape, chosen)


# ── English and feed formats ─────────────────────────────────────────────────

# The whole text, hence a group that nothing may precede or follow.
_EN_MONTH_DAY = rf"(?U)(?<![\s\S])([\w&&[^\d_]]+)\s+(\d{{1,2}}),\s+{_YEAR}(?![\s\S])"


def en_abbr(col: Column) -> Column:
    """``Mar 02, 2026``; with a tail, the first twelve characters are tried."""
    text = _clean(col)
    read = lambda value: _named_date(
        value, _EN_MONTH_DAY, MONTHS_EN_ABBR, year=3, month=1, day=2
    )
    return F.coalesce(read(text), read(F.substring(text, 1, 12)))


def en_abbr_or_iso(col: Column) -> Column:
    """``Mar 02, 2026`` as the whole text, else an ISO date in front."""
    whole = _named_date(
        _clean(col), _EN_MONTH_DAY, MONTHS_EN_ABBR, year=3, month=1, day=2
    )
    return F.coalesce(whole, iso_date(col))


def es_as_en(col: Column) -> Column:
    """``ene 5, 2023``: Spanish abbreviations, English abbreviations or names."""
    months = {**MONTHS_EN, **MONTHS_EN_ABBR, **MONTHS_ES_ABBR}
    return _named_date(_clean(col), _EN_MONTH_DAY, months, year=3, month=1, day=2)


_RFC2822 = (
    r"(?<![\s\S])(?:[a-z]+,?\s+)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{2,4})\s+"
    r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?:\s*[+-]\d{4}|\s+.*)?(?![\s\S])"
)


def rfc2822(col: Column) -> Column:
    """``Tue, 05 Mar 2024 10:00:00 +0000``; the offset is dropped."""
    year, month, day, hour, minute, second = _parts(
        F.lower(_strip(col)), _RFC2822, 3, 2, 1, 4, 5, 6
    )
    # Two digits: 69 to 99 are of the last century.
    full = (
        F.when(F.length(year) > 2, year)
        .when(year >= "69", F.concat(F.lit("19"), year))
        .otherwise(F.concat(F.lit("20"), year))
    )
    seconds = F.coalesce(second.try_cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))
    return F.try_make_timestamp(
        _number(full), _month(month, MONTHS_EN_ABBR), _number(day),
        _number(hour), _number(minute), seconds,
    )


# ── Breadcrumbs ──────────────────────────────────────────────────────────────


def slash_crumb(col: Column) -> Column:
    """``› 2023/07/09`` anywhere in the text."""
    parts = _parts(col, rf"(?U)›\s*{_YEAR}/(\d{{2}})/(\d{{2}})", 1, 2, 3)
    return _day(*map(_number, parts))


def bullet_dmy(col: Column) -> Column:
    """``Judicial • 09/07/2023`` anywhere in the text, day first."""
    parts = _parts(col, rf"(?U)•\s*(\d{{2}})/(\d{{2}})/{_YEAR}", 3, 2, 1)
    return _day(*map(_number, parts))


# ── Choice by name ───────────────────────────────────────────────────────────

FORMATS = {
    "es_month_day": es_month_day,
    "es_day_de_month": es_day_de_month,
    "es_text": es_text,
    "es_abbr": es_abbr,
    "es_positional": es_positional,
    "es_positional_de": lambda col: es_positional(col, allow_de=True),
    "iso_date": iso_date,
    "iso_datetime": iso_datetime,
    "iso_datetime_short_offset": iso_datetime_short_offset,
    "to_utc_naive": to_utc_naive,
    "en_abbr": en_abbr,
    "en_abbr_or_iso": en_abbr_or_iso,
    "es_as_en": es_as_en,
    "rfc2822": rfc2822,
    "slash_crumb": slash_crumb,
    "bullet_dmy": bullet_dmy,
}


def parse_date(
    col: Column, formats: Iterable[str], now: Column | str | None = None
) -> Column:
    """First format of ``formats`` that reads the text wins.

    ``es_relative`` may be named too when ``now`` is given.
    """
    parsers = dict(FORMATS)
    if now is not None:
        parsers["es_relative"] = lambda value: es_relative(value, now)
    return F.coalesce(*[parsers[name](col) for name in formats])
