"""HTML as column expressions: elements with their own ends, references, furniture.

A page is split once at the tags of interest. What follows is work on the array of parts:
depths are running sums of openings and closings, and an opening is closed by the next tag
of its depth. Work grows with the page alone, whatever is left open in it; arrays are built
in blocks, since appending to one copies it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(values: Column) -> Column:
    """An array as arrays of ``_BLOCK`` values."""
    last = F.floor((F.size(values) - 1) / _BLOCK).cast("int")
    numbers = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: F.slice(values, k * _BLOCK + 1, F.lit(_BLOCK)))


def running_sum(values: Column) -> Column:
    """Sums of an array of integers up to each place."""
    none = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))

    def grown(state: Column, more: Column, entry: Column) -> Column:
        return F.struct(
            (state["sum"] + more).alias("sum"), F.concat(state["all"], F.array(entry)).alias("all")
        )

    def by_block(sums: Column) -> Column:
        before = F.aggregate(
            sums, none, lambda s, b: grown(s, F.element_at(b, -1), s["sum"]), lambda s: s["all"]
        )
        return let(before, lambda add: F.flatten(
            F.transform(sums, lambda b, k: F.transform(b, lambda x: x + F.get(add, k)))
        ))

    def direct(block: Column) -> Column:
        return F.aggregate(block, none, lambda s, x: grown(s, x, s["sum"] + x), lambda s: s["all"])

    return F.when(F.size(values) <= _BLOCK, direct(values)).otherwise(
        let(F.transform(_blocks(values), direct), by_block)
    )


def _named(names: Sequence[str] | str) -> str:
    alternatives = names if isinstance(names, str) else "|".join(names)
    return rf"</?(?:{alternatives})(?![\w-])"


def without(html: Column, names: Sequence[str], comments: bool = True) -> Column:
    """The page with the elements ``names``, and comments, as single blanks.

    An element ends at the first closing tag of its name. An opening that nothing closes
    stays as markup.
    """
    pattern = ("<!--|-->|" if comments else "") + _named(names)
    openings = [f"<{name}" for name in names] + ["<!--"] * comments
    closings = [f"</{name}" for name in names] + ["-->"] * comments
    known = F.array(*map(F.lit, openings))

    def closing_of(tag: Column) -> Column:
        return F.get(F.array(*map(F.lit, closings)), F.array_position(known, tag).cast("int") - 1)

    def after(text: Column, tag: Column) -> Column:
        return F.when(tag == "-->", F.substring(text, 4, 1 << 30)).otherwise(
            F.regexp_replace(text, "^[^>]*+>", "")
        )

    def step(state: Column, part: Column) -> Column:
        inside, out = state["inside"], state["out"]
        opens = (inside == "") & part["opens"]
        stays = (inside == "") & ~part["opens"]
        closes = (inside != "") & (part["tag"] == inside)
        added = (
            F.when(opens, F.lit(" ")).when(stays, part["text"])
            .when(closes, after(part["text"], part["tag"]))
        )
        return F.struct(
            F.when(opens, closing_of(part["tag"])).when(closes, "").otherwise(inside).alias("inside"),
            F.when(added.isNull(), out).otherwise(F.concat(out, F.array(added))).alias("out"),
        )

    def start(inside: Column) -> Column:
        return F.struct(inside.alias("inside"), F.array().cast("array<string>").alias("out"))

    def by_block(state: Column, block: Column) -> Column:
        return let(F.aggregate(block, start(state["inside"]), step), lambda done: F.struct(
            done["inside"].alias("inside"),
            F.concat(state["out"], F.array(F.array_join(done["out"], ""))).alias("out"),
        ))

    def tagged(parts: Column) -> Column:
        tags = F.transform(parts, lambda p: F.lower(F.regexp_extract(p, f"(?i)^(?:{pattern})", 0)))

        def marked(tags: Column) -> Column:
            back = F.reverse(tags)
            # places from the end, so a last closing lies behind an opening if it is nearer
            last = F.array(*[F.array_position(back, F.lit(c)) for c in closings])

            def one(text: Column, i: Column, last: Column) -> Column:
                tag = F.get(tags, i)
                place = F.get(last, F.array_position(known, tag).cast("int") - 1)
                opens = F.coalesce((place > 0) & (F.size(tags) - place > i), F.lit(False))
                return F.struct(tag.alias("tag"), opens.alias("opens"), text.alias("text"))

            return let(last, lambda last: F.transform(parts, lambda p, i: one(p, i, last)))

        return let(tags, marked)

    split = F.split(html, f"(?i)(?={pattern})")
    def joined(state: Column) -> Column:
        return F.array_join(state["out"], "")

    done = let(let(split, tagged), lambda parts: F.when(
        F.size(parts) <= _BLOCK, F.aggregate(parts, start(F.lit("")), step, joined)
    ).otherwise(F.aggregate(_blocks(parts), start(F.lit("")), by_block, joined)))
    return F.when(F.regexp_like(html, F.lit(f"(?i){pattern}")), done).otherwise(html)


def elements(
    html: Column, names: str, opening: str | None = None, around: str | None = None
) -> Column:
    """Array of elements in page order, each from its opening tag to its own closing one.

    ``names`` are tag names as alternatives of a pattern; ``opening`` is a pattern that the
    opening tag must match. With ``around`` an element must hold a match of it outside its
    inner elements of these names. An element that nothing closes ends where the next
    chosen one begins, or with the page.
    """
    tag = _named(names)

    def chosen(parts: Column, marks: Column) -> Column:
        """Places and ends of the wanted elements, from marks sorted by depth and place."""
        pairs = F.transform(marks, lambda m, k: F.struct(
            m["i"].alias("i"), m["step"].alias("step"), F.when(
                (F.get(marks, k + 1)["depth"] == m["depth"]) & (F.get(marks, k + 1)["step"] == -1),
                F.get(marks, k + 1)["i"],
            ).alias("end"),
        ))
        opens = F.filter(pairs, lambda p: p["step"] == 1)
        if opening is not None:
            opens = F.filter(
                opens, lambda p: F.regexp_like(F.get(parts, p["i"]), F.lit(f"^(?:{opening})"))
            )
        return F.array_sort(opens)

    def holding(parts: Column, depths: Column, steps: Column) -> Column:
        """Places of elements with a match of ``around`` in their own text."""
        texts = F.array_sort(F.transform(parts, lambda p, i: F.struct(
            F.get(depths, i).alias("depth"), i.alias("i"), (F.get(steps, i) == 1).alias("opens"),
            F.regexp_like(p, F.lit(around)).alias("holds"),
        )))
        none = F.struct(
            F.lit(-1).alias("at"), F.lit(-1).alias("depth"), F.array().cast("array<int>").alias("all")
        )

        def step(s: Column, t: Column) -> Column:
            at = F.when(t["opens"], t["i"]).when(s["depth"] == t["depth"], s["at"]).otherwise(-1)
            return F.struct(
                at.alias("at"), t["depth"].alias("depth"),
                F.when(t["holds"] & (at >= 0), F.array_append(s["all"], at)).otherwise(s["all"]).alias("all"),
            )

        return F.array_distinct(F.aggregate(texts, none, step, lambda s: s["all"]))

    def found(parts: Column, steps: Column, depths: Column) -> Column:
        marks = F.array_sort(F.filter(F.transform(parts, lambda p, i: F.struct(
            (F.get(depths, i) + F.when(F.get(steps, i) == -1, 1).otherwise(0)).alias("depth"),
            i.alias("i"), F.get(steps, i).alias("step"),
        )), lambda m: m["step"] != 0))

        def cut(places: Column) -> Column:
            return F.transform(places, lambda e, k: F.array_join(F.slice(
                parts, e["i"] + 1,
                F.coalesce(e["end"], F.get(places, k + 1)["i"], F.size(parts)) - e["i"],
            ), ""))

        def held(places: Column) -> Column:
            if around is None:
                return let(places, cut)
            return let(holding(parts, depths, steps), lambda own: let(
                F.filter(places, lambda e: F.array_contains(own, e["i"])), cut
            ))

        return let(marks, lambda m: held(chosen(parts, m)))

    def stepped(parts: Column) -> Column:
        steps = F.transform(parts, lambda p, i: F.when(F.startswith(p, F.lit("</")) & (
            (i > 0) | F.regexp_like(p, F.lit(f"(?i)^{tag}"))), -1
        ).when((i > 0) | F.regexp_like(p, F.lit(f"(?i)^{tag}")), 1).otherwise(0))
        return let(steps, lambda s: let(running_sum(s), lambda d: found(parts, s, d)))

    return let(F.split(html, f"(?i)(?={tag})"), stepped)


# ── References ───────────────────────────────────────────────────────────────

# What browsers read for the numbers of the Windows code page.
_WINDOWS = {
    str(code): bytes([code]).decode("cp1252", "ignore") or chr(code) for code in range(0x80, 0xA0)
}
_REFERENCE = r"^(#[0-9]{1,9};?|#[xX][0-9A-Fa-f]{1,8};?|[A-Za-z][A-Za-z0-9]{1,31};?)"


_SLOTS = 4096


def _table(pairs: dict[str, str]) -> Column:
    """A map literal, however large: the optimizer reads it from one string."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _looked_up(pairs: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a large map: maps are searched from end to end, so it is cut in slots."""
    slots: list[dict[str, str]] = [{} for _ in range(_SLOTS)]
    for name, value in pairs.items():
        slots[crc32(name.encode()) % _SLOTS][name] = value
    table = F.from_json(F.lit(json.dumps(slots)), "array<map<string,string>>")
    slot = (F.crc32(key.cast("binary")) % _SLOTS).cast("int")
    return F.try_element_at(F.get(table, slot), key)


def unescape(col: Column) -> Column:
    """Decode all named, decimal and hexadecimal character references, each once.

    Names are those of HTML 5, the old ones also without semicolon where no letter or digit
    follows. Two halves of a surrogate pair side by side are one character; alone, and
    numbers beyond Unicode, they give the replacement character. Unknown names stay.
    """

    def number(name: Column) -> Column:
        hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
        digits = F.rtrim(name, F.lit(";"))
        return F.when(~F.startswith(name, F.lit("#")), None).when(
            hexadecimal, F.conv(F.substring(digits, 3, 8), 16, 10).try_cast("long")
        ).otherwise(F.substring(digits, 2, 9).try_cast("long"))

    def character(code: Column) -> Column:
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        digits = F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD))), 8, "0")
        windows = F.when(code.between(0x80, 0x9F), F.try_element_at(_table(_WINDOWS), code.cast("string")))
        return F.coalesce(windows, F.decode(F.unhex(digits), "UTF-32"))

    def high(r: Column, code: Column) -> Column:
        return F.coalesce(code.between(0xD800, 0xDBFF) & (r["name"] == r["text"]), F.lit(False))

    def low(code: Column) -> Column:
        return F.coalesce(code.between(0xDC00, 0xDFFF), F.lit(False))

    def decoded(refs: Column) -> Column:
        def numbered(r: Column, k: Column, code: Column) -> Column:
            after, before = number(F.get(refs, k + 1)["name"]), F.get(refs, k - 1)
            pair = (code - 0xD800) * 0x400 + (after - 0xDC00) + 0x10000
            return (
                F.when(high(r, code) & low(after), character(pair))
                .when(low(code) & high(before, number(before["name"])), "").otherwise(character(code))
            )

        def one(r: Column, k: Column) -> Column:
            # most references are names, and need none of the work on numbers
            value = F.when(
                F.startswith(r["name"], F.lit("#")), let(number(r["name"]), lambda code: numbered(r, k, code))
            ).otherwise(_looked_up(html5, r["name"]))
            rest = F.substring(r["text"], F.length(r["name"]) + 1, F.lit(1 << 30))
            return F.when(k == 0, r["text"]).otherwise(F.coalesce(
                F.when(r["name"] != "", F.concat(value, rest)), F.concat(F.lit("&"), r["text"])
            ))

        return F.array_join(F.transform(refs, one), "")

    def read(parts: Column) -> Column:
        return F.transform(parts, lambda p, k: F.struct(
            p.alias("text"),
            F.when(k > 0, F.regexp_extract(p, _REFERENCE, 1)).otherwise("").alias("name"),
        ))

    done = let(let(F.split(col, "&"), read), decoded)
    return F.when(F.contains(col, F.lit("&")), done).otherwise(col)
