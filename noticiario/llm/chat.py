"""Chat records of many layouts as canonical turns, and their training format.

The nested field paths of a record, hashed, are its fingerprint. A registry maps the
fingerprints of known layouts to declarative mappings: which list holds the turns, which
fields hold role and text, or which fields are which turn. Columns of a DataFrame share
one fingerprint, known when the plan is made; JSON texts are fingerprinted each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, empty_if_null

START, END = "<|im_start|>", "<|im_end|>"
# Role names of other layouts. Fixed values of public chat formats.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "conv_id long, turn long, role string, text string"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``items``: the list with a record's turns; ``role`` and ``text`` are its fields.
    ``fields``: turns as ``(role, (field, ...))``; texts of several fields are joined by a
    blank line, empty ones left out. ``turn`` names the order of a table with a row per turn.
    """

    name: str
    items: str | None = None
    role: str | None = None
    text: str | None = None
    turn: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())

    @property
    def paths(self) -> frozenset[str]:
        if self.items:
            return frozenset({f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"})
        if self.turn:
            return frozenset({self.turn, self.role, self.text})
        return frozenset(f for _, names in self.fields for f in names)


MAPPINGS = (
    Mapping("messages", items="messages", role="role", text="content"),
    Mapping("conversations", items="conversations", role="from", text="value"),
    Mapping("rows", turn="turn", role="role", text="text"),
    Mapping("instruction_input", fields=(
        ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("system_prompt", fields=(
        ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


REGISTRY = {fingerprint(m.paths): m for m in MAPPINGS}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Leaf paths of a schema; ``[]`` stands for the elements of a list."""
    if isinstance(kind, T.StructType):
        return {
            p for f in kind.fields
            for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
        }
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def value_paths(value, at: str = "") -> set[str]:
    """Leaf paths of a parsed JSON value."""
    if isinstance(value, dict):
        return {
            p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else str(k))
        }
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def select_mapping(paths: set[str]) -> Mapping | None:
    """The mapping of a layout: by its whole fingerprint, else by the fingerprint of the
    paths that a mapping names, the one with most paths first (so extra fields do no harm)."""
    if found := REGISTRY.get(fingerprint(paths)):
        return found
    fitting = [m for m in MAPPINGS if REGISTRY.get(fingerprint(paths & m.paths)) is m]
    return max(fitting, key=lambda m: len(m.paths), default=None)


def _role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = empty_if_null(role)
    return F.coalesce(known[role], role)


def canonical_turns(records: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Turns of records with columns: ``conv_id, turn, role, text``.

    Null roles and texts are empty; a record whose list is null or empty has no turns.
    A turn of named fields that are all empty stays as an empty turn. An unknown layout is
    an error that names its paths. Without a ``conv_id`` column records are numbered.
    """
    paths = schema_paths(records.schema) - {conv_id}
    mapping = select_mapping(paths)
    if mapping is None:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    named = any(c == conv_id for c in records.columns)
    key = (F.col(f"`{conv_id}`") if named else F.monotonically_increasing_id()).cast("long")
    if mapping.turn:
        return records.select(
            key.alias("conv_id"), F.col(f"`{mapping.turn}`").cast("long").alias("turn"),
            _role(F.col(f"`{mapping.role}`")).alias("role"),
            empty_if_null(F.col(f"`{mapping.text}`")).alias("text"),
        )
    if mapping.items:
        listed = records.select(
            key.alias("conv_id"), F.posexplode(F.col(f"`{mapping.items}`")).alias("turn", "item")
        )
        return listed.select(
            "conv_id", F.col("turn").cast("long").alias("turn"),
            _role(F.col("item")[mapping.role]).alias("role"),
            empty_if_null(F.col("item")[mapping.text]).alias("text"),
        )
    turns = F.array(*[
        F.struct(F.lit(role).alias("role"), F.concat_ws(
            "\n\n", *[F.when(F.length(F.col(f"`{n}`")) > 0, F.col(f"`{n}`")) for n in names]
        ).alias("text")) for role, names in mapping.fields
    ])
    return records.select(key.alias("conv_id"), F.posexplode(turns).alias("turn", "item")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "item.role", "item.text"
    )


def _turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    def text(value) -> str:
        return value if isinstance(value, str) else "" if value is None else json.dumps(value)

    if mapping.items:
        return [
            (ROLES.get(role := text(x.get(mapping.role)), role), text(x.get(mapping.text)))
            for x in record[mapping.items] if isinstance(x, dict)
        ]
    if mapping.turn:
        role = text(record[mapping.role])
        return [(ROLES.get(role, role), text(record[mapping.text]))]
    return [
        (role, "\n\n".join(t for t in (text(record.get(n)) for n in names) if t))
        for role, names in mapping.fields
    ]


def turns_from_json(records: DataFrame, column: str, conv_id: str = "conv_id") -> DataFrame:
    """Turns of records kept as JSON texts, each converted by its own fingerprint.

    ``fingerprint`` is added. A record that is null, no JSON object, or of an unknown layout
    gives one row with null ``turn``, ``role`` and ``text``, so none is lost silently.
    """
    bounded_batches(records.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch["conv_id"], batch["record"], strict=True):
                try:
                    record = json.loads(raw) if raw else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    rows.append((key, None, None, None, None))
                    continue
                paths = value_paths(record) - {"conv_id"}
                name, mapping = fingerprint(paths), select_mapping(paths)
                if mapping is None:
                    rows.append((key, None, None, None, name))
                    continue
                first = record.get(mapping.turn, 0) if mapping.turn else 0
                rows += [
                    (key, (first or 0) + k, role, text, name)
                    for k, (role, text) in enumerate(_turns_of(record, mapping))
                ]
            out = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "fingerprint"])
            yield out.astype({"conv_id": "Int64", "turn": "Int64"})

    return records.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{column}`").alias("record")
    ).mapInPandas(run, f"{TURNS}, fingerprint string")


def escape(text: Column) -> Column:
    """No control string is left: ``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|`` and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    # a role ends at the line feed, so its own line feeds are written as a pair
    for a, b in (("%", "%25"), ("\n", "%0A")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return escape(role)


def _unescape_role(role: Column) -> Column:
    role = unescape(role)
    for a, b in (("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def format_turns(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """The training format, one row for each turn: ``conv_id, position, segment, start``,
    ``loss_from, loss_to``.

    The segments of a conversation, joined by ``position``, are its formatted text; places
    are code points in that text. The loss mask covers the texts of role ``learn``, without
    marks. Rows by turn (null last), then role and text; a null ``conv_id`` is a conversation.
    A conversation is never gathered in memory: its rows pass in order.
    """
    role, text = empty_if_null("role"), empty_if_null("text")
    placed = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")
    ).rowsBetween(Window.unboundedPreceding, 0)
    head = F.concat(F.lit(START), _escape_role(role), F.lit("\n"))
    body = escape(text)
    learned = F.col("role") == learn
    made = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumns({
        "segment": F.concat(head, body, F.lit(f"{END}\n")),
        "head": F.length(head), "body": F.length(body),
    }).withColumns({
        "position": F.count("*").over(placed) - 1,
        "start": F.sum(F.length("segment")).over(placed) - F.length("segment"),
    })
    start = F.col("start") + F.col("head")
    return made.select(
        "conv_id", "position", "segment", "start",
        F.when(learned, start).alias("loss_from"),
        F.when(learned, start + F.col("body")).alias("loss_to"),
    )


def parse_segments(formatted: DataFrame) -> DataFrame:
    """Turns and learned texts read from formatted segments."""
    pattern = r"(?s)\A<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n\z"
    learned = F.expr("substring(segment, int(loss_from - start + 1), int(loss_to - loss_from))")
    return formatted.select(
        "conv_id", "position",
        _unescape_role(F.regexp_extract("segment", pattern, 1)).alias("role"),
        unescape(F.regexp_extract("segment", pattern, 2)).alias("text"),
        unescape(learned).alias("learned"), F.length("segment").cast("long").alias("chars"),
    )


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    ]

    def frame(rows):
        return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})

    at, n = None, 0
    for batch in batches:
        done = []
        for key, role, text, learned, chars in zip(
            *(batch[c] for c in ("conv_id", "role", "text", "learned", "chars")), strict=True
        ):
            key = None if pd.isna(key) else int(key)
            if n and key != at:
                done.append((at, n, turns.hexdigest(), loss, learned_sum.hexdigest(), size))
                n = 0
            if not n:
                at, loss, size = key, 0, 0
                turns, learned_sum = hashlib.sha256(), hashlib.sha256()
            n, size = n + 1, size + int(chars)
            turns.update(f"{role}\n{text}\n".encode())
            if learned is not None:
                loss += len(learned)
                learned_sum.update(learned.encode())
        if done:
            yield frame(done)
    if n:
        yield frame([(at, n, turns.hexdigest(), loss, learned_sum.hexdigest(), size)])


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and checksums of each conversation, from its segments in order."""
    bounded_batches(formatted.sparkSession)
    return (
        parse_segments(formatted).repartition("conv_id")
        .sortWithinPartitions("conv_id", "position")
        .mapInPandas(_digests, "conv_id long, n_turns long, turns_sha256 string, "
                     "loss_chars long, loss_sha256 string, formatted_chars long")
    )
