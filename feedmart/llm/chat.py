"""Chat formatting: schema fingerprints select mappings that turn records into canonical turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Mapping:
    """How a layout of records becomes turns.

    ``fields`` lists (role, path) of single turns; ``turns`` is the path of a
    list, or empty for the record itself, whose items hold ``role`` and
    ``text``. ``optional`` paths may be absent. ``roles`` renames roles.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    turns: str | None = None
    role: str = "role"
    text: str = "text"
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        if self.turns is None:
            return [p for _, p in self.fields]
        return [f"{self.turns}[].{x}" if self.turns else x for x in (self.role, self.text)]


#: Layouts that are known from the start; ``format_chats`` takes others.
MAPPINGS = (
    Mapping("turn rows", turns=""),
    Mapping("turn rows, content", turns="", text="content"),
    Mapping("messages", turns="messages", text="content"),
    Mapping("conversations", turns="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant", "system": "system"}),
    Mapping("prompt and completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("question and answer", fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
)


#: Fields that say nothing about turns, at any depth; they are left out of a record's paths.
IGNORED = frozenset({"id", "conv_id", "source", "name", "weight", "metadata", "meta", "timestamp", "lang", "tags"})
#: A record nested deeper than this is of no known layout.
DEEPEST = 64


def field_paths(value: Any, ignored: frozenset[str] = IGNORED) -> set[str]:
    """Paths of the leaves of a record: names joined by dots, ``[]`` for list items. ``ignored`` fields, empty lists and empty objects have none."""
    paths, todo = set(), [(value, "", 0)]
    while todo:
        x, at, depth = todo.pop()
        if depth > DEEPEST:
            raise ValueError("nested too deeply")
        if isinstance(x, dict):
            todo += [(v, f"{at}.{k}" if at else k, depth + 1) for k, v in x.items() if k not in ignored]
        elif isinstance(x, list):
            todo += [(v, f"{at}[]", depth + 1) for v in x]
        else:
            paths.add(at)
    return paths


def clean(text: str) -> str:
    """``text`` with lone surrogates, which no UTF-8 holds, replaced by U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def schema_fingerprint(paths: set[str]) -> str:
    """16 hex digits of the SHA-256 of the sorted paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "replace")).hexdigest()[:16]


def registry(mappings: tuple[Mapping, ...]) -> dict[str, Mapping]:
    """Fingerprint to mapping, for every choice of the optional paths."""
    out: dict[str, Mapping] = {}
    for m in mappings:
        needed = {p for p in m.paths() if p not in m.optional}
        for n in range(len(m.optional) + 1):
            for extra in combinations(m.optional, n):
                out.setdefault(schema_fingerprint(needed | {*extra}), m)
    return out


def _text(value: Any) -> str:
    return "" if value is None else clean(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def turns_of(record: Any, mapping: Mapping) -> list[tuple[str, str]] | None:
    """(role, text) in order; None if an item lacks what the mapping asks for, though the record as a whole has its paths."""
    if mapping.turns is None:
        return [(role, _text(record[path])) for role, path in mapping.fields if path in record]
    items = record.get(mapping.turns) if mapping.turns else [record]
    if not isinstance(items, list) or not all(isinstance(x, dict) and mapping.role in x and mapping.text in x for x in items):
        return None
    return [(mapping.roles.get(r := _text(x[mapping.role]), r), _text(x[mapping.text])) for x in items]


def escape(text: str) -> str:
    """No control string can stand in the result: a backslash is doubled and one comes between ``<`` and ``|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int | None, int | None]:
    """The marked turn, and start and length of what the loss covers in it (assistant texts)."""
    head = f"{START}{escape(role).replace('\n', chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{END}", *((len(head), len(body)) if role == "assistant" else (None, None))


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) read back."""
    if not (formatted.startswith(START) and formatted.endswith(END)):
        raise ValueError("not a formatted turn")
    head, _, body = formatted[len(START) : -len(END)].partition("\n")
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head), unescape(body)


SCHEMA = "conv_id long, seq long, part int, schema_id string, mapping string, formatted string, loss_start int, loss_length int"


def format_chats(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS, ignored: frozenset[str] = IGNORED) -> DataFrame:
    """Formats rows of ``conv_id, seq, record`` (JSON); one row of ``SCHEMA`` per turn.

    The formatted conversation is ``formatted`` of its rows in the order of
    ``seq, part``; ``loss_start`` and ``loss_length`` mark, in code points,
    what the loss covers in a row. Narrow: no shuffle.

    Records of an unknown layout, and such as are not JSON or nested deeper
    than ``DEEPEST``, give one row with their fingerprint (null in the latter
    cases), null mapping and empty text, so that none goes unseen (``unknown``
    counts them). So do records of which one item lacks its role or text, and
    lists without items, whose layout cannot be told. Fields named in
    ``ignored`` have no say in the layout. Null values count as empty; lone
    surrogates become U+FFFD. An empty table gives no rows.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(mappings)
        for batch in batches:
            rows = []
            for conv, seq, record in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    value = json.loads(record)
                    schema_id = schema_fingerprint(field_paths(value, ignored))
                except (TypeError, ValueError, RecursionError):
                    value, schema_id = None, None
                mapping = known.get(schema_id)
                turns = turns_of(value, mapping) if mapping else None
                if turns is None:
                    rows.append((conv, seq, 0, schema_id, None, "", None, None))
                    continue
                for part, turn in enumerate(turns):
                    rows.append((conv, seq, part, schema_id, mapping.name, *format_turn(*turn)))
            columns = [*zip(*rows, strict=True)] if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return records.select(F.col("conv_id").cast("long"), F.col("seq").cast("long"), "record").mapInArrow(run, SCHEMA)


def unknown(formatted: DataFrame) -> DataFrame:
    """``schema_id, n``: how many records of each fingerprint no mapping could convert; null for such as are not JSON."""
    return formatted.filter("mapping is null").groupBy("schema_id").agg(F.count(F.lit(1)).alias("n"))


def turn_records(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, seq, record`` of a table that has a row per turn.

    Records come in the layouts that sources use, by a hash of conversation and
    turn: objects of role and text, of role and content, lists of messages, and
    lists of from and value with their own names of roles.
    """
    role, text = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    shown = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    foreign = F.array(F.struct(shown.alias("from"), text.alias("value")))
    layouts = [
        F.to_json(F.struct(role.alias("role"), text.alias("text"))),
        F.to_json(F.struct(text.alias("content"), role.alias("role"), F.col(turn).cast("string").alias("id"))),
        F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"), F.lit("rows").alias("source"))),
        # A role that is called human or gpt already would be renamed.
        F.when(role.isin("human", "gpt"), F.to_json(F.struct(role.alias("role"), text.alias("text")))).otherwise(F.to_json(F.struct(foreign.alias("conversations")))),
    ]
    pick = F.pmod(F.xxhash64(F.col(conv), F.col(turn)), F.lit(len(layouts)))
    record = F.element_at(F.array(*layouts), (pick + 1).cast("int"))
    return rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("seq"), record.alias("record"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """One row of ``DIGEST`` per conversation, read back from formatted turns.

    A digest over a whole conversation is one stream by its nature: its turns
    come sorted and pass through one task batch by batch, and only the state
    of the digest is kept, so a conversation of any length fits. Turns with
    equal ``seq`` and ``part`` come in the order of their formatted text.
    """
    names = [f.split()[0] for f in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        close = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for batch in batches:
            done = []
            for conv, formatted, start, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(close(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(formatted)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                if start is not None:
                    learnt = unescape(formatted[start : start + length])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode("utf-8", "replace"))
                state[5] += len(formatted)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(close(state), types, strict=True)], names=names)

    order = ["conv_id", "seq", "part", "formatted"]
    rows = formatted.filter("mapping is not null").repartition("conv_id").sortWithinPartitions(*order)
    return rows.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(run, DIGEST)
