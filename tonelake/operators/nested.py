"""Deeply nested JSON cells as related flat tables with parent-child links.

Each cell is read once, event by event, by a strict scanner with an explicit stack (no tree is built, and no depth is
too deep). Where an event lies under a repeated ancestor (a list, or a map whose keys are data), the scanner's stack
holds the ordinals or keys that lead to the instance; leaf events become path-value-ordinal triples of that instance.
Triples of one instance are pivoted where they arise, since all of them come from one cell: a row per instance, keyed by
(record id, path), its parent being the path without the last step (an object under a fixed name has the path of the
instance that holds it, which is also its parent). Nothing is shuffled, and all ancestors of all cells come from one
scan. An ancestor that tells its branches keeps all else of an instance too: what is neither an asked leaf nor a
branch of the expected kind goes by name into the map `other`, so no table loses anything. Without branches told, only
the leaves asked for are collected.

Defined results: null cells, cells that are not strict JSON (NaN and Infinity are none), and levels of another kind
than the layout expects give no rows, and other levels of the same cell are kept; foreign elements of a list count as
positions but give no rows; of a repeated key the last value holds; an absent or null leaf is null (in `other`, an
absent one has no entry); a leaf that is no text comes as its JSON text as written; repeated records give their rows
again; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.sources.tables import cut, text_rows

ITEMS, KEYS = "[]", "{}"


@dataclass(frozen=True)
class Ancestor:
    """A repeated ancestor: `steps` lead from the cell's root to an instance.

    A step is ITEMS (each element of a list), KEYS (each entry of a map), or a tuple of names of which the first
    present key is followed. `scalar` names the leaf that takes an instance which is text or null instead of an object.
    `branches` are the (names, kind) that further ancestors tell, the first present name if its value is of that kind.
    """

    name: str
    steps: tuple
    leaves: tuple[str, ...]
    scalar: str | None = None
    branches: tuple[tuple[tuple[str, ...], type], ...] | None = None
    #: leaves of which `<leaf>_kind` tells the JSON kind (text, number, word, null, list, map)
    kinds: tuple[str, ...] = ()
    #: whether values of another kind at an instance's place give rows too, with their kind in the leaf `foreign`
    foreign: bool = False

    def columns(self) -> tuple[str, ...]:
        return (*self.leaves, *(f"{k}_kind" for k in self.kinds), *(("foreign",) if self.foreign else ()))


_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|"([^"\\\x00-\x1f]*)"|("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))')
#: A whole member of a map with a plain key and a scalar value, and what follows it: read at one stroke.
_MEMBER = re.compile(r'[ \t\r\n]*"([^"\\\x00-\x1f]*)"[ \t\r\n]*:[ \t\r\n]*(?:"([^"\\\x00-\x1f]*)"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))[ \t\r\n]*([,}])')
_BLANK = re.compile(r"[ \t\r\n]*")
# what may come next
_VALUE, _VALUE_OR_END, _KEY_OR_END, _KEY, _COLON, _MORE = range(6)
_KINDS = {2: "text", 3: "text", 4: "number", 5: "word"}


def _utf8(s: str) -> str:
    """Lone surrogates, which JSON can escape, have no UTF-8 form."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


class _Open:
    """A container whose end has not come yet: the ancestors sought below it, and the instances it is."""

    __slots__ = ("is_map", "below", "instances", "begin", "key", "size", "spans", "row_at", "held")

    def __init__(self, is_map: bool, below: list, instances: list, begin: int, key: str | None, row_at: int):
        self.is_map, self.below, self.instances, self.begin, self.key, self.row_at = is_map, below, instances, begin, key, row_at
        self.size = 0
        self.spans: dict[str, tuple[int, int]] | None = {} if is_map and below else None
        self.held: dict[str, tuple[str, str | None]] | None = {} if instances else None  # key -> (kind, text)


def scan(text: str | None, ancestors: list[Ancestor]) -> list[tuple[int, tuple[str, ...], dict[str, str | None]]] | None:
    """(ancestor, ordinals, leaves) of every instance in a strict JSON text, in order; None if it is none.

    A state (ancestor, depth, ordinals) means that the first `depth` steps of the ancestor lead here. It advances with
    each container that opens, so an event costs time only for the ancestors that can still come.
    """
    if text is None:
        return None
    rows: list = []
    stack: list[_Open] = []
    match, at, end, expect = _TOKEN.match, 0, len(text), _VALUE
    key: str | None = None
    start = [(i, 0, ()) for i in range(len(ancestors))]

    def child_states(parent: _Open | None, key: str | None) -> list:
        if parent is None:
            return start
        out = []
        for i, depth, path in parent.below:
            step = ancestors[i].steps[depth]
            if step == ITEMS:
                if not parent.is_map:
                    out.append((i, depth + 1, (*path, str(parent.size))))
            elif parent.is_map:
                if step == KEYS:
                    out.append((i, depth + 1, (*path, _utf8(key))))
                elif key in step:
                    out.append((i, depth + 1, path))
        return out

    def settle(parent: _Open, k: str, begin: int) -> None:
        """Of a repeated key the last value holds: rows of the earlier one are taken back."""
        old = parent.spans.get(k)
        if old:
            for r in range(*old):
                rows[r] = None
        parent.spans[k] = (begin, len(rows))

    def scalar(parent: _Open | None, key: str | None, kind: int, value: str | None) -> None:
        begin = len(rows)
        if parent is None or parent.below:
            for i, depth, path in child_states(parent, key):
                a = ancestors[i]
                if depth == len(a.steps) and a.scalar and (kind in (2, 3) or value is None):
                    rows.append((i, path, {a.scalar: value if value is None else _utf8(value)}))
                elif depth == len(a.steps) and a.foreign:
                    rows.append((i, path, {"foreign": "null" if value is None else _KINDS[kind]}))
        if parent is not None:
            if parent.held is not None:
                parent.held[key] = ("null" if value is None else _KINDS[kind], value if value is None else _utf8(value))
            if parent.spans is not None:
                settle(parent, key, begin)

    def close(o: _Open) -> None:
        if o.spans:  # of alternative names the first present one is followed
            for i, depth, _ in o.below:
                step = ancestors[i].steps[depth]
                if step not in (ITEMS, KEYS):
                    present = [k for k in step if k in o.spans]
                    for k in present[1:]:
                        for r in range(*o.spans[k]):
                            if rows[r] is not None and rows[r][0] == i:
                                rows[r] = None
        for i, row in o.instances:
            a = ancestors[i]
            told = set(a.leaves)
            for names, kind in a.branches or ():
                k = next((n for n in names if n in o.held), None)
                if k is not None and o.held[k][0] == ("list" if kind is list else "map"):
                    told.add(k)
            for k in a.kinds:
                if k in o.held:
                    row[f"{k}_kind"] = o.held[k][0]
            for k, (_, v) in o.held.items():
                if k in a.leaves or (a.branches is not None and k not in told):
                    row[k if k in a.leaves else k.encode("utf-8", "backslashreplace").decode("utf-8")] = v

    member = _MEMBER.match
    while True:
        if expect in (_KEY_OR_END, _KEY) and (m := member(text, at)) is not None:
            parent = stack[-1]
            key, kind = m[1], 2 if m[2] is not None else 4 if m[3] is not None else 5
            if parent.held is not None or parent.below:
                value = m[2] if kind == 2 else m[3] if kind == 4 else None if m[4] == "null" else m[4]
                scalar(parent, key, kind, value)
            parent.size += 1
            if m[5] == ",":
                at, expect = m.end(), _KEY
            else:  # the end of the map is read as such
                at, expect = m.end() - 1, _MORE
            continue
        m = match(text, at)
        if m is None:
            return None
        kind = m.lastindex
        token_at, at = m.start(kind), m.end()
        parent = stack[-1] if stack else None
        if kind == 1:
            ch = text[token_at]
            if ch in "{[":
                if expect > _VALUE_OR_END:
                    return None
                states = child_states(parent, key) if parent is None or parent.below else ()
                is_map = ch == "{"
                below, instances, row_at = [], [], len(rows)
                for i, depth, path in states:
                    if depth < len(ancestors[i].steps):
                        below.append((i, depth, path))
                    elif not is_map:
                        if ancestors[i].foreign:
                            rows.append((i, path, {"foreign": "list"}))
                    else:
                        row: dict[str, str | None] = {}
                        rows.append((i, path, row))
                        instances.append((i, row))
                stack.append(_Open(is_map, below, instances, token_at, key, row_at))
                expect = _KEY_OR_END if is_map else _VALUE_OR_END
                continue
            if ch in "}]":
                if not stack or parent.is_map != (ch == "}") or expect not in (_MORE, _KEY_OR_END if ch == "}" else _VALUE_OR_END):
                    return None
                o = stack.pop()
                if o.is_map:
                    close(o)
                parent, key = (stack[-1] if stack else None), o.key
                if parent is not None:
                    if parent.held is not None:
                        parent.held[key] = ("map" if o.is_map else "list", text[o.begin : at])
                    if parent.spans is not None:
                        settle(parent, key, o.row_at)
            elif ch == ",":
                if expect != _MORE:
                    return None
                expect = _KEY if parent.is_map else _VALUE
                continue
            else:
                if expect != _COLON:
                    return None
                expect = _VALUE
                continue
        else:
            if kind == 2:
                value: str | None = m[2]
            elif kind == 3:
                value = json.loads(m[3])
            elif kind == 4:
                value = m[4]
            else:
                value = None if m[5] == "null" else m[5]
            if expect in (_KEY_OR_END, _KEY):
                if kind not in (2, 3):
                    return None
                key, expect = value, _COLON
                continue
            if expect > _VALUE_OR_END:
                return None
            scalar(parent, key, kind, value)
        # a value has ended
        if parent is None:
            return [r for r in rows if r is not None] if _BLANK.match(text, at).end() == end else None
        parent.size += 1
        expect = _MORE


def flatten(df: DataFrame, row_id: str, cells: dict[str, list[Ancestor]]) -> dict[str, DataFrame]:
    """A DataFrame (row_id, source_field, path, parent_path, ordinal, steps, *leaves, other) for each ancestor named in `cells`.

    `cells` maps a JSON column to the ancestors sought in it. One scan writes the instances of all ancestors to the shared
    checkpoint folder; the tables are views of what it wrote.
    """
    whole = cut(shred(df, row_id, cells))
    out = {}
    for a in (one for ancestors in cells.values() for one in ancestors):
        other = ["other"] if a.branches is not None else []
        out[a.name] = whole.where(F.col("ancestor") == a.name).select("row_id", "source_field", "path", "parent_path", "ordinal", "steps", *(f"leaf_{x}" for x in a.columns()), *other)
    return out


def shred(df: DataFrame, row_id: str, cells: dict[str, list[Ancestor]]) -> DataFrame:
    """All instances of all ancestors in one pass over `df`: (row_id, source_field, ancestor, path, parent_path, ordinal, steps, *leaves).

    `steps` are the ordinals and keys of the path, one by one. If an ancestor tells its branches, a map `other` with all else follows.
    """
    leaves = list(dict.fromkeys(x for a in cells.values() for one in a for x in one.columns()))
    columns = list(cells)
    whole = any(one.branches is not None for a in cells.values() for one in a)
    names = ["row_id", "source_field", "ancestor", "path", "parent_path", "ordinal", "steps", *(f"leaf_{x}" for x in leaves), *(["other"] if whole else [])]
    kinds = {"row_id": (pa.int64(), "bigint"), "other": (pa.map_(pa.string(), pa.string()), "map<string,string>"), "steps": (pa.list_(pa.string()), "array<string>")}
    kinds = {n: kinds.get(n, (pa.string(), "string")) for n in names}
    schema = pa.schema([pa.field(n, kinds[n][0]) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches):
            ids = batch.column(0).to_pylist()
            out: list[list] = [[] for _ in names]
            for c, column in enumerate(columns):
                for rid, cell in zip(ids, batch.column(c + 1)):
                    for i, at, row in scan(cell.as_py(), cells[column]) or ():
                        a = cells[column][i]
                        named = bool(a.steps) and isinstance(a.steps[-1], tuple)
                        other = [[(k, row.pop(k)) for k in list(row) if k not in a.columns()]] if whole else []
                        for to, x in zip(out, (rid, column, a.name, "/".join(at), "/".join(at if named else at[:-1]), at[-1] if at and not named else "", list(at), *(row.get(n) for n in leaves), *other)):
                            to.append(x)
                    if len(out[0]) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)
                        out = [[] for _ in names]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    spark_schema = ", ".join(f"`{n}` {kinds[n][1]}" for n in names)
    return df.select(F.col(row_id).cast("bigint"), *(F.col(c).cast("string") for c in columns)).mapInArrow(run, spark_schema)


# the leaves of both schema versions; what a later one adds is in `other`
_VERSION = ("display_label", "display_position", "actual_mix_id", "stimulus_id", "audio_path", "rating", "rating_set", "audio_played", "first_play_timestamp", "response_time_ms")
_TRIAL = ("trial_index", "episode_position", "song_position", "scenario_id", "episode_id", "song_id", "excerpt_id", "comparative_comment")
_VERSION_LISTS = ("version_records", "versions")

RESPONSES = Ancestor("responses", (ITEMS,), (*_TRIAL, "comment", *_VERSION), branches=())
TRIALS = Ancestor("trials", (ITEMS,), _TRIAL, branches=((_VERSION_LISTS, list), (("device",), dict)))
DEVICES = Ancestor("devices", (ITEMS, ("device",)), ("output",), branches=((("levels",), list),))
LEVELS = Ancestor("device_levels", (ITEMS, ("device",), ("levels",), ITEMS), ("db",), branches=())
VERSIONS = Ancestor("versions", (ITEMS, _VERSION_LISTS, ITEMS), _VERSION, branches=((("play_events",), list),))
PLAYS = Ancestor("play_events", (ITEMS, _VERSION_LISTS, ITEMS, ("play_events",), ITEMS), ("at_ms", "action"), branches=())
MAPPING = Ancestor("mapping", (KEYS, KEYS, KEYS), ("stimulus_id", "revision"), scalar="stimulus_id", branches=())
