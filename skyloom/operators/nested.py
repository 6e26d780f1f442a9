"""Nested snapshots as flat tables that keep their parents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.structural import StructuralIndex, build_index

#: Arrays of a snapshot and the names that producers give to the members read here (fixed values).
CHILDREN = ("sat_attrs", "sat_edges", "target_edges")
_OWN = frozenset((b"id", b"sat_id", b"satellite_id", b"satellite", b"sat", b"name"))
_FROM = frozenset((b"from", b"from_id", b"source", b"src", b"start", b"from_sat", b"satellite"))
_TO = frozenset((b"to", b"to_id", b"target", b"dst", b"end", b"to_sat", b"target_id"))
_WEIGHT = frozenset((b"health", b"w", b"q", b"weight", b"quality"))
_POSITION = frozenset((b"pos", b"position"))

FLAT_SCHEMA = T.StructType(
    [
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("child", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("a_id", T.LongType()),
        T.StructField("b_id", T.LongType()),
        T.StructField("parent_ord", T.LongType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("pos", T.ArrayType(T.DoubleType())),
    ]
)
_ARROW = pa.schema(
    [
        ("snapshot_id", pa.int64()), ("child", pa.string()), ("ord", pa.int64()), ("a_id", pa.int64()), ("b_id", pa.int64()),
        ("parent_ord", pa.int64()), ("weight", pa.float64()), ("pos", pa.list_(pa.float64())),
    ]
)
_BATCH_BYTES = 4_000_000
#: A JSON string that may hold JSON: blanks, then a brace, a bracket or a quote, each plain or escaped.
_EMBEDDED = re.compile(rb'"(?: |\\[nrt]|\\u00(?:20|09|0[aAdD]))*+(?:[{\[]|\\"|\\u00(?:7[bB]|5[bB]|22))')
_WHOLE = re.compile(rb"-?\d{1,30}")
_DIGITS = re.compile(rb"(\d+)\D*$")
_OPEN_OBJECT, _OPEN_ARRAY, _STRING = 123, 91, 34


def _number(raw: bytes | None) -> int | None:
    """The id in a number, in a text for a number or in a name such as Satellite111."""
    if raw is None:
        return None
    raw = raw.strip(b'"').strip()
    try:
        value = int(raw) if _WHOLE.fullmatch(raw) else float(raw)
        return int(value) if value == value and abs(value) < 2**63 else None
    except ValueError:
        found = _DIGITS.search(raw)
        return int(found[1]) if found and len(found[1]) < 19 else None


def _real(raw: bytes | None) -> float | None:
    try:
        return float(raw.strip(b'"')) if raw is not None else None
    except ValueError:
        return None


def _embedded(raw: bytes) -> bytes | None:
    """The text inside a JSON string whose first character but for blanks opens an object, an array or a further string."""
    return json.loads(raw).encode("utf-8", "surrogatepass") if _EMBEDDED.match(raw) else None


_FIELD_NAMES = sorted(_OWN | _FROM | _TO | _WEIGHT | _POSITION)
_NAMES = [*(child.encode() for child in CHILDREN), *_FIELD_NAMES]


def _named(names: frozenset) -> np.ndarray:
    """Which codes of ``_NAMES`` are among ``names``; the last entry stands for the code -1."""
    return np.array([*(n in names for n in _NAMES), False])


_IS_OWN, _IS_FROM, _IS_TO, _IS_WEIGHT, _IS_POSITION = (_named(n) for n in (_OWN, _FROM, _TO, _WEIGHT, _POSITION))


class _Elements:
    """Elements of the three arrays that one batch of texts holds, with JSON texts inside strings.

    Which tokens are containers, elements and fields is told by masks over the whole batch; Python
    goes only over what was found.
    """

    def __init__(self) -> None:
        #: (text, order key, child, own, from, to, weight, pos, owner's order key)
        self.rows: list[tuple] = []

    def scan(self, texts: list[bytes], owners: list[int], prefixes: list[tuple], roots: list[int]) -> None:
        index = build_index(texts)
        kind, parent, value = index.kind, index.parent, index.value
        code = index.name_codes(_NAMES)
        child = np.where(code < len(CHILDREN), code, -1)
        top = value & (parent < 0)
        child[top] = np.asarray(roots, dtype=np.int64)[index.doc[top]]
        self._embedded(index, child, owners, prefixes)

        container = value & (child >= 0) & (kind != _STRING)
        listed = kind == _OPEN_ARRAY
        up = np.maximum(parent, 0)
        inner = value & (index.key < 0) & (parent >= 0) & container[up] & listed[up]
        element = inner | (container & ~listed)
        letters = np.frombuffer(index.data, dtype=np.uint8)
        element &= ~((kind != _STRING) & (letters[np.minimum(index.start, letters.size - 1)] == 110))  # null is what begins with n
        holder = np.where(inner, parent, np.arange(kind.size))

        field = (index.key >= 0) & (parent >= 0) & element[up] & (kind[up] == _OPEN_OBJECT)
        plain = field & (kind != _OPEN_OBJECT) & ~listed
        own, source, to = (self._first(index, plain & mask[code]) for mask in (_IS_OWN, _IS_FROM, _IS_TO))
        bare = np.flatnonzero(element & (kind != _OPEN_OBJECT) & ~listed)
        own.update(zip(bare.tolist(), self._numbers(index, bare), strict=True))
        weight: dict[int, float | None] = {}
        for token in np.flatnonzero(plain & _IS_WEIGHT[code]).tolist():
            if weight.get(int(parent[token])) is None:
                weight[int(parent[token])] = _real(index.raw(token))
        place_list = field & ~plain & _IS_POSITION[code]
        points: dict[int, list] = {int(t): [] for t in np.flatnonzero(place_list)}
        for token in np.flatnonzero(value & (parent >= 0) & place_list[up]).tolist():
            points[int(parent[token])].append(_real(index.raw(token)))
        position = {int(parent[t]): values for t, values in points.items()}

        found = np.flatnonzero(element)
        above = parent[holder[found]]
        under_satellite = (above >= 0) & element[np.maximum(above, 0)] & (child[holder[np.maximum(above, 0)]] == 0)
        rows = zip(
            found.tolist(), index.doc[found].tolist(), index.start[found].tolist(), child[holder[found]].tolist(),
            np.where(under_satellite, above, -1).tolist(), index.start[np.maximum(above, 0)].tolist() if kind.size else [], strict=True,
        )
        for token, doc, start, what, satellite, satellite_start in rows:
            begins = source.get(token)
            if satellite >= 0 and begins is None and what:
                begins = own.get(satellite)
            owner = (*prefixes[doc], satellite_start) if satellite >= 0 else None
            self.rows.append((owners[doc], (*prefixes[doc], start), what, own.get(token), begins, to.get(token), weight.get(token), position.get(token), owner))

    def _embedded(self, index: StructuralIndex, child: np.ndarray, owners: list[int], prefixes: list[tuple]) -> None:
        """Scan the JSON texts inside the strings of the batch; what is in one counts where its string stands."""
        strings = np.flatnonzero(index.value & (index.kind == _STRING))
        letters = np.frombuffer(index.data, dtype=np.uint8)
        # the character after the quote: of the others, none can begin JSON behind blanks, plain or escaped
        likely = strings[np.isin(letters[index.start[strings] + 1], (32, 92, _OPEN_OBJECT, _OPEN_ARRAY))]
        nested: tuple[list[bytes], list[int], list[tuple], list[int]] = ([], [], [], [])
        for token in likely.tolist():
            if (text := _embedded(index.raw(token))) is not None:
                doc = int(index.doc[token])
                for to, what in zip(nested, (text, owners[doc], (*prefixes[doc], int(index.start[token])), int(child[token])), strict=True):
                    to.append(what)
        if nested[0]:
            self.scan(*nested)

    @staticmethod
    def _numbers(index: StructuralIndex, tokens: np.ndarray) -> list[int | None]:
        values, plain = index.whole_numbers(tokens)
        return [v if p else _number(index.raw(t)) for t, v, p in zip(tokens.tolist(), values.tolist(), plain.tolist(), strict=True)]

    def _first(self, index: StructuralIndex, mask: np.ndarray) -> dict[int, int]:
        """The first number among the fields of each object."""
        tokens = np.flatnonzero(mask)
        first: dict[int, int] = {}
        for owner, number in zip(index.parent[tokens].tolist(), self._numbers(index, tokens), strict=True):
            if number is not None and owner not in first:
                first[owner] = number
        return first


def _flatten(ids: list[int], bodies: list[bytes]) -> dict[str, list]:
    elements = _Elements()
    elements.scan(bodies, list(range(len(bodies))), [()] * len(bodies), [-1] * len(bodies))
    rows = sorted(elements.rows, key=lambda row: (row[0], row[1]))
    numbers: dict[tuple, int] = {}
    places: dict[tuple, int] = {}
    ords, parents = [], []
    for text, place, what, *_, owner in rows:
        number = numbers[text, what] = numbers.get((text, what), 0) + 1
        places[text, place] = number
        ords.append(number)
        parents.append(places.get((text, owner)) if owner else None)
    columns = (
        [ids[r[0]] for r in rows], [CHILDREN[r[2]] for r in rows], ords, [r[4] if r[2] else r[3] for r in rows], [r[5] if r[2] else 0 for r in rows],
        parents, [r[6] for r in rows], [r[7] for r in rows],
    )
    return dict(zip(_ARROW.names, columns, strict=True))


def _flatten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(ids: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(_flatten(ids, bodies), schema=_ARROW)

    for batch in batches:
        ids: list[int] = []
        bodies: list[bytes] = []
        held = 0
        for snapshot, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(snapshot)
            bodies.append(body.encode("utf-8", "surrogatepass"))
            held += len(bodies[-1])
            if held >= _BATCH_BYTES:
                yield out(ids, bodies)
                ids, bodies, held = [], [], 0
        if ids:
            yield out(ids, bodies)


def flatten_json(records: DataFrame, key: str, body: str) -> DataFrame:
    """The three flat tables of JSON snapshots as rows of one: ``FLAT_SCHEMA``.

    Texts of a task are indexed together (see ``functions.structural``): bitmaps, depth by prefix
    sums, spans, and from them the elements of sat_attrs, sat_edges and target_edges wherever they
    lie, also in JSON inside strings. ord numbers the elements of a child within the snapshot from
    1 in document order; parent_ord is the ord of the sat_attrs element that an edge is kept
    under. A single object counts as an array of one; null elements aren't counted.

    A null, empty or malformed body gives no row; it costs no other body its rows. Rows equal in
    ``key`` and ``body`` are read once. Bodies of any length are read whole, long ones in a batch
    of their own. Extra columns are dropped. An empty table gives an empty one.
    """
    rows = records.select(F.col(f"`{key}`").cast("long").alias("snapshot_id"), F.col(f"`{body}`").alias("body"))
    return rows.filter(F.length("body") > 0).distinct().mapInArrow(_flatten_batches, FLAT_SCHEMA)


def flatten_arrays(snapshots: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """The flat tables of typed snapshots, in the form of ``flatten_json``.

    Null arrays give no rows and null elements aren't counted. Repeated snapshots (equal in the
    key and the three arrays) are read once. Extra columns are dropped.
    """
    rows = snapshots.select(F.col(f"`{key}`").cast("long").alias("snapshot_id"), *CHILDREN).distinct()

    def child(name: str, a: str, b: str | None, weight: str) -> DataFrame:
        sound = F.filter(F.col(name), lambda e: e.isNotNull())
        taken = rows.select("snapshot_id", F.posexplode(sound).alias("at", "e"))
        return taken.select(
            "snapshot_id",
            F.lit(name).alias("child"),
            (F.col("at") + 1).cast("long").alias("ord"),
            F.col(f"e.{a}").cast("long").alias("a_id"),
            (F.col(f"e.{b}") if b else F.lit(0)).cast("long").alias("b_id"),
            F.lit(None).cast("long").alias("parent_ord"),
            F.col(f"e.{weight}").cast("double").alias("weight"),
            (F.col("e.pos") if name == "sat_attrs" else F.lit(None)).cast("array<double>").alias("pos"),
        )

    return (
        child("sat_attrs", "id", None, "health")
        .unionByName(child("sat_edges", "from_id", "to_id", "w"))
        .unionByName(child("target_edges", "from_id", "to_id", "q"))
    )
