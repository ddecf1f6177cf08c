"""Deeply nested records as flat child tables with links to their parents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



_CHILD = pa.struct([("ok", pa.bool_()), ("id", pa.string())])
_PARENT = pa.struct([("ok", pa.bool_()), ("id", pa.string()), ("child", pa.list_(_CHILD))])
_TX = pa.struct([("in_msg", pa.list_(_CHILD)), ("out_msg", pa.list_(_CHILD))])
_BAD = object()


def _read(value):
    """A JSON value, with strings that hold an object, list or string read in turn, however deep (each is shorter than the last); _BAD for what can't be read."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return _BAD
    return value


def _members(value) -> dict | None:
    """The non-null members of an object by their keys in lower case without underscores; None for anything else."""
    if not isinstance(value, dict):
        return None
    found: dict = {}
    for key, member in value.items():
        if member is not None:
            found.setdefault(key.replace("_", "").lower(), member)
    return found


def _elements(value) -> list:
    """The elements of a list however it is shaped: an array, an object keyed by position, one bare object, or any of these as a string."""
    value = _read(value)
    if isinstance(value, list):
        return value
    if isinstance(value, dict) and value:
        return [value[k] for k in sorted(value, key=int)] if all(k.isdecimal() for k in value) else [value]
    return []


def _child(element, key: str, inner: str | None = None) -> dict:
    """One element as a struct; ok: it is an object; child: the elements of its list ``inner``."""
    fields = _members(_read(element))
    name = fields and fields.get(key)
    out = {"ok": fields is not None, "id": name if isinstance(name, str) or name is None else json.dumps(name)}
    if inner:
        out["child"] = [_child(e, "feeid") for e in _elements((fields or {}).get(inner))]
    return out


def _legs(text: str | None) -> list:
    return [_child(e, "legid", "fees") for e in _elements((_members(_read(text)) or {}).get("legs"))]


def _transaction(text: str | None) -> dict:
    fields = _members(_read(text)) or {}
    inward = [_child(fields["inmsg"], "hash")] if "inmsg" in fields else []
    return {"in_msg": inward, "out_msg": [_child(e, "hash") for e in _elements(fields.get("outmsgs"))]}


def _emit(lists: pa.ListArray, keys: pa.Array, kind: str, parents: pa.Array | None = None) -> tuple[pa.RecordBatch, pa.Array, pa.Array]:
    """Children of one level from a list array: parents by the parent-index kernel, places from the offsets, keys by take.

    Gives the rows, each row's parent place within ``lists``, and which children are objects.
    """
    parent = pc.list_parent_indices(lists)
    flat = lists.flatten()
    starts = pc.subtract(lists.offsets[:-1], lists.offsets[0])
    at = pa.array(range(len(flat)), pa.int32()) if len(flat) else pa.array([], pa.int32())
    place = pc.subtract(at, pc.take(starts, parent))
    over = pc.take(parents, parent) if parents is not None else pa.array([0] * len(flat), pa.int32())
    key = pc.take(keys, parent)
    ids = flat.field("id") if pa.types.is_struct(flat.type) else flat
    ok = pc.fill_null(flat.field("ok"), False) if pa.types.is_struct(flat.type) else flat.is_valid()
    rows = pa.RecordBatch.from_arrays([key, pa.array([kind] * len(flat), pa.string()), over, place, ids], names=["row_key", "child_kind", "parent_pos", "child_pos", "child_id"])
    return rows, place, ok


def _dense(lists: pa.Array) -> pa.ListArray:
    """The same lists with null lists as empty ones and offsets from 0."""
    size = pc.fill_null(pc.list_value_length(lists), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cast(pc.cumulative_sum(size), pa.int32())])
    return pa.ListArray.from_arrays(offsets, lists.flatten())


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("row_key")
        legs = _dense(pa.array([_legs(t) for t in batch.column("details").to_pylist()], pa.list_(_PARENT)))
        rows, place, ok = _emit(legs, keys, "leg")
        yield rows.filter(ok)
        below, owner = _dense(legs.flatten().field("child")), rows.column("row_key")
        rows, _, ok = _emit(below, owner, "fee", place)
        yield rows.filter(ok)
        texts = _dense(batch.column("transactions_full"))
        rows, place, _ = _emit(texts, keys, "tx")
        txs = pa.array([_transaction(t) for t in texts.flatten().to_pylist()], _TX)
        for kind in ("in_msg", "out_msg"):
            below, _, ok = _emit(_dense(txs.field(kind)), rows.column("row_key"), kind, place)
            yield below.filter(ok)
        rows, _, ok = _emit(_dense(batch.column("accounts")), keys, "account")
        yield rows.filter(ok)


def nested_children(actions: DataFrame, key: str = "delivery_id") -> DataFrame:
    """All child objects of raw actions: (row_key, child_kind, parent_pos, child_pos, child_id).

    Each JSON text is decoded once into a typed nested Arrow column, whatever the shape and spelling of its lists;
    from there offsets and parent-index kernels give every child table of a batch, with keys and positions
    propagated by take. Only the four columns needed are read and nothing is shuffled. Kinds: leg, fee, in_msg, out_msg,
    account. Unreadable and null elements keep their position and give no child; an unreadable text, null and
    empty lists have none; a child without id has a null child_id; repeated deliveries give their children again.
    """
    flat = actions.select(F.col(key).cast("bigint").alias("row_key"), "details", "transactions_full", "accounts")
    return flat.mapInArrow(_flatten, "row_key bigint, child_kind string, parent_pos int, child_pos int, child_id string")
