"""Raw chain actions: validation, revisions merged by action, and identities of addresses."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namequarry.operators.delivery import id_bytes

# what must hold of a raw action, in SQL that Spark and others read alike; matches(x, 'pattern') is a search
_WIRE = "({c} IS NOT NULL AND length({c}) BETWEEN 1 AND 2048)"
_LT = "({c} IS NOT NULL AND matches({c}, '^(0|[1-9][0-9]{{0,18}})$') AND TRY_CAST({c} AS BIGINT) IS NOT NULL)"
_INT = "({c} IS NOT NULL AND {c} BETWEEN 0 AND 2147483647)"
RULES = {
    "action_id": _WIRE.format(c="action_id"), "type": "(type IS NOT NULL AND length(type) <= 128 AND matches(type, '^[a-z][a-z0-9_]*$'))", "details": "details IS NOT NULL",
    **{c: _LT.format(c=c) for c in ("start_lt", "end_lt", "trace_end_lt")}, **{c: _INT.format(c=c) for c in ("start_utime", "end_utime", "trace_end_utime", "trace_mc_seqno_end")},
    "success": "success IS NOT NULL", "trace_id": _WIRE.format(c="trace_id"), "transactions": "transactions IS NOT NULL",
    **{c: f"({c} IS NULL OR length({c}) BETWEEN 1 AND 2048)" for c in ("trace_external_hash", "trace_external_hash_norm")}, "finality": "(finality IS NULL OR finality IN (0, 1, 2))",
    "lt_order": "(TRY_CAST(start_lt AS BIGINT) IS NULL OR TRY_CAST(end_lt AS BIGINT) IS NULL OR TRY_CAST(start_lt AS BIGINT) <= TRY_CAST(end_lt AS BIGINT))",
    "trace_lt_order": "(TRY_CAST(end_lt AS BIGINT) IS NULL OR TRY_CAST(trace_end_lt AS BIGINT) IS NULL OR TRY_CAST(end_lt AS BIGINT) <= TRY_CAST(trace_end_lt AS BIGINT))",
    "utime_order": "(start_utime IS NULL OR end_utime IS NULL OR start_utime <= end_utime)", "trace_utime_order": "(end_utime IS NULL OR trace_end_utime IS NULL OR end_utime <= trace_end_utime)",
}


def action_errors(actions: DataFrame, key: str = "delivery_id") -> DataFrame:
    """(key, errors): every rule that an action breaks, parted by commas; empty for a valid one."""
    rule = lambda text: F.expr(re.sub(r"matches\((\w+), ('[^']*')\)", r"(\1 RLIKE \2)", text))
    broken = F.array(*(F.when(~F.coalesce(rule(r), F.lit(False)), F.lit(n)) for n, r in RULES.items()))
    return actions.select(key, F.array_join(F.array_compact(broken), ",").alias("errors"))


def action_errors_sql(key: str = "delivery_id", table: str = "raw_actions") -> str:
    parts = ", ".join(f"CASE WHEN NOT coalesce({r}, false) THEN '{n}' END" for n, r in RULES.items()).replace("matches(", "regexp_matches(")
    return f"SELECT {key}, concat_ws(',', {parts}) AS errors FROM {table}"


def merged_json(before, after, later: bool):
    """Two revisions of a JSON value: objects member by member, anything else that differs from the later one if ``later``, else the former."""
    if isinstance(before, dict) and isinstance(after, dict):
        return {k: merged_json(before[k], after[k], later) if k in before and k in after else before.get(k, after.get(k)) for k in [*before, *(k for k in after if k not in before)]}
    return after if later and before != after else before


def conflicts(before, after, path: str = "details") -> list[str]:
    """The paths of scalars that two revisions both have and that differ; members and elements only one has are none."""
    if isinstance(before, dict) and isinstance(after, dict):
        return [x for k in before if k in after for x in conflicts(before[k], after[k], f"{path}.{k}")]
    if isinstance(before, list) and isinstance(after, list):
        return [x for i, (a, b) in enumerate(zip(before, after)) for x in conflicts(a, b, f"{path}[{i}]")]
    return [] if before == after and isinstance(before, bool) == isinstance(after, bool) else [path]


_MERGED = "action_key string, revisions bigint, first_delivery bigint, last_delivery bigint, finality int, details string, accounts array<string>, conflicts array<string>"


def merged_revisions(actions: DataFrame, order: str = "delivery_id") -> DataFrame:
    """One row per action id (its bytes, in hex) of all revisions, merged in the order of delivery.

    Details are merged deeply, where revisions differ that of higher (or equal, later) finality holds, and ``conflicts`` lists the
    paths that ever changed. Accounts are the union in the order first seen, finality the highest. Unreadable or missing
    details count as none. One pass over rows sorted by action holds one merged action, however many revisions it has. Rows without an id are left out.
    """
    rows = actions.select(id_bytes(F.col("action_id")).alias("action_key"), order, F.coalesce("finality", F.lit(0)).alias("finality"), "details", "accounts").where("action_key is not null")
    rows = rows.repartition("action_key").sortWithinPartitions("action_key", order)

    def read(text: str | None):
        try:
            return json.loads(text) if text is not None else None
        except (ValueError, RecursionError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        names = [c.split()[0] for c in _MERGED.split(", ")]
        out, now = [], None

        def give() -> None:
            if now is not None:
                details = None if now[5] is None else json.dumps(now[5], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
                out.append((*now[:5], details, list(now[6]), sorted(now[7])))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for key, at, finality, text, accounts in zip(*(c.to_pylist() for c in batch.columns)):
                value, seen = read(text), [a for a in accounts or [] if a is not None]
                if now is None or now[0] != key:
                    give()
                    now = [key, 1, at, at, finality, value, dict.fromkeys(seen), set()]
                    continue
                if now[5] is None or value is None:
                    now[5] = value if now[5] is None else now[5]
                else:
                    now[7] |= set(conflicts(now[5], value))
                    now[5] = merged_json(now[5], value, finality >= now[4])
                now[6] |= dict.fromkeys(seen)
                now[1], now[3], now[4] = now[1] + 1, at, max(now[4], finality)
            if len(out) >= 5000:
                yield made()
                out.clear()
        give()
        yield made()

    return rows.mapInArrow(run, _MERGED)


@F.pandas_udf(T.StringType())
def address_identity(address: pd.Series) -> pd.Series:
    """One text for every writing of an account: workchain:hex of a raw address or of a friendly one with a right checksum; ``wire:`` and the text for anything else."""

    def of(a: str | None) -> str | None:
        if a is None:
            return None
        if m := re.fullmatch(r"(-?\d+):([a-fA-F0-9]{64})", a):
            return f"{int(m[1])}:{m[2].lower()}"
        if re.fullmatch(r"[A-Za-z0-9_+/-]{48}", a):
            raw = base64.b64decode(a.replace("-", "+").replace("_", "/"))
            if raw[0] & 0x7F in (0x11, 0x51) and binascii.crc_hqx(raw[:34], 0) == int.from_bytes(raw[34:], "big"):
                return f"{int.from_bytes(raw[1:2], 'big', signed=True)}:{raw[2:34].hex()}"
        return f"wire:{a}"

    return address.map(of)


def collected(rows: DataFrame, limit: int, most_pages: int = 1000, most_rows: int = 250_000, snapshot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(actions, summary) of recorded pages of at most ``limit`` rows: (page_no from 0, place, action_key, end_utime).

    Pages count up to the first that isn't full, and at most ``most_pages`` and whole pages of ``most_rows``; rows that ended after
    ``snapshot`` are left out, so that pages of a growing list don't shift. An action that several pages hold is kept where it came first, with the number
    of its copies. summary, one row: pages, rows, actions, duplicates, complete (the last page wasn't full) and next_offset.
    """
    sizes = rows.groupBy("page_no").agg(F.count("*").alias("size"))
    ends = sizes.agg(F.min(F.when(F.col("size") < limit, F.col("page_no"))).alias("short"), F.max("page_no").alias("last")).first()
    allowed = min(most_pages, most_rows // limit)
    stop = min(x for x in (ends["short"], ends["last"], allowed - 1) if x is not None)
    held = rows.where(F.col("page_no") <= stop)
    kept = held if snapshot is None else held.where(F.col("end_utime") <= snapshot)
    once = kept.groupBy("action_key").agg(F.count("*").alias("copies"), F.min(F.struct("page_no", "place")).alias("m")).select("action_key", "copies", "m.page_no", "m.place")
    counts = kept.agg(F.count("*").alias("rows"), F.count_distinct("action_key").alias("actions"))
    complete = ends["short"] is not None and ends["short"] <= stop
    summary = counts.select(F.lit(stop + 1).alias("pages"), "rows", "actions", (F.col("rows") - F.col("actions")).alias("duplicates"), F.lit(complete).alias("complete"), F.lit((stop + 1) * limit).alias("next_offset"))
    return once, summary
