"""Market events: validation, canonical form and identity, legacy records as events, and lifecycles of listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namequarry.functions.handles import handle
from namequarry.functions.instants import iso_ms
from namequarry.operators.merge import merged_events, sole_alias, tolerant_match
from namequarry.operators.validate import errors

# fixed values: the closed vocabularies and text forms of an event
EVENT_TYPES = ("sale", "listed", "bid", "cancelled", "expired", "transfer", "mint")
SALE_FORMATS = ("auction", "fixed-price", "offer", "unknown")
MARKET_PHASES = ("primary", "secondary", "unknown")
GRADES = ("high", "medium", "low")
ROLES = ("seller", "buyer", "bidder", "from", "to", "owner")
SOURCE = "^[a-z0-9][a-z0-9._-]{0,63}$"
PARSER = "^[a-z0-9][a-z0-9._:/-]{0,127}$"
VIEW = "^[a-z0-9][a-z0-9._-]{0,119}$"
HASH = "^sha256:[a-f0-9]{64}$"
TX_HASH = "^[A-Za-z0-9+/_=-]{16,128}$"
RAW_ADDRESS = "^-?[0-9]+:[a-f0-9]{64}$"
FRIENDLY_ADDRESS = "^[A-Za-z0-9_-]{48}$"
AMOUNTS = ("priceTon", "askTon", "reserveTon", "bidTon", "feesTon")


def web_address(raw: Column) -> Column:
    """An http or https address of at most 2048 characters with its scheme and host in lower case, without a default port, with a path; else null."""
    t = F.trim(raw)
    part = lambda n: F.regexp_extract(t, r"^(?i)(https?)://([^/?#\s:@]+)(:\d{1,5})?([/?#]\S*)?$", n)
    scheme, port, rest = F.lower(part(1)), part(3), part(4)
    port = F.when(((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")), "").otherwise(port)
    return F.when((part(1) != "") & (F.length(t) <= 2048), F.concat(scheme, F.lit("://"), F.lower(part(2)), port, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def chain_address(raw: Column) -> Column:
    """A raw address in lower case or a friendly one as it is; else null."""
    t = F.trim(raw)
    return F.when(F.lower(t).rlike(RAW_ADDRESS), F.lower(t)).when(t.rlike(FRIENDLY_ADDRESS), t)


def _text(raw: Column, pattern: str | None = None, most: int = 240, lower: bool = False) -> Column:
    """Trimmed text of 1 to ``most`` characters that has the form; else null."""
    t = F.trim(F.lower(raw) if lower else raw)
    ok = F.length(t).between(1, most)
    return F.when(ok & t.rlike(pattern) if pattern else ok, t)


def provenance(p: Column, fields: list[str]) -> Column:
    """Provenance in canonical form, each field that has no valid value null; null as a whole without a valid source."""
    made = {
        "source": _text(p["source"], SOURCE, 64, True), "parser": _text(p["parser"], PARSER, 128, True),
        **{u: web_address(p[u]) for u in ("sourceUrl", "requestedUrl", "assetUrl")},
        "page": F.when(p["page"] > 0, p["page"]), "rowIndex": F.when(p["rowIndex"] >= 0, p["rowIndex"]),
        "marketView": _text(p["marketView"], VIEW, 120, True) if "marketView" in fields else F.lit(None).cast("string"),
        "sourceEventId": _text(p["sourceEventId"], r"^[^\x00-\x1f\x7f]+$") if "sourceEventId" in fields else F.lit(None).cast("string"),
        "snapshotHash": _text(p["snapshotHash"], HASH, 71) if "snapshotHash" in fields else F.lit(None).cast("string"),
    }
    return F.when(made["source"].isNotNull(), F.struct(*(c.alias(k) for k, c in made.items())))


def event_id(source: Column, kind: Column, username: Column, source_event: Column, tx_hash: Column, event_ms: Column) -> Column:
    """The stable id of an event: of its source's own id, else its transaction, else its exact time; without any of them that of a cluster of observations."""
    occurrence = F.coalesce(F.concat(F.lit("source-event:"), source_event), F.concat(F.lit("tx:"), tx_hash), F.concat(F.lit("event:"), iso_ms(event_ms)))
    known = F.concat_ws("\u0000", F.lit("market-event-v1"), source, kind, username, occurrence)
    cluster = F.concat_ws("\u0000", F.lit("market-observation-cluster-v1"), source, kind, username)
    ok = source.isNotNull() & kind.isNotNull() & username.isNotNull()
    return F.when(ok, F.concat(F.lit("market:v1:"), F.substring(F.sha2(F.when(occurrence.isNotNull(), known).otherwise(cluster), 256), 1, 40)))


def canonical_events(events: DataFrame) -> DataFrame:
    """Events in canonical form with all their ``errors``; a valid one has none.

    events: the columns of a market event, eventAt and observedAt also as event_ms and observed_ms (null: no instant).
    Absent fields are null and allowed unless a rule asks for them. identityKind, the event id and the effective time (event_ms, else
    observed_ms) are derived; a given id or kind that differs is an error. Extra columns are kept. Nothing is dropped.
    """
    c = F.col
    fields = events.schema["provenance"].dataType.fieldNames()
    p = provenance(c("provenance"), fields)
    rows = events.withColumns({
        "__p": p, "__user": handle(c("username")), "__kind": F.when(c("eventType").isin(*EVENT_TYPES), c("eventType")), "__tx": _text(c("txHash"), TX_HASH, 128),
        "__item": chain_address(c("nftItemAddress")), "__collection": chain_address(c("nftCollectionAddress")),
        "__format": F.coalesce(c("saleFormat"), F.lit("unknown")), "__phase": F.coalesce(c("marketPhase"), F.lit("unknown")),
    })
    rows = rows.withColumn("__identity", F.when(c("event_ms").isNotNull() | c("__tx").isNotNull() | c("__p.sourceEventId").isNotNull(), "event").otherwise("observation-cluster"))
    rows = rows.withColumn("__id", event_id(c("__p.source"), c("__kind"), c("__user"), c("__p.sourceEventId"), c("__tx"), c("event_ms")))
    kind, graded = c("__kind"), c("confidence")
    absent_or = lambda raw, ok: raw.isNull() | ok
    none = lambda *names: F.coalesce(*(c(n) for n in names)).isNull()
    rules = {
        "schemaVersion": absent_or(c("schemaVersion"), c("schemaVersion") == 1), "eventType": kind.isNotNull(), "username": c("__user").isNotNull(), "observedAt": c("observed_ms").isNotNull(),
        "eventAt": absent_or(c("eventAt"), c("event_ms").isNotNull()), "order": absent_or(c("event_ms"), absent_or(c("observed_ms"), c("event_ms") <= c("observed_ms"))),
        **{a: absent_or(c(a), (c(a) >= 0 if a == "feesTon" else c(a) > 0) & (c(a) < float("inf"))) for a in AMOUNTS},
        "saleFormat": c("__format").isin(*SALE_FORMATS), "marketPhase": c("__phase").isin(*MARKET_PHASES), "confidence": graded.isin(*GRADES), "txHash": absent_or(c("txHash"), c("__tx").isNotNull()),
        "nftItemAddress": absent_or(c("nftItemAddress"), c("__item").isNotNull()), "nftCollectionAddress": absent_or(c("nftCollectionAddress"), c("__collection").isNotNull()),
        **{f"counterparties.{r}": absent_or(c("counterparties")[r], F.trim(c("counterparties")[r]).rlike(HASH)) for r in ROLES},
        **{f"provenance.{f}": absent_or(c("provenance")[f], c("__p")[f].isNotNull()) for f in fields if f != "source"}, "provenance.source": c("__p").isNotNull(),
        "identityKind": absent_or(c("identityKind"), c("identityKind") == c("__identity")),
        "salePrice": ~kind.eqNullSafe(F.lit("sale")) | c("priceTon").isNotNull(), "saleTime": ~(kind.eqNullSafe(F.lit("sale")) & graded.eqNullSafe(F.lit("high"))) | c("event_ms").isNotNull(),
        "saleEvidence": ~(kind.eqNullSafe(F.lit("sale")) & graded.eqNullSafe(F.lit("high"))) | c("__tx").isNotNull() | c("__p.sourceEventId").isNotNull(),
        "listedAsk": ~kind.eqNullSafe(F.lit("listed")) | ~none("askTon", "reserveTon"), "bid": ~kind.eqNullSafe(F.lit("bid")) | c("bidTon").isNotNull(),
        "onlySalesPriced": kind.isNull() | (kind == "sale") | c("priceTon").isNull(), "moveAmounts": ~F.coalesce(kind.isin("transfer", "mint"), F.lit(False)) | none("askTon", "reserveTon", "bidTon"),
        "fixedPrice": (c("__format") != "fixed-price") | none("reserveTon", "bidTon"), "eventId": absent_or(c("eventId"), F.trim("eventId") == c("__id")),
    }
    rows = rows.withColumn("errors", errors(rules))
    parties = c("counterparties")
    return rows.withColumns({
        "event_id": c("__id"), "identityKind": c("__identity"), "eventType": kind, "username": c("__user"), "saleFormat": c("__format"), "marketPhase": c("__phase"), "txHash": c("__tx"), "nftItemAddress": c("__item"),
        "nftCollectionAddress": c("__collection"), "counterparties": F.when(F.coalesce(*(parties[r] for r in ROLES)).isNotNull(), F.struct(*(F.trim(parties[r]).alias(r) for r in ROLES))),
        "provenance": c("__p"), "effective_ms": F.coalesce("event_ms", "observed_ms"),
    }).drop("__p", "__user", "__kind", "__tx", "__item", "__collection", "__format", "__phase", "__identity", "__id")


def sales_as_events(sold: DataFrame) -> DataFrame:
    """Sold records (with event_ms of saleAt and observed_ms of scrapedAt) as sale events for ``canonical_events``.

    Without an exact time the grade is low; a high grade needs an id, else, as for unknown grades, it is medium. A source without a valid form is the first market's.
    """
    c = F.col
    source = F.coalesce(_text(c("source"), SOURCE, 64, True), F.lit("fragment"))
    grade = F.when(c("event_ms").isNull(), "low").when(c("confidence").isin("medium", "low") | ((c("confidence") == "high") & c("eventId").isNotNull()), c("confidence")).otherwise("medium")
    p, text = c("provenance"), F.lit(None).cast("string")
    number = F.lit(None).cast("double")
    rest = [x for x in sold.columns if x not in ("eventId", "confidence", "provenance", "source", "view", "saleAt", "scrapedAt", "username", "priceTon", "event_ms", "observed_ms")]
    return sold.select(
        *rest, F.lit(1).alias("schemaVersion"), text.alias("eventId"), text.alias("identityKind"), F.lit("sale").alias("eventType"), "username", F.when(c("event_ms").isNotNull(), c("saleAt")).alias("eventAt"), F.col("scrapedAt").cast("string").alias("observedAt"), "event_ms", "observed_ms", "priceTon",
        *(number.alias(a) for a in AMOUNTS[1:]), text.alias("saleFormat"), text.alias("marketPhase"), text.alias("txHash"), text.alias("nftItemAddress"), text.alias("nftCollectionAddress"), F.struct(*(text.alias(r) for r in ROLES)).alias("counterparties"),
        F.struct(source.alias("source"), F.coalesce(p["parser"], F.lit("legacy-sold-record")).alias("parser"), p["sourceUrl"].alias("sourceUrl"), p["requestedUrl"].alias("requestedUrl"), p["assetUrl"].alias("assetUrl"), p["page"].alias("page"), p["rowIndex"].alias("rowIndex"), c("view").alias("marketView"), c("eventId").alias("sourceEventId")).alias("provenance"),
        grade.alias("confidence"),
    )


def merged(canonical: DataFrame) -> DataFrame:
    """Valid canonical events once per id: agreed values, the highest grade, the fields in conflict, and the earliest observation. ``unknown`` says nothing."""
    known = lambda n: F.nullif(n, F.lit("unknown")).alias(n)
    rows = canonical.where(F.size("errors") == 0).select("event_id", "eventType", "username", "event_ms", "observed_ms", *AMOUNTS, known("saleFormat"), known("marketPhase"), "txHash", "nftItemAddress", "nftCollectionAddress", "confidence")
    one = merged_events(rows, "event_id", [*AMOUNTS], ["eventType", "username", "event_ms", "saleFormat", "marketPhase", "txHash", "nftItemAddress", "nftCollectionAddress"], "confidence")
    return one.join(rows.groupBy("event_id").agg(F.min("observed_ms").alias("observed_ms")), "event_id").withColumn("effective_ms", F.coalesce("event_ms", "observed_ms"))


# ---- lifecycles

# fixed value: which of several events at one time comes first
TURN = {"listed": 0, "bid": 1, "sale": 2, "transfer": 3, "cancelled": 4, "expired": 5}
_LIFE = "outcome string, id string, username string, asset string, status string, ask double, listed_ms bigint, last_ms bigint, ended_ms bigint, sold_ms bigint, sale_price double"


def asset_events(events: DataFrame) -> DataFrame:
    """Events (event_id, username, eventType, event_ms, observed_ms, askTon, reserveTon, priceTon, txHash, nftItemAddress, source, source_event) with the asset they are of and the identity of their listing.

    The asset is the item's address, else the one address that the name was ever seen with, else the name. Events without an exact time are left out.
    """
    alias = sole_alias(events.select("username", F.col("nftItemAddress").alias("__item")), "username", "__item")
    rows = events.where("event_ms is not null and username is not null").join(alias, "username", "left")
    item = F.coalesce("nftItemAddress", "__item")
    identity = F.coalesce(F.concat("source", F.lit(":source-event:"), "source_event"), F.concat("source", F.lit(":tx:"), "txHash"))
    turn = F.coalesce(F.create_map(*(F.lit(x) for kv in TURN.items() for x in kv))[F.col("eventType")], F.lit(6))
    return rows.select(F.when(item.isNotNull(), F.concat(F.lit("nft:"), item)).otherwise(F.concat(F.lit("username:"), "username")).alias("asset"), F.col("event_ms").alias("at"), turn.alias("turn"), "observed_ms", "event_id", "username", F.col("eventType").alias("kind"), F.coalesce("askTon", "reserveTon").alias("ask"), F.col("priceTon").alias("price"), F.col("source").alias("market"), identity.alias("identity"))


class _Asset:
    """The open listings of one asset: each event either opens, confirms, replaces or ends one, or is put down as unmatched, ambiguous or invalid."""

    def __init__(self, asset: str, out: list):
        self.asset, self.out, self.open = asset, out, []

    def _give(self, item: dict, outcome: str = "listing") -> None:
        self.out.append((outcome, *(item.get(k) for k in ("id", "username")), self.asset, *(item.get(k) for k in ("status", "ask", "listed", "last", "ended", "sold", "price"))))

    def _end(self, item: dict, status: str, at: int, price: float | None = None) -> None:
        self.open.remove(item)
        self._give(item | {"status": status, "last": at, "ended": at, "sold": at if status == "sold" else None, "price": price})

    def step(self, at: int, event: str, username: str, kind: str, ask: float | None, price: float | None, market: str, identity: str | None) -> None:
        same = [x for x in self.open if identity is not None and x["identity"] == identity]
        here = [x for x in self.open if x["market"] == market]
        note = {"id": event, "username": username, "status": kind, "listed": at, "ask": ask}
        if kind == "listed":
            if ask is None or not 0 < ask < float("inf") or len(same) > 1:
                return self._give(note, "invalid")
            if same and abs(same[0]["ask"] - ask) <= 1e-12 * max(1.0, same[0]["ask"], ask):
                same[0]["last"] = at  # seen again at the same price
                return None
            if same:
                self._end(same[0], "cancelled", at)
                here = [x for x in self.open if x["market"] == market]
            if len(here) == 1:
                self._end(here[0], "cancelled", at)
            self.open.append(note | {"status": "active", "last": at, "market": market, "identity": identity})
        elif kind in ("sale", "cancelled", "expired", "transfer"):
            fit = same or here or self.open
            if len(fit) != 1:
                return self._give(note, "ambiguous" if fit else "unmatched")
            self._end(fit[0], {"sale": "sold", "transfer": "cancelled"}.get(kind, kind), at, price if kind == "sale" else None)
        return None

    def close(self) -> None:
        for x in self.open:
            self._give(x)


def lifecycles(events: DataFrame) -> DataFrame:
    """Listings of ``asset_events`` from their opening to their end: outcome ``listing``; and events that don't fit: ``unmatched``, ``ambiguous``, ``invalid``.

    An end closes a listing only if exactly one is open that fits: by identity, else of its market, else any. A new price or a second
    listing in the market closes the one before. Listings that never end stay active as last seen. A pass over rows sorted by asset
    holds the open listings of one asset, however long its history; that order is what the operator is about, so one asset is one pass.
    """
    order = ["asset", "at", "turn", "observed_ms", "event_id"]
    rows = events.select(*order, "username", "kind", "ask", "price", "market", "identity").repartition("asset").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.float64()] + [pa.int64()] * 4 + [pa.float64()]
        names = [c.split()[0] for c in _LIFE.split(", ")]
        out: list[tuple] = []
        now: _Asset | None = None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for asset, at, _, _, event, *rest in zip(*(col.to_pylist() for col in batch.columns)):
                if now is None or now.asset != asset:
                    if now is not None:
                        now.close()
                    now = _Asset(asset, out)
                now.step(at, event, *rest)
            if len(out) >= 10_000:
                yield made()
                out.clear()
        if now is not None:
            now.close()
        yield made()

    return rows.mapInArrow(run, _LIFE)


def as_listings(lives: DataFrame) -> DataFrame:
    """Lifecycles as the listings that ``estimates.listing_estimates`` takes."""
    of = lives.where("outcome = 'listing'")
    return of.select("id", F.col("username").alias("name"), "ask", F.lit(None).cast("string").alias("segment"), "status", "listed_ms", F.col("last_ms").alias("observed_ms"), "ended_ms", "sold_ms", "sale_price")


# ---- sold records

def valid_sales(sold: DataFrame) -> DataFrame:
    """Sold records (row_id, username, priceTon, saleAt, event_ms, observed_ms, source, confidence) in canonical form, with their ``errors``.

    A name of 4 to 32 letters, digits and underscores, a positive price, a time of observation, and a sale time that is one and no later are needed. Without a
    sale time the grade is low, whatever it was, and there is no id; else the id follows from source, name and time.
    """
    c = F.col
    user = F.lower("username")
    rules = {
        "username": user.rlike("^[a-z][a-z0-9_]{3,31}$"), "priceTon": (c("priceTon") > 0) & (c("priceTon") < float("inf")), "scrapedAt": c("observed_ms").isNotNull(),
        "saleAt": c("saleAt").isNull() | c("event_ms").isNotNull(), "order": c("event_ms").isNull() | c("observed_ms").isNull() | (c("event_ms") <= c("observed_ms")),
    }
    grade = F.when(c("confidence").isin(*GRADES), F.when(c("event_ms").isNull(), "low").otherwise(c("confidence")))
    at = F.when(c("event_ms").isNotNull(), F.sha2(F.concat_ws("\u0000", F.coalesce("source", F.lit("unknown")), user, F.concat(F.lit("sale:"), iso_ms(c("event_ms")))), 256))
    return sold.select("row_id", user.alias("username"), "priceTon", "event_ms", "observed_ms", "source", grade.alias("confidence"), F.concat(F.lit("sold:"), F.substring(at, 1, 32)).alias("event_id"), errors(rules).alias("errors"))


def sold_history(valid: DataFrame) -> DataFrame:
    """Valid sales as one history: (event_id, username, price, event_ms, observed_ms, confidence, n, conflict).

    Dated sales once per id, as last observed; ``conflict`` where their prices differ. An undated record of the name and price of a
    dated sale is that sale seen before its time was known; the others leave one row a name, the last observed. The result doesn't depend on any order of rows.
    """
    ok = valid.where(F.size("errors") == 0)
    last = F.max_by(F.struct("priceTon", "confidence"), F.struct("observed_ms", "row_id")).alias("l")
    dated = ok.where("event_id is not null").groupBy("event_id", "username", "event_ms").agg(F.count("*").alias("n"), F.max("observed_ms").alias("observed_ms"), F.min("priceTon").alias("lo"), F.max("priceTon").alias("hi"), last)
    dated = dated.select("event_id", "username", F.col("l.priceTon").alias("price"), "event_ms", "observed_ms", "l.confidence", "n", (F.col("hi") - F.col("lo") > 1e-12 * F.greatest(F.lit(1.0), F.col("hi"))).alias("conflict"))
    bare = ok.where("event_id is null").withColumnRenamed("priceTon", "price")
    known = tolerant_match(bare, dated.select("username", "price"), "username", "price").select("row_id").distinct()
    loose = bare.join(known, "row_id", "left_anti").groupBy("username").agg(F.count("*").alias("n"), F.max("observed_ms").alias("observed_ms"), F.max_by(F.struct("price", "confidence"), F.struct("observed_ms", "row_id")).alias("l"))
    text = F.lit(None).cast("string")
    return dated.unionByName(loose.select(text.alias("event_id"), "username", "l.price", F.lit(None).cast("bigint").alias("event_ms"), "observed_ms", "l.confidence", "n", F.lit(False).alias("conflict")))
