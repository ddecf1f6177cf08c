"""New batches checked for duplicates and near-duplicates against all history through an incremental inverted index."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from namequarry.llm.components import component_stars
from namequarry.session import Files, work_dir, written
from namequarry.skew import join_counted

TIME_MS = 600_000
PRICE_SHARE = 0.01
FANOUT = 8  # generations of one level that are compacted into one
PER_BUCKET = 500_000  # tokens of the first batch that a bucket takes
_SLACK = 1e-11  # for decimal prices that lie exactly one percent apart

# one generation is one table; ``kind`` says what a row is, and each kind uses some of the columns
_ROW = "row_id bigint, batch_no int, kind string, key string, x bigint, y bigint, tc bigint, pc bigint, n bigint, root bigint, t0 bigint, t1 bigint, p0 double, p1 double"
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]
_TOKEN = ["kind", "key", "x", "y"]
_RANGES = ["t0", "t1", "p0", "p1"]


def _shaped(df: DataFrame, **given: Column) -> DataFrame:
    """``df`` as rows of a generation: the columns it lacks are null."""
    kinds = dict(c.split() for c in _ROW.split(", "))
    have = set(df.columns)
    return df.select(*(given[c].cast(kinds[c]).alias(c) if c in given else F.col(c) if c in have else F.lit(None).cast(kinds[c]).alias(c) for c in _COLUMNS))


class SaleIndex:
    """An inverted index over records of sales: rare token -> postings, partitioned by token.

    A record's tokens are its id (``e``), its name in a ten-minute cell (``t``) and its name in a one-percent price
    cell (``p``). Sharing the id is a link; the other two must overlap both (with the cell itself or a neighbour of
    it), so of these a prefix of one is enough: a record is posted under the one that is rarer by the stored
    document frequencies, and a batch probes both of its own with their neighbours, which finds a posting whichever
    token it was put under and however frequencies have moved since. What meets is filtered by the ranges of price
    (the length filter) and time that a posting carries, and the overlap of the other token is verified.

    Any two records in one cell (name, time, price) are linked, so a cell is one posting whatever it holds: copies and dense cells
    yield no pairs, and a token has at most as many postings as there are price cells or ten-minute cells beside it. Two neighbouring cells are linked or not by their
    ranges; where they differ in both time and price, one ordered pass over their stored points decides.

    A batch is appended as one folder (frequencies, postings, points, roots of its rows, merged roots), made
    visible by one atomic replacement of the manifest. History is never rewritten by a batch: FANOUT
    generations of one level are compacted into one of the next, so each row is copied a logarithmic number of
    times. Only the buckets that hold tokens of the batch are read. A batch that failed can be taken in again; one
    that succeeded under a ``label`` is not taken in twice.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.buckets, self.fanout = spark, path or work_dir(spark, "sales"), buckets, fanout
        self.files = Files(spark, self.path)

    def _state(self) -> dict:
        at = f"{self.path}/manifest.json"
        return json.loads(self.files.read(at)) if self.files.exists(at) else {"generations": [], "labels": {}, "buckets": None, "merged": False}

    def _read(self, state: dict, part: str, touched: list[int] | None = None) -> DataFrame:
        """All rows of one part (freq, post, points, rows, merges), of the buckets ``touched`` if given."""
        paths = [p for g in state["generations"] if self.files.exists(p := f"{self.path}/{g['name']}/part={part}")]
        if not paths:
            return self.spark.createDataFrame([], _ROW)
        found = self.spark.read.schema(_ROW + ", gen string, part string, bucket int").option("basePath", self.path).parquet(*paths)
        return (found if touched is None else found.where(F.col("bucket").isin(touched))).select(*_COLUMNS)

    def _bucket(self, buckets: int) -> Column:
        """Tokens by their key and a coarse place, so that neighbouring cells mostly share a bucket and a frequent name has many."""
        place = F.when(F.col("kind") == "p", F.floor(F.col("y") / 64)).otherwise(F.floor(F.col("x") / 4320))
        return F.pmod(F.xxhash64("kind", "key", place, "row_id"), F.lit(buckets)).cast("int")

    def _save(self, parts: dict[str, DataFrame], buckets: int) -> str:
        """Write the parts of a generation as one table; gives its name. A name is used once, so what a failed run left is never in the way."""
        name = f"gen={uuid.uuid4().hex}"
        whole = None
        for part, df in parts.items():
            df = df.withColumns({"part": F.lit(part), "bucket": self._bucket(buckets)})
            whole = df if whole is None else whole.unionByName(df)
        whole.hint("rebalance", "part", "bucket").write.partitionBy("part", "bucket").parquet(f"{self.path}/{name}")
        return name

    def _current(self, df: DataFrame, state: dict) -> DataFrame:
        """``df`` with its root as of now. Merges only ever lower a root, so of all that a root was merged into the smallest holds."""
        if not state["merged"]:
            return df
        merges = self._read(state, "merges").groupBy(F.col("row_id").alias("old")).agg(F.min("root").alias("new"))
        return df.join(merges, df["root"] == F.col("old"), "left").withColumn("root", F.coalesce("new", "root")).drop("old", "new")

    def assigned(self) -> DataFrame:
        """All records taken in so far: row_id, batch_no, root (the smallest row_id of its sale)."""
        state = self._state()
        return self._current(self._read(state, "rows").select("row_id", "batch_no", "root"), state)

    def ingest(self, batch: DataFrame, label: str | None = None) -> DataFrame:
        """Take in (row_id bigint, batch_no int, event_id string, name string, price double, ms bigint); gives row_id, batch_no and root.

        Null ids, names, prices and times link nothing; nor do prices that aren't positive numbers. A record without
        any token is its own sale. Repeated rows share a root. Extra columns are dropped. ``batch`` is read several
        times, so it should be a stored table.
        """
        state = self._state()
        if label is not None and label in state["labels"]:
            return self._read({"generations": [{"name": state["labels"][label]}]}, "rows").select("row_id", "batch_no", "root")
        work = f"{self.path}/work-{uuid.uuid4().hex[:12]}"
        complete = (F.col("price") > 0) & ~F.isnan("price") & (F.col("price") < float("inf")) & F.col("name").isNotNull() & F.col("ms").isNotNull()
        cells = {"tc": F.floor(F.col("ms") / TIME_MS), "pc": F.floor(F.log(F.col("price")) / -math.log(1 - PRICE_SHARE))}
        rows = batch.select("row_id", "batch_no", "event_id", "name", "price", "ms").withColumns({k: F.when(complete, c) for k, c in cells.items()})

        # document frequencies of the batch's tokens; c is the cell that t and p make together
        none = F.lit(0).cast("bigint")
        token = lambda kind, key, x, y: F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), x.alias("x"), y.alias("y"))
        of_cell = token("c", "name", F.col("tc"), F.col("pc")), token("t", "name", F.col("tc"), none), token("p", "name", none, F.col("pc"))
        each = F.array_compact(F.array(*(F.when(F.col("tc").isNotNull(), t) for t in of_cell), F.when(F.col("event_id").isNotNull(), token("e", "event_id", none, none))))
        counted = rows.select("row_id", "ms", "price", F.inline(each)).groupBy(*_TOKEN).agg(
            F.min("row_id").alias("rep"), F.count("*").alias("n"), F.min("ms").alias("t0"), F.max("ms").alias("t1"), F.min("price").alias("p0"), F.max("price").alias("p1"),
        )
        size = Observation()
        tokens = written(counted.observe(size, F.count("*").alias("tokens"), F.sum("n").alias("total"), F.max("n").alias("most")), f"{work}/tokens")
        known = (size.get["total"] or 0, size.get["most"] or 0)
        buckets = state["buckets"] or self.buckets or 1 << max(4, math.ceil(math.log2(max(1, size.get["tokens"] / PER_BUCKET))))

        probe = self._probe(tokens)
        touched = None
        if state["generations"] and size.get["tokens"] < 4 * buckets:  # few tokens: most buckets needn't be read
            touched = sorted(r[0] for r in probe.withColumn("row_id", F.lit(None).cast("bigint")).select(self._bucket(buckets)).distinct().collect())  # at most ``buckets`` numbers
        near = written(self._met(probe, tokens, state, touched), f"{work}/near")
        links = near.where("sure and u <> v").select("u", "v").unionByName(self._diagonal(near.where("not sure"), rows, state, touched))
        # records to the first of their id and of their cell; copies are leaves of one star
        groups = tokens.where("kind in ('c', 'e') and n > 1").select(*_TOKEN, "rep", "n")
        own = rows.select("row_id", F.inline(F.filter(each, lambda t: t["kind"].isin("c", "e"))))
        links = links.unionByName(join_counted(own, groups, _TOKEN, "n", known=known).select(F.col("row_id").alias("u"), F.col("rep").alias("v")))
        stars = component_stars(links)

        rooted = tokens.where("kind in ('c', 'e')").join(stars, F.col("rep") == F.col("u"), "left").withColumn("root", F.coalesce("v", "rep")).drop("u", "v")
        # the prefix: the rarer of the two tokens by all frequencies stored so far
        df = lambda kind: F.sum(F.when(F.col("token") == kind, F.col("n")))
        order = near.where("freq").groupBy("key", "tc", "pc").agg((df("p") < df("t")).alias("by_price"))
        places = rooted.where("kind = 'c'").withColumnsRenamed({"x": "tc", "y": "pc"}).join(order, ["key", "tc", "pc"])
        by = F.col("by_price")
        merged = near.where("old").select(F.col("v").alias("root")).distinct().join(stars, F.col("root") == F.col("u")).select(F.col("u").alias("row_id"), F.col("v").alias("root"))
        if state["merged"]:
            before = self._read(state, "merges").groupBy("row_id").agg(F.min("root").alias("root"))
            merged = merged.unionByName(before.join(merged.select(F.col("row_id").alias("root"), F.col("root").alias("to")), "root").select("row_id", F.col("to").alias("root")))
        name = self._save({
            "freq": _shaped(tokens.where("kind in ('t', 'p')").drop(*_RANGES)),
            "post": _shaped(rooted.where("kind = 'e'").drop("n", *_RANGES)).unionByName(_shaped(places.drop("n"), kind=F.when(by, F.lit("p")).otherwise("t"), x=F.when(by, 0).otherwise(F.col("tc")), y=F.when(by, F.col("pc")).otherwise(0))),
            "points": _shaped(rows.where("tc is not null").select(F.lit("t").alias("kind"), F.col("name").alias("key"), F.col("tc").alias("x"), F.col("pc").alias("y"), F.col("ms").alias("t0"), F.col("price").alias("p0")).distinct()),
            "rows": _shaped(rows.select("row_id", "batch_no").join(stars, F.col("row_id") == F.col("u"), "left").withColumn("root", F.coalesce("v", "row_id"))),
            "merges": _shaped(merged),
        }, buckets)
        merges = self.files.exists(f"{self.path}/{name}/part=merges")
        state = {"generations": [*state["generations"], {"name": name, "level": 0}], "labels": state["labels"] | ({label: name} if label is not None else {}), "buckets": buckets, "merged": state["merged"] or merges}
        self.files.put(f"{self.path}/manifest.json", json.dumps(state))
        self.files.delete(work)
        taken = self._read({"generations": [{"name": name}]}, "rows").select("row_id", "batch_no", "root")
        self._compact()
        return taken

    def _compact(self) -> None:
        """While a level has ``fanout`` generations, make them one of the next: one row a posting, frequency, point and merge."""
        while True:
            state = self._state()
            by_level: dict[int, list[dict]] = {}
            for g in state["generations"]:
                by_level.setdefault(g["level"], []).append(g)
            level = next((k for k, gens in sorted(by_level.items()) if len(gens) >= self.fanout), None)
            if level is None:
                return
            some = state | {"generations": by_level[level]}
            post = self._current(self._read(some, "post"), state)
            parts = {
                "freq": _shaped(self._read(some, "freq").groupBy(*_TOKEN).agg(F.sum("n").alias("n"))),
                "post": _shaped(post.groupBy(*_TOKEN, "tc", "pc").agg(F.min("root").alias("root"), *((F.min if c[1] == "0" else F.max)(c).alias(c) for c in _RANGES))),
                "points": self._read(some, "points").distinct(),
                "rows": self._read(some, "rows"),
                "merges": _shaped(self._read(some, "merges").groupBy("row_id").agg(F.min("root").alias("root"))),
            }
            name = self._save(parts, state["buckets"])
            rest = [g for g in state["generations"] if g["level"] != level]
            self.files.put(f"{self.path}/manifest.json", json.dumps(state | {"generations": [{"name": name, "level": level + 1}, *rest]}))

    def vacuum(self) -> None:
        """Delete what no reader of the present manifest needs: compacted generations and what failed runs left."""
        state = self._state()
        keep = {g["name"] for g in state["generations"]} | set(state["labels"].values()) | {"manifest.json"}
        for name in self.files.names(self.path):
            if name not in keep:
                self.files.delete(f"{self.path}/{name}")

    def _probe(self, tokens: DataFrame) -> DataFrame:
        """The tokens that a batch looks for: its ids, and for each of its cells both tokens with their neighbours, and the cells after it."""
        zero = F.lit(0).cast("bigint")
        step = lambda kind, dx, dy: F.struct(F.lit(kind).alias("kind"), (F.col("x") + dx if kind != "p" else zero).alias("x"), (F.col("y") + dy if kind != "t" else zero).alias("y"), F.lit(dx == 0 and dy == 0).alias("own"))
        around = [step("t", d, 0) for d in (-1, 0, 1)] + [step("p", 0, d) for d in (-1, 0, 1)]
        forward = [step("c", dx, dy) for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1))]  # within the batch each pair of cells once
        alone = F.struct(F.lit("e").alias("kind"), F.col("x"), F.col("y"), F.lit(False).alias("own"))
        return tokens.where("kind in ('c', 'e')").select(
            "key", F.col("rep").alias("u"), F.when(F.col("kind") == "c", F.col("x")).alias("tc"), F.when(F.col("kind") == "c", F.col("y")).alias("pc"), *(F.col(c).alias(f"a_{c}") for c in _RANGES),
            F.inline(F.when(F.col("kind") == "c", F.array(*around, *forward)).otherwise(F.array(alone))),
        )

    def _met(self, probe: DataFrame, tokens: DataFrame, state: dict, touched: list[int] | None) -> DataFrame:
        """What the batch's tokens meet: (u, v, sure, old, freq, ...).

        u: a record of the batch, v: one of its own or the root of a posting (old). sure: linked by what the posting
        says. freq: a stored frequency of one of a cell's own two tokens, no link.
        """
        side = ["b_tc", "b_pc", "v", "n", *_RANGES, "old", "freq"]
        flags = lambda old, freq: {"old": F.lit(old), "freq": F.lit(freq)}
        names = {"root": "v", "tc": "b_tc", "pc": "b_pc"}
        own = tokens.where("kind in ('c', 't', 'p')").withColumns({"b_tc": F.col("x"), "b_pc": F.col("y"), "v": F.col("rep"), "old": F.lit(False), "freq": F.col("kind") != "c"})
        held = own.select(*_TOKEN, *side)
        if state["generations"]:
            post = self._current(self._read(state, "post", touched).drop("row_id", "batch_no"), state).withColumnsRenamed(names).withColumns(flags(True, False))
            freq = self._read(state, "freq", touched).withColumnsRenamed(names).withColumns(flags(False, True))
            held = held.unionByName(post.select(*_TOKEN, *side)).unionByName(freq.select(*_TOKEN, *side))
        met = probe.join(held, _TOKEN).withColumn("token", F.col("kind"))
        dx, dy = F.col("b_tc") - F.col("tc"), F.col("b_pc") - F.col("pc")
        # overlap: the other token is the same or a neighbour too; time filter: the later cell's first against the earlier's last; price filter: the same by shares
        gap = F.when(dx > 0, F.col("t0") - F.col("a_t1")).when(dx < 0, F.col("a_t0") - F.col("t1")).otherwise(0)
        ratio = F.when(dy > 0, F.col("a_p1") / F.col("p0")).when(dy < 0, F.col("p1") / F.col("a_p0")).otherwise(1.0)
        close = (F.abs(dx) <= 1) & (F.abs(dy) <= 1) & (gap <= TIME_MS) & (ratio >= 1 - PRICE_SHARE - _SLACK)
        met = met.where(F.when(F.col("freq"), F.col("own")).otherwise((F.col("kind") == "e") | close))
        single = lambda p: (F.col(p + "t0") == F.col(p + "t1")) & (F.col(p + "p0") == F.col(p + "p1"))
        met = met.withColumn("sure", ~F.col("freq") & ((F.col("kind") == "e") | (dx == 0) | (dy == 0) | (single("a_") & single(""))))
        return met.select("u", "v", "sure", "old", "freq", "token", "n", "key", "tc", "pc", "b_tc", "b_pc")

    def _diagonal(self, near: DataFrame, rows: DataFrame, state: dict, touched: list[int] | None) -> DataFrame:
        """Cells apart in both time and price: is there a point in each with both close? One ordered pass per pair."""
        pair = near.where("not freq").select("u", "v", "old", "key", "tc", "pc", "b_tc", "b_pc")
        own = rows.where("tc is not null").select(F.col("name").alias("key"), F.col("tc").alias("x"), F.col("pc").alias("y"), "ms", "price")
        held = self._read(state, "points", touched).select("key", "x", "y", F.col("t0").alias("ms"), F.col("p0").alias("price"))
        points = own.withColumn("old", F.lit(False)).unionByName(held.withColumn("old", F.lit(True)))
        ends = F.array(
            F.struct(F.col("tc").alias("x"), F.col("pc").alias("y"), F.lit(False).alias("from"), (F.col("b_tc") > F.col("tc")).alias("earlier")),
            F.struct(F.col("b_tc").alias("x"), F.col("b_pc").alias("y"), F.col("old").alias("from"), (F.col("b_tc") < F.col("tc")).alias("earlier")),
        )
        up = (F.col("b_tc") - F.col("tc")) * (F.col("b_pc") - F.col("pc")) > 0  # the later cell has the higher prices
        sides = pair.withColumn("up", up).select("u", "v", "key", "b_tc", "b_pc", "up", F.inline(ends)).withColumnRenamed("from", "old")
        points = sides.join(points, ["key", "x", "y", "old"])
        points = points.withColumns({"at": F.col("ms") + F.when(F.col("earlier"), TIME_MS).otherwise(0), "asks": F.col("earlier").cast("int")})
        seen = Window.partitionBy("u", "v", "key", "b_tc", "b_pc").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        later = F.when(~F.col("earlier"), F.col("price"))
        points = points.withColumns({"low": F.min(later).over(seen), "high": F.max(later).over(seen)})
        close = F.when(F.col("up"), F.col("price") >= F.col("low") * (1 - PRICE_SHARE - _SLACK)).otherwise(F.col("high") >= F.col("price") * (1 - PRICE_SHARE - _SLACK))
        return points.where(F.col("earlier") & close).select("u", "v")
