"""Sales read from recorded listing pages: from their tables, else from JSON in scripts, else from their text; what can't be used is put aside with a reason."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HANDLE = re.compile(r"[a-z][a-z0-9_]{3,31}")
_TEXT = re.compile(r"@([a-zA-Z][a-zA-Z0-9_]{3,31})([^@]{0,180}?)(\d[\d\s  ,'’.]*?(?:[.,]\d+)?)\s*(?:ton|gram)\b", re.I)
_OUT = "page_id {kind}, parser string, row_no int, username string, price double, sale_at string, confidence string, raw_price string, reason string"


def flat(text: str) -> str:
    """Runs of any blanks as one, none at the ends."""
    return re.sub(r"[\s  ]+", " ", text).strip()


def amount(text: str) -> float | None:
    """A positive amount: one separator of three digits groups, the last of two kinds is the decimal one; blanks and apostrophes group."""
    t = re.sub(r"[\s  '’]", "", re.sub(r"(?i)\s*(?:ton|gram)s?\.?$", "", text.strip()))
    if re.fullmatch(r"\d{1,3}(,\d{3})+(\.\d+)?", t):
        t = t.replace(",", "")
    elif re.fullmatch(r"\d{1,3}(\.\d{3})+,\d+", t) or re.fullmatch(r"\d{1,3}(\.\d{3}){2,}", t):
        t = t.replace(".", "").replace(",", ".")
    elif re.fullmatch(r"\d+,\d+", t):
        t = t.replace(",", ".")
    return float(t) if re.fullmatch(r"\d+(\.\d+)?", t) and float(t) > 0 else None


def moment(text: str | None) -> str | None:
    """A time with a zone or offset as ``yyyy-MM-ddTHH:mm:ss.SSSZ``; else null."""
    try:
        at = datetime.fromisoformat((text or "").strip())
    except ValueError:
        return None
    return at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z" if at.tzinfo else None


class _Page(HTMLParser):
    """Table rows with their cells, names, amounts and times; the page's scripts, times and text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.scripts, self.times, self.text = [], [], [], []
        self.open: list[tuple[str, set]] = []
        self.row: dict | None = None

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        classes = set(found.get("class", "").split())
        if tag == "tr":
            self.row = {"cells": [], "names": [], "amounts": [], "times": [], "status": [], "head": False}
            self.rows.append(self.row)
        elif tag in ("td", "th") and self.row is not None:
            self.row["cells"].append("")
            self.row["head"] |= tag == "th"
        if "datetime" in found and tag == "time":
            self.times.append(found["datetime"])
            if self.row is not None:
                self.row["times"].append(found["datetime"])
        if tag == "a" and self.row is not None and (m := re.match(r"/username/([^/?#]+)", found.get("href", ""), re.I)):
            self.row["names"].append(m[1])
        for mark, where in (("icon-ton", "amounts"), ("table-cell-status-thin", "status"), ("tm-status-unavail", "status"), ("table-cell-value", "status"), ("tm-value", "names")):
            if mark in classes and self.row is not None:
                self.row[where].append([len(self.row["cells"]) - 1, ""] if where == "amounts" else "")
                classes.add("*" + where)
        if tag == "script":
            self.scripts.append("")
        if tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.open.append((tag, classes))

    def handle_endtag(self, tag):
        while self.open and self.open.pop()[0] != tag:
            pass
        if tag == "table":
            self.row = None

    def handle_data(self, data):
        inside = {c for _, classes in self.open for c in classes if c.startswith("*")}
        if any(t == "script" for t, _ in self.open):
            self.scripts[-1] += data
            return
        self.text.append(data)
        if self.row is None:
            return
        if self.row["cells"]:
            self.row["cells"][-1] += data
        for where in ("names", "status"):
            if "*" + where in inside:
                self.row[where][-1] += data
        if "*amounts" in inside:
            self.row["amounts"][-1][1] += data


def _name(texts: list[str]) -> str | None:
    plain = (re.sub("^@", "", flat(t)).lower() for t in texts)
    return next((p for p in plain if _HANDLE.fullmatch(p)), None)


def _from_tables(page: _Page) -> list[tuple]:
    out = []
    for no, row in enumerate(r for r in page.rows if not r["head"]):
        prices = [(flat(raw), value, bool(re.search(r"sale\s*price", row["cells"][at] if 0 <= at < len(row["cells"]) else "", re.I))) for at, raw in row["amounts"] if (value := amount(flat(raw))) is not None]
        said = [p for p in prices if p[2]]
        sold = any(re.fullmatch("sold", flat(s), re.I) for s in [*row["status"], *row["cells"]])
        name = _name(row["names"])
        if not (sold or said) or name is None:
            continue
        times = [moment(t) for t in row["times"]]
        at = times[0] if times else None
        explicit, every = sorted({p[1] for p in said}), sorted({p[1] for p in prices})
        price, grade, reason = None, None, None
        if None in times:
            reason = "invalid sale time"
        elif len(set(times)) > 1:
            reason = "several sale times"
        elif len(explicit) == 1:
            price, grade = explicit[0], "high" if at else "medium"
        elif explicit:
            reason = "conflicting sale prices"
        elif len(every) == 1:
            price, grade = every[0], "medium"
        else:
            reason = "several amounts, no sale price" if every else "no sale price"
        out.append(("table", no, name, price, None if reason else at, grade, " | ".join(p[0] for p in prices) or None, reason))
    return out


def _walk(node) -> Iterator[dict]:
    if isinstance(node, dict):
        yield node
    for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from _walk(child)


def _from_scripts(page: _Page) -> list[tuple]:
    out = []
    for text in page.scripts:
        m = re.search(r"\{.*\}", text, re.S)
        try:
            value = json.loads(m[0]) if m else None
        except (ValueError, RecursionError):
            continue
        for found in _walk(value):
            name = next((found[k] for k in ("username", "handle") if isinstance(found.get(k), str)), None)
            key = next((k for k in ("priceTon", "salePriceTon", "sale_price_ton") if isinstance(found.get(k), (int, float, str)) and not isinstance(found.get(k), bool)), None)
            name = _name([name]) if name else None
            if name is None or key is None or (price := amount(str(found[key]))) is None:
                continue
            at = moment(next((found[k] for k in ("saleAt", "soldAt", "sold_at", "date") if isinstance(found.get(k), str)), None))
            status = str(next((found[k] for k in ("status", "state", "type") if found.get(k) is not None), "")).lower()
            sold = key != "priceTon" or re.search(r"\bsold\b", status) is not None
            reason = "no exact sale time" if at is None else None if sold else "no evidence of a sale"
            out.append(("json", len(out), name, None if reason else price, None if reason else at, None if reason else "medium", str(found[key]), reason))
    return out


def _from_text(page: _Page) -> list[tuple]:
    times = {t for t in map(moment, page.times) if t}
    found = [(m[1].lower(), m[3], value, flat(m[2])) for m in _TEXT.finditer(flat(" ".join(page.text))) if (value := amount(flat(m[3]))) is not None]
    out = []
    for no, (name, raw, price, said) in enumerate(found):
        sold = re.search(r"\bsale\s+price\b", said, re.I) and re.search(r"\bsold\b", said, re.I)
        reason = "no evidence of a sale" if not sold else None if len(found) == 1 and len(times) == 1 else "no single sale and time"
        out.append(("text", no, name, None if reason else price, None if reason else min(times), None if reason else "low", raw, reason))
    return out


def sold_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, parser, row_no, username, price, sale_at, confidence, raw_price, reason) of every candidate of recorded pages.

    A page is read by its table rows, where none of them tells of a sale by the JSON in its scripts, and where that has none either by
    its text. ``reason`` says why a candidate is put aside; it is null for sales. A row needs a status of Sold or a cell with a sale price,
    one price and at most one time; JSON needs an exact time and evidence; text a single candidate and a single time.
    Null and empty pages, and malformed markup beyond what can be read, give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                read = _Page()
                read.feed(text or "")
                read.close()
                out += [(page, *r) for r in _from_tables(read) or _from_scripts(read) or _from_text(read)]
            yield pd.DataFrame(out, columns=["page_id", "parser", "row_no", "username", "price", "sale_at", "confidence", "raw_price", "reason"])

    return pages.select(F.col(key).alias("page_id"), html).mapInPandas(run, _OUT.format(kind=pages.schema[key].dataType.simpleString()))


def listing_view(html: Column, url: Column) -> Column:
    """The order a page was listed in: of its form, else of its address; null if neither says."""
    form = F.regexp_extract(html, r"(?is)<input[^>]*\bname=['\"]sort['\"][^>]*\bvalue=['\"]([^'\"]*)['\"]", 1)
    return F.nullif(F.lower(F.trim(F.coalesce(F.nullif(F.trim(form), F.lit("")), F.nullif(F.regexp_extract(url, r"[?&]sort=([^&#]*)", 1), F.lit(""))))), F.lit(""))


def unique_sales(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sales, conflicting): sales once per (username, sale_at), pages of one crawl together; those whose price differs between copies are put aside as a whole.

    Sales without a time are once per (username, price). Of copies that of the highest grade, then the first page, stays. Aggregations only, no group is gathered.
    """
    sales = candidates.where("reason is null")
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    kept = F.min(F.struct(rank.alias("rank"), "page_id", "row_no", "parser", "price", "confidence")).alias("k")
    dated = sales.where("sale_at is not null").groupBy("username", "sale_at").agg(F.count("*").alias("copies"), F.min("price").alias("lo"), F.max("price").alias("hi"), kept)
    undated = sales.where("sale_at is null").groupBy("username", "price").agg(F.count("*").alias("copies"), kept).withColumn("sale_at", F.lit(None).cast("string")).drop("price")
    shown = ["username", "sale_at", "copies", "k.price", "k.confidence", "k.parser", "k.page_id"]
    same = F.abs(F.col("hi") - F.col("lo")) <= 1e-12 * F.greatest(F.lit(1.0), F.col("hi"))
    return dated.where(same).select(*shown).unionByName(undated.select(*shown)), dated.where(~same).select("username", "sale_at", "copies", F.col("lo").alias("lowest"), F.col("hi").alias("highest"))
