"""Whether a name is free, from recorded answers of three kinds of sources: struct (available, confidence) with available yes, no, invalid or unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAKEN = r"\b(on auction|for sale|sold|taken)\b"  # fixed value: what a listing says of a name that isn't free


def _status(available: str, confidence: str) -> Column:
    return F.struct(F.lit(available).alias("available"), F.lit(confidence).alias("confidence"))


def answer_status(result: Column, error: Column, code: Column | None = None) -> Column:
    """From a remote call: its boolean result, else what its error says; a limit on calls or any other error leaves it unknown."""
    said = lambda pattern: F.coalesce(error.rlike(pattern), F.lit(False))
    limited = said(r"(?i)FLOOD_WAIT_|please\s+wait|a\s+wait\s+of|^FLOOD$") | (F.coalesce(code == 420, F.lit(False)) if code is not None else F.lit(False))
    return (
        F.when(said("(?i)USERNAME_INVALID"), _status("invalid", "high")).when(said("(?i)USERNAME_OCCUPIED"), _status("no", "high")).when(said("(?i)USERNAME_PURCHASE_AVAILABLE"), _status("no", "high"))
        .when(limited | error.isNotNull() | result.isNull(), _status("unknown", "low")).when(result, _status("yes", "high")).otherwise(_status("no", "high"))
    )


def wait_seconds(error: Column) -> Column:
    """How long a source asked to wait; null if it didn't say."""
    return F.regexp_extract(error, r"(?i)(?:FLOOD_WAIT_|please\s+wait\s+|a\s+wait\s+of\s+)(\d+)", 1).try_cast("int")


def _text(html: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " "), r"\s+", " ")))


def listing_status(html: Column, username: Column) -> Column:
    """From a marketplace page, the first rule that holds: a robot check or no page (unknown), a claim by someone, the header's status, the name's own
    row of a search, an amount beside a bid or price; without any sign of use it may be free. Null pages are unknown."""
    text = _text(html)
    robot = F.lower(html).rlike(r"/cdn-cgi/challenge-platform/|cf-chl-|challenge-platform") | text.rlike("checking your browser before accessing|verify you are human|enable javascript and cookies to continue|cloudflare.{0,100}(challenge|ray id)|(challenge|ray id).{0,100}cloudflare")
    header = _text(F.regexp_extract(html, r"(?is)class=['\"][^'\"]*\btm-section-header-status\b[^'\"]*['\"][^>]*>(.*?)</", 1))
    rows = F.regexp_extract_all(html, F.lit(r"(?is)\btm-row-selectable\b[^>]*>(.*?)(?=<[^>]*\btm-row-selectable\b|$)"), F.lit(1))
    own = F.get(F.filter(rows, lambda r: F.lower(F.regexp_replace(F.trim(F.regexp_extract(r, r"(?is)\btm-value\b[^>]*>([^<]*)<", 1)), "^@", "")) == F.lower(username)), F.lit(0))
    mine, shown = _text(own), F.lower(F.regexp_extract(own, r"(?is)\b(?:tm-status-avail|tm-status-unavail|table-cell-status-thin)\b[^>]*>([^<]*)<", 1))
    holds = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(html.isNull() | robot, _status("unknown", "low")).when(text.contains("page not found"), _status("unknown", "high")).when(text.contains("someone already claimed this username"), _status("no", "high"))
        .when(header.rlike(TAKEN), _status("no", "high")).when(holds(shown.rlike(r"\bunavailable\b") & mine.contains("not for sale")), _status("yes", "low")).when(holds(mine.rlike(TAKEN)), _status("no", "high"))
        .when(text.rlike(r"(bid|price)[^.!?]{0,120}\d[\d\s,.]*\s*(ton|gram)\b"), _status("no", "low")).otherwise(_status("yes", "low"))
    )


def profile_status(html: Column, username: Column) -> Column:
    """From a profile page: free, with little confidence, if its title is the generic one of the name and it has no profile text."""
    title = F.lower(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1), r"\s+", " ")))
    free = (title == F.concat(F.lit("telegram: contact @"), F.lower(username))) & ~html.contains("tgme_page_extra")
    return F.when(html.isNull(), _status("unknown", "low")).when(free, _status("yes", "low")).otherwise(_status("no", "low"))


def still_open(names: DataFrame, checked: DataFrame, name: str = "name", available: str = "available") -> DataFrame:
    """Names that the next source has yet to be asked for: those that no earlier answer rules out. An anti join; null names are left out."""
    ruled_out = checked.where(F.col(available).isin("no", "invalid")).select(name).distinct()
    return names.where(F.col(name).isNotNull()).join(ruled_out, name, "left_anti")
