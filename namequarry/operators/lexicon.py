"""Words within names, by a dictionary given as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 3  # least letters of a part of a compound
EMBEDDED = 4  # least letters of a word within a run
_OUT = "name string, is_word int, contains_word int, two_words int, words array<string>, coverage double, longest_ratio double, quality double, token string, token_quality double, word_count int, token_count int, token_coverage double, separated_tokens double"


def segmented(run: str, words: set[str]) -> list[str] | None:
    """The run as two or more words of PART letters at least: as few as can be, then with the longest shortest part, then the first found; else None."""
    best: list[list[str] | None] = [[], *([None] * len(run))]
    for end in range(PART, len(run) + 1):
        for start in range(end - PART + 1):
            head, word = best[start], run[start:end]
            if head is None or word not in words:
                continue
            made, held = [*head, word], best[end]
            if held is None or (len(made), -min(map(len, made))) < (len(held), -min(map(len, held))):
                best[end] = made
    found = best[len(run)]
    return found if found and len(found) > 1 else None


def match_quality(run: str, token: str, words: set[str]) -> float:
    """1 if the run is the token, 0.85 if it is the token and one word beside it, 0.72 with a word on either side, else 0; the token's first place counts."""
    at = run.find(token)
    if at < 0:
        return 0.0
    head, tail = run[:at], run[at + len(token) :]
    known = lambda w: len(w) >= PART and w in words
    if not head and not tail:
        return 1.0
    if (not head and known(tail)) or (not tail and known(head)):
        return 0.85
    return 0.72 if known(head) and known(tail) else 0.0


def _analysed(name: str, words: set[str], tokens: set[str]) -> tuple:
    runs = [r for r in "".join(c if "a" <= c <= "z" else " " for c in name).split(" ") if r]
    letters = sum(map(len, runs))
    whole = int(len(runs) == 1 and runs[0] in words)
    pair = len(runs) == 2 and all(len(r) >= PART and r in words for r in runs)
    if len(runs) == 1:
        pair = any(runs[0][:i] in words and runs[0][i:] in words for i in range(PART, len(runs[0]) - PART + 1))
    found: list[str] = []
    for r in runs:
        if r in words:
            found.append(r)
        elif parts := segmented(r, words):
            found += parts
        elif inner := next((r[i : i + n] for n in range(len(r), EMBEDDED - 1, -1) for i in range(len(r) - n + 1) if r[i : i + n] in words), None):
            found.append(inner)
    longest = max(map(len, found), default=0)
    coverage = min(1.0, sum(map(len, found)) / letters) if letters else 0.0
    quality = coverage / len(found) ** 0.5 * (0.5 + 0.5 * min(1.0, max(0.0, (longest - 2) / 6))) if found else 0.0
    matches = {(r, t): q for r in runs for t in tokens if (q := match_quality(r, t, words)) > 0}
    best = max(((q, len(t), t) for (_, t), q in matches.items()), default=(0.0, 0, None))
    spread = min(1.0, sum(len(t) for _, t in matches) / letters) if letters else 0.0
    alone = sum(r in tokens for r in runs) / len(runs) if runs else 0.0
    return name, whole, int(bool(found)), int(pair), found, coverage, longest / letters if letters else 0.0, quality, best[2], best[0], len(found), len(matches), spread, alone


def lexical_content(names: DataFrame, words: DataFrame, tokens: DataFrame) -> DataFrame:
    """What words each distinct name holds: whether it is one, holds one or is two, the words themselves, how much of it they cover, and its best token.

    names, words, tokens: a column ``name``, ``word`` and ``token``. Only the pieces of names that are words are looked at:
    a name's pieces meet the dictionary in a join, so the dictionary may have any size and isn't broadcast. Names may have up to some dozens of characters. Null and empty names are left out.
    """
    distinct = names.where(F.col("name") != "").select("name").distinct()
    piece = F.flatten(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.transform(F.sequence(i, F.length("name")), lambda j: F.substring(F.col("name"), i, j - i + 1))))
    pieces = distinct.select("name", F.explode(F.array_distinct(piece)).alias("piece")).where(F.col("piece").rlike("^[a-z]{2,}$"))
    known = words.select(F.col("word").alias("piece")).distinct().withColumn("is_token", F.lit(False)).unionByName(tokens.select(F.col("token").alias("piece")).distinct().withColumn("is_token", F.lit(True)))
    held = pieces.join(known, "piece").groupBy("name").agg(F.collect_set(F.when(~F.col("is_token"), F.col("piece"))).alias("words"), F.collect_set(F.when(F.col("is_token"), F.col("piece"))).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int32()] * 3, pa.list_(pa.string()), *[pa.float64()] * 3, pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        for b in batches:
            rows = [_analysed(n, set(w or ()), set(t or ())) for n, w, t in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _OUT.split(", ")])

    return distinct.join(held, "name", "left").select("name", "words", "tokens").mapInArrow(run, _OUT)
