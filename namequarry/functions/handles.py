"""String functions over handles: validity, keys, n-grams, similarity and the numeric features of a name."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "aeiouy"
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")  # fixed value: rows of the keyboard
# fixed values: Cyrillic letters and their Latin spellings
LATIN = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya"}


def handle(raw: Column) -> Column:
    """Trimmed, without leading @, in lower case; null unless 4 to 32 letters, digits and underscores with a letter first."""
    name = F.lower(F.regexp_replace(F.trim(raw), "^@+", ""))
    return F.when(name.rlike("^[a-z][a-z0-9_]{3,31}$"), name)


def valid_handle(name: Column, shortest: int = 5) -> Column:
    """Letter first, ``shortest`` to 32 characters, no double and no trailing underscore."""
    return name.rlike(f"^[a-z][a-z0-9_]{{{shortest - 1},31}}$") & ~name.contains("__") & ~name.endswith("_")


def structural_segment(name: Column) -> Column:
    """length:digits:underscores, as has-flags."""
    return F.concat_ws(":", F.length(name).cast("string"), name.rlike("[0-9]").cast("int").cast("string"), name.contains("_").cast("int").cast("string"))


def shape(name: Column) -> Column:
    """letters, digits, letter-digit, underscore or other, with the bucket of the length."""
    letters, digits, under = name.rlike("[a-z]"), name.rlike("[0-9]"), name.contains("_")
    kind = F.when(letters & ~digits & ~under, "letters").when(~letters & digits & ~under, "digits").when(letters & digits & ~under, "letter-digit").when(under & (letters | digits), "underscore").otherwise("other")
    n = F.length(name)
    return F.concat(kind, F.lit(":"), F.when(n <= 4, "4").when(n == 5, "5").when(n <= 7, "6-7").when(n <= 10, "8-10").otherwise("11+"))


def lexical_family(name: Column) -> Column:
    """Runs of digits as #, runs of underscores as one."""
    return F.regexp_replace(F.regexp_replace(name, "[0-9]+", "#"), "_+", "_")


def ngrams(name: Column, n: int) -> Column:
    """The distinct n-grams of ^name$; a shorter one is its own only gram."""
    p = F.concat(F.lit("^"), name, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))
    return F.array_distinct(grams)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(1.0))


def edit_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(1.0))


def class_runs(name: Column) -> Column:
    """Classes of characters (a, d, _, o), runs collapsed."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^a-z0-9_]", "o~"), "[0-9]", "d~"), "(?<![od])[a-z](?!~)|(?<=[od])[a-z](?!~)", "a~")
    return F.regexp_replace(F.replace(flat, F.lit("~"), F.lit("")), r"(.)\1+", "$1")


def amount(text: Column) -> Column:
    """A decimal amount in any common grouping: 1,583,948 / 12.345,75 / 1.234.567 / 12,5; one comma before three digits groups.

    A trailing unit in letters is dropped; null if the rest is no amount.
    """
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s ]+", " "), r"\s*(?:ton|gram)s?\.?$", ""))
    t = F.replace(t, F.lit(" "), F.lit(""))
    clean = (
        F.when(t.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(r"^\d{1,3}(\.\d{3})+,\d+$") | t.rlike(r"^\d{1,3}(\.\d{3}){2,}$"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(t.rlike(r"^\d+,\d+$"), F.replace(t, F.lit(","), F.lit(".")))
        .when(t.rlike(r"^\d+(\.\d+)?$"), t)
    )
    return clean.try_cast("double")


def transliterated(text: Column) -> Column:
    """Cyrillic letters in Latin spelling, lower case, everything but a-z, 0-9 and _ dropped."""
    single = {k: v for k, v in LATIN.items() if len(v) <= 1}
    out = F.lower(text)
    for k, v in LATIN.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    ordered = sorted(single.items(), key=lambda kv: kv[1] == "")
    out = F.translate(out, "".join(k for k, _ in ordered), "".join(v for _, v in ordered))
    return F.regexp_replace(out, "[^a-z0-9_]", "")


def pronounceable(name: Column) -> Column:
    """At least three letters, a fifth of them vowels, no more than three consonants in a row."""
    letters = F.regexp_replace(name, "[^a-z]", "")
    vowels = F.length(F.regexp_replace(letters, f"[^{VOWELS}]", ""))
    return (F.length(letters) >= 3) & (vowels >= 0.2 * F.length(letters)) & ~letters.rlike(f"[^{VOWELS}]{{4,}}")


def _longest(name: Column, pattern: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(name, F.lit(f"({pattern})"), F.lit(1)), F.length)), F.lit(0))


def _pairs(name: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2)))


def numeric_features(name: Column) -> dict[str, Column]:
    """Counts, ratios, runs and flags of a name, each a JVM expression; 0 where a ratio has no denominator."""
    n = F.length(name)
    count = lambda cls: F.length(F.regexp_replace(name, f"[^{cls}]", ""))
    ratio = lambda a: F.coalesce(F.try_divide(a, n), F.lit(0.0))
    near = F.array(*(F.lit(x) for row in KEYBOARD for a, b in zip(row, row[1:]) for x in (a + b, b + a)))
    steps = F.array(*(F.lit(x) for run in ("abcdefghijklmnopqrstuvwxyz", "0123456789") for a, b in zip(run, run[1:]) for x in (a + b,)))
    pairs = F.when(n >= 2, _pairs(name)).otherwise(F.array().cast("array<string>"))
    share = lambda hits: F.coalesce(F.try_divide(F.size(hits), F.size(pairs)), F.lit(0.0))
    digits, letters, under = count("0-9"), count("a-z"), count("_")
    vowels = count(VOWELS)
    return {
        "length": n,
        "digits": digits, "letters": letters, "underscores": under,
        "digit_ratio": ratio(digits), "letter_ratio": ratio(letters),
        "digit_run": _longest(name, "[0-9]+"), "letter_run": _longest(name, "[a-z]+"),
        "digit_groups": F.size(F.regexp_extract_all(name, F.lit("[0-9]+"), F.lit(0))),
        "leading_digits": F.length(F.regexp_extract(name, "^[0-9]*", 0)), "trailing_digits": F.length(F.regexp_extract(name, "[0-9]*$", 0)),
        "palindrome": (name == F.reverse(name)).cast("int"),
        "unique_ratio": ratio(F.size(F.array_distinct(F.split(name, "")))),
        "repeats": F.size(F.filter(pairs, lambda p: F.substring(p, 1, 1) == F.substring(p, 2, 1))),
        "keyboard_share": share(F.filter(pairs, lambda p: F.array_contains(near, p))),
        "ascending_share": share(F.filter(pairs, lambda p: F.array_contains(steps, p))),
        "descending_share": share(F.filter(pairs, lambda p: F.array_contains(steps, F.reverse(p)))),
        "vowel_ratio": F.coalesce(F.try_divide(vowels, letters), F.lit(0.0)),
        "consonant_run": _longest(name, "[b-df-hj-np-tv-xz]+"), "vowel_run": _longest(name, f"[{VOWELS}]+"),
        "digit_position_mean": positions(name, "0-9")[0], "digit_position_std": positions(name, "0-9")[1], "underscore_position_mean": positions(name, "_")[0],
        "periodic_ratio": periodic_ratio(name), **pronounceability(name),
    }


def entropy(name: Column, alphabet: int = 37) -> Column:
    """Shannon entropy of the characters over log2 of the alphabet, between 0 and 1."""
    chars = F.split(name, "")
    n = F.size(chars)
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - F.size(F.filter(chars, lambda x: x == c)) / n * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))
    return F.when(F.length(name) > 0, F.least(bits / F.log2(F.lit(float(alphabet))), F.lit(1.0))).otherwise(0.0)


def _times32(h: Column, factor: int) -> Column:
    """The low 32 bits of a product of 32-bit numbers, in halves so that no step passes 64 bits."""
    high, low, mask = F.lit(factor >> 16), F.lit(factor & 0xFFFF), F.lit(0xFFFFFFFF)
    return (h * low + F.shiftleft((h * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)


def stable_hash(text: Column, seed: int) -> Column:
    """FNV-1a over the ASCII characters of a text from ``seed``, finished as Murmur3 does: 0 to 2**32 - 1."""
    mixed = lambda x, n: x.bitwiseXOR(F.shiftrightunsigned(x, n))
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("bigint"))
    steps = lambda h: mixed(_times32(mixed(_times32(mixed(h, 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)
    return F.aggregate(codes, F.lit(seed).cast("bigint"), lambda h, c: _times32(h.bitwiseXOR(c), 0x01000193), steps)


BANKS = (0x811C9DC5, 0x9E3779B9)  # fixed values: seeds of the two banks of buckets


def hashed_ngrams(name: Column, buckets: int = 32, seed: int = BANKS[0]) -> Column:
    """Signed counts of all 2-, 3- and 4-grams of ^name$, repeated ones too, in ``buckets`` hashed places, over the root of their number.

    One bank; ``hashed_banks`` has both. Of a canonical name: ASCII, of which the first 256 characters count. An empty name has zeros.
    """
    p = F.concat(F.lit("^"), F.substring(name, 1, 256), F.lit("$"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.concat(F.lit(f"{n}:"), F.substring(p, i, F.lit(n))))
    grams = F.concat(of(2), F.when(F.length(p) >= 3, of(3)).otherwise(F.array().cast("array<string>")), F.when(F.length(p) >= 4, of(4)).otherwise(F.array().cast("array<string>")))
    none = F.array_repeat(F.lit(0.0), buckets)
    places = F.transform(F.transform(grams, lambda g: stable_hash(g, seed)), lambda h: F.struct((h % buckets).alias("at"), F.when(h < 2**31, 1.0).otherwise(-1.0).alias("sign")))
    add = lambda acc, q: F.transform(acc, lambda x, i: x + F.when(i == q["at"], q["sign"]).otherwise(0.0))
    counts = F.aggregate(places, none, add)
    scale = 1 / F.sqrt(F.size(grams).cast("double"))
    return F.when(name == "", none).otherwise(F.transform(counts, lambda x: x * scale))


def hashed_banks(name: Column, buckets: int = 32) -> Column:
    """Both banks of ``hashed_ngrams``, one after the other."""
    return F.concat(*(hashed_ngrams(name, buckets, seed) for seed in BANKS))


@F.pandas_udf(T.StringType())
def canonical(raw: pd.Series) -> pd.Series:
    """NFKC in lower case; every character but a-z, 0-9 and _ is ?. Null stays null. (The JVM's normaliser isn't among Spark's functions.)"""
    return raw.map(lambda s: None if s is None else re.sub("[^a-z0-9_]", "?", unicodedata.normalize("NFKC", s).lower()))


def positions(name: Column, cls: str) -> tuple[Column, Column]:
    """Mean and standard deviation of the places of the characters of a class, 0 at the first and 1 at the last; 0 where there are none or one character."""
    last = F.length(name) - 1
    at = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(name, i + 1, F.lit(1)).rlike(f"[{cls}]")), lambda i: F.try_divide(i, last))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    mean = F.try_divide(total(at), F.size(at))
    spread = F.sqrt(F.try_divide(total(F.transform(at, lambda x: (x - mean) * (x - mean))), F.size(at)))
    return F.coalesce(F.when(last > 0, mean), F.lit(0.0)), F.coalesce(F.when(last > 0, spread), F.lit(0.0))


def periodic_ratio(name: Column) -> Column:
    """The longest span that repeats its own start at least once whole (abab, aaa), over the length.

    A span of period p is p and a run of places that equal the one p further on; the run must be p long at least.
    """
    n = F.length(name)
    same = lambda p: F.array_join(F.transform(F.sequence(F.lit(1), n - p), lambda i: F.when(F.substring(name, i, F.lit(1)) == F.substring(name, i + p, F.lit(1)), "1").otherwise("0")), "")
    spans = F.transform(F.transform(F.sequence(F.lit(1), F.floor(n / 2).cast("int")), lambda p: F.struct(p.alias("p"), _longest(same(p), "1+").alias("run"))), lambda x: F.when(x["run"] >= x["p"], x["p"] + x["run"]).otherwise(0))
    return F.when(n >= 2, F.array_max(spans) / n).otherwise(0.0)


def pronounceability(name: Column) -> dict[str, Column]:
    """Of the letters of a name, vowels aeiou: ratio and groups of vowels, longest runs, changes between vowel and consonant, and the weighted score; all 0 without letters."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^a-z]", ""), "[aeiou]", "0"), "[a-z]", "1")  # 0 a vowel, 1 a consonant
    n = F.length(kinds)
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    within = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    vowels, run_v, run_c = F.length(F.replace(kinds, F.lit("1"), F.lit(""))), _longest(kinds, "0+"), _longest(kinds, "1+")
    groups = F.size(F.regexp_extract_all(kinds, F.lit("0+"), F.lit(0)))
    changes = over(F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1, n - 1)
    balance = within(1 - F.abs(over(vowels, n) - 0.42) / 0.42)
    clusters = lambda run, most: within(1 - F.greatest(run - 2, F.lit(0)) / most)
    score = within(over(n, F.length(name)) * (0.32 * balance + 0.28 * changes + 0.25 * clusters(run_c, 4) + 0.15 * clusters(run_v, 3)))
    parts = {"spoken_vowel_ratio": over(vowels, n), "vowel_groups": over(groups, n), "vowel_run_ratio": over(run_v, n), "consonant_run_ratio": over(run_c, n), "alternation": changes, "pronounceability": score}
    return {k: F.when(n > 0, c).otherwise(0.0) for k, c in parts.items()}


def _runs(name: Column) -> Column:
    """Runs of letters, digits and other characters as structs (kind, size); underscores part them and are none."""
    parts = F.regexp_extract_all(name, F.lit("[a-z]+|[0-9]+|[^a-z0-9_]+"), F.lit(0))
    kind = lambda p: F.when(p.rlike("^[a-z]"), "a").when(p.rlike("^[0-9]"), "d").otherwise("o")
    return F.transform(parts, lambda p: F.struct(kind(p).alias("kind"), F.length(p).alias("size")))


# fixed values of the score of two names: the factors in run_penalty, structural_damp, damped_score and name_similarity


def run_penalty(a: Column, b: Column) -> Column:
    """exp(-0.9 d), d the mean difference of aligned runs in kind and relative size plus that in their number."""
    x, y = _runs(a), _runs(b)
    n = F.greatest(F.size(x), F.size(y), F.lit(1))
    both = F.least(F.size(x), F.size(y))
    aligned = F.zip_with(F.slice(x, F.lit(1), both), F.slice(y, F.lit(1), both), lambda p, q: F.when(p["kind"] != q["kind"], 1.0).otherwise(0.0) + F.abs(p["size"] - q["size"]) / F.greatest(p["size"], q["size"]))
    return F.exp(-0.9 * (F.abs(F.size(x) - F.size(y)) + F.aggregate(aligned, F.lit(0.0), lambda s, d: s + d)) / n)


def class_shape(name: Column) -> Column:
    """The class of each character: a, 0, _ or ?; lengths, shares, class runs and runs of a name are those of its shape."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^a-z0-9_]", "?"), "[a-z]", "a"), "[0-9]", "0")


def structural_damp(a: Column, b: Column) -> Column:
    """What differences in length, digits, underscores and class runs leave of a similarity; the same for names of the same shapes."""
    share = lambda n: F.coalesce(F.try_divide(F.length(F.regexp_replace(n, "[^0-9]", "")), F.length(n)), F.lit(0.0))
    under = lambda n: F.length(F.regexp_replace(n, "[^_]", ""))
    length = F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.exp(-1.25 * length - 1.4 * F.abs(share(a) - share(b)) - 0.3 * F.abs(under(a) - under(b))) * (0.65 + 0.35 * edit_similarity(class_runs(a), class_runs(b)))


def damped_score(lexical: Column, damp: Column, runs: Column) -> Column:
    """The score of ``name_similarity`` from its parts; it never falls with any of them."""
    return F.least(F.greatest((0.94 * lexical + 0.06 * damp) * damp * runs, F.lit(0.0)), F.lit(1.0))


def name_similarity(a: Column, b: Column) -> Column:
    """Similarity of two names between 0 and 1: shared bigrams and trigrams and edits, damped by differences in length, digits, underscores and runs."""
    grams = 0.45 * jaccard(ngrams(a, 2), ngrams(b, 2)) + 0.55 * jaccard(ngrams(a, 3), ngrams(b, 3))
    score = damped_score(0.58 * grams + 0.42 * edit_similarity(a, b), structural_damp(a, b), run_penalty(a, b))
    return F.when(a == b, F.when(a != "", 1.0).otherwise(0.0)).when((a == "") | (b == ""), 0.0).otherwise(score)
