"""The whole feature vector of a canonical name: 20 + 45 named numbers, then two banks of hashed grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namequarry.functions.handles import KEYBOARD, _longest, _pairs, numeric_features


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _entropy(items: Column, alphabet: int) -> Column:
    """Shannon entropy of an array's elements over the most it can be; 0 for one element or none."""
    n = F.size(items)
    times = lambda c: F.size(F.filter(items, lambda x: x == c))
    bits = F.aggregate(F.array_distinct(items), F.lit(0.0), lambda acc, c: acc - times(c) / n * F.log2(times(c) / n))
    return F.when(n > 1, F.least(bits / F.log2(F.least(n, F.lit(alphabet)).cast("double")), F.lit(1.0))).otherwise(0.0)


def _marks(pairs: Column, of) -> Column:
    """One letter for each pair of neighbours, joined."""
    return F.array_join(F.transform(pairs, of), "")


def named_features(name: Column, lexical: Column) -> dict[str, Column]:
    """The named numbers of a canonical name (a-z, 0-9, _ and ? for any other character), in their fixed order.

    lexical: the struct of ``operators.lexicon.lexical_content``. Ratios without a denominator are 0; an empty name has zeros.
    """
    n, f = F.length(name), numeric_features(name)
    chars = F.when(n > 0, F.split(name, "")).otherwise(F.array().cast("array<string>"))
    pairs = F.when(n >= 2, _pairs(name)).otherwise(F.array().cast("array<string>"))
    last = n - 1
    flag = lambda c: c.cast("int")
    count = lambda cls: F.length(F.regexp_replace(name, f"[^{cls}]", ""))
    groups = lambda cls: F.size(F.regexp_extract_all(name, F.lit(f"[{cls}]+"), F.lit(0)))
    kinds, vowels, under = F.array_distinct(chars), count("aeiou"), count("_")
    # 0 a vowel, 1 anything else
    vowel = F.regexp_replace(F.translate(F.regexp_replace(name, "[0-9]", "x"), "aeiou", "00000"), "[^0]", "1")
    alternations = F.greatest(F.length(F.regexp_replace(vowel, r"(.)\1+", "$1")) - 1, F.lit(0))
    code = lambda p, i: F.ascii(F.substring(p, i, 1))
    step = lambda p: F.when(p.rlike("^([a-z]{2}|[0-9]{2})$"), F.when(code(p, 2) - code(p, 1) == 1, "u").when(code(p, 2) - code(p, 1) == -1, "d").otherwise("-")).otherwise("-")
    near = F.array(*(F.lit(x) for row in KEYBOARD for a, b in zip(row, row[1:]) for x in (a + b, b + a)))
    steps, keys = _marks(pairs, step), _marks(pairs, lambda p: F.when(F.array_contains(near, p), "k").otherwise("-"))
    run = lambda marks, pattern: F.when(n > 1, (_longest(marks, pattern) + 1) / n).otherwise(0.0)
    repeats = F.size(F.filter(pairs, lambda p: F.substring(p, 1, 1) == F.substring(p, 2, 1)))
    doubled = F.size(F.filter(kinds, lambda c: F.size(F.filter(chars, lambda x: x == c)) > 1))
    of = lambda c: F.coalesce(lexical[c].cast("double"), F.lit(0.0))
    return {
        "length": n, **{f"is_{k}": flag(n == k) for k in range(4, 9)}, "is_9_or_more": flag(n >= 9), "has_digit": flag(f["digits"] > 0), "digits": f["digits"], "digit_ratio": _over(f["digits"], n), "vowel_ratio": _over(vowels, n),
        "unique_ratio": _over(F.size(kinds), n), "repeat_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(name, F.lit(r"((.)\2*)"), F.lit(1)), F.length)), F.lit(0)), "palindrome": F.when(n > 0, f["palindrome"]).otherwise(0),
        "syllable_regularity": _over(alternations, last), "has_token": flag(of("token_quality") >= 0.72), "is_word": of("is_word"), "contains_word": of("contains_word"), "two_words": of("two_words"), "same_ends": flag((n > 0) & (F.left(name, F.lit(1)) == F.right(name, F.lit(1)))),
        "letters": f["letters"], "letter_ratio": _over(f["letters"], n), "underscores": under, "underscore_ratio": _over(under, n), "starts_underscore": flag(name.startswith("_")), "ends_underscore": flag(name.endswith("_")), "underscore_groups": groups("_"),
        "underscore_run": _longest(name, "_+"), "underscore_position_mean": f["underscore_position_mean"], "double_underscore": flag(name.contains("__")), "starts_digit": flag(name.rlike("^[0-9]")), "ends_digit": flag(name.rlike("[0-9]$")), "leading_digits": f["leading_digits"],
        "trailing_digits": f["trailing_digits"], "digit_groups": groups("0-9"), "digit_run": f["digit_run"], "digit_position_mean": f["digit_position_mean"], "digit_position_std": f["digit_position_std"], "letter_groups": groups("a-z"), "invalid": F.length(F.regexp_replace(name, r"[^?]", "")),
        "repeats": repeats, "repeat_ratio": _over(repeats, last), "repeated_kinds_ratio": _over(doubled, F.size(kinds)), "duplicate_bigram_ratio": _over(F.size(pairs) - F.size(F.array_distinct(pairs)), F.size(pairs)), "periodic_ratio": f["periodic_ratio"],
        "ascending_ratio": _over(F.length(F.regexp_replace(steps, "[^u]", "")), last), "descending_ratio": _over(F.length(F.regexp_replace(steps, "[^d]", "")), last), "ordinal_run_ratio": run(steps, "u+|d+"),
        "keyboard_ratio": _over(F.length(F.regexp_replace(keys, "[^k]", "")), last), "keyboard_run_ratio": run(keys, "k+"), "char_entropy": _entropy(chars, 38), "bigram_entropy": _entropy(pairs, 38 * 38),
        "spoken_vowel_ratio": f["spoken_vowel_ratio"], "vowel_groups": f["vowel_groups"], "vowel_run_ratio": f["vowel_run_ratio"], "consonant_run_ratio": f["consonant_run_ratio"], "pronounceability": f["pronounceability"],
        "word_count": of("word_count"), "word_coverage": of("coverage"), "longest_word_ratio": of("longest_ratio"), "word_quality": of("quality"), "token_count": of("token_count"), "token_coverage": of("token_coverage"), "token_quality": of("token_quality"), "separated_tokens": of("separated_tokens"),
    }
