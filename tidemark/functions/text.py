"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def normal(text: Column) -> Column:
    """Lower case, letters and decimal digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]", "")


def fields(text: Column) -> Column:
    """Words between any Unicode white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), "")


def has_letters(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{Nd}]")


def spoken_length(text: Column) -> Column:
    """Likely seconds to say a word: about 15 characters a second, one second at most."""
    return F.least(F.lit(1.0), F.lit(0.08) + F.lit(0.065) * F.length(text))


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"[.?!]$")


def similar(a: Column, b: Column, share: float = 0.35) -> Column:
    """Whether the edit distance is at most a share of the longer text, which isn't empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return (longer > 0) & (F.levenshtein(a, b) <= share * longer)


def squashed(words: Column) -> Column:
    return F.transform(words, normal)


def changed_words(find: Column, replace: Column) -> tuple[Column, Column]:
    """The squashed words only in ``find`` and those only in ``replace``, each run together in order."""
    a, b = squashed(fields(find)), squashed(fields(replace))
    only = lambda x, y: F.array_join(F.filter(x, lambda w: ~F.array_contains(y, w)), "")
    return only(a, b), only(b, a)


def resembles_run(word: Column, phrase: Column) -> Column:
    """Whether a word is similar to some run of one to three adjacent words of a phrase, run together."""
    w = squashed(fields(phrase))
    n = F.size(w)
    runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), ""))).otherwise(F.array().cast("array<string>"))
    return F.exists(F.concat(runs(1), runs(2), runs(3)), lambda r: similar(word, r))


#: Number words and what they mean.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "first": 1, "second": 2, "third": 3,
}


def spoken_numbers(phrase: Column) -> Column:
    """Distinct numbers in a phrase, as digits or words; a ten and a unit after it are one number."""
    table = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    bare = F.transform(fields(F.lower(phrase)), lambda w: F.regexp_replace(w, r"^\p{P}+|\p{P}+$", ""))
    values = F.transform(bare, lambda w: F.try_element_at(table, w))
    is_ten = lambda v: F.coalesce((v >= 20) & (v % 10 == 0), F.lit(False))
    is_unit = lambda v: F.coalesce(v < 10, F.lit(False))
    # whether a value is a unit used up by a ten, or a ten that takes one, shows in its neighbours alone
    said = F.transform(
        values,
        lambda v, i: F.when(v.isNull(), F.lit(None))
        .when(is_unit(v) & is_ten(F.get(values, i - 1)), F.lit(None))
        .when(is_ten(v) & is_unit(F.get(values, i + 1)), v + F.get(values, i + 1))
        .otherwise(v),
    )
    digits = F.transform(F.regexp_extract_all(phrase, F.lit(r"(\d+)"), F.lit(1)), lambda d: d.try_cast("int"))
    return F.array_distinct(F.array_compact(F.concat(digits, said)))


def keep_punctuation(words: Column, first: Column, last: Column) -> Column:
    """Replacement words with the leading punctuation of ``first`` and the trailing one of ``last``, where they lack any."""
    lead, trail = F.regexp_extract(first, r"^(\p{P}*)", 1), F.regexp_extract(last, r"(\p{P}*)$", 1)
    n = F.size(words)

    def one(w: Column, i: Column) -> Column:
        w = F.when((i == 0) & ~w.rlike(r"^\p{P}"), F.concat(lead, w)).otherwise(w)
        return F.when((i == n - 1) & ~w.rlike(r"\p{P}$"), F.concat(w, trail)).otherwise(w)

    return F.transform(words, one)


def slug(text: Column, limit: int) -> Column:
    """Lower-case words joined by hyphens, apostrophes dropped, at most ``limit`` bytes and ending at a whole word."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "['’]", ""), "[^a-z0-9]+", "-")
    out = F.regexp_replace(out, "^-+|-+$", "")
    cut = F.substring(out, 1, limit)
    whole = F.when(F.substring(out, limit + 1, 1) == "-", cut).otherwise(F.regexp_replace(cut, "(?<=.)-[^-]*$", ""))
    return F.when(F.length(out) <= limit, out).otherwise(F.regexp_replace(whole, "-+$", ""))


def without_angles(text: Column) -> Column:
    """Without the characters that titles and descriptions can't have."""
    return F.trim(F.translate(text, "<>", ""))


def tidy_line(text: Column) -> Column:
    """Control characters become blanks; runs of white space become one blank."""
    return F.array_join(fields(F.regexp_replace(text, r"\p{Cc}", " ")), " ")


def distinct_ignoring_case(items: Column) -> Column:
    """Non-empty items, the first of those that differ in case only."""
    zero = F.struct(F.array().cast("array<string>").alias("low"), F.array().cast("array<string>").alias("out"))
    old = lambda s, x: x.isNull() | (x == "") | F.array_contains(s["low"], F.lower(x))
    step = lambda s, x: F.when(old(s, x), s).otherwise(F.struct(F.array_append(s["low"], F.lower(x)).alias("low"), F.array_append(s["out"], x).alias("out")))
    return F.aggregate(items, zero, step)["out"]


def limit_chars(text: Column, n: int) -> Column:
    """At most ``n`` characters, ending at a sentence past the middle (counted in bytes), else at a word with an ellipsis."""
    cut = F.substring(text, 1, n)
    to_sentence = F.regexp_extract(cut, r"(?s)^(.*[.!?])", 1)
    to_word = F.regexp_extract(cut, r"(?s)^(.*) ", 1)
    shorter = F.when(F.octet_length(to_sentence) - 1 > n // 2, to_sentence).otherwise(F.concat(F.trim(F.when(cut.contains(" "), to_word).otherwise(cut)), F.lit(ELLIPSIS)))
    return F.when(F.length(text) <= n, text).otherwise(shorter)


def capitals(text: Column) -> Column:
    """Upper case, character by character: a sharp s, which has no capital of its own there, stays."""
    return F.replace(F.upper(F.replace(text, F.lit("ß"), F.lit("\ue000"))), F.lit("\ue000"), F.lit("ß"))


def subtitle_text(text: Column) -> Column:
    """With the markup characters of styled subtitles escaped."""
    return F.translate(F.replace(text, F.lit("\\"), F.lit("\\\\")), "{}", "()")


def caption_argument(text: Column) -> Column:
    """Text for an image tool that reads % as a code and a leading @ as a file."""
    doubled = F.replace(text, F.lit("%"), F.lit("%%"))
    return F.when(doubled.startswith("@"), F.concat(F.lit("\\"), doubled)).otherwise(doubled)


def folder_name(date: Column, title: Column, passage: Column) -> Column:
    """"date · title (passage)" without characters that file names can't show, at most 120 characters."""
    name = F.concat(date, F.coalesce(F.concat(F.lit(" · "), F.trim(F.substring_index(title, " | ", 1))), F.lit("")), F.when(F.coalesce(passage, F.lit("")) != "", F.concat(F.lit(" ("), passage, F.lit(")"))).otherwise(""))
    name = F.regexp_replace(F.replace(F.replace(name, F.lit(": "), F.lit(" - ")), F.lit(":"), F.lit(".")), r"[/\\]", "-")
    return F.when(F.length(name) > 120, F.trim(F.substring(name, 1, 120))).otherwise(name)


def quoted(text: Column) -> Column:
    """A basic string of a settings file."""
    return F.concat(F.lit('"'), F.regexp_replace(tidy_line(text), r'(["\\])', r"\\$1"), F.lit('"'))


def prompt_version(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)
