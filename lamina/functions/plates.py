"""Plate grammar as column expressions: normalisation, swaps, correction and scoring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What the recogniser's grammar is made of.
PREFERRED = "^[0-9]{2}[A-Z][0-9]{4,6}$"
VALID = "^[0-9]{2}[A-Z][A-Z0-9]?[0-9]{3,5}$"
LETTERS_READ_AS_DIGITS, THEIR_DIGITS = "BGILOSZT", "86110521"
DIGITS_READ_AS_LETTERS, THEIR_LETTERS = "014568", "GLASGB"
#: Letters whose full upper case is two characters though they have a capital of their own: sharp s, and Greek ones with an iota below.
SMALL = "ß" + "".join(map(chr, [*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8), 0x1FB3, 0x1FC3, 0x1FF3]))
THEIR_CAPITALS = "ẞ" + SMALL[1:].translate({ord(c): c.title() for c in SMALL[1:]})
CLASSES = "0123456789ABCDEFGHKLMNPRSTUVXYZ"


def normalised(text: Column) -> Column:
    """Upper case, ASCII letters and digits only."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def upper_letter(character: Column) -> Column:
    """Upper case of one character as one character, as SQL gives it; a letter that has no single capital stays."""
    upper = F.upper(character)
    return F.when(F.length(upper) == 1, upper).otherwise(F.translate(character, SMALL, THEIR_CAPITALS))


def class_characters(text: Column) -> Column:
    """Upper case, characters of the class set only."""
    return F.regexp_replace(F.upper(text), f"[^{CLASSES}]", "")


def comparison_key(text: Column) -> Column:
    """Upper case without dashes and dots."""
    return F.upper(F.translate(text, "-.", ""))


def _digits(text: Column) -> Column:
    return F.translate(text, LETTERS_READ_AS_DIGITS, THEIR_DIGITS)


def with_letters_at(text: Column, count: int) -> Column:
    """Swaps so that ``count`` characters from the third on are letters and all others digits."""
    rest = F.substring(text, 3 + count, 1_000_000)
    return F.concat(_digits(F.substring(text, 1, 2)), F.translate(F.substring(text, 3, count), DIGITS_READ_AS_LETTERS, THEIR_LETTERS), _digits(rest))


def without_doubled(text: Column) -> Column:
    """Nine characters whose fourth digit is repeated lose it, if the rest is a plate."""
    shorter = F.concat(F.substring(text, 1, 3), F.substring(text, 5, 1_000_000))
    doubled = (F.length(text) == 9) & F.substring(text, 4, 1).rlike("[0-9]") & (F.substring(text, 4, 1) == F.substring(text, 5, 1))
    return F.when(doubled & (shorter.rlike(PREFERRED) | shorter.rlike(VALID)), shorter).otherwise(text)


def corrected(text: Column, drop_doubled: bool = True) -> Column:
    """The first preferred reading of the text, else the first valid one, else the normalised text."""
    plain = normalised(text)
    readings = F.array(plain, with_letters_at(plain, 1), with_letters_at(plain, 2))
    if drop_doubled:
        readings = F.transform(readings, without_doubled)
    first = lambda pattern: F.get(F.filter(readings, lambda r: r.rlike(pattern)), F.lit(0))
    return F.coalesce(first(PREFERRED), first(VALID), plain)


def is_valid(text: Column) -> Column:
    return text.rlike(PREFERRED) | text.rlike(VALID)


def thin_seven(character: Column, ink_ratio: Column, most: float = 0.48) -> Column:
    """A seven whose ink is no wider than this share of its height is a one."""
    return F.when((character == "7") & (ink_ratio <= most), "1").otherwise(character)


def format_score(text: Column, two_line: Column, top_count: Column) -> Column:
    """Additive plausibility of a reading; two-line plates are judged by their lines."""
    size = F.length(text)
    base = F.when(size.between(7, 9), 3.0).when(size < 7, -3.0).otherwise(-2.0)
    top, bottom = F.substring(text, F.lit(1), top_count), F.substring(text, top_count + 1, F.lit(1_000_000))
    digits = lambda t: F.regexp_count(t, F.lit("[0-9]"))
    letters = lambda t: F.regexp_count(t, F.lit("[A-Z]"))
    award = lambda condition, points: F.when(condition, points).otherwise(0.0)
    by_line = (
        award(F.length(top).between(3, 4), 1.0)
        + award(F.length(bottom) >= F.length(top), 1.0)
        + award(top.rlike("^[0-9]{2}"), 3.0)
        + award(letters(top) > 0, 2.0)
        + award(bottom.rlike("^[0-9]{4,6}$"), 4.0)
        + award(F.length(bottom) > 0, 2.0 * digits(bottom) / F.greatest(F.length(bottom), F.lit(1)))
        - 1.5 * letters(bottom)
    )
    tail = F.substring(text, 4, 1_000_000)
    single = award(text.rlike("^[0-9]{2}[A-Z]"), 5.0) + award(F.length(tail) > 0, 3.0 * digits(tail) / F.greatest(F.length(tail), F.lit(1)))
    return base + F.when(two_line, by_line).otherwise(single)


def edit_similarity_parts(label: Column, reading: Column) -> tuple[Column, Column]:
    """(edit distance, longer length): summed over rows they give the micro character accuracy."""
    return F.levenshtein(label, reading), F.greatest(F.length(label), F.length(reading))


def safe_stem(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_")


def label_path(path: Column) -> Column:
    """An image's path to its label's: whole path parts named images become labels, the suffix becomes .txt."""
    parts = F.transform(F.split(path, "/"), lambda p: F.when(p == "images", F.lit("labels")).otherwise(p))
    return F.regexp_replace(F.array_join(parts, "/"), r"\.[^./]+$", ".txt")


def model_spec(text: Column) -> Column:
    """name=path as a struct; without a name the path names itself."""
    parts = F.split(text, "=", 2)
    return F.struct(parts[0].alias("name"), F.when(F.size(parts) > 1, F.get(parts, 1)).otherwise(text).alias("path"))


def feature_method(name: Column) -> Column:
    """The feature extractor that a free-form name stands for."""
    key = F.lower(F.trim(name))
    has = lambda *words: F.array_contains(F.array(*[key.contains(w) for w in words]), True)
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "resnet").when(has("legacy", "8x8", "324"), "hog_legacy").when(has("hog"), "hog")
        .when(has("wavelet", "haar"), "wavelet").when(has("raw", "pixel"), "raw").when(has("resnet"), "resnet").otherwise(key)
    )


def flag(text: Column, default: bool) -> Column:
    """Booleans as manifests write them; blank gives the default."""
    key = F.lower(F.trim(text))
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit(default)).otherwise(key.isin("1", "true", "yes", "y", "plate", "crop"))


def alert_line(status: Column, severity: Column, name: Column, summary: Column) -> Column:
    return F.format_string("[%s] %s %s: %s", F.upper(status), severity, name, summary)


def shown(value: Column) -> Column:
    """Four decimals, n/a for null."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.4f", value))


def done_early(valid: Column, score: Column) -> Column:
    """A reading that is valid and scores 12 or more needs no second look."""
    return F.coalesce(valid & (score >= 12), F.lit(False))


def needs_fallback(valid: Column, score: Column, characters: Column, angle: Column) -> Column:
    """A reading to try anew: turned by more than 15 degrees, of fewer than seven characters, or not valid and below 10."""
    return (F.abs(F.coalesce(angle, F.lit(0.0))) > 15) | (characters < 7) | (~F.coalesce(valid, F.lit(False)) & (F.coalesce(score, F.lit(0.0)) < 10))


def sample_label(path: Column) -> Column:
    """Class of a sample's file: its folder where that is a class, else the first character of its name; null where neither is."""
    folder = F.regexp_extract(path, "([^/]+)/[^/]+$", 1)
    first = F.upper(F.regexp_extract(path, "([^/])[^/]*$", 1))
    single = f"^[{CLASSES}]$"
    return F.when(folder.rlike(single), folder).when(first.rlike(single), first)


def recovered_pair(metadata: Column, blocks: list[str], names: list[str], default: int) -> Column:
    """A pair of whole numbers in a JSON text: from the first block it has, under the first name that the block has.

    One number stands for both; what is neither a number nor a list of two gives the default.
    """
    first = lambda text, keys: F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in keys])
    found = first(first(F.lower(metadata), blocks), names)  # names in any case
    listed = F.from_json(found, "array<int>")
    one = F.when(found.rlike("^-?[0-9]+$"), found).try_cast("int")
    return F.coalesce(F.when(F.size(listed) == 2, listed), F.when(one.isNotNull(), F.array(one, one)), F.array(F.lit(default), F.lit(default)))
