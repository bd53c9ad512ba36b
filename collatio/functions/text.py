"""Column functions on text; none of them leaves the JVM.

White space is Unicode's, with the four separators U+001C to U+001F, unlike
Java's `\\s` and Spark's trim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from collatio.profiles import FRONT_SECTIONS, TextProfile

#: Use only behind (?U).
SPACE = r"[\s\x{1c}-\x{1f}]"
#: The same characters, one by one.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPECIAL = "\\^$.|?*+()[]{}-&~"


def quote(text: str) -> str:
    """The text as part of a regex or of a regex class."""
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U){SPACE}+", "")


def keep(text: Column, inside: str) -> Column:
    """Only the characters of a class."""
    return F.regexp_replace(text, f"[^{inside}]", "")


def drop(text: Column, inside: str) -> Column:
    """All but the characters of a class and white space."""
    return F.regexp_replace(text, f"(?U)[{inside}\\s\\x{{1c}}-\\x{{1f}}]+", "")


def plain(text: Column, profile: TextProfile) -> Column:
    """The text proper, by the profile's whitelist or blacklist."""
    if profile.keep_class is not None:
        return keep(text, profile.keep_class)
    return drop(text, profile.drop_class)


def drop_marks_and_separators(text: Column) -> Column:
    """Without Unicode categories P and Z."""
    return F.regexp_replace(text, r"[\p{P}\p{Z}]", "")


def lines(text: Column) -> Column:
    """Lines as Python's splitlines has them; no empty line after a last break."""
    breaks = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
    parts = F.split(text, breaks)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_after(text: Column, terminators: str) -> Column:
    """Pieces that end behind a terminator, stripped, without empty ones."""
    pieces = F.split(text, f"(?<=[{quote(terminators)}])")
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def chars(text: Column) -> Column:
    """Code points as an array; of an empty text an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


_DIGITS = "一二三四五六七八九"


def numeral(label: Column) -> Column:
    """Value of the numeral behind 卷 at the start of a label, else -1.

    A unit multiplies the digit before it, or 1; of digits that follow each
    other the last counts.
    """
    written = F.regexp_extract(label, f"^卷([{_DIGITS}十百]+)", 1)
    state = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"))

    def step(s, c):
        unit = F.when(c == "十", 10).when(c == "百", 100)
        factor = F.when(s["digit"] == 0, 1).otherwise(s["digit"])
        digit = F.instr(F.lit(_DIGITS), c)
        return F.when(unit.isNotNull(), F.struct((s["total"] + factor * unit).alias("total"), F.lit(0).alias("digit"))).otherwise(
            F.struct(s["total"].alias("total"), digit.alias("digit"))
        )

    value = F.aggregate(chars(written), state, step, lambda s: s["total"] + s["digit"])
    return F.when(written == "", F.lit(-1)).otherwise(value)


def volume_number(label: Column, anywhere: bool) -> Column:
    """0 for front sections (named anywhere in the label, or by the whole label)."""
    front = F.lit(False)
    for name in FRONT_SECTIONS:
        front = front | (label.contains(name) if anywhere else label == name)
    return F.when(front, F.lit(0)).otherwise(numeral(label))


def trailing_byline(text: Column, profile: TextProfile, inner_max: int | None = None) -> tuple[Column, Column]:
    """(text without it, byline or null) of a short note with the mark at the end.

    inner_max: how long a closing note is looked at; one longer than the
    profile's limit is left alone, and so is a short one before it.
    """
    limit = inner_max or profile.byline_max
    pattern = f"(?U)\\(([^()]{{1,{limit}}})\\){SPACE}*$"
    inner = F.regexp_extract(text, pattern, 1)
    found = (inner != "") & inner.contains(profile.byline_mark) & (F.length(inner) <= profile.byline_max)
    return (
        F.when(found, rstrip(F.regexp_replace(text, pattern, ""))).otherwise(text),
        F.when(found, F.regexp_extract(text, pattern, 0)),
    )


def without_bylines(text: Column, profile: TextProfile) -> Column:
    """Without short notes with the mark, wherever they stand."""
    mark = quote(profile.byline_mark)
    return F.regexp_replace(text, f"\\((?=[^()]*{mark})[^()]{{1,{profile.byline_max}}}\\)", "")


def marks_after(text: Column, profile: TextProfile) -> tuple[Column, Column]:
    """(characters of text, what follows each up to the next); a lead is dropped."""
    pattern = f"([{profile.keep_class}])([^{profile.keep_class}]*)"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))


def category(text: Column, profile: TextProfile) -> Column:
    """Which of the two keywords a text holds."""
    first, second = (text.contains(k) for k in profile.keywords)
    a, b = profile.keyword_names
    return F.when(first & second, "both").when(first, f"{a}_only").when(second, f"{b}_only").otherwise("neither")


def categories(profile: TextProfile) -> list[str]:
    a, b = profile.keyword_names
    return ["both", f"{a}_only", f"{b}_only", "neither"]


def apply_predictions(text: Column, predictions: Column, marks: Column) -> Column:
    """Text with predicted marks behind its characters.

    predictions: array<struct<end int, entity string>>; marks: map from entity
    to mark.  The mark follows the character that ends at `end`; a later
    prediction for the same place wins; entities not in the map leave none, and
    places outside the text count for nothing.
    """

    placed = F.filter(predictions, lambda p: p["end"].between(1, F.length(text)))
    ordered = F.array_sort(F.transform(placed, lambda p, i: F.struct(p["end"].cast("int").alias("end"), i.alias("i"), p["entity"].alias("entity"))))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"), F.lit(0).alias("end"), F.lit("").alias("mark"))

    def written(s, stop):
        """What is put out when the place held is left for good."""
        return F.concat(s["out"], F.substring(text, s["done"] + 1, stop - s["done"]), s["mark"])

    def step(s, p):
        mark = F.coalesce(F.try_element_at(marks, p["entity"]), F.lit(""))
        same = p["end"] == s["end"]
        return F.struct(
            F.when(same, s["out"]).otherwise(written(s, s["end"])).alias("out"),
            F.when(same, s["done"]).otherwise(s["end"]).alias("done"),
            p["end"].alias("end"),
            mark.alias("mark"),
        )

    return F.aggregate(ordered, state, step, lambda s: F.concat(written(s, s["end"]), F.substring(text, s["end"] + 1, F.length(text))))


# The thirty years of the sexagenary cycle from 1554 on.
SEXAGENARY_START = 1554
SEXAGENARY_YEARS = (
    "甲寅", "乙卯", "丙辰", "丁巳", "戊午", "己未", "庚申", "辛酉", "壬戌", "癸亥",
    "甲子", "乙丑", "丙寅", "丁卯", "戊辰", "己巳", "庚午", "辛未", "壬申", "癸酉",
    "甲戌", "乙亥", "丙子", "丁丑", "戊寅", "己卯", "庚辰", "辛巳", "壬午", "癸未",
)


def sexagenary_year(text: Column) -> Column:
    """Year of the earliest entry of the cycle that the text holds, or null."""
    names = F.array(*[F.lit(n) for n in SEXAGENARY_YEARS])
    held = F.filter(F.sequence(F.lit(0), F.lit(len(SEXAGENARY_YEARS) - 1)), lambda i: text.contains(F.get(names, i)))
    return F.get(held, 0) + F.lit(SEXAGENARY_START)
