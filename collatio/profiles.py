"""Constants of a kind of text, as one value that operators take."""

from __future__ import annotations

from dataclasses import dataclass

# The five blocks of Han characters, as the inside of a regex class.
HAN_CLASS = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2ffff}"
# Punctuation removed from letters (all else stays).
LETTER_MARKS_CLASS = "，。、；：？！「」『』《》〈〉（）()\\[\\]【】〔〕,.;:!?\"'’‘“”—\\-·…"
# Titles of the front sections, all of volume number 0.
FRONT_SECTIONS = ("提要", "原序", "門目", "姓氏")
# Lines of a cover, neither heading nor text.
COVER_PATTERNS = (
    "^欽定四庫全書",
    "^朱子語類[卷巻]第?[一二三四五六七八九十百]+$",
    "^朱子語類提要$",
    "^朱子語類原序$",
    "^朱子語類門目$",
    "^朱子語類姓氏$",
    r"^朱子語類[\x{3000}\s]+儒家類$",
)
# Fixed value: the volume title that may end a paragraph of the XML witness.
TRAILING_COVER = "朱子語類[卷巻]第?[一二三四五六七八九十百]+"
TITLE_PREFIX = "朱子語類"


@dataclass(frozen=True)
class TextProfile:
    """What counts as text, where sentences end and what is looked for."""

    name: str
    #: inside of a regex class of the characters that are text, or
    keep_class: str | None = None
    #: of those that are not (white space always goes with them)
    drop_class: str | None = None
    terminators: str = "。？！；"
    paragraph_separator: str = "\n\n"
    byline_max: int = 8
    byline_mark: str = "/"
    keywords: tuple[str, str] = ("理", "氣")
    keyword_names: tuple[str, str] = ("li", "qi")
    #: deletions up to this length are no fallback spans
    small_delete: int = 3
    #: paragraphs that occur so often keep only the first
    repeat_limit: int = 5
    context: int = 20
    fallback_context: int = 50


HAN_CORPUS = TextProfile("han_corpus", keep_class=HAN_CLASS)
HAN_LETTERS = TextProfile("han_letters", drop_class=LETTER_MARKS_CLASS, terminators="。？！")
#: For text in Latin letters: the same operators with other constants.
LATIN = TextProfile(
    "latin", keep_class=r"\p{L}", terminators=".?!", paragraph_separator="\n",
    keywords=("tion", "ment"), keyword_names=("tion", "ment"),
)
