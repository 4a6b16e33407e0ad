"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, and the characters that end a line.
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: The same white space as a string, for trimming.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Sentence ends, hyphens, and code-point ranges of script classes.
TERMINAL = "[.!?…。！？؟۔]"
HYPHEN = "[-‐‑­]"
SCRIPTS = {
    "latin": r"\x{41}-\x{24f}\x{1e00}-\x{1eff}",
    "cyrillic": r"\x{400}-\x{52f}",
    "arabic": r"\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}",
    "deva": r"\x{900}-\x{97f}",
    "cjk": r"\x{2e80}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff66}-\x{ff9d}",
}
#: Wide code points (two cells) and right-to-left letters, as ranges.
WIDE = r"\x{1100}-\x{115f}\x{2e80}-\x{303e}\x{3041}-\x{33ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{a000}-\x{a4cf}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{fe30}-\x{fe6f}\x{ff00}-\x{ff60}\x{ffe0}-\x{ffe6}\x{1f300}-\x{1f64f}\x{1f900}-\x{1f9ff}\x{20000}-\x{3fffd}"
RTL = r"\x{590}-\x{8ff}\x{fb1d}-\x{fdff}\x{fe70}-\x{feff}"


def count_of(c: Column, inside: str) -> Column:
    """Characters of a class, by what is left when the others go: no array of matches is made."""
    return F.length(F.regexp_replace(c, f"[^{inside}]+", ""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def split_lines(c: Column) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, f"(?:{LINE_END})\\z", ""), LINE_END, -1))


def expand_tabs(c: Column, stop: int = 8) -> Column:
    """Tabs as spaces up to the next stop."""
    none = F.lit(None).cast("string")
    grown = F.aggregate(F.split(c, "\t", -1), none, lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, F.repeat(F.lit(" "), F.lit(stop) - F.length(a) % stop), x)))
    return F.when(F.instr(c, "\t") > 0, grown).otherwise(c)


def clean(c: Column) -> Column:
    """Body text that cannot open a comment."""
    return strip(F.replace(c, F.lit("<!--"), F.lit("<! --")))


def cell(c: Column) -> Column:
    return F.replace(F.replace(clean(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def heading(c: Column, title: Column) -> Column:
    t = clean(c)
    return F.concat(F.when(title, "# ").otherwise("## "), F.when(t.startswith("#"), F.concat(F.lit("\\"), t)).otherwise(t))


def anchor(page: Column, x0: Column, y0: Column, x1: Column, y1: Column, tag: Column) -> Column:
    """The comment that places an element; null without geometry."""
    s = lambda x: x.cast("string")
    return F.concat(F.lit("<!-- @"), s(page), F.lit(" ["), s(x0), F.lit(","), s(y0), F.lit(","), s(x1), F.lit(","), s(y1), F.lit("] "), tag, F.lit(" -->"))


def page_marker(page: Column, width: Column | None = None, height: Column | None = None, unit: Column | None = None, scale: Column | None = None) -> Column:
    out = [F.lit("<!-- page "), page.cast("string")]
    if width is not None:
        size = F.concat(F.lit(" size="), F.floor(width + 0.5).cast("string"), F.lit("x"), F.floor(height + 0.5).cast("string"), F.lit(" unit="), unit)
        out.append(F.when(F.coalesce(width, F.lit(0)) != 0, size).otherwise(""))
    if scale is not None:
        out.append(F.when(scale != 1, F.concat(F.lit(" scale="), scale.cast("string"))).otherwise(""))
    return F.concat(*out, F.lit(" -->"))


def fence(rows: Column) -> Column:
    """A run of backticks longer than any in the rows, three at least."""
    runs = F.transform(F.flatten(F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit("(`+)"), F.lit(1)))), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def collapse(c: Column) -> Column:
    """White space of marked-up text: newlines kept once, else one space."""
    t = F.regexp_replace(c, f"[{WS}]*\n[{WS}]*", "\n")
    t = F.regexp_replace(t, r"[\t\x{0b}-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " ")
    return strip(t)


def norm(c: Column) -> Column:
    """White space normalised, lower case."""
    return F.lower(norm_ws(c))


def norm_ws(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{WS}]+", " "))


def cell_width(c: Column) -> Column:
    """Display cells: none for marks and format characters, two for wide ones. Ranges approximate the width tables."""
    bare = F.regexp_replace(c, r"[\p{Mn}\p{Me}\p{Cf}]", "")
    return (F.length(bare) + count_of(bare, WIDE)).cast("long")


def is_rtl(c: Column) -> Column:
    right = count_of(c, RTL)
    return right > count_of(c, r"\p{L}") - right


def uncoverable(c: Column) -> Column:
    """Characters outside Latin-1."""
    return F.length(F.regexp_replace(c, r"[\x{00}-\x{ff}]+", "")).cast("long")


#: Closers of a text are looked for in so many last characters before the whole text is.
_TAIL = 16


def last_mark(c: Column) -> Column:
    """The last character after closing quotes, brackets and white space are gone."""
    bare = lambda x: F.regexp_replace(x, f"[{WS}\"\\x{{27}}\\p{{Pe}}\\p{{Pf}}]+\\z", "")
    tail = bare(F.right(c, F.lit(_TAIL)))
    return F.right(F.when(tail != "", tail).otherwise(bare(c)), F.lit(1))


def ends_terminal(c: Column) -> Column:
    return is_terminal(last_mark(c))


def ends_hyphen(c: Column) -> Column:
    return is_hyphen(last_mark(c))


def is_terminal(mark: Column) -> Column:
    return mark.rlike(f"^{TERMINAL}$")


def is_hyphen(mark: Column) -> Column:
    return mark.rlike(f"^{HYPHEN}$")


def starts_lowercase(c: Column, voided: Column) -> Column:
    """Whether the first cased letter is lower; null without one, or where the page's case says nothing."""
    first = F.regexp_extract(c, r"([\p{Lu}\p{Ll}])", 1)
    return F.when(voided | (first == ""), F.lit(None).cast("boolean")).otherwise(first.rlike(r"^\p{Ll}$"))


def case_counts(c: Column) -> tuple[Column, Column]:
    """Upper-case letters, and upper- and lower-case letters together."""
    cased = F.regexp_replace(c, r"[^\p{Lu}\p{Ll}]+", "")
    return F.length(F.regexp_replace(cased, r"\p{Ll}+", "")).cast("long"), F.length(cased).cast("long")


def case_voided(upper: Column, cased: Column) -> Column:
    """No cased letters, or nine tenths of them upper case."""
    return 10 * upper >= 9 * cased


def script_class(c: Column) -> Column:
    """The script of nine tenths of the classified letters, mixed, or none; ties go to the greater name."""
    letters = F.regexp_replace(c, r"[^\p{L}]+", "")
    n = {k: count_of(letters, v) for k, v in SCRIPTS.items()}
    total = sum(n.values(), F.lit(0))
    best = F.greatest(*(F.struct(v.alias("n"), F.lit(k).alias("k")) for k, v in n.items()))
    return F.when(total == 0, "none").when(10 * best["n"] >= 9 * total, best["k"]).otherwise("mixed")


def digit_class(c: Column) -> Column:
    d = count_of(c, r"\p{Nd}")
    a = count_of(c, r"\p{Nd}\p{L}")
    return F.when(~c.rlike(r"\p{Nd}"), "none").when(d == a, "all").when(2 * d >= a, "high").otherwise("low")
