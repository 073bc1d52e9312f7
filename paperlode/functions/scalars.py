"""Scalar functions as Column expressions: money, dates, numbers, tokens, text. All run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond the JVM's ASCII classes, for character classes.
SPACES = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Words left out of keyword matching.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it its of on or that the this to was were what which with how much many did does do"
).split()
# The pattern of a keyword, of a number in running text and of a citation mark.
KEYWORD = r"[a-z0-9]+(?:[.,][0-9]+)*"
_KEPT = rf"(?<![a-z0-9])(?!(?:{'|'.join(STOP_WORDS)})(?![a-z0-9]|[.,][0-9])){KEYWORD}"
NUMBER = r"\(?-?[$€£₹¥]?\s?\d[\d,]*(?:\.\d+)?\)?%?"
CITATION = r"\[\d+(?:\s*[,\-–]\s*\d+)*\]"
MONEY = "decimal(18,2)"

# Printed dates.
DATE_TEXT = r"(?:\d{1,2}[/\-. ](?:\d{1,2}|[A-Za-z]{3})[/\-. ]\d{2,4}|\d{4}-\d{2}-\d{2})"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used; keeps generated code small."""
    return F.element_at(F.transform(F.array(value), use), 1)


def squash(text: Column | str) -> Column:
    """Lower-case ASCII letters only."""
    return F.regexp_replace(F.lower(_c(text)), "[^a-z]", "")


def inr(amount: Column | str) -> Column:
    """Money in Indian grouping (last three digits, then twos); ``.00`` is dropped, null stays null."""
    a = _c(amount).cast(MONEY)

    def grouped(text: Column) -> Column:
        whole = F.regexp_replace(F.regexp_extract(text, r"\d+", 0), r"(?<=\d)(?=(\d{2})*\d{3}$)", ",")
        return F.concat(F.regexp_extract(text, "^-", 0), whole, F.regexp_replace(F.right(text, F.lit(3)), r"\.00$", ""))

    return let(a.cast("string"), grouped)


def parse_amount(text: Column | str) -> Column:
    """A printed amount; parentheses, a leading minus or a trailing Dr make it negative. Null if it is none."""
    squeezed = F.replace(F.trim(_c(text)), F.lit(" "), F.lit(""))

    def value(t: Column) -> Column:
        bare = F.replace(F.btrim(F.regexp_replace(t, r"(?i)(cr|dr)$", ""), F.lit("()-")), F.lit(","), F.lit(""))
        sign = F.when(t.rlike(r"^\(.*\)$|^-|[dD][rR]$"), -1).otherwise(1)
        return (sign * let(bare, lambda b: F.when(b.rlike(r"^(\d+\.?\d*|\.\d+)$"), b.try_cast(MONEY)))).cast(MONEY)

    return let(squeezed, value)


def ascii_digits(text: Column | str) -> Column:
    """The text with the decimal digits of every script as 0 to 9."""
    other = [c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Nd"]
    return F.translate(_c(text), "".join(other), "".join(str(unicodedata.digit(c)) for c in other))


def signed(cell: Column | str) -> Column:
    """The first number inside a cell; negative if it starts with a bracket or minus, or the cell ends with Dr."""
    t = F.upper(F.replace(_c(cell), F.lit(" "), F.lit("")))
    raw = F.regexp_extract(t, r"\(?-?[\d,]+(?:\.\d+)?\)?", 0)
    value = F.replace(F.btrim(raw, F.lit("()-")), F.lit(","), F.lit("")).try_cast(MONEY)
    return F.when(raw.rlike(r"\d"), F.when(raw.rlike(r"^[(-]") | t.rlike(r"DR\.?$"), -value).otherwise(value))


def number_value(token: Column | str) -> Column:
    """The value of a number token: currency signs and percent go, enclosing brackets or a minus make it negative."""
    t = F.regexp_replace(_c(token), r"[$€£₹¥\s]", "")
    digits = F.regexp_replace(t, r"[^\d.]", "")
    negative = (t.startswith("(") & t.endswith(")")) | t.startswith("-") | t.startswith("(-")
    value = F.when(digits.rlike(r"^(\d+\.?\d*|\.\d+)$"), digits.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def number_tokens(text: Column | str) -> Column:
    """All number tokens of a text in order as they stand (blanks and a last comma may adjoin), citation marks left out."""
    return F.regexp_extract_all(F.regexp_replace(_c(text), CITATION, " "), F.lit(NUMBER), 0)


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-M-d")


def parse_date(text: Column | str) -> Column:
    """A printed day: d/m/y, d-m-y (years of two or four digits), d.m.Y, d Mon y, d-Mon-y, d/Mon/Y or Y-m-d.

    Only the first eleven characters count; where they are no date as a whole, a date they begin with is taken.
    Years of two digits from 69 on are of the twentieth century.
    """
    t = F.substring(F.trim(F.regexp_replace(_c(text), r"\s+", " ")), 1, 11)
    numeric = r"^(\d{1,2})([/\-.])(\d{1,2})\2(\d{4}|(?<!\.)\d{2})$"
    named = r"^(\d{1,2})([ \-/])((?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))\2(\d{4}|(?<!/)\d{2})$"
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"

    def whole(v: Column) -> Column:
        def year(p: str) -> Column:
            y = F.regexp_extract(v, p, 4)
            return F.when(F.length(y) == 2, F.concat(F.when(y >= "69", "19").otherwise("20"), y)).otherwise(y)

        month = F.array_position(F.lit(_MONTHS), F.lower(F.regexp_extract(v, named, 3))).cast("string")
        return (
            F.when(v.rlike(numeric), _ymd(year(numeric), F.regexp_extract(v, numeric, 3), F.regexp_extract(v, numeric, 1)))
            .when(v.rlike(named), _ymd(year(named), month, F.regexp_extract(v, named, 1)))
            .when(v.rlike(iso), _ymd(F.regexp_extract(v, iso, 1), F.regexp_extract(v, iso, 2), F.regexp_extract(v, iso, 3)))
        )

    return let(t, lambda t: let(F.when((t.rlike(numeric) | t.rlike(named) | t.rlike(iso)), t).otherwise(F.regexp_extract(t, "^" + DATE_TEXT, 0)), whole))


def est_tokens(text: Column | str) -> Column:
    """Estimated model tokens: a letter run costs a quarter of its length (rounded up), any other mark one."""
    return F.regexp_count(_c(text), F.lit(rf"[A-Za-z]{{1,4}}|[^A-Za-z{SPACES}]"))


def keywords(text: Column | str) -> Column:
    """Lower-case keywords; digits joined by dots or commas stay together, stop words go (inside the pattern, so that
    no lambda runs)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(_KEPT), 0)


def garbage_ratio(text: Column | str) -> Column:
    """Share of the characters (without white space) that are private, unassigned, control or replacement ones."""
    bare = F.regexp_replace(_c(text), r"(?U)\s+", "")
    size = F.length(bare)
    return F.when(size == 0, 0.0).otherwise(F.regexp_count(bare, F.lit(r"[\p{Co}\p{Cn}\p{Cc}\x{FFFD}]")) / size)


def page_span(first: Column | str, last: Column | str) -> Column:
    """``a-b``, or ``a`` for a single page."""
    a, b = _c(first), _c(last)
    return F.when(b > a, F.concat_ws("-", a.cast("string"), b.cast("string"))).otherwise(a.cast("string"))


def assessment_year(text: Column | str) -> Column:
    """The first ``20YY-YY`` (or ``20YY/YY``, ``20YY-20YY``) of a text as ``20YY-YY``; null if there is none."""
    p = r"\b(20\d{2})\s*[-/]\s*(20\d{2}|\d{2})\b"
    t = _c(text)
    return F.when(t.rlike(p), F.concat_ws("-", F.regexp_extract(t, p, 1), F.right(F.regexp_extract(t, p, 2), F.lit(2))))


def shorten(text: Column | str, n: int = 48) -> Column:
    """White space evened out and cut to n characters, the last an ellipsis where something is cut."""
    t = F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", " "))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def clean_cell(cell: Column | str) -> Column:
    """A table cell without glyph marks, pipes as slashes, white space evened out."""
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(F.coalesce(_c(cell), F.lit("")), r"\(cid:\d+\)", " "), F.lit("|"), F.lit("/")), r"\s+", " "))


def column_kind(label: Column | str, position: Column | int) -> Column:
    """What a header label heads: balance, debit, credit, date or text (a value date is text)."""
    n, p = squash(label), F.lit(position) if isinstance(position, int) else position
    return (
        F.when(n.contains("balance") | (n == "bal") | (n == "closingbal"), "balance")
        .when(n.contains("debit") | n.contains("withdrawal") | (n == "dr"), "debit")
        .when(n.contains("credit") | n.contains("deposit") | (n == "cr"), "credit")
        .when(n.contains("value"), "text")
        .when(n.contains("date") | ((p == 0) & n.isin("transaction", "txn", "tran", "txndt", "trandate")), "date")
        .otherwise("text")
    )


def suffix_of_tag(text: Column | str, tag: str) -> Column:
    """Length of the longest end of a text that begins a tag without being all of it."""
    t = _c(text)
    hits = [F.when(t.endswith(tag[:k]), F.lit(k)) for k in range(len(tag) - 1, 0, -1)]
    return F.coalesce(*hits, F.lit(0))


def without_thoughts(text: Column | str) -> Column:
    """A text without ``<think>`` blocks; an open block runs to the end."""
    return F.regexp_replace(_c(text), r"(?s)<think>.*?(?:</think>|\z)", "")


def page_kind(chars: Column | str, garbage: Column | str, images: Column | str, least: int = 40, noise: float = 0.30, covered: float = 0.35) -> Column:
    """scanned, hybrid or digital, by text characters, garbage ratio and image coverage."""
    return F.when((_c(chars) < least) | (_c(garbage) > noise), "scanned").when(_c(images) > covered, "hybrid").otherwise("digital")


def last_number(cells: Column, text: Column, label: str) -> Column:
    """The value of a labelled row: its right-most number right of the label, else a number that ends its last filled
    cell after letters. A number equal to the row's first filled cell left of the label is a serial number."""
    number = r"^\(?-?\d[\d,]*(?:\.\d+)?\)?(?:\s*(?:Cr|Dr|CR|DR))?$"
    trailing = r"^(?s)(.*?[A-Za-z].*?)(\(?-?\d{1,3}(?:,\d{2,3})*(?:\.\d+)?\)?)\s*$"
    at = F.greatest(F.array_position(F.transform(cells, lambda c: c.rlike(label)), True).cast("int"), F.lit(1))
    serial = F.try_element_at(F.filter(F.slice(cells, 1, at - 1), lambda c: c != ""), F.lit(1))
    right = F.slice(cells, at + 1, F.greatest(F.size(cells) - at, F.lit(0)))
    cell = F.try_element_at(F.filter(right, lambda c: c.rlike(number) & ~c.eqNullSafe(serial)), F.lit(-1))
    filled = F.try_element_at(F.filter(F.slice(cells, at, F.size(cells)), lambda c: c != ""), F.lit(-1))
    tail_of = F.when(cells.isNull(), text).otherwise(F.coalesce(filled, F.lit("")))
    tail = F.when(tail_of.rlike(trailing), F.regexp_extract(tail_of, trailing, 2))
    return F.when(cells.isNotNull(), F.coalesce(cell, tail)).otherwise(tail)
