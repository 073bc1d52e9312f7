"""Pieces of DuckDB SQL that the checking statements share."""

from __future__ import annotations

from paperlode.functions.scalars import DATE_TEXT, KEYWORD, STOP_WORDS


def q(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


SPACES = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def tokens(e: str) -> str:
    return f"len(regexp_extract_all({e}, {q(f'[A-Za-z]{{1,4}}|[^A-Za-z{SPACES}]')}))"


def squash(e: str) -> str:
    return f"regexp_replace(lower({e}), '[^a-z]', '', 'g')"


def amount(e: str) -> str:
    t = f"replace(trim({e}), ' ', '')"
    bare = f"replace(trim(regexp_replace({t}, '(?i)(cr|dr)$', ''), '()-'), ',', '')"
    negative = f"(({t} LIKE '(%' AND {t} LIKE '%)') OR {t} LIKE '-%' OR upper({t}) LIKE '%DR')"
    return f"(CASE WHEN regexp_matches({bare}, '^(\\d+\\.?\\d*|\\.\\d+)$') THEN CASE WHEN {negative} THEN -try_cast({bare} AS DECIMAL(18,2)) ELSE try_cast({bare} AS DECIMAL(18,2)) END END)"


def inr(e: str) -> str:
    a = f"CAST({e} AS DECIMAL(18,2))"
    text = f"CAST(abs({a}) AS VARCHAR)"
    whole, cents = f"split_part({text}, '.', 1)", f"split_part({text}, '.', 2)"
    head, tail = f"left({whole}, greatest(length({whole}) - 3, 0))", f"right({whole}, 3)"
    groups = f"reverse(rtrim(regexp_replace(reverse({head}), '(\\d\\d)', '\\1,', 'g'), ','))"
    return f"(CASE WHEN {a} < 0 THEN '-' ELSE '' END || CASE WHEN length({whole}) > 3 THEN {groups} || ',' || {tail} ELSE {whole} END || CASE WHEN {cents} = '00' THEN '' ELSE '.' || {cents} END)"


def day(e: str) -> str:
    t = f"left(trim(regexp_replace({e}, '\\s+', ' ', 'g')), 11)"

    def whole(v: str) -> str:
        out = "CASE"
        for sep, short in (("/", True), ("-", True), ("\\.", False)):
            years = "(\\d{4}|\\d{2})" if short else "(\\d{4})"
            p = f"^(\\d{{1,2}}){sep}(\\d{{1,2}}){sep}{years}$"
            out += f" WHEN regexp_matches({v}, '{p}') THEN {ymd(v, p, 3, 2, 1, False)}"
        for sep, short in ((" ", True), ("-", True), ("/", False)):
            years = "(\\d{4}|\\d{2})" if short else "(\\d{4})"
            p = f"(?i)^(\\d{{1,2}}){sep}(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec){sep}{years}$"
            out += f" WHEN regexp_matches({v}, '{p}') THEN {ymd(v, p, 3, 2, 1, True)}"
        p = "^(\\d{4})-(\\d{1,2})-(\\d{1,2})$"
        return out + f" WHEN regexp_matches({v}, '{p}') THEN {ymd(v, p, 1, 2, 3, False)} END"

    def ymd(v: str, p: str, y: int, m: int, d: int, named: bool) -> str:
        year = f"regexp_extract({v}, '{p}', {y})"
        full = f"CASE WHEN length({year}) = 4 THEN {year} WHEN {year} >= '69' THEN '19' || {year} ELSE '20' || {year} END"
        month = f"regexp_extract({v}, '{p}', {m})"
        if named:
            month = f"CAST((position(lower({month}) IN 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) // 3 AS VARCHAR)"
        return f"try_cast({full} || '-' || lpad({month}, 2, '0') || '-' || lpad(regexp_extract({v}, '{p}', {d}), 2, '0') AS DATE)"

    prefix = f"regexp_extract({t}, {q('^' + DATE_TEXT)})"
    return f"coalesce({whole(t)}, {whole(prefix)})"


def keywords(e: str) -> str:
    stop = ", ".join(q(w) for w in STOP_WORDS)
    return f"list_filter(regexp_extract_all(lower({e}), {q(KEYWORD)}), lambda t: t NOT IN ({stop}))"


LINES = "l AS (SELECT doc_id, line_no, page, text, cells FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY loaded_at) AS n FROM doc_lines WHERE doc_id IS NOT NULL AND line_no IS NOT NULL) WHERE n = 1)"
