"""Personal information in free text, by anchor expansion.

One Aho-Corasick automaton finds at-signs, titles, street words and other cues; runs of digits and masks are anchors of
their own. At each anchor a deterministic parser of its kind expands to the left and right and validates the boundaries.
Boundaries are those of the grammar (a line, a sentence, a run of address words, the words of a name), never a number of
characters, and every text is walked in time that grows with its length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.session import widen

# Anchors by the parser they call. A cue ends where the item may begin, or stands inside or after it.
EMAIL_ANCHORS = ("@",)
PHONE_ANCHORS = ("ontact", "obile", "hone", "umber", "eached", "eached on", "each ", "ollect ", "Tel", "tel", "Call", "call", "WhatsApp", "Fax", "fax")
ID_ANCHORS = ("Aadhaar", "aadhaar", "AADHAAR", "PAN", "Permanent Account", "assport", "PASSPORT", "dentity no", "dentity number", "ID no", "UID")
STREET_ANCHORS = (" Road", " Street", " Lane", " Marg", " Avenue", " Cross", " Nagar", " Colony", " Layout", " Salai", " Chowk", " Path")
TITLE_ANCHORS = ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Shri ", "Smt. ", "Sri ", "Kum. ", "Prof. ", "Miss ", "Mr ", "Mrs ", "Ms ", "Dr ", "Smt ")
NAME_CUES = (
    "Name :", "Name: ", "Name ", "Holder : ", "Holder: ", "Dear ", "Signed by ", "signed by ", "verified for ", "Nominee: ", "Nominee : ", "write to ", "applicant ", " s/o ", " w/o ", " d/o ", " c/o ",
    "collected from ", "UPI/", "IMPS-", "NEFT ", "TRF TO ", "TRF FROM ", "RTGS ", "Attn: ", "witness ", "Witness: ", "Guarantor: ", "in favour of ", "Beneficiary: ", "Payee: ",
)
AFTER_NAME_CUES = (" s/o ", " w/o ", " d/o ", " c/o ", " (PAN", " (Aadhaar", " (passport", " (Passport", " executed ", " was ", " is ", " can be ", " resides ", ", residing ", " residing ", ", resident ", " signed ", " hereby ")

# Words that make a name one of a firm, bank or place, or that head a column.
NOT_PERSON = set(
    "Ltd Limited Pvt Private LLP Inc Corp Company Co Bank Traders Agencies Foods Infra Estates Textiles Steel Works Housing Finance Industries Enterprises Services Cooperative Commercial Peoples Sons Brothers "
    "Trust Society Association Ministry Department Office Branch Tax Income Total Gross Account Date Period Balance Statement Number Rent Flat Road Street Lane Marg Avenue Cross "
    "Sir Madam Customer Holder The This That Interest Payment Page".split()
)
_UPPER_NOT = {w.upper() for w in NOT_PERSON} | {"RENT", "UPI", "NEFT", "IMPS", "RTGS", "ATM", "POS", "PAN", "IFSC", "MICR"}

_IN_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_PHONE = re.compile(
    r"(?=[(+\d])(?<![\w+])(?:"
    r"\(?\+91\)?[ -]?\d{5}[ -]?\d{5}"
    r"|\(?\+44\)?[ -]?\d{2,4}[ -]?\d{3,4}[ -]?\d{3,4}"
    r"|\(?\+1\)?[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{4}"
    r"|\(?\+\d{1,3}\)?(?=(?:[ ()-]*\d){8,12}(?![ -]?\d))[ -]?\(?\d{2,5}\)?(?:[ -]?\d{2,6}){1,3}"
    r"|0\d{2,4}-\d{4} ?\d{4}|0\d{2,4}-\d{6,8}"
    r"|0\d{4} \d{3} ?\d{3}|07\d{3}[ -]?\d{3}[ -]?\d{3}"
    r"|0?[5-9]\d{4}[ -]?\d{5}"
    r"|\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4}"
    r")(?![\w@]|[-/]\d|\.\d)"
)
_AADHAAR = re.compile(r"(?<![\w-])[\dXx*]{4}([ -]?)[\dXx*]{4}\1\d{4}(?![\w]|-\d)")
_PAN = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{5}\d{4}[A-Z]|[A-Z]{2,5}[Xx*]{2,6}\d{2,4}[A-Z]|[Xx*]{5,6}\d{4}[A-Z*]|[A-Z]{5}[Xx*]{4}[A-Z])(?![A-Za-z0-9])")
_PASSPORT = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]\d{7}|[A-Z][Xx*]{3,5}\d{2,4})(?![A-Za-z0-9])")
# Forms that need no cue: an Aadhaar number in groups that are no part of a longer row of groups, a whole passport number
# (a masked one, or twelve digits in one run, looks like an account).
# The runs only say where it is worth to try.
_RUN = re.compile(r"\d[\d ()-]{7,}\d")
_MASK = re.compile(r"[Xx*]{4}[ -]")
_GROUPS = re.compile(r"(?<![\d*Xx][ -])(?<![\w+-])[\dXx*]{4}([ -])[\dXx*]{4}\1\d{4}(?![\w]|[ -]\d)")
_WHOLE_PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z]\d{7}(?![A-Za-z0-9])")
_POSTAL = re.compile(r"(?<![\d,./-])\d{3} ?\d{3}(?!\d|[,.]\d)")
# A run of words an address may be of: capitalised words, numbers and a few small words, with commas and blanks between.
_ADDRESS_RUN = re.compile(r"(?:(?:[A-Z][\w'.&/-]*|[A-Z]?\d[\w/-]*|near|opp\.?|opposite|behind|beside|off|of|the|and|no\.?)(?: ?[-–] ?|, ?|\. ?| |(?=[\n|;:)(\"]|$)))+")
_DOOR = re.compile(r"(?:(?:H\.? ?No\.?|D\.? ?No\.?|Door No\.?|Flat(?: No\.?)?|House No\.?|Plot No\.?|Apt\.?|Unit|No\.?) ?)?(?<![\w/-])\d{1,4}[A-Z]?(?:[-/]\d{1,4}[A-Z]?)*,? (?=[A-Z])")
_W = r"(?:[A-Z][a-z]+(?:[A-Z][a-z]+)?(?:-[A-Z][a-z]+)?|[A-Z]{2,}(?:-[A-Z]{2,})?)"
_NAME = re.compile(rf"(?:{_W}, {_W}(?: [A-Z]\.)?(?![\w])|{_W}(?: [A-Z]\.){{1,2}} {_W}|(?:[A-Z]\. ?){{1,3}}{_W}(?: {_W})?|{_W} {_W}(?![\w]))")
_NAME_LEFT = re.compile(rf"(?:{_W}, {_W}(?: [A-Z]\.)?|{_W}(?: [A-Z]\.){{1,2}} {_W}|(?:[A-Z]\. ?){{1,3}}{_W}|{_W} {_W})$")
_NEXT = re.compile(r" +([A-Z][A-Za-z]+)")
_TITLE = re.compile(r"(?:(?:Mrs?|Ms|Dr|Smt|Kum|Prof)\.? |(?:Shri|Sri|Miss) )")
# Ends of a sentence, a line or a cell.
_BREAK = re.compile(r"\n|\||[.!?।] +(?=[A-Z])")
# What stands before numbers that are not personal.
_NOT_NUMBER = re.compile(r"(?:[Vv]oucher|[Oo]rder(?: no\.?)?|UTR|[Aa]ccount(?: [Nn]umber| [Nn]o\.?)?|A/c No\.?|IFSC|MICR|GSTIN|[Ii]nvoice|[Cc]heque|Ref(?:\.| no\.?)?|Acknowledgement Number)\s*:?\s*$")

OUT = "origin string, doc_id string, seq int, pii_type string, pii_value string"
#: Which kind wins where spans overlap.
_FIRST = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}


def automaton():
    """The anchors, each with the kinds of parser it calls."""
    import ahocorasick

    kinds: dict[str, set[str]] = {}
    for kind, anchors in (("email", EMAIL_ANCHORS), ("phone", PHONE_ANCHORS), ("id", ID_ANCHORS), ("street", STREET_ANCHORS), ("title", TITLE_ANCHORS), ("cue", NAME_CUES), ("after", AFTER_NAME_CUES)):
        for a in anchors:
            kinds.setdefault(a, set()).add(kind)
    found = ahocorasick.Automaton()
    for a, k in kinds.items():
        found.add_word(a, (len(a), tuple(sorted(k))))
    found.make_automaton()
    return found


def _person(text: str, start: int, end: int) -> bool:
    """Whether the words of a span, and the one after it, are of a person rather than of a firm, bank or place."""
    words = re.findall(r"[A-Za-z]{2,}", text[start:end])
    if not words or any(w in NOT_PERSON or w in _UPPER_NOT for w in words):
        return False
    nxt = _NEXT.match(text, end)
    if nxt and (nxt[1] in NOT_PERSON or (nxt[1] in _UPPER_NOT and nxt[1] not in ("RENT",))):
        return False
    return not re.match(r" and Company", text[end : end + 12])


def _name_at(text: str, at: int) -> tuple[int, int] | None:
    """The name that begins at an offset, after blanks and titles."""
    while at < len(text) and text[at] == " ":
        at += 1
    while m := _TITLE.match(text, at):
        at = m.end()
    m = _NAME.match(text, at)
    if m is None:
        return None
    end = m.end()
    if ", " in m.group() and not _person(text, at, end):
        return None
    # "S. SURNAME RENT": the narration's own word is no part of the name; what is left must still be one
    words = text[at:end].split()
    if words[-1] in _UPPER_NOT:
        end -= len(words[-1]) + 1
        if not _NAME.fullmatch(text, at, end):
            return None
    return (at, end) if _person(text, at, end) else None


def _local_part(text: str, at: int) -> int:
    """Where the part of an address before an at-sign begins; ``at`` if there is none."""
    i = at
    while i and text[i - 1] in _IN_LOCAL:
        i -= 1
    while i < at and not text[i].isalnum():
        i += 1
    return i if i < at and text[at - 1] != "." else at


def _names_before(text: str, at: int) -> tuple[int, int] | None:
    """The name that ends at an offset: the longest that the last five words make."""
    lo = at
    for _ in range(5):
        lo = text.rfind(" ", 0, lo)
        if lo < 0:
            break
    lo = max(lo + 1, text.rfind("\n", 0, at) + 1, text.rfind("|", 0, at) + 1)
    m = _NAME_LEFT.search(text, lo, at)
    return m.span() if m and _person(text, *m.span()) else None


class _Sentences:
    """Whether a cue stands in the same sentence before an offset."""

    def __init__(self, text: str, cues: list[int]) -> None:
        self.text, self.cues = text, cues
        self.seen: dict[int, tuple[int, int]] = {}  # of a cue: how far its sentence is known, and where it ends

    def before(self, at: int) -> bool:
        k = bisect_right(self.cues, at)
        if not k:
            return False
        cue = self.cues[k - 1]
        known, end = self.seen.get(cue, (cue, len(self.text)))
        if known < at <= end:
            m = _BREAK.search(self.text, known, at)
            known, end = (at, end) if m is None else (m.end(), m.start())
            self.seen[cue] = known, end
        return at <= end


def _numbers(text: str, phone_cues: list[int], id_cues: list[int]) -> Iterator[tuple[int, int, str]]:
    """Phone and identity numbers by their form. Glued to a slash (parts of codes and paths) phones need a cue in
    their sentence, and so do forms that accounts and codes have too; none is taken after words that make it a number
    of something else."""
    called, identified = _Sentences(text, phone_cues), _Sentences(text, id_cues)

    def free(a: int, b: int) -> bool:
        return text[a - 1 : a] != "/" and text[b : b + 1] != "/"

    tried = [(m, "id_number", False) for pattern in (_PAN, _WHOLE_PASSPORT) for m in pattern.finditer(text)]
    runs = [(max(0, r.start() - 2), r.end() + 3) for r in _RUN.finditer(text)]
    masks = [(max(0, r.start() - 5), r.end() + 12) for r in _MASK.finditer(text)]
    for kind, pattern, spans in (("id_number", _GROUPS, runs + masks), ("phone", _PHONE, runs)):
        tried += [(m, kind, kind == "phone" and not free(*m.span())) for lo, hi in spans for m in pattern.finditer(text, lo, hi)]
    if id_cues:
        tried += [(m, "id_number", True) for pattern in (_AADHAAR, _PASSPORT) for m in pattern.finditer(text, id_cues[0])]
    for m, kind, weak in tried:
        a, b = m.span()
        if _NOT_NUMBER.search(text, max(0, a - 64), a):
            continue
        if weak:
            if not (called if kind == "phone" else identified).before(a) or (kind == "id_number" and text[a - 1 : a] == "+"):
                continue
        elif kind == "id_number" and not free(a, b):
            continue
        if kind == "phone" and text[a] == "+" and text[a - 1 : a] == "(" and ")" in m.group() and "(" not in m.group():
            a -= 1
        yield a, b, kind


def _address(text: str, streets: list[int]) -> Iterator[tuple[int, int, str]]:
    """Addresses: in a run of address words that holds a street word, from the door number to the postal code."""
    k, first = 0, streets[0]
    for run in _ADDRESS_RUN.finditer(text, max(text.rfind("\n", 0, first), text.rfind("|", 0, first)) + 1):
        k = bisect_right(streets, run.start(), k)
        if k == len(streets):
            return
        pos = run.start()
        while k < len(streets) and streets[k] < run.end():  # a run may hold several addresses
            at = streets[k]
            tail = _POSTAL.search(text, at, run.end())
            if tail is None:
                break
            doors = list(_DOOR.finditer(text, pos, at))
            if doors:
                whole = len(doors) == 1 or not re.search(r"[.:;]", text[doors[0].end() : doors[-1].start()])
                yield doors[0].start() if whole else doors[-1].start(), tail.end(), "address"
            pos = tail.end()
            k = bisect_right(streets, pos, k)


def find(text: str | None, anchors) -> list[tuple[int, int, str]]:
    """Spans of personal information: start, end, type, in order and without overlap."""
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    cues: dict[str, list[int]] = {"phone": [], "id": [], "street": []}
    for last, (size, kinds) in anchors.iter(text):
        end = last + 1
        start = end - size
        for kind in kinds:
            if kind == "email":
                left, right = _local_part(text, start), _DOMAIN.match(text, end)
                if left < start and right:
                    spans.append((left, right.end(), "email"))
            elif kind == "phone" or kind == "id":
                cues[kind].append(end)
            elif kind == "street":
                cues[kind].append(start)
            elif kind in ("title", "cue"):
                if start and text[start - 1].isalpha() and text[start].isalpha():
                    continue
                if (at := _name_at(text, end)) is not None:
                    spans.append((*at, "name"))
            elif (at := _names_before(text, start)) is not None:
                spans.append((*at, "name"))
    spans += _numbers(text, cues["phone"], cues["id"])
    if cues["street"]:
        spans += _address(text, cues["street"])
    if not spans:
        return spans
    spans.sort(key=lambda s: (_FIRST[s[2]], s[0], -s[1]))
    kept: list[tuple[int, int, str]] = []  # in order of their places
    for s in spans:
        k = bisect_right(kept, (s[0], len(text) + 1, ""))
        if (k == 0 or kept[k - 1][1] <= s[0]) and (k == len(kept) or kept[k][0] >= s[1]):
            kept.insert(k, s)
    return kept


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with typed placeholders for the spans, everything else unchanged."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("origin", pa.string()), ("doc_id", pa.string()), ("seq", pa.int32()), ("pii_type", pa.string()), ("pii_value", pa.string())])
    anchors = automaton()
    for b in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        origin, doc, seq, texts = (c.to_pylist() for c in b.columns)
        for i, text in enumerate(texts):
            for start, end, kind in find(text, anchors):
                for name, value in (("origin", origin[i]), ("doc_id", doc[i]), ("seq", seq[i]), ("pii_type", kind), ("pii_value", text[start:end])):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for b in batches:
        texts = pa.array([redact(t, find(t, anchors)) for t in b.column(3).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], texts], names=["origin", "doc_id", "seq", "text"])


def _texts(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    return chunks.select(F.lit("chunk").alias("origin"), "doc_id", F.col("chunk_index").alias("seq"), "text").unionByName(
        lines.select(F.lit("line").alias("origin"), "doc_id", F.col("line_no").alias("seq"), "text")
    )


def found(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """Every distinct item of personal information: origin, doc_id, seq, pii_type, pii_value (as it stands).

    In: chunks (doc_id, chunk_index, text), lines (doc_id, line_no, text); further columns are ignored. Null and
    empty texts hold none; copies of a row count once; a value that stands twice in a text is one row.
    """
    return widen(_texts(chunks, lines).where(F.length("text") > 3)).mapInArrow(_found, OUT).distinct()


def redacted(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """origin, doc_id, seq, text of every row with typed placeholders (``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``,
    ``[ADDRESS]``, ``[NAME]``) for what :func:`found` finds; null and empty texts stay as they are, rows stay rows."""
    return widen(_texts(chunks, lines)).mapInArrow(_redacted, "origin string, doc_id string, seq int, text string")
