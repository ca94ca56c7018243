"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, scheme marks, plus signs before a digit, digits and cue
words. At each anchor a small deterministic parser expands to both sides to the boundaries of an e-mail address, a network
address, a card, a phone or an account number, and validates what it found. Parsers of one kind never go back before the
end of their last find, so a text is read in linear time whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order of their report, the first four being the base ones; letters of an address; cue words.
KINDS = ("email", "ip", "card", "phone", "account", "address", "iban")
BASE = 4
DIGITS = frozenset("0123456789")
HOST = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")
LOCAL = HOST | frozenset("._%+")
DIALLED = DIGITS | frozenset(" ().-")
CUES = ("account", "acct", "passport", "ssn")

#: The added kinds, matched at their anchor only.
ACCOUNT = re.compile(r"\b(?i:account|acct|passport|ssn)(?: ?(?i:number|no\.?|#))?[ :=#]{1,3}([A-Z]{0,2}[0-9](?:[ -]?[0-9]){4,16})\b", re.ASCII)
LOGIN = re.compile(r"://[^\x00-\x20/?#@<>\x22]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", re.ASCII)

Span = tuple[int, int, int]  # place of the kind in KINDS, start, end


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def iban_holds(text: str) -> bool:
    """Whether the check digits of an account number hold (remainder 1 modulo 97)."""
    bare = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _email(text: str, at: int, since: int) -> tuple[int, int] | None:
    """Bounds of the address around an at-sign; its local part begins at since or later."""
    start = at
    while start > since and text[start - 1] in LOCAL:
        start -= 1
    end, dots, n = at + 1, 0, len(text)
    while end < n and text[end] in HOST:
        end += 1
    if start == at or end == at + 1:
        return None
    while end + 1 < n and text[end] == "." and text[end + 1] in HOST:
        dots, end = dots + 1, end + 2
        while end < n and text[end] in HOST:
            end += 1
    return (start, end) if dots else None


def _dotted(text: str, start: int) -> tuple[int, int]:
    """(end, parts) of a chain of at most four digit runs with single dots between, begun at a digit."""
    end, parts, n = start, 0, len(text)
    while parts < 4:
        while end < n and text[end] in DIGITS:
            end += 1
        parts += 1
        if parts == 4 or not (end + 1 < n and text[end] == "." and text[end + 1] in DIGITS):
            break
        end += 1
    return end, parts


def _spaced(text: str, start: int) -> int:
    """End of a run of digits with at most one space or hyphen between two of them."""
    end, n = start + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def _dialled(text: str, plus: int) -> int | None:
    """End of a number that begins with a plus sign and a digit: the last digit of what can be dialled."""
    end, n = plus + 2, len(text)
    while end < n and text[end] in DIALLED:
        end += 1
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end >= plus + 4 else None


def anchors() -> ahocorasick.Automaton:
    """The automaton over all anchors; a hit gives the anchor's first character's distance from its last, and its kind."""
    found = ahocorasick.Automaton()
    found.add_word("@", (0, "@"))
    found.add_word("://", (2, "s"))
    for d in DIGITS:
        found.add_word(d, (0, "d"))
        found.add_word(f"+{d}", (1, "+"))
    for cue in CUES:
        for spelt in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(spelt, (len(cue) - 1, "c"))
    found.make_automaton()
    return found


def private_spans(text: str, automaton: ahocorasick.Automaton) -> list[Span]:
    """Spans (place in KINDS, start, end) of a text, by kind, then start; offsets are code points."""
    out: list[Span] = []
    mail = dotted = run = phone = scheme = iban = 0
    for last, (back, kind) in automaton.iter(text):
        at = last - back
        if kind == "d":
            if at >= dotted:
                dotted, parts = _dotted(text, at)
                if parts == 4 and all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in text[at:dotted].split(".")):
                    out.append((1, at, dotted))
            if at >= run:
                run = _spaced(text, at)
                digits = text[at:run].replace(" ", "").replace("-", "") if 13 <= run - at <= 37 else ""
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, at, run))
            if at >= iban + 2 and (shaped := IBAN.match(text, at - 2)):
                iban = shaped.end()
                if iban_holds(shaped.group()):
                    out.append((6, at - 2, iban))
        elif kind == "@":
            found = _email(text, at, mail)
            if found:
                out.append((0, *found))
                mail = found[1]
        elif kind == "+":
            end = _dialled(text, at) if at >= phone else None
            if end is not None:
                phone = end
                if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    out.append((3, at, end))
        elif kind == "s":
            login = LOGIN.match(text, at) if at >= scheme else None
            named = SCHEME.search(text, max(scheme, at - 32), at) if login else None
            if named:
                scheme = login.end()
                out.append((5, named.start(), scheme))
        else:
            number = ACCOUNT.match(text, at)
            if number:
                out.append((4, number.start(1), number.end(1)))
    out.sort()
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _with(df: DataFrame, out: str, kind: str, make: Callable[[str, list[Span]], object], text_col: str) -> DataFrame:
    base = df.drop(*(c for c in df.columns if c == out and c != text_col))
    schema = base.select("*", F.lit(None).cast(kind).alias(out)).schema
    place = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        target = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])) if kind == SPANS else pa.string()
        for batch in batches:
            made = []
            for value in batch.column(place):  # one text at a time
                text = value.as_py()
                made.append(make(text, private_spans(text, automaton)) if text is not None else make(None, []))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, target)], names=[f.name for f in schema.fields])

    return base.mapInArrow(run, schema)


def find_private(df: DataFrame, text_col: str = "text", out_col: str = "private") -> DataFrame:
    """df plus out_col: all spans (kind, start, end) of the text, by kind as in KINDS, then start; offsets are code points.

    A null or empty text has no spans. A column of the name out_col is replaced, all others stay. Texts are read whole.
    email, ip, card and phone are leftmost, do not overlap within a kind, and what fails its check is not tried again from
    another start; account needs a cue word before it, address is a URL with a login, iban holds its check digits.
    """
    return _with(df, out_col, SPANS, lambda _, spans: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans], text_col)


def _masked(text: str | None, spans: list[Span]) -> str | None:
    if text is None:
        return None
    parts, at = [], 0
    for start, kind, end in sorted((s, k, e) for k, s, e in spans):
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask_private(df: DataFrame, text_col: str = "text", out_col: str = "masked") -> DataFrame:
    """df plus out_col: the text with [kind] in place of each span; of overlapping spans the first gives the name. Null stays null."""
    return _with(df, out_col, "string", _masked, text_col)


def spans_text(spans: str | Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(spans: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*KINDS[:BASE]))
