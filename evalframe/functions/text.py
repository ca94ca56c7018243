"""Text and digest expressions: Column in, Column out."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts of these characters only are unchanged by NFKC, so the JVM can normalise them.
STABLE = r"^[\t\n\x0B\f\r\x20-\x7EÀ-ÿ]*$"
#: Access tokens of one public model hub, not inside a longer word.
TOKEN_PATTERN = r"(?<![A-Za-z0-9])hf_[A-Za-z0-9]{20,}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


@F.pandas_udf(StringType())
def _nfkc_fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def normalize_text(text: Column | str, fold: bool = False) -> Column:
    """NFKC, runs of white space to one space, ends trimmed, optionally case-folded; null stays null.

    Texts that NFKC cannot change stay in the JVM; the Python function sees null in their place.
    """
    text = _col(text)
    simple = text.rlike(STABLE)
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss")) if fold else text
    fast = F.btrim(F.regexp_replace(plain, r"[\t\n\x0B\f\r\x1C-\x20]+", " "))
    return F.when(simple, fast).otherwise((_nfkc_fold if fold else _nfkc)(F.when(~simple, text)))


#: Joins texts for one normalising call: a character of private use, which NFKC and case folding leave alone.
_SEAM = "\uE000"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being evaluated a single time for each row however often use names it.

    Spark writes a Column out wherever it is named, so nested uses multiply; a lambda's argument is evaluated once. Python
    functions may stand in value, not in use.
    """
    return F.transform(F.array(value), use)[0]


def join_items(items: Column) -> Column:
    """An array's texts in one string, each after a seam; null entries go, a null array stays null."""
    return F.array_join(F.concat(F.array(F.lit("")), items), _SEAM)


def fold_joined(joined: Column, fold: bool = False) -> Column:
    """struct(plain, odd): joined texts normalised if all are simple, else as they are in odd, for a Python function."""
    simple = joined.rlike(STABLE.replace("[", f"[{_SEAM}"))
    plain = F.replace(F.lower(joined), F.lit("ß"), F.lit("ss")) if fold else joined
    return F.struct(F.when(simple, F.regexp_replace(plain, r"[\t\n\x0B\f\r\x1C-\x20]+", " ")).alias("plain"), F.when(~simple, joined).alias("odd"))


def fold_odd(odd: Column, fold: bool = False) -> Column:
    return (_nfkc_fold if fold else _nfkc)(odd)


def part_items(joined: Column) -> Column:
    """The texts of join_items, trimmed."""
    parts = F.split(joined, _SEAM)
    return F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.btrim(x))


def normalize_items(items: Column | str, fold: bool = False) -> Column:
    """normalize_text of each entry of an array of texts; null entries go, a null array stays null.

    The entries are normalised as one string, in the JVM if all are simple, else in one Python call, and parted again.
    """
    read = once(join_items(_col(items)), lambda j: fold_joined(j, fold))
    return part_items(F.coalesce(read["plain"], fold_odd(read["odd"], fold)))


def canonical_json(**fields: Column | str) -> Column:
    """A JSON object with sorted keys, no spaces and nulls kept."""
    return F.to_json(F.struct(*(_col(fields[k]).alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def canonical_sha256(**fields: Column | str) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def fingerprint(*texts: tuple[str, Column | str]) -> Column:
    """Digest of normalised, case-folded (name, text) parts; what is not named (ids, times) plays no part."""
    return canonical_sha256(**{name: normalize_text(c, fold=True) for name, c in texts})


def label_fingerprint(evidence: Column | str | None = None, **labels: Column | str) -> Column:
    """Digest of a label: evidence is normalised, case-folded and sorted, so its order and spelling play no part."""
    if evidence is None:
        return canonical_sha256(**labels)
    return canonical_sha256(evidence=F.array_sort(normalize_items(evidence, fold=True)), **labels)


def contains_literal(text: Column, snippet: Column) -> Column:
    """Whether a normalised snippet that is not empty stands in a normalised text."""
    return F.coalesce((snippet != "") & F.contains(text, snippet), F.lit(False))


def evidence_items(value: Column | str, is_array: bool = True) -> Column:
    """Evidence as an array without null or blank entries; one string counts as one entry."""
    items = _col(value) if is_array else F.array(_col(value))
    return F.coalesce(F.filter(items, lambda x: x.isNotNull() & (F.btrim(x) != "")), F.array().cast("array<string>"))


def evidence_counts(evidence: Column, text: Column) -> Column:
    """struct(total, grounded, unsupported); text and evidence entries must be normalised alike.

    The text enters the comparison as an array, because a normalised text may come from a Python function, which no
    lambda may hold.
    """
    items = evidence_items(evidence)
    grounded = F.size(F.filter(F.zip_with(items, F.array_repeat(text, F.size(items)), lambda x, t: contains_literal(t, x)), lambda ok: ok))
    return F.struct(F.size(items).alias("total"), grounded.alias("grounded"), (F.size(items) - grounded).alias("unsupported"))


def find_hints(text: Column | str, hints: list[str]) -> Column:
    """For each hint that the text holds, the text's own spelling of its first place; no repeats."""
    text = _col(text)
    found = [F.when(F.instr(F.lower(text), h.lower()) > 0, F.substring(text, F.instr(F.lower(text), h.lower()), F.lit(len(h)))) for h in hints]
    return F.array_distinct(F.array_compact(F.array(*found)))


def holds_any(text: Column, hints: list[str]) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | F.contains(text, F.lit(h))
    return F.coalesce(out, F.lit(False))


def unsafe_controls(text: Column | str) -> Column:
    """Control characters other than tab, LF and CR."""
    return F.coalesce(_col(text).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"), F.lit(False))


def secret_like(text: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    return F.coalesce(_col(text).rlike(pattern), F.lit(False))


def secret_file_name(path: Column | str) -> Column:
    """Environment files and private keys by their base name."""
    name = F.lower(F.substring_index(_col(path), "/", -1))
    return name.rlike(r"^\.env(\..*)?$") | name.rlike(r"\.(pem|key|p12|pfx)$") | name.isin("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials", ".netrc")


def hash_pick(n: int, *parts: Column | str) -> Column:
    """First 8 bytes, big-endian, of sha256 of the parts joined by colons, modulo n."""
    digest = F.sha2(F.concat_ws(":", *(_col(p).cast("string") for p in parts)), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")
