"""Scalar text functions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes, longest first; a stem keeps three letters.
SUFFIXES = ["ing", "ed", "ly", "es", "s"]
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
IPV4 = "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}"


def tokens(text: Column) -> Column:
    """[a-z0-9]+ of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def stem(token: Column) -> Column:
    out = token
    for s in reversed(SUFFIXES):
        out = F.when(token.endswith(s) & (F.length(token) >= len(s) + 3), F.left(token, F.length(token) - len(s))).otherwise(out)
    return out


def slug(text: Column, most: int = 48, default: str = "unnamed") -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_")
    s = F.regexp_replace(F.left(F.regexp_replace(s, "^_+|_+$", ""), F.lit(most)), "_+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.split(F.reverse(digits), "")
    parts = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x.cast("int") * 2 > 9, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)).otherwise(x.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def content_hash(first: Column, second: Column) -> Column:
    return F.md5(F.concat(F.lower(first), F.lit("|"), F.lower(F.coalesce(second, F.lit("")))))


def estimated_tokens(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("bigint")


def excerpt(text: Column, size: int = 180) -> Column:
    flat = F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(size - 1))), F.lit("…")))


#: Perturbations by name: functions from a column to a column. register with ``perturbation``.
PERTURBATIONS: dict[str, Callable[[Column], Column]] = {}


def perturbation(name: str) -> Callable:
    def add(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        PERTURBATIONS[name] = f
        return f

    return add


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != "")


@perturbation("typos")
def _typos(text: Column) -> Column:
    """In about an eighth of the words of four characters or more, as their digest says, two inner characters change places, one is lost, or one stands twice."""

    def number(w: Column, at: int, size: int) -> Column:
        return F.conv(F.substring(F.md5(w), at, size), 16, 10).cast("int")

    def typo(w: Column) -> Column:
        n = F.length(w)
        i = 1 + number(w, 2, 2) % F.greatest(n - 2, F.lit(1))  # from 1 to n - 2
        head, one, two, tail = F.left(w, i), F.substring(w, i + 1, F.lit(1)), F.substring(w, i + 2, F.lit(1)), F.substring(w, i + 3, n)
        kind = number(w, 4, 1) % 3
        changed = F.when(kind == 0, F.concat(head, two, one, tail)).when(kind == 1, F.concat(head, two, tail)).otherwise(F.concat(head, one, one, two, tail))
        return F.when((n >= 4) & (number(w, 1, 1) < 2), changed).otherwise(w)

    return F.array_join(F.transform(_words(text), typo), " ")


@perturbation("lower_no_punctuation")
def _plain(text: Column) -> Column:
    """Lower case without ASCII punctuation, single blanks."""
    bare = F.regexp_replace(F.lower(text), "[!-/:-@\\[-`{-~]", "")
    return F.trim(F.regexp_replace(bare, "[ \\t\\n\\r]+", " "))


@perturbation("upper")
def _upper(text: Column) -> Column:
    """Full case mapping: ß gives SS."""
    return F.upper(text)


@perturbation("truncated")
def _truncated(text: Column) -> Column:
    """The first 60 % of the words, rounded up, four at least."""
    words = _words(text)
    return F.array_join(F.slice(words, 1, F.greatest(F.lit(4), F.ceil(F.size(words) * 0.6).cast("int"))), " ")


@perturbation("noise")
def _noise(text: Column) -> Column:
    return F.concat(F.lit("hi there, "), text, F.lit(" thanks in advance"))


def perturbed(text: Column, kind: str) -> Column:
    """The text after a registered perturbation: typos, lower_no_punctuation, upper, truncated, noise."""
    return PERTURBATIONS[kind](text)


_MARKUP = re.compile(r"<[^>]+>")


def _shown(c: str) -> str:
    """A character as a reader sees it: nothing for format characters (soft hyphens, zero widths, directions), a blank for controls."""
    kind = unicodedata.category(c)
    return "" if kind == "Cf" else " " if kind == "Cc" else c


def normalise(text: str | None) -> str | None:
    """Compatibility forms composed, markup out, entities decoded, then characters as they are shown, with single blanks."""
    if text is None:
        return None
    plain = html.unescape(_MARKUP.sub(" ", unicodedata.normalize("NFKC", text)))
    if not plain.isascii() or not plain.isprintable():
        plain = "".join(map(_shown, plain))
    return " ".join(plain.split())


# What is redacted, in this order.
PII = [
    ("EMAIL", re.compile(EMAIL)),
    ("CARD", re.compile(r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])")),
    ("ACCOUNT_ID", re.compile(r"(?i)\b(?:account|acct|customer)[ _-]?(?:id|no|number)?[ :#]*[0-9]{5,12}\b")),
    ("NATIONAL_ID", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("IP", re.compile(rf"(?<![\w.]){IPV4}(?![\w]|\.[0-9])")),
    ("PHONE", re.compile(r"(?<![0-9.])\+?[0-9(][0-9 ()./-]{7,}[0-9](?![0-9])")),
]


def _luhn(digits: str) -> bool:
    total = sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _counts(kind: str, found: str) -> bool:
    """Whether what a pattern found is of its kind: check digits, how many digits, or numbers that fit a byte."""
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "CARD":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "IP":
        return all(int(x) < 256 for x in found.split("."))
    return kind != "PHONE" or 9 <= len(digits) <= 15


def redact(text: str | None) -> tuple[str | None, dict[str, int]]:
    """The text with personal data replaced, and how often each kind was found."""
    counts: dict[str, int] = {}
    for kind, pattern in PII if text else ():

        def put(m: re.Match, kind: str = kind) -> str:
            if not _counts(kind, m[0]):
                return m[0]
            counts[kind] = counts.get(kind, 0) + 1
            return f"[{kind}]"

        text = pattern.sub(put, text)
    return text, counts


def normalised(df: DataFrame, column: str, to: str = "normalised") -> DataFrame:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(normalise, na_action="ignore")

    return df.withColumn(to, run(column))


def redacted(df: DataFrame, column: str, to: str = "redacted") -> DataFrame:
    """Adds struct ``to`` of text and counts (a map). Texts with neither an @ nor a run of digits don't reach Python."""

    @F.pandas_udf("text string, counts map<string,int>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [redact(x) for x in s]
        return pd.DataFrame({"text": [r[0] for r in rows], "counts": [r[1] for r in rows]})

    # Every kind has an @, or a digit before four or more digits and signs.
    some = F.col(column).rlike("@|[0-9][0-9 ()./+-]{4,}")
    found = run(F.when(some, F.col(column)))
    none = F.struct(F.col(column).alias("text"), F.expr("cast(map() as map<string,int>)").alias("counts"))
    return df.withColumn(to, F.when(some, found).otherwise(none))
