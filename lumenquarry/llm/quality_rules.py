"""Quality rules: base counts and divergence from language references. Only DataFrame functions.

Two histograms describe a document: classes of its characters, and common words of several languages (and all
others) among its words. References are the mean histograms of each of four languages' sound documents, computed over the
whole corpus and smoothed towards fixed ones, so that few documents or none are enough. A document fails where all
references are far in Jensen-Shannon distance and it is long enough for this to mean something. Common words tell
nothing of other languages: their documents are judged by characters alone, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, unused

# Frequent function words, as they are written inside a sentence.
COMMON_WORDS = {
    "en": "the of and to in is that it for was on with".split(),
    "fr": "le la les de des et un une que dans en pour".split(),
    "de": "der die das und ist in den von zu mit im ein".split(),
    "es": "el la los de y que en un una por con se".split(),
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
#: Rounded occurrences of the words above in 1000 words of ordinary prose, and shares of CLASSES in it.
OCCURRENCES = {
    "en": [61, 31, 28, 26, 21, 11, 11, 10, 9, 9, 7, 7],
    "fr": [25, 28, 20, 48, 19, 25, 13, 12, 12, 15, 9, 9],
    "de": [32, 34, 11, 28, 9, 18, 13, 11, 11, 9, 8, 7],
    "es": [30, 38, 17, 60, 26, 31, 27, 11, 8, 9, 9, 13],
}
PROSE = [0.92, 0.03, 0.01, 0.035, 0.0, 0.005]
#: A document of a greater share of a class has no part in references.
MOST = {"upper": 0.5, "digit": 0.3, "pause": 0.2, "symbol": 0.05}
SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
CLASSES = ["lower", "upper", "digit", "pause", "symbol", "other"]
#: Letters of scripts without capitals, and the marks on them, count as lower. Pauses of several scripts.
LETTERS, PAUSES = "[\\p{Lo}\\p{Lm}\\p{M}]+", "[.,;:!?'\"()\u3001\u3002\uff0c\uff1b\uff1a\uff01\uff1f\uff08\uff09\u300c\u300d\u300a\u300b\u060c\u061b\u061f\u0964-]+"


@dataclass(frozen=True)
class Limits:
    """Guards on length, and the farthest distances that pass."""

    min_chars: int = 200
    min_words: int = 150
    far_chars: float = 0.26
    far_words: float = 0.26
    #: A fixed reference weighs as much as so many documents.
    fixed_weight: int = 10


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _counts(docs: DataFrame) -> DataFrame:
    """Adds t, w (words) and the lengths that remain as one class of characters after the other is taken out."""
    df = docs.withColumn("t", F.trim(text_or_empty("text"), F.lit(" \t\n\x0b\f\r")))
    df = df.withColumn("w", F.when(F.col("t") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("t", SPACE + "+")))
    df = df.withColumn("r0", F.array_join("w", "")).withColumn("r1", _without(_without(F.col("r0"), "\\p{Ll}+"), LETTERS)).withColumn("r2", _without(F.col("r1"), "\\p{Lu}+"))
    df = df.withColumn("r3", _without(F.col("r2"), "[0-9]+")).withColumn("r4", _without(F.col("r3"), PAUSES)).withColumn("r5", _without(F.col("r4"), SYMBOLS + "+"))
    # The common words alone, each between two bars. A capital first letter is as good.
    written = [x for w in WORDS for x in (w, w.capitalize())]
    found = F.filter("w", lambda x: x.isin(written))
    return df.withColumn("found", F.concat(F.lit("|"), F.lower(F.array_join(found, "||")), F.lit("|")))


def _histograms(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols and the arrays char_hist and word_hist of shares."""
    n = {f"n{i}": F.length(f"r{i}") for i in range(6)}
    df = df.withColumns(n).withColumn("n_words", F.size("w").cast("bigint")).withColumn("word_chars", F.col("n0").cast("bigint")).withColumn("n_symbols", (F.col("n1") - F.length(_without(F.col("r1"), SYMBOLS + "+"))).cast("bigint"))
    parts = [F.col(f"n{i}") - F.col(f"n{i + 1}") for i in range(5)] + [F.col("n5")]
    chars = F.array(*[F.when(F.col("n0") > 0, p / F.col("n0")).otherwise(F.lit(0.0)) for p in parts])
    lost = lambda w: F.length("found") - F.length(F.replace(F.col("found"), F.concat(F.lit("|"), w, F.lit("|")), F.lit("")))
    share = F.transform(F.array(*[F.lit(w) for w in WORDS]), lambda w: F.when(F.col("n_words") > 0, lost(w) / (F.length(w) + 2) / F.col("n_words")).otherwise(F.lit(0.0)))
    df = df.withColumn("share", share)
    words = F.concat("share", F.array(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate("share", F.lit(0.0), lambda a, x: a + x))))
    return df.withColumn("char_hist", chars).withColumn("word_hist", words)


def _fixed(language: str) -> tuple[list[float], list[float]]:
    counts = dict(zip(COMMON_WORDS[language], OCCURRENCES[language], strict=True))
    words = [counts.get(w, 0) / 1000 for w in WORDS]
    return PROSE, [*words, 1 - sum(words)]


def references(docs: DataFrame, limits: Limits = Limits()) -> dict[str, tuple[list[float], list[float]]]:
    """Histograms (characters, words) of each language of COMMON_WORDS, one row each on the driver.

    They are means over the language's sound documents that pass the length guards, and over ``fixed_weight`` documents like
    the fixed histogram. Null texts and rows of other languages or none have no part; repeated rows count each time; an empty table gives the
    fixed histograms.
    """
    lang = F.col("lang").cast("string")
    df = _histograms(_counts(docs.select("text", lang.alias("lang")).where(F.col("lang").isin(list(COMMON_WORDS)))))
    sound = (F.col("n_words") >= limits.min_words) & (F.col("word_chars") >= limits.min_chars)
    for name, most in MOST.items():
        sound &= F.col("char_hist")[CLASSES.index(name)] <= most
    total = lambda x: F.coalesce(F.sum(F.when(sound, x)), F.lit(0.0))
    c, w = ([total(F.col(h)[i]) for i in range(n)] for h, n in (("char_hist", len(CLASSES)), ("word_hist", len(WORDS) + 1)))
    names = [f"x{i}" for i in range(len(c) + len(w))]
    rows = df.groupBy("lang").agg(F.count_if(sound).alias("n"), *[x.alias(name) for x, name in zip(c + w, names, strict=True)]).collect()
    found = {r["lang"]: (r["n"], [r[x] for x in names]) for r in rows}
    out, k = {}, limits.fixed_weight
    for language in COMMON_WORDS:
        fixed = _fixed(language)
        n, sums = found.get(language, (0, [0.0] * len(names)))
        both = [(x + k * y) / (n + k) for x, y in zip(sums, [*fixed[0], *fixed[1]], strict=True)]
        out[language] = both[: len(CLASSES)], both[len(CLASSES) :]
    return out


def _js(shares: str, reference: list[float] | Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of an array of shares from a reference."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(F.lit(2.0) * x / (x + y))).otherwise(F.lit(0.0))

    reference = reference if isinstance(reference, Column) else F.array(*[F.lit(float(x)) for x in reference])
    parts = F.zip_with(shares, reference, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.lit(2.0)))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in 3-word windows found twice or more.

    Hashes of the windows rule out most texts; the others are counted by the windows themselves.
    """
    windows = F.expr("cast(sequence(0, size(w) - 3) as array<int>)")
    hashed = F.when(F.size("w") >= 4, F.transform(windows, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    df = df.withColumn("hashes", hashed).withColumn("twice", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    keyed = F.transform(windows, lambda i: F.struct(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("g"), i.alias("i")))
    df = df.withColumn("sorted", F.when(F.col("twice"), F.sort_array(keyed)))
    same = lambda i, j: F.coalesce(F.get("sorted", i)["g"] == F.get("sorted", j)["g"], F.lit(False))
    places = F.filter(F.expr("sequence(0, size(sorted) - 1)"), lambda i: same(i, i + 1) | (same(i, i - 1) & (i > 0)))
    df = df.withColumn("starts", F.when(F.col("twice"), F.sort_array(F.transform(places, lambda i: F.get("sorted", i)["i"]))))
    gaps = F.transform(F.expr("sequence(0, size(starts) - 1)"), lambda j: F.least(F.lit(3), F.coalesce(F.get("starts", j + 1) - F.get("starts", j), F.lit(3))))
    total = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.size("starts") > 0, total), F.lit(0)).cast("bigint"))


def judged(docs: DataFrame, refs: dict[str, tuple[list[float], list[float]]], limits: Limits = Limits()) -> DataFrame:
    """All columns of docs, and one struct ``quality`` with the counts, both distances, base_failed and kept.

    The nearest of the references counts. Where docs has a column lang, documents of no language that has a reference, null and
    empty ones too, are judged by the base rule and their characters. A null text has no words: it fails the base
    rule, as any text of under 50 words. With {} for references only the base rule decides. Repeated rows are judged alike; an
    empty table gives an empty one.
    """
    inner = docs.toDF(*[c if c == "text" else f"column {i}" for i, c in enumerate(docs.columns)])
    df = _repeat_words(_histograms(_counts(inner)))
    lines = F.filter(F.split(text_or_empty("text"), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))

    def nearest(shares: str, i: int) -> Column:
        return F.least(*[_js(shares, x[i]) for x in refs.values()], F.lit(1.0)) if refs else F.lit(0.0)

    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    df = df.withColumn("char_js", nearest("char_hist", 0)).withColumn("word_js", nearest("word_hist", 1)).withColumn("base_failed", failed)
    far_words = (F.col("n_words") >= limits.min_words) & (F.col("word_js") > limits.far_words)
    if "lang" in docs.columns:
        lang = F.coalesce(F.col(inner.columns[docs.columns.index("lang")]).cast("string"), F.lit(""))
        far_words &= lang.isin(list(refs))
    strange = ((F.col("word_chars") >= limits.min_chars) & (F.col("char_js") > limits.far_chars)) | far_words
    verdict = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_js", "word_js", "base_failed", (~F.col("base_failed") & ~strange).alias("kept"))
    return df.select(*[F.col(c).alias(d) for c, d in zip(inner.columns, docs.columns, strict=True)], verdict.alias(unused(docs, "quality")))


def kept_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents, with all their columns, that pass. Null and empty texts don't; repeated rows pass or go together."""
    name = unused(docs, "quality")
    found = judged(docs, references(docs, limits), limits)
    # What isn't deterministic stays where it is: a plain filter would be copied down into every step above the scan.
    passes = unused(found, "passes")
    return found.withColumn(passes, F.col(name)["kept"] & (F.monotonically_increasing_id() >= 0)).where(passes).select(*docs.columns)
