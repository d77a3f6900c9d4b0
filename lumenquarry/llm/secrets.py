"""Secret scans. Only DataFrame functions.

Base patterns find assignments, access keys and long hexadecimal strings. Besides, two character Markov models of first
order, one of random strings and one of ordinary identifiers, score every other long token: the log-likelihood
ratio of its transitions, over the token or stretches of it, decides. The models are trained from labelled samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty, unused

KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A greedy run of 16 (32) or more is a greedy run that isn't dropped for its length, as a run inside it ends where it ends.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
#: Tokens that the models score.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A token or stretch is a secret if random strings explain it better by so many bits in all, and so many for each transition.
BITS, BITS_EACH = 20.0, 0.8
#: A stretch of fewer characters, with the words it cuts, is none.
SHORTEST = 16
#: Items of a block that is folded alone.
FOLD = 256
_SPANS = "array<struct<s:int,k:int,e:int>>"
_NONE = f"cast(array() as {_SPANS})"

# Parts of ordinary identifiers, and words of four languages that are often joined to longer ones.
PARTS = (
    "get set user name index table column value count total order item list map node tree file path read write open close start stop "
    "first last next prev create update delete insert select filter group join merge split parse format string number integer float "
    "config option default request response server client session token header content length buffer stream input output error "
    "message handler manager service factory builder context session thread process event listener callback result status version "
    "account customer product invoice payment address country language document paragraph sentence training evaluation dataset"
).split()
COMPOUNDS = (
    "understanding government knowledge through weather station business something market responsible character photograph international library ordinary question "
    "arbeit nehmer zeit buch haupt stadt zwischen pruefung kranken haus lehrer schule strasse wasser werk land wissen freund feuer wehr platz sprache kunde verfahren "
    "developpement entreprise quelque toujours politique environnement connaissance aujourd lequel chaque beaucoup travail maison monsieur semaine "
    "desarrollo empresa siempre conocimiento gobierno ayuntamiento trabajo derecho cuando mientras nuestro ciudad pueblo amigo tiempo escuela"
).split()
#: Runs in the order of the alphabet or the keyboard.
RUNS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01234567890123456789", "qwertyuiopasdfghjklzxcvbnm", "zyxwvutsrqponmlkjihgfedcba"]
#: Bounds of the training sample: documents that words are taken from, on average, characters of each, words.
DOCUMENTS, CHARACTERS, WORDS = 2000, 50_000, 4000


def ordinary_words(docs: DataFrame, documents: int = DOCUMENTS, words: int = WORDS) -> list[str]:
    """At most ``words`` distinct words of the corpus, from about ``documents`` documents; longer ones than CHARACTERS aren't taken.

    Words stand alone, in letters of which the first alone may be a capital, and are too short for a candidate: no key is among
    them. Hashes alone decide which documents (a share by the number of rows) and words are taken. A null text has no words; an
    empty table gives [].
    """
    share = documents / max(1, docs.count())
    key = F.xxhash64("doc_id", "text") if "doc_id" in docs.columns else F.xxhash64("text")
    some = docs.where((F.pmod(key, F.lit(2**40)) < F.lit(int(min(1.0, share) * 2**40))) & (F.length("text") <= CHARACTERS))
    word = F.explode(F.array_distinct(F.filter(F.split("text", "[^A-Za-z0-9+/_=-]+"), lambda w: w.rlike("^[A-Za-z][a-z]{3,17}$"))))
    found = some.select(word.alias("w")).select(F.lower("w").alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(words)
    return [r["w"] for r in found.collect()]


def sample(spark: SparkSession, words: list[str] | None = None, rows: int = 9000, seed: int = 0) -> DataFrame:
    """A labelled sample (text, secret): random strings of several alphabets, and ordinary strings.

    Ordinary ones are words of the corpus (``words``, if there are any), of four languages and of code, joined in the ways of
    identifiers, paths, compounds and titles, and runs of the alphabet. Another seed gives other rows, as to hold out.
    """
    n = F.col("id")
    lists = [F.split(F.lit(" ".join(x)), " ") for x in (PARTS, COMPOUNDS, words or COMPOUNDS)]
    sizes = [len(PARTS), len(COMPOUNDS), len(words or COMPOUNDS)]
    h = lambda *i: F.xxhash64(n, F.lit(seed), *i)
    # A third of all strings, at least, is of each list's words alone.
    pick = lambda which, i: F.get(lists[which], F.pmod(h(i), F.lit(sizes[which])).cast("int"))
    of = F.pmod(h(F.lit("list")), F.lit(3))
    word = lambda i: F.when(of == 0, pick(0, i)).when(of == 1, pick(1, i)).otherwise(pick(2, i))
    digest = lambda i: F.sha2(F.concat(F.lit(f"{seed}:{i}:"), n.cast("string")), 512)
    both = spark.range(rows).withColumns({"hex": digest(2), "b64": F.base64(F.unhex(F.concat(digest(0), digest(1)))), "w": F.transform(F.sequence(F.lit(0), F.lit(3)), word)})
    both = both.withColumns({"plain": F.regexp_replace("b64", "[+/=]", ""), "camel": F.array_join(F.transform("w", F.initcap), ""), "_": F.array_join("w", "_"), "joined": F.array_join("w", "")})
    size = 20 + F.pmod(h(F.lit("size")), F.lit(41)).cast("int")
    random = [F.col("b64"), F.col("plain"), F.translate("b64", "+/=", "-_"), F.lower("plain"), F.upper("plain"), F.col("hex"), F.upper("hex")]
    number = F.pmod(h(F.lit("number")), F.lit(2100)).cast("string")
    runs = F.split(F.lit(" ".join(RUNS)), " ")
    title = F.concat(F.upper(F.substring("joined", 1, 1)), F.expr("substring(joined, 2)"))
    ordinary = [
        F.col("_"), F.array_join("w", "-"), F.array_join("w", "/"), F.col("camel"), F.upper("_"), F.col("joined"), title, F.upper("joined"), F.concat("_", F.lit("_"), number),
        F.concat(F.get("w", F.lit(0)), "camel"), F.concat(F.lit("/"), F.array_join("w", "/"), F.lit("-"), F.substring(number, 1, 1)), F.concat(F.array_join(F.slice("w", 1, 2), "/"), F.lit("/"), F.array_join(F.transform(F.slice("w", 3, 2), F.initcap), "")),
        F.array_join(F.transform("w", F.initcap), "-"), F.get(runs, F.pmod(h(F.lit("run")), F.lit(len(RUNS))).cast("int")),
    ]
    one_of = lambda columns: F.get(F.array(*columns), F.pmod(h(F.lit("form")), F.lit(len(columns))).cast("int"))
    secret = both.select(F.substring(one_of(random), F.lit(1), size).alias("text"), F.lit(True).alias("secret"))
    return secret.unionByName(both.select(one_of(ordinary).alias("text"), F.lit(False).alias("secret")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[int]:
    """Hundredths of bits, log2 P(next | character) under secrets minus under ordinary strings, for all pairs of ALPHABET.

    ``samples`` has text and secret; rows with a null are left out. At most two rows a pair come to the driver.
    """
    c = F.split("text", "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.element_at("c", i), F.element_at("c", i + 1)))
    rows = samples.where("text is not null and secret is not null and length(text) > 1").withColumn("c", c).select("secret", F.explode(pairs).alias("pair"))
    rows = rows.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    counts = {(r["secret"], r["pair"]): r["n"] for r in rows.groupBy("secret", "pair").agg(F.count("*").alias("n")).collect()}

    def logs(secret: bool) -> list[float]:
        out = []
        for a in ALPHABET:
            n = [counts.get((secret, a + b), 0) + smoothing for b in ALPHABET]
            out += [math.log2(x / sum(n)) for x in n]
        return out

    return [round(100 * (x - y)) for x, y in zip(logs(True), logs(False), strict=True)]


def _let(value: Column, body) -> Column:
    """body of a value that is calculated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _emitted(items: Column, state: Column, step) -> Column:
    """The spans that a fold puts out: step(state, item) gives the next state and an array of spans.

    Arrays grow by copies, so blocks of items are folded to blocks of spans: n items cost n * (FOLD + n / FOLD) copies.
    """
    start = lambda state: F.struct(state.alias("state"), F.expr(_NONE).alias("out"))

    def one(acc: Column, x: Column) -> Column:
        new, out = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], out).alias("out"))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FOLD).cast("int")), lambda b: F.slice(v, b * FOLD + 1, FOLD))
        more = lambda acc, block: F.aggregate(block, start(acc["state"]), one, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], x["out"]).alias("out")))
        return F.when(F.size(v) > 0, F.aggregate(blocks, start(state), more)["out"]).otherwise(F.expr(_NONE))

    return _let(items, whole)


def _where(text: str, found: str, pattern: str, kind: int, least: Column | None = None) -> Column:
    """Spans of all matches in column ``found``, placed by the pieces between them, which split() leaves."""
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("a"), F.col(found).alias("b"), *([least.alias("v")] if least is not None else []))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + F.length(x["a"])
        e = s + F.length(x["b"])
        span = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        return e, span if least is None else F.when(F.length(x["v"]) >= 8, span).otherwise(F.expr(_NONE))

    return F.when(F.size(found) > 0, _emitted(both, F.lit(0), step)).otherwise(F.expr(_NONE))


def _segments(token: Column, model: Column, codes: Column) -> Column:
    """Segments (s, e) of a token that random strings explain better: the whole token, or the stretches between falls of the ratio.

    A transition to the same character, or one that is among the eight before it, tells nothing new and counts as none. A
    stretch reaches to the separators around it; it counts if it is then SHORTEST characters long and has the bits.
    """
    floor, least = int(100 * BITS_EACH), int(100 * BITS)
    numbers = F.transform(F.split(token, ""), lambda c: F.element_at(codes, F.ascii(c) + 1))
    pairs = _let(numbers, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.when(F.get(c, i - 1) == F.get(c, i), F.lit(0)).otherwise(F.get(c, i - 1) * len(ALPHABET) + F.get(c, i) + 1)))
    before = lambda p, i: F.slice(p, F.greatest(i - 7, F.lit(1)), F.least(i, F.lit(8)))
    gains = _let(pairs, lambda p: F.transform(p, lambda x, i: F.when((x == 0) | F.array_contains(before(p, i), x), F.lit(0)).otherwise(F.element_at(model, F.greatest(x, F.lit(1))))))
    start = F.expr("named_struct('i', 0, 'sum', 0, 'cur', 0, 'raw', 0, 'from', 0, 'best', 0, 'got', 0, 'to', 0, 'out', cast(array() as array<struct<s:int,e:int>>))")
    ended = lambda acc: F.when(acc["got"] >= least, F.concat(acc["out"], F.array(F.struct(acc["from"].alias("s"), acc["to"].alias("e"))))).otherwise(acc["out"])

    def pack(acc: Column, **new: Column) -> Column:
        return F.struct(*[new.get(n, acc[n]).alias(n) for n in ("i", "sum", "cur", "raw", "from", "best", "got", "to", "out")])

    def step(acc: Column, gain: Column) -> Column:
        cur, raw, at, total, zero = acc["cur"] + gain - floor, acc["raw"] + gain, acc["i"] + 1, acc["sum"] + gain, F.lit(0)
        rise = pack(acc, i=at, sum=total, cur=cur, raw=raw, best=cur, got=raw, to=at + 1)
        on = pack(acc, i=at, sum=total, cur=cur, raw=raw)
        off = pack(acc, **{"i": at, "sum": total, "cur": zero, "raw": zero, "from": at, "best": zero, "got": zero, "to": zero, "out": ended(acc)})
        return F.when((cur <= 0) | (cur < acc["best"] - least // 2), off).when(cur > acc["best"], rise).otherwise(on)

    def finish(acc: Column) -> Column:
        whole = (acc["sum"] >= least) & (acc["sum"] >= acc["i"] * floor)
        return F.when(whole, F.array(F.struct(F.lit(0).alias("s"), (acc["i"] + 1).alias("e")))).otherwise(ended(acc))

    def wide(x: Column) -> Column:
        inner = F.substring(token, x["s"] + 1, x["e"] - x["s"])
        ahead = F.element_at(F.split(F.substring(token, F.lit(1), x["s"]), "[/_=-]"), -1)
        behind = F.element_at(F.split(F.substring(token, x["e"] + 1, F.length(token)), "[/_=-]", 2), 1)
        # The last letters of a word before the first separator, or the first ones after the last, don't draw that word in.
        first, last = F.regexp_extract(inner, "^[^/_=-]{0,2}[/_=-]+", 0), F.regexp_extract(inner, "[/_=-]+[^/_=-]{0,2}$", 0)
        s = F.when((ahead != "") & (first != ""), x["s"] + F.length(first)).otherwise(x["s"] - F.length(ahead))
        e = F.when((behind != "") & (last != ""), x["e"] - F.length(last)).otherwise(x["e"] + F.length(behind))
        return F.struct(s.alias("s"), e.alias("e"))

    def enough(g: Column, x: Column) -> Column:
        return (x["e"] - x["s"] >= SHORTEST) & (F.aggregate(F.slice(g, x["s"] + 1, x["e"] - x["s"] - 1), F.lit(0), lambda a, y: a + y) >= least)

    return _let(gains, lambda g: F.filter(F.array_distinct(F.transform(F.aggregate(g, start, step, finish), wide)), lambda x: enough(g, x)))


def _uncovered(markov: Column, base: Column) -> Column:
    """What of the Markov spans no base span covers, by one fold over the sorted ends of all spans."""
    def ends(spans: Column, at: str, b: int, m: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x[at].alias("at"), F.lit(b).alias("b"), F.lit(m).alias("m")))

    all_ends = F.concat(ends(base, "s", 1, 0), ends(base, "e", -1, 0), ends(markov, "s", 0, 1), ends(markov, "e", 0, -1))

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        b, m = acc["b"] + x["b"], acc["m"] + x["m"]
        was, now = (acc["b"] == 0) & (acc["m"] > 0), (b == 0) & (m > 0)
        piece = F.array(F.struct(acc["since"].alias("s"), F.lit(3).alias("k"), x["at"].alias("e")))
        out = F.when(was & ~now & (x["at"] > acc["since"]), piece).otherwise(F.expr(_NONE))
        return F.struct(b.alias("b"), m.alias("m"), F.when(now & ~was, x["at"]).otherwise(acc["since"]).alias("since")), out

    return _emitted(F.array_sort(all_ends), F.expr("named_struct('b', 0, 'm', 0, 'since', 0)"), step)


def scanned(docs: DataFrame, model: list[int]) -> DataFrame:
    """All columns of docs, and a struct ``secrets`` with the arrays base and spans of (s, k, e), by start and kind.

    s and e count code points, e is exclusive, k is an index of KINDS. A null text is empty; a row without spans has
    empty arrays. Of Markov spans what no base span covers is added. Repeated rows give equal spans; an empty table gives none.
    Where docs has a column secrets, the added one ends in underscores.
    """
    inner = docs.toDF(*[c if c == "text" else f"column {i}" for i, c in enumerate(docs.columns)])
    df = inner.withColumn("t", text_or_empty("text"))
    all_ = lambda p, g=0: F.regexp_extract_all("t", F.lit(p), F.lit(g))
    df = df.withColumns({"f0": all_(ASSIGN), "f1": all_(ACCESS), "f2": all_(HEX), "f3": all_(CANDIDATE)})
    values = F.when(F.size("f0") > 0, all_(ASSIGN, 1))
    base = F.concat(_where("t", "f0", ASSIGN, 0, values), _where("t", "f1", ACCESS, 1), _where("t", "f2", HEX, 2))
    df = df.withColumn("base", F.array_sort(base))
    numbers = lambda x: F.split(F.lit(" ".join(map(str, x))), " ").cast("array<int>")
    weights, codes = numbers(model), numbers([max(0, ALPHABET.find(chr(i))) for i in range(128)])
    df = df.withColumn("scored", F.when(F.size("f3") > 0, F.transform("f3", lambda t: _segments(t, weights, codes))))
    # Only where some candidate scores are places looked for.
    df = df.withColumn("good", F.coalesce(F.exists("scored", lambda x: F.size(x) > 0), F.lit(False)))
    placed = F.when(F.col("good"), _where("t", "f3", CANDIDATE, 3))
    parts = F.zip_with(placed, "scored", lambda p, found: F.transform(found, lambda x: F.struct((p["s"] + x["s"]).alias("s"), (p["s"] + x["e"]).alias("e"))))
    df = df.withColumn("markov", F.flatten(parts))
    spans = F.when(F.col("good"), F.array_sort(F.concat("base", _uncovered(F.col("markov"), F.col("base"))))).otherwise(F.col("base"))
    found = F.struct("base", spans.alias("spans"))
    return df.select(*[F.col(c).alias(d) for c, d in zip(inner.columns, docs.columns, strict=True)], found.alias(unused(docs, "secrets")))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(docs: DataFrame, model: list[int], mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every span, overlapping ones as one, replaced by ``mark``; n_chars, where there is one, follows.

    A null text stays null, and a text without spans, an empty one too, as it is. Repeated rows are redacted alike; an empty
    table gives an empty one.
    """
    name = unused(docs, "secrets")
    df = scanned(docs, model)
    spans = F.col(name)["spans"]
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        inside, longer = x["s"] < acc["at"], F.greatest(acc["at"], x["e"])
        here = F.array(F.substring("text", acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))
        return F.struct(longer.alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], here)).alias("out"))

    whole = F.aggregate(spans, start, step)
    text = F.when(F.size(spans) > 0, F.concat(F.array_join(whole["out"], ""), F.substring(F.col("text"), whole["at"] + 1, F.length("text")))).otherwise(F.col("text"))
    out = df.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
