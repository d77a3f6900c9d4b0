import math
import random
import re

import brute
from lumenquarry.llm import quality_rules as q
from lumenquarry.llm.queries import op3_quality_rules

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_whole_table_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = op3_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[n] for n in NAMES) == brute.quality(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_odd_texts(spark):
    texts = [
        None, "", " \n\t", "a", "a b c", "a b c a b c", "x x x x", "x x x", "a b\nc\nc\n\nc\n \n c", "é ü\xa0ö # $", "\x1c a\x0bb", "w " * 30_000, "a b c d a b c e b c d", "|<>|" * 9,
        "\n".join(["same line of words"] * 40), "🎉 b c 🎉 b c", " lead and trail ",
    ]
    d = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int, w string")
    for r in q.judged(d, {}).collect():
        assert tuple(r.quality[n] for n in NAMES) == brute.quality(texts[r.doc_id]), repr(texts[r.doc_id])
        assert r.n_words == 1 and r.w == "w"
    assert q.kept_documents(d.limit(0).withColumn("lang", q.F.lit("en"))).count() == 0


def test_distance_is_that_of_jensen_and_shannon(spark):
    p, r = [0.2, 0.5, 0.3, 0.0], [0.1, 0.4, 0.0, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, r)]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
    got = spark.createDataFrame([(p,)], "p array<double>").select(q._js("p", r)).head()[0]
    assert abs(got - math.sqrt((kl(p, m) + kl(r, m)) / 2)) < 1e-12
    assert spark.createDataFrame([(p,)], "p array<double>").select(q._js("p", p)).head()[0] < 1e-7


def test_junk_goes_and_clean_text_stays(spark):
    """References come from the corpus; shouting, symbol noise and lists without function words are far from them."""
    words = [f"{a}{b}{c}" for a in ("tri", "mon", "sel", "ca") for b in ("ver", "lan", "do") for c in ("ta", "ber", "nis", "l")]

    def prose(i, n=240):
        r = random.Random(i)
        return " ".join(("the", "of", "and", "in")[(i + j) % 4] if j % 3 == 0 else r.choice(words) + ("." if j % 11 == 0 else "") for j in range(n))

    def listing(i):
        r = random.Random(i)
        return " | ".join(r.choice(words) + r.choice(words) for _ in range(250))

    clean = [prose(i) for i in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in prose(i).split()) for i in range(2)] + [" ".join(w + "###" for w in prose(i).split()) for i in range(2)] + [listing(i) for i in range(2)]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id bigint, text string, lang string")
    rare = [(i + 100, t, "xx") for i, t in enumerate(junk)]  # a language without a reference: characters alone decide
    d = d.unionByName(spark.createDataFrame(rare, d.schema))
    kept = {r.doc_id for r in q.kept_documents(d).collect() if r.lang == "en"}
    assert {r.doc_id for r in q.kept_documents(d).collect() if r.lang == "xx"} == {i for i, _, _ in rare[4:]}
    assert kept == set(range(60)) and not any(brute.quality(t)[5] for t in clean + junk)


def _prose(i, words=("the", "of", "and", "in"), n=240):
    r = random.Random(i)
    return " ".join(words[(i + j) % 4] if j % 4 == 0 else "".join(r.choice(("tri", "mon", "sel", "ca", "ver", "lan")) for _ in range(3)) + ("." if j % 11 == 0 else "") for j in range(n))


def _kept(spark, rows):
    d = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string")
    return {r.doc_id for r in q.kept_documents(d).collect()}


def test_few_documents_are_judged_too(spark):
    """A document of a built-in language gets the same verdict alone and among many."""
    fillers = _prose(1, ("tri", "mon", "sel", "ver"), 300).split()
    often = "the of and to the in that the it was and of with is a on the to for and".split()
    clean = " ".join(often[i // 4 % len(often)] if i % 4 == 0 else w for i, w in enumerate(fillers))
    junk = [" ".join(w.upper() + "!!" for w in _prose(1).split()), " ".join(w + "###" for w in _prose(2).split())]
    for lang in ("en", "de"):
        assert _kept(spark, [(clean, lang), *[(t, lang) for t in junk]]) == {0}
        assert _kept(spark, [(junk[0], lang)]) == set()


def test_languages_beyond_the_32nd_are_judged_and_junk_founds_no_reference(spark):
    sound = [(_prose(i, ("uno", "dva", "tri", "shti")), f"l{k:02}") for k in range(33) for i in range(11 if k < 32 else 10)]
    shout = [" ".join(w.upper() + "!!" for w in _prose(i).split()) for i in range(12)]
    noise = [" ".join(w + "###" for w in _prose(i).split()) for i in range(12)]
    rows = [*sound, (noise[0], "l32"), *[(t, "zz") for t in noise], *[(t, None) for t in shout], (shout[0], "en"), (noise[0], "fr")]
    assert _kept(spark, rows) == set(range(len(sound)))


def _brute_histograms(text):
    import unicodedata

    classes = [0] * len(q.CLASSES)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    for c in "".join(words):
        kind = unicodedata.category(c)
        name = "lower" if kind in ("Ll", "Lo", "Lm") or kind[0] == "M" else "upper" if kind == "Lu" else "digit" if c in "0123456789" else "pause" if re.fullmatch(q.PAUSES, c) else "symbol" if c in "#*$%&|<>" else "other"
        classes[q.CLASSES.index(name)] += 1
    n, m = sum(classes), len(words)
    share = [sum(w in (x, x.capitalize()) for w in words) / m if m else 0.0 for x in q.WORDS]
    return m, n, [x / n if n else 0.0 for x in classes], [*share, max(0.0, 1 - sum(share))]


def _brute_distance(p, r):
    kl = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
    return math.sqrt(max(0.0, (kl(p, r) + kl(r, p)) / 2))


def test_verdicts_of_the_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    hist = {r.doc_id: _brute_histograms(r.text) for r in docs}
    limits, refs = q.Limits(), {}
    for lang, words in q.COMMON_WORDS.items():
        sound = [h for r in docs if r.lang == lang for h in [hist[r.doc_id]] if h[0] >= limits.min_words and h[1] >= limits.min_chars and all(h[2][q.CLASSES.index(c)] <= most for c, most in q.MOST.items())]
        counts = dict(zip(words, q.OCCURRENCES[lang], strict=True))
        fixed = [counts.get(w, 0) / 1000 for w in q.WORDS]
        k, n = limits.fixed_weight, len(sound)
        mean = lambda at, fixed: [(sum(h[at][i] for h in sound) + k * x) / (n + k) for i, x in enumerate(fixed)]  # noqa: B023, E731
        refs[lang] = mean(2, q.PROSE), mean(3, [*fixed, 1 - sum(fixed)])
    gone = 0
    for r in op3_quality_rules(spark, sf_dir).collect():
        m, n, chars, words = hist[r.doc_id]
        char_js, word_js = (min(_brute_distance(p, x[i]) for x in refs.values()) for i, p in enumerate((chars, words)))
        assert abs(r.char_js - char_js) < 1e-6 and abs(r.word_js - word_js) < 1e-6, r.doc_id
        want = not r.base_failed and not (n >= limits.min_chars and char_js > limits.far_chars) and not (m >= limits.min_words and word_js > limits.far_words)
        assert r.kept == want
        gone += not r.kept and not r.base_failed
    assert 0 < gone < len(docs) / 5


def test_other_languages_get_one_verdict_alone_and_among_many(spark):
    chinese = [" ".join("".join(chr(0x4E00 + random.Random(f"{i} {k}").randrange(3000)) for _ in range(4)) + ("\u3002" if i % 6 == 0 else "") for i in range(160)) for k in range(12)]
    italian, shout = _prose(1, ("che", "il", "per", "non")), " ".join(w.upper() + "!!" for w in _prose(1).split())
    for lang in ("zh", None, ""):
        for text, keep in ((chinese[0], True), (italian, True), (shout, False)):
            assert _kept(spark, [(text, lang)]) == ({0} if keep else set())
        many = [*chinese, *[_prose(i, ("che", "il", "per", "non")) for i in range(12)], shout]
        assert _kept(spark, [(t, lang) for t in many]) == set(range(24))
