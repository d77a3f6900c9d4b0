import hashlib
import re

import brute
import pytest
from lumenquarry.llm import secrets
from lumenquarry.llm.queries import op1_secret_scans


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.sample(spark))


def test_whole_table_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = op1_secret_scans(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute.secrets(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(brute.listed(want).encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("markov")) == brute.listed(want)


ODD = [
    None, "", "pass", "password=x", 'PassWord" : "abcdefgh1"', "secret=token: abcdefghij", "api_key=API-KEY=12345678", "token==========", "é🎉 secret: ÄÖ", "ünï🎉 api_key = 'abc.def-ghi' tail",
    "AKIA" + "A" * 11, "xAKIA" + "A" * 12, "AKIAAKIA" + "0" * 8, "a" * 31, "a" * 32, "g" + "0" * 40 + "G", "ſecret=abcdefghij", "token=" + "f" * 40 + " token=" + "AKIA" + "B" * 20,
    "password='short' password='longenough'", "x" * 300_000 + " secret=" + "q" * 100_000, ("token=abcdefgh " * 3000),
]


def test_odd_texts(spark, model):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id bigint, text string, t string")
    for r in secrets.scanned(d, model).collect():
        assert [(x.s, x.k, x.e) for x in r.secrets.base] == brute.secrets(ODD[r.doc_id]), ODD[r.doc_id]
        assert r.t == "x"


def test_markov_models_tell_random_strings_from_identifiers(spark, model):
    random = ["q7Zt0LmXw9Rk2VbNs4Hd8", "dGhpcyBpc8fK2mQz7LpX1vBn", "Zx81kQpLw02nVtRy77GhJd3mXq"]
    plain = ["get_customer_account_index_2024", "responseHandlerFactory2Builder", "training/dataset/version_10/index", "internationalization", "2024-01-01-report-summary-final", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    d = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(random + plain)], "doc_id bigint, text string")
    found = {r.doc_id: [(x.s, x.e) for x in r.secrets.spans if x.k == 3] for r in secrets.scanned(d, model).collect()}
    assert [found[i] for i in range(len(random))] == [[(4, 4 + len(t))] for t in random]
    assert all(not found[len(random) + i] for i in range(len(plain)))


def test_redaction(spark, model):
    rows = [(i, t, len(t) if t else 0, "k") for i, t in enumerate([*ODD, "see q7Zt0LmXw9Rk2VbNs4Hd8 and token=abcdefgh1 é"])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, secrets string")
    out = {r.doc_id: r for r in secrets.redacted(d, model).collect()}
    assert out[len(ODD)].text == "see [REDACTED] and [REDACTED] é" and out[len(ODD)].secrets == "k"
    for i, t in enumerate(ODD):
        assert not brute.secrets(out[i].text)
        if not brute.secrets(t):
            assert (out[i].text, out[i].n_chars) == (t, len(t) if t else 0)
        else:
            assert out[i].n_chars == len(out[i].text)
    assert secrets.redacted(d.limit(0), model).count() == 0


def test_training_ignores_nulls_and_other_characters(spark):
    d = spark.createDataFrame([("ab", True), (None, True), ("cd", None), ("é!", False), ("x", False)], "text string, secret boolean")
    m = secrets.train(d)
    assert len(m) == len(secrets.ALPHABET) ** 2 and max(m) > 0 and re.fullmatch("[A-Za-z0-9+/_=-]+", secrets.ALPHABET)


def test_keys_inside_long_runs_and_without_digits(spark, model):
    key, letters = "q7Zt0LmXw9Rk2VbNs4Hd8PqX", "qZtKLmXwJRkGVbNsYHdWfPxQ"
    path = "customer/account/index/order/product/document/"
    texts = [f"see {path}{key}/{path}name", letters, f"{path}{key}/{path}{key}", f"token=abcdefgh.{'x' * 3} é", "+" + "------+" * 12, "-=" * 20, f"AKIA{'A' * 12}_{key}_end"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r.doc_id: [texts[r.doc_id][x.s : x.e] for x in r.secrets.spans if x.k == 3] for r in secrets.scanned(d, model).collect()}
    assert found[0] == [key] and found[1] == [letters] and found[2] == [key, key] and found[3] == [] and found[4] == [] and found[5] == []
    out = {r.doc_id: r.text for r in secrets.redacted(d, model).collect()}
    assert key not in out[6] and "AKIA" not in out[6] and out[0] == f"see {path}[REDACTED]/{path}name"


#: But for the runs of alphabet and keyboard and short words of code, the models aren't trained with these words.
ORDINARY = """Geschwindigkeitsbegrenzung Donaudampfschifffahrtsgesellschaft Rechtsschutzversicherungsgesellschaften Bundesausbildungsfoerderungsgesetz
Arbeiterunfallversicherungsgesetz Kraftfahrzeughaftpflichtversicherung anticonstitutionnellement institutionnalisation electroencefalografista contrarrevolucionario
desafortunadamente-siempre incomprehensibilities counterrevolutionaries SuperCalifragilisticExpialidocious github/workflows/continuous-integration /usr/lib/python3/dist-packages
java/util/concurrent/atomic/AtomicReference abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 3-5-1/section-of-Technology org/apache/commons/collections MAX_NUMBER_OF_CONNECTIONS
getElementsByClassNameAndTag Massachusetts-Institute-of-Technology user-agent-string-parser-2.0 qwertyuiopasdfghjklzxcvbnm erberbeeinheitkeiter thanbleshaningtionnt
docs/getting-started/installation/index node_modules/react-dom/production internationalization_of_strings 2024-01-15T10-30-00-backup""".split()


def keys(alphabet, n, size, rng):
    return ["".join(rng.choice(alphabet) for _ in range(size)) for _ in range(n)]


def test_ordinary_strings_and_keys_of_many_alphabets(spark, sf_dir):
    import random
    import string

    rng = random.Random(5)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = secrets.train(secrets.sample(spark, secrets.ordinary_words(docs)))
    held_out = secrets.sample(spark, secrets.ordinary_words(docs), 400, seed=77).collect()
    sets = {
        "ordinary": ORDINARY, "mixed": keys(string.ascii_letters + string.digits, 200, 32, rng), "upper hex": keys("0123456789ABCDEF", 150, 40, rng),
        "lower hex": keys("0123456789abcdef", 150, 30, rng), "base64": keys(string.ascii_letters + string.digits + "+/", 150, 44, rng), "short": keys(string.ascii_letters + string.digits, 150, 20, rng),
        "held out, secret": [r.text for r in held_out if r.secret], "held out, ordinary": [r.text for r in held_out if not r.secret and len(r.text) >= 20],
    }
    rows = [(i, name, f"see {t} here") for name, texts in sets.items() for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "i int, name string, text string").repartition(8)
    hit: dict[str, list[str]] = {name: [] for name in sets}
    for r in secrets.scanned(d, model).collect():
        if r.secrets.spans:
            hit[r.name].append(r.text)
    share = {name: len(hit[name]) / len(sets[name]) for name in sets}
    print(share, hit["ordinary"], hit["held out, ordinary"][:20])
    assert len(hit["ordinary"]) <= 1, hit["ordinary"]
    assert share["mixed"] >= 0.99 and share["base64"] >= 0.97 and share["upper hex"] >= 0.9 and share["lower hex"] >= 0.9 and share["short"] >= 0.95, share
    true, false = len(hit["held out, secret"]), len(hit["held out, ordinary"])
    assert true / (true + false) >= 0.95 and share["held out, secret"] >= 0.95, share


def markov(text, model, base):
    """Markov spans by plain loops over characters."""
    at = {c: i for i, c in enumerate(secrets.ALPHABET)}
    floor, least, n = int(100 * secrets.BITS_EACH), int(100 * secrets.BITS), len(secrets.ALPHABET)
    covered = {i for s, _, e in base for i in range(s, e)}
    inside = set()
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        token, pairs, gains = m[0], [], []
        for a, b in zip(token, token[1:]):
            gains.append(0 if a == b or (a, b) in pairs[-8:] else model[at[a] * n + at[b]])
            pairs.append((a, b) if a != b else None)
        if sum(gains) >= least and sum(gains) >= len(gains) * floor:
            found = [(0, len(token))]
        else:
            runs, cur, raw, begin, best, got, to = [], 0, 0, 0, 0, 0, 0
            for i, g in enumerate(gains):
                cur, raw = cur + g - floor, raw + g
                if cur <= 0 or cur < best - least // 2:
                    runs.append((begin, to, got))
                    cur, raw, begin, best, got, to = 0, 0, i + 1, 0, 0, 0
                elif cur > best:
                    best, got, to = cur, raw, i + 2
            runs.append((begin, to, got))
            found = []
            for s, e, got in runs:
                if got < least:
                    continue
                inner, ahead, behind = token[s:e], re.split("[/_=-]", token[:s])[-1], re.split("[/_=-]", token[e:])[0]
                first, last = re.match("[^/_=-]{0,2}[/_=-]+", inner), re.search("[/_=-]+[^/_=-]{0,2}$", inner)
                s = s + len(first[0]) if ahead and first else s - len(ahead)
                e = e - len(last[0]) if behind and last else e + len(behind)
                if e - s >= secrets.SHORTEST and sum(gains[s : e - 1]) >= least:
                    found.append((s, e))
        inside |= {m.start() + i for s, e in found for i in range(s, e)}
    inside -= covered
    starts = sorted(i for i in inside if i - 1 not in inside)
    ends = sorted(i + 1 for i in inside if i + 1 not in inside)
    return list(zip(starts, ends, strict=True))


def test_markov_spans_against_brute_force(spark, model):
    import random
    import string

    rng = random.Random(8)
    words, signs = [*secrets.PARTS, *secrets.COMPOUNDS, "Technology", "of", "3", "5", "1"], string.ascii_letters + string.digits
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            key = "".join(rng.choice(signs) for _ in range(rng.randrange(4, 50)))
            parts.append(rng.choice([key, rng.choice(words), rng.choice(words).title(), f"token={key}", f"AKIA{key.upper()}", "%040x" % rng.getrandbits(160), "é"]) + rng.choice([" ", "/", "-", "_", "", "=", ". "]))
        texts.append("".join(parts))
    texts += [" ".join(keys(signs, 700, 24, rng)), "-".join(keys(signs, 300, 20, rng))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    seen = 0
    for r in secrets.scanned(d, model).collect():
        base = brute.secrets(texts[r.doc_id])
        got = [(x.s, x.e) for x in r.secrets.spans if x.k == 3]
        assert got == markov(texts[r.doc_id], model, base), texts[r.doc_id]
        seen += len(got)
    assert seen > 800


def test_a_megabyte_of_keys_takes_time_by_its_length(spark, model):
    import random
    import string
    import time

    rng = random.Random(2)
    seconds = []
    for n in (2_000, 36_000):
        text = " ".join(keys(string.ascii_letters + string.digits, n, 28, rng))
        d = spark.createDataFrame([(1, text)], "doc_id int, text string")
        began = time.time()
        spans = secrets.scanned(d, model).collect()[0].secrets.spans
        seconds.append(time.time() - began)
        assert len(spans) >= 0.99 * n
    print(seconds)
    assert seconds[1] < 40
