import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from lumenquarry.llm import repair
from lumenquarry.llm.queries import op12_conversation_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda v: " " if v is None else str(v)
        role, text = space(role), space(text)
        f = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if f == 1:
            text = ""
        if f == 2:
            text = re.sub("[.!?]", "", text)
        if f == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


def cheapest(rows, limit=2):
    """All edits of rows (role, text, fault), tried by brute force: (cost, audit, repaired rows)."""
    best = None
    places = [range(limit + 1)] * (len(rows) + 1)
    for counts in itertools.product(*places):
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(e != "D" and r[2] in ("blank", "duplicate") for e, r in zip(edits, rows, strict=True)):
                continue
            audit = "".join("I" * n + e for n, e in zip(counts, (*edits, ""), strict=True))
            cost = sum({"D": 3, "K": 0, "R": 2, "I": 2}[e] for e in audit) + sum(e != "D" and r[2] == "truncated" for e, r in zip(edits, rows, strict=True))
            if best and (cost, audit) >= best[:2]:
                continue
            free = [e for e in audit if e in "IR"]
            for roles in itertools.product(("user", "assistant"), repeat=len(free)):
                given, left, made = iter(roles), iter(rows), []
                for e in audit:
                    row = next(left) if e != "I" else None
                    if e != "D":
                        made.append((row[0] if e == "K" else next(given), row[1] if row else ""))
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)):
                    best = cost, audit, made
                    break
    return best


def brute(rows, answer=cheapest):
    """The contract row by row; the edits by ``answer``."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked = set(), []
        for _, _, role, text in own:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            marked.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, made = answer(marked)
        faults = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, digest)
    return out


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def all_of(turns):
    return repair.repaired_all(turns, repair.damaged(turns))


def test_small_conversations_match_all_edits(spark):
    r = random.Random(3)
    texts = ["Yes.", "No!", "so", " ", "", None, "Why? \n", "x ", "é."]
    rows = [(c, r.choice([None, 0, 1, 2, 3, 9]), r.choice(["system", "user", "assistant", "tool", "", None, "s"]), r.choice(texts)) for c in range(120) for _ in range(r.randint(1, 3))]
    rows += [(None, 1, "user", "a"), (None, 2, "user", "b.")]
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({"conv": F.lit(1), "audit": F.lit("z"), "digest": F.lit(0)})
    found = got(all_of(turns))
    assert found == brute(rows)
    assert any(v[0] for v in found.values()) and any("I" in v[6] and "K" in v[6] for v in found.values())


def test_signatures_match_all_edits():
    rows = {"d": ("u", "t", "blank"), "s": ("s", "t", ""), "u": ("u", "t", ""), "a": ("a", "t", ""), "x": ("x", "t", ""), "U": ("u", "t", "truncated"), "A": ("a", "t", "truncated"), "S": ("s", "t", "truncated"), "X": ("x", "t", "truncated")}
    names = sorted("".join(x) for n in range(4) for x in itertools.product("dsuaxUASX", repeat=n))
    names += sorted("".join(x) for x in itertools.product("dsua", repeat=4))
    for sig, cost, audit in repair.repairs(names):
        if len(sig) < 4:
            assert (cost, audit) == cheapest([rows[c] for c in sig])[:2], sig
        else:  # with fewer inserted rows tried, brute force gives a bound
            assert (cost, audit) <= cheapest([rows[c] for c in sig], 1)[:2], sig


def test_long_signatures_and_shared_layers():
    r = random.Random(4)
    long = "".join(r.choice("suaxdUA") for _ in range(300_000))
    found = {s: (c, a) for s, c, a in repair.repairs(sorted([long, long[:200_000], long[:-1] + "d"]))}
    alone = {s: (c, a) for x in (long, long[:200_000]) for s, c, a in repair.repairs([x])}
    assert all(found[s] == alone[s] for s in alone)
    seen = repair.Layers()
    kind = seen.first
    for symbol in long[:5000]:
        kind, _, _ = seen.next(kind, symbol)
    assert len(seen.known) < 400  # few kinds of layers, however long the signature


def test_tables_have_every_conversation(spark, sf_dir):
    found = got(op12_conversation_repair(spark, sf_dir))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert set(found) == {r[0] for r in rows}

    def by_signature(marked):
        symbols = ["d" if f in ("blank", "duplicate") else (c if (c := role[:1]) in ("s", "u", "a") and c else "x") for role, _, f in marked]
        sig = "".join(s.upper() if m[2] == "truncated" else s for s, m in zip(symbols, marked, strict=True))
        _, cost, audit = next(repair.repairs([sig]))
        made, left = [], iter(marked)
        for e in audit:
            row = next(left) if e != "I" else None
            if e != "D":
                role = row[0] if e == "K" else ("assistant" if made and made[-1][0][0] == "u" else "user")
                made.append((role, row[1] if row else ""))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in made))
        return cost, audit, made

    assert found == brute(rows, by_signature)


def test_empty_and_all_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert all_of(empty).count() == 0
    gone = next((c, t) for c in range(100) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(*gone, "user", "Hi.")], SCHEMA)
    assert got(all_of(one)) == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
