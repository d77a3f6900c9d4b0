"""Repair of the structure of conversations: a least number of edits, found by dynamic programming over a shared trie.

What the cheapest edits are depends only on a conversation's signature, a string with one symbol for each row: its role's initial
and its fault. Signatures are made distinct and sorted; sorted strings are the walk through a prefix trie, of which only
the path to the current node is held. A layer of the program is computed once for each node, however many signatures
share it, and an answer is read at a terminal node. Layers are kept as differences to their cheapest state, of which
only few kinds occur, so that a node costs a reference and a number, and a long conversation little memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: What a row's symbol is: d for blank and duplicate rows, else the role's initial (x for others), a capital letter where the text is cut off.
DELETED, OTHER = "d", "x"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
STATES, START, AFTER_S, AFTER_U, AFTER_A = range(4), 0, 1, 2, 3
ROLES = {AFTER_U: "user", AFTER_A: "assistant"}
#: Two inserted rows lead to every state that any number leads to. A state dearer by more than SLACK than the cheapest can't win: two
#: inserted rows lead from any state to where another can be.
INSERTS, SLACK = 2, 4
_ROW = pa.schema([("conv", pa.string()), ("signature", pa.string()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")]])


def _made(state: int) -> int:
    """Where a row leads whose role is chosen for the pattern."""
    return AFTER_A if state == AFTER_U else AFTER_U


def _kept(state: int, initial: str) -> int | None:
    """Where a row with this initial leads, if the pattern bears it."""
    if initial == "s":
        return AFTER_S if state == START else None
    return _made(state) if initial == ROLES[_made(state)][0] else None


def steps(symbol: str) -> list[tuple[int, str, int, int]]:
    """(state, edit, next state, cost) for all that can be done with a row."""
    out = [(q, DELETE, q, COST[DELETE]) for q in STATES]
    if symbol != DELETED:
        more = TRUNCATED if symbol.isupper() else 0
        out += [(q, REROLE, _made(q), COST[REROLE] + more) for q in STATES]
        out += [(q, KEEP, to, COST[KEEP] + more) for q in STATES if (to := _kept(q, symbol.lower())) is not None]
    return out


def _inserted() -> list[tuple[int, int, int]]:
    """(state, number of inserted rows, next state)."""
    out = []
    for q in STATES:
        to = q
        for k in range(INSERTS + 1):
            out.append((q, k, to))
            to = _made(to)
    return out


class Layers:
    """Layers of the program by kind. A kind has, for each state, how much dearer it is than the cheapest one (None: out of reach) and the
    place of its audit among the four: audits that end with a row's edit aren't prefixes of one another, so places suffice to compare."""

    def __init__(self):
        self.first = ((0, None, None, None), (0, 0, 0, 0))
        self.known: dict[tuple, tuple] = {}

    def next(self, kind: tuple, symbol: str) -> tuple[tuple, int, tuple]:
        """(kind, cost added to the cheapest, how each state was reached: (state before, edits))."""
        key = kind, symbol
        if (found := self.known.get(key)) is None:
            costs, places = kind
            best: dict[int, tuple] = {}
            by = steps(symbol)
            for q, k, via in _inserted():
                if costs[q] is not None:
                    for at, edit, to, cost in by:
                        if at == via:
                            way = (costs[q] + k * COST[INSERT] + cost, places[q], INSERT * k + edit, q)
                            best[to] = min(best.get(to, way), way)
            least = min(w[0] for w in best.values())
            best = {q: w for q, w in best.items() if w[0] - least <= SLACK}
            order = sorted(best, key=lambda q: best[q][1:3])
            kind = tuple(best[q][0] - least if q in best else None for q in STATES), tuple(order.index(q) if q in best else 0 for q in STATES)
            found = self.known[key] = kind, least, tuple((best[q][3], best[q][2]) if q in best else None for q in STATES)
        return found

    def end(self, kind: tuple) -> tuple[int, int, int]:
        """(cost added, state, inserted rows) of the cheapest way to end here, of equal ones that with the least audit."""
        costs, places = kind
        ends = [(costs[q] + k * COST[INSERT], places[q], k, q) for q, k, to in _inserted() if costs[q] is not None and to in (START, AFTER_A)]
        cost, _, k, q = min(ends)
        return cost, q, k


def repairs(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of sorted signatures; each layer is computed once for the prefix that neighbours share."""
    layers, path, before = Layers(), [], ""
    path.append((layers.first, 0, None))
    for signature in signatures:
        shared = len(commonprefix((before, signature)))
        del path[shared + 1 :]
        for symbol in signature[shared:]:
            kind, total, _ = path[-1]
            kind, cost, moves = layers.next(kind, symbol)
            path.append((kind, total + cost, moves))
        before = signature
        more, q, k = layers.end(path[-1][0])
        audit = [INSERT * k]
        for _, _, moves in reversed(path[1:]):
            q, edits = moves[q]
            audit.append(edits)
        yield signature, path[-1][1] + more, "".join(reversed(audit))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32 of ``conv_id:turn`` mod 20 deals out; nulls are one space in role, text and this key.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it with the same turn, 4 makes its role user; others stay.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("n"))
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")


def _facts(rows: DataFrame) -> DataFrame:
    """Adds conv, initial, blank, truncated, digest, first: what a row's symbol takes, and the place where a repeated row and text stands first."""
    last: Column = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    rows = rows.withColumns({
        "conv": F.col("conv_id").cast("string"), "initial": F.substring("role", 1, 1), "last": last, "place": F.struct(F.col("turn").isNotNull().alias("known"), "turn"),
        "digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256),
    }).withColumns({"blank": F.col("last") == "", "truncated": ~F.col("last").isin(".", "!", "?")}).drop("last")
    firsts = rows.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left").drop("c", "d").withColumn("later", F.coalesce(F.col("place") > F.col("first"), F.lit(False))).drop("place", "first")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, one row for each conversation out: its signature and the counts of its faults. A symbol for each row is held."""
    now, s = object(), None

    def row() -> dict:
        low, high, distinct = s["turns"]
        return {"conv": now, "signature": "".join(s["signature"]), "gaps": high - low + 1 - distinct if distinct else 0} | {k: s[k] for k in ("blank", "duplicate", "truncated", "illegal")}

    for batch in batches:
        out = []
        for conv, turn, initial, blank, truncated, digest, later in zip(*[batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "blank", "truncated", "digest", "later")], strict=True):
            if s is None or conv != now:
                if s is not None:
                    out.append(row())
                now, s = conv, {"signature": [], "turns": (0, 0, 0), "last": None, "turn": None, "digest": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            again = later or (s["last"] is not None and turn == s["turn"] and digest == s["digest"])
            fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
            if fault:
                s[fault] += 1
            symbol = initial if initial in ("s", "u", "a") else OTHER
            s["signature"].append(DELETED if blank or again else symbol.upper() if truncated else symbol)
            s["illegal"] += s["last"] is not None and s["last"] + initial not in ("su", "ua", "au")
            if turn is not None:
                low, high, distinct = s["turns"]
                s["turns"] = (low, turn, distinct + (turn != high)) if distinct else (turn, turn, 1)
            s["last"], s["turn"], s["digest"] = initial, turn, digest
        if out:
            yield pa.RecordBatch.from_pylist(out, _ROW)
    if s is not None:
        yield pa.RecordBatch.from_pylist([row()], _ROW)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = repairs(x for batch in batches for x in batch.column("signature").to_pylist())
    part: list[tuple[str, int, str]] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*part, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["signature", "cost", "audit"])

    held = 0
    for row in found:
        part.append(row)
        held += len(row[0])
        if held > 1_000_000:
            yield out()
            part, held = [], 0
    yield out()


class _Repaired:
    """The rows of one conversation after its edits, as they come: only a place in the audit and a state are held."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at, self.state = self.at + 1, _made(self.state)
            yield ROLES[self.state], ""

    def rows(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == REROLE:
            self.state = _made(self.state)
            yield ROLES[self.state], text
        elif edit == KEEP:
            self.state = _kept(self.state, role[:1])
            yield role, text


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit, then its sorted rows in; a digest for each conversation out."""
    names, now, repair, state = ["conv", "repaired_sha256"], None, None, None

    def put(rows: Iterator[tuple[str, str]]) -> None:
        for role, text in rows:
            state[0].update(f"{state[1]}{role}:{text}".encode("utf-8", "surrogatepass"))
            state[1] = "\n"

    for batch in batches:
        done: list[tuple[str | None, str]] = []
        for conv, audit, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text")], strict=True):
            if audit is not None:
                if repair:
                    put(repair.inserted())
                    done.append((now, state[0].hexdigest()))
                now, repair, state = conv, _Repaired(audit), [hashlib.sha256(), ""]
            else:
                put(repair.rows(role, text))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names)
    if repair:
        put(repair.inserted())
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([state[0].hexdigest()])], names)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation with rows (conv_id, turn, role, text).

    Rows go by turn (null first), then role, then text; equal rows stand beside one another. A row's first fault counts: blank (no character but
    white space; a null text is blank), duplicate (role and text stood earlier), truncated (it doesn't end with ``.!?``). A null role is empty.
    Blank and duplicate rows must go. The audit has the initials of the cheapest edits that leave roles ``(s?(ua)+)?``, of equally cheap ones the
    least. A null conv_id is a conversation like others. An empty table has none. Other columns aren't read. A conversation's rows pass one
    task as a stream, since its audit and its digest are one value each.
    """
    kind, work = rows.schema["conv_id"].dataType.simpleString(), Workspace(rows.sparkSession, "repair")
    rows = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = ("conv", "turn", "role", "text")
    facts = _facts(rows).repartition("conv").sortWithinPartitions(*order).select("conv", "turn", "initial", "blank", "truncated", "digest", "later")
    signed = work.keep(facts.mapInArrow(_signed, "conv string, signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"), "signed")
    distinct = signed.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    answers = distinct.mapInArrow(_walked, "signature string, cost bigint, audit string")
    found = work.keep(signed.join(answers, "signature").drop("signature"), "found")
    heads = found.select("conv", F.lit(None).cast("bigint").alias("turn"), "audit", F.lit("").alias("role"), F.lit("").alias("text"))
    all_rows = heads.unionByName(rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.lit(None).cast("string").alias("audit"), "role", "text"))
    stream = all_rows.repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), "turn", "role", "text").select("conv", "audit", "role", "text")
    digests = stream.mapInArrow(_digested, "conv string, repaired_sha256 string").withColumnRenamed("conv", "c")
    both = found.join(digests, F.col("conv").eqNullSafe(F.col("c")))
    return both.select(F.col("conv").cast(kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_all(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """repaired(rows), and a row of zeros, an empty audit and the digest of nothing for conversations of ``turns`` that have no rows."""
    ids = turns.select(F.col("conv_id").alias("c")).distinct()
    found = ids.join(repaired(rows), F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("c", "conv_id")
    return found.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
