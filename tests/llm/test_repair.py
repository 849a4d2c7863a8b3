import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querent.llm import queries, repair

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
GOAL = re.compile(r"(s?(ua)+)?", re.S)


def faults(rows):
    """(initial, fixed, cut) and the name of the first fault of (turn, role, text) rows."""
    seen, out = set(), []
    for _, role, text in rows:
        visible = text.strip(SPACES)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", fault))
    return out


def enumerated(rows):
    """The best of all strings of edits with at most two messages put in at a place."""
    best, inserts = None, ["", "u", "a", "ua", "au", "uu", "aa"]
    ways = [[("D", "", 2)] if fixed else [("D", "", 2), ("K", i or "?", 5 * cut), ("R", "u", 1 + 5 * cut), ("R", "a", 1 + 5 * cut)] for i, fixed, cut, _ in faults(rows)]
    for own in product(*ways):
        for put in product(inserts, repeat=len(rows) + 1):
            roles = put[0] + "".join(o[1] + p for o, p in zip(own, put[1:], strict=True))
            if GOAL.fullmatch(roles):
                edits = "I" * len(put[0]) + "".join(o[0] + "I" * len(p) for o, p in zip(own, put[1:], strict=True))
                found = (sum(o[2] for o in own) + 5 * sum(map(len, put)), edits)
                best = found if best is None or found < best else best
    return best


def backward(rows):
    """The same from the end, with whole strings: best (cost, letters) of what follows, by the last role."""
    best = {"": (0, ""), "s": None, "u": None, "a": (0, "")}

    def put(best):
        for _ in range(3):
            for q, to in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                if best[to] is not None:
                    new = (best[to][0] + 5, "I" + best[to][1])
                    best[q] = new if best[q] is None else min(best[q], new)
        return best

    best = put(best)
    for initial, fixed, cut, _ in reversed(faults(rows)):
        new = {}
        for q in best:
            ways = [(2, "D", q)]
            if not fixed:
                ways.append((1 + 5 * cut, "R", "a" if q == "u" else "u"))
                if initial == "s" and q == "" or initial == "u" and q != "u" or initial == "a" and q == "u":
                    ways.append((5 * cut, "K", initial))
            ways = [(c + best[to][0], letter + best[to][1]) for c, letter, to in ways if best[to] is not None]
            new[q] = min(ways) if ways else None
        best = put(new)
    return best[""]


def applied(rows, audit):
    out, at, last = [], 0, ""
    for letter in audit:
        if letter == "I":
            last = "assistant" if last[:1] == "u" else "user"
            out.append((last, ""))
            continue
        _, role, text = rows[at]
        at += 1
        if letter != "D":
            last = role if letter == "K" else "assistant" if last[:1] == "u" else "user"
            out.append((last, text))
    assert at == len(rows)
    return out


def wanted(rows):
    kinds, cost = faults(rows), None
    cost, audit = backward(rows)
    messages = applied(rows, audit)
    assert GOAL.fullmatch("".join(r[:1] for r, _ in messages))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip(kinds, kinds[1:], strict=False)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(sum(k[3] == name for k in kinds) for name in ("blank", "duplicate", "truncated")),
        sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest(),
    ), messages


def broken(conv, turn, role, text):
    """The rows that one of the table becomes."""
    value = lambda x: " " if x is None else str(x)
    kind = zlib.crc32(f"{value(conv)}:{value(turn)}".encode()) % 20
    role, text = value(role), value(text)
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def order(row):
    return (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode())


role = st.sampled_from(["user", "assistant", "system", "", "tool", "u"])
text = st.sampled_from(["", " \n", "Yes.", "No", "Well!\t", "?", "a"])
rows_of = lambda n: st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), role, text), max_size=n).map(lambda x: sorted(x, key=order))


@settings(max_examples=60, deadline=None)
@given(rows_of(3))
def test_backward_program_is_the_best_of_all(rows):
    assert backward(rows) == enumerated(rows)


@settings(max_examples=500, deadline=None)
@given(rows_of(14))
def test_audits(rows):
    tally, cost, audit = repair.judged([repair.Row(*r, 1) for r in rows])
    want = wanted(rows)[0]
    assert (tally.gaps(), tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit) == want[:7]


@settings(max_examples=300, deadline=None)
@given(rows_of(14), st.lists(st.integers(0, 14), max_size=4))
def test_segments_join(rows, at):
    cuts = [0, *sorted(min(a, len(rows)) for a in at), len(rows)]
    best, seen = [(0, repair.Piece()), None, None, None], set()
    for a, b in zip(cuts, cuts[1:], strict=False):
        run = repair.Run((0, 1, 2, 3))
        for r in rows[a:b]:
            run.add(repair.Row(*r, 1), r[1:] in seen)
            seen.add(r[1:])
        best = [repair.least([(best[p][0] + run.best[p][q][0], best[p][1], run.best[p][q][1].text()) for p in range(4) if best[p] and run.best[p][q]]) for q in range(4)]
    cost, piece = repair.closed(best)
    assert (cost, piece.text()) == backward(rows)


def test_prefixes_whose_hashes_collide_are_told_apart(monkeypatch):
    monkeypatch.setattr(repair, "PRIME", 2)
    rnd = random.Random(5)
    for _ in range(300):
        rows = sorted(((rnd.randint(0, 9), rnd.choice(["user", "assistant", "system"]), rnd.choice("abc") + rnd.choice(["", "."])) for _ in range(12)), key=order)
        assert repair.judged([repair.Row(*r, 1) for r in rows])[1:] == backward(rows)


def table(spark, n=90):
    rnd, rows = random.Random(3), []
    for conv in [None, *range(n)]:
        for turn in rnd.sample([None, *range(12)], rnd.randint(1, 9)):
            for _ in range(rnd.choice([1, 1, 1, 2])):
                rows.append((conv, turn, rnd.choice(["user", "assistant", "system", None, "tool"]), rnd.choice(["Hello there.", "Hello", " ", None, "What? No", "Fine!", "x" * 100 + rnd.choice("ab."), "Ä\n!"]), rnd.random()))
    rows += [(7, None, "user", "same.", 0.0)] * 40 + [(8, k, "assistant" if k % 3 else "user", f"turn {k}" + "." * (k % 5), 0.0) for k in range(300)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost double").repartition(5)


@pytest.mark.parametrize(("most_rows", "most_text"), [(repair.ROWS, repair.TEXT), (2, 1 << 20), (1000, 30)])
def test_query_against_brute_force(spark, most_rows, most_text):
    rows, df = table(spark)
    by_conv = {}
    for conv, turn, r, t, _ in rows:
        by_conv.setdefault(conv, []).extend(broken(conv, turn, r, t))
    got = {r.conv_id: tuple(r)[1:] for r in repair.audited(repair.damaged(df), most_rows, most_text).collect()}
    assert got.keys() == by_conv.keys()
    want = {conv: wanted(sorted(own, key=order)) for conv, own in by_conv.items()}
    assert got == {conv: w[0] for conv, w in want.items()}
    messages = {}
    for m in repair.repaired(repair.damaged(df), most_rows, most_text).orderBy("place").collect():
        messages.setdefault(m.conv_id, []).append((m.role, m.text))
    assert messages == {conv: w[1] for conv, w in want.items() if w[1]}


def test_edges(spark):
    schema = "conv_id string, turn long, role string, text string"
    assert repair.audited(repair.damaged(spark.createDataFrame([], schema))).collect() == []
    dropped = next(k for k in range(100) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    got = repair.audited(repair.damaged(spark.createDataFrame([(str(dropped), 1, "user", "Hi.")], schema))).collect()
    assert [tuple(r) for r in got] == [(str(dropped), 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    far = spark.createDataFrame([("a", -(2**63), "user", "Hi."), ("a", 2**63 - 1, "assistant", "Yes " * 2_000_000 + ".")], schema)
    found = repair.audited(repair.plain(far)).first()
    assert (found.gaps, found.audit, found.cost) == (2**63 - 1, "KK", 0)


def test_long_conversation(spark):
    rows = spark.range(40_000).selectExpr("5 conv_id", "id turn", "if(id % 7 = 0, 'assistant', if(id % 2 = 0, 'user', 'assistant')) role", "concat('turn ', id % 30000, if(id % 11 = 0, '', '.')) text")
    found = repair.audited(repair.plain(rows), 512).first()
    plain = [(r.turn, r.role, r.text) for r in rows.orderBy("turn").collect()]
    kinds = faults(plain)
    assert (found.duplicate, found.truncated, found.illegal) == (sum(k[3] == "duplicate" for k in kinds), sum(k[2] for k in kinds), sum(a[0] + b[0] not in ("ua", "au") for a, b in zip(kinds, kinds[1:], strict=False)))
    messages = applied(plain, found.audit)
    assert GOAL.fullmatch("".join(r[:1] for r, _ in messages))
    assert found.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    by_conv = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        by_conv.setdefault(r.conv_id, []).extend(broken(r.conv_id, r.turn, r.role, r.text))
    assert {r.conv_id: tuple(r)[1:] for r in queries.op13_repair(spark, sf).collect()} == {c: wanted(sorted(own, key=order))[0] for c, own in by_conv.items()}


def test_sql_says_the_same(spark):
    rows, df = table(spark)
    con = duckdb.connect()
    con.register("given", df.select("conv_id", "turn", "role", "text").toArrow())
    got = [tuple(r) for r in repair.audited(repair.damaged(df.where("conv_id is null or conv_id != 8"))).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.sql(repair.sql("(SELECT * FROM given WHERE conv_id IS DISTINCT FROM 8)")).fetchall()))
