import hashlib
import itertools
import random
import re
import zlib

from conftest import SF001
from parlance.llm.common import read
from parlance.llm.turn_repair import audits, best_audits, damage, diagnose, repair_conversations, repair_report

CONV = "conv_id bigint, turn bigint, role string, text string"
SPACES = " \t\n\x0b\f\r"


def exhaustive(letters):
    """Cheapest audit of a short signature: every edit of every turn, with up to two
    inserts in every gap, against the grammar as a pattern."""
    best = None
    for edits in itertools.product("KRD", repeat=len(letters)):
        if any(c == "-" and e != "D" for c, e in zip(letters, edits)):
            continue
        for gaps in itertools.product(range(3), repeat=len(letters) + 1):
            cost = 3 * sum(gaps) + sum({"K": 0, "R": 3, "D": 4}[e] for e in edits)
            cost += sum(3 for c, e in zip(letters, edits) if c.isupper() and e != "D")
            if best and cost > best[0]:
                continue
            # o: any written role, fitted to the pattern below
            shape, audit = "o" * gaps[0], "I" * gaps[0]
            for c, e, g in zip(letters, edits, gaps[1:]):
                shape += {"K": c.lower(), "R": "o", "D": ""}[e] + "o" * g
                audit += e + "I" * g
            n = len(shape)
            want = ("s" if n % 2 else "") + "ua" * (n // 2)
            fits = n != 1 and all(a == b or a == "o" and b != "s" for a, b in zip(shape, want))
            if fits and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def faults(rows):
    """(role, text, fault) of sorted turns."""
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(SPACES)
        f = "b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, f))
    return out


def cheapest(turns):
    """(cost, audit) by recursion over whole audit strings."""
    memo = {}
    step = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    for g, end in enumerate([(0, ""), (6, "II"), (3, "I"), (0, "")]):
        memo[len(turns), g] = end
    for i in range(len(turns) - 1, -1, -1):
        role, _, fault = turns[i]
        more = 3 if fault == "t" else 0
        plain = []
        for g in range(4):
            opts = [(4 + memo[i + 1, g][0], "D" + memo[i + 1, g][1])]
            if fault not in ("b", "d"):
                if role[:1] in step[g]:
                    c, a = memo[i + 1, step[g][role[:1]]]
                    opts.append((more + c, "K" + a))
                c, a = memo[i + 1, step[g]["a" if g == 2 else "u"]]
                opts.append((3 + more + c, "R" + a))
            plain.append(min(opts))
        ins = lambda x: (3 + x[0], "I" + x[1])
        two, three = min(plain[2], ins(plain[3])), min(plain[3], ins(plain[2]))
        memo[i, 2], memo[i, 3] = two, three
        memo[i, 0], memo[i, 1] = min(plain[0], ins(two)), min(plain[1], ins(two))
    return memo[0, 0]


def apply(turns, audit):
    out, i, n = [], 0, sum(e != "D" for e in audit)
    for e in audit:
        name = "assistant" if (n - len(out)) % 2 else "user"
        if e == "I":
            out.append(f"{name}:")
            continue
        role, text, _ = turns[i]
        i += 1
        if e != "D":
            out.append(f"{role if e == 'K' else name}:{text}")
    return out


def damaged(rows):
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if n:
            text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
            yield from [(c, t, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)


def brute(rows):
    out = {}
    by = {c: [] for c, *_ in rows}
    for c, t, role, text in damaged(rows):
        by[c].append((t, role, text))
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        told = faults(turns)
        cost, audit = cheapest(told)
        numbers = [t for t, *_ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        out[c] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(sum(f == k for *_, f in told) for k in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(apply(told, audit)).encode()).hexdigest(),
        )
    return out


def report(spark, rows, schema=CONV):
    conv = spark.createDataFrame(rows, schema)
    got = repair_report(damage(conv), conv).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in got}


def test_audits_are_the_cheapest_and_least():
    short = ["".join(p) for n in range(4) for p in itertools.product("suaxSUAX-", repeat=n)]
    got = {s: (c, a) for s, c, a in audits(iter(sorted(short, key=lambda s: s[::-1])))}
    assert got == {s: exhaustive(s) for s in short}
    # in any order, from other endings
    random.Random(1).shuffle(short)
    assert {s: (c, a) for s, c, a in audits(iter(short))} == got


def test_a_long_conversation_has_few_nodes():
    from parlance.llm.turn_repair import Automaton

    auto, node = Automaton(), None
    node, rng = auto.end, random.Random(2)
    for _ in range(50_000):
        node = auto.longer(rng.choice("suaxSUAX-"), node)[1]
    assert len(auto.nodes) < 200
    long = "".join(rng.choice("suaxSUAX-") for _ in range(20_000))
    (_, cost, audit), = audits(iter([long]))
    assert sum(e != "I" for e in audit) == len(long)
    spent = sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit)
    kept = [e for e in audit if e != "I"]
    assert cost == spent + sum(3 for c, e in zip(long, kept) if c.isupper() and e != "D")


def test_every_signature_once(spark):
    sigs = ["ua", "ua", "sua", "", None, "Ua-", "ua"] * 50
    got = best_audits(spark.createDataFrame([(s,) for s in sigs], "signature string")).collect()
    assert {r["signature"]: (r["cost"], r["audit"]) for r in got} == {s: exhaustive(s) for s in {"ua", "sua", "", "Ua-"}}
    assert len(got) == 4


def test_given_conversations(spark):
    rows = [tuple(r) for r in read(spark, SF001, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert report(spark, rows) == brute(rows)


def hard_rows():
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "tool", "", None, "sys", "User"]
    texts = ["Yes.", "No!", "why?", "cut off", "", None, " \t", "Said. ", "é\U0001f600.", "a:b\nuser:c.", "x" * 50_000 + "."]
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 12)):
            n = rng.choice([t, t, t, 2 * t, None, 0])
            rows += [(c, n, rng.choice(roles), rng.choice(texts))] * rng.choice([1, 1, 1, 2])
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(40)]
    rows += [(None, None, None, None), (-5, None, "user", "Alone.")]
    rows += [(900, t % 700, rng.choice(roles), rng.choice(texts[:8])) for t in range(3000)]  # a third in one
    return rows


def test_hard_rows_match_brute_force(spark):
    rows = hard_rows()
    assert report(spark, rows) == brute(rows)


def test_dropped_conversation_has_zeros(spark):
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert report(spark, [(c, 0, "user", "Hi.")]) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"), (1, 2, "tool", "cut"), (2, 0, "system", "Be."), (2, 1, "user", "")]
    conv = spark.createDataFrame(rows, CONV)
    found = diagnose(conv)
    got = [tuple(r) for r in repair_conversations(conv, found).orderBy("conv_id", "edit_no").collect()]
    # 1: 0 + 3 + 4, where keeping both users and the cut turn takes 0 + 3 + 0 + 6;
    # 2: 4 + 4, where keeping the system turn takes two inserts besides the delete
    assert got == [
        (1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Hello?"), (1, 2, "D", "tool", "cut"),
        (2, 0, "D", "system", "Be."), (2, 1, "D", "user", ""),
    ]
    costs = {r["conv_id"]: (r["cost"], r["audit"]) for r in found.collect()}
    assert costs == {1: cheapest(faults([(t, r, x) for c, t, r, x in rows if c == 1])), 2: (8, "DD")}


def test_clashing_columns_and_empty_table(spark):
    extra = CONV + ", c int, t string, h string, n int, audit string, back int, fault string"
    rows = [(1, 0, "user", "Hi.", 1, "x", None, 2, "D", 3, "b"), (1, 1, "assistant", "Yes.", 1, "x", None, 2, "D", 3, "b")]
    conv = spark.createDataFrame(rows, extra)
    got = {r["conv_id"]: r["audit"] for r in repair_report(conv, conv).collect()}
    assert got == {1: "KK"}
    empty = spark.createDataFrame([], CONV)
    assert repair_report(damage(empty), empty).collect() == []
