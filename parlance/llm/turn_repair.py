"""Operator 11: conversation structure repair over a suffix-shared automaton.

The cheapest repair of a conversation depends on its turns' roles and faults
alone, so a conversation is reduced to a signature, one letter a turn, and every
different signature is worked out once. Signatures are read from their ends.
Sorted by their reversed form, those that end alike are neighbours and share the
path of that ending; and endings that leave the same choices are one node of the
automaton (minimised from the end). A node keeps, for each state of the grammar,
the cost to go, the first edit of the best audit suffix, and the state that edit
leads to, so the suffix is a chain through the nodes below and is never copied.

The grammar has the states START, SYSTEM, USER and PAIRED (read last: nothing, an
s, a u, an a); START and PAIRED may end. In a state each edit leads to one state
only, and edits that cost the same differ in their letter, so the ASCII-least of
the cheapest audits is had by the least letter at each step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from parlance.llm.common import join_aggregate, materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
START, SYSTEM, USER, PAIRED = STATES = range(4)
ENDS = (START, PAIRED)
# state -> role initials it may go on with, and the state after each
GRAMMAR = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": PAIRED}, {"u": USER})
# state -> the initial that an edit writes there
WRITES = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
MUST_GO = "-"
SPACES = " \t\n\x0b\f\r"


class Node:
    """Suffixes with the same choices. Costs are relative: the least of them is 0."""

    __slots__ = ("cost", "edit", "to", "longer")

    def __init__(self, cost: tuple, edit: tuple, to: tuple) -> None:
        self.cost, self.edit, self.to = cost, edit, to
        self.longer: dict[str, tuple[int, Node]] = {}


class Automaton:
    """The nodes met so far, each worked out once; they are few (the costs of two
    states differ by what a few edits cost), however many suffixes there are."""

    def __init__(self) -> None:
        self.nodes: dict[tuple, Node] = {}
        self.end = self._settle([(0, "", g) if g in ENDS else None for g in STATES])[1]

    def _settle(self, best: list) -> tuple[int, Node]:
        # an insert stays at the node; two of them reach any state that inserts can reach
        for _ in STATES:
            for g in STATES:
                to = GRAMMAR[g][WRITES[g]]
                if best[to] is not None:
                    option = (COST[INSERT] + best[to][0], INSERT, to)
                    best[g] = option if best[g] is None else min(best[g], option)
        low = min(b[0] for b in best)
        key = (tuple(b[0] - low for b in best), tuple(b[1] for b in best), tuple(b[2] for b in best))
        if key not in self.nodes:
            self.nodes[key] = Node(*key)
        return low, self.nodes[key]

    def longer(self, letter: str, node: Node) -> tuple[int, Node]:
        """(added cost, node) of a suffix with one more letter in front."""
        if letter not in node.longer:
            best = []
            for g in STATES:
                options = [(COST[DELETE] + node.cost[g], DELETE, g)]
                if letter != MUST_GO:
                    more = TRUNCATED_COST if letter.isupper() else 0
                    to = GRAMMAR[g].get(letter.lower())
                    if to is not None:
                        options.append((COST[KEEP] + more + node.cost[to], KEEP, to))
                    to = GRAMMAR[g][WRITES[g]]
                    options.append((COST[REROLE] + more + node.cost[to], REROLE, to))
                best.append(min(options))
            node.longer[letter] = self._settle(best)
        return node.longer[letter]


def audits(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of signatures, best in order of their reversed form.

    What is held is the automaton and the path of the last signature; the next
    one keeps the part of it that is their common ending.
    """
    auto = Automaton()
    path, base, last = [auto.end], [0], ""
    for s in signatures:
        back, same = s[::-1], 0
        while same < len(back) and same < len(last) and back[same] == last[same]:
            same += 1
        del path[same + 1:], base[same + 1:]
        for letter in back[same:]:
            added, node = auto.longer(letter, path[-1])
            path.append(node)
            base.append(base[-1] + added)
        last = back
        at, state, edits = len(back), START, []
        while edit := path[at].edit[state]:
            state = path[at].to[state]
            edits.append(edit)
            at -= edit != INSERT
        yield s, base[-1] + path[-1].cost[START], "".join(edits)


def _arrow(make: Callable, schema: pa.Schema, weight: Callable, size: int = 2000, most: int = 4_000_000) -> Callable:
    """A function for ``mapInArrow`` from one that turns batches into tuples; a
    batch ends at ``size`` rows or a weight of ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for r in make(batches):
            out.append(r)
            held += weight(r)
            if len(out) >= size or held >= most:
                yield _batch(out, schema)
                out, held = [], 0
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def best_audits(signatures: DataFrame, col: str = "signature") -> DataFrame:
    """``signature, cost, audit``, one row for each different signature.

    Signatures are dealt out by ranges of their reversed form, so that those with
    a common ending meet in a task. Null signatures are left out.
    """
    parts = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = signatures.where(F.col(col).isNotNull()).select(F.col(col).alias("signature")).distinct()
    rows = rows.withColumn("back", F.reverse("signature")).repartitionByRange(parts, "back")
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    run = _arrow(
        lambda batches: audits(s for b in batches for s in b.column(0).to_pylist()),
        schema, lambda r: 2 * len(r[0]),
    )
    return rows.sortWithinPartitions("back").select("signature").mapInArrow(
        run, "signature string, cost bigint, audit string"
    )


def damage(
    conv: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The four columns with planted faults.

    By crc32("conv:turn") modulo 20: 0 drops a row, 1 empties its text, 2 takes
    out its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role user. A null
    role or text becomes one space, and a null in the key counts as one.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(name(conv_col), F.lit(":"), name(turn_col)).cast("binary")) % 20
    rows = conv.select(
        F.col(conv_col), F.col(turn_col), F.coalesce(F.col(role_col), F.lit(" ")).alias("r"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("x"), n.alias("n"),
    )
    role = F.when(F.col("n") == 4, "user").otherwise(F.col("r"))
    text = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.regexp_replace("x", "[.!?]", ""))
    times = F.when(F.col("n") == 3, 2).otherwise(1)
    return rows.where("n <> 0").select(
        conv_col, turn_col, role.alias(role_col), text.otherwise(F.col("x")).alias(text_col),
        F.explode(F.array_repeat(F.lit(0), times)).alias("n"),
    ).drop("n")


def _turns(conv: DataFrame, cols: list[str]) -> DataFrame:
    """``c, t, role, text, h``: the turns, and a digest that stands for the text."""
    c, t, role, text = (F.col(x) for x in cols)
    rows = conv.select(
        c.alias("c"), t.alias("t"), F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
    )
    return rows.withColumn("h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _fault(text: Column, seen: Column) -> Column:
    """b, d, t: the first fault of a turn, blank, duplicate or truncated; else empty."""
    said = F.btrim(text, F.lit(SPACES))
    ended = F.substring(said, -1, 1).isin(".", "!", "?")
    return F.when(said == "", "b").when(seen, "d").when(~ended, "t").otherwise("")


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, gaps, blank, duplicate, truncated, illegal, signature) of sorted turns."""
    now = None
    for b in batches:
        for c, t, initial, fault in zip(*(b.column(k).to_pylist() for k in range(4))):
            if now is None or now[0] != c:
                if now:
                    yield _told(*now)
                now, before = (c, [], {"b": 0, "d": 0, "t": 0, "illegal": 0}, [None, None, 0]), None
            _, letters, count, turns = now
            if t is not None:
                turns[0] = t if turns[0] is None else turns[0]
                turns[2] += t != turns[1]
                turns[1] = t
            if fault:
                count[fault] += 1
            if before is not None and before + initial not in LEGAL:
                count["illegal"] += 1
            before = initial
            letter = initial if initial in ("s", "u", "a") else "x"
            letters.append(MUST_GO if fault in ("b", "d") else letter.upper() if fault else letter)
    if now:
        yield _told(*now)


def _told(c, letters, count, turns) -> tuple:
    gaps = 0 if turns[0] is None else turns[1] - turns[0] + 1 - turns[2]
    return c, gaps, count["b"], count["d"], count["t"], count["illegal"], "".join(letters)


def diagnose(
    conv: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row a conversation: its id, ``gaps, blank, duplicate, truncated, illegal,
    signature, cost, audit``.

    Turns are taken by turn, null first, then by role and by a SHA-256 of the
    text, which also tells whether a turn was said before. Repeated rows are
    turns of their own, and all but the first of them are duplicates. Null role
    and text count as one space; rows with a null conversation id are one
    conversation. ``gaps`` are turn numbers left out between the least and the
    greatest. Other columns are not read. No rows in, no rows out.

    Texts stay where they are read: what is shuffled is a letter and a digest a
    turn. A conversation's turns meet in one task, as their order makes the
    signature; that task sorts them with spill and keeps one letter a turn.
    """
    rows = _turns(conv, [conv_col, turn_col, role_col, text_col])
    kind, ids = conv.schema[conv_col].dataType.simpleString(), to_arrow_type(conv.schema[conv_col].dataType)
    rows = rows.select(
        "c", "t", "role", "h", _fault(F.col("text"), F.lit(False)).alias("fault"),
    ).repartition("c")
    early = F.col("t").asc_nulls_first()
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("c", "role", "h").orderBy(early)))
    fault = F.when((F.col("nth") > 1) & (F.col("fault") != "b"), "d").otherwise(F.col("fault"))
    rows = rows.sortWithinPartitions(F.col("c"), early, "role", "h", "nth").select(
        "c", "t", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")
    )
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    schema = pa.schema([("c", ids), *((x, pa.int64()) for x in counts), ("signature", pa.string())])
    found = rows.mapInArrow(
        _arrow(_figures, schema, lambda r: len(r[-1])),
        f"c {kind}, {', '.join(f'{x} bigint' for x in counts)}, signature string",
    )
    found = materialize(found, "conversation-faults")
    best = materialize(best_audits(found), "conversation-audits")
    out = join_aggregate(found, best, ["signature"])
    return out.select(F.col("c").alias(conv_col), *counts, "signature", "cost", "audit")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, number, edit, role, text): turns as edited, after each audit its turns."""
    now = None

    def writes(c, edit, role, text):
        nonlocal no, state
        if edit in (REROLE, INSERT):
            role = NAMES[WRITES[state]]
        if edit != DELETE:
            state = GRAMMAR[state][role[:1]]
        no += 1
        return c, no - 1, edit, role, text

    def inserts():
        nonlocal at
        while audit[at:at + 1] == INSERT:
            at += 1
            yield writes(now[0], INSERT, None, "")

    for b in batches:
        for c, head, role, text in zip(*(b.column(k).to_pylist() for k in range(4))):
            if head is not None:
                if now:
                    yield from inserts()
                now, audit, at, no, state = (c,), head, 0, 0, START
                continue
            yield from inserts()
            at += 1
            yield writes(c, audit[at - 1], role, text)
    if now:
        yield from inserts()


def repair_conversations(
    conv: DataFrame,
    found: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row an edit, in order: the id, ``edit_no, edit, role, text``.

    ``found`` is what ``diagnose`` says of the same conversations. K keeps a
    turn, R gives it another role, I is an inserted turn with empty text, D a
    turn that goes (role and text are those it had); the repaired conversation is
    all rows but D. Each conversation's audit goes ahead of its turns into the
    task that holds them, sorted, and the turns stream by one at a time.
    """
    rows = _turns(conv, [conv_col, turn_col, role_col, text_col]).withColumn("audit", F.lit(None).cast("string"))
    kind, ids = conv.schema[conv_col].dataType.simpleString(), to_arrow_type(conv.schema[conv_col].dataType)
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    heads = found.select(F.col(conv_col).alias("c"), *map(none, ("t", "role", "text", "h")), "audit")
    both = rows.unionByName(heads).repartition("c").sortWithinPartitions(
        "c", F.col("audit").isNull(), F.col("t").asc_nulls_first(), "role", "h"
    )
    schema = pa.schema([
        ("c", ids), ("edit_no", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
    ])
    out = both.select("c", "audit", "role", "text").mapInArrow(
        _arrow(_edited, schema, lambda r: len(r[4])),
        f"c {kind}, edit_no bigint, edit string, role string, text string",
    )
    return out.withColumnRenamed("c", conv_col)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    now, sha, some = None, None, False
    for b in batches:
        for c, edit, role, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
            if now is None or now[0] != c:
                if now:
                    yield now[0], sha.hexdigest()
                now, sha, some = (c,), hashlib.sha256(), False
            if edit != DELETE:
                sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True
    if now:
        yield now[0], sha.hexdigest()


def repair_report(
    conv: DataFrame,
    ids: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Per id in ``ids`` what ``diagnose`` says but the signature, and a digest of
    the repaired ``role:text`` lines. An id without turns has zeros, an empty audit
    and the digest of nothing.

    The digests are taken from ``repair_conversations`` as it comes, in order
    within its tasks.
    """
    cols = (conv_col, turn_col, role_col, text_col)
    found = diagnose(conv, *cols).drop("signature")
    found = materialize(found, "conversation-repairs")
    kind, key = conv.schema[conv_col].dataType.simpleString(), to_arrow_type(conv.schema[conv_col].dataType)
    schema = pa.schema([("c", key), ("repaired_sha256", pa.string())])
    said = repair_conversations(conv, found, *cols).mapInArrow(
        _arrow(_digests, schema, lambda r: 1), f"c {kind}, repaired_sha256 string"
    )
    all_ids = ids.select(F.col(conv_col).alias("i")).distinct()
    out = all_ids.join(found, F.col("i").eqNullSafe(F.col(conv_col)), "left").drop(conv_col)
    out = out.join(said, F.col("i").eqNullSafe(F.col("c")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        F.col("i").alias(conv_col), *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
