"""Operator 1: removal of repeated byte strings by merging shard BWTs.

Texts are cut at context-free anchors into phrases, so that a repeated string
of ``length`` bytes shows as a run of equal phrases, its core. Shards build the
suffix array and Burrows-Wheeler transform of their phrase sequences; the
transforms are merged by refining the interleave one phrase at a time, where a
block lists the interval of each shard whose suffixes share the same prefix.
Blocks of one suffix are dropped, so common prefixes and repeated intervals
appear without sorting suffixes across shards. The bytes around each repeated
core then decide every window, by 64-bit hashes inside its block: two different
windows of a block agree with a chance of 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.batches import bounds, give_back, lean, mix, powers, whole_groups
from parlance.llm.common import join_aggregate, materialize

LENGTH = 400
GRAM = 16  # bytes an anchor is chosen by
SPAN = 128  # anchor candidates among which the least is taken
SHARD_ROWS = 200_000  # phrases per shard
HOT_BLOCK = 50_000  # members beyond which a block is counted window by window
BROADCAST_KEYS = 1_000_000  # keys of at most 32 bytes
CONTEXT_BYTES = 8_000_000  # of context in one Arrow batch
PIECE = 1 << 18  # bytes of a text, or of contexts, hashed at once
SIGNED_ROWS = 500  # texts in one batch of signatures
WINDOWS = 500_000  # judged at once, by distance from the anchor

_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))


class Cutter:
    """Anchors of byte strings, for windows of one length.

    The anchor of a window at p is the least gram among the ``span`` starting
    at p (the last of equals), which depends on the window's bytes alone.
    """

    def __init__(self, length: int = LENGTH, gram: int = GRAM, span: int = SPAN) -> None:
        self.length, self.gram, self.span = length, gram, span
        # any window anchored at q holds all anchors of starts up to q + reach
        self.reach = length - gram + 1 - span - (span - 1)
        if not 1 <= self.reach <= 254 or span + gram > 255:
            raise ValueError("span must be at most half of length - gram, and fit one byte")

    def _anchors(self, data: np.ndarray) -> np.ndarray:
        """The anchor of each start whose ``span`` grams lie in ``data``."""
        n, g = len(data), self.gram
        power, inverse = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
        grams = mix((sums[g:] - sums[:-g]) * inverse[: n - g + 1])
        # the upper bits of a gram's hash, then the place counted from the end
        bits, top = np.uint64(31), np.uint64((1 << 31) - 1)
        low = (grams >> bits << bits) | (top - np.arange(len(grams), dtype=np.uint64))
        wide = 1
        while wide * 2 <= self.span:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        if wide < self.span:
            low = np.minimum(low[: len(low) - (self.span - wide)], low[self.span - wide :])
        return (top - (low & top)).astype(np.int64)

    def cut(self, data: np.ndarray):
        """(phrase hashes, packed places) of a text, both per anchor but the last.

        A place packs: start q, phrase bytes, q - first and q - last start of the
        windows anchored here, phrases in the core (0: no whole window). The text
        is worked through in pieces that overlap by what an anchor sees, so
        besides the text a few bytes per byte are held.
        """
        n, g = len(data), self.gram
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lasts, anchors = [], []
        starts = n - g + 1 - (self.span - 1)
        for a in range(0, starts, PIECE):
            b = min(a + PIECE, starts)
            at = a + self._anchors(data[a : b + self.span + g - 2])
            ends = np.flatnonzero(np.append(at[1:] != at[:-1], True))
            lasts.append(a + ends)
            anchors.append(at[ends])
        last, q = np.concatenate(lasts), np.concatenate(anchors)
        own = np.append(q[1:] != q[:-1], True)  # an anchor across an edge is one
        last, q = last[own], q[own]
        first = np.append(0, last[:-1] + 1)
        if len(q) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = q[1:] + g
        size = end - q[:-1]
        phrase = np.empty(len(size), np.uint64)
        for a in range(0, n, PIECE):
            i, j = np.searchsorted(q[:-1], (a, a + PIECE))
            if i < j:
                part = data[a : end[j - 1]]
                power, inverse = powers(len(part) + 1)
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
                here = q[i:j] - a
                phrase[i:j] = (sums[end[i:j] - a] - sums[here]) * inverse[here]
        phrase = mix(phrase + size.astype(np.uint64))
        final = np.minimum(last, n - self.length)
        core = np.searchsorted(last, q + self.reach) - np.arange(len(q))
        core[(final < first) | (q + self.reach > last[-1])] = 0
        q, first, final, core = q[:-1], first[:-1], final[:-1], core[:-1]
        final = np.maximum(final, first)
        place = (q << 32) | (size << 24) | ((q - first) << 16) | ((q - final) << 8) | core
        return phrase.view(np.int64), place


def unpack(place: np.ndarray):
    """(q, phrase bytes, first start, last start, core phrases)."""
    q = place >> 32
    return q, (place >> 24) & 255, q - ((place >> 16) & 255), q - ((place >> 8) & 255), place & 255


def _as_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _signer(cutter: Cutter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SIGNED_ROWS):
                b = whole.slice(at, SIGNED_ROWS)
                keys, sizes, phrases, places = [], [], [], []
                for t in b.column("text"):
                    data = _as_bytes(t.as_py())
                    keys.append(hashlib.sha256(data).digest())
                    sizes.append(len(data))
                    h, p = cutter.cut(np.frombuffer(data, np.uint8))
                    phrases.append(h)
                    places.append(p)
                off = pa.array(np.cumsum([0, *map(len, phrases)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("rid"), b.column("id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(off, pa.array(np.concatenate(phrases))),
                        pa.ListArray.from_arrays(off, pa.array(np.concatenate(places))),
                    ],
                    ["rid", "id", "key", "n", "phrases", "places"],
                )

    return lean(run)


def _having(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` with (or without) a key; the keys are broadcast only if counted few."""
    few = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, how)


# ---------------------------------------------------------------- shard transforms
def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first ``depth`` symbols at least (prefix doubling)."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    order, h = np.argsort(rank, kind="stable"), 1
    while h < depth:
        ahead = np.full(n, -1, np.int64)
        if h < n:
            ahead[: n - h] = rank[h:]
        pair = rank * (n + 1) + ahead + 1
        order = np.argsort(pair, kind="stable")
        s = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
        if rank.max() == n - 1:
            break
        h *= 2
    return order


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Suffix order, BWT and LF mapping of one shard's phrase runs, one row per rank.

    A run is a stretch of neighbouring repeated phrases of one text; runs end in
    symbols of their own, so no prefix crosses an end.
    """
    pdf = pdf.sort_values(["rid", "place"])
    rid, place = pdf["rid"].to_numpy(), pdf["place"].to_numpy()
    phrase = pdf["phrase"].to_numpy()
    n = len(pdf)
    q, size, _, _, core = unpack(place)
    gram = int(pdf["gram"].iloc[0])
    joined = np.zeros(n, bool)  # continues the row before
    joined[1:] = (rid[1:] == rid[:-1]) & (q[1:] + gram == q[:-1] + size[:-1])
    run = np.cumsum(~joined) - 1
    starts = np.flatnonzero(~joined)
    left = np.append(starts[1:], n)[run] - np.arange(n)  # phrases to the run's end
    core = np.where(core <= left, core, 0)
    # a suffix is followed as long as its own core, or that of one before it, needs
    need = core.copy()
    while True:
        more = np.where(joined[1:], np.maximum(need[1:], need[:-1] - 1), need[1:])
        if (more == need[1:]).all():
            break
        need[1:] = more
    final = np.arange(n) + np.maximum(core, 1) - 1  # last phrase of the core
    stop = (q + size)[final]
    symbol = np.unique(phrase, return_inverse=True)[1]
    at = np.arange(n) + run  # places in the text with an end symbol after each run
    seq = np.empty(n + len(starts), np.int64)
    seq[at] = symbol + len(starts)
    ends = np.append(starts[1:], n) + np.arange(len(starts))
    seq[ends] = np.arange(len(starts))
    order = suffix_array(seq, int(need.max(initial=1)) + 1)
    order = order[seq[order] >= len(starts)]  # suffixes that begin with a phrase
    index = np.full(len(seq), -1, np.int64)
    index[at] = np.arange(n)
    row = index[order]
    rank = np.empty(n, np.int64)
    rank[row] = np.arange(n)
    before = np.where(joined[row], rank[row - 1], -1)  # LF: rank of the suffix one longer
    return pd.DataFrame(
        {
            "shard": pdf["shard"].iloc[0], "rank": np.arange(n),
            "bwt": np.where(before >= 0, phrase[row - 1], 0), "lf": before, "phrase": phrase[row],
            "rid": rid[row], "place": place[row], "stop": stop[row], "core": core[row].astype(np.int32),
            "need": need[row].astype(np.int32),
        }
    )


_SHARD = (
    "shard int, rank long, bwt long, lf long, phrase long, rid long, place long, stop long, "
    "core int, need int"
)


def _key(block: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Name of the block one phrase longer, the same in every shard."""
    b = block.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(b + phrase.view(np.uint64)).view(np.int64)


def _intervals(key: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
    """(block, lo, hi) from the ranks in each block, contiguous by construction."""
    order = np.lexsort((rank, key))
    key, rank = key[order], rank[order]
    cuts = bounds([key]) if len(key) else np.zeros(1, np.int64)
    return pd.DataFrame(
        {"block": key[cuts[:-1]], "lo": rank[cuts[:-1]], "hi": rank[cuts[1:] - 1] + 1}
    )


def first_blocks(index: pd.DataFrame) -> pd.DataFrame:
    """Intervals of each first phrase of a shard."""
    index = index.sort_values("rank")
    phrase = index["phrase"].to_numpy()
    out = _intervals(_key(np.zeros(len(phrase), np.int64), phrase), index["rank"].to_numpy())
    return out.assign(shard=index["shard"].iloc[0])[["shard", "block", "lo", "hi"]]


_STEP = "emit boolean, shard int, block long, lo long, hi long, rid long, place long, stop long"


def refiner(level: int, steps: int):
    """Steps of the interleave: blocks of ``level`` phrases -> of ``steps`` more.

    At each step the members whose core has as many phrases as the block are
    emitted, and LF takes the others to the suffixes one phrase longer.
    """

    def run(index: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(state):
            return pd.DataFrame({c.split()[0]: [] for c in _STEP.split(", ")})
        index = index.sort_values("rank")
        lo, hi = state["lo"].to_numpy(), state["hi"].to_numpy()
        size = hi - lo
        rank = np.arange(size.sum()) + np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size)
        block = np.repeat(state["block"].to_numpy(), size)
        shard = int(state["shard"].iloc[0])
        col = {c: index[c].to_numpy() for c in ("bwt", "lf", "rid", "place", "stop", "core", "need")}
        out = []
        for now in range(level, level + steps):
            done = col["core"][rank] == now
            out.append(
                pd.DataFrame(
                    {
                        "emit": True, "shard": shard, "block": block[done], "lo": 0, "hi": 0,
                        "rid": col["rid"][rank[done]], "place": col["place"][rank[done]],
                        "stop": col["stop"][rank[done]],
                    }
                )
            )
            longer = col["lf"][rank]
            go = longer >= 0
            go[go] = col["need"][longer[go]] > now
            block, rank = _key(block[go], col["bwt"][rank[go]]), longer[go]
        rest = _intervals(block, rank).assign(emit=False, shard=shard, rid=0, place=0, stop=0)
        out.append(rest[list(out[0].columns)])
        out = pd.concat(out, ignore_index=True)
        give_back()
        return out

    return run


def levels_of(longest: int) -> list[tuple[int, int]]:
    """(level, steps) rounds up to the longest core: 2 phrases a round at first,
    where most blocks settle, then twice as many each time."""
    out, level, steps = [], 1, 2
    while level <= longest:
        out.append((level, steps))
        level += steps
        if level > 6:
            steps *= 2
    return out


def merge_transforms(index: DataFrame) -> DataFrame:
    """(block, rid, place, stop) of the cores; every repeated core is among them.

    State: one row per block and shard, its interval. A round is one pass over
    the shards' transforms and one aggregation of interval sizes by block;
    blocks of fewer than two suffixes are settled and leave. The phrases of an
    index occur at least twice, so the first level settles none.
    """
    spark = index.sparkSession
    longest = index.agg(F.max("core")).first()[0] or 0
    state = index.select("shard", "rank", "phrase").groupBy("shard").applyInPandas(
        first_blocks, "shard int, block long, lo long, hi long"
    )
    found = []
    for level, steps in levels_of(longest):
        if level > 1:
            total = state.groupBy("block").agg(F.sum(F.col("hi") - F.col("lo")).alias("m"))
            state = state.join(total.where("m > 1").select("block"), "block")
        step = (
            index.drop("phrase").groupBy("shard").cogroup(state.groupBy("shard"))
            .applyInPandas(refiner(level, steps), _STEP)
        )
        step = materialize(step, f"bwt-step-{level}")
        found.append(step.where("emit").select("block", "rid", "place", "stop"))
        state = step.where("not emit").select("shard", "block", "lo", "hi")
        if not state.limit(1).count():
            break
    if not found:
        return spark.createDataFrame([], "block long, rid long, place long, stop long")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


# ---------------------------------------------------------------- windows
def _contexts(cutter: Cutter):
    """Text and core members -> the bytes before and after each core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            held = 0
            for rid, text, blocks, places, stops in zip(
                *(b.column(c) for c in ("rid", "text", "blocks", "places", "stops"))
            ):
                data, r = _as_bytes(text.as_py()), rid.as_py()
                q, _, first, last, _ = unpack(np.asarray(places.as_py(), dtype=np.int64))
                for block, a, f, l, e in zip(
                    blocks.as_py(), q.tolist(), first.tolist(), last.tolist(), stops.as_py()
                ):
                    around = data[f:a] + data[e : l + cutter.length]
                    for c, v in zip(out, (block, r, f, a, e - a, around)):
                        c.append(v)
                    held += len(around)
                    if held > CONTEXT_BYTES:
                        yield _context_batch(out)
                        out, held = ([], [], [], [], [], []), 0
            if out[0]:
                yield _context_batch(out)

    return lean(run)


_CONTEXT = "block long, rid long, first long, anchor long, core long, around binary"


def _context_batch(out) -> pa.RecordBatch:
    types = [pa.int64()] * 5 + [pa.binary()]
    names = ["block", "rid", "first", "anchor", "core", "around"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


class _Windows:
    """The windows of the members in a table, by their distance from the anchor."""

    def __init__(self, t: pa.Table, length: int) -> None:
        self.first, self.anchor, core = (t.column(c).to_numpy() for c in ("first", "anchor", "core"))
        around = t.column("around").combine_chunks()
        size = np.asarray(pc.binary_length(around), dtype=np.int64)
        data = np.zeros(0, np.uint8)
        if size.any():
            offsets, content = around.buffers()[1:]
            at = np.frombuffer(offsets, np.int32)[around.offset : around.offset + len(size) + 1]
            data = np.frombuffer(content, np.uint8)[at[0] : at[-1]]
        # powers count from each member's own beginning, so a short table serves all
        power, self.inverse = powers(int(size.max(initial=0)) + 1)
        self.begin = np.cumsum(size) - size
        self.sums = np.zeros(len(data) + 1, np.uint64)
        upto = np.uint64(0)
        cuts = np.searchsorted(self.begin, np.arange(0, len(data) + PIECE, PIECE))
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i < j:
                a, b = self.begin[i], self.begin[j - 1] + size[j - 1]
                inside = np.arange(a, b) - np.repeat(self.begin[i:j], size[i:j])
                self.sums[a + 1 : b + 1] = upto + np.cumsum(_BYTE[data[a:b]] * power[inside])
                upto = self.sums[b]
        self.part = length - core  # bytes of a window outside the core
        self.count = np.maximum(size - self.part + 1, 0)

    def __len__(self) -> int:
        return int(self.count.sum())

    def hashes(self, near: int, far: int):
        """(row, start, hash) of the windows that begin ``near`` to ``far`` - 1
        bytes before their anchor.

        A hash covers the bytes outside the core, with the distance mixed in, so
        equal hashes in a block mean equal windows.
        """
        ahead = self.anchor - self.first
        lo = np.clip(ahead - far + 1, 0, self.count)
        n = np.clip(ahead - near + 1, lo, self.count) - lo
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        at = self.begin[row] + step
        start = self.first[row] + step
        h = (self.sums[at + self.part[row]] - self.sums[at]) * self.inverse[step]
        apart = (self.anchor[row] - start).astype(np.uint64)
        return row, start, mix(h + apart * np.uint64(0x9FB21C651E98DF25))

    def slices(self, span: int, most: int):
        """All windows, about ``most`` at a time."""
        wide = max(1, span * most // max(1, len(self)))
        for near in range(0, span, wide):
            yield self.hashes(near, min(span, near + wide))


def _spans(rid: np.ndarray, start: np.ndarray, length: int):
    """Merged (rid, start, end) of windows."""
    order = np.lexsort((start, rid))
    rid, start = rid[order], start[order]
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + length)
    cuts = np.append(np.flatnonzero(new), len(rid))
    return rid[cuts[:-1]], start[cuts[:-1]], start[cuts[1:] - 1] + length


def _judge(length: int, span: int, most: int):
    """Windows that occur at least twice in their block -> spans per text.

    Equal windows lie equally far from their anchors, so the distances can be
    judged one slice after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["block"]):
            block = mix(t.column("block").to_numpy().view(np.uint64))
            rid = t.column("rid").to_numpy()
            for row, start, h in _Windows(t, length).slices(span, most):
                _, inv, n = np.unique(block[row] + h, return_inverse=True, return_counts=True)
                twice = n[inv] > 1
                out = _spans(rid[row[twice]], start[twice], length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["rid", "start", "end"])

    return lean(run)


def _listed(length: int, span: int, most: int):
    """All windows of hot blocks, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                block, rid = b.column("block").to_numpy(), b.column("rid").to_numpy()
                for row, start, h in _Windows(pa.Table.from_batches([b]), length).slices(span, most):
                    cols = (block[row], h.view(np.int64), rid[row], start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in cols], ["block", "window", "rid", "start"]
                    )

    return lean(run)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their spans -> maximal removed runs and the digest of the rest."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for key, text, spans in zip(*(b.column(c) for c in ("key", "text", "spans"))):
            data, runs = _as_bytes(text.as_py()), []
            for s in sorted((x["start"], x["end"]) for x in spans.as_py()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            rest, at = hashlib.sha256(), 0
            for s, e in runs:
                rest.update(data[at:s])
                at = e
            rest.update(data[at:])
            for c, v in zip(out, (key.as_py(), runs, sum(e - s for s, e in runs), rest.hexdigest())):
                c.append(v)
        types = (pa.binary(), pa.list_(pa.list_(pa.int64())), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, types)], ["key", "runs", "n_removed", "kept"]
        )


def repeated_strings(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    span: int = SPAN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, removed, kept_sha256``.

    A byte is removed if a string of ``length`` bytes covering it also starts at
    another place, in the same or another text; strings are judged on the
    input and lie within one text. ``removed`` lists the maximal removed runs
    [start, end) in UTF-8 bytes, ``kept_sha256`` is the hex digest of the rest.
    Null text counts as empty; texts under ``length`` bytes stay whole. Repeated
    rows are copies of each other. Null ids pass through. Other columns are not
    read. No rows in, no rows out.

    Equal texts are one text with a count: from two on, all of it is removed.
    Phrases that occur once cannot lie in a repeated string and are left out
    before the shards are built. Phrases and windows are compared by 64-bit
    hashes inside their groups, never by pairs; a block with more than
    ``HOT_BLOCK`` members is counted by an aggregation over its windows instead
    of in one task. Texts whose anchors are dense (periodic ones) need more
    levels, at most ``length`` of them.
    """
    cutter = Cutter(length, gram, span)
    spark = docs.sparkSession
    text = F.col(text_col)
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text.alias("text")
    )
    signed = materialize(
        base.mapInArrow(
            _signer(cutter),
            f"rid long, id {base.schema['id'].dataType.simpleString()}, key binary, n long, "
            "phrases array<bigint>, places array<bigint>",
        ),
        "bwt-signatures",
    )
    keys = materialize(
        signed.where(F.col("n") >= length).groupBy("key").agg(
            F.min("rid").alias("rid"), F.count("*").alias("copies")
        ),
        "bwt-texts",
    )
    copies = keys.where("copies > 1").select("key", F.col("rid").alias("first"))
    later = materialize(
        signed.where(F.col("n") >= length).select("key", "rid").join(copies, "key")
        .where("rid <> first").select("rid"),
        "bwt-copies",
    )
    firsts = _having(
        signed.where(F.size("phrases") > 0).select("rid", "phrases", "places"),
        later, "rid", "left_anti",
    )
    phrases = firsts.select(
        "rid", F.explode(F.arrays_zip(F.col("phrases").alias("phrase"), F.col("places").alias("place")))
        .alias("x"),
    ).select("rid", "x.phrase", "x.place")
    often = phrases.groupBy("phrase").agg(F.count("*").alias("m")).where("m > 1").select("phrase")
    repeated = materialize(join_aggregate(phrases, often, ["phrase"]), "bwt-phrases")
    shards = max(1, -(-repeated.count() // SHARD_ROWS))
    index = materialize(
        repeated.select(
            F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard"),
            "rid", "phrase", "place", F.lit(gram).alias("gram"),
        ).groupBy("shard").applyInPandas(build_shard, _SHARD),
        "bwt-shards",
    )
    members = merge_transforms(index)  # read from the rounds' own tables each time

    named = keys.select("rid", "key", "copies")
    texts = _having(
        docs.select(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("hex"), text.alias("text"))
        .withColumn("key", F.unhex("hex")).select("key", "text"),
        members.select("rid").distinct().join(named, "rid").select("key"), "key",
    )
    per = members.groupBy("rid").agg(F.collect_list(F.struct("place", "stop", "block")).alias("m"))
    near = materialize(
        texts.groupBy("key").agg(F.first("text").alias("text")).join(per.join(named, "rid"), "key").select(
            "rid", "key", "copies", "text", F.col("m.block").alias("blocks"),
            F.col("m.place").alias("places"), F.col("m.stop").alias("stops"),
        ),
        "bwt-near",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    around = near.select("rid", "text", "blocks", "places", "stops").mapInArrow(_contexts(cutter), _CONTEXT)
    hot = members.groupBy("block").agg(F.count("*").alias("m")).where(F.col("m") > HOT_BLOCK).select("block")
    if hot.limit(1).count():
        hot = materialize(hot, "bwt-hot")
        around = materialize(around, "bwt-around")
        cool = _having(around, hot, "block", "left_anti")
        windows = materialize(
            _having(around, hot, "block").mapInArrow(
                _listed(length, span, WINDOWS), "block long, window long, rid long, start long"
            ),
            "bwt-windows",
        )
        twice = windows.groupBy("block", "window").agg(F.count("*").alias("m")).where("m > 1")
        wide = windows.join(twice.select("block", "window"), ["block", "window"]).select(
            "rid", "start", (F.col("start") + length).alias("end")
        )
    else:
        cool, wide = around, None
    spans = (
        cool.repartition(parts, "block").sortWithinPartitions("block")
        .mapInArrow(_judge(length, span, WINDOWS), "rid long, start long, end long")
    )
    if wide is not None:
        spans = spans.union(wide)
    spans = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    cut = (
        spans.join(near.where("copies = 1").select("rid", "key", "text"), "rid")
        .select("key", "text", "spans").mapInArrow(lean(_kept), "key binary, runs array<array<bigint>>, n_removed long, kept string")
    )
    copied = keys.where("copies > 1").select("key", F.lit(True).alias("copied"))
    info = cut.join(copied, "key", "full_outer")
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("n")))
    none = F.array().cast("array<array<bigint>>")
    out = join_aggregate(signed.select("id", "key", "n"), info, ["key"], "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_bytes"),
        F.when(F.col("copied"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), whole).otherwise(F.coalesce("runs", none)).alias("removed"),
        F.when(F.col("copied"), F.lit(hashlib.sha256(b"").hexdigest()))
        .otherwise(F.coalesce("kept", F.lower(F.hex("key")))).alias("kept_sha256"),
    )
