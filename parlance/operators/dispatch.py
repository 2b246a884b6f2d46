"""O5: answer every command line with one keyed join.

Plan shape (one output row per input line, always)::

    lines --parse (projection)--> BroadcastHashJoin(catalogue)
          --status projection--> left join (verb, key) lookups
          --reply projection--> (line_id, ts, verb, status, reply)

* The catalogue is checked at every size; up to a bound it is broadcast,
  beyond it joined on salted verbs (see ``catalogue.py``).
* The lookups are aggregated to one answer per ``(verb, key)`` with the number
  of rows found, and left-joined to the lines: one lazy plan without measuring
  jobs. Catalyst broadcasts the answers when the files are small, AQE when the
  aggregated stage turns out to be; otherwise the join is sort-merge.
* The join has a third key, a hash of the first two. It makes Spark shuffle
  the answers once more after the aggregation, and AQE can then split the
  partition of a hot key (it only splits a join fed by plain shuffles).
  Bucketed lookups are joined as they lie, without any shuffle; hot keys are
  split there by ``hot_key_lines``.
* One rule for repeated keys in every strategy: never more than one row per
  line. With ``check_unique`` a line that asks for a key with several lookup
  rows fails the job; without, it gets the least body. Repeats that no line
  asks for do no harm.
* ``keys``: the distinct keys the lines ask for (counted exactly) prune the
  lookup scan, as literal ``key IN (...)`` filters pushed into the Parquet
  scans or, for many keys, by a broadcast; the answers are checkpointed,
  measured and broadcast back. Neither lookups nor lines are shuffled.
* ``pruned``: lines that no lookup can answer leave before the join, and those
  that may be answered are a filter over the scan, from which Spark builds a
  runtime Bloom filter of the requested keys for the scans of large lookups.
* ``hot_key_lines`` answers the keys that many lines ask for from a bounded
  broadcast before the main join, for joins where AQE cannot split them.
* Lines that cannot match (blank, unknown verb, bad arguments) still pass
  through the left join, but with a null join verb and a per-line join key,
  so they spread over all partitions instead of piling on the null key.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from parlance.functions.commands import key_of
from parlance.operators.answers import Answers
from parlance.operators.catalogue import (  # noqa: F401 - re-exported
    CATALOGUE_BROADCAST_MAX,
    MAX_VERB_LENGTH,
    Catalogue,
    CatalogueSide,
    catalogue_side,
)
from parlance.operators.lookups import (  # noqa: F401 - re-exported
    LOOKUP_BROADCAST_MAX_BYTES,
    LOOKUP_BROADCAST_MAX_ROWS,
    LookupCheck,
    _row_bytes,
    bucket_lookups,
    check_lookups,
    check_unique_lookups,
    is_bucketed,
    lookup_table,
    union_lookups,
)
from parlance.operators.parse import parse_commands
from parlance.session import shared_dir

# The statuses, in the order the first matching one wins.
BLANK = "blank"
UNKNOWN_COMMAND = "unknown_command"
BAD_ARGUMENTS = "bad_arguments"
NOT_FOUND = "not_found"
OK = "ok"
STATUSES = (BLANK, UNKNOWN_COMMAND, BAD_ARGUMENTS, NOT_FOUND, OK)
_CODES = {name: i for i, name in enumerate(STATUSES)}

KEYS_BROADCAST_MAX = 1_000_000
KEYS_BROADCAST_MAX_BYTES = 256 * 1024 * 1024
HOT_KEYS_MAX = 100_000
# Up to this many requested keys are fetched to the driver and filtered as
# literals (pushed into the Parquet scans); more go through a broadcast join.
KEYS_IN_LIST_MAX = 10_000
HOT_KEY_MIN_LINES = 10_000
# Up to this many verbs the ``pruned`` strategy writes the catalogue into the plan.
PRUNED_VERBS_MAX = 1_000
STRATEGIES = ("auto", "shuffle", "keys", "pruned")

# Internal column names, prefixed so they cannot clash with user columns.
_ARITY = "__p_arity"
_KEY = "__p_key"
_PRE = "__p_pre_status"
_JVERB = "__p_jverb"
_JKEY = "__p_jkey"
_BODY = "__p_body"
_N = "__p_n"
_HOT = "__p_hot"
_HN = "__p_hot_n"
_HBODY = "__p_hot_body"
_SHARD = "__p_shard"


def _answers(lookups: DataFrame | Answers, wanted=None) -> DataFrame:
    """One row per ``(verb, key)``: how many lookup rows it has, and the least body.

    ``wanted`` narrows a frame of (verb, key, ...) to the rows asked for, before they
    are aggregated; a written table of answers is aggregated already.
    """
    ready = isinstance(lookups, Answers)
    side = lookups.frame if ready else lookups.select("verb", "key", "body")
    side = side.withColumnsRenamed({"verb": _JVERB, "key": _JKEY, "body": _BODY, "n": _N})
    if wanted is not None:
        side = wanted(side)
    if ready:
        return side
    return side.groupBy(_JVERB, _JKEY).agg(F.count(F.lit(1)).alias(_N), F.min(_BODY).alias(_BODY))


def _shard_of() -> Column:
    return F.xxhash64(_JVERB, _JKEY)


def classify(parsed: DataFrame, cat: CatalogueSide) -> DataFrame:
    """Attach the catalogue arity and the status that needs no lookup."""
    with_arity = cat.join(parsed, "left", _ARITY)
    key = key_of("args")
    # A one-byte code, not the status text, travels through the shuffle.
    pre = (
        F.when(F.col("verb").isNull(), F.lit(_CODES[BLANK]))
        .when(F.col(_ARITY).isNull(), F.lit(_CODES[UNKNOWN_COMMAND]))
        .when(
            (F.size("args") != F.col(_ARITY)) | F.col(_KEY).isNull(),
            F.lit(_CODES[BAD_ARGUMENTS]),
        )
    )
    return with_arity.withColumn(_KEY, key).withColumn(_PRE, pre.cast("tinyint"))


def _status_text(code: Column) -> Column:
    # A constant array (folded to one literal) indexed by the code.
    return F.get(F.array(*[F.lit(name) for name in STATUSES]), code)


def _key_filter(rows) -> Column:
    """``verb = v AND key IN (...)`` per verb, as literals.

    On a union of lookups with a constant verb per branch, Catalyst keeps
    only the matching disjunct in each branch and pushes ``key IN (...)``
    into that branch's Parquet scan, where row-group min/max statistics skip
    the groups holding none of the keys (very effective on key-sorted or
    bucketed lookup files).
    """
    by_verb: dict[str, list[int]] = {}
    for r in rows:
        by_verb.setdefault(r[_JVERB], []).append(r[_JKEY])
    cond = F.lit(False)
    for verb, keys in sorted(by_verb.items()):
        cond = cond | ((F.col(_JVERB) == F.lit(verb)) & F.col(_JKEY).isin(sorted(keys)))
    return cond


def _requested_answers(
    keyed: DataFrame, lookups: DataFrame | Answers, max_keys: int, max_bytes: int
) -> tuple[DataFrame, bool] | None:
    """The lookup rows for the keys the lines ask for, one row per key, and
    whether they are small enough to broadcast; ``None`` when more than
    ``max_keys`` distinct keys are asked for.

    The distinct keys come from a partial (map-side) aggregation, so a key
    that a third of the lines ask for is one row per task before the
    shuffle. Their count is checked exactly; each is a catalogue verb and a
    bigint, so their size is bounded too. Up to ``KEYS_IN_LIST_MAX`` of them
    are fetched and become literal ``key IN (...)`` filters pushed into the
    lookup scans (see :func:`_key_filter`); more are checkpointed (so the
    broadcast is built from that, not from the lines again) and broadcast to
    prune the lookup scan. Either way the lookups are not shuffled. The answers are
    checkpointed into the session's checkpoint folder (one lookup scan, and
    a cut lineage), their exact size in bytes is measured, and only below
    ``max_bytes`` are they broadcast back to the lines.
    """
    shared_dir(keyed.sparkSession)
    requested = keyed.filter(F.col(_JVERB).isNotNull()).select(_JVERB, _JKEY).distinct()
    # An exact count (partial aggregation, one number per task to the final
    # sum); only a set known to be small is then fetched or written.
    n = requested.count()
    if n > max_keys:
        return None
    answers = _answers(lookups, _only(requested, n)).checkpoint(eager=True)
    size = answers.agg(F.sum(_row_bytes(_JVERB, _BODY)).alias("bytes")).first()["bytes"] or 0
    return answers, size <= max_bytes


def _only(keys: DataFrame, n: int):
    """A narrowing to ``n`` distinct keys: as literals, or many by a broadcast."""
    if n <= KEYS_IN_LIST_MAX:
        cond = _key_filter(keys.collect())
        return lambda side: side.filter(cond)
    keys = keys.checkpoint(eager=True)
    # Inner join on distinct keys (a semi-join in effect). A left_semi here would be
    # pushed into each branch of a lookup union and recompute the keys once per branch.
    return lambda side: side.join(F.broadcast(keys), on=[_JVERB, _JKEY], how="inner")


def _unique_guard(n: Column, code: Column, verb: Column, key: Column | None = None) -> Column:
    """``code``, or a job failure when the key had ``n`` > 1 lookup rows."""
    where = [F.lit("lookup key ("), verb]
    if key is not None:
        where += [F.lit(", "), key.cast("string")]
    return F.when(
        n > 1,
        F.raise_error(
            F.concat(*where, F.lit(") has "), n.cast("string"), F.lit(" rows; keys must be unique"))
        ).cast("int"),
    ).otherwise(code)


def _hot_key_answers(
    keyed: DataFrame, lookups: DataFrame | Answers, min_lines: int, max_keys: int, max_bytes: int
) -> DataFrame | None:
    """Every key asked for by at least ``min_lines`` lines, with its answer
    (or none), one row per key; ``None`` when there is no such key, or, with
    a warning, when the set is too big to broadcast.

    Lines per key come from a partial (map-side) aggregation, so a hot key
    is one row per task before the shuffle. There are at most
    ``lines / min_lines`` hot keys, and their number is also counted
    exactly against ``max_keys``. Their answers are fetched once (by literal
    ``key IN (...)`` filters pushed into the lookup scans, or for many keys
    a broadcast of them into the scan), checkpointed, and measured in bytes.
    """
    shared_dir(keyed.sparkSession)
    hot = (
        keyed.filter(F.col(_JVERB).isNotNull())
        .groupBy(_JVERB, _JKEY)
        .agg(F.count(F.lit(1)).alias("lines"))
        .filter(F.col("lines") >= min_lines)
        .select(_JVERB, _JKEY)
    )
    n = hot.count()
    if n > max_keys:
        warnings.warn(
            f"hot keys are not split: {n} keys have {min_lines} lines or more, the bound is "
            f"{max_keys}; raise hot_key_lines",
            stacklevel=3,
        )
    if n == 0 or n > max_keys:
        return None
    hot = hot.checkpoint(eager=True)
    hits = _answers(lookups, _only(hot, n)).withColumnsRenamed({_N: _HN, _BODY: _HBODY})
    table = (
        hot.join(hits, on=[_JVERB, _JKEY], how="left")
        .withColumn(_HOT, F.lit(True))
        .checkpoint(eager=True)
    )
    size = table.agg(F.sum(_row_bytes(_JVERB, _HBODY)).alias("bytes")).first()["bytes"] or 0
    if size > max_bytes:
        warnings.warn(
            f"hot keys are not split: their answers take {size} bytes, the bound is {max_bytes}",
            stacklevel=3,
        )
        return None
    return table


def _pruned(
    parsed: DataFrame, entries: tuple[tuple[str, int], ...], lookups: DataFrame | Answers, check_unique: bool
) -> DataFrame:
    """Replies in two branches of one lazy plan: lines a lookup may answer, and the rest.

    The catalogue stands in the plan as literals, so the first branch is a filter
    and a projection over the scan of the lines. That is the shape Spark's optimizer
    takes for the creation side of a runtime filter: where the lookups' scans are
    large and the lines are not, by ``spark.sql.optimizer.runtime.bloomFilter.*``,
    it puts a Bloom filter of the requested keys on each lookup scan, below the
    aggregation and its shuffle. The second branch is answered without any shuffle.
    The lines are read once a branch, and once more for the filter.
    """
    arity = F.element_at(F.create_map(*[F.lit(x) for e in entries for x in e]), F.col("verb"))
    known = F.col("verb").isin([v for v, _ in entries])
    asks = known & (F.size("args") == arity) & key_of("args").isNotNull()
    asked = parsed.where(asks).withColumns({_JVERB: F.col("verb"), _JKEY: key_of("args")})
    side, on = _answers(lookups), [_JVERB, _JKEY]
    if isinstance(lookups, Answers):
        side = F.broadcast(side) if lookups.fits() else side
    else:
        on = [*on, _SHARD]
        side, asked = side.withColumn(_SHARD, _shard_of()), asked.withColumn(_SHARD, _shard_of())
    n, ok = F.col(_N), F.lit(_CODES[OK])
    answered = F.when(n.isNotNull(), _unique_guard(n, ok, F.col(_JVERB), F.col(_JKEY)) if check_unique else ok)
    code = F.coalesce(answered, F.lit(_CODES[NOT_FOUND]))
    status = _status_text(code)
    first = asked.join(side, on=on, how="left").select(
        "line_id", "ts", "verb", status.alias("status"), F.when(code == ok, F.col(_BODY)).otherwise(status).alias("reply")
    )
    other = (
        F.when(F.col("verb").isNull(), BLANK).when(known, BAD_ARGUMENTS).otherwise(UNKNOWN_COMMAND)
    )
    rest = parsed.where(~F.coalesce(asks, F.lit(False))).select(
        "line_id", "ts", "verb", other.alias("status"), other.alias("reply")
    )
    return first.unionByName(rest)


def dispatch_commands(
    lines: DataFrame,
    catalogue: Catalogue | DataFrame,
    lookups: DataFrame | Answers,
    *,
    line_col: str = "line",
    strategy: str = "auto",
    check_unique: bool = True,
    keys_broadcast_max: int = KEYS_BROADCAST_MAX,
    keys_broadcast_max_bytes: int = KEYS_BROADCAST_MAX_BYTES,
    hot_key_lines: int | str | None = None,
    hot_key_min_lines: int = HOT_KEY_MIN_LINES,
) -> DataFrame:
    """Answer every line: ``(line_id, ts, verb, status, reply)``.

    ``lines`` needs ``line_id``, ``ts`` and ``line_col``. ``lookups`` is
    ``(verb, key, body)``, or a written table of their answers (``AnswerTable``),
    which is joined as it is, by broadcast where its measured size allows. ``reply``
    is the looked up body for ``ok`` lines and the status text for every other line.
    There is one row per line, always.

    ``strategy`` picks the lookup join; rows and errors are the same in all:

    * ``auto``: one lazy plan. The lookups are aggregated to one answer per
      key, and Catalyst and AQE choose broadcast or sort-merge from their size.
    * ``shuffle``: the same plan, always sort-merge.
    * ``keys``: for inputs asking for few distinct keys (micro-batches):
      see :func:`_requested_answers`; falls back to ``auto`` beyond
      ``keys_broadcast_max`` distinct keys, and joins the answers without a
      hint (AQE decides) beyond ``keys_broadcast_max_bytes``.

    * ``pruned``: one lazy plan in two branches, for lookups far larger than the
      lines (see :func:`_pruned`); as ``auto`` beyond ``PRUNED_VERBS_MAX`` verbs.
      Takes no ``hot_key_lines``.

    ``check_unique``: a line that asks for a key with several lookup rows fails
    the job, whether its status is read or its reply. Without it such a line gets
    the least of the bodies.

    ``hot_key_lines``: split hot keys without relying on AQE. Keys asked for by
    at least this many lines are answered first from a broadcast (see
    :func:`_hot_key_answers`); their lines then pass the main join with a
    per-line key, spread over all partitions. Costs one more aggregation pass
    over the lines. ``"auto"`` counts the lines and calls a key hot when it
    alone fills an average join partition (lines /
    ``spark.sql.shuffle.partitions``, at least ``hot_key_min_lines``), so there
    are at most as many hot keys as partitions. It is the default for bucketed
    lookups in a batch, whose join AQE cannot split; ``0`` turns it off. A
    split that has to be left out for its size is reported by a warning.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown join strategy {strategy!r}; use one of {STRATEGIES}")
    if lines.isStreaming and (strategy == "keys" or hot_key_lines):
        raise ValueError("keys and hot_key_lines need a batch; use stream_dispatch for streams")
    spark = lines.sparkSession
    cat = catalogue_side(spark, catalogue)
    parsed = parse_commands(lines.select("line_id", "ts", line_col), col=line_col)
    if strategy == "pruned":
        if hot_key_lines:
            raise ValueError("the pruned strategy takes no hot_key_lines")
        if cat.entries and len(cat.entries) <= PRUNED_VERBS_MAX:
            return _pruned(parsed, cat.entries, lookups, check_unique)
    staged = classify(parsed, cat)
    eligible = F.col(_PRE).isNull()
    keyed = staged.withColumns(
        {
            _JVERB: F.when(eligible, F.col("verb")),
            # Lines that cannot match keep a per-line key: with the null
            # verb they never match, and they hash to many partitions.
            _JKEY: F.when(eligible, F.col(_KEY)).otherwise(
                F.xxhash64(F.col("line_id"), F.col(line_col))
            ),
        }
    )
    ready = isinstance(lookups, Answers)
    bucketed = not ready and is_bucketed(lookups)
    if hot_key_lines is None and bucketed and not lines.isStreaming:
        hot_key_lines = "auto"
    if hot_key_lines == "auto":
        if lines.isStreaming:
            raise ValueError("hot_key_lines='auto' needs a batch")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        hot_key_lines = max(hot_key_min_lines, -(-lines.count() // parts))
    elif isinstance(hot_key_lines, str):
        raise ValueError(f"hot_key_lines must be an int, 'auto' or None, got {hot_key_lines!r}")
    hot = None
    if hot_key_lines:
        hot = _hot_key_answers(
            keyed, lookups, hot_key_lines, HOT_KEYS_MAX, keys_broadcast_max_bytes
        )
    if hot is not None:
        keyed = keyed.join(F.broadcast(hot), on=[_JVERB, _JKEY], how="left")
        is_hot = F.col(_HOT).isNotNull()
        keyed = keyed.withColumns(
            {
                _JVERB: F.when(~is_hot, F.col(_JVERB)),
                _JKEY: F.when(~is_hot, F.col(_JKEY)).otherwise(
                    F.xxhash64(F.col("line_id"), F.col(line_col))
                ),
            }
        )
    found = None
    if strategy == "keys":
        found = _requested_answers(keyed, lookups, keys_broadcast_max, keys_broadcast_max_bytes)
    if found is not None:
        answers, small = found
        on = [_JVERB, _JKEY]
        side = F.broadcast(answers) if small else answers
    else:
        side, on = _answers(lookups), [_JVERB, _JKEY]
        if ready and strategy != "shuffle" and lookups.fits():
            side = F.broadcast(side)
        elif not bucketed and not ready:
            on = [*on, _SHARD]
            side = side.withColumn(_SHARD, _shard_of())
            keyed = keyed.withColumn(_SHARD, _shard_of())
        if strategy == "shuffle":
            side = side.hint("merge")
    joined = keyed.join(side, on=on, how="left")
    n, body, ok = F.col(_N), F.col(_BODY), F.lit(_CODES[OK])
    # The guard is part of the code, so that status and reply both carry it.
    answered = F.when(n.isNotNull(), _unique_guard(n, ok, F.col(_JVERB), F.col(_JKEY)) if check_unique else ok)
    if hot is not None:
        is_hot, n = F.col(_HOT).isNotNull(), F.col(_HN)
        hot_ok = F.when(n.isNotNull(), _unique_guard(n, ok, F.col("verb")) if check_unique else ok)
        answered = F.when(is_hot, hot_ok).otherwise(answered)
        body = F.when(is_hot, F.col(_HBODY)).otherwise(body)
    code = F.coalesce(F.col(_PRE), answered, F.lit(_CODES[NOT_FOUND]))
    status = _status_text(code)
    return joined.select(
        "line_id",
        "ts",
        "verb",
        status.alias("status"),
        F.when(code == ok, body).otherwise(status).alias("reply"),
    )


def observe_statuses(replies: DataFrame, to: Observation | str) -> DataFrame:
    """``replies``, counting its lines per status as they pass: no job of its own.

    After the first action an ``Observation`` has one number per status, and
    ``lines``; a name serves a stream, whose progress reports then hold them.
    """
    per = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return replies.observe(to, F.count(F.lit(1)).alias("lines"), *per)


def unknown_commands(
    lines: DataFrame, catalogue: Catalogue | DataFrame, *, line_col: str = "line"
) -> DataFrame:
    """Lines whose verb is not in the catalogue: ``(line_id, ts, line, verb)``.

    Blank lines are dropped first; the rest are anti-joined to the catalogue:
    broadcast while it is proven small, so the lines are not shuffled, and on
    salted verbs beyond that.
    """
    cat = catalogue_side(lines.sparkSession, catalogue)
    parsed = parse_commands(lines.select("line_id", "ts", line_col), col=line_col)
    out = cat.join(parsed.filter(F.col("verb").isNotNull()), "left_anti")
    return out.select("line_id", "ts", line_col, "verb")
