"""The command catalogue: which verbs exist and how many arguments each takes.

The catalogue is small by definition (a console has a handful of
commands), and that bound is enforced: at most ``CATALOGUE_BROADCAST_MAX``
verbs of at most ``MAX_VERB_LENGTH`` characters, so broadcasting it is safe.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.commands import SEPARATOR_PATTERN

# The catalogue's broadcast bound: at most this many verbs of at most this
# many characters.
CATALOGUE_BROADCAST_MAX = 10_000
MAX_VERB_LENGTH = 256
_VALUES_MAX = 64
SALTS = 16  # copies of a verb in the join of a catalogue too large to broadcast


@dataclass(frozen=True)
class Catalogue:
    """The known commands: verb -> number of arguments.

    The first argument is the lookup key; a verb needs at least one.
    """

    entries: tuple[tuple[str, int], ...]

    def __init__(self, entries: Iterable[tuple[str, int]]):
        seen: dict[str, int] = {}
        for verb, arity in entries:
            _check_entry(verb, arity)
            if verb in seen:
                raise ValueError(_TWICE.format(verb))
            seen[verb] = arity
        if len(seen) > CATALOGUE_BROADCAST_MAX:
            raise ValueError(
                f"catalogue has {len(seen)} verbs; pass a DataFrame for more than "
                f"{CATALOGUE_BROADCAST_MAX}"
            )
        object.__setattr__(self, "entries", tuple(seen.items()))

    @property
    def verbs(self) -> tuple[str, ...]:
        return tuple(v for v, _ in self.entries)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """A local relation (``LocalTableScan``, no Python worker at run time).

        Short lists become a ``VALUES`` list with bound parameters (values
        are never pasted into SQL text); longer ones an Arrow table, since
        binding thousands of parameters is slow.
        """
        if not self.entries:
            return spark.createDataFrame([], "verb string, arity int")
        if len(self.entries) > _VALUES_MAX:
            import pyarrow as pa

            table = pa.table(
                {
                    "verb": pa.array([v for v, _ in self.entries], pa.string()),
                    "arity": pa.array([a for _, a in self.entries], pa.int32()),
                }
            )
            return spark.createDataFrame(table)
        marks = ", ".join(f"(:v{i}, :a{i})" for i in range(len(self.entries)))
        args: dict[str, object] = {}
        for i, (verb, arity) in enumerate(self.entries):
            args[f"v{i}"] = verb
            args[f"a{i}"] = arity
        return spark.sql(
            "SELECT CAST(verb AS STRING) AS verb, CAST(arity AS INT) AS arity "
            f"FROM VALUES {marks} AS t(verb, arity)",
            args=args,
        )


def _check_verb(verb: str) -> None:
    if not isinstance(verb, str) or not verb:
        raise ValueError(f"verb must be a non-empty string, got {verb!r}")
    if len(verb) > MAX_VERB_LENGTH:
        raise ValueError(f"verb longer than {MAX_VERB_LENGTH} characters")
    if re.search(SEPARATOR_PATTERN, verb):
        raise ValueError(f"verb {verb!r} contains a separator")
    if verb != verb.lower():
        raise ValueError(f"verb {verb!r} must be lower case; lines are matched lower-cased")


_TWICE = "verb {!r} listed twice in the catalogue"


def _check_entry(verb: str, arity: int) -> None:
    _check_verb(verb)
    if not isinstance(arity, int) or arity < 1:
        raise ValueError(f"arity of {verb!r} must be an int >= 1, got {arity!r}")


def _check_large(cat: DataFrame) -> None:
    """The checks of ``Catalogue`` as one pass over a catalogue of any size."""
    verb, arity = F.col("verb"), F.col("arity")
    fine = (
        (F.length(verb) > 0)
        & (F.length(verb) <= MAX_VERB_LENGTH)
        & ~F.regexp_like(verb, F.lit(SEPARATOR_PATTERN))
        & (verb == F.lower(verb))
        & (arity >= 1)
    )
    seen = cat.withColumn("bad", ~F.coalesce(fine, F.lit(False))).groupBy("verb").agg(
        F.count(F.lit(1)).alias("n"), F.max("bad").alias("bad"), F.min("arity").alias("arity")
    )
    for r in seen.filter("bad OR n > 1").limit(1).collect():
        _check_entry(r["verb"], r["arity"])
        if r["n"] > 1:
            raise ValueError(_TWICE.format(r["verb"]))
        raise ValueError(f"verb {r['verb']!r} is not valid")


@dataclass(frozen=True)
class CatalogueSide:
    """The catalogue ready to be joined: checked, and broadcast when proven small."""

    frame: DataFrame
    small: bool
    entries: tuple[tuple[str, int], ...] | None = None  # of a small one

    def join(self, parsed: DataFrame, how: str, arity: str | None = None) -> DataFrame:
        """``parsed`` joined on ``verb``, with the arity under the name given.

        A small catalogue is broadcast. A large one is joined by shuffle: every
        verb is repeated over ``SALTS`` salts, a line takes one by its id, so a
        verb that many lines use spreads over as many partitions, and lines
        without a verb take a key of their own that matches nothing.
        """
        cols = [F.col("verb")] + ([F.col("arity").alias(arity)] if arity else [])
        if self.small:
            return parsed.join(F.broadcast(self.frame.select(*cols)), on="verb", how=how)
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        side = self.frame.select(*cols).withColumnRenamed("verb", "__p_cverb").withColumn("__p_csalt", salt)
        own = F.concat(F.lit(" "), F.col("line_id").cast("string"))  # no verb holds a blank
        keyed = parsed.withColumns(
            {
                "__p_lverb": F.coalesce("verb", own, F.lit(" ")),
                "__p_lsalt": F.pmod(F.xxhash64("line_id", "verb"), F.lit(SALTS)).cast("int"),
            }
        )
        on = (F.col("__p_lverb") == F.col("__p_cverb")) & (F.col("__p_lsalt") == F.col("__p_csalt"))
        return keyed.join(side, on, how).drop("__p_lverb", "__p_lsalt", "__p_cverb", "__p_csalt")


def catalogue_side(spark: SparkSession, catalogue: Catalogue | DataFrame | CatalogueSide) -> CatalogueSide:
    """The catalogue checked by the same rules at every size."""
    if isinstance(catalogue, CatalogueSide):
        return catalogue
    if isinstance(catalogue, Catalogue):
        return CatalogueSide(catalogue.to_df(spark), True, tuple(catalogue.entries))
    cat = catalogue.select(F.col("verb").cast("string"), F.col("arity").cast("int"))
    head = cat.limit(CATALOGUE_BROADCAST_MAX + 1).collect()
    if len(head) <= CATALOGUE_BROADCAST_MAX:
        # Bounded: validate locally and broadcast the checked list.
        return catalogue_side(spark, Catalogue((r["verb"], r["arity"]) for r in head))
    _check_large(cat)
    return CatalogueSide(cat, False)
