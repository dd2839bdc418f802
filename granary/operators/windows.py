"""Training windows drawn from a packed store, with source and interval tables of any size.

Draws are those of ``sampling.Release``, bit for bit, but no list of sources is held anywhere.
Running shares are stored in bands: a band row has up to ``BAND`` shares, and only the last
share of each band (its head) is looked at to find the band.  Heads of the source table travel
with the task.  Heads of a source's intervals are banded in the same way, level upon level, until
one band is left, so a draw looks at ``BAND`` shares a level, however many intervals there are.

What a step draws depends on what it drew before, as all numbers come from one generator.  So
rows of a batch are drawn in rounds: numbers, then the source's band, then the interval's band,
level by level, each an equi-join that deals all steps side by side.  A step carries the bounds of its earlier
rows and replays them, so that a task that is tried again draws the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.sequences import tokens
from granary.operators.audit import require_empty
from granary.operators.lineage import forget, written
from granary.operators.store import decode, strand

#: Shares of a band row.
BAND = 256


def running_shares(weights: np.ndarray) -> np.ndarray:
    """Sums of shares up to each weight; the last one is 1."""
    sums = np.cumsum(weights / weights.sum())
    return sums / sums[-1]


@dataclass
class Tables:
    """Bands of sources (band, shares, sources) and of intervals (source, level, band, shares, low, room), heads of the first, and the levels of the latter.

    Level 0 has the intervals' shares, each other one the heads of the level below it.
    """

    sources: DataFrame
    intervals: DataFrame
    heads: np.ndarray
    levels: int
    source: str


def tables(sources: DataFrame, intervals: DataFrame, context: int, source: str = "source", split: str | None = None, declared: DataFrame | None = None) -> Tables:
    """Tables for windows of ``context`` symbols.

    ``sources`` has (source, weight) and, where only those of a ``split`` are drawn from, split;
    a weight that is null or not positive counts as 1.  ``intervals`` has (source, start, length);
    those shorter than the context are left out, and sources without any.  ``declared`` has
    (source, windows), the capacity that a manifest promises; another one is an error.
    """
    named = sources if split is None else sources.filter(F.col("split") == split)
    own = intervals.join(named.select(source), source, "left_semi")
    usable = own.filter(F.col("length") >= context)
    if declared is not None:
        observed = usable.groupBy(source).agg(F.sum(F.floor(F.col("length") / context)).alias("observed"))
        told = declared.join(named.select(source), source, "left_semi").join(observed, source, "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
        require_empty(told.filter(~F.col("windows").eqNullSafe(F.col("observed"))), "declared capacity differs")
    kind = dict(sources.dtypes)[source]

    def bands(shares: np.ndarray) -> tuple[pa.ListArray, list[int], np.ndarray]:
        cuts = [*range(0, len(shares), BAND), len(shares)]
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(shares)), cuts, shares[np.array(cuts[1:]) - 1]

    def by_interval(table: pa.Table) -> pa.Table:
        table = table.sort_by([("start", "ascending"), ("length", "ascending")])
        low, room = table["start"].to_numpy(), table["length"].to_numpy() - (context - 1)
        lists, cuts, heads = bands(running_shares(room.astype(np.float64)))
        of = lambda x: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x))
        name = lambda n: table[source].slice(0, 1).take(pa.array([0] * n))
        made = [pa.table({source: name(len(heads)), "level": pa.array([0] * len(heads), pa.int32()), "band": pa.array(np.arange(len(heads))), "shares": lists, "low": of(low), "room": of(room)})]
        while len(heads) > 1:
            lists, _, heads = bands(heads)
            none = pa.nulls(len(heads), pa.list_(pa.int64()))
            made.append(pa.table({source: name(len(heads)), "level": pa.array([len(made)] * len(heads), pa.int32()), "band": pa.array(np.arange(len(heads))), "shares": lists, "low": none, "room": none}))
        return pa.concat_tables(made)

    spans = usable.select(source, F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))
    of_interval = written(spans.groupBy(source).applyInArrow(by_interval, f"`{source}` {kind}, level int, band long, shares array<double>, low array<long>, room array<long>"), "interval_bands")
    levels = of_interval.agg(F.max("level")).first()[0]
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0).cast("double").alias("weight")
    weights = named.select(source, weight).join(of_interval.filter("level = 0 AND band = 0").select(source), source)

    def by_source(table: pa.Table) -> pa.Table:
        table = table.sort_by([(source, "ascending")])
        lists, cuts, _ = bands(running_shares(table["weight"].to_numpy()))
        of = lambda x: pa.array([x.slice(a, b - a).to_pylist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return pa.table({"band": pa.array(np.arange(len(cuts) - 1)), "shares": lists, "sources": pa.array(of(table[source]).to_pylist(), pa.list_(table.schema.field(source).type))})

    # The registry of sources is summed in its order by one task: a name and a weight each, no interval, no symbol.
    of_source = written(weights.select(source, "weight").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: by_source(t), f"band long, shares array<double>, sources array<{kind}>"), "source_bands")
    heads = np.array([r["head"] for r in of_source.select("band", F.element_at("shares", -1).alias("head")).orderBy("band").toLocalIterator()])
    if not len(heads):
        raise ValueError("no source has an interval of the context length")
    return Tables(of_source, of_interval, heads, levels + 1, source)


def _generator(seed: int, step: int, rank: int) -> np.random.Generator:
    name = f"{seed}\0{step}\0{rank}".encode("ascii")
    return np.random.default_rng(int(np.frombuffer(hashlib.sha256(name).digest(), "<u8", 1)[0]))


def _replayed(seed: int, step: int, rank: int, bounds: list[dict]) -> tuple[np.random.Generator, list[tuple[int, bool]]]:
    """The generator after the rows of ``bounds``, and the start and strand of each."""
    rng, out = _generator(seed, step, rank), []
    for b in bounds:
        rng.random(2)
        out.append((int(rng.integers(b["low"], b["low"] + b["room"])), bool(rng.integers(0, 2))))
    return rng, out


_BOUNDS = "array<struct<source:{kind},low:bigint,room:bigint>>"


def draw(steps: DataFrame, made: Tables, seed: int, batch: int) -> DataFrame:
    """(step, rank, row, source, start, reverse): ``batch`` draws for each (step, rank)."""
    source, heads = made.source, made.heads
    kind = dict(made.intervals.dtypes)[source]
    bounds = _BOUNDS.format(kind=kind)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = np.array([_replayed(seed, s, r, x)[0].random(2) for s, r, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]).reshape(-1, 2)
            band = np.searchsorted(heads, u[:, 0], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(u[:, 0]), pa.array(u[:, 1]), pa.array(band)], [*b.schema.names, "u", "v", "band"])

    at = lambda shares, x: F.size(F.filter(shares, lambda c: c <= x))
    level = lambda k: made.intervals.filter(F.col("level") == k).select(F.col(source).alias("source"), F.col("band").alias("part"), F.col("shares").alias("parts"), "low", "room")
    now = steps.select(F.col("step").cast("long").alias("step"), F.col("rank").cast("long").alias("rank"), F.array().cast(bounds).alias("bounds"))
    for _ in range(batch):
        asked = now.mapInArrow(numbers, f"step long, rank long, bounds {bounds}, u double, v double, band long")
        found = asked.join(made.sources, "band").select("step", "rank", "bounds", "v", F.element_at("sources", at(F.col("shares"), F.col("u")) + 1).alias("source"))
        found = found.withColumn("part", F.lit(0).cast("long"))
        for k in range(made.levels - 1, 0, -1):  # a source of fewer levels has no row here and stays in band 0
            below = found.join(level(k).drop("low", "room"), ["source", "part"], "left")
            found = below.withColumn("part", F.coalesce(F.col("part") * BAND + at(F.col("parts"), F.col("v")), F.lit(0)).cast("long")).drop("parts")
        found = found.join(level(0), ["source", "part"])
        place = at(F.col("parts"), F.col("v")) + 1
        one = F.struct("source", F.element_at("low", place).alias("low"), F.element_at("room", place).alias("room"))
        after = written(found.select("step", "rank", F.array_append("bounds", one).alias("bounds")), "draws")
        if _:
            forget(now)
        now = after

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, r, i, x[i]["source"], *got) for s, r, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for i, got in enumerate(_replayed(seed, s, r, x)[1])]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), b.schema.field(2).type.value_type.field("source").type, pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["step", "rank", "row", source, "start", "reverse"])

    return now.mapInArrow(finish, f"step long, rank long, row int, `{source}` {kind}, start long, reverse boolean")


def sample(steps: DataFrame, made: Tables, store: DataFrame, context: int, seed: int, batch: int, block: int) -> DataFrame:
    """(step, rank, row, source, start, reverse, bases, ids): draws with the tokens of their windows, read from the store by range."""
    drawn = written(draw(steps, made, seed, batch).withColumn("length", F.lit(context)), "drawn")
    read = decode(store, drawn, made.source, "start", "length", "bases", block).withColumn("bases", strand(F.col("bases"), F.col("reverse")))
    return read.drop("length").withColumn("ids", tokens(F.col("bases")))
