"""Weights, splits, leakage, deterministic draws, window sampling, and span masking."""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.sequences import token_arrays
from granary.operators.batches import bounded
from granary.operators.skew import splittable
from granary.plans import policy

#: Ids that ``span_mask`` masks at once: three arrays of 64 bits an id.
AT_ONCE = 1 << 20


def two_level_weights(df: DataFrame, group: str, size: str, penalties: list[str], group_power: float = policy.SPECIES_POWER, member_power: float = policy.MEMBER_POWER, eligible: Column | None = None) -> DataFrame:
    """Adds ``sampling_weight``: share of the group's tempered size, times the member's share within it.

    A member counts with its tempered size over the root of its largest penalty; rows that
    are not eligible have weight 0.  Group sums are aggregated and joined back.
    """
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    worst = F.greatest(*(F.col(p) for p in penalties)) if len(penalties) > 1 else (F.col(penalties[0]) if penalties else F.lit(1))
    local = F.pow(F.col(size).cast("double"), F.lit(member_power)) / F.sqrt(worst.cast("double"))
    marked = df.withColumn("__local", F.when(ok, local))
    sums = marked.filter(ok).groupBy(group).agg(F.pow(F.sum(size).cast("double"), F.lit(group_power)).alias("__mass"), F.sum("__local").alias("__sum"))
    total = sums.agg(F.sum("__mass")).scalar()
    weight = F.col("__mass") / total * F.col("__local") / F.col("__sum")
    joined = marked.join(splittable(sums, group), group, "left")
    return joined.withColumn("sampling_weight", F.coalesce(weight, F.lit(0.0))).drop("__local", "__mass", "__sum")


def inverse_group_weight(size: Column) -> Column:
    """1 / group size to 12 places."""
    return F.round(1.0 / size, 12)


def holdout_split(value: Column, held: list[str], name: str = "cold_genus_holdout") -> Column:
    """Split by a stated set of values."""
    return F.when(value.isin(*held), F.lit(name)).otherwise(F.lit("pretrain")) if held else F.lit("pretrain")


def split_leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose rows are in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("splits"), F.count(F.lit(1)).alias("rows")).filter("splits > 1")


def uniform(seed: Column) -> Column:
    """A number in [0, 1) from 52 bits of the SHA-256 of a string: the same in any engine."""
    return F.conv(F.substring(F.sha2(seed, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def weighted_draws(items: DataFrame, draws: DataFrame, key: str, weight: str, u: str = "u") -> DataFrame:
    """Gives each draw the item whose share of the summed weights holds its ``u`` in [0, 1).

    Items and draws are sorted together along [0, 1) in bands, and a running maximum gives
    each draw the last item that begins before it: no range join, no cross join.
    """
    bands = 1024
    order = Window.partitionBy("__coarse").orderBy(key)
    coarse = items.filter(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("w")).withColumn("__coarse", F.pmod(F.xxhash64(key), F.lit(bands)))
    firsts = coarse.groupBy("__coarse").agg(F.sum("w").alias("s"))
    base = firsts.select("__coarse", (F.sum("s").over(Window.orderBy("__coarse")) - F.col("s")).alias("__base"), F.sum("s").over(Window.partitionBy()).alias("__all"))
    placed = coarse.join(F.broadcast(base), "__coarse")  # one row per band
    low = (F.col("__base") + F.sum("w").over(order) - F.col("w")) / F.col("__all")
    starts = placed.select(low.alias("at"), F.lit(0).alias("side"), F.struct(low.alias("at"), F.col(key).alias("k")).alias("item"))
    band = F.least(F.floor(F.col("at") * bands), F.lit(bands - 1))
    asked = draws.select(F.col(u).alias("at"), F.lit(1).alias("side"), F.struct(*draws.columns).alias("draw"))
    starts = starts.withColumn("band", band)
    carry = starts.groupBy("band").agg(F.max("item").alias("item")).withColumn("next", F.coalesce(F.lead("band").over(Window.orderBy("band")), F.lit(bands - 1)))
    carry = carry.filter(F.col("next") > F.col("band")).select(F.explode(F.sequence(F.col("band") + 1, "next")).alias("band"), "item")
    carried = carry.select("band", (F.col("band") / F.lit(float(bands))).alias("at"), F.lit(0).alias("side"), "item")
    every = starts.unionByName(carried.select(*starts.columns)).withColumn("draw", F.lit(None).cast(asked.schema["draw"].dataType))
    every = every.unionByName(asked.withColumn("band", band).withColumn("item", F.lit(None).cast(every.schema["item"].dataType)))
    running = Window.partitionBy("band").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("last", F.max("item").over(running)).filter("side = 1").select("draw.*", F.col("last.k").alias(key))


class Release:
    """A bounded release manifest as flat tables of running shares, for draws by bisection.

    Fixed by the format, so that draws are bit-equal wherever they are made: a step's generator
    is seeded by the first 8 bytes (little end first) of the SHA-256 of seed, step and rank joined
    by zero bytes; a draw takes, in this order, a number for the source, one for the interval, a
    start and a strand.
    """

    def __init__(self, sources: list[dict], context: int):
        usable = [(s["name"], s["weight"] if s["weight"] > 0 else 1.0, np.array([i for i in s["intervals"] if i[1] >= context], np.int64).reshape(-1, 2)) for s in sources]
        usable = [u for u in usable if len(u[2])]
        if not usable:
            raise ValueError("no source has an interval of the context length")
        self.names = [name for name, _, _ in usable]
        self.by_source = self._running(np.array([w for _, w, _ in usable], np.float64))
        self.low = [spans[:, 0] for _, _, spans in usable]
        self.room = [spans[:, 1] - (context - 1) for _, _, spans in usable]
        self.by_interval = [self._running(r.astype(np.float64)) for r in self.room]

    @staticmethod
    def _running(weights: np.ndarray) -> np.ndarray:
        sums = np.cumsum(weights / weights.sum())
        return sums / sums[-1]

    def draws(self, seed: int, step: int, rank: int, batch: int) -> list[tuple]:
        """(step, rank, row, source, start, reverse) of a step."""
        name = f"{seed}\0{step}\0{rank}".encode("ascii")
        rng = np.random.default_rng(int(np.frombuffer(hashlib.sha256(name).digest(), "<u8", 1)[0]))
        out = []
        for row in range(batch):
            source = bisect.bisect_right(self.by_source, rng.random())
            interval = bisect.bisect_right(self.by_interval[source], rng.random())
            low = int(self.low[source][interval])
            start = int(rng.integers(low, low + int(self.room[source][interval])))
            out.append((step, rank, row, self.names[source], start, bool(rng.integers(0, 2))))
        return out


def sample_windows(steps: DataFrame, sources: list[dict], context: int, seed: int, batch: int) -> DataFrame:
    """Draws of (source, interval, start, strand) for each (step, rank).

    ``sources`` (a bounded release manifest) has name, weight and intervals (start, length).
    """
    release = Release(sources, context)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for step, rank in zip(frame["step"].tolist(), frame["rank"].tolist(), strict=True) for r in release.draws(seed, step, rank, batch)]
            yield pd.DataFrame(rows, columns=["step", "rank", "row", "source", "start", "reverse"])

    return steps.select("step", "rank").mapInPandas(draw, "step long, rank long, row int, source string, start long, reverse boolean")


def span_starts(n: int, probability: float, mean_span: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of spans that cover exactly ``ceil(n * probability)`` of ``n`` places and do not overlap.

    Lengths are geometric, the last one cut to the exact share; what stays between spans is a
    uniformly drawn composition, so all is decided in one pass, however long the row.
    """
    target = math.ceil(n * probability)
    if not target:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.minimum(np.cumsum(rng.geometric(1 / mean_span, target)), target)
    ends = ends[: int(np.searchsorted(ends, target)) + 1]
    spans = len(ends)
    bars = np.sort(rng.choice(n - target + spans, spans, replace=False)) - np.arange(spans)  # free places before each span
    lengths = np.diff(ends, prepend=0)
    return bars + ends - lengths, lengths


def span_mask(df: DataFrame, keys: list[str], ids: str, seed: int, probability: float = policy.MASK_SHARE, mean_span: float = policy.MEAN_SPAN, mask: int = 1, low: int = 2, high: int = 6) -> DataFrame:
    """Adds ``masked`` and ``labels`` (-100 where not chosen): geometric spans up to an exact share.

    Of the chosen positions 80 % become the mask, 10 % a random symbol, 10 % stay.  The
    generator is seeded by ``seed`` and the keys, so a row's masks do not depend on its place.
    ``ids`` are token ids, or sequences, which are read as ids in the same pass.  Null and empty
    rows have no ids.
    """
    if not 0 < probability < 1 or mean_span < 1:
        raise ValueError("probability must be between 0 and 1 and mean span at least 1")
    kinds = dict(df.dtypes)
    text = kinds[ids] == "string"
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{ids}` array<bigint>, masked array<bigint>, labels array<bigint>"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole, 1, AT_ONCE)):
            if text:
                values, ends = token_arrays(batch.column(1))
            else:
                lists = batch.column(1).fill_null([])
                ends = lists.offsets.to_numpy().astype(np.int64)
                values = lists.values.to_numpy()[ends[0] : ends[-1]].copy()
                ends -= ends[0]
            out, labels = values.copy(), np.full(len(values), -100, np.int64)
            for a, b, row in zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column(0).to_pylist(), strict=True):
                rng = np.random.default_rng(row % (1 << 64))
                start, length = span_starts(b - a, probability, mean_span, rng)
                at = a + np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                kind = rng.choice(3, len(at), p=(0.8, 0.1, 0.1))
                labels[at] = values[at]
                out[at[kind == 0]] = mask
                out[at[kind == 1]] = rng.integers(low, high, int((kind == 1).sum()))
            offsets = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (values, out, labels))], [*keys, ids, "masked", "labels"])

    row = F.xxhash64(F.lit(seed), *keys).alias("__row")
    return df.select(row, (F.col(ids) if text else F.col(ids).cast("array<bigint>")).alias("__ids"), *keys).mapInArrow(apply, schema)
