"""Mixing sources to target weights by entropy balancing.

Sources get targets in words; document rates w in [0, 2] stay as close to 1 in relative entropy as the targets allow.
The dual is one multiplier per source, and the rates are exponentially tilted: w = min(2, exp(lambda * size / mean
size)). Newton iterations solve it. Rates depend on (source, size) alone, so rows are counted by those once and the
iterations run over the counts, as grouped sums at the Newton point and a few others of the bracket; the state, a row
per source, is a table that joins them, and nothing is collected but one number a round (how many sources are
unsolved). A source that stays unsolved is an error. All sums are of integers (fixed point), so
reruns agree to the last bit whatever the order of rows.

Rates become whole copies by systematic rounding along (source, size): copies = floor(C + w + 1/2) - floor(C + 1/2),
where C sums the rates before a document. Neighbours have nearly equal sizes, so a source misses its target by less
than its largest document; then, up to ``FLIPS`` times, the one document whose size is nearest to what a source is
short (or over) is taken once more (or less).

Defined cases: a null text has size 0; a null source is a source of its own, last in order; repeated rows are
separate documents; documents of size 0 are taken once and count nothing; a source without words has target 0; an
empty table gives an empty result; further columns are passed on by mix().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import textkernel as K
from tessera.llm.shared import fresh, lean, remove, repeated, store

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
_ONE = 1 << 20  # fixed point of rates
_FINE = float(1 << 10)  # fixed point of sums
_ROUNDS = 40
_POINTS = 6  # of the bracket, besides the Newton point, that a round looks at
FLIPS = 3


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for t in K.texts(batch.column("text")):
            starts, _ = K.spans(t)
            sizes[t.first : t.first + len(t)] = np.diff(K.split_docs(starts, t.offsets))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(sizes)], names=[*names, "size"])


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, the columns of keep, size: the number of words of each text."""
    slim = docs.select("doc_id", "source", *keep, "text")
    fields = ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in ("doc_id", "source", *keep))
    return slim.mapInArrow(lean(_count_words), f"{fields}, size long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target: shares by weight, stopped at cap times the source and the excess reshared.

    Resharing until none is above ends at one water level: sorted by cap / weight, a source is stopped while its cap
    is under the level that the words left over would give it.
    """
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))  # one row per source
    order = every.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    one = one.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    up = every.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    later = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    level = left / F.sum("_w").over(later)
    one = one.withColumn("_level", level).withColumn("_stopped", F.col("_cap") <= F.col("_level") * F.col("_w"))
    rest = F.min(F.when(~F.col("_stopped"), F.struct((F.col("_cap") / F.col("_w")).alias("at"), F.col("_level").alias("level")))).over(every)["level"]
    target = F.when(F.col("_stopped") | rest.isNull(), F.col("_cap")).otherwise(rest * F.col("_w"))
    return one.select("source", "source_size", target.alias("target"))


def _rate(multiplier, x):
    return F.least(F.lit(float(CAP)), F.exp(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), multiplier * x))))


def balance(counts: DataFrame, wanted: DataFrame, cap: int = CAP, rounds: int = _ROUNDS) -> DataFrame:
    """source, lam, mean: the solved multipliers.

    counts: source, size, n. Each round is one grouped sum over the counts, at the Newton point and ``_POINTS`` more of a
    bracket that the signs of the residuals narrow, so the iteration cannot run away where rates are stopped at the cap.
    The first bracket reaches from where even the smallest document brings no more than the target to where all are
    stopped at the cap.
    """
    words = counts.filter("size > 0")
    mean = words.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    state = wanted.filter("source_size > 0").alias("w").join(mean.alias("m"), F.col("w.source").eqNullSafe(F.col("m.source")))
    reach = F.col("mean") / F.col("least")
    low = -reach * (F.greatest(F.log(F.col("source_size") / F.col("target")), F.lit(0.0)) + 1)
    done = F.col("target") >= F.col("source_size") * float(cap)
    lam = F.when(done, F.lit(float("inf"))).otherwise(F.lit(0.0))
    state = store(state.select("w.source", "target", "mean", lam.alias("lam"), low.alias("low"), (reach * (math.log(cap) + 1)).alias("high"), done.alias("done")), "mix-state")
    fixed = lambda v: F.sum(F.round(v * F.lit(_FINE)).cast("decimal(38,0)"))
    for _ in range(rounds):
        if state.filter("not done").isEmpty():
            break
        points = F.array(F.col("lam"), *[F.col("low") + (F.col("high") - F.col("low")) * F.lit((i + 1) / (_POINTS + 1)) for i in range(_POINTS)])
        asked = state.filter("not done").select(F.col("source").alias("s"), "mean", F.explode(points).alias("at"))
        joined = words.join(asked, F.col("source").eqNullSafe(F.col("s")))
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("at"), x)
        mass = F.col("size") * F.col("n")
        sums = joined.groupBy("s", "at").agg(fixed(rate * mass).alias("taken"), fixed(F.when(rate < cap, rate * x * mass).otherwise(F.lit(0.0))).alias("slope"))
        own = state.select(F.col("source").alias("t"), "target", "low", "high")
        over = F.col("taken").cast("double") / _FINE - F.col("target")
        seen = sums.join(own, F.col("s").eqNullSafe(F.col("t"))).select("s", "at", over.alias("over"), (F.col("slope").cast("double") / _FINE).alias("slope"), "low", "high")
        best = F.min(F.struct(F.abs("over").alias("miss"), "at", "over", "slope")).alias("best")
        told = seen.groupBy("s").agg(best, F.max(F.when(F.col("over") < 0, F.col("at"))).alias("under"), F.min(F.when(F.col("over") >= 0, F.col("at"))).alias("above"))
        a, b = state.alias("a"), told.alias("b")
        down, up = F.greatest(F.col("a.low"), "b.under"), F.least(F.col("a.high"), "b.above")
        newton = F.col("best.at") - F.col("best.over") / F.col("best.slope")
        step = F.when((F.col("best.slope") > 0) & (newton > down) & (newton < up), newton).otherwise((down + up) / 2)
        solved = F.col("best.miss") <= F.greatest(F.lit(0.5), F.col("a.target") * 1e-7)
        live = ~F.col("a.done")
        nxt = a.join(b, F.col("a.source").eqNullSafe(F.col("b.s")), "left").select(
            "a.source", "a.target", "a.mean",
            F.when(live, F.when(solved, F.col("best.at")).otherwise(step)).otherwise(F.col("a.lam")).alias("lam"),
            F.when(live, down).otherwise(F.col("a.low")).alias("low"), F.when(live, up).otherwise(F.col("a.high")).alias("high"),
            (F.col("a.done") | F.coalesce(solved, F.lit(False))).alias("done"),
        )
        before, state = state, store(nxt, "mix-state")
        remove(before)
    left = state.filter("not done").select("source").take(5)
    if left:
        raise ValueError(f"unsolved sources: {[r['source'] for r in left]}")
    return state.select("source", "lam", "mean")


def rates(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, size, _salt, w (fixed point), c0 (rates before this class), n: one row for each class of equal documents."""
    classes = sized.groupBy("source", "size", "_salt").agg(F.count("*").alias("n"))
    counts = classes.groupBy("source", "size").agg(F.sum("n").alias("n"))
    solved = balance(counts, wanted).alias("s")
    c = classes.alias("c").join(solved, F.col("c.source").eqNullSafe(F.col("s.source")), "left")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam") == float("inf"), F.lit(float(CAP))).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean")))
    c = c.select("c.source", "size", "_salt", "n", F.round(rate * _ONE).cast("long").alias("w"))
    # Sums in two steps: over a source's distinct sizes, then over the salts of one size; never over documents.
    steps = c.groupBy("source", "size").agg(F.sum(F.col("w") * F.col("n")).alias("_s"))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("source", "size", F.coalesce(F.sum("_s").over(smaller), F.lit(0)).alias("_start")).alias("s")
    earlier = Window.partitionBy("source", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_in", F.coalesce(F.sum(F.col("w") * F.col("n")).over(earlier), F.lit(0))).alias("c")
    same = F.col("c.source").eqNullSafe(F.col("s.source")) & (F.col("c.size") == F.col("s.size"))
    return c.join(steps, same).select("c.source", "c.size", "_salt", "n", "w", (F.col("_start") + F.col("_in")).alias("c0"))


def _flipped(rounded: DataFrame) -> DataFrame:
    """rounded with one document of each source taken once more or less, where that brings the source nearer its target."""
    missing = rounded.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("missing"))
    r, m = rounded.alias("r"), missing.alias("m")
    able = F.when(F.col("missing") > 0, F.col("copies") < CAP).otherwise(F.col("copies") > 0) & (F.col("size") > 0)
    gap = F.abs(F.col("size") - F.abs("missing"))
    best = r.join(m, F.col("r.source").eqNullSafe(F.col("m.source"))).filter(able & (gap < F.abs("missing")))
    best = best.groupBy("r.source").agg(F.min(F.struct(gap.alias("gap"), "size", "_salt", "_j", F.signum("missing").cast("int").alias("by"))).alias("b"))
    best = best.select(F.col("source"), F.col("b.size").alias("size"), F.col("b._salt").alias("_salt"), F.col("b._j").alias("_j"), F.col("b.by").alias("by"))
    same = F.col("r.source").eqNullSafe(F.col("b.source"))
    for k in ("size", "_salt", "_j"):
        same = same & (F.col(f"r.{k}") == F.col(f"b.{k}"))
    keep = [F.col(f"r.{k}") for k in rounded.columns if k != "copies"]
    return r.join(best.alias("b"), same, "left").select(*keep, (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies"))


def copies(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, the columns of keep, size, source_size, target, copies for every row of docs."""
    # Salts are stretches of the order by hash, so that their number changes no result.
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.xxhash64("doc_id", F.lit(1))
    salt = F.least(F.floor((own / F.lit(2.0**64) + 0.5) * salts), F.lit(salts - 1)).cast("int")
    sized = store(sizes(docs, *keep).withColumn("_salt", salt), "mix-sizes")
    wanted = store(targets(sized), "mix-targets")
    classes = rates(sized, wanted).alias("k")
    inside = Window.partitionBy("source", "size", "_salt").orderBy(own, "doc_id", *keep)
    d = sized.withColumn("_j", F.row_number().over(inside)).alias("d")
    same = F.col("d.source").eqNullSafe(F.col("k.source")) & (F.col("d.size") == F.col("k.size")) & (F.col("d._salt") == F.col("k._salt"))
    end = F.col("c0") + F.col("w") * F.col("d._j") + F.lit(_ONE // 2)
    number = (F.floor(end / _ONE) - F.floor((end - F.col("w")) / _ONE)).cast("int")
    mine = [f"d.{n}" for n in ("doc_id", "source", *keep, "size", "_salt", "_j")]
    out = d.join(classes, same).select(*mine, number.alias("copies")).alias("d")
    # A row per source: joined by broadcast only where Spark's own size check allows it.
    out = out.join(wanted.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(*mine, "t.source_size", "t.target", "d.copies")
    out = store(out, "mix-copies")
    for _ in range(FLIPS):
        before, out = out, store(_flipped(out), "mix-copies")
        remove(before)
    remove(sized, wanted)
    return out.drop("_salt", "_j")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "source")


def mix(docs: DataFrame) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; rows taken zero times go. Texts are not shuffled."""
    row = fresh(docs, "_row")
    # Rows are numbered and written once, so that each has its own number of copies, whatever its doc_id.
    numbered = store(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    taken = copies(numbered, row).select(row, F.col("copies").alias("n")).filter("n > 0")
    return repeated(numbered, row, taken, 0)
