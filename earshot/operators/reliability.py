"""Agreement between annotators: frames, confusion, chance-corrected coefficients and error rates.

Frames are counted and not laid out: a recording is cut wherever an annotator's segment begins or ends, and each such run of
frames is one row for each annotator and active category, with its number of frames as weight. Work grows with the segments,
whatever the frames' length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.interval import REC, SEGMENT

GRID = (REC, "coder", "frame", "n", "category")
MOST_CODERS = 100


def _positions(categories: Sequence[str]):
    return F.create_map(*[x for i, c in enumerate(categories) for x in (F.lit(c), F.lit(i))])


def frames(segments: DataFrame, ranges: DataFrame, timescale: int, categories: Sequence[str], column: str = "speaker_type", coder: str = "set", none: bool = True, overlap: bool = False, coders: Sequence[str] | None = None) -> DataFrame:
    """recording_filename, coder, frame, n, category: one row for each category active in a run of ``n`` frames of ``timescale`` ms, from ``frame``.

    ``ranges`` has one range for each recording, from range_onset; frame 0 begins there. A segment covers the frames from the
    one of its onset up to, without, the one of its offset. With ``none`` a frame without any has the category "none"; with
    ``overlap`` a frame with several also has "overlap". The runs of a recording are the same for all ``coders`` (all there
    are, if not given, and MOST_CODERS at most). One sweep over each recording's bounds, with a running count for each coder
    and category.
    """
    if coders is None:
        found = segments.select(F.col(coder).cast("string").alias("c")).where("c is not null").distinct().limit(MOST_CODERS + 1).collect()
        if len(found) > MOST_CODERS:
            raise ValueError(f"more than {MOST_CODERS} coders")
        coders = sorted(r["c"] for r in found)
    if not coders:
        return ranges.select(REC, F.lit("").alias("coder"), F.lit(0).cast("bigint").alias("frame"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("category")).where("false")
    bounds = ranges.select(REC, "range_onset", F.ceil((F.col("range_offset") - F.col("range_onset")) / timescale).alias("_n")).where("_n > 0")
    at = lambda c: F.floor((F.col(c) - F.col("range_onset")) / timescale)
    inside = segments.where(F.col(column).isin(*categories) & F.col(coder).isin(*coders)).join(bounds, REC)
    inside = inside.withColumns({"_f": F.greatest(at("segment_onset"), F.lit(0)), "_t": F.least(at("segment_offset"), F.col("_n"))}).where("_f < _t")
    state = _positions(coders)[F.col(coder)] * len(categories) + _positions(categories)[F.col(column)]
    bound = lambda t, d: F.struct(F.col(t).cast("bigint").alias("t"), F.lit(d).alias("d"))
    events = inside.select(REC, state.alias("_s"), F.explode(F.array(bound("_f", 1), bound("_t", -1))).alias("b")).select(REC, "_s", "b.*")
    ends = bounds.select(REC, F.lit(-1).alias("_s"), F.explode(F.array(F.lit(0).cast("bigint"), F.col("_n"))).alias("t"), F.lit(0).alias("d"))
    states = range(len(coders) * len(categories))
    steps = events.unionByName(ends).groupBy(REC, "t").agg(*[F.sum(F.when(F.col("_s") == i, F.col("d")).otherwise(0)).alias(f"_{i}") for i in states])
    order = Window.partitionBy(REC).orderBy("t")
    runs = steps.select(REC, F.col("t").alias("frame"), (F.lead("t").over(order) - F.col("t")).alias("n"), *[(F.sum(f"_{i}").over(order) > 0).alias(f"_{i}") for i in states]).where("n is not null")

    def active(i: int):
        some = F.filter(F.array(*[F.when(F.col(f"_{i * len(categories) + j}"), c) for j, c in enumerate(categories)]), lambda x: x.isNotNull())
        some = F.when(F.size(some) > 1, F.concat(some, F.array(F.lit("overlap")))).otherwise(some) if overlap else some
        return F.when(F.size(some) == 0, F.array(F.lit("none"))).otherwise(some) if none else some

    each = runs.select(REC, "frame", "n", F.explode(F.array(*[F.struct(F.lit(c).alias("coder"), active(i).alias("all")) for i, c in enumerate(coders)])).alias("x"))
    return each.select(REC, "x.coder", "frame", "n", F.explode("x.all").alias("category"))


def each_frame(grid: DataFrame) -> DataFrame:
    """The same with a row for each frame, where that is wanted."""
    return grid.withColumn("frame", F.explode(F.sequence("frame", F.col("frame") + F.col("n") - 1))).drop("n")


def labels(grid: DataFrame, categories: Sequence[str], rest: bool = False) -> DataFrame:
    """One label for each run and coder: the last active of ``categories``. With ``rest``, runs with none of them get the last category."""
    place = F.when(F.col("category").isin(*categories), _positions(categories)[F.col("category")])
    best = grid.groupBy(REC, "coder", "frame", "n").agg(F.max_by("category", place).alias("label"))
    return best.withColumn("label", F.coalesce("label", F.lit(categories[-1]))) if rest else best.where("label is not null")


def _weighted(df: DataFrame) -> DataFrame:
    """Items count ``n`` times where they have such a column, else once."""
    return df if "n" in df.columns else df.withColumn("n", F.lit(1).cast("bigint"))


def confusion(grid: DataFrame, first: str, second: str) -> DataFrame:
    """category_1, category_2, n: the frames in which both are active, ``first``'s and ``second``'s."""
    side = lambda who, name, *more: grid.where(F.col("coder") == who).select(REC, "frame", *more, F.col("category").alias(name))
    return side(first, "category_1", "n").join(side(second, "category_2"), [REC, "frame"]).groupBy("category_1", "category_2").agg(F.sum("n").alias("n"))


def krippendorff_alpha(items: DataFrame, item: Sequence[str] = (REC, "frame"), label: str = "label") -> DataFrame:
    """alpha with nominal distance, n_pairable, observed and expected disagreement, over the items with two labels or more: one row.

    alpha = 1 - Do / De. Null where nothing can be paired or only one label is used. An item counts ``n`` times if it has such
    a column.
    """
    each = _weighted(items.where(F.col(label).isNotNull())).groupBy(*item, label).agg(F.count("*").alias("c"), F.max("n").alias("w"))
    sized = each.withColumn("m", F.sum("c").over(Window.partitionBy(*item))).where("m > 1")
    observed = sized.agg(F.sum(F.col("w") * F.col("c") * (F.col("m") - F.col("c")) / (F.col("m") - 1)).alias("differ"), F.sum(F.col("w") * F.col("c")).alias("n"))
    totals = sized.groupBy(label).agg(F.sum(F.col("w") * F.col("c")).alias("t")).agg(F.sum(F.col("t").cast("double") * F.col("t")).alias("same"))
    both = observed.crossJoin(totals)
    do, de = F.col("differ") / F.col("n"), (F.col("n").cast("double") * F.col("n") - F.col("same")) / (F.col("n").cast("double") * (F.col("n") - 1))
    return both.select((1 - do / F.nullif(de, F.lit(0.0))).alias("alpha"), F.coalesce("n", F.lit(0)).alias("n_pairable"), do.alias("observed"), de.alias("expected"))


def multi_kappa(items: DataFrame, coders: Sequence[str], item: Sequence[str] = (REC, "frame"), label: str = "label") -> DataFrame:
    """Chance-corrected agreement of all pairs of ``coders``: (mean agreement - mean chance) / (1 - mean chance), each pair's chance by its coders' own shares."""
    rows = _weighted(items.where(F.col("coder").isin(*coders) & F.col(label).isNotNull()))
    a, b = rows.select(*item, F.col("n").alias("w"), F.col("coder").alias("a"), F.col(label).alias("la")), rows.select(*item, F.col("coder").alias("b"), F.col(label).alias("lb"))
    pairs = a.join(b, list(item)).where("a < b").groupBy("a", "b", "la", "lb").agg(F.sum("w").alias("n"))
    share_a = pairs.groupBy("a", "b", F.col("la").alias("l")).agg(F.sum("n").alias("na"))
    share_b = pairs.groupBy("a", "b", F.col("lb").alias("l")).agg(F.sum("n").alias("nb"))
    total = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("la") == F.col("lb"), F.col("n"))), F.lit(0)).alias("same"))
    chance = share_a.join(share_b, ["a", "b", "l"]).groupBy("a", "b").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("by_chance"))
    each = total.join(chance, ["a", "b"], "left").select((F.col("same") / F.col("n")).alias("ao"), (F.coalesce("by_chance", F.lit(0.0)) / F.col("n") / F.col("n")).alias("ae"))
    return each.agg(F.avg("ao").alias("ao"), F.avg("ae").alias("ae")).select(((F.col("ao") - F.col("ae")) / F.nullif(1 - F.col("ae"), F.lit(0.0))).alias("kappa"), F.col("ao").alias("agreement"), F.col("ae").alias("chance"))


def error_rates(grid: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Frames of reference speech, missed, falsely alarmed and confused (as many as can't be matched), and their rates: one row."""
    side = lambda who, name: grid.where((F.col("coder") == who) & ~F.col("category").isin("none", "overlap")).groupBy(REC, "frame", "n").agg(F.collect_set("category").alias(name))
    both = side(reference, "r").join(side(hypothesis, "h"), [REC, "frame", "n"], "full_outer")
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    right = F.when(F.col("r").isNull() | F.col("h").isNull(), 0).otherwise(F.size(F.array_intersect("r", "h")))
    counts = both.select("n", size("r").alias("r"), size("h").alias("h"), right.alias("c"))
    total = lambda x, name: F.coalesce(F.sum(x * F.col("n")), F.lit(0)).alias(name)
    r, h, c = F.col("r"), F.col("h"), F.col("c")
    out = counts.agg(total(r, "reference"), total(F.greatest(r - h, F.lit(0)), "missed"), total(F.greatest(h - r, F.lit(0)), "false_alarm"), total(F.least(r, h) - c, "confused"))
    n = F.nullif(F.col("reference"), F.lit(0))
    return out.withColumns({"detection_error_rate": (F.col("missed") + F.col("false_alarm")) / n, "identification_error_rate": (F.col("missed") + F.col("false_alarm") + F.col("confused")) / n})


def segments_of(grid: DataFrame, timescale: int) -> DataFrame:
    """The runs of frames of one category as segments again; runs that follow on one another are one."""
    w = Window.partitionBy(REC, "coder", "category").orderBy("frame")
    marked = grid.withColumn("_new", F.when(F.lag(F.col("frame") + F.col("n")).over(w) == F.col("frame"), 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(w)).groupBy(REC, "coder", "category", "_run")
    return runs.agg((F.min("frame") * timescale).alias(SEGMENT[0]), (F.max(F.col("frame") + F.col("n")) * timescale).alias(SEGMENT[1])).drop("_run")
