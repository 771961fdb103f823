"""Permutation test of the window scan.

Shuffling responses among events leaves every window's own sums alone; only the
two sums that hold the response change. All repeats of an event travel as one
array, so events meet windows once however many repeats there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwin.operators.joins import attach
from seasonwin.operators.ordered import running
from seasonwin.operators.products import window_sums
from seasonwin.operators.scan import (
    BASELINE_PARAMETERS,
    COMBO,
    LIN,
    MEAN,
    PARAMETERS,
    QUAD,
    SINGULAR,
    SLOPE,
    aicc,
    center_series,
    event_slices,
)
from seasonwin.session import pin

_HASH_CHUNK = 3


def shuffled_responses(events: DataFrame, repeats: int, seed: int, group: Sequence[str] = ()) -> DataFrame:
    """Each event with ``ys``, its response in every repeat, and its ``position``.

    A repeat orders the events of a group by the hash of (seed, repeat, id), and
    the event at a position of order 0 takes the response at the same position
    of the repeat's order. Hash prefixes cut a group into even chunks, so a
    group of any size is numbered in parallel.
    """
    keyed = events.where(F.col("y").isNotNull()).select(*group, "event_id", "y")
    orders = keyed.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats)))).withColumn(
        "_hash", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("repeat"), F.col("event_id").cast("string")))
    )
    chunk = F.conv(F.substring("_hash", 1, _HASH_CHUNK), 16, 10).cast("long")
    placed = running(
        orders, [*group, "repeat"], ["_hash", "event_id"], {"position": (F.lit(1).cast("long"), F.sum)}, chunk=chunk
    )
    drawn = (
        placed.where(F.col("repeat") > 0)
        .groupBy(*group, "position")
        .agg(F.array_sort(F.collect_list(F.struct("repeat", "y"))).alias("_ys"))
        .select(*group, "position", F.col("_ys.y").alias("ys"))
    )
    home = placed.where(F.col("repeat") == 0).select(*group, "position", "event_id")
    return attach(home, drawn, [*group, "position"], "inner")


def randomise_scan(
    events: DataFrame,
    series: DataFrame,
    repeats: int = 100,
    seed: int = 1,
    start: int = 120,
    stop: int = -150,
    exclude: tuple[int, int] | None = (10, -150),
    stats: Sequence[str] = (MEAN, SLOPE),
    funcs: Sequence[str] = (LIN, QUAD),
    on: Sequence[str] = (),
    group: Sequence[str] = (),
) -> DataFrame:
    """Best window and criterion per combination and repeat of shuffled responses."""
    known = events.where(F.col("y").isNotNull())
    # Read several times below: counted, shuffled and multiplied.
    covered = pin(event_slices(known, center_series(series), start, stop, on), "slices")
    # Shuffle among the events that are fitted: each variable's own, as series may cover different ones.
    fitted = covered.groupBy(*group, "variable", "event_id").agg(F.first("y").alias("y"))
    shuffled = shuffled_responses(fitted, repeats, seed, [*group, "variable"])
    work = attach(covered, shuffled, [*group, "variable", "event_id"], "inner")
    sums = window_sums(work, start, stop, exclude, stats, QUAD in funcs, group, covered)
    return _best_of_repeats(sums, start, stop, funcs, group)


def _best_of_repeats(
    sums: DataFrame, start: int, stop: int, funcs: Sequence[str], group: Sequence[str]
) -> DataFrame:
    """The best window per repeat, from sums per window with a list over repeats.

    All windows of a combination fit the same events, so the best criterion is
    the largest explained sum of squares. What depends on the window alone is
    worked out before the repeats are unfolded; a repeat costs a few products.
    """
    c = F.col
    n = c("n")
    width = start - stop + 1
    per_window = sums.select(
        *group, "variable", "stat", "_window", "n", "sy", "sy2", "sx", "sx2", "_sxy", "_sx2y",
        (c("sx2") - c("sx") * c("sx") / n).alias("_xx"),
        (c("sx3") - c("sx") * c("sx2") / n).alias("_xu"),
        (c("sx4") - c("sx2") * c("sx2") / n).alias("_uu"),
    )
    det = c("_xx") * c("_uu") - c("_xu") * c("_xu")
    per_window = per_window.select(
        "*", (c("sx") / n).alias("_mx"), (c("sx2") / n).alias("_mu"),
        (c("_xx") > SINGULAR * c("sx2")).alias("_line"),
        (det > SINGULAR * c("_xx") * c("_uu")).alias("_curve"), det.alias("_det"),
    ).where("_line")
    each = per_window.select("*", F.posexplode("_sxy").alias("_i", "sxy")).where("sxy is not null")
    xy, uy = c("_xy"), c("_uy")
    each = each.select(
        *group, "variable", "stat", "n", "sy", "sy2", "_window", "_xx", "_xu", "_uu", "_det", "_curve",
        (c("_i") + 1).alias("repeat"),
        (c("sxy") - c("_mx") * c("sy")).alias("_xy"),
        *([(F.get("_sx2y", c("_i")) - c("_mu") * c("sy")).alias("_uy")] if QUAD in funcs else []),
    )
    explained = {
        LIN: F.try_divide(xy * xy, c("_xx")),
        QUAD: F.when(
            c("_curve"),
            F.try_divide(c("_uu") * xy * xy - 2 * c("_xu") * xy * uy + c("_xx") * uy * uy, c("_det")),
        ),
    }
    keys = [*group, "variable", "stat", "repeat"]
    gains = each.select(*keys, "n", "sy", "sy2", "_window", *[explained[f].alias(f"_ss_{f}") for f in funcs])
    best = gains.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("sy").alias("sy"), F.max("sy2").alias("sy2"),
        # Of equal windows the one that opens, then closes, nearest to the range's end, as in the scan's ranks.
        *[F.max(F.when(c(f"_ss_{f}").isNotNull(), F.struct(c(f"_ss_{f}").alias("ss"), (-c("_window")).alias("at")))).alias(f"_best_{f}") for f in funcs],
    )
    per_func = best.select(*keys, "n", "sy", "sy2", F.explode(F.array(*[
        F.struct(F.lit(f).alias("func"), c(f"_best_{f}.ss").alias("ss"), (-c(f"_best_{f}.at")).alias("at")) for f in funcs
    ])).alias("_b")).select(*keys, "n", "sy", "sy2", "_b.*").where("ss is not null")
    total = c("sy2") - c("sy") * c("sy") / n
    rss = F.greatest(total - c("ss"), 1e-15 * total)
    parameters = F.when(c("func") == QUAD, PARAMETERS[QUAD]).otherwise(PARAMETERS[LIN])
    return per_func.select(
        *group, *COMBO, "repeat",
        (F.floor(c("at") / width) + stop).cast("int").alias("open"),
        (F.pmod(c("at"), F.lit(width)) + stop).cast("int").alias("close"),
        F.when(total > 0, aicc(n, rss, parameters) - aicc(n, total, BASELINE_PARAMETERS)).alias("delta_aicc"),
    ).where("delta_aicc is not null")


def permutation_p(scan: DataFrame, rand: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Share of repeats whose best window is at least as good as the observed best."""
    keys = [*group, *COMBO]
    observed = scan.where(F.col("rank") == 1).select(*keys, F.col("delta_aicc").alias("observed"))
    hits = attach(rand.select(*keys, "delta_aicc"), observed, keys, "inner").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("repeats"),
        F.min("observed").alias("observed"),
        (F.count_if(F.col("delta_aicc") <= F.col("observed")) / F.count(F.lit(1))).alias("p"),
    )
    text = F.when(F.col("p") < 0.001, F.lit("<0.001")).otherwise(F.round("p", 3).cast("string"))
    return hits.withColumn("p_text", text)
