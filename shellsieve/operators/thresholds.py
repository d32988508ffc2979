"""Per-action decision thresholds: defaults, the sweep table and the ascent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shellsieve.functions import vectors as V
from shellsieve.taxonomy import DEFAULT_THRESHOLD, TAXONOMY, Taxonomy

# Fixed value: the grid 0.30 .. 0.70 in steps of 0.05.
GRID = tuple(round(0.30 + 0.05 * i, 2) for i in range(9))


def with_defaults(given: DataFrame, default: float = DEFAULT_THRESHOLD, tax: Taxonomy = TAXONOMY) -> DataFrame:
    """One row per action; unknown keys and non-numbers are ignored."""
    known = given.select(F.col("action"), F.col("threshold").try_cast("double").alias("_t")).groupBy("action").agg(F.max("_t").alias("_t"))
    return (tax.to_df(given.sparkSession).filter(F.col("grp") == "action").select(F.col("id").alias("action"), "pos")
            .join(known, "action", "left")
            .select("pos", "action", F.coalesce("_t", F.lit(default)).alias("threshold")))


def as_dict(thresholds: DataFrame) -> dict[str, float]:
    """Thresholds as plain values; one row per action of the taxonomy."""
    return {r["action"]: r["threshold"] for r in thresholds.select("action", "threshold").collect()}


def sweep(df: DataFrame, scores: str, true_labels: str, grid=GRID, tax: Taxonomy = TAXONOMY) -> DataFrame:
    """(action, threshold) -> tp, predicted, support in one aggregation.

    A score counts for every threshold it reaches. Rows are therefore counted
    once per (action, highest threshold reached) and summed from the top down,
    which leaves 28 x 10 rows to shuffle whatever the input size.
    """
    cuts = sorted(grid)
    entries = F.expr(V.array([
        f"struct({i} AS pos, get({scores}, {i}) AS s, cast(array_contains({true_labels}, {V.lit(a)}) AS int) AS y)"
        for i, a in enumerate(tax.action_ids)]))
    reached = F.expr(" + ".join(f"cast(e.s >= {V.lit(t)} AS int)" for t in cuts))
    cells = (df.select(F.explode(entries).alias("e")).groupBy(F.col("e.pos").alias("pos"), reached.alias("cell"))
             .agg(F.count("*").alias("n"), F.sum("e.y").alias("y")))
    levels = F.array(*[F.struct(F.lit(k + 1).alias("cell"), F.lit(t).alias("threshold")) for k, t in enumerate(cuts)])
    frame = (tax.to_df(df.sparkSession).filter(F.col("grp") == "action")
             .select((F.col("pos") - len(tax.verdict_ids)).alias("pos"), F.col("id").alias("action"), F.explode(levels).alias("l"))
             .select("pos", "action", "l.cell", "l.threshold"))
    zero = cells.filter(F.col("cell") == 0).select("pos", F.col("y").alias("y0"))
    down = Window.partitionBy("pos").orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = (frame.join(cells, ["pos", "cell"], "left").na.fill(0, ["n", "y"])
              .withColumns({"predicted": F.sum("n").over(down), "tp": F.sum("y").over(down),
                            "_all": F.sum("y").over(Window.partitionBy("pos"))}))
    return (summed.join(zero, "pos", "left")
            .select("pos", "action", "threshold", "tp", "predicted",
                    (F.col("_all") + F.coalesce("y0", F.lit(0))).alias("support")))


def tune(sweep_df: DataFrame, passes: int = 2, start: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Greedy coordinate ascent on overall micro F1 over the sweep table.

    Actions take turns in taxonomy order; a threshold changes only on a strict
    gain, the first best grid value wins. The table has 28 x 9 rows whatever the
    data size, so one small group is all this step ever sees.
    """
    def ascend(pdf):
        pdf = pdf.sort_values(["pos", "threshold"])
        tables = {p: g.reset_index(drop=True) for p, g in pdf.groupby("pos")}
        order = sorted(tables)
        support = sum(int(tables[p]["support"].iloc[0]) for p in order)
        at = {p: int((tables[p]["threshold"] - start).abs().idxmin()) for p in order}
        tp = sum(int(tables[p]["tp"][at[p]]) for p in order)
        predicted = sum(int(tables[p]["predicted"][at[p]]) for p in order)

        def f1(hits, guesses):
            precision = hits / max(1, guesses)
            recall = hits / max(1, support)
            return 2 * precision * recall / max(1e-9, precision + recall)

        for _ in range(passes):
            for p in order:
                table = tables[p]
                rest_tp = tp - int(table["tp"][at[p]])
                rest_predicted = predicted - int(table["predicted"][at[p]])
                best, best_f1 = at[p], f1(tp, predicted)
                for k in range(len(table)):
                    value = f1(rest_tp + int(table["tp"][k]), rest_predicted + int(table["predicted"][k]))
                    if value > best_f1:
                        best, best_f1 = k, value
                at[p] = best
                tp = rest_tp + int(table["tp"][best])
                predicted = rest_predicted + int(table["predicted"][best])
        out = pdf.groupby("pos", as_index=False).first()[["pos", "action"]]
        out["threshold"] = [float(tables[p]["threshold"][at[p]]) for p in out["pos"]]
        out["micro_f1"] = f1(tp, predicted)
        return out

    return sweep_df.groupBy().applyInPandas(ascend, "pos int, action string, threshold double, micro_f1 double")
