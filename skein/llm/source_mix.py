"""Operator 6: mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled (by a digest of id and text) and get virtual finish times: the source's
tokens so far divided by the source's target. A source may be gone through twice; the second pass
continues the first. All finish times together are sorted by range and cut where the budget is used up.

Running sums never need a whole source, or everything, in one task: rows fall into small buckets (of
the shuffled order, of the finish times), the buckets' sums are accumulated, and only rows of one bucket
are summed in order. The accumulation itself is one window over the buckets of a source, and one over the slices: narrow
rows, one for 500 documents, and from 5e7 documents on one slice for a 100,000th of them.

Within a source and a pass the finish times rise with the shuffled order, so the cut is one place in that order. These
places, two for each source, are all that a row needs to know: no text and no document moves to learn what is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_WORD, Scratch, small

BUCKET_ROWS = 500
MAX_SLICES = 100_000
#: Fixed by the contract: weights by rank of the source, and the share of all sizes that is mixed, and the passes.
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
PASSES = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, passes: int = PASSES) -> DataFrame:
    """sizes: source, source_size. Adds rank, weight, and target: the share of all sizes dealt out by weight, no source
    above passes times its size, what is over dealt out again by weight.

    The level is found in one pass: sources in the order of limit / weight fill up first.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    limit = (F.lit(passes) * F.col("source_size")).cast("double")
    ranked = sizes.withColumn("rank", F.row_number().over(every) - 1).withColumn("weight", w.cast("double")).withColumn("most", limit)
    ranked = ranked.withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything).cast("double") * share[0] / share[1]
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    # the first source that does not fill up sets the level of all that follow
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    target = F.coalesce(F.least(F.col("most"), first * F.col("weight")), F.col("most"))
    return ranked.withColumn("target", target).select("source", "source_size", "rank", "weight", "target")


def _order(finish: str) -> Column:
    return F.struct(F.col(finish).alias("finish"), "rank", "shuffled", "size", "id")


def _measured(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """id, source, size and the digest that shuffles."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    return [F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WS_WORD)).cast("long").alias("size"), F.md5(named.cast("binary")).alias("shuffled")]


def _thresholds(base: DataFrame, weights: tuple[int, ...], share: tuple[int, int], scratch: Scratch) -> DataFrame:
    """One row per source: of, source_size, target, and for each pass the last (shuffled, size, id) that the mix takes."""
    totals = scratch.write(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")), "source-sizes")
    targets = source_targets(totals.select("source", "source_size"), weights, share)
    targets = targets.alias("t").join(totals.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")))
    targets = scratch.write(targets.select(F.col("t.source").alias("of"), "t.source_size", "t.rank", "t.target", F.greatest(F.lit(1), F.ceil(F.col("s.source_rows") / BUCKET_ROWS)).alias("buckets")), "targets")
    total, n_rows = totals.agg(F.sum("source_size"), F.sum("source_rows")).first()
    total, n_rows = int(total or 0), int(n_rows or 0)

    place = F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long")
    # repeated rows are taken together: they weigh as one of their common size
    once = base.groupBy("source", "shuffled", "size", "id").agg((F.first("size") * F.count("*")).alias("weight"))
    rows = once.join(small(targets), F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", F.shiftright(place * F.col("buckets"), 32))
    rows = scratch.write(rows.select("id", "size", "weight", "source_size", "target", "rank", "shuffled", "bucket"), "documents")
    sums = rows.groupBy("rank", "bucket").agg(F.sum("weight").alias("bucket_size"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.write(sums.select("rank", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("before")), "bucket-sums")
    within = Window.partitionBy("rank", "bucket").orderBy("shuffled", "size", "id").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("inside", F.sum("weight").over(within)).join(small(sums), ["rank", "bucket"])
    done = F.col("before") + F.col("inside")
    finish = [F.when(F.col("target") > 0, (done + F.lit(p) * F.col("source_size")) / F.col("target")).alias(f"finish{p}") for p in range(PASSES)]
    rows = scratch.write(summed.select("id", "size", "weight", "rank", "shuffled", *finish), "finish-times")

    slices = max(1, min(MAX_SLICES, -(-n_rows // BUCKET_ROWS)))
    timed = rows.select("id", "size", "weight", "rank", "shuffled", F.explode(F.array(*(f"finish{p}" for p in range(PASSES)))).alias("finish")).filter("finish is not null")
    timed = timed.withColumn("slice", F.floor(F.least(F.col("finish"), F.lit(4.0)) * slices))
    along = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    by_slice = timed.groupBy("slice").agg(F.sum("weight").alias("n")).select("slice", "n", F.sum("n").over(along).alias("through"))
    over = by_slice.filter(F.col("through") * share[1] > F.lit(total * share[0])).orderBy("slice").select("slice", F.col("through") - F.col("n")).first()
    if over is None:
        taken = [F.col(f"finish{p}").isNotNull() for p in range(PASSES)]
    else:
        # the slice in which the budget runs out: its rows in order, up to the last that fits
        edge = timed.filter(F.col("slice") == over[0]).withColumn("at", _order("finish"))
        upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        last = edge.withColumn("through", F.sum("weight").over(upto) + over[1]).filter(F.col("through") * share[1] <= F.lit(total * share[0])).agg(F.max("at").alias("at")).first()["at"]
        if last is None:
            taken = [F.floor(F.least(F.col(f"finish{p}"), F.lit(4.0)) * slices) < over[0] for p in range(PASSES)]
        else:
            kinds = dict(rows.dtypes)
            cut = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["rank"]).cast(kinds["rank"]).alias("rank"), F.lit(last["shuffled"]).alias("shuffled"), F.lit(last["size"]).cast("long").alias("size"), F.lit(last["id"]).cast(kinds["id"]).alias("id"))
            taken = [F.col(f"finish{p}").isNotNull() & (_order(f"finish{p}") <= cut) for p in range(PASSES)]
    where = F.struct("shuffled", "size", "id")
    cuts = scratch.write(rows.groupBy(F.col("rank").alias("r")).agg(*(F.max(F.when(t, where)).alias(f"cut{p}") for p, t in enumerate(taken))), "cuts")
    return targets.join(small(cuts), F.col("rank") == F.col("r"), "left").select("of", "source_size", "target", *(f"cut{p}" for p in range(PASSES)))


def _passes() -> Column:
    """How often a row (shuffled, size, id, with its source's cuts) is taken. Nothing is taken of an empty text."""
    where = F.struct("shuffled", "size", "id")
    times = sum((F.coalesce((where <= F.col(f"cut{p}")).cast("long"), F.lit(0)) for p in range(1, PASSES)), F.coalesce((where <= F.col("cut0")).cast("long"), F.lit(0)))
    return F.when(F.col("size") > 0, times).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, size (words), source_size, target (of its source), taken (words that the mix
    takes, 0, size or twice size).

    Null and empty texts have size 0 and nothing is taken of them. Null is a source of its own, the last. Rows that
    repeat id, text and source are taken together, all or none; other ties cannot be. Further columns are ignored. An
    empty table gives none. The mix takes whole documents, so a source ends within one document (with its repeats) of its
    target. The result is a table in the shared folder; all others that the mix writes are deleted.
    """
    with Scratch(docs.sparkSession, "mix") as scratch:
        base = scratch.write(docs.select(*_measured(id_col, text_col, source_col)), "sizes")
        cuts = _thresholds(base, weights, share, scratch)
        out = base.join(small(scratch.write(cuts, "thresholds")), F.col("source").eqNullSafe(F.col("of")))
        return scratch.result(out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * _passes()).cast("long").alias("taken")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() takes it, with all their columns. No text is shuffled."""
    with Scratch(docs.sparkSession, "mix") as scratch:
        base = scratch.write(docs.select(*_measured(id_col, text_col, source_col)), "sizes")
        cuts = small(scratch.result(_thresholds(base, weights, share, scratch)))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows = docs.select(whole, *_measured(id_col, text_col, source_col)).join(cuts, F.col("source").eqNullSafe(F.col("of")))
    times = rows.select("whole", _passes().alias("times")).filter("times > 0")
    return times.select("whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("whole.*")


def oracle() -> str:
    return f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                      md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS shuffled FROM documents),
    s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s0),
    s2 AS (SELECT *, CASE rank % 3 WHEN 0 THEN {WEIGHTS[0]}.0 WHEN 1 THEN {WEIGHTS[1]}.0 ELSE {WEIGHTS[2]}.0 END::DOUBLE AS weight,
                  (2 * source_size)::DOUBLE AS most FROM s1),
    s3 AS (SELECT *, most / weight AS ratio FROM s2),
    s4 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 3 / 2
                       - coalesce(sum(most) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                     / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s3),
    l AS (SELECT arg_min(lvl, (ratio, rank)) AS lvl FROM s4 WHERE lvl <= ratio),
    t AS (SELECT source, source_size, rank, coalesce(least(most, (SELECT lvl FROM l) * weight), most) AS target FROM s4),
    r AS (SELECT d.doc_id, d.size, d.shuffled, t.source_size, t.target, t.rank, row_number() OVER () AS rowno,
                 sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.shuffled, d.size, d.doc_id) AS done
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    f AS (SELECT rowno, size, rank, shuffled, doc_id, (done + p.pass * source_size)::DOUBLE / target AS finish
          FROM r, (VALUES (0), (1)) p(pass) WHERE target > 0),
    c AS (SELECT rowno, size, sum(size) OVER (ORDER BY finish, rank, shuffled, size, doc_id) AS through FROM f),
    k AS (SELECT rowno, sum(size)::BIGINT AS taken FROM c WHERE 2 * through <= (SELECT 3 * sum(size) FROM d) GROUP BY rowno)
    SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(k.taken, 0)::BIGINT AS taken FROM r LEFT JOIN k USING (rowno)
    """
