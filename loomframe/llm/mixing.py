"""Mixing sources to target weights by Pareto order sampling (Rosén, "On sampling with probability proportional to size", 1997).

Each source gets a target number of words. Within a source, documents have unequal inclusion odds, in proportion to a
measure of each (its affinity). A document whose expected copies are e gives floor(e) certain whole copies; the rest of
the target is a sample without replacement: documents are ranked by their random odds divided by their inclusion odds,
and the lowest ranks are taken until the rest is filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stash import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Random numbers have 52 bits; the ranks of a source are summed in so many buckets, and only one of them is sorted.
BITS, BUCKETS = 52, 1 << 14
#: Largest affinity; a source has at most so many sums, one for each.
AFFINITY = 1024
#: The affinity of the numbered query: the binary digits of a document's size, so that 1000 words are twice as likely as 31.
DIGITS = "length(bin(size))"


def _draw(key: str, text: str, seed: int) -> Column:
    """A 52-bit number from the key and the text alone, so that reruns agree and rows with one key differ."""
    of = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(of), 1, 13), 16, 10).cast("long")


def _targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sizes: (source, source_size), one row for each source. Adds target: shares by weight, held at ``most`` times the size.

    Sources are names of a catalogue; all of them pass one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = sizes.withColumn("w", w.cast("long"))
    # Sources reach their ceiling in the order of ceiling / weight; those before the first that stays below are held.
    by_room = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumns({
        "total": F.sum("source_size").over(everything),
        "held": F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0)),
        "open": F.sum("w").over(onward),
    })
    # (total - held) / open is the words a unit of weight gets if all sources from here on stay below their ceilings
    fits = (F.col("total") - F.col("held")) * F.col("w") <= most * F.col("source_size") * F.col("open")
    t = t.withColumn("fits", fits)
    t = t.withColumns({
        "held": F.min(F.when(F.col("fits"), F.col("held"))).over(everything),
        "open": F.max(F.when(F.col("fits"), F.col("open"))).over(everything),
    })
    share = (F.col("total") - F.col("held")).cast("double") * F.col("w") / F.col("open")
    cap = (most * F.col("source_size")).cast("double")
    return t.select("source", "source_size", F.when(F.col("fits"), share).otherwise(cap).alias("target"))


def _scales(levels: DataFrame, most: int) -> DataFrame:
    """levels: (s, target, liking, words), one row for each source and affinity. Adds scale, by source: expected copies
    are min(``most``, scale * liking), with the scale at which they add up to the target. Zero without affinity."""
    # The higher an affinity, the sooner it reaches the ceiling; those above the first that stays below are held there.
    down = Window.partitionBy("s").orderBy(F.col("liking").desc())
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    onward = down.rowsBetween(0, Window.unboundedFollowing)
    t = levels.where("liking > 0 and words > 0").withColumns({
        "held": F.coalesce(F.sum("words").over(above), F.lit(0)) * most,
        "mass": F.sum(F.col("words") * F.col("liking")).over(onward),
    })
    t = t.withColumn("scale", (F.col("target") - F.col("held")) / F.col("mass").cast("double"))
    fits = F.col("scale") * F.col("liking") <= most
    found = t.groupBy("s").agg(F.max(F.when(fits, F.struct("liking", "scale")))["scale"].alias("scale"))
    # no level fits only where all are held at the ceiling
    return found.select(F.col("s").alias("ss"), F.coalesce("scale", F.lit(float(most))).alias("scale"))


def pareto_mixture(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", affinity: str | None = None,
    weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 1,
) -> DataFrame:
    """How many words of each document a mixture of the sources takes.

    The size of a document is its number of words (runs of characters other than space and TAB..CR). Sources in code
    point order, null last, have the ``weights`` in turn and share the size of the table; a target stops at ``most``
    times its source's size, and the excess is shared by weight among the others until none is above. Within a source a
    document's expected copies are in proportion to its ``affinity``, ``most`` at the utmost: an SQL expression over the
    columns of ``docs`` and ``size`` that gives whole numbers from 0 to AFFINITY (null and less count as 0, more as
    AFFINITY); without it all are equal. A document is taken as many whole times for certain, and once more with the odds
    of the fraction: of the documents in the order of random odds / inclusion odds, the first are taken until the source
    is nearest to its target. One document is then added or taken out if that brings it nearer.

    Returns one row for each row of ``docs``: (``key``, size, source_size, target, taken), taken in words with repeats.

    Defined cases: null and wordless texts have size 0 and nothing is taken of them; null is a source of its own; a
    source without words has target 0; documents draw by key and text, so null keys and a key on several texts differ;
    rows that repeat draw the same number, are ranked next to each other and are taken singly; other ties are broken by
    key, size and a hash of the text; very long texts are counted whole; an empty table gives an empty result; other
    columns of ``docs``, whatever their names, are looked at by ``affinity`` alone.
    """
    scratch = Scratch(docs.sparkSession, "mixture")
    counted = docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
    liking = F.lit(1).cast("long") if affinity is None else F.least(F.greatest(F.coalesce(F.expr(affinity).cast("long"), F.lit(0)), F.lit(0)), F.lit(AFFINITY)).cast("long")
    rows = scratch.put(
        counted.select(
            F.col(key).alias("id"),
            F.col(source).alias("source"),
            "size",
            _draw(key, text, seed).alias("x"),
            F.xxhash64(text).alias("h"),
            liking.alias("liking"),
        ).withColumn("r", F.monotonically_increasing_id()),  # tells rows that repeat apart, and decides nothing else
        "sizes",
    )
    levels = scratch.put(rows.groupBy("source", "liking").agg(F.sum("size").alias("words")), "levels")
    plan = _targets(levels.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most).withColumnRenamed("source", "s")
    scales = _scales(levels.join(plan, F.expr("s <=> source")), most)
    # Sources are names of a catalogue: as few rows as sources, broadcast by Spark itself where they are small.
    plan = scratch.put(plan.join(scales, F.expr("s <=> ss"), "left").drop("ss").fillna(0.0, ["scale"]), "targets")

    expected = F.least(F.col("scale") * F.col("liking"), F.lit(float(most)))
    ranked = rows.join(plan, F.expr("source <=> s")).withColumn("expected", expected)
    ranked = ranked.withColumn("copies", F.floor("expected").cast("long"))
    odds = "((x + 0.5D) / {0}D) / (1D - (x + 0.5D) / {0}D)".format(1 << BITS)
    ranked = ranked.withColumn("part", F.col("expected") - F.col("copies")).withColumn(
        "rank", F.expr(f"case when part > 0 then ({odds}) / (part / (1D - part)) end")
    )
    # the rank's place on a scale of 52 bits; its leading bits are the bucket
    ranked = ranked.withColumn("place", F.floor(F.col("rank") / (1 + F.col("rank")) * (1 << BITS)).cast("long"))
    ranked = ranked.withColumn("b", F.shiftright("place", BITS - BUCKETS.bit_length() + 1))
    sums = scratch.put(
        ranked.groupBy("s", "b").agg(
            F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)).alias("size"),
            F.sum(F.col("size") * F.col("copies")).alias("certain"), F.first("target").alias("target"),
        ),
        "rank-sums",
    )
    rest = sums.groupBy("s").agg((F.first("target") - F.sum("certain")).alias("rest")).withColumnRenamed("s", "rs")

    by_rank = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        sums.where("b is not null")
        .withColumn("before", F.coalesce(F.sum("size").over(by_rank), F.lit(0)))
        .join(rest, F.expr("s <=> rs"))
        .where("before < rest and rest <= before + size")
        .select(F.col("s").alias("cs"), F.col("b").alias("cb"), F.col("before").alias("base"))
    )
    cuts = scratch.put(rest.join(cut, F.expr("rs <=> cs"), "left").drop("cs"), "cuts")
    marked = ranked.join(cuts, F.expr("s <=> rs")).drop("rs", "liking", "scale", "expected", "part", "rank")
    inside = Window.partitionBy("source").orderBy("place", "x", "id", "size", "h", "r").rowsBetween(Window.unboundedPreceding, -1)
    edge = marked.where("b = cb").withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("more", F.expr("2 * before + size < 2 * rest"))
    # a source whose sample is all of its ranked documents has no cut
    clear = marked.where("b is null or cb is null or b <> cb").withColumns({
        "before": F.lit(None).cast("long"), "more": F.expr("b is not null and rest > 0 and (cb is null or b < cb)"),
    })
    drawn = scratch.put(clear.union(edge.select(*clear.columns)), "drawn")

    # One document closes the gap that is left, if there is one of a better size.
    gap = drawn.groupBy("s").agg(
        (F.first("rest") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("gap")
    ).withColumnRenamed("s", "gs")
    near = drawn.where("size > 0 and rest > 0 and b is not null").join(gap, F.expr("s <=> gs")).where("(gap > 0) = (not more)")
    near = near.withColumn("off", F.abs(F.col("size") - F.abs("gap"))).where("off < abs(gap)")
    near = near.groupBy("s").agg(F.min(F.struct("off", "x", "id", "h", "r")).alias("near"))
    near = near.select(F.col("s").alias("ns"), F.col("near.r").alias("nr"))
    last = drawn.join(near, F.expr("s <=> ns"), "left")
    change = F.expr("nr is not null and r = nr")
    return last.select(
        F.col("id").alias(key),
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("copies") + (F.col("more") != change).cast("long"))).alias("taken"),
    )


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS x
  FROM documents),
k AS (SELECT *, CAST(length(bin(size)) AS BIGINT) AS liking FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM s),
h AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
             CAST(coalesce(sum(3 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS held,
             CAST(sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
      FROM w WINDOW r AS (ORDER BY source_size / w, source NULLS LAST)),
f AS (SELECT *, (total - held) * w <= 3 * source_size * open AS fits FROM h),
t AS (SELECT source, source_size,
             CASE WHEN fits THEN CAST(total - min(held) FILTER (fits) OVER () AS DOUBLE) * w / max(open) FILTER (fits) OVER ()
                  ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM f),
l AS (SELECT k.source AS ls, liking, CAST(sum(size) AS BIGINT) AS words FROM k GROUP BY 1, 2 HAVING sum(size) > 0),
a AS (SELECT ls, liking, target, CAST(coalesce(sum(words) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * 3 AS up,
             CAST(sum(words * liking) OVER (v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS mass
      FROM l JOIN t ON ls IS NOT DISTINCT FROM t.source WINDOW v AS (PARTITION BY ls ORDER BY liking DESC)),
b AS (SELECT *, (target - CAST(up AS DOUBLE)) / CAST(mass AS DOUBLE) AS scale FROM a),
z AS (SELECT ls, coalesce(arg_max(scale, liking) FILTER (scale * liking <= 3), 3.0::DOUBLE) AS scale FROM b GROUP BY ls),
e AS (SELECT k.*, source_size, target, least(coalesce(scale, 0) * liking, 3) AS expected
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source LEFT JOIN z ON k.source IS NOT DISTINCT FROM ls),
p AS (SELECT *, CAST(floor(expected) AS BIGINT) AS copies, expected - floor(expected) AS part, (x + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM e),
q AS (SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS rank,
             target - sum(size * copies) OVER (PARTITION BY source) AS rest FROM p),
o AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY floor(rank / (1 + rank) * 4503599627370496), x, doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM q),
m AS (SELECT *, rank IS NOT NULL AND rest > 0 AND 2 * before + size < 2 * rest AS more FROM o),
g AS (SELECT *, rest - sum(CASE WHEN more THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM m),
n AS (SELECT *, size > 0 AND rest > 0 AND rank IS NOT NULL AND (gap > 0) = (NOT more) AND abs(size - abs(gap)) < abs(gap) AS able FROM g),
c AS (SELECT *, able AND row_number() OVER (PARTITION BY source, able ORDER BY abs(size - abs(gap)), x, doc_id) = 1 AS change FROM n)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CAST(more <> change AS BIGINT)) AS BIGINT) AS taken FROM c
"""
