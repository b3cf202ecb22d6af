"""Genomic intervals: strand-aware overlap joins, extents, merging, and the classification of reading frames.

Columns are ``chrom``, ``strand``, ``start_pos``, ``end_pos`` (closed). Overlaps are found by joining bins of several levels. An interval's own level is the
finest whose bins are at least as wide, so that it lies in one or two of them; it is listed there, and in one or two bins of each coarser level
that occurs in the data. Two intervals meet at the coarser one's level, in the first bin that both span: nothing has to be made distinct, and the
rows listed depend on the number of levels, not on the spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.genome import biological_start, coordinates
from strandline.sources.storage import materialize

#: Bins of level k have 2**(FINEST + 2 * k) positions; COARSEST is the last k.
FINEST, COARSEST = 9, 16
#: Most unions of intervals that every task may hold (some 10 MB).
MOST_UNIONS = 100_000
# Labels from the strongest on, biotypes, and what two labels make together.
PRIORITY = ("psORF", "uoORF", "uaoORF", "doORF", "daoORF", "iORF", "dORF", "daORF", "uORF", "uaORF", "lncRNA", "riORF", "aORF", "eORF", "udORF")
PSEUDOGENES = (
    "processed_pseudogene", "unprocessed_pseudogene", "translated_unprocessed_pseudogene", "translated_processed_pseudogene", "transcribed_processed_pseudogene",
    "transcribed_unprocessed_pseudogene", "unitary_pseudogene", "polymorphic_pseudogene",
)
AMBIGUOUS = ("non_stop_decay", "nonsense_mediated_decay", "ambiguous_orf", "protein_coding_CDS_not_defined")
NONCODING = ("lncRNA", "lincRNA", "antisense", "sense_intronic", "sense_overlapping")
TOGETHER = {
    ("uORF", "iORF"): "uoORF", ("uaORF", "iORF"): "uaoORF", ("daORF", "iORF"): "daoORF", ("dORF", "iORF"): "doORF", ("uORF", "dORF"): "udORF", ("uaORF", "dORF"): "udORF",
    ("uORF", "daORF"): "udORF", ("uaORF", "daORF"): "udORF", ("dORF", "daORF"): "dORF", ("uORF", "uaORF"): "uORF",
}


def _own_level(start: Column, end: Column) -> Column:
    """The finest level whose bins are wider than the interval's last position is from its first."""
    wide = F.shiftright(F.greatest(end - start, F.lit(0)), FINEST)
    bits = F.when(wide > 0, F.length(F.bin(wide))).otherwise(0)
    return F.least(F.floor((bits + 1) / 2), F.lit(COARSEST)).cast("int")


def _bin(position: str) -> Column:
    return F.call_function("shiftright", F.col(position), F.col("_level") * 2 + FINEST)


def _listed(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Each row once for each level from its own on, of those that occur, and each of the at most two bins there."""
    own = df.withColumn("_own", _own_level(F.col("start_pos"), F.col("end_pos")))
    by_level = own.withColumn("_level", F.explode(F.sequence("_own", F.lit(COARSEST)))).join(F.broadcast(levels), "_level", "left_semi")
    return by_level.withColumn("_bin", F.explode(F.sequence(_bin("start_pos"), F.greatest(_bin("start_pos"), _bin("end_pos")))))


def _levels(a: DataFrame, b: DataFrame) -> DataFrame:
    """The levels that occur: at most COARSEST + 1 rows."""
    level = _own_level(F.col("start_pos"), F.col("end_pos")).alias("_level")
    return a.select(level).unionByName(b.select(level)).distinct()


def overlaps(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("chrom", "strand"), levels: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """All pairs of overlapping rows, b's columns prefixed ``ref_``, with ``overlap`` in positions. Rows with a null position, or a null in ``on``, are in none.

    ``levels`` are those that occur, if they are to be found in tables that are cheaper to read than a and b. With ``how`` left, each bin of a row of a with a
    start in which it meets nothing gives a row without b, even if another of its bins gives pairs.
    """
    levels = _levels(a, b) if levels is None else levels
    keys = (*on, "_level", "_bin")
    right = _listed(b, levels)
    right = right.select(*(F.col(c).alias(f"ref_{c}") for c in right.columns))
    same = reduce(lambda x, y: x & y, (F.col(c) == F.col(f"ref_{c}") for c in keys))
    meet = (F.col("start_pos") <= F.col("ref_end_pos")) & (F.col("ref_start_pos") <= F.col("end_pos"))
    once = (F.greatest("_own", "ref__own") == F.col("_level")) & (F.greatest(_bin("start_pos"), _bin("ref_start_pos")) == F.col("_bin"))
    overlap = F.least("end_pos", "ref_end_pos") - F.greatest("start_pos", "ref_start_pos") + 1
    pairs = _listed(a, levels).join(right, same & meet & once, how)
    return pairs.drop("_level", "_bin", "_own", "ref__own", *(f"ref_{c}" for c in keys)).withColumn("overlap", overlap)


def not_overlapping(a: DataFrame, b: DataFrame, row_id: list[str]) -> DataFrame:
    """Rows of a that overlap no row of b."""
    narrow = ["chrom", "strand", "start_pos", "end_pos"]
    met = overlaps(a.select(*dict.fromkeys([*row_id, *narrow])), b.select(*narrow)).select(*row_id)
    return a.join(met, row_id, "left_anti")


def extents(coding: DataFrame, key: str) -> DataFrame:
    """Most upstream start and most downstream end of the coding rows of each key, by strand."""
    plus = F.max(F.col("strand") == "+")
    up = F.when(plus, F.min("start_pos")).otherwise(F.max("end_pos"))
    down = F.when(plus, F.max("end_pos")).otherwise(F.min("start_pos"))
    return coding.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("chrom").alias("chrom"), up.alias("upstream"), down.alias("downstream"))


def coding_starts(coding: DataFrame) -> DataFrame:
    return coding.select("chrom", biological_start(F.col("strand"), F.col("start_pos"), F.col("end_pos")).alias("bio_start")).distinct()


def _ranged(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows dealt by ranges of key and order, and stored; ``_part`` is the range."""
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    return materialize(ranged.withColumn("_part", F.spark_partition_id()), "intervals")


def _carried(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Adds the largest value of the key in the ranges before: it comes from one row for each range and key."""
    parts = rows.groupBy(F.col("_part").alias("_p"), F.col(key).alias("_k")).agg(F.max(value).alias("_m"))
    parts = parts.select("_p", "_k", F.max("_m").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias(name))
    return rows.join(parts, (rows["_part"] == parts["_p"]) & rows[key].eqNullSafe(parts["_k"])).drop("_p", "_k")


def running_max(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the largest value of the rows before in a key's order; null for its first. Rows are dealt by ranges, so that no task sees a whole key; equal places come in any order."""
    here = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = _carried(_ranged(df, key, order), key, F.col(value), "_before")
    return rows.withColumn(name, F.greatest(F.max(value).over(here), F.col("_before"))).drop("_part", "_before")


def merged(df: DataFrame, key: str = "chrom") -> DataFrame:
    """Unions of overlapping or touching intervals ``lo`` to ``hi``, by chromosome: an island begins where the running maximum ends.

    Intervals are dealt by ranges of chromosome and start, and stored. A range's running maximum, and the island that it is in, go on from the ranges
    before it; both come from one row for each range and chromosome, so that no task sees a whole chromosome.
    """
    ranged = _ranged(df.select(key, "lo", "hi"), key, ["lo", "hi"])
    here = Window.partitionBy("_part", key).orderBy("lo", "hi")
    reach = F.greatest(F.max("hi").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    begins = _carried(ranged, key, F.col("hi"), "_before").withColumn("_reach", reach)
    begins = begins.withColumn("_first", F.when(F.col("_reach").isNull() | (F.col("lo") > F.col("_reach")), F.col("lo"))).drop("_before", "_reach")
    island = F.coalesce(F.max("_first").over(here.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open"))
    islands = _carried(begins, key, F.col("_first"), "_open").withColumn("_island", island)
    return islands.groupBy(key, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def inside(points: DataFrame, position: str, ranges: DataFrame, name: str) -> DataFrame:
    """Marks the points that lie in a range of their chromosome, of any length: the farthest end of the ranges that begin up to there reaches them.

    Points and ranges are put in order together and dealt by ranges of places, as in :func:`running_max`. A null position or chromosome lies in none.
    """
    starts = ranges.select("chrom", F.col("lo").alias("_at"), F.col("hi").alias("_hi"), F.lit(0).alias("_point"))
    both = points.withColumns({"_at": F.col(position), "_point": F.lit(1)}).unionByName(starts, allowMissingColumns=True)
    reached = running_max(both, "chrom", ["_at", "_point"], "_hi", "_reach").filter("_point = 1")
    return reached.withColumn(name, F.coalesce((F.col("_reach") >= F.col("_at")) & F.col("chrom").isNotNull(), F.lit(False))).drop("_at", "_point", "_hi", "_reach")


def in_unions(points: DataFrame, position: str, unions: DataFrame, name: str, most: int = MOST_UNIONS) -> DataFrame:
    """What :func:`inside` marks, for ranges without overlaps, as :func:`merged` gives them: up to ``most`` of them are sent to the points, which stay where they are.

    A union is listed in the one or two bins of its own level, and a point looks into its bin of each level that occurs: at most one union holds it.
    """
    unions = materialize(unions.select("chrom", "lo", "hi"), "unions")
    if unions.count() > most:
        return inside(points, position, unions, name)
    unions = unions.withColumn("_level", _own_level(F.col("lo"), F.col("hi")))
    found = []
    for level in sorted(r[0] for r in unions.select("_level").dropna().distinct().collect()):  # at most COARSEST + 1
        binned = lambda c: F.shiftright(F.col(c), FINEST + 2 * level)  # noqa: B023, E731
        own = unions.filter(F.col("_level") == level).withColumn("_bin", F.explode(F.sequence(binned("lo"), binned("hi"))))
        own = own.select(F.col("chrom").alias("_chrom"), "_bin", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.lit(True).alias(f"_in{level}"))
        meets = (F.col("chrom") == F.col("_chrom")) & (binned(position) == F.col("_bin")) & F.col(position).between(F.col("_lo"), F.col("_hi"))
        points = points.join(F.broadcast(own), meets, "left").drop("_chrom", "_bin", "_lo", "_hi")  # at most ``most`` unions
        found.append(f"_in{level}")
    return points.withColumn(name, F.coalesce(*found, F.lit(False))).drop(*found)


def label(pairs: DataFrame) -> Column:
    """The label of one overlap row, from the columns that :func:`annotated_pairs` prepares."""
    c = F.col
    plus, yes = c("strand") == "+", lambda x: F.coalesce(x, F.lit(False))
    beyond_down = yes((plus & (c("orf_start") > c("downstream"))) | (~plus & (c("orf_end") < c("downstream"))))
    before_up = yes((plus & (c("orf_start") < c("upstream"))) | (~plus & (c("orf_end") > c("upstream"))))
    over_down = yes((plus & (c("orf_end") > c("downstream"))) | (~plus & (c("orf_start") < c("downstream"))))
    in_gene = yes(c("bio_start").between(F.least("upstream", "downstream"), F.greatest("upstream", "downstream")))
    read_through = ~in_gene & c("in_any_cds")
    biotype = F.coalesce(c("ref_transcript_biotype"), F.lit("Unknown"))
    ambiguous = reduce(lambda a, b: a | b, (biotype.contains(x) for x in AMBIGUOUS))
    utr = lambda confident, sure, unsure: F.when(c("shares_start"), "iORF").when(confident, sure).when(read_through, "iORF").otherwise(unsure)
    coding = F.when(c("shares_start") | c("in_any_cds"), "iORF").when(before_up, "uoORF").when(over_down, "doORF").otherwise("iORF")
    return (
        F.when(c("ref_feature") == "three_prime_utr", utr(beyond_down, "dORF", "daORF")).when(c("ref_feature") == "five_prime_utr", utr(before_up, "uORF", "uaORF"))
        .when(c("ref_feature") == "CDS", coding).when(c("ref_feature") == "retrotransposed", "psORF").when(biotype.isin(*PSEUDOGENES), "psORF").when(ambiguous, "aORF")
        .when(biotype.contains("retained_intron"), "riORF").when(c("ref_gene_biotype").isin(*NONCODING), "lncRNA").when(c("ref_feature") == "exon", "eORF").otherwise("UA")
    )


def _labelled(orfs: DataFrame, reference: DataFrame, how: str = "inner") -> DataFrame:
    """All overlap rows (of :func:`overlaps`, ``how`` as there) with ``annotation``, ``gene_name`` and ``gene_id``. What depends on the ORF row alone is found before the join.

    Genes are stored, so that Spark knows how few they are and need not shuffle the overlap rows to them.
    """
    coding = reference.filter((F.col("feature") == "CDS") & F.col("transcript_id").isNotNull())
    genes = extents(coding, "gene_id").select(F.col("gene_id").alias("_gene"), F.col("chrom").alias("_chrom"), "upstream", "downstream")
    genes = materialize(genes, "genes")
    spans = merged(genes.select(F.col("_chrom").alias("chrom"), F.least("upstream", "downstream").alias("lo"), F.greatest("upstream", "downstream").alias("hi")))
    starts = coding_starts(coding).select(F.col("chrom").alias("_chrom"), F.col("bio_start").alias("_start"), F.lit(True).alias("_shared"))
    at = coordinates(F.col("id"))
    rows = orfs.withColumns({"orf_start": F.coalesce(at["start"], "start_pos"), "orf_end": F.coalesce(at["end"], "end_pos")})
    rows = rows.withColumn("bio_start", biological_start(F.col("strand"), F.col("orf_start"), F.col("orf_end")))
    rows = rows.join(starts, (rows["chrom"] == starts["_chrom"]) & (rows["bio_start"] == starts["_start"]), "left").drop("_chrom", "_start")
    rows = in_unions(rows.withColumn("shares_start", F.coalesce("_shared", F.lit(False))).drop("_shared"), "bio_start", spans, "in_any_cds")
    pairs = overlaps(rows, reference, levels=_levels(orfs, reference), how=how)
    pairs = pairs.join(genes.drop("_chrom"), pairs["ref_gene_id"] == genes["_gene"], "left").drop("_gene")
    named = F.coalesce("ref_gene_name", F.lit("Unnamed"))
    return pairs.withColumnsRenamed({"ref_ref_pos": "ref_pos"}).withColumns({"annotation": label(pairs), "gene_name": named, "gene_id": F.coalesce("ref_gene_id", F.lit("Unknown"))})


def annotated_pairs(orfs: DataFrame, reference: DataFrame) -> DataFrame:
    """Overlap rows of coding ORF rows with their label: ``id``, ``pos``, ``ref_pos``, ``annotation``, ``gene_name``, ``gene_id``."""
    return _labelled(orfs.filter(F.col("feature") == "CDS"), reference).select("id", "pos", "ref_pos", "annotation", "gene_name", "gene_id")


def _rank(annotation: Column) -> Column:
    place = F.array_position(F.lit(list(PRIORITY)), annotation)
    return F.when(place > 0, place).otherwise(len(PRIORITY) + 1)


def _folded(rows: Column) -> Column:
    """One label of an id's sorted rows: they are folded from the first on, two labels at a time."""
    item = lambda r, a=None: F.struct((r["annotation"] if a is None else a).alias("annotation"), r["gene_name"].alias("gene_name"), r["gene_id"].alias("gene_id"))

    def fold(state: Column, row: Column) -> Column:
        one, two = state["annotation"], row["annotation"]
        out = F.when(F.lit(False), state)
        for (a, b), c in TOGETHER.items():
            out = out.when(((one == a) & (two == b)) | ((one == b) & (two == a)), item(row, F.lit(c)))
        return out.when(_rank(two) < _rank(one), item(row)).otherwise(state)

    return F.aggregate(F.slice(rows, F.lit(2), F.size(rows)), item(F.get(rows, F.lit(0))), fold)


_ROW = ("pos", "ref_pos", "annotation", "gene_name", "gene_id")


def resolved(pairs: DataFrame) -> DataFrame:
    """One label for each id: its rows are folded in the order of the input, two labels at a time. An id has few rows."""
    rows = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*_ROW))).alias("_rows"))
    return rows.select("id", F.explode(F.array(_folded(F.col("_rows")))).alias("r")).select("id", "r.annotation", "r.gene_name", "r.gene_id")


def classified(orfs: DataFrame, reference: DataFrame, row_id: list[str]) -> DataFrame:
    """The classification of all ids: overlapping ones by their rows, the others ``intergenic``. Ids that overlap with other than coding rows only are left out.

    Both come from one overlap join: a row overlaps nothing if it only has rows without a partner there. Which row of an id that is matters only to ids
    without coding pairs, so that the others' pairs go without the row's key.
    """
    key = F.struct(*(c for c in row_id if c != "id"))
    pairs = _labelled(orfs, reference.withColumn("_met", F.lit(True)), "left")
    met = F.coalesce("ref__met", F.lit(False))
    row = F.when(met & (F.col("feature") == "CDS"), F.struct(*_ROW)).alias("_row")
    both = pairs.select("id", F.when(~met, key).alias("_none"), row, F.when(met, key).alias("_some"))
    both = both.withColumn("_some", F.when(F.col("_row").isNull(), F.col("_some")))
    placeless = orfs.filter(F.col("start_pos").isNull()).select("id", key.alias("_none"))  # has no bin
    ids = both.unionByName(placeless, allowMissingColumns=True).groupBy("id").agg(F.array_sort(F.collect_list("_row")).alias("_rows"), F.array_except(F.collect_set("_none"), F.collect_set("_some")).alias("_alone"))
    none = F.struct(F.lit("intergenic").alias("annotation"), F.lit("None").alias("gene_name"), F.lit("None").alias("gene_id"))
    one = F.when(F.size("_rows") > 0, _folded(F.col("_rows"))).when(F.size("_alone") > 0, none)
    return ids.select("id", F.explode(F.array(one)).alias("r")).filter("r IS NOT NULL").select("id", "r.annotation", "r.gene_name", "r.gene_id")


def profile(points: DataFrame, bins: int, symmetric_about: Column | None = None) -> DataFrame:
    """Mean intensity in equal bins along each item's axis: ``item``, ``bin``, ``mean``; points have ``item``, ``along``, ``intensity``.

    The last bin is closed; with a centre, bins are symmetric about it. An empty bin takes the nearest filled one, the one after it first. Items that span
    less than 1 have no profile. The range of an item comes from an aggregation that is joined back.
    """
    moved = points.withColumn("_x", F.col("along") - (symmetric_about if symmetric_about is not None else F.lit(0.0)))
    spans = moved.groupBy("item").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).filter(F.col("_hi") - F.col("_lo") >= 1)
    if symmetric_about is not None:
        reach = F.greatest(F.abs("_lo"), F.abs("_hi"))
        spans = spans.select("item", (-reach).alias("_lo"), reach.alias("_hi"))
    at = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    means = moved.join(spans, "item").groupBy("item", at.alias("bin")).agg(F.avg("intensity").alias("mean"))
    grid = spans.select("item", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(means, ["item", "bin"], "left")
    by = Window.partitionBy("item").orderBy("bin")
    after, before = by.rowsBetween(0, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("mean").isNotNull(), F.struct("bin", "mean"))
    grid = grid.withColumns({"_next": F.first(seen, ignorenulls=True).over(after), "_last": F.last(seen, ignorenulls=True).over(before)})
    nearer = F.coalesce(F.col("_next")["bin"] - F.col("bin") <= F.col("bin") - F.col("_last")["bin"], F.col("_next").isNotNull())
    return grid.select("item", "bin", F.when(nearer, F.col("_next")["mean"]).otherwise(F.col("_last")["mean"]).alias("mean"))


def best_overlap(shared: DataFrame, areas: DataFrame, least: float, most: float) -> DataFrame:
    """For each cell the nucleus with most shared pixels (the smaller id of equals), if its share of the cell's area is within bounds."""
    counts = shared.groupBy("cell", "nucleus").agg(F.count("*").alias("_n"))
    best = counts.groupBy("cell").agg(F.max_by("nucleus", F.struct("_n", -F.col("nucleus"))).alias("nucleus"))
    out = best.join(areas.select(F.col("id").alias("nucleus"), F.col("nucleus_area")), "nucleus").join(areas.select(F.col("id").alias("cell"), F.col("cell_area")), "cell")
    return out.withColumn("share", F.col("nucleus_area") / F.col("cell_area")).filter(F.col("share").between(least, most)).select("cell", "nucleus", "share")


def central(items: DataFrame) -> DataFrame:
    """Of each image the item of least distance over the largest distance less half its area over the largest area; the smaller id of equals."""
    by = Window.partitionBy("image")
    over = lambda c: F.col(c) / F.when(F.max(c).over(by) == 0, 1.0).otherwise(F.max(c).over(by))
    scored = items.withColumn("_score", over("distance") - 0.5 * over("area"))
    return scored.groupBy("image").agg(F.min_by("item", F.struct("_score", "item")).alias("item"))


def mask_ratios(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean intensity inside the nucleus and the whole cell, and their ratio."""
    nuclear, whole = F.avg(F.when(F.col("is_nucleus"), F.col("intensity"))), F.avg("intensity")
    return pixels.groupBy(*keys).agg(nuclear.alias("nuclear"), whole.alias("cell_mean"), F.when(whole > 0, nuclear / whole).alias("ratio"))
