"""Peptide and spectrum matches: counts, candidates, scoring, and lookups along lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import spectra as sp
from strandline.functions.lists import decode_list
from strandline.functions.predicates import pinned
from strandline.operators.ranks import medians, null_safe
from strandline.sources.storage import materialize

# Purity that a candidate needs, candidates for each peptide, order of qualities.
LEAST_PURITY, CANDIDATES = 0.5, 5
#: Characters of a run by which ids are searched for, and most ids that every task may hold (some 10 MB).
GRAM, MOST_IDS = 4, 50_000
#: Most ids that are searched for by one pattern, whose cost grows with their number.
MOST_ALTERNATIVES = 256
QUALITIES = ("Strong", "Moderate", "Weak", "Insufficient")


def listed_peptides(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each peptide of a list written as text; blanks and ``nan`` are none."""
    one = F.trim(F.col("peptide"))
    return df.select(key, F.explode(decode_list(F.col(text))).alias("peptide")).select(key, one.alias("peptide")).filter((F.col("peptide") != "") & (F.lower("peptide") != "nan"))


def protein_rollup(df: DataFrame, protein: str, counts: list[str], others: str) -> DataFrame:
    """Summed counts and the different companions of each protein, sorted and joined; a blank one is ``BLANK``."""
    named = F.coalesce(F.nullif(F.col(others), F.lit("")), F.lit("BLANK"))
    return df.groupBy(protein).agg(*(F.sum(c).alias(c) for c in counts), F.array_join(F.sort_array(F.collect_set(named)), ";").alias(others))


def spectral_counts(df: DataFrame) -> DataFrame:
    """Count of each peptide over all batches; ``is_one_hit`` if it is one."""
    return df.groupBy("peptide").agg(F.sum("spectral_count").alias("global_count")).withColumn("is_one_hit", F.col("global_count") == 1)


def candidates(df: DataFrame, tie: str, most: int = CANDIDATES, least_purity: float = LEAST_PURITY) -> DataFrame:
    """Up to ``most`` spectra of each peptide by score, with ``candidate_rank`` and ``acetyl_rescued``.

    Spectra without an acetylated N-terminus are preferred where there are any, then pure ones (else the best alone); all share the
    charge and modified form of the best. One shuffle by peptide serves all windows.
    """
    by = Window.partitionBy("peptide")
    acetyl = F.coalesce(F.col("modified_peptide").rlike(r"^n\[43\]"), F.lit(False))
    rows = df.withColumn("_acetyl", acetyl).withColumns({"_any_plain": F.max(~F.col("_acetyl")).over(by), "_any_acetyl": F.max("_acetyl").over(by)})
    rows = rows.filter(~F.col("_any_plain") | ~F.col("_acetyl")).withColumn("_pure", F.coalesce(F.col("purity") >= least_purity, F.lit(False)))
    score = [F.col("hyperscore").desc_nulls_last(), F.col(tie)]
    rows = rows.withColumns({"_any_pure": F.max("_pure").over(by), "_place": F.row_number().over(by.orderBy(*score))})
    rows = rows.filter(F.when(F.col("_any_pure"), F.col("_pure")).otherwise(F.col("_place") == 1))
    ordered = by.orderBy(*score)
    rows = rows.withColumns({"_charge": F.first("charge").over(ordered), "_form": F.first("modified_peptide").over(ordered)})
    same = rows.filter((F.col("charge") == F.col("_charge")) & (F.col("modified_peptide") == F.col("_form")))
    out = same.withColumn("candidate_rank", F.row_number().over(ordered)).filter(F.col("candidate_rank") <= most)
    return out.withColumn("acetyl_rescued", F.col("_any_plain") & F.col("_any_acetyl")).select(*df.columns, "candidate_rank", "acetyl_rescued")


def primary(found: DataFrame) -> DataFrame:
    """The first candidate of each peptide unless it is acetylated."""
    return found.filter((F.col("candidate_rank") == 1) & ~F.coalesce(F.col("modified_peptide").rlike(r"^n\[43\]"), F.lit(False)))


def round_of(batch: Column) -> Column:
    return F.when(batch.startswith("round2/"), 2).otherwise(1)


def scored(df: DataFrame, ppm: float = 20.0) -> DataFrame:
    """Adds to rows of ``predicted``, ``observed``, ``charge`` and ``length``: ``matches``, ``degrees``, ``normalised``, ``n_matched``, ``n_predicted``, ``n_cleavages``, ``n_sites``."""
    kept = pinned(df, {"predicted": sp.possible_fragments(F.col("predicted"), F.col("charge")), "observed": sp.without_reporters(F.col("observed"))})
    found = pinned(kept, {"matches": sp.matched(F.col("predicted"), F.col("observed"), ppm)})
    out = found.withColumns(
        {
            "degrees": sp.angle(F.col("matches")), "n_matched": F.size("matches"), "n_predicted": F.size("predicted"),
            "n_cleavages": sp.cleavages(F.col("matches"), F.col("length")), "n_sites": sp.cleavage_sites(F.col("length")),
        }
    )
    return out.withColumn("normalised", sp.normalised(F.col("degrees")))


def best_candidate(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Of each key the candidate with most cleavage sites, then the smallest angle, then most matches; the first wins ties."""
    w = Window.partitionBy(key).orderBy(F.desc("n_cleavages"), F.asc("degrees"), F.desc("n_matched"), tie)
    return df.withColumns({"_rank": F.row_number().over(w), "candidates_evaluated": F.count("*").over(Window.partitionBy(key))}).filter("_rank = 1").drop("_rank")


def rated(df: DataFrame) -> DataFrame:
    percent = sp.coverage_percent(F.col("n_cleavages"), F.col("n_sites"))
    out = df.withColumns({"sa_rating": sp.angle_rating(F.col("degrees")), "coverage_percent": percent})
    out = out.withColumn("match_coverage", sp.coverage_rating(F.col("coverage_percent")))
    return out.withColumn("confidence", sp.tier(F.col("sa_rating"), F.col("match_coverage")))


def score_report(df: DataFrame, facets: list[str]) -> DataFrame:
    """Count, share and mean and median angle of all rows and of each value of each facet: grouping sets in one pass, medians by ranges."""
    exploded = df.select("degrees", F.explode(F.array(F.struct(F.lit("all").alias("facet"), F.lit("").alias("value")), *(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets))).alias("g"))
    # what the figures are made of: different angles of each value, counted; the rows are read once
    counted = materialize(exploded.groupBy("g.facet", "g.value", "degrees").agg(F.count("*").alias("_rows")), "angles")
    sums = counted.groupBy("facet", "value").agg(F.sum("_rows").alias("n"), (F.sum(F.col("degrees") * F.col("_rows")) / F.sum(F.when(F.col("degrees").isNotNull(), F.col("_rows")))).alias("mean_degrees"))
    out = null_safe(sums, medians(counted, ["facet", "value"], "degrees", "median_degrees", "_rows"), ["facet", "value"], "left")
    total = sums.filter("facet = 'all'").agg(F.max("n").alias("_total"))
    return out.join(F.broadcast(total)).withColumn("percent", 100 * F.col("n") / F.col("_total")).drop("_total")  # one row


def along_list(df: DataFrame, key: str, text: str, metrics: DataFrame, names: list[str], by: str = "peptide") -> DataFrame:
    """For each list its elements' metrics as lists of the same length, null where there is none."""
    items = df.select(key, F.posexplode_outer(decode_list(F.col(text))).alias("_at", "_item")).withColumn("_item", F.trim("_item"))
    found = items.join(metrics.select(F.col(by).alias("_item"), *names), "_item", "left")
    row = F.struct("_at", *names)
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), row))).alias("_rows"))
    return lists.select(key, *(F.transform("_rows", lambda r: r[n]).alias(n) for n in names))


def _placed(df: DataFrame, text: str, lengths: DataFrame, name: str) -> DataFrame:
    """Every substring of the text that has the length of some id: its place (from 1) and the substring. As many rows as places and lengths."""
    listed = lengths.agg(F.sort_array(F.collect_set("n")).alias("_lengths"))  # one row of the ids' different lengths
    cut = df.join(F.broadcast(listed)).withColumn("_n", F.explode("_lengths")).filter(F.length(text) >= F.col("_n"))
    cut = cut.withColumn("at", F.explode(F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1)))
    return cut.withColumn(name, F.substring(F.col(text), F.col("at"), F.col("_n"))).drop("_lengths", "_n")


def _numbered(df: DataFrame, text: str) -> DataFrame:
    """Each different text once with a number; stored, so that the numbers stay."""
    texts = df.select(F.col(text).alias("_text")).dropna().distinct()
    return materialize(texts.withColumn("_number", F.monotonically_increasing_id()), "texts")


def _grams(df: DataFrame, text: str) -> DataFrame:
    """``_place`` (from 1) and ``_gram`` of every run of GRAM characters of a text."""
    places = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1))
    return df.withColumn("_place", F.explode(places)).withColumn("_gram", F.substring(F.col(text), F.col("_place"), F.lit(GRAM)))


def found_at(texts: DataFrame, wanted: DataFrame, anything: str | None = None, most: int = MOST_IDS) -> DataFrame:
    """The texts' columns, ``at`` (from 1) and ``_want`` wherever a wanted id occurs in a text ``_text``; the character ``anything`` in an id stands for any one.

    An inverted index holds each id under the one of its runs of GRAM characters that is rarest in the texts; the texts' runs are joined with it, and the ids that
    begin where they should are compared. An id one of whose runs is in no text is dropped at once. Up to ``most`` ids are sent to the texts, which stay where
    they are; with more of them, as many rows are shuffled as the texts have places, whatever the ids' number and lengths, and the texts need a ``_number``.
    Ids without a run (short ones, or ``anything`` in all of them) have no rows here.
    """
    runs = _grams(wanted.select("_want"), "_want")
    runs = runs.filter(~F.col("_gram").contains(anything)) if anything else runs
    places = _grams(texts, "_text")
    counts = places.select("_gram").join(runs.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    known = runs.join(counts, "_gram", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = known.groupBy("_want").agg(F.min(F.struct("_n", "_gram", "_place")).alias("_run")).filter("_run._n > 0")
    rarest = materialize(rarest.select("_want", F.col("_run._gram").alias("_gram"), F.col("_run._place").alias("_begin")), "runs")
    at = (F.col("_place") - F.col("_begin") + 1).alias("at")
    if rarest.count() <= most:
        near = places.join(F.broadcast(rarest), "_gram").select(*texts.columns, "_want", at).filter("at > 0")  # at most ``most`` rows
    else:
        near = places.select("_number", "_place", "_gram").join(rarest, "_gram").select("_number", "_want", at).filter("at > 0").join(texts, "_number")
    piece = F.substring(F.col("_text"), F.col("at"), F.length("_want"))
    same = piece == F.col("_want")
    if anything:
        same = same | ((F.length(piece) == F.length("_want")) & F.forall(F.arrays_zip(F.split(piece, "").alias("a"), F.split("_want", "").alias("b")), lambda c: (c["b"] == anything) | (c["a"] == c["b"])))
    return near.filter(same).select(*texts.columns, "at", "_want")


def _alternation(ids: list[str]) -> str:
    """A pattern of literal ids, the first of which that begins at a place counts; of none, one that is nowhere."""
    return "|".join(re.sub(r"([\x00-/:-@\[-`{-\x7f])", r"\\\1", i) for i in ids) or "(?!)"


def mentioned(df: DataFrame, text: str, ids: DataFrame, keep: list[str], alternatives: int = MOST_ALTERNATIVES, most: int = MOST_IDS) -> DataFrame:
    """A row for each different id that is found in a text when it is searched from the left for any of the ids, without overlaps.

    At a place where several ids begin, the first of them in ``ids``' order counts: column ``place`` if there is one, else the id itself. Up to ``alternatives``
    ids are one pattern, and nothing is shuffled. With more, each different text is searched once (:func:`found_at`; ids too short for it are joined with the texts' substrings of their at most GRAM - 1 lengths), and
    the places found are walked from the left. Ids are stored. With up to ``most`` of them, different texts are shuffled once and searched where they are.
    """
    order = F.min("place") if "place" in ids.columns else F.min("gene_id")
    wanted = materialize(ids.filter(F.length("gene_id") > 0).groupBy(F.col("gene_id").alias("_want")).agg(order.alias("_order")), "ids")
    first = [r[0] for r in wanted.orderBy(F.col("_order").asc_nulls_last(), "_want").select("_want").limit(alternatives + 1).collect()]
    if len(first) <= alternatives:
        return df.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(_alternation(first)), F.lit(0)))).alias("gene_id"))
    few = wanted.count() <= most
    texts = df.select(F.col(text).alias("_text")).dropna().distinct() if few else _numbered(df, text)
    short = wanted.filter(F.length("_want") < GRAM)
    listed = short.select("_want")
    apart = _placed(texts, "_text", short.select(F.length("_want").alias("n")), "_want").join(F.broadcast(listed) if few else listed, "_want").select(*texts.columns, "at", "_want")
    hits = found_at(texts, wanted, most=most)
    hits = hits.unionByName(apart) if not few or not short.isEmpty() else hits
    hits = hits.join(F.broadcast(wanted) if few else wanted, "_want")  # at most ``most`` rows
    key = "_text" if few else "_number"
    # of ids that begin at one place the first one comes first, and the others begin before it ends
    lists = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "_order", F.col("_want").alias("id")))).alias("_hits"))
    start = F.struct(F.lit(1).alias("free"), F.array().cast("array<string>").alias("ids"))
    taken = F.aggregate("_hits", start, lambda s, h: F.when(h["at"] >= s["free"], F.struct((h["at"] + F.length(h["id"])).alias("free"), F.array_union(s["ids"], F.array(h["id"])).alias("ids"))).otherwise(s))
    found = lists.select(key, F.explode(taken["ids"]).alias("gene_id"))
    found = found if few else found.join(texts, "_number").drop("_number")
    return df.join(found, F.col(text) == F.col("_text")).select(*keep, "gene_id")


def assets_of(df: DataFrame, key: str, text: str, assets: DataFrame) -> DataFrame:
    """Best quality among a list's peptides, the number ``n`` of all their assets, and the ``peptides`` that have them; ``No PSM`` without a list, ``Insufficient`` without assets.

    A peptide's assets are rows of ``assets`` and stay there: lists are joined with one row for each peptide, so that common peptides' paths are not
    repeated for each list. A peptide that is listed twice counts twice.
    """
    order = F.array_position(F.lit(list(QUALITIES)), F.col("quality"))
    known = assets.groupBy(F.col("peptide").alias("_item")).agg(F.min(order).alias("_rank"), F.count("*").alias("_n"))
    items = df.select(key, F.explode(decode_list(F.col(text))).alias("_item")).withColumn("_item", F.trim("_item"))
    found = items.join(known, "_item").groupBy(key).agg(F.min("_rank").alias("_rank"), F.sum("_n").alias("_n"), F.sort_array(F.collect_list("_item")).alias("_items"))
    out = df.select(key, text).join(found, key, "left")
    best = F.when(F.col(text).isNull() | (F.col(text) == ""), "No PSM").when(F.col("_rank").isNull(), "Insufficient").otherwise(F.get(F.lit(list(QUALITIES)), (F.col("_rank") - 1).cast("int")))
    return out.select(key, best.alias("quality"), F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_items", F.array().cast("array<string>")).alias("peptides"))


def stratified(df: DataFrame, strata: list[tuple[Column, int]], order: list, key: str, most: int) -> DataFrame:
    """The first n rows of each stratum, each key once (in the first stratum that has it), and no more than ``most`` in all."""
    parts = []
    for i, (mask, n) in enumerate(strata):
        parts.append(df.filter(mask).orderBy(*order).limit(n).withColumns({"_stratum": F.lit(i), "_place": F.row_number().over(Window.orderBy(*order))}))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_stratum", "_place"))).filter("_n = 1")
    return first.orderBy("_stratum", "_place").limit(most).drop("_n", "_place", "_stratum")


def longest_prefix(df: DataFrame, name: str, prefixes: DataFrame, to: str = "grp") -> DataFrame:
    """The longest prefix that a name begins with, in any case; else the name itself in lower case. Prefixes are joined by their length."""
    lower = F.lower(name)
    lengths = prefixes.select(F.length("prefix").alias("_n")).distinct()
    cut = df.select(name).distinct().join(F.broadcast(lengths)).withColumn("_head", F.substring(lower, F.lit(1), F.col("_n")))  # as many rows as prefix lengths
    found = cut.join(prefixes.select(F.lower("prefix").alias("_head"), "prefix"), "_head").groupBy(name).agg(F.max_by("prefix", F.length("prefix")).alias("_prefix"))
    return df.join(found, name, "left").withColumn(to, F.coalesce("_prefix", lower)).drop("_prefix")


def tolerant_ids(df: DataFrame, column: str, known: DataFrame, to: str = "row_name") -> DataFrame:
    """The known id that equals an id, else the first known id that holds it with each ``:`` standing for any character, else null.

    The first is the one with the least ``place`` in ``known``, or the least id without that column. Only ids that equal none are searched for, inside the
    known ids, by :func:`found_at`. Those of which no GRAM characters are without a ``:`` are joined apart, with the known ids' substrings of their
    lengths, without the characters at the places of ``:``.
    """
    order = F.col("place") if "place" in known.columns else F.col("id")
    known = known.groupBy(F.col("id").alias("_id")).agg(F.min(order).alias("_order"))
    ids = df.select(F.col(column).alias("_want")).dropna().distinct()
    exact = ids.join(known, F.col("_want") == F.col("_id"), "left_semi").select("_want", F.col("_want").alias("_found"))
    rest = ids.join(exact, "_want", "left_anti").filter(F.length("_want") > 0)
    texts = _numbered(known, "_id")
    inside = found_at(texts, rest, ":").select("_want", F.col("_text").alias("_id")).join(known, "_id")
    bare_run = rf"[^:]{{{GRAM}}}"
    # an id's form: its length, where its colons are, and what is left of it
    colons = F.expr("filter(transform(split(_want, ''), (c, i) -> CASE WHEN c = ':' THEN i + 1 END), i -> i IS NOT NULL)")
    rest = rest.filter(~F.col("_want").rlike(bare_run)).withColumns({"_colons": colons, "_size": F.length("_want"), "_bare": F.replace(F.col("_want"), F.lit(":"), F.lit(""))})
    forms = rest.select("_size", "_colons").distinct().agg(F.collect_list(F.struct("_size", "_colons")).alias("_forms"))  # one row of the different forms
    cut = known.join(F.broadcast(forms)).withColumn("_form", F.explode("_forms")).select("_id", "_order", "_form.*").filter("length(_id) >= _size")
    cut = cut.withColumn("_at", F.explode(F.expr("sequence(1, length(_id) - _size + 1)"))).withColumn("_piece", F.expr("substring(_id, _at, _size)"))
    bare = F.expr("array_join(filter(split(_piece, ''), (c, i) -> NOT array_contains(_colons, i + 1)), '')")
    apart = cut.withColumn("_bare", bare).join(rest, ["_size", "_colons", "_bare"])
    near = inside.unionByName(apart.select("_want", "_id", "_order"), allowMissingColumns=True).groupBy("_want").agg(F.min_by("_id", "_order").alias("_found"))
    return df.join(exact.unionByName(near), F.col(column) == F.col("_want"), "left").withColumn(to, F.col("_found")).drop("_want", "_found")
