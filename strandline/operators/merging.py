"""Merging result tables by key, unifying their columns, and set operations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.predicates import first_of


#: Rows of a common key, left and right, that one task matches with each other.
LEFT_ROWS, RIGHT_ROWS = 16_384, 4_096


def spread_join(a: DataFrame, b: DataFrame, key: str, how: str = "inner", left_rows: int = LEFT_ROWS, right_rows: int = RIGHT_ROWS) -> DataFrame:
    """Inner or left join of two tables that both have many rows of a key: as many rows come out as the key's rows multiplied, but no task makes them alone.

    A key with more rows than ``left_rows`` or ``right_rows`` is cut into pieces by a hash of the rows, and each piece of one side meets each of the other
    in a task of its own. A row is copied once for each piece of the other side, so that a cell of pieces takes in far fewer rows than it makes.
    """
    sizes = a.groupBy(key).agg(F.count("*").alias("_a")).join(b.groupBy(key).agg(F.count("*").alias("_b")), key).filter((F.col("_a") > left_rows) | (F.col("_b") > right_rows))
    cells = F.broadcast(sizes.select(key, F.ceil(F.col("_a") / left_rows).alias("_a"), F.ceil(F.col("_b") / right_rows).alias("_b")))  # few keys have so many rows
    number = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        piece = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1)))
        out = df.join(cells, key, "left").withColumns({f"{own}_at": piece, f"{other}_at": F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))})
        return out.withColumn("_cut", F.col(own).isNotNull()).drop(own, other).repartition(number, key, "_a_at", "_b_at")

    right = dealt(b, "_b", "_a").drop("_cut").withColumn("_met", F.lit(True))
    out = dealt(a, "_a", "_b").join(right, [key, "_a_at", "_b_at"], how)
    # a key that is cut has rows on both sides: without a match is only a piece that no row fell into
    return out.filter(~F.col("_cut") | F.col("_met").isNotNull()).drop("_a_at", "_b_at", "_cut", "_met")


#: Rows of a list and of a piece that is cut into lists, rows of the other side that meet a list in one task, and tasks for each of the session's partitions.
LIST_ROWS, PIECE_ROWS, OTHER_ROWS, MORE_TASKS = 1_024, 8_192, 16_384, 8


def list_join(a: DataFrame, b: DataFrame, key: str, how: str = "inner", list_rows: int = LIST_ROWS, piece_rows: int = PIECE_ROWS, other_rows: int = OTHER_ROWS) -> DataFrame:
    """The inner or left join that :func:`spread_join` makes, for rows out that are stored: in an order that files of columns keep small.

    A key's rows of ``b`` are cut into pieces by a hash, and each piece, in order, into lists; a task matches a piece of ``a`` with one list after another.
    The values of ``a`` stay for a whole list, and those of ``b`` come again in the same order for each row of ``a``: a task writes few different values, in
    long runs and short patterns. Lists have a multiple of eight rows, so that values packed into bits fall on the same bytes each time.
    A row of ``a`` is copied for each list, which is a thousandth of the rows it makes. Columns of ``b`` must have an order; equal rows are in one piece.
    """
    b = b.filter(F.col(key).isNotNull())
    fields = [c for c in b.columns if c != key]
    sizes = b.groupBy(key).agg(F.count("*").alias("_b")).join(a.groupBy(key).agg(F.count("*").alias("_a")), key, "left").filter((F.col("_a") > other_rows) | (F.col("_b") > list_rows))
    pieces, others = F.ceil(F.col("_b") / piece_rows), F.ceil(F.coalesce("_a", F.lit(1)) / other_rows)
    cells = F.broadcast(sizes.select(key, others.alias("_others"), pieces.alias("_pieces"), F.ceil(F.col("_b") / pieces / list_rows).alias("_lists")))  # few keys have so many rows
    number = MORE_TASKS * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [key, "_other_at", "_list_at"]

    def dealt(df: DataFrame) -> DataFrame:
        parts = {c: F.coalesce(c, F.lit(1)) for c in ("_others", "_pieces", "_lists")}
        return df.join(cells, key, "left").withColumn("_cut", F.col("_lists").isNotNull()).withColumns(parts)

    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    piece = F.pmod(F.xxhash64(*b.columns), "_pieces").alias("_piece")
    whole = dealt(b).groupBy(key, "_others", "_lists", piece).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_rows"))
    whole = whole.withColumn("_width", (8 * F.ceil(F.size("_rows") / (8 * F.col("_lists")))).cast("int")).withColumn("_i", each(F.col("_lists")))
    cut = F.slice("_rows", (F.col("_i") * F.col("_width") + 1).cast("int"), F.col("_width"))
    lists = whole.select(key, "_others", (F.col("_piece") * F.col("_lists") + F.col("_i")).alias("_list_at"), cut.alias("_list")).filter(F.size("_list") > 0)
    lists = lists.withColumn("_other_at", each(F.col("_others"))).drop("_others").repartition(number, *at)
    rows = dealt(a).withColumn("_other_at", F.pmod(F.xxhash64(*a.columns), "_others"))
    rows = rows.select(*a.columns, "_cut", "_other_at", each(F.col("_pieces") * F.col("_lists")).alias("_list_at")).repartition(number, *at)
    # a key that is cut has lists: without a match is only a place that no list has
    out = rows.join(lists.hint("merge"), at, how).filter(~F.col("_cut") | F.col("_list").isNotNull())
    none = F.array(F.lit(None).cast(lists.schema["_list"].dataType.elementType))
    return out.select(*a.columns, F.inline(F.coalesce("_list", none)))


def merge_keys(sources: dict[str, DataFrame], key: str = "sequence", null_safe: bool = False) -> DataFrame:
    """All different keys of the sources, null among them only if ``null_safe``."""
    keys = reduce(DataFrame.unionByName, (df.select(key) for df in sources.values())).distinct()
    return keys if null_safe else keys.filter(F.col(key).isNotNull())


def merge_sources(sources: dict[str, DataFrame], key: str = "sequence", null_safe: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """Full outer merge of all sources: their columns prefixed by name, and a flag ``<name>_present`` for each.

    A key that several rows of several sources have gives all their combinations. Null keys meet each other only if ``null_safe``.
    All different keys are the spine (:func:`merge_keys`; ``keys``, where they are known). The first source joins it, and all others join it one after
    another; the combinations of both are made last, by :func:`spread_join`, so that they are never shuffled and no task makes those of a common key alone.
    """
    parts = []
    for name, df in sources.items():
        prefix = re.sub(r"[()]", "", name.replace(" ", "_")).replace("+", "_")
        parts.append(df.select(F.col(key), *(F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in df.columns if c != key), F.lit(True).alias(f"{prefix}_present")))
    at = F.struct(key) if null_safe else F.col(key)  # structs of a null are equal
    keyed = [(p if null_safe else p.filter(F.col(key).isNotNull())).select(at.alias("_key"), *(F.col(f"`{c}`") for c in p.columns if c != key)) for p in parts]
    spine = (merge_keys(sources, key, null_safe) if keys is None else keys).select(at.alias("_key"))
    sides = [spine.join(p, "_key", "left") for p in keyed[:2]]
    out = reduce(lambda x, y: spread_join(x, y, "_key", "left"), [sides[-1], *keyed[2:]])
    if len(keyed) > 1:
        out = spread_join(sides[0], out, "_key")
    out = out.select((F.col("_key")[key] if null_safe else F.col("_key")).alias(key), *(F.col(f"`{c}`") for c in out.columns if c != "_key"))
    if not null_safe:
        out = reduce(lambda a, p: a.unionByName(p.filter(F.col(key).isNull()), allowMissingColumns=True), parts, out)
    return out.fillna(False, subset=[c for c in out.columns if c.endswith("_present")])


def completeness(columns: list[str]) -> Column:
    """Number of columns with a value."""
    return reduce(lambda a, b: a + b, (F.col(f"`{c}`").isNotNull().cast("int") for c in columns), F.lit(0))


def completeness_merge(sources: dict[str, DataFrame], keep: list[str], name: str = "filled", key: str = "sequence") -> DataFrame:
    """The columns ``keep`` of each source's rows in a merge, and :func:`completeness` of all columns but key and flags: each source's rows are counted before they are combined."""
    taken = {}
    for source, df in sources.items():
        count = completeness([c for c in df.columns if c != key])
        taken[source] = df.select(key, *keep, count.alias("_filled"))
    merged = merge_sources(taken, key)
    total = reduce(lambda a, b: a + b, (F.coalesce(f"{source}__filled", F.lit(0)) for source in sources))
    return merged.select(key, *(f"{source}_{c}" for source in sources for c in keep), total.alias(name))


def most_complete(df: DataFrame, key: str, tie: list[str]) -> DataFrame:
    """Of each key the row with most values outside the key and the presence flags; ties by the columns given."""
    data = [c for c in df.columns if c != key and not c.endswith("_present")]
    w = Window.partitionBy(key).orderBy(F.desc("_filled"), *(F.col(c).asc_nulls_last() for c in tie))
    ranked = df.withColumn("_filled", completeness(data)).withColumn("_rank", F.row_number().over(w))
    return ranked.filter("_rank = 1").drop("_filled", "_rank")


def best_rows(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Of each key of one source the row with most values; ties by the column given, nulls last."""
    data = [c for c in df.columns if c != key]
    order = F.struct((-completeness(data)).alias("n"), F.col(tie).isNull().alias("none"), F.col(tie).alias("tie"))
    return df.groupBy(key).agg(F.min_by(F.struct(*data), order).alias("_row")).select(key, *(F.col(f"_row.`{c}`").alias(c) for c in data))


def most_complete_merge(sources: dict[str, DataFrame], tie: str, key: str = "sequence") -> DataFrame:
    """What :func:`most_complete` keeps of a merge, ties by the sources' columns in turn, without the combinations.

    A combination has as many values as its rows together, so that a key's best one is made of each source's best row: at most one row of a key
    and source is merged. Rows with a null key are not combined; of each source's best one of them the best is kept.
    """
    merged = merge_sources({name: best_rows(df, key, tie) for name, df in sources.items()}, key)
    return most_complete(merged, key, [f"{name}_{tie}" for name in sources])


def unified(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """For each new name the first non-null of the columns whose name matches the pattern, left to right."""
    return df.withColumns({new: first_of([c for c in df.columns if re.search(p, c, re.IGNORECASE)]) for new, p in patterns.items()})


def enrich(df: DataFrame, master: DataFrame, key: str, columns: list[str], order: list[Column]) -> DataFrame:
    """Left join of columns from a master table, of which each key's first row counts."""
    ranked = master.select(key, *columns, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("_rank"))
    return df.join(ranked.filter("_rank = 1").drop("_rank"), key, "left")


def mapped(df: DataFrame, names: DataFrame, column: str, from_name: str, to_name: str, first_only: bool = True) -> DataFrame:
    """Replaces a column's values by what a mapping table says (its smallest match, or every match), where it says something."""
    table = names.groupBy(from_name).agg(F.min(to_name).alias(to_name)) if first_only else names.select(from_name, to_name)
    table = table.select(F.col(from_name).alias("_from"), F.col(to_name).alias("_to"))
    joined = df.join(table, df[column] == F.col("_from"), "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def without_columns(df: DataFrame, pattern: str, first: tuple[str, ...] = ()) -> DataFrame:
    """Drops columns whose name matches; moves key columns (in any case) to the front."""
    kept = [c for c in df.columns if not re.search(pattern, c)]
    front = [c for f in first for c in kept if c.upper() == f.upper()]
    return df.select(*(F.col(f"`{c}`") for c in [*front, *(c for c in kept if c not in front)]))


def without_text(df: DataFrame, text: str) -> DataFrame:
    """Drops rows any column of which contains a text."""
    return df.filter(~F.concat_ws("\x00", *(F.col(f"`{c}`").cast("string") for c in df.columns)).contains(text))


def prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") if c == key else F.col(f"`{c}`").alias(prefix + c) for c in df.columns))


def bound(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def wide_by_category(df: DataFrame, category: str, values: list[str], columns: list[str], key: str) -> DataFrame:
    """A row for each row, with the columns ``<category>_<column>`` of its own category filled and the others null."""
    new = [F.when(F.col(category) == v, F.col(c)).alias(f"{v.replace(' ', '_')}_{c}") for v in values for c in columns]
    return df.filter(F.col(category).isin(*values)).select(key, *new)


def signatures(df: DataFrame, key: str, group: str, joiner: str = " & ") -> DataFrame:
    """How many keys have each combination of groups."""
    sets = df.dropna(subset=[key, group]).groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(group)), joiner).alias("signature"))
    return sets.groupBy("signature").agg(F.count("*").alias("n"))
