"""Filters and figures of a faceted view: each filter does nothing when its selection is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.lists import decode_list
from strandline.functions.predicates import is_in, is_true, matches, number

# Types of each group.
GROUPS = {
    "Upstream": ("uORF", "uoORF", "uaORF", "uaoORF", "udORF"),
    "Downstream": ("dORF", "doORF", "daORF", "daoORF"),
    "Internal ORF": ("iORF", "oORF"),
    "TrEMBL/AltORF": ("eORF", "TrEMBL"),
    "Short-Isoform": ("Iso", "D-Iso", "N-Iso"),
    "lncRNA": ("lncRNA",),
    "psORF": ("psORF",),
}
DASH = "—"


def group_of(kind: Column) -> Column:
    """The group of a type; a type without one stands for itself."""
    out = kind
    for group, members in GROUPS.items():
        out = F.when(kind.isin(*members), group).otherwise(out)
    return out


def one_of(df: DataFrame, column: str, chosen: list[str], keep_null: bool = False) -> DataFrame:
    if not chosen:
        return df
    kept = is_in(F.col(column), chosen)
    return df.filter(kept | F.col(column).isNull() if keep_null else kept)


def within(df: DataFrame, column: str, bounds: tuple[float, float] | None) -> DataFrame:
    """Inclusive bounds; nulls stay."""
    return df if bounds is None else df.filter(F.col(column).between(*bounds) | F.col(column).isNull())


def search(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(matches(F.col(column), pattern, ignore_case=True)) if pattern else df


def in_groups(df: DataFrame, column: str, groups: list[str], narrowed: str | None = None, members: list[str] | None = None) -> DataFrame:
    """Types of the groups; of the narrowed group only the members given."""
    chosen = [t for g in groups for t in GROUPS.get(g, ())]
    if groups and members and narrowed:
        chosen = [t for t in chosen if t not in GROUPS[narrowed] or t in members]
    elif not groups:
        chosen = members or []
        if not chosen:
            return df
    return df.filter(is_in(F.col(column), chosen))


def beyond_start(df: DataFrame, kind: str, positions: str) -> DataFrame:
    """Drops isoforms all of whose peptide positions (a list as text) are at the very start (2 or less); what can't be read stays."""
    numbers = F.transform(decode_list(F.col(positions)), lambda x: x.try_cast("int"))
    readable = F.coalesce(F.forall(numbers, lambda x: x.isNotNull()), F.lit(False))
    late = F.coalesce(F.exists(numbers, lambda x: x > 2), F.lit(False))
    return df.filter(~is_in(F.col(kind), GROUPS["Short-Isoform"]) | F.col(positions).isNull() | ~readable | late)


def significance(df: DataFrame, columns: dict[str, str], loose: float = 0.2, strict: float = 0.05) -> DataFrame:
    """For each prefix and q-value column the flags ``<prefix>_significant`` and ``<prefix>_highly_significant``; null counts as 1."""
    new = {}
    for prefix, column in columns.items():
        q = F.coalesce(number(F.col(column)), F.lit(1.0))
        new |= {f"{prefix}_significant": q < loose, f"{prefix}_highly_significant": q < strict}
    return df.withColumns(new)


def is_reviewed(labels: Column) -> Column:
    return F.coalesce(F.lower(labels).contains("swiss"), F.lit(False))


def included(df: DataFrame, annotated: Column, labels: list[str], in_proteomics: Column, longest: int = 151) -> DataFrame:
    """Annotated rows, and reviewed microproteins that proteomics has seen."""
    reviewed = F.lit(False)
    for c in labels:
        reviewed = reviewed | F.coalesce(F.lower(F.col(c)).contains("swiss-prot"), F.lit(False))
    short = F.coalesce(F.length("sequence") <= longest, F.lit(False))
    return df.filter(is_true(annotated) | (reviewed & short & is_true(in_proteomics)))


def masked(df: DataFrame, labels: str, not_applicable: list[str], kinds: list[str], scores: list[str]) -> DataFrame:
    """Display columns: reviewed rows show a dash where a column doesn't apply and ``Swiss-Prot`` as type; scores have three decimals."""
    reviewed, new = is_reviewed(F.col(labels)), {}
    for c in not_applicable:
        new[c] = F.when(reviewed, DASH).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    for c in kinds:
        new[c] = F.when(reviewed, "Swiss-Prot").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    for c in scores:
        new[c] = F.when(reviewed, DASH).otherwise(F.coalesce(F.format_string("%.3f", number(F.col(c))), F.lit("")))
    return df.withColumns(new)


def headline(df: DataFrame, gene: str, group: str, kind: str, labels: str, significant: dict[str, str]) -> DataFrame:
    """One row: totals, distinct genes, groups and types, significant rows, reviewed and unreviewed with their percentages."""
    reviewed = F.count_if(is_reviewed(F.col(labels)))
    total = F.count("*")
    percent = lambda n: F.when(total > 0, F.round(n / total * 100, 1)).otherwise(0.0)
    return df.agg(
        total.alias("total"), F.count_distinct(gene).alias("genes"), F.count_distinct(group).alias("groups"), F.count_distinct(kind).alias("types"),
        *(F.count_if(is_true(F.col(c))).alias(name) for name, c in significant.items()),
        reviewed.alias("reviewed"), (total - reviewed).alias("unreviewed"), percent(reviewed).alias("reviewed_percent"), percent(total - reviewed).alias("unreviewed_percent"),
    )


def options(df: DataFrame, columns: list[str], ranges: list[str]) -> DataFrame:
    """One row: sorted different values of each facet, and whole-number limits of each range."""
    facets = [F.sort_array(F.collect_set(c)).alias(c) for c in columns]
    limits = [f(F.col(c).cast("long")).alias(f"{n}_{c}") for c in ranges for n, f in (("min", F.min), ("max", F.max))]
    return df.agg(*facets, *limits)


def direction(value: Column, q: Column, threshold: float = 0.2) -> Column:
    """Class of a fold change: missing, not significant, up, down, or none at zero."""
    return F.when(value.isNull(), "na").when(q >= threshold, "ns").when(value > 0, "up").when(value < 0, "down").otherwise("")


def p_class(p: Column, threshold: float) -> Column:
    return F.when(p.isNull(), "na").when(p < threshold, "yes").otherwise("ns")
