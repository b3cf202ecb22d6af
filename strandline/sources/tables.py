"""Text and Parquet tables: reads with fixed schemas, batch folders, merges refreshed by source and exports with a table of contents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.sources.storage import delete

#: How the names of the catalog's tables of batch folders begin.
BATCHES = "strandline_batches_"


def read_csv(spark: SparkSession, path: str, schema: StructType | str, separator: str = ",") -> DataFrame:
    """A table with a header line; blanks are null; no inference."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("sep", separator).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.option("header", True).option("sep", separator).option("escape", '"').csv(path)


def read_batches(spark: SparkSession, root: str, file_name: str, schema: StructType | str, kept: DataFrame | None = None, key: str = "peptide") -> DataFrame:
    """The same tab-separated file of all batch folders below a root, with ``batch`` and ``round`` from the path; folders without it are skipped.

    A folder is ``b<number>`` or ``round2/b<number>``; it may be a partition folder (``name=b1``), and files may lie one folder below it. The root's own
    name and those above it say nothing. Each folder is a partition of the scan: the files are listed once, as Spark's reader does, and an external table
    of the session's catalog (``strandline_batches_...``, which ``drop_batches`` removes) knows them by ``batch``.

    With ``kept`` only rows whose key it has are read on, by a semi join. If it has a column ``batch`` too, only the batches it names are opened:
    Spark prunes the other partitions when the query runs. Its batches are broadcast, of which there are at most as many as folders.
    A null key or batch of ``kept`` matches nothing.
    """
    kind = spark.createDataFrame([], schema).schema
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    above = len(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString())  # as the listing's paths begin
    inside = F.regexp_extract(F.expr(f"substring(path, {above + 1})"), r"(?:^|/)((?:round2/)?(?:\w+=)?b\d+)/(?:[^/]*/)?[^/]*$", 1)
    folders = listing(spark, root, file_name).select(folder.alias("folder"), F.regexp_replace(inside, r"\w+=", "").alias("batch")).filter("batch <> ''").distinct()
    found: dict[str, list[str]] = {}
    for row in folders.orderBy("batch", "folder").collect():  # no more than the scan's own list of files
        found.setdefault(row["batch"], []).append(row["folder"])
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    table = f"{BATCHES}{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)
    options = f"header 'true', sep '\\t', pathGlobFilter {quoted(file_name)}"
    # several folders of one batch are partitions of their own
    spark.sql(f"CREATE TABLE {table} ({columns}, batch STRING, part INT) USING csv OPTIONS ({options}) PARTITIONED BY (batch, part) LOCATION {quoted(root)}")
    specs = [f"PARTITION (batch = {quoted(b)}, part = {i}) LOCATION {quoted(at)}" for b, places in found.items() for i, at in enumerate(places)]
    for i in range(0, len(specs), 500):
        spark.sql(f"ALTER TABLE {table} ADD {' '.join(specs[i : i + 500])}")
    rows = spark.table(table)
    if kept is not None and "batch" in kept.columns:
        wanted = kept.select("batch").filter(F.length("batch") > 0).distinct().join(folders.select("batch").distinct(), "batch", "left_semi")
        rows = rows.join(F.broadcast(wanted), "batch", "left_semi")
    if kept is not None:
        rows = rows.join(kept.select(key).distinct(), key, "left_semi")
    return rows.select(*kind.names, "batch", F.when(F.col("batch").startswith("round2/"), 2).otherwise(1).alias("round"))


def drop_batches(spark: SparkSession) -> None:
    """Removes the catalog's tables of batch folders; the files stay. What ``read_batches`` returned can't be run after it."""
    for t in spark.catalog.listTables(pattern=f"{BATCHES}*"):
        spark.sql(f"DROP TABLE IF EXISTS {t.name}")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, times and sizes of all files below the paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "modificationTime", "length")
    one = F.concat_ws("|", "path", F.col("modificationTime").cast("string"), F.col("length").cast("string"))
    # the sum of hashes doesn't depend on the order of files
    row = files.agg(F.count("*"), F.sum(F.xxhash64(one).cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1]}"


MANIFEST = "version long, source string, fingerprint string, part string, merged string, written timestamp"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """What ``refreshed`` has published below a path: for each version a row for each source, with its fingerprint, its part and the merged table."""
    known = spark.createDataFrame([], MANIFEST)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return known
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{path}/manifest")


def refreshed(
    spark: SparkSession, path: str, sources: dict[str, list[str]], load: Callable[[str], DataFrame], merge: Callable[[dict[str, DataFrame]], DataFrame], keep: int = 2,
    combine: Callable[[dict[str, DataFrame], DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The table merged from several sources, stored below a path and refreshed by source.

    sources: the paths of each source's files. ``load`` gives a source's part of the table, which is stored under the files' fingerprint; ``merge``
    makes the table of all parts. Where no file changed, the newest version is returned and nothing runs but the listing. Else parts of changed
    sources are built, the others are taken as they are, and the new version is written beside the old one. It is published by a manifest of one
    file, which appears as a whole when Spark commits it: readers have the old version until then, and a build that fails or loses the driver changes
    nothing for them. Two builders never write one folder; of versions with one number the one written last counts. The ``keep`` newest versions stay, so
    that readers of the one before can end; older ones, and parts that no kept version has, are deleted.

    A table that has far more rows than its parts is better not stored: with ``combine``, a version is only what ``merge`` makes, and the table is
    what ``combine`` makes of the parts and the version whenever it is read. All calls for one path must give the same functions.
    """

    def table(parts: dict[str, str], merged: str) -> DataFrame:
        stored = spark.read.parquet(merged)
        return stored if combine is None else combine({name: spark.read.parquet(parts[name]) for name in sources}, stored)

    now = {name: fingerprint(spark, paths) for name, paths in sources.items()}
    known = [r.asDict() for r in manifest(spark, path).orderBy("version", "written", "merged").collect()]  # a row for each kept version and source
    newest = [r for r in known if known and r["merged"] == known[-1]["merged"]]
    if newest and {r["source"]: r["fingerprint"] for r in newest} == now:
        return table({r["source"]: r["part"] for r in newest}, newest[0]["merged"])
    stored = {(r["source"], r["fingerprint"]): r["part"] for r in known}
    parts = {}
    for name, mark in now.items():
        parts[name] = stored.get((name, mark))
        if parts[name] is None:
            parts[name] = f"{path}/parts/{uuid.uuid4().hex}"
            load(name).write.parquet(parts[name])
    version, ident = (known[-1]["version"] + 1 if known else 1), uuid.uuid4().hex
    merged = f"{path}/versions/{version}-{ident}"
    merge({name: spark.read.parquet(part) for name, part in parts.items()}).write.parquet(merged)
    rows = spark.createDataFrame([(version, name, now[name], parts[name], merged) for name in now], "version long, source string, fingerprint string, part string, merged string")
    rows.withColumn("written", F.current_timestamp()).coalesce(1).write.json(f"{path}/manifest/{version}-{ident}")
    order = list(dict.fromkeys(r["merged"] for r in known)) + [merged]
    old, left = order[:-keep], set(order[-keep:])
    used = set(parts.values()) | {r["part"] for r in known if r["merged"] in left}
    for gone in old:
        delete(spark, f"{path}/manifest/{gone.rsplit('/', 1)[1]}")
        delete(spark, gone)
    for part in {r["part"] for r in known} - used:
        delete(spark, part)
    return table(parts, merged)


def export_tables(tables: dict[str, tuple[DataFrame, str]], path: str, descriptions: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes each table under its id, and returns the table of contents and the column dictionary, which are written too.

    Contents: ``position``, ``name``, ``description``, ``columns``, ``n_rows``. Dictionary: ``name``, ``position``, ``column_name``, ``kind``,
    ``description`` (of ``descriptions``, by column name; null without), ``n_values`` that aren't null, and ``digest``: the sum over these values of the first 32
    bits of the MD5 of each as text, the same in any order of rows. Figures are taken from the files written, in one aggregation for each table.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    contents, columns, told = [], [], descriptions or {}
    for i, (name, (df, description)) in enumerate(tables.items()):
        df.write.parquet(f"{path}/{name}")
        figures = []
        for k, c in enumerate(df.columns):
            value = F.col(f"`{c}`").cast("string")
            figures += [F.count(value).alias(f"n{k}"), F.coalesce(F.sum(F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")), F.lit(0)).alias(f"d{k}")]
        row = spark.read.schema(df.schema).parquet(f"{path}/{name}").agg(F.count("*").alias("n"), *figures).first()
        contents.append((i, name, description, len(df.columns), row["n"]))
        columns += [(name, k, f.name, f.dataType.simpleString(), told.get(f.name), row[f"n{k}"], row[f"d{k}"]) for k, f in enumerate(df.schema.fields)]
    toc = spark.createDataFrame(contents, "position int, name string, description string, columns int, n_rows long")
    dictionary = spark.createDataFrame(columns, "name string, position int, column_name string, kind string, description string, n_values long, digest long")
    toc.write.parquet(f"{path}/contents")
    dictionary.write.parquet(f"{path}/column_dictionary")
    return toc, dictionary


def missing(expected: DataFrame, present: DataFrame, key: str = "path") -> DataFrame:
    """Expected outputs that are not there."""
    return expected.join(present.select(key).distinct(), key, "left_anti")


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes of all files below a root; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")


# Folders of assets, and their names' patterns.
QUALITY_FOLDERS = ("Strong", "Moderate", "Weak", "Insufficient")
COUPLING_FOLDERS = ("coupled", "non_coupled")


def spectrum_assets(paths: DataFrame) -> DataFrame:
    """``peptide``, ``charge``, ``scan``, ``quality`` of ``mirror_plots/<quality>/<peptide>_<charge>_..._<scan>.png``; other paths are left out."""
    part = lambda i: F.regexp_extract("path", r"(?:^|/)mirror_plots/([^/]+)/([^/]+)\.png$", i)
    names = paths.select("path", part(1).alias("quality"), F.split(part(2), "_").alias("_p")).filter(F.col("quality").isin(*QUALITY_FOLDERS) & (F.size("_p") >= 3))
    return names.select("path", "quality", F.col("_p")[0].alias("peptide"), F.replace(F.col("_p")[1], F.lit("z"), F.lit("")).alias("charge"), F.element_at("_p", -1).alias("scan"))


def profile_assets(paths: DataFrame) -> DataFrame:
    """One asset for each stem of ``expression_profiles/<coupling>/<gene>_<chrom>_<start>-<end>``, an image before a document."""
    part = lambda i: F.regexp_extract("path", r"(?:^|/)expression_profiles/([^/]+)/(.*)_(chr\w+?)_(\d+)-(\d+)\.(png|pdf)$", i)
    rows = paths.select("path", part(1).alias("coupling"), part(2).alias("gene"), F.concat(part(3), F.lit(":"), part(4), F.lit("-"), part(5)).alias("coordinates"), part(6).alias("_kind"))
    rows = rows.filter(F.col("coupling").isin(*COUPLING_FOLDERS))
    first = F.struct(F.when(F.col("_kind") == "png", 0).otherwise(1), "path")
    return rows.groupBy("coupling", "gene", "coordinates").agg(F.min_by("path", first).alias("path"))


def sorted_table(df: DataFrame, column: str, ascending: bool, *ties: str) -> DataFrame:
    """Nulls last in both directions."""
    by: Column = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    return df.orderBy(by, *ties)
