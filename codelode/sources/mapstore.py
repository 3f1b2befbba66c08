"""The map of a set of repositories as tables on disk, and its readable index."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codelode.functions.hof import join_present
from codelode.operators.extract import EXTRA_TYPE

MAP_VERSION = 1
UNIT_SCHEMA = (
    "repo string, id string, file string, lang string, type string, name string, start int, "
    f"end int, comment string, description string, area string, extra {EXTRA_TYPE}, cut boolean"
)
FILE_SCHEMA = (
    "repo string, file string, lines int, lang string, area string, header string, n_units int"
)


def unit_counts(units: DataFrame) -> DataFrame:
    """Units per type, most frequent first, and how many have no description."""
    return units.groupBy("type").agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce("description", F.lit("")) == "").alias("without_description"),
    ).orderBy(F.desc("n"), "type")


def map_meta(units: DataFrame, stats: DataFrame, project: str = "") -> DataFrame:
    """One row per repository: version, project, number of files and units."""
    files = stats.groupBy("repo").agg(F.count("*").alias("n_files"))
    counts = units.groupBy("repo").agg(F.count("*").alias("n_units"))
    return files.join(counts, "repo", "left").select(
        "repo", F.lit(MAP_VERSION).alias("version"), F.lit(project).alias("project"), "n_files",
        F.coalesce("n_units", F.lit(0)).alias("n_units"))


def extra_summary() -> Column:
    """What a unit refers to, in brackets; lists are cut at 8, except middleware."""
    def listed(field: str, title: str, limit: int | None = 8) -> Column:
        arr = F.col(f"extra.{field}")
        shown = F.slice(arr, 1, limit) if limit else arr
        return F.when(F.size(arr) > 0, F.concat(F.lit(title), F.array_join(shown, ", ")))

    def single(field: str, title: str) -> Column:
        col = F.col(f"extra.{field}")
        return F.when(col != "", F.concat(F.lit(title), col))

    inner = join_present("; ", [
        listed("tables", "tables: "), listed("emits", "socket: "), listed("calls", "api: "),
        single("route", "route: "), listed("middleware", "auth: ", None), single("parent", "in: "),
    ])
    return F.when(inner != "", F.concat(F.lit(" ["), inner, F.lit("]"))).otherwise(F.lit(""))


def unit_bullet() -> Column:
    shown = F.substring(F.coalesce("description", F.lit("")), 1, 200)
    return F.concat(
        F.lit("- `"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"),
        F.lit("` **"), F.col("name"), F.lit("** - "),
        F.when(shown != "", shown).otherwise(F.lit("(no description)")), extra_summary())


def render_index(units: DataFrame, stats: DataFrame) -> DataFrame:
    """Index lines (repo, area, file, start, line): a heading per area (file NULL), a heading
    per file (start 0), a bullet per unit. One row per line, so no area and no repository is
    ever gathered in one task; sort by the first four columns to read it."""
    key = ["repo", "area", "file", "start", "line"]
    none = lambda t: F.lit(None).cast(t)
    areas = units.select("repo", "area").distinct().select(
        "repo", "area", none("string").alias("file"), none("int").alias("start"),
        F.concat(F.lit("\n## Area: "), F.col("area")).alias("line"))
    header = F.when(F.coalesce("header", F.lit("")) != "", F.concat(
        F.lit(" - "), F.substring("header", 1, 160))).otherwise(F.lit(""))
    sections = stats.where(F.col("n_units") > 0).select(
        "repo", "area", "file", F.lit(0).alias("start"),
        F.concat(F.lit("\n### "), F.col("file"), F.lit(" ("), F.col("lines").cast("string"),
                 F.lit(" lines)"), header).alias("line"))
    bullets = units.select("repo", "area", "file", "start", unit_bullet().alias("line"))
    return areas.select(*key).unionByName(sections.select(*key)).unionByName(bullets.select(*key))


def index_heading(meta: DataFrame, generated: str) -> DataFrame:
    """Title lines of the index of each repository."""
    return meta.select("repo", F.concat(
        F.lit("# Codebase map\n"),
        F.when(F.col("project") != "", F.concat(F.lit("Project: "), F.col("project"), F.lit("\n")))
        .otherwise(F.lit("")),
        F.lit(f"Generated {generated}: "), F.col("n_files").cast("string"), F.lit(" files, "),
        F.col("n_units").cast("string"), F.lit(" units. Do not edit by hand.\n")).alias("line"))


def write_map(units: DataFrame, stats: DataFrame, path: str, *, project: str = "",
              generated: str = "", as_json: bool = False) -> None:
    """Save units and files, clustered by repository and path (range partitions give every
    Parquet file a narrow key range, so reading one repository skips the others), and the
    index as sorted text. The tables are read back for the index, so mining runs once."""
    spark = units.sparkSession
    for name, df in (("units", units), ("files", stats)):
        (df.repartitionByRange("repo", "file").sortWithinPartitions("repo", "file")
         .write.mode("overwrite").parquet(f"{path}/{name}"))
    saved = load_map(spark, path)
    if saved is None:
        raise OSError(f"map at {path} cannot be read back")
    saved_units, saved_stats = saved
    meta = map_meta(saved_units, saved_stats, project)
    meta.write.mode("overwrite").parquet(f"{path}/meta")
    if as_json:
        saved_units.write.mode("overwrite").json(f"{path}/units_json")
    null = F.lit(None).cast("string")
    lines = index_heading(meta, generated).select(
        "repo", null.alias("area"), null.alias("file"), null.cast("int").alias("start"), "line"
    ).unionByName(render_index(saved_units, saved_stats))
    (lines.orderBy("repo", "area", "file", "start").select("line")
     .write.mode("overwrite").text(f"{path}/index"))


def load_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(units, files) of a saved map; NULL when it is missing or not a map."""
    try:
        found = spark.read.parquet(f"{path}/units"), spark.read.parquet(f"{path}/files")
    except AnalysisException:
        return None
    wanted = [UNIT_SCHEMA, FILE_SCHEMA]
    for df, schema in zip(found, wanted):
        names = [c.strip().split(" ")[0] for c in schema.split("extra ")[0].split(",") if c.strip()]
        if not set(names) <= set(df.columns):
            return None
    return found
