"""From files to the map: the build as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codelode.operators.describe import merge_descriptions
from codelode.operators.extract import (
    FACTS,
    file_stats_of,
    mine_files,
    mined_units,
    route_table_of,
    with_pages,
)
from codelode.operators.limits import Limits
from codelode.sources.corpus import is_minified, list_files
from codelode.sources.scratch import saved


def scanned(files: DataFrame, include=(), exclude=(), unique: bool = False) -> DataFrame:
    """Files that are listed for scanning and are not minified."""
    return list_files(files, include, exclude, unique=unique).where(~is_minified(F.col("text")))


def build_map(
    files: DataFrame, *, include: list[str] = (), exclude: list[str] = (),
    areas: list[tuple[str, str]] = (), descriptions: DataFrame | None = None,
    unique: bool = False, limits: Limits = Limits(),
) -> tuple[DataFrame, DataFrame]:
    """files(repo, path, size, text) -> (units, file stats). ``limits`` is how far blocks and
    comments reach.

    The files are read once: units are mined together with the facts about their file and
    saved, without any source text. The file table and the route table come from the saved
    rows, and so do the pages, which need the routes of the whole repository."""
    chosen = scanned(files, include, exclude, unique)
    rows = saved(mined_units(mine_files(chosen, areas, limits), with_facts=True), "units")
    units = with_pages(rows, route_table_of(rows)).drop(*FACTS)
    if descriptions is not None:
        units = merge_descriptions(units, descriptions)
    return units, file_stats_of(rows)
