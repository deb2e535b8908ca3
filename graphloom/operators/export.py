"""Graph exports: CSV, Markdown, text and tables by project."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import csv_field, markdown_cell, name_uuid

from .ordering import numbered

FORMATS = {"csv": ".csv", "excel": ".xlsx", "markdown": ".md", "text": ".txt"}
ENTITY_COLUMNS, RELATION_COLUMNS = ("name", "type", "description", "source_chunk_count"), ("src", "tgt", "description", "keywords", "weight", "source_chunk_count")
CELL_LIMIT = 32767


@dataclass(frozen=True)
class ExportConfig:
    """What to export and how."""

    format: str = "csv"
    entities: bool = True
    relations: bool = True
    batch_size: int = 1000
    max_items: int | None = None

    def __post_init__(self):
        if self.batch_size <= 0 or not (self.entities or self.relations):
            raise ValueError("need a positive batch size, and entities or relations")

    @staticmethod
    def parse(name: str | None) -> str:
        name = (name or "csv").strip().lower()
        if name not in FORMATS:
            raise ValueError(f"unknown format {name}")
        return name


def export_name(project: str, format: str) -> str:
    """File name of an export: eight characters of the project and the ending of the format."""
    return f"kg-export-{project[:8]}{FORMATS[ExportConfig.parse(format)]}"


def checked_request(exists: bool, format: str | None, entities: bool = True, relations: bool = True, max_items: int | None = None) -> tuple[int, ExportConfig | str]:
    """Status and configuration of a request, or what is wrong with it: 404 for no such project, 400 for bad values."""
    if not exists:
        return 404, "no such project"
    try:
        return 200, ExportConfig(ExportConfig.parse(format), entities, relations, max_items=max_items)
    except ValueError as e:
        return 400, str(e)


def with_count(rows: DataFrame) -> DataFrame:
    return rows.withColumn("source_chunk_count", F.coalesce(F.size("source_chunk_ids"), F.lit(0)))


def csv_rows(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return with_count(rows).select(F.concat_ws(",", *[csv_field(F.col(c)) for c in columns]).alias("line"))


def markdown_rows(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    cell = lambda c: F.format_string("%.2f", F.col(c).cast("double")) if c == "weight" else markdown_cell(F.col(c).cast("string"))
    return with_count(rows).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))


#: Sections of a Markdown document with their columns and the rules below them.
SECTIONS = {
    "Entities": ("| Name | Type | Description | Document ID | Sources |", "|------|------|-------------|-------------|---------|"),
    "Relations": ("| Source | Target | Description | Keywords | Weight |", "|--------|--------|-------------|----------|--------|"),
}


def escaped(value: Column) -> Column:
    """A Markdown cell: pipes escaped, line feeds as spaces, no carriage returns; null is empty."""
    return F.replace(F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def markdown_document(vertices: DataFrame, edges: DataFrame, config: ExportConfig = ExportConfig(format="markdown")) -> DataFrame:
    """The lines of a Markdown document, (section, number, line): headings with counts, tables, descriptions cut at 100
    characters, max_items for each section. Empty sections are left out; an empty line stands between two. Rows are in order
    of their first columns and numbered without passing one task."""
    cut = F.when(F.length("description") > 100, F.concat(F.substring("description", 1, 97), F.lit("..."))).otherwise(F.col("description"))
    dash = lambda c: escaped(F.coalesce(F.col(c), F.lit("-"))) if c in vertices.columns else F.lit("-")
    cells = {
        "Entities": (vertices, ["name", "type"], [escaped(F.col("name")), dash("type"), escaped(cut), dash("document_id"), F.coalesce(F.size("source_chunk_ids"), F.lit(0)).cast("string")]),
        "Relations": (edges, ["src", "tgt"], [escaped(F.col("src")), escaped(F.col("tgt")), escaped(cut), escaped(F.col("keywords")), F.format_string("%.2f", F.col("weight").cast("double"))]),
    }
    out, before = None, False
    for title, wanted in (("Entities", config.entities), ("Relations", config.relations)):
        rows, order, columns = cells[title]
        if not wanted or rows.isEmpty():
            continue
        rows = rows.orderBy(*order).limit(config.max_items) if config.max_items is not None else rows
        table = numbered(rows.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |"))), order).select(F.lit(title).alias("section"), (F.col("number") + 3).alias("number"), "line")
        count = rows.agg(F.format_string(f"## {title} (%d)", F.count("*")).alias("line"))
        top = [F.lit("")] * before + [F.col("line"), F.lit(""), *map(F.lit, SECTIONS[title])]
        head = count.select(F.lit(title).alias("section"), F.posexplode(F.array(*top)).alias("number", "line")).withColumn("number", (F.col("number") - int(before)).cast("long"))
        lines = head.unionByName(table)
        out, before = lines if out is None else out.unionByName(lines), True
    return out if out is not None else vertices.sparkSession.createDataFrame([], "section string, number long, line string")


def excel_cell(value: Column) -> Column:
    return F.when(F.length(value) > CELL_LIMIT, F.concat(F.substring(value, 1, CELL_LIMIT - 3), F.lit("..."))).otherwise(value)


def text_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """Numbered blocks of all rows, in order."""
    flat = F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"\s+", " "))
    short = F.when(flat == "", "(none)").when(F.length(flat) > 200, F.concat(F.substring(flat, 1, 197), F.lit("..."))).otherwise(flat)
    return numbered(rows, order).select(F.format_string("%d. %s [%s]\n   %s", F.col("number"), F.col("name"), F.coalesce("type", F.lit("(none)")), short).alias("block"))


def export_csv(vertices: DataFrame, edges: DataFrame, config: ExportConfig) -> str:
    """The two-section file, streamed through the driver row by row; max_items bounds each section."""
    parts = []
    for title, rows, columns, wanted in (("# ENTITIES", vertices, ENTITY_COLUMNS, config.entities), ("# RELATIONS", edges, RELATION_COLUMNS, config.relations)):
        if wanted:
            rows = rows.orderBy(*columns[:2])
            rows = rows.limit(config.max_items) if config.max_items is not None else rows
            parts.append("\n".join([title, ",".join(columns), *(r["line"] for r in csv_rows(rows, columns).toLocalIterator())]) + "\n")
    return "\n".join(parts)


def export_project(tables: dict[str, DataFrame], project: str, path: str) -> None:
    """Each table's rows of a project as Parquet below a folder."""
    for name, table in tables.items():
        table.filter(F.col("project_id") == project).write.mode("overwrite").parquet(f"{path}/{name}")


def import_project(spark, path: str, names: list[str], project: str, references: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables of an export under another project id. Row ids are new: a hash of the project and the old id, so that
    columns that refer to them (references: column name to table) are renewed alike."""
    fresh = lambda table, c: F.when(F.col(c).isNotNull(), name_uuid(F.concat_ws(":", F.lit(project), F.lit(table), F.col(c).cast("string")))).alias(c)
    out = {}
    for name in names:
        table = spark.read.parquet(f"{path}/{name}").withColumn("project_id", F.lit(project))
        refers = {"id": name} | {c: t for c, t in (references or {}).items() if t in names}
        out[name] = table.select(*[fresh(refers[c], c) if c in refers else F.col(c) for c in table.columns])
    return out
