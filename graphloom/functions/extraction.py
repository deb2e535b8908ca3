"""Entities, relations and keywords from the text that a language model returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import extracted_name, stripped

#: Fixed values of the format: field and end markers, and the spellings that models give them.
FIELD, DONE = "{tuple_delimiter}", "{completion_delimiter}"
SPELLINGS = (
    (r"<\|#\|>", FIELD),
    (r"<\|(?:COMPLETE|complete)\|>", DONE),
    (r"\\\{tuple_delimiter\\\}", FIELD),
    (r"\\\{completion_delimiter\\\}", DONE),
    (r"(?i)\{\s*tuple_delimiter\s*\}", FIELD),
    (r"(?i)\{\s*completion_delimiter\s*\}", DONE),
    (r"<\|#(?![|>])", FIELD),
    (r"(?<!<\|)#\|>", FIELD),
    (r"(?:\{tuple_delimiter\}){2,}", FIELD),
)
FIELD_PATTERN = r"\{tuple_delimiter\}"


def repaired(text: Column) -> Column:
    """Delimiters in their standard spelling; lines of four or more fields between pipes get field markers."""
    out = text
    for pattern, marker in SPELLINGS:
        out = F.regexp_replace(out, pattern, marker)
    piped = lambda line: F.lower(F.trim(line)).rlike(r"^(?:entity|relation)\|") & ~F.contains(line, F.lit(FIELD)) & (F.size(F.split(F.rtrim(line, F.lit("|")), r"\|")) >= 4)
    return F.array_join(F.transform(F.split(out, "\n"), lambda line: F.when(piped(line), F.replace(F.rtrim(line, F.lit("|")), F.lit("|"), F.lit(FIELD))).otherwise(line)), "\n")


def records(text: Column) -> Column:
    """Non-blank records between line ends and end markers."""
    return F.filter(F.split(text, r"\n|\{completion_delimiter\}|<\|COMPLETE\|>|<\|complete\|>"), lambda r: stripped(r) != "")


def unglued(record: Column) -> Column:
    """Records that were run together, each with its kind in front; entity marks are looked for first."""

    def cut(kind: str) -> Column:
        parts = F.filter(F.split(record, rf"(?i)\{{tuple_delimiter\}}{kind}\{{tuple_delimiter\}}"), lambda p: stripped(p) != "")
        return F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(kind + FIELD), p)))

    has = lambda kind: F.contains(F.lower(record), F.lit(FIELD + kind + FIELD))
    return F.when(has("entity"), cut("entity")).when(has("relation"), cut("relation")).otherwise(F.array(record))


def _fields(record: Column) -> Column:
    return F.split(stripped(record), FIELD_PATTERN)


def parsed_entity(record: Column) -> Column:
    """Struct of name, type and description, or null: four fields and a name are needed; a blank type is CONCEPT."""
    f = _fields(record)
    at = lambda i: stripped(F.get(f, F.lit(i)))
    name = extracted_name(at(1))
    ok = (F.lower(at(0)) == "entity") & (F.size(f) >= 4) & (name != "")
    return F.when(ok, F.struct(name.alias("name"), F.when(at(2) == "", "CONCEPT").otherwise(at(2)).alias("type"), at(3).alias("description")))


def parsed_relation(record: Column) -> Column:
    """Struct of src, tgt, keywords, description and weight, or null: five fields and two different names are needed."""
    f = _fields(record)
    at = lambda i: stripped(F.get(f, F.lit(i)))
    src, tgt = extracted_name(at(1)), extracted_name(at(2))
    ok = (F.lower(at(0)) == "relation") & (F.size(f) >= 5) & (src != "") & (tgt != "") & (F.lower(src) != F.lower(tgt))
    return F.when(ok, F.struct(src.alias("src"), tgt.alias("tgt"), at(3).alias("keywords"), F.when(at(4) == "", "RELATED_TO").otherwise(at(4)).alias("description"), F.lit(1.0).alias("weight")))


JSON_SCHEMA = "struct<entities:array<struct<name:string,type:string,description:string>>,relationships:array<struct<source:string,target:string,type:string,description:string>>>"


def parsed_json(response: Column) -> Column:
    """The JSON payload of a response, without a code fence around it; null if it is none."""
    body = stripped(F.regexp_replace(stripped(response), r"(?s)^```(?:json)?\s*|\s*```$", ""))
    return F.when(body.startswith("{") & body.endswith("}"), F.from_json(body, JSON_SCHEMA, {"mode": "PERMISSIVE"}))


def parse_responses(responses: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of each response, by JSON where it is JSON and by records otherwise: (id, seq, fields)."""
    base = responses.select(F.col(id_col), F.col(text_col).alias("_text"), parsed_json(F.col(text_col)).alias("_json"))
    is_json = F.col("_json.entities").isNotNull() | F.col("_json.relationships").isNotNull()
    as_json = base.filter(F.coalesce(is_json, F.lit(False)))
    e1 = as_json.select(id_col, F.posexplode("_json.entities").alias("seq", "e")).filter("trim(e.name) <> ''").select(id_col, "seq", F.col("e.name").alias("name"), F.coalesce("e.type", F.lit("CONCEPT")).alias("type"), F.coalesce("e.description", F.lit("")).alias("description"))
    r1 = as_json.select(id_col, F.posexplode("_json.relationships").alias("seq", "r")).filter("trim(r.source) <> '' AND trim(r.target) <> ''")
    r1 = r1.select(id_col, "seq", F.col("r.source").alias("src"), F.col("r.target").alias("tgt"), F.coalesce("r.type", F.lit("")).alias("keywords"), F.coalesce("r.description", F.lit("RELATED_TO")).alias("description"), F.lit(1.0).alias("weight"))
    lines = base.filter(~F.coalesce(is_json, F.lit(False))).select(id_col, F.posexplode(F.flatten(F.transform(records(repaired(F.col("_text"))), unglued))).alias("seq", "line"))
    e2 = lines.select(id_col, "seq", parsed_entity(F.col("line")).alias("e")).filter("e IS NOT NULL").select(id_col, "seq", "e.*")
    r2 = lines.select(id_col, "seq", parsed_relation(F.col("line")).alias("r")).filter("r IS NOT NULL").select(id_col, "seq", "r.*")
    return e1.unionByName(e2), r1.unionByName(r2)


def keywords(response: Column, level: str) -> Column:
    """Keywords of HIGH or LOW level: the rest of their line, cut at commas, in lower case, without blanks and "none"."""
    line = F.regexp_extract(response, rf"(?i){level}_LEVEL_KEYWORDS:\s*(.+)", 1)
    return F.filter(F.transform(F.split(line, ","), lambda k: F.lower(F.trim(k))), lambda k: (k != "") & (k != "none"))


def keep_longer(rows: DataFrame, key: Column, order: str, columns: list[str]) -> DataFrame:
    """Of rows with one key the one of the longest description; of equally long ones the first."""
    best = F.max_by(F.struct(*columns), F.struct(F.length(F.coalesce("description", F.lit(""))), F.negate(F.col(order))))
    return rows.groupBy(key.alias("_key")).agg(best.alias("r")).select("r.*")


def legacy_tuples(text: Column) -> Column:
    """Quoted three-field tuples of older cache rows: array of (name, type, description)."""
    pattern = r'\("([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\)'
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "name"), (2, "type"), (3, "description"))]
    return F.arrays_zip(*groups)


def legacy_relations(text: Column) -> Column:
    """Five-field tuples of older cache rows: array of (src, tgt, description, keywords, weight)."""
    pattern = r'\("([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*([\d.]+)\)'
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "src"), (2, "tgt"), (3, "description"), (4, "keywords"), (5, "weight"))]
    return F.transform(F.arrays_zip(*groups), lambda x: x.withField("weight", x["weight"].cast("double")))
