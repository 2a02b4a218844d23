"""Short summaries of files by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.scopes import stem

#: Characters of a text that are looked at, and of a summary.
LOOKED_AT, LONGEST = 2000, 300


def outline(markdown: Column) -> Column:
    heads = F.slice(F.regexp_extract_all(markdown, F.lit(r"(?m)^#+[ ]+(.*)"), F.lit(1)), 1, 6)
    return F.concat(F.lit("Structure: "), F.array_join(heads, " > "))


def json_keys(text: Column) -> Column:
    keys = F.json_object_keys(text)
    return F.concat(F.lit("Keys: "), F.array_join(F.slice(keys, 1, 15), ", "), F.lit(" (total "), F.size(keys).cast("string"), F.lit(")"))


def symbols(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:class|def|function|fn|struct)\s+(\w+)"), F.lit(1))
    return F.concat(F.lit("Symbols: "), F.array_join(F.slice(F.array_distinct(found), 1, 15), ", "))


def headers(csv: Column) -> Column:
    return F.concat(F.lit("Columns: "), F.array_join(F.transform(F.split(F.split(csv, "\n")[0], ","), lambda c: F.trim(c)), ", "))


def embedding_text(summary: Column, path: Column) -> Column:
    """A summary without its label and marks, led by the file's stem unless it holds it."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(summary, r"^(?:\[[^\]]*\]\s*)?(?:Structure|Keys|Symbols|Columns):\s*", ""), r"[>,\s]+", " "))
    return F.when(F.contains(F.lower(plain), F.lower(stem(path))), plain).otherwise(F.concat_ws(" ", stem(path), plain))


def summarise(files: DataFrame) -> DataFrame:
    """file_id, summary, embedding_text of files (file_id, path, type, text), from the start of each text."""
    head = F.substring("text", 1, LOOKED_AT)
    by_kind = (
        F.when(F.col("type") == "md", outline(head)).when(F.col("type") == "py", symbols(head)).when(F.col("type") == "csv", headers(head))
        .when(F.col("type") == "json", json_keys(F.col("text"))).otherwise(F.trim(F.regexp_replace(head, r"\s+", " ")))
    )
    short = F.substring(by_kind, 1, LONGEST)
    return files.select("file_id", short.alias("summary"), embedding_text(short, F.col("path")).alias("embedding_text"))
