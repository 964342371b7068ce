"""Writers: incremental stores, small reports, manifests and the graph as a file."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.sources.files import exists, write_text

#: Rows that a report on the driver's side may have.
MAX_REPORT_ROWS = 100_000


def append_missing(rows: DataFrame, path: str, key: str, derive: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Appends rows whose key the Parquet store lacks, each key once; returns how many. Nothing is rewritten.

    ``derive`` adds what is computed of a row; it is given only the rows that the store lacks.
    """
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh = (fresh if derive is None else derive(fresh)).persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(path)
        return n
    finally:
        fresh.unpersist()


def write_new(rows: DataFrame, path: str) -> None:
    """Writes Parquet where nothing is yet; an existing target is an error."""
    rows.write.mode("errorifexists").parquet(path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_extraction(passage_mentions: DataFrame, sentence_mentions: DataFrame, folder: str) -> None:
    """Results of an extraction: entities of passages and entities of sentences, each a table that replaces the last one."""
    passage_mentions.write.mode("overwrite").parquet(f"{folder}/passage_entities")
    sentence_mentions.write.mode("overwrite").parquet(f"{folder}/sentence_entities")


def write_json_report(rows: DataFrame, path: str) -> None:
    """A small result as one JSON array; more than MAX_REPORT_ROWS is an error."""
    write_text(rows.sparkSession, json.dumps([json.loads(r) for r in _small(rows.toJSON().take(MAX_REPORT_ROWS + 1))], ensure_ascii=False, indent=2), path)


def write_csv_report(rows: DataFrame, path: str) -> None:
    """A small result as one CSV file with a byte order mark, for spreadsheets."""
    found = _small(rows.take(MAX_REPORT_ROWS + 1))
    cell = lambda v: "" if v is None else f'"{str(v).replace(chr(34), chr(34) * 2)}"' if any(c in str(v) for c in ',"\n') else str(v)
    lines = [",".join(rows.columns), *(",".join(cell(v) for v in r) for r in found)]
    write_text(rows.sparkSession, "﻿" + "\n".join(lines) + "\n", path)


def _xml(text: F.Column) -> F.Column:
    """Text as it may stand in XML, attributes included."""
    text = F.coalesce(text, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def graph_document(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a GraphML document, each vertex and edge made where its row is: part, line."""
    node = F.concat(F.lit('<node id="'), _xml(F.col("node_id")), F.lit('"><data key="content">'), _xml(F.col("content")), F.lit("</data></node>"))
    ends = F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")))
    link = F.concat(ends, F.lit('"><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>"))
    return vertices.select(F.lit(1).alias("part"), node.alias("line")).unionByName(edges.select(F.lit(2).alias("part"), link.alias("line")))


def write_graph(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    """GraphML in parts: head, the vertices' and edges' lines, tail; concatenated in this order they are one document."""
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="content" for="node" attr.name="content" attr.type="string"/><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">'
    lines = graph_document(vertices, edges)
    write_text(vertices.sparkSession, head + "\n", f"{folder}/0-head")
    lines.filter("part = 1").select("line").write.mode("errorifexists").text(f"{folder}/1-nodes")
    lines.filter("part = 2").select("line").write.mode("errorifexists").text(f"{folder}/2-edges")
    write_text(vertices.sparkSession, "</graph></graphml>\n", f"{folder}/3-tail")


def _small(found: list) -> list:
    if len(found) > MAX_REPORT_ROWS:
        raise ValueError(f"a report of more than {MAX_REPORT_ROWS} rows")
    return found

