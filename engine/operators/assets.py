"""Views of visual-script assets and their chunks.

Assets: name, path, parent_class, graphs (name, nodes, links or edges), functions, variables, components, each of the last five an array of JSON texts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engine.operators.chunking import Limits, code_parts, count


def ordered(text: str | None) -> str | None:
    """JSON with its keys in order; what isn't JSON stays."""
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False)
    except ValueError:
        return text


def sorted_json(column: Column | str) -> Column:
    return F.pandas_udf(lambda texts: texts.map(ordered), "string")(column)


def _lines(title: str, values: Column) -> Column:
    return F.concat(F.lit(f"{title}:\n"), F.array_join(values, "\n"))


def _sorted_array(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def views(assets: DataFrame, version: str, graph: str | None = None) -> DataFrame:
    """id, asset, view, name, content: a summary, each graph, each function, the variables and the components of each asset; only graphs and functions of a name, if given."""
    size = lambda c: F.size(_sorted_array(c)).cast("string")
    name_of = lambda c: F.get_json_object(c, "$.name")
    summary = F.concat_ws("\n", F.concat(F.lit("Asset: "), "name"), F.concat(F.lit("Path: "), "path"), F.concat(F.lit("Parent: "), F.coalesce("parent_class", F.lit("none"))), *[F.concat(F.lit(f"{x.capitalize()}: "), size(x)) for x in ("graphs", "functions", "variables", "components")])
    base = assets.select("name", "path", "parent_class", "graphs", "functions", "variables", "components")
    out = base.select(F.col("path").alias("asset"), F.lit("summary").alias("view"), "name", summary.alias("content"))
    for kind in ("graph", "function"):
        each = base.select("path", F.explode(_sorted_array(f"{kind}s")).alias("x"))
        # edges are another name of links
        text = F.regexp_replace("x", r'"edges"\s*:', '"links":')
        rows = each.select(F.col("path").alias("asset"), F.lit(kind).alias("view"), name_of(F.col("x")).alias("name"), sorted_json(text).alias("content"))
        out = out.unionByName(rows.where(F.col("name") == graph) if graph else rows)
    for kind in ("variables", "components"):
        each = base.where(F.size(kind) > 0).select("path", "name", F.posexplode(kind).alias("n", "x")).withColumn("x", sorted_json("x"))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda v: v["x"])
        rows = each.groupBy("path", "name").agg(_lines(kind.capitalize(), lines).alias("content"))
        out = out.unionByName(rows.select(F.col("path").alias("asset"), F.lit(kind).alias("view"), "name", "content"))
    return out.withColumn("id", F.concat(F.lit("asset-"), F.sha2(F.concat_ws("|", F.lit(version), "asset", "view", "name"), 256)))


def view_chunks(text: str, view: str, header: str, limits: Limits) -> list[tuple[int, int, str]]:
    """Part, parts and text; only graphs are split, by lines."""
    parts = code_parts(text, limits) if view == "graph" and count(text) > limits.most else [text]
    return [(i + 1, len(parts), f"{header}\n{x}") for i, x in enumerate(parts)]
