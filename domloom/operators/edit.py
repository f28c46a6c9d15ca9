"""Single edits of a nodes table as relational plans. Ordered pipelines of edits belong to parse(transforms=...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import SPACES, select_css

_EDGE = f"^[{SPACES}]+|[{SPACES}]+$"


def _inside(nodes: DataFrame, roots: DataFrame, id_col: str, how: str) -> DataFrame:
    """Rows of nodes strictly inside one of roots ('left_semi'), or inside none ('left_anti'). A template's content lies in its
    interval, at any depth, so one join finds all."""
    r = roots.select(F.col(id_col).alias("r_doc"), F.col("node_id").alias("r_node"), F.col("post").alias("r_post"))
    on = (F.col(id_col) == F.col("r_doc")) & (F.col("r_node") < F.col("node_id")) & (F.col("post") < F.col("r_post"))
    return nodes.join(r, on, how)


def drop_nodes(nodes: DataFrame, css: str, id_col: str = "page_id") -> DataFrame:
    """nodes without the matches and all below them. Positions and counts are those of the input."""
    hit = select_css(nodes, css, id_col)
    return _inside(nodes, hit, id_col, "left_anti").join(hit.select(id_col, "node_id"), [id_col, "node_id"], "left_anti")


def empty_nodes(nodes: DataFrame, css: str, id_col: str = "page_id") -> DataFrame:
    """nodes without what is below the matches; the root of a match's own template content stays."""
    hit = select_css(nodes, css, id_col)
    # Of nested matches the outer one rules.
    outer = _inside(hit, hit, id_col, "left_anti").select(F.col(id_col).alias("o_doc"), F.col("node_id").alias("o_node"))
    own = nodes.where("content_of IS NOT NULL").join(outer, (F.col(id_col) == F.col("o_doc")) & (F.col("content_of") == F.col("o_node")), "left_semi")
    return _inside(nodes, hit, id_col, "left_anti").unionByName(own)


def unwrap_nodes(nodes: DataFrame, css: str, id_col: str = "page_id") -> DataFrame:
    """nodes without the matches themselves: parent_id of what was below becomes the nearest kept ancestor. Template content
    is left where it is; parse(transforms=[Unwrap(...)]) hoists that too."""
    hit = select_css(nodes, css, id_col).where("NOT (name = 'template' AND namespace = 'html')")
    kept = nodes.join(hit.select(id_col, "node_id"), [id_col, "node_id"], "left_anti")
    orphans = kept.join(hit.select(F.col(id_col).alias("h_doc"), F.col("node_id").alias("h_node")), (F.col(id_col) == F.col("h_doc")) & (F.col("parent_id") == F.col("h_node")), "left_semi")
    above = kept.where("NOT startswith(name, '#text')").select(F.col(id_col).alias("a_doc"), F.col("tree_id").alias("a_tree"), F.col("node_id").alias("a_node"), F.col("post").alias("a_post"))
    on = (F.col(id_col) == F.col("a_doc")) & (F.col("tree_id") == F.col("a_tree")) & (F.col("a_node") < F.col("node_id")) & (F.col("post") < F.col("a_post"))
    near = orphans.join(above, on).groupBy(F.col(id_col).alias("n_doc"), F.col("node_id").alias("n_node")).agg(F.max("a_node").alias("nearest"))
    out = kept.join(near, (F.col(id_col) == F.col("n_doc")) & (F.col("node_id") == F.col("n_node")), "left")
    return out.withColumn("parent_id", F.coalesce("nearest", "parent_id")).drop("n_doc", "n_node", "nearest")


def text_by_document(nodes: DataFrame, id_col: str = "page_id", separator: str = " ", strip: bool = True) -> DataFrame:
    """(id_col, text): the text rows of each document in order, joined. A group is one document."""
    data: Column = F.regexp_replace("data", _EDGE, "") if strip else F.col("data")
    words = nodes.where("name = '#text'").select(id_col, "text_ord", data.alias("data")).where("data <> ''")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("text_ord", "data"))), lambda x: x["data"])
    return words.groupBy(id_col).agg(F.array_join(ordered, separator).alias("text"))
