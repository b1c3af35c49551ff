"""Small graphs and row sets for the tests."""

from graphloom.graph import Graph, complete_entities, complete_relationships


def make_graph(spark, entities, edges) -> Graph:
    """Entities (id, name, type, file, line, end) and edges (source, target, type, line), in order."""
    rows = [(i, *e) for i, e in enumerate(entities)]
    links = [(i, *e) for i, e in enumerate(edges)]
    return Graph(
        complete_entities(spark.createDataFrame(
            rows, "ord long, id string, name string, type string, file_path string, line_number int, end_line int")),
        complete_relationships(spark.createDataFrame(
            links, "ord long, source_id string, target_id string, type string, line_number int")),
    )


def pairs(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}
