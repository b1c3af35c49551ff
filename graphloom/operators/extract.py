"""From syntax facts to entities and relationships: projections and explodes over one parse."""

from __future__ import annotations

import gc
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from graphloom.functions.names import SEPARATOR, ancestor_ids, is_constant_name, looks_like_class
from graphloom.functions.syntax import FACT_SCHEMA, fact_arrow_schema, file_facts
from graphloom.graph import Graph, ParsedGraph, dense_numbers
from graphloom.schema import ENTITY_COLUMNS
from graphloom.session import dealt, materialize, parse_tasks

#: Files read and facts handed on at once: a worker holds no more of them as Python objects.
FILES_AT_ONCE, ROWS_PER_FRAME = 500, 5_000
FACT_TYPES = dict(field.split(" ") for field in FACT_SCHEMA.split(", "))
FACT_COLUMNS = tuple(FACT_TYPES)
# Kinds of facts that become entities.
ENTITY_KINDS = ("module", "class", "function", "async", "variable", "import")
# A position is the file's number times this, plus the place inside the file.
FILE_SPAN = 2**27


def _parse(batches, kinds: tuple[str, ...] | None, columns: tuple[str, ...]):
    fields = fact_arrow_schema()
    schema = pa.schema([fields.field(c) for c in columns])
    places = [fields.get_field_index(c) for c in columns]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        values = [*zip(*rows)] if rows else [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(values[i], f.type) for i, f in zip(places, schema)], schema=schema)

    rows: list[tuple] = []
    for batch in (b.slice(i, FILES_AT_ONCE) for b in batches for i in range(0, max(1, b.num_rows), FILES_AT_ONCE)):
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
            facts = _facts_of(path, content)
            rows.extend(facts if kinds is None else [fact for fact in facts if fact[1] in kinds])
            if len(rows) >= ROWS_PER_FRAME:
                yield frame(rows)
                rows = []
    yield frame(rows)


def _facts_of(path: str, content) -> list[tuple]:
    """Facts of one file. Its tree holds no cycles, so the collector need not search it over and over."""
    collects = gc.isenabled()
    gc.disable()
    try:
        return file_facts(path, content)
    finally:
        if collects:
            gc.enable()


def syntax_facts(
    sources: DataFrame, spread: bool = False, kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] = FACT_COLUMNS
) -> DataFrame:
    """Parse every file of (path, content) once; unreadable or invalid files give an ``error`` row.

    Files are parsed where they are read (``read_files`` spreads the listing, not the contents).
    ``spread`` deals out contents that come from a few large partitions. ``kinds`` and ``columns`` say
    which facts and what of them is asked for; the rest does not leave the Python workers.
    """
    rows = sources.select("path", "content")
    rows = rows.repartition(parse_tasks(sources.sparkSession)) if spread else rows
    schema = ", ".join(f"{c} {FACT_TYPES[c]}" for c in columns)
    return rows.mapInArrow(partial(_parse, kinds=kinds, columns=columns), schema)


def stored_facts(sources: DataFrame, kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] = FACT_COLUMNS) -> DataFrame:
    """The facts of (path, content) as a table bucketed by path: what is grouped, ordered or numbered by
    file afterwards moves no rows. Sources are shuffled instead, which are a fraction of their facts."""
    return materialize(syntax_facts(dealt(sources.select("path", "content"), "path"), kinds=kinds, columns=columns), by="path")


def stored_spans(sources: DataFrame) -> DataFrame:
    """Entities of (path, content) with type and lines only, in the places of their files as ``ord``: what
    looks up lines needs neither calls and texts nor numbers of files."""
    facts = stored_facts(sources, ENTITY_KINDS, ("path", "kind", "pre", "sub", "name", "owner_names", "line", "end_line"))
    whole = facts.select("*", *[F.lit(None).cast(t).alias(c) for c, t in FACT_TYPES.items() if c not in facts.columns])
    return materialize(merged_entities(whole, ["type", "line_number", "end_line"]).selectExpr("place as ord", "id", "file_path", "v.*"))


def parse_errors(facts: DataFrame) -> DataFrame:
    """Files that gave no entities, with the reason: (path, reason)."""
    return facts.filter("kind = 'error'").select("path", F.col("name").alias("reason"))


SCOPED_ID = "concat_ws('::', path, if(size(owner_names) > 0, array_join(owner_names, '::'), null), name)"


def parsed_entities(facts: DataFrame, file_rows: bool = True) -> DataFrame:
    """One row per definition with its place in the file, repeated ids included.

    With ``file_rows`` a file also gives a FILE row with the id of its MODULE row.
    """
    variable_type = F.when(is_constant_name(F.col("name")), "CONSTANT").otherwise("VARIABLE")
    roles = "array('FILE', 'MODULE')" if file_rows else "array('MODULE')"
    return (
        facts.filter("kind not in ('call', 'error')")
        .withColumn("variable_type", variable_type)
        # One pass: only a module fact can stand for two rows.
        .selectExpr("*", f"explode(if(kind = 'module', {roles}, array(''))) as role")
        .selectExpr(
            "path as file_path",
            "if(role = 'FILE', -1, pre + sub) as place",
            f"case kind when 'module' then path when 'import' then concat(path, '::import:', name) else {SCOPED_ID} end as id",
            "if(kind = 'module', path, name) as name",
            "case kind when 'module' then role when 'class' then 'CLASS' when 'function' then 'FUNCTION' "
            "when 'async' then 'ASYNC_FUNCTION' when 'import' then 'IMPORT' else variable_type end as type",
            "line as line_number",
            "end_line",
            "case when role = 'FILE' then to_json(named_struct('description', concat('File: ', path))) "
            "when kind = 'variable' then to_json(named_struct("
            "'description', concat(variable_type, ': ', name), 'type_annotation', annotation)) "
            "when kind = 'import' then to_json(named_struct("
            "'description', if(module is null, concat('Import: ', original_name), concat('From ', module, ' import ', original_name)), "
            "'module', module, 'original_name', original_name)) else properties end as properties",
        )
    )


def parsed_relationships(facts: DataFrame) -> DataFrame:
    """Unresolved edges with their order inside the file (``k``).

    A call or assignment belongs to every enclosing definition, so the chain of owners recorded
    at parse time is exploded instead of walking each definition again. All edges come from one
    explode of the facts, which keeps the rows of a file where they are.
    """
    defined = F.expr("kind not in ('call', 'module')")
    contains = F.when(defined & F.col("id").contains(SEPARATOR), F.transform(ancestor_ids(F.col("id")), lambda up, i: F.struct(
        F.expr("named_struct('a', 0, 'b', pre + sub)").withField("c", i + 1).withField("d", F.lit(0)).withField("e", F.lit(0)).alias("k"),
        up.alias("source_id"), F.col("id").alias("target_id"), F.lit("CONTAINS").alias("type"),
    )))
    imports = F.expr("if(kind = 'import', array(named_struct('k', named_struct('a', 1, 'b', pre + sub, 'c', 0, 'd', 0, 'e', 0), "
                     "'source_id', path, 'target_id', id, 'type', 'IMPORTS')), null)")
    inherits = F.expr("if(kind = 'class', transform(bases, (base, i) -> named_struct('k', named_struct('a', 2, 'b', pre, 'c', 0, 'd', 0, 'e', i), "
                      "'source_id', id, 'target_id', base, 'type', 'INHERITS')), null)")
    # Class bodies own only calls that look like an instantiation.
    source = "concat_ws('::', path, array_join(slice(owner_names, 1, i + 1), '::'))"
    type_ = "case when kind = 'variable' then 'DEFINES_IN' when in_class or (class_like and not is_method) then 'INSTANTIATES' else 'CALLS' end"
    type_ = type_.replace("in_class", "substring(owner_kinds, i + 1, 1) = 'c'")
    owned = F.expr(
        "if(kind in ('call', 'variable'), array_compact(transform(owner_pres, (owner_pre, i) -> "
        "if(substring(owner_kinds, i + 1, 1) = 'c' and not (kind = 'call' and class_like), null, named_struct("
        "'k', named_struct('a', 2, 'b', owner_pre, 'c', if(kind = 'variable', 2, 1), 'd', depth, 'e', pre + sub), "
        f"'source_id', {source}, 'target_id', if(kind = 'variable', concat({source}, '::local:', name), name), 'type', {type_})))), null)"
    )
    return (
        facts.filter("kind <> 'error'")
        .withColumn("class_like", looks_like_class(F.col("name")))
        .withColumn("id", F.expr(f"if(kind = 'import', concat(path, '::import:', name), {SCOPED_ID})"))
        .select("path", "line", F.explode(F.flatten(F.array_compact(F.array(contains, imports, inherits, owned)))).alias("edge"))
        .selectExpr("path as file_path", "edge.k", "edge.source_id", "edge.target_id", "edge.type", "line as line_number")
    )


def type_hints(facts: DataFrame) -> DataFrame:
    """``x = C(...)``, ``x = m.C(...)`` and ``x: C``: (file_path, variable, class_name, walk order)."""
    return facts.filter("kind = 'variable' and type_hint is not null").selectExpr(
        "path as file_path", "name as variable", "type_hint as class_name", "named_struct('depth', depth, 'pre', pre) as walk"
    )


def file_numbers(facts: DataFrame) -> DataFrame:
    """Consecutive numbers of the files in path order: (file_path, file_no)."""
    return dense_numbers(facts.filter("kind = 'module'").select(F.col("path").alias("file_path")), "file_path", "file_no")


def merged_entities(facts: DataFrame, values: list[str]) -> DataFrame:
    """Per file and id the first place and, as ``v``, the last definition's values."""
    return parsed_entities(facts, file_rows=False).groupBy("file_path", "id").agg(
        F.min("place").alias("place"), F.max_by(F.struct(*values), "place").alias("v")
    )


def graph_entities(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Entities of the graph: per id the last definition's values at the first one's position."""
    return merged_entities(facts, [c for c in ENTITY_COLUMNS if c not in ("ord", "id", "file_path")]).join(files, "file_path").selectExpr(
        f"file_no * {FILE_SPAN} + place as ord", "id", *[f"v.{c}" if c != "file_path" else c for c in ENTITY_COLUMNS[2:]]
    )


def graph_relationships(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Parsed edges numbered by file and place. A file was one task's input, so is its window."""
    in_file = Window.partitionBy("file_path").orderBy("k")
    return (
        parsed_relationships(facts)
        .withColumn("place", F.row_number().over(in_file))
        .join(files, "file_path")
        .selectExpr(
            f"file_no * {FILE_SPAN} + place as ord", "source_id", "target_id", "type", "line_number",
            "1D as weight", "false as is_resolved", "'{}' as properties",
        )
    )


def numbered_graph(facts: DataFrame, files: DataFrame) -> Graph:
    """The unresolved graph of ``facts``; entities are a table bucketed by file, edges one that is written
    when they are first read."""
    entities = materialize(graph_entities(facts, files), by="file_path")
    last = files.agg(F.max("file_no")).first()[0]
    span = (0 if last is None else last + 1) * FILE_SPAN + 1
    return ParsedGraph(entities, facts, lambda some: graph_relationships(some, files), parsed_relationships, span)


def build_graph(sources: DataFrame, internal_prefixes: tuple[str, ...] = (), resolve: bool = True) -> Graph:
    """Sources (path, content) to a graph with cross-file resolution, written as tables.

    The one parse is written first, since entities, edges and type hints all read it.
    """
    from graphloom.operators.resolve import resolve_graph

    facts = stored_facts(sources)
    graph = numbered_graph(facts, materialize(file_numbers(facts)))
    return resolve_graph(graph, type_hints(facts), internal_prefixes) if resolve else graph
