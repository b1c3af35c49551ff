"""Code-graph analytics on Spark: extraction, resolution, search, traversal, diff and edit plans."""

from graphloom.graph import Graph
from graphloom.operators.extract import build_graph
from graphloom.plans.diff import ChangeSet, diff_graphs
from graphloom.plans.edit_plan import EditPlan, edit_plan
from graphloom.session import build_session

__all__ = ["Graph", "build_graph", "ChangeSet", "diff_graphs", "EditPlan", "edit_plan", "build_session"]
