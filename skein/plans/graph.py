"""Workflow graphs on the driver: decoding, lint, cycles, order, entry and exit, and the choice of an engine.

A graph is one JSON document and small; tables of many graphs are handled by ``skein.operators.graphs``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from skein.functions.jsontree import BROKEN, decode


class GraphError(ValueError):
    """The graph cannot be planned."""


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    data: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    source: str
    target: str


@dataclass(frozen=True)
class Graph:
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]

    def unique(self) -> dict[str, Node]:
        """Nodes by id; of several of one id the last one counts, at the place of the first."""
        return {node.id: node for node in self.nodes}


def parse(flow: str) -> Graph:
    """The graph of a flow document; the type inside ``data`` wins over the outer one unless that is ``default``."""
    document = decode(flow)
    if document is BROKEN or not isinstance(document, dict):
        raise GraphError("the flow is not a JSON object")
    if not isinstance(document.get("nodes"), list) or not isinstance(document.get("edges"), list):
        raise GraphError("the flow needs lists of nodes and edges")
    nodes = []
    for item in document["nodes"]:
        data = item.get("data") if isinstance(item.get("data"), dict) else {}
        outer = item.get("type")
        nodes.append(Node(str(item.get("id")), str(data.get("type") or ("" if outer == "default" else outer) or ""), data))
    return Graph(tuple(nodes), tuple(Edge(str(x.get("source")), str(x.get("target"))) for x in document["edges"]))


def java_order(names: Iterable[str]) -> list[str]:
    """Names in the order in which a hash table of the JVM iterates over them.

    The table has 16 places, doubled whenever more than three quarters are used; a place is chosen by the string hash
    folded once, and names of one place keep the order of insertion.
    """
    kept = list(dict.fromkeys(names))
    places = 16
    while len(kept) > places * 3 // 4:
        places *= 2

    def place(name: str) -> int:
        code = 0
        units = name.encode("utf-16-be")
        for i in range(0, len(units), 2):
            code = (code * 31 + (units[i] << 8 | units[i + 1])) & 0xFFFFFFFF
        return (code ^ code >> 16) & (places - 1)

    return sorted(kept, key=place)


def _ordered(names: Iterable[str], tie_order: str) -> list[str]:
    return java_order(names) if tie_order == "java_hash" else list(dict.fromkeys(names))


def predecessors(graph: Graph) -> dict[str, list[str]]:
    """Sources of the edges into each node; an edge that names an unknown node is an error."""
    found: dict[str, list[str]] = {name: [] for name in graph.unique()}
    for edge in graph.edges:
        for end in (edge.source, edge.target):
            if end not in found:
                raise GraphError(f"an edge names the unknown node {end}")
        found[edge.target].append(edge.source)
    return found


def topological(graph: Graph, tie_order: str = "list") -> list[Node]:
    """All nodes, sources first; a cycle is an error.

    First come the nodes without incoming edges, then each node when its last source is done, first in, first out. Ties
    follow the list of nodes, or with ``java_hash`` the iteration order of a JVM hash table of their ids.
    """
    before = predecessors(graph)
    after: dict[str, list[str]] = {name: [] for name in before}
    for target in _ordered(before, tie_order):
        for source in before[target]:
            after[source].append(target)
    waiting = {name: len(sources) for name, sources in before.items()}
    queue = deque(name for name in _ordered(before, tie_order) if not waiting[name])
    nodes, order = graph.unique(), []
    while queue:
        name = queue.popleft()
        order.append(nodes[name])
        for target in after[name]:
            waiting[target] -= 1
            if not waiting[target]:
                queue.append(target)
    if len(order) < len(nodes):
        raise GraphError("the workflow has a cycle through " + ", ".join(name for name, n in waiting.items() if n))
    return order


def entry(graph: Graph) -> Node:
    """The first node without incoming edges, else the first node."""
    targets = {edge.target for edge in graph.edges}
    return next((node for node in graph.nodes if node.id not in targets), graph.nodes[0])


def exit_node(graph: Graph) -> Node:
    """The first node without outgoing edges, else the last node."""
    sources = {edge.source for edge in graph.edges}
    return next((node for node in graph.nodes if node.id not in sources), graph.nodes[-1])


def reachable(graph: Graph, tie_order: str = "list") -> list[Node]:
    """The nodes reachable from the single entry, in topological order."""
    after: dict[str, list[str]] = {}
    for edge in graph.edges:
        after.setdefault(edge.source, []).append(edge.target)
    seen, front = {entry(graph).id}, [entry(graph).id]
    while front:
        front = [name for source in front for name in after.get(source, ()) if name not in seen and not seen.add(name)]
    return [node for node in topological(graph, tie_order) if node.id in seen]


def select_engine(name: str | None) -> str:
    return "langgraph" if (name or "").strip().lower() == "langgraph" else "dag"


#: Fields that nodes of each kind offer to references (fixed values); other kinds offer ``output``.
CATALOGUE = {"input": ("user_input",), "tts": ("audioUrl", "fileName", "output")} | {x: ("output", "tokens") for x in ("llm", "openai", "deepseek", "qwen", "zhipu", "step", "ai_ping")}


def lint(graph: Graph) -> list[str]:
    """What would go wrong or surprise at run time: unknown references and template names, parameters without a value, custom outputs before speech."""
    import re

    found = []
    nodes = graph.unique()
    for node in nodes.values():
        params = [x for key in ("inputParams", "outputParams") for x in node.data.get(key) or () if isinstance(x, dict)]
        names = {x.get("name") for x in params}
        for param in params:
            if not param.get("name"):
                found.append(f"{node.id}: a parameter has no name")
            reference = param.get("referenceNode")
            if param.get("type") == "reference":
                if not reference or "." not in reference:
                    found.append(f"{node.id}: {param.get('name')} refers to nothing")
                elif reference.split(".")[0] not in nodes:
                    found.append(f"{node.id}: {param.get('name')} refers to the unknown node {reference.split('.')[0]}")
            elif param.get("type") == "input" and param.get("value") is None:
                found.append(f"{node.id}: {param.get('name')} has no value")
        for text in (node.data.get("prompt"), node.data.get("responseContent")):
            found += [f"{node.id}: the template names the unknown {name}" for name in re.findall(r"\{\{(\w+)\}\}", text or "") if name not in names]
        if node.type not in ("input", "output", "tts") and node.data.get("outputParams"):
            if any(nodes[edge.target].type == "tts" for edge in graph.edges if edge.source == node.id and edge.target in nodes):
                found.append(f"{node.id}: with custom outputs the next node gets no output")
    return found


def without_node(graph: Graph, name: str) -> Graph:
    """The graph without a node and the edges that touch it."""
    return Graph(tuple(x for x in graph.nodes if x.id != name), tuple(x for x in graph.edges if name not in (x.source, x.target)))
