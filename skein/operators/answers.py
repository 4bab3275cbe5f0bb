"""Answers as Markdown. All rows given here are bounded by a budget or a limit of the query that made them."""

from __future__ import annotations

#: The fence language of a source file's suffix; others are shown as TypeScript.
FENCES = {".php": "php", ".vue": "vue", ".py": "python", ".go": "go", ".sh": "bash"}


def _place(node: dict, between: str) -> str:
    return f"{node['source_file']}{between}{node['source_location']}" if node.get("source_location") else f"{node['source_file']}"


def node_block(node: dict) -> str:
    """A node without its description."""
    rank = f" · centrality: {node.get('centrality') or 0:.2f}" if node.get("source_location") else ""
    return f"### {node['label']} ({node['type']}){rank}\n→ File: {_place(node, ' ')}"


def answer_text(question: str, nodes: list[dict], edges: list[dict], stats: dict) -> str:
    """Chosen nodes by type (files apart), then the first ten relations among them. nodes in order of choice."""
    out = [f'## "{question}"', f"_{len(nodes)} nodes · {stats['tokens_used']}/{stats['budget']} tokens ({100 * stats['coverage']:.1f}% coverage)_", ""]
    kinds: dict[str, list[dict]] = {}
    for n in nodes:
        kinds.setdefault(n["type"], []).append(n)
    for kind, group in kinds.items():
        if kind != "file":
            out.append(f"### {kind[:1].upper()}{kind[1:]}s")
            out += [line for n in group for line in (node_block(n), "")]
    label = {n["id"]: n["label"] for n in nodes}
    if edges:
        shown = dict.fromkeys((e["source"], e["target"]) for e in edges[:10])
        out.append("### Key relations")
        for e in edges[:10]:
            if shown.pop((e["source"], e["target"]), 0) is None and {e["source"], e["target"]} <= label.keys():
                out.append(f"- {label[e['source']]} → **{e['relation']}** → {label[e['target']]}{' _[inferred]_' if e['confidence'] == 'INFERRED' else ''}")
    if nodes and stats["coverage"] < 1:
        out += ["", "---", "More connected nodes exist; a larger budget includes them."]
    return "\n".join(out)


def snippets_text(rows: list[dict]) -> str:
    """rows (source_file, label, first, snippet) of relevance.snippets, in order."""
    out = []
    for r in rows:
        fence = next((v for k, v in FENCES.items() if r["source_file"].endswith(k)), "ts")
        out += [f"### Source: {r['label']} (`{r['source_file']}:{r['first']}`)", f"```{fence}", r["snippet"], "```", ""]
    return "\n" + "\n".join(out) if out else ""


def search_text(query: str, rows: list[dict]) -> str:
    if not rows:
        return f'No results for "{query}". Try other terms or a prefix ("{query}*").'
    hits = [f"- **{r['label']}** ({r['type']}) @ `{r['file']}`" + (f" — {r['description'][:100]}" if r["description"] else "") for r in rows]
    return "\n".join([f'## Search results for "{query}"', "", *hits, "", f"_{len(rows)} results_"])


def tree_text(rows: list[dict], nodes: dict[str, dict], indent: str = "") -> list[str]:
    """Box-drawn dependents of one start: rows (node_id, parent_id, depth, pos)."""
    kids: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        kids.setdefault(r["parent_id"], []).append(r)
    out: list[str] = []

    def walk(at: str, lead: str) -> None:
        mine = kids.get(at, [])
        for i, r in enumerate(mine):
            n, last = nodes[r["node_id"]], i == len(mine) - 1
            where = f" @ {_place(n, ':')}" if n["source_file"] else ""
            out.append(f"{lead}{'└── ' if last else '├── '}[d={r['depth']}] {n['label']} ({n['type']}){where}")
            walk(r["node_id"], lead + ("    " if last else "│   "))

    for start in {r["parent_id"] for r in rows} - {r["node_id"] for r in rows}:
        walk(start, indent)
    return out


def impact_text(target: dict, rows: list[dict], nodes: dict[str, dict], methods: list[tuple[str, list[dict]]], most: int) -> str:
    """rows: the target's dependents; methods: (label, dependents) of its methods where a class has none itself."""
    out = [f"## Impact of {target['label']}", f"_{target['type']} @ {_place(target, ':') if target['source_file'] else 'unknown'}_", ""]
    if rows:
        out += tree_text(rows, nodes)
        if sum(r["depth"] == 1 for r in rows) >= most:
            out += ["", f"_Truncated at {most} results. Try a narrower name._"]
    elif target["type"] == "class":
        out += ["No direct dependents of this class. Dependents of its methods:", ""]
        for label, own in methods:
            out += [f"  {label}:", *tree_text(own, nodes, "    ")]
        if not methods:
            out.append("No dependents of any method of this class.")
    else:
        out.append("No dependents in the graph.")
    return "\n".join(out)


def explain_text(node: dict, connections: int, relations: list[dict], shown: int = 15) -> str:
    """relations: relation, n and the first ``shown`` lines of each, in the order of their first edges."""
    out = [f"## {node['label']} ({node['type']})", f"- **File:** `{node['source_file']}`{' ' + node['source_location'] if node.get('source_location') else ''}"]
    out += [f"- **Community:** {'—' if node.get('community') is None else node['community']}", f"- **Connections:** {connections}"]
    out += [f"- **Description:** {node['description']}"] if node.get("description") else []
    out.append("")
    if relations:
        out.append("### Relations")
        for r in relations:
            out += [f"#### {r['relation']} ({r['n']})", *(f"- {line}" for line in r["shown"])]
            out += [f"- … and {r['n'] - shown} more"] if r["n"] > shown else []
    return "\n".join(out)


def summary_text(stats: dict, extensions: list[tuple[str, int]], cached: int, extracted: int, directed: bool, top: list[tuple[str, int]]) -> str:
    """What a build made."""
    files = f"{cached} cached, {extracted} extracted" if cached else f"{extracted} extracted"
    spoken = ", ".join(f"`{e}`×{n}" for e, n in extensions) or "none"
    rows = [("Files", f"{cached + extracted} ({files})"), ("Languages", spoken), ("Nodes", stats["n_nodes"]), ("Edges", stats["n_edges"]), ("Communities", stats["n_communities"]), ("Mode", "directed" if directed else "undirected")]
    out = ["**Graph built**", "", "| Metric | Value |", "|--------|-------|", *(f"| {k} | {v} |" for k, v in rows)]
    if top:
        out += ["", "### Most connected", *(f"{i}. **{label}** — {n} connections" for i, (label, n) in enumerate(top, 1))]
    return "\n".join(out)
