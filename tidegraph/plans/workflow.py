"""The analysis from a question to a briefing, as steps over one graph.

Models and searches are callables given by the caller; each has a deterministic stand-in. Only small
results (top lists, single rows) reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import risk as R
from ..operators.documents import expand_query, findings, first_by_url
from ..operators.lookup import gazetteer, mentions_in

STEPS = ("coordinator", "collect", "analyse", "assess", "brief")


def focus_of(g: G.Graph, query: str, most: int = 8) -> DataFrame:
    """(id, name): vertices named in the query, longest pattern first; else the three greatest hubs."""
    spark = g.vertices.sparkSession
    text = spark.createDataFrame([(0, query)], "k int, text string")
    pat = gazetteer(g.vertices)
    hit = mentions_in(text, "text", "k", pat).select("id")
    named = pat.join(hit, "id", "left_semi").groupBy("id").agg(F.max(F.length("pattern")).alias("n")).orderBy(F.desc("n"), "id").limit(most)
    got = named.join(g.vertices.select("id", "name"), "id").select("id", "name")
    return got if not got.isEmpty() else G.hubs(g, 3).select("id", "name")


def analyse(g: G.Graph, query: str) -> dict:
    """Focus, hubs, exposure, chains and stats of the graph for a question; a step that fails is noted and the others go on."""
    out: dict = {"errors": []}
    focus = focus_of(g, query)
    out["focus"] = [r.asDict() for r in focus.collect()]

    def step(name: str, run: Callable[[], list]) -> None:
        try:
            out[name] = [r.asDict(recursive=True) for r in run()]
        except Exception as e:  # noqa: BLE001
            out[name] = []
            out["errors"].append(f"{name}: {str(e)[:200]}")

    step("hubs", lambda: G.hubs(g, 10).collect())
    step("exposure", lambda: G.exposure_report(g).where("exposure_score > 0").orderBy(F.desc("exposure_score"), "id").limit(10).collect())
    step("chains", lambda: G.with_names(G.dependency_chains(g, focus), g.vertices).orderBy(F.desc("hops"), "path").limit(3).collect())
    step("critical_paths", lambda: G.critical_paths(g, focus).collect())
    step("stats", lambda: G.traversal_stats(g, focus.limit(5)).orderBy("root").collect())
    out["vertices"], out["edges"] = g.vertices.count(), g.edges.count()
    return out


def graph_findings(a: dict) -> list[str]:
    out = []
    if a.get("hubs"):
        out.append(f"{a['hubs'][0]['name']} is the best connected entity ({a['hubs'][0]['degree']} edges)")
    high = [e for e in a.get("exposure", ()) if e["exposure_score"] >= 0.6]
    if high:
        out.append(f"{len(high)} of the most exposed organizations score 0.6 or more")
    if a.get("chains"):
        out.append("Longest dependency chain: " + " > ".join(x["name"] for x in a["chains"][0]["named"]))
    near = [p for p in a.get("critical_paths", ()) if p["hops"] <= 2]
    if near:
        out.append(f"{len(near)} critical pairs are two edges apart or less")
    return [*out, f"The graph holds {a.get('vertices', 0)} entities and {a.get('edges', 0)} relationships"]


def assess(g: G.Graph, threats: DataFrame) -> dict:
    scores = G.exposure_report(g)
    a = R.indicators(R.assess(scores, g.edges.where("rel_type = 'THREATENS'"), R.risk_matrix(threats)), sources=1)
    return a.head().asDict(recursive=True)


# The sections of a briefing in their order.
SECTIONS = ("Executive summary", "Key findings", "Graph", "Risk", "Exposure", "Posture", "Recommendations", "Outlook")


def briefing(query: str, graph_part: dict | None, risk: dict | None, evidence: list[str]) -> str:
    """The text of all sections; a part that is missing reads UNDETERMINED."""
    g, r = graph_part or {}, risk or {}
    level, score = r.get("level") or "UNDETERMINED", r.get("score") or 0.0
    bars = [f"  {e['name'][:30]:<30} {'#' * int(e['exposure_score'] * 20):<24} {e['exposure_score']:.2f}" for e in g.get("exposure", ())[:10]]
    body = {
        "Executive summary": [f"{query}: {level} ({score:.2f}), {len(evidence)} findings, {len(g.get('focus', ()))} entities in focus"],
        "Key findings": [f"{i}. {x}" for i, x in enumerate([*evidence[:3], *graph_findings(g)[:3]] if g else evidence[:3], 1)],
        "Graph": [f"{h['name']}: {h['degree']}" for h in g.get("hubs", ())[:5]] + [f"error: {e}" for e in g.get("errors", ())[:5]],
        "Risk": [f"level {level}, score {score:.2f}, basis {r.get('basis', 'none')}", *r.get("escalation", ()), *r.get("mitigation", ())],
        "Exposure": bars + [f"{sum(e['exposure_score'] >= 0.6 for e in g.get('exposure', ()))} at 0.6 or more"],
        "Posture": ["Watch the entities in focus."],
        "Recommendations": ["Review the entities of high exposure first."],
        "Outlook": ["Run again when the graph has changed."],
    }
    return "\n\n".join(f"{i}. {s.upper()}\n" + "\n".join(body[s]) for i, s in enumerate(SECTIONS, 1))


def stream(g: G.Graph, query: str, search: Callable[[str], DataFrame], threats: DataFrame) -> Iterator[tuple[str, dict]]:
    """(step, what it found) one after another; an exception ends the run with the step 'error'."""
    timeline: list[dict] = []

    def entry(agent: str, status: str) -> list[dict]:
        row = {"agent": agent, "status": status, "at": datetime.now(UTC).isoformat(timespec="seconds")}
        if row not in timeline:
            timeline.append(row)
        return timeline

    try:
        yield "coordinator", {"query": query, "searches": expand_query(query), "timeline": list(entry("coordinator", "done"))}
        rows = None
        for q in expand_query(query):
            got = search(q)
            rows = got if rows is None else rows.unionByName(got)
        evidence = [r["finding"] for r in findings(first_by_url(rows)).collect()]
        yield "collect", {"findings": evidence, "timeline": list(entry("collect", "done"))}
        part = analyse(g, query)
        yield "analyse", {"graph": part, "timeline": list(entry("analyse", "done"))}
        risk = assess(g, threats)
        yield "assess", {"risk": risk, "timeline": list(entry("assess", "done"))}
        yield "brief", {"text": briefing(query, part, risk, evidence), "timeline": list(entry("brief", "done"))}
    except Exception as e:  # noqa: BLE001
        yield "error", {"status": "error", "message": str(e)[:500], "timeline": list(entry("error", "error"))}


def run(g: G.Graph, query: str, search: Callable[[str], DataFrame], threats: DataFrame) -> dict:
    state: dict = {"status": "done"}
    for _, found in stream(g, query, search, threats):
        state |= found
    return state
