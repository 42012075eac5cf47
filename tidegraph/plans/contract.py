"""The schema contract: closed types, value coercion, limits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed sets of entity and relationship types.
ENTITY_TYPES = ("organization", "person", "location", "event", "asset", "threat")
RELATIONSHIP_TYPES = (
    "OPERATES_IN", "SUPPLIES", "THREATENS", "RELATED_TO", "HEADQUARTERED_IN", "COMMANDS", "DEPLOYED_AT", "MANUFACTURES", "SHIPS_THROUGH",
    "DEPENDS_ON", "ALLIES_WITH", "COMPETES_WITH", "MONITORS", "OWNS", "EMPLOYS", "PARTICIPATES_IN", "TRANSITS", "SUPPLIES_TO", "LOCATED_IN",
)


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str = "string"
    enum: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Contract:
    """Types and attributes that data must follow; built by load_contract."""

    attributes: dict[str, tuple[Attribute, ...]]
    relationship_types: tuple[str, ...] = RELATIONSHIP_TYPES
    dependency_types: tuple[str, ...] = ("DEPENDS_ON", "SUPPLIES", "SUPPLIES_TO")
    threat_type: str = "threat"
    exposure_types: tuple[str, ...] = ("organization",)
    linking: dict[str, float] = field(default_factory=dict)

    def descriptor(self) -> dict:
        """What a planner of queries is told."""
        return {
            "node_label": "Entity", "entity_types": sorted(self.attributes), "relationship_types": sorted(self.relationship_types),
            "rules": ["ids of entities are in the property id", "values are given as parameters", "paths have at most 6 edges", "every query ends with a LIMIT"],
        }

    def describe(self) -> str:
        """The types and attributes as text for a model."""
        lines = ["Entity types"]
        for t, attributes in self.attributes.items():
            lines.append(f"- {t}" + (": " + ", ".join(f"{a.name}:{a.kind}" + (f" of {'|'.join(a.enum)}" if a.enum else "") for a in attributes) if attributes else ""))
        return "\n".join([*lines, "Relationship types", ", ".join(sorted(self.relationship_types)), f"Dependencies: {', '.join(self.dependency_types)}", f"Threats: {self.threat_type}; exposed: {', '.join(self.exposure_types)}"])

    def is_entity_type(self, c: Column) -> Column:
        return F.lower(F.trim(c)).isin(*self.attributes)

    def is_relationship_type(self, c: Column) -> Column:
        return F.upper(F.trim(c)).isin(*self.relationship_types)

    def relationship_type(self, c: Column) -> Column:
        """Trimmed and upper case; RELATED_TO if null or unknown."""
        return F.when(F.coalesce(self.is_relationship_type(c), F.lit(False)), F.upper(F.trim(c))).otherwise("RELATED_TO")

    def coerce(self, entity_type: str, values: Column) -> dict[str, Column]:
        """A column per attribute of the type, from a map of texts: blank, unlisted and out-of-range values are null."""
        out = {}
        for a in self.attributes.get(entity_type, ()):
            raw = values[a.name]
            if a.kind == "float":
                v = raw.try_cast("double")
                if a.low is not None:
                    v = F.when(v.between(a.low, a.high), v)
            elif a.kind.startswith("list"):
                v = F.filter(F.split(raw, r"\s*[;|]\s*"), lambda x: F.trim(x) != "")
            else:
                v = F.nullif(F.trim(raw), F.lit(""))
                if a.enum:
                    v = F.when(v.isin(*a.enum), v)
            out[a.name] = v
        return out


def load_contract(spec: dict) -> Contract:
    """The contract of a parsed YAML document. Types outside the closed sets, and analysis types outside the document's, raise."""
    types = spec.get("entity_types") or {}
    if bad := set(types) - set(ENTITY_TYPES):
        raise ValueError(f"unknown entity types: {sorted(bad)}")
    rels = tuple(spec.get("relationship_types") or ())
    if bad := set(rels) - set(RELATIONSHIP_TYPES):
        raise ValueError(f"unknown relationship types: {sorted(bad)}")
    attributes = {
        t: tuple(
            Attribute(a["name"], a.get("type", "string"), tuple(a.get("enum") or ()), *(a.get("range") or (None, None)))
            for a in (body or {}).get("attributes") or ()
        )
        for t, body in types.items()
    }
    g = spec.get("graph_analysis") or {}
    dep, threat, exposed = tuple(g.get("dependency_relationship_types") or ()), g.get("threat_entity_type", "threat"), tuple(g.get("exposure_entity_types") or ())
    if bad := set(dep) - set(rels):
        raise ValueError(f"dependency types that are no relationship types: {sorted(bad)}")
    if bad := ({threat} | set(exposed)) - set(types):
        raise ValueError(f"analysis types that are no entity types: {sorted(bad)}")
    return Contract(attributes, rels, dep, threat, exposed, dict(spec.get("entity_linking") or {}))


def read_contract(path: str) -> Contract:
    import yaml

    with open(path) as f:
        return load_contract(yaml.safe_load(f))
