"""The candidate map: filters, refusals, views and the full order of candidates.

A candidate has dimensions (controllability, reachability, ...) as columns of values. A
view floats what it is about to the front and removes nothing; only what is proven safe
sinks, and what is not known never does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import rank

#: Review statuses, orders, dimensions and views, with their older names.
STATUSES = ("to-verify", "reachable", "all")
SHOWN = ("to-verify", "reachable")
SPINES = ("by-sink", "controllability", "default", "impact", "reachability", "sink_impact")
DIMENSIONS = ("completeness", "controllability", "filtering", "reachability", "sink_impact", "source", "source_writability", "writer")
VIEWS: dict[str, tuple[tuple[str, str] | None, str]] = {"default": (None, "impact"), "by-sink": (None, "by-sink"), "nvram-source": (("source", "nvram"), "impact"), "reachable-first": (("reachability", "found"), "impact")}
ALIASES = {"reachable-only": "reachable-first"}
#: Bands of controllability, and of what a parameter's character set lets through.
CONTROLLABILITY = {"controllable": 5, "free": 3, "constrained": 2, "unknown": 1, "constant": 0}
LIKELY = 4
CHARSETS = {"free_string": 3, "charset_maybe": 2, "unknown": 1, "charset_safe": 0}


def canonical_view(view: str | None) -> str | None:
    return ALIASES.get(view, view) if view else view


def refusal(status: str | None = None, sort_by: str | None = None, view: str | None = None, fragments: tuple[str, ...] = ()) -> str | None:
    """Why a question cannot be answered as asked; None if it can. Nothing misspelt is taken for a default."""
    if status is not None and status not in STATUSES:
        return f"no status {status!r}; there are {', '.join(STATUSES)}"
    if sort_by is not None and sort_by not in SPINES:
        return f"no order {sort_by!r}; there are {', '.join(SPINES)}"
    if view is not None and canonical_view(view) not in VIEWS:
        return f"no view {view!r}; there are {', '.join([*VIEWS, *ALIASES])}"
    pairs = [f.strip().partition("=") for f in fragments if f.strip()]
    bad = [f"{d}{s}{v}" for d, s, v in pairs if not (s and d.strip() and v.strip())]
    if bad:
        return f"not of the form dimension=value: {', '.join(map(repr, bad))}"
    unknown = [d.strip() for d, _, _ in pairs if d.strip() not in DIMENSIONS]
    return f"no dimension {unknown[0]!r}; there are {', '.join(DIMENSIONS)}" if unknown else None


def filters(fragments: tuple[str, ...]) -> dict[str, str]:
    """Well-formed fragments as dimension and value."""
    return {d.strip(): v.strip() for d, _, v in (f.partition("=") for f in fragments if f.strip())}


def filtered(candidates: DataFrame, sink: str | None = None, status: str | None = None) -> DataFrame:
    """Candidates whose callee or class is ``sink`` in either case, of a review status; a sink or ``all`` shows every status."""
    if sink is not None:
        candidates = candidates.where((F.lower(F.coalesce("sink_anchor", F.lit(""))) == sink.lower()) | (F.lower("sink_class") == sink.lower()))
    shown = SHOWN if status in (None, "all") or sink is not None else (status,)
    return candidates.where(F.col("status").isin(*shown))


def matches(dimension: str, value: str) -> Column:
    """Whether a dimension has a value: equal, one of values joined by +, or an entry of any kind for ``found``."""
    own = F.coalesce(F.col(dimension), F.lit(""))
    if dimension == "reachability":
        kinds = F.split(F.regexp_replace(own, "^entry:", ""), r"\+")
        asked = value.removeprefix("entry:").split("+")
        return own.startswith("entry:") & (F.lit(value == "found") | F.forall(F.array(*map(F.lit, asked)), lambda v: F.array_contains(kinds, v)))
    return (own == value) | F.array_contains(F.split(own, r"\+"), value)


def _level(values: dict[str, int], own: Column, other: int) -> Column:
    out = F.lit(other)
    for name, level in values.items():
        out = F.when(own == name, level).otherwise(out)
    return out


def atoms(candidates: DataFrame, impact: dict[str, int] | None = None) -> DataFrame:
    """Candidates with the parts of their order. Columns: proven_safe, sink_class, controllability, controllability_state, source, source_kind, reachability, writer, completeness, function, evidence_ref."""
    param = F.coalesce(F.col("source") == "param", F.lit(False))
    kind, reach = F.coalesce("source_kind", F.lit("unknown")), F.coalesce("reachability", F.lit("unknown"))
    entry = reach.startswith("entry:")
    control = F.when((F.col("controllability") == "controllable") & (F.col("controllability_state") == "likely"), LIKELY).otherwise(_level(CONTROLLABILITY, F.col("controllability"), 1))
    return candidates.withColumns(
        {
            "__safe": F.coalesce("proven_safe", F.lit(False)).cast("int"),
            "__impact": rank.impact(F.col("sink_class"), impact),
            "__control": control,
            "__float": (param & kind.isin("free_string", "charset_maybe", "unknown")).cast("int"),
            "__charset": F.when(param, _level(CHARSETS, kind, 1)).otherwise(0),
            "__reach": F.when(entry, 1 + F.size(F.split(reach, r"\+"))).otherwise(F.when(reach == "unknown", 1).otherwise(0)),
            "__entry": entry.cast("int"),
            "__writer": F.coalesce((F.col("writer") == "located").cast("int"), F.lit(0)),
            "__whole": F.coalesce((F.col("completeness") == "complete").cast("int"), F.lit(0)),
        }
    )


def order(spine: str = "impact") -> list[Column]:
    """The full order over ``atoms``: what is proven safe last, the spine, then the same keys under every view, and a unique end."""
    pivot = {"reachability": [F.desc("__reach")], "controllability": [F.desc("__control")], "by-sink": [F.desc("__impact"), F.asc_nulls_first("sink_class")]}.get(spine, [F.desc("__impact")])
    return [F.col("__safe"), *pivot, *(F.desc(c) for c in ("__impact", "__control", "__float", "__charset", "__entry", "__writer", "__whole")), F.asc_nulls_first("function"), F.asc_nulls_first("evidence_ref")]


def viewed(candidates: DataFrame, view: str | None = None, sort_by: str | None = None, fragments: tuple[str, ...] = (), impact: dict[str, int] | None = None) -> tuple[DataFrame, list[Column]]:
    """Candidates with their band (0 matches the view and the fragments, 1 not) and atoms, and the order to read them in. None is removed."""
    why = refusal(sort_by=sort_by, view=view, fragments=fragments)
    if why:
        raise ValueError(why)
    own, spine = VIEWS[canonical_view(view) or "default"]
    hit = F.lit(True)
    for dimension, value in [*([own] if own else []), *filters(fragments).items()]:
        hit = hit & F.coalesce(matches(dimension, value), F.lit(False))
    made = atoms(candidates, impact).withColumn("band", F.when(F.col("__safe") == 1, 2).when(hit, 0).otherwise(1))
    return made, [F.col("band"), *order(sort_by or spine)]


def page_key() -> list[Column]:
    """The order of pages that are walked: impact as it is by default, then the reference, whatever the view."""
    return [F.desc(rank.impact(F.col("sink_class"))), F.asc_nulls_first("evidence_ref")]
