"""Access predicates as column expressions: they are part of the scan's filter, before any candidate is made."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    workspace: int
    subject: str
    purpose: str
    clearance: int
    scopes: tuple[str, ...] = ()
    audiences: tuple[str, ...] = ()
    compartments: tuple[str, ...] = field(default=())

    def keys(self, owner: bool = False) -> list[str]:
        """The audience keys that stand for the principal: the subject, everyone, owners, groups."""
        return list(dict.fromkeys([self.subject, "*", *(["@owner"] if owner else []), *self.audiences]))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def scope_overlap(p: Principal) -> Column:
    """A row without scopes is open to all scopes of its workspace."""
    return (F.size("scopes") == 0) | F.arrays_overlap("scopes", _strings(p.scopes))


def _base(p: Principal) -> Column:
    """What every form asks: workspace, consent, retrievability, clearance, scope overlap."""
    return (F.col("workspace") == p.workspace) & F.col("consent") & F.col("retrievable") & (F.col("sensitivity") <= p.clearance) & scope_overlap(p)


def is_owner(p: Principal) -> Column:
    return F.array_contains("owners", p.subject)


def _granted(p: Principal, any_purpose: bool = False) -> Column:
    """Whether one of the grants names an audience of the principal's together with the purpose (or `*`, if that stands for all)."""

    def fits(g: Column) -> Column:
        audience = g["audience"].isin(p.keys()) | (is_owner(p) & (g["audience"] == "@owner"))
        purpose = F.array_contains(g["purposes"], p.purpose)
        return audience & ((purpose | F.array_contains(g["purposes"], "*")) if any_purpose else purpose)

    return F.exists("grants", fits)


def _legacy(p: Principal, groups: bool) -> Column:
    """For rows without grants: an owner or one of the audience, for any purpose if none is named. Groups count in the service's form only."""
    audience = is_owner(p) | F.arrays_overlap("audience", _strings(p.keys() if groups else [p.subject, "*"]))
    return audience & ((F.size("purposes") == 0) | F.array_contains("purposes", p.purpose))


def allows(p: Principal) -> Column:
    """The record form: grants decide where there are any, else audience and purposes."""
    return _base(p) & F.when(F.size("grants") == 0, _legacy(p, groups=False)).otherwise(_granted(p))


def allows_service(p: Principal) -> Column:
    """The service's form: as `allows`, but the principal's groups count in rows without grants, too."""
    return _base(p) & F.when(F.size("grants") == 0, _legacy(p, groups=True)).otherwise(_granted(p))


def allows_graph(p: Principal, spaces: tuple[str, ...] = ()) -> Column:
    """The graph's form: all compartments granted, the purpose among the allowed ones, spaces that meet, and a grant to public, owner, subject, group or space."""
    compartments = F.size(F.array_except("compartments", _strings(p.compartments))) == 0
    where = (F.size("spaces") == 0) | F.arrays_overlap("spaces", _strings(spaces))
    names = ["public", p.subject, *(f"group:{a}" for a in p.audiences), *(f"space:{s}" for s in spaces)]
    granted = F.exists("grants", lambda g: F.array_contains(g["purposes"], p.purpose) & (g["audience"].isin(names) | (is_owner(p) & (g["audience"] == "owner"))))
    return _base(p) & compartments & F.array_contains("purposes", p.purpose) & where & granted


def allows_recall(p: Principal) -> Column:
    """The recall's form: compartments are among the scopes; only grants admit, `*` stands for any purpose, and no grant is a refusal."""
    compartments = F.size(F.array_except("compartments", _strings(p.scopes))) == 0
    return _base(p) & compartments & _granted(p, any_purpose=True)


def allows_index(p: Principal, snapshot: Column | int) -> Column:
    """All of a row's scopes and compartments must be the principal's, and the row not deleted as of the snapshot."""
    inside = lambda c, of: F.size(F.array_except(c, _strings(of))) == 0
    return (F.col("workspace") == p.workspace) & inside("scopes", p.scopes) & inside("compartments", p.compartments) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > snapshot))


def narrows(parent: str, child: str) -> Column:
    """Whether a derived policy (struct column) only narrows its parent's: scopes, purposes and grants inside, owners equal, compartments and sensitivity not less."""
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    p, c = (lambda f: F.col(f"{parent}.{f}")), (lambda f: F.col(f"{child}.{f}"))
    covered = F.forall(c("grants"), lambda g: F.exists(p("grants"), lambda h: (h["audience"] == g["audience"]) & inside(g["purposes"], h["purposes"])))
    return inside(c("scopes"), p("scopes")) & inside(c("purposes"), p("purposes")) & covered & (F.array_sort(c("owners")) == F.array_sort(p("owners"))) & inside(p("compartments"), c("compartments")) & (c("sensitivity") >= p("sensitivity"))


def signature(*columns: str) -> Column:
    """A name of a policy, equal for equal labels whatever the order in their sets."""
    flat = [F.array_sort(c) if c in ("scopes", "owners", "audience", "purposes", "compartments") else F.col(c) for c in columns]
    return F.sha2(F.to_json(F.struct(*(x.alias(c) for x, c in zip(flat, columns))), {"ignoreNullFields": "false"}), 256)
