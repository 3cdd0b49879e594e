"""The foreign-key graph: order for seeding, cycles broken at nullable edges, closure, levels.

A schema has at most some thousand tables, so this is driver work on metadata; rows never come near it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from seedplane.model import CyclicSchemaError, ForeignKey, Schema


@dataclass
class Order:
    tables: list[str] = field(default_factory=list)
    depth: dict[str, int] = field(default_factory=dict)
    deferred: list[ForeignKey] = field(default_factory=list)
    dangling: list[ForeignKey] = field(default_factory=list)
    own: list[ForeignKey] = field(default_factory=list)
    cycles: list[list[str]] = field(default_factory=list)

    def levels(self) -> list[list[str]]:
        return [[t for t in self.tables if self.depth[t] == d] for d in range(max(self.depth.values(), default=-1) + 1)]

    def notes(self) -> list[str]:
        return (
            [f"cycle of {', '.join(c)} broken at {fk.name}" for c, fk in zip(self.cycles, self.deferred, strict=True)]
            + [f"{fk.name} refers to {fk.parent}, which is not seeded" for fk in self.dangling] + [f"{fk.name} refers to its own table" for fk in self.own]
        )


class Graph:
    def __init__(self, schema: Schema, included: set[str] | None = None):
        self.schema = schema
        self.names = sorted(schema.tables if included is None else included)
        known = set(self.names)
        self.edges: list[ForeignKey] = []
        self.own: list[ForeignKey] = []
        self.dangling: list[ForeignKey] = []
        for name in self.names:
            for fk in sorted(schema.tables[name].fks, key=lambda f: f.name):
                (self.own if fk.to_self else self.edges if fk.parent in known else self.dangling).append(fk)
        self.parents = {t: {fk.parent for fk in self.edges if fk.child == t} for t in self.names}
        self.children = {t: {fk.child for fk in self.edges if fk.parent == t} for t in self.names}

    def roots(self) -> list[str]:
        return [t for t in self.names if not self.parents[t]]

    def leaves(self) -> list[str]:
        return [t for t in self.names if not self.children[t]]

    def order(self) -> Order:
        out = Order(dangling=self.dangling, own=self.own)
        live = list(self.edges)
        done: set[str] = set()
        while True:
            waits = {t: {fk.parent for fk in live if fk.child == t and fk.parent not in done} for t in self.names if t not in done}
            ready = [t for t, w in waits.items() if not w]
            heapq.heapify(ready)
            while ready:
                t = heapq.heappop(ready)
                done.add(t)
                out.tables.append(t)
                before = [out.depth[fk.parent] for fk in live if fk.child == t and fk.parent in out.depth]
                out.depth[t] = 1 + max(before) if before else 0
                for child in self.children[t]:
                    if child not in done and t in waits.get(child, ()):
                        waits[child].discard(t)
                        if not waits[child]:
                            heapq.heappush(ready, child)
            stuck = {t: w for t, w in waits.items() if t not in done}
            if not stuck:
                return out
            group = min((g for g in strong_components(stuck) if len(g) > 1), key=lambda g: (len(g), g[0]))
            breakable = [fk for fk in live if fk.child in group and fk.parent in group and self.schema.tables[fk.child].nullable(fk.columns, every=True)]
            if not breakable:
                raise CyclicSchemaError(group)
            cut = min(breakable, key=lambda fk: (len(fk.columns), fk.name))
            out.deferred.append(cut)
            out.cycles.append(group)
            live.remove(cut)


def strong_components(edges: dict[str, set[str]]) -> list[list[str]]:
    """Members sorted; two depth-first passes, without recursion."""
    finished: list[str] = []
    seen: set[str] = set()
    for start in sorted(edges):
        stack = [(start, iter(sorted(edges[start])))] if start not in seen else []
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            nxt = next((n for n in rest if n in edges and n not in seen), None)
            if nxt is None:
                finished.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(sorted(edges[nxt]))))
    back: dict[str, list[str]] = {n: [] for n in edges}
    for n, ps in edges.items():
        for p in ps:
            if p in back:
                back[p].append(n)
    groups, taken = [], set()
    for start in reversed(finished):
        if start not in taken:
            group, todo = [], [start]
            taken.add(start)
            while todo:
                n = todo.pop()
                group.append(n)
                fresh = [m for m in back[n] if m not in taken]
                taken.update(fresh)
                todo += fresh
            groups.append(sorted(group))
    return groups


def closure(schema: Schema, wanted: set[str], forbidden: set[str] = frozenset()) -> set[str]:
    """wanted and all tables that their NOT NULL foreign keys need, never the forbidden ones."""
    out, todo = set(wanted), sorted(wanted)
    while todo:
        table = schema.tables[todo.pop()]
        for fk in table.fks:
            if not fk.to_self and not table.nullable(fk.columns, every=True) and fk.parent not in out and fk.parent not in forbidden:
                out.add(fk.parent)
                todo.append(fk.parent)
    return out
