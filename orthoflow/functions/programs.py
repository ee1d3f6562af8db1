"""A module's logic as a program of array levels, and the minimal KO sets that would make it true.

A program has the distinct KOs below a root, and levels of nodes from the bottom up. A node is "all of" or "one of" some
earlier values, named by their places: the KOs first, then two constants (unknown, true), then the nodes
level by level. A referenced module is compiled in once, however often it is named.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa

FALSE, UNKNOWN, TRUE = 0, 1, 2
ALL_OF, ONE_OF = 0, 1
PROGRAM = (
    "root_id string, kos array<string>, levels array<array<struct<op:int,kids:array<int>>>>, "
    "blocks array<struct<block_index:int,node:int,required:long,leaves:array<int>>>, "
    "optional array<struct<module_id:string,node_id:int,node:int,leaves:array<int>>>")
_KIDS = pa.list_(pa.int32())
PROGRAM_TYPES = pa.schema([
    ("root_id", pa.string()), ("kos", pa.list_(pa.string())),
    ("levels", pa.list_(pa.list_(pa.struct([("op", pa.int32()), ("kids", _KIDS)])))),
    ("blocks", pa.list_(pa.struct([("block_index", pa.int32()), ("node", pa.int32()), ("required", pa.int64()), ("leaves", _KIDS)]))),
    ("optional", pa.list_(pa.struct([("module_id", pa.string()), ("node_id", pa.int32()), ("node", pa.int32()), ("leaves", _KIDS)])))])


class Compiler:
    """Values of one root: each is (depth, kind, payload, required, leaves); names are their places in ``values``."""

    def __init__(self, modules: dict[str, list[dict]]):
        self.modules = modules
        self.kos: dict[str, int] = {}
        self.values: list[tuple] = [(0, "const", UNKNOWN, 1, frozenset()), (0, "const", TRUE, 0, frozenset())]
        self.done: dict[str, dict[int, int]] = {}
        self.optional: list[tuple[str, int, int]] = []

    def add(self, *value) -> int:
        self.values.append(value)
        return len(self.values) - 1

    def joined(self, op: int, kids: list[int]) -> int:
        if len(kids) == 1:
            return kids[0]
        below = [self.values[k] for k in kids]
        return self.add(1 + max(v[0] for v in below), op, kids, sum(v[3] for v in below), frozenset().union(*(v[4] for v in below)))

    def order(self, root: str) -> list[str]:
        """Modules below the root, referenced ones first; a reference back into an open module is left out (unknown)."""
        out, state, pending = [], {}, [root]
        while pending:
            module = pending[-1]
            if state.get(module) is None:
                state[module] = "open"
                pending.extend(n["value"] for n in reversed(self.modules[module])
                               if n["kind"] == "module_reference" and not n["blocked"] and n["value"] in self.modules and n["value"] not in state)
            else:
                pending.pop()
                if state[module] == "open":
                    state[module] = "done"
                    out.append(module)
        return out

    def module(self, module_id: str) -> dict[int, int]:
        """Values of the blocks by their numbers. Nodes are in depth-first order, so the last come first here."""
        kids: dict[int | None, list[int]] = {}
        blocks: dict[int, int] = {}
        for node in reversed(self.modules[module_id]):
            own = kids.pop(node["node_id"], [])[::-1]
            kind = node["kind"]
            if kind == "ko":
                if node["value"] not in self.kos:
                    self.kos[node["value"]] = self.add(0, "ko", node["value"], 1, frozenset([node["value"]]))
                value = self.kos[node["value"]]
            elif kind in ("and", "or"):
                value = self.joined(ONE_OF if kind == "or" else ALL_OF, own)
            elif kind == "group":
                value = own[0]
            elif kind == "optional":
                self.optional.append((module_id, node["node_id"], own[0]))
                value = 1
            elif kind == "module_reference" and not node["blocked"] and node["value"] in self.done:
                targets = list(self.done[node["value"]].values())
                value = self.joined(ALL_OF, targets) if targets else 0
                if self.values[value][3] == 0:
                    value = self.add(0, "const", UNKNOWN, 0, frozenset())
            else:
                value = 0
            if node["parent_id"] is None:
                blocks[node["block_index"]] = value
            else:
                kids.setdefault(node["parent_id"], []).append(value)
        return blocks

    def program(self, root: str) -> dict:
        for module in self.order(root):
            self.done[module] = self.module(module)
        kos = list(self.kos)
        place = {"const": {UNKNOWN: len(kos), TRUE: len(kos) + 1}}
        leaf = {ko: k for k, ko in enumerate(kos)}
        levels: list[list[int]] = []
        for k, value in enumerate(self.values):
            if value[0]:
                levels.extend([] for _ in range(value[0] - len(levels)))
                levels[value[0] - 1].append(k)
        places, after = {}, count(len(kos) + 2)
        for k, value in enumerate(self.values):
            if not value[0]:
                places[k] = leaf[value[2]] if value[1] == "ko" else place["const"][value[2]]
        for level in levels:
            for k in level:
                places[k] = next(after)

        def leaves(k: int) -> list[int]:
            return sorted(leaf[x] for x in self.values[k][4])

        return {
            "root_id": root, "kos": kos,
            "levels": [[{"op": self.values[k][1], "kids": [places[x] for x in self.values[k][2]]} for k in level] for level in levels],
            "blocks": [{"block_index": b, "node": places[k], "required": self.values[k][3], "leaves": leaves(k)} for b, k in sorted(self.done[root].items())],
            "optional": [{"module_id": m, "node_id": n, "node": places[k], "leaves": leaves(k)} for m, n, k in self.optional]}


def compile_root(table: pa.Table) -> pa.Table:
    """One root's program from the nodes of its reachable modules (root_id, module_id, node columns, blocked)."""
    modules: dict[str, list[dict]] = {}
    rows = table.to_pylist()
    for row in rows:
        modules.setdefault(row["module_id"], []).append(row)
    for nodes in modules.values():
        nodes.sort(key=lambda n: n["node_id"])
    root = rows[0]["root_id"]
    return pa.Table.from_pylist([Compiler(modules).program(root)] if root in modules else [], schema=PROGRAM_TYPES)


def folded(kos: list[str], levels: list[list[dict]], present: list[str]) -> list[int]:
    """The truth of all values of a program where ``present`` are the KOs found."""
    found = set(present)
    truth = [TRUE if ko in found else FALSE for ko in kos] + [UNKNOWN, TRUE]
    for level in levels:
        truth += [(max if node["op"] == ONE_OF else min)(truth[k] for k in node["kids"]) for node in level]
    return truth


# --- minimal sets --------------------------------------------------------------------------------

#: A part of the logic with so many alternatives at most is reduced to a list; larger ones are walked as a stream.
LISTED = 1_024


class TooMany(Exception):
    """A caller's bound on combinations is passed, or an unknown part leaves the answer open."""


class Alternatives:
    """Minimal sets of absent KOs that make a false value true, as bit masks over the module's own KO numbering."""

    def __init__(self, n_kos: int, levels: list[list[dict]], truth: list[int], cap: int | None = None):
        self.n, self.truth, self.cap = n_kos, truth, cap
        self.nodes = {n_kos + 2 + k: node for k, node in enumerate(node for level in levels for node in level)}
        self.bounds: dict[int, int] = {}
        self.lists: dict[int, list[int]] = {}
        self.kids: dict[int, list[int]] = {}

    def lacking(self, value: int) -> list[int]:
        """The false parts of a false node; an unknown part of "all of" leaves it open."""
        if value not in self.kids:
            node = self.nodes[value]
            if node["op"] == ALL_OF and any(self.truth[k] == UNKNOWN for k in node["kids"]):
                raise TooMany
            self.kids[value] = list(dict.fromkeys(k for k in node["kids"] if self.truth[k] == FALSE))
        return self.kids[value]

    def check(self, value: int) -> None:
        """Bounds of everything below, lowest first; raises where a part is open."""
        pending = [value]
        while pending:
            at = pending[-1]
            if at < self.n:
                self.bounds[at], self.lists[at] = 1, [1 << at]
            todo = [] if at in self.bounds else [k for k in self.lacking(at) if k not in self.bounds]
            if todo:
                pending.extend(todo)
                continue
            pending.pop()
            if at not in self.bounds:
                self._reduce(at)

    def _reduce(self, at: int) -> None:
        """Bound of a node whose parts have theirs, and its list where that is small."""
        kids = self.lacking(at)
        if self.nodes[at]["op"] == ONE_OF:
            self.bounds[at] = sum(self.bounds[k] for k in kids)
            if all(k in self.lists for k in kids) and self.bounds[at] <= self._listed():
                self.lists[at] = antichain([m for k in kids for m in self.lists[k]])
        else:
            bound, masks = 1, [0]
            for k in kids:
                size = len(self.lists[k]) if k in self.lists else self.bounds[k]
                bound = (len(masks) if masks is not None else bound) * size
                if self.cap is not None and bound > self.cap:
                    raise TooMany
                masks = antichain([a | b for a in masks for b in self.lists[k]]) if masks is not None and k in self.lists and bound <= self._listed() else None
            self.bounds[at] = bound
            if masks is not None:
                self.lists[at] = masks
        if at in self.lists:
            self.bounds[at] = len(self.lists[at])

    def _listed(self) -> int:
        return LISTED if self.cap is None else max(LISTED, self.cap)

    def shards(self, value: int, rows: int) -> int:
        """Into how many parts of about ``rows`` candidates the walk can be cut: "all of" cuts at its first factors."""
        if value in self.lists or self.nodes[value]["op"] == ONE_OF:
            return 1
        return max(1, min(4_096, self.bounds[value] // rows))

    def stream(self, value: int, shard: int = 0, shards: int = 1) -> Iterator[int]:
        """Candidate sets: all minimal ones, each once at least."""
        if value in self.lists:
            yield from self.lists[value]
        elif self.nodes[value]["op"] == ONE_OF:
            for k in self.lacking(value):
                yield from self.stream(k)
        else:
            base, factors = 0, []
            for k in self.lacking(value):
                if self.bounds[k] == 1:
                    base |= next(iter(self.stream(k)))
                else:
                    factors.append(k)
            factors.sort(key=lambda k: (k not in self.lists, self.bounds[k]))
            cut, size = 0, 1
            while cut < len(factors) and size < shards:
                size *= self.bounds[factors[cut]]
                cut += 1
            for i, prefix in enumerate(self._product(factors[:cut], base)):
                if i % shards == shard:
                    yield from self._product(factors[cut:], prefix)

    def _product(self, factors: list[int], base: int) -> Iterator[int]:
        if not factors:
            yield base
            return
        for mask in self.stream(factors[0]):
            yield from self._product(factors[1:], base | mask)

    def read_once(self, value: int) -> bool:
        """Whether every KO below occurs once: then all candidates are minimal and different."""
        seen, pending = set(), [value]
        while pending:
            at = pending.pop()
            if at in seen:
                return False
            seen.add(at)
            if at >= self.n:
                pending.extend(self.lacking(at))
        return True

    def holds(self, value: int, mask: int) -> bool:
        """Whether the value is true once the KOs of the mask are there; nodes come after their parts."""
        true: dict[int, bool] = {}
        below, pending = set(), [value]
        while pending:
            at = pending.pop()
            if at not in below:
                below.add(at)
                pending.extend(self.lacking(at) if at >= self.n else ())
        for at in sorted(below):
            true[at] = bool(mask >> at & 1) if at < self.n else (any if self.nodes[at]["op"] == ONE_OF else all)(true[k] for k in self.lacking(at))
        return true[value]

    def minimal(self, value: int, shard: int = 0, shards: int = 1) -> Iterator[int]:
        """Minimal sets; the same one may come again where a KO occurs in several parts."""
        plain = value in self.lists or self.read_once(value)
        for mask in self.stream(value, shard, shards):
            if plain or not any(self.holds(value, mask & ~(1 << bit)) for bit in bits_of(mask)):
                yield mask


def bits_of(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def antichain(masks: list[int]) -> list[int]:
    """Distinct masks that hold no other one, smallest first."""
    out: list[int] = []
    for mask in sorted(set(masks), key=lambda m: (m.bit_count(), m)):
        if not any(kept & mask == kept for kept in out):
            out.append(mask)
    return out
