"""A plain model of a share's tree in memory, which the replica is tested against."""

from __future__ import annotations

from dataclasses import dataclass, field

ROOT = (1, 0)
FIRST_COOKIE, MAX_PENDING = 3, 65_536
Key = tuple[int, int]


@dataclass
class Dir:
    names: dict[str, tuple[int, Key, str]] = field(default_factory=dict)
    next_cookie: int = FIRST_COOKIE
    generation: int = 0
    complete: bool = False

    def put(self, name: str, key: Key, kind: str) -> tuple[bool, Key | None]:
        """(is a new link, node whose link is lost)."""
        old = self.names.get(name)
        if old and old[1] == key:
            self.names[name] = (old[0], key, kind)
            return False, None
        self.names.pop(name, None)
        self.names[name] = (self.next_cookie, key, kind)
        self.next_cookie += 1
        self.generation += 1
        return True, old and old[1]

    def drop(self, name: str) -> tuple[Key, str] | None:
        old = self.names.pop(name, None)
        if old is None:
            return None
        self.generation += 1
        return old[1], old[2]


@dataclass
class Node:
    kind: str
    mode: int = 0
    size: int = 0
    mtime_sec: int = 0
    version: int = 0
    parent: Key = ROOT
    links: int = 0
    dir: Dir | None = None


class Tree:
    """State of one share.  ``compat`` keeps the leak of a rename onto another link of its node."""

    def __init__(self, compat: bool = True):
        self.nodes: dict[Key, Node] = {ROOT: Node("dir", 0o755, dir=Dir(complete=True))}
        self.waiting: dict[Key, list[dict]] = {}
        self.resync = False
        self.compat = compat

    # Records.

    def apply(self, r: dict) -> None:
        op = r["op"]
        key, parent = (r.get("ino"), r.get("gen") or 0), (r.get("parent_ino"), r.get("parent_gen") or 0)
        if op == "created":
            self._created(key, parent, r)
        elif op == "removed":
            self._unlink(parent, r["name"])
        elif op == "renamed":
            self._renamed(parent, r["name"], (r["to_parent_ino"], r.get("to_parent_gen") or 0), r["to_name"])
        elif op in ("attr", "content"):
            if key in self.nodes:
                self._update(self.nodes[key], r)
            else:
                self._wait(key, r)
        elif op == "self_removed":
            if key != ROOT and key in self.nodes:
                self.nodes[key].links = 0
                self._delete(key)
        elif op == "overflow":
            self.resync = True

    def _created(self, key: Key, parent: Key, r: dict) -> None:
        if r.get("has_attr", True):
            self.put_node(key, r, parent)
            for x in self.waiting.pop(key, []):
                self._update(self.nodes[key], x)
            node = self.nodes[key]
            if node.dir is not None:
                node.dir.complete = True
            kind = r["kind"]
        else:
            kind = "file"
            if key not in self.nodes:
                self.nodes[key] = Node(kind, 0o644, parent=parent)
        self.link(parent, r["name"], key, kind)

    def _renamed(self, source: Key, name: str, to: Key, to_name: str) -> None:
        at = self.nodes.get(source)
        taken = at.dir.drop(name) if at and at.dir else None
        if taken is None:
            return
        key, kind = taken
        goal = self.nodes.get(to)
        if goal is None or goal.dir is None:
            return
        fresh, lost = goal.dir.put(to_name, key, kind)
        if not fresh and not self.compat and key in self.nodes:
            self.nodes[key].links -= 1
        if lost is not None:
            self._lose_link(lost)
        if key in self.nodes:
            self.nodes[key].parent = to

    def _wait(self, key: Key, r: dict) -> None:
        if len(self.waiting) >= MAX_PENDING:
            self.waiting.clear()
        self.waiting.setdefault(key, []).append(r)

    # State.

    def put_node(self, key: Key, r: dict, parent: Key) -> None:
        node = self.nodes.get(key)
        if node is None:
            node = self.nodes[key] = Node(r["kind"], version=r.get("version") or 0)
        node.kind, node.mode, node.size, node.mtime_sec, node.parent = r["kind"], r["mode"] or 0, r["size"] or 0, r["mtime_sec"] or 0, parent
        if node.kind == "dir" and node.dir is None:
            node.dir = Dir()

    def _update(self, node: Node, r: dict) -> None:
        node.size, node.mtime_sec = r["size"] or 0, r["mtime_sec"] or 0
        if r["op"] == "attr":
            node.mode = r["mode"] or 0
            node.kind = r.get("kind") or node.kind
        else:
            node.version = r["version"] or 0

    def link(self, parent: Key, name: str, key: Key, kind: str) -> None:
        at = self.nodes.get(parent)
        if at is None or at.dir is None:
            return
        fresh, lost = at.dir.put(name, key, kind)
        if fresh and key in self.nodes:
            self.nodes[key].links += 1
        if lost is not None:
            self._lose_link(lost)

    def _unlink(self, parent: Key, name: str) -> None:
        at = self.nodes.get(parent)
        dropped = at.dir.drop(name) if at and at.dir else None
        if dropped:
            self._lose_link(dropped[0])

    def _lose_link(self, key: Key) -> None:
        node = self.nodes.get(key)
        if node is None:
            return
        node.links = max(0, node.links - 1)
        if node.links == 0 and key != ROOT:
            self._delete(key)

    def _delete(self, key: Key) -> None:
        """Remove a node and, without recursion, all that loses its last link with it."""
        todo = [key]
        while todo:
            node = self.nodes.pop(todo.pop(), None)
            if node is None or node.dir is None:
                continue
            for _, child, _ in node.dir.names.values():
                c = self.nodes.get(child)
                if c is not None:
                    c.links = max(0, c.links - 1)
                    if c.links == 0 and child != ROOT:
                        todo.append(child)
