"""Query trees. A node says what a line must look like; ``compile`` turns it into a Column."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    """Base of all nodes; subclass it and register a compiler to add a predicate."""


@dataclass(frozen=True)
class MatchAll(Node):
    """Every line; no highlights."""


@dataclass(frozen=True)
class Term(Node):
    text: str
    case_sensitive: bool = False


@dataclass(frozen=True)
class Regex(Node):
    pattern: str
    case_sensitive: bool = False


@dataclass(frozen=True)
class Fuzzy(Node):
    text: str
    distance: int
    case_sensitive: bool = False


@dataclass(frozen=True)
class And(Node):
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    child: Node


@dataclass(frozen=True)
class Near(Node):
    left: Node
    right: Node
    distance: int


@dataclass(frozen=True)
class FieldFilter(Node):
    """A file predicate under a negation; it stays in the tree and compiles against file columns."""

    name: str
    value: str


@dataclass(frozen=True)
class Chip:
    """What the parser understood, for display."""

    field: str
    value: str
    raw: str
    position: int
    enabled: bool = True
    explanation: str | None = None


@dataclass
class FileFilters:
    """Conditions on the file that a line belongs to; all hold together."""

    name: list[str] = field(default_factory=list)
    path: list[str] = field(default_factory=list)
    folder: list[str] = field(default_factory=list)
    root: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    type_extensions: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    status: list[str] = field(default_factory=list)
    extractor: list[str] = field(default_factory=list)
    size_min: int | None = None
    size_max: int | None = None
    modified_from: object = None
    modified_before: object = None
    created_from: object = None
    created_before: object = None

    @property
    def empty(self) -> bool:
        return all(v in ([], None) for v in vars(self).values())


@dataclass(frozen=True)
class Unified(Node):
    content: Node
    filters: FileFilters
    chips: tuple[Chip, ...] = ()
    semantic: tuple[str, ...] = ()

    @property
    def has_content(self) -> bool:
        return not isinstance(self.content, MatchAll)

    @property
    def has_semantic(self) -> bool:
        return bool(self.semantic)

    @property
    def metadata_terms(self) -> list[str]:
        f = self.filters
        return [*f.name, *f.path, *f.folder, *f.root, *f.extensions, *f.type_extensions, *f.categories]


def simplify(node: Node) -> Node:
    """Drops what matches everything: from AND, out of OR as a whole, and as a side of NEAR. NOT stays as it is."""
    if isinstance(node, And):
        kept = tuple(c for c in map(simplify, node.children) if not isinstance(c, MatchAll))
        return MatchAll() if not kept else kept[0] if len(kept) == 1 else And(kept)
    if isinstance(node, Or):
        kept = tuple(map(simplify, node.children))
        return MatchAll() if any(isinstance(c, MatchAll) for c in kept) else kept[0] if len(kept) == 1 else Or(kept)
    if isinstance(node, Near):
        a, b = simplify(node.left), simplify(node.right)
        return b if isinstance(a, MatchAll) else a if isinstance(b, MatchAll) else Near(a, b, node.distance)
    if isinstance(node, Not):
        return Not(simplify(node.child))
    return node
