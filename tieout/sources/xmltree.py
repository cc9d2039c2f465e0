"""XML with limits: no document type, bounded nodes and depth; local names."""

from __future__ import annotations

import re
from xml.etree import ElementTree
from xml.parsers import expat

from tieout.model import MalformedInput, ResourceLimit
from tieout.sources.records import Limits


class _Guard(ElementTree.TreeBuilder):
    def __init__(self, limits: Limits):
        super().__init__()
        self.limits, self.nodes, self.depth = limits, 0, 0

    def start(self, tag, attrs):
        self.nodes, self.depth = self.nodes + 1, self.depth + 1
        if self.nodes > self.limits.xml_nodes or self.depth > self.limits.xml_depth:
            raise ResourceLimit("XML nodes or depth")
        return super().start(tag, attrs)

    def end(self, tag):
        self.depth -= 1
        return super().end(tag)


def parse(data: bytes, limits: Limits = Limits()) -> ElementTree.Element:
    if re.search(rb"<!\s*(DOCTYPE|ENTITY)", data[: 1 << 16], re.I):
        raise MalformedInput("a document type")
    try:
        return ElementTree.fromstring(data, parser=ElementTree.XMLParser(target=_Guard(limits)))
    except (ElementTree.ParseError, expat.ExpatError) as e:
        raise MalformedInput(f"XML: {e}") from e


def local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def children(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in e if local(c) == name]


def descendants(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in e.iter() if local(c) == name and c is not e]


def at(e: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for name in path:
        e = next(iter(children(e, name)), None) if e is not None else None
    return e


def text(e: ElementTree.Element | None) -> str | None:
    return ("".join(e.itertext()).strip() or None) if e is not None else None


def only(e: ElementTree.Element, name: str) -> ElementTree.Element:
    found = children(e, name)
    if len(found) != 1:
        raise MalformedInput(f"{len(found)} elements {name}")
    return found[0]
