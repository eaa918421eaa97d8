"""A compiler for CSS selectors over ``functions.html`` trees.

Types, ids, classes, attributes (presence, =, ~=, |=, ^=, $=, *=), ``:not``, ``:first-child``, ``:last-child``,
``:only-child``, ``:nth-child``, ``:empty``; descendant, child, adjacent and general sibling; groups. Anything else
raises ``SelectorError``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from siltloom.functions.html import Node

Test = Callable[[Node], bool]


class SelectorError(ValueError):
    """The selector is malformed or not supported."""


_IDENT = r"(?:-?[A-Za-z_\u0080-￿][\w\-\u0080-￿]*)"
_PART = re.compile(
    rf"(?P<tag>\*|{_IDENT})|\#(?P<id>[\w\-\u0080-￿]+)|\.(?P<cls>{_IDENT})"
    rf"|\[\s*(?P<attr>[\w\-:]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s\"']+))\s*)?\]"
    rf"|:(?P<pseudo>[a-z-]+)(?:\((?P<arg>[^()]*(?:\([^()]*\)[^()]*)*)\))?"
)


def _elements(node: Node) -> list[Node]:
    return [k for k in node.kids if not isinstance(k, str)]


def _nth(arg: str) -> Callable[[int], bool]:
    arg = arg.strip().lower()
    if arg in ("odd", "even"):
        return lambda i: i % 2 == (arg == "odd")
    m = re.fullmatch(r"(?:([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))", arg)
    if not m:
        raise SelectorError(arg)
    if m[4] is not None:
        n = int(m[4])
        return lambda i: i == n
    a = {"": 1, "+": 1, "-": -1}.get(m[1], None)
    a = int(m[1]) if a is None else a
    b = int((m[2] or "") + m[3]) if m[3] else 0
    return lambda i: i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0


def _attribute(name: str, op: str | None, value: str) -> Test:
    name = name.lower()
    if op is None:
        return lambda n: name in n.attrs
    if op == "=":
        return lambda n: n.attrs.get(name) == value
    if op == "~=":
        return lambda n: value in (n.attrs.get(name) or "").split()
    if op == "|=":
        return lambda n: (v := n.attrs.get(name)) is not None and (v == value or v.startswith(value + "-"))
    if value == "":
        return lambda n: False
    if op == "^=":
        return lambda n: (n.attrs.get(name) or "").startswith(value)
    if op == "$=":
        return lambda n: (n.attrs.get(name) or "").endswith(value)
    return lambda n: value in (n.attrs.get(name) or "")


def _pseudo(name: str, arg: str | None) -> Test:
    if name == "not" and arg is not None:
        inner = [_chain(x) for x in _split(arg)]
        return lambda n: not any(t(n) for t in inner)
    siblings = lambda n: _elements(n.parent) if n.parent is not None else [n]
    if name == "first-child":
        return lambda n: siblings(n)[0] is n
    if name == "last-child":
        return lambda n: siblings(n)[-1] is n
    if name == "only-child":
        return lambda n: len(siblings(n)) == 1
    if name == "empty":
        return lambda n: not n.kids
    if name == "nth-child" and arg is not None:
        ok = _nth(arg)
        return lambda n: ok(next(i for i, k in enumerate(siblings(n), 1) if k is n))
    raise SelectorError(f":{name}")


def _compound(text: str) -> Test:
    tests: list[Test] = []
    at = 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or (m["tag"] and at):
            raise SelectorError(text)
        if m["tag"]:
            tag = m["tag"].lower()
            tests.append((lambda n: True) if tag == "*" else (lambda n, t=tag: n.tag == t))
        elif m["id"]:
            tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=m["cls"]: v in (n.attrs.get("class") or "").split())
        elif m["attr"]:
            value = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), "")
            tests.append(_attribute(m["attr"], m["op"], value))
        else:
            tests.append(_pseudo(m["pseudo"], m["arg"]))
        at = m.end()
    if not tests:
        raise SelectorError(text)
    return lambda n: all(t(n) for t in tests)


def _split(text: str) -> list[str]:
    """At commas outside of brackets and quotes."""
    out, depth, quote, cur = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(cur)
            cur = ""
            continue
        cur += c
    out.append(cur)
    if depth or quote:
        raise SelectorError(text)
    return [x.strip() for x in out]


_COMBINATOR = re.compile(r"((?:[^\s>+~\[(\"']|\[[^\]]*\]|\([^()]*(?:\([^()]*\)[^()]*)*\))+)|\s*([>+~])\s*|(\s+)")


def _chain(text: str) -> Test:
    """A test of the rightmost element that looks up and back along the combinators."""
    parts: list[tuple[str, Test]] = []
    how, at, text = "", 0, text.strip()
    while at < len(text):
        m = _COMBINATOR.match(text, at)
        if not m:
            raise SelectorError(text)
        if m[1]:
            if parts and not how:
                raise SelectorError(text)
            parts.append((how, _compound(m[1])))
            how = ""
        elif m[2]:
            if not parts or how:
                raise SelectorError(text)
            how = m[2]
        elif not how:
            how = " "
        at = m.end()
    if not parts or how.strip():
        raise SelectorError(text)

    def holds(node: Node, i: int) -> bool:
        if not parts[i][1](node):
            return False
        if i == 0:
            return True
        how = parts[i][0]
        if how == ">":
            return node.parent is not None and holds(node.parent, i - 1)
        if how == " ":
            up = node.parent
            while up is not None:
                if holds(up, i - 1):
                    return True
                up = up.parent
            return False
        before: list[Node] = []
        for k in _elements(node.parent) if node.parent is not None else []:
            if k is node:
                break
            before.append(k)
        if how == "+":
            return bool(before) and holds(before[-1], i - 1)
        return any(holds(k, i - 1) for k in before)

    return lambda n: holds(n, len(parts) - 1)


@lru_cache(1000)
def compile_selector(text: str) -> Test:
    tests = [_chain(x) for x in _split(text)]
    return tests[0] if len(tests) == 1 else lambda n: any(t(n) for t in tests)


def select(root: Node, selector: str) -> Iterator[Node]:
    """Matching elements below ``root``, in document order."""
    test = compile_selector(selector)
    for node in root.walk():
        if node is not root and test(node):
            yield node


def first(root: Node, selector: str) -> Node | None:
    return next(select(root, selector), None)
