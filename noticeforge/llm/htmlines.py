"""A tolerant reader of HTML that gives text lines with the path of containers around each."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z][^<>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_ATTR = re.compile(r"""\b(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_BLANKS = re.compile(r"[ \t\r\n]+")

#: Elements that end a line, those of them that stand in the path, and what an opening tag closes by itself.
PATH_TAGS = frozenset("body div section main article table tr td th ul ol dl form header footer nav aside address fieldset blockquote center figure".split())
BLOCK_TAGS = PATH_TAGS | frozenset("html head p h1 h2 h3 h4 h5 h6 li dt dd tbody thead tfoot caption pre hr br option select legend figcaption details summary button".split())
_CELLS = frozenset(("td", "th"))
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}


class Line(NamedTuple):
    """text, its innermost tag, its path (container names from the body on), number of the container, letters within links."""

    text: str
    tag: str
    path: tuple[str, ...]
    nodes: tuple[int, ...]
    linked: int


def _label(tag: str, attrs: str) -> str:
    """tag.class of an element, generalised: digits and hashed parts of classes and ids are masked."""
    names = []
    if tag in _CELLS:
        # Layout tables tell their cells apart by how they are set.
        names += [f"[{a}]" for a in ("width", "colspan", "rowspan") if a in attrs]
    for m in _ATTR.finditer(attrs):
        for name in (m[2] or m[3] or m[4] or "").split():
            names.append(("#" if m[1].lower() == "id" else ".") + generalise(name))
    return tag + "".join(sorted(set(names)))


def generalise(name: str) -> str:
    """A class or id without what differs from page to page: digits, and the hash after a prefix."""
    name = name.lower()
    name = re.sub(r"(?<=[-_])(?=[a-z]*\d)[0-9a-z]{5,}$|(?<=[-_])[0-9a-f]{6,}$", "*", name)
    return re.sub(r"\d+", "#", name)


_LABELS: dict[str, str] = {}


def label(tag: str, token: str) -> str:
    """_label with the results of the tags seen so far."""
    if len(token) > 200:
        return _label(tag, token)
    if token not in _LABELS:
        if len(_LABELS) > 50_000:
            _LABELS.clear()
        _LABELS[token] = _label(tag, token)
    return _LABELS[token]


def lines_of(page: str | None) -> list[Line]:
    """The lines of a page; scripts, styles, comments, the title and hidden inputs hold none, a cut-off end is taken as it is."""
    if not page:
        return []
    out: list[Line] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether they are in the path
    path: list[str] = []
    nodes: list[int] = []
    buf: list[str] = []
    state = {"linked": 0, "at": None, "tag": "", "n": 0}
    link = 0

    def flush() -> None:
        text = _BLANKS.sub(" ", html.unescape("".join(buf))).strip(" \t\r\n")
        if text:
            p, k = state["at"] or (tuple(path), tuple(nodes))
            out.append(Line(text, state["tag"], p, k, state["linked"]))
        buf.clear()
        state["linked"], state["at"], state["tag"] = 0, None, ""

    def pop() -> str:
        tag, in_path = stack.pop()
        if in_path:
            path.pop()
            nodes.pop()
        return tag

    def text(piece: str) -> None:
        nonlocal link
        if piece:
            buf.append(piece)
            if state["at"] is None and piece.strip(" \t\r\n"):
                state["at"] = (tuple(path), tuple(nodes))
                state["tag"] = next((t for t, _ in reversed(stack)), "")
            if link:
                state["linked"] += len(piece.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        token = m[0]
        if m[1] or token.startswith(("<!", "<?")):
            continue
        tag = _NAME.match(token)[1].lower()
        closing = token.startswith("</")
        if tag == "a":
            link = 0 if closing else 1
            continue
        if tag not in BLOCK_TAGS:
            continue
        if tag in _CELLS:
            buf.append(" ")
        elif tag not in ("tbody", "thead", "tfoot") or stack and stack[-1][0] not in ("tr", "td"):
            flush()
        if closing:
            if any(t == tag for t, _ in stack):
                bound = {"table"} if tag in ("tr", "td", "th", "tbody") else set()
                for t, _ in reversed(stack):
                    if t == tag:
                        while pop() != tag:
                            pass
                        break
                    if t in bound:
                        break
            link = 0
            continue
        if tag in _VOID:
            continue
        if tag != "p" and stack and stack[-1][0] == "p" or tag == "p" and stack and stack[-1][0] == "p":
            pop()
        if tag in _CLOSES:
            same, bound = _CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in bound:
                    break
                if stack[i][0] in same:
                    while len(stack) > i:
                        pop()
                    break
        in_path = tag in PATH_TAGS
        stack.append((tag, in_path))
        if in_path:
            path.append(label(tag, token))
            state["n"] += 1
            nodes.append(state["n"])
    text(page[at:] if not page[at:].startswith("<") else "")
    flush()
    return out
