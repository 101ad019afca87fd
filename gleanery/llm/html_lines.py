"""Line-preserving views of HTML, shared by the page operators.

Lines are counted from 1 and split at line feeds only. Script, style and
comment bodies and tags may run over several lines; they are blanked in place
so that every later line keeps its number.
"""

from __future__ import annotations

import html as _html
import re

_HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!/?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


def _keep_breaks(m: re.Match) -> str:
    s = m.group()
    n = s.count("\n")
    return "\n" * n if n else ""


def visible_lines(page: str | None) -> list[str]:
    """Visible text of every physical line, white space collapsed."""
    if not page:
        return []
    bare = _HIDDEN.sub(_keep_breaks, page)
    out = []
    for line in bare.split("\n"):
        if "&" in line:
            line = _html.unescape(line)
        out.append(_SPACE.sub(" ", line).strip())
    return out


def line_key(visible: str) -> str:
    """Equality form of a visible line: case and digit runs do not count."""
    return _SPACE.sub(" ", _DIGITS.sub("0", visible.lower())).strip()


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w-]*)([^>]*)>|<![^>]*>|\n|[^<\n]+|<",
    re.S | re.I,
)
_CLASS = re.compile(r"""class\s*=\s*["']?([^"'>]*)""", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
BRANCHES = frozenset(
    "div nav main aside footer header section article table body form".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: Containers nested deeper count as part of the container at this depth.
MAX_DEPTH = 16


class LineView:
    """One text-bearing line of a page and its place in the page's tree."""

    __slots__ = ("no", "text", "branch", "heading", "link_chars")

    def __init__(self, no: int, branch: int, heading: bool):
        self.no, self.branch, self.heading = no, branch, heading
        self.text = ""
        self.link_chars = 0


class Branch:
    """A container element: its path of tags and classes, and its presentation
    style, the sequence of the elements directly inside it."""

    __slots__ = ("parent", "path", "depth", "style", "bare")

    def __init__(self, parent: int, path: str, depth: int):
        self.parent, self.path, self.depth = parent, path, depth
        self.style: list[str] = []
        self.bare = True


def page_view(page: str | None) -> tuple[str, list[LineView], list[Branch]]:
    """The page title, its body lines with branch and links, and its branches.

    A branch is the innermost open container element that holds block
    elements; a container of bare text counts as a paragraph of the branch
    around it, unless that is the body. Unclosed paragraphs and
    list items end at the next block element; a close tag closes everything
    opened after its partner."""
    title, in_title, in_head = "", False, False
    stack: list[tuple[str, int]] = [("body", 0)]
    branches = [Branch(0, "body", 0)]
    branches[0].bare = False
    leaf = ""
    link = False
    rows: list[LineView] = []
    no, cur = 1, None
    for m in _TOKEN.finditer(page or ""):
        s = m.group()
        if s == "\n":
            no += 1
            cur = None
            continue
        if m.group(3):
            tag, closing, attrs = m.group(3).lower(), bool(m.group(2)), m.group(4)
            if tag == "head":
                in_head = not closing
            elif tag == "title":
                in_title = not closing
            elif tag == "a":
                link = not closing and bool(_HREF.search(attrs))
            elif tag in BRANCHES:
                leaf = ""
                link = False
                if not closing:
                    if tag != "body":
                        cls = _CLASS.search(attrs)
                        name = f"{tag}.{cls.group(1) if cls else ''}"
                        above = branches[stack[-1][1]]
                        above.bare = False
                        above.style.append(name)
                        if above.depth < MAX_DEPTH:
                            branches.append(Branch(stack[-1][1], f"{above.path}/{name}", above.depth + 1))
                            stack.append((tag, len(branches) - 1))
                        else:
                            stack.append((tag, stack[-1][1]))
                elif any(t == tag for t, _ in stack[1:]):
                    while stack[-1][0] != tag:
                        stack.pop()
                    stack.pop()
            elif tag in HEADINGS or tag in ("p", "li", "blockquote", "td", "span", "button", "dd", "dt"):
                if closing:
                    if tag != "span":
                        leaf = ""
                else:
                    branches[stack[-1][1]].bare = False
                    branches[stack[-1][1]].style.append(tag)
                    leaf = tag
            if "\n" in s:
                no += s.count("\n")
                cur = None
            continue
        if s[0] == "<" and len(s) > 1:
            if "\n" in s:
                no += s.count("\n")
                cur = None
            continue
        if in_title:
            title += s
            continue
        if in_head:
            continue
        text = _html.unescape(s) if "&" in s else s
        if cur is None:
            if not text.strip():
                continue
            cur = LineView(no, stack[-1][1], leaf in HEADINGS)
            rows.append(cur)
        cur.text += text
        if link:
            cur.link_chars += len(text.strip())
    for r in rows:
        own = branches[r.branch]
        if own.bare and own.parent:
            r.branch = own.parent
        r.text = _SPACE.sub(" ", r.text).strip()
    return _SPACE.sub(" ", _html.unescape(title)).strip(), [r for r in rows if r.text], branches
