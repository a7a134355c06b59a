"""Markdown as plain text, by one scanner for blocks and one for what stands within a line.

What is literal (code, TeX, addresses, names between double underscores) is taken whole where it begins, so nothing within it is markup: neither stars, nor
a pipe that would end a table's cell. Marks of emphasis are paired afterwards, among what is left.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

#: Names between double underscores that are no emphasis. Fixed value.
DUNDERS = "init|new|name|main|file|all|version|dict|class|repr|str|enter|exit|call|iter|next|len|getattr|setattr|getitem|setitem|eq|hash|doc|slots"
#: What boxes of tasks become, what joins a cell to its heading and to the next cell. Fixed values.
DONE, OPEN, OF, AND = "已完成：", "未完成：", "：", "；"

_DUNDER = re.compile(rf"(?<!\w)__(?:{DUNDERS})__(?!\w)")
_ADDRESS = re.compile(r"https?://[^\s<>\[\]()]+")
_POINTED = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_LINK_END = re.compile(r"""\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:"[^"]*"|'[^']*'|\([^()]*\)))?\s*\)""")
_TEX = {"$$": "$$", "\\[": "\\]", "\\(": "\\)"}
#: All that may begin a literal, a link, an escape or a mark; between these nothing is looked at.
_NEXT = re.compile(r"[`$\\_<\[*~]|h(?=ttps?://)|!(?=\[)")
_MARKUP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_QUOTE, _FENCE = re.compile(r"\s*(?:>\s?)+"), re.compile(r"\s*(?:[-*+]\s+|\d{1,9}[.)]\s+)?(`{3,}|~{3,})([^`]*)$")
_HEADING, _BULLET, _NUMBER = re.compile(r"\s{0,3}#{1,6}(?:\s+(.*?))?(?:\s+#+)?\s*$"), re.compile(r"\s*[-*+]\s+(.*)$"), re.compile(r"(\s*(?:[-*+]\s+)?)(\d{1,9})[.)]\s+(.*)$")
_BOX = re.compile(r"\[([ xX])\]\s+")
_RULE, _UNDERLINE = re.compile(r"\s{0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$"), re.compile(r"\s{0,3}(?:=+|-+)\s*$")
_BELOW_HEAD = re.compile(r":?-+:?")


def _wide(c: str) -> bool:
    return "㐀" <= c <= "鿿"


class _Source:
    """A text, and where in it literals and brackets end; what needs a look at the whole text is found once."""

    def __init__(self, text: str) -> None:
        self.text, self.absent = text, {}

    @cached_property
    def dollars(self) -> list[int]:
        """Signs that may end a formula."""
        return [m.start() for m in re.finditer(r"(?<![\s\\])\$", self.text)]

    @cached_property
    def brackets(self) -> dict[int, int]:
        """Where each bracket closes."""
        out, open_, at = {}, [], 0
        while at < len(self.text):
            c = self.text[at]
            if c == "\\" and self.literal(at) is None:
                at += 2
                continue
            if c in "`$<\\" and (found := self.literal(at)):
                at = found[0]
                continue
            if c == "[":
                open_.append(at)
            elif c == "]" and open_:
                out[open_.pop()] = at
            at += 1
        return out

    def find(self, end: str, at: int) -> int:
        """The next `end` from `at` on, -1 if there is none; it is looked for in vain once."""
        if at >= self.absent.get(end, len(self.text) + 1):
            return -1
        if (found := self.text.find(end, at)) < 0:
            self.absent[end] = at
        return found

    def ticks(self, size: int, at: int) -> int:
        """The next run of just so many backticks."""
        while (found := self.find("`" * size, at)) >= 0:
            run = re.compile("`+").match(self.text, found)[0]
            if len(run) == size:
                return found
            at = found + len(run)
        return -1

    def literal(self, at: int) -> tuple[int, str] | None:
        """Where the literal that begins at `at` ends, and what it reads as; None if none begins there."""
        text, c = self.text, self.text[at]
        if c == "`":
            size = len(re.compile("`+").match(text, at)[0])
            close = self.ticks(size, at + size)
            return (close + size, text[at + size : close]) if close >= 0 else (len(text), text[at + size :])
        if c in "$\\" and (end := _TEX.get(text[at : at + 2])):
            stop = self.find(end, at + 2)
            return (stop + 2, text[at : stop + 2]) if stop >= 0 else None
        if c == "$" and text[at + 1 : at + 2].strip():
            k = bisect_right(self.dollars, at + 1)
            tick = self.find("`", at)
            if k < len(self.dollars) and not 0 <= tick < self.dollars[k]:
                return self.dollars[k] + 1, text[at : self.dollars[k] + 1]
            return None
        if c == "_" and (m := _DUNDER.match(text, at)):
            return m.end(), m[0]
        if c == "<" and (m := _POINTED.match(text, at)):
            return m.end(), m[1]
        if c == "h" and (m := _ADDRESS.match(text, at)):
            kept = m[0].rstrip("*_")
            return at + len(kept), kept
        return None

    def link(self, at: int, depth: int) -> tuple[int, str] | None:
        """The link or image at `at` as its label and address; an address that is its own label stands once. Labels within labels are read to a bounded depth."""
        image = self.text[at] == "!"
        close = self.brackets.get(at + image)
        m = _LINK_END.match(self.text, close + 1) if close and depth else None
        if not m:
            return None
        label, target = inline(self.text[at + image + 1 : close], depth - 1), re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", m[1] if m[1] is not None else m[2])
        return m.end(), label if label == target and not image else f"{label}（{target}）"


class _Marks:
    """A run of marks, and whether it may open and close emphasis."""

    def __init__(self, text: str, at: int, end: int) -> None:
        self.sign, self.left, self.size = text[at], end - at, end - at
        before, after = text[at - 1 : at] or " ", text[end : end + 1] or " "
        mark = lambda c: not (c.isalnum() or c.isspace()) or (self.sign == "_" and _wide(c))
        opens = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
        closes = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
        word = lambda c: c.isascii() and (c.isalnum() or c == "_")
        if self.sign == "_":
            opens, closes = opens and (not closes or mark(before)), closes and (not opens or mark(after))
        elif self.sign == "*" and (word(before) or before == ")") and (word(after) or after == "("):
            opens = closes = False  # an operator
        self.opens, self.closes = (opens, closes) if self.sign != "~" or self.size == 2 else (False, False)
        #: Marks that models leave before wide characters, without a counterpart.
        self.stray = self.sign == "*" and _wide(after) and (at == 0 and self.size <= 3 or self.size in (2, 3) and not (before.isascii() and (before.isalnum() or before == "*")))


def _scanned(text: str, depth: int) -> Iterator[str | _Marks]:
    source, at, plain = _Source(text), 0, 0
    while m := _NEXT.search(text, at):
        at = m.start()
        c, found = text[at], None
        if c in "`$\\_<h":
            found = source.literal(at)
        if found is None and c == "\\" and text[at + 1 : at + 2] and text[at + 1] in _MARKUP:
            found = at + 2, text[at + 1]
        if found is None and (c == "[" or c == "!" and text[at + 1 : at + 2] == "["):
            found = source.link(at, depth)
        if found is None and c in "*_~":
            end = at
            while text[end : end + 1] == c:
                end += 1
            found = end, _Marks(text, at, end)
        if found is None:
            at += 1
            continue
        yield text[plain:at]
        yield found[1]
        at = plain = found[0]
    yield text[plain:]


def inline(text: str, depth: int = 10) -> str:
    """What stands within a line, without its markup."""
    if not _NEXT.search(text):
        return text
    pieces = list(_scanned(text, depth))
    opened: list[_Marks] = []
    waiting = Counter()  # how many of each sign are open
    for piece in pieces:
        if not isinstance(piece, _Marks):
            continue
        while piece.closes and piece.left and waiting[piece.sign]:
            while opened[-1].sign != piece.sign:  # what is open within ends here
                waiting[opened.pop().sign] -= 1
            taken = min(piece.left, opened[-1].left, 2)
            piece.left -= taken
            opened[-1].left -= taken
            if not opened[-1].left:
                waiting[opened.pop().sign] -= 1
        if piece.opens and piece.left:
            opened.append(piece)
            waiting[piece.sign] += 1
    read = lambda m: "" if m.stray and m.left == m.size else m.sign * m.left
    return "".join(read(p) if isinstance(p, _Marks) else p for p in pieces)


def cells(line: str) -> list[str]:
    """The cells of a table's line. Pipes within code, TeX and after a backslash end none."""
    line, out, start, at = line.strip(), [], 0, 0
    source = _Source(line)
    while at < len(line):
        if line[at] in "`$\\" and (found := source.literal(at)) and found[0] <= len(line) and (line[at] != "`" or line[found[0] - 1] == "`"):
            at = found[0]
        elif line[at] == "\\":
            at += 2
        elif line[at] == "|":
            out.append(line[start:at].strip())
            at = start = at + 1
        else:
            at += 1
    out.append(line[start:].strip())
    return out[line.startswith("|") : len(out) - (line.endswith("|") and not out[-1] and len(out) > 1)]


def _is_code(line: str) -> bool:
    """Whether a line is one statement that assigns, calls, computes, compares or lists, in ASCII names."""
    if not re.search(r"[=(\[{<>+\-*/%|&^]", line):
        return False
    try:
        body = ast.parse(line).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    node = body[0] if len(body) == 1 else None
    value = node.value if isinstance(node, ast.Expr) else None
    fits = isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)) or isinstance(value, (ast.Call, ast.BinOp, ast.Compare, ast.Dict, ast.List, ast.Set))
    return fits and all(n.id.isascii() for n in ast.walk(node) if isinstance(n, ast.Name))


def _heads(lines: list[str], at: int) -> list[str] | None:
    """The cells of a table's heading, if one stands at `at`."""
    if "|" not in lines[at] or at + 1 >= len(lines) or "-" not in lines[at + 1]:
        return None
    heads, below = cells(lines[at]), cells(lines[at + 1])
    return heads if len(heads) == len(below) and all(_BELOW_HEAD.fullmatch(c) for c in below) else None


def _row(line: str, heads: list[str]) -> str:
    values = [inline(c.replace("\\|", "|")) for c in cells(line)]
    return AND.join((f"{heads[n]}{OF}" if n < len(heads) and heads[n] else "") + v for n, v in enumerate(values))


def _line(line: str) -> str:
    """A line that is neither code nor part of a table."""
    if m := _HEADING.match(line):
        return inline(m[1] or "")
    number = ""
    if m := _NUMBER.match(line):
        number, line = f"{m[2]}. ", m[3]
    elif m := _BULLET.match(line):
        line = m[1]
    else:
        return inline(line.strip())
    box = ""
    if m := _BOX.match(line):
        box, line = OPEN if m[1] == " " else DONE, line[m.end() :]
    return number + box + inline(line.strip())


def plain_of(text: str | None) -> str:
    """Markdown as plain lines: headings and marks go, rows of tables become `head：cell；`, what is literal stays as it is; several blank lines become one."""
    lines = [line if _FENCE.match(line) else line[m.end() :] if (m := _QUOTE.match(line)) else line for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    out: list[str] = []
    at, blank = 0, True  # blank: no paragraph is open, so a line of dashes underlines nothing
    while at < len(lines):
        line = lines[at]
        at += 1
        if m := _FENCE.match(line):
            while at < len(lines) and not re.fullmatch(rf"\s*{re.escape(m[1][0])}{{{len(m[1])},}}\s*", lines[at]):
                out.append(lines[at])
                at += 1
            at, blank = at + 1, True
        elif line.lstrip().startswith(("$$", "\\[")):
            end = _TEX[line.lstrip()[:2]]
            stop = at if end in line.lstrip()[2:] else next((k + 1 for k in range(at, len(lines)) if end in lines[k]), None)
            out += [inline(line)] if stop is None else lines[at - 1 : stop]
            at, blank = stop or at, False
        elif not line.strip():
            out += [""] if out and out[-1] else []
            blank = True
        elif _RULE.match(line) or not blank and _UNDERLINE.match(line):
            blank = True
        elif (heads := _heads(lines, at - 1)) is not None:
            heads = [inline(h.replace("\\|", "|")) for h in heads]
            at += 1
            first = at
            while at < len(lines) and "|" in lines[at]:
                out.append(_row(lines[at], heads))
                at += 1
            out += [AND.join(heads)] if at == first else []
            blank = True
        elif _is_code(line.strip()):
            out.append(line.rstrip())
            blank = False
        else:
            out.append(_line(line))
            blank = False
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n").strip()
