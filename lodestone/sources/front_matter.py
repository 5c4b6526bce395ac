"""Front matter as data: the part of YAML that people write at the head of a note.

Mappings and lists by indentation, flow ones in brackets, plain, single- and double-quoted scalars over one or more lines, and
block scalars with their chomping. `null`, `~` and nothing are null, `true` and `false` are truth values, and every other scalar
is text as it is written, numbers and dates too. Anchors, tags and several documents are errors.
"""

from __future__ import annotations

import re

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{}#&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "e": "\x1b", "b": "\b", "f": "\f", "v": "\v", "a": "\a", " ": " ", "/": "/", "\\": "\\", '"': '"', "N": "\x85", "_": "\xa0"}


class _Lines:
    def __init__(self, text: str) -> None:
        self.lines = text.split("\n")
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        """Indent and text of the next line that isn't blank or a comment."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            bare = line.lstrip(" ")
            if bare.startswith("\t") and bare.strip():
                raise ValueError(f"tab in the indentation of line {self.at + 1}")
            if bare and not bare.startswith("#"):
                return len(line) - len(bare), bare.rstrip()
            self.at += 1
        return None


def _uncommented(text: str) -> str:
    """Text up to a comment that isn't within quotes."""
    quote = ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and not (quote == '"' and text[i - 1] == "\\") else quote
        elif c in "\"'" and (i == 0 or text[i - 1] in " [{,:'"):
            quote = c
        elif c == "#" and (i == 0 or text[i - 1] in " \t"):
            return text[:i].rstrip()
    return text.rstrip()


def _plain(text: str) -> object:
    if text[:1] in ("&", "*", "!", "%", "@", "`"):
        raise ValueError(f"not read: {text[:20]}")
    return {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "false": False, "False": False}.get(text, text)


def _double(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "xuU":
            return chr(int(c[1:], 16))
        if c not in _ESCAPES:
            raise ValueError(f"unknown escape \\{c}")
        return _ESCAPES[c]

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, text)


def _flow(text: str, at: int) -> tuple[object, int]:
    """A flow value of `text` from `at` on, and where it ends."""
    at += len(text[at:]) - len(text[at:].lstrip())
    if at >= len(text):
        raise ValueError("a bracket is open")
    if text[at] in "[{":
        close, out, at = {"[": "]", "{": "}"}[text[at]], ([] if text[at] == "[" else {}), at + 1
        while True:
            at += len(text[at:]) - len(text[at:].lstrip(" ,"))
            if at >= len(text):
                raise ValueError("a bracket is open")
            if text[at] == close:
                return out, at + 1
            value, at = _flow(text, at)
            if isinstance(out, dict):
                at += len(text[at:]) - len(text[at:].lstrip())
                if text[at : at + 1] == ":":
                    out[str(value)], at = _flow(text, at + 1)
                else:
                    out[str(value)] = None
            else:
                out.append(value)
    m = re.compile(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\']|\'\')*)\'').match(text, at)
    if m:
        return (_double(m[1]) if m[1] is not None else m[2].replace("''", "'")), m.end()
    m = re.compile(r"(?:[^,\[\]{}:]|:(?!\s|$|[,\]}]))*").match(text, at)
    return _plain(m[0].strip()), m.end()


def _open(text: str) -> bool:
    """Whether quotes or brackets that a value begins with are still open."""
    if text[:1] == '"':
        return re.fullmatch(r'"(?:[^"\\]|\\.)*"', text) is None
    if text[:1] == "'":
        return re.fullmatch(r"'(?:[^']|'')*'", text) is None
    bare = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'', "", text)
    return text[:1] in ("[", "{") and sum(bare.count(c) for c in "[{") > sum(bare.count(c) for c in "]}")


def _block(lines: _Lines, head: str, indent: int) -> str:
    """A block scalar: `|` keeps lines, `>` joins them; `-` and `+` say what becomes of the line ends behind it."""
    m = re.fullmatch(r"([|>])([+-]?)([1-9]?)([+-]?)", head)
    if not m:
        raise ValueError(f"not read: {head[:20]}")
    held: list[str] = []
    while lines.at < len(lines.lines):
        line = lines.lines[lines.at]
        if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
            break
        held.append(line)
        lines.at += 1
    full = [x for x in held if x.strip()]
    depth = indent + int(m[3]) if m[3] else min((len(x) - len(x.lstrip(" ")) for x in full), default=0)
    held = [x[depth:] for x in held]
    while held and not held[-1].strip():
        held.pop()
    trailing = "" if "-" in (m[2], m[4]) or not held else "\n"
    if m[1] == "|":
        return "\n".join(held) + trailing
    out = ""
    for before, line in zip([None, *held], held, strict=False):
        if before is None:
            out = line
        elif not line.strip():
            out += "\n"
        else:
            # lines that are indented further, or follow an empty one, are not joined
            out += line if out.endswith("\n") and not before.strip() else ("\n" if line[:1] == " " or before[:1] == " " else " ") + line
    return out + trailing


def _scalar(lines: _Lines, text: str, indent: int) -> object:
    """The value that begins with `text`; further lines belong to it if quotes or brackets are open or they are indented further."""
    if text[:1] in ("|", ">"):
        return _block(lines, _uncommented(text), indent)
    quoted = text[:1] in ("\"", "'", "[", "{")
    text = _uncommented(text)
    while lines.at < len(lines.lines) and (_open(text) if quoted else True):
        following = lines.peek()
        if following is None or (not quoted and (following[0] <= indent or _KEY.match(following[1]))):
            break
        lines.at += 1
        text += " " + _uncommented(following[1])
    if not quoted:
        return _plain(text)
    if _open(text):
        raise ValueError("quotes or brackets are open")
    value, end = _flow(text, 0)
    if text[end:].strip():
        raise ValueError(f"text behind a value: {text[end:].strip()[:20]}")
    return value


def _value(lines: _Lines, indent: int) -> object:
    """What stands below a key or dash, from `indent` on."""
    first = lines.peek()
    if first is None or first[0] < indent:
        return None
    depth, text = first
    if text == "-" or text.startswith("- "):
        out: list = []
        while (line := lines.peek()) and line[0] == depth and (line[1] == "-" or line[1].startswith("- ")):
            out.append(_item(lines, line[1][1:], depth))
        return out
    if not _KEY.match(text):
        lines.at += 1
        return _scalar(lines, text, depth - 1)
    found: dict = {}
    while (line := lines.peek()) and line[0] == depth:
        m = _KEY.match(line[1])
        if not m:
            raise ValueError(f"no key in line {lines.at + 1}")
        key = m[1][1:-1] if m[1][:1] in ("\"", "'") else m[1]
        if key in found:
            raise ValueError(f"{key} stands twice")
        lines.at += 1
        rest = line[1][m.end() :].strip()
        if rest and not rest.startswith("#"):
            found[key] = _scalar(lines, rest, depth)
        else:
            following = lines.peek()
            # a list may stand as far left as its key
            below = depth if following and following[0] == depth and (following[1] == "-" or following[1].startswith("- ")) else depth + 1
            found[key] = _value(lines, below)
    if (line := lines.peek()) and line[0] > depth:
        raise ValueError(f"line {lines.at + 1} is indented too far")
    return found


def _item(lines: _Lines, rest: str, depth: int) -> object:
    inner = rest.strip()
    if not inner or inner.startswith("#"):
        lines.at += 1
        return _value(lines, depth + 1)
    if _KEY.match(inner) or inner.startswith("- "):
        # what follows the dash is a block of its own, as far right as it stands
        lines.lines[lines.at] = " " * (depth + 1 + len(rest) - len(rest.lstrip())) + inner
        return _value(lines, depth + 1)
    lines.at += 1
    return _scalar(lines, inner, depth)


def parse(text: str) -> dict:
    """The mapping that a front matter holds; ValueError says why it holds none."""
    lines = _Lines(text)
    if lines.peek() is None:
        return {}
    found = _value(lines, 0)
    if lines.peek() is not None:
        raise ValueError(f"line {lines.at + 1} belongs to nothing")
    if not isinstance(found, dict):
        raise ValueError("no mapping")
    return found
