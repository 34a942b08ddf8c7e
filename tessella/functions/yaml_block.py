"""A reader for the leading block of a document: the part of YAML that such blocks use.

Nested maps and lists by indentation, flow lists and maps over any number of lines,
quoted and plain scalars (plain ones may go on in deeper lines), literal and folded
block scalars with their indicators, comments. Anchors, aliases, tags and complex keys
are not read. Nothing raises: what is not understood is left out and named.
"""

from __future__ import annotations

import json
import re

_KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s"'\[\]{}#&*!|>%@`,?-][^#]*?|[-?][^\s#][^#]*?))\s*:(?:\s+|$)""")
_NUMBER = re.compile(r"[-+]?(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][-+]?[0-9]+)?$")
_WHOLE = re.compile(r"[-+]?[0-9][0-9_]*$")
_BASED = re.compile(r"0(?:x[0-9a-fA-F]+|o[0-7]+|b[01]+)$")
_DAY = re.compile(r"\d{4}-\d\d?-\d\d?(?:(?:[Tt]|[ \t]+)\d\d?:\d\d:\d\d(?:\.\d*)?(?:[ \t]*(?:Z|[-+]\d\d?(?::\d\d)?))?)?$")
_COMMENT = re.compile(r"(?:^|[ \t])#.*$")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", "_": "\xa0", " ": " ", "/": "/", '"': '"', "\\": "\\"}
_WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False, ".inf": float("inf"), "-.inf": float("-inf"), ".nan": float("nan")}


class Day(str):
    """A date or a time, which is no string to a reader of fields."""


class _Open(Exception):
    """A flow value or a quoted scalar goes on in the next line."""


def scalar(text: str):
    """The value of a plain scalar."""
    if text in _WORDS:
        return _WORDS[text]
    if _BASED.match(text):
        return int(text, 0)
    if _WHOLE.match(text):
        return int(text.replace("_", ""))
    if _NUMBER.match(text):
        return float(text.replace("_", ""))
    return Day(text) if _DAY.match(text) else text


def _quoted(s: str, at: int) -> tuple[str, int]:
    """A quoted scalar at ``at`` and the place behind it."""
    mark, out, k = s[at], [], at + 1
    while k < len(s):
        c = s[k]
        if mark == "'" and c == "'":
            if s[k + 1 : k + 2] != "'":
                return "".join(out), k + 1
            k += 1
        elif mark == '"' and c == '"':
            return "".join(out), k + 1
        elif mark == '"' and c == "\\":
            k += 1
            width = {"x": 2, "u": 4, "U": 8}.get(s[k : k + 1])
            if width:
                digits = s[k + 1 : k + 1 + width]
                c = chr(int(digits, 16)) if re.fullmatch(r"[0-9a-fA-F]+", digits) and int(digits, 16) < 0x110000 else "\ufffd"
                k += width
            else:
                c = _ESCAPES.get(s[k : k + 1], s[k : k + 1])
        out.append(c)
        k += 1
    raise _Open


def flow(s: str, at: int = 0, deep: int = 0) -> tuple[object, int]:
    """A flow value at ``at`` and the place behind it."""
    at = _skip(s, at)
    if s[at] in "\"'":
        return _quoted(s, at)
    if s[at] not in "[{":
        end = re.compile(r",|\]|\}|:(?=\s|$)" if deep else r"$").search(s, at)
        if end is None:
            raise _Open
        return scalar(s[at : end.start()].strip()), end.start()
    many, close = s[at] == "[", "]" if s[at] == "[" else "}"
    items, pairs, at = [], {}, _skip(s, at + 1)
    while s[at] != close:
        value, at = flow(s, at, deep + 1)
        at = _skip(s, at)
        if s[at] == ":":
            key = "" if value is None else str(value)
            at = _skip(s, at + 1)
            value, at = (None, at) if s[at] in ",}]" else flow(s, at, deep + 1)
            value = {key: value} if many else value
            at = _skip(s, at)
        elif not many:
            key, value = "" if value is None else str(value), None
        if many:
            items.append(value)
        else:
            pairs.setdefault(key, value)
        if s[at] == ",":
            at = _skip(s, at + 1)
        elif s[at] != close:
            raise ValueError("a list or map in one line")
    return (items if many else pairs), at + 1


def _skip(s: str, at: int) -> int:
    while at < len(s) and (s[at] in " \t\n" or (s[at] == "#" and at and s[at - 1] in " \t\n")):
        at = (s.find("\n", at) if "\n" in s[at:] else len(s)) if s[at] == "#" else at + 1
    if at >= len(s):
        raise _Open
    return at


class _Reader:
    def __init__(self, text: str):
        self.lines, self.at, self.problems = text.replace("\r\n", "\n").split("\n"), 0, []

    def peek(self) -> tuple[int, str] | None:
        """Indentation and text of the next line with something in it."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            text = line.strip(" \t")
            if text and not text.startswith("#"):
                return len(line) - len(line.lstrip(" ")), text
            self.at += 1
        return None

    def node(self, indent: int):
        """The value that begins in the next line."""
        _, text = self.peek()
        if text == "-" or text.startswith("- "):
            return self.sequence(indent)
        if _KEY.match(text):
            return self.mapping(indent)
        self.at += 1
        return self.value(text, indent - 1)

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while (line := self.peek()) and line[0] >= indent:
            m = _KEY.match(line[1])
            if line[0] > indent or not m or line[1].startswith("- "):
                if line[0] == indent and line[1].startswith("- "):
                    break
                self.problems.append(f"line {self.at + 1}")
                self.at += 1
                continue
            self.at += 1
            key = _quoted('"' + m[1] + '"', 0)[0] if m[1] is not None else m[2].replace("''", "'") if m[2] is not None else m[3].strip()
            value = self.value(line[1][m.end() :], indent)
            if key in out:
                self.problems.append(f"repeated key {key}")
            else:
                out[key] = value
        return out

    def sequence(self, indent: int) -> list:
        out = []
        while (line := self.peek()) and line[0] == indent and (line[1] == "-" or line[1].startswith("- ")):
            rest = line[1][1:].lstrip(" ")
            inner = indent + len(line[1]) - len(rest)
            if _KEY.match(rest) and rest[0] not in "\"'[{" or rest.startswith("- "):
                self.lines[self.at] = " " * inner + rest  # a map or list that begins behind the dash
                out.append(self.node(inner))
            else:
                self.at += 1
                out.append(self.value(rest, indent, in_list=True))
        return out

    def value(self, rest: str, indent: int, in_list: bool = False):
        """The value that begins with ``rest``, behind a key or dash at ``indent``."""
        if rest[:1] in ("|", ">") and re.match(r"[|>][-+0-9]{0,2}\s*(?:#.*)?$", rest):
            return self.block_scalar(rest, indent)
        if rest[:1] in ("[", "{", '"', "'"):
            return self.spread(rest, indent)
        rest = _COMMENT.sub("", rest).strip()
        if rest[:1] in ("&", "*", "!"):
            self.problems.append(f"not read: {rest.split()[0]}")
        if rest:
            while (line := self.peek()) and line[0] > indent:
                rest += " " + _COMMENT.sub("", line[1]).strip()
                self.at += 1
            return scalar(rest)
        line = self.peek()
        if line and (line[0] > indent or line[0] == indent and line[1].startswith("- ") and not in_list):
            return self.node(line[0])
        return None

    def spread(self, text: str, indent: int):
        """A quoted or flow value over as many lines as it needs."""
        glue = "\n" if text[0] in "[{" else " "
        while True:
            try:
                value, end = flow(text)
                if _COMMENT.sub("", " " + text[end:]).strip():
                    self.problems.append(f"after a value: {text[end:].strip()}")
                return value
            except _Open:
                if self.at >= len(self.lines):
                    self.problems.append("a value without an end")
                    return None
                text += glue + self.lines[self.at].strip()
                self.at += 1
            except ValueError as e:
                self.problems.append(str(e))
                return None

    def block_scalar(self, head: str, indent: int) -> str:
        own = re.search(r"[1-9]", head)
        lines: list[str] = []
        depth = max(indent, 0) + int(own[0]) if own else None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            lead = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                if depth is None:
                    depth = lead
                if lead < depth or lead <= indent:
                    break
            lines.append(line)
            self.at += 1
        body = [line[depth or 0 :] for line in lines]
        kept = len(body)
        while kept and not body[kept - 1].strip(" "):
            kept -= 1
        text = "\n".join(body[:kept])
        if head[0] == ">":  # lines that begin with a blank stay lines of their own
            text = re.sub(r"(?<=[^\n])\n(?=[^\n \t])(?<![ \t]\n)", " ", text)
            text = re.sub(r"\n(\n+)(?=[^ \t])", r"\1", text)
        end = "" if "-" in head or not kept else "\n"
        return text + (("\n" * (len(body) - kept + 1)) if "+" in head and kept else end)


def read_block(text: str) -> tuple[dict, list[str]]:
    """The keys of a block, of a repeated one the first, and what was not understood."""
    reader = _Reader(text)
    out: dict = {}
    if line := reader.peek():
        try:
            found = reader.node(line[0])
        except (RecursionError, ValueError):  # thousands of brackets or digits
            return {}, ["too deep or too long"]
        out = found if isinstance(found, dict) else {}
        if not isinstance(found, dict):
            reader.problems.append("no keys")
        if reader.peek():
            reader.problems.append(f"line {reader.at + 1}")
    return out, reader.problems


def as_json(value: object) -> str:
    """JSON of a value with sorted keys; numbers that are none in JSON are null."""
    def plain(v: object) -> object:
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return None if isinstance(v, float) and not -1e309 < v < 1e309 else v

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True)
