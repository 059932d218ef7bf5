"""A reader of the YAML that notes and reports have in their frontmatter.

Mappings and lists by indentation, flow lists and mappings, quoted and plain scalars, literal and folded blocks, comments. Not read: anchors,
tags, several documents, complex keys; they are errors. Dates and times stay text in ISO form.
"""

from __future__ import annotations

import re

# How plain scalars are read.
NULLS, TRUE, FALSE = {"", "~", "null", "Null", "NULL"}, {"true", "True", "TRUE", "yes", "Yes", "on"}, {"false", "False", "FALSE", "no", "No", "off"}
INTEGER, NUMBER = re.compile(r"[-+]?[0-9]+"), re.compile(r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[-+]?[0-9]+[eE][-+]?[0-9]+")
MOMENT = re.compile(r"(\d{4})-(\d\d?)-(\d\d?)(?:[Tt ]+(\d\d?:\d\d(?::\d\d(?:\.\d+)?)?)\s*(Z|[-+]\d\d?(?::?\d\d)?)?)?")
KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}
DEPTH = 50


class BadYaml(ValueError):
    """Text that is no YAML as far as it is read here."""


def load(text: str):
    """The value of a document; a document without content is None."""
    return _Reader(text).document()


class _Reader:
    def __init__(self, text: str):
        self.lines = [(len(line) - len(line.lstrip(" ")), line.lstrip(" ").rstrip(), line) for line in text.replace("\r\n", "\n").split("\n")]
        self.at = 0

    def document(self):
        if self._peek() is None:
            return None
        out = self._block(self._peek()[0], 0)
        if self._peek() is not None:
            raise BadYaml(f"line {self.at + 1} fits no level")
        return out

    def _peek(self):
        while self.at < len(self.lines) and (not self.lines[self.at][1] or self.lines[self.at][1].startswith("#")):
            self.at += 1
        return self.lines[self.at] if self.at < len(self.lines) else None

    def _block(self, indent: int, depth: int):
        if depth > DEPTH:
            raise BadYaml("too many levels")
        _, line, _ = self._peek()
        if line.startswith("\t"):
            raise BadYaml("a tab indents")
        if line == "-" or line.startswith("- "):
            return self._list(indent, depth)
        if KEY.match(line):
            return self._mapping(indent, depth)
        self.at += 1
        return scalar(line)

    def _list(self, indent: int, depth: int) -> list:
        out = []
        while (now := self._peek()) and now[0] == indent and (now[1] == "-" or now[1].startswith("- ")):
            rest = now[1][1:].lstrip()
            if not rest or rest.startswith("#"):
                self.at += 1
                below = self._peek()
                out.append(self._block(below[0], depth + 1) if below and below[0] > indent else None)
            elif KEY.match(rest) and rest[0] not in "[{\"'":
                # a mapping begins on the line of its mark
                inner = indent + len(now[1]) - len(rest)
                self.lines[self.at] = (inner, rest, now[2])
                out.append(self._mapping(inner, depth + 1))
            else:
                out.append(self._value(rest, indent, depth))
        return out

    def _mapping(self, indent: int, depth: int) -> dict:
        out: dict = {}
        while (now := self._peek()) and now[0] == indent:
            m = KEY.match(now[1])
            if not m:
                raise BadYaml(f"line {self.at + 1} has no key")
            key = scalar(m.group(1))
            rest = now[1][m.end() :].strip()
            if rest and not rest.startswith("#"):
                out[str(key)] = self._value(rest, indent, depth)
                continue
            self.at += 1
            below = self._peek()
            if below and (below[0] > indent or (below[0] == indent and (below[1] == "-" or below[1].startswith("- ")))):
                out[str(key)] = self._block(below[0], depth + 1)
            else:
                out[str(key)] = None
        return out

    def _value(self, text: str, indent: int, depth: int):
        if text[0] in "|>":
            return self._literal(text, indent)
        self.at += 1
        if text[0] in "&*!%@`":
            raise BadYaml(f"line {self.at} uses what is not read here")
        if text[0] in "[{":
            while not _closed(text):  # a flow value may go on
                now = self._peek()
                if now is None:
                    raise BadYaml("a bracket is not closed")
                text += " " + now[1]
                self.at += 1
            return _Flow(text).whole()
        while (now := self._peek()) and now[0] > indent and text[0] not in "\"'":  # a plain scalar goes on
            text += " " + now[1]
            self.at += 1
        return scalar(text)

    def _literal(self, mark: str, indent: int) -> str:
        self.at += 1
        part: list[str] = []
        inner = None
        while self.at < len(self.lines):
            own, line, raw = self.lines[self.at]
            if line and own <= indent:
                break
            if line and inner is None:
                inner = own
            part.append(raw[inner or 0 :].rstrip() if line else "")
            self.at += 1
        while part and not part[-1]:
            part.pop()
        if mark[0] == ">":
            text = re.sub(r"(?<=\S)\n(?=\S)", " ", "\n".join(part))
        else:
            text = "\n".join(part)
        return text if "-" in mark or not text else text + "\n"


def _closed(text: str) -> bool:
    depth, quote = 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
    return depth <= 0


class _Flow:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def whole(self):
        out = self.value()
        rest = self.text[self.at :].strip()
        if rest and not rest.startswith("#"):
            raise BadYaml("text after a bracket")
        return out

    def _skip(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        if self.at >= len(self.text):
            raise BadYaml("a bracket is not closed")
        return self.text[self.at]

    def value(self):
        c = self._skip()
        if c == "[":
            self.at += 1
            out = []
            while self._skip() != "]":
                out.append(self.value())
                if self._skip() == ",":
                    self.at += 1
            self.at += 1
            return out
        if c == "{":
            self.at += 1
            found: dict = {}
            while self._skip() != "}":
                key = self.value()
                found[str(key)] = None
                if self._skip() == ":":
                    self.at += 1
                    if self._skip() not in ",}":
                        found[str(key)] = self.value()
                if self._skip() == ",":
                    self.at += 1
            self.at += 1
            return found
        m = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^,\[\]{}:]+(?::(?!\s)[^,\[\]{}:]*)*").match(self.text, self.at)
        if not m:
            raise BadYaml("a bracket holds what is not read here")
        self.at = m.end()
        return scalar(m.group(0).strip())


def scalar(text: str):
    """The value of a scalar; a comment after it is left out."""
    text = text.strip()
    if text[:1] == '"':
        m = re.match(r'"((?:[^"\\]|\\.)*)"\s*(?:#.*)?$', text, re.S)
        if not m:
            raise BadYaml("a quote is not closed")
        return re.sub(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", lambda e: chr(int(e[1] or e[2], 16)) if e[1] or e[2] else ESCAPES.get(e[3], e[3]), m.group(1))
    if text[:1] == "'":
        m = re.match(r"'((?:[^']|'')*)'\s*(?:#.*)?$", text, re.S)
        if not m:
            raise BadYaml("a quote is not closed")
        return m.group(1).replace("''", "'")
    text = re.sub(r"\s+#.*$", "", text)
    if text[:1] in ("[", "{"):
        return _Flow(text).whole()
    if re.search(r":(\s|$)", text):
        raise BadYaml("a key inside a value")
    if text in NULLS:
        return None
    if text in TRUE or text in FALSE:
        return text in TRUE
    if INTEGER.fullmatch(text) and len(text) < 19:
        return int(text)
    if NUMBER.fullmatch(text):
        return float(text)
    if m := MOMENT.fullmatch(text):
        day = f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}"
        return day + (f"T{m[4]}{m[5] or ''}" if m[4] else "")
    return text
