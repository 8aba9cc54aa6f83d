"""Lexers with pushdown stacks for JSON, TOML and XML. Each raises Reject, naming the defect, unless the text is well formed."""

from __future__ import annotations

import re

from chunkloom.llm.pylex import Reject

JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-])|(?:true|false|null)(?!\w))|([\[\]{},:]))', re.A)


def json(text: str) -> None:
    """Strict JSON: one value; no comments, trailing commas, bare words or unescaped control characters."""
    stack: list[str] = []
    at, n = 0, len(text)
    #: What is due: v value, k key, k} key or end, v] value or end, : colon, , comma or end, . nothing.
    due = "v"
    while True:
        m = JSON_TOKEN.match(text, at)
        if not m:
            rest = text[at:].lstrip(" \t\n\r")
            if rest:
                raise Reject("unterminated_literal" if rest[0] == '"' else "merge_conflict" if re.match(r"<{7}|={7}|>{7}|\|{7}", rest) else "invalid_token")
            if due != ".":
                raise Reject("premature_end")
            return
        at = m.end()
        string, scalar, mark = m.groups()
        if due == ".":
            raise Reject("grammar")
        if string is not None and due in ("k", "k}"):
            due = ":"
        elif string is not None or scalar is not None:
            if due not in ("v", "v]"):
                raise Reject("grammar")
            due = "," if stack else "."
        elif mark in "{[":
            if due not in ("v", "v]"):
                raise Reject("grammar")
            stack.append(mark)
            due = "k}" if mark == "{" else "v]"
        elif mark in "}]":
            if not stack or stack[-1] != ("{" if mark == "}" else "["):
                raise Reject("unbalanced_delimiter")
            if due not in (",", "k}", "v]"):
                raise Reject("grammar")
            stack.pop()
            due = "," if stack else "."
        elif mark == ",":
            if due != "," or not stack:
                raise Reject("grammar")
            due = "k" if stack[-1] == "{" else "v"
        else:
            if due != ":":
                raise Reject("grammar")
            due = "v"


BASIC = r'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]++|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*+"'
LITERAL = r"'[^'\x00-\x08\x0a-\x1f\x7f]*+'"
LONG_BASIC = r'"""(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]++|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n\s*)|"{1,2}(?!"))*+"""(?:"{1,2}(?!"))?'
LONG_LITERAL = r"'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]++|'{1,2}(?!'))*+'''(?:'{1,2}(?!'))?"
DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?"
OFFSET = r"(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)"
INTEGER = r"[+-]?(?:0|[1-9](?:_?\d)*)"
TOML_VALUE = re.compile(
    rf"(?:{LONG_BASIC}|{LONG_LITERAL}|(?!\"\"\"){BASIC}|(?!'''){LITERAL}|(?:{DATE}(?:[Tt ]{TIME}{OFFSET}?)?|{TIME}|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|{INTEGER}(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|[+-]?(?:inf|nan)|true|false)(?![\w.:+-]))",
    re.A,
)
TOML_KEY = re.compile(rf"[ \t]*(?:[A-Za-z0-9_-]++|(?!\"\"\"){BASIC}|(?!'''){LITERAL})[ \t]*(?:\.[ \t]*(?:[A-Za-z0-9_-]++|{BASIC}|{LITERAL})[ \t]*)*+", re.A)
BLANK = re.compile(r"[ \t]*+(?:#[^\x00-\x08\x0a-\x1f\x7f]*+)?+")
LINES = re.compile(r"(?:[ \t\n]|\r\n|#[^\x00-\x08\x0a-\x1f\x7f]*+(?=\n|\r\n|$))*+")
SPACE = re.compile(r"[ \t]*+")


def toml_value(text: str, at: int) -> int:
    """The end of the value at `at`. The stack holds the open arrays and inline tables."""
    stack: list[str] = []
    while True:
        at = (LINES if stack and stack[-1] == "[" else SPACE).match(text, at).end()
        c = text[at : at + 1]
        if c == "[":
            stack.append("[")
            at = LINES.match(text, at + 1).end()
            if text[at : at + 1] != "]":
                continue
        elif c == "{":
            stack.append("{")
            at = SPACE.match(text, at + 1).end()
            if text[at : at + 1] != "}":
                at = toml_assign(text, at)
                continue
        else:
            m = TOML_VALUE.match(text, at)
            if not m:
                raise Reject("premature_end" if not c else "unterminated_literal" if c in "\"'" else "grammar")
            at = m.end()
            if not stack:
                return at
        while stack:  # an item of the innermost collection, or that collection, has ended
            kind = stack[-1]
            at = (LINES if kind == "[" else SPACE).match(text, at).end()
            c = text[at : at + 1]
            if c == ",":
                at = (LINES if kind == "[" else SPACE).match(text, at + 1).end()
                if kind == "{":
                    at = toml_assign(text, at)
                elif text[at : at + 1] == "]":
                    continue
                break
            if c != ("]" if kind == "[" else "}"):
                raise Reject("unbalanced_delimiter" if not c or c in "]}" else "grammar")
            stack.pop()
            at += 1
        else:
            return at


def toml_assign(text: str, at: int) -> int:
    m = TOML_KEY.match(text, at)
    if not m:
        raise Reject("premature_end" if at >= len(text) else "grammar")
    if text[m.end() : m.end() + 1] != "=":
        raise Reject("premature_end" if m.end() >= len(text.rstrip()) else "grammar")
    return m.end() + 1


def toml(text: str) -> None:
    """TOML 1.0; that keys and tables are defined once is no matter of grammar and not looked at."""
    if re.search(r"\r(?!\n)", text):
        raise Reject("invalid_token")
    at, n = 0, len(text)
    while at < n:
        at = SPACE.match(text, at).end()
        c = text[at : at + 1]
        if c == "[":
            double = text.startswith("[[", at)
            m = TOML_KEY.match(text, at + 1 + double)
            if not m:
                raise Reject("merge_conflict" if text.startswith("<<<<<<<", at) else "grammar")
            at = m.end()
            if not text.startswith("]]" if double else "]", at):
                raise Reject("unbalanced_delimiter")
            at += 1 + double
        elif c and c not in "#\r\n":
            if re.match(r"<{7}|={7}|>{7}|\|{7}", text[at : at + 7]):
                raise Reject("merge_conflict")
            at = toml_value(text, toml_assign(text, at))
        at = BLANK.match(text, at).end()
        if at < n:
            if text.startswith("\r\n", at):
                at += 2
            elif text[at] == "\n":
                at += 1
            else:
                raise Reject("grammar")


XML_NAME = r"[:A-Z_a-z\xc0-\xd6\xd8-\xf6\xf8-˿Ͱ-ͽͿ-῿‌‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff][-.:\w\xb7̀-ͯ‿⁀]*+"
XML_TAG = re.compile(rf"<({XML_NAME})((?:\s+{XML_NAME}\s*=\s*(?:\"[^<\"]*+\"|'[^<']*+'))*+)\s*+(/?)>")
XML_ATTR = re.compile(rf"\s+({XML_NAME})\s*=\s*(\"[^<\"]*+\"|'[^<']*+')")
XML_END = re.compile(rf"</({XML_NAME})\s*+>")
XML_MISC = re.compile(rf"<!--(?:(?!--)[\s\S])*+-->|<\?(?!xml[\s?])({XML_NAME})(?:\s(?:(?!\?>)[\s\S])*+)?\?>")
XML_DECL = re.compile(r"<\?xml\s+version\s*=\s*(?:\"1\.\d+\"|'1\.\d+')(?:\s+encoding\s*=\s*(?:\"[A-Za-z][\w.-]*\"|'[A-Za-z][\w.-]*'))?(?:\s+standalone\s*=\s*(?:\"(?:yes|no)\"|'(?:yes|no)'))?\s*\?>", re.A)
XML_DOCTYPE = re.compile(rf"<!DOCTYPE\s+{XML_NAME}(?:\s+(?:SYSTEM|PUBLIC\s+(?:\"[^\"]*\"|'[^']*'))\s+(?:\"[^\"]*\"|'[^']*'))?\s*(\[[^\]]*\]\s*)?>")
XML_REFERENCE = re.compile(r"&(?:#\d+;|#x[0-9a-fA-F]+;|(?:amp|lt|gt|quot|apos);)")
XML_BAD = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def xml_text(text: str, known: bool) -> None:
    for x, d in re.findall(r"&#(?:x([0-9a-fA-F]+)|(\d+));", text):
        if (c := int(x, 16) if x else int(d)) > 0x10FFFF or XML_BAD.match(chr(c)):
            raise Reject("invalid_token")
    rest = XML_REFERENCE.sub("", text) if not known else re.sub(rf"&(?:#\d+|#x[0-9a-fA-F]+|{XML_NAME});", "", text)
    if "&" in rest:
        raise Reject("invalid_token")


def xml(text: str) -> None:
    """Well-formed XML 1.0: one root, tags that nest, attributes quoted and given once, references that are known."""
    text = text.removeprefix("﻿")
    if XML_BAD.search(text):
        raise Reject("invalid_token")
    at, n, root, doctype, stack = 0, len(text), False, False, []
    if m := XML_DECL.match(text):
        at = m.end()
    while at < n:
        if text[at] != "<":
            end = text.find("<", at)
            end = n if end < 0 else end
            part = text[at:end]
            if stack:
                if "]]>" in part:
                    raise Reject("invalid_token")
                xml_text(part, doctype)
            elif part.strip(" \t\r\n"):
                raise Reject("grammar")
            at = end
        elif m := XML_TAG.match(text, at):
            if root and not stack:
                raise Reject("grammar")
            names = [a for a, _ in XML_ATTR.findall(m.group(2))]
            if len(names) != len(set(names)):
                raise Reject("grammar")
            xml_text(m.group(2), doctype)
            root = True
            if not m.group(3):
                stack.append(m.group(1))
            at = m.end()
        elif m := XML_END.match(text, at):
            if not stack or stack.pop() != m.group(1):
                raise Reject("unbalanced_delimiter")
            at = m.end()
        elif m := XML_MISC.match(text, at):
            if (m.group(1) or "").lower() == "xml":
                raise Reject("grammar")
            at = m.end()
        elif text.startswith("<![CDATA[", at) and stack:
            end = text.find("]]>", at)
            if end < 0:
                raise Reject("unterminated_literal")
            at = end + 3
        elif not root and not doctype and (m := XML_DOCTYPE.match(text, at)):
            doctype = True
            at = m.end()
        else:
            raise Reject("merge_conflict" if text.startswith("<<<<<<<", at) else "premature_end" if text.find(">", at) < 0 else "invalid_token")
    if stack or not root:
        raise Reject("premature_end")
