"""Lexer and pushdown parser for JavaScript as a classic script (no modules, no JSX).

The stack holds the open brackets, template literals and function bodies; what is due next decides whether a slash
begins a regular expression. Only the grammar counts: names declared twice and the like are not looked at.
"""

from __future__ import annotations

import re

from chunkloom.llm.pylex import Reject

SPACE = re.compile(r"(?:[ \t\v\f\xa0﻿  -   　]++|(\r\n|[\n\r  ])|//[^\n\r  ]*+|<!--[^\n\r]*+|/\*(?:[^*]++|\*(?!/))*+\*/)")
IDENT = r"(?:[$_\w]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})"
TOKEN = re.compile(
    rf"""
    (?P<number>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|0[0-7]+|(?:0|[1-9](?:_?\d)*)n|(?:(?:0\d*[89]\d*|0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)(?!{IDENT}))
  | (?P<name>\#?(?!\d){IDENT}(?:{IDENT}|[‌‍])*)
  | (?P<string>"(?:[^"\\\n\r]++|\\(?:\r\n|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|u\{{[0-9a-fA-F]+\}}|[^xu\r]|\r))*+"|'(?:[^'\\\n\r]++|\\(?:\r\n|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|u\{{[0-9a-fA-F]+\}}|[^xu\r]|\r))*+')
  | (?P<template>`)
  | (?P<op>\?\.(?!\d)|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{{}}()\[\];,<>+\-*/%&|^!~?:=.@])
    """,
    re.X,
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]++|\\[^\n\r]|\[(?:[^\]\\\n\r]++|\\[^\n\r])*+\])++/[\w$]*+")
#: Reserved words of scripts.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= ^= |= &&= ||= ??=".split())
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
MARKER = re.compile(r"^(?:<{7}(?: |$)|={7}$|>{7}(?: |$)|\|{7}(?: |$))", re.M)


class Script:
    """One parse. kind, text and newline (whether one came before) describe the token that is due."""

    def __init__(self, source: str):
        self.source, self.at = source.removeprefix("﻿"), 0
        if self.source.startswith("#!"):
            self.at = (self.source + "\n").index("\n")
        self.functions: list[str] = []
        self.loops = 0
        self.arrows: dict[int, tuple | None] = {}
        self.next()

    def next(self) -> None:
        s, at, newline = self.source, self.at, False
        while m := SPACE.match(s, at):
            newline = newline or m.group(1) is not None or m.group().startswith("/*") and bool(re.search(r"[\n\r  ]", m.group()))
            at = m.end()
        self.newline, self.start = newline, at
        if at >= len(s):
            self.kind, self.text, self.at = "end", "", at
            return
        m = TOKEN.match(s, at)
        if not m:
            raise Reject("unterminated_literal" if s[at] in "\"'" or s.startswith("/*", at) else "invalid_token")
        self.kind, self.text, self.at = m.lastgroup, m.group(), m.end()

    def fail(self) -> Reject:
        if self.kind == "end":
            return Reject("premature_end")
        return Reject("unbalanced_delimiter" if self.text in (")", "]", "}") else "grammar")

    def take(self, text: str) -> None:
        if self.text != text or self.kind not in ("op", "name"):
            raise self.fail()
        self.next()

    def have(self, text: str) -> bool:
        if self.text == text and self.kind in ("op", "name"):
            self.next()
            return True
        return False

    def at_op(self, text: str) -> bool:
        return self.text == text and self.kind == "op"

    def semicolon(self) -> None:
        if self.at_op(";"):
            self.next()
        elif not (self.newline or self.kind == "end" or self.at_op("}")):
            raise self.fail()

    def identifier(self) -> None:
        if self.kind != "name" or self.text in RESERVED or self.text[0] == "#" or self.text == "yield" and self.inside("*") or self.text == "await" and self.inside("a"):
            raise self.fail()
        self.next()

    def inside(self, mark: str) -> bool:
        return bool(self.functions) and mark in self.functions[-1]

    def peek(self) -> tuple[str, str, bool]:
        kept = self.at, self.kind, self.text, self.newline, self.start
        try:
            self.next()
            return self.kind, self.text, self.newline
        except Reject:
            return "bad", "", False
        finally:
            self.at, self.kind, self.text, self.newline, self.start = kept

    # statements

    def script(self) -> None:
        while self.kind != "end":
            self.statement(True)

    def block(self) -> None:
        self.take("{")
        while not self.at_op("}"):
            if self.kind == "end":
                raise Reject("unbalanced_delimiter")
            self.statement(True)
        self.next()

    def condition(self) -> None:
        self.take("(")
        self.expression()
        self.take(")")

    def body(self) -> None:
        self.loops += 1
        self.statement(False)
        self.loops -= 1

    def statement(self, declarations: bool) -> None:
        kind, text = self.kind, self.text
        if kind == "op" and text == "{":
            self.block()
        elif kind == "op" and text == ";":
            self.next()
        elif kind != "name":
            self.expression()
            self.semicolon()
        elif text in ("var", "const") or text == "let" and self.let():
            if text != "var" and not declarations:
                raise self.fail()
            self.next()
            self.declarators(True, text == "const")
            self.semicolon()
        elif text == "function" or text == "async" and self.peek()[1] == "function" and not self.peek()[2]:
            self.function(True)
        elif text == "class":
            if not declarations:
                raise self.fail()
            self.klass(True)
        elif text == "if":
            self.next()
            self.condition()
            self.statement(False)
            if self.have("else"):
                self.statement(False)
        elif text == "for":
            self.loop()
        elif text == "while":
            self.next()
            self.condition()
            self.body()
        elif text == "do":
            self.next()
            self.body()
            self.take("while")
            self.condition()
            self.have(";")
        elif text in ("break", "continue"):
            self.next()
            if self.kind == "name" and not self.newline and self.text not in RESERVED:
                self.next()
            self.semicolon()
        elif text == "return":
            if not self.functions:
                raise Reject("grammar")
            self.next()
            if not (self.newline or self.kind == "end" or self.at_op(";") or self.at_op("}")):
                self.expression()
            self.semicolon()
        elif text == "throw":
            self.next()
            if self.newline:
                raise Reject("grammar")
            self.expression()
            self.semicolon()
        elif text == "try":
            self.next()
            self.block()
            caught = self.have("catch")
            if caught:
                if self.have("("):
                    self.binding()
                    self.take(")")
                self.block()
            if self.have("finally"):
                self.block()
            elif not caught:
                raise self.fail()
        elif text == "switch":
            self.next()
            self.condition()
            self.take("{")
            while not self.have("}"):
                if self.have("case"):
                    self.expression()
                else:
                    self.take("default")
                self.take(":")
                while not (self.at_op("}") or self.kind == "name" and self.text in ("case", "default")):
                    if self.kind == "end":
                        raise Reject("unbalanced_delimiter")
                    self.statement(True)
        elif text == "with":
            self.next()
            self.condition()
            self.statement(False)
        elif text == "debugger":
            self.next()
            self.semicolon()
        elif text == "import" and self.peek()[1] != "(":
            raise Reject("grammar")
        elif text not in RESERVED and self.peek()[:2] == ("op", ":"):
            self.identifier()
            self.next()
            self.statement(declarations)
        else:
            self.expression()
            self.semicolon()

    def let(self) -> bool:
        kind, text, _ = self.peek()
        return kind == "name" and text not in ("in", "instanceof", "of") and text not in RESERVED or kind == "op" and text in ("[", "{")

    def declarators(self, ins: bool, const: bool, head: bool = False) -> None:
        while True:
            pattern = self.at_op("[") or self.at_op("{")
            self.binding()
            if self.have("="):
                self.assignment(ins)
            elif head and (self.text == "of" or self.text == "in"):
                return
            elif pattern or const:
                raise self.fail()
            if not self.have(","):
                return

    def loop(self) -> None:
        self.next()
        if self.text == "await" and self.inside("a"):
            self.next()
        self.take("(")
        if self.at_op(";"):
            pass
        elif self.kind == "name" and (self.text in ("var", "const") or self.text == "let" and self.let()):
            const = self.text == "const"
            self.next()
            self.declarators(False, const, True)
        else:
            target = self.expression(False)
            if self.kind == "name" and self.text in ("of", "in") and not target:
                raise self.fail()
        if self.kind == "name" and self.text in ("of", "in"):
            of = self.text == "of"
            self.next()
            self.assignment() if of else self.expression()
        else:
            self.take(";")
            if not self.at_op(";"):
                self.expression()
            self.take(";")
            if not self.at_op(")"):
                self.expression()
        self.take(")")
        self.body()

    def binding(self) -> None:
        if self.have("["):
            while not self.have("]"):
                if self.have(","):
                    continue
                rest = self.have("...")
                self.element(rest)
                if not self.at_op("]"):
                    if rest:
                        raise self.fail()
                    self.take(",")
        elif self.have("{"):
            while not self.have("}"):
                if self.have("..."):
                    self.identifier()
                    if not self.at_op("}"):
                        raise self.fail()
                    continue
                plain = self.kind == "name" and self.text not in RESERVED
                self.key()
                if self.have(":"):
                    self.element(False)
                elif not plain:
                    raise self.fail()
                elif self.have("="):
                    self.assignment()
                if not self.at_op("}"):
                    self.take(",")
        else:
            self.identifier()

    def element(self, rest: bool) -> None:
        self.binding()
        if not rest and self.have("="):
            self.assignment()

    def key(self) -> None:
        if self.have("["):
            self.assignment()
            self.take("]")
        elif self.kind in ("name", "string", "number"):
            self.next()
        else:
            raise self.fail()

    def function(self, named: bool) -> None:
        marks = "f"
        if self.text == "async":
            marks += "a"
            self.next()
        self.take("function")
        if self.have("*"):
            marks += "*"
        if named or not self.at_op("("):
            self.identifier()
        self.rest_of_function(marks)

    def rest_of_function(self, marks: str) -> None:
        self.functions.append(marks)
        self.take("(")
        while not self.have(")"):
            rest = self.have("...")
            self.element(rest)
            if not self.at_op(")"):
                if rest:
                    raise self.fail()
                self.take(",")
        self.block()
        self.functions.pop()

    def klass(self, named: bool) -> None:
        self.next()
        if named or self.kind == "name" and self.text not in RESERVED:
            self.identifier()
        if self.have("extends"):
            self.unary(True)
        self.take("{")
        while not self.have("}"):
            if self.have(";"):
                continue
            if self.text == "static" and self.kind == "name" and not (self.peek()[1] in ("(", "=", ";", "}")):
                self.next()
                if self.at_op("{"):
                    self.functions.append("f")
                    self.block()
                    self.functions.pop()
                    continue
            if not self.method():
                self.key()
                if self.at_op("("):
                    self.rest_of_function("f")
                else:
                    if self.have("="):
                        self.functions.append("f")
                        self.assignment()
                        self.functions.pop()
                    self.semicolon()

    def method(self) -> bool:
        """Take a method with async, *, get or set before its name; False where there is none of these."""
        marks = "f"
        if self.kind == "name" and self.text in ("get", "set", "async") and self.peek()[1] not in ("(", "=", ";", "}", ",", ":") and not (self.text == "async" and self.peek()[2]):
            marks += "a" if self.text == "async" else ""
            self.next()
            if self.at_op("*") and "a" not in marks:
                raise self.fail()
        elif not self.at_op("*"):
            return False
        if self.have("*"):
            marks += "*"
        self.key()
        self.rest_of_function(marks)
        return True

    # expressions: each returns whether what it took may be assigned to

    def expression(self, ins: bool = True) -> bool:
        target = self.assignment(ins)
        while self.have(","):
            self.assignment(ins)
            target = False
        return target

    def arrow(self) -> bool:
        """Whether the bracket that is due encloses the parameters of an arrow function; looked at once for each bracket.

        Where it does, what follows the parameters is remembered, so that they are not read again.
        """
        kept = self.at, self.kind, self.text, self.newline, self.start
        if kept[4] in self.arrows:
            return self.arrows[kept[4]] is not None
        open_functions = len(self.functions)
        after = None
        try:
            self.next()
            while not self.have(")"):
                rest = self.have("...")
                self.element(rest)
                if not self.at_op(")"):
                    self.take(",")
            if self.at_op("=>") and not self.newline:
                after = self.at, self.kind, self.text, self.newline, self.start
        except Reject:
            del self.functions[open_functions:]
        finally:
            self.at, self.kind, self.text, self.newline, self.start = kept
        self.arrows[self.start] = after
        return after is not None

    def arrow_body(self, marks: str, ins: bool) -> None:
        self.take("=>")
        self.functions.append(marks)
        if self.at_op("{"):
            self.block()
        else:
            self.assignment(ins)
        self.functions.pop()

    def assignment(self, ins: bool = True) -> bool:
        if self.kind == "name":
            if self.text == "async":
                kind, text, newline = self.peek()
                if not newline and (kind == "name" and text not in RESERVED and text != "of" or text == "("):
                    kept = self.at, self.kind, self.text, self.newline, self.start
                    self.next()
                    if self.at_op("(") and self.arrow():
                        self.parameters_of_arrow()
                        self.arrow_body("a", ins)
                        return False
                    if self.kind == "name" and self.peek()[1] == "=>":
                        self.next()
                        self.arrow_body("a", ins)
                        return False
                    self.at, self.kind, self.text, self.newline, self.start = kept
            elif self.text == "yield" and self.inside("*"):
                self.next()
                if not self.newline and self.have("*"):
                    self.assignment(ins)
                elif not self.newline and not (self.kind == "op" and self.text in (")", "]", "}", ",", ";", ":") or self.kind == "end" or self.text in ("in", "of")):
                    self.assignment(ins)
                return False
            if self.text not in RESERVED and self.peek()[:2] == ("op", "=>"):
                self.identifier()
                if self.newline:
                    raise self.fail()
                self.arrow_body("f", ins)
                return False
        elif self.at_op("(") and self.arrow():
            self.parameters_of_arrow()
            self.arrow_body("f", ins)
            return False
        pattern = self.at_op("[") or self.at_op("{")
        loose = len(self.loose) if pattern else 0
        target = self.conditional(ins)
        if self.kind == "op" and self.text in ASSIGN:
            if not target and not (pattern and self.text == "="):
                raise self.fail()
            if pattern and self.text == "=":
                del self.loose[loose:]
            self.next()
            self.assignment(ins)
            return False
        if self.loose and loose == 0 and not self.depth and not (self.kind == "name" and self.text in ("of", "in")):
            raise Reject("grammar")
        return target or pattern

    #: Shorthand defaults such as {a = 1}, right only where a pattern turns out to be one; depth counts open literals.
    loose: list[int] = []
    depth = 0

    def parameters_of_arrow(self) -> None:
        self.at, self.kind, self.text, self.newline, self.start = self.arrows[self.start]

    def conditional(self, ins: bool) -> bool:
        target = self.binary(0, ins)
        if self.at_op("?"):
            self.next()
            self.assignment()
            self.take(":")
            self.assignment(ins)
            return False
        return target

    def binary(self, least: int, ins: bool) -> bool:
        unary_before = self.kind == "op" and self.text in ("-", "+", "!", "~") or self.kind == "name" and self.text in ("typeof", "void", "delete")
        target = self.unary()
        while True:
            text = self.text
            level = BINARY.get(text) if self.kind == "op" or self.kind == "name" and text in ("in", "instanceof") else None
            if level is None or level < least or text == "in" and not ins:
                return target
            if text == "**" and unary_before:
                raise self.fail()
            self.next()
            self.binary(level if text == "**" else level + 1, ins)
            target = unary_before = False

    def unary(self, postfix_only: bool = False) -> bool:
        if not postfix_only:
            if self.kind == "op" and self.text in ("++", "--"):
                self.next()
                if not self.unary():
                    raise self.fail()
                return False
            if self.kind == "op" and self.text in ("-", "+", "!", "~") or self.kind == "name" and (self.text in ("typeof", "void", "delete") or self.text == "await" and self.inside("a")):
                self.next()
                self.unary()
                return False
        target = self.postfix(self.primary())
        if not postfix_only and self.kind == "op" and self.text in ("++", "--") and not self.newline:
            if not target:
                raise self.fail()
            self.next()
            return False
        return target

    def arguments(self) -> None:
        self.take("(")
        while not self.have(")"):
            self.have("...")
            self.assignment()
            if not self.at_op(")"):
                if self.kind == "end":
                    raise Reject("unbalanced_delimiter")
                self.take(",")

    def postfix(self, target: bool, calls: bool = True) -> bool:
        chain = False
        while True:
            if self.at_op("."):
                self.next()
                if self.kind != "name":
                    raise self.fail()
                self.next()
                target = True
            elif self.at_op("?.") and calls:
                self.next()
                chain = True
                if self.at_op("("):
                    self.arguments()
                elif self.have("["):
                    self.expression()
                    self.take("]")
                elif self.kind == "name":
                    self.next()
                else:
                    raise self.fail()
            elif self.at_op("["):
                self.next()
                self.expression()
                self.take("]")
                target = True
            elif self.at_op("(") and calls:
                self.arguments()
                target = False
            elif self.kind == "template":
                if chain:
                    raise self.fail()
                self.template()
                target = False
            else:
                return target and not chain

    def template(self) -> None:
        s, at = self.source, self.at
        while True:
            if at >= len(s):
                raise Reject("unterminated_literal")
            c = s[at]
            if c == "\\":
                at += 2
            elif c == "`":
                self.at = at + 1
                self.next()
                return
            elif c == "$" and s.startswith("${", at):
                self.at = at + 2
                self.next()
                self.expression()
                if not self.at_op("}"):
                    raise self.fail()
                at = self.start + 1
            else:
                at += 1

    def primary(self) -> bool:
        kind, text = self.kind, self.text
        if kind == "number" or kind == "string":
            self.next()
            return False
        if kind == "template":
            self.template()
            return False
        if kind == "name":
            if text == "function" or text == "async" and self.peek()[1] == "function" and not self.peek()[2]:
                self.function(False)
                return False
            if text == "class":
                self.klass(False)
                return False
            if text == "new":
                self.next()
                if self.have("."):
                    if not (self.text == "target" and self.functions):
                        raise self.fail()
                    self.next()
                    return False
                if self.kind == "name" and self.text == "import":
                    raise self.fail()
                self.postfix(self.primary(), False)
                if self.at_op("("):
                    self.arguments()
                return False
            if text in ("this", "null", "true", "false"):
                self.next()
                return False
            if text == "super":
                self.next()
                if not (self.functions and (self.at_op(".") or self.at_op("[") or self.at_op("("))):
                    raise self.fail()
                return False
            if text == "import":
                self.next()
                if not self.at_op("("):
                    raise self.fail()
                return False
            if text[0] == "#":
                self.next()
                if not (self.kind == "name" and self.text == "in"):
                    raise self.fail()
                return False
            self.identifier()
            return True
        if text == "(":
            self.next()
            depth, self.depth = self.depth, 0
            target = self.expression()
            self.depth = depth
            self.take(")")
            return target
        if text == "[":
            self.next()
            self.depth += 1
            while not self.have("]"):
                if self.have(","):
                    continue
                self.have("...")
                self.assignment()
                if not self.at_op("]"):
                    if self.kind == "end":
                        raise Reject("unbalanced_delimiter")
                    self.take(",")
            self.depth -= 1
            return False
        if text == "{":
            self.next()
            self.depth += 1
            while not self.have("}"):
                if self.kind == "end":
                    raise Reject("unbalanced_delimiter")
                if self.have("..."):
                    self.assignment()
                elif not self.method():
                    plain = self.kind == "name" and self.text not in RESERVED and self.text[0] != "#"
                    if self.kind == "name" and self.text[0] == "#":
                        raise self.fail()
                    self.key()
                    if self.at_op("("):
                        self.rest_of_function("f")
                    elif self.have(":"):
                        self.assignment()
                    elif not plain:
                        raise self.fail()
                    elif self.at_op("="):
                        self.loose = [*self.loose, self.start]
                        self.next()
                        self.assignment()
                if not self.at_op("}"):
                    if self.kind == "end":
                        raise Reject("unbalanced_delimiter")
                    self.take(",")
            self.depth -= 1
            return False
        if text in ("/", "/="):
            m = REGEX.match(self.source, self.start)
            if not m:
                raise Reject("unterminated_literal")
            self.at = m.end()
            self.next()
            return False
        raise self.fail()


def javascript(source: str) -> None:
    """Accept a classic script or raise Reject with the defect."""
    Script(source).script()
