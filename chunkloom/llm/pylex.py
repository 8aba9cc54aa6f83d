"""Lexer and pushdown acceptor for Python.

The acceptor takes the files it can prove to be well formed: tokens go through a machine of two states (an operand
is due, an operand has ended) with one stack of open brackets, ternaries and comprehensions and one of open
blocks. Whatever it does not take comes out with the reason, for the exact check that follows. It must never take a
file that does not parse; that it leaves some well-formed ones to the exact check only costs time.
"""

from __future__ import annotations

import re

NAME, NUMBER, STRING, BYTES, OP, NEWLINE = "name", "number", "string", "bytes", "op", "newline"

#: Reserved words of the language.
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
ATOMS = frozenset(["None", "True", "False"])

LEX = re.compile(
    r"""
    (?P<space>[ ]+|\\\n)
  | (?P<comment>\#[^\n]*)
  | (?P<newline>\n)
  | (?P<string>[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^"\\]++|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]++|\\.|'(?!''))*+'''|"(?!"")(?:[^"\\\n]++|\\.)*+"|'(?!'')(?:[^'\\\n]++|\\.)*+'|""(?!")|''(?!')))
  | (?P<number>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:0(?:_?0)*|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![\w.]))
  | (?P<name>[^\W\d]\w*)
  | (?P<op>\*\*=?|//=?|>>=?|<<=?|->|\.\.\.|:=|[-+*/%@&|^=!<>]=|[-+*/%@&|^~<>=()\[\]{},:;.])
    """,
    re.X | re.S,
)
ESCAPE = re.compile(r"\\[xuUN]")
FIELD = re.compile(r"\{\{|\}\}|\{[^\W\d]\w*(?:\.[^\W\d]\w*)*(?:![rsa])?(?::[^{}'\"\\]*)?\}")
BINARY = frozenset(["+", "-", "*", "/", "//", "%", "@", "&", "|", "^", "<<", ">>", "**", "<", ">", "<=", ">=", "==", "!=", "and", "or", "in", "is"])
AUGMENTED = frozenset(["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", "<<=", ">>=", "**="])
PAIR = {")": "(", "]": "[", "}": "{"}
#: Tokens after which a whole expression starts, so that `not` and `lambda` may follow.
FRESH = frozenset(["", "(", "[", "{", ",", "=", ":", "else", "return", "if", "elif", "while", "assert"])


class Reject(Exception):
    """Not accepted; the message names the defect suspected."""


def lex(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, column, line) of every token; columns only matter for the first token of a line."""
    out, at, line, start, n = [], 0, 1, 0, len(source)
    while at < n:
        m = LEX.match(source, at)
        if not m:
            c = source[at]
            if source.startswith(('"""', "'''"), at) or c in "\"'":
                raise Reject("unterminated_literal")
            raise Reject("invalid_token")
        kind, text = m.lastgroup, m.group()
        if kind == "string":
            prefix = text[: min(text.find('"') % len(text), text.find("'") % len(text))].lower()
            if prefix not in ("", "r", "b", "u", "f", "rb", "br", "fr", "rf"):
                raise Reject("invalid_token")
            if "r" not in prefix and ESCAPE.search(text):
                raise Reject("grammar")
            if "f" in prefix:
                if "\\" in text or re.search(r"[{}]", FIELD.sub("", text)):
                    raise Reject("grammar")
            if "b" in prefix and not text.isascii():
                raise Reject("invalid_token")
            out.append((BYTES if "b" in prefix else STRING, text, at - start, line))
        elif kind in (NAME, NUMBER, OP):
            if kind == NAME and not text.isascii() and not text.isidentifier():
                raise Reject("invalid_token")
            out.append((kind, text, at - start, line))
        elif kind == NEWLINE:
            out.append((NEWLINE, text, at - start, line))
        if "\n" in text:
            line += text.count("\n")
            start = at + text.rfind("\n") + 1
        at = m.end()
    return out


class Frame:
    """An open bracket. kind: ( grouping or tuple, C call, D parameters, [ list, S subscript, { dict or set."""

    __slots__ = ("commas", "comp", "dict_", "keyword", "kind", "start", "tern")

    def __init__(self, kind: str, start: int):
        self.kind, self.start, self.commas, self.comp, self.dict_, self.keyword, self.tern = kind, start, 0, 0, None, False, 0


def expression(t: list[tuple[str, str, int, int]], i: int, n: int, stops: frozenset, tuple_ok: bool = True) -> int:
    """Accept one expression from token i; the index of the token after it, one of stops at depth 0 or n."""
    stack: list[Frame] = []
    top = Frame("", i)
    operand, last, before = True, "", ""
    tern = 0
    lambdas = 0
    begin = i
    while i < n:
        kind, text = t[i][0], t[i][1]
        if kind == NEWLINE:
            i += 1
            continue
        f = stack[-1] if stack else top
        if not stack and not operand and f.tern == 0 and lambdas == 0 and text in stops and kind in (OP, NAME):
            return i
        if operand:
            if kind == NUMBER or kind == STRING or kind == BYTES or (kind == NAME and (text not in KEYWORDS or text in ATOMS)) or text == "...":
                operand = False
            elif kind == OP and text in "([{":
                stack.append(Frame(text, i + 1))
                before, last = last, text
                i += 1
                continue
            elif text in ("-", "+", "~"):
                pass
            elif text == "not" and (last in FRESH or last in ("and", "or", "not")):
                pass
            elif text == "lambda" and last in FRESH and not f.comp:
                i += 1
                while i < n and t[i][1] != ":":
                    if not (t[i][0] == NAME and t[i][1] not in KEYWORDS):
                        raise Reject("grammar")
                    i += 1
                    if i < n and t[i][1] == ",":
                        i += 1
                    elif i >= n or t[i][1] != ":":
                        raise Reject("grammar")
                if i >= n:
                    raise Reject("premature_end")
                last = ":"
                i += 1
                continue
            elif text == "*" and f.kind in ("C", "[") and (i == f.start or last == ",") and not f.keyword and not f.comp:
                pass
            elif text == "**" and f.kind == "C" and (i == f.start or last == ","):
                f.keyword = True
            elif kind == OP and text in ")]}":
                if not stack or PAIR[text] != {"C": "(", "S": "["}.get(f.kind, f.kind):
                    raise Reject("unbalanced_delimiter")
                empty, comma = i == f.start, last == ","
                if not (empty and f.kind != "S" or comma and not empty and f.commas and not f.comp or f.kind == "S" and last == ":"):
                    raise Reject("grammar")
                stack.pop()
                operand = False
            elif text == ":" and f.kind == "S" and (i == f.start or last in (":", ",")) and f.tern == 0:
                pass
            else:
                raise Reject("grammar")
        elif kind == STRING and last == STRING or kind == BYTES and last == BYTES:
            pass
        elif kind == NAME:
            if text == "if":
                if f.comp:
                    pass
                else:
                    f.tern += 1
                operand = True
            elif text == "else":
                if f.tern <= 0:
                    raise Reject("grammar")
                f.tern -= 1
                operand = True
            elif text == "not":
                if not (i + 1 < n and t[i + 1][1] == "in"):
                    raise Reject("grammar")
                i += 1
                operand, text = True, "in"
            elif text == "is":
                if i + 1 < n and t[i + 1][1] == "not":
                    i += 1
                operand, text = True, "is"
            elif text in BINARY:
                operand = True
            elif text == "for":
                if f.kind not in ("(", "[", "{", "C") or f.commas or f.keyword or f.tern:
                    raise Reject("grammar")
                if t[f.start][1] in ("*", "**"):
                    raise Reject("grammar")
                f.comp += 1
                j, depth = i + 1, 0
                if j < n and t[j][1] == "(":
                    depth, j = 1, j + 1
                while True:
                    if not (j < n and t[j][0] == NAME and t[j][1] not in KEYWORDS):
                        raise Reject("grammar")
                    j += 1
                    if j < n and t[j][1] == ",":
                        j += 1
                        continue
                    break
                if depth:
                    if not (j < n and t[j][1] == ")"):
                        raise Reject("grammar")
                    j += 1
                if not (j < n and t[j][1] == "in"):
                    raise Reject("grammar")
                i, text, operand = j, "in", True
            else:
                raise Reject("grammar")
        elif kind == OP:
            if text in BINARY:
                operand = True
            elif text == ".":
                i += 1
                if last == NUMBER or not (i < n and t[i][0] == NAME and t[i][1] not in KEYWORDS):
                    raise Reject("premature_end" if i >= n else "grammar")
                text = t[i][1]
            elif text == "(" or text == "[":
                stack.append(Frame("C" if text == "(" else "S", i + 1))
                operand = True
            elif text in ")]}":
                if not stack or PAIR[text] != {"C": "(", "S": "["}.get(f.kind, f.kind):
                    raise Reject("unbalanced_delimiter")
                if f.tern or f.kind == "{" and f.dict_ == "key":
                    raise Reject("grammar")
                if f.kind == "(" and t[f.start][1] == "*" and not f.commas:
                    raise Reject("grammar")
                stack.pop()
            elif text == ",":
                if f.tern or f.comp or not stack and not tuple_ok:
                    raise Reject("grammar")
                if f.kind == "{":
                    if f.dict_ == "key":
                        raise Reject("grammar")
                    f.dict_ = {None: "set", "value": "key", "set": "set"}[f.dict_]
                f.commas += 1
                operand = True
            elif text == ":":
                if f.tern:
                    raise Reject("grammar")
                if f.kind == "{" and f.dict_ in (None, "key") and not f.comp:
                    f.dict_ = "value"
                elif f.kind == "S":
                    pass
                else:
                    raise Reject("grammar")
                operand = True
            elif text == "=":
                if not (f.kind == "C" and last == NAME and before in ("(", ",") and not f.comp):
                    raise Reject("grammar")
                f.keyword = True
                operand = True
            else:
                raise Reject("grammar")
        else:
            raise Reject("grammar")
        # a positional argument must not follow a keyword argument
        if f.kind == "C" and f.keyword and text == "," and kind == OP:
            j = i + 1
            while j < n and t[j][0] == NEWLINE:
                j += 1
            if j < n and t[j][1] not in (")", "**"):
                k = j + 1
                while k < n and t[k][0] == NEWLINE:
                    k += 1
                if not (t[j][0] == NAME and k < n and t[k][1] == "="):
                    raise Reject("grammar")
        before, last = last, (kind if kind in (STRING, BYTES, NUMBER) else NAME if kind == NAME and not operand else text)
        i += 1
    if stack:
        raise Reject("unbalanced_delimiter")
    if operand and not (last == "," and tuple_ok and i > begin) or top.tern:
        raise Reject("premature_end")
    return i


def targets(t: list[tuple[str, str, int, int]], i: int, j: int) -> None:
    """Accept tokens i to j as a target: names, attributes and subscripts, alone or with commas between."""
    depth, fresh = 0, True
    while i < j:
        kind, text = t[i][0], t[i][1]
        if kind == NEWLINE:
            pass
        elif fresh:
            if kind != NAME or text in KEYWORDS:
                raise Reject("grammar")
            fresh = False
        elif text == ".":
            i += 1
            if i >= j or t[i][0] != NAME or t[i][1] in KEYWORDS:
                raise Reject("grammar")
        elif text == "[":
            depth, k = 1, i + 1
            while k < j and depth:
                depth += (t[k][1] in ("[", "(", "{") and t[k][0] == OP) - (t[k][1] in ("]", ")", "}") and t[k][0] == OP)
                k += 1
            i = k - 1
        elif text == ",":
            fresh = True
        else:
            raise Reject("grammar")
        i += 1


def parameters(t: list[tuple[str, str, int, int]], i: int, n: int) -> int:
    """Accept parameters from after the bracket; the index after the closing one."""
    star = default = double = False
    while True:
        while i < n and t[i][0] == NEWLINE:
            i += 1
        if i >= n:
            raise Reject("unbalanced_delimiter")
        text = t[i][1]
        if text == ")":
            return i + 1
        if double:
            raise Reject("grammar")
        if text in ("*", "**"):
            if text == "*" and star:
                raise Reject("grammar")
            star, double = True, text == "**"
            i += 1
            if i < n and t[i][1] in (",", ")"):
                raise Reject("grammar")
        if not (i < n and t[i][0] == NAME and t[i][1] not in KEYWORDS):
            raise Reject("grammar")
        plain = t[i - 1][1] not in ("*", "**")
        i += 1
        while i < n and t[i][0] == NEWLINE:
            i += 1
        if i < n and t[i][1] == ":":
            i = expression(t, i + 1, n, frozenset([",", ")", "="]), False)
        if i < n and t[i][1] == "=":
            if not plain:
                raise Reject("grammar")
            default = True
            i = expression(t, i + 1, n, frozenset([",", ")"]), False)
        elif plain and default and not star:
            raise Reject("grammar")
        if i < n and t[i][1] == ",":
            i += 1
        elif not (i < n and t[i][1] == ")"):
            raise Reject("unbalanced_delimiter" if i >= n else "grammar")


def dotted(t: list[tuple[str, str, int, int]], i: int, n: int) -> int:
    while True:
        if not (i < n and t[i][0] == NAME and t[i][1] not in KEYWORDS):
            raise Reject("premature_end" if i >= n else "grammar")
        i += 1
        if i < n and t[i][1] == ".":
            i += 1
            continue
        return i


def aliases(t: list[tuple[str, str, int, int]], i: int, n: int, whole: bool) -> int:
    while True:
        if whole:
            i = dotted(t, i, n)
        else:
            if not (i < n and t[i][0] == NAME and t[i][1] not in KEYWORDS):
                raise Reject("premature_end" if i >= n else "grammar")
            i += 1
        if i < n and t[i][1] == "as":
            if not (i + 1 < n and t[i + 1][0] == NAME and t[i + 1][1] not in KEYWORDS):
                raise Reject("grammar")
            i += 2
        if i < n and t[i][1] == ",":
            i += 1
            continue
        return i


END: frozenset = frozenset()
COLON = frozenset([":"])


def simple(t: list[tuple[str, str, int, int]], i: int, n: int) -> None:
    """Accept the simple statement t[i:n]."""
    word = t[i][1] if t[i][0] == NAME else ""
    if word in ("pass", "break", "continue"):
        i += 1
    elif word == "return":
        i += 1
        if i < n:
            i = expression(t, i, n, END)
    elif word == "raise":
        i += 1
        if i < n:
            i = expression(t, i, n, frozenset(["from"]), False)
            if i < n:
                i = expression(t, i + 1, n, END, False)
    elif word == "assert":
        i = expression(t, i + 1, n, frozenset([","]), False)
        if i < n:
            i = expression(t, i + 1, n, END, False)
    elif word == "import":
        i = aliases(t, i + 1, n, True)
    elif word == "from":
        i += 1
        dots = i
        while i < n and t[i][1] in (".", "..."):
            i += 1
        if i == dots or i < n and t[i][1] != "import":
            i = dotted(t, i, n)
        if not (i + 1 < n and t[i][1] == "import"):
            raise Reject("premature_end" if i >= n - 1 else "grammar")
        i += 1
        if t[i][1] == "*":
            i += 1
        elif t[i][1] == "(":
            raise Reject("grammar")
        else:
            i = aliases(t, i, n, False)
            if t[n - 1][1] == ",":
                raise Reject("grammar")
    elif word == "del":
        targets(t, i + 1, n)
        if t[n - 1][1] in ("del", ","):
            raise Reject("grammar")
        i = n
    elif word in ("global", "nonlocal"):
        i += 1
        while i < n:
            if t[i][0] != NAME or t[i][1] in KEYWORDS or i + 1 < n and (t[i + 1][1] != "," or i + 2 >= n):
                raise Reject("grammar")
            i += 2
        if t[n - 1][1] == word:
            raise Reject("premature_end")
        i = n
    else:
        stop = frozenset(["=", ":"]) | AUGMENTED
        j = expression(t, i, n, stop)
        if j < n and t[j][1] == ":":
            targets(t, i, j)
            if any(x[1] == "," for x in t[i:j]):
                raise Reject("grammar")
            j = expression(t, j + 1, n, frozenset(["="]), False)
            if j < n:
                j = expression(t, j + 1, n, END)
        elif j < n and t[j][1] in AUGMENTED:
            targets(t, i, j)
            if any(x[1] == "," for x in t[i:j]):
                raise Reject("grammar")
            j = expression(t, j + 1, n, END)
        else:
            while j < n and t[j][1] == "=":
                targets(t, i, j)
                i = j + 1
                j = expression(t, i, n, frozenset(["="]))
        i = j
    if i != n:
        raise Reject("grammar")


def header(t: list[tuple[str, str, int, int]], i: int, n: int) -> tuple[str, int]:
    """Accept the header of a compound statement; its kind and the index after the colon."""
    word = t[i][1]
    start = i
    if word == "async":
        i += 1
        if i >= n or t[i][1] not in ("def", "for", "with"):
            raise Reject("grammar")
        word = t[i][1]
    if word in ("if", "elif", "while"):
        i = expression(t, i + 1, n, COLON, False)
    elif word == "for":
        j = i + 1
        depth = 0
        while j < n and not (t[j][1] == "in" and depth == 0):
            depth += (t[j][1] in ("[", "(", "{") and t[j][0] == OP) - (t[j][1] in ("]", ")", "}") and t[j][0] == OP)
            j += 1
        if j == i + 1 or j >= n:
            raise Reject("grammar")
        targets(t, i + 1, j)
        i = expression(t, j + 1, n, COLON)
    elif word in ("else", "finally", "try"):
        i += 1
    elif word == "except":
        i += 1
        if i < n and t[i][1] != ":":
            i = expression(t, i, n, frozenset([":", "as"]), False)
            if i < n and t[i][1] == "as":
                if not (i + 1 < n and t[i + 1][0] == NAME and t[i + 1][1] not in KEYWORDS):
                    raise Reject("grammar")
                i += 2
    elif word == "with":
        if i + 1 < n and t[i + 1][1] == "(":
            raise Reject("grammar")
        while True:
            i = expression(t, i + 1, n, frozenset([":", "as", ","]), False)
            if i < n and t[i][1] == "as":
                if not (i + 1 < n and t[i + 1][0] == NAME and t[i + 1][1] not in KEYWORDS):
                    raise Reject("grammar")
                i += 2
            if i < n and t[i][1] == ",":
                continue
            break
    elif word == "def":
        if not (i + 2 < n and t[i + 1][0] == NAME and t[i + 1][1] not in KEYWORDS and t[i + 2][1] == "("):
            raise Reject("premature_end" if i + 2 >= n else "grammar")
        i = parameters(t, i + 3, n)
        if i < n and t[i][1] == "->":
            i = expression(t, i + 1, n, COLON, False)
    else:  # class
        if not (i + 1 < n and t[i + 1][0] == NAME and t[i + 1][1] not in KEYWORDS):
            raise Reject("premature_end" if i + 1 >= n else "grammar")
        i += 2
        if i < n and t[i][1] == "(":
            i = expression(t, i - 1, n, COLON, False)
    if not (i < n and t[i][1] == ":" and t[i][0] == OP):
        raise Reject("premature_end" if i >= n else "grammar")
    return ("def" if word == "def" else "async" if t[start][1] == "async" else word), i + 1


COMPOUND = frozenset("if elif else while for try except finally with def class async".split())
MARKER = re.compile(r"^(?:<{7}(?: |$)|={7}$|>{7}(?: |$)|\|{7}(?: |$))", re.M)


def statements(source: str) -> None:
    """Accept a module or raise Reject."""
    if "\t" in source or "\r" in source or "\f" in source or "\0" in source or "\ufeff" in source:
        raise Reject("indentation" if "\t" in source else "invalid_token")
    t = lex(source)
    if t and t[-1][0] != NEWLINE:
        t.append((NEWLINE, "\n", 0, t[-1][3]))
    n = len(t)
    indents, i, opened = [0], 0, False
    #: What the last finished statement on each level was, for else, except and finally.
    before: list[str] = [""]
    while i < n:
        if t[i][0] == NEWLINE:
            i += 1
            continue
        j, depth = i, 0
        while j < n and not (t[j][0] == NEWLINE and depth == 0):
            if t[j][0] == OP:
                depth += (t[j][1] in "([{") - (t[j][1] in ")]}")
                if depth < 0:
                    raise Reject("unbalanced_delimiter")
            j += 1
        if depth:
            raise Reject("unbalanced_delimiter")
        column = t[i][2]
        if opened:
            if column <= indents[-1]:
                raise Reject("premature_end")
            indents.append(column)
            before.append("")
            opened = False
        else:
            while column < indents[-1]:
                indents.pop()
                if before.pop() in ("try", "@"):
                    raise Reject("grammar")
            if column != indents[-1]:
                raise Reject("indentation")
        word = t[i][1] if t[i][0] == NAME else ""
        old = before[-1]
        if old == "try" and word not in ("except", "finally"):
            raise Reject("grammar")
        if old == "@" and word not in ("def", "class", "async") and t[i][1] != "@":
            raise Reject("grammar")
        if word in COMPOUND:
            kind, k = header(t, i, j)
            if kind in ("elif", "else", "except", "finally"):
                allowed = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "else_try")}[kind]
                if old not in allowed:
                    raise Reject("grammar")
            if old == "@" and kind not in ("def", "class"):
                raise Reject("grammar")
            before[-1] = "else_try" if kind == "else" and old == "except" else {"async": ""}.get(kind, kind)
            if k < j:
                if t[k][1] in COMPOUND:
                    raise Reject("grammar")
                simple_line(t, k, j)
            else:
                opened = True
        elif t[i][1] == "@":
            expression(t, i + 1, j, END, False)
            before[-1] = "@"
        else:
            simple_line(t, i, j)
            before[-1] = ""
        i = j + 1
    if opened or "try" in before or "@" in before:
        raise Reject("premature_end")


def simple_line(t: list[tuple[str, str, int, int]], i: int, j: int) -> None:
    start, depth = i, 0
    for k in range(i, j):
        if t[k][0] == OP:
            depth += (t[k][1] in "([{") - (t[k][1] in ")]}")
            if t[k][1] == ";" and not depth:
                if k == start:
                    raise Reject("grammar")
                simple(t, start, k)
                start = k + 1
    if start < j:
        simple(t, start, j)
