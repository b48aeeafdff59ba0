"""A reader of TypeScript and JavaScript sources, JSX too: tokens with matched brackets, calls, imports, elements.

It knows as much of the languages as finding calls and their arguments takes: comments, strings, templates, regular
expressions, brackets and JSX. What it can't read to the end raises ScriptError.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/)+")
_WORD = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*|\#[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"0[xXbBoO][0-9a-fA-F_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?n?")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_MARK = re.compile(r"\?\.(?![0-9])|=>|\.\.\.|\?\?=?|&&=?|\|\|=?|[=!]==?|<=|\+\+|--|[\s\S]")
_TAG = re.compile(r"<([A-Za-z_$][\w$.:-]*)?")
_ESCAPE = re.compile(r"\\(u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|\r\n|[\s\S])")
#: Words after which an operand follows, not an operator.
_BEFORE_OPERAND = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "do", "else", "await", "yield", "default"}
#: Words that a parenthesis follows without a call.
_NO_CALL = {"if", "for", "while", "switch", "catch", "with", "function", "return", "typeof", "await", "case", "in", "of", "new", "do", "else", "void", "delete", "throw", "yield", "instanceof"}
_CLOSES = {")": "(", "]": "[", "}": "{"}


class ScriptError(ValueError):
    pass


@dataclass
class Token:
    kind: str  # word, number, string, template, regex, mark, jsx
    text: str
    start: int
    end: int
    match: int = -1  # of a bracket: the index of its other half


@dataclass
class Braces:
    """An expression in braces inside JSX."""

    owner: Element
    tokens: list[Token] = field(default_factory=list)


@dataclass
class Element:
    tag: str
    start: int
    inside: Element | Braces | None
    attributes: dict[str, str | Braces | None] = field(default_factory=dict)
    closed: bool = False  # <a/>, without children


def literal(text: str) -> str:
    """The value of a quoted string."""

    def value(m: re.Match) -> str:
        code = m[2] or m[3] or m[4]
        if code:
            return chr(int(code, 16))
        return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}.get(m[1], m[1])

    return _ESCAPE.sub(value, text[1:-1])


@dataclass
class Call:
    """receiver.name(arguments), or name(arguments) without a receiver."""

    tokens: list[Token]
    open: int

    @property
    def close(self) -> int:
        return self.tokens[self.open].match

    def _callee(self) -> int:
        """The index of the callee's last token; type arguments are passed over."""
        k = self.open - 1
        if k >= 0 and self.tokens[k].text == ">":
            depth = 0
            while k >= 0:
                depth += (self.tokens[k].text == ">") - (self.tokens[k].text == "<")
                k -= 1
                if not depth:
                    break
        return k

    @property
    def name(self) -> str:
        return self.tokens[self._callee()].text

    @property
    def member(self) -> bool:
        k = self._callee()
        return k > 0 and self.tokens[k - 1].text in (".", "?.")

    @property
    def on_call(self) -> bool:
        """Whether the receiver is a call itself."""
        k = self._callee() - 2
        return k >= 0 and self.tokens[k].text == ")" and is_call(self.tokens, self.tokens[k].match)

    def path(self) -> list[str] | None:
        """The names of a.b.c(...), if the callee is of names alone."""
        k, names = self._callee(), []
        while k >= 0 and self.tokens[k].kind == "word":
            names.append(self.tokens[k].text)
            if k < 2 or self.tokens[k - 1].text not in (".", "?."):
                return names[::-1]
            k -= 2
        return None

    def arguments(self) -> list[list[Token]]:
        return split(self.tokens, self.open + 1, self.close)

    def chained(self) -> Call | None:
        """The call made on this one's result."""
        k = self.close
        if k + 2 < len(self.tokens) and self.tokens[k + 1].text in (".", "?.") and self.tokens[k + 2].kind == "word":
            k += 3
            if k < len(self.tokens) and self.tokens[k].text == "<":
                depth = 0
                while k < len(self.tokens):
                    depth += (self.tokens[k].text == "<") - (self.tokens[k].text == ">")
                    k += 1
                    if not depth:
                        break
            if k < len(self.tokens) and self.tokens[k].text == "(":
                return Call(self.tokens, k)
        return None


def split(tokens: list[Token], start: int, end: int, mark: str = ",") -> list[list[Token]]:
    """What lies between marks of the outermost level; a trailing mark adds nothing."""
    out, own, k = [], [], start
    while k < end:
        t = tokens[k]
        if t.text == mark and t.kind == "mark":
            out.append(own)
            own = []
            k += 1
            continue
        if t.match > k:
            own += tokens[k : t.match + 1]
            k = t.match + 1
        else:
            own.append(t)
            k += 1
    return [x for x in [*out, own] if x]


def is_call(tokens: list[Token], k: int) -> bool:
    """Whether the parenthesis at k opens arguments."""
    if k <= 0 or tokens[k].text != "(":
        return False
    before = tokens[k - 1]
    if before.kind == "word":
        if k > 1 and tokens[k - 2].text in (".", "?."):
            return True
        if before.text in _NO_CALL or k > 1 and tokens[k - 2].text in ("function", "new", "get", "set") and tokens[k - 2].kind == "word":
            return False
        return not _declares(tokens, k)
    if before.text == ">":
        own = Call(tokens, k)._callee()
        return own >= 0 and tokens[own].kind == "word" and not _declares(tokens, k)
    return before.text in (")", "]") or before.kind == "template"


def _declares(tokens: list[Token], k: int) -> bool:
    """A method's declaration: name(...) {, or name(...): type {."""
    end = tokens[k].match
    return end + 1 < len(tokens) and tokens[end + 1].text == "{" and (k < 2 or tokens[k - 2].text in ("{", "}", ";", "async", "static", "public", "private", "protected", "*", ","))


class Script:
    def __init__(self, text: str):
        self.text = text
        self.elements: list[Element] = []
        self.tokens: list[Token] = []
        #: All lists of tokens: the script's own, and one for each expression in JSX or in a template.
        self.lists: list[list[Token]] = [self.tokens]
        if self._script(0, self.tokens, None, None) != len(text):
            raise ScriptError("a bracket closes that was not opened")

    def source(self, tokens: list[Token]) -> str:
        return self.text[tokens[0].start : tokens[-1].end] if tokens else ""

    def calls(self) -> list[Call]:
        found = [Call(own, k) for own in self.lists for k in range(len(own)) if is_call(own, k)]
        return sorted(found, key=lambda c: c.tokens[c.open].start)

    def imports(self) -> list[str]:
        """What import declarations name, in order."""
        out, own = [], self.tokens
        for k, t in enumerate(own):
            if t.text != "import" or t.kind != "word" or k and own[k - 1].text in (".", "?."):
                continue
            n = k + 1
            if n < len(own) and own[n].kind == "string":
                out.append(literal(own[n].text))
                continue
            while n < len(own) and own[n].text not in ("from", ";", "(", "=") and own[n].kind != "string":
                n = own[n].match + 1 if own[n].match > n else n + 1
            if n + 1 < len(own) and own[n].text == "from" and own[n + 1].kind == "string":
                out.append(literal(own[n + 1].text))
        return out

    # --- reading

    def _operand_next(self, own: list[Token]) -> bool:
        if not own:
            return True
        t = own[-1]
        if t.kind == "word":
            return t.text in _BEFORE_OPERAND and not (len(own) > 1 and own[-2].text in (".", "?."))
        return t.kind == "mark" and t.text not in (")", "]", "}", "++", "--")

    def _script(self, at: int, own: list[Token], closer: str | None, inside: Braces | None) -> int:
        """Reads up to an unmatched closer; the position behind it."""
        text, stack = self.text, []
        while True:
            if m := _SPACE.match(text, at):
                at = m.end()
            if at >= len(text):
                if closer or stack:
                    raise ScriptError("the source ends inside brackets")
                return at
            c = text[at]
            if c in "\"'":
                m, kind = _STRING.match(text, at), "string"
                if not m:
                    raise ScriptError("a string is not closed")
            elif c == "`":
                end = self._template(at, inside)
                own.append(Token("template", text[at:end], at, end))
                at = end
                continue
            elif c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit():
                m, kind = _NUMBER.match(text, at), "number"
            elif m := _WORD.match(text, at):
                kind = "word"
            elif c == "/" and self._operand_next(own) and (m := _REGEX.match(text, at)):
                kind = "regex"
            elif c == "<" and self._operand_next(own) and self._is_tag(at):
                end = self._element(at, inside)
                own.append(Token("jsx", text[at:end], at, end))
                at = end
                continue
            else:
                m, kind = _MARK.match(text, at), "mark"
            at = m.end()
            t = Token(kind, m[0], m.start(), at)
            if kind == "mark" and t.text in "([{":
                stack.append(len(own))
            elif kind == "mark" and t.text in _CLOSES:
                if not stack:
                    if t.text == closer:
                        return at
                    raise ScriptError("a bracket closes that was not opened")
                k = stack.pop()
                if own[k].text != _CLOSES[t.text]:
                    raise ScriptError("brackets do not match")
                own[k].match, t.match = len(own), k
            own.append(t)

    def _template(self, at: int, inside: Braces | None) -> int:
        text, at = self.text, at + 1
        while at < len(text):
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                return at + 1
            elif text.startswith("${", at):
                own: list[Token] = []
                self.lists.append(own)
                at = self._script(at + 2, own, "}", inside)
            else:
                at += 1
        raise ScriptError("a template is not closed")

    def _is_tag(self, at: int) -> bool:
        m = _TAG.match(self.text, at)
        if not m[1]:
            return self.text.startswith("<>", at)
        # <T>(x) => and <T,>() are type parameters, a cast is <T>x
        rest = self.text[m.end() : m.end() + 400].lstrip()
        if rest.startswith((",", "extends ")) or rest.startswith((">(", "> (")) and "</" + m[1] not in self.text[at:]:
            return False
        return bool(re.match(r"/?>|[A-Za-z_{/]", rest))

    def _element(self, at: int, inside: Element | Braces | None) -> int:
        text = self.text
        m = _TAG.match(text, at)
        own = Element(m[1] or "", at, inside)
        self.elements.append(own)
        at = m.end()
        while True:  # attributes
            if s := _SPACE.match(text, at):
                at = s.end()
            if text.startswith("/>", at):
                own.closed = True
                return at + 2
            if text.startswith(">", at):
                at += 1
                break
            if text.startswith("{", at):
                at = self._braces(at, own)[0]
                continue
            name = re.compile(r"[A-Za-z_$][\w$:.-]*").match(text, at)
            if not name:
                raise ScriptError(f"a tag that is not well formed at {at}")
            at, value = name.end(), None
            if eq := re.compile(r"\s*=\s*").match(text, at):
                at = eq.end()
                if text[at : at + 1] == "{":
                    at, value = self._braces(at, own)
                elif text[at : at + 1] in ('"', "'"):
                    end = text.find(text[at], at + 1)
                    if end < 0:
                        raise ScriptError("a string is not closed")
                    value, at = text[at + 1 : end], end + 1
                elif text[at : at + 1] == "<":
                    at = self._element(at, own)
            own.attributes.setdefault(name[0], value)
        while True:  # children
            at = min((p for p in (text.find("<", at), text.find("{", at)) if p >= 0), default=-1)
            if at < 0:
                raise ScriptError(f"<{own.tag}> is not closed")
            if text[at] == "{":
                at = self._braces(at, own)[0]
            elif close := re.compile(r"</\s*([\w$.:-]*)\s*>").match(text, at):
                if close[1] != own.tag:
                    raise ScriptError(f"<{own.tag}> is closed by {close[0]}")
                return close.end()
            else:
                at = self._element(at, own)

    def _braces(self, at: int, owner: Element) -> tuple[int, Braces]:
        own = Braces(owner)
        self.lists.append(own.tokens)
        return self._script(at + 1, own.tokens, "}", own), own
