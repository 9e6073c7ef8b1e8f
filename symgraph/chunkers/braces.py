"""Chunks of languages with braces, by a scanner of their structure: comments and strings are blanked, then
declarations are found by their heads, and end with their block, a semicolon or a line."""

from __future__ import annotations

import re

FALLBACK_NAME = 80
_I = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:public|protected|private|static|final|abstract|default|synchronized|native|sealed|non-sealed|strictfp|transient|volatile)\s+)*"
_TYPE = r"(?:<[^>(){};]*>\s*)?[A-Za-z_][\w.]*(?:<[^(){};]*>)?(?:\[\])*"
_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"

#: Fixed values, by language: kind, head (group n: the name), what a declaration stands in ("" anywhere, "type" the
#: body of a type) and how it ends: "block" or semicolon, "line" or semicolon, "semicolon".
RULES = {
    "go": [
        ("import_declaration", r"^import\b", "", "group"), ("method_declaration", rf"^func\s*\([^)]*\)\s*(?P<n>{_I})", "", "block"),
        ("function_declaration", rf"^func\s+(?P<n>{_I})", "", "block"), ("type_declaration", r"^[ \t]*\btype\b(?=\s+[A-Za-z_(])", "", "group"),
        ("const_declaration", r"^[ \t]*\bconst\b(?=\s)", "", "group"), ("var_declaration", r"^[ \t]*\bvar\b(?=\s)", "", "group"),
    ],
    "java": [
        ("package_declaration", r"\bpackage\s+[\w.]+", "", "semicolon"), ("import_declaration", r"\bimport\s+(?:static\s+)?[\w.*]+", "", "semicolon"),
        ("class_declaration", rf"{_MODS}\bclass\s+(?P<n>{_I})", "", "block"), ("interface_declaration", rf"{_MODS}(?<!@)\binterface\s+(?P<n>{_I})", "", "block"),
        ("enum_declaration", rf"{_MODS}\benum\s+(?P<n>{_I})", "", "block"), ("record_declaration", rf"{_MODS}\brecord\s+(?P<n>{_I})(?=\s*[(<])", "", "block"),
        ("constructor_declaration", rf"(?<![\w.]){_MODS}(?P<n>{_I})\s*(?=\()", "type", "constructor"),
        ("method_declaration", rf"(?<![\w.]){_MODS}(?!return\b|new\b|throw\b|else\b){_TYPE}\s+(?P<n>{_I})\s*(?=\()", "type", "block"),
        ("field_declaration", rf"(?<![\w.]){_MODS}(?!return\b|import\b|package\b|throw\b){_TYPE}\s+(?P<n>{_I})\s*(?=[=;,])", "type", "semicolon"),
    ],
    "rust": [
        ("use_declaration", rf"{_PUB}\buse\s", "", "semicolon"), ("function_item", rf"{_PUB}(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*\bfn\s+(?P<n>{_I})", "", "block"),
        ("struct_item", rf"{_PUB}\bstruct\s+(?P<n>{_I})", "", "block"), ("enum_item", rf"{_PUB}\benum\s+(?P<n>{_I})", "", "block"),
        ("trait_item", rf"{_PUB}(?:unsafe\s+)?\btrait\s+(?P<n>{_I})", "", "block"), ("impl_item", r"(?:unsafe\s+)?\bimpl\b(?:\s*<[^{{>]*>)?\s*(?:[\w:<>', &]+?\bfor\s+)?(?P<n>[\w:]+(?:<[^{{]*>)?)", "", "block"),
        ("type_item", rf"{_PUB}\btype\s+(?P<n>{_I})", "", "semicolon"), ("const_item", rf"{_PUB}\bconst\s+(?!fn\b|unsafe\b|async\b)(?P<n>{_I})\s*(?=:)", "", "semicolon"),
        ("static_item", rf"{_PUB}\bstatic\s+(?:mut\s+)?(?P<n>{_I})\s*(?=:)", "", "semicolon"), ("mod_item", rf"{_PUB}\bmod\s+(?P<n>{_I})", "", "block"),
    ],
    "typescript": [
        ("import_statement", r"^[ \t]*\bimport\b(?!\s*\()", "", "line"), ("abstract_class_declaration", rf"\babstract\s+class\s+(?P<n>{_I})", "", "block"),
        ("class_declaration", rf"(?<!abstract )\bclass\s+(?P<n>{_I})", "", "block"), ("interface_declaration", rf"\binterface\s+(?P<n>{_I})", "", "block"),
        ("enum_declaration", rf"(?:const\s+)?\benum\s+(?P<n>{_I})", "", "block"), ("type_alias_declaration", rf"\btype\s+(?P<n>{_I})\s*(?:<[^=]*>)?\s*(?==)", "", "line"),
        ("generator_function_declaration", rf"(?:async\s+)?\bfunction\s*\*\s*(?P<n>{_I})", "", "block"), ("function_declaration", rf"(?:async\s+)?\bfunction\s+(?P<n>{_I})", "", "block"),
        ("lexical_declaration", rf"\b(?:const|let)\s+(?P<n>{_I})(?=\s*[:=;,\n])", "", "line"), ("variable_declaration", rf"\bvar\s+(?P<n>{_I})(?=\s*[:=;,\n])", "", "line"),
        ("method", rf"^[ \t]*(?:(?:public|protected|private|static|readonly|async|override|abstract|get|set)\s+)*\*?\s*(?P<n>#?{_I})\??\s*(?:<[^(){{}}]*>)?\s*(?=\()", "type", "method"),
        ("public_field_definition", rf"^[ \t]*(?:(?:public|protected|private|static|readonly|override|declare)\s+)*(?P<n>#?{_I})[?!]?\s*(?=[:=;\n])", "class", "line"),
    ],
}
_TYPE_HEADS = {"class_declaration", "abstract_class_declaration", "interface_declaration", "enum_declaration", "record_declaration"}
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "new", "function", "super", "this", "throw", "synchronized", "constructor_"}


def blanked(text: str, language: str) -> str:
    """The text with comments and strings as blanks, line ends kept; places stay the same."""
    quotes = {"go": "\"'`", "java": "\"'", "rust": '"', "typescript": "\"'`"}[language]
    strings = "|".join(rf"{re.escape(q)}(?:\\.|[^{re.escape(q)}\\{'' if q == '`' or (language == 'rust') else chr(10)}])*{re.escape(q)}" for q in quotes)
    chars = r"|'(?:\\.[^']*|[^'\\\n])'" if language == "rust" else ""
    pattern = re.compile(rf"//[^\n]*|/\*.*?\*/|{strings}{chars}", re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _closed(text: str, at: int, opening: str, closing: str) -> int:
    """The place after the bracket that closes the one at `at`."""
    depth = 0
    for m in re.compile(f"[{re.escape(opening)}{re.escape(closing)}]").finditer(text, at):
        depth += 1 if m[0] == opening else -1
        if depth == 0:
            return m.end()
    return len(text)


def _end(text: str, at: int, how: str) -> int | None:
    """Where a declaration whose head ends at `at` ends, or None if it isn't one."""
    k, n = at, len(text)
    while k < n:
        c = text[k]
        if c in "([":
            k = _closed(text, k, c, {"(": ")", "[": "]"}[c])
            if how == "group" and text[at:k].lstrip().startswith("("):
                return k
            continue
        if c == "{":
            if how == "constructor" and not re.match(r"\s*\([^{}]*\)\s*(?:throws\s+[\w.,\s]+)?$", text[at:k]):
                return None
            k = _closed(text, k, "{", "}")
            if how in ("block", "constructor", "method", "group"):
                return k
            continue
        if c == ";":
            return None if how == "constructor" else k + (how != "group")
        if c == "}":
            return k if how in ("line", "method", "group") else None
        if c == "\n" and how in ("line", "group") and not re.match(r"\s*[.?:+&|=)]", text[k:]) and not re.search(r"[=,(+&|:?]\s*$|=>\s*$", text[at:k]):
            return k
        if c == "\n" and how == "method" and not text[at:k].rstrip().endswith((",", "|", "&", ":")):
            return k
        k += 1
    return n


def chunks(source: bytes, language: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, start, end) in bytes of the declarations of a file."""
    text = source.decode("latin-1")  # one character a byte, so that places are bytes
    plain, out, bodies = blanked(text, language), [], []
    rules = sorted(RULES[language], key=lambda r: r[2] != "")
    for kind, head, inside, how in rules:
        for m in re.compile(head, re.M).finditer(plain):
            name = m.groupdict().get("n")
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if name in _KEYWORDS:
                continue
            body = next((b for b in sorted(bodies, key=lambda b: b[1] - b[0]) if b[0] < start < b[1]), None)
            if inside and (body is None or _depth(plain, body[0], start) != 1 or (inside == "class" and body[2] == "interface_declaration")):
                continue
            end = _end(plain, m.end(), how)
            if end is None:
                continue
            is_constructor = how == "constructor"
            if is_constructor and name != body[3]:
                continue
            if kind == "method":
                whole = plain[m.end() : end]
                kind_now = "method_definition" if "{" in whole else "abstract_method_signature" if "abstract" in m[0] else "method_signature"
            else:
                kind_now = kind
            label = name or text[start:end].strip().split("\n", 1)[0][:FALLBACK_NAME]
            if name is None and language == "typescript":
                label = label.rstrip(";") if not text[start:end].rstrip().endswith(";") else label
            out.append((kind_now, label.encode("latin-1").decode("utf-8", "replace"), start, end))
            if kind_now in _TYPE_HEADS and "{" in plain[m.end() : end]:
                bodies.append((plain.index("{", m.end()), end, kind_now, name))
    return out


def _depth(text: str, start: int, at: int) -> int:
    part = text[start:at]
    return part.count("{") - part.count("}")


_CALLEE = re.compile(rf"(?<![\w$.]){_I}(?:\s*(?:\?\.|\.)\s*#?{_I}|\s*!(?=\s*[.(]))*(?:<[^<>(){{}};]*>)?\s*(?:\?\.)?\s*(?=\()")
_NEXT = re.compile(rf"(?:\s*!?\s*(?:\?\.|\.)\s*#?{_I})+(?:<[^<>(){{}};]*>)?\s*(?:\?\.)?\s*(?=\()")
_NEW = re.compile(rf"(?<![\w$.])new\s+(?={_I})")
_RETURN = re.compile(r"(?<![\w$.])return\b")
_NOT_CALLED = _KEYWORDS | {"import", "await", "typeof", "void", "delete", "in", "of", "do", "else", "case", "yield", "async", "with"}


def sites(source: bytes, language: str = "typescript") -> list[tuple[str, int, int, int, int]]:
    """(what, start_line, start_col, end_line, end_col) of callees, new expressions and return statements, lines from 0.

    A callee is the chain of names before an argument list; heads of functions and methods, which are followed by
    a body or a type, aren't calls.
    """
    text = source.decode("latin-1")
    plain = blanked(text, language)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    from bisect import bisect_right

    def place(at: int) -> tuple[int, int]:
        line = bisect_right(starts, at) - 1
        return line, at - starts[line]

    heads, out, new_callees = set(), [], set()
    for kind, name, start, _ in chunks(source, language):
        if kind in ("method_definition", "method_signature", "abstract_method_signature"):
            m = re.compile(rf"(?<![\w$]){re.escape(name)}\s*[?(<]").search(plain, start)
            heads.add(m.start() if m else start)
    for m in _NEW.finditer(plain):
        callee = _CALLEE.match(plain, m.end())
        end = _closed(plain, callee.end(), "(", ")") if callee else re.compile(rf"{_I}(?:\.{_I})*").match(plain, m.end()).end()
        new_callees.add(m.end())
        out.append(("new", *place(m.start()), *place(end)))
    for m in _CALLEE.finditer(plain):
        before = plain[max(0, m.start() - 40) : m.start()].rstrip()[-9:]
        if m.start() in heads or m[0].strip() in _NOT_CALLED - {"super"} or re.search(r"\bfunction\s*\*?$", before):
            continue
        close = _closed(plain, m.end(), "(", ")")
        if re.compile(r"\s*\{").match(plain, close):
            continue
        if m.start() not in new_callees:
            out.append(("call", *place(m.start()), *place(m.start() + len(m[0].rstrip()))))
        while more := _NEXT.match(plain, close):  # calls on what a call returns
            out.append(("call", *place(m.start()), *place(close + len(more[0].rstrip()))))
            close = _closed(plain, more.end(), "(", ")")
    for m in _RETURN.finditer(plain):
        end = _end(plain, m.end(), "line") or len(plain)
        out.append(("return", *place(m.start()), *place(end)))
    return sorted(set(out), key=lambda s: s[1:])
