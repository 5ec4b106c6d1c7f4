"""Declarations, calls, imports and parents in source text, by masking strings and comments and matching brackets.

The scanner is no parser: it finds top-level declarations and the members of one level of classes, which is what the
relations need. Text that it can't follow gives fewer records, never an error.
"""

from __future__ import annotations

import ast
import bisect
import itertools
import re

Record = dict

_STRINGS = {
    "go": r'`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    "typescript": r'`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "rust": r'b?r(#*)"(?:.|\n)*?"\1|b?"(?:\\.|[^"\\])*"|b?\'(?:\\[^\n]+?|[^\'\\\n])\'',
    "php": r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|<<<[\'"]?(\w+)[\'"]?\n(?:.|\n)*?\n\s*\1\b',
}
_STRINGS["javascript"] = _STRINGS["typescript"]
_COMMENTS = {"go": r"//[^\n]*|/\*(?:.|\n)*?\*/", "rust": r"//[^\n]*|/\*(?:.|\n)*?\*/", "typescript": r"//[^\n]*|/\*(?:.|\n)*?\*/", "javascript": r"//[^\n]*|/\*(?:.|\n)*?\*/", "php": r"//[^\n]*|#(?!\[)[^\n]*|/\*(?:.|\n)*?\*/"}
_MASKS = {lang: re.compile(f"{_COMMENTS[lang]}|{_STRINGS[lang]}") for lang in _STRINGS}
# Words before a bracket that are no calls, by language.
NOT_CALLS = {
    "go": frozenset("if for switch return func go defer select range case struct interface map chan var const type".split()),
    "typescript": frozenset("if for while switch catch function return typeof await new super import delete void throw do in of yield case".split()),
    "rust": frozenset("if for while match loop fn return let in as move mut impl where unsafe".split()),
    "php": frozenset("if for foreach while switch match catch function fn return array list isset empty".split()),
}
NOT_CALLS["javascript"] = NOT_CALLS["typescript"]


_VISIBLE, _BRACKET, _WORD, _HEAD_END, _BLOCK = (re.compile(p) for p in (r"[^\n]", r"[{}()\[\]]", r"[^\s{}()\[\]]+", r"[{}()\[\];\n]", r"\s*\{"))


def mask(text: str, lang: str) -> str:
    """The text with strings and comments blanked, line for line and character for character."""
    return _MASKS[lang].sub(lambda m: _VISIBLE.sub(" ", m[0]), text)


class Source:
    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        self.bare = mask(text, lang)
        self.feeds = [m.start() for m in re.finditer("\n", text)]
        # the brackets, looked for once: their places, and the depth behind each
        self.brackets = [m.start() for m in _BRACKET.finditer(self.bare)]
        self.depths = list(itertools.accumulate(1 if self.bare[at] in "{([" else -1 for at in self.brackets))

    def row(self, at: int) -> int:
        return bisect.bisect_left(self.feeds, at)

    def close(self, at: int) -> int:
        """The place just behind the bracket that closes the one at ``at``; the end of the text if none does."""
        first = bisect.bisect_left(self.brackets, at)
        try:
            return self.brackets[self.depths.index(self.depths[first - 1] if first else 0, first)] + 1
        except ValueError:
            return len(self.bare)

    def level(self, start: int, end: int) -> list[int]:
        """Places in [start, end) that are inside no bracket: starts of lines or statements."""
        out, depth, at = [], 0, start
        for k in range(bisect.bisect_left(self.brackets, start), bisect.bisect_left(self.brackets, end)):
            here = self.brackets[k]
            if not depth and here > at:
                out += [m.start() for m in _WORD.finditer(self.bare, at, here)]
            depth = depth + 1 if self.depths[k] > (self.depths[k - 1] if k else 0) else max(0, depth - 1)
            at = here + 1
        if not depth:
            out += [m.start() for m in _WORD.finditer(self.bare, at, end)]
        return out

    def body_end(self, at: int) -> tuple[int, bool]:
        """End of a declaration whose head starts at ``at``: behind its block, or at the end of its statement. And whether it has a block."""
        depth = 0
        for m in _HEAD_END.finditer(self.bare, at):
            c = m[0]
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c == "{" and depth <= 0:
                return self.close(m.start()), True
            elif c == ";" and depth <= 0:
                return m.end(), False
            elif c == "}" and depth <= 0:
                return m.start(), False
            elif c == "\n" and depth <= 0 and self.lang == "go" and not _BLOCK.match(self.bare, m.end()):
                return m.start(), False
        return len(self.bare), False


def _symbol(src: Source, kind: str, name: str, receiver: str, start: int, end: int) -> Record:
    return {"rec": "symbol", "grammar_kind": kind, "name": name, "receiver": receiver, "start_row": src.row(start), "end_row": src.row(max(start, end - 1)) + 1, "span": (start, end)}


def _heads(src: Source, start: int, end: int, pattern: re.Pattern) -> list[re.Match]:
    """Matches of a declaration's head that begin outside all brackets of [start, end)."""
    out, behind = [], start
    for at in src.level(start, end):
        if at < behind:
            continue
        m = pattern.match(src.bare, at, end)
        if m:
            out.append(m)
            behind = m.end()
    return out


_GO = re.compile(r"func\s*(?:\((?P<recv>[^)]*)\)\s*)?(?P<fn>\w+)|type\s+(?:\(\s*)?(?P<type>\w+)")


def _go(src: Source) -> list[Record]:
    out = []
    for m in _heads(src, 0, len(src.bare), _GO):
        if m["type"]:
            grouped = re.match(r"type\s*\(", m[0])
            end = src.close(src.bare.index("(", m.start())) if grouped else src.body_end(m.end())[0]
            out.append(_symbol(src, "type_declaration", m["type"], "", m.start(), end))
        else:
            end = src.body_end(m.end())[0]
            if m["recv"] is None:
                out.append(_symbol(src, "function_declaration", m["fn"], "", m.start(), end))
            else:
                base = re.fullmatch(r"\s*(?:\w+\s+)?\*?\s*(?:\w+\.)?(\w+)\s*", m["recv"])
                out.append(_symbol(src, "method_declaration", m["fn"], base[1] if base else "", m.start(), end))
    return out


_TS = re.compile(r"(?P<pre>(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?)(?:(?P<fn>(?:async\s+)?function\s*\*?)\s*(?P<fname>[\w$]+)|class\s+(?P<cls>[\w$]+)|interface\s+(?P<iface>[\w$]+)|type\s+(?P<alias>[\w$]+)\s*(?:<[^=]*>)?\s*=|(?:const\s+)?enum\s+(?P<enum>[\w$]+))")
_TS_METHOD = re.compile(r"(?:(?:public|private|protected|static|readonly|async|override|abstract|get|set)\s+)*\*?\s*(?P<name>[#\w$]+)\s*(?:<[^>(]*>)?\(")


def _ts(src: Source) -> list[Record]:
    out, full = [], src.lang == "typescript"
    for m in _heads(src, 0, len(src.bare), _TS):
        start = m.start() + len(m["pre"])
        if m["fname"]:
            end, block = src.body_end(m.end())
            if block or full:
                out.append(_symbol(src, "function_declaration", m["fname"], "", start, end))
        elif m["cls"]:
            end, _ = src.body_end(m.end())
            out.append(_symbol(src, "class_declaration", m["cls"], "", start, end))
            brace = src.bare.find("{", m.end(), end)
            head = src.bare[m.end() : brace if brace >= 0 else end]
            heritage = re.search(r"\b(?:extends|implements)\b(.*)", head, re.S)
            for parent in dict.fromkeys(re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"<[^>]*>|\b(?:extends|implements)\b", " ", heritage[1]))) if heritage else ():
                out.append({"rec": "inherits", "name": m["cls"], "parent_name": parent})
            if brace >= 0:
                out += _members(src, brace, end, m["cls"], _TS_METHOD)
        elif full and (m["iface"] or m["alias"] or m["enum"]):
            end = src.body_end(m.end())[0]
            out.append(_symbol(src, "class_declaration", m["iface"] or m["alias"] or m["enum"], "", start, end))
    return out


def _members(src: Source, brace: int, end: int, owner: str, pattern: re.Pattern, need_block: bool = True) -> list[Record]:
    out = []
    for m in _heads(src, brace + 1, end - 1, pattern):
        if m["name"] in NOT_CALLS.get(src.lang, ()):
            continue
        bracket = src.bare.find("(", m.end() - 1)
        stop, block = src.body_end(src.close(bracket)) if bracket >= 0 else (m.end(), False)
        if block or not need_block:
            out.append(_symbol(src, "method_declaration", m["name"], owner, m.start(), stop))
    return out


_RUST = re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default)\s+|extern\s+(?:\s*)?)*(?:fn\s+(?P<fn>\w+)|struct\s+(?P<struct>\w+)|enum\s+(?P<enum>\w+)|(?:auto\s+)?trait\s+(?P<trait>\w+)|type\s+(?P<alias>\w+)|(?P<impl>impl)\b)")
_RUST_FN = re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default)\s+)*fn\s+(?P<name>\w+)")


def _rust(src: Source) -> list[Record]:
    out = []
    for m in _heads(src, 0, len(src.bare), _RUST):
        end, block = src.body_end(m.end())
        if m["fn"]:
            out.append(_symbol(src, "function_declaration", m["fn"], "", m.start(), end))
        elif m["impl"]:
            brace = src.bare.find("{", m.end(), end)
            head = re.sub(r"\bwhere\b.*", "", src.bare[m.end() : brace], flags=re.S)
            head = re.sub(r"^\s*<(?:[^<>]|<[^<>]*>)*>", "", head)
            owner = head.rsplit(" for ", 1)[-1].strip()
            if block and brace >= 0:
                out += _members(src, brace, end, owner, _RUST_FN)
        else:
            kind = "struct" if m["struct"] else "enum" if m["enum"] else "trait" if m["trait"] else "type_alias"
            name = m["struct"] or m["enum"] or m["trait"] or m["alias"]
            out.append(_symbol(src, f"{kind}_declaration", name, "", m.start(), end))
            brace = src.bare.find("{", m.end(), end)
            if m["trait"] and brace >= 0:
                out += _members(src, brace, end, name, _RUST_FN)
    return out


_PHP = re.compile(r"(?:(?:abstract|final|readonly)\s+)*(?:function\s+&?\s*(?P<fn>\w+)|class\s+(?P<cls>\w+)|interface\s+(?P<iface>\w+)|trait\s+(?P<trait>\w+)|enum\s+(?P<enum>\w+))", re.I)
_PHP_METHOD = re.compile(r"(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?\s*(?P<name>\w+)", re.I)


def _php(src: Source) -> list[Record]:
    out = []
    for m in _heads(src, 0, len(src.bare), _PHP):
        end = src.body_end(m.end())[0]
        if m["fn"]:
            out.append(_symbol(src, "function_declaration", m["fn"], "", m.start(), end))
            continue
        kind = "class" if m["cls"] else "interface" if m["iface"] else "trait" if m["trait"] else "enum"
        name = m["cls"] or m["iface"] or m["trait"] or m["enum"]
        out.append(_symbol(src, f"{kind}_declaration", name, "", m.start(), end))
        brace = src.bare.find("{", m.end(), end)
        if brace >= 0 and not m["enum"]:
            out += _members(src, brace, end, name, _PHP_METHOD, need_block=False)
    return out


def _python(text: str) -> list[Record]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def one(node: ast.AST, kind: str, receiver: str = "") -> None:
        out.append({"rec": "symbol", "grammar_kind": kind, "name": node.name, "receiver": receiver, "start_row": node.lineno - 1, "end_row": node.end_lineno, "span": None})

    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for n in tree.body:
        if isinstance(n, functions):
            one(n, "function_declaration")
        elif isinstance(n, ast.ClassDef):
            one(n, "class_declaration")
            for m in n.body:
                if isinstance(m, functions):
                    one(m, "method_declaration", n.name)
    return out


_CALL = re.compile(r"(?<![\w$.])(?P<path>(?:[\w$]+\s*\.\s*)*)(?P<name>[A-Za-z_$][\w$]*)\s*\(")
_NO_CALL = re.compile(r"\b(?:func|function|fn|new)$")
_AFTER_DOT = re.compile(r"[)\]}]\s*\.\s*(?P<name>[A-Za-z_]\w*)\s*\(")


def _calls(src: Source, s: Record) -> list[tuple[int, str]]:
    """(position, name) of the calls in a declaration's block: plain ones, and in Go also the last part of a selector."""
    start, end = s["span"]
    brace = src.bare.find("{", start, end)
    if brace < 0:
        return []
    if src.lang == "go":  # the block, not an interface in the parameters
        close = src.bare.find("(", start)
        while 0 <= close < end:
            brace = src.bare.find("{", src.close(close), end)
            nxt = src.bare.find("(", src.close(close), brace if brace >= 0 else end)
            if nxt < 0:
                break
            close = nxt
    got = []
    for m in _CALL.finditer(src.bare, max(brace, start), end):
        if m["name"] in NOT_CALLS.get(src.lang, ()) or (m["path"] and src.lang != "go"):
            continue
        before = src.bare[max(start, m.start() - 12) : m.start()].rstrip()
        if before.endswith(("func", "function", "fn", "new")) and _NO_CALL.search(before):
            continue
        got.append((m.start("name"), m["name"]))
    if src.lang == "go":
        got += [(m.start("name"), m["name"]) for m in _AFTER_DOT.finditer(src.bare, max(brace, start), end)]
    return sorted(set(got))


def _imports(src: Source) -> list[Record]:
    """Import paths with their rows; ``first`` marks the first of a statement."""
    out = []
    if src.lang == "go":
        for m in re.finditer(r"^import\b[^\S\n]*(\()?", src.bare, re.M):
            end = src.close(m.end() - 1) if m[1] else (src.text.find("\n", m.end()) + 1 or len(src.text)) - 1
            for k, q in enumerate(re.finditer(r'"([^"\n]*)"', src.text[m.start() : end])):
                out.append({"rec": "import", "import_path": q[1], "start_row": src.row(m.start()), "end_row": src.row(max(m.start(), end - 1)) + 1, "first": k == 0})
    elif src.lang in ("typescript", "javascript"):
        for m in re.finditer(r"^(?:import\b(?!\s*\()|export\b[^\n;]*?\bfrom\b)", src.bare, re.M):
            q = re.compile(r"""(?:"([^"\n]*)"|'([^'\n]*)')""").search(src.text, m.start())
            if q and ";" not in src.bare[m.start() : q.start()]:
                out.append({"rec": "import", "import_path": q[1] if q[1] is not None else q[2], "start_row": src.row(m.start()), "end_row": src.row(q.end()) + 1, "first": True})
    return out


EXTRACTORS = {"go": _go, "typescript": _ts, "javascript": _ts, "rust": _rust, "php": _php}


def register(lang: str, extractor, strings: str, comments: str) -> None:
    """Add a language: a function from Source to records, and the patterns of its strings and comments."""
    EXTRACTORS[lang] = extractor
    _MASKS[lang] = re.compile(f"{comments}|{strings}")


def extract(text: str, lang: str) -> list[Record]:
    """All records of a file: symbols in order of place (seq), calls, imports, inherits."""
    if lang == "python":
        found, src = _python(text), None
    elif lang in EXTRACTORS:
        src = Source(text, lang)
        found = EXTRACTORS[lang](src)
    else:
        return []
    symbols = sorted((r for r in found if r["rec"] == "symbol"), key=lambda r: r["start_row"]) if lang != "rust" else [r for r in found if r["rec"] == "symbol"]
    out = [{k: v for k, v in s.items() if k != "span"} | {"seq": n} for n, s in enumerate(symbols)]
    if src is not None:
        if lang not in ("php",):
            for n, s in enumerate(symbols):
                if s["grammar_kind"] in ("function_declaration", "method_declaration"):
                    out += [{"rec": "call", "seq": n, "callee_name": c, "name": s["name"], "receiver": s["receiver"], "start_row": s["start_row"], "end_row": src.row(at)} for at, c in _calls(src, s)]
        out += _imports(src)
        out += [r for r in found if r["rec"] == "inherits"]
    return out


#: White space at both ends, as Spark's regular expressions (``functions.text.strip``) see it.
_ENDS = re.compile("\\A[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+(?=[\x85\u2028\u2029]?\\Z)")


def doc_above(lines: list[str], row: int) -> str:
    """What ``operators.tree.doc_of`` gives for a declaration at ``row``, looking no further up than its comment."""
    got = []
    for n in range(min(row, len(lines)) - 1, -1, -1):
        line = _ENDS.sub("", lines[n])
        if line.startswith("//"):
            got.append(line[2:])
        elif line or got:
            break
    return _ENDS.sub("", "\n".join(reversed(got)))


def tokens(text: str, lang: str) -> list[tuple[int, str]]:
    """(row, token) of words, numbers and strings; an approximation of a syntax tree's named leaves."""
    bare = mask(text, lang) if lang in _MASKS else text
    feeds = [m.start() for m in re.finditer("\n", text)]
    return [(bisect.bisect_left(feeds, m.start()), m[0]) for m in re.finditer(r"[A-Za-z_$][\w$]*|\d[\w.]*", bare)]
