"""Facts of Java and Python files from their text alone: methods with their complexity, and patterns that security rules judge."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NOISE = {
    "java": (re.compile(r"(?s)//[^\n]*|/\*.*?\*/"), re.compile(r'(?s)"""..*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'')),
    "python": (re.compile(r"#[^\n]*"), re.compile(r'(?s)"""..*?"""|\'\'\'..*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'')),
}
_BOTH = {k: re.compile(f"(?s){s.pattern.removeprefix('(?s)')}|{c.pattern.removeprefix('(?s)')}") for k, (c, s) in _NOISE.items()}
_NAME = r"[A-Za-z_$][\w$]*"
_JAVA_TOKEN = re.compile(rf"(?P<name>{_NAME})|(?P<sign>[(){{}};.,@])")
# Words that stand before a bracket and are no names of methods, kinds of types, and a mark of a test.
_JAVA_WORDS = {"if", "for", "while", "switch", "catch", "synchronized", "try", "do", "else", "return", "new", "throw", "assert", "case", "super", "this"}
_JAVA_TYPES = {"class", "interface", "enum", "record"}
_JAVA_TESTS = {"Test", "ParameterizedTest", "RepeatedTest"}
# Words and signs that each add a branch.
_BRANCH = {"java": re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\|"), "python": re.compile(r"\b(?:if|elif|for|while|except|and|or)\b")}
_PATTERNS = {
    "java": [("sec.crypto.weak-hash", re.compile(r'getInstance\s*\(\s*"(?:MD5|SHA-?1)"')), ("sec.sql.string-concatenation", re.compile(r'(?i)"[^"\n]*\b(?:select|insert\s+into|update|delete\s+from)\b[^"\n]*"\s*\+'))],
    "python": [("sec.crypto.weak-hash", re.compile(r"\bhashlib\.(?:(?:md5|sha1)\s*\(|new\s*\(\s*[\"'](?i:md5|sha-?1)[\"'])")), ("sec.sql.string-concatenation", re.compile(r"(?i)\bexecute(?:many)?\s*\(\s*(?:f[\"']|[\"'][^\"'\n]*\b(?:select|insert|update|delete)\b[^\"'\n]*[\"']\s*(?:%|\+|\.format))"))],
}


def _blank(text: str, pattern: re.Pattern) -> str:
    """Matches become blanks of the same length, line breaks stay, so offsets hold."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _without_comments(text: str, language: str) -> str:
    """Comments blanked, strings kept: a mark of a comment inside a string is none."""
    comment = _NOISE[language][0]
    return _BOTH[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if comment.fullmatch(m[0]) else m[0], text)


def _closing(text: str, at: int) -> int:
    """Where the brace opened before `at` closes, or the end of the text."""
    depth = 1
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def _indented(text: str, at: int, indent: int) -> int:
    """Where the block ends whose lines stand deeper than indent."""
    end = text.find("\n", at)
    if end < 0:
        return len(text)
    for m in re.compile(r"(?m)^([ \t]*)(?=\S)").finditer(text, end + 1):
        if len(m[1].expandtabs(8)) <= indent and text[m.end()] not in ")]}":
            return m.start()
    return len(text)


def _java_tokens(plain: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, str, int, bool]]]:
    """(methods as (name, start, body), types and packages as (kind, name, start, False), methods that are tests as ("test", ...)).

    A method is a name with round brackets after it that are followed by a body, throws between them or not; what is called or
    made (a dot or `new` before the name) is none, nor is a name at the start of nothing: a head has a word, a bracket or an
    annotation before it.
    """
    tokens = [(m[0], m.start(), m.end()) for m in _JAVA_TOKEN.finditer(plain)]
    heads, others, opened = [], [], []
    closing: dict[int, int] = {}
    for i, (t, _, _) in enumerate(tokens):
        if t == "(":
            opened.append(i)
        elif t == ")" and opened:
            closing[opened.pop()] = i
    marked = False
    for i, (t, start, _) in enumerate(tokens):
        after = tokens[i + 1][0] if i + 1 < len(tokens) else ""
        before = tokens[i - 1][0] if i else ""
        if t == "@" and after in _JAVA_TESTS:
            marked = True
        elif t == "package" and not i:
            j = i + 1
            while j < len(tokens) and tokens[j][0] != ";":
                j += 1
            others.append(("package", plain[tokens[i + 1][1] : tokens[j - 1][2]] if j > i + 1 else "", start, False))
        elif t in _JAVA_TYPES and before != "." and re.fullmatch(_NAME, after):
            if t != "record" or tokens[i + 2 : i + 3] and tokens[i + 2][0] in "({<":
                others.append((t, after, tokens[i + 1][1], False))
        elif after == "(" and re.fullmatch(_NAME, t) and t not in _JAVA_WORDS and before not in (".", "new", "@", "record"):
            j = closing.get(i + 1, len(tokens)) + 1
            if j < len(tokens) and tokens[j][0] == "throws":
                while j < len(tokens) and tokens[j][0] not in "{;":
                    j += 1
            if j < len(tokens) and tokens[j][0] == "{":
                heads.append((t, start, tokens[j][2]))
                if marked:
                    others.append(("test", t, start, True))
                marked = False
    return heads, others


def _python_heads(plain: str) -> Iterator[tuple[str, str, int, int, int]]:
    """(def or class, name, start, end of the name, indent) of the lines that begin one."""
    at = 0
    for line in plain.split("\n"):
        words = line.split()
        lead = 1 if words[:2] == ["async", "def"] else 0
        if len(words) > lead + 1 and words[lead] in ("def", "class"):
            body = line[len(line) - len(line.lstrip()) :]
            name = re.split(r"[(:\[\s]", words[lead + 1], maxsplit=1)[0]
            if name.isidentifier():
                start = at + line.index(name, line.index(words[lead]) + len(words[lead]))
                yield words[lead], name, start, start + len(name), len(line.expandtabs(8)) - len(body.expandtabs(8))
        at += len(line) + 1


def _found(text: str, language: str) -> tuple[list[tuple[str, int, int, int]], list[tuple[str, str, int, bool]]]:
    """(methods as (name, start, end, complexity), other facts)."""
    plain = _blank(text, _BOTH[language])
    if language == "java":
        heads, others = _java_tokens(plain)
        spans = [(name, start, _closing(plain, body), body) for name, start, body in heads]
    else:
        heads = list(_python_heads(plain))
        spans = [(name, start, _indented(plain, end, indent), end) for kind, name, start, end, indent in heads if kind == "def"]
        others = [("class", name, start, False) for kind, name, start, _, _ in heads if kind == "class"]
        others += [("test", name, start, True) for kind, name, start, _, _ in heads if kind == "def" and name.startswith("test")]
    return [(name, start, end, 1 + len(_BRANCH[language].findall(plain, body, end))) for name, start, end, body in spans], others


def methods(text: str, language: str) -> list[tuple[str, int, int, int]]:
    """(name, start, end, complexity) of each method, in order."""
    return _found(text, language)[0]


def _facts(path: str, text: str, language: str) -> Iterator[tuple]:
    found, others = _found(text, language)
    line = lambda at: text.count("\n", 0, at) + 1
    for name, start, end, complexity in found:
        yield ("method", path, language, name, line(start), complexity, line(max(end - 1, start)) - line(start) + 1, None)
    shown = _without_comments(text, language)
    for rule, pattern in _PATTERNS[language]:
        for m in pattern.finditer(shown):
            inside = [f for f in found if f[1] <= m.start() < f[2]]
            yield ("pattern", path, language, inside[-1][0] if inside else path.rsplit("/", 1)[-1], line(m.start()), None, None, rule)
    for kind, name, start, _ in others:
        fact = kind if kind in ("package", "test") else "type"
        yield (fact, path, language, name, line(start), None, None, kind if fact == "type" else None)


def code_facts(files: DataFrame) -> DataFrame:
    """(kind, path, language, symbol, line, complexity, lines, rule_id) of .java and .py files: methods, types with what they are
    (class, interface, ...) as their rule_id, the package, tests, and weak hashes and SQL put together from strings, each with the
    method around it. Comments and strings count as blanks for methods; a pattern in a comment is none. Files are read one at a
    time and whole; one must fit into Arrow's two GB of text."""
    columns = ["kind", "path", "language", "symbol", "line", "complexity", "lines", "rule_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, t in zip(b["path"], b["content"]) for r in _facts(p, t or "", "java" if p.lower().endswith(".java") else "python")]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"line": "Int32", "complexity": "Int32", "lines": "Int32"})

    schema = "kind string, path string, language string, symbol string, line int, complexity int, lines int, rule_id string"
    return files.filter(F.lower("path").rlike(r"\.(java|py)$")).select("path", "content").mapInPandas(run, schema)
