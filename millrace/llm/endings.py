"""How a text ends: closed, or within a word, sentence, formula or environment."""

from __future__ import annotations

import re

#: What the end of a text says about a cut.
CLOSED, UNSURE, REMARK, OPEN = "closed", "unsure", "remark", "open"
#: All that ``detail`` can say.
ENDINGS = (CLOSED, UNSURE, f"{REMARK} line", f"{REMARK} part", f"{OPEN} word", f"{OPEN} sign", f"{OPEN} in word", f"{OPEN} in sign", f"{OPEN} in stop")

# Commands that may stand at the end of a finished file, after its last sentence.
TRAILERS = ("endinput", "clearpage", "cleardoublepage", "newpage", "pagebreak", "bibliography", "bibliographystyle", "input", "include", "printbibliography", "maketitle", "appendix", "label", "tableofcontents", "fi", "bye", "vfill", "bigskip", "medskip", "smallskip", "par", "noindent", "hfill", "qed")

# Environments that a blank line can't lie in, and commands that no other environment can hold.
FORMULAS = frozenset(x + star for x in ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "math", "alignat", "flalign", "split", "cases", "array", "matrix", "pmatrix", "bmatrix") for star in ("", "*"))
HEADINGS = frozenset(("part", "chapter", "section", "subsection", "subsubsection"))

_TOKEN = re.compile(r"%[^\n]*|\n[ \t]*\n|\\(begin|end)\s*\{([^{}\n]*)\}|\\([a-zA-Z@]+)\*?|\\.|\$\$?|[{}]", re.S)
_VERBATIM = {"verbatim", "verbatim*", "lstlisting", "comment", "minted"}
_TRAILER = re.compile(r"\\(?:" + "|".join(TRAILERS) + r")\*?(?:\s*\[[^\[\]]*\])?(?:\s*\{[^{}]*\})*\s*$")
# Of these, commands that mean nothing without the argument in braces that follows.
_BARE = re.compile(r"\\(?:bibliography|bibliographystyle|include|label)\*?\s*$")
_COMMENT = re.compile(r"(?:^|(?<=\n))[ \t]*%[^\n]*\s*$")
_SENTENCE = re.compile(r"""[.?!。！？](?:["'”’»)\]}$]|''|\\\)|\\\]|~?\\(?:cite[tp]?|footnote|label|ref)\*?(?:\[[^\[\]]*\])?\{[^{}]*\})*$""")
_WORDS = re.compile(r"(?<![\\\w])[^\W\d_]{2,}(?:\s+[^\W\d_]+){2,}")
_ENV = re.compile(r"\\end\s*\{[^{}\n]+\}$|\\\]$|\$\$$")
_MARK = re.compile(r"(?:\s*(?:\.\.\.|…|\[\s*(?:\.\.\.|…|truncated|cut|continued|more|abridged|snip(?:ped)?|read more)\s*\]|\((?:truncated|cut|continued|more)\)))+\s*$", re.I)
_NOTE = re.compile(r"\n[ \t]*%[ \t]*(?:-{2,}|={2,}|\*{2,}|#{2,}|\[)[^\n]*\s*$")


def without_mark(text: str) -> tuple[str, bool]:
    """The text before a note line or an ellipsis that a source adds at the end, and whether it had an ellipsis."""
    body = _NOTE.sub("", text)
    rest = _MARK.sub("", body)
    return rest, len(rest) < len(body)


def structure(text: str) -> tuple[bool, bool, int]:
    """Whether the text is complete as a file, whether something is open at its end, and where the last comment starts (-1: it
    doesn't end in one).

    Open are environments but ``document``, braces, formulas, a skipped draft, and a preamble without a document.
    Comments and verbatim text are passed over. What a damaged text left open further up doesn't count: a blank line
    ends formulas and braces, a heading all environments, and whole words with a full stop end a formula between dollars.
    """
    stack: list[str] = []
    depth, math, draft, started, ended, begun = 0, False, 0, False, False, False
    verbatim, comment, dollar = "", -1, 0
    for m in _TOKEN.finditer(text):
        token = m.group()
        first = token[0]
        kind = m.group(1)
        if verbatim:
            if kind == "end" and m.group(2) == verbatim:
                verbatim = ""
                stack.pop()
            continue
        if first == "%":
            if m.end() == len(text):
                comment = m.start()
            continue
        if kind == "begin":
            env = m.group(2)
            if env == "document":
                begun = True
                stack.clear()
                depth, math = 0, False
            else:
                stack.append(env)
                if env in _VERBATIM:
                    verbatim = env
        elif kind == "end":
            env = m.group(2)
            if env == "document":
                ended = True
            elif env in stack:
                while stack.pop() != env:
                    pass
            math = False
        elif first == "\n":
            depth, math = 0, False
            stack = [e for e in stack if e not in FORMULAS]
        elif first == "{":
            depth += 1
        elif first == "}":
            depth = max(0, depth - 1)
        elif first == "$":
            math, dollar = not math, m.end()
        elif token == "\\[" or token == "\\(":
            math = True
        elif token == "\\]" or token == "\\)":
            math = False
        elif (name := m.group(3)) is not None:
            if name in HEADINGS:
                stack.clear()
                depth, math = 0, False
            elif name == "documentclass":
                started = True
            elif name == "iffalse":
                draft += 1
            elif name == "fi":
                draft = max(0, draft - 1)
    if math and _SENTENCE.search(text) and _WORDS.search(text, dollar):
        math, depth = False, 0
    is_open = bool(stack) or depth > 0 or math or draft > 0 or (started and not begun)
    return ended, is_open, comment


def _above(text: str, comment: int) -> str:
    """The text above the block of comment lines that the comment at this place ends."""
    start = text.rfind("\n", 0, comment) + 1
    if text[start:comment].strip():
        return text[:comment]
    while start:
        line = text.rfind("\n", 0, start - 1) + 1
        if not text[line:start].lstrip().startswith("%"):
            break
        start = line
    return text[:start]


def ending(text: str) -> str:
    """The evidence of the end of a text, from which any mark of the source has been taken.

    ``closed``: it has an ``\\end{document}``, or ends with a sentence or environment and nothing is open. ``open``: it ends within
    something. ``remark``: so far closed, but its last line is a comment that breaks off, as remarks after the end
    of a file do and cuts may. ``unsure``: the rest, and empty text.
    """
    return detail(text).partition(" ")[0]


def detail(text: str) -> str:
    """The evidence and, behind a blank, what it rests on: of an open end whether something encloses it (``in``) and whether it stops
    at a word, a sign or a full stop; of a remark whether its line is ended."""
    rest = text.rstrip()
    ended, is_open, comment = structure(rest)
    if ended:
        return CLOSED
    last = rest[-1:]
    if is_open:
        return f"{OPEN} in {'word' if last.isalnum() else 'stop' if _SENTENCE.search(rest) else 'sign'}"
    if comment >= 0:
        remark = rest[comment:].strip("% \t\n-=*#")
        before = detail(_above(rest, comment))
        # a comment that is itself a whole sentence, a rule or empty says nothing
        if not remark or _SENTENCE.search(remark) or before != CLOSED:
            return before
        return f"{REMARK} {'line' if '\n' in text[len(rest):] else 'part'}"
    if _BARE.search(rest):
        return f"{OPEN} sign"
    while True:
        cut = _TRAILER.sub("", rest).rstrip()
        if (m := _COMMENT.search(cut)) is not None:
            cut = _above(cut, m.start()).rstrip()
        if cut == rest:
            break
        rest = cut
    if not rest:
        return UNSURE
    if _SENTENCE.search(rest) or _ENV.search(rest):
        return CLOSED
    last = rest[-1]
    if last.isalnum() or last in ",;:-=+~(&_^$<|/'…" or re.search(r"\\(?:[a-zA-Z]*|[%&#_$])$|\\\\$", rest):
        return f"{OPEN} {'word' if last.isalnum() else 'sign'}"
    return UNSURE
