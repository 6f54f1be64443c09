"""Markup residue: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure (problem 4).

A text is cut into blocks: headings, paragraphs, list items, quotes, code, formulas, table rows. Their
markup is removed; code and formulas stay as they are written. Then two passes label blocks as content
or boilerplate. First: headings, list items, code, formulas and table rows are content; stop-word density,
length and link density decide what else they can. Second: short and otherwise undecided blocks take the label of the nearest
decided neighbours (both agree, or the nearer one; content when there is none). The clean text holds
the content blocks; the boilerplate ones are kept with their label.

In the clean text a heading stands on its own line between empty lines, list items begin with "- " or
their number, code is indented by four blanks, formulas stand without their delimiters, table cells
are separated by tabs. pieces counts the bits of markup found, per family; conventions of plain mail
(quote marks, dashes, stars or numbers before lines, *word*, drawn lines, addresses and remarks in
angle brackets, prices, paths, arithmetic) are none and stay as they are.

Defined cases: text null: null clean text, no blocks, no pieces; empty: empty. Id null stays null; repeated rows are converted one by one. Texts without markup come out unchanged but for line
ends (\\r\\n as \\n) and outer blank lines. Very long texts are converted whole. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.util import spread

# Names of HTML elements, old ones included.
ELEMENTS = frozenset(
    """a abbr acronym address applet area article aside audio b base basefont bdi bdo bgsound big blink blockquote body br button
    canvas caption center cite code col colgroup dd del details dfn dir div dl dt em embed fieldset figcaption figure font footer form
    frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta
    nav nobr noframes noscript object ol optgroup option p param picture pre q ref s samp script section select small source span strike
    strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr track tt u ul var video wbr""".split()
)
BREAKING = frozenset(
    """address article aside blockquote body br center dd div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head
    header hr html legend li main menu nav ol optgroup option p pre section select table tbody tfoot thead title tr ul""".split()
)
# Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    """the a an of to and in that is was for it with as on be at by this not are but from or have his her their our your each every
    der die das und ein eine zu den von mit für auf ist nicht im dem des durch bei nach über vor le la les un une des du et de à est que
    pour dans sur par chez sans sous entre el los las una y en con por para más se lo sin o os as um uma e do da em não com ao é até
    się i w na z do że nie to jest po dla przez który и в на с не что по для это как из от у за чтобы под без""".split()
)
STOP_CHARACTERS = frozenset("的了在是我和们有这のにはをとがでた")

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(\s[^<>]*|/)?>")
_CUT_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[A-Za-z-]+(?:\s*=[^<>]*)?)?\s*(?=$|<)|\s+[A-Za-z-]+\s*=\s*(?:\"[^\"<>]*\"?|'[^'<>]*'?|[^\s<>]+)|(?<=<BR)(?=[\s])|(?<=<br)(?=[\s]))")
_CUT_HEAD = re.compile(r"^[^<>\n]*?\b(?:href|src|class|style|color|size|face|bgcolor|width|align)\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[\w#%]+)[^<>\n]*>")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*(?:>|\Z)|<\?xml[^>]*(?:>|\Z)|<!\[CDATA\[|\]\]>|-->", re.S | re.I)
_HIDDEN = re.compile(r"<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_ENTITY_REST = re.compile(r"#\d{1,7};?|#[xX][0-9A-Fa-f]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};|(?:nbsp|lt|gt|amp|quot|copy|reg)(?![A-Za-z0-9=;])")

_FENCE = re.compile(r"^ {0,3}(```+|~~~+)\s*([\w+#.-]*)\s*$")
_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
_TABLE_RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$|^\s*\|\s*:?-{2,}:?\s*\|\s*$")
_TABLE_ROW = re.compile(r"^\s*\|(?![-}+|]).*[^|\s].*\|\s*$")
_LINK = re.compile(r"(!?)\[((?:[^\[\]]++|\[[^\[\]\n]*\])*+)\]\(([^()\s]*(?:\([^()\s]*\))?[^()\s]*)(?:\s+\"[^\"\n]*\")?\)")
_CUT_LINK = re.compile(r"\]\((?:https?|ftp|mailto):[^\s()]*\)?")
_REFERENCE = re.compile(r"^ {0,3}\[[^\]\n]+\]:\s*<?\S+:\S+>?.*$")
_REF_LINK = re.compile(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]")
_TASK = re.compile(r"^(\s*[-*+] )\[[ xX]\] ")
_STRONG = re.compile(r"\*\*(?=[^\s*])([^*]++)(?<!\s)\*\*(?!\*)")
_STRONG_ = re.compile(r"(?<![\w_])__(?=[^\s_])([^_]++)(?<!\s)__(?![\w_])")
_STRIKE = re.compile(r"~~(?=[^\s~])([^~]++)(?<!\s)~~")
_TICKS = re.compile(r"(?<![�\x80-\x9f])(`+)(?=[^`\n])([^\n�\x80-\x9f]*?[^`�\x80-\x9f])\1(?![`�\x80-\x9f])")

# pieces broken by an empty line
_BROKEN = re.compile(r"(\*\*|~~|```)(?=[^\s*~`])(?=[^*~`]+?\n[ \t]*\n)([^*~`]++)(?<!\s)\1(?![*~`])")
_BROKEN_WIKI = re.compile(r"\[\[(?=[^\[\]]+?\n[ \t]*\n)([^\[\]]++)\]\]|\{\{(?=[^{}]+?\n[ \t]*\n)([^{}]++)\}\}")

_WIKI_HEAD = re.compile(r"^(={2,6})\s*([^=\s](?:.*[^=\s])?)\s*\1\s*$")
_TEXTILE = re.compile(r"^(?:h([1-6])|bq)\. +(\S.*)$")
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*+\|)*+([^\[\]|]++)\]\]")
_CATEGORY = re.compile(r"^\s*\[\[(?:Category|Kategorie|Catégorie|File|Image|Datei):[^\[\]\n]*\]\]\s*$", re.I)
_URL_LINK = re.compile(r"\[(?:https?|ftp|mailto)[:/]\S+\s+((?:(?!\[(?:https?|ftp|mailto)[:/])[^\]])++)\]")
_BRACES = re.compile(r"\{\{|\}\}|[{}]")
_QUOTES = re.compile(r"('{2,5})(?=[^'\s])([^']++)(?<!\s)\1(?!')")
_WIKI_TABLE = re.compile(r"^\s*(?:\{\||\|\}|\|-+\s*$|\|\+)")
_WIKI_ROW = re.compile(r"^\s*(?:\|\|?|!)\s*(.*(?:\|\||!!).*?)\s*$")
_MAGIC = re.compile(r"__(?:TOC|NOTOC|NOEDITSECTION)__|~~~~+(?=\s*$)|\{(?:code|noformat|quote)(?::[^}]*)?\}|#REDIRECT\b")

_COMMAND = re.compile(r"(?P<escaped>\\[{}])|(?P<command>~?\\(?P<name>[A-Za-z]+)\*?\s*(?:\[[^\[\]\n]*\]\s*)*\{)|(?P<group>\{\\(?:it|bf|em|tt|sc|rm|sf|sl|small|large|Large|tiny|footnotesize)\b\s*)|(?P<open>\{)|(?P<close>\})")
_OPEN_COMMAND = re.compile(r"\\(?:text(?:bf|it|tt|rm|sf|sc)|emph|section|subsection|subsubsection|paragraph|chapter|footnote|cite|ref|label|begin|end|title|author)\*?\{")
_BARE = re.compile(r"(?<![\w\\:])\\(?:item|maketitle|tableofcontents|centering|hline|noindent|newpage|clearpage|par|bigskip|medskip|smallskip|LaTeX|TeX|ldots|dots|quad|qquad|newline|linebreak|appendix)\b(?!\\)\s?")
_ACCENT = re.compile(r"\\(['\"`^~])\s*(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))")
_ESCAPED = re.compile(r"(?<![\\\w:])\\([%&#_$])|(?<=\w)\\([%&$])")
_LINE_BREAK = re.compile(r"\\\\(?:\[[^\]\n]*\])?[ \t]*(?=\n|$)")
_MATH = re.compile(r"\\\(((?:(?!\\\().)+?)\\\)|\\\[((?:(?!\\\[).)+?)\\\]|\$\$(.+?)\$\$", re.S)
_DOLLARS = re.compile(r"(?<![\w$\\])\$(?=[^\s$])([^$\n]++)(?<![\s\\])\$(?![\w$])")
_MATH_INNER = re.compile(r"\\[A-Za-z]|[\^_{}]|^[A-Za-z]$|^[A-Za-z0-9 ]*[=<>+/-] ?[A-Za-z0-9 .]+$")
_BEGIN = re.compile(r"^\s*\\begin\{([A-Za-z]+)\*?\}")
_SECTION = re.compile(r"^\s*\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]\n]*\])?\{(.*)\}\s*$")
_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
_FORMULAS = frozenset("equation align displaymath math eqnarray gather multline".split())
_CODE = frozenset("verbatim lstlisting Verbatim minted".split())
_MARKS = {"'": "\u0301", "`": "\u0300", '"': "\u0308", "^": "\u0302", "~": "\u0303"}
_ITEM = re.compile(r"^\s*\\item(?:\[([^\]]*)\])?\s*(.*)$")
_LIST = re.compile(r"^(\s*)([-*+\u2022]|\*{2,}|#{2,}|#(?=[^#]*$)|\d{1,3}[.)])[ \t]+(\S.*)$")
_WORDS = re.compile(r"[^\W\d_]+")
_URL = re.compile(r"(?:https?|ftp)://\S+|www\.\S+")


@dataclass
class Block:
    kind: str  # heading, paragraph, item, quote, code, formula, row
    level: int
    text: str
    links: int = 0  # characters of link text
    label: str = ""


class _Html:
    """HTML to lines: breaking tags end lines, headings, items and code keep a mark that the line pass reads."""

    H, LI, CODE, END = "\ue000", "\ue001", "\ue002", "\ue003"  # private marks, never in the output
    LINK, LINKED = "\ue004", "\ue005"

    def __init__(self, found: Counter):
        self.found = found

    def convert(self, text: str) -> str:
        def comment(m: re.Match) -> str:
            self.found["html"] += 1
            return ""

        def tag(m: re.Match) -> str:
            closing, name = m.group(1), m.group(2).lower()
            if name not in ELEMENTS:
                return m.group()
            self.found["html"] += 1
            if name in ("pre", "listing", "textarea"):
                return f"\n{self.END if closing else self.CODE}\n"
            if name[0] == "h" and name[1:] in "123456" and len(name) == 2 or name == "title":
                return "\n" if closing else f"\n{self.H}{name[1:] if len(name) == 2 else '1'}"
            if name == "li":
                return "\n" if closing else f"\n{self.LI}"
            if name in ("td", "th"):
                return "" if not closing else "\t"
            if name == "a":
                return self.LINKED if closing else self.LINK
            if name in ("sub", "sup"):
                return "" if closing else {"sub": "_", "sup": "^"}[name]
            return "\n" if name in BREAKING else ""

        text = _HIDDEN.sub(comment, text)
        text = _COMMENT.sub(comment, text)
        text = _TAG.sub(tag, text)
        text = _CUT_TAG.sub(self._cut, text)
        text = _CUT_HEAD.sub(comment, text, count=1)
        return self._entities(text)

    def _cut(self, m: re.Match) -> str:
        name = m.group(2).lower()
        if name not in ELEMENTS:
            return m.group()
        self.found["html"] += 1
        return "\n" if name in BREAKING else ""

    def _entities(self, text: str) -> str:
        """Entities as characters; escaped text may hold entities and tags again, at any depth."""
        while True:
            after = self._unescaped(text)
            if after == text:
                return after
            text = _TAG.sub(lambda m: ("\n" if m.group(2).lower() in BREAKING else "") if m.group(2).lower() in ELEMENTS else m.group(), after)

    def _unescaped(self, text: str) -> str:
        """One pass; an ampersand that comes out is at once tried with what follows, so '&amp;amp;amp;' costs one pass too."""
        out, at = [], 0
        while (k := text.find("&", at)) >= 0:
            out.append(text[at:k])
            at, shown = k + 1, "&"
            while shown == "&" and (m := _ENTITY_REST.match(text, at)):
                name = m.group()
                if name[0] != "#" and name.rstrip(";") + ";" not in html5:
                    break
                self.found["html"] += 1
                shown, at = unescape("&" + (name if name.endswith(";") else name + ";")), m.end()
            out.append(shown)
        out.append(text[at:])
        return "".join(out)


def _templates(text: str, found: Counter) -> str:
    """{{...}} without other braces inside, nested ones from the inside: the last argument, or nothing. One pass with a stack."""
    stack: list[tuple[list[str], bool]] = [([], False)]  # text so far, whether single braces are in it
    at = 0
    for m in _BRACES.finditer(text):
        stack[-1][0].append(text[at : m.start()])
        at = m.end()
        if m.group() == "{{":
            stack.append(([], False))
        elif m.group() == "}}" and len(stack) > 1:
            parts, braces = stack.pop()
            inner = "".join(parts)
            if braces:
                stack[-1][0].append("{{" + inner + "}}")
            else:
                found["wiki"] += 1
                stack[-1][0].append(inner.rpartition("|")[2] if "|" in inner else "")
        else:
            stack[-1] = (stack[-1][0], True)
            stack[-1][0].append(m.group())
    tail = text[at:]
    for parts, _ in reversed(stack[1:]):
        tail = "{{" + "".join(parts) + tail
    return "".join(stack[0][0]) + tail


_DROPPED = frozenset("label cite ref documentclass usepackage begin end vspace hspace includegraphics bibliography pagestyle".split())


def _commands(text: str, found: Counter) -> str:
    """LaTeX commands with an argument and {\\it ...} groups as their text, at any depth. One pass with a stack."""
    stack: list[tuple[str, str, list[str]]] = [("", "", [])]  # kind, what opened it, text so far
    at = 0
    for m in _COMMAND.finditer(text):
        stack[-1][2].append(text[at : m.start()])
        at = m.end()
        kind = m.lastgroup if m.lastgroup != "name" else "command"
        if kind == "close" and len(stack) > 1:
            kind, opened, parts = stack.pop()
            inner = "".join(parts)
            if kind == "open":
                inner = "{" + inner + "}"
            else:
                found["latex"] += 1
                if kind == "command":
                    name = opened.lstrip("~\\").rstrip("{").partition("[")[0].strip().rstrip("*")
                    inner = "" if name in _DROPPED else f" ({inner})" if name == "footnote" else inner
            stack[-1][2].append(inner)
        elif kind in ("escaped", "close"):
            stack[-1][2].append(m.group())
        else:
            stack.append((kind, m.group(), []))
    tail = text[at:]
    for _, opened, parts in reversed(stack[1:]):
        tail = opened + "".join(parts) + tail
    return "".join(stack[0][2]) + tail


def _addresses(text: str) -> int:
    """Characters of URLs and mail addresses."""
    n = sum(len(x) for x in _URL.findall(text))
    if "@" in text:
        for word in text.split():
            local, _, host = word.partition("@")
            n += len(word) if local and "." in host[1:-1] and not _URL.search(word) else 0
    return n


def _inline(text: str, found: Counter) -> tuple[str, int]:
    """Text without inline markup, and how many of its characters were link text."""
    links = 0
    kept: list[str] = []

    def count(family: str, value, link: bool = False):
        def one(m: re.Match) -> str:
            nonlocal links
            found[family] += 1
            out = value(m)
            links += len(out) if link else 0
            return out

        return one

    def keep(value):  # code and formulas are taken out so that nothing else touches them
        kept.append(value)
        return f"\ue010{len(kept) - 1}\ue011"

    text = _TICKS.sub(count("markdown", lambda m: keep(m.group(2).strip())), text)
    text = _MATH.sub(count("latex", lambda m: keep(next(g for g in m.groups() if g is not None).strip())), text)

    def dollars(m: re.Match) -> str:
        if not _MATH_INNER.search(m.group(1)):
            return m.group()
        found["latex"] += 1
        return keep(m.group(1))

    text = _DOLLARS.sub(dollars, text)
    text = _LINK.sub(count("markdown", lambda m: m.group(2), True), text)
    text = _CUT_LINK.sub(count("markdown", lambda m: ""), text)
    text = _REF_LINK.sub(count("markdown", lambda m: m.group(1), True), text)
    text = _WIKI_LINK.sub(count("wiki", lambda m: m.group(1), True), text)
    text = _URL_LINK.sub(count("wiki", lambda m: m.group(1), True), text)
    if "{{" in text:
        text = _templates(text, found)
    for pattern in (_STRONG, _STRONG_, _STRIKE):
        text = pattern.sub(count("markdown", lambda m: m.group(1)), text)
    text = _QUOTES.sub(count("wiki", lambda m: m.group(2)), text)
    text = _MAGIC.sub(count("wiki", lambda m: ""), text)
    if "\\" in text:
        text = _ACCENT.sub(count("latex", lambda m: (m.group(2) or m.group(3)) + _MARKS[m.group(1)]), text)
        text = _commands(text, found)
        text = _OPEN_COMMAND.sub(count("latex", lambda m: ""), text)
        text = _BARE.sub(count("latex", lambda m: ""), text)
        text = _ESCAPED.sub(count("latex", lambda m: m.group(1) or m.group(2)), text)
        text = _LINE_BREAK.sub(count("latex", lambda m: ""), text)
    links += sum(len(x) for x in re.findall(f"{_Html.LINK}([^{_Html.LINKED}]*)", text)) + _addresses(text)
    text = text.replace(_Html.LINK, "").replace(_Html.LINKED, "")
    return re.sub("\ue010(\\d+)\ue011", lambda m: kept[int(m.group(1))], text), links


def blocks_of(text: str) -> tuple[list[Block], Counter]:
    """The blocks of a text and the number of pieces of markup by family."""
    found: Counter = Counter()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in text or "&" in text or ">" in text:
        text = _Html(found).convert(text)
    html = found["html"] > 0
    text, n = _BROKEN.subn(r"\2", text)
    found["markdown"] += n
    text, n = _BROKEN_WIKI.subn(lambda m: (m.group(1) or m.group(2)).partition("|")[0], text)
    found["wiki"] += n
    found = +found  # no families without pieces
    lines, out, paragraph = text.split("\n"), [], []

    def flush() -> None:
        if paragraph:
            joined = "\n".join(paragraph)
            plain, links = _inline(joined, found)
            if plain.strip():
                out.append(Block("paragraph", 0, plain.strip("\n"), links))
            paragraph.clear()

    def add(kind: str, level: int, raw: str) -> None:
        flush()
        plain, links = (raw, 0) if kind in ("code", "formula") else _inline(raw, found)
        if plain.strip():
            out.append(Block(kind, level, plain if kind == "code" else plain.strip(), links))

    k = 0
    while k < len(lines):
        line = lines[k]
        k += 1
        if line == _Html.CODE or (fence := _FENCE.match(line)):
            end = _Html.END if line == _Html.CODE else fence.group(1)
            body = []
            if line != _Html.CODE:
                found["markdown"] += 1
                if fence.group(2) == "" and not any(lines[j].strip().startswith(end) for j in range(k, len(lines))):
                    continue  # the end of a fence whose beginning is cut off
            while k < len(lines) and not lines[k].strip().startswith(end):
                body.append(lines[k])
                k += 1
            k += 1
            add("code", 0, "\n".join(body).strip("\n"))
        elif line == _Html.END:
            flush()
        elif (m := _BEGIN.match(line)) and m.group(1) in _FORMULAS | _CODE:
            found["latex"] += 1
            body = [line[m.end() :]] if line[m.end() :].strip() and not line[m.end() :].startswith("{") else []
            while k < len(lines) and not re.match(rf"\s*\\end\{{{m.group(1)}", lines[k]):
                body.append(lines[k])
                k += 1
            k += 1
            add("formula" if m.group(1) in _FORMULAS else "code", 0, "\n".join(x for x in body if x.strip()))
        elif line.startswith(_Html.H):
            add("heading", int(line[1] if line[1:2].isdigit() else 1), line[2:])
        elif line.startswith(_Html.LI):
            add("item", 1, line[1:])
        elif m := _ATX.match(line):
            found["markdown"] += 1
            add("heading", len(m.group(1)), m.group(2))
        elif m := _SECTION.match(line):
            found["latex"] += 1
            add("heading", _LEVEL[m.group(1)], m.group(2))
        elif m := _WIKI_HEAD.match(line):
            found["wiki"] += 1
            add("heading", len(m.group(1)), m.group(2))
        elif m := _TEXTILE.match(line):
            found["wiki"] += 1
            add("heading" if m.group(1) else "quote", int(m.group(1) or 0), m.group(2))
        elif re.fullmatch(r"={3,}\s*", line) and paragraph and paragraph[-1].strip():
            found["markdown"] += 1
            title = paragraph.pop()
            add("heading", 1, title)
        elif _setext_dashes(line, paragraph, lines, k):
            found["markdown"] += 1
            title = paragraph.pop()
            add("heading", 2, title)
        elif _CATEGORY.match(line) or _WIKI_TABLE.match(line):
            found["wiki"] += 1
            flush()
        elif _TABLE_RULE.match(line) or _REFERENCE.match(line):
            found["markdown"] += 1
            flush()
        elif m := _WIKI_ROW.match(line):
            found["wiki"] += 1
            add("row", 0, "\t".join(c.strip() for c in re.split(r"\|\||!!", m.group(1).strip("|")) if c.strip()))
        elif _TABLE_ROW.match(line):
            found["markdown"] += 1
            add("row", 0, "\t".join(c.strip() for c in line.strip().strip("|").split("|")))
        elif "\t" in line and html and line.strip():
            add("row", 0, "\t".join(c.strip() for c in line.split("\t") if c.strip()))
        elif m := _ITEM.match(line):
            found["latex"] += 1
            add("item", 1, m.group(2))
        elif m := _LIST.match(line):
            if _TASK.match(line):
                found["markdown"] += 1
                m = _LIST.match(_TASK.sub(r"\1", line)) or m
            if m.group(2)[0] in "*#" and len(m.group(2)) > 1:
                found["wiki"] += 1
            add("item", 1 + len(m.group(1)) // 2, f"{m.group(2)} {m.group(3)}" if m.group(2)[0].isdigit() else m.group(3))
        elif line.startswith(">"):
            flush()
            plain, links = _inline(line, found)
            out.append(Block("quote", 0, plain, links))
        elif not line.strip():
            flush()
        else:
            paragraph.append(line)
    flush()
    return out, found


def _setext_dashes(line: str, paragraph: list[str], lines: list[str], k: int) -> bool:
    """Dashes of just the title's length under a single line between empty ones; other drawn lines are none."""
    dashes = line.rstrip()
    return bool(re.fullmatch(r"-{3,}", dashes)) and len(paragraph) == 1 and abs(len(paragraph[0].rstrip()) - len(dashes)) <= 1 and (k >= len(lines) or not lines[k].strip())


LONG, SHORT, STOP_LOW, STOP_HIGH, LINK_HIGH = 140, 40, 0.10, 0.22, 0.4


def label(blocks: list[Block]) -> None:
    """Two passes over the blocks of one text: content or boilerplate."""
    for b in blocks:
        if b.kind in ("code", "formula", "row"):
            b.label = "content"
            continue
        words = _WORDS.findall(b.text.lower())
        wide = sum(c > "\u2e80" for c in b.text)
        size = len(b.text) + wide
        density = (sum(w in STOP_WORDS for w in words) + sum(c in STOP_CHARACTERS for c in b.text)) / max(1, len(words) + wide / 4)
        links = b.links / max(1, len(b.text))
        if b.kind in ("heading", "item"):  # structure is kept whatever its links
            b.label = "content"
        elif links > LINK_HIGH:
            b.label = "boilerplate"
        elif size < SHORT:
            b.label = ""
        elif density >= STOP_HIGH or size >= LONG and density >= STOP_LOW or b.kind == "quote":
            b.label = "content"
        elif size >= LONG and links > LINK_HIGH / 2:
            b.label = "boilerplate"
    decided = [k for k, b in enumerate(blocks) if b.label]
    at = 0
    for k, b in enumerate(blocks):
        if b.label:
            at += 1
            continue
        before = decided[at - 1] if at else None
        after = decided[at] if at < len(decided) else None
        if before is None or after is None:
            b.label = blocks[before if before is not None else after].label if decided else "content"
        else:
            b.label = blocks[before if k - before <= after - k else after].label


def clean(text: str | None) -> tuple[str | None, list[Block], Counter]:
    """(clean text, labelled blocks, pieces of markup by family)."""
    if not text:
        return text, [], Counter()
    blocks, found = blocks_of(text)
    label(blocks)
    if not found:
        return text.replace("\r\n", "\n").strip("\n"), blocks, found
    out, last = [], ""
    for b in blocks:
        if b.label != "content":
            continue
        body = "\n".join("    " + x for x in b.text.split("\n")) if b.kind == "code" else b.text
        if b.kind == "item":
            body = "  " * (b.level - 1) + (body if body[:1].isdigit() and re.match(r"\d+[.)] ", body) else "- " + body)
        tight = b.kind == last and b.kind in ("item", "quote", "row")
        out.append(("\n" if tight else "\n\n" if out else "") + body)
        last = b.kind
    return "".join(out), blocks, found


OUT = "id long, clean string, html int, markdown int, wiki int, latex int, blocks array<struct<kind: string, level: int, label: string, text: string>>"


def clean_markup(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, clean text, pieces of markup per family, labelled blocks of every row, in one narrow pass."""
    block = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("label", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [clean(t) for t in b.column(1).to_pylist()]
            families = [pa.array([d[2][f] for d in done], pa.int32()) for f in ("html", "markdown", "wiki", "latex")]
            blocks = pa.array([[{"kind": x.kind, "level": x.level, "label": x.label, "text": x.text} for x in d[1]] for d in done], pa.list_(block))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), *families, blocks], ["id", "clean", "html", "markdown", "wiki", "latex", "blocks"])

    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, OUT)
