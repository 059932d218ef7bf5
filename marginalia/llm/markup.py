"""Markup residue: HTML, wiki, LaTeX and Markdown rendered to plain text that keeps its structure.

Code and formulas are set aside first and come back unchanged. LaTeX, wiki and Markdown constructs become text,
heading lines, list lines and aligned tables; HTML tags go to a tree builder with implied end tags, and a renderer
emits the tree's visible text with block spacing, list marks and aligned cells. Every conversion notes its kind.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.batches import values

#: A text without any of these characters has no markup.
ANY = re.compile(r"[<&\\{\[*_~|>'=$`]")
#: Elements open at once; deeper ones are treated as if their tags were absent, their text stays.
DEPTH = 200
#: Rows or columns that a cell spans at most.
SPAN = 200

# Element names, by what they mean for a tree and its layout.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var button select option textarea output".split())
BLOCK = set(
    "html body head title address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "iframe legend li main menu nav object ol optgroup p pre section summary table caption colgroup thead tbody tfoot tr td th ul script style template noscript canvas svg math audio video map picture".split()
)
UNSEEN = set("head title script style template iframe noscript svg canvas audio video".split())
NAMES = VOID | INLINE | BLOCK
#: Start tag -> open elements it ends, and the elements that bound the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
}
PARAGRAPH_ENDS = BLOCK - {"li", "tr", "td", "th", "dt", "dd", "thead", "tbody", "tfoot", "caption", "colgroup", "script", "style", "template", "noscript", "object", "iframe", "canvas", "audio", "video", "svg", "math", "map", "picture"}
MARKS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307"}
SYMBOLS = {"ldots": "…", "dots": "…", "textbackslash": "\\", "ss": "ß", "ae": "æ", "oe": "œ", "o": "ø", "aa": "å", "LaTeX": "LaTeX", "TeX": "TeX", "textendash": "–", "textemdash": "—", "euro": "€", "textmu": "µ", "quad": " ", "par": "\n\n", "newline": "\n", "linebreak": "\n"}
# Greek letters whose Unicode name is another one.
LETTERS = {"lambda": "lamda"}
# Environments that hold a formula, and commands that set the layout only.
FORMULAS = set("equation align gather displaymath math eqnarray multline alignat flalign".split())
SILENT = set(
    "centering raggedright raggedleft noindent indent bfseries itshape scshape ttfamily rmfamily sffamily normalfont tiny scriptsize footnotesize small normalsize large Large LARGE huge Huge "
    "maketitle tableofcontents listoffigures listoftables newpage clearpage pagebreak smallskip medskip bigskip hfill vfill hline toprule midrule bottomrule item appendix begin end bf it em tt sc rm sf protect".split()
)
SIGNS = {"times": "×", "cdot": "·", "leq": "≤", "geq": "≥", "neq": "≠", "pm": "±", "approx": "≈", "infty": "∞", "rightarrow": "→", "to": "→"}
HEADINGS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
FILES = {"datei", "file", "bild", "image", "media", "medium"}
CATEGORIES = {"kategorie", "category"}

#: What is set aside begins with one of these; where it ends is found by ``Rendering._aside`` without looking at any text twice.
OPENERS = re.compile(
    r"(?P<fence>^[ \t]*(?P<mark>`{3,}|~{3,})[^\n]*\n)"
    r"|(?P<ticks>(?<!`)`+(?!`))"
    r"|(?P<display>\$\$)"
    r"|(?P<square>(?<!\\)\\\[)|(?P<round>(?<!\\)\\\()"
    r"|(?P<inline>(?<![\\$\w])\$(?=[^\s$])(?:[^$\n\\]|\\.)*?(?<=[^\s\\])\$(?![\w$]))"
    r"|(?P<path>(?<![A-Za-z0-9])[A-Za-z]:\\[^\s\"<>|]*|(?<!\S)\\\\[\w.-]+\\[^\s\"<>|]*|(?<![\\\w{.-])[\w.-]+(?:\\[\w.-]+){2,}(?![{\w])|https?://[^\s\"'<>)\]|}]+)"
    r"|(?P<own>[\ue000-\ue003]+)",
    re.M | re.S,
)
BLANK_LINE = re.compile(r"\n[ \t]*\n")
TICKS = re.compile(r"(?<!`)`+(?!`)")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
HIDDEN = re.compile(r"<(script|style|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*)\s*(/?)>|<!DOCTYPE[^<>]*>", re.I)
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SLOT = re.compile("\ue000(\\d+)\ue001")
TAG_SLOT = re.compile("(\ue002\\d+\ue003)")

ENVIRONMENT = re.compile(r"\\begin\{(\w+\*?)\}((?:\[[^\]\n]{0,200}\]|\{[^{}\n]{0,200}\})*)|\\end\{(\w+\*?)\}")
TITLE = re.compile(r"[ \t]*\\(" + "|".join(HEADINGS) + r")\*?(?:\[[^\]\n]{0,200}\])?\{([^{}]*)\}[ \t]*")
ACCENT = re.compile(r"\{\\([\"'`^~=.])\s*\{?(\w|\\i)\}?\}|\\([\"'`^~=.])(?:\{(\w|\\i)\}|([A-Za-z]))")
DROPPED = re.compile(r"\\(?:label|index|vspace|hspace|usepackage|documentclass|input|include|bibliography|bibliographystyle|begin|end)\*?(?:\[[^\]\n]{0,200}\])?\{[^{}]*\}")
KEYED = re.compile(r"\\(cite\w*|ref|eqref|pageref|autoref)\*?(?:\[[^\]\n]{0,200}\])?\{([^{}]*)\}")
LINKED = re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}")
#: A command with an argument, or a brace by itself.
BRACE = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]{0,200}\])?\{|(?<!\\)[{}]")
FONT = re.compile(r"\\(?:bf|it|em|tt|sc|rm|sf|sl|bfseries|itshape|scshape|ttfamily|small|large|tiny)\b[ \t]*")
BARE = re.compile(r"\\([A-Za-z]+)\*?([ \t]?)")
NEWLINE = re.compile(r"\\\\(?:\[[^\]\n]{0,40}\])?(?=\s|$)[ \t]*\n?")
#: Characters that LaTeX and Markdown write with a backslash.
ESCAPED = re.compile(r"\\([%&_#${}*\[\]|~^<>+!`-])")

TABLE_OPENS, TABLE_ENDS = re.compile(r"^[ \t]*\{\|[^\n]*\n", re.M), re.compile(r"^[ \t]*\|\}[ \t]*$", re.M)
TEMPLATE = re.compile(r"\{\{|\}\}|[{}]")
WIKI_LINK = re.compile(r"!?\[\[([^\[\]]+)\]\]")
QUOTES = re.compile(r"('{5}|'{2,3})(?=[^\s'])((?:(?!\n[ \t]*\n)(?:[^']|'(?!')))+?)(?<=[^\s'])\1(?!')")
WIKI_HEADING = re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t]*$", re.M)

#: A line of text, alone in its paragraph, above a line of equals signs or hyphens.
SETEXT = re.compile(r"(?:(?<=\n\n)|\A)(?![ \t]*(?:[-*+#>|=]|\d+[.)]))([^\n|]*[^\s|][^\n|]*)\n(={3,}|-{3,})[ \t]*(?=\n|\Z)")
MD_DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
MD_LINK = re.compile(r"(!?)\[([^\[\]]*)\]\([ \t]*<?([^()\s<>]*(?:\([^()\s]*\)[^()\s]*)?)>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?[ \t]*\)")
MD_DEFINITION = re.compile(r"^ {0,3}\[([^\]\n]+)\]:[ \t]*\S+[^\n]*$\n?", re.M)
MD_REFERENCE = re.compile(r"(!?)\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])((?:(?!\n[ \t]*\n)[^~])+?)(?<=[^\s~])~~(?!~)")
STARS = re.compile(r"(?<![\\*\w])(\*{1,3})(?=[^\s*])((?:(?!\n[ \t]*\n)[^*])+?)(?<=[^\s*])\1(?!\*)(?!(?<![*]\*)\w)")
UNDERLINES = re.compile(r"(?<![\w\\])(_{1,3})(?=[^\s_])((?:(?!\n[ \t]*\n)(?:[^_]|(?<=[^\W_])_+(?=[^\W_])))+?)(?<=[^\s_])\1(?!\w)")
QUOTED = re.compile(r"^ {0,3}(?:>[ \t]?)+", re.M)


def greek(name: str) -> str:
    """The letter that a command names, or nothing."""
    try:
        found = unicodedata.lookup(f"GREEK {'SMALL' if name.islower() else 'CAPITAL'} LETTER {LETTERS.get(name.lower(), name.lower())}") if name[1:].islower() or len(name) > 1 else ""
    except KeyError:
        return ""
    return found


def aligned(rows: list[list[str]]) -> str:
    """Cells in columns of equal width, separated by a bar."""
    rows = [[" ".join(c.split()) for c in r] for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    n = max(map(len, rows))
    rows = [r + [""] * (n - len(r)) for r in rows]
    width = [max(len(r[i]) for r in rows) for i in range(n)]
    return "\n".join(" | ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in rows)


class Element:
    __slots__ = ("name", "seen", "children", "attributes")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []
        style = re.sub(r"\s+", "", attributes.get("style", "").lower())
        self.seen = name not in UNSEEN and "hidden" not in attributes and "display:none" not in style and "visibility:hidden" not in style


class Rendering:
    """One text's conversion: ``text`` and the ``kinds`` of markup that were found."""

    def __init__(self, source: str):
        self.kinds: set[str] = set()
        #: What was set aside, and whether it may hold other parts.
        self.kept: list[tuple[str, bool]] = []
        self.tags: list[re.Match] = []
        self.text = self._whole(source) if ANY.search(source) else source

    def _note(self, kind: str, pattern: re.Pattern, to: Callable[[re.Match], str] | str, text: str) -> str:
        out, n = pattern.subn(to, text)
        if n:
            self.kinds.add(kind)
        return out

    def _whole(self, text: str) -> str:
        text = text.replace("\r\n", "\n")
        text = self._aside(text)
        if "<" in text:
            text = self._note("html", COMMENT, "", text)
            text = self._note("html", HIDDEN, "", text)
            text = TAG.sub(self._tag, text)
        if "\\" in text:
            text = self._latex(text)
        if "[[" in text or "{" in text or "''" in text or "=" in text:
            text = self._wiki(text)
        if "\n=" in text or "\n-" in text:
            text = SETEXT.sub(lambda m: ("# " if m.group(2)[0] == "=" else "## ") + m.group(1).strip(), text)
        text = self._markdown(text)
        if self.tags or "&" in text:
            text = self._html(text)
        if "\\" in text:
            text = ESCAPED.sub(r"\1", text)
        text = self._restored(text)
        return re.sub(r"\n{3,}", "\n\n", text) if self.kinds else text

    def _aside(self, text: str) -> str:
        """Set aside code, formulas, file paths and addresses. Every search for an end starts where the last one of its kind stopped."""
        if not OPENERS.search(text):
            return text
        blanks = [m.start() for m in BLANK_LINE.finditer(text)]
        runs: dict[int, list[int]] = {}
        for m in TICKS.finditer(text):
            runs.setdefault(len(m.group(0)), []).append(m.start())
        missing: set[str] = set()
        out, done, at = [], 0, 0
        while m := OPENERS.search(text, at):
            kind, start, end = m.lastgroup, m.start(), -1
            kind = "fence" if m.group("fence") else kind
            if kind == "fence":
                close = re.compile(r"^[ \t]*" + re.escape(m.group("mark")) + r"[`~]*[ \t]*$", re.M).search(text, m.end())
                end = close.end() if close else len(text)
            elif kind in ("ticks", "display"):
                i = bisect.bisect_left(blanks, m.end())
                stop = blanks[i] if i < len(blanks) else len(text)
                if kind == "ticks":
                    same = runs[len(m.group(0))]
                    i = bisect.bisect_left(same, m.end() + 1)
                    end = same[i] + len(m.group(0)) if i < len(same) and same[i] < stop else -1
                else:
                    close = text.find("$$", m.end() + 1, stop + 1)
                    end = close + 2 if close >= 0 else -1
            elif kind in ("square", "round"):
                mark = "\\]" if kind == "square" else "\\)"
                close = -1 if mark in missing else text.find(mark, m.end() + 1)
                if close < 0:
                    missing.add(mark)
                end = close + 2 if close >= 0 else -1
            else:
                end = m.end()
            if end < 0:
                at = m.end() if kind != "display" else start + 1
                continue
            out += [text[done:start], self._slot(text[start:end], False)]
            done = at = end
            if at >= len(text):
                break
        return "".join([*out, text[done:]])

    def _slot(self, part: str, nested: bool) -> str:
        self.kept.append((part, nested))
        return f"\ue000{len(self.kept) - 1}\ue001"

    def _restored(self, text: str) -> str:
        def one(m: re.Match) -> str:
            part, nested = self.kept[int(m.group(1))]
            return self._restored(part) if nested else part

        return SLOT.sub(one, text) if self.kept else text

    # ---- LaTeX

    def _latex(self, text: str) -> str:
        if "\\begin{" in text:
            text = self._environments(text)
        text = self._note("latex", TITLE, lambda m: "\n" + "#" * HEADINGS[m.group(1)] + " " + m.group(2).strip() + "\n", text)
        text = self._note("latex", ACCENT, self._accent, text)
        text = self._note("latex", LINKED, r"\1", text)
        text = self._note("latex", KEYED, lambda m: f"[{m.group(2)}]" if m.group(1).startswith("cite") else m.group(2), text)
        text = self._note("latex", DROPPED, "", text)
        if "{" in text:
            text = self._commands(text)
        text = self._note("latex", BARE, self._bare, text)
        return self._note("latex", NEWLINE, "\n", text)

    def _bare(self, m: re.Match) -> str:
        """A command without argument: its symbol, nothing if it only sets the layout, else it stays, as it may belong to a formula."""
        name = m.group(1)
        if name in SYMBOLS:
            return SYMBOLS[name]
        if name in SILENT:
            return ""
        letter = SIGNS.get(name) or greek(name)
        return letter + m.group(2) if letter else m.group(0)

    def _commands(self, text: str) -> str:
        """Commands with an argument become their argument, a footnote its text in parentheses; one pass with a stack of open braces."""
        stack: list[tuple[str | None, str, list[str]]] = [(None, "", [])]
        at = 0
        for m in BRACE.finditer(text):
            top = stack[-1][2]
            top.append(text[at : m.start()])
            at = m.end()
            if m.group(0) != "}":
                stack.append((m.group(1), m.group(0), []))
            elif len(stack) == 1:
                top.append("}")
            else:
                name, _, parts = stack.pop()
                inside = "".join(parts)
                if name is None:
                    font = FONT.match(inside)
                    if font:
                        self.kinds.add("latex")
                    inside = inside[font.end() :] if font else "{" + inside + "}"
                else:
                    self.kinds.add("latex")
                    inside = f" ({inside})" if name == "footnote" else inside
                stack[-1][2].append(inside)
        stack[-1][2].append(text[at:])
        return "".join(opening + "".join(parts) for _, opening, parts in stack)

    def _accent(self, m: re.Match) -> str:
        mark, letter = m.group(1) or m.group(3), m.group(2) or m.group(4) or m.group(5)
        return unicodedata.normalize("NFC", letter.replace("\\", "") + MARKS[mark])

    def _environments(self, text: str) -> str:
        """Environments become their content, innermost first; one pass with a stack of open ones. Ends without a beginning stay."""
        stack: list[tuple[str, str, list[str]]] = [("", "", [])]
        open_: Counter[str] = Counter()
        at = 0
        for m in ENVIRONMENT.finditer(text):
            stack[-1][2].append(text[at : m.start()])
            at = m.end()
            if m.group(1):
                stack.append((m.group(1), m.group(0), []))
                open_[m.group(1)] += 1
            elif not open_[m.group(3)]:
                stack[-1][2].append(m.group(0))
            else:
                while stack[-1][0] != m.group(3):  # begun inside and never ended
                    name, opening, parts = stack.pop()
                    open_[name] -= 1
                    stack[-1][2].append(opening + "".join(parts))
                name, _, parts = stack.pop()
                open_[name] -= 1
                self.kinds.add("latex")
                stack[-1][2].append(self._environment(name.rstrip("*"), "".join(parts)))
        stack[-1][2].append(text[at:])
        return "".join(opening + "".join(parts) for _, opening, parts in stack)

    def _environment(self, name: str, inside: str) -> str:
        if name in ("itemize", "enumerate", "description"):
            items = re.split(r"\\item\b(?:\[([^\]\n]{0,200})\])?", inside)[1:]
            lines = [" ".join(f"{label}: {x}".split() if label else x.split()) for label, x in zip(items[::2], items[1::2])]
            return "\n".join((f"{i}. " if name == "enumerate" else "- ") + x for i, x in enumerate(lines, 1))
        if name in ("tabular", "tabularx", "longtable", "array"):
            rows = re.split(r"\\\\(?:\[[^\]\n]{0,40}\])?|\\(?:hline|toprule|midrule|bottomrule)\b", inside)
            return "\n" + aligned([re.split(r"(?<!\\)&", r) for r in rows]) + "\n"
        if name in FORMULAS:
            return self._slot("$$\n" + inside.strip("\n") + "\n$$", True)
        if name in ("verbatim", "lstlisting", "minted"):
            return "\n" + self._slot("```\n" + inside.strip("\n") + "\n```", True) + "\n"
        return inside

    # ---- wiki

    def _wiki(self, text: str) -> str:
        if "{|" in text:
            text = self._wiki_tables(text)
        if "{{" in text:
            text = self._templates(text)
        if "[[" in text:
            text = self._note("wiki", WIKI_LINK, self._wiki_link, text)
        if "''" in text:
            text = self._note("wiki", QUOTES, r"\2", self._note("wiki", QUOTES, r"\2", text))
        if "=" in text:
            text = self._note("wiki", WIKI_HEADING, lambda m: "#" * len(m.group(1)) + " " + m.group(2), text)
        return text

    def _wiki_tables(self, text: str) -> str:
        ends = [(m.start(), m.end()) for m in TABLE_ENDS.finditer(text)]
        out, done = [], 0
        for m in TABLE_OPENS.finditer(text):
            i = bisect.bisect_left(ends, (m.end(), 0))
            if i == len(ends):
                break
            if m.start() >= done:
                self.kinds.add("wiki")
                out += [text[done : m.start()], self._wiki_table(text[m.end() : ends[i][0]])]
                done = ends[i][1]
        return "".join([*out, text[done:]])

    def _wiki_table(self, inside: str) -> str:
        rows: list[list[str]] = [[]]
        for line in inside.split("\n"):
            line = line.strip()
            if line.startswith("|-"):
                rows.append([])
            elif line.startswith("|+"):
                rows.insert(0, [line[2:]])
            elif line[:1] in ("|", "!"):
                for cell in re.split(r"\|\||!!", line[1:]):
                    # attributes before a single bar belong to the cell, not to its text
                    rows[-1].append(cell.rsplit("|", 1)[-1] if "[[" not in cell else cell)
            elif line and rows[-1]:
                rows[-1][-1] += " " + line
        return aligned(rows)

    def _templates(self, text: str) -> str:
        """Templates become their values, innermost first; one pass with a stack of open ones. One with single braces inside stays."""
        stack: list[tuple[list[str], bool]] = [([], False)]
        at = 0
        for m in TEMPLATE.finditer(text):
            stack[-1][0].append(text[at : m.start()])
            at = m.end()
            mark = m.group(0)
            if mark == "{{":
                stack.append(([], False))
            elif mark != "}}" or len(stack) == 1:
                stack[-1][0].append(mark)
                stack[-1] = (stack[-1][0], True)
            else:
                parts, braces = stack.pop()
                inside = "".join(parts)
                if braces:
                    stack[-1][0].append("{{" + inside + "}}")
                    stack[-1] = (stack[-1][0], True)
                else:
                    self.kinds.add("wiki")
                    stack[-1][0].append(self._template(inside))
        stack[-1][0].append(text[at:])
        return "{{".join("".join(parts) for parts, _ in stack)

    def _template(self, inside: str) -> str:
        parts = [p.strip() for p in inside.split("|")][1:]
        return "; ".join(re.sub(r"\s*=\s*", ": ", p, count=1) for p in parts if p) or inside.split("|")[0].strip()

    def _wiki_link(self, m: re.Match) -> str:
        parts = [p.strip() for p in m.group(1).split("|")]
        space = parts[0].split(":")[0].strip().lower() if ":" in parts[0] else ""
        if space in CATEGORIES:
            return ""
        if space in FILES or m.group(0)[0] == "!":
            return parts[-1] if len(parts) > 1 else parts[0].split(":")[-1]
        return parts[-1] or parts[0]

    # ---- Markdown

    def _markdown(self, text: str) -> str:
        if "|" in text and "-" in text:
            text = self._markdown_tables(text)
        if "](" in text:
            text = self._note("markdown", MD_LINK, lambda m: m.group(2), text)
        if "]:" in text:
            known = {m.group(1).lower() for m in MD_DEFINITION.finditer(text)}
            if known:
                text = self._note("markdown", MD_DEFINITION, "", text)
                text = MD_REFERENCE.sub(lambda m: m.group(2) if (m.group(3) or m.group(2)).lower() in known else m.group(0), text)
        if ">" in text:
            text = self._note("markdown", QUOTED, "", text)
        if "~~" in text:
            text = self._note("markdown", STRIKE, r"\1", text)
        if "*" in text:
            text = self._note("markdown", STARS, r"\2", self._note("markdown", STARS, r"\2", text))
        if "_" in text:
            text = self._note("markdown", UNDERLINES, r"\2", self._note("markdown", UNDERLINES, r"\2", text))
        return text

    def _markdown_tables(self, text: str) -> str:
        lines, out, i = text.split("\n"), [], 0
        while i < len(lines):
            if i + 1 < len(lines) and "|" in lines[i] and "|" in lines[i + 1] and MD_DELIMITER.match(lines[i + 1]):
                rows = [self._cells(lines[i])]
                i += 2
                while i < len(lines) and "|" in lines[i] and lines[i].strip():
                    rows.append(self._cells(lines[i]))
                    i += 1
                self.kinds.add("markdown")
                out.append(aligned(rows))
            else:
                out.append(lines[i])
                i += 1
        return "\n".join(out)

    def _cells(self, line: str) -> list[str]:
        return re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))

    # ---- HTML

    def _tag(self, m: re.Match) -> str:
        if m.group(2) and m.group(2).lower() not in NAMES:
            return m.group(0)
        self.kinds.add("html")
        self.tags.append(m)
        return f"\ue002{len(self.tags) - 1}\ue003"

    def _html(self, text: str) -> str:
        root = Element("", {})
        stack = [root]
        for part in TAG_SLOT.split(text):
            if part[:1] != "\ue002":
                if part:
                    stack[-1].children.append(part)
                continue
            m = self.tags[int(part[1:-1])]
            name = (m.group(2) or "").lower()
            if not name:
                continue
            if m.group(1):
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
                if at and not (name not in ("table", "td", "th") and any(e.name in ("td", "th") for e in stack[at + 1 :])):
                    del stack[at:]
                continue
            self._imply(stack, name)
            attributes = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(m.group(3) or "")}
            element = Element(name, attributes)
            stack[-1].children.append(element)
            if name not in VOID and not m.group(4) and len(stack) < DEPTH:
                stack.append(element)
        return self._flow(root, False, 0)

    def _imply(self, stack: list[Element], name: str) -> None:
        """End open elements that the start tag ``name`` ends, and open a row for a cell that stands alone."""
        if name in IMPLIED:
            ended, bounds = IMPLIED[name]
            last = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in bounds:
                    break
                if stack[i].name in ended:
                    last = i
            if last:
                del stack[last:]
            if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot") and len(stack) < DEPTH:
                row = Element("tr", {})
                stack[-1].children.append(row)
                stack.append(row)
        elif name in PARAGRAPH_ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    del stack[i:]
                    break
                if stack[i].name not in INLINE:
                    break

    def _entities(self, text: str) -> str:
        def one(m: re.Match) -> str:
            plain = html.unescape(m.group(0))
            if plain == m.group(0):
                return plain
            self.kinds.add("html")
            return " " if plain == "\xa0" else plain

        return ENTITY.sub(one, text) if "&" in text else text

    def _flow(self, element: Element, inside: bool, level: int) -> str:
        """Text of an element's children; ``inside`` a block, white space is collapsed."""
        out = ""
        for child in element.children:
            if isinstance(child, str):
                part = self._entities(re.sub(r"\s+", " ", child) if inside else child)
                out += part.lstrip(" ") if inside and (not out or out[-1] in " \n") else part
            elif child.seen:
                out = self._placed(out, child, inside, level)
        return out

    def _placed(self, out: str, e: Element, inside: bool, level: int) -> str:
        name = e.name
        if name == "br":
            return out.rstrip(" ") + "\n"
        if name == "img":
            return out + e.attributes.get("alt", "")
        if name == "input":
            return out + (e.attributes.get("value", "") if e.attributes.get("type", "text").lower() != "hidden" else "")
        if name == "hr":
            return out.rstrip(" \n") + "\n\n"
        if name == "code" and not inside:
            return out + self._flow(e, True, level)
        if name in INLINE or name in VOID:
            return out + self._flow(e, inside, level)
        if name == "pre":
            return self._block(out, "```\n" + self._raw(e).strip("\n") + "\n```", 2)
        if name == "table":
            return self._block(out, self._table(e, level), 2)
        if name in ("ul", "ol", "menu"):
            return self._block(out, self._list(e, level), 1 if level else 2)
        if name[0] == "h" and name[1:].isdigit():
            return self._block(out, "#" * int(name[1:]) + " " + self._flow(e, True, level).strip(), 2)
        if name == "li":
            return self._block(out, "- " + self._flow(e, True, level).strip(), 1)
        gap = 2 if name in ("p", "blockquote", "figure", "dl", "fieldset") else 1
        return self._block(out, self._flow(e, True, level).strip(), gap)

    def _block(self, out: str, content: str, gap: int) -> str:
        if not content.strip():
            return out
        out = out.rstrip(" ")
        while out and not out.endswith("\n" * gap):
            out += "\n"
        return out + content + "\n" * gap

    def _raw(self, e: Element) -> str:
        return "".join(self._entities(c) if isinstance(c, str) else ("\n" if c.name == "br" else self._raw(c) if c.seen else "") for c in e.children)

    def _list(self, e: Element, level: int) -> str:
        lines, n = [], 0
        for child in e.children:
            if isinstance(child, str):
                if child.strip():
                    lines.append("  " * level + self._entities(" ".join(child.split())))
            elif child.seen and child.name == "li":
                n += 1
                text = self._flow(child, True, level + 1).strip()
                first, _, rest = text.partition("\n")
                lines.append("  " * level + (f"{n}. " if e.name == "ol" else "- ") + first + ("\n" + rest if rest else ""))
            elif child.seen:
                lines.append(self._placed("", child, True, level + 1).strip("\n"))
        return "\n".join(lines)

    def _table(self, e: Element, level: int) -> str:
        rows: list[list[str]] = []
        extra: list[str] = []
        below: dict[int, int] = {}  # columns that a cell of an earlier row reaches down into, and for how many rows

        def span(d: Element, name: str) -> int:
            text = d.attributes.get(name, "").strip()
            return min(int(text), SPAN) if text.isascii() and text.isdigit() and int(text) else 1

        def row(x: Element) -> None:
            cells: list[str] = []

            def skip() -> None:
                while below.get(len(cells), 0):
                    below[len(cells)] -= 1
                    cells.append("")

            for d in x.children:
                if isinstance(d, Element) and d.name in ("td", "th"):
                    if not d.seen:
                        continue
                    skip()
                    deep, wide = span(d, "rowspan"), span(d, "colspan")
                    for k in range(wide):
                        if deep > 1:
                            below[len(cells)] = deep - 1
                        cells.append("" if k else self._flow(d, True, level).replace("\n", " "))
                elif t := self._loose(d, level):
                    extra.append(t)
            while any(n and at >= len(cells) for at, n in below.items()):
                if below.get(len(cells), 0):
                    skip()
                else:
                    cells.append("")
            rows.append(cells)

        def visit(x: Element) -> None:
            for c in x.children:
                if isinstance(c, str):
                    if c.strip():
                        extra.append(self._entities(" ".join(c.split())))
                elif not c.seen:
                    continue
                elif c.name == "tr":
                    row(c)
                elif c.name in ("thead", "tbody", "tfoot", "table"):
                    visit(c)
                else:
                    extra.append(self._flow(c, True, level).strip())

        visit(e)
        return "\n".join([*[x for x in extra if x], *([t] if (t := aligned(rows)) else [])])

    def _loose(self, d: Element | str, level: int) -> str:
        """Text between a row's cells, which is shown before the table."""
        if isinstance(d, str):
            return self._entities(" ".join(d.split()))
        return self._flow(d, True, level).strip() if d.seen else ""


def rendered(df: DataFrame, id_col: str = "id", text_col: str = "content_full") -> DataFrame:
    """(id, text, kinds): each row's clean text and the sorted kinds of markup it had.

    Kinds are html, wiki, latex and markdown. Code, formulas, file paths, addresses, amounts, identifiers and
    arithmetic are left as they are and are no markup; list marks stay. A null text gives null and no kinds, an empty
    one stays empty; repeated rows give repeated results. Row by row, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kinds = [], []
            for x in values(b.column(1)):
                r = Rendering(x) if x is not None else None
                texts.append(r.text if r else None)
                kinds.append(sorted(r.kinds) if r else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["id", "text", "kinds"])

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id string, text string, kinds array<string>")
