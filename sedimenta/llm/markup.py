"""Markup residue in text documents: what notation a text uses, and its clean text.

Code blocks are set aside first, so their content is never read as markup.  The
rest is streamed through the standard library's HTML parser; its events give
lines with their text and the number of tags in them.  Lines whose text-to-tag
ratio, smoothed with a Gaussian, falls below a threshold and that carry nothing
but links are left out as navigation; all other lines are content.  Markdown,
wiki and LaTeX are turned into the same plain structure: headings as ``#``
lines, lists as ``-`` lines, code between fences, formulas in ``$``.
"""

from __future__ import annotations

import math
import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements of HTML.
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes noscript object ol optgroup option output p param picture pre progress "
    "q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time "
    "title tr track tt u ul var video wbr".split()
)
_BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,30}));")
_SINGLE = frozenset("a b i p q s u".split())

# Code blocks of every notation, leftmost first; the named group tells which.
CODE = re.compile(
    r"(?P<md_fence>^[ \t]*(?P<f>`{3,}|~{3,})[^\n`]*\n(?P<md_body>.*?)(?:^[ \t]*(?P=f)[`~]*[ \t]*(?=\n|<|$)|\Z))"
    r"|(?P<html_pre><pre\b[^<>]*>(?P<pre_body>.*?)</pre\s*>)"
    r"|(?P<html_code><(?P<ct>code|kbd|samp|tt)\b[^<>]*>(?P<code_body>.*?)</(?P=ct)\s*>)"
    r"|(?P<wiki_block><(?P<wt>syntaxhighlight|nowiki|source)\b[^<>]*>(?P<wiki_body>.*?)</(?P=wt)\s*>)"
    r"|(?P<wiki_inline>\{\{\s*(?:code|tt|mono|kbd|var|pre)\s*\|(?P<wi_body>[^{}\n]*)\}\})"
    r"|(?P<tex_block>\\begin\{(?P<env>verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]]*\])?(?P<tex_body>.*?)\\end\{(?P=env)\})"
    r"|(?P<tex_inline>\\(?:texttt|lstinline|code|mintinline)\{(?P<ti_body>(?:[^{}\n]|\\.|\{[^{}\n]*\})*)\}|\\(?:verb|lstinline)\*?(?P<vd>[^\sA-Za-z*{])(?P<v_body>[^\n]*?)(?P=vd))"
    r"|(?P<md_inline>(?<![`\\])(?P<t>`{1,2})(?!`)(?P<mi_body>[^`\n]+(?:`[^`\n]+)*?)(?P=t)(?!`))",
    re.DOTALL | re.MULTILINE | re.IGNORECASE,
)
_MAY_CODE = re.compile(r"`|~~~|<(?:pre|code|kbd|samp|tt|syntaxhighlight|nowiki|source)\b|\{\{|\\(?:begin|texttt|verb|lstinline|code|mint)", re.IGNORECASE)
_KIND = {"md_fence": "markdown", "md_inline": "markdown", "html_pre": "html", "html_code": "html", "wiki_block": "wiki", "wiki_inline": "wiki", "tex_block": "latex", "tex_inline": "latex"}
_BODY = {"md_fence": "md_body", "md_inline": "mi_body", "html_pre": "pre_body", "html_code": "code_body", "wiki_block": "wiki_body", "wiki_inline": "wi_body", "tex_block": "tex_body", "tex_inline": "ti_body"}
_INLINE = frozenset({"md_inline", "html_code", "wiki_inline", "tex_inline"})
#: Private-use characters that hold the place of a piece set aside.
_OPEN, _CLOSE, _HEAD = "\ue000", "\ue001", "\ue002"
_PRIVATE = re.compile("[\ue000-\ue005]")
_HELD = re.compile(f"{_OPEN}(\\d+){_CLOSE}")

_DUNDER = r"(?:init|main|name|file|all|dict|str|repr|call|iter|next|len|doc|class|new|del|enter|exit|getitem|setitem|eq|hash|slots|version|author|path|module)"
_BEFORE, _AFTER = r"(?<![\w*\\/_])", r"(?![\w*/])"
MARKDOWN = re.compile(
    r"(?P<h>^[ ]{0,3}(?P<hm>#{1,6})[ \t]+(?P<ht>\S[^\n]*?)[ \t#]*$)"
    r"|(?P<setext>^(?P<st>[^\s#>|\-=*][^\n]*)\n[ ]{0,3}(?P<sm>={3,}|-{3,})[ \t]*$)"
    r"|(?P<quote>^[ ]{0,3}>[ \t]?(?P<qt>\S[^\n]*)$)"
    r"|(?P<table>^[ \t]*\|?(?:[ \t]*:?-{2,}:?[ \t]*\|)+(?:[ \t]*:?-{2,}:?[ \t]*)?\|?[ \t]*$)"
    r"|(?P<refdef>^[ ]{0,3}\[[^\]\n]{1,60}\]:[ \t]*<?(?:https?://|/|www\.|mailto:|\#)\S+[^\n]*$)"
    r"|(?P<image>!\[(?P<it>[^\]\n]*)\](?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|\[[^\]\n]*\]))"
    r"|(?P<link>(?<![\w\]!\\])\[(?P<lt>(?:[^\[\]\n]|\[[^\[\]\n]*\])+)\](?:\((?:<[^<>\n]*>|[^\s()<>]+(?:\([^\s()]*\))?)(?:[ \t]+[\"'(][^\n)]*)?\)|\[[^\]\n]{0,60}\]))"
    r"|(?P<auto><(?:https?://|mailto:)[^\s<>]+>)"
    rf"|(?P<strong>{_BEFORE}(?P<sd>\*\*\*|\*\*)(?=\S)(?P<sx>[^\n]{{1,5000}}?)(?<=\S)(?P=sd){_AFTER})"
    rf"|(?P<strong2>{_BEFORE}__(?!{_DUNDER}__)(?=[^\s_])(?P<sy>[^\n]{{1,5000}}?)(?<=[^\s_])__(?!\w))"
    rf"|(?P<em>{_BEFORE}\*(?=[^\s*])(?P<ex>[^*\n]+?)(?<=[^\s*])\*{_AFTER})"
    rf"|(?P<em2>{_BEFORE}_(?=[^\s_])(?P<ey>[^_\n]+?)(?<=[^\s_])_(?!\w))"
    r"|(?P<strike>~~(?=\S)(?P<sk>[^~\n]+?)(?<=\S)~~)",
    re.MULTILINE,
)
WIKI = re.compile(
    r"(?P<h>^(?P<hm>={1,6})[ \t]*(?P<ht>[^=\s][^\n]*?)[ \t]*(?P=hm)[ \t]*$)"
    r"|(?P<table>^[ \t]*(?:\{\|[^\n]*|\|\}|\|-(?:[ \t][^\n|]*)?)$)"
    r"|(?P<file>\[\[(?:File|Image|Media|Datei|Fichier|Archivo):(?P<ft>[^\[\]\n]*)\]\])"
    r"|(?P<link>(?<![\w\]\[])\[\[(?![\s\d\-+.,\"'\[])(?P<lt>[^\[\]{}\n|]+)(?:\|(?P<la>[^\[\]\n]*))?\]\](?!\]))"
    r"|(?P<ext>(?<![\w\]\[!])\[(?:https?:|ftp:|mailto:)?//[^\s\[\]]+[ \t]+(?P<et>[^\[\]\n]+)\](?!\())"
    r"|(?P<template>(?<![{$#\w])\{\{(?:[#:]?[A-Za-z][\w \-/:.]*(?:\|[^{}]*)|(?:[Rr]eflist|[Cc]lear|TOC|toc|[Cc]itation needed|[Ss]tub|[Uu]nsigned|PAGENAME|[Cc]n))\}\}(?!\}))"
    r"|(?P<bold>(?<![\w'])'''(?=[^\s'])(?P<bx>[^\n]{1,5000}?)(?<=[^\s'])'''(?!['\w]))"
    r"|(?P<ital>(?<![\w'])''(?=[^\s'])(?P<ix>[^'\n](?:[^\n]{0,5000}?[^\s'])?)''(?!['\w]))"
    r"|(?P<tag><(?:ref|references|gallery|math|includeonly|noinclude|onlyinclude|poem)\b[^<>]*/?>|</(?:ref|gallery|math|includeonly|noinclude|poem)>|^(?:__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION)__)|\[\[(?:Category|Kategorie|Catégorie|Categoría):[^\[\]\n]*\]\])",
    re.MULTILINE,
)
# The same beside a table, with its rows.
WIKI_TABLE = re.compile(r"(?P<row>^[ \t]*[|!](?![}\-+|])(?P<rx>[^\n]*)$)|" + WIKI.pattern, re.MULTILINE)
_DOLLAR = r"(?<![\w\\$])\$(?=[^\s$])(?!\d+(?:[.,]\d+)?(?:\s|$))(?P<dm>(?:[^$\n\\]|\\.)*?)(?<=[^\s\\])\$(?![\w$])"
LATEX = re.compile(
    r"(?P<display>\$\$(?=[^$])(?P<dd>.+?)\$\$|\\\[(?P<db>.+?)\\\]|\\\((?P<dp>.+?)\\\))"
    r"|(?P<mathenv>\\begin\{(?P<me>equation|align|alignat|gather|multline|eqnarray|displaymath|math|flalign|split)(?P<ms>\*?)\}(?P<mx>.*?)\\end\{(?P=me)(?P=ms)\})"
    r"|(?P<tabular>\\begin\{(?P<te>tabular[xy]?|longtable|array)\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*(?P<tb>.*?)\\end\{(?P=te)\*?\})"
    r"|(?P<env>\\(?P<eb>begin|end)\{(?P<en>[A-Za-z]+)\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?)"
    r"|(?P<sect>\\(?P<sl>part|chapter|section|subsection|subsubsection|paragraph)\*?\{(?P<sx>[^{}\n]*)\})"
    r"|(?P<item>\\item\b[ \t]*)"
    r"|(?P<wrap>\\(?:textbf|textit|textsc|textsl|textrm|textsf|emph|underline|text|mbox|caption|title|footnote)\{(?P<wx>(?:[^{}]|\{[^{}]*\})*)\})"
    r"|(?P<href>\\href\{[^{}\n]*\}\{(?P<hx>[^{}\n]*)\})"
    r"|(?P<cmd>\\(?P<cn>url|ref|eqref|cite[pt]?|label|includegraphics|usepackage|documentclass|input|include|bibliography|newcommand|renewcommand|frac|sqrt|mathrm|mathbf|mathbb|mathcal|hat|bar|vec|operatorname|color|textcolor|hspace|vspace|centering|hline|maketitle|noindent|newpage|LaTeX|TeX|ldots|dots|alpha|beta|gamma|delta|epsilon|lambda|sigma|theta|sum|int|prod|infty|nabla|partial|cdot|times|leq?|geq?|neq?|approx|rightarrow|to|in|log|exp|lim)(?![A-Za-z])(?:\*?(?:\[[^\]\n]*\])?(?:\{(?:[^{}\n]|\{[^{}\n]*\})*\})*))"
    rf"|(?P<dollar>{_DOLLAR})",
    re.DOTALL,
)
_FORMULA = re.compile(r"[\\^_{}=<>]|^[A-Za-z]$|^[A-Za-z]\([^()]*\)$|^[A-Za-z0-9 ]+[+\-*/][A-Za-z0-9 ]+$")
_MATH_ONLY = re.compile(r"^[^A-Za-z]*(?:[A-Za-z]{1,2}[^A-Za-z]+)*[A-Za-z]{0,2}$")


# What ends the content of an element whose content is no text, as the parser sees it.
_HIDDEN = {t: re.compile(rf"</\s*{t}\s*>", re.IGNORECASE) for t in ("script", "style")}


class _Events(HTMLParser):
    """Lines of text with their tags, out of parser events; unknown tags stay text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.lines: list[list] = [["", 0, 0, False, 0]]  # text, tags, characters inside links, structure, links
        self.html = False
        self.links = 0
        self.skip = 0
        self.lists: list[int | None] = []  # of each open list the number of its last item, None if it has none
        self.at = 0  # where the tag at hand starts
        self.never_closed: set[str] = set()  # from here on
        self.referred: dict[str, bool] = {}  # whether a reference stands in the text with its semicolon

    def parse_starttag(self, i: int) -> int:
        self.at = i
        return super().parse_starttag(i)

    def set_cdata_mode(self, elem: str, **more: bool) -> None:
        if self.skip or elem not in _HIDDEN:  # else it is not closed and what follows is text
            super().set_cdata_mode(elem, **more)

    def _closed(self, tag: str) -> bool:
        if tag not in self.never_closed and not _HIDDEN[tag].search(self.rawdata, self.at):
            self.never_closed.add(tag)
        return tag not in self.never_closed

    def _text(self, s: str) -> None:
        if self.skip:
            return
        first, *more = s.split("\n")
        self._add(first)
        for part in more:
            self.lines.append(["", 0, 0, False, 0])
            self._add(part)

    def _add(self, s: str) -> None:
        line = self.lines[-1]
        line[0] += s
        if self.links:
            line[2] += len(s)

    def _break(self, prefix: str = "") -> None:
        if self.lines[-1][0].strip():
            self.lines.append(["", 0, 0, False, 0])
        if prefix:
            self.lines[-1][0] = prefix
            self.lines[-1][3] = True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        raw = self.get_starttag_text() or ""
        if tag not in ELEMENTS or (tag in _SINGLE and not self._paired(tag, raw)) or (tag in _HIDDEN and not self._closed(tag)):
            self._text(raw)
            return
        self.html = True
        self.lines[-1][1] += 1
        if tag in _HIDDEN:
            self.skip += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self._break(_HEAD * int(tag[1]) + " ")
        elif tag in ("ol", "ul", "menu", "dir"):
            self._break()
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            self._break(f"{self.lists[-1]}. " if self.lists and self.lists[-1] else "- ")
        elif tag == "blockquote":
            self._break()
        elif tag == "img":
            self._text(dict(attrs).get("alt") or "")
        elif tag in ("td", "th"):
            self._text(" | " if self.lines[-1][0].strip() else "")
        elif tag in _BLOCKS:
            self._break()
        elif tag == "a":
            self.links += 1
            self.lines[-1][4] += 1

    def _paired(self, tag: str, raw: str) -> bool:
        at = self.rawdata.lower()
        return f"</{tag}>" in at or "=" in raw or (tag == "p" and raw.lower() == "<p>")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:  # it has no content
            self.html = True
            self.lines[-1][1] += 1
            return
        self.handle_starttag(tag, attrs)
        if tag == "a":
            self.links = max(0, self.links - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag not in ELEMENTS:
            self._text(f"</{tag}>")
            return
        self.html = True
        self.lines[-1][1] += 1
        if tag in _HIDDEN:
            self.skip = max(0, self.skip - 1)
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in ("ol", "ul", "menu", "dir"):
            self._break()
            if self.lists:
                self.lists.pop()
        elif tag in _BLOCKS and tag not in ("td", "th"):
            self._break()

    def handle_data(self, data: str) -> None:
        self._text(data)

    def handle_entityref(self, name: str) -> None:
        self._reference(f"&{name};", f"{name};" in html5)

    def handle_charref(self, name: str) -> None:
        self._reference(f"&#{name};", True)

    def _reference(self, raw: str, known: bool) -> None:
        # the parser also takes references without a semicolon; those are plain text
        if raw not in self.referred:
            self.referred[raw] = raw in self.rawdata
        known = known and self.referred[raw]
        self.html = self.html or known
        self._text(unescape(raw) if known else raw if self.referred[raw] else raw.rstrip(";"))

    def handle_comment(self, data: str) -> None:
        self.html = True

    def handle_decl(self, decl: str) -> None:
        if decl.lower().startswith("doctype"):
            self.html = True
        else:
            self._text(f"<!{decl}>")

    def unknown_decl(self, data: str) -> None:
        self._text(f"<![{data}]>")

    def handle_pi(self, data: str) -> None:
        self._text(f"<?{data}>")


def content_lines(lines: list[list], *, sigma: float = 1.0, factor: float = 0.5) -> list[str]:
    """Lines of content regions: smoothed text-to-tag ratio at or above the threshold.

    The threshold is ``factor`` times the standard deviation of the ratios, at
    most their mean.  Below it a line still is content if it has structure, if
    most of its text is outside links, or if it is a link by itself: navigation
    comes as several links in a row.
    """
    if not any(line[2] for line in lines):
        return [line[0] for line in lines]
    ratio = [len(line[0].strip()) / (1 + line[1]) for line in lines]
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    smooth = []
    for i in range(len(ratio)):
        near = [(w, ratio[i + k]) for k, w in zip(range(-reach, reach + 1), kernel, strict=True) if 0 <= i + k < len(ratio)]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    threshold = min(mean, factor * math.sqrt(sum((r - mean) ** 2 for r in smooth) / len(smooth)))
    linked = [not line[3] and line[2] > 0 and 2 * line[2] >= sum(c.isalnum() for c in line[0]) for line in lines]
    filled = [i for i, line in enumerate(lines) if line[0].strip()]
    in_row = {i for p, i in enumerate(filled) if linked[i] and (lines[i][4] > 1 or (p and linked[filled[p - 1]]) or (p + 1 < len(filled) and linked[filled[p + 1]]))}
    out = []
    for i, (line, r, own) in enumerate(zip(lines, smooth, ratio, strict=True)):
        # smoothing alone would lift a row of links beside long paragraphs
        if min(r, 4 * own) >= threshold or line[3] or i not in in_row or _OPEN in line[0]:
            out.append(line[0])
    return out


#: Marks around the text of links of Markdown and wiki, until regions are told apart.
_LINK, _END = "\ue003", "\ue004"
_STRUCTURE = re.compile(rf"[ \t]*(?:{_HEAD}|[-*+][ \t]|\d+[.)][ \t]|[|!]|{_OPEN})")


def _regions(text: str) -> str:
    """Content regions of text whose links come from Markdown or wiki: each link is a tag."""
    if _LINK not in text:
        return text
    lines = []
    for line in text.split("\n"):
        inside = sum(len(p.partition(_END)[0]) for p in line.split(_LINK)[1:])
        n = line.count(_LINK)
        lines.append([line.replace(_LINK, "").replace(_END, ""), 2 * n, inside, _STRUCTURE.match(line) is not None, n])
    return "\n".join(content_lines(lines))


#: Breaks an opening that nothing closes, so that its pattern does not look for the end again and again; taken out afterwards.
_MASK = "\ue005"
_CODE_PAIRS = [(f"<{t}", f"</{t}") for t in ("pre", "code", "kbd", "samp", "tt", "syntaxhighlight", "nowiki", "source")]
_CODE_PAIRS += [(f"\\begin{{{t}}}", f"\\end{{{t}}}") for t in ("verbatim", "verbatim*", "lstlisting", "minted", "alltt")]
_MATH = "equation align alignat gather multline eqnarray displaymath math flalign split".split()
_TEX_PAIRS = [("\\[", "\\]"), ("\\(", "\\)")] + [(f"\\begin{{{t}{s}}}", f"\\end{{{t}{s}}}") for t in _MATH for s in ("", "*")] + [(f"\\begin{{{t}", f"\\end{{{t}") for t in ("tabular", "longtable", "array")]
#: Shorter texts are read as they are: the result is the same, and the patterns are fast enough.
_LONG = 10_000


def _without_unclosed(text: str, pairs: list[tuple[str, str]]) -> str:
    """The text with those openings masked after which their end never comes."""
    if len(text) < _LONG:
        return text
    low, places = text.lower(), []
    if len(low) != len(text):  # some letter changes its length, so places would not fit
        return text
    for opening, end in pairs:
        at = low.find(opening, low.rfind(end) + 1)
        while at >= 0:
            places.append(at + 1)
            at = low.find(opening, at + 1)
    if not places:
        return text
    cuts = [0, *sorted(set(places)), len(text)]
    return _MASK.join(text[a:b] for a, b in zip(cuts, cuts[1:], strict=False))


def _hold(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with its code set aside, and the pieces as (group, content)."""
    held: list[tuple[str, str]] = []
    if not _MAY_CODE.search(text):
        return text, held
    text = _without_unclosed(text, _CODE_PAIRS)

    def take(m: re.Match) -> str:
        group = next(g for g in _KIND if m.group(g) is not None)
        body = m.group(_BODY[group])
        if body is None:
            body = m.group("v_body") or ""
        if group == "html_pre":
            body = re.sub(r"^\s*<code\b[^<>]*>|</code\s*>\s*$", "", body, flags=re.IGNORECASE)
        if group.startswith("html"):
            body = unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", body))
        held.append((group, body.replace(_MASK, "")))
        mark = f"{_OPEN}{len(held) - 1}{_CLOSE}"
        return mark if group in _INLINE else f"\n{mark}\n" if group != "md_fence" else f"{mark}\n"

    return CODE.sub(take, text).replace(_MASK, ""), held


def _is_formula(body: str) -> bool:
    return _FORMULA.search(body.strip()) is not None


def analyse(text: str | None, clean: bool = True) -> tuple[str | None, list[str]]:
    """(clean text, kinds of markup) of a text; the text is None where not asked for or null."""
    if text is None:
        return None, []
    src = _PRIVATE.sub("", text)
    src, held = _hold(src)
    kinds = {_KIND[g] for g, _ in held}
    if "<" in src or "&" in src:
        # notations that look like tags or hold references are kept from the parser
        auto = MARKDOWN_AUTO.sub(lambda m: (kinds.add("markdown"), m.group(1))[1], src)
        ev = _Events()
        ev.feed(auto)
        ev.close()
        if ev.html:
            kinds.add("html")
        lines = content_lines(ev.lines) if clean else [line[0] for line in ev.lines]
        src = "\n".join(lines)
        if "<" in src and WIKI_TAG.search(src):
            kinds.add("wiki")
    out = src
    if "$" in out or "\\" in out:
        n = len(held)
        out = LATEX.sub(_Latex(kinds, held), _without_unclosed(out, _TEX_PAIRS)).replace(_MASK, "")
        held[n:] = [(g, body.replace(_MASK, "")) for g, body in held[n:]]
        if clean and len(held) > 1:
            out = _joined(out, held)
    if "'" in out or "[" in out or "=" in out or "{" in out:
        tables = "{|" in out  # rows are only told from other lines inside a table
        out = (WIKI_TABLE if tables else WIKI).sub(lambda m: _wiki(m, kinds), out)
        if tables:  # rules between rows leave no blank lines
            out = re.sub(r"^(\|[^\n]*)\n\n(?=\| )", r"\1\n", out, flags=re.MULTILINE)
    if _MAY_MARKDOWN.search(out):
        out = MARKDOWN.sub(lambda m: _markdown(m, kinds), out)
    if not clean:
        return None, sorted(kinds)
    return _render(_regions(out), held), sorted(kinds)


MARKDOWN_AUTO = re.compile(r"<((?:https?://|mailto:)[^\s<>]+)>(?!\))")
WIKI_TAG = re.compile(r"</?(?:ref|references|gallery|math|nowiki|syntaxhighlight|includeonly|noinclude)\b[^<>]*>")
_MAY_MARKDOWN = re.compile(r"[*_\[~>#|]|^(?:=|-){3,}", re.MULTILINE)


# Commands whose argument is text to keep, and commands that stand for nothing in the text; the others are formulas.
_SHOWN = frozenset("url ref eqref cite citep citet textcolor color".split())
_SILENT = frozenset("label includegraphics usepackage documentclass input include bibliography newcommand renewcommand hspace vspace centering hline maketitle noindent newpage".split())
_WORDS = {"LaTeX": "LaTeX", "TeX": "TeX", "ldots": "...", "dots": "..."}
_LATEX_KINDS = ("display", "mathenv", "tabular", "env", "sect", "item", "wrap", "href", "cmd", "dollar")


class _Latex:
    """Structure out of LaTeX events in the order of the text: lists know their kind, formulas are set aside whole."""

    def __init__(self, kinds: set, held: list) -> None:
        self.kinds, self.held = kinds, held
        self.lists: list[int | None] = []

    def hold(self, group: str, body: str) -> str:
        self.held.append((group, body))
        return f"{_OPEN}{len(self.held) - 1}{_CLOSE}"

    def __call__(self, m: re.Match) -> str:
        g = next(k for k in _LATEX_KINDS if m.group(k) is not None)
        if g == "dollar" and not _is_formula(m.group("dm")):
            return m.group()
        self.kinds.add("latex")
        return getattr(self, g)(m)

    def dollar(self, m: re.Match) -> str:
        return self.hold("formula", m.group("dm"))

    def display(self, m: re.Match) -> str:
        return self.hold("formula", (m.group("dd") or m.group("db") or m.group("dp")).strip())

    def mathenv(self, m: re.Match) -> str:
        body = re.sub(r"\\(?:label\{[^{}]*\}|nonumber|notag)", "", m.group("mx"))
        return self.hold("display", " ".join(body.split()))

    def tabular(self, m: re.Match) -> str:
        rows = [re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^{}]*\})", "", r) for r in re.split(r"\\\\(?:\[[^\]]*\])?", m.group("tb"))]
        cells = [[LATEX.sub(self, " ".join(c.split())) for c in re.split(r"(?<!\\)&", r)] for r in rows]
        return "\n" + "\n".join(" | ".join(c) for c in cells if any(c)) + "\n"

    def env(self, m: re.Match) -> str:
        if m.group("en") in ("enumerate", "itemize", "description"):
            if m.group("eb") == "begin":
                self.lists.append(0 if m.group("en") == "enumerate" else None)
            elif self.lists:
                self.lists.pop()
        return ""

    def item(self, m: re.Match) -> str:
        if self.lists and self.lists[-1] is not None:
            self.lists[-1] += 1
            return f"{self.lists[-1]}. "
        return "- "

    def sect(self, m: re.Match) -> str:
        level = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}[m.group("sl")]
        return _HEAD * level + " " + m.group("sx")

    def wrap(self, m: re.Match) -> str:
        return m.group("wx")

    def href(self, m: re.Match) -> str:
        return m.group("hx")

    def cmd(self, m: re.Match) -> str:
        name = m.group("cn")
        if name in _SILENT:
            return ""
        if name in _WORDS:
            return _WORDS[name]
        if name in _SHOWN:
            shown = re.findall(r"\{([^{}]*)\}", m.group())
            return shown[-1] if shown else ""
        return self.hold("formula", m.group().strip())


#: Formulas with nothing but blanks, signs and single letters between them are one.
_NEIGHBOURS = re.compile(rf"{_OPEN}\d+{_CLOSE}(?:[ ]*(?:[-+*/=<>^_,]|[A-Za-z0-9](?![\w])|)[ ]*{_OPEN}\d+{_CLOSE})+")


def _joined(text: str, held: list[tuple[str, str]]) -> str:
    """Commands of one formula that stand in running text, put together."""

    def join(m: re.Match) -> str:
        if any(held[int(i)][0] != "formula" for i in _HELD.findall(m.group())):
            return m.group()
        held.append(("formula", _HELD.sub(lambda x: held[int(x.group(1))][1], m.group())))
        return f"{_OPEN}{len(held) - 1}{_CLOSE}"

    return _NEIGHBOURS.sub(join, text)


def _wiki(m: re.Match, kinds: set) -> str:
    kinds.add("wiki")
    if m.group("h"):
        return _HEAD * len(m.group("hm")) + " " + m.group("ht")
    if m.group("file"):
        return m.group("ft").rpartition("|")[2]
    if m.group("link"):
        return f"{_LINK}{m.group('la') or m.group('lt')}{_END}"
    if m.group("template"):
        # what a template shows are its parameters
        return " ".join(p.rpartition("=")[2].strip() for p in m.group()[2:-2].split("|")[1:])
    if "row" in m.re.groupindex and m.group("row"):
        return "| " + re.sub(r"[ \t]*(?:!!|\|\|)[ \t]*", " | ", m.group("rx").strip())
    return m.group("et") or m.group("bx") or m.group("ix") or ""


def _markdown(m: re.Match, kinds: set) -> str:
    kinds.add("markdown")
    if m.group("h"):
        return _HEAD * len(m.group("hm")) + " " + m.group("ht")
    if m.group("table"):
        return m.group()  # its rows are kept as they are
    if m.group("setext"):
        return (_HEAD if m.group("sm")[0] == "=" else 2 * _HEAD) + " " + m.group("st")
    if m.group("auto"):
        return m.group()[1:-1]
    if m.group("link"):
        return f"{_LINK}{m.group('lt')}{_END}"
    return next((x for k in ("qt", "it", "lt", "sx", "sy", "ex", "ey", "sk") if (x := m.group(k)) is not None), "")


def _render(out: str, held: list[tuple[str, str]]) -> str:
    def back(m: re.Match) -> str:
        group, body = held[int(m.group(1))]
        if group in ("formula", "display"):
            return f"${body}$" if group == "formula" else f"$${body}$$"
        return f"`{body.strip()}`" if group in _INLINE else f"```\n{body.strip(chr(10))}\n```"

    plain = re.sub(r"[ \t]+(?=\n|$)", "", out.replace(_HEAD, "#"))
    plain = re.sub(r"\n{3,}", "\n\n", plain).strip()
    for _ in range(3):  # a piece may hold another
        if not _HELD.search(plain):
            break
        plain = _HELD.sub(back, plain)
    return plain


RESULT = "clean string, markup array<string>"


def analysed(text: Column, clean: bool = True) -> Column:
    """struct(clean, markup) of a text column; null gives a null text and no markup.

    Empty texts have no markup.  Texts of any length are read whole, in time
    that grows with their length.  Broken markup (unclosed tags, fences, braces)
    is plain text where it is, and so is emphasis that does not end within 5,000
    characters of its line.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([analyse(t, clean) for t in texts], columns=["clean", "markup"])

    return F.pandas_udf(run, RESULT)(text)
