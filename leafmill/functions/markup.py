"""HTML fragments: whitelist filter, markdown subset, well-formedness. Trees have no built-in form, so these run in Arrow batches."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd

from .batches import on_batches

# ---- fixed values: what content documents may hold
ALLOWED_TAGS = frozenset(
    "html head title meta link style body h1 h2 h3 h4 h5 h6 p div span section nav article aside header footer figure figcaption a em strong b i u s small sub sup br hr abbr cite q dfn kbd samp var time mark ins del"
    " ul ol li dl dt dd blockquote pre code table caption thead tbody tfoot tr th td img details summary".split()
)
PARENTS = {
    "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr"}, "th": {"tr"},
    "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "caption": {"table"},
}
GLOBAL_ATTRIBUTES = frozenset("id class title lang dir style role".split())
TAG_ATTRIBUTES = {
    "a": {"href", "rel"}, "img": {"src", "alt", "width", "height"}, "link": {"href", "rel", "type", "media"}, "meta": {"name", "content", "charset", "http-equiv"},
    "th": {"colspan", "rowspan", "scope"}, "td": {"colspan", "rowspan"}, "ol": {"start", "type"}, "time": {"datetime"},
}
NAMESPACED = frozenset({"xml:lang", "xml:space", "epub:type", "epub:prefix"})
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
REFERENCE_ATTRIBUTES = ("src", "href", "poster", "data")


class _Tree(HTMLParser):
    """A lenient tree: nodes are [name, attributes, children], children are nodes, strings or None for a comment."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["div", [], []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, [(k, v or "") for k, v in attrs], []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, [(k, v or "") for k, v in attrs], []])

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)

    def handle_comment(self, data):
        self.open[-1][2].append(None)

    handle_pi = handle_decl = unknown_decl = handle_comment


def parse(fragment: str) -> list:
    tree = _Tree()
    tree.feed(fragment)
    tree.close()
    return tree.root


def attribute_allowed(tag: str, name: str) -> bool:
    return name in GLOBAL_ATTRIBUTES or name in TAG_ATTRIBUTES.get(tag, ()) or name in NAMESPACED or name.startswith(("aria-", "data-"))


def sanitized(root: list, images: frozenset | None) -> int:
    """Filters a tree in place and returns the number of changes.

    The verdict on a node looks at its parent as parsed; children of a node that goes take its place, so text is kept.
    """
    changes = 0
    walk = [root]
    for node in walk:  # grows as it goes: parents before children
        walk.extend(c for c in node[2] if isinstance(c, list))
    for parent in reversed(walk):
        kept: list = []
        for child in parent[2]:
            if isinstance(child, str):
                kept.append(child)
                continue
            if child is None:
                changes += 1
                continue
            tag, attrs, inner = child
            if tag not in ALLOWED_TAGS or ":" in tag or (tag in PARENTS and parent[0] not in PARENTS[tag]):
                changes += 1
                kept.extend(inner)
                continue
            if tag == "img":
                src = dict(attrs).get("src")
                if not src or (images is not None and src not in images):
                    changes += 1
                    continue
            good = [(k, v) for k, v in attrs if attribute_allowed(tag, k)]
            changes += len(attrs) - len(good)
            child[1] = good
            kept.append(child)
        parent[2] = kept
    return changes


def written(root: list) -> str:
    """The children of a node as XML."""
    out: list[str] = []
    todo: list = list(reversed(root[2]))
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(html.escape(x, quote=False))
        else:
            tag, attrs, inner = x
            head = tag + "".join(f' {k}="{html.escape(v)}"' for k, v in attrs)
            if inner:
                out.append(f"<{head}>")
                todo.append((f"</{tag}>",))
                todo.extend(reversed(inner))
            else:
                out.append(f"<{head}/>")
    return "".join(out)


def xml_error(document: str | bytes | None) -> str | None:
    """Why a document is not well-formed, or None if it is."""
    if document is None:
        return "no document"
    parser = expat.ParserCreate(namespace_separator="}")
    try:
        parser.Parse(document, True)
    except expat.ExpatError as e:
        return str(e)
    return None


def clean_fragment(fragment: str, images: frozenset | None = frozenset()) -> tuple[str, int]:
    """A fragment that can stand in an XHTML document, and the number of changes; a fragment that cannot be mended is shown as text."""
    root = parse(fragment)
    changes = sanitized(root, images)
    out = written(root)
    if xml_error(f"<div xmlns:epub='e'>{out}</div>"):
        return f"<p>{html.escape(fragment)}</p>", changes
    return out, changes


@on_batches("struct<html:string,changes:int>")
def fragment_cleaned(fragments: pd.Series) -> pd.DataFrame:
    found = [(None, None) if f is None else clean_fragment(f) for f in fragments]
    return pd.DataFrame(found, columns=["html", "changes"])


@on_batches("struct<html:string,changes:int>")
def fragment_with_images(fragments: pd.Series, images: pd.Series) -> pd.DataFrame:
    """Like fragment_cleaned, but images that are in the package are kept."""
    found = [(None, None) if f is None else clean_fragment(f, frozenset(() if own is None else own)) for f, own in zip(fragments, images, strict=True)]
    return pd.DataFrame(found, columns=["html", "changes"])


@on_batches("string")
def xml_errors(documents: pd.Series) -> pd.Series:
    return pd.Series([xml_error(d) for d in documents], dtype=object)


_INLINE = re.compile(
    r"(?P<code>`+)(?P<in_code>.+?)(?P=code)(?!`)|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]+)(?:\s+\"[^\"]*\")?\)|\[(?P<label>[^\]]+)\](?:\((?P<href>[^)\s]+)(?:\s+\"[^\"]*\")?\)|\[(?P<ref>[^\]]*)\])"
    r"|(?P<strong>\*\*|(?<!\w)__)(?=\S)(?P<in_strong>.+?)(?<=\S)(?P=strong)|(?P<em>\*|(?<![\w_])_)(?=[^\s*_])(?P<in_em>.+?)(?<=[^\s*_])(?P=em)(?![\w_])",
    re.DOTALL,
)
_LINK = re.compile(r"(?m)^\s{0,3}\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s+[\"'(].*[\"')])?\s*$\n?")
_FENCE = re.compile(r"\s{0,3}(```+)")
_HEAD = re.compile(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*$")
_RULE = re.compile(r"\s{0,3}([-*_])(\s*\1){2,}\s*")
_GRID = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*")
_ITEM = re.compile(r"(\s*)([-*+]|[0-9]+\.)\s+(.*)")


def _inline(text: str, links: dict[str, str]) -> str:
    """Code, images, links, strong and emphasis, one after another from the left; what stands inside is looked at in the same way, but for code."""

    def put(m: re.Match) -> str:
        if m["code"]:
            return f"<code>{html.escape(m['in_code'].strip(), quote=False)}</code>"
        if m["src"]:
            return f'<img alt="{m["alt"]}" src="{m["src"]}"/>'
        if m["label"]:
            href = m["href"] or links.get((m["ref"] or m["label"]).lower())
            return f'<a href="{href}">{_inline(m["label"], links)}</a>' if href else m[0]
        if m["strong"]:
            return f"<strong>{_inline(m['in_strong'], links)}</strong>"
        return f"<em>{_inline(m['in_em'], links)}</em>"

    return _INLINE.sub(put, text)


def _list(lines: list[str], links: dict[str, str]) -> str:
    """A list from its lines: an item that is indented further than the one before opens a list in it."""
    out: list[str] = []
    open_lists: list[tuple[int, str]] = []
    for line in lines:
        m = _ITEM.fullmatch(line)
        if not m:
            out.append("\n" + _inline(line.strip(), links))
            continue
        depth, tag = len(m[1].expandtabs(4)), "ol" if m[2][0].isdigit() else "ul"
        while open_lists and depth < open_lists[-1][0]:
            out.append(f"</li></{open_lists.pop()[1]}>")
        if not open_lists or depth > open_lists[-1][0] + 1:
            open_lists.append((depth, tag))
            out.append(f"<{tag}><li>")
        else:
            out.append("</li><li>")
        out.append(_inline(m[3], links))
    out += [f"</li></{tag}>" for _, tag in reversed(open_lists)]
    return "".join(out)


def markdown_html(text: str, links: dict[str, str] | None = None) -> str:
    """Markdown: headings, fenced code, nested lists, quotes, tables with a rule line, rules, paragraphs, reference links, and inline code, images, links, strong and emphasis by stars or underscores. Raw HTML passes through."""
    if links is None:
        links = {}
        parts = re.split(r"(?ms)(^\s{0,3}```.*?^\s{0,3}```[^\n]*$)", text)
        for k in range(0, len(parts), 2):
            links.update((name.lower(), url) for name, url in _LINK.findall(parts[k]))
            parts[k] = _LINK.sub("", parts[k])
        text = "".join(parts)
    out: list[str] = []
    lines = text.split("\n")
    k = 0
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
        elif m := _FENCE.match(line):
            end = next((j for j in range(k + 1, len(lines)) if _FENCE.match(lines[j])), len(lines))
            out.append("<pre><code>" + html.escape("\n".join(lines[k + 1 : end]), quote=False) + "\n</code></pre>")
            k = end + 1
        elif m := _HEAD.match(line):
            out.append(f"<h{len(m[1])}>{_inline(m[2], links)}</h{len(m[1])}>")
            k += 1
        elif _RULE.fullmatch(line):
            out.append("<hr/>")
            k += 1
        elif "|" in line and k + 1 < len(lines) and _GRID.fullmatch(lines[k + 1]):
            rows = [line]
            j = k + 2
            while j < len(lines) and "|" in lines[j]:
                rows.append(lines[j])
                j += 1
            cells = [[_inline(c.strip(), links) for c in r.strip().strip("|").split("|")] for r in rows]
            out.append("<table><thead><tr>" + "".join(f"<th>{c}</th>" for c in cells[0]) + "</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in cells[1:]) + "</tbody></table>")
            k = j
        elif (m := _ITEM.fullmatch(line)) and len(m[1]) < 4:
            j = k
            while j < len(lines) and lines[j].strip() and not _FENCE.match(lines[j]) and (_ITEM.fullmatch(lines[j]) or lines[j][:1].isspace()):
                j += 1
            out.append(_list(lines[k:j], links))
            k = j
        elif line.lstrip().startswith(">"):
            quote = []
            while k < len(lines) and lines[k].lstrip().startswith(">"):
                quote.append(lines[k].lstrip()[1:].lstrip())
                k += 1
            out.append("<blockquote>" + markdown_html("\n".join(quote), links) + "</blockquote>")
        else:
            own = [line]
            k += 1
            while k < len(lines) and lines[k].strip() and not re.match(r"\s{0,3}(#{1,6}\s|```|>)", lines[k]):
                own.append(lines[k])
                k += 1
            out.append(f"<p>{_inline(chr(10).join(own), links)}</p>")
    return "\n".join(out)


@on_batches("string")
def markdown_rendered(texts: pd.Series) -> pd.Series:
    return texts.map(markdown_html, na_action="ignore")
