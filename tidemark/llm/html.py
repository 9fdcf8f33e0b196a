"""Main text of web pages by line-block distribution.

Markup is stripped to blocks (lines): one for each paragraph, heading, list item and so on, with empty
lines where a container begins or ends. Subtrees that aren't the article's text by their element, role
or class (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments; a class counts only
if all its words name such things or layout) leave an empty line. The lengths of the lines, without linked text, are summed over a sliding window; the text begins
where the sum first surges over the threshold and ends where it dives to nothing for the last time, and all
lines between are kept, short ones and those in containers of their own too; lists of links behind it go. Where lines surge inside <article> or <main> elements alone, and those hold most of
the page's unlinked text, they bound it: the text reaches from the first line of them to the last.
"""

import html
import re

from pyspark.sql import DataFrame

from tidemark.llm.common import map_rows

WINDOW, SURGE, LINKS = 3, 80, 0.5

TAG = re.compile(r"""<!--|<[a-zA-Z/!?](?:[^>"']|"[^"<>]*"|'[^'<>]*')*>|<[a-zA-Z/!?][^>]*>""", re.S)
BEGUN = re.compile(r"<[a-zA-Z/!?]")
CLOSE = re.compile(r"</([a-zA-Z][a-zA-Z0-9-]*)")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s>/=])|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORDS = re.compile(r"[^a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no text of the page; the first two run to the end of the page if they aren't closed, the others are no elements then.
RAW = frozenset("script style noscript template textarea svg iframe title select button object canvas math".split())
DROP = frozenset("nav footer aside form dialog menu fieldset".split())
CONTAINERS = frozenset("article main section div body table ul ol dl header details blockquote figure".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre hr address caption figcaption summary center".split())
#: What the start of an element ends by HTML's rules, if open: a paragraph, or its own kind.
P_ENDS = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu
    nav ol p pre search section summary table ul li dt dd""".split()
)
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
CELLS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")} | dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "tr", "td", "th"))
#: Elements whose end tag may be left out.
OMITTED = frozenset({"p", *ITEMS, *CELLS})
WALLS = ("table", "td", "th", "caption")
SPECIAL = BLOCKS | DROP | P_ENDS | frozenset("tbody thead tfoot html".split())
#: Words in a class, id or role that name what surrounds an article.
AROUND = frozenset(
    """ad ads advert adverts advertisement advertising banner sidebar menu nav navbar navigation topbar cookie cookies consent gdpr notice notices
    alert comment comments disqus reply replies respond promo promotion share sharing social related recommended footer popup modal newsletter subscribe
    subscription breadcrumb breadcrumbs widget sponsor sponsored login signup search toolbar masthead copyright legal pagination pager complementary contentinfo dialog""".split()
)
#: Words in a class, id or role that tell where or how something stands, but not what it is.
LAYOUT = frozenset(
    """area bar block body bottom box button buttons center col column container content entry fixed float footer header inner item items left links list main module
    outer page panel post posts primary right row secondary section site sticky text title top unit wrap wrapper article articles policy form link reader user""".split()
)

SITE = frozenset(("header", "site", "page", "top", "main", "global", ""))


def _around(name: str) -> bool:
    """Whether one class, id or role names boilerplate, and nothing else beside its layout."""
    words = [w for w in WORDS.split(name.lower()) if w]
    return any(w in AROUND for w in words) and all(w in AROUND or w in LAYOUT or len(w) == 1 for w in words)


def _dropped(name: str, tag: str, inside: bool) -> bool:
    if name in DROP or name == "header" and not inside:
        return True
    if "=" not in tag and "hidden" not in tag.lower():
        return False
    if HIDDEN.search(tag):
        return True
    if name in ("body", "html", "main", "article") and "comment" not in tag.lower():
        return False
    for _, a, b, c in MARKS.findall(tag):
        if any(_around(x) or not inside and "header" in (words := set(WORDS.split(x.lower()))) and words <= SITE for x in (a or b or c).split()):
            return True
    return False


class _Open:
    """The open elements, ended by their tags and by HTML's implied ends. A step costs what it opens or ends."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}  # places of each name; of "*", all but inline elements; of "#", those without address, div and p

    def last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def cut(self, k: int) -> None:
        while len(self.names) > k:
            for n in self.kinds(self.names.pop()):
                self.at[n].pop()

    @staticmethod
    def kinds(name: str) -> tuple[str, ...]:
        return (name,) if name not in SPECIAL else (name, "*") if name in ("address", "div", "p") else (name, "*", "#")

    def push(self, name: str) -> None:
        for n in self.kinds(name):
            self.at.setdefault(n, []).append(len(self.names))
        self.names.append(name)

    def start(self, name: str, dropped: int) -> None:
        """Ends what the start of an element of this name ends, as `end` does."""
        if name in ITEMS and (k := self.last(*ITEMS[name])) >= 0 and k == self.last("#") and self.may(k, dropped):
            self.cut(k)
        if name in CELLS and (ends := [k for n in CELLS[name] if (k := self.last(n)) > self.last("table") and self.may(k, dropped)]):
            self.cut(min(ends))
        if name in P_ENDS and (k := self.last("p")) > self.last(*WALLS) and self.may(k, dropped):
            self.cut(k)

    def may(self, k: int, dropped: int) -> bool:
        return k > dropped or dropped < len(self.names) and self.names[dropped] in OMITTED

    def end(self, name: str, dropped: int) -> None:
        """The end tag of `name`. What is dropped from the place `dropped` on ends by its own end tag, or by that of an element around it if its own may be left out."""
        k = self.last(name)
        if name == "table":
            wall = -1
        elif name in CELLS or name == "caption":
            wall = self.last("table")
        elif name in SPECIAL:
            wall = self.last(*WALLS, *(("ul", "ol", "menu") if name == "li" else ()))
        else:
            wall = self.last("*")
        if k >= 0 and (k == dropped or k > wall and self.may(k, dropped)):
            self.cut(k)


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters of it in links, whether inside an article or main) of every block; ("", 0, ..) between containers."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked, in_link, main = 0, 0, 0
    opened, skip, base = _Open(), "", -1
    at = 0

    last = {m.group(1).lower(): m.start() for m in CLOSE.finditer(page)}  # the last end tag of each name
    until = page.rfind(">") + 1  # no tag ends after it

    def close(gap: bool) -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, linked, main > 0))
        if gap and out and out[-1][0]:
            out.append(("", 0, main > 0))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if base < 0 and text:
            parts.append(html.unescape(text))
            linked += len(parts[-1]) if in_link else 0

    while m := TAG.search(page, at, until):
        add(page[at : m.start()])
        at = m.end()
        tag = m.group()
        if tag == "<!--":
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
            continue
        if tag.startswith("<!"):
            continue
        named = NAME.match(tag)
        if not named:
            continue
        name, end = named.group(1).lower(), tag[1] == "/"
        if name in RAW and not end:
            if last.get(name, -1) >= at:
                at = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at).end()
            elif name in ("script", "style"):
                at = len(page)
            continue
        alone = name in VOID or tag.endswith("/>")
        if end:
            opened.end(name, base)
        else:
            opened.start(name, base)
        if base >= 0 and len(opened.names) <= base:
            base = -1
            if end and name == skip:
                continue
        if not end and not alone:
            opened.push(name)
        if base >= 0:
            continue
        if not end and not alone and _dropped(name, tag, main > 0) and (name in OMITTED or last.get(name, -1) >= at):
            close(True)
            skip, base = name, len(opened.names) - 1
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = 0 if end else 1  # links don't nest
        elif name in BLOCKS:
            close(name in CONTAINERS)
            if name in ("article", "main"):
                main = max(0, main + (-1 if end else 1))
    rest = BEGUN.search(page, max(at, until))
    add(page[at : rest.start() if rest else None])
    close(False)
    return out


def _sums(size: list[int], window: int) -> list[int]:
    return [sum(size[i : i + window]) for i in range(len(size))]


def _bounded(found: list[tuple[str, int, bool]], window: int, surge: int) -> tuple[int, int] | None:
    """From the first to behind the last line of the page's articles, if the text surges in them alone and most of it is there."""
    own = [i for i, x in enumerate(found) if x[2] and x[0]]
    inside, outside = ([len(t) - n if m == side else 0 for t, n, m in found] for side in (True, False))
    if own and sum(inside) >= sum(outside) and max(_sums(outside, window)) < min(surge, max(1, *_sums(inside, window))):
        return own[0], own[-1] + 1
    return None


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text blocks of one page, joined by blank lines; empty if there are none."""
    found = lines(page or "")
    if bounds := _bounded(found, window, surge):
        return "\n\n".join(t for t, _, _ in found[slice(*bounds)] if t)
    size = [len(t) - n for t, n, _ in found]
    sums = [x if found[i][0] else 0 for i, x in enumerate(_sums(size, window))]
    runs, i = [], 0  # lines between two container edges
    while i < len(found):
        j = i
        while j < len(found) and found[j][0]:
            j += 1
        if i < j:
            runs.append((i, j))
        i = j + 1
    text = [sum(n for _, n, _ in found[i:j]) <= LINKS * sum(len(t) for t, _, _ in found[i:j]) for i, j in runs]
    first = next((k for k, (i, j) in enumerate(runs) if text[k] and max(sums[i:j]) >= surge), None)
    kept: list[str] = []
    if first is not None:
        i, j = runs[max(0, first - 1)]
        if size[i] and sums[runs[first][0]] >= surge:  # a title in a container of its own, right before the surge
            first = max(0, first - 1)
        last = max(k for k in range(len(runs)) if text[k])  # the sums dive to nothing behind it, save for links
        kept = [t for t, _, _ in found[runs[first][0] : runs[last][1]] if t]
    if not kept:  # nothing surges: the fullest lines are all there is
        kept = [t for t, n, m in found if t and (m or n <= LINKS * len(t))]
    return "\n\n".join(kept)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, from the whole html, in time linear in its length.

    A null or empty page, or one without text, has an empty text. Ids may repeat or be null; other columns are left out,
    whatever their names; an empty table gives an empty one.
    """
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)) + ", text string, n_chars long"
    return map_rows(pages.select(id_col, url_col, html_col), schema, lambda _, ids, urls, pages_: [(i, u, t, len(t)) for i, u, x in zip(ids, urls, pages_, strict=True) for t in [extract(x)]])
