"""Main text of HTML pages by tree scoring.

A page is parsed into a small tree of elements.  Elements that never hold main
text are dropped: scripts, styles, forms, navigation, headers, footers, asides,
and those whose class, id or role names a menu, advert, notice, comment list or
the like.  Each paragraph gives points for its length and its commas to its
ancestors, the nearer the more; an element's points are discounted by the share
of its text that is in links.  The best container is the start; the article or
main it stands in is kept whole but for lists of links, and elsewhere the parts
beside it and beside its ancestors that score well or hold prose are kept, with
the headings, lists, tables and figures between them.  Their blocks are joined.

Defined results: a null or empty page, or one without text outside the dropped
elements, has an empty text; unclosed and stray tags are closed or ignored as
they come; a page cut in the middle gives what is there; a bare text without
tags is one block; repeated rows give repeated results; an empty table gives an
empty result.  Each page is one call on the whole page; other columns stay as
they are.
"""

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element names by their part in a page.
DROPPED = frozenset(
    "script style noscript template nav header footer aside form fieldset button select option "
    "textarea input label iframe object embed applet svg canvas audio video map menu dialog "
    "head title meta link base frameset noframes annotation annotation-xml".split()
)
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame".split())
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table "
    "caption thead tbody tfoot tr td th figure figcaption address details summary center hr "
    "hgroup search nav header footer aside form fieldset".split()
)
CONTAINERS = frozenset("article main section div body td blockquote center figure html".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd div section article main body".split())
# Opening one of these ends an open element of the listed names.
ENDED_BY = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "tbody": ("thead", "tbody", "tr", "td", "th"),
}
ENDS_P = BLOCKS - {"html", "body"}
FLOW_BOUNDS = frozenset("td th table li div article section blockquote".split())
CELLS = frozenset(name for ended in ENDED_BY.values() for name in ended)
CELL_BOUNDS = frozenset("ul ol table dl".split())
# Words of class, id and label that name what is never main text ...
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner|menu\w*|breadcrumbs?|"
    r"nav(?:s|i|bars?|igations?|igator|links?|lists?|menus?|items?|box|boxes|pills?|tabs?|wrap|wrapper|container|main|top|left|right)?|"
    r"side-?bar\w*|rail|foot(?:er)?\w*|masthead|top-?bar|comments?|comment-?\w+|disqus|respond|responses?|"
    r"replies|reply|cookies?|consent|gdpr|notice|alert|popup|pop-?over|modal|overlay|newsletter|subscri\w+|"
    r"sign-?up|log-?in|share-\w+|share_\w+|sharing|related|recommend\w*|outbrain|taboola|pagination|pager|"
    r"paging|tool-?bar|screen-reader\w*|sr-only|navigation|complementary|contentinfo|dialog|alertdialog)(?:$|[\s_-])"
    r"|(?:^|\s)(?:hidden|hide|skip(?:[_-](?:to|nav|navigation|link|links|content|main)\S*)?)(?:$|\s)",
    re.IGNORECASE,
)
# ... and of what may be either: inside an article or main its text decides, elsewhere
# it goes unless a class of its own says that the text is in there.
WEAK = re.compile(
    r"(?:^|[\s_-])(?:head(?:er)?|tags?|legal|copyright|disclaimer|search|social|share|widget\w*)(?:$|[\s_-])",
    re.IGNORECASE,
)
WANTED = re.compile(
    r"(?:^|\s)(?:article|content|main|body|entry|post|story|text)(?:$|\s)", re.IGNORECASE
)
LIKELY = re.compile(r"article|content|main|body|entry|post|story|text|blog", re.IGNORECASE)

_OPENING = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_ENDING = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
# A paragraph below this many characters gives no points; each of these many gives
# one more, up to three.
LEAST_CHARS = 25
CHARS_PER_POINT = 100
# What stays beside main text if fewer of its characters than LINKED are in links.
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 hgroup ul ol dl table figure".split())
LINKED = 0.25
# A child of an article or main is a list of links from this share on, unless it
# is a heading or paragraph.
LISTED = 0.5
TITLES = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre figure".split())
# Text of more characters reads like prose; shorter text must end like a sentence.
PROSE_CHARS = 80


class Node:
    """Element with children in order: nodes and strings.

    ``flow`` and ``cell`` are the nearest of the node and its ancestors that an
    opening tag has to look at: paragraphs and what bounds them, and list items,
    cells and what bounds those.  ``inside`` tells whether it stands in an article
    or main.
    """

    __slots__ = ("name", "parent", "children", "weak", "bonus", "score", "flow", "cell", "inside")

    def __init__(self, name, parent=None, weak=False, bonus=0.0):
        self.name, self.parent, self.weak, self.bonus = name, parent, weak, bonus
        self.children: list = []
        self.score = 0.0
        self.flow = self if name == "p" or name in FLOW_BOUNDS else parent and parent.flow
        self.cell = self if name in CELLS or name in CELL_BOUNDS else parent and parent.cell
        self.inside = bool(parent) and (parent.inside or parent.name in ("article", "main"))


def _attributes(written: str) -> dict[str, str]:
    return {
        m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(written)
    }


def _judged(name: str, written: str) -> tuple[str, float]:
    """(judgment, bonus) of an element from its attributes; judgment is out, weak or empty."""
    bonus = {"article": 25.0, "main": 10.0}.get(name, 0.0)
    if not written or written.isspace():
        return "", bonus
    given = _attributes(written)
    style = given.get("style", "").replace(" ", "").lower()
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return "out", bonus
    if given.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"):
        return "out", bonus
    words = " ".join(given.get(k, "") for k in ("class", "id", "aria-label"))
    words = re.sub(r"\b(?:has|with|no|without)-[\w-]+", "", words)  # says what is beside it
    if not words.strip():
        return "", bonus
    if LIKELY.search(words):
        bonus += 15.0
    if name in ("html", "body", "article", "main"):
        return "", bonus
    if UNWANTED.search(words):
        return "out", bonus
    return "weak" if WEAK.search(words) and not WANTED.search(words) else "", bonus


class _Tags:
    """Tags of a page in order; every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.unpaired = {'"': len(page), "'": len(page)}  # from here on there is no such quote

    def after(self, at: int):
        """(start, end, closing, name, attributes) of the next tag, or None.

        The name is None for comments and declarations.  A tag goes to its ``>``
        outside quotes; a quote without a second one is a character like any other.
        """
        page = self.page
        opening = _OPENING.search(page, at)
        if opening is None:
            return None
        start, here = opening.span()
        if opening[2] is None:
            end = {"<!--": "-->", "<![CDATA[": "]]>"}.get(opening[0], ">")
            found = page.find(end, here)
            return start, found + len(end) if found >= 0 else len(page), False, None, ""
        attributes = here
        while True:
            mark = _ENDING.search(page, here)
            if mark is None:
                return start, len(page), bool(opening[1]), opening[2].lower(), page[attributes:]
            here = mark.end()
            if mark[0] == ">":
                break
            if here < self.unpaired[mark[0]]:
                second = page.find(mark[0], here)
                if second >= 0:
                    here = second + 1
                else:
                    self.unpaired[mark[0]] = here
        return start, here, bool(opening[1]), opening[2].lower(), page[attributes : here - 1]


def parse(page: str) -> Node:
    """Tree of a page; what never holds main text is left out."""
    root = Node("html")
    here = root
    at = 0
    tags = _Tags(page)
    is_open: Counter = Counter(["html"])  # elements from the root to here, by name
    dropped: list[str] = []  # open elements since the one that is dropped
    inside: Counter = Counter()  # of those, by name

    def add(text: str):
        if text and not dropped:
            here.children.append(html.unescape(text))

    def leave(node: Node):
        """Closes everything up to and with ``node``."""
        nonlocal here
        while True:
            left, here = here, here.parent
            is_open[left.name] -= 1
            if left is node:
                return

    while True:
        tag = tags.after(at)
        if tag is None:
            add(page[at:])
            return root
        start, end, closing, name, written = tag
        add(page[at:start])
        at = end
        if name is None:
            continue
        if not closing and name in RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            shut = page.find(">", found.end()) if found else -1
            at = shut + 1 if shut >= 0 else len(page)
            continue
        if dropped and _ends_dropped(dropped, inside, is_open, name, closing):
            dropped.clear()
            inside.clear()
        elif dropped:
            # only the names count, until the dropped element is closed
            if closing and inside[name]:
                while True:
                    last = dropped.pop()
                    inside[last] -= 1
                    if last == name:
                        break
            elif not closing and name not in VOID and name != "p" and not written.endswith("/"):
                if dropped[-1] in ENDED_BY.get(name, ()) and len(dropped) > 1:
                    inside[dropped.pop()] -= 1
                if name in DROPPED or name in BLOCKS or name == dropped[0]:
                    dropped.append(name)
                    inside[name] += 1
            continue
        if closing:
            if is_open[name] > (name == "html"):
                while here.name != name:
                    leave(here)
                leave(here)
            continue
        if name in ("html", "body") and is_open[name]:
            continue
        # an element that may not stay open
        if name in ENDS_P and here.flow is not None and here.flow.name == "p":
            leave(here.flow)
        if name in ENDED_BY:
            cell = here.cell
            while cell is not None and cell.name not in CELL_BOUNDS:
                above = cell.parent
                if cell.name in ENDED_BY[name]:
                    leave(cell)
                cell = above.cell
        judgment, bonus = _judged(name, written)
        if name in VOID:
            if name in ("br", "hr", "img"):
                here.children.append(Node(name, here))
            continue
        if name in DROPPED or judgment == "out":
            # a break in the text stays where the element was
            here.children.append(Node("gap" if name in BLOCKS or judgment else "none", here))
            if not written.endswith("/") or name in BLOCKS:
                dropped.append(name)
                inside[name] += 1
            continue
        node = Node(name, here, judgment == "weak", bonus)
        here.children.append(node)
        here = node
        is_open[name] += 1


def _ends_dropped(dropped: list[str], inside: Counter, is_open: Counter, name: str, closing: bool) -> bool:
    """Whether a tag ends an unclosed dropped element and is read as usual."""
    if closing:
        return not inside[name] and is_open[name] > 0
    if dropped == ["p"]:
        return name in ENDS_P
    return len(dropped) == 1 and dropped[0] in ENDED_BY.get(name, ())


def _up(node):
    while node is not None:
        yield node
        node = node.parent


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks below a node, in page order, white space made one space."""
    out: list[str] = []
    parts: list[str] = []

    def end():
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            out.append(text)

    stack = [(node, 0)]
    while stack:
        here, k = stack.pop()
        if k == 0 and here.name in BLOCKS:
            end()
        if k < len(here.children):
            stack.append((here, k + 1))
            child = here.children[k]
            if isinstance(child, str):
                parts.append(child)
            elif child.name == "br":
                parts.append(" ")
            elif child.name in ("hr", "gap"):
                end()
            else:
                stack.append((child, 0))
        elif here.name in BLOCKS:
            end()
    end()
    return out


def _measured(root: Node) -> tuple[dict, list[Node]]:
    """(characters of own blocks, of links) by node, and all nodes, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    sizes: dict = {}
    for node in reversed(order):
        text = links = 0
        for child in node.children:
            if isinstance(child, str):
                text += len(_SPACE.sub(" ", child).strip())
            else:
                t, n = sizes[id(child)]
                text, links = text + t, links + n
        sizes[id(node)] = (text, text if node.name == "a" else links)
    return sizes, order


def _density(node: Node, sizes: dict) -> float:
    text, links = sizes[id(node)]
    return links / text if text else 0.0


def _own_text(node: Node) -> str:
    """Text of a node outside its child blocks."""
    parts, stack = [], [node]
    while stack:
        here = stack.pop()
        if isinstance(here, str):
            parts.append(here)
        elif here is node or here.name not in BLOCKS:
            stack.extend(reversed(here.children))
    return _SPACE.sub(" ", "".join(parts)).strip()


def main_nodes(root: Node) -> list[Node]:
    """Best container and what goes with it, in page order."""
    _without_weak(root)
    sizes, order = _measured(root)
    touched = []
    for node in order:
        if node.name not in PARAGRAPHS:
            continue
        text = _own_text(node)
        if not text:
            continue
        points = 1.0 if len(text) >= LEAST_CHARS else 0.25
        points += text.count(",") + text.count("，") + text.count("、")
        points += min(3.0, len(text) / CHARS_PER_POINT)
        points *= 1 - _density(node, sizes)
        # a container's own text counts for itself, a paragraph's for its parents
        first = node if node.name in CONTAINERS and node.name not in ("blockquote", "td") else node.parent
        for share, above in zip((1.0, 0.5, 0.25), _up(first or node)):
            if above.score == 0.0:
                above.score = above.bonus
                touched.append(above)
            above.score += points * share
    if not touched:
        return [root]
    final = {id(n): n.score * (1 - _density(n, sizes)) for n in touched}
    candidates = [n for n in touched if n.name in CONTAINERS] or touched
    best = max(candidates, key=lambda n: final[id(n)])
    return [_whole(best, final, sizes, _prose_of(order))]


def _prose_of(order: list[Node]) -> dict[int, bool]:
    """Whether each node is or holds a paragraph that reads like prose; parents come first."""
    found: dict[int, bool] = {}
    for node in reversed(order):
        holds = any(found[id(c)] for c in node.children if isinstance(c, Node))
        if not holds and node.name in PARAGRAPHS:
            holds = _reads(_own_text(node)) and _own_density(node) < LINKED
        found[id(node)] = holds
    return found


def _without_weak(root: Node) -> None:
    """Weakly named elements go, but for prose of few links inside an article or main."""
    sizes, order = _measured(root)
    if not any(n.weak for n in order):
        return
    prose = _prose_of(order)
    for node in order:
        if node.weak and not (node.inside and prose[id(node)] and _density(node, sizes) < LINKED):
            node.name, node.children, node.weak = "gap", [], False


def _reads(text: str) -> bool:
    return len(text) > PROSE_CHARS or (len(text) >= LEAST_CHARS and bool(re.search(r"[.!?。！？]$", text)))


def _own_density(node: Node) -> float:
    """Share of a node's text outside its child blocks that is in links."""
    text = links = 0
    stack = [(node, node.name == "a")]
    while stack:
        here, linked = stack.pop()
        if isinstance(here, str):
            n = len(_SPACE.sub(" ", here).strip())
            text, links = text + n, links + n * linked
        elif here is node or here.name not in BLOCKS:
            stack.extend((c, linked or here.name == "a") for c in here.children)
    return links / text if text else 0.0


def _whole(best: Node, final: dict, sizes: dict, prose: dict) -> Node:
    """The best container with what belongs to it, a tree without the rest.

    Inside an article or main that is all of it but lists of links.  Elsewhere,
    and beside an article, each ancestor adds its children that score well or
    hold prose, up to the last one that has such a container or paragraph; below
    that one headings, lists, tables, figures and bare text of few links stay too.
    """
    path = list(_up(best))
    mains = [k for k, n in enumerate(path) if n.name == "main"]
    articles = [k for k, n in enumerate(path) if n.name == "article"]
    # up to here everything is main text
    sure = (mains or articles or [0])[-1]
    bar = max(10.0, 0.2 * final[id(best)])

    def belongs(child: Node) -> bool:
        if final.get(id(child), 0.0) >= bar:
            return True
        if _density(child, sizes) >= LINKED:
            return False
        if child.name in ("p", "blockquote", "pre"):
            text = _own_text(child)
            return prose[id(child)] or bool(re.search(r"[.!?]$", text))
        return (child.name == "article" or not articles) and prose[id(child)]

    top = sure
    for k in range(sure + 1, 1 if mains else len(path)):
        if any(
            isinstance(c, Node) and c.name in BLOCKS and c is not path[k - 1] and belongs(c)
            for c in path[k].children
        ):
            top = k
    # headings beside the best container, even if nothing else is
    if not mains:
        top = max(top, min(sure + 1, len(path) - 1))
    kept = best
    for k in range(1, top + 1):
        above = Node(path[k].name)
        run: list = []  # bare text

        def end():
            if run:
                bare = Node("none")
                bare.children = list(run)
                text, linked = _own_text(bare), _own_density(bare)
                if text and linked < LINKED and (k <= sure or not articles and _reads(text)):
                    above.children.extend(run)
                run.clear()

        for child in path[k].children:
            if isinstance(child, str) or child.name not in BLOCKS and child is not path[k - 1]:
                run.append(child)
                continue
            end()
            if child is path[k - 1]:
                above.children.append(kept)
            elif k <= sure:
                keep = child.name in TITLES or _density(child, sizes) < LISTED
                above.children.append(child if keep else Node("gap"))
            elif belongs(child) or child.name in BESIDE and _density(child, sizes) < LINKED and (
                not articles or child.name in ("h1", "h2", "h3")
            ):
                above.children.append(child)
            else:
                above.children.append(Node("gap"))
        end()
        kept = above
    return kept


def extract(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    return "\n".join(text for node in main_nodes(parse(page)) for text in blocks_of(node))


def main_text(page: Column) -> Column:
    """Column expression: the main text of a page."""

    @F.arrow_udf("string")
    def extracted(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p.as_py()) for p in pages], pa.string())

    return extracted(page)
