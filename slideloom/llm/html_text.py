"""Main text of web pages by composite text density.

A page is read into a small tree of block elements with their inline elements.  The density of an element is its
characters per tag, adjusted by the share of link characters and link tags; the density sum of a block adds up
all its child elements, blocks and inline ones.
The block with the largest density sum is the content; the smallest density on its path up to the body is
the threshold at which further subtrees are searched in the same way.  The structure of the page completes
this: headings, quotes, lists and short paragraphs that belong to the blocks found stay too.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import require
from ._words import frugal, slices

#: Attributes up to the end of the tag: a quote only opens a value behind "=", and only if it is closed somewhere.
_ATTRIBUTES = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe)\b{_ATTRIBUTES}(?:>|\Z).*?(?:</\1\b[^>]*(?:>|\Z)|\Z)"
    rf"|<(/?)([a-z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
_SPACE = re.compile(r"\s+")
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that are never main text.
DROPPED = frozenset("nav footer aside form button select option dialog menu head object canvas audio video map svg noscript template".split())
#: Of these, the ones within lines of text, which they do not part.
_WITHIN = frozenset("button select object canvas audio video map svg noscript template".split())
#: Names in class, id or role that mark such parts, whole or as the end of a longer name (left-sidebar).
DROPPED_NAMES = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "aside footer header masthead cookie cookies consent notice popup modal newsletter subscribe share sharing social comment comments "
    "disqus reply replies related recommended widget toolbar search login complementary contentinfo commentlist respond disclaimer signup paywall "
    "gdpr copyright skyscraper leaderboard".split()
)
#: Of these, the ones that name the head of a page or of an article: inside an article or main a part that holds a heading stays.
_HEADS = frozenset("banner header masthead".split())
#: Of these, the ones that say nothing as the first word of a longer name (search-results, header-image).
_WEAK = _HEADS | frozenset("menu search login social share reply widget related recommended copyright".split())
#: Parts of longer names that say a page has, or does not have, such a part (has-sidebar, no-comments).
_ABOUT = frozenset("has have with without no not hide hidden show is".split())
#: Last words of names that only say where or in which form such a part is (sidebar-left, share-buttons).
_FORMS = frozenset("left right top bottom bar box area list links link items item buttons button icons icon slot unit block widget widgets".split())
#: The same of longer names that do not begin with a word for main text (comments-section, but not content-sidebar-wrap).
_WRAPS = _FORMS | frozenset(
    "section container wrapper wrap inner outer holder app root panel group zone region row col column message messages thread body form posts stories articles content main primary secondary".split()
)
_CONTENT = frozenset("content main article post entry story body text".split())
#: First words of names that only say who uses them (js-comments, site-footer).
_PREFIXES = frozenset("js c u l m o is site page global wp block the".split())
#: Dropped by their element alone, wherever the text is.
_NEVER = _WITHIN | {"head", "option"}
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th pre blockquote figure "
    "figcaption address center fieldset hr details summary header hgroup caption".split()
) | DROPPED
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "option", "summary"} - _WITHIN
_ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that belong to the content directly behind them, alone or in a wrapper of such.
_LEADING = _HEADINGS | frozenset("p blockquote ul ol dl pre figure figcaption".split())
_HOLDER = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}


class _Block:
    __slots__ = ("chars", "children", "density", "dropped", "holder", "inline", "link_chars", "link_tags", "name", "parent", "parts", "sum", "tags")

    def __init__(self, name: str, parent: _Block | None, dropped: bool | str):
        self.name, self.parent, self.dropped = name, parent, dropped  # dropped: by its own element or names ("head": by one of _HEADS), until _settle
        # the outermost article around the block, itself included, or, without an article, the outermost main
        above = parent.holder if parent is not None else None
        self.holder: _Block | None = above if above is not None and (above.name == "article" or name != "article") else self if name in ("article", "main") else above
        self.parts: list[str | _Block] = []  # text and blocks in page order
        self.children: list[_Block] = []
        self.inline: list[tuple[int, int, int, int]] = []  # characters, tags, link characters, link tags in each inline child
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def parse(page: str) -> _Block:
    """The tree of blocks; unclosed elements end where a browser would end them."""
    root = _Block("body", None, False)
    here, links = root, 0
    # inline elements that are open in ``here``, with its counts where they began
    opened: list[tuple[str, int, int, int, int]] = []
    # how many blocks, and inline elements, of each name are open: an end tag without any costs nothing
    blocks, inlines = Counter(), Counter()

    def close(to: int = 0) -> None:
        if not to and opened:
            _, c, t, lc, lt = opened[0]
            here.inline.append((here.chars - c, here.tags - t, here.link_chars - lc, here.link_tags - lt))
        inlines.subtract(x[0] for x in opened[to:])
        del opened[to:]

    def leave(up: _Block) -> None:
        """Ends ``here`` and all blocks up to ``up``."""
        nonlocal here
        while here is not up:
            blocks[here.name] -= 1
            here = here.parent
        blocks[up.name] -= 1
        here = up.parent

    for m in _TOKEN.finditer(page):
        text = m.group(5)
        if text is not None:
            text = html.unescape(text)
            here.parts.append(text)
            n = len(text) - text.count(" ")
            here.chars += n
            if links:
                here.link_chars += n
            continue
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if m.group(2):  # an end tag
            if name == "a":
                links = max(0, links - 1)
            if name == "br":
                here.parts.append(" ")
            elif name not in BLOCKS:
                if inlines[name]:
                    close(next(i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == name))
            elif name not in ("html", "body") and blocks[name]:
                up = here
                while up.name != name:
                    up = up.parent
                close()
                leave(up)
                links = 0
            continue
        if name in ("html", "body") or name == "head" and here is not root:
            continue
        if name == "br":
            here.parts.append(" ")
        if name not in BLOCKS:
            here.tags += 1
            if name == "a":
                here.link_tags += 1
                links += 1
            if name not in _VOID:
                opened.append((name, here.chars, here.tags, here.link_chars, here.link_tags))
                inlines[name] += 1
            continue
        close()
        if here.name == "head" and name not in ("head",):
            leave(here)  # a body without a start tag
        if name in _CLOSES_P and here.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (here.name == "p" or name[0] == "h"):
            leave(here)
            links = 0
        for other in _ITEM.get(name, ()):
            if not blocks[other]:
                continue
            up, stop = here, _HOLDER[name]
            while up is not root and up.name != other and up.name not in stop:
                up = up.parent
            if up.name == other and up is not root:
                leave(up)
                links = 0
                break
        block = _Block(name, here, name in DROPPED or _is_dropped(name, m.group(4), here))
        here.parts.append(block)
        if name not in _VOID and not m.group(4).endswith("/"):
            here = block
            blocks[name] += 1
    close()
    _settle(root)
    return root


def _settle(root: _Block) -> None:
    """Drop what is inside dropped blocks, but no block around an article or main, or with most of the page's text outside links.

    The second exception is for forms and names, as these are put around whole pages too.
    """
    order = [root]
    for block in order:
        order.extend(p for p in block.parts if not isinstance(p, str))
    plain = {id(b): 0 if b.name in _NEVER else b.chars - b.link_chars for b in order}
    around, headed = set(), set()
    for block in reversed(order[1:]):
        up = block.parent
        if block.name not in _NEVER:
            plain[id(up)] += plain[id(block)]
        if block.name in ("article", "main") or id(block) in around:
            around.add(id(up))
        if block.name in ("h1", "h2") or id(block) in headed:
            headed.add(id(up))
    most = plain[id(root)] / 2
    for block in order[1:]:
        if block.dropped and block.name not in _NEVER:
            by_name = block.name == "form" or block.name not in DROPPED
            head = block.dropped == "head" and block.holder is not None and id(block) in headed
            block.dropped = not (id(block) in around or head or by_name and plain[id(block)] > most)
        block.dropped = block.dropped or block.parent.dropped
        if not block.dropped:
            block.parent.children.append(block)


def _marks(name: str) -> str | None:
    """The word by which a class, id or role name marks a part that is never main text: the whole name, its last word before words of form, or its first."""
    if name in DROPPED_NAMES:
        return name
    parts = [p for p in re.split("[_-]+", name) if p]
    if any(p in _ABOUT for p in parts):
        return None
    while len(parts) > 1 and parts[0] in _PREFIXES:
        parts.pop(0)
    if not parts:
        return None
    forms = _FORMS if parts[0] in _CONTENT else _WRAPS
    while len(parts) > 1 and parts[-1] in forms and parts[-1] not in DROPPED_NAMES:
        parts.pop()
    return parts[-1] if parts[-1] in DROPPED_NAMES else parts[0] if parts[0] in DROPPED_NAMES - _WEAK else None


def _is_dropped(name: str, attributes: str, parent: _Block) -> bool | str:
    if name == "header" and parent.holder is None:  # a page header; inside an article it holds the title
        return True
    if not attributes or name in ("article", "main"):
        return False
    found = [word for m in _NAMES.finditer(attributes) for x in (m.group(1) or m.group(2) or m.group(3) or "").lower().split() if (word := _marks(x))]
    return "head" if found and all(word in _HEADS for word in found) else bool(found)


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Composite text density: characters per tag times the logarithm of (c / lc)(t / lt) to the base ln(c lc / (c - lc) + c * body_share + e)."""
    if not chars:
        return 0.0
    per_tag = chars / max(1, tags)
    ratio = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_share * chars + math.e)
    return per_tag * max(0.0, math.log(ratio) / math.log(base))


def densities(root: _Block) -> list[_Block]:
    """Fill in density and density sum of every block; the blocks, parents before children."""
    order = [root]
    for block in order:
        order.extend(block.children)
    for block in reversed(order):
        for child in block.children:
            block.chars += child.chars
            block.tags += child.tags + 1
            block.link_chars += child.link_chars
            block.link_tags += child.link_tags
    # a page without links counts as one with a single link character: the logarithm needs a base
    share = max(1, root.link_chars) / max(1, root.chars)
    for block in order:
        block.density = density(block.chars, block.tags, block.link_chars, block.link_tags, share)
    for block in order:
        block.sum = sum(child.density for child in block.children) + sum(density(*counts, share) for counts in block.inline)
    return order


def _highest(block: _Block) -> _Block:
    best, queue = block, [block]
    for b in queue:
        queue.extend(b.children)
        if b.sum > best.sum:
            best = b
    return best


def _marked(root: _Block) -> list[_Block]:
    """The subtrees that their density marks as content, in page order."""
    densities(root)
    if not root.chars:
        return []
    best = _highest(root)
    if best.sum == 0:
        return [root]
    threshold, up = best.density, best
    while up is not None:
        threshold = min(threshold, up.density)
        up = up.parent
    marked, queue = {id(best)}, list(root.children)
    if best is not root:
        on_path, up = set(), best
        while up is not None:
            on_path.add(id(up))
            up = up.parent
        while queue:
            block = queue.pop()
            if block is best or block.chars == 0:
                continue
            if id(block) in on_path:
                queue.extend(block.children)
            elif block.density >= threshold and block.children:
                inner = _highest(block)
                marked.add(id(inner if inner.sum else block))
            elif block.density >= threshold and block.name[0] in "ph":
                marked.add(id(block))
    out, walk = [], [root]
    while walk:
        block = walk.pop()
        if id(block) in marked:
            out.append(block)
        else:
            walk.extend(reversed(block.children))
    return out


def _linked(block: _Block) -> bool:
    """Whether most characters of a block are in links; those of headings do not count as such."""
    links, queue = block.link_chars, [block]
    for b in queue:
        if b.name in _HEADINGS:
            links -= b.link_chars
        else:
            queue.extend(b.children)
    return 2 * links > block.chars


def _leads(block: _Block) -> bool:
    """Whether a block directly before the content belongs to it."""
    queue = [block]
    for b in queue:
        if b.name not in _LEADING:
            if any(isinstance(p, str) and p.strip() for p in b.parts):
                return False
            queue.extend(c for c in b.children if c.chars)
    return not _linked(block)


def content_blocks(root: _Block) -> list[_Block | str]:
    """The content in page order: subtrees, and texts that stand beside them.

    An article or main with a marked subtree stays, and so does what lies between the first and the last marked
    subtree outside of these, both without blocks that are mostly links (paragraphs, headings and quotes are no such
    blocks).  Of what is before the first one, the headings, quotes, lists and paragraphs directly before it stay.
    """
    marked = _marked(root)
    if not marked or marked[0] is root:
        return list(marked)
    ids, whole, loose, path = {id(b) for b in marked}, set(), set(), set()
    for block in marked:
        holder = block.holder
        if holder is None:
            loose.add(id(block))
        else:
            whole.add(id(holder))
        up = block.parent
        while up is not None and id(up) not in path:
            path.add(id(up))
            up = up.parent
    # the page as subtrees and texts in order, each with whether it is in an article or main that stays
    items: list[tuple[_Block | str, bool]] = []
    stack = [(iter(root.parts), False)]
    held: list[str] = []
    while stack:
        parts, inside = stack[-1]
        part = next(parts, None)
        if isinstance(part, str):
            held.append(part)
            continue
        if part is not None and part.dropped and part.name in _WITHIN:
            continue
        if held:
            items.append(("".join(held), inside))
            held = []
        if part is None:
            stack.pop()
        elif part.dropped:
            continue
        elif id(part) in path and id(part) not in ids:
            stack.append((iter(part.parts), inside or id(part) in whole))
        else:
            items.append((part, inside or id(part) in whole))
    places = [i for i, (x, _) in enumerate(items) if id(x) in loose]
    first, last = (places[0], places[-1]) if places else (len(items), -1)
    keep = set()
    for i, (x, inside) in enumerate(items):
        stays = inside or first <= i <= last
        if id(x) in ids or stays and (isinstance(x, str) or x.name in ("p", "blockquote", "pre", "figcaption") or not _linked(x)):
            keep.add(i)
    for i in range(first - 1, -1, -1) if places else ():
        x = items[i][0]
        if isinstance(x, str):
            if x.strip():
                break
        elif x.chars:
            if not _leads(x):
                break
            keep.add(i)
    return [items[i][0] for i in sorted(keep)]


def _texts(block: _Block) -> Iterator[str]:
    """Texts of blocks in page order; text around an inner block is a block of its own."""
    stack: list[tuple[Iterator, list[str]]] = [(iter(block.parts), [])]
    while stack:
        parts, held = stack[-1]
        for part in parts:
            if isinstance(part, str):
                held.append(part)
                continue
            if part.dropped and part.name in _WITHIN:
                continue
            if held:
                yield "".join(held)
                held.clear()
            if not part.dropped:
                stack.append((iter(part.parts), []))
                break
        else:
            if held:
                yield "".join(held)
            stack.pop()


def main_text(page: str | None) -> str:
    """Main text of one page, its blocks joined by empty lines; '' if there is none."""
    if not page:
        return ""
    blocks = (_SPACE.sub(" ", t).strip() for b in content_blocks(parse(page)) for t in ([b] if isinstance(b, str) else _texts(b)))
    return "\n\n".join(t for t in blocks if t)


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``column`` replaced by text and n_chars, row by row and with no shuffle.

    A null or empty page gives an empty text; repeated rows are kept; existing text and n_chars columns are replaced.  A page
    of any length is read whole as one tree, in time in proportion to its length however deep it is.
    """
    require(pages, [column])
    pages = pages.drop(*[c for c in ("text", "n_chars") if c != column])
    rest = [f for f in pages.schema.fields if f.name != column]
    schema = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            texts = [main_text(x) for x in batch.column(column).to_pylist()]
            kept = [batch.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema.fieldNames())

    return pages.select(*[F.col(f"`{f.name}`") for f in rest], F.col(column).cast("string").alias(column)).mapInArrow(frugal(run), schema)
