"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. Frames that are never article text (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) leave lines of length zero, a window of
them; where a page marks its article, so does what lies outside it; elsewhere lines that are links and nothing else count
as empty, as menus without a mark are made of these. Text lengths are summed over sliding windows of lines: where the sum
surges from zero text begins, where it dives back to zero it ends, and what lies between a surge and its dive is kept.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from varspan.llm.common import sliced

#: Lines of a window.
WINDOW = 3
#: Share of a page's text beyond which an element with the class words of a layout (LAYOUT) is the page and no frame.
WHOLE = 0.8

#: A quote opens a value only after '='; elsewhere it is a sign like any other, and so is one that nothing closes.
_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title)\b{_ATTRS}>.*?(?:</(?P=raw)\b[^>]*+>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>{_ATTRS})>"
    r"|<[a-z/!?][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.IGNORECASE | re.DOTALL,
)
ATTR = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<![\w-])(hidden)(?![\w-])", re.IGNORECASE)
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
FRAMES = {"nav", "footer", "aside", "form", "button", "select", "head", "menu", "dialog", "object", "canvas"}
BLOCKS = {
    *"address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr".split(),
    *"header html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split(),
    *FRAMES,
}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words that make a name in class, id or role a frame's, if all its words are of these sets (or numbers), so
#: "cookie-notice" and "site-footer" are frames, "with-sidebar" and "entry-header" are not.
NOTICES = set(
    "ad ads advert adverts advertisement advertising advertisements breadcrumb breadcrumbs consent contentinfo cookie cookies "
    "copyright disclaimer footer gdpr login menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted "
    "promotion signup sponsor sponsored subscribe alert dialog".split()
)
LAYOUT = set("banner complementary header masthead related search share sharing sidebar social toolbar widget widgets".split())
COMMENTS = set("comment comments commentlist disqus discussion replies reply respond".split())
QUALIFIERS = set(
    "site main page global top bottom left right primary secondary box container wrapper wrap list section area block inner outer "
    "bar slot unit link links item items posts articles stories user".split()
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]\w*")
OWN_RIGHTS = re.compile(r"^(?:\u00a9|\(c\)|copyright\b)", re.IGNORECASE)

#: Signs that stand between the links of a menu.
BETWEEN_LINKS = " \t\r\n|/>,-\u00b7\u2022\u2013\u00bb"

NOT, FRAME, MAYBE = range(3)


def _marks(name: str) -> set[str]:
    """The marking words of one class name, empty unless every word of it is a mark, a qualifier or a number."""
    words = {w.lower() for w in WORDS.findall(name)}
    found = words & (NOTICES | LAYOUT | COMMENTS)
    return found if all(w in QUALIFIERS or w[0].isdigit() for w in words - found) else set()


def _frame(name: str, attrs: str, in_article: bool) -> int:
    """Whether an element that opens is a frame; MAYBE: one by layout words alone, unless it holds nearly all text."""
    if name in FRAMES or name == "header" and not in_article:
        return FRAME
    if not attrs.strip() or name in ("html", "body", "main"):
        return NOT
    found: set[str] = set()
    for key, a, b, c, hidden in ATTR.findall(attrs):
        value, key = a or b or c, key.lower()
        if hidden or key == "aria-hidden" and value.lower() == "true":
            return NOT if name == "article" else FRAME
        if key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return FRAME
        if key in ("class", "id", "role"):
            for token in value.split():
                found |= _marks(token)
    if name == "article":
        found &= COMMENTS
    if in_article:
        found -= {"header", "masthead"}
    return NOT if not found else MAYBE if found <= LAYOUT else FRAME


class _Page:
    """Lines of a page as (text, characters outside links, innermost open element that may be a frame or -1, in article),
    frames as lines of length zero. Every step takes constant time on average, however deep elements are nested."""

    def __init__(self, page: str, reopen: bool = False):
        """reopen: an article ends frames that are open, as if they had been left unclosed."""
        self.lines: list[tuple[str, int, int, bool]] = []
        self.parents: list[int] = []  # of the elements that may be frames: the one around each
        self.articles = self.mains = 0  # how many article and main elements stand outside frames
        parts: list[str] = []
        stack: list[tuple[str, int, int]] = []  # open elements: name, kind, innermost maybe-frame
        at: dict[str, list[int]] = {}  # where each name stands in the stack
        blocks: list[int] = []  # where the elements stand that aren't inline
        frames = inside = links = plain = cleared = 0
        maybe = -1

        def pop_to(depth: int) -> None:
            nonlocal frames, inside, links, cleared, maybe
            while len(stack) > depth:
                name, kind, around = stack.pop()
                at[name].pop()
                if blocks and blocks[-1] == len(stack):
                    blocks.pop()
                if len(stack) >= cleared:
                    frames -= kind == FRAME
                cleared = min(cleared, len(stack))
                inside -= name in ("article", "main") and kind == NOT
                links -= name == "a"
                maybe = around

        def flush() -> None:
            nonlocal plain
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                self.lines.append((text, plain, maybe, inside > 0))
            plain = 0

        for token in TOKEN.finditer(page):
            text, name = token["text"], token["name"]
            if text is not None:
                if not frames:
                    parts.append(text)
                    plain += 0 if links else len(text.strip(BETWEEN_LINKS))
                continue
            if name is None:
                continue
            name = name.lower()
            if name in BLOCKS:
                flush()
            if name in VOID or SELF_CLOSED.search(token["attrs"]):
                continue
            if token["close"]:
                if at.get(name):
                    pop_to(at[name][-1])
                continue
            if name not in BLOCKS and name not in ("span", "a"):
                continue
            if name in BLOCKS and blocks and stack[blocks[-1]][0] == "p":  # a block ends an open paragraph
                pop_to(blocks[-1])
            kind = _frame(name, token["attrs"], inside > 0)
            if name in ("article", "main") and kind == NOT:
                if reopen and frames and not inside:
                    frames, cleared = 0, len(stack)
                inside += 1
                if not frames:
                    self.articles += name == "article"
                    self.mains += name == "main"
            around = maybe
            if kind == FRAME and not frames:
                self.lines += [("", 0, -1, False)] * WINDOW
            if kind == MAYBE and not frames:
                self.parents.append(maybe)
                maybe = len(self.parents) - 1
            stack.append((name, kind, around))
            at.setdefault(name, []).append(len(stack) - 1)
            if name in BLOCKS:
                blocks.append(len(stack) - 1)
            frames += kind == FRAME
            links += name == "a"
        flush()

    def sizes(self) -> list[int | None]:
        """The length that each line counts with; None: its text is no part of the article."""
        held = [0] * len(self.parents)  # text under each element that may be a frame
        total = 0
        for text, _, own, _ in self.lines:
            total += len(text)
            if own >= 0:
                held[own] += len(text)
        for i in range(len(held) - 1, -1, -1):  # a parent opens before its children
            if self.parents[i] >= 0:
                held[self.parents[i]] += held[i]
        hidden: list[bool] = []
        for i, parent in enumerate(self.parents):
            hidden.append(held[i] < WHOLE * total or parent >= 0 and hidden[parent])
        seen = [own < 0 or not hidden[own] for _, _, own, _ in self.lines]
        shown = sum(len(line[0]) for line, s in zip(self.lines, seen) if s)
        inside = sum(len(line[0]) for line, s in zip(self.lines, seen) if s and line[3])
        # cards of other articles come in numbers and hold little
        marked = inside > 0 and (self.mains > 0 or self.articles == 1 or 2 * inside >= shown)
        out: list[int | None] = []
        for (text, plain, _, article), s in zip(self.lines, seen):
            if not s or marked and not article or not marked and OWN_RIGHTS.match(text):
                out.append(None)
            else:
                out.append(len(text) if marked or plain else 0)
        return out

    def between(self) -> str:
        """The text between each surge, the first line after windows without text, and its dive, the last before them."""
        sizes = self.sizes()
        kept, window, surge, last = [], 0, -1, -1
        for i in range(len(sizes) + WINDOW):
            size = (sizes[i] or 0) if i < len(sizes) else 0
            window += size - ((sizes[i - WINDOW] or 0) if i >= WINDOW else 0)
            if size:
                surge, last = i if surge < 0 else surge, i
            if not window and surge >= 0:
                kept += range(surge, last + 1)
                surge = -1
        return " ".join(self.lines[i][0] for i in kept if sizes[i] is not None and self.lines[i][0])


def main_text(page: str | None) -> str:
    """The text between surges and dives; '' for null, empty and textless pages."""
    return _Page(page or "").between() or _Page(page or "", reopen=True).between()


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        for part in sliced(batch, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages; other columns are ignored.

    Null, empty and textless html give an empty text. Unclosed elements end with the element around them, unclosed
    frames where an article begins, a page cut off anywhere at its end. Rows are independent: repeated pages give equal
    texts, an empty table gives none.
    """
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )


def op3_html(pages: DataFrame) -> DataFrame:
    return extract(pages)
