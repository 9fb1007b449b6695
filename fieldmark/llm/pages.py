"""Web pages as sequences of blocks: a tolerant reader that repairs what real markup leaves open.

A page becomes a list of events. An element event stands for an opening block element and is known by the path of block
elements above it (name, class, id). A text event stands for the text of one block, known by its path and its text. Inline
elements don't cut a block; a line break counts as white space.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import xxhash

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""", re.S)
_CUT = re.compile(r"<[/!?A-Za-z].*\Z", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![-\w"'=])(hidden)(?![-\w=])""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_SHUT = {name: re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span
    strike strong sub sup time tt u var wbr input button select""".split())
#: Elements that end an open element of the same set, up to the nearest container.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
          "th": ("td th", "tr table"), "thead": ("tr td th tbody thead tfoot", "table"), "tbody": ("tr td th tbody thead tfoot", "table"),
          "tfoot": ("tr td th tbody thead tfoot", "table"), "option": ("option", "select datalist"), "body": ("head", "html")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold main text, and words of classes, ids and roles that say the same.
ASIDE_TAGS = frozenset("""nav footer aside header form head button select datalist dialog menu svg object embed template canvas audio video map
    fieldset""".split()) | RAW
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
    complementary contentinfo copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices
    pager pagination popup popular promo promoted promotion recommended related replies reply respond search share sharing sidebar
    signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets""".split())
#: Words that turn the next one round, as in has-sidebar.
TURNS = frozenset("has with without no non hide".split())
#: How surely a container holds the article: 3 an article, 2 the main part, 1 something called content.
BODY_NAMES = {"articlebody": 3, "entrycontent": 3, "postcontent": 3, "postbody": 3, "articlecontent": 3, "articletext": 3, "storybody": 3,
              "article": 2, "post": 2, "story": 2, "entry": 2, "main": 2, "maincontent": 2, "content": 1, "text": 1, "body": 1}
#: Share of the text outside asides that a kind of container needs to stand for the page.
LEAST_SHARE = 0.25


class Event(NamedTuple):
    key: int
    text: str | None  # None for an element
    aside: bool
    rank: int  # of the surest container around
    links: int  # characters inside links


class _Element(NamedTuple):
    name: str
    key: int
    aside: bool
    rank: int


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for m in ATTRIBUTE.finditer(text):
        if m[5]:
            found["hidden"] = "hidden"
        else:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _cues(name: str, found: dict[str, str]) -> tuple[bool, int, str]:
    """(is it an aside, rank as a container, its name in paths)."""
    called = [c for k in ("class", "id", "role", "itemprop") for c in found.get(k, "").split()]
    mark = name + "".join("." + c for c in sorted(_DIGITS.sub("0", c) for k in ("class", "id") for c in found.get(k, "").split()))
    rank = {"article": 3, "main": 2}.get(name, 0)
    aside = name in ASIDE_TAGS
    if not called and len(found) == 0:
        return aside, rank, mark
    for c in called:
        words = [w.lower() for w in _WORDS.findall(c)]
        rank = max(rank, BODY_NAMES.get("".join(words), 0))
        if name not in ("html", "body", "main", "article"):
            aside |= any(w in ASIDE_WORDS and not (k and words[k - 1] in TURNS) for k, w in enumerate(words))
        elif name == "article":
            aside |= "comment" in words or "ad" in words
    style = found.get("style", "").replace(" ", "").lower()
    aside |= "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    return aside, rank if not aside else 0, mark


def _key(parent: int, mark: str) -> int:
    return xxhash.xxh3_64_intdigest(mark.encode("utf-8", "replace"), seed=parent)


def read(page: str) -> list[Event]:
    """The events of a page in page order; texts are decoded, with white space turned into single spaces, never empty."""
    events: list[Event] = []
    stack = [_Element("", 1, False, 0)]
    inline: list[tuple[str, bool]] = []  # open inline elements: name, is it an aside
    known: dict[tuple[int, str, str], tuple[bool, int, int]] = {}
    parts: list[str] = []
    linked = 0

    def finish() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                events.append(Event(_key(top.key, "\0" + text), text, top.aside, top.rank, min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if not text or any(aside for _, aside in inline):
            return
        text = entities.unescape(text) if "&" in text else text
        parts.append(text)
        if any(name == "a" for name, _ in inline):
            linked += len(text.strip())

    def close_to(depth: int) -> None:
        finish()
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at) if page.find(">", at) >= 0 or page.find("<!", at) >= 0 else None
        if m is None:
            say(_CUT.sub("", page[at:]))  # a tag that the page breaks off in is no text
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:  # comments, declarations
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3].replace("&", "&amp;"))
            continue
        name = name.lower()
        if m[1]:
            if name in INLINE:
                for k in range(len(inline) - 1, -1, -1):
                    if inline[k][0] == name:
                        del inline[k]
                        break
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    close_to(depth)
                    inline.clear()
                    break
            else:
                if name == "p":  # a closing tag without its opening one still ends a block
                    finish()
            continue
        if name in RAW:
            shut = _SHUT[name].search(page, at)
            at = shut.end() if shut else end
            finish()
            events.append(Event(_key(stack[-1].key, name), None, True, 0, 0))
            continue
        if name in INLINE:
            if name == "br" or name == "img":
                parts.append(" ")
            elif name not in VOID:
                aside = name in ASIDE_TAGS or (m[3] != "" and _cues(name, _attributes(m[3]))[0])
                inline.append((name, aside))
            continue
        # a block element ends an open paragraph, and others of its kind
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name == "p":
                close_to(depth)
                break
            if stack[depth].name in ("div", "article", "section", "main", "body", "table", "td", "li", "blockquote"):
                break
        ended, within = CLOSES.get(name, (frozenset(), frozenset()))
        if ended:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in within:
                    break
                if stack[depth].name in ended:
                    close_to(depth)
        finish()
        inline.clear()
        parent = stack[-1]
        seen = (parent.key, name, m[3])
        if seen not in known:
            aside, rank, mark = _cues(name, _attributes(m[3]))
            known[seen] = (aside, rank, _key(parent.key, mark))
        aside, rank, key = known[seen]
        around = max(e.rank for e in stack)
        if name in ("article", "main") and not aside:
            inside = any(e.aside and e.name in ASIDE_TAGS for e in stack)  # a wrapper's class may be wrong, a nav isn't
        elif name in HEADINGS and around >= 2 and parent.name == "header":  # the title of an article
            inside = any(e.aside for e in stack[:-1])
        else:
            inside = parent.aside or aside
        element = _Element(name, key, inside, 0 if inside else max(rank, around))
        events.append(Event(key, None, inside, element.rank, 0))
        if name not in VOID and not m[0].endswith("/>"):
            stack.append(element)
    finish()
    return events


def rank_of(events: list[Event]) -> int:
    """The surest kind of container that holds a fair share of the text outside asides; 0 if none does."""
    size = [0, 0, 0, 0]
    for e in events:
        if e.text is not None and not e.aside:
            for k in range(e.rank + 1):
                size[k] += len(e.text)
    return next((k for k in (3, 2, 1) if size[k] and size[k] >= LEAST_SHARE * size[0]), 0)
