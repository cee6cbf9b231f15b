"""HTML extraction by equivalence-class template deduction.

Tokens are a page's elements (an opening and a closing one each, named by the path of elements they stand in) and its
texts (with their path). Over the pages of a host a token has an occurrence vector: how often it occurs in each page.
1. vectors(): the tokens that stand on most pages of their host, with the sums of a hash of (page, times) as their
   vector, by aggregates that combine before the shuffle, so that a host with a third of all pages is no hot group.
2. classes(): tokens of equal vectors are an equivalence class; it counts if it is large: an element and something else.
3. checked(): each page says of each class whether its tokens stand there in one order, again and again, and in which
   slot (between which two tokens) of which other class it stands.
4. decide(): classes that are ordered and stand in one slot of a class that does so, too, on nearly all pages are valid;
   nested into each other they are the template. Its texts are template texts. Its main slot is the deepest template
   element that holds nearly all text that is neither template nor beside the text.
5. extract(): what the main slot of a page holds besides template tokens, that is its remaining slots, without what is
   beside the text; an article is one more sign: if articles hold most of what is left, only they are the result.
   Where nothing is left (pages that are copies of one another), the main slot's template texts stay.

Beside the text stand menus, asides, footers and the like by their element; by their class or id only if each part of one
of its whole words is a side word or says where or how it stands; and lists of links outside articles. The last two and
forms stay text if they hold the page's main element or first article, its heading and much of its text, or half of all text
of their host.

Null or empty html: an empty text. Null url: the pages of no host share one. Markup may be cut off, unclosed or nested to any
depth. Empty table: no rows. Repeated rows each count as a page and get their own result; ties: the deeper element. Extra
columns are ignored; pages are read whole. Of hosts with fewer than LEAST_PAGES pages the page's own elements decide, and
any article marks the text.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, defaultdict
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import discard, map_rows, stored, table

# Fixed values of HTML and of common markup.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main",
          "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "caption"}
SPACED = {"br", "td", "th", "option"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt",
          "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
SIDE = {"nav", "aside", "footer", "button", "select", "dialog", "menu", "head", "audio", "video", "canvas", "label", "datalist"}
SIDE_UNLESS_MAIN = {"form", "fieldset", "object"}
SIDE_WORDS = {"ad", "ads", "adsbygoogle", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies",
              "consent", "gdpr", "notice", "popup", "modal", "overlay", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
              "comment", "comments", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "newsletter",
              "subscribe", "subscription", "login", "signup", "search", "footer", "masthead", "pagination", "pager", "widget", "toolbar", "skip"}
PLACE_WORDS = {"area", "articles", "bar", "block", "body", "bottom", "box", "buttons", "col", "column", "container", "content", "form", "frame", "global", "group", "header",
               "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "posts", "primary", "right", "row", "secondary", "section",
               "site", "slot", "stories", "title", "top", "unit", "wrap", "wrapper"}
SIDE_ROLES = {"navigation", "contentinfo", "complementary", "alert", "dialog", "menu", "menubar", "alertdialog"}
SIDE_ROLES_UNLESS_MAIN = {"banner", "search", "form"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
ENDS_P = {"div", "article", "section", "body", "main", "td", "li", "blockquote"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: A template token stands on this part of a host's pages, on this many at least; tokens of a class that counts, at least.
SUPPORT, LEAST_PAGES, LARGE = 0.6, 3, 3
#: The part of its pages on which a class must be ordered and in its slot; of the text that the main slot holds; of what
#: is left that articles that count hold on hosts with a template.
VALID, HOLDS_TEXT, ARTICLE_HOLDS = 0.9, 0.8, 0.5
#: What is beside the text by its name stays text with this part of the host's text, or with a heading and this part of the page's.
HALF, WITH_HEADING = 0.5, 0.3
#: A list of this many items at least, of whose text this part is links, is a menu.
MENU_ITEMS, MENU_LINKS = 3, 0.9
#: Characters of templates that are broadcast; more are joined by a shuffle, whose skewed hosts adaptive execution splits.
BROADCAST_CHARS = 8_000_000
PAGE = 0  # the token that stands for the page itself
NOT_SIDE, BY_NATURE, BY_NAME = 0, 1, 2


@lru_cache(maxsize=1 << 16)
def traits(name: str, attributes: str) -> tuple[str, int]:
    """The element's sign in a path, and whether it is beside the text."""
    side = BY_NATURE if name in SIDE else BY_NAME if name in SIDE_UNLESS_MAIN else NOT_SIDE
    if not attributes.strip(" /"):
        return name, side
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    marks = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    sign = f"{name}.{marks[0]}" if marks else name
    if name in ("html", "body"):
        return sign, NOT_SIDE
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden") == "true" or role in SIDE_ROLES or "display:none" in found.get("style", "").replace(" ", ""):
        return sign, BY_NATURE
    for mark in marks:
        words = {w for w in re.split(r"[_:-]+", mark) if w and not w.isdigit()}
        if words & SIDE_WORDS and words <= SIDE_WORDS | PLACE_WORDS:
            return sign, side or BY_NAME
    return sign, side or (BY_NAME if role in SIDE_ROLES_UNLESS_MAIN else NOT_SIDE)


@lru_cache(maxsize=1 << 18)
def path_token(above: int, sign: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{above}>{sign}") - (1 << 63)


def text_token(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}".encode("utf-8", "replace")) - (1 << 63)


class Page:
    """Elements (0: the page itself) in order of their opening, each with its path's token, the element above, first and last
    position, whether it is beside the text, in an article, main or holds a heading; texts as (element, text, position)."""

    def __init__(self, page: str) -> None:
        self.path, self.above, self.side, self.article, self.first, self.last = [PAGE], [0], [NOT_SIDE], [False], [0], [0]
        self.main, self.heading, self.items = [False], [False], [0]
        self.texts: list[tuple[int, str, int]] = []
        self.links: list[int] = []  # characters of links, by text
        self._read(page)
        n = len(self.path)
        self.chars, linked = [0] * n, [0] * n
        for (e, text, _), k in zip(self.texts, self.links, strict=True):
            self.chars[e] += len(text)
            linked[e] += min(k, len(text))
        for e in range(n - 1, 0, -1):
            self.chars[self.above[e]] += self.chars[e]
            linked[self.above[e]] += linked[e]
            if self.items[e] >= MENU_ITEMS and not self.article[e] and linked[e] >= MENU_LINKS * self.chars[e] > 0:
                self.side[e] = self.side[e] or BY_NAME

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # name, element (or that above of an inline one); -1: its text is dropped
        opened: Counter[str] = Counter()
        held: list[str] = []
        ends: dict[str, int] = {}
        at, size, lowered, position, link, linked, articles, dropped = 0, len(page), None, 0, 0, 0, 0, 0

        def flush() -> None:
            nonlocal position, linked
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                held.clear()
                if text:
                    position += 1
                    self.texts.append((stack[-1][1], text, position))
                    self.links.append(linked)
            linked = 0

        def hold(text: str) -> None:
            nonlocal linked
            if not dropped:
                held.append(text)
                if link:
                    linked += len(text)

        def pop(k: int) -> None:
            """Closes the elements from place k of the stack."""
            nonlocal position, link, dropped
            while len(stack) > k:
                name, e = stack.pop()
                opened[name] -= 1
                link -= name == "a"
                if name.startswith("~"):
                    dropped -= 1
                elif e != stack[-1][1]:
                    position += 1
                    self.last[e] = position

        def mark(flags: list[bool], e: int) -> None:
            while not flags[e]:
                flags[e] = True
                e = self.above[e]

        for m in TAG.finditer(page):
            if m.start() < at:
                continue
            if m.start() > at:
                hold(page[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                if m[0].startswith("<![CDATA["):
                    hold(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            if m[1] or m[4]:
                own = name if opened[name] else f"~{name}"
                if opened[own]:
                    k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == own)
                    if name in BLOCKS or any(x[0] in BLOCKS or x[0] in SIDE for x in stack[k:]):
                        flush()
                    pop(k)
                elif name == "p":
                    flush()
                continue
            if name in RAW:
                lowered = page.lower() if lowered is None else lowered
                end = lowered.find(f"</{name}", at) if len(lowered) == size else -1
                if end < 0:
                    found = re.compile(f"</{name}", re.I).search(page, at)
                    end = found.start() if found else size
                at = end
                continue
            sign, side = traits(name, m[3] or m[6] or "")
            if name in ("article", "main"):
                articles += name == "article" and not side
                lowered = page.lower() if lowered is None else lowered
                for i, (n, e) in enumerate(stack):  # a menu that is never closed ends before it
                    if n in SIDE and n not in ends:
                        ends[n] = lowered.rfind(f"</{n}")
                    if e and n in SIDE and ends[n] < at:
                        flush()
                        pop(i)
                        break
            if name in BLOCKS:
                flush()
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in ENDS_P), None) if opened["p"] else None
                if k is not None and stack[k][0] == "p":
                    pop(k)
            if name in CLOSED_BY and any(opened[x] for x in CLOSED_BY[name]):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in HOLDS[name]:
                        break
                    if stack[i][0] in CLOSED_BY[name]:
                        flush()
                        pop(i)
                        break
            if name in SPACED:
                hold(" ")
            if name in VOID:
                continue
            above = stack[-1][1]
            if name == "header" and not self.article[above]:
                side = BY_NATURE
            if name in INLINE:
                if side:  # a part of a line: its text goes, the line stays
                    dropped += 1
                    opened[f"~{name}"] += 1
                    stack.append((f"~{name}", above))
                else:
                    link += name == "a"
                    opened[name] += 1
                    stack.append((name, above))
                continue
            if name in SIDE:
                flush()
            e = len(self.path)
            position += 1
            self.path.append(path_token(self.path[above], sign))
            self.above.append(above), self.side.append(side), self.first.append(position), self.last.append(position)
            self.article.append(name in ("article", "main") or self.article[above])
            self.main.append(False), self.heading.append(False), self.items.append(0)
            if name == "li":
                self.items[above] += 1
            elif name == "main" or name == "article" and articles == 1 and not side:
                mark(self.main, e)
            elif name == "h1":
                mark(self.heading, e)
            opened[name] += 1
            stack.append((name, e))
        if at < size:
            hold(page[at:].partition("<")[0] if re.match(r"<[a-zA-Z/!]", page[at:]) else page[at:])
        flush()
        pop(1)
        self.last[0] = position + 1

    def beside(self, cleared: set[int]) -> list[bool]:
        """Of each element, whether it is beside the text. cleared: the paths that only seem to be."""
        out = [False] * len(self.path)
        for e in range(1, len(out)):
            side = self.side[e]
            if side == BY_NAME and (self.main[e] or self.path[e] in cleared or self.heading[e] and self.chars[e] >= WITH_HEADING * self.chars[0]):
                side = NOT_SIDE
            out[e] = out[self.above[e]] or bool(side)
        return out


def host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def by_host(pages: DataFrame) -> DataFrame:
    """__host (a hash of it) and html."""
    return pages.select(F.xxhash64(host()).alias("__host"), "html")


def vectors(pages: DataFrame) -> DataFrame:
    """host, token and, of tokens on most pages of a host of LEAST_PAGES pages or more: text, times, v1, v2 (its vector), the sums of
    its first (first, last) positions and characters; and of those that are named as beside the text."""

    def tokens(batch):
        rows = {n: [] for n in ("host", "page", "token", "text", "times", "chars", "first", "last", "named")}
        for h, i, source in zip(*(batch.column(c).to_pylist() for c in ("__host", "__page", "html")), strict=True):
            page, own = Page(source or ""), {}
            for e, path in enumerate(page.path):
                if path in own:
                    own[path][1] += 1
                    own[path][2] += page.chars[e]
                else:
                    own[path] = [False, 1, page.chars[e], page.first[e], page.last[e], page.side[e] == BY_NAME]
            for e, text, at in page.texts:
                token = text_token(page.path[e], text)
                if token in own:
                    own[token][1] += 1
                else:
                    own[token] = [True, 1, 0, at, at, False]
            rows["host"] += [h] * len(own)
            rows["page"] += [i] * len(own)
            rows["token"] += own
            for n, values in zip(("text", "times", "chars", "first", "last", "named"), zip(*own.values(), strict=True), strict=True):
                rows[n] += values
        return rows

    own = by_host(pages).withColumn("__page", F.monotonically_increasing_id())  # used in one pass only: any two rows differ
    said = map_rows(own, "host long, page long, token long, text boolean, times long, chars long, first long, last long, named boolean", tokens)
    h = F.xxhash64("page", "times")
    per = said.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))).alias("v1"), F.sum(F.shiftrightunsigned(h, 33)).alias("v2"),
        *[F.sum(c).alias(c) for c in ("times", "chars", "first", "last")], F.max("text").alias("text"), F.max("named").alias("named"))
    counted = by_host(pages).groupBy(F.col("__host").alias("host")).agg(F.count("*").alias("of"))
    often = (F.col("of") >= LEAST_PAGES) & (F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), SUPPORT * F.col("of")))
    return per.join(counted, "host").where(often | F.col("named") | (F.col("token") == PAGE)).withColumn("often", often)


def classes(known: DataFrame) -> DataFrame:
    """host, template (JSON): the paths that only seem beside the text, and the tokens of the large classes: path or text, the
    class (a hash of its vector), and the sums of positions by which they are ordered. A host's frequent tokens are at most
    those of its pages divided by SUPPORT, so this is a bounded row."""
    total = known.where(F.col("token") == PAGE).select("host", F.col("chars").alias("all"), (F.col("of") >= LEAST_PAGES).alias("several"))
    cleared = known.where("named").join(total, "host").where(F.col("chars") >= HALF * F.col("all")).groupBy("host").agg(F.collect_list("token").alias("cleared"))
    own = known.where("often").where(F.col("token") != PAGE)
    sized = own.groupBy("host", "v1", "v2").agg(F.sum(F.when(F.col("text"), 1).otherwise(2)).alias("size"), F.min("text").alias("only_texts"))
    own = own.join(sized.where((F.col("size") >= LARGE) & ~F.col("only_texts")), ["host", "v1", "v2"])
    tokens = own.groupBy("host").agg(F.collect_list(F.struct("token", "text", F.xxhash64("v1", "v2").alias("cls"), "first", "last")).alias("tokens"))
    made = total.join(cleared, "host", "left").join(tokens, "host", "left")
    return made.select("host", F.to_json(F.struct("several", "cleared", "tokens")).alias("template"))


_read: dict[int, tuple[str, dict]] = {}  # of each Python worker; bounded


def template_of(key: int, text: str | None) -> dict:
    if key not in _read or _read[key][0] != text:
        if len(_read) > 500:
            _read.clear()
        made = json.loads(text or "{}")
        made["cleared"] = set(made.get("cleared") or ())
        made["repeated"] = set(made.get("repeated") or ())
        steps = defaultdict(list)  # of each class its tokens in order: (position, path or text, closes)
        for t in made.get("tokens") or ():
            steps[t["cls"]].append((t["first"], t["token"], False))
            if not t["text"]:
                steps[t["cls"]].append((t["last"], t["token"], True))
        made["order"] = {(token, closes): (cls, k) for cls, own in steps.items() for k, (_, token, closes) in enumerate(sorted(own))}
        made["size"] = {cls: len(own) for cls, own in steps.items()}
        _read[key] = (text, made)
    return _read[key][1]


def walked(page: Page, order: dict, size: dict) -> dict[int, list]:
    """Of each class on the page: whether its tokens stand in order and cross no other class, and the (class, slot) around it.

    An occurrence runs from a class's first token to its last; the ones that are open form a stack, innermost last."""
    events = [(page.first[e], p, False) for e, p in enumerate(page.path) if (p, False) in order]
    events += [(page.last[e], p, True) for e, p in enumerate(page.path) if (p, True) in order]
    events += [(at, token, False) for e, text, at in page.texts if (token := text_token(page.path[e], text), False) in order]
    found: dict[int, list] = {}
    inside: list[list[int]] = []  # [class, number of its tokens passed]
    for _, token, closes in sorted(events):
        cls, k = order[token, closes]
        if not k:
            around = (inside[-1][0], inside[-1][1]) if inside else (0, 0)
            own = found.setdefault(cls, [True, around])
            if own[1] != around:  # its occurrences stand in different slots
                own[0] = False
            inside.append([cls, 1])
        elif inside and inside[-1] == [cls, k]:
            inside[-1][1] += 1
        else:
            found.setdefault(cls, [False, (0, 0)])[0] = False
            for x in inside:
                if x[0] == cls:
                    x[1] = k + 1
        while inside and inside[-1][1] >= size[inside[-1][0]]:
            inside.pop()
    for cls, _ in inside:
        found[cls][0] = False
    return found


def checked(pages: DataFrame) -> DataFrame:
    """host, what, a, b, c, n of pages with their template: pages of a class (in order or not), pages of a class in a slot of
    another, and characters, template texts left out (1) or not (0), of each template element, of the page as element 0."""

    def look(batch):
        sums: Counter = Counter()
        for h, source, text in zip(*(batch.column(c).to_pylist() for c in ("__host", "html", "template")), strict=True):
            known = template_of(h, text)
            if not known["order"]:
                continue
            page = Page(source or "")
            for cls, (ok, (around, slot)) in walked(page, known["order"], known["size"]).items():
                sums[h, "seen", cls, int(ok), 0] += 1
                sums[h, "slot", cls, around, slot] += 1
            side, held = page.beside(known["cleared"]), ([0] * len(page.path), [0] * len(page.path))
            for e, t, _ in page.texts:
                if not side[e]:
                    held[0][e] += len(t)
                    if (text_token(page.path[e], t), False) not in known["order"]:
                        held[1][e] += len(t)
            for k in (0, 1):
                for e in range(len(page.path) - 1, -1, -1):
                    if e:
                        held[k][page.above[e]] += held[k][e]
                    if held[k][e] and (not e or (page.path[e], False) in known["order"]):
                        sums[h, "held", page.path[e], k, 0] += held[k][e]
        return {n: [x[i] for x in sums] for i, n in enumerate(("host", "what", "a", "b", "c"))} | {"n": list(sums.values())}

    said = map_rows(pages, "host long, what string, a long, b long, c long, n long", look)
    return said.groupBy("host", "what", "a", "b", "c").agg(F.sum("n").alias("n"))


def decide(template: dict, sums: list[dict]) -> dict:
    """The host's template: main slot (a path) and template texts, of its classes and what its pages say of them."""
    seen, fine, slots, held = Counter(), Counter(), defaultdict(Counter), (Counter(), Counter())
    for r in sums:
        if r["what"] == "seen":
            seen[r["a"]] += r["n"]
            fine[r["a"]] += r["n"] * r["b"]
        elif r["what"] == "slot":
            slots[r["a"]][r["b"], r["c"]] += r["n"]
        else:
            held[r["b"]][r["a"]] += r["n"]
    around = {}
    for cls, n in seen.items():
        where, often = max(slots[cls].items(), key=lambda x: (x[1], x[0]))
        if min(fine[cls], often) >= VALID * n:
            around[cls] = where[0]
    valid = {0}
    while more := {cls for cls, over in around.items() if over in valid and cls not in valid}:
        valid |= more
    tokens = [t for t in template.get("tokens") or () if t["cls"] in valid]
    best = held[1] if held[1][PAGE] else held[0]
    deep = [(t["first"] / max(1, seen[t["cls"]]), t["token"]) for t in tokens if not t["text"] and best[t["token"]] >= HOLDS_TEXT * best[PAGE] > 0]
    return {"several": True, "cleared": template.get("cleared") or [], "container": max(deep)[1] if deep else None, "repeated": [t["token"] for t in tokens if t["text"]]}


def templates(pages: DataFrame) -> DataFrame:
    """host, template (JSON: several, cleared, container, repeated): a row for each host with a template or names to clear."""
    known = stored(vectors(pages), "tokens")
    found = stored(classes(known), "classes")
    sums = checked(with_template(by_host(pages), found))
    both = found.join(sums.groupBy("host").agg(F.to_json(F.collect_list(F.struct("what", "a", "b", "c", "n"))).alias("sums")), "host", "left")

    def settle(batch):
        made = []
        for text, said in zip(batch.column("template").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            own = json.loads(text)
            made.append(json.dumps(decide(own, json.loads(said or "[]")) if own.get("several") else {"cleared": own.get("cleared") or []}))
        return {"host": batch.column("host"), "template": made}

    out = stored(map_rows(both, "host long, template string", settle), "templates")
    discard(known)
    discard(found)
    return out


def with_template(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (with __host) and the template of their host."""
    small = (known.agg(F.sum(F.length("template") + 100)).first()[0] or 0) <= BROADCAST_CHARS
    known = known.withColumnRenamed("host", "__host")
    return rows.join(F.broadcast(known) if small else known, "__host", "left")


def main_text(page: Page, known: dict) -> str:
    """The text of a page by the template of its host."""
    side, container, several = page.beside(known["cleared"]), known.get("container"), known.get("several")
    inside = [False] * len(page.path)
    for e in range(len(inside)):
        inside[e] = page.path[e] == container or e > 0 and inside[page.above[e]]
    slot = [x for x in page.texts if not side[x[0]]]
    if any(inside[x[0]] for x in slot):
        slot = [x for x in slot if inside[x[0]]]
    if several:
        slot = [x for x in slot if text_token(page.path[x[0]], x[1]) not in known["repeated"]] or slot
    marked = [x for x in slot if page.article[x[0]]]
    if marked and (not several or sum(len(x[1]) for x in marked) >= ARTICLE_HOLDS * sum(len(x[1]) for x in slot)):
        slot = marked
    return "\n\n".join(text for _, text, _ in slot)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    pages = pages.select("page_id", "url", "html")
    rows = with_template(pages.withColumn("__host", F.xxhash64(host())), templates(pages))

    def work(batch):
        own = (batch.column(c).to_pylist() for c in ("__host", "html", "template"))
        made = [main_text(Page(p or ""), template_of(h, t)) for h, p, t in zip(*own, strict=True)]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": made, "n_chars": [len(t) for t in made]}

    return map_rows(rows.select("page_id", "url", "html", "__host", "template"), "page_id long, url string, text string, n_chars long", work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
