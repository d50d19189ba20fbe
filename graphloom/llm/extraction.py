"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree. Each has a hidden label, content or not;
its evidence is a sum of weights of features of its markup and text, and each
parent-child pair has a 2x2 potential by the kind of the child. Sum-product
messages go from the leaves to the root and back and give each element's
marginal probability of being content; a block of text is kept if that of its
element is more than one half.

Weights are trained by the gradient of the conditional likelihood (what labels
say minus what the marginals expect) on labelled pages: those whose markup
names its main part by ``article`` or ``main``. In that part, elements outside
navigation, forms, comments and the like are content, everything else isn't;
an element whose class only may mean such a thing is judged by whether it holds
text that runs.
Half of the time a training page is shown with such names taken away, so that
the model also learns from text, links and place; and each is also shown with
comments, a form or the like put into its main part, with that part cut short,
with it written as lists, tables, sections, preformatted text and the like, and
as a page of nothing else, without any name. Training takes at most
``sample_pages`` pages (a parameter), chosen by hashes of their ids and html
before any html is gathered; every page is extracted, from its whole html.

Defined results: null or empty html and pages without text give the empty text;
repeated rows and null ids get a row each; a page is read in time linear in its
length, broken or deep markup included; without labelled pages the weights
that stand below are used alone; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import PRIVATE, filled

#: Elements of HTML by how they are read.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
SILENT = set("script style noscript template svg math iframe object textarea select option button label title head canvas audio video".split())
#: What an open head can hold; any other start tag, or text, ends it.
HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
RAW = set("script style textarea title noscript iframe".split())
NAMED = "article main section header footer nav aside form ul ol li dl table tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption div body html".split()
#: An open element on the left ends where one on the right begins.
ENDS = {"p": set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "label": set("div h1 h2 h3 h4 h5 h6 hr li ol p pre section table ul".split())}
#: Where an implied end looks no further outwards.
WALLS = set("ul ol dl table article section div nav aside footer header main form body html".split())
AWAY = set("nav header footer aside form menu dialog fieldset".split())
#: Words of classes and ids. The first name what isn't content; the others also stand for subjects
#: ("related work"), so that what such an element holds has to say the same.
STRONG = "ad ads advert\\w* breadcrumb\\w* comment\\w* cookie\\w* footer masthead nav\\w* newsletter popup promo\\w* sidebar sponsor\\w* subscribe toolbar"
WEAK = "banner header menu modal notice related share sharing social widget"
HINT, MAYBE = (re.compile(rf"(?i)(?:^|[\s_-])(?:{words.replace(' ', '|')})(?:$|[\s_-])") for words in (STRONG, WEAK))

_HINTED = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


_NAME = re.compile(r"(/?)([A-Za-z][^\s/><]*)")
_STOP = re.compile(r"[<>\"']")


def tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """The markup of a page in order: ``(start, end, closing, tag, attributes)``;
    comments and declarations have no tag. A ``<`` that begins neither is text,
    and so is a tag that another ``<`` outside quotes, or the end, cuts off
    (but an unfinished one at the end of the page). In time linear in the page:
    what can't be found any more isn't looked for again."""
    last, quotes = source.rfind(">"), {q: source.rfind(q) for q in "\"'"}
    at = source.find("<")
    while at >= 0:
        following = at + 1
        if source.startswith("!--", at + 1):
            end = source.find("-->", at + 4)
            following = len(source) if end < 0 else end + 3
            yield at, following, False, "", ""
        elif source.startswith(("!", "?"), at + 1):
            if at < last:
                following = source.index(">", at) + 1
                yield at, following, False, "", ""
        elif name := _NAME.match(source, at + 1):
            place = name.end()
            while place >= 0:
                stop = _STOP.search(source, place) if place <= last else None
                if stop is None or stop[0] == "<":
                    place = -1
                elif stop[0] == ">":
                    following = stop.end()
                    yield at, following, bool(name[1]), name[2].lower(), source[name.end() : stop.start()]
                    break
                else:
                    place = source.index(stop[0], stop.end()) + 1 if quotes[stop[0]] >= stop.end() else -1
            if place < 0 and at > last and source.find("<", at + 1) < 0:
                following = len(source)
                yield at, following, False, "", ""
        at = source.find("<", following)


def hint(tag: str, attributes: str) -> int:
    """What an element's class, id and role say: 2 no content, 1 perhaps none,
    0 nothing. Those of a page's body or main part say nothing of it (they tell
    of what stands beside it), headings aren't doubted for a word."""
    if tag in ("body", "main"):
        return 0
    said = [next(filter(None, h.groups()), "") for h in _HINTED.finditer(attributes)]
    if any(map(HINT.search, said)):
        return 2
    return int(tag not in _HEADINGS and any(map(MAYBE.search, said)))


_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Element:
    """A block element: what the model sees of it, and its text."""

    __slots__ = ("tag", "parent", "hinted", "chars", "linked", "stops", "before", "children", "depth")

    def __init__(self, tag: str, parent: int, hinted: int, depth: int, before: int):
        self.tag, self.parent, self.hinted, self.depth, self.before = tag, parent, hinted, depth, before
        self.chars = self.linked = self.stops = self.children = 0


def read_page(source: str) -> tuple[list[Element], list[tuple[int, str]]]:
    """Block elements in page order (parents first) and blocks of text, each
    with the number of its element."""
    elements = [Element("html", -1, 0, 0, 0)]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements: tag, number of the block element
    pieces: list[str] = []
    silent = links = 0
    seen = 0
    #: Where in the stack each tag is open, where walls are, and where what isn't inline.
    places: dict[str, list[int]] = defaultdict(list)
    walls, standing, begun = [0], [0], set()

    def flush() -> None:
        nonlocal seen
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                at = stack[-1][1]
                blocks.append((at, text))
                elements[at].chars += len(text)
                elements[at].stops += len(_STOPS.findall(text))
                seen += len(text)

    def pop_to(size: int) -> None:
        nonlocal silent, links
        while len(stack) > size:
            tag, _ = stack.pop()
            places[tag].pop()
            for held in (walls, standing):
                if held and held[-1] == len(stack):
                    held.pop()
            silent -= tag in SILENT
            links -= tag == "a"

    def push(tag: str, number: int) -> None:
        places[tag].append(len(stack))
        if tag in WALLS:
            walls.append(len(stack))
        if tag not in INLINE:
            standing.append(len(stack))
        stack.append((tag, number))

    def end_head() -> None:
        while stack[-1][0] == "head":
            pop_to(len(stack) - 1)

    def put(text: str) -> None:
        if silent and text.strip():
            end_head()
        if text and not silent:
            pieces.append(text)
            if links:
                elements[stack[-1][1]].linked += len(text.strip())

    at = 0
    for start, end, closing, tag, attributes in tags(source):
        if start < at:
            continue
        if start > at:
            put(source[at:start])
        at = end
        if not tag:
            continue
        if closing:
            size = places[tag][-1] if places[tag] else 0
            # An end inside a section doesn't end what stands around the section.
            if size and not (tag not in WALLS and walls[-1] > size):
                if standing[-1] >= size:
                    flush()
                pop_to(size)
            continue
        if tag not in HEAD:
            end_head()
        if tag == "br":
            put(" ")
            continue
        if tag in INLINE:
            if tag not in VOID and not attributes.endswith("/"):
                push(tag, stack[-1][1])
                links += tag == "a"
            continue
        flush()
        ended = max((places[x][-1] for x in ENDS if places[x] and tag in ENDS[x]), default=0)
        if ended > walls[-1]:
            pop_to(ended)
        if tag in VOID:
            continue
        if tag in SILENT:
            if tag in ("svg", "math") and attributes.endswith("/"):
                continue
            push(tag, stack[-1][1])
            silent += 1
            if tag in RAW:
                close = re.compile(rf"(?i)</{re.escape(tag)}\s*>").search(source, at)
                at = close.end() if close else len(source)
                pop_to(len(stack) - 1)
            continue
        if tag == "body" and tag in begun:
            continue
        parent = stack[-1][1]
        if tag == "html":
            continue
        hinted = hint(tag, attributes) if attributes else 0
        elements[parent].children += 1
        elements.append(Element(tag, parent, hinted, elements[parent].depth + 1, seen))
        begun.add(tag)
        push(tag, len(elements) - 1)
    if at < len(source):
        put(source[at:])
    flush()
    return elements, blocks


_STOPS = re.compile(r"[.!?,;:]")


def totals(elements: list[Element]) -> list[list[int]]:
    """Characters, those in links, and stops of each element with all below it."""
    total = [[e.chars, e.linked, e.stops] for e in elements]
    for i in range(len(elements) - 1, 0, -1):
        for k in range(3):
            total[elements[i].parent][k] += total[i][k]
    return total


#: From how many characters on a text runs.
RUNNING = 200


def runs(chars: int, linked: int, stops: int) -> bool:
    """Whether it is text that runs: long, in sentences, with few links."""
    return chars >= RUNNING and 5 * linked < chars and 200 * stops >= chars


def features(elements: list[Element], nameless: bool = False) -> list[tuple]:
    """Each element's active features; ``nameless`` as if names said nothing."""
    total = totals(elements)
    share = [min(4, 5 * linked // max(chars, 1)) if chars else -1 for chars, linked, _ in total]
    whole = max(total[0][0], 1)
    found = []
    for i, (e, (chars, linked, stops)) in enumerate(zip(elements, total)):
        tag = e.tag if e.tag in _NAMED else "other"
        if nameless and tag in _SECTIONS:
            tag = "div"
        found.append((
            ("tag", tag),
            ("hint", 0 if nameless else e.hinted if e.hinted != 1 or not runs(chars, linked, stops) else 0),
            ("chars", min(9, int(math.log2(chars + 1)))),
            ("links", share[i]),
            ("links around", share[i], share[max(e.parent, 0)]),
            ("stops", min(5, 100 * stops // max(chars, 1)) if chars else -1),
            ("share", 4 * chars // whole),
            ("place", 4 * e.before // whole),
            ("depth", min(e.depth, 6)),
        ))
    return found


_NAMED, _SECTIONS = set(NAMED), set("article main section header footer nav aside".split())

#: The weights before any training: what the names themselves say.
START = {("tag", "article"): 2.0, ("tag", "main"): 2.0, ("tag", "p"): 1.0, ("hint", 2): -3.0, ("hint", 1): -2.0, ("links", 4): -1.0} | {("tag", t): -3.0 for t in ("nav", "header", "footer", "aside", "form")}


class TreeModel:
    """Weights of features and log-potentials ``pair[kind][parent][child]``."""

    def __init__(self):
        self.weights: dict = defaultdict(float, START)
        self.pair: dict = defaultdict(lambda: [[0.7, -0.7], [-0.7, 0.7]])

    @staticmethod
    def kind(feature: tuple) -> str:
        return feature[0][1]

    def marginals(self, elements: list[Element], seen: list[tuple]) -> tuple[list[float], list[list[list[float]]]]:
        """Each element's probability of content and, for training, of each
        combination with its parent's label. Messages are kept normalised."""
        n = len(elements)
        own = []
        for f in seen:
            s = sum(self.weights.get(x, 0.0) for x in f)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
            own.append([1 - p, p])
        table = []
        for f in seen:
            (a, b), (c, d) = self.pair[self.kind(f)] if self.kind(f) in self.pair else _NEUTRAL
            table.append(((math.exp(a), math.exp(b)), (math.exp(c), math.exp(d))))
        # Upwards: belief of an element from what is below it.
        below = [o[:] for o in own]
        up = [(0.5, 0.5)] * n
        for i in range(n - 1, 0, -1):
            t, (x, y) = table[i], below[i]
            m0, m1 = t[0][0] * x + t[0][1] * y, t[1][0] * x + t[1][1] * y
            z = m0 + m1
            up[i] = m0 / z, m1 / z
            b = below[elements[i].parent]
            b[0] *= up[i][0]
            b[1] *= up[i][1]
            z = b[0] + b[1]
            b[0] /= z
            b[1] /= z
        # Downwards: the parent's belief without the child's own message.
        belief = [None] * n
        joint = [None] * n
        z = below[0][0] + below[0][1]
        belief[0] = below[0][0] / z, below[0][1] / z
        for i in range(1, n):
            p = belief[elements[i].parent]
            out0, out1 = p[0] / max(up[i][0], 1e-300), p[1] / max(up[i][1], 1e-300)
            t, (x, y) = table[i], below[i]
            j00, j01, j10, j11 = out0 * t[0][0] * x, out0 * t[0][1] * y, out1 * t[1][0] * x, out1 * t[1][1] * y
            z = j00 + j01 + j10 + j11
            joint[i] = j00 / z, j01 / z, j10 / z, j11 / z
            belief[i] = joint[i][0] + joint[i][2], joint[i][1] + joint[i][3]
        return [b[1] for b in belief], joint

    def learn(self, elements: list[Element], labels: list[int], seen: list[tuple], pace: float) -> None:
        """One step up the conditional likelihood of a labelled page."""
        p, joint = self.marginals(elements, seen)
        for i, f in enumerate(seen):
            error = pace * (labels[i] - p[i])
            for x in f:
                self.weights[x] += error
            if i:
                pair = self.pair[self.kind(f)]
                a, b = labels[elements[i].parent], labels[i]
                for k in range(4):
                    pair[k // 2][k % 2] += pace * ((k == 2 * a + b) - joint[i][k])

    def main_text(self, source: str) -> str:
        elements, blocks = read_page(source)
        if not blocks:
            return ""
        p, _ = self.marginals(elements, features(elements))
        return "\n".join(text for at, text in blocks if p[at] > 0.5)


_NEUTRAL = [[0.7, -0.7], [-0.7, 0.7]]


def page_labels(elements: list[Element]) -> list[int] | None:
    """Labels from a page's own names; None if no element is named main."""
    if not any(e.tag in ("article", "main") for e in elements):
        return None
    main, away, total = [False] * len(elements), [False] * len(elements), totals(elements)
    for i, e in enumerate(elements):
        main[i] = e.tag in ("article", "main") or e.parent >= 0 and main[e.parent]
        doubted = e.hinted == 2 or e.hinted == 1 and not runs(*total[i])
        # A class of what stands around the main part ("with-sidebar") says nothing of it.
        away[i] = e.tag in AWAY or main[i] and doubted or e.parent >= 0 and away[e.parent]
    return [int(m and not a) for m, a in zip(main, away)]


#: What training pages may lack: containers inside the main part that aren't content.
#: Those that end in a space hold links.
INTRUDERS = ("div class='comments'", "form", "aside", "div class='share' ", "section id='related' ", "nav ", "div class='newsletter'", "footer", "div class='sidebar'", "header", "div class='cookie notice'", "section class='comment-list'", "div class='nav' ")
_MAIN = re.compile(r"(?i)<(?:article|main)\b[^>]*>")
_MAIN_END = re.compile(r"(?i)</(?:article|main)\s*>")


def intruded(page: str, number: int, texts: list[str]) -> str:
    """The page with a container of other pages' text put before its main part
    or at that part's start or end."""
    opening = INTRUDERS[number % len(INTRUDERS)]
    some = [texts[(7 * number + k) % len(texts)] for k in range(1 + number % 3)] if texts else ["text"]
    shape = "<p>{}</p>"
    if opening.endswith(" "):
        shape = ("<a href='#'>{}</a> ", "<p><a href='#'>{}</a></p>", "<li><a href='#'>{}</a></li>")[number // 2 % 3]
        some = [" ".join(t.split()[: 1 + (number + k) % 4]) for k, t in enumerate(some)]
    block = f"<{opening}>" + "".join(shape.format(entities.escape(t)) for t in some) + f"</{opening.split()[0]}>"
    ends = [m.start() for m in _MAIN_END.finditer(page)]
    first = _MAIN.search(page)
    at = ends[-1] if ends and number % 2 else first.start() if number % 4 else first.end()
    return page[:at] + block + page[at:]


def shortened(page: str, number: int, texts: list[str]) -> str:
    """The page's main part cut to a few short paragraphs, for half of the
    numbers without what stands around it."""
    first = _MAIN.search(page)
    ends = [m.start() for m in _MAIN_END.finditer(page)]
    blocks = (" ".join(texts[(3 * number + k) % len(texts)].split()[: 1 + (number + 2 * k) % 6]) for k in range(1 + number % 4)) if texts else ["text"]
    body = "".join(f"<p>{entities.escape(b)}</p>" for b in blocks)
    if number % 2:
        return first[0] + body
    return page[: first.end()] + body + (page[ends[-1] :] if ends else "")


#: How a text may stand in a main part.
SHAPES = (
    "<p>{0}</p>", "<h2>{1}</h2><p>{0}</p>", "<ul><li>{0}</li><li>{1}</li></ul>", "<table><tr><th>{1}</th><td>{2}</td></tr><tr><td>{2}</td><td>{0}</td></tr></table>",
    "<pre>{0}</pre>", "<blockquote><p>{0}</p></blockquote>", "<section id='{2}'><h3>{1}</h3><p>{0}</p></section>", "<div>{0}</div>", "<p>{0}</p>",
    "<dl><dt>{1}</dt><dd>{0}</dd></dl>", "<figure><figcaption>{1}</figcaption></figure><p>{0}</p>", "<ol><li><p>{0}</p></li></ol>", "<div><div><p>{0}</p></div></div>",
    "<p><a href='#'>{1}</a></p><p>{0}</p>", "<p>{0}</p><ul><li><a href='#'>{1}</a></li></ul>", "<p>{0} <a href='#'>{1}</a></p>",
    "<p>{0}</p><h2>{1}</h2><ol><li><a href='#'>{1}, {2}</a></li><li><a href='#'>{2} {1}</a></li></ol>", "<section class='related {2}'><h2>{1}</h2><p>{0}</p></section>",
)


def reshaped(number: int, blocks: list[str]) -> str:
    """Markup of a main part with these texts in various shapes."""
    out = ["<h1>" + entities.escape(blocks[0]) + "</h1>"] if number % 2 and blocks else []
    for k, text in enumerate(blocks):
        words = text.split()
        shape = SHAPES[(number + k * (1 + number % 5)) % len(SHAPES)]
        if "related" in shape and not runs(len(text), 0, len(_STOPS.findall(text))):
            shape = SHAPES[0]
        out.append(shape.format(*map(entities.escape, (text, " ".join(words[: 1 + (number + k) % 7]), words[-1].strip("'\"") if words else "x"))))
    return "".join(out)


def variants(page: str, number: int, blocks: list[str], texts: list[str]) -> Iterator[tuple[list[Element], list[int], bool]]:
    """Further pages made from a labelled one: elements, labels, and whether
    their names are to be seen."""
    short = shortened(page, number, texts)
    for made in (intruded(page, number, texts), short, intruded(short, number + 1, texts)):
        elements = read_page(made)[0]
        yield elements, page_labels(elements), True
    first, ends = _MAIN.search(page), [m.start() for m in _MAIN_END.finditer(page)]
    body = reshaped(number, blocks[: 1 + number % 12])
    elements = read_page(page[: first.end()] + body + (page[ends[-1] :] if ends else ""))[0]
    yield elements, page_labels(elements), number % 2 == 0
    elements = read_page(f"<html><body>{body}</body></html>" if number % 3 else f"<div id='content'>{body}</div>")[0]
    yield elements, [1] * len(elements), True


def train(pages: list[str], epochs: int = 6, rate: float = 0.3) -> TreeModel:
    """Fit on the labelled ones of the pages. Each is shown as it is, without
    its names, and in its variants."""
    model = TreeModel()
    known = []
    for page in pages:
        elements, blocks = read_page(page)
        if labels := page_labels(elements):
            known.append((page, elements, labels, [t for at, t in blocks if labels[at]], [t for _, t in blocks]))
    texts = [t for *_, every in known for t in every]
    shown = []
    for i, (page, elements, labels, blocks, _) in enumerate(known):
        made = [(e, y, features(e, nameless=not named)) for e, y, named in variants(page, i, blocks, texts)]
        shown.append((elements, labels, [features(elements), features(elements, nameless=True)], made))
    for epoch in range(epochs):
        for i, (elements, labels, seen, made) in enumerate(shown):
            pace = rate / (1 + epoch)
            model.learn(elements, labels, seen[(i + epoch) % 2], pace)
            for e, y, f in made:
                model.learn(e, y, f, pace)
    model.weights, model.pair = dict(model.weights), dict(model.pair)
    return model


def trained_on(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = 400) -> TreeModel:
    """A model of at most ``sample_pages`` labelled pages of the table. Pages are
    chosen by two hashes, so no more html than theirs comes to the driver."""
    keyed = pages.filter(F.col(html_col).rlike(r"(?i)<(?:article|main)[\s>]")).select(F.xxhash64(id_col).alias("k"), F.xxhash64(html_col).alias("x"), F.col(html_col).alias("h"))
    chosen = keyed.select("k", "x").distinct().orderBy("k", "x").limit(sample_pages)
    # At most ``sample_pages`` rows of two numbers.
    rows = keyed.join(F.broadcast(chosen), ["k", "x"]).groupBy("k", "x").agg(F.first("h").alias("h")).collect()
    return train([r["h"] for r in sorted(rows, key=lambda r: (r["k"], r["x"]))])


def extracted(pages: DataFrame, model: TreeModel, keep: list[str], html_col: str = "html") -> DataFrame:
    """The kept columns, ``text`` and ``n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.main_text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    rows = pages.select(*keep, filled(html_col).alias(PRIVATE + "html"))
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")
