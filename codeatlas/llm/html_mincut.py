"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A logistic classifier gives each block a log-odds of being content from its words, links
and neighbours; no element or class name is among its inputs. This becomes the block's capacity to the source or the sink,
at most `CLIP`. Neighbours in page order, and blocks of one parent, are tied by edges whose capacity halves with each step
between them in the tree. Elements whose tag or name says something are nodes, too (regions), tied to their blocks and to
the region around it: an article or main part leans to the source; forms, page headers and names such as `related` or
`notice` lean to the sink, and what they hold may outweigh that; form and header ties cost one way only. Only what can't be
the article has an unbounded capacity to the sink: nav, footer, aside, hidden elements, what is labelled an advert, and what
is named as a whole after a frame (adverts, sidebars, reader comments and the like). A name that has such a word among others
(`has-sidebar`, `nav-fixed`) leans a little. An article within a part named after a frame or teasers is decided by its blocks
alone, or leans to the source if the page has no other article; one among comments is never heard. A maximum flow separates
content from the rest. Where words speak for no block of a page, its best sentence is the measure.

The classifier starts from fixed weights and is fitted, with a ridge towards them, on a bounded sample of pages whose own
markup tells content from frame (article or main against nav, footer, aside and the like); that markup is the label only.

Null or empty html, or a page without content blocks, gives an empty text. Unclosed tags and cut-off pages end where the
html ends; work is linear in the nesting. Pages are judged each by themselves; repeated rows each give a row, null ids and
urls are carried, extra columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements by what they do to text.
GONE = frozenset("script style template svg canvas object iframe noscript audio video select textarea head title datalist map".split())
RAW = frozenset("script style textarea title iframe noscript".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i img input ins kbd label mark math mfrac mi mn mo mrow msqrt mstyle msub msup mtext q s samp semantics small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTROLS = frozenset("input select textarea button".split())
LIST_LIKE = frozenset("ul ol dl table select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What is never the article.
FRAME = frozenset("nav footer aside menu dialog".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar tablist".split())
HARD_NAMES = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|sidebars?|nav|navbar|navigation|footer|masthead|topbar|comments?|commentlist|disqus|respond|replies)")
COMMENT_NAMES = re.compile(r"(?:comments?|commentlist|disqus|respond|replies)")
AD_LABELS = re.compile(r"\s*(?:ads?|advert\w*|sponsored(?: \w+)?|promoted(?: \w+)?|promotion)\s*", re.I)
#: What covers a page or asks for something; a whole text in it outweighs its name.
ASKING_NAMES = re.compile(r"(?:cookies?|consent|gdpr|popups?|modal)")
NOTICE_NAMES = re.compile(r"(?:notices?|overlay|share\w*|sharing|social|related|recommend\w*|newsletter\w*|subscri\w*|signup|login|pagination|pager|breadcrumbs?|disclaimer|skip\w*)")
#: What is often not the article, and words that add nothing to a name.
SOFT_NAMES = re.compile(r"(?:notices?|alerts?|banner|overlay|rail|widgets?|menus?|breadcrumbs?|toolbar|share\w*|sharing|social|related|recommend\w*|newsletter\w*|subscri\w*|signup|login|pagination|pager|tags?|copyright|disclaimer|skip\w*|header)")
PLAIN_NAMES = re.compile(r"(?:\d+|lists?|sections?|area|box|block|container|wrap|wrapper|slot|unit|site|page|main|posts?|entry|top|bottom|left|right|inner|outer|form|links?|items?|bar|thread|text|holder|module|content|article|primary|secondary|global|mobile|desktop|the|(?!has|no|not|non|all|off|on)[a-z]{1,3})")
CONTENT_NAMES = re.compile(r"(?:article\w*|content|post|entry|story|body|prose)")
ENDS = ".!?:;\u2026\u201d\u3002\uff01\uff1f"
FEATURES = ("bias", "link share", "words", "sentence", "commas", "heading", "list item", "signs", "words before", "words after")
PRIOR = np.array([0.0, -4.0, 1.5, 1.0, 0.5, 1.5, -0.5, -3.0, 0.3, 0.3])
#: The most that words say; the leaning of regions; the tie of a block or region to the region around it, and of neighbours.
CLIP, GOOD, FORM, HEADER, SOFT, PARTLY, NOTICE, ASKING, ONLY = 4.0, 1.5, -2.0, -8.0, -4.0, -1.5, -12.0, -8.0, 3.0
#: What each control adds to a form's leaning, and where that ends.
CONTROL, LEAST = -3.0, -8.0
CONTENT, NEVER = 1e9, -1e9
HOLD = 4.5


class Block:
    __slots__ = ("text", "parent", "linked", "heading", "item", "region", "frame", "label")

    def __init__(self, text, parent, linked, heading, item, region, frame, label):
        self.text, self.parent, self.linked, self.heading, self.item, self.region, self.frame, self.label = text, parent, linked, heading, item, region, frame, label


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


class Page:
    """Blocks in page order, the tree of block-level elements, and regions (leaning, region around it or -1)."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.up, self.depth = [0], [0]
        self.regions: list[tuple[float, int]] = []
        self.wrappers: set[int] = set()
        self.doubtful: list[int] = []
        self._read(html)
        if not any(leaning == CONTENT for leaning, _ in self.regions):
            for k in self.doubtful:
                self.regions[k] = ONLY, self.regions[k][1]

    def _region(self, leaning: float, around: int) -> int:
        self.regions.append((leaning, around))
        return len(self.regions) - 1

    def _marks(self, tag: str, given: str, held: tuple) -> tuple:
        """(region, never content, in content, in a part named so, label, within a part that is named after a frame) of an element, from its own and its parent's."""
        region, frame, content, good, label, shunned = held
        a = attributes(given) if given and not given.isspace() else {}
        role, names = a.get("role", "").lower(), f"{a.get('class', '')} {a.get('id', '')}".lower().split()
        never = region, True, False, False, False, "always"
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "") or AD_LABELS.fullmatch(a.get("aria-label", "-")):
            return never
        if shunned != "always" and (tag == "main" or role == "main"):  # whatever wraps it
            return self._region(CONTENT, -1), False, True, good, True, ""
        if tag in FRAME or role in FRAME_ROLES or shunned == "always":
            return never
        leaning, hard, listed = 0.0, False, False
        for name in names if tag not in ("html", "body") else ():
            parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
            bad, asks, notes, soft = ([bool(x.fullmatch(p)) for p in parts] for x in (HARD_NAMES, ASKING_NAMES, NOTICE_NAMES, SOFT_NAMES))
            whole = all(x or y or z or PLAIN_NAMES.fullmatch(p) for x, y, z, p in zip(bad, asks, soft, parts)) and not ("content" in parts and any(p.startswith("sidebar") for p in parts))
            if any(bad):
                if whole and any(map(COMMENT_NAMES.fullmatch, parts)):
                    return never
                hard |= whole
                leaning = min(leaning, SOFT if content else PARTLY)
            elif any(asks):
                leaning = min(leaning, ASKING if whole else PARTLY)
            elif any(soft):
                leaning = min(leaning, PARTLY if not whole else NOTICE if any(notes) else SOFT)
                listed |= whole and any(notes)
            elif leaning >= 0 and any(CONTENT_NAMES.fullmatch(p) for p in parts):
                leaning, good = GOOD, True
        if tag == "article" or role == "article":
            if not shunned:
                return self._region(CONTENT, region), False, True, good, True, ""
            self.doubtful.append(len(self.regions))
            return self._region(0.0, region), False, content, good, None, shunned
        if frame:
            return region, True, False, False, False, shunned
        if hard:
            return self._region(ASKING, region), True, False, False, False, "named"
        shunned = shunned or ("named" if listed or leaning == ASKING else "")
        if tag == "header" and not (content or good):
            leaning = HEADER
        elif tag == "form" or role == "form":
            leaning = FORM
        if leaning:
            if leaning == HEADER or tag == "form" or role == "form":
                self.wrappers.add(len(self.regions))
            return self._region(leaning, region), False, content, good, None if leaning < 0 else label, shunned
        return region, False, content, good, label, shunned

    def _read(self, html: str) -> None:
        stack: list[tuple] = [("", 0, (-1, False, False, False, None, ""))]
        opened: Counter = Counter()
        forms: list[tuple[int, int]] = []
        pieces: list[str] = []
        linked = gone = links = at = 0

        def flush():
            nonlocal pieces, linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    region, frame, _, _, label, _ = stack[-1][2]
                    self.blocks.append(Block(text, stack[-1][1], linked / len(text), any(opened[h] for h in HEADINGS), opened["li"] > 0, region, frame, label))
                pieces, linked = [], 0

        def say(text: str):
            nonlocal linked
            if text and not gone:
                text = unescape(text)
                pieces.append(text)
                if links:
                    linked += len(text.strip())

        def pop():
            nonlocal gone, links
            tag = stack.pop()[0]
            opened[tag] -= 1
            gone -= tag in GONE
            links -= tag in ("a", "button")

        while at < len(html):
            m = TAG.search(html, at)
            if not m:
                say(html[at:])
                break
            say(html[at : m.start()])
            at = m.end()
            close, tag, given = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag not in INLINE:
                flush()
            if close:
                if opened[tag] > 0:
                    while True:
                        last = stack[-1][0]
                        pop()
                        if last == tag:
                            break
                continue
            if tag == "br":
                continue
            if stack[-1][0] == "head" and tag not in IN_HEAD:
                pop()
            if tag in CONTROLS and "hidden" not in given:
                while forms and len(stack) <= forms[-1][0]:
                    forms.pop()
                if forms:
                    leaning, around = self.regions[forms[-1][1]]
                    self.regions[forms[-1][1]] = (max(LEAST, leaning + CONTROL), around)
            ends = CLOSES.get(tag, () if tag in INLINE or tag in VOID else ("p",))
            if any(opened[e] > 0 for e in ends):
                k = len(stack) - 1
                while k > 0 and stack[k][0] not in ends and (stack[k][0] in INLINE or tag in CLOSES and stack[k][0] == "p") and stack[k][0] not in LIST_LIKE:
                    k -= 1
                if k > 0 and stack[k][0] in ends:
                    flush()
                    while len(stack) > k:
                        pop()
            if tag in VOID or given.rstrip().endswith("/") and tag in ("svg", "path"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            parent = stack[-1][1]
            if tag not in INLINE:
                self.up.append(parent)
                self.depth.append(self.depth[parent] + 1)
                parent = len(self.up) - 1
            stack.append((tag, parent, self._marks(tag, given, stack[-1][2])))
            if tag == "form" and not stack[-1][2][1]:
                forms.append((len(stack) - 1, stack[-1][2][0]))
            opened[tag] += 1
            gone += tag in GONE
            links += tag in ("a", "button")
        flush()

    def steps(self, a: int, b: int) -> int:
        """Steps between two elements in the tree. Between blocks that follow one another these are elements opened or closed there."""
        n, up, depth = 0, self.up, self.depth
        while a != b:
            if depth[a] < depth[b]:
                a, b = b, a
            a = up[a]
            n += 1
        return n

    def edges(self, tie: float) -> list[tuple[int, int, float]]:
        """Ties of neighbours, of each block with the block before it under the same parent, and of what a region holds with it. Regions follow the blocks."""
        out, last, n = [], {}, len(self.blocks)
        for i, b in enumerate(self.blocks):
            if i:
                out.append((i - 1, i, tie * 0.5 ** max(0, self.steps(self.blocks[i - 1].parent, b.parent) - 2)))
            over = self.up[b.parent]
            if last.get(over, i - 1) < i - 1:
                out.append((last[over], i, tie))
            last[over] = i
            if b.region >= 0 and not b.frame and b.region not in self.wrappers:
                out.append((i, n + b.region, HOLD))
        out += [(n + k, n + around, HOLD) for k, (_, around) in enumerate(self.regions) if around >= 0]
        return out


    def one_way(self) -> list[tuple[int, int, float]]:
        """Ties that cost only where a block is content and the form or header around it isn't: being in one never speaks for a block."""
        n = len(self.blocks)
        return [(i, n + b.region, HOLD) for i, b in enumerate(self.blocks) if b.region in self.wrappers and not b.frame]


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block, of steps of a tenth."""
    words = [min(math.log1p(b.text.count(" ") + 1), 4.5) / 1.5 - 1.4 for b in blocks]
    out = np.zeros((len(blocks), len(FEATURES)))
    for i, b in enumerate(blocks):
        t, n = b.text, len(b.text)
        signs = sum(map(t.count, "|\u00a9\u00b7\u00bb\u00ab\u203a\u2022>")) / (t.count(" ") + 1)
        out[i] = (1.0, min(1.0, b.linked), words[i], t[-1] in ENDS, min(1.0, 30 * (t.count(",") + t.count("\u3001") + t.count("\uff0c")) / (n + 30)), b.heading, b.item, min(1.0, signs), words[i - 1] if i else -1.0, words[i + 1] if i + 1 < len(blocks) else -1.0)
    return np.round(out, 1)


def labelled(html: str | None) -> list[tuple[tuple, bool, float]]:
    """(features, is content, weight) of the blocks that their page's markup labels; a page weighs 1 in all."""
    blocks = Page(html or "").blocks
    x = features(blocks) if blocks else ()
    found = Counter((tuple(f), not b.frame) for f, b in zip(x, blocks) if b.frame or b.label)
    return [(f, y, n / found.total()) for (f, y), n in found.items()]


def fit(rows: list[tuple[tuple, bool, float]], rounds: int = 300, ridge: float = 0.02) -> np.ndarray:
    """Weights from (features, is content, weight), both classes weighing the same."""
    if len({y for _, y, _ in rows}) < 2:
        return PRIOR
    rows = sorted(rows)
    x, y, n = np.array([f for f, _, _ in rows]), np.array([y for _, y, _ in rows], float), np.array([n for _, _, n in rows])
    n = np.where(y > 0, n / n[y > 0].sum(), n / n[y == 0].sum()) / 2
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ ((p - y) * n) + ridge * (w - PRIOR))
    return w


def min_cut(odds: list[float], edges: list[tuple[int, int, float]], one_way: list[tuple[int, int, float]] = ()) -> list[bool]:
    """Which nodes are on the source's side; odds above 0 tie a node to the source, below to the sink. `one_way` edges (i, j, c) cost c only with i there and j not.

    A node whose own odds outweigh all its edges has that side in every minimum cut; it is settled, and its edges move to
    its neighbours' odds. The rest is left to a maximum flow in layers.
    """
    n, odds = len(odds), list(odds)
    near: list[dict[int, float]] = [{} for _ in odds]
    leaves, enters = [0.0] * n, [0.0] * n
    for i, j, c in [*edges, *((j, i, c) for i, j, c in edges), *one_way]:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j].setdefault(i, 0.0)
        leaves[i] += c
        enters[j] += c
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and (odds[i] > leaves[i] + 1e-9 or -odds[i] > enters[i] + 1e-9):
            side[i] = odds[i] > 0
            for j, c in near[i].items():
                back = near[j].pop(i)
                odds[j] += c if side[i] else -back
                leaves[j] -= back
                enters[j] -= c
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if not left:
        return [bool(s) for s in side]
    spare = {i: abs(odds[i]) for i in left}
    room = {i: dict(near[i]) for i in left}
    while True:
        layer = {i: 0 for i in left if odds[i] > 0 and spare[i] > 1e-12}
        queue, reached = deque(layer), False
        while queue:
            i = queue.popleft()
            reached |= odds[i] < 0 and spare[i] > 1e-12
            for j, c in room[i].items():
                if c > 1e-12 and j not in layer:
                    layer[j] = layer[i] + 1
                    queue.append(j)
        if not reached:
            break
        _augment(odds, spare, room, layer)
    for i in left:
        side[i] = i in layer
    return [bool(s) for s in side]


def _augment(odds: list[float], spare: dict, room: dict, layer: dict) -> None:
    """Send flow along paths that go one layer down with each step, until none is left."""
    ways, tried = {i: list(room[i]) for i in layer}, dict.fromkeys(layer, 0)
    for start in [i for i, d in layer.items() if d == 0]:
        path = [start]
        while path and spare[start] > 1e-12:
            i = path[-1]
            if odds[i] < 0 and spare[i] > 1e-12:
                steps = list(zip(path, path[1:]))
                flow = min(spare[start], spare[i], *(room[a][b] for a, b in steps))
                spare[start] -= flow
                spare[i] -= flow
                for a, b in steps:
                    room[a][b] -= flow
                    room[b][a] += flow
                full = next((k for k, (a, b) in enumerate(steps) if room[a][b] <= 1e-12), None)
                if full is not None:
                    del path[full + 1 :]
                continue
            while tried[i] < len(ways[i]):
                j = ways[i][tried[i]]
                if layer.get(j) == layer[i] + 1 and room[i][j] > 1e-12:
                    path.append(j)
                    break
                tried[i] += 1
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1


def block_odds(page: Page, weights: np.ndarray) -> list[float]:
    """What words say, within `CLIP`. If they speak for no block of a page, its best sentence outside all regions is the measure."""
    odds = np.clip(features(page.blocks) @ weights, -CLIP, CLIP).tolist()
    if odds and max(odds) <= 0 and all(x <= 0 for x, _ in page.regions):
        said = [o for b, o in zip(page.blocks, odds) if not b.frame and b.region < 0 and b.linked < 0.5 and b.text[-1] in ENDS]
        more = 1 - max(said, default=1.0)
        odds = [o + more for o in odds]
    return [NEVER if b.frame else o for b, o in zip(page.blocks, odds)]


def main_text(html: str | None, weights: np.ndarray = PRIOR, tie: float = 1.5) -> str:
    page = Page(html or "")
    if not page.blocks:
        return ""
    side = min_cut([*block_odds(page, weights), *(x for x, _ in page.regions)], page.edges(tie), page.one_way())
    return " ".join(b.text for b, kept in zip(page.blocks, side) if kept)


def sample_weights(pages: DataFrame, most_pages: int) -> np.ndarray:
    """Weights fitted on at most `most_pages` pages, those of the lowest hash; whole pages are read where they lie, and only their blocks' features reach the driver."""

    def run(batches):
        for b in batches:
            for h in b.column("html").to_pylist():
                if rows := labelled(h):
                    yield pa.RecordBatch.from_arrays([pa.array([list(f) for f, _, _ in rows], pa.list_(pa.float64())), pa.array([y for _, y, _ in rows]), pa.array([n for _, _, n in rows])], names=["x", "y", "n"])

    keyed = pages.select(F.xxhash64("page_id", "url", F.xxhash64("html")).alias("key"), "html")
    last = keyed.select("key").distinct().orderBy("key").limit(most_pages).agg(F.max("key")).first()[0]
    if last is None:
        return PRIOR
    chosen = keyed.where(F.col("key") <= last).dropDuplicates(["key"]).select("html")
    rows = chosen.mapInArrow(run, "x array<double>, y boolean, n double").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    return fit([(tuple(r["x"]), r["y"], round(r["n"], 9)) for r in rows])


def extract(pages: DataFrame, most_pages: int = 300, tie: float = 1.5) -> DataFrame:
    """page_id, url, text, n_chars. The classifier is fitted on at most `most_pages` pages."""
    weights = sample_weights(pages, most_pages)

    def run(batches):
        for b in batches:
            texts = [main_text(h, weights, tie) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
