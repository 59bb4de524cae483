"""Main text of web pages by composite text density.

The page becomes a tree (void, raw-text and unclosed elements as browsers treat
them). Elements that by name, role or class are no article text are cut off.
For every node left: characters per tag of its subtree, adjusted for links
(composite text density). A node's density sum is the sum over its children.
The node of the largest sum is the article; the smallest density on its path
from the body is the threshold, and any other branch whose nodes reach the
threshold all the way down from the body adds its own largest-sum subtree.
Inside the chosen subtrees blocks made mostly of links are left out.

Blocks come out in page order, white space inside a block is one space, two
line feeds part blocks, character references are decoded.

Defined results: null, blank and text-free pages give an empty text; a page
without tags is one block; repeated rows give repeated results.
"""

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset((
    "html body address article aside blockquote canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr li main menu nav ol p pre section summary table tbody tfoot thead tr td th ul caption "
    "legend optgroup option select").split())
CLOSES_P = BLOCK - {"html", "body", "head", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
# What an opening tag closes if it is open, up to the given containers.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
        "option": (("option",), ("select",))}
# Elements that hold no article text.
DROPPED = frozenset((
    "head script style noscript iframe template svg math canvas audio video object embed nav aside footer form button select option "
    "input textarea label dialog menu fieldset noembed noframes map").split())
_PART = (r"ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|"
         r"alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comment|comments|disqus|respond|replies|reply|sidebar|side|"
         r"widget|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|footnav|masthead|topbar|toolbar|share|sharing|social|related|"
         r"recommended|recommendations|pagination|pager|tags|copyright|disclaimer|skip|search|rating|ratings|feedback")
_UNWANTED = re.compile(rf"(?:^|[\s_-])(?:{_PART}|header|site-header|page-header)(?:$|[\s_-]|\d)", re.I)
# Whole elements are left out by name if they hold others; an advert may be any element.
CONTAINERS = frozenset("div section ul ol dl table center details figure header blockquote".split())
_ADVERT = re.compile(r"ads?|advert(?:s|isement|isements|ising)?|sponsored", re.I)
# Inside an article names are often headings turned into ids, or layout: a class must be such a name as a whole, an id one of these.
_TAIL = r"box|block|section|container|wrapper|list|area|bar|slot|unit|links?|buttons?|posts|articles|stories|form|widget|banner|thread|icons"
_WHOLE = re.compile(rf"(?:(?:post|entry|article|page|site|user|reader|social|cookie|inline|blog)[-_])?(?:{_PART})(?:[-_](?:{_TAIL}))*[-_]?\d*", re.I)
_ARTICLE_IDS = frozenset("comments comment-section disqus_thread respond sidebar newsletter cookie-notice cookie-banner ad ads advert".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|"
    r"<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)>|"
    r"</?[a-zA-Z][^>]*\Z|(?P<text>[^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class _Tree:
    """Nodes by number, parents before children; `items` lists the texts and block borders in page order."""

    def __init__(self):
        self.tag, self.parent, self.cut = ["#root"], [-1], [False]
        self.items: list[tuple[int, str]] = []
        self.open = [0]

    def start(self, tag: str, cut: bool) -> int:
        top = self.open[-1]
        self.tag.append(tag)
        self.parent.append(top)
        self.cut.append(cut or self.cut[top])
        return len(self.tag) - 1

    def pop_to(self, names, stop=()) -> None:
        """Close up to the innermost open element in `names`, unless one in `stop` comes first."""
        for k in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[k]]
            if name in names:
                del self.open[k:]
                return
            if name in stop:
                return


def _named_so(tag: str, kind: str, value: str, in_article: bool) -> bool:
    """Whether a class or id says that the element is no article text."""
    if kind == "class" and any(_ADVERT.fullmatch(c) for c in value.split()):
        return True
    if tag not in CONTAINERS:
        return False
    if not in_article:
        return _UNWANTED.search(value) is not None
    return value.lower() in _ARTICLE_IDS if kind == "id" else any(_WHOLE.fullmatch(c) for c in value.split())


def _unwanted(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and _named_so(tag, name, value, in_article):
            return True
        if name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def parse(page: str) -> _Tree:
    tree, at, n, articles = _Tree(), 0, len(page), 0
    match = _TOKEN.match
    while at < n:
        m = match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            tree.items.append((tree.open[-1], text))
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag in ("article", "main"):
                articles = max(0, articles - 1)
            if tag == "p" and not any(tree.tag[k] == "p" for k in tree.open):
                continue
            if tag in ("br",):
                tree.items.append((tree.open[-1], " "))
            else:
                tree.pop_to((tag,), () if tag in BLOCK else BLOCK)
            if tag in BLOCK:
                tree.items.append((tree.open[-1], "\x00"))
            continue
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if tag in CLOSES_P:
            tree.pop_to(("p",), ("table", "td", "th", "div", "section", "article", "li", "body", "button"))
        if tag in ENDS:
            names, stop = ENDS[tag]
            tree.pop_to(names, stop)
        if tag in BLOCK:
            tree.items.append((tree.open[-1], "\x00"))
        if tag in VOID:
            tree.start(tag, True)
            tree.items.append((tree.open[-1], "\x00" if tag == "hr" else " "))
            continue
        node = tree.start(tag, _unwanted(tag, attrs, articles > 0))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
            continue
        if tag in ("article", "main"):
            articles += 1
        if not attrs.endswith("/") or tag in BLOCK or tag == "a":
            tree.open.append(node)
    return tree


def _density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite text density; zero counts below a fraction line stand for one."""
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + ratio * chars + math.e)
    value = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    return chars / max(tags, 1) * math.log(max(value, 1e-9)) / math.log(max(base, 1 + 1e-9))


def _link_list(tag: str, chars: int, link_chars: int, link_tags: int) -> bool:
    """Many short links and hardly anything else, as in menus; a title or paragraph that is a link is text, references are long."""
    return tag in CONTAINERS and link_tags >= 3 and link_chars > 0.6 * chars and link_chars < 30 * link_tags


def main_text(page: str | None) -> str:
    """The article of `page`, or an empty string."""
    if not page or page.isspace():
        return ""
    tree = parse(page)
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for k in range(1, n):
        linked[k] = tree.tag[k] == "a" or linked[tree.parent[k]]
    words = []
    for node, text in tree.items:
        if text == "\x00" or tree.cut[node]:
            words.append("")
            continue
        text = _html.unescape(text) if "&" in text else text
        words.append(text)
        size = len(" ".join(text.split()))
        chars[node] += size
        if linked[node]:
            link_chars[node] += size
    for k in range(n - 1, 0, -1):
        if tree.cut[k]:
            continue
        p = tree.parent[k]
        chars[p] += chars[k]
        link_chars[p] += link_chars[k]
        tags[p] += tags[k] + 1
        link_tags[p] += link_tags[k] + (tree.tag[k] == "a")
    body = next((k for k in range(n) if tree.tag[k] == "body"), 0)
    if not chars[body]:
        body = 0
    if not chars[body]:
        return ""
    ratio = link_chars[body] / chars[body]
    density = [0.0 if tree.cut[k] else _density(chars[k], tags[k], link_chars[k], link_tags[k], ratio) for k in range(n)]
    total = [0.0] * n
    for k in range(1, n):
        total[tree.parent[k]] += density[k]
    # Largest sum in each subtree; a node without children that count stands for itself.
    best, value = list(range(n)), [t if t else -1.0 for t in total]
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        if not tree.cut[k] and value[k] > value[p]:
            value[p], best[p] = value[k], best[k]
    top = best[body] if value[body] > 0 else body
    path, k = [top], top
    while k != body and k > 0:
        k = tree.parent[k]
        path.append(k)
    threshold = min(density[k] for k in path)
    chosen, waiting = {top}, [body]
    children: dict[int, list[int]] = {}
    for k in range(1, n):
        children.setdefault(tree.parent[k], []).append(k)
    while waiting:
        k = waiting.pop()
        if tree.cut[k] or density[k] < threshold or not chars[k]:
            continue
        chosen.add(best[k] if value[k] > 0 else k)
        waiting.extend(children.get(k, ()))
    inside = [False] * n
    for k in range(n):
        inside[k] = k in chosen or (k > 0 and inside[tree.parent[k]])
        if inside[k] and k not in chosen and _link_list(tree.tag[k], chars[k], link_chars[k], link_tags[k]) and density[k] < threshold:
            tree.cut[k] = True
        if k > 0 and tree.cut[tree.parent[k]]:
            tree.cut[k] = True
    blocks, run = [], []
    for (node, text), word in zip(tree.items, words):
        if text == "\x00":
            blocks.append("".join(run))
            run = []
        elif inside[node] and not tree.cut[node]:
            run.append(word)
    blocks.append("".join(run))
    return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of all `pages` (page_id, url, html); no shuffle."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars bigint")
