"""Main text of web pages: flat blocks, classified by a decision tree.

A page is cut into flat blocks of text at block-level tags. A block has its number of words,
its share of words inside links, the same of the blocks before and after it, and the kind of
container it stands in. Elements such as nav or footer tell a kind; class, id and role of others
only hint at one, so that words and links decide there. A tree trained on the small table of html_labels tells content from
the rest. Scripts, styles, markup, comments in the source and form controls are no text.
"""

import html
import re
from collections import Counter
from functools import lru_cache

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.llm import html_labels
from ticklane.llm.tables import ship
from ticklane.llm.trees import nested, value

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|([^<]+|<)", re.S)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is not shown, or belongs to a form.
_HIDDEN = frozenset("script style noscript template textarea select svg iframe title object math button option".split())
#: Those of them that can hold their like, and the end of one that needs no end tag.
_NESTING = frozenset("svg object math template".split())
_OPTION_END = re.compile(r"</option\b[^>]*>|(?=<option\b|</?(?:select|datalist|optgroup)\b)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ARTICLE, _MENU, _EDGE, _EXTRA, _COMMENTS, _HINT, _UNSEEN = 1, 2, 3, 4, 5, 6, 7
_KINDS = {"article": _ARTICLE, "main": _ARTICLE, "nav": _MENU, "menu": _MENU, "aside": _MENU, "header": _EDGE, "footer": _EDGE, "form": _HINT, "dialog": _EXTRA}
#: Words of a class, id or role that tell the container.
_NAMED = (
    (_COMMENTS, re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply|discussion|disqus|respond)(?:$|[\s_-])", re.I)),
    (_EXTRA, re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|share|social|form|alert)(?:$|[\s_-])", re.I)),
    (_MENU, re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|breadcrumbs?|related|widget|pagination|toc|tags)(?:$|[\s_-])", re.I)),
    (_EDGE, re.compile(r"(?:^|[\s_-])(?:header|footer|masthead|copyright)(?:$|[\s_-])", re.I)),
    (_ARTICLE, re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story)(?:$|[\s_-])", re.I)),
)
#: Names that tell what a page has or lacks, not what the element is, or from where on they do.
_STATE = re.compile(r"(?:(?<=\s)|^)(?:no|has|is|without|show|hide)[_-]\S*|[_-](?:with|without|has|no)[_-]\S*|\S*[_-](?:enabled|disabled|open|closed|on|off)(?=\s|$)", re.I)
#: Attributes of an element that a browser does not show.
_NOT_SHOWN = re.compile(r"(?:^|[\s\"'])hidden(?=$|[\s=/])|\bstyle\s*=\s*(?:\"[^\"]*|'[^']*|[^\s>]*)\b(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _kind(tag: str, attributes: str) -> int:
    kind = _KINDS.get(tag, 0)
    if attributes and tag not in ("body", "html") and _NOT_SHOWN.search(attributes):
        return _UNSEEN
    if kind <= _ARTICLE and attributes and tag not in ("body", "html"):
        for names in _ATTRIBUTE.findall(attributes):
            own = _STATE.sub("", "".join(names))
            for found, pattern in _NAMED:
                if pattern.search(own):
                    return found if found in (_ARTICLE, _COMMENTS) else _HINT
    return kind


class _Ends:
    """Where hidden elements of a page end; each kind of tag is looked up along the page once."""

    def __init__(self, page: str):
        self.page, self.unclosed, self.pairs = page, set(), {}

    def of(self, tag: str, attributes: str, at: int) -> int | None:
        """The end of the element whose start tag ends at `at`; none if it is not closed."""
        if tag in ("svg", "math") and attributes.rstrip().endswith("/"):
            return at
        if tag in _NESTING:
            if tag not in self.pairs:
                self.pairs[tag] = self._paired(tag)
            return self.pairs[tag].get(at)
        if tag in self.unclosed:
            return None
        pattern = _OPTION_END if tag == "option" else re.compile(rf"</{tag}\b[^>]*>", re.I)
        end = pattern.search(self.page, at)
        if not end:
            self.unclosed.add(tag)
        return end and end.end()

    def _paired(self, tag: str) -> dict[int, int]:
        opened, pairs = [], {}
        for m in re.compile(rf"<(/?){tag}\b([^>]*)>", re.I).finditer(self.page):
            if not m[1]:
                if not m[2].endswith("/"):
                    opened.append(m.end())
            elif opened:
                pairs[opened.pop()] = m.end()
        return pairs


class _Opened:
    """The open elements, with the kind of place that the innermost one makes.

    What is around an article does not count in it, but comments do. Else the innermost element
    counts that has a kind; a class such as content does so only where nothing else has one.
    """

    def __init__(self):
        self.tags: list[str] = []
        self.places: list[tuple[bool, bool, int, bool]] = [(False, False, 0, False)]  # unseen, comments, kind, in an article
        self.count: Counter = Counter()

    def push(self, tag: str, kind: int) -> None:
        unseen, comments, inner, article = self.places[-1]
        if kind == _ARTICLE:
            inner, article = (0 if tag in ("article", "main") else inner), True
        elif kind:
            inner = kind
        self.tags.append(tag)
        self.count[tag] += 1
        self.places.append((unseen or kind == _UNSEEN, comments or kind == _COMMENTS, inner, article))

    def close(self, tag: str) -> bool:
        """Close the innermost such element and all in it, if there is one."""
        found = self.count[tag] > 0
        while found:
            last = self.tags.pop()
            self.places.pop()
            self.count[last] -= 1
            if last == tag:
                break
        return found

    def place(self) -> int:
        unseen, comments, inner, article = self.places[-1]
        return _UNSEEN if unseen else _COMMENTS if comments else inner or (_ARTICLE if article else 0)


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """Blocks in page order: (text, words, words in links, heading, container)."""
    out, text = [], []
    linked = heading = links = 0
    opened, ends = _Opened(), _Ends(page)
    at = 0

    def flush():
        nonlocal linked
        words = html.unescape("".join(text)).split()
        place = opened.place()
        if words and place != _UNSEEN:
            out.append((" ".join(words), len(words), min(linked, len(words)), heading, place))
        text.clear()
        linked = 0

    while m := _TOKEN.match(page, at):
        at = m.end()
        closing, tag, attributes, plain = m[1], m[2], m[3], m[4]
        if plain is not None:
            text.append(plain)
            if links:
                linked += len(html.unescape(plain).split())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            links = max(0, links + (-1 if closing else 1)) if closing or not links else links
        elif tag == "br":
            text.append(" ")
        elif tag in _INLINE:
            pass
        elif closing:
            flush()
            if tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6"):
                heading = 0
            if opened.close(tag):
                links = 0
        else:
            flush()
            if tag in ("p", "li", "td", "th") and opened.tags and opened.tags[-1] == tag:
                opened.close(tag)  # such an element ends where the next one starts
            if tag in _HIDDEN:
                end = ends.of(tag, attributes, at)
                if end is not None or tag in ("script", "style"):
                    at = len(page) if end is None else end
            elif tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6"):
                heading = 1
            elif tag not in _VOID and tag not in ("p", "li", "tr", "td", "th", "dt", "dd", "body", "html"):
                kind = _kind(tag, attributes)
                in_article = tag == "header" and kind != _UNSEEN and opened.count["article"] + opened.count["main"] > 0
                opened.push(tag, 0 if in_article else kind)
            if tag in ("p", "li", "td", "th") and attributes and (kind := _kind(tag, attributes)) > _ARTICLE:
                opened.push(tag, kind)
    flush()
    return out


def featured(found: list[tuple[str, int, int, int, int]]) -> list[list[float]]:
    """Features of each block, as in html_labels."""
    shape = [(0.0, 0.0), *((float(n), k / n) for _, n, k, _, _ in found), (0.0, 0.0)]
    return [[float(c), float(h), *shape[i + 1], *shape[i], *shape[i + 2]] for i, (_, _, _, h, c) in enumerate(found)]


@lru_cache(maxsize=4)
def _fitted(app: str) -> object:
    spark = SparkSession.active()
    table = spark.createDataFrame(html_labels.rows(), "x array<double>, label double")
    tree = DecisionTreeClassifier(maxDepth=7, featuresCol="features", labelCol="label", seed=7)
    return nested(tree.fit(table.select("label", array_to_vector("x").alias("features"))).toDebugString)


def tree(spark: SparkSession):
    """The tree, trained once in a session."""
    return _fitted(spark.sparkContext.applicationId)


def main_text(page: str, model) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, x in zip(found, featured(found)) if value(model, x) >= 0.5)


def _extracted(frames, model):
    for frame in frames:
        yield frame[["page_id", "url"]].assign(page_id=frame.page_id.astype("Int64"), text=[main_text(h, model) for h in frame.html])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row, of the whole html; text is empty if there is none.

    A null html is empty. Broken markup is read as far as it goes. Rows stay as they are,
    also repeated ones and those with null ids; other columns go.
    """
    ship(pages.sparkSession)
    model = tree(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(lambda f: _extracted(f, model), "page_id long, url string, text string")
