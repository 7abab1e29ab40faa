"""Operator 6: main text of web pages by equivalence classes of template tokens.

A page is cut into blocks: runs of text between block tags, each under the path of the elements around it. Its tokens are the
paths that occur in it and the texts under their paths.

1. Every different page content of a host counts its tokens (copies count once). A token's occurrence vector over the contents of its
   host is kept as a sum of hashes of (content, count), next to the number of contents and the mean place, so no vector is ever held:
   sums are aggregated before they are shuffled.
2. Tokens on at least half of a host's pages (and on three pages) may be of its template; their number is bounded by twice the
   mean number of tokens of a page. Tokens with equal vectors form an equivalence class. A class is valid if it has at least
   two tokens at different mean places, or is on all pages; valid classes are nested by the spans of their places, and one that
   crosses the border of the class around it is dropped. The tokens of the nested classes are the template.
3. What the template leaves are the slots. Slots of menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and
   reader comments are told by element, role, ``hidden`` or the last word of a name in class and id (fixed values below) and left out; texts of the template
   are left out unless they stand in an article or main element, where even what all pages share is the page's own text. If a page has an article or
   main element, only slots in it stay.

A page of a host with too few pages has no template: slots and elements alone decide. Null html counts as empty: empty text. Null or
odd urls share one host. Repeated rows are pages of their own. Unclosed and wrongly nested tags are closed by the elements around
them. Extra columns are kept; the text's name gets underscores in front if it is taken.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrace.llm.common import fresh, pairs, table, text_key
from sparktrace.session import BROADCAST_ROWS, cut

LEAST_PAGES = 3
LEAST_SHARE = 0.5

# Elements by what they are in a page.
MAIN = {"article", "main"}
LEFT_OUT = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "dialog", "menu", "option", "title"}
LEFT_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
LEFT_OUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion",
    "cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "sidebar", "aside", "widget",
    "header", "masthead", "footer", "copyright", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "share", "sharing",
    "social", "related", "recommended", "search", "searchform", "form",
}
#: Of these, what an article element itself may be, and what is no site header in an article.
READERS_WORDS = {"ad", "ads", "advert", "advertisement", "comment", "comments", "commentlist", "disqus", "promo", "reply", "replies", "respond", "sponsored"}
TITLE_WORDS = {"header", "masthead", "banner"}
#: Words at the end of a name that say nothing of what it is, and words at its beginning that speak of the page around.
NEUTRAL_WORDS = {
    "area", "articles", "author", "bar", "block", "body", "bottom", "box", "button", "buttons", "column", "container", "content", "count", "date", "dialog",
    "heading", "icon", "icons", "inner", "item", "items", "label", "left", "link", "links", "list", "main", "meta", "outer", "panel", "posts", "reading", "right", "row",
    "section", "slot", "stories", "text", "thread", "title", "top", "unit", "wrap", "wrapper",
}
SPEAKING_WORDS = {"has", "hide", "is", "no", "not", "show", "with", "without"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "input", "ruby", "rb", "rt", "rp",
}
#: Elements that a new one of the given name closes, up to the nearest of the second set.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

_tags = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
_attributes = re.compile(r"""(class|id|role|style)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_hidden = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_quoted = re.compile(r"\"[^\"]*\"|'[^']*'")
_words = re.compile(r"[a-z0-9]+")


class Element:
    """An open element: its name, path, whether it is left out and whether it is in a main element."""

    __slots__ = ("name", "path", "out", "main")

    def __init__(self, name: str, path: str, out: bool, main: bool):
        self.name, self.path, self.out, self.main = name, path, out, main


def names_left_out(names: str, article: bool, in_main: bool) -> bool:
    """Whether one of the names in class and id says that an element is left out.

    A name is what its last word says, without numbers and words that say nothing (``comment-list-2`` is a comment, ``article-body``
    an article); names that speak of the page (``with-sidebar``) say nothing of the element.
    """
    words_of = READERS_WORDS if article else LEFT_OUT_WORDS
    for name in names.split():
        words = _words.findall(name)
        if not words or words[0] in SPEAKING_WORDS:
            continue
        while len(words) > 1 and (words[-1] in NEUTRAL_WORDS or words[-1].isdigit()):
            words.pop()
        if words[-1] in words_of and not (in_main and words[-1] in TITLE_WORDS):
            return True
    return False


def _opened(name: str, attributes: str, above: Element) -> Element:
    said = {k.lower(): v.strip("\"'").lower() for k, v in _attributes.findall(attributes)} if "=" in attributes else {}
    names = f"{said.get('class', '')} {said.get('id', '')}".strip()
    is_main = name in MAIN or said.get("role") in MAIN
    out = above.out or name in LEFT_OUT or said.get("role") in LEFT_OUT_ROLES or (name == "header" and not above.main)
    if not out and attributes and (_hidden.search(_quoted.sub("", attributes)) or "display:none" in said.get("style", "").replace(" ", "")):
        out = True
    if not out and names and name not in ("html", "body", "main"):
        out = names_left_out(names, is_main, above.main)
    main = above.main or is_main and not out
    if name in INLINE and not names:
        return Element(name, above.path, out, main)
    return Element(name, f"{above.path}/{name}{'.' + names if names else ''}", out, main)


def blocks_of(page: str | None) -> list[tuple[str, bool, bool, str]]:
    """(path, left out, in a main element, text) of every block with text, in page order."""
    stack = [Element("", "", False, False)]
    found: list[tuple[str, bool, bool, str]] = []
    parts: list[str] = []
    held = stack[0]

    def end() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append((held.path, held.out, held.main, text))
            parts.clear()

    at, page = 0, page or ""
    for tag in _tags.finditer(page):
        if tag.start() > at:
            if not parts:
                held = stack[-1]
            parts.append(page[at : tag.start()])
        at = tag.end()
        closing, name = tag.group(2), tag.group(3)
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            end()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    if stack[-1].out != stack[depth - 1].out:
                        end()
                    del stack[depth:]
                    break
            continue
        if name == "p" or name in CLOSED_BY:
            closes, bound = CLOSED_BY.get(name, ({"p"}, set()))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in closes:
                    del stack[depth:]
                    break
                if stack[depth].name in bound or (name == "p" and stack[depth].name not in INLINE):
                    break
        if name in VOID or tag.group(4).rstrip().endswith("/") and name in ("path", "circle", "use"):
            continue
        element = _opened(name, tag.group(4), stack[-1])
        if element.out != stack[-1].out:
            end()
        stack.append(element)
    if at < len(page):
        if not parts:
            held = stack[-1]
        parts.append(page[at:])
    end()
    return found


def token(path: str, text: str) -> int:
    """Signed 64-bit number of a text under a path; an empty text stands for the path itself."""
    return xxhash.xxh3_64_intdigest(f"{path}\x00{text}") - (1 << 63)


def _host() -> str:
    return r"lower(coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), ''))"


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, place, vector): a row for each distinct token of each page."""

    def run(batches):
        for batch in pairs(batches):
            rows = []
            for host, key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: dict[int, list] = {}
                blocks = blocks_of(page)
                for i, (path, _, _, text) in enumerate(blocks):
                    for t, is_text in ((token(path, ""), False), (token(path, text), True)):
                        seen.setdefault(t, [is_text, (i + 0.5) / len(blocks), 0])[2] += 1
                rows += [(host, t, s, place, xxhash.xxh3_64_intdigest(key + b"%d" % n) >> 24) for t, (s, place, n) in seen.items()]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "token", "is_text", "place", "vector"])

    return contents(pages).mapInArrow(run, "host string, token bigint, is_text boolean, place double, vector bigint")


def contents(pages: DataFrame) -> DataFrame:
    """(host, key, html): every page content of a host once, so that copies don't make a template of their text.

    Contents that occur once, nearly all, stay where they are; of the others one copy is sent per task.
    """
    keyed = pages.select(F.expr(_host()).alias("host"), text_key(F.col("html")).alias("key"), "html")
    repeated = cut(keyed.groupBy("host", "key").agg(F.count("*").alias("copies")).filter("copies > 1").drop("copies"))
    few = repeated.count() <= BROADCAST_ROWS
    known = F.broadcast(repeated) if few else repeated
    single = keyed.join(known, ["host", "key"], "left_anti")
    several = keyed.join(known, ["host", "key"], "left_semi").groupBy("host", "key").agg(F.first("html").alias("html"))
    return single.unionByName(several)


def nested_template(tokens: pd.DataFrame) -> list[int]:
    """Texts of the valid, nested equivalence classes of one host's frequent tokens."""
    classes = []
    for _, members in tokens.groupby("vector"):
        on_all = bool((members["pages"] == members["host_pages"]).all())
        if on_all or len(members) > 1 and members["place"].nunique() > 1:
            classes.append((members["place"].min(), members["place"].max(), members))
    template, around = [], []
    for low, high, members in sorted(classes, key=lambda c: (c[0], -c[1])):
        while around and around[-1] < low:
            around.pop()
        if around and high > around[-1]:  # it crosses the border of the class around it: not nested
            continue
        around.append(high)
        template += members.loc[members["is_text"], "token"].tolist()
    return template


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = LEAST_SHARE) -> DataFrame:
    """(host, template): the texts (token numbers) of each host's template."""
    counts = page_tokens(pages).groupBy("host", "token", "is_text").agg(
        F.count("*").alias("pages"), F.sum("vector").alias("vector"), F.avg("place").alias("place")
    )
    hosts = pages.groupBy(F.expr(_host()).alias("host")).agg(F.count_distinct(text_key(F.col("html"))).alias("host_pages"))
    frequent = counts.filter(F.col("pages") >= least_pages).join(hosts, "host").filter(F.col("pages") >= share * F.col("host_pages"))

    def deduce(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "template": [nested_template(group)]})

    return frequent.groupBy("host").applyInPandas(deduce, "host string, template array<bigint>")


def main_text(blocks: list[tuple[str, bool, bool, str]], template: set[int]) -> str:
    stay = [b for b in blocks if not b[1] and (b[2] or token(b[0], b[3]) not in template)]
    if any(b[2] for b in stay):
        stay = [b for b in stay if b[2]]
    return "\n\n".join(b[3] for b in stay)


def extract(pages: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the main text in place of the html."""
    source = pages.withColumn("html", F.col("html").cast("string")).withColumn("url", F.col("url").cast("string"))
    made = cut(templates(source.select("url", "html")).filter(F.size("template") > 0))
    host, template = fresh(pages, "host", "template")
    # Templates are one row per host; hosts with very many pages are split by the join.
    joined = source.withColumn(host, F.expr(_host())).join(made.select(F.col("host").alias(host), F.col("template").alias(template)), host, "left")
    kept = [f for f in pages.schema.fields if f.name != "html"]
    (text,) = fresh(pages.drop("html"), text)
    schema = T.StructType([*kept, T.StructField(text, T.StringType(), False)])

    def run(batches):
        for batch in pairs(batches):
            texts = [main_text(blocks_of(page), set(t or ())) for page, t in zip(batch.column("html").to_pylist(), batch.column(template).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)


def op6_html(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
