"""Main text of web pages by a site style tree.

A page's elements become style nodes: the path of tags and classes from the root. The pages of a host are merged by
node. A node's presentation importance is the entropy of its styles (the sequence of its children's tags) over the m
pages that have it, to base m; its content importance is one minus the mean of log(n) / log(m) over the texts it holds,
n being the pages with that text, so that text which repeats over the site counts for little. Both are mixed, and
branches below ``threshold`` are removed from each page. Pages with equal html count once. A node seen on under
``min_pages`` pages has no low importance.

Adverts, menus and readers' comments that differ from page to page have high entropy, so no importance tells them from
an article. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are therefore known
by their role as well, on every host: by tag, by role, or by a class or id all of whose words tell such a role or a
place. ``no-sidebar`` or ``share-price-report`` is no such name. A branch so named that holds the page's main element
stays, and so does a form around main, an article or a first heading. Main-text elements (article, main, and the
paragraphs and headings inside) are never removed for low importance.

Statistics are two grouped counts over (host, node, text) with partial aggregation, over the nodes of each different
page, which are written once. A page takes the removed nodes of
its layout, that is its set of nodes, by a join on (host, layout, slot): the pages of one layout spread over up to
``SLOTS`` slots by key and url, and the removed nodes are copied to the slots that its pages have, so a template that a
third of all pages share is no single task. Depth and size of a page are not limited.

Null or empty html: an empty text. Null or odd url: pages of one unnamed host. Repeated rows: a row each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprep.llm.bpe import _field
from seqprep.llm.common import written

THRESHOLD, MIN_PAGES, MIX, SLOTS = 0.4, 5, 0.9, 256
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math object video audio canvas textarea select xmp title".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br img input".split())
BAD_TAGS = set("head nav footer aside button dialog menu header".split())
BAD_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
BAD_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead comment comments reply replies disqus cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe signup login share sharing social related recommended widget toolbar pagination pager skip".split()
)
# words that may stand beside one of these in a name
PLAIN_NAMES = set(
    "area articles bar block bottom box btn button buttons card cards col column container fixed floating form global group holder "
    "inner item items js left links list main mobile module outer page panel popular posts primary right secondary section site "
    "sticky stories text thread title top unit wrap wrapper zone".split()
)
FORM, NAMED = 1, 2
TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tr td th figure figcaption header".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
BARRIER = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME = re.compile(r"[a-z]+", re.I)
SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _names(value: str) -> set[str]:
    return {w.lower() for w in NAME.findall(SPLIT.sub(" ", value))}


def _tells_role(value: str, roles: set[str]) -> bool:
    """Whether a class or id is made of words of a role and of its place alone."""
    for name in value.split():
        words = _names(name)
        if words & roles and all(w in roles or w in PLAIN_NAMES or len(w) == 1 for w in words):
            return True
    return False


def read_page(text: str | None) -> tuple[list[int], list[int], list[int], list[str], list[tuple[int, int, int]]]:
    """Elements (node, parent place), blocks (element place, text) and style features (node, style, text) of one page.

    Blocks inside removed roles are left out. A node is 0 where it must not be removed for low importance.
    """
    from xxhash import xxh64_intdigest as digest

    text = text or ""
    mask = (1 << 63) - 1
    nodes, parents, owners, texts, features = [0], [-1], [], [], []
    # per element: FORM or NAMED if its role may remove it; what it holds: 1 for main, 2 for an article or first heading
    roles, holds = [0], [0]
    # open elements: tag, path hash, place, bad, inside main, children's tags, running hash of the text inside
    stack: list[list] = [["", 0, 0, False, False, [], []]]
    parts: list[str] = []

    def flush() -> None:
        block = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if block:
            top = next((e for e in reversed(stack) if e[0] not in INLINE), stack[0])
            top[6].append(digest(block.encode(), 0))
            if not any_bad():
                owners.append(top[2])
                texts.append(block)

    def any_bad() -> bool:
        return stack[-1][3]

    def pop() -> None:
        tag, path, place, _, _, children, inside = stack.pop()
        if tag in INLINE:
            return
        whole = digest(repr(inside).encode(), 1)
        if inside:
            stack_top = next((e for e in reversed(stack) if e[0] not in INLINE), stack[0])
            stack_top[6].append(whole)
            if nodes[place]:
                style = digest(" ".join(t for i, t in enumerate(children) if i == 0 or children[i - 1] != t).encode(), 2)
                features.append((path, style & mask, whole & mask))

    at = 0
    for hit in iter(lambda: TOKEN.search(text, at), None):
        if hit.start() > at:
            parts.append(text[at : hit.start()])
        at = hit.end()
        tag = hit[2] or hit[5]
        if not tag:
            continue
        tag, closing = tag.lower(), hit[1] or hit[4]
        if tag not in INLINE:
            flush()
        elif tag in ("br", "img", "input"):
            parts.append(" ")
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    while len(stack) > k:
                        pop()
                    break
                # an inline end tag does not close blocks
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            if not (hit[3] or hit[6] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
                at = end.end() if end else (len(text) if tag in ("script", "style", "textarea", "title", "xmp") else at)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            # a block ends an open paragraph; list items, cells and rows end their like
            ends = CLOSES.get(tag, {"p"})
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends or stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    if stack[-1][0] not in ends:
                        break
                elif stack[k][0] in BARRIER.get(tag, ()) or (stack[k][0] not in INLINE and tag not in CLOSES):
                    break
        given = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(hit[3] or hit[6] or "")}
        above = stack[-1]
        main = above[4] or tag in ("article", "main")
        name, role = given.get("class", "") + " " + given.get("id", ""), given.get("role", "").lower()
        words = _names(name)
        named = tag not in ("html", "body", "article", "main") and _tells_role(name, BAD_NAMES - {"header"} if main else BAD_NAMES)
        bad = (
            above[3] or (tag in BAD_TAGS and not (tag == "header" and above[4])) or role in BAD_ROLES
            or (named and tag in INLINE) or "hidden" in given
        )
        label = f"{tag}.{'.'.join(sorted(words))}"
        path = above[1] if tag in INLINE else digest(f"{above[1]}/{label}".encode(), 3) & mask
        if tag not in INLINE:
            owner = next((e for e in reversed(stack) if e[0] not in INLINE), stack[0])
            owner[5].append(tag)
            kept = tag in ("html", "body", "article", "main") or (main and tag in TEXT_TAGS)
            nodes.append(0 if kept else path)
            parents.append(owner[2])
            roles.append(NAMED if named else FORM if tag == "form" or role == "form" else 0)
            holds.append(0)
            if tag in ("main", "article", "h1") and not bad:
                kind, up = (1 if tag == "main" else 2), owner[2]
                # an article of a comment list does not speak for what is around that list
                while up > 0 and not holds[up] & kind and (kind == 1 or roles[up] != NAMED):
                    holds[up] |= kind
                    up = parents[up]
            stack.append([tag, path, len(nodes) - 1, bad, main, [], []])
        else:
            stack.append([tag, path, above[2], bad, main, [], []])
    parts.append(text[at:])
    flush()
    while len(stack) > 1:
        pop()
    gone = [False] * len(nodes)
    for i in range(1, len(nodes)):  # parents come before their children
        gone[i] = gone[parents[i]] or (roles[i] == FORM and not holds[i]) or (roles[i] == NAMED and not holds[i] & 1)
    kept = [k for k, o in enumerate(owners) if not gone[o]]
    return nodes, parents, [owners[k] for k in kept], [texts[k] for k in kept], features


def _parsed(pages: DataFrame, key: str, url: str, page: str, content: bool) -> DataFrame:
    """Per page: host, layout and either its features (and a hash of its html) or its blocks."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))
    slot = F.pmod(F.xxhash64(F.col(key), F.col(url)), F.lit(SLOTS)).cast("int")
    narrow = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), host.alias("_host"), slot.alias("_slot"), F.col(page).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                layouts, rows = [], []
                for cell in batch.column(4):
                    text = cell.as_py()
                    nodes, parents, owners, texts, features = read_page(text)
                    used = sorted({n for n in nodes if n})
                    layouts.append(digest(repr(used).encode(), 4) >> 1)
                    if content:
                        rows.append((nodes, parents, owners, texts))
                    else:
                        styles = {(n, 0, s) for n, s, _ in features}
                        rows.append((used, digest((text or "").encode(), 5) >> 1, sorted(styles | {(n, 1, t) for n, _, t in features})))
                columns = [*(batch.column(i) for i in ((0, 1, 2, 3) if content else (2, 3))), pa.array(layouts, pa.int64())]
                names = ["_key", "_url", "_host", "_slot", "_layout"] if content else ["_host", "_slot", "_layout"]
                kinds = [("_nodes", pa.list_(pa.int64())), ("_parents", pa.list_(pa.int32())), ("_owners", pa.list_(pa.int32())), ("_texts", pa.list_(pa.string()))]
                if not content:
                    entry = pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())])
                    kinds = [("_nodes", pa.list_(pa.int64())), ("_page", pa.int64()), ("_features", pa.list_(entry))]
                    rows = [(u, h, [{"node": n, "kind": k, "value": v} for n, k, v in f]) for u, h, f in rows]
                for i, (name, kind) in enumerate(kinds):
                    columns.append(pa.array([r[i] for r in rows], kind))
                    names.append(name)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    if content:
        kind = _field(narrow, "_key") + ", " + _field(narrow, "_url")
        return narrow.mapInArrow(run, f"{kind}, _host string, _slot int, _layout bigint, _nodes array<bigint>, _parents array<int>, _owners array<int>, _texts array<string>")
    return narrow.mapInArrow(run, "_host string, _slot int, _layout bigint, _nodes array<bigint>, _page bigint, _features array<struct<node:bigint,kind:int,value:bigint>>")


def importance(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """The style trees as (_host, node, pages, importance), and the layouts as (_host, _layout, _nodes, _slots)."""
    parsed = _parsed(pages, key, url, page, content=False)
    once = parsed.groupBy("_host", "_layout", "_page").agg(F.any_value("_nodes").alias("_nodes"), F.any_value("_features").alias("_features"), F.collect_set("_slot").alias("_slots"))
    # read for the layouts and for the counts: the pages are not parsed again for the second
    once = written(once, "style-pages", "zstd")
    slots = once.select("_host", "_layout", "_nodes", F.explode("_slots").alias("_slot")).groupBy("_host", "_layout")
    layouts = slots.agg(F.any_value("_nodes").alias("_nodes"), F.collect_set("_slot").alias("_slots"))
    seen = once.select("_host", F.explode("_features").alias("x")).groupBy("_host", "x.node", "x.kind", "x.value").agg(F.count("*").alias("n"))
    style, text = F.col("kind") == 0, F.col("kind") == 1
    n = F.col("n").cast("double")
    merged = seen.groupBy("_host", "node").agg(
        F.sum(F.when(style, n)).alias("m"), F.sum(F.when(style, n * F.log(n))).alias("styles"), F.avg(F.when(text, F.log(n))).alias("texts")
    )
    base = F.log("m")
    presentation = F.greatest(F.lit(0.0), (base - F.col("styles") / F.col("m")) / base)
    value = F.when(F.col("m") < min_pages, 1.0).otherwise((1 - MIX) * presentation + MIX * (1 - F.least(F.col("texts") / base, F.lit(1.0))))
    return merged.select("_host", "node", F.col("m").cast("long").alias("pages"), value.alias("importance")), layouts


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(key, url, text, n_chars): one row per page, its blocks in page order joined by a line feed."""
    tree, layouts = importance(pages, key, url, page, min_pages)
    low = tree.where(F.col("importance") < threshold).select("_host", F.col("node").alias("_node"))
    removed = (
        layouts.select("_host", "_layout", "_slots", F.explode("_nodes").alias("_node")).join(low, ["_host", "_node"])
        .groupBy("_host", "_layout").agg(F.collect_set("_node").alias("_removed"), F.any_value("_slots").alias("_slots"))
        .select("_host", "_layout", "_removed", F.explode("_slots").alias("_slot"))
    )
    blocks = _parsed(pages, key, url, page, content=True).join(removed, ["_host", "_layout", "_slot"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for nodes, parents, owners, texts, removed in zip(*(batch.column(i).to_pylist() for i in range(2, 7))):
                if removed:
                    gone = set(removed)
                    low_at = [False] * len(nodes)
                    for i in range(1, len(nodes)):  # parents come before their children
                        low_at[i] = low_at[parents[i]] or nodes[i] in gone
                    texts = [t for o, t in zip(owners, texts) if not low_at[o]]
                out.append("\n".join(texts))
            sizes = pa.array([len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), sizes], names=["_key", "_url", "text", "n_chars"])

    kind = ", ".join(_field(blocks, c) for c in ("_key", "_url"))
    found = blocks.select("_key", "_url", "_nodes", "_parents", "_owners", "_texts", "_removed").mapInArrow(run, f"{kind}, text string, n_chars bigint")
    return found.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", "n_chars")
