"""Main text of web pages by consensus paths of their hosts.

Every page is read into text blocks below a tree of generalised paths (tag and
first class or id, digits as #).  Menus, headers, footers, asides, forms,
scripts, styles and what roles or ``hidden`` name as such are left out as they
are read.  A class or id that names a notice, an advert, a sidebar or comments
is a suspicion only: containers named so without doubt are left out unless the
page has no other text, all others only if they are mostly links or if their
text recurs on at least half of the host's pages.

The page votes for the path of the lowest container that holds its heading and
nearly all of its text, and names the containers beside it.  Votes are counted
per host in Spark; pages are then read again and give the text below their
host's winning path, if nearly all that it leaves out stands in containers that
at least half of its voters leave out.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, stage_table

# fixed values: element names by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var label map object math mi mn mo ms mtext mrow mfrac msqrt mroot msub "
                   "msup msubsup munder mover munderover semantics annotation".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption address summary ul ol dl".split())
LEFT_OUT = frozenset("nav header footer aside form noscript template svg canvas button select dialog menu head audio "
                     "video".split())
MAIN = frozenset("article main".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                           "toolbar".split())
# fixed values: words of class and id names that make a container suspect
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination popup promo promotion related reply replies respond "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
# fixed values: last words that leave no doubt, and words that say only where or how such a container stands
SURE_WORDS = frozenset("advert adverts advertisement advertisements adsense breadcrumb breadcrumbs comments disqus gdpr navbar "
                       "pagination sidebar".split())
FRAME_WORDS = frozenset("area articles bar block bottom box button buttons card center column container first form global group "
                        "holder icons inner item items last latest left line link links list main module outer page pages panel "
                        "placeholder popular posts primary rail reader recent right row secondary section site slot small stories "
                        "strip text thread title tools top user wrap wrapper zone".split())
NOT_MEANT = frozenset("no has with without".split())
ARTICLE_WORDS = frozenset("article post entry story".split())
TITLE_OWNERS = frozenset("article post entry story content".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
                 r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""")
NAMING = re.compile(r"class|id\s*=|hidden|role|style", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+")
DIGITS = re.compile(r"[0-9]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
#: Open elements that the start of one ends, up to the elements that bound them.
ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}),
        "td": ("td th", {"table", "tr"}), "th": ("td th", {"table", "tr"}), "option": ("option", {"select"})}

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEARLY = 0.9  # share of the text that a container holds, or that the host's path explains


def suspicion(name: str) -> int:
    """Of a class or id name: 2 names something left out, 1 perhaps, 0 doesn't."""
    words = [w.lower() for w in CAMEL.split(name) if w and not w.isdigit()]
    if not words or words[0] in NOT_MEANT or (words[-1] == "header" and words[0] in TITLE_OWNERS):
        return 0
    if words[0] not in LEFT_OUT_WORDS and words[-1] not in LEFT_OUT_WORDS:
        return 0
    return 2 if words[-1] in SURE_WORDS or all(w in LEFT_OUT_WORDS or w in FRAME_WORDS for w in words) else 1


def _tag(name: str) -> str:
    return re.split(r"[.#]", name)[0]


def _named(name: str, words: frozenset) -> bool:
    parts = [w.lower() for w in CAMEL.split(name.replace("#", " ")) if w][1:]
    return bool(parts) and (parts[0] in words or parts[-1] in words)


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class Page:
    """Text blocks of a page below the tree of its generalised paths.

    Paths are numbered, parents first; the root is 0.  ``key`` names a path by
    a 64-bit hash, so that paths of deep pages cost no more than others.
    """

    def __init__(self) -> None:
        self.parent, self.name, self.key, self.doubt = [-1], [""], [0], [0]
        self.container, self.heading = [True], [""]
        self.below: list[dict[str, int]] = [{}]
        self.blocks: list[tuple[int, str, int]] = []  # path, text, characters of it in links

    def child(self, at: int, name: str, doubt: int) -> int:
        """The path of an element ``name`` below path ``at``."""
        got = self.below[at].get(name)
        if got is None:
            got = self.below[at][name] = len(self.parent)
            tag = _tag(name)
            self.parent.append(at)
            self.name.append(name)
            self.key.append(_hash(self.key[at].to_bytes(8, "little", signed=True) + name.encode("utf-8", "surrogatepass")))
            self.doubt.append(doubt)
            self.container.append(self.container[at] and tag not in TEXT_BLOCKS)
            self.heading.append(self.heading[at] or (tag if tag in HEADINGS else ""))
            self.below.append({})
        else:
            self.doubt[got] = max(self.doubt[got], doubt)
        return got

    def upward(self, values: list[int]) -> list[int]:
        """Sums over each path and all below it."""
        for n in range(len(values) - 1, 0, -1):
            values[self.parent[n]] += values[n]
        return values

    def downward(self, own: list[bool]) -> list[bool]:
        """Whether it holds for a path or any above it."""
        for n in range(1, len(own)):
            own[n] = own[n] or own[self.parent[n]]
        return own

    def weights(self, blocks: list[tuple[int, str, int]]) -> list[int]:
        """Characters outside links that stand in each path itself."""
        own = [0] * len(self.parent)
        for n, text, links in blocks:
            own[n] += max(0, len(text) - 2 * links)
        return own

    def kept(self, recurring: frozenset[int] = frozenset()) -> list[tuple[int, str, int]]:
        """The blocks outside suspect containers that are left out.  A container
        named without doubt stays if it holds the page's only ``main`` element,
        or, on a page without text elsewhere, a heading, else the most text."""
        if not any(self.doubt):
            return self.blocks
        count = len(self.parent)
        chars, links = [0] * count, [0] * count
        for n, text, linked in self.blocks:
            chars[n] += len(text)
            links[n] += linked
        self.upward(chars), self.upward(links)
        out = [d == 2 or d == 1 and (2 * links[n] >= chars[n] or self.key[n] in recurring) for n, d in enumerate(self.doubt)]
        own = self.weights(self.blocks)
        gone = self.downward(list(out))
        heavy = self.upward(list(own))
        mains = [n for n in range(count) if _tag(self.name[n]) == "main" and heavy[n]]
        stay = 0
        if mains and all(gone[n] for n in mains):
            stay = max(mains, key=lambda n: (heavy[n], -n))
        elif not any(own[n] and not gone[n] for n in range(count)):
            owner = [0] * count  # the innermost container left out
            held = [0] * count
            for n in range(1, count):
                owner[n] = n if out[n] else owner[self.parent[n]]
                held[owner[n]] += own[n]
            titled = {owner[n] for n, _, _ in self.blocks if self.heading[n]}
            stay = max(range(count), key=lambda n: (n in titled, held[n], -n))
        while stay > 0:
            out[stay] = False
            stay = self.parent[stay]
        gone = self.downward(out)
        return [b for b in self.blocks if not gone[b[0]]]

    def suspects(self) -> list[tuple[int, int]]:
        """(path key, hash of the text below) of the containers that may be left out."""
        if 1 not in self.doubt:
            return []
        sums = [0] * len(self.parent)
        for n, text, _ in self.blocks:
            sums[n] += _hash(text.encode("utf-8", "surrogatepass"))
        self.upward(sums)
        return [(self.key[n], ((sums[n] + (1 << 63)) % (1 << 64)) - (1 << 63)) for n, d in enumerate(self.doubt) if d == 1 and sums[n]]


def _element(tag: str, attributes: str, inside: Counter, forms: bool) -> tuple[str, bool, int]:
    """(generalised name, left out, suspicion) of a start tag."""
    main = inside["article"] > 0 or inside["main"] > 0
    own_part = (tag in ("header", "dialog") and main or tag == "footer" and inside["blockquote"] > 0 or tag == "form" and forms)
    name, out, doubt = tag, tag in LEFT_OUT and not own_part, 0
    if attributes.strip():
        a = {}
        for k, x, y, z, hidden in ATTRIBUTE.findall(attributes):
            a.setdefault("hidden" if hidden else k.lower(), x or y or z)
        classes, own = a.get("class", "").split(), a.get("id", "").strip()
        if classes:
            name = f"{tag}.{DIGITS.sub('#', classes[0])}"
        elif own:
            name = f"{tag}#{DIGITS.sub('#', own)}"
        if tag not in MAIN and tag not in ("html", "body"):
            out = (out or a.get("role", "").lower() in LEFT_OUT_ROLES or "hidden" in a or a.get("aria-hidden") == "true"
                   or re.search(r"display\s*:\s*none", a.get("style", ""), re.I) is not None)
            doubt = max(map(suspicion, [*classes, own]))
            if doubt == 2 and any(_named(f"{tag}.{x}", TITLE_OWNERS) and not suspicion(x) for x in classes):
                doubt = 1
    return name.replace("/", "-"), out, doubt


def blocks(page: str, forms: bool = False) -> Page:
    """Text blocks in page order.  White space inside a block is one space; a
    line break is white space.  ``forms``: keep what stands in forms."""
    out = Page()
    stack: list[tuple[str, int, bool]] = []  # tag, path, left out from here on
    inside: Counter = Counter()  # open elements by tag
    piece: list[str] = []
    links = depth_a = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal links
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                out.blocks.append((stack[-1][1] if stack else 0, text, links))
            piece.clear()
        links = 0

    def pop_to(k: int) -> None:
        while len(stack) > k:
            inside[stack.pop()[0]] -= 1

    def say(raw: str) -> None:
        nonlocal links
        if raw and not (stack and stack[-1][2]):
            text = html.unescape(raw) if "&" in raw else raw
            piece.append(text)
            if depth_a:
                links += len(text.strip())

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing:
                close = _RAW_END[tag].search(page, at)
                at = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                say(" " if tag == "br" else "")
            continue
        plain = not attributes or not NAMING.search(attributes)
        if tag in INLINE and (closing or plain) and not inside[tag]:
            if tag == "a":
                depth_a = 0 if closing else 1
            continue
        if tag not in INLINE:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1) if inside[tag] else ():
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag not in INLINE:
            depth_a = 0
            while stack and (stack[-1][0] in INLINE):
                pop_to(len(stack) - 1)
            if stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
            if tag in ENDS and any(inside[x] for x in ENDS[tag][0].split()):
                names, bounds = ENDS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in bounds:
                        break
                    if stack[k][0] in names.split():
                        pop_to(k)
                        break
        name, left_out, doubt = _element(tag, attributes, inside, forms)
        if tag in INLINE:  # a part of a sentence is left out only without doubt
            left_out = left_out or doubt == 2
            if not left_out:
                depth_a = 1 if tag == "a" else depth_a
                if not inside[tag]:
                    continue
        if not attributes.rstrip().endswith("/") or tag not in ("path", "use"):
            inside[tag] += 1
            above = stack[-1][1] if stack else 0
            stack.append((tag, above if tag in INLINE else out.child(above, name, doubt), left_out or bool(stack and stack[-1][2])))
    flush()
    return out


def best_path(page: Page, kept: list[tuple[int, str, int]]) -> int:
    """From the root on, the heaviest child that keeps the heading, while it
    holds ``NEARLY`` all of the page's text and nothing stands beside it but
    containers; an article or main element may hold a quarter, and a container
    named like one, with the heading, half of its parent's.  What stands in an
    article is never divided."""
    own = page.weights(kept)
    direct = [0] * len(own)  # text that stands in a container, in no lower one
    for n, weight in enumerate(own):
        while not page.container[n]:
            n = page.parent[n]
        direct[n] += weight
    total = page.upward(own)
    none = ("z", len(kept))
    first = [none] * len(total)  # highest heading below each path, the first of its rank
    for i, (n, _, _) in enumerate(kept):
        if page.heading[n]:
            first[n] = min(first[n], (page.heading[n], i))
    for n in range(len(first) - 1, 0, -1):
        first[page.parent[n]] = min(first[page.parent[n]], first[n])
    here, base = 0, total[0]
    while True:
        tag = _tag(page.name[here])
        inner = [n for n in page.below[here].values() if page.container[n] and total[n]]
        within = here > 0 and (tag in MAIN or _named(page.name[here], ARTICLE_WORDS))
        if within:
            inner = [n for n in inner if tag == "main" and _tag(page.name[n]) == "article"]
        if not inner:
            return here
        top = max(inner, key=lambda n: (total[n] * (2 if _tag(page.name[n]) in MAIN else 1), page.name[n]))
        main, heads = _tag(page.name[top]) in MAIN, first[here] != none
        if heads and first[top] != first[here] and not (main and not within and first[top][0] == first[here][0]):
            return here
        if within:
            enough = total[top] >= NEARLY * total[here]
        elif main:
            enough = total[top] >= 0.25 * total[here]
        elif heads and _named(page.name[top], TITLE_OWNERS):
            enough = total[top] >= 0.5 * total[here]
        else:
            enough = total[top] >= NEARLY * base and direct[here] == 0
        if not enough:
            return here
        if main or within or _named(page.name[top], TITLE_OWNERS):
            base = total[top]
        here = top


def sides(page: Page, main: int) -> list[int]:
    """For each path the outermost one on it that isn't above the main container."""
    above = {0}
    n = main
    while n > 0:
        above.add(n)
        n = page.parent[n]
    got = [0] * len(page.parent)
    for n in range(1, len(got)):
        got[n] = n if n in above or page.parent[n] in above else got[page.parent[n]]
    return got


def read_page(page: str) -> Page:
    found = blocks(page)
    return found if found.blocks else blocks(page, forms=True)


def main_text(text: str, path: int | None, known: list[int] | None = None, recurring: list[int] | None = None) -> str:
    """The blocks below the host's path.  A page without text there, or with
    text of its own best container neither there nor in the host's ``known``
    sides (more than the rest that ``NEARLY`` leaves), gives that container's."""
    page = read_page(text)
    kept = page.kept(frozenset(recurring or ()))
    if not kept:
        return ""
    count = len(page.parent)
    total = page.upward(page.weights(kept))
    own = want = best_path(page, kept)
    named = {page.key[n]: n for n in range(count)}.get(path) if path is not None else None
    if named is not None and total[named]:
        in_own, in_named = (page.downward([n == x for n in range(count)]) for x in (own, named))
        side, sure = sides(page, named), set(known or ())
        lost = sum(max(0, len(t) - 2 * links) for n, t, links in kept
                   if in_own[n] and not in_named[n] and page.key[side[n]] not in sure)
        if lost <= (1 - NEARLY) * total[own]:
            want = named
    below = page.downward([n == want for n in range(count)])
    return "\n\n".join(t for n, t, _ in kept if below[n])


def host_of(url: Column) -> Column:
    """Lower-case host of a url; null when there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


#: Rows of a page's vote: its path, a container beside it, a suspect container with its text, the page itself.
PATH, SIDE, SUSPECT, PAGE = 0, 1, 2, 3
VOTES = "host string, kind int, path long, key long, text long, page long, weight long"


def page_votes(text: str) -> list[tuple[int, int, int, int, int, int]]:
    """(kind, path, key, text, page, weight) rows of a page."""
    page = read_page(text)
    kept = page.kept()
    same = _hash(text.encode("utf-8", "surrogatepass"))
    rows = [(PAGE, 0, 0, 0, same, 0)] + [(SUSPECT, 0, key, said, same, 0) for key, said in page.suspects()]
    best = best_path(page, kept) if kept else 0
    if best:
        rows.append((PATH, page.key[best], 0, 0, 0, page.upward(page.weights(kept))[best]))
        below, side = page.downward([n == best for n in range(len(page.parent))]), sides(page, best)
        rows += [(SIDE, page.key[best], key, 0, 0, 0) for key in {page.key[side[n]] for n, _, _ in kept if not below[n]}]
    return rows


def _votes(batches):
    for b in batches:
        hosts, rows = [], []
        for host, page in zip(b.column("host").to_pylist(), b.column("html")):
            found = page_votes(page.as_py() or "")
            rows += found
            hosts += [host] * len(found)
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
            ["host", "kind", "path", "key", "text", "page", "weight"])


def host_paths(pages: DataFrame, stages: Stages) -> DataFrame:
    """(host, path, sides, recurring): the path with most votes of the host's
    pages, then most text; what at least half of its voters leave out beside
    it; the suspect containers whose text is the same on at least half of the
    host's different pages, and on two.  Both lists are at most twice as long
    as the mean of what the host's pages name."""
    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")) \
        .where("host IS NOT NULL").mapInArrow(_votes, VOTES)
    counted = stages.table(votes.groupBy("host", "kind", "path", "key", "text", "page")
                           .agg(F.count("*").alias("votes"), F.sum("weight").alias("weight")), "host-votes")

    def kind(k: int) -> DataFrame:
        return counted.where(F.col("kind") == k)

    known = kind(PAGE).groupBy("host").agg(F.count("*").alias("pages"))
    best = kind(PATH).groupBy("host").agg(F.max_by(F.struct("path", "votes"), F.struct("votes", "weight", "path")).alias("best")) \
        .select("host", "best.path", F.col("best.votes").alias("voters"))
    beside = kind(SIDE).join(best, ["host", "path"]).where("2 * votes >= voters").groupBy("host") \
        .agg(F.collect_list("key").alias("sides"))
    recurring = kind(SUSPECT).groupBy("host", "key", "text").agg(F.count("*").alias("same")).where("same >= 2") \
        .join(known, "host").where("2 * same >= pages").groupBy("host").agg(F.collect_set("key").alias("recurring"))
    return known.join(best, "host", "left").join(beside, "host", "left").join(recurring, "host", "left") \
        .select("host", "path", "sides", "recurring")


def _extract(batches):
    for b in batches:
        texts = [main_text(page.as_py() or "", path.as_py(), beside.as_py(), again.as_py())
                 for page, path, beside, again in zip(b.column("html"), b.column("path"), b.column("sides"), b.column("recurring"))]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, ...) -> page_id, url, text, n_chars, one row
    per input row.

    Null or empty html gives an empty text; a page without a host (null or odd
    url) uses its own best path; null page_ids stay null; repeated rows vote as
    often as they occur and are extracted alike; other columns are ignored.
    The table of hosts is written first; Spark broadcasts it only when its
    measured size is below the session's threshold, and else shuffles the join.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    stages = Stages(pages.sparkSession)
    winners = stage_table(host_paths(pages, stages), "host-paths")
    stages.close()
    return pages.withColumn("host", host_of(F.col("url"))).join(winners, "host", "left") \
        .select("page_id", "url", "html", "path", "sides", "recurring") \
        .mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
