"""Main text of web pages by equivalence-class template deduction.

1. Each page is read once into blocks of text. A block has two tokens: its place, which is
   the path of block-level elements above it with their classes and ids, and its words (path
   and text).
2. Per host, tokens that occur in the same pages equally often share an occurrence vector
   and form an equivalence class. Vectors are compared by a hash whose halves add up page by
   page, so a host with a third of all pages is counted in every task and merged. Classes of
   several tokens that span enough of the host's pages go on.
3. A second look at the pages validates classes: their tokens must come in one order, again
   and again, and a class may not cross one that spans more pages, but lie within one slot
   of it. Valid classes, nested so, are the host's template. Its tokens part the pages into
   slots; texts that are tokens of a class on nearly all pages are fixed, as they are
   template, not data.
4. Which slots are the article? A third look adds up each slot's text: slots that hold
   mostly links are menus. The main box is the innermost element that holds nearly all of the
   host's running text, without what is fixed. Slots in the main box are content, and so are
   slots of running text or titles elsewhere. Names only break ties: within the main box,
   elements that their tag, class or id marks (adverts, forms, comments, ...) are left out.
   Where the page has an article element, that is the content, whatever the box holds
   besides; within it headings and its own header stay, and a class or id marks a part only
   if it is such a word itself. A fixed text inside an article element is the
   article's (headings, list items), unless it comes behind all of its own text and a marked
   part.
5. A last map puts the content slots' blocks together.

Pages are counted once per host and own text, so copies of a page under many urls and
repeated rows weigh as one page. The parsed blocks are stored, so html is read once only.

Defined cases: null or empty html gives ''; a page with a null url belongs to the host '';
rows with the same page_id are extracted each; truncated html is read to its end, a tag that the end cuts off is dropped, and a < that no
tag follows is text; pages of
a host with fewer than ``LEAST_PAGES`` distinct pages, and pages without the main box of
their host, are read by their elements alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townwire.llm.common import join_counted, map_slices, stored

#: Elements without text of their own, read as raw text up to their end tag.
RAW = frozenset("script style noscript template iframe svg textarea select title canvas".split())
#: Elements that end a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul video audio".split()
)
VOID = frozenset("hr".split())
#: An opening tag of the first kind ends an open element of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOT_CONTENT = frozenset("nav header footer aside form head menu dialog button fieldset search".split())
CONTENT = frozenset(("article", "main"))
NOT_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar sidenav side menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottombar comment comments reply replies disqus respond discussion related recommended share sharing social toolbar form search".split()
)
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Words that mark a part of an article as none of it: as a class or id of its own, or as the first word of one. Headings are never marked, and an article's own header is its title.
PARTS_WITHIN = NOT_CONTENT_WORDS - frozenset("header masthead topbar banner search form discussion respond alert notice notices".split())
FIRST_WITHIN = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies newsletter comment comments disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A quotation mark opens a value only behind an equals sign; any other is part of the tag, which ends at the next >. A < that no tag follows is text.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|[^<]+|<[a-zA-Z/][^<>]*\Z|<""", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: What such a class begins with says what its element holds or lacks, not what it is.
HOLDS = re.compile(r"(?:with|has|have|no|without)[-_]")
#: Kinds of paths; an article below n elements that only a word of their class or id marks has the kind OTHER + n.
OUT, ARTICLE, OTHER = 0, 1, 2
#: Least share of a host's pages that a class spans, the share for fixed text, and the distinct pages that a host needs for a template.
VALID, FIXED, LEAST_PAGES = 0.5, 0.9, 10
#: Tokens of the smallest class; words of running text; share of linked text from which a slot is a menu; share of the text that the main box holds.
CLASS_TOKENS, TEXT_WORDS, LINKED, MAIN = 2, 12, 0.5, 0.9
#: Elements that hold parts of a page, rather than pieces of running text.
BOXES = frozenset("body article main section div td aside nav header footer form center details".split())
TITLE = "h1"


def host_of(url: str | None) -> str:
    found = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def words_of(attributes: str) -> tuple[str, bool, bool, bool]:
    """What an element's path token shows of its attributes, whether they mark it as no content, whether only a word in them does, and whether that holds within an article too."""
    shown, out, worded, within = [], False, False, False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden":
            out = True
        elif name == "role":
            out = out or value in NOT_CONTENT_ROLES
        elif name in ("class", "id"):
            shown.append(f"{name}={re.sub(r'[0-9]+', '0', value).replace('/', '|')}")
            worded = worded or any(not HOLDS.match(x) and not NOT_CONTENT_WORDS.isdisjoint(re.split(r"[^a-z]+", x)) for x in value.split())
            within = within or any(x in PARTS_WITHIN or re.split(r"[^a-z]+", x)[0] in FIRST_WITHIN for x in value.split())
    return " ".join(shown), out, worded, within


def blocks(page: str) -> Iterator[tuple[str, int, str, int, int]]:
    """(path, kind, text, linked characters, depth of the innermost marked element) of the page's blocks in order; text is clean and not empty."""
    #: element, path, kind, marked elements that an article lifts (-1: none can), depth of the innermost marked element
    stack: list[tuple[str, str, int, int, int]] = [("", "", OTHER, 0, 0)]
    parts: list[str] = []
    linked = in_link = 0
    at, end = 0, len(page)

    def flush() -> Iterator[tuple[str, int, str, int, int]]:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                yield stack[-1][1], stack[-1][2], text, min(linked, len(text)), stack[-1][4]
        linked = 0

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            text = m[0]
            if text[0] == "<" and text != "<":
                continue  # a comment, a declaration, or a tag that the page's end cuts off
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) * bool(in_link)
            continue
        tag = tag.lower()
        if not closing:
            if tag in RAW:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = page.find(">", close.start()) + 1 if close else end
                at = at or end
            elif tag == "a":
                in_link += 1
            elif tag in ("br", "wbr"):
                parts.append(" " if tag == "br" else "")
            elif tag in BLOCKS:
                yield from flush()
                in_link = 0
                if stack[-1][0] == "p":
                    stack.pop()
                if tag in CLOSES:
                    while len(stack) > 1 and stack[-1][0] in CLOSES[tag]:
                        stack.pop()
                if tag not in VOID and not attributes.rstrip().endswith("/"):
                    shown, out, worded, within = words_of(attributes) if attributes else ("", False, False, False)
                    _, path, kind, marked, mark = stack[-1]
                    if kind not in (OUT, OTHER):  # in an article
                        worded = within and tag not in HEADINGS
                    if tag in NOT_CONTENT and not (tag == "header" and kind not in (OUT, OTHER)) or out and tag not in ("html", "body"):
                        kind, marked, mark = OUT, -1, path.count("/") + 1
                    elif worded and tag not in ("html", "body"):
                        kind, marked, mark = OUT, marked + (marked >= 0), path.count("/") + 1
                    elif tag in CONTENT and marked >= 0:
                        kind = OTHER + marked if marked else ARTICLE
                    stack.append((tag, f"{path}/{tag} {shown}".rstrip(), kind, marked, mark))
        elif tag == "a":
            in_link = max(0, in_link - 1)
        elif tag in BLOCKS:
            yield from flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
    yield from flush()


def own_blocks(found: list[tuple]) -> list[int]:
    """Where the blocks of the article stand, or without one all that aren't in page parts.

    An article below marked elements counts where none below fewer of them has running text,
    and where a page without an article elsewhere hasn't more running text elsewhere.
    """
    depth = {b[1]: 0 for b in found if b[1] not in (OUT, OTHER)}
    for _, kind, text, *_ in found:
        if kind in depth:
            depth[kind] = max(depth[kind], text.count(" "))
    most = next((k for k in sorted(depth) if depth[k] >= TEXT_WORDS), min(depth, default=ARTICLE))
    if depth and ARTICLE not in depth:
        running = [b for b in found if b[2].count(" ") >= TEXT_WORDS]
        if sum(len(b[2]) for b in running if b[1] == OTHER) > sum(len(b[2]) for b in running if b[1] in depth):
            depth.clear()  # most running text stands outside of marked elements
    return [i for i, b in enumerate(found) if b[1] in depth and b[1] <= most] or [i for i, b in enumerate(found) if b[1] == OTHER]


def without_fixed(found: list[tuple], places: list[int], fixed: list[bool]) -> list[int]:
    """places without an article's closing fixed texts: those behind its last own text and a page part."""
    last = next((k for k in range(len(places) - 1, -1, -1) if not fixed[places[k]]), None)
    if last is None:
        return places
    part = next((i for i in range(places[last], len(found)) if found[i][1] == OUT), len(found))
    return [i for i in places if i < part]


def boxes_of(found: list[tuple]) -> tuple[dict[str, list[int]], list[int]]:
    """Per box above any block: characters of running text, and of all text, that isn't linked ('' is the page). And per block the place of its innermost box in this order."""
    out: dict[str, list[int]] = {"": [0, 0]}
    at: dict[str, int] = {"": 0}
    innermost = []
    for path, _, text, linked, _ in found:
        own = len(text) - linked
        running = own if text.count(" ") >= TEXT_WORDS and linked <= LINKED * len(text) else 0
        for box in boxes_above(path):
            at.setdefault(box, len(at))
            sums = out.setdefault(box, [0, 0])
            sums[0] += running
            sums[1] += own
        innermost.append(at[box])
    return out, innermost


def boxes_above(path: str) -> list[str]:
    """The page and the boxes that a path leads through."""
    steps, out, at = path.split("/")[1:], [""], ""
    for step in steps:
        at = f"{at}/{step}"
        if step.split(" ", 1)[0] in BOXES:
            out.append(at)
    return out


PARSED = "page_id long, url string, host string, body long, page long, path array<string>, kind array<int>, text array<string>, linked array<int>, mark array<int>, place array<long>, words array<long>, boxes array<struct<box:string,running:long,own:long>>, box_at array<int>"


def parsed(pages: DataFrame) -> DataFrame:
    """One row per row of pages: its blocks, their tokens, its boxes, and hashes of its own text and of the row."""

    def run(slices):
        import xxhash

        digest = lambda s: xxhash.xxh3_64_intdigest(s) - (1 << 63)
        for x in slices:
            out: dict[str, list] = {k: [] for k in ("page_id", "url", "host", "body", "page", "path", "kind", "text", "linked", "mark", "place", "words", "boxes", "box_at")}
            for page_id, url, source in zip(x["page_id"], x["url"], x["html"]):
                found = list(blocks(source or ""))
                boxes, box_at = boxes_of(found)
                path, kind, text, linked, mark = (list(c) for c in zip(*found)) if found else ([], [], [], [], [])
                own = digest("\n".join(text[i] for i in own_blocks(found)))
                row = (
                    page_id, url, host_of(url), own, digest(f"{url}\n{source}"), path, kind, text, linked, mark,
                    [digest(p) for p in path], [digest(f"{p}\n{t}") for p, t in zip(path, text)],
                    [{"box": b, "running": r, "own": o} for b, (r, o) in boxes.items()], box_at,
                )
                for k, v in zip(out, row):
                    out[k].append(v)
            yield out

    return map_slices(pages, run, PARSED)


def of_hosts(rows: DataFrame, hosts: DataFrame, *columns: str) -> DataFrame:
    """rows of the hosts in the table (one row per host, with its number of rows): large hosts are broadcast, their rows stay where they are."""
    total = hosts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return join_counted(rows, hosts.select("host", "rows", *columns), "host", "rows", total).drop("rows")


def equivalence_classes(once: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per host with a template its candidate classes: array of (class, pages, tokens), widest first; a class is named by its least token.

    once has a row per distinct page; hosts has host, all (distinct pages) and rows.
    """

    def count(slices):
        for x in slices:
            out = {"host": x["host"], "page": x["page"], "token": [], "times": []}
            for place, words in zip(x["place"], x["words"]):
                n = Counter(place)
                n.update(words)
                out["token"].append(list(n))
                out["times"].append(list(n.values()))
            yield out

    each = map_slices(once.select("host", "page", "place", "words"), count, "host string, page long, token array<long>, times array<long>")
    seen = each.select("host", "page", F.inline(F.arrays_zip("token", "times")))
    own = F.xxhash64("page", "times")
    halves = [F.sum(x.bitwiseAND(F.lit(0xFFFFFFFF))).alias(k) for k, x in (("low", own), ("high", F.shiftright(own, 32)))]
    counted = seen.groupBy("host", "token").agg(F.count("*").alias("pages"), *halves).filter(F.col("pages") >= VALID * LEAST_PAGES)
    frequent = of_hosts(counted, hosts, "all").filter(F.col("pages") >= VALID * F.col("all"))
    classes = frequent.groupBy("host", "low", "high").agg(F.min("token").alias("class"), F.max("pages").alias("pages"), F.collect_set("token").alias("tokens"))  # at most 1 / VALID times as many tokens as a page has
    several = classes.filter(F.size("tokens") >= CLASS_TOKENS)
    return several.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.col("pages"), F.col("class"), F.col("tokens"))), asc=False).alias("classes"))


def ordered(stream: list[int], classes: list[dict]) -> dict[int, tuple[int, ...] | None]:
    """For a page's tokens in order: each class's tokens in their order, None where that isn't the same every time."""
    of = {t: k for k, c in enumerate(classes) for t in c["tokens"]}
    seen: list[list[int]] = [[] for _ in classes]
    for t in stream:
        if t in of:
            seen[of[t]].append(t)
    out = {}
    for own, c in zip(seen, classes):
        if own:
            one = own[: len(c["tokens"])]
            out[c["class"]] = tuple(one) if own == one * (len(own) // len(one)) else None
    return out


def nested(stream: list[int], classes: list[dict]) -> dict[int, tuple[int, ...] | None]:
    """The same with None where a class crosses a wider one, that is, doesn't stand within one slot of it every time. classes are ordered, the widest first."""
    of = {t: k for k, c in enumerate(classes) for t in c["tokens"]}
    n = [0] * len(classes)
    opened: list[tuple[int, ...]] = [()] * len(classes)
    crossed = [False] * len(classes)
    for t in stream:
        k = of.get(t)
        if k is not None:
            before = tuple(n[:k])  # how many tokens of the wider classes stand before it
            if n[k] % len(classes[k]["tokens"]) == 0:
                opened[k] = before
            crossed[k] = crossed[k] or opened[k] != before
            n[k] += 1
    return {c["class"]: None if crossed[k] else tuple(c["tokens"]) for k, c in enumerate(classes) if n[k]}


def stream_of(place: list[int], words: list[int]) -> list[int]:
    """A page's tokens in order."""
    return [t for pair in zip(place, words) for t in pair]


def valid_classes(looked: DataFrame, check) -> DataFrame:
    """Per host, as classes: (pages, class, tokens in order) of the classes that pass the check, ordered or nested, on every page and alike. looked: pages with their host's classes."""

    def run(slices):
        for x in slices:
            out: dict[str, list] = {k: [] for k in ("host", "class", "pages", "tokens")}
            for host, place, words, classes in zip(x["host"], x["place"], x["words"], x["classes"]):
                pages = {c["class"]: c["pages"] for c in classes}
                for name, tokens in check(stream_of(place, words), classes).items():
                    for k, v in zip(out, (host, name, pages[name], tokens)):
                        out[k].append(v)
            yield out

    seen = map_slices(looked.select("host", "place", "words", "classes"), run, "host string, class long, pages long, tokens array<long>")
    alike = seen.groupBy("host", "class", "pages").agg(F.min("tokens").alias("tokens"), F.max("tokens").alias("last"), F.max(F.col("tokens").isNull()).alias("failed"))
    passed = alike.filter(~F.col("failed") & (F.col("tokens") == F.col("last")))
    return passed.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("pages", "class", "tokens")), asc=False).alias("classes"))


def slots_of(place: list[int], words: list[int], template: set[int]) -> list[int]:
    """Per block its slot, named by the template token that opens it; 0 before the first."""
    out, slot = [], 0
    for p, w in zip(place, words):
        slot = w if w in template else p if p in template else slot
        out.append(slot)
    return out


def menu_slots(looked: DataFrame) -> DataFrame:
    """Per host: the slots that hold mostly links, and those that hold running text, by all their pages. looked: pages with their host's template."""

    def run(slices):
        for x in slices:
            out: dict[str, list] = {k: [] for k in ("host", "slot", "blocks", "spaces", "chars", "linked")}
            for host, place, words, chars, spaces, linked, tokens in zip(*(x[k] for k in ("host", "place", "words", "chars", "spaces", "linked", "tokens"))):
                sums: dict[int, list[int]] = {}
                for slot, c, n, k in zip(slots_of(place, words, set(tokens)), chars, spaces, linked):
                    one = sums.setdefault(slot, [0, 0, 0, 0])
                    for i, v in enumerate((1, n, c, k)):
                        one[i] += v
                for slot, values in sums.items():
                    for k, v in zip(out, (host, slot, *values)):
                        out[k].append(v)
            yield out

    seen = map_slices(looked.select("host", "place", "words", "chars", "spaces", "linked", "tokens"), run, "host string, slot long, blocks long, spaces long, chars long, linked long")
    slots = seen.groupBy("host", "slot").agg(*(F.sum(k).alias(k) for k in ("blocks", "spaces", "chars", "linked")))
    menu = F.when(F.col("linked") >= LINKED * F.col("chars"), F.col("slot"))
    running = F.when((F.col("linked") < LINKED * F.col("chars")) & (F.col("spaces") >= TEXT_WORDS * F.col("blocks")), F.col("slot"))
    return slots.groupBy("host").agg(F.collect_set(menu).alias("menus"), F.collect_set(running).alias("running"))


def fixed_texts(looked: DataFrame) -> DataFrame:
    """Per host: texts that are tokens of wide classes, with their box and their characters on all pages. looked: pages with their host's wide tokens."""

    def run(slices):
        for x in slices:
            out: dict[str, list] = {k: [] for k in ("host", "token", "box", "running", "own")}
            for host, words, chars, spaces, linked, boxes, box_at, wanted in zip(*(x[k] for k in ("host", "words", "chars", "spaces", "linked", "boxes", "box_at", "wide"))):
                wanted = set(wanted)
                for w, c, n, k, b in zip(words, chars, spaces, linked, box_at):
                    if w in wanted:
                        for name, v in zip(out, (host, w, boxes[b]["box"], c - k if n >= TEXT_WORDS and k <= LINKED * c else 0, c - k)):
                            out[name].append(v)
            yield out

    seen = map_slices(looked.select("host", "words", "chars", "spaces", "linked", "boxes", "box_at", "wide"), run, "host string, token long, box string, running long, own long")
    one = seen.groupBy("host", "token").agg(F.first("box").alias("box"), F.sum("running").alias("running"), F.sum("own").alias("own"))
    return one.groupBy("host").agg(F.collect_list(F.struct("token", "box", "running", "own")).alias("fixed"))


def main_box(boxes: list[dict], fixed: list[dict]) -> str:
    """The innermost box with nearly all of the host's running text, or where there is none of its text, fixed texts not counted."""
    sums = {b["box"]: [b["running"], b["own"]] for b in boxes}
    for f in fixed:
        for box in boxes_above(f["box"]):
            if box in sums:
                sums[box][0] -= f["running"]
                sums[box][1] -= f["own"]
    k = 0 if sums.get("", (0, 0))[0] > 0 else 1
    least = MAIN * sums.get("", (0, 0))[k]
    return max((b for b, v in sums.items() if v[k] >= least), key=lambda b: (b.count("/"), b), default="") if least > 0 else ""


def templates(blocks_: DataFrame) -> DataFrame:
    """Per host with enough distinct pages: its valid classes, tokens, fixed texts, slots of links and of running text, and main box. blocks_ is what parsed() gives."""
    copies = blocks_.groupBy("host", "body").agg(
        F.count("*").alias("rows"), F.min("page").alias("page"),
        F.min_by(F.struct("place", "words", "linked", "boxes", "box_at", F.transform("text", F.char_length).alias("chars"), F.transform("text", lambda t: F.char_length(t) - F.char_length(F.replace(t, F.lit(" ")))).alias("spaces")), "page").alias("x"),
    )
    once = stored(copies.select("host", "rows", "page", "x.*"), "pages-once")
    hosts = stored(once.groupBy("host").agg(F.count("*").alias("all"), F.sum("rows").alias("rows")).filter(F.col("all") >= LEAST_PAGES), "hosts")
    pages = once.select("host", "place", "words", "linked", "chars", "spaces", "boxes", "box_at")
    classes = stored(equivalence_classes(once, hosts), "classes")
    for check in (ordered, nested):
        classes = stored(valid_classes(of_hosts(pages, classes.join(hosts, "host"), "classes"), check), f"classes-{check.__name__}")
    wide = F.filter("classes", lambda c: c["pages"] >= FIXED * F.col("all"))
    tokens = stored(classes.join(hosts, "host").select("host", "rows", F.col("classes").alias("valid"), F.flatten(F.col("classes.tokens")).alias("tokens"), F.flatten(wide["tokens"]).alias("wide")), "tokens")
    slots, fixed = menu_slots(of_hosts(pages, tokens, "tokens")), fixed_texts(of_hosts(pages, tokens, "wide"))
    boxes = once.select("host", F.inline("boxes")).groupBy("host", "box").agg(F.count("*").alias("pages"), F.sum("running").alias("running"), F.sum("own").alias("own"))
    boxes = of_hosts(boxes, hosts, "all").filter(F.col("pages") >= VALID * F.col("all")).groupBy("host").agg(F.collect_list(F.struct("box", "running", "own")).alias("boxes"))
    parts = hosts.join(tokens.select("host", "valid", "tokens"), "host", "left").join(slots, "host", "left").join(fixed, "host", "left").join(boxes, "host", "left")

    def choose(slices):
        for x in slices:
            yield {
                "host": x["host"], "rows": x["rows"], "valid": x["valid"], "tokens": [t or [] for t in x["tokens"]], "menus": [m or [] for m in x["menus"]], "running": [m or [] for m in x["running"]],
                "fixed": [[f["token"] for f in fs or ()] for fs in x["fixed"]], "main": [main_box(b or [], f or []) for b, f in zip(x["boxes"], x["fixed"])],
            }

    schema = "host string, rows long, valid array<struct<pages:long,class:long,tokens:array<long>>>, tokens array<long>, menus array<long>, running array<long>, fixed array<long>, main string"
    return map_slices(parts, choose, schema)


def content(found: list[tuple], place: list[int], words: list[int], template: dict | None) -> list[int]:
    """Where the page's content stands. found: (path, kind, text, linked, mark); template: sets tokens, menus, running, fixed, and main."""
    own = own_blocks(found)
    in_article = bool(own) and found[own[0]][1] != OTHER
    if template is None:
        return own if in_article else [i for i in own if found[i][3] <= LINKED * len(found[i][2])]
    slots, main = slots_of(place, words, template["tokens"]), template["main"]
    fixed = [w in template["fixed"] for w in words]
    inside = lambda path: path.startswith(main) and path[len(main) : len(main) + 1] in ("", "/")
    depth = main.count("/")
    box = [i for i, (path, _, _, _, mark) in enumerate(found) if main and inside(path) and mark <= depth]
    if in_article and (found[own[0]][1] == ARTICLE or not box or not set(box).isdisjoint(own)):
        return without_fixed(found, own, fixed)
    if not box:
        return [i for i in own if slots[i] not in template["menus"] and found[i][3] <= LINKED * len(found[i][2]) and not fixed[i]]
    last = lambda i: found[i][0].rsplit("/", 1)[1].split(" ", 1)[0] if found[i][0] else ""
    more = [i for i in own if found[i][1] == OTHER and (slots[i] in template["running"] or last(i) == TITLE or slots[i] in {slots[j] for j in box})]
    return [i for i in sorted({*box, *more}) if not fixed[i] and slots[i] not in template["menus"] and (found[i][3] <= LINKED * len(found[i][2]) or i in box)]


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    read = stored(parsed(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")), "blocks")
    found = stored(templates(read), "templates")
    names = ("page_id", "url", "path", "kind", "text", "linked", "mark", "place", "words", "tokens", "menus", "running", "fixed", "main")

    def run(slices):
        for x in slices:
            out = []
            for path, kind, text, linked, mark, place, words, tokens, menus, running, fixed, main in zip(*(x[k] for k in names[2:])):
                template = None if tokens is None else {"tokens": set(tokens), "menus": set(menus), "running": set(running), "fixed": set(fixed), "main": main}
                out.append("\n\n".join(text[i] for i in content(list(zip(path, kind, text, linked, mark)), place, words, template)))
            yield {"page_id": x["page_id"], "url": x["url"], "text": out, "n_chars": [len(t) for t in out]}

    known = of_hosts(read, found, "tokens", "menus", "running", "fixed", "main").select(*names)
    others = read.join(found.select("host"), "host", "left_anti").withColumns({k: F.lit(None).cast("array<long>") for k in names[9:13]} | {"main": F.lit(None).cast("string")}).select(*names)
    return map_slices(known.unionByName(others), run, "page_id long, url string, text string, n_chars long")
