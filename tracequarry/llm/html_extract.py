"""Main text of web pages by union-free wrappers inferred for each host.

A page is a stream of tokens: tags by name, and texts, each with the region it stands in (left out, article, neither). For
each host, pages are aligned one after the other with the wrapper so far, a union-free regular expression:
literals, text slots, optional groups and repeated groups. Texts that
differ become slots; where tokens differ, the alignment looks for a
repetition of the square that ends there (a repeated group) and else for
the nearest place at which both go on alike (an optional group). A wrapper is fitted on a
bounded sample of a host's pages.

Each text item of a wrapper is then marked by what is to be done with what it takes. What varies is content: slots of the article
region are kept, and slots of no region on pages without an article. What does not vary is template if a count over all of the host's pages bears it
out, wherever it stands: a literal of no region that more than half of them have goes, and so does one inside articles that more than nine tenths have.
Articles that are copies of each other have literals too; so inside articles literals are template only if MOST_DIFFERENT different pages and more show them,
and if all of them together are a small part of each article's text. What stands in regions that hold no article by tag, role or
class goes. Every page is read whole by its host's wrapper: its texts are what the items that take them say. What no item takes, and
pages of hosts without a wrapper, go by the page's own tags.

Hosts are a key that one site may dominate. Wrappers are made from at most SAMPLE different pages of a host, found
without bringing a host together, and joined to the pages by host.

Defined results: a null or empty page, or one without text outside the
left-out regions, has an empty text; a page of a host without a wrapper (a null url or one
without `://` has the host `''`) is read without one; repeated pages each get a row, and count once for the wrapper; other
columns are ignored, whatever
their names; an empty table gives an empty result. Unclosed tags end where HTML ends them or at the end of their region; a tag that never ends is
text. Reading takes time in proportion to a page's length, however deep its regions and however long its tags.
"""

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .url_filter import host_of

#: Pages of each host that a wrapper is fitted on, and the characters that such a page has at most.
SAMPLE, SAMPLE_CHARS = 12, 1 << 20
#: A literal outside of articles is template if it is on more than this share of its host's pages, and one inside of them if it is on more than the second.
TEMPLATE_SHARE, ARTICLE_SHARE = 0.5, 0.9
#: Different pages that have to show the literals of articles, and the part of each article's text that these may be.
MOST_DIFFERENT, ARTICLE_PART = 8, 0.2
#: How far a page and its wrapper are looked along for the place at which both go on alike.
REACH = 100
#: The sample's rows, of some 40 bytes, that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Fixed values of HTML: what has no content, what holds raw text, what makes a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul video audio".split())
#: Regions that are never an article's text.
ASIDE = frozenset("head nav header footer aside form menu dialog button select option label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of the names of such regions. A class or id is such a name if it has one of these and otherwise only words of PLACE or
#: numbers: `ad-slot-2` is one, `side-effects` and `related-work` are not. It is one as well if it ends with a word of HEADS and denies nothing: `user-comments`, not `no-sidebar`.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget widgets footer header masthead share sharing social related recommended comment comments commentlist disqus replies reply respond skip toolbar pagination pager adsbygoogle".split()
)
PLACE = frozenset("area bar block box bottom button buttons container fixed global holder icons inner item items left link links list mobile outer page panel right row site slot sticky thread top unit wrap wrapper zone body content form head message meta policy primary secondary section settings text title".split())
HEADS = frozenset("ad ads advert adverts advertisement advertisements comment comments commentlist sidebar newsletter navbar breadcrumbs pagination disqus".split())
DENIES = frozenset("no not non without with has hide show on is".split())
#: An article of its own may still be a reader's comment or an advert.
ARTICLE_NAMES = frozenset("ad advert advertisement sponsored promo related comment comments reply".split())
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|[^\W_a-zA-Z]+")
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))""")
_SPACE = re.compile(r"\s+")
#: An open tag that ends an earlier one of its kind, as HTML has it.
CLOSES = {"body": ("head",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Regions by mark. A wrapper's items are tokens `<tag m`, `</tag m`, `"m` and the text, slots `#m`, and groups ["?", items] and ["+", items].
OUT, ARTICLE, NEITHER = "x", "a", "-"
#: What becomes of the text that an item takes.
DROP, UNLESS_ARTICLE, KEEP = 0, 1, 2


def _parts(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes): text, open and close tags in order; comments and declarations are left out.

    One pass: every search either moves on to what it finds, or is not tried where nothing can be found.
    """
    size, last = len(page), page.rfind(">")
    ends: dict[int, int] = {}
    text = scan = 0
    while (at := page.find("<", scan)) >= 0:
        if page.startswith("<!--", at):
            end, kind = page.find("-->", at + 4), None
            end = size if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            end, kind = page.find("]]>", at + 9), None
            end = size if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end, kind = page.find(">", at), None
            end = size if end < 0 else end + 1
        elif at > last:
            break  # no tag ends any more
        elif kind := _TAG_NAME.match(page, at):
            end = _tag_end(page, kind.end(), ends) + 1
        else:
            scan = at + 1
            continue
        if at > text:
            yield "t", page[text:at], ""
        text = scan = end
        if kind is None:
            continue
        tag, attributes = kind[1].lower(), page[kind.end() : end - 1]
        if page[at + 1] == "/":
            yield "c", tag, ""
            continue
        yield "o", tag, attributes
        if tag in RAW and not attributes.rstrip().endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(page, end)
            yield "c", tag, ""
            text = scan = stop.end() if stop else size
    if text < size:
        yield "t", page[text:], ""


def _tag_end(page: str, at: int, ends: dict[int, int]) -> int:
    """Where the `>` of a tag is: after its quoted values, or the first of all if a quote is not closed. There is one.

    ends: for each quote that a search came to outside of a value, where that search ended, -1 if a value does not. A later search that comes to the same quote ends there too, so no
    quote is gone by twice.
    """
    place, passed, end = at, [], -1
    while m := _QUOTE_OR_END.search(page, place):
        if m[0] == ">":
            end = m.start()
            break
        if m.start() in ends:
            end = ends[m.start()]
            break
        passed.append(m.start())
        close = page.find(m[0], m.end())
        if close < 0:
            break
        place = close + 1
    ends.update(dict.fromkeys(passed, end))
    return end if end >= 0 else page.find(">", at)


def _clean(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def _names(value: str, names: frozenset[str]) -> bool:
    """Whether one of a class's or id's names is that of a region of these."""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if any(w in names for w in words) and all(w in names or w in NAMES or w in PLACE or w.isdigit() for w in words):
            return True
        if words and words[-1] in HEADS and words[-1] in names and not DENIES.intersection(words):
            return True
    return False


def _left_out(tag: str, attributes: str) -> bool:
    if tag in ASIDE or tag in RAW:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    names = ARTICLE_NAMES if tag == "article" else NAMES
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in ROLES or name in ("class", "id") and _names(value, names):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value.strip().lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", _ATTRIBUTE.sub(" ", attributes), re.I))


class _Open:
    """The open tags, by place, with what is asked of them at hand: the last one of each name, and the last block and the last wall."""

    def __init__(self):
        self.tags: list[tuple[str | None, str]] = []  # name, mark; no name where an inline tag was closed below others
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.walls: list[int] = []

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def inside(self) -> str:
        return self.tags[-1][1] if self.tags else NEITHER

    def push(self, name: str, mark: str) -> None:
        at = len(self.tags)
        self.tags.append((name, mark))
        self.places.setdefault(name, []).append(at)
        if name in BLOCK and name != "p":
            self.blocks.append(at)
        if name in BLOCK or name in ASIDE:
            self.walls.append(at)

    def cut(self, at: int) -> None:
        """Closes the tag at a place and all after it."""
        while len(self.tags) > at or self.tags and self.tags[-1][0] is None:
            name, _ = self.tags.pop()
            if name is not None:
                self.places[name].pop()
        for places in (self.blocks, self.walls):
            while places and places[-1] >= len(self.tags):
                places.pop()

    def end_paragraph(self) -> None:
        """Any block ends an open paragraph."""
        at = self.last("p")
        if at > (self.blocks[-1] if self.blocks else -1):
            self.cut(at)

    def close(self, name: str) -> None:
        at = self.last(name)
        if at < 0:
            return
        # An inline tag does not close the regions opened inside it.
        if name in BLOCK or name in ASIDE or at > (self.walls[-1] if self.walls else -1):
            self.cut(at)
        else:
            self.places[name].pop()
            self.tags[at] = (None, self.tags[at][1])


_LISTS = ("ul", "ol", "dl", "table", "select")


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, mark of the region) in page order: `t` texts, `o` and `c` tags, and `b` where a block ends."""
    stack = _Open()
    state = NEITHER
    for kind, value, attributes in _parts(page):
        if kind == "t":
            yield "t", value, state
            continue
        cuts = value in BLOCK
        if kind == "o":
            out_here = _left_out(value, attributes)
            cuts |= out_here
            for closed in CLOSES.get(value, ()):  # up to the list or table around it
                at = stack.last(closed)
                if at >= 0 and at > max(map(stack.last, _LISTS)):
                    stack.cut(at)
            empty = value in VOID or attributes.rstrip().endswith("/") and value not in BLOCK
            if value in BLOCK and not empty:
                stack.end_paragraph()
            inside = stack.inside()
            if out_here:
                inside = OUT
            elif inside == NEITHER and (value in ("article", "main") or re.search(r"""role\s*=\s*["']?(?:main|article)\b""", attributes, re.I)):
                inside = ARTICLE
            # A paragraph is a break between blocks, and a region only if it is left out.
            if not empty and (value != "p" or out_here):
                stack.push(value, inside)
            yield "o", value, inside
        else:
            cuts |= value in ASIDE or value in RAW
            yield "c", value, state
            if value == "p":
                stack.end_paragraph()
            else:
                stack.close(value)
        new = stack.inside()
        if cuts or new != state:
            yield "b", "", new
            state = new


def _token(kind: str, value: str, mark: str) -> str | None:
    """An event's token; None for what is none. Long texts are told by a digest."""
    if kind == "o":
        return f"<{value} {mark}"
    if kind == "c":
        return f"</{value} {mark}"
    text = _clean(value) if kind == "t" else ""
    if not text:
        return None
    return f'"{mark}{text if len(text) <= 40 else blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()}'


def stream(page: str) -> list[str]:
    """The page's tokens."""
    return [t for e in events(page) if (t := _token(*e))]


def _slot(item: str) -> str:
    return f"#{item[1]}"


def _is_text(item) -> bool:
    return isinstance(item, str) and item[0] in '"#'


def _alike(a, b) -> bool:
    """Whether a wrapper item takes a page token without a change."""
    return a == b or _is_text(a) and _is_text(b) and a[1] == b[1]


def _takes(items: list, tokens: list[str], at: int) -> int | None:
    """Where the page goes on after items, None if they do not fit at `at`."""
    for item in items:
        if isinstance(item, str):
            if at >= len(tokens) or not _alike(item, tokens[at]):
                return None
            at += 1
        else:
            end = _takes(item[1], tokens, at)
            if end is None and item[0] == "+":
                return None
            while end is not None and end > at:
                at = end
                end = _takes(item[1], tokens, at) if item[0] == "+" else None
    return at


def _merged(a: list, b: list) -> list:
    """Items of two runs that are alike, with slots where texts differ."""
    return [x if x == y or not isinstance(x, str) else _slot(x) for x, y in zip(a, b, strict=True)]


def _square(done: list, rest: list[str], at: int) -> tuple[int, int] | None:
    """(length, copies) of the repetition that ends where the alignment stopped: `done`'s tail, and copies of it in rest."""
    for n in range(1, min(len(done), 24) + 1):
        unit = done[-n:]
        first = unit[0]
        if not (isinstance(first, str) and first.startswith("<") and not first.startswith("</")):
            continue
        copies, here = 0, at
        while (end := _takes(unit, rest, here)) is not None and end > here:
            copies, here = copies + 1, end
        if copies:
            return n, copies
    return None


def _repeat(out: list, n: int, unit: list) -> None:
    """Puts a repeated group in the place of out's last n items, and of the copies just before them."""
    del out[-n:]
    while len(out) >= n and all(isinstance(a, str) and isinstance(b, str) and _alike(a, b) for a, b in zip(unit, out[-n:], strict=True)):
        unit = _merged(unit, out[-n:])
        del out[-n:]
    out.append(["+", unit])


def align(wrapper: list, tokens: list[str], reach: int = REACH) -> list:
    """The wrapper that takes what it took before and the page as well."""
    out: list = []
    i = j = 0
    while i < len(wrapper) or j < len(tokens):
        if i < len(wrapper) and not isinstance(wrapper[i], str):
            kind, items = wrapper[i]
            end, taken = _takes(items, tokens, j), False
            while end is not None and end > j:
                j, taken = end, True
                end = _takes(items, tokens, j) if kind == "+" else None
            if taken or kind == "?":
                out.append(wrapper[i])
            else:
                out.append(["?", [wrapper[i]]])
            i += 1
            continue
        if i < len(wrapper) and j < len(tokens) and _alike(wrapper[i], tokens[j]):
            out.append(wrapper[i] if wrapper[i] == tokens[j] else _slot(wrapper[i]))
            i, j = i + 1, j + 1
            continue
        # A mismatch: a repetition on the page, or in the wrapper, ...
        if j < len(tokens) and (found := _square(out, tokens, j)):
            n, copies = found
            unit = out[-n:]
            for _ in range(copies):
                end = _takes(unit, tokens, j)
                unit = _generalised(unit, tokens[j:end])
                j = end
            _repeat(out, n, unit)
            continue
        if i < len(wrapper) and all(isinstance(x, str) for x in wrapper[i : i + 24]) and (found := _square(out, wrapper, i)):
            n, copies = found
            unit = out[-n:]
            for _ in range(copies):
                end = _takes(unit, wrapper, i)
                unit = _generalised(unit, wrapper[i:end])
                i = end
            _repeat(out, n, unit)
            continue
        # ... or an option: what stands before the nearest place where both go on alike.
        best = None
        for skip in range(1, reach):
            if i < len(wrapper) and j + skip < len(tokens) and isinstance(wrapper[i], str) and wrapper[i] == tokens[j + skip]:
                best = ("page", skip)
                break
            if j < len(tokens) and i + skip < len(wrapper) and isinstance(wrapper[i + skip], str) and wrapper[i + skip] == tokens[j]:
                best = ("wrapper", skip)
                break
        if best is None:
            best = ("page", len(tokens) - j) if i >= len(wrapper) else ("wrapper", len(wrapper) - i) if j >= len(tokens) else ("both", 1)
        if best[0] in ("page", "both"):
            out.append(["?", [_slot(t) if _is_text(t) else t for t in tokens[j : j + best[1]]]])
            j += best[1]
        if best[0] in ("wrapper", "both"):
            out.append(["?", wrapper[i : i + best[1]]])
            i += best[1]
    return out


def _generalised(unit: list, tokens: list) -> list:
    """unit, with slots where the copy's texts differ; a unit with groups stays."""
    if len(unit) == len(tokens) and all(isinstance(x, str) for x in unit):
        return _merged(unit, tokens)
    return unit


def infer(pages: list[str]) -> list:
    """The wrapper of pages of one host, aligned one after the other."""
    streams = [stream(p) for p in pages]
    if not streams:
        return []
    wrapper: list = list(streams[0])
    for tokens in streams[1:]:
        wrapper = align(wrapper, tokens)
    return wrapper


def literals(wrapper: list) -> set[str]:
    """Text tokens outside of left-out regions that the wrapper has as literals outside options: the same on every page of the sample."""
    out = set()
    for item in wrapper:
        if isinstance(item, str):
            if item[0] == '"' and item[1] != OUT:
                out.add(item)
        elif item[0] == "+":
            out |= literals(item[1])
    return out


def candidates(wrapper: list, pages: list[str]) -> set[str]:
    """The literals that may be template: all outside of articles; those inside only if enough pages show them and they are a small part of every article."""
    found = literals(wrapper)
    inside = {t for t in found if t[1] == ARTICLE}
    if len(pages) < MOST_DIFFERENT or any(_part_of(page, inside) > ARTICLE_PART for page in pages):
        return found - inside
    return found


def _part_of(page: str, inside: set[str]) -> float:
    """Which part of an article's text some of its texts are."""
    texts = [(t, len(_clean(e[1]))) for e in events(page) if e[0] == "t" and (t := _token(*e)) and t[1] == ARTICLE]
    return sum(n for t, n in texts if t in inside) / max(1, sum(n for _, n in texts))


def marked(wrapper: list, template: set[str]) -> list:
    """The wrapper with what is to be done beside each text item: [item, what]."""
    def what(item: str) -> int:
        return DROP if item[1] == OUT or item in template else KEEP if item[1] == ARTICLE else UNLESS_ARTICLE

    return [[item, what(item)] if _is_text(item) else item if isinstance(item, str) else [item[0], marked(item[1], template)] for item in wrapper]


def _is_group(item) -> bool:
    return not isinstance(item, str) and item[0] in ("?", "+")


def _same(item, token: str) -> bool:
    return item == token if isinstance(item, str) else not _is_group(item) and _alike(item[0], token)


def _read(items: list, tokens: list[str], at: int, taken: list[tuple[int, int]]) -> int | None:
    """Where the page goes on after items, None if they do not fit at `at`; adds (place, what) of the texts that they take."""
    before = len(taken)
    for item in items:
        if not _is_group(item):
            if at >= len(tokens) or not _same(item, tokens[at]):
                del taken[before:]
                return None
            if not isinstance(item, str):
                taken.append((at, item[1]))
            at += 1
            continue
        end = _read(item[1], tokens, at, taken)
        if end is None and item[0] == "+":
            del taken[before:]
            return None
        while end is not None and end > at:
            at = end
            end = _read(item[1], tokens, at, taken) if item[0] == "+" else None
    return at


def read(wrapper: list, tokens: list[str]) -> dict[int, int]:
    """{place of a text token: what the wrapper's item that takes it says}; tokens that no item takes are left out.

    Where the page does not fit, it and the wrapper are looked along for the nearest tag that both have.
    """
    taken: list[tuple[int, int]] = []
    i = j = 0
    while i < len(wrapper) and j < len(tokens):
        item = wrapper[i]
        if _is_group(item):
            end = _read([item] if item[0] == "+" else item[1], tokens, j, taken)
            j, i = j if end is None else end, i + 1
        elif _same(item, tokens[j]):
            if not isinstance(item, str):
                taken.append((j, item[1]))
            i, j = i + 1, j + 1
        else:
            for skip in range(1, REACH):
                if isinstance(item, str) and j + skip < len(tokens) and tokens[j + skip] == item:
                    j += skip
                    break
                if i + skip < len(wrapper) and isinstance(wrapper[i + skip], str) and wrapper[i + skip] == tokens[j]:
                    i += skip
                    break
            else:
                i, j = i + 1, j + 1
    return dict(taken)


def main_text(page: str | None, wrapper: list | None = None) -> str:
    """The page's text by its host's marked wrapper, or by its own tags."""
    if not page:
        return ""
    found = list(events(page))
    tokens = [(k, t) for k, e in enumerate(found) if (t := _token(*e))]
    told = read(wrapper, [t for _, t in tokens]) if wrapper else {}
    said = {tokens[place][0]: what for place, what in told.items()}
    has_article = any(t[:2] == '"' + ARTICLE for _, t in tokens)
    blocks, run = [], []
    for k, (kind, value, mark) in enumerate(found):
        if kind == "t":
            what = said.get(k)
            if what is None:
                what = DROP if mark == OUT else KEEP if mark == ARTICLE else UNLESS_ARTICLE
            if what == KEEP or what == UNLESS_ARTICLE and not has_article:
                run.append(value)
        elif kind == "b" and run:
            blocks.append(_clean("".join(run)))
            run = []
    blocks.append(_clean("".join(run)))
    return " ".join(b for b in blocks if b)


def _sampled(pages: DataFrame, sample: int) -> DataFrame:
    """(host, html): `sample` different pages of each host at most, those with the least hashes.

    A top-k by partial aggregation, so a host's pages never meet in one task; repeated pages have one hash.
    """
    texts = pages.select(host_of(F.col("url")).alias("host"), "html").filter(f"host <> '' and html <> '' and length(html) <= {SAMPLE_CHARS}")
    keyed = texts.withColumn("h", F.xxhash64("html", F.lit(3)))
    cells = keyed.groupBy("host", F.pmod("h", F.lit(4096)).alias("cell")).agg(F.min("h").alias("h"))
    few = cells.groupBy("host").agg(F.slice(F.sort_array(F.collect_list("h")), 1, sample).alias("some"))
    chosen = staged(few.select("host", F.explode("some").alias("h")), "wrapper-samples")
    # Few hosts: their sample goes to the pages. Very many: pages and sample are dealt out by host and hash.
    small = chosen.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(chosen) if small else chosen, ["host", "h"]).groupBy("host", "h").agg(F.min("html").alias("html"))


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, wrapper): the marked wrapper, as JSON, of each host with two different pages at least."""

    def fit(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("h", kind="stable")
        wrapper = infer(part["html"].tolist()) if len(part) > 1 else []
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(wrapper)], "literals": [json.dumps(sorted(candidates(wrapper, part["html"].tolist())))]})

    fitted = staged(_sampled(pages, sample).groupBy("host").applyInPandas(fit, "host string, wrapper string, literals string").filter("wrapper <> '[]'"), "wrappers-fitted")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """On how many pages each of a host's literals is, and, as '', how many pages it has."""
        told: dict[str, set[str]] = {}
        for batch in batches:
            n: Counter = Counter()
            for host, some, page in zip(batch["host"], batch["literals"], batch["html"], strict=True):
                if host not in told:
                    if len(told) > 1000:
                        told.clear()
                    told[host] = set(json.loads(some))
                n[host, ""] += 1
                n.update((host, t) for t in told[host].intersection(stream(page)))
            yield pd.DataFrame([(h, t, c) for (h, t), c in n.items()], columns=["host", "literal", "n"])

    undecided = fitted.filter("literals <> '[]'").select("host", "literals")
    texts = pages.select(host_of(F.col("url")).alias("host"), "html").filter("html is not null")
    counts = texts.join(undecided, "host").select("host", "literals", "html").mapInPandas(count, "host string, literal string, n long").groupBy("host", "literal").agg(F.sum("n").alias("n"))
    counts = staged(counts, "wrapper-literals")
    whole = counts.filter("literal = ''").select("host", F.col("n").alias("n_pages"))
    share = F.when(F.substring("literal", 2, 1) == ARTICLE, ARTICLE_SHARE).otherwise(TEMPLATE_SHARE)
    common = counts.filter("literal <> ''").join(whole, "host").filter(F.col("n") > F.col("n_pages") * share)
    template = common.groupBy("host").agg(F.collect_set("literal").alias("template"))  # of one wrapper's literals

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [json.dumps(marked(json.loads(w), set() if t is None else set(t)), separators=(",", ":")) for w, t in zip(batch["wrapper"], batch["template"], strict=True)]
            yield pd.DataFrame({"host": batch["host"].tolist(), "wrapper": done})

    return fitted.drop("literals").join(template, "host", "left").mapInPandas(mark, "host string, wrapper string")


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch["html"], batch["wrapper"], strict=True):
            if wrapper is not None and wrapper not in held:
                if len(held) > 200:
                    held.clear()
                held[wrapper] = json.loads(wrapper)
            texts.append(main_text(page, held.get(wrapper)))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    fitted = staged(wrappers(pages), "wrappers")
    # Read from files, the wrappers are broadcast by Spark only while their size allows; else both sides are
    # dealt out by host and Spark splits the part of a host with very many pages.
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host")).join(fitted, "host", "left")
    return told.select("page_id", "url", "html", "wrapper").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
