"""Main text of web pages by union-free regular expressions inferred per host.

A page is a stream of structural tags and text slots. Runs of equal groups are folded into one repeated group, so
pages of one template have few different streams. Streams of a host are aligned one after another with what has been
inferred so far: tokens that match stay, and what only one side has becomes an optional group, which gives the
host's wrapper: a regular expression without unions, of tokens, optional and repeated groups, and slots. Each page is
then matched against its host's wrapper, which gives every text of it a place there. A text that all different pages
with this place have in it is the template's, like a byline's "share this"; what varies is the page's. A page's
text is what stands in its article slots without the template's texts.

Which slots are the article's: those in an ``article`` or ``main`` element where the wrapper has one, else all of
the body's, in both cases but for slots inside of elements that are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or comments by their tag, role, class or id. A page whose host has an article slot
but that fills none itself gets its other body slots. A slot is named by the tags around it.

Which texts are the template's: pages count as different by the texts in their article slots, so copies of an article
show nothing, and a text needs PAGES of them and SHARE of the host's. A repeated place, such as a list's item, holds
several texts of a page, each of which is the template's or not.

Scale: pages give their folded stream. Distinct streams of a host are aligned some ALIGNED at a time, then the
wrappers of these, level by level, so a host with a third of all pages, each different, is many small groups. A
wrapper of more than LONG items has its runs of optional items made one repeated group of their different ones, so
its length depends on a host's tags, not on its pages; long streams are aligned in linear time. Neither changes which
slots there are. Matching follows a page's tokens through the wrapper's expression with the places it may be at, some
few at a time. Places and texts are counted as hashes. Wrappers are joined to pages by host; Spark broadcasts them if small and splits large hosts if not.

Edge cases: a null or empty page has an empty text; pages without a url, or one that names no host, form a host of
their own; broken tags end at the next ``<`` or the page's end; a head ends at the first thing that can't be in it; very
long pages are read whole, in time linear in their length; repeated rows give repeated results; columns that aren't asked
for are left out, and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.scratch import Scratch

#: Streams or wrappers of a host that one task aligns, about.
ALIGNED = 64
#: Items of a wrapper from which on its optional runs are generalised.
LONG = 512
#: Pairs of items up to which two streams are aligned by longest matches, and how far a linear alignment looks ahead.
PAIRS, AHEAD = 1 << 18, 64
#: The longest group that folding looks for, in tokens.
GROUP = 12
#: Different pages, and share of a host's, that hold a text of the template.
PAGES, SHARE = 3, 0.1
#: Characters of wrappers that a task keeps compiled.
KNOWN = 1 << 22
#: Elements whose contents aren't text, and those that are never part of an article.
RAW = ("script", "style", "template", "noscript", "iframe", "textarea", "xmp", "svg", "math", "object", "canvas", "title")
NEVER = frozenset("head nav header footer aside form button select menu dialog fieldset datalist label legend option".split()) | frozenset(RAW)
#: Elements that end a block without holding others here (their end tags may be missing), and inline ones.
MARKS = frozenset("p li dt dd tr td th thead tbody tfoot hr option optgroup".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base col embed input link meta param source track".split())
#: Words of a class, id or role that say what an element is.
SIGNS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer footer "
    "gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related "
    "replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget alert alertdialog dialog discussion responses".split()
)
#: The signs of an inline advert; what a class says of a page's state, not of the element; and
#: words that may follow a sign in a class.
ADS = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion".split())
STATES = frozenset("has with without no is not show hide".split())
PARTS = frozenset(
    "area articles bar block bottom box buttons container content entries fixed form group heading icons inner item items left links list main outer panel "
    "post posts primary right row secondary section slot stories sticky text thread title top unit wrap wrapper".split()
)
#: Elements of a head, which any other ends, and what ends an element whose end tag may be missing, within
#: the element named last.
OF_HEAD = frozenset("base link meta".split()) | frozenset(RAW)
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
ENDS |= {t: ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}) for t in ("td", "th")} | {t: ({"tr", "tbody", "thead", "tfoot"}, {"table"}) for t in ("tr",)}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)>|<(?P<open>/?)(?P<bad>[a-zA-Z][^\s/><]*)[^<>]*(?:>|(?=<)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HEADING = re.compile(r"h[1-6](?:\W|$)")
#: Characters of a tag that mean something in streams and wrappers.
_MEANT = re.compile(r"[()*?+!@>#]")
_INNER = re.compile(r"[^\s()*?+]+")
_PART = re.compile(r"[()]|[^\s()*?+]+|[*?+]")


def _signed(value: str, signs: frozenset[str] = SIGNS) -> bool:
    """Whether a class, id or role names a part of a page that isn't the article: one of its names ends with such a word,
    or goes on with words for a part, and doesn't tell a state."""
    for name in value.split():
        words = _WORD.findall(_NUMBER.sub("", name))
        if STATES.isdisjoint(words):
            while words and words[-1] in PARTS and words[-1] not in signs:
                words.pop()
            if words and words[-1] in signs:
                return True
    return False


def _named(rest: str, signs: frozenset[str]) -> bool:
    """Whether a tag's class, id or role has a sign."""
    return any(name.lower() in ("class", "id", "role") and _signed((a or b or c).lower(), signs) for name, a, b, c in _ATTRIBUTE.findall(rest))


def _element(tag: str, rest: str) -> str:
    """A tag's name in streams: with ``!`` if its attributes say it isn't part of an article, or ``@`` if they say it is."""
    if not rest or rest.isspace() or rest == "/":
        return tag
    kind = ""
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            if tag not in ("html", "body", "main") and _signed(value):
                kind = "!"
            elif not kind and (name == "role" and value == "main" or name == "itemprop" and value == "articlebody"):
                kind = "@"
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            kind = "!"
    return tag + kind


def stream(page: str) -> Iterator[tuple[str, str | None]]:
    """(token, text): tags as their names, with ``/`` at the end of an element, and slots as ``#`` and the names of
    the elements around them, with their text."""
    stack: list[str] = []
    held: list[str] = []
    at, n = 0, len(page)
    skip, depth, code = "", 0, 0  # an inline advert, how often it is open, and how deep in code this is

    def flush() -> Iterator[tuple[str, str | None]]:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                if stack and stack[-1] == "head":
                    stack.pop()
                    yield "/head", None
                yield "#" + ">".join(stack), text

    def leave(i: int) -> Iterator[tuple[str, str | None]]:
        name = stack[i].rstrip("!@")
        del stack[i:]
        yield "/" + name, None

    while at < n:
        m = _TOKEN.search(page, at)
        if not skip:
            held.append(html_.unescape(page[at : m.start() if m else n]))
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None and not skip:
            held.append(m["cdata"])
        tag = _MEANT.sub("_", (m["tag"] or m["bad"] or "").lower())
        if not tag:
            continue
        end, rest = (m["end"] or m["open"]) == "/", m["rest"] or ""
        if tag in RAW:
            if not end and not rest.endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag in INLINE:
            if tag == "code":
                code = max(0, code + (-1 if end else 1))
            if skip:
                depth += (tag == skip) * (-1 if end else 1)
                skip = skip if depth else ""
            elif not end and rest and tag not in ("br", "wbr", "img") and not code and "pre" not in stack and _named(rest, ADS):
                skip, depth = tag, 1
            if tag == "br" and not skip:
                held.append(" ")
            continue
        yield from flush()
        skip, depth = "", 0
        if not end and stack and stack[-1] == "head" and tag not in OF_HEAD:
            yield from leave(len(stack) - 1)
        if tag in VOID:
            continue
        if not end:
            # elements that end here without an end tag
            if stack and stack[-1] == "p!":
                yield from leave(len(stack) - 1)
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i].rstrip("!@")
                if name in ENDS and tag in ENDS[name][0]:
                    yield from leave(i)
                    break
                if any(name in within for own, within in ENDS.values() if tag in own):
                    break
        if tag in MARKS and not end:
            name = tag + "!" * (bool(rest) and _named(rest, SIGNS))
            if name == tag:
                yield name, None
                continue
            stack.append(name)
            yield name, None
        elif end:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].rstrip("!@") == tag), None)
            if found is not None and (tag not in ENDS or not any(x.rstrip("!@") in ENDS[tag][1] for x in stack[found:])):
                yield from leave(found)
        else:
            name = _element(tag, rest)
            stack.append(name)
            yield name, None
            if rest.endswith("/"):
                stack.pop()
    yield from flush()


# A wrapper is a list of (text of a token or group, whether it may be missing, whether it may repeat).
Item = tuple[str, bool, bool]


def fold(items: list[Item]) -> list[Item]:
    """Neighbouring equal groups as one repeated group, shorter groups first. Groups are equal by their names; what is
    optional or repeated in one of them is so in all."""
    for size in range(1, GROUP + 1):
        out: list[Item] = []
        i = 0
        while i < len(items):
            group, j = items[i : i + size], i + size
            names = [x[0] for x in group]
            while j + size <= len(items) and [x[0] for x in items[j : j + size]] == names:
                group = [(a[0], a[1] or b[1], a[2] or b[2]) for a, b in zip(group, items[j : j + size], strict=True)]
                j += size
            if j == i + size:
                out.append(items[i])
                i += 1
            else:
                out.append((names[0], group[0][1], True) if size == 1 else (f"({' '.join(map(_shown, group))})", False, True))
                i = j
        items = out
    return items


def _shown(item: Item) -> str:
    return item[0] + ("*" if item[1] and item[2] else "?" if item[1] else "+" if item[2] else "")


def _blocks(a: list[str], b: list[str]) -> Iterator[tuple[int, int, int]]:
    """(i, j, n) in order, so that a[i:i + n] matches b[j:j + n], and last both ends with n of 0."""
    if len(a) * len(b) <= PAIRS:
        yield from SequenceMatcher(None, a, b, False).get_matching_blocks()
        return
    places = defaultdict(list)
    for i, x in enumerate(a):
        places[x].append(i)
    i = 0
    for j, x in enumerate(b):
        k = bisect_left(places[x], i) if x in places else 0
        if x in places and k < len(places[x]) and places[x][k] - i <= AHEAD:
            yield places[x][k], j, 1
            i = places[x][k] + 1
    yield len(a), len(b), 0


def generalise(wrapper: list[Item]) -> list[Item]:
    """A long wrapper's runs of optional items, each as one optional, repeated group of its different optional items."""
    if len(wrapper) <= LONG:
        return wrapper
    out: list[Item] = []
    i = 0
    while i < len(wrapper):
        j = i
        while j < len(wrapper) and wrapper[j][1]:
            j += 1
        if j - i > 1:
            inner = dict.fromkeys(x for text, _, _ in wrapper[i:j] for x in _INNER.findall(text))
            out.append((f"({' '.join(f'{x}?' for x in inner)})", True, True))
            i = j
        else:
            out.append(wrapper[i])
            i += 1
    return out


def align(wrapper: list[Item], other: list[Item]) -> list[Item]:
    """A wrapper of what both match: what one side lacks is optional, and what either repeats repeats."""
    out: list[Item] = []
    a = b = 0
    for i, j, n in _blocks([x[0] for x in wrapper], [x[0] for x in other]):
        out += [(x[0], True, x[2]) for x in [*wrapper[a:i], *other[b:j]]]
        a, b = i + n, j + n
        out += [(x[0], x[1] or y[1], x[2] or y[2]) for x, y in zip(wrapper[i:a], other[j:b], strict=True)]
    return generalise(fold(out))


def infer(streams: list[list[Item]]) -> list[Item]:
    """The wrapper of some streams or wrappers."""
    wrapper: list[Item] = []
    for k, items in enumerate(sorted(streams, key=lambda x: (-len(x), x))):
        wrapper = align(wrapper, items) if k else items
    return wrapper


def _inside(slot: str) -> list[str]:
    return slot[1:].split(">") if len(slot) > 1 else []


def _boilerplate(path: list[str]) -> bool:
    article = max((i for i, x in enumerate(path) if x.rstrip("!@") in ("article", "main")), default=-1)
    for i, x in enumerate(path):
        name = x.rstrip("!@")
        if name == "header" and i > article >= 0 and _HEADING.match(path[-1]) and not x.endswith("!"):
            continue  # an article's heading may stand in a header of the article
        if name in NEVER or x.endswith("!"):
            return True
    return False


def roles(wrapper: list[Item]) -> dict[str, int]:
    """The article's slots of a wrapper: 2, and the other slots that a page without these gives: 1."""
    slots = sorted({s for text, _, _ in wrapper for s in re.findall(r"#[^\s()*?+]*", text)})
    own = {s: _inside(s) for s in slots}
    body = {s for s in slots if not _boilerplate(own[s])}
    main = {s for s in body if any(x.rstrip("!@") in ("article", "main") or x.endswith("@") for x in own[s])}
    return {s: 2 if s in main or not main else 1 for s in body}


class Expression:
    """A wrapper as an automaton that gives each token of a page its place in it."""

    def __init__(self, wrapper: list[Item]):
        # at a number: the token there and None, or None and the numbers that may follow at once, preferred ones first
        self.code: list[tuple[str | None, list[int]]] = []
        self._next: dict[int, dict[str, list[int]]] = {}
        parts = _PART.findall(" ".join(map(_shown, wrapper)))
        starts: list[int] = []
        last = 0
        for k, part in enumerate(parts):
            if part in "*?+":
                end = len(self.code)
                if part in "*+":
                    self.code.append((None, [last, end + 1]))
                if part in "*?":
                    self.code[last] = (None, [last + 1, len(self.code)])
            elif part == ")":
                last = starts.pop()
            else:
                # an empty step in front, which becomes a choice if the part may be missing
                last = len(self.code)
                self.code.append((None, [last + 1]))
                if part == "(":
                    starts.append(last)
                else:
                    self.code.append((part, []))

    def _after(self, at: int) -> dict[str, list[int]]:
        """The places that may come next at a number, by their tokens; the end is a token ``""``."""
        if at not in self._next:
            found: dict[str, list[int]] = {}
            seen, stack = set(), [at]
            while stack:
                i = stack.pop()
                if i in seen:
                    continue
                seen.add(i)
                if i == len(self.code):
                    found.setdefault("", []).append(i)
                elif self.code[i][0] is None:
                    stack += reversed(self.code[i][1])
                else:
                    found.setdefault(self.code[i][0], []).append(i)
            self._next[at] = found
        return self._next[at]

    def places(self, tokens: list[str]) -> list[int] | None:
        """Each token's place on the preferred way through the wrapper; None if there is no way."""
        steps: list[dict[int, int]] = []
        now = [-1]
        for token in [*tokens, ""]:
            step: dict[int, int] = {}
            for i in now:
                for j in self._after(i + 1).get(token, ()):
                    step.setdefault(j, i)
            if not step:
                return None
            steps.append(step)
            now = list(step)
        out, at = [], now[0]
        for step in reversed(steps):
            at = step[at]
            out.append(at)
        return out[-2::-1] if tokens else []


def _hash(*texts: str) -> int:
    return int.from_bytes(blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Template:
    """A host's wrapper, ready for its pages: its expression, the roles of its slots and the template's texts."""

    def __init__(self, wrapper: str | None, fixed: str | None = None):
        items = [tuple(x) for x in json.loads(wrapper or "[]")]
        self.expression, self.role, self.fixed = Expression(items), roles(items), frozenset((fixed or "").split())

    def own(self, page: str) -> list[tuple[int, str]]:
        """(place, text) of a page's article slots; the place is -1 if the page doesn't match."""
        found = list(stream(page))
        places = self.expression.places([t for t, _ in found]) or [-1] * len(found)
        kept = [(self.role.get(t, 0), place, text) for (t, text), place in zip(found, places, strict=True) if text is not None]
        level = 2 if any(r == 2 for r, _, _ in kept) else 1
        return [(place, text) for r, place, text in kept if r >= level]

    def text(self, page: str) -> str:
        """A page's article slots without the template's texts."""
        return "\n".join(text for place, text in self.own(page) if not self.fixed or f"{place}:{_hash(text)}" not in self.fixed)


class Templates(dict):
    """Templates by wrapper and texts, as many as fit into KNOWN."""

    size = 0

    def __missing__(self, key: tuple[str | None, str | None]) -> Template:
        if self.size > KNOWN:
            self.clear()
            self.size = 0
        self.size += len(key[0] or "") + len(key[1] or "")
        self[key] = Template(*key)
        return self[key]


def host(url: str = "url") -> Column:
    """The host of a url, in lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, scratch: Scratch, html: str = "html") -> DataFrame:
    """(host, wrapper, fixed) of every host of pages with a column ``host``; a wrapper is JSON of its items, fixed are
    the places and hashes of the template's texts."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(fold([(t, False, False) for t, _ in stream(p or "")])) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "wrapper"])

    def aligned(pdf: pd.DataFrame) -> pd.DataFrame:
        made = infer([[tuple(x) for x in json.loads(w)] for w in pdf["wrapper"]])
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(made)]})

    kinds, level = pages.select("host", html).mapInArrow(folded, "host string, wrapper string").distinct(), 0
    while True:
        kinds = scratch.put(kinds, f"kinds{level}")
        counts = scratch.put(kinds.groupBy("host").agg(F.count("*").alias("n")), f"counts{level}")
        if counts.where("n > 1").isEmpty():
            # written, so that Spark knows its size when it is joined to pages
            return scratch.put(kinds.join(fixed_texts(pages, kinds, scratch, html), "host", "left"), "wrappers")
        salt = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / ALIGNED))
        kinds = kinds.join(counts, "host").withColumn("salt", salt).groupBy("host", "salt").applyInPandas(aligned, "host string, wrapper string")
        level += 1


def fixed_texts(pages: DataFrame, kinds: DataFrame, scratch: Scratch, html: str = "html") -> DataFrame:
    """(host, fixed) of the hosts that have texts of the template, by their wrappers."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates()
        kind = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.int64())]))
        for batch in batches:
            hashes, slots = [], []
            for wrapper, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = known[wrapper, None].own(page or "")
                hashes.append(_hash(*(text for _, text in own)))
                slots.append([{"place": p, "text": h} for p, h in sorted({(p, _hash(text)) for p, text in own})])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.int64()), pa.array(slots, kind)], names=["host", "page", "slots"])

    found = pages.select("host", F.col(html).alias("_html")).join(kinds, "host").select("host", "wrapper", "_html").mapInArrow(placed, "host string, page bigint, slots array<struct<place int, text bigint>>")
    different = scratch.put(found.dropDuplicates(["host", "page"]), "different")
    hosts = different.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= PAGES)
    reached = different.select("host", F.explode(F.array_distinct("slots.place")).alias("place")).groupBy("host", "place").agg(F.count("*").alias("reached"))
    held = different.select("host", F.explode("slots").alias("s")).groupBy("host", "s.place", "s.text").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    fixed = held.join(reached, ["host", "place"]).join(hosts, "host").where((F.col("n") == F.col("reached")) & (F.col("n") >= F.col("pages") * SHARE) & (F.col("place") >= 0))
    return scratch.put(fixed.groupBy("host").agg(F.concat_ws(" ", F.sort_array(F.collect_set(F.concat_ws(":", "place", "text")))).alias("fixed")), "fixed")


def text_of(page: str, role: dict[str, int]) -> str:
    """A page's text by the roles of its host's slots alone."""
    found = [(role.get(t, 0), text) for t, text in stream(page) if text is not None]
    level = 2 if any(r == 2 for r, _ in found) else 1
    return "\n".join(text for r, text in found if r >= level)


def extract(pages: DataFrame, found: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys and ``text`` of every page, by the wrappers of the hosts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                page, wrapper, fixed = (part.column(len(keys) + k).to_pylist() for k in range(3))
                texts = [known[w, x].text(p or "") for p, w, x in zip(page, wrapper, fixed, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keys))), pa.array(texts, pa.string())], names=[*keys, "text"])

    own = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keys)
    known = found.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"), F.col("fixed").alias("_fixed"))
    asked = pages.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keys)), F.col(html).alias("_html"), F.col("host").alias("_of"))
    return asked.join(known, F.expr("_of <=> _host"), "left").select(*(f"_{i}" for i in range(len(keys))), "_html", "_wrapper", "_fixed").mapInArrow(run, f"{own}, text string")
