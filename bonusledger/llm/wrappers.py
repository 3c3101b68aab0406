"""Main text of web pages by wrappers: union-free regular expressions over the
token streams of a host's pages.

A page becomes a stream of structural tokens and text slots; tandem repeats fold
into repeated groups, so a page with 3 and one with 300 paragraphs look alike.
The distinct folded streams of a host are aligned one after another: what both
have stays, what one lacks becomes optional, and groups that differ are aligned
inside.  Hosts with many streams are aligned in bounded groups first and then the
groups' wrappers, so no task holds all streams of a host.

The wrapper decides what is content, in two steps.  By its slots: those below
containers that are marked as menu, header, footer, sidebar, notice, advert, form or
comments are not (a container around the only article or main part, or a form around
most of the text, is layout); with an article or main part in the wrapper only slots
inside it are; without one, all slots that are not marked.  Then by its texts: the
texts that the host's pages have at one place of the wrapper are compared, and a
container whose places all hold the same text on every page that has them is the
host's template, not content (see ``templates``).  A page is then read again, aligned
with its host's wrapper.

Null and empty html give an empty text.  A page whose url is null or has no host
is aligned with the other such pages.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import land, small

GROUP = 256  # streams that one task aligns
LEAST = 3  # pages of different content on which a template text stands
LARGEST = math.inf  # items times items from which on differences are made optional whole; none by default, all are aligned
KEPT = 512  # rows of an alignment's table that are held
# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title select svg annotation iframe canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small "
    "span strike strong sub sup time tt u var wbr object math menclose mfenced mfrac mi mmultiscripts mn mo mover mpadded "
    "mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
CLUTTER = frozenset("nav footer aside form button menu dialog head".split())
MARKS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice popup promo "
    "promotion related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
ADVERTS = frozenset("ad ads advert advertisement adverts promo promotion sponsor sponsored".split())
# words that may stand beside a mark in a class or id that names a part of a page
PARTS = frozenset(
    "area articles bar block bottom box buttons col column container content fixed global group icons inner item items left "
    "lang language link links list main mobile outer page panel posts primary right row secondary section signup site "
    "sticky stories sub the top unit widgets wrap wrapper".split())
CONTAINERS = frozenset("article aside details div dl footer form header li main nav ol section table ul".split())
HOLDERS = CONTAINERS - {"article", "main", "li"}  # may be a template as a whole
# an open element of the first kind ends where one of the second begins
CLOSES = {"p": frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
SCOPE = frozenset("article aside body div footer form header main nav ol section table ul blockquote td th".split())
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNIT = re.compile("|".join(sorted(MARKS | PARTS, key=lambda w: (-len(w), w))))
_GLUE = re.compile(r"[-_0-9]+")
_CLASS = re.compile(r"[A-Za-z_-]{1,40}")
_BLANK = re.compile(r"\s+")


def marks_of(name: str, given: list[str]) -> set[str]:
    """The marks that classes, ids and roles set on an element.  A name counts as a
    whole: it consists of marks and words for parts ("top-nav", "commentlist"); names
    that say something else ("social-history", "has-sidebar") do not.  Containers
    take all marks; paragraphs and inline elements those of adverts; headings none."""
    most = MARKS if name in CONTAINERS else ADVERTS if name in INLINE or name == "p" else None
    if most is None:
        return set()
    out = set()
    for v in given:
        v = _GLUE.sub("", v.lower())
        words = _UNIT.findall(v)
        if sum(map(len, words)) == len(v):
            out.update(w for w in words if w in most)
    return out


def tokens(page: str):
    """("open", name, key) / ("close", name, "") / ("text", characters, "") in page
    order.  Comments, declarations and raw elements (scripts, styles, titles) are
    left out."""
    at, low = 0, None
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            yield "text", page[at:m.start()], ""
        at = m.end()
        if m.group(1) is not None:
            yield "text", _escaped(m.group(1)), ""
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if m.group(2):
            yield "close", name, ""
            continue
        if name in RAW:
            if low is None:
                low = page.lower() if len(page.lower()) == len(page) else page
            end = low.find("</" + name, at)
            if not m.group(0).endswith("/>"):
                at = len(page) if end < 0 else end
            continue
        given = [(a[1].lower(), v) for a in _ATTR.finditer(m.group(4)) for v in (a[2] or a[3] or a[4] or "").split()]
        key = name
        if given:
            marks = marks_of(name, [v for _, v in given])
            key += "." + " ".join(sorted(marks)) if marks else ""
            if name in HOLDERS:  # tells containers of one element name apart
                key += next(("#" + v for kind, v in given if kind == "class" and _CLASS.fullmatch(v)), "")
        yield "open", name, key
    if at < len(page):
        yield "text", page[at:], ""


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def blocks(page: str | None):
    """(path, text) of each block of text: the open elements around it as keys
    joined by "/", and the decoded characters with single spaces."""
    stack: list[tuple[str, str]] = []
    parts: list[str] = []

    def flush():
        text = _BLANK.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        return [("/".join(k for n, k in stack if n not in INLINE), text)] if text else []

    for kind, name, key in tokens(page or ""):
        if kind == "text":
            if not any(n in INLINE for n, _ in stack):  # only marked ones are on the stack: an advert within a line
                parts.append(name)
        elif name == "br":
            parts.append(" ")
        elif name in INLINE:
            if "." in key and name not in VOID:
                stack.append((name, key))
            elif kind == "close" and stack and stack[-1][0] == name:
                stack.pop()
            elif kind == "open" and stack and stack[-1][0] == name:
                stack.append((name, key))  # nested in an advert: its end must not end the advert
            continue
        elif kind == "open":
            yield from flush()
            top = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), -1)
            if top >= 0 and name in CLOSES.get(stack[top][0], ()):
                del stack[top:]
            elif name in ("li", "dt", "dd", "tr", "td", "th"):
                # ends the last one of its kind that is open in the same list or table
                for i in range(len(stack) - 1, -1, -1):
                    if name in CLOSES.get(stack[i][0], ()):
                        del stack[i:]
                        break
                    if stack[i][0] in SCOPE:
                        break
            if name not in VOID:
                stack.append((name, key))
        else:
            if any(n == name for n, _ in stack):
                yield from flush()
                while stack.pop()[0] != name:
                    pass
            else:
                yield from flush()
    yield from flush()


# A wrapper is a list of items: "path" (a slot) or [mark, [items]] with mark "+"
# (repeated) or "?" (optional).  Sizes of slots are kept beside, by path.


def folded(items: list) -> tuple[list, list[int]]:
    """Tandem repeats of up to 8 items become repeated groups, the shortest first; and
    how many of the given items each stands for."""
    counts = [1] * len(items)
    for width in range(1, 9):
        out, got, i = [], [], 0
        while i < len(items):
            unit, n = items[i:i + width], 1
            while len(unit) == width and items[i + n * width:i + (n + 1) * width] == unit:
                n += 1
            if n > 1:
                out.append(unit[0] if width == 1 and isinstance(unit[0], list) and unit[0][0] == "+" else ["+", unit])
                got.append(sum(counts[i:i + n * width]))
                i += n * width
            else:
                out.append(items[i])
                got.append(counts[i])
                i += 1
        items, counts = out, got
    return items, counts


def fold(items: list) -> list:
    return folded(items)[0]


def _name(item) -> str:
    """Items that may be aligned share a name: a slot's is its path; a group's
    that of its first slot, so a slot meets its own repetition."""
    while isinstance(item, list):
        item = item[1][0]
    return item


def _joined(a, b):
    if a == b:
        return a
    la, lb = isinstance(a, list), isinstance(b, list)
    inner = align(a[1] if la else [a], b[1] if lb else [b])
    marks = {x[0] for x, is_list in ((a, la), (b, lb)) if is_list}
    if "+" in marks:
        inner = ["+", inner]
        return ["?", [inner]] if "?" in marks else inner
    return ["?", inner]


def _rows(n: int, last: np.ndarray, above):
    """Rows 0 to n of a table whose row n is ``last`` and whose row i is made by
    ``above`` from i and row i + 1.  About ``KEPT`` rows are held and those between
    made again, so streams of any length are aligned in the memory of some rows."""
    step, held, row = n // KEPT + 1, {n: last}, last
    for i in range(n - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            held[i] = row
    for low in range(0, n, step):
        part = [held[min(low + step, n)]]
        for i in range(min(low + step, n) - 1, low, -1):
            part.append(above(i, part[-1]))
        yield held[low]
        yield from part[:0:-1]
    yield last


def _upto(row: np.ndarray) -> np.ndarray:
    """The greatest value from each place on, and a 0 behind the last."""
    return np.append(np.maximum.accumulate(row[::-1])[::-1], 0)


def align(a: list, b: list) -> list:
    """The wrapper of both: a longest common subsequence of names is kept and the
    rest becomes optional."""
    if a == b:
        return a
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    nx, ny = [_name(i) for i in x], [_name(i) for i in y]
    if len(x) * len(y) > LARGEST:
        have = set(slots(x))
        more = []
        for item in y:  # goes only if all its slots are there
            if not have.issuperset(slots([item])):
                have.update(slots([item]))
                more.append(item)
        return fold(a[:head] + [i if isinstance(i, list) and i[0] == "?" else ["?", [i]] for i in x + more]
                    + (a[len(a) - tail:] if tail else []))
    names: dict[str, int] = {}
    ix, iy = (np.array([names.setdefault(v, len(names)) for v in n], np.int32) for n in (nx, ny))
    # per row i and place j the length of the longest common subsequence of x[i:] and y[j:]
    best = _rows(len(x), np.zeros(len(y) + 1, np.int32), lambda i, after: _upto(np.where(iy == ix[i], after[1:] + 1, after[:-1])))
    here, after = next(best), next(best, None)
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        both = i < len(x) and j < len(y) and nx[i] == ny[j]
        if not both and i < len(x) and j < len(y) and after[j] < here[j + 1] or i == len(x):
            out.append(y[j] if isinstance(y[j], list) and y[j][0] == "?" else ["?", [y[j]]])
            j += 1
            continue
        if both:
            out.append(_joined(x[i], y[j]))
            j += 1
        else:
            out.append(x[i] if isinstance(x[i], list) and x[i][0] == "?" else ["?", [x[i]]])
        i += 1
        here, after = after, next(best, None)
    return fold(a[:head] + out + (a[len(a) - tail:] if tail else []))


def slots(wrapper: list):
    for item in wrapper:
        if isinstance(item, list):
            yield from slots(item[1])
        else:
            yield item


def places(wrapper: list, items: list) -> list[int]:
    """For each item of a page's folded stream the wrapper's item that it is aligned
    with (-1: none), in order; as many as possible are.  A group may take several."""
    have = [set(slots([w])) for w in wrapper]
    need = [set(slots([i])) for i in items]
    n, m = len(items), len(wrapper)
    step = [0 if isinstance(w, list) else 1 for w in wrapper]
    at: dict[str, list[int]] = {}
    for w, names in enumerate(have):
        for name in names:
            at.setdefault(name, []).append(w)
    ahead = np.arange(m) + np.array(step, int)

    def above(k, after):
        found = np.zeros(m, np.int32)
        for name in need[k]:
            found[at.get(name, [])] += 1
        return _upto(np.maximum(after[:-1], np.where(found == len(need[k]), 1 + after[ahead], 0)))

    # per item k and place w how many of items[k:] can be aligned with wrapper[w:]
    best = _rows(n, np.zeros(m + 1, np.int32), above)
    here, after = next(best), next(best, None)
    out, k, w = [], 0, 0
    while k < n:
        if w < m and need[k] <= have[w] and here[w] == 1 + after[w + step[w]]:
            out.append(w)
            w += step[w]
        elif w < m and here[w] == here[w + 1]:
            w += 1
            continue
        else:
            out.append(-1)
        k += 1
        here, after = after, next(best, None)
    return out


def _parts(path: str) -> list[tuple[str, str]]:
    """Names and marks of a path's elements."""
    return [(k.partition("#")[0].partition(".")[0], k.partition("#")[0].partition(".")[2]) for k in path.split("/") if k]


def is_clutter(path: str, articles: bool = True) -> bool:
    """Whether a container marks the slot as something beside the content.  A
    header inside an article is the article's own.  Without ``articles`` marks on
    articles do not count."""
    inside = False
    for name, marks in _parts(path):
        inside = inside or name in ("article", "main")
        if name in CLUTTER or name == "header" and not inside:
            return True
        if marks and name not in ("html", "body", "main") and (articles or name != "article") and not (inside and marks == "header"):
            return True
    return False


def _layout(path: str) -> tuple[int, str] | None:
    """For a slot in an article or main part that is clutter only by marks of that
    part or of containers around it: their number and the path down to the last."""
    keys = path.split("/")
    names = [n for n, _ in _parts(path)]
    part = next((i for i, n in enumerate(names) if n in ("article", "main")), None)
    if part is None:
        return None
    around = [i for i, (name, marks) in enumerate(_parts(path)[:part + 1]) if marks and name not in ("html", "body", "main")]
    if not around or is_clutter("/".join([*names[:part + 1], *keys[part + 1:]])):
        return None
    return len(around), "/".join(keys[:around[-1] + 1])


def _unformed(paths: list[str], sizes: dict[str, int]) -> dict[str, str]:
    """The paths with forms that are layout seen as plain containers: forms around an
    article or main part, or whose headings and paragraphs hold over half of the text
    that nothing else marks."""
    layout, text, total = set(), {}, 0
    for path in paths:
        keys, names = path.split("/"), [n for n, _ in _parts(path)]
        if len(keys) != len(names):
            continue
        plain = not is_clutter("/".join("div" if n == "form" else k for k, n in zip(keys, names, strict=True)))
        total += sizes.get(path, 0) * plain
        for i in [i for i, n in enumerate(names) if n == "form"]:
            form, below = "/".join(keys[:i + 1]), names[i + 1:]
            if "article" in below or "main" in below:
                layout.add(form)
            elif plain and any(n in ("p", "h1", "h2", "h3", "h4", "h5", "h6") for n in below):
                text[form] = text.get(form, 0) + sizes.get(path, 0)
    layout.update(form for form, n in text.items() if 2 * n > total)
    out = {}
    for path in paths:
        keys = path.split("/")
        out[path] = "/".join("div" if "/".join(keys[:i + 1]) in layout else k for i, k in enumerate(keys)) if layout else path
    return out


def content_slots(wrapper: list, sizes: dict[str, int]) -> list[str]:
    """The paths of the wrapper's slots that are content."""
    seen = _unformed(sorted(set(slots(wrapper))), sizes)
    for articles in (True, False):  # marks on articles count unless nothing would be left
        plain = [s for s, path in seen.items() if not is_clutter(path, articles)]
        for part in ("article", "main"):
            inside = [s for s in plain if any(n == part for n, _ in _parts(s))]
            if inside:
                return inside
        # no part outside marked containers: a container around the part is layout, the one with the fewest marks and most text
        held = {s: got for s, path in seen.items() if (got := _layout(path))}
        if held:
            text: dict[tuple[int, str], int] = {}
            for s, (n, top) in held.items():
                text[-n, top] = text.get((-n, top), 0) + sizes.get(s, 0)
            n, top = max(sorted(text), key=lambda k: (k[0], text[k]))
            return [s for s, got in held.items() if got == (-n, top)]
        if plain:
            return plain
    return []


def holders(path: str) -> list[str]:
    """The containers around a slot that may be a template as a whole, the outermost
    first: those inside the article or main part, or inside the body."""
    keys, names = path.split("/"), [n for n, _ in _parts(path)]
    part = next((i for i, n in enumerate(names) if n in ("article", "main")), -1)
    return ["/".join(keys[:i + 1]) for i in range(part + 1, len(names)) if names[i] in HOLDERS]


def templates(wrapper: list, paths: list[str], texts: dict, contents: int, chars: float) -> list[tuple[int, str]]:
    """The places (item of the wrapper, path) among the content slots ``paths`` that
    are the host's template.  ``texts`` tells per place whether all pages have the
    same text there, on how many pages of different content, and how long it is.

    A place is constant if it has one text on ``LEAST`` contents or more; if the
    wrapper has it as optional, on a tenth of the host's ``contents`` too.  A
    container is a template if all its neighbouring places are constant, so a heading
    that all pages have stays with the varying text below it.  If templates held more
    than half of ``chars`` (the mean page's content), the pages are copies of each
    other: nothing is a template."""
    good, constant, out = set(paths), set(), set()
    for (w, path), (same, count, _) in texts.items():
        optional = isinstance(wrapper[w], list) and wrapper[w][0] == "?"
        if same and path in good and count >= LEAST and not (optional and count * 10 < contents):
            constant.add((w, path))
    if not constant:
        return []
    slot_sets = [sorted(good.intersection(slots([item]))) for item in wrapper]
    for holder in sorted({h for _, path in constant for h in holders(path)}):
        run: list[tuple[int, str]] = []
        for w in range(len(wrapper) + 1):
            here = [(w, p) for p in slot_sets[w] if p == holder or p.startswith(holder + "/")] if w < len(wrapper) else []
            if not here:
                if run and constant.issuperset(run):
                    out.update(run)
                run = []
            run += here
    if 2 * sum(texts[place][2] for place in out) > chars:
        return []
    return sorted(out)


def _merge(wrappers):
    """One wrapper from JSON texts of several."""
    out = None
    for w in wrappers:
        items = json.loads(w)
        out = items if out is None else align(out, items)
    return json.dumps(out or [])


def _digest(texts) -> int:
    h = blake2b(digest_size=8)
    for t in texts:
        h.update(t.encode("utf-8", "surrogatepass") + b"\n")
    return int.from_bytes(h.digest(), "big", signed=True)


def _stream(page: str | None):
    """A page's folded stream, sizes by path, digest of its content and, for each
    text that may belong to a template, (item of the stream, path, digest, length)."""
    found = list(blocks(page))
    items, counts = folded([p for p, _ in found])
    sizes: dict[str, int] = {}
    for p, t in found:
        sizes[p] = sizes.get(p, 0) + len(t)
    clutter = {p: is_clutter(p) for p in sizes}
    held = {p: not clutter[p] and bool(holders(p)) for p in sizes}
    inner = {p for p in sizes if not clutter[p] and any(n in ("article", "main") for n, _ in _parts(p))}
    content = _digest(t for p, t in found if (p in inner if inner else not clutter[p]))
    marks, at = [], 0
    for k, n in enumerate(counts):
        texts: dict[str, list[str]] = {}
        for p, t in found[at:at + n]:
            if held[p]:
                texts.setdefault(p, []).append(t)
        marks += [{"k": k, "path": p, "sig": _digest(ts), "n": sum(map(len, ts))} for p, ts in texts.items()]
        at += n
    return json.dumps(items), list(sizes.items()), content, marks


def infer(pages: DataFrame, host: str, html: str, group: int = GROUP) -> DataFrame:
    """(host, paths, rule): the content slots of each host's wrapper, and a JSON text
    [paths, wrapper, templates] for ``main_text``; the wrapper is left out where the
    host has no template."""
    schema = T.StructType.fromDDL("host string, stream string, sizes map<string, bigint>, content bigint, "
                                  "marks array<struct<k: int, path: string, sig: bigint, n: bigint>>")
    types = pa.schema([
        ("host", pa.string()), ("stream", pa.string()), ("sizes", pa.map_(pa.string(), pa.int64())), ("content", pa.int64()),
        ("marks", pa.list_(pa.struct([("k", pa.int32()), ("path", pa.string()), ("sig", pa.int64()), ("n", pa.int64())])))])

    def streams(batches):
        for batch in small(batches):
            out = list(zip(*map(_stream, batch.column(1).to_pylist()), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), *(pa.array(x, f.type) for x, f in zip(out, list(types)[1:], strict=True))], schema=types)

    seen = land(pages.select(F.col(host).alias("host"), F.col(html)).mapInArrow(streams, schema), "page-streams")
    sizes = seen.select("host", F.explode("sizes").alias("path", "n")).groupBy("host", "path").agg(F.sum("n").alias("n"))
    level = seen.select("host", F.col("stream").alias("wrapper")).distinct()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [_merge(sorted(pdf["wrapper"]))]})

    while True:
        level = land(level, "page-wrappers")
        most = level.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        # every host's streams in groups of about ``group``
        n = level.groupBy("host").agg((F.ceil(F.count("*") / group)).alias("groups"))
        part = F.pmod(F.xxhash64("wrapper"), F.col("groups"))
        level = (level.join(n, "host").withColumn("part", F.when(F.col("groups") > 1, part).otherwise(F.lit(0)))
                 .drop("groups").groupBy("host", "part").applyInPandas(merged, "host string, wrapper string"))

    def placed(batches):
        for batch in small(batches, 50):
            host, stream, k, w = [], [], [], []
            for h, s, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = places(json.loads(whole), json.loads(s))
                host += [h] * len(got)
                stream += [s] * len(got)
                k += range(len(got))
                w += got
            yield pa.RecordBatch.from_arrays([
                pa.array(host, pa.string()), pa.array(stream, pa.string()), pa.array(k, pa.int32()), pa.array(w, pa.int32())],
                ["host", "stream", "k", "w"])

    # the texts of all pages at each place of the wrapper, pages of one content counted once
    held = seen.where(F.size("marks") > 0)
    spots = held.select("host", "stream").distinct().join(level, "host").select("host", "stream", "wrapper").mapInArrow(
        placed, "host string, stream string, k int, w int").where("w >= 0")
    texts = (held.select("host", "stream", "content", F.inline("marks")).join(spots, ["host", "stream", "k"])
             .groupBy("host", "w", "path", "content").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.max("n").alias("n"))
             .groupBy("host", "w", "path").agg((F.min("lo") == F.max("hi")).alias("same"), F.count("*").alias("count"), F.max("n").alias("n"))
             .groupBy("host").agg(F.collect_list(F.struct("w", "path", "same", "count", "n")).alias("texts")))
    totals = (seen.groupBy("host", "content").agg(F.count("*").alias("pages"))
              .groupBy("host").agg(F.count("*").alias("contents"), F.sum("pages").alias("pages")))
    weights = sizes.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "n"))).alias("sizes"))

    def chosen(batches):
        for batch in small(batches):
            out = []
            for w, s, t, contents, n in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                wrapper, size = json.loads(w), dict(s or [])
                paths = content_slots(wrapper, size)
                found = {(x["w"], x["path"]): (x["same"], x["count"], x["n"]) for x in t or []}
                gone = templates(wrapper, paths, found, contents, sum(size.get(p, 0) for p in paths) / n)
                out.append((paths, json.dumps([paths, wrapper if gone else [], gone])))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([x[0] for x in out], pa.list_(pa.string())), pa.array([x[1] for x in out], pa.string())],
                ["host", "paths", "rule"])

    return land(level.join(weights, "host", "left").join(texts, "host", "left").join(totals, "host")
                .select("host", "wrapper", "sizes", "texts", "contents", "pages")
                .mapInArrow(chosen, "host string, paths array<string>, rule string"), "page-rules")


def main_text(page: str | None, rule: tuple) -> str:
    """The text of a page by its host's rule (content paths, wrapper, templates)."""
    found = list(blocks(page))
    good, wrapper, gone = rule
    if not any(p in good for p, _ in found):  # a page unlike its host's wrapper is read by its own
        sizes: dict[str, int] = {}
        for p, t in found:
            sizes[p] = sizes.get(p, 0) + len(t)
        good, gone = set(content_slots([p for p, _ in found], sizes)), ()
    if not gone:
        return "\n".join(t for p, t in found if p in good)
    items, counts = folded([p for p, _ in found])
    at = [w for w, n in zip(places(wrapper, items), counts, strict=True) for _ in range(n)]
    return "\n".join(t for (p, t), w in zip(found, at, strict=True) if p in good and (w, p) not in gone)


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``out`` (a column of that name gives
    way)."""
    pages = pages.drop(out)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))
    rules = infer(pages.select(host.alias("__host"), html), "__host", html).select(F.col("host").alias("__host"), F.col("rule").alias("__rule"))
    both = pages.withColumn("__host", host).join(rules, "__host", "left")
    names = pages.columns

    def read(batches):
        known: dict[str, tuple] = {}  # rules of a task's last hosts
        for batch in small(batches):
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts = []
            for page, text in zip(cols[html].to_pylist(), cols["__rule"].to_pylist(), strict=True):
                rule = known.get(text)
                if rule is None:
                    if len(known) >= 100:
                        known.clear()
                    paths, wrapper, gone = json.loads(text or "[[], [], []]")
                    rule = known[text] = set(paths), wrapper, {(w, p) for w, p in gone}
                texts.append(main_text(page, rule))
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in names), pa.array(texts, pa.string())], [*names, out])

    return both.select(*names, "__rule").mapInArrow(
        read, T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())]))


def op1_wrappers(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
