"""XML documents cut into rows by many tasks, with proof that nothing was lost.

A document is read as byte splits.  Where a split begins, nobody knows yet whether
it is inside a tag, a comment, a CDATA section or an open row, so the scan has two
phases, as a prefix sum has:

1. Each block (consecutive bytes of a split, about a megabyte) is lexed from every
   state it may begin in.  What is kept of it is small: for each of these states the
   state at its end, the elements it closes that were open before, and those it
   leaves open.
2. Per document these effects are composed in order, one entry per block.  That
   gives every block its true state and its open elements, and it checks the
   document: end tags that match, one root, nothing open at the end.  A truncated
   or unbalanced document is an error that names the file.
3. Each block, now with its state, gives out its rows; a row that reaches over a
   border is put together from its pieces by row.  Rows of nothing but cells are
   given out as cells, the others as text.

Splits are read up to the ends of rows ("</row>") if a file's begin holds one, else
from "<" to "<", which any document has but which makes many small records.

Rows may be nested at any depth: text belongs to the innermost open row.  Encodings
are those of 8-bit supersets of ASCII and UTF-16, where a block is lexed for both
byte orders and both alignments and the document's head and the block's offset pick
the right one.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from bisect import bisect_left
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

BLOCK = 1 << 20  # bytes of a block
ROW = b"row"
HEAD = 1 << 16  # bytes of a document in which its prolog ends
TEXT, COMMENT, CDATA, PI, DOCTYPE, TAG, QUOTE, APOSTROPHE = range(8)
_IN_TAG = (TAG, QUOTE, APOSTROPHE)
_CLOSERS = {COMMENT: b"-->", CDATA: b"]]>", PI: b"?>"}
_ATTRIBUTES = rb"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+"
_MARKUP = re.compile(
    rb"<(?:(!--)|(!\[CDATA\[)|(\?)|(!DOCTYPE)|/([^\s>]*+)[^>]*+(>)?|([^\s/>!?<\"'=]++)(" + _ATTRIBUTES + rb")(>)?)")
_REST = re.compile(_ATTRIBUTES + rb"(>)?")
# an element of texts, CDATA sections, comments and elements without elements in them, as one match; its loop is
# not possessive, since re loses marks of groups in such loops, and there is one way to match it all the same
_NAME = rb"[^\s/>!?<\"'=]++"
_PLAIN_ATTRIBUTES = rb"[^\"'<>]*+(?:(?:\"[^\"<]*+\"|'[^'<]*+')[^\"'<>]*+)*+"
_SECTION = rb"<!(?:\[CDATA\[[^\]]*+(?:\](?!\]>)[^\]]*+)*+\]\]>|--[^-]*+(?:-(?!->)[^-]*+)*+-->)"
_LEAF = rb"<(" + _NAME + rb")" + _PLAIN_ATTRIBUTES + rb">(?:(?<=/>)|(?<!/>)[^<]*+(?:" + _SECTION + rb"[^<]*+)*+</\3\s*+>)"
_ELEMENT = re.compile(
    rb"<(" + _NAME + rb")" + _PLAIN_ATTRIBUTES + rb">(?<!/>)([^<]*+(?:(?:" + _LEAF + rb"|" + _SECTION + rb")[^<]*+)*)</\1\s*+>")
_SUBSET = re.compile(rb"[^\[>]*+([\[>])")
_SUBSET_END = re.compile(rb"\]\s*+>")


class Lexer:
    """Tags of 8-bit text from a state on: (opens, name, begin, end) and, after the
    last, the ``state`` reached.  A name of None closes whatever is open.  ``starts``
    tells where markup began."""

    def __init__(self, text: bytes, state: int, row: bytes | None = None):
        """Elements that hold little are gone over at once, so that tags within them
        are left out, but for those that hold a ``row``."""
        self.text, self.state, self.inner = text, state, row and b"<" + row
        self.begin, self.closes = self._begin()
        self.starts: list[int] = []

    def _tag_end(self, at: int):
        """Inside a tag: end and whether it closes itself, or None and the state."""
        m = _REST.match(self.text, at)
        if m[1]:
            self.state = TEXT
            return m.end(), self.text[m.end() - 2:m.end() - 1] == b"/"
        left = self.text[m.end():m.end() + 1]
        self.state = QUOTE if left == b'"' else APOSTROPHE if left == b"'" else TAG
        return None, False

    def _begin(self):
        """Where text goes on after what the block begins in, and whether a tag
        that ends there closes itself; None if it does not end."""
        s, state = self.text, self.state
        if state == TEXT:
            return 0, False
        if state in _CLOSERS:
            at = s.find(_CLOSERS[state])
            return (None, False) if at < 0 else (at + len(_CLOSERS[state]), False)
        if state == DOCTYPE:
            m = _SUBSET_END.search(s)
            return (m.end() if m else None), False
        at = 0
        if state in (QUOTE, APOSTROPHE):
            at = s.find(b'"' if state == QUOTE else b"'") + 1
            if not at:
                return None, False
        return self._tag_end(at)

    def __iter__(self):
        s, at = self.text, self.begin
        if at is None:
            return
        self.state = TEXT
        if self.closes:
            yield False, None, at, at
        while True:
            at = s.find(b"<", at)
            if at < 0:
                return
            self.starts.append(at)
            m = _ELEMENT.match(s, at)
            if m and not (self.inner and s.find(self.inner, *m.span(2)) >= 0):
                yield True, m[1], at, m.start(2)
                yield False, m[1], m.end(2), m.end()
                at = m.end()
                continue
            m = _MARKUP.match(s, at)
            if m is None:
                yield False, b"<", at, at  # no markup: an end tag that matches nothing
                return
            if m[7] is not None:
                if m[9]:
                    end = m.end()
                else:
                    self.state = TAG
                    left = s[m.end():m.end() + 1]
                    self.state = QUOTE if left == b'"' else APOSTROPHE if left == b"'" else TAG
                    end = len(s)
                yield True, m[7], at, end
                if m[9] and m[8].endswith(b"/"):
                    yield False, m[7], at, end
                at = end
                if not m[9]:
                    return
            elif m[5] is not None:
                # an end tag is not cut by a border, but for element names beyond ASCII in UTF-16
                yield False, m[5] if m[6] else b"<", at, m.end()
                at = m.end()
            else:
                kind = COMMENT if m[1] else CDATA if m[2] else PI if m[3] else DOCTYPE
                if kind == DOCTYPE:
                    head = _SUBSET.match(s, m.end())
                    close = _SUBSET_END.search(s, head.end()) if head and head[1] == b"[" else head
                    at = close.end() if close else -1
                else:
                    at = s.find(_CLOSERS[kind], m.end())
                    at += len(_CLOSERS[kind]) if at >= 0 else 0
                if at < 0:
                    self.state = kind
                    return


def _reduced(tags, state: int) -> list:
    """[end state, names closed that were open before, [name, place] left open,
    first mismatch or null, elements begun at the lowest level]."""
    closes, opens, bad, base = [], [], None, 0
    for begins, name, at, _ in tags:
        if begins:
            base += not opens
            opens.append((name, at))
        elif opens:
            if name is not None and opens[-1][0] != name:
                bad = bad or f"</{name.decode('latin-1')}> after <{opens[-1][0].decode('latin-1')}>"
            opens.pop()
        else:
            closes.append(None if name is None else name.decode("latin-1"))
            base = 0
    return [state, closes, [[name.decode("latin-1"), at] for name, at in opens], bad, base]


def row_tags(tags, state: int, row: bytes) -> bytes:
    """What ``pieces`` needs of a block's tags, if it begins in plain text: the state
    at the end, and [1 for a begin and 2 more for a row, begin, end] for each."""
    out = [state]
    for begins, name, at, end in tags:
        if not begins and len(out) > 3 and out[-3] == 1:  # an element without rows in it
            del out[-3:]
        else:
            out += begins + 2 * (begins and name == row), at, end
    return array("i", out).tobytes()


def effects_of(text: bytes, states, plain: Lexer | None = None, tags: list | None = None) -> dict[int, list]:
    """The effect of a block from each of the states.  From most of them the lexer
    soon is where it is from plain text too, at the begin of the same markup; from
    there on the tags are the same and are not looked for again.  ``tags`` are those
    that ``plain``, a lexer from plain text, has given."""
    if plain is None:
        plain = Lexer(text, TEXT)
        tags = list(plain)
    starts = set(plain.starts)
    out, known = {}, {}
    for state in states:
        lexer = plain if state == TEXT else Lexer(text, state)
        key = lexer.begin, lexer.closes
        if state == TEXT:
            out[state] = _reduced(tags, plain.state)
        elif lexer.begin is None:
            out[state] = _reduced([], lexer.state)
        elif key in known:
            out[state] = known[key]
        else:
            found, end = [], None
            for tag in lexer:
                if tag[1] is not None and tag[2] in starts:
                    found += tags[bisect_left(tags, tag[2], key=lambda t: t[2]):]
                    end = plain.state
                    break
                found.append(tag)
            out[state] = known[key] = _reduced(found, lexer.state if end is None else end)
    return out


def aligned(block: bytes, form: str, before: bytes = b"x") -> bytes:
    """A block's bytes from code unit to code unit: with the byte before it if it
    begins within a unit, without its last one if it ends within one."""
    if form == "8":
        return block
    block = block if form[1] == "0" else before + block
    return block[:len(block) - len(block) % 2]


def units(block: bytes, form: str) -> bytes:
    """A block as 8-bit text: itself, or its UTF-16 code units with those beyond 8
    bits as a letter."""
    if form == "8":
        return block
    # a block begins at a byte 3C; after a zero byte this is a "<" in big-endian order
    data = aligned(block, form, b"\0" if form == "B1" else b"x")
    low, high = (data[0::2], data[1::2]) if form[0] == "L" else (data[1::2], data[0::2])
    if not high.strip(b"\0"):
        return low
    return bytes([a if not b else 120 for a, b in zip(low, high, strict=True)])


def forms(block: bytes) -> list[str]:
    """What a block may be: UTF-16 documents have zero bytes in their tags, and
    only a short block may hold none."""
    wide = ["L0", "L1", "B0", "B1", "B2"]
    return wide if b"\0" in block[:4096] else ["8"] if len(block) >= 4096 else ["8", *wide]


_CODECS = {"UTF-8": "utf-8", "ISO-8859-1": "latin-1", "WINDOWS-1252": "cp1252", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be"}


def encoding_of(head: bytes) -> str:
    """By byte-order mark, else as declared, else UTF-8."""
    if head[:2] in (b"\xff\xfe", b"<\0"):
        return "UTF-16LE"
    if head[:2] in (b"\xfe\xff", b"\0<"):
        return "UTF-16BE"
    m = re.match(rb"(?:\xef\xbb\xbf)?\s*<\?xml[^>]*?encoding\s*=\s*[\"']([^\"']+)", head)
    name = m[1].decode("latin-1").upper() if m else "UTF-8"
    known = {"UTF8": "UTF-8", "US-ASCII": "UTF-8", "LATIN1": "ISO-8859-1", "LATIN-1": "ISO-8859-1", "CP1252": "WINDOWS-1252"}
    name = known.get(name, name)
    if name not in _CODECS:
        raise ValueError(f"XML encoding not supported: {name}")
    return name


_BLOCKS = "source_file string, at long, seq int, size long, last string, effects string, tags binary, head binary, block binary"


def _read_blocks(size: int, sep: bytes):
    """Blocks of the records that ``sep`` parts.  A split but a file's first begins
    with it.  Blocks within a split begin at a "<" or after the end of a row."""
    ends = sep != b"<"

    def run(batches):
        def records():
            for batch in batches:
                files, ats, values = batch.columns
                # a batch holds few splits
                begins = [0, *(i for i in range(1, len(ats)) if ats[i] != ats[i - 1] or files[i] != files[i - 1])] if (
                    len(ats) and (pc.min_max(ats)["min"] != pc.min_max(ats)["max"] or pc.min_max(files)["min"] != pc.min_max(files)["max"])
                ) else [0][:len(ats)]
                for i, j in zip(begins, [*begins[1:], len(ats)], strict=True):
                    yield (files[i].as_py(), ats[i].as_py()), values.slice(i, j - i).to_pylist()

        def blocks():
            now, seq, parts, n = None, 0, [], 0
            for key, values in records():
                for value in values:
                    if key != now or n >= size:
                        if now is not None:
                            yield now, seq, sep.join(parts) + (sep if ends and key == now else b"")
                        seq = seq + 1 if key == now else 0
                        parts = [] if seq and ends or key[1] == 0 and not seq else [b""]
                        now, n = key, 0
                    parts.append(value)
                    n += len(value) + len(sep)
            if now is not None:
                yield now, seq, sep.join(parts)

        for (file, at), seq, block in blocks():
            first, near = at == 0 and not seq, at + seq * size < HEAD
            found, of_rows = {}, None
            for form in forms(block):
                text = units(block, form)
                states = (TEXT,) if first else (TEXT, COMMENT, CDATA, PI, DOCTYPE) if form == "8" else range(8)
                plain = Lexer(text, TEXT, ROW)
                tags = list(plain)
                found[form] = effects_of(text, states, plain, tags)
                if form == "8":
                    of_rows = row_tags(tags, plain.state, ROW)
            yield pa.RecordBatch.from_pylist([{
                "source_file": file, "at": at, "seq": seq, "size": len(block), "last": block[-1:].hex(),
                "effects": json.dumps(found), "tags": of_rows,
                "head": block[:HEAD] if near else None, "block": block}], arrow)

    fields = [("source_file", pa.string()), ("at", pa.int64()), ("seq", pa.int32()), ("size", pa.int64()),
              ("last", pa.string()), ("effects", pa.string()), ("tags", pa.binary()), ("head", pa.binary()), ("block", pa.binary())]
    arrow = pa.schema(fields)
    return run


def compose(blocks: list[dict]) -> list[dict]:
    """The true state and open elements at the begin of each block of a document;
    raises if the document is not balanced."""
    file = blocks[0]["source_file"]

    def no(reason: str):
        raise ValueError(f"not a whole XML document: {file}: {reason}")

    encoding = encoding_of(blocks[0]["head"])
    head = b""
    for b in blocks:
        if b["head"] is None or len(head) >= HEAD:
            break
        head += b["head"]
    head = head[:HEAD]
    begin = Lexer(units(head, "8" if encoding[:6] != "UTF-16" else f"{encoding[6]}0"), TEXT)
    if next(iter(begin), None) is None and begin.state == DOCTYPE and len(head) == HEAD:
        no(f"its prolog does not end within {HEAD} bytes")
    prolog = head.decode(_CODECS[encoding], "replace")
    declared = json.dumps(declared_entities(prolog))
    state, stack, offset, before, roots, out = TEXT, [], 0, "", 0, []
    for b in blocks:
        form = "8" if encoding[:6] != "UTF-16" else f"{encoding[6]}{offset % 2}"
        form = "B2" if form == "B1" and before != "00" else form
        effects = json.loads(b["effects"])
        if form not in effects:
            no(f"its encoding is not {encoding} throughout" if b is not blocks[0] else f"it is not in {encoding}")
        if str(state) not in effects[form]:
            no("a tag holds a <")
        out.append({"source_file": file, "at": b["at"], "seq": b["seq"], "form": form, "encoding": encoding, "state": state,
                    "stack": json.dumps(stack), "before": before, "declared": declared, "prolog": None if out else prolog})
        state, closes, opens, bad, base = effects[form][str(state)]
        if bad:
            no(bad)
        for name in closes:
            if not stack:
                no(f"</{name}> without a begin")
            if name is not None and stack[-1][0] != name:
                no(f"</{name}> after <{stack[-1][0]}>")
            stack.pop()
        if not stack:
            roots += base
        stack = stack + [[name, b["at"], b["seq"], place] for name, place in opens]
        offset, before = offset + b["size"], b["last"]
    if state != TEXT:
        no("it ends inside a tag, comment or section")
    if stack:
        no(f"<{stack[-1][0]}> has no end")
    if roots != 1:
        no(f"{roots} root elements")
    return out


_STARTS = "source_file string, at long, seq int, form string, encoding string, state int, stack string, before string, declared string, prolog string"
_PIECES = ("source_file string, row_at long, row_seq int, row_place long, at long, seq int, kind int, "
           "encoding string, body binary, cells map<string,string>")


def _composed(table):
    blocks = sorted(table.to_pylist(), key=lambda b: (b["at"], b["seq"]))
    return pa.Table.from_pylist(compose(blocks), pa.schema([
        ("source_file", pa.string()), ("at", pa.int64()), ("seq", pa.int32()), ("form", pa.string()),
        ("encoding", pa.string()), ("state", pa.int32()), ("stack", pa.string()),
        ("before", pa.string()), ("declared", pa.string()), ("prolog", pa.string())]))


def pieces(b: dict, row: bytes = ROW):
    """(row's key, whole, bytes) of the rows that a block holds or goes on with.
    ``tags`` of a block are those of a lexer from plain text (``row_tags``)."""
    block, wide = aligned(b["block"], b["form"], bytes.fromhex(b["before"])), 1 if b["form"] == "8" else 2
    if b.get("tags") and b["form"] == "8" and b["state"] == TEXT:
        tags = array("i", b["tags"])
        first, ends, length = 0, tags[0], len(block)
        tags = zip(tags[1::3], tags[2::3], tags[3::3], strict=True)
    else:
        text = units(b["block"], b["form"])
        lexer, length = Lexer(text, b["state"], row), len(text)
        first, found = lexer.begin, list(lexer)
        ends = lexer.state
        tags = ((begins + 2 * (begins and name == row), at, end) for begins, name, at, end in found)
    stack = [(at, seq, place) if name == row.decode() else None for name, at, seq, place in json.loads(b["stack"])]
    rows = [[key, False, []] for key in stack if key]  # key, whether it begins here, segments
    begin = 0
    if rows and stack[-1] and b["state"] in _IN_TAG:
        # the rest of the row's own begin tag, which a border has cut
        begin = length if first is None else first

    def cut(end):
        return block[begin * wide:len(block) if end is None else end * wide]

    for kind, at, end in tags:
        if kind:
            key = None
            if kind == 3:
                if rows:
                    rows[-1][2].append(cut(at))
                key, begin = (b["at"], b["seq"], at), end
                rows.append([key, True, []])
            stack.append(key)
        else:
            key = stack.pop()
            if key:
                key, whole, segments = rows.pop()
                segments.append(cut(at))
                yield key, whole, b"".join(segments)
                begin = end
    for i, (key, _, segments) in enumerate(rows):
        if i == len(rows) - 1 and not (stack[-1] and ends in _IN_TAG):
            segments.append(cut(None))
        yield key, False, b"".join(segments)


_DOCTYPE = re.compile(r"(?s)<!DOCTYPE[^\[>]*\[(.*?)\]\s*>", re.A)
_ENTITY = re.compile(r"""<!ENTITY\s+([^\s%"']+)\s+["']([^"']*)["']\s*>""", re.A)
_CELL = re.compile(
    r"""[ \t\n]*+<cell((?:[ \t\n]++[A-Za-z_][A-Za-z0-9_.-]*+[ \t\n]*+=[ \t\n]*+(?:"[^"<&\x00-\x1f]*+"|'[^'<&\x00-\x1f]*+'))*+)[ \t\n]*+>"""
    r"""((?:[^<\x00-\x08\x0b-\x1f\ufffe\uffff]++|<!\[CDATA\[(?:[^\]\x00-\x08\x0b-\x1f\ufffe\uffff]++|\](?!\]>))*+\]\]>)*+)"""
    r"""</cell[ \t\n]*+>[ \t\n]*+"""
    r"""|[ \t\n]*+<(?!(?i:cell)>)([A-Za-z][A-Za-z0-9_.-]*+)>[^<&\]\x00-\x08\x0b-\x1f\ufffe\uffff]*+</\3[ \t\n]*+>[ \t\n]*+"""
    r"""|([\s\S])""")
_CELL_ATTRIBUTE = re.compile(r"""([A-Za-z_][A-Za-z0-9_.-]*+)[ \t\n]*+=[ \t\n]*+(?:"([^"]*+)"|'([^']*+)')""")
_REFERENCE = re.compile(r"&(?:(amp|lt|gt|quot|apos)|#([0-9]{1,7})|#x([0-9a-fA-F]{1,6}));")
_PREDEFINED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def declared_entities(prolog: str) -> list[list[str]]:
    """[name, replacement] of a document's prolog, as ``files.declared_entities``."""
    m = _DOCTYPE.search(prolog)
    return [[e[1], e[2]] for e in _ENTITY.finditer(m[1])] if m else []


class _Odd(ValueError):
    """A row that is left to the XML parser."""


def _referred(m):
    if m[1]:
        return _PREDEFINED[m[1]]
    c = int(m[2]) if m[2] else int(m[3], 16)
    if not (c in (9, 10, 13) or 32 <= c < 0xD800 or 0xE000 <= c < 0xFFFE or 0x10000 <= c < 0x110000):
        raise _Odd
    return chr(c)


def _resolved(text: str, entities) -> str:
    """Character data outside CDATA sections without its references."""
    if "&" in text:
        for name, value in entities:
            text = text.replace(f"&{name};", value)
        if "<" in text or _REFERENCE.sub("", text).find("&") >= 0:
            raise _Odd
    if "]]>" in text:
        raise _Odd
    return _REFERENCE.sub(_referred, text) if "&" in text else text


def _cell_name(attributes: str) -> str:
    found = _CELL_ATTRIBUTE.findall(attributes)
    names = [name for name, _, _ in found]
    if names.count("name") != 1 or len(set(names)) < len(names) or any(n != "name" and n.lower() in ("name", "value") for n in names):
        raise _Odd
    return next(v or w for name, v, w in found if name == "name")


def plain_cells(body: str, entities, names: dict | None = None) -> dict[str, str] | None:
    """The cells of a row that holds nothing but cells of text and CDATA sections (and
    maybe other elements of mere text), by name, as the XML parser reads them, and stripped; else None.  ``entities``
    are put in one after another.  ``names`` keeps names by their attributes."""
    names, cells = {} if names is None else names, {}
    marked = "&" in body or "]]>" in body
    try:
        for attributes, text, other, odd in _CELL.findall(body):
            if odd:
                return None
            if other:  # an element that is no cell
                continue
            name = names.get(attributes)
            if name is None:
                if len(names) >= 1000:
                    names.clear()
                name = names[attributes] = _cell_name(attributes)
            if not marked:
                pass
            elif "<" in text:
                first, *parts = text.split("<![CDATA[")
                out = [_resolved(first, entities)]
                for part in parts:
                    section, rest = part.split("]]>", 1)
                    out += section, _resolved(rest, entities)
                text = "".join(out)
            elif "&" in text or "]]>" in text:
                text = _resolved(text, entities)
            cells[name] = text.strip()
    except _Odd:
        return None
    return cells or None


def _rows(entities):
    """Rows of blocks: plain ones (kind 0) as cells, other whole ones (1) and those
    that a border cuts (2) as bytes."""
    entities = list(entities.items())

    def run(batches):
        text = pa.map_(pa.string(), pa.string())
        arrow = pa.schema([("source_file", pa.string()), ("row_at", pa.int64()), ("row_seq", pa.int32()), ("row_place", pa.int64()),
                           ("at", pa.int64()), ("seq", pa.int32()), ("kind", pa.int32()), ("encoding", pa.string()),
                           ("body", pa.binary()), ("cells", text)])

        def batch_of(b, kind, n, keys, bodies, cells):
            constant = lambda v, t: pa.repeat(pa.scalar(v, t), n)
            return pa.RecordBatch.from_arrays([
                constant(b["source_file"], pa.string()), *[pa.array([k[i] for k in keys], t) if keys else pa.nulls(n, t) for i, t in enumerate(
                    (pa.int64(), pa.int32(), pa.int64()))],
                constant(b["at"], pa.int64()), constant(b["seq"], pa.int32()), constant(kind, pa.int32()), constant(b["encoding"], pa.string()),
                pa.array(bodies, pa.binary()) if bodies else pa.nulls(n, pa.binary()), cells or pa.nulls(n, text)], schema=arrow)

        names = {}
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time as Python objects
                (b,) = batch.slice(i, 1).to_pylist()
                codec, known = _CODECS[b["encoding"]], [*map(tuple, json.loads(b["declared"])), *entities]
                ends, keys, values, whole, cut = [0], [], [], [], []
                for key, begins, body in pieces(b):
                    if not begins:
                        cut.append((key, body))
                    elif body:
                        try:
                            cells = plain_cells(body.decode(codec), known, names)
                        except UnicodeDecodeError:
                            cells = None
                        if cells is None:
                            whole.append(body)
                        else:
                            keys += cells
                            values += cells.values()
                            ends.append(len(keys))
                if len(ends) > 1:
                    cells = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
                    yield batch_of(b, 0, len(ends) - 1, None, None, cells)
                if whole:
                    yield batch_of(b, 1, len(whole), None, whole, None)
                if cut:
                    yield batch_of(b, 2, len(cut), [k for k, _ in cut], [body for _, body in cut], None)

    return run


def _text(body, encoding):
    return (F.when(encoding == "UTF-8", body.cast("string")).when(encoding == "UTF-16LE", F.decode(body, "UTF-16LE"))
            .when(encoding == "UTF-16BE", F.decode(body, "UTF-16BE")).when(encoding == "ISO-8859-1", F.decode(body, "ISO-8859-1"))
            .otherwise(F.decode(body, "windows-1252")))


_ROW_END = b"</row>"


def _of_rows(spark: SparkSession, files: list[str]) -> list[bool]:
    """Whether splits of a file are read up to the ends of rows: one is in its begin,
    and none is its very end, which the reader of records leaves out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    utils = jvm.org.apache.commons.io.IOUtils

    def part(fs, path, at, n):
        stream = fs.open(path)
        try:
            stream.seek(at)
            return bytes(utils.toByteArray(stream, n))
        finally:
            stream.close()

    def one(file):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        fs = path.getFileSystem(conf)
        size = fs.getFileStatus(path).getLen()
        head = part(fs, path, 0, min(HEAD, size))
        end = min(len(_ROW_END), size)
        return _ROW_END in head and b"\0" not in head and part(fs, path, size - end, end) != _ROW_END

    with ThreadPoolExecutor(max_workers=8) as pool:
        return list(pool.map(one, files))


def read_rows(spark: SparkSession, paths: list[str], block: int = BLOCK,
              entities: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: source_file, body, cells; prologs: source_file, prolog) of XML documents.
    A row of nothing but cells has ``cells``, its texts by name, any other its
    ``body``.  The documents are checked when this is called."""
    paths = list(dict.fromkeys(paths))

    def records(sep: bytes):
        return spark.read.option("lineSep", sep.decode()).text(paths).select(
            F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("at"),
            F.col("value").cast("binary").alias("value"))

    def blocks_of(raw, sep):
        return raw.mapInArrow(_read_blocks(block, sep), _BLOCKS)

    raw = records(_ROW_END)
    files = list(raw.inputFiles())
    of_rows = _of_rows(spark, files)
    if all(of_rows):
        blocks = blocks_of(raw, _ROW_END)
    elif not any(of_rows):
        blocks = blocks_of(records(b"<"), b"<")
    else:
        few = sum(of_rows) * 2 < len(files)
        named = F.col("source_file").isin([f for f, r in zip(files, of_rows, strict=True) if r == few])
        blocks = blocks_of(raw.where(named if few else ~named), _ROW_END).union(
            blocks_of(records(b"<").where(~named if few else named), b"<"))
    blocks = materialize(blocks, "xml-blocks")
    starts = materialize(blocks.drop("block", "tags").groupBy("source_file").applyInArrow(_composed, _STARTS), "xml-states")
    if starts.where("prolog is not null").count() < len(files):
        seen = {r["source_file"] for r in starts.where("prolog is not null").select("source_file").toLocalIterator()}
        raise ValueError(f"not a whole XML document: {min(set(files) - seen)}: it is empty")
    known = blocks.select("source_file", "at", "seq", "tags", "block").join(starts.drop("prolog"), ["source_file", "at", "seq"])
    cut = materialize(known.mapInArrow(_rows(entities or {}), _PIECES), "xml-rows")
    place = F.struct("at", "seq", "body")
    joined = cut.where("kind = 2").groupBy("source_file", "row_at", "row_seq", "row_place", "encoding").agg(
        F.sort_array(F.collect_list(place)).alias("parts"))
    joined = joined.select("source_file", "encoding", F.aggregate(
        "parts", F.lit(b""), lambda all_, p: F.concat(all_, p["body"])).alias("body"))
    rows = cut.where("kind = 1").select("source_file", "encoding", "body").union(joined)
    rows = rows.select("source_file", _text(F.col("body"), F.col("encoding")).alias("body"), F.lit(None).cast("map<string,string>").alias("cells"))
    plain = cut.where("kind = 0").select("source_file", F.lit(None).cast("string").alias("body"), "cells")
    return plain.union(rows), starts.where("prolog is not null").select("source_file", "prolog")
