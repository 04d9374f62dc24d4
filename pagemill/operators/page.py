"""The conversion of one page, from its HTML to its body, in one pass over the page.

The rules are those of `tokens`, `nodes`, `select` and `markdown`, which state them as windows and
aggregations over token rows and give the same results (tests/test_page.py compares the two).  Here a
page's tokens stay in lists: a running window is a variable, a window over (page, depth) a dict by
depth, a backward one a loop from the end.  So a task holds one page at a time, and a token costs no
sort.  Patterns are those of the rows' modules; where Java and Python read them differently, what Java
does is written out."""

from __future__ import annotations

import html.entities
import re

import pyarrow as pa

from ..config import ALWAYS_IGNORED, ROOT_FALLBACKS, Config, Step, compile_selector_list
from . import markdown as M
from . import nodes as N
from . import tokens as K

# ---------------------------------------------------------------- strings

_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # (?U)\s
_WS = re.compile(f"[{_SPACE}]+")
_TRIM = " \t\n\r\x00\x0b"
_LATE_END = "\x85\u2028\u2029"  # Java's $ also stands before one of these at the end
_TRIM_LATE = re.compile(f"[{_TRIM}]+(?=[{_LATE_END}]\\Z)")
_NL_LATE = re.compile(f"\n+(?=[{_LATE_END}]\\Z)")
_CR = re.compile("\r\n?")
_BLANKS = re.compile("[ \t]+")
_TICKS = re.compile("`+")
_SHIELDED = re.compile("[\ue000-\ue040]")
_STANDS = re.compile("[\ue020-\ue040]")
_BACK = re.compile("\ue040[\ue020-\ue040]|[^\ue040]+|\ue040")
_TO_STAND = {0xE000 + i: 0xE020 + i for i in range(32)}
_FROM_STAND = {0xE020 + i: 0xE000 + i for i in range(32)}
_ESCAPE = "\ue040"


def trim(s: str) -> str:
    if s and s[-1] in _LATE_END:
        s = _TRIM_LATE.sub("", s)
    return s.strip(_TRIM)


def collapse(s: str) -> str:
    return _WS.sub(" ", s)


def inline(s: str) -> str:
    return trim(_WS.sub(" ", s))


def _fence(s: str, least: int) -> str:
    return "`" * max(least, max(map(len, _TICKS.findall(s)), default=0) + 1) if "`" in s else "`" * max(least, 1)


def inline_code(s: str) -> str:
    t = trim(_BLANKS.sub(" ", _CR.sub("\n", s).replace("\n", " ")))
    if t == "":
        return ""
    f, pad = _fence(t, 1), " " if t[0] == "`" or t[-1] == "`" else ""
    return f + pad + t + pad + f


def code_block(s: str) -> str:
    t = _CR.sub("\n", s)
    if t and t[-1] in _LATE_END:
        t = _NL_LATE.sub("", t)
    t = t.strip("\n")
    if t == "":
        return ""
    f = _fence(t, 3)
    return f"{f}\n{t}\n{f}"


def cell_text(s: str) -> str:
    return inline(inline(s).replace("|", "\\|"))


def shield(s: str) -> str:
    if s.isascii() or not _SHIELDED.search(s):
        return s
    return _STANDS.sub(lambda m: _ESCAPE + m[0], s).translate(_TO_STAND)


def unshield(s: str) -> str:
    if s.isascii() or not _STANDS.search(s):
        return s
    return "".join(p[1:2] if p[0] == _ESCAPE else p.translate(_FROM_STAND) for p in _BACK.findall(s))


# ---------------------------------------------------------------- tokens

_I = re.I | re.A
_RUNS = re.compile(K.RUNS_RX.replace(r"\z", r"\Z"), _I)
_RUN = re.compile(K._RUN_RX)
_RAW = re.compile(K._RAW_RX.replace("(?i)", ""), _I)
_REFERENCE = re.compile(K._REFERENCE_RX, _I)
_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)", re.A)
_ATTR = re.compile(K.ATTR_RX.replace("([^", "(?:[^", 1), re.A)
_ATTR_NAME = re.compile(r"[^\s=]+", re.A)
_ATTR_VALUE = re.compile(r"[^\s=]+\s*=\s*(.*)\Z", re.A | re.S)
_PIECE = re.compile(r"&(?:#([0-9]++)|#[xX]([0-9a-fA-F]++)|([A-Za-z][A-Za-z0-9]{0,31}));")
_HTML5 = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
_UPPER = {c: c + 32 for c in range(65, 91)}
_VOID = frozenset(K.VOID_TAGS)
_KEYS = frozenset(K.ATTR_KEYS)


def _character(m: re.Match) -> str:
    dec, hx, name = m.groups()
    if name is not None:
        return _HTML5.get(name, m[0])
    digits = (dec or hx).lstrip("0") or "0"
    cp = 0x110000 if len(digits) > (7 if dec else 6) else int(digits, 10 if dec else 16)
    return "\ufffd" if cp <= 0 or cp > 0x10FFFF or 0xD800 <= cp <= 0xDFFF else chr(cp)


def decode(s: str) -> str:
    return _PIECE.sub(_character, s) if "&" in s else s


def attributes(tok: str, tag: str) -> dict[str, str]:
    """The attributes the conversion reads (tokens.tag_attributes)."""
    body = tok[len(tag) + 1:-2 if tok.endswith("/>") else -1 if tok.endswith(">") else None]
    out: dict[str, str] = {}
    for a in _ATTR.findall(body):
        k = _ATTR_NAME.match(a)[0].translate(_UPPER)
        if k in _KEYS and k not in out:
            m = _ATTR_VALUE.match(a)
            v = m[1] if m else ""
            out[k] = decode(v[1:-1] if len(v) > 1 and v[0] in "\"'" and v[-1] == v[0] else v)
    return out


class Tokens:
    """A page's tokens, column by column: pos, kind, tag, is_void, attrs, text, and hi and closed of elements."""
    __slots__ = ("pos", "kind", "tag", "void", "attrs", "text", "hi", "closed", "list_d", "tbl_d", "several")

    def __init__(self, pages: list[str]):
        """Pages that share an id are one: their tokens alternate by position."""
        found = [_found(p) for p in pages]
        self.several = len(found) > 1
        if len(found) == 1:
            toks, self.pos = found[0], list(range(len(found[0])))
        else:
            both = sorted(((i, n) for n, f in enumerate(found) for i in range(len(f))))
            toks, self.pos = [found[n][i] for i, n in both], [i for i, _ in both]
        n = len(toks)
        self.kind, self.tag, self.void, self.attrs, self.text = [""] * n, [None] * n, [False] * n, [None] * n, [None] * n
        kinds, tags = self.kind, self.tag
        known = _KNOWN
        for i, t in enumerate(toks):
            if t[0] != "<":
                if "&" in t and _REFERENCE.search(t):
                    kinds[i], self.text[i] = "entity", decode(t)
                else:
                    kinds[i], self.text[i] = "text", t
                continue
            got = known.get(t)
            if got is None:
                got = _read(t)
                if len(t) < 40 and len(known) < 5000 and got[3] is None:
                    known[t] = got
            kinds[i], tags[i], self.void[i], self.attrs[i] = got
            if got[0] == "text":
                self.text[i] = t


#: Tags without attributes, as they were read before.
_KNOWN: dict[str, tuple] = {}


def _found(page: str) -> list[str]:
    found = _RUNS.findall(page)
    if found:
        last = found[-1]
        if last[-1] != ">" and len(last) > 1 and last[0] == "<" and (last[1] in "!?/" or last[1].isascii() and last[1].isalpha()) \
                and not last.startswith("<!--") and not _RAW.match(last):
            found[-1:] = _RUN.findall(last)
    return found


def _read(t: str) -> tuple:
    """(kind, tag, is_void, attrs) of a token that begins with '<'."""
    if t.startswith("<!--"):
        return "comment", None, False, None
    c = t[1:2]
    if c == "/":
        c = t[2:3]
        return ("close", _TAG.match(t)[1].translate(_UPPER), False, None) if c.isascii() and c.isalpha() else ("text", None, False, None)
    if c.isascii() and c.isalpha():
        tag = _TAG.match(t)[1]
        low = tag.translate(_UPPER)
        if _RAW.match(t):
            return "raw", low, False, None
        bare = len(t) == len(tag) + 2 and t[-1] == ">"
        return "open", low, low in _VOID or t.endswith("/>"), None if bare else attributes(t, tag)
    return ("decl" if c and c in "!?" else "text"), None, False, None


# ---------------------------------------------------------------- structure

_BLOCK = frozenset(N.BLOCK_TAGS)
_INLINE = frozenset(N.INLINE_TAGS)
_P_INLINE = _INLINE | {"p"}
_LISTS = frozenset(N.LIST_TAGS)
_LISTS_DL = _LISTS | {"dl"}
_DEFS = frozenset(N.DEFINITION_TAGS)
_CELLS = frozenset(N.CELL_TAGS)
_SECTIONS = frozenset(N.TABLE_SECTION_TAGS)
_FAM1 = _LISTS_DL | _DEFS | {"li"}
_FAM2 = _CELLS | _SECTIONS | {"table", "tr"}
BIG = N.BIG


def spans(t: Tokens) -> None:
    """nodes.element_spans(): hi and closed of elements, list_d, tbl_d."""
    n, pos, kind, tag, void = len(t.pos), t.pos, t.kind, t.tag, t.void
    pair: list = [None] * n
    paired = [False] * n  # of closes
    list_d, tbl_d = [0] * n, [0] * n
    ld = td = 0
    stacks: dict[str, list[int]] = {}
    for i in range(n):
        k = kind[i]
        if k == "open":
            g = tag[i]
            if not void[i]:
                if g in _LISTS_DL:
                    ld += 1
                elif g == "table":
                    td += 1
                if g in stacks:
                    stacks[g].append(i)
                else:
                    stacks[g] = [i]
            list_d[i], tbl_d[i] = ld, td
        elif k == "close":
            g = tag[i]
            list_d[i], tbl_d[i] = ld, td  # of what it closes; a stray close has depth 0, as is ld then
            if g in _LISTS_DL:
                ld -= ld > 0
            elif g == "table":
                td -= td > 0
            s = stacks.get(g)
            if s:
                pair[s.pop()] = pos[i]
                paired[i] = True
        else:
            list_d[i], tbl_d[i] = ld, td
    # Depth among the containers that have a close.
    pd, d = [0] * n, 0
    for i in range(n):
        if pair[i] is not None:
            if tag[i] not in _P_INLINE:
                d += 1
            pd[i] = d
        elif paired[i] and tag[i] not in _P_INLINE:
            pd[i] = d
            d -= 1
        else:
            pd[i] = d
    hi: list = [None] * n
    closed: list = [None] * n
    last = pos[-1] if n else 0
    ends: dict[int, int] = {}
    next_block, nblk = [None] * n, None
    for i in range(n - 1, -1, -1):
        next_block[i] = nblk
        if tag[i] in _BLOCK and (kind[i] == "open" or kind[i] == "close"):
            nblk = pos[i]
    nli: dict[int, int] = {}
    ndt: dict[int, int] = {}
    ncell: dict[int, int] = {}
    nrow: dict[int, int] = {}
    # From the end; tokens that share a position keep their order, as they do in a descending sort.
    for i in range(n - 1, -1, -1) if not t.several else sorted(range(n), key=lambda i: (-pos[i], i)):
        k, p = kind[i], pos[i]
        if k == "raw":
            hi[i] = p
            continue
        if k != "open" and k != "close":
            continue
        g = tag[i]
        if k == "open":
            pr = pair[i]
            if void[i]:
                hi[i], closed[i] = p, False
            else:
                pend = ends.get(pd[i])
                parent_end = BIG if pend is None else pend - 1
                if g in _P_INLINE:
                    term = None if pr is not None and pr <= parent_end and g != "p" else next_block[i]
                    within = parent_end
                else:
                    term = (nli.get(list_d[i]) if g == "li" else ndt.get(list_d[i]) if g in _DEFS else ncell.get(tbl_d[i]) if g in _CELLS
                            else nrow.get(tbl_d[i]) if g == "tr" else None)
                    within = parent_end if pr is None else BIG if pend is None else pend
                if pr is not None and (term is None or pr <= term) and pr <= within:
                    hi[i], closed[i] = pr, True
                else:
                    hi[i] = min(parent_end, last, BIG if term is None else term - 1)
                    closed[i] = pr is not None and pr == hi[i]
        elif paired[i] and g not in _P_INLINE:
            ends[pd[i]] = p
        if g in _FAM1:
            if g == "li":
                nli[list_d[i]] = p
            elif g in _DEFS:
                ndt[list_d[i]] = p
            elif k == "close":
                (ndt if g == "dl" else nli)[list_d[i]] = p
        elif g in _FAM2:
            if g in _CELLS:
                ncell[tbl_d[i]] = p
            elif g != "table" or k == "close":
                ncell[tbl_d[i]] = nrow[tbl_d[i]] = p
    t.hi, t.closed, t.list_d, t.tbl_d = hi, closed, list_d, tbl_d


def tree_depths(t: Tokens) -> list[int]:
    """nodes.with_tree(): elements that contain a token, itself included."""
    opened = [i for i in range(len(t.pos)) if t.kind[i] == "open" and not t.void[i]]
    ended = sorted(t.hi[i] + 1 for i in opened)
    out, run, e = [], 0, 0
    for i, p in enumerate(t.pos):
        while e < len(ended) and ended[e] <= p:
            run -= 1
            e += 1
        if t.kind[i] == "open" and not t.void[i]:
            run += 1
        out.append(run + (t.kind[i] == "raw" or t.kind[i] == "open" and t.void[i]))
    return out


# ---------------------------------------------------------------- selection

_CLASS_SPACE = re.compile("[ \t\r\n]+")


def _simple(t: Tokens, i: int, step: Step) -> bool:
    """select.simple_match(), on an element's row."""
    if step.tag != "*" and t.tag[i] != step.tag:
        return False
    if step.id is None and not step.classes:
        return True
    a = t.attrs[i] or {}
    if step.id is not None and a.get("id") != step.id:
        return False
    if step.classes:
        have = _CLASS_SPACE.split(a.get("class") or "")
        return all(c in have for c in step.classes)
    return True


def _matches(t: Tokens, rows: list[int], steps: tuple[Step, ...], depth: list[int] | None) -> set[int]:
    """select.match_selector(): the rows (of those given, in order) that match."""
    elements = [i for i in rows if t.kind[i] == "open" or t.kind[i] == "raw"]
    found = {i for i in elements if _simple(t, i, steps[0])}
    for st in steps[1:]:
        if not found:
            break
        now, reach = set(), -1
        at: dict[int, bool] = {}
        for i in elements:
            under = at.get(depth[i] - 1, False) if st.child else reach >= t.pos[i]
            if under and _simple(t, i, st):
                now.add(i)
            hit = i in found
            if st.child:
                at[depth[i]] = hit
            elif hit:
                reach = max(reach, t.hi[i])
        found = now
    return found


class Selection:
    """The root and exclusion selectors of a job."""

    def __init__(self, cfg: Config):
        self.roots = list(cfg.root_steps) + list(compile_selector_list(",".join(ROOT_FALLBACKS)))
        self.excluded = list(compile_selector_list(ALWAYS_IGNORED)) + list(cfg.ignore_steps)
        self.tree = any(st.child for steps in self.roots + self.excluded for st in steps)
        self.tags = self._tags(self.roots)
        self.out_tags = self._tags(self.excluded)

    @staticmethod
    def _tags(selectors: list[tuple[Step, ...]]) -> frozenset | None:
        """The tags that some selector's last step names; None where one takes any tag."""
        last = {s[-1].tag for s in selectors}
        return None if "*" in last else frozenset(last)

    def rows(self, t: Tokens) -> tuple[list[int], list[bool], tuple[int, int, int] | None]:
        """(rows strictly inside the root, whether each is excluded, (rank, lo, inner end) of the root)."""
        every = range(len(t.pos))
        depth = tree_depths(t) if self.tree else None
        best = None
        if self.tags is None or not self.tags.isdisjoint(t.tag):
            for rank, steps in enumerate(self.roots):
                got = _matches(t, every, steps, depth) if self._may(t, steps) else ()
                if got:
                    best = min((rank, t.pos[i], t.hi[i] - 1 if t.closed[i] else t.hi[i]) for i in got)
                    break
        if best is None:
            return [], [], None
        _, lo, end = best
        rows = [i for i in every if lo < t.pos[i] <= end]
        out: set[int] = set()
        for steps in self.excluded:
            if self._may(t, steps):
                out |= _matches(t, rows, steps, depth)
        if not out:
            return rows, [False] * len(rows), best
        flags, reach = [], -1
        for i in rows:
            if i in out:
                reach = max(reach, t.hi[i])
            flags.append(reach >= t.pos[i])
        return rows, flags, best

    @staticmethod
    def _may(t: Tokens, steps: tuple[Step, ...]) -> bool:
        return steps[-1].tag == "*" or steps[-1].tag in t.tag


# ---------------------------------------------------------------- blocks

MARK, BR, LNL = M.MARK, M.BR, M.LNL
_EMPH_OF = {tag: k for k, tags in M.EMPH_TAGS.items() for tag in tags}
_LEVEL = {h: int(h[1]) for h in M.HEADINGS}
_SPANS = frozenset(M.SPAN_TAGS)
_BOXES = frozenset(M.CONTAINERS)
_ROWS = _SECTIONS | {"tr", "table"}
_ROW_CELLS = _ROWS | _CELLS
_LI_BOXES = _BOXES | {"li"}
_NONBLANK = re.compile(r"[^ \t\n\r\x00\x0B]")
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_OPENS = "".join(o for o, _, _ in M.EMPH.values())
_CLOSES = "".join(c for _, c, _ in M.EMPH.values())
_EDGE = f"[{_SPACE}{MARK}{BR}{LNL}]+"
_AFTER_OPEN, _BEFORE_CLOSE = re.compile(f"([{_OPENS}]){_EDGE}"), re.compile(f"{_EDGE}([{_CLOSES}])")
_EMPTY = re.compile("|".join(o + f"[{MARK}]*" + c for o, c, _ in M.EMPH.values()))
_MARKS = MARK + "".join(o + c for o, c, _ in M.EMPH.values())
_RUNS_OF_MARKS = re.compile(f"[{_MARKS}]+|[^{_MARKS}]+")
_FINAL = str.maketrans({**{o: m for o, _, m in M.EMPH.values()}, **{c: m for _, c, m in M.EMPH.values()}, BR: "  \n", LNL: "\n", MARK: ""})
_MARKED = re.compile("[\ue000-\ue01f]")
_BLANK = f"(?:(?!\n)[{_SPACE}])"
_BOL = "(?:\\A|(?<=[\n\r\x85\u2028\u2029]))"
_HEAD_RULE = re.compile(f"{_BOL}{_BLANK}+(#{{1,6}}{_BLANK}+)")
_LIST_RULE = re.compile(f"{_BOL}{_BLANK}([-*+]{_BLANK}|\\d+\\.{_BLANK})")
_MANY_NL = re.compile("\n{3,}")
_LINE_END = re.compile(r"[ \t\x0B\x00\r]+$", re.M)
_LINE = re.compile(r"^(?=[^\n])", re.M)
_EMPTY_LINE = re.compile(r"^(?=\n)", re.M)
_OUTER = re.compile("^ *> ")


def image(a: dict[str, str] | None) -> str:
    """markdown.image_markdown()"""
    a = a or {}
    src = next((s for s in (trim(a.get(k) or "") for k in ("src", "data-src", "data-lazy-src", "data-original")) if s), "")
    scheme = _SCHEME.match(src)
    if src == "" or scheme and scheme[1].translate(_UPPER) not in ("http", "https"):
        return ""
    alt = inline(inline(a.get("alt") or "").replace("[", "\\[").replace("]", "\\]")) if inline(a.get("alt") or "") else "Image"
    title = inline(inline(a.get("title") or "").replace('"', '\\"'))
    return f'![{alt}]({src} "{title}")' if title else f"![{alt}]({src})"


def finish_inline(s: str) -> str:
    """markdown.finish_inline()"""
    v = _WS.sub(" ", s)
    if not _MARKED.search(v):
        return trim(v)
    v = _BEFORE_CLOSE.sub(r"\1", _AFTER_OPEN.sub(r"\1", v))
    if _EMPTY.search(v):
        v = "".join(_reduced(r) if _EMPTY.search(r) else r for r in _RUNS_OF_MARKS.findall(v))
    return trim(v.translate(_FINAL))


_OPEN_OF = {c: o for o, c, _ in M.EMPH.values()}


def _reduced(run: str) -> str:
    acc: list[str] = []
    for ch in run:
        if ch in _OPEN_OF:
            at = len(acc)
            while at and acc[at - 1] == MARK:
                at -= 1
            if at and acc[at - 1] == _OPEN_OF[ch]:
                del acc[at - 1:]
                continue
        acc.append(ch)
    return "".join(acc)


def line_rules(s: str) -> str:
    """markdown.line_rules()"""
    v = _CR.sub("\n", s) if "\r" in s else s
    if "#" in v:
        v = _HEAD_RULE.sub(r"\1", v)
    v = _LIST_RULE.sub(r"\1", v)
    return _MANY_NL.sub("\n\n", v)


def table(cells: list[tuple[int, int, str]]) -> str:
    """markdown.table_markdown() of the cells (row, place, text)."""
    rows: list[list[str]] = []
    at = None
    for row, _, text in sorted(cells):
        if row != at or not rows:
            rows.append([])
            at = row
        rows[-1].append(text)
    wide = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
    lines.insert(1, "| " + " | ".join(["---"] * wide) + " |")
    return "\n".join(lines)


class Unit:
    """A unit's groups and what it carries up (markdown._META)."""
    __slots__ = ("groups", "k_d", "l_d", "level", "list_id", "ordered", "in_list", "idx", "root_list", "row_id", "tbl_id", "e", "carry", "first", "reach", "prev", "g")

    def __init__(self):
        self.groups: dict[int, list] = {}  # g -> [pieces, in a span, the span]
        self.level = self.list_id = self.ordered = self.in_list = self.root_list = self.row_id = self.tbl_id = self.idx = None
        self.k_d = self.l_d = None
        self.e = [0, 0, 0]
        self.carry = (0, 0, 0)
        self.reach = self.prev = self.g = None


_KEYS_OF_EMPH = list(M.EMPH)  # b, i, d
_EM = [M.EMPH[k] for k in _KEYS_OF_EMPH]
_EM_INDEX = {tag: _KEYS_OF_EMPH.index(k) for tag, k in _EMPH_OF.items()}


def units(t: Tokens, rows: list[int], images: bool) -> tuple[dict[tuple[str, int], Unit], bool]:
    """markdown.assign_units() and token_pieces(): the units of the content rows, and whether any isn't blank."""
    out: dict[tuple[str, int], Unit] = {}
    has_content = False
    drop = span_hi = -1
    k_d = l_d = t_d = pre_d = 0
    m = [0, 0, 0]
    seg = pre = tbl = row = cell = root_list = None
    by_depth: dict[int, list] = {}  # k_d -> [item, its number of items, box, the number when it opened]
    kinds, tags, poss, texts, his = t.kind, t.tag, t.pos, t.text, t.hi
    for i in rows:
        kind, tag, p, text = kinds[i], tags[i], poss[i], texts[i]
        opened, closing = kind == "open", kind == "close"
        if not has_content and (kind != "text" or _NONBLANK.search(text)):
            has_content = True
        flat = span_hi > p
        if opened:
            if tag == "iframe":
                drop = max(drop, his[i])
            if tag in _SPANS:
                span_hi = max(span_hi, his[i])
        if drop >= p or kind == "raw" or kind == "decl":
            continue
        own_m = None  # emphasis: (index, it opens, it closes a stray)
        kd, ld, td, prd = k_d, l_d, t_d, pre_d
        md = m
        if flat and (opened or closing):
            opened = closing = False
            kind = "flat"
        if opened:
            if tag in _BOXES:
                k_d += 1
                kd = k_d
                if tag in _LISTS:
                    l_d += 1
                    ld = l_d
            elif tag == "table":
                t_d += 1
                td = t_d
            elif tag == "pre":
                pre_d += 1
                prd = pre_d
            elif tag in _EM_INDEX:
                x = _EM_INDEX[tag]
                own_m = (x, True, False)
                if t.closed[i]:
                    m[x] += 1
        elif closing:
            # A close has the depth of what it closes, a stray one none.
            if tag in _BOXES:
                k_d -= k_d > 0
                if tag in _LISTS:
                    l_d -= l_d > 0
            elif tag == "table":
                t_d -= t_d > 0
            elif tag == "pre":
                pre_d -= pre_d > 0
            elif tag in _EM_INDEX:
                x = _EM_INDEX[tag]
                own_m = (x, False, m[x] == 0)
                if m[x]:
                    md = m[:]
                    m[x] -= 1
        box_open = opened and tag in _BOXES
        if opened or closing:
            if tag in _BLOCK:
                seg = (p, opened, tag)
                if td == 1 and tag in _ROW_CELLS:
                    if tag in _ROWS:
                        row = (p, opened and tag == "tr")
                    cell = (p, opened and tag in _CELLS)
                    if tag == "table" and opened:
                        tbl = p
                if opened:
                    if tag == "pre" and prd == 1:
                        pre = p
                    if ld == 1 and tag in _LISTS:
                        root_list = p
        here = by_depth.get(kd)
        if here is None:
            here = by_depth[kd] = [None, 0, None, None]
        if (opened or closing) and tag in _LI_BOXES:
            here[0] = (p, opened and tag == "li")
            if opened:
                if tag == "li":
                    here[1] += 1
                else:
                    here[2], here[3] = (p, tag == "ol", tag in _LISTS), here[1]
        item, nli, box, list0 = here
        in_list = kd >= 1 and box is not None and box[2]
        level = None
        if td >= 1:
            if not (cell and cell[1] and row and row[1]):
                continue
            ukind, uid = "cell", cell[0]
        elif prd >= 1:
            ukind, uid = "pre", pre
        elif box_open:
            ukind, uid = "box", p
        elif in_list:
            if not (item and item[1]):
                continue
            ukind, uid = "item", item[0]
        elif opened and tag == "hr":
            ukind, uid = "hr", p
        else:
            ukind, uid = "seg", seg[0] if seg else -1
            if seg and seg[1]:
                level = _LEVEL.get(seg[2])
        u = out.get((ukind, uid))
        if u is None:
            u = out[ukind, uid] = Unit()
            u.k_d, u.l_d, u.first = kd, ld, p
        else:
            if kd < u.k_d:
                u.k_d = kd
            if ld < u.l_d:
                u.l_d = ld
        if p == u.first:  # emphasis that is open before the unit
            u.carry = tuple(md) if own_m is None or not own_m[1] or not t.closed[i] else tuple(v - (x == own_m[0]) for x, v in enumerate(m))
        if u.level is None:
            u.level = level
        if u.list_id is None and box is not None:
            u.list_id, u.ordered = box[0], box[1]
        if u.in_list is None:
            u.in_list = in_list
        if list0 is not None and (u.idx is None or nli - list0 > u.idx):
            u.idx = nli - list0
        if u.root_list is None:
            u.root_list = root_list
        if u.row_id is None and row:
            u.row_id = row[0]
        if u.tbl_id is None:
            u.tbl_id = tbl
        # Its group: a flattened span, or a run between spans.
        inl = ukind == "seg" or ukind == "item"
        was, prev = u.reach, u.prev
        if inl and opened and tag in _SPANS:
            own = (his[i], -p, tag, (t.attrs[i] or {}).get("href"))
            if was is None or own[:3] > was[:3] or own[:3] == was[:3] and (own[3] is not None and (was[3] is None or own[3] > was[3])):
                u.reach = own
        sp = u.reach
        in_span = sp is not None and sp[0] >= p
        if in_span:
            u.g = -sp[1]
        elif prev is None or was is not None and was[0] >= prev:
            u.g = p
        u.prev = p
        group = u.groups.get(u.g)
        if group is None:
            group = u.groups[u.g] = [[], False, None, []]
        if in_span:
            group[1] = True
        if p == u.g and group[2] is None:
            group[2] = sp
        # The piece.
        if ukind == "hr":
            piece = "---"
        elif in_span or not inl and ukind != "box":
            piece = shield(text) if text else ""
        elif kind == "text" or kind == "entity":
            piece = shield(text)
        elif own_m and (own_m[1] or not own_m[2]):
            x = own_m[0]
            piece = _EM[x][0] if own_m[1] else _EM[x][1]
            if inl:
                u.e[x] += 1 if own_m[1] else -1
        elif opened and tag == "br":
            piece = BR
        elif opened and tag == "img":
            piece = shield(image(t.attrs[i])) if images else ""
        elif ukind == "item" and (opened or closing) and tag in _BLOCK:
            piece = MARK + "#" * _LEVEL[tag] + " " if opened and tag in _LEVEL else MARK + " --- " if opened and tag == "hr" else MARK + " "
        else:
            piece = MARK
        group[0].append(piece)
        if t.several:
            group[3].append(p)
    if t.several:  # pieces go by position, then by what they are
        for u in out.values():
            for group in u.groups.values():
                group[0] = [x for _, x in sorted(zip(group[3], group[0]))]
    return out, has_content


def _joined(u: Unit) -> str:
    """A unit's pieces, its spans flattened."""
    if len(u.groups) == 1:
        (pieces, is_span, _, _), = u.groups.values()
        if not is_span:
            return "".join(pieces)
    parts = []
    for g in sorted(u.groups):
        pieces, is_span, sp, _ = u.groups[g]
        s = "".join(pieces)
        if is_span and sp is not None and sp[2] == "a":
            text, href = inline(s), trim(sp[3] or "")
            href = shield(href)
            parts.append(text if href == "" else f"[{text or href}]({href}){LNL}")
        elif is_span:
            parts.append(inline_code(s))
        else:
            parts.append(s)
    return "".join(parts)


def blocks(t: Tokens, rows: list[int], images: bool) -> tuple[list[tuple], bool]:
    """markdown.markdown_blocks(): (upos, sub, bkind, text, k_d, l_d, list_id, root_list, ordered, in_list) in order,
    and whether the page has content."""
    found, has_content = units(t, rows, images)
    out: list[tuple] = []
    tables: dict[int, list] = {}
    for (ukind, uid), u in sorted(found.items()):
        if ukind == "box":
            out.append((uid, 0, "box", "", u.k_d, u.l_d, u.list_id, u.root_list, u.ordered, u.in_list))
            continue
        if ukind == "hr":
            out.append((uid, 0, "rule", "---", u.k_d, u.l_d, u.list_id, u.root_list, u.ordered, u.in_list))
            continue
        s = _joined(u)
        if ukind == "cell":
            had = tables.get(u.tbl_id)
            if had is None:
                tables[u.tbl_id] = [u, [(u.row_id, uid, cell_text(s))]]
            else:
                had[1].append((u.row_id, uid, cell_text(s)))
                had[0].k_d, had[0].l_d = min(had[0].k_d, u.k_d), min(had[0].l_d, u.l_d)
                for k in ("list_id", "ordered", "in_list", "root_list"):
                    if getattr(had[0], k) is None:
                        setattr(had[0], k, getattr(u, k))
            continue
        if ukind == "pre":
            bkind, text = "code", code_block(s)
        else:
            c, e = u.carry, u.e
            if any(c) or any(e):
                s = "".join(_EM[x][0] * c[x] for x in range(3)) + s + "".join(_EM[x][1] * max(e[x] + c[x], 0) for x in (2, 1, 0))
            text = finish_inline(s)
            if ukind == "item":
                bkind, text = "item", line_rules((f"{u.idx}. " if u.ordered else "- ") + collapse(text))
            else:
                bkind = "para" if u.level is None else "heading"
                if text:
                    text = line_rules(text if u.level is None else "#" * u.level + " " + collapse(text))
        out.append((uid, 1, bkind, unshield(text), u.k_d, u.l_d, u.list_id, u.root_list, u.ordered, u.in_list))
    for tbl, (u, cells) in tables.items():
        out.append((tbl, 1, "table", unshield(table(cells)), u.k_d, u.l_d, u.list_id, u.root_list, u.ordered, u.in_list))
    out.sort(key=lambda b: b[:3])
    return out, has_content


# ---------------------------------------------------------------- body

def blank_prefix(prefix: str) -> str:
    m = _OUTER.match(prefix)
    outer = m[0] if m else ""
    return outer + prefix[len(outer):].rstrip(" ")


def prefix_lines(text: str, prefix: str) -> str:
    if prefix == "":
        return text
    if ">" in prefix:
        text = _LINE_END.sub("", text)
    return _EMPTY_LINE.sub(blank_prefix(prefix), _LINE.sub(prefix, text))


def body(found: list[tuple]) -> str | None:
    """markdown.assemble_body() of blocks(); None where there is nothing but containers."""
    boxes: dict[int, tuple[int, bool]] = {}  # depth -> (the container opened last there, it is a quote)
    pieces: list[str] = []
    prev = None
    some = False
    for upos, _, bkind, text, k_d, l_d, list_id, root_list, ordered, in_list in found:
        if bkind == "box":
            boxes[k_d] = (upos, not in_list)
            continue
        some = True
        item = bkind == "item"
        if text == "" and not item:
            continue
        path = [boxes[d] for d in range(1, k_d if item else k_d + 1) if d in boxes] if k_d else []
        if prev is None:
            sep = ""
        else:
            same = item and prev[0] and root_list is not None and root_list == prev[4]
            if same and (l_d > prev[1] or l_d == prev[1] and list_id is not None and list_id == prev[3]):
                sep = "\n"
            elif path and prev[2]:
                sep = "\n" + blank_prefix("".join("> " if q else "  " for q in _shared(path, prev[2]))) + "\n"
            else:
                sep = "\n\n"
        prefix = "".join("> " if q else "  " for _, q in path) + (" " if in_list and ordered and not item else "")
        pieces.append(sep + prefix_lines(text, prefix))
        prev = (item, l_d, path, list_id, root_list)
    return trim("".join(pieces)) if some else None


def _shared(path: list[tuple], other: list[tuple]) -> list[bool]:
    both = set(other)
    return [p[1] for p in path if p in both]


def convert(pages: list[str], selection: Selection, images: bool) -> tuple[str, bool] | None:
    """(body, has content) of a page, given as the HTML of all rows with its id; None without a root or blocks."""
    t = Tokens(pages)
    spans(t)
    rows, out, _ = selection.rows(t)
    rows = [i for i, x in zip(rows, out) if not x]
    if not rows:
        return None
    found, has_content = blocks(t, rows, images)
    text = body(found)
    return None if text is None else (text, has_content)


# ---------------------------------------------------------------- rows

#: A token of a page's root, as select.drop_excluded() gives it.
TOKEN = ("pos int, kind string, tag string, is_void boolean, attrs map<string, string>, text string, list_d long, tbl_d long, hi int, closed boolean, "
         "root_lo int, root_hi int, root_rank int, excluded boolean")
#: What blocks() reads of a token.
CONTENT = ["pos", "kind", "tag", "attrs", "text", "hi", "closed"]
#: A block, as markdown.markdown_blocks() gives it.
BLOCK = ("upos int, sub int, bkind string, text string, k_d long, l_d long, list_id int, root_list int, ordered boolean, in_list boolean, has_content boolean")
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "map<string, string>": pa.map_(pa.string(), pa.string())}


def _lists(schema: str, columns: list[list], sizes: list[int]) -> pa.ListArray:
    """An array of lists of structs, of these sizes, from the structs' columns end to end."""
    fields = [f.split(" ", 1) for f in re.split(r", (?=[a-z_]+ [a-z])", schema)]
    arrays = [pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)]
    offsets = [0]
    for n in sizes:
        offsets.append(offsets[-1] + n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, names=[f for f, _ in fields]))


def decoded(htmls: pa.Array) -> list[str]:
    return [h.decode("utf-8", "replace") for h in htmls.as_py()]


#: Pages whose tokens are Python objects at a time; an Arrow batch (64 MB) may hold thousands.
SOME = 128


def some_by_some(make, pages: pa.Array) -> pa.Array:
    """make(pages), SOME of them at a time."""
    return pa.concat_arrays([make(pages.slice(s, SOME)) for s in range(0, max(1, len(pages)), SOME)])


def token_lists(pages: pa.Array, selection: Selection) -> pa.ListArray:
    """TOKEN structs of each page's root."""
    columns: list[list] = [[] for _ in range(14)]
    sizes = []
    for page in pages:
        t = Tokens(decoded(page))
        spans(t)
        rows, out, root = selection.rows(t)
        sizes.append(len(rows))
        if not rows:
            continue
        for to, of in zip(columns, (t.pos, t.kind, t.tag, t.void, t.attrs, t.text, t.list_d, t.tbl_d, t.hi, t.closed)):
            to += [of[i] for i in rows]
        columns[4][-len(rows):] = [None if a is None else list(a.items()) for a in columns[4][-len(rows):]]
        for to, v in zip(columns[10:13], (root[1], root[2], root[0])):
            to += [v] * len(rows)
        columns[13] += out
    return _lists(TOKEN, columns, sizes)


def block_lists(pages: pa.Array, images: bool) -> pa.ListArray:
    """BLOCK structs of each page's content, given as lists of structs of CONTENT."""
    flat = pages.flatten()
    fields = {c: flat.field(c).to_pylist() for c in CONTENT}
    columns: list[list] = [[] for _ in range(11)]
    sizes, at = [], 0
    for n in pages.value_lengths().to_pylist():
        rows = sorted(range(at, at + n), key=fields["pos"].__getitem__)
        at += n
        t = Tokens.__new__(Tokens)
        t.pos, t.kind, t.tag, attrs, t.text, t.hi, t.closed = ([fields[c][i] for i in rows] for c in CONTENT)
        t.attrs = [a and dict(a) for a in attrs]
        t.several = any(a == b for a, b in zip(t.pos, t.pos[1:]))
        found, has_content = blocks(t, list(range(n)), images)
        sizes.append(len(found))
        for k, to in enumerate(columns[:10]):
            to += [b[k] for b in found]
        columns[10] += [has_content] * len(found)
    return _lists(BLOCK, columns, sizes)
