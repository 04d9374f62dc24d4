"""Job configuration: the eight options of the page-to-Markdown job, validated once
on the driver.  Selector strings are compiled here into small step lists; they are
configuration, never data."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
from dataclasses import dataclass, field

# Fixed values that must match the behaviour being reproduced.
DEFAULT_ROOT_SELECTOR = "main, article, #content, #main-content, #app"
DEFAULT_IGNORE_SELECTORS = "header, footer, nav, form"
ALWAYS_IGNORED = "script,style,noscript,template"
ROOT_FALLBACKS = ("main", "article", "body")
DEFAULT_POST_TYPES = ("post", "page")
CACHE_TTL_SECONDS = 12 * 3600
CONVERTER_VERSION = 3
ROOT_SELECTOR_MAX = 500
IGNORE_SELECTORS_MAX = 2000


class ConfigError(ValueError):
    """A setting the engine refuses instead of silently widening."""


@dataclass(frozen=True)
class Step:
    """One simple selector: tag (or '*'), optional id, classes; `child` means the
    combinator before it is '>' (else descendant)."""

    tag: str = "*"
    id: str | None = None
    classes: tuple[str, ...] = ()
    child: bool = False


_SIMPLE = re.compile(r"^(?:([A-Za-z0-9_-]+)|\*)?((?:[#.][A-Za-z0-9_-]+)*)$")


def split_selector_list(text: str) -> list[str]:
    """Comma / newline separated list; blanks ignored; order kept (priority)."""
    return [s.strip() for s in re.split(r"[,\r\n]+", text or "") if s.strip()]


def compile_selector(selector: str) -> tuple[Step, ...]:
    """Compile `a b`, `a > b`, `tag#id.c1.c2` forms into steps.

    Unsupported syntax (attribute selectors, pseudo classes, sibling combinators, a
    leading '>') is a configuration error rather than a silent widening."""
    s = re.sub(r"\s*>\s*", " > ", selector.strip())
    s = re.sub(r"\s+", " ", s).strip()
    if not s:
        raise ConfigError("empty selector")
    steps: list[Step] = []
    child = False
    for tok in s.split(" "):
        if tok == ">":
            if not steps or child:
                raise ConfigError(f"selector {selector!r}: '>' needs an element on both sides")
            child = True
            continue
        m = _SIMPLE.match(tok)
        if not m or tok == "":
            raise ConfigError(f"selector {selector!r}: unsupported part {tok!r}")
        tag = (m.group(1) or "*").lower()
        rest = m.group(2) or ""
        ids = re.findall(r"#([A-Za-z0-9_-]+)", rest)
        classes = tuple(dict.fromkeys(re.findall(r"\.([A-Za-z0-9_-]+)", rest)))
        if len(set(ids)) > 1:
            raise ConfigError(f"selector {selector!r}: an element has one id")
        steps.append(Step(tag=tag, id=ids[0] if ids else None, classes=classes, child=child))
        child = False
    if child:
        raise ConfigError(f"selector {selector!r}: dangling '>'")
    return tuple(steps)


def compile_selector_list(text: str) -> tuple[tuple[Step, ...], ...]:
    return tuple(compile_selector(s) for s in split_selector_list(text))


@dataclass(frozen=True)
class Config:
    post_types: tuple[str, ...] = DEFAULT_POST_TYPES
    available_types: tuple[str, ...] = ("post", "page", "product")
    document_root_selector: str = DEFAULT_ROOT_SELECTOR
    ignore_selectors: str = DEFAULT_IGNORE_SELECTORS
    respect_noindex: bool = True
    include_images: bool = False
    enable_content_negotiation: bool = False
    accept_markdown_wildcards: bool = False
    cache_ttl_seconds: int = CACHE_TTL_SECONDS
    generation: int = 1
    locale: str = "en_US"
    # The page that a site's '/' and '/index.md' stand for: one for all sites, or (site, page) pairs.
    site_front_page_id: int | tuple[tuple[int, int], ...] | None = None
    # Pages over this size are refused with a reason; no limit unless a job sets one.
    max_html_bytes: int | None = None
    # Tasks of the page_id exchange (None: the session's shuffle partitions).  Tokenizing
    # expands a page into thousands of rows and every later step runs in the same tasks,
    # so a large job sets this for about 32 MB of HTML a task.
    page_partitions: int | None = None
    root_steps: tuple = field(default=(), compare=False, repr=False)
    ignore_steps: tuple = field(default=(), compare=False, repr=False)

    def __post_init__(self):
        root = (self.document_root_selector or "").strip()
        if not root:
            root = DEFAULT_ROOT_SELECTOR
        ignore = (self.ignore_selectors or "").strip()
        for what, text, most in (("document_root_selector", root, ROOT_SELECTOR_MAX), ("ignore_selectors", ignore, IGNORE_SELECTORS_MAX)):
            if len(text) > most:
                raise ConfigError(f"{what}: {len(text)} characters, at most {most}")
        object.__setattr__(self, "document_root_selector", root)
        object.__setattr__(self, "ignore_selectors", ignore)
        object.__setattr__(self, "generation", max(1, int(self.generation)))
        object.__setattr__(self, "root_steps", compile_selector_list(root))
        object.__setattr__(self, "ignore_steps", compile_selector_list(ignore))

    def replace(self, **kw) -> "Config":
        kw = {k: v for k, v in kw.items()}
        base = {f.name: getattr(self, f.name) for f in dataclasses.fields(self)
                if f.name not in ("root_steps", "ignore_steps")}
        base.update(kw)
        return Config(**base)

    @property
    def enabled_types(self) -> tuple[str, ...]:
        """Configured types that exist and are public (attachments never), deduplicated."""
        avail = [t for t in self.available_types if t != "attachment"]
        out: list[str] = []
        for t in self.post_types:
            t = re.sub(r"[^a-z0-9_\-]", "", str(t).lower())
            if t and t in avail and t not in out:
                out.append(t)
        return tuple(out)

    @property
    def options_hash(self) -> str:
        """md5 of the options that change the converted text."""
        payload = json.dumps({"root": self.document_root_selector, "ignore": self.ignore_selectors,
                              "include_images": bool(self.include_images), "v": CONVERTER_VERSION},
                             separators=(",", ":"))
        return hashlib.md5(payload.encode()).hexdigest()

    def bump_generation(self) -> "Config":
        return self.replace(generation=self.generation + 1)


DEFAULT = Config()
