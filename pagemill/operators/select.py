"""CSS-subset selection over token rows: tag, #id, .class, combined forms, descendant
and child combinators.  All selectors advance together, a step at a time: the n-th steps of
all of them take one running-max window for descendants ("inside an element matched by the step
before") and one window over (page_id, depth) for children.  So the plan grows with the longest
selector, not with their number.  No joins, no exchange."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALWAYS_IGNORED, ROOT_FALLBACKS, Config, Step, compile_selector_list
from ..functions import text as T
from .nodes import before, class_list, running

_ids = count()


def simple_match(step: Step) -> Column:
    """One simple selector on element rows (open tags and raw script/style)."""
    c = T.among("kind", ["open", "raw"])
    if step.tag != "*":
        c = c & (F.col("tag") == step.tag)
    if step.id is not None:
        c = c & (F.col("attrs").getItem("id") == F.lit(step.id))
    for cls in step.classes:
        c = c & F.array_contains(class_list(F.col("attrs")), F.lit(cls))
    return F.coalesce(c, F.lit(False))


def _inside(flag: str) -> Column:
    """Token lies strictly inside an element whose row has `flag` set."""
    w = before(Window.partitionBy("page_id").orderBy("pos"))
    return F.coalesce(F.max(F.when(F.col(flag), F.col("hi"))).over(w) >= F.col("pos"), F.lit(False))


def _parents_have(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """For each out -> flag: `out` = the token's parent element has `flag`.  Element rows are
    candidates at their own depth and look one level up for their parent."""
    elem = T.among("kind", ["open", "raw"])
    look = F.when(elem, F.col("depth") - 1).otherwise(F.col("depth"))
    own = F.struct(*[F.col(f).alias(out) for out, f in flags.items()])
    none = F.lit(None).cast("struct<" + ", ".join(f"{out}: boolean" for out in flags) + ">")
    seek = F.struct(look.alias("_k"), F.lit(1).alias("_role"), none.alias("_v"))
    roles = F.when(elem, F.array(F.struct(F.col("depth").alias("_k"), F.lit(0).alias("_role"), own.alias("_v")), seek)).otherwise(F.array(seek))
    x = df.withColumn("_x", F.explode(roles)).select("*", "_x.*").drop("_x")
    w = running(Window.partitionBy("page_id", "_k").orderBy("pos", "_role"))
    x = x.withColumn("_got", F.last("_v", ignorenulls=True).over(w)).filter("_role = 1")
    return x.withColumns({out: F.coalesce(F.col("_got")[out], F.lit(False)) for out in flags}).drop("_k", "_role", "_v", "_got")


def match_selectors(df: DataFrame, selectors: dict[str, tuple[Step, ...]], scope: Column | None = None) -> DataFrame:
    """Adds a boolean for each out -> compiled selector: element rows that match it.  `scope`
    restricts the first steps (relative selection inside a context element)."""
    run = next(_ids)
    at = {out: f"_m{run}_{i}" for i, out in enumerate(selectors)}  # by selector: the column of the step it has reached
    for n in range(max(map(len, selectors.values()), default=0)):
        here = {out: steps[n] for out, steps in selectors.items() if n < len(steps)}
        if n == 0:
            df = df.withColumns({at[out]: simple_match(st) if scope is None else simple_match(st) & scope for out, st in here.items()})
            continue
        children = {f"{at[out]}_p": at[out] for out, st in here.items() if st.child}
        if children:
            df = _parents_have(df, children)
        under = {f"{at[out]}_p": _inside(at[out]) for out, st in here.items() if not st.child}
        if under:
            df = df.withColumns(under)
        df = df.withColumns({at[out]: simple_match(st) & F.col(f"{at[out]}_p") for out, st in here.items()}).drop(*[f"{at[out]}_p" for out in here])
    return df.withColumnsRenamed({c: out for out, c in at.items()})


def match_selector(df: DataFrame, steps: tuple[Step, ...], out: str,
                   scope: Column | None = None) -> DataFrame:
    """Adds boolean `out`: element rows matching the compiled selector."""
    return match_selectors(df, {out: steps}, scope)


def match_any(df: DataFrame, selectors: tuple[tuple[Step, ...], ...], out: str,
              scope: Column | None = None) -> DataFrame:
    """Union of several selectors (comma / newline alternatives)."""
    run = next(_ids)
    names = {f"_any{run}_{i}": s for i, s in enumerate(selectors) if len(s) > 1}
    df = match_selectors(df, names, scope)
    plain = F.lit(False)
    for s in selectors:
        if len(s) == 1:
            plain = plain | simple_match(s[0])
    if scope is not None:
        plain = plain & scope
    for n in names:
        plain = plain | F.col(n)
    return df.withColumn(out, plain).drop(*names)


def main_content(df: DataFrame, cfg: Config) -> DataFrame:
    """Adds `root_lo`, `root_hi` (inner range end) to every token of a page: the first
    configured selector that matches anything, its first element in document order;
    then `main`, `article`, `body`.  Pages with no root get NULLs."""
    selectors = list(cfg.root_steps) + list(compile_selector_list(",".join(ROOT_FALLBACKS)))
    prio = F.lit(None).cast("int")
    names = [f"_root{i}" for i in range(len(selectors))]
    df = match_selectors(df, dict(zip(names, selectors)))
    for i in reversed(range(len(names))):
        prio = F.when(F.col(names[i]), F.lit(i)).otherwise(prio)
    inner_hi = F.when(F.col("closed"), F.col("hi") - 1).otherwise(F.col("hi"))
    cand = F.when(prio.isNotNull(), F.struct(prio.alias("p"), F.col("pos").alias("lo"), inner_hi.alias("ih")))
    best = F.min(cand).over(Window.partitionBy("page_id"))
    df = df.withColumn("_best", best).drop(*names)
    return (df.withColumn("root_lo", F.col("_best.lo")).withColumn("root_hi", F.col("_best.ih"))
            .withColumn("root_rank", F.col("_best.p")).drop("_best"))


def drop_excluded(df: DataFrame, cfg: Config) -> DataFrame:
    """Adds `excluded`: token lies in (or is) an element matched, strictly inside the
    root, by the always-ignored list or the configured ignore list.  All matches are
    found before any removal, as one union."""
    scope = (F.col("pos") > F.col("root_lo")) & (F.col("pos") <= F.col("root_hi"))
    sels = tuple(compile_selector_list(ALWAYS_IGNORED)) + tuple(cfg.ignore_steps)
    df = match_any(df, sels, "_excl", scope)
    w = running(Window.partitionBy("page_id").orderBy("pos"))
    df = df.withColumn("excluded", F.coalesce(
        F.max(F.when(F.col("_excl"), F.col("hi"))).over(w) >= F.col("pos"), F.lit(False)))
    return df.drop("_excl")


def within_root(df: DataFrame) -> DataFrame:
    """Tokens strictly inside the root (not the root tag itself)."""
    return df.filter((F.col("pos") > F.col("root_lo")) & (F.col("pos") <= F.col("root_hi")))


def content_subtree(df: DataFrame) -> DataFrame:
    """Tokens strictly inside the root (not the root tag itself), not excluded."""
    return within_root(df).filter(~F.col("excluded"))
