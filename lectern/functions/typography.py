"""Sub- and superscripts of a typeset line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as T


def render_spans(spans: Column, mark: bool = False) -> Column:
    """The text of a line from its spans (array<struct<text, size, y>>).

    Marked, small spans off the baseline become "^x" or "_x", in braces if longer than a character. The body size is the largest that at
    least a quarter of the heaviest size's characters have; the baseline is the upper median of its spans' y; small is below 85 % of
    it, off more than 15 % of it. Neighbouring spans of one kind merge; a blank span parts them. An empty line gives ""."""
    whole = F.array_join(F.transform(spans, lambda s: s.text), "")
    if not mark:
        return F.coalesce(whole, F.lit(""))
    inked = F.filter(spans, lambda s: T.strip(s.text) != "")
    sizes = F.array_distinct(F.transform(inked, lambda s: s["size"]))
    weighed = F.transform(sizes, lambda z: F.struct(z.alias("size"), F.aggregate(F.filter(inked, lambda s: s["size"] == z), F.lit(0), lambda a, s: a + F.length(T.strip(s.text))).alias("n")))
    most = F.array_max(F.transform(weighed, lambda w: w.n))
    body = F.array_max(F.transform(F.filter(weighed, lambda w: w.n >= 0.25 * most), lambda w: w["size"]))
    ys = F.array_sort(F.transform(F.filter(inked, lambda s: s["size"] == body), lambda s: s.y))
    base = F.get(ys, F.floor(F.size(ys) / 2).cast("int"))
    raised = lambda s: (s["size"] < 0.85 * body) & (s.y < base - 0.15 * body)
    lowered = lambda s: (s["size"] < 0.85 * body) & (s.y > base + 0.15 * body)
    kinds = F.transform(spans, lambda s: F.struct(F.when(T.strip(s.text) == "", "").when(raised(s), "^").when(lowered(s), "_").otherwise("").alias("k"), s.text.alias("t")))
    start = F.array().cast("array<struct<k:string,t:string>>")

    def merge(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        same = (F.size(a) > 0) & F.coalesce(last.k == x.k, F.lit(False))
        joined = F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(x.k.alias("k"), F.concat(last.t, x.t).alias("t"))))
        return F.when(same, joined).otherwise(F.concat(a, F.array(F.struct(x.k.alias("k"), x.t.alias("t")))))

    runs = F.aggregate(kinds, start, merge)

    def show(r: Column) -> Column:
        inner = T.strip(r.t)
        return F.when(r.k == "", r.t).otherwise(F.concat(r.k, F.when(F.length(inner) > 1, F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(inner)))

    return F.when(spans.isNull() | (F.size(spans) == 0), "").otherwise(F.array_join(F.transform(runs, show), ""))
