"""Page rasters of unlike sizes: area resampling and comparison as column expressions.

A raster is an array of grey levels by rows. A pixel of the target covers a rectangle of the source; the part of each source
pixel within it is its weight, kept as whole numbers, so results are exact: only the pixels that overlap are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import scalars as s


def _cover(k: Column, n: Column, to: Column) -> Column:
    """(i, w) of source places that overlap place k of `to` places over n: w in units of 1 / to, n in all."""
    first, last = F.floor(k * n / to), F.floor(((k + 1) * n + to - 1) / to) - 1
    weight = lambda i: F.least((k + 1) * n, (i + 1) * to) - F.greatest(k * n, i * to)
    return F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("i"), weight(i).alias("w")))


def resized(px: Column, height: Column, width: Column, to_height: Column, to_width: Column) -> Column:
    """px of height x width by box filter to to_height x to_width, halves up."""
    zero = F.lit(0).cast("bigint")
    row = lambda y, xs: F.aggregate(xs, zero, lambda total, x: total + x["w"] * F.get(px, (y["i"] * width + x["i"]).cast("int")))
    area = height * width

    def pixel(k: Column) -> Column:
        ys, xs = _cover(F.floor(k / to_width), height, to_height), _cover(k % to_width, width, to_width)
        total = F.aggregate(ys, zero, lambda done, y: done + y["w"] * row(y, xs))
        return F.floor((2 * total + area) / (2 * area)).cast("int")

    return F.when(area > 0, F.transform(F.sequence(zero, (to_height * to_width - 1).cast("bigint")), pixel))


def gray(red: Column, green: Column, blue: Column) -> Column:
    """A grey level of a colour. The weights of the channels, in thousandths."""
    return F.floor((299 * red + 587 * green + 114 * blue) / 1000).cast("int")


def near_share(a: Column, b: Column) -> Column:
    """Share of pixels that differ by less than PIXEL_STEP levels."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d < s.PIXEL_STEP)) / F.size(a)


def raster_similarity(embeddings: DataFrame) -> DataFrame:
    """vec_id, similarity, severity: each vector as an 8 x 8 raster, made as large as the next one's, of 6 x 5 (colours of
    three values each where the vector is long enough, else grey), and compared with it."""
    level = lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int")
    px = embeddings.select("vec_id", F.transform("embedding", level).alias("px"))
    colour = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: gray(F.get("px", (2 * k).cast("int")), F.get("px", (2 * k + 1).cast("int")), F.get("px", (2 * k + 2).cast("int"))))
    small = px.select((F.col("vec_id") - 1).alias("vec_id"), colour.alias("other"))
    n = lambda k: F.lit(k).cast("bigint")
    both = px.join(small, "vec_id").select("vec_id", resized(F.col("px"), n(8), n(8), n(6), n(5)).alias("scaled"), "other")
    share = near_share(F.col("scaled"), F.col("other"))
    return both.select("vec_id", F.array_join(F.col("scaled").cast("array<string>"), " ").alias("scaled"), F.round(share, 9).alias("similarity"), F.when(share < s.SIMILAR_PAGE, "warning").otherwise("ok").alias("severity"))


_COVER = "list_transform(range(({k} * {n}) // {to}, (({k} + 1) * {n} + {to} - 1) // {to}), lambda i: {{'i': i, 'w': least(({k} + 1) * {n}, (i + 1) * {to}) - greatest({k} * {n}, i * {to})}})"
SQL = {
    "raster_similarity": f"""with p as (select vec_id, list_transform(embedding, lambda x: floor((x::double + 1) * 127.5)::int) as px from embeddings),
k as (select unnest(range(0, 30)) as k), c as (select k, {_COVER.format(k='(k // 5)', n=8, to=6)} as ys, {_COVER.format(k='(k % 5)', n=8, to=5)} as xs from k),
w as (select k, y.i * 8 + x.i as i, y.w * x.w as w from (select k, unnest(ys) as y, xs from c), unnest(xs) as u(x)),
r as (select vec_id, k, ((2 * sum(w.w * p.px[w.i + 1]) + 64) // 128)::int as v, any_value(p.px) as px from p, w group by vec_id, k),
a as (select vec_id, list(v order by k) as scaled from r group by vec_id),
o as (select vec_id - 1 as vec_id, list_transform(range(0, 30), lambda k: (299 * px[2 * k + 1] + 587 * px[2 * k + 2] + 114 * px[2 * k + 3]) // 1000) as other from p),
s as (select vec_id, scaled, len(list_filter(range(1, 31), lambda i: abs(scaled[i] - other[i]) < {s.PIXEL_STEP})) / 30 as sim from a join o using (vec_id))
select vec_id, array_to_string(scaled, ' ') as scaled, round(sim, 9) as similarity, case when sim < {s.SIMILAR_PAGE} then 'warning' else 'ok' end as severity from s""",
}
