"""Registered queries over the synthetic motion field, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinefield.functions import exprs as X
from kinefield.operators import compare as C
from kinefield.operators import pictures as P
from kinefield.operators import prediction as M
from kinefield.operators import vectors as V
from kinefield.plans import field
from kinefield.plans import pictures as plan_pictures
from kinefield.sources import cavlc, mvcsv, nal, syntax

_COLS = ["seq", "frame", "source", "src_x", "src_y", "dst_x", "dst_y"]

_BASE = """with b as (
  select event_id as seq, cast(event_id // 4096 as int) as video, cast(event_id // 64 as int) as frame,
    cast(event_id % 8 as int) as bx, cast((event_id // 8) % 8 as int) as by_,
    case when event_type in ('click', 'view') then 1 else -1 end as source,
    cast((event_id * 7919 + user_id * 31) % 129 - 64 as int) as mvx,
    cast((event_id * 104729 + user_id * 17) % 129 - 64 as int) as mvy, user_id, event_type, value
  from events),
mv as (
  select *, 16 * bx + 8 as cx, 16 * by_ + 8 as cy, 16 * bx + 8 as dst_x, 16 * by_ + 8 as dst_y,
    16 * bx + 8 + cast(mvx // 4 as int) as src_x, 16 * by_ + 8 + cast(mvy // 4 as int) as src_y
  from b),
nz as (select * from mv where src_x <> dst_x or src_y <> dst_y)
"""
_SEL = "select seq, frame, source, src_x, src_y, dst_x, dst_y from "
_LEN2 = "((dst_x - src_x) * (dst_x - src_x) + (dst_y - src_y) * (dst_y - src_y))"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(_BASE + _SEL + "nz")
def mv_export_h264(spark, sf_dir) -> DataFrame:
    return V.drop_zero(field.vectors(spark, sf_dir)).select(*_COLS)


@query(_BASE + "select seq, frame, source, cx as src_x, cy as src_y, cx + (mvx >> 2) as dst_x, cy + (mvy >> 2) as dst_y from mv where (mvx >> 2) <> 0 or (mvy >> 2) <> 0")
def mv_export_hevc(spark, sf_dir) -> DataFrame:
    return V.drop_zero(field.vectors(spark, sf_dir, "hevc")).select(*_COLS)


@query(_BASE + _SEL + "mv where source <= 0")
def mv_l0_only(spark, sf_dir) -> DataFrame:
    return V.list0_only(field.vectors(spark, sf_dir)).select(*_COLS)


@query(_BASE + _SEL + "mv where frame = 7")
def mv_frame(spark, sf_dir) -> DataFrame:
    return V.of_frame(field.vectors(spark, sf_dir), 7).select(*_COLS)


@query(_BASE + "select coalesce(max(frame), 0) as max_frame from mv")
def mv_max_frame(spark, sf_dir) -> DataFrame:
    return V.max_frame(field.vectors(spark, sf_dir))


@query(_BASE + _SEL + "mv where frame % 3 <> 0")
def mv_decimate(spark, sf_dir) -> DataFrame:
    return V.decimate(field.vectors(spark, sf_dir), 3).select(*_COLS)


@query(_BASE + _SEL + f"mv where {_LEN2} >= 36")
def mv_min_size(spark, sf_dir) -> DataFrame:
    return V.min_size(field.vectors(spark, sf_dir), 6).select(*_COLS)


@query(_BASE + _SEL + "mv qualify row_number() over (partition by frame, cx // 32, cy // 32 order by seq) = 1")
def mv_grid(spark, sf_dir) -> DataFrame:
    return V.grid(field.vectors(spark, sf_dir), 32).select(*_COLS)


@query(
    _BASE
    + _SEL
    + f"nz where source <= 0 and {_LEN2} >= 36 qualify row_number() over (partition by frame, cx // 32, cy // 32 order by seq) = 1"
)
def mv_filter_chain(spark, sf_dir) -> DataFrame:
    return V.filter_chain(field.vectors(spark, sf_dir), True, 6, 32).select(*_COLS)


def _reduce_sql(k: int) -> str:
    return (
        _BASE
        + f"""select seq, frame, cast(case when n <= {k} then seat else rnk end as int) as place from (
  select seq, frame, count(*) over (partition by frame) as n,
    row_number() over (partition by frame order by {_LEN2} desc, seq) as rnk,
    row_number() over (partition by frame order by seq) as seat
  from mv where {_LEN2} > 4) where rnk <= {k}"""
    )


@query(_reduce_sql(10))
def mv_reduce_topk(spark, sf_dir) -> DataFrame:
    return V.reduce_vectors(field.vectors(spark, sf_dir), 10).select("seq", "frame", "place")


@query(_reduce_sql(100))
def mv_reduce_under_k(spark, sf_dir) -> DataFrame:
    return V.reduce_vectors(field.vectors(spark, sf_dir), 100).select("seq", "frame", "place")


@query(_BASE + "select frame, source, " + ", ".join(f"cast(((({c}) * 900 + 32768) & 65535) - 32768 as smallint) as {c}" for c in ("src_x", "src_y", "dst_x", "dst_y")) + " from mv")
def mv_compact(spark, sf_dir) -> DataFrame:
    rows = field.vectors(spark, sf_dir)
    return V.compact(rows.withColumns({c: F.col(c) * 900 for c in ("src_x", "src_y", "dst_x", "dst_y")}))


def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two copies, each with some rows less, some twice, and some moved by a quarter."""
    mv = field.vectors(spark, sf_dir).select(*_COLS)
    ends = ("src_x", "src_y", "dst_x", "dst_y")
    mv = mv.withColumns({c: F.col(c).cast("double") for c in ends})
    first = mv.filter("seq % 11 <> 0").withColumn("copies", F.when(F.col("seq") % 13 == 0, 2).otherwise(1))
    second = mv.filter("seq % 7 <> 0").withColumn("copies", F.when(F.col("seq") % 17 == 0, 2).otherwise(1))
    moved = {c: F.col(c) + F.when(F.col("seq") % n == 0, 0.25).otherwise(0.0) for c, n in zip(ends, (5, 19, 23, 29), strict=True)}
    second = second.withColumns(moved)
    return tuple(x.select("*", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "col") for x in (first, second))


_TWO = (
    _BASE
    + """, f as (
  select mv.* replace (cast(src_x as double) as src_x, cast(src_y as double) as src_y, cast(dst_x as double) as dst_x, cast(dst_y as double) as dst_y)
  from mv, range(2) r(i) where seq % 11 <> 0 and (i = 0 or seq % 13 = 0)),
s as (
  select mv.* replace (src_x + case when seq % 5 = 0 then 0.25 else 0 end::double as src_x, src_y + case when seq % 19 = 0 then 0.25 else 0 end::double as src_y,
    dst_x + case when seq % 23 = 0 then 0.25 else 0 end::double as dst_x, dst_y + case when seq % 29 = 0 then 0.25 else 0 end::double as dst_y)
  from mv, range(2) r(i) where seq % 7 <> 0 and (i = 0 or seq % 17 = 0)),
fk as (select *, row_number() over (partition by frame, sx, sy, dx, dy, source order by seq) as r from (
  select frame, source, seq, src_x, src_y, dst_x, dst_y, cast(trunc(src_x) as bigint) as sx, cast(trunc(src_y) as bigint) as sy,
    cast(trunc(dst_x) as bigint) as dx, cast(trunc(dst_y) as bigint) as dy from f where src_x <> dst_x or src_y <> dst_y)),
sk as (select *, row_number() over (partition by frame, sx, sy, dx, dy, source order by seq) as r from (
  select frame, source, seq, src_x, src_y, dst_x, dst_y, cast(trunc(src_x) as bigint) as sx, cast(trunc(src_y) as bigint) as sy,
    cast(trunc(dst_x) as bigint) as dx, cast(trunc(dst_y) as bigint) as dy from s where src_x <> dst_x or src_y <> dst_y)),
j as (
  select coalesce(fk.frame, sk.frame) as frame, coalesce(fk.sx, sk.sx) as sx, coalesce(fk.sy, sk.sy) as sy, coalesce(fk.dx, sk.dx) as dx,
    coalesce(fk.dy, sk.dy) as dy, coalesce(fk.source, sk.source) as source, coalesce(fk.r, sk.r) as r, fk.r is not null as ina, sk.r is not null as inb,
    fk.src_x as a1, fk.src_y as a2, fk.dst_x as a3, fk.dst_y as a4, sk.src_x as b1, sk.src_y as b2, sk.dst_x as b3, sk.dst_y as b4
  from fk full join sk on fk.frame = sk.frame and fk.sx = sk.sx and fk.sy = sk.sy and fk.dx = sk.dx and fk.dy = sk.dy and fk.source = sk.source and fk.r = sk.r),
k as (select *, bool_or(ina) over w as anya, bool_or(inb) over w as anyb,
    'Frame ' || frame || ' src=(' || sx || ',' || sy || ') dst=(' || dx || ',' || dy || ') source=' || source as shown
  from j window w as (partition by frame, sx, sy, dx, dy, source)),
d as (
  select *, 0 as turn, shown || ': missing in second file' as message from k where not anyb and r = 1
  union all select *, 1, shown || ': missing in first file' from k where not anya and r = 1
  union all select *, 2, shown || ': extra row in second file (index ' || (r - 1) || ')' from k where anya and not ina
  union all select *, 3, shown || ': extra row in first file (index ' || (r - 1) || ')' from k where anyb and not inb
"""
    + "".join(
        f"  union all select *, {k + 4}, shown || ': ''{c}'' differs (first=' || regexp_replace(cast(a{k + 1} as varchar), '\\.0$', '') || ', second=' || regexp_replace(cast(b{k + 1} as varchar), '\\.0$', '') || ')' from k where ina and inb and a{k + 1} <> b{k + 1}\n"
        for k, c in enumerate(("src_x", "src_y", "dst_x", "dst_y"))
    )
    + ")\n"
)


@query(_TWO + "select distinct frame, sx as k_src_x, sy as k_src_y, dx as k_dst_x, dy as k_dst_y, source from d")
def mv_compare_keys(spark, sf_dir) -> DataFrame:
    return C.compare(*_two(spark, sf_dir)).select(*C.KEY).distinct()


@query(_TWO + "select frame, sx as k_src_x, sy as k_src_y, dx as k_dst_x, dy as k_dst_y, source, cast(r as int) as row, turn, message from d")
def mv_compare_rows(spark, sf_dir) -> DataFrame:
    return C.compare(*_two(spark, sf_dir))


@query(_TWO + "select message from d")
def mv_compare_report(spark, sf_dir) -> DataFrame:
    return C.report(C.compare(*_two(spark, sf_dir)))


@query(
    _BASE
    + """, shapes(code, turn8, turn, cx, cy, w, h, part, n) as (values
  (0, 0, 0, 8, 8, 16, 16, 0, 1), (1, 0, 0, 8, 4, 16, 8, 0, 2), (1, 0, 1, 8, 12, 16, 8, 1, 2), (2, 0, 0, 4, 8, 8, 16, 0, 2), (2, 0, 1, 12, 8, 8, 16, 1, 2),
  (3, 1, 0, 4, 4, 8, 8, 0, 4), (3, 1, 1, 12, 4, 8, 8, 1, 4), (3, 1, 2, 4, 12, 8, 8, 2, 4), (3, 1, 3, 12, 12, 8, 8, 3, 4)),
used as (select mv.seq, mv.frame, mv.bx, mv.by_, mv.mvx, mv.mvy, sh.*, src,
    case when src = -1 then (mv.seq + part) % 3 <> 0 else (mv.seq + part) % 4 = 0 end as here
  from mv join shapes sh on sh.code = mv.user_id % 4, (values (-1), (1)) l(src))
select seq, frame, turn, cx, cy, w, h, source, mv_x, mv_y from (
  select seq, frame, cast(case when turn8 = 1 then part * 2 + case when src > 0 then 1 else 0 end else part + n * case when src > 0 then 1 else 0 end end as int) as turn,
    bx * 16 + cx as cx, by_ * 16 + cy as cy, w, h, src as source, bool_or(here) over (partition by seq, src) as there,
    case when here then case when src < 0 then mvx + part else -mvx - part end else 0 end as mv_x,
    case when here then case when src < 0 then mvy else -mvy end else 0 end as mv_y
  from used) where there"""
)
def mv_partition_expand(spark, sf_dir) -> DataFrame:
    rows = field.blocks(spark, sf_dir).drop("cx", "cy", "source", "mv_x", "mv_y")
    parts = F.array(
        *(
            F.struct(
                ((F.col("seq") + p) % 3 != 0).alias("l0"),
                ((F.col("seq") + p) % 4 == 0).alias("l1"),
                (F.col("mvx") + p).alias("x0"),
                F.col("mvy").alias("y0"),
                (-F.col("mvx") - p).alias("x1"),
                (-F.col("mvy")).alias("y1"),
            )
            for p in range(4)
        )
    )
    # Only the partitions that a shape has count for its use of a list.
    count = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(2), F.lit(4)), (F.col("user_id") % 4 + 1).cast("int"))
    shape = F.element_at(F.array(*(F.lit(s) for s in V.SHAPES)), (F.col("user_id") % 4 + 1).cast("int"))
    made = rows.select("seq", "frame", F.col("bx").alias("mbx"), F.col("by_").alias("mby"), shape.alias("shape"), F.slice(parts, F.lit(1), count).alias("parts"))
    return V.expand(made).select("seq", "frame", "turn", "cx", "cy", "w", "h", "source", "mv_x", "mv_y")


_NEAR = (
    _BASE
    + """, g as (select seq, frame, bx, by_, mvx, mvy, cast(user_id % 3 as int) - 1 as ref from mv),
n as (
  select g.*, coalesce(a.ref, -2) as ar, coalesce(a.mvx, 0) as ax, coalesce(a.mvy, 0) as ay,
    coalesce(b.ref, -2) as br, coalesce(b.mvx, 0) as bx_, coalesce(b.mvy, 0) as by2,
    coalesce(r.ref, l.ref, -2) as cr, case when r.ref is not null then r.mvx else coalesce(l.mvx, 0) end as cx_,
    case when r.ref is not null then r.mvy else coalesce(l.mvy, 0) end as cy_
  from g left join g a on a.frame = g.frame and a.bx = g.bx - 1 and a.by_ = g.by_
  left join g b on b.frame = g.frame and b.bx = g.bx and b.by_ = g.by_ - 1
  left join g r on r.frame = g.frame and r.bx = g.bx + 1 and r.by_ = g.by_ - 1
  left join g l on l.frame = g.frame and l.bx = g.bx - 1 and l.by_ = g.by_ - 1)
"""
)


def _pred_sql(ref: str, a: str, b: str, c: str) -> str:
    med = f"greatest(least({a}, {b}), least(greatest({a}, {b}), {c}))"
    m = f"((ar = {ref})::int + (br = {ref})::int + (cr = {ref})::int)"
    return (
        f"case when {m} = 1 then case when ar = {ref} then {a} when br = {ref} then {b} else {c} end "
        f"when {m} = 0 and br = -2 and cr = -2 and ar <> -2 then {a} else {med} end"
    )


_PX, _PY = _pred_sql("ref", "ax", "bx_", "cx_"), _pred_sql("ref", "ay", "by2", "cy_")


def _refs(spark, sf_dir) -> DataFrame:
    rows = field.blocks(spark, sf_dir)
    return rows.select("seq", "frame", "bx", "by_", "mvx", "mvy", ((F.col("user_id") % 3).cast("int") - 1).alias("ref"))


@query(_NEAR + f"select seq, frame, px, py, mvx - px as dx, mvy - py as dy from (select *, {_PX} as px, {_PY} as py from n)")
def mv_p16_median(spark, sf_dir) -> DataFrame:
    return M.median_prediction(_refs(spark, sf_dir)).select("seq", "frame", "px", "py", "dx", "dy")


@query(
    _NEAR
    + "".join(
        f"{'union all ' if k else ''}select '{side}' as side, seq, case when {n}r = ref then {x} else {_PX} end as px, case when {n}r = ref then {y} else {_PY} end as py from n "
        for k, (side, n, x, y) in enumerate((("top", "b", "bx_", "by2"), ("left", "a", "ax", "ay"), ("diagonal", "c", "cx_", "cy_")))
    )
)
def mv_dir_pred(spark, sf_dir) -> DataFrame:
    out = None
    for side in ("top", "left", "diagonal"):
        rows = M.directional_prediction(_refs(spark, sf_dir), side).select(F.lit(side).alias("side"), "seq", "px", "py")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    _NEAR
    + "select seq, frame, "
    + ", ".join(
        f"case when ar = -2 or (ar = 0 and ax = 0 and ay = 0) or br = -2 or (br = 0 and bx_ = 0 and by2 = 0) then 0 else {_pred_sql('0', *v)} end as {p}"
        for p, v in (("px", ("ax", "bx_", "cx_")), ("py", ("ay", "by2", "cy_")))
    )
    + " from n"
)
def mv_pskip(spark, sf_dir) -> DataFrame:
    return M.skip_prediction(_refs(spark, sf_dir)).select("seq", "frame", "px", "py")


@query(
    _BASE
    + """, t as (select seq, frame, bx, by_, cast(floor(abs(value)) as int) % 17 as total from mv)
select t.seq, cast(case when l + u < 64 then (l + u + 1) // 2 else (l + u) & 31 end as int) as nc from (
  select t.seq, coalesce(a.total, 64) as l, coalesce(b.total, 64) as u from t
  left join t a on a.frame = t.frame and a.bx = t.bx - 1 and a.by_ = t.by_
  left join t b on b.frame = t.frame and b.bx = t.bx and b.by_ = t.by_ - 1) t"""
)
def mv_nc(spark, sf_dir) -> DataFrame:
    rows = field.blocks(spark, sf_dir)
    total = F.floor(F.abs("value")).cast("int") % 17
    near = M.with_neighbours(rows.select("seq", "frame", "bx", "by_", "mvx", "mvy", total.alias("ref")))

    def of(n):
        return F.when(F.col(f"{n}.ref") == M.MISSING, 64).otherwise(F.col(f"{n}.ref"))

    return near.select("seq", X.neighbour_count(of("a"), of("b")).cast("int").alias("nc"))


def _pictures(spark, sf_dir) -> DataFrame:
    rows = field.blocks(spark, sf_dir)
    return rows.select(
        "video", "seq", F.col("seq").alias("frame"), (F.col("seq") % 512 == 0).alias("idr"),
        F.when(F.col("seq") % 512 == 0, 0).otherwise((F.col("seq") + F.col("user_id") % 3) % 16).cast("int").alias("lsb"),
        ((F.col("seq") % 3 != 1) | (F.col("seq") % 512 == 0)).alias("is_ref"), (F.col("seq") % 4 == 0).alias("base"),
    )


def _poc_sql(anchor: str) -> str:
    return (
        _BASE
        + f""", p as (
  select video, seq, seq % 512 = 0 as idr, cast(case when seq % 512 = 0 then 0 else (seq + user_id % 3) % 16 end as int) as lsb, {anchor} as anchor from mv),
e as (select *, sum(idr::int) over (partition by video order by seq) as ep from p),
l as (select *, coalesce(last_value(case when anchor then lsb end ignore nulls) over (partition by video, ep order by seq rows between unbounded preceding and 1 preceding), 0) as low from e),
s as (select *, case when idr then 0 when lsb < low and low - lsb >= 8 then 16 when lsb > low and lsb - low > 8 then -16 else 0 end as step from l)
select video, seq, cast(lsb + step + coalesce(sum(case when anchor then step end) over (partition by video, ep order by seq rows between unbounded preceding and 1 preceding), 0) as int) as poc from s"""
    )


@query(_poc_sql("(seq % 3 <> 1 or seq % 512 = 0)"))
def mv_poc_unwrap(spark, sf_dir) -> DataFrame:
    return P.display_order(_pictures(spark, sf_dir), 4).select("video", "seq", "poc")


@query(_poc_sql("seq % 4 = 0"))
def mv_poc_hevc(spark, sf_dir) -> DataFrame:
    return P.display_order(_pictures(spark, sf_dir), 4, F.col("base")).select("video", "seq", "poc")


@query(
    _BASE
    + """select video, frame, cast(count(*) as int) as n_slices, min(seq) as first_seq from (
  select video, seq, cast(sum(case when event_type = 'signup' then 1 else 0 end) over (partition by video order by seq) - 1 as int) as frame from b)
where frame >= 0 group by video, frame"""
)
def mv_picture_assembly(spark, sf_dir) -> DataFrame:
    rows = field.blocks(spark, sf_dir).select("video", "seq", F.when(F.col("event_type") == "signup", 0).otherwise(1).alias("first_mb"))
    made = P.group_slices(P.assemble_pictures(rows))
    return made.select("video", "frame", "n_slices", F.element_at("slices", 1).alias("first_seq"))


@query(
    _BASE
    + """select * from (select video, seq, user_id % 4 as id, event_type,
  last_value(case when event_type = 'purchase' then seq * 10 end ignore nulls) over (partition by video, user_id % 4 order by seq rows between unbounded preceding and 1 preceding) as resolved
from b) where event_type <> 'purchase' and resolved is not null"""
)
def mv_param_asof(spark, sf_dir) -> DataFrame:
    rows = field.blocks(spark, sf_dir)
    is_set = F.col("event_type") == "purchase"
    units = rows.select("video", "seq", "event_type", (F.col("user_id") % 4).alias("id"), F.when(is_set, "set").otherwise("slice").alias("kind"), F.when(is_set, F.col("seq") * 10).alias("value"))
    return P.resolve_parameters(units).select("video", "seq", "id", "event_type", "resolved")


@query(
    _BASE
    + """select seq, i as place, ([seq, seq + 1] || [seq + 2, seq + 3, seq + 4])[1 + ((i + 1) % 5) ] as ref
from mv, range(0, 7) r(i) where i < 1 + seq % 7"""
)
def mv_ref_lists(spark, sf_dir) -> DataFrame:
    s = F.col("seq")
    made = P.reference_list(F.array(s + 1, s + 2), F.array(s + 3, s + 4, s), (s % 7 + 1).cast("int"))
    return field.blocks(spark, sf_dir).select("seq", F.posexplode(made).alias("place", "ref")).withColumn("place", F.col("place").cast("long"))


_POCS = _BASE + """, p as (select video, seq as frame, seq % 3 <> 1 as is_ref, cast((seq * 7 + user_id % 5) % 64 as int) as poc, seq from mv)
"""


def _pocs(spark, sf_dir) -> DataFrame:
    rows = field.blocks(spark, sf_dir)
    return rows.select("video", "seq", F.col("seq").alias("frame"), (F.col("seq") % 3 != 1).alias("is_ref"), ((F.col("seq") * 7 + F.col("user_id") % 5) % 64).cast("int").alias("poc"))


@query(
    _POCS
    + """, r as (select video, frame, poc, row_number() over (partition by video order by seq) - 1 as no from p where is_ref),
w as (select video, seq, frame, poc, coalesce(sum(is_ref::int) over (partition by video order by seq rows between unbounded preceding and 1 preceding), 0) as seen from p),
s as (
  select w.video, w.frame, w.poc, 1 + w.seq % 3 as n0, 1 + w.seq % 2 as n1,
    coalesce(list([r.poc, r.frame] order by abs(r.poc - w.poc), r.no desc) filter (r.poc < w.poc), []) as before,
    coalesce(list([r.poc, r.frame] order by abs(r.poc - w.poc), r.no desc) filter (r.poc > w.poc), []) as later
  from w join r on r.video = w.video and r.no < w.seen and r.no >= w.seen - 16 and r.poc <> w.poc group by all),
l as (
  select *, list_transform(range(n0), lambda i: (before || later)[1 + i % len(before || later)]) as l0,
    list_transform(range(n1), lambda i: (later || before)[1 + i % len(later || before)]) as l1 from s),
h as (select *, case when len(l1) > 1 and l0 = l1 then l1[2] else l1[1] end as head from l)
select video, frame, poc, head[2] as col_frame, cast(head[1] as int) as col_poc from h"""
)
def mv_colocated(spark, sf_dir) -> DataFrame:
    """List 1's head; the SQL builds and compares both lists."""
    return P.collocated(_pocs(spark, sf_dir), n0=1 + F.col("seq") % 3, n1=1 + F.col("seq") % 2)


@query(
    _POCS
    + """, r as (select video, frame, poc, row_number() over (partition by video order by seq) - 1 as no from p where is_ref),
w as (select video, frame, coalesce(sum(is_ref::int) over (partition by video order by seq rows between unbounded preceding and 1 preceding), 0) as seen from p)
select w.video, w.frame, cast(count(r.no) as int) as held, coalesce(sum(r.frame), 0)::bigint as frames from w
left join r on r.video = w.video and r.no < w.seen and r.no >= w.seen - 16 group by 1, 2"""
)
def mv_dpb16(spark, sf_dir) -> DataFrame:
    rows = P.last_references(_pocs(spark, sf_dir))
    total = F.aggregate("dpb", F.lit(0).cast("long"), lambda x, s: x + s["frame"])
    return rows.select("video", "frame", F.size("dpb").alias("held"), total.alias("frames"))


@query(
    _BASE
    + """, d as (select seq, mvx, greatest(-128, least(127, mvx)) as td, greatest(-128, least(127, mvy * 3)) as tb from mv where mvx <> 0),
x as (select *, cast(trunc((16384 + trunc(abs(td) / 2.0)) / td) as int) as tx from d),
f as (select *, greatest(-4096, least(4095, (tb * tx + 32) >> 6)) as factor from x)
select seq, cast(greatest(-32768, least(32767, sign(factor * mvx) * ((abs(factor * mvx) + 127) >> 8))) as int) as scaled from f"""
)
def mv_scale(spark, sf_dir) -> DataFrame:
    rows = field.blocks(spark, sf_dir).filter("mvx <> 0")
    return rows.select("seq", X.scale_by_distance(F.col("mvx"), F.col("mvx"), F.col("mvy") * 3).cast("int").alias("scaled"))


@query(
    _BASE
    + """select frame, by_, cast(min(bx) as int) as bx, cast(count(*) as int) as width, event_type from (
  select *, sum(brk) over (partition by frame, by_ order by bx) as g from (
    select *, case when lag(event_type) over (partition by frame, by_ order by bx) = event_type then 0 else 1 end as brk from b)) group by frame, by_, g, event_type"""
)
def mv_runs(spark, sf_dir) -> DataFrame:
    return M.runs(field.blocks(spark, sf_dir), "event_type")


@query()
def mv_rects(spark, sf_dir) -> DataFrame:
    return M.rectangles(field.blocks(spark, sf_dir), "event_type")


@query(
    "select event_id, repeat('0', length(bin(event_id + 1)) - 1) || bin(event_id + 1) as code, cast(event_id as int) as back from events"
)
def x_ue(spark, sf_dir) -> DataFrame:
    rows = field.events(spark, sf_dir).select("event_id", X.ue_bits(F.col("event_id")).alias("code"))
    return rows.withColumn("back", X.ue_value(F.col("code")))


@query("select event_id, case when event_id % 2 = 1 then (event_id + 1) // 2 else -((event_id + 1) // 2) end as value from events")
def x_se(spark, sf_dir) -> DataFrame:
    return field.events(spark, sf_dir).select("event_id", X.se_value(F.col("event_id")).alias("value"))


@query("select event_id, case when event_id <= 1 then 0 else cast(length(bin(event_id - 1)) as int) end as bits from events")
def x_ceil_log2(spark, sf_dir) -> DataFrame:
    return field.events(spark, sf_dir).select("event_id", X.ceil_log2(F.col("event_id")).alias("bits"))


@query(
    "select event_id, cast("
    + " + ".join(f"((((event_id % 16) >> {k}) & 1) << {2 * k}) + (((((event_id // 16) % 16) >> {k}) & 1) << {2 * k + 1})" for k in range(4))
    + " as bigint) as address from events"
)
def x_morton(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return field.events(spark, sf_dir).select("event_id", X.morton(e % 16, F.floor(e / 16) % 16).cast("long").alias("address"))


@query(
    """select event_id, case when pre <= 63 then 2 * (63 - pre) else 2 * (pre - 64) + 1 end as state from (
  select event_id, cast(least(126, greatest(1, (((event_id % 61 - 30) * (event_id % 52)) >> 4) + event_id % 127 - 20)) as int) as pre from events)"""
)
def x_ctx_init(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    state = X.context_state((e % 61 - 30).cast("int"), (e % 127 - 20).cast("int"), (e % 52).cast("int"))
    return field.events(spark, sf_dir).select("event_id", state.cast("int").alias("state"))


@query(
    """select event_id, cast((event_id % 256) >> 7 as int) as forbidden, cast(((event_id % 256) >> 5) & 3 as int) as ref_idc, cast((event_id % 256) & 31 as int) as h264_type,
  cast(((event_id % 256) >> 1) & 63 as int) as hevc_type, cast((((event_id % 256) & 1) << 5) + ((event_id * 7 % 256) >> 3) as int) as layer, cast((event_id * 7 % 256) & 7 as int) as temporal from events"""
)
def x_nal_type(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    a, b = X.h264_nal((e % 256).cast("int")), X.hevc_nal((e % 256).cast("int"), (e * 7 % 256).cast("int"))
    return field.events(spark, sf_dir).select(
        "event_id", a["forbidden"].alias("forbidden"), a["ref_idc"].alias("ref_idc"), a["type"].alias("h264_type"),
        b["type"].alias("hevc_type"), b["layer"].alias("layer"), b["temporal"].alias("temporal"),
    )


@query(
    "select event_id, ['P', 'B', 'I', 'SP', 'SI'][1 + event_id % 5] as h264, case event_id % 3 when 0 then 'B' when 1 then 'P' else 'I' end as hevc from events"
)
def x_slice_type(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return field.events(spark, sf_dir).select("event_id", X.h264_slice_type(e).alias("h264"), X.hevc_slice_type(e % 3).alias("hevc"))


@query(
    "select event_id, cast((event_id % 1000 + 64) // 64 as int) as ctb_w, cast((event_id % 700 + 32) // 32 as int) as ctb_h from events"
)
def x_ctb_dims(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return field.events(spark, sf_dir).select(
        "event_id", F.ceil((e % 1000 + 1) / 64).cast("int").alias("ctb_w"), F.ceil((e % 700 + 1) / 32).cast("int").alias("ctb_h")
    )


@query(_BASE + "select seq, frame, source, cast(src_x as double) as src_x, cast(src_y as double) as src_y, cast(dst_x as double) as dst_x, cast(dst_y as double) as dst_y, cast(seq % 300 as int) as w, cast(seq * 3 as bigint) as flags from mv")
def csv_roundtrip(spark, sf_dir) -> DataFrame:
    mv = field.vectors(spark, sf_dir)
    wide = mv.select("seq", "frame", "source", (F.col("seq") % 300).cast("int").alias("w"), F.lit(16).alias("h"), *(F.col(c).cast("double").alias(c) for c in ("src_x", "src_y", "dst_x", "dst_y")), (F.col("seq") * 3).cast("decimal(20,0)").alias("flags"), F.col("mvx").cast("double").alias("motion_x"), F.col("mvy").cast("double").alias("motion_y"), F.lit(4.0).alias("motion_scale"))
    text = mvcsv.wide_text(wide).columns
    lines = wide.select("seq", mvcsv.format_flags(F.col("flags")).alias("flags"), *(F.col(c) if c in ("frame", "source", "w", "h") else mvcsv._float(F.col(c)).alias(c) for c in text if c != "flags"))
    rows = mvcsv.parse_lines(lines.select("seq", F.concat_ws(",", *text).alias("value")), ",".join(text))
    return rows.select("seq", "frame", "source", "src_x", "src_y", "dst_x", "dst_y", "w", F.col("flags").cast("long").alias("flags"))


@query(
    _BASE
    + """select seq, frame, cast(src_x as double) as src_x, case when seq % 3 = 0 then src_x + mvx / 4.0::double else cast(src_x as double) end as dst_x, 0 as source
from mv where seq % 5 <> 0"""
)
def csv_defaults(spark, sf_dir) -> DataFrame:
    mv = field.vectors(spark, sf_dir)
    frame = F.when(F.col("seq") % 5 == 0, F.lit("x")).otherwise(F.concat(F.col("frame").cast("string"), F.lit(".7")))
    scale = F.when(F.col("seq") % 3 == 0, F.lit("4")).when(F.col("seq") % 3 == 1, F.lit("0")).otherwise(F.lit("1.0d"))
    lines = mv.select("seq", F.concat_ws(",", F.col("src_y"), frame, F.lit("junk"), F.col("src_x"), F.col("mvx"), scale).alias("value"))
    return mvcsv.parse_lines(lines, "src_y,frame,extra,src_x,motion_x,motion_scale").select("seq", "frame", "src_x", "dst_x", "source")


def _streams(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("raw"))
    start, unit = F.lit(bytes([0, 0, 1, 0x67])), F.lit(bytes([0, 0, 0, 1, 0x41]))
    return docs.withColumn("data", F.concat(start, F.col("raw"), unit, F.col("raw")))


@query(
    """with d as (select doc_id, coalesce(text, '') as t from documents where text is not null)
select doc_id, cast(u as int) as unit, cast(case u when 0 then 7 else 1 end as int) as nal_type, t as payload from d, range(2) r(u)"""
)
def b_annexb(spark, sf_dir) -> DataFrame:
    """Texts hold no zero bytes, so each is a unit as it is."""
    rows = nal.units(_streams(spark, sf_dir).select("doc_id", "data"))
    return rows.select("doc_id", "unit", "nal_type", F.col("payload").cast("string").alias("payload"))


@query("select doc_id, 0 as unit, 1 as nal_type, text as payload from documents where text is not null")
def b_avcc(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit(bytes([0x41])), F.col("text").cast("binary")).alias("u"))
    sized = docs.select("doc_id", F.concat(F.unhex(F.lpad(F.hex(F.octet_length("u")), 8, "0")), F.col("u")).alias("data"))
    return nal.units(sized, length_size=4).select("doc_id", "unit", "nal_type", F.col("payload").cast("string").alias("payload"))


@query("select doc_id, cast(2 * octet_length(encode(text)) + 12 as int) as size from documents where text is not null")
def b_ebsp(spark, sf_dir) -> DataFrame:
    """Two texts, nine bytes of start codes and headers, and 0 0 3 1 less its emulation byte."""
    rows = _streams(spark, sf_dir).filter("raw is not null")
    return rows.select("doc_id", F.octet_length(nal.rbsp(F.concat("data", F.lit(bytes([0, 0, 3, 1]))))).alias("size"))


@query()
def b_se_stream(spark, sf_dir) -> DataFrame:
    """Whole texts read as streams of signed codes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    codes = nal.signed_codes(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.select("doc_id", codes.alias("codes")).select("doc_id", F.size("codes").alias("n"), F.array_max("codes").alias("most"))


@query(
    """select event_id as seq, cast(user_id % 4 as int) as sps_id, cast(4 + event_id % 5 as int) as log2_max_frame_num,
  cast(1 + event_id % 120 as int) as width_in_mbs, cast(1 + user_id % 68 as int) as height_in_map_units, cast(event_id % 4 as int) as max_num_ref_frames,
  cast(event_id % 2 as int) as cabac, cast(event_id % 1000 as int) as first_mb, case when event_id % 3 = 0 then 'I' else 'P' end as slice_type,
  cast(event_id % 16 as int) as frame_num, cast(user_id % 16 as int) as poc_lsb, cast(case when event_id % 3 = 0 then 1 + event_id % 2 else 1 + user_id % 5 end as int) as num_ref_l0,
  cast(26 + event_id % 21 - 10 + user_id % 11 - 5 as int) as slice_qp, cast(case when event_id % 3 > 0 and event_id % 2 = 1 then event_id % 3 else 0 end as int) as cabac_init_idc, true as at_data
from events"""
)
def b_h264_headers(spark, sf_dir) -> DataFrame:
    """Parameter sets and a slice header written as bits for each event, and read."""
    rows = field.events(spark, sf_dir).select(F.col("event_id").alias("e"), F.col("user_id").alias("u"))
    e, u, ue, se, no = F.col("e"), F.col("u"), X.ue_bits, X.se_bits, F.lit("0")
    inter, cabac = e % 3 > 0, e % 2 == 1
    sps = F.concat(F.lit("0100001000000000" + "00011110"), ue(u % 4), ue(e % 5), ue(F.lit(0)), ue(e % 7), ue(e % 4), no, ue(e % 120), ue(u % 68), F.lit("10"))
    pps = F.concat(ue(u % 8), ue(u % 4), X.fixed_bits(e % 2, 1), no, ue(F.lit(0)), ue(e % 2), ue(F.lit(0)), F.lit("000"), se(e % 21 - 10), se(F.lit(0)), se(F.lit(0)), F.lit("000"))
    head = F.concat(
        *(ue(e % 1000), ue(F.when(inter, 5 * (u % 2)).otherwise(7)), ue(u % 8), X.fixed_bits(e % 16, (e % 5 + 4).cast("int")), X.fixed_bits(u % 16, (e % 7 + 4).cast("int"))),
        F.when(inter, F.concat(F.lit("1"), ue(u % 5), no)).otherwise(F.lit("")),
        no,
        F.when(inter & cabac, ue(e % 3)).otherwise(F.lit("")),
        se(u % 11 - 5),
    )
    coded = rows.select(e.alias("seq"), F.length(head).alias("bits"), X.packed(sps).alias("sps"), X.packed(pps).alias("pps"), X.packed(head).alias("slice"))
    sets = coded.select("seq", "bits", "slice", syntax.h264_sps(F.col("sps")).alias("sps"), syntax.h264_pps(F.col("pps")).alias("pps"))
    read = sets.select("seq", "bits", "sps", "pps", syntax.h264_slice(F.col("slice"), F.lit(1), F.lit(2), F.col("sps"), F.col("pps")).alias("head"))
    return read.select(
        *("seq", "sps.sps_id", "sps.log2_max_frame_num", "sps.width_in_mbs", "sps.height_in_map_units", "sps.max_num_ref_frames", "pps.cabac"),
        *("head.first_mb", "head.slice_type", "head.frame_num", "head.poc_lsb", "head.num_ref_l0", "head.slice_qp", "head.cabac_init_idc"),
        (F.col("head.data_bit") == F.col("bits")).alias("at_data"),
    )


@query(
    """with v as (select event_id, cast((event_id * 7919 + user_id * 31) % 129 - 64 as int) as mvx, cast((event_id * 104729 + user_id * 17) % 129 - 64 as int) as mvy from events),
  m as (select cast(event_id // 4096 as int) as video, cast(event_id // 32 % 128 as int) as frame, cast(event_id % 32 as int) as mb, mvx, mvy from v)
  select video, frame, mb, mvx, mvy, 8 + cast(mvx // 4 as int) as src_x, 16 * mb + 8 + cast(mvy // 4 as int) as src_y from m"""
)
def d_h264_cavlc(spark, sf_dir) -> DataFrame:
    """The field written as slices of pictures one macroblock wide, decoded and exported.

    There each vector is predicted by the one above it, so what is coded is a difference
    along the column. The last picture may have fewer macroblocks than its height.
    """
    rows = field.blocks(spark, sf_dir).select("seq", "mvx", "mvy").withColumns(
        {"video": F.floor(F.col("seq") / 4096).cast("int"), "number": F.floor(F.col("seq") / 32).cast("long")}
    )
    above = Window.partitionBy("video", "number").orderBy("seq")
    coded = F.concat(X.ue_bits(F.lit(0)), X.ue_bits(F.lit(0)), *(X.se_bits(F.col(c) - F.coalesce(F.lag(c).over(above), F.lit(0))) for c in ("mvx", "mvy")), X.ue_bits(F.lit(0)))
    data = F.array_join(F.array_sort(F.collect_list(F.struct("seq", "bits")))["bits"], "")
    # No macroblock is skipped; 0 is the whole shape, and 0 the pattern without residuals.
    no, head = F.lit("0"), F.concat(X.ue_bits(F.lit(0)), X.ue_bits(F.lit(5)), X.ue_bits(F.lit(0)), F.lit("0001"), F.lit("0000"), F.lit("00"), F.lit("0"), X.se_bits(F.lit(0)))
    slices = rows.withColumn("bits", coded).groupBy("video", "number").agg(data.alias("bits"))
    slices = slices.select("video", (F.col("number") % 128 + 2).cast("int").alias("nal_no"), F.lit(1).alias("nal_type"), X.packed(F.concat(head, "bits")).alias("payload"))
    sps = F.concat(F.lit("01000010" + "0" * 16), *(X.ue_bits(F.lit(n)) for n in (0, 0, 0, 0, 1)), no, X.ue_bits(F.lit(0)), X.ue_bits(F.lit(31)), F.lit("11"))
    pps = F.concat(X.ue_bits(F.lit(0)), X.ue_bits(F.lit(0)), F.lit("00"), *(X.ue_bits(F.lit(0)) for _ in range(3)), F.lit("000"), *(X.se_bits(F.lit(0)) for _ in range(3)), F.lit("000"))
    sets = F.inline(F.array(*(F.struct(F.lit(k).alias("nal_no"), F.lit(7 + k).alias("nal_type"), X.packed(bits).alias("payload")) for k, bits in enumerate((sps, pps)))))
    units = slices.unionByName(rows.select("video").distinct().select("video", sets))
    units = units.select(F.col("video").cast("string").alias("path"), F.lit("h264").alias("codec"), F.lit(0).alias("packet"), "nal_no", "nal_type", F.lit(2).alias("ref_idc"), "payload")
    found = plan_pictures.h264_vectors(plan_pictures.h264_slices(units))
    return found.select(
        F.col("video").cast("int").alias("video"),
        "frame",
        F.floor(F.col("seq") / 8).cast("int").alias("mb"),
        *(F.col(a).alias(b) for a, b in (("mv_x", "mvx"), ("mv_y", "mvy"))),
        "src_x",
        "src_y",
    )


@query(
    """with f as (select event_id as e, user_id as u, (1 + event_id % 30) * (1 + user_id % 17) as ctbs, event_id % 3 as kind, event_id % 4 = 0 as first from events)
select e as seq, cast(u % 16 as int) as sps_id, cast(64 * (1 + e % 30) as int) as width, cast(64 * (1 + u % 17) as int) as height, cast(4 + e % 5 as int) as log2_max_poc_lsb,
  cast(case when first then 1 else 0 end as int) as first_in_picture, cast(case when first then 0 else e % ctbs end as int) as address, ['B', 'P', 'I'][1 + kind] as slice_type,
  cast(u % 16 as int) as poc_lsb, cast(-1 - e % 3 as int) as nearest, cast(case when kind < 2 then 1 + u % 4 else 0 end as int) as refs_l0, cast(case when kind = 0 then 1 + u % 3 else 0 end as int) as refs_l1,
  cast(case when kind < 2 then 5 - e % 5 else 5 end as int) as max_merge, cast(26 + e % 21 - 10 + u % 11 - 5 as int) as slice_qp, true as at_data
from f"""
)
def b_hevc_headers(spark, sf_dir) -> DataFrame:
    """HEVC parameter sets and a slice header written as bits for each event, and read."""
    rows = field.events(spark, sf_dir).select(F.col("event_id").alias("e"), F.col("user_id").alias("u"))
    e, u, ue, se, bit = F.col("e"), F.col("u"), X.ue_bits, X.se_bits, F.lit
    no, inter, both, first = bit(""), e % 3 < 2, e % 3 == 0, e % 4 == 0
    number = lambda *ns: [ue(F.lit(n)) for n in ns]
    sps = F.concat(
        *(bit("00000001" + "00000001" + "0" * 88), ue(u % 16), *number(1), ue(64 * (1 + e % 30)), ue(64 * (1 + u % 17)), bit("0"), *number(0, 0), ue(e % 5)),
        *(bit("1"), *number(4, 0, 0, 0, 3, 0, 3, 0, 0), bit("00"), X.fixed_bits(e % 2, 1), bit("0"), *number(1, 1, 0), ue(e % 3), bit("1"), bit("01")),
    )
    pps = F.concat(ue(u % 8), ue(u % 16), bit("0000000"), ue(e % 2), *number(0), se(e % 21 - 10), bit("000"), *number(0, 0), bit("0" * 9), bit("0"), *number(0), bit("0"))
    ctbs = (1 + e % 30) * (1 + u % 17)
    place = X.fixed_bits(e % ctbs, X.ceil_log2(ctbs.cast("int")).cast("int"))
    refs = F.concat(bit("1"), ue(u % 4), F.when(both, F.concat(ue(u % 3), bit("1"))).otherwise(no))
    motion = F.when(e % 2 == 1, F.concat(F.when(both, bit("1")).otherwise(no), F.when(u % 4 > 0, ue(F.lit(0))).otherwise(no))).otherwise(no)
    head = F.concat(
        *(F.when(first, bit("1")).otherwise(bit("0")), ue(u % 8), F.when(first, no).otherwise(place), ue(e % 3)),
        *(X.fixed_bits(u % 16, (e % 5 + 4).cast("int")), bit("1"), X.fixed_bits(e % 2, 1), F.when(e % 2 == 1, bit("10")).otherwise(no)),
        *(F.when(inter, F.concat(refs, motion, ue(e % 5))).otherwise(no), se(u % 11 - 5)),
    )
    coded = rows.select(e.alias("seq"), (F.floor(F.length(head) / 8) + 1).alias("begin"), X.packed(sps).alias("sps"), X.packed(pps).alias("pps"), X.packed(head).alias("slice"))
    sets = coded.select("seq", "begin", "slice", syntax.hevc_sps(F.col("sps")).alias("sps"), syntax.hevc_pps(F.col("pps")).alias("pps"))
    read = sets.select("seq", "begin", "sps", syntax.hevc_slice(F.col("slice"), F.lit(1), F.col("sps"), F.col("pps")).alias("head"))
    return read.select(
        *("seq", "sps.sps_id", "sps.width", "sps.height", "sps.log2_max_poc_lsb", "head.first_in_picture", "head.address", "head.slice_type", "head.poc_lsb"),
        F.get("head.delta", F.lit(0)).alias("nearest"),
        *("head.refs_l0", "head.refs_l1", "head.max_merge", "head.slice_qp"),
        (F.col("head.data_byte") == F.col("begin")).alias("at_data"),
    )


@query(_BASE + "select seq, frame, -1 as source, cx, cy, mvx as mv_x, mvy as mv_y from mv")
def d_h264_cavlc(spark, sf_dir) -> DataFrame:
    """Each picture written as the bits of a P slice with variable-length codes, and decoded."""
    blocks = field.blocks(spark, sf_dir).select("frame", "bx", "by_", F.lit(0).alias("ref"), "mvx", "mvy")
    # No skipped macroblock, one part, the difference to the predictor, no coefficients.
    plain = X.ue_bits(F.lit(0))
    coded = F.concat(plain, plain, X.se_bits(F.col("dx")), X.se_bits(F.col("dy")), plain)
    ordered = F.array_sort(F.collect_list(F.struct("by_", "bx", coded.alias("bits"))))
    slices = M.median_prediction(blocks).groupBy("frame").agg(ordered.alias("mbs"))
    number = lambda **values: F.struct(*(F.lit(v).alias(k) for k, v in values.items()))
    found = slices.select(
        *(F.lit(0).alias("video"), "frame", F.lit(8).alias("width_mbs")),
        cavlc.motion(
            X.packed(F.array_join("mbs.bits", "")),
            number(data_bit=0, slice_type="P", num_ref_l0=1, first_mb=0),
            number(width_in_mbs=8, height_in_map_units=8, frame_mbs_only=1, chroma_format_idc=1),
            number(transform_8x8_mode=0),
        ).alias("motion"),
    )
    rows = plan_pictures.vectors_of(found)
    seq = F.col("frame").cast("long") * 64 + F.floor(F.col("seq") / 8)
    return rows.select(seq.alias("seq"), "frame", "source", "cx", "cy", "mv_x", "mv_y")


@query(
    _BASE
    + """select video, count(*)::bigint as blocks, count(distinct frame)::bigint as pictures, sum((source = -1)::int)::bigint as list0, sum((source = 1)::int)::bigint as list1,
  coalesce(min(cast(user_id % 52 as int)), 999) as qp_min, max(cast(user_id % 52 as int)) as qp_max, sum((event_type = 'error')::int)::bigint as errors from b group by video"""
)
def stats_audit(spark, sf_dir) -> DataFrame:
    qp = (F.col("user_id") % 52).cast("int")
    return field.blocks(spark, sf_dir).groupBy("video").agg(
        F.count("*").alias("blocks"),
        F.countDistinct("frame").alias("pictures"),
        F.count_if(F.col("source") == -1).alias("list0"),
        F.count_if(F.col("source") == 1).alias("list1"),
        F.coalesce(F.min(qp), F.lit(999)).alias("qp_min"),
        F.max(qp).alias("qp_max"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )


@query(
    _BASE
    + f"select frame, count(*) as vectors, max({_LEN2})::bigint as longest from (select * from nz where {_LEN2} >= 36 qualify row_number() over (partition by frame, cx // 32, cy // 32 order by seq) = 1) group by frame"
)
def mv_frame_summary(spark, sf_dir) -> DataFrame:
    """The flagship: export, drop, thin, and count by picture."""
    rows = V.filter_chain(field.vectors(spark, sf_dir), False, 6, 32)
    return rows.groupBy("frame").agg(F.count("*").alias("vectors"), F.max(V.squared_length()).cast("long").alias("longest"))
