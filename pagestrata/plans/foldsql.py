"""SQL of rules that visit the boxes of a page in order (DuckDB): recursion over the rows, one list of kept boxes per page."""

from __future__ import annotations

EDGES = ("x1", "y1", "x2", "y2")


def size(a: str) -> str:
    return f"(greatest(0,{a}.x2-{a}.x1)*greatest(0,{a}.y2-{a}.y1))"


def common(a: str, b: str) -> str:
    return f"(greatest(0,least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0,least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)))"


def like(a: str, b: str) -> str:
    i = common(a, b)
    return f"(case when {i}>0 then {i}/({size(a)}+{size(b)}-{i}) else 0.0e0 end)"


def part(a: str, b: str) -> str:
    return f"({common(a, b)}/greatest(least({size(a)},{size(b)}),1))"


def share(a: str, b: str) -> str:
    """Share of ``a`` that ``b`` covers."""
    return f"(case when {size(a)}>0 then {common(a, b)}/{size(a)} else 0.0e0 end)"


def most(a: str, b: str) -> str:
    return f"greatest({share(a, b)},{share(b, a)})"


def middle(a: str, b: str) -> str:
    return f"(({a}.x1+{a}.x2)/2.0e0 between {b}.x1 and {b}.x2 and ({a}.y1+{a}.y2)/2.0e0 between {b}.y1 and {b}.y2)"


def around(a: str, b: str) -> str:
    return f"x1:=least({a}.x1,{b}.x1), y1:=least({a}.y1,{b}.y1), x2:=greatest({a}.x2,{b}.x2), y2:=greatest({a}.y2,{b}.y2)"


def folded(name: str, rows: str, score: str, merge: str, last: bool = False) -> str:
    """CTEs ``name`` and ``name_out`` (page_id, slot, v) of a fold over ``rows`` (page_id, rk from 1, struct v).

    A row joins the kept ``k`` with the highest ``score`` (NULL: none), the first or last of equal ones, which becomes ``merge``;
    else it is kept.
    """
    at = "len(sc)+1-list_position(list_reverse(sc),best)" if last else "list_position(sc,best)"
    return f"""{name} as (select page_id, cast(rk as bigint) rk, [v] kept from {rows} where rk=1
    union all select page_id, rk, case when best is null then list_append(kept, v) else list_transform(kept, lambda k, i: case when i={at} then {merge} else k end) end
    from (select *, list_max(sc) best from (select s.page_id, cast(r.rk as bigint) rk, s.kept, r.v, list_transform(s.kept, lambda k: {score.replace('v.', 'r.v.')}) sc from {name} s join {rows} r on r.page_id=s.page_id and r.rk=s.rk+1) a) b),
  {name}_out as (select page_id, generate_subscripts(kept,1)-1 slot, unnest(kept) v from (select {name}.page_id, kept from {name} join (select page_id, max(rk) rk from {rows} group by 1) m on m.page_id={name}.page_id and m.rk={name}.rk) q)"""


def read(name: str, rows: str, rtl: bool = False) -> str:
    """CTEs ``name`` and ``name_out`` (page_id, i, position): reading order of ``rows`` (page_id, i, x1 .. y2, reading_order).

    Every step takes the last open group of a page: it is parted at its widest row gap, else at its widest column gap, if that is wide
    for the median side; else its rows are done.
    """
    def gaps(low: str, high: str) -> str:
        return f"list_transform(range(1,len(s{low[0]})), lambda j: s{low[0]}[j+1].r.{low}-s{low[0]}[j].r.{high})"

    def wide(axis: str, ratio: str, least: str) -> str:
        side = f"list_aggregate(list_transform(g, lambda r: greatest(1,r.{axis}2-r.{axis}1)),'median')"
        return f"coalesce(len(g)>1 and list_max(g{axis})>0 and list_max(g{axis})>=greatest({side}*{ratio},{least}),false)"

    def ordered(axis: str, other: str) -> str:
        return f"list_sort(list_transform(g, lambda r: struct_pack(a:=r.{axis}1, b:=r.{other}1, i:=r.i, r:=r))) s{axis}"

    def parts(axis: str, swap: bool) -> str:
        first = f"list_transform(s{axis}[1:list_position(g{axis},list_max(g{axis}))], lambda z: z.r)"
        second = f"list_transform(s{axis}[list_position(g{axis},list_max(g{axis}))+1:], lambda z: z.r)"
        return f"[{first},{second}]" if swap else f"[{second},{first}]"

    side = "-r.x2" if rtl else "r.x1"
    leaf = f"list_transform(list_sort(list_transform(g, lambda r: struct_pack(o:=r.o, y:=r.y1, s:={side}, i:=r.i))), lambda z: z.i)"
    return f"""{name} as (select page_id, [list(struct_pack(i:=cast(i as bigint), o:=coalesce(reading_order,1000000000), x1:=x1, y1:=y1, x2:=x2, y2:=y2))] todo, cast([] as bigint[]) done from {rows} group by 1
    union all select page_id, case when cy then list_concat(rest, {parts('y', False)}) when cx then list_concat(rest, {parts('x', rtl)}) else rest end, case when cy or cx then done else list_concat(done, {leaf}) end
    from (select *, {wide('y', '0.10e0', '8.0e0')} cy, {wide('x', '0.15e0', '10.0e0')} cx from (select *, {gaps('y1', 'y2')} gy, {gaps('x1', 'x2')} gx from (
      select *, {ordered('y', 'x')}, {ordered('x', 'y')} from (select page_id, todo[len(todo)] g, todo[1:len(todo)-1] rest, done from {name} where len(todo)>0) a) b) c) d),
  {name}_out as (select page_id, unnest(done) i, generate_subscripts(done,1)-1 as position from {name} where len(todo)=0)"""
