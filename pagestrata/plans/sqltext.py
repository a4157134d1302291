"""SQL fragments shared by the comparison queries (DuckDB)."""

from __future__ import annotations


def area(p: str = "") -> str:
    return f"(greatest(0,{p}x2-{p}x1)*greatest(0,{p}y2-{p}y1))"


def inter(a: str, b: str) -> str:
    return (
        f"(greatest(0,least({a}x2,{b}x2)-greatest({a}x1,{b}x1))"
        f"*greatest(0,least({a}y2,{b}y2)-greatest({a}y1,{b}y1)))"
    )


def iou(a: str, b: str) -> str:
    i = inter(a, b)
    return f"(case when {i}>0 then {i}/({area(a)}+{area(b)}-{i}) else 0.0 end)"


def center_in(a: str, b: str, pad: int = 0) -> str:
    return (
        f"(({a}x1+{a}x2)/2.0 between {b}x1-{pad} and {b}x2+{pad} "
        f"and ({a}y1+{a}y2)/2.0 between {b}y1-{pad} and {b}y2+{pad})"
    )


def cut(v: str, top: str) -> str:
    return f"greatest(0,least({v},{top}))"
