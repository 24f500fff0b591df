"""SQL forms of the gap-filling closed form, for the oracle texts."""

from __future__ import annotations


def neighbour_ctes(src: str, cols: list[str], out: str, key: str = "site_id") -> str:
    """CTEs ``{out}_f`` and ``{out}`` over ``src`` (which has ``rn``): for each
    column the rn and value of the previous / next valid row."""
    nb = ",\n".join(
        f"max(CASE WHEN {c} IS NOT NULL THEN rn END) OVER (PARTITION BY {key} ORDER BY rn "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}__rn0,\n"
        f"min(CASE WHEN {c} IS NOT NULL THEN rn END) OVER (PARTITION BY {key} ORDER BY rn "
        f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}__rn1" for c in cols)
    joins = "\n".join(
        f"LEFT JOIN {src} p_{i} ON f.{key} = p_{i}.{key} AND f.{c}__rn0 = p_{i}.rn\n"
        f"LEFT JOIN {src} n_{i} ON f.{key} = n_{i}.{key} AND f.{c}__rn1 = n_{i}.rn"
        for i, c in enumerate(cols))
    vals = ", ".join(f"p_{i}.{c} AS {c}__v0, n_{i}.{c} AS {c}__v1" for i, c in enumerate(cols))
    return (f"{out}_f AS (SELECT {src}.*, {nb} FROM {src}),\n"
            f"{out} AS (SELECT f.*, {vals} FROM {out}_f f\n{joins})")


def fill_case(c: str, ffill_limit: int, interp_limit: int | None) -> str:
    k = f"rn - {c}__rn0"
    lim = ffill_limit
    interp = (f"({c}__v1 - {c}__v0) / CAST({c}__rn1 - {c}__rn0 - {lim} AS DOUBLE) "
              f"* CAST({k} - {lim} AS DOUBLE) + {c}__v0")
    parts = [f"WHEN {c} IS NOT NULL THEN {c}",
             f"WHEN {c}__v0 IS NULL THEN CAST(NULL AS DOUBLE)",
             f"WHEN {k} <= {lim} THEN {c}__v0"]
    if interp_limit is not None:
        parts.append(f"WHEN {k} - {lim} > {interp_limit} THEN CAST(NULL AS DOUBLE)")
    parts.append(f"WHEN {c}__v1 IS NULL THEN {c}__v0")
    parts.append(f"ELSE {interp}")
    return "CASE " + " ".join(parts) + " END"


def ffill_bfill_case(c: str) -> str:
    return f"coalesce({c}, {c}__v0, {c}__v1)"
