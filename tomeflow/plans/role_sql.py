"""The same roles as SQL common table expressions, for the side-by-side check."""

from __future__ import annotations

from tomeflow.plans import role_text as R

_LINE = ", ".join(R.LINE_ORDER)

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "r_documents": (
        (),
        f"SELECT {R.DOCUMENTS} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "r_sections": (
        (),
        f"""SELECT {R.SECTIONS}, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) as int) AS "order" FROM orders""",
    ),
    "r_subsections": (
        (),
        f"""SELECT concat(section_id, '-', cast("order" as string)) AS id, * FROM (
            SELECT {R.SUBSECTIONS}, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) as int) AS "order" FROM lineitem) q""",
    ),
    "r_tree": (
        ("r_sections", "r_subsections"),
        """SELECT s.*, h.document_id, h.name AS section_name, h."order" AS section_order
           FROM r_subsections s JOIN r_sections h ON s.section_id = h.id""",
    ),
    "r_events": ((), f"SELECT {R.EVENTS} FROM events"),
    "r_users": ((), f"SELECT {R.USERS} FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "r_images": ((), f"SELECT {R.IMAGES} FROM part"),
    "r_raw_html": ((), f"SELECT {R.RAW_HTML} FROM pages"),
}


def with_roles(sql: str, roles: tuple[str, ...]) -> str:
    names: list[str] = []

    def need(name: str) -> None:
        for dep in CTES[name][0]:
            need(dep)
        if name not in names:
            names.append(name)

    for name in roles:
        need(name)
    if not names:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in names)
    body = sql.strip()
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(word):
            return f"{word}{head},\n{body[len(word):]}"
    return f"WITH {head}\n{body}"
