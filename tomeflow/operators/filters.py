"""Row filters, access rules and data-quality rules over documents, sections, subsections and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow import fixed_values as V
from tomeflow.operators import ordered


def blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c), F.lit("")) == ""


def in_group(group: str | None, staff_group: str) -> Column:
    """Staff see every group, other users their own."""
    return F.lit(True) if group in (None, staff_group) else F.col("group") == group


def list_documents(
    docs: DataFrame, status: str = "in progress", user_group: str = "", view: str = "own", staff_group: str = "staff"
) -> DataFrame:
    """Unarchived documents, newest first. Staff choose their own group's list or ``view='all'``."""
    out = docs.filter(F.col("archived").isNull())
    if status == "in progress":
        out = out.filter(~F.col("status").isin(V.CLOSED_STATUSES))
    elif status != "all":
        out = out.filter(F.col("status") == status)
    if not (user_group == staff_group and view == "all"):
        out = out.filter(F.col("group") == user_group)
    return out.orderBy(F.desc("updated"), "id")


def search_documents(docs: DataFrame, text: str) -> DataFrame:
    """Case-insensitive "contains" on four fields; % and _ have no special meaning; no text, no rows."""
    text = text.strip().lower()
    if not text:
        return docs.limit(0)
    hit = F.lit(False)
    for name in ("short_name", "title", "opdiv", "number"):
        hit = hit | F.lower(name).contains(text)
    return docs.filter(F.col("archived").isNull() & hit).orderBy(F.desc("updated"), "id")


def current_versions(docs: DataFrame, status: str | None = None, user_group: str | None = None, staff_group: str = "staff") -> DataFrame:
    out = docs.filter(F.col("archived").isNull() & F.col("successor").isNull())
    if status:
        out = out.filter(F.col("status") == status)
    return out.filter(in_group(user_group, staff_group))


def check_access(requests: DataFrame, users: DataFrame, docs: DataFrame, staff_group: str) -> DataFrame:
    """Is each requested (user_id, document_id) allowed: archived for staff only, else staff or same group."""
    u = users.select(F.col("id").alias("user_id"), F.col("group").alias("user_group"))
    d = docs.select(F.col("id").alias("document_id"), F.col("group").alias("document_group"), "archived")
    staff = F.col("user_group") == staff_group
    allowed = F.when(F.col("archived").isNotNull(), staff).otherwise(staff | (F.col("user_group") == F.col("document_group")))
    return requests.join(u, "user_id").join(d, "document_id").withColumn("allowed", allowed)


def documents_for_user(docs: DataFrame, user_group: str, staff_group: str) -> DataFrame:
    """The documents one user may open; a filter, so it reaches the scan."""
    if user_group == staff_group:
        return docs
    return docs.filter(F.col("archived").isNull() & (F.col("group") == user_group))


def manageable_users(users: DataFrame, manager_id: str, manager_group: str, is_superuser: bool) -> DataFrame:
    """The users one manager may manage."""
    others = users.filter(F.col("id") != manager_id)
    if not is_superuser:
        others = others.filter((F.col("group") == manager_group) & ~F.col("is_superuser"))
    return others.orderBy("email")


def check_manageable(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """May ``manager`` manage ``target`` for each pair asked about; two equi joins, no all-pairs step."""
    cols = ["group", "is_superuser", "is_opdiv_admin"]
    m = users.select(F.col("id").alias("manager"), *[F.col(c).alias(f"m_{c}") for c in cols])
    t = users.select(F.col("id").alias("target"), F.col("group").alias("t_group"), F.col("is_superuser").alias("t_super"))
    allowed = F.when(F.col("m_is_superuser"), True).otherwise(
        F.col("m_is_opdiv_admin") & (F.col("manager") != F.col("target")) & ~F.col("t_super") & (F.col("m_group") == F.col("t_group"))
    )
    return pairs.join(m, "manager").join(t, "target").select("manager", "target", allowed.alias("allowed"))


def normalize_users(users: DataFrame, staff_group: str) -> DataFrame:
    """Cleaned user rows; ``problem`` names the rule a row breaks (route those to a reject table)."""
    broken = F.col("is_superuser") & (F.col("group") != staff_group)
    return users.select(
        "id",
        F.lower("email").alias("email"),
        "group",
        F.nullif("external_id", F.lit("")).alias("external_id"),
        "is_superuser",
        F.col("is_superuser").alias("is_staff"),
        (F.col("is_opdiv_admin") & ~F.col("is_superuser")).alias("is_opdiv_admin"),
        F.when(broken, "superuser outside staff group").alias("problem"),
    )


def allowed_actions(docs: DataFrame) -> DataFrame:
    """One row per action a document's status permits, numbered in display order."""
    pairs = [x for s, acts in V.STATUS_ACTIONS.items() for x in (F.lit(s), F.array(*map(F.lit, acts)))]
    actions = F.create_map(*pairs)[F.lower("status")]
    return docs.select("id", "status", F.posexplode(actions).alias("position", "action"))


def section_page_flag(name: Column) -> Column:
    """False for reference parts such as a glossary."""
    flag = F.lit(True)
    for word in V.NO_SECTION_PAGE_WORDS:
        flag = flag & ~F.lower(name).contains(word)
    return flag


def breadcrumbs(sections: DataFrame) -> DataFrame:
    low = F.lower("name")
    label = F.lit(V.BREADCRUMB_DEFAULT)
    for part, text in reversed(V.BREADCRUMBS.items()):
        label = F.when(low.contains(part), text).otherwise(label)
    return sections.filter(low.rlike("^(step|contacts|learn)")).withColumn("breadcrumb", label)


def side_nav(sections: DataFrame) -> DataFrame:
    """A summary row for each document that has sections, then its sections by order."""
    first = sections.select("document_id").distinct().select(
        "document_id", F.lit(0).alias("order"), F.lit("summary-box-key-information").alias("html_id"), F.lit("Summary").alias("name")
    )
    return first.unionByName(sections.select("document_id", "order", "html_id", "name"))


def is_floating_callout() -> Column:
    listed = F.trim("name").isin(V.FLOATING_CALLOUTS)
    opens = F.lit(False)
    for text in V.FLOATING_CALLOUTS:
        opens = opens | F.trim("body").startswith(text)
    return F.when(F.col("name") != "", listed).otherwise(opens)


def floating_callouts(subsections: DataFrame) -> DataFrame:
    return subsections.filter(F.col("callout_box") & is_floating_callout())


def placeholder_or_blank(c: Column) -> Column:
    return (F.trim(c) == "") | F.trim(c).rlike(r"^\{[^{}]+\}$")


def missing_metadata(docs: DataFrame) -> DataFrame:
    """(document, field) for each of author, subject and keywords that is blank or only a placeholder."""
    long = docs.unpivot("id", ["author", "subject", "keywords"], "field", "value")
    return long.filter(placeholder_or_blank(F.coalesce("value", F.lit("")))).select("id", "field")


def not_started(subsections: DataFrame) -> DataFrame:
    return subsections.filter((F.col("edit_mode") != "locked") & (F.col("status") == "default"))


def visible_subsections(subsections: DataFrame) -> DataFrame:
    return subsections.filter(~F.col("hidden"))


def archive_documents(docs: DataFrame, requests: DataFrame, on: str, drafts_only: bool = True) -> DataFrame:
    """Outcome of a soft delete for each requested id; ``archived`` is set only where it is allowed."""
    d = docs.select("id", "status", F.col("archived").alias("was"))
    ok = F.col("was").isNull()
    if drafts_only:
        ok = ok & (F.col("status") == "draft")
    outcome = (
        F.when(F.col("status").isNull(), "not found")
        .when(ok, "archived")
        .when(F.col("was").isNotNull(), "already archived")
        .otherwise("not a draft")
    )
    rows = requests.select("id").distinct().join(d, "id", "left").withColumn("outcome", outcome)
    return rows.select("id", F.when(F.col("outcome") == "archived", F.to_date(F.lit(on))).otherwise(F.col("was")).alias("archived"), "outcome")


def doc_title_size(title: Column) -> Column:
    n = F.length(title)
    return F.when(n > 225, "very-very-small").when(n > 165, "very-small").when(n > 110, "smaller").otherwise("normal")


def _violations(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.select(F.lit(table).alias("table"), "id", F.explode(found).alias("rule"))


def validate_documents(docs: DataFrame, restricted: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    rules = {
        "title or number required": blank("title") & blank("number"),
        "title too long": F.length("title") > 250,
        "number too long": F.length("number") > 200,
        "unknown status": ~F.col("status").isin(V.STATUSES),
    }
    for group, fields in (restricted or {}).items():
        for field, allowed in fields.items():
            rules[f"{field} not permitted for group"] = (F.col("group") == group) & (F.col(field) != "") & ~F.col(field).isin(allowed)
    return _violations(docs, "documents", rules)


def validate_sections(sections: DataFrame, parents: tuple[str, str] | None = None) -> DataFrame:
    rules = {
        "heading too long": F.length("name") > 250,
        "blank name": F.col("name") == "",
        "blank id": F.coalesce("html_id", F.lit("")) == "",
    }
    if parents:
        a, b = parents
        rules["exactly one parent"] = F.col(a).isNull() == F.col(b).isNull()
    return _violations(sections, "sections", rules)


def validate_subsections(subsections: DataFrame) -> DataFrame:
    name, tag, body = F.col("name") != "", F.col("tag") != "", F.col("body") != ""
    rules = {
        "heading too long": F.length("name") > 400,
        "name without heading level": name & ~tag,
        "heading level without name": tag & ~name,
        "neither name nor content": ~name & ~body & ~tag,
        "unknown heading level": tag & ~F.col("tag").rlike("^h[2-7]$"),
        "unknown edit mode": ~F.col("edit_mode").isin(V.EDIT_MODES),
        "no variable in content": (F.col("edit_mode") == "variables") & ~F.col("body").rlike(r"\{[^{}]+\}"),
    }
    return _violations(subsections, "subsections", rules)


#: Default orders of lists, by name; the id settles ties.
ORDERS = {
    "documents, last updated first": ("-updated", "id"), "instances, last created first": ("-created", "id"), "documents by title": ("title", "id"),
    "users by email": ("email", "id"), "sections in order": ("order", "id"), "rows in order": ("order", "id"),
}


def in_order(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` in one of the default orders (``ORDERS``), with their place in it. No task sorts or numbers everything."""
    return ordered.row_numbers(rows, [], [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in ORDERS[name]])
