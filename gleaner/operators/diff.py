"""Differences of symbol and configuration snapshots, and the actions they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values: (change, kind of symbol) to (action, priority), and the same for configuration fields.
_KINDS = ("function", "method", "class")
ACTIONS = {
    **{("added", k): ("add_section", "medium") for k in (*_KINDS, "struct", "interface")},
    **{("removed", k): ("remove_section", "critical") for k in (*_KINDS, "struct", "interface")},
    **{("signature_changed", k): ("update_section", "high") for k in ("function", "method")},
    **{("modified", k): ("update_section", "low") for k in _KINDS},
    **{("parent_changed", k): ("update_section", "medium") for k in _KINDS},
    **{("doc_changed", k): ("update_section", "low") for k in _KINDS},
}
CONFIG_ACTIONS = {
    "added": ("add_field_doc", "high"),
    "removed": ("remove_section", "critical"),
    "type_changed": ("update_field_doc", "high"),
    "default_changed": ("update_example", "medium"),
}
PRIORITIES = ("critical", "high", "medium", "low")


def is_public(name: Column, file: Column) -> Column:
    """Python names without a leading underscore, Go names with a capital; all others."""
    return F.when(F.coalesce(name, F.lit("")) == "", False).when(F.endswith(file, F.lit(".py")), ~F.startswith(name, F.lit("_"))).when(F.endswith(file, F.lit(".go")), name.rlike(r"^\p{Lu}")).otherwise(True)


def last_wins(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def _sides(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Both snapshots, full-outer joined by null-safe-free keys; fields as o.* and n.* structs (null where a side is missing)."""
    o = last_wins(old, keys).select(*keys, F.struct(*fields).alias("o"))
    n = last_wins(new, keys).select(*keys, F.struct(*fields).alias("n"))
    return o.join(n, keys, "full_outer")


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two symbol snapshots (file, name, type, line, column, signature, parent, doc, ord), by file and name.

    The first that holds counts: added, removed, signature, parent (the old one not null), doc, place. A change of signature
    is breaking if the symbol is public, a removal always.
    """
    both = _sides(old, new, ["file", "name"], ["type", "line", "column", "signature", "parent", "doc"])
    o, n = (lambda f: F.col(f"o.{f}")), (lambda f: F.col(f"n.{f}"))
    differs = lambda f: ~o(f).eqNullSafe(n(f))
    kind = (
        F.when(F.col("o").isNull(), "added")
        .when(F.col("n").isNull(), "removed")
        .when(differs("signature"), "signature_changed")
        .when(differs("parent") & o("parent").isNotNull(), "parent_changed")
        .when(differs("doc"), "doc_changed")
        .when(differs("line"), "modified")
    )
    got = both.withColumn("change_type", kind).where("change_type is not null")
    breaking = (F.col("change_type") == "removed") | ((F.col("change_type") == "signature_changed") & is_public(F.col("name"), F.col("file")))
    return got.select(
        "name", "change_type", F.coalesce("n.type", "o.type").alias("symbol_type"), "file", F.col("n.line").alias("line"), F.col("n.column").alias("column"),
        F.col("o.signature").alias("old_signature"), F.col("n.signature").alias("new_signature"), F.col("o.parent").alias("old_parent"), F.col("n.parent").alias("new_parent"),
        F.col("o.doc").alias("old_doc"), F.col("n.doc").alias("new_doc"), F.when(breaking, "breaking").otherwise("non-breaking").alias("severity"),
    )


def widened(old: Column, new: Column) -> Column:
    """Whether a type takes on ``None`` and keeps its base."""
    base = lambda x: F.regexp_replace(F.replace(F.replace(x, F.lit(" | None"), F.lit("")), F.lit("Optional["), F.lit("")), "]+$", "")
    return F.contains(new, F.lit("None")) & ~F.contains(old, F.lit("None")) & F.contains(base(new), base(old))


def config_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two snapshots of configuration fields (file, parent_symbol, name, field_type, default_value,
    is_optional, ord). The first that holds counts: added, removed, type, default, optional to required."""
    both = _sides(old, new, ["file", "parent_symbol", "name"], ["field_type", "default_value", "is_optional"])
    o, n = (lambda f: F.col(f"o.{f}")), (lambda f: F.col(f"n.{f}"))
    tightened = o("is_optional") & ~n("is_optional")
    retyped = ~o("field_type").eqNullSafe(n("field_type"))
    kind = (
        F.when(F.col("o").isNull(), "added")
        .when(F.col("n").isNull(), "removed")
        .when(retyped, "type_changed")
        .when(~o("default_value").eqNullSafe(n("default_value")), "default_changed")
        .when(tightened, "type_changed")
    )
    soft = F.coalesce(widened(o("field_type"), n("field_type")), F.lit(False))
    got = both.withColumn("change_type", kind).where("change_type is not null")
    breaking = F.when(F.col("change_type") == "removed", True).when(F.col("change_type") == "type_changed", F.when(retyped, ~soft).otherwise(True)).otherwise(False)
    mark = (F.col("change_type") == "type_changed") & ~retyped
    action = F.when(F.col("change_type") == "added", "add_field_doc").when(F.col("change_type") == "removed", "remove_field_doc").otherwise("update_field_doc")
    return got.select(
        F.col("name").alias("field_name"), "parent_symbol", "change_type", "file",
        F.when(mark, F.concat(o("field_type"), F.lit(" (optional)"))).otherwise(o("field_type")).alias("old_type"),
        F.when(mark, F.concat(n("field_type"), F.lit(" (required)"))).otherwise(n("field_type")).alias("new_type"),
        o("default_value").alias("old_default"), n("default_value").alias("new_default"),
        F.when(breaking, "breaking").otherwise("non-breaking").alias("severity"), action.alias("documentation_action"),
    )


def ordered_changes(changes: DataFrame) -> DataFrame:
    """O1: breaking changes first, then by file and line (no line as 0), with the name to settle ties."""
    return changes.orderBy(F.when(F.col("severity") == "breaking", 0).otherwise(1), "file", F.coalesce("line", F.lit(0)), "name")


def ordered_config_changes(changes: DataFrame) -> DataFrame:
    """O2."""
    return changes.orderBy(F.when(F.col("severity") == "breaking", 0).otherwise(1), "file", "parent_symbol", "field_name")


def _looked_up(key: Column, table: dict[str, tuple[str, str]], i: int) -> Column:
    pairs = F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v[i])))
    return F.try_element_at(pairs, key)


def actions(changes: DataFrame, code_to_doc: DataFrame | None = None, affected: DataFrame | None = None, docs_path: str = "docs") -> DataFrame:
    """What each semantic change asks of the documentation: action_type, priority and target_file.

    The table of actions is small and fixed, so it is part of the expression; ``code_to_doc`` (file, doc, ord) and ``affected``
    (file, doc, ord) give target documents, the first of each file, in this order; else the path's convention does.
    """
    key = F.concat_ws("|", "change_type", "symbol_type")
    table = {f"{a}|{b}": v for (a, b), v in ACTIONS.items()}
    action = F.coalesce(_looked_up(key, table, 0), F.lit("update_section"))
    base = F.coalesce(_looked_up(key, table, 1), F.when(F.col("severity") == "breaking", "medium").otherwise("low"))
    priority = F.when((F.col("severity") == "breaking") & (base != "critical"), "high").otherwise(base)
    out = changes.withColumn("action_type", action).withColumn("priority", priority)
    targets = []
    for name, df in (("_dep", code_to_doc), ("_aff", affected)):
        if df is not None:
            out = out.join(df.groupBy("file").agg(F.min_by("doc", "ord").alias(name)), "file", "left")
            targets.append(F.col(name))
    target = F.coalesce(*targets, conventional_doc(F.col("file"), F.col("name"), docs_path))
    return out.withColumn("target_file", target).drop("_dep", "_aff")


def conventional_doc(file: Column, name: Column, docs_path: str = "docs") -> Column:
    """The document that a source file's path suggests."""
    base = F.element_at(F.split(file, "/"), -1)
    at = lambda *x: F.concat(F.lit(docs_path + "/"), *x)
    parts = F.split(file, "/")
    module = F.replace(F.replace(file, F.lit("/"), F.lit(".")), F.lit(".py"), F.lit(""))
    return (
        F.when(F.endswith(file, F.lit(".py")), at(F.lit("reference/"), F.element_at(F.split(module, r"\."), -1), F.lit(".md")))
        .when(F.endswith(file, F.lit(".go")) & F.array_contains(parts, "cmd"), at(F.lit("cli/"), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("main")), F.lit(".md")))
        .when(F.endswith(file, F.lit(".go")), at(F.lit("api/"), F.replace(base, F.lit(".go"), F.lit(".md"))))
        .when(file.rlike(r"\.(?:ts|tsx|js|jsx)$"), at(F.lit("api/"), F.element_at(F.split(base, r"\."), 1), F.lit(".md")))
        .when(F.endswith(file, F.lit(".rs")), at(F.lit("api/"), F.replace(base, F.lit(".rs"), F.lit(".md"))))
        .otherwise(at(F.lit("api/"), F.lower(name), F.lit(".md")))
    )


def config_actions(changes: DataFrame, doc: str = "docs/reference/configuration.md") -> DataFrame:
    """J18 for configuration fields."""
    base = F.coalesce(_looked_up(F.col("change_type"), CONFIG_ACTIONS, 1), F.when(F.col("severity") == "breaking", "medium").otherwise("low"))
    return (
        changes.withColumn("action_type", F.coalesce(_looked_up(F.col("change_type"), CONFIG_ACTIONS, 0), F.lit("update_section")))
        .withColumn("priority", F.when((F.col("severity") == "breaking") & (base != "critical"), "high").otherwise(base))
        .withColumn("target_file", F.lit(doc))
    )


def ordered_actions(items: DataFrame) -> DataFrame:
    """O3: by priority, file and name."""
    rank = F.array_position(F.array(*(F.lit(p) for p in PRIORITIES)), F.col("priority"))
    return items.orderBy(rank, "target_file", "name")
