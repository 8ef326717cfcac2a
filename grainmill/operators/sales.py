"""Sales arithmetic: find rows whose measures contradict each other, and repair them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.numbers import as_number, is_numeric_type, is_plain_number, round_even
from grainmill.functions.text import normalize_text, strip
from grainmill.operators.counting import column_medians
from grainmill.operators.roles import quoted, sales_roles

# Order states whose net amount is checked, and the one that makes it zero.
CANCELLED = "annulee"
CHECKED_STATUSES = ["annulee", "livree", "livre"]
TOLERANCE = 0.01
FREE_ROLES = ("delivery_fee", "delivery_cost")


def _number(df: DataFrame, name: str, allow_free: bool = False) -> Column:
    return as_number(quoted(name), df.schema[name].dataType, allow_free)


def _raw_issue(df: DataFrame, name: str) -> Column:
    if is_numeric_type(df.schema[name].dataType):
        return F.lit(False)
    return ~is_plain_number(quoted(name).cast("string"))


def sales_issue(df: DataFrame, roles: dict[str, str] | None = None) -> Column:
    """True for a row with a contradiction between its measures; NULL comparisons do not count."""
    roles = roles or sales_roles(df.columns)
    if not roles:
        return F.lit(False)
    number = {role: _number(df, name) for role, name in roles.items() if role != "status"}
    gross = number["gross"]
    rules = [
        number["quantity"] <= 0,
        number["unit_price"] < 0,
        F.abs(number["quantity"] * number["unit_price"] - gross) > TOLERANCE,
    ]
    if "discount" in number:
        rules += [number["discount"] < 0, number["discount"] > gross]
    if "delivery_cost" in number:
        rules.append(number["delivery_cost"] < 0)
    if "score" in number:
        rules += [number["score"] < 1, number["score"] > 5, number["score"] % 1 != 0]
    rules += [_raw_issue(df, name) for role, name in roles.items() if role != "status"]
    out = F.lit(False)
    for rule in rules:
        out = out | F.coalesce(rule, F.lit(False))
    return out


def _fallbacks(df: DataFrame, roles: dict[str, str]) -> dict[str, float]:
    """Median quantity, price and delivery cost, and the commonest score, of the valid cells."""
    quantity, price = _number(df, roles["quantity"]), _number(df, roles["unit_price"])
    wanted = {"quantity": F.when(quantity > 0, quantity), "unit_price": F.when(price >= 0, price)}
    if "delivery_cost" in roles:
        cost = _number(df, roles["delivery_cost"])
        wanted["delivery_cost"] = F.when(cost >= 0, cost)
    medians = column_medians(df, wanted)
    defaults = {"quantity": 1.0, "unit_price": 0.0, "delivery_cost": 0.0, "score": 4.0}
    found = {role: value for role, value in medians.items() if value is not None}
    if "score" in roles:
        score = _number(df, roles["score"])
        # Only the five whole scores remain, so the grouped table has at most five rows.
        valid = df.select(score.alias("s")).where((F.col("s").between(1, 5)) & (F.col("s") % 1 == 0))
        top = valid.groupBy("s").count().orderBy(F.desc("count"), "s").first()
        if top:
            found["score"] = top["s"]
    return {**defaults, **found}


def repair_sales(df: DataFrame, roles: dict[str, str] | None = None, flag: str | None = None) -> DataFrame:
    """Make quantity, price, gross, discount, fees, net, margin and score consistent.

    Each step reads the columns repaired before it. Rows are never compared with each other, so
    the whole repair is one projection; the four fallback values are single numbers. With `flag`, a
    boolean column says which rows changed.
    """
    roles = roles or sales_roles(df.columns)
    if not roles:
        return df.withColumn(flag, F.lit(False)) if flag else df
    fallback = _fallbacks(df, roles)
    has = roles.__contains__
    parsed = {
        f"_old_{role}": _number(df, name, role in FREE_ROLES) for role, name in roles.items() if role != "status"
    }
    # The margin step needs each original number, so parse once and carry the results.
    out = df.withColumns(parsed)
    old = {role: F.col(f"_old_{role}") for role in roles if role != "status"}

    bad_quantity = old["quantity"].isNull() | (old["quantity"] <= 0)
    ratio = F.when((old["gross"] > 0) & (old["unit_price"] > 0), old["gross"] / old["unit_price"])
    whole = F.when((ratio > 0) & (F.abs(ratio - F.rint(ratio)) < 0.01), F.rint(ratio))
    out = out.withColumn("_quantity", F.when(bad_quantity, F.coalesce(whole, F.lit(fallback["quantity"]))).otherwise(old["quantity"]))
    changed = bad_quantity

    quantity = F.col("_quantity")
    bad_price = old["unit_price"].isNull() | (old["unit_price"] < 0)
    ratio = F.when((old["gross"] > 0) & (quantity > 0), round_even(F.try_divide(old["gross"], quantity), 2))
    out = out.withColumn("_unit_price", F.when(bad_price, F.coalesce(ratio, F.lit(fallback["unit_price"]))).otherwise(old["unit_price"]))
    changed = changed | bad_price

    expected = round_even(quantity * F.col("_unit_price"), 2)
    out = out.withColumn("_expected", expected)
    bad_gross = old["gross"].isNull() | (old["gross"] < 0) | (F.abs(old["gross"] - F.col("_expected")) > TOLERANCE)
    out = out.withColumn("_gross", F.when(bad_gross, F.col("_expected")).otherwise(old["gross"]))
    changed = changed | bad_gross
    gross = F.col("_gross")

    if has("discount"):
        raw = quoted(roles["discount"])
        percent = F.lit(False) if is_numeric_type(df.schema[roles["discount"]].dataType) else strip(raw).endswith("%")
        value = F.when(percent, round_even(gross * old["discount"] / 100, 2)).otherwise(old["discount"])
        out = out.withColumn("_discount", F.when(value.between(F.lit(0.0), gross), value).otherwise(0.0))
        changed = changed | old["discount"].isNull() | (old["discount"] != F.col("_discount"))
    for role, default in (("delivery_fee", 0.0), ("delivery_cost", fallback["delivery_cost"])):
        if has(role):
            bad = old[role].isNull() | (old[role] < 0)
            out = out.withColumn(f"_{role}", F.when(bad, F.lit(default)).otherwise(old[role]))
            changed = changed | bad
    amount = lambda role: F.col(f"_{role}") if has(role) else F.lit(0.0)

    if has("net"):
        state = normalize_text(F.coalesce(quoted(roles["status"]).cast("string"), F.lit(""))) if has("status") else F.lit("")
        due = F.when(state == CANCELLED, 0.0).otherwise(gross - amount("discount") + amount("delivery_fee"))
        off = state.isin(CHECKED_STATUSES) & (old["net"].isNull() | (F.abs(old["net"] - due) > TOLERANCE))
        out = out.withColumn("_due", due).withColumn("_off", off)
        out = out.withColumn("_net", F.when(F.col("_off"), round_even(F.col("_due"), 2)).otherwise(old["net"]))
        changed = changed | F.col("_off")
    out = out.withColumn("_changed", F.coalesce(changed, F.lit(False)))
    if has("margin"):
        net, old_net = (F.col("_net"), old["net"]) if has("net") else (F.lit(None).cast("double"),) * 2
        prior = F.coalesce(old["delivery_cost"], F.lit(0.0)) if has("delivery_cost") else F.lit(0.0)
        product_cost = old_net - old["margin"] - prior
        rebased = round_even(net - product_cost - amount("delivery_cost"), 2)
        out = out.withColumn("_margin", F.coalesce(F.when(F.col("_changed"), rebased), old["margin"]))
    row_changed = F.col("_changed")
    if has("score"):
        valid = F.coalesce(old["score"].between(1, 5) & (old["score"] % 1 == 0), F.lit(False))
        out = out.withColumn("_score", F.when(valid, old["score"]).otherwise(F.lit(fallback["score"])))
        row_changed = row_changed | ~valid
    by_column = {name: role for role, name in roles.items() if role != "status"}
    columns = [F.col(f"_{by_column[c]}").alias(c) if c in by_column else quoted(c) for c in df.columns]
    return out.select(*columns, *([row_changed.alias(flag)] if flag else []))
